"""Exact top-k search by exhaustive term-at-a-time accumulation.

Candidates are dealt evenly over places, and every packed query block goes to every place. A task
holds the candidates of its place, ordered by id, and lets the query blocks pass. Each component is
a term: the queries' weights of that term, times the weights in the term's posting list, are added
to a dense array of scores. Terms with few postings are scattered one after another, the others
are added up as one product of their weight columns. Of each tile of scores only what beats a
query's k-th best so far is selected, so a task gives k rows a query; the places' winners are
merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a query block and of a tile of candidates; weights that either may hold; columns of a strip of scores.
QUERY_ROWS = 512
CANDIDATE_ROWS = 2048
TILE_WEIGHTS = 2**22
STRIP_ROWS = 256
#: A place has so many candidates at least, if there are more places, and takes so many bytes of them.
PLACE_ROWS = 2048
PLACE_BYTES = 64 * 2**20
SCALE = 256
#: What one product in the dense array costs less than one that is scattered.
SCATTER_COST = 128

_PACKED = "place int, asked boolean, ids binary, marks binary, sizes binary, values binary"


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """Columns vec_id, weights (array of bigint): each component times ``scale``, rounded down.
    A vector that is null, or holds a null or non-finite component, is left out, as is a null id.
    Products are exact as 64-bit integers."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    return rows.select(F.col("vec_id").cast("bigint"), F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("weights"))


def _blocks(rows: DataFrame, size: int, kind: str) -> DataFrame:
    """Rows packed as (ids, hashes of weights, lengths, values) of at most ``size`` vectors of one place, in
    binaries; the values are integers of numpy's ``kind``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pa.array(np.argsort(batch.column("place").to_numpy(), kind="stable")))
            ends = [0, *(np.flatnonzero(np.diff(batch.column("place").to_numpy())) + 1).tolist(), batch.num_rows]
            for first, last in zip(ends, ends[1:], strict=False):
                for start in range(first, last, size):
                    part = batch.slice(start, min(size, last - start))
                    weights = part.column("weights")
                    packed = [part.column("vec_id").to_numpy(), part.column("mark").to_numpy(), pa.compute.list_value_length(weights).to_numpy()]
                    binaries = [*(x.astype(np.int64).tobytes() for x in packed), weights.flatten().to_numpy().astype(kind).tobytes()]
                    yield pa.RecordBatch.from_arrays([part.column("place")[:1], part.column("asked")[:1], *(pa.array([x], pa.binary()) for x in binaries)], names=["place", "asked", "ids", "marks", "sizes", "values"])

    return rows.select("place", "asked", "vec_id", "mark", "weights").mapInArrow(run, _PACKED)


def _fill(table: np.ndarray, places: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> None:
    """Write vectors into the given rows of a table of zeros; what is longer than the table is cut."""
    width = table.shape[1]
    if len(sizes) and (sizes == sizes[0]).all():
        table[places, : sizes[0]] = values.reshape(len(sizes), sizes[0])[:, :width]
        return
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = at < width
    table[np.repeat(places, sizes)[kept], at[kept]] = values[kept]


class _Packed:
    """Packed blocks on their way to one table, ordered by id if asked for."""

    def __init__(self, kind: str, width: int):
        self.kind, self.width, self.blocks, self.rows = kind, width, [], 0

    def add(self, batch: pa.RecordBatch, row: int) -> None:
        packed = [np.frombuffer(batch.column(name)[row].as_buffer(), kind) for name, kind in (("ids", np.int64), ("marks", np.int64), ("sizes", np.int64), ("values", self.kind))]
        # copies, or each block would keep its whole batch
        self.blocks.append([x.copy() for x in packed])
        self.rows += len(packed[0])

    def take(self, ordered: bool, step: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, hashes and the table of weights, short vectors filled up with zeros, as is the table to a
        multiple of ``step`` rows; the blocks are given up."""
        ids, marks = (np.concatenate([np.zeros(0, np.int64), *(block[n] for block in self.blocks)]) for n in (0, 1))
        order = np.argsort(ids, kind="stable") if ordered else np.arange(len(ids))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        table, stop = np.zeros((-(-len(ids) // step) * step, self.width), self.kind), len(ids)
        while self.blocks:
            block = self.blocks.pop()
            _fill(table, place[stop - len(block[0]) : stop], *block[2:])
            stop -= len(block[0])
        self.rows = 0
        return ids[order], marks[order], table


def accumulate(queries: np.ndarray, candidates: np.ndarray, asked: np.ndarray, held: np.ndarray, scores: np.ndarray) -> None:
    """All inner products into ``scores``. ``asked`` and ``held`` are the numbers of queries and candidates
    that have each term. Terms that few have are added one after another, each to the rows that ask for it
    and the places of its posting list, the others together."""
    rare = asked * held * SCATTER_COST < scores.size
    many = np.flatnonzero(~rare)
    if len(many) == len(rare):
        np.matmul(queries, candidates.T, out=scores)
    else:
        np.matmul(queries[:, many], candidates[:, many].T, out=scores)
    for term in np.flatnonzero(rare & (asked > 0) & (held > 0)):
        asking, posting = np.flatnonzero(queries[:, term]), np.flatnonzero(candidates[:, term])
        scores[asking[:, None], posting] += queries[asking, term][:, None] * candidates[posting, term]


class Best:
    """The k best candidates of each query so far, in their order; ties go to the smaller id."""

    def __init__(self, query_ids: np.ndarray, k: int, dtype: type):
        #: less than any score
        self.none = -np.inf if np.issubdtype(dtype, np.floating) else -(2**62)
        self.query_ids, self.k = query_ids, k
        self.ids, self.scores = np.zeros((len(query_ids), k), np.int64), np.full((len(query_ids), k), self.none, dtype)
        self.found, self.waiting = [], 0

    def select(self, candidate_ids: np.ndarray, scores: np.ndarray) -> None:
        """Take in what may be among the best of a tile: candidates ordered by id, none smaller than an earlier
        tile's, and their scores, which may have more columns. Rows with the query's own id are no candidates."""
        scores[:, len(candidate_ids) :] = self.none
        first, last = (np.searchsorted(candidate_ids, self.query_ids, side) for side in ("left", "right"))
        for place in np.flatnonzero(first < last):
            scores[place, first[place] : last[place]] = self.none
        # an equal score has no smaller id than the k-th best, so it is none better
        bar, width = self.scores[:, -1], scores.shape[1]
        strips = scores.reshape(-1, min(STRIP_ROWS, width))
        each = len(strips) // len(scores)
        high = np.flatnonzero(strips.max(axis=1).reshape(-1, each) > bar[:, None])
        if width > self.k and 2 * len(high) > len(strips):
            # the k-th score of the tile; of the rows that reach just it, the first k will do
            least = np.partition(scores, -self.k, axis=1)[:, -self.k][:, None]
            better = (scores >= least) & (scores > bar[:, None])
            if np.count_nonzero(better) > 2 * self.k * len(scores):
                better &= (scores > least) | (np.cumsum(scores == least, axis=1, dtype=np.int32) <= self.k)
            at, column = np.divmod(np.flatnonzero(better), width)
        else:
            # only the strips whose highest score is over the bar are looked through
            strip, step = np.divmod(np.flatnonzero(strips[high] > bar[high // each][:, None]), strips.shape[1])
            at, strip = np.divmod(high[strip], each)
            column = strip * strips.shape[1] + step
        self.found.append((at, candidate_ids[column], scores[at, column]))
        self.waiting += len(at)
        if self.waiting > 2 * self.k * len(scores) or (bar == self.none).any():
            self.settle()

    def settle(self) -> None:
        """Rank what was found with the best so far."""
        # these are of smaller ids and stand first, and tiles are in the order of ids, so a stable sort keeps that order
        at, ids, values = (np.concatenate(x) for x in zip((np.repeat(np.arange(len(self.ids)), self.k), self.ids.ravel(), self.scores.ravel()), *self.found, strict=True))
        order = np.lexsort((-values, at))
        best = order[np.searchsorted(at[order], np.arange(len(self.ids)))[:, None] + np.arange(self.k)]
        self.ids, self.scores = ids[best], values[best]
        self.found, self.waiting = [], 0


def _dtype(bound: float) -> type:
    """The type in which sums of integers up to ``bound`` are exact and fast."""
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64


def _places(spark: SparkSession, n: int, n_asked: int, row_bytes: int) -> int:
    """A place holds what a task has room for. More places keep more cores busy, as far as the query blocks,
    which go to all of them, are no more than the candidates, or four tasks a core."""
    full = -(-n * row_bytes // PLACE_BYTES)
    busy = max(n // max(1, n_asked), 4 * spark.sparkContext.defaultParallelism)
    return max(1, full, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // PLACE_ROWS, busy))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k candidates of the highest integer inner product for every query row: columns query_id,
    rank (from 1), vec_id, score. Both inputs have vec_id and weights as ``usable`` gives them; other
    columns are ignored. Vectors of other lengths count as filled up with zeros. Ties go to the
    smaller vec_id; rows of the query's own id are left out; repeated rows of an id are one vector
    each and may each be found; query rows of one id are one query for each different vector, equal ones
    are one. Products too large for 64-bit sums raise an OverflowError. Fewer candidates give fewer rows, none give none.
    Queries are packed, and only packed blocks are repeated, once for each place; candidates are sent once."""
    spark = vectors.sparkSession
    largest = F.greatest(F.array_max("weights").cast("double"), -F.array_min("weights").cast("double"))
    (terms, most, n), (asked_terms, asked_most, n_asked) = ((size or 0, top or 0.0, count) for size, top, count in (rows.agg(F.max(F.size("weights")), F.max(largest), F.count("*")).first() for rows in (vectors, queries)))
    terms = min(terms, asked_terms)
    bound = terms * most * asked_most
    if bound >= 2**62:
        raise OverflowError("the components are too large for 64-bit inner products")
    dtype, kind = _dtype(bound), next(x for x in ("i1", "i2", "i4", "i8") if max(most, asked_most) < 2.0 ** (8 * int(x[1]) - 1) or x == "i8")
    places = _places(spark, n, n_asked, terms * int(kind[1]) + 24)
    query_rows, tile_rows = (max(1, min(rows, TILE_WEIGHTS // max(1, terms))) for rows in (QUERY_ROWS, CANDIDATE_ROWS))
    tile_rows -= tile_rows % STRIP_ROWS if tile_rows > STRIP_ROWS else 0

    marked = [rows.select("vec_id", "weights", F.xxhash64("weights").alias("mark")) for rows in (vectors, queries.select("vec_id", "weights").dropDuplicates())]
    # by content, so that a task that runs again deals its rows as before; copies of a row are parted by their partition
    place = F.pmod(F.pmod(F.xxhash64("vec_id", "mark"), F.lit(places)) + F.spark_partition_id(), F.lit(places)).cast("int")
    candidates = _blocks(marked[0].withColumns({"place": place, "asked": F.lit(False)}), tile_rows, kind)
    asked = _blocks(marked[1].withColumns({"place": F.lit(0), "asked": F.lit(True)}), query_rows, kind)
    asked = asked.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(places - 1))))
    met = candidates.unionByName(asked).repartitionById(places, "place").sortWithinPartitions("place", "asked")

    def tiles(held: _Packed) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, weights and the number of candidates of each term, by tiles."""
        ids, _, table = held.take(ordered=True, step=STRIP_ROWS)
        parts = [(ids[x : x + tile_rows], table[x : x + tile_rows]) for x in range(0, len(ids), tile_rows)]
        return [(own, part, np.count_nonzero(part, axis=0)) for own, part in parts]

    def winners(query: _Packed, candidates: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        query_ids, marks, weights = query.take(ordered=False)
        counts, weights, best = np.count_nonzero(weights, axis=0), weights.astype(dtype), Best(query_ids, max(k, 1), dtype)
        space = np.empty(len(query_ids) * tile_rows, dtype)
        for ids, table, held in candidates:
            scores = space[: len(query_ids) * len(table)].reshape(len(query_ids), len(table))
            accumulate(weights, table.astype(dtype), counts, held, scores)
            best.select(ids, scores)
        best.settle()
        at, rank = np.nonzero(best.scores != best.none)
        columns = [query_ids[at], marks[at], best.ids[at, rank], best.scores[at, rank].astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "mark", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, query, tiled = None, _Packed(kind, terms), _Packed(kind, terms), None
        for batch in batches:
            for row, (here, asking) in enumerate(zip(batch.column("place").to_pylist(), batch.column("asked").to_pylist(), strict=True)):
                if here != at:
                    if query.rows:
                        yield winners(query, tiled)
                    at, held, tiled = here, _Packed(kind, terms), None
                if not asking:
                    held.add(batch, row)
                    continue
                if tiled is None:
                    tiled = tiles(held)
                query.add(batch, row)
                if query.rows >= query_rows:
                    yield winners(query, tiled)
        if query.rows:
            yield winners(query, tiled)

    # a place gives k rows a query; the rank limit is applied in each task before the shuffle
    found = met.mapInArrow(run, "query_id bigint, mark bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "mark").orderBy(F.col("score").desc(), "vec_id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)

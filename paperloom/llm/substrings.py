"""Long repeated word spans by a compacted de Bruijn graph.

Edges of the graph are the runs of ``window`` consecutive words of all documents. As usual for such
graphs they are partitioned by minimizer: the smallest hash among the runs of ``ANCHOR`` words
inside, so equal windows share an anchor at the same place. Consecutive windows of a document with
one anchor are compacted at once into a path; a path occurs in a document at source coordinates
(place, number of windows) and is known by its content. Only paths whose anchor occurs in several
documents can repeat. Where all paths of an anchor have one content they are copies and the
path never branches; where contents differ, joins over the windows of one occurrence of each
content, read from the text at its coordinates, find what the branches share. Each window thus
learns the smallest document that holds it, and every later document loses the words it covers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.words import Spans, buffers, covered, mix, slices, whole, windows
from paperloom.session import ensure_checkpoint_dir

WINDOW = 50
ANCHOR = 10
#: Null ids come after all others.
LAST = (1 << 63) - 1

PATHS = "doc bigint, version bigint, anchor bigint, content bigint, at int, n int"


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of each ``width`` consecutive values, the first among equals."""
    places = np.arange(len(values))
    size = 1
    while size < width:
        step = min(size, width - size)
        a, b = places[:-step], places[step:]
        places = np.where(values[b] < values[a], b, a)
        size += step
    return places


def paths(spans: Spans, hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Compacted paths of all texts: text, anchor, content, first word (in its text), windows."""
    starts, texts = whole(spans, window)
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    anchors = windows(hashes, anchor)
    owner = leftmost_minima(anchors, window - anchor + 1)[starts]
    edges = windows(hashes, window)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (texts[1:] != texts[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    # first and last window overlap, so together with their distance they tell all the words
    content = mix(edges[first] * np.uint64(0x9FB21C651E98DF25) + edges[last] + (last - first).astype(np.uint64))
    return texts[first], anchors[owner[first]], content, starts[first] - spans.first[texts[first]], last - first + 1


def _emit_paths(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                spans = Spans(*buffers(part.column("text")))
                text, key, content, at, n = paths(spans, spans.hashes(), window, anchor)
                own = pa.array(text)
                columns = [part.column("doc").take(own), part.column("version").take(own), pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "version", "anchor", "content", "at", "n"])

    return run


def _emit_windows(window: int):
    """Windows of the paths asked for (array of anchor, content, doc, at, n) in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                spans = Spans(*buffers(part.column("text")))
                edges = windows(spans.hashes(), window)
                asked = part.column("asked")
                text = np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(asked).to_numpy())
                flat = asked.flatten()
                n = flat.field("n").to_numpy().astype(np.int64)
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row = np.repeat(np.arange(len(n)), n)
                place = spans.first[text][row] + flat.field("at").to_numpy()[row] + within
                rows = pa.array(row)
                columns = [flat.field(c).take(rows) for c in ("anchor", "content")] + [part.column("doc").take(pa.array(text[row])), pa.array(within.astype(np.int32)), pa.array(edges[place].view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "content", "low", "i", "edge"])

    return run


def repeated_spans(keyed: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Columns doc, version, spans: the runs of windows (at, n) of each text (columns doc, version,
    text) that also start in a text of a smaller ``doc``. Hot anchors and contents are reduced to one
    row each before they are joined back to their places."""
    ensure_checkpoint_dir(keyed.sparkSession)
    texts = keyed.select("doc", "version", "text")
    found = texts.mapInArrow(_emit_paths(window, anchor), PATHS)
    shared = found.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("anchor")
    # places of paths that may repeat, read three times below
    places = found.join(shared, "anchor", "left_semi").checkpoint()
    contents = places.groupBy("anchor", "content").agg(F.min(F.struct("doc", "version", "at", "n")).alias("src"))
    branching = contents.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor")
    asked = contents.join(branching, "anchor", "left_semi").groupBy(F.col("src.doc").alias("doc"), F.col("src.version").alias("version"))
    asked = asked.agg(F.collect_list(F.struct("anchor", "content", F.col("src.at").alias("at"), F.col("src.n").alias("n"))).alias("asked"))
    # rows that share id and text are copies, one of them is read
    sources = asked.join(texts, ["doc", "version"]).dropDuplicates(["doc", "version"])
    edges = sources.select("doc", "text", "asked").mapInArrow(_emit_windows(window), "anchor bigint, content bigint, low bigint, i int, edge bigint")
    lowest = edges.groupBy("anchor", "edge").agg(F.min("low").alias("least"), F.max("low").alias("most")).where("least < most").select("anchor", "edge", "least")
    better = edges.join(lowest, ["anchor", "edge"]).where("least < low").groupBy("anchor", "content").agg(F.collect_list(F.struct("i", "least")).alias("better"))
    known = contents.select("anchor", "content", F.col("src.doc").alias("low")).join(better, ["anchor", "content"], "left")
    hits = places.join(known, ["anchor", "content"]).where("doc > low or better is not null")
    own = F.when(F.col("doc") > F.col("low"), F.array(F.struct(F.col("at").alias("at"), F.col("n").alias("n")))).otherwise(
        F.transform(F.filter("better", lambda b: b["least"] < F.col("doc")), lambda b: F.struct((F.col("at") + b["i"]).alias("at"), F.lit(1).alias("n")))
    )
    return hits.groupBy("doc", "version").agg(F.flatten(F.collect_list(own)).alias("spans")).where(F.size("spans") > 0)


def _cut(window: int, passing: list[str], fields: list[str]):
    """Remove covered words; gives the columns ``passing`` and those of ``fields``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text")
                data, off = buffers(texts)
                spans = Spans(data, off)
                found = part.column("spans")
                text = np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(found).fill_null(0).to_numpy())
                flat = found.flatten()
                n = flat.field("n").to_numpy().astype(np.int64)
                first = spans.first[text] + flat.field("at").to_numpy()
                row = np.repeat(np.arange(len(n)), n)
                marks = first[row] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                gone = covered(marks, window, len(spans.starts))
                out: dict[str, list] = {f: [] for f in fields}
                raw = data.tobytes()
                for i in range(part.num_rows):
                    a, b = spans.first[i], spans.first[i + 1]
                    own = gone[a:b]
                    lost = int(own.sum())
                    whole_text = raw[off[i] : off[i + 1]]
                    if "n_words" in out:
                        out["n_words"].append(int(b - a))
                        out["n_removed"].append(lost)
                        words = whole_text.split()
                        if lost:
                            words = [w for w, g in zip(words, own, strict=True) if not g]
                        out["kept_sha256"].append(hashlib.sha256(b" ".join(words)).hexdigest())
                    if "kept" in out:
                        if not texts[i].is_valid:
                            out["kept"].append(None)
                        elif not lost:
                            out["kept"].append(whole_text.decode())
                        else:
                            # a removed run goes up to the next word that stays
                            edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
                            starts = np.concatenate([spans.starts[a:b], [off[i + 1]]])
                            at, pieces = int(off[i]), []
                            for lo, hi in zip(edge[::2], edge[1::2], strict=True):
                                pieces.append(raw[at : starts[lo]])
                                at = int(starts[hi])
                            out["kept"].append((b"".join(pieces) + raw[at : off[i + 1]]).decode())
                columns = [part.column(c) for c in passing]
                for f in fields:
                    columns.append(pa.array(out[f], pa.string() if f in ("kept", "kept_sha256") else pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, names=[*passing, *fields])

    return run


def digests(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """For each row: doc_id, n_words, n_removed and the digest of the words that stay (see
    ``remove_repeats`` for what goes)."""
    doc_id = F.col("doc_id").cast("bigint")
    keyed = documents.select(F.coalesce(doc_id, F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("version"), "text", doc_id.alias("doc_id"))
    spans = repeated_spans(keyed, window, anchor)
    rows = keyed.join(spans, ["doc", "version"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_cut(window, ["doc_id"], ["n_words", "n_removed", "kept_sha256"]), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def remove_repeats(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Every row of ``documents`` with all its columns, its ``text`` less each word covered by a window
    of ``window`` words whose sequence also starts in a document of a smaller doc_id. What is left
    keeps its white space up to each removed run. Windows are judged on the input. A null text stays
    null; texts of fewer words than a window stay; repeats inside one document stay; rows of one id are
    one document here, so they lose nothing to each other; null ids come after all others and lose
    nothing to each other; other columns, whatever their names, are kept; no rows give none."""
    keyed = documents.select(F.struct(*[documents[c] for c in documents.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("version"), "text")
    spans = repeated_spans(keyed, window, anchor)
    row = keyed.schema["row"].dataType.simpleString()
    cut = keyed.join(spans, ["doc", "version"], "left").select("row", "text", "spans").mapInArrow(_cut(window, ["row"], ["kept"]), f"row {row}, kept string")
    return cut.select(*[(F.col("kept") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in documents.columns])

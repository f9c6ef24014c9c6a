"""Exact Jaccard self-join of word n-gram sets by vertical partitioning, with its components.

The order of all n-grams is cut into fragments by hash, and each fragment counts on its own:

1. Every text sends the n-grams of its set to their fragments, packed by block of texts. A fragment
   counts how many texts have each n-gram and returns, for each text, how many of its n-grams no
   other text has. Summed over the fragments this gives the part of a set that can be shared; a text
   whose shareable part is below the threshold has no link, and most texts end here.
2. The rest, one text for each distinct set, is ordered by frequency, again by fragment, rare n-grams
   first. Sets that link share an n-gram of their prefixes; those n-grams are the postings.
3. Links are sought in rounds. The members of a posting are met by a few of its first members, the
   hubs, four times as many each round, but only where the two are not yet connected. The overlap of
   such a pair is counted fragment by fragment and summed. Connected members need not meet, so a
   group of copies of any size costs one pair a member; a posting is done when its members are
   connected or all have been hubs. A pair is counted only if what either set has from the common
   n-gram on could suffice, as it must at the first n-gram they share. No pair that could connect
   anything is left out.

N-grams and sets are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.scratch import Scratch
from paperloom.llm.words import LOWER, Spans, buffers, mix, per_text, slices, whole, windows

WORDS = 5
PERCENT = 75
#: n-grams a fragment holds on average.
FRAGMENT_GRAMS = 1 << 20
#: Fragments that the overlap of a pair is counted in.
OVERLAP_FRAGMENTS = 4
#: Members of a posting that one task ranks on average.
LANE_MEMBERS = 1 << 12
BLOCK_BYTES = 6 << 20


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, and the texts' offsets in them. A text of fewer
    words has one n-gram, its whole sequence; a text without words has none."""
    data, off = buffers(texts)
    spans = Spans(LOWER[data], off)
    hashes = spans.hashes()
    at, owner = whole(spans, words)
    found = [mix(windows(hashes, words)[at] + np.uint64(words))]
    owners = [owner]
    counts = spans.counts
    for n in range(1, words):
        short = np.flatnonzero(counts == n)
        if len(short):
            found.append(mix(windows(hashes, n)[spans.first[short]] + np.uint64(n)))
            owners.append(short)
    grams, owner = np.concatenate(found), np.concatenate(owners)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return grams, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])


def set_ids(grams: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for an empty one."""
    sums = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=sums[1:])
    more = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(mix(grams + np.uint64(0x632BE59BD9B4E019)), out=more[1:])
    sizes = np.diff(ends).astype(np.uint64)
    own = mix((sums[ends[1:]] - sums[ends[:-1]]) * np.uint64(0x9FB21C651E98DF25) + (more[ends[1:]] - more[ends[:-1]]) + sizes)
    return np.where(sizes > 0, own, np.uint64(0)).view(np.int64)


def _fragment(grams: np.ndarray, fragments: int) -> np.ndarray:
    return ((grams >> np.uint64(32)) % np.uint64(fragments)).astype(np.int32)


def _low(grams: np.ndarray) -> bytes:
    """The low three bytes; within a fragment of a million n-grams few share them, and those few only
    count as shared when they are not."""
    return grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :3].tobytes()


def _send(fragments: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        block = (context.partitionId() if context else 0) << 32
        for batch in batches:
            for part in slices(batch, limit=BLOCK_BYTES):
                grams, ends = shingles(part.column("text"), words)
                ids, sizes = set_ids(grams, ends), np.diff(ends)
                fragment = _fragment(grams, fragments)
                order = np.argsort(fragment, kind="stable")
                cuts = np.concatenate([[0], np.cumsum(np.bincount(fragment, minlength=fragments))])
                owner = np.repeat(np.arange(part.num_rows), sizes)[order]
                sorted_grams = grams[order]
                rows = []
                for f in range(fragments):
                    a, b = cuts[f], cuts[f + 1]
                    counts = np.bincount(owner[a:b], minlength=part.num_rows).astype("<u4")
                    head = f == 0
                    rows.append((f, block, _narrow(counts), _low(sorted_grams[a:b])) + ((part.column("doc_id").to_pylist(), ids.tolist(), sizes.tolist(), part.column("version").to_pylist()) if head else (None,) * 4))
                block += 1
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()] + [pa.list_(pa.int64())] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["fragment", "block", "counts", "grams", "doc_ids", "sets", "sizes", "versions"])

    return run


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in one, two or four bytes each, told by the first byte."""
    most = int(counts.max(initial=0))
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _count_alone(sent: pa.Table) -> pa.Table:
    """For each block of a fragment: how many n-grams of each text no other text has here."""
    counts = [_wide(c) for c in sent.column("counts").to_pylist()]
    low = [np.frombuffer(g, np.uint8).reshape(-1, 3) for g in sent.column("grams").to_pylist()]
    sizes = [len(x) for x in low]
    table = np.zeros((sum(sizes), 4), np.uint8)
    table[:, :3] = np.concatenate(low)
    keys = table.view("<u4").ravel()
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    alone = np.ones(len(keys), bool)
    alone[order[1:][same]] = False
    alone[order[:-1][same]] = False
    out, at = [], 0
    for own, size in zip(counts, sizes, strict=True):
        out.append(_narrow(per_text(alone[at : at + size], np.concatenate([[0], np.cumsum(own)]))))
        at += size
    return pa.table([sent.column("block"), pa.array(out, pa.binary()), *(sent.column(c) for c in ("doc_ids", "sets", "sizes", "versions"))], names=["block", "alone", "doc_ids", "sets", "sizes", "versions"])


def _sum_alone(parts: pa.Table) -> pa.Table:
    """One row for each text of a block: its set, size and n-grams of its own."""
    total = sum(_wide(a) for a in parts.column("alone").to_pylist())
    head = next(i for i, x in enumerate(parts.column("sets")) if x.is_valid)
    lists = [parts.column(c)[head].as_py() for c in ("doc_ids", "sets", "sizes", "versions")]
    return pa.table([pa.array(x, pa.int64()) for x in (*lists, total)], names=["doc_id", "set", "size", "version", "alone"])


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                grams, ends = shingles(part.column("text"), words)
                values = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(grams.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(set_ids(grams, ends)), pa.array(np.diff(ends).astype(np.int64)), values], names=["set", "size", "grams"])

    return run


def _may_link(size: Column, shared: Column, percent: int) -> Column:
    """At most ``shared`` n-grams in common with any other set, and no union below ``size``."""
    return 100 * shared >= percent * size


def links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Component of each set that links with another: columns set, component (the least set id of the
    component). ``sets``: set, size, grams (array of distinct bigint), one row for each set."""
    scratch = Scratch(sets.sparkSession)
    tokens = sets.select("set", "size", F.explode("grams").alias("gram"))
    # the frequency of an n-gram is added up before it is joined to its sets
    frequent = tokens.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    shared = tokens.join(frequent, "gram").groupBy("set", "size").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("order"))
    own = F.col("size") - F.size("order")
    # the prefix has size - ceil(percent * size / 100) + 1 n-grams, the set's own ones first
    prefix = (F.col("size") - F.ceil(F.col("size") * percent / 100) + 1 - own).cast("int")
    prefixes = shared.where(prefix > 0).select("set", "size", F.size("order").alias("common"), F.posexplode(F.slice("order", 1, prefix)).alias("place", "t"))
    # ``left`` n-grams of the set come at or after this one
    postings = prefixes.select("set", "size", F.col("t.gram").alias("gram"), (F.col("common") - F.col("place")).alias("left"))
    postings = scratch.write(postings, "postings")
    members = postings.groupBy("gram").agg(F.count("*").alias("members")).where("members > 1")
    # the members of a common n-gram are ranked in lanes, which take turns: no task sorts them all, and no rank comes twice
    lanes = F.ceil(F.col("members") / LANE_MEMBERS)
    placed = postings.join(members, "gram").withColumn("lanes", lanes).withColumn("lane", F.pmod(F.xxhash64("set"), F.col("lanes")))
    # the join leaves all of an n-gram in one place, which the window would take as it is
    placed = placed.repartition("gram", "lane")
    ranked = Window.partitionBy("gram", "lane").orderBy("set")
    placed = placed.withColumn("rank", (F.row_number().over(ranked) - 1) * F.col("lanes") + F.col("lane"))
    postings = scratch.write(placed.select("set", "size", "gram", "left", "rank"), "postings")
    part = F.pmod(F.shiftright("gram", 32), F.lit(OVERLAP_FRAGMENTS))
    fragments = tokens.join(postings.select("set").distinct(), "set", "left_semi").groupBy("set", part.alias("fragment")).agg(F.collect_list("gram").alias("grams"))
    fragments = scratch.write(fragments, "fragments")
    component = scratch.write(postings.select("set").distinct().select("set", F.col("set").alias("component")), "component")
    first, hubs = 0, 1
    while True:
        placed = postings.join(component, "set")
        met = placed.where((F.col("rank") >= first) & (F.col("rank") < first + hubs)).select("gram", F.col("set").alias("a"), F.col("size").alias("size_a"), F.col("left").alias("left_a"), F.col("rank").alias("rank_a"), F.col("component").alias("component_a"))
        pairs = met.join(placed, "gram").where((F.col("rank") > F.col("rank_a")) & (F.col("component") != F.col("component_a")))
        # at its first common n-gram a pair has no more in common than what either set has from there on
        most = F.least("left", "left_a")
        pairs = pairs.where(100 * most >= percent * (F.col("size") + F.col("size_a") - most)).select("a", "size_a", F.col("set").alias("b"), F.col("size").alias("size_b")).distinct()
        overlap = pairs.join(fragments.select(F.col("set").alias("a"), "fragment", F.col("grams").alias("grams_a")), "a").join(fragments.select(F.col("set").alias("b"), "fragment", "grams"), ["b", "fragment"])
        overlap = overlap.select("a", "b", "size_a", "size_b", F.size(F.array_intersect("grams_a", "grams")).alias("n")).groupBy("a", "b", "size_a", "size_b").agg(F.sum("n").alias("n"))
        found = overlap.where(100 * F.col("n") >= percent * (F.col("size_a") + F.col("size_b") - F.col("n"))).select("a", "b")
        edges = found.join(component.select(F.col("set").alias("a"), F.col("component").alias("u")), "a").join(component.select(F.col("set").alias("b"), F.col("component").alias("v")), "b")
        edges = scratch.write(edges.select("u", "v").distinct(), "edges")
        if not edges.isEmpty():
            merged = connected(edges)
            component = component.join(merged.select(F.col("node").alias("component"), "least"), "component", "left").select("set", F.coalesce("least", "component").alias("component"))
            component = scratch.write(component, "component")
        first, hubs = first + hubs, hubs * 4
        # what is left: members from the next hub on, where members are not all connected
        left = postings.where(F.col("rank") >= first)
        mixed = left.join(component, "set").groupBy("gram").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("gram")
        postings = scratch.write(left.join(mixed, "gram", "left_semi"), "postings")
        if postings.isEmpty():
            return component


def connected(edges: DataFrame) -> DataFrame:
    """Least node of the component of every node that has an edge: columns node, least. Each round
    every node takes the least label around it, then the label of its label, until none changes."""
    scratch = Scratch(edges.sparkSession)
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).union(edges.select(F.col("v"), F.col("u"))).distinct()
    both = scratch.write(both, "both")
    labels = scratch.write(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("now")), "labels").withColumnRenamed("now", "least")
    while True:
        around = both.join(labels.select(F.col("node").alias("other"), F.col("least").alias("near")), "other").groupBy("node").agg(F.min("near").alias("near"))
        step = labels.join(around, "node").select("node", F.least("least", "near").alias("next"), "least")
        jump = step.join(labels.select(F.col("node").alias("next"), F.col("least").alias("far")), "next", "left")
        moved = scratch.write(jump.select("node", F.least("next", F.coalesce("far", "next")).alias("now"), "least"), "labels")
        labels = moved.select("node", F.col("now").alias("least"))
        if moved.where("now != least").isEmpty():
            return labels


def classes(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each row of ``documents`` (doc_id, text; others are ignored): doc_id, version (hash
    of the text), n_shingles (the size of its set of ``words``-word n-grams) and component_id, the
    smallest doc_id reachable by links, its own included. Two texts link when their sets' intersection
    has ``percent`` of the union or more. A text of fewer words has one n-gram, the whole sequence; a
    null or empty text, or one of white space, has none and no links. Equal texts link; rows that
    share an id are vertices each, with one number. A null id is never the smallest; a component of
    null ids alone has a null id. An empty table gives an empty result."""
    return _members(documents, words, percent).drop("first")


def _members(documents: DataFrame, words: int, percent: int) -> DataFrame:
    """The rows of ``classes`` with ``first``, the least (doc_id, version) of the component, null ids
    last; null for a row without words."""
    scratch = Scratch(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # about one n-gram for every six bytes
    fragments = max(1, size // (6 * FRAGMENT_GRAMS))
    kind = "doc_ids array<bigint>, sets array<bigint>, sizes array<bigint>, versions array<bigint>"
    sent = rows.mapInArrow(_send(fragments, words), f"fragment int, block bigint, counts binary, grams binary, {kind}")
    counted = sent.groupBy("fragment").applyInArrow(_count_alone, f"block bigint, alone binary, {kind}")
    members = counted.groupBy("block").applyInArrow(_sum_alone, "doc_id bigint, set bigint, size bigint, version bigint, alone bigint")
    members = scratch.write(members, "members")
    # equal sets are one; an n-gram that only copies of one set have still counts as shared here
    able = members.where((F.col("size") > 1) & _may_link(F.col("size"), F.col("size") - F.col("alone"), percent))
    chosen = able.groupBy("set").agg(F.min("version").alias("version")).select("version").distinct()
    sets = rows.select("version", "text").join(chosen, "version", "left_semi").dropDuplicates(["version"]).mapInArrow(_sets(words), "set bigint, size bigint, grams array<bigint>").dropDuplicates(["set"])
    sets = scratch.write(sets, "sets")
    linked = links(sets, percent)
    whole_class = F.coalesce("component", "set").alias("group")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "version")
    grouped = members.where("size > 0").groupBy("set").agg(F.min(row).alias("least")).join(linked, "set", "left").select("set", "least", whole_class)
    smallest = grouped.groupBy("group").agg(F.min("least").alias("first"))
    named = grouped.join(smallest, "group").select("set", "first")
    alone = F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return members.join(named, "set", "left").select("doc_id", "version", F.col("size").alias("n_shingles"), alone.alias("component_id"), "first")


def keep_one(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``documents`` that stay when of each component only one row does, with all their
    columns: the row of the smallest doc_id, null ids last, and of the rows of that id the one whose
    text has the least hash. Of rows with equal id and text any one stays; rows without words all stay."""
    scratch = Scratch(documents.sparkSession)
    # the whole row is one column, so that its names cannot clash with those used here
    rows = documents.select(F.struct(*[documents[c] for c in documents.columns]).alias("row"), documents["doc_id"].cast("bigint").alias("doc"), F.xxhash64(documents["text"]).alias("version"))
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("version") == F.col("first.version"))
    found = _members(documents, words, percent).where("n_shingles > 0").select(F.col("doc_id").alias("of_doc"), F.col("version").alias("of_version"), first.alias("first"))
    # rows of equal id and text are in one component
    found = scratch.write(found.groupBy("of_doc", "of_version").agg(F.first("first").alias("first"), F.count("*").alias("rows")), "found")
    same = F.col("doc").eqNullSafe(F.col("of_doc")) & (F.col("version") == F.col("of_version"))
    back = [F.col("row").getField(c).alias(c) for c in documents.columns]
    repeated = found.where("first and rows > 1").select("of_doc", "of_version")
    if repeated.isEmpty():
        return rows.join(found.where("not first").select("of_doc", "of_version"), same, "left_anti").select(*back)
    # repeated rows are told apart by a number, which is fixed once they are written
    numbered = scratch.write(rows.join(repeated, same).select("row", "of_doc", "of_version", F.monotonically_increasing_id().alias("number")), "repeated")
    chosen = numbered.groupBy("of_doc", "of_version").agg(F.min("number").alias("number")).select("number")
    one = numbered.join(chosen, "number", "left_semi").select(*back)
    return rows.join(found.where("not first or rows > 1").select("of_doc", "of_version"), same, "left_anti").select(*back).unionByName(one)

"""Line deduplication over overlapping windows of three lines.

Consecutive lines are hashed, windows of three of them are looked up over all documents, and all
windows but the first occurrence are removed by merging the positions they cover. The first
occurrence is the one of the smallest (doc_id, position). Whether a line goes is decided on the
input, not on what other removals leave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LENGTH = 3


def _windows(text: Column, length: int) -> Column:
    """Array of (position, key) of the windows of a text that hold a word; two 64-bit hashes."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.struct(F.xxhash64(x).alias("h"), F.hash(x).alias("g"), x.rlike("[^\\x20\\x09-\\x0D]").alias("worded")))

    def window(lines: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(lines) - (length - 1))
        all_starts = F.when(F.size(lines) >= length, starts).otherwise(F.array().cast("array<int>"))

        def one(i: Column) -> Column:
            own = [F.element_at(lines, i + k) for k in range(length)]
            worded = own[0]["worded"]
            for x in own[1:]:
                worded = worded | x["worded"]
            key = F.xxhash64(*[x["h"] for x in own], *[x["g"] for x in own])
            return F.struct(worded.alias("worded"), (i - 1).alias("at"), key.alias("key"), F.hash(*[x["g"] for x in own], *[x["h"] for x in own]).alias("check"))

        return F.filter(F.transform(all_starts, one), lambda w: w["worded"])

    return F.element_at(F.transform(F.array(lines), window), 1)


def _rows(documents: DataFrame, length: int) -> DataFrame:
    """One row for each window; ``doc`` is the rank key of a document: null ids come last."""
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1))
    return documents.select(doc.alias("doc"), F.xxhash64("text").alias("version"), F.explode(_windows(F.col("text"), length)).alias("w")).select("doc", "version", "w.at", "w.key", "w.check")


def covered_lines(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """Columns doc, version, gone: the sorted positions (from 0) of the lines to remove of each
    document that loses any. Counting by window is combined before the shuffle; only windows that
    occur more than once are joined back, each with the one row that holds its first place."""
    rows = _rows(documents, length)
    first = rows.groupBy("key", "check").agg(F.min(F.struct("doc", "at", "version")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = rows.join(first, ["key", "check"]).where(F.struct("doc", "at", "version") > F.col("first"))
    return later.groupBy("doc", "version").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence("at", F.col("at") + (length - 1)))))).alias("gone"))


def remove_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """Every row of ``documents`` (doc_id, text; other columns are kept as they are, also those named
    like work columns) with its text less the lines in later occurrences of a window, in column
    ``text``, and a struct ``lines`` (n_lines, n_removed). Windows of blank lines alone do not
    count. A null text stays null and has no lines; a text of fewer than three lines stays whole;
    of two equal windows in one document the later goes; rows that share id and text are copies of
    one document and keep the same lines; null ids come after all others. An empty table stays empty."""
    gone = covered_lines(documents, length).select(F.col("doc").alias("__doc"), F.col("version").alias("__version"), F.col("gone").alias("__gone"))
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1))
    keyed = documents.select(F.struct(*[documents[c] for c in documents.columns]).alias("__row"), doc.alias("__doc"), F.xxhash64("text").alias("__version"))
    lines = F.split(F.col("__row.text"), "\n", -1)
    cuts = F.concat(F.array(F.lit(-1)), F.coalesce("__gone", F.array().cast("array<int>")), F.array(F.size(lines)))
    joined = keyed.join(gone, ["__doc", "__version"], "left").select("__row", "__gone", lines.alias("__lines"), cuts.alias("__cuts"))
    # what lies between one removed line and the next
    spans = F.transform(F.sequence(F.lit(1), F.size("__cuts") - 1), lambda i: F.struct(F.get("__cuts", i - 1).alias("a"), F.get("__cuts", i).alias("b")))
    left = F.flatten(F.transform(F.filter(spans, lambda s: s["b"] - s["a"] > 1), lambda s: F.slice("__lines", s["a"] + 2, s["b"] - s["a"] - 1)))
    text = F.when(F.col("__gone").isNull(), F.col("__row.text")).otherwise(F.array_join(left, "\n"))

    def number(size: Column) -> Column:
        return F.when(size > 0, size).otherwise(0).cast("bigint")

    counts = F.struct(number(F.size("__lines")).alias("n_lines"), number(F.size("__gone")).alias("n_removed"))
    return joined.select(*[(text if c == "text" else F.col(f"__row.`{c}`")).alias(c) for c in documents.columns], counts.alias("lines"))

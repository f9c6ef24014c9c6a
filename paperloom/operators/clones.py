"""Clone classes: token runs that occur in two places or more, wherever their lines break.

Fingerprints by winnowing choose a few runs of tokens of each file, so that two equal runs of
``min_tokens`` tokens always share one. Files without a shared fingerprint are done with; in the others
the windows around shared fingerprints are compared whole, and neighbouring equal windows grow into
regions as long as they can. Regions that share a window are of one class.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import Stages
from .graphs import components
from .scans import DUPLICATE_TOKENS

# A token is a run of characters without ASCII white space, so texts that break lines elsewhere agree.
_TOKEN = re.compile(r"[^ \t\n\x0b\f\r]+")


#: Hashes of tokens a task remembers from text to text.
KNOWN_TOKENS = 1 << 19
_known: dict[str, int] = {}


def _hashed(tokens: list[str]) -> np.ndarray:
    """A 64-bit hash of every token."""
    if len(_known) > KNOWN_TOKENS:
        _known.clear()
    for token in set(tokens).difference(_known):
        _known[token] = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")
    return np.fromiter(map(_known.__getitem__, tokens), np.uint64, len(tokens))


def _rolled(hashes: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hashes, modulo 2 ** 64, of all runs of ``length`` tokens, from prefix sums."""
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    powers = np.cumprod(np.full(len(hashes), base, np.uint64))
    undo = np.cumprod(np.full(len(hashes), inverse, np.uint64))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * powers)])
    runs = (sums[length:] - sums[:-length]) * undo[: len(hashes) - length + 1]
    runs ^= runs >> np.uint64(31)
    return runs * np.uint64(0xC4CEB9FE1A85EC53)


def winnow(values: np.ndarray, window: int) -> np.ndarray:
    """Places of the least value, the last of equals, of every ``window`` values in a row."""
    if len(values) < window:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(values, window)[:, ::-1]
    # a run of windows at a time, since their order is a copy
    least = [views[at : at + (1 << 16)].argmin(axis=1) for at in range(0, len(views), 1 << 16)]
    places = np.arange(window - 1, len(values)) - np.concatenate(least)
    return places[np.concatenate([[True], places[1:] != places[:-1]])]


def _split(min_tokens: int) -> tuple[int, int]:
    """Length of a fingerprinted run and of the window one is chosen from: they overlap in every run
    of ``min_tokens`` tokens."""
    run = max(1, (min_tokens * 3 + 4) // 5)
    return run, min_tokens - run + 1


def fingerprints(files: DataFrame, min_tokens: int) -> DataFrame:
    """``file, place, mark``: the winnowed fingerprints of texts (``file, content``)."""
    run, window = _split(min_tokens)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rolled = _rolled(_hashed(_TOKEN.findall(text or "")), run)
                places = winnow(rolled, window)
                if len(places):
                    yield pa.RecordBatch.from_pydict({"file": pa.array([file] * len(places), pa.int64()), "place": pa.array(places), "mark": pa.array(rolled[places].view(np.int64))})

    return files.select("file", "content").mapInArrow(mark, "file bigint, place bigint, mark bigint")


def _windows(files: DataFrame, min_tokens: int) -> DataFrame:
    """``file, start, digest``: whole windows of texts (``file, content, places``) that hold a fingerprint."""
    reach = min_tokens - _split(min_tokens)[0]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text, places in zip(*(batch.column(n).to_pylist() for n in ("file", "content", "places")), strict=True):
                tokens = _TOKEN.findall(text or "")
                near = {s for p in places for s in range(max(0, p - reach), min(p, len(tokens) - min_tokens) + 1)}
                starts = sorted(near)
                digests = [hashlib.md5(" ".join(tokens[s : s + min_tokens]).encode()).digest() for s in starts]
                if starts:
                    yield pa.RecordBatch.from_pydict({"file": pa.array([file] * len(starts), pa.int64()), "start": pa.array(starts, pa.int64()), "digest": pa.array(digests, pa.binary())})

    return files.mapInArrow(cut, "file bigint, start bigint, digest binary")


def _lines(regions: DataFrame) -> DataFrame:
    """Add the lines of a region (``content, start, tokens``)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last = [], []
            for text, regions_of in zip(batch.column("content").to_pylist(), batch.column("regions").to_pylist(), strict=True):
                spans = [m.span() for m in _TOKEN.finditer(text)]
                line = np.cumsum(np.array([0] + [text.count("\n", spans[i - 1][0] if i else 0, s[0]) for i, s in enumerate(spans)])[1:]) + 1
                first.append([int(line[r["start"]]) for r in regions_of])
                last.append([int(line[r["start"] + r["tokens"] - 1]) for r in regions_of])
            kept = [batch.column("file"), batch.column("regions"), pa.array(first, pa.list_(pa.int64())), pa.array(last, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(kept, names=["file", "regions", "first", "last"])

    kind = regions.schema["regions"].dataType.simpleString()
    return regions.mapInArrow(find, f"file bigint, regions {kind}, first array<bigint>, last array<bigint>")


def clone_classes(files: DataFrame, min_tokens: int = DUPLICATE_TOKENS) -> DataFrame:
    """``project, path, start_token, tokens, start_line, end_line, class_project, class_path, class_token,
    members``: every region of tokens that also occurs elsewhere, as long as it can be, with the first
    region of its class (by project, path and place) as representative, and the class's size.

    A region is a run of windows of ``min_tokens`` tokens each of which occurs in two places or more;
    two regions are of one class if they share a window, directly or over others. Nothing is paired:
    a window copied everywhere links each region to the first one that has it. Project and path
    together are unique. Null texts have no tokens.
    """
    stages = Stages(files.sparkSession)
    # files get numbers in the order of project and path, range by range
    listed, _, _ = stages.write(files.select("project", "path").repartitionByRange(F.col("project"), F.col("path")).sortWithinPartitions("project", "path").withColumn("file", F.monotonically_increasing_id()))
    texts = files.select("project", "path", "content").join(listed, ["project", "path"]).select("file", "content")
    marks, _, _ = stages.write(fingerprints(texts, min_tokens))
    shared = marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark")
    places = marks.join(shared, "mark", "left_semi").groupBy("file").agg(F.collect_list("place").alias("places"))
    windows, _, _ = stages.write(_windows(texts.join(places, "file"), min_tokens))
    first = F.min(F.struct("file", "start")).alias("least")
    repeated = windows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), first).where("n > 1").select("digest", "least")
    inside = Window.partitionBy("file").orderBy("start")
    runs = windows.join(repeated, "digest").withColumn("run", F.col("start") - F.row_number().over(inside))
    # where a copied passage goes on in step with the place that has it first, its windows tell one link
    before = F.lag(F.struct("start", "least")).over(inside)
    on = (before["start"] + 1 == F.col("start")) & (before["least"]["file"] == F.col("least.file")) & (before["least"]["start"] + 1 == F.col("least.start"))
    runs = runs.withColumn("turn", F.coalesce(~on, F.lit(True)) | F.coalesce(F.lead("start").over(inside) == F.col("start"), F.lit(False)))
    starts = Window.partitionBy("file", "run")
    held, _, _ = stages.write(runs.select("file", "start", "least", "turn", F.min("start").over(starts).alias("first"), F.count(F.lit(1)).over(starts).alias("n")))
    regions = held.groupBy("file", F.col("first").alias("start")).agg((F.max("n") + (min_tokens - 1)).alias("tokens"))
    nodes = regions.select(F.struct("file", "start").alias("node"))
    # the window a region shares lies in the region that has it first
    linked, _, _ = stages.write(held.where("turn").select("file", "first", "least").distinct())
    homes = held.select(F.struct("file", "start").alias("least"), F.struct("file", F.col("first").alias("start")).alias("b"))
    homes = homes.join(linked.select("least").distinct(), "least", "left_semi")
    edges = linked.select(F.struct("file", F.col("first").alias("start")).alias("a"), "least").join(homes, "least").select("a", "b")
    classes, _, _ = stages.write(components(nodes, edges).select(F.col("node.file").alias("file"), F.col("node.start").alias("start"), "component"))
    sizes = classes.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    told = regions.join(classes, ["file", "start"]).join(sizes, "component")
    by_file = told.groupBy("file").agg(F.collect_list(F.struct("start", "tokens", "component", "members")).alias("regions"))
    lined = _lines(by_file.join(texts, "file").select("file", "regions", "content"))
    each = lined.select("file", F.inline(F.arrays_zip("regions", "first", "last")))
    named = each.join(listed, "file").select(
        "project", "path", F.col("regions.start").alias("start_token"), F.col("regions.tokens").alias("tokens"),
        F.col("first").alias("start_line"), F.col("last").alias("end_line"), F.col("regions.component").alias("c"), F.col("regions.members").alias("members"),
    )
    heads = listed.select(F.col("project").alias("class_project"), F.col("path").alias("class_path"), F.col("file").alias("_head"))
    return named.join(heads, F.col("c.file") == F.col("_head")).select(
        "project", "path", "start_token", "tokens", "start_line", "end_line",
        "class_project", "class_path", F.col("c.start").alias("class_token"), "members",
    )

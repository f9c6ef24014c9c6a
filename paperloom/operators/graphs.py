"""Connected components and strongly connected components of edge tables, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stages import Stages

#: Steps along the edges in one written round of a flood.
HOPS = 4


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node each node is linked with, directly or over others.

    ``nodes`` has ``node`` and ``edges`` has ``a, b`` among them, read both ways. Every round hangs the
    neighbours of a node below the smallest of them, first those that are larger than the node, then
    those that are not, so distances halve and no node gathers its neighbours: only minima are taken.
    A round is written, and the loop ends when the written edges no longer change.
    """
    stages = Stages(nodes.sparkSession)
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, count, _ = stages.write(ordered)
    before = None
    while count:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        # larger neighbours of a node to its least neighbour
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        # smaller neighbours, and the node itself, to its least one
        low = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("x")), F.struct(F.col("b").alias("x")))).alias("e"), "least")
        step = small.select(F.col("e.x").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        links, count, _ = stages.write(step)
        mark = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    root = links.groupBy("a").agg(F.min("b").alias("component"))
    joined = nodes.join(root.withColumnRenamed("a", "node"), "node", "left")
    return joined.select("node", F.coalesce("component", "node").alias("component"))


def cycles(edges: DataFrame) -> DataFrame:
    """``project, node, cycle``: nodes on a circle of ``edges`` (``project, src, dst``), with the smallest
    node of their strongly connected component; other nodes are left out.

    Nodes without an edge in or out are trimmed until none is left. Then each round floods the smallest
    name forward and backward through what remains: nodes that both floods give the same name form the
    component of that node and leave; edges between different names lie in no component and leave too.
    """
    stages = Stages(edges.sparkSession)
    given, _, _ = stages.write(edges.select("project", "src", "dst").dropna().distinct())
    # nodes get numbers in the order of project and name, range by range; the rounds move numbers only
    names = given.select("project", F.explode(F.array("src", "dst")).alias("name")).distinct()
    names = names.repartitionByRange("project", "name").sortWithinPartitions("project", "name")
    names, _, _ = stages.write(names.withColumn("id", F.monotonically_increasing_id()))
    start, end = (names.select("project", F.col("name").alias(side), F.col("id").alias(f"{side}_id")) for side in ("src", "dst"))
    numbered = given.join(start, ["project", "src"]).join(end, ["project", "dst"])
    all_links, count, _ = stages.write(numbered.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")))
    links, found = all_links, []
    while count:
        links, count = _trimmed(stages, links, count)
        if not count:
            break
        ahead = _flooded(stages, links, "src", "dst")
        back = _flooded(stages, links, "dst", "src")
        named = ahead.join(back.withColumnRenamed("name", "other"), "node")
        named, _, _ = stages.write(named)
        found.append(named.where("name = other").select("node", F.col("name").alias("cycle")))
        left = named.select("node", "name", "other", (F.col("name") == F.col("other")).alias("done"))
        ends = [left.select(*[F.col(c).alias(f"{side}_{c}") for c in ("name", "other", "done")], F.col("node").alias(side)) for side in ("src", "dst")]
        kept = links.join(ends[0], "src").join(ends[1], "dst")
        kept = kept.where("NOT src_done AND NOT dst_done AND src_name = dst_name AND src_other = dst_other")
        links, count, _ = stages.write(kept.select("src", "dst"))
    if not found:
        return edges.select("project", F.col("src").alias("node"), F.col("src").alias("cycle")).where("false")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    # a node alone is on a circle only if it points to itself
    size = out.groupBy("cycle").agg(F.count(F.lit(1)).alias("n"))
    loops = all_links.where("src = dst").select(F.col("src").alias("node")).withColumn("loop", F.lit(True))
    out = out.join(size, "cycle").join(loops, "node", "left").where("n > 1 OR loop").select("node", "cycle")
    out = out.join(names.select("project", F.col("id").alias("node"), F.col("name").alias("node_name")), "node")
    out = out.join(names.select(F.col("id").alias("cycle"), F.col("name").alias("cycle_name")), "cycle")
    return out.select("project", F.col("node_name").alias("node"), F.col("cycle_name").alias("cycle"))


def _trimmed(stages: Stages, links: DataFrame, count: int) -> tuple[DataFrame, int]:
    while count:
        to = links.select(F.col("dst").alias("src")).distinct()
        out = links.select(F.col("src").alias("dst")).distinct()
        kept = links.join(to, "src", "left_semi").join(out, "dst", "left_semi")
        links, left, _ = stages.write(kept.select("src", "dst"))
        if left == count:
            break
        count = left
    return links, count


def _flooded(stages: Stages, links: DataFrame, start: str, end: str) -> DataFrame:
    """``node, name``: the smallest node from which a node is reached along the links. A written round
    takes ``HOPS`` steps; only nodes that got a smaller name in the last step send theirs on."""
    nodes = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    names, _, _ = stages.write(nodes.withColumn("name", F.col("node")).withColumn("lower", F.lit(True)))
    while True:
        step = names.select("node", "name", "lower", F.col("name").alias("before"))
        for _ in range(HOPS):
            sent = links.join(step.where("lower").select(F.col("node").alias(start), "name"), start)
            best = sent.groupBy(F.col(end).alias("node")).agg(F.min("name").alias("sent"))
            least = F.least("name", "sent")
            step = step.join(best, "node", "left").select("node", least.alias("name"), (least < F.col("name")).alias("lower"), "before")
        names, changed, _ = stages.write(step.select("node", "name", "lower"), F.col("lower"))
        if not changed:
            return names.select("node", "name")

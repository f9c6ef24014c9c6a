"""Scans of file trees and the sinks of cleaned files and packed contexts."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.packing import with_final_newline
from ..session import ensure_checkpoint_dir
from .sink import local_path, write_files


#: Rows of a listing, and bytes of content, that a task holds at once.
LISTED, LOADED = 8192, 16 << 20


def scan_files(spark: SparkSession, root: str, glob: str | None = None, in_tasks: bool = False, content: bool = True) -> DataFrame:
    """``(path, length, modified, content)`` of the files below ``root``.

    Paths are relative. A filter on ``length`` reaches the scan, and content that is not
    selected is not read. Files that vanish or cannot be read are skipped. Like every Spark
    file scan this one leaves out empty files and names that start with a dot or an
    underscore; ``list_tree`` and ``read_tree`` have them.

    Spark's scan lists all files on the driver and opens few in a task. With ``in_tasks``, for many
    files on a mounted file system, tasks list the folders, level by level, and read the files: the
    driver sees no listing and small files are rows, not tasks. Then filters come after the reading,
    and ``content`` false leaves it out.
    """
    if not in_tasks:
        return _scan_by_spark(spark, root, glob)
    if glob:
        raise ValueError("a scan in tasks takes no name filter")
    base = local_path(root)
    ensure_checkpoint_dir(spark)
    schema = "path string, length bigint, modified timestamp, is_dir boolean"
    width = spark.sparkContext.defaultParallelism
    level = spark.createDataFrame([("",)], "path string").mapInArrow(_scan_below(base), schema).checkpoint()
    found = level
    while not level.where("is_dir").isEmpty():
        level = level.where("is_dir").select("path").repartition(width).mapInArrow(_scan_below(base), schema).checkpoint()
        found = found.unionByName(level)
    files = found.where("NOT is_dir AND length > 0").drop("is_dir")
    if not content:
        return files
    count, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(width, count // (2 * LISTED), size // (8 * LOADED))
    return files.repartition(tasks).mapInArrow(_load_below(base), "path string, length bigint, modified timestamp, content binary")


def _scan_below(base: str):
    """Task function: folders in, the files and folders in them out, but for hidden names."""

    def run(batches):
        names = ["path", "length", "modified", "is_dir"]
        kinds = [pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.bool_()]

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for folder in batch.column("path").to_pylist():
                rows = []
                try:
                    entries = os.scandir(os.path.join(base, folder))
                except OSError:
                    continue
                with entries:
                    for entry in entries:
                        if entry.name.startswith((".", "_")) and not (entry.name.startswith("_") and "=" in entry.name):
                            continue
                        try:
                            below, stat = entry.is_dir(), entry.stat()
                        except OSError:
                            continue
                        if not below and not entry.is_file():
                            continue
                        rows.append((os.path.join(folder, entry.name), stat.st_size, stat.st_mtime_ns // 1000, below))
                        if len(rows) == LISTED:
                            yield table(rows)
                            rows = []
                if rows:
                    yield table(rows)

    return run


def _load_below(base: str):
    """Task function: adds the content of listed files, a bounded number of bytes at a time."""

    def run(batches):
        for batch in batches:
            places, contents, size = [], [], 0

            def table():
                own = batch.take(pa.array(places, pa.int64()))
                return pa.RecordBatch.from_arrays([*own.columns, pa.array(contents, pa.binary())], names=[*own.schema.names, "content"])

            for place, path in enumerate(batch.column("path").to_pylist()):
                try:
                    with open(os.path.join(base, path), "rb") as handle:
                        contents.append(handle.read())
                except OSError:
                    continue
                places.append(place)
                size += len(contents[-1])
                if size >= LOADED:
                    yield table()
                    places, contents, size = [], [], 0
            if places:
                yield table()

    return run


def _scan_by_spark(spark: SparkSession, root: str, glob: str | None) -> DataFrame:
    reader = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("ignoreCorruptFiles", True)
        .option("ignoreMissingFiles", True)
    )
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), r"^\Q" + root.rstrip("/") + r"\E/", "")
    return reader.load(root).select(
        relative.alias("path"), "length", F.col("modificationTime").alias("modified"), "content"
    )


def _list_below(root: str):
    """Task function: directories in, the files and directories inside them out."""

    def run(batches):
        import pandas as pd
        from pyarrow import fs

        filesystem, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for batch in batches:
            for directory in batch["path"]:
                where = base.rstrip("/") + ("/" + directory if directory else "")
                try:
                    infos = filesystem.get_file_info(fs.FileSelector(where))
                except OSError:
                    continue
                rows = [
                    (
                        i.path[len(base.rstrip("/")) + 1 :],
                        i.size if i.type == fs.FileType.File else None,
                        i.mtime,
                        i.type == fs.FileType.Directory,
                    )
                    for i in infos
                    if i.type in (fs.FileType.File, fs.FileType.Directory) and i.base_name != ".git"
                ]
                yield pd.DataFrame(rows, columns=["path", "length", "modified", "is_dir"])

    return run


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """``(path, length, modified)`` of all files below ``root``, hidden names included.

    One job per directory level; every directory is one row of work. Each level is
    checkpointed, so no directory is listed twice. Version-control directories are not
    entered and unreadable ones are skipped.
    """
    ensure_checkpoint_dir(spark)
    schema = "path string, length bigint, modified timestamp, is_dir boolean"
    width = spark.sparkContext.defaultParallelism
    level = spark.createDataFrame([("",)], "path string").mapInPandas(_list_below(root), schema).checkpoint()
    found = level
    while not level.where("is_dir").isEmpty():
        level = (
            level.where("is_dir").select("path").repartition(width).mapInPandas(_list_below(root), schema).checkpoint()
        )
        found = found.unionByName(level)
    return found.where("NOT is_dir").select("path", "length", "modified")


def load_content(files: DataFrame, root: str) -> DataFrame:
    """Add ``content`` (bytes) to listed files; read after filtering. Unreadable files are left out."""

    def run(batches):
        from pyarrow import fs

        filesystem, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for batch in batches:
            for start in range(len(batch)):
                row = batch.iloc[start : start + 1]
                try:
                    with filesystem.open_input_stream(base.rstrip("/") + "/" + row["path"].iloc[0]) as handle:
                        data = handle.read()
                except OSError:
                    continue
                yield row.assign(content=[data])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInPandas(run, f"{fields}, content binary")


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root`` with content, hidden and empty ones included."""
    return load_content(list_tree(spark, root), root)


def decode(files: DataFrame) -> DataFrame:
    """Bytes to text; ``valid_utf8`` marks rows whose bytes were not valid and had to be replaced."""
    text = F.col("content").cast("string")
    return files.withColumn("valid_utf8", F.is_valid_utf8(text)).withColumn("content", F.make_valid_utf8(text))


def changed_files(cleaned: DataFrame) -> DataFrame:
    """The rows ``write_cleaned`` writes."""
    return cleaned.where("removed > 0").select("project", "path", "content")


def changed_originals(cleaned: DataFrame) -> DataFrame:
    """The rows ``backup_originals`` writes."""
    return cleaned.where("removed > 0").select("project", "path", F.col("original").alias("content"))


def _below_project(files: DataFrame) -> DataFrame:
    return files.select(F.concat_ws("/", "project", "path").alias("path"), "content")


def write_cleaned(cleaned: DataFrame, root: str, **options) -> None:
    """Write the files that changed to ``root/project/path``; see ``sink.write_files`` for the options."""
    write_files(_below_project(changed_files(cleaned)), root, **options)


def backup_originals(cleaned: DataFrame, root: str, **options) -> None:
    """Write the originals of the files that changed; call it before ``write_cleaned``."""
    write_files(_below_project(changed_originals(cleaned)), root, **options)


def context_offsets(parts: DataFrame, order: list[str], repeats: bool = False) -> DataFrame:
    """``parts`` with ``start``, the byte at which a piece begins in its project's context.

    A running sum in two steps on keys and sizes alone: rows are dealt by ranges of their order, so a
    large project lies in many tasks; sums per task and project are small and give each task its base.
    Text is moved only by the final join. ``order`` names columns that are unique within a project;
    rows that share them begin at one place, or with ``repeats`` one behind the other, by their text.
    """
    ensure_checkpoint_dir(parts.sparkSession)
    keys = [F.collate(F.col(c), "UNICODE") if c == "path" else F.col(c) for c in order]
    keys += [F.col(c) for c in order if c == "path"]
    narrow = parts.groupBy("project", *order).agg(F.sum(F.octet_length("text").cast("bigint")).alias("bytes"), F.count(F.lit(1)).alias("like"))
    dealt = narrow.repartitionByRange("project", *keys).sortWithinPartitions("project", *keys)
    dealt = dealt.withColumn("task", F.spark_partition_id()).checkpoint()
    by_task = Window.partitionBy("project").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("project", "task").agg(F.sum("bytes").alias("sum"))
    bases = bases.select("project", "task", F.coalesce(F.sum("sum").over(by_task), F.lit(0)).alias("base"))
    within = Window.partitionBy("project", "task").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    bases = bases.select(F.col("project").alias("of"), F.col("task").alias("in"), "base")
    here = F.col("project").eqNullSafe(F.col("of")) & (F.col("task") == F.col("in"))
    placed = dealt.withColumn("inside", F.coalesce(F.sum("bytes").over(within), F.lit(0))).join(bases, here)
    placed = placed.select(F.col("project").alias("_project"), *[F.col(c).alias(f"_{c}") for c in order], (F.col("base") + F.col("inside")).alias("start"), F.col("like").alias("_like"))
    same = F.col("project").eqNullSafe(F.col("_project"))
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    own = ["_project", *[f"_{c}" for c in order], "_like"]
    if not repeats or dealt.where("like > 1").isEmpty():
        return parts.join(placed, same).drop(*own)
    alone = parts.join(placed.where("_like = 1"), same)
    # Only these few rows are dealt once more.
    before = Window.partitionBy("project", *order).orderBy(F.col("text").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    behind = F.col("start") + F.coalesce(F.sum(F.octet_length("text").cast("bigint")).over(before), F.lit(0))
    return alone.unionByName(parts.join(placed.where("_like > 1"), same).withColumn("start", behind)).drop(*own)


#: Bytes of a context from which on it goes on in the next row.
PART_BYTES = 4 << 20


def assemble_context(parts: DataFrame, tie=(), part_bytes: int = PART_BYTES) -> DataFrame:
    """``project, part, start, pieces, text``: the pieces of each project put together in their order.

    ``parts`` is the result of a pack, a filled template or a chosen output. A context of at most
    ``part_bytes`` is one row with its whole text. Part k of a longer one has the pieces that begin in
    the k-th run of ``part_bytes`` bytes, ``start`` is the byte at which it begins: the parts of a project,
    in order, are the context without a gap, and no task holds more of it than a part and a piece.
    """
    order = [*(["slot"] if "slot" in parts.columns else []), "path", *tie]
    keys = [k for c in order for k in ([F.collate(F.col(c), "UNICODE"), F.col(c)] if c == "path" else [F.col(c)])]
    placed = context_offsets(parts, order, repeats=True).select("project", "start", F.struct("start", *[k.alias(f"k{i}") for i, k in enumerate(keys)], "text").alias("piece"))
    grouped = placed.groupBy("project", F.floor(F.col("start") / part_bytes).alias("part")).agg(
        F.min("start").alias("start"), F.count(F.lit(1)).alias("pieces"), F.sort_array(F.collect_list("piece")).alias("all")
    )
    return grouped.select("project", "part", "start", "pieces", F.array_join("all.text", "").alias("text"))


def write_context(parts: DataFrame, root: str, name: str = "context.txt", tie=(), **options) -> DataFrame:
    """Write each project's context, and a line end, to ``root/project/name``; returns what was written.

    ``parts`` is the result of a pack, a filled template or a chosen output (rows without text, which
    are errors, are left out). Every task writes its pieces at their places in the project's file, so
    neither a task nor the driver holds a context. The result has ``project, file, start, bytes`` and
    the order columns, one row per piece.
    """
    order = [*(["slot"] if "slot" in parts.columns else []), "path", *tie]
    ready = context_offsets(with_final_newline(parts.where("text IS NOT NULL")), order)
    ready = ready.withColumn("file", F.concat_ws("/", "project", F.lit(name)))
    write_files(ready.select(F.col("file").alias("path"), "start", F.col("text").alias("content")), root, **options)
    return ready.select("project", "file", *order, "start", F.octet_length("text").cast("bigint").alias("bytes"))

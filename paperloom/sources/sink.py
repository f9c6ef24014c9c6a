"""A sink that writes rows into files at relative paths, all of them or none.

Each task writes into a staging folder beside the target. The commit renames that folder, or its files
into a target that is there already; an abort removes it. Pieces of one file may come from many tasks:
each is written at its own place, and a task that runs again writes the same bytes to the same places.
"""

from __future__ import annotations

import contextlib
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import ensure_checkpoint_dir
from .stages import Stages

FORMAT = "paperloom_files"
#: Files a task keeps open at once.
OPEN_FILES = 64


def local_path(root: str) -> str:
    """The mount point of a root given as a path or as a ``file`` address; others raise a ValueError."""
    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    if "://" in root or not os.path.isabs(root):
        raise ValueError(f"{root} is not an absolute path or file address of a mounted file system")
    return os.path.normpath(root)


def safe_path(path: str | None) -> str:
    """A relative path that stays below its root; any other raises a ValueError."""
    if not path or "\0" in path or path.startswith("/") or any(part in ("", ".", "..") for part in path.split("/")):
        raise ValueError(f"{path!r} is not a path below the target")
    return path


@dataclass
class Written(WriterCommitMessage):
    rows: int
    bytes: int


class FileWriter(DataSourceArrowWriter):
    """Rows of ``path``, ``content`` (binary) and ``start`` (place of the content in the file)."""

    def __init__(self, root: str, merge: bool):
        self.root, self.merge = local_path(root), merge
        if os.path.lexists(self.root) and not merge:
            raise FileExistsError(self.root)
        self.staging = f"{self.root}.staging-{uuid.uuid4()}"
        os.makedirs(self.staging)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        rows = size = 0
        handles: dict[str, int] = {}
        try:
            for batch in iterator:
                columns = (batch.column(name).to_pylist() for name in ("path", "start", "content"))
                for path, start, content in zip(*columns, strict=True):
                    content = memoryview(content or b"")
                    handle = self._handle(handles, safe_path(path))
                    done = 0
                    while done < len(content):
                        done += os.pwrite(handle, content[done:], start + done)
                    rows, size = rows + 1, size + done
        finally:
            for handle in handles.values():
                os.close(handle)
        return Written(rows, size)

    def _handle(self, handles: dict[str, int], path: str) -> int:
        if path not in handles:
            if len(handles) >= OPEN_FILES:
                os.close(handles.pop(next(iter(handles))))
            target = os.path.join(self.staging, path)
            self._make(os.path.dirname(target))
            handles[path] = os.open(target, os.O_WRONLY | os.O_CREAT, 0o644)
        return handles[path]

    def _make(self, folder: str) -> None:
        """Make a folder below the staging folder, which is gone once the job was given up."""
        if os.path.isdir(folder):
            return
        if folder == self.staging:
            raise FileNotFoundError(folder)
        self._make(os.path.dirname(folder))
        with contextlib.suppress(FileExistsError):
            os.mkdir(folder)

    def commit(self, messages: list) -> None:
        if not os.path.lexists(self.root):
            os.rename(self.staging, self.root)
            return
        if not self.merge:
            self.abort(messages)
            raise FileExistsError(self.root)
        for folder, _, names in os.walk(self.staging):
            target = os.path.normpath(os.path.join(self.root, os.path.relpath(folder, self.staging)))
            os.makedirs(target, exist_ok=True)
            for name in names:
                os.replace(os.path.join(folder, name), os.path.join(target, name))
        shutil.rmtree(self.staging)

    def abort(self, messages: list) -> None:
        # renamed first, so that tasks still at work find no folder to write into
        gone = f"{self.staging}.gone"
        with contextlib.suppress(FileNotFoundError):
            os.rename(self.staging, gone)
        shutil.rmtree(gone, ignore_errors=True)


class FilesSource(DataSource):
    """``df.write.format("paperloom_files").option("root", folder)`` for rows of path, start, content."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
        if kinds != {"path": "string", "start": "bigint", "content": "binary"}:
            raise ValueError(f"rows of path string, start bigint, content binary are written, not {kinds}")
        return FileWriter(self.options["root"], self.options.get("merge", "false").lower() == "true")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FilesSource)


def write_files(rows: DataFrame, root: str, merge: bool = False) -> None:
    """Write ``content`` (text or bytes; null is empty) to ``path`` below ``root``, at byte ``start`` if
    there is such a column, else as the whole file.

    ``root`` is a folder of a file system mounted on the driver and all executors. It must not exist,
    unless ``merge`` is set: then files of the same path are replaced and others stay. Either all files
    appear or, when a task fails, none. Paths are relative and stay below the root; a path given twice
    (with one start) is an error, found before anything is written.
    """
    register(rows.sparkSession)
    whole = "start" not in rows.columns
    start = F.lit(0) if whole else F.col("start")
    rows = rows.select("path", start.cast("bigint").alias("start"), F.col("content").cast("binary").alias("content"))
    # worked out once, for the test and the writing
    stages = Stages(rows.sparkSession)
    rows, _, _ = stages.write(rows)
    given = rows if whole else rows.where("octet_length(content) > 0")
    again = given.groupBy("path", "start").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("path").first()
    if again is not None:
        stages.remove()
        raise ValueError(f"{again[0]!r} is given twice")
    try:
        rows.write.format(FORMAT).option("root", root).option("merge", str(merge).lower()).mode("append").save()
    finally:
        stages.remove()


def new_folder(spark: SparkSession) -> str:
    """The path of a folder that does not exist yet, below the checkpoint folder all executors share."""
    ensure_checkpoint_dir(spark)
    return local_path(f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4()}")


def read_pieces(pieces: DataFrame, root: str) -> DataFrame:
    """Add ``content``, the ``bytes`` at ``start`` of ``file`` below ``root``, read where the row is."""
    base = local_path(root)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            columns = (batch.column(name).to_pylist() for name in ("file", "start", "bytes"))
            found = []
            for path, start, size in zip(*columns, strict=True):
                with open(os.path.join(base, safe_path(path)), "rb") as handle:
                    handle.seek(start)
                    found.append(handle.read(size))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, "content"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return pieces.mapInArrow(run, f"{fields}, content binary")

"""Sinks: files at relative paths, contexts written in pieces, all or nothing."""

import os
import random

import pytest
from pyspark.errors import PySparkException

from paperloom.operators import cleaning, packing
from paperloom.sources import files as src
from paperloom.sources import sink

FILES = "project string, path string, content string"


def tree(root):
    found = {}
    for folder, _, names in os.walk(root):
        for name in names:
            path = os.path.join(folder, name)
            with open(path, "rb") as handle:
                found[os.path.relpath(path, root)] = handle.read().decode()
    return found


def test_changed_files_and_their_originals_are_written(frame, tmp_path):
    files = frame(FILES, ("p", "a.ts", "a//x"), ("p", "b.ts", "b"), ("q", ".x/ü y.ts", "//z"))
    cleaned = cleaning.clean_files(files)
    src.backup_originals(cleaned, str(tmp_path / "backup"))
    src.write_cleaned(cleaned, f"file://{tmp_path}/out")
    assert tree(tmp_path / "backup") == {"p/a.ts": "a//x", "q/.x/ü y.ts": "//z"}
    assert tree(tmp_path / "out") == {"p/a.ts": "a", "q/.x/ü y.ts": ""}


def test_a_target_that_exists_is_merged_on_request_only(frame, tmp_path):
    (tmp_path / "t" / "d").mkdir(parents=True)
    (tmp_path / "t" / "d" / "old").write_text("old")
    (tmp_path / "t" / "same").write_text("longer than the new text")
    rows = frame("path string, content string", ("d/new", "n"), ("same", "s"), ("empty", None))
    with pytest.raises(PySparkException):
        sink.write_files(rows, str(tmp_path / "t"))
    sink.write_files(rows, str(tmp_path / "t"), merge=True)
    assert tree(tmp_path / "t") == {"d/old": "old", "d/new": "n", "same": "s", "empty": ""}
    assert os.listdir(tmp_path) == ["t"]


@pytest.mark.parametrize("bad", ["../up", "/abs", "a//b", "a/./b", "", "x\0y", None])
def test_a_failed_task_leaves_no_file(frame, tmp_path, bad):
    rows = frame("path string, content string", *[(f"f{i}", "x") for i in range(40)], (bad, "x")).repartition(8)
    with pytest.raises(PySparkException):
        sink.write_files(rows, str(tmp_path / "t"))
    assert os.listdir(tmp_path) == []


def test_a_path_given_twice_is_an_error(frame, tmp_path):
    with pytest.raises(ValueError):
        sink.write_files(frame("path string, content string", ("a", "x"), ("a", "")), str(tmp_path / "t"))
    assert os.listdir(tmp_path) == []


def test_no_rows_make_an_empty_folder(frame, tmp_path):
    sink.write_files(frame("path string, content string"), str(tmp_path / "t"))
    assert os.listdir(tmp_path / "t") == []


def test_other_roots_are_refused(frame):
    for root in ("hdfs://x/y", "relative/path"):
        with pytest.raises((ValueError, PySparkException)):
            sink.write_files(frame("path string, content string", ("a", "x")), root)


def plain_context(rows, fmt):
    chunk = {"xml": '<file path="{}">\n{}\n</file>', "text": "// file: {}\n{}"}[fmt]
    head, tail = {"xml": ("<files>\n", "\n</files>"), "text": ("", "")}[fmt]
    return head + "\n\n".join(chunk.format(p, c) for p, c in sorted(rows)) + tail + "\n"


@pytest.mark.parametrize("fmt", ["xml", "text"])
def test_contexts_of_any_size_become_one_file_each(frame, tmp_path, fmt):
    rng = random.Random(1)
    rows = {"big": [(f"f{i:05d}.ts", "é" * rng.randrange(300)) for i in range(3000)], "small": [("a", "")], "q": [("x", "1"), ("y", "2\n")]}
    files = frame(FILES, *[(project, p, c) for project, own in rows.items() for p, c in own]).repartition(7)
    pieces = src.write_context(packing.pack(files, fmt), str(tmp_path / "out"))
    assert tree(tmp_path / "out") == {f"{p}/context.txt": plain_context(own, fmt) for p, own in rows.items()}
    read = sink.read_pieces(pieces, str(tmp_path / "out"))
    back = sorted((r["start"], r["content"].decode()) for r in read.where("project = 'big'").collect())
    assert "".join(text for _, text in back) == plain_context(rows["big"], fmt)


def test_filled_templates_are_written(frame, tmp_path):
    files = frame(FILES, ("p", "b.ts", "2"), ("p", "a.ts", "1"))
    totals = frame("project string, template string, tokens bigint, usd double", ("p", "{{fileList}}|{{context}}|{{tokenCount}}", 3, 0.5))
    rows = packing.fill_template(packing.pack_text(files), packing.file_list(files), totals)
    src.write_context(rows, str(tmp_path / "out"), "prompt.md")
    assert tree(tmp_path / "out") == {"p/prompt.md": "a.ts\nb.ts|// file: a.ts\n1\n\n// file: b.ts\n2|3\n"}


def test_a_scan_in_tasks_lists_and_reads_what_the_scan_does(spark, tmp_path):
    from paperloom.sources import files as src

    for path, text in {"a": "x", "b/c.ts": "é\n" * 40_000, "b/d/e": "z", "b/empty": "", ".hidden": "h", "_own/f": "o", "b/_g": "g", "b/k=_1": "k"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text, encoding="utf-8")
    for k in range(300):
        (tmp_path / f"b/many{k}").write_text(str(k))
    listed = [sorted((r["path"], r["length"], r["modified"].timestamp(), bytes(r["content"])) for r in src.scan_files(spark, str(tmp_path), in_tasks=t).collect()) for t in (False, True)]
    assert [x[:2] + x[3:] for x in listed[0]] == [x[:2] + x[3:] for x in listed[1]] and len(listed[1]) == 304
    assert all(abs(x[2] - y[2]) < 1 for x, y in zip(*listed, strict=True))
    assert src.scan_files(spark, "file:" + str(tmp_path), in_tasks=True, content=False).columns == ["path", "length", "modified"]


def test_the_sink_works_its_rows_out_once(spark, tmp_path):
    from paperloom.sources.sink import write_files

    seen = spark.sparkContext.accumulator(0)

    def tell(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(50).selectExpr("concat('f', id) as path", "'x' as content").mapInArrow(tell, "path string, content string")
    write_files(rows, str(tmp_path / "out"))
    assert seen.value == 50 and len(list((tmp_path / "out").iterdir())) == 50

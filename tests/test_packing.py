import os
import sys

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

import compare
from paperloom.operators import packing, tokens

SCHEMA = "project string, path string, content string"


@pytest.fixture
def files(frame):
    return frame(SCHEMA, ("p", "b.ts", "const b = 2;"), ("p", "a.ts", "const a = 1;"))


XML = '<files>\n<file path="a.ts">\nconst a = 1;\n</file>\n\n<file path="b.ts">\nconst b = 2;\n</file>\n</files>'
TEXT = "// file: a.ts\nconst a = 1;\n\n// file: b.ts\nconst b = 2;"


def context(rows):
    """The pieces of one project put together."""
    slots = ["slot"] if "slot" in rows.columns else []
    return "".join(r["text"] for r in rows.orderBy(*slots, packing.order_key()).collect())


def test_formats(files):
    assert context(packing.pack_xml(files)) == XML
    assert context(packing.pack_text(files)) == TEXT
    assert context(packing.pack(files, "yaml")) == XML
    assert packing.pack_summary(files, "yaml").collect()[0]["format"] == "xml"
    assert context(packing.file_list(files)) == "a.ts\nb.ts"


def test_a_project_is_ordered_rows_at_any_size(frame):
    mixed = frame(SCHEMA, ("big", "a", "x" * 100_000), ("big", "b", "y"), ("small", "a", "z"))
    rows = packing.pack_text(mixed).collect()
    assert sorted((r["project"], r["path"], r["last"]) for r in rows) == [("big", "a", False), ("big", "b", True), ("small", "a", True)]


def test_packing_does_not_shuffle_content(files):
    plan = packing.pack_xml(files)._jdf.queryExecution().optimizedPlan().toString()
    aggregate = plan[plan.index("Aggregate") :]
    assert "content" not in aggregate.split("LogicalRDD")[0]


def fill(frame, files, template, count=42, usd=0.0123456):
    named = frame("project string, template string, tokens bigint, usd double", ("p", template, count, usd))
    return context(packing.fill_template(packing.pack_text(files), packing.file_list(files), named))


def test_fill_template(frame, files):
    template = "Files: {{fileList}}\nTokens: {{tokenCount}}\nCost: {{usdEstimate}}\n---\n{{context}}"
    assert fill(frame, files, template) == f"Files: a.ts\nb.ts\nTokens: 42\nCost: 0.0123\n---\n{TEXT}"
    assert fill(frame, files, "Just a prompt") == f"Just a prompt\n\n{TEXT}"
    assert fill(frame, files, "") == f"\n\n{TEXT}"
    assert fill(frame, files, "{{context}}A{{fileList}}{{context}}") == f"{TEXT}Aa.ts\nb.ts{TEXT}"


def test_substituted_text_is_not_searched_again(frame):
    files = frame(SCHEMA, ("p", "{{context}}", "has {{fileList}}"))
    assert fill(frame, files, "{{context}}|{{fileList}}") == "// file: {{context}}\nhas {{fileList}}|{{context}}"


@pytest.mark.parametrize(
    "value, inline",
    [
        ("line one\nline two", True), ("prompts/pack.md", False), ("prompts\\pack.md", False), ("pack.md", False),
        ("summarize", True), ("summarize this codebase", True), ("", False), ("   ", False),
    ],
)
def test_looks_inline(frame, value, inline):
    assert frame("s string", (value,)).select(packing.looks_inline(F.col("s"))).collect()[0][0] is inline


def test_template_lookup(frame):
    templates = frame("name string, content string", ("review.md", "M"), ("review.txt", "T"), ("only.txt", "O"), ("x/p.md", "P"))
    sources = frame("source string", ("review.md",), ("do it",), ("gone.md",), ("x/p.md",), ("./x/../review.md",))
    found = {r["source"]: r["template"] for r in packing.resolve_source(sources, templates).collect()}
    assert found == {"review.md": "M", "do it": "do it", "gone.md": None, "x/p.md": "P", "./x/../review.md": "M"}
    names = frame("named string", ("review",), ("review.txt",), ("only",), ("gone",))
    found = {r["named"]: r["template"] for r in packing.resolve_name(names, templates).collect()}
    assert found == {"review": "M", "review.txt": "T", "only": "O", "gone": None}


def test_choose_output(frame):
    names = ("raw", "missing", "configured", "named", "unnamed")
    files = frame(SCHEMA, *[(p, "f", "C") for p in names])
    totals = frame("project string, tokens bigint, usd double", *[(p, 1, 0.1) for p in names])
    sources = frame("project string, source string", ("missing", "gone.md"), ("configured", "a.md"), ("named", "a.md"))
    named = frame("project string, named string", ("named", "b"), ("unnamed", "nowhere"))
    templates = frame("name string, content string", ("a.md", "A {{context}}"), ("b.md", "B {{context}}"))
    found = packing.choose_output(packing.pack_text(files), packing.file_list(files), totals, sources, named, templates)
    packed = "// file: f\nC"
    for project, want in {"raw": packed, "missing": packed, "configured": "A " + packed, "named": "B " + packed}.items():
        own = found.where(f"project = '{project}'")
        assert context(own) == want and own.where("error IS NOT NULL").isEmpty()
    failed = found.where("project = 'unnamed'").collect()
    assert [(r["text"], r["error"]) for r in failed] == [(None, "template not found: nowhere")]


def test_token_count_equals_the_library(frame):
    texts = ["hello world", "", "const x = 42;\n", "Привет, мир! 🌍", "<|endoftext|>", "  a\n\n\n b"]
    counted = tokens.token_count(frame("text string, id int", *[(t, i) for i, t in enumerate(texts)]), "text")
    got = {r["id"]: r["text_tokens"] for r in counted.collect()}
    assert got == {i: tokens.count_text(t) for i, t in enumerate(texts)}
    assert got[1] == 0 and got[0] == 2 and got[4] > 1


@pytest.mark.parametrize("fmt", ["xml", "text"])
def test_summed_tokens_equal_those_of_the_context(frame, fmt):
    odd = [("a.ts", "x  \n\n"), ("b dir/c.ts", "  lead"), ("ä.md", "> quote\n<tag>"), ("z", ""), ("z2", "\n"), ("z3", "1 // ")]
    files = frame(SCHEMA, *[("p", p, c) for p, c in odd], ("single", "a", "b"))
    contexts = {p: context(packing.pack(files.where(f"project = '{p}'"), fmt)) for p in ("p", "single")}
    summary = {r["project"]: r["tokens"] for r in packing.pack_token_summary(files, fmt).collect()}
    assert summary == {p: tokens.count_text(t) for p, t in contexts.items()}


def test_price(frame):
    row = frame("n bigint", (2,)).select(tokens.token_cost(F.col("n"))).collect()[0][0]
    assert abs(row - 2 / 1_000_000 * 5) < 1e-12


def test_price_text_rounds_by_binary_value(frame):
    prices = [n * 5e-6 for n in range(0, 4000, 10)]
    got = frame("u double", *[(u,) for u in prices]).select(tokens.usd_text(F.col("u")).alias("t")).collect()
    assert [r["t"] for r in got] == ["%.4f" % u for u in prices]


def test_packing_cleaned_files_leaves_the_sources(frame):
    files = frame(SCHEMA, ("p", "a.ts", "a // x"))
    assert context(packing.pack_text(files, clean=True)) == "// file: a.ts\na "
    assert files.collect()[0]["content"] == "a // x"


def test_a_context_is_put_together_whole(files):
    from paperloom.sources.files import assemble_context

    assert [tuple(r) for r in assemble_context(packing.pack_xml(files)).collect()] == [("p", 0, 0, 2, XML)]
    assert [r["text"] for r in assemble_context(packing.file_list(files)).collect()] == ["a.ts\nb.ts"]


def test_a_long_context_goes_on_in_the_next_part(frame):
    from paperloom.sources.files import assemble_context

    names = ["b", "C", "a", "é", "_d", "e f"]
    rows = [(project, name, name * 9) for project in ("p", None) for name in names] + [("q", "x", ""), ("p", "e f", "again")]
    packed = packing.pack_text(frame(SCHEMA, *rows, *[("p", f"n{k}", str(k)) for k in range(30)]), nameless=True)
    whole = {r["project"]: r["text"] for r in assemble_context(packed).collect()}
    assert set(whole) == {"p", None, "q"} and whole["q"] == "// file: x\n"
    assert whole[None].startswith("// file: _d") and all(f"// file: {name}\n{name * 9}" in whole[None] for name in names)
    parts = sorted(assemble_context(packed, part_bytes=40).where("project = 'p'").collect(), key=lambda r: r["part"])
    assert len(parts) > 5 and "".join(r["text"] for r in parts) == whole["p"] and sum(r["pieces"] for r in parts) == 37
    assert all(r["start"] // 40 == r["part"] for r in parts)


def test_the_packing_queries_give_whole_contexts(spark, sf_dir):
    import __spark_entry__ as entry

    bytes_of = {r["project"]: r["context_bytes"] for r in entry.queries()["d08_pack_summary"](spark, sf_dir).collect()}
    packed = entry.queries()["d01_pack_xml"](spark, sf_dir).collect()
    assert len(packed) == len(bytes_of)
    assert all(len(r["text"].encode()) == bytes_of[r["project"]] and r["text"].endswith("</files>") for r in packed)


@pytest.fixture
def odd_dir(tmp_path):
    """Documents of which some share path and seq, and some lack a text, first and last in their project."""
    texts = [
        (780, "two", "src0"), (781, "one", "src0"), (781, "one", "src0"), (0, "z", "src0"),
        (782, None, "src1"), (580, "mid", "src1"), (1, None, "src1"),
        (783, None, "src2"), (2, None, "src2"),
        (3, "y", "other"), (4, "x", "other"), (784, None, "other"), (785, "v", "other"), (785, "v", "other"),
    ]
    rows = [{"doc_id": i, "text": t, "lang": "en", "source": s, "n_chars": len(t or "")} for i, t, s in texts]
    nations = [{"n_nationkey": k, "n_name": f"N{k}", "n_regionkey": k, "n_comment": ""} for k in range(5)]
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "documents.parquet")
    pq.write_table(pa.Table.from_pylist(nations), tmp_path / "nation.parquet")
    return str(tmp_path)


def texts_and_sql(spark, folder, name):
    """The text of each project, once the query agrees with its SQL."""
    import __spark_entry__ as entry

    con = duckdb.connect()
    for table in ("documents", "nation"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    rows = entry.queries()[name](spark, folder)
    assert compare.difference(rows, con, entry.oracle_sql()[name]) is None
    return {r["project"]: r["text"] for r in rows.collect()}


SHARED = '<files>\n' + "\n\n".join(f'<file path="{p}">\n{t}\n</file>' for p, t in [(".env.example", "one"), (".env.example", "one"), (".env.example", "two"), ("src/f0.ts", "z")]) + "\n</files>"
MIDDLE = '<files>\n<file path="Dockerfile">\nmid\n</file>\n</files>'


def test_texts_of_files_that_share_a_place_or_have_none(spark, odd_dir):
    found = texts_and_sql(spark, odd_dir, "d02_pack_text")
    assert found["src0"] == "\n\n".join(f"// file: {p}\n{t}" for p, t in [(".env.example", "one"), (".env.example", "one"), (".env.example", "two"), ("src/f0.ts", "z")])
    assert found["src1"] == "// file: Dockerfile\nmid" and found["src2"] == ""


def test_long_contexts_of_files_that_share_a_place(frame):
    from paperloom.sources.files import assemble_context

    rows = [("p", path, f"{k % 7}" * 20) for path in "abc" for k in range(30)] + [(None, "a", "x"), ("p", "0", None), ("p", "c", None)]
    packed = packing.pack_text(frame(SCHEMA, *rows), loose=True)
    assert {r["project"] for r in packed.collect()} == {"p"}
    parts = sorted(assemble_context(packed, tie=("nth",), part_bytes=300).collect(), key=lambda r: r["part"])
    texts = sorted(r for r in rows if r[0] and r[2])
    assert "".join(r["text"] for r in parts) == "\n\n".join(f"// file: {p}\n{t}" for _, p, t in texts)
    assert len(parts) > 9 and max(len(r["text"]) for r in parts) < 350 and all(r["start"] // 300 == r["part"] for r in parts)


def test_lists_of_files_that_share_a_place(spark, odd_dir):
    found = texts_and_sql(spark, odd_dir, "d03_file_list")
    assert found["src0"] == ".env.example\n.env.example\n.env.example\nsrc/f0.ts"
    assert found["src1"] == ".env.example\nDockerfile\nsrc/f1.ts"
    assert found["other"] == ".env.example\n.env.example\n.env.example\nsrc/f3.ts\nsrc/f4.ts"


def test_templates_filled_with_files_that_share_a_place_or_have_none(spark, odd_dir):
    found = texts_and_sql(spark, odd_dir, "d04_fill_template")
    assert found == {"src0": f"Plain prompt of N0\n\n{SHARED}", "src1": f"summarize this\n\n{MIDDLE}"}


def test_outputs_of_files_that_share_a_place_or_have_none(spark, odd_dir):
    found = texts_and_sql(spark, odd_dir, "d06_choose_output")
    assert found["src0"] == f"Plain prompt of N0\n\n{SHARED}" and found["src1"] == f"summarize this\n\n{MIDDLE}"
    assert found["src2"] == "Files: .env.example\nsrc/f2.ts Tokens: 0 Cost: 0.0000  again 0"
    assert found["other"].startswith('<files>\n<file path=".env.example">\nv\n</file>\n\n<file path=".env.example">') and found["other"].endswith("y\n</file>\n\n<file path=\"src/f4.ts\">\nx\n</file>\n</files>")

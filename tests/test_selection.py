import os

import pytest
from pyspark.sql import functions as F

from paperloom.operators import selection as sel
from paperloom.sources import files as src

FILES = "project string, path string, length bigint"


def listed(frame, *paths):
    return frame(FILES, *[("p", path, 1) for path in paths])


def rules(frame, *texts):
    return sel.ignore_rules(
        frame("project string, origin_ord int, content string", *[("p", i, t) for i, t in enumerate(texts)])
    )


def kept(df):
    return sorted(r["path"] for r in df.collect())


RULE_CASES = [
    # defaults keep sources and drop dependency and build folders
    (["\n".join(sel.DEFAULT_IGNORE)], ["b.ts", "a.ts", "node_modules/dep/index.js", "dist/out.js", "src/util.ts"], ["a.ts", "b.ts", "src/util.ts"]),
    (["secret.txt\nlogs/\n"], [".gitignore", "secret.txt", "logs/app.log", "keep.txt"], [".gitignore", "keep.txt"]),
    (["*.md\n"], [".toolignore", "readme.md", "code.ts"], [".toolignore", "code.ts"]),
    # the last matching rule decides, also across sources
    (["*.log", "!keep.log"], ["a.log", "keep.log"], ["keep.log"]),
    (["!keep.log", "*.log"], ["a.log", "keep.log"], []),
    # a dropped directory is not entered again
    (["logs", "!logs/keep.log"], ["logs/keep.log", "x.ts"], ["x.ts"]),
    (["logs/*", "!logs/keep.log"], ["logs/keep.log", "logs/a.log"], ["logs/keep.log"]),
    # a directory rule leaves a file of that name alone
    (["build/"], ["build", "build/a.ts", "src/build/b.ts"], ["build"]),
    # rooted, spanning and single-character patterns
    (["/docs"], ["docs/a.md", "src/docs/b.md"], ["src/docs/b.md"]),
    (["src/**/gen"], ["src/gen/a.ts", "src/x/y/gen/b.ts", "gen/c.ts"], ["gen/c.ts"]),
    (["**/tmp"], ["tmp/a", "x/tmp/b", "x/tmpl"], ["x/tmpl"]),
    (["a/**"], ["a/b", "a/c/d", "b/a/x"], ["b/a/x"]),
    (["f?.ts"], ["f1.ts", "f12.ts", "f/.ts"], ["f/.ts", "f12.ts"]),
    (["[a-c].ts", "x[^0-9].ts"], ["a.ts", "d.ts", "xa.ts", "x1.ts"], ["d.ts", "x1.ts"]),
    # operators of regular expressions are plain text, malformed classes match nothing
    (["a+b.ts", "c(1).ts", "[z-a].ts", "q[.ts", "$x"], ["a+b.ts", "aab.ts", "c(1).ts", "b.ts", "q[.ts", "$x"], ["aab.ts", "b.ts", "q[.ts"]),
    (["src\\gen"], ["src/gen/a.ts", "src/b.ts"], ["src/b.ts"]),
    (["# note\n\n   \n  *.ts  "], ["a.ts", "# note"], ["# note"]),
]


def test_ignore_rules(frame):
    """Every case is a project of its own."""
    sources = [(f"c{i}", k, text) for i, (texts, _, _) in enumerate(RULE_CASES) for k, text in enumerate(texts)]
    files = frame(FILES, *[(f"c{i}", path, 1) for i, (_, paths, _) in enumerate(RULE_CASES) for path in paths])
    found = sel.ignore_rules(frame("project string, origin_ord int, content string", *sources))
    left = {}
    for row in sel.ignore_filter(files, found).collect():
        left.setdefault(row["project"], set()).add(row["path"])
    for i, (texts, _, expected) in enumerate(RULE_CASES):
        assert left.get(f"c{i}", set()) == set(expected), texts


def test_rules_of_one_project_do_not_touch_another(frame):
    files = frame(FILES, ("p", "a.md", 1), ("q", "a.md", 1))
    assert [r["project"] for r in sel.ignore_filter(files, rules(frame, "*.md")).collect()] == ["q"]


def test_version_control_directory_is_always_dropped(frame):
    assert kept(sel.ignore_filter(listed(frame, ".git/config", "lib/.git/x", "a.ts", ".gitignore"), rules(frame, "!.git"))) == [".gitignore", "a.ts"]


@pytest.mark.parametrize(
    "roots, expected",
    [
        (["src"], ["src/a.ts", "src/nested/b.ts"]),
        (["src/"], ["src/a.ts", "src/nested/b.ts"]),
        (["src", "."], ["other/c.ts", "src", "src/a.ts", "src/nested/b.ts", "srcs/d.ts"]),
        (["src", ""], ["other/c.ts", "src", "src/a.ts", "src/nested/b.ts", "srcs/d.ts"]),
        ([], ["other/c.ts", "src", "src/a.ts", "src/nested/b.ts", "srcs/d.ts"]),
        (["src/a.ts"], []),
    ],
)
def test_roots(frame, roots, expected):
    paths = ["src/a.ts", "src/nested/b.ts", "other/c.ts", "src", "srcs/d.ts"]
    assert kept(sel.root_path_filter(listed(frame, *paths), roots)) == expected


def test_size_limit_keeps_equal(frame):
    files = frame(FILES, ("p", "a", sel.MAX_FILE_BYTES), ("p", "b", sel.MAX_FILE_BYTES + 1))
    assert kept(sel.size_filter(files)) == ["a"]
    assert kept(sel.oversize_files(files)) == ["b"]


def test_text_and_binary(frame):
    schema = "project string, path string, content binary"
    rows = [
        ("p", "img.PNG", b"x"), ("p", "code.ts", b"a\x00"), ("p", "main.go", b"x"), ("p", "Dockerfile", b"\x00"),
        ("p", "blob.xyz", b"A\x00B"), ("p", "plain.xyz", b"hello"), ("p", "empty", b""), ("p", "late", b"a" * 8192 + b"\x00"),
    ]
    files = frame(schema, *rows)
    assert kept(sel.text_filter(files)) == sorted(p for _, p, _ in rows if p != "img.PNG")
    assert kept(sel.text_filter(files, True, sel.BINARY_PROBE_BYTES)) == sorted(
        p for _, p, _ in rows if p not in ("img.PNG", "blob.xyz")
    )
    assert kept(sel.text_filter(files, by_content=True)) == sorted(
        p for _, p, _ in rows if p not in ("img.PNG", "blob.xyz", "late")
    )


@pytest.mark.parametrize("json", ['{"prompts":{"pack":5}}', '{"cleaner":{"whitelist":["a",1]}}', '{"packer":{"ignore":[true]}}', "{", "[]x"])
def test_fields_of_the_wrong_type_are_errors(frame, json):
    assert sel.effective_config(frame("project string, json string", ("p", json))).collect()[0]["invalid"]


@pytest.mark.parametrize("json", [None, "{}", '{"prompts":{"pack":null}}', '{"prompts":null,"cleaner":{"whitelist":[]}}', '{"packer":{"ignore":["a"],"x":5}}'])
def test_missing_and_empty_fields_are_not(frame, json):
    assert not sel.effective_config(frame("project string, json string", ("p", json))).collect()[0]["invalid"]


@pytest.mark.parametrize("given, expected", [(["banana", "apple", "cherry"], ["apple", "banana", "cherry"]), (["z", "ä", "a"], ["a", "ä", "z"]), (["only"], ["only"])])
def test_locale_order(frame, given, expected):
    assert [r["path"] for r in sel.locale_order(listed(frame, *given)).collect()] == expected


def test_clean_targets(frame):
    files = listed(frame, "src/a.ts", "src/b.go", "src/c.tsx", "readme.md")
    assert kept(sel.extension_filter(files)) == ["src/a.ts", "src/c.tsx"]
    assert kept(sel.input_path_filter(files, ["src/a.ts"])) == ["src/a.ts"]
    assert kept(sel.input_path_filter(files, ["src/"])) == ["src/a.ts", "src/b.go", "src/c.tsx"]
    assert kept(sel.input_path_filter(files, ["src/a"])) == []


def test_change_sets(frame):
    changes = frame("list string, path string", ("staged", "b.ts"), ("unstaged", "a.ts"), ("untracked", "b.ts"), ("staged", " "))
    files = listed(frame, "a.ts", "b.ts", "c.ts")
    assert kept(sel.changed_filter(files, changes)) == ["a.ts", "b.ts"]
    assert kept(sel.changed_filter(files, changes, "staged")) == ["b.ts"]


def config(frame, text):
    return sel.effective_config(frame("project string, json string", ("p", text))).collect()[0]


def test_config_defaults_and_overrides(frame):
    row = config(frame, None)
    assert (row["whitelist"], row["keep_doc"], row["clean_use_vcs_ignore"], row["invalid"]) == (["//!"], True, True, False)
    assert row["pack_ignore"] == list(sel.DEFAULT_IGNORE)
    row = config(frame, '{"$schema":"x","cleaner":{"keepJSDoc":false}}')
    assert (row["keep_doc"], row["clean_use_vcs_ignore"], row["whitelist"]) == (False, True, ["//!"])
    assert config(frame, '{"unknown":123,"packer":{"useGitignore":false}}')["pack_use_vcs_ignore"] is False
    assert config(frame, '{"packer":{"ignore":[]}}')["pack_ignore"] == []


def test_config_of_wrong_type_is_an_error_row(frame):
    row = config(frame, '{"cleaner":{"whitelist":"not-an-array"}}')
    assert row["invalid"] and row["whitelist"] is None


def test_ignore_sources_follow_the_configuration(frame):
    config = sel.effective_config(
        frame("project string, json string", ("p", '{"packer":{"ignore":["gen"]}}'), ("q", '{"packer":{"useGitignore":false}}'))
    )
    schema = "project string, path string, content string"
    files = frame(
        schema,
        *[(p, path, text) for p in "pq" for path, text in ((".gitignore", "*.log"), (".toolignore", "*.md"), ("sub/.gitignore", "*.ts"))],
        *[(p, path, "") for p in "pq" for path in ("a.log", "b.md", "c.ts", "gen/x.ts", "dist/y.ts")],
    )
    found = sel.ignore_filter(files, sel.ignore_rules(sel.ignore_sources(config, files, ".toolignore")))
    left = sorted((r["project"], r["path"]) for r in found.collect() if not r["path"].endswith("ignore"))
    assert left == [("p", "c.ts"), ("p", "dist/y.ts"), ("q", "a.log"), ("q", "c.ts"), ("q", "gen/x.ts")]


def make_tree(root):
    for path, data in {
        "src/a.ts": b"a", "src/deep/b.ts": b"bb", ".gitignore": b"*.log\n", ".git/config": b"x", "_x/c.ts": b"ccc", "d.log": b"",
    }.items():
        target = os.path.join(root, path)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(target, "wb") as handle:
            handle.write(data)


def test_scan_reads_visible_names_and_prunes(spark, tmp_path):
    make_tree(str(tmp_path))
    scanned = src.scan_files(spark, str(tmp_path))
    assert {r["path"]: r["length"] for r in scanned.select("path", "length").collect()} == {"src/a.ts": 1, "src/deep/b.ts": 2}
    plan = scanned.where("length <= 1").select("path")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,1)" in plan and "content" not in plan.split("ReadSchema")[1]


def test_tree_has_hidden_names_and_loads_after_filtering(spark, tmp_path):
    make_tree(str(tmp_path))
    tree = src.list_tree(spark, str(tmp_path))
    assert {r["path"] for r in tree.collect()} == {"src/a.ts", "src/deep/b.ts", ".gitignore", "_x/c.ts", "d.log"}
    loaded = src.decode(src.load_content(tree.where(F.col("path").endswith(".ts")), str(tmp_path)))
    assert {r["path"]: r["content"] for r in loaded.collect()} == {"src/a.ts": "a", "src/deep/b.ts": "bb", "_x/c.ts": "ccc"}


def test_read_tree(spark, tmp_path):
    make_tree(str(tmp_path))
    assert {r["path"]: bytes(r["content"]) for r in src.read_tree(spark, str(tmp_path)).collect()}["d.log"] == b""


def test_invalid_utf8_is_flagged(frame):
    rows = src.decode(frame("path string, content binary", ("a", b"x\xff"), ("b", b"x"))).orderBy("path").collect()
    assert [(r["valid_utf8"], r["content"]) for r in rows] == [(False, "x\ufffd"), (True, "x")]

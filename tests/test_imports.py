import pytest

from paperloom.operators import imports as imp
from paperloom.session import ensure_checkpoint_dir

FILES = "project string, path string, content string"


def test_specifiers(frame):
    text = """
import a from './a'; import { b,
  c } from "../b.js"
import './side';
export * from './re'; export { x } from './x';
import type { T } from './types';
const d = await import('./dyn'), e = require("./req");
// import gone from './gone';
/* export * from './gone2' */
const s = "import no from './no'";
import r from 'react'; import fs from 'node:fs';
"""
    rows = imp.import_edges_raw(frame(FILES, ("p", "src/m.ts", text))).collect()
    assert [(r["specifier"], r["kind"]) for r in rows if not r["specifier"].startswith("./no")] == [
        ("./a", "import"), ("../b.js", "import"), ("./side", "import"), ("./re", "re-export"), ("./x", "re-export"),
        ("./types", "type"), ("./dyn", "dynamic"), ("./req", "dynamic"), ("react", "import"), ("node:fs", "import"),
    ]


def test_resolution(frame):
    files = frame(
        "project string, path string",
        *[("p", f) for f in (
            "src/m.ts", "src/a.ts", "src/a.js", "src/dir/index.tsx", "src/both.ts", "src/both/index.ts", "lib/b.ts",
            "src/data.json", "index.ts", "node_modules/x/index.js", "src/d.d.ts", "src/real.js",
        )],
        ("q", "src/other.ts"),
    )
    wanted = {
        "./a": "src/a.ts", "./a.js": "src/a.js", "./dir": "src/dir/index.tsx", "./dir/": "src/dir/index.tsx",
        "./both": "src/both.ts", "../lib/b": "lib/b.ts", "../lib/b.js": "lib/b.ts", "./data": "src/data.json",
        "..": "index.ts", "./d": "src/d.d.ts", "./real": "src/real.js", "@/a": "src/a.ts", "lib": "lib/b.ts",
        "./other": None, "../../up": None, "../node_modules/x": None, "react": None,
    }
    edges = frame(
        "project string, path string, specifier string, kind string", *[("p", "src/m.ts", s, "import") for s in wanted]
    )
    rows = imp.resolve_imports(edges, files, {"@/*": "src/*", "lib": "lib/b"}).collect()
    assert {r["specifier"]: r["resolved"] for r in rows} == wanted
    assert {r["specifier"] for r in rows if r["external"]} == {"react", "../../up"}


EDGES = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e"), ("x", "y"), ("e", "e")]


def reach(frame, entries, depth=0):
    edges = frame("project string, src string, dst string", *[("p", s, t) for s, t in EDGES], ("q", "a", "z"))
    starts = frame("project string, path string", *[("p", e) for e in entries])
    return imp.reachable(edges, starts, depth)


def test_reachable_with_cycles(frame):
    rows = {r["path"]: (r["depth"], r["parent"]) for r in reach(frame, ["a"]).collect()}
    assert rows == {"a": (0, None), "b": (1, "a"), "c": (1, "a"), "d": (2, "b"), "e": (3, "d")}


def test_depth_and_reasons(frame):
    limited = reach(frame, ["a", "x"], 1)
    assert {r["path"]: r["reason"] for r in imp.explain(limited).collect()} == {
        "a": "entry point", "x": "entry point", "b": "import from a", "c": "import from a", "y": "import from x",
    }
    assert {r["path"] for r in reach(frame, ["a"], -5).collect()} == set("abcde")


def test_large_levels_are_joined_without_shuffling_the_edges(spark, frame):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = {r["path"]: (r["depth"], r["parent"]) for r in reach(frame, ["a"]).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert rows == {"a": (0, None), "b": (1, "a"), "c": (1, "a"), "d": (2, "b"), "e": (3, "d")}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("import_edges_")]


def configs(frame, *rows):
    return frame("project string, path string, content string", *rows)


def test_aliases_are_read_from_each_projects_configuration(frame):
    found = imp.path_aliases(configs(
        frame,
        ("p", "tsconfig.json", '{"compilerOptions": {"paths": {"@/*": ["src/*", "lib/*"], "x": ["./y"]}}}'),
        ("q", "tsconfig.json", '{ // base\n "extends": "./conf/base", "compilerOptions": {"strict": true,}, }'),
        ("q", "conf/base.json", '{"extends": "../top.json", "compilerOptions": {"paths": {"@/*": ["../app/*"]}}}'),
        ("q", "top.json", '{"compilerOptions": {"baseUrl": "code", "paths": {"@/*": ["never"]}}}'),
        ("r", "jsconfig.json", '{"extends": ["./a.json", "./b.json"]}'),
        ("r", "b.json", '{"extends": "./c.json"}'),
        ("r", "c.json", '{"extends": "./b.json", "compilerOptions": {"baseUrl": "."}}'),
        ("s", "tsconfig.json", "not json"), ("s", "sub/tsconfig.json", '{"compilerOptions": {"baseUrl": "."}}'),
        ("t", "tsconfig.json", '{"extends": "some-package/tsconfig"}'),
    ))
    rows = sorted((r["project"], r["alias"], r["targets"], r["fallback"]) for r in found.collect())
    assert rows == [
        ("p", "@/*", ["src/*", "lib/*"], False), ("p", "x", ["y"], False),
        ("q", "*", ["code/*"], True), ("q", "@/*", ["app/*"], False),
        ("r", "*", ["*"], True),
    ]


def test_the_longest_alias_and_the_first_file_win(frame):
    files = frame("project string, path string", *[("p", f) for f in ("src/a.ts", "lib/a.ts", "lib/b/index.ts", "ui/k.tsx", "base/z.ts", "one.ts", "end/q.gen.ts")], ("q", "lib/a.ts"))
    aliases = frame(
        "project string, alias string, targets array<string>, fallback boolean",
        ("p", "@/*", ["src/*", "lib/*"], False), ("p", "@/ui/*", ["ui/*"], False), ("p", "one", ["one"], False),
        ("p", "gen/*.x", ["end/*.gen"], False), ("p", "*", ["base/*"], True), ("q", "@/*", ["lib/*"], False),
    )
    wanted = {
        ("p", "@/a"): ("src/a.ts", False), ("p", "@/b"): ("lib/b/index.ts", False), ("p", "@/ui/k"): ("ui/k.tsx", False),
        ("p", "@/ui/none"): (None, False), ("p", "one"): ("one.ts", False), ("p", "gen/q.x"): ("end/q.gen.ts", False),
        ("p", "z"): ("base/z.ts", False), ("p", "react"): (None, True), ("q", "@/a"): ("lib/a.ts", False), ("q", "one"): (None, True),
    }
    edges = frame("project string, path string, specifier string, kind string", *[(p, "m.ts", s, "import") for p, s in wanted] * 2)
    rows = imp.resolve_imports(edges, files, aliases).collect()
    assert len(rows) == 2 * len(wanted)
    assert {(r["project"], r["specifier"]): (r["resolved"], r["external"]) for r in rows} == wanted


def test_no_entry_is_an_error(frame):
    with pytest.raises(ValueError):
        reach(frame, [])


def test_checkpoints_go_to_the_named_folder(spark):
    ensure_checkpoint_dir(spark)
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert spark.sparkContext.getCheckpointDir().startswith("file:" + named)

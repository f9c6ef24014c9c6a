from pyspark.sql import functions as F

from paperloom.functions import markdown as md
from paperloom.operators import contracts, documents as d

DOCS = "project string, rel_path string, content string"


def value(frame, text, expression):
    return frame("t string", (text,)).select(expression(F.col("t")).alias("v")).collect()[0]["v"]


def test_section(frame):
    text = "# T\n## Goal now\r\nA\n### Sub\nB\n\n## Goals\nC\n## Next\nD"
    assert value(frame, text, lambda c: md.section(c, "## Goal")) == "A\n### Sub\nB"
    assert value(frame, text, lambda c: md.section(c, "## Next")) == "D"
    assert value(frame, text, lambda c: md.section(c, "## Gone")) == ""
    assert value(frame, "## Goal\n# Top\nx", lambda c: md.section(c, "## Goal")) == ""


def test_stand_block(frame):
    runbook = "# Runbook\n\n## Stand: dev (dev stand)\n- a\n- b\n\n## Stand: prod (prod)\n- c\n"
    assert value(frame, runbook, lambda c: md.block_from(c, "## Stand: dev")) == "## Stand: dev (dev stand)\n- a\n- b\n"
    assert value(frame, runbook, lambda c: md.block_from(c, "## Stand: prod")) == "## Stand: prod (prod)\n- c\n"
    assert value(frame, runbook, lambda c: md.block_from(c, "## Stand: missing")) == ""


def test_items_and_cells(frame):
    text = "1. **One** two\n- *x*\r\n  • y \n* z\n12.no\ntext"
    assert value(frame, text, md.list_items) == ["One two", "x", "y", "z"]
    table = "| Term | D |\n|---|---|\n| A | 1 |\nB | 2\n|  | 3 |\nno table"
    assert value(frame, table, lambda c: md.first_cells(c, ("Term",))) == ["A", "B"]


def test_keywords(frame):
    assert value(frame, "Users compare éclair Ёлочка ЁЖИКИ abcd five5 under_score Compare", md.keywords) == [
        "compare", "елочка", "ежики", "compare",
    ]


def test_fences_keep_line_numbers(frame):
    text = "a [x]\n```py\n[b]\n```\n[c]\n  ```\n[open]"
    rows = d.placeholders(frame(DOCS, ("p", "x.md", text))).collect()
    assert [(r["line"], r["detail"]) for r in rows] == [(1, "a [x]"), (5, "[c]")]
    boxes = d.placeholders(frame(DOCS, ("p", "x.md", "- [ ] a\r\n- [x] b\n[l](u)\n[a](u) [b]"))).collect()
    assert [r["line"] for r in boxes] == [1, 2, 4]


def test_banned(frame):
    text = "A fast and easy way\nbreakfast\nif neededness\nЛёгкий\nFAST-food\n```\nfast\n```\nfastest"
    rows = d.banned_words(frame(DOCS, ("p", "x.md", text))).collect()
    assert [(r["line"], r["rule"], r["detail"]) for r in rows] == [
        (1, "banned word", "fast"), (3, "banned phrase", "if needed"), (4, "banned word", "легкий"), (5, "banned word", "fast"),
    ]


VISION = """# V
**Status:** approved | **Date:** 2024-01-01
## Problem
{long}
## Target audience
{long}
## Goal
Give suppliers delivery schedules in one place, and much more than that for everyone.
## Key capabilities
1. Compare delivery schedules and {long}
## Success metrics
| Metric | Target |
|---|---|
| Orders | 5 percent more than in the year before, measured every single month |
## In scope
- Compare delivery schedules, and also some further words so that it is long enough
## Out of scope
- Payroll accounting exports together with quarterly bookkeeping ledgers
""".replace("{long}", "Regional warehouse managers plan deliveries for several suppliers each week.")
SPEC = """# S
**Status:** draft | **Date:** 2024-01-01
## References
## How the system works
{long}
## Glossary
| Term | Meaning |
| Schedule | the delivery plan that suppliers and warehouses agreed on together |
## Entities
| Entity | What |
| Schedule | the delivery plan that suppliers and warehouses agreed on together |
## Pages and screens
{long}
## Key operations
- Compare each schedule: delivery schedules, regional warehouse managers, deliveries, several suppliers
## Integrations
## Testing
**Critical scenarios** **Business rules** **Negative scenarios** all described in enough words
## Artifacts
see a.png
""".replace("{long}", "Regional warehouse managers plan deliveries for several suppliers each week.")
INDEX = "**Status:** draft **Date:** 2024-01-01\n## Navigation\n## Quick links"


def validated(frame, artifacts=(), **changes):
    texts = {d.INDEX: INDEX, d.VISION: VISION, d.SPEC: SPEC}
    texts.update({getattr(d, k): v for k, v in changes.items()})
    docs = frame(DOCS, *[("p", path, text) for path, text in texts.items() if text is not None])
    files = frame("project string, rel_path string", *[("p", a) for a in artifacts])
    return sorted((r["stage"], r["rule"], r["detail"]) for r in d.validate_documents(docs, files).collect())


def test_stages_stop_later_ones(frame):
    quick = (1, "banned word", "quick")  # the required heading itself holds a banned word
    assert validated(frame) == [quick]
    assert (1, "missing document", "") in validated(frame, INDEX=None)


def test_consistency_and_artifacts(frame, monkeypatch):
    monkeypatch.setattr(d, "BANNED", ())
    monkeypatch.setattr(d._banned, "__defaults__", (("zzz",),))
    assert validated(frame) == []
    assert validated(frame, ["3_ARTIFACTS/a.png", "3_ARTIFACTS/b.png"]) == [(3, "artifact not mentioned", "")]
    conflict = VISION.replace("Payroll accounting exports", "Delivery schedules")
    rules = {rule for _, rule, _ in validated(frame, ["3_ARTIFACTS/b.png"], VISION=conflict)}
    assert rules == {"excluded but specified"}
    assert {stage for stage, _, _ in validated(frame, VISION=conflict)} == {2}
    unused = SPEC.replace("| Schedule | the delivery plan that suppliers and warehouses agreed on together |\n## Entities", "| Zeppelin | an airship that nobody mentions anywhere else in these documents |\n## Entities")
    assert validated(frame, SPEC=unused) == [(2, "unused term", "Zeppelin")]


def test_status(frame):
    docs = frame(DOCS, ("p", d.INDEX, "**Status:** draft x **Status:** approved **Date:** 2020-01-01"), ("p", d.SPEC, "none"))
    report = {r["rel_path"]: (r["status"], r["date"]) for r in d.status_report(docs).collect()}
    assert report == {d.INDEX: ("draft", "2020-01-01"), d.SPEC: ("?", "?"), d.VISION: ("MISSING", "")}
    changed = {r["rel_path"]: (r["content"], r["changed"]) for r in d.set_status(docs, "in review", "2024-05-06").collect()}
    assert changed[d.INDEX] == ("**Status:** in review x **Status:** in review **Date:** 2024-05-06", True)
    assert changed[d.SPEC] == ("none", False)


def test_project_names(frame):
    names = frame("project string", ("ok-Name",), ("a b",), ("a/b c",), (" ",))
    rows = sorted((r["project"], r["problem"]) for r in d.project_name_issues(names).collect())
    assert rows == [(" ", "empty"), (" ", "spaces"), ("a b", "spaces"), ("a/b c", "forbidden characters"), ("a/b c", "spaces")]


def unpaged(frame, body):
    docs = frame(DOCS, ("p", contracts.API, f"```graphql\n{body}\n```"))
    return [(r["root_type"], r["field"]) for r in contracts.list_fields_without_paging(docs).collect()]


def test_paging(frame):
    assert unpaged(frame, "type Query {\n  a: [A]\n  b(first: Int): [B]\n  c: [C]\n}\ntype X {\n y: [Y]\n}") == [("Query", "a")]
    far = "type Query {\n  b(first: Int): [B]\n" + "  n: Int\n" * 7 + "  near: [N]\n  far: [F]\n}"
    assert unpaged(frame, far) == [("Query", "far")]
    assert unpaged(frame, "type Mutation\n{\n  a: [A]\n}") == []
    assert unpaged(frame, "type Query {\n  a(in: { x: Int }): [A]\n  deep {\n    b: [B]\n  }\n}\nextra: [E]") == [("Query", "a"), ("Query", "b")]
    assert unpaged(frame, "type Query {}\ntype Subscription { s: [S]\n}") == [("Subscription", "s")]


def test_models(frame):
    schema = "```prisma\nmodel User {\n id Int\n}\nmodel A_B {\n id Int\n}\nmodel User {\n createdAt DateTime\n}\n```"
    docs = frame(DOCS, ("p", contracts.DATABASE, schema), ("p", contracts.API, "nothing"))
    assert contracts.models_without_timestamps(docs).collect() == []
    row = contracts.model_coverage(docs).collect()[0]
    assert (row["covered"], row["total"], row["missing"]) == (0, 2, "User, A_B")


def test_verdict_gates(frame):
    full = [("p", f, "## Stack\n## What's already\n### Quick start") for f in contracts.REQUIRED_FILES]
    verdict = contracts.blueprint_verdict(frame(DOCS, *full, ("q", contracts.GUIDE, ""))).collect()
    rows = {r["project"]: (r["errors"], r["warnings"], r["passed"]) for r in verdict}
    # p: two missing blocks and two documents without a reference; q: four missing files and nothing else
    assert rows == {"p": (4, 0, False), "q": (4, 0, False)}

import datetime as dt
import random

import pytest

from paperloom.operators import findings as fd
from paperloom.operators import scans

TEXTS = "project string, path string, content string"


def test_parse(frame):
    table = (
        "| Check ID | Check | Status | Evidence | Solution | Fixed |\n|--|--|--|--|--|--|\n"
        "| OWA-02 | Auth | ❌ FAIL 🔴 | `a.ts:14` | **1. Add** \\\\ 2. x | No |\n| OWA-06 | Rate | ⏸ ACCEPTED | `b.ts` | In baseline | — |\n"
    )
    reports = frame("session string, audit string, component string, content string", ("s", "a", "c", table), ("s", "a", "c", "✅ none"))
    rows = [r.asDict() for r in fd.parse_findings(reports).collect()]
    assert [(r["check_id"], r["status"], r["severity"], r["evidence"], r["confidence"]) for r in rows] == [
        ("OWA-02", "FAIL", "critical", "a.ts:14", None), ("OWA-06", "ACCEPTED", None, "b.ts", None),
    ]


def test_baseline(frame):
    schema = "check_id string, file string, status string, severity string"
    rows = [("A", "x", "FAIL", "low"), ("A", "y", "FAIL", "low"), ("B", "x", "FAIL", "low"), ("C", "x", "FAIL", "low")]
    date = dt.date
    entries = frame(
        "check_id string, file string, type string, expires date",
        ("A", "x", "one", date(2000, 1, 1)), ("A", "x", "open", None), ("B", None, "any", date(2000, 1, 1)), ("C", "z", "no", None),
    )
    accepted = fd.apply_baseline(frame(schema, *rows), entries)
    got = {(r["check_id"], r["file"]): (r["status"], r["baseline_type"]) for r in accepted.collect()}
    assert got == {("A", "x"): ("ACCEPTED", "open"), ("A", "y"): ("FAIL", None), ("B", "x"): ("ACCEPTED", "any"), ("C", "x"): ("FAIL", None)}
    late = {(r["check_id"], r["file"]): (r["status"], r["severity"], r["note"]) for r in fd.expire_baseline(accepted, "2000-01-02").collect()}
    assert late["B", "x"] == ("FAIL", "high", "[baseline expired: 2000-01-01]") and late["A", "x"][0] == "ACCEPTED"
    on_the_day = fd.expire_baseline(accepted, "2000-01-01").where("check_id = 'B'").collect()[0]
    assert on_the_day["status"] == "ACCEPTED"


def test_verification(frame):
    files = frame("project string, path string, content string", ("p", "a.ts", "1\n2\n3"), ("q", "a.ts", "1\n2\n3\n4\n5"))
    given = frame("project string, evidence string", *[("p", e) for e in ("a.ts:3", "a.ts:4", "gone.ts:1", "a.ts", None)])
    got = {r["evidence"]: r["verdict"] for r in fd.verify_findings(given, files).collect()}
    assert got == {"a.ts:3": "confirmed", "a.ts:4": "false positive", "gone.ts:1": "stale", "a.ts": "confirmed", None: "stale"}


def test_sessions(frame):
    days = [dt.date(2024, 1, n) for n in (1, 2, 3)]
    sessions = frame("project string, session date", *[("p", x) for x in days], ("q", days[0]))
    assert sorted((r["project"], r["session"].day) for r in fd.keep_newest(sessions).collect()) == [("p", 2), ("p", 3), ("q", 1)]
    assert [r["session"].day for r in fd.stale_sessions(sessions, "2024-02-01").collect() if r["project"] == "p"] == [1]
    plan = fd.keep_newest(sessions)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_secrets(frame):
    text = "\n".join([
        'password = "hunter2"', "api_key: 'abc'", 'token = "your-token"', 'secret="${X}"', "see https://u:pw@host/x",
        "https://host:80/@x", "-----BEGIN RSA PRIVATE KEY-----", "AKIA" + "A1" * 8, "ghp_" + "a" * 36, "monkey business", "x?token=abc",
    ])
    rows = scans.scan_patterns(frame(TEXTS, ("p", "a", text), ("p", "b", "clean"))).collect()
    assert sorted((r["line"], r["pattern"]) for r in rows) == [
        (1, "assignment"), (2, "assignment"), (5, "url credentials"), (7, "private key"), (8, "cloud access key"),
        (9, "repository token"), (11, "url parameter"),
    ]


@pytest.mark.parametrize("text, found", [
    ('password = "hunter2", token = "example"', [(1, "assignment", 1)]),
    ("AKIA" + "B2" * 8 + ' key = "todo"', [(1, "cloud access key", 1)]),
    ('"password": "hunter2"', [(1, "assignment", 1)]),
    ('dbPassword = "hunter2"', [(1, "assignment", 1)]),
    ("x\n\ntoken := 'a' secret => \"b\"", [(3, "assignment", 1), (3, "assignment", 2)]),
    ("İ password = 'x'", [(1, "assignment", 1)]),
    ('monkey = "x" keyboard = "y" if key == "z"', []),
    ("https://u:${PW}@h ?token=<t> ?secret=%s", []),
    ("", []), (None, []),
])
def test_each_match_is_judged_by_its_own_value(frame, text, found):
    rows = scans.scan_patterns(frame(TEXTS, ("p", "a", text))).collect()
    assert sorted((r["line"], r["pattern"], r["n"]) for r in rows) == found


def test_confirmed_findings_lead_to_what_was_missed(frame):
    secret = 'const password = "hunter2";'
    files = frame(TEXTS, *[("p", f, secret) for f in ("d/a.ts", "d/b.ts", "d/c.ts", "e/a.ts")], ("q", "d/a.ts", secret), ("p", "d/k.ts", "AKIA" + "B2" * 8))
    known = frame(
        "project string, audit string, check_id string, status string, severity string, evidence string",
        ("p", "s", "SEC-01", "FAIL", "critical", "d/a.ts:1"), ("p", "s", "SEC-02", "FAIL", "low", "d/b.ts:1"), ("q", "s", "SEC-01", "PASS", "critical", "d/a.ts:1"),
    )
    rows = fd.missed_findings(fd.verify_findings(known, files), scans.scan_patterns(files)).collect()
    assert [(r["project"], r["check_id"], r["path"], r["pattern"], r["found_from"], r["verdict"]) for r in rows] == [
        ("p", "SEC-01", "d/c.ts", "assignment", "d/a.ts:1", "missed")
    ]


def test_session_status_against_all_entries(frame):
    rng = random.Random(8)
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    entries = []
    for _ in range(150):
        since = rng.randrange(900)
        entries.append((rng.choice("pq"), rng.choice(["A", "B"]), rng.choice([None, "f", "g"]), day(since), rng.choice([None, day(since + rng.randrange(40)), day(since + rng.randrange(40)), day(since + rng.randrange(40))]) if rng.random() < 0.2 else day(since + rng.randrange(30))))
    entries.append(("p", "A", "f", day(50), day(10)))
    known = [(rng.choice("pqr"), day(rng.randrange(-50, 1000)), rng.choice("ABC"), rng.choice([None, "f", "g", "h"]), rng.choice(["FAIL", "FAIL", "PASS"]), "low", i) for i in range(300)]
    found = fd.session_status(
        frame("project string, session date, check_id string, file string, status string, severity string, id int", *known),
        frame("project string, check_id string, file string, since date, expires date", *entries),
    ).collect()
    wanted = {}
    for project, session, check, file, status, severity, i in known:
        mine = [e for e in entries if e[0] == project and e[1] == check and (e[2] is None or e[2] == file) and (e[4] is None or e[3] <= e[4])]
        ended = max((e[4] for e in mine if e[4] and e[4] < session), default=None)
        if status == "FAIL" and any(e[3] <= session and (e[4] is None or session <= e[4]) for e in mine):
            wanted[i] = ("ACCEPTED", severity, None)
        elif status == "FAIL" and ended:
            wanted[i] = ("FAIL", "high", f"[baseline expired: {ended}]")
        else:
            wanted[i] = (status, severity, None)
    assert {r["id"]: (r["status"], r["severity"], r["note"]) for r in found} == wanted


def test_reports_are_spliced_and_stay_as_they_are_elsewhere(frame):
    text = "# T \r\n\n| Check ID | Check | Status | Evidence |\n|---|:-:|---|---|\n| SEC-01 | a |  ✅ PASS | `x.ts:1` |\n| SEC-02 | b \\\\| c | ⏸ ACCEPTED | `y.ts:2` |\n|SEC-03|d|❌ FAIL 🔴|`z.ts:3`|\n\ntail  "
    reports = frame("report int, content string", (1, text), (2, text), (3, "no table"))
    rows = fd.report_rows(reports, "report")
    assert sorted((r["line"], r["check_id"], r["status"], r["evidence"]) for r in rows.where("report = 1").collect()) == [
        (4, "SEC-01", "PASS", "x.ts:1"), (5, "SEC-02", "ACCEPTED", "y.ts:2"), (6, "SEC-03", "FAIL", "z.ts:3"),
    ]
    verdicts = frame(
        "report int, line int, check_id string, verdict string, evidence string, note string",
        (1, 4, "SEC-01", "stale", "x.ts:1", None), (1, 5, "SEC-02", "confirmed", "y.ts:2", "[baseline expired: 2024-01-01]"), (1, 6, "SEC-03", "gone", "z.ts:3", None),
        (2, 4, "SEC-01", "confirmed", "x.ts:1", None),
    )
    changed, log = fd.rewrite_reports(reports, verdicts, frame("report int, row string", (1, "| NEW-01 |"), (3, "| NEW-02 |")), "report")
    want = text.replace("  ✅ PASS |", "  ✅ PASS [✓ stale] |").replace(" ⏸ ACCEPTED ", " ❌ FAIL 🟠 [baseline expired: 2024-01-01] ").replace("|SEC-03|d|❌ FAIL 🔴|`z.ts:3`|", "| NEW-01 |")
    assert {r["report"]: r["content"] for r in changed.collect()} == {1: want, 3: "no table\n| NEW-02 |"}
    assert [tuple(r) for r in log.collect()] == [(1, 6, "SEC-03", "[removed: z.ts not found]")]


def brute_blocks(files, min_lines, min_tokens):
    """Blocks by comparing every window of every file."""
    windows, lines = {}, {}
    for key, text in files.items():
        kept = [(n, t.strip()) for n, t in enumerate(text.split("\n"), 1) if t.strip()]
        lines[key] = kept
        for i in range(len(kept) - min_lines + 1):
            windows.setdefault(tuple(t for _, t in kept[i : i + min_lines]), []).append((key, i))
    found = set()
    for key, kept in lines.items():
        at = sorted(i for places in windows.values() if len(places) > 1 for k, i in places if k == key)
        while at:
            run = [at.pop(0)]
            while at and at[0] == run[-1] + 1:
                run.append(at.pop(0))
            block = kept[run[0] : run[-1] + min_lines]
            tokens = sum(len(t.split()) for _, t in block)
            if tokens >= min_tokens:
                found.add((key, block[0][0], block[-1][0], len(block), tokens))
    return found


def test_duplicates_against_brute_force(frame):
    rng = random.Random(5)
    files = {}
    for n in range(30):
        lines = [rng.choice(["a b", "c", "d e f", "", "  x y", f"u{rng.random()}"]) for _ in range(rng.randint(0, 30))]
        if n % 3 == 0:
            lines[3:3] = [f"shared line {i}" for i in range(rng.randint(3, 7))]
        files[f"f{n}"] = "\n".join(lines)
    rows = scans.duplicate_blocks(frame(TEXTS, *[("p", k, t) for k, t in files.items()]), 3, 6).collect()
    got = {(r["path"], r["start_line"], r["end_line"], r["lines"], r["tokens"]) for r in rows}
    assert got == brute_blocks(files, 3, 6) and got


def test_links(frame):
    docs = frame(
        "project string, rel_path string, content string",
        ("p", "docs/a.md", "# Top Part!\n[1](b.md) [2](./gone.md) [3](#top-part) [4](#no) [5](../src/x.ts) [6](http://e.com/q) [7](b.md#it) [8](/docs/b.md) [9](../src) [10](mailto:x@y.z) ![11](i.png)"),
        ("p", "docs/b.md", "## Other"),
    )
    files = frame("project string, path string", ("p", "src/x.ts"), ("q", "docs/gone.md"))
    rows = {r["link"]: r["problem"] for r in scans.broken_links(docs, files).collect()}
    assert rows == {"./gone.md": "missing file", "#no": "missing heading", "b.md#it": "missing heading", "i.png": "missing file"}


def test_markers(frame):
    text = "// TODO x\n// TODO 2020-01-01 x\n// FIXME 2024-08-01\n// TODO(ann) y\n// TODO #12\n// TODOS\n// FIXME 2020-99-99"
    rows = scans.debt_markers(frame(TEXTS, ("p", "a", text)), "2024-09-01").collect()
    assert [(r["line"], r["problem"]) for r in rows] == [(1, "untracked"), (2, "old"), (7, "untracked")]


def test_runtime_priority(frame):
    files = frame("project string, path string", ("p", "go.mod"), ("p", "package.json"), ("q", "sub/go.mod"), ("r", "build.gradle.kts"))
    assert {r["project"]: r["runtime"] for r in scans.detect_runtime(files).collect()} == {"p": "node", "q": "generic", "r": "java"}


def test_matrix(frame):
    edges = frame("src string, dst string, purpose string", ("ui/a", "db/b", "reads"), ("ui/a", "db/c", "reads"), ("ui/b", "db/c", "asks"), ("x", "ui/a", "calls"))
    rows = {r["caller"]: r.asDict() for r in scans.call_matrix(edges, [("ui", "^ui/"), ("db", "^db/")]).collect()}
    assert rows["ui"]["db"] == "asks, reads" and rows["ui"]["ui"] == "" and rows["other"]["ui"] == "calls"


def plain_merge(edges, limit):
    names = {n: n for e in edges for n in e[:2]}
    while len(set(names.values())) > limit:
        calls, weight = {}, {}
        for a, b, _ in edges:
            a, b = names[a], names[b]
            for x, y in {(a, b), (b, a)}:
                calls[x, y] = calls.get((x, y), 0) + 1
                weight[x] = weight.get(x, 0) + 1
        top = min(weight, key=lambda n: (-weight[n], n))
        light = sorted(weight, key=lambda n: (weight[n], n))[: len(weight) - limit]
        group = {n: n for n in weight}
        for n in light:
            near = [(-c, y) for (x, y), c in calls.items() if x == n and y != n]
            other = min(near)[1] if near else top
            if other != n:
                old, new = group[n], group[other]
                group = {m: new if g == old else g for m, g in group.items()}
        head = {g: min((m for m in group if group[m] == g), key=lambda m: (-weight[m], m)) for g in group.values()}
        names = {n: head[group[m]] for n, m in names.items()}
    return names


@pytest.mark.parametrize("limit", [1, 4, 12])
def test_components_merge_until_a_matrix_is_readable(frame, limit):
    rng = random.Random(limit)
    nodes = [f"c{i:02d}" for i in range(30)]
    edges = [(rng.choice(nodes), rng.choice(nodes[:12]), rng.choice(["reads", "asks"])) for _ in range(70)] + [("lone", "lone", "calls")]
    names, calls = scans.merge_components(frame("caller string, callee string, purpose string", *edges), limit)
    wanted = plain_merge(edges, limit)
    assert dict(map(tuple, names.collect())) == wanted
    told = {(r["caller"], r["callee"]): (r["calls"], r["purposes"]) for r in calls.collect()}
    between = {}
    for a, b, p in edges:
        between.setdefault((wanted[a], wanted[b]), []).append(p)
    assert told == {k: (len(v), ", ".join(sorted(set(v)))) for k, v in between.items()}

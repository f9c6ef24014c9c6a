"""Tables of audit findings: parsing, baselines, roll-ups, evidence checks, sessions.

A finding row is ``session, audit, component, check_id, check, status, severity, confidence,
evidence, solution, fixed``; operators use the columns they need and pass the others on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions.globs import directory_prefixes
from ..functions.text import extension, let, parent_dir, trim_space

# Statuses, the severity marks and the types of baseline entries.
STATUSES = ("PASS", "FAIL", "ACCEPTED", "UNVERIFIED")
SEVERITY_MARKS = {"🔴": "critical", "🟠": "high", "🟡": "medium", "🟢": "low"}
BASELINE_TYPES = ("accepted-risk", "false-positive", "intentional-design")

# Session age in days after which it counts as stale, sessions kept.
STALE_DAYS = 30
SESSIONS_KEPT = 2

# Extensions of source files in the coverage check.
SOURCE_EXTENSIONS = (".ts", ".js", ".py")

# Audits with the prefix of their check ids and how many checks each has.
CHECKS = {
    "audit-secrets": ("SEC", 7),
    "audit-owasp": ("OWA", 9),
    "audit-validation": ("VAL", 8),
    "audit-errors": ("ERR", 9),
    "audit-logging": ("LOG", 8),
    "audit-performance": ("PER", 8),
    "audit-architecture": ("ARC", 7),
    "audit-concurrency": ("CON", 6),
    "audit-naming": ("NAM", 7),
    "audit-yagni": ("YAGNI", 5),
    "audit-reinvention": ("REINV", 4),
    "audit-docs": ("DOC", 6),
    "audit-bugs": ("BUG", 10),
    "audit-tests": ("TST", 9),
    "audit-deployment": ("DEP", 12),
    "audit-api-contracts": ("API", 7),
}

_LOCATION = r"([^\s:`|]+):(\d+)"


def parse_findings(reports: DataFrame) -> DataFrame:
    """Findings from the tables of Markdown reports (``session, audit, component, content``).

    The header row of the table gives the place of each column, so reports with and without
    a confidence column are read alike. Status and severity come from one cell.
    """
    columns = {
        "check_id": "Check ID",
        "check": "Check",
        "mark": "Status",
        "confidence": "Confidence",
        "evidence": "Evidence",
        "solution": "Solution",
        "fixed": "Fixed",
    }

    def typed(rows: Column) -> Column:
        header = F.get(F.filter(rows, lambda r: F.get(r, F.lit(0)) == "Check ID"), F.lit(0))

        def cell(row: Column, title: str) -> Column:
            return F.nullif(F.get(row, F.array_position(header, title).cast("int") - 1), F.lit("—"))

        body = F.filter(rows, lambda r: header.isNotNull() & F.get(r, F.lit(0)).rlike(r"^[A-Z]+-\d+$"))
        return F.transform(body, lambda r: F.struct(*[cell(r, t).alias(n) for n, t in columns.items()]))

    found = reports.select("session", "audit", "component", F.inline(let(md.table_rows(F.col("content")), typed)))
    severity = F.lit(None).cast("string")
    for mark, name in SEVERITY_MARKS.items():
        severity = F.when(F.col("mark").contains(mark), F.lit(name)).otherwise(severity)
    return found.select(
        "session",
        "audit",
        "component",
        "check_id",
        "check",
        F.regexp_extract("mark", "(" + "|".join(STATUSES) + ")", 1).alias("status"),
        severity.alias("severity"),
        "confidence",
        F.translate("evidence", "`", "").alias("evidence"),
        "solution",
        F.coalesce(F.col("fixed").contains("Yes"), F.lit(False)).alias("fixed"),
    )


def _entry(columns) -> Column:
    """The entry that counts when several cover the same finding: open-ended first, then the latest."""
    until = F.coalesce("expires", F.lit("9999-12-31").cast("date"))
    return F.max(F.struct(until.alias("until"), *columns)).alias("entry")


def apply_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings a baseline entry covers become ``ACCEPTED``; adds ``expires`` and ``baseline_type``.

    An entry without a file covers every finding of its check, one with a file that file
    only, and then counts first. The baseline is reduced to one entry per check and per check
    and file before two lookups, so no finding is multiplied.
    """
    kept = [F.col("type"), F.col("expires")]
    by_check = baseline.where("file IS NULL").groupBy("check_id").agg(_entry(kept)).withColumnRenamed("entry", "_any")
    by_file = (
        baseline.where("file IS NOT NULL").groupBy("check_id", "file").agg(_entry(kept)).withColumnRenamed("entry", "_one")
    )
    joined = findings.join(by_file, ["check_id", "file"], "left").join(by_check, "check_id", "left")
    entry = F.coalesce("_one", "_any")
    return joined.select(
        *[c for c in findings.columns if c != "status"],
        F.when(entry.isNotNull(), F.lit("ACCEPTED")).otherwise(F.col("status")).alias("status"),
        entry["expires"].alias("expires"),
        entry["type"].alias("baseline_type"),
    )


def expire_baseline(accepted: DataFrame, as_of: str) -> DataFrame:
    """Accepted findings whose entry has expired fail again with high severity and a note."""
    expired = (F.col("status") == "ACCEPTED") & (F.col("expires") < F.lit(as_of).cast("date"))
    expired = F.coalesce(expired, F.lit(False))
    note = F.concat(F.lit("[baseline expired: "), F.col("expires").cast("string"), F.lit("]"))
    return (
        accepted.withColumn("_expired", expired)
        .withColumn("status", F.when(F.col("_expired"), F.lit("FAIL")).otherwise(F.col("status")))
        .withColumn("severity", F.when(F.col("_expired"), F.lit("high")).otherwise(F.col("severity")))
        .withColumn("note", F.when(F.col("_expired"), note))
        .drop("_expired")
    )


def baseline_calendar(baseline: DataFrame, until) -> DataFrame:
    """``project, check_id, file, month, periods, ended``: what a baseline accepts, month by month.

    ``baseline`` has ``project, check_id, file, since, expires``; an entry holds from ``since`` to
    ``expires``, both included, or for good. Periods of one key that overlap or touch are merged; a month
    lists those that reach into it, which being disjoint are few, and the last one that ended before it.
    Months run from a key's first entry to the month of ``until``, a date.
    """
    key = ["project", "check_id", "file"]
    entries = baseline.select(*key, "since", F.coalesce("expires", F.lit("9999-12-31").cast("date")).alias("expires")).where("since <= expires")
    order = Window.partitionBy(*key).orderBy("since", "expires")
    before = F.max("expires").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.when(before.isNull() | (F.date_add(before, 1) < F.col("since")), 1).otherwise(0)
    runs = entries.distinct().withColumn("apart", apart).withColumn("run", F.sum("apart").over(order))
    merged = runs.groupBy(*key, "run").agg(F.min("since").alias("since"), F.max("expires").alias("expires"))
    last = F.lit(until).cast("date")
    merged = merged.where(F.col("since") <= last)
    month, step = F.trunc("since", "month"), F.expr("interval 1 month")
    within = merged.select(*key, F.struct("since", "expires").alias("period"), F.explode(F.sequence(month, F.trunc(F.least("expires", last), "month"), step)).alias("month"))
    listed = within.groupBy(*key, "month").agg(F.array_sort(F.collect_list("period")).alias("periods"))
    span = merged.groupBy(*key).agg(F.min("since").alias("since"))
    months = span.select(*key, F.explode(F.sequence(month, F.trunc(last, "month"), step)).alias("month"))
    listed = listed.withColumnsRenamed({c: f"_{c}" for c in [*key, "month"]})
    here = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*key, "month"]])
    full = months.join(listed, here, "left").select(*key, "month", "periods")
    past = Window.partitionBy(*key).orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.max(F.array_max(F.transform("periods", lambda p: p["expires"]))).over(past)
    # a period may end in its own month only, so the last end before a month is in a month before it
    return full.select(*key, "month", F.coalesce("periods", F.array()).alias("periods"), F.when(ended < F.col("month"), ended).alias("ended"))


def session_status(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings with the ``status`` and ``note`` they have on the day of their own session.

    A failure that an entry of its project and check covers that day, for its file or for all, is
    ``ACCEPTED``; one whose last such entry has ended is a failure of high severity with a note; others
    stay. ``findings`` have ``project, session, check_id, file, status, severity``. A finding meets at
    most two rows, the calendars of its month, so nothing is multiplied however many entries there are.
    """
    horizon = findings.agg(F.max("session")).first()[0]
    if horizon is None:
        return findings.withColumn("note", F.lit(None).cast("string"))
    calendar = baseline_calendar(baseline, horizon)
    one = calendar.where("file IS NOT NULL").withColumnsRenamed({"periods": "_one", "ended": "_one_ended"})
    every = calendar.where("file IS NULL").drop("file").withColumnsRenamed({"periods": "_any", "ended": "_any_ended"})
    dated = findings.withColumn("month", F.trunc("session", "month"))
    joined = dated.join(one, ["project", "check_id", "file", "month"], "left").join(every, ["project", "check_id", "month"], "left")
    day = F.col("session")

    def holds(periods: str) -> Column:
        return F.coalesce(F.exists(periods, lambda p: day.between(p["since"], p["expires"])), F.lit(False))

    def gone(periods: str, ended: str) -> Column:
        here = F.array_max(F.transform(F.filter(periods, lambda p: p["expires"] < day), lambda p: p["expires"]))
        return F.greatest(here, F.col(ended))

    failed, valid = F.col("status") == "FAIL", holds("_one") | holds("_any")
    over = F.greatest(gone("_one", "_one_ended"), gone("_any", "_any_ended"))
    state = F.when(failed & valid, "accepted").when(failed & over.isNotNull(), "expired").otherwise("same")
    marked = joined.withColumns({"_state": state, "_over": over})
    return marked.select(
        *[c for c in findings.columns if c not in ("status", "severity")],
        F.when(F.col("_state") == "accepted", "ACCEPTED").otherwise(F.col("status")).alias("status"),
        F.when(F.col("_state") == "expired", "high").otherwise(F.col("severity")).alias("severity"),
        F.when(F.col("_state") == "expired", F.concat(F.lit("[baseline expired: "), F.col("_over").cast("string"), F.lit("]"))).alias("note"),
    )


def expired_entries(baseline: DataFrame, as_of: str) -> DataFrame:
    """Baseline entries whose date has passed."""
    return baseline.where(F.col("expires") < F.lit(as_of).cast("date"))


def untyped_baseline(baseline: DataFrame) -> DataFrame:
    """Entries without one of the three types, with the type their reason suggests."""
    reason = F.lower(F.coalesce("reason", F.lit("")))
    recommended = (
        F.when(reason.contains("false") | reason.contains("not real"), "false-positive")
        .when(reason.contains("intentional") | reason.contains("design"), "intentional-design")
        .otherwise("accepted-risk")
    )
    untyped = ~F.coalesce(F.col("type").isin(*BASELINE_TYPES), F.lit(False))
    return baseline.where(untyped).select("check_id", "file", "reason", recommended.alias("recommended_type"))


def component_summary(findings: DataFrame) -> DataFrame:
    """Failures by severity, accepted findings and all failures per component, with a TOTAL row."""
    failed = F.col("status") == "FAIL"
    counted = findings.rollup("component").agg(
        F.count_if(failed & (F.col("severity") == "critical")).alias("critical"),
        F.count_if(failed & (F.col("severity") == "high")).alias("high"),
        F.count_if(failed & F.col("severity").isin("medium", "low")).alias("medium_low"),
        F.count_if(F.col("status") == "ACCEPTED").alias("accepted"),
        F.count_if(failed).alias("total_fail"),
        F.grouping("component").alias("_all"),
    )
    name = F.when(F.col("_all") == 1, F.lit("TOTAL")).otherwise(F.col("component"))
    return counted.withColumn("component", name).drop("_all")


def critical_breakdown(findings: DataFrame) -> DataFrame:
    """Critical failures with place, evidence and the first of their solutions."""
    first = F.get(F.split("solution", r"\\\\"), F.lit(0))
    return findings.where("status = 'FAIL' AND severity = 'critical'").select(
        "component", "check_id", "check", "evidence", trim_space(F.regexp_replace(first, r"\*\*", "")).alias("resolution")
    )


def evidence_path(evidence: Column) -> Column:
    """The file an evidence text names, without its line."""
    return F.regexp_extract(evidence, r"([^\s:`|]+)", 1)


def uncovered_modules(files: DataFrame, findings: DataFrame, root: str = "src") -> DataFrame:
    """``project, directory``: source directories no finding of their project refers to, directly or
    through a directory below."""
    sources = files.where(F.col("path").startswith(f"{root}/") & extension(F.col("path")).isin(*SOURCE_EXTENSIONS))
    directories = sources.select("project", F.concat(parent_dir(F.col("path")), F.lit("/")).alias("directory")).distinct()
    mentioned = findings.select("project", F.explode(directory_prefixes(evidence_path(F.col("evidence")))).alias("directory")).distinct()
    return directories.join(mentioned, ["project", "directory"], "left_anti")


def weak_evidence(findings: DataFrame) -> DataFrame:
    """Failures whose evidence names no line, with the reason."""
    problem = F.when(
        F.coalesce(trim_space(F.col("evidence")), F.lit("")).isin("", "—"), F.lit("no evidence")
    ).otherwise(F.lit("no line, only a file name"))
    weak = (F.col("status") == "FAIL") & ~F.coalesce(F.col("evidence").rlike(r"[^\s:]+:\d+"), F.lit(False))
    return findings.where(weak).withColumn("problem", problem)


def _evidence_line() -> Column:
    return F.nullif(F.regexp_extract("evidence", _LOCATION, 2), F.lit("")).cast("bigint")


def verify_findings(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``verdict``: ``confirmed``, ``false positive`` without that line, ``stale`` without the file.

    A finding is held against the files of its own project. Only line counts leave the files, not
    their content.
    """
    counted = files.select(
        "project", F.col("path").alias("_path"), F.size(F.split("content", "\n", -1)).cast("bigint").alias("_lines")
    ).groupBy("project", "_path").agg(F.max("_lines").alias("_lines"))
    located = findings.withColumn("_path", evidence_path(F.col("evidence"))).withColumn("_line", _evidence_line())
    verdict = (
        F.when(F.col("_lines").isNull(), "stale")
        .when(F.col("_line").isNull() | F.col("_line").between(1, F.col("_lines")), "confirmed")
        .otherwise("false positive")
    )
    return located.join(counted, ["project", "_path"], "left").withColumn("verdict", verdict).drop("_path", "_line", "_lines")


def missed_findings(verified: DataFrame, hits: DataFrame) -> DataFrame:
    """``project, audit, check_id, path, line, pattern, found_from, verdict``: what confirmed critical
    findings lead to, with verdict ``missed``.

    ``hits`` are matches of ``scans.scan_patterns``. A confirmed critical failure whose evidence names
    the line of a match stands for that pattern; matches of the pattern in files of the same directory
    that no finding of the project names are missed, once per audit and check, from the first such
    finding. Both sides are reduced to one row per directory and pattern, or per match, before they
    meet, so a directory with many findings multiplies nothing.
    """
    spots = hits.select("project", "path", "line", "pattern").distinct()
    named = verified.select("project", "audit", "check_id", "status", "severity", "verdict", evidence_path(F.col("evidence")).alias("path"), _evidence_line().alias("line"))
    critical = named.where("verdict = 'confirmed' AND status = 'FAIL' AND severity = 'critical' AND line IS NOT NULL")
    traced = critical.join(spots, ["project", "path", "line"]).groupBy("project", parent_dir(F.col("path")).alias("folder"), "pattern", "audit", "check_id")
    sources = traced.agg(F.min(F.struct("path", "line")).alias("s")).select("project", "folder", "pattern", "audit", "check_id", F.concat("s.path", F.lit(":"), "s.line").alias("found_from"))
    known = named.where("line IS NOT NULL").select("project", "path", "line").distinct()
    open_spots = spots.join(known, ["project", "path", "line"], "left_anti").withColumn("folder", parent_dir(F.col("path")))
    found = open_spots.join(sources, ["project", "folder", "pattern"])
    return found.select("project", "audit", "check_id", "path", "line", "pattern", "found_from", F.lit("missed").alias("verdict"))


def stale_sessions(sessions: DataFrame, as_of: str, days: int = STALE_DAYS) -> DataFrame:
    """Sessions older than ``days``, with their age."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("session")).cast("bigint")
    return sessions.withColumn("age_days", age).where(F.col("age_days") > days)


def latest_session(sessions: DataFrame) -> DataFrame:
    """Newest session of each project."""
    return sessions.groupBy("project").agg(F.max("session").alias("session"))


def keep_newest(sessions: DataFrame, count: int = SESSIONS_KEPT) -> DataFrame:
    """The newest sessions of each project.

    A rank limit is applied within each input partition before the shuffle, so a project with
    very many sessions sends only a few rows.
    """
    rank = F.row_number().over(Window.partitionBy("project").orderBy(F.col("session").desc()))
    return sessions.distinct().withColumn("_rank", rank).where(F.col("_rank") <= count).drop("_rank")


def merge_reports(*reports: DataFrame) -> DataFrame:
    """Failures and accepted findings of all reports."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reports)
    return merged.where(F.col("status").isin("FAIL", "ACCEPTED"))


# A row of a finding in a report, and its cells: the text between the bars.
_ROW = r"^\s*\|\s*[A-Z]+-\d+\s*\|"
_CELL = r"(?<!\\)\|"


def report_rows(reports: DataFrame, *keys: str) -> DataFrame:
    """``*keys, line, check_id, status, evidence``: the finding rows of Markdown reports (``content``) by
    the number of their line, from 0; the header above gives the places of the columns."""
    lines = F.split("content", "\n", -1)

    def cells(line: Column) -> Column:
        return F.transform(F.split(line, _CELL, -1), trim_space)

    header = F.array_max(F.transform(F.filter(lines, lambda t: t.contains("Check ID")), cells))
    numbered = F.filter(F.transform(lines, lambda t, i: F.struct(i.alias("line"), t.alias("text"))), lambda x: x["text"].rlike(_ROW))
    found = reports.select(*keys, header.alias("header"), F.inline(numbered)).withColumn("cells", cells(F.col("text")))

    def cell(title: str) -> Column:
        return F.get("cells", F.array_position("header", F.lit(title)).cast("int") - 1)

    status = F.regexp_extract(cell("Status"), "(" + "|".join(STATUSES) + ")", 1)
    return found.select(*keys, "line", cell("Check ID").alias("check_id"), status.alias("status"), F.translate(cell("Evidence"), "`", "").alias("evidence"))


def rewrite_reports(reports: DataFrame, verdicts: DataFrame, additions: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Reports spliced after verification, and the log of what was removed.

    ``verdicts`` has ``*keys, line, verdict, evidence`` and ``note``: rows that are ``false positive``
    or ``stale`` without their file (``gone``) go, ``stale`` ones are marked in their status cell, and
    those with a ``note`` fail again with it. ``additions`` has ``*keys, row``: whole table rows put below
    the last finding, or at the end of a report without any. All other text stays byte for byte;
    reports without a change are left out. Verdicts and additions are gathered per report.
    """
    acts = verdicts.where("verdict IN ('false positive', 'gone', 'stale') OR note IS NOT NULL")
    by_report = acts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("line", F.struct("verdict", "note")))).alias("_acts"))
    added = additions.groupBy(*keys).agg(F.array_sort(F.collect_list("row")).alias("_added"))
    joined = reports
    for side in (by_report, added):
        side = side.withColumnsRenamed({k: f"_{k}" for k in keys})
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        joined = joined.join(side, same, "left").drop(*[f"_{k}" for k in keys])
    lines = F.split("content", "\n", -1)
    none = F.array().cast("array<string>")

    def spliced(line: Column, act: Column, status: Column) -> Column:
        def marked(parts: Column) -> Column:
            stale = F.concat(F.regexp_replace(F.get(parts, status), r"\s+$", ""), F.lit(" [✓ stale] "))
            failed = F.concat(F.lit(" ❌ FAIL 🟠 "), act["note"], F.lit(" "))
            cells = (F.slice(parts, 1, status), F.array(F.coalesce(failed, stale)), F.slice(parts, status + 2, F.size(parts)))
            return F.array(F.array_join(F.concat(*cells), "|"))

        return F.when(act.isNull(), F.array(line)).when(act["verdict"].isin("false positive", "gone"), none).otherwise(let(F.split(line, _CELL, -1), marked))

    def rewritten(given: Column) -> Column:
        last = F.array_max(F.transform(given["lines"], lambda t, i: F.when(t.rlike(_ROW), i).otherwise(-1)))
        place = F.when(last < 0, F.size(given["lines"]) - 1).otherwise(last)
        head = F.array_max(F.filter(given["lines"], lambda t: t.contains("Check ID")))
        status = F.array_position(F.transform(F.split(head, _CELL, -1), trim_space), F.lit("Status")).cast("int") - 1

        def joined_lines(known: Column) -> Column:
            def line_of(t: Column, i: Column) -> Column:
                more = F.when(i == known["place"], F.coalesce(given["added"], none)).otherwise(none)
                return F.concat(spliced(t, given["acts"][i], known["status"]), more)

            return F.array_join(F.flatten(F.transform(given["lines"], line_of)), "\n")

        return let(F.struct(place.alias("place"), status.alias("status")), joined_lines)

    kept = let(F.struct(lines.alias("lines"), F.col("_acts").alias("acts"), F.col("_added").alias("added")), rewritten)
    changed = joined.where("_acts IS NOT NULL OR _added IS NOT NULL").select(*[c for c in reports.columns if c != "content"], kept.alias("content"))
    reason = F.when(F.col("verdict") == "gone", F.concat(F.lit("[removed: "), evidence_path(F.col("evidence")), F.lit(" not found]"))).otherwise(F.lit("[removed: false positive]"))
    log = verdicts.where("verdict IN ('false positive', 'gone')").select(*keys, "line", "check_id", reason.alias("reason"))
    return changed, log


def verification_totals(verified: DataFrame, by: str = "component") -> DataFrame:
    """Verdicts per report with a TOTAL row."""
    verdict = F.col("verdict")
    counted = verified.rollup(by).agg(
        F.count_if(verdict == "confirmed").alias("confirmed"),
        F.count_if(verdict == "false positive").alias("false_positive"),
        F.count_if(verdict == "stale").alias("stale"),
        F.count_if(verdict == "missed").alias("missed"),
        F.grouping(by).alias("_all"),
    )
    return counted.withColumn(by, F.when(F.col("_all") == 1, F.lit("TOTAL")).otherwise(F.col(by))).drop("_all")


def checks_catalog(spark: SparkSession) -> DataFrame:
    """``audit, check_id`` of every known check."""
    rows = [(audit, f"{prefix}-{n:02d}") for audit, (prefix, count) in CHECKS.items() for n in range(1, count + 1)]
    return spark.createDataFrame(rows, "audit string, check_id string")


def catalog_coverage(findings: DataFrame) -> DataFrame:
    """Checked and unchecked findings of every catalogued check; never reported ones count zero."""
    counts = findings.groupBy("check_id").agg(
        F.count_if(F.col("status") != "UNVERIFIED").alias("checked"),
        F.count_if(F.col("status") == "UNVERIFIED").alias("not_checked"),
    )
    catalog = checks_catalog(findings.sparkSession)
    return catalog.join(counts, "check_id", "left").fillna(0, ["checked", "not_checked"])

"""Checks of technical contracts: required files, schema and API blocks, cross-checks between them.

Input is ``docs(project, rel_path, content)``. Errors fail a project, warnings do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions.text import NOT_AFTER_WORD, NOT_BEFORE_WORD, WORD, let, split_lines, trim_space

DATABASE = "DATABASE_MODEL.md"
API = "API_CONTRACTS.md"
ARCHITECTURE = "ARCHITECTURE.md"
GUIDE = "IMPLEMENTATION_GUIDE.md"

# Required files and the patterns of the checks.
REQUIRED_FILES = (GUIDE, DATABASE, API, ARCHITECTURE, "TESTING_PLAN.md")
LAYER_PATH = r"src/(?:entities|features|widgets|pages|shared|app)/|app/(?:entities|features|widgets|pages|shared)/"
MODEL = rf"model\s+({WORD}+)\s*\{{((?s:.)*?)\n\}}"
ROOT_TYPE = rf"^type\s+(Query|Mutation|Subscription){NOT_BEFORE_WORD}"
LIST_TYPE = rf":\s*\[{WORD}"
PAGING = rf"(?i){NOT_AFTER_WORD}(?:first|after|limit|offset|page|cursor){NOT_BEFORE_WORD}"
REQUIREMENT_DOC = r"SPEC\.md|VISION\.md"
GUIDE_SECTIONS = {
    "Stack": rf"(?mid)^#{{1,3}}\s*stack{NOT_BEFORE_WORD}",
    "Already Implemented": r"(?mid)^#{1,3}\s*(?:already implemented|what.s already)",
    "Local Setup": r"(?mid)^#{1,3}\s*(?:local (?:setup|run|start)|getting started|quick start)",
}
MIGRATION_SECTION = r"(?mid)^#{1,3}\s*(?:migration plan|db changes|database changes)"
LOOK_BACK = 8
MODEL_COVERAGE = 0.5

# Column names of the texts once they share a row.
TEXT_COLUMNS = {GUIDE: "guide", DATABASE: "database", API: "api", ARCHITECTURE: "architecture", "TESTING_PLAN.md": "testing"}


def _content() -> Column:
    return F.col("content")


def _only(docs: DataFrame, *names: str) -> DataFrame:
    return docs.where(F.col("rel_path").isin(*names))


def missing_files(docs: DataFrame) -> DataFrame:
    """``project, rel_path`` of required files that are not there."""
    flags = [F.bool_or(F.col("rel_path") == p) for p in REQUIRED_FILES]
    absent = F.array_compact(F.array(*[F.when(~flag, F.lit(p)) for flag, p in zip(flags, REQUIRED_FILES)]))
    return docs.groupBy("project").agg(absent.alias("absent")).select("project", F.explode("absent").alias("rel_path"))


def code_blocks(docs: DataFrame) -> DataFrame:
    """``project, rel_path, language, body`` of the schema and the API block; an empty body is an error."""
    language = F.when(F.col("rel_path") == DATABASE, "prisma").otherwise("graphql")
    body = F.when(F.col("rel_path") == DATABASE, md.code_block(_content(), "prisma")).otherwise(
        md.code_block(_content(), "graphql")
    )
    return _only(docs, DATABASE, API).select("project", "rel_path", language.alias("language"), body.alias("body"))


def missing_blocks(docs: DataFrame) -> DataFrame:
    return code_blocks(docs).where("body = ''").select("project", "rel_path", "language")


def layer_paths(docs: DataFrame) -> DataFrame:
    """Projects whose architecture document names layered source paths."""
    return _only(docs, ARCHITECTURE).where(_content().rlike(LAYER_PATH)).select("project", "rel_path")


def _models(database: Column) -> Column:
    """Array of ``struct(model, body)``; a repeated name keeps its last body."""
    found = let(
        md.code_block(database, "prisma"),
        lambda b: F.arrays_zip(
            F.regexp_extract_all(b, F.lit(MODEL), F.lit(1)).alias("model"),
            F.regexp_extract_all(b, F.lit(MODEL), F.lit(2)).alias("body"),
        ),
    )
    return let(
        found,
        lambda ms: F.filter(
            ms, lambda m, i: ~F.exists(F.slice(ms, i + 2, F.size(ms)), lambda later: later["model"] == m["model"])
        ),
    )


def models(docs: DataFrame) -> DataFrame:
    """``project, model, body`` of the schema block."""
    return _only(docs, DATABASE).select("project", F.inline(_models(_content())))


def _texts(docs: DataFrame) -> DataFrame:
    """One row per project with the texts of its required files, null where one is missing."""
    return docs.groupBy("project").agg(
        *[F.max(F.when(F.col("rel_path") == p, _content())).alias(c) for p, c in TEXT_COLUMNS.items()]
    )


def _weak_coverage(database: Column, api: Column, minimum: float) -> Column:
    """One ``struct(covered, total, missing)`` when too few models are mentioned, else none."""
    names = let(
        md.code_block(database, "prisma"),
        lambda b: F.array_distinct(F.regexp_extract_all(b, F.lit(MODEL), F.lit(1))),
    )

    def measured(n: Column) -> Column:
        total = F.size(n["names"]).cast("bigint")
        absent = F.filter(n["names"], lambda name: ~F.contains(n["api"], F.lower(name)))
        return let(
            absent,
            lambda gone: F.struct(
                (total - F.size(gone)).cast("bigint").alias("covered"),
                total.alias("total"),
                F.array_join(gone, ", ").alias("missing"),
            ),
        )

    found = let(F.struct(names.alias("names"), F.lower(api).alias("api")), measured)
    return F.filter(F.array(found), lambda c: (c["total"] > 0) & (c["covered"] / c["total"] < minimum))


def model_coverage(docs: DataFrame, minimum: float = MODEL_COVERAGE) -> DataFrame:
    """Projects whose API document mentions less than half of the schema's models."""
    both = _texts(_only(docs, DATABASE, API)).where("database IS NOT NULL AND api IS NOT NULL")
    return both.select("project", F.inline(_weak_coverage(F.col("database"), F.col("api"), minimum)))


def traceability(docs: DataFrame) -> DataFrame:
    """Schema and API documents without a reference to a requirement document."""
    return _only(docs, DATABASE, API).where(~_content().rlike(REQUIREMENT_DOC)).select("project", "rel_path")


def _unpaged(api: Column) -> Column:
    """Array of ``struct(line, root_type, field)``, found by one walk over the lines of the API block.

    A root type lasts while its brace depth stays above zero, so one that opens its brace on a
    later line is left at once. The walk carries only the depth, the type and the findings.
    """

    def step(lines: Column, acc: Column, i: Column) -> Column:
        line = trim_space(F.get(lines, i))
        return let(
            F.struct(line.alias("text"), F.regexp_extract(line, ROOT_TYPE, 1).alias("opened")),
            lambda s: let(
                F.when(s["opened"] != "", F.lit(0)).otherwise(acc["depth"])
                + F.regexp_count(s["text"], F.lit(r"\{"))
                - F.regexp_count(s["text"], F.lit(r"\}")),
                lambda depth: let(
                    F.when(depth > 0, F.coalesce(F.nullif(s["opened"], F.lit("")), acc["root_type"])),
                    lambda root: F.struct(
                        depth.alias("depth"),
                        root.alias("root_type"),
                        F.when(
                            root.isNotNull()
                            & s["text"].rlike(LIST_TYPE)
                            & ~F.exists(
                                F.slice(lines, F.greatest(i - (LOOK_BACK - 1), F.lit(1)), F.least(i, F.lit(LOOK_BACK)) + 1),
                                lambda near: near.rlike(PAGING),
                            ),
                            F.concat(
                                acc["found"],
                                F.array(
                                    F.struct(
                                        (i + 1).cast("bigint").alias("line"),
                                        root.alias("root_type"),
                                        F.when(
                                            s["text"].rlike(rf"{WORD}+\s*[(:]"),
                                            F.regexp_extract(s["text"], rf"({WORD}+)\s*[(:]", 1),
                                        )
                                        .otherwise(s["text"])
                                        .alias("field"),
                                    )
                                ),
                            ),
                        )
                        .otherwise(acc["found"])
                        .alias("found"),
                    ),
                ),
            ),
        )

    start = F.struct(
        F.lit(0).alias("depth"),
        F.lit(None).cast("string").alias("root_type"),
        F.array().cast("array<struct<line: bigint, root_type: string, field: string>>").alias("found"),
    )
    return let(
        split_lines(md.code_block(api, "graphql")),
        lambda lines: F.aggregate(
            F.transform(lines, lambda _, i: i), start, lambda acc, i: step(lines, acc, i), lambda acc: acc["found"]
        ),
    )


def list_fields_without_paging(docs: DataFrame) -> DataFrame:
    """``project, line, root_type, field``: list fields of root operations without paging words.

    The words are looked for in the line and the eight lines before it.
    """
    return _only(docs, API).where(_content().rlike(LIST_TYPE)).select("project", F.inline(_unpaged(_content())))


def _timeless(database: Column) -> Column:
    found = F.filter(
        _models(database),
        lambda m: ~m["model"].contains("_") & ~m["body"].contains("createdAt") & ~m["body"].contains("updatedAt"),
    )
    return F.transform(found, lambda m: m["model"])


def models_without_timestamps(docs: DataFrame) -> DataFrame:
    """Models, join tables aside, that have neither a creation nor an update time."""
    return _only(docs, DATABASE).select("project", F.explode(_timeless(_content())).alias("model"))


def _guide_gaps(guide: Column) -> Column:
    return F.array_compact(F.array(*[F.when(~guide.rlike(rx), F.lit(name)) for name, rx in GUIDE_SECTIONS.items()]))


def guide_sections(docs: DataFrame) -> DataFrame:
    """Sections the implementation guide lacks."""
    return _only(docs, GUIDE).select("project", F.explode(_guide_gaps(_content())).alias("section"))


def migration_section(docs: DataFrame, update_mode: bool = True) -> DataFrame:
    """Schema documents without a migration section; only looked at in update mode."""
    chosen = _only(docs, DATABASE).where(F.lit(update_mode) & ~_content().rlike(MIGRATION_SECTION))
    return chosen.select("project", "rel_path")


def _checked(docs: DataFrame, update_mode: bool) -> DataFrame:
    """``project, issues`` for every project; its texts meet in one row, so they are shuffled once."""
    guide, database, api, architecture = (F.col(c) for c in ("guide", "database", "api", "architecture"))

    def issues(check: str, details: Column, severity: str = "error") -> Column:
        return F.transform(
            details,
            lambda d: F.struct(F.lit(check).alias("check"), d.alias("detail"), F.lit(severity).alias("severity")),
        )

    def named(tests: dict) -> Column:
        return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in tests.items()]))

    absent = named({p: F.col(c).isNull() for p, c in TEXT_COLUMNS.items()})
    blocks = named(
        {
            "prisma": md.code_block(database, "prisma") == "",
            "graphql": md.code_block(api, "graphql") == "",
        }
    )
    parsed = F.concat(
        issues(
            "model coverage",
            F.transform(_weak_coverage(database, api, MODEL_COVERAGE), lambda c: c["missing"]),
        ),
        issues("paging", F.transform(_unpaged(api), lambda f: f["field"]), "warning"),
        issues("timestamps", _timeless(database)),
    )
    checks = [
        issues("layer path", named({ARCHITECTURE: architecture.rlike(LAYER_PATH)})),
        issues(
            "traceability",
            named({DATABASE: ~database.rlike(REQUIREMENT_DOC), API: ~api.rlike(REQUIREMENT_DOC)}),
        ),
        issues("guide section", _guide_gaps(guide)),
    ]
    if update_mode:
        checks.append(issues("migration section", named({DATABASE: ~database.rlike(MIGRATION_SECTION)})))
    none = F.array().cast("array<struct<check: string, detail: string, severity: string>>")
    content = let(
        blocks,
        lambda b: F.concat(issues("missing block", b), F.when(F.size(b) == 0, parsed).otherwise(none)),
    )
    found = let(
        absent,
        lambda a: F.when(F.size(a) > 0, issues("missing file", a)).otherwise(F.concat(content, *checks)),
    )
    return _texts(docs).select("project", F.explode(F.array(found)).alias("issues"))


def blueprint_issues(docs: DataFrame, update_mode: bool = False) -> DataFrame:
    """``project, check, detail, severity`` of all checks.

    A missing file stops everything else; a missing code block skips the checks that read it.
    """
    return _checked(docs, update_mode).select("project", F.inline("issues"))


def blueprint_verdict(docs: DataFrame, update_mode: bool = False) -> DataFrame:
    """``project, errors, warnings, passed`` for every project, clean ones included."""

    def count(severity: str) -> Column:
        return F.size(F.filter("issues", lambda i: i["severity"] == severity)).cast("bigint")

    counted = _checked(docs, update_mode).select(
        "project", count("error").alias("errors"), count("warning").alias("warnings")
    )
    return counted.withColumn("passed", F.col("errors") == 0)

"""Checks of product documents: structure, wording and agreement between documents.

Input is ``docs(project, rel_path, content)``, one row per document of a project. Checks
give issue rows ``project, rel_path, line, rule, detail``; ``line`` is null when a finding
concerns the whole document.

A check is an array expression over the text of one document, or over the vision and the
specification of one project. Used alone it is exploded from its document; ``validate``
puts all of them behind a single grouping by project.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions.text import (
    NOT_AFTER_WORD,
    NOT_BEFORE_WORD,
    base_name,
    let,
    literal_array,
    normalize,
    quote,
    split_lines,
    trim_space,
)

INDEX = "INDEX.md"
VISION = "1_PRODUCT_VISION/VISION.md"
SPEC = "2_PRODUCT_SPEC/SPEC.md"

# Required documents with their headings.
HEADINGS = {
    INDEX: ("## Navigation", "## Quick links"),
    VISION: (
        "## Problem", "## Target audience", "## Goal", "## Key capabilities",
        "## Success metrics", "## In scope", "## Out of scope",
    ),
    SPEC: (
        "## References", "## How the system works", "## Glossary", "## Entities", "## Pages and screens",
        "## Key operations", "## Integrations", "## Testing", "## Artifacts",
    ),
}
# Shortest section, documents it applies to, headings it does not apply to.
MIN_SECTION_CHARS = 60
LENGTH_CHECKED = (VISION, SPEC)
LENGTH_EXEMPT = ("## References", "## Navigation", "## Quick links", "## Integrations", "## Artifacts")

# Column names of the three texts once they share a row.
TEXT_COLUMNS = {INDEX: "index", VISION: "vision", SPEC: "spec"}

# Allowed statuses and the metadata lines.
STATUSES = ("draft", "in review", "approved")
STATUS_LINE = r"\*\*Status:\*\*\s*(draft|in review|approved)"
DATE_LINE = r"\*\*Date:\*\*\s*(\d{4}-\d{2}-\d{2})"

# Smallest share of keywords the specification has to mention.
CAPABILITY_COVERAGE = 0.4
SCOPE_COVERAGE = 0.35

# Header cells of tables, in both languages.
METRIC_HEADERS = ("Metric", "Метрика")
ENTITY_HEADERS = ("Entity", "Сущность")
TERM_HEADERS = ("Term", "Термин")
TEST_SUBSECTIONS = ("**Critical scenarios**", "**Business rules**", "**Negative scenarios**")

# Fixed value: bracketed text that is not a link.
PLACEHOLDER = r"\[[^\]]+\](?!\()"

# Banned words and phrases, in the order they are looked for.
BANNED = (
    "if needed", "if desired", "optionally", "maybe",
    "perhaps", "possibly", "probably", "likely",
    "при необходимости", "по желанию", "при желании", "может быть",
    "возможно", "опционально", "наверное", "вероятно",
    "fast", "quick", "speedy", "rapid",
    "convenient", "handy", "user-friendly",
    "easy", "simple", "effortless", "straightforward",
    "intuitive", "seamless", "flexible",
    "modern", "innovative", "cutting-edge",
    "best", "optimal", "efficient", "high-quality",
    "быстро", "быстрый", "быстрая", "быстрое",
    "удобно", "удобный", "удобная", "удобное",
    "легко", "легкий", "легкая", "легкое",
    "просто", "простой", "простая", "простое",
    "интуитивно", "интуитивный", "интуитивная",
    "гибко", "гибкий", "гибкая",
    "современный", "современная", "современное",
    "инновационный", "инновационная",
    "лучший", "лучшая", "лучшее",
    "оптимальный", "оптимальная", "оптимальное",
    "эффективно", "эффективный", "эффективная",
    "качественный", "качественная", "качественное",
)

ISSUE = "array<struct<line: bigint, rule: string, detail: string>>"


def _content() -> Column:
    return F.col("content")


def _issue(rule: Column | str, detail: Column, line: Column | None = None) -> Column:
    return F.struct(
        (line if line is not None else F.lit(None)).cast("bigint").alias("line"),
        (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"),
        detail.alias("detail"),
    )


def _no_issues() -> Column:
    return F.array().cast(ISSUE)


def _fold(phrase: str) -> str:
    return phrase.replace("ё", "е").replace("Ё", "Е").lower()


def _by_document(check, rel_paths=tuple(HEADINGS)) -> Column:
    """``check(content, rel_path)`` for the document at hand; no issues for other documents."""
    chosen = _no_issues()
    for rel_path in rel_paths:
        chosen = F.when(F.col("rel_path") == rel_path, check(_content(), rel_path)).otherwise(chosen)
    return chosen


def required(docs: DataFrame) -> DataFrame:
    """The rows of required documents."""
    return docs.where(F.col("rel_path").isin(*HEADINGS))


def _emit(docs: DataFrame, issues: Column) -> DataFrame:
    return docs.select("project", "rel_path", F.inline(issues))


def sections(docs: DataFrame) -> DataFrame:
    """``project, rel_path, heading, body`` of every required heading that has text."""
    by_document = F.lit(None).cast("array<struct<heading: string, body: string>>")
    for rel_path, headings in HEADINGS.items():
        bodies = F.array(
            *[F.struct(F.lit(h).alias("heading"), md.section(_content(), h).alias("body")) for h in headings]
        )
        by_document = F.when(F.col("rel_path") == rel_path, bodies).otherwise(by_document)
    found = required(docs).select("project", "rel_path", F.inline(by_document))
    return found.where("body <> ''")


def stand_block(docs: DataFrame, stand: str) -> DataFrame:
    """The block of one named stand in a runbook, heading included; empty when it is missing."""
    return docs.select("project", "rel_path", md.block_from(_content(), f"## Stand: {stand}").alias("block"))


def section_items(docs: DataFrame, heading: str, rel_path: str = VISION) -> DataFrame:
    """``project, pos, item`` of the list items below ``heading``."""
    chosen = docs.where(F.col("rel_path") == rel_path)
    return chosen.select("project", F.posexplode(md.list_items(md.section(_content(), heading))).alias("pos", "item"))


def section_cells(docs: DataFrame, heading: str, skip, rel_path: str = SPEC) -> DataFrame:
    """``project, pos, cell``: first cells of the table below ``heading``."""
    chosen = docs.where(F.col("rel_path") == rel_path)
    return chosen.select(
        "project", F.posexplode(md.first_cells(md.section(_content(), heading), skip)).alias("pos", "cell")
    )


# Checks of one document.


def _status(content: Column) -> Column:
    return F.nullif(F.regexp_extract(content, STATUS_LINE, 1), F.lit(""))


def _date(content: Column) -> Column:
    return F.nullif(F.regexp_extract(content, DATE_LINE, 1), F.lit(""))


def doc_metadata(docs: DataFrame) -> DataFrame:
    """``project, rel_path, status, date``: the first of each, null when missing."""
    return docs.select(
        "project", "rel_path", _status(_content()).alias("status"), _date(_content()).alias("date")
    )


def _metadata(content: Column, _rel_path: str) -> Column:
    return F.array_compact(
        F.array(
            F.when(_status(content).isNull(), _issue("metadata", F.lit("status"))),
            F.when(_date(content).isNull(), _issue("metadata", F.lit("date"))),
        )
    )


def metadata_issues(docs: DataFrame) -> DataFrame:
    """Required documents without a status or a date line."""
    return _emit(docs, _by_document(_metadata))


def _headings(content: Column, rel_path: str) -> Column:
    absent = let(
        F.transform(split_lines(content), trim_space),
        lambda lines: F.filter(
            literal_array(HEADINGS[rel_path]), lambda h: ~F.exists(lines, lambda line: F.startswith(line, h))
        ),
    )
    return F.transform(absent, lambda h: _issue("missing heading", h))


def missing_headings(docs: DataFrame) -> DataFrame:
    """Headings no line of a document starts with."""
    return _emit(docs, _by_document(_headings))


def missing_documents(docs: DataFrame) -> DataFrame:
    """Required documents a project lacks. One flag per document, so nothing grows with a project."""
    absent = F.array_compact(
        F.array(*[F.when(~F.bool_or(F.col("rel_path") == p), F.lit(p)) for p in HEADINGS])
    )
    found = docs.groupBy("project").agg(absent.alias("absent")).select("project", F.explode("absent").alias("rel_path"))
    return _emit(found, F.array(_issue("missing document", F.lit(""))))


def required_documents_and_headings(docs: DataFrame) -> DataFrame:
    return missing_documents(docs).unionByName(missing_headings(docs))


def _placeholders(content: Column) -> Column:
    hits = F.filter(md.numbered_lines(md.blank_fences(content)), lambda ln: ln["text"].rlike(PLACEHOLDER))
    return F.transform(hits, lambda ln: _issue("placeholder", ln["text"], ln["line"]))


def placeholders(docs: DataFrame) -> DataFrame:
    """Lines outside code fences that hold bracketed text which is not a link."""
    return _emit(docs.where(_content().contains("[")), _placeholders(_content()))


def _banned(content: Column, phrases=BANNED) -> Column:
    folded = [_fold(p) for p in phrases]
    table = F.arrays_zip(
        literal_array(phrases).alias("phrase"),
        literal_array(folded).alias("folded"),
        literal_array([f"{NOT_AFTER_WORD}{quote(f)}{NOT_BEFORE_WORD}" for f in folded]).alias("regex"),
    )
    # A substring search over the whole text leaves few phrases, mostly none, for its lines.
    present = let(normalize(content), lambda text: F.filter(table, lambda p: F.contains(text, p["folded"])))

    def hit(line: Column, p: Column) -> Column:
        whole_word = F.regexp_instr(line, p["regex"]) > 0
        return F.contains(line, p["folded"]) & (p["folded"].contains(" ") | whole_word)

    def issues(some: Column) -> Column:
        first = F.transform(
            md.numbered_lines(md.blank_fences(content)),
            lambda ln: F.struct(
                ln["line"].alias("line"),
                let(
                    normalize(ln["text"]),
                    lambda line: F.get(F.filter(some, lambda p: hit(line, p)), F.lit(0))["phrase"],
                ).alias("phrase"),
            ),
        )
        return F.transform(
            F.filter(first, lambda f: f["phrase"].isNotNull()),
            lambda f: _issue(
                F.when(f["phrase"].contains(" "), F.lit("banned phrase")).otherwise(F.lit("banned word")),
                f["phrase"],
                f["line"],
            ),
        )

    return let(present, lambda some: F.when(F.size(some) == 0, _no_issues()).otherwise(issues(some)))


def banned_words(docs: DataFrame, phrases=BANNED) -> DataFrame:
    """First banned phrase of each line outside code fences, in list order.

    Phrases of several words match as substrings, single words as whole words.
    """
    return _emit(docs, _banned(_content(), phrases))


def _short(content: Column, rel_path: str, minimum: int = MIN_SECTION_CHARS) -> Column:
    headings = [h for h in HEADINGS[rel_path] if h not in LENGTH_EXEMPT]
    bodies = F.array(
        *[F.struct(F.lit(h).alias("heading"), md.section(content, h).alias("body")) for h in headings]
    )
    short = F.filter(bodies, lambda s: (s["body"] != "") & (F.char_length(s["body"]) < minimum))
    return F.transform(
        short,
        lambda s: _issue(
            "short section", F.concat(s["heading"], F.lit(" "), F.char_length(s["body"]).cast("string"))
        ),
    )


def short_sections(docs: DataFrame, minimum: int = MIN_SECTION_CHARS) -> DataFrame:
    """Sections with text of fewer than ``minimum`` characters."""
    return _emit(docs, _by_document(lambda c, p: _short(c, p, minimum), LENGTH_CHECKED))


def _metrics(content: Column) -> Column:
    rows = F.filter(
        md.table_rows(md.section(content, "## Success metrics")),
        lambda r: ~F.get(r, F.lit(0)).isin(*METRIC_HEADERS, "")
        & ~F.coalesce(F.get(r, F.lit(1)), F.lit("")).rlike(r"\p{Nd}"),
    )
    return F.transform(rows, lambda r: _issue("metric without number", F.get(r, F.lit(0))))


def metrics_without_number(docs: DataFrame) -> DataFrame:
    """Success metrics whose target value holds no digit."""
    return _emit(docs, _by_document(lambda c, _: _metrics(c), (VISION,)))


# Checks of a vision against the specification of its project.


def _pair(docs: DataFrame) -> DataFrame:
    """``project, vision, spec`` of the projects that have both."""
    both = docs.where(F.col("rel_path").isin(VISION, SPEC)).groupBy("project").agg(
        F.max(F.when(F.col("rel_path") == VISION, _content())).alias("vision"),
        F.max(F.when(F.col("rel_path") == SPEC, _content())).alias("spec"),
    )
    return both.where("vision IS NOT NULL AND spec IS NOT NULL")


def _vision(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("rel_path") == VISION).select("project", _content().alias("vision"))


def _spec(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("rel_path") == SPEC).select("project", _content().alias("spec"))


def _items(vision: Column, heading: str) -> Column:
    """Items of a vision section with their keywords."""
    return F.transform(
        md.list_items(md.section(vision, heading)),
        lambda item: F.struct(item.alias("item"), md.keywords(item).alias("words")),
    )


def _found_in(words: Column, text: Column) -> Column:
    return F.filter(words, lambda w: F.contains(text, w))


def _enough(shared: Column, words: Column) -> Column:
    """Two shared keywords that are half of the item's."""
    return (F.size(shared) >= 2) & (F.size(shared) / F.size(words) >= 0.5)


def _distinct_words(items: Column) -> Column:
    return F.transform(items, lambda i: F.struct(i["item"].alias("item"), F.array_distinct(i["words"]).alias("words")))


def _contradictions(inside: Column, outside: Column) -> Column:
    pairs = F.flatten(
        F.transform(
            _distinct_words(outside),
            lambda out: F.transform(
                inside,
                lambda inn: F.struct(
                    inn["item"].alias("included"),
                    out["item"].alias("excluded"),
                    out["words"].alias("words"),
                    F.array_intersect(out["words"], inn["words"]).alias("shared"),
                ),
            ),
        )
    )
    return F.filter(pairs, lambda p: _enough(p["shared"], p["words"]))


def scope_contradictions(docs: DataFrame) -> DataFrame:
    """Excluded and included items that share two keywords and half of the excluded item's.

    Both lists stand in one document, so items are compared within its row and only the
    contradicting ones leave it.
    """
    vision = F.col("vision")
    found = _contradictions(_items(vision, "## In scope"), F.array(F.col("out")))
    listed = _vision(docs).select("project", "vision", F.explode(_items(vision, "## Out of scope")).alias("out"))
    return listed.select("project", F.inline(found)).select(
        "project", "included", "excluded", F.array_join(F.array_sort("shared"), ", ").alias("shared")
    )


def _scope_text(spec: Column) -> Column:
    """Normalised text of the operations and pages of a specification."""
    return normalize(
        F.concat(md.section(spec, "## Key operations"), F.lit(" "), md.section(spec, "## Pages and screens"))
    )


def _specified(outside: Column, scope: Column) -> Column:
    found = F.transform(
        outside, lambda o: F.struct(o["item"].alias("item"), _found_in(o["words"], scope).alias("found"))
    )
    return F.filter(found, lambda f: F.size(f["found"]) >= 2)


def excluded_but_specified(docs: DataFrame) -> DataFrame:
    """Excluded items with two keywords, repeats counted, in the operations or pages of the specification."""
    found = let(
        _scope_text(F.col("spec")), lambda scope: _specified(_items(F.col("vision"), "## Out of scope"), scope)
    )
    return _pair(docs).select("project", F.inline(found)).select(
        "project", F.col("item").alias("excluded"), F.array_join("found", ", ").alias("found")
    )


def _covered(items: Column, text: Column) -> Column:
    """How many keywords of each item, repeats counted, occur in a normalised text."""
    worded = F.filter(items, lambda i: F.size(i["words"]) > 0)
    return F.transform(
        worded,
        lambda i: F.struct(
            i["item"].alias("item"),
            F.size(_found_in(i["words"], text)).cast("bigint").alias("found"),
            F.size(i["words"]).cast("bigint").alias("total"),
        ),
    )


def _weak(items: Column, text: Column, minimum: float) -> Column:
    return F.filter(_covered(items, text), lambda c: c["found"] / c["total"] < minimum)


def _coverage(docs: DataFrame, heading: str, minimum: float) -> DataFrame:
    found = let(normalize(F.col("spec")), lambda text: _weak(_items(F.col("vision"), heading), text, minimum))
    return _pair(docs).select("project", F.inline(found)).withColumn("share", F.col("found") / F.col("total"))


def capability_coverage(docs: DataFrame, minimum: float = CAPABILITY_COVERAGE) -> DataFrame:
    """Capabilities of the vision that the specification hardly mentions."""
    return _coverage(docs, "## Key capabilities", minimum)


def inscope_coverage(docs: DataFrame, minimum: float = SCOPE_COVERAGE) -> DataFrame:
    """Items in scope that the specification hardly mentions."""
    return _coverage(docs, "## In scope", minimum)


def _unused_entities(spec: Column) -> Column:
    return let(
        F.struct(
            normalize(md.section(spec, "## Key operations")).alias("operations"),
            md.first_cells(md.section(spec, "## Entities"), ENTITY_HEADERS).alias("names"),
        ),
        lambda d: F.filter(d["names"], lambda n: ~F.contains(d["operations"], normalize(n))),
    )


def entities_without_operation(docs: DataFrame) -> DataFrame:
    """Entities that no key operation mentions."""
    return _spec(docs).select("project", F.explode(_unused_entities(F.col("spec"))).alias("entity"))


def _absent_subsections(spec: Column) -> Column:
    return let(
        md.section(spec, "## Testing"),
        lambda t: F.filter(literal_array(TEST_SUBSECTIONS), lambda s: ~F.contains(t, s)),
    )


def testing_subsections(docs: DataFrame) -> DataFrame:
    """Required subsections the testing section lacks."""
    return _spec(docs).select("project", F.explode(_absent_subsections(F.col("spec"))).alias("subsection"))


def _unused_terms(vision: Column, spec: Column) -> Column:
    parts = let(
        md.section(spec, "## Glossary"),
        lambda g: F.struct(
            md.first_cells(g, TERM_HEADERS).alias("terms"),
            normalize(F.when(g == "", spec).otherwise(F.replace(spec, g, F.lit("")))).alias("rest"),
            normalize(vision).alias("vision"),
        ),
    )
    return let(
        parts,
        lambda d: F.filter(
            d["terms"],
            lambda t: ~F.contains(d["rest"], normalize(t)) & ~F.contains(d["vision"], normalize(t)),
        ),
    )


def unused_glossary_terms(docs: DataFrame) -> DataFrame:
    """Glossary terms that neither the rest of the specification nor the vision uses."""
    return _pair(docs).select("project", F.explode(_unused_terms(F.col("vision"), F.col("spec"))).alias("term"))


def _conflicts(outside: Column, goal: Column) -> Column:
    found = F.transform(
        _distinct_words(outside),
        lambda o: F.struct(
            o["item"].alias("item"), o["words"].alias("words"), _found_in(o["words"], goal).alias("shared")
        ),
    )
    return F.filter(found, lambda f: _enough(f["shared"], f["words"]))


def goal_conflicts(docs: DataFrame) -> DataFrame:
    """Excluded items with two distinct keywords, and half of theirs, in the goal."""
    vision = F.col("vision")
    found = let(
        normalize(md.section(vision, "## Goal")), lambda goal: _conflicts(_items(vision, "## Out of scope"), goal)
    )
    return _vision(docs).select("project", F.inline(found)).select(
        "project", F.col("item").alias("excluded"), F.array_join(F.array_sort("shared"), ", ").alias("shared")
    )


def unmentioned_artifacts(artifacts: DataFrame, docs: DataFrame) -> DataFrame:
    """Artifacts (``project, rel_path``) whose name and path occur in no document of their project.

    The path ends with the name, so a text without the name is without the path.
    """
    return _unmentioned(artifacts, _texts(docs))


def _named(artifacts: DataFrame) -> DataFrame:
    path = F.translate("rel_path", "\\", "/")
    return artifacts.select("project", path.alias("rel_path"), base_name(path).alias("name"))


def mentions(names: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct ``project, name`` of the names (``project, name``) that occur in the text of their project
    (``project, text``, one row each).

    The distinct names of a project travel to its text, never the text to a name. An automaton over the
    names reads the text once, so the work is the length of the text and of the names, not their product.
    """
    listed = names.where("name <> ''").groupBy("project").agg(F.collect_set("name").alias("names"))
    given = texts.select("project", "text").join(listed, "project")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        for batch in batches:
            for project, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("project", "text", "names")), strict=True):
                automaton = ahocorasick.Automaton()
                for name in wanted:
                    automaton.add_word(name, name)
                automaton.make_automaton()
                found = sorted({name for _, name in automaton.iter(text or "")})
                yield pa.RecordBatch.from_arrays([pa.array([project] * len(found), pa.string()), pa.array(found, pa.string())], names=["project", "name"])

    return given.mapInArrow(run, "project string, name string")


def _unmentioned(artifacts: DataFrame, texts: DataFrame) -> DataFrame:
    combined = F.concat_ws("\n", *[F.col(c) for c in TEXT_COLUMNS.values()])
    named = _named(artifacts)
    found = mentions(named, texts.select("project", combined.alias("text")))
    # an empty name is in every text
    return named.where("name <> ''").join(found, ["project", "name"], "left_anti").select("project", "rel_path")


def status_report(docs: DataFrame) -> DataFrame:
    """Status and date of every expected document: ``MISSING`` without the document, ``?`` without the line."""
    unknown = F.lit("?")
    cells = [
        F.max(
            F.when(
                F.col("rel_path") == p,
                F.struct(F.coalesce("status", unknown).alias("status"), F.coalesce("date", unknown).alias("date")),
            )
        )
        for p in HEADINGS
    ]
    absent = F.struct(F.lit("MISSING").alias("status"), F.lit("").alias("date"))
    rows = F.array(
        *[F.struct(F.lit(p).alias("rel_path"), F.coalesce(c, absent).alias("cell")) for c, p in zip(cells, HEADINGS)]
    )
    report = doc_metadata(docs).groupBy("project").agg(rows.alias("rows")).select("project", F.inline("rows"))
    return report.select("project", "rel_path", "cell.status", "cell.date")


def set_status(docs: DataFrame, status: str, date: str) -> DataFrame:
    """Required documents with every status and date line rewritten, and whether that changed them."""
    if status not in STATUSES:
        raise ValueError(f"status must be one of {', '.join(STATUSES)}")
    new = F.regexp_replace(_content(), STATUS_LINE, f"**Status:** {status}")
    new = F.regexp_replace(new, DATE_LINE, f"**Date:** {date}")
    rewritten = let(new, lambda text: F.struct(text.alias("content"), (text != _content()).alias("changed")))
    return required(docs).select("project", "rel_path", F.inline(F.array(rewritten)))


# All checks together.


def _texts(docs: DataFrame) -> DataFrame:
    """One row per project with the texts of its required documents, null where one is missing."""
    return docs.groupBy("project").agg(
        *[F.max(F.when(F.col("rel_path") == p, _content())).alias(c) for p, c in TEXT_COLUMNS.items()]
    )


def _at(rel_path: str, issues: Column) -> Column:
    return F.transform(
        issues,
        lambda i: F.struct(
            F.lit(rel_path).alias("rel_path"), i["line"].alias("line"), i["rule"].alias("rule"), i["detail"].alias("detail")
        ),
    )


def _structure(rel_path: str, text: Column) -> Column:
    """Issues within one document, or its absence."""
    checks = [_metadata(text, rel_path), _headings(text, rel_path), _placeholders(text), _banned(text)]
    if rel_path in LENGTH_CHECKED:
        checks.append(_short(text, rel_path))
    if rel_path == VISION:
        checks.append(_metrics(text))
    absent = F.array(_issue("missing document", F.lit("")))
    return _at(rel_path, F.when(text.isNull(), absent).otherwise(F.concat(*checks)))


def _consistency(vision: Column, spec: Column) -> Column:
    """Issues between a vision and a specification."""
    facts = F.struct(
        _items(vision, "## In scope").alias("inside"),
        _items(vision, "## Out of scope").alias("outside"),
        _items(vision, "## Key capabilities").alias("capabilities"),
        normalize(md.section(vision, "## Goal")).alias("goal"),
        _scope_text(spec).alias("scope"),
        normalize(spec).alias("spec"),
    )

    def named(rule: str, found: Column, field: str | None = None) -> Column:
        return F.transform(found, lambda f: _issue(rule, f[field] if field else f))

    return let(
        facts,
        lambda d: F.concat(
            _at(
                VISION,
                F.concat(
                    named("scope contradiction", _contradictions(d["inside"], d["outside"]), "excluded"),
                    named("excluded but specified", _specified(d["outside"], d["scope"]), "item"),
                    named("capability not covered", _weak(d["capabilities"], d["spec"], CAPABILITY_COVERAGE), "item"),
                    named("scope item not covered", _weak(d["inside"], d["spec"], SCOPE_COVERAGE), "item"),
                    named("goal conflict", _conflicts(d["outside"], d["goal"]), "item"),
                ),
            ),
            _at(
                SPEC,
                F.concat(
                    named("entity without operation", _unused_entities(spec)),
                    named("missing test subsection", _absent_subsections(spec)),
                    named("unused term", _unused_terms(vision, spec)),
                ),
            ),
        ),
    )


def validate_documents(docs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Issues of the first failing stage of each project, with ``stage`` 1 to 3.

    Structure errors stop the consistency checks, those stop the artifact check. The texts of
    a project meet in one row, so the documents are read and shuffled once and a stage that
    is not reached is not computed; only artifacts of projects clean so far are looked up.
    """
    texts = _texts(docs)
    structure = F.concat(*[_structure(p, F.col(c)) for p, c in TEXT_COLUMNS.items()])
    staged = texts.select("*", F.explode(F.array(structure)).alias("first"))
    second = F.when(F.size("first") == 0, _consistency(F.col("vision"), F.col("spec"))).otherwise(
        F.slice("first", 1, 0)
    )
    staged = staged.select("*", F.explode(F.array(second)).alias("second"))

    stage = F.when(F.size("first") > 0, F.lit(1)).otherwise(F.lit(2))
    documented = staged.select("project", stage.alias("stage"), F.inline(F.concat("first", "second")))
    clean = staged.where((F.size("first") == 0) & (F.size("second") == 0))
    of_clean = artifacts.join(clean.select("project"), "project", "left_semi")
    unmentioned = _emit(
        _unmentioned(of_clean, clean), F.array(_issue("artifact not mentioned", F.lit("")))
    )
    return documented.unionByName(unmentioned.withColumn("stage", F.lit(3)))


def project_name_issues(names: DataFrame) -> DataFrame:
    """``project, problem`` for empty names, forbidden characters and blanks."""
    name = F.col("project")
    problems = F.array_compact(
        F.array(
            F.when(trim_space(name) == "", F.lit("empty")),
            F.when(name.rlike(r'[/\\:*?"<>|]'), F.lit("forbidden characters")),
            F.when(name.contains(" "), F.lit("spaces")),
        )
    )
    return names.select("project", F.explode(problems).alias("problem"))


def validate_projects(docs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The whole gate: issues of the first failing stage of each project that has documents, with ``stage``
    0 for its name and 1 to 3 as ``validate_documents`` has them. A project whose name is refused is not
    looked into."""
    names = docs.select("project").distinct()
    refused = project_name_issues(names)
    rows = _emit(refused.withColumn("rel_path", F.lit("")), F.array(_issue("project name", F.col("problem")))).withColumn("stage", F.lit(0))
    kept = docs.join(refused.select("project").distinct(), "project", "left_anti")
    return rows.unionByName(validate_documents(kept, artifacts))

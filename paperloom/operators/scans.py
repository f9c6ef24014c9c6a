"""Scans over project files: runtimes, secrets, critical paths, variables, links, duplicates, debt, stages."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions.globs import directory_prefixes
from ..functions.spans import Pattern, SpanFinder
from ..functions.text import clean_path, let, literal_array, parent_dir, split_lines, trim_space
from ..sources.stages import Stages
from .graphs import components

# Runtimes by priority, the base names that mark them, their tier.
RUNTIMES = (
    ("node", r"package\.json", "first-class"),
    ("go", r"go\.mod", "first-class"),
    ("python", r"pyproject\.toml|requirements\.txt|setup\.py", "general"),
    ("rust", r"Cargo\.toml", "general"),
    ("java", r"pom\.xml|build\.gradle.*|settings\.gradle.*", "general"),
)
NO_RUNTIME = ("generic", "fallback")

# How each runtime reads a variable; the group is its name.
ENV_PATTERNS = {
    "node": r"(?:process\.env|import\.meta\.env)\.([A-Z0-9_]+)",
    "go": r'os\.Getenv\("([A-Z0-9_]+)"\)',
    "python": r"os\.environ(?:\.get)?\(?[\"']?([A-Z0-9_]+)",
    "rust": r'(?:std::)?env::var\(?"([A-Z0-9_]+)"',
    "java": r'System\.getenv\("([A-Z0-9_]+)"\)',
    "generic": r"([A-Z][A-Z0-9_]{2,})",
}

# Patterns of secrets; the group is the value a match stands or falls by. All are plain enough for any
# regular-expression dialect. A name may be quoted, joined with others or in camel case.
_NAME = (
    r"(?:(?:[A-Za-z0-9_.-]*[_.-])?(?i:password|passwd|token|key|secret)"
    r"|[A-Za-z0-9_]*[a-z0-9](?:Password|Passwd|Token|Key|Secret))"
)
SECRET_PATTERNS = {
    "assignment": Pattern(
        ("password", "passwd", "token", "key", "secret"),
        rf"(?:^|[^A-Za-z0-9_.-]){_NAME}[\"']?[ \t]*(?::=|=>|[=:])[ \t]*[\"']([^\"']+)[\"']",
    ),
    "url credentials": Pattern(("://",), r"[A-Za-z][A-Za-z0-9+.-]*://[^ \t/:@]+:([^ \t/@]+)@"),
    "url parameter": Pattern(("api_key=", "apikey=", "token=", "secret="), r"[?&](?:api_key|apikey|token|secret)=([^ \t&#\"']+)"),
    "private key": Pattern(("private key-----",), r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)"),
    "cloud access key": Pattern(("akia",), r"(?:^|[^A-Za-z0-9])(AKIA[0-9A-Z]{16})"),
    "repository token": Pattern(("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"(?:^|[^A-Za-z0-9])(gh[pousr]_[A-Za-z0-9]{36})"),
    "model provider key": Pattern(("sk-",), r"(?:^|[^A-Za-z0-9])(sk-[A-Za-z0-9_-]{20,})"),
}
# Values that only hold a place.
PLACEHOLDER_VALUE = r"(?i)(?:<.*>|\$\{.*|\{\{.*|%[a-z(].*|x{3,}|\*{3,}|your[-_ ].*|change[-_ ]?me|example|placeholder|todo|\.{3})"

# Words that make a source file critical, the directories of each tier, the report's length.
CRITICAL_WORDS = ("auth", "login", "payment", "billing", "webhook", "cron", "migration")
TIERS = (("critical", r"^src/(?:auth|payments|workers)/"), ("standard", r"^src/(?:api|services)/"), ("low", r"^src/utils/"))
CRITICAL_PATHS = 20

# Smallest duplicate.
DUPLICATE_LINES = 8
DUPLICATE_TOKENS = 50

# Age in months after which a dated marker is old; decisions shown per project.
OLD_MONTHS = 6
DECISIONS_SHOWN = 7

# Fixed value: components a call matrix stays readable with.
MATRIX_COMPONENTS = 12


def _content() -> Column:
    return F.col("content")


def detect_runtime(files: DataFrame) -> DataFrame:
    """``project, runtime, tier`` by the first marker, in order of priority, at the project root."""
    marker = F.lit(None).cast("int")
    for rank, (_, names, _) in reversed(list(enumerate(RUNTIMES))):
        marker = F.when(F.col("path").rlike(f"^(?:{names})$"), F.lit(rank)).otherwise(marker)
    best = files.groupBy("project").agg(F.min(marker).alias("rank"))
    return best.select(
        "project",
        F.coalesce(F.get(literal_array([r[0] for r in RUNTIMES]), "rank"), F.lit(NO_RUNTIME[0])).alias("runtime"),
        F.coalesce(F.get(literal_array([r[2] for r in RUNTIMES]), "rank"), F.lit(NO_RUNTIME[1])).alias("tier"),
    )


def detect_stack(files: DataFrame) -> DataFrame:
    """Flags for a compose file, a container file and an environment example at the project root."""
    path = F.col("path")
    return files.groupBy("project").agg(
        F.bool_or(path.isin("docker-compose.yml", "docker-compose.yaml")).alias("compose"),
        F.bool_or(path == "Dockerfile").alias("dockerfile"),
        F.bool_or(path == ".env.example").alias("env_example"),
    )


def scan_patterns(files: DataFrame, patterns=None) -> DataFrame:
    """``project, path, line, pattern, n``: every match that looks like a secret, the ``n``-th of its
    pattern in its line. A match whose own value only holds a place is left out, whatever else stands
    in its line.

    Texts are read once by an automaton over the hints of all patterns; a pattern is only tried in
    the lines that have one of its hints. Null texts have no matches.
    """
    patterns = dict(patterns or SECRET_PATTERNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = SpanFinder(patterns, PLACEHOLDER_VALUE)
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("project", "path", "content")), strict=True)
            found = [(project, path, line, name, n) for project, path, text in rows for line, name, n, _ in finder.find(text or "")]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["project", "path", "line", "pattern", "n"])

    return files.select("project", "path", "content").mapInArrow(run, "project string, path string, line bigint, pattern string, n bigint")


def critical_paths(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Source files that mention a critical word, ranked within their project by tier and path; with a
    ``limit`` only the first of each project."""
    tier = F.lit("standard")
    order = F.lit(1)
    for rank, (name, prefix) in enumerate(TIERS):
        tier = F.when(F.col("path").rlike(prefix), F.lit(name)).otherwise(tier)
        order = F.when(F.col("path").rlike(prefix), F.lit(rank)).otherwise(order)
    mentions = reduce(or_, [_content().contains(word) for word in CRITICAL_WORDS])
    found = files.where(F.col("path").startswith("src/") & mentions)
    listed = found.select("project", "path", tier.alias("tier"), order.alias("_order"))
    rank = F.row_number().over(Window.partitionBy("project").orderBy("_order", "path"))
    ranked = listed.withColumn("rank", rank).drop("_order")
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def env_names(content: Column, runtime: Column) -> Column:
    """Distinct variable names a text reads, by the pattern of its runtime."""
    names = F.lit(None).cast("array<string>")
    for name, regex in ENV_PATTERNS.items():
        names = F.when(runtime == name, F.regexp_extract_all(content, F.lit(regex), F.lit(1))).otherwise(names)
    return F.array_distinct(names)


def extract_env_vars(files: DataFrame, runtimes: DataFrame) -> DataFrame:
    """Distinct ``project, name`` of the variables read by source files."""
    return (
        files.join(runtimes.select("project", "runtime"), "project")
        .select("project", F.explode(env_names(_content(), F.col("runtime"))).alias("name"))
        .distinct()
    )


def documented_env_vars(files: DataFrame) -> DataFrame:
    """Distinct ``project, name`` of the variables an environment example lists."""
    examples = files.where(F.col("path").rlike(r"(?:^|/)\.env\.example$"))
    names = F.regexp_extract_all(_content(), F.lit(r"(?m)^[ \t]*(?:export[ \t]+)?([A-Z][A-Z0-9_]*)="), F.lit(1))
    return examples.select("project", F.explode(names).alias("name")).distinct()


def env_sync(used: DataFrame, documented: DataFrame) -> DataFrame:
    """``project, name, problem``: used but not documented, or documented but not used.

    The comparison is the same for documented and existing commands.
    """
    left = used.distinct().withColumn("_used", F.lit(True))
    right = documented.distinct().withColumn("_documented", F.lit(True))
    both = left.join(right, ["project", "name"], "full")
    problem = F.when(F.col("_documented").isNull(), "undocumented").when(F.col("_used").isNull(), "unused")
    return both.select("project", "name", problem.alias("problem")).where("problem IS NOT NULL")


def documented_commands(docs: DataFrame) -> DataFrame:
    """Distinct ``project, name`` of package scripts that documents tell to run."""
    names = F.regexp_extract_all(_content(), F.lit(r"(?:npm|pnpm|yarn) run ([A-Za-z0-9:_-]+)"), F.lit(1))
    return docs.select("project", F.explode(names).alias("name")).distinct()


def manifest_commands(manifests: DataFrame) -> DataFrame:
    """Distinct ``project, name`` of the scripts in project manifests (``project, json``)."""
    scripts = F.from_json("json", "scripts map<string, string>")["scripts"]
    return manifests.select("project", F.explode(F.map_keys(scripts)).alias("name")).distinct()


def heading_slug(heading: Column) -> Column:
    """Anchor of a heading: lower case, punctuation dropped, blanks as hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(trim_space(heading)), r"[^\p{L}\p{N}_ -]", ""), " ", "-")


def broken_links(docs: DataFrame, files: DataFrame) -> DataFrame:
    """``project, rel_path, link, problem``: relative links to missing files, anchors to missing headings.

    External links are not looked at. ``files`` lists what exists besides the documents.
    """
    links = F.regexp_extract_all(_content(), F.lit(r"\]\(([^)\s]+)[^)]*\)"), F.lit(1))
    found = docs.where(_content().contains("](")).select(
        "project", "rel_path", F.explode(F.array_distinct(links)).alias("link")
    )
    local = found.where(~F.col("link").rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)"))
    named = F.regexp_extract("link", r"^([^#?]*)", 1)
    base = F.when(named.startswith("/"), named).otherwise(F.concat(parent_dir(F.col("rel_path")), F.lit("/"), named))
    local = local.select(
        "project",
        "rel_path",
        "link",
        F.when(named == "", F.col("rel_path")).otherwise(clean_path(base)).alias("target"),
        F.nullif(F.regexp_extract("link", r"#(.*)$", 1), F.lit("")).alias("slug"),
    )

    listed = docs.select("project", F.col("rel_path").alias("path")).unionByName(files.select("project", "path"))
    # only projects that have such links are listed, and only what a link names is kept
    folders = F.transform(directory_prefixes(F.col("path")), lambda d: F.regexp_replace(d, "/$", ""))
    asked = local.select("project", "target").distinct()
    near = listed.join(asked.select("project").distinct(), "project", "left_semi")
    named_paths = near.select("project", F.explode(F.concat(F.array("path"), folders)).alias("target"))
    known = named_paths.join(asked, ["project", "target"], "left_semi").distinct()
    headings = F.regexp_extract_all(_content(), F.lit(r"(?md)^#{1,6} +(.*)$"), F.lit(1))
    slugs = docs.select(
        "project", F.col("rel_path").alias("target"), F.explode(F.transform(headings, heading_slug)).alias("slug")
    ).distinct()

    checked = local.join(known.withColumn("_known", F.lit(True)), ["project", "target"], "left").join(
        slugs.withColumn("_heading", F.lit(True)), ["project", "target", "slug"], "left"
    )
    anchored = F.col("slug").isNotNull() & F.col("target").endswith(".md")
    problem = F.when(F.col("_known").isNull() & (F.coalesce("target", F.lit("?")) != ""), "missing file").when(
        anchored & F.col("_heading").isNull(), "missing heading"
    )
    return checked.select("project", "rel_path", "link", problem.alias("problem")).where("problem IS NOT NULL")


def _line_windows(min_lines: int) -> Column:
    """Every run of ``min_lines`` lines that are not blank: place, digest, tokens."""
    lines = F.filter(
        F.transform(
            split_lines(_content()),
            lambda text, i: let(
                trim_space(text),
                lambda t: F.struct(
                    (i + 1).cast("bigint").alias("line"),
                    F.md5(t).alias("digest"),
                    F.regexp_count(t, F.lit(r"\S+")).cast("bigint").alias("tokens"),
                ),
            ),
        ),
        lambda ln: ln["tokens"] > 0,
    )
    return let(
        lines,
        lambda ls: F.transform(
            F.slice(ls, 1, F.greatest(F.size(ls) - (min_lines - 1), F.lit(0))),
            lambda ln, i: let(
                F.slice(ls, i + 1, F.lit(min_lines)),
                lambda w: F.struct(
                    i.cast("bigint").alias("pos"),
                    ln["line"].alias("first"),
                    F.element_at(w, -1)["line"].alias("last"),
                    F.unhex(F.md5(F.array_join(w["digest"], ""))).alias("digest"),
                    F.aggregate(w, F.lit(0).cast("bigint"), lambda acc, x: acc + x["tokens"]).alias("tokens"),
                    F.element_at(w, -1)["tokens"].alias("added"),
                ),
            ),
        ),
    )


def duplicate_blocks(
    files: DataFrame, min_lines: int = DUPLICATE_LINES, min_tokens: int = DUPLICATE_TOKENS
) -> DataFrame:
    """``project, path, start_line, end_line, lines, tokens`` of blocks that occur in two places or more.

    Lines are compared trimmed, blank ones are skipped, a token is a run of characters without
    white space. Windows of ``min_lines`` lines are compared by digest and counted before the
    shuffle, so a block copied everywhere stays one counter per task and no pairs are formed.
    Adjoining duplicated windows of a file merge into one block.
    """
    windows = files.select("project", "path", F.inline(_line_windows(min_lines)))
    repeated = windows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    shared = windows.join(repeated, "digest", "left_semi").drop("digest")
    order = Window.partitionBy("project", "path").orderBy("pos")
    runs = shared.withColumn("run", F.col("pos") - F.row_number().over(order))
    # The first window of a run counts whole, each later one adds its last line.
    tokens = F.min_by("tokens", "pos") + F.sum("added") - F.min_by("added", "pos")
    blocks = runs.groupBy("project", "path", "run").agg(
        F.min("first").alias("start_line"),
        F.max("last").alias("end_line"),
        (F.count(F.lit(1)) + (min_lines - 1)).alias("lines"),
        tokens.alias("tokens"),
    )
    return blocks.where(F.col("tokens") >= min_tokens).drop("run")


def debt_markers(files: DataFrame, as_of: str, months: int = OLD_MONTHS) -> DataFrame:
    """``project, path, line, problem``: markers without date, author or ticket, and dated ones grown old."""
    marker = r"(?:^|[^A-Za-z0-9_])(?:TODO|FIXME)(?:[^A-Za-z0-9_]|$)"
    hits = F.filter(md.numbered_lines(_content()), lambda ln: ln["text"].rlike(marker))
    found = files.where(_content().rlike("TODO|FIXME")).select("project", "path", F.inline(hits))
    text = F.col("text")
    dated = F.try_to_date(F.nullif(F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), "yyyy-MM-dd")
    author = text.rlike(r"(?:TODO|FIXME)\([^)]+\)|@[A-Za-z0-9_-]+")
    ticket = text.rlike(r"[A-Z][A-Z0-9]+-\d+|#\d+|https?://")
    problem = F.when(dated < F.add_months(F.lit(as_of).cast("date"), -months), "old").when(
        dated.isNull() & ~author & ~ticket, "untracked"
    )
    return found.select("project", "path", "line", problem.alias("problem")).where("problem IS NOT NULL")


def call_matrix(edges: DataFrame, roles) -> DataFrame:
    """Who calls whom and why: one row per calling role, one column per called role, empty for none.

    ``edges`` has ``src, dst, purpose``; ``roles`` is an ordered sequence of ``(role, path
    regex)`` that merges files into components, the first match counts and the rest is
    ``other``. Purposes are a small vocabulary and are made distinct before they are listed.
    """
    names = [name for name, _ in roles] + ["other"]

    def role(path: Column) -> Column:
        chosen = F.lit("other")
        for name, regex in reversed(list(roles)):
            chosen = F.when(path.rlike(regex), F.lit(name)).otherwise(chosen)
        return chosen

    distinct = edges.select(
        role(F.col("src")).alias("caller"), role(F.col("dst")).alias("callee"), "purpose"
    ).distinct()
    cells = distinct.groupBy("caller").pivot("callee", names).agg(
        F.array_join(F.array_sort(F.collect_set("purpose")), ", ")
    )
    return cells.fillna("", names)


def merge_components(edges: DataFrame, limit: int = MATRIX_COMPONENTS) -> tuple[DataFrame, DataFrame]:
    """``component, merged`` for every component of ``edges`` (``caller, callee, purpose``), so that at most
    ``limit`` are left, and ``caller, callee, calls, purposes`` between those.

    While there are too many, those with the least calls, as many as are too many, each join the one
    they have most calls with, in either direction; one without calls to others joins the one with the
    most calls of all. Ties go to the smaller name. A merged component bears the name of the member
    with the most calls. Each round is written; only the number of components comes to the driver.
    """
    stages = Stages(edges.sparkSession)
    calls = edges.groupBy("caller", "callee").agg(F.count(F.lit(1)).alias("calls"))
    nodes = edges.select(F.explode(F.array("caller", "callee")).alias("component")).distinct()
    names, count, _ = stages.write(nodes.select("component", F.col("component").alias("merged")))
    calls, _, _ = stages.write(calls)
    while count > limit:
        ends = names.withColumnRenamed("component", "caller").withColumnRenamed("merged", "a")
        tips = names.withColumnRenamed("component", "callee").withColumnRenamed("merged", "b")
        now = calls.join(ends, "caller").join(tips, "callee").groupBy("a", "b").agg(F.sum("calls").alias("calls"))
        both = now.unionByName(now.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "calls"))
        weight = both.groupBy("a").agg(F.sum("calls").alias("weight"))
        near = both.where("a <> b").groupBy("a", "b").agg(F.sum("calls").alias("calls"))
        best = near.groupBy("a").agg(F.min(F.struct((-F.col("calls")).alias("calls"), "b")).alias("best"))
        top = weight.agg(F.min(F.struct((-F.col("weight")).alias("w"), "a")).alias("h")).first()["h"]["a"]
        light = weight.join(best, "a", "left").orderBy("weight", "a").limit(count - limit)
        joins = light.select("a", F.coalesce("best.b", F.lit(top)).alias("b")).where("a <> b")
        joins, _, _ = stages.write(joins.select("a", "b"))
        groups = components(weight.select(F.col("a").alias("node")), joins)
        heads = groups.join(weight.withColumnRenamed("a", "node"), "node").groupBy("component")
        heads = heads.agg(F.min(F.struct((-F.col("weight")).alias("w"), "node")).alias("h")).select("component", F.col("h.node").alias("head"))
        renamed = groups.join(heads, "component").select(F.col("node").alias("merged"), "head")
        names, _, _ = stages.write(names.join(renamed, "merged").select("component", F.col("head").alias("merged")))
        count = names.select("merged").distinct().count()
    ends = names.withColumnRenamed("component", "caller").withColumnRenamed("merged", "a")
    tips = names.withColumnRenamed("component", "callee").withColumnRenamed("merged", "b")
    told = edges.join(ends, "caller").join(tips, "callee").groupBy("a", "b", "purpose").agg(F.count(F.lit(1)).alias("n"))
    purposes = F.array_join(F.array_sort(F.collect_list("purpose")), ", ").alias("purposes")
    return names, told.groupBy(F.col("a").alias("caller"), F.col("b").alias("callee")).agg(F.sum("n").alias("calls"), purposes)


def classify_manifest(manifests: DataFrame) -> DataFrame:
    """``project, kind`` from the dependencies of a manifest (``project, json``), first rule wins."""
    parsed = F.from_json("json", "dependencies map<string, string>, devDependencies map<string, string>")

    def has(group: str, *names: str) -> Column:
        keys = F.map_keys(F.col(f"m.{group}"))
        return F.coalesce(F.arrays_overlap(keys, literal_array(names)), F.lit(False))

    kind = (
        F.when(has("dependencies", "react", "vue"), "frontend")
        .when(has("devDependencies", "vite"), "frontend")
        .when(has("dependencies", "@nestjs/core", "express", "fastify"), "backend")
        .when(F.get_json_object("json", "$.bin").isNotNull(), "CLI")
        .otherwise("library")
    )
    return manifests.withColumn("m", parsed).select("project", kind.alias("kind"))


def active_decisions(docs: DataFrame, count: int | None = None) -> DataFrame:
    """Front matter of decisions that are active or need review, ranked within their project from the
    newest; with a ``count`` only the newest of each."""
    front = F.regexp_extract(_content(), r"\A---\n((?s:.)*?)\n---", 1)

    def field(name: str) -> Column:
        return F.regexp_extract("front", rf"(?md)^{name}:\s*(.*)$", 1)

    parsed = docs.select("project", "rel_path", F.explode(F.array(front)).alias("front")).select(
        "project",
        "rel_path",
        field("id").alias("id"),
        field("title").alias("title"),
        field("status").alias("status"),
        field("created_at").alias("created_at"),
    )
    active = parsed.where(F.col("status").isin("active", "needs_review"))
    rank = F.row_number().over(Window.partitionBy("project").orderBy(F.col("created_at").desc(), "id", "rel_path"))
    ranked = active.withColumn("rank", rank)
    return ranked if count is None else ranked.where(F.col("rank") <= count)


def project_stage(files: DataFrame) -> DataFrame:
    """How far each project is, by the files in its workspace (``project, path, modified``).

    ``outdated`` warns when the specification is newer than the schema document made from it.
    """
    path, project = F.col("path"), F.col("project")
    spec = path == F.concat(F.lit("docs/"), project, F.lit("/2_PRODUCT_SPEC/SPEC.md"))
    blueprint = F.concat(F.lit("blueprint/"), project, F.lit("/3_TECH_BLUEPRINT/"))
    model = path == F.concat(blueprint, F.lit("DATABASE_MODEL.md"))
    code = F.concat(F.lit("projects/"), project)
    spec_time, model_time = F.max(F.when(spec, F.col("modified"))), F.max(F.when(model, F.col("modified")))
    return files.groupBy("project").agg(
        F.bool_or(spec).alias("specified"),
        F.bool_or(path.startswith("prototype/src/")).alias("prototyped"),
        F.bool_or(path == F.concat(blueprint, F.lit("IMPLEMENTATION_GUIDE.md"))).alias("planned"),
        (
            F.bool_or(F.startswith(path, F.concat(code, F.lit("/backend/src/"))))
            & F.bool_or(F.startswith(path, F.concat(code, F.lit("/frontend/src/"))))
        ).alias("implemented"),
        F.coalesce(spec_time > model_time, F.lit(False)).alias("outdated"),
    )

"""Which files of a project take part: ignore rules, size, kind, roots, change sets, configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import globs
from ..functions.text import base_name, extension, literal_array, quote, trim_space

# Limits.
MAX_FILE_BYTES = 1024 * 1024
BINARY_PROBE_BYTES = 8192

# Extensions taken as binary.
BINARY_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".webp", ".gif", ".bmp", ".ico", ".tif", ".tiff",
    ".psd", ".ai", ".sketch", ".heic", ".heif",
    ".mp3", ".wav", ".flac", ".ogg", ".m4a",
    ".mp4", ".mkv", ".mov", ".avi", ".webm", ".wmv", ".flv", ".mpg", ".mpeg", ".ogv",
    ".zip", ".gz", ".tgz", ".bz2", ".xz", ".rar", ".7z", ".tar",
    ".pdf", ".exe", ".dll", ".so", ".dylib", ".class", ".jar", ".war", ".ear",
    ".ttf", ".otf", ".woff", ".woff2", ".eot",
    ".bin", ".pak", ".dat",
)

# Extensions and whole names taken as text, before the list above.
TEXT_NAMES = (
    ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".json", ".html", ".css",
    ".scss", ".less", ".vue", ".svelte",
    ".java", ".py", ".c", ".cpp", ".h", ".hpp", ".cs", ".go", ".rs", ".php",
    ".rb", ".swift", ".kt", ".dart", ".scala", ".pl", ".lua", ".sh", ".bat",
    ".md", ".txt", ".xml", ".yaml", ".yml", ".sql", ".graphql", ".toml", ".ini", ".env",
    ".gitignore", ".dockerignore", "dockerfile", ".editorconfig",
)

# Extensions whose comments can be stripped, and those an incremental audit looks at.
CLEANABLE_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".html", ".htm")
AUDITED_EXTENSIONS = (".ts", ".js", ".py", ".go", ".rs")
AUDIT_SCOPE_FILES = 30

# Configuration defaults.
DEFAULT_IGNORE = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", ".git", "node_modules", "dist", "coverage")
DEFAULT_WHITELIST = ("//!",)

CONFIG_SCHEMA = (
    "cleaner struct<whitelist: array<string>, keepJSDoc: boolean, useGitignore: boolean, ignore: array<string>>, "
    "packer struct<ignore: array<string>, useGitignore: boolean, contentBasedBinaryDetection: boolean>, "
    "prompts struct<pack: string>, _corrupt string"
)


def ignore_rules(sources: DataFrame) -> DataFrame:
    """Ignore files to rules: ``project, origin_ord, line, pattern, negated, dir_only, regex``.

    ``sources`` holds one row per ignore text with ``project``, ``origin_ord`` (configuration
    before the version-control file before the tool's own) and ``content``. Blank lines and
    comments are dropped, a backslash is read as a slash. The rule order is ``origin_ord``,
    then ``line``.
    """
    lines = sources.select("project", "origin_ord", F.posexplode(F.split("content", "\n", -1)).alias("pos", "raw"))
    text = lines.withColumn("text", F.translate(trim_space(F.col("raw")), "\\", "/")).where(
        (F.col("text") != "") & ~F.col("text").startswith("#")
    )
    negated = F.col("text").startswith("!")
    body = F.regexp_replace("text", r"^!", "")
    rules = text.select(
        "project",
        "origin_ord",
        (F.col("pos") + 1).cast("bigint").alias("line"),
        F.regexp_replace(body, r"/$", "").alias("pattern"),
        negated.alias("negated"),
        body.endswith("/").alias("dir_only"),
    ).where("pattern <> ''")
    return rules.withColumn("regex", globs.rule_regex(F.col("pattern"), F.col("dir_only")))


def combined_rules(rules: DataFrame) -> DataFrame:
    """One row per project: ``ignore_regex`` for its whole ordered rule list, ``has_negated``.

    The list of one project is as long as its ignore files, so this group stays small
    however many files the project has.
    """
    ordered = F.sort_array(F.collect_list(F.struct("origin_ord", "line", "negated", "regex")))
    return rules.groupBy("project").agg(
        globs.fold_rules(ordered).alias("ignore_regex"), F.bool_or("negated").alias("has_negated")
    )


def ignored(path: Column, regex: Column, has_negated: Column) -> Column:
    """Whether a rule list drops a file.

    A rule matches an entry it names and everything below. Without negated rules the path
    alone decides; otherwise each ancestor is tested first, since a dropped directory is
    never entered and a later rule cannot bring its files back.
    """
    below = F.exists(globs.directory_prefixes(path), lambda d: globs.matches(d, regex))
    return F.when(regex.isNull(), F.lit(False)).otherwise(
        globs.matches(path, regex) | (has_negated & below)
    )


def in_vcs_dir(path: Column) -> Column:
    return path.rlike(r"(^|/)\.git/")


def ignore_filter(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files that neither their project's ignore rules nor a version-control directory drop."""
    per_project = combined_rules(rules)
    joined = vcs_dir_filter(files).join(per_project, "project", "left")
    return joined.where(
        ~ignored(F.col("path"), F.col("ignore_regex"), F.col("has_negated"))
    ).drop("ignore_regex", "has_negated")


def vcs_dir_filter(files: DataFrame) -> DataFrame:
    """Files outside version-control directories, at any depth."""
    return files.where(~in_vcs_dir(F.col("path")))


def root_path_filter(files: DataFrame, roots) -> DataFrame:
    """Files strictly inside one of ``roots``; an empty root or ``.`` lifts the restriction."""
    prefixes = [r[:-1] if r.endswith("/") else r for r in roots]
    if not prefixes or any(p in ("", ".") for p in prefixes):
        return files
    return files.where(F.col("path").rlike("^(?:" + "|".join(quote(p) for p in prefixes) + ")/"))


def size_filter(files: DataFrame, limit: int = MAX_FILE_BYTES) -> DataFrame:
    """Files of at most ``limit`` bytes."""
    return files.where(F.col("length") <= limit)


def oversize_files(files: DataFrame, limit: int = MAX_FILE_BYTES) -> DataFrame:
    """The files ``size_filter`` drops, as a report without content."""
    return files.where(F.col("length") > limit).select("project", "path", "length")


def is_text(path: Column, content: Column | None = None, probe_bytes: int | None = None) -> Column:
    """Known text name, else not a known binary one, else (with ``content``) no zero byte in it, or in
    its first ``probe_bytes``; ``BINARY_PROBE_BYTES`` are what the command line looks at."""
    ext, base = extension(path), F.lower(base_name(path))
    unknown = F.lit(True)
    if content is not None:
        probe = content.cast("binary")
        if probe_bytes is not None:
            probe = F.substring(probe, 1, probe_bytes)
        unknown = F.position(F.lit(b"\x00"), probe) == 0
    return (
        F.when(ext.isin(*TEXT_NAMES) | base.isin(*TEXT_NAMES), F.lit(True))
        .when(ext.isin(*BINARY_EXTENSIONS), F.lit(False))
        .otherwise(unknown)
    )


def text_filter(files: DataFrame, by_content: bool = False, probe_bytes: int | None = None) -> DataFrame:
    return files.where(is_text(F.col("path"), F.col("content") if by_content else None, probe_bytes))


def locale_key(path: Column) -> Column:
    """Sort key that puts accented letters next to their base letter and ignores case first."""
    return F.collate(path, "UNICODE")


def locale_order(files: DataFrame, *columns: str) -> DataFrame:
    """Files in root-collation order of ``columns`` (``path`` when none are given)."""
    return files.orderBy(*[locale_key(F.col(c)) for c in (columns or ("path",))])


def extension_filter(files: DataFrame, extensions=CLEANABLE_EXTENSIONS) -> DataFrame:
    return files.where(extension(F.col("path")).isin(*extensions))


def input_path_filter(files: DataFrame, inputs) -> DataFrame:
    """Files named by an input or below one."""
    if not inputs:
        return files
    alternatives = "|".join(f"{quote(i)}\\z|{quote(i[:-1] if i.endswith('/') else i)}/" for i in inputs)
    return files.where(F.col("path").rlike("^(?:" + alternatives + ")"))


def change_set(changes: DataFrame, mode: str = "changed") -> DataFrame:
    """Distinct changed paths: the union of all lists, or the staged one only."""
    listed = changes.where(F.col("list") == "staged") if mode == "staged" else changes
    cleaned = listed.select(*[c for c in listed.columns if c not in ("list", "path")], trim_space(F.col("path")).alias("path"))
    return cleaned.where("path <> ''").distinct()


def changed_filter(files: DataFrame, changes: DataFrame, mode: str = "changed") -> DataFrame:
    """Files in the change set; ``changes`` has ``list`` and ``path`` (and ``project`` when it has one)."""
    keys = ["project", "path"] if "project" in changes.columns else ["path"]
    return files.join(change_set(changes, mode), keys, "left_semi")


def audit_scope(changes: DataFrame, limit: int | None = None) -> DataFrame:
    """Changed source files of an incremental audit; with a ``limit`` only the first by path, of each
    project where ``changes`` has projects."""
    scope = extension_filter(change_set(changes), AUDITED_EXTENSIONS)
    if limit is None:
        return scope
    if "project" not in scope.columns:
        return scope.orderBy("path").limit(limit)
    rank = F.row_number().over(Window.partitionBy("project").orderBy("path"))
    return scope.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def effective_config(configs: DataFrame) -> DataFrame:
    """Project settings: given fields over the defaults, one row per project.

    Unknown keys are ignored and an explicit empty list counts as given. A field of the wrong
    type makes the row an error row, whose settings are null.
    """
    parsed = configs.withColumn(
        "c",
        F.from_json("json", CONFIG_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}),
    )
    # numbers or flags in text fields pass the parser but not the types
    typed = F.try_parse_json("json")

    def kind(field: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(typed, f"$.{field}", "variant")), F.lit("VOID"))

    mixed = ~kind("prompts.pack").isin("STRING", "VOID")
    for field in ("cleaner.whitelist", "cleaner.ignore", "packer.ignore"):
        mixed = mixed | ~kind(field).isin("ARRAY<STRING>", "ARRAY<VOID>", "VOID")
    bad = F.col("json").isNotNull() & (F.col("c._corrupt").isNotNull() | typed.isNull() | mixed)

    def setting(field: str, default: Column) -> Column:
        return F.when(~bad, F.coalesce(F.col(f"c.{field}"), default))

    return parsed.select(
        "project",
        setting("cleaner.whitelist", literal_array(DEFAULT_WHITELIST)).alias("whitelist"),
        setting("cleaner.keepJSDoc", F.lit(True)).alias("keep_doc"),
        setting("cleaner.useGitignore", F.lit(True)).alias("clean_use_vcs_ignore"),
        setting("cleaner.ignore", literal_array(())).alias("clean_ignore"),
        setting("packer.ignore", literal_array(DEFAULT_IGNORE)).alias("pack_ignore"),
        setting("packer.useGitignore", F.lit(True)).alias("pack_use_vcs_ignore"),
        setting("packer.contentBasedBinaryDetection", F.lit(False)).alias("probe_content"),
        F.when(~bad, F.col("c.prompts.pack")).alias("pack_prompt"),
        bad.alias("invalid"),
    )


def ignore_sources(config: DataFrame, files: DataFrame, tool_file: str | None = None, clean: bool = False) -> DataFrame:
    """Ignore texts of each project for ``ignore_rules``: configuration, version-control file, tool file.

    ``config`` comes from ``effective_config``. The version-control file counts unless the
    configuration says otherwise; only files at the project root are looked at. With ``clean``
    the lists for cleaning are added and its own switch is used.
    """
    lists = F.concat("pack_ignore", "clean_ignore") if clean else F.col("pack_ignore")
    switch = "clean_use_vcs_ignore" if clean else "pack_use_vcs_ignore"
    configured = config.where(~F.col("invalid")).select(
        "project", F.lit(1).alias("origin_ord"), F.array_join(lists, "\n").alias("content")
    )
    texts = files.where(F.col("path") == ".gitignore").join(config.where(switch).select("project"), "project", "left_semi")
    sources = configured.unionByName(texts.select("project", F.lit(2).alias("origin_ord"), "content"))
    if tool_file:
        own = files.where(F.col("path") == tool_file)
        sources = sources.unionByName(own.select("project", F.lit(3).alias("origin_ord"), "content"))
    return sources


def list_files(files: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """Paths only, or ``path``, arrow and reason when ``reasons`` (project, path, reason) is given."""
    if reasons is None:
        return files.select("project", "path")
    listed = files.select("project", "path").join(reasons, ["project", "path"], "left")
    return listed.select("project", "path", F.concat_ws("  ← ", "path", F.coalesce("reason", F.lit(""))).alias("entry"))


def find_files(
    files: DataFrame,
    rules: DataFrame | None = None,
    roots=(),
    max_bytes: int = MAX_FILE_BYTES,
    exclude_binary: bool = True,
    by_content: bool = False,
) -> DataFrame:
    """The whole selection, cheap tests first: rules, roots, size, kind."""
    kept = ignore_filter(files, rules) if rules is not None else vcs_dir_filter(files)
    kept = size_filter(root_path_filter(kept, roots), max_bytes)
    return text_filter(kept, by_content) if exclude_binary else kept

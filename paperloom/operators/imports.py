"""Import graph of JavaScript and TypeScript files: edges, resolution, reachability, reasons."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import segments
from ..functions.text import clean_path, parent_dir, quote
from ..sources.stages import Stages
from .packing import pack

# Extensions an import may leave out, in the order they are tried.
RESOLVED_EXTENSIONS = (".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", ".json")

_STRING = r"(?:\"[^\"\n]+\"|'[^'\n]+')"
IMPORT = (
    rf"\b(?:import|export)\b[^;'\"`()]*?\bfrom\s*{_STRING}"
    rf"|\bimport\s*{_STRING}"
    rf"|\b(?:import|require)\s*\(\s*{_STRING}\s*\)"
)


def import_edges_raw(files: DataFrame, strip_comments: bool = True) -> DataFrame:
    """``project, path, specifier, kind`` of every import, re-export, type import and dynamic import."""
    text = F.col("content")
    if strip_comments:
        text = segments.remove_segments(text, segments.CODE_TOKENS, segments.is_code_comment)["content"]
    found = files.select("project", "path", F.explode(F.regexp_extract_all(text, F.lit(IMPORT), F.lit(0))).alias("m"))
    kind = (
        F.when(F.col("m").rlike(r"^(?:import|export)\s+type\b"), "type")
        .when(F.col("m").startswith("export"), "re-export")
        .when(F.col("m").rlike(r"^(?:import|require)\s*\("), "dynamic")
        .otherwise("import")
    )
    specifier = F.regexp_extract("m", r"[\"']([^\"'\n]+)[\"']\s*\)?$", 1)
    return found.select("project", "path", specifier.alias("specifier"), kind.alias("kind"))


# Levels of a search that one job takes.
LEVELS = 3

CONFIG = "struct<extends: string, compilerOptions: struct<baseUrl: string, paths: map<string, array<string>>>>"


def path_aliases(configs: DataFrame, roots=("tsconfig.json", "jsconfig.json")) -> DataFrame:
    """``project, alias, targets, fallback``: the path aliases in force in each project.

    ``configs`` are the configuration files (``project, path, content``; comments and trailing commas
    are allowed). The first of ``roots`` a project has is in force, with what it inherits: a file without
    aliases of its own takes those of the file it extends, likewise the base folder. Inheritance is
    followed by doubling: every file that still lacks something takes it over from the file it points
    to and then points where that one does, so a chain of n files takes log n rounds and a circle ends
    with what it has. Targets are project paths in the order they are tried; ``fallback`` marks the
    base folder itself, which a specifier need not hit.
    """
    bare = segments.remove_segments(F.col("content"), segments.CODE_TOKENS, segments.is_code_comment)["content"]
    strict = F.when(F.try_parse_json("bare").isNotNull(), F.col("bare")).otherwise(F.regexp_replace("bare", r",(\s*[}\]])", "$1"))
    read = configs.select("project", "path", bare.alias("bare")).select("project", "path", F.from_json(strict, CONFIG).alias("c"))
    folder = parent_dir(F.col("path"))
    extends = F.col("c.extends")
    # of a list of files the last one counts
    extends = F.when(extends.startswith("["), F.element_at(F.from_json(extends, "array<string>"), -1)).otherwise(extends)
    upper = F.when(extends.rlike(r"^\.\.?/"), clean_path(F.concat(folder, F.lit("/"), extends)))
    upper = F.when(upper.endswith(".json"), upper).otherwise(F.concat(upper, F.lit(".json")))
    options = F.col("c.compilerOptions")
    base = F.when(options["baseUrl"].isNotNull(), F.struct(clean_path(F.concat(folder, F.lit("/"), options["baseUrl"])).alias("folder")))
    own = F.when(options["paths"].isNotNull(), F.struct(folder.alias("folder"), options["paths"].alias("paths")))
    stages = Stages(configs.sparkSession)
    state, files, _ = stages.write(read.select("project", "path", base.alias("base"), own.alias("own"), upper.alias("upper")))
    for _ in range(max(files, 1).bit_length()):
        lacking = F.col("upper").isNotNull() & (F.col("base").isNull() | F.col("own").isNull())
        if state.where(lacking).isEmpty():
            break
        above = state.select("project", F.col("path").alias("upper"), F.col("base").alias("b"), F.col("own").alias("o"), F.col("upper").alias("u"))
        open_ones = state.where(lacking).join(above, ["project", "upper"], "left")
        taken = open_ones.select("project", "path", F.coalesce("base", "b").alias("base"), F.coalesce("own", "o").alias("own"), F.col("u").alias("upper"))
        state, _, _ = stages.write(taken.unionByName(state.where(~F.coalesce(lacking, F.lit(False)))))

    rank = F.array_position(F.array(*[F.lit(r) for r in roots]), F.col("path"))
    chosen = state.where(rank > 0).groupBy("project").agg(F.min_by(F.struct("base", "own"), rank).alias("s")).select("project", "s.*")
    start = F.coalesce(F.col("base.folder"), F.col("own.folder"))
    named = chosen.select("project", start.alias("start"), F.explode("own.paths").alias("alias", "targets"))
    named = named.select("project", "alias", F.transform("targets", lambda t: clean_path(F.concat(F.col("start"), F.lit("/"), t))).alias("targets"), F.lit(False).alias("fallback"))
    whole = clean_path(F.concat(F.col("base.folder"), F.lit("/*")))
    bases = chosen.where("base IS NOT NULL").select("project", F.lit("*").alias("alias"), F.array(whole).alias("targets"), F.lit(True).alias("fallback"))
    return named.unionByName(bases)


def _alias_lists(aliases) -> DataFrame:
    """One row per project with its aliases cut at their star: a project's are few, being one file's."""
    star = F.instr("alias", "*")
    cut = aliases.select(
        "project",
        F.struct(
            # the longest text before the star wins, an alias without one before all
            F.when(star == 0, F.lit(1 << 30)).otherwise(star).cast("int").alias("weight"),
            (~F.col("fallback")).alias("meant"),
            F.when(star == 0, F.col("alias")).otherwise(F.substring_index("alias", "*", 1)).alias("before"),
            F.when(star == 0, F.lit(None)).otherwise(F.expr("substring(alias, instr(alias, '*') + 1)")).alias("after"),
            "targets",
        ).alias("a"),
    )
    return cut.groupBy("project").agg(F.reverse(F.array_sort(F.collect_list("a"))).alias("aliases"))


def _aliased(edges: DataFrame, keys: DataFrame, aliases) -> DataFrame:
    """``project, specifier, aliased, meant``: the file the aliases give each distinct specifier."""
    wanted = edges.where(~F.col("specifier").rlike(RELATIVE)).select("project", "specifier").distinct()
    said = F.col("specifier")

    def hits(a: Column) -> Column:
        around = F.length(a["before"]) + F.length(a["after"])
        starred = said.startswith(a["before"]) & said.endswith(a["after"]) & (F.length(said) >= around)
        return F.when(a["after"].isNull(), said == a["before"]).otherwise(starred)

    best = F.get(F.filter("aliases", hits), F.lit(0))
    found = wanted.join(_alias_lists(aliases), "project").withColumn("a", best).where("a IS NOT NULL")
    size = F.length("specifier") - F.length("a.before") - F.length("a.after")
    match = F.when(F.col("a.after").isNull(), F.lit("")).otherwise(F.substring(said, F.length("a.before") + 1, size))
    goals = F.transform("a.targets", lambda t: clean_path(F.replace(t, F.lit("*"), F.col("match"))))
    tried = found.withColumn("match", match).select("project", "specifier", F.col("a.meant").alias("meant"), F.posexplode(goals).alias("place", "key"))
    met = tried.join(keys, ["project", "key"], "left")
    first = F.min_by("resolved", F.when(F.col("resolved").isNotNull(), F.col("place")))
    return met.groupBy("project", "specifier").agg(first.alias("aliased"), F.bool_or("meant").alias("meant"))


RELATIVE = r"^\.\.?(?:/|$)"


def file_keys(files: DataFrame) -> DataFrame:
    """``project, key, resolved``: the best file for every name an import may use for it.

    A file answers to its full path, to the path without a known extension, to its directory
    when it is an index file, and a TypeScript file to the JavaScript name it compiles to.
    One row per key, so resolution is a lookup that adds no rows.
    """
    path = F.col("path")
    exts = "|".join(quote(e) for e in sorted(RESOLVED_EXTENSIONS, key=len, reverse=True))
    ext = F.regexp_extract(path, rf"({exts})$", 1)
    rank = F.array_position(F.array(*[F.lit(e) for e in RESOLVED_EXTENSIONS]), ext).cast("int")
    stem = F.regexp_replace(path, rf"(?:{exts})$", "")
    compiled = F.when(ext.isin(".ts", ".tsx"), F.concat(stem, F.lit(".js")))
    index = F.when((ext != "") & stem.rlike(r"(?:^|/)index$"), F.regexp_replace(stem, r"/?index$", ""))

    def entry(key: Column, priority: Column) -> Column:
        return F.struct(key.alias("key"), priority.alias("priority"))

    names = F.array(
        entry(path, F.lit(0)),
        entry(F.when(ext != "", stem), rank),
        entry(compiled, F.lit(20) + rank),
        entry(index, F.lit(40) + rank),
    )
    listed = files.where(~path.rlike(r"(?:^|/)node_modules/")).select("project", "path", F.explode(names).alias("n"))
    return (
        listed.where("n.key IS NOT NULL")
        .groupBy("project", F.col("n.key").alias("key"))
        .agg(F.min(F.struct("n.priority", "path")).alias("best"))
        .select("project", "key", F.col("best.path").alias("resolved"))
    )


def resolve_imports(edges: DataFrame, files: DataFrame, aliases=None) -> DataFrame:
    """Add ``resolved`` to raw edges: the file a specifier names, null for packages and missing files.

    ``aliases`` are those of ``path_aliases`` (``project, alias, targets, fallback``), or a mapping that
    holds for all projects. Among the aliases that fit the one with the longest text before its star is
    taken, of its targets the first that is a file. A specifier that is relative, or that an alias is
    meant for, is never ``external``.
    """
    keys = file_keys(files)
    local = F.when(F.col("specifier").rlike(RELATIVE), clean_path(F.concat(parent_dir(F.col("path")), F.lit("/"), F.col("specifier"))))
    joined = edges.withColumn("key", local).join(keys, ["project", "key"], "left")
    meant, found = F.col("key").isNotNull(), F.col("resolved")
    if aliases:
        if isinstance(aliases, dict):
            rows = F.array(*[F.struct(F.lit(a).alias("alias"), F.array(F.lit(t)).alias("targets")) for a, t in aliases.items()])
            aliases = edges.select("project").distinct().select("project", F.inline(rows), F.lit(False).alias("fallback"))
        joined = joined.join(_aliased(edges, keys, aliases), ["project", "specifier"], "left")
        found = F.coalesce(found, "aliased")
        meant = meant | F.coalesce(F.col("meant"), F.lit(False)) | F.col("aliased").isNotNull()
    return joined.select("project", "path", "specifier", "kind", (~meant).alias("external"), found.alias("resolved"))


def graph_edges(resolved: DataFrame) -> DataFrame:
    """Distinct ``project, src, dst`` pairs of resolved imports."""
    return resolved.where("resolved IS NOT NULL").select(
        "project", F.col("path").alias("src"), F.col("resolved").alias("dst")
    ).distinct()


def reachable(edges: DataFrame, entries: DataFrame, max_depth: int = 0) -> DataFrame:
    """``project, path, depth, parent``: files reachable from ``entries`` (``project, path``).

    Depth 0 are the entries, 1 their imports; a ``max_depth`` below 1 means no limit. Among
    the importers one step closer the first by path is the parent.

    A round is one job of up to ``LEVELS`` levels: the newest level is expanded step by step, each
    node keeping its least depth and parent, and what was seen in earlier rounds is left out at the
    end. A node seen before leads to seen nodes only, so the order of the two does not matter.
    The edges are bucketed by the file they start from, so a level too large for the optimizer to
    broadcast is dealt to them and they are not shuffled again.
    """
    spark = edges.sparkSession
    stages = Stages(spark)
    level = entries.select("project", "path", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")).distinct()
    level, rows, path = stages.write(level)
    if rows == 0:
        raise ValueError("reachability needs at least one entry file")
    schema, paths, depth = level.schema, [path], 0
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"import_edges_{uuid.uuid4().hex}"
    dealt = edges.select("project", "src", "dst").repartition(buckets, "project", "src")
    dealt.write.bucketBy(buckets, "project", "src").sortBy("project", "src").option("path", f"{stages.base}/edges").saveAsTable(name)
    try:
        links = spark.table(name)
        while rows and (max_depth < 1 or depth < max_depth):
            steps = LEVELS if max_depth < 1 else min(LEVELS, max_depth - depth)
            state = level.select("project", "path", F.struct("depth", "parent").alias("best"))
            for _ in range(steps):
                newest = state.where(F.col("best.depth") == depth).select("project", F.col("path").alias("src"))
                depth += 1
                found = links.join(newest, ["project", "src"]).select("project", F.col("dst").alias("path"), F.struct(F.lit(depth).alias("depth"), F.col("src").alias("parent")).alias("best"))
                state = state.unionByName(found).groupBy("project", "path").agg(F.min("best").alias("best"))
            seen = stages.read(schema, paths).select("project", "path")
            fresh = state.join(seen, ["project", "path"], "left_anti").select("project", "path", "best.*")
            found, rows, path = stages.write(fresh, F.col("depth") == depth)
            paths.append(path)
            level = found.where(F.col("depth") == depth)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return stages.read(schema, paths)


def explain(reach: DataFrame) -> DataFrame:
    """Why a file is included: an entry point, or the file that imports it."""
    reason = F.when(F.col("parent").isNull(), F.lit("entry point")).otherwise(
        F.concat(F.lit("import from "), F.col("parent"))
    )
    return reach.select("project", "path", reason.alias("reason"))


def pack_reachable(files: DataFrame, reach: DataFrame, fmt: str = "xml", **options) -> DataFrame:
    """Pack the reachable files only; ignore rules, size and kind are not looked at here."""
    return pack(files.join(reach.select("project", "path"), ["project", "path"], "left_semi"), fmt, **options)

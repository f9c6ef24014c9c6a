"""Pack the files of a project, in order, into one context and fill a template with it.

A context is the ordered rows of a project, at every size: each row has its place (project,
path and the tie columns) and a piece of text, and the pieces of a project concatenate to the
context. Nothing gathers a project; ``sources.files.write_context`` writes the pieces into one
file per project.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import byte_length, clean_path, let
from ..session import ensure_checkpoint_dir
from . import tokens as tok
from .cleaning import clean_files
from .selection import locale_key

# Head, separator and tail of the two formats.
LAYOUT = {"xml": ("<files>\n", "\n\n", "\n</files>"), "text": ("", "\n\n", "")}


def known_format(fmt: str) -> str:
    """An unknown format is packed, and reported, as xml."""
    return fmt if fmt in LAYOUT else "xml"


def _chunk(fmt: str) -> Column:
    if fmt == "xml":
        return F.concat(F.lit('<file path="'), "path", F.lit('">\n'), "content", F.lit("\n</file>"))
    return F.concat(F.lit("// file: "), "path", F.lit("\n"), "content")


def order_key(tie=()) -> Column:
    """Place of a row in its project: root-collation order of the path, then the path, then ``tie``."""
    return F.struct(locale_key(F.col("path")).alias("k"), F.col("path").alias("p"), *[F.col(c) for c in tie])


def _size(files: DataFrame) -> Column:
    """Bytes of a file; a ``length`` column saves reading the content just to size it."""
    return F.col("length").cast("bigint") if "length" in files.columns else byte_length(F.col("content"))


#: Rows of a table of one row per project up to which a join with files sends it to every task.
SENT = 10_000


def _settled(few: DataFrame) -> DataFrame:
    """A table of one row per project, worked out once: several branches read it, and each would carry
    what is behind it in its plan. A small one is sent to the tasks, so that no project's files meet in one."""
    ensure_checkpoint_dir(few.sparkSession)
    few = few.checkpoint()
    return F.broadcast(few) if few.count() <= SENT else few


def _pieces(files: DataFrame, chunk: Column, layout, tie, nameless: bool = False, loose: bool = False) -> DataFrame:
    """One piece per file. The ends of a project come from paths alone, so content is neither
    sorted nor shuffled unless the optimizer finds the table of ends too large to send."""
    head, sep, tail = (F.lit(part) for part in layout)
    key = order_key(tie)
    ends = (files.where(chunk.isNotNull()) if loose else files).groupBy("project").agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    first, last = key == F.col("_first"), key == F.col("_last")
    ends = ends.withColumnRenamed("project", "_project")
    same = F.col("project").eqNullSafe(F.col("_project")) if nameless else F.col("project") == F.col("_project")
    if loose:
        files = files if nameless else files.where("project IS NOT NULL")
        return _loose_pieces(files.join(_settled(ends), same, "left"), chunk, first, last, (head, sep, tail), tie)
    return files.join(ends, same).select(
        "project",
        "path",
        *tie,
        last.alias("last"),
        F.concat(F.when(key == F.col("_first"), head).otherwise(sep), chunk, F.when(last, tail).otherwise(F.lit(""))).alias("text"),
    )


def _loose_pieces(files: DataFrame, chunk: Column, first: Column, last: Column, layout, tie) -> DataFrame:
    """Pieces of files that may share their place: those at the two ends of a project are numbered
    among their like, so that one has the head and one the tail. Only these are shuffled."""
    head, sep, tail = layout
    outer = F.coalesce(first | last, F.lit(False))
    own = ["project", "path", *tie]
    inner = files.where(~outer).select(*own, F.lit(1).alias("nth"), F.lit(False).alias("last"), F.concat(sep, chunk).alias("text"))
    like = Window.partitionBy(*own)
    ranked = files.where(outer).select(*own, first.alias("_head"), last.alias("_tail"), chunk.alias("_chunk"))
    ranked = ranked.withColumn("nth", F.row_number().over(like.orderBy(F.col("_chunk").asc_nulls_last())))
    ranked = ranked.withColumn("last", F.col("_tail") & (F.col("nth") == F.count("_chunk").over(like)))
    before = F.when(F.col("_head") & (F.col("nth") == 1), head).otherwise(sep)
    text = F.concat(before, "_chunk", F.when(F.col("last"), tail).otherwise(F.lit("")))
    return inner.unionByName(ranked.select(*own, "nth", "last", text.alias("text")))


def pack(files: DataFrame, fmt: str = "xml", tie=(), clean: bool = False, nameless: bool = False, loose: bool = False, **cleaning) -> DataFrame:
    """``project, path, *tie, last, text``: the pieces of the context of each project.

    In the order of ``order_key`` the pieces of a project concatenate to its context; ``last``
    marks the final one. ``tie`` names columns that order equal paths; path and tie together are
    unique in a project. Content is not escaped. With ``clean`` comments are dropped first, the
    sources stay untouched. Files without a project are left out, or with ``nameless`` one more project.

    With ``loose`` path and tie may repeat and files may lack a text: head and tail stand at the first
    and last file that has one, files that share a place come in the order of their text, and a column
    ``nth`` behind ``tie`` numbers those at the ends; name it as one more tie in what follows. The ends
    are found at once.
    """
    fmt = known_format(fmt)
    if clean:
        files = clean_files(files, **cleaning)
    return _pieces(files, _chunk(fmt), LAYOUT[fmt], tie, nameless, loose)


def pack_xml(files: DataFrame, **options) -> DataFrame:
    return pack(files, "xml", **options)


def pack_text(files: DataFrame, **options) -> DataFrame:
    return pack(files, "text", **options)


def file_list(files: DataFrame, tie=(), nameless: bool = False, loose: bool = False) -> DataFrame:
    """The paths of a project in file order, one per line; shaped like ``pack``."""
    return _pieces(files, F.col("path"), ("", "\n", ""), tie, nameless, loose)


def with_final_newline(parts: DataFrame) -> DataFrame:
    """The text a sink writes: a context ends with one more line end."""
    return parts.withColumn("text", F.when(F.col("last"), F.concat("text", F.lit("\n"))).otherwise(F.col("text")))


# Placeholders that stand for rows of their own.
ROW_PLACEHOLDER = r"\{\{(?:context|fileList)\}\}"


def fill_template(parts: DataFrame, listed: DataFrame, templates: DataFrame, tie=()) -> DataFrame:
    """``project, slot, path, *tie, last, text``: templates filled with contexts, as ordered rows.

    ``parts`` are packed files, ``listed`` the file list, and ``templates`` has ``project, template,
    tokens, usd``. A template is cut at its context and file-list placeholders: even slots are its own
    texts, odd slots the rows that stand there. Ordered by slot and ``order_key`` the rows of a project
    concatenate to the filled template. Substituted text is not searched again; a template without a
    context placeholder gets the context appended after a blank line.
    """
    named = F.when(F.col("template").contains("{{context}}"), F.col("template"))
    named = named.otherwise(F.concat("template", F.lit("\n\n{{context}}")))
    cut = _settled(templates.select("project", "tokens", "usd", named.alias("template")))
    pieces, holders = F.split("template", ROW_PLACEHOLDER, -1), F.regexp_extract_all("template", F.lit(ROW_PLACEHOLDER), F.lit(0))
    holders = F.concat(holders, F.array(F.lit(None).cast("string")))
    slots = cut.select("project", "tokens", "usd", F.posexplode(F.arrays_zip(pieces.alias("piece"), holders.alias("holder"))).alias("i", "s"))
    slots = slots.select("project", "tokens", "usd", (F.col("i") * 2).alias("slot"), "s.piece", "s.holder")
    none = [F.lit(None).cast(parts.schema[c].dataType).alias(c) for c in tie]
    own = slots.select("project", "slot", F.lit("").alias("path"), *none, F.col("holder").isNull().alias("last"), _plain(F.col("piece")).alias("text"))
    for holder, rows in (("{{context}}", parts), ("{{fileList}}", listed)):
        places = slots.where(F.col("holder") == holder).select("project", (F.col("slot") + 1).alias("slot"))
        own = own.unionByName(rows.drop("last").join(places, "project").select("project", "slot", "path", *tie, F.lit(False).alias("last"), "text"))
    return own


def _plain(piece: Column) -> Column:
    """A piece of a template with its count and price put in."""
    holders = r"\{\{(?:tokenCount|usdEstimate)\}\}"
    cut = F.struct(F.split(piece, holders, -1).alias("pieces"), F.regexp_extract_all(piece, F.lit(holders), F.lit(0)).alias("holders"))

    def value(text: Column, holder: Column) -> Column:
        filled = F.when(holder.isNull(), F.lit("")).when(holder == "{{tokenCount}}", F.col("tokens").cast("string"))
        return F.concat(text, filled.otherwise(tok.usd_text(F.col("usd"))))

    return let(cut, lambda c: F.array_join(F.zip_with(c["pieces"], c["holders"], value), ""))


def looks_inline(source: Column) -> Column:
    """Whether a prompt source is the prompt itself: several lines, or words without slash and extension."""
    return source.contains("\n") | (
        source.rlike(r"\S") & ~source.rlike(r"[/\\]") & ~source.rlike(r"\.[^/]*\z")
    )


def resolve_source(sources: DataFrame, templates: DataFrame) -> DataFrame:
    """Add ``template`` and ``found``: a stored template of that path, else inline text, else nothing."""
    stored = templates.select(F.col("name").alias("_path"), F.col("content").alias("_stored"))
    inline = F.when(looks_inline(F.col("source")), F.col("source"))
    joined = sources.withColumn("_path", clean_path(F.col("source"))).join(stored, "_path", "left")
    joined = joined.withColumn("template", F.coalesce("_stored", inline))
    return joined.withColumn("found", F.col("template").isNotNull()).drop("_path", "_stored")


def resolve_name(names: DataFrame, templates: DataFrame) -> DataFrame:
    """Add ``template`` for a template name: the exact name with an extension, else ``.md`` before ``.txt``.

    Every template is listed once under each name it answers to and only the best one per
    name is kept, so the lookup adds no rows.
    """
    exact = templates.select(F.col("name").alias("named"), F.lit(0).alias("rank"), "content").where(
        F.col("named").rlike(r"\.[^/]*\z")
    )
    bare = templates.where(F.col("name").rlike(r"\.(?:md|txt)\z")).select(
        F.regexp_replace("name", r"\.(?:md|txt)\z", "").alias("named"),
        F.when(F.col("name").endswith(".md"), 1).otherwise(2).alias("rank"),
        "content",
    )
    bare = bare.where(~F.col("named").rlike(r"\.[^/]*\z"))
    best = exact.unionByName(bare).groupBy("named").agg(F.min_by("content", "rank").alias("template"))
    return names.join(best, "named", "left").withColumn("found", F.col("template").isNotNull())


def choose_output(
    parts: DataFrame, listed: DataFrame, totals: DataFrame, sources: DataFrame, names: DataFrame, templates: DataFrame, tie=()
) -> DataFrame:
    """``project, slot, path, *tie, last, text, error``: what each project's context finally looks like.

    ``totals`` has ``project, tokens, usd``; ``sources`` the configured prompt (``project, source``),
    ``names`` an explicitly named template (``project, named``). A missing configured prompt leaves the
    rows of the raw context; the named template overrides it, and a missing one is a row with an error.
    """
    configured = resolve_source(sources, templates).select("project", F.col("template").alias("_configured"))
    explicit = resolve_name(names, templates).select("project", "named", F.col("template").alias("_explicit"))
    chosen = totals.join(configured, "project", "left").join(explicit, "project", "left")
    missing = F.col("named").isNotNull() & F.col("_explicit").isNull()
    chosen = chosen.select("project", "tokens", "usd", "named", missing.alias("missing"), F.coalesce("_explicit", "_configured").alias("template"))
    chosen = _settled(chosen)
    no_error = F.lit(None).cast("string").alias("error")
    filled = fill_template(parts, listed, chosen.where("NOT missing AND template IS NOT NULL"), tie).select("*", no_error)
    raw = parts.join(chosen.where("NOT missing AND template IS NULL").select("project"), "project", "left_semi")
    none = [F.lit(None).cast(parts.schema[c].dataType).alias(c) for c in tie]
    failed = chosen.where("missing").select(
        "project", F.lit(0).alias("slot"), F.lit("").alias("path"), *none, F.lit(True).alias("last"),
        F.lit(None).cast("string").alias("text"), F.concat(F.lit("template not found: "), "named").alias("error"),
    )
    return filled.unionByName(raw.select("project", F.lit(1).alias("slot"), "path", *tie, "last", "text", no_error)).unionByName(failed)


def context_bytes(files: DataFrame, fmt: str) -> Column:
    """Aggregate: bytes of the packed context of a group of files."""
    around = {"xml": len('<file path="">\n\n</file>'), "text": len("// file: \n")}[fmt]
    head, sep, tail = (len(part) for part in LAYOUT[fmt])
    size = F.sum(_size(files) + F.octet_length("path") + around) + (F.count(F.lit(1)) - 1) * sep + head + tail
    return size.cast("bigint")


def pack_summary(files: DataFrame, fmt: str = "xml") -> DataFrame:
    """Files, bytes, estimated tokens, cost and format per project; the template does not count.

    Sizes add up, so no context is built for it, and with a ``length`` column no content is read.
    """
    fmt = known_format(fmt)
    totals = files.groupBy("project").agg(
        F.count(F.lit(1)).alias("files"), context_bytes(files, fmt).alias("context_bytes")
    )
    counted = totals.withColumn("tokens", tok.estimate_tokens(F.col("context_bytes")))
    return counted.withColumn("usd", tok.token_cost(F.col("tokens"))).withColumn("format", F.lit(fmt))


def pack_token_summary(files: DataFrame, fmt: str = "xml", tie=(), vocabulary=None) -> DataFrame:
    """Like ``pack_summary`` with byte-pair counts of the context.

    Each file is counted on its own and the counts are summed. The cuts lie where the split
    pattern always cuts (between letters and a following blank or bracket in the file
    headers), so the sum equals the count of the joined text.
    """
    fmt = known_format(fmt)

    def fixed(text: str) -> int:
        return tok.count_text(text, vocabulary)

    key = order_key(tie).alias("key")
    if fmt == "xml":
        inner = F.concat(F.lit(' path="'), "path", F.lit('">\n'), "content", F.lit("\n</file"))
        counted = tok.token_count(files.select("project", inner.alias("body")), "body", vocabulary=vocabulary)
        total = (
            F.sum("body_tokens")
            + (F.count(F.lit(1)) - 1) * fixed(">\n\n<file")
            + fixed("<files>\n<file")
            + fixed(">\n</files>")
        )
    else:
        inner = F.concat(F.lit(" file: "), "path", F.lit("\n"), "content")
        pieces = files.select(
            "project",
            F.col("path"),
            *[F.col(c) for c in tie],
            F.concat(inner, F.lit("\n\n//")).alias("body"),
            inner.alias("last"),
        )
        counted = tok.token_count(pieces, "body", "last", vocabulary=vocabulary).withColumn("key", key)
        total = F.sum("body_tokens") + F.max_by(F.col("last_tokens") - F.col("body_tokens"), "key") + fixed("//")
    totals = counted.groupBy("project").agg(F.count(F.lit(1)).alias("files"), total.cast("bigint").alias("tokens"))
    return totals.withColumn("usd", tok.token_cost(F.col("tokens"))).withColumn("format", F.lit(fmt))

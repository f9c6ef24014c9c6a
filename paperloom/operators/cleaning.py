"""Comment removal: the rewrite of every file and the reports about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexer, segments
from ..functions.text import byte_length, extension

HTML_EXTENSIONS = (".html", ".htm")
JSX_EXTENSIONS = (".tsx", ".jsx")


def strip_html_comments(text: Column, keep_words=(), keep_doc=True) -> Column:
    """``struct(content, removed, matches)`` of a markup text; scripts inside are not read as code."""
    return segments.remove_segments(
        text, segments.HTML_COMMENT, lambda t: ~segments.keeps_comment(t, keep_words, keep_doc)
    )


def strip_code_comments(text: Column, keep_words=(), keep_doc=True, jsx: bool = False, cut: Column | None = None) -> Column:
    """``struct(content, removed, matches)`` of a JavaScript or TypeScript text.

    Lexical: strings, template literals and regex literals are recognised and kept whole. The
    flat pattern reads text between tags as code and templates as plain; where that matters
    ``cut`` brings the text already cut by the nested lexer (see ``clean_files``). With ``jsx`` an
    expression container that holds only comments goes with its braces.
    """
    return segments.remove_segments(
        text,
        segments.JSX_TOKENS if jsx else segments.CODE_TOKENS,
        lambda t: segments.is_code_comment(t) & ~segments.keeps_comment(t, keep_words, keep_doc),
        cut,
    )


def clean_files(files: DataFrame, keep_words=(), keep_doc=True, nested: bool = True) -> DataFrame:
    """Add the cleaned ``content``, the ``original``, ``removed`` and the dropped ``matches``.

    The kind of a file follows from its extension. ``keep_words`` and ``keep_doc`` are values
    or columns of ``files``, so each project can bring its own configuration. Scripts with code in
    templates or with tags are cut by the nested lexer, in Arrow batches that hold such files only;
    ``nested`` false leaves it out, for corpora without such files.
    """
    text, ext = F.col("content"), extension(F.col("path"))
    kept = [c for c in files.columns if c != "content"]
    cut = None
    if nested:
        script = F.when(~ext.isin(*HTML_EXTENSIONS), text)
        files = files.withColumn("_cut", lexer.nested_cut(script, F.coalesce(ext.isin(*JSX_EXTENSIONS), F.lit(False))))
        cut = F.col("_cut")
    result = (
        F.when(ext.isin(*HTML_EXTENSIONS), strip_html_comments(text, keep_words, keep_doc))
        .when(ext.isin(*JSX_EXTENSIONS), strip_code_comments(text, keep_words, keep_doc, jsx=True, cut=cut))
        .otherwise(strip_code_comments(text, keep_words, keep_doc, cut=cut))
    )
    # The generator keeps the rewrite from being repeated by a filter on its result.
    return files.select(*kept, text.alias("original"), F.inline(F.array(result)))


def clean_summary(cleaned: DataFrame, *keys: str) -> DataFrame:
    """Files, changes, comments and bytes per group, with the estimated tokens saved."""
    before, after = F.sum(byte_length(F.col("original"))), F.sum(byte_length(F.col("content")))
    return cleaned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files_processed"),
        F.count_if(F.col("removed") > 0).alias("files_changed"),
        F.sum("removed").alias("comments_removed"),
        before.alias("bytes_before"),
        after.alias("bytes_after"),
        (before - after).alias("bytes_saved"),
        F.round((before - after) / 4).cast("bigint").alias("tokens_saved"),
    )


def previews(cleaned: DataFrame, count: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """``project, path, removed, previews, more``: the dropped comments in text order, each on one line.

    With a ``count`` only the first are shown and ``more`` says how many follow; with ``max_bytes``
    longer ones are cut.
    """
    shown = F.col("matches") if count is None else F.slice("matches", 1, count)
    return cleaned.where("removed > 0").select(
        "project",
        "path",
        "removed",
        F.transform(shown, lambda m: segments.preview(m, max_bytes)).alias("previews"),
        (F.col("removed") - F.size(shown)).cast("bigint").alias("more"),
    )


def clean_report(cleaned: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """One row per processed file with its count and all previews; nothing is written."""
    return cleaned.select(
        "project", "path", "removed", F.transform("matches", lambda m: segments.preview(m, max_bytes)).alias("previews")
    )

"""Segment rewrite: cut a text at every match of a pattern, decide per match, join again.

One ``regexp_replace`` marks the matches and a split at the marks gives the pieces between
them and the matches in turn, so the rewrite is a narrow, JVM-side expression that scans a
text once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Comment directives that always stay, lower case.
SYSTEM_KEEP_WORDS = (
    "@ts-ignore",
    "@ts-expect-error",
    "eslint-disable",
    "prettier-ignore",
    "biome-ignore",
    "todo",
    "fixme",
)

# Fixed value: longest preview in a report of the command line.
PREVIEW_BYTES = 60

HTML_COMMENT = r"(?s)<!--.*?-->"

_DOUBLE = r'"[^"\\\n]*+(?:\\(?s:.)[^"\\\n]*+)*+"'
_SINGLE = r"'[^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+'"
_TEMPLATE = r"`[^`\\]*+(?:\\(?s:.)[^`\\]*+)*+`"
_BLOCK = r"/\*[^*]*+(?:\*(?!/)[^*]*+)*+\*/"
_LINE = r"//[^\n\r\u2028\u2029]*+"
# A slash starts a regex literal after an operator or a keyword; otherwise it divides. The
# look-behind stands behind the slash, so it is only tried at slashes.
_REGEX = (
    r"/(?<=[=(,:;!&|?{\[+~^<>%*]\s{0,8}/|\breturn\s{1,8}/|\btypeof\s{1,8}/|\bcase\s{1,8}/|\A\s{0,8}/)"
    r"(?![*/])[^/\\\[\n]*+(?:(?:\\[^\n]|\[[^\]\\\n]*+(?:\\[^\n][^\]\\\n]*+)*+\])[^/\\\[\n]*+)*+/"
)
# An expression container that holds nothing but block comments, in child position.
_JSX_EMPTY = rf"\{{(?<=(?<!=)>\s{{0,64}}\{{)\s*+(?:{_BLOCK}\s*+)++\}}(?=\s*+[<{{])"

_CODE = "|".join((_DOUBLE, _SINGLE, _TEMPLATE, _BLOCK, _LINE, _REGEX))
CODE_TOKENS = rf"(?=[\"'`/])(?:{_CODE})"
JSX_TOKENS = rf"(?=[\"'`/{{])(?:{_JSX_EMPTY}|{_CODE})"

# Cuts a text around its matches; a text that holds this noncharacter is cut the long way.
_CUT = "\uffff"


def is_code_comment(token: Column) -> Column:
    """Whether a match of the code pattern is a comment rather than a string or a regex literal."""
    return token.startswith("//") | token.startswith("/*") | token.startswith("{")


def keeps_comment(token: Column, keep_words, keep_doc) -> Column:
    """Whether a comment stays: a doc block when asked for, or one holding a directive word.

    The word test is a substring test on the lower-cased text, for HTML comments too.
    ``keep_words`` is an array column or a sequence of extra words; the system words always count.
    """
    lowered = F.lower(token)
    keep = F.lit(False)
    for word in SYSTEM_KEEP_WORDS:
        keep = keep | lowered.contains(word)
    if isinstance(keep_words, Column):
        keep = keep | F.exists(keep_words, lambda w: F.contains(lowered, F.lower(w)))
    else:
        for word in keep_words:
            keep = keep | lowered.contains(word.lower())
    doc = keep_doc if isinstance(keep_doc, Column) else F.lit(keep_doc)
    return keep | (doc & F.ltrim(token).startswith("/**"))


def _ident_at_end(piece: Column) -> Column:
    return F.right(piece, F.lit(1)).rlike(r"^[A-Za-z0-9_$]$")


def _ident_at_start(piece: Column) -> Column:
    return F.left(piece, F.lit(1)).rlike(r"^[A-Za-z0-9_$]$")


def remove_segments(text: Column, pattern: str, removes: Callable[[Column], Column], known: Column | None = None) -> Column:
    """``struct(content, removed, matches)`` after dropping the matches ``removes`` selects.

    A dropped match leaves one blank when both neighbours are identifier characters, so two
    tokens never merge, unless it is a whole expression container. ``matches`` holds the
    dropped texts in order. Where ``known`` is not null it is the text already cut: pieces at
    even places, matches at odd ones, the last piece always there.
    """
    marked = F.split(F.regexp_replace(text, pattern, f"{_CUT}$0{_CUT}"), _CUT, -1)
    apart = let(
        F.struct(
            F.split(text, pattern, -1).alias("pieces"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("tokens"),
        ),
        lambda c: F.concat(
            F.flatten(F.zip_with(F.slice(c["pieces"], 1, F.size(c["tokens"])), c["tokens"], lambda p, t: F.array(p, t))),
            F.slice(c["pieces"], -1, 1),
        ),
    )
    cut = F.when(text.contains(_CUT), apart).otherwise(marked)
    if known is not None:
        cut = F.when(known.isNotNull(), known).otherwise(cut)

    def rebuilt(part: Column) -> Column:
        token = part["token"]
        joint = _ident_at_end(part["before"]) & _ident_at_start(part["after"]) & ~token.startswith("{")
        gap = F.when(joint, F.lit(" ")).otherwise(F.lit(""))
        return F.concat(part["before"], F.when(removes(token), gap).otherwise(token))

    def rewritten(c: Column) -> Column:
        def at(place: int) -> Column:
            return F.filter(c, lambda _, i: i % 2 == place)

        def whole(ends: Column) -> Column:
            pieces, tokens = ends["pieces"], ends["tokens"]
            parts = F.arrays_zip(
                F.slice(pieces, 1, F.size(tokens)).alias("before"),
                tokens.alias("token"),
                F.slice(pieces, 2, F.size(tokens)).alias("after"),
            )
            dropped = F.filter(tokens, removes)
            content = F.concat(F.array_join(F.transform(parts, rebuilt), ""), F.element_at(pieces, -1))
            return F.struct(
                content.alias("content"), F.size(dropped).cast("bigint").alias("removed"), dropped.alias("matches")
            )

        return let(F.struct(at(0).alias("pieces"), at(1).alias("tokens")), whole)

    return let(cut, rewritten)


def preview(comment: Column, max_bytes: int | None = None) -> Column:
    """A comment on one line; with ``max_bytes`` a longer one is cut to three characters less and three
    dots (``PREVIEW_BYTES`` is what the command line shows)."""
    single = F.trim(F.regexp_replace(comment, r"[ \t\n\f\r]+", " "))
    if max_bytes is None:
        return single
    cut = F.concat(F.substring(single, 1, max_bytes - 3), F.lit("..."))
    return F.when(F.octet_length(single) <= max_bytes, single).otherwise(cut)

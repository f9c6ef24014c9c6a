"""Text expressions with the white-space and word rules the checks rely on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes, written for Java regular expressions.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
NOT_AFTER_WORD = rf"(?<!{WORD})"
NOT_BEFORE_WORD = rf"(?!{WORD})"

_RARE_LINE_END = r"[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def quote(text: str) -> str:
    """``text`` as a literal inside a regular expression."""
    return "".join("\\" + ch if ch in r"\.[]{}()*+-?^$|/#&~" else ch for ch in text)


# Every white-space character, as a set of characters to trim.
SPACE_CHARS = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def trim_space(text: Column) -> Column:
    """Drop white space of every kind from both ends (a plain trim drops blanks only)."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value`` evaluated once, however often the body refers to it.

    Inside a lambda the optimizer shares no common expressions, so a costly value that the
    body repeats would otherwise be computed per use or per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_lines(text: Column) -> Column:
    """Lines without their ends; a final line end opens no further line, empty text has none."""
    # A plain newline needs no regular expression; the other line ends are rare.
    parts = let(
        text,
        lambda t: F.when(t.rlike(_RARE_LINE_END), F.split(t, _LINE_END, -1)).otherwise(F.split(t, "\n", -1)),
    )
    return let(
        parts,
        lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p),
    )


def unix_lines(text: Column) -> Column:
    """Every kind of line end written as one newline."""
    return F.when(text.rlike(_RARE_LINE_END), F.regexp_replace(text, _LINE_END, "\n")).otherwise(text)


def normalize(text: Column) -> Column:
    """Lower case with the letter yo folded to ye."""
    return F.lower(F.replace(F.replace(text, F.lit("ё"), F.lit("е")), F.lit("Ё"), F.lit("Е")))


def extension(path: Column) -> Column:
    """Lower-cased last extension of the base name with its dot, or an empty string."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    """The directory part without a trailing slash; empty at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def clean_path(path: Column) -> Column:
    """Resolve ``.`` and ``..`` parts; a path that leaves the project becomes null."""
    stepped = F.aggregate(
        F.split(path, "/", -1),
        F.array().cast("array<string>"),
        lambda acc, part: F.when(acc.isNull() | part.isin("", "."), acc)
        .when(
            part == "..",
            F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))),
        )
        .otherwise(F.concat(acc, F.array(part))),
    )
    return F.array_join(stepped, "/")


def byte_length(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def literal_array(values) -> Column:
    """A constant array of strings, written as one literal so that long lists keep plans small."""
    values = list(values)
    if not values:
        return F.array().cast("array<string>")
    return F.split(F.lit("\x1f".join(values)), "\x1f", -1)

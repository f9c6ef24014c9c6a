"""Ignore patterns as regular expressions, built with column expressions.

One pattern becomes one look-ahead; a whole ordered rule list becomes one expression in
which the last matching rule decides, so a project's rules cost one regex evaluation.
Paths are tested with directories written as ``a/b/`` (trailing slash).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

NEVER = "(?!)"


def glob_body(pattern: Column) -> Column:
    """Regular expression of one pattern without its ``!`` and its trailing slash.

    ``*`` and ``?`` stay inside a path part, ``[...]`` is a class, a part ``**`` spans any
    number of parts. A pattern without a slash may match at any depth, one with a slash is
    tied to the root.
    """
    rooted = pattern.contains("/")
    text = F.regexp_replace(pattern, r"^/+", "")
    # Quote what a regular expression would read as an operator; classes stay as they are.
    text = F.regexp_replace(text, r"([.+(){}|$])", r"\\$1")
    text = F.regexp_replace(text, r"\^(?<!\[\^)", r"\\^")
    # Two placeholders keep the star replacements apart.
    text = F.regexp_replace(text, r"(^|/)\*\*(?=/)/", "$1\u0001")
    text = F.regexp_replace(text, r"/\*\*$", "/\u0002")
    # A part of stars only stands for a part that is there, so "a/*" does not mean "a/" itself.
    text = F.regexp_replace(text, "(?<=^|/|\u0001)\\*+(?=/|$)", "[^/]+")
    text = F.regexp_replace(text, r"\*+", "[^/]*")
    text = F.regexp_replace(text, r"\?", "[^/]")
    text = F.replace(text, F.lit("\u0001"), F.lit("(?:[^/]*/)*"))
    text = F.replace(text, F.lit("\u0002"), F.lit("[^/].*"))
    return F.concat(F.when(rooted, F.lit("")).otherwise(F.lit("(?:[^/]*/)*")), text)


def well_formed(pattern: Column) -> Column:
    """Whether every bracket closes around a plain class with ascending ranges."""
    bracket = r"\[\^?([^\[\]\^&\\]+)\]"
    ranges = F.flatten(
        F.transform(
            F.regexp_extract_all(pattern, F.lit(bracket), F.lit(1)),
            lambda body: F.regexp_extract_all(body, F.lit(r"[^-]-[^-]"), F.lit(0)),
        )
    )
    ascending = F.forall(ranges, lambda r: F.ascii(F.substring(r, 1, 1)) <= F.ascii(F.substring(r, 3, 1)))
    return ~F.regexp_replace(pattern, bracket, "").contains("[") & ascending


def rule_regex(pattern: Column, dir_only: Column) -> Column:
    """Pattern for a whole path: the named entry or anything below it. A malformed one never matches."""
    tail = F.when(dir_only, F.lit("/.*")).otherwise(F.lit("(?:/.*)?"))
    return F.when(well_formed(pattern), F.concat(glob_body(pattern), tail, F.lit(r"\z"))).otherwise(F.lit(NEVER))


def fold_rules(rules: Column) -> Column:
    """One expression for an ordered array of ``struct(ord, negated, regex)``.

    A later positive rule is one more alternative, a later negated rule guards everything
    before it; consecutive rules of one kind do not nest.
    """
    folded = F.aggregate(
        rules,
        F.lit(NEVER),
        lambda acc, r: F.when(
            r["negated"], F.concat(F.lit("(?!"), r["regex"], F.lit(")(?:"), acc, F.lit(")"))
        ).otherwise(F.concat(F.lit("(?="), r["regex"], F.lit(")|"), acc)),
    )
    return F.concat(F.lit(r"\A(?:"), folded, F.lit(")"))


def matches(path: Column, regex: Column) -> Column:
    """Test against a regex held in a column; this form keeps the last compiled pattern."""
    return F.regexp_instr(path, regex) > 0


def directory_prefixes(path: Column) -> Column:
    """Every ancestor directory, outermost first, with a trailing slash."""
    return let(
        F.split(path, "/", -1),
        lambda parts: F.transform(
            F.slice(parts, 1, F.size(parts) - 1),
            lambda _, i: F.concat(F.array_join(F.slice(parts, F.lit(1), i + 1), "/"), F.lit("/")),
        ),
    )

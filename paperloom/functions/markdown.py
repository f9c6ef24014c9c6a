"""Markdown expressions: sections, list items, table cells, lines outside code fences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NOT_AFTER_WORD, NOT_BEFORE_WORD, SPACE, WORD, literal_array, normalize, quote, split_lines, trim_space, unix_lines

# Fixed value: the line between the head and the body of a table.
TABLE_RULE = r"^\s*\|[-: |]+\|\s*$"

# Words that carry no topic.
STOPWORDS = (
    "будет", "этого", "этот", "этой", "этом", "этому", "этими",
    "который", "которой", "которая", "которые", "которых", "которым", "которого",
    "также", "чтобы", "должен", "может", "каждый", "каждая", "каждое",
    "должна", "должно", "через", "после", "перед", "между",
    "пользователь", "пользователя", "пользователей", "пользователи",
    "системы", "система", "продукт", "продукта", "список", "раздел",
    "данные", "данных", "только", "более", "менее", "того",
    "всего", "всех", "всем", "свою", "своих", "своем",
    "такой", "такая", "такое", "такие", "таких", "таким",
    "одного", "одному", "одним", "один", "одна", "одно",
    "иметь", "делать", "делает", "делают", "выполнять", "выполняет",
    "включает", "включают", "содержит", "содержат",
    "возможность", "возможности", "функция", "функции", "функционал",
    "позволяет", "нужно", "нужен", "нужна", "нужны", "можно", "нельзя",
    "является", "являются",
    "that", "this", "with", "from", "have", "will", "been",
    "they", "their", "which", "when", "user", "users", "system",
    "page", "pages", "entity", "entities", "should", "feature", "features",
    "include", "includes", "contains", "operation", "operations", "screen",
)


def section(content: Column, heading: str) -> Column:
    """Text under the first line that starts with ``heading``, up to a heading of its level or above.

    Trimmed; empty when the heading is missing. Code fences are not considered.
    """
    level = len(heading) - len(heading.lstrip("#"))
    edge = NOT_BEFORE_WORD if heading[-1:].isalnum() or heading.endswith("_") else rf"(?={WORD})"
    pattern = rf"(?md)^{quote(heading)}{edge}.*$((?s:.)*?)(?=^#{{1,{level}}} |\z)"
    return trim_space(F.regexp_extract(content, pattern, 1))


def block_from(content: Column, prefix: str) -> Column:
    """The lines from the first one starting with ``prefix`` to before the next ``## `` heading.

    The heading line is part of the block. The match is a prefix match, so a longer name
    with the same start is taken as well.
    """
    return F.regexp_extract(content, rf"(?md)(^{quote(prefix)}.*$(?s:.)*?)(?=\n## |\z)", 1)


def list_items(text: Column) -> Column:
    """Texts of bulleted and numbered items, emphasis marks removed."""
    item = rf"^{SPACE}*(?:\p{{Nd}}+\.|[-*•]){SPACE}+(.+)"
    found = F.filter(split_lines(text), lambda line: line.rlike(item))
    return F.transform(
        found,
        lambda line: trim_space(F.regexp_replace(F.regexp_extract(line, item, 1), r"\*+([^*]+)\*+", "$1")),
    )


def table_rows(text: Column) -> Column:
    """Cells of every table row (arrays of trimmed strings), rule rows left out."""
    rows = F.filter(split_lines(text), lambda line: line.contains("|") & ~line.rlike(TABLE_RULE))
    return F.transform(
        rows,
        lambda line: F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|", -1), trim_space),
    )


def first_cells(text: Column, skip=()) -> Column:
    """First cell of each table row, empty cells and the header names in ``skip`` left out."""
    cells = F.transform(table_rows(text), lambda row: F.get(row, F.lit(0)))
    kept = F.filter(cells, lambda c: c != "")
    return F.filter(kept, lambda c: ~c.isin(*skip)) if skip else kept


def keywords(text: Column) -> Column:
    """Latin and Cyrillic words of five letters or more, normalised, stopwords removed."""
    words = F.regexp_extract_all(
        text, F.lit(rf"{NOT_AFTER_WORD}[а-яёА-ЯЁa-zA-Z]{{5,}}{NOT_BEFORE_WORD}"), F.lit(0)
    )
    return F.filter(
        F.transform(words, normalize), lambda w: ~F.array_contains(literal_array(STOPWORDS), w)
    )


def blank_fences(content: Column) -> Column:
    """``content`` with fenced code and the fence lines emptied, line numbers unchanged.

    Every line whose first characters are three backquotes opens or closes a fence; an
    unclosed fence runs to the end. Cutting at the fence lines makes every second piece
    code, so no state has to be carried from line to line.
    """
    pieces = F.split(unix_lines(content), r"(?md)^[ \t\x1f\p{Z}]*```.*$", -1)
    kept = F.transform(
        pieces, lambda p, i: F.when(i % 2 == 0, p).otherwise(F.regexp_replace(p, r"[^\n]+", ""))
    )
    return F.array_join(kept, "")


def numbered_lines(content: Column) -> Column:
    """Array of ``struct(line, text)``: 1-based numbers and trimmed texts."""
    return F.transform(
        split_lines(content),
        lambda text, i: F.struct((i + 1).cast("bigint").alias("line"), trim_space(text).alias("text")),
    )


def code_block(content: Column, language: str) -> Column:
    """Body of the first fenced block of ``language``; empty when there is none."""
    return F.regexp_extract(content, rf"```{quote(language)}\n((?s:.)*?)```", 1)

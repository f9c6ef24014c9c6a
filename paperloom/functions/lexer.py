"""A pushdown lexer for scripts whose comments a flat pattern cannot tell apart.

Template literals hold code, code holds templates, and in component files tags hold text and text
holds code again. The lexer keeps a stack of modes and cuts a text at its comments. Files without
such nesting are cut by the patterns of ``segments`` and never reach it.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Modes: code up to its closing brace, the text of a template, inside a tag, between tags.
CODE, TEMPLATE, TAG, TEXT = range(4)

_BLOCK = r"/\*.*?\*/"
_LINE = r"//[^\n\r\u2028\u2029]*"
_NEXT = {
    CODE: re.compile(rf'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|{_BLOCK}|{_LINE}|[`{{}}()\[\]/<]', re.DOTALL),
    TEMPLATE: re.compile(r"\\.|`|\$\{", re.DOTALL),
    TAG: re.compile(rf'"[^"]*"|\'[^\']*\'|{_BLOCK}|{_LINE}|\{{|/>|<|>', re.DOTALL),
    TEXT: re.compile(r"\{|</[^>]*>|<(?=[A-Za-z_$>])"),
}
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_TAG_OPENS = re.compile(r"<(?:>|[A-Za-z_$](?![\w$]*\s*(?:,|\bextends\b)))")
_TAIL = re.compile(r"(?:[\w$]+|\+\+|--|[^\s])\s*\Z")
_HASHBANG = re.compile(r"#![^\n]*")

# What an expression may follow; after anything else a slash divides and "<" compares.
_BEFORE_VALUE = frozenset("=(,:;!&|?{[+-~^<>%*")
_WORDS_BEFORE_VALUE = frozenset("return typeof case in of delete void throw new do else instanceof yield await default".split())


class _Cut:
    """One pass over a text; ``found`` are the (start, end) of its comments and empty containers."""

    def __init__(self, text: str, tags: bool):
        self.text, self.tags = text, tags
        self.found: list[tuple[int, int]] = []
        #: (mode, place where it began, container among tags, open angle brackets)
        self.stack: list[list] = [[CODE, 0, False, 0]]
        self.before = ""
        self.run()

    def value_may_follow(self) -> bool:
        return not self.before or self.before in _BEFORE_VALUE or self.before in _WORDS_BEFORE_VALUE

    def run(self) -> None:
        text, at = self.text, 0
        shebang = _HASHBANG.match(text)
        if shebang:
            at = shebang.end()
        while True:
            mode = self.stack[-1][0]
            match = _NEXT[mode].search(text, at)
            if match is None:
                return
            if mode == CODE:
                # only what stands right before the token matters, so a bounded look back does
                last = _TAIL.search(text, max(at, match.start() - 80), match.start())
                if last:
                    self.before = last[0].rstrip()
                at = self.code(match)
            elif mode == TEMPLATE:
                at = self.template(match)
            elif mode == TAG:
                at = self.tag(match)
            else:
                at = self.between(match)

    def code(self, match: re.Match) -> int:
        token, start, end = match[0], match.start(), match.end()
        if token.startswith(("//", "/*")):
            self.found.append((start, end))
            return end
        if token == "`":
            self.stack.append([TEMPLATE, start, False, 0])
        elif token == "/":
            literal = _REGEX.match(self.text, start) if self.value_may_follow() else None
            self.before = "literal" if literal else "/"
            return literal.end() if literal else end
        elif token == "<":
            if self.tags and self.value_may_follow() and _TAG_OPENS.match(self.text, start):
                return self.open_tag(start)
            self.before = token
        elif token == "{":
            self.stack.append([CODE, start, False, 0])
            self.before = token
        elif token == "}":
            self.close(start, end)
        else:
            self.before = "literal" if token[0] in "\"'" else token
        return end

    def close(self, start: int, end: int) -> None:
        if len(self.stack) > 1:
            _, opened, container, _ = self.stack.pop()
            if container:
                self.empty_container(opened, end)
        self.before = "}"

    def empty_container(self, opened: int, end: int) -> None:
        """A container that holds nothing but comments goes as one."""
        inside, at = [], opened + 1
        count = len(self.found)
        while count and self.found[count - 1][0] > opened:
            count -= 1
        for start, stop in self.found[count:]:
            inside.append(self.text[at:start])
            at = stop
        inside.append(self.text[at : end - 1])
        if len(inside) > 1 and not any(map(str.strip, inside)):
            self.found[count:] = [(opened, end)]

    def template(self, match: re.Match) -> int:
        if match[0] == "`":
            self.stack.pop()
            self.before = "literal"
        elif match[0] == "${":
            self.stack.append([CODE, match.start() + 1, False, 0])
            self.before = ""
        return match.end()

    def open_tag(self, start: int) -> int:
        if self.text.startswith("<>", start):
            self.stack.append([TEXT, start, False, 0])
            return start + 2
        self.stack.append([TAG, start, False, 0])
        return start + 1

    def tag(self, match: re.Match) -> int:
        token, top = match[0], self.stack[-1]
        if token.startswith(("//", "/*")):
            self.found.append((match.start(), match.end()))
        elif token == "{":
            self.container(match.start())
        elif token == "/>":
            self.stack.pop()
            self.before = "literal"
        elif token == "<":
            top[3] += 1
        elif token == ">":
            if top[3]:
                top[3] -= 1
            else:
                top[0] = TEXT
        return match.end()

    def container(self, start: int) -> None:
        self.stack.append([CODE, start, True, 0])
        self.before = ""

    def between(self, match: re.Match) -> int:
        if match[0] == "{":
            self.container(match.start())
        elif match[0] == "<":
            return self.open_tag(match.start())
        else:
            self.stack.pop()
            self.before = "literal"
        return match.end()


def cut(text: str, tags: bool) -> list[str]:
    """Pieces between the comments of a script at even places, the comments at odd ones.

    With ``tags`` the text may hold elements; should they not close, they were none, and the text is
    read without them. Unclosed comments and strings are ordinary text.
    """
    lexed = _Cut(text, tags)
    if tags and any(mode in (TAG, TEXT) for mode, *_ in lexed.stack):
        lexed = _Cut(text, False)
    out, at = [], 0
    for start, end in lexed.found:
        out += [text[at:start], text[start:end]]
        at = end
    return [*out, text[at:]]


@F.pandas_udf(ArrayType(StringType()))
def _cuts(texts: pd.Series, tags: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else cut(t, bool(j)) for t, j in zip(texts, tags, strict=True)], dtype=object)


def nests(text: Column, tags: Column) -> Column:
    """Whether a script has comment marks and may nest: code in a template, or tags among code."""
    marked = text.contains("//") | text.contains("/*")
    return marked & (text.contains("${") | (tags & text.rlike(r"<[A-Za-z_$>]")))


def nested_cut(text: Column, tags: Column) -> Column:
    """``cut`` of the texts that nest, null for the others, which are not sent to Python."""
    return _cuts(F.when(nests(text, tags), text), tags)

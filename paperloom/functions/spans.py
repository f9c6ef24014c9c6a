"""Matches of many patterns in one pass: an automaton over all hints, patterns only where a hint is."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from typing import NamedTuple

_LOWER = {c: c + 32 for c in range(65, 91)}


class Pattern(NamedTuple):
    """``hints`` are lower-case words of which every match holds one; group 1 of ``regex`` is the value."""

    hints: tuple[str, ...]
    regex: str


class SpanFinder:
    """Finds the matches of named patterns in the lines of a text, leaving out those whose own value
    ``placeholder`` matches whole."""

    def __init__(self, patterns: Mapping[str, Pattern], placeholder: str):
        import ahocorasick

        self.regexes = {name: re.compile(p.regex) for name, p in patterns.items()}
        self.placeholder = re.compile(placeholder)
        by_hint: dict[str, list[str]] = {}
        for name, pattern in patterns.items():
            for hint in pattern.hints:
                by_hint.setdefault(hint, []).append(name)
        self.automaton = ahocorasick.Automaton()
        for hint, names in by_hint.items():
            self.automaton.add_word(hint, tuple(names))
        self.automaton.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int, str, int, str]]:
        """(line from 1, pattern, number of the match among those of its pattern in the line, value)."""
        hits = list(self.automaton.iter(text.translate(_LOWER)))
        if not hits:
            return
        lines = text.split("\n")
        ends, at = [], -1
        for line in lines:
            at += len(line) + 1
            ends.append(at - 1)
        wanted = {(bisect_right(ends, end - 1), name) for end, names in hits for name in names}
        for number, name in sorted(wanted):
            for n, match in enumerate(self.regexes[name].finditer(lines[number]), 1):
                if not self.placeholder.fullmatch(match[1]):
                    yield number + 1, name, n, match[1]

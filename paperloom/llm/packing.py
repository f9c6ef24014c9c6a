"""Sum-of-squares packing of tokenised documents into windows of a fixed number of tokens.

Each task packs the documents it reads, online: whole windows are cut off a long document, and the
rest goes to the fill level that keeps the sum of the squared counts of partly filled windows
smallest. A level array holds those counts. When the input ends, or too many windows are open,
their contents are poured into full windows; what remains at the end of a task is less than one
window and is cut at powers of two, which need no padding. Nothing is shuffled: tasks
do not share windows, and a repeated task gives the same windows again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.words import slices

WINDOW = 4096
END_ID = 2
#: Open windows a task may hold, each with at most ``window`` ids.
OPEN_WINDOWS = 1024
#: Distinct words whose ids a worker remembers, and the longest word remembered.
WORDS_KEPT = 600_000
LONGEST_KEPT = 48

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class WordEncoder:
    """Ids of texts, remembered word by word. A vocabulary whose pre-tokenizer never joins
    across white space gives the same ids for a text as for its words one after another.

    Two generations are remembered: when the newer is full it becomes the older, and words met
    again come back into the newer."""

    def __init__(self, definition: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        self.table = [np.array([i], "<u4").tobytes() for i in range(self.tokenizer.get_vocab_size())]
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.end = np.array([end_id], "<u4").tobytes()
        # whether case does not matter, and a word of plain letters is one piece for the model; probed
        # on words of several kinds, and else every word takes the whole way through the library
        probes = [b"a", b"the", b"qzx", b"internationalisation", b"s", b"xyzzyplugh"]
        self.folds = self._whole([p.upper() for p in probes]) == self._whole(probes)
        self.plain = self.folds and self._whole(probes) == [self._letters(p) for p in probes]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text and the end id, as little-endian 32-bit numbers."""
        split = [self._words(text or "") for text in texts]
        if len(self.known) > WORDS_KEPT:
            self.known, self.older = {}, self.known
        known, older, long = self.known, self.older, {}
        rest = []
        fresh: set[bytes] = set()
        for words in split:
            fresh.update(filterfalse(known.__contains__, words))
        for word in fresh:
            ids = older.get(word)
            if ids is None and self.plain:
                if word.isalpha() and word.islower():
                    ids = self._letters(word)
                elif word[-1] in b".,;:!|" and word[:-1].isalpha() and word.islower():
                    # letters end a piece, and so does the end of the word
                    mark = word[-1:]
                    if mark not in known:
                        known[mark] = self._whole([mark])[0]
                    ids = (known.get(word[:-1]) or self._letters(word[:-1])) + known[mark]
            if ids is None:
                rest.append(word)
            elif len(word) <= LONGEST_KEPT:
                known[word] = ids
            else:
                long[word] = ids
        for word, ids in zip(rest, self._whole(rest), strict=True):
            (known if len(word) <= LONGEST_KEPT else long)[word] = ids
        look = known.__getitem__ if not long else lambda word: known[word] if word in known else long[word]
        return [b"".join(map(look, words)) + self.end for words in split]

    def _words(self, text: str) -> list[bytes]:
        """Words of a text, capitals of the basic alphabet folded unless a combining mark (the bytes
        0xCC and 0xCD begin those that join with such letters) might make that matter."""
        data = text.encode()
        return (data.lower() if self.folds and b"\xcc" not in data and b"\xcd" not in data else data).split()

    def _letters(self, word: bytes) -> bytes:
        table = self.table
        return b"".join([table[token.id] for token in self.model.tokenize(word.decode())])

    def _whole(self, words: list[bytes]) -> list[bytes]:
        table = self.table
        out = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [b"".join([table[i] for i in x.ids]) for x in out]


class Packer:
    """Online packing of byte strings of 4-byte ids; ``pieces`` collects finished rows."""

    def __init__(self, first_sequence: int, window: int = WINDOW):
        self.window = window
        self.next_sequence = first_sequence
        self.levels = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = {}
        self.n_open = 0
        self.pieces: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, start, size = len(ids) // 4, 0, self.window
        while total - start >= size:
            self._close([(doc_id, start, ids[4 * start : 4 * (start + size)], total)])
            start += size
        if start < total:
            self._place((doc_id, start, ids[4 * start :], total))

    def _place(self, piece: tuple) -> None:
        """Filling level h to h + s changes the sum of squares by 2 (N[h+s] - N[h]) + 2, opening a
        window by 2 N[s] + 1; levels 0 and full count nothing."""
        size = len(piece[2]) // 4
        change = 2 * (self.levels[size:] - self.levels[: self.window + 1 - size]) + 2
        change[self.levels[: len(change)] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * self.levels[size] + 1
        if len(change) > 1 and self.levels[self.window - size]:
            change[-1] = 1 - 2 * self.levels[self.window - size]
        level = int(np.argmin(change))
        window = self.open[level].pop() if level else []
        self.levels[level] -= level > 0
        self.n_open += (level == 0) - (level + size == self.window)
        window.append(piece)
        if level + size == self.window:
            self._close(window)
        else:
            self.levels[level + size] += 1
            self.open.setdefault(level + size, []).append(window)
            if self.n_open > OPEN_WINDOWS:
                self._pour(False)

    def _pour(self, last: bool) -> None:
        """Empty the open windows, fullest first, into full ones. The rest, less than a window,
        stays open or, at the end, is cut at powers of two."""
        queue = [p for level in sorted(self.open, reverse=True) for w in self.open[level] for p in w]
        left = sum(len(p[2]) // 4 for p in queue)
        self.open, self.n_open = {}, 0
        self.levels[:] = 0
        goal, current, filled = self._goal(left, last), [], 0
        for doc_id, start, ids, total in queue:
            at, size = 0, len(ids) // 4
            while at < size:
                take = min(size - at, goal - filled)
                current.append((doc_id, start + at, ids[4 * at : 4 * (at + take)], total))
                at, filled = at + take, filled + take
                if filled == goal:
                    self._close(current)
                    left -= goal
                    current, filled = [], 0
                    goal = self._goal(left, last)
        if current:
            self.open, self.n_open = {filled: [current]}, 1
            self.levels[filled] = 1

    def _goal(self, left: int, last: bool) -> int:
        return self.window if left >= self.window or not last else 1 << max(0, left.bit_length() - 1)

    def _close(self, window: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in window:
            self.pieces.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, self.next_sequence, offset))
            offset += len(ids) // 4
        self.next_sequence += 1

    def finish(self) -> None:
        self._pour(True)

    def take(self) -> list[tuple]:
        out, self.pieces = self.pieces, []
        return out


def pack(documents: DataFrame, definition: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents in windows of at most ``window`` tokens. ``definition`` is the text
    of a tokenizer file whose pre-tokenizer splits at white space. Every document has at least one
    piece (a null or empty text holds the end id alone); a null doc_id is passed on; rows that
    share an id are packed separately; other columns are ignored; no rows give no pieces. Sequence
    ids are unique; those of one task follow each other."""
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    sent = documents.sparkSession.sparkContext.broadcast(definition)  # the vocabulary file, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value, end_id)
        context = TaskContext.get()
        packer = Packer((context.partitionId() if context else 0) << 33, window)
        for batch in batches:
            for part in slices(batch):
                ids = encoder.encode(part.column("text").to_pylist())
                for doc_id, own in zip(part.column("doc_id").to_pylist(), ids, strict=True):
                    packer.add(doc_id, own)
                yield _rows(packer.take())
        packer.finish()
        yield _rows(packer.take())

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SCHEMA)


_ENCODERS: dict[tuple, WordEncoder] = {}


def _encoder(definition: str, end_id: int) -> WordEncoder:
    """One encoder for each worker process; its memory of words outlives the task."""
    key = (zlib.crc32(definition.encode()), end_id)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(definition, end_id)
    return _ENCODERS[key]


def _rows(pieces: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    columns = list(zip(*pieces, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

"""Byte-level BPE by a lazily determinised transducer, and its streaming decoder.

A rank table gives every string of bytes one tokenisation, and two neighbouring tokens of it are
always a pair that the merges leave as it is. Reading bytes from the left, every prefix therefore
has exactly one last token, found among the tokens that end there. The nondeterministic machine
keeps all prefixes from which an unfinished token may still start; a state of the determinised one
is that set with the tokens not yet certain. Tokens which all members share are emitted, so output
lags by the longest token at most. States and transitions are made when first needed.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.words import slices

#: States, pieces and pairs a worker remembers before it starts afresh.
STATES_KEPT = 200_000
UNITS_KEPT = 300_000
PAIRS_KEPT = 400_000
LONGEST_KEPT = 48

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def read_ranks(content: bytes) -> dict[bytes, int]:
    """The tokens of a rank file: a line holds a token in base64 and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}


class State:
    __slots__ = ("final", "members", "moves")

    def __init__(self, members: tuple):
        self.members = members  # (trie node, last token, pending tokens), the longest open token first
        self.final = members[-1][2]
        self.moves: dict[int, tuple[State, tuple[int, ...]]] = {}


class Transducer:
    """Encodes byte strings by merge ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.nodes: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                step = self.nodes[node].get(byte)
                if step is None:
                    step = self.nodes[node][byte] = len(self.nodes)
                    self.nodes.append({})
                    self.token_at.append(-1)
                node = step
            self.token_at[node] = rank
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.edges: dict[int, tuple[list, list]] = {}
        self._forget()

    def _forget(self) -> None:
        for state in getattr(self, "states", {}).values():
            state.moves.clear()  # states point at each other
        self.pairs: dict[tuple[int, int], bool] = {}
        self.states: dict[tuple, State] = {}
        self.members: dict[tuple, tuple] = {}
        self.start = self._state(((0, -1, ()),))

    def _state(self, members: tuple) -> State:
        state = self.states.get(members)
        if state is None:
            members = tuple([self.members.setdefault(m, m) for m in members])
            state = self.states[members] = State(members)
        return state

    def _edges(self, token: int) -> tuple[list, list]:
        """The parts of a token that its merges have, one after another, at its left and at its
        right end: (bytes, rank) from a single byte up to the whole."""
        found = self.edges.get(token)
        if found is None:
            parts = [bytes([b]) for b in self.bytes_of[token]]
            first, last = [(parts[0], -1)], [(parts[-1], -1)]
            while True:
                joined = [(rank, i) for i in range(len(parts) - 1) if (rank := self.ranks.get(parts[i] + parts[i + 1])) is not None]
                if not joined:
                    break
                rank, i = min(joined)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                if i == 0:
                    first.append((parts[0], rank))
                if i == len(parts) - 1:
                    last.append((parts[-1], rank))
            found = self.edges[token] = first, last
        return found

    def stays(self, left: int, right: int) -> bool:
        """Whether the merges leave two tokens side by side. Only parts that touch the seam matter:
        the tokens stay if no merge across it is due before the next merge on either side."""
        known = self.pairs.get((left, right))
        if known is None:
            ends, starts, i, j, never = self._edges(left)[1], self._edges(right)[0], 0, 0, 1 << 60
            known = True
            while known:
                next_end = ends[i + 1][1] if i + 1 < len(ends) else never
                next_start = starts[j + 1][1] if j + 1 < len(starts) else never
                across = self.ranks.get(ends[i][0] + starts[j][0], never)
                known = across >= next_end or across > next_start
                if next_end == never and next_start == never:
                    known = across == never
                    break
                if next_end <= next_start:
                    i += 1
                else:
                    j += 1
            self.pairs[left, right] = known
        return known

    def _move(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        if len(self.states) >= STATES_KEPT or len(self.pairs) >= PAIRS_KEPT:
            self._forget()  # even inside a piece: the state at work is all that is needed
        members, ended = [], None
        for node, last, pending in state.members:
            step = self.nodes[node].get(byte)
            if step is None:
                continue
            token = self.token_at[step]
            if ended is None and token >= 0 and (last < 0 or self.stays(last, token)):
                ended = (0, token, (*pending, token))
            if self.nodes[step]:
                members.append((step, last, pending))
        members.append(ended)
        sure, agreed = 0, members[0][2]
        for token in agreed:
            if not all(len(m[2]) > sure and m[2][sure] == token for m in members):
                break
            sure += 1
        if sure:
            members = [(n, t, p[sure:]) for n, t, p in members]
        move = state.moves[byte] = self._state(tuple(members)), agreed[:sure]
        return move

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Token ids of a byte string that arrives in chunks, each as soon as it is certain."""
        state = self.start
        for chunk in chunks:
            for byte in chunk:
                state, emitted = state.moves.get(byte) or self._move(state, byte)
                yield from emitted
        yield from state.final

    def encode(self, piece: bytes) -> list[int]:
        out: list[int] = []
        state = self.start
        for byte in piece:
            state, emitted = state.moves.get(byte) or self._move(state, byte)
            if emitted:
                out += emitted
        out += state.final
        return out


class Decoder:
    """Text of token ids, streamed: the state is the bytes of a character that is not complete, and
    each state knows for every token met so far what it adds and where it leads."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.tables: dict[bytes, dict[int, tuple[str, bytes]]] = {b"": {}}
        #: Tokens that are whole characters: from the empty state back to it.
        self.complete = {}
        for token, data in bytes_of.items():
            text, rest = self.advance(b"", data)
            if not rest and text.encode() == data:
                self.complete[token] = text

    @staticmethod
    def advance(pending: bytes, token: bytes) -> tuple[str, bytes]:
        """Complete characters of pending + token, and the bytes left; a byte that cannot go on
        becomes the replacement character."""
        data = pending + token
        tail = 0
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 != 0x80:
                need = 2 if byte & 0xE0 == 0xC0 else 3 if byte & 0xF0 == 0xE0 else 4 if byte & 0xF8 == 0xF0 else 1
                tail = back if need > back else 0
                break
        cut = len(data) - tail
        return data[:cut].decode("utf-8", "replace"), data[cut:]

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        pending = b""
        for token in ids:
            table = self.tables.get(pending)
            if table is None:
                table = self.tables[pending] = {}
            step = table.get(token)
            if step is None:
                step = table[token] = self.advance(pending, self.bytes_of[token])
            text, pending = step
            yield text
        if pending:
            yield pending.decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        """The whole text; where every token is whole characters, no state but the empty one occurs."""
        try:
            return "".join([self.complete[token] for token in ids])
        except KeyError:
            return "".join(self.stream(ids))


#: White space other than blank and line feed, by any definition of it.
_OTHER_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]")
#: A run of blanks and line feeds with what follows. The split pattern always cuts where such a
#: run begins, since its matches have white space only at their start or throughout.
_UNIT = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Letters and digits of a part of Unicode for which they are easily told, and all its characters.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(rf"[\t\n\x0b-\r -~¡-¬®-±´¶-¸»¿×÷–—‘’“”…{_LETTERS}]*")


def _plain_pattern(pattern: str) -> re.Pattern | None:
    """The split pattern for texts of ``_PLAIN`` characters, which the standard library matches faster;
    none if it speaks of other classes than letters and numbers."""
    out, inside = [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.DOTALL):
        inside = part == "[" or inside and part != "]"
        letters = {r"\p{L}": _LETTERS, r"\p{N}": "0-9"}.get(part)
        out.append(part if letters is None else letters if inside else f"[{letters}]")
    try:
        return re.compile("".join(out))
    except re.error:
        return None


class Codec:
    """Splits texts by the pattern, encodes each match on its own and decodes ids; remembers the
    ids of matches, or of units (a word with the blanks before it), in two generations. Only for split
    patterns of the usual kind, which never join other characters to white space after them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.split = regex.compile(pattern).findall
        plain = _plain_pattern(pattern)
        self.quick = plain.findall if plain else None
        self.transducer = Transducer(ranks)
        self.decoder = Decoder(self.transducer.bytes_of)
        self.units: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _keep(self, unit: str, ids: tuple[int, ...]) -> tuple[int, ...]:
        if len(unit) <= LONGEST_KEPT:
            if len(self.units) >= UNITS_KEPT:
                self.older = dict(self.units)
                self.units.clear()
            self.units[unit] = ids
        return ids

    def _piece(self, piece: str) -> tuple[int, ...]:
        return self._keep(piece, self.older.get(piece) or tuple(self.transducer.encode(piece.encode())))

    def _unit(self, unit: str) -> tuple[int, ...]:
        known = self.older.get(unit)
        encode = self.transducer.encode
        return self._keep(unit, known or tuple([token for piece in self.split(unit) for token in encode(piece.encode())]))

    def encode(self, text: str) -> list[int]:
        if self.quick and _PLAIN.fullmatch(text):
            parts, make = self.quick(text), self._piece
        else:
            parts, make = [text] if _OTHER_SPACE.search(text) else _UNIT.findall(text), self._unit
        get, out = self.units.get, []
        for part in parts:
            out += get(part) or make(part)
        return out

    def decode(self, ids: list[int]) -> str:
        return self.decoder.decode(ids)


_CODECS: dict[tuple, Codec] = {}


def codec(rank_file: bytes, pattern: str) -> Codec:
    """One codec for each worker process; what it has learnt outlives the task."""
    key = (hashlib.sha256(rank_file).digest(), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(read_ranks(rank_file), pattern)
        # the tables hold no cycles; scanning them again and again would cost more than encoding
        gc.freeze()
        gc.set_threshold(200_000, 50, 1000)
    return _CODECS[key]


def encode_documents(documents: DataFrame, rank_file: bytes, pattern: str) -> DataFrame:
    """Columns doc_id, ids (array of int) of every whole text. A null text has no ids; equal rows get
    equal ids; other columns are ignored; an empty table gives an empty result."""
    sent = documents.sparkSession.sparkContext.broadcast((rank_file, pattern))  # a vocabulary of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*sent.value)
        for batch in batches:
            for part in slices(batch):
                ids = pa.array([own.encode(t or "") for t in part.column("text").to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], names=["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, rank_file: bytes, pattern: str) -> DataFrame:
    """Columns doc_id, text from columns doc_id, ids; null ids give an empty text."""
    sent = encoded.sparkSession.sparkContext.broadcast((rank_file, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*sent.value)
        for batch in batches:
            texts = pa.array([own.decode(ids or []) for ids in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint"), "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(documents: DataFrame, rank_file: bytes, pattern: str) -> DataFrame:
    """Digests of encoding and decoding in one pass over the texts: n_tokens, ids_sha256 (decimal
    ids joined by one space) and decoded_sha256 (the bytes decoded from those ids)."""
    sent = documents.sparkSession.sparkContext.broadcast((rank_file, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*sent.value)
        said = [str(i) for i in range(max(own.decoder.bytes_of) + 1)]
        for batch in batches:
            for part in slices(batch):
                counts, ids_sha, text_sha = [], [], []
                for text in part.column("text").to_pylist():
                    ids = own.encode(text or "")
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(" ".join([said[i] for i in ids]).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
                columns = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SCHEMA)

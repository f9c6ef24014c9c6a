"""SentencePiece encoding and decoding by a prefix table of last tokens.

In a merge-type model every prefix of a text has one encoding, so one last piece. Reading from the
left, an automaton finds all pieces that end at a position; the last one of the prefix is the piece
that the merges leave alone beside the last piece of the prefix before it. The table of last pieces
is filled in one pass and the ids are read from it backwards.

For models whose normaliser maps no characters and that have no user-defined or unused pieces;
others raise a ValueError.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.words import slices

#: Cores and pairs of pieces a worker remembers before it starts afresh.
CORES_KEPT = 300_000
PAIRS_KEPT = 1_000_000
LONGEST_KEPT = 48
BLANK = "▁"

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class Model(NamedTuple):
    """What is needed of a model file, of the size of its vocabulary."""

    pieces: tuple[str, ...]
    kinds: tuple[int, ...]
    scores: tuple[float, ...]
    dummy_prefix: bool
    trims: bool
    byte_fallback: bool
    unknown_surface: str


#: Kinds of pieces in a model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def read_model(content: bytes) -> Model:
    """The vocabulary and the settings of a model file."""
    from sentencepiece import sentencepiece_model_pb2 as formats

    proto = formats.ModelProto()
    proto.ParseFromString(content)
    rules, trained = proto.normalizer_spec, proto.trainer_spec
    kinds = tuple(int(p.type) for p in proto.pieces)
    if trained.model_type != formats.TrainerSpec.BPE or not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("only merge-type models of normal, byte, control and unknown pieces are read")
    if rules.precompiled_charsmap or not rules.escape_whitespaces or trained.treat_whitespace_as_suffix:
        raise ValueError("only models that leave characters as they are and escape blanks before words are read")
    return Model(
        tuple(p.piece for p in proto.pieces),
        kinds,
        tuple(float(p.score) for p in proto.pieces),
        bool(rules.add_dummy_prefix),
        bool(rules.remove_extra_whitespaces),
        bool(trained.byte_fallback),
        trained.unk_surface,
    )


def merged(text: str, scores: dict[str, float]) -> list[str]:
    """The definition: join the neighbours whose union scores highest, the leftmost first, to the end.
    Quadratic, for a piece or a pair of pieces only."""
    parts = list(text)
    while True:
        found = [(-score, i) for i in range(len(parts) - 1) if (score := scores.get(parts[i] + parts[i + 1])) is not None]
        if not found:
            return parts
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


class Encoder:
    """Ids of texts. ``pieces`` that the merges never yield take no part; characters outside the
    vocabulary stand alone."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model = model
        self.scores = {p: s for p, s, kind in zip(model.pieces, model.scores, model.kinds, strict=True) if kind == NORMAL}
        ids = {p: i for i, (p, kind) in enumerate(zip(model.pieces, model.kinds, strict=True)) if kind == NORMAL}
        bytes_at = {int(p[3:5], 16): i for i, (p, kind) in enumerate(zip(model.pieces, model.kinds, strict=True)) if kind == BYTE}
        unknown = model.kinds.index(UNKNOWN) if UNKNOWN in model.kinds else 0
        #: Characters of pieces; any other character is never merged.
        self.known = set("".join(ids))
        self.names = [p for p in ids if merged(p, self.scores) == [p]]
        self.names += sorted(self.known - set(self.names))
        self.lone = lambda c: tuple(bytes_at[b] for b in c.encode()) if model.byte_fallback else (unknown,)
        self.ids = [(ids[p],) if p in ids else self.lone(p) for p in self.names]
        self.automaton = ahocorasick.Automaton()
        for at, name in enumerate(self.names):
            self.automaton.add_word(name, (at, len(name)))
        self.automaton.make_automaton()
        self.lengths = list(map(len, self.names))
        self.size = len(self.names)
        #: Neighbouring characters within pieces; a seam between others is never closed.
        self.joints = {name[i : i + 2] for name in self.names for i in range(len(name) - 1)}
        self.pairs: dict[int, bool] = {}
        #: Cores met since the last change of generation, and those of the generation before.
        self.cores: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.cut = self._cutter()

    def _cutter(self):
        """A function that cuts a text where no piece spans the seam. Characters fall into families that
        pieces connect (an alphabet, the punctuation); a core is a run of one family, with the blanks
        before it if pieces have blanks only in front."""
        if any(BLANK in name.lstrip(BLANK) for name in self.names):
            return lambda text: re.findall("[%s]+|." % "".join(map(re.escape, sorted(self.known))), text, re.DOTALL)
        family = {c: {c} for c in self.known}
        for left, right in self.joints:
            a, b = family[left], family[right]
            if left != BLANK and a is not b:
                a, b = sorted((a, b), key=len)
                b |= a
                for c in a:
                    family[c] = b
        own = {id(members): "".join(sorted(members)) for c, members in family.items() if c != BLANK}
        single = [members for members in sorted(own.values()) if len(members) == 1 and members * 2 not in self.joints]
        several = sorted((re.escape(members) for members in set(own.values()).difference(single)), key=len, reverse=True)
        alone = "".join(map(re.escape, single))
        kinds = [f"[{members}]+" for members in several] + [f"[{alone}]"] * bool(alone)
        return re.compile(f"{BLANK}*(?:{'|'.join(kinds)})|{BLANK}+|." if kinds else ".", re.DOTALL).findall

    def stays(self, left: int, right: int) -> bool:
        """Whether the merges leave two pieces side by side."""
        known = self.pairs.get(left * self.size + right)
        if known is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            a, b = self.names[left], self.names[right]
            known = a[-1] + b[0] not in self.joints or merged(a + b, self.scores) == [a, b]
            self.pairs[left * self.size + right] = known
        return known

    def table(self, chunk: str) -> list[int]:
        """The last piece of every prefix of a run of known characters; place 0 is the empty prefix."""
        last, size, known, stays = [-1] * (len(chunk) + 1), self.size, self.pairs.get, self.stays
        for end, (piece, length) in self.automaton.iter(chunk):
            end += 1
            if last[end] < 0:
                start = end - length
                if not start:
                    last[end] = piece
                    continue
                fits = known(last[start] * size + piece)
                if fits or fits is None and stays(last[start], piece):
                    last[end] = piece
        return last

    def _core(self, core: str) -> tuple[int, ...]:
        ids = self.older.get(core)
        if ids is None:
            if core[0] in self.known:
                last, at, back, lengths = self.table(core), len(core), [], self.lengths
                while at:
                    back.append(last[at])
                    at -= lengths[last[at]]
                ids = tuple([i for piece in reversed(back) for i in self.ids[piece]])
            else:
                ids = self.lone(core)
        if len(core) <= LONGEST_KEPT:
            if len(self.cores) >= CORES_KEPT:
                self.older = dict(self.cores)
                self.cores.clear()
            self.cores[core] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        model = self.model
        if model.trims:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return []
        text = (BLANK if model.dummy_prefix else "") + text.replace(" ", BLANK)
        get, make, out = self.cores.get, self._core, []
        for core in self.cut(text):
            out += get(core) or make(core)
        return out


def _resume(error: UnicodeError):
    return "�", error.start + 1


codecs.register_error("one_byte_replaced", _resume)


class Decoder:
    """Texts of ids. Runs of byte pieces are read as UTF-8, each byte that fits no character becoming
    the replacement character; control pieces vanish; an id outside the vocabulary raises an IndexError."""

    def __init__(self, model: Model):
        self.model = model
        self.strips = model.dummy_prefix or model.trims
        self.surfaces: list[str | None] = []
        for piece, kind in zip(model.pieces, model.kinds, strict=True):
            if kind == BYTE:  # a byte of ASCII is a character wherever it stands
                byte = int(piece[3:5], 16)
                self.surfaces.append(chr(byte) if byte < 128 else None)
            else:
                self.surfaces.append({UNKNOWN: model.unknown_surface, CONTROL: ""}.get(kind, piece.replace(BLANK, " ")))

    def decode(self, ids: list[int]) -> str:
        if not ids:
            return ""
        out, surfaces = self._first(ids)
        try:
            return "".join(out + surfaces)
        except TypeError:  # a byte piece beyond ASCII has no surface of its own
            return "".join(self._joined(out, ids[len(ids) - len(surfaces) :], surfaces))

    def _first(self, ids: list[int]) -> tuple[list[str], list[str | None]]:
        """The surface of the ids up to the first that has any, less its leading blank, and the rest."""
        if min(ids) < 0:
            raise IndexError(min(ids))
        surfaces = list(map(self.surfaces.__getitem__, ids))
        if not self.strips:
            return [], surfaces
        at = 0
        while at < len(ids) and surfaces[at] is not None:
            text = surfaces[at]
            if self.model.kinds[ids[at]] == NORMAL and text.startswith(" "):
                if not self.model.trims:
                    return [text[1:]], surfaces[at + 1 :]
                text = text[1:]
            if text:
                return [text], surfaces[at + 1 :]
            at += 1
        return [], surfaces[at:]

    def _joined(self, out: list[str], ids: list[int], surfaces: list[str | None]) -> Iterator[str]:
        yield from out
        held = bytearray()
        for i, surface in zip(ids, surfaces, strict=True):
            if surface is None:
                held.append(int(self.model.pieces[i][3:5], 16))
                continue
            if held:
                yield held.decode("utf-8", "one_byte_replaced")
                held.clear()
            yield surface
        yield held.decode("utf-8", "one_byte_replaced")


_KEPT: dict[str, tuple[Encoder, Decoder]] = {}


def _codec(model: Model) -> tuple[Encoder, Decoder]:
    """One encoder and decoder for each worker process; what they have learnt outlives the task."""
    key = hashlib.sha256(repr(model).encode()).hexdigest()
    if key not in _KEPT:
        _KEPT[key] = Encoder(model), Decoder(model)
    return _KEPT[key]


def encode_documents(documents: DataFrame, model_file: bytes) -> DataFrame:
    """Columns doc_id, ids (array of int) of every whole text. A null or empty text has no ids; equal
    rows get equal ids; other columns are ignored; an empty table gives an empty result. Memory per
    task grows with the longest run of known characters without a blank, not with the table."""
    sent = documents.sparkSession.sparkContext.broadcast(read_model(model_file))  # a vocabulary of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _codec(sent.value)[0].encode
        for batch in batches:
            for part in slices(batch):
                ids = pa.array([encode(t or "") for t in part.column("text").to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], names=["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, model_file: bytes) -> DataFrame:
    """Columns doc_id, text from columns doc_id, ids; null ids give an empty text."""
    sent = encoded.sparkSession.sparkContext.broadcast(read_model(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _codec(sent.value)[1].decode
        for batch in batches:
            texts = pa.array([decode(ids or []) for ids in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint"), "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(documents: DataFrame, model_file: bytes) -> DataFrame:
    """Digests of encoding and decoding in one pass over the texts: n_tokens, ids_sha256 (decimal ids
    joined by commas) and decoded_sha256 (the text decoded from those ids, in UTF-8)."""
    sent = documents.sparkSession.sparkContext.broadcast(read_model(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _codec(sent.value)
        said = [str(i) for i in range(len(sent.value.pieces))]
        for batch in batches:
            for part in slices(batch):
                counts, ids_sha, text_sha = [], [], []
                for text in part.column("text").to_pylist():
                    ids = encoder.encode(text or "")
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(said.__getitem__, ids)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(decoder.decode(ids).encode()).hexdigest())
                columns = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SCHEMA)

"""Language-model scores by prediction by partial matching over bytes, and a word baseline.

The model is a trie of byte contexts up to ``ORDER`` bytes long, with the counts of the bytes that
follow each in the training texts. A byte is coded in the longest context that has seen its
predecessors; a context that has not seen the byte escapes (method C: distinct followers against
all), and the bytes it has seen are excluded from the shorter ones. Trained once, a context and a
byte always cost the same, so a text's code length is a sum over its distinct (ORDER + 1)-grams.

Texts are dealt to blocks by hash. A block sends its distinct grams and words with their training
counts to fragments (grams by the last two context bytes, so that a fragment holds whole subtrees
of the trie; words by hash). A fragment adds up the counts, prices each gram and word, and sends
the prices back in the order it got them. Blocks then price their texts. No task holds the whole
trie; only the counts of byte pairs, at most 65,536, are shared with all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.words import LOWER, WORD_BYTE, Spans, buffers, mix, per_text, slices

ORDER = 5
#: Bytes that never occur in a normalised text: capitals and white space but the blank. One of the
#: latter, the line feed, ends a text and stands before it.
END = 10
SYMBOLS = 256 - 26 - 5 + 1
BLOCK_BYTES = 12 << 20
FOLDS, HELD_FOLD = 5, 1


def stream(spans: Spans) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text joined by a blank and closed by END, after ORDER times END; and where each
    text's scored bytes (the words, blanks and the closing END) start and stop."""
    size = per_text(spans.ends - spans.starts + 1, spans.first)
    own = np.maximum(size, 1)  # one place for the END of a text without words
    stops = np.cumsum(own + ORDER)
    starts = stops - own
    # the bytes of words, and the first byte after each word as its blank
    inside = WORD_BYTE[spans.data]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    heads = spans.off[1:-1][spans.off[1:-1] < len(keep)]
    keep[heads] = inside[heads]
    values = np.where(inside, spans.data, np.uint8(32))[keep]
    places = np.concatenate([[0], np.cumsum(keep)])[spans.off[:-1]]
    out = np.full(int(stops[-1]) if len(stops) else 0, END, np.uint8)
    for start, stop, place in zip(starts.tolist(), stops.tolist(), places.tolist(), strict=True):
        out[start : stop - 1] = values[place : place + stop - 1 - start]
    return out, np.stack([starts, stops])


def grams(data: np.ndarray) -> np.ndarray:
    """For each position, its byte as the lowest and the ORDER bytes before it above, as one number;
    the first ORDER positions have none."""
    if len(data) <= ORDER:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) - ORDER,), ">u8", padded, strides=(1,))
    return eights.astype(np.uint64) >> np.uint64(8 * (7 - ORDER))


def scored(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grams of all scored bytes and the texts' offsets in them."""
    keep = np.zeros(len(data) + 1, np.int64)
    keep[bounds[0]] += 1
    keep[bounds[1]] -= 1
    inside = np.cumsum(keep[:-1]) > 0
    return grams(data)[inside[ORDER:]], np.concatenate([[0], np.cumsum(bounds[1] - bounds[0])])


def prices(codes: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of each gram of a fragment. ``codes`` are distinct, ``counts`` their training
    counts (0: only in texts to score); ``pairs`` the counts of (byte before, byte) of all training
    texts. All grams whose context ends alike in two bytes must be present."""
    n = len(codes)
    result = np.zeros(n)
    open_ = np.ones(n, bool)  # not priced yet
    symbols = (codes & np.uint64(255)).astype(np.int64)
    trained = counts > 0
    # rows of the next longer order's followers, to exclude
    seen_context, seen_symbol = None, None
    for order in range(ORDER, -1, -1):
        context = (codes >> np.uint64(8)) & np.uint64((1 << (8 * order)) - 1) if order else np.zeros(n, np.uint64)
        if order >= 2:
            keys, place = np.unique(context, return_inverse=True)
            follow, inverse = np.unique((context[trained] << np.uint64(8)) | symbols[trained].astype(np.uint64), return_inverse=True)
            amount = np.bincount(inverse, counts[trained], minlength=len(follow)) if len(follow) else np.zeros(0)
            owner = np.searchsorted(keys, follow >> np.uint64(8))
            totals = np.bincount(owner, amount, minlength=len(keys))
            kinds = np.bincount(owner, minlength=len(keys)).astype(float)

            def count_of(ctx: np.ndarray, sym: np.ndarray, follow=follow, amount=amount) -> np.ndarray:
                if not len(follow):
                    return np.zeros(len(ctx))
                want = (ctx << np.uint64(8)) | sym.astype(np.uint64)
                at = np.minimum(np.searchsorted(follow, want), len(follow) - 1)
                return np.where(follow[at] == want, amount[at], 0.0)
        else:
            table = pairs if order == 1 else pairs.sum(axis=0, keepdims=True)
            keys, place = np.unique(context, return_inverse=True)
            rows = table[keys.astype(np.int64)]
            totals, kinds = rows.sum(axis=1), (rows > 0).sum(axis=1).astype(float)

            def count_of(ctx: np.ndarray, sym: np.ndarray, table=table) -> np.ndarray:
                return table[ctx.astype(np.int64), sym].astype(float)

        # what the longer contexts have seen is excluded here: by longer context, the sum of counts
        total, kind = totals[place], kinds[place]
        if seen_context is not None:
            short = seen_context[0] & np.uint64((1 << (8 * order)) - 1) if order else np.zeros(len(seen_context[0]), np.uint64)
            gone = np.bincount(seen_context[1], count_of(short[seen_context[1]], seen_symbol), minlength=len(short))
            total = total - gone[seen_place]
            kind = kind - seen_kinds[seen_place]
        own = count_of(context, symbols)
        hit = open_ & (own > 0)
        result[hit] += np.log10(own[hit] / (total + kind)[hit])
        open_ &= ~hit
        escape = open_ & (kind > 0)
        result[escape] += np.log10(kind[escape] / (total + kind)[escape])
        # followers of this order's contexts, for the next
        if order >= 2:
            seen_context, seen_symbol = (keys, owner), (follow & np.uint64(255)).astype(np.int64)
        else:
            where, sym = np.nonzero(rows)
            seen_context, seen_symbol = (keys, where), sym
        seen_place, seen_kinds = place, kinds
    left = SYMBOLS - kinds[place]
    result[open_] -= np.log10(np.maximum(left[open_], 1))
    return result


def _words(texts: pa.Array) -> Spans:
    data, off = buffers(texts)
    return Spans(LOWER[data], off)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of byte pairs (before, byte) in training texts, their tokens (code -2), all bytes (-1)."""
    pairs, tokens, size = np.zeros(1 << 16, np.int64), 0, 0
    for batch in batches:
        for part in slices(batch):
            spans = _words(part.column("text"))
            size += len(spans.data)
            data, bounds = stream(spans)
            train = ~part.column("held_out").to_numpy(zero_copy_only=False)
            # +1 where a training text's scored bytes start, -1 behind them
            steps = np.zeros(len(data) + 1, np.int8)
            steps[bounds[0][train]] += 1
            steps[bounds[1][train]] -= 1
            both = (data[:-1].astype(np.uint16) << np.uint16(8)) | data[1:]
            pairs += np.bincount(both[np.cumsum(steps[1:-1], dtype=np.int8) > 0], minlength=1 << 16)
            tokens += int((spans.counts + 1)[train].sum())
    found = np.flatnonzero(pairs)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], found])), pa.array(np.concatenate([[size, tokens], pairs[found]]))], names=["code", "n"])


class Dictionary:
    """Distinct grams and words of a block in the order of sending: by fragment, then by value; with
    their training counts, or with the place of each text's grams and words in the dictionary."""

    def __init__(self, docs: pa.Table, fragments: int, counting: bool):
        found: tuple[list, list] = ([], [])
        trained: tuple[list, list] = ([], [])
        self.parts = []
        for batch in docs.to_batches():
            for part in slices(batch):
                spans = _words(part.column("text"))
                train = ~part.column("held_out").to_numpy(zero_copy_only=False)
                codes, ends = scored(*stream(spans))
                places = []
                for kind, (values, owners) in enumerate(((codes, np.diff(ends)), (spans.hashes(), spans.counts))):
                    if counting:
                        found[kind].append(values)
                        trained[kind].append(np.repeat(train, owners))
                    else:
                        own, inverse = np.unique(values, return_inverse=True)
                        places.append((own, inverse.astype(np.int32)))
                        found[kind].append(own)
                if not counting:
                    self.parts.append((part.column("doc_id"), part.column("held_out"), ends, spans.first, places))
        self.keys, self.counts, self.order, self.ends = [], [], [], []
        for kind in (0, 1):
            every = np.concatenate([*found[kind], np.zeros(0, np.uint64)])
            found[kind].clear()
            if counting:
                keys, counts = _tallied(every, np.concatenate([*trained[kind], np.zeros(0, bool)]), kind)
                self.counts.append(counts)
            else:
                keys = np.unique(every)
            self.keys.append(keys)
            fragment = fragment_of(keys, kind, fragments)
            # short numbers are sorted by counting
            self.order.append(np.argsort(fragment.astype(np.uint16) if fragments <= 1 << 16 else fragment, kind="stable"))
            self.ends.append(np.concatenate([[0], np.cumsum(np.bincount(fragment, minlength=fragments))]))


def _tallied(values: np.ndarray, train: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs in training texts; ``values`` is used up.
    Grams leave a bit free, which carries the flag through a single sort."""
    if kind == 1:
        keys = np.unique(values)
        seen, n = np.unique(values[train], return_counts=True)
        counts = np.zeros(len(keys), np.int64)
        counts[np.searchsorted(keys, seen)] = n
        return keys, counts
    values <<= np.uint64(1)
    values |= train
    values.sort()
    train = (values & np.uint64(1)).astype(bool)
    values >>= np.uint64(1)
    heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])[: len(values)])
    sums = np.concatenate([[0], np.cumsum(train)])
    return values[heads], np.diff(sums[np.append(heads, len(values))])


def fragment_of(keys: np.ndarray, kind: int, fragments: int) -> np.ndarray:
    """Grams go by the last two bytes of their context, words by their hash."""
    place = mix((keys >> np.uint64(8)) & np.uint64(0xFFFF)) if kind == 0 else keys
    return ((place >> np.uint64(33)) % np.uint64(fragments)).astype(np.int32)


def _planes(values: np.ndarray, width: int) -> bytes:
    """Low ``width`` bytes of each number, byte by byte, which packs well when sorted."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(data: bytes, width: int) -> np.ndarray:
    table = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((table.shape[1], 8), np.uint8)
    out[:, :width] = table.T
    return out.view("<u8").ravel()


WIDTHS = (ORDER + 1, 8)


def _send(fragments: int):
    def run(docs: pa.Table) -> pa.Table:
        block = docs.column("block")[0].as_py()
        book = Dictionary(docs, fragments, True)
        rows = []
        for kind in (0, 1):
            keys, counts = (x[kind][book.order[kind]] for x in (book.keys, book.counts))
            for f in range(fragments):
                part = slice(book.ends[kind][f], book.ends[kind][f + 1])
                if part.start < part.stop:
                    rows.append((kind * fragments + f, block, _planes(keys[part], WIDTHS[kind]), _planes(counts[part].astype(np.uint64), 8)))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["fragment", "block", "keys", "counts"])

    return run


def _price(fragments: int, pairs):
    def run(sent: pa.Table) -> pa.Table:
        fragment = sent.column("fragment")[0].as_py()
        kind, blocks = fragment // fragments, sent.column("block").to_pylist()
        keys = [_from_planes(k.as_py(), WIDTHS[kind]) for k in sent.column("keys")]
        counts = [_from_planes(c.as_py(), 8).astype(np.int64) for c in sent.column("counts")]
        found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, np.concatenate(counts), minlength=len(found)).astype(np.int64)
        values = prices(found, total, pairs.value) if kind == 0 else total
        values = values.astype("<f8" if kind == 0 else "<i8")[inverse]
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        known = int((total > 0).sum()) if kind == 1 else 0
        out = [v.tobytes() for v in np.split(values, cuts)]
        return pa.table([pa.array(blocks, pa.int64()), pa.array([fragment] * len(out), pa.int32()), pa.array(out, pa.binary()), pa.array([known] + [0] * (len(out) - 1), pa.int64())], names=["block", "fragment", "prices", "known"])

    return run


def _score(fragments: int, train_tokens: int, train_texts: int):
    end_price = np.log10(train_texts + 0.5)

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        book = Dictionary(docs, fragments, False)
        said = sorted(zip(replies.column("fragment").to_pylist(), replies.column("prices").to_pylist(), strict=True))
        values = []
        for kind, form in ((0, "<f8"), (1, "<i8")):
            own = np.frombuffer(b"".join(p for f, p in said if f // fragments == kind), form)
            back = np.empty(len(own), own.dtype)
            back[book.order[kind]] = own
            values.append(back)
        out = []
        for doc_id, held_out, ends, first, places in book.parts:
            price, counts = (values[kind][np.searchsorted(book.keys[kind], own)][inverse] for kind, (own, inverse) in enumerate(places))
            known = per_text(counts > 0, first) + (train_texts > 0)
            base = per_text(np.log10(counts + 0.5), first) + end_price
            numbers = (np.diff(first) + 1, known.astype(np.int64), np.full(len(doc_id), train_tokens), base, per_text(price, ends))
            out.append(pa.RecordBatch.from_arrays([doc_id, held_out, *(pa.array(x) for x in numbers)], names=RESULT))
        return pa.Table.from_batches(out)

    return run


RESULT = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "word_part", "score"]


def score_documents(documents: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Scores of every row of ``documents`` (doc_id, text; others are ignored): held_out (crc32 of the
    id's text leaves 1 modulo 5; not for a null id), n_tokens (words and one end), n_known (of
    those, seen in training texts), train_tokens, base_score (smoothed word frequencies) and score
    (the trie's log10 probability of the lower-case words joined by one blank and the end). A null
    or empty text has only the end. Equal texts get equal scores; rows may repeat; with no training
    text every byte has the same price; an empty table gives an empty result."""
    spark = documents.sparkSession
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("bigint").cast("string")), F.lit(FOLDS)) == HELD_FOLD, F.lit(False))
    rows = documents.select(F.col("doc_id").cast("bigint"), held.alias("held_out"), "text")
    # at most 65,538 rows: the pairs of bytes and two totals
    found = {r["code"]: r["n"] for r in rows.mapInArrow(_statistics, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect()}
    size, train_tokens = found.pop(-1, 0), found.pop(-2, 0)
    pairs = np.zeros((256, 256), np.int64)
    for code, n in found.items():
        pairs[code >> 8, code & 255] = n
    # each training text has one END after its last byte
    train_texts = int(pairs[:, END].sum())
    shared = spark.sparkContext.broadcast(pairs)
    blocks = max(1, -(-size // block_bytes))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    sent = dealt.groupBy("block").applyInArrow(_send(blocks), "fragment int, block bigint, keys binary, counts binary")
    replies = sent.groupBy("fragment").applyInArrow(_price(blocks, shared), "block bigint, fragment int, prices binary, known bigint")
    scored_rows = dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_score(blocks, train_tokens, train_texts), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, word_part double, score double")
    # distinct training tokens, the end among them
    distinct = replies.agg((F.sum("known") + (1 if train_texts else 0)).alias("v")).scalar()
    norm = F.log10(F.lit(float(train_tokens)) + F.lit(0.5) * (distinct + 1))
    return scored_rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", (F.col("word_part") - F.col("n_tokens") * norm).alias("base_score"), "score")

"""Quality rules: fixed base rules and a calibrated logistic regression over hashed n-grams.

A document's features are the relative frequencies of hashed byte 2-grams and 4-grams, words and
word pairs, so the linear score is the sum of four mean weights and one pass of table lookups
scores a text of any length. The model is fitted on a bounded sample of the labelled rows, its
scores are mapped to probabilities on rows kept out of the fit (with the class shares of all
labels), and whole texts are scored in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.words import LINE_BYTE, WORD_BYTE, Spans, buffers, covered, mix, per_text, slices, whole, windows

BITS = 16
GROUPS = 4
#: Rows of each class that the model may see; the smallest hashes of doc_id are taken.
SAMPLE_PER_CLASS = 1024
THRESHOLD = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOL_BYTE = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, probability double"


@dataclass
class Model:
    """Weights by feature group and hash, and the line that maps scores to log odds; without
    weights (no labels of both classes) only the base rules decide."""

    weights: np.ndarray | None
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = THRESHOLD


def _equal_to_earlier(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occurred before, and which occur more than once."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    earlier, several = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    earlier[order[1:][same]] = True
    several[order[1:][same]] = True
    several[order[:-1][same]] = True
    return earlier, several


def _keyed(hashes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    return mix(hashes ^ (texts.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def base_counts(spans: Spans, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """The five counts of the base rules for each text."""
    data, off = spans.data, spans.off
    in_word = WORD_BYTE[data]
    lines = Spans(data, off, LINE_BYTE)
    word_bytes = np.concatenate([[0], np.cumsum(in_word)])
    texts = lines.owner()
    worded = word_bytes[lines.ends] > word_bytes[lines.starts]
    earlier, _ = _equal_to_earlier(_keyed(lines.hashes()[worded], texts[worded]))
    at, owner = whole(spans, 3)
    _, several = _equal_to_earlier(_keyed(windows(hashes, 3)[at], owner))
    repeats = covered(at[several], 3, len(spans.starts))
    return {
        "n_words": spans.counts,
        "word_chars": per_text(in_word & ((data & 0xC0) != 0x80), off),
        "n_symbols": per_text(SYMBOL_BYTE[data], off),
        "n_dup_lines": np.bincount(texts[worded][earlier], minlength=len(off) - 1),
        "n_repeat_words": per_text(repeats, spans.first),
    }


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def features(spans: Spans, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each group: the feature of every position of all texts, and the texts' offsets in it."""
    data, off = spans.data, spans.off
    shift = np.uint32(32 - BITS)
    for kind, width in (("<u2", 2), ("<u4", 4)):
        padded = np.concatenate([data, np.zeros(width, np.uint8)])
        grams = np.ndarray((len(data),), kind, padded, strides=(1,)).astype(np.uint32)
        places = (grams * np.uint32(0x9E3779B1)) >> shift
        keep = np.ones(len(data), bool)
        for back in range(1, width):
            keep[np.maximum(off[1:] - back, off[:-1])[off[1:] > off[:-1]]] = False
        ends = np.concatenate([[0], np.cumsum(keep)])[off]
        yield places[keep], ends
    for width in (1, 2):
        at, owner = whole(spans, width)
        places = (windows(hashes, width)[at] >> np.uint64(64 - BITS)).astype(np.uint32)
        yield places, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(off) - 1))])


def raw_scores(weights: np.ndarray, spans: Spans, hashes: np.ndarray) -> np.ndarray:
    total = np.full(len(spans.off) - 1, float(weights[GROUPS, 0]))
    for group, (places, ends) in enumerate(features(spans, hashes)):
        sums = per_text(weights[group][places], ends)
        total += sums / np.maximum(np.diff(ends), 1)
    return total


def _probability(model: Model, scores: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(model.slope * scores + model.shift, -60, 60)))


def score_slice(texts: pa.Array, model: Model) -> dict[str, np.ndarray]:
    """Counts, verdict and probability of each text of one slice."""
    spans = Spans(*buffers(texts))
    hashes = spans.hashes()
    out = base_counts(spans, hashes)
    failed = base_failed(out["n_words"], out["n_repeat_words"])
    if model.weights is None:
        chance = np.ones(len(texts))
    else:
        chance = _probability(model, raw_scores(model.weights, spans, hashes))
    return out | {"base_failed": failed, "kept": ~failed & (chance >= model.threshold), "probability": chance}


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's distinct features and their shares, as packed 32-bit numbers."""
    for batch in batches:
        for part in slices(batch):
            spans = Spans(*buffers(part.column("text")))
            places, shares = [[] for _ in range(part.num_rows)], [[] for _ in range(part.num_rows)]
            for group, (found, ends) in enumerate(features(spans, spans.hashes())):
                for i in range(part.num_rows):
                    own, counts = np.unique(found[ends[i] : ends[i + 1]], return_counts=True)
                    places[i].append(own.astype(np.int32) + (group << BITS))
                    shares[i].append((counts / max(1, counts.sum())).astype(np.float32))
            packed = [pa.array([np.concatenate(x).tobytes() for x in kind], pa.binary()) for kind in (places, shares)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), *packed], names=["doc_id", "quality", "places", "shares"])


def fit(documents: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS, threshold: float = THRESHOLD) -> Model:
    """Fit on at most ``sample_per_class`` labelled rows of each class, the ones with the
    smallest hash of doc_id; three of four train, the fourth calibrates. Labels other than 0
    and 1, null ids, and labels without a document are ignored; of two labels of one id the
    smaller counts, of several texts of one id the one with the least hash. Only sparse features of the sample reach the driver."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    known = known.join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    shares = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        return Model(None, threshold=threshold)
    order = F.xxhash64("doc_id")
    picked = [known.where(F.col("quality") == q).orderBy(order, "doc_id").limit(sample_per_class) for q in (0, 1)]
    # at most 2 * sample_per_class rows of two numbers
    sample = F.broadcast(picked[0].union(picked[1]))
    # of several texts of one id the one with the least hash
    texts = documents.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t"))
    rows = texts.select("doc_id", "quality", "t.text").mapInArrow(_sparse, "doc_id bigint, quality int, places binary, shares binary").toArrow()
    return _train(rows.sort_by("doc_id"), shares, threshold)


#: Features of the sample that one step of a round takes at once; more only cost memory.
STEP_FEATURES = 1 << 18


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    """The numbers of all values of a binary column, one after the other."""
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(value.as_buffer(), kind) for chunk in column.chunks for value in chunk)], dtype=kind)


def _train(rows: pa.Table, shares: dict[int, int], threshold: float, rounds: int = 120) -> Model:
    """Full-batch logistic regression with adaptive steps, then Platt's line on the fourth fold."""
    size = (GROUPS + 1) << BITS
    y = rows.column("quality").to_numpy().astype(float)
    fold = np.arange(len(y)) % 4
    held = fold == 3
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    cols, vals = _joined(rows.column("places"), np.int32), _joined(rows.column("shares"), np.float32)
    ends = np.concatenate([[0], np.cumsum([len(value.as_buffer()) // 4 for chunk in rows.column("places").chunks for value in chunk])]).astype(np.int64)
    # runs of rows of about STEP_FEATURES features: no array but the sample itself is as long as the sample
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(STEP_FEATURES, ends[-1], STEP_FEATURES)), [len(y)]]))
    parts = [(slice(a, b), slice(ends[a], ends[b]), ends[a : b + 1] - ends[a]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    # a feature's share is scaled by its spread, so rare and common n-grams move alike
    spread = np.zeros(size)
    for _, at, _ in parts:
        spread += np.bincount(cols[at], vals[at].astype(float) ** 2, minlength=size)
    spread = np.sqrt(spread / max(1, len(y))) + 1e-4
    weight = np.where(y == 1, 0.5 / max(1, (y[~held] == 1).sum()), 0.5 / max(1, (y[~held] == 0).sum())) * ~held
    w, bias, first, second = np.zeros(size), 0.0, np.zeros(size), np.zeros(size)
    z = np.zeros(len(y))
    for step in range(1, rounds + 1):
        scaled, grad, moved = w / spread, np.zeros(size), 0.0
        for own, at, off in parts:
            z[own] = per_text(vals[at] * scaled[cols[at]], off) + bias
            error = (1 / (1 + np.exp(-np.clip(z[own], -60, 60))) - y[own]) * weight[own]
            grad += np.bincount(cols[at], vals[at] * np.repeat(error, np.diff(off)), minlength=size)
            moved += error.sum()
        grad = grad / spread + 1e-4 * w
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        w -= 0.01 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        bias -= 0.1 * moved
    for own, at, off in parts:
        z[own] = per_text(vals[at] * (w / spread)[cols[at]], off) + bias
    slope, shift = _platt(z[held], y[held], shares) if held.any() else (1.0, 0.0)
    table = (w / spread).reshape(GROUPS + 1, 1 << BITS).astype(np.float32)
    table[GROUPS, 0] = bias
    return Model(table, slope, shift, threshold)


def _platt(z: np.ndarray, y: np.ndarray, shares: dict[int, int]) -> tuple[float, float]:
    """Slope and shift of the log odds by Newton's steps, each class weighted by its share."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    total = shares[0] + shares[1]
    weight = np.where(y == 1, shares[1] / total / n1, shares[0] / total / n0)
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(1e-9, float(np.abs(z).mean()))
    x = z / scale
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -60, 60)))
        g = np.array([(weight * (p - target) * x).sum() + 1e-4 * a, (weight * (p - target)).sum()])
        s = weight * p * (1 - p)
        h = np.array([[(s * x * x).sum() + 1e-4, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 0.0) / scale), float(b)


def _send(spark: SparkSession, model: Model):
    """The model has a fixed size (a table of 2**BITS weights for each group)."""
    return spark.sparkContext.broadcast(model)


def assess(documents: DataFrame, model: Model) -> DataFrame:
    """One row of counts and verdict for each row of ``documents`` (columns doc_id and text; any
    others are ignored). A null text has no words, so it fails the base rules, as does any text
    of fewer than 50 words or with over half of its words in repeated three-word windows. Equal
    rows get equal results; a null doc_id is passed on; an empty table gives an empty result."""
    sent = _send(documents.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = score_slice(part.column("text"), sent.value)
                columns = [part.column("doc_id"), *(pa.array(out[k].astype(np.int64)) for k in BASE), *(pa.array(out[k]) for k in ("base_failed", "kept", "probability"))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *BASE, "base_failed", "kept", "probability"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SCHEMA)


def keep_good(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of ``documents`` that pass base rules and model, with all their columns."""
    sent = _send(documents.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(score_slice(part.column("text"), sent.value)["kept"]))

    return documents.mapInArrow(run, documents.schema)


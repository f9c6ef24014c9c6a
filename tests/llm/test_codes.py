"""Product codes against a plain Lloyd over all rows."""

import hashlib
import math
import random

import pytest

from paperloom.llm import codes
from paperloom.llm.queries import QUERIES

VECTORS = "vec_id bigint, embedding array<float>, label int, code string, weights int"


def plain(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error, label_error, sha) by definition."""
    kept = [(i, e, label) for i, e, label in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    longest = max([len(e) for _, e, _ in kept], default=0)
    width = -(-longest // parts)
    whole = [[math.floor(256 * x) for x in e] + [0] * (width * parts - len(e)) for _, e, _ in kept]
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for v in whole]
    least = {}
    for (i, e, _), v, pieces in zip(kept, whole, cut):
        if i is not None and (i not in least or v < least[i][0]):
            least[i] = (v, pieces)
    first = sorted(least)[:entries]
    books = [[least[i][1][p] for i in first] for p in range(parts)]

    def find(piece, book):
        far = [sum((a - b) ** 2 for a, b in zip(piece, entry)) for entry in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for pieces in cut:
                held.setdefault(find(pieces[p], books[p])[0], []).append(pieces[p])
            for entry, members in held.items():
                books[p][entry] = tuple(sum(m[d] for m in members) // len(members) for d in range(width))
    found = [[find(pieces[p], books[p]) for p in range(parts)] for pieces in cut]
    errors = [sum(e for _, e in f) for f in found]
    by_label = {}
    for (_, _, label), error in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + error
    sha = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return [(i, "".join(f"{c:02x}" for c, _ in f), error, by_label[label], sha) for (i, _, label), f, error in zip(kept, found, errors)]


def answers(frame):
    return sorted((tuple(r) for r in frame.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def test_the_query_agrees_with_a_plain_lloyd(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [tuple(r) for r in table.select("vec_id", "embedding", "label").collect()]
    assert answers(QUERIES["op12_vector_codes"](spark, sf_dir)) == sorted(plain(rows), key=repr)


def test_nulls_ties_repeats_hot_vectors_and_clashing_names(spark):
    rng = random.Random(2)
    hot = [0.5, -0.25] * 16
    rows = [(i, [rng.uniform(-1, 1) for _ in range(32)], rng.choice([None, 1, 2])) for i in range(0, 180, 2)]
    rows += [(1000 + i, hot, 3) for i in range(120)] + [(5, hot, 3)] * 40
    rows += [(None, hot, None), (None, None, 1), (7, None, 1), (9, [None] * 32, 1), (11, [float("nan")] * 32, 1), (13, [float("inf")] * 32, 1)]
    rows += [(15, [0.125] * 20, 2), (17, [], None), (2, [-1.0] * 32, 1)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS).repartition(5)
    assert answers(codes.compress(frame)) == sorted(plain(rows), key=repr)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(3, [], 1), (4, [], 2)], [(3, [0.1, 0.2], 1)]])
def test_small_tables(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    assert answers(codes.compress(frame)) == sorted(plain(rows), key=repr)


def test_without_ids_there_are_no_entries(spark):
    frame = spark.createDataFrame([(None, [0.5] * 16, 1, "x", 1)], VECTORS)
    assert [(r["code"], r["error"]) for r in codes.compress(frame).collect()] == [(None, None)]


def test_components_too_large_for_exact_sums_are_refused(spark):
    frame = spark.createDataFrame([(1, [1e30] * 16, 1, "x", 1)], VECTORS)
    with pytest.raises(OverflowError):
        codes.compress(frame)


def test_only_changed_members_migrate(spark, sf_dir, monkeypatch):
    moved = []
    write = codes.Scratch.write

    def watch(self, df, name):
        table = write(self, df, name)
        if name == "compared":
            moved.append((table.where("home <> target").count(), table.count()))
        return table

    monkeypatch.setattr(codes.Scratch, "write", watch)
    rows = codes.usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    form = codes.shape(rows)
    codes.fit(rows, form, rounds=4)
    assert len(moved) == 3 and all(total == form.rows * form.parts for _, total in moved)
    assert moved[-1][0] < moved[0][0] < form.rows * form.parts

"""The stages of the pipeline, each against plain Python on the rows that the one before gave."""

import hashlib
import random
import zlib

import corpus_pipeline
from pyspark.sql import functions as F
from test_operators import brute_lines, brute_spans, cut, sentence

from paperloom.llm import packing
from paperloom.llm.queries import vocabulary

COLUMNS = "doc_id bigint, text string, n_chars int, row string, spans int, version string, rows int"


def fixture_rows():
    rng = random.Random(12)
    poem = "\n".join(sentence(rng, 10) for _ in range(8))
    plain, lost, near, other, passage = (sentence(rng, n) for n in (90, 80, 100, 60, 60))
    texts = [(1, poem), (2, poem), (1, poem), (None, poem), (3, poem + "\n" + sentence(rng, 60)), (5, plain), (6, plain), (7, plain.upper()), (5, plain)]
    texts += [(50, lost), (50, lost), (51, lost), (60, near), (60, near + " end"), (61, "start " + near), (None, other), (None, other), (None, other + " end")]
    texts += [(70, passage + " " + sentence(rng, 50)), (71, sentence(rng, 40) + " " + passage), (None, sentence(rng, 40) + " " + passage)]
    texts += [(80, "too short"), (81, "again and " * 60), (82, None), (None, None), (83, "")]
    return [(i, t, None if t is None else len(t), f"r{k}", k, "v", k) for k, (i, t) in enumerate(texts)]


def brute_quality(rows):
    def good(text):
        ws = cut(text)
        three = [tuple(ws[k : k + 3]) for k in range(len(ws) - 2)]
        return len(ws) >= 50 and 100 * len({k + j for k, w in enumerate(three) if three.count(w) > 1 for j in range(3)}) <= 50 * len(ws)

    return sorted((str(r[0]), r[1]) for r in rows if good(r[1]))


def brute_kept(rows, version):
    sets = []
    for _, t, *_ in rows:
        ws = [w.lower() for w in cut(t)]
        sets.append({tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set())
    left, want = set(range(len(rows))), []
    while left:
        group, todo = [], [left.pop()]
        while todo:
            group.append(a := todo.pop())
            linked = {b for b in left if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
            left -= linked
            todo += linked
        i, t = min(((rows[a][0], rows[a][1]) for a in group), key=lambda r: (r[0] is None, r[0] or 0, version[r[1]]))
        want.append((str(i), str(t)))
    return sorted(want)


def tokens_by_document(pieces):
    out = {}
    for p in pieces:
        out[p["doc_id"]] = out.get(p["doc_id"], 0) + p["length"]
    return out


def test_stages_and_run(spark, tmp_path):
    rows = fixture_rows()
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    # labels of one class only: the base rules decide
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "substrings", "packing"]
    before, places = rows, {r[3]: r for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = [tuple(r) for r in docs.collect()]
        got = sorted((str(r[0]), str(r[1])) for r in after)
        if name == "quality":
            assert got == brute_quality(before)
        elif name == "lines":
            assert got == sorted((x[0], str(x[3])) for x in brute_lines(before))
        elif name == "near_duplicates":
            frame = spark.createDataFrame([(r[1],) for r in before], "text string")
            assert got == brute_kept(before, {r[0]: r[1] for r in frame.select("text", F.xxhash64("text")).collect()})
        else:
            assert sorted((str(r[0]), hashlib.sha256(b" ".join(cut(r[1]))).hexdigest()) for r in after) == sorted((x[0], x[3]) for x in brute_spans(before))
        # each row is one of the table, with its other columns, once
        assert len({r[3] for r in after}) == len(after)
        assert all((r[0], *r[3:]) == (places[r[3]][0], *places[r[3]][3:]) and r[2] == len(r[1]) for r in after)
        before = after
    definition = vocabulary("word_bpe_49k.json").decode()
    encoder, ids, want = packing.WordEncoder(definition), {}, {}
    for i, t, *_ in before:
        ids.setdefault(i, []).append(own := encoder.encode([t])[0])
        want[i] = want.get(i, 0) + len(own) // 4
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert tokens_by_document(pieces) == want
    assert all(any(zlib.crc32(own[4 * p["start"] : 4 * (p["start"] + p["length"])]) == p["ids_crc32"] for own in ids[p["doc_id"]]) for p in pieces)
    assert tokens_by_document(corpus_pipeline.run(spark, str(tmp_path)).collect()) == want

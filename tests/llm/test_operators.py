"""The corpus operators against plain Python on small tables, with nulls, ties, copies and clashing names."""

import hashlib
import random
import re
import zlib

import pytest

from paperloom.llm import bpe, jaccard, licenses, lines, packing, pages, ppm, quality, substrings, topk
from paperloom.llm.queries import pattern, vocabulary
from paperloom.llm.words import Spans, buffers, windows

DOCS = "doc_id bigint, text string, row string, spans int"
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base, passage = sentence(rng, 120), sentence(rng, 70)
    texts = [base, base, " ".join(base.split()[:-2] + ["x", "y"]), base.upper(), sentence(rng, 90) + "\n" + passage, passage + " " + sentence(rng, 60)]
    texts += [None, "", " \n\t ", "one two", "one  two", "One two three four five", "a\nb\nc\nd\na\nb\nc", "q\na\nb\nc\n", "Re " * 200, "é🙂 ß\x0bx " * 40, "x" * 3000]
    texts += [sentence(rng, rng.randrange(1, 200)) for _ in range(15)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, base), (None, passage), (3, base.upper()), (4, "another text of one id")]
    return [(i, t, "r", 7) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def cut(text):
    return WORDS.findall((text or "").encode())


def test_words_and_windows():
    import pyarrow as pa

    spans = Spans(*buffers(pa.array(["ab  cd", None, "ef\x0bgh", "", "longer than eight"])))
    assert spans.counts.tolist() == [2, 0, 2, 0, 3]
    hashes = spans.hashes()
    assert len(set(hashes.tolist())) == 7
    twice = Spans(*buffers(pa.array(["a b c a b c"]))).hashes()
    assert windows(twice, 3)[0] == windows(twice, 3)[3] != windows(twice, 3)[1]


def test_bpe_agrees_with_the_library_and_round_trips(docs, none, corpus):
    import tiktoken

    ranks = vocabulary("byte_bpe_50k.tiktoken")
    plain = tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=bpe.read_ranks(ranks), special_tokens={})
    rng = random.Random(1)
    codec = bpe.codec(ranks, pattern())
    for _ in range(400):
        text = "".join(rng.choice("ab  e\n\tthéß🙂漢'sre1 .\x0b\x1c\x85\xa0") for _ in range(rng.randrange(200)))
        assert codec.encode(text) == plain.encode_ordinary(text)
        assert codec.decode(codec.encode(text)) == text
    want = sorted((-1 if i is None else i, len(ids := plain.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in corpus)
    got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in bpe.round_trip(docs, ranks, pattern()).collect())
    assert got == want
    assert bpe.round_trip(none, ranks, pattern()).count() == 0
    encoded = bpe.encode_documents(docs, ranks, pattern())
    assert sorted(r["text"] for r in bpe.decode_documents(encoded, ranks, pattern()).collect()) == sorted(t or "" for _, t, *_ in corpus)


def test_streaming_decode_of_split_characters():
    codec = bpe.codec(vocabulary("byte_bpe_50k.tiktoken"), pattern())
    single = {data[0]: rank for rank, data in codec.decoder.bytes_of.items() if len(data) == 1}
    assert codec.decode([single[b] for b in "a🙂é".encode()]) == "a🙂é"
    assert "�" in codec.decode([single[0xF0], single[0x9F]])


HTML = """<html><head><title>No</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<div class="cookie-notice">no</div><nav><ul><li><a href=x>no</a></ul></nav><div class="ad">no</div>
<article><h1>The &amp; head</h1><p>First   para<b>graph</b> with some length to it.<br>More<p>Second one, also long enough to count.</p>
<form><input><label>no</label></form><aside>no</aside><ul><li>item one<li>item two</ul><div id="comments"><p>no</p></div></article>
<!-- no --><footer>&copy; no</footer></body></html>"""


def test_page_text(spark):
    want = "The & head\nFirst paragraph with some length to it. More\nSecond one, also long enough to count.\nitem one\nitem two"
    rows = [(1, "u", HTML), (2, None, None), (3, "v", ""), (None, "w", "<p>plain text without any article</p>"), (4, "x", "<nav>menu</nav>")]
    got = {r["url"]: (r["text"], r["n_chars"]) for r in pages.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got == {"u": (want, len(want)), None: ("", 0), "v": ("", 0), "w": ("plain text without any article", 30), "x": ("", 0)}


OMITTED = """<!doctype html><html lang=en><head><meta charset=utf-8><title>No</title><style>p{}</style><noscript><img src=x></noscript>%s
<nav><ul><li><a href=x>no</a><li><a href=y>no</a></ul></nav>
<div><p>First paragraph without an end tag, long enough to count.<ul><li>item one<li>item two</ul>
<table><tr><td>cell one<td>cell two</table><p>Second paragraph, also long enough to count as text, and longer than the first.
<p>Third paragraph, also long enough to count as text, and about as long as the second one is.</div>
<footer>&copy; no</footer>"""


def test_page_text_with_omitted_end_tags():
    want = "First paragraph without an end tag, long enough to count.\nitem one\nitem two\ncell one\ncell two\nSecond paragraph, also long enough to count as text, and longer than the first.\nThird paragraph, also long enough to count as text, and about as long as the second one is."
    for head_end in ("</head><body>", "</head>", "<body>", "", '<body class="page"><main>'):
        assert pages.main_text(OMITTED % head_end) == want
    assert pages.main_text("<head><title>No</title>Plain text right after the title.") == "Plain text right after the title."
    assert pages.main_text("<head><title>No</title><noscript><p>no</p></noscript><body><p>Text after a head that stays open.") == "Text after a head that stays open."
    assert pages.main_text("<head><script>no</script><template><p>no</p></template></head><p>Text after a head.") == "Text after a head."


def test_model_scores(docs, none, corpus):
    from math import log10

    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, *_ in corpus}
    tokens = [(i, [w.lower() for w in cut(t)] + [None]) for i, t, *_ in corpus]
    counts = {}
    for i, own in tokens:
        if not held[i]:
            for w in own:
                counts[w] = counts.get(w, 0) + 1
    total, kinds = sum(counts.values()), len(counts)
    want = sorted((-1 if i is None else i, held[i], len(own), sum(w in counts for w in own), total, round(sum(log10((counts.get(w, 0) + 0.5) / (total + 0.5 * (kinds + 1))) for w in own), 6)) for i, own in tokens)
    rows = ppm.score_documents(docs, block_bytes=4000).collect()
    got = sorted((-1 if r[0] is None else r[0], r[1], r[2], r[3], r[4], round(r["base_score"], 6)) for r in rows)
    assert got == want
    assert all(r["score"] <= 0 for r in rows)
    assert sorted(round(r["score"], 6) for r in ppm.score_documents(docs).collect()) == sorted(round(r["score"], 6) for r in rows)
    assert ppm.score_documents(none).count() == 0


def test_trie_prices_are_probabilities():
    import numpy as np

    rng = np.random.default_rng(3)
    text = rng.choice(np.frombuffer(b"abcd ", np.uint8), 3000)
    data = np.concatenate([np.full(ppm.ORDER, ppm.END, np.uint8), text])
    codes, counts = np.unique(ppm.grams(data), return_counts=True)
    pairs = np.zeros((256, 256), np.int64)
    np.add.at(pairs, ((codes >> np.uint64(8) & np.uint64(255)).astype(int), (codes & np.uint64(255)).astype(int)), counts)
    symbols = [b for b in range(256) if not 65 <= b <= 90 and not 9 <= b <= 13 and b != 32] + [32, ppm.END]
    assert len(symbols) == ppm.SYMBOLS
    context = codes[7] >> np.uint64(8)
    every = np.array([(int(context) << 8) | s for s in symbols], np.uint64)
    extra = np.setdiff1d(every, codes)
    keys = np.concatenate([codes, extra])
    price = ppm.prices(keys, np.concatenate([counts, np.zeros(len(extra), np.int64)]), pairs)
    assert abs((10 ** price[np.isin(keys, every)]).sum() - 1) < 1e-9


def brute_components(corpus):
    sets = []
    for i, t, *_ in corpus:
        ws = [w.lower() for w in cut(t)]
        sets.append((i, frozenset(tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))) if ws else frozenset()))
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[root(a)] = root(b)
    out = []
    for k, (i, s) in enumerate(sets):
        ids = [sets[j][0] for j in range(len(sets)) if root(j) == root(k) and sets[j][0] is not None]
        out.append((str(i), len(s), min(ids) if ids else None))
    return sorted(out, key=str)


def test_jaccard_components(docs, none, corpus):
    found = jaccard.classes(docs).collect()
    assert sorted(((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in found), key=str) == brute_components(corpus)
    assert jaccard.classes(none).count() == 0
    assert jaccard.keep_one(docs).columns == docs.columns


def test_keep_one_of_each_component(spark, docs, none, corpus):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    near = sentence(rng, 90).split()
    lost, other = sentence(rng, 80), sentence(rng, 70)
    rows = [(i, t, f"r{k}", s) for k, (i, t, _, s) in enumerate(corpus)]
    # repeated rows; one id with two linked texts; groups of null ids alone; one id with two texts that do not link
    rows += [(50, lost, "a", 1), (50, lost, "b", 2), (50, lost, "a", 1), (51, lost, "c", 1)]
    rows += [(60, " ".join(near), "d", 1), (60, " ".join([*near, "end"]), "e", 1), (61, " ".join(["start", *near]), "f", 1)]
    rows += [(None, other, "g", 1), (None, other, "g", 1), (None, other + " end", "h", 1), (None, sentence(rng, 60), "i", 1)]
    rows += [(None, None, "j", 1), (None, None, "j", 1), (70, "", "k", 1), (70, "", "k", 1), (80, sentence(rng, 50), "l", 1), (80, sentence(rng, 50), "m", 1)]
    for case in (rows, corpus):
        frame = spark.createDataFrame(case, DOCS).repartition(3)
        version = {r["text"]: r["v"] for r in frame.select("text", F.xxhash64("text").alias("v")).distinct().collect()}
        sets = []
        for _, t, *_ in case:
            ws = [w.lower() for w in cut(t)]
            sets.append({tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set())
        left, want = set(range(len(case))), []
        while left:
            group, todo = [], [left.pop()]
            while todo:
                group.append(a := todo.pop())
                linked = {b for b in left if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
                left -= linked
                todo += linked
            i, t = min(((case[a][0], case[a][1]) for a in group), key=lambda r: (r[0] is None, r[0] or 0, version[r[1]]))
            want.append((str(i), str(t)))
        kept = jaccard.keep_one(frame)
        assert kept.columns == frame.columns
        got = [tuple(r) for r in kept.collect()]
        assert sorted((str(r[0]), str(r[1])) for r in got) == sorted(want)
        assert set(got) <= set(case)
    assert jaccard.keep_one(none).count() == 0


def test_jaccard_chain_of_near_copies(spark):
    rng = random.Random(2)
    base = sentence(rng, 100, 10**6).split()
    rows = []
    for k in range(60):  # each differs from the next by one word at a place of its own
        base = list(base)
        base[(k * 7) % 100] = f"edit{k}"
        rows.append((1000 - k, " ".join(base), "r", 1))
    assert sorted(((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard.classes(spark.createDataFrame(rows, DOCS)).collect()), key=str) == brute_components(rows)


def test_jaccard_ranks_in_lanes_give_the_same_components(spark, docs, corpus, monkeypatch):
    monkeypatch.setattr(jaccard, "LANE_MEMBERS", 3)
    rng = random.Random(3)
    base = sentence(rng, 80, 10**6).split()
    # thirty near copies and twenty texts that only share a passage of them
    rows = [(k, " ".join([*base[:k], f"own{k}", *base[k + 1 :]]), "r", 1) for k in range(30)]
    rows += [(100 + k, " ".join(base[:30]) + " " + sentence(rng, 12 + k, 10**6), "r", 1) for k in range(20)]
    for case, frame in ((rows, spark.createDataFrame(rows, DOCS)), (corpus, docs)):
        found = jaccard.classes(frame).collect()
        assert sorted(((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in found), key=str) == brute_components(case)


def brute_spans(corpus, window=50):
    lowest = {}
    for i, t, *_ in corpus:
        ws, rank = cut(t), 1 << 62 if i is None else i
        for k in range(len(ws) - window + 1):
            key = tuple(ws[k : k + window])
            lowest[key] = min(lowest.get(key, rank), rank)
    out = []
    for i, t, *_ in corpus:
        ws, rank, gone = cut(t), 1 << 62 if i is None else i, set()
        for k in range(len(ws) - window + 1):
            if lowest[tuple(ws[k : k + window])] < rank:
                gone.update(range(k, k + window))
        kept = b" ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((str(i), len(ws), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_substring_removal(docs, none, corpus):
    assert sorted((str(r[0]), *r[1:]) for r in substrings.digests(docs).collect()) == brute_spans(corpus)
    cleaned = substrings.remove_repeats(docs)
    assert cleaned.columns == docs.columns
    assert sorted(hashlib.sha256(b" ".join(cut(r["text"]))).hexdigest() for r in cleaned.collect()) == sorted(x[3] for x in brute_spans(corpus))
    assert substrings.remove_repeats(none).count() == 0


def test_licenses(spark):
    text = "intro words here\n\nThis work is licensed under the GNU General Public License, version 3.\nmore text follows\nAll rights reserved."
    rows = [(1, text), (2, None), (3, ""), (None, "Released under the MIT License."), (5, "Nothing of the kind is said in this sentence.")]
    got = {r["doc_id"]: (r["n_found"], r["license"], r["dice"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {1: (2, "GPL-3.0", 1.0), 2: (0, None, None), 3: (0, None, None), None: (1, "MIT", 1.0), 5: (0, None, None)}
    scanner = licenses.Scanner()
    a, b = licenses.bigrams(licenses.normalise("Licensed under the Apache Licence, Version 2.0.").split()), scanner.templates[0][1]
    assert scanner.best(a) is None or scanner.best(a)[1] == 2 * len(a & b) / (len(a) + len(b))


MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""

BSD_TEXT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
%s
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

BSD_NAMES = """
3. Neither the name of Example Works nor the names of its contributors may be
   used to endorse or promote products derived from this software without
   specific prior written permission.
"""


def test_licenses_inside_long_texts_and_lines():
    rng = random.Random(4)
    before, after = sentence(rng, 300), sentence(rng, 300)
    scanner = licenses.Scanner()
    full = next(text for name, text in reversed(licenses.TEMPLATES) if name == "GPL-3.0")
    for name, text in (("MIT", MIT_TEXT), ("BSD-2-Clause", BSD_TEXT % ""), ("BSD-3-Clause", BSD_TEXT % BSD_NAMES), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."), ("GPL-3.0", full)):
        text = text.strip("\n")
        for form in (text, text.replace("\n", "\n# ")):
            (found,) = scanner.scan(f"{before}\n{after}\n\n{form}\n\n{after}")
            assert found["license"] == name and found["dice"] > 0.9
            assert (found["first_line"], found["last_line"]) == (3, 3 + text.count("\n"))
        (found,) = scanner.scan(f"{before} {' '.join(text.split())} {after}")
        assert (found["license"], found["first_line"], found["last_line"]) == (name, 0, 0) and found["dice"] > 0.9
    twice = scanner.scan(f"{before} {MIT_TEXT}\n{BSD_TEXT % ''} {MIT_TEXT}\n{after}")
    assert [m["license"] for m in twice] == ["MIT", "BSD-2-Clause", "MIT"]


def brute_licenses(scanner, words):
    """The closest span, the longest and then the first among equals, and the same on either side of it."""
    best = None
    for a in range(len(words)):
        for b in range(a + 2, len(words) + 1):
            pairs = licenses.bigrams(words[a:b])
            for i, (name, own) in enumerate(scanner.templates):
                dice = 2 * len(pairs & own) / (len(pairs) + len(own))
                # the shortest of the spans of one start, and no start whose bigram comes again
                if dice >= scanner.threshold and tuple(words[a : a + 2]) in own and tuple(words[a : a + 2]) not in licenses.bigrams(words[a + 1 : b]):
                    shorter = any(2 * len((p := licenses.bigrams(words[a:c])) & own) / (len(p) + len(own)) >= dice for c in range(a + 2, b))
                    if not shorter:
                        best = min(best or (1,), (-dice, a - b, name, i, a, b))
    if best is None:
        return []
    a, b = best[4:]
    known = licenses.bigrams(words[a:b]) & scanner.templates[best[3]][1]
    while b < len(words) and (words[b - 1], words[b]) in known:
        b += 1
    while a and (words[a - 1], words[a]) in known:
        a -= 1
    left, right = brute_licenses(scanner, words[:a]), brute_licenses(scanner, words[b:])
    return left + [(best[2], -best[0], a, b)] + [(n, d, x + b, y + b) for n, d, x, y in right]


def test_licenses_are_the_closest_spans():
    rng = random.Random(8)
    for threshold in (0.5, 0.75):
        for _ in range(60):
            templates = tuple((f"T{k}", " ".join(rng.choice("abcde") for _ in range(rng.randrange(2, 9)))) for k in range(3))
            scanner = licenses.Scanner(templates, threshold)
            words = [rng.choice("abcdefg") for _ in range(rng.randrange(0, 22))]
            want = brute_licenses(scanner, [w.encode() for w in words])
            # one word a line, so lines are places
            assert [(m["license"], m["dice"], m["first_line"], m["last_line"] + 1) for m in scanner.scan("\n".join(words))] == want


def test_topk(spark):
    rng = random.Random(9)
    rows = [(k, [rng.choice([0.0, rng.uniform(-1, 1)]) for _ in range(6)]) for k in range(130)]
    rows += [(130, rows[50][1]), (131, rows[50][1]), (200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (250, [float("nan")] * 6), (None, rows[1][1])]
    vectors = topk.usable(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    weights = {r["vec_id"]: r["weights"] for r in vectors.collect()}
    want = []
    for q in (0, 50, 100):
        scored = sorted((-sum(a * b for a, b in zip(weights[q], w)), c) for c, w in weights.items() if c != q)[:5]
        want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored)]
    got = topk.search(vectors, vectors.where("vec_id % 50 = 0"), 5)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert topk.search(vectors.where("vec_id < 3"), vectors.where("vec_id = 0"), 5).count() == 2
    assert topk.search(vectors.limit(0), vectors, 5).count() == 0


def test_packing(docs, none, corpus):
    from tokenizers import Tokenizer

    definition = vocabulary("word_bpe_49k.json").decode()
    library = Tokenizer.from_str(definition)
    pieces = packing.pack(docs.coalesce(1), definition, window=256).collect()
    ids = {}
    for i, t, *_ in corpus:
        ids.setdefault(i, []).append(library.encode(t or "", add_special_tokens=False).ids + [2])
    by_sequence = {}
    for p in pieces:
        assert any(len(x) == p["doc_tokens"] and zlib.crc32(b"".join(k.to_bytes(4, "little") for k in x[p["start"] : p["start"] + p["length"]])) == p["ids_crc32"] for x in ids[p["doc_id"]])
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert sum(p["length"] for p in pieces) == sum(len(x) for own in ids.values() for x in own)
    for own in by_sequence.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 256 and end & (end - 1) == 0
    assert packing.pack(none, definition).count() == 0
    encoder = packing.WordEncoder(definition)
    for text in ("B ̱", "K\x0b́", "it's THE end.", "İΣσ x", "<|endoftext|> a", "a" * 500):
        assert encoder.encode([text])[0] == b"".join(k.to_bytes(4, "little") for k in [*library.encode(text, add_special_tokens=False).ids, 2])


def test_quality_base_counts(docs, none, corpus):
    got = sorted(tuple(str(x) for x in tuple(r)[:7]) for r in quality.assess(docs, quality.Model(None)).collect())
    want = []
    for i, t, *_ in corpus:
        ws, ls = cut(t), [x for x in (t or "").split("\n") if cut(x)]
        three = [tuple(ws[k : k + 3]) for k in range(len(ws) - 2)]
        repeated = {k + j for k, w in enumerate(three) if three.count(w) > 1 for j in range(3)}
        failed = len(ws) < 50 or 100 * len(repeated) > 50 * len(ws)
        want.append(tuple(map(str, (i, len(ws), sum(len(w.decode()) for w in ws), sum(c in "#*$%&|<>" for c in t or ""), len(ls) - len(set(ls)), len(repeated), failed))))
    assert got == sorted(want)
    assert quality.assess(none, quality.Model(None)).count() == 0


def test_quality_model_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    found = quality.assess(documents, quality.fit(documents, train)).join(test, "doc_id").where("not base_failed")
    rows = found.select("kept", "quality").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in rows) >= 0.9 * len(rows) > 0
    assert quality.fit(documents, labels.where("quality = 1")).weights is None


def brute_lines(corpus):
    first = {}
    order = sorted(range(len(corpus)), key=lambda k: (corpus[k][0] is None, corpus[k][0] or 0))
    out = []
    for k in order:
        i, t = corpus[k][:2]
        ls, gone = (t or "").split("\n") if t is not None else [], set()
        for a in range(len(ls) - 2):
            key = tuple(ls[a : a + 3])
            if any(cut(x) for x in key) and first.setdefault(key, (i, t, a)) != (i, t, a):
                gone.update((a, a + 1, a + 2))
        out.append((str(i), len(ls), len(gone), None if t is None else "\n".join(x for a, x in enumerate(ls) if a not in gone)))
    return sorted(out, key=str)


def test_line_dedup(docs, none, corpus):
    found = lines.remove_repeats(docs).collect()
    assert sorted(((str(r["doc_id"]), r["lines"]["n_lines"], r["lines"]["n_removed"], r["text"]) for r in found), key=str) == brute_lines(corpus)
    assert lines.remove_repeats(none).count() == 0


def test_a_rights_notice_does_not_hide_the_license(spark):
    bsd = "Copyright (c) 2020, Ann. All rights reserved.\n\n" + BSD_TEXT % "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
    rows = [(1, bsd), (2, "Copyright Ann. All rights reserved.\n\n" + MIT_TEXT), (3, "All rights reserved."), (4, "Released under the MIT License.\nAll rights reserved.")]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[1].startswith("BSD-") and (got[2], got[3], got[4]) == ("MIT", "Proprietary", "MIT")


def test_topk_of_repeated_queries_and_huge_components(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 1.0]), (2, [2.0, 5.0])], "vec_id bigint, embedding array<float>")
    vectors = topk.usable(frame)
    got = sorted(tuple(r) for r in topk.search(vectors, vectors.where("vec_id = 0"), 5).collect())
    one, two = 256 * 256, 2 * 256 * 256
    assert got == sorted([(0, 1, 1, 3 * one), (0, 2, 2, two), (0, 1, 2, 5 * one), (0, 2, 1, one)])
    with pytest.raises(OverflowError):
        huge = topk.usable(spark.createDataFrame([(0, [1e30]), (50, [1e30])], "vec_id bigint, embedding array<float>"))
        topk.search(huge, huge, 5)


def sent_bytes(df):
    """Bytes of rows that all shuffles and broadcasts of a DataFrame's run have sent."""
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        else:
            if name in ("Exchange", "BroadcastExchange"):
                total += node.metrics().apply("dataSize").value()
            todo += [node.children().apply(n) for n in range(node.children().size())]
    return total


def test_topk_sends_queries_to_no_more_places_than_the_candidates_need(spark):
    import numpy as np

    weights = np.random.default_rng(2).integers(-200, 200, (9000, 32))
    frame = spark.createDataFrame([(k, w.tolist()) for k, w in enumerate(weights)], "vec_id bigint, weights array<bigint>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        found = topk.search(frame, frame.where("vec_id % 20 = 0"), 5)
        got = sorted(tuple(r) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    # queries were sent 200 times
    assert 0 < sent_bytes(found) < 2 * weights.nbytes
    scores = weights[::20] @ weights.T
    scores[np.arange(450), np.arange(0, 9000, 20)] = -(2**62)
    best = np.argsort(-scores, axis=1, kind="stable")[:, :5]
    assert got == sorted((20 * q, n + 1, int(c), int(scores[q, c])) for q, row in enumerate(best) for n, c in enumerate(row))


@pytest.mark.parametrize("top", [3, 2**13, 2**29])  # many ties; sums for floats of 32 and 64 bits and integers
def test_topk_over_several_places_and_tiles(spark, monkeypatch, top):
    rng = random.Random(top)
    monkeypatch.setattr(topk, "PLACE_ROWS", 40)
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 8)
    rows = [(rng.randrange(-60, 60), [rng.choice([0, rng.randrange(-top, top)]) for _ in range(rng.randrange(5))]) for _ in range(240)]
    rows += rng.choices(rows, k=60) + [(99, [1, -1])] * 12
    frame = spark.createDataFrame(rows, "vec_id bigint, weights array<bigint>").repartition(3)
    for k in (1, 5, 400):
        want = []
        for query, w in {(i, tuple(w)) for i, w in rows if i % 3 == 0}:
            scored = sorted((-sum(a * b for a, b in zip(w, c)), i) for i, c in rows if i != query)[:k]
            want += [(query, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
        got = topk.search(frame, frame.where("vec_id % 3 = 0"), k)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_topk_of_tiles_and_rare_terms():
    import numpy as np

    rng = np.random.default_rng(4)
    for share, width in ((0.002, 700), (0.05, 90), (1.0, 6)):
        queries, candidates = ((rng.random((n, width)) < share) * rng.integers(-3, 4, (n, width)) for n in (20, 1500))
        ids, own = np.sort(rng.integers(0, 900, 1500)), rng.integers(0, 900, 20)
        want = queries @ candidates.T
        best = topk.Best(own, 5, np.float32)
        for start, stop in ((0, 3), (3, 259), (259, 1027), (1027, 1500)):
            table = np.zeros((-(-(stop - start) // topk.STRIP_ROWS) * topk.STRIP_ROWS, width), np.float32)
            table[: stop - start] = candidates[start:stop]
            scores = np.full((20, len(table)), 99, np.float32)
            topk.accumulate(queries.astype(np.float32), table, np.count_nonzero(queries, axis=0), np.count_nonzero(table, axis=0), scores)
            assert (scores[:, : stop - start] == want[:, start:stop]).all()
            best.select(ids[start:stop], scores)
        best.settle()
        for q in range(20):
            scored = sorted((-int(s), int(i)) for s, i in zip(want[q], ids) if i != own[q])[:5]
            assert [(-int(s), int(i)) for s, i in zip(best.scores[q], best.ids[q])] == scored


def test_the_fit_does_not_depend_on_the_order_of_rows(spark):
    import numpy as np

    rng = random.Random(3)
    rows = [(i, sentence(rng, 30, 60 if i % 2 else 400)) for i in range(60)] + [(i, sentence(rng, 30)) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    models = []
    for order in (rows, rows[::-1]):
        models.append(quality.fit(spark.createDataFrame(order, "doc_id bigint, text string").repartition(3), labels))
    assert np.array_equal(models[0].weights, models[1].weights) and models[0].slope == models[1].slope


def test_keep_one_with_the_names_it_uses_itself(spark):
    text = "one two three four five six seven"
    schema = "doc_id bigint, text string, row int, version string, of_doc int, of_version int, number int, first int, rows int, doc int, __doc int, __version int"
    frame = spark.createDataFrame([(k, text, *[k] * 1, "v", *[k] * 8) for k in (3, 1, 1, 2)], schema)
    kept = jaccard.keep_one(frame)
    assert kept.columns == frame.columns and [r["doc_id"] for r in kept.collect()] == [1]


def test_the_fit_holds_little_more_than_its_sample():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    count, features = 512, 4000
    places = [rng.integers(0, quality.GROUPS << quality.BITS, features).astype(np.int32).tobytes() for _ in range(count)]
    given = [rng.random(features).astype(np.float32).tobytes() for _ in range(count)]
    rows = pa.table({"doc_id": range(count), "quality": [k % 2 for k in range(count)], "places": places, "shares": given})
    tracemalloc.start()
    model = quality._train(rows, {0: count, 1: count}, 0.5, rounds=2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.weights.any() and most < 4 * 8 * count * features

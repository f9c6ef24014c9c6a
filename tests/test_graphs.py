"""Components, cycles and clone classes against plain Python."""

import random
from collections import deque

import numpy as np
import pytest

from paperloom.operators import clones, graphs


def plain_components(nodes, edges):
    near = {n: {n} for n in nodes}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for start in sorted(nodes):
        if start in out:
            continue
        queue = deque([start])
        out[start] = start
        while queue:
            for other in near[queue.popleft()]:
                if other not in out:
                    out[other] = start
                    queue.append(other)
    return out


@pytest.mark.parametrize("kind", ["random", "path", "star", "none"])
def test_components(frame, kind):
    rng = random.Random(kind)
    nodes = list(range(300))
    rng.shuffle(nodes)
    edges = {
        "random": [(rng.choice(nodes), rng.choice(nodes)) for _ in range(220)],
        "path": list(zip(nodes[:200], nodes[1:200])),
        "star": [(nodes[0], n) for n in nodes[:250]],
        "none": [],
    }[kind]
    found = graphs.components(frame("node bigint", *[(n,) for n in nodes]), frame("a bigint, b bigint", *edges))
    assert dict(map(tuple, found.collect())) == plain_components(nodes, edges)


def plain_cycles(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)

    def reached(start):
        seen, queue = set(), deque([start])
        while queue:
            for other in near.get(queue.popleft(), ()):
                if other not in seen:
                    seen.add(other)
                    queue.append(other)
        return seen

    ahead = {n: reached(n) for n in {x for e in edges for x in e}}
    return {n: min(m for m in ahead[n] if n in ahead[m]) for n in ahead if n in ahead[n]}


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles(frame, seed):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(40)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(55)] + [("self", "self"), ("a", "b"), ("b", "c")]
    frames = frame("project string, src string, dst string", *[("p", *e) for e in edges], ("q", "n00", "n01"), ("q", "n01", "n00"))
    found = {(r["project"], r["node"]): r["cycle"] for r in graphs.cycles(frames).collect()}
    assert found == {("p", n): c for n, c in plain_cycles(edges).items()} | {("q", "n00"): "n00", ("q", "n01"): "n00"}


def test_no_cycles(frame):
    schema = "project string, src string, dst string"
    assert graphs.cycles(frame(schema, ("p", "a", "b"), ("p", "b", "c"))).collect() == []
    assert graphs.cycles(frame(schema)).collect() == []


def plain_classes(files, size):
    streams = {(p, path): [(t, n) for n, line in enumerate((text or "").split("\n"), 1) for t in clones._TOKEN.findall(line)] for p, path, text in files}
    windows = {}
    for key, tokens in streams.items():
        for s in range(len(tokens) - size + 1):
            windows.setdefault(tuple(t for t, _ in tokens[s : s + size]), []).append((key, s))
    shared = {place: w for w, places in windows.items() if len(places) > 1 for place in places}
    regions, of = {}, {}
    for key, s in sorted(shared):
        if (key, s - 1) in shared:
            of[key, s] = of[key, s - 1]
        else:
            of[key, s] = (key, s)
        regions[of[key, s]] = s + size - of[key, s][1]
    edges = [(of[places[0]], of[p]) for places in windows.values() if len(places) > 1 for p in places]
    classes = plain_components(list(regions), edges)
    members = {c: list(classes.values()).count(c) for c in classes.values()}
    out = []
    for (key, s), n in regions.items():
        lines = streams[key]
        (ckey, cs) = classes[key, s]
        out.append((*key, s, n, lines[s][1], lines[s + n - 1][1], *ckey, cs, members[classes[key, s]]))
    return sorted(out)


@pytest.mark.parametrize("size", [4, 9])
def test_clone_classes(frame, size):
    rng = random.Random(size)
    passages = [[f"w{rng.randrange(30)}" for _ in range(rng.randrange(3, 25))] for _ in range(6)]
    files = []
    for i in range(40):
        words = []
        for _ in range(rng.randrange(4)):
            words += [f"u{rng.randrange(500)}" for _ in range(rng.randrange(8))] + rng.choice(passages)
        files.append((f"p{i % 3}", f"f{i:02d}", "".join(w + rng.choice([" ", "\n", "  ", "\t\n\n"]) for w in words)))
    files += [("p0", "same", "a " * 40), ("p1", "null", None), ("p1", "empty", "")]
    found = sorted(map(tuple, clones.clone_classes(frame("project string, path string, content string", *files), size).collect()))
    assert found == plain_classes(files, size)


def test_every_long_shared_run_shares_a_fingerprint():
    rng = np.random.default_rng(1)
    run, window = clones._split(50)
    assert run + window - 1 == 50
    for _ in range(200):
        common = rng.integers(0, 2**63, 50).astype(np.uint64)
        marks = []
        for _ in range(2):
            around = [rng.integers(0, 2**63, int(rng.integers(0, 60))).astype(np.uint64) for _ in range(2)]
            rolled = clones._rolled(np.concatenate([around[0], common, around[1]]), run)
            marks.append(set(rolled[clones.winnow(rolled, window)].tolist()))
        assert marks[0] & marks[1]


def test_cycles_works_its_edges_out_once(spark, frame):
    seen = spark.sparkContext.accumulator(0)

    def tell(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    schema = "project string, src string, dst string"
    edges = frame(schema, ("p", "a", "b"), ("p", "b", "a"), ("p", "c", "c"), (None, "a", "b"), (None, "b", "a")).mapInArrow(tell, schema)
    assert sorted(tuple(r) for r in graphs.cycles(edges).collect()) == [("p", "a", "a"), ("p", "b", "a"), ("p", "c", "c")]
    assert seen.value == 5


def test_winnow_takes_the_last_least_value():
    rng = np.random.default_rng(5)
    for size, window in ((0, 3), (2, 3), (3, 3), (70_000, 21), (500, 1)):
        values = rng.integers(0, 7, size).astype(np.uint64)
        plain = sorted({max(range(at, at + window), key=lambda k: (-int(values[k]), k)) for at in range(size - window + 1)})
        assert clones.winnow(values, window).tolist() == plain


def test_a_long_copy_tells_few_links(frame, monkeypatch):
    told = []
    plain = clones.components

    def counted(nodes, edges):
        told.append(edges.count())
        return plain(nodes, edges)

    monkeypatch.setattr(clones, "components", counted)
    long = " ".join(f"t{k}" for k in range(400))
    files = frame("project string, path string, content string", ("p", "a", long), ("p", "b", "x " + long + " y"), ("p", "c", "z z " + long))
    rows = clones.clone_classes(files).collect()
    assert sorted((r["path"], r["start_token"], r["tokens"], r["class_path"], r["members"]) for r in rows) == [("a", 0, 400, "a", 3), ("b", 1, 400, "a", 3), ("c", 2, 400, "a", 3)]
    assert told[0] <= 3

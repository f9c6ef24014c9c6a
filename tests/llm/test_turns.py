"""Conversation repair against a search over all edits, with runs cut short so that conversations span many."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from paperloom.llm import turns
from paperloom.llm.queries import QUERIES

ROWS = "conv_id bigint, turn bigint, role string, text string, conv string, run int, place int"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    for conv_id, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        part = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv_id, turn)).encode()) % 20
        if part == 0:
            continue
        text = "" if part == 1 else re.sub("[.!?]", "", text) if part == 2 else text
        yield from [(conv_id, turn, "user" if part == 4 else role, text)] * (2 if part == 3 else 1)


def cheapest(rows):
    """Least (cost, audit) by best-first search over (row, roles so far as a state), and its rows."""
    best, seen = [(0, "", 0, 0, ())], set()
    while best:
        cost, audit, at, state, out = heapq.heappop(best)
        if (at, state) in seen:
            continue
        seen.add((at, state))
        if at == len(rows) and state in (0, 3):
            return cost, audit, out
        role = "user" if state != 2 else "assistant"
        step = 2 if state != 2 else 3
        heapq.heappush(best, (cost + 3, audit + "I", at, step, (*out, (role, ""))))
        if at < len(rows):
            old, text, fault = rows[at]
            heapq.heappush(best, (cost + 4, audit + "D", at + 1, state, out))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                heapq.heappush(best, (cost + more + 3, audit + "R", at + 1, step, (*out, (role, text))))
                if old[:1] == role[0]:
                    heapq.heappush(best, (cost + more, audit + "K", at + 1, step, (*out, (old, text))))
                if old[:1] == "s" and state == 0:
                    heapq.heappush(best, (cost + more, audit + "K", at + 1, 1, (*out, (old, text))))


def plain(rows):
    out = []
    after = list(damaged(rows))
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in after if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        said, faulty, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            last = WORD.findall(text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in said else "truncated" if last[0] not in ".!?" else "fine"
            said.add((role, text))
            counts[fault] = counts.get(fault, 0) + 1
            faulty.append((role, text, fault))
        numbers = [t for t, _, _ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, repaired = cheapest(faulty)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha))
    return sorted(out, key=repr)


def answers(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def odd_rows():
    rng = random.Random(4)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "ulf"]
    texts = ["Yes.", "No!", "Why?", "and then", "", " \t\n", None, "é. ", "🙂", "a.b", "..."]
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randrange(1, 14)):
            role = rng.choice(["user", "assistant"][turn % 2 :]) if rng.random() < 0.6 else rng.choice(roles)
            text = f"{turn} {rng.choice(texts)}" if rng.random() < 0.7 else rng.choice(texts)
            rows.append((conv, rng.choice([None, turn, turn, turn + 3, -turn]), role, text))
    rows += [(70, t, ["user", "assistant"][t % 2], f"Turn {t % 90}.") for t in range(400)] + [(71, 5, "user", "The same.")] * 150
    rows += [(72, 2**40, "user", "x" * 200000 + "."), (73, None, None, None), (74, None, "assistant", "A."), (74, None, "assistant", "A.")]
    return rows


@pytest.mark.parametrize("bits", [3, 14])
def test_repairs_as_a_search_over_all_edits(spark, monkeypatch, bits):
    monkeypatch.setattr(turns, "RUN_BITS", bits)
    rows = odd_rows()
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], ROWS).repartition(4)
    assert answers(turns.repaired_conversations(frame)) == plain(rows)


def test_the_query_agrees_with_the_search(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert answers(QUERIES["op11_turn_repair"](spark, sf_dir)) == plain(rows)


def test_an_empty_table_gives_no_rows(spark):
    assert turns.repaired_conversations(spark.createDataFrame([], ROWS)).collect() == []


def test_paths_are_the_least_of_all_words():
    rng = np.random.default_rng(1)
    names = {turns.FINE: "fine", turns.BLANK: "blank", turns.DUPLICATE: "duplicate", turns.TRUNCATED: "truncated"}
    runs = [rng.integers(0, 16, rng.integers(1, 20)) for _ in range(200)]
    found = turns.paths(runs, np.array([turns.ENDS] * len(runs)))
    for codes, by_entry in zip(runs, found):
        cost, audit, _ = cheapest([("suat"[c % 4], "", names[int(c) // 4]) for c in codes])
        path = by_entry[0]
        assert path.word + "I" * {1: 2, 2: 1}.get(path.exit, 0) == audit
        assert min(turns.product(codes)[0] + turns.ENDS) == cost


def test_repaired_rows_are_a_table(spark):
    rows = [("7", 0, "system", "Be kind."), ("7", 1, "assistant", "Hello."), ("7", 2, "user", ""), ("7", 3, "user", "Bye")]
    frame = spark.createDataFrame(rows, "conv string, turn bigint, role string, text string")
    found = turns.repair(frame).rows.orderBy("run", "step").select("edit", "role", "text").collect()
    assert list(map(tuple, found)) == [("K", "system", "Be kind."), ("I", "user", ""), ("K", "assistant", "Hello."), ("D", "user", ""), ("D", "user", "Bye")]

"""Repair of conversation structure at least cost, the least audit among the cheapest.

The rows of a conversation, in order, are kept, given another role or deleted, and empty turns are
inserted, until the roles read: perhaps a system turn, then user and assistant in turn. The audit is
the edits' initials. A node of the graph is a place between rows and what was emitted last; a row is
a 4 x 4 matrix of costs, so runs of rows multiply in any grouping and a long conversation is cut into
runs that tasks handle apart: matrices forward, cost vectors back. Inside a run the nodes on optimal
arcs are ranked by their least audits of 1, 2, 4 and more letters, each length from pairs of ranks of
the length before, while pointers double with it; the ranks choose the arc of a node and the doubled
pointers read off the path. No two arcs of a node have one letter, so least words lead to one node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.scratch import Scratch

#: Rows of a run at most, as a power of two, and rows whose graphs are ranked together.
RUN_BITS = 14
RANKED_ROWS = 1 << 15

SPACE = r"\x20\x09-\x0D"
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
INITIALS = "sua"
#: States: nothing yet, system, user, assistant; what a user or an assistant turn leads to.
STEP = np.array([2, 2, 3, 2])
#: Cheapest ends of each state by insertions.
ENDS = (0, 6, 3, 0)
LETTERS = "DIKR"
FAR = 1 << 40


def _arc(code: int, state: int, letter: str) -> tuple[int, int] | None:
    """Cost and next state of an edit of a row of a code, or of an insertion before it."""
    fault, initial = divmod(code, 4)
    if letter == "I":
        return 3, int(STEP[state])
    if letter == "D":
        return 4, state
    if fault in (BLANK, DUPLICATE):
        return None
    more = 3 * (fault == TRUNCATED)
    if letter == "R":
        return 3 + more, int(STEP[state])
    if initial == 0:
        return (more, 1) if state == 0 else None
    return (more, int(STEP[state])) if initial < 3 and STEP[state] == initial + 1 else None


#: By letter, code and state: cost, and state reached.
_ARCS = [[[_arc(code, state, letter) or (FAR, state) for state in range(4)] for code in range(16)] for letter in LETTERS]
COST = np.array(_ARCS, np.int64)[..., 0]
NEXT = np.array(_ARCS, np.int64)[..., 1]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 4 x 4 matrices of costs: sums along a path, the least of all paths."""
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(-2), FAR)


def _row_matrices() -> np.ndarray:
    """Costs from state to state over insertions and one row, by code."""
    insert = np.full((4, 4), FAR, np.int64)
    for state in range(4):
        insert[state, state] = 0
        insert[state, STEP[state]] = min(insert[state, STEP[state]], 3)
    insert = times(insert, insert)
    rows = np.full((16, 4, 4), FAR, np.int64)
    for letter in (0, 2, 3):
        for code in range(16):
            for state in range(4):
                to = NEXT[letter, code, state]
                rows[code, state, to] = min(rows[code, state, to], COST[letter, code, state])
    return times(insert[None], rows)


ROW = _row_matrices()


def product(codes: np.ndarray) -> np.ndarray:
    """The matrix of a run of rows, halving the number of factors each time."""
    factors = ROW[codes]
    while len(factors) > 1:
        odd = factors[-1:] if len(factors) % 2 else factors[:0]
        factors = np.concatenate([times(factors[0 : len(factors) - len(odd) : 2], factors[1 : len(factors) : 2]), odd])
    return factors[0]


class Path(NamedTuple):
    word: str
    seats: str
    rows: list[int]
    exit: int


def paths(runs: list[np.ndarray], ends: np.ndarray) -> list[list[Path | None]]:
    """For each run of codes, given the least costs from the four states after it, the path of least
    audit from each state before it: its letters, the states they lead to, the row each handles (for
    an insertion the one after it) and the state it ends in. None where no end can be reached."""
    sizes = np.array([len(r) for r in runs])
    order = np.argsort(-sizes, kind="stable")
    base = np.cumsum((sizes + 1) * 4) - (sizes + 1) * 4
    total = int(((sizes + 1) * 4).sum())
    cost = np.full(total, FAR, np.int64)
    codes = np.zeros(total, np.int64)
    last = np.zeros(total, bool)
    states = np.arange(4)
    cost[(base + sizes * 4)[:, None] + states] = ends
    last[(base + sizes * 4)[:, None] + states] = True
    flat = np.concatenate(runs).astype(np.int64)
    first = np.cumsum(sizes) - sizes
    layer = np.arange(len(flat)) - np.repeat(first, sizes)
    codes[(np.repeat(base, sizes) + layer * 4)[:, None] + states] = flat[:, None]
    for at in range(int(sizes.max()) - 1, -1, -1):
        own = order[: int((sizes > at).sum())]
        here = base[own] + at * 4
        then = cost[(here + 4)[:, None] + states]
        cost[here[:, None] + states] = np.minimum((ROW[flat[first[own] + at]] + then[:, None, :]).min(2), FAR)

    # optimal arcs of every node, by letter
    node = np.arange(total)
    state = (node - np.repeat(base, (sizes + 1) * 4)) % 4
    heads = np.stack([node - state + (0 if letter == "I" else 4) + NEXT[k, codes, state] for k, letter in enumerate(LETTERS)])
    heads[:, last] = node[last]
    weights = np.stack([COST[k, codes, state] for k in range(4)])
    usable = (weights + cost[heads] == cost) & ~last & (cost < FAR)

    # ranks of least audits of 1, 2, 4 ... letters, and where these lead
    letter = np.where(usable.any(0), usable.argmax(0) + 1, 0)
    rank, jump = letter, heads[np.maximum(letter - 1, 0), node]
    jump = np.where(letter > 0, jump, node)
    jumps = [jump]
    while (letter[jump] > 0).any():
        rank = np.unique(rank * (int(rank.max()) + 1) + rank[jump], return_inverse=True)[1].reshape(-1)
        jump = jump[jump]
        jumps.append(jump)
    # the arc of a node: the least letter, then the least rank after it
    choice = np.where(usable, (np.arange(4)[:, None] + 1) * (int(rank.max()) + 1) + rank[heads], 1 << 62).argmin(0)
    chosen = np.where(letter > 0, heads[choice, node], node)

    out = []
    for b, size, run in zip(base, sizes, range(len(runs)), strict=True):
        found: list[Path | None] = []
        for entry in range(4):
            start = int(b) + entry
            if cost[start] >= FAR:
                found.append(None)
                continue
            # the length is found from the longest pointer down, then every offset is read at once
            length, here = 0, start
            if letter[start]:
                for k in range(len(jumps) - 1, -1, -1):
                    if letter[jumps[k][here]]:
                        here, length = int(jumps[k][here]), length + (1 << k)
                length += 1
            offsets = np.arange(length)
            nodes = np.full(length, start)
            for k, doubled in enumerate(jumps):
                go = (offsets >> k) & 1 == 1
                nodes[go] = doubled[nodes[go]]
            to = chosen[nodes]
            word = "".join([LETTERS[i] for i in choice[nodes]])
            seats = "".join(map(str, (to - b) % 4))
            rows = ((nodes - b) // 4).tolist()
            end = int(to[-1] - b) % 4 if length else entry
            found.append(Path(word, seats, rows, end))
        out.append(found)
    return out


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text) with planted faults, by the checksum of ``conv_id:turn``; ``conv`` is
    the id as text. Nulls in role, text and the checked text count as one space; the turn stays null."""

    def text(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    part = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = conversations.select(text("conv_id").alias("conv"), F.col("turn").cast("bigint").alias("turn"), text("role").alias("role"), text("text").alias("text"), part.alias("part"))
    body = F.when(F.col("part") == 1, "").when(F.col("part") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.where("part <> 0").withColumn("copies", F.when(F.col("part") == 3, 2).otherwise(1))
    role = F.when(F.col("part") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv", "turn", role.alias("role"), body.alias("text"), F.explode(F.expr("array_repeat(0, copies)")).alias("copy")).drop("copy")


def _placed(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """All rows with their fault and their place: ``run`` (rows of a task's range, in order) and ``place``."""
    key = ["conv", "turn", "role", "text"]
    groups = scratch.write(turns.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "groups")
    order = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)))
    said = groups.groupBy("conv", "role", "text").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("places"))
    groups = groups.join(said.where("places > 1").drop("places"), ["conv", "role", "text"], "left")
    rows = groups.select(*key, (F.coalesce(F.col("first"), order) < order).alias("later"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("copy"))
    fault = F.when(~F.col("text").rlike(f"[^{SPACE}]"), BLANK).when(F.col("later") | (F.col("copy") > 1), DUPLICATE)
    fault = fault.when(~F.col("text").rlike(f"[.!?][{SPACE}]*\\z"), TRUNCATED).otherwise(FINE)
    initial = F.expr(f"instr('{INITIALS}', substring(role, 1, 1))")
    initial = F.when((F.col("role") == "") | (initial == 0), 3).otherwise(initial - 1)
    rows = rows.repartitionByRange(*key, "copy").sortWithinPartitions(*key, "copy")
    numbered = rows.select(*key, fault.alias("fault"), (fault * 4 + initial).cast("int").alias("code"), F.monotonically_increasing_id().alias("place"))
    return scratch.write(numbered.withColumn("run", F.shiftright("place", RUN_BITS)), "placed")


def _each(df: DataFrame, schema: str, names: list[str], handle: Callable[[list[dict]], list[tuple]], weight: str | None = None) -> DataFrame:
    """Rows made from rows in batches; with ``weight`` a batch ends once that list column adds up to RANKED_ROWS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = empty.schema
        for batch in batches:
            held, load = [], 0
            for row in batch.to_pylist():
                held.append(row)
                load += len(row[weight]) if weight else 1
                if load >= RANKED_ROWS:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, t, strict=True)) for t in handle(held)], schema=kinds)
                    held, load = [], 0
            if held:
                yield pa.RecordBatch.from_pylist([dict(zip(names, t, strict=True)) for t in handle(held)], schema=kinds)

    empty = df.sparkSession.createDataFrame([], schema).toArrow()
    return df.mapInArrow(run, schema)


def _illegal(initials: list[int]) -> int:
    return sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(initials, initials[1:]))


def _summaries(rows: list[dict]) -> list[tuple]:
    out = []
    for row in rows:
        codes = np.array(row["codes"])
        initials = codes % 4
        out.append((row["conv"], row["run"], row["start"], row["codes"], product(codes).ravel().tolist(), _illegal(initials.tolist()), int(initials[0]), int(initials[-1])))
    return out


def _chains(rows: list[dict]) -> list[tuple]:
    """Costs after each run of a conversation, from its last run back; totals go with its first."""
    out = []
    for row in rows:
        runs, ends = row["runs"], np.array(ENDS, np.int64)
        illegal = sum(r["illegal"] for r in runs) + sum(_illegal([a["tail"], b["head"]]) for a, b in zip(runs, runs[1:]))
        for number in range(len(runs) - 1, -1, -1):
            before = np.minimum((np.array(runs[number]["matrix"]).reshape(4, 4) + ends).min(1), FAR)
            totals = (int(before[0]), illegal) if not number else (None, None)
            out.append((row["conv"], runs[number]["run"], ends.tolist(), number == len(runs) - 1, len(runs), *totals))
            ends = before
    return out


def _solved(rows: list[dict]) -> list[tuple]:
    out = []
    found = paths([np.array(r["codes"]) for r in rows], np.array([r["ends"] for r in rows], np.int64))
    for row, by_entry in zip(rows, found, strict=True):
        exits, said = [], []
        for path in by_entry:
            if path is not None and row["last"]:  # what is left to insert at the end
                more = {1: "23", 2: "3"}.get(path.exit, "")
                path = Path(path.word + "I" * len(more), path.seats + more, path.rows + [len(row["codes"])] * len(more), path.exit)
            exits.append(None if path is None else path.exit)
            said.append(None if path is None else {"word": path.word, "seats": path.seats, "rows": path.rows})
        out.append((row["conv"], row["run"], row["start"], row["runs"], exits, said))
    return out


def _entries(rows: list[dict]) -> list[tuple]:
    out = []
    for row in rows:
        state = 0
        for run in row["runs"]:
            out.append((row["conv"], run["run"], state))
            state = run["exits"][state]
    return out


class Repair(NamedTuple):
    #: conv, run, step, edit, role, text of all rows after the repair and of deleted ones, in the order (run, step)
    rows: DataFrame
    #: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256
    conversations: DataFrame


def repair(turns: DataFrame) -> Repair:
    """Repair the conversations of columns conv (text), turn, role, text; only the turn may be null.

    Rows are taken by turn, nulls first, ties by role and text, so equal rows stand together. A role
    counts by its first character, an empty one by none. Long conversations are cut into runs of at most
    2 ** RUN_BITS rows, of which a task sees one at a time; a conversation brings one short row per run
    together, and its audit and its digest, which are single values, are put together at the end from one
    piece per run. Tables between the steps are written to the shared folder."""
    scratch = Scratch(turns.sparkSession)
    placed = _placed(turns.select("conv", "turn", "role", "text"), scratch)

    gathered = placed.groupBy("conv", "run").agg(F.min("place").alias("start"), F.array_sort(F.collect_list(F.struct("place", "code"))).alias("rows"))
    gathered = gathered.select("conv", "run", "start", F.col("rows.code").alias("codes"))
    names = ["conv", "run", "start", "codes", "matrix", "illegal", "head", "tail"]
    schema = "conv string, run bigint, start bigint, codes array<int>, matrix array<bigint>, illegal bigint, head int, tail int"
    runs = scratch.write(_each(gathered, schema, names, _summaries, "codes"), "runs")

    short = F.struct("run", "matrix", "illegal", "head", "tail")
    chained = runs.groupBy("conv").agg(F.array_sort(F.collect_list(short)).alias("runs"))
    names = ["conv", "run", "ends", "last", "runs", "cost", "illegal"]
    schema = "conv string, run bigint, ends array<bigint>, last boolean, runs int, cost bigint, illegal bigint"
    chains = scratch.write(_each(chained, schema, names, _chains), "chains")

    known = runs.select("conv", "run", "start", "codes").join(chains.select("conv", "run", "ends", "last", "runs"), ["conv", "run"])
    # codes are small and the work on them is not, so they are dealt out whatever their size
    known = known.repartition(int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv", "run")
    names = ["conv", "run", "start", "runs", "exits", "paths"]
    schema = "conv string, run bigint, start bigint, runs int, exits array<int>, paths array<struct<word: string, seats: string, rows: array<int>>>"
    solved = scratch.write(_each(known, schema, names, _solved, "codes"), "solved")

    joined = solved.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("run", "exits"))).alias("runs"))
    entries = _each(joined, "conv string, run bigint, entry int", ["conv", "run", "entry"], _entries)
    picked = solved.join(entries, ["conv", "run"]).select("conv", "run", "start", "runs", F.get("paths", F.col("entry")).alias("path"))
    picked = scratch.write(picked.select("conv", "run", "start", "runs", "path.*"), "picked")

    letters, seats = F.split("word", ""), F.split("seats", "")
    steps = picked.select("conv", "run", "start", F.posexplode(F.arrays_zip(letters.alias("edit"), seats.alias("seat"), F.col("rows").alias("at"))).alias("step", "s"))
    steps = steps.where("s.at IS NOT NULL").select("conv", "run", "step", "s.edit", "s.seat", F.when(F.col("s.edit") != "I", F.col("start") + F.col("s.at")).alias("place"))
    given = F.when(F.col("seat") == "2", "user").otherwise("assistant")
    old = placed.select("conv", "place", F.col("role").alias("old_role"), "text")
    rows = steps.join(old, ["conv", "place"], "left")
    role = F.when(F.col("edit").isin("K", "D"), F.col("old_role")).otherwise(given)
    rows = rows.select("conv", "run", "step", "edit", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    audits = picked.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("run", "word"))).alias("words"))
    audits = audits.select("conv", F.array_join("words.word", "").alias("audit"))
    by_turn = placed.groupBy("conv", "turn").agg(*[F.count_if(F.col("fault") == k).alias(n) for n, k in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0).cast("bigint")).alias("gaps")
    counts = by_turn.groupBy("conv").agg(gaps, *[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")])
    totals = chains.where("cost IS NOT NULL").select("conv", "illegal", "cost")
    said = counts.join(totals, "conv").join(audits, "conv").join(_digests(rows, picked), "conv")
    return Repair(rows, said)


def _digests(rows: DataFrame, picked: DataFrame) -> DataFrame:
    """SHA-256 of every conversation's rows ``role:text`` joined by line feeds. Rows are joined to one
    piece per run; a conversation of several runs streams its pieces, in order, through one digest."""
    line = F.struct("step", F.concat_ws(":", "role", "text").alias("line"))
    pieces = rows.where("edit <> 'D'").groupBy("conv", "run").agg(F.array_join(F.array_sort(F.collect_list(line))["line"], "\n").alias("piece"))
    pieces = picked.select("conv", "run", "runs").join(pieces, ["conv", "run"], "left")
    single = pieces.where("runs = 1").select("conv", F.sha2(F.coalesce("piece", F.lit("")), 256).alias("repaired_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, begun = None, hashlib.sha256(), False
        for batch in batches:
            for name, piece in zip(batch.column("conv").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                if conv is not None and name != conv:
                    yield pa.RecordBatch.from_pydict({"conv": [conv], "repaired_sha256": [state.hexdigest()]})
                    state, begun = hashlib.sha256(), False
                conv = name
                if piece is not None:
                    state.update(("\n" if begun else "").encode() + piece.encode())
                    begun = True
        if conv is not None:
            yield pa.RecordBatch.from_pydict({"conv": [conv], "repaired_sha256": [state.hexdigest()]})

    several = pieces.where("runs > 1").select("conv", "run", "piece").repartition("conv").sortWithinPartitions("conv", "run")
    return single.unionAll(several.select("conv", "piece").mapInArrow(run, "conv string, repaired_sha256 string"))


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """Damage the rows, repair them and report one row for every original conv_id, null among them; other
    columns are ignored. A conversation without rows after the damage has zeros, an empty audit and the
    digest of an empty text; an empty table gives no rows."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    ids = rows.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    ids = ids.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    said = ids.join(repair(damage(rows)).conversations, "conv", "left")
    numbers = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256().hexdigest())
    return said.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))

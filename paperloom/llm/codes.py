"""Vector compression by product codes, trained with member-resident Lloyd rounds.

A vector is cut into equal parts, and each part position has a codebook of its own. The parts of all
vectors are members of owners (position, entry, salt); a table holds every owner's members together.
An owner sums the members it has, so an update moves sums only; the next round compares members with
the new entries where they lie, and only those whose nearest entry changed go through a shuffle to
their new owner. Salts cut the members of an entry that many parts have into many owners.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.scratch import Scratch

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Members of one position for which a salt is added, and the least number of salts.
MEMBERS_PER_SALT = 1 << 16
LEAST_SALTS = 16
#: Members compared with a codebook at once.
SLICE = 4096


class Shape(NamedTuple):
    rows: int
    parts: int
    width: int


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """All columns of the rows whose ``embedding`` is not null and holds no null or non-finite component,
    with ``weights``: each component times ``scale``, rounded down. Any column of that name is replaced."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col("embedding").isNotNull() & finite)
    return rows.withColumn("weights", F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def shape(rows: DataFrame, scale: int = SCALE, parts: int = PARTS) -> Shape:
    """Number of usable rows and width of a part. Squared distances and sums are exact 64-bit integers;
    components too large for that raise an OverflowError."""
    size = F.max(F.size("embedding"))
    largest = F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))))
    count, longest, most = rows.agg(F.count(F.lit(1)), size, largest).first()
    width = -(-(longest or 0) // parts)
    reach = (most or 0.0) * scale + 1
    if width * parts * (2 * reach) ** 2 >= 2**62 or count * reach >= 2**62:
        raise OverflowError(f"components up to {most} do not give exact 64-bit sums")
    return Shape(count, parts, width)


def _table(weights: pa.Array, form: Shape) -> np.ndarray:
    """Lists of integers as (row, part, component), short ones filled up with zeros."""
    columns = form.parts * form.width
    sizes = pa.compute.list_value_length(weights).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), columns), np.int64)
    out[np.arange(columns) < sizes[:, None]] = weights.flatten().to_numpy(zero_copy_only=False)
    return out.reshape(len(sizes), form.parts, form.width)


def nearest(members: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry at the least squared Euclidean distance of each member, ties to the lower index, and
    that distance."""
    best, error = np.zeros(len(members), np.int64), np.zeros(len(members), np.int64)
    for start in range(0, len(members), SLICE):
        part = members[start : start + SLICE]
        far = np.zeros((len(part), len(entries)), np.int64)
        for i in range(members.shape[1]):
            step = part[:, i, None] - entries[None, :, i]
            far += step * step
        best[start : start + SLICE] = far.argmin(1)
        error[start : start + SLICE] = far.min(1)
    return best, error


def first_codebooks(rows: DataFrame, form: Shape, entries: int = ENTRIES) -> np.ndarray:
    """The parts of the vectors of the smallest ids, by position and entry. Of an id with several
    vectors the least one counts; null ids give no entry. At most ``entries`` rows reach the driver."""
    named = rows.where(F.col("vec_id").isNotNull())
    ids = [r[0] for r in named.select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    least = named.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("weights").alias("weights"))
    found = dict(map(tuple, least.collect())) if ids else {}
    table = np.zeros((len(ids), form.parts * form.width), np.int64)
    for row, vec_id in zip(table, ids, strict=True):
        row[: len(found[vec_id])] = found[vec_id]
    return table.reshape(len(ids), form.parts, form.width).transpose(1, 0, 2)


def _members(rows: DataFrame, form: Shape, codebooks: np.ndarray, salts: int) -> DataFrame:
    """A row for each part: position, target (its nearest entry), salt and components v0, v1 and so on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = 0
        for batch in batches:
            table = _table(batch.column("weights"), form)
            salt = (met + np.arange(len(table))) % salts
            met += len(table)
            for position in range(form.parts):
                part = table[:, position]
                columns = [np.full(len(part), position, np.int32), nearest(part, codebooks[position])[0].astype(np.int32), salt.astype(np.int32), *part.T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=_names(form))

    return rows.select("weights").mapInArrow(run, _schema(form))


def _names(form: Shape) -> list[str]:
    return ["position", "target", "salt", *[f"v{i}" for i in range(form.width)]]


def _schema(form: Shape) -> str:
    return ", ".join(f"{name} {'bigint' if name[0] == 'v' else 'int'}" for name in _names(form))


def _compared(members: DataFrame, form: Shape, codebooks: np.ndarray) -> DataFrame:
    """The members where they lie, with ``home``, the entry whose owner has them, and their new target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            position = batch.column("position").to_numpy()
            values = [batch.column(f"v{i}").to_numpy() for i in range(form.width)]
            table = np.stack(values, 1) if values else np.zeros((len(position), 0), np.int64)
            target = np.zeros(len(position), np.int32)
            for p in np.unique(position):
                own = position == p
                target[own] = nearest(table[own], codebooks[p])[0]
            columns = [batch.column("position"), pa.array(target), *[batch.column(n) for n in _names(form)[2:]], batch.column("target")]
            yield pa.RecordBatch.from_arrays(columns, names=[*_names(form), "home"])

    return members.select(*_names(form)).mapInArrow(run, f"{_schema(form)}, home int")


def _updated(members: DataFrame, form: Shape, codebooks: np.ndarray) -> np.ndarray:
    """Every entry as its members' mean, rounded down; entries without members stay. Each owner sums its
    members in place; one row of sums for each entry of a position comes to the driver."""
    sums = [F.sum(f"v{i}").alias(f"v{i}") for i in range(form.width)]
    out = codebooks.copy()
    for row in members.groupBy("position", "target").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        out[row["position"], row["target"]] = [row[f"v{i}"] // row["n"] for i in range(form.width)]
    return out


def fit(rows: DataFrame, form: Shape, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (position, entry, component) after Lloyd rounds over all usable rows; the tables of
    members are written to the shared folder and removed. The driver holds the codebooks only."""
    codebooks = first_codebooks(rows, form, entries)
    if not rounds or not codebooks.shape[1]:
        return codebooks
    scratch = Scratch(rows.sparkSession)
    salts = max(LEAST_SALTS, form.rows // MEMBERS_PER_SALT)
    owner = ["position", "target", "salt"]
    members = scratch.write(_members(rows, form, codebooks, salts).repartition(*owner), "members")
    for round_number in range(rounds):
        if round_number:
            compared = scratch.write(_compared(members, form, codebooks), "compared")
            staying = compared.where("home = target").drop("home")
            moving = compared.where("home <> target").drop("home")
            members = staying.unionAll(moving.repartition(*owner))
        codebooks = _updated(members, form, codebooks)
    scratch.remove()
    return codebooks


def encode(rows: DataFrame, form: Shape, codebooks: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of usable rows with ``code`` (the index of each part's nearest entry, two hex
    digits or as many as the codebook needs) and ``error`` (their squared distances summed). With empty
    codebooks both are null."""
    digits = max(2, len(f"{max(codebooks.shape[1] - 1, 0):x}"))
    kept = [f.dataType.simpleString() for c in keep for f in rows.schema.fields if f.name == c]
    names = [f"kept{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = _table(batch.column("weights"), form)
            if codebooks.shape[1]:
                found = [nearest(table[:, p], codebooks[p]) for p in range(form.parts)]
                said = np.array([f"{i:0{digits}x}" for i in range(codebooks.shape[1])])
                places = np.stack([f[0] for f in found], 1)
                code = pa.array(["".join(row) for row in said[places]], pa.string())
                error = pa.array(sum(f[1] for f in found), pa.int64())
            else:
                code, error = pa.nulls(len(table), pa.string()), pa.nulls(len(table), pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], code, error], names=[*names, "code", "error"])

    given = rows.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], "weights")
    schema = ", ".join([f"{n} {kind}" for n, kind in zip(names, kept, strict=True)] + ["code string", "error bigint"])
    coded = given.mapInArrow(run, schema)
    return coded.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "code", "error")


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all entries' components by position, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame) -> DataFrame:
    """Columns vec_id, label, code, error, label_error (error summed over equal labels, nulls together) and
    codebooks_sha256 of every usable row. Null vectors and those with null or non-finite components are
    left out; shorter vectors count as filled up with zeros to the longest, and that to a multiple of the
    parts; repeated rows are coded each; of an id with several vectors the least starts an entry, null ids
    start none; fewer ids give smaller codebooks, an empty table gives no rows. Other columns are ignored."""
    rows = usable(vectors.select(F.col("vec_id").cast("bigint"), "embedding", "label"))
    form = shape(rows)
    codebooks = fit(rows, form)
    coded = encode(rows, form, codebooks, ["vec_id", "label"])
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")
    return joined.withColumn("codebooks_sha256", F.lit(digest(codebooks)))

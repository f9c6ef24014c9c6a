"""Run every registered query on Spark and its SQL on DuckDB and compare names, types and rows.

    python tests/compare.py [sf_dir] [query prefix ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _rows(table):
    names = sorted(table.column_names)
    rows = list(zip(*[table.column(n).to_pylist() for n in names])) if names else []
    return names, sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


def difference(spark_df, con, sql: str):
    """None when both sides agree, else a short description."""
    left = spark_df.toArrow()
    right = con.execute(sql).fetch_arrow_table() if hasattr(con, "fetch_arrow_table") else con.sql(sql).arrow()
    if hasattr(right, "read_all"):
        right = right.read_all()
    names, a = _rows(left)
    other, b = _rows(right)
    if names != other:
        return f"columns {names} <> {other}"
    types = {n: (str(left.schema.field(n).type), str(right.schema.field(n).type)) for n in names}
    wrong = {n: t for n, t in types.items() if t[0].replace("large_", "") != t[1].replace("large_", "") and "timestamp" not in t[0]}
    if a != b:
        only_a = [r for r in a if r not in set(b)][:2] if len(a) < 50000 else []
        only_b = [r for r in b if r not in set(a)][:2] if len(b) < 50000 else []
        return f"{len(a)} rows <> {len(b)} rows\n   spark {only_a!r:.900}\n   duckdb {only_b!r:.900}"
    if wrong:
        return f"types {wrong}"
    return None


def main():
    import __spark_entry__ as entry
    from paperloom.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g"
    )
    spark.sparkContext.setLogLevel("OFF")
    con, oracles, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        if name not in oracles:
            print(f"{name}: no SQL")
            continue
        start = time.time()
        try:
            found = difference(query(spark, sf_dir), con, oracles[name])
        except Exception as error:  # noqa: BLE001
            found = f"{type(error).__name__}: {str(error)[:700]}"
        bad += found is not None
        print(f"{name}: {found or 'ok'} ({time.time() - start:.1f}s)", flush=True)
    print(f"{bad} different")


if __name__ == "__main__":
    main()

"""Runs registered queries against their oracle SQL: python tests/compare.py [sf_dir] [name ...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from plumbline.session import TABLES, build_session  # noqa: E402


def connect(root: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("set TimeZone = 'UTC'")
    for table in TABLES:
        db.execute(f"create view {table} as select * from read_parquet('{root}/{table}.parquet')")
    return db


def plain(value):
    if isinstance(value, bool):
        return int(value)
    if value is None:
        return None
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, str):
        return value
    try:
        number = float(value)
    except (TypeError, ValueError):
        return str(value)
    return None if math.isnan(number) else round(number, 9) + 0.0


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, db, name, fn, sql, root) -> str | None:
    """None when both sides agree, else what differs."""
    frame = fn(spark, root)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if sql is None:
        return None if got else "no rows"
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} against {sorted(names)}"
    want = rows_of(names, result.fetchall())
    if got == want:
        return None
    only_got = [r for r in got if r not in set(want)][:2]
    only_want = [r for r in want if r not in set(got)][:2]
    return f"{len(got)} rows against {len(want)}; only here {only_got}; only oracle {only_want}"


def main() -> int:
    from plumbline.suite import ORACLES, QUERIES

    root = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    chosen = sys.argv[2:] or list(QUERIES)
    spark = build_session("local[8]", 8, **{"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    db, failures = connect(root), 0
    for name in chosen:
        start = time.time()
        try:
            problem = compare(spark, db, name, QUERIES[name], ORACLES.get(name), root)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failures += problem is not None
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {name} {time.time() - start:.1f}s {'' if name in ORACLES else '(rows only) '}{problem or ''}", flush=True)
    print(f"{len(chosen) - failures} of {len(chosen)} agree")
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main())

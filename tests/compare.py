"""Compare registered queries with their SQL: python tests/compare.py [sf_dir] [name ...]."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def both(spark, con, query, sql: str, sf_dir: str) -> tuple[list, list, list, list]:
    df = query(spark, sf_dir)
    got = df.collect()
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    return sorted(df.columns), sorted(names), rows_of(df.columns, got), rows_of(names, rel.fetchall())


if __name__ == "__main__":
    from tideglass.plans import catalog
    from tideglass.plans.catalog import ORACLE
    from tideglass.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session, con = build_session(master=f"local[{os.environ.get('COMPARE_CPUS', 8)}]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}), duck(folder)
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(f"/tmp/compare-{time.time_ns()}")
    for name in sys.argv[2:] or list(catalog.QUERIES):
        start = time.time()
        try:
            if name in ORACLE:
                a, b, got, want = both(session, con, catalog.QUERIES[name], ORACLE[name], folder)
                ok = a == b and got == want
                print(name, "ok" if ok else "DIFFERS", len(got), len(want), f"{time.time() - start:.1f}s", flush=True)
                if not ok:
                    print("  ", a, b, sorted(set(got) - set(want), key=repr)[:3], sorted(set(want) - set(got), key=repr)[:3])
            else:
                print(name, "rows only", len(catalog.QUERIES[name](session, folder).collect()), f"{time.time() - start:.1f}s", flush=True)
        except Exception as e:
            print(name, "FAILED", str(e)[:700], flush=True)

"""Compare queries with their SQL: python tests/oracle.py SF [NAME...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def frames(spark, sf_dir: str, name: str) -> tuple[pd.DataFrame, pd.DataFrame]:
    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return entry.queries()[name](spark, sf_dir).toPandas(), con.execute(entry.oracle_sql()[name]).df()


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} {len(want)}"
    text = lambda df: sorted("|".join("∅" if pd.isna(v) else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    a, b = text(got), text(want)
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} rows differ, as {bad[:2]}" if bad else ""


if __name__ == "__main__":
    from conftest import session

    import __spark_entry__ as entry

    spark = session()
    for name in sys.argv[2:] or list(entry.queries()):
        if name not in entry.queries():
            continue
        t = time.time()
        try:
            if name in entry.oracle_sql():
                got, want = frames(spark, f"/root/testdata/sf{sys.argv[1]}", name)
                print(name, "OK" if not (d := differences(got, want)) else "DIFFERS " + d, len(got), round(time.time() - t, 1), flush=True)
            else:
                print(name, "rows", entry.queries()[name](spark, f"/root/testdata/sf{sys.argv[1]}").count(), round(time.time() - t, 1), flush=True)
        except Exception as e:
            print(name, "FAILED", type(e).__name__, str(e)[:400].replace("\n", " "), flush=True)

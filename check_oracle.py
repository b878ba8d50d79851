"""Compare registered queries with their SQL on DuckDB: python check_oracle.py [sf_dir] [name ...]."""

import sys
import time

import duckdb
import pandas as pd

from rippleframe.plans import REGISTRY
from rippleframe.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
            return tuple(cell(x) for x in v)
        if isinstance(v, (bytes, bytearray)):
            return bytes(v)
        if pd.isna(v):
            return None
        return v.item() if hasattr(v, "item") else v

    rows = [tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)]
    return sorted(rows, key=repr)


def compare(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(sql_df.columns)}"
    a, b = canonical(spark_df), canonical(sql_df)
    if a == b:
        return "ok"
    extra = [r for r in a if r not in set(b)][:2] if len(a) < 50000 else []
    missing = [r for r in b if r not in set(a)][:2] if len(b) < 50000 else []
    n = sum(x != y for x, y in zip(a, b))
    return f"rows {len(a)} vs {len(b)}, {n} differ; spark only {extra}; sql only {missing}"


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(REGISTRY)
    spark = build_session(cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for name in names:
        q, start = REGISTRY[name], time.time()
        try:
            got = q.build(spark, sf_dir).toPandas()
            took = time.time() - start
            if q.sql is None:
                verdict = f"rows only, {len(got)} rows"
            else:
                verdict = compare(got, con.execute(q.sql).fetchdf())
        except Exception as e:  # noqa: BLE001
            took, verdict = time.time() - start, f"ERROR {str(e)[:1200]}"
        bad += not verdict.startswith(("ok", "rows only"))
        print(f"{name:28s} {took:6.2f}s {len(got) if verdict[0] != 'E' else 0:7d} {verdict}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

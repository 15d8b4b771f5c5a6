"""Run queries next to their SQL and compare rows. Usage: python -m tests.oracle [--blocks | --plain] SF_DIR [names]."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def plain(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
            return None
        if isinstance(v, (bool,)) or type(v).__name__ == "bool_":
            return bool(v)
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, float):
            return float(f"{v:.12g}")
        return v

    rows = [tuple(plain(v) for v in r) for r in df.astype(object).itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((x is not None, str(x)) for x in r))


def compare(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str:
    """Empty when equal, else what differs."""
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} vs {len(sql_df)}"
    a, b = canonical(spark_df), canonical(sql_df)
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        return f"{len(diff)} rows differ, first {diff[0]}"
    kinds = []
    for c in sorted(spark_df.columns):
        ks, kd = spark_df[c].dtype.kind, sql_df[c].dtype.kind
        if ks != kd and len(spark_df):
            kinds.append(f"{c}: {spark_df[c].dtype} vs {sql_df[c].dtype}")
    return f"(types {kinds})" if kinds else ""


def main() -> None:
    import __spark_entry__ as entry
    from folioscan.session import build_session

    # --blocks treats groups of over 20 rows as hot and keeps tiny partitions apart.
    # --plain takes the session as Spark makes it.
    blocks, bare = "--blocks" in sys.argv, "--plain" in sys.argv
    folder, *only = [a for a in sys.argv[1:] if not a.startswith("--")]
    spark = SparkSession.builder.master("local[8]").config(
        "spark.ui.enabled", "false").getOrCreate() if bare else build_session("oracle", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.folioscan.hotRows": "20" if blocks else "2000000",
        "spark.sql.adaptive.coalescePartitions.enabled": str(not blocks).lower()})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if only and not any(name == o or (o.endswith("*") and name.startswith(o[:-1]))
                            for o in only):
            continue
        try:
            t = time.time()
            got = fn(spark, folder).toPandas()
            spent = time.time() - t
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark {str(e)[:1500]}", flush=True)
            bad += 1
            continue
        if name not in oracles:
            print(f"rows {name}: {len(got)} rows, {spent:.2f}s", flush=True)
            continue
        try:
            t = time.time()
            want = con.execute(oracles[name]).df()
            sql_time = time.time() - t
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: sql {str(e)[:1200]}", flush=True)
            bad += 1
            continue
        said = compare(got, want)
        bad += bool(said) and not said.startswith("(types")
        print(f"{'ok  ' if not said else 'warn' if said.startswith('(types') else 'DIFF'} {name}: "
              f"{len(got)} rows, spark {spent:.2f}s, sql {sql_time:.2f}s {said[:900]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()

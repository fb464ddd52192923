"""Compare registered queries with their oracle SQL: python tests/check_oracles.py [sf] [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

import __spark_entry__ as entry  # noqa: E402
from trovelake.runtime import local_session  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or str(df[c].dtype) in ("string", "str"):
            df[c] = df[c].map(lambda v: "<null>" if v is None or v != v else str(v))
        elif df[c].dtype != bool:
            df[c] = df[c].astype(float).round(9).fillna(-1e300)  # null equals null
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def difference(spark_df: pd.DataFrame, oracle_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(oracle_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(oracle_df.columns)}"
    if len(spark_df) != len(oracle_df):
        return f"rows {len(spark_df)} against {len(oracle_df)}"
    a, b = normal(spark_df), normal(oracle_df)
    same = (a.values == b.values).all(axis=1) if len(a) else None
    if same is None or same.all():
        return None
    at = int((~same).argmax())
    return f"{int((~same).sum())} rows differ, first {a.iloc[at].to_dict()} against {b.iloc[at].to_dict()}"


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def type_difference(schema, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    mine = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in schema}
    other = {row[0]: row[1] for row in con.execute(f"DESCRIBE {sql}").fetchall()}
    wrong = {c: (t, other.get(c)) for c, t in mine.items() if other.get(c) != t}
    return f"types {wrong}" if wrong else None


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("oracles", cores="8")
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        started = time.time()
        try:
            result = run(spark, sf_dir)
            got = result.toPandas()
            middle = time.time()
            problem = type_difference(result.schema, con, sql[name]) or difference(
                got, con.execute(sql[name]).df()
            )
        except Exception as error:  # report and go on with the next query
            got, middle, problem = (), time.time(), f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        took = f"spark {middle - started:.1f}s oracle {time.time() - middle:.1f}s"
        print(f"{'ok ' if problem is None else 'BAD'} {name} rows={len(got)} {took} {problem or ''}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())

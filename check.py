"""Compare every registered query with its SQL: ``python check.py [sf] [name ...]``."""

from __future__ import annotations

import glob
import os
import sys
import tempfile
import time

import duckdb
import pandas as pd

from lapspark.plans import ORACLES, QUERIES
from lapspark.session import build_session

ROOT = os.environ.get("TESTDATA", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kind = str(df[c].dtype)
        if kind.startswith("datetime"):
            df[c] = df[c].dt.tz_localize(None).astype("datetime64[us]").astype(str)
        elif kind.startswith(("int", "Int", "uint")):
            df[c] = df[c].map(lambda v: None if pd.isna(v) else f"{int(v)}")
        elif kind.startswith("float"):
            df[c] = df[c].map(lambda v: None if pd.isna(v) else repr(float(v) + 0.0))
        else:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NA else str(v))
    df = df.fillna("~")
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def kinds(df: pd.DataFrame) -> dict[str, str]:
    short = {"i": "int", "u": "int", "f": "float", "M": "time", "b": "bool", "O": "object"}
    return {c: short.get(df[c].dtype.kind, df[c].dtype.kind) for c in df.columns}


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLES:
        return True, f"{len(got)} rows (no SQL)"
    want = con.execute(ORACLES[name]).fetchdf()
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}"
    note = ""
    a, b = kinds(got), kinds(want)
    odd = {c: (a[c], b[c]) for c in a if a[c] != b[c]}
    if odd:
        note = f" [types {odd}]"
        for c, (x, y) in odd.items():
            if {x, y} == {"int", "float"}:
                got[c], want[c] = got[c].astype("float"), want[c].astype("float")
    x, y = normal(got), normal(want)
    if not x.equals(y):
        bad = (x != y).any(axis=1)
        i = bad.idxmax()
        return False, f"{int(bad.sum())} of {len(x)} rows differ, e.g. {x.loc[i].to_dict()} != {y.loc[i].to_dict()}{note}"
    return True, f"{len(got)} rows{note}"


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"{ROOT}/sf{sf}"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="12g", spark__log__level="ERROR",
                          spark__checkpoint__dir=tempfile.mkdtemp(prefix="lapspark-check-"))
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names:
        begin = time.time()
        try:
            ok, text = compare(spark, con, name, sf_dir)
        except Exception as exc:  # report and go on with the next query
            ok, text = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - begin:6.1f}s {text}", flush=True)
    print(f"{len(names) - failed} of {len(names)} fine")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)

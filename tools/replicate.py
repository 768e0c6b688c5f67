"""Write enlarged copies of the test tables: ``python tools/replicate.py source target copies [hot]``.

Keys are shifted per copy, so drivers and sessions multiply; with ``hot`` a third of all events and
line items belong to one driver instead.
"""

from __future__ import annotations

import os
import sys

import duckdb


def main(source: str, target: str, copies: int, hot: bool) -> None:
    os.makedirs(target, exist_ok=True)
    con = duckdb.connect()
    user = "user_id + c * 100000"
    supplier = "l_suppkey + c * 100000"
    if hot:
        user = f"CASE WHEN event_id % 3 = 0 THEN 7 ELSE {user} END"
        supplier = f"CASE WHEN l_orderkey % 3 = 0 THEN 7 ELSE {supplier} END"
    con.execute(
        f"""COPY (SELECT event_id + c * 10000000 AS event_id, ts + to_microseconds(c) AS ts, {user} AS user_id,
                         event_type, value, props FROM '{source}/events.parquet', range({copies}) r(c))
            TO '{target}/events.parquet' (ROW_GROUP_SIZE 200000)"""
    )
    con.execute(
        f"""COPY (SELECT l_orderkey + c * 1000000 AS l_orderkey, l_partkey, {supplier} AS l_suppkey,
                         * EXCLUDE (l_orderkey, l_partkey, l_suppkey)
                  FROM '{source}/lineitem.parquet', range({copies}) r(c))
            TO '{target}/lineitem.parquet' (ROW_GROUP_SIZE 200000)"""
    )


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2], int(sys.argv[3]), "hot" in sys.argv[4:])

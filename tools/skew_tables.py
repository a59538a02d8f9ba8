"""Copy the tables with a third of the rows moved onto one key.

    python tools/skew_tables.py /root/testdata/sf0.01 /tmp/spark-XXXXXX
"""

import os
import sys

import duckdb

# Table: (column that gets one hot value, which rows move).
HOT = {
    "lineitem": ("l_orderkey", "(l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 3 = 0"),
    "orders": ("o_custkey", "o_orderkey % 3 = 0"),
    "documents": ("source", "doc_id % 3 = 0"),
    "events": ("user_id", "event_id % 3 = 0"),
    "conversations": None,
}


def write_skewed(source: str, target: str) -> None:
    con = duckdb.connect()
    os.makedirs(target, exist_ok=True)
    for name in sorted(os.listdir(source)):
        table = name.removesuffix(".parquet")
        text = f"SELECT * FROM '{source}/{name}'"
        if HOT.get(table):
            column, moved = HOT[table]
            hot = con.execute(f"SELECT min({column}) FROM '{source}/{name}'").fetchone()[0]
            value = f"'{hot}'" if isinstance(hot, str) else hot
            text = f"SELECT * REPLACE (CASE WHEN {moved} THEN {value} ELSE {column} END AS {column}) FROM '{source}/{name}'"
        con.execute(f"COPY ({text}) TO '{target}/{name}' (FORMAT parquet)")


if __name__ == "__main__":
    write_skewed(*sys.argv[1:3])

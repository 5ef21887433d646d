"""Run the queries against their SQL: python -m checks.compare [--shuffled] [folder] [name ...]

With --shuffled no join is broadcast for its size, and AQE takes every partition for a large one.
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from checks.oracle import ORACLE
from checks.queries import QUERIES
from rankflow.session import configure

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


SHUFFLED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def difference(spark, con, sf: str, name: str) -> str:
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = Counter(tuple(_value(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLE:
        return f"{sum(got.values())} rows, no SQL"
    cursor = con.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return f"DIFFERENT columns {columns} {sorted(names)}"
    at = [names.index(c) for c in columns]
    want = Counter(tuple(_value(r[i]) for i in at) for r in cursor.fetchall())
    if got != want:
        here, there = got - want, want - got
        return (
            f"DIFFERENT {sum(here.values())} rows only here {list(here)[:2]},"
            f" {sum(there.values())} only in SQL {list(there)[:2]}"
        )
    return f"equal, {sum(got.values())} rows"


def main() -> None:
    arguments = [a for a in sys.argv[1:] if a != "--shuffled"]
    sf = arguments[0] if arguments else "/root/testdata/sf0.01"
    names = arguments[1:] or list(QUERIES)
    builder = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
    builder = builder.config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
    if "--shuffled" in sys.argv:
        for key, value in SHUFFLED.items():
            builder = builder.config(key, value)
    spark = configure(builder.config("spark.ui.showConsoleProgress", "false")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name in names:
        start = time.time()
        try:
            outcome = difference(spark, con, sf, name)
        except Exception as error:  # report and go on with the next query
            outcome = f"FAILED {str(error)[:400]}"
        print(f"{name}: {outcome} ({time.time() - start:.1f}s)", flush=True)


if __name__ == "__main__":
    main()

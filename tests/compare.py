"""Registered queries against their SQL in DuckDB, as rows whose order doesn't matter."""

import math
import sys

import duckdb

from lodestone.sources.tables import TABLES


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if hasattr(value, "quantize"):
        return float(f"{float(value):.9g}")
    if hasattr(value, "isoformat"):
        return value.isoformat()[:19]
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def difference(spark, folder, run, sql):
    """None, or what differs."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    df = run(spark, folder)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, want.fetchall())
    if a == b:
        return None
    return f"{len(a)} and {len(b)} rows; only here {[x for x in a if x not in set(b)][:3]}; only there {[x for x in b if x not in set(a)][:3]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from lodestone import queries

    session = SparkSession.builder.master("local[3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    for name, run in queries.queries().items():
        if len(sys.argv) > 1 and name not in sys.argv[1:]:
            continue
        try:
            sql = queries.oracle_sql().get(name)
            if sql:
                found = difference(session, "/root/testdata/sf0.01", run, sql)
                if found:
                    print("DIFFERS", name, found[:700])
            else:
                print("ROWS", name, [tuple(r) for r in run(session, "/root/testdata/sf0.01").limit(8).collect()])
        except Exception as e:
            print("FAILS", name, type(e).__name__, str(e).split("JVM stacktrace")[0][:500])

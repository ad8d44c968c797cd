"""Tables and what is known of them: columns, keys, row counts, a compact rendering, label columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
#: Spark knows no keys, so they are kept beside the catalog.
PRIMARY_KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"],
    "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"], "documents": ["doc_id"], "labels": ["doc_id"],
    "pages": ["page_id"], "benchmark": ["item_id"], "conversations": ["conv_id", "turn"], "embeddings": ["vec_id"],
}
FOREIGN_KEYS = [
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id"),
]
_SHORT = {"bigint": "int", "int": "int", "double": "num", "string": "txt", "timestamp_ntz": "date", "timestamp": "date", "date": "date"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, names: list[str] = TABLES) -> None:
    """The tables as temporary views, so that SQL reaches them by name and no path need be named in a statement."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)


def schema(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """(table_name, position, column_name, type, is_key) of the named tables."""
    rows = [(n, i, f.name, f.dataType.simpleString(), f.name in PRIMARY_KEYS.get(n, ())) for n in names for i, f in enumerate(table(spark, folder, n).schema)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, type string, is_key boolean")


def foreign_keys(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FOREIGN_KEYS, "source string, source_column string, target string, target_column string")


def row_counts(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """(table_name, n) of the named tables in one job."""
    return reduce(DataFrame.unionAll, (table(spark, folder, n).agg(F.lit(n).alias("table_name"), F.count("*").alias("n")) for n in names))


def rendered(spark: SparkSession, folder: str, names: list[str]) -> str:
    """A compact text of tables, columns (* for keys), empty tables and join edges."""
    counts = {r["table_name"]: r["n"] for r in row_counts(spark, folder, names).collect()}
    lines = []
    for n in names:
        columns = ", ".join(f"{f.name}:{_SHORT.get(f.dataType.simpleString(), f.dataType.simpleString())}{'*' * (f.name in PRIMARY_KEYS.get(n, ()))}" for f in table(spark, folder, n).schema)
        lines.append(f"{n}({columns})" + " [EMPTY TABLE - 0 rows]" * (not counts[n]))
    lines += [f"JOIN {s}.{sc} = {t}.{tc}" for s, sc, t, tc in FOREIGN_KEYS if s in names and t in names]
    return "\n".join(lines)


def column_owners(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """(column_name, owners, advice): which tables have a column, and how to name it."""
    owners = schema(spark, folder, names).groupBy("column_name").agg(F.array_sort(F.collect_set("table_name")).alias("o"))
    advice = F.when(F.size("o") == 1, F.concat(F.lit("column of "), F.col("o")[0], F.lit(" only"))).otherwise(F.concat(F.lit("exists on "), F.array_join("o", ", "), F.lit(" - qualify")))
    return owners.select("column_name", F.array_join("o", ",").alias("owners"), advice.alias("advice"))


def label_profile(spark: SparkSession, folder: str, labels: list[tuple[str, str]], near_unique: float = 0.9) -> DataFrame:
    """(label, n, n_distinct, collides): a label column collides if its values are nearly, but not quite, unique."""
    parts = [table(spark, folder, t).agg(F.lit(f"{t}.{c}").alias("label"), F.count("*").alias("n"), F.count_distinct(c).alias("n_distinct")) for t, c in labels]
    df = reduce(DataFrame.unionAll, parts)
    return df.withColumn("collides", (F.col("n_distinct") < F.col("n")) & (F.col("n_distinct") >= near_unique * F.col("n")))

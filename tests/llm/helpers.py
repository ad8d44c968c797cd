"""Fixtures shared by the tests of this folder."""

import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls in every column, empty, blank and very long texts, repeated rows, ties.
EDGES = [
    (1, None, None, None, None), (None, "one two three four", "en", "a", 1), (2, "", "en", "b", 0), (3, " \t\n ", None, "a", 4),
    (4, "same text here now", "en", None, 18), (4, "same text here now", "en", None, 18), (5, "same text here now", "en", "b", 18),
    (6, "long " + "wordy stuff goes on and on " * 5000, "en", "a", 9), (7, "Ünïcödé 😀 text\nwith lines\n\nwith lines", "de", "c", 3), (-8, "x", "en", "c", 1),
]


def edges(spark, extra=True):
    """EDGES with extra columns whose names are those of operators' results."""
    df = spark.createDataFrame(EDGES, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for name in ("size", "score", "kept", "fp", "g", "root", "shard", "spans", "key", "words", "taken", "component_id", "n_words", "row"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table(spark, name="documents", sf="sf0.001"):
    return spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def crc_mod(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)

"""What the operators of this folder share: the shared folder, tables written to cut lineage, word splitting."""

from __future__ import annotations

import contextlib
import contextvars
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word contract here: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"


@functools.cache
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="lodestone-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, else that of setCheckpointDir().

    Where neither is set, a temporary folder serves a local master; on a cluster that would lose data, so it is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_folder()


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/lodestone/{label}-{uuid.uuid4().hex}"


#: Where tables written by saved() are noted, if anybody is to delete them.
_notes: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("notes", default=None)


def saved(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back, so that a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    if (notes := _notes.get()) is not None:
        notes.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def noting(paths: list[str]) -> Iterator[None]:
    """Adds to paths the tables that saved() writes inside; no other caller's tables are among them."""
    before = _notes.set(paths)
    try:
        yield
    finally:
        _notes.reset(before)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes noted tables and empties the list; to be called when every result that rests on them has been written."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text as an array; none for an empty or null text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))



def ascii_lower(text: str) -> str:
    """A-Z in lower case, everything else as it is."""
    # bytes.lower() changes A-Z alone.
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def split_words(text: str) -> list[str]:
    """Python's counterpart of words(): str.split() would also split at other Unicode spaces and at \\x1c-\\x1f."""
    for blank in "\t\n\x0b\x0c\r":
        if blank in text:
            text = text.replace(blank, " ")
    return [w for w in text.split(" ") if w]


def bucket_of_id(doc_id: Column, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo modulus; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))

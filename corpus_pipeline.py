"""A training corpus from documents: quality rules, near-duplicates, decontamination, mixing, token files.

Every stage takes what its predecessor kept, whole, and all but the last return the columns of documents. A stage's
result is written before the next begins, which then deletes what earlier stages of the same run have left in the
shared folder; the first stage begins a run. Tables of other queries are never touched.

All stages run in the same executors and the same Python workers, which keep what they once needed. So texts travel to workers in
batches of at most BATCH rows: each stage lowers the session's spark.sql.execution.arrow.maxRecordsPerBatch to that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import lsa, mixing, overlap, quality, tokens
from lodestone.llm.common import delete, new_path, noting
from lodestone.llm.queries import vocabulary

#: What the stages of the latest run have written to the shared folder.
_written: list[str] = []
#: Rows that travel to a Python worker at once.
BATCH = 1000


def _small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:  # none or less: unbounded
        spark.conf.set(name, BATCH)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality rules keep; begins a run."""
    global _written
    _written = []
    _small_batches(spark)
    with noting(_written):
        return quality.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (SimHash blocks and MinHash bands, then five-word shingles' exact Jaccard of 0.8 or more): that with the smallest doc_id."""
    delete(spark, _written)
    _small_batches(spark)
    with noting(_written):
        return overlap.one_of_each(docs, least=0.8, shingle=5)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    delete(spark, _written)
    _small_batches(spark)
    with noting(_written):
        return lsa.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    delete(spark, _written)
    _small_batches(spark)
    with noting(_written):
        return mixing.mix(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens, ids_crc32."""
    delete(spark, _written)
    _small_batches(spark)
    return tokens.write_tokens(docs, vocabulary()).documents()


STAGES = [("quality rules", good_quality), ("near-duplicates", distinct), ("decontamination", decontaminated), ("mixing", mixed), ("token files", tokenized)]

#: Hashes, a latent class model, an SVD and a tokenizer can't be put into SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each stage's result written before the next begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""Evaluation as DataFrames: result equality, recall grids, confusion, calibration, rankings, leakage."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.columns import question_words
from lodestone.functions.matching import ROUNDING, matchable
from lodestone.operators.retrieval import similar_questions

#: Outcomes of an evaluation run as (id, gold label, predicted label, confidence, correct, answered).
OUTCOMES = [
    ("e1", "sql", "sql", 0.75, True, True), ("e2", "sql", "sql", 0.60, True, True), ("e3", "hybrid", "sql", 0.55, False, True), ("e4", "hybrid", "hybrid", 0.70, True, True),
    ("e5", "rag", "rag", 0.65, True, True), ("e6", "rag", "hybrid", None, False, False), ("e7", "sql", "sql", 0.75, False, True), ("e8", "hybrid", "hybrid", 0.60, True, True),
]
#: Runs of generator configurations: (configuration, seed, score, calls, disqualified).
RUNS = [("baseline", 0, 0.20, 30, False), ("baseline", 1, 0.10, 30, False), ("few-shot", 0, 0.50, 22, False), ("few-shot", 1, 0.55, 20, False), ("search", 0, 0.60, 130, True), ("search", 1, 0.58, 139, False), ("boot", 0, 0.45, 17, False), ("boot", 1, 0.60, 22, False)]


def outcomes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OUTCOMES, "id string, label string, predicted string, confidence double, correct boolean, answered boolean")


def confusion(df: DataFrame) -> DataFrame:
    return df.groupBy("label", "predicted").agg(F.count("*").alias("n"))


def calibration(df: DataFrame) -> DataFrame:
    """Accuracy, mean confidence and their difference over answered rows."""
    answered = df.filter("answered").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("confidence").alias("confidence"))
    return answered.select("n", F.round("accuracy", 6).alias("accuracy"), F.round("confidence", 6).alias("confidence"), F.round(F.col("confidence") - F.col("accuracy"), 6).alias("gap"))


def ranking(df: DataFrame) -> DataFrame:
    """Configurations without a disqualified run by mean score, then spread, then calls."""
    per = df.groupBy("config").agg(F.avg("score").alias("mean"), (F.max("score") - F.min("score")).alias("spread"), F.avg("calls").alias("calls"), F.max("disqualified").alias("out"))
    return per.filter("NOT out").select("config", F.round("mean", 6).alias("mean"), F.round("spread", 6).alias("spread"), "calls").orderBy(F.desc("mean"), "spread", "calls", "config")


def recall_grid(gold: DataFrame, hits: DataFrame, ks: list[int]) -> DataFrame:
    """gold (qid, chunk_id), hits (qid, chunk_id, rank) -> (k, recall, mean_chunks): found gold over all gold at each k."""
    # Both sides are read once: all counts come from one join of pairs.
    key = ["qid", "chunk_id"]
    pairs = gold.groupBy(*key).agg(F.count("*").alias("n")).join(hits.groupBy(*key).agg(F.collect_list("rank").alias("ranks")), key, "full")
    upto = lambda k: F.coalesce(F.size(F.filter("ranks", lambda r: r <= k)), F.lit(0))
    n = F.coalesce("n", F.lit(0))
    totals = pairs.agg(
        F.sum(n).alias("total"), F.count_distinct(F.when(F.col("n").isNotNull(), F.col("qid"))).alias("questions"),
        F.array(*(F.struct(F.lit(k).alias("k"), F.sum(F.when(F.col("ranks").isNotNull(), upto(k))).alias("chunks"), F.sum(F.when(F.col("ranks").isNotNull(), n * upto(k))).alias("found")) for k in ks)).alias("at"),
    )
    rows = totals.select("total", "questions", F.inline("at")).filter("chunks > 0")
    return rows.select("k", F.round(F.col("found") / F.col("total"), 6).alias("recall"), F.round(F.col("chunks") / F.col("questions"), 6).alias("mean_chunks"))


_NUMBERS = ("double", "float", "int", "bigint", "smallint", "tinyint")
#: Rows that one task may have to pair at once, where several columns of numbers lie close together without a gap.
GROUP = 20_000


def _split(df: DataFrame, numeric: list[bool], side: int) -> DataFrame:
    """(side, t: the cells that must be equal, as texts, x0, x1 ...: the numbers); a number that is missing or none is a text."""
    texts, numbers = [], []
    for name, is_number in zip(df.columns, numeric, strict=True):
        c = F.col(f"`{name}`")
        if is_number:
            d = c.cast("double")
            odd = d.isNull() | F.isnan(d) | (F.abs(d) == float("inf"))
            texts.append(F.when(odd, F.coalesce(d.cast("string"), F.lit("null"))).otherwise(""))
            numbers.append(F.when(odd, 0.0).otherwise(d).alias(f"x{len(numbers)}"))
        else:
            texts.append(F.coalesce(F.concat(F.lit("="), F.trim(F.regexp_replace(c.cast("string"), r"\s+", " "))), F.lit("null")))
    return df.select(F.lit(side).alias("side"), F.array(*texts).cast("array<string>").alias("t"), *numbers)


def _unpaired(key, pdf: pd.DataFrame, columns: list[str], tolerance: float) -> pd.DataFrame:
    if len(pdf) > GROUP:
        raise ValueError(f"more than {GROUP} rows lie within {tolerance} of each other: they can't be paired in one task")
    x, y = (pdf.loc[pdf["side"] == s, columns].to_numpy() for s in (0, 1))
    return pd.DataFrame({"n": [] if matchable(x, y, tolerance) else [len(pdf)]})


def same_rows(a: DataFrame, b: DataFrame, tolerance: float = 0.01) -> bool:
    """Whether two results hold the same rows, duplicates counted, in any order, numbers within tolerance: whether all rows
    can be paired. White space in texts is collapsed.

    Rows whose other cells are equal are sorted by a number and part wherever the next one is more than tolerance away,
    for each column of numbers. One column is paired by rank, as a join; several are matched group by group. A group
    has rows that lie close together in every column; more than GROUP of them are refused.
    """
    if len(a.columns) != len(b.columns):
        return False
    numeric = [all(kind in _NUMBERS or kind.startswith("decimal") for kind in kinds) for kinds in zip((k for _, k in a.dtypes), (k for _, k in b.dtypes), strict=True)]
    rows = _split(a, numeric, 0).unionAll(_split(b, numeric, 1))
    columns = [c for c in rows.columns if c.startswith("x")]
    if len(columns) < 2:
        ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("side", "t").orderBy(*columns or [F.lit(0)])))
        x, y = (ranked.filter(F.col("side") == s).select("t", "rank", F.col(columns[0] if columns else "rank").alias(f"v{s}")) for s in (0, 1))
        off = F.col("v0").isNull() | F.col("v1").isNull() | (F.abs(F.col("v0") - F.col("v1")) > tolerance + ROUNDING)
        return x.join(y, ["t", "rank"], "full").filter(off).isEmpty()
    keys = ["t"]
    for c in columns:  # a new group wherever a gap is wider than the tolerance
        w = Window.partitionBy(*keys).orderBy(c)
        gap = (F.col(c) - F.lag(c).over(w) > tolerance + ROUNDING).cast("int")
        rows = rows.withColumn("gap", F.coalesce(gap, F.lit(0))).withColumn(f"g{c}", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("gap")
        keys = [*keys, f"g{c}"]
    return rows.groupBy(*keys).applyInPandas(lambda key, pdf: _unpaired(key, pdf, columns, tolerance), "n long").isEmpty()


def changed_records(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key) of records that two runs don't give alike in the named fields, those of one run only included."""
    text = lambda df, n: df.select(key, F.to_json(F.struct(*fields)).alias(n))
    return text(a, "a").join(text(b, "b"), key, "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select(key)


def leakage(train: DataFrame, test: DataFrame, least: float = 0.85) -> DataFrame:
    """train (qid, question, added), test (qid, question) -> (train_id, test_id, reason, fatal)."""
    ids = train.join(test.select("qid"), "qid", "left_semi").select(F.col("qid").alias("train_id"), F.col("qid").alias("test_id"), F.lit("same id").alias("reason"), F.lit(True).alias("fatal"))
    near = similar_questions(train, test, least).join(train.select(F.col("qid").alias("a_key"), "added"), "a_key")
    pairs = near.select(F.col("a_key").alias("train_id"), F.col("b_key").alias("test_id"), F.when(F.col("overlap") == 1, "same question").otherwise("similar question").alias("reason"), ((F.col("overlap") == 1) | F.col("added")).alias("fatal"))
    return ids.unionByName(pairs).distinct()


#: Words of texts that one task of closest() compares with each other, of either side, and parts of train at least.
WORDS, PARTS = 2_000_000, 16
#: The most frequent words of a task's texts are compared as bits of so many 64-bit numbers.
MASKS = 2


def _encoded(texts: pd.Series, ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, word) of texts of distinct words; the word is -1 if it has no number."""
    words = [t.split(" ") for t in texts]
    flat = np.fromiter((ids.get(w, -1) for ws in words for w in ws), np.int64)
    return np.repeat(np.arange(len(words)), [len(ws) for ws in words]), flat


def _nearest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows (key, words, n: their number, of_train) -> (a, b, shared, united): for each row of train that shares a word with any, the best
    others of this group, the smallest key for each overlap; what rounding to six digits may make equal to the best is among them."""
    a, b = pdf[pdf["of_train"]].reset_index(drop=True), pdf[~pdf["of_train"]].sort_values("key", ignore_index=True)
    ids = {w: i for i, w in enumerate(dict.fromkeys(w for t in b["words"] for w in t.split(" ")))}
    row, word = _encoded(b["words"], ids)
    frequent = np.argsort(-np.bincount(word, minlength=len(ids)), kind="stable")[: 64 * MASKS]
    bit = np.full(len(ids) + 1, -1)  # the last is for words without a number
    bit[frequent] = np.arange(len(frequent))

    def masks(n: int, row: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = np.zeros((MASKS, n), np.uint64)
        some = bit[word] >= 0
        np.bitwise_or.at(out, (bit[word[some]] // 64, row[some]), np.uint64(1) << (bit[word[some]] % 64).astype(np.uint64))
        return out

    mine, (a_row, a_word) = masks(len(b), row, word), _encoded(a["words"], ids)
    theirs = masks(len(a), a_row, a_word)
    order = np.argsort(word, kind="stable")
    postings, ends = row[order], np.cumsum(np.bincount(word, minlength=len(ids)))
    rare = (a_word >= 0) & (bit[a_word] < 0)
    a_row, a_word = a_row[rare], a_word[rare]
    cuts, sizes, found = np.searchsorted(a_row, np.arange(len(a) + 1)), b["n"].to_numpy("i8"), [np.empty((4, 0), np.int64)]
    for i, n in enumerate(a["n"]):
        shared = np.bitwise_count(mine & theirs[:, i, None]).sum(0, dtype=np.int64)
        for w in a_word[cuts[i] : cuts[i + 1]]:  # a text has a word once, so that no place comes twice
            shared[postings[ends[w - 1] if w else 0 : ends[w]]] += 1
        overlap = shared / (sizes + n - shared)
        most = overlap.max(initial=0)
        if most > 0:
            near = np.flatnonzero(overlap >= most - 1.1e-6)
            near = near[np.unique(overlap[near], return_index=True)[1]]  # in order of keys
            found.append(np.stack([np.full(len(near), i), near, shared[near], sizes[near] + n - shared[near]]))
    i, j, shared, united = np.concatenate(found, axis=1)
    return pd.DataFrame({"a": a["key"].to_numpy()[i], "b": b["key"].to_numpy()[j], "shared": shared, "united": united})


def closest(train: DataFrame, test: DataFrame, key: str = "qid", text: str = "question") -> DataFrame:
    """(train_id, test_id, overlap): each training question's nearest test question by overlap of words, ties by the
    smallest id; with overlap 0 where no word is shared, and no row at all where test is empty. Texts with the same words are compared once.

    An exact search without a threshold. The best overlap of unlike texts rests on words that very many have, so that nearly all
    pairs must be looked at: work grows with texts of train times texts of test. Both sides are dealt into parts of at most about WORDS
    words; every part meets every other in a task of its own, which returns each question's best of that part. No pair is
    shuffled or written, and a task's memory doesn't grow with the input.
    """
    named = train.select(F.col(key).alias("train_id"), F.array_join(question_words(F.col(text)), " ").alias("words"))
    a = named.groupBy("words").agg(F.min("train_id").alias("key"))
    b = test.select(F.col(key).alias("key"), F.array_join(question_words(F.col(text)), " ").alias("words")).groupBy("words").agg(F.min("key").alias("key"))
    count = F.size(F.split("words", " ")).cast("long").alias("n")
    a, b = (x.filter("words <> ''").select("key", "words", count) for x in (a, b))
    parts = lambda x: -(-(x.agg(F.sum("n")).first()[0] or 0) // WORDS) or 1
    of_a, of_b = max(PARTS, parts(a)), parts(b)
    own, every = lambda n: F.pmod(F.xxhash64("words"), F.lit(n)), lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = a.select("*", F.lit(True).alias("of_train"), own(of_a).cast("int").alias("i"), every(of_b).alias("j")).unionByName(b.select("*", F.lit(False).alias("of_train"), every(of_a).alias("i"), own(of_b).cast("int").alias("j")))
    kind = dealt.schema["key"].dataType.simpleString()
    # A fixed number of partitions isn't merged into few: the work lies in the pairs, not in the bytes.
    met = dealt.repartition(4 * of_a * of_b, "i", "j").groupBy("i", "j").applyInPandas(_nearest, f"a {kind}, b {kind}, shared long, united long")
    pairs = met.select("a", "b", F.round(F.col("shared") / F.col("united"), 6).alias("overlap"))
    best = pairs.groupBy("a").agg(F.max("overlap").alias("overlap"), F.min_by("b", F.struct(-F.col("overlap"), F.col("b"))).alias("test_id"))
    first = test.agg(F.min(key).alias("first")).filter("first IS NOT NULL")  # one row
    rows = named.join(a.select("words", F.col("key").alias("a")), "words", "left").join(best, "a", "left").crossJoin(F.broadcast(first))
    return rows.select("train_id", F.coalesce("test_id", "first").alias("test_id"), F.coalesce("overlap", F.lit(0.0)).alias("overlap"))

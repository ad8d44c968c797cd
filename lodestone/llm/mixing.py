"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets a key -ln(u) / w, u uniform from a hash of its id, text and a seed, w its quality weight: taking
documents by ascending key is weighted sampling without replacement. A source whose target is e times its size and
more is taken e times whole (complete epochs); for the rest, its documents are sorted by key and their sizes summed
up to the budget. The document at the budget's edge goes in if more than half of it fits.

Scale: sorting and summing run over (source, key, size) rows dealt out by ranges of (source, key, row), with the sums of
earlier ranges added, so that a hot source, or a row repeated very often, spreads over as many tasks as it needs. What is left of it is one cut
per source, with which each document's copies are decided where it is read: texts are never shuffled.
Targets are made on the driver from one row per source, at most `max_sources` of them (beyond that it is refused).

Edge cases: null or empty texts have size 0 and are taken in complete epochs only; a null source is a source, last in
order; null ids hash like an empty id; repeated rows share a key and are told apart by their place in the input, so that
the cut may lie between them (mix() finds the place again when it reads docs a second time: where Spark then splits the
files otherwise, the number of such equal rows taken may differ by some, nothing else); an empty table gives an empty
result; other columns are carried where the caller asks for them, never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import saved, words

_OWN = "_lodestone_m_"
WEIGHTS = (3, 1, 2)


def quality_weight(text: Column) -> Column:
    """A document's weight in (0, 1]: symbols and shouting lower it."""
    text = F.coalesce(text, F.lit(""))
    odd = F.regexp_count(text, F.lit("[#*$%&|<>!]")) / F.greatest(F.length(text), F.lit(1))
    return 1 / (1 + 20 * odd)


def targets(sizes: dict, weights: dict, share: float = 1.5, most: float = 2.0) -> dict:
    """Words to take from each source: share of all words dealt by weight, none above most times its size.

    What lies above goes to the others by weight, until none is above.
    """
    left, open_, out = share * sum(sizes.values()), dict(weights), {}
    while open_:
        each = left / sum(open_.values())
        full = [s for s, w in open_.items() if each * w > most * sizes[s]]
        if not full:
            return out | {s: each * w for s, w in open_.items()}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
            del open_[s]
    return out


def in_order(sources: list) -> list:
    """By code point, null last."""
    return sorted((s for s in sources if s is not None)) + [None] * (None in sources)


def _keyed(docs: DataFrame, seed: int, doc_id: str, text: str, source: str) -> DataFrame:
    """docs with size, source, key, tie and row under private names; row tells equal rows apart."""
    p, words_of = _OWN, F.col(f"`{text}`").cast("string")
    uniform = (F.pmod(F.xxhash64(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), F.coalesce(words_of, F.lit("")), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return docs.withColumns({
        p + "size": F.size(words(words_of)).cast("long"),
        p + "source": F.col(f"`{source}`").cast("string"),
        p + "key": -F.log(uniform) / quality_weight(words_of),
        p + "tie": F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(-(1 << 63)).cast("long")),
        p + "row": F.monotonically_increasing_id(),
    })


_NARROW = ("source", "size", "key", "tie", "row")


def _plan(narrow: DataFrame, cycle, share: float, most: float, max_sources: int) -> DataFrame:
    """narrow (source, size, key, tie, row, under private names) -> one row per source: its size, target, complete epochs and cut."""
    spark, p = narrow.sparkSession, _OWN
    narrow = narrow.select(*(F.col(p + c).alias(c) for c in _NARROW))
    per_source = narrow.groupBy("source").agg(F.sum("size").alias("n")).limit(max_sources + 1).collect()
    if len(per_source) > max_sources:
        raise ValueError(f"over {max_sources} sources")
    sizes = {r["source"]: r["n"] for r in per_source}
    order = in_order(list(sizes))
    wanted = targets(sizes, {s: cycle[i % len(cycle)] for i, s in enumerate(order)}, share, most) if order else {}
    rows = []
    for s in order:
        epochs = int(wanted[s] // sizes[s]) if sizes[s] else 0
        rows.append((s, sizes[s], float(wanted[s]), epochs, float(wanted[s] - epochs * sizes[s])))
    plan = spark.createDataFrame(rows, "source string, source_size long, target double, epochs long, rest double")
    cut = saved(_cuts(narrow, plan), "cuts")
    joined = plan.alias("a").join(cut.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left")
    return joined.select(*(F.col("a." + c).alias(p + "s_" + c) for c in plan.columns), F.col("b.cut").alias(p + "cut"))


def _cuts(narrow: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, cut): the largest (key, tie, row) that the source's partial epoch takes."""
    n = int(narrow.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = saved(narrow.repartitionByRange(n, "source", "key", "tie", "row").withColumn("part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("source", "part").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col("source").alias("b_source"), F.col("part").alias("b_part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part", "source").orderBy("key", "tie", "row").rowsBetween(Window.unboundedPreceding, 0)
    run = ranged.withColumn("run", F.sum("size").over(inside))
    # A row per range and source in it: at most ranges + sources.
    run = run.join(F.broadcast(before), F.col("source").eqNullSafe(F.col("b_source")) & (F.col("part") == F.col("b_part")))
    run = run.join(F.broadcast(plan.select(F.col("source").alias("p_source"), "rest")), F.col("source").eqNullSafe(F.col("p_source")))
    taken = run.filter(F.col("before") + F.col("run") - F.col("size") / 2 < F.col("rest"))
    return taken.groupBy("source").agg(F.max(F.struct("key", "tie", "row")).alias("cut"))


def _with_copies(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    """keyed with its source's plan and copies, under private names."""
    p = _OWN
    # One row per source, at most max_sources of them.
    out = keyed.join(F.broadcast(plan), F.col(p + "source").eqNullSafe(F.col(p + "s_source")), "left")
    within = F.struct(*(F.col(p + c).alias(c) for c in ("key", "tie", "row"))) <= F.col(p + "cut")
    return out.withColumn(p + "copies", F.col(p + "s_epochs") + F.coalesce(within.cast("long"), F.lit(0)))


def mixed(docs: DataFrame, cycle=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source", max_sources: int = 100_000) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target (its source's), taken (size times copies). Texts are read once."""
    p = _OWN
    narrow = saved(_keyed(docs, seed, doc_id, text, source).select(F.col(f"`{doc_id}`").alias("doc_id"), *(p + c for c in _NARROW)), "sizes")
    df = _with_copies(narrow, _plan(narrow, cycle, share, most, max_sources))
    return df.select("doc_id", F.col(p + "size").alias("size"), F.col(p + "s_source_size").alias("source_size"), F.col(p + "s_target").alias("target"), (F.col(p + "size") * F.col(p + "copies")).alias("taken"))


def mix(docs: DataFrame, cycle=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source", max_sources: int = 100_000) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken."""
    keyed = _keyed(docs, seed, doc_id, text, source)
    narrow = saved(keyed.select(*(_OWN + c for c in _NARROW)), "sizes")
    copies = F.col(_OWN + "copies")
    df = _with_copies(keyed, _plan(narrow, cycle, share, most, max_sources)).filter(copies > 0)
    return df.withColumn(_OWN + "k", F.explode(F.sequence(F.lit(1), copies))).select(*(f"`{c}`" for c in docs.columns))

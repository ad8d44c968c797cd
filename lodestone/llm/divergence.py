"""Source divergence audit: how far the sources of a language are apart in their words, and by which words.

Every (language, source) group has a vector over its language's kept terms: p = 1 + floor(10^9 (count + 2) / (N + 2 V)).
Groups are compared by f = floor((p - q)^2 / (p + q)), summed over the kept terms: each with each other group of its language, in a
systolic rotation, and each with the whole language, term by term. All arithmetic is in whole numbers.

A language's kept terms are dealt into shards of some SHARD_TERMS; a group's piece of a shard holds the numbers of its
terms and their counts, as differences, compressed. Pieces stay where they are, in cached partitions by (language,
shard, seat). The groups of a language are seated at a round-robin tournament: in each round every group meets one
other, and over all rounds every other one once. In a meeting one of the two stays and the other's piece travels to
it; who travels alternates, so that every group is host to half of its meetings. A meeting gives the value for both
directions, since f is symmetric. Terms that neither group has add the same number each, so that only their number is needed. The
terms that mark a group are ranked by a heap in the task that packs a piece; heaps of one group meet at the end.

Scale: words are counted in tasks before they are shuffled (FLUSH entries at a time), then once by (language, term),
where rare terms leave. Pieces have about SHARD_TERMS entries, whatever the size of a group, language or vocabulary.
Rounds travel in laps of at most LAP_BYTES and LAP_ROUNDS, each lap one job whose results are written, so that disk and
memory don't grow with the number of rounds. The work is the number of pairs of groups times the vocabulary, as the
result asks for. Counts are exact up to 9 * 10^15 words a language.

Edge cases: null texts, languages and sources are empty ones; a group without terms has counts of 0; a language
without kept terms has pairs of value 0 and no terms; a lone source has no pairs; ties go by the item's UTF-8 bytes; repeated
rows are documents like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_lower, new_path, saved

_TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: Entries of a task's count before they are sent on, terms of a shard, and what travels at once.
FLUSH, SHARD_TERMS, LAP_BYTES, LAP_ROUNDS = 400_000, 4096, 4 << 30, 512
#: A term is kept if so many documents of its language have it; so many terms of a group are returned.
DOCUMENTS, TOP = 10, 10
UNIT = 1_000_000_000


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of every (lang, source, term), added up over FLUSH entries or a little more."""
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    entries = 0

    def counted() -> pa.RecordBatch:
        columns: dict[str, list] = {c: [] for c in ("lang", "source", "term", "n", "docs")}
        for (lang, source), (n, docs) in seen.items():
            columns["lang"] += [lang] * len(n)
            columns["source"] += [source] * len(n)
            columns["term"] += n
            columns["n"] += n.values()
            columns["docs"] += map(docs.__getitem__, n)
        return pa.record_batch([pa.array(v, pa.string() if c in ("lang", "source", "term") else pa.int64()) for c, v in columns.items()], list(columns))

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            n, docs = seen.setdefault((lang, source), (Counter(), Counter()))
            before, terms = len(n), _TERM.findall(ascii_lower(text))
            n.update(terms)
            docs.update(set(terms))
            entries += len(n) - before
            if entries > FLUSH:
                yield counted()
                seen, entries = {}, 0
    yield counted()


def probability(count: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)) in 64 bits, by long division in steps of 1000."""
    whole = total + 2 * kept
    rest, found = np.asarray(count, np.int64) + 2, np.zeros(np.shape(count), np.int64)
    for _ in range(3):
        found, rest = found * 1000 + rest * 1000 // whole, rest * 1000 % whole
    return found + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def packed(at: np.ndarray, count: np.ndarray) -> bytes:
    """Numbers in rising order, as differences, and counts."""
    return zlib.compress(np.diff(at, prepend=0).astype("<u4").tobytes() + np.asarray(count).astype("<i8").tobytes(), 1)


def unpacked(piece: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(piece) if piece else b""
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, "<u4", n), dtype=np.int64), np.frombuffer(raw, "<i8", n, 4 * n)


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """One group's piece of a shard, and its heap of terms that are likelier here than in the language."""
    pdf = pdf.sort_values("at")
    one = pdf.iloc[0]
    p = probability(pdf["n"].to_numpy(), int(one["words"]), int(one["kept"]))
    q = probability(pdf["total"].to_numpy(), int(one["lang_words"]), int(one["kept"]))
    marks = heapq.nsmallest(TOP, ((-v, t) for v, t, more in zip(distance(p, q).tolist(), pdf["term"], p > q, strict=True) if more))
    row = (one["lang"], int(one["shard"]), int(one["seat"]), packed(pdf["at"].to_numpy(), pdf["n"].to_numpy()), [{"item": t, "value": -v} for v, t in marks])
    return pd.DataFrame([row], columns=["lang", "shard", "seat", "piece", "marks"])


def partner(seat: Column, turn: Column, seats: Column) -> Column:
    """Who meets a seat in a round of a tournament of so many seats; null for none. Seats and rounds count from 0.

    With an even number of places m, the two seats of a meeting add up to the round's number modulo m - 1; the one seat
    that would meet itself meets the last. An odd number of seats leaves the last place empty.
    """
    last = seats + seats % 2 - 1
    other = F.pmod(turn - seat, last)
    met = F.when(seat == last, F.pmod(turn * ((last + 1) / 2).cast("long"), last)).when(other == seat, last).otherwise(other)
    return F.when((turn < last) & (met < seats), met)


class _Vector:
    """A group's values over a shard's terms, from its piece."""

    def __init__(self, piece: bytes | None, words: int, kept: int):
        self.at, count = unpacked(piece)
        self.p = probability(count, words, kept) if kept else count
        self.none = int(probability(np.zeros(1, np.int64), words, kept)[0]) if kept else 1
        self.end = int(self.at[-1]) + 1 if len(self.at) else 0

    def spread(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        values, has = np.full(length, self.none, np.int64), np.zeros(length, bool)
        values[self.at], has[self.at] = self.p, True
        return values, has


def _meet(hosts: pd.DataFrame, guests: pd.DataFrame) -> pd.DataFrame:
    rows = []
    if len(hosts):
        host = hosts.iloc[0]
        kept = int(host["kept"])
        own = _Vector(host["piece"], int(host["words"]), kept)
        for seat, piece, words in zip(guests["guest"], guests["piece"], guests["words"], strict=True):
            other = _Vector(piece, int(words), kept)
            length = max(own.end, other.end)
            (p, a), (q, b) = own.spread(length), other.spread(length)
            either = a | b
            rows.append((host["lang"], int(host["seat"]), int(seat), int(distance(p[either], q[either]).sum()), int(either.sum())))
    return pd.DataFrame(rows, columns=["lang", "host", "guest", "value", "terms"])


_MEETING = "lang string, host long, guest long, value long, terms long"


def _rotate(residents: DataFrame, seats: int) -> DataFrame:
    """residents (lang, shard, seat, seats, words, kept, piece) -> the meetings' sums (_MEETING) over terms that host or guest has, a row a shard."""
    spark = residents.sparkSession
    rounds = seats + seats % 2 - 1
    if rounds < 1:
        return spark.createDataFrame([], _MEETING)
    size = residents.agg(F.coalesce(F.sum(F.length("piece")), F.lit(0))).first()[0]
    lap = max(1, min(LAP_ROUNDS, rounds, LAP_BYTES // max(size, 1)))
    # With fewer partitions than the session's, Spark would deal the hosts anew in every lap.
    tasks = max(math.ceil(size / (32 << 20)), int(spark.conf.get("spark.sql.shuffle.partitions")))
    home = residents.repartition(tasks, "lang", "shard", "seat").persist(StorageLevel.MEMORY_AND_DISK)
    path = new_path(spark, "meetings")
    try:
        home.count()  # adaptive plans tell the partitioning of what is cached only then
        for first in range(0, rounds, lap):
            turns = F.sequence(F.lit(first).cast("long"), F.lit(min(first + lap, rounds) - 1).cast("long"))
            seat = F.col("seat")
            met = F.transform(turns, lambda turn: partner(seat, turn, F.col("seats")))
            # Of two seats the higher travels if their sum is odd, else the lower.
            hosts = F.filter(met, lambda host: host.isNotNull() & ((seat > host) == ((seat + host) % 2 == 1)))
            guests = residents.select("lang", "shard", seat.alias("guest"), "words", "piece", F.explode(hosts).alias("host"))
            home.groupBy("lang", "shard", "seat").cogroup(guests.groupBy("lang", "shard", "host")).applyInPandas(_meet, _MEETING).write.mode("append").parquet(path)
    finally:
        home.unpersist()
    return spark.read.schema(_MEETING).parquet(path)


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` has every other source of the language, part `term` the terms that mark the source."""
    none = F.lit("")
    own = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), none).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))))
    # Dealt by (lang, term) once: the sums by group, and the windows over all groups of a term.
    counted = own.mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    counted = counted.select("lang", "source", "term", "n", F.sum("n").over(term).alias("total"), F.sum("docs").over(term).alias("docs"), (F.col("source") == F.min("source").over(term)).cast("long").alias("first"))
    kept = saved(counted.filter(F.col("docs") >= DOCUMENTS).drop("docs"), "terms")

    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("words"), F.sum("first").alias("kept"))
    langs = sums.groupBy("lang").agg(F.sum("words").alias("lang_words"), F.sum("kept").alias("kept"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    seat = Window.partitionBy("lang")
    groups = own.select("lang", "source").distinct().join(sums.drop("kept"), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", zero("words"), zero("lang_words"), zero("kept"))
    groups = groups.select("*", (F.row_number().over(seat.orderBy("source")) - 1).cast("long").alias("seat"), F.count("*").over(seat).alias("seats"))
    groups = saved(groups.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("kept") / SHARD_TERMS)).cast("long")), "groups")

    dealt = kept.join(groups, ["lang", "source"]).withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")))
    dealt = dealt.withColumn("at", F.dense_rank().over(Window.partitionBy("lang", "shard").orderBy("term")) - 1)
    dealt = dealt.select("lang", "shard", "seat", "at", "term", "n", "total", "words", "lang_words", "kept")
    pieces = saved(dealt.groupBy("lang", "shard", "seat").applyInPandas(_pack, "lang string, shard long, seat long, piece binary, marks array<struct<item string, value long>>"), "pieces")

    everywhere = groups.select("lang", "seat", "seats", "words", "kept", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
    residents = saved(everywhere.join(pieces.drop("marks"), ["lang", "shard", "seat"], "left"), "residents")
    met = _rotate(residents, groups.agg(F.max("seats")).first()[0] or 0).groupBy("lang", "host", "guest").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))

    # A term that neither group has.
    absent = lambda words: F.expr(f"1 + {2 * UNIT}L div greatest({words} + 2 * kept, 1L)")
    a = groups.select("lang", F.col("seat").alias("host"), F.col("source").alias("a"), F.col("words").alias("a_words"), "kept")
    b = groups.select("lang", F.col("seat").alias("guest"), F.col("source").alias("b"), F.col("words").alias("b_words"))
    pairs = met.join(a, ["lang", "host"]).join(b, ["lang", "guest"]).withColumns({"p": absent("a_words"), "q": absent("b_words")})
    value = F.col("value") + (F.col("kept") - F.col("terms")) * F.expr("(p - q) * (p - q) div (p + q)")
    both = F.explode(F.array(*(F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in ("ab", "ba")))).alias("x")
    pairs = pairs.select("lang", value.alias("value"), both).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    marks = pieces.select("lang", "seat", F.explode("marks").alias("x")).join(groups.select("lang", "seat", "source"), ["lang", "seat"])
    marks = marks.select("lang", "source", F.lit("term").alias("part"), "x.item", "x.value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = pairs.unionByName(marks).withColumn("rank", F.row_number().over(order).cast("int"))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= TOP))


#: The same from the definition, by all pairs of groups and kept terms, for DuckDB.
SQL = """
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
tok AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM tok GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
grp AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT lang, source, term, count(*) AS c FROM tok GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c
  FROM grp g JOIN kept k USING (lang) LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
p AS (
  SELECT lang, source, term, c, (1 + (1000000000::HUGEINT * (c + 2)) // (sum(c) OVER (PARTITION BY lang, source) + 2 * v))::BIGINT AS p
  FROM dense JOIN v USING (lang)),
whole AS (SELECT lang, term, sum(c) AS c FROM dense GROUP BY lang, term),
q AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (c + 2)) // (sum(c) OVER (PARTITION BY lang) + 2 * v))::BIGINT AS q FROM whole JOIN v USING (lang)),
summed AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value
  FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 10
"""

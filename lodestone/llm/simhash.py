"""SimHash near-duplicates: pigeonhole blocks, joined on blocks, then verified by Hamming distance.

A fingerprint is cut into n blocks. Two fingerprints that differ in at most d bits agree in at least n - d blocks, so
they share a key for some choice of n - d blocks. Keys are met by one shuffle of 8-byte fingerprints; inside a key's
group, members are linked by a search that compares each member with those not reached yet, which gives a spanning
forest of the group's links, not all its pairs. Components over fingerprints follow in Spark.

Scale: only distinct fingerprints are keyed, so exact copies cost nothing more; n grows with the number of
fingerprints to keep chance groups small (the result doesn't depend on n); a key shared by more than `chunk`
fingerprints is split into pairs of chunks, each a group of its own, so that no task holds a group of unbounded size
and no link is lost.

Edge cases: a null or empty text has fingerprint zero, linked like any other; fewer words than a shingle make one
shingle; repeated rows and ties share a fingerprint and a component; null ids are members but never name a component
(its component_id is null if no member has an id); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_lower, saved, split_words
from lodestone.llm.components import connected_components

SEED = 42


def fingerprint(text: str, shingle: int = 4) -> int:
    """64 bits, as a signed integer: bit i is 1 if it is set in over half of the shingles' hashes."""
    import xxhash

    words = split_words(ascii_lower(text))
    if not words:
        return 0
    b = " ".join(words).encode()
    gaps = np.flatnonzero(np.frombuffer(b, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(b)][shingle - 1 :] or [len(b)]
    hashes = np.array([xxhash.xxh64_intdigest(b[s:e], SEED) for s, e in zip(starts, ends, strict=False)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(text: Column, shingle: int = 4) -> Column:
    """fingerprint() of a text column."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return of(F.coalesce(text.cast("string"), F.lit("")))


def block_masks(n: int, distance: int) -> list[int]:
    """For every choice of n - distance of n blocks, the mask of their bits, as signed integers."""
    cuts = [round(64 * i / n) for i in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(x) for x in combinations(blocks, n - distance))]


def _blocks_for(rows: int, distance: int) -> int:
    """As few blocks as give keys long enough to keep chance groups small: log2(rows) + 8 bits, or + 1 beyond a distance
    of 4, where longer keys would be too many."""
    n, spare = distance + 2, 8 if distance <= 4 else 1
    while 64 * (n - distance) / n < math.log2(max(rows, 2)) + spare and n < 16:
        n += 1
    return n


def _forest(members: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, int]]:
    """(reached, seed) pairs that span the links among sorted members."""
    rest = members
    while len(rest) > 1:
        seed, rest = rest[0], rest[1:]
        front = [seed]
        while front and len(rest):
            near = np.bitwise_count(rest ^ front.pop()) <= distance
            if near.any():
                reached, rest = rest[near], rest[~near]
                front.extend(reached)
                yield reached, seed


def _link_groups(batches: Iterator[pd.DataFrame], distance: int) -> Iterator[pd.DataFrame]:
    """Rows (g, fp), sorted and with the rows of a g together, to links (a, b)."""

    def links(g: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, int)
        sizes = np.diff(np.r_[starts, len(g)])
        two = starts[sizes == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
        a, b = [fp[two]], [fp[two + 1]]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            for reached, seed in _forest(fp[s : s + n], distance):
                a.append(np.full(len(reached), seed))
                b.append(reached)
        return pd.DataFrame({"a": np.concatenate(a).view("i8"), "b": np.concatenate(b).view("i8")}).drop_duplicates()

    g, fp = [], []
    for pdf in batches:
        new_g, new_fp = pdf["g"].to_numpy("i8"), pdf["fp"].to_numpy("i8").view("u8")
        last = int(np.searchsorted(new_g, new_g[-1])) if len(new_g) else 0
        if not last and g and g[0][0] == new_g[0]:  # the same group goes on
            g.append(new_g)
            fp.append(new_fp)
            continue
        yield links(np.concatenate([*g, new_g[:last]]), np.concatenate([*fp, new_fp[:last]]))
        g, fp = [new_g[last:]], [new_fp[last:]]
    if g:
        yield links(np.concatenate(g), np.concatenate(fp))


def linked_components(prints: DataFrame, distance: int = 4, chunk: int = 4096) -> DataFrame:
    """prints (fp long) -> (node, root) over fingerprints that link to some other, roots left out."""
    distinct = saved(prints.select("fp").distinct(), "fingerprints")
    masks = block_masks(_blocks_for(distinct.count(), distance), distance)
    keyed = distinct.select("fp", F.explode(F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(masks)))).alias("g"))
    hot = saved(keyed.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > chunk), "hot")
    parts = F.coalesce(F.ceil(F.col("n") / chunk), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64(F.col("fp"), F.lit(1)), F.col("parts")).cast("int")
    groups = (
        keyed.join(hot, "g", "left").withColumn("parts", parts).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(F.when(F.col("parts") == 1, F.col("g")).otherwise(F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other"))).alias("g"), "fp")
    )
    links = groups.repartition("g").sortWithinPartitions("g", "fp").mapInPandas(partial(_link_groups, distance=distance), "a long, b long")
    return connected_components(links)


def _members(table: DataFrame, distance: int) -> DataFrame:
    """table (doc_id, fp, ...) with root, the fingerprint that stands for a row's component."""
    roots = saved(linked_components(table, distance), "roots")
    return table.join(roots, table["fp"] == roots["node"], "left").drop("node").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id in reach)."""
    table = saved(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), fingerprints(F.col(f"`{text}`"), shingle).alias("fp")), "prints")
    members = saved(_members(table, distance), "members")
    names = saved(members.groupBy("root").agg(F.min("doc_id").alias("component_id")), "names")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return members.join(names, "root").select("doc_id", digits.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = 4, distance: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of docs, one row of each component: that with the smallest id (rows without id last).

    A row is known by two hashes of its columns (maps left out), so that only these travel with fingerprints; docs
    themselves are shuffled once, to meet the rows to keep.
    """
    hashed = [f"`{f.name}`" for f in docs.schema if "map<" not in f.dataType.simpleString()]
    own = ["_lodestone_s_a", "_lodestone_s_b"]
    keyed = docs.withColumns({own[0]: F.xxhash64(*hashed), own[1]: F.xxhash64(F.lit(1), *hashed)})
    narrow = saved(keyed.select(F.col(own[0]).alias("a"), F.col(own[1]).alias("b"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), fingerprints(F.col(f"`{text}`"), shingle).alias("fp")), "prints")
    best = _members(narrow, distance).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "a", "b")).alias("m"))
    kept = saved(best.select(F.col("m.a").alias(own[0]), F.col("m.b").alias(own[1])), "kept")
    # A merge join at every size: the rows to keep grow with the input.
    return keyed.join(kept.hint("merge"), own, "left_semi").dropDuplicates(own).select(*(f"`{x}`" for x in docs.columns))

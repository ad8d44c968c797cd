"""Near-duplicates: SimHash and MinHash bands find candidates, the exact Jaccard similarity of word shingles decides.

SimHash is that of `simhash.py`: fingerprints cut into blocks, joined on choices of blocks, pairs within four bits, components
of these. The members of such a component meet under a key of their own, as those of a band do. Fingerprints of texts that are alike by 0.8 often
differ in more bits (about half of the pairs of 0.8 and more were within six), so MinHash bands find the others.

A text is the set of its five-word shingles, as 32-bit hashes (chance meetings of two hashes shift a similarity by less
than 1e-4 in texts of up to 400,000 words). BANDS keys of ROWS minima each meet two texts of similarity s with
probability 1 - (1 - s ** ROWS) ** BANDS: 0.997 at s = 0.8, 0.99998 at 0.85. Components of the graph of shared keys are
found on 8-byte names of sets; every similar pair that shares a key lies within one of them. Inside a component, sets
meet once and are compared exactly by a search that compares each member with those not reached yet.

Scale: equal sets count once, so exact copies cost nothing more. Keys, links and names are narrow; sets are shuffled
once, and only those of texts that share a key. In a component of more than `chunk` sets or CHUNK_BYTES, members needn't all
meet: only sets that share a key do. There, each set is first compared with the first set of each of its keys; those
that are similar to it are linked through it. The others, few in a group of near copies, meet all sets of the key, in pairs of chunks
of bounded number and bytes. Keys with the same members are one. So no task holds a group of unbounded size, work doesn't
grow with the square of a chained component or of a group of near copies, and no link is lost.

Edge cases: null and empty texts have an empty set, equal to each other and similar to nothing else; fewer words than a
shingle make one shingle; repeated rows and ties share a set; rows without id come last; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_lower, saved, split_words
from lodestone.llm.components import connected_components
from lodestone.llm.simhash import fingerprints, linked_components

SEED, BANDS, ROWS = 42, 32, 8
#: Bytes of sets in a chunk, and numbers that are compared with a set at once.
CHUNK_BYTES, NUMBERS = 16 << 20, 1 << 21
_RNG = np.random.default_rng(7)
_MULTIPLY = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_ADD = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingle_hashes(text: str, shingle: int = 5) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, sorted."""
    import xxhash

    words = split_words(ascii_lower(text))
    if not words:
        return np.empty(0, np.uint64)
    b = " ".join(words).encode()
    gaps = np.flatnonzero(np.frombuffer(b, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(b)][shingle - 1 :] or [len(b)]
    return np.unique(np.array([xxhash.xxh64_intdigest(b[s:e], SEED) for s, e in zip(starts, ends, strict=False)], np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys, each a hash of its number and of ROWS minima; none for an empty set."""
    import xxhash

    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 256):
        part = hashes[at : at + 256]
        least = np.minimum(least, (part * _MULTIPLY[:, None] + _ADD[:, None]).min(1))
    least = least.astype("<u8").reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least)], np.uint64).view(np.int64)


def sketches(text: Column, shingle: int) -> Column:
    """(fp: name of the set, keys, hashes: the set as sorted 32-bit numbers) of a text column."""

    @F.pandas_udf("fp long, keys array<long>, hashes binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        import xxhash

        rows = []
        for t in texts:
            h = shingle_hashes(t, shingle)
            name = np.uint64(xxhash.xxh64_intdigest(h.astype("<u8").tobytes(), SEED)).view(np.int64)
            rows.append((int(name), band_keys(h), np.unique((h >> np.uint64(32)).astype("<u4")).tobytes()))
        return pd.DataFrame(rows, columns=["fp", "keys", "hashes"])

    return of(F.coalesce(text.cast("string"), F.lit("")))


def _reached(own: np.ndarray, others: list[np.ndarray], least: float) -> np.ndarray:
    """Which of the others, none of them empty unless own is, have a Jaccard similarity of least or more with own."""
    found = np.zeros(len(others), bool)
    sizes = np.array([len(s) for s in others])
    near = np.flatnonzero((sizes >= least * len(own)) & (least * sizes <= len(own)))
    for part in np.split(near, np.flatnonzero(np.diff(np.cumsum(sizes[near]) // NUMBERS)) + 1) if len(near) else []:
        flat = np.concatenate([others[i] for i in part])
        if not len(flat):
            found[part] = not len(own)
            continue
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        common = np.add.reduceat((own[at] == flat).astype(np.int64), np.r_[0, np.cumsum(sizes[part])[:-1]])
        found[part] = common >= least * (len(own) + sizes[part] - common) - 1e-9
    return found


def _forest(sets: list[np.ndarray], least: float) -> Iterator[tuple[int, int]]:
    """Pairs of positions that span the links (Jaccard of at least least) among sets."""
    rest, front = np.arange(1, len(sets)), [0]
    while len(rest):
        if not front:
            front, rest = [int(rest[0])], rest[1:]
            continue
        seed = front.pop()
        hit = _reached(sets[seed], [sets[i] for i in rest], least)
        reached, rest = rest[hit], rest[~hit]
        front.extend(reached.tolist())
        yield from ((seed, int(i)) for i in reached)


def _link_groups(batches: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    """Rows (g, fp, hashes), with the rows of a g together, to links (a, b)."""

    def links(fp: list[int], sets: list[np.ndarray]) -> pd.DataFrame:
        found = [(fp[i], fp[j]) for i, j in _forest(sets, least)]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    last, fp, sets = None, [], []
    for pdf in batches:
        out = []
        for g, f, h in zip(pdf["g"], pdf["fp"], pdf["hashes"], strict=True):
            if g != last and fp:
                out.append(links(fp, sets))
                fp, sets = [], []
            last = g
            fp.append(int(f))
            sets.append(np.frombuffer(h, "<u4"))
        if out:
            yield pd.concat(out)
    if fp:
        yield links(fp, sets)


def _verify(batches: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    """Rows (a, b, hashes, others: b's) that are similar."""
    for pdf in batches:
        good = [bool(_reached(np.frombuffer(x, "<u4"), [np.frombuffer(y, "<u4")], least)[0]) for x, y in zip(pdf["hashes"], pdf["others"], strict=True)]
        yield pdf.loc[good, ["a", "b"]]


def _link_rest(batches: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    """Rows (g, fp, hashes, loose: whether it is to meet all others, linked: whether it is linked to the key's first set), rows of a g together, to links."""

    def links(rows: list[tuple[int, np.ndarray, bool, bool]]) -> list[tuple[int, int]]:
        loose = {fp: h for fp, h, is_loose, is_linked in rows if is_loose or not is_linked}
        names, sets = list(loose), list(loose.values())
        found = [(names[i], names[j]) for i, j in _forest(sets, least)]
        others = [(fp, h) for fp, h, _, is_linked in rows if is_linked]
        if others:  # these are linked to each other: one will do
            for fp in {fp for fp, _, is_loose, _ in rows if is_loose}:
                hit = np.flatnonzero(_reached(loose[fp], [h for _, h in others], least))
                found += [(fp, others[i][0]) for i in hit[:1]]
        return found

    last, rows = None, []
    for pdf in batches:
        out = []
        for g, fp, h, loose, linked in zip(pdf["g"], pdf["fp"], pdf["hashes"], pdf["loose"], pdf["linked"], strict=True):
            if g != last and rows:
                out += links(rows)
                rows = []
            last = g
            rows.append((int(fp), np.frombuffer(h, "<u4"), bool(loose), bool(linked)))
        if out:
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    if rows:
        yield pd.DataFrame(links(rows), columns=["a", "b"], dtype="int64")


def _links_by_key(shared: DataFrame, sets: DataFrame, least: float, chunk: int) -> DataFrame:
    """shared (fp, g): sets and the keys that they share with others; sets (fp, size, hashes) -> links (a, b) that span all links of sets that share a key."""
    n = F.count("*").alias("n")
    # Keys with the same members are one; members are told by their number, the least and the sum of their hashes.
    keys = shared.groupBy("g").agg(F.min("fp").alias("m"), n, F.sum(F.xxhash64("fp").cast("decimal(38,0)")).alias("s")).filter("n > 1").groupBy("m", "n", "s").agg(F.min("g").alias("g"))
    held = saved(shared.join(keys.select("g", "m").hint("merge"), "g"), "held")
    pairs = held.filter("fp <> m").select(F.col("fp").alias("a"), F.col("m").alias("b")).distinct()
    with_a = pairs.join(sets.select(F.col("fp").alias("a"), "hashes").hint("merge"), "a")
    star = saved(with_a.join(sets.select(F.col("fp").alias("b"), F.col("hashes").alias("others")).hint("merge"), "b").mapInPandas(partial(_verify, least=least), "a long, b long"), "star")
    linked = held.join(star.select(F.col("a").alias("fp"), F.col("b").alias("m"), F.lit(True).alias("linked")).hint("merge"), ["fp", "m"], "left")
    told = saved(linked.withColumn("linked", F.coalesce("linked", F.col("fp") == F.col("m"))).join(sets.select("fp", "size").hint("merge"), "fp"), "told")
    parts = lambda of: F.greatest(F.ceil(F.sum(of.cast("int")) / chunk), F.ceil(F.sum(F.when(of, F.col("size")).otherwise(0)) / CHUNK_BYTES)).cast("int")
    open_ = saved(told.groupBy("g").agg(parts(~F.col("linked")).alias("rows"), parts(F.lit(True)).alias("columns")).filter("rows > 0"), "open")
    # What isn't linked to the key's first set meets all of the key's sets.
    told = told.join(open_.hint("merge"), "g").withColumn("mine", F.xxhash64("fp", F.lit(1)))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    loose = told.filter("NOT linked").select("g", "fp", "linked", F.pmod("mine", "rows").cast("int").alias("i"), every("columns").alias("j"), F.lit(True).alias("loose"))
    others = told.select("g", "fp", "linked", every("rows").alias("i"), F.pmod("mine", "columns").cast("int").alias("j"), F.lit(False).alias("loose"))
    groups = loose.unionByName(others).join(sets.select("fp", "hashes").hint("merge"), "fp").select(F.xxhash64("g", "i", "j").alias("g"), "fp", "hashes", "loose", "linked")
    return star.unionByName(groups.repartition("g").sortWithinPartitions("g").mapInPandas(partial(_link_rest, least=least), "a long, b long"))


def simhash_keys(prints: DataFrame) -> DataFrame:
    """prints (fp: name of a set, print: SimHash fingerprint of a text that has it) -> (fp, g): a key for each component of fingerprints within four bits."""
    prints = saved(prints.distinct(), "prints")
    roots = saved(linked_components(prints.select(F.col("print").alias("fp"))), "print-roots")
    named = prints.join(roots.hint("merge"), prints["print"] == roots["node"], "left")
    return named.select("fp", F.xxhash64(F.lit("simhash"), F.coalesce("root", "print")).alias("g")).distinct()


def linked_sets(table: DataFrame, least: float, chunk: int = 512, more: DataFrame | None = None) -> DataFrame:
    """table (row, fp, keys, hashes), row unique -> (node, root) over names of sets that link to some other, roots left out.
    more (fp, g): further keys of sets."""
    # One row stands for its set; found by names alone, so that very many copies meet in partial minima only.
    chosen = saved(table.groupBy("fp").agg(F.min("row").alias("row"), F.max(F.octet_length("hashes")).cast("long").alias("size")), "chosen")
    keyed = table.select("row", "keys").join(chosen.hint("merge"), "row").select("fp", F.explode("keys").alias("g"))
    keyed = saved(keyed if more is None else keyed.unionByName(more), "keyed")
    met = saved(keyed.groupBy("g").agg(F.min("fp").alias("m"), F.count("*").alias("n")).filter("n > 1").drop("n"), "met")
    candidates = saved(connected_components(keyed.join(met.hint("merge"), "g").filter("fp <> m").select(F.col("fp").alias("a"), F.col("m").alias("b"))), "candidates")
    members = candidates.select(F.col("node").alias("fp"), "root").unionByName(candidates.select(F.col("root").alias("fp"), "root").distinct())
    members = saved(members.join(chosen, "fp"), "members")
    hot = saved(members.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).filter((F.col("n") > chunk) | (F.col("bytes") > CHUNK_BYTES)).select("root"), "hot")
    sets = table.select("row", "hashes")
    cold = sets.join(members.join(hot, "root", "left_anti").select("row", "fp", F.col("root").alias("g")).hint("merge"), "row").select("g", "fp", "hashes")
    links = cold.repartition("g").sortWithinPartitions("g").mapInPandas(partial(_link_groups, least=least), "a long, b long")
    if not hot.isEmpty():
        large = saved(members.join(hot, "root", "left_semi").select("row", "fp", "size"), "large")
        shared = keyed.join(met.select("g").hint("merge"), "g").join(large.select("fp").hint("merge"), "fp", "left_semi")
        links = links.unionByName(_links_by_key(shared, saved(sets.join(large.hint("merge"), "row").drop("row"), "sets"), least, chunk))
    return connected_components(links)


def one_of_each(docs: DataFrame, least: float = 0.8, shingle: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of docs, one row of each component of texts linked by a Jaccard similarity of at least least: that with
    the smallest id (rows without id last).

    A row is known by two hashes of its columns (maps left out); docs themselves are shuffled once, to meet the rows to keep.
    """
    hashed = [f"`{f.name}`" for f in docs.schema if "map<" not in f.dataType.simpleString()]
    own = ["_lodestone_o_a", "_lodestone_o_b"]
    keyed = docs.withColumns({own[0]: F.xxhash64(*hashed), own[1]: F.xxhash64(F.lit(1), *hashed)})
    narrow = keyed.select(F.col(own[0]).alias("a"), F.col(own[1]).alias("b"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), sketches(F.col(f"`{text}`"), shingle).alias("s"), fingerprints(F.col(f"`{text}`")).alias("print"))
    table = saved(narrow.select(F.monotonically_increasing_id().alias("row"), "a", "b", "doc_id", "s.*", "print"), "sketches")
    roots = saved(linked_sets(table.select("row", "fp", "keys", "hashes"), least, more=simhash_keys(table.select("fp", "print"))), "roots")
    members = table.select("a", "b", "doc_id", "fp").join(roots, table["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    best = members.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "a", "b")).alias("m"))
    kept = saved(best.select(F.col("m.a").alias(own[0]), F.col("m.b").alias(own[1])), "kept")
    # A merge join at every size: the rows to keep grow with the input.
    return keyed.join(kept.hint("merge"), own, "left_semi").dropDuplicates(own).select(*(f"`{x}`" for x in docs.columns))

"""LM scoring with an interpolated modified Kneser-Ney bigram model.

N-grams are counted in Spark and stored as sorted arrays of 64-bit keys with their counts, in files of the shared folder
that workers map into memory and search by bisection.

Words are stored by the 64-bit hash of their text; a word's place in the sorted array is its id. A bigram's key is the
pair of ids, exact, where two ids fit into 63 bits (over two thousand million words), else a 64-bit hash of the pair.
Counts have 64 bits. P(w | u) = max(c(u w) - D(c), 0) / c(u) + gamma(u) * P(w), with three discounts D for counts 1, 2
and more, and P(w) likewise from the number of different words before w, interpolated with the uniform distribution
over the vocabulary and one unknown word. The beginning of a text is a context, its end a word.

Scale: three passes over texts in tasks, which count before they emit; words and bigrams are dealt out to many buckets,
the bigrams of a frequent first word over as many of them as its share asks for; Spark sorts them, with spilling, and
tasks write them as they come. The driver sees one row a bucket. Workers map what they search, or read it by buckets
where the shared folder isn't mounted, and keep a bounded part; nothing of the model's size is broadcast.

Edge cases: null and empty texts are the end alone; unknown words share one unknown's probability; without training
texts every word is unknown; repeated rows count each time; null ids belong to the fold of the empty text; an empty
table gives an empty result; other columns are ignored. Different words with one 64-bit hash would be counted as one.
"""

from __future__ import annotations

import secrets
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bucket_of_id, new_path, saved
from lodestone.llm.tokens import Reader, _store

#: The end of a text as a word; no word can have this text. The beginning, a context only, has the id after all words.
END = b"\n"
FOLDS, HELD_OUT = 7, 2
#: Bits of a bigram's key that may hold two ids.
PACKED = 63
BLOCK = 1 << 16
_FLUSH = 1_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit numbers that spreads them evenly."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _words(text: str) -> list[bytes]:
    """Lower-case words in UTF-8 and the end. Of bytes, lower() changes A-Z and split() cuts at the six blanks, no others."""
    found = text.encode().lower().split()
    found.append(END)
    return found


def _groups(pdf: pd.DataFrame, chars: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Rows in groups of about so many characters, for texts may be very long."""
    for _, some in pdf.groupby(pdf["text"].str.len().cumsum().to_numpy() // chars, sort=False):
        yield some


def _runs(labels: np.ndarray) -> Iterator[np.ndarray]:
    """Positions of each run of equal labels."""
    return iter(np.split(np.arange(len(labels)), np.flatnonzero(np.diff(labels)) + 1)) if len(labels) else iter(())


def _by_label(labels: np.ndarray) -> Iterator[np.ndarray]:
    """Positions of each label; small labels sort in linear time."""
    small = len(labels) and labels.min() >= 0 and labels.max() < 1 << 16
    order = np.argsort(labels.astype(np.uint16) if small else labels, kind="stable")
    return (order[run] for run in _runs(labels[order]))


#: One for all tasks of a worker.
_read = Reader()


class Sorted:
    """Sorted keys and counts in bucket files: {bucket: (file, start, n)}; ids are places in the order of buckets."""

    def __init__(self, index: dict[int, tuple[str, int, int]]):
        self.index, self.base, at = index, {}, 0
        for b in sorted(index):
            self.base[b] = at
            at += index[b][2]
        self.size = at

    def __getstate__(self):
        return self.index

    def __setstate__(self, index):
        self.__init__(index)

    def segment(self, bucket: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts of a bucket."""
        file, start, n = self.index[bucket]
        return _read(file + ".key", "<i8", start, n), _read(file + ".cnt", "<i8", start, n)

    def find(self, buckets: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count or 0) of each key."""
        ids, counts = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        for some in _by_label(buckets):
            b = int(buckets[some[0]])
            if b in self.index:
                own, cnt = self.segment(b)
                asked = keys[some]
                at = np.minimum(np.searchsorted(own, asked), len(own) - 1)
                hit = own[at] == asked
                ids[some[hit]] = self.base[b] + at[hit]
                counts[some[hit]] = cnt[at[hit]]
        return ids, counts

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts by id; ids must be sorted."""
        buckets = np.array(sorted(self.base))
        bases = np.array([self.base[b] for b in buckets])
        of, out = np.searchsorted(bases, ids, "right") - 1, np.zeros(len(ids), np.int64)
        for run in _runs(of):
            b = int(buckets[of[run[0]]])
            out[run] = self.segment(b)[1][ids[run] - self.base[b]]
        return out


def _file(folder: str, number: int) -> str:
    return f"{folder}/{number:016x}"


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[dict[str, np.ndarray]]:
    """Rows (bucket, key, n, ...) sorted by bucket and key, in pieces of one bucket; n of equal keys is added up, across batches too."""
    last: dict[str, np.ndarray] = {}

    def pieces(rows: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
        for run in _runs(rows["bucket"]):
            yield {c: x[run[0] : run[-1] + 1] for c, x in rows.items()}

    for pdf in batches:
        if not len(pdf):
            continue
        rows = {c: pdf[c].to_numpy("i8") for c in pdf}
        if last:
            rows = {c: np.r_[last[c], x] for c, x in rows.items()}
        b, k = rows["bucket"], rows["key"]
        starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (b[1:] != b[:-1])])
        n = np.add.reduceat(rows["n"], starts)
        rows = {c: n if c == "n" else x[starts] for c, x in rows.items()}
        last = {c: x[-1:] for c, x in rows.items()}  # may go on in the next batch
        yield from pieces({c: x[:-1] for c, x in rows.items()})
    if last:
        yield from pieces(last)


def _write_sorted(batches: Iterator[pd.DataFrame], folder: str) -> Iterator[tuple[dict[str, np.ndarray] | None, tuple[int, int, int, int] | None]]:
    """Writes a partition's sorted rows to a file as they come; yields (piece, None) of each, and (None, (bucket, file
    number, start, size)) at the end of a bucket."""
    store = bucket = None
    try:
        for piece in _merged(batches):
            if store is None:
                store, path = _store(folder)
                store.create_dir(path, recursive=True)
                number, at, start = secrets.randbits(62), 0, 0
                files = [store.open_output_stream(_file(path, number) + x) for x in (".key", ".cnt")]
            if bucket is not None and piece["bucket"][0] != bucket:
                yield None, (bucket, number, start, at - start)
                start = at
            bucket = int(piece["bucket"][0])
            files[0].write(piece["key"].astype("<i8").tobytes())
            files[1].write(piece["n"].astype("<i8").tobytes())
            at += len(piece["key"])
            yield piece, None
    finally:
        if store is not None:
            for f in files:
                f.close()
    if bucket is not None:
        yield None, (bucket, number, start, at - start)


def _count_words(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    seen: Counter = Counter()

    def flush() -> pd.DataFrame:
        keys = _hashes(list(seen))
        out = pd.DataFrame({"bucket": (keys >> np.uint64(64 - bits)).astype("i4"), "key": keys.view("i8"), "n": np.fromiter(seen.values(), "i8", len(seen))})
        seen.clear()
        return out

    for pdf in batches:
        for text in pdf["text"]:
            seen.update(_words(text))
        if len(seen) > _FLUSH:
            yield flush()
    if seen:
        yield flush()


@dataclass
class Words:
    """The stored words, and what follows from their counts."""

    store: Sorted
    bits: int
    n_tokens: int
    n_texts: int
    buckets: int

    def __post_init__(self):
        self.begin = self.store.size
        self.shift = self.begin.bit_length()
        self.packed = 2 * self.shift <= PACKED

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of the words of all texts, their counts, number of words of each text)."""
        split = [_words(t) for t in texts]
        flat = list(chain.from_iterable(split))
        distinct = list(dict.fromkeys(flat))
        keys = _hashes(distinct)
        ids, counts = self.store.find((keys >> np.uint64(64 - self.bits)).astype("i4"), keys.view("i8"))
        at = np.fromiter(map(dict(zip(distinct, range(len(distinct)), strict=True)).__getitem__, flat), np.int64, len(flat))
        return ids[at], counts[at], np.fromiter(map(len, split), np.int64, len(split))

    def keys(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Keys of bigrams by their words' ids."""
        if self.packed:
            return u << self.shift | w
        return _mix(_mix(u) + w.astype(np.uint64)).view("i8")

    def parts(self, rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of bigrams: from their keys, or carried beside them."""
        return (rows["key"] >> self.shift, rows["key"] & ((1 << self.shift) - 1)) if self.packed else (rows["u"], rows["w"])

    def bigram_buckets(self, u: np.ndarray, w: np.ndarray, u_counts: np.ndarray) -> np.ndarray:
        """A first word with a share f of all tokens goes to 1 + f * buckets buckets."""
        parts = 1 + (u_counts * (self.buckets / max(1, self.n_tokens))).astype(np.uint64)
        part = _mix(w) % parts
        return (_mix(u.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + part) % np.uint64(self.buckets)).astype("i4")

    def pairs(self, ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every word's context and its count: the word before, or the beginning."""
        u, uc = np.r_[0, ids[:-1]], np.r_[0, counts[:-1]]
        first = np.cumsum(lengths) - lengths
        u[first], uc[first] = self.begin, self.n_texts
        return u, uc


def _count_bigrams(batches: Iterator[pd.DataFrame], words: Words) -> Iterator[pd.DataFrame]:
    held, size = [], 0

    def flush() -> pd.DataFrame:
        u, w = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        keys = words.keys(u, w)
        if words.packed:
            keys.sort()
        else:
            order = np.argsort(keys, kind="stable")
            keys, u, w = keys[order], u[order], w[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        n = np.diff(np.r_[starts, len(keys)])
        out = {"key": keys[starts], "n": n} | ({} if words.packed else {"u": u[starts], "w": w[starts]})
        u, w = words.parts(out)
        order = np.arange(len(u)) if words.packed else np.argsort(u, kind="stable")
        begins = int(np.searchsorted(u[order], words.begin))
        counts = np.empty(len(u), np.int64)
        counts[order] = np.r_[words.store.counts_of(u[order[:begins]]), np.full(len(u) - begins, words.n_texts)]
        return pd.DataFrame({"bucket": words.bigram_buckets(u, w, counts)} | out)

    for pdf in batches:
        for some in _groups(pdf):
            ids, counts, lengths = words.ids(some["text"].tolist())
            held.append((words.pairs(ids, counts, lengths)[0], ids))
            size += len(ids)
            if size > 6 * _FLUSH:
                yield flush()
                size = 0
    if held:
        yield flush()


#: What is known of an id: different words before it, and of the bigrams that begin with it, how many occur once, twice, more often.
BEFORE, ONCE, TWICE, MORE = range(4)


def _write_bigrams(batches: Iterator[pd.DataFrame], folder: str, words: Words) -> Iterator[pd.DataFrame]:
    """Writes bigram files; rows (k, v, file, start): v of an id's figure at k = 4 * id + figure; below zero, figures of
    the whole at -1 - i (bigrams that occur i times) and buckets at -10 - bucket, v their number of keys. Files are
    numbers, for sums and maxima of numbers are hashed where those of texts would be sorted."""
    counts = np.zeros(5, np.int64)
    before, held = [], 0

    def rows(k, v, file=0, start=0) -> pd.DataFrame:
        return pd.DataFrame({"k": k, "v": v, "file": file, "start": start})

    def befores() -> pd.DataFrame:
        ids, m = np.unique(np.concatenate(before), return_counts=True)
        before.clear()
        return rows(4 * ids + BEFORE, m)

    for piece, bucket in _write_sorted(batches, folder):
        if bucket:
            yield rows([-10 - bucket[0]], [bucket[3]], bucket[1], bucket[2])
            continue
        counts += np.bincount(np.minimum(piece["n"], 5), minlength=6)[1:]
        u, w = words.parts(piece)
        k, v = np.unique(4 * u + np.minimum(piece["n"], 3), return_counts=True)
        yield rows(k, v)
        before.append(w)
        held += len(w)
        if held > 4 * _FLUSH:
            yield befores()
            held = 0
    if before:
        yield befores()
    if counts.any():
        yield rows(-1 - np.arange(1, 5), counts[:4])


def discounts(t: list[int]) -> np.ndarray:
    """D for counts 0, 1, 2 and more, from the numbers of n-grams that occur 1, 2, 3 and 4 times."""
    if not t[0] or not t[1]:
        return np.array([0, 0.5, 0.75, 0.9])
    y = t[0] / (t[0] + 2 * t[1])
    d = [i - (i + 1) * y * t[i] / t[i - 1] if t[i - 1] else i / 2 for i in (1, 2, 3)]
    return np.array([0, *(min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1))])


def _write_blocks(batches: Iterator[pd.DataFrame], folder: str, low_d: np.ndarray, high_d: np.ndarray, total: int, rest: float) -> Iterator[pd.DataFrame]:
    """Rows (block, k, v), blocks together, to dense arrays of P(w) and of gamma(u) * c(u) by id."""
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    block, held = None, []

    def close_block():
        k, v = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        figures = np.zeros((BLOCK, 4), np.float64)
        figures.reshape(-1)[k - 4 * BLOCK * block] = v
        c = figures[:, BEFORE]
        low = np.maximum(c - low_d[np.minimum(c, 3).astype(int)], 0) / total + rest
        gamma = figures[:, ONCE:] @ high_d[1:]
        file = f"/{block:08d}-{secrets.token_hex(8)}"
        with store.open_output_stream(path + file) as f:
            f.write(np.stack([low, gamma]).astype("<f4").tobytes())
        return pd.DataFrame({"block": [block], "file": [folder + file]})

    for pdf in batches:
        b, k, v = (pdf[c].to_numpy("i8") for c in ("block", "k", "v"))
        for part in _runs(b):
            if held and block != b[part[0]]:
                yield close_block()
            block = int(b[part[0]])
            held.append((k[part], v[part]))
    if held:
        yield close_block()


@dataclass
class Model:
    """Paths and numbers; the arrays are mapped by those who use it."""

    words: Words
    bigrams: Sorted
    blocks: dict[int, str]
    high_d: np.ndarray
    unknown: float
    begin: float  # gamma(beginning) * number of texts

    def by_id(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(w) and gamma(u) * c(u) of ids; -1 is the unknown word."""
        low, gamma = np.full(len(ids), self.unknown), np.zeros(len(ids))
        blocks = np.where(ids < 0, 0, ids // BLOCK + 1)
        for some in _by_label(blocks):
            if (file := self.blocks.get(int(blocks[some[0]]) - 1)) is not None:
                low[some], gamma[some] = _read(file, "<f4", 0, 2 * BLOCK).reshape(2, BLOCK)[:, ids[some] % BLOCK]
        return low, gamma

    def score(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """(words, known words, base score, score) of each text, in log10."""
        ids, counts, lengths = self.words.ids(texts)
        u, uc = self.words.pairs(ids, counts, lengths)
        low, gamma = self.by_id(ids)
        gamma = np.where(u == self.words.begin, self.begin, np.r_[0, gamma[:-1]])
        ask = np.flatnonzero((u >= 0) & (ids >= 0))
        c = np.zeros(len(ids))
        c[ask] = self.bigrams.find(self.words.bigram_buckets(u[ask], ids[ask], uc[ask]), self.words.keys(u[ask], ids[ask]))[1]
        has = (u >= 0) & (uc > 0)
        total = np.where(has, uc, 1)
        p = np.where(has, np.maximum(c - self.high_d[np.minimum(c, 3).astype(int)], 0) / total + gamma / total * low, low)
        starts = np.cumsum(lengths) - lengths
        base = np.log10((counts + 1) / (self.words.n_tokens + self.words.store.size + 1))
        return lengths, np.add.reduceat(counts > 0, starts, dtype=np.int64), np.add.reduceat(base, starts), np.add.reduceat(np.log10(p), starts)


def train(texts: DataFrame) -> Model:
    """texts (text) -> the model, its arrays written to the shared folder."""
    spark = texts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(8, (4 * n - 1).bit_length())
    folder = new_path(spark, "words")
    counted = texts.mapInPandas(partial(_count_words, bits=bits), "bucket int, key long, n long")
    index = counted.repartition(n, "bucket").sortWithinPartitions("bucket", "key").mapInPandas(partial(_write_words, folder=folder), "bucket int, file long, start long, size long, n long").collect()
    store = Sorted({r["bucket"]: (_file(folder, r["file"]), r["start"], r["size"]) for r in index})
    words = Words(store, bits, sum(r["n"] for r in index), 0, 1 << bits)
    end = _hashes([END])
    words.n_texts = int(store.find((end >> np.uint64(64 - bits)).astype("i4"), end.view("i8"))[1][0])
    folder = new_path(spark, "bigrams")
    pairs = texts.mapInPandas(partial(_count_bigrams, words=words), "bucket int, key long, n long" + ", u long, w long" * (not words.packed))
    figures = pairs.repartition(n, "bucket").sortWithinPartitions("bucket", "key").mapInPandas(partial(_write_bigrams, folder=folder, words=words), "k long, v long, file long, start long")
    figures = saved(figures.groupBy("k").agg(F.sum("v").alias("v"), F.max("file").alias("file"), F.max("start").alias("start")), "figures")
    whole = {r["k"]: r for r in figures.filter("k < 0").collect()}  # one row a bucket
    bigrams = Sorted({-10 - k: (_file(folder, r["file"]), r["start"], r["v"]) for k, r in whole.items() if k <= -10})
    high_d = discounts([whole[-1 - i]["v"] if -1 - i in whole else 0 for i in range(1, 5)])
    own = figures.filter(f"k >= 0 and k < {4 * words.begin}")
    before = own.filter(f"k % 4 = {BEFORE}").agg(F.sum("v"), *(F.count_if(F.col("v") == i) for i in range(1, 5)), F.count_if(F.col("v") >= 3)).first()
    total = before[0] or 0
    low_d = discounts(list(before[1:5]))
    vocabulary = store.size + 1
    rest = float(low_d[1:] @ [before[1], before[2], before[5]]) / total / vocabulary if total else 1 / vocabulary
    folder = new_path(spark, "blocks")
    blocks = own.select(F.floor(F.col("k") / (4 * BLOCK)).cast("long").alias("block"), "k", "v").repartition(n, "block").sortWithinPartitions("block")
    blocks = blocks.mapInPandas(partial(_write_blocks, folder=folder, low_d=low_d, high_d=high_d, total=max(1, total), rest=rest), "block long, file string").collect()
    begin = {r["k"] - 4 * words.begin: r["v"] for r in figures.filter(f"k >= {4 * words.begin}").collect()}
    return Model(words, bigrams, {r["block"]: r["file"] for r in blocks}, high_d, rest, float(sum(high_d[i] * begin.get(i, 0) for i in (1, 2, 3))))


def _write_words(batches: Iterator[pd.DataFrame], folder: str) -> Iterator[pd.DataFrame]:
    n = 0
    for piece, bucket in _write_sorted(batches, folder):
        if piece is not None:
            n += int(piece["n"].sum())
        else:
            yield pd.DataFrame([(*bucket, n)], columns=["bucket", "file", "start", "size", "n"])
            n = 0


def _score(batches: Iterator[pd.DataFrame], model: Model) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for some in _groups(pdf):
            n, known, base, score = model.score(some["text"].tolist())
            yield pd.DataFrame({"doc_id": some["doc_id"].to_numpy(), "n_tokens": n, "n_known": known, "train_tokens": model.words.n_tokens, "base_score": base, "score": score})


def lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    own = docs.select(F.col(f"`{doc_id}`").cast("string").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    held_out = bucket_of_id(F.col("doc_id"), FOLDS) == HELD_OUT
    model = train(own.filter(~held_out).select("text"))
    scored = own.mapInPandas(partial(_score, model=model), "doc_id string, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))

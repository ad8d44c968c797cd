"""Benchmark decontamination by latent semantic retrieval.

Passages are TF-IDF vectors over the benchmark's words (square root of the count times idf, idf counted over all
documents). The latent space comes from a distributed randomised SVD of two kinds of passages, each kind with half of
the weight: the benchmark's items, and those passages of all documents in which the benchmark's words carry weight
(COSINE ** 2 of the squared norm; no other passage can reach that cosine with an item). `rank` directions are kept.

Items are searched for by class of length, with windows of the least power of two that holds the item, beginning every
quarter of it: so a verbatim item fills over half of some window, whatever its length. Items of a window's class whose
cosine with it, in the latent space, is high enough are candidates. A candidate counts if the longest common subsequence
of its words with the surrounding words covers enough of it, and enough of its answer (the words of its last sentence):
so copies with words changed, added or left out are found, and texts that only share vocabulary are not. The latent
space only proposes: equal words have equal places in it at any rank; a low rank costs candidates that don't hold.

Scale: documents are turned into word ids once, without a shuffle; idf, passages and windows are made from those. What is
shuffled is one row per word and task, the passages of the SVD (without their texts) and its partial sums, which are
added in two steps. The benchmark is the small side and travels whole: `max_bytes` bounds its index (basis and items),
beyond which the call is refused.

Edge cases: null or empty texts match nothing; items without words match nothing; equal items all match; repeated rows
get equal answers; very short items (from one word on) and very long ones are searched like others; empty tables give an
empty result; null ids are carried; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import saved

#: Least cosine of a candidate; least share of an item, and of its answer, in the common subsequence.
COSINE, COVERED, ANSWERED = 0.4, 0.7, 0.5
_ODD = re.compile(r"[\W_]+")
_SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")


def tokens(text: str | None) -> list[str]:
    """Lower-case words without punctuation."""
    return [w for w in (_ODD.sub("", x) for x in (text or "").lower().split()) if w]


def answer_length(text: str) -> int:
    """Words of an item's last sentence."""
    parts = [n for n in (len(tokens(s)) for s in _SENTENCE.split(text)) if n]
    return parts[-1] if parts else 0


def common_length(a: list[int], b: list[int], tail: int) -> tuple[int, int]:
    """Length of the longest common subsequence of a and b, and of the last tail words of a with b; bit-parallel."""

    def length(x: list[int]) -> int:
        v = full
        for w in x:
            u = v & where.get(w, 0)
            v = ((v + u) | (v - u)) & full
        return len(b) - v.bit_count()

    where: dict[int, int] = {}
    for j, w in enumerate(b):
        where[w] = where.get(w, 0) | 1 << j
    full = (1 << len(b)) - 1
    return length(a), length(a[len(a) - tail :])


def window_of(words: int) -> int:
    """Words of the windows that items of that many words are searched with: the least power of two that holds them."""
    return 1 << max(0, words - 1).bit_length()


class Vocabulary:
    """Ids of the benchmark's words; -1 for any other word. Remembers the spellings that it has met, up to a bound."""

    def __init__(self, words: list[str]):
        self.ids = {w: i for i, w in enumerate(words)}
        self.seen: dict[str, int] = {}

    def __getstate__(self):
        return self.ids

    def __setstate__(self, ids):
        self.ids, self.seen = ids, {}

    def __call__(self, text: str | None) -> np.ndarray:
        parts = (text or "").lower().split()
        missing = set(parts).difference(self.seen)
        if missing:
            if len(self.seen) > 200_000:
                self.seen, missing = {}, set(parts)
            for p in missing:
                w = _ODD.sub("", p)
                self.seen[p] = self.ids.get(w, -1) if w else -2
        ids = np.fromiter(map(self.seen.__getitem__, parts), np.int32, len(parts))
        return ids[ids > -2]


def _dtype(terms: int) -> str:
    return "<i2" if terms < 1 << 15 else "<i4"


def _encode(batches: Iterator[pd.DataFrame], vocabulary: Vocabulary) -> Iterator[pd.DataFrame]:
    dtype = _dtype(len(vocabulary.ids))
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [vocabulary(t).astype(dtype).tobytes() for t in pdf["text"]]})


def _groups(ids: pd.Series, dtype: str, words: int = 300_000) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(position of the first, ids of documents), of about so many words together."""
    held, size, first = [], 0, 0
    for i, b in enumerate(ids):
        held.append(np.frombuffer(b, dtype))
        size += len(held[-1])
        if size >= words:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def _document_counts(batches: Iterator[pd.DataFrame], terms: int) -> Iterator[pd.DataFrame]:
    n, df = 0, np.zeros(terms, np.int64)
    for pdf in batches:
        for b in pdf["ids"]:
            n += 1
            ids = np.unique(np.frombuffer(b, _dtype(terms)))
            df[ids[ids >= 0]] += 1
    at = np.flatnonzero(df)
    yield pd.DataFrame({"term": np.r_[-1, at], "n": np.r_[n, df[at]]})


def _projected(row: np.ndarray, terms: np.ndarray, values: np.ndarray, basis: np.ndarray, n: int) -> np.ndarray:
    """Sparse rows (row ascending) times basis."""
    out = np.zeros((n, basis.shape[1]), basis.dtype)
    if len(row):
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[starts]] = np.add.reduceat(values[:, None] * basis[terms], starts)
    return out


def _sketch(batches: Iterator[pd.DataFrame], basis: np.ndarray) -> Iterator[pd.DataFrame]:
    """Rows a of the matrix A -> this task's part of A' A basis, by term."""
    total, salt = np.zeros(basis.shape), None
    basis = basis.astype(np.float32)
    for pdf in batches:
        salt = int(pdf["salt"].iloc[0]) if salt is None and len(pdf) else salt
        for at in range(0, len(pdf), 2000):
            part = pdf.iloc[at : at + 2000]
            terms, values = np.concatenate(part["terms"].tolist()), np.concatenate(part["values"].tolist()).astype(np.float32)
            row = np.repeat(np.arange(len(part)), part["terms"].map(len))
            y = _projected(row, terms, values, basis, len(part))
            order = np.argsort(terms, kind="stable")
            starts = np.flatnonzero(np.r_[True, terms[order][1:] != terms[order][:-1]]) if len(terms) else []
            if len(terms):
                total[terms[order][starts]] += np.add.reduceat(values[order, None] * y[row[order]], starts)
    at = np.flatnonzero(total.any(1))
    if len(at):
        yield pd.DataFrame({"block": at // 256, "salt": salt, "term": at, "v": [x.tobytes() for x in total[at]]})


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    terms, at = np.unique(pdf["term"], return_inverse=True)
    v = np.zeros((len(terms), len(pdf["v"].iloc[0]) // 8))
    for i, b in zip(at, pdf["v"], strict=True):
        v[i] += np.frombuffer(b)
    return pd.DataFrame({"block": pdf["block"].iloc[0], "term": terms, "v": [row.tobytes() for row in v]})


def randomised_basis(rows: DataFrame, terms: int, rank: int, rounds: int = 2, seed: int = 1) -> np.ndarray:
    """rows (terms array<int>, values array<float>) -> orthonormal basis (terms x at most rank) of their leading right singular vectors."""
    if not terms:
        return np.zeros((0, 0), np.float32)
    width = min(terms, rank + 10)
    basis = np.random.default_rng(seed).standard_normal((terms, width))
    rows = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(32)))

    def applied(basis: np.ndarray) -> np.ndarray:
        out = np.zeros_like(basis)
        parts = rows.mapInPandas(partial(_sketch, basis=basis), "block int, salt int, term int, v binary")
        for by in (["block", "salt"], ["block"]):
            parts = parts.groupBy(*by).applyInPandas(_summed, "block int, term int, v binary")
        for r in parts.collect():  # terms rows
            out[r["term"]] = np.frombuffer(r["v"])
        return out

    for _ in range(rounds):
        basis = np.linalg.qr(applied(basis))[0]
    values, vectors = np.linalg.eigh(basis.T @ applied(basis))
    best = np.argsort(values)[::-1][:rank]
    return (basis @ vectors[:, best[values[best] > 1e-9 * max(values.max(), 1e-300)]]).astype(np.float32)


class Index:
    """The benchmark, ready to be searched; bounded by the benchmark's size."""

    def __init__(self, items: list[tuple[int | None, str]], vocabulary: Vocabulary, idf: np.ndarray, unknown: float):
        self.vocabulary, self.idf, self.unknown = vocabulary, idf.astype(np.float32), unknown
        self.items = [(i, vocabulary(t).tolist(), answer_length(t)) for i, t in items]
        self.sizes = np.array([window_of(len(ids)) for _, ids, _ in self.items], int)
        self.basis, self.classes = None, {}

    def sparse(self, ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, value) of the vectors of windows [start, end) of ids."""
        n, terms = end - start, max(1, len(self.idf))
        first = np.cumsum(n) - n
        row = np.repeat(np.arange(len(n)), n)
        t = ids[np.arange(len(row)) - first[row] + start[row]]
        key, counts = np.unique(row[t >= 0] * terms + t[t >= 0], return_counts=True)
        return key // terms, key % terms, np.sqrt(counts, dtype=np.float32) * self.idf[key % terms]

    def windows(self, ids: np.ndarray, lengths: np.ndarray, window: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, start, end) of the windows of documents laid end to end in which known words carry weight."""
        mass = np.where(ids >= 0, self.idf[ids] if len(self.idf) else 0, self.unknown).astype(np.float64) ** 2
        upto, known = np.r_[0, np.cumsum(mass)], np.r_[0, np.cumsum(np.where(ids >= 0, mass, 0))]
        base = np.cumsum(lengths) - lengths
        n = -(-np.maximum(1, lengths - window + stride) // stride)
        doc = np.repeat(np.arange(len(lengths)), n)
        start = base[doc] + (np.arange(len(doc)) - (np.cumsum(n) - n)[doc]) * stride
        end = np.minimum(start + window, (base + lengths)[doc])
        norm2 = upto[end] - upto[start]
        near = (known[end] - known[start] >= COSINE**2 * norm2) & (norm2 > 1e-12)
        return doc[near], start[near], end[near]

    def latent(self, ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Unit vectors of windows in the latent space; zero where nothing of a window lies in it."""
        y = _projected(*self.sparse(ids, start, end), self.basis, len(start))
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)

    def project(self, basis: np.ndarray) -> None:
        self.basis = basis
        flat = np.array([w for _, ids, _ in self.items for w in ids], np.int32)
        n = np.array([len(ids) for _, ids, _ in self.items], int)
        latent = self.latent(flat, np.cumsum(n) - n, np.cumsum(n)) if len(n) else np.zeros((0, basis.shape[1]), np.float32)
        self.classes = {int(w): (np.flatnonzero(self.sizes == w), latent[self.sizes == w]) for w in np.unique(self.sizes)}

    def matches(self, docs: list[np.ndarray]) -> list[list[tuple[int | None, float, float]]]:
        """(item_id, share of the item in the common subsequence, cosine) of every item that each document contains."""
        found: list[list] = [[] for _ in docs]
        lengths = np.array([len(x) for x in docs], int)
        if not len(self.items) or not lengths.sum():
            return found
        ids, base = np.concatenate(docs).astype(np.int32), np.cumsum(lengths) - lengths
        spans: dict[tuple[int, int], list] = {}
        for window, (rows, latent) in self.classes.items():
            doc, start, end = self.windows(ids, lengths, window, max(1, window // 4))
            step = max(1, 60_000 // window)
            for at in range(0, len(doc), step):
                s, e = start[at : at + step], end[at : at + step]
                cosines = self.latent(ids, s, e) @ latent.T
                for w, k in zip(*np.nonzero(cosines >= COSINE), strict=True):
                    d = int(doc[at + w])
                    spans.setdefault((d, int(rows[k])), []).append((float(cosines[w, k]), int(s[w] - base[d]), int(e[w] - base[d])))
        for (d, k), windows in sorted(spans.items()):
            item_id, words, answer = self.items[k]
            share = self._covered(docs[d], words, answer, windows)
            if share >= COVERED:
                found[d].append((item_id, share, max(windows)[0]))
        return found

    @staticmethod
    def _covered(ids: np.ndarray, words: list[int], answer: int, windows: list[tuple[float, int, int]]) -> float:
        """The largest share of an item in the common subsequence with the words around its windows, where its answer is there too."""
        at: list[list[int]] = []
        for _, s, e in windows:
            if at and s - len(words) <= at[-1][1]:
                at[-1][1] = e + len(words)
            else:
                at.append([max(0, s - len(words)), e + len(words)])
        share = 0.0
        for s, e in at:
            # Runs of overlapping windows are searched piece by piece, each twice as long as item and window.
            step = len(words) + window_of(len(words))
            for p in range(s, max(s + 1, e - step), step):
                piece = ids[p : p + 2 * step].tolist()
                there = set(piece)
                if sum(w in there for w in words) < COVERED * len(words):
                    continue
                whole, tail = common_length(words, piece, answer)
                if tail >= ANSWERED * answer:
                    share = max(share, whole / len(words))
        return share


def _passages(batches: Iterator[pd.DataFrame], index: Index) -> Iterator[pd.DataFrame]:
    """The vectors, of unit length, of documents' passages in which known words carry weight, one after another, for every class of length."""
    dtype = _dtype(len(index.idf))
    for pdf in batches:
        for _, docs in _groups(pdf["ids"], dtype):
            ids, lengths = np.concatenate(docs), np.array([len(x) for x in docs], int)
            for window in np.unique(index.sizes):
                _, start, end = index.windows(ids, lengths, int(window), int(window))
                row, terms, values = index.sparse(ids, start, end)
                if len(row):
                    cuts = np.flatnonzero(row[1:] != row[:-1]) + 1
                    starts = np.r_[0, cuts]
                    values = values / np.repeat(np.sqrt(np.add.reduceat(values**2, starts)), np.diff(np.r_[starts, len(row)]))
                    yield pd.DataFrame({"terms": np.split(terms.astype(np.int32), cuts), "values": np.split(values.astype(np.float32), cuts)})


def build_index(docs: DataFrame, benchmark: DataFrame, rank: int = 128, max_bytes: int = 256 << 20, rows_a_task: int = 200_000) -> tuple[Index, DataFrame]:
    """docs (doc_id, text), benchmark (item_id, text) -> the index, and docs as (doc_id, ids), written."""
    spark = docs.sparkSession
    n_words = benchmark.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")))).first()[0] or 0
    if 8 * n_words > max_bytes:
        raise ValueError(f"a benchmark of {n_words} words; its index may take {max_bytes} bytes")
    items = sorted(((r["item_id"], r["text"]) for r in benchmark.select("item_id", "text").collect() if tokens(r["text"])), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    vocabulary = Vocabulary(sorted({w for _, t in items for w in tokens(t)}))
    terms = len(vocabulary.ids)
    if 8 * (terms * (rank + 10) + len(items) * rank + n_words) > max_bytes:
        raise ValueError(f"a benchmark of {len(items)} items and {terms} different words; its index may take {max_bytes} bytes")
    encoded = saved(docs.select("doc_id", "text").mapInPandas(partial(_encode, vocabulary=vocabulary), "doc_id string, ids binary"), "word-ids")
    counts = encoded.select("ids").mapInPandas(partial(_document_counts, terms=terms), "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = {r["term"]: r["n"] for r in counts.collect()}  # one row per word of the benchmark
    n = counts.get(-1, 0)
    df = np.array([counts.get(i, 0) for i in range(terms)], float)
    index = Index(items, vocabulary, np.log((n + 2) / (df + 1)), float(np.log((n + 2) / 2)))
    schema = "terms array<int>, values array<float>"
    passages = saved(encoded.select("ids").mapInPandas(partial(_passages, index=index), schema), "passages")
    n_passages = passages.count()
    weight, rows = max(1.0, n_passages / max(1, len(items))) ** 0.5, []
    for _, ids, _ in index.items:
        _, t, v = index.sparse(np.array(ids, np.int32), np.array([0]), np.array([len(ids)]))
        rows.append((t.tolist(), (weight * v / max(1e-9, np.linalg.norm(v))).tolist()))
    matrix = passages.unionByName(spark.createDataFrame(rows, schema)).repartition(max(1, (n_passages + len(rows)) // rows_a_task))
    index.project(randomised_basis(saved(matrix, "matrix"), terms, rank))
    return index, encoded


def _search(batches: Iterator[pd.DataFrame], index: Index) -> Iterator[pd.DataFrame]:
    dtype = _dtype(len(index.idf))
    for pdf in batches:
        for first, docs in _groups(pdf["ids"], dtype):
            rows = [(pdf["doc_id"].iloc[first + j], None if i is None else str(i), share, cosine) for j, found in enumerate(index.matches(docs)) for i, share, cosine in found]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "covered", "cosine"])


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """A row for every row of docs and item of benchmark (item_id, text) that it contains: doc_id, item_id, covered, cosine."""
    index, encoded = build_index(docs.select(F.col(f"`{doc_id}`").cast("string").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")), _items(benchmark), **options)
    found = encoded.mapInPandas(partial(_search, index=index), "doc_id string, item_id string, covered double, cosine double")
    return found.withColumns({"doc_id": F.col("doc_id").cast("long"), "item_id": F.col("item_id").cast("long")})


def contains_item(text: Column, index: Index) -> Column:
    """Whether a text contains any item of the index."""

    @F.pandas_udf("boolean")
    def any_item(texts: pd.Series) -> pd.Series:
        ids = pd.Series([index.vocabulary(t).astype(_dtype(len(index.idf))).tobytes() for t in texts])
        return pd.Series([bool(found) for _, docs in _groups(ids, _dtype(len(index.idf))) for found in index.matches(docs)], dtype=bool)

    return any_item(text)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of docs that contain no item of benchmark. Texts are read twice, and not shuffled."""
    index, _ = build_index(docs.select(F.lit(None).cast("string").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")), _items(benchmark), **options)
    return docs.filter(~contains_item(F.col(f"`{text}`").cast("string"), index))

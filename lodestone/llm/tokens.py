"""Token ids in flat binary files: unsigned integers, 64-bit document offsets, memory-mapped by readers.

Documents are dealt out by ranges of doc_id, sorted within a range, encoded by a public tokenizer and written as one
shard a range: `.ids` (unsigned 16- or 32-bit token ids, one document after another), `.off` (n + 1 64-bit offsets of
documents, from the shard's first id) and `.doc` (64-bit doc_ids; the first n_null rows have none). A shard's place in
the whole corpus is the prefix sum of the shards before it, kept in the index, so that no shard waits for another.

Scale: texts are shuffled once; a task holds a batch of texts and a bounded cache, offsets and ids of documents are written as they
come; the driver sees one row a shard, and shards grow in number with the input, not in size. A task that is tried again writes another file, and the index names only files of tasks that succeeded.

Edge cases: null and empty texts are documents of the end id alone; rows without doc_id come first; ties and repeated
rows are all kept, in order of the text's hash; an empty table gives no shards; other columns are ignored. A vocabulary
of any kind that the tokenizers library reads will do; ids above what dtype holds are an error.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import uuid
import zlib
from array import array
from collections import OrderedDict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import new_path

_INDEX = "shard long, ids string, off string, doc string, n_docs long, n_null long, n_ids long"
_RUN = re.compile(r"\s\s")
_SPACE = re.compile(r"\s")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_RUNS = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")
#: Words that a worker remembers, besides those of the texts at hand.
CACHE = 500_000
#: Input of a shard, by Spark's estimate of the size of docs, and most shards, for an estimate may be far too high.
SHARD_BYTES, MOST_SHARDS = 256 << 20, 100_000


def _has_run(text: str) -> bool:
    """Whether white space may stand beside white space or at an end, so that not every space is a place to cut at."""
    return text[:1].isspace() or text[-1:].isspace() or (any(x in text for x in _RUNS) if text.isascii() else _RUN.search(text) is not None)


def _cuts_at_spaces(vocabulary: str) -> bool:
    """Whether a tokenizer splits at every single space between two non-space characters before it merges: a byte-level
    one with its own expression, nothing that rewrites texts, and added tokens that take no white space along."""
    with open(vocabulary, encoding="utf-8") as f:
        said = json.load(f)
    before, added = said.get("pre_tokenizer") or {}, said.get("added_tokens") or []
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    return bool(
        plain and said.get("model", {}).get("type") == "BPE" and not any(said.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))
        and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"] for t in added)
    )


class Encoder:
    """Ids of whole texts as bytes. Where the tokenizer splits at every single space between two non-space characters, a
    text's ids are the ids of its parts, cut before such spaces; parts are encoded once and remembered. With any other
    tokenizer, texts are encoded whole."""

    def __init__(self, vocabulary: str, dtype: str, end: int | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.dtype, self.code = np.dtype(dtype), {2: "H", 4: "I"}[np.dtype(dtype).itemsize]
        self.end = b"" if end is None else np.array([end], self.dtype).tobytes()
        self.cuts = _cuts_at_spaces(vocabulary)
        self.known: dict[str, bytes] = {}
        #: By id, whether a token begins with a space, which byte-level vocabularies write as U+0120.
        self.begins = np.zeros(0, bool)
        if self.cuts:
            words = self.tokenizer.get_vocab()
            self.begins = np.zeros(max(words.values(), default=0) + 1, bool)
            self.begins[[i for w, i in words.items() if w.startswith("\u0120")]] = True

    def _encoded(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), 10_000):
            for e in self.tokenizer.encode_batch_fast(texts[at : at + 10_000], add_special_tokens=False):
                yield array(self.code, e.ids).tobytes()

    def _of_words(self, words: list[str]) -> Iterator[bytes]:
        """The ids of each word, none of which has white space, behind a space. They are encoded as one text, in which a
        token that begins with a space begins a word; should there be more or fewer of these, one by one."""
        for at in range(0, len(words), 10_000):
            some = words[at : at + 10_000]
            text = " ".join(some)
            ids = np.array(self.tokenizer.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.dtype)
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) != len(some):
                yield from self._encoded([" " + w for w in some])
                continue
            raw, width = ids.tobytes(), self.dtype.itemsize
            ends = [*(starts * width).tolist(), len(raw)]
            yield from (raw[a:b] for a, b in itertools.pairwise(ends))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return [b + self.end for b in self._encoded(texts)]
        cut, words, known = [], set(), self.known
        for t in texts:
            parts = _CUT.split(t) if _has_run(t) else t.split(" ")
            cut.append(parts)
            words.update(parts)
        missing = words.difference(known)
        odd = [w for w in missing if not w or _SPACE.search(w)]
        plain = list(missing.difference(odd))
        known.update(zip(plain, self._of_words(plain), strict=True))
        known.update(zip(odd, self._encoded([" " + w for w in odd]), strict=True))
        found = [first + b"".join(map(known.__getitem__, parts[1:])) + self.end for first, parts in zip(self._encoded([p[0] for p in cut]), cut, strict=True)]
        if len(known) > CACHE:  # the words of the last texts stay; frequent ones are among them
            self.known = {w: known[w] for w in words} if len(words) <= CACHE // 2 else {}
        return found


@functools.lru_cache(maxsize=1)
def _encoder(vocabulary: str, dtype: str, end: int | None) -> Encoder:
    """One for all tasks of a worker, so that what it remembers outlives a task."""
    return Encoder(vocabulary, dtype, end)


def _store(folder: str):
    """A file system and a path that tasks can write to, whatever the shared folder's scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _write_shard(batches: Iterator[pd.DataFrame], folder: str, vocabulary: str, dtype: str, end: int | None) -> Iterator[pd.DataFrame]:
    """The three files of a shard, written side by side as texts come; nothing is kept of a document but its ids' number in the sum."""
    encoder, files, name = _encoder(vocabulary, dtype, end), [], None
    shard, n_docs, n_null, n_ids = None, 0, 0, 0
    for pdf in batches:
        # By size, for texts may be very long.
        group = pdf["text"].str.len().cumsum().to_numpy() // 4_000_000
        for _, some in pdf.groupby(group, sort=False):
            if not files:
                shard = int(some["shard"].iloc[0])
                store, path = _store(folder)
                store.create_dir(path, recursive=True)
                name = f"{path}/{shard:06d}-{uuid.uuid4().hex}"
                files = [store.open_output_stream(name + suffix) for suffix in (".ids", ".off", ".doc")]
                files[1].write(np.zeros(1, "<i8").tobytes())
            encoded = encoder(some["text"].tolist())
            for b in encoded:
                files[0].write(b)
            ends = n_ids + np.cumsum([len(b) // encoder.dtype.itemsize for b in encoded], dtype="<i8")
            files[1].write(ends.astype("<i8").tobytes())
            files[2].write(some["doc_id"].to_numpy("<i8").tobytes())
            n_docs, n_null, n_ids = n_docs + len(some), n_null + int(some["absent"].sum()), int(ends[-1])
    if not files:
        return
    for f in files:
        f.close()
    base = folder + name.removeprefix(path)
    yield pd.DataFrame([(shard, base + ".ids", base + ".off", base + ".doc", n_docs, n_null, n_ids)], columns=[x.split()[0] for x in _INDEX.split(", ")])


class TokenFiles:
    """The index of a written corpus; its rows carry the start of each shard in the whole."""

    def __init__(self, spark: SparkSession, folder: str, dtype: str, shards: list):
        self.spark, self.folder, self.dtype = spark, folder, dtype
        starts = itertools.accumulate((s["n_ids"] for s in shards), initial=0)
        self.shards = [(*s, start) for s, start in zip(shards, starts, strict=False)]
        self.n_ids = sum(s["n_ids"] for s in shards)

    def index(self) -> DataFrame:
        """One row a shard: its files, sizes and start; as many partitions as shards."""
        schema = _INDEX + ", start long"
        return self.spark.createDataFrame(self.shards, schema).repartition(max(1, len(self.shards)), "shard")

    def documents(self, with_ids: bool = False) -> DataFrame:
        """Read from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as 32-bit little-endian), and the ids if asked for."""
        schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
        return self.index().mapInPandas(partial(_read_shards, dtype=self.dtype, with_ids=with_ids), schema)


class Reader:
    """Parts of files as arrays: memory-mapped where the shared folder is mounted; else read by ranges, of which the
    latest are kept, up to so many bytes."""

    def __init__(self, most: int = 256 << 20):
        self.most, self.size, self.mapped, self.stores, self.kept = most, 0, {}, {}, OrderedDict()

    def __call__(self, uri: str, dtype: str, start: int, n: int) -> np.ndarray:
        """n values from the start-th on."""
        if not n:
            return np.empty(0, dtype)
        if (whole := self.mapped.get((uri, dtype))) is not None:
            return whole[start : start + n]
        store, path = self.stores.get(uri) or self.stores.setdefault(uri, _store(uri))
        if store.type_name == "local":
            return self.mapped.setdefault((uri, dtype), np.memmap(path, dtype=dtype, mode="r"))[start : start + n]
        if (part := self.kept.pop((uri, start, n), None)) is None:
            width = np.dtype(dtype).itemsize
            with store.open_input_file(path) as f:
                f.seek(start * width)
                part = np.frombuffer(f.read(n * width), dtype)
            self.size += part.nbytes
        self.kept[uri, start, n] = part
        while self.size > self.most and len(self.kept) > 1:
            self.size -= self.kept.popitem(last=False)[1].nbytes
        return part


def _read_shards(batches: Iterator[pd.DataFrame], dtype: str, with_ids: bool) -> Iterator[pd.DataFrame]:
    read = Reader(0)
    for pdf in batches:
        for s in pdf.itertuples():
            for at in range(0, s.n_docs, 2000):
                n = min(s.n_docs - at, 2000)
                off, doc = read(s.off, "<i8", at, n + 1), read(s.doc, "<i8", at, n)
                ids = [read(s.ids, dtype, int(a), int(b - a)) for a, b in zip(off, off[1:], strict=False)]
                rows = pd.DataFrame({
                    "doc_id": pd.array(doc, dtype="Int64"), "start": s.start + off[:-1], "n_tokens": off[1:] - off[:-1],
                    "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids],
                })
                rows.loc[np.arange(at, at + n) < s.n_null, "doc_id"] = pd.NA
                if with_ids:
                    rows["ids"] = [x.astype("<i8") for x in ids]
                yield rows


def _shards(docs: DataFrame) -> int:
    """As many shards as the session has shuffle partitions, or more where the input is larger."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // SHARD_BYTES), MOST_SHARDS))


def write_tokens(docs: DataFrame, vocabulary: str, end: int | None = 2, dtype: str = "<u2", shards: int | None = None, doc_id: str = "doc_id", text: str = "text", folder: str | None = None) -> TokenFiles:
    """Encodes and writes all docs; dtype must hold the vocabulary's ids ("<u2" below 65,536, else "<u4")."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    n = shards or _shards(docs)
    ranged = (
        docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
        .withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
        .repartitionByRange(n, "doc_id", "tie", "row")  # row spreads rows that are repeated very often
        .sortWithinPartitions("doc_id", "tie")
        .select(F.spark_partition_id().alias("shard"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("absent"), "text")
    )
    done = ranged.mapInPandas(partial(_write_shard, folder=folder, vocabulary=vocabulary, dtype=dtype, end=end), _INDEX)
    return TokenFiles(spark, folder, dtype, sorted(done.collect(), key=lambda s: s["shard"]))

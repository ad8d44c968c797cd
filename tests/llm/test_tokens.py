import random
import zlib

import numpy as np

from lodestone.llm import tokens
from lodestone.llm.queries import vocabulary
from tests.llm.helpers import edges, empty, table


def encoder():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def compare(df):
    t = encoder()
    want, start = [], 0
    texts = sorted(((r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    for d, text in texts:
        ids = t.encode(text, add_special_tokens=False).ids + [2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = tokens.write_tokens(df, vocabulary(), shards=3)
    found = sorted((tuple(r) for r in got.documents().collect()), key=lambda x: x[1])
    assert found == want
    assert got.n_ids == start
    return got


def test_round_trip(spark):
    files = compare(table(spark, sf="sf0.001"))
    t = encoder()
    texts = {r["doc_id"]: r["text"] for r in table(spark).collect()}
    for r in files.documents(with_ids=True).collect():
        assert t.decode(r["ids"][:-1]) == texts[r["doc_id"]] and r["ids"][-1] == 2


def test_edges(spark):
    compare(edges(spark))
    assert tokens.write_tokens(empty(spark), vocabulary()).documents().count() == 0


def test_parts_encode_like_whole_texts():
    rng, parts = random.Random(2), [" ", "  ", "\n", " \n", "\t", "a", "Bc'", "'s", "'ll", "12", "é", "\xa0", "　", "\x1c", "\x85", "😀", "<|endoftext|>", "...", "word", "-", "dogs'", "_", "x.\n", ")\n(", "<|", "|>", "½", "²", "e\u0301"]
    t, encode = encoder(), tokens.Encoder(vocabulary(), "<u2", 2)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(6000)]
    for text, b in zip(texts, encode(texts), strict=True):
        assert np.frombuffer(b, "<u2").tolist() == t.encode(text, add_special_tokens=False).ids + [2], repr(text)


def test_other_vocabularies_encode_whole_texts(spark):
    from tokenizers import Tokenizer

    path, texts = vocabulary("word_bpe_49k.json"), ["One  two, THREE<|endoftext|> four", "", " a b ", "line\n\nline"]
    t, encode = Tokenizer.from_file(path), tokens.Encoder(path, "<u2", None)
    assert not encode.cuts
    assert [np.frombuffer(b, "<u2").tolist() for b in encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 50)
    t, encode = encoder(), tokens.Encoder(vocabulary(), "<u2", 2)
    for k in range(5):
        texts = [f"word{k}x{i} common again" for i in range(40)]
        for text, b in zip(texts, encode(texts), strict=True):
            assert np.frombuffer(b, "<u2").tolist() == t.encode(text, add_special_tokens=False).ids + [2]
        assert len(encode.known) <= 50


def test_very_many_equal_rows_are_spread(spark):
    df = spark.createDataFrame([(None, "same") for _ in range(400)] + [(3, "x")], "doc_id long, text string").repartition(6)
    files = tokens.write_tokens(df, vocabulary(), shards=4)
    assert max(s[4] for s in files.shards) < 300
    assert sorted(r["start"] for r in files.documents().collect()) == list(range(0, 802, 2))


def test_a_shard_of_many_documents_is_written_as_it_comes(spark):
    import tracemalloc

    import pandas as pd

    folder = tokens.new_path(spark, "tokens")

    def written(n):
        batches = (pd.DataFrame({"shard": 0, "doc_id": range(at, at + 10_000), "absent": False, "text": "a b"}) for at in range(0, n, 10_000))
        tracemalloc.start()
        (row,) = list(tokens._write_shard(batches, folder, vocabulary(), "<u2", 2))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return row, peak

    written(10_000)
    (_, few), (row, many) = written(50_000), written(400_000)
    assert many < 1.3 * few
    store, path = tokens._store(row["off"][0])
    off = np.frombuffer(store.open_input_file(path).read(), "<i8")
    assert row["n_docs"][0] == 400_000 and len(off) == 400_001 and (np.diff(off) == 3).all() and off[-1] == row["n_ids"][0]


def test_shards_grow_with_the_input(spark, monkeypatch):
    docs = table(spark, sf="sf0.01")
    assert tokens._shards(docs) == 4
    monkeypatch.setattr(tokens, "SHARD_BYTES", 100_000)
    assert 10 < tokens._shards(docs) < 40
    monkeypatch.setattr(tokens, "MOST_SHARDS", 6)
    assert tokens._shards(docs) == 6

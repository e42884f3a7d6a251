import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidewell.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(rows):
    t = Tokenizer.from_file(PATH)
    start, out = 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_matches_plain_encoding(spark):
    odd = ["It's 10:45, isn't it?", "a\tb\x0bc d e", "caf́e ́x", "ÉCOLE, İstanbul ΣΑΣ", "<|endoftext|> x<|startoftext|>y", "", " ", "\n\n", "日本語 тест, ok!!", "foo's bar're '", "x" * 3000, "¡hola! l'été ß ª"]
    rows = [(i * 3, t) for i, t in enumerate(odd)] + [(None, "no id"), (1000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text")
    got = tokens.tokenized(docs, PATH, block_tokens=64).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == brute(rows)


def test_repeated_ids_lookup_and_empty(spark):
    docs = spark.createDataFrame([(5, "one two", 1), (5, "three", 2), (7, "four", 3), (None, "five", 4), (8, "word " * 300_000, 5), (9, None, 6)], "doc_id long, text string, n_tokens int")
    path = tokens.new_path(spark, "t")
    tokens.write_tokens(docs, PATH, path, block_tokens=3)
    t = Tokenizer.from_file(PATH)

    def plain(x):
        return [*t.encode(x, add_special_tokens=False).ids, 2]

    assert sorted(tokens.lookup(spark, path, 5)) == sorted(map(plain, ("one two", "three")))
    assert tokens.lookup(spark, path, 6) == [] and tokens.lookup(spark, path, 9) == [[2]]
    assert tokens.lookup(spark, path, 8) == [plain("word " * 300_000)]
    empty = tokens.new_path(spark, "t")
    assert tokens.write_tokens(docs.limit(0), PATH, empty).count() == 0 and tokens.lookup(spark, empty, 5) == []
    assert tokens.tokenized(docs.limit(0), PATH).count() == 0


def test_directory_of_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(tokens, "BUCKET_KEYS", 10)
    path = tokens.new_path(spark, "t")
    tokens.write_tokens(spark.range(0, 900, 3).selectExpr("id AS doc_id", "concat('word ', id) AS text"), PATH, path, block_tokens=50)
    t = Tokenizer.from_file(PATH)
    for i in (0, 3, 450, 897):
        assert tokens.lookup(spark, path, i) == [[*t.encode(f"word {i}", add_special_tokens=False).ids, 2]]
    assert tokens.lookup(spark, path, 1) == []


def test_index_is_minimal_and_perfect():
    ids = np.sort(np.random.default_rng(1).integers(-(2**60), 2**60, 5000))
    index = tokens.Index.build(ids, np.ones(5000, bool), np.arange(5001), 2)
    again = tokens.Index.from_bytes(index.to_bytes())
    assert (again.find(ids, np.zeros(5000, int)) == np.arange(5000)).all()
    assert sorted(again.ordinal.tolist()) == list(range(5000))
    assert (again.find(ids + 1, np.zeros(5000, int)) == -1).mean() > 0.99

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewell.llm import alignment
from tidewell.llm.queries import QUERIES

SCHEMA = "doc_id long, text string"
BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links"]


def byte_alphabet():
    from tokenizers import pre_tokenizers

    pre = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    out = {}
    for x in range(128):
        out[pre.pre_tokenize_str(chr(x))[0][0]] = x
    for x in range(0x80, 0x800):
        raw = chr(x).encode()
        for c, y in zip(pre.pre_tokenize_str(chr(x))[0][0], raw, strict=True):
            out[c] = y
    for x in (0x800, 0x1000, 0x2000, 0x3000, 0x4000, 0x5000, 0x6000, 0x7000, 0x8000, 0x9000, 0xA000, 0xB000, 0xC000, 0xD000, 0xE000, 0xF000, 0x10000, 0x40000, 0x80000, 0xC0000, 0x100000):
        for c, y in zip(pre.pre_tokenize_str(chr(x))[0][0], chr(x).encode(), strict=True):
            out[c] = y
    return out


class Brute:
    def __init__(self):
        self.a = Tokenizer.from_file(BYTE)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PIECE)
        self.alphabet = byte_alphabet()

    def tokens(self, text):
        """Lists of (id, start, end) in bytes, of the whole text at once; or None."""
        if not text:
            return None
        raw, out = b" " + text.encode(), []
        a = self.a.encode(" " + text, add_special_tokens=False)
        sides = [[(i, bytes(self.alphabet[c] for c in self.a.id_to_token(i))) for i in a.ids]]
        side = []
        for i in self.b.encode(text):
            p = self.b.id_to_piece(i)
            side.append((i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()))
        for side in (*sides, side):
            if b"".join(x for _, x in side) != raw:
                return None
            at, spans = 0, []
            for i, x in side:
                spans.append((i, at, at + len(x)))
                at += len(x)
            out.append(spans)
        return out

    def results(self, rows):
        seen, docs = Counter(), []
        for d, text in rows:
            both = self.tokens(text)
            if both is None:
                docs.append((d, 0, 0, 0, [], "", 0))
                continue
            a, b = both
            links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
            ends = sorted({x[2] for x in a} & {y[2] for y in b})
            text_of, many, low = [], 0, 0
            for e in ends:
                g = [[str(x[0]) for x in side if low < x[2] <= e] for side in both]
                many += len(g[0]) * len(g[1])
                text_of.append(",".join(g[0]) + "|" + ",".join(g[1]))
                low = e
            docs.append((d, len(a), len(b), len(ends), links, hashlib.sha256(";".join(text_of).encode()).hexdigest(), many))
            seen.update(set(links))
        best = {}
        for (a, _), n in seen.items():
            best[a] = max(n, best.get(a, 0))
        return sorted(((d, na, nb, ng, len(links), sum(seen[p] == best[p[0]] for p in links), sum(seen[p] for p in links), sha, many) for d, na, nb, ng, links, sha, many in docs), key=str)


@pytest.fixture(scope="module")
def brute():
    return Brute()


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


ODD = [
    (None, "no id but text"), (1, None), (2, ""), (3, " "), (4, "   leading and  double  spaces "), (5, "line\nbreaks \n here\r\n\tand tabs"),
    (6, "<|endoftext|> and <s> </s> <unk> as text"), (7, "a▁b"), (8, "bell\x07here"), (9, "nul\x00"), (10, "été ünïcode   x  y 　 z　 w"),
    (11, "ﬁne ｆｕｌｌ é café"), (12, "漢字かな 交じり文 没有空格的很长的句子" * 3), (13, "emoji 😀😀 👩‍👩‍👧 x😀y"), (14, "don't we'll I'M it's  's 've"),
    (15, "12345 678,901.5 1e-9 a1b2c3"), (15, "12345 678,901.5 1e-9 a1b2c3"), (16, "x" * 3000), (17, "    \x85 \x1c \x1f a"), (18, "a ​ b᠎ c ﻿ d"),
]


@pytest.mark.parametrize("chunk_bytes", [1 << 24, 600])
def test_against_brute_force(spark, brute, chunk_bytes):
    rnd = random.Random(4)
    letters = "abcdefgh  \n\t.,'é漢😀 　ABC123<>|-_"
    rows = ODD + [(100 + i, "".join(rnd.choice(letters) for _ in range(rnd.randrange(60)))) for i in range(150)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_a", F.lit("extra")).withColumn("kind", F.lit(7))
    assert got(alignment.aligned_counts(df, BYTE, PIECE, chunk_bytes=chunk_bytes)) == brute.results(rows)


def test_whole_texts_in_segments(brute):
    """Ids of the segments, joined, are those of whole texts, long ones in pieces included."""
    pair = alignment.Pair(BYTE, PIECE)
    rnd = random.Random(5)
    text = " ".join("".join(rnd.choice("etaoinsé漢.,'\n 19") for _ in range(rnd.randrange(1, 12))) for _ in range(40_000))
    x = alignment.align(pair, alignment.CUT.split(text))
    assert x.a.tolist() == brute.a.encode(" " + text, add_special_tokens=False).ids
    assert x.b.tolist() == brute.b.encode(text)
    chunk = alignment._Chunk(pair)
    old, alignment.PIECE = alignment.PIECE, 5000
    try:
        chunk.add(1, text)
    finally:
        alignment.PIECE = old
    whole = alignment._Chunk(pair)
    whole.add(1, text)
    assert chunk.docs[0][3] == whole.docs[0][3]


def test_product_against_dense():
    rng = np.random.default_rng(2)
    for shape in ((5, 7, 4), (1, 1, 1), (6, 3, 0)):
        x, y = rng.integers(0, 3, shape[:2]), rng.integers(0, 3, shape[1:])

        def csr(m):
            row, column = np.nonzero(m)
            return alignment.Csr(np.searchsorted(row, np.arange(len(m) + 1)), column, m[row, column], m.shape[1])

        z = csr(x) @ csr(y)
        dense = np.zeros((shape[0], shape[2]), int)
        for i in range(shape[0]):
            dense[i, z.column[z.first[i] : z.first[i + 1]]] = z.value[z.first[i] : z.first[i + 1]]
        assert (dense == x @ y).all()
        t = csr(x).transposed()
        assert t.columns == shape[0] and (np.diff(t.first) == (x > 0).sum(axis=0)).all()


def test_links_of_tokens(spark, brute):
    rows = [(1, "internationalisation of déjà-vu 漢字"), (2, None), (3, "a▁")]
    a, b = brute.tokens(rows[0][1])
    want = sorted((1, i, j, x[0], y[0], min(x[2], y[2]) - max(x[1], y[1])) for i, x in enumerate(a) for j, y in enumerate(b) if x[1] < y[2] and y[1] < x[2])
    assert sorted(tuple(r)[:6] for r in alignment.token_links(spark.createDataFrame(rows, SCHEMA), BYTE, PIECE).collect()) == want


def test_query_and_empty_table(spark, brute):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 4000").select("doc_id", "text").collect()]
    assert got(alignment.aligned_counts(spark.createDataFrame(rows, SCHEMA), BYTE, PIECE)) == brute.results(rows)
    assert QUERIES["op12_alignment"](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert got(alignment.aligned_counts(spark.createDataFrame([], SCHEMA), BYTE, PIECE)) == []

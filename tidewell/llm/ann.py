"""Approximate nearest neighbours by additive quantisation.

A vector is close to the sum of one codeword from each of several
full-dimensional codebooks, found by beam search over residuals; codes and
norms are stored in blocks beside the vectors.  A query block scores an index
block by lookup tables of inner products, each sum scaled by the stored norms
to the length of the vector it stands for, and the best `rerank` rows of each
block are then scored exactly on the original vectors.  The codebooks are
fitted on a bounded sample (`sample`); every row is indexed.

Queries and index are both cut into blocks of bounded size, and a task meets
one block of each; tasks pass on the best k rows of each query only.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import stored


class AdditiveQuantiser:
    """Codebooks (m, k, d); `beam` partial codes are kept while encoding."""

    def __init__(self, codebooks: np.ndarray, beam: int):
        self.codebooks, self.beam = codebooks, beam
        self.norms = (codebooks**2).sum(axis=2)
        self.code = np.uint8 if codebooks.shape[1] <= 256 else np.uint16

    @classmethod
    def fit(cls, x: np.ndarray, m: int, k: int, beam: int, rounds: int = 6, seed: int = 5) -> AdditiveQuantiser:
        rng = np.random.default_rng(seed)
        rest, books = x.astype(np.float32), []
        for _ in range(m):
            book = rest[rng.choice(len(rest), k, replace=len(rest) < k)].copy()
            for _ in range(rounds):
                at = np.argmin((book**2).sum(axis=1) - 2 * rest @ book.T, axis=1)
                size = np.bincount(at, minlength=k)
                order = np.argsort(at, kind="stable")
                sums = np.add.reduceat(np.concatenate((rest[order], np.zeros((1, x.shape[1]), np.float32))), np.minimum(np.cumsum(size) - size, len(rest)), axis=0)
                book = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], book).astype(np.float32)
            at = np.argmin((book**2).sum(axis=1) - 2 * rest @ book.T, axis=1)
            rest = rest - book[at]
            books.append(book)
        return cls(np.array(books), beam)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, m), and the norm of each vector over that of its sum (0 for a sum of 0)."""
        n, d = x.shape
        rest = x[:, None, :].astype(np.float32)
        error = (rest**2).sum(axis=2)
        codes = np.empty((n, 1, 0), self.code)
        for book, norms in zip(self.codebooks, self.norms, strict=True):
            width, k = rest.shape[1], len(book)
            cost = (error[:, :, None] - 2 * (rest.reshape(-1, d) @ book.T).reshape(n, width, k) + norms).reshape(n, -1)
            keep = min(self.beam, cost.shape[1])
            best = np.argpartition(cost, keep - 1, axis=1)[:, :keep]
            parent, word = best // k, best % k
            rows = np.arange(n)[:, None]
            rest = rest[rows, parent] - book[word]
            error = (rest**2).sum(axis=2)
            codes = np.concatenate((codes[rows, parent], word[:, :, None].astype(self.code)), axis=2)
        at = np.argmin(error, axis=1)
        rows = np.arange(n)
        own, of_sum = (np.sqrt((v.astype(np.float64) ** 2).sum(axis=1)) for v in (x, x - rest[rows, at]))
        return codes[rows, at], np.divide(own, of_sum, out=np.zeros(n), where=of_sum > 0).astype(np.float32)

    def scores(self, queries: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Inner products of queries with the coded vectors, from lookup tables, at the stored norms."""
        tables = np.einsum("qd,mkd->mqk", queries.astype(np.float32), self.codebooks, optimize=True)
        out = np.zeros((len(queries), len(codes)), np.float32)
        for table, own in zip(tables, codes.T, strict=True):
            out += table[:, own]
        return out * norms


def _best(scores: np.ndarray, most: int) -> np.ndarray:
    """Positions of the `most` largest scores; of equal ones, the first."""
    if len(scores) <= most:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - most)[len(scores) - most]
    above = np.flatnonzero(scores > least)
    return np.concatenate((above, np.flatnonzero(scores == least)[: most - len(above)]))


def _packed(rows: DataFrame, per_block: int, kind: str, quantiser=None) -> DataFrame:
    """Rows (vec_id, embedding) as blocks in ascending vec_id order: ids, vectors as numbers of a kind, and codes and norms if there is a quantiser."""
    shared = rows.sparkSession.sparkContext.broadcast(quantiser) if quantiser else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = [], []

        def block() -> pa.RecordBatch:
            i = np.concatenate(ids)
            x = np.concatenate(vectors).astype(kind)
            out = {"n": [len(i)], "ids": [i.astype("<i8").tobytes()], "vectors": [x.tobytes()], "codes": [None], "norms": [None]}
            if shared:
                codes, norms = shared.value.encode(x)
                out |= {"codes": [codes.tobytes()], "norms": [norms.astype("<f4").tobytes()]}
            return pa.RecordBatch.from_pydict(out, pa.schema([("n", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("codes", pa.binary()), ("norms", pa.binary())]))

        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                part = batch.slice(lo, per_block - sum(map(len, ids)))
                lo += part.num_rows
                ids.append(part.column(0).to_numpy())
                vectors.append(part.column(1).flatten().to_numpy().reshape(part.num_rows, -1))
                if sum(map(len, ids)) == per_block:
                    yield block()
                    ids, vectors = [], []
        if ids:
            yield block()

    return rows.mapInArrow(run, "n long, ids binary, vectors binary, codes binary, norms binary")


def nearest(
    vectors: DataFrame,
    is_query: Column | None = None,
    k: int = 20,
    codebooks: int = 16,
    codewords: int = 64,
    beam: int = 4,
    rerank: int = 300,
    sample: int = 8000,
    block_rows: int = 8192,
    query_rows: int = 1024,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """The k rows of largest inner product for each query: query_id, rank (from 1), vec_id, score.

    Queries are the rows for which is_query holds (default: vec_id divisible by
    20), candidates all rows of another vec_id; ties go to the smaller vec_id.
    score is the inner product of the original vectors in double precision.
    Rows with a null id, and vectors that are null, empty, zero, or hold null
    or non-finite components, take no part.  Vectors of several lengths are
    searched each among those of its own, as others have no inner product with
    it.  Of rows that repeat an id, the vector that sorts first counts.  With
    fewer than k candidates, all are returned; an empty table has no result.
    """
    spark = vectors.sparkSession
    whole = F.col(f"`{embedding}`").cast("array<double>")
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kind = "<f4" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "<f8"  # as they came: nothing is lost
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), whole.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~bad & F.exists("x", lambda v: v != 0))
    rows = rows.groupBy("vec_id").agg(F.min("x").alias("x"))
    rows = stored(rows, "vectors")
    lengths = [r.d for r in rows.select(F.size("x").alias("d")).distinct().orderBy("d").collect()]
    if not lengths:
        return spark.range(0).select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    asked = is_query if is_query is not None else F.col("vec_id") % 20 == 0
    found = [_nearest(rows.where(F.size("x") == d), asked, kind, k, codebooks, codewords, beam, rerank, sample, block_rows, query_rows) for d in lengths]
    return functools.reduce(DataFrame.unionByName, found)


def _nearest(rows: DataFrame, is_query: Column, kind: str, k: int, codebooks: int, codewords: int, beam: int, rerank: int, sample: int, block_rows: int, query_rows: int) -> DataFrame:
    """The search among rows (vec_id, x) of one length."""
    spark = rows.sparkSession
    learn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("x").toPandas()["x"]
    quantiser = AdditiveQuantiser.fit(np.stack(learn.to_numpy()), codebooks, min(codewords, len(learn)), beam)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_part = max(1, min(parts, rows.count() // block_rows))
    # full blocks, however many partitions the cluster deals rows to: a task passes on k rows a query and block
    dealt = rows.repartitionByRange(per_part, "vec_id").coalesce(per_part).sortWithinPartitions("vec_id")
    index = stored(_packed(dealt, block_rows, kind, quantiser), "index")
    asked = rows.where(is_query)
    queries = stored(_packed(asked.coalesce(per_part).sortWithinPartitions("vec_id"), query_rows, kind).select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")), "queries")
    shared = spark.sparkContext.broadcast(quantiser)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantised = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids, x, codes, norms, q_ids, q = (np.frombuffer(batch.column(c)[i].as_buffer(), k) for c, k in enumerate(("<i8", kind, quantised.code, "<f4", "<i8", kind)))
                x, q, codes = x.reshape(len(ids), -1), q.reshape(len(q_ids), -1).astype(np.float64), codes.reshape(len(ids), -1)
                found = []
                for lo in range(0, len(q), 64):
                    rough = quantised.scores(q[lo : lo + 64], codes, norms)
                    for j in range(len(rough)):
                        rough[j][ids == q_ids[lo + j]] = -np.inf
                        at = _best(rough[j], rerank)
                        at = at[ids[at] != q_ids[lo + j]]
                        exact = x[at].astype(np.float64) @ q[lo + j]
                        top = np.lexsort((ids[at], -exact))[:k]
                        found.append((np.full(len(top), q_ids[lo + j]), ids[at[top]], exact[top]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

    # every pair of blocks, not of rows: the stated query set against all rows
    pairs = index.select("ids", "vectors", "codes", "norms").crossJoin(queries)
    found = pairs.mapInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

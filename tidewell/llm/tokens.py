"""Token ids in binary shards with a minimal perfect hash index.

A folder of shards holds two tables.  In `blocks`, each row is a block: raw
little-endian ids of neighbouring documents, and an index over them.  In
`directory`, each row is a bucket of keys, by their hashes, and an index that
leads to the shard and block of each.  Both indexes are minimal perfect hashes
of the document keys (hash and displace): a key leads in constant time to one
slot, whose stored fingerprint tells whether the key is there, and which gives
its place.  So a lookup reads one bucket of the directory and the blocks of its
documents, however many there are.  Blocks hold at most `block_tokens` ids
unless one document alone has more, buckets about BUCKET_KEYS keys.

Writing goes through Spark's committer, so lost executors leave no half shards,
and any file system that Spark writes to will do.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textbytes as tb
from .shared import new_path

MAGIC = 0x5457_544B
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: A word of plain letters and the punctuation after it, which the tokenizer parts the same way.
PLAIN = "^(?P<core>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+)(?P<tail>[.,!?;:$%&#*|)\"-]*)$"
#: Words that a task remembers the ids of.
MOST_REMEMBERED = 400_000
#: Rows and bytes of text that are encoded at a time, one row at least.
ENCODED_ROWS, ENCODED_BYTES = 4096, 4 << 20
#: Keys in a bucket of the directory, in the mean.
BUCKET_KEYS = 1 << 16


class Encoder:
    """Ids of texts; remembers those of words, as blanks always part tokens in this kind of tokenizer.

    Arrow cuts texts into chunks and finds the distinct ones; only these are
    looked at in Python, and only new ones go through the tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(vocabulary.values()) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.final = np.zeros(size, bool)
        for token, i in vocabulary.items():
            self.final[i] = token.endswith("</w>")
        self.chunks: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, cores: list[str]) -> list[bytes]:
        """Lower-case runs of letters, many to a call: each ends with the one token that is final in a word."""
        out = []
        for i in range(0, len(cores), 2000):
            part = cores[i : i + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            ends = ((np.flatnonzero(self.final[ids]) + 1) * self.dtype.itemsize).tolist()
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *ends], ends)] if len(ends) == len(part) else self._plain(part)
        return out

    @staticmethod
    def _remembered(known: dict[str, bytes], pieces: list[str], learn: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        if len(known) > MOST_REMEMBERED:
            known.clear()
        if missing := [p for p in pieces if p not in known]:
            known.update(zip(missing, learn(missing), strict=True))
        return [known[p] for p in pieces]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[pa.Buffer, np.ndarray]:
        """Raw ids of all texts in a row, each with the end id, and the bytes at which each text's begin."""
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        bounds = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        words = parts.flatten().dictionary_encode()
        forms = words.dictionary
        split = pc.extract_regex(forms, PLAIN)
        plain = pc.is_valid(split)
        cores = pc.utf8_lower(split.field("core").filter(plain)).dictionary_encode()
        tails = split.field("tail").filter(plain).dictionary_encode()
        odd = forms.filter(pc.invert(plain)).to_pylist()
        pieces = self._remembered(self.cores, cores.dictionary.to_pylist(), self._joined)
        n_cores = len(pieces)
        pieces += self._remembered(self.chunks, tails.dictionary.to_pylist(), self._plain)
        n_tails = len(pieces) - n_cores
        pieces += self._remembered(self.chunks, odd, self._plain) + [b"", np.array([end_id], self.dtype).tobytes()]
        # each form is two pieces: a core and its tail, or an odd chunk and the empty piece
        is_plain = plain.to_numpy(zero_copy_only=False)
        two = np.full((len(forms), 2), len(pieces) - 2, np.int32)
        two[is_plain, 0] = cores.indices.to_numpy()
        two[is_plain, 1] = tails.indices.to_numpy() + n_cores
        two[~is_plain, 0] = np.arange(len(odd)) + n_cores + n_tails
        flat = np.insert(two[words.indices.to_numpy()].ravel(), 2 * bounds[1:], len(pieces) - 1)
        ids = pa.array(pieces, pa.large_binary()).take(pa.array(flat))
        ends = np.frombuffer(ids.buffers()[1], np.int64)[2 * bounds.astype(np.int64) + np.arange(len(bounds))]
        return ids.buffers()[2], ends


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _key_hash(ids: np.ndarray, times: np.ndarray) -> np.ndarray:
    return tb.mix(tb.mix(ids.view(np.uint64) + GOLDEN) + times.astype(np.uint64) * GOLDEN)


def _slot(h: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    return (tb.mix(h + displacement.astype(np.uint64) * GOLDEN) % np.uint64(n)).astype(np.int64)


class Index:
    """Minimal perfect hash index of a block: key (id, how many times it came before) -> ordinal, offset, length."""

    def __init__(self, ids: np.ndarray, valid: np.ndarray, bounds: np.ndarray, displacement: np.ndarray, ordinal: np.ndarray, fingerprint: np.ndarray, width: int):
        self.ids, self.valid, self.bounds, self.displacement, self.ordinal, self.fingerprint, self.width = ids, valid, bounds, displacement, ordinal, fingerprint, width

    @staticmethod
    def times(ids: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """How many equal keys stand before each one, equal keys being neighbours; null keys count down from -1."""
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (valid[1:] != valid[:-1])
        at = np.arange(len(ids)) - np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
        return np.where(valid, at, -1 - at)

    @classmethod
    def build(cls, ids: np.ndarray, valid: np.ndarray, bounds: np.ndarray, width: int) -> Index:
        n = len(ids)
        h = _key_hash(ids, cls.times(ids, valid))
        buckets = max(1, n // 4)
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=buckets)
        start = np.cumsum(size) - size
        displacement = np.zeros(buckets, np.int32)
        ordinal = np.full(n, -1, np.int64)
        by_size = np.argsort(-size, kind="stable")
        for b in by_size[: int((size > 1).sum())].tolist():
            own = order[start[b] : start[b] + size[b]]
            d, width_tried = 0, 32
            while True:  # many displacements at a time, more of them as free slots grow rare
                slots = _slot(h[own], np.arange(d, d + width_tried)[:, None], n)
                fits = np.flatnonzero((ordinal[slots] < 0).all(axis=1)).tolist()
                if first := [i for i in fits if len(set(slots[i].tolist())) == len(own)][:1]:
                    d, at = d + first[0], slots[first[0]]
                    break
                d, width_tried = d + width_tried, min(2 * width_tried, 4096)
            displacement[b] = d
            ordinal[at] = own
        alone = by_size[int((size > 1).sum()) : int((size > 0).sum())]
        free = np.flatnonzero(ordinal < 0)
        displacement[alone] = -1 - free
        ordinal[free] = order[start[alone]]
        return cls(ids, valid, bounds, displacement, ordinal.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)[ordinal], width)

    def find(self, ids: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Ordinal of each key, -1 where the fingerprint says that the block has no such key."""
        n = len(self.ids)
        if not n:
            return np.full(len(ids), -1)
        h = _key_hash(ids, times)
        d = self.displacement[(h % np.uint64(len(self.displacement))).astype(np.int64)]
        slot = np.where(d < 0, -1 - d, _slot(h, np.maximum(d, 0), n))
        same = self.fingerprint[slot] == (h >> np.uint64(32)).astype(np.uint32)
        return np.where(same, self.ordinal[slot].astype(np.int64), -1)

    def to_bytes(self) -> bytes:
        head = np.array([MAGIC, len(self.ids), len(self.displacement), self.width], "<i8")
        parts = (head, self.ids.astype("<i8"), self.bounds.astype("<i8"), self.displacement.astype("<i4"), self.ordinal.astype("<u4"), self.fingerprint.astype("<u4"), self.valid.astype("u1"))
        return b"".join(x.tobytes() for x in parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Index:
        magic, n, m, width = np.frombuffer(raw, "<i8", 4).tolist()
        if magic != MAGIC:
            raise ValueError("not a token block index")
        at, out = 32, []
        for kind, count in (("<i8", n), ("<i8", n + 1), ("<i4", m), ("<u4", n), ("<u4", n), ("u1", n)):
            out.append(np.frombuffer(raw, kind, count, at))
            at += out[-1].nbytes
        ids, bounds, displacement, ordinal, fingerprint, valid = out
        return cls(ids.astype(np.int64), valid.astype(bool), bounds, displacement, ordinal, fingerprint, width)


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, order: list[Column] | None = None, block_tokens: int = 1 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the shard table of docs to path and returns it as read back.

    Documents stand in ascending doc_id order, or in that of the columns in
    `order`.  A null text is empty and has the end id only; a null doc_id sorts
    first and is kept, but is in no directory; repeated ids are kept, each with
    its own ids.  An empty table gives empty tables.
    """
    spark = docs.sparkSession
    keys = order or [F.col(doc_id).cast("long")]
    read = docs.select(*(k.alias(f"_{i}") for i, k in enumerate(keys)), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    names = [f"_{i}" for i in range(len(keys))]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = read.repartitionByRange(parts, *names).sortWithinPartitions(*names, "doc_id").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = _encoder(tokenizer), TaskContext.get().partitionId()
        width = encoder.dtype.itemsize
        ids: list[int | None] = []
        raw: list[bytes] = []
        size = block = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, raw, size, block
            keys, rows = ids, raw
            if None in ids or any(a > b for a, b in zip(ids, ids[1:])):  # equal keys must be neighbours in the index only
                by = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, i))
                keys, rows = [ids[i] for i in by], [raw[i] for i in by]
                place = np.empty(len(by), np.int64)
                place[by] = np.arange(len(by))
            else:
                place = np.arange(len(ids))
            lengths = np.array([len(x) // width for x in rows], np.int64)
            bounds = np.concatenate(([0], np.cumsum(lengths)))
            valid = np.array([k is not None for k in keys])
            index = Index.build(np.array([k or 0 for k in keys], np.int64), valid, bounds, width)
            out = {"shard": [shard], "block": [block], "n_docs": [len(keys)], "n_tokens": [int(bounds[-1])], "index": [index.to_bytes()], "place": [place.astype("<u4").tobytes()], "payload": [b"".join(rows)]}
            ids, raw, size, block = [], [], 0, block + 1
            return pa.RecordBatch.from_pydict(out, pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("index", pa.binary()), ("place", pa.binary()), ("payload", pa.binary())]))

        for batch in batches:
            column = batch.column(1)
            sums = np.concatenate(([0], np.cumsum(pc.binary_length(column).to_numpy())))
            lo = 0
            while lo < batch.num_rows:
                most = int(np.searchsorted(sums, sums[lo] + ENCODED_BYTES, "right")) - 1
                hi = max(lo + 1, min(most, lo + ENCODED_ROWS))
                found, begin = encoder.encode(column.slice(lo, hi - lo), end_id)
                keys, begin = batch.column(0).slice(lo, hi - lo).to_pylist(), begin.tolist()
                for i, a, b in zip(keys, begin, begin[1:], strict=False):
                    if ids and (size + b - a) // width > block_tokens:
                        yield flush()
                    ids.append(i)
                    raw.append(found[a:b].to_pybytes())
                    size += b - a
                lo = hi
        if ids:
            yield flush()

    blocks = dealt.mapInArrow(run, "shard int, block int, n_docs long, n_tokens long, index binary, place binary, payload binary")
    blocks.write.option("compression", "zstd").parquet(f"{path}/blocks")
    tokens = read_tokens(spark, path)
    _write_directory(tokens, f"{path}/directory")
    return tokens


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/blocks")


def _bucket(key: Column, buckets: Column | int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets) if isinstance(buckets, int) else buckets)


def _write_directory(tokens: DataFrame, path: str) -> None:
    """Writes the directory of a block table: of each bucket of keys, an index whose ordinals are places in a list of (shard, block)."""
    buckets = 1 + (tokens.agg(F.sum("n_docs")).first()[0] or 0) // BUCKET_KEYS

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, block, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                index = Index.from_bytes(raw)
                ids = np.unique(index.ids[index.valid])
                yield pa.RecordBatch.from_pydict({"key": pa.array(ids), "at": pa.array(np.full(len(ids), shard << 32 | block, np.int64))})

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def one() -> pa.RecordBatch:
            bucket, key, at = held[0][0], *(np.concatenate(x) for x in list(zip(*held, strict=True))[1:])
            index = Index.build(key, np.ones(len(key), bool), np.arange(len(key) + 1), 8)
            return pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int64()), "buckets": pa.array([buckets], pa.int64()), "index": pa.array([index.to_bytes()], pa.binary()), "places": pa.array([at.astype("<i8").tobytes()], pa.binary())})

        for batch in batches:
            of, key, at = (c.to_numpy() for c in batch.columns)
            cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
            for b, k, p in zip(np.split(of, cuts), np.split(key, cuts), np.split(at, cuts), strict=True):
                if len(b):
                    if held and held[0][0] != b[0]:
                        yield one()
                        held = []
                    held.append((int(b[0]), k, p))
        if held:
            yield one()

    rows = tokens.select("shard", "block", "index").mapInArrow(keys, "key long, at long").select(_bucket(F.col("key"), buckets).alias("bucket"), "key", "at")
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "key", "at")
    rows.mapInArrow(build, "bucket long, buckets long, index binary, places binary").write.parquet(path)


def documents_of(tokens: DataFrame) -> DataFrame:
    """One row per document of a shard table: doc_id, start, n_tokens, ids_crc32, shard, block.

    start counts the ids of all documents before it.  Every document is fetched
    by its key through the index; one that the index does not lead to is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                index = Index.from_bytes(row["index"])
                ids = np.frombuffer(row["payload"], f"<u{index.width}").astype("<u4")
                place = np.frombuffer(row["place"], "<u4")
                at = index.find(index.ids, Index.times(index.ids, index.valid))
                if (at != np.arange(len(at))).any():
                    raise ValueError("the index does not lead to every document of its block")
                low, high = index.bounds[at], index.bounds[at + 1]
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
                n = high - low
                before = np.empty(len(n), np.int64)  # in the order in which the documents came
                came = place.astype(np.int64)  # place[i]: ordinal of the i-th document to come
                lengths = n[came]
                before[came] = np.cumsum(lengths) - lengths
                k = len(n)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(index.ids, pa.int64(), mask=~index.valid), "inside": pa.array(before), "n_tokens": pa.array(n), "ids_crc32": pa.array(crc, pa.int64()), "shard": pa.array(np.full(k, row["shard"]), pa.int32()), "block": pa.array(np.full(k, row["block"]), pa.int32())})

    docs = tokens.select("shard", "block", "index", "place", "payload").mapInArrow(run, "doc_id long, inside long, n_tokens long, ids_crc32 long, shard int, block int")
    sizes = tokens.select("shard", "block", "n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # as many rows as shards
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    in_shard = Window.partitionBy("shard").orderBy("block")
    blocks = sizes.select("shard", "block", (F.sum("n_tokens").over(in_shard) - F.col("n_tokens")).alias("skip")).join(shards, "shard")
    return docs.join(blocks, ["shard", "block"]).select("doc_id", (F.col("base") + F.col("skip") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "shard", "block")


def lookup(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """Ids of the documents with this id: one bucket of the directory is read, then the blocks to which it leads."""
    here = _bucket(F.lit(doc_id).cast("long"), F.col("buckets"))
    rows = spark.read.parquet(f"{path}/directory").where(F.col("bucket") == here).collect()  # one bucket or none
    places: set[int] = set()
    for row in rows:
        index, t = Index.from_bytes(bytes(row["index"])), 0
        while (at := int(index.find(np.array([doc_id]), np.array([t]))[0])) >= 0 and index.ids[at] == doc_id:
            places.add(int(np.frombuffer(row.places, "<i8")[at]))
            t += 1
    if not places:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                index, t = Index.from_bytes(row["index"]), 0
                while (at := int(index.find(np.array([doc_id]), np.array([t]))[0])) >= 0 and index.valid[at] and index.ids[at] == doc_id:
                    ids = np.frombuffer(row["payload"], f"<u{index.width}")[index.bounds[at] : index.bounds[at + 1]]
                    yield pa.RecordBatch.from_pydict({"ids": pa.array([ids.astype(np.int64).tolist()])})
                    t += 1

    wanted = functools.reduce(lambda a, b: a | b, ((F.col("shard") == p >> 32) & (F.col("block") == (p & 0xFFFFFFFF)) for p in sorted(places)))
    found = read_tokens(spark, path).where(wanted).select("index", "payload").mapInArrow(run, "ids array<long>")
    return [r.ids for r in found.collect()]


def tokenized(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes docs' shard table to a new folder and returns documents_of what is read back."""
    return documents_of(write_tokens(docs, tokenizer, new_path(docs.sparkSession, "tokens"), **options))

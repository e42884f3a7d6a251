"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact intersection.

Documents are sets of word shingles.  The join is lossless:

1. Equal sets become one class (key: 64-bit hash of the set).
2. Two sets with Jaccard >= t share a shingle within the first
   n - ceil(t*n) + 1 shingles of each under any common order.  The order used
   puts rare shingles first, after counts over all documents in a table of
   2^18 cells, so that common passages and lines fall out of most prefixes.
3. All classes that hold one prefix shingle join the group of its smallest
   class.  Groups are cut by size into tiles, and only pairs of tiles whose
   size bands can reach t are compared: first by bitmaps, whose bit counts
   bound the overlap from above, then by intersecting the sorted arrays.
4. A task that compares a pair of tiles reports a spanning forest of the links
   it finds, never all pairs, and skips pairs that are connected already.
5. Components of the links give the result.

No step gathers a group in one task or on the driver: tiles have at most
`tile` members and are numbered by ranks within small ranges of sizes and keys;
shingles that many documents may have in their prefixes are dealt out in parts;
the only table on the driver is that of the cells, whose size is fixed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textbytes as tb
from .shared import spare, stored, texts

CELL_BITS = 18
BITMAP_BITS = (10, 18)  # as powers of two; two bits a shingle between these
FILTER_BITS = 24
HOT_PARTS = 64
RANK_BITS = 10  # ranges of keys by which members of a group of one size are ranked
TYPICAL = 400  # shingles of a member that takes one of a tile's places; a larger one takes as many more


def _cells(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _set_key(x: np.ndarray) -> int:
    """64-bit hash of a set of shingles, as a signed integer."""
    both = tb.mix(np.array([x.sum(dtype=np.uint64), np.bitwise_xor.reduce(tb.mix(x + np.uint64(7))), len(x)], np.uint64) * tb.SHINGLE_CODES[:3])
    return int(tb.mix(both.sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0])


def _bitmap(x: np.ndarray) -> bytes:
    width = 1 << min(max(int(2 * len(x) - 1).bit_length(), BITMAP_BITS[0]), BITMAP_BITS[1]) if len(x) else 1 << BITMAP_BITS[0]
    bits = np.zeros(width, np.uint8)
    bits[(x & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _sets_and_cells(docs: DataFrame, width: int) -> DataFrame:
    """Rows kind 0: each document with its text's hash and its set's size, key and bitmap; kind 1: counts of shingles by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            n, key, bitmap = [], [], []
            for s in tb.slices(batch.column(1)):
                sets = tb.shingle_sets(s, width)
                counts += np.bincount(_cells(np.concatenate(sets)), minlength=1 << CELL_BITS)
                n += map(len, sets)
                key += map(_set_key, sets)
                bitmap += map(_bitmap, sets)
            kind = pa.array(np.zeros(len(n), np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(bitmap, pa.binary()), kind], names=names)
        used = np.flatnonzero(counts)
        zero = pa.array(np.zeros(len(used), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(used), zero, pa.array(counts[used]), zero, pa.nulls(len(used), pa.binary()), pa.array(np.ones(len(used), np.int32))], names=names)

    names = ["doc_id", "hash", "n", "key", "bitmap", "kind"]
    return docs.mapInArrow(run, "doc_id long, hash long, n long, key long, bitmap binary, kind int")


def _cell_counts(cells: DataFrame) -> np.ndarray:
    table = np.zeros(1 << CELL_BITS, np.int64)
    found = cells.toPandas()  # as many rows as cells
    table[found["cell"].to_numpy()] = found["count"].to_numpy()
    return table


def _prefixes(docs: DataFrame, table: np.ndarray, width: int, percent: int, hot_rows: int) -> DataFrame:
    """Rows (token, n, key): each class with its prefix shingles; and hot, where there are cells of hot_rows occurrences: 1 for their shingles."""
    any_hot = bool((table >= hot_rows).any())
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = shared.value, set()
        for batch in batches:
            for s in tb.slices(batch.column(0)):
                token, n, key, hot = [], [], [], []
                for x in tb.shingle_sets(s, width):
                    k = _set_key(x)
                    if not len(x) or k in seen:  # a task tells of a class once
                        continue
                    seen.add(k)
                    size = len(x) - -(-percent * len(x) // 100) + 1
                    c = order[_cells(x)]
                    if size < len(x):
                        near = np.flatnonzero(c <= np.partition(c, size - 1)[size - 1])
                        x = x[near[np.argsort(c[near], kind="stable")[:size]]]
                    token.append(x)
                    n.append(np.full(len(x), len(c)))
                    key.append(np.full(len(x), k))
                    hot.append((order[_cells(x)] >= hot_rows).astype(np.int32))
                if token:
                    columns = (token, n, key, hot) if any_hot else (token, n, key)
                    columns = [np.concatenate(c) for c in columns]
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0].view(np.int64)), *map(pa.array, columns[1:])], names=["token", "n", "key", "hot"][: len(columns)])

    return docs.select("text").mapInArrow(run, "token long, n long, key long" + ", hot int" * any_hot)


def _groups(prefixes: DataFrame) -> DataFrame:
    """Rows (lead, n, key): each class in the groups of the smallest classes with which it shares a prefix shingle.

    Shingles of cells with many occurrences are kept apart: their smallest
    classes are found by sums before the shuffle, and their rows dealt in parts.
    """

    def joined(rows: DataFrame) -> DataFrame:
        return rows.where("least != most").groupBy(F.col("least.key").alias("lead"), "n", "key").agg(F.lit(1).alias("one")).drop("one")

    of_token = Window.partitionBy("token")
    own = F.struct("n", "key")
    if "hot" not in prefixes.columns:
        return joined(prefixes.withColumns({"least": F.min(own).over(of_token), "most": F.max(own).over(of_token)}))
    prefixes = stored(prefixes, "prefixes", partition_by="hot")
    hot = prefixes.where("hot = 1").drop("hot")
    ends = hot.groupBy("token").agg(F.min(own).alias("least"), F.max(own).alias("most"))
    ends = ends.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(HOT_PARTS - 1).cast("long"))))
    hot = hot.withColumn("part", F.pmod("key", F.lit(HOT_PARTS))).join(ends, ["token", "part"])
    return _groups(prefixes.where("hot = 0").drop("hot")).unionByName(joined(hot))


def _by_group(df: DataFrame, keys: list[str], one: Callable[[dict[str, np.ndarray | list]], dict | None], schema: str) -> DataFrame:
    """Applies `one` to each group of bounded size; groups share tasks, and each is seen whole.

    Rows are dealt by the keys and sorted, so that a task walks over many small
    groups with no cost per group but the function's own.
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def groups(t: pa.Table, last: bool) -> Iterator[pa.Table]:
            nonlocal rest
            cols = [t.column(k).to_numpy() for k in keys]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            edges = [0, *cuts.tolist(), t.num_rows]
            stop = len(edges) - 1 if last else len(edges) - 2
            for a, b in zip(edges[:stop], edges[1 : stop + 1], strict=True):
                yield t.slice(a, b - a)
            rest = None if last else t.slice(edges[-2])

        def results(t: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            parts = [x for g in groups(t.combine_chunks(), last) if (x := one({c: g.column(c) for c in names}))]
            if parts:
                yield pa.RecordBatch.from_pydict({c: np.concatenate([p[c] for p in parts]) for c in parts[0]})

        for batch in batches:
            if batch.num_rows:
                t = pa.Table.from_batches([batch])
                yield from results(pa.concat_tables([rest, t]) if rest is not None else t, False)
        if rest is not None:
            yield from results(rest, True)

    return df.repartition(*keys).sortWithinPartitions(*keys, "n", "key").mapInArrow(run, schema)


def _tile_pairs(groups: DataFrame, tile: int, percent: int) -> DataFrame:
    """Rows (lead, i, j, n, key): the members of each pair of tiles whose size bands can reach the threshold."""
    of_cell = ["lead", "n", "range"]
    members = groups.withColumn("range", F.shiftright("key", 64 - RANK_BITS))  # ascends with the key
    sizes = members.groupBy(*of_cell).agg(F.count("*").alias("m"))
    # a member's share of a tile, so that tiles of long documents take no more memory than others
    share = F.greatest(F.col("n"), F.lit(TYPICAL))
    sizes = sizes.withColumn("m", F.col("m") * share)
    before = F.sum("m").over(Window.partitionBy("lead").orderBy("n", "range")) - F.col("m")
    ranked = members.withColumn("rank", F.row_number().over(Window.partitionBy(*of_cell).orderBy("key")) - 1)
    tiled = ranked.join(sizes.select(*of_cell, before.alias("before")), of_cell)
    tiled = stored(tiled.select("lead", "n", "key", F.floor((F.col("before") + F.col("rank") * share) / (tile * TYPICAL)).cast("long").alias("i")), "tiles")
    bands = tiled.groupBy("lead", "i").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("m"))
    other = bands.select("lead", F.col("i").alias("j"), F.col("low").alias("low_j"), F.col("m").alias("m_j"))
    pairs = bands.join(other, "lead").where((F.col("i") <= F.col("j")) & (100 * F.col("high") >= percent * F.col("low_j")) & ((F.col("i") != F.col("j")) | (F.col("m") > 1)))
    sides = pairs.select("lead", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("of"))
    return sides.join(tiled.withColumnRenamed("i", "of"), ["lead", "of"]).select("lead", "i", "j", "n", "key")


class _Reach:
    """Which members of a group, sorted by size, the sizes and bitmaps let reach the threshold with a given one."""

    def __init__(self, n: np.ndarray, bitmaps: list[bytes], percent: int):
        self.n, self.percent = n, percent
        self.width = np.array([len(x) for x in bitmaps])  # grows with n
        self.folded = {}
        for w in np.unique(self.width).tolist():
            from_ = int(np.searchsorted(self.width, w))
            rows = [np.bitwise_or.reduce(np.frombuffer(x, np.uint64).reshape(-1, w // 8), axis=0) for x in bitmaps[from_:]]
            self.folded[w] = (from_, np.array(rows))

    def of(self, a: int) -> np.ndarray:
        n, percent = self.n, self.percent
        stop = int(np.searchsorted(n, n[a] * 100 // percent, "right"))
        from_, bits = self.folded[int(self.width[a])]
        mine, rest = bits[a - from_], bits[a + 1 - from_ : stop - from_]
        only_a = np.bitwise_count(mine & ~rest).sum(axis=1, dtype=np.int64)
        only_b = np.bitwise_count(~mine & rest).sum(axis=1, dtype=np.int64)
        most = np.minimum(n[a] - only_a, n[a + 1 : stop] - only_b)
        return a + 1 + np.flatnonzero((100 + percent) * most >= percent * (n[a] + n[a + 1 : stop]))


def _members_in_reach(percent: int) -> Callable[[dict], dict | None]:
    def one(g: dict) -> dict | None:
        n = g["n"].to_numpy()
        reach = _Reach(n, g["bitmap"].to_pylist(), percent)
        hit = np.zeros(len(n), bool)
        for a in range(len(n) - 1):
            if len(found := reach.of(a)):
                hit[a] = hit[found] = True
        if not hit.any():
            return None
        return {c: g[c].to_numpy()[hit] for c in ("lead", "i", "j", "n", "key")}

    return one


def _forest(percent: int) -> Callable[[dict], dict | None]:
    def one(g: dict) -> dict | None:
        n, key = g["n"].to_numpy(), g["key"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in g["shingles"].to_pylist()]
        reach = _Reach(n, [_bitmap(x) for x in sets], percent)
        root = np.arange(len(n))
        links = []
        for a in range(len(n) - 1):
            for b in reach.of(a).tolist():
                if root[a] == root[b]:
                    continue
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if 100 * both >= percent * (n[a] + n[b] - both):
                    root[root == root[b]] = root[a]
                    links.append((key[a], key[b]))
        if not links:
            return None
        return dict(zip(("a", "b"), np.array(links).T, strict=True))

    return one


def components(links: DataFrame, a: str = "a", b: str = "b", name: str = "links") -> DataFrame:
    """Rows (node, root) of all nodes of the links; root is the smallest node of the component.

    Alternates the large-star and small-star steps until nothing changes; each
    round is written to the shared folder.  Self-links and nulls are ignored.
    """
    edges = stored(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), name)
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        edges = stored(small, name)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now


def _linked(docs: DataFrame, percent: int, width: int, tile: int, hot_rows: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, hash, n, key) of the documents, hash being that of the text; and (key, root), a root for each set that is linked."""
    read = texts(docs, doc_id=doc_id, text=text).withColumn("hash", F.xxhash64("text"))
    kinds = stored(_sets_and_cells(read, width), "sets", partition_by="kind")
    rows = kinds.where("kind = 0").select("doc_id", "hash", "n", "key", "bitmap")
    cells = _cell_counts(kinds.where("kind = 1").groupBy(F.col("doc_id").alias("cell")).agg(F.sum("n").alias("count")))
    bitmaps = rows.where("n > 0").groupBy("key").agg(F.max("bitmap").alias("bitmap"))

    groups = stored(_groups(_prefixes(read, cells, width, percent, hot_rows)), "groups")
    pairs = _tile_pairs(groups, tile, percent).join(bitmaps, "key")
    reach = stored(_by_group(pairs.select("lead", "i", "j", "n", "key", "bitmap"), ["lead", "i", "j"], _members_in_reach(percent), "lead long, i long, j long, n long, key long"), "reach")

    wanted = reach.select("key").distinct()
    sets = _shingles_of(read, wanted, width)
    members = reach.join(sets, "key").select("lead", "i", "j", "n", "key", "shingles")
    links = _by_group(members, ["lead", "i", "j"], _forest(percent), "a long, b long")
    return rows.drop("bitmap"), components(links).select(F.col("node").alias("key"), "root")


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, tile: int = 1024, hot_rows: int = 1 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Two documents link when 100 * |intersection| >= percent * |union| of their
    sets of `width`-word shingles (words: lower-cased A-Z, cut at blanks; fewer
    words: the whole sequence).  component_id is the smallest doc_id reachable
    by links, itself included.  A null or empty text has an empty set and links
    with nothing: its component is its own id.  Repeated rows are equal sets
    and so linked.  A row with null doc_id takes part; its component_id is that
    of the others it reaches, or null.
    """
    rows, roots = _linked(docs, percent, width, tile, hot_rows, doc_id, text)
    classes = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    found = classes.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    found = stored(found.select("key", "root", "doc_id"), "classes")
    least = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_key = found.join(least, "root").select("key", "component_id")
    out = rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("key")).alias("key")).join(of_key, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _shingles_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Rows (key, shingles): one per wanted class.

    A bit table of fixed size, combined on the executors from the wanted keys,
    spares the shuffle most other classes; the join that follows is exact.
    """
    slot = F.pmod(F.col("key"), F.lit(1 << FILTER_BITS))
    words = wanted.groupBy((F.shiftright(slot, 6)).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(key, {1 << FILTER_BITS}) % 64 as int))")).alias("bits")).toPandas()
    table = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        for batch in batches:
            for s in tb.slices(batch.column(0)):
                key, shingles = [], []
                for x in tb.shingle_sets(s, width):
                    k = _set_key(x)
                    at = k % (1 << FILTER_BITS)
                    if len(x) and k not in seen and int(bits[at >> 6]) >> (at & 63) & 1:
                        seen.add(k)
                        key.append(k)
                        shingles.append(x.tobytes())
                if key:
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(shingles, pa.binary())], names=["key", "shingles"])

    found = docs.select("text").mapInArrow(run, "key long, shingles binary").join(wanted, "key")
    return found.groupBy("key").agg(F.first("shingles").alias("shingles"))


def distinct_documents(docs: DataFrame, percent: int = 80, width: int = 5, tile: int = 1024, hot_rows: int = 1 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, with one row left of each group of near duplicates.

    Groups are those of the texts, whatever ids repeat: of each, the row with
    the smallest id stays; rows without an id come last; among equal ids, the
    text of the smallest hash; among rows that repeat an id and its text, the
    one whose other columns hash smallest.  Rows without words are in no group
    and all stay.  An empty table stays empty.
    """
    rows, roots = _linked(docs, percent, width, tile, hot_rows, doc_id, text)
    times = rows.where("n > 0").groupBy("doc_id", "hash", "key").agg(F.count("*").alias("times"))
    found = stored(times.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), "documents")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash")).alias("first"))
    marked = found.join(first, "root").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("hash") == F.col("first.hash")))
    id_, hash_, stays = spare(docs, "of_id", "of_hash", "stays")
    changed = stored(marked.where("not stays or times > 1").select(F.col("doc_id").alias(id_), F.col("hash").alias(hash_), F.col("stays").alias(stays)), "changed")
    at, own = F.col(f"`{doc_id}`").cast("long"), F.xxhash64(F.col(f"`{text}`").cast("string").cast("binary"))
    same = at.eqNullSafe(F.col(id_)) & (own == F.col(hash_))
    # these rows grow with the documents, so they are never broadcast, at no size
    out = docs.join(changed.hint("merge"), same, "left_anti")
    again = changed.where(stays)
    if again.isEmpty():
        return out
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    repeated = docs.join(again, same, "left_semi").groupBy(at.alias(id_), own.alias(hash_)).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("row"))
    return out.unionByName(repeated.select("row.*"))

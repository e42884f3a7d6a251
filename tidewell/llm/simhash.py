"""SimHash near duplicates by anchor points of a covering code.

A document's fingerprint has 64 bits, each the majority of that bit over the
XXH64 values of its word shingles.  Fingerprints at most `distance` apart link.

Candidates meet at anchors.  Two parts of 23 bits each are read as words of the
binary Golay code: it is perfect, so that every word of 23 bits has exactly one
code word, its home, within the covering radius of 3.  An anchor is a pair of
code words.  A fingerprint goes to every anchor within covering radius plus
distance: for parts that differ in d1 and d2 bits, the home of one fingerprint
is within 3 + d1 and 3 + d2 of the other's parts, and d1 + d2 is at most the
distance, so one meets the other at its home, whatever the other 18 bits are.
That is 61 places on average at a distance of 2, among 2^24 anchors.  At an
anchor, those at home are compared with all that came, on all 64 bits.

Equal fingerprints are one before that, so copies cost nothing.  An anchor that
is home to very many is dealt out in parts by a table of fixed size; each part
takes some of those at home.  A task tells of a forest of the links it finds,
never of all pairs, and components of the links give the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .neardup import components
from .shared import stored, texts

SEED = 42
BITS = 64
PART = 23  # length of the code's words
RADIUS = 3  # its covering radius
MESSAGE = 12  # bits of a word that name a code word
# Fixed value: the generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
HASHES_AT_ONCE = 1 << 16
PAIRS_AT_ONCE = 1 << 21
CELL_BITS = 20  # anchors are counted in 2^20 cells to find those that are home to many
HOME_ROWS = 1 << 15


# --- fingerprints -------------------------------------------------------------


def _spaced(s: tb.Slice, w: tb.Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The slice's words with one space after each, and where they start and end there."""
    inside = tb.SPACE_WORDS[s.data]
    length = w.end - w.start
    start = np.cumsum(length + 1) - length - 1
    out = np.full(int(length.sum()) + len(length), 0x20, np.uint8)
    out[np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)] = s.data[inside]
    return out.tobytes(), start, start + length


def _majorities(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Per row the 64 bits that are set in over half of its hashes; row ascends; 0 for a row without hashes."""
    votes = np.zeros((rows, BITS), np.int64)
    for at in range(0, len(h), HASHES_AT_ONCE):
        some, of = h[at : at + HASHES_AT_ONCE], row[at : at + HASHES_AT_ONCE]
        bits = np.unpackbits(some.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        votes[of[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    n = np.bincount(row, minlength=rows)
    return np.packbits(2 * votes > n[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints_of(column: pa.Array, width: int = 3) -> np.ndarray:
    """Unsigned fingerprint of each text of a binary column."""
    out = []
    for s in tb.slices(column):
        w = tb.words(s, tb.SPACE_WORDS, hashed=False)
        data, start, end = _spaced(s, w)
        n = np.diff(w.first)
        shingles = np.where(n >= width, n - width + 1, np.minimum(n, 1))
        row = np.repeat(np.arange(len(n)), shingles)
        low = w.first[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
        high = low + np.minimum(n, width)[row] - 1
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(data[a:b], SEED) for a, b in zip(start[low].tolist(), end[high].tolist(), strict=True)), np.uint64, len(row))
        out.append(_majorities(h, row, len(n)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def fingerprints(docs: DataFrame, width: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, bits: each row's fingerprint as a signed long with the same 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = fingerprints_of(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], names=["doc_id", "bits"])

    return texts(docs, doc_id=doc_id, text=text).mapInArrow(run, "doc_id long, bits long")


# --- anchors --------------------------------------------------------------------


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words, as polynomials, by the generator; the same for words that differ by a code word."""
    rest = words.astype(np.int64)
    for bit in range(PART - 1, PART - MESSAGE - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ GENERATOR << bit - (PART - MESSAGE), rest)
    return rest


class Cover:
    """The code words within radius plus distance of any word, by the word's syndrome."""

    def __init__(self, distance: int):
        one = [1 << i for i in range(PART)]
        errors, weight = [np.zeros(1, np.int64)], [0]
        for w in range(1, min(RADIUS + distance, PART) + 1):
            last = errors[-1]  # patterns of w - 1 bits, each to be given a bit above its highest
            errors.append(np.concatenate([last[last < bit] | bit for bit in one]))
            weight.append(w)
        excess = np.repeat(np.maximum(np.array(weight) - RADIUS, 0), [len(e) for e in errors])
        self.errors = np.concatenate(errors)
        syndrome = _syndromes(self.errors)
        order = np.lexsort((excess, syndrome))
        self.errors, excess, syndrome = self.errors[order], excess[order], syndrome[order]
        self.first = np.searchsorted(syndrome, np.arange(1 << PART - MESSAGE))
        #: upto[e + 1]: by syndrome, how many patterns have an excess of e or less; they come first
        self.upto = np.array([np.zeros(1 << PART - MESSAGE, np.int64)] + [np.bincount(syndrome[excess <= e], minlength=1 << PART - MESSAGE) for e in range(distance + 1)])

    def names(self, words: np.ndarray, pattern: np.ndarray) -> np.ndarray:
        """The 12 bits that name the code word at an error pattern of each word."""
        return (words ^ self.errors[pattern]) >> PART - MESSAGE


def anchors(bits: np.ndarray, cover: Cover, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(row, anchor, home): the anchors of fingerprints; home is True for those within the covering radius."""
    left, right = (bits & np.uint64((1 << PART) - 1)).astype(np.int64), (bits >> np.uint64(PART) & np.uint64((1 << PART) - 1)).astype(np.int64)
    s, t = _syndromes(left), _syndromes(right)
    for e in range(distance + 1):  # the excess of the left part, and at most what it leaves of the right
        here = cover.upto[e + 1][s] - cover.upto[e][s]
        there = cover.upto[distance - e + 1][t]
        row = np.repeat(np.arange(len(bits)), here * there)
        at = np.arange(len(row)) - np.repeat(np.cumsum(here * there) - here * there, here * there)
        i = cover.first[s[row]] + cover.upto[e][s[row]] + at // np.maximum(there[row], 1)
        j = at % np.maximum(there[row], 1)
        anchor = cover.names(left[row], i) << MESSAGE | cover.names(right[row], cover.first[t[row]] + j)
        if e:
            yield row, anchor, False
        else:
            home = j < cover.upto[1][t[row]]
            yield row[home], anchor[home], True
            yield row[~home], anchor[~home], False


def _cells(anchor: np.ndarray) -> np.ndarray:
    return (tb.mix(anchor.astype(np.uint64)) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _parts(distinct: DataFrame, cover: Cover, home_rows: int) -> np.ndarray:
    """In how many parts the anchors of each cell are dealt: one for every home_rows fingerprints at home there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            for _, anchor, home in anchors(batch.column(0).to_numpy().view(np.uint64), cover, 0):
                if home:
                    counts += np.bincount(_cells(anchor), minlength=1 << CELL_BITS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["cell", "n"])

    table = np.ones(1 << CELL_BITS, np.int32)
    many = distinct.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > home_rows)
    found = many.toPandas()  # at most a row for each of the 2^20 cells
    table[found["cell"].to_numpy(np.int64)] = -(-found["n"].to_numpy(np.int64) // home_rows)
    return table


def _sent(distinct: DataFrame, cover: Cover, distance: int, parts: np.ndarray) -> DataFrame:
    """Rows (place, bits): the fingerprints at their anchors; place is the anchor, then the part, then 0 for those at home."""
    shared = distinct.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(every), 4096):
                bits = every[at : at + 4096]
                for row, anchor, home in anchors(bits, cover, distance):
                    n = shared.value[_cells(anchor)].astype(np.int64)
                    mine = (tb.mix(bits[row]) % n.astype(np.uint64)).astype(np.int64)
                    place = (anchor << 32 | mine << 1) if home else None
                    # one at home in a part is also met, as a visitor, by those at home in the other parts
                    again = np.repeat(np.arange(len(row)), n)
                    part = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
                    if home:
                        again, part = again[part != mine[again]], part[part != mine[again]]
                    visits = anchor[again] << 32 | part << 1 | 1
                    places = visits if place is None else np.concatenate((place, visits))
                    rows = row[again] if place is None else np.concatenate((row, row[again]))
                    yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(bits[rows].view(np.int64))], names=["place", "bits"])

    return distinct.select("bits").mapInArrow(run, "place long, bits long")


def forest(group: np.ndarray, home: np.ndarray, bits: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links (row, row) that span, in each group, what its rows at home reach; rows come group by group, those at home first."""
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.concatenate((first, [len(group)])))
    start, stop = np.repeat(first, size), np.repeat(first + size, size)
    root = np.arange(len(group))
    links = []
    rows = np.flatnonzero(home & (stop - start > 1))
    cost = np.cumsum((stop - start)[rows])
    at = 0
    while at < len(rows):
        upto = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        mine = rows[at:upto]
        n = (stop - start)[mine]
        a = np.repeat(mine, n)
        b = start[a] + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        near = (np.bitwise_count(bits[a] ^ bits[b]) <= distance) & (a != b)
        a, b = a[near], b[near]
        for x, y in zip(*(np.split(v, np.flatnonzero(a[1:] != a[:-1]) + 1) for v in (a, b)), strict=True) if len(a) else ():
            i = int(x[0])
            others, at_first = np.unique(root[y], return_index=True)
            at_first, others = at_first[others != root[i]], others[others != root[i]]
            if len(others):
                links += [(i, int(j)) for j in y[at_first]]
                tree = root[start[i] : stop[i]]
                tree[np.isin(tree, others)] = root[i]
        at = upto
    return links


def _links(sent: DataFrame, distance: int) -> DataFrame:
    """Rows (a, b): a forest of the links at each anchor and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, bits = np.empty(0, np.int64), np.empty(0, np.int64)

        def found(place: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
            links = np.array(forest(place >> 1, place & 1 == 0, bits.view(np.uint64), distance), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(bits[links[:, 0]]), pa.array(bits[links[:, 1]])], names=["a", "b"])

        for batch in batches:
            place = np.concatenate((place, batch.column(0).to_numpy()))
            bits = np.concatenate((bits, batch.column(1).to_numpy()))
            whole = int(np.searchsorted(place, place[-1] >> 1 << 1)) if len(place) else 0
            if whole:
                yield found(place[:whole], bits[:whole])
                place, bits = place[whole:], bits[whole:]
        if len(place):
            yield found(place, bits)

    return sent.repartition(F.expr("shiftright(place, 1)")).sortWithinPartitions("place").mapInArrow(run, "a long, b long")


def simhash_duplicates(docs: DataFrame, distance: int = 2, width: int = 3, home_rows: int = HOME_ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Words are cut at blanks, A-Z lower-cased, and joined by single spaces into
    shingles of `width` words, repeats included; fewer words are one shingle; a
    null or empty text, or one of blanks, has the fingerprint zero, which links
    like any other.  Bits set in just half of the hashes are 0.  component_id is
    the smallest doc_id reachable by links of fingerprints that differ in
    `distance` bits or fewer.  Repeated rows have equal fingerprints and are
    linked.  A row with a null doc_id takes part; its component_id is that of
    the others it reaches, or null.  An empty table gives an empty one; other
    columns are not read.
    """
    if not 0 <= distance <= 4:
        raise ValueError("distance must be between 0 and 4")  # beyond it, a word's patterns meet those of other code words
    rows = stored(fingerprints(docs, width, doc_id, text), "fingerprints")
    distinct = stored(rows.groupBy("bits").agg(F.min("doc_id").alias("doc_id")), "distinct")
    cover = Cover(distance)
    parts = _parts(distinct.select("bits"), cover, home_rows)
    nodes = components(_links(_sent(distinct, cover, distance, parts), distance), name="simhash-links").withColumnsRenamed({"node": "bits"})
    found = stored(distinct.join(nodes, "bits", "left").withColumn("root", F.coalesce("root", "bits")), "classes")
    least = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_bits = found.join(least, "root").select("bits", "component_id")
    out = rows.join(of_bits, "bits", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")

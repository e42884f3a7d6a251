"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are put in a pseudo-random order and cut into blocks; a
slot of the mix takes one block.  With weights w and B blocks of each source,
the target is the fluid mix: at any time the sources that are not used up are
served in proportion to their weights, one block a slot in all.  Source i has
been served k blocks of it at the time t(k / w_i), where

    t(v) = sum over sources j of min(v * w_j, B_j),

so block k is released at slot floor(t(k / w_i)) and due at ceil(t((k + 1) /
w_i)).  Taking the released block with the earliest deadline in every slot
places every block within its window; so each source is less than one block
from its target after every slot, also when others have run out, and no
document is dropped or repeated.  Weights are taken exactly, as fractions.

Documents are ranked within (source, chunk of hashes) groups of bounded size
and moved up by the sums of the chunks before, so a source of any size is never
sorted in one task.  Counts by source reach the driver, where the slots of all
blocks are found; blocks have so many documents that there are at most
`most_slots` of them (a source has one at least).
"""

from __future__ import annotations

import bisect
import heapq
import json
import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import spare

CHUNK_ROWS = 512
SUPER = 1024
PLAN_BLOCKS = 1024  # blocks of a source in a row of the plan

Source = str | None


class Fluid:
    """The time at which the fluid mix has served k blocks of a source, in whole numbers of slots."""

    def __init__(self, blocks: dict[Source, int], weights: dict[Source, float]):
        exact = {s: Fraction(weights[s]) for s in blocks}
        if any(w <= 0 for w in exact.values()):
            raise ValueError("weights must be above 0")
        unit = math.lcm(*(w.denominator for w in exact.values()))
        self.weight = {s: int(w * unit) for s, w in exact.items()}
        ends = sorted((Fraction(blocks[s], self.weight[s]), blocks[s], self.weight[s]) for s in blocks)
        self.ends = [e for e, _, _ in ends]
        self.done, self.rate = [0], [sum(self.weight.values())]  # blocks of sources used up, and weight of the others
        for _, b, w in ends:
            self.done.append(self.done[-1] + b)
            self.rate.append(self.rate[-1] - w)

    def window(self, s: Source, k: int) -> tuple[int, int]:
        """Slot at which block k of s is released, and the one before which it is due."""
        w = self.weight[s]
        a, b = (bisect.bisect_right(self.ends, Fraction(x, w)) for x in (k, k + 1))
        return self.done[a] + k * self.rate[a] // w, self.done[b] - (-(k + 1) * self.rate[b] // w)


def schedule(blocks: dict[Source, int], weights: dict[Source, float]) -> list[Source]:
    """Sources by slot: of the released blocks, that with the earliest deadline; of equal ones, that of the smaller name, null first."""
    if not blocks:
        return []
    fluid = Fluid(blocks, weights)
    tie = {s: i for i, s in enumerate(sorted(blocks, key=lambda s: (s is not None, s or "")))}
    done, waiting, ready, out = dict.fromkeys(blocks, 0), [], [], []

    def await_next(s: Source) -> None:
        if done[s] < blocks[s]:
            release, due = fluid.window(s, done[s])
            heapq.heappush(waiting, (release, due, tie[s], s))

    for s in blocks:
        await_next(s)
    for slot in range(sum(blocks.values())):
        while waiting and waiting[0][0] <= slot:
            heapq.heappush(ready, heapq.heappop(waiting)[1:])
        *_, s = heapq.heappop(ready)
        out.append(s)
        done[s] += 1
        await_next(s)
    return out


def _plan(counts: dict[Source, int], weights: dict[Source, float], block_rows: int) -> list[dict]:
    """Rows (source, part, slots, starts): of each PLAN_BLOCKS blocks of a source, their slots and the positions of their first rows."""
    done, slots, starts, at = dict.fromkeys(counts, 0), {s: [] for s in counts}, {s: [] for s in counts}, 0
    for slot, s in enumerate(schedule({s: -(-n // block_rows) for s, n in counts.items()}, weights)):
        slots[s].append(slot)
        starts[s].append(at)
        at += min(block_rows, counts[s] - done[s] * block_rows)
        done[s] += 1
    return [{"source": s, "part": i // PLAN_BLOCKS, "slots": slots[s][i : i + PLAN_BLOCKS], "starts": starts[s][i : i + PLAN_BLOCKS]} for s in counts for i in range(0, len(slots[s]), PLAN_BLOCKS)]


def mixed(
    docs: DataFrame,
    weights: dict[Source, float] | None = None,
    power: float = 0.5,
    block_rows: int = 16,
    most_slots: int = 1 << 18,
    source: str = "source",
    by: tuple[str, ...] = ("doc_id",),
    seed: int = 0,
) -> DataFrame:
    """The rows of docs, all columns, and mix_block (within the source), mix_slot, mix_position (from 0).

    weights: target weight by source, above 0; without it, the weight of a
    source is its number of rows to the power `power`.  Sources without a given
    weight have the smallest given one.  A null source is a source of its own.
    Blocks have block_rows rows, or more where there would be over most_slots.
    Order within a source is that of a hash of the columns in `by` and then of
    all columns, so that rows of one id, or of none, are not kept together;
    rows equal in every column may stand in either order.  An empty table stays
    empty.  Where docs has a column of a new one's name, the new one gets
    underscores before it.
    """
    spark = docs.sparkSession
    named = F.col(f"`{source}`").cast("string")
    counts = {r.s: r.n for r in docs.groupBy(named.alias("s")).agg(F.count("*").alias("n")).collect()}  # a row for each source
    # never null, so that windows and joins by it share one partitioning
    key = F.coalesce(F.concat(F.lit("of "), named), F.lit("none"))
    block_rows = max(block_rows, -(-sum(counts.values()) // most_slots))
    if weights is None:
        weights = {s: n**power for s, n in counts.items()}
    least = min(weights.values(), default=1.0)
    plan = _plan(counts, {s: weights.get(s, least) for s in counts}, block_rows)
    # as many numbers as slots, twice: bounded by most_slots, so it may be broadcast
    schema = "array<struct<source:string,part:long,slots:array<long>,starts:array<long>>>"
    plans = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(plan)), schema)).alias("p")).select(F.coalesce(F.concat(F.lit("of "), F.col("p.source")), F.lit("none")).alias("p_source"), F.col("p.part").alias("p_part"), "p.slots", "p.starts")

    whole = [F.col(f"`{c}`") for c in docs.columns]
    own = [F.col(f"`{c}`") for c in by]
    chunks = max(1, max(counts.values(), default=0) // CHUNK_ROWS)

    def dealt(*more) -> DataFrame:
        first, then = F.xxhash64(F.lit(seed), *own), F.xxhash64(F.lit(seed), *(c.cast("string") for c in whole))
        rows = docs.select(key.alias("s"), first.alias("h"), then.alias("t"), *more)
        return rows.withColumn("c", F.pmod(F.xxhash64("h", "t"), F.lit(chunks)))

    sizes = dealt().groupBy("s", "c").agg(F.count("*").alias("n")).withColumn("big", F.floor(F.col("c") / SUPER))
    inner = F.sum("n").over(Window.partitionBy("s", "big").orderBy("c")) - F.col("n")
    bigs = sizes.groupBy("s", "big").agg(F.sum("n").alias("m"))
    bigs = bigs.select(F.col("s").alias("s2"), F.col("big").alias("b2"), (F.sum("m").over(Window.partitionBy("s").orderBy("big")) - F.col("m")).alias("outer"))
    skips = sizes.select("s", "c", "big", inner.alias("inner")).join(bigs, (F.col("s") == F.col("s2")) & (F.col("big") == F.col("b2")))
    skips = skips.select(F.col("s").alias("s3"), F.col("c").alias("c3"), (F.col("inner") + F.col("outer")).alias("skip"))

    place = F.row_number().over(Window.partitionBy("s", "c").orderBy("h", "t")) - 1
    ranked = dealt(F.struct(*whole).alias("row")).withColumn("inside", place).join(skips, (F.col("s") == F.col("s3")) & (F.col("c") == F.col("c3")))
    ranked = ranked.select("row", "s", (F.col("inside") + F.col("skip")).alias("rank")).withColumn("block", F.floor(F.col("rank") / block_rows).cast("long"))
    of_part = (F.col("s") == F.col("p_source")) & (F.floor(F.col("block") / PLAN_BLOCKS) == F.col("p_part"))
    out = ranked.join(F.broadcast(plans), of_part).withColumn("at", (F.col("block") % PLAN_BLOCKS + 1).cast("int"))
    new = [F.col("block"), F.element_at("slots", F.col("at")), F.element_at("starts", F.col("at")) + F.col("rank") % block_rows]
    names = spare(docs, "mix_block", "mix_slot", "mix_position")
    return out.select("row.*", *(c.alias(n) for c, n in zip(new, names, strict=True)))


def in_mix_order(docs: DataFrame, **options) -> DataFrame:
    """The rows and columns of docs, written out in the order of the mix: files by name, rows within files.

    All rows stay, whatever is null or repeated; see `mixed` for their order.
    """
    position = spare(docs, "mix_position")[0]
    out = mixed(docs, **options)
    # positions run from 0 without gaps, so ranges need no sample of the rows
    parts, rows = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(1, docs.count())
    part = F.floor(F.col(position) * parts / rows).cast("int")
    return out.repartitionById(parts, part).sortWithinPartitions(position).select(*(F.col(f"`{c}`") for c in docs.columns))

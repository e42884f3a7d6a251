"""Steps along undirected edges from many starts at once.

Each start is a bit, and a node carries one mask of the starts that have reached
it, so up to 64 searches share every join; more starts go in further batches.
The edges of a node with many of them lie in parts of about `part_edges`, and
only such a node's mask is sent to several tasks; masks that arrive at a node
are or-ed before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored

PART_EDGES = 4096


def _both_ways(edges: DataFrame) -> DataFrame:
    known = edges.select("a", "b").where("a is not null and b is not null")
    return known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def reach(directed: DataFrame, starts: DataFrame, k: int, part_edges: int = PART_EDGES) -> DataFrame:
    """node, batch, hop, mask: the starts (node, batch, mask) that first reach a node after `hop` steps a -> b, up to k.

    Every pair of a node and a start has one row, at its least hop.  Loops and
    repeated edges change nothing; a start without edges has its own row only.
    """
    parts = stored(directed.groupBy("a").agg(F.ceil(F.count("*") / part_edges).cast("int").alias("parts")), "parts")
    laid = directed.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), "b")
    laid = stored(laid, "edges")
    new = stored(starts.groupBy("node", "batch").agg(F.bit_or("mask").alias("mask")).select("node", "batch", F.lit(0).alias("hop"), "mask"), "frontier")
    seen = new
    for hop in range(1, k + 1):
        sent = new.join(parts, F.col("node") == F.col("a")).select("a", "batch", "mask", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        came = sent.join(laid, ["a", "part"]).groupBy(F.col("b").alias("node"), "batch").agg(F.bit_or("mask").alias("mask"))
        known = seen.groupBy("node", "batch").agg(F.bit_or("mask").alias("_known"))
        fresh = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("_known", F.lit(0).cast("long"))))
        new = came.join(known, ["node", "batch"], "left").select("node", "batch", F.lit(hop).alias("hop"), fresh.alias("mask")).where("mask <> 0")
        new = stored(new, "frontier")  # each hop is computed once
        seen = seen.unionByName(new)
    return seen


def _one_bit(starts: DataFrame) -> DataFrame:
    return starts.where("node is not null").select("node", F.lit(0).alias("batch"), F.lit(1).cast("long").alias("mask"))


def hops(edges: DataFrame, starts: DataFrame, k: int) -> DataFrame:
    """node, hop: nodes within k undirected steps of any of the starts, with the least number of steps."""
    return reach(_both_ways(edges), _one_bit(starts), k).select("node", "hop")


def labelled_hops(edges: DataFrame, labels: DataFrame, starts: DataFrame, k: int, allowed: Sequence[str], blocked: Sequence[str] = ()) -> DataFrame:
    """node, hop as `hops`, on steps to nodes (node, label) of the allowed labels only, and never on from blocked ones, which may be reached.

    A start may have any label and is left even if its label is blocked.
    """
    ok = labels.where(F.col("label").isin([*allowed, *blocked])).select(F.col("node").alias("b")).distinct()
    shut = labels.where(F.col("label").isin(list(blocked))).select(F.col("node").alias("a")).distinct()
    shut = shut.join(starts.select(F.col("node").alias("a")), "a", "left_anti")
    steps = _both_ways(edges).join(ok, "b", "left_semi").join(shut, "a", "left_anti").select("a", "b")
    return reach(steps, _one_bit(starts), k).select("node", "hop")


def hops_of_each(edges: DataFrame, nodes: Sequence, k: int) -> DataFrame:
    """start, node, hop: nodes within k undirected steps of each of the nodes given, by one search for all."""
    seen = reach(_both_ways(edges), _numbered(edges, nodes), k)
    bits = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("mask", i) == 1))
    each = seen.select("node", "hop", "batch", bits.alias("_i")).select("node", "hop", (F.col("batch") * 64 + F.col("_i")).alias("_i"))
    kind = edges.schema["a"].dataType
    names = F.array(*(F.lit(n).cast(kind) for n in dict.fromkeys(nodes)))
    return each.select(F.element_at(names, F.col("_i") + 1).alias("start"), "node", "hop")


def neighbourhoods(edges: DataFrame, nodes: Sequence, k: int) -> DataFrame:
    """node: those within k steps of every one of the nodes, the nodes themselves left out; one search for all of them."""
    distinct = list(dict.fromkeys(nodes))
    per = reach(_both_ways(edges), _numbered(edges, distinct), k).groupBy("node", "batch").agg(F.sum(F.bit_count("mask")).alias("n"))
    return per.groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") == len(distinct)).select("node").where(~F.col("node").isin(distinct))


def _numbered(edges: DataFrame, nodes: Sequence) -> DataFrame:
    kind = edges.schema["a"].dataType.simpleString()
    rows = [(n, i // 64, (1 << 63) - (1 << 64) if i % 64 == 63 else 1 << i % 64) for i, n in enumerate(dict.fromkeys(nodes))]
    return edges.sparkSession.createDataFrame(rows, f"node {kind}, batch int, mask long")

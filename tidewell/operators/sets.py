"""All pairs of token sets that are at least so similar, by prefixes of rare tokens.

Equal sets are one class, so copies are never paired.  A set's tokens stand in
order of how many classes hold them; two sets of a Jaccard of t share a token
among the first n - ceil(t n) + 1 of each, so a token that nearly every set has
is looked up for sets only that have nothing rarer.  Postings meet by token and
size, within the sizes that t allows, and pairs whose places in the two lists
leave too few tokens to come are dropped before the exact count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored


def _least(share: float, n: Column) -> Column:
    """The smallest whole number that is not below share * n."""
    return F.ceil(F.lit(share) * n - 1e-9).cast("int")


def classes(rows: DataFrame, id_: str, tokens: str) -> DataFrame:
    """id, class: the smallest id with the same set; null and empty sets are left out."""
    keyed = rows.select(F.col(id_).alias("id"), F.array_sort(F.array_distinct(F.array_compact(tokens))).alias("_s")).where(F.size("_s") > 0)
    keyed = keyed.withColumn("_h", F.sha2(F.to_json("_s"), 256))
    least = keyed.groupBy("_h").agg(F.min("id").alias("class"))
    return keyed.select("id", "_h").join(least, "_h").select("id", "class")


def similar_sets(rows: DataFrame, id_: str, tokens: str, threshold: float) -> DataFrame:
    """a, b, jaccard of all pairs of unlike sets, each named by the smallest id that has it, with a Jaccard of at least `threshold`; a < b.

    Null and empty sets are in no pair, null tokens are left out, and repeated
    rows and equal sets are one class (`classes` names their members).
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    plain = rows.select(F.col(id_).alias("id"), F.array_sort(F.array_distinct(F.array_compact(tokens))).alias("s")).where(F.size("s") > 0)
    sets = stored(plain.groupBy(F.sha2(F.to_json("s"), 256).alias("_h")).agg(F.min("id").alias("id"), F.first("s").alias("s")).drop("_h"), "sets")
    each = sets.select("id", F.explode("s").alias("t"))
    often = each.groupBy("t").agg(F.count("*").alias("n"))
    ordered = each.join(often, "t").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "t"))).alias("_s")).select("id", F.col("_s.t").alias("s"), F.size("_s").alias("n"))
    ordered = stored(ordered, "ordered")
    prefix = F.slice("s", 1, F.col("n") - _least(threshold, F.col("n")) + 1)
    postings = ordered.select("id", "n", F.posexplode(prefix).alias("at", "t"))
    a = postings.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("at").alias("ia"), "t", F.explode(F.sequence(_least(threshold, F.col("n")), F.col("n"))).alias("nb"))
    b = postings.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"), "t")
    met = a.join(b, ["t", "nb"]).where((F.col("nb") < F.col("na")) | (F.col("a") < F.col("b")))
    needed = _least(threshold / (1 + threshold), F.col("na") + F.col("nb"))
    possible = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) + F.least("ia", "ib") >= needed
    pairs = met.where(possible).select("a", "b").distinct()
    left = ordered.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    right = ordered.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("m", F.size(F.array_intersect("sa", "sb")))
    whole = F.size("sa") + F.size("sb") - F.col("m")
    found = both.where(F.col("m") >= F.lit(threshold) * whole - 1e-9)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("m") / whole).alias("jaccard"))

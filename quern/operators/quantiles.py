"""Exact percentiles of large groups, by counts over ranges of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import kept


def exact_percentiles(rows: DataFrame, key: str, name: str, nearest: bool = False, points: tuple[float, ...] = (0.5, 0.95), slots: int = 100) -> DataFrame:
    """One row a key: p50 and p95 (or other points) as percentiles() has them, without one task that holds all values of a key.

    Values are counted first. Approximate cuts part each key's distinct values into about equal slots, whose counts say in which slots the wanted
    ranks lie; only those few are sorted. The cuts decide nothing but the sizes of slots, so the result is exact. Nulls don't count; a key of nulls only has nulls.
    """
    counted = kept(rows.groupBy(F.col(key).alias("_k"), F.col(name).cast("double").alias("_v")).agg(F.count("*").alias("_c")))
    known = F.col("_v").isNotNull()
    cuts = kept(counted.groupBy("_k").agg(F.sum(F.when(known, F.col("_c"))).alias("_n"), F.approx_percentile("_v", [k / slots for k in range(1, slots)], 10_000).alias("_cuts")))
    own = cuts.select(F.col("_k").alias("_key"), "_cuts")
    placed = counted.where(known).join(own, F.col("_k").eqNullSafe(F.col("_key"))).select("_k", "_v", "_c", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_slot"))
    upto = Window.partitionBy("_k").orderBy("_slot")
    sums = placed.groupBy("_k", "_slot").agg(F.sum("_c").alias("_in")).withColumn("_to", F.sum("_in").over(upto))
    place = lambda p: F.lit(p) * F.col("_n") if nearest else F.lit(p) * (F.col("_n") - 1)
    low = lambda p: F.greatest(F.lit(1), F.ceil(place(p))) if nearest else F.floor(place(p)) + 1
    high = lambda p: low(p) if nearest else F.ceil(place(p)) + 1
    ranks = F.array(*[F.struct(F.lit(f"{end}{k}").alias("end"), at(p).cast("long").alias("rank")) for k, p in enumerate(points) for end, at in (("low", low), ("high", high))])
    wanted = cuts.select(F.col("_k").alias("_key"), F.explode(ranks).alias("_w"))
    goals = sums.join(wanted, F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_w.rank") > F.col("_to") - F.col("_in")) & (F.col("_w.rank") <= F.col("_to")))
    goals = goals.groupBy(F.col("_k").alias("_key"), F.col("_slot").alias("_at")).agg(F.first(F.col("_to") - F.col("_in")).alias("_before"), F.collect_list("_w").alias("_goals"))
    within = Window.partitionBy("_k", "_slot").orderBy("_v")
    inside = placed.join(goals, F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_slot") == F.col("_at"))).withColumn("_upto", F.col("_before") + F.sum("_c").over(within))
    met = inside.select("_k", "_v", F.explode(F.filter("_goals", lambda g: (g["rank"] <= F.col("_upto")) & (g["rank"] > F.col("_upto") - F.col("_c")))).alias("_g"))
    found = met.groupBy(F.col("_k").alias("_key")).agg(*[F.max(F.when(F.col("_g.end") == f"{end}{k}", F.col("_v"))).alias(f"_{end}{k}") for k in range(len(points)) for end in ("low", "high")])

    def value(k: int, p: float) -> Column:
        at, first, last = place(p), F.col(f"_low{k}"), F.col(f"_high{k}")
        between = F.when(first == last, first).otherwise((F.ceil(at) - at) * first + (at - F.floor(at)) * last)
        return F.round(first if nearest else between, 4).alias(f"p{round(100 * p)}")

    return cuts.join(found, F.col("_k").eqNullSafe(F.col("_key")), "left").select(F.col("_k").alias(key), *[value(k, p) for k, p in enumerate(points)])

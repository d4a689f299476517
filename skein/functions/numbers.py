"""Numeric helpers: rank shares, bins, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bround(c: Column, digits: int) -> Column:
    """Half-even rounding, negative digits included."""
    return F.bround(c, digits)


def wilson(successes: Column, n: Column, z: float = 1.96) -> Column:
    """struct<lo, hi>: Wilson interval of a share."""
    p = successes / n
    middle, half = (p + z * z / (2 * n)), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.struct(((middle - half) / (1 + z * z / n)).alias("lo"), ((middle + half) / (1 + z * z / n)).alias("hi"))


#: Ranges of values that a running total is cut into.
RANGES = 64


def with_total_before(counted: DataFrame, value: str, count: str, out: str) -> DataFrame:
    """counted, a row per distinct numeric value, with the sum of count over all smaller values.

    Values are cut into ranges at approximate quantiles; each range is summed by its own
    tasks, and only the totals of the ranges, at most RANGES rows, meet in one.
    """
    cuts = counted.agg(F.percentile_approx(value, [k / RANGES for k in range(1, RANGES)]).alias("cuts_"))
    ranged = counted.crossJoin(F.broadcast(cuts)).withColumn("range_", F.size(F.filter("cuts_", lambda x: x < F.col(value)))).drop("cuts_")
    totals = ranged.groupBy("range_").agg(F.sum(count).alias("sum_"))
    # one row a range
    offsets = totals.select(F.col("range_").alias("of_"), F.coalesce(F.sum("sum_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset_"))
    within = F.coalesce(F.sum(count).over(Window.partitionBy("range_").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summed = ranged.withColumn("within_", within).join(F.broadcast(offsets), F.col("range_") == F.col("of_"))
    return summed.withColumn(out, F.col("within_") + F.col("offset_")).drop("within_", "offset_", "range_", "of_")


def with_rank_share(df: DataFrame, value: str, out: str) -> DataFrame:
    """Average-tie rank over the number of non-null values, in (0, 1]; null gets 0.5.

    Ranks are worked out over the distinct values, by ranges, and come back by a join.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v_")).agg(F.count("*").alias("c_"))
    total = F.broadcast(counted.agg(F.sum("c_").alias("total_")))
    shares = with_total_before(counted, "v_", "c_", "before_").crossJoin(total).select("v_", ((F.col("before_") + (F.col("c_") + 1) / 2) / F.col("total_")).alias("share_"))
    joined = df.join(shares, df[value] == shares.v_, "left")
    return joined.withColumn(out, F.coalesce("share_", F.lit(0.5))).drop("v_", "share_")


def with_quantile_bin(df: DataFrame, value: str, out: str, bins: int = 5) -> DataFrame:
    """Right-closed bin between exact quantiles, equal edges merged; the smallest value is in bin 0.

    The edges are one row, joined to every row.
    """
    edges = df.agg(F.array_distinct(F.percentile(value, F.array(*[F.lit(k / bins) for k in range(bins + 1)]))).alias("edges_"))
    inner = F.slice("edges_", 2, F.greatest(F.size("edges_") - 2, F.lit(0)))
    binned = F.size(F.filter(inner, lambda e: e < F.col(value)))
    return df.crossJoin(F.broadcast(edges)).withColumn(out, F.when(F.col(value).isNotNull(), binned)).drop("edges_")

"""Lookups, fills, nearest and containment joins between tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_from_group(d: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Where any of the columns is null, all become the medians of the source's group (null if it has none)."""
    medians = source.na.drop(subset=keys).groupBy(*keys).agg(*[F.median(c).alias(f"{c}_m") for c in columns])
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    joined = d.join(medians, keys, "left").withColumn("missing_", missing)
    return reduce(lambda x, c: x.withColumn(c, F.when(F.col("missing_"), F.col(f"{c}_m")).otherwise(F.col(c))), columns, joined).drop("missing_", *[f"{c}_m" for c in columns])


def lookup(d: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """d with the table's value by key, or the default."""
    return d.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the groups that new brings, and new: a partition replace."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def by_priority(frames: list[DataFrame], key: str, order: str) -> DataFrame:
    """Union by name; of rows with one key, that of the first frame stays, then the least in order."""
    tagged = [f.withColumn("priority_", F.lit(k)) for k, f in enumerate(frames)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    w = Window.partitionBy(key).orderBy("priority_", order)
    return union.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_", "priority_")


def first_contained(text: Column, names: list[str], longest_first: bool = True, whole_word: bool = False) -> Column:
    """The first gazetteer name that a text contains; the names are a literal array, so nothing is joined."""
    ordered = sorted(names, key=lambda n: (-len(n), n)) if longest_first else names
    if whole_word:
        padded = F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
        return F.get(F.filter(F.array(*map(F.lit, ordered)), lambda n: F.contains(padded, F.concat(F.lit(" "), n, F.lit(" ")))), F.lit(0))
    return F.get(F.filter(F.array(*map(F.lit, ordered)), lambda n: F.contains(text, n)), F.lit(0))


def per_distinct(d: DataFrame, keys: list[str], work) -> DataFrame:
    """d joined null-safely with work(distinct keys): costly work once per distinct key."""
    done = work(d.select(*keys).distinct())
    renamed = reduce(lambda x, k: x.withColumnRenamed(k, f"{k}_k"), keys, done)
    on = reduce(lambda a, b: a & b, [d[k].eqNullSafe(renamed[f"{k}_k"]) for k in keys])
    return d.join(renamed, on, "left").drop(*[f"{k}_k" for k in keys])


def tolerance_pairs(d: DataFrame, id_col: str, keys: list[str], value: str, relative: float) -> DataFrame:
    """(a, b) with a < b of rows with equal keys whose values differ by at most a share of the larger.

    The value is dealt into logarithmic bins no narrower than the tolerance, and each
    row meets its own and the next bin only.
    """
    import math

    width = -math.log(1 - relative)
    rows = d.select(F.col(id_col).alias("id"), *keys, F.col(value).cast("double").alias("v")).where(F.col("v") > 0).withColumn("bin", F.floor(F.log("v") / width))
    left = rows.withColumn("bin", F.explode(F.array(F.col("bin"), F.col("bin") + 1)))
    a, b = left.alias("a"), rows.alias("b")
    f = lambda s, n: F.col(f"{s}.{n}")
    equal = reduce(lambda x, y: x & y, [f("a", k) == f("b", k) for k in [*keys, "bin"]])
    near = F.abs(f("a", "v") - f("b", "v")) <= relative * F.greatest(f("a", "v"), f("b", "v"))
    # a pair in neighbouring bins meets once, from the lower; in one bin from the smaller id
    once = F.when(F.floor(F.log(f("a", "v")) / width) == f("b", "bin"), f("a", "id") < f("b", "id")).otherwise(F.lit(True))
    pairs = a.join(b, equal).where(near & once & (f("a", "id") != f("b", "id")))
    return pairs.select(F.least(f("a", "id"), f("b", "id")).alias("a"), F.greatest(f("a", "id"), f("b", "id")).alias("b"))

"""Statistics over tables: outliers, folds, out-of-fold baselines, intervals, densities."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import with_total_before

# Labels of the outlier reasons, in the order in which they are listed.
PRICE_LOW, PRICE_HIGH, AREA_SMALL, AREA_LARGE, PER_M2 = "price_too_low", "price_too_high", "area_too_small", "area_too_large", "price_per_m2_outlier"


@dataclass
class OutlierBounds:
    price_min: float = 200_000
    price_max: float = 100_000_000
    area_min: float = 5.0
    area_max: float = 500.0
    iqr: float = 3.0
    min_group: int = 10


def flag_outliers(d: DataFrame, price: str, area: str, group: str, wider: str, b: OutlierBounds | None = None) -> DataFrame:
    """d with is_outlier and outlier_reason: absolute bounds, and price per area outside its group's fences.

    Groups under min_group rows take the wider group's fences; null keys form no
    group. Nothing is dropped.
    """
    b = b or OutlierBounds()
    rows = d.withColumn("ppm_", F.when(F.col(area) > 0, F.col(price) / F.col(area)))

    def fences(key: str, name: str) -> DataFrame:
        q1, q3 = F.percentile("ppm_", F.lit(0.25)), F.percentile("ppm_", F.lit(0.75))
        agg = rows.where(F.col(key).isNotNull() & F.col("ppm_").isNotNull()).groupBy(key).agg(F.count("*").alias("n_"), q1.alias("q1"), q3.alias("q3"))
        step = b.iqr * (F.col("q3") - F.col("q1"))
        return agg.select(key, F.struct("n_", (F.col("q1") - step).alias("lo"), (F.col("q3") + step).alias("hi")).alias(name))

    rows = rows.join(fences(group, "near_"), group, "left").join(fences(wider, "wide_"), wider, "left")
    use = F.when(F.col("near_.n_") >= b.min_group, F.col("near_")).otherwise(F.col("wide_"))
    outside = ~F.col("ppm_").between(use["lo"], use["hi"])
    reasons = [(F.col(price) < b.price_min, PRICE_LOW), (F.col(price) > b.price_max, PRICE_HIGH), (F.col(area) < b.area_min, AREA_SMALL), (F.col(area) > b.area_max, AREA_LARGE), (outside, PER_M2)]
    said = F.concat_ws(";", *[F.when(test, name) for test, name in reasons])
    return rows.withColumn("is_outlier", said != "").withColumn("outlier_reason", F.nullif(said, F.lit(""))).drop("ppm_", "near_", "wide_")


def null_coverage(d: DataFrame, columns: list[str]) -> DataFrame:
    """(field, missing, percent), from one aggregation turned into rows."""
    counted = d.agg(F.count("*").alias("n_"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.unpivot(["n_"], columns, "field", "missing").select("field", "missing", F.round(F.lit(100.0) * F.col("missing") / F.col("n_"), 6).alias("percent"))


def exploded_counts(d: DataFrame, column: str, separator: str, name: str) -> DataFrame:
    return d.select(F.explode(F.split(column, separator)).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def group_transform(d: DataFrame, keys: str | list[str], *aggregates: Column) -> DataFrame:
    """d with its group's aggregates; rows with a null key get nulls."""
    keys = [keys] if isinstance(keys, str) else keys
    return d.join(d.na.drop(subset=keys).groupBy(*keys).agg(*aggregates), keys, "left")


def _average_rank(d: DataFrame, column: str, out: str) -> DataFrame:
    counted = d.groupBy(F.col(column).alias("v_")).agg(F.count("*").alias("c_"))
    ranks = with_total_before(counted, "v_", "c_", "before_").select("v_", (F.col("before_") + (F.col("c_") + 1) / 2).alias(out))
    return d.join(ranks, d[column] == ranks.v_).drop("v_")


def spearman(d: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of average ranks, over the rows where both are given."""
    rows = d.select(F.col(a).alias("a_"), F.col(b).alias("b_")).na.drop()
    return _average_rank(_average_rank(rows, "a_", "ra_"), "b_", "rb_").agg(F.corr("ra_", "rb_").alias("spearman"))


def boxplot(d: DataFrame, key: str, value: str) -> DataFrame:
    q = d.groupBy(key).agg(F.percentile(value, F.lit(0.25)).alias("q1"), F.median(value).alias("med"), F.percentile(value, F.lit(0.75)).alias("q3"), F.avg(value).alias("mean"))
    whisker = 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col(value)
    return d.join(q, key).groupBy(key).agg(
        F.round(F.first("q1"), 6).alias("q1"), F.round(F.first("med"), 6).alias("med"), F.round(F.first("q3"), 6).alias("q3"), F.round(F.first("mean"), 6).alias("mean"),
        F.min(F.when(v >= F.col("q1") - whisker, v)).alias("lo"), F.max(F.when(v <= F.col("q3") + whisker, v)).alias("hi"),
    )


def hexbin_median(d: DataFrame, x: str, y: str, value: str, origin: tuple[float, float], size: float, least: int) -> DataFrame:
    """Median per hexagon: each point goes to the nearer of two lattices' centres; small cells are left out."""
    sx, sy = (F.col(x) - origin[0]) / size, (F.col(y) - origin[1]) / size / math.sqrt(3)
    i1, j1, i2, j2 = F.rint(sx), F.rint(sy), F.floor(sx), F.floor(sy)
    d1, d2 = F.pow(sx - i1, F.lit(2)) + 3 * F.pow(sy - j1, F.lit(2)), F.pow(sx - i2 - 0.5, F.lit(2)) + 3 * F.pow(sy - j2 - 0.5, F.lit(2))
    cell = [F.when(d1 < d2, a.cast("double")).otherwise(b.cast("double") + 0.5) for a, b in ((i1, i2), (j1, j2))]
    return d.groupBy(cell[0].alias("hx"), cell[1].alias("hy")).agg(F.count("*").alias("n"), F.round(F.median(value), 6).alias("med")).where(F.col("n") >= least)


def kde_grid(points: DataFrame, xs: tuple[float, float, int], ys: tuple[float, float, int]) -> DataFrame:
    """Gaussian density of (x, y) on a grid, Scott's bandwidth with full covariance.

    The grid is a literal array, so points are read once and only sums per grid cell are shuffled.
    """
    k = points.agg(F.count("*").alias("n"), F.var_samp("x").alias("a"), F.covar_samp("x", "y").alias("b"), F.var_samp("y").alias("d"))
    h = F.pow(F.col("n").cast("double"), F.lit(-1.0 / 3))
    k = k.select("n", *[(F.col(c) * h).alias(c) for c in "abd"])
    grid = F.array(*[F.struct(F.lit(xs[0] + xs[1] * i).alias("gx"), F.lit(ys[0] + ys[1] * j).alias("gy")) for i in range(xs[2]) for j in range(ys[2])])
    each = points.crossJoin(F.broadcast(k)).select("x", "y", "n", "a", "b", "d", F.explode(grid).alias("g"))
    dx, dy, det = F.col("g.gx") - F.col("x"), F.col("g.gy") - F.col("y"), F.col("a") * F.col("d") - F.col("b") * F.col("b")
    power = F.col("d") * dx * dx - 2 * F.col("b") * dx * dy + F.col("a") * dy * dy
    total = F.sum(F.exp(-0.5 * power / det)) / (F.first("n") * 2 * F.pi() * F.sqrt(F.first(det)))
    return each.groupBy(F.col("g.gx").alias("gx"), F.col("g.gy").alias("gy")).agg(total.alias("density"))


def page(d: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Rows of the number-th page, with the rank shown.

    Only what the pages up to it hold is ranked: the rest falls away in a top-k.
    """
    top = d.orderBy(*order).limit(number * size)
    return top.withColumn("shown", F.row_number().over(Window.orderBy(*order))).where(F.col("shown") > (number - 1) * size)


def zscore(d: DataFrame, column: str, out: str) -> DataFrame:
    """Standardised by mean and sample deviation; nulls count as the median."""
    filled = d.crossJoin(F.broadcast(d.agg(F.median(column).alias("m_")))).withColumn("f_", F.coalesce(F.col(column).cast("double"), F.col("m_")))
    s = F.broadcast(filled.agg(F.avg("f_").alias("a_"), F.stddev_samp("f_").alias("s_")))
    return filled.crossJoin(s).withColumn(out, (F.col("f_") - F.col("a_")) / F.col("s_")).drop("m_", "f_", "a_", "s_")


def group_r2(d: DataFrame, key: str, value: str) -> DataFrame:
    """Share of a value's variance that its group means explain, from sums per group."""
    g = d.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    total = g.agg(F.sum("n").alias("n_"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("a_"))
    within, between = F.sum(F.col("n") * F.col("v")), F.sum(F.col("n") * F.pow(F.col("m") - F.col("a_"), F.lit(2)))
    return g.crossJoin(F.broadcast(total)).agg((1 - within / (within + between)).alias("r2"))


def cluster_sums(d: DataFrame, group: str, a: str, b: str) -> DataFrame:
    return d.groupBy(group).agg(F.count("*").alias("n"), F.sum(a).alias("a"), F.sum(b).alias("b"))


def bootstrap_interval(sums: DataFrame, draws: int = 1000, seed: int = 0) -> DataFrame:
    """95 % intervals of mean a, mean b and their difference when whole groups are drawn again.

    Poisson weights from a hash of group and draw stand in for multinomial counts,
    so every draw is a sum that tasks work out alone; no group travels.
    """
    key = sums.columns[0]
    u = (F.pmod(F.xxhash64(F.col(key), F.col("draw"), F.lit(seed)), F.lit(2**31)).cast("double") + 0.5) / 2**31
    cumulative = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    weight = sum((F.when(u > float(c), 1).otherwise(0) for c in cumulative), F.lit(0))
    drawn = sums.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("w", weight)
    means = drawn.groupBy("draw").agg((F.sum(F.col("w") * F.col("a")) / F.sum(F.col("w") * F.col("n"))).alias("a"), (F.sum(F.col("w") * F.col("b")) / F.sum(F.col("w") * F.col("n"))).alias("b"))
    means = means.withColumn("diff", F.col("a") - F.col("b"))
    ends = [F.percentile(c, F.array(F.lit(0.025), F.lit(0.975))).alias(c) for c in ("a", "b", "diff")]
    return means.agg(*ends).unpivot([], ["a", "b", "diff"], "name", "interval").select("name", F.get("interval", F.lit(0)).alias("lo"), F.get("interval", F.lit(1)).alias("hi"))


def sample_per_group(d: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows of each group, chosen by a seeded hash: a sampling operator, the same choice every time."""
    w = Window.partitionBy(group).orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key))
    return d.withColumn("rn_", F.row_number().over(w)).where(F.col("rn_") <= n).drop("rn_")


def fold_group(phone: Column, cell: Column, row: Column) -> Column:
    """One poster is one group, else one grid cell, else the row itself."""
    return F.coalesce(phone, cell, F.concat(F.lit("row:"), row.cast("string")))


def with_fold(d: DataFrame, group: Column, folds: int = 5, hashed: bool = True) -> DataFrame:
    """A fold that depends on the group alone, so no group is split."""
    return d.withColumn("fold", F.pmod(F.xxhash64(group) if hashed else group, F.lit(folds).cast("long")))


def oof_group_median(d: DataFrame, key: str, target: str, fold: str) -> DataFrame:
    """d with pred: its group's median over the other folds, or of all rows there."""
    # values are counted once; what is copied to the other folds is a row per distinct value
    folds = d.select(fold).distinct().withColumnRenamed(fold, "out_")
    counted = d.groupBy(F.col(fold).alias("in_"), F.col(key).alias("key_"), F.col(target).alias("y_")).agg(F.count("*").alias("c_"))
    others = F.broadcast(folds).crossJoin(counted).where("in_ <> out_")
    median = F.percentile("y_", 0.5, F.col("c_"))
    own = others.groupBy("out_", "key_").agg(median.alias("m_"))
    whole = others.groupBy("out_", "y_").agg(F.sum("c_").alias("c_")).groupBy(F.col("out_").alias("fold_")).agg(median.alias("a_"))
    joined = d.join(own, (d[fold] == own.out_) & (d[key] == own.key_), "left").join(whole, F.col(fold) == F.col("fold_"))
    return joined.withColumn("pred", F.coalesce("m_", "a_")).drop("out_", "key_", "m_", "fold_", "a_")


def regression_metrics(d: DataFrame, y: str, pred: str, within: float = 0.25) -> DataFrame:
    ape, log_error = F.abs(F.col(pred) - F.col(y)) / F.col(y), F.log(pred) - F.log(y)
    return d.agg(
        F.round(F.avg(ape), 9).alias("mape"), F.round(F.median(ape), 9).alias("median_ape"), F.round(F.avg(F.abs(F.col(pred) - F.col(y))), 6).alias("mae"),
        F.round(F.sqrt(F.avg(log_error * log_error)), 9).alias("rmse_log"), F.round(1 - F.avg(log_error * log_error) / F.var_pop(F.log(y)), 4).alias("r2_log"),
        F.round(F.avg((ape <= within).cast("int")), 9).alias("within"),
    )


def conformal_margins(d: DataFrame, y: str, lo: str, hi: str, fold: str, coverage: float = 0.8) -> DataFrame:
    """(fold, margin): the finite-sample quantile of the other folds' scores max(lo - y, y - hi).

    The level depends on the number of scores, so the quantile interpolates in their sorted array by hand.
    """
    scores = d.select(F.col(fold).alias("in_"), F.greatest(F.col(lo) - F.col(y), F.col(y) - F.col(hi)).alias("s"))
    folds = d.select(F.col(fold).alias("fold")).distinct()
    ranked = folds.crossJoin(scores).where("in_ <> fold").groupBy("fold").agg(F.count("*").alias("n"))
    level = F.least(F.lit(1.0), F.ceil((F.col("n") + 1) * coverage) / F.col("n"))
    at = ranked.select("fold", ((F.col("n") - 1) * level).alias("at"))
    w = Window.partitionBy("fold").orderBy("s")
    placed = folds.crossJoin(scores).where("in_ <> fold").withColumn("k", F.row_number().over(w) - 1).join(at, "fold")
    weight = F.greatest(1 - F.abs(F.col("k") - F.col("at")), F.lit(0.0))
    return placed.groupBy("fold").agg(F.sum(weight * F.col("s")).alias("margin"))


def conformal_band(d: DataFrame, margins: DataFrame, lo: str, hi: str, center: str, fold: str) -> DataFrame:
    """Bands widened by their fold's margin, never past the centre."""
    m = d.join(margins.withColumnRenamed("fold", "fold_"), d[fold] == F.col("fold_"))
    return m.withColumn(lo, F.least(F.col(lo) - F.col("margin"), F.col(center))).withColumn(hi, F.greatest(F.col(hi) + F.col("margin"), F.col(center))).drop("fold_", "margin")


def fair_bands(d: DataFrame, price: str, pred: str, lo: str, hi: str, digits: int = -3) -> DataFrame:
    """fair_price rounded half-even, value_pct to one digit, and the tier of the asked price."""
    unit = 10.0 ** -digits
    tier = F.when(F.col(price) < F.col(lo), "below").when(F.col(price) > F.col(hi), "above").otherwise("within")
    return d.withColumn("fair_price", F.rint(F.col(pred) / unit) * unit).withColumn("value_pct", F.bround((F.col(price) - F.col(pred)) / F.col(pred) * 100, 1)).withColumn("tier", tier)

"""Queries over aggregates, windows and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import wilson, with_quantile_bin, with_rank_share
from ..operators import stats as S
from .catalogue import query
from .tables import LISTINGS, listings, table


@query("agg_value_counts_share", "SELECT event_type, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 9) AS share FROM events GROUP BY event_type")
def agg_value_counts_share(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9))


@query("agg_null_coverage", f"""WITH {LISTINGS}, c AS (SELECT count(*) AS n, count(*) - count(area) AS area, count(*) - count(value_pct) AS value_pct, count(*) - count(days_old) AS days_old FROM listings)
SELECT 'area' AS field, area AS missing, round(100.0 * area / n, 6) AS percent FROM c UNION ALL SELECT 'value_pct', value_pct, round(100.0 * value_pct / n, 6) FROM c UNION ALL SELECT 'days_old', days_old, round(100.0 * days_old / n, 6) FROM c""")
def agg_null_coverage(spark, sf_dir):
    return S.null_coverage(listings(spark, sf_dir), ["area", "value_pct", "days_old"])


@query("agg_quantiles", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.05), 6) AS p05, round(quantile_cont(o_totalprice, 0.25), 6) AS q1, round(median(o_totalprice), 6) AS med, round(quantile_cont(o_totalprice, 0.75), 6) AS q3, round(quantile_cont(o_totalprice, 0.99), 6) AS p99 FROM orders GROUP BY o_orderpriority")
def agg_quantiles(spark, sf_dir):
    q = lambda p: F.round(F.percentile("o_totalprice", F.lit(p)), 6)
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(q(0.05).alias("p05"), q(0.25).alias("q1"), F.round(F.median("o_totalprice"), 6).alias("med"), q(0.75).alias("q3"), q(0.99).alias("p99"))


@query("agg_multi_having", "SELECT c_nationkey, c_mktsegment, count(*) AS size, round(avg(c_acctbal), 6) AS mean, round(median(c_acctbal), 6) AS med FROM customer GROUP BY ALL HAVING count(*) >= 12")
def agg_multi_having(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("size"), F.round(F.avg("c_acctbal"), 6).alias("mean"), F.round(F.median("c_acctbal"), 6).alias("med")).where("size >= 12")


@query("agg_rollup_total", "SELECT coalesce(source, 'total') AS source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (source)")
def agg_rollup_total(spark, sf_dir):
    d = table(spark, sf_dir, "documents").rollup("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return d.select(F.coalesce("source", F.lit("total")).alias("source"), "n", "chars")


@query("agg_pivot_levels", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY o_orderpriority")
def agg_pivot_levels(spark, sf_dir):
    levels = ["F", "O", "P"]
    out = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", levels).count()
    return out.na.fill(0, levels)


@query("agg_explode_count", "WITH r AS (SELECT unnest(string_split(p_name, ' ')) AS reason FROM part) SELECT reason, count(*) AS n FROM r GROUP BY reason")
def agg_explode_count(spark, sf_dir):
    return S.exploded_counts(table(spark, sf_dir, "part"), "p_name", " ", "reason")


@query("agg_pair_counts", "SELECT p_brand AS source, p_type AS target, count(*) AS n FROM part GROUP BY ALL")
def agg_pair_counts(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("source"), F.col("p_type").alias("target")).agg(F.count("*").alias("n"))


@query("agg_multi_site_keys", "SELECT l_suppkey, count(DISTINCT l_returnflag) AS sites, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_returnflag) > 1")
def agg_multi_site_keys(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_returnflag").alias("sites"), F.count("*").alias("n")).where("sites > 1")


_RANKED = "(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


@query("agg_spearman", f"WITH r AS (SELECT {_RANKED.format(c='p_size')} AS a, {_RANKED.format(c='p_retailprice')} AS b FROM part) SELECT round(corr(a, b), 6) AS spearman FROM r")
def agg_spearman(spark, sf_dir):
    return S.spearman(table(spark, sf_dir, "part"), "p_size", "p_retailprice").select(F.round("spearman", 6).alias("spearman"))


@query("agg_skew_corr", "WITH m AS (SELECT avg(value) AS m FROM events) SELECT round(avg((value - m) ^ 3) / avg((value - m) ^ 2) ^ 1.5, 6) AS skew, round(corr(value, CAST(user_id AS DOUBLE)), 6) AS pearson FROM events, m")
def agg_skew_corr(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.round(F.skewness("value"), 6).alias("skew"), F.round(F.corr("value", F.col("user_id").cast("double")), 6).alias("pearson"))


@query("agg_log_histogram", "SELECT CAST(floor(ln(o_totalprice) * 4) AS BIGINT) AS bin, count(*) AS n FROM orders WHERE o_totalprice > 0 GROUP BY bin")
def agg_log_histogram(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_totalprice > 0").groupBy(F.floor(F.log("o_totalprice") * 4).alias("bin")).agg(F.count("*").alias("n"))


@query("agg_boxplot", """WITH q AS (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.25) AS q1, median(c_acctbal) AS med, quantile_cont(c_acctbal, 0.75) AS q3, avg(c_acctbal) AS mean FROM customer GROUP BY ALL)
SELECT q.c_mktsegment, round(q1, 6) AS q1, round(med, 6) AS med, round(q3, 6) AS q3, round(mean, 6) AS mean, min(c_acctbal) FILTER (c_acctbal >= q1 - 1.5 * (q3 - q1)) AS lo, max(c_acctbal) FILTER (c_acctbal <= q3 + 1.5 * (q3 - q1)) AS hi
FROM customer c JOIN q ON c.c_mktsegment = q.c_mktsegment GROUP BY ALL""")
def agg_boxplot(spark, sf_dir):
    return S.boxplot(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal")


@query("agg_hexbin_median", f"""WITH {LISTINGS}, s AS (SELECT price, (lon - 105.70) / 0.02 AS x, (lat - 20.90) / 0.02 / sqrt(3.0) AS y FROM listings),
h AS (SELECT price, round_even(x, 0) AS i1, round_even(y, 0) AS j1, floor(x) AS i2, floor(y) AS j2, x, y FROM s),
b AS (SELECT price, (x - i1) ^ 2 + 3.0 * (y - j1) ^ 2 < (x - i2 - 0.5) ^ 2 + 3.0 * (y - j2 - 0.5) ^ 2 AS first, i1, j1, i2, j2 FROM h)
SELECT CAST(CASE WHEN first THEN i1 ELSE i2 + 0.5 END AS DOUBLE) AS hx, CAST(CASE WHEN first THEN j1 ELSE j2 + 0.5 END AS DOUBLE) AS hy, count(*) AS n, round(median(price), 6) AS med FROM b GROUP BY ALL HAVING count(*) >= 3""")
def agg_hexbin_median(spark, sf_dir):
    return S.hexbin_median(listings(spark, sf_dir), "lon", "lat", "price", (105.70, 20.90), 0.02, 3)


@query("agg_kde_grid", """WITH p AS (SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part),
s AS (SELECT count(*) AS n, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS d FROM p),
k AS (SELECT n, n ^ (-1.0 / 3) * a AS a, n ^ (-1.0 / 3) * b AS b, n ^ (-1.0 / 3) * d AS d FROM s),
g AS (SELECT 1 + 5.0 * i AS gx, 900 + 10.0 * j AS gy FROM range(10) t(i), range(10) u(j))
SELECT CAST(gx AS DOUBLE) AS gx, CAST(gy AS DOUBLE) AS gy, round(sum(exp(-0.5 * (d * (gx - x) ^ 2 - 2 * b * (gx - x) * (gy - y) + a * (gy - y) ^ 2) / (a * d - b * b))) / (any_value(n) * 2 * pi() * sqrt(any_value(a * d - b * b))), 9) AS density FROM g, p, k GROUP BY gx, gy""")
def agg_kde_grid(spark, sf_dir):
    points = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return S.kde_grid(points, (1.0, 5.0, 10), (900.0, 10.0, 10)).withColumn("density", F.round("density", 9))


@query("agg_null_share_udaf", f"WITH {LISTINGS} SELECT house_type, round(avg(CAST(area IS NULL AS INTEGER)), 9) AS null_share, count(area) || '/' || count(*) AS filled FROM listings GROUP BY house_type")
def agg_null_share_udaf(spark, sf_dir):
    return listings(spark, sf_dir).groupBy("house_type").agg(F.round(F.avg(F.col("area").isNull().cast("int")), 9).alias("null_share"), F.concat_ws("/", F.count("area").cast("string"), F.count("*").cast("string")).alias("filled"))


@query("agg_hit_rate", "SELECT o_orderpriority, round_even(avg(CAST(o_orderstatus = 'F' AS INTEGER)), 3) AS hit_rate FROM orders GROUP BY o_orderpriority")
def agg_hit_rate(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.bround(F.avg((F.col("o_orderstatus") == "F").cast("int")), 3).alias("hit_rate"))


@query("agg_mean_of_groups", "WITH g AS (SELECT user_id, sum(value * 2) / count(*) AS m FROM events GROUP BY user_id) SELECT round(avg(m), 6) AS mean_of_means, count(*) AS users FROM g")
def agg_mean_of_groups(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("user_id").agg((F.sum(F.col("value") * 2) / F.count("*")).alias("m"))
    return g.agg(F.round(F.avg("m"), 6).alias("mean_of_means"), F.count("*").alias("users"))


@query("agg_seeded_sample_per_group")
def agg_seeded_sample_per_group(spark, sf_dir):
    return S.sample_per_group(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 25, seed=7)


@query("win_pct_rank_avg_ties", "SELECT p_partkey, round((rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0) / count(*) OVER (), 9) AS share FROM part")
def win_pct_rank_avg_ties(spark, sf_dir):
    return with_rank_share(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", "share").select("p_partkey", F.round("share", 9).alias("share"))


@query("win_qcut5", "WITH e AS (SELECT list_distinct(quantile_cont(p_retailprice, [0.2, 0.4, 0.6, 0.8])) AS q FROM part) SELECT p_partkey, CAST(len(list_filter(q, lambda x: x < p_retailprice)) AS INTEGER) AS bin FROM part, e")
def win_qcut5(spark, sf_dir):
    return with_quantile_bin(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "bin").select("p_partkey", "bin")


@query("win_group_transform", "SELECT c_custkey, median(c_acctbal) OVER w AS med, count(*) OVER w AS size, (SELECT count(DISTINCT c2.c_mktsegment) FROM customer c2 WHERE c2.c_nationkey = customer.c_nationkey) AS segments FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
def win_group_transform(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return S.group_transform(c, "c_nationkey", F.median("c_acctbal").alias("med"), F.count("*").alias("size"), F.countDistinct("c_mktsegment").alias("segments")).select("c_custkey", "med", "size", "segments")


@query("win_dup_flag", "SELECT page_id, count(*) OVER (PARTITION BY regexp_replace(url, '[?#].*$', '')) > 1 AS shared FROM pages")
def win_dup_flag(spark, sf_dir):
    key = F.regexp_replace("url", r"[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", (F.count("*").over(Window.partitionBy(key)) > 1).alias("shared"))


@query("win_page_slice", "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS shown FROM orders QUALIFY shown BETWEEN 41 AND 60")
def win_page_slice(spark, sf_dir):
    return S.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3, 20)


@query("win_relative_max_date", "SELECT o_orderkey, date_diff('day', o_orderdate, max(o_orderdate) OVER ())::INTEGER AS days_old FROM orders")
def win_relative_max_date(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    newest = F.broadcast(o.agg(F.max("o_orderdate").alias("newest")))
    return o.crossJoin(newest).select("o_orderkey", F.date_diff("newest", "o_orderdate").alias("days_old"))


@query("win_zscore", "SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER (), 9) AS z FROM part")
def win_zscore(spark, sf_dir):
    return S.zscore(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", "z").select("p_partkey", F.round("z", 9).alias("z"))


@query("win_nlargest", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10")
def win_nlargest(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "o_custkey").limit(10)


@query("stat_iqr_outliers", f"""WITH {LISTINGS}, r AS (SELECT *, price * 1000 / area AS ppm FROM listings WHERE area IS NOT NULL),
d AS (SELECT district, count(*) AS n, quantile_cont(ppm, 0.25) AS q1, quantile_cont(ppm, 0.75) AS q3 FROM r GROUP BY district),
p AS (SELECT house_type, quantile_cont(ppm, 0.25) AS q1, quantile_cont(ppm, 0.75) AS q3 FROM r GROUP BY house_type),
f AS (SELECT listing_id, concat_ws(';', CASE WHEN price * 1000 < 910000 THEN 'price_too_low' END, CASE WHEN price * 1000 > 990000 THEN 'price_too_high' END, CASE WHEN area < 3 THEN 'area_too_small' END, CASE WHEN area > 48 THEN 'area_too_large' END,
  CASE WHEN d.n >= 10 AND NOT ppm BETWEEN d.q1 - 3 * (d.q3 - d.q1) AND d.q3 + 3 * (d.q3 - d.q1) OR d.n < 10 AND NOT ppm BETWEEN p.q1 - 3 * (p.q3 - p.q1) AND p.q3 + 3 * (p.q3 - p.q1) THEN 'price_per_m2_outlier' END) AS reason
  FROM r JOIN d USING (district) JOIN p USING (house_type))
SELECT listing_id, reason <> '' AS is_outlier, nullif(reason, '') AS outlier_reason FROM f""")
def stat_iqr_outliers(spark, sf_dir):
    d = listings(spark, sf_dir).where("area is not null").withColumn("price", F.col("price") * 1000)
    bounds = S.OutlierBounds(910_000, 990_000, 3.0, 48.0)
    return S.flag_outliers(d, "price", "area", "district", "house_type", bounds).select("listing_id", "is_outlier", "outlier_reason")


@query("stat_wilson", """WITH s AS (SELECT o_orderpriority, CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY ALL)
SELECT o_orderpriority, round((k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 9) AS lo, round((k / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 9) AS hi FROM s""")
def stat_wilson(spark, sf_dir):
    s = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.sum((F.col("o_orderstatus") == "F").cast("double")).alias("k"), F.count("*").cast("double").alias("n"))
    w = wilson(F.col("k"), F.col("n"))
    return s.select("o_orderpriority", F.round(w["lo"], 9).alias("lo"), F.round(w["hi"], 9).alias("hi"))


@query("stat_group_r2", "WITH g AS (SELECT p_retailprice AS x, avg(p_retailprice) OVER (PARTITION BY p_brand) AS m, avg(p_retailprice) OVER () AS a FROM part) SELECT round(1 - sum((x - m) ^ 2) / sum((x - a) ^ 2), 6) AS r2 FROM g")
def stat_group_r2(spark, sf_dir):
    return S.group_r2(table(spark, sf_dir, "part"), "p_brand", "p_retailprice").select(F.round("r2", 6).alias("r2"))


@query("stat_cluster_sums", "SELECT l_suppkey, count(*) AS n, round(sum(l_discount), 6) AS a, round(sum(l_tax), 6) AS b FROM lineitem GROUP BY l_suppkey")
def stat_cluster_sums(spark, sf_dir):
    return S.cluster_sums(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_discount", "l_tax").select("l_suppkey", "n", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query("stat_bootstrap_ci")
def stat_bootstrap_ci(spark, sf_dir):
    return S.bootstrap_interval(S.cluster_sums(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_discount", "l_tax"), draws=500, seed=0)


@query("stat_shared_points", "WITH c AS (SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS k FROM customer) SELECT round(100.0 * avg(CAST(k >= 12 AS INTEGER)), 6) AS percent FROM c")
def stat_shared_points(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    big = S.group_transform(c, ["c_nationkey", "c_mktsegment"], F.count("*").alias("k"))
    return big.agg(F.round(100 * F.avg((F.col("k") >= 12).cast("int")), 6).alias("percent"))


@query("fold_group_assign", "SELECT l_orderkey % 5 AS fold, count(*) AS n, count(DISTINCT l_orderkey) AS groups FROM lineitem GROUP BY fold")
def fold_group_assign(spark, sf_dir):
    return S.with_fold(table(spark, sf_dir, "lineitem"), F.col("l_orderkey"), 5, hashed=False).groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("groups"))


_FOLDS = "p AS (SELECT *, p_partkey % 5 AS fold FROM part)"
_OOF = f"""WITH {_FOLDS}, f AS (SELECT DISTINCT fold FROM p),
g AS (SELECT f.fold, p.p_brand, median(p_retailprice) AS m FROM f JOIN p ON p.fold <> f.fold GROUP BY ALL), a AS (SELECT f.fold, median(p_retailprice) AS m FROM f JOIN p ON p.fold <> f.fold GROUP BY ALL),
o AS (SELECT p_partkey, p_retailprice AS y, p.fold, coalesce(g.m, a.m) AS pred FROM p LEFT JOIN g ON g.fold = p.fold AND g.p_brand = p.p_brand JOIN a ON a.fold = p.fold)"""


@query("fold_oof_group_median", f"{_OOF} SELECT p_partkey, fold, round(pred, 6) AS pred FROM o")
def fold_oof_group_median(spark, sf_dir):
    p = S.with_fold(table(spark, sf_dir, "part"), F.col("p_partkey"), 5, hashed=False)
    return S.oof_group_median(p, "p_brand", "p_retailprice", "fold").select("p_partkey", "fold", F.round("pred", 6).alias("pred"))


@query("model_metrics_table", f"""{_OOF} SELECT round(avg(abs(pred - y) / y), 9) AS mape, round(median(abs(pred - y) / y), 9) AS median_ape, round(avg(abs(pred - y)), 6) AS mae, round(sqrt(avg((ln(pred) - ln(y)) ^ 2)), 9) AS rmse_log,
round(1 - sum((ln(pred) - ln(y)) ^ 2) / (sum(ln(y) ^ 2) - count(*) * avg(ln(y)) ^ 2), 4) AS r2_log, round(avg(CAST(abs(pred - y) / y <= 0.02 AS INTEGER)), 9) AS within FROM o""")
def model_metrics_table(spark, sf_dir):
    p = S.with_fold(table(spark, sf_dir, "part"), F.col("p_partkey"), 5, hashed=False)
    return S.regression_metrics(S.oof_group_median(p, "p_brand", "p_retailprice", "fold"), "p_retailprice", "pred", within=0.02)


@query("conformal_margin", f"WITH x AS ({_OOF} SELECT * FROM o) SELECT CAST(f AS BIGINT) AS fold, round((SELECT list_sort(list(sc))[1 + CAST(floor((count(*) - 1) * least(1.0, ceil((count(*) + 1) * 0.8) / count(*))) AS BIGINT)] * (1 - ((count(*) - 1) * least(1.0, ceil((count(*) + 1) * 0.8) / count(*)) - floor((count(*) - 1) * least(1.0, ceil((count(*) + 1) * 0.8) / count(*))))) + list_sort(list(sc))[least(count(*), 2 + CAST(floor((count(*) - 1) * least(1.0, ceil((count(*) + 1) * 0.8) / count(*))) AS BIGINT))] * ((count(*) - 1) * least(1.0, ceil((count(*) + 1) * 0.8) / count(*)) - floor((count(*) - 1) * least(1.0, ceil((count(*) + 1) * 0.8) / count(*)))) FROM (SELECT greatest(pred - 5 - y, y - pred - 5) AS sc FROM x WHERE x.fold <> f)), 6) AS margin FROM range(5) t(f)")
def conformal_margin(spark, sf_dir):
    p = S.with_fold(table(spark, sf_dir, "part"), F.col("p_partkey"), 5, hashed=False)
    scored = S.oof_group_median(p, "p_brand", "p_retailprice", "fold").withColumn("lo", F.col("pred") - 5).withColumn("hi", F.col("pred") + 5)
    return S.conformal_margins(scored, "p_retailprice", "lo", "hi", "fold", 0.8).select("fold", F.round("margin", 6).alias("margin"))


@query("band_tiers", f"""{_OOF} SELECT p_partkey, round_even(pred / 10, 0) * 10 AS fair_price, round_even((y - pred) / pred * 100, 1) AS value_pct, CASE WHEN y < pred * 0.98 THEN 'below' WHEN y > pred * 1.02 THEN 'above' ELSE 'within' END AS tier FROM o""")
def band_tiers(spark, sf_dir):
    p = S.with_fold(table(spark, sf_dir, "part"), F.col("p_partkey"), 5, hashed=False)
    o = S.oof_group_median(p, "p_brand", "p_retailprice", "fold").withColumn("lo", F.col("pred") * 0.98).withColumn("hi", F.col("pred") * 1.02)
    return S.fair_bands(o, "p_retailprice", "pred", "lo", "hi", -1).select("p_partkey", "fair_price", "value_pct", "tier")

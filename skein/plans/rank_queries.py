"""Queries over the recommender: filters, scores, caps, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import recommend as R
from .catalogue import query
from .tables import LISTINGS, listings, table

_TYPICAL = """typ AS (
  SELECT l.*, coalesce(CASE WHEN n2 >= 30 THEN m2 ELSE m1 END, (SELECT median(price) FROM listings)) AS typical_price
  FROM listings l LEFT JOIN (SELECT house_type, district, median(price) AS m2, count(price) AS n2 FROM listings GROUP BY ALL) g2 USING (house_type, district)
  LEFT JOIN (SELECT house_type, median(price) AS m1 FROM listings GROUP BY ALL) g1 USING (house_type))"""


def _share(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN 0.5 ELSE (rank() OVER (PARTITION BY {column} IS NULL ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0) / count({column}) OVER () END"


def _search_sql(where: str, budget: float, cap: int, top: int, weights: dict[str, float], columns: str = "listing_id, score") -> str:
    w = weights
    extra = "".join(f" + {v} * {k}" for k, v in w.items() if k.startswith("q_"))
    capped = f"WHERE rn <= {cap}" if cap else ""
    return f"""WITH {LISTINGS}, {_TYPICAL},
m AS (SELECT * FROM typ WHERE {where}),
p AS (SELECT *, least(greatest(typical_price, {budget} * 0.7), {budget}) AS ref, {_share("value_pct")} AS rv, {_share("distance_km")} AS rd, {_share("amenity_count")} AS s_amenity FROM m),
s AS (SELECT *, CASE WHEN price < ref THEN least(price / ref, 1.0) ELSE 1.0 - 0.5 * (price - ref) / greatest({budget} - ref, 1.0) END AS s_price, 1 - rv AS s_value, 1 - rd AS s_distance FROM p),
t AS (SELECT *, round_even({w["price"]} * s_price + {w["value"]} * s_value + {w["distance"]} * s_distance + {w["amenity"]} * s_amenity{extra}, 3) AS score FROM s),
c AS (SELECT *, row_number() OVER (PARTITION BY building ORDER BY score DESC, listing_id) AS rn FROM t)
SELECT {columns} FROM c {capped} ORDER BY score DESC, listing_id LIMIT {top}"""


_BASE = "price <= {budget} AND house_type <> 'Nhà nguyên căn' AND NOT is_shared"


@query("rank_recommend_topk", _search_sql(_BASE.format(budget=980.0) + " AND (area IS NULL OR area >= 10.0)", 980.0, 1, 10, R.WEIGHTS))
def rank_recommend_topk(spark, sf_dir):
    d = R.with_typical_price(listings(spark, sf_dir))
    return R.recommend(d, R.Search(budget=980.0, min_area=10.0)).select("listing_id", "score")


_NEED = R.Search(budget=990.0, need=("balcony",), districts=("Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5"), max_km=15.0, max_days_old=300, top=20)


@query("rank_recommend_need_flags", _search_sql(_BASE.format(budget=990.0) + " AND balcony = 1 AND district IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5') AND distance_km <= 15.0 AND (days_old IS NULL OR days_old <= 300)", 990.0, 1, 20, R.WEIGHTS))
def rank_recommend_need_flags(spark, sf_dir):
    return R.recommend(R.with_typical_price(listings(spark, sf_dir)), _NEED).select("listing_id", "score")


@query("rank_house_type_contains", _search_sql(_BASE.format(budget=995.0) + " AND contains(lower(house_type), 'econ')", 995.0, 1, 15, R.WEIGHTS))
def rank_house_type_contains(spark, sf_dir):
    return R.recommend(R.with_typical_price(listings(spark, sf_dir)), R.Search(budget=995.0, house_type="ECON", top=15)).select("listing_id", "score")


@query("rank_per_group_cap", _search_sql(_BASE.format(budget=970.0), 970.0, 2, 50, R.WEIGHTS, "listing_id, building, score"))
def rank_per_group_cap(spark, sf_dir):
    return R.recommend(R.with_typical_price(listings(spark, sf_dir)), R.Search(budget=970.0, per_building=2, top=50)).select("listing_id", "building", "score")


_LEARNED = {"price": 0.1, "value": 0.2, "distance": 0.4, "amenity": 0.1, "q_has_address": 0.2}


@query("rank_hand_vs_learned_weights", f"""WITH h AS ({_search_sql(_BASE.format(budget=980.0), 980.0, 1, 30, R.WEIGHTS)}), l AS ({_search_sql(_BASE.format(budget=980.0), 980.0, 1, 30, _LEARNED)})
SELECT coalesce(h.listing_id, l.listing_id) AS listing_id, h.score AS hand, l.score AS learned FROM h FULL JOIN l ON h.listing_id = l.listing_id""")
def rank_hand_vs_learned_weights(spark, sf_dir):
    d = R.with_typical_price(listings(spark, sf_dir))
    hand = R.recommend(d, R.Search(budget=980.0, top=30)).select("listing_id", F.col("score").alias("hand"))
    learned = R.recommend(d, R.Search(budget=980.0, top=30, weights=_LEARNED)).select("listing_id", F.col("score").alias("learned"))
    return hand.join(learned, "listing_id", "full")


@query("rank_price_score", f"""WITH {LISTINGS}, {_TYPICAL}, r AS (SELECT *, least(greatest(typical_price, 970.0 * 0.7), 970.0) AS ref FROM typ)
SELECT listing_id, round(CASE WHEN price < ref THEN least(price / ref, 1.0) ELSE 1.0 - 0.5 * (price - ref) / greatest(970.0 - ref, 1.0) END, 6) AS s_price FROM r""")
def rank_price_score(spark, sf_dir):
    d = R.with_typical_price(listings(spark, sf_dir))
    return d.select("listing_id", F.round(R.price_score(F.col("price"), F.col("typical_price"), 970.0), 6).alias("s_price"))


@query("rank_typical_price_fallback", f"WITH {LISTINGS}, {_TYPICAL} SELECT listing_id, typical_price FROM typ")
def rank_typical_price_fallback(spark, sf_dir):
    return R.with_typical_price(listings(spark, sf_dir)).select("listing_id", "typical_price")


@query("rank_impute_area_quintile", f"""WITH {LISTINGS},
e AS (SELECT quantile_cont(price, [0.2, 0.4, 0.6, 0.8]) AS q FROM listings),
b AS (SELECT l.*, len(list_filter(list_distinct(q), lambda x: x < price)) AS bin FROM listings l, e),
m AS (SELECT house_type, bin, median(area) AS m FROM b GROUP BY ALL)
SELECT listing_id, area IS NULL AS area_imputed, coalesce(area, m, (SELECT median(area) FROM listings)) AS area_est FROM b LEFT JOIN m USING (house_type, bin)""")
def rank_impute_area_quintile(spark, sf_dir):
    return R.with_imputed_area(listings(spark, sf_dir)).select("listing_id", "area_imputed", "area_est")


# Marks of adverts, dealt to the rooms by number.
_TITLES = ("Phòng trọ khép kín", "Pass lại phòng đẹp", "Ở ghép cho nữ", "KTX giá rẻ", "Studio gần Brand#3")


def _adverts(spark, sf_dir):
    k = F.col("listing_id")
    d = listings(spark, sf_dir).drop("is_shared", "q_has_address", "lat", "lon")
    title = F.element_at(F.array(*map(F.lit, _TITLES)), (k % len(_TITLES) + 1).cast("int"))
    return d.select(
        *(c for c in d.columns if c not in ("price",)), F.when(k % 23 != 0, F.col("price")).alias("price"), title.alias("title"), F.when(k % 4 == 0, F.lit("nhượng lại")).alias("description"),
        F.concat(F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit(" "))).otherwise(""), F.lit("Phố X, Phường "), F.col("district"), F.lit(", "), F.col("building")).alias("address"),
        F.when(k % 19 == 0, k - 1).alias("duplicate_of"), (F.lit(20.0) + F.floor(k * 7919 % 2000 / 100)).alias("lat"), (F.lit(105.0) + F.floor(k * 104729 % 2000 / 100)).alias("lon"),
    )


def _adverts_sql() -> str:
    title = "CASE listing_id % 5 " + " ".join(f"WHEN {n} THEN '{t}'" for n, t in enumerate(_TITLES)) + " END"
    return f"""adverts AS (
  SELECT listing_id, house_type, district, area, CASE WHEN listing_id % 23 <> 0 THEN price END AS price, {title} AS title, CASE WHEN listing_id % 4 = 0 THEN 'nhượng lại' ELSE '' END AS description,
    (CASE WHEN listing_id % 3 = 0 THEN listing_id || ' ' ELSE '' END) || 'Phố X, Phường ' || district || ', ' || building AS address, CASE WHEN listing_id % 19 = 0 THEN listing_id - 1 END AS duplicate_of,
    20.0 + floor(CAST(listing_id * 7919 % 2000 AS DOUBLE) / 100) AS lat, 105.0 + floor(CAST(listing_id * 104729 % 2000 AS DOUBLE) / 100) AS lon
  FROM listings)"""


_BRANDS = tuple(f"Brand#{n}" for n in range(1, 26))
_FOLDED = "lower(strip_accents(replace(replace(address || ' ' || title, 'đ', 'd'), 'Đ', 'D')))"
_MARKS = f"""CAST(NOT regexp_matches(lower(title || ' ' || substr(description, 1, 400)), '\\bpass\\b|nhượng|sang lại|sang nhượng') AS DOUBLE) AS q_not_sublet,
  CAST(NOT regexp_matches(lower(title || ' ' || substr(description, 1, 400)), 'cho nữ|nữ thuê|chỉ nữ|chỉ nhận nữ|ưu tiên nữ') AS DOUBLE) AS q_any_gender,
  CAST(regexp_matches(split_part(address, 'Phường', 1), '\\d') AS DOUBLE) AS q_has_address,
  CAST(len(list_filter({list(_BRANDS)!r}, lambda n: regexp_matches({_FOLDED}, '(?:^|\\W)' || lower(n) || '(?:$|\\W)'))) = 0
    OR coalesce(list_contains(list_filter({list(_BRANDS)!r}, lambda n: regexp_matches({_FOLDED}, '(?:^|\\W)' || lower(n) || '(?:$|\\W)')), district), false) AS DOUBLE) AS q_district_ok"""


@query("rank_quality_marks", f"WITH {LISTINGS}, {_adverts_sql()} SELECT listing_id, {_MARKS} FROM adverts")
def rank_quality_marks(spark, sf_dir):
    return R.with_quality_marks(_adverts(spark, sf_dir), _BRANDS).select("listing_id", "q_not_sublet", "q_any_gender", "q_has_address", "q_district_ok")


@query("rank_prepared_listings", f"""WITH {LISTINGS}, {_adverts_sql()},
kept AS (SELECT * FROM adverts WHERE duplicate_of IS NULL AND price IS NOT NULL),
w AS (SELECT lat, lon, count(DISTINCT district) >= 5 AS bad FROM kept GROUP BY lat, lon),
g AS (SELECT kept.* EXCLUDE (district, lat, lon), bad AS geo_suspect, CASE WHEN NOT bad THEN district END AS district, CASE WHEN NOT bad THEN kept.lat END AS lat FROM kept JOIN w ON kept.lat = w.lat AND kept.lon = w.lon),
q AS (SELECT list_distinct([quantile_cont(price, 0.0), quantile_cont(price, 0.2), quantile_cont(price, 0.4), quantile_cont(price, 0.6), quantile_cont(price, 0.8), quantile_cont(price, 1.0)]) AS e, median(price) AS m0, median(area) AS a0 FROM g),
s AS (SELECT list_sort(e) AS e, m0, a0 FROM q),
b AS (SELECT g.*, m0, a0, len(list_filter(e[2:len(e) - 1], lambda x: x < price)) AS bin FROM g, s),
a AS (SELECT house_type, bin, median(area) AS am FROM b GROUP BY ALL),
t2 AS (SELECT house_type, district, median(price) AS m2, count(price) AS n2 FROM b WHERE district IS NOT NULL GROUP BY ALL),
t1 AS (SELECT house_type, median(price) AS m1 FROM b GROUP BY ALL)
SELECT listing_id, geo_suspect, district, lat, coalesce(area, am, a0) AS area_est, coalesce(CASE WHEN n2 >= 30 THEN m2 ELSE m1 END, m0) AS typical_price,
  regexp_matches(lower(title), 'ghép|slot|giường') OR (regexp_matches(lower(title), 'ktx') AND price < 2500000) AS is_shared, {_MARKS}
FROM b LEFT JOIN a USING (house_type, bin) LEFT JOIN t2 USING (house_type, district) LEFT JOIN t1 USING (house_type)""")
def rank_prepared_listings(spark, sf_dir):
    d = R.prepared(_adverts(spark, sf_dir), [F.col("price").desc()], _BRANDS)
    return d.select("listing_id", "geo_suspect", "district", "lat", "area_est", "typical_price", "is_shared", "q_not_sublet", "q_any_gender", "q_has_address", "q_district_ok")


_VOTES = """votes AS (SELECT l.doc_id, d.lang AS session, d.source AS query, l.quality AS label, CAST(d.doc_id * 7919 % 1009 AS DOUBLE) / 1009 AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def _votes(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return labels.join(docs, "doc_id").select("doc_id", F.col("lang").alias("session"), F.col("source").alias("query"), F.col("quality").alias("label"), (F.col("doc_id") * 7919 % 1009 / 1009).alias("score"))


@query("metric_ndcg_at_10", f"""WITH {_VOTES}, r AS (SELECT *, row_number() OVER (PARTITION BY session, query ORDER BY score DESC, doc_id) AS r, row_number() OVER (PARTITION BY session, query ORDER BY label DESC, doc_id) AS i FROM votes)
SELECT session, query, round(sum(CASE WHEN r <= 10 THEN label / log2(r + 1) ELSE 0 END) / nullif(sum(CASE WHEN i <= 10 THEN label / log2(i + 1) ELSE 0 END), 0), 9) AS ndcg FROM r GROUP BY session, query""")
def metric_ndcg_at_10(spark, sf_dir):
    return R.ndcg(_votes(spark, sf_dir), ["session", "query"], "score", "label", "doc_id").withColumn("ndcg", F.round("ndcg", 9))


@query("metric_precision_at_5", f"""WITH {_VOTES}, r AS (SELECT *, row_number() OVER (PARTITION BY session, query ORDER BY score DESC, doc_id) AS r FROM votes)
SELECT session, query, round(avg(CAST(label AS DOUBLE)), 9) AS precision FROM r WHERE r <= 5 GROUP BY session, query""")
def metric_precision_at_5(spark, sf_dir):
    return R.precision_at(_votes(spark, sf_dir), ["session", "query"], "score", "label", "doc_id").withColumn("precision", F.round("precision", 9))


@query("metric_random_baseline_expected", f"""WITH {_VOTES}, n AS (SELECT session, query, count(*) AS n, sum(label) AS p FROM votes GROUP BY ALL)
SELECT session, query, round(p / n * list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))) / CASE WHEN p > 0 THEN list_sum(list_transform(range(1, CAST(least(p, 10) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) END, 9) AS expected_ndcg FROM n""")
def metric_random_baseline_expected(spark, sf_dir):
    return R.random_ndcg(_votes(spark, sf_dir), ["session", "query"], "label").withColumn("expected_ndcg", F.round("expected_ndcg", 9))


_PERSONAS = [("student", 940.0, 12.0, "balcony"), ("family", 990.0, 20.0, None), ("worker", 960.0, 8.0, None)]


def _persona_sql() -> str:
    parts = []
    for name, budget, km, need in _PERSONAS:
        for config, weights in (("hand", R.WEIGHTS), ("learned", _LEARNED)):
            where = _BASE.format(budget=budget) + f" AND distance_km <= {km}" + (f" AND {need} = 1" if need else "")
            inner = _search_sql(where, budget, 1, 10, weights, "price, distance_km, amenity_count, score, listing_id")
            parts.append(f"SELECT '{name}' AS persona, '{config}' AS config, count(*) AS n, round(avg(price), 6) AS mean_price, round(avg(distance_km), 6) AS mean_km, round(avg(amenity_count), 6) AS mean_amenities FROM ({inner})")
    return " UNION ALL ".join(parts)


@query("rank_persona_grid", _persona_sql())
def rank_persona_grid(spark, sf_dir):
    d = R.with_typical_price(listings(spark, sf_dir))
    out = None
    for name, budget, km, need in _PERSONAS:
        for config, weights in (("hand", R.WEIGHTS), ("learned", _LEARNED)):
            top = R.recommend(d, R.Search(budget=budget, max_km=km, need=(need,) if need else (), weights=dict(weights)))
            row = top.agg(F.count("*").alias("n"), F.round(F.avg("price"), 6).alias("mean_price"), F.round(F.avg("distance_km"), 6).alias("mean_km"), F.round(F.avg("amenity_count"), 6).alias("mean_amenities"))
            row = row.select(F.lit(name).alias("persona"), F.lit(config).alias("config"), "n", "mean_price", "mean_km", "mean_amenities")
            out = row if out is None else out.unionByName(row)
    return out

"""Queries over the admission rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators import filters as L
from .catalogue import query
from .tables import LISTINGS, listings, table

# Sample titles.
TITLES = [("Phòng trọ gần trường", 2.0e6), ("Ở ghép 1 người", 1.0e6), ("KTX giá rẻ", 1.8e6), ("KTX cao cấp", 4.2e6), ("Cho thuê văn phòng", 9.0e6), ("Phòng gần biệt thự", 3.0e6), ("Pass phòng tầng 4 - 4,1 tr", 4.1e6), ("Phòng từ 2tr đến 3tr", 2.0e6)]
_VALUES = "(VALUES " + ", ".join(f"('{t}', CAST({p} AS DOUBLE))" for t, p in TITLES) + ") AS t(title, price)"
_F = "lower(strip_accents(replace(replace(title, 'đ', 'd'), 'Đ', 'D')))"


def _titles(spark):
    return spark.createDataFrame(TITLES, "title string, price double")


@query("filter_shared_flag", f"SELECT title, regexp_matches(lower(title), '{L.SHARED}') OR (regexp_matches(lower(title), '{L.DORM}') AND price < {L.DORM_PRICE}) AS shared FROM {_VALUES}")
def filter_shared_flag(spark, sf_dir):
    return _titles(spark).select("title", L.is_shared(F.col("title"), F.col("price")).alias("shared"))


@query("filter_room_validity")
def filter_room_validity(spark, sf_dir):
    v = L.room_validity(F.col("title"), F.col("price"), 8e6)
    return _titles(spark).select("title", v["valid"].alias("valid"), v["reason"].alias("reason"))


@query("filter_noise_flags")
def filter_noise_flags(spark, sf_dir):
    return _titles(spark).select("title", *[c.alias(k) for k, c in L.noise_flags(F.col("title"), F.lit("Phòng trọ"), F.lit(20)).items()])


@query("filter_price_gate", f"WITH {LISTINGS} SELECT listing_id FROM listings WHERE price BETWEEN 920 AND 980 AND NOT regexp_matches(lower(house_type), '^(?:econ)')")
def filter_price_gate(spark, sf_dir):
    return listings(spark, sf_dir).where(L.plausible_price(F.col("price"), F.col("house_type"), "econ", 920, 980)).select("listing_id")


@query("filter_not_stale", f"WITH {LISTINGS} SELECT listing_id FROM listings WHERE days_old IS NULL OR days_old <= 180")
def filter_not_stale(spark, sf_dir):
    return L.not_stale(listings(spark, sf_dir)).select("listing_id")


@query("filter_blank_placeholder", f"WITH {LISTINGS} SELECT listing_id, CASE WHEN listing_id % 7 <> 0 THEN lat END AS lat, CASE WHEN listing_id % 7 <> 0 THEN lon END AS lon, price FROM listings")
def filter_blank_placeholder(spark, sf_dir):
    return L.blanked(listings(spark, sf_dir), F.col("listing_id") % 7 == 0, ["lat", "lon"]).select("listing_id", "lat", "lon", "price")


_DISTRICTS = tuple(f"Brand#{n}" for n in range(1, 13))


@query("filter_spatial_analysis", f"WITH {LISTINGS} SELECT listing_id FROM listings WHERE lat BETWEEN 20.7 AND 21.05 AND lon BETWEEN 105.6 AND 105.85 AND price BETWEEN 910 AND 990 AND area BETWEEN 8 AND 40 AND district IN {_DISTRICTS}")
def filter_spatial_analysis(spark, sf_dir):
    return L.for_spatial_analysis(listings(spark, sf_dir), _DISTRICTS, (910, 990), (8, 40), (20.7, 21.05), (105.6, 105.85)).select("listing_id")


@query("filter_complete_and_training", f"WITH {LISTINGS} SELECT listing_id, is_shared FROM listings WHERE price IS NOT NULL AND area IS NOT NULL AND listing_id % 19 <> 0 AND NOT is_shared")
def filter_complete_and_training(spark, sf_dir):
    d = listings(spark, sf_dir).withColumn("duplicate_of", F.when(F.col("listing_id") % 19 == 0, F.col("listing_id") - 1))
    return L.training_rows(L.with_price_and_area(d)).select("listing_id", "is_shared")


@query("filter_located", f"""WITH {LISTINGS}, l AS (SELECT listing_id, CASE WHEN listing_id % 4 <> 0 THEN district END AS district, CASE WHEN listing_id % 10 = 0 THEN NULL WHEN listing_id % 7 = 0 THEN 10.77 WHEN listing_id % 6 = 0 THEN 21.028511 ELSE lat END AS lat, CASE WHEN listing_id % 6 = 0 THEN 105.804817 ELSE lon END AS lon FROM listings)
SELECT listing_id FROM l WHERE ((lat BETWEEN 20.50 AND 21.45 AND lon BETWEEN 105.25 AND 106.05) OR (lat IS NULL AND district IS NOT NULL)) AND NOT coalesce(round(lat, 6) = 21.028511 AND round(lon, 6) = 105.804817, false)""")
def filter_located(spark, sf_dir):
    k = F.col("listing_id")
    lat = F.when(k % 10 == 0, None).when(k % 7 == 0, F.lit(10.77)).when(k % 6 == 0, F.lit(21.028511)).otherwise(F.col("lat"))
    d = listings(spark, sf_dir).select("listing_id", F.when(k % 4 != 0, F.col("district")).alias("district"), lat.alias("lat"), F.when(k % 6 == 0, F.lit(105.804817)).otherwise(F.col("lon")).alias("lon"))
    return L.off_fallback_point(L.located(d, G.coordinate_issue(F.col("lat"), F.col("lon")))).select("listing_id")


@query("filter_in_city", "SELECT c_custkey FROM customer WHERE contains(lower(c_mktsegment), 'build') OR contains(lower(c_mktsegment), 'auto')")
def filter_in_city(spark, sf_dir):
    return L.in_city(table(spark, sf_dir, "customer"), "c_mktsegment", ("build", "auto")).select("c_custkey")

"""Driver tables and the listing-shaped views over them, in DataFrame and SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as rooms, with amenity counts from lineitem and derived distance, age and value."""
    part = table(spark, sf_dir, "part")
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    k = F.col("p_partkey")
    return part.join(counts, "p_partkey", "left").select(
        k.alias("listing_id"), F.col("p_type").alias("house_type"), F.col("p_brand").alias("district"),
        F.when(k % 9 != 0, F.col("p_size").cast("double")).alias("area"), F.col("p_retailprice").alias("price"),
        F.coalesce("n", F.lit(0)).alias("amenity_count"), (k * 7919 % 2000 / 100).alias("distance_km"),
        F.when(k % 13 != 0, k * 31 % 400 / 10 - 20).alias("value_pct"), F.concat_ws("|", "p_brand", F.col("p_size").cast("string")).alias("building"),
        F.when(k % 17 != 0, k * 37 % 400).alias("days_old"), (k % 11 == 0).alias("is_shared"), (k % 2).cast("int").alias("balcony"),
        (k % 3 == 0).cast("int").alias("q_has_address"), (F.lit(20.90) + k * 7919 % 2000 / 10000).alias("lat"), (F.lit(105.70) + k * 104729 % 2000 / 10000).alias("lon"),
    )


LISTINGS = """am AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey),
listings AS (
  SELECT p_partkey AS listing_id, p_type AS house_type, p_brand AS district, CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_size AS DOUBLE) END AS area, p_retailprice AS price,
    coalesce(n, 0) AS amenity_count, CAST(p_partkey * 7919 % 2000 AS DOUBLE) / 100 AS distance_km,
    CASE WHEN p_partkey % 13 <> 0 THEN CAST(p_partkey * 31 % 400 AS DOUBLE) / 10 - 20 END AS value_pct, p_brand || '|' || p_size AS building,
    CASE WHEN p_partkey % 17 <> 0 THEN p_partkey * 37 % 400 END AS days_old, p_partkey % 11 = 0 AS is_shared, CAST(p_partkey % 2 AS INTEGER) AS balcony,
    CAST(p_partkey % 3 = 0 AS INTEGER) AS q_has_address, CAST(20.90 AS DOUBLE) + CAST(p_partkey * 7919 % 2000 AS DOUBLE) / 10000 AS lat,
    CAST(105.70 AS DOUBLE) + CAST(p_partkey * 104729 % 2000 AS DOUBLE) / 10000 AS lon
  FROM part LEFT JOIN am ON p_partkey = l_partkey)"""

"""Sources: file scans with schemas kept, tolerant JSON, nested payloads, source adapters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def require_columns(d: DataFrame, names: list[str]) -> DataFrame:
    """d, or an error that names what is missing."""
    missing = [n for n in names if n not in d.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return d


def parquet_last_wins(spark: SparkSession, pattern: str, key: str) -> DataFrame:
    """All files that match, columns merged; of rows with one key the last by file name stays."""
    rows = spark.read.option("mergeSchema", True).parquet(pattern).withColumn("file_", F.col("_metadata.file_path"))
    rows = rows.withColumn("at_", F.monotonically_increasing_id())
    w = Window.partitionBy(key).orderBy(F.col("file_").desc(), F.col("at_").desc())
    return rows.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_", "file_", "at_")


def csv_text(spark: SparkSession, path: str, columns: list[str], source_file: bool = True) -> DataFrame:
    """CSV with a header, every column as text (leading zeros survive), a byte-order mark passed over."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    d = spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"').option("enforceSchema", True).csv(path)
    return d.withColumn("source_file", F.element_at(F.split("_metadata.file_path", "/"), -1)) if source_file else d


def json_array(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """One object per line; blank and broken lines are passed over."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def latest_cache(spark: SparkSession, path: str, schema, key: str, seq: str) -> DataFrame:
    """An append-only cache: each key's latest record."""
    d = json_lines(spark, path, schema)
    others = [c for c in d.columns if c != key]
    latest = d.groupBy(key).agg(F.max_by(F.struct(*others), F.col(seq)).alias("x"))
    return latest.select(key, "x.*")


def gzip_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(listing_id, html) of gzipped pages named by their id; the text source unpacks them."""
    d = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.html.gz").text(folder)
    return d.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.html\.gz$", 1).alias("listing_id"), F.col("value").alias("html"))


def geojson_rings(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(name, ring) of polygon features: the outer ring's (lon, lat) pairs."""
    schema = "features array<struct<properties map<string, string>, geometry struct<type string, coordinates array<array<array<double>>>>>>"
    d = spark.read.schema(schema).option("multiLine", True).json(path)
    return d.select(F.explode("features").alias("f")).select(F.col("f.properties")[name].alias("name"), F.get("f.geometry.coordinates", F.lit(0)).alias("ring"))


# Columns of the canonical advert and of the social post.
CANONICAL = ["listing_id", "platform", "url", "title", "description", "house_type", "price", "area", "address", "district", "ward", "lat", "lon", "posted_at", "phone", "images"]
POST = ["post_id", "post_url", "group_url", "timestamp_text", "timestamp", "text", "reaction_count", "comment_count", "share_count", "image_urls", "video_urls", "crawl_time"]

ADAPTERS: dict[str, dict[str, str]] = {}


def register_adapter(platform: str, mapping: dict[str, str]) -> None:
    """mapping: canonical column to an SQL expression over the platform's own columns."""
    unknown = set(mapping) - set(CANONICAL)
    if unknown:
        raise ValueError(f"not canonical: {sorted(unknown)}")
    ADAPTERS[platform] = mapping


def adapted(d: DataFrame, platform: str) -> DataFrame:
    """A platform's rows as canonical ones, ids prefixed once, missing columns null."""
    mapping = ADAPTERS[platform]
    out = d.select(*[(F.expr(mapping[c]) if c in mapping else F.lit(None).cast("string")).cast("string").alias(c) for c in CANONICAL if c != "platform"], F.lit(platform).alias("platform"))
    return out.withColumn("listing_id", prefixed(F.col("listing_id"), platform.split(".")[0].lower() + "_")).select(CANONICAL)


def prefixed(c: Column, prefix: str) -> Column:
    return F.when(F.startswith(c, F.lit(prefix)), c).otherwise(F.concat(F.lit(prefix), c))


def merged(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def normalized_post(d: DataFrame) -> DataFrame:
    """A raw social post: canonical URL, id, text and counts, media links once each in order."""
    from ..functions import text as T

    url = T.normalize_url(F.col("post_url"))
    media = lambda c: F.array_distinct(F.filter(F.transform(F.col(c), lambda x: F.trim(x)), lambda x: x != ""))
    return d.select(
        F.coalesce("post_id", T.extract_post_id(F.col("post_url"))).alias("post_id"), url.alias("post_url"), T.normalize_url(F.col("group_url")).alias("group_url"),
        "timestamp_text", "timestamp", T.post_text(F.col("text")).alias("text"), *[T.parse_count(F.col(c)).alias(c) for c in ("reaction_count", "comment_count", "share_count")],
        media("image_urls").alias("image_urls"), media("video_urls").alias("video_urls"), "crawl_time",
    )


def post_identity(d: DataFrame) -> Column:
    """URL, else id, else a digest of text and time."""
    digest = F.sha2(F.concat_ws("␟", F.coalesce("text", F.lit("")), F.coalesce("timestamp_text", F.lit(""))), 256)
    return F.coalesce(F.nullif("post_url", F.lit("")), F.nullif("post_id", F.lit("")), digest)


def complete_cases(d: DataFrame, columns: list[str], unknown: tuple[str, ...] = ("", "none", "null", "nan", "chưa rõ", "$undefined", "undefined")) -> DataFrame:
    """Rows in which every column says something."""
    return d.where(reduce(lambda a, b: a & b, [F.coalesce(~F.lower(F.trim(F.col(c).cast("string"))).isin(*unknown), F.lit(False)) for c in columns]))


class UrlFiles:
    """A crawl frontier read from local files: what a fetch source would hand on, without a network.

    Page numbers are the partitions; a robots rule and the retry schedule are plain functions.
    """

    @staticmethod
    def allowed(path: str, disallow: list[str]) -> bool:
        return not any(path.startswith(rule) for rule in disallow if rule)

    @staticmethod
    def is_challenge(html: str, signs: tuple[str, ...] = ("captcha", "verify you are human", "cf-challenge")) -> bool:
        low = html.lower()
        return any(s in low for s in signs)


def frontier_next(state: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages still to walk: after the last completed page of each slice that is not exhausted."""
    joined = pages.join(state.select("slice", "last_page", "exhausted"), "slice", "left")
    return joined.where(~F.coalesce("exhausted", F.lit(False)) & (F.col("page") > F.coalesce("last_page", F.lit(0)))).select(pages.columns)

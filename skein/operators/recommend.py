"""Filter-then-rank recommendations over a listings table.

A listings table has listing_id, price, typical_price, house_type, district, area,
amenity_count, distance_km, value_pct, building, days_old, is_shared; the
functions here add the derived ones. Filters come first and reach the scan; the
ranks run over what survives.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import with_quantile_bin, with_rank_share
from ..functions.parsers import DISTRICTS, district_core
from ..functions.text import ascii_fold
from . import filters
from .entity import address_key, first_of

# Hand-set weights of the score's parts.
WEIGHTS = {"price": 0.30, "value": 0.25, "distance": 0.25, "amenity": 0.20}
MIN_TYPICAL_GROUP = 30
WHOLE_HOUSE = "Nhà nguyên căn"
BUDGET_ANCHOR, DEAR_SLOPE = 0.7, 0.5


@dataclass
class Search:
    budget: float
    districts: tuple[str, ...] = ()
    min_area: float | None = None
    need: tuple[str, ...] = ()
    max_km: float | None = None
    house_type: str | None = None
    top: int = 10
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    include_shared: bool = False
    per_building: int = 1
    max_days_old: int | None = None
    whole_house: bool = False


def with_typical_price(d: DataFrame, min_group: int = MIN_TYPICAL_GROUP) -> DataFrame:
    """Median price of kind and district, of the kind alone for small groups, of all rows at last.

    Groups are aggregated and joined back; null keys form no group.
    """
    both = d.where("house_type is not null and district is not null").groupBy("house_type", "district").agg(F.median("price").alias("m2_"), F.count("price").alias("n2_"))
    one = d.where("house_type is not null").groupBy("house_type").agg(F.median("price").alias("m1_"))
    whole = d.agg(F.median("price").alias("m0_"))
    out = d.join(both, ["house_type", "district"], "left").join(one, "house_type", "left").crossJoin(F.broadcast(whole))
    typical = F.coalesce(F.when(F.col("n2_") >= min_group, F.col("m2_")).otherwise(F.col("m1_")), F.col("m0_"))
    return out.withColumn("typical_price", typical).drop("m0_", "m1_", "m2_", "n2_")


def with_imputed_area(d: DataFrame) -> DataFrame:
    """area_est: the area, else the median of its kind and price quintile, else of all; area_imputed says so."""
    binned = with_quantile_bin(d.withColumn("kind_", F.coalesce("house_type", F.lit(""))), "price", "bin_")
    medians = binned.where("bin_ is not null").groupBy(F.col("kind_").alias("k2_"), F.col("bin_").alias("b2_")).agg(F.median("area").alias("m_"))
    whole = d.agg(F.median("area").alias("m0_"))
    out = binned.join(medians, (F.col("kind_") == F.col("k2_")) & (F.col("bin_") == F.col("b2_")), "left").crossJoin(F.broadcast(whole))
    return out.withColumn("area_imputed", F.col("area").isNull()).withColumn("area_est", F.coalesce("area", "m_", "m0_")).drop("kind_", "bin_", "k2_", "b2_", "m_", "m0_")


# Patterns of titles and descriptions that hand a contract on, or want women only.
SUBLET = r"\bpass\b|nhượng|sang lại|sang nhượng"
WOMEN_ONLY = r"cho nữ|nữ thuê|chỉ nữ|chỉ nhận nữ|ưu tiên nữ"
#: Characters of a description that the quality marks read.
DESCRIPTION_CHARS = 400
#: Wards that the addresses of one point may name before the point counts as a geocoder's fallback.
FALLBACK_WARDS = 5
WARD_NAME = r"(?:Phường|Xã|Thị trấn) ([^,]+)"


def with_quality_marks(d: DataFrame, districts: tuple[str, ...] = DISTRICTS) -> DataFrame:
    """d with q_not_sublet, q_any_gender, q_has_address, q_district_ok: 1.0 where there is no doubt.

    The last is 0 if the address or title names districts of the list as whole words,
    and the row's own is none of them. Null texts count as empty.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    said = F.lower(F.concat_ws(" ", text("title"), F.substring(text("description"), 1, DESCRIPTION_CHARS)))
    where = ascii_fold(F.concat_ws(" ", text("address"), text("title")))
    named = F.filter(F.array(*map(F.lit, districts)), lambda n: F.regexp_like(where, F.concat(F.lit(r"(?<!\w)"), district_core(n), F.lit(r"(?!\w)"))))
    mark = lambda c: F.when(c, 1.0).otherwise(0.0)
    return (
        d.withColumn("q_not_sublet", mark(~F.regexp_like(said, F.lit(SUBLET)))).withColumn("q_any_gender", mark(~F.regexp_like(said, F.lit(WOMEN_ONLY))))
        .withColumn("q_has_address", mark(address_key(F.col("address")) != ""))
        .withColumn("q_district_ok", mark((F.size(named) == 0) | F.coalesce(F.array_contains(named, F.col("district")), F.lit(False))))
    )


def without_fallback_points(d: DataFrame, columns: tuple[str, ...] = ("lat", "lon", "district", "ward")) -> DataFrame:
    """d with geo_suspect, and what came from a fallback point blanked: its rows' addresses name many wards."""
    ward = F.nullif(F.trim(F.regexp_extract("address", WARD_NAME, 1)), F.lit(""))
    wards = d.where("lat is not null and lon is not null").groupBy(F.col("lat").alias("y_"), F.col("lon").alias("x_")).agg(F.countDistinct(ward).alias("wards_"))
    marked = d.join(wards, (d.lat == wards.y_) & (d.lon == wards.x_), "left").withColumn("geo_suspect", F.coalesce(F.col("wards_") >= FALLBACK_WARDS, F.lit(False))).drop("y_", "x_", "wards_")
    return filters.blanked(marked, F.col("geo_suspect"), list(columns))


def prepared(d: DataFrame, order: list[Column], districts: tuple[str, ...] = DISTRICTS) -> DataFrame:
    """The listings table that searches run over, each step on what the one before left.

    One row per listing_id (the first by order), none that repeats another room, none
    without a price; fallback points blanked; area estimated unless it has been;
    typical price, shared rooms and quality marks.
    """
    rows = first_of(d, ["listing_id"], order).where("duplicate_of is null and price is not null")
    rows = without_fallback_points(rows)
    if "area_est" not in rows.columns:
        rows = with_imputed_area(rows)
    rows = with_typical_price(rows).withColumn("is_shared", filters.is_shared(F.col("title"), F.col("price")))
    return with_quality_marks(rows, districts)


def price_score(price: Column, typical: Column, budget: float | Column) -> Column:
    """1 at the reference price; proportional below it, falling gently towards the budget above it."""
    budget = budget if isinstance(budget, Column) else F.lit(float(budget))
    ref = F.least(F.greatest(typical, budget * BUDGET_ANCHOR), budget)
    dear = F.lit(1.0) - F.lit(DEAR_SLOPE) * (price - ref) / F.greatest(budget - ref, F.lit(1.0))
    return F.when(price < ref, F.least(price / ref, F.lit(1.0))).otherwise(dear)


def hard_filters(d: DataFrame, s: Search) -> DataFrame:
    """The rows that a search admits; unknown area and age are admitted."""
    keep = F.col("price") <= s.budget
    if not (s.whole_house or "nguyên căn" in (s.house_type or "").lower()):
        keep &= F.coalesce(F.col("house_type") != WHOLE_HOUSE, F.lit(True))
    if not s.include_shared:
        keep &= ~F.col("is_shared")
    if s.districts:
        keep &= F.col("district").isin(*s.districts)
    if s.min_area:
        keep &= F.col("area").isNull() | (F.col("area") >= s.min_area)
    for flag in s.need:
        keep &= F.col(flag) == 1
    if s.max_km:
        keep &= F.col("distance_km") <= s.max_km
    if s.house_type:
        keep &= F.contains(F.lower(F.coalesce("house_type", F.lit(""))), F.lit(s.house_type.lower()))
    if s.max_days_old is not None:
        keep &= F.col("days_old").isNull() | (F.col("days_old") <= s.max_days_old)
    return d.where(keep)


def scored(d: DataFrame, s: Search) -> DataFrame:
    """s_price, s_value, s_distance, s_amenity and their weighted sum, score, rounded half-even to 3 digits."""
    m = with_rank_share(with_rank_share(with_rank_share(d, "value_pct", "rv_"), "distance_km", "rd_"), "amenity_count", "s_amenity")
    m = m.withColumn("s_price", price_score(F.col("price"), F.col("typical_price"), s.budget)).withColumn("s_value", 1 - F.col("rv_")).withColumn("s_distance", 1 - F.col("rd_"))
    w = s.weights
    score = w["price"] * F.col("s_price") + w["value"] * F.col("s_value") + w["distance"] * F.col("s_distance") + w["amenity"] * F.col("s_amenity")
    for name, weight in w.items():
        if name.startswith("q_") and name in m.columns:
            score += weight * F.col(name)
    return m.withColumn("score", F.bround(score, 3)).drop("rv_", "rd_")


def capped_per_building(d: DataFrame, most: int) -> DataFrame:
    """At most so many rows of a building, the best first; rows without a building are exempt."""
    w = Window.partitionBy("building").orderBy(F.col("score").desc(), F.col("listing_id"))
    return d.withColumn("rn_", F.row_number().over(w)).where((F.coalesce("building", F.lit("")) == "") | (F.col("rn_") <= most)).drop("rn_")


def recommend(d: DataFrame, s: Search) -> DataFrame:
    """The search's top rows, best first; ties go to the smaller id."""
    out = scored(hard_filters(d, s), s)
    if s.per_building:
        out = capped_per_building(out, s.per_building)
    return out.orderBy(F.col("score").desc(), F.col("listing_id")).limit(s.top)


def ndcg(votes: DataFrame, group: list[str], score: str, label: str, tie: str, k: int = 10) -> DataFrame:
    """Per group: NDCG at k with gain 0 or 1; null where nothing is relevant."""
    by_score, by_label = Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(tie)), Window.partitionBy(*group).orderBy(F.col(label).desc(), F.col(tie))
    ranked = votes.withColumn("r_", F.row_number().over(by_score)).withColumn("i_", F.row_number().over(by_label))
    gain = lambda rank: F.sum(F.when(F.col(rank) <= k, F.col(label) / F.log2(F.col(rank) + 1)).otherwise(0.0))
    return ranked.groupBy(*group).agg((gain("r_") / F.nullif(gain("i_"), F.lit(0.0))).alias("ndcg"))


def precision_at(votes: DataFrame, group: list[str], score: str, label: str, tie: str, k: int = 5) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(tie))
    return votes.withColumn("r_", F.row_number().over(w)).where(F.col("r_") <= k).groupBy(*group).agg(F.avg(F.col(label).cast("double")).alias("precision"))


def random_ndcg(votes: DataFrame, group: list[str], label: str, k: int = 10) -> DataFrame:
    """Expected NDCG of a random order, in closed form: the mean label times the discounts, over the ideal gain."""
    n = votes.groupBy(*group).agg(F.count("*").cast("int").alias("n"), F.sum(label).cast("int").alias("p"))
    discounts = lambda m: F.aggregate(F.sequence(F.lit(1), m), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    ideal = F.when(F.col("p") > 0, discounts(F.least(F.col("p"), F.lit(k))))
    return n.select(*group, ((F.col("p") / F.col("n")) * discounts(F.least(F.col("n"), F.lit(k))) / ideal).alias("expected_ndcg"))

"""Admission rules for adverts: plausible numbers, kinds of property, shared rooms, noisy labels, expired pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_fold, keyword_flag

# Words of titles that name something other than a room.
FORBIDDEN = [
    "biệt thự", "villa", "shophouse", "nhà liền kề", "nhà phố", "nhà mặt tiền", "nhà nguyên căn", "nguyên căn", "thuê nguyên căn", "nhà riêng nguyên căn",
    "nhà 3 tầng", "nhà 4 tầng", "nhà 5 tầng", "mặt bằng", "mặt bằng kinh doanh", "mbkd", "văn phòng", "kho xưởng", "nhà kho", "nhà xưởng", "kiot", "kí ốt",
    "cửa hàng", "trang trại", "đất nền", "bán đất", "bán nhà", "căn hộ cao cấp", "chung cư cao cấp", "penthouse", "duplex", "condotel",
    "2 phòng ngủ", "3 phòng ngủ", "4 phòng ngủ", "2pn", "3pn", "4pn",
]
# With a word of rooms and one of place in the title, a forbidden word only tells where the room is.
ROOM_WORDS = ["ở ghép", "phòng trọ", "nhà trọ", "ccmn", "phòng"]
PLACE_WORDS = ["gần", "cạnh", "đối diện", "sau", "trong khu", "view"]
# Patterns of lower-cased titles that tell a bed's price from a room's.
SHARED = r"ghép|slot|giường|home ?stay|sleep ?box|1 người|/ ?người|\d ?/ ?ng\b|\bshare\b"
DORM = r"ký túc xá|ktx"
# Patterns of folded titles that tell another price from a room's.
PRICE_RANGE = r"(?<!\w)\d[\d.,]*\s*(?:tr|trieu|k|m)?\s*(?:-|–|~|den)\s*\d[\d.,]*\s*(?:tr|trieu|k|m)\b|\btu\s+\d[\d.,]*\s*(?:tr|trieu|k)"
PER_PERSON = r"/\s*(?:nguoi|ng|giuong|bed|slot)\b|\b1\s*nguoi\b|\bo ghep\b|\bghep\b|homestay|sleep ?box|\bktx\b|ky tuc"
SUBLET = r"\bpass\b|nhuong|sang lai"
WHOLE_HOUSE = r"nguyen can|nha rieng|ca nha|nha \d+ tang"
DORM_PRICE = 2_500_000
MAX_AGE_DAYS = 180


def plausible_price(price: Column, title: Column, not_room: str | None = None, least: float = 500_000, most: float = 50_000_000) -> Column:
    """Price within inclusive bounds and a title that does not begin like something else."""
    kind = F.coalesce(~F.regexp_like(title, F.lit(f"(?i)^(?:{not_room})")), F.lit(True)) if not_room else F.lit(True)
    return F.coalesce(price.between(least, most), F.lit(False)) & kind


def positive_or_null(c: Column) -> Column:
    return F.when(c > 0, c)


def room_validity(title: Column, price: Column, max_price: float | None = None, price_text: Column | None = None, allow_negotiable: bool = True) -> Column:
    """struct<valid, reason>: with a maximum, a known, positive price up to it; and no forbidden word as a whole word, but as a place.

    price_text: what stands where a price is no number, such as "to be agreed on".
    """
    t = F.lower(F.coalesce(title, F.lit("")))
    reason = F.lit(None).cast("string")
    if max_price is not None:
        spoken = price_text.isNotNull() if price_text is not None else F.lit(False)
        missing = F.when(spoken, F.lit(None) if allow_negotiable else F.lit("price to be agreed on")).otherwise(F.lit("price missing"))
        reason = F.when(price.isNull(), missing).when(price <= 0, F.lit("price not positive")).when(price > max_price, F.lit("price too high"))
    word = F.get(F.filter(F.array(*map(F.lit, FORBIDDEN)), lambda w: F.contains(t, w) & F.regexp_like(t, F.concat(F.lit(r"(?<![\p{L}\p{N}])"), w, F.lit(r"(?![\p{L}\p{N}])")))), F.lit(0))
    as_place = keyword_flag(t, ROOM_WORDS) & keyword_flag(t, PLACE_WORDS)
    reason = F.coalesce(reason, F.when(word.isNotNull() & ~as_place, F.concat(F.lit("title: "), word)))
    return F.struct(reason.isNull().alias("valid"), reason.alias("reason"))


def expired(html: Column, signs: list[str], banner: str | None = None, phrase: str | None = None) -> Column:
    """A sign of an expired advert, or a banner class together with a phrase."""
    low = F.lower(F.coalesce(html, F.lit("")))
    found = keyword_flag(low, signs)
    return found | (F.contains(low, F.lit(banner)) & F.contains(low, F.lit(phrase))) if banner else found


def is_shared(title: Column, price: Column) -> Column:
    """Adverts of a bed: by words, or a dormitory at a bed's price."""
    t = F.lower(F.coalesce(title, F.lit("")))
    return F.regexp_like(t, F.lit(SHARED)) | (F.regexp_like(t, F.lit(DORM)) & F.coalesce(price < DORM_PRICE, F.lit(False)))


def noise_flags(title: Column, house_type: Column, area: Column) -> dict[str, Column]:
    """Reasons to doubt that a price is one room's rent, from the title alone; floor numbers are taken out first."""
    t = F.regexp_replace(ascii_fold(F.coalesce(title, F.lit(""))), r"tang\s*\d+", " ")
    like = lambda p: F.regexp_like(t, F.lit(p))
    room = F.coalesce(house_type.isin("Phòng trọ", "Studio"), F.lit(False))
    mismatch = room & (F.coalesce(area >= 60, F.lit(False)) | F.regexp_like(ascii_fold(F.coalesce(title, F.lit(""))), F.lit(WHOLE_HOUSE)))
    return {"price_range": like(PRICE_RANGE), "per_person": like(PER_PERSON), "sublet": like(SUBLET), "mismatch": mismatch}


def not_stale(d: DataFrame, age: str = "days_old", most: int = MAX_AGE_DAYS) -> DataFrame:
    """Rows of unknown age stay."""
    return d.where(~F.coalesce(F.col(age) > most, F.lit(False)))


def blanked(d: DataFrame, bad: Column, columns: list[str], prefixes: tuple[str, ...] = ("distance_to_", "nearest_"), suffix: str = "proximity_tier") -> DataFrame:
    """d with coordinates, and all that was derived from them, null where bad."""
    targets = {c for c in d.columns if c in columns or c.startswith(prefixes) or c.endswith(suffix)}
    return d.select(*[F.when(~F.coalesce(bad, F.lit(False)), F.col(c)).alias(c) if c in targets else F.col(c) for c in d.columns])


# The box, prices and areas of the spatial analysis; a point that a geocoder falls back to.
ANALYSIS_LAT, ANALYSIS_LON, ANALYSIS_PRICE, ANALYSIS_AREA = (20.7, 21.4), (105.6, 106.1), (500_000, 25_000_000), (8, 120)
FALLBACK_POINT = (21.028511, 105.804817)


def with_price_and_area(d: DataFrame, price: str = "price", area: str = "area") -> DataFrame:
    return d.na.drop(subset=[price, area])


def for_spatial_analysis(d: DataFrame, districts: tuple[str, ...], price=ANALYSIS_PRICE, area=ANALYSIS_AREA, lat=ANALYSIS_LAT, lon=ANALYSIS_LON) -> DataFrame:
    """Rows of the listed districts with coordinates, price and area within inclusive bounds; unknown ones go."""
    within = F.col("lat").between(*lat) & F.col("lon").between(*lon) & F.col("price").between(*price) & F.col("area").between(*area)
    return d.where(within & F.col("district").isin(*districts))


def off_fallback_point(d: DataFrame, point: tuple[float, float] = FALLBACK_POINT, digits: int = 6) -> DataFrame:
    """Rows that are not exactly on the fallback point; those without coordinates stay."""
    on = (F.round("lat", digits) == point[0]) & (F.round("lon", digits) == point[1])
    return d.where(~F.coalesce(on, F.lit(False)))


def located(d: DataFrame, issue: Column) -> DataFrame:
    """Rows that a district or a usable coordinate places in the city; issue: see coordinate_issue."""
    return d.where((issue.isNull() | ((issue == "missing") & F.col("district").isNotNull())))


def in_city(d: DataFrame, column: str, names: tuple[str, ...] = ("hà nội", "ha noi", "hanoi")) -> DataFrame:
    """Rows whose text names the city."""
    return d.where(keyword_flag(F.lower(F.coalesce(F.col(column), F.lit(""))), list(names)))


def training_rows(d: DataFrame) -> DataFrame:
    """Rows that a price model may learn from: one per room, not shared, with a price."""
    return d.where(F.col("duplicate_of").isNull() & ~F.coalesce(F.col("is_shared"), F.lit(False)) & F.col("price").isNotNull())

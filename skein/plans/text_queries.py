"""Queries over text functions, parsers, HTML and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import parsers as P
from ..functions import text as T
from .catalogue import query
from .tables import LISTINGS, listings, table

# Sample strings for the parsers.
NAMES = ["Quận Đống Đa", "dong da", "CẦU GIẤY", "huyện sóc sơn", "Chưa rõ", "Thị xã Sơn Tây", "tx. sơn tây", "Cầu Giấy, Bắc Từ Liêm", "  Q. Ba  Đình "]
PRICES = ["3,5 triệu/tháng", "3tr5", "5 triệu 500", "350 nghìn", "3.500.000 đ", "Thỏa thuận", "liên hệ", "2 triệu", "abc", "2tr", "1200k"]
RENTS = ["3tr500", "2,5 triệu", "2.4 - 3 triệu", "3500k", "3.500.000", "4 triệu", "3k/số", "200000", "12tr5", "1.800k", "xx triệu", "2tr"]
AREAS = ["20 - 27", "25", "25,5 m2", "27-20", "abc", "0", "30m²", " 18 ", "12.5 ~ 14"]
TARIFFS = ["3.500đ/số", "3k", "giá nhà nước", "miễn phí", "3k-4k", "100.000 - 120.000", "4000", "theo đồng hồ"]
DATES = ["05/03/2024", "Ngày đăng: 7/11/2023", "2024-02-29T10:00:00Z", "2024-01-02", "yesterday"]
COUNTS = ["1.2K", "3K", "2.5M", "1,234", "1,2K", "12 lượt", "none", "4 tr", "7"]
AMENITIES = ["phong khep kin, co ban cong va may giat", "khong chung chu, gio giac tu do, thang may", "chung chu, cho de xe", "trong", "full noi that, dieu hoa, nong lanh, tu lanh"]
KINDS = ["Phòng trọ khép kín", "Nhà nguyên căn 3 tầng", "CCMN mới", "studio cao cấp", "Căn hộ 2 phòng ngủ", "2pn", "homestay", "đất nền"]
PHONES = ["0917831531", "917831531", "+84 917 831 531", "84917831531", "0123", "a1b2c3d4e5f60718", "091-783-1531"]
URLS = ["https://WWW.Example.com/a/b/?x=1#y", "http://m.site.vn/path/", "ftp://no", "https://host", "https://www.facebook.com/groups/12/posts/345/"]


def _values(column: str, strings: list[str]) -> str:
    told = ", ".join("('" + s.replace("'", "''") + "')" for s in strings)
    return f"(VALUES {told}) AS t({column})"


def _frame(spark, strings: list[str], column: str = "s"):
    return spark.createDataFrame([(s,) for s in strings], f"{column} string")


_FOLD = "trim(regexp_replace(lower(strip_accents(replace(replace({c}, 'đ', 'd'), 'Đ', 'D'))), '\\s+', ' ', 'g'))"


@query("text_fold", f"SELECT doc_id, {_FOLD.format(c='text')} AS folded FROM documents WHERE text IS NOT NULL")
def text_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.fold(F.col("text")).alias("folded"))


@query("text_normalize", r"""SELECT doc_id, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{2500}-\x{25FF}]+', '', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '[ \t]+', ' ', 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS clean FROM documents""")
def text_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("clean"))


@query("text_normalize_composed")
def text_normalize_composed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_text(F.col("text"), compose=True).alias("clean"))


@query("text_slug", f"SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def text_slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query("text_redact")
def text_redact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.redact_phones(F.col("text")).alias("redacted"))


@query("text_strip_digits", "SELECT doc_id, regexp_replace(lower(strip_accents(replace(replace(substr(text, 1, 600), 'đ', 'd'), 'Đ', 'D'))), '[0-9]', ' ', 'g') AS digit_free FROM documents WHERE text IS NOT NULL")
def text_strip_digits(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.digit_free(F.col("text")).alias("digit_free"))


@query("text_keyword_flags", "SELECT doc_id, contains(text, 'licens') OR contains(text, 'Licens') AS licensed, contains(text, 'http') AS links FROM documents")
def text_keyword_flags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.keyword_flag(F.col("text"), ["licens", "Licens"]).alias("licensed"), T.keyword_flag(F.col("text"), ["http"]).alias("links"))


def _amenity_sql() -> str:
    cols = []
    for key, words in P.AMENITIES.items():
        told = " OR ".join(f"contains(s, '{w}')" for w in words)
        negative = next((n for n, p in P.NEGATIONS.items() if p == key), None)
        veto = " AND NOT (" + " OR ".join(f"contains(s, '{w}')" for w in P.AMENITIES[negative]) + ")" if negative else ""
        cols.append(f"({told}){veto} AS {key}")
    return f"SELECT s, {', '.join(cols)} FROM {_values('s', AMENITIES)}"


@query("text_negation_flags", _amenity_sql())
def text_negation_flags(spark, sf_dir):
    return _frame(spark, AMENITIES).select("s", *[c.alias(k) for k, c in P.amenity_flags(F.col("s")).items()])


_KIND_SQL = " ".join(f"WHEN regexp_matches(f, '{p}') THEN '{label}'" for p, label in P.HOUSE_TYPES)


@query("text_first_match_class", f"SELECT s, CASE {_KIND_SQL} ELSE 'Khác' END AS kind FROM (SELECT s, {_FOLD.format(c='s')} AS f FROM {_values('s', KINDS)})")
def text_first_match_class(spark, sf_dir):
    return _frame(spark, KINDS).select("s", T.first_match(T.fold(F.col("s")), P.HOUSE_TYPES, "Khác").alias("kind"))


@query("text_count_suffix", f"""WITH v AS (SELECT s, lower(trim(s)) AS t FROM {_values('s', COUNTS)}), p AS (SELECT s, regexp_extract(t, '^[^0-9]*?([0-9][0-9.,]*)', 1) AS n, regexp_extract(t, '^[^0-9]*?[0-9][0-9.,]*\\s*(tr|ty|[knmbt])(?:$|[^\\p{{L}}])', 1) AS u FROM v)
SELECT s, CAST(CASE WHEN n = '' THEN NULL WHEN u <> '' THEN round(TRY_CAST(replace(n, ',', '.') AS DOUBLE) * CASE u WHEN 'tr' THEN 1e6 WHEN 'ty' THEN 1e9 WHEN 'k' THEN 1e3 WHEN 'n' THEN 1e3 WHEN 'm' THEN 1e6 ELSE 1e9 END) ELSE TRY_CAST(regexp_replace(n, '[.,]', '', 'g') AS BIGINT) END AS BIGINT) AS n FROM p""")
def text_count_suffix(spark, sf_dir):
    return _frame(spark, COUNTS).select("s", T.parse_count(F.col("s")).alias("n"))


@query("text_bool_spellings", "SELECT s, coalesce(lower(trim(s)) IN ('true', 't', '1', 'yes', 'có'), false) AS flag, CASE WHEN lower(trim(s)) IN ('nan', 'none', 'null') THEN '' ELSE trim(s) END AS known FROM (VALUES (' True '), ('có'), ('0'), ('nan'), ('NULL'), ('1')) AS t(s)")
def text_bool_spellings(spark, sf_dir):
    return _frame(spark, [" True ", "có", "0", "nan", "NULL", "1"]).select("s", T.to_bool(F.col("s")).alias("flag"), T.clean_unknown(F.col("s")).alias("known"))


def _district_sql() -> str:
    pairs = ", ".join(f"('{d}')" for d in P.DISTRICTS)
    core = lambda c: f"regexp_replace({_FOLD.format(c=c)}, '^(?:quan|huyen|thi xa|tx|q)\\.?\\s+', '')"
    return f"""WITH d AS (SELECT u, {core('u')} AS k FROM (VALUES {pairs}) AS t(u)), v AS (SELECT s, {core('s')} AS k FROM {_values('s', NAMES)})
SELECT s, u AS district, regexp_replace(u, '^(?:Quận|Huyện|Thị xã)\\s+', '') AS short FROM v LEFT JOIN d USING (k)"""


@query("text_districts", _district_sql())
def text_districts(spark, sf_dir):
    return _frame(spark, NAMES).select("s", P.normalize_district(F.col("s")).alias("district"), P.short_district(F.col("s")).alias("short"))


@query("parse_rent_vnd")
def parse_rent_vnd(spark, sf_dir):
    p = P.parse_price_vnd(F.col("s"))
    return _frame(spark, PRICES).select("s", p["value"].alias("value"), p["negotiable"].alias("negotiable"))


@query("parse_rent_normal")
def parse_rent_normal(spark, sf_dir):
    return _frame(spark, RENTS).select("s", P.normalize_rent(F.col("s")).alias("rent"))


@query("parse_rent_list")
def parse_rent_list(spark, sf_dir):
    return _frame(spark, [*RENTS, "Giá 2,4-3tr, cọc 1 tháng 2500k, sdt 0917831531"]).select("s", P.extract_rents(F.col("s")).alias("rents"))


_NUM = "(\\d+(?:[.,]\\d+)?)"


@query("parse_area_range", f"""WITH v AS (SELECT s, lower(trim(s)) AS t FROM {_values('s', AREAS)}), p AS (SELECT s, TRY_CAST(replace(regexp_extract(t, '^{_NUM}\\s*(?:-|–|~|đến)\\s*{_NUM}\\s*(?:m2|m²)?$', 1), ',', '.') AS DOUBLE) AS a, TRY_CAST(replace(regexp_extract(t, '^{_NUM}\\s*(?:-|–|~|đến)\\s*{_NUM}\\s*(?:m2|m²)?$', 2), ',', '.') AS DOUBLE) AS b, TRY_CAST(replace(regexp_extract(t, '^{_NUM}\\s*(?:m2|m²)?$', 1), ',', '.') AS DOUBLE) AS n FROM v),
r AS (SELECT s, coalesce(CASE WHEN a IS NOT NULL THEN least(a, b) END, n) AS lo, coalesce(CASE WHEN a IS NOT NULL THEN greatest(a, b) END, n) AS hi FROM p)
SELECT s, CASE WHEN lo > 0 THEN lo END AS lo, CASE WHEN lo > 0 THEN hi END AS hi, CASE WHEN lo > 0 THEN (lo + hi) / 2 END AS middle FROM r""")
def parse_area_range(spark, sf_dir):
    a = P.parse_area(F.col("s"))
    return _frame(spark, AREAS).select("s", a["lo"].alias("lo"), a["hi"].alias("hi"), P.area_midpoint(F.col("s")).alias("middle"))


@query("parse_tariff")
def parse_tariff(spark, sf_dir):
    return _frame(spark, TARIFFS).select("s", P.parse_tariff(F.col("s"), 2500).alias("money"))


@query("parse_date_any", f"SELECT s, coalesce(CAST(try_strptime(nullif(regexp_extract(s, '(\\d{{1,2}}/\\d{{1,2}}/\\d{{4}})', 1), ''), '%d/%m/%Y') AS DATE), TRY_CAST(TRY_CAST(s AS TIMESTAMPTZ) AS DATE)) AS day FROM {_values('s', DATES)}")
def parse_date_any(spark, sf_dir):
    return _frame(spark, DATES).select("s", P.parse_date(F.col("s")).alias("day"))


@query("hash_contact", f"""WITH v AS (SELECT s, trim(s) AS t, regexp_replace(s, '\\D', '', 'g') AS d FROM {_values('s', PHONES)}), n AS (SELECT s, t, CASE WHEN starts_with(d, '84') AND length(d) = 11 THEN '0' || substr(d, 3) WHEN length(d) = 9 AND NOT starts_with(d, '0') THEN '0' || d ELSE d END AS d FROM v)
SELECT s, CASE WHEN regexp_full_match(t, '[0-9a-f]{{16}}') THEN t WHEN length(d) >= 9 THEN substr(sha256(d || 'salt'), 1, 16) END AS contact FROM n""")
def hash_contact(spark, sf_dir):
    return _frame(spark, PHONES).select("s", P.hash_contact(F.col("s"), "salt").alias("contact"))


@query("hash_set", "SELECT c_nationkey, sha256(array_to_string(list_sort(list(DISTINCT c_mktsegment)), '|')) AS digest FROM customer GROUP BY c_nationkey")
def hash_set(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_list("c_mktsegment").alias("x")).select("c_nationkey", P.hash_set(F.col("x")).alias("digest"))


@query("cache_key", "SELECT doc_id, sha256('{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}') AS key FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def cache_key(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang is not null and source is not null")
    return d.select("doc_id", F.sha2(F.to_json(F.struct("lang", "source")), 256).alias("key"))


@query("url_normalize", f"""SELECT s, CASE WHEN r <> '' THEN 'https://' || regexp_replace(lower(split_part(r, '/', 1)), '^(?:www|m)\\.', '') || regexp_replace(regexp_replace(r, '^[^/]*', ''), '/+$', '') END AS url, nullif(regexp_extract(s, '/posts/(\\d+)', 1), '') AS post
FROM (SELECT s, regexp_extract(s, '^[hH][tT][tT][pP][sS]?://([^?#]+)', 1) AS r FROM {_values('s', URLS)})""")
def url_normalize(spark, sf_dir):
    return _frame(spark, URLS).select("s", T.normalize_url(F.col("s")).alias("url"), T.extract_post_id(F.col("s")).alias("post"))


@query("url_page_keys", "SELECT page_id, 'https://' || regexp_replace(lower(split_part(r, '/', 1)), '^(?:www|m)\\.', '') || regexp_replace(regexp_replace(r, '^[^/]*', ''), '/+$', '') AS url FROM (SELECT page_id, regexp_extract(url, '^[hH][tT][tT][pP][sS]?://([^?#]+)', 1) AS r FROM pages)")
def url_page_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.normalize_url(F.col("url")).alias("url"))


@query("url_permalink_gate", "SELECT page_id, NOT regexp_matches(url, '^https://[^/]+/[a-z]{2}/[0-9]+$') OR count(*) OVER (PARTITION BY url) > 1 AS bad FROM pages")
def url_permalink_gate(spark, sf_dir):
    return H.mark_bad_links(table(spark, sf_dir, "pages"), "url", r"^https://[^/]+/[a-z]{2}/[0-9]+$").select("page_id", "bad")


@query("html_title_links", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS links FROM pages")
def html_title_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.title(F.col("html")).alias("title"), H.links(F.col("html")).alias("links"))


@query("html_text_blocks", "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'gs'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
def html_text_blocks(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.visible_text(F.col("html")).alias("text"))


@query("html_expired_flag", "SELECT page_id, contains(lower(html), 'worthless') OR contains(lower(html), 'trash') AS expired FROM pages")
def html_expired_flag(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.keyword_flag(F.lower("html"), ["worthless", "trash"]).alias("expired"))


@query("html_card_rows", "WITH c AS (SELECT page_id, unnest(string_split(html, '<li>')[2:]) AS card, generate_subscripts(string_split(html, '<li>')[2:], 1) AS pos FROM pages) SELECT page_id, pos, regexp_extract(card, 'href=\"([^\"]*)\"', 1) AS href, regexp_extract(card, '>([^<]+)</a>', 1) AS label FROM c")
def html_card_rows(spark, sf_dir):
    return H.cards(table(spark, sf_dir, "pages"), "html", "<li>", {"href": r'href="([^"]*)"', "label": r">([^<]+)</a>"}, ["page_id"])


@query("html_parsed_tags")
def html_parsed_tags(spark, sf_dir):
    return H.parse_pages(table(spark, sf_dir, "pages"), "page_id", "html")


@query("html_balanced_json")
def html_balanced_json(spark, sf_dir):
    pages = _frame(spark, ['x = {"rooms": [{"id": 1, "tags": ["a]", "b"]}, {"id": 2}], "n": 3}', "nothing"], "html")
    return pages.select(H.balanced_array(F.col("html"), "rooms").alias("rooms"))


@query("json_nested_any_minmax", "SELECT event_type, min(k) AS lo, max(k) AS hi, bool_or(k > 90) AS any_high FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type")
def json_nested_any_minmax(spark, sf_dir):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.bool_or(F.col("k") > 90).alias("any_high"))


@query("json_images_parse")
def json_images_parse(spark, sf_dir):
    return _frame(spark, ['["http://a/1.jpg", "http://a/2.jpg"]', "['http://b/1.jpg']", "http://c/1.jpg | http://c/2.jpg | x", "", "[]"]).select("s", P.parse_images(F.col("s")).alias("images"))


@query("json_evidence_validate")
def json_evidence_validate(spark, sf_dir):
    rows = [("p1", "Cho thuê phòng 3tr5 tại Cầu Giấy", '{"classification": "rental", "listings": [{"price": 3500000, "evidence": {"price": "3tr5"}}]}'),
            ("p2", "Cho thuê phòng", '{"classification": "rental", "listings": [{"price": 2000000, "evidence": {"price": "2tr"}}]}'),
            ("p3", "Tìm phòng", '{"classification": "other", "listings": []}'), ("p4", "hỏng", "{")]
    return H.validated_listings(spark.createDataFrame(rows, "post string, text string, payload string"))


@query("parse_address_candidates")
def parse_address_candidates(spark, sf_dir):
    from ..functions import address as A

    rows = [("Số 5, ngõ 102/35 Trường Chinh, Phường Phương Mai, Quận Đống Đa", None, None), ("168/553 Giải Phóng", "Phường Giáp Bát", "Quận Hoàng Mai"), ("Phố Kim Mã, Quận Ba Đình", None, None), ("TP Hồ Chí Minh", None, None), (None, None, "Quận Ba Đình")]
    d = spark.createDataFrame(rows, "address string, ward string, district string")
    return A.with_candidates(d, "address", "ward", "district")


@query("sql_registered_functions", f"""WITH {LISTINGS} SELECT listing_id, round(12742.0 * asin(sqrt(sin((radians(21.0) - radians(lat)) / 2) ^ 2 + cos(radians(lat)) * cos(radians(21.0)) * sin(radians(105.8 - lon) / 2) ^ 2)), 6) AS km,
round(CASE WHEN price < 950.0 THEN least(price / 950.0, 1.0) ELSE 1.0 - 0.5 * (price - 950.0) / greatest(1000.0 - 950.0, 1.0) END, 6) AS s_price FROM listings""")
def sql_registered_functions(spark, sf_dir):
    from ..functions.registry import register

    register(spark)
    listings(spark, sf_dir).createOrReplaceTempView("skein_listings")
    return spark.sql("SELECT listing_id, round(haversine_km(lat, lon, 21.0D, 105.8D), 6) AS km, round(price_score(price, 950.0D, 1000.0D), 6) AS s_price FROM skein_listings")


@query("sql_table_function")
def sql_table_function(spark, sf_dir):
    from ..functions.registry import register

    register(spark)
    listings(spark, sf_dir).select("listing_id", F.concat(F.col("listing_id").cast("string"), F.lit(" "), F.col("house_type")).alias("address"), "district").createOrReplaceTempView("skein_addresses")
    return spark.sql("SELECT a.listing_id, c.pos, c.level, c.query FROM skein_addresses a, LATERAL address_candidates(a.address, CAST(NULL AS STRING), a.district) c")

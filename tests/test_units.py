"""Cases that the tables don't hold: linkage without chains, parsers, sinks, streams."""

import math
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import address as A
from skein.functions import parsers as P
from skein.functions import text as T
from skein.operators import entity as E
from skein.operators import filters as L
from skein.operators import recommend as R
from skein.operators import textindex as X
from skein.plans import flow_queries
from skein.sources import readers, sinks
from skein.streaming import events as V


def values(spark, column, strings):
    return [r[0] for r in spark.createDataFrame([(s,) for s in strings], "s string").select(column(F.col("s"))).collect()]


def test_text(spark):
    assert values(spark, T.ascii_fold, ["Đẹp", "Phố Kim Mã", None]) == ["dep", "pho kim ma", None]
    assert values(spark, T.normalize_text, ["a\t\tb \n\n\n\n c\x0b😀", None]) == ["a b\n\nc", None]
    assert values(spark, T.redact_phones, ["gọi 0917 831 531 nhé", "mã 12345"]) == ["gọi [phone] nhé", "mã 12345"]
    assert values(spark, T.parse_count, ["1.2K", "1,234", "1,2K", "12 lượt", None]) == [1200, 1234, 1200, 12, None]


def test_prices_and_areas(spark):
    price = values(spark, P.parse_price_vnd, ["3,5 triệu/tháng", "3tr5", "5 triệu 500", "Thỏa thuận", "3.500.000 đ", "x"])
    assert [(p.value, p.negotiable) for p in price] == [(3.5e6, False), (3.5e6, False), (5.5e6, False), (None, True), (3.5e6, False), (None, False)]
    area = values(spark, P.parse_area, ["20 - 27", "27-20", "25", "abc", "0"])
    assert [(a.lo, a.hi) for a in area] == [(20, 27), (20, 27), (25, 25), (None, None), (None, None)]
    assert values(spark, P.extract_rents, ["2,4-3tr, 2500k", None]) == [[2_400_000, 3_000_000, 2_500_000], []]


def test_contacts(spark):
    same = values(spark, lambda c: P.hash_contact(c, "s"), ["0917831531", "917831531", "+84 917 831 531", "84917831531"])
    assert len(set(same)) == 1 and len(same[0]) == 16
    assert values(spark, lambda c: P.hash_contact(c, "s"), ["0123", "a1b2c3d4e5f60718", None]) == [None, "a1b2c3d4e5f60718", None]


def test_rents(spark):
    texts = ["3tr500", "2,5 triệu", "2.4 - 3 triệu", "3500k", "3.500.000", "4 triệu", "3k/số", "200000", "12tr5", "1.800k", "xx triệu", "2tr", None]
    assert values(spark, P.normalize_rent, texts) == [3_500_000, 2_500_000, 2_400_000, 3_500_000, 3_500_000, 4_000_000, None, None, 12_500_000, 1_800_000, None, 2_000_000, None]
    lists = ["Giá 2,4-3tr, cọc 1 tháng 2500k, sdt 0917831531", "phòng 25m2 tầng 3, 3m5 hoặc 3.500.000đ", "12tr5 và 1.800k, 100.000đ", "không rõ"]
    assert values(spark, P.extract_rents, lists) == [[2_400_000, 3_000_000, 2_500_000], [3_500_000], [12_500_000, 1_800_000], []]
    sums = values(spark, P.parse_price_vnd, ["800 nghìn/tháng", "1 triệu 200 nghìn", "3.5 triệu/tháng", "Giá thương lượng", "3,5 tr", None])
    assert [(x.value, x.negotiable) for x in sums] == [(8e5, False), (1.2e6, False), (3.5e6, False), (None, True), (3.5e6, False), (None, False)]


# Addresses in the forms that listings use, with their street, road word and alley.
ADDRESSES = {
    "Tạ Quang Bửu, Phường Bách Khoa, Quận Hai Bà Trưng, Hà Nội": ("Tạ Quang Bửu", None, None),
    "12/3, Phố Xã Đàn, Phường Kim Liên, Quận Đống Đa, Hà Nội": ("Xã Đàn", "Phố", "3"),
    "Xã Đàn, Phường Kim Liên, Quận Đống Đa, Hà Nội": ("Xã Đàn", None, None),
    "Đường Đường Láng, Quận Đống Đa, Hà Nội": ("Láng", "Đường", None),
    "Ngõ Hoàng An, Quận Đống Đa, Hà Nội": ("Ngõ Hoàng An", None, None),
    "Ngõ 580 Trường Chinh": ("Trường Chinh", None, "580"),
    "Số 104 ngách 49/25 ngõ 165 dương quảng hàm": ("dương quảng hàm", None, "165"),
    "Số nhà 21, ngõ 2/27, đường Phương Canh": ("Phương Canh", "Đường", "2"),
    "19A/15/100/250 KIM GIANG": ("KIM GIANG", None, "250"),
    "số nhà 25 ngách 46 Linh Quang": ("Linh Quang", None, None),
    "Số 33B Mặt phố Tôn Đức Thắng": ("Tôn Đức Thắng", "Phố", None),
    "102 Khuất Duy Tiến": ("Khuất Duy Tiến", None, None),
    "Tổ 12 Yên Nghĩa": ("Yên Nghĩa", None, None),
    "Số 21/5 Hoàng Cầu": ("Hoàng Cầu", None, "5"),
    "số 6 ngõ 16 khu tập thể thủy sản (đi ngõ 94 Cầu Bươu vào)": ("khu tập thể thủy sản", None, "16"),
    "Số 5, ngõ 102/35 Trường Chinh, Phường Phương Mai": ("Trường Chinh", None, "102"),
    "168/553 Giải Phóng": ("Giải Phóng", None, "553"),
    "": (None, None, None),
}


def test_streets():
    assert {a: A.street_of(a) for a in ADDRESSES} == ADDRESSES and A.street_of(None) == (None, None, None)


def test_cities():
    told = {"12 Lê Lợi, TP. Hồ Chí Minh": "Hồ Chí Minh", "12 Nguyễn Huệ, TP.HCM": "Hồ Chí Minh", "Trần Phú, Phường Mộ Lao, Quận Hà Đông, Hà Nội": "Hà Nội", "102 Khuất Duy Tiến": "Hà Nội", None: "Hà Nội"}
    assert {a: A.city_of(a) for a in told} == told


def test_address_candidates(spark):
    said = lambda *x: [(c.level, c.query) for c in A.candidates(*x)]
    found = A.candidates("Ngõ 580 Trường Chinh", "Phường Kim Liên", "Quận Đống Đa")
    assert [(c.level, c.query) for c in found] == [
        ("alley", "Ngõ 580 Trường Chinh, Hà Nội"), ("street", "Trường Chinh, Hà Nội"), ("street", "Phố Trường Chinh"), ("street", "Đường Trường Chinh"),
        ("ward", "Phường Kim Liên, Hà Nội"), ("ward", "Kim Liên, Hà Nội"), ("district", "Quận Đống Đa, Hà Nội"),
    ]
    assert all(c.district == "Quận Đống Đa" for c in found[:-1]) and found[-1].district is None
    assert said(None, None, None) == []
    assert said("Đường Lê Trọng Tấn Thanh Xuân, Quận Thanh Xuân, Hà Nội", None, "Quận Thanh Xuân")[:2] == [("street", "Đường Lê Trọng Tấn, Hà Nội"), ("street", "Phố Lê Trọng Tấn")]
    assert said("Cầu Giấy", None, "Quận Cầu Giấy")[0] == ("street", "Cầu Giấy, Hà Nội")
    far = A.candidates("số 35 Lê Văn Chí, Linh Xuân, Hồ Chí Minh", "Linh Xuân", None)
    assert [(c.level, c.query) for c in far] == [("street", "Lê Văn Chí, Hồ Chí Minh"), ("street", "Phố Lê Văn Chí"), ("street", "Đường Lê Văn Chí"), ("ward", "Linh Xuân, Hồ Chí Minh"), ("city", "Hồ Chí Minh, Việt Nam")]
    assert all(c.city == "Hồ Chí Minh" and c.district is None for c in far)
    d = spark.createDataFrame([("Ngõ 580 Trường Chinh", "Phường Kim Liên", None), (None, None, None)], "a string, w string, d string")
    assert A.with_candidates(d, "a", "w", "d").count() == 6


def test_room_validity(spark):
    def of(title, price=3.5e6, **more):
        d = spark.createDataFrame([(title, price)], "t string, p double").select(L.room_validity(F.col("t"), F.col("p"), **more).alias("v"))
        return d.first().v.valid

    assert of("Cho thuê phòng trọ sinh viên Cầu Giấy giá rẻ", max_price=6e6) and of("Phòng trọ studio full đồ", 6e6, max_price=6e6) and not of("Phòng trọ cao cấp", 7e6, max_price=6e6)
    told = F.lit("Thỏa thuận")
    assert of("Phòng trọ", None, max_price=6e6, price_text=told) and not of("Phòng trọ", None, max_price=6e6, price_text=told, allow_negotiable=False) and not of("Phòng trọ", None, max_price=6e6) and not of("Phòng trọ", -1.0, max_price=6e6)
    for bad in ("Cho thuê căn hộ cao cấp 2PN Goldmark City", "Cho thuê nhà nguyên căn 4 tầng ngõ rộng ô tô đỗ", "Cho thuê biệt thự khu đô thị Thanh Hà", "Cho thuê văn phòng mặt phố Cầu Giấy"):
        assert not of(bad)
    for good in ("Cho thuê phòng trọ khép kín full đồ Quan Hoa Cầu Giấy", "Phòng trọ view biệt thự", "Phòng đẹp trong khu biệt thự Thanh Hà", "Nhà của villager", None):
        assert of(good)


def adverts(spark, texts, **more):
    rows = [(str(k), k, t, "", "HN", 20.0 + 10 * k, 1e6 * (k + 1), "") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "listing_id string, pos long, title string, description string, province string, area double, price double, address string")


def test_linkage_forms_no_chain(spark):
    base = [f"w{i}" for i in range(70)]
    near, far = list(base), list(base)
    near[6] = "x"
    far[6], far[60] = "x", "y"
    got = {r.listing_id: r.cluster_id for r in E.find_clusters(adverts(spark, [" ".join(t) for t in (base, near, far)])).collect()}
    assert got == {"0": "0", "1": "0", "2": "2"}


def test_mark_duplicates(spark):
    rows = [(0, "a", "S1", "D", "Phòng đẹp", "", 1.00e6, 20.0, None, None, None), (1, "b", "S1", "D", "phong dep", "", 1.04e6, 20.5, None, None, None), (2, "c", "S2", "D", "phong dep", "", 1.00e6, 20.0, None, None, None),
            (3, "d", "S1", None, "x", "", None, None, None, None, None), (4, "e", "S1", None, "x", "", None, None, "f" * 16, None, None)]
    d = spark.createDataFrame(rows, "pos long, listing_id string, platform string, district string, title string, address string, price double, area double, phone string, lat double, lon double")
    got = {r.listing_id: (r.duplicate_of, r.n_duplicates) for r in E.mark_duplicates(d).collect()}
    assert got == {"a": (None, 1), "b": ("a", 1), "c": (None, 0), "d": ("e", 1), "e": (None, 1)}


def merged_by_pairs(n, match):
    """Groups by their first row: matching pairs in order, merged if all cross pairs match."""
    group = {i: {i} for i in range(n)}
    for x in range(n):
        for y in range(x + 1, n):
            a, b = group[x], group[y]
            if a is not b and match(x, y) and all(match(p, q) for p in a for q in b):
                a = a | b
                group |= dict.fromkeys(a, a)
    return [min(group[i]) for i in range(n)]


@pytest.mark.parametrize("seed", range(20))
def test_cliques_are_complete_linkage_in_row_order(seed):
    rng = np.random.default_rng(seed)
    n = 40
    key, value, text = rng.integers(0, 3, n), rng.integers(0, 9, n), rng.integers(-1, 12, n)
    like = {int(c): np.array([], int) for c in range(12)}
    for a, b in rng.integers(0, 12, (6, 2)).tolist():
        if a != b and {a, b} <= set(text.tolist()):
            like[a], like[b] = np.union1d(like[a], [b]), np.union1d(like[b], [a])

    def match(x, c):
        found = (key[c] == key[x]) & (np.abs(value[c] - value[x]) <= 1)
        return found if text[x] < 0 else found | (text[c] == text[x]) | np.isin(text[c], like[int(text[x])])

    got = E.greedy_cliques([key, text], match, E.twins_of(key, value, text), like)
    assert got.tolist() == merged_by_pairs(n, lambda x, y: bool(match(x, np.array([y]))[0]))


def test_mark_duplicates_of_one_hot_title(spark):
    """4,000 rows of one title: eight million pairs, which are not written out."""
    d = spark.range(4000).select(
        F.col("id").alias("pos"), F.col("id").cast("string").alias("listing_id"), F.lit("S").alias("platform"), F.lit("D").alias("district"), F.lit("room").alias("title"), F.lit("").alias("address"),
        (1e6 + F.col("id") % 2 * 1e6).alias("price"), F.lit(20.0).alias("area"), F.lit(None).cast("string").alias("phone"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"),
    )
    began = time.perf_counter()
    got = E.mark_duplicates(d).groupBy("duplicate_of", "n_duplicates").count().collect()
    assert sorted((r.duplicate_of or "", r.n_duplicates, r["count"]) for r in got) == [("", 1999, 2), ("0", 1999, 1999), ("1", 1999, 1999)]
    assert time.perf_counter() - began < 120


def test_price_score(spark):
    d = spark.createDataFrame([(700.0, 700.0), (350.0, 700.0), (1000.0, 700.0)], "p double, t double")
    assert [r[0] for r in d.select(R.price_score(F.col("p"), F.col("t"), 1000.0)).collect()] == [1.0, 0.5, 0.5]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.upsert_parquet(one, path, "k")
    sinks.upsert_parquet(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), path, "k")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    sinks.write_csv_bom(one.withColumn("l", F.array(F.lit("x"), F.lit("y"))), str(tmp_path / "c"), ["v", "k", "l"])
    back = readers.csv_text(spark, str(tmp_path / "c"), ["v", "k", "l"], source_file=False)
    assert sorted(map(tuple, back.collect())) == [("a", "1", "x | y"), ("b", "2", "x | y")]
    with pytest.raises(ValueError):
        sinks.write_back(one, one.limit(1), ["k"], ["v"])
    assert sinks.merge_section('{"a": 1}', "b", {"c": 2}) == '{"a": 1, "b": {"c": 2}}'


def test_sources(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"k": "1", "s": 1, "v": "a"}\n\n{broken\n{"k": "1", "s": 2, "v": "b"}\n')
    got = readers.latest_cache(spark, str(tmp_path / "x.jsonl"), "k string, s long, v string", "k", "s").collect()
    assert [tuple(r) for r in got] == [("1", 2, "b")]
    readers.register_adapter("Site.vn", {"listing_id": "id", "title": "name", "price": "cost"})
    d = readers.adapted(spark.createDataFrame([("7", "room", 5), ("site_8", "x", 6)], "id string, name string, cost int"), "Site.vn")
    assert [(r.listing_id, r.platform, r.price, r.ward) for r in d.collect()] == [("site_7", "Site.vn", "5", None), ("site_8", "Site.vn", "6", None)]
    with pytest.raises(ValueError):
        readers.require_columns(d, ["none"])


def test_retry():
    tries, waits = [], []

    def work():
        tries.append(1)
        if len(tries) < 3:
            raise TimeoutError
        return "ok"

    assert V.retry(work, 5, (TimeoutError,), waits.append) == "ok" and waits == [1.0, 2.0]


@pytest.mark.parametrize("kind", ["tumbling", "session"])
def test_streams_write_every_window(spark, sf_dir, tmp_path, kind):
    of = {"tumbling": lambda d: V.tumbling(d, "ts", None, "1 day", ["event_type"], F.count("*").alias("n")), "session": lambda d: V.sessions(d, "ts", None, "30 minutes", ["user_id"], F.count("*").alias("n"))}[kind]
    query = getattr(flow_queries, f"stream_{kind}_ext")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = lambda d: sorted(map(tuple, d.collect()))
    want = rows(of(events.withColumn("ts", F.col("ts").cast("timestamp"))))
    assert rows(query(spark, sf_dir)) == want and sum(r[-1] for r in want) == events.where("ts is not null").count()
    # a folder of several files, the newest events first, a batch a file
    parts = events.withColumn("part", F.ntile(3).over(Window.orderBy("ts")))
    for part in (3, 2, 1):
        parts.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
        time.sleep(1.1)
    assert rows(query(spark, str(tmp_path))) == want
    by_file = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert rows(V.run_whole(of(by_file), "by-file")) == want


def test_streams_go_on_where_they_stopped(spark, sf_dir, tmp_path):
    """A second run over the same paths takes the new file only, and ends with the same table as one run over all."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("part", F.col("event_id") % 2)
    order = [F.col("ts").desc(), F.col("event_id").desc()]
    folder = f"{tmp_path}/events"
    for part in (0, 1):
        events.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(folder)
        stream = V.event_stream(spark, folder)
        table = V.upsert_stream(stream, ["user_id", "event_type"], order, "u", f"{tmp_path}/upserts")
        counts = V.run_whole(stream.groupBy("event_type").agg(F.count("*").alias("n")), "c", f"{tmp_path}/counts")
        appended = V.run_to_table(stream.select("event_id"), "a", path=f"{tmp_path}/appended")
        seen = events.where(F.col("part") <= part)
        assert appended.count() == seen.count()
        assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, seen.groupBy("event_type").count().collect()))
        want = V.latest(seen, ["user_id", "event_type"], order)
        assert sorted(r.event_id for r in table.collect()) == sorted(r.event_id for r in want.collect())


def test_quality_marks_and_null_columns(spark):
    rows = [("Pass phòng cho nữ", None, "12 Phố X, Quận Đống Đa", "Quận Đống Đa"), ("Phòng gần Cầu Giấy", "", "Phố Y, Phường Z", "Quận Ba Đình"), (None, None, None, None)]
    d = spark.createDataFrame(rows, "title string, description string, address string, district string")
    got = [tuple(r)[4:] for r in R.with_quality_marks(d).collect()]
    assert got == [(0.0, 0.0, 1.0, 1.0), (1.0, 1.0, 0.0, 0.0), (1.0, 1.0, 0.0, 1.0)]


def test_tfidf_rows(spark, monkeypatch):
    """Against a count by hand: few terms broadcast, texts of very many characters, null, empty and repeated ids."""
    wide = " ".join(chr(0x4E00 + k) + chr(0x4E01 + k) for k in range(0, 5000, 2))
    texts = [(1, "a bc  Def\tghijklm"), (2, None), (3, "abc def\x00 é def"), (3, "ghijklm bc"), (4, wide + " bc def"), (5, ""), (6, wide + " ghijklm abc"), (7, wide)]
    monkeypatch.setattr(X, "MAX_HEAD", 3)
    tf = defaultdict(Counter)
    for i, t in texts:
        for w in (t or "").lower().split():
            p = f" {w} "
            tf[i].update(p[k : k + n] for n in (3, 4, 5) if len(p) >= n or n == 3 for k in range(max(len(p) - n + 1, 1)))
    df = Counter(t for c in tf.values() for t in c)
    raw = {i: {t: (1 + math.log(k)) * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, k in c.items() if df[t] >= 2} for i, c in tf.items()}
    want = {i: {t: w / math.sqrt(sum(x * x for x in ws.values())) for t, w in ws.items()} for i, ws in raw.items() if ws}
    index = X.TfIdf(spark.createDataFrame(texts, "id long, text string"), "id", F.col("text"), min_df=2)
    got = {r.id: (r.terms, r.total) for r in index.totals().collect()}
    assert got == {i: (len(ws), pytest.approx(sum(ws.values()))) for i, ws in want.items()}
    assert {(r.id, r.term): r.weight for r in index.weights().collect()} == {(i, t): pytest.approx(w) for i, ws in want.items() for t, w in ws.items()}
    for q in (1, 4):
        like = {i: sum(w * want[q].get(t, 0) for t, w in ws.items()) for i, ws in want.items() if i != q}
        assert {r.id: r.similarity for r in index.similar(q).collect()} == {i: pytest.approx(x) for i, x in like.items() if x}
    assert index.similar(99).count() == 0


def test_copies_of_a_text_tie(spark, monkeypatch):
    """Equal texts are alike to the last bit, so that ids break the tie, where most terms join in several partitions."""
    monkeypatch.setattr(X, "MAX_HEAD", 10)
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(3, 10))) for _ in range(1500)]
    query = " ".join(rng.choice(words, 6))
    texts = [f"{query} {' '.join(rng.choice(words, 200))}" for _ in range(6)]
    rows = [(0, query)] + [(k, texts[k % 6]) for k in range(1, 480)]
    plain = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in plain}
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        index = X.TfIdf(spark.createDataFrame(rows, "id long, text string").repartition(4, "id"), "id", F.col("text"))
        found = {r.id: r.similarity for r in index.similar(0).collect()}
        assert [len({x for i, x in found.items() if i % 6 == k}) for k in range(6)] == [1] * 6
        best = max(found.values())
        assert [r.id for r in X.cosine_top(index, 0, 10).collect()] == sorted(i for i, x in found.items() if x == best)[:10]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_text_terms_are_not_shuffled_one_by_one(spark, sf_dir):
    """Plans deal out rows of documents and rare terms, not every term of every text."""
    index = X.TfIdf(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", F.col("text"))
    sent = index._weighed(index.docs, {}).count()
    assert sent <= index.n + 1000 < index.weights().count()


def test_similar_pairs_with_frequent_items(spark, monkeypatch):
    """All pairs by brute force, while many items are frequent and come last; blocks keep rows apart."""
    monkeypatch.setattr(E, "FREQUENT", 2)
    monkeypatch.setattr(E, "MAX_FREQUENT", 15)
    rng = np.random.default_rng(1)
    base = [set(rng.choice(60, 20, replace=False).tolist()) for _ in range(8)]
    sets = [(k, sorted(base[k % 8] ^ set(rng.choice(60, k % 4, replace=False).tolist())), "ab"[k % 3 == 0]) for k in range(60)] + [(60, [], "a")]
    want = {(a, b) for a, x, p in sets for b, y, q in sets if a < b and p == q and x and y and len(set(x) & set(y)) >= 0.85 * len(set(x) | set(y))}
    got = E.similar_pairs(spark.createDataFrame(sets, "id long, items array<long>, block string"), 0.85, "block").collect()
    assert len(got) == len(want) > 20 and {(r.a, r.b) for r in got} == want


def test_clusters_of_one_hot_address(spark):
    """4,000 texts unlike each other at one address and price: one cluster, without eight million pairs."""
    d = spark.range(4000).select(
        F.col("id").cast("string").alias("listing_id"), F.col("id").alias("pos"), F.lit("").alias("title"), F.md5(F.col("id").cast("string")).alias("description"), F.lit("HN").alias("province"),
        F.lit(20.0).alias("area"), F.lit(1e6).alias("price"), F.lit("So 1 Pho A").alias("address"),
    )
    began = time.perf_counter()
    assert [tuple(r) for r in E.find_clusters(d).groupBy("cluster_id").count().collect()] == [("0", 4000)]
    assert time.perf_counter() - began < 120

"""Queries over set operations, event logs, streams and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..streaming import events as V
from .catalogue import query
from .tables import listings, table


@query("set_union_by_name", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def set_union_by_name(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return s.unionByName(c, allowMissingColumns=True)


@query("set_source_priority", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY CASE WHEN source = 'src0' THEN 0 ELSE 1 END, doc_id) = 1")
def set_source_priority(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("m"))
    return J.by_priority([d.where("source = 'src0'"), d.where("coalesce(source <> 'src0', true)")], "m", "doc_id").select("doc_id", "source")


@query("set_partition_replace", "SELECT source, doc_id FROM documents WHERE source NOT IN ('src1', 'src2') UNION ALL SELECT source, -doc_id - 1 FROM documents WHERE source IN ('src1', 'src2')")
def set_partition_replace(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    new = d.where("source in ('src1', 'src2')").select("source", (-F.col("doc_id") - 1).alias("doc_id"))
    return J.replaced(d, new, ["source"])


@query("set_word_overlap", "SELECT a.p_partkey AS a, b.p_partkey AS b, len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' '))) AS common FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def set_word_overlap(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    b = p.select(F.col("p_partkey").alias("b"), F.col("w").alias("wb"))
    return p.join(b, F.col("p_partkey") + 1 == F.col("b")).select(F.col("p_partkey").alias("a"), "b", F.size(F.array_intersect("w", "wb")).cast("long").alias("common"))


@query("evt_latest_vote", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def evt_latest_vote(spark, sf_dir):
    return V.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_type", "event_id", "value")


@query("evt_current_state", "SELECT user_id, max_by(event_type, (ts, event_id)) AS vote FROM events WHERE event_type IN ('click', 'purchase') GROUP BY user_id")
def evt_current_state(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type in ('click', 'purchase')")
    return V.current_votes(e, ["user_id"], "event_type", "ts", "event_id")


@query("evt_impression_ctr", "SELECT user_id, round(count(*) FILTER (event_type = 'click') / CAST(nullif(count(*) FILTER (event_type = 'view'), 0) AS DOUBLE), 9) AS ctr FROM events GROUP BY user_id")
def evt_impression_ctr(spark, sf_dir):
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(n("click") / F.nullif(n("view"), F.lit(0)), 9).alias("ctr"))


@query("evt_retention", "SELECT event_id FROM events WHERE date_diff('day', ts, (SELECT max(ts) FROM events)) <= 7")
def evt_retention(spark, sf_dir):
    return V.retained(table(spark, sf_dir, "events"), "ts", 7).select("event_id")


def _stream(spark, sf_dir):
    return V.event_stream(spark, f"{sf_dir}/events.parquet")


@query("stream_dedup", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stream_dedup(spark, sf_dir):
    once = V.deduplicated(_stream(spark, sf_dir).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "60 days")
    return V.run_to_table(once, "dedup").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("stream_upsert", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def stream_upsert(spark, sf_dir):
    out = V.upsert_stream(_stream(spark, sf_dir), ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()], "upsert")
    return out.select("user_id", "event_type", "event_id")


@query("stream_tumbling_ext", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def stream_tumbling_ext(spark, sf_dir):
    t = V.tumbling(_stream(spark, sf_dir), "ts", None, "1 day", ["event_type"], F.count("*").alias("n"))
    return V.run_whole(t, "tumbling").withColumn("start", F.col("start").cast("timestamp_ntz"))


_SESSIONS = """WITH b AS (SELECT user_id, ts, coalesce(ts > lag(ts) OVER w + INTERVAL 30 MINUTE, true) AS fresh FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM b)
SELECT min(ts)::TIMESTAMP AS start, (max(ts) + INTERVAL 30 MINUTE)::TIMESTAMP AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k"""


@query("stream_session_ext", _SESSIONS)
def stream_session_ext(spark, sf_dir):
    t = V.sessions(_stream(spark, sf_dir), "ts", None, "30 minutes", ["user_id"], F.count("*").alias("n"))
    return V.run_whole(t, "sessions").withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("ltr_fit_weights")
def ltr_fit_weights(spark, sf_dir):
    from ..operators import models as M

    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    k = F.col("doc_id")
    votes = d.select(F.col("quality").cast("double").alias("label"), (F.log1p("n_chars") / 10).alias("s_price"), (k % 97 / 97).alias("s_value"), (k % 31 / 31).alias("s_distance"), (F.col("toxic").cast("double")).alias("s_amenity"))
    return M.learned_weights(votes, ["s_price", "s_value", "s_distance", "s_amenity"], "label")


@query("model_gbt_fair_price")
def model_gbt_fair_price(spark, sf_dir):
    from ..operators import models as M

    return M.oof_gbt(listings(spark, sf_dir), "price", ["area", "distance_km", "amenity_count", "days_old"], ["house_type", "district"], folds=2, iterations=10).select("listing_id", "fold", F.round("pred", 3).alias("pred"))


@query("model_leave_one_source_out")
def model_leave_one_source_out(spark, sf_dir):
    from ..operators import models as M

    return M.leave_one_out(listings(spark, sf_dir).withColumn("source", F.col("balcony").cast("string")), "source", "price", ["area", "distance_km", "amenity_count"], ["house_type"], iterations=5)

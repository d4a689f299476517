"""Exact top-k inner-product search by distributed histogram selection.

Queries and candidates are packed into blocks of vectors; each pair of blocks is
scored by one matrix product. Scores are integers. Each pass counts them, for
every query, in a histogram over the interval that still holds its kth value; the
histograms of all blocks are added up, and the interval shrinks to one bin, until
so few scores lie at or above its lower end that a filter can take them, or it is
a single value. A last pass emits each block's scores from there on, at most k per
query and block with ties to the smaller id, and a window ranks what is left.

A block adds to a histogram only down to its own kth score in the interval: lower
bins cannot hold the global kth value. So what is shuffled is at most k bins per
query and block, however the scores are spread.

Edge cases: vectors that are null or empty, or hold a null or non-finite component,
take no part; nor do null ids; only vectors of equal length meet; a query with no
candidate returns nothing, one with fewer than k returns all; rows that repeat an
id are candidates each, though none for a query of its own id; repeated query
rows count once, the one whose vector sorts first; scores beyond 2^53 are summed
as exact integers, and where a score might not fit 64 bits the search fails rather than round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

SCALE = 256
#: Vectors of a block of candidates and of a block of queries.
CANDIDATE_BLOCK, QUERY_BLOCK = 2048, 1024
BINS = 1024
#: A query's interval is fine enough if at most this many times k scores lie at or above its lower end.
ENOUGH = 8


def _pack(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """One row per block and vector length: dim, block, ids, data (floored components, row by row, as doubles)."""
    n = vectors.count()
    blocks = max(1, -(-n // size))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(name)), F.lit(blocks).cast("long")).cast("int"))

    def pack(pdf):
        pdf = pdf.sort_values("vec_id", kind="stable")
        data = np.stack([np.asarray(v, dtype="<f8") for v in pdf["v"]])
        return pd.DataFrame({"dim": [int(pdf["dim"].iloc[0])], "block": [int(pdf["block"].iloc[0])], "ids": [pdf["vec_id"].to_numpy()], "data": [data.tobytes()]})

    return durable(dealt.groupBy("dim", "block").applyInPandas(pack, "dim int, block int, ids array<long>, data binary"), name)


def _scores(queries: bytes, candidates: bytes, dim: int) -> np.ndarray:
    """Exact int64 inner products of two blocks."""
    q, c = (np.frombuffer(x, "<f8").reshape(-1, dim) for x in (queries, candidates))
    bound = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * dim
    if bound < 2**53:
        return (q @ c.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in q], dtype=object) @ np.array([[int(x) for x in row] for row in c], dtype=object).T
    return exact.astype(np.int64)


def _masked(scores: np.ndarray, query_ids, candidate_ids) -> tuple[np.ndarray, np.ndarray]:
    return scores, np.asarray(query_ids)[:, None] != np.asarray(candidate_ids)[None, :]


def top_k(
    vectors: DataFrame, k: int = 5, query_modulus: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by query_modulus, against all rows."""
    usable = F.expr("v is not null and size(v) > 0 and forall(raw, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    raw = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    # floor() of a double is a long; what does not fit (2^63 and above) stays a double
    v = F.transform(raw, lambda x: F.when(F.abs(x * scale) < 2.0**52, F.floor(x * scale).cast("double")).otherwise(x * scale))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), raw.alias("raw"), v.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable).select("vec_id", "v", F.size("v").alias("dim"))
    one_each = rows.where(F.col("vec_id") % query_modulus == 0).groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v", F.size("v").alias("dim"))
    candidates = _pack(rows, CANDIDATE_BLOCK, "candidates")
    queries = _pack(one_each, QUERY_BLOCK, "queries")

    grid = durable(queries.groupBy("dim").agg(F.count("*").cast("int").alias("q_blocks")).join(candidates.groupBy("dim").agg(F.count("*").cast("int").alias("c_blocks")), "dim"), "grid")
    norms = _norms(candidates)

    # the state of each query block: for each query the interval [low, high) in bins of a width, and how many scores lie above it
    def begin(pdf):
        top = float(pdf["top"].iloc[0])
        out = []
        for block, data, dim, ids in zip(pdf["block"], pdf["data"], pdf["dim"], pdf["ids"]):
            q = np.frombuffer(data, "<f8").reshape(-1, dim)
            most = np.ceil(np.linalg.norm(q, axis=1) * top * (1 + 1e-9)) + 1
            if (most >= 2**62).any():
                raise OverflowError("scores would not fit 64 bits")
            most = most.astype(np.int64)
            width = np.maximum(1, -(-(2 * most + 1) // BINS))
            out.append((dim, block, -most, most + 1, width, np.zeros(len(q), np.int64), np.zeros(len(q), bool)))
        return pd.DataFrame(out, columns=["dim", "block", "low", "high", "width", "above", "done"])

    state_ddl = "dim int, block int, low array<long>, high array<long>, width array<long>, above array<long>, done array<boolean>"
    state = durable(queries.join(norms, "dim").groupBy("dim", "block").applyInPandas(begin, state_ddl), "state")

    def pairs(state: DataFrame) -> DataFrame:
        """Every block of queries with every block of candidates of its length."""
        q = queries.join(state, ["dim", "block"]).join(grid, "dim")
        q = q.select("dim", F.col("block").alias("qb"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), "low", "high", "width", "above", "done", F.explode(F.sequence(F.lit(0), F.lit(n_candidate_blocks - 1))).alias("cb"))
        c = candidates.select("dim", F.col("block").alias("cb"), F.col("ids").alias("c_ids"), F.col("data").alias("c_data"), F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1))).alias("qb"))
        return q.join(c, ["dim", "qb", "cb"])

    n_candidate_blocks = (candidates.agg(F.max("block")).first()[0] or 0) + 1
    n_query_blocks = (queries.agg(F.max("block")).first()[0] or 0) + 1

    def count(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                scores, other = _masked(_scores(r.q_data, r.c_data, r.dim), r.q_ids, r.c_ids)
                out_q, out_bin, out_n = [], [], []
                for i in np.flatnonzero(~np.asarray(r.done)):
                    s = scores[i][other[i]]
                    bins = (s[(s >= r.low[i]) & (s < r.high[i])] - r.low[i]) // r.width[i]
                    if not len(bins):
                        continue
                    if len(bins) > k:
                        bins = bins[bins >= np.partition(bins, len(bins) - k)[len(bins) - k]]
                    b, n = np.unique(bins, return_counts=True)
                    out_q.append(np.full(len(b), i))
                    out_bin.append(b)
                    out_n.append(n)
                if out_q:
                    yield pd.DataFrame({"dim": r.dim, "block": r.qb, "q": np.concatenate(out_q), "bin": np.concatenate(out_bin), "n": np.concatenate(out_n)})

    def refine(key, left, right):
        if not len(left):
            return pd.DataFrame(columns=["dim", "block", "low", "high", "width", "above", "done"])
        row = left.iloc[0]
        low, high, width, above, done = (np.array(row[c]) for c in ("low", "high", "width", "above", "done"))
        by = right.sort_values(["q", "bin"], ascending=[True, False])
        seen = set()
        for q, part in by.groupby("q", sort=True):
            seen.add(q)
            up = above[q] + part["n"].to_numpy().cumsum()
            at = int(np.searchsorted(up, k))
            if at == len(up):  # fewer than k scores in all: take everything
                done[q] = True
                continue
            above[q] = up[at - 1] if at else above[q]
            low[q] += int(part["bin"].iloc[at]) * width[q]
            high[q] = min(high[q], low[q] + width[q])
            if width[q] == 1 or up[at] <= ENOUGH * k:
                done[q] = True
            else:
                width[q] = max(1, -(-(high[q] - low[q]) // BINS))
        for q in range(len(done)):
            if q not in seen:
                done[q] = True
        return pd.DataFrame([(row["dim"], row["block"], low, high, width, above, done)], columns=["dim", "block", "low", "high", "width", "above", "done"])

    while state.where(F.exists("done", lambda x: ~x)).limit(1).count():
        counted = pairs(state).mapInPandas(count, "dim int, block int, q int, bin long, n long")
        histogram = counted.groupBy("dim", "block", "q", "bin").agg(F.sum("n").alias("n"))
        state = durable(state.groupBy("dim", "block").cogroup(histogram.groupBy("dim", "block")).applyInPandas(refine, state_ddl), "state")

    def emit(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                scores, other = _masked(_scores(r.q_data, r.c_data, r.dim), r.q_ids, r.c_ids)
                c_ids = np.asarray(r.c_ids)
                out_q, out_id, out_s = [], [], []
                for i, q_id in enumerate(r.q_ids):
                    at = np.flatnonzero(other[i] & (scores[i] >= r.low[i]))
                    if len(at):
                        at = at[np.lexsort([c_ids[at], -scores[i][at]])[:k]]
                        out_q.append(np.full(len(at), q_id))
                        out_id.append(c_ids[at])
                        out_s.append(scores[i][at])
                if out_q:
                    yield pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_id), "score": np.concatenate(out_s)})

    found = pairs(state).mapInPandas(emit, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _norms(candidates: DataFrame) -> DataFrame:
    """(dim, top): the largest length of a candidate, by number of components."""

    def longest(batches):
        for pdf in batches:
            top = [float(np.linalg.norm(np.frombuffer(d, "<f8").reshape(-1, dim), axis=1).max()) for d, dim in zip(pdf["data"], pdf["dim"])]
            yield pd.DataFrame({"dim": pdf["dim"], "top": top})

    return candidates.mapInPandas(longest, "dim int, top double").groupBy("dim").agg(F.max("top").alias("top"))


#: The same rows in DuckDB's SQL over ``embeddings``.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

"""Document fingerprints as invertible Bloom lookup tables of paragraph digests.

A text's distinct paragraph digests are put into three cells each; a cell holds a
count, the XOR of its digests and the XOR of their check values. Subtracting the
cells of two versions cancels what they share, and peeling (take a cell with one
digest, remove that digest from its other cells, again) recovers the digests in
which they differ. If peeling gets stuck, both versions are sketched again with
four times the cells. Everything is DataFrame expressions; no rows leave the JVM.

Paragraphs end at a newline, and long ones at a sentence end after certain
letters, a rule that looks at the text around it only, so an edit moves no other
boundary.

Edge cases: a null text counts as empty; an empty text has no paragraphs (two such
are alike, 1.0; one such and another, 0.0); repeated paragraphs count once; texts
of any length are used whole; rows that share an id follow one another by their
texts' hashes; null ids come last; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: A newline, or the blank after a sentence that ends in one of these letters.
PARAGRAPH_END = r"\n|(?<=[aeiotn][.!?]) "
#: Cells in each of the three parts of a fingerprint, and of the larger ones for retries.
BASE_CELLS = 8
RETRY_CELLS = tuple(8 * 4**k for k in range(1, 9))
PARTS = 3
#: Peeling rounds; each one removes every digest that stands alone somewhere.
MAX_ROUNDS = 40
#: Buckets of neighbouring ids for each shuffle partition.
BUCKETS_PER_PARTITION = 3


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of the paragraphs of a text."""
    pieces = F.filter(F.transform(F.split(text, PARAGRAPH_END), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(-1))


def _cell(pos: Column, count: Column, key: Column, check: Column) -> Column:
    return F.struct(pos.cast("int").alias("pos"), count.cast("int").alias("count"), key.alias("key"), check.alias("check"))


def _entries(keys: Column, cells: Column, count) -> Column:
    """One cell per key and part; keys: array of struct<key, count> or of digests."""

    def of(k):
        key, n = (k["key"], -k["count"]) if count is None else (k, F.lit(count))
        return F.array(*[_cell(cells * part + F.pmod(F.xxhash64(key, F.lit(part)), cells.cast("long")), n, key, _check(key)) for part in range(PARTS)])

    return F.flatten(F.transform(keys, of))


def _once(value: Column, use) -> Column:
    """use(value), with value worked out once: a one-row array binds it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _added(c: Column, e: Column) -> Column:
    return _cell(c["pos"], c["count"] + e["count"], c["key"].bitwiseXOR(e["key"]), c["check"].bitwiseXOR(e["check"]))


def _merged(entries: Column) -> Column:
    """Entries of equal position joined into one cell; cells that hold nothing are left out.

    Sorted by position, each run of equal ones is joined on its own, so the work is in proportion.
    """

    def joined(es):
        last = F.filter(F.sequence(F.lit(1), F.size(es)), lambda i: (i == F.size(es)) | (F.get(es, i)["pos"] != F.get(es, i - 1)["pos"]))

        def run(end, before):
            first = F.get(es, before)
            many = F.aggregate(F.slice(es, before + 2, end - before - 1), first, _added)
            return F.when(end == before + 1, first).when(end == before + 2, _added(first, F.get(es, before + 1))).otherwise(many)

        return _once(last, lambda ends: F.transform(ends, lambda end, k: run(end, F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1)))))

    found = F.when(F.size(entries) == 0, entries).otherwise(_once(F.sort_array(entries), joined))
    return F.filter(found, lambda c: (c["count"] != 0) | (c["key"] != 0) | (c["check"] != 0))


def sketch(keys: Column, cells: Column) -> Column:
    """The non-empty cells of a set of digests, by position."""
    return _merged(_entries(keys, cells, 1))


def subtract(a: Column, b: Column) -> Column:
    return _merged(F.concat(a, F.transform(b, lambda c: _cell(c["pos"], -c["count"], c["key"], c["check"]))))


def peel(difference: Column, cells: Column) -> Column:
    """struct<cells, found, stuck>: what is left, and the recovered struct<key, count> (1: only in a, -1: only in b).

    No cells left means that every differing digest was recovered.
    """
    zero = F.struct(difference.alias("cells"), F.array().cast("array<struct<key:bigint,count:int>>").alias("found"), F.lit(False).alias("stuck"))

    def round_(acc, _):
        alone = F.filter(acc["cells"], lambda c: (F.abs(c["count"]) == 1) & (c["check"] == _check(c["key"])))
        pure = F.array_distinct(F.transform(alone, lambda c: F.struct(c["key"].alias("key"), c["count"].alias("count"))))
        # a one-row array binds pure, so that it is worked out once
        again = F.transform(
            F.array(pure),
            lambda p: F.when(F.size(p) == 0, F.struct(acc["cells"].alias("cells"), acc["found"].alias("found"), F.lit(True).alias("stuck"))).otherwise(
                F.struct(_merged(F.concat(acc["cells"], _entries(p, cells, None))).alias("cells"), F.concat(acc["found"], p).alias("found"), F.lit(False).alias("stuck"))
            ),
        )
        return F.when((F.size(acc["cells"]) == 0) | acc["stuck"], acc).otherwise(F.get(again, F.lit(0)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(MAX_ROUNDS)), zero, round_)


def _outcome(peeled: Column) -> Column:
    """struct<only_a, only_b>, or null if peeling got stuck."""
    counted = F.transform(
        F.array(peeled),
        lambda p: F.when(
            F.size(p["cells"]) == 0,
            F.struct(
                F.size(F.filter(p["found"], lambda x: x["count"] > 0)).alias("only_a"), F.size(F.filter(p["found"], lambda x: x["count"] < 0)).alias("only_b")
            ),
        ),
    )
    return F.get(counted, F.lit(0))


def difference(keys_a: Column, keys_b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """struct<only_a, only_b>: numbers of differing digests, by the fingerprints, else by larger ones.

    After RETRY_CELLS (enough for about 1.2 million differences) the sets themselves decide.
    """
    first = _outcome(peel(subtract(sketch_a, sketch_b), F.lit(BASE_CELLS)))

    def retry(acc, cells):
        return F.when(acc.isNotNull(), acc).otherwise(_outcome(peel(subtract(sketch(keys_a, cells), sketch(keys_b, cells)), cells)))

    exact = F.struct(F.size(F.array_except(keys_a, keys_b)).alias("only_a"), F.size(F.array_except(keys_b, keys_a)).alias("only_b"))
    # sizes that cannot hold the differences at the least are not tried
    least = F.abs(F.size(keys_a) - F.size(keys_b))
    sizes = F.filter(F.array(*map(F.lit, RETRY_CELLS)), lambda c: PARTS * c > least)
    retried = F.aggregate(sizes, F.lit(None).cast("struct<only_a:int,only_b:int>"), retry)
    return F.coalesce(first, retried, exact)


def likeness(keys_a: Column, keys_b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """Jaccard similarity of the digest sets, from their difference."""
    n_a, n_b = F.size(keys_a), F.size(keys_b)
    of = F.transform(
        F.array(difference(keys_a, keys_b, sketch_a, sketch_b)),
        lambda d: F.when(n_a + n_b == 0, F.lit(1.0)).otherwise((n_a - d["only_a"]).cast("double") / (n_a + d["only_b"])),
    )
    return F.get(of, F.lit(0))


def as_text(keys: Column, cells: Column) -> Column:
    """A fingerprint as a string: the number of digests, then each cell as position:count:key:check in hex."""
    said = F.transform(cells, lambda c: F.concat_ws(":", c["pos"].cast("string"), c["count"].cast("string"), F.lower(F.hex(c["key"])), F.lower(F.hex(c["check"]))))
    return F.concat(F.size(keys).cast("string"), F.lit("|"), F.array_join(said, ","))


def with_next(docs: DataFrame, id_col: str, text_col: str, more=None) -> DataFrame:
    """id, text (null as empty), next_text: the text of the row that follows by ascending id; after the last, the first.

    more: names and columns made of ``text``; of each, the row has its own value and, as
    next_<name>, that of the row that follows. They are worked out once a row, after
    the shuffle.

    Rows are dealt into buckets of neighbouring ids, one shuffle of the texts; only
    the first row of each bucket is looked up from the bucket before it.
    """
    spark = docs.sparkSession
    more = more or {}
    names = ["text", *more]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    n = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("id", [k / n for k in range(1, n)], F.lit(20 * n))).first()[0] or []
    cuts = sorted(set(cuts))
    # ids above the k-th cut are in bucket k or later; null ids in the last
    bounds = F.array(*map(F.lit, cuts)).cast("array<bigint>") if cuts else F.array().cast("array<bigint>")
    bucket = F.when(F.col("id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.size(F.filter(bounds, lambda c: c < F.col("id"))))
    rows = rows.withColumn("bucket", bucket)
    order = [F.col("id").asc_nulls_last(), F.col("h").asc()]

    firsts = rows.groupBy("bucket").agg(F.min("id").alias("id")).orderBy("bucket").collect()  # one row a bucket
    follows = [(a.bucket, b.bucket, b.id) for a, b in zip(firsts, firsts[1:] + firsts[:1], strict=True)]
    starts = spark.createDataFrame(follows or [(-1, -1, None)], "before int, at int, first_id long")
    own = rows.select("id", "text", "h", F.col("bucket").alias("at"))
    first = own.join(F.broadcast(starts), (own.at == starts.at) & own.id.eqNullSafe(starts.first_id))
    heads = first.groupBy("before").agg(F.min_by("text", "h").alias("text"))
    heads = durable(heads.select("before", "text", *(c.alias(x) for x, c in more.items())).select("before", F.struct(*names).alias("head")), "heads")

    dealt = rows.repartition("bucket").select("id", "h", "bucket", "text", *(c.alias(x) for x, c in more.items()))
    w = Window.partitionBy("bucket").orderBy(*order)
    seen = dealt.withColumn("after", F.lead(F.struct(*names)).over(w))
    out = seen.join(heads, seen.bucket == heads.before, "left").withColumn("after", F.coalesce("after", "head"))
    return out.select("id", *names, *(F.col(f"after.{x}").alias(f"next_{x}") for x in names))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text swaps the last quarter for the beginning of the next document.
    """
    n, cells = F.char_length("text"), F.lit(BASE_CELLS)
    keys = lambda text: _once(digests(text), lambda ks: F.struct(ks.alias("keys"), sketch(ks, cells).alias("cells")))
    rows = with_next(docs, id_col, text_col, {"s": keys(F.col("text"))})
    edited = F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 4) as int))"), F.expr("left(next_text, cast(floor(char_length(text) / 4) as int))"))
    told = _once(edited, lambda e: F.struct(F.sha2(e, 256).alias("sha"), keys(e).alias("s")))
    of = lambda x: (F.col(f"{x}.keys"), F.col(f"{x}.cells"))
    like = lambda a, b: likeness(a[0], b[0], a[1], b[1])
    sketched = rows.select("id", n.cast("long").alias("n_chars"), "s", "next_s", told.alias("e"))
    return sketched.select(
        F.col("id").alias(id_col), "n_chars", F.col("e.sha").alias("edited_sha256"),
        as_text(*of("s")).alias("fingerprint"), as_text(*of("e.s")).alias("edited_fingerprint"),
        like(of("s"), of("e.s")).alias("near_edited"), like(of("s"), of("next_s")).alias("near_next"),
    )

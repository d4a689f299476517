"""Near-duplicate groups by fast similarity sketching.

A set of word shingles is sketched by rounds of hashed bin placement: in round i
each element falls into one hashed bin with value i + hash, and a bin keeps its
least value. Rounds go on until every bin is filled; after t rounds, round t + j
puts every element into bin j, so filling is certain. Each of the t coordinates
is then equal for two sets with probability close to their Jaccard similarity,
with concentration as strong as that of t independent minima (Dahlgaard, Knudsen
and Thorup, 2017), at about t ln t + |set| hashes instead of t * |set|.

Bands of coordinates give buckets. Sets that are equal are one node. In a bucket,
nodes are compared with the one amid the most copies, and then each pair of nodes
that are still in different components is compared, so no link that could join two
components stays untested; pairs inside a component never are listed. What each set
shares with its bucket's centre, counted exactly, rules out most of the others: beyond
that, two sets share only elements outside the centre. Every link is confirmed on the
full sets, and components are found by large-star and small-star steps on tables,
never on the driver.

With 40 bands of 6 coordinates, two sets of similarity 0.8 share no bucket with
probability (1 - 0.8^6)^40 < 6e-6.

Edge cases: null or empty texts, and texts without words, have an empty set, are
linked with nothing and are kept; a text of fewer words than a shingle is one
shingle; rows that repeat an id each give a row, and carry its smallest id; rows
with a null id belong to their set's node and get the group's smallest id, or
null if it has none; an empty table gives an empty result; extra columns are not
read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_durable, durable, words_of

BANDS, ROWS = 40, 6
COORDINATES = BANDS * ROWS
#: Pairs whose one-bit sketches agree less than the least similarity allows by so many standard deviations are not confirmed.
DEVIATIONS = 6.0
#: Members that one task compares with a copy of a centre's text.
MEMBERS_PER_CENTRE = 256

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64((1 << 40) - 1)
_LOW31 = np.uint64((1 << 31) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_SEEDS = _mix(np.arange(1, 2 * 4096 + 1, dtype=np.uint64) * _GOLDEN)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of the whole text."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(k, len(words))
    out = np.full(len(words) - width + 1, np.uint64(width), np.uint64)
    for j in range(width):
        out = _mix(out * _GOLDEN + h[j : len(words) - width + 1 + j])
    return np.unique(out)


def sketch(x: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """t coordinates of a set of at least one element; t at most 4096."""
    s = np.full(t, _EMPTY, np.uint64)
    done, wanted = 0, int(1.3 * t * (np.log(t) + 1))
    while done < t:
        rounds = min(t - done, max(1, -(-wanted // len(x))))
        numbers = np.arange(done, done + rounds, dtype=np.uint64)
        h = _mix(x[None, :] ^ _SEEDS[done : done + rounds, None])
        np.minimum.at(s, ((h >> np.uint64(40)) % np.uint64(t)).ravel().astype(np.intp), ((h & _LOW) | (numbers[:, None] << np.uint64(40))).ravel())
        done += rounds
        if not (s == _EMPTY).any():
            return s
    for j in np.flatnonzero(s == _EMPTY):
        s[j] = (np.uint64(t + int(j)) << np.uint64(40)) | (_mix(x ^ _SEEDS[t + j]) & _LOW).min()
    return s


def band_keys(s: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for column in s.reshape(bands, rows).T:
        key = _mix(key * _GOLDEN + column)
    return key.view(np.int64)


def one_bits(s: np.ndarray) -> np.ndarray:
    """The lowest bits of the coordinates, in 64-bit words."""
    bits = np.packbits((s & np.uint64(1)).astype(np.uint8))
    return np.concatenate([bits, np.zeros(-len(bits) % 8, np.uint8)]).view(np.int64)


def set_digest(x: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(x.tobytes())


def _text_hash(text: Column) -> Column:
    return F.xxhash64(text.cast("string"), F.char_length(text.cast("string")))


def _sketched(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    small = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), _text_hash(F.col(text_col)).alias("h"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, digest, keys, bits = [], [], [], []
                for text in part.column(1).to_pylist():
                    x = shingle_set(text, k)
                    n.append(len(x))
                    if len(x):
                        s = sketch(x)
                        digest.append(set_digest(x))
                        keys.append(band_keys(s))
                        bits.append(one_bits(s))
                    else:
                        digest.append(None)
                        keys.append(None)
                        bits.append(None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                    names=["id", "h", "n", "node", "keys", "bits"],
                )

    return small.mapInArrow(run, f"id {dict(small.dtypes)['id']}, h long, n long, node binary, keys array<long>, bits array<long>")


def _may_link(percent: int, a: str, b: str) -> Column:
    """Sizes, one-bit sketches and what is known of their bucket's pivot don't rule out a link of nodes a and b.

    Of a and b both, the elements within the pivot's set are counted; beyond these
    they can share something only if their elements outside it have a hash in common.
    """
    least = percent / 100
    agree = (1 + least) / 2
    most_apart = COORDINATES * (1 - agree) + DEVIATIONS * (COORDINATES * agree * (1 - agree)) ** 0.5
    words = -(-COORDINATES // 64)
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.get(f"{a}.bits", F.lit(i)).bitwiseXOR(F.get(f"{b}.bits", F.lit(i)))) for i in range(words)])
    sizes = 100 * F.least(f"{a}.n", f"{b}.n") >= percent * F.greatest(f"{a}.n", f"{b}.n")
    within = F.least(f"{a}.common", f"{b}.common")
    enough = 100 * within >= percent * (F.col(f"{a}.n") + F.col(f"{b}.n") - within)
    return sizes & (apart <= most_apart) & (enough | F.arrays_overlap(f"{a}.outside", f"{b}.outside"))


def _compared(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, linked, common, outside) for the pairs (a, b): whether the full sets are similar
    enough, how many elements they share, and hashes of b's elements outside a.

    A centre a with many members is copied once per MEMBERS_PER_CENTRE of them, so
    no task takes more than that for one centre.
    """
    pairs = durable(pairs.distinct(), "pairs")
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS_PER_CENTRE).cast("int").alias("shares"))
    shares = durable(shares, "shares")
    centres = (
        texts.join(shares, texts.node == shares.a)
        .select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(None).cast("binary").alias("b"), "text")
    )
    members = (
        pairs.join(shares, "a")
        .select("a", "b", F.pmod(F.xxhash64("b"), F.col("shares").cast("long")).cast("int").alias("share"))
        .join(texts, F.col("b") == texts.node)
        .select("a", "share", "b", "text")
    )

    names = ["a", "b", "linked", "common", "outside"]

    def run(batches):
        centre, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            rows = []
            for a, _, b, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = shingle_set(text, k)
                if b is None:
                    if set_digest(x) == a:  # texts meet their nodes by hash
                        centre, own = a, x
                elif a == centre and set_digest(x) == b:
                    beyond = np.setdiff1d(x, own, assume_unique=True)
                    common = len(x) - len(beyond)
                    rows.append((a, b, 100 * common >= percent * (len(own) + len(beyond)), common, (beyond & _LOW31).astype(np.int32)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.binary(), pa.binary(), pa.bool_(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names)

    both = centres.unionByName(members).repartition("a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())
    return durable(both.mapInArrow(run, "a binary, b binary, linked boolean, common long, outside array<int>"), "compared")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every end of the links (a, b): label is its component's smallest node.

    Large-star and small-star steps alternate until the edges stop changing; each
    step is an aggregation and a join, and its result a table in the shared folder.
    """
    if links.isEmpty():
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    ends = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = durable(ends, "edges")
    state_of = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = state_of(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = durable(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        # large star: each larger neighbour goes to the least of the neighbourhood; edges (u, v) have u > v, so v sees u
        large = durable(edges.join(least, edges.v == least.u).select(edges.u, F.col("m").alias("v")).distinct(), "edges")
        # small star: the smaller neighbours and the node itself go to the least of them
        least_small = durable(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least_small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least_small.select("u", F.col("m").alias("v")))
        after = durable(small.where("u <> v").distinct(), "edges")
        state = state_of(after)
        for old in (edges, least, large, least_small):
            drop_durable(old)
        edges = after
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _joined(links: DataFrame, labels: DataFrame) -> DataFrame:
    """labels after the components at the ends of links are joined."""
    a, b = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    lifted = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    over = durable(components(lifted).select(F.col("node").alias("was"), F.col("label").alias("now")), "labels")
    kept = labels.join(over, labels.label == over.was, "left").select("node", F.coalesce("now", "label").alias("label"))
    new = over.join(labels, over.was == labels.node, "left_anti").select(F.col("was").alias("node"), F.col("now").alias("label"))
    return durable(kept.unionByName(new), "labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept."""
    each = durable(_sketched(docs, id_col, text_col, k), "sketched")
    # one row for each set, though its copies may be many; h: hash of one of its texts
    nodes = durable(
        each.where("node is not null").groupBy("node").agg(F.min("id").alias("first_id"), F.min("h").alias("h"), F.max("n").alias("n"), F.first("keys").alias("keys"), F.first("bits").alias("bits")),
        "nodes",
    )
    entries = nodes.select("node", F.explode("keys").alias("bucket"))
    shared = durable(entries.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1"), "buckets")
    members = durable(entries.join(shared, "bucket").select("bucket", "node", "c"), "members")

    # a node amid many copies shares large buckets in most bands: it is the one to compare the others with
    weights = durable(members.groupBy("node").agg(F.sum("c").alias("weight")), "weights")
    facts = durable(nodes.join(weights, "node").select("node", "n", "bits", "keys", "h", "weight"), "facts")
    weighed = members.join(weights, "node").select("bucket", "node", "weight")
    pivots = durable(weighed.groupBy("bucket").agg(F.max_by("node", F.struct("weight", "node")).alias("pivot")), "pivots")

    # a text for each node, by the hash of one of its texts: copies are dropped before they are shuffled
    source = docs.select(_text_hash(F.col(text_col)).alias("h"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    texts = durable(source.groupBy("h").agg(F.min("text").alias("text")).join(facts.select("node", "h"), "h").select("node", "text"), "texts")

    # every member against its bucket's pivot
    starred = members.join(pivots, "bucket").where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    stars = _compared(starred, texts, k, percent)
    labels = durable(components(stars.where("linked").select("a", "b")), "labels")

    # what is left in different components of one bucket, each pair in the first bucket that it shares
    now = durable(members.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label")), "now")
    per_label = durable(now.groupBy("bucket", "label").agg(F.count("*").alias("c")), "perlabel")
    mixed = durable(per_label.groupBy("bucket").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("c", "label")).alias("main")).where("labels > 1"), "mixed")
    rows = now.join(mixed, "bucket").join(pivots, "bucket").select("bucket", "pivot", "node", "label", (F.col("label") == F.col("main")).alias("is_main"))
    rows = durable(rows.join(facts, "node").select("bucket", "pivot", "node", "label", "is_main", "n", "bits", "keys"), "rows")
    own = F.col("node") == F.col("pivot")
    known = stars.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "common", "outside")
    rows = rows.join(known, ["pivot", "node"], "left").select(
        "bucket", "node", "label", "is_main", "n", "bits", "keys",
        F.when(own, F.col("n")).otherwise(F.col("common")).alias("common"), F.when(own, F.array().cast("array<int>")).otherwise(F.col("outside")).alias("outside"),
    )
    rows = durable(rows, "rows")
    side = lambda of: F.struct("n", "bits", "keys", "common", "outside").alias(of)
    # the largest component of a bucket is on one side only: pairs within it never arise
    left = rows.where("not is_main").select("bucket", F.col("node").alias("a"), F.col("label").alias("label_a"), side("fa")).alias("l")
    right = rows.select("bucket", F.col("node").alias("b"), F.col("label").alias("label_b"), "is_main", side("fb")).alias("r")
    first_shared = F.get(F.array_intersect(F.col("fa.keys"), F.col("fb.keys")), F.lit(0)) == F.col("l.bucket")
    apart = (F.col("label_a") != F.col("label_b")) & (F.col("is_main") | (F.col("a") < F.col("b")))
    pairs = left.join(right, (F.col("l.bucket") == F.col("r.bucket")) & apart & _may_link(percent, "fa", "fb") & first_shared).select("a", "b")
    links = _compared(pairs, texts, k, percent)
    labels = _joined(links.where("linked").select("a", "b"), labels)

    groups = nodes.join(labels, "node", "left").select("node", "first_id", F.coalesce("label", "node").alias("label"))
    groups = durable(groups, "groups")
    firsts = durable(groups.groupBy("label").agg(F.min("first_id").alias("component_id")), "firsts")
    named = durable(groups.join(firsts, "label").select("node", "component_id"), "named")
    own = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return each.select("id", "n", "node").join(named, "node", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(False)).alias("kept")
    )

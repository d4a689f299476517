"""Removal of repeated multi-line chunks with content-defined boundaries.

A line ends at a newline, or at a sentence end within one (prose is often stored
without hard breaks). Each line is hashed; a hash rolled over each pair of
neighbouring line hashes decides whether a chunk ends there. A boundary thus
depends on two lines only, and lines added or removed elsewhere shift no other.
Chunks are first grouped by hash alone, without their text; of those whose hash
is not alone the bytes are read again and grouped, so equal hashes alone remove
nothing. Of a chunk of at least two lines that occurs more than once, the first
occurrence stays (smallest id, then position) and the others are cut out.

All DataFrame functions. Hashes, ids and positions are shuffled; of the texts only
the chunks with a hash in common, pre-aggregated, and each document to meet what
goes from it.

Edge cases: null texts stay null, empty ones empty; a text without two lines
stays as it is; rows with a null id are left alone and count as no occurrence;
rows that share an id count as one document: of a chunk's first document the
smallest position stays, in each of its rows; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_durable, durable

#: Position after a newline, or after a sentence end with its blank.
LINE_END = r"(?<=\n)|(?<=[.!?] )"
#: A chunk ends where the rolled hash begins with a digit below this: every second line on average.
BOUNDARY_BELOW = "8"
MIN_LINES, MIN_CHARS = 2, 40


#: Marks line ends while a text is cut; texts that hold it themselves are cut by the pattern.
MARK = "\x01"


def lines_of(text: Column) -> Column:
    """Lines with their ends; together they are the text. Literal replacements are much faster than the pattern."""
    t = F.coalesce(text, F.lit(""))
    marked = t
    for end in ("\n", ". ", "! ", "? "):
        marked = F.replace(marked, F.lit(end), F.lit(end + MARK))
    # a mark follows a line's end, so that only what comes after the last one can be empty
    by_mark = F.split(F.rtrim(marked, F.lit(MARK)), MARK, -1)
    by_pattern = F.filter(F.split(t, LINE_END, -1), lambda x: x != "")
    return F.when(t == "", F.array().cast("array<string>")).when(F.contains(t, F.lit(MARK)), by_pattern).otherwise(by_mark)


def _once(value: Column, use) -> Column:
    """use(value), with value worked out once: a one-row array binds it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


CHUNK = "array<struct<line:int,n:int,chunk:string,chars:int>>"


def chunks_of(lines: Column) -> Column:
    """array<struct<line, n, chunk, chars>>: consecutive chunks of n lines from that line (from 1) that together are the text."""

    def ends(ls, hs):
        n = F.size(ls)
        rolled = lambda i: F.substring(F.md5(F.concat(F.get(hs, i - 2), F.get(hs, i - 1)).cast("binary")), 1, 1)
        return F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: (i == n) | ((i > 1) & (rolled(i) < BOUNDARY_BELOW)))

    def cut(ls, es):
        def chunk(e, k):
            n = F.when(k > 0, e - F.get(es, k - 1)).otherwise(e)
            whole = lambda m: F.when(m == 1, F.get(ls, e - 1)).otherwise(F.array_join(F.slice(ls, e - m + 1, m), ""))
            return _once(n, lambda m: _once(whole(m), lambda t: F.struct((e - m + 1).alias("line"), m.alias("n"), t.alias("chunk"), F.char_length(t).alias("chars"))))

        return F.transform(es, chunk)

    hashes = lambda ls: F.transform(ls, lambda x: F.md5(x.cast("binary")))
    found = _once(lines, lambda ls: _once(hashes(ls), lambda hs: _once(ends(ls, hs), lambda es: cut(ls, es))))
    return F.coalesce(found, F.array().cast(CHUNK))


def keys_of(chunks: Column) -> Column:
    """array<struct<line, n, more, key>>: chunks whose span is long enough, and the hash of the span.

    The span is what must repeat for the chunk to go: itself, or if it is too short,
    itself and the chunk before it (the first one: after it), of -more (more) lines.
    """

    def one(c, k):
        other = F.get(chunks, F.when(k > 0, k - 1).otherwise(F.lit(1)))
        short = F.when(
            (c["n"] + F.coalesce(other["n"], F.lit(0)) >= MIN_LINES) & (c["chars"] + F.coalesce(other["chars"], F.lit(0)) >= MIN_CHARS),
            F.struct(
                c["line"].alias("line"), c["n"].alias("n"), (F.coalesce(other["n"], F.lit(0)) * F.when(k > 0, -1).otherwise(1)).alias("more"),
                F.xxhash64(F.when(k > 0, F.concat(other["chunk"], c["chunk"])).otherwise(F.concat(c["chunk"], F.coalesce(other["chunk"], F.lit(""))))).alias("key"),
            ),
        )
        own = F.struct(c["line"].alias("line"), c["n"].alias("n"), F.lit(0).alias("more"), F.xxhash64(c["chunk"]).alias("key"))
        return F.when((c["n"] >= MIN_LINES) & (c["chars"] >= MIN_CHARS), own).otherwise(short)

    return F.filter(F.transform(chunks, one), lambda x: x.isNotNull())


def span_of(lines: Column, place: Column) -> Column:
    """The text that keys_of() hashed for a chunk at this place."""
    start = place["line"] + F.least(place["more"], F.lit(0))
    return F.array_join(F.slice(lines, start, place["n"] + F.abs(place["more"])), "")


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, text (without what was removed), n_lines, n_removed (lines), and the columns to carry."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(F.lit(0), *carry).alias("other"))
    known = rows.where("id is not null").withColumn("h", F.xxhash64("text"))
    lines = lines_of(F.col("text"))

    # chunks by hash only; of one key, those that are alone repeat nothing
    keyed = _once(lines, lambda ls: F.struct(F.size(ls).alias("n_lines"), _once(chunks_of(ls), keys_of).alias("keys")))
    cut = durable(known.select("id", "h", keyed.alias("x")).select("id", "h", "x.*"), "chunks")
    place = F.struct("line", "n", "more")
    each = cut.select("id", "h", F.inline("keys"))
    shared = durable(each.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "shared")
    hits = durable(each.join(shared, "key").select("id", "h", "line", "n", "more", "key"), "hits")

    # the bytes of these: which of them are equal, and whose is the first
    places = hits.groupBy("id", "h").agg(F.collect_set(place).alias("places"))
    spans = _once(lines, lambda ls: F.transform("places", lambda p: F.struct(p["line"].alias("line"), p["n"].alias("n"), p["more"].alias("more"), span_of(ls, p).alias("span"))))
    told = known.select("id", "h", "text").join(places, ["id", "h"]).select("id", "h", F.inline(spans)).withColumn("key", F.xxhash64("span"))
    texts = durable(told.groupBy("key", "span").agg(F.min("id").alias("first_id"), F.count("*").alias("c")), "texts")
    by_key = durable(texts.groupBy("key").agg(F.count("*").alias("texts"), F.min("first_id").alias("first_id"), F.sum("c").alias("c")).where("texts > 1 or c > 1"), "keys")
    # a key with one text stands for its bytes; where two texts meet in one key, the texts themselves decide
    repeats = hits.join(by_key.where("texts = 1").select("key", "first_id"), "key").select("id", "h", "line", "n", "key", "first_id", F.lit(None).cast("string").alias("span"))
    if not by_key.where("texts > 1").isEmpty():
        mixed = told.join(by_key.where("texts > 1").select("key"), "key", "left_semi")
        repeats = repeats.unionByName(mixed.join(texts.where("c > 1").select("key", "span", "first_id"), ["key", "span"]).select(*repeats.columns))
    foreign = repeats.where("id <> first_id").select("id", "h", "line", "n")
    # places in the document of the first occurrence: all but the first are repeats within it
    own = repeats.where("id = first_id")
    ends = own.groupBy("id", "key", "span").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line")).where("last_line > first_line")
    same = (own.id == ends.id) & (own.key == ends.key) & own.span.eqNullSafe(ends.span) & (own.line > ends.first_line)
    again = own.join(ends, same, "left_semi").select("id", "h", "line", "n")
    gone = foreign.unionByName(again).groupBy("id", "h").agg(F.collect_set(F.struct("line", "n")).alias("gone"))
    facts = durable(cut.groupBy("id", "h").agg(F.min("n_lines").alias("n_lines")).join(gone, ["id", "h"], "left"), "gone")
    for table in (shared, hits, texts, by_key, cut):
        drop_durable(table)

    # array_except is by hash: no line is looked up in a list
    gone_lines = F.flatten(F.transform("gone", lambda g: F.sequence(g["line"], g["line"] + g["n"] - 1)))
    left = _once(lines, lambda ls: _once(F.array_except(F.sequence(F.lit(1), F.size(ls)), gone_lines), lambda at: F.struct(F.array_join(F.transform(at, lambda i: F.get(ls, i - 1)), "").alias("text"), F.size(at).alias("n"))))
    joined = known.join(facts, ["id", "h"]).select("id", "other", "n_lines", "text", F.when(F.col("gone").isNotNull(), left).alias("left"))
    done = joined.select("id", "other", "n_lines", F.when(F.col("left").isNull(), F.col("text")).otherwise(F.col("left.text")).alias("text"), F.when(F.col("left").isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.col("left.n")).alias("n_removed"))
    nameless = rows.where("id is null").select("id", "other", F.size(lines).alias("n_lines"), "text", F.lit(0).alias("n_removed"))
    return done.unionByName(nameless).select(
        F.col("id").alias(id_col), F.col("text").alias(text_col), F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), *(F.col("other")[c].alias(c) for c in carry)
    )


#: A line has at least one character, so a window of MIN_CHARS characters has at most so many lines.
MOST_LINES = max(MIN_LINES, MIN_CHARS)


def windows_of(lines: Column) -> Column:
    """array<struct<start, n, span>>: the least windows of at least MIN_LINES (two) lines and MIN_CHARS characters.

    Each pair of neighbours is one; a shorter pair is extended line by line, once
    forward from its first line and once backward from its second. Every line of a
    run of that size then lies in a window within the run.
    """
    kind = "array<struct<start:int,n:int,span:string>>"

    def grown(ls, first, n, forward):
        some = F.slice(ls, first, n) if forward else F.reverse(F.slice(ls, first, n))
        more = lambda acc, x: F.when(
            F.char_length(acc["span"]) >= MIN_CHARS, acc
        ).otherwise(F.struct((acc["n"] + 1).alias("n"), (F.concat(acc["span"], x) if forward else F.concat(x, acc["span"])).alias("span")))
        return F.aggregate(some, F.struct(F.lit(0).alias("n"), F.lit("").alias("span")), more)

    def at(ls, i):  # i: from 1, the first line of a pair
        pair = F.concat(F.get(ls, i - 1), F.get(ls, i))
        whole = F.array(F.struct(i.alias("start"), F.lit(2).alias("n"), pair.alias("span")))
        lowest = F.greatest(i + 2 - MOST_LINES, F.lit(1))
        both = F.transform(
            F.array(F.struct(grown(ls, i, F.lit(MOST_LINES), True).alias("w"), F.lit(True).alias("f")), F.struct(grown(ls, lowest, i + 2 - lowest, False).alias("w"), F.lit(False).alias("f"))),
            lambda x: F.struct(F.when(x["f"], i).otherwise(i + 2 - x["w"]["n"]).alias("start"), x["w"]["n"].alias("n"), x["w"]["span"].alias("span")),
        )
        return F.when(F.char_length(pair) >= MIN_CHARS, whole.cast(kind)).otherwise(F.filter(both.cast(kind), lambda x: F.char_length(x["span"]) >= MIN_CHARS))

    bound = F.transform(F.array(lines), lambda ls: F.when(F.size(ls) > 1, F.flatten(F.transform(F.sequence(F.lit(1), F.size(ls) - 1), lambda i: at(ls, i)))))
    return F.coalesce(F.get(bound, F.lit(0)), F.array().cast(kind))


def remove_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """As remove_repeated, but every line goes that lies in a repeated run of at least MIN_LINES lines and MIN_CHARS characters.

    Runs begin and end anywhere: all windows of a text are looked up, not only its
    chunks. The first occurrence of a window stays (smallest id, then position), and
    so does the first one of each line. Windows meet by hash; those whose hashes are
    not alone are read again and compared byte by byte.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(F.lit(0), *carry).alias("other"))
    known = rows.where("id is not null")
    hashed = F.transform(windows_of(lines_of(F.col("text"))), lambda w: F.struct(w["start"].alias("start"), w["n"].alias("n"), F.xxhash64(w["span"]).alias("key")))
    each = durable(known.select("id", F.explode(hashed).alias("w")).select("id", "w.*"), "windows")
    shared = durable(each.groupBy("key").agg(F.min(F.struct("id", "start")).alias("low"), F.max(F.struct("id", "start")).alias("high")).where("low <> high").select("key"), "shared")
    hits = durable(each.join(shared, "key").select("id", "start", "n"), "hits")
    drop_durable(each)
    at = hits.groupBy("id").agg(F.collect_set(F.struct("start", "n")).alias("at"))
    # lines are bound once: a column of them would be worked out again for each window that looks into it
    span = lambda ls, w: F.struct(w["start"].alias("start"), w["n"].alias("n"), F.array_join(F.slice(ls, w["start"], w["n"]), "").alias("span"))
    spans = _once(lines_of(F.col("text")), lambda ls: F.transform("at", lambda w: span(ls, w)))
    told = durable(known.select("id", "text").join(at, "id").select("id", F.inline(spans)), "spans")
    first = durable(told.groupBy("span").agg(F.min(F.struct("id", "start")).alias("first"), F.max(F.struct("id", "start")).alias("last")).where("first <> last").select("span", "first"), "firsts")
    again = told.join(first, "span").where(F.struct("id", "start") > F.col("first"))
    gone = again.select("id", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("line")).groupBy("id").agg(F.collect_set("line").alias("gone"))

    # array_except is by hash: no line is looked up in a list
    left = lambda ls: _once(F.array_except(F.sequence(F.lit(1), F.size(ls)), F.col("gone")), lambda at: F.struct(F.array_join(F.transform(at, lambda i: F.get(ls, i - 1)), "").alias("text"), F.size(ls).alias("n"), F.size(at).alias("kept")))
    lines = lines_of(F.col("text"))
    untouched = _once(F.size(lines), lambda n: F.struct(F.col("text").alias("text"), n.alias("n"), n.alias("kept")))
    cut = rows.join(gone, "id", "left").select("id", "other", F.when(F.col("gone").isNull(), untouched).otherwise(_once(lines, left)).alias("x"))
    return cut.select(
        F.col("id").alias(id_col), F.col("x.text").alias(text_col), F.col("x.n").cast("long").alias("n_lines"),
        (F.col("x.n") - F.col("x.kept")).cast("long").alias("n_removed"), *(F.col("other")[c].alias(c) for c in carry),
    )


#: The same rows as remove_repeated in DuckDB's SQL over ``documents``.
ORACLE = f"""
WITH cut AS (
  SELECT doc_id, text, list_filter(string_split(regexp_replace(coalesce(text, ''), '(\\n|[.!?] )', '\\1' || chr(31), 'g'), chr(31)), lambda x: x <> '') AS ls
  FROM documents),
ends AS (
  SELECT *, list_filter(range(1, len(ls) + 1), lambda i: i = len(ls) OR (i > 1 AND substr(md5(md5(ls[i - 1]) || md5(ls[i])), 1, 1) < '{BOUNDARY_BELOW}')) AS es FROM cut),
chunks AS (
  SELECT doc_id, k AS pos, es[k] - coalesce(es[k - 1], 0) AS n, array_to_string(ls[coalesce(es[k - 1], 0) + 1 : es[k]], '') AS chunk
  FROM (SELECT doc_id, ls, es, unnest(range(1, len(es) + 1)) AS k FROM ends)),
near AS (
  SELECT *, lag(chunk) OVER d AS before, lag(n) OVER d AS n_before, coalesce(lead(chunk) OVER d, '') AS after, coalesce(lead(n) OVER d, 0) AS n_after
  FROM chunks WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
spans AS (
  SELECT doc_id, pos, n, chunk,
    CASE WHEN n >= {MIN_LINES} AND length(chunk) >= {MIN_CHARS} THEN chunk WHEN pos > 1 THEN before || chunk ELSE chunk || after END AS span,
    CASE WHEN n >= {MIN_LINES} AND length(chunk) >= {MIN_CHARS} THEN n WHEN pos > 1 THEN n + n_before ELSE n + n_after END AS n_span
  FROM near),
marked AS (
  SELECT *, counts AND row_number() OVER (PARTITION BY span, counts ORDER BY doc_id, pos) > 1 AS gone
  FROM (SELECT *, n_span >= {MIN_LINES} AND length(span) >= {MIN_CHARS} AS counts FROM spans)),
whole AS (
  SELECT doc_id, coalesce(string_agg(chunk, '' ORDER BY pos) FILTER (NOT gone), '') AS text, coalesce(sum(n) FILTER (gone), 0) AS n_removed
  FROM marked GROUP BY doc_id)
SELECT cut.doc_id, CASE WHEN cut.text IS NULL OR coalesce(n_removed, 0) = 0 THEN cut.text ELSE whole.text END AS text,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed
FROM cut LEFT JOIN whole ON cut.doc_id = whole.doc_id
"""

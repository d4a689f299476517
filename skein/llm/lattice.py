"""Marginal log-likelihood of texts under a subword unigram model.

The pieces are those of an existing tokenizer model file; their probabilities are
learned from the training rows by expectation maximisation: the expected pieces of
each distinct word, times how often the word occurs. A word's probability sums over all its segmentations
into pieces, by a forward recursion in log space; a text is its words, each with a
leading word mark, then an end token. Since no piece reaches over a word mark
other than at its start, the lattice of a text is the chain of its words'
lattices, and each distinct word of the corpus is worked out once, whole, however
long it is. (The public files hold no unigram model; these pieces are a BPE file's,
so that their scores have to be learned.)

Word counts cover all training rows. Frequent words of at most HEAD_WORD_BYTES
bytes, HEAD_WORDS of them at most, go to every worker with their counts and scores;
the rest of a text's words meet theirs in a join, each distinct word of a text once.

Edge cases: null and empty texts, and texts of white space, have one token, the
end; a null id counts as not held out and not in training; repeated rows count and
score each; words of any length are whole; with no training rows N is 0 and every
probability comes from the smoothing alone; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_durable, durable, id_remainder, words_of, worker_memo

MARK = "▁"
HEAD_WORDS, HEAD_WORD_BYTES = 100_000, 48
#: Distinct words that a task counts before it passes them on.
COUNTED_WORDS = 300_000
EM_ROUNDS = 7
#: Words, and about the most characters, in one row of lattices; such a row has half a megabyte, so few are read and sent at a time.
CHUNK_WORDS, CHUNK_CHARS = 2048, 32_768
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "16", "spark.sql.parquet.columnarReaderBatchSize": "16"}
LN10 = math.log(10)
#: Added to each piece's count.
SMOOTHING = 0.1


@dataclass
class Pieces:
    """trie: natural log-probability of each piece, None for each beginning of one; byte_log_p: of the 256 byte pieces."""

    trie: dict[str, float | None]
    byte_log_p: list[float]
    end_log_p: float

    @classmethod
    def of(cls, names: list[str], byte_ids: dict[int, int], counts: list[float], ends: float) -> Pieces:
        """counts: by piece; names: text of each piece that a word can hold, None for the others."""
        total = math.log(sum(counts) + ends + SMOOTHING * (len(counts) + 1))
        trie: dict[str, float | None] = {}
        for name, c in zip(names, counts, strict=True):
            if name is not None:
                for k in range(1, len(name)):
                    trie.setdefault(name[:k], None)
                trie[name] = math.log(c + SMOOTHING) - total
        least = math.log(SMOOTHING) - total
        return cls(trie, [math.log(counts[byte_ids[b]] + SMOOTHING) - total if b in byte_ids else least for b in range(256)], math.log(ends + SMOOTHING) - total)

    def bytes_log_p(self, char: str) -> float:
        return sum(self.byte_log_p[b] for b in char.encode("utf-8", "surrogatepass"))


def word_log_p(word: str, m: Pieces) -> float:
    """log of the sum over all segmentations of the marked word; a character that is no piece is its bytes.

    The forward recursion in log space: terms[e] are the ways to reach e, and their
    log-sum is known when e is the next start.
    """
    text = MARK + word
    trie, n = m.trie, len(text)
    exp, log = math.exp, math.log
    terms: list[list[float]] = [[] for _ in range(n + 1)]
    terms[0].append(0.0)
    top = 0.0
    for start in range(n + 1):
        ways = terms[start]
        if len(ways) == 1:
            here = ways[0]
        else:
            top = max(ways)
            here = top + log(sum([exp(t - top) for t in ways]))
        terms[start] = ways = ()
        if start == n:
            return here
        if trie.get(text[start]) is None:
            terms[start + 1].append(here + m.bytes_log_p(text[start]))
        for end in range(start + 1, n + 1):
            p = trie.get(text[start:end], 0)
            if p == 0:
                break
            if p is not None:
                terms[end].append(here + p)
    raise AssertionError


#: An edge in one number: the node it leads to, the characters it spans and its piece.
SPAN_BITS, PIECE_BITS = 7, 21


_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SLOT_BITS = 20


def _further(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Hashes of strings that are one code point longer."""
    x = h * _GOLDEN + points.astype(np.uint64) + np.uint64(1)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class PieceTable:
    """Piece numbers by the 64-bit hash of the text, for arrays of hashes: -1 for beginnings of pieces, -2 for anything else."""

    def __init__(self, names: dict[str, int]):
        pieces = {x: i for x, i in names.items()}
        for x in names:
            for k in range(1, len(x)):
                pieces.setdefault(x[:k], -1)
        self.longest = max(map(len, names), default=0)
        lengths = np.array([len(x) for x in pieces])
        points = np.zeros((len(pieces), self.longest), np.uint32)
        for k, x in enumerate(pieces):
            points[k, : len(x)] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
        h = np.zeros(len(pieces), np.uint64)
        for j in range(self.longest):
            longer = lengths > j
            h[longer] = _further(h[longer], points[longer, j])
        order = np.argsort(h)
        self.hashes, self.numbers = h[order], np.array(list(pieces.values()), np.int64)[order]
        slots = (self.hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        self.first = np.searchsorted(slots, np.arange((1 << SLOT_BITS) + 1))
        self.probes = int(np.diff(self.first).max(initial=0))

    def find(self, h: np.ndarray) -> np.ndarray:
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        out = np.full(len(h), -2, np.int64)
        for _ in range(self.probes):
            here = np.flatnonzero(at < end)
            if not len(here):
                break
            same = here[self.hashes[at[here]] == h[here]]
            out[same] = self.numbers[at[same]]
            at = at + 1
        return out


def lattice_of(words: list[str], table: PieceTable, size: int) -> tuple[np.ndarray, np.ndarray, str]:
    """Edges of the lattices of marked words by position and node, the words' lengths, and the characters that are no piece.

    Nodes are the positions in all words, one word after another. All strings of one
    length are looked up at once; only those that begin a piece go on to the next. The
    k-th character that is no piece counts as piece size + k.
    """
    points = np.frombuffer("".join([MARK + w for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), lengths)
    position = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left = lengths[word] - position
    node = np.arange(len(points)) + word
    edges, levels, chars = [], [], ""
    at, h = np.arange(len(points)), np.zeros(len(points), np.uint64)
    for n in range(1, table.longest + 1):
        inside = left[at] >= n
        at, h = at[inside], h[inside]
        if not len(at):
            break
        h = _further(h, points[at + n - 1])
        found = table.find(h)
        piece = found >= 0
        own = at[piece]
        edges.append((node[own] + n) << (SPAN_BITS + PIECE_BITS) | n << PIECE_BITS | found[piece])
        levels.append(position[own] + n)
        if n == 1:
            other = at[~piece]
            distinct, number = np.unique(points[other], return_inverse=True)
            chars = distinct.tobytes().decode("utf-32-le", "surrogatepass")
            edges.append((node[other] + 1) << (SPAN_BITS + PIECE_BITS) | 1 << PIECE_BITS | (size + number))
            levels.append(position[other] + 1)
        goes_on = found > -2
        at, h = at[goes_on], h[goes_on]
    packed, level = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (edges, levels))
    return packed[np.lexsort([packed, level])], lengths, chars


class Chunk:
    """The lattices of some words: forward sums, and the expected pieces of their segmentations."""

    def __init__(self, edges: np.ndarray, lengths: np.ndarray, log_p: np.ndarray):
        self.piece = edges & ((1 << PIECE_BITS) - 1)
        self.there = edges >> (PIECE_BITS + SPAN_BITS)
        self.here = self.there - (edges >> PIECE_BITS & ((1 << SPAN_BITS) - 1))
        self.size = len(log_p)
        first = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.nodes, self.last = int(first[-1]), first[1:] - 1
        level = (np.arange(self.nodes) - np.repeat(first[:-1], lengths + 1))[self.there]
        bounds = np.append(np.flatnonzero(np.diff(level, prepend=0)), len(level))
        self.spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
        p = log_p[self.piece]
        self.forward, self.share = np.zeros(self.nodes), np.zeros(len(edges))
        for i, j in self.spans:
            ways, to = self.forward[self.here[i:j]] + p[i:j], self.there[i:j]
            starts = np.flatnonzero(np.diff(to, prepend=-1))
            n = np.diff(starts, append=j - i)
            top = np.maximum.reduceat(ways, starts)
            ways = np.exp(ways - np.repeat(top, n))
            total = np.add.reduceat(ways, starts)
            self.forward[to[starts]] = top + np.log(total)
            self.share[i:j] = ways / np.repeat(total, n)

    def log_p(self) -> np.ndarray:
        """log of the sum over all segmentations of each word."""
        return self.forward[self.last]

    def expected_pieces(self, counts: np.ndarray) -> np.ndarray:
        """Expected occurrences of each piece over all segmentations of the words, times their counts.

        A node's share of a word's segmentations goes back to the edges into it by
        their shares of its forward sum, so nothing underflows.
        """
        passing = np.zeros(self.nodes)
        passing[self.last] = counts
        share = self.share.copy()
        for i, j in reversed(self.spans):
            share[i:j] *= passing[self.there[i:j]]
            passing[self.here[i:j]] += share[i:j]  # edges of one level lead to different words or start apart
        return np.bincount(self.piece, share, self.size)


def _chunks(words: list[str]):
    """Numbers from and to of words that make a row of lattices."""
    start = chars = 0
    for k, word in enumerate(words):
        if k > start and (k - start >= CHUNK_WORDS or chars + len(word) > CHUNK_CHARS):
            yield start, k
            start, chars = k, 0
        chars += len(word)
    if start < len(words):
        yield start, len(words)


def _word_counts(rows: DataFrame) -> DataFrame:
    """(word, c) over whole texts of (text, train): c counts the training rows; summed within each task before the shuffle."""

    def run(batches):
        held: Counter = Counter()

        def flush():
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])
            held.clear()

        for batch in batches:
            for text, train in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if train:
                    held.update(words_of(text))
                else:
                    for word in set(words_of(text)):
                        held.setdefault(word, 0)
                if len(held) > COUNTED_WORDS:
                    yield from flush()
        yield from flush()

    return rows.select("text", "train").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def learn_pieces(words: DataFrame, ends: int, model_path: str) -> tuple[Pieces, DataFrame]:
    """Probabilities of the pieces of the model file for the words (word, c), and (word, c, log_p).

    They start from the tokenizer's own segmentation of every distinct word and go
    through EM_ROUNDS rounds of expectation maximisation over all of them, weighted
    by their counts. The lattices are worked out and written once; a round collects
    one count a piece, and the last pass leaves the words' scores.
    """
    import sentencepiece

    context = words.sparkSession.sparkContext
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    size = sp.vocab_size()
    names: list[str | None] = [None if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) else sp.id_to_piece(i) for i in range(size)]
    # a piece with a mark elsewhere than at its start can be part of no word
    names = [None if x is None or MARK in x[1:] else x for x in names]
    if max(len(x) for x in names if x) >= 1 << SPAN_BITS:
        raise ValueError("a piece of the model is too long")
    byte_ids = {int(sp.id_to_piece(i)[3:-1], 16): i for i in range(size) if sp.is_byte(i)}
    told = context.broadcast((sp.serialized_model_proto(), PieceTable({x: i for i, x in enumerate(names) if x is not None})))
    key = uuid.uuid4().hex
    fields = ["words", "lengths", "counts", "edges", "chars", "used", "starts"]
    kinds = (pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.string(), pa.binary(), pa.binary())

    def build(batches):
        proto, table = told.value
        own = worker_memo("lattice", key, lambda: sentencepiece.SentencePieceProcessor(model_proto=proto))
        for batch in batches:
            all_words, all_counts = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            for i, j in _chunks(all_words):
                some, counts = all_words[i:j], all_counts[i:j].astype(float)
                encoded = own.encode(some, num_threads=1)
                starts = np.bincount(np.array([x for ids in encoded for x in ids], np.int64), np.repeat(counts, [len(ids) for ids in encoded]), size)
                used = np.flatnonzero(starts)
                edges, lengths, chars = lattice_of(some, table, size)
                row = ("\n".join(some), lengths.tobytes(), counts.tobytes(), edges.tobytes(), chars, used.tobytes(), starts[used].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names=fields)

    lattices = durable(words.select("word", "c").mapInArrow(build, "words string, lengths binary, counts binary, edges binary, chars string, used binary, starts binary"), "lattices")

    def summed(rows: DataFrame, of) -> list[float]:
        """of() gives each row's counts by piece; they are summed within each task, then over all."""

        def run(batches):
            found = np.zeros(size)
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    of(found, *row)
            used = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(found[used], pa.float64())], names=["piece", "c"])

        # exact sums of rounded counts, so that the order of addition leaves no trace
        exact = F.sum(F.round("c", 6).cast("decimal(30,6)")).cast("double")
        out = [0.0] * size
        for r in rows.mapInArrow(run, "piece int, c double").groupBy("piece").agg(exact.alias("c")).collect():
            out[r.piece] = r.c
        return out

    conf = words.sparkSession.conf
    before = {k: conf.get(k) for k in SMALL_BATCHES}
    for k, v in SMALL_BATCHES.items():
        conf.set(k, v)
    try:
        pieces = _rounds(lattices, summed, names, byte_ids, ends)
        scored = durable(_scores(lattices, pieces, names), "wordscores")
    finally:
        for k, v in before.items():
            conf.set(k, v)
        drop_durable(lattices)
    return pieces, scored


def _by_piece(m: Pieces, names: list[str | None]) -> tuple[np.ndarray, list[float]]:
    return np.array([m.trie[x] if x is not None else 0.0 for x in names]), m.byte_log_p


def _chunk(held, edges: bytes, lengths: bytes, spelled: list[bytes]) -> Chunk:
    log_p, byte_log_p = held
    return Chunk(np.frombuffer(edges, np.int64), np.frombuffer(lengths, np.int64), np.concatenate([log_p, [sum(byte_log_p[b] for b in x) for x in spelled]]))


def _rounds(lattices: DataFrame, summed, names: list[str | None], byte_ids: dict[int, int], ends: int) -> Pieces:
    context, size = lattices.sparkSession.sparkContext, len(names)

    def start(found, used, starts):
        np.add.at(found, np.frombuffer(used, np.int64), np.frombuffer(starts))

    counts = summed(lattices.select("used", "starts"), start)
    for _ in range(EM_ROUNDS):
        held = context.broadcast(_by_piece(Pieces.of(names, byte_ids, counts, ends), names))

        def one(found, edges, lengths, counts, chars, held=held):
            spelled = [x.encode("utf-8", "surrogatepass") for x in chars]
            got = _chunk(held.value, edges, lengths, spelled).expected_pieces(np.frombuffer(counts))
            found += got[:size]
            for x, c in zip(spelled, got[size:], strict=True):
                for b in x:
                    if b in byte_ids:
                        found[byte_ids[b]] += c

        counts = summed(lattices.select("edges", "lengths", "counts", "chars"), one)
        held.unpersist()
    return Pieces.of(names, byte_ids, counts, ends)


def _scores(lattices: DataFrame, pieces: Pieces, names: list[str | None]) -> DataFrame:
    """(word, c, log_p), natural logarithm, of all words of the lattices."""
    held = lattices.sparkSession.sparkContext.broadcast(_by_piece(pieces, names))

    def run(batches):
        for batch in batches:
            for words, lengths, counts, edges, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                log_p = _chunk(held.value, edges, lengths, [x.encode("utf-8", "surrogatepass") for x in chars]).log_p()
                yield pa.RecordBatch.from_arrays([pa.array(words.split("\n")), pa.array(np.frombuffer(counts).astype(np.int64)), pa.array(log_p)], names=["word", "c", "log_p"])

    return lattices.select("words", "lengths", "counts", "edges", "chars").mapInArrow(run, "word string, c long, log_p double")


def _frequent(words: DataFrame) -> DataFrame:
    """Words so frequent that there are at most HEAD_WORDS of them: whole classes of counts, by a histogram of 16 classes to a doubling."""
    short = words.where((F.octet_length("word") <= HEAD_WORD_BYTES) & (F.col("c") > 0)).withColumn("class", F.floor(F.log2("c") * 16))
    least, held = None, 0
    for r in short.groupBy("class").agg(F.count("*").alias("n")).orderBy(F.col("class").desc()).collect():  # at most 16 * 63 rows
        held += r.n
        if held > HEAD_WORDS:
            break
        least = r["class"]
    return short.where(F.lit(False) if least is None else F.col("class") >= least)


def score_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held: int = 2) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    remainder = id_remainder(F.col("id"), modulus)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    in_training = F.coalesce(remainder != held, F.lit(False))
    counted = durable(_word_counts(rows.select("text", in_training.alias("train"))), "wordcounts")
    ends = rows.where(in_training).count()
    stats = counted.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    # the end counts as a token and, once seen, as a distinct one
    n_train, distinct = (stats[0] or 0) + ends, (stats[1] or 0) + (ends > 0)
    pieces, words = learn_pieces(counted, ends, model_path)
    drop_durable(counted)
    head = {r.word.encode("utf-8", "surrogatepass"): (math.log10(r.c + 1), r.log_p / LN10) for r in _frequent(words).collect()}
    told = spark.sparkContext.broadcast((pieces.end_log_p / LN10, head))
    end_base = math.log10(ends + 1)

    def run(batches):
        end_score, head = told.value
        get = head.get
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = [[], [], [], []]
                tail_words, tail_n, offsets = [], [], [0]
                for text in part.column(1).to_pylist():
                    counted = Counter(words_of(text))
                    base, score, n_head, n_all = end_base, end_score, 0, 0
                    for word, n in counted.items():
                        n_all += n
                        known = get(word)
                        if known is None:
                            tail_words.append(word)
                            tail_n.append(n)
                        else:
                            base += n * known[0]
                            score += n * known[1]
                            n_head += n
                    offsets.append(len(tail_words))
                    for column, x in zip(out, (n_all + 1, n_head, base, score), strict=True):
                        column.append(x)
                tail = pa.StructArray.from_arrays([pa.array(tail_words, pa.binary()).cast(pa.string()), pa.array(tail_n, pa.int64())], names=["word", "n"])
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
                arrays = [part.column(0), *(pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tail)]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_tokens", "n_head", "base", "score", "tail"])

    id_type = dict(rows.dtypes)["id"]
    made = durable(rows.mapInArrow(run, f"id {id_type}, n_tokens long, n_head long, base double, score double, tail array<struct<word:string,n:long>>").withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = made.select("row", F.inline("tail"))
    n_known, base, score = F.sum(F.when(F.col("c") > 0, F.col("n"))), F.sum(F.col("n") * F.log10(F.col("c") + 1)), F.sum(F.col("n") * F.col("log_p") / LN10)
    met = rest.join(words, "word").groupBy("row").agg(n_known.alias("n_tail"), base.alias("base_tail"), score.alias("score_tail"))
    held_out = F.coalesce(remainder == held, F.lit(False))
    # log10((c + 1) / (N + 1 * (V + 1))) is summed as log10(c + 1), less one denominator a token
    denominator = math.log10(n_train + 1 * (distinct + 1))
    full = made.drop("tail").join(met, "row", "left")
    return full.select(
        F.col("id").alias(id_col), held_out.alias("held_out"), "n_tokens",
        (F.col("n_head") + F.coalesce("n_tail", F.lit(0)) + F.lit(1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_tail", F.lit(0.0)) - F.col("n_tokens") * denominator).alias("base_score"),
        (F.col("score") + F.coalesce("score_tail", F.lit(0.0))).alias("score"),
    )

"""Language identification with language-bitmask n-gram filters.

For each learned language its character n-grams go into a Bloom filter. The
filters are bit-sliced: one table of slots, in which bit l of a slot belongs to
language l, so ANDing the slots of an n-gram yields every language whose filter
holds it. A text's n-grams are counted per language, the counts are corrected for
the filter's false positives, and the language with the largest share wins.

A language contains an n-gram if that makes up at least MIN_RATE of its n-grams,
whatever the other languages do. Where one occurrence is enough, foreign words in
ever more text fill all filters alike. Rates of a language sum to 1, so a filter
holds at most 1 / MIN_RATE n-grams however large the corpus: the broadcast table
has a fixed bound.

N-grams are worked out for all words of a batch at once, on arrays of code points;
an n-gram is its 64-bit hash.

Edge cases: a null text, or one without letters, is ``und`` with score 0, as is
any text if nothing could be learned; a text with letters but without a known
n-gram gets the most frequent learned language and score 0; equal shares go to
the language that sorts first; texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, with_text_columns, worker_memo

SIZES = (2, 3, 4)
MIN_RATE = 2e-5
SLOTS_LOG2, HASHES = 20, 4
UNDETERMINED = "und"
#: Distinct words that a worker remembers before it starts afresh.
CACHE_WORDS, CACHE_WORD_CHARS = 250_000, 60
#: Distinct words whose n-grams are worked out together.
BATCH_WORDS = 50_000

_LETTER = regex.compile(r"\p{L}")
_M1, _M2, _GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _letters(owner: str) -> np.ndarray:
    """For each code point whether it is a letter or a mark."""
    return worker_memo(owner, "letters", lambda: np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)]))


def grams(words: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the word) of all n-grams of the lower-cased letter runs of the words, each run between blanks.

    No word holds white space, so joined by blanks they are one array of code points.
    """
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    points = np.frombuffer((" " + " ".join([w.lower() for w in words]) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.cumsum(points == 32) - 1
    is_letter = letters[points]
    code = np.where(is_letter, points, 0).astype(np.uint64)
    hashes, numbers = [], []
    h = _mix(code + np.uint64(1))
    inside = np.ones(len(code), bool)  # of windows from here: all between the ends are letters
    for n in range(2, max(SIZES) + 1):
        last = code[n - 1 :]
        h = _mix(h[: len(last)] * _GOLDEN + last + np.uint64(1))
        inside = inside[: len(last)] if n == 2 else inside[: len(last)] & is_letter[n - 2 : n - 2 + len(last)]
        if n in SIZES:
            at = np.flatnonzero(inside & (is_letter[: len(last)] | is_letter[n - 1 :]) if n == 2 else inside)
            hashes.append(h[at])
            numbers.append(word[np.where(is_letter[at], at, at + 1)])
    return np.concatenate(hashes), np.concatenate(numbers)


def slots_of(hashes: np.ndarray) -> list[np.ndarray]:
    a, b = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return [((a + np.uint64(i) * b) & np.uint64((1 << SLOTS_LOG2) - 1)).astype(np.intp) for i in range(HASHES)]


@dataclass
class Filters:
    """langs: sorted names; table: uint8, slots by ceil(len(langs) / 8); false_positive: by language."""

    langs: list[str]
    most_frequent: str
    table: np.ndarray
    false_positive: np.ndarray

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """For each n-gram and language whether its filter holds it."""
        first, *others = (self.table[at] for at in slots_of(hashes))
        for more in others:
            first &= more
        return np.unpackbits(first, axis=1, bitorder="little")[:, : len(self.langs)]

    def decide(self, total: int, hits: np.ndarray) -> tuple[str, float]:
        share = np.clip((hits / total - self.false_positive) / (1 - self.false_positive), 0, 1) if total else np.zeros(len(self.langs))
        if not share.any():
            return self.most_frequent, 0.0
        best = int(share.argmax())
        return self.langs[best], float(share[best] / share.sum() * min(1.0, share[best] + 0.5))


def _counts(train: DataFrame) -> DataFrame:
    """(lang, gram, c) over whole texts; gram: the hash."""

    def run(batches):
        letters = _letters("langmask.learn")
        waiting: dict[str, Counter] = defaultdict(Counter)

        def flush():
            for lang, words in waiting.items():
                names, seen = list(words), np.fromiter(words.values(), np.float64, len(words))
                parts = [grams(names[at : at + BATCH_WORDS], letters) for at in range(0, len(names), BATCH_WORDS)]
                weights = [seen[at * BATCH_WORDS : (at + 1) * BATCH_WORDS][number] for at, (_, number) in enumerate(parts)]
                found, where = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
                c = np.bincount(where, np.concatenate(weights), len(found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(c)], names=["lang", "gram", "c"])
            waiting.clear()

        held = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = waiting[lang]
                held -= len(words)
                words.update(text.split())
                held += len(words)
                if held > CACHE_WORDS:
                    yield from flush()
                    held = 0
        yield from flush()

    return train.mapInArrow(run, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def learn(train: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Filters:
    """Filters from the rows whose text and language are not null; all of them count."""
    rows = train.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = durable(_counts(rows), "gramcounts")
    totals = durable(counts.groupBy("lang").agg(F.sum("c").alias("n")), "totals")
    by_lang = {r.lang: r.n for r in totals.collect()}  # one row a language
    langs = sorted(by_lang)
    table = np.zeros((1 << SLOTS_LOG2, max(1, -(-len(langs) // 8))), np.uint8)
    place = {lang: k for k, lang in enumerate(langs)}
    contained = counts.join(F.broadcast(totals), "lang").where(F.col("c") >= MIN_RATE * F.col("n")).select("lang", "gram")
    for lang, hashes in contained.groupBy("lang").agg(F.collect_list("gram")).collect():  # at most 1 / MIN_RATE n-grams a language
        k = place[lang]
        for at in slots_of(np.array(hashes, np.int64).view(np.uint64)):
            table[at, k >> 3] |= np.uint8(1 << (k & 7))
    fill = np.unpackbits(table, axis=1, bitorder="little")[:, : len(langs)].mean(axis=0) if langs else np.zeros(0)
    most = max(langs, key=lambda x: by_lang[x]) if langs else UNDETERMINED
    return Filters(langs, most, table, fill**HASHES)


class _Words:
    """Counts by word, for words that have come before: its n-grams, and those that each filter holds."""

    def __init__(self, filters: Filters):
        self.f = filters
        self.place: dict[str, int] = {}
        self.counts = np.zeros((CACHE_WORDS, 1 + len(filters.langs)), np.int32)

    def _of(self, words: list[str], letters: np.ndarray) -> np.ndarray:
        out = np.zeros((len(words), 1 + len(self.f.langs)), np.int32)
        for at in range(0, len(words), BATCH_WORDS):
            some = words[at : at + BATCH_WORDS]
            hashes, number = grams(some, letters)
            out[at : at + len(some), 0] = np.bincount(number, minlength=len(some))
            held = self.f.holds(hashes)
            for k in range(len(self.f.langs)):
                out[at : at + len(some), k + 1] = np.bincount(number[held[:, k] > 0], minlength=len(some))
        return out

    def __call__(self, texts: list[str], letters: np.ndarray) -> np.ndarray:
        """For each text the number of its n-grams, and of those that each filter holds."""
        cut = [t.split() for t in texts]
        missing = {w for ws in cut for w in ws} - self.place.keys()
        if len(self.place) + len(missing) > CACHE_WORDS:
            self.place.clear()
            missing = {w for ws in cut for w in ws}
        new, at = list(missing), len(self.place)
        if at + len(new) > len(self.counts):  # one batch of texts has more distinct words than the cache
            self.counts = np.zeros((at + len(new), self.counts.shape[1]), np.int32)
        self.counts[at : at + len(new)] = self._of(new, letters)
        self.place.update(zip(new, range(at, at + len(new)), strict=True))
        get, counts = self.place.__getitem__, self.counts
        out = np.array([counts[np.fromiter(map(get, ws), np.intp, len(ws))].sum(axis=0, dtype=np.int64) for ws in cut]).reshape(len(cut), -1)
        if sum(map(len, new)) > CACHE_WORD_CHARS * max(1000, len(new)):  # very long words must not fill the memory
            self.place.clear()
        return out


def predict(docs: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    held = docs.sparkSession.sparkContext.broadcast(filters)
    key = uuid.uuid4().hex

    def make():
        owner = "langmask.predict " + key
        words, letters = worker_memo(owner, "words", lambda: _Words(held.value)), _letters(owner)
        f = words.f

        def of(texts):
            known = words([t or "" for t in texts], letters) if f.langs else None
            told = []
            for k, t in enumerate(texts):
                certain = f.langs and t and _LETTER.search(t)
                told.append(f.decide(int(known[k, 0]), known[k, 1:]) if certain else (UNDETERMINED, 0.0))
            return [t[0] for t in told], [t[1] for t in told]

        return of

    return with_text_columns(docs, text_col, [("lang_pred", "string", pa.string()), ("score", "double", pa.float64())], make)

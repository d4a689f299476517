"""Quality by nearest-neighbour voting in a latent-semantic space.

Texts become hashed counts of word shapes (runs of upper, lower, digits and signs),
of words and of immediate repetitions, weighted by the inverse document frequency
over all documents, and projected on the leading singular directions of a sample
of labelled texts. The sample's vectors are broadcast; every document's cosine
with each of them is computed exactly, in blocks, and the labels of the nearest
vote with the similarity as weight.

MAX_LABELLED bounds the labelled rows that are used (those with the smallest
crc32 of the id, so a fixed choice); everything else covers all rows.

Edge cases: null, empty and blank texts, and all texts if no label could be
learned from, get the labelled rows' share of label 1 (0.5 without any); ids that
repeat in the labels count with their smallest label and least text; repeated
documents each give a row; texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_text_columns, worker_memo

DIMENSIONS, LATENT = 4096, 48
MAX_LABELLED, NEIGHBOURS = 4096, 15
THRESHOLD = 0.7
#: Weight of a word's own count beside its shape's.
WORD_WEIGHT = 0.25
REPEAT, FRESH, RESERVED = 0, 1, 2
CACHE_WORDS, CACHE_WORD_CHARS = 400_000, 60
POWER_ITERATIONS, SEED = 4, 7



def _plain_shape(body: str) -> str | None:
    """The shape of a run of letters; None for anything else."""
    if not body.isalpha():
        return None
    if body.islower():
        return "a"
    if body.isupper():
        return "A"
    return "Aa" if body[0].isupper() and body[1:].islower() else None


def shape(word: str) -> str:
    """Aa, a, A, 0 for runs of letters and digits; other characters stand, repeats cut to three."""
    body = word.rstrip(".,;:!?*%&$#)\"'")
    plain, tail = _plain_shape(body), word[len(body) :]
    if plain and len(tail) <= 3:
        return plain + tail
    out = regex.sub(r"\p{Lu}(?=\p{Ll})", "\x01", word)
    out = regex.sub(r"\p{Lu}+", "A", out)
    out = regex.sub(r"[\p{Ll}\p{Lo}\p{Lm}\p{Lt}\p{M}]+", "a", out)
    out = regex.sub(r"\p{N}+", "0", out.replace("\x01", "A"))
    return regex.sub(r"(.)\1{3,}", r"\1\1\1", out)[:16]


def _slot(kind: str, text: str) -> int:
    return RESERVED + zlib.crc32((kind + text).encode("utf-8", "surrogatepass")) % (DIMENSIONS - RESERVED)


class Counter:
    """Texts to rows of DIMENSIONS weighted counts."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.shapes, self.words = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        cut = [t.split() if t else [] for t in texts]
        missing = {w for ws in cut for w in ws} - self.place.keys()
        if len(self.place) + len(missing) > CACHE_WORDS:
            self.__init__()
            missing = {w for ws in cut for w in ws}
        if missing:
            order, at = list(missing), len(self.shapes)
            self.shapes = np.concatenate([self.shapes, np.array([_slot("s", shape(w)) for w in order], np.int32)])
            self.words = np.concatenate([self.words, np.array([_slot("w", w.lower().strip(".,;:!?()\"'")) for w in order], np.int32)])
            self.place.update(zip(order, range(at, at + len(order)), strict=True))
        out = np.zeros((len(texts), DIMENSIONS), np.float32)
        get = self.place.__getitem__
        for k, ws in enumerate(cut):
            if ws:
                ids = np.fromiter(map(get, ws), np.intp, len(ws))
                out[k] = np.bincount(self.shapes[ids], minlength=DIMENSIONS) + WORD_WEIGHT * np.bincount(self.words[ids], minlength=DIMENSIONS)
                same = int((ids[1:] == ids[:-1]).sum())
                out[k, REPEAT], out[k, FRESH] = same, len(ws) - same
        for w in [w for w in missing if len(w) > CACHE_WORD_CHARS]:
            del self.place[w]
        return out


def _counts() -> Counter:
    return worker_memo("knnquality", "counter", Counter)


@dataclass
class Model:
    idf: np.ndarray
    directions: np.ndarray  # DIMENSIONS by latent
    vectors: np.ndarray  # labelled rows by latent, of length 1
    labels: np.ndarray
    prior: float

    def latent(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        z = x @ self.directions
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        out = np.full(len(counts), self.prior)
        if not len(self.labels):
            return out
        near = self.latent(counts) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.clip(np.take_along_axis(near, best, axis=1), 0, None).astype(np.float64)
        total = weight.sum(axis=1)
        has = (total > 1e-9) & (counts.sum(axis=1) > 0)
        out[has] = (weight * self.labels[best]).sum(axis=1)[has] / total[has]
        return np.clip(out, 0.0, 1.0)


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many documents each dimension occurs, and how many there are; sums over all rows."""

    def run(batches):
        df, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                texts = batch.slice(at, 500).column(0).to_pylist()
                df += (_counts()(texts) > 0).sum(axis=0)
                n += len(texts)
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*used.tolist(), -1], pa.int64()), pa.array([*df[used].tolist(), n], pa.int64())], names=["slot", "c"])

    df, n = np.zeros(DIMENSIONS, np.int64), 0
    for r in docs.select(F.col(text_col).cast("string").alias("text_")).mapInArrow(run, "slot long, c long").groupBy("slot").agg(F.sum("c").alias("c")).collect():
        if r.slot < 0:
            n = r.c
        else:
            df[r.slot] = r.c
    return df, n


def _sample(labelled: DataFrame, text_col: str, label_col: str) -> tuple[np.ndarray, np.ndarray]:
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                x = _counts()(part.column(0).to_pylist())
                slots = [np.flatnonzero(row) for row in x]
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), pa.array(slots, pa.list_(pa.int64())), pa.array([row[s] for row, s in zip(x, slots, strict=True)], pa.list_(pa.float32()))],
                    names=["label", "slots", "counts"],
                )

    rows = labelled.select(F.col(text_col).cast("string").alias("text_"), F.col(label_col).cast("double").alias("label")).mapInArrow(run, "label double, slots array<long>, counts array<float>").collect()
    x = np.zeros((len(rows), DIMENSIONS), np.float32)
    for k, r in enumerate(rows):
        x[k, r.slots] = r.counts
    order = np.lexsort([x @ np.sin(np.arange(DIMENSIONS, dtype=np.float32)), [r.label for r in rows]]) if rows else []
    return x[order], np.array([r.label for r in rows])[order] if rows else np.zeros(0)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """docs: all documents (for frequencies); labels: id and 0/1 label of the rows to learn from."""
    df, n = document_frequencies(docs, text_col)
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("label_"))
    ids = one.orderBy(F.crc32(F.col(id_col).cast("string").cast("binary")), id_col).limit(MAX_LABELLED)
    # one text for each label, the least, so that repeated ids send no more than that to the driver
    named = docs.select(F.col(id_col).alias("id_"), F.col(text_col).cast("string").alias("text_")).join(F.broadcast(ids.select(F.col(id_col).alias("id_"), "label_")), "id_")
    x, y = _sample(named.groupBy("id_", "label_").agg(F.min("text_").alias("text_")), "text_", "label_")
    idf = (np.log((1 + n) / (1 + df)) + 0.05).astype(np.float32)
    model = Model(idf, np.eye(DIMENSIONS, min(LATENT, DIMENSIONS), dtype=np.float32), np.zeros((0, LATENT), np.float32), y, float(y.mean()) if len(y) else 0.5)
    if len(y):
        w = np.log1p(x) * idf
        w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12)
        q = np.random.default_rng(SEED).standard_normal((DIMENSIONS, LATENT + 16)).astype(np.float32)
        for _ in range(POWER_ITERATIONS):
            q, _ = np.linalg.qr(w.T @ (w @ q))
        _, _, v = np.linalg.svd(w @ q, full_matrices=False)
        model.directions = np.ascontiguousarray((q @ v.T)[:, :LATENT], dtype=np.float32)
        model.vectors = model.latent(x).astype(np.float32)
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with score and predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def of(texts):
            score = held.value.score(_counts()(texts))
            return score, (score >= THRESHOLD).astype(np.int32)

        return of

    return with_text_columns(docs, text_col, [("score", "double", pa.float64()), ("predicted", "int", pa.int32())], make)

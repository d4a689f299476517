"""Harmonic packing: token sequences filled by reciprocal-capacity classes.

A document's ids are cut into pieces: whole sequences first, then for the rest a
piece whose length lies just below capacity / c for some c. All pieces of class c
(length at most capacity // c) go into sequences of exactly c pieces, which each
worker fills on its own without looking at lengths again. What a worker cannot
fill (fewer than c pieces of each class) is filled by groups of workers, then
groups of groups; the last remainder, whose size is bounded by the classes, is
placed best-fit by decreasing length.

Edge cases: a null or empty text holds only the end id; null ids keep their rows;
repeated rows are packed each; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import bisect
import json
import re
import sys
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ChunkCache
from .common import durable, worker_memo

CAPACITY = 1024
#: Classes that a cut may aim at; shorter pieces take a power of two per sequence.
MAX_CLASS = 64
#: A cut is made if it saves more than so many padded tokens and leaves no shorter piece than this.
MIN_SAVED, MIN_PIECE = 8, 8
#: Workers whose remainders are filled together at each level.
FAN_IN = 16


def class_of(length: int, capacity: int = CAPACITY) -> int:
    """Pieces of this length that are put into one sequence."""
    c = max(1, capacity // max(1, length))
    return c if c <= MAX_CLASS else 1 << (c.bit_length() - 1)


@lru_cache(maxsize=None)
def cut_rest(length: int, capacity: int = CAPACITY) -> tuple[int, ...]:
    """Lengths of the pieces of a rest of under one sequence."""
    out = []
    while length:
        c = class_of(length, capacity)
        head = capacity // (c + 1)
        if c < MAX_CLASS and capacity // c - length > MIN_SAVED and length - head >= MIN_PIECE:
            out.append(head)
            length -= head
        else:
            out.append(length)
            length = 0
    return tuple(out)


def cut(length: int, capacity: int = CAPACITY) -> list[int]:
    return [capacity] * (length // capacity) + list(cut_rest(length % capacity, capacity))


class Filler:
    """Fills sequences of each class in the order in which pieces come."""

    def __init__(self, first_id: int):
        self.next_id = first_id
        self.open: dict[int, list] = {}

    def add(self, length: int, piece, capacity: int):
        """Yields (piece, sequence_id, offset) for each sequence that this piece completes."""
        c = class_of(length, capacity)
        waiting = self.open.setdefault(c, [])
        waiting.append((length, piece))
        if len(waiting) == c:
            at = 0
            for n, p in waiting:
                yield p, self.next_id, at
                at += n
            self.next_id += 1
            waiting.clear()

    def rest(self):
        return [p for waiting in self.open.values() for p in waiting]


def best_fit(pieces: list[tuple[int, object]], capacity: int, first_id: int):
    """(piece, sequence_id, offset), each into the fullest sequence with room, longest first."""
    room: list[tuple[int, int]] = []  # (free, sequence), sorted
    used = 0
    for length, piece in sorted(pieces, key=lambda x: (-x[0], x[1])):
        k = bisect.bisect_left(room, (length, -1))
        if k < len(room):
            free, seq = room.pop(k)
        else:
            free, seq = capacity, used
            used += 1
        yield piece, first_id + seq, capacity - free
        bisect.insort(room, (free - length, seq))


# Fixed value: how a byte-level pre-tokenizer cuts a text.
BYTE_LEVEL_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these characters only, whose classes every version of Unicode agrees on, are encoded by ranks.
PLAIN = re.compile("[\t\n\r -~\u00a1-\u024f]*")


def _by_ranks(tok):
    """The tokenizer as ranks of byte strings, which gives the same ids several times as fast; None if it is no plain byte-level BPE."""
    import tiktoken
    from tokenizers import models, pre_tokenizers

    if tok.normalizer is not None or type(tok.model) is not models.BPE or type(tok.pre_tokenizer) is not pre_tokenizers.ByteLevel:
        return None
    told = json.loads(tok.to_str())
    model, cut = told["model"], told["pre_tokenizer"]
    if cut["add_prefix_space"] or not cut.get("use_regex", True) or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix")):
        return None
    pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
    ids = [model["vocab"].get(a + b, -1) for a, b in pairs]
    if min(ids, default=0) < 0 or any(x >= y for x, y in zip(ids, ids[1:])):
        return None  # ranks are ids only if later merges have larger ones
    # printable bytes spell themselves, the others the letters from U+0100 on
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte_of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))}
    made = {a + b for a, b in pairs}
    ranks = {bytes(byte_of[c] for c in name): i for name, i in model["vocab"].items() if name in made or (len(name) == 1 and name in byte_of)}
    return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _encoder(path: str):
    """(texts to their ids as little-endian unsigned 32-bit integers; None to none), for one worker."""

    def make():
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        pack = lambda ids: np.asarray(ids, dtype="<u4").tobytes()
        if sys.byteorder == "little" and array("I").itemsize == 4:
            pack = lambda ids: array("I", ids).tobytes()
        one = lambda text: pack(tok.encode(text, add_special_tokens=False).ids)
        cache = ChunkCache(lambda chunks: [pack(x.ids) for x in tok.encode_batch_fast(chunks, add_special_tokens=False)], b"".join)
        special = [t.content for t in tok.get_added_tokens_decoder().values()]
        by_ranks = _by_ranks(tok)

        def encode(texts: list[str | None]) -> list[bytes]:
            out, others = [b""] * len(texts), []
            for k, text in enumerate(texts):
                if not text:
                    continue
                if any(x in text for x in special):
                    out[k] = one(text)
                elif by_ranks and PLAIN.fullmatch(text):
                    out[k] = pack(by_ranks(text))
                else:
                    others.append(k)
            for k, value in zip(others, cache([texts[k] for k in others]), strict=True):
                out[k] = value
            return out

        return encode

    return worker_memo("harmonic", path, make)


_PIECE = "`start` long, `length` long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"
_NAMES = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    (and ids array<int> with keep_ids).

    Sequence ids are unique, not consecutive: the level and the worker that filled
    a sequence are its high bits.
    """
    spark = docs.sparkSession
    id_type = dict(docs.dtypes)[id_col]
    small = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text_"))
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def first(batches):
        encode = _encoder(tokenizer_path)
        worker = TaskContext.get().partitionId()
        filler, kind = Filler(worker << 32), None
        names = [id_col, *_NAMES, "worker", *(["ids"] if keep_ids else [])]

        def batch_of(rows, ids, payload):
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(ids, type=kind), *(pa.array(c, type=pa.int64()) for c in cols)]
            if keep_ids:
                arrays.append(pa.array([np.frombuffer(p, "<u4").astype("i4") for p in payload], type=pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            kind = batch.column(0).type
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                coded = encode(part.column(1).to_pylist())
                rows, ids, payload = [], [], []
                for doc, body in zip(part.column(0).to_pylist(), coded, strict=True):
                    body += end
                    total, start = len(body) // 4, 0
                    for n in cut(total, capacity):
                        own = body[4 * start : 4 * (start + n)]
                        piece = (doc, start, n, zlib.crc32(own), total, own if keep_ids else b"")
                        start += n
                        for (d, s, m, crc, tot, data), seq, off in filler.add(n, piece, capacity):
                            ids.append(d)
                            rows.append((s, m, crc, tot, seq, off, worker))
                            payload.append(data)
                if rows:
                    yield batch_of(rows, ids, payload)
        if left := [p for _, p in filler.rest()]:
            yield batch_of([(s, m, crc, tot, None, None, worker) for _, s, m, crc, tot, _ in left], [p[0] for p in left], [p[5] for p in left])

    ids_col = ", ids array<int>" if keep_ids else ""
    made = durable(small.mapInArrow(first, f"`{id_col}` {id_type}, {_PIECE}, worker long{ids_col}"), "packed")
    workers = (made.agg(F.max("worker")).first()[0] or 0) + 1
    columns = [id_col, *_NAMES, *(["ids"] if keep_ids else [])]
    done = [made.where("sequence_id is not null").select(columns)]
    left, level = made.where("sequence_id is null"), 1
    while True:
        last = workers <= FAN_IN
        left = left.withColumn("worker", F.floor(F.col("worker") / FAN_IN))
        filled = durable(_fill(left, id_col, capacity, level, last, columns), "packed")
        done.append(filled.where("sequence_id is not null").select(columns))
        if last:
            break
        left, workers, level = filled.where("sequence_id is null"), -(-workers // FAN_IN), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _fill(left: DataFrame, id_col: str, capacity: int, level: int, last: bool, columns: list[str]) -> DataFrame:
    """Fill what FAN_IN workers left; last: place what then remains as well.

    A group holds under FAN_IN * (sum of class sizes) rows, whatever the input.
    """

    def fill(table: pa.Table) -> pa.Table:
        # ids stay in Arrow: through floating point, long ids beside a null one would be rounded
        table = table.sort_by([(c, "ascending") for c in ("length", id_col, "start", "ids_crc32")])
        lengths = table.column("length").to_pylist()
        filler = Filler((level << 56) | (table.column("worker")[0].as_py() << 32))
        seq, off = [None] * len(lengths), [None] * len(lengths)
        for k, n in enumerate(lengths):
            for p, s, o in filler.add(n, k, capacity):
                seq[p], off[p] = s, o
        if last:
            for p, s, o in best_fit(filler.rest(), capacity, filler.next_id):
                seq[p], off[p] = s, o
        for name, told in (("sequence_id", seq), ("offset", off)):
            table = table.set_column(table.schema.get_field_index(name), name, pa.array(told, pa.int64()))
        return table

    return left.groupBy("worker").applyInArrow(fill, left.schema)

"""Byte-level BPE through a sentencepiece model built from a rank file.

The model is serialised here, not trained: every byte string of the vocabulary
becomes one piece (each byte mapped to one letter), scored by its negative rank,
with identity normalisation. Sentencepiece merges the neighbours whose joined
piece scores highest, which is the lowest rank, so each pre-token gets the ids
that the rank file defines. Decoding goes back from the ids to the model's pieces
and from their letters to the bytes.

Edge cases: null and empty texts have no ids (decoded: empty); texts of any
length are encoded whole; repeated rows each give a row; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_memo

#: Letters that stand for the 256 bytes; none is a space or sentencepiece's own mark.
BYTE_CHARS = [chr(0x100 + b) for b in range(256)]
#: Distinct chunks in each of the two generations that a worker remembers.
CACHE_CHUNKS, CACHE_CHUNK_CHARS = 400_000, 100

_SPACE_RUN = re.compile(r"\s ")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model whose piece ids are the ranks.

    Fields are those of the public sentencepiece_model.proto. The unknown piece,
    which no text can reach since all 256 bytes are pieces, comes last.
    """
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    pieces = []
    for token, rank in by_rank:
        name = "".join(BYTE_CHARS[b] for b in token).encode()
        pieces.append(_block(1, _block(1, name) + b"\x15" + struct.pack("<f", -rank) + _number(3, 1)))
    unknown = _block(1, _block(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2))
    trainer = _number(3, 2) + _number(4, len(by_rank) + 1) + _number(40, len(by_rank))
    normalizer = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + unknown + _block(2, trainer) + _block(3, normalizer)


class ChunkCache:
    """Text to a joined value per chunk, encoding each distinct chunk once.

    A chunk is a stretch from one single space to the next. No match of a
    byte-level pattern holds a character other than white space followed by
    white space, so cutting before a space that follows such a character never
    cuts a match. Texts with white space before a space are cut by the pattern.

    encode_many: list of chunks to list of values; join: list of values to one.
    """

    def __init__(self, encode_many, join, limit: int = CACHE_CHUNKS):
        self.encode_many, self.join, self.limit = encode_many, join, limit
        self.known: dict[str, object] = {}
        self.older: dict[str, object] = {}

    def _chunks(self, text: str) -> list[str]:
        if _SPACE_RUN.search(text):
            return self.split_exactly(text)
        first, *rest = text.split(" ")
        out = [" " + x for x in rest]
        return [first, *out] if first else out

    @staticmethod
    def split_exactly(text: str) -> list[str]:
        """Cut only where a character that no rule takes as white space meets a space."""
        return [x for x in re.split(r"(?<=[^\s\x1c-\x1f\x85])(?= )", text) if x]

    def __call__(self, texts: list[str | None]) -> list:
        if len(self.known) > self.limit:
            self.older, self.known = self.known, {}
        known = self.known
        cut = [self._chunks(t) if t else [] for t in texts]
        found = [list(map(known.get, c)) for c in cut]
        lacking = [k for k, values in enumerate(found) if None in values]
        missing = {chunk for k in lacking for chunk, value in zip(cut[k], found[k], strict=True) if value is None}
        for chunk in missing & self.older.keys():
            known[chunk] = self.older[chunk]
        if new := list(missing - known.keys()):
            known.update(zip(new, self.encode_many(new), strict=True))
        for k in lacking:
            found[k] = list(map(known.get, cut[k]))
        for chunk in [c for c in missing if len(c) > CACHE_CHUNK_CHARS]:  # a few very long chunks must not fill the memory
            del known[chunk]
        return list(map(self.join, found))


def inverse_pieces(model) -> dict[str, bytes]:
    """Id, as text, to the bytes that its piece stands for, read from the serialised model."""
    byte_of = {c: b for b, c in enumerate(BYTE_CHARS)}
    return {str(i): bytes([byte_of[c] for c in model.id_to_piece(i)]) for i in range(model.vocab_size()) if not model.is_unknown(i)}


def _encoder(ranks_path: str, pattern: str):
    def make():
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(read_ranks(ranks_path)))
        find = regex.compile(pattern).findall
        chars = BYTE_CHARS

        def encode_many(chunks: list[str]) -> list[str]:
            matches = [find(c) for c in chunks]
            distinct = list({m for ms in matches for m in ms})
            ids = model.encode(["".join([chars[b] for b in m.encode("utf-8", "surrogatepass")]) for m in distinct], num_threads=1) if distinct else []
            said = {m: " ".join(map(str, x)) for m, x in zip(distinct, ids, strict=True)}
            return [" ".join([said[m] for m in ms]) for ms in matches]

        return ChunkCache(encode_many, " ".join), inverse_pieces(model)

    return worker_memo("bpe", f"{ranks_path} {pattern}", make)


OUT = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """One row per document: its id, n_tokens, ids_sha256, decoded_sha256 and, with
    keep_ids, ids (the ids as array<int>) and decoded (the bytes)."""
    small = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text_"))
    schema = pa.schema(list(OUT) + ([("ids", pa.list_(pa.int32())), ("decoded", pa.binary())] if keep_ids else []))

    def run(batches):
        cache, table = _encoder(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for said in cache(part.column(1).to_pylist()):
                    ids = said.split(" ") if said else []
                    back = b"".join(map(table.__getitem__, ids))
                    row = [len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(back).hexdigest()]
                    rows.append(row + ([list(map(int, ids)), back] if keep_ids else []))
                columns = [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=[id_col, *schema.names])

    out = f"`{id_col}` {dict(small.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return small.mapInArrow(run, out + (", ids array<int>, decoded binary" if keep_ids else ""))

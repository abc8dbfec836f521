"""Byte-level BPE through sentencepiece: the model is written straight from a rank file, nothing is trained.

Each token's bytes become printable characters, one a byte; a piece's score is its negative rank, so the merge of
least rank always goes first. Normalisation is the identity. Texts are split by a pattern first, and each
pre-token is encoded on its own; equal pre-tokens of a task are encoded once. Decoding maps ids back to pieces and
characters back to bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dugout.llm.common import slices

#: Distinct pre-tokens that a task remembers at once.
_REMEMBERED = 200_000


def byte_characters() -> list[str]:
    """A printable character for every byte: itself where it is one, else the next above 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + others.index(b)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank. The file (base64 and rank on each line) has the driver's vocabulary: a bounded size."""
    with open(path, "rb") as f:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, filter(bytes.strip, f))}
    if sorted(found) != list(range(len(found))):
        raise ValueError(f"{path}: ranks have gaps")
    return [found[i] for i in range(len(found))]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def model_of(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose ids are the ranks; the piece for the unknown comes last."""
    letters = byte_characters()
    pieces = []
    for rank, token in enumerate(tokens):
        piece = "".join(letters[b] for b in token).encode()
        pieces.append(_bytes(1, _bytes(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -rank) + _number(3, 1)))
    pieces.append(_bytes(1, _bytes(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0) + _number(3, 2)))
    trainer = _number(3, 2) + _number(4, len(tokens) + 1) + _number(40, len(tokens)) + _number(41, -1) + _number(42, -1) + _number(43, -1)
    normalizer = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _bytes(2, trainer) + _bytes(3, normalizer)


class _Known(dict):
    """Ids of the pre-tokens met so far, each encoded when it is first asked for."""

    def __init__(self, model: bytes, tokens: list[bytes]):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.letters = dict(enumerate(byte_characters()))
        # A pre-token that is a token is that token, whether merges lead to it or not.
        self.whole = {t: struct.pack("<I", i) for i, t in enumerate(tokens)}

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        ids = self.whole.get(raw)
        if ids is None:
            found = self.pieces.encode(raw.decode("latin-1").translate(self.letters))
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(self) >= _REMEMBERED:
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit integers."""

    def __init__(self, model: bytes, tokens: list[bytes], pattern: str):
        import regex

        self.split = regex.compile(pattern).findall
        self.known = _Known(model, tokens)

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.split(text)))


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", column: str = "ids") -> DataFrame:
    """``docs`` with the text's ids in binary ``column`` (replaced if there): little-endian unsigned 32-bit integers.

    Texts are encoded whole, without special tokens; a null text counts as empty and an empty one has no ids. Rows
    are independent, so repeated rows and empty tables are plain cases.
    """
    names = [c for c in docs.columns if c != column]
    tokens = read_ranks(ranks)
    model = model_of(tokens)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model, tokens, pattern)
        for batch in slices(batches, text):
            ids = pa.array([encoder(t or "") for t in batch.column(text).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*names, column])

    docs = docs.select(*names)
    return docs.mapInArrow(encoded, docs.withColumn(column, F.lit(b"")).schema)


def decode(rows: DataFrame, ranks: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """``rows`` with the bytes of ``ids`` in binary ``column``; null ids give empty bytes. An id outside the vocabulary fails."""
    names = [c for c in rows.columns if c != column]
    letters = byte_characters()
    back = {c: b for b, c in enumerate(letters)}
    model = model_of(read_ranks(ranks))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        table = [bytes(back[c] for c in pieces.id_to_piece(i)) for i in range(pieces.vocab_size() - 1)]
        for batch in batches:
            out = [b"".join([table[i] for i in memoryview(x or b"").cast("I")]) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*names, column])

    rows = rows.select(*names)
    return rows.mapInArrow(decoded, rows.withColumn(column, F.lit(b"")).schema)

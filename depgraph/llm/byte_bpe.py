"""Operator 10, byte-level BPE encoding and decoding by a sentencepiece model made from a vocabulary of ranks.

The vocabulary's byte strings become pieces of one printable character a byte, scored by their negative rank, in a
sentencepiece BPE model that is serialised here, with an identity normaliser. Pre-tokens, mapped in the same way,
are encoded by it, and the piece ids are the ranks. Decoding maps ids back to byte strings.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from depgraph.llm.common import by_bytes, give_back
from depgraph.llm.pieces import Pieces, encoded

#: Bytes of texts, or of the ids of texts, that a worker turns into an Arrow array at once.
SLICE = 2 << 20

#: Byte b is shown as the character 0x100 + b: one letter each, none of them white space.
_SHOWN = {b: 0x100 + b for b in range(256)}


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a .tiktoken file, in order of rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    found = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [found[i] for i in range(len(found))]


def shown(token: bytes) -> str:
    return token.decode("latin-1").translate(_SHOWN)


def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: piece i is token i with score -i; the unknown piece comes last."""
    out = b"".join(_block(1, _block(1, shown(t).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -i)) for i, t in enumerate(tokens))
    out += _block(1, _block(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0) + _number(3, 2))
    none = 2**64 - 1  # -1: there is no such piece
    out += _block(2, _number(3, 2) + _number(4, len(tokens) + 1) + _number(40, len(tokens)) + b"".join(_number(f, none) for f in (41, 42, 43)))
    return out + _block(3, _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))


class ByteBpe:
    """Encodes pre-tokens by the serialised model. A pre-token that is a token itself is that token's id."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.tokens))
        self.split = regex.compile(pattern).findall
        #: Tokens that no chain of merges makes; as whole pre-tokens they stand all the same.
        names = [shown(t) for t in self.tokens]
        self.whole = {s: [i] for i, (s, ids) in enumerate(zip(names, self.model.encode(names, num_threads=1), strict=True)) if ids != [i]}
        self.pieces = Pieces(self._encode, limit=400_000)

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers."""
        cut = [self.split(p) for p in pieces]
        tokens = list(dict.fromkeys(t for c in cut for t in c))
        names = [shown(t.encode()) for t in tokens]
        ids = self.model.encode(names, num_threads=1) if names else []
        known = {t: array("I", self.whole.get(s, x)).tobytes() for t, s, x in zip(tokens, names, ids, strict=True)}
        return [b"".join([known[t] for t in c]) for c in cut]

    def encode(self, texts) -> Iterator[bytes]:
        for found in encoded(self.pieces, texts):
            yield b"".join(b"".join(x) for x in found)


@cache
def _coder(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


@cache
def _table(path: str) -> list[bytes]:
    return read_ranks(path)


def _id_lists(coder: ByteBpe, texts: pa.Array) -> pa.ListArray:
    found = list(coder.encode(x.as_py() for x in texts))
    ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))


def _byte_strings(table: list[bytes], lists: pa.ListArray) -> pa.Array:
    out = [None if n is None else [] for n in pa.compute.list_value_length(lists).to_pylist()]
    tokens = [table[i] for i in lists.flatten().to_pylist()]
    at = 0
    for i, n in enumerate(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_pylist()):
        if out[i] is not None:
            out[i] = b"".join(tokens[at : at + n])
        at += n
    return pa.array(out, pa.binary())


def _released(coder: ByteBpe) -> None:
    """At a task's end: the worker may serve other operators next, so it doesn't keep the pieces it has met."""
    coder.pieces.clear()
    give_back()


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    return (some.column(0) for some in by_bytes(pa.RecordBatch.from_arrays([texts], names=["text"]), 0, SLICE))


def encode(text, ranks: str, pattern: str):
    """Column array<int>: the ids of the whole text, each match of ``pattern`` encoded by itself, without special
    tokens. Null and empty texts give an empty array."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _coder(ranks, pattern)
        for texts in batches:
            for some in _slices(texts):
                yield _id_lists(coder, some)
        _released(coder)

    return ids(text)


def decode(ids, ranks: str):
    """Column binary: the byte strings of the ids, one after the other. Null gives null; an unknown id is an error."""

    @F.arrow_udf("binary")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = _table(ranks)
        for lists in batches:
            part = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0), np.int64)) // (SLICE // 4)
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lists)]
            for a, b in zip(cuts, cuts[1:]):
                yield _byte_strings(table, lists.slice(a, b - a))

    return text(ids)


def encode_decode(text, ranks: str, pattern: str):
    """Column struct<ids: array<int>, decoded: binary>: ``encode`` and then ``decode`` of its ids, in one worker."""

    @F.arrow_udf("struct<ids: array<int>, decoded: binary>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _coder(ranks, pattern)
        for texts in batches:
            for some in _slices(texts):
                ids = _id_lists(coder, some)
                yield pa.StructArray.from_arrays([ids, _byte_strings(coder.tokens, ids)], names=["ids", "decoded"])
        _released(coder)

    return both(text)

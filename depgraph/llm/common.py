"""What the operators share: the cluster's shared folder, written intermediate tables, words, hashes."""

from __future__ import annotations

import ctypes
import functools
import hashlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from depgraph.tables import discard, has_rows, recorded, shared_dir
from depgraph.tables import stored as written

__all__ = ["discard", "has_rows", "recorded", "shared_dir", "written"]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = 2_000, size: int | None = None) -> None:
    """Send texts to Python workers in Arrow batches of at most so many rows, unless the session asks for fewer.

    Spark's own 10,000 rows of long texts take much of a worker's memory, and each task holds several batches. ``size``: a batch
    ends with the row that reaches so many bytes, for tables of few large rows; executors build batches outside their heap.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    # with another unit it is the session's own
    if size and (found := spark.conf.get(key).lower().removesuffix("b")).isdigit() and not 0 < int(found) <= size:
        spark.conf.set(key, str(size))


def give_back() -> None:
    """At a task's end: free memory goes back to the system, as the worker process stays and may serve other operators."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that every bit depends on all input bits (uint64 in, uint64 out)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: Bytes that end a word where words are letters and digits; UTF-8 bytes above 0x7F belong to words.
NOT_ALNUM = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: The low bytes of a number that belong to a word of so many bytes.
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(8)], np.uint64)
_SHORT, _TOP = 7, np.uint64(1 << 63)


def by_bytes(batch: pa.RecordBatch, text: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts (column number ``text``) hold about ``most`` bytes; a longer text stands alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64)
    part = np.cumsum(sizes) // most
    at = 0
    for end in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]:
        if end > at:
            yield batch.slice(at, end - at)
        at = end


def new_key() -> bytes:
    """A secret for the hashes of one run of an operator: nobody can write texts whose hashes collide in it."""
    return os.urandom(16)


def _short_hashes(values: np.ndarray) -> np.ndarray:
    """A one-to-one mapping of the 63-bit numbers onto themselves."""
    low = ~_TOP
    h = values ^ (values >> np.uint64(30))
    h = (h * np.uint64(0x9E3779B97F4A7C15)) & low
    h = h ^ (h >> np.uint64(29))
    h = (h * np.uint64(0xD6E8FEB86659FD93)) & low
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of a run of texts (Arrow strings; null: none).

    counts: words of each text. starts, ends: bytes of each word in ``data``, where A-Z are lower-cased if asked for.
    hashes: 64 bits of each word. Words of up to 7 bytes are numbers mapped one to one, with the top bit clear, so they
    never collide; others have the top bit set and a cryptographic digest under ``key``, so they collide by chance only.
    """

    def __init__(self, texts: pa.Array, breaks: bytes = SPACE, lower: bool = False, key: bytes = b""):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        held = texts.buffers()[2] if len(texts) else None
        self.data = data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.empty(0, np.uint8)
        self.key, self.lower = key, lower
        offsets = offsets - offsets[0]
        inside = np.ones(256, bool)
        inside[list(breaks)] = False
        flags = np.zeros(len(data) + 2, bool)
        flags[1:-1] = word = inside[data]
        opens, closes = word & ~flags[:-2], word & ~flags[2:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        opens[edges] = word[edges]
        closes[edges - 1] = word[edges - 1]
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.counts = np.diff(np.searchsorted(self.starts, offsets))

    def each(self) -> Iterator[tuple[int, int]]:
        """First and end word of each text."""
        ends = np.cumsum(self.counts)
        return zip((ends - self.counts).tolist(), ends.tolist(), strict=True)

    @functools.cached_property
    def _cased(self) -> np.ndarray:
        return _LOWER[self.data] if self.lower else self.data

    def exact(self, which: np.ndarray | None = None) -> pa.DictionaryArray:
        """The very bytes of all words, or of those numbered ``which``, each distinct word once."""
        starts, ends = (self.starts, self.ends) if which is None else (self.starts[which], self.ends[which])
        bounds = np.empty(2 * len(starts), np.int64)
        bounds[::2], bounds[1::2] = starts, ends
        if not len(bounds):
            return pa.array([], pa.large_binary()).dictionary_encode()
        # words and what stands between them in turn
        every = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(self._cased))])
        return every.take(pa.array(np.arange(0, len(bounds) - 1, 2))).dictionary_encode()

    @functools.cached_property
    def hashes(self) -> np.ndarray:
        sizes = self.ends - self.starts
        out = np.empty(len(sizes), np.uint64)
        short = sizes <= _SHORT
        padded = np.concatenate((self._cased, np.zeros(8, np.uint8)))
        eights = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))
        out[short] = _short_hashes((eights[self.starts[short]] & _MASKS[sizes[short]]) | (sizes[short].astype(np.uint64) << np.uint64(56)))
        long = np.flatnonzero(~short)
        words = self.exact(long)
        digests = b"".join([hashlib.blake2b(w, digest_size=8, key=self.key).digest() for w in words.dictionary.to_pylist()])
        out[long] = np.frombuffer(digests, "<u8")[words.indices.to_numpy()] | _TOP
        return out


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of runs of words from the hashes of their two parts."""
    return mix(mix(a) + b)


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive words; empty if there are fewer. Runs of 1, 2, 4, ... words are put together."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, runs, size = None, 0, words, 1
    while done < k:
        if k & size:
            most = len(words) - done - size + 1
            out = runs if out is None else joined(out[:most], runs[done : done + most])
            done += size
        if done < k:
            runs, size = joined(runs[:-size], runs[size:]), 2 * size
    return mix(out[:n])


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as it takes to be no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out

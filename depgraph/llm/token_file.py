"""Operator 3, token-ID files: bit-plane shuffled, zstandard-compressed chunks with an index.

A token file is a folder of two Parquet tables, so Spark's committer makes its writes safe against lost executors
and any store that Spark writes to can hold it:

``chunks``  shard, chunk, first (ids before it in its shard), n_ids, doc_ids, doc_lengths, payload
``index``   all of that without the payload, and n_docs, payload_bytes: where each chunk stands

Shards follow one another in the order of the documents' ids, as do the chunks of a shard and the documents of a
chunk. A chunk holds whole documents. Its payload is a run of blocks of at most ``BLOCK`` ids:

``<4s I B B`` magic, ids, planes, kind (0: byte planes, 1: bit planes); ``<I`` times planes: sizes; the planes

Each block of unsigned 32-bit ids is transposed into 4 byte planes or 32 bit planes, and each plane is compressed
by itself, so that planes that hardly change cost nearly nothing.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depgraph.llm.common import small_batches
from depgraph.llm.pieces import Pieces, encoded

BLOCK = 1 << 15
CHUNK = 1 << 16
MAGIC = b"TPB1"
_HEAD = struct.Struct("<4sIBB")
CHUNK_SCHEMA = "shard int, chunk long, first long, n_ids long, doc_ids array<long>, doc_lengths array<long>, payload binary"


def pack_block(ids: np.ndarray, bits: bool = False) -> bytes:
    """One block of ids (uint32, at most BLOCK) as compressed planes."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        flags = np.unpackbits(raw, axis=1, bitorder="little")
        planes = [np.packbits(flags[:, i]).tobytes() for i in range(32)]
    else:
        planes = [raw[:, i].tobytes() for i in range(4)]
    squeeze = zstandard.ZstdCompressor(level=3)
    small = [squeeze.compress(p) for p in planes]
    return _HEAD.pack(MAGIC, len(ids), len(small), bits) + struct.pack(f"<{len(small)}I", *map(len, small)) + b"".join(small)


def unpack_blocks(payload: bytes) -> np.ndarray:
    """All ids of a chunk's payload (uint32)."""
    at, out = 0, []
    while at < len(payload):
        magic, n, planes, bits = _HEAD.unpack_from(payload, at)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        at += _HEAD.size
        sizes = struct.unpack_from(f"<{planes}I", payload, at)
        at += 4 * planes
        columns = []
        for size in sizes:
            plane = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload[at : at + size], max_output_size=n + 8), np.uint8)
            columns.append(np.unpackbits(plane, count=n) if bits else plane)
            at += size
        both = np.stack(columns, axis=1)
        out.append((np.packbits(both, axis=1, bitorder="little") if bits else np.ascontiguousarray(both)).view("<u4").ravel())
    return np.concatenate(out) if out else np.empty(0, "<u4")


_LETTER, _DIGIT, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
#: Letters, a digit, or marks: in texts of Latin-1 characters, what the tokenizer's own pattern finds but for contractions.
_LATIN = re.compile(f"[{_LETTER}]+|[{_DIGIT}]|[^{_SPACE}{_LETTER}{_DIGIT}]+")


class Ids(Pieces):
    """Ids of pieces, as little-endian unsigned 32-bit integers, for a tokenizer that lower-cases and drops white space.

    Texts of Latin-1 characters are cut into words and marks in lower case, so that few distinct ones are encoded;
    others, and those with an apostrophe or a special token, into what stands between spaces or line ends.
    """

    def __init__(self, model, limit: int = 1_200_000):
        super().__init__(self._ids, limit, any_space=True)
        self.model = model

    def _ids(self, pieces: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.model.encode_batch_fast(pieces, add_special_tokens=False)]

    def _cut(self, text: str) -> list:
        if "'" not in text and "<|" not in text and (text.isascii() or max(text) < "\u0100"):
            return _LATIN.findall(text.lower())
        return text.replace("\n", " ").split(" ")


@cache
def _ids(path: str) -> Pieces:
    """One for each worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    one = lambda x: model.encode(x, add_special_tokens=False).ids
    if one(" A\n B, 12'") == [i for x in "ab,12'" for i in one(x)]:
        return Ids(model)
    return Pieces(lambda xs: [array("I", x.ids).tobytes() for x in model.encode_batch_fast(xs, add_special_tokens=False)])


def write_token_file(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, doc_id: str = "doc_id", text: str = "text", bits: bool = False) -> None:
    """Encode every whole text and write the ids, in ascending order of doc_id, as a token file at ``path``.

    Null texts count as empty; a document without ids still is in the file. A null doc_id comes first. Rows with
    the same doc_id all stay, in the order of their texts' hashes. Other columns are left out. Texts are dealt out
    by ranges of doc_id, one shard a task, and each task streams: it holds one chunk, or one longer document.
    """
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, known, held, size, first, number = TaskContext.get().partitionId(), _ids(tokenizer), [], 0, 0, 0

        def close():
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            payload = b"".join(pack_block(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK))
            row = {"shard": [shard], "chunk": [number], "first": [first], "n_ids": [len(ids)], "doc_ids": [[d for d, _ in held]], "doc_lengths": [[len(x) // 4 for _, x in held]], "payload": [payload]}
            return pa.RecordBatch.from_pydict(row, schema)

        schema = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("payload", pa.binary())])
        for batch in batches:
            for d, found in zip(batch.column(0).to_pylist(), encoded(known, (x.as_py() for x in batch.column(1))), strict=True):
                one = b"".join(b"".join(x) for x in found) + end
                held.append((d, one))
                size += len(one) // 4
                if size >= CHUNK or len(held) >= CHUNK:
                    yield close()
                    held, first, number, size = [], first + size, number + 1, 0
        if held:
            yield close()

    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    dealt.mapInArrow(chunks, CHUNK_SCHEMA).write.parquet(f"{path}/chunks")
    written = spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks")
    index = written.withColumns({"n_docs": F.size("doc_ids"), "payload_bytes": F.octet_length("payload")}).drop("payload")
    index.write.parquet(f"{path}/index")


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit) of each document.

    Chunks are decoded each by itself. Only the number of ids of each shard, one a task of the writer, is gathered.
    """
    index = spark.read.parquet(f"{path}/index")
    totals = index.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    bases, before = [], 0
    for shard, n in totals:
        bases.append((shard, before))
        before += n
    base = F.broadcast(spark.createDataFrame(bases, "shard int, base long"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["doc_lengths"], np.int64)
                ids = unpack_blocks(row["payload"])
                if len(ids) != lengths.sum():
                    raise ValueError(f"chunk {row['chunk']} of shard {row['shard']} doesn't hold the ids that its index tells")
                ends = np.cumsum(lengths)
                raw, starts = ids.tobytes(), ends - lengths
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["at"]), pa.array(lengths), pa.array([raw[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks").join(base, "shard").withColumn("at", F.col("base") + F.col("first"))
    return chunks.select("shard", "chunk", "at", "doc_ids", "doc_lengths", "payload").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")

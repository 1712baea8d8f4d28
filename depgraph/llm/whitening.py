"""Operator 12, embedding whitening: covariance with multiplicities, over distinct vectors.

1. Each vector becomes integers x. Equal x are grouped once, with their count as the weight in the fit (or one).
2. Tasks sum up n, the weighted sums S of each dimension (exactly), and then the weighted products of the vectors less their
   mean, one matrix of dimensions by dimensions each, which are added up by rows. Only that matrix comes to the driver, whatever
   the number of vectors; its eigenvectors are the components.
3. Each distinct vector is whitened once and joined back to the rows that hold it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depgraph.llm.common import written

#: Rows multiplied at once, and shares of all rows from which on a vector is joined apart (so at most so many vectors are).
BLOCK, COMMON = 8_192, 1_000
#: x is floor(SCALE * c) + SHIFT; a number beyond RANGE, which has no such long, counts as not finite.
SCALE, SHIFT, RANGE = 1_024, 100_000, float(2**52)

WHITENED = "x array<long>, weight long, n long, deviation decimal(38, 0), whitened array<double>"
_WIDE = pa.decimal128(38, 0)


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, x of the rows whose vector is not null, holds neither null nor non-finite numbers, and has the commonest
    number of dimensions (of equally common ones the smallest)."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("c"))
    # abs(NaN) < RANGE is false only with isnan, as Spark takes NaN for the largest number
    rows = rows.where(f"c IS NOT NULL AND forall(c, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('{RANGE}'))")
    rows = rows.select("vec_id", F.expr(f"transform(c, v -> floor({SCALE} * v) + {SHIFT}L)").alias("x"))
    size = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("x") == (size["n"] if size else 0))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """x and weight (the first two columns) of at most BLOCK vectors at a time, and all columns."""
    for batch in batches:
        for i in range(0, len(batch), BLOCK):
            some = batch.slice(i, BLOCK)
            yield some.column(0).flatten().to_numpy().reshape(len(some), -1), some.column(1).to_numpy(), some


def _exact(a: np.ndarray, most: int) -> np.ndarray:
    """The integers as they are if nothing up to ``most`` exceeds 64 bits, or else without any bound."""
    return a if most < 2**62 else a.astype(object)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """dimension, n, s: of all vectors of a task."""
    n, s = 0, None
    for x, w, _ in _blocks(batches):
        most = int(np.abs(x).max(initial=0)) * int(w.sum())
        part = [int(v) for v in _exact(w, most) @ _exact(x, most)]
        n, s = n + int(w.sum()), part if s is None else [a + b for a, b in zip(s, part, strict=True)]
    if s is not None:
        yield pa.RecordBatch.from_pydict({"dimension": list(range(len(s))), "n": [n] * len(s), "s": s}, pa.schema([("dimension", pa.int32()), ("n", pa.int64()), ("s", _WIDE)]))


def weighted_sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """The sum of the weights and, of each dimension, that of weight times x (columns x, weight)."""
    parts = vectors.select("x", "weight").mapInArrow(_sums, "dimension int, n long, s decimal(38, 0)")
    rows = parts.groupBy("dimension").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("dimension").collect()
    return (int(rows[0]["n"]) if rows else 0), [int(r["s"]) for r in rows]


def _products(mean: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(mean), len(mean)))
        for x, w, _ in _blocks(batches):
            centred = x - mean
            total += (centred * w[:, None]).T @ centred
        yield pa.RecordBatch.from_pydict({"i": list(range(len(mean))), "row": list(total)}, pa.schema([("i", pa.int32()), ("row", pa.list_(pa.float64()))]))

    return run


def _added(table: pa.Table) -> pa.Table:
    total = np.add.reduce([np.asarray(r.values) for r in table.column("row")])
    return pa.table({"i": table.column("i").slice(0, 1), "row": pa.array([total], pa.list_(pa.float64()))})


def weighted_covariance(vectors: DataFrame, n: int, mean: np.ndarray) -> np.ndarray:
    """The mean of weight times the products of x less its mean (columns x, weight)."""
    parts = vectors.select("x", "weight").mapInArrow(_products(mean), "i int, row array<double>")
    rows = parts.groupBy("i").applyInArrow(_added, "i int, row array<double>").orderBy("i").toArrow().column("row")
    out = np.array([r.values.to_numpy() for r in rows]).reshape(len(mean), len(mean)) / n
    return (out + out.T) / 2


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The first eigenvectors (columns) and eigenvalues, greatest first, and the trace; none where there is no variance but
    rounding. The largest entry of each vector is positive."""
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > len(values) * np.finfo(float).eps * values.max(initial=0)]
    vectors = vectors[:, order]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    return vectors, values[order], float(np.trace(covariance))


def _whitened(n: int, sums: list[int], axes: np.ndarray):
    mean = np.array([s / n for s in sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, _, some in _blocks(batches):
            most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
            off = _exact(x, most) * n - _exact(np.array(sums, object if most >= 2**62 else np.int64), most)
            off = _exact(off, int(np.abs(off).max(initial=0)) ** 2 * max(x.shape[1], 1))
            squares = [int(v) if v < 10**38 else None for v in (off * off).sum(axis=1).tolist()]
            yield pa.RecordBatch.from_pydict(
                {"x": some.column(0), "weight": some.column(1), "n": some.column(2), "deviation": squares, "whitened": list((x - mean) @ axes)},
                pa.schema([("x", some.column(0).type), ("weight", pa.int64()), ("n", pa.int64()), ("deviation", _WIDE), ("whitened", pa.list_(pa.float64()))]),
            )

    return run


def identity_error(each: DataFrame, n: int, size: int) -> float:
    """The largest absolute entry of the covariance of ``whitened``, about its own mean, less the identity."""
    own = each.select(F.col("whitened").alias("x"), "weight")
    means = own.select(*(F.sum(F.col("weight") * F.col("x")[i]) / n for i in range(size))).first()
    return float(np.abs(weighted_covariance(own, n, np.array(means, float)) - np.eye(size)).max())


def _joined_back(rows: DataFrame, each: DataFrame) -> DataFrame:
    """vec_id, deviation, whitened of each row. Vectors that one in COMMON rows holds are fewer than that many, and are sent to
    the rows; for the others, rows are dealt out by vector, so none of them fills a task."""
    total = rows.count()
    often = F.broadcast(each.where(F.col("n") * COMMON > total).select("x", "deviation", "whitened"))
    seldom = each.where(F.col("n") * COMMON <= total).select("x", "deviation", "whitened")
    rest = rows.join(often.select("x"), "x", "left_anti").join(seldom, "x")
    return rows.join(often, "x").unionByName(rest).select("vec_id", "deviation", "whitened")


def whiten(vectors: DataFrame, most: int = 8, weights: str = "counts", vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of each row that takes part.

    A number c of a vector becomes x = floor(1024 c) + 100000. weights: ``counts`` fits on all rows, ``one`` on each distinct x
    once; n is the sum of the weights. deviation: the sum over dimensions of (n x - S)**2, exact, as a decimal; null if it
    exceeds 38 digits. whitened: x - S / n along the component, by the root of its eigenvalue. explained: the share of
    the trace. identity_error: the largest absolute entry of the whitened vectors' covariance less the identity.

    Vectors that are null, hold null, NaN, infinite numbers or some beyond 2**52, or haven't the commonest number of dimensions
    take no part. Null and repeated ids stay; equal vectors have equal results. Components without variance are left out, so a
    table of equal vectors, of empty ones or without rows gives no rows. Other columns are not looked at.
    """
    if weights not in ("counts", "one"):
        raise ValueError("weights are counts or one")
    spark = vectors.sparkSession
    rows = written(integer_vectors(vectors, vec_id, embedding), "integer-vectors")
    distinct = written(rows.groupBy("x").agg(F.count(F.lit(1)).alias("n")), "distinct-vectors")
    fitted = distinct.select("x", (F.col("n") if weights == "counts" else F.lit(1).cast("long")).alias("weight"), "n")
    n, sums = weighted_sums(fitted)
    kept, values, trace = np.empty((0, 0)), np.empty(0), 0.0
    if n and sums:
        kept, values, trace = components(weighted_covariance(fitted, n, np.array([s / n for s in sums])), most)
    if not len(values):
        return spark.createDataFrame([], f"vec_id {dict(rows.dtypes)['vec_id']}, component int, n long, deviation decimal(38, 0), whitened double, explained double, identity_error double")
    each = written(fitted.mapInArrow(_whitened(n, sums, kept / np.sqrt(values)), WHITENED), "whitened")
    error = identity_error(each, n, len(values))
    out = _joined_back(rows, each)
    explained = F.array(*(F.lit(float(v / trace)) for v in values))
    out = out.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "value"))
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.col("value").alias("whitened"), F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")
    )

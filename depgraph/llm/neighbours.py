"""Operator 2, approximate nearest neighbours by inner product: balanced posting lists under a graph of centroids.

Vectors get one more component that makes their lengths equal, so that the largest inner product is the smallest
distance. A bounded sample is halved again and again at the median, which gives lists of equal size; their means
are the centroids. A graph of near centroids is held in memory and searched best first. Each vector goes to the
list of its nearest centroid and, near a boundary, to the lists of others that are nearly as near; each query searches the
graph with a beam that grows until it reaches beyond all centroids that are nearly as near as its nearest one, and visits
the lists of these, however many they are. Lists are scored exactly, in double precision.

Equal vectors are one vector with its smallest ids, so a vector that many rows share is one entry of its list.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depgraph.llm.common import has_rows, written

#: Bounds, whatever the input's size: vectors to fit on, lists, and what is scored at once in one task.
FIT_VECTORS, MAX_LISTS, BLOCK = 50_000, 4_096, 4_096
#: Bytes of the vectors to fit on, which come to the driver; wide vectors are fewer.
FIT_BYTES = 128 << 20
#: Vectors of a list (more where MAX_LISTS is reached), lists of a boundary vector, links of a centroid.
LIST, COPIES, DEGREE = 256, 4, 24
#: Lists that each query visits at least, however near the nearest centroid is.
LEAST_VISITS = 4
#: Centroids that a query's search holds at first.
BEAM = 32
#: The share of their true neighbours among the fitted vectors that so many of those must find; the ratio grows to it.
FOUND, TRIED = 0.95, 256


class Centroids:
    """Centroids (float64, with the added component), and for each the numbers of near and a few far ones."""

    def __init__(self, points: np.ndarray, lists: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        parts = [points]
        while len(parts) < lists:
            big = max(range(len(parts)), key=lambda i: len(parts[i]))
            if len(parts[big]) < 2:
                break
            own = parts.pop(big)
            parts += self._halves(own, rng)
        self.at = np.stack([p.mean(axis=0) for p in parts])
        n = len(self.at)
        near = min(DEGREE * 2 // 3, n - 1)
        own = (self.at * self.at).sum(axis=1)
        order = np.concatenate([np.argsort(own - 2 * self.at[i : i + 256] @ self.at.T, axis=1, kind="stable")[:, : near + 1] for i in range(0, n, 256)])
        self.links = np.concatenate((order, rng.integers(0, n, (n, DEGREE - near))), axis=1)

    @staticmethod
    def _halves(own: np.ndarray, rng) -> list[np.ndarray]:
        """Cut at the median along the line between two means."""
        a, b = own[rng.choice(len(own), 2, replace=False)]
        for _ in range(6):
            side = own @ (b - a)
            cut = np.argpartition(side, len(own) // 2)
            a, b = own[cut[: len(own) // 2]].mean(axis=0), own[cut[len(own) // 2 :]].mean(axis=0)
        return [own[cut[: len(own) // 2]], own[cut[len(own) // 2 :]]]

    def distances(self, x: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Squared distances of each row of x to the centroids numbered in the same row of ``to``."""
        own = (self.at * self.at).sum(axis=1)
        out = np.empty(to.shape)
        for i in range(0, len(x), 512):
            some = to[i : i + 512]
            out[i : i + 512] = own[some] - 2 * np.einsum("bd,bmd->bm", x[i : i + 512], self.at[some])
        return np.maximum(out + (x * x).sum(axis=1)[:, None], 0)

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best first through the graph, all rows of x in step: numbers of near centroids and squared distances, nearest first."""
        n, beam = len(self.at), min(beam, len(self.at))
        start = np.unique(np.linspace(0, n - 1, min(beam, max(8, n // 64))).astype(np.int64))
        ids = np.full((len(x), beam), -1)
        far = np.full((len(x), beam), np.inf)
        done = np.ones((len(x), beam), bool)
        ids[:, : len(start)] = start
        far[:, : len(start)] = self.distances(x, np.broadcast_to(start, (len(x), len(start))))
        done[:, : len(start)] = False
        seen = np.zeros((len(x), n), bool)
        seen[:, start] = True
        rows = np.arange(len(x))
        for _ in range(2 * beam):
            pick = np.where(done, np.inf, far).argmin(axis=1)
            live = ~done[rows, pick]
            if not live.any():
                break
            on, pick = rows[live], pick[live]
            done[on, pick] = True
            new = self.links[ids[on, pick]]
            d = np.where(seen[on[:, None], new], np.inf, self.distances(x[on], new))
            twice = np.sort(new, axis=1)
            if (twice[:, 1:] == twice[:, :-1]).any():
                for j in range(1, new.shape[1]):
                    d[:, j] = np.where((new[:, :j] == new[:, j : j + 1]).any(axis=1), np.inf, d[:, j])
            seen[on[:, None], new] = True
            both, both_d = np.concatenate((ids[on], new), axis=1), np.concatenate((far[on], d), axis=1)
            flags = np.concatenate((done[on], np.isinf(d)), axis=1)
            best = np.argpartition(both_d, beam - 1, axis=1)[:, :beam]
            take = lambda a: np.take_along_axis(a, best, axis=1)
            ids[on], far[on], done[on] = take(both), take(both_d), take(flags)
        order = np.argsort(far, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(far, order, axis=1)

    def within(self, x: np.ndarray, ratio: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of near centroids, nearest first, and which of them are within the ratio of the nearest or among the ``least``
        nearest. Rows whose whole beam is within the ratio are searched again with twice the beam, so none is cut off."""
        n = len(self.at)
        ids, keep = np.zeros((len(x), n), np.int64), np.zeros((len(x), n), bool)
        rows, beam = np.arange(len(x)), min(n, BEAM)
        while len(rows):
            found, d = self.search(x[rows], beam)
            near = np.sqrt(d) <= ratio * np.sqrt(d[:, :1]) + 1e-12
            done = ~near[:, -1] | (beam == n)
            near[:, :least] = True
            ids[rows[done], : found.shape[1]], keep[rows[done], : found.shape[1]] = found[done], near[done] & (found[done] >= 0)
            rows, beam = rows[~done], min(n, 2 * beam)
        return ids, keep

    def every(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all centroids and their squared distances, nearest first, for each row of x."""
        own = (self.at * self.at).sum(axis=1)
        far = np.maximum(own - 2 * (x @ self.at.T) + (x * x).sum(axis=1)[:, None], 0)
        order = np.argsort(far, axis=1, kind="stable")
        return order, np.take_along_axis(far, order, axis=1)


def _lists(sent, longest: float, ratio: float, query: bool):
    """The numbers of the lists of each vector: of a query all within the ratio, of another at most COPIES of them."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model: Centroids = pickle.loads(sent.value)
        for vectors in batches:
            for i in range(0, len(vectors), 256):
                some = vectors.slice(i, 256)
                x = np.asarray(some.flatten(), np.float64).reshape(len(some), -1)
                ids, keep = chosen(model, x, longest, ratio, query)
                yield pa.array([a[k] for a, k in zip(ids, keep, strict=True)], pa.list_(pa.int64()))

    return F.arrow_udf(run, "array<long>")


def chosen(model: Centroids, x: np.ndarray, longest: float, ratio: float, query: bool) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of lists, nearest first, for each row of x, and which of them it goes to."""
    if query:
        return model.within(_longer(x, None), ratio, LEAST_VISITS)
    ids, d = model.search(_longer(x, longest), 4 * COPIES)
    keep = np.sqrt(d) <= ratio * np.sqrt(d[:, :1]) + 1e-12
    keep[:, COPIES:] = False
    return ids, keep


def wide_enough(model: Centroids, fitted: np.ndarray, longest: float, near: float, boundary: float, k: int) -> float:
    """The ratio for queries: ``near``, or more where TRIED of the fitted vectors need more to find FOUND of their k best."""
    need = []
    for i in range(0, min(TRIED, len(fitted)), 64):
        asks = fitted[i : min(i + 64, TRIED)]
        scores = asks @ fitted.T
        scores[np.arange(len(asks)), np.arange(i, i + len(asks))] = -np.inf
        most = min(k, len(fitted) - 1)
        best = np.argpartition(-scores, most - 1, axis=1)[:, :most] if most else np.empty((len(asks), 0), np.int64)
        ids, d = model.every(_longer(asks, None))
        times = np.empty(d.shape)
        np.put_along_axis(times, ids, np.sqrt(d) / np.maximum(np.sqrt(d[:, :1]), 1e-12), axis=1)
        lists, keep = chosen(model, fitted[best.ravel()], longest, boundary, False)
        row = np.repeat(np.arange(len(asks)), most)
        need.append(np.where(keep, times[row[:, None], lists], np.inf).min(axis=1))
    need = np.concatenate(need)
    return max(near, float(np.quantile(need, FOUND))) if len(need) else near


def _longer(x: np.ndarray, longest: float | None) -> np.ndarray:
    more = np.zeros(len(x)) if longest is None else np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0))
    return np.concatenate((x, more[:, None]), axis=1)


_SCORED = pa.schema([("query", pa.int64()), ("vector", pa.int64()), ("first", pa.int64()), ("score", pa.float64())])


def _scored(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: vectors of one block of a list. right: queries that visit it, with the score to reach. The k best of
        the block for each query."""
        names = {"query": [], "vector": [], "first": [], "score": []}
        if left.num_rows and right.num_rows:
            matrix = lambda t: np.asarray(t.column("embedding").combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1)
            x, keys, first = matrix(left), left.column("key").to_numpy(), left.column("first").to_numpy()
            q, queries, bar = matrix(right), right.column("key").to_numpy(), right.column("bar").to_numpy()
            for i in range(0, len(q), 1024):
                scores = q[i : i + 1024] @ x.T
                at = max(0, len(x) - k)
                least = np.maximum(np.partition(scores, at, axis=1)[:, at], bar[i : i + 1024] - 1e-12)
                row, column = np.nonzero(scores >= least[:, None])
                order = np.lexsort((first[column], -scores[row, column], row))
                row, column = row[order], column[order]
                best = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, column = row[best], column[best]
                for name, values in (("query", queries[i : i + 1024][row]), ("vector", keys[column]), ("first", first[column]), ("score", scores[row, column])):
                    names[name].append(values)
        flat = {n: np.concatenate(v) if v else np.empty(0, np.float64 if n == "score" else np.int64) for n, v in names.items()}
        return pa.table(flat, _SCORED)

    return run


def nearest(vectors: DataFrame, is_query, k: int = 20, near: float = 1.1, boundary: float = 1.03, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k vectors found with the largest inner products for each query.

    is_query: Column that tells the query rows. A query's own row is no answer to it; equal vectors are. Equal scores
    go by the smaller vec_id. near, boundary: how many times as far as the nearest centroid may a query's or a
    vector's further lists be; near grows where the fitted vectors show that it is too little (FOUND). Vectors that are null, zero, not of the commonest length, or hold null, NaN or
    infinite components take no part, nor do rows with a null id; of repeated ids each row takes part. The index is
    fitted on at most FIT_VECTORS vectors and FIT_BYTES bytes, those with the least hash, and holds all. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    whole = "id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)"
    rows = written(rows.where(whole).withColumn("key", F.xxhash64("embedding")), "vectors")
    size = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("embedding") == size["n"])
    # at most k + 1 rows of a group of equal vectors leave a task
    least = rows.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("r") <= k + 1)
    distinct = written(least.groupBy("key").agg(F.first("embedding").alias("embedding"), F.sort_array(F.collect_list("id")).alias("ids"), F.min("id").alias("first")), "distinct-vectors")
    total = distinct.count()
    longest = distinct.agg(F.max(F.expr("sqrt(aggregate(embedding, double(0), (s, x) -> s + x * x))"))).first()[0]
    most = max(1, min(FIT_VECTORS, FIT_BYTES // (8 * max(1, size["n"]))))
    sample = distinct.orderBy(F.xxhash64("key"), "key").limit(most).select("embedding").toArrow().column(0).combine_chunks()
    sample = sample.flatten().to_numpy().reshape(len(sample), -1)
    model = Centroids(_longer(sample, longest), min(MAX_LISTS, max(1, total // LIST)))
    near = wide_enough(model, sample, longest, near, boundary, k)
    sent = spark.sparkContext.broadcast(pickle.dumps(model))
    placed = written(distinct.select("key", "first", "embedding", F.explode(_lists(sent, longest, boundary, False)("embedding")).alias("list")), "lists")
    asking = rows.where("asks").dropDuplicates(["key"]).select("key", "embedding", F.posexplode(_lists(sent, longest, near, True)("embedding")).alias("at", "list"))
    asking = written(asking, "visits")
    if not has_rows(asking):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # long lists, and lists that many queries visit, are scored in blocks; there are at most MAX_LISTS counts
    blocks = lambda df, name: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias(name))
    sizes = written(blocks(placed, "across").join(blocks(asking, "down"), "list"), "blocks")
    left = placed.join(F.broadcast(sizes), "list").withColumn("a", F.expr("pmod(key, across)")).withColumn("d", F.explode(F.expr("sequence(0L, down - 1)"))).select("list", "a", "d", "key", "first", "embedding")

    def scored(visits: DataFrame, name: str) -> DataFrame:
        own = F.broadcast(sizes.select(*(F.col(c).alias(c) for c in sizes.columns)))
        right = visits.join(own, "list").withColumn("d", F.expr("pmod(key, down)")).withColumn("a", F.explode(F.expr("sequence(0L, across - 1)"))).select("list", "a", "d", "key", "embedding", "bar")
        both = left.groupBy("list", "a", "d").cogroup(right.groupBy("list", "a", "d")).applyInArrow(_scored(k + 1), "query long, vector long, first long, score double")
        return written(both, name)

    def best(of: DataFrame) -> DataFrame:
        """The k + 1 best vectors of each query; a vector of several lists counts once."""
        once = of.groupBy("query", "vector").agg(F.max("score").alias("score"), F.min("first").alias("first"))
        return once.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "first"))).where(F.col("r") <= k + 1)

    # the nearest lists give each query a score that what the others send must reach
    close = scored(asking.where(F.col("at") < LEAST_VISITS).withColumn("bar", F.lit(float("-inf"))), "scored")
    bars = best(close).where(F.col("r") == k + 1).select(F.col("query").alias("key"), F.col("score").alias("bar"))
    further = asking.where(F.col("at") >= LEAST_VISITS).join(bars, "key", "left").withColumn("bar", F.coalesce("bar", F.lit(float("-inf"))))
    top = best(close.unionByName(scored(further, "scored"))).select("query", "vector", "score")
    top = top.join(distinct.select(F.col("key").alias("vector"), "ids"), "vector")
    top = top.select("query", "score", F.explode("ids").alias("vec_id"))
    lists = top.groupBy("query").agg(F.expr(f"slice(array_sort(collect_list(struct(-score AS far, vec_id, score))), 1, {k + 1})").alias("found"))
    lists = written(lists, "found")
    asked = rows.where("asks").select(F.col("id").alias("query_id"), F.col("key").alias("query"))
    own = F.expr(f"slice(filter(found, f -> f.vec_id <> query_id), 1, {k})")
    out = asked.join(lists, "query").select("query_id", F.posexplode(own).alias("at", "f"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))

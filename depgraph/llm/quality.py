"""Operator 8, quality classifier: hierarchical empirical Bayes over documents, hosts and paths.

A logistic model of each target (good quality, toxic) is fitted on a bounded sample of labelled documents: on shape
features of the text and on a lexicon of words that tell the target's classes apart. Its log-odds, less those of
the sample, are a document's evidence. Grouped aggregation over all documents gives each host and each path within
a host the share that the model expects; a host's share is shrunk toward the global one, and a path's toward its
host's, by as many pseudo-documents as the spread between sites tells, so sparse sites say little. The posterior
adds a document's evidence to the log-odds of its path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depgraph.llm.common import NOT_ALNUM, SPACE, Words, by_bytes, give_back, small_batches, unused, written

#: Bounds, whatever the input's size: labelled documents to fit on, words of a lexicon, rows of sites that are broadcast.
FIT_DOCUMENTS, LEXICON, BROADCAST_SITES = 20_000, 2_000, 100_000
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "bar": b"|", "symbol": b"#$%&*+<=>@[]^_{}~\\", "mark": b"!?", "stop": b".,;:", "line": b"\n"}


def features(texts: pa.Array, lexicons: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A row of shape features and lexicon sums for each text; zeros, but for the constant, for null and empty ones."""
    words = Words(texts, SPACE, lower=True)
    n = words.counts
    ends = np.cumsum(n)
    begins = ends - n
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), np.int64)
    offsets = np.r_[0, np.cumsum(sizes)]
    per = np.maximum(sizes, 1)

    def total(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(values)]
        return sums[b] - sums[a]

    rows = [np.ones(len(n)), np.log1p(n), total(words.ends - words.starts, begins, ends) / np.maximum(n, 1) / 10]
    for some in _CLASSES.values():
        table = np.zeros(256, np.int32)
        table[list(some)] = 1
        rows.append(np.sqrt(total(table[words.data], offsets[:-1], offsets[1:]) / per))
    again = np.r_[words.hashes[1:] == words.hashes[:-1], False][: len(words.hashes)]
    rows.append(total(again.astype(np.int32), begins, np.maximum(ends - 1, begins)) / np.maximum(n, 1))
    rows.append(np.array([len(np.unique(words.hashes[a:b])) / (b - a) if b > a else 1.0 for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]))
    words = Words(texts, NOT_ALNUM, lower=True)
    n = words.counts
    ends = np.cumsum(n)
    begins = ends - n
    for known, weights in lexicons:
        value = np.zeros(len(words.hashes))
        if len(known):
            at = np.minimum(np.searchsorted(known, words.hashes), len(known) - 1)
            there = known[at] == words.hashes
            value[there] = weights[at[there]]
        up, down = total(np.maximum(value, 0), begins, ends), total(np.minimum(value, 0), begins, ends)
        rows += [np.log1p(up), np.log1p(up / np.sqrt(np.maximum(n, 1))), np.log1p(-down)]
    return np.stack(rows, axis=1)


def _document_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """target, word: each distinct word of each labelled document."""
    for whole in batches:
        for batch in by_bytes(whole, 0):
            words = Words(batch.column(0), NOT_ALNUM, lower=True)
            distinct = [np.unique(words.hashes[a:b]).astype(np.int64) for a, b in words.each()]
            if sum(map(len, distinct)):
                target = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), [len(x) for x in distinct])
                yield pa.RecordBatch.from_arrays([pa.array(target, pa.int32()), pa.array(np.concatenate(distinct))], names=["target", "word"])


def lexicon(sample: DataFrame, text: str, target: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and log-odds of the words that tell the classes apart most surely."""
    both = sample.where(F.col(target).isNotNull()).select(text, F.col(target).cast("int"))
    n0, n1 = (both.where(F.col(target) == v).count() for v in (0, 1))
    if not n0 or not n1:
        return np.empty(0, np.uint64), np.empty(0)
    counted = both.mapInArrow(_document_words, "target int, word long").groupBy("word").agg(F.count("*").alias("n"), F.sum("target").alias("k")).where("n >= 5")
    odds = F.log((F.col("k") + 0.5) / (n1 + 1.0)) - F.log((F.col("n") - F.col("k") + 0.5) / (n0 + 1.0))
    sure = F.abs("odds") / F.sqrt(1 / (F.col("k") + 0.5) + 1 / (F.col("n") - F.col("k") + 0.5))
    best = counted.withColumn("odds", odds).withColumn("sure", sure).where("sure > 4 AND abs(odds) > 1").orderBy(F.desc("sure"), "word").limit(LEXICON).select("word", "odds").collect()
    hashes = np.array([w for w, _ in best], np.int64).astype(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.array([o for _, o in best], float)[order]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the first column is the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """Lexicons and, for each target, weights and the sample's log-odds."""

    def __init__(self, targets: list[str], lexicons: list, weights: list[np.ndarray], priors: list[float]):
        self.targets, self.lexicons, self.weights, self.priors = targets, lexicons, weights, priors

    def evidence(self, text) -> Column:
        """Column array<double>: the log-odds of each target that the text adds to those of its site."""
        lexicons, weights = self.lexicons, np.stack(self.weights, axis=1)
        priors = np.array(self.priors)

        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                parts = [np.clip(features(b.column(0), lexicons) @ weights - priors, -20, 20) for b in by_bytes(pa.RecordBatch.from_arrays([texts], names=["t"]), 0)]
                flat = np.concatenate(parts).ravel() if parts else np.empty(0)
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(priors)), pa.array(flat))
            give_back()

        return F.arrow_udf(score, "array<double>")(text)


def fit(docs: DataFrame, labels: DataFrame, targets: list[str], doc_id: str = "doc_id", text: str = "text", most: int = FIT_DOCUMENTS) -> Model:
    """Fit on at most ``most`` labels of documents, those with the least hash of their id. Rows that repeat an id count
    as one, with the least of their texts. A target that has one class only, or no labels, gets no weights."""
    known = labels.select(F.col(doc_id).alias("id"), *targets).where("id IS NOT NULL")
    chosen = known.orderBy(F.xxhash64("id"), "id", *targets).limit(most)
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("_text")).join(F.broadcast(chosen.select("id").distinct()), "id").groupBy("id").agg(F.min("_text").alias("_text"))
    sample = written(texts.join(F.broadcast(chosen), "id").select("_text", *targets), "labelled")
    lexicons = [lexicon(sample, "_text", t) for t in targets]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, 0):
                x = features(batch.column(0), lexicons)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), *batch.columns[1:]], names=["x", *targets])

    kinds = ", ".join(f"{t} int" for t in targets)
    table = sample.select("_text", *(F.col(t).cast("int") for t in targets)).mapInArrow(rows, f"x array<double>, {kinds}").toPandas()
    weights, priors = [], []
    for t in targets:
        own = table[table[t].isin([0, 1])]
        y = own[t].to_numpy(float)
        if len(set(y)) < 2:
            weights.append(np.zeros(_width(len(targets))))
            priors.append(0.0)
        else:
            weights.append(logistic(np.stack(own["x"].to_list()), y))
            priors.append(float(np.log(y.mean() / (1 - y.mean()))))
    return Model(targets, lexicons, weights, priors)


def _width(lexicons: int) -> int:
    return features(pa.array([""]), [(np.empty(0, np.uint64), np.empty(0))] * lexicons).shape[1]


def site_priors(paths: DataFrame, prior: float, i: int) -> DataFrame:
    """host, path, site: the log-odds of each path, shrunk toward its host's share and those toward the global one.

    paths: of each path the documents n, and the sums s and q of what the model expects of them and of its squares.
    Pseudo-documents are estimated by moments: the variance within sites over that between them.
    """
    paths = paths.select("host", "path", "n", F.col(f"s{i}").alias("s"), F.col(f"q{i}").alias("q"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"), F.sum("q").alias("host_q"))
    within, between = F.col("host_q") - F.col("host_s") ** 2 / F.col("host_n"), F.col("host_s") ** 2 / F.col("host_n")
    sums = hosts.agg(F.sum("host_n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(within).alias("within"), F.sum(between).alias("between"), F.sum("host_s").alias("s")).first()
    n = sums["n"] or 0
    share = sums["s"] / n if n else float(1 / (1 + np.exp(-prior)))
    m = _pseudo(n, sums["k"], sums["within"], (sums["between"] or 0.0) - n * share * share)
    hosts = hosts.withColumn("host_share", (F.col("host_s") + F.lit(m * share)) / (F.col("host_n") + F.lit(m)))
    both = paths.join(hosts.withColumnRenamed("host", "h"), F.expr("host <=> h"))
    within, between = F.col("q") - F.col("s") ** 2 / F.col("n"), F.col("n") * (F.col("s") / F.col("n") - F.col("host_s") / F.col("host_n")) ** 2
    sums = both.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(within).alias("within"), F.sum(between).alias("between")).first()
    m = _pseudo(sums["n"] or 0, sums["k"], sums["within"], sums["between"] or 0.0)
    shrunk = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), (F.col("s") + F.lit(m) * F.col("host_share")) / (F.col("n") + F.lit(m))))
    return both.select("host", "path", F.log(shrunk / (1 - shrunk)).alias("site"))


def _pseudo(n: int, k: int, within: float | None, between: float) -> float:
    """Pseudo-documents of a prior over k sites of n documents, from sums of squares; between 1 and 10,000."""
    if n <= k or k < 2:
        return 10_000.0
    inner = max(within or 0.0, 1e-9) / (n - k)
    outer = (between - inner * (k - 1)) / n
    return float(min(10_000.0, max(1.0, inner / outer))) if outer > 0 else 10_000.0


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, doc_id: str = "doc_id", text: str = "text", good: str = "quality", toxic: str = "toxic", most: int = FIT_DOCUMENTS) -> DataFrame:
    """Add quality_score and toxic_score (posteriors between 0 and 1) and keep: good rather than not, and not toxic.

    Columns so named are replaced, all others stay. Null texts count as empty, null hosts and paths are sites of their
    own, and repeated rows each count and get a row. The evidence is written once, with the rows that it is of.
    Labels other than 0 and 1 are left out; several labels of one document all count. Without labels of both classes
    a target's posterior is that of the model's zero weights, 0.5, and for toxic nothing is dropped.
    """
    small_batches(docs.sparkSession)
    model = fit(docs, labels, [good, toxic], doc_id, text, most)
    known = [bool(np.any(w)) for w in model.weights]
    e, h, p, *site = unused(docs, "evidence", "host", "path", "site0", "site1", "site_host", "site_path")
    scored = written(docs.withColumns({e: model.evidence(F.col(text)), h: host, p: path}), "evidence")
    expected = [1 / (1 + F.exp(-(F.col(e)[i] + prior))) for i, prior in enumerate(model.priors)]
    summed = scored.select(F.col(h).alias("host"), F.col(p).alias("path"), *(x.alias(f"p{i}") for i, x in enumerate(expected)))
    sums = [f(i).alias(f"{x}{i}") for i in range(2) for x, f in (("s", lambda i: F.sum(f"p{i}")), ("q", lambda i: F.sum(F.col(f"p{i}") * F.col(f"p{i}"))))]
    paths = written(summed.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *sums), "paths")
    sites = [site_priors(paths, model.priors[i], i).withColumnRenamed("site", site[i]) for i in range(2)]
    both = sites[0].alias("a").join(sites[1].alias("b"), F.expr("a.host <=> b.host AND a.path <=> b.path")).select(F.col("a.host").alias(site[2]), F.col("a.path").alias(site[3]), *site[:2])
    both = written(both, "sites")
    small = both.count() <= BROADCAST_SITES
    out = scored.join(F.broadcast(both) if small else both, F.col(h).eqNullSafe(F.col(site[2])) & F.col(p).eqNullSafe(F.col(site[3])))
    posterior = [1 / (1 + F.exp(-(F.col(e)[i] + F.col(site[i])))) for i in range(2)]
    out = out.withColumns({"quality_score": posterior[0], "toxic_score": posterior[1]})
    keep = (F.col("quality_score") >= 0.5 if known[0] else F.lit(True)) & (F.col("toxic_score") < 0.5 if known[1] else F.lit(True))
    return out.withColumn("keep", keep).drop(e, h, p, *site)

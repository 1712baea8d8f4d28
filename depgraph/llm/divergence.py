"""Operator 13, source divergence audit: how far each source's use of terms is from that of its language and its other sources.

1. Texts are cut into slices; each slice becomes one row: its distinct terms in order, and of each document its language, its
   source and the numbers and counts of its terms. Texts are read once.
2. Iceberg refinement: a term is a string of bytes and an end mark. Level by level the first 4, 8, 16, ... bytes of the terms are
   counted by the distinct documents of a language that hold a term so beginning. A prefix with too few documents is
   discarded with all that begins with it; a prefix with its end mark is a complete term, and is kept and not looked at again.
   Levels end when no unfinished prefix is left. Which prefixes go on is sent to the tasks as a bitmap of a fixed size; where two
   unfinished prefixes share a bit, one that should have gone lives on for a level and is then counted exactly.
3. Occurrences of kept terms are summed by source, and compared in integers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depgraph.llm.common import Words, by_bytes, discard, give_back, has_rows, joined, small_batches, written

#: Bytes between terms: all of ASCII but letters.
NOT_LETTERS = bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Bytes of texts in a slice, bytes of the first level's prefixes, bits of the map of prefixes that go on, counts that a task
#: adds up before it hands them on, and counters that it holds at once for pairs of which most don't occur.
SLICE, FIRST, BITS, ADDED, DENSE = 2 << 20, 4, 25, 1_000_000, 1 << 20
#: No byte of a text in UTF-8.
END = b"\xff"
#: Sources and terms that one task compares at once.
SOURCES, TERMS = 256, 2_048

SLICED = "terms array<binary>, groups array<struct<lang: string, source: string>>, doc_group binary, doc_pairs binary, pair_term binary, pair_count binary"
_GROUP = pa.struct([("lang", pa.string()), ("source", pa.string())])
_SLICED = pa.schema([("terms", pa.list_(pa.binary())), ("groups", pa.list_(_GROUP))] + [(n, pa.binary()) for n in ("doc_group", "doc_pairs", "pair_term", "pair_count")])


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, lang, source of documents, none of them null: a row for each slice.

    doc_group: of each document the number of its group; doc_pairs: how many distinct terms it has; pair_term, pair_count:
    the numbers of these, rising, and how often each occurs. All are little-endian 32-bit numbers.
    """
    for batch in _gathered(batches):
        words = Words(batch.column(0), NOT_LETTERS, lower=True)
        found = words.exact()
        order = pc.array_sort_indices(found.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        term = place[found.indices.to_numpy()] if len(found) else np.empty(0, np.int64)
        doc = np.repeat(np.arange(len(batch)), words.counts)
        pairs, times = np.unique(doc * max(len(order), 1) + term, return_counts=True)
        groups: dict[tuple[str, str], int] = {}
        own = [groups.setdefault(g, len(groups)) for g in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        packed = lambda a: np.asarray(a).astype("<i4").tobytes()
        terms = found.dictionary.take(pa.array(order)).cast(pa.binary())
        yield pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms),
                pa.array([[{"lang": a, "source": b} for a, b in groups]], pa.list_(_GROUP)),
                pa.array([packed(own)], pa.binary()),
                pa.array([packed(np.bincount(pairs // max(len(order), 1), minlength=len(batch)))], pa.binary()),
                pa.array([packed(pairs % max(len(order), 1))], pa.binary()),
                pa.array([packed(times)], pa.binary()),
            ],
            schema=_SLICED,
        )
    give_back()


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about SLICE bytes of texts, put together from small ones or cut from large ones."""
    held, size = [], 0
    for whole in batches:
        for part in by_bytes(whole, 0, SLICE):
            held.append(part)
            size += part.column(0).nbytes
            if size >= SLICE:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


class _Slice:
    """One row of SLICED: its terms with their end marks, its pairs of document and term, and their languages."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        terms = batch.column(0)[i].values
        self.terms = pc.binary_join_element_wise(terms, pa.scalar(END, pa.binary()), pa.scalar(b"", pa.binary())) if len(terms) else terms
        self.groups = [(g["lang"], g["source"]) for g in batch.column(1)[i].as_py()]
        codes: dict[str, int] = {}
        of_group = np.array([codes.setdefault(a, len(codes)) for a, _ in self.groups], np.int64)
        self.langs = list(codes)
        read = lambda c: np.frombuffer(batch.column(c)[i].as_buffer(), "<i4").astype(np.int64)
        doc_group, doc_pairs, self.term, self.count = (read(c) for c in range(2, 6))
        self.doc = np.repeat(np.arange(len(doc_group)), doc_pairs)
        self.group = np.repeat(doc_group, doc_pairs)
        self.lang = of_group[self.group]

    def prefixes(self, length: int) -> tuple[pa.Array, np.ndarray]:
        """The distinct prefixes of that many bytes in order, and for each pair the number of its prefix."""
        coded = pc.binary_slice(self.terms, 0, length).dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy().astype(np.int64)[self.term]

    def keep(self, on: np.ndarray) -> None:
        self.term, self.count, self.doc, self.group, self.lang = (a[on] for a in (self.term, self.count, self.doc, self.group, self.lang))


def _slots(langs: list[str], of: np.ndarray, prefixes: pa.Array, which: np.ndarray, length: int) -> np.ndarray:
    """Bits of the map for pairs of a language (a number in ``langs``) and a prefix of at most ``length`` bytes (a number)."""
    width = -(-length // 8)
    offsets = np.frombuffer(prefixes.buffers()[1], np.int32)[prefixes.offset : prefixes.offset + len(prefixes) + 1].astype(np.int64)
    data = np.frombuffer(prefixes.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(prefixes) else np.empty(0, np.uint8)
    sizes = np.diff(offsets)
    padded = np.zeros((len(prefixes), 8 * width), np.uint8)
    padded[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = data
    h = sizes.astype(np.uint64)
    for column in padded.view("<u8").T:
        h = joined(h, column)
    start = np.array([zlib.crc32(x.encode()) for x in langs], np.uint64)
    return (joined(start[of], h[which]) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _added(parts: Iterator[tuple[list[tuple], np.ndarray, pa.Array, np.ndarray]], fields: list[str], key: str, sum_: str) -> Iterator[pa.RecordBatch]:
    """The sums of what several slices of a task have counted; of each its groups (strings, one for each field), and the number of
    the group, the key and the count of each row. Groups are numbered anew within the task, and named where rows are handed on."""
    held, size, numbers = [], 0, {}

    def summed(more: bool = False) -> Iterator[pa.RecordBatch]:
        found = pa.concat_tables(held).group_by(["group", key]).aggregate([(sum_, "sum")]).rename_columns(["group", key, sum_])
        held.clear()
        if more and len(found) <= ADDED * 2 // 3:
            # slices share much, so the next ones may be added to these
            held.append(found)
            return
        names = [pa.array([g[i] for g in numbers], pa.string()) for i in range(len(fields))]
        for some in found.to_batches(max_chunksize=50_000):
            yield pa.RecordBatch.from_arrays([*(n.take(some.column("group")) for n in names), some.column(key), some.column(sum_)], names=[*fields, key, sum_])

    for groups, which, keys, sums in parts:
        own = np.array([numbers.setdefault(g, len(numbers)) for g in groups], np.int32)
        held.append(pa.table({"group": own[which], key: keys, sum_: sums}))
        size += len(sums)
        if size >= ADDED:
            yield from summed(more=True)
            size = sum(map(len, held))
    if held:
        yield from summed()


def _grouped(major: np.ndarray, minor: np.ndarray, minors: int, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs (major, minor) and how many there are of each, or the sums of their weights."""
    minors = max(minors, 1)
    keys = major * minors + minor
    most = (int(major.max()) + 1) * minors if len(major) else 0
    if most <= DENSE:
        sums = np.bincount(keys, weights, most).astype(np.int64)
        keys = np.flatnonzero(sums)
        sums = sums[keys]
    else:
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sums = np.diff(np.r_[first, len(keys)]) if weights is None else np.add.reduceat(weights[order], first)
        keys = keys[first]
    return keys // minors, keys % minors, sums


def _narrowed(s: _Slice, length: int, bitmap: np.ndarray, open_only: bool = False) -> None:
    """Leave the pairs whose prefix of that length has its bit set for their language; ``open_only``: and has no end mark."""
    names, at = s.prefixes(length)
    langs, which, _ = _grouped(s.lang, at, len(names))
    slots = _slots(s.langs, langs, names, which, length)
    live = np.zeros(len(s.langs) * max(len(names), 1), bool)
    live[langs * max(len(names), 1) + which] = (bitmap[slots >> 6] >> (slots & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
    on = live[s.lang * max(len(names), 1) + at]
    if open_only and len(names):
        on &= ~pc.ends_with(names, END).to_numpy(zero_copy_only=False)[at]
    s.keep(on)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[_Slice]:
    for batch in batches:
        for i in range(len(batch)):
            yield _Slice(batch, i)


def _level(length: int, before: int | None, sent):
    """lang, prefix, docs of a task's slices: documents by prefixes of ``length`` bytes, of terms whose shorter prefix goes on."""

    def counted(s: _Slice) -> tuple[list[tuple], np.ndarray, pa.Array, np.ndarray]:
        if before is not None:
            # a complete term was counted at its level, and may share a bit with a prefix that goes on
            _narrowed(s, before, sent.value, open_only=True)
        names, at = s.prefixes(length)
        # a document's terms stand in order, and so do their prefixes
        new = np.r_[True, (at[1:] != at[:-1]) | (s.doc[1:] != s.doc[:-1])] if len(at) else np.empty(0, bool)
        langs, which, docs = _grouped(s.lang[new], at[new], len(names))
        return [(x,) for x in s.langs], langs, names.take(pa.array(which)), docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _added(map(counted, _slices(batches)), ["lang"], "prefix", "docs")
        give_back()

    return run


def _bitmap(found: DataFrame, length: int) -> np.ndarray:
    """The bits of the prefixes (lang, prefix): at most 2**BITS / 64 words come to the driver, whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            slots = _slots(langs.dictionary.to_pylist(), langs.indices.to_numpy(), batch.column(1), np.arange(len(batch)), length)
            yield pa.RecordBatch.from_pydict({"word": slots >> 6, "bit": (np.uint64(1) << (slots & 63).astype(np.uint64)).view(np.int64)})

    held = found.select("lang", "prefix").mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros((1 << BITS) // 64, np.uint64)
    out[held.column("word").to_numpy()] = held.column("bits").to_numpy().view(np.uint64)
    return out


def kept_terms(slices: DataFrame, least: int) -> tuple[DataFrame, int]:
    """lang, term, prefix (with the end mark) of the terms in at least ``least`` documents of their language, by refinement of
    their prefixes; and the length of the last prefixes, which no kept term exceeds."""
    spark = slices.sparkSession
    before, sent, kept, length = None, None, None, FIRST
    while True:
        counted = slices.mapInArrow(_level(length, before, sent), "lang string, prefix binary, docs long").groupBy("lang", "prefix").agg(F.sum("docs").alias("docs"))
        counted = written(counted.where(F.col("docs") >= least).select("lang", "prefix", F.expr(f"endswith(prefix, X'{END.hex()}')").alias("whole")), "prefixes")
        done = counted.where("whole").select("lang", F.expr("decode(substr(prefix, 1, length(prefix) - 1), 'UTF-8')").alias("term"), "prefix")
        kept = done if kept is None else kept.unionByName(done)
        open_ = counted.where("NOT whole")
        if not has_rows(open_):
            return kept, length
        before, sent, length = length, spark.sparkContext.broadcast(_bitmap(open_, length)), 2 * length


def _counts(length: int, sent):
    """lang, source, term, n of a task's slices: occurrences of the terms whose bit is set."""

    def counted(s: _Slice) -> tuple[list[tuple], np.ndarray, pa.Array, np.ndarray]:
        _narrowed(s, length, sent.value)
        names, at = s.prefixes(length)
        # a cut term is none that is kept, and shares a bit with one by chance
        whole = pc.ends_with(names, END).to_numpy(zero_copy_only=False) if len(names) else np.empty(0, bool)
        on = whole[at]
        groups, which, n = _grouped(s.group[on], at[on], len(names), s.count[on])
        terms = pc.binary_slice(names.filter(pa.array(whole)), 0, -1).cast(pa.string())
        number = np.cumsum(whole) - 1
        return s.groups, groups, terms.take(pa.array(number[which])), n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _added(map(counted, _slices(batches)), ["lang", "source"], "term", "n")
        give_back()

    return run


def _share(n: str, total: str, terms: str) -> str:
    """1 + floor(10**9 * (n + 2) / (total + 2 * terms)), exactly, as SQL."""
    return f"(1 + (cast(1000000000 as decimal(10, 0)) * cast({n} + 2 as decimal(20, 0))) div cast({total} + 2 * {terms} as decimal(20, 0)))"


_DISTANCE = "((p - q) * (p - q)) div (p + q)"
_PAIRS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64()), ("seen", pa.int64())])


def _compared(left: pa.Table, right: pa.Table) -> pa.Table:
    """left: source, block, term, p of one block of terms. right: all sources of the blocks compared (source, block, p of a
    term that they lack). For each two sources of the two blocks the sum over these terms."""
    rows: dict[str, list] = {n: [] for n in _PAIRS.names}
    if left.num_rows and right.num_rows:
        lang, low, high = (right.column(c)[0].as_py() for c in ("lang", "low", "high"))
        terms = left.column("term").combine_chunks().dictionary_encode()
        at = terms.indices.to_numpy()
        names, own = right.column("source").to_pylist(), right.column("block").to_numpy()
        table = np.repeat(right.column("p").to_numpy()[:, None], len(terms.dictionary), axis=1)
        number = {x: i for i, x in enumerate(names)}
        table[[number[x] for x in left.column("source").to_pylist()], at] = left.column("p").to_numpy()
        for i in np.flatnonzero(own == low):
            others = np.flatnonzero(own == high)
            others = others[others > i] if low == high else others
            p, q = table[i][None, :], table[others]
            values = ((p - q) ** 2 // (p + q)).sum(axis=1)
            for j, v in zip(others.tolist(), values.tolist(), strict=True):
                for a, b in ((i, j), (j, i)):
                    for k, x in zip(_PAIRS.names, (lang, names[a], names[b], v, len(terms.dictionary)), strict=True):
                        rows[k].append(x)
    return pa.Table.from_pydict(rows, _PAIRS)


def audit(docs: DataFrame, least: int = 10, top: int = 10, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank.

    A term is a run of ASCII letters and of characters beyond ASCII, with A-Z lower-cased. Each language keeps its terms in at
    least ``least`` rows. A source's share of a kept term is p = 1 + floor(10**9 (n + 2) / (N + 2 V)), with n occurrences of
    it, N of all kept terms and V kept terms; the distance of two shares is floor((p - q)**2 / (p + q)). Part ``pair``: item is each
    other source of the language, value the sum of distances. Part ``term``: item is each kept term of which the source
    has a greater share than its language, value the distance, the ``top`` greatest only. Ranks count from 1, greater
    values first, then items in the order of their bytes.

    Null texts, languages and sources are empty strings; each row is a document, repeated ones too. A source without kept terms has pairs but
    no terms, a source alone in its language no pairs. Other columns are not looked at. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark, size=2 * SLICE)
    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))))
    slices = written(own.mapInArrow(_sliced, SLICED), "slices")
    groups = written(slices.select(F.explode("groups").alias("g")).select("g.lang", "g.source").distinct(), "groups")
    kept, length = kept_terms(slices, least)
    kept = written(kept, "kept-terms")
    found = slices.mapInArrow(_counts(length, spark.sparkContext.broadcast(_bitmap(kept, length))), "lang string, source string, term string, n long")
    counts = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")).join(kept, ["lang", "term"], "left_semi")
    counts = written(counts, "term-counts")
    discard(slices)
    sizes = groups.select("lang").distinct().join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms")), "lang", "left").select("lang", F.coalesce("terms", F.lit(0)).alias("terms"))
    whole = counts.groupBy("lang").agg(F.sum("n").alias("whole"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    named = groups.join(sums, ["lang", "source"], "left").join(sizes, "lang").join(whole, "lang", "left")
    blocks = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / SOURCES).cast("long").alias("blocks"))
    named = named.join(blocks, "lang").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "terms", F.coalesce("whole", F.lit(0)).alias("whole"), "blocks")
    named = written(named.withColumn("block", F.expr("pmod(xxhash64(source), blocks)")), "sources")
    shares = counts.join(named, ["lang", "source"]).withColumn("p", F.expr(_share("n", "total", "terms")))
    shares = written(shares.select("lang", "source", "term", "n", "p", "whole", "terms", "block", "blocks"), "shares")
    terms = shares.withColumn("all", F.expr("sum(n) OVER (PARTITION BY lang, term)")).withColumn("q", F.expr(_share("all", "whole", "terms")))
    best = ranked(terms.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_DISTANCE).alias("value"))).where(F.col("rank") <= top)
    return best.unionByName(ranked(_pairs(named, shares)))


def _pairs(named: DataFrame, shares: DataFrame) -> DataFrame:
    """Each two sources of a language, in both orders. Terms are compared block by block with blocks of sources; what neither
    of two sources has, and no other of their blocks, is counted and not compared."""
    sides = lambda block: F.explode(F.expr(f"transform(sequence(0L, blocks - 1), b -> named_struct('low', least(b, {block}), 'high', greatest(b, {block})))")).alias("s")
    parts = f"((terms - 1) div {TERMS} + 1)"
    left = shares.select("lang", "source", "term", "p", F.expr(f"pmod(xxhash64(term), {parts})").alias("part"), sides("block")).select("lang", "part", "s.*", "source", "term", "p")
    zero = F.expr(f"if(terms > 0, {_share('0', 'total', 'terms')}, 1L)").alias("p")
    right = named.where("terms > 0").select("lang", "source", "block", zero, F.explode(F.expr(f"sequence(0L, {parts} - 1)")).alias("part"), sides("block")).select("lang", "part", "s.*", "source", "block", "p")
    keys = ["lang", "part", "low", "high"]
    sums = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_compared, "lang string, source string, item string, value long, seen long")
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    own = named.select("lang", "source", "terms", zero)
    other = named.select("lang", F.col("source").alias("item"), zero.alias("q"))
    every = own.join(other, "lang").where("source <> item").join(sums, ["lang", "source", "item"], "left")
    value = f"if(terms > 0, coalesce(value, 0) + (terms - coalesce(seen, 0)) * ({_DISTANCE}), 0L)"
    return every.select("lang", "source", F.lit("pair").alias("part"), "item", F.expr(value).alias("value"))


def ranked(values: DataFrame) -> DataFrame:
    return values.withColumn("rank", F.expr("cast(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS int)"))


def audit_sql(least: int = 10, top: int = 10) -> str:
    """The same in DuckDB SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    share = "1 + (CAST(1000000000 AS HUGEINT) * ({n} + 2)) // ({total} + 2 * v)"
    return rf"""WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
unnest(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
grp AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
kept AS (SELECT lang, term FROM d GROUP BY ALL HAVING count(DISTINCT row) >= {least}),
v AS (SELECT g.lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM grp) g LEFT JOIN kept k USING (lang) GROUP BY g.lang),
c AS (SELECT lang, source, term, count(*) AS n FROM d SEMI JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, v.v FROM grp g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
own AS (SELECT lang, source, term, n, v, {share.format(n="n", total="sum(n) OVER (PARTITION BY lang, source)")} AS p FROM dense),
alls AS (SELECT lang, term, sum(n) AS n, any_value(v) AS v FROM dense GROUP BY lang, term),
q AS (SELECT lang, term, {share.format(n="n", total="sum(n) OVER (PARTITION BY lang)")} AS q FROM alls),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM own a JOIN own b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM own JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= {top}"""

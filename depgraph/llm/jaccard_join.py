"""Operator 9, n-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

1. Each document becomes the set of its n-grams' hashes and one fingerprint of that set. One row of each fingerprint
   goes on, so copies are neither counted nor paired with one another.
2. Slices of the input tell which n-grams are frequent within them; those whose sums pass a limit are frequent n-grams,
   with a rank of their own, and skip the counting. The limit grows with the number of slices, so there are never more
   of them than a slice has n-grams, and every other n-gram occurs in a bounded number of sets.
3. The other hashes are dealt out by range in packed arrays, each range counts in how many sets its n-grams occur, and
   only n-grams that occur in more than one set go back to their sets. What does not come back occurs once.
4. Each set orders its n-grams rarest first and posts its prefix, as long as the threshold needs. N-grams that
   occur once come first, so a set with enough of them posts nothing.
5. Sets that share a posted n-gram are candidates if the positional filter (which holds the length filter) lets
   them. The first round pairs each posting list with its most central set only; the second pairs what is in
   different components still, long lists in blocks, so a large group of near copies isn't paired with itself, and no
   link that could join components is left out. Each pair is verified once, by the suffix filter and then the overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depgraph.llm.common import SPACE, Words, by_bytes, discard, give_back, has_rows, mix, new_key, recorded, small_batches, windows, written
from depgraph.llm.components import components

#: Hash bits that go into counts and overlaps, and n-grams that one range counts at once, on average.
BITS, RANGE = 56, 2_000_000
#: Bytes of a slice of texts; sets of a slice from which on an n-gram is reported; the least limit of a frequent one.
SLICE, OFTEN, FREQUENT = 4 << 20, 8, 1_000
#: Sets of one block of a posting list in the second round.
POSTED = 4_096


def ngram_sets(texts: pa.Array, n: int, key: bytes = b"") -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; of fewer words the whole sequence; empty without words."""
    words = Words(texts, SPACE, lower=True, key=key)
    grams = windows(words.hashes, n)
    for a, b in words.each():
        if b - a >= n:
            one = np.sort(grams[a : b - n + 1])
            yield one[np.r_[True, one[1:] != one[:-1]]]
        else:
            yield windows(words.hashes[a:b], b - a) if b > a else np.empty(0, np.uint64)


def fingerprint(grams: np.ndarray) -> int:
    """64 bits of a set, signed. Two given sets agree by chance with probability 2**-64."""
    with np.errstate(over="ignore"):
        total = mix(grams * np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64) + np.uint64(len(grams))
    return int(mix(np.array([total]))[0].astype(np.int64))


_CUT = np.uint64(64 - BITS)
SETS = "doc_id long, set_id long, n_shingles long, gram long, times long"


def _identified(n: int, key: bytes = b""):
    """A row for each text, one for each n-gram that is frequent within a slice, and one (without either) for the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, 1, SLICE):
                sets = list(ngram_sets(batch.column(1), n, key))
                keys = [fingerprint(s) if len(s) else None for s in sets]
                found = np.sort(np.concatenate([*dict(zip(keys, sets, strict=True)).values(), np.empty(0, np.uint64)])) >> _CUT
                cuts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else np.empty(0, np.int64)
                times = np.diff(np.append(cuts, len(found)))
                often = times >= OFTEN
                grams, times = found[cuts[often]].astype(np.int64), times[often]
                rest = len(grams) + 1
                columns = {"doc_id": batch.column(0).to_pylist() + [None] * rest, "set_id": keys + [None] * rest, "n_shingles": [len(s) for s in sets] + [None] * rest}
                columns |= {"gram": [None] * len(sets) + grams.tolist() + [None], "times": [None] * len(sets) + times.tolist() + [1]}
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in columns.items()})
        give_back()

    return run


def frequent(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """N-grams (sorted) that many slices found frequent, and ranks of their frequency.

    With S slices and the limit T, at least OFTEN * S, an n-gram that isn't among them occurs in less than T + OFTEN * S sets, and
    there are at most 1 / OFTEN of a slice's n-grams of them: some 90,000 at any size of the input.
    """
    slices = found.where("times IS NOT NULL AND gram IS NULL").count()
    sums = found.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("times").alias("times"))
    table = sums.where(F.col("times") >= max(FREQUENT, OFTEN * slices)).toPandas()
    grams = table["gram"].to_numpy(np.int64).astype(np.uint64)
    order = np.argsort(grams)
    return grams[order], _ranks(table["times"].to_numpy(np.int64)[order])


def _ranks(times: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.floor(8 * np.log2(np.maximum(times, 1)))).astype(np.uint8)


def _alone(n: int, key: bytes = b""):
    """set_id and text of each set of a slice, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, 0, SLICE):
                first: dict[int, int] = {}
                for i, grams in enumerate(ngram_sets(batch.column(0), n, key)):
                    if len(grams):
                        first.setdefault(fingerprint(grams), i)
                yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), batch.column(0).take(pa.array(first.values(), pa.int64()))], names=["set_id", "text"])
        give_back()

    return run


_PACKED = pa.schema([("part", pa.int32()), ("sets", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary()), ("ranks", pa.binary())])
PACKED = "part int, sets binary, counts binary, keys binary, ranks binary"


def _packed(parts: np.ndarray, sets: np.ndarray, keys: np.ndarray, ranks: np.ndarray | None = None) -> pa.RecordBatch:
    """One row for each part. All three are given for each key; keys of one set within a part stand together."""
    order = np.argsort(parts, kind="stable")
    parts, sets, keys = parts[order], sets[order], keys[order]
    ranks = None if ranks is None else ranks[order]
    cuts = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]]) if len(parts) else np.empty(0, np.int64)
    rows: dict[str, list] = {k: [] for k in _PACKED.names}
    for a, b in zip(cuts, np.append(cuts[1:], len(parts))[: len(cuts)], strict=True):
        own = sets[a:b]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        rows["part"].append(int(parts[a]))
        # counts are bytes, so a set with more keys than that stands there more than once
        times = np.diff(np.append(first, b - a))
        pieces = -(-times // 255)
        counts = np.full(pieces.sum(), 255, np.uint8)
        counts[np.cumsum(pieces) - 1] = times - 255 * (pieces - 1)
        rows["sets"].append(np.repeat(own[first], pieces).tobytes())
        rows["counts"].append(counts.tobytes())
        rows["keys"].append(np.ascontiguousarray(keys[a:b, None].view(np.uint8)[:, : BITS // 8]).tobytes())
        rows["ranks"].append(None if ranks is None else ranks[a:b].tobytes())
    return pa.RecordBatch.from_pydict(rows, _PACKED)


def _gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """owner, keys, ranks of all packed rows."""
    join = lambda name: b"".join(x for x in table.column(name).to_pylist() if x is not None)
    owner = np.repeat(np.frombuffer(join("sets"), "<i8"), np.frombuffer(join("counts"), np.uint8))
    packed = np.frombuffer(join("keys"), np.uint8).reshape(-1, BITS // 8)
    keys = np.zeros((len(packed), 8), np.uint8)
    keys[:, : BITS // 8] = packed
    return owner, keys.view("<u8").ravel(), np.frombuffer(join("ranks"), np.uint8)


def _dealt(n: int, key: bytes, parts: int, sent):
    """Each set's n-grams: frequent ones, with their ranks, to the part of the set, others to the part of their range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, ranks = sent.value
        for whole in batches:
            for batch in by_bytes(whole, 1, SLICE):
                sets = list(ngram_sets(batch.column(1), n, key))
                keys = np.concatenate([*sets, np.empty(0, np.uint64)]) >> _CUT
                owner = np.repeat(batch.column(0).to_numpy(), [len(s) for s in sets])
                at = np.minimum(np.searchsorted(often, keys), max(len(often) - 1, 0))
                known = often[at] == keys if len(often) else np.zeros(len(keys), bool)
                if known.any():
                    yield _packed((owner[known] % parts).astype(np.int32), owner[known], keys[known], ranks[at[known]])
                if not known.all():
                    keys, owner = keys[~known], owner[~known]
                    yield _packed(((keys >> np.uint64(BITS - 32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32), owner, keys)
        give_back()

    return run


def _counted(parts: int):
    """The n-grams of a range that occur in more than one set, with a rank of their frequency, dealt back by set.

    Frequent n-grams, which are with their sets already, pass through.
    """

    def run(table: pa.Table) -> pa.Table:
        passed = table.column("ranks").is_valid()
        owner, keys, _ = _gathered(table.filter(pa.compute.invert(passed)))
        order = np.argsort(keys, kind="stable")
        run_at = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]]) if len(keys) else np.empty(0, np.int64)
        lengths = np.diff(np.append(run_at, len(keys)))
        found = np.empty(len(keys), np.int64)
        found[order] = np.repeat(lengths, lengths)
        again = found > 1
        back = _packed((owner[again] % parts).astype(np.int32), owner[again], keys[again], _ranks(found[again]))
        del owner, keys, order, found
        give_back()
        return pa.concat_tables([table.filter(passed).cast(_PACKED), pa.Table.from_batches([back])])

    return run


_CANDIDATE = pa.schema([("set_id", pa.int64()), ("size", pa.int64()), ("uniq", pa.int64()), ("prefix", pa.list_(pa.int64())), ("shared", pa.binary())])


def _prefixed(num: int, den: int):
    """Of each set that has n-grams in common with others within its prefix: the prefix, rarest first, and all of them."""

    def run(table: pa.Table) -> pa.Table:
        known = table.column("size").is_valid().to_numpy(zero_copy_only=False)
        ids, sizes = (table.filter(pa.array(known)).column(c).to_numpy() for c in ("set_id", "size"))
        owner, keys, ranks = _gathered(table.filter(pa.array(~known)))
        order = np.lexsort((keys, ranks, owner))
        owner, keys = owner[order], keys[order]
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, np.int64)
        lengths = np.diff(np.append(first, len(owner)))
        by_id = np.argsort(ids)
        size = sizes[by_id][np.searchsorted(ids[by_id], owner[first])] if len(first) else np.empty(0, np.int64)
        uniq = size - lengths
        room = size - -(-num * size // den) + 1 - uniq
        on = room > 0
        rows = {"set_id": owner[first][on], "size": size[on], "uniq": uniq[on]}
        spans = list(zip(first[on].tolist(), lengths[on].tolist(), room[on].tolist(), strict=True))
        rows["prefix"] = [keys[a : a + min(m, r)].astype(np.int64) for a, m, r in spans]
        rows["shared"] = [np.sort(keys[a : a + m]).tobytes() for a, m, _ in spans]
        del owner, keys, ranks, order
        give_back()
        return pa.Table.from_pydict(rows, _CANDIDATE)

    return run


def candidates(docs: DataFrame, sets: DataFrame, often: tuple[np.ndarray, np.ndarray], n: int, num: int, den: int, key: bytes) -> DataFrame:
    """set_id, size, uniq (n-grams in no other set), prefix (without those), shared (all others, sorted uint64)."""
    sizes = sets.where("set_id IS NOT NULL").groupBy("set_id").agg(F.first("n_shingles").alias("size"))
    spark = docs.sparkSession
    total = sizes.agg(F.sum("size")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE))
    alone = docs.select("text").mapInArrow(_alone(n, key), "set_id long, text string").groupBy("set_id").agg(F.first("text").alias("text"))
    dealt = alone.mapInArrow(_dealt(n, key, parts, spark.sparkContext.broadcast(often)), PACKED)
    back = dealt.repartitionById(parts, F.col("part")).groupBy("part").applyInArrow(_counted(parts), PACKED)
    sizes = sizes.select(F.expr(f"cast(pmod(set_id, {parts}) as int)").alias("part"), "set_id", "size")
    both = back.unionByName(sizes, allowMissingColumns=True).repartitionById(parts, F.col("part"))
    return both.groupBy("part").applyInArrow(_prefixed(num, den), "set_id long, size long, uniq long, prefix array<long>, shared binary")


def _overlap(a: pa.Array, b: pa.Array, least: pa.Array) -> pa.Array:
    """Common n-grams of two sorted sets, or 0 if the suffix filter shows that there are fewer than ``least``."""
    out = []
    for x, y, need in zip(a, b, least.to_pylist(), strict=True):
        x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
        cuts = np.arange(1, 16, dtype=np.uint64) << np.uint64(BITS - 4)
        in_x, in_y = (np.diff(np.r_[0, np.searchsorted(z, cuts), len(z)]) for z in (x, y))
        if np.minimum(in_x, in_y).sum() < need:
            out.append(0)
            continue
        both = np.concatenate((x, y))
        both.sort(kind="stable")
        out.append(int((both[1:] == both[:-1]).sum()))
    return pa.array(out, pa.int64())


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b: set_id) that reach the threshold."""
    side = lambda x: sets.select(F.col("set_id").alias(x), F.col("size").alias(f"size_{x}"), F.col("shared").alias(f"shared_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    least = F.expr(f"cast(ceil({num} * (size_a + size_b) / {num + den}) as long)")
    scored = both.withColumn("overlap", F.arrow_udf(_overlap, "long")("shared_a", "shared_b", least))
    return scored.where(f"{num + den} * overlap >= {num} * (size_a + size_b)").select("a", "b")


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``.

    Words are what stands between ASCII white space, with A-Z lower-cased. Two documents link when the Jaccard
    similarity of their sets of n-grams is num / den or more; component_id is the smallest doc_id that links reach.
    A text of fewer than n words has its whole sequence as the only n-gram. Null and empty texts have the empty
    set and stand alone, as do rows with a null doc_id and no equals. Rows that repeat a doc_id each get a row.
    Other columns are not looked at. Overlaps compare 56-bit hashes of n-grams that at least two sets share.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    small_batches(docs.sparkSession)
    key = new_key()
    found = written(docs.mapInArrow(_identified(n, key), SETS), "sets")
    sets = found.where("times IS NULL").select("doc_id", "set_id", "n_shingles")
    with recorded() as made:
        labels = _labels(docs, sets, found, n, num, den, key)
        ids = sets.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("first"))
        ids = ids.join(labels, F.col("set_id") == F.col("node"), "left").select("set_id", "first", F.coalesce("label", "set_id").alias("label"))
        ids = written(ids, "first-ids")
    least = ids.groupBy("label").agg(F.min("first").alias("component_id"))
    named = written(ids.join(least, "label").select("set_id", "component_id"), "named")
    discard(*made)
    return sets.join(named, "set_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _labels(docs: DataFrame, sets: DataFrame, found: DataFrame, n: int, num: int, den: int, key: bytes) -> DataFrame:
    """node, label: the component of each set that links to another."""
    known = written(candidates(docs, sets, frequent(found), n, num, den, key), "candidates")
    postings = written(known.select("set_id", "size", "uniq", F.posexplode("prefix").alias("at", "gram")).select("gram", "set_id", "size", (F.col("uniq") + F.col("at")).alias("at"), (F.col("uniq") / F.col("size")).alias("apart")), "postings")
    central = postings.groupBy("gram").agg(F.min(F.struct("apart", "set_id", "size", "at")).alias("c"), F.min("size").alias("low"), F.count("*").alias("n")).where("n > 1")
    central = written(central.select("gram", "low", F.expr(f"cast(n div {POSTED} as int)").alias("last"), *(F.col(f"c.{x}").alias(f"{x}_c") for x in ("set_id", "size", "at"))), "central")

    def feasible(x: str, y: str) -> str:
        """The positional filter, as SQL: what is left from the common n-gram on can reach the overlap needed."""
        return f"{num + den} * least(size{x} - at{x}, size{y} - at{y}) >= {num} * (size{x} + size{y})"

    star = postings.join(central, "gram").where("set_id <> set_id_c").where(feasible("", "_c"))
    links = written(verified(_distinct_pairs(star, "set_id", "set_id_c"), known, num, den), "links")
    labels = components(links)
    rest = _across(postings, central, labels, feasible, num, den)
    more = written(verified(_distinct_pairs(rest, "set_id", "set_id_o"), known, num, den), "links")
    if has_rows(more):
        labels = components(links.unionByName(more))
    return labels


def _distinct_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _across(postings: DataFrame, central: DataFrame, labels: DataFrame, feasible, num: int, den: int) -> DataFrame:
    """Pairs within a posting list whose sets are in different components; at least one not in the central set's."""
    named = postings.join(labels, F.col("set_id") == F.col("node"), "left").withColumn("label", F.coalesce("label", "set_id")).drop("node", "apart")
    home = central.join(labels, F.col("set_id_c") == F.col("node"), "left").select("gram", "low", "last", F.coalesce("label", "set_id_c").alias("home"))
    named = written(named.join(home, "gram"), "named-postings")
    # a set that can't reach even the smallest one of its list has no partner there; it meets the others block by block
    off = named.where(f"label <> home AND {num + den} * (size - at) >= {num} * (size + low)").withColumn("block", F.explode(F.expr("sequence(0, last)")))
    other = named.select("gram", F.expr("cast(pmod(set_id, last + 1) as int)").alias("block"), *(F.col(x).alias(f"{x}_o") for x in ("set_id", "size", "at", "label")))
    pairs = off.join(other, ["gram", "block"]).where("label <> label_o AND (label_o = home OR set_id < set_id_o)")
    return pairs.where(feasible("", "_o"))

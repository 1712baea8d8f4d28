"""Operator 4, substring dedup: a sparse de Bruijn graph of token k-mers, compacted through Spark joins.

1. Of each window of ``length`` words, the k-mer with the least hash (the first of equals) is an anchor, so equal
   windows have equal anchors, and one word in a dozen is one. Anchors are the graph's nodes; its edges are the
   exact words from one anchor to the next.
2. Anchors are counted, with their next and previous edges, summed up for each document before the shuffle.
   An edge is solid if every occurrence of the anchor before it goes on with it and every occurrence of the anchor
   after it comes by it. Joining solid edges with one another, twice as far each round, compacts every nonbranching
   path to its first anchor: each repeated anchor then has a path and a place on it. Where a path's anchors repeat, all
   of it repeats word by word.
3. Paths and places are joined back to the source coordinates. Windows within consecutive places of a repeated path are
   known by then. The other windows whose anchor repeats, around branches and ends, are verified at their coordinates:
   128-bit digests of their very words are counted the same way.
4. Words covered by repeated windows are removed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depgraph.llm.common import SPACE, Words, by_bytes, discard, has_rows, joined, mix, new_key, small_batches, windows, written

#: Words of an anchor.
ANCHOR = 12
OCCURRENCES = "gram long, row_id long, n long, after long, before long"


def _first_least(h: np.ndarray, w: int) -> np.ndarray:
    """Index of the least of each w consecutive values, the first of equals."""
    if len(h) < w:
        return np.empty(0, np.int64)
    best, span = np.arange(len(h)), 1
    while span < w:
        step = min(span, w - span)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(h[b] < h[a], b, a)
        span += step
    return best


class Anchored:
    """The anchors of a run of texts. Positions are word numbers within the run."""

    def __init__(self, texts: pa.Array, length: int, key: bytes = b""):
        self.words = Words(texts, SPACE, key=key)
        self.length = length
        self.grams = windows(self.words.hashes, ANCHOR)
        least = _first_least(self.grams, length - ANCHOR + 1)
        ends = np.cumsum(self.words.counts)
        own = np.maximum(self.words.counts - length + 1, 0)
        #: For each window of one text: its first word, its text, its anchor.
        self.text = np.repeat(np.arange(len(own)), own)
        self.first = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(ends - self.words.counts, own)
        self.anchor_of = least[self.first] if len(self.first) else np.empty(0, np.int64)
        new = np.r_[True, self.anchor_of[1:] != self.anchor_of[:-1]] if len(self.first) else np.empty(0, bool)
        self.at, self.owner = self.anchor_of[new], self.text[new]
        self.gram = self.grams[self.at].astype(np.int64)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor but the last of the run: the hash of the words up to the next, and if that is the same text's."""
        h = self.words.hashes
        same = self.owner[1:] == self.owner[:-1]
        size = np.where(same, self.at[1:] - self.at[:-1], 0) + ANCHOR
        edge = size.astype(np.uint64)
        for j in range(self.length):  # no anchor is further from the next than a window is long
            on = j < size
            if not on.any():
                break
            edge[on] = joined(edge[on], h[self.at[:-1][on] + j])
        return mix(edge).astype(np.int64), same


def _occurrences(length: int, key: bytes):
    """One row for each anchor of a row: how often it is there, and its next and previous edge if always the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, 1):
                a = Anchored(batch.column(1), length, key)
                if not len(a.at):
                    continue
                edge, same = a.edges()
                after, before = np.r_[edge, 0], np.r_[0, edge]
                has_after, has_before = np.r_[same, False], np.r_[False, same]
                order = np.lexsort((a.gram, a.owner))
                gram, owner = a.gram[order], a.owner[order]
                cut = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])])
                columns = [gram[cut], batch.column(0).to_numpy(zero_copy_only=False)[owner[cut]], np.diff(np.r_[cut, len(gram)])]
                out = [pa.array(c, pa.int64()) for c in columns]
                for values, there in ((after, has_after), (before, has_before)):
                    v, t = values[order], there[order]
                    always = np.logical_and.reduceat(t, cut) & (np.minimum.reduceat(v, cut) == np.maximum.reduceat(v, cut))
                    out.append(pa.array(v[cut], mask=~always))
                yield pa.RecordBatch.from_arrays(out, names=["gram", "row_id", "n", "after", "before"])

    return run


def _covered(n: int, first: np.ndarray, length: int) -> np.ndarray:
    """Flags of the n words that windows starting at ``first`` cover."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, first + length, -1)
    return np.cumsum(steps[:n]) > 0


def _digests(words: Words, lo: int, hi: int, firsts: list[int], length: int) -> list[bytes]:
    """A digest of the exact words of each window of the text of words lo to hi - 1; firsts count from lo."""
    data = words.data
    own = [data[s:e].tobytes() for s, e in zip(words.starts[lo:hi].tolist(), words.ends[lo:hi].tolist(), strict=True)]
    return [hashlib.blake2b(b" ".join(own[i : i + length]), digest_size=16).digest() for i in firsts]


JUDGED = "doc_id long, n_words long, n_removed long, kept string, text string, known binary, row_id long, firsts array<int>, pending array<binary>, times array<long>"
_JUDGED = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("text", pa.string()), ("known", pa.binary()), ("row_id", pa.int64())]
    + [("firsts", pa.list_(pa.int32())), ("pending", pa.list_(pa.binary())), ("times", pa.list_(pa.int64()))]
)


def _kept(words: Words, a: int, b: int, gone: np.ndarray) -> str:
    data = words.data
    starts, ends = words.starts[a:b][~gone], words.ends[a:b][~gone]
    return b" ".join([data[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]).decode()


def _judged(length: int, key: bytes):
    """Rows without windows to verify are finished; of the others the windows known to repeat and those to verify."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, 1):
                a = Anchored(batch.column(1), length, key)
                twice_at, head, place = np.zeros(len(a.at), bool), np.zeros(len(a.at), np.int64), np.zeros(len(a.at), np.int64)
                lists = batch.column(3)
                for t in np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False)):
                    lo, hi = np.searchsorted(a.owner, (t, t + 1))
                    grams, heads, places = (lists[int(t)].values.field(c).to_numpy() for c in ("gram", "head", "place"))
                    order = np.argsort(grams)
                    found = np.minimum(np.searchsorted(grams, a.gram[lo:hi], sorter=order), len(grams) - 1)
                    found = order[found]
                    twice_at[lo:hi], head[lo:hi], place[lo:hi] = grams[found] == a.gram[lo:hi], heads[found], places[found]
                on = (a.owner[1:] == a.owner[:-1]) & twice_at[1:] & twice_at[:-1] & (head[1:] == head[:-1]) & (place[1:] == place[:-1] + 1)
                solid = np.r_[on, False][: len(a.at)]
                number = np.cumsum(np.r_[0, ~solid[:-1]]) if len(solid) else np.empty(0, np.int64)
                heads = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(number) else np.empty(0, np.int64)
                tails = np.r_[heads[1:] - 1, len(number) - 1] if len(number) else heads
                # windows: on which path their anchor is, and whether they lie within it
                which = np.cumsum(np.r_[0, a.anchor_of[1:] != a.anchor_of[:-1]]) if len(a.first) else np.empty(0, np.int64)
                path = number[which] if len(which) else which
                twice = twice_at[which]
                within = twice & (a.first >= a.at[heads[path]]) & (a.first + length <= a.at[tails[path]] + ANCHOR)
                verify = twice & ~within
                rows = {k: [] for k in _JUDGED.names}
                bounds = np.searchsorted(a.text, np.arange(len(batch) + 1))
                ids, row_ids = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                for t, (lo, hi) in enumerate(a.words.each()):
                    w = slice(bounds[t], bounds[t + 1])
                    known = a.first[w][within[w]] - lo
                    firsts = a.first[w][verify[w]]
                    rows["doc_id"].append(ids[t])
                    rows["n_words"].append(hi - lo)
                    if len(firsts):
                        times: dict[bytes, int] = {}
                        for d in _digests(a.words, lo, hi, (firsts - lo).tolist(), length):
                            times[d] = times.get(d, 0) + 1
                        rows["text"].append(batch.column(1)[t].as_py())
                        rows["known"].append(np.packbits(_covered(hi - lo, known, length)).tobytes())
                        rows["row_id"].append(row_ids[t])
                        rows["firsts"].append(firsts - lo)
                        rows["pending"].append(list(times))
                        rows["times"].append(list(times.values()))
                        rows["n_removed"].append(None)
                        rows["kept"].append(None)
                    else:
                        gone = _covered(hi - lo, known, length)
                        for k in ("text", "known", "row_id", "firsts", "pending", "times"):
                            rows[k].append(None)
                        rows["n_removed"].append(int(gone.sum()))
                        rows["kept"].append(_kept(a.words, lo, hi, gone))
                yield pa.RecordBatch.from_pydict(rows, _JUDGED)

    return run


def _finished(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, 1):
                words = Words(batch.column(1), SPACE)
                rows = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept")}
                for t, (lo, hi) in enumerate(words.each()):
                    gone = np.unpackbits(np.frombuffer(batch.column(2)[t].as_buffer(), np.uint8), count=hi - lo).astype(bool)
                    if batch.column(4)[t].is_valid:
                        again, firsts = set(batch.column(4)[t].as_py()), batch.column(3)[t].values.to_numpy()
                        hit = [d in again for d in _digests(words, lo, hi, firsts.tolist(), length)]
                        gone |= _covered(hi - lo, firsts[hit], length)
                    rows["doc_id"].append(batch.column(0)[t].as_py())
                    rows["n_words"].append(hi - lo)
                    rows["n_removed"].append(int(gone.sum()))
                    rows["kept"].append(_kept(words, lo, hi, gone))
                yield pa.RecordBatch.from_pydict(rows, pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))

    return run


def compacted(counted: DataFrame) -> DataFrame:
    """gram, head, place: the first anchor of the nonbranching path that each anchor is on, and its place there.

    counted: gram, and the edges after and before it where all its occurrences have the same one. Each round joins
    what an anchor points back to with what that points back to, so rounds grow with the logarithm of a path's length.
    A text ends, so no path comes back to itself.
    """
    solid = counted.where("before IS NOT NULL").select("gram", F.col("before").alias("edge")).join(counted.where("after IS NOT NULL").select(F.col("gram").alias("back"), F.col("after").alias("edge")), "edge")
    now = counted.select("gram").join(solid.select("gram", "back"), "gram", "left")
    now = written(now.select("gram", F.coalesce("back", "gram").alias("head"), F.when(F.col("back").isNull(), 0).otherwise(1).cast("long").alias("place"), F.col("back").isNull().alias("done")), "paths")
    for _ in range(math.ceil(math.log2(now.count() + 1)) + 1):
        if not has_rows(now.where("NOT done")):
            break
        far = now.select(F.col("gram").alias("head"), F.col("head").alias("first"), F.col("place").alias("more"), F.col("done").alias("ended"))
        on = now.where("NOT done").join(far, "head").select("gram", F.col("first").alias("head"), (F.col("place") + F.col("more")).alias("place"), F.col("ended").alias("done"))
        new = written(now.where("done").unionByName(on), "paths")
        discard(now)
        now = new
    return now.select("gram", "head", "place")


def remove_repeats(docs: DataFrame, length: int = 35, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) of every row of ``docs``.

    Words are what stands between ASCII white space, unchanged. A word is removed if it is covered by a window of
    ``length`` consecutive words of its row that also starts anywhere else in the input, the same row included.
    Windows are compared by paths and 128-bit digests. Null and empty texts have no words, and shorter texts lose none. Rows
    are told apart by doc_id and text: each of several equal rows is another place, and all their windows repeat.
    Null doc_ids are fine. Other columns are not looked at.
    """
    if length <= ANCHOR:
        raise ValueError(f"windows have more than {ANCHOR} words")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(doc_id, text).alias("row_id"))
    small_batches(docs.sparkSession)
    key = new_key()
    seen = written(docs.select("row_id", "text").mapInArrow(_occurrences(length, key), OCCURRENCES), "anchors")
    always = lambda c: F.when((F.min(c) == F.max(c)) & (F.count(c) == F.count(F.lit(1))), F.min(c))
    counted = seen.groupBy("gram").agg(F.sum("n").alias("n"), always("after").alias("after"), always("before").alias("before")).where("n > 1").drop("n")
    paths = compacted(written(counted, "repeated-anchors"))
    # sets, as equal rows have one row_id: each anchor counts once for all of them
    flagged = seen.select("gram", "row_id").join(paths, "gram").groupBy("row_id").agg(F.collect_set(F.struct("gram", "head", "place")).alias("anchors"))
    flagged = written(flagged, "flagged")
    both = docs.join(flagged, "row_id", "left").select("doc_id", "text", "row_id", "anchors")
    judged = written(both.mapInArrow(_judged(length, key), JUDGED), "judged")
    discard(seen, paths, flagged)
    pending = judged.where("row_id IS NOT NULL")
    places = pending.select("row_id", F.explode(F.arrays_zip("pending", "times")).alias("w")).select("row_id", F.col("w.pending").alias("window"), F.col("w.times").alias("n"))
    again = written(places.groupBy("window").agg(F.sum("n").alias("n")).where("n > 1").select("window"), "repeated-windows")
    by_row = places.join(again, "window").groupBy("row_id").agg(F.collect_set("window").alias("windows"))
    rest = pending.join(by_row, "row_id", "left").select("doc_id", "text", "known", "firsts", "windows")
    columns = "doc_id long, n_words long, n_removed long, kept string"
    return judged.where("row_id IS NULL").select("doc_id", "n_words", "n_removed", "kept").unionByName(rest.mapInArrow(_finished(length), columns))

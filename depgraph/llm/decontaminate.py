"""Operator 7, benchmark decontamination: documents are streamed through a generalised suffix automaton of test items.

A window is ``n`` consecutive words of an item; an item of fewer words, but not none, is one window. The automaton
holds every run of words of every item. While a document's words go through it, it tells the longest run that ends
at each word; where that is as long as a window, the window occurs there.

The items are dealt into automata of a bounded number of words, each sent to the executors by itself, so test sets
of any size work: the documents are then read once for each automaton and the hits are put together.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depgraph.llm.common import NOT_ALNUM, Words, by_bytes, give_back, small_batches, unused

#: Words of items in one automaton: about 200 bytes each on an executor.
AUTOMATON_WORDS = 400_000


class Automaton:
    """Generalised suffix automaton over word numbers.

    length: of the longest run of a state. link: its longest suffix that occurs elsewhere too. For a state whose
    runs reach ``n`` words, ``hits`` has the items that contain its last ``n`` words; ``short`` has the lengths and
    items of shorter whole items that end a state's runs, longest first.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], n: int):
        """items: their ids (None: hits words, but has no id to report) and words."""
        self.n = n
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.words = {w: i for i, w in enumerate(dict.fromkeys(w for _, ws in items for w in ws))}
        ends: list[list[int]] = []
        for _, ws in items:
            last, path = 0, []
            for w in ws:
                last = self._add(last, self.words[w])
                path.append(last)
            ends.append(path)
        within: list[set[str | None]] = [set() for _ in self.link]
        whole: list[list[tuple[int, str | None]]] = [[] for _ in self.link]
        for (item, ws), path in zip(items, ends, strict=True):
            if len(ws) < n:
                state = path[-1]
                whole[state].append((len(ws), item))
            for state in path[n - 1 :]:
                within[self._of_length(state, n)].add(item)
        order = sorted(range(len(self.link)), key=self.length.__getitem__)
        #: The items of the window that ends each state's runs, if they are long enough; those of its own and linked short items.
        self.hits: list[tuple[str | None, ...]] = [()] * len(self.link)
        self.short: list[tuple[tuple[int, str | None], ...]] = [()] * len(self.link)
        for state in order[1:]:
            above = self.link[state]
            if self.length[above] >= n:
                self.hits[state] = self.hits[above]
            elif self.length[state] >= n:
                self.hits[state] = tuple(sorted(within[state], key=str))
            self.short[state] = (*sorted(whole[state], key=lambda x: (-x[0], str(x[1]))), *self.short[above])
        self.least = min([n if len(ws) >= n else len(ws) for _, ws in items], default=n)

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, state: int, word: int, to: int) -> int:
        """A copy of ``to`` for the shorter runs that come from ``state`` and its suffixes."""
        copy = self._new(self.length[state] + 1)
        self.next[copy] = dict(self.next[to])
        self.link[copy], self.link[to] = self.link[to], copy
        while state >= 0 and self.next[state].get(word) == to:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _add(self, last: int, word: int) -> int:
        """The state of the run of ``last`` and ``word``."""
        to = self.next[last].get(word)
        if to is not None:
            return to if self.length[to] == self.length[last] + 1 else self._split(last, word, to)
        new, state = self._new(self.length[last] + 1), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state < 0:
            self.link[new] = 0
        else:
            to = self.next[state][word]
            self.link[new] = to if self.length[to] == self.length[state] + 1 else self._split(state, word, to)
        return new

    def _of_length(self, state: int, n: int) -> int:
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def stream(self, words: list[int]) -> Iterator[tuple[int, int, str]]:
        """(end, words, item) of each window that occurs in a run of word numbers."""
        next_, link, length, n = self.next, self.link, self.length, self.n
        state = have = 0
        for i, w in enumerate(words):
            while state and w not in next_[state]:
                state = link[state]
                have = length[state]
            if w in next_[state]:
                state = next_[state][w]
                have += 1
                if have >= n:
                    for item in self.hits[state]:
                        yield i + 1, n, item
                if self.short[state]:
                    for size, item in self.short[state]:
                        if size <= have:
                            yield i + 1, size, item


def _spans(automaton: Automaton, numbers: np.ndarray) -> tuple[list[tuple[int, int]], list[str]]:
    """Word spans of a document that windows hit, and the items they are of. ``numbers``: of its words, -1 for those that
    no item has; runs of these are skipped."""
    there = numbers >= 0
    edges = np.flatnonzero(np.diff(np.r_[False, there, False].astype(np.int8)))
    spans: list[tuple[int, int]] = []
    items: set[str | None] = set()
    for a, b in edges.reshape(-1, 2):
        if b - a < automaton.least:
            continue
        for end, size, item in automaton.stream(numbers[a:b].tolist()):
            items.add(item)
            low, high = int(a) + end - size, int(a) + end
            while spans and spans[-1][1] >= low:
                low = min(low, spans[-1][0])
                high = max(high, spans.pop()[1])
            spans.append((low, high))
    return spans, sorted(items - {None})


def automata(items: DataFrame, n: int, item_id: str, text: str, most: int = AUTOMATON_WORDS) -> Iterator[Automaton]:
    """One for each ``most`` words of items, read through the driver item by item; more than one only for large sets."""
    held, size = [], 0
    for item, t in items.select(F.col(item_id).cast("string").alias("item"), F.col(text)).orderBy("item").toLocalIterator():
        words = Words(pa.array([t], pa.string()), NOT_ALNUM, lower=True).exact().to_pylist()
        if held and size + len(words) > most:
            yield Automaton(held, n)
            held, size = [], 0
        if words:
            held.append((item, words))
            size += len(words)
    if held:
        yield Automaton(held, n)


HITS = "struct<n_words: long, spans: array<struct<low: long, high: long>>, items: array<string>>"


def hit_spans(text, automaton: Automaton, spark) -> object:
    """Column struct: n_words, the hit spans of words (low to high - 1, merged, in order) and the items found."""
    sent = spark.sparkContext.broadcast(pickle.dumps(automaton, protocol=5))

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        made = pickle.loads(sent.value)
        for texts in batches:
            out = []
            for some in by_bytes(pa.RecordBatch.from_arrays([texts], names=["text"]), 0):
                words = Words(some.column(0), NOT_ALNUM, lower=True)
                exact = words.exact()
                numbers = np.array([made.words.get(w, -1) for w in exact.dictionary.to_pylist()] or [-1])[exact.indices.to_numpy()]
                for a, b in words.each():
                    spans, items = _spans(made, numbers[a:b])
                    out.append({"n_words": b - a, "spans": [{"low": x, "high": y} for x, y in spans], "items": items})
            yield pa.array(out, pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))), ("items", pa.list_(pa.string()))]))
        del made
        give_back()

    # called nondeterministic so that a filter on the hits isn't pushed below, where it would find them a second time
    return F.arrow_udf(find, HITS).asNondeterministic()(text)


_MERGE = """aggregate(array_sort({x}), cast(array() as array<struct<low: long, high: long>>), (m, s) ->
  if(size(m) > 0 and s.low <= element_at(m, -1).high,
     concat(slice(m, 1, size(m) - 1), array(named_struct('low', element_at(m, -1).low, 'high', greatest(element_at(m, -1).high, s.high)))),
     concat(m, array(s))))"""


def find_hits(docs: DataFrame, items: DataFrame, n: int = 13, text: str = "text", item_id: str = "item_id", item_text: str = "text", into: str = "contamination") -> DataFrame:
    """Add ``into``: n_words, spans (merged word spans inside any occurrence of a window), items (their ids as strings).

    Words are letters, digits and all characters beyond ASCII, with A-Z lower-cased. Null and empty texts have no
    words; items without words match nothing; those without an id hit words
    but aren't named; items that repeat an id count as one; without items no word is
    hit. Other columns stay, also those of repeated rows; one named like ``into`` is replaced.
    """
    spark, found = docs.sparkSession, []
    small_batches(spark)
    for automaton in automata(items, n, item_id, item_text):
        found.append(hit_spans(F.col(text), automaton, spark))
    if not found:
        found = [hit_spans(F.col(text), Automaton([], n), spark)]
    if len(found) == 1:
        return docs.withColumn(into, found[0])
    parts = unused(docs, *(f"part{i}" for i in range(len(found))))
    wide = docs.withColumns(dict(zip(parts, found, strict=True)))
    spans = F.expr(_MERGE.format(x="concat(" + ", ".join(f"{p}.spans" for p in parts) + ")"))
    merged = F.struct(F.col(f"{parts[0]}.n_words").alias("n_words"), spans.alias("spans"), F.array_sort(F.array_distinct(F.concat(*(F.col(f"{p}.items") for p in parts)))).alias("items"))
    return wide.withColumn(into, merged).drop(*parts)


def without_spans(text, spans):
    """Column: the text without the words of the spans (those of ``find_hits``) and the white space after them."""

    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, found in batches:
            out = []
            for one, own in zip(texts, found.to_pylist(), strict=True):
                if not own:
                    out.append(one.as_py())
                    continue
                words = Words(pa.array([one.as_py()], pa.string()), NOT_ALNUM, lower=True)
                starts = [*words.starts.tolist(), len(words.data)]
                raw, at, kept = words.data.tobytes(), 0, []
                for s in own:
                    kept.append(raw[at : starts[s["low"]]])
                    at = starts[s["high"]]
                out.append(b"".join([*kept, raw[at:]]).decode())
            yield pa.array(out, pa.string())
        give_back()

    return F.arrow_udf(cut, "string")(text, spans)


def _hit_words(into: str) -> str:
    return f"aggregate({into}.spans, cast(0 as long), (n, s) -> n + s.high - s.low)"


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 13, share: int = 20, text: str = "text") -> DataFrame:
    """Drop the documents that exceed the coverage limit (one word in ``share``) and cut the hit spans out of others.

    All other columns stay as they are in ``docs``, whatever their names; nulls, ties and repeats as in ``find_hits``.
    """
    (into,) = unused(docs, "contamination")
    found = find_hits(docs, items, n, text, into=into)
    kept = found.where(F.expr(f"NOT ({_hit_words(into)} > 0 AND {share} * {_hit_words(into)} >= {into}.n_words)"))
    return kept.withColumn(text, without_spans(F.col(text), F.col(f"{into}.spans"))).select([F.col(f"`{c}`") for c in docs.columns])


def judged(hits: DataFrame, share: int = 20) -> DataFrame:
    """Add n_words, n_hit and contaminated (some word is hit, and at least one in ``share`` is) to what ``find_hits``
    gives; columns so named are replaced."""
    counted = hits.withColumns({"n_words": F.col("contamination.n_words"), "n_hit": F.expr(_hit_words("contamination"))})
    return counted.withColumn("contaminated", F.expr(f"n_hit > 0 AND {share} * n_hit >= n_words"))

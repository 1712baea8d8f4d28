"""Operator 11, personal data by bootstrapped contextual extraction.

1. Four plain forms (e-mail and IP addresses, card and phone numbers) give the seed entities of every text, and looser forms the
   candidates: things that look much like one of them. Either stands in two lexical patterns: the two words before it, and
   the words on both sides.
2. Patterns and the identifiers found in them are the two sides of a graph. Round by round a pattern's confidence for a kind is
   the share of its identifiers that are of that kind, and a candidate's score is the best confidence of the patterns that it
   stands in; candidates of confident patterns count for other patterns in the next round.
3. Candidates that stand in a confident pattern are found; the seeds stay in any case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depgraph.llm.common import by_bytes, discard, give_back, has_rows, small_batches, written

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# Equal to the contract's forms, but with no second look at what can't match; runs of digits can't begin in their middle.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
# Candidates: addresses without a dot or with words for signs, digits in groups, and addresses of the newer form.
_AT = re.compile(r"@| ?[\[({] ?at ?[\])}] ?", re.IGNORECASE)
_HOST = re.compile(r"[A-Za-z0-9-]++(?:(?:\.| ?[\[({] ?dot ?[\])}] ?)[A-Za-z0-9-]++)*+", re.IGNORECASE)
_GROUPS = re.compile(r"(?<![A-Za-z0-9])[+(]{0,2}[0-9](?:[ ().:/-]{0,2}[0-9])++(?![A-Za-z0-9])")
_COLONS = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Za-z:])")
#: Digits of a candidate that may be a phone or a card number, and characters on either side that words are looked for in.
_PHONE_DIGITS, _CARD_DIGITS, _SIDE = (7, 15), (12, 19), 64


def _luhn(digits: str) -> bool:
    twice = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(int(d) if i % 2 == 0 else twice[int(d)] for i, d in enumerate(reversed(digits))) % 10 == 0


def _only(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _addresses(text: str, sign: re.Pattern, host: re.Pattern) -> Iterator[tuple[int, int]]:
    """The longest local part before each sign, after what the address before it took, and the host behind it."""
    done = 0
    for m in sign.finditer(text):
        before = text[done : m.start()]
        start = done + len(before.rstrip(_LOCAL))
        after = host.match(text, m.end())
        if start < m.start() and after:
            yield start, after.end()
            done = after.end()
        else:
            done = max(done, m.end())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, number of the kind, end of each seed entity, in that order."""
    found = [(a, 0, b) for a, b in _addresses(text, re.compile("@"), _DOMAIN)] if "@" in text else []
    if _DIGIT.search(text):
        small = lambda x: len(x := x.lstrip("0")) < 4 and int(x or "0") < 256
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(small, m.groups()))]
        found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 14 <= len(d := _only(m.group())) <= 19 and _luhn(d)]
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_only(m.group())) <= 15]
    return sorted(found)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, list[int]]]:
    """start, end, kinds of what looks like an identifier and overlaps neither a seed nor an earlier candidate."""
    found: list[tuple[int, int, list[int]]] = []
    if "@" in text or "at" in text.lower():
        found += [(a, b, [0]) for a, b in _addresses(text, _AT, _HOST)]
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), [1]) for m in _COLONS.finditer(text)]
        for m in _GROUPS.finditer(text):
            n = len(_only(m.group()))
            kinds = [k for k, (low, high) in ((2, _CARD_DIGITS), (3, _PHONE_DIGITS)) if low <= n <= high]
            if kinds:
                found.append((m.start(), m.end(), kinds))
    kept, spans = [], sorted((a, b) for a, _, b in taken)
    end, at = 0, 0
    for a, b, kinds in sorted(found):
        while at < len(spans) and spans[at][1] <= a:
            at += 1
        if a >= end and not any(x < b and a < y for x, y in spans[at : at + 4]):
            kept.append((a, b, kinds))
            end = b
    return kept


def contexts(text: str, start: int, end: int) -> list[str]:
    """The two patterns that text[start:end] stands in; digits count as 0, letters as small ones."""
    plain = lambda x: _DIGIT.sub("0", x.lower())
    before = ["^", "^", *text[max(0, start - _SIDE) : start].split()]
    after = [*text[end : end + _SIDE].split(), "$"]
    return [plain(f"{before[-2]} {before[-1]} *"), plain(f"{before[-1]} * {after[0]}")]


_SPAN = [("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]
_MARK = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("kinds", pa.list_(pa.int32())), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
_FOUND = pa.struct([("base", pa.list_(pa.struct(_SPAN))), ("marks", pa.list_(_MARK))])
FOUND = "struct<base: array<struct<start: int, kind: int, end: int>>, marks: array<struct<start: int, end: int, seed: boolean, kinds: array<int>, instance: string, patterns: array<string>>>>"


def _marked(text: str) -> dict:
    base = base_spans(text)
    marks = [(a, b, True, [k]) for a, k, b in base] + [(a, b, False, kinds) for a, b, kinds in candidates(text, base)]
    plain = lambda x, kinds: _only(x) if kinds[0] > 1 else x.lower()
    return {
        "base": [{"start": a, "kind": k, "end": b} for a, k, b in base],
        "marks": [{"start": a, "end": b, "seed": s, "kinds": k, "instance": plain(text[a:b], k), "patterns": contexts(text, a, b)} for a, b, s, k in marks],
    }


def _find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        out = []
        for some in by_bytes(pa.RecordBatch.from_arrays([texts], names=["text"]), 0):
            out += [_marked(t or "") for t in some.column(0).to_pylist()]
        yield pa.array(out, _FOUND)
    give_back()


#: Patterns that are sent to all tasks at most; more are joined by a shuffle.
SENT = 100_000


def confident_patterns(marks: DataFrame, limit: float = 0.6, least: int = 3, rounds: int = 4) -> DataFrame:
    """pattern, kind, confidence of the patterns that tell a kind with at least ``limit``.

    marks: seed, kinds, instance, patterns. confidence: the sum of the scores of the pattern's distinct identifiers for that
    kind, by one more than all its identifiers. ``least`` identifiers with a score are needed. Seeds have the score 1, other
    identifiers the best confidence that reached the limit in the round before; after ``rounds`` rounds, or when a round
    changes no score, that is the result.
    """
    edges = marks.select("instance", "seed", F.explode("kinds").alias("kind"), "patterns").select("instance", "seed", "kind", F.explode("patterns").alias("pattern"))
    edges = edges.groupBy("pattern", "instance", "kind").agg(F.max("seed").alias("seed"))
    sizes = edges.groupBy("pattern", "instance").agg(F.lit(1).alias("one")).groupBy("pattern").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    sizes = written(sizes, "pattern-sizes")
    # no pattern of fewer identifiers can ever become confident
    edges = written(edges.join(sizes, "pattern"), "pattern-edges")
    discard(sizes)
    seeds = edges.where("seed").select("instance", "kind", F.lit(1.0).alias("score")).distinct()
    scores = written(seeds, "scores")
    while True:
        rounds -= 1
        held = edges.join(scores, ["instance", "kind"]).groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
        # rounded, as sums of fractions depend on their order
        sure = held.select("pattern", "kind", "n", F.round(F.col("sum") / (F.col("size") + 1), 9).alias("confidence")).where((F.col("n") >= least) & (F.col("confidence") >= limit))
        sure = written(sure.select("pattern", "kind", "confidence"), "patterns")
        if not rounds:
            break
        new = edges.join(_sent(sure), ["pattern", "kind"]).groupBy("instance", "kind").agg(F.max("confidence").alias("score")).unionByName(seeds).groupBy("instance", "kind").agg(F.max("score").alias("score"))
        new = written(new, "scores")
        same = not has_rows(new.exceptAll(scores))
        discard(scores)
        scores = new
        if same:
            break
        discard(sure)
    discard(edges, scores)
    return sure


def _sent(patterns: DataFrame) -> DataFrame:
    return F.broadcast(patterns) if patterns.count() <= SENT else patterns


def find_private(docs: DataFrame, limit: float = 0.6, least: int = 3, rounds: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base, spans of every row: arrays of structs start, kind (its place in KINDS), end, by start and kind.

    Places count code points, and ends are behind. base: the seed entities of each kind, found from left to right without
    overlap within a kind. spans: these and the candidates in confident patterns, each with the kind of which a pattern is surest (of
    equals the first in KINDS); a candidate never overlaps a seed. Null and empty texts have no spans. Rows that repeat an id or
    a text each get a row; identifiers count once for a pattern however often they occur there. Other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    found = docs.select(F.col(doc_id).alias("doc_id"), F.arrow_udf(_find, FOUND)(F.col(text).cast("string")).alias("found"))
    found = written(found.select("doc_id", "found.base", "found.marks", F.monotonically_increasing_id().alias("row")), "private")
    marks = found.select("row", F.explode("marks").alias("m")).select("row", "m.*")
    sure = confident_patterns(marks, limit, least, rounds)
    held = marks.where("NOT seed").select("row", "start", "end", "kinds", F.explode("patterns").alias("pattern")).join(_sent(sure), "pattern").where("array_contains(kinds, kind)")
    best = held.groupBy("row", "start", "end").agg(F.min_by("kind", F.struct(-F.col("confidence"), "kind")).alias("kind"))
    more = best.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    every = F.array_sort(F.concat("base", F.coalesce("more", F.expr("cast(array() AS array<struct<start: int, kind: int, end: int>>)"))))
    return found.join(more, "row", "left").select("doc_id", "base", every.alias("spans"))


def listed(spans) -> object:
    """Column: kind:start:end of each span, comma-joined."""
    kind = lambda k: reduce(lambda c, i: c.when(k == i, KINDS[i]), range(1, len(KINDS)), F.when(k == 0, KINDS[0]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

"""Operator 5, line dedup: a suffix array over line-ID sequences by distributed prefix doubling (DataFrame functions only).

1. A document is the sequence of its lines that are not blank. Of documents with one and the same text the first stands
   for all; each of the others is one later copy as a whole. Lines that occur once end the runs around them, so only
   the others are ranked.
2. Prefix doubling: round k ranks the runs of 2**k lines from each start (fewer where a run ends before). A run's rank
   is that of the pair of ranks of its halves, in the pairs' order, so ranks order suffixes by their first 2**k lines.
   Rounds end when no run of 2**k lines occurs twice; the last ranks order the suffix array.
3. The longest common prefix of neighbours in the suffix array is put together from the rounds: the highest round in
   which both have one rank, and then the same from the first line after that run on.
4. Intervals of the suffix array whose neighbours have at least so many lines in common are repeated runs: an interval goes
   from a place whose prefix is shorter to the next such place. The first suffix of an interval, by doc_id and line, stays;
   the others start later copies, which are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depgraph.llm.common import discard, has_rows, recorded, unused, written

#: A line is blank if nothing is left of it without these characters in front.
_NOT_BLANK = "trim(LEADING ' \\t\\r' FROM {line}) <> ''"


def line_sequences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row_id, t and u (which tell texts apart), own: characters and two hashes of each line that is not blank."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.ltrim(x, F.lit(" \t\r")) != "")
    own = F.transform(lines, lambda x: F.struct(F.length(x).alias("chars"), F.xxhash64(x).alias("h"), F.hash(x).alias("m")))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(doc_id, text).alias("row_id"), F.xxhash64(text).alias("t"), F.hash(text).alias("u"), own.alias("own"))


def _ranked(pairs: DataFrame, least: int, name: str) -> DataFrame:
    """The pairs (h, m) that occur ``least`` times, with their rank in order and how often they occur."""
    found = pairs.groupBy("h", "m").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    ordered = found.repartitionByRange("h", "m").sortWithinPartitions("h", "m")
    return written(ordered.select("h", "m", F.monotonically_increasing_id().alias("rank"), "n"), name)


def suffix_rounds(lines: DataFrame) -> DataFrame:
    """doc_id, row_id, line, chars, ranks, lengths of each start of a repeated line.

    lines: doc_id, row_id, line, chars, h, m. ranks and lengths: of each round, the rank of the run of 2**k lines and its
    lines, fewer if a line that occurs once or the end comes first.
    """
    ranks = _ranked(lines, 2, "line-ranks")
    now = lines.join(ranks, ["h", "m"]).select("doc_id", "row_id", "line", "chars", F.array("rank").alias("ranks"), F.array(F.lit(1)).alias("lengths"))
    # rows equal in doc_id and text have the same row_id and count once
    now = written(now.dropDuplicates(["row_id", "line"]), "line-runs")
    discard(ranks)
    k, held = 0, now
    while has_rows(now):
        k += 1
        half = 2 ** (k - 1)
        ahead = now.select("row_id", (F.col("line") - half).alias("line"), F.element_at("ranks", -1).alias("m"), F.element_at("lengths", -1).alias("beyond"))
        length = F.element_at("lengths", -1)
        pairs = now.join(ahead, ["row_id", "line"], "left").withColumns(
            {"h": F.element_at("ranks", -1), "m": F.coalesce("m", F.lit(-1)), "length": F.when(length == half, half + F.coalesce("beyond", F.lit(0))).otherwise(length)}
        )
        pairs = written(pairs.drop("beyond"), "line-pairs")
        ranks = _ranked(pairs, 1, "line-ranks")
        joined = pairs.join(ranks, ["h", "m"]).withColumns({"ranks": F.concat("ranks", F.array("rank")), "lengths": F.concat("lengths", F.array("length"))})
        new = written(joined.select(*now.columns, (F.col("n") > 1).alias("twice")), "line-runs")
        discard(held, pairs, ranks)
        again = has_rows(new.where(f"twice AND element_at(lengths, -1) = {2**k}"))
        now, held = new.drop("twice"), new
        if not again:
            break
    return now


def common_prefixes(starts: DataFrame) -> DataFrame:
    """doc_id, row_id, line, chars, part, place, other_row, other_line, lcp: each suffix in the order of the suffix array, the one
    in front of it, and how many lines they have in common.

    starts: as ``suffix_rounds`` gives them. place: from 0 without gaps; part: a range of places that one task can hold.
    """
    order = [F.element_at("ranks", -1).alias("last"), "row_id", "line"]
    ordered = starts.select(*order, "doc_id", "chars", "ranks", "lengths").repartitionByRange("last", "row_id", "line").sortWithinPartitions("last", "row_id", "line")
    ordered = written(ordered.withColumn("id", F.monotonically_increasing_id()), "suffix-array")
    # the ids count within partitions; one row a partition tells where each begins
    part, within = F.shiftright("id", 33).alias("part"), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    begins = ordered.groupBy(part).agg(F.count(F.lit(1)).alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("begin"))
    places = ordered.withColumn("part", F.shiftright("id", 33)).join(F.broadcast(begins), "part").select((F.col("begin") + within).alias("place"), "part", "doc_id", "row_id", "line", "chars", "ranks", "lengths")
    other = places.select((F.col("place") + 1).alias("place"), F.col("row_id").alias("other_row"), F.col("line").alias("other_line"), F.col("ranks").alias("other_ranks"))
    # a rank that two suffixes share in a round they share in all rounds before it
    equal = F.size(F.filter(F.arrays_zip(F.col("ranks").alias("a"), F.col("other_ranks").alias("b")), lambda s: s["a"] == s["b"]))
    equal = F.coalesce(F.when(F.col("other_ranks").isNotNull(), F.greatest(equal, F.lit(0))), F.lit(0)).alias("equal")
    keys = ["doc_id", "row_id", "line", "chars", "part", "place", "other_row", "other_line"]
    pairs = places.join(other, "place", "left").select(*keys, F.lit(0).alias("lcp"), equal, "lengths")
    grown = lambda p: p.select(*keys, F.expr("if(equal > 0, lcp + lengths[equal - 1], lcp)").alias("lcp"), (F.col("equal") - 1).alias("round"), F.expr("equal > 1 AND lengths[equal - 1] = shiftleft(1, equal - 1)").alias("open"))
    found = written(grown(pairs), "prefixes")
    done = found.where("NOT open").select(*keys, "lcp")
    while has_rows(found.where("open")):
        here = starts.select("row_id", F.col("line").alias("at"), "ranks", "lengths")
        there = starts.select(F.col("row_id").alias("other_row"), F.col("line").alias("other_at"), F.col("ranks").alias("other_ranks"))
        on = found.where("open").withColumns({"at": F.col("line") + F.col("lcp"), "other_at": F.col("other_line") + F.col("lcp")})
        on = on.join(here, ["row_id", "at"], "left").join(there, ["other_row", "other_at"], "left")
        found = written(grown(on.select(*keys, "lcp", F.least(equal, "round").alias("equal"), "lengths")), "prefixes")
        done = done.unionByName(found.where("NOT open").select(*keys, "lcp"))
    return done


def later_copies(prefixes: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """row_id, line, chars, and a flag for each condition: whether the suffix is a later one in its interval.

    prefixes: as ``common_prefixes`` gives them. conditions: name -> SQL on lcp and chars that holds where a suffix belongs to
    the same interval as the one in front of it. An interval is known by the place at which it begins, the last at which the
    condition fails: within a range of places a running maximum, and one row a range tells what came before. So all of it
    happens within the ranges; of an interval that goes on through several of them, the first suffixes of its parts are compared.
    """
    breaks = {f"{n}_at": F.when(~F.expr(c), F.col("place")) for n, c in conditions.items()}
    suffixes = prefixes.select("doc_id", "row_id", "line", "chars", "part", "place", *(b.alias(n) for n, b in breaks.items()))
    ends = suffixes.groupBy("part").agg(*(F.max(n).alias(n) for n in breaks))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ends = ends.select("part", *(F.max(n).over(earlier).alias(f"{n}_before") for n in breaks))
    past = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    out = suffixes.join(F.broadcast(ends), "part").select("doc_id", "row_id", "line", "chars", "part", *(F.coalesce(F.max(n).over(past), F.col(f"{n}_before")).alias(n) for n in breaks))
    place = "struct(doc_id, row_id, line)"
    # the same ranges: nothing is shuffled for these
    out = out.withColumns({f"{n}_first": F.expr(f"min({place}) OVER (PARTITION BY part, {n}_at)") for n in conditions})
    out = written(out, "intervals")
    for name in conditions:
        at = f"{name}_at"
        # at most one for each range
        through = F.broadcast(ends.select(F.col(f"{at}_before").alias(at)).where(f"{at} IS NOT NULL").distinct())
        whole = F.broadcast(out.join(through, at).groupBy(at).agg(F.min(f"{name}_first").alias("first")))
        out = out.join(whole, at, "left").withColumn(name, F.expr(f"{place} > least(first, {name}_first)")).drop("first")
    return out.select("row_id", "line", "chars", *conditions)


def _gone_lines(docs: DataFrame, min_lines: int, min_chars: int, doc_id: str, text: str) -> DataFrame:
    """row_id, gone (the lines to delete), longest, of rows that have either."""
    # filtered once written, as Spark would make the sequences twice otherwise
    whole = written(line_sequences(docs, doc_id, text), "lines").where("size(own) > 0")
    firsts = whole.groupBy("t", "u").agg(F.min(F.struct("doc_id", "row_id")).alias("f"), F.max("row_id").alias("high"), F.min("row_id").alias("low"))
    firsts = written(firsts.select(F.col("f.row_id").alias("row_id"), (F.col("low") < F.col("high")).alias("copied")), "first-texts")
    own = whole.join(firsts, "row_id", "left")
    lines = own.where("copied IS NOT NULL").select("doc_id", "row_id", F.posexplode("own").alias("line", "s")).select("doc_id", "row_id", "line", "s.chars", "s.h", "s.m")
    starts = suffix_rounds(lines)
    prefixes = common_prefixes(starts)
    later = later_copies(prefixes, {"later_run": f"lcp >= {min_lines}", "later": f"lcp >= 1 AND chars >= {min_chars}"})
    # a short line by itself begins an interval of its own
    cut = later.where("later_run OR later")
    cut = cut.select("row_id", F.explode(F.when(F.col("later_run"), F.sequence("line", F.col("line") + (min_lines - 1))).otherwise(F.array("line"))).alias("at"))
    longest = prefixes.where("lcp > 0").select("row_id", "lcp").unionByName(prefixes.where("lcp > 0").select(F.col("other_row").alias("row_id"), "lcp"))
    every = cut.select("row_id", "at", F.lit(0).alias("lcp")).unionByName(longest.select("row_id", F.lit(None).cast("int").alias("at"), "lcp"))
    by_row = every.groupBy("row_id").agg(F.collect_set("at").alias("gone"), F.max("lcp").alias("lcp"))
    # copies of a whole text: all lines of the later ones, if there are enough of them or each is long enough by itself
    copies = own.where("coalesce(copied, true)").select("row_id", "copied", F.size("own").alias("n"), F.expr(f"filter(sequence(0, size(own) - 1), i -> size(own) >= {min_lines} OR own[i].chars >= {min_chars})").alias("all")).dropDuplicates(["row_id"])
    return by_row.join(copies, "row_id", "full").select(
        "row_id", F.when(F.col("n").isNotNull() & F.col("copied").isNull(), F.col("all")).otherwise(F.coalesce("gone", F.array().cast("array<int>"))).alias("gone"), F.coalesce("n", "lcp").alias("longest")
    )


def dedup_lines(docs: DataFrame, min_lines: int = 2, min_chars: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Delete later copies of repeated runs of lines; the first copy of each, by doc_id and line, stays.

    Deleted is each line in a later copy of a run of at least ``min_lines`` lines, and each line that is by
    itself a later copy and has ``min_chars`` characters or more. Lines are compared by 96 bits of hashes; blank ones
    (spaces, tabs, carriage returns) are no part of runs and stay. All columns stay, whatever their names; ``text``
    holds the lines left, and is null or empty where it was. Added: n_lines (not blank), n_removed, longest_run (lines
    of the longest run in the row that occurs anywhere else too, or 0); columns so named are replaced. Rows equal in
    doc_id and text count as one document and share its result. A null doc_id is the first in order. An empty table
    gives an empty one.
    """
    with recorded() as made:
        result = _gone_lines(docs, min_lines, min_chars, doc_id, text)
    # what is left to do needs this small table only
    result = written(result, "gone-lines")
    discard(*(t for t in made if t is not result))
    key, gone, long, parts, at = unused(docs, "key", "gone", "longest", "parts", "at")
    result = result.toDF(key, gone, long)
    out = docs.withColumn(key, F.xxhash64(doc_id, text)).join(result, key, "left")
    out = out.withColumn(parts, F.split(text, "\n", -1))
    out = out.withColumn(at, F.expr(f"filter(sequence(0, size({parts}) - 1), i -> {_NOT_BLANK.format(line=f'{parts}[i]')})"))
    left = F.expr(f"transform(array_except(sequence(0, size({parts}) - 1), transform({gone}, i -> {at}[i])), i -> {parts}[i])")
    return out.withColumns(
        {
            text: F.when(F.size(gone) > 0, F.array_join(left, "\n")).otherwise(F.col(text)),
            "n_lines": F.when(F.col(at).isNull(), 0).otherwise(F.size(at)).cast("long"),
            "n_removed": F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long"),
            "longest_run": F.coalesce(long, F.lit(0)).cast("long"),
        }
    ).drop(key, gone, long, parts, at)


def dedup_lines_sql(min_chars: int = 40) -> str:
    """The same in DuckDB SQL, for runs of two lines; the longest runs by sorting all suffixes."""
    common = "coalesce(list_position(list_transform(range(1, least(len({a}), len({b})) + 1), lambda k: {a}[k] = {b}[k]), false), least(len({a}), len({b})) + 1) - 1"
    return f"""WITH l0 AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS line, i, x AS name, length(x) AS chars
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
WHERE translate(x, ' ' || chr(9) || chr(13), '') <> ''),
r0 AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id, line) > 1 AS later FROM l0),
l1 AS (SELECT a.doc_id, a.line, a.name AS n1, b.name AS n2 FROM l0 a JOIN l0 b ON a.doc_id = b.doc_id AND b.line = a.line + 1),
r1 AS (SELECT *, row_number() OVER (PARTITION BY n1, n2 ORDER BY doc_id, line) > 1 AS later FROM l1),
gone AS (SELECT doc_id, line FROM r0 WHERE later AND chars >= {min_chars}
UNION SELECT doc_id, line FROM r1 WHERE later UNION SELECT doc_id, line + 1 FROM r1 WHERE later),
numbered AS (SELECT doc_id, line, dense_rank() OVER (ORDER BY name) AS g FROM l0),
sequences AS (SELECT doc_id, list(g ORDER BY line) AS s FROM numbered GROUP BY doc_id),
suffixes AS (SELECT doc_id, s[i:] AS suffix FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM sequences)),
ordered AS (SELECT doc_id, suffix, coalesce(lag(suffix) OVER w, []) AS before, coalesce(lead(suffix) OVER w, []) AS after FROM suffixes WINDOW w AS (ORDER BY suffix)),
longest AS (SELECT doc_id, max(greatest(coalesce({common.format(a="suffix", b="before")}, 0), coalesce({common.format(a="suffix", b="after")}, 0))) AS longest_run FROM ordered GROUP BY doc_id),
cut AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
kept AS (SELECT c.doc_id, string_agg(c.x, chr(10) ORDER BY c.i) FILTER (WHERE g.line IS NULL) AS text, count(g.line) AS n_removed, count(l.line) AS n_lines
FROM cut c LEFT JOIN l0 l ON l.doc_id = c.doc_id AND l.i = c.i LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line = l.line GROUP BY c.doc_id)
SELECT d.doc_id, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
CAST(coalesce(s.longest_run, 0) AS BIGINT) AS longest_run, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN longest s USING (doc_id)"""

"""Personal data, whitening, divergence, and the hashes that operators share, against brute force."""

import hashlib
import itertools
import random
import re
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("depgraph.llm")

ODD = [None, "", " ", "a" * 5000, "\x00 x퟿ é ß İ", "same words here", "same words here", "x@y.z " * 400, "日本 語é ABC abc aBc"]


# -- personal data ---------------------------------------------------------------------------------------------------


def luhn(digits):
    return sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(digits[::-1])) % 10 == 0


def plain_spans(t):
    """The contract's four forms by their own expressions."""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m)) <= 15]
    return sorted(found)


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text("ab1.@-+ (9%é", max_size=40), st.text("0123456789.- +()", max_size=60), st.lists(st.sampled_from(["a@b.c", "@", ".", "1.2.3.4", "255", "256", "4111111111111111", "4111 1111-1111 1111", "+1 (555) 123-4567", "+1", " ", "é", "00001", "x"])).map("".join)))
def test_base_spans(text):
    from depgraph.llm.private_data import base_spans, candidates

    spans = base_spans(text)
    assert spans == plain_spans(text)
    found = candidates(text, spans)
    assert all(a < b and kinds for a, b, kinds in found)
    assert not any(a < y and x < b for a, b, _ in found for x, _, y in spans)


def test_base_spans_of_long_runs():
    from depgraph.llm.private_data import base_spans, candidates

    for text in ("a" * 200_000, "1" * 200_000, "a." * 100_000 + "@", "1." * 100_000, "+1" + " " * 200_000, "1:" * 100_000, "@a" * 100_000, "(at)" * 50_000):
        assert len(candidates(text, base_spans(text))) < 50_001


def private_corpus():
    """Phones behind "call me at"; some without a plus, which only the context tells from part numbers."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    texts = [f"{word()} Call me at +1 555 {i:03} 01{i:02} {word()} {word()}" for i in range(10, 30)]
    texts += [f"{word()} call me at 555 {i:03} 77{i:02} {word()}" for i in range(10, 14)]
    texts += [f"{word()} part number 555 {i:03} 88{i:02} {word()}" for i in range(10, 30)]
    texts += [f"{word()} write to {word()}@mail.example.com {word()}" for _ in range(9)] + [f"{word()} write to {word()} (at) mail dot example", "write to nobody@nowhere now"]
    # a second round: these stand beside what the first round finds only
    texts += [f"or dial 555 {i:03} 77{i:02} please" for i in range(10, 14)] + ["or dial 555 990 9999 please"]
    return texts + ODD + ["4111 1111 1111 1111 and ::1 2001:db8:0:0:1:0:0:1 at 10.0.0.1"]


def brute_patterns(marks, limit, least, rounds):
    edges = {}
    for m in marks:
        for p in m["patterns"]:
            for k in m["kinds"]:
                edges[p, m["instance"], k] = edges.get((p, m["instance"], k), False) or m["seed"]
    members = {}
    for p, i, _ in edges:
        members.setdefault(p, set()).add(i)
    seeds = {(i, k): 1.0 for (p, i, k), s in edges.items() if s and len(members[p]) >= least}
    scores, sure = dict(seeds), {}
    for _ in range(rounds):
        held = {}
        for p, i, k in edges:
            if (i, k) in scores and len(members[p]) >= least:
                held.setdefault((p, k), []).append(scores[i, k])
        sure = {(p, k): round(sum(v) / (len(members[p]) + 1), 9) for (p, k), v in held.items() if len(v) >= least}
        sure = {x: c for x, c in sure.items() if c >= limit}
        new = dict(seeds)
        for p, i, k in edges:
            if (p, k) in sure:
                new[i, k] = max(new.get((i, k), 0), sure[p, k])
        if new == scores:
            break
        scores = new
    return sure


def test_private_data(spark):
    from depgraph.llm import private_data as D

    texts = private_corpus()
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, texts[0], "clash"), (3, texts[3], None)], "doc_id long, text string, spans string").repartition(3)
    got = D.find_private(docs).collect()
    assert len(got) == len(texts) + 2
    marks = [m for t in texts for m in D._marked(t or "")["marks"]]
    sure = brute_patterns(marks, 0.6, 3, 4)
    assert {(p, k): c for p, k, c in D.confident_patterns(spark.createDataFrame(marks, "start int, end int, seed boolean, kinds array<int>, instance string, patterns array<string>")).collect()} == pytest.approx(sure)
    by_id = {r.doc_id: r for r in got}
    added = 0
    for i, t in enumerate(texts):
        base = plain_spans(t or "")
        want = set(base)
        for m in D._marked(t or "")["marks"]:
            if not m["seed"]:
                held = [(-sure[p, k], k) for p in m["patterns"] for k in m["kinds"] if (p, k) in sure]
                want |= {(m["start"], min(held)[1], m["end"])} if held else set()
        added += len(want) - len(base)
        assert [tuple(s) for s in by_id[i].base] == base
        assert [tuple(s) for s in by_id[i].spans] == sorted(want), t
    said = {t: [t[s.start : s.end] for s in by_id[i].spans] for i, t in enumerate(texts) if t}
    assert all(len(said[t]) == 1 for t in said if "call me at 555" in t) and not any(said[t] for t in said if "part number" in t)
    assert said["write to nobody@nowhere now"] == ["nobody@nowhere"] and said["or dial 555 990 9999 please"] == ["555 990 9999"] and added >= 10
    assert D.find_private(docs.limit(0)).count() == 0
    one = D.find_private(docs.where("doc_id = 9")).select(D.listed(F.col("spans")).alias("s")).collect()
    assert len(one) == 1


def test_private_data_query(spark, tmp_path):
    from depgraph.llm.private_data import KINDS
    from depgraph.llm.queries import op11_private_data

    texts = private_corpus() + ["a@b.c d@e.f", "1.2.3.4 and 5.6.7.8 and a@b.c", "+1 555 010 9999", "4111 1111 1111 1111 +1 (555) 010-9999", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in enumerate(texts):
        base = plain_spans(t or "")
        listed = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base)
        want.append((i, *(sum(k == own for _, own, _ in base) for k in range(4)), hashlib.sha256(listed.encode()).hexdigest()))
    got = op11_private_data(spark, str(tmp_path)).select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256")
    assert got.dtypes[1:5] == [(f"n_{k}", "bigint") for k in KINDS]
    assert sorted(map(tuple, got.collect())) == want


# -- whitening -------------------------------------------------------------------------------------------------------


def brute_whitening(rows, weights):
    """x of each row, n, sums, components and eigenvalues over the fit list."""
    x = {i: np.floor(1024 * np.array(v, float)).astype(int) + 100000 for i, v in rows}
    fit = list({tuple(v): v for v in x.values()}.values()) if weights == "one" else list(x.values())
    fit = np.array(fit)
    values, vectors = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    return x, len(fit), [int(s) for s in fit.sum(axis=0)], values[::-1], vectors[:, ::-1]


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_whitening(spark, weights):
    from depgraph.llm.whitening import whiten

    rng = np.random.default_rng(3)
    base = [[float(v) for v in rng.normal(size=10) * np.arange(1, 11)] for _ in range(60)]
    good = [(i, base[i % 60] if i < 90 else base[0]) for i in range(150)]
    bad = [(200, None), (201, [None] + base[0][1:]), (202, [float("nan")] + base[0][1:]), (203, [float("-inf")] + base[0][1:]), (204, base[1][:4]), (205, [1e300] + base[0][1:]), (206, [])]
    rows = [(i, v, "clash", 7) for i, v in good + bad]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string, x int").repartition(3)
    got = whiten(df, weights=weights).collect()
    x, n, sums, values, vectors = brute_whitening(good, weights)
    assert len(got) == 8 * len(good) and {r.n for r in got} == {n}
    signs = {}
    for r in got:
        assert int(r.deviation) == sum((n * int(a) - s) ** 2 for a, s in zip(x[r.vec_id], sums, strict=True))
        want = (x[r.vec_id] - np.array(sums) / n) @ vectors[:, r.component - 1] / np.sqrt(values[r.component - 1])
        signs.setdefault(r.component, set()).add(round(float(r.whitened / want), 6))
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9) and 0 <= r.identity_error < 1e-9
    assert all(s in ({1.0}, {-1.0}) for s in signs.values())


def test_whitening_of_odd_tables(spark):
    from depgraph.llm.whitening import whiten

    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whiten(make([])).count() == 0 and whiten(make([(1, [1.0, 2.0])] * 3)).count() == 0 and whiten(make([(1, []), (2, None)])).count() == 0
    got = whiten(make([(None, [1.0, 0.0]), (5, [2.0, 0.0]), (5, [2.0, 0.0])])).collect()
    assert sorted((r.vec_id is None, r.component, r.n) for r in got) == [(False, 1, 3), (False, 1, 3), (True, 1, 3)]
    assert all(r.explained == 1 and r.identity_error < 1e-12 for r in got) and got[0].deviation is not None
    # sums beyond 64 bits
    far = whiten(make([(1, [2.0**50, 1.0]), (2, [0.0, 1.0])])).collect()
    assert {int(r.deviation) for r in far} == {(1 << 60) ** 2}
    far = whiten(make([(1, [2.0**51, 1.0]), (2, [0.0, 1.0])] * 9)).collect()
    assert {r.deviation for r in far} == {None} and all(abs(abs(r.whitened) - 1) < 1e-9 for r in far)


# -- divergence ------------------------------------------------------------------------------------------------------


def brute_audit(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", [x.translate(low) for x in term.findall(text or "")]) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = {}
        for _, _, ws in own:
            for w in set(ws):
                df[w] = df.get(w, 0) + 1
        kept = sorted(w for w, n in df.items() if n >= least)
        share = lambda ds: {w: 1 + int(Fraction(10**9 * (sum(d[2].count(w) for d in ds) + 2), sum(d[2].count(v) for d in ds for v in kept) + 2 * len(kept))) for w in kept}
        apart = lambda p, q: (p - q) * (p - q) // (p + q)
        sources = {s: [d for d in own if d[1] == s] for s in {d[1] for d in own}}
        p, q = {s: share(ds) for s, ds in sources.items()}, share(own)
        for s, ds in sources.items():
            pairs = [(-sum(apart(p[s][w], p[t][w]) for w in kept), t.encode(), t) for t in sources if t != s]
            terms = [(-apart(p[s][w], q[w]), w.encode(), w) for w in kept if p[s][w] > q[w] and any(w in d[2] for d in ds)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)]
    return sorted(out)


def audit_rows():
    rng = random.Random(11)
    long = "é" * 40 + "q" * 30
    vocabulary = ["The", "cat", "CATALOGUE", "catalog", "naïve", "İs", "ß", "𝒳y", "l" * 70, long, "z", "don't x1y"]
    rows = [(" ".join(rng.choices(vocabulary, k=rng.randrange(12))), rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "c", "é", None])) for _ in range(80)]
    rows += [("one two", "fr", "only")] * 3 + [(t, "odd", "o") for t in ODD] + [("x y z", "lone", "s1"), (None, "lone", "s2"), ("", "lone", "s3")]
    return rows + [("same " * 3, "hot", f"h{i}") for i in range(7)]


@pytest.mark.parametrize("blocks", [256, 2])
def test_divergence(spark, monkeypatch, blocks):
    from depgraph.llm import divergence as D

    monkeypatch.setattr(D, "SOURCES", blocks)
    monkeypatch.setattr(D, "TERMS", 8 * blocks)
    rows = audit_rows()
    docs = spark.createDataFrame([(t, a, b, "clash", 1) for t, a, b in rows], "text string, lang string, source string, value string, rank int").repartition(4)
    for least in (10, 2):
        got = D.audit(docs, least=least, top=3)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, got.collect())) == brute_audit(rows, least, 3)


def test_divergence_sql(spark):
    from depgraph.llm import divergence as D

    rows = audit_rows()
    duck = duckdb.connect()
    duck.sql("CREATE TABLE documents (text VARCHAR, lang VARCHAR, source VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    assert sorted(duck.sql(f"SELECT lang, source, part, item, value, rank FROM ({D.audit_sql(5, 2)})").fetchall()) == brute_audit(rows, 5, 2)
    assert D.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_prefix_refinement_discards(spark, monkeypatch):
    """Terms of rare prefixes are gone after the first level; where every bit is set, nothing more is kept."""
    from depgraph.llm import divergence as D

    rows = [("common commons rare" + chr(97 + i) * 9, "en", "s") for i in range(20)]
    slices = spark.createDataFrame(rows, "text string, lang string, source string").mapInArrow(D._sliced, D.SLICED)
    first = slices.mapInArrow(D._level(4, None, None), "lang string, prefix binary, docs long").groupBy("prefix").agg(F.sum("docs").alias("n"))
    assert {bytes(r.prefix): r.n for r in first.collect()} == {b"comm": 20, b"rare": 20}
    assert {r.term for r in D.kept_terms(slices, 20)[0].collect()} == {"common", "commons"}
    monkeypatch.setattr(D, "_bitmap", lambda found, length: np.full((1 << D.BITS) // 64, -1, np.int64).view(np.uint64))
    assert {r.term for r in D.kept_terms(slices, 20)[0].collect()} == {"common", "commons"}


def test_complete_terms_that_share_a_bit_are_kept_once(spark, monkeypatch):
    from depgraph.llm import divergence as D

    # of terms complete at the first level and prefixes that go on, two with the same bit
    letters = "abcdefghijklmnopqrst"
    short, long = ([x + "".join(y) for x in letters for y in itertools.product(letters, repeat=n)] for n in (2, 3))
    slots = lambda xs, end: D._slots(["en"], np.zeros(len(xs), np.int64), pa.array([x.encode() + end for x in xs], pa.binary()), np.arange(len(xs)), 4).tolist()
    by_slot = dict(zip(slots(long, b""), long, strict=True))
    whole, begin = next((x, by_slot[s]) for x, s in zip(short, slots(short, D.END), strict=True) if s in by_slot)
    rows = [(f"{whole} {begin}ning other {whole}" if i % 3 else f"{begin}ning {whole} z", "en", f"s{i % 4}") for i in range(24)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    want = brute_audit(rows, 10, 10)
    slices = docs.mapInArrow(D._sliced, D.SLICED)
    assert sorted(r.term for r in D.kept_terms(slices, 10)[0].collect()) == sorted([whole, f"{begin}ning", "other"])
    assert sorted(map(tuple, D.audit(docs).collect())) == want
    monkeypatch.setattr(D, "_bitmap", lambda found, length: np.full((1 << D.BITS) // 64, -1, np.int64).view(np.uint64))
    assert sorted(map(tuple, D.audit(docs).collect())) == want


def test_slices_are_sent_in_small_batches(spark):
    """A batch of all of a task's slices would be held outside the executor's heap, with as many copies as its buffers grew."""
    from depgraph.llm import divergence as D

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    D.audit(spark.createDataFrame([("one two", "en", "s")], "text string, lang string, source string"))

    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    large = spark.range(0, 12, 1, 1).select(F.expr(f"repeat('x', {D.SLICE})").alias("slice"))
    assert max(r.n for r in large.mapInArrow(rows, "n long").collect()) <= 2


def test_counts_of_pairs():
    from depgraph.llm import divergence as D

    rng = np.random.default_rng(4)
    for minors in (7, D.DENSE):
        major, minor, weights = rng.integers(0, 5, 3_000), rng.integers(0, min(minors, 900), 3_000), rng.integers(1, 9, 3_000)
        for w in (None, weights):
            want = {}
            for a, b, n in zip(major.tolist(), minor.tolist(), (weights * 0 + 1 if w is None else w).tolist(), strict=True):
                want[a, b] = want.get((a, b), 0) + n
            got = D._grouped(major, minor, minors, w)
            assert list(zip(*(x.tolist() for x in got), strict=True)) == [(a, b, n) for (a, b), n in sorted(want.items())]


# -- what operators share --------------------------------------------------------------------------------------------


def _unmix(h):
    """The inverse of the mixing that word hashes once used, by which partners of any 16-byte word could be written down."""
    whole = (1 << 64) - 1
    h ^= h >> 32
    h = h * pow(0xD6E8FEB86659FD93, -1, 1 << 64) & whole
    for s in (29,):
        y = h
        for _ in range(3):
            y = h ^ (y >> s)
        h = y
    h = h * pow(0x9E3779B97F4A7C15, -1, 1 << 64) & whole
    y = h
    for _ in range(3):
        y = h ^ (y >> 31)
    return y


def test_words_never_collide_by_construction():
    import pyarrow as pa

    from depgraph.llm.common import SPACE, Words, mix, new_key

    first = lambda w: int(mix(np.array([(16 * 0xA0761D6478BD642F & (1 << 64) - 1) ^ int.from_bytes(w[:8], "little")], np.uint64))[0])
    assert _unmix(int(mix(np.array([12345], np.uint64))[0])) == 12345
    rng = random.Random(1)
    made = []
    while len(made) < 3:
        a, head = (bytes(rng.choices(range(0x21, 0x7F), k=n)) for n in (16, 8))
        tail = (first(a) ^ int.from_bytes(a[8:], "little") ^ first(head)).to_bytes(8, "little")
        if all(0x21 <= c < 0x7F for c in tail):
            made.append((a.decode(), (head + tail).decode()))
    for key in (b"", new_key()):
        h = Words(pa.array([" ".join(x for p in made for x in p)]), SPACE, key=key).hashes
        assert len(set(h.tolist())) == 6
    # short and long words never meet, and all short ones differ
    some = [bytes(rng.choices(range(0x21, 0x7F), k=rng.randrange(1, 12))).decode() for _ in range(3000)]
    h = Words(pa.array([" ".join(some)]), SPACE).hashes
    assert len(set(h.tolist())) == len(set(some))
    assert all((int(x) >> 63 == 1) == (len(w) > 7) for x, w in zip(h, some, strict=True))


def test_windows():
    from depgraph.llm.common import windows

    words = np.random.default_rng(1).integers(0, 50, 400).astype(np.uint64)
    for k in (1, 2, 3, 5, 12, 35, 400):
        h = windows(words, k)
        assert len(h) == 401 - k
        runs = {}
        for i, x in enumerate(h.tolist()):
            assert runs.setdefault(x, tuple(words[i : i + k])) == tuple(words[i : i + k])
        assert len(runs) == len({tuple(words[i : i + k]) for i in range(len(h))})
    assert len(windows(words[:4], 5)) == 0


def test_component_rounds(spark, monkeypatch):
    """A chain whose labels fall from one end to the other once took a round for each link."""
    from depgraph.llm import components as C

    made = []
    real = C.written
    monkeypatch.setattr(C, "written", lambda df, name: made.append(name) or real(df, name))
    n = 200
    chain = [(0, n + 1), *((i + 1, i) for i in range(n, 0, -1)), (500, 501), (502, 501), (7, 7)]
    got = {r.node: r.label for r in C.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(n + 2)} | {500: 500, 501: 500, 502: 500}
    assert made.count("label-links") - 1 <= 3 and made.count("hooks") <= 16


def test_items_without_id_hit_words(spark):
    from depgraph.llm import decontaminate as D

    items = spark.createDataFrame([(None, "secret phrase"), (4, "other words")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a Secret phrase here"), (2, "other words secret phrase")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.contamination["items"]) for r in D.judged(D.find_hits(docs, items)).collect()}
    assert got == {1: (2, []), 2: (4, ["4"])}


def test_entry_needs_no_session():
    """Neither the queries nor their SQL build columns before a session exists."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = "import __spark_entry__ as e; assert {'pipeline', 'op13_divergence', 'tree_lines'} <= set(e.queries()) and 'op5_line_dedup' in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)

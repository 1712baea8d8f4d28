"""The ten operators against the libraries or brute force, on small tables with odd rows."""

import base64
import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

LONG = " ".join(f"w{i % 997} x{i % 13}," for i in range(20_000))
ODD = [
    None, "", " ", "  a", "a  b", "a \n b", "\x00abc \x00abc", "x <|endoftext|> y<|endoftext|>. <|ENDOFTEXT|>", "日本語 テスト  😀 é é", "don't  I'll\t\tgo \r\n x",
    "a" * 3000, " " * 300 + "b", " \x1c x\x1d y", "İ ΣΑΣ ΣΣ. ς", "é, ². Ⅷ. a_. x'S, 12,5.", "same text here", "same text here", LONG,
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, x, "clash", "src") for i, x in enumerate(ODD)] + [(None, "no id", "clash", None), (3, "a repeated id", "clash", "src")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, source string").repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def pairs(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_token_counts(odd, empty):
    from tokenizers import Tokenizer

    from depgraph.llm.token_counts import count_tokens

    path = P.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    got = count_tokens(odd, path)
    assert got.columns.count("n_tokens") == 1
    for r in got.collect():
        n = len(model.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 512)
    assert count_tokens(empty, path).count() == 0
    import sentencepiece

    other = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=other)
    assert all(r.n_tokens == len(sp.encode(r.text or "")) for r in count_tokens(odd, other).collect())


def test_byte_bpe(odd, empty):
    import tiktoken

    from depgraph.llm.byte_bpe import decode, encode, encode_decode

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    model = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = odd.withColumn("ids", encode(F.col("text"), path, P.PATTERN)).withColumn("back", decode(F.col("ids"), path))
    coded = coded.withColumn("both", encode_decode(F.col("text"), path, P.PATTERN))
    for r in coded.collect():
        assert r.both.ids == r.ids and bytes(r.both.decoded) == bytes(r.back)
        assert r.ids == model.encode_ordinary(r.text or "")
        assert bytes(r.back) == (r.text or "").encode()
    assert empty.withColumn("ids", encode(F.col("text"), path, P.PATTERN)).count() == 0


@pytest.mark.parametrize("bits", [False, True])
def test_token_file(spark, odd, empty, bits):
    from tokenizers import Tokenizer

    from depgraph.llm.common import scratch_path
    from depgraph.llm.token_file import read_token_file, write_token_file

    model = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    path = scratch_path(spark, "test")
    write_token_file(odd, path, P.path("word_bpe_49k.json"), end_id=1, bits=bits)
    got = read_token_file(spark, path).withColumn("crc", F.crc32("ids")).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in odd.collect()), key=lambda d: (d is not None, d))
    texts, at = {}, 0
    for r in odd.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    for r in got:
        assert r.start == at
        at += r.n_tokens
        raw = [np.array([*model.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for x in texts[r.doc_id]]
        assert bytes(r.ids) in raw and r.crc == zlib.crc32(r.ids) and r.n_tokens == len(r.ids) // 4
    none = scratch_path(spark, "test")
    write_token_file(empty, none, P.path("word_bpe_49k.json"), end_id=1)
    assert read_token_file(spark, none).count() == 0


def test_token_planes():
    from depgraph.llm.token_file import pack_block, unpack_blocks

    ids = np.random.default_rng(1).integers(0, 2**32, 5001, dtype=np.uint32)
    for bits in (False, True):
        assert (unpack_blocks(pack_block(ids, bits) + pack_block(ids[:7], bits)) == np.r_[ids, ids[:7]]).all()
    assert len(unpack_blocks(b"")) == 0


def words_corpus(seed=3, n=60):
    """Texts with exact and near copies, shared passages and periodic runs."""
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(0, 400)}"
    passage = [word() for _ in range(50)]
    docs = [[word() for _ in range(int(rng.integers(0, 160)))] for _ in range(n)]
    for i in range(0, n, 3):
        base = list(docs[i])
        for _ in range(int(rng.integers(0, 4))):
            if base:
                base[int(rng.integers(0, len(base)))] = word()
        docs.append(base)
    docs += [docs[5], docs[5], ["a"] * 80, ["a"] * 60 + ["b"] * 50, ["p", "q"] * 40]
    for i in range(0, n, 7):
        docs[i] = docs[i][:20] + passage + docs[i][20:]
    return [" ".join(d) for d in docs]


@pytest.fixture(scope="module")
def corpus(spark):
    texts = [*words_corpus(), None, "", "  ", "One two", "one  TWO"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), texts


@pytest.mark.parametrize("limit", [1_000, 1])
def test_jaccard_join(spark, corpus, empty, monkeypatch, limit):
    """With a limit of 1 the n-grams of the shared passage are frequent ones, which skip the counting."""
    from depgraph.llm import jaccard_join as J
    from depgraph.llm.jaccard_join import near_duplicates

    monkeypatch.setattr(J, "FREQUENT", limit)
    docs, texts = corpus
    if limit == 1:
        docs = docs.coalesce(1)
        found = J.frequent(docs.select("doc_id", "text").mapInArrow(J._identified(5), J.SETS))
        assert len(found[0]) > 40 and (np.diff(found[0].astype(float)) > 0).all()
    sets = []
    for x in texts:
        w = (x or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    top = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((top[a], top[b]))
            top = [low if t == high else t for t in top]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == {i: (len(s), top[i]) for i, s in enumerate(sets)}
    assert near_duplicates(empty).count() == 0


@pytest.mark.parametrize("partitions", ["2", "200"])
def test_jaccard_join_without_common_ngrams(spark, partitions):
    from depgraph.llm.jaccard_join import near_duplicates

    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = [(i, " ".join(f"{x}{k}" for k in range(9))) for i, x in enumerate("abc")]
        for some in ([], rows[:1], rows, [*rows, (3, rows[0][1]), (None, rows[1][1]), (4, None)]):
            docs = spark.createDataFrame(some, "doc_id long, text string")
            got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()), key=str)
            first = {t: min(d for d, u in some if u == t and d is not None) for d, t in some if d is not None}
            assert got == sorted(((d, 5 if t else 0, first[t] if t else d) for d, t in some), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_packed_ngrams():
    """Sets of more than 255 n-grams in one part, parts without any, and nothing at all come back as they were."""
    import pyarrow as pa

    from depgraph.llm import jaccard_join as J

    rng = np.random.default_rng(1)
    owner = np.repeat(np.array([7, -3, 9]), [1000, 255, 2])
    keys = rng.integers(0, 1 << J.BITS, len(owner)).astype(np.uint64)
    parts = rng.integers(0, 3, len(owner)) * 2
    ranks = rng.integers(0, 255, len(owner)).astype(np.uint8)
    got = J._gathered(pa.Table.from_batches([J._packed(parts, owner, keys, ranks)]))
    order = np.argsort(parts, kind="stable")
    assert all((a == b[order]).all() for a, b in zip(got, (owner, keys, ranks), strict=True))
    assert all(len(x) == 0 for x in J._gathered(pa.Table.from_batches([J._packed(parts[:0], owner[:0], keys[:0])])))


def test_word_hashes():
    """Words that a polynomial modulo 2**64 can't tell apart (Thue-Morse and its complement), and all cuts of one text."""
    import pyarrow as pa

    from depgraph.llm.common import NOT_ALNUM, SPACE, Words

    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    h = Words(pa.array([f"{a} {b} {a}", None, "", "x"]), SPACE).hashes
    assert h[0] == h[2] != h[1]
    some = [("ab" * 40)[:n] for n in range(1, 81)] + ["é" * n for n in range(1, 50)]
    h = Words(pa.array([" ".join(some), *some]), SPACE).hashes
    assert (h[: len(some)] == h[len(some) :]).all() and len(set(h.tolist())) == len(some)
    assert len(set(Words(pa.array(["AbC,abc", "aBc"]), NOT_ALNUM, lower=True).hashes.tolist())) == 1


def test_jaccard_join_large_group(spark):
    """A group of near copies whose members link through others only."""
    from depgraph.llm.jaccard_join import near_duplicates

    base = [f"b{i}" for i in range(60)]
    texts = []
    for i in range(80):
        own = list(base)
        for j in range(i % 4):
            own[(7 * i + 13 * j) % 60] = f"n{i}_{j}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    top = list(range(80))
    for a, b in combinations(range(80), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((top[a], top[b]))
            top = [low if t == high else t for t in top]
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == dict(enumerate(top))


def test_substring_dedup(corpus, empty):
    from depgraph.llm.substring_dedup import remove_repeats

    docs, texts = corpus
    cut = [(x or "").split() for x in texts]
    count = Counter(tuple(w[i : i + 35]) for w in cut for i in range(len(w) - 34))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in remove_repeats(docs).collect()}
    for d, w in enumerate(cut):
        hit = [False] * len(w)
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                hit[i : i + 35] = [True] * 35
        assert got[d] == (len(w), sum(hit), " ".join(x for x, h in zip(w, hit, strict=True) if not h))
    assert remove_repeats(empty).count() == 0
    twice = docs.where("doc_id = 3").unionByName(docs.where("doc_id = 3"))
    assert {(r.n_words, r.n_removed) for r in remove_repeats(twice).collect()} == {(len(cut[3]), len(cut[3]) if len(cut[3]) >= 35 else 0)}


def test_substring_dedup_equal_rows(spark):
    """Equal rows count each anchor once, and words that a polynomial hash can't tell apart are different words."""
    from depgraph.llm.substring_dedup import remove_repeats

    text = " ".join(f"e{i}" for i in range(60))
    rows = [(1, text)] * 400 + [(None, text), (None, None)]
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(1, 60, 60, "")] * 400 + [(None, 60, 60, ""), (None, 0, 0, "")], key=str)
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    rows = [(1, " ".join([a] + [f"w{i}" for i in range(34)])), (2, " ".join([b] + [f"w{i}" for i in range(34)]))]
    assert [r.n_removed for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0, 0]


def test_compacted_paths(spark):
    """A path of 40 anchors, one that branches, and an anchor by itself."""
    from depgraph.llm.substring_dedup import compacted

    rows = [(i, 1000 + i if i < 39 else None, 999 + i if i else None) for i in range(40)]
    rows += [(100, 2000, None), (101, None, 2000), (102, None, None), (103, 3000, None)]
    got = {r.gram: (r.head, r.place) for r in compacted(spark.createDataFrame(rows, "gram long, after long, before long")).collect()}
    assert got == {i: (0, i) for i in range(40)} | {100: (100, 0), 101: (100, 1), 102: (102, 0), 103: (103, 0)}


ITEMS = [(1, " ".join(f"i{k}" for k in range(30))), (2, "Short, item!"), (3, " ".join(f"i{k}" for k in range(10, 40))), (4, None), (5, "--"), (6, "item short item"), (7, "short item")]


@pytest.mark.parametrize("most", [400_000, 20])
def test_decontamination(spark, empty, monkeypatch, most):
    from depgraph.llm import decontaminate as D

    monkeypatch.setattr(D.automata, "__defaults__", (most,))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    run = [f"I{k}" for k in range(40)]
    texts = [None, "", " ".join(run), " ".join(run[3:16]), " ".join(run[3:15]), "a SHORT-item b", "item short item short item", " ".join(["z"] * 300 + run[:13]), "x " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pattern = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda x: pattern.findall((x or "").encode().lower())
    windows = {}
    for i, x in ITEMS:
        w = words(x)
        for j in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[j : j + 13]), set()).add(i)
    got = {r.doc_id: r for r in D.judged(D.find_hits(docs, items)).collect()}
    for d, x in enumerate(texts):
        w, found = words(x), set()
        hit = [0] * len(w)
        for key, own in windows.items():
            for j in range(len(w) - len(key) + 1):
                if tuple(w[j : j + len(key)]) == key:
                    found |= own
                    hit[j : j + len(key)] = [1] * len(key)
        assert (got[d].n_words, got[d].n_hit, got[d].contamination["items"]) == (len(w), sum(hit), sorted(map(str, found))), x
        assert got[d].contaminated == (sum(hit) > 0 and 20 * sum(hit) >= len(w))
    kept = {r.doc_id: r.text for r in D.decontaminate(docs, items).collect()}
    assert set(kept) == {d for d in got if not got[d].contaminated} and kept[7].split() == ["z"] * 300
    assert D.find_hits(empty, items).count() == 0
    clash = docs.selectExpr("doc_id", "text", "'mine' AS n_words", "1 AS N_hit", "2 AS contaminated", "3 AS contamination", "4 AS part0")
    named = spark.createDataFrame([("b-1", ITEMS[0][1]), ("a", ITEMS[0][1]), ("a", None), (None, "short item")], "item_id string, text string")
    cut = D.decontaminate(clash, named)
    assert cut.columns == clash.columns and {tuple(r)[2:] for r in cut.collect()} == {("mine", 1, 2, 3, 4)}
    found = D.find_hits(clash, named)
    assert found.columns == clash.columns and [r.contamination["items"] for r in found.where("doc_id = 3").collect()] == [["a", "b-1"]]
    assert D.judged(D.find_hits(docs, items.limit(0))).where("n_hit > 0 OR contaminated").count() == 0


def brute_lines(rows, min_lines=2, min_chars=40):
    """Lines deleted of each row: (doc_id, text) in order."""
    cut = {d: [x for x in (t or "").split("\n") if x.strip(" \t\r")] for d, t in rows}
    order = [(d, i) for d in sorted(cut) for i in range(len(cut[d]))]
    gone = set()
    for n in (1, min_lines):
        seen = set()
        for d, i in order:
            run = tuple(cut[d][i : i + n])
            if len(run) == n:
                if run in seen and (n > 1 or len(run[0]) >= min_chars):
                    gone |= {(d, i + j) for j in range(n)}
                seen.add(run)
    longest = dict.fromkeys(cut, 0)
    for (d, i), (e, j) in combinations(order, 2):
        n = 0
        while i + n < len(cut[d]) and j + n < len(cut[e]) and cut[d][i + n] == cut[e][j + n]:
            n += 1
        longest[d], longest[e] = max(longest[d], n), max(longest[e], n)
    return {d: (len(cut[d]), sum((d, i) in gone for i in range(len(cut[d]))), longest[d]) for d in cut}


def test_line_dedup(spark, empty):
    from depgraph.llm.line_dedup import dedup_lines

    rng = np.random.default_rng(5)
    long = "a line of boilerplate that is longer than forty characters"
    pool = ["x", "y", "", "  ", long, "short line"]
    rows = [(i, "\n".join(pool[int(j)] if j < 6 else f"own {i} {j}" for j in rng.integers(0, 9, int(rng.integers(0, 25))))) for i in range(30)]
    rows += [(30, None), (31, ""), (32, "\n\n"), (33, rows[4][1]), (34, rows[4][1] + "\nend"), (41, "alone " * 9), (42, "alone " * 9), (43, "few"), (44, "few")]
    runs = {n: [f"run {n} {k}" for k in range(n)] for n in (3, 5, 7, 13)}
    for i, (a, b) in enumerate(((3, 5), (5, 7), (7, 3), (13, 13), (3, 13))):
        rows.append((50 + i, "\n".join([f"a{i}", *runs[a], "", f"b{i}", *runs[b][: 4 + i], *runs[a][2:]])))
    docs = spark.createDataFrame([(*r, "old", 1, 2) for r in rows], "doc_id long, text string, n_lines string, key int, Gone int").repartition(3)
    found = dedup_lines(docs)
    assert found.columns == ["doc_id", "text", "n_lines", "key", "Gone", "n_removed", "longest_run"]
    got = {r.doc_id: r for r in found.collect()}
    assert {d: (r.n_lines, r.n_removed, r.longest_run) for d, r in got.items()} == brute_lines(rows)
    assert all(r.key == 1 and r.Gone == 2 for r in got.values())
    for least in (1, 3, 4):
        other = {r.doc_id: (r.n_lines, r.n_removed, r.longest_run) for r in dedup_lines(docs, least).collect()}
        assert other == brute_lines(rows, least, 40 if least > 1 else 0)
    assert got[30].text is None and got[31].text == "" and got[32].text == "\n\n"
    assert dedup_lines(empty).count() == 0
    one = spark.createDataFrame([(None, "x\ny\nz"), (1, "x\ny")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in dedup_lines(one).collect()} == {None: "x\ny\nz", 1: ""}


def test_sharding(spark, odd, empty):
    from depgraph.llm.common import scratch_path
    from depgraph.llm.shards import Store

    store = Store(spark, scratch_path(spark, "store"))
    for i in range(3):
        assert store.append(odd, "source") == i + 1
    before = pairs(store.read())
    stale = store.manifest()
    assert store.compact(target=1 << 20) == 4
    after = store.manifest()
    assert len(after["shards"]) < len(stale["shards"]) and sum(s["rows"] for s in after["shards"]) == 3 * odd.count()
    assert pairs(store.read()) == before == pairs(store.read(3))
    with pytest.raises(Exception, match="exist"):  # another writer was first
        store.commit(stale)
    assert store.version() == 4
    writing = f"{store.path}/data/not-committed-yet"
    odd.write.parquet(writing)
    store.vacuum()
    assert pairs(store.read()) == before and pairs(spark.read.parquet(writing)) == pairs(odd)
    with pytest.raises(FileNotFoundError):
        store.read(3)
    assert not store._fs.exists(store._path("data/" + stale["shards"][0]["file"]))
    store.vacuum(grace=-60)
    assert not store._fs.exists(store._path("data/not-committed-yet")) and pairs(store.read()) == before
    assert store.append(empty, "source") == 5 and store.read().count() == 3 * odd.count()
    with pytest.raises(ValueError):
        store.append(odd.drop("source"), "doc_id")
    clash = odd.withColumns({"arrival": F.col("doc_id") * 2, "_arrival": F.lit("mine"), "Arrival_": F.lit("x")})
    named = Store(spark, scratch_path(spark, "store"))
    named.append(clash, "arrival")
    assert pairs(named.read()) == pairs(clash)
    none = Store(spark, scratch_path(spark, "store"))
    none.append(empty, "source")
    assert none.read().count() == 0 and none.compact() == 1


def test_store_with_two_writers(spark, monkeypatch):
    """A writer that loses the race commits on the winner's version; a column with a dot may tell arrivals."""
    from depgraph.llm.common import scratch_path
    from depgraph.llm.shards import Store

    path = scratch_path(spark, "two-writers")
    first, second = Store(spark, path), Store(spark, path)
    rows = lambda *ids: spark.createDataFrame([(i, "x") for i in ids], "`a.id` long, `b.c``d` string").coalesce(1)
    real = first._listed

    def late(*args):
        monkeypatch.setattr(first, "_listed", real)
        second.append(rows(3, 4), arrival="b.c`d")
        return real(*args)

    monkeypatch.setattr(first, "_listed", late)
    assert first.append(rows(1, 2), arrival="a.id") == 2 and second.version() == 2
    assert sorted(r[0] for r in second.read().collect()) == [1, 2, 3, 4]


def test_quality(spark, empty):
    from depgraph.llm.quality import classify

    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(600):
        w = [f"w{rng.integers(0, 200)}" for _ in range(int(rng.integers(5, 80)))]
        kind = i % 6
        if kind == 0:
            w = [x + "###" for x in w]
        if kind == 1:
            w[2] = "nasty"
        rows.append((i, " ".join(w), f"s{i % 7}", "en"))
        if i < 400:
            labels.append((i, int(kind != 0), int(kind == 1)))
    rows += [(600, None, None, None), (601, "", "s1", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in classify(docs, known, F.col("source"), F.col("lang")).collect()}
    assert len(got) == 602
    held_out = [got[i].keep == (i % 6 > 1) for i in range(400, 600)]
    assert np.mean(held_out) > 0.95
    assert all(0 <= r.quality_score <= 1 and 0 <= r.toxic_score <= 1 for r in got.values())
    assert all(r.keep for r in classify(docs, known.limit(0), F.col("source"), F.col("lang")).collect())
    assert classify(docs.limit(0), known, F.col("source"), F.col("lang")).count() == 0


def test_quality_posteriors(spark):
    """Posteriors from the evidence by plain sums: shares of hosts shrunk to the global one, those of paths to their host's."""
    from depgraph.llm import quality as Q

    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        host, path = ("hot", "p0") if i % 3 == 0 else (f"h{rng.integers(0, 6)}", f"p{rng.integers(0, 3)}")
        good = rng.random() < 0.3 + 0.1 * (hash_of := int(host[1:]) if host != "hot" else 4)
        words = [f"w{rng.integers(0, 80)}" + ("" if good else "##") for _ in range(int(rng.integers(3, 30)))]
        rows.append((i, " ".join(words), host if i % 50 else None, path, int(good), hash_of))
    docs = spark.createDataFrame([(*r[:4], "x", 1.5, "y", False) for r in rows], "doc_id long, text string, host string, path string, evidence string, site0 double, _id string, keep boolean")
    docs = docs.unionByName(docs.where("doc_id < 5"))  # repeated rows
    labels = spark.createDataFrame([(r[0], r[4], int(r[0] % 11 == 0)) for r in rows[:200]] + [(7, None, 3), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = Q.classify(docs, labels, F.col("host"), F.col("path"))
    assert out.columns == [*docs.columns, "quality_score", "toxic_score"]
    got = sorted(((r.doc_id, r.host, r.path, r.quality_score, r.toxic_score, r.keep) for r in out.collect()), key=str)
    model = Q.fit(docs, labels, ["quality", "toxic"])
    found = docs.select("doc_id", "host", "path", model.evidence(F.col("text")).alias("e")).collect()

    def pseudo(n, k, within, between):
        if n <= k or k < 2:
            return 10_000.0
        outer = (between - within / (n - k) * (k - 1)) / n
        return min(10_000.0, max(1.0, within / (n - k) / outer)) if outer > 0 else 10_000.0

    scores = []
    for i in range(2):
        p = {}
        for r in found:
            p.setdefault((r.host, r.path), []).append(1 / (1 + np.exp(-(r.e[i] + model.priors[i]))))
        hosts = {}
        for (h, _), v in p.items():
            hosts.setdefault(h, []).extend(v)
        n, share = len(found), sum(map(sum, p.values())) / len(found)
        m = pseudo(n, len(hosts), sum(sum((np.array(v) - np.mean(v)) ** 2) for v in hosts.values()), sum(len(v) * (np.mean(v) - share) ** 2 for v in hosts.values()))
        near = {h: (sum(v) + m * share) / (len(v) + m) for h, v in hosts.items()}
        m = pseudo(n, len(p), sum(sum((np.array(v) - np.mean(v)) ** 2) for v in p.values()), sum(len(v) * (np.mean(v) - np.mean(hosts[k[0]])) ** 2 for k, v in p.items()))
        site = {k: (sum(v) + m * near[k[0]]) / (len(v) + m) for k, v in p.items()}
        scores.append([1 / (1 + np.exp(-(r.e[i] + np.log(site[r.host, r.path] / (1 - site[r.host, r.path]))))) for r in found])
    expected = sorted(((r.doc_id, r.host, r.path, a, b, bool(a >= 0.5 and b < 0.5)) for r, a, b in zip(found, *scores, strict=True)), key=str)
    assert len(got) == len(expected) and all(x[:3] == y[:3] and x[5] == y[5] and np.allclose(x[3:5], y[3:5], rtol=1e-6) for x, y in zip(got, expected, strict=True))


def test_texts_longer_than_a_block(spark):
    """Texts that are cut (words), cut rarely (lines, one blank in between) and not at all (no blank) give the libraries' ids."""
    import tiktoken
    from tokenizers import Tokenizer

    from depgraph.llm.byte_bpe import encode_decode
    from depgraph.llm.pieces import BLOCK, blocks
    from depgraph.llm.token_counts import count_tokens
    from depgraph.llm.token_file import read_token_file, write_token_file
    from depgraph.llm.common import scratch_path

    words = " ".join(f"w{i % 1999},  x{i % 97}" for i in range(150_000))
    texts = [words, "\n".join(f"line{i % 499}" for i in range(160_000)) + " end " + "tail\n" * 9, "日本語テスト" * 9_000]
    assert len(words) > BLOCK and len(list(blocks(words))) > 1 and "".join(blocks(words)) == words
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bpe = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert {r.doc_id: r.n_tokens for r in count_tokens(docs, P.path("byte_bpe_50k.json")).collect()} == {i: len(bpe.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read().splitlines() if x)}
    tik = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = docs.select("doc_id", encode_decode(F.col("text"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).alias("c"))
    for r in coded.collect():
        assert list(r.c.ids) == tik.encode_ordinary(texts[r.doc_id]) and bytes(r.c.decoded) == texts[r.doc_id].encode()
    path = scratch_path(spark, "token-file")
    write_token_file(docs, path, P.path("word_bpe_49k.json"), end_id=1)
    word = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for r in read_token_file(spark, path).collect():
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == [*word.encode(texts[r.doc_id], add_special_tokens=False).ids, 1]


def test_site_shrinkage(spark):
    """A site of one document stays near the global share; one of many follows its own documents."""
    from depgraph.llm.quality import site_priors

    rows = [(f"h{i}", "p", 400, 400 * p, 400 * p * p + 8) for i, p in enumerate([0.2, 0.5, 0.8, 0.9, 0.4])] + [("tiny", "p", 1, 0.01, 0.0001)]
    got = {r.host: 1 / (1 + np.exp(-r.site)) for r in site_priors(spark.createDataFrame(rows, "host string, path string, n long, s0 double, q0 double"), 0.0, 0).collect()}
    assert abs(got["h2"] - 0.8) < 0.1 and got["tiny"] > 0.1


def test_neighbours(spark):
    from depgraph.llm.neighbours import nearest

    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16))
    x[:500] = x[0]  # a third of the rows are one vector
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(1500, None), (1520, [0.0] * 16), (1540, [float("nan")] * 16), (1560, [None] + [1.0] * 15), (1580, [1.0]), (1600, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(vectors, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    scores = x[::20] @ x.T
    found = 0
    for q, s in zip(range(0, 1500, 20), scores, strict=True):
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -np.round(s, 9)))[:20].tolist()
        assert len(got[q]) == 20 and q not in [v for v, _ in got[q]]
        assert all(abs(score - s[v]) < 1e-9 for v, score in got[q])
        found += len(set(best) & {v for v, _ in got[q]})
    assert set(got) == set(range(0, 1500, 20)) and found >= 0.9 * 20 * 75
    assert [v for v, _ in got[0][:20]] == list(range(1, 21)) or got[0][0][1] > scores[0][1]
    few = nearest(vectors.where("vec_id < 3"), F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r.vec_id) for r in sorted(few, key=lambda r: r["rank"])] == [(0, 1), (0, 2)]
    assert nearest(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_visits_all_lists_of_the_ratio(spark, monkeypatch):
    """A ratio that selects every one of 375 lists finds exactly what brute force finds."""
    from depgraph.llm import neighbours as N

    monkeypatch.setattr(N, "LIST", 4)
    x = np.random.default_rng(5).normal(size=(1500, 16))
    vectors = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in N.nearest(vectors, F.col("vec_id") % 20 == 0, near=1e6).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    scores = x[::20] @ x.T
    for q, s in zip(range(0, 1500, 20), scores, strict=True):
        s[q] = -np.inf
        assert got[q] == np.argsort(-s, kind="stable")[:20].tolist()


def test_components(spark):
    from depgraph.llm.components import components

    chain = [(i, i + 1) for i in range(40)] + [(100, 101)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_with_repeated_and_null_ids(spark):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, a), (1, b), (2, b), (None, c), (None, c + " d"), (None, ""), (None, "")]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.keep_one_of_near_copies(spark, docs, "")
    kept = [(r.doc_id, r.text[:1]) for r in got.collect()]
    assert sorted(kept, key=str) == sorted([(1, "a"), (1, "b"), (None, "c"), (None, ""), (None, "")], key=str)


def test_stages_side_by_side(spark):
    """A stage called twice: both results can be read, until a later stage is called on what was written of them."""
    import corpus_pipeline

    text = "a line that many documents share, long enough to count\nand its second line"
    docs = lambda *ids: spark.createDataFrame([(i, f"{text}\nown {i}", "en", "s", 9) for i in ids], "doc_id long, text string, lang string, source string, n_chars long")
    one, two = corpus_pipeline.delete_lines(spark, docs(1, 2), ""), corpus_pipeline.delete_lines(spark, docs(5, 6, 7), "")
    assert {r.doc_id: r.text for r in one.collect()} == {1: f"{text}\nown 1", 2: "own 2"}
    assert {r.doc_id for r in two.where("text LIKE 'own%'").collect()} == {6, 7}


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    """Each stage keeps its columns, and rows with nulls, empty texts and repeated ids, and takes empty tables."""
    import corpus_pipeline as C

    text = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(1, text("a")), (1, text("a")), (None, text("b")), (2, None), (3, ""), (3, " \n"), (4, text("c")), (None, None)]
    docs = spark.createDataFrame([(d, t, None if d == 1 else "en", None, None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {"quality": len(rows), "lines": len(rows), "near_copies": len(rows) - 1, "benchmark": len(rows), "encode": len(rows)}
    for name, stage in C.STAGES:
        out = stage(spark, docs.withColumns({"extra": F.lit(1), "keep": F.lit("mine"), "key": F.lit(2)}), str(tmp_path))
        assert name == "encode" or out.columns == C.COLUMNS, name
        assert out.count() == want[name], name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_pipeline(spark, tmp_path):
    """Stage by stage on a fixture: junk and toxic go, repeated lines go, one near copy stays, test items go."""
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "benchmark", "encode"]
    rng = np.random.default_rng(9)
    text = lambda: " ".join(f"w{rng.integers(0, 500)}" for _ in range(60))
    rows = []
    for i in range(600):
        t = text()
        rows.append((i, " ".join(x + "###" for x in t.split()) if i % 6 == 0 else t + " nasty" if i % 6 == 1 else t))
    item = " ".join(f"q{k}" for k in range(20))
    near = text()
    line = "this boilerplate line stands in several documents, word by word"
    rows += [(600, near), (601, near + " end"), (602, f"{item} and more"), (603, text() + "\n" + line), (604, text() + "\n" + line)]
    spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, int(d % 6 != 0), int(d % 6 == 1)) for d in range(600)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    kept = {d for d in range(600) if d % 6 > 1} | {600, 603, 604}
    assert len(kept ^ set(got)) <= 12 and {600, 603, 604} <= set(got) and not {601, 602} & set(got)
    texts = dict(rows)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[603].decoded_sha256 == digest(texts[603]) and got[604].decoded_sha256 == digest(texts[604].split("\n")[0])

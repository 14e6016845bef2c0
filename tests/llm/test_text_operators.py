"""Shingles, fingerprints, n-gram join, language, mixing and token files against brute force."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm import fingerprint, jaccard_join, language, mixing, rans, shingles, token_file
from spanloom.llm.components import components

ODD = [None, "", " \n\t", "x", "X ", "one two three four", "one two three four five", "One  two\tthree four five", "one two three four five six", "é ö " * 30, "a" * 5000, "日本 語"]


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def near(rng, base, k):
    words = base.split(" ")
    for _ in range(k):
        words[rng.randrange(len(words))] = str(rng.random())
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    out = list(ODD)
    passage = " ".join(word() for _ in range(40))
    for _ in range(6):
        base = " ".join(word() for _ in range(rng.randint(20, 90)))
        out += [base, base] + [near(rng, base, k) for k in (1, 1, 2, 3, 5)]
    out += [f"{passage} {' '.join(word() for _ in range(30))}" for _ in range(12)]
    out += [near(rng, passage, 1) for _ in range(25)]
    return out


def test_shingles_are_the_distinct_grams(texts, monkeypatch):
    for chunk in (64, 1 << 19):
        monkeypatch.setattr(shingles, "CHUNK", chunk)
        sets = shingles.shingle_sets(pa.array(texts))
        assert [len(s) for s in sets] == [len(grams(t)) for t in texts]
        for i in range(0, len(texts), 7):
            for j in range(len(texts)):
                assert len(np.intersect1d(sets[i], sets[j])) == len(grams(texts[i]) & grams(texts[j]))


def brute_components(texts):
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [grams(t) for t in texts]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def test_jaccard_join_matches_brute_force(spark, texts, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PIVOTS", 1)
    monkeypatch.setattr(jaccard_join, "GROWTH", 3)
    monkeypatch.setattr(jaccard_join, "BUCKET_BYTES", 4096)
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect()}
    assert got == {i: (len(grams(t)), c) for i, (t, c) in enumerate(zip(texts, brute_components(texts), strict=True))}


def test_jaccard_join_edges(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard_join.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, 2, 7), (7, 2, 7), (7, 2, 7), (None, 0, None), (3, 0, 3)], key=repr)
    assert jaccard_join.near_duplicates(df.limit(0)).count() == 0


def test_components_in_rounds(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1100)]
    df = spark.createDataFrame(links, "a long, b long").repartition(6)
    one, many = components(df), components(df, local=20)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    assert {r.component for r in one.collect() if r.node >= 1000} == {1000}


def _holds(near, jaccard, compared, a, b):
    """A likeness against the exact sets: equal sets and disjoint ones exactly, others within five deviations."""
    if a == b or not a & b:
        assert near == jaccard == float(a == b)
    elif compared == 0:
        assert near == jaccard == 0
    else:
        exact = len(a & b) / min(len(a), len(b))
        assert abs(near - exact) <= 5 * (max(exact * (1 - exact), 0.02) / compared) ** 0.5 + 1e-9 or compared < 20
        assert 0 <= jaccard <= near <= 1


def test_short_texts_inside_a_long_one():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in rng.integers(0, 30000, 40000)]
    long = fingerprint.sketch(shingles.shingle_sets(pa.array([" ".join(words)]))[0])
    for i in range(37):
        short = fingerprint.sketch(shingles.shingle_sets(pa.array([" ".join(words[1000 * i : 1000 * i + 24])]))[0])
        near, _, compared = fingerprint.likeness(short, long)
        assert near == (1.0 if compared else 0.0)
    assert sum(fingerprint.likeness(fingerprint.sketch(shingles.shingle_sets(pa.array([" ".join(words[1000 * i : 1000 * i + 24])]))[0]), long)[2] > 0 for i in range(37)) >= 34


def test_fingerprints(spark, texts):
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in fingerprint.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert len(got) == len(rows)
    for i, (key, t) in enumerate(rows):
        t, nxt = t or "", rows[i - 1][1] or ""
        n = len(t)
        edited = t[: n - n // 2] + nxt[: n // 2]
        r = got[key]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        a, b = grams(t), grams(edited)
        _holds(r.near_edited, r.jaccard_edited, r.compared_edited, a, b)
        _holds(r.near_next, r.jaccard_next, r.compared_next, a, grams(nxt))
    alike = [r.fingerprint for r in got.values() if grams(rows[r.doc_id // 3][1]) == grams(ODD[6])]
    assert len(set(alike)) == 1
    assert fingerprint.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).count() == 0


def test_sketches_merge():
    a, b = (np.sort(shingles.mix(np.arange(lo, hi, dtype=np.uint64))) for lo, hi in ((0, 4000), (2000, 2600)))
    x, y = fingerprint.sketch(a), fingerprint.sketch(b)
    assert fingerprint.likeness(x, y)[0] > 0.9 and fingerprint.likeness(x, y)[1] < 0.3
    assert fingerprint.likeness(x, y)[2] == min(len(x), len(y)) - 2
    whole, union = fingerprint.merge(x, y), fingerprint.sketch(np.union1d(a, b))
    assert whole[0] == union[0] and (whole[2:] == union[2:]).all() and whole[1] == 0
    assert (fingerprint.decode(fingerprint.encode(x)) == x).all()


def test_language(spark):
    words = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["kvark", "zwolt", "grunk"]}
    rng = random.Random(2)
    make = lambda k: " ".join(rng.choice(words[k]) for _ in range(12))
    train = spark.createDataFrame([(make(k), k) for k in ("aa", "bb") * 10] + [(None, "aa"), ("lorem", None)], "text string, lang string")
    model = language.fit(train)
    rows = [("1", "zwolt kvark"), ("2", "ipsum"), ("3", None), ("4", "12 34 !"), ("5", ""), ("6", "ipsum " * 40000)]
    df = spark.createDataFrame(rows, "score string, text string")
    got = {r.text: (r.lang_pred, r.score) for r in language.identify(df.withColumnRenamed("score", "id"), model).collect()}
    assert got["zwolt kvark"][0] == "bb" and got["ipsum"][0] == "aa" and got["ipsum " * 40000][0] == "aa"
    assert got[None] == got["12 34 !"] == got[""] == ("und", 0.0)
    empty = language.fit(train.limit(0))
    assert empty.predict("lorem") == ("und", 0.0)


def test_language_counts_by_chunks(monkeypatch):
    text = "Der schnelle braune Fuchs, 12 springt über den faulen Hund. " * 20
    whole = language.gram_counts(text)
    monkeypatch.setattr(language, "CHUNK", 17)
    parts = language.gram_counts(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_parts_by_levels(spark):
    """The part of a key among few and many cut points is their number at or below it."""
    from spanloom.llm import ranges

    keys = [None, -5, 0, 1, 2, 3, 5000, 29_997, 29_998, 10**12, *range(100, 400)]
    for cuts in ([], [1], list(range(0, 90, 3)), list(range(0, 30_000, 3))):
        got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", ranges.part_of("k", cuts).alias("p")).collect()
        assert all(r.p == (0 if r.k is None else sum(c <= r.k for c in cuts)) for r in got)


def test_mixing(spark):
    rows = [(i, "w " * (i % 9 + 1), "abcde"[i % 5]) for i in range(4000)] + [(9001, None, "a"), (9002, "x y", None), (9002, "x y", None), (None, "x", "b"), (9003, "", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_counts(df).collect()
    assert len(got) == len(rows)
    total = sum(len((t or "").split()) for _, t, _ in rows)
    targets = {r.source: r["__target"] for r in got}
    sizes = {r.source: r["__source_size"] for r in got}
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    assert all(targets[s] <= 2 * sizes[s] + 1e-9 for s in targets)
    for s in "abcde":
        taken = sum(r["__size"] * r["__copies"] for r in got if r.source == s)
        assert taken == pytest.approx(targets[s], rel=0.01)
    assert {r["__copies"] for r in got} <= {0, 1, 2}
    again = mixing.mix(df)
    assert again.columns == df.columns and again.count() == sum(r["__copies"] for r in got)
    assert mixing.mix(df.limit(0)).count() == 0
    clash = mixing.mix(df.selectExpr("*", "1 AS __size", "2 AS __copies", "3 AS row"))
    assert clash.columns == [*df.columns, "__size", "__copies", "row"] and clash.count() == again.count()


def test_mixing_of_few_documents(spark):
    """Sources of some thirty texts of very different lengths come near their targets."""
    rows = [(i, "w " * (1 + (i * 7919) % 97 + 900 * (i % 11 == 0)), "abcdefgh"[i % 8]) for i in range(250)]
    got = mixing.mix_counts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in "abcdefgh":
        mine = [r for r in got if r.source == s]
        taken, largest = sum(r["__size"] * r["__copies"] for r in mine), max(r["__size"] for r in mine)
        assert abs(taken - mine[0]["__target"]) <= largest / 2


@pytest.mark.parametrize("n", [0, 1, 63, 64, 1000, 70000])
def test_rans_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.3, n).clip(0, 49000).astype(np.uint32)
    table = rans.Table(np.bincount(ids, minlength=49408))
    block = rans.encode(ids, table, interval=1 << 12)
    assert (rans.decode(block, table) == ids).all()
    for k in range(-(-n // (1 << 12))):
        lo = k << 12
        assert (rans.decode(block, table, k, k + 1) == ids[lo : lo + (1 << 12)]).all() or n < 1 << 12
    if n:
        with pytest.raises(ValueError):
            rans.decode(block[:-9] + bytes([block[-9] ^ 1]) + block[-8:], table)


def test_token_files(spark, texts, tmp_path):
    from tokenizers import Tokenizer

    own = ["<|endoftext|> a", "a<|endoftext|>b", "a\x1cb", "it's I'LL don't", "İstanbul É a̸", "x\x85y\xa0z"]
    rows = [(i, t) for i, t in enumerate(texts + own)] + [(None, "null id"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    token_file.write(df, f"file://{tmp_path}/t", block_ids=300)
    got = token_file.read(spark, f"file://{tmp_path}/t").collect()
    t = Tokenizer.from_file(token_file.tokenizer_path(token_file.TOKENIZER))
    want, at = [], 0
    ids = [(k, [*t.encode(x or "", add_special_tokens=False).ids, 2]) for k, x in rows]
    for key, x in sorted(ids, key=lambda r: (r[0] is not None, r[0] or 0, struct.pack(f"<{len(r[1]) - 1}H", *r[1][:-1]))):
        want.append((key, at, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))))
        at += len(x)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    token_file.write(df.limit(0), f"file://{tmp_path}/e")
    assert token_file.read(spark, f"file://{tmp_path}/e").count() == 0


def _plain_grams(text):
    """N-grams of a text as tuples of letters, 0 for a blank, the most frequent first."""
    from collections import Counter

    seq = [0]
    for c in text:
        x = (ord(c.lower()) if len(c.lower()) == 1 else ord(c)) if c.isalpha() else 0
        if x or seq[-1]:
            seq.append(x)
    if seq[-1]:
        seq.append(0)
    n = Counter((x,) for x in seq if x)
    n.update(zip(seq, seq[1:], strict=False))
    n.update(t for t in zip(seq, seq[1:], seq[2:], strict=False) if t[1])
    return [g for g, _ in sorted(n.items(), key=lambda kv: (-kv[1], len(kv[0]), kv[0]))] if any(seq) else []


def _code(gram):
    out = 0
    for x in gram:
        out = out << 21 | x
    return out | (0, 0, 1 << 43, 1 << 63)[len(gram)]


def test_language_against_plain_lists():
    """Predictions and scores of profiles made of plain lists, with ties, short texts and texts without letters."""
    rng = np.random.default_rng(5)
    word = lambda letters: "".join(rng.choice(list(letters), rng.integers(1, 7)))
    langs = {"aa": "abcdeé", "bb": "defgh", "cc": "abghxß"}
    tops = {k: _plain_grams(" ".join(word(v) for _ in range(400)))[: language.PROFILE] for k, v in langs.items()}
    codes = np.unique(np.array([_code(g) for t in tops.values() for g in t], dtype=np.uint64))
    ranks = np.full((len(codes), 3), language.PROFILE, dtype=np.int64)
    for j, t in enumerate(tops.values()):
        for at, g in enumerate(t):
            ranks[np.searchsorted(codes, np.uint64(_code(g))), j] = at
    profiles = language.Profiles(list(langs), codes, ranks)
    texts = ["", " 12 ", "a", "É!", "x" * 50] + [" ".join(word("abcdefghxé, 1") for _ in range(rng.integers(1, 60))) for _ in range(60)]
    for t in texts:
        own = _plain_grams(t)[: language.DOC_GRAMS]
        if not own:
            assert profiles.predict(t) == (language.UNKNOWN, 0.0)
            continue
        place = [{g: i for i, g in enumerate(top)} for top in tops.values()]
        costs = [sum(min(abs(p[g] - i), language.PROFILE) if g in p else language.PROFILE for i, g in enumerate(own)) for p in place]
        best = costs.index(min(costs))
        got = profiles.predict(t)
        assert got[0] == list(langs)[best] and got[1] == pytest.approx(1 - costs[best] / (language.PROFILE * len(own)))

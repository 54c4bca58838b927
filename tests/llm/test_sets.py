"""Set join, term counts, near duplicates and groups against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from litlake.llm import classes, neardup, setjoin, termcounts


def pairs(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def brute(sets, threshold, least=1):
    kept = {k: frozenset(v) for k, v in sets.items() if v and len(set(v)) >= least}
    return {(a, b) for a, b in itertools.combinations(sorted(kept), 2) if len(kept[a] & kept[b]) >= threshold * len(kept[a] | kept[b]) - 1e-9}


def table(spark, sets):
    return spark.createDataFrame([(k, v) for k, v in sets.items()], "id string, items array<string>")


@pytest.mark.parametrize("threshold,words,seed", [(0.6, 12, 1), (0.6, 40, 2), (0.8, 15, 3), (0.5, 20, 4), (0.34, 25, 5)])
def test_similar_sets(spark, threshold, words, seed):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(words)]
    sets = {f"r{i:03}": rng.choices(names, weights=[1 / (j + 1) for j in range(words)], k=rng.randint(0, 11)) for i in range(150)}
    members, links = setjoin.similar_sets(table(spark, sets), "id", "items", threshold, 3)
    assert pairs(classes.expand_pairs(members, links.select("cls_a", "cls_b"), "id")) == brute(sets, threshold, 3)


@pytest.mark.parametrize("hot", [1, 3])
def test_split_keys(spark, monkeypatch, hot):
    monkeypatch.setattr(setjoin, "HOT", hot)
    rng = random.Random(8)
    sets = {f"r{i:03}": ["a", "b", *rng.choices("cdefgh", k=rng.randint(1, 4))] for i in range(120)}
    members, links = setjoin.similar_sets(table(spark, sets), "id", "items", 0.6, 3)
    assert pairs(classes.expand_pairs(members, links.select("cls_a", "cls_b"), "id")) == brute(sets, 0.6, 3)
    assert setjoin.parts_of((1, 2), {1: 9, 2: 5}, hot) == 1 + 5 // hot and setjoin.parts_of((1, 3), {1: 9}, hot) == 1 + 1 // hot


def test_sets_in_one_segment(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "_cut", lambda tokens, m: {0: tuple(tokens)})
    for n in range(3, 9):
        base = list(range(1, n + 1))
        near = base[:-1] + [99]
        if len(set(base) & set(near)) >= 0.6 * len(set(base) | set(near)):
            assert setjoin.probe_keys(base, 0.6, {}) & setjoin.index_keys(sorted(near), 0.6)


def test_sets_with_odd_rows(spark):
    df = spark.createDataFrame(
        [("a", ["x", "y", "z"], "e"), ("a", ["x", "y", "z"], "e"), ("b", ["z", "y", "x", "x", None], "e"), ("c", None, "e"), ("d", [], None), ("e", ["x"], "e")],
        "id string, items array<string>, cls string",
    )
    members, links = setjoin.similar_sets(df, "id", "items", 0.6, 3)
    assert pairs(classes.expand_pairs(members, links.select("cls_a", "cls_b"), "id")) == {("a", "b")}
    assert links.count() == 0 and members.count() == 2
    none = setjoin.similar_sets(df.limit(0), "id", "items")
    assert none[0].count() == 0 and none[1].count() == 0


def test_hot_set(spark):
    sets = {f"h{i:03}": ["a", "b", "c"] for i in range(120)} | {f"o{i:03}": ["a", f"x{i}", f"y{i}"] for i in range(120)} | {"n": ["a", "b", "c", "d"]}
    members, links = setjoin.similar_sets(table(spark, sets), "id", "items", 0.6, 3)
    assert links.count() == 1
    assert len(pairs(classes.expand_pairs(members, links.select("cls_a", "cls_b"), "id"))) == 120 * 119 // 2 + 120


def test_term_counts(spark, monkeypatch):
    monkeypatch.setattr(termcounts, "FLUSH", 5)
    rng = random.Random(3)
    rows = [(f"r{i}", rng.choice("fg"), [rng.choice("abcdefghij") for _ in range(rng.randint(0, 9))]) for i in range(200)]
    rows = list({(r, f): (r, f, t) for r, f, t in rows}.values()) + [(None, "f", ["a"]), ("z", "f", None), ("y", "f", [None, "a", "a"])]
    df = spark.createDataFrame(rows, "record string, field string, terms array<string>")
    want = {}
    for r, f, terms in rows:
        for t in (terms or []) if r else []:
            if t:
                n, s = want.setdefault((f, t), [0, set()])
                want[f, t] = [n + 1, s | {r}]
    got = {(r["field"], r["term"]): (r["occurrences"], r["records"]) for r in termcounts.term_counts(df).collect()}
    assert got == {k: (n, len(s)) for k, (n, s) in want.items()}
    marks = termcounts.mark_terms(termcounts.term_counts(df), 200)
    assert {r["mark"] for r in marks.collect()} <= {"rare", "common", None}
    assert termcounts.term_counts(df.limit(0)).count() == 0


def test_words():
    assert termcounts.words("Ａ b_c-3 情感! ﬁn") == ["a", "b", "c", "3", "情感", "fin"]
    assert termcounts.words(None) == [] and termcounts.words(" _ ") == []


def test_near_duplicates(spark):
    rng = random.Random(9)
    vocabulary = [f"word{i}" for i in range(900)]
    texts = {}
    for i in range(120):
        base = rng.sample(vocabulary, 80)
        texts[f"b{i:03}"] = base
        for j, edits in enumerate((1, 5, 9, 12)):
            copy = list(base)
            for place in rng.sample(range(80), edits):
                copy[place] = rng.choice(vocabulary)
            rng.shuffle(copy)
            texts[f"c{i:03}{j}"] = copy
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "key string, text string")
    members, links = neardup.near_duplicates(df)
    got = pairs(classes.expand_pairs(members, links.select("cls_a", "cls_b"), "key"))
    want = brute(texts, 0.7)
    assert got <= want and len(got) >= 0.99 * len(want)


def test_near_duplicates_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    df = spark.createDataFrame([("a", "One two"), ("a", "One two"), ("b", "two, ONE!"), ("c", None), ("d", ""), ("e", "..."), ("f", long), ("g", long + " x")], "key string, text string")
    members, links = neardup.near_duplicates(df)
    assert pairs(classes.expand_pairs(members, links.select("cls_a", "cls_b"), "key")) == {("a", "b"), ("f", "g")}
    none = neardup.near_duplicates(df.limit(0))
    assert none[0].count() == 0 and none[1].count() == 0


def test_groups(spark):
    rng = random.Random(4)
    edges = [(f"{i:04}", f"{i + 1:04}") for i in range(90)] + [(f"{rng.randint(200, 420):04}", f"{rng.randint(200, 420):04}") for _ in range(150)]
    edges = [e for e in edges if e[0] != e[1]] + [("0000", "0001")]
    nodes = sorted({x for e in edges for x in e} | {"lone"})
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = classes.connected_groups(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "a string, b string"))
    assert {r["node"]: r["grp"] for r in got.collect()} == {n: root(n) for n in nodes}
    none = spark.createDataFrame([], "a string, b string")
    assert classes.connected_groups(spark.createDataFrame([("q",)], "node string"), none).collect()[0]["grp"] == "q"


def test_first_rows(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), (None, 0, "n"), ("b", 3, None)], "k string, pos int, v string")
    assert pairs(classes.first_rows(df, "k", "pos", ["v"])) == {("a", "x"), ("b", None)}
    assert df.where(F.lit(False)).count() == 0


@pytest.mark.parametrize("records,threshold", [(1_000, 0.7), (110_000, 0.7), (110_000, 0.8), (10_000, 0.5), (10**8, 0.7)])
def test_pairs_at_the_threshold_become_candidates(records, threshold):
    """Records of two sizes of collection and more: 1,500 pairs whose similarity is the threshold."""
    rng = np.random.default_rng(4)
    k, segments = neardup.plan(records, threshold)
    sets, many = [], 1500
    own = round(100 * (1 - threshold))
    for _ in range(many):
        words = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        shared = words[: 2 * (100 - own)]
        sets += [np.sort(np.concatenate([shared, words[200 - 2 * own : 200 - own]])), np.sort(np.concatenate([shared, words[200 - own :]]))]
    prints = np.concatenate([neardup.fingerprints(sets[i : i + 500], k * segments) for i in range(0, len(sets), 500)])
    apart = prints[::2] != prints[1::2]
    symbols, check = apart[:, : k * segments], apart[:, k * segments :]
    met = symbols.reshape(many, segments, k).sum(axis=2).min(axis=1) <= 1
    near = (check.sum(axis=1) <= neardup.most_apart(neardup.CHECK, (1 - threshold) / 2)) & (symbols.sum(axis=1) <= neardup.most_apart(k * segments, 1 - threshold))
    assert (met & near).sum() >= many - 2


def test_near_duplicates_by_place(spark):
    df = spark.createDataFrame([("a", 2, "One two three"), ("a", 1, "four five"), ("b", 9, "four, FIVE"), ("c", 1, None), ("c", 2, "one two three"), (None, 1, "four five")], "key string, place long, text string")
    members, links = neardup.near_duplicates(df)
    assert pairs(classes.expand_pairs(members, links.select("cls_a", "cls_b"), "key")) == {("a", "b")} and links.count() == 0

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from braidlog.llm import neardup as n
from braidlog.session import cut
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def run(spark, texts, extra=False, expand=32):
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "id bigint, text string, class string" if extra else "id bigint, text string, other string").select("id", "text")
    sig = cut(n.signatures(df))
    links, member = n.links(df, sig), n.members(sig)
    return {tuple(r) for r in n.pairs(links, member, expand).collect()}, {tuple(r) for r in n.groups(links, member).collect()}


def brute(texts, threshold=0.5):
    return {(i, j) for (i, a), (j, b) in combinations(sorted(texts), 2) if n.similarity(a, b) >= threshold}


def corpus(seed, count, words=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(800)]
    texts = []
    for i in range(count):
        if texts and r.random() < 0.5:
            w = r.choice(texts)[1].split()
            for _ in range(r.randint(0, 6)):
                k = r.randrange(len(w))
                w[k : k + r.randint(0, 2)] = [r.choice(vocabulary)] * r.randint(0, 2)
            if r.random() < 0.2:
                half = len(w) // 2
                w = w[half:] + w[:half]
        else:
            w = [r.choice(vocabulary) for _ in range(words)]
        texts.append((i + 1, " ".join(w) or "x y z"))
    return texts


def test_recall_and_precision_against_brute_force(spark):
    texts = corpus(1, 500)
    want = brute(texts)
    got, groups = run(spark, texts)
    assert got <= want and len(got) >= 0.97 * len(want) > 100
    root = {i: i for i, _ in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in got:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert {(r[0], r[2]) for r in groups} == {(i, find(i)) for i, _ in texts}


def test_copies_nulls_short_and_empty(spark):
    base = "one two three four five six seven"
    texts = [(1, base), (2, base.upper() + "!"), (3, "one two"), (4, ""), (5, "one two"), (6, base + " eight"), (7, "a b c d e f g")]
    got, groups = run(spark, texts, extra=True)
    assert got == {(1, 2), (1, 6), (2, 6)}
    assert {r[0] for r in groups} == {1, 2, 6, 7} and {r[1:3] for r in groups if r[0] in (1, 2)} == {(1, 1)}
    assert run(spark, [])[0] == set()


def test_large_classes_are_stars(spark):
    texts = [(i, "the same words again and again here") for i in range(1, 101)] + [(200, "the same words again and again here now")]
    got, _ = run(spark, texts)
    assert got == {(1, i) for i in range(2, 101)} | {(1, 200)}


def test_large_nodes_are_compared_in_blocks(spark, monkeypatch):
    """A node of many distinct texts, in a few ranges and many blocks: every pair is found."""
    monkeypatch.setattr(n, "SMALL", 2)
    monkeypatch.setattr(n, "BLOCK", 4)
    r = random.Random(5)
    core = [f"c{i}" for i in range(40)]
    texts = [(i, " ".join(core + [f"t{r.randrange(10**6)}" for _ in range(4)])) for i in range(1, 61)]
    got, _ = run(spark, texts)
    assert got == brute(texts)


def _ranges(rows, cuts):
    """What the walks over ranges of sorted rows find, blocks compared with each other."""
    out = []
    for k, part in enumerate(rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])):
        batches = [pa.record_batch([pa.array(x, pa.int64()) for x in zip(*p, strict=True)], names=["key", "class", "sketch"]) for p in (part[:7], part[7:]) if p]
        out += [(k, x) for b in n._walk(iter(batches)) for x in b.to_pylist()]
    got = [(x["a"], x["b"]) for _, x in out if x["node"] is None]
    nodes = {}
    for k, x in out:
        if x["node"] is not None:
            nodes.setdefault(x["node"], []).append([tuple(z) for z in np.frombuffer(x["packed"], np.int64).reshape(-1, 2).tolist()])
    for blocks in nodes.values():
        got += [p for x in blocks for p in n._close(x)] + [p for x, y in combinations(blocks, 2) for p in n._close(x, y)]
    return got, nodes


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2)), max_size=40), st.integers(1, 6), st.lists(st.integers(0, 40), max_size=3), st.integers(2, 9))
def test_walk_compares_every_node(keys, small, cuts, block):
    """Pairs that share the deepest prefix always meet, wherever the ranges are cut; those of small shallow nodes meet too."""
    before = n.SMALL, n.BLOCK
    n.SMALL, n.BLOCK = small, block
    try:
        rows = sorted((a << (n.BITS * (n.DEEPEST - n.SHALLOW)) | b, i, 0) for i, (a, b) in enumerate(keys))
        got, _ = _ranges(rows, sorted(min(c, len(rows)) for c in cuts))
    finally:
        n.SMALL, n.BLOCK = before
    size = Counter(a for a, _ in keys)
    must = {(i, j) for (i, x), (j, y) in combinations(enumerate(keys), 2) if x == y or (x[0] == y[0] and size[x[0]] <= small)}
    may = {(i, j) for (i, x), (j, y) in combinations(enumerate(keys), 2) if x[0] == y[0]}
    assert must <= set(got) <= may


def test_a_hot_node_lies_in_many_tasks(spark):
    """Texts that nearly all share their sequences: the work is spread, and nothing of it is lost."""
    r = random.Random(9)
    core = " ".join(f"c{i}" for i in range(60))
    texts = [(i, f"{core} t{r.randrange(10**6)} u{r.randrange(10**6)}") for i in range(1, 2301)]
    df = spark.createDataFrame(texts, "id bigint, text string").select("id", "text")
    sig = cut(n.signatures(df))
    keyed = sig.select(F.posexplode("upper").alias("tree", "top")).where("tree = 0").groupBy("top").count().orderBy(F.desc("count")).first()
    assert keyed["count"] > 2000
    assert n.candidates(sig).count() == 2300 * 2299 // 2


@pytest.mark.parametrize("s,least", [(0.5, 0.95), (0.6, 0.995), (0.8, 0.9999)])
def test_recall_of_the_deepest_level(s, least):
    assert n.recall(s, n.DEEPEST) >= least


def test_prefix_is_shortened_until_the_target():
    assert n.longest() == n.DEEPEST and n.recall(n.THRESHOLD, n.DEEPEST) >= n.TARGET > n.recall(n.THRESHOLD, n.DEEPEST + 1)
    assert n.longest(0.9, 0.8, 40) > n.longest(0.999, 0.8, 40)
    with pytest.raises(ValueError):
        n.longest(0.999, 0.1, 3)


def partly_common(families, share):
    """Texts of 100 words, ``share`` of them common to all, in pairs at a similarity just above 0.5."""
    texts = []
    for f in range(families):
        common = int(100 * share)
        both = max(0, 70 - common)
        for k in range(2):
            words = [f"b{i}" for i in range(common)] + [f"f{f}x{i}" for i in range(both)] + [f"f{f}k{k}y{i}" for i in range(100 - common - both)]
            texts.append((len(texts) + 1, " ".join(words)))
    return texts


@pytest.mark.parametrize("share", [0.0, 0.3, 0.5, 0.6])
def test_recall_whatever_part_is_common(spark, share):
    texts = partly_common(80, share)
    want = brute(texts)
    got, _ = run(spark, texts)
    assert len(want) >= 80 and got <= want and len(got) >= 0.97 * len(want)


def test_floors_lose_nothing_at_the_threshold():
    from math import comb

    for planes, functions in ((1, 64), (n.WALK_PLANES, n.FUNCTIONS), (n.PLANES, n.FUNCTIONS)):
        p = 0.5 + 0.5 / 2**planes
        floor = n.least(planes, functions)
        assert 0 < floor < functions and sum(comb(functions, k) * p**k * (1 - p) ** (functions - k) for k in range(floor)) <= 1e-6
    assert n.recall(n.THRESHOLD, n.DEEPEST) >= 0.995


def test_forks_meet_their_parents(spark):
    base = [" ".join(f"p{k}w{i}" for i in range(30)) for k in range(3)]
    texts = [(1, base[0]), (2, base[1]), (3, base[0] + " more"), (4, base[1]), (5, "nothing of the kind is said in here"), (6, base[2])]
    df = spark.createDataFrame(texts, "id bigint, text string")
    sig = cut(n.signatures(df))
    kin = spark.createDataFrame([("f", "p"), ("g", "q"), ("x", "p")], "session_id string, forked_from_id string")
    of = spark.createDataFrame([(1, "p"), (2, "p"), (3, "f"), (4, "f"), (5, "f"), (6, "g")], "id bigint, session_id string")
    got = n.shared_with(n.links(df, sig), n.members(sig), kin, of)
    assert {tuple(r) for r in got.collect()} == {("f", "p", 3, 2), ("g", "q", 1, 0)}

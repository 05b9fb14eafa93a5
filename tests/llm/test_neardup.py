"""Near-duplicates: signatures estimate similarity, classes equal those of all verified pairs."""

import hashlib
import random

import numpy as np
import pytest

from veilgraph.llm import neardup
from veilgraph.llm.components import components


def test_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    k = 400
    for share, weights in ((0.9, None), (0.5, None), (0.7, "random"), (0.2, "random")):
        n = 600
        common, a, b = (rng.integers(0, 2**63, int(n * s)).astype(np.uint64) for s in (share, 1 - share, 1 - share))
        x, y = np.concatenate([common, a]), np.concatenate([common, b])
        wx = rng.uniform(0.2, 4, len(x)) if weights else np.ones(len(x))
        wy = np.concatenate([wx[: len(common)] * (rng.uniform(0.5, 1.5, len(common)) if weights else 1), rng.uniform(0.2, 4, len(b)) if weights else np.ones(len(b))])
        both = np.minimum(wx[: len(common)], wy[: len(common)]).sum()
        want = both / (wx.sum() + wy.sum() - both)
        got = (neardup.dart_minhash(x, wx, k) == neardup.dart_minhash(y, wy, k)).mean()
        assert got == pytest.approx(want, abs=4 * (want * (1 - want) / k) ** 0.5 + 0.01)


def test_signature_ignores_order_and_works_for_any_size():
    rng = np.random.default_rng(2)
    for n in (1, 2, 50, 20_000):
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        p = rng.permutation(len(x))
        assert (neardup.dart_minhash(x, np.ones(len(x)), 120) == neardup.dart_minhash(x[p], np.ones(len(x)), 120)).all()


def corpus():
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 40, 120]))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 8, 25])):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            texts.append((" ".join(own)).upper() if rng.random() < 0.3 else ", ".join(own))
    return texts + [None, "", "...", "one two", "one two", "One, two!"]


def brute(texts):
    from collections import Counter

    from veilgraph.llm._common import words

    sets = []
    for t in texts:
        w = words((t or "").encode())
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = sum((sets[i] & sets[j]).values())
                if both >= 0.8 * (sum(sets[i].values()) + sum(sets[j].values()) - both):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("block", [512, 3])
def test_classes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = corpus()
    d = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, class_id string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(d).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def crowd():
    """Two classes of near copies in one bucket; only their last two texts link them, and no least text does."""

    def text(p, q, tail):
        own = [f"36x{i}" for i in range(200)]
        for i in range(p):
            own[10 + 10 * i] = f"p{i}"
        for i in range(q):
            own[110 + 10 * i] = f"q{i}"
        return " ".join([*own[:-1], tail])

    def some(p, q, n, low):
        every = (text(p, q, f"t{p}{q}{k}") for k in range(1000))
        return [t for t in every if (hashlib.blake2b(t.encode(), digest_size=16).digest() < b"\x80") == low][:n]

    return [*some(5, 0, 20, True), *some(0, 5, 20, True), *some(1, 0, 1, False), *some(0, 1, 1, False)]


@pytest.mark.parametrize("block", [512, 7])
def test_a_crowd_hangs_on_one_link(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = crowd()
    assert set(brute(texts)) == {0} and len(set(brute(texts[:-1]))) == 2
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = neardup.near_duplicates(d, bands=4, rows=1).collect()
    assert {r["class_id"] for r in got} == {0}


def test_one_of_each_class_stays(spark):
    d = spark.createDataFrame([(None, "a b c d e f", 1), (5, "A b c d e f", 2), (5, "a b c d e f", 3), (5, "a b c d e f", 3), (7, None, 4), (8, None, 4)], "doc_id long, text string, x int")
    out = neardup.remove_near_duplicates(d).collect()
    assert sorted(str(r["doc_id"]) for r in out) == ["5", "7", "8"] and len(out[0]) == 3
    assert neardup.near_duplicates(d.limit(0)).collect() == []


def test_clashing_columns_are_kept(spark):
    names = ["__thash", "__first", "own_id", "row", "class_id", "label", "key"]
    d = spark.createDataFrame([(1, "a b c d e f", *"abcdefg"), (2, "a b c d e f", *"abcdefg"), (None, None, *[None] * 7)], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    out = neardup.remove_near_duplicates(d)
    assert out.columns == d.columns and {tuple(r) for r in out.collect()} == {(1, "a b c d e f", *"abcdefg"), (None, None, *[None] * 7)}


def test_shared_elements_equal_multiset_intersection():
    from collections import Counter

    rng = np.random.default_rng(4)
    bags = [Counter(rng.integers(0, 30, n).tolist()) for n in (1, 5, 40, 40, 60)]
    sets = [neardup.unary(neardup.mix(np.array(list(b), np.uint64)), np.array(list(b.values()))) for b in bags]
    got = neardup.shared_elements(sets, np.arange(3), np.arange(3, 5))
    assert got.tolist() == [[sum((a & b).values()) for b in bags[3:]] for a in bags[:3]]


def test_components_of_a_long_chain(spark):
    rows = spark.createDataFrame([(f"{i:04}", f"{i + 1:04}") for i in range(200)] + [("x", "y")], "a string, b string")
    got = {r["node"]: r["label"] for r in components(rows).collect()}
    assert {v for k, v in got.items() if k < "x"} == {"0000"} and got["y"] == "x"

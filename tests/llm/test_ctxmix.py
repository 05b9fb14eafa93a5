"""Scoring: exact base, a proper code, learning that helps on held-out texts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from veilgraph.llm import ctxmix


def test_codes_are_prefix_free_and_complete():
    codes = ctxmix.build_codes([b"", b"the", b"of", b"zebra"], [9, 30, 12, 2], 7)
    seen = set()
    for s in range(5):
        a, n = codes["start"][s], codes["length"][s]
        seen.add("".join(map(str, codes["bit"][a : a + n])))
    assert len(seen) == 5 and sum(2.0 ** -len(x) for x in seen) == pytest.approx(1)
    assert sum(2.0 ** -float(n) for n in codes["length"][5:]) == pytest.approx(1)


def test_symbols_spell_what_is_rare():
    coder = ctxmix.Coder(ctxmix.build_codes([b"", b"the"], [3, 4], 5), 10)
    symbols, rare, ids = coder.symbols("The qué the".encode())
    assert rare == ["qué".encode()] and ids.tolist() == [1, 1, 0]
    assert symbols.tolist() == [1, 2, *[3 + p for p in ctxmix.pairs("qué".encode())], 1, 0]


def corpus():
    rng = random.Random(6)
    topics = [[f"{a}{i}" for i in range(40)] for a in ("fish", "rock", "tree")]
    rows = [(i, " ".join(rng.choice(topics[i % 3]) for _ in range(60))) for i in range(700)]
    return rows + [(900, None), (901, ""), (None, "Fish1 unseen-word Ünseen"), (902, "fish1 " * 3000)]


def test_scores(spark):
    rows = corpus()
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score int")
    got = {r["doc_id"]: r for r in ctxmix.score(d, vocabulary=90, bits=14).collect()}
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    low = lambda t: [*(t or "").encode().lower().split(), b""]
    count = Counter(x for i, t in rows if not held(i) for x in low(t))
    n, v = sum(count.values()), len(count)
    for i, t in rows:
        want = math.fsum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in low(t))
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(low(t)), sum(x in count for x in low(t)), n)
        assert r["base_score"] == pytest.approx(want, rel=1e-9) and r["score"] < 0
        assert r["bits_per_byte"] == pytest.approx(-r["score"] / math.log10(2) / max(1, len((t or "").encode())))
    tested = [r for i, r in got.items() if r["held_out"] and r["n_tokens"] > 50]
    assert sum(r["score"] for r in tested) > sum(r["base_score"] for r in tested)


def test_probabilities_of_all_next_symbols_sum_to_one():
    texts = [b"a b a b a c", b"a b c c a b"]
    codes = ctxmix.build_codes([b"", b"a", b"b", b"c"], [2, 5, 4, 3], 1)
    coder = ctxmix.Coder(codes, 12)
    counts = [np.zeros(2 * n, np.int64) for n in (codes["nodes"], 1 << 12, 1 << 12)]
    for t in texts:
        s = coder.symbols(t)[0]
        one, two = ctxmix.before(s, np.array([0]))
        _, code, first, second = coder.decisions(s, one, two)
        for own, slot in zip(counts, (codes["node"][code], first, second), strict=True):
            np.add.at(own, 2 * slot.astype(np.int64) + codes["bit"][code], 1)
    model = {"odds": [ctxmix.log_odds(c)[0] for c in counts], "seen": ctxmix.log_odds(counts[2])[1]} | ctxmix.fresh()
    lead = [1, 2]
    base = ctxmix.score_group(coder, model, [np.array(lead)])[0]
    total = sum(math.exp(ctxmix.score_group(coder, model, [np.array([*lead, s])])[0] - base) for s in range(5))
    assert total == pytest.approx(1, abs=1e-4)


def test_sparse_counters_round_trip():
    import pandas as pd

    rng = np.random.default_rng(3)
    counts = [np.where(rng.random(3 * ctxmix.PART // 2) < 0.1, rng.integers(0, 2**32, 3 * ctxmix.PART // 2), rng.integers(0, 2, 3 * ctxmix.PART // 2)).astype(np.uint32)]
    want = 5 * counts[0].astype(np.uint64)
    rows = pd.concat([b.to_pandas() for b in ctxmix._flush(counts, 3)] * 5)
    got = np.concatenate([ctxmix._summed(own) for _, own in rows.groupby("b")])[: len(want)]
    assert (got == want).all() and got.max() > 2**33 and not counts[0].any()


def test_weights_do_not_depend_on_the_layout(spark):
    d = spark.createDataFrame([(i, t) for i, t in corpus() if i is not None], "doc_id long, text string")
    one, many = ({r["doc_id"]: r["score"] for r in ctxmix.score(x, vocabulary=90, bits=14).collect()} for x in (d.coalesce(1), d.repartition(5)))
    assert all(one[i] == pytest.approx(many[i], rel=1e-4) for i in one)


def test_held_out_documents_score_above_the_base(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r for r in ctxmix.score(d).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_few_slots_lose_little(spark):
    """Contexts that share slots blur the counts; the mix then leans on the others."""
    d = spark.createDataFrame([(i, t) for i, t in corpus() if i is not None], "doc_id long, text string")
    total = {bits: sum(r["score"] for r in ctxmix.score(d, vocabulary=90, bits=bits).collect() if r["held_out"]) for bits in (16, 10)}
    assert 1.3 * total[16] < total[10]


def test_no_training_rows(spark):
    d = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    r = ctxmix.score(d, vocabulary=10, bits=10).collect()
    assert len(r) == 1 and r[0]["train_tokens"] == 0 and r[0]["n_known"] == 0 and r[0]["score"] < 0
    assert ctxmix.score(d.limit(0), vocabulary=10, bits=10).collect() == []


def test_texts_are_dealt_anew_across_batches():
    import pyarrow as pa

    texts = ["a" * n for n in (30, 30, 50, 0, 250, 10, 90, 5)] + [None] * 9
    rows = [pa.record_batch([pa.array(range(i, min(i + 3, 17))), pa.array(texts[i : i + 3], pa.string())], ["i", "t"]) for i in range(0, 17, 3)]
    dealt = list(ctxmix.pieces(iter(rows), 1, most=100, rows=6))
    assert [r for b in dealt for r in b.to_pylist()] == [{"i": i, "t": t} for i, t in enumerate(texts)]
    # Two short batches make one piece, a long text stands alone, and empty texts are bounded by their number.
    assert [b.num_rows for b in dealt] == [2, 2, 1, 2, 6, 4]
    assert list(ctxmix.pieces(iter([rows[0].slice(0, 0)]), 1)) == []


def test_equal_symbols_after_equal_contexts_are_looked_up_once(monkeypatch):
    rng = np.random.default_rng(4)
    coder = ctxmix.Coder(ctxmix.build_codes([b"", b"a", b"b", b"c"], [2, 5, 4, 3], 1), 10)
    now = rng.integers(0, 9, 3000)
    one, two = ctxmix.before(now, np.array([0, 700]))
    _, code, *slots = coder.decisions(now, one, two)
    looked = []
    paths = ctxmix.Coder._paths
    monkeypatch.setattr(ctxmix.Coder, "_paths", lambda self, own, *more: looked.append(len(own)) or paths(self, own, *more))
    for context, slot in zip(ctxmix.contexts(one, two), slots, strict=True):
        want, got = np.zeros(2 << 10, np.uint32), np.zeros(2 << 10, np.uint32)
        np.add.at(want, 2 * slot + coder.codes["bit"][code], np.uint32(1))
        coder.count_contexts(now.astype(np.uint64) << np.uint64(32) | context, got)
        coder.count_contexts(np.zeros(0, np.uint64), got)
        assert (got == want).all()
    assert looked[0] == len(set(zip(now, one, strict=True))) < looked[1] == len(set(zip(now, one, two, strict=True))) < 3000


def test_spelling_and_tallies_follow_the_words():
    import pyarrow as pa

    words = [b"zebra", b"", "qué".encode(), b"of", b"of", b"", b"x"]
    for held in (pa.array(words, pa.binary()), pa.array([b"cut", *words], pa.binary()).slice(1), pa.array([], pa.binary())):
        spelled, many = ctxmix.spelling(held)
        assert spelled.tolist() == [p for w in held.to_pylist() for p in ctxmix.pairs(w)] and many.tolist() == [len(ctxmix.pairs(w)) for w in held.to_pylist()]
    tokens, times = ctxmix.tallies(pa.array(words, pa.binary()), np.array([0, 3, 3, 7]))
    assert [dict(zip(*x, strict=True)) for x in zip(tokens.to_pylist(), times.to_pylist(), strict=True)] == [{}, Counter(words[:3]), {}, Counter(words[3:])]


def test_a_worker_prepares_the_codes_once():
    made = []
    shared = {}
    assert ctxmix.kept(shared, lambda: made.append(1) or "a") == ctxmix.kept(shared, lambda: made.append(1) or "b") == "a" and made == [1]

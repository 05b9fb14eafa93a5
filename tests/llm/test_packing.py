"""Packing: exact round trip of ids, gapless sequences, little padding."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veilgraph.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", "Hello world's end", "été <|endoftext|> x", "<|endoftext|>", "a <|endoftext|><|endoftext|>  b<|endoftext", "一  <|endoftext|>\n二", "一 二 😀", "a b " * 3000, "\x1c\x1d \x85 \xa0", "word " * 200] + [f"item {i} " * (i % 70) for i in range(400)]


def test_round_trip(spark):
    t = Tokenizer.from_file(PATH)
    d = spark.createDataFrame([(i, x, 0) for i, x in enumerate(TEXTS)], "doc_id int, text string, length int")
    rows = packing.pack(d, PATH, capacity=256, with_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(ids.tobytes()) == r["ids_crc32"]
        by_doc.setdefault(r["doc_id"], []).append((r["start"], ids.tolist(), r["doc_tokens"]))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, x in enumerate(TEXTS):
        parts = sorted(by_doc[i])
        got = [y for _, ids, _ in parts for y in ids]
        assert got == t.encode(x or "", add_special_tokens=False).ids + [1] and {n for _, _, n in parts} == {len(got)}
        assert [s for s, _, _ in parts] == np.cumsum([0] + [len(p[1]) for p in parts])[:-1].tolist()
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r["length"] for r in rows)
    assert total / (256 * len(by_seq)) > 0.95


def test_null_and_repeated_ids(spark):
    d = spark.createDataFrame([(None, "x y"), (None, "x y"), (1, "z")], "doc_id long, text string")
    rows = packing.pack(d, PATH).collect()
    assert len(rows) == 3 and sorted((r["offset"], r["length"]) for r in rows)[0][0] == 0
    assert packing.pack(d.limit(0), PATH).collect() == []


@pytest.mark.parametrize("demand", [{1: 5}, {3: 7, 5: 2}, {16: 3, 9: 4, 7: 4, 2: 30}, {i: (i * 7) % 11 for i in range(1, 17)}])
def test_plan_has_room_for_all_and_is_near_the_bound(demand):
    plan = packing.solve(demand, 16)
    slots = {}
    for often, pattern in plan:
        assert sum(s * n for s, n in pattern.items()) <= 16
        for s, n in pattern.items():
            slots[s] = slots.get(s, 0) + often * n
    assert all(slots.get(s, 0) >= n for s, n in demand.items())
    bound = -(-sum(s * n for s, n in demand.items()) // 16)
    assert sum(n for n, _ in plan) <= bound * 1.3 + 2


def test_knapsack_is_optimal():
    values = np.array([0.1, 0.35, 0.5, 0.72])
    worth, pattern = packing.best_pattern(values, 7)
    best = max(a * 0.1 + b * 0.35 + c * 0.5 + d * 0.72 for a in range(8) for b in range(4) for c in range(3) for d in range(2) if a + 2 * b + 3 * c + 4 * d <= 7)
    assert worth == pytest.approx(best) and pattern @ values == pytest.approx(best)

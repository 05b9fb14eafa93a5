"""Transcript parsing: exact decoding in pieces, held-out accuracy, content kept."""

import itertools
import math
import random

import numpy as np

from veilgraph.llm import chat


def model():
    rng = np.random.default_rng(3)
    log = lambda x: np.log(x / x.sum(-1, keepdims=True))
    k = len(chat.STATES)
    return chat.Model(log(rng.random(k)), log(rng.random((k, k))), [log(rng.random((k, n))) for n in (4, 2, 2, 4)])


def test_decoding_equals_brute_force():
    m, rng = model(), random.Random(2)
    for n in (1, 2, 4):
        f = [(rng.randrange(4), rng.randrange(2), rng.randrange(2), rng.randrange(4)) for _ in range(n)]
        e = m.scores(f)
        score = lambda s: m.first[s[0]] + e[0][s[0]] + sum(m.move[a, b] + e[i + 1][b] for i, (a, b) in enumerate(itertools.pairwise(s)))  # noqa: E731, B023
        best = max(itertools.product(range(6), repeat=n), key=score)
        assert m.decode(f, None, None) == list(best)
        assert math.isclose(m.matrix(f, True)[0].max(), score(best))


def rows(n, turns):
    rng = random.Random(n)
    say = lambda: "\n".join(" ".join(rng.choice(["oak", "elm", "is", "it"]) for _ in range(rng.randint(1, 20))) for _ in range(rng.randint(1, 3)))
    return [(c, t, ["user", "assistant"][t % 2] if t or c % 5 else "system", say()) for c in range(n) for t in range(turns)]


def test_recovers_roles_of_held_out_transcripts(spark):
    d = spark.createDataFrame(rows(120, 6), "conv_id long, turn long, role string, text string")
    got = chat.recover_roles(d).collect()
    assert len(got) == 720 and sum(r["role"] == r["parsed_role"] for r in got) / 720 > 0.93


def test_pieces_decode_as_the_whole(spark):
    data = [(1, t, r, x) for _, t, r, x in rows(1, 300)] + [(2, t, r, x) for _, t, r, x in rows(3, 4)]
    d = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    blocks = chat.raw_blocks(d)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        staged = chat.stage(blocks, "key", "order", "text", "role")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert staged.select("__part").distinct().count() > 1
    m = chat.fit(staged)
    got = {(r["__key"], r["__order"]): r["parsed_role"] for r in chat.parse(staged, m).collect() if r["__key"] == 1}
    own = sorted((r["order"], r["text"]) for r in blocks.where("key = 1").collect())
    lines = [chat.block_lines(t) for _, t in own]
    states = m.decode([f for x in lines for f, _ in x], None, None)
    at = np.cumsum([0] + [len(x) for x in lines])[:-1]
    assert [got[1, o] for o, _ in own] == [chat.STATES[states[i]][0] for i in at]


def test_edge_cases(spark):
    d = spark.createDataFrame([(None, None, None, None), (None, None, "user", ""), (1, 1, "user", "hi"), (1, 1, "user", "hi"), (2, 0, "robot", "x" * 50_000)], "conv_id long, turn long, role string, text string")
    got = chat.recover_roles(d).collect()
    assert len(got) == 5 and all(r["parsed_role"] in chat.ROLES for r in got)
    assert chat.recover_roles(d.limit(0)).collect() == []

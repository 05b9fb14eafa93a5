"""Quality rules: exact counts, exact tails, certified cutoffs."""

import math
import random

import pytest

from veilgraph.llm import quality


def brute(text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if x]
    seen, again = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                again.update(range(i, i + 8))
    lines, dups = [], 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            dups += line in lines
            lines.append(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dups, len(again)


def texts():
    rng = random.Random(1)
    out = [None, "", "\n\n", "é é\x85é\xa0x y", "a b c d e f g h a b c d e f g h", "x " * 30, "same\nsame\n same\nsame", "#*$%&|<>"]
    return out + [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 80))).replace(" ", rng.choice([" ", "\n", "\t "])) for _ in range(150)]


def test_counts_equal_brute_force():
    for t in texts():
        assert quality.text_counts(t)[:5] == brute(t), t


def test_tail_is_exact():
    for n, p in ((12, 0.3), (40, 0.05)):
        for k in range(n + 1):
            want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert quality.binomial_tail(k, n, p) == pytest.approx(want, abs=1e-12)


def test_certified_cutoffs_keep_their_promise():
    rng = random.Random(4)
    grid, broken, alpha, level = [i / 20 for i in range(20)], 0, 0.1, 0.1
    for _ in range(300):
        good, bad = [0] * 20, [0] * 20
        for _ in range(200):
            good[min(19, int(rng.random() * 20))] += 1
            bad[min(19, int(20 * rng.random() ** 0.2))] += 1
        cut = quality.certify(good, bad, 200, grid, alpha, level, penalty=0.0)
        broken += cut is not None and 1 - cut > alpha + 1e-9
    assert broken <= 300 * level * 1.5


def test_nothing_is_certified_on_few_rows():
    assert quality.certify([0] * 5, [3] * 5, 10, [1, 2, 3, 4, 5], 0.01, 0.01) is None


def table(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(3000):
        w = [rng.choice(words) for _ in range(30)]
        kind = i % 10
        if kind == 0:
            w = [x + "###" for x in w]
        if kind == 1:
            w[rng.randrange(30)] = "vileword"
        rows.append((i, " ".join(w), "en" if i % 3 else None, "extra"))
        labels.append((i, int(kind != 0), int(kind == 1)))
    rows += [(None, None, "en", "x"), (3001, "short", "en", "x"), (5, rows[5][1], None, "extra")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words string"), spark.createDataFrame(labels + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")


def test_bad_goes_and_good_stays(spark):
    docs, labels = table(spark)
    got = {r["doc_id"]: r for r in quality.assess(docs, labels).collect()}
    assert not any(got[i]["kept"] for i in range(3000) if i % 10 in (0, 1))
    assert all(got[i]["kept"] for i in range(3000) if i % 10 > 1)
    assert got[None]["n_words"] == 0 and got[3001]["base_failed"] and not got[3001]["kept"]
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 2401


def test_empty_tables(spark):
    docs, labels = table(spark)
    assert quality.assess(docs.limit(0), labels).collect() == []
    assert quality.assess(docs, labels.limit(0)).where("kept").count() == 3001

"""Decontamination against brute force."""

import hashlib
import random
import re

import pytest

from veilgraph.llm import decontam


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size=10):
    out = {}
    for d, text in docs:
        w, hit, own = words(text), set(), set()
        for i, item in items:
            v = words(item)
            for win in {tuple(v[k : k + size]) for k in range(max(1, len(v) - size + 1))} if v else ():
                for p in range(len(w) - len(win) + 1):
                    if tuple(w[p : p + len(win)]) == win:
                        hit.update(range(p, p + len(win)))
                        own.add("" if i is None else str(i))
        out[d] = (len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit))
    return out


def cases():
    rng = random.Random(5)
    vocab = ["Ab", "cd", "é", "x9", "the", "of", "Ö", "zz"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.choice([0, 1, 3, 9, 10, 11, 25]))) for i in range(12)] + [(12, None), (None, say(14)), (3, "the of"), (20, say(10))]
    docs = [(100, None), (101, ""), (102, "... !")]
    for k in range(60):
        parts = [say(rng.randint(0, 30))]
        if k % 2:
            t = rng.choice(items)[1] or ""
            parts += [t.upper() if k % 4 == 1 else ", ".join(t.split()), say(5)]
        docs.append((k, " ".join(parts)))
    docs += [(200, (items[6][1] + " ") * 3), (201, "q" * 200_000 + " the of")]
    return docs, items


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 200])
def test_equals_brute_force(spark, block):
    docs, items = cases()
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_words string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    rows = decontam.decontaminate(d, b, block_bytes=block).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows}
    assert len(rows) == len(docs) and got == brute(docs, items)


def test_removal_keeps_columns_and_repeats(spark):
    d = spark.createDataFrame([(1, "a b c", None), (1, "a b c", None), (2, "x a b", "k"), (None, None, "k")], "doc_id long, text string, __n string")
    b = spark.createDataFrame([(1, "x a")], "item_id long, text string")
    out = decontam.remove_contaminated(d, b)
    assert out.columns == d.columns and sorted(map(str, out.collect())) == sorted(map(str, d.where("doc_id = 1 OR doc_id IS NULL").collect()))


def test_empty_tables(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(d, b).collect() == []
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert [r["contaminated"] for r in decontam.decontaminate(one, b).collect()] == [False]

"""Personal data against plain regular expressions, and disclosure on a small corpus."""

import hashlib
import random
import re

import pytest

from veilgraph.llm import pii

RX = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    out = [(m.start(), i, m.end(), k) for i, (k, rx) in enumerate(RX.items()) for m in re.finditer(rx, text or "") if valid(k, m.group())]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


def texts():
    rng = random.Random(11)
    bits = ["a@b.c", "@", ".", "1", "22", "333", "4539 1488 0343 6467", "4539-1488", " ", "  ", "-", "+", "+1 (304) 555-0123", "(", ")", "é", "😀", "255.1.2.3", "1.2.3.4.5.6.7.8", "x_y%z@q-r.s", "+x@d.e", "0", "\n", "256.1.1.1", "4111111111111111"]
    return [None, "", "a@b.c+x@d.e", "1 " * 40, "4111 1111 1111 1111 4111111111111111", "x" * 50_000 + "a@b.c", "1.2.3.4 " * 700, *["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(400)]]


def test_base_spans_equal_plain_patterns(spark):
    rows = spark.createDataFrame(list(enumerate(texts())), "doc_id int, text string")
    got = {r["doc_id"]: r for r in pii.find_personal_data(rows).collect()}
    for i, t in enumerate(texts()):
        want = brute(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (t, want, got[i]["spans"])
        assert [got[i][f"n_{k}"] for k in RX] == [sum(x.startswith(k) for x in want) for k in RX]


def corpus():
    rng = random.Random(2)
    common = ["the", "and", "river", "stone", "green", "walked", "under", "bridge"]
    rows = [" ".join(rng.choice(common) for _ in range(40)) for _ in range(200)]
    for k in range(6):
        filler = " ".join(rng.choice(common) for _ in range(3))
        rows[k] = f"{filler} Quentin zorblax {rng.choice(common)} q.z@mail.example.com stone {filler}"
    rows[10] = "stone Zorblax walked alone under the bridge"
    return rows


@pytest.mark.parametrize("literal", [4000, -1])
def test_disclosing_terms(spark, monkeypatch, literal):
    monkeypatch.setattr(pii, "LITERAL", literal)
    rows = spark.createDataFrame(list(enumerate(corpus())), "doc_id int, text string")
    found = {r["term"]: r["mark"] for r in pii.disclosing_terms(rows).collect()}
    assert {"quentin", "zorblax"} <= set(found) and not set(found) & {"the", "river", "stone"}
    marked = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(rows).collect()}
    assert "term:6:13" in marked[10] and marked[50] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(rows).collect()}
    assert "@" not in clean[0] and "Quentin" not in clean[0] and clean[50] == corpus()[50]


def test_marks_are_the_same_beyond_the_literal_list(spark, monkeypatch):
    texts = [*corpus(), *[f"question {k} under the bridge" for k in range(30)], "QUENTIN walked alone", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = []
    for literal in (4000, -1):
        monkeypatch.setattr(pii, "LITERAL", literal)
        out.append({r["doc_id"]: r["text"] for r in pii.sanitise(rows).collect()})
    assert out[0][len(texts) - 3] == "que* walked alone"
    assert out[0] == out[1]


def test_sanitise_keeps_columns_and_nulls(spark):
    d = spark.createDataFrame([(1, "mail a@b.c now +1 (304) 555-0123!", "n", 3), (2, None, None, None), (1, "same", "n", 3)], "doc_id int, text string, kind string, e int")
    out = pii.sanitise(d)
    assert out.columns == d.columns
    assert sorted(str(r["text"]) for r in out.collect()) == ["None", "mail [email] now [phone]!", "same"]
    assert pii.sanitise(d.limit(0)).count() == 0


def test_clashing_columns_hold_no_raw_text(spark):
    names = ["__text", "__base", "__hits", "__in", "__marks", "__row", "__cut", "key"]
    d = spark.createDataFrame([(1, "write to zed@corp.example.com please", *names)], "doc_id int, text string, " + ", ".join(f"`{c}` string" for c in names))
    for literal in (4000, -1):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(pii, "LITERAL", literal)
            out = pii.sanitise(d)
            assert out.columns == d.columns and tuple(out.first()) == (1, "write to [email] please", *names)


def test_chance_gives_no_terms_and_addresses_give_their_names(spark):
    few = [f"note {k} ask about it at zed@corp.example.com please" for k in range(3)]
    rows = spark.createDataFrame(list(enumerate([*few, "plain words", None])), "doc_id int, text string")
    assert pii.disclosing_terms(rows).collect() == []
    once = [*corpus()[20:], "stone Wilmar walked, wilmar.k@mail.example.com under the bridge"]
    rows = spark.createDataFrame(list(enumerate(once)), "doc_id int, text string")
    assert {r["term"] for r in pii.disclosing_terms(rows).collect()} == {"wilmar"}


def test_shared_parts_are_protected(spark):
    rng = random.Random(5)
    common = [x for x in corpus()[50].split()]
    texts = [" ".join(rng.choice(common) for _ in range(40)) for _ in range(300)]
    for k in range(8):
        texts[k] += f" staff{k}@quorl.example.org {rng.choice(common)} Quorlsoft {rng.choice(common)}"
    found = {r["term"] for r in pii.disclosing_terms(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert found == {"quorlsoft"}


def test_main_path_is_native(spark):
    rows = spark.createDataFrame(list(enumerate(corpus())), "doc_id int, text string")
    plan = pii.find_personal_data(rows)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.split("== Physical Plan ==")[-1])

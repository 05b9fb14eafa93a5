"""Content-defined chunks resist insertions; repeated passages are found and removed."""

import random

from veilgraph.llm import chunkdedup


def say(rng, n):
    return " ".join("".join(rng.choice("abcdefgh é") for _ in range(rng.randint(2, 9))).replace(" ", "i") for _ in range(n))


def test_borders_cover_and_resist_insertions():
    rng = random.Random(3)
    text = say(rng, 3000).encode()
    ends = chunkdedup.borders(text).tolist()
    assert ends[-1] == len(text) and ends == sorted(set(ends))
    pieces = {text[a:b] for a, b in zip([0, *ends], ends, strict=False)}
    moved = b"inserted " + text[:7000] + b" and here " + text[7000:]
    cut = chunkdedup.borders(moved).tolist()
    again = [moved[a:b] for a, b in zip([0, *cut], cut, strict=False)]
    assert sum(len(x) for x in again if x in pieces) > 0.97 * len(text)
    for odd in (b"a" * 5000, b"x", bytes(range(33, 127)) * 40):
        ends = chunkdedup.borders(odd)
        assert ends[-1] == len(odd) and max(ends[0], *(ends[1:] - ends[:-1]), 0) <= chunkdedup.MOST


def docs(spark):
    rng = random.Random(8)
    passage = say(rng, 70)
    rows = [(i, say(rng, 150), "q") for i in range(60)]
    for i in range(0, 60, 6):
        rows[i] = (i, f"{say(rng, 30)} {passage} {say(rng, 30)}", "q")
    rows += [(100, None, "q"), (101, "", "q"), (102, "tiny", "q"), (103, say(random.Random(1), 90), "q"), (103, say(random.Random(1), 90), "q")]
    return spark.createDataFrame(rows, "doc_id int, text string, n_chunks string"), rows, passage


def test_passages_are_found_once(spark):
    d, rows, passage = docs(spark)
    got = chunkdedup.find_repeats(d, with_text=True).collect()
    assert len(got) == len(rows)
    text_of = {i: t for i, t, _ in rows}
    hit = {r["doc_id"] for r in got if r["has_repeats"]}
    assert hit == {*range(0, 60, 6), 103}
    kept = [r for r in got if r["doc_id"] in range(0, 60, 6) and r["removed_chars"] == 0]
    assert len(kept) == 1
    for r in got:
        if r["doc_id"] in range(0, 60, 6):
            a, b = (int(x) for x in r["passages"].split(":"))
            assert text_of[r["doc_id"]][a:b].strip() in passage or len(set(text_of[r["doc_id"]][a:b]) - set(passage)) == 0
            assert len(text_of[r["doc_id"]][a:b].split()) > 45
        assert len(r["clean_text"] or "") == len(text_of[r["doc_id"]] or "") - r["removed_chars"]
    twins = sorted(r["removed_chars"] for r in got if r["doc_id"] == 103)
    assert twins[0] == 0 and twins[1] == len(text_of[103])


def test_empty_table(spark):
    d, _, _ = docs(spark)
    assert chunkdedup.find_repeats(d.limit(0)).collect() == []


def test_repeated_chunks_equal_brute_force(spark):
    """Per text: chunks, and those in runs of enough words of chunks that occur elsewhere, counted in plain Python."""
    import itertools
    from collections import Counter

    d, rows, _ = docs(spark)
    cut = []
    for _, text, _ in rows:
        raw = (text or "").encode()
        ends = chunkdedup.borders(raw).tolist() if raw else []
        cut.append([raw[a:b] for a, b in zip([0, *ends], ends, strict=False)])
    seen = Counter(x for own in cut for x in own)
    want = []
    for (i, text, _), own in zip(rows, cut, strict=True):
        n, at, raw = 0, 0, (text or "").encode()
        starts = {m for m in range(len(raw)) if not raw[m : m + 1].isspace() and (m == 0 or raw[m - 1 : m].isspace())}
        for twice, run in itertools.groupby(own, key=lambda x: seen[x] > 1):
            run = list(run)
            size = sum(map(len, run))
            if twice and len(starts & set(range(at, at + size))) >= chunkdedup.WORDS:
                n += len(run)
            at += size
        want.append((i, len(own), n))
    got = chunkdedup.find_repeats(d).select("doc_id", "n_chunks", "n_repeated_chunks").collect()
    assert sorted(map(tuple, got)) == sorted(want) and any(n for *_, n in want)

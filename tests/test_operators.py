"""Segmentation, resolution, rules, arbitration and artifact on small transcripts of our own."""

import random

import pytest
from pyspark.sql import functions as F

from veilgraph.operators import entities, rules, text
from veilgraph.plans import arbitration, artifact, build, graph, scoring
from veilgraph.sources import readers
from veilgraph.sources.proposals import answers

TEXT = "INTERVIEWER: Thank you, Mr. Dorsey. Who raised you?\n\nNARRATOR: My sister Ida Dorsey did. She was twelve then. I was born March 4, 1951, in Tulsa. Write me at d@ex.org."


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")


def test_turns_and_sentences_tile(spark):
    d = docs(spark, TEXT, "", "no label. Just text", "\n\nA: x\nB 2: y?")
    for tiles in (text.turns(d), text.sentences(d)):
        rows = {}
        for r in tiles.collect():
            rows.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
        for r in d.collect():
            spans = sorted(rows.get(r["doc_id"], []))
            assert [s for s, _ in spans] == [0, *[e for _, e in spans[:-1]]] if spans else r["text"] == ""
            assert not spans or spans[-1][1] == len(r["text"])


def test_roles_and_mask(spark):
    d = docs(spark, TEXT)
    t = text.turns(d)
    assert [r["role"] for r in t.orderBy("start").collect()] == ["interviewer", "subject"]
    masked = text.subject_mask(d, t).first()["text"]
    assert len(masked) == len(TEXT) and "Thank" not in masked and "My sister" in masked and "NARRATOR" not in masked


def test_overlaps_match_greedy(spark):
    rng = random.Random(3)
    rows = [(f"d{k}", s, s + rng.randint(1, 9), rng.choice([None, 0.5, 0.9])) for k in range(12) for s in (rng.randint(0, 30) for _ in range(12))]
    got = {}
    for r in text.resolve_overlaps(spark.createDataFrame(rows, "doc_id string, start int, end int, score double")).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    for k in {r[0] for r in rows}:
        kept = []
        for _, s, e, _ in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] - r[2], -(r[3] or 0.0), r[1])):
            if all(e <= a or b <= s for a, b in kept):
                kept.append((s, e))
        assert sorted(kept) == sorted(got[k])


def test_windows_stay_in_budget(spark):
    d = docs(spark, "One two three. " * 50, "x" * 300 + ". y.")
    w = text.pack_windows(text.sentences(d), 100).collect()
    assert all(r["end"] - r["start"] <= 100 for r in w if r["doc_id"] == "d0") and sum(r["end"] - r["start"] for r in w) == 750 + 304


def test_tagging_and_excerpt(spark):
    spans = F.expr("array(named_struct('start', 0, 'end', 3, 'tag', 'P1'), named_struct('start', 8, 'end', 11, 'tag', 'P2'))")
    r = spark.range(1).select(text.tag_spans(F.lit("Ann met Bob."), spans).alias("t"), text.blank_spans(F.lit("Ann met Bob."), spans).alias("b"), text.excerpt(F.lit("abcdefgh"), 2, 2).alias("e")).first()
    assert r["t"] == "[P1 Ann] met [P2 Bob]." and r["b"] == "\0\0\0 met \0\0\0." and r["e"] == "ab\n[...]\ngh"


def found(spark, d, *forms):
    rows = spark.createDataFrame([("d0", f, k) for f, k in forms], "doc_id string, form string, entity_type string")
    return text.find_forms(d, rows)


@pytest.fixture(scope="module")
def run(spark):
    d = docs(spark, TEXT).withColumn("interview_date", F.lit("1999-06-01").cast("date"))
    forms = [("Ida Dorsey", "PERSON"), ("Dorsey", "PERSON"), ("twelve", "AGE"), ("March 4, 1951", "DATE_ABSOLUTE"), ("Tulsa", "LOCATION"), ("d@ex.org", "EMAIL")]
    rows = spark.createDataFrame([("Oklahoma", "state", "", ""), ("Tulsa", "city", "Oklahoma", "T-Town|tulsa town")], "name string, type string, parent string, aliases string")
    return build.run(d, found(spark, d.select("doc_id", "text"), *forms), gazetteer=readers.gazetteer_tables(rows))


def test_graph(run):
    assert {(r["relation"], r["detail"]) for r in run.edges.collect()} >= {("RELATED_TO", "sister")}
    names = {(r["field"], r["value"]) for r in run.ledger.where("action = 'keep'").select("field", "value").collect()}
    assert ("resolved_value", "1951-03-04") in names and ("given_name", "Ida") in names and ("value", "12") in names


def test_artifact_and_corruptions(spark, run, tmp_path):
    a = artifact.build(run.transcripts, run.entities, run.mentions, run.values, run.edges, run.blocking, run.flags)
    assert artifact.violations(a, run.transcripts).collect() == []
    artifact.write(a, f"file://{tmp_path}/out", run.transcripts)
    back = readers.artifacts(spark, f"file://{tmp_path}/out")
    assert artifact.violations(back, run.transcripts).collect() == []
    one = back.first().asDict(recursive=True)
    wrong = {
        "version": one | {"graph_version": "9"},
        "dangling edge": one | {"edges": [{"source": "x", "target": "y", "relation": "RELATED_TO", "detail": "", "evidence": ""}]},
        "dangling blocking row": one | {"blocking": [{"entity_id": "x", "field": "f", "reason": "r"}]},
        "no speaker": one | {"interviewee_id": "nobody"},
        "digest": one | {"source": {"sha256": "0", "chars": len(TEXT)}},
        "span": one | {"entities": [e | {"mentions": [m | {"start": m["start"] + 1} for m in e["mentions"]]} for e in one["entities"]]},
    }
    for what, row in wrong.items():
        bad = spark.createDataFrame([row], artifact.SCHEMA)
        assert what in {r["violation"] for r in artifact.violations(bad, run.transcripts).collect()}


def test_fold_precedence(spark):
    values = spark.createDataFrame([("d", "a", "role", "x"), ("d", "b", "role", "y"), ("d", "b", "age", "3")], "doc_id string, entity_id string, field string, value string")
    roots = spark.createDataFrame([("d", "a", "a"), ("d", "b", "a")], "doc_id string, node string, root string")
    read = lambda base: {(r["entity_id"], r["field"]): r["value"] for r in entities.fold_values(values, roots, base).collect()}
    assert read(False) == {("a", "role"): "y", ("a", "age"): "3"} and read(True) == {("a", "role"): "x", ("a", "age"): "3"}


def test_coref_gates(spark):
    m = spark.createDataFrame([("d", "m0", 0, 3, "e1", "F", ["ann"]), ("d", "m1", 10, 13, "e2", "M", ["ann"]), ("d", "m2", 20, 23, "e3", None, ["anna"])], "doc_id string, mention_id string, start int, end int, entity_id string, gender string, tokens array<string>")
    at = spark.createDataFrame([("d", "m0", 0), ("d", "m1", 1), ("d", "m2", 2)], "doc_id string, mention_id string, sent_ix int")
    clusters = spark.createDataFrame([("d", 1, 0, 3), ("d", 1, 10, 13), ("d", 1, 20, 23)], "doc_id string, cluster_id int, start int, end int")
    got = {r["other"]: (r["accepted"], r["reason"]) for r in entities.coref_pairs(clusters, m, at).collect()}
    assert got == {"e2": (False, "genders conflict"), "e3": (True, "names compatible")}


def test_chains_stop_at_cycles(spark):
    e = spark.createDataFrame([("d", "a", "b", 0), ("d", "b", "c", 0), ("d", "c", "a", 0)], "doc_id string, source string, target string, seq int").withColumn("relation", F.lit("LOCATED_IN"))
    got = {(r["node"], r["depth"], r["ancestor"]) for r in graph.chains(e).collect()}
    assert got == {("a", 1, "b"), ("a", 2, "c"), ("b", 1, "c"), ("b", 2, "a"), ("c", 1, "a"), ("c", 2, "b")}


def test_votes_and_cache(spark):
    a = spark.createDataFrame([("d", "e", "f", "x", 2), ("d", "e", "f", "y", 1), ("d", "e", "g", "z", 0), ("d", "e", "g", "z", 3)], "doc_id string, entity_id string, field string, value string, window_ix int")
    assert {(r["field"], r["value"], r["confidence"]) for r in arbitration.votes(a).collect()} == {("f", "y", "low"), ("g", "z", "high")}
    prompts = spark.createDataFrame([("m", "s", "p"), ("m", "s", "p"), ("m", "s", "q")], "model string, system string, prompt string")
    got = answers(prompts, spark.createDataFrame([], "key string"), lambda m, s, p: {"says": p} if p == "p" else None).collect()
    assert [r["answer"] for r in got] == ['{"says": "p"}']


def test_owner_cases(spark):
    cases = {"I was fourteen.": ["interviewee"], "My daughter June was maybe fourteen.": ["other"], "She was a child of fourteen.": ["other"], "It was fourteen.": []}
    d = docs(spark, *[f"Q: my own fourteen cents\n\nA: {c}" for c in cases])
    forms = d.select("doc_id", F.lit("fourteen").alias("form"), F.lit("AGE").alias("entity_type"))
    m = build.all_entities(text.number_mentions(text.find_forms(d, forms))).where("start > 25")
    t = text.turns(d)
    got = {r["doc_id"]: r["survivors"] for r in rules.owner_evidence(m, text.clipped_sentences(text.sentences(d), t), d).collect()}
    assert [got.get(f"d{i}", []) for i in range(len(cases))] == list(cases.values())


def test_readers(spark, tmp_path):
    (tmp_path / "one.txt").write_text("Ann left.", encoding="utf-8")
    (tmp_path / "one.json").write_text('{"transcript_id": "one", "detections": [{"start": 0, "end": 3, "entity_type": "PERSON", "text": "Ann"}, {"start": 1, "end": 3, "entity_type": "PERSON", "text": "Ann"}]}', encoding="utf-8")
    (tmp_path / "meta.json").write_text('{"one": {"interview_date": "1999-02-03"}}', encoding="utf-8")
    d, f = readers.stage_inputs(spark, f"{tmp_path}/*.txt", f"{tmp_path}/one.json", f"{tmp_path}/meta.json")
    assert [(r["doc_id"], r["text"], str(r["interview_date"])) for r in d.collect()] == [("one", "Ann left.", "1999-02-03")]
    assert [r["reason"] for r in text.validate_detections(f, d.select("doc_id", "text")).collect()] == ["span does not match"]
    places, aliases = readers.gazetteer(spark, f"file://{tmp_path}/none.csv")
    assert places.count() == aliases.count() == 0


def test_hierarchy_scores(spark):
    rows = lambda *x: spark.createDataFrame([("d", *r) for r in x], "doc_id string, node string, parent string")
    chains = spark.createDataFrame([("d", "a", 1, "b"), ("d", "a", 2, "c")], "doc_id string, node string, depth int, ancestor string")
    assert tuple(scoring.hierarchy(rows(("a", "b"), ("e", "f")), rows(("a", "c"), ("g", "h")), chains).first()) == (0, 1, 1, 1)


def test_long_chains_have_no_cap(spark):
    n = 300
    e = spark.range(n).select(F.lit("d").alias("doc_id"), F.format_string("n%04d", "id").alias("source"), F.format_string("n%04d", F.col("id") + 1).alias("target"), F.lit("LOCATED_IN").alias("relation"), F.lit(0).alias("seq"))
    got = graph.chains(e).groupBy("node").agg(F.max("depth").alias("n"), F.count("*").alias("rows"), F.count_distinct("ancestor").alias("kinds")).collect()
    assert {r["node"]: (r["n"], r["rows"], r["kinds"]) for r in got} == {f"n{i:04}": (n - i, n - i, n - i) for i in range(n)}


def test_as_of(spark):
    rows = spark.createDataFrame([("d", 0, "a"), ("d", 5, "b"), ("e", 3, "c")], "doc_id string, start int, x string")
    points = spark.createDataFrame([("d", 4), ("d", 5), ("d", 99), ("e", 2), ("f", 1)], "doc_id string, pos int")
    assert {tuple(r) for r in text.as_of(points, rows, "pos", "start", ["x"]).collect()} == {("d", 4, "a"), ("d", 5, "b"), ("d", 99, "b"), ("e", 2, None), ("f", 1, None)}


def test_decisions_of_owners_places_and_ages(spark):
    d = docs(spark, "A: I was fourteen then. We left France. Alma was twelve years old.").withColumn("interview_date", F.lit("1999-06-01").cast("date"))
    forms = found(spark, d, ("fourteen", "AGE"), ("twelve years old", "AGE"), ("France", "LOCATION"), ("Alma", "PERSON"))
    places = spark.createDataFrame([("France", "country", "", "")], "name string, type string, parent string, aliases string")
    g = build.run(d, forms, gazetteer=readers.gazetteer_tables(places))
    texts = {r["entity_id"]: r["text"] for r in g.mentions.collect()}
    got = {(texts.get(r["entity_id"]), r["field"]): (r["action"], r["value"], r["failed"]) for r in g.ledger.collect()}
    assert got["fourteen", "owner"] == ("keep", "interviewee", [])
    assert got["France", "subtype_location"][:2] == ("keep", "country") and got["France", "replace_location"] == ("keep", "false", [])
    assert got["twelve years old", "replace_age"][1] == "true" and got["twelve years old", "owner"][1] != "interviewee"
    assert {r["source"] for r in g.edges.where("relation = 'ATTRIBUTE_OF'").collect()} == {k for k, v in texts.items() if v == "fourteen"}


def test_kinship_owners(spark):
    d = docs(spark, "A: I had an older sister named Alma.", "A: Boyd came. He had a brother named Carl.", "A: My mother's sister Edna left.")
    m = build.all_entities(text.number_mentions(text.find_forms(d, spark.createDataFrame([(f"d{i}", f, "PERSON") for i, f in ((0, "Alma"), (1, "Boyd"), (1, "Carl"), (2, "Edna"))], "doc_id string, form string, entity_type string"))))
    names = {r["entity_id"]: r["text"] for r in m.collect()}
    got = {(r["doc_id"], names.get(r["source"], "speaker"), names[r["target"]], r["detail"]) for r in rules.kinship(d, m, build.speakers(d)).collect()}
    assert got == {("d1", "Boyd", "Carl", "brother"), ("d2", "speaker", "Edna", "mother's sister")}


def test_alias_cues_of_every_kind(spark):
    d = docs(spark, "They called Clara 'Dot'.", "We knew him as Big Jim Doe Roe.", "His real name was Carl.", "He went by Skip then.", "She was nicknamed “Bee”. Nobody called.", None, "")
    got = {(r["doc_id"], r["cue"], r["subject"], r["alias"], r["alias_end"] - r["alias_start"]) for r in entities.alias_cues(d).collect()}
    assert got == {("d0", "call", "Clara", "Dot", 3), ("d1", "as", "him", "Big Jim Doe", 11), ("d2", "real", "His", "Carl", 4), ("d3", "by", None, "Skip", 4), ("d4", "nick", None, "Bee", 3)}


def test_plans_hold_an_expression_once(spark):
    from veilgraph.functions.spans import regex_spans
    from veilgraph.operators import checks

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    texts = spark.range(3).select(F.col("id").cast("string").alias("text"))
    assert plan(texts.select(regex_spans(F.col("text"), "needle").alias("x"))).count("needle") == 2
    keys = "doc_id string, entity_id string, field string"
    cands = spark.createDataFrame([("d", "e", "gender", "PERSON", "Ann", "F", None, True)], f"{keys}, category string, text string, rule string, llm string, llm_ran boolean")
    context = spark.createDataFrame([("d", "e", "gender", "F", ["Ann"])], f"{keys}, value string, forms array<string>")
    own = checks.outcomes(context, ["gender"])
    assert own.collect() == checks.outcomes(context).collect()
    assert "not_refuted_by_pronoun" in plan(own) and "plausible_range" not in plan(own)
    found = arbitration.arbitrate(cands, spark.createDataFrame(own.collect(), own.schema))
    assert [(r["action"], r["value"]) for r in found.collect()] == [("keep", "F")]
    assert plan(found).count("spring|summer") <= 2


def test_tables_that_grow_are_merged(spark, monkeypatch):
    plans = {}

    def noted(df, label, write=build.step):
        plans.setdefault(label, "")
        plans[label] += df._jdf.queryExecution().executedPlan().toString()
        return write(df, label)

    monkeypatch.setattr(build, "step", noted)
    d = docs(spark, "A: I was fourteen then. My sister Alma left on March 4, 1951.").withColumn("interview_date", F.lit("1999-06-01").cast("date"))
    g = build.run(d, found(spark, d, ("fourteen", "AGE"), ("Alma", "PERSON"), ("March 4, 1951", "DATE_ABSOLUTE")))
    assert {r["relation"] for r in g.edges.collect()} == {"RELATED_TO", "STATED_WITH", "ATTRIBUTE_OF"}
    # The field map and policies are of fixed size; joins of joins count as the product of their sides, small on one document only.
    assert {k for k, p in plans.items() if "BroadcastExchange" in p} <= {"entities", "context", "candidates", "outcomes", "ledger"}

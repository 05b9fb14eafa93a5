"""Streaming ingestion over a folder."""

from veilgraph.operators import text
from veilgraph.streaming import ingest


def test_new_files_become_turns(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("Q: Hello?\n\nA: Hi.", encoding="utf-8")
    seen = []
    stream = ingest.transcript_stream(spark, f"file://{tmp_path}/in")
    q = ingest.process(stream, lambda df, _: seen.extend(text.turns(df).collect()), f"file://{tmp_path}/cp")
    q.awaitTermination(120)
    assert [(r["doc_id"], r["role"]) for r in seen] == [("a", "interviewer"), ("a", "subject")]


def test_sessions_assemble_turns(spark):
    rows = spark.createDataFrame([("d", "2020-01-01 10:00:00", 1, "A: one"), ("d", "2020-01-01 10:05:00", 2, "B: two"), ("d", "2020-01-01 12:00:00", 3, "A: late")], "doc_id string, ts string, seq int, text string")
    got = ingest.assemble_turns(rows.selectExpr("doc_id", "cast(ts as timestamp) ts", "seq", "text")).orderBy("started").collect()
    assert [r["text"] for r in got] == ["A: one\n\nB: two", "A: late"]

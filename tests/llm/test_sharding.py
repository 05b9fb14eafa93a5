"""Sharding: contiguous, near equal, whole."""

import zlib

from veilgraph.llm import sharding


def test_shards_are_contiguous_and_balanced(spark):
    texts = [None, "", "é", *["x" * (i * 37 % 900) for i in range(500)]]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id int, text string, size int").repartition(5)
    rows = sharding.shard_report(d).collect()
    assert len(rows) == len(texts)
    total, most = 0, max(len((t or "").encode()) + 1 for t in texts)
    per = {}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes" and r["grown_shard"] is None
        total += r["size"]
        per.setdefault(r["shard"], []).append((r["slot"], r["size"]))
    assert set(per) == set(range(8))
    for own in per.values():
        assert sorted(s for s, _ in own) == list(range(len(own)))
        assert abs(sum(n for _, n in own) - total / 8) <= most


def test_edge_cases(spark):
    d = spark.createDataFrame([(None, None), (None, None), (1, "x" * 100_000)], "doc_id long, text string")
    rows = sharding.shard_report(d).collect()
    assert len(rows) == 3 and {r["shard"] for r in rows} <= set(range(8))
    assert sharding.shard_report(d.limit(0)).collect() == []


def test_written_shards_hold_every_row(spark, tmp_path):
    d = spark.createDataFrame([(i, "t" * i) for i in range(50)], "doc_id int, text string")
    path = sharding.write_shards(d, sharding.text_size(), 4, f"file://{tmp_path}/s")
    back = spark.read.parquet(path)
    assert back.count() == 50 and back.select("__shard").distinct().count() == 4


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    from veilgraph.llm import sharding

    d = spark.createDataFrame([(1, "ab", "x", "y"), (2, None, "z", "w")], "doc_id int, text string, `__size` string, `__part` string")
    out = sharding.assign_shards(d, sharding.text_size(), 2)
    assert out.columns == [*d.columns, "___size", "__shard", "__slot"]
    assert {tuple(r)[:5] for r in out.collect()} == {(1, "ab", "x", "y", 3), (2, None, "z", "w", 1)}

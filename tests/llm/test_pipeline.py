"""The pipeline as a whole, on the smallest tables."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now, n = docs, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns
        left = now.count()
        assert 0.5 * n < left <= n
        n = left


def test_run_packs_what_is_left(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    per = {}
    for r in rows:
        per.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in per.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0


def test_stage_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "personal_data", "pack"]


def test_stages_keep_clashing_columns(spark):
    """Columns named as operators name their own come through every stage as they were."""
    from pyspark.sql import functions as F

    names = ["__spans", "__items", "__n_words", "__row", "__text", "__size", "__thash", "__part", "__c0", "__lexicon_odds"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).select("*", *[F.concat(F.lit(n), "doc_id").alias(n) for n in names])
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns
        rows = now.collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)


def test_empty_and_null_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    none = docs.limit(0)
    nulls = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0)], docs.schema)
    for now in (none, nulls):
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF)
        assert now.collect() == []

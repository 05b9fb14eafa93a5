"""Scoring against gold annotations. A gold row without an entity counts in the dangerous direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgraph.functions import scalar as S


def count_if(c: Column, name: str) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False))).alias(name)


def gold_entities(rows: DataFrame, mentions: DataFrame) -> DataFrame:
    """Gold rows(doc_id, text, ...) with entity_id of the mentions that read the same, letter case aside."""
    own = mentions.select("doc_id", F.lower("text").alias("__k"), "entity_id").distinct()
    return rows.withColumn("__k", F.lower("text")).join(own, ["doc_id", "__k"], "left").drop("__k")


def clustering(gold_forms: DataFrame, mentions: DataFrame) -> DataFrame:
    """One row: exact, over_merged, split, missing among gold people(doc_id, canonical, form)."""
    hit = gold_entities(gold_forms.withColumnRenamed("form", "text"), mentions)
    per = hit.groupBy("doc_id", "canonical").agg(F.count_distinct("entity_id").alias("n"), F.collect_set("entity_id").alias("ids"))
    shared = hit.where("entity_id IS NOT NULL").groupBy("doc_id", "entity_id").agg((F.count_distinct("canonical") > 1).alias("over"))
    over = hit.join(shared, ["doc_id", "entity_id"]).groupBy("doc_id", "canonical").agg(F.bool_or("over").alias("over"))
    rows = per.join(over, ["doc_id", "canonical"], "left").withColumn("over", F.coalesce("over", F.lit(False)))
    return rows.agg(F.count("*").alias("gold"), count_if((F.col("n") == 1) & ~F.col("over"), "exact"), count_if(F.col("over"), "over_merged"), count_if(F.col("n") > 1, "split"), count_if(F.col("n") == 0, "missing"))


def relations(gold: DataFrame, predicted: DataFrame, keys: tuple[str, ...] = ("doc_id", "source", "target")) -> DataFrame:
    """One row for each layer of predicted(keys, detail, layer) and 'all': tp, fp, missed, detail_ok."""
    layers = predicted.select(*keys, "detail", F.explode(F.array("layer", F.lit("all"))).alias("layer")).dropDuplicates([*keys, "layer"])
    every = layers.select("layer").distinct()
    g = gold.select(*keys, F.col("detail").alias("gold_detail")).dropDuplicates(list(keys)).join(F.broadcast(every))
    j = g.join(layers, [*keys, "layer"], "full_outer")
    return j.groupBy("layer").agg(
        count_if(F.col("gold_detail").isNotNull() & F.col("detail").isNotNull(), "tp"),
        count_if(F.col("gold_detail").isNull(), "fp"),
        count_if(F.col("detail").isNull(), "missed"),
        count_if(S.kin_canon(F.col("gold_detail")) == S.kin_canon(F.col("detail")), "detail_ok"),
    )


def three_way(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """One row: correct, wrong (also where gold has none), missing."""
    g, p = F.col(gold), F.col(predicted)
    return rows.agg(count_if(F.lower(g) == F.lower(p), "correct"), count_if(p.isNotNull() & ~F.lower(g).eqNullSafe(F.lower(p)), "wrong"), count_if(p.isNull() & g.isNotNull(), "missing"))


def redaction(rows: DataFrame) -> DataFrame:
    """One row from rows(gold_replace, replace; NULL where there is no entity): leaks and over-redactions apart."""
    g, p = F.col("gold_replace"), F.coalesce("replace", F.lit(False))
    return rows.agg(F.count("*").alias("gold"), count_if(g & ~p, "leaks"), count_if(~g & p, "over_redacted"), count_if(g == p, "correct"), count_if(g, "gold_pos"), count_if(~g, "gold_neg"))


def dates(rows: DataFrame) -> DataFrame:
    """One row from rows(gold_resolved, tolerance_days, expect_flag, resolved, entity_id)."""
    near = F.abs(F.date_diff("resolved", "gold_resolved")) <= F.coalesce("tolerance_days", F.lit(0))
    flag = F.coalesce("expect_flag", F.lit(False))
    ok = F.when(flag, F.col("resolved").isNull()).otherwise(near)
    return rows.agg(F.count("*").alias("gold"), count_if(ok, "correct"), count_if(F.col("entity_id").isNull(), "no_entity"))


def ages(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row from rows(keys, gold_value, tolerance, value): the best candidate of each gold row counts."""
    gap = F.abs(F.col("value") - F.col("gold_value"))
    best = rows.groupBy(*keys, "gold_value", "tolerance").agg(F.min(gap).alias("gap"))
    return best.agg(F.count("*").alias("gold"), count_if(F.col("gap") <= F.coalesce("tolerance", F.lit(0)), "correct"))


def hierarchy(gold: DataFrame, predicted: DataFrame, gold_chains: DataFrame) -> DataFrame:
    """One row for parents(doc_id, node, parent): exact, coarse (a true ancestor), missed, false_positive."""
    j = gold.select("doc_id", "node", F.col("parent").alias("g")).join(predicted.select("doc_id", "node", F.col("parent").alias("p")), ["doc_id", "node"], "full_outer")
    true = gold_chains.select("doc_id", "node", F.col("ancestor").alias("p"), F.lit(True).alias("above")).distinct()
    j = j.join(true, ["doc_id", "node", "p"], "left")
    return j.agg(count_if(F.col("g") == F.col("p"), "exact"), count_if((F.col("g") != F.col("p")) & F.col("above"), "coarse"), count_if(F.col("p").isNull() & F.col("g").isNotNull(), "missed"), count_if(F.col("p").isNotNull() & ~F.coalesce(F.col("g") == F.col("p"), F.lit(False)) & F.col("above").isNull(), "false_positive"))


def ledger_histogram(ledger: DataFrame) -> DataFrame:
    """(field, label, n) and over all fields (field NULL); rejects are refuted or blind."""
    label = F.when(F.col("action") == "reject", F.when(F.size("failed") > 0, "reject_refuted").otherwise("reject_blind")).otherwise(F.col("action"))
    return ledger.withColumn("label", label).groupingSets([["field", "label"], ["label"]], "field", "label").agg(F.count("*").alias("n"))


def micro_average(metrics: DataFrame, by: str = "metric") -> DataFrame:
    """metrics(by, num, den) summed before the ratio; NULL where there is nothing to divide by."""
    return metrics.groupBy(by).agg(F.sum("num").alias("num"), F.sum("den").alias("den")).withColumn("ratio", F.try_divide("num", "den"))


def class_balance(rows: DataFrame, flag: str) -> DataFrame:
    return rows.agg(count_if(F.col(flag), "gold_pos"), count_if(~F.col(flag), "gold_neg"))

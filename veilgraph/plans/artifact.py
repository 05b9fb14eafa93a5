"""The artifact: a validated, digest-pinned graph document for each transcript."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.functions.spans import cut

VERSION = "0.2"
SCHEMA = (
    "graph_version string, transcript_id string, source struct<sha256:string,chars:int>, interview_date string, interviewee_id string, "
    "blocking array<struct<entity_id:string,field:string,reason:string>>, "
    "entities array<struct<entity_id:string,category:string,subtype:string,attributes:map<string,string>,mentions:array<struct<mention_id:string,start:int,end:int,text:string,entity_type:string>>,needs_review:boolean,review_reason:string>>, "
    "edges array<struct<source:string,target:string,relation:string,detail:string,evidence:string>>"
)
_KEYS = ("graph_version", "transcript_id", "source", "interviewee_id", "blocking", "entities", "edges")


def build(transcripts: DataFrame, entities: DataFrame, mentions: DataFrame, values: DataFrame, edges: DataFrame, blocking: DataFrame, flags: DataFrame) -> DataFrame:
    """One row for each transcript in SCHEMA. entities(doc_id, entity_id, category, subtype); the speaker is category SPEAKER."""
    m = mentions.groupBy("doc_id", "entity_id").agg(F.array_sort(F.collect_list(F.struct("start", "mention_id", "end", "text", "entity_type"))).alias("ms"))
    m = m.select("doc_id", "entity_id", F.transform("ms", lambda x: F.struct(x["mention_id"].alias("mention_id"), x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), x["text"].alias("text"), x["entity_type"].alias("entity_type"))).alias("mentions"))
    a = values.where("value IS NOT NULL").dropDuplicates(["doc_id", "entity_id", "field"]).groupBy("doc_id", "entity_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("attributes"))
    empty = F.array().cast("array<struct<mention_id:string,start:int,end:int,text:string,entity_type:string>>")
    rows = entities.join(m, ["doc_id", "entity_id"], "left").join(a, ["doc_id", "entity_id"], "left").join(flags, ["doc_id", "entity_id"], "left")
    one = F.struct("entity_id", "category", "subtype", F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes"), F.coalesce("mentions", empty).alias("mentions"), F.col("reason").isNotNull().alias("needs_review"), F.coalesce("reason", F.lit("")).alias("review_reason"))
    own = rows.select("doc_id", "category", "entity_id", one.alias("e")).groupBy("doc_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("entity_id", F.col("e").dropFields("attributes").alias("k"), F.to_json("e.attributes").alias("j")))), lambda x: F.struct(x["entity_id"], x["k"]["category"].alias("category"), x["k"]["subtype"].alias("subtype"), F.from_json(x["j"], "map<string,string>").alias("attributes"), x["k"]["mentions"].alias("mentions"), x["k"]["needs_review"].alias("needs_review"), x["k"]["review_reason"].alias("review_reason"))).alias("entities"),
        F.min(F.when(F.col("category") == "SPEAKER", F.col("entity_id"))).alias("interviewee_id"),
    )
    e = edges.select("doc_id", F.struct("source", "target", "relation", "detail", F.coalesce("evidence", F.lit("")).alias("evidence")).alias("x")).groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("edges"))
    b = blocking.select("doc_id", F.struct("entity_id", "field", "reason").alias("x")).groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("blocking"))
    out = transcripts.join(own, "doc_id").join(e, "doc_id", "left").join(b, "doc_id", "left")
    return out.select(
        F.lit(VERSION).alias("graph_version"),
        F.col("doc_id").alias("transcript_id"),
        F.struct(F.sha2("text", 256).alias("sha256"), F.length("text").alias("chars")).alias("source"),
        F.col("interview_date").cast("string").alias("interview_date") if "interview_date" in transcripts.columns else F.lit(None).cast("string").alias("interview_date"),
        "interviewee_id",
        F.coalesce("blocking", F.array().cast("array<struct<entity_id:string,field:string,reason:string>>")).alias("blocking"),
        "entities",
        F.coalesce("edges", F.array().cast("array<struct<source:string,target:string,relation:string,detail:string,evidence:string>>")).alias("edges"),
    )


def violations(artifacts: DataFrame, transcripts: DataFrame | None = None) -> DataFrame:
    """(transcript_id, violation): version, missing keys, ids, edge and blocking references, speaker, digest, spans."""
    ids = F.transform("entities", lambda e: e["entity_id"])
    found = [
        F.when(~F.col("graph_version").eqNullSafe(F.lit(VERSION)), "version"),
        *[F.when(F.col(k).isNull(), f"missing {k}") for k in _KEYS if k != "graph_version"],
        F.when(F.size(F.array_distinct(ids)) < F.size(ids), "duplicate entity id"),
        F.when(F.exists("edges", lambda e: ~F.array_contains(ids, e["source"]) | ~F.array_contains(ids, e["target"])), "dangling edge"),
        F.when(F.exists("blocking", lambda b: ~F.array_contains(ids, b["entity_id"])), "dangling blocking row"),
        F.when(~F.array_contains(ids, F.col("interviewee_id")), "no speaker"),
    ]
    rows = artifacts
    if transcripts is not None:
        rows = rows.join(transcripts.select(F.col("doc_id").alias("transcript_id"), F.col("text").alias("__text")), "transcript_id", "left")
        every = F.flatten(F.transform("entities", lambda e: e["mentions"]))
        found += [
            F.when(F.sha2("__text", 256) != F.col("source.sha256"), "digest"),
            F.when(F.length("__text") != F.col("source.chars"), "length"),
            F.when(F.exists(every, lambda m: cut(F.col("__text"), m["start"], m["end"]) != m["text"]), "span"),
        ]
    return rows.select("transcript_id", F.explode(F.array_compact(F.array(*found))).alias("violation"))


def write(artifacts: DataFrame, path: str, transcripts: DataFrame | None = None) -> None:
    """Validate, then write one JSON line for each transcript; raises where anything is violated."""
    bad = violations(artifacts, transcripts).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['transcript_id']}: {r['violation']}" for r in bad))
    artifacts.write.mode("overwrite").json(path)


def exit_code(artifacts: DataFrame, failed: int = 0) -> int:
    """0: clean, 2: a field waits for a decision, 1: a document failed."""
    return 1 if failed else 2 if not artifacts.where("size(blocking) > 0").isEmpty() else 0

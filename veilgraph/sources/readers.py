"""Readers: transcripts, detections, metadata, gazetteer, gold annotations, artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DETECTIONS = "transcript_id string, detector_version string, detections array<struct<start:int,end:int,entity_type:string,score:double,text:string,recognizer:string>>"
PERSON = "canonical string, forms array<string>, gender string, replace boolean, subtype string, role string, given_name string, surname string, ethnicity string, note string"
GOLD = (
    "transcript_id string, interview_date string, "
    "interviewee struct<identity:string,forms:array<string>,given_name:string,surname:string,gender:string,ethnicity:string,dob:string,note:string>, "
    "people array<struct<canonical:string,forms:array<string>,gender:string,replace:boolean,subtype:string,role:string,given_name:string,surname:string,ethnicity:string,note:string>>, "
    "relations array<struct<source:string,target:string,detail:string,note:string>>, "
    "dates array<struct<text:string,category:string,resolved:string,tolerance_days:int,expect_flag:boolean,shiftable:boolean,approximate:boolean,owner:string,replace:boolean,note:string>>, "
    "ages array<struct<text:string,value:int,tolerance:int,approximate:boolean,stated_with:string,owner:string,replace:boolean,context:string,expect_flag:boolean,note:string>>, "
    "locations array<struct<text:string,in_gazetteer:boolean,type:string,parent:string,replace:boolean,note:string>>, "
    "identifiers array<struct<text:string,type:string,owner:string,identifying:boolean,note:string>>"
)


def _stem() -> Column:
    return F.url_decode(F.regexp_extract("_metadata.file_path", r"([^/]+?)\.[A-Za-z]+$", 1))


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): one row for each UTF-8 text file; the id is the file's stem."""
    return spark.read.text(path, wholetext=True).select(_stem().alias("doc_id"), F.col("value").alias("text"))


def detections(spark: SparkSession, path: str) -> DataFrame:
    """One row for each detection of the JSON files."""
    rows = spark.read.schema(DETECTIONS).option("multiLine", True).json(path)
    return rows.select(F.col("transcript_id").alias("doc_id"), F.explode("detections").alias("d")).select("doc_id", "d.*")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, interview_date) of a JSON object keyed by document."""
    kind = T.MapType(T.StringType(), T.StructType([T.StructField("interview_date", T.StringType())]))
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("doc_id", "x"))
    return rows.select("doc_id", F.try_to_date("x.interview_date").alias("interview_date"))


def stage_inputs(spark: SparkSession, texts: str, found: str, dates: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Transcripts with interview dates (NULL without metadata), and their detections."""
    docs = transcripts(spark, texts)
    if dates is None:
        docs = docs.withColumn("interview_date", F.lit(None).cast("date"))
    else:
        docs = docs.join(metadata(spark, dates), "doc_id", "left")
    return docs, detections(spark, found)


def gazetteer_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gkey, name, type, parent) and (alias, name_key) of rows(name, type, parent, aliases); the last row of a key stands."""
    rows = rows.withColumn("__n", F.monotonically_increasing_id())

    def last(df: DataFrame, key: str) -> DataFrame:
        w = Window.partitionBy(key).orderBy(F.desc("__n"))
        return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__n")

    places = last(rows.select(F.lower(F.trim("name")).alias("gkey"), F.trim("name").alias("name"), F.lower("type").alias("type"), F.nullif(F.trim("parent"), F.lit("")).alias("parent"), "__n"), "gkey")
    alias = rows.select(F.explode(F.split("aliases", r"\|")).alias("alias"), F.lower(F.trim("name")).alias("name_key"), "__n")
    aliases = last(alias.select(F.lower(F.trim("alias")).alias("alias"), "name_key", "__n").where("alias <> ''"), "alias")
    return places, aliases


def gazetteer(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Gazetteer of a CSV file; empty tables where there is none."""
    kind = "name string, type string, parent string, aliases string"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    rows = spark.read.schema(kind).option("header", True).csv(path) if there else spark.createDataFrame([], kind)
    return gazetteer_tables(rows)


def gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold annotations, one row for each file; explode the sections."""
    return spark.read.schema(GOLD).option("multiLine", True).json(path).withColumnRenamed("transcript_id", "doc_id")


def gold_section(rows: DataFrame, section: str) -> DataFrame:
    return rows.select("doc_id", F.explode(section).alias("x")).select("doc_id", "x.*")


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Artifacts as written by plans.artifact.write."""
    from veilgraph.plans.artifact import SCHEMA

    return spark.read.schema(SCHEMA).json(path)

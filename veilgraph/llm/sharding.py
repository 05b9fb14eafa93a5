"""Contiguous byte-balanced shards from global prefix sums.

Rows keep the order in which the input is read. Each partition's rows get running sums of their sizes;
the totals of the partitions (one small row each) are summed up in partition order, which gives every
row its global byte offset. The total is cut at equal targets: a row goes to the shard that holds the
middle of its bytes. So shards are contiguous, and no shard differs from its target by more than one row.

The input is written once to the shared folder with (partition, position) and local sums, so that a
lost executor can't change the order between the two passes. Only totals of partitions are shuffled.

Defined results: a null text has size 1 and the checksum of no bytes. Rows are never compared, so
ties, repeats and nulls need no rule. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.llm._common import free_name, materialize, new_path, renamed, restored, small_batches

SHARDS = 8
_OWN = ["__part", "__at", "__size", "__before"]


def running_sums(df: DataFrame) -> DataFrame:
    """df, of which the last column is __size, with __part, __at (position in it) and __before (bytes before the row in its partition)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.num_rows
            own = batch.column(batch.num_columns - 1)
            ends = pc.add(pc.cumulative_sum(own), before)
            columns = [pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64()), own, pc.subtract(ends, own)]
            yield pa.record_batch([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], *_OWN])
            if n:
                at, before = at + n, ends[-1].as_py()

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1]]
    return df.mapInArrow(run, ", ".join([*kept, "__part int, __at long, __size long, __before long"]))


def assign_shards(df: DataFrame, size: Column, shards: int = SHARDS) -> DataFrame:
    """df with __size, __shard and __slot (position in the shard), led by more underscores where df has such a column."""
    small_batches(df.sparkSession)
    own, names = renamed(df.withColumn(new := free_name("__size", df.columns), size.cast("long")))
    staged = materialize(running_sums(own.withColumnRenamed(names.pop(new), "__size")), "staged")
    totals = staged.groupBy("__part").agg(F.sum("__size").alias("bytes"), F.count("*").alias("rows"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "__part",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("__byte0"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("__row0"),
        F.sum("bytes").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__all"),
    )
    # One row for each partition of the input: a few bytes for every 100 MB read.
    placed = staged.join(F.broadcast(starts), "__part")
    placed = placed.withColumn("__shard", F.least(F.lit(shards - 1), F.expr(f"({shards} * (2 * (__byte0 + __before) + __size)) div (2 * __all)")).cast("int"))
    first = placed.groupBy("__shard").agg(F.min(F.col("__row0") + F.col("__at")).alias("__first"))
    out = placed.join(F.broadcast(first), "__shard")
    given = {"__size": F.col("__size"), "__shard": F.col("__shard"), "__slot": F.col("__row0") + F.col("__at") - F.col("__first")}
    return out.select(*restored(names), *[c.alias(free_name(k, df.columns)) for k, c in given.items()])


def write_shards(df: DataFrame, size: Column, shards: int = SHARDS, path: str | None = None) -> str:
    """Write df as Parquet partitioned by shard, rows in slot order within each file; returns the folder."""
    path = path or new_path(df.sparkSession, "shards")
    assign_shards(df, size, shards).write.partitionBy(free_name("__shard", df.columns)).parquet(path)
    return path


def text_size(text_col: str = "text") -> Column:
    """UTF-8 bytes of a text (null: none) plus 1."""
    return F.coalesce(F.octet_length(F.col(f"`{text_col}`").cast("string")), F.lit(0)).cast("long") + 1


def shard_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row for each document: id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = assign_shards(docs.select(id_col, text_col), text_size(text_col), shards)
    return rows.select(
        id_col,
        F.col("__size").alias("size"),
        F.crc32(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("__shard").alias("shard"),
        F.col("__slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

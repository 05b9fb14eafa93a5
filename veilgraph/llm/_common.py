"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.store import materialize, new_path, release, shared_dir

__all__ = ["as_bytes", "free_name", "materialize", "new_path", "release", "renamed", "restored", "row_id", "shared_dir", "small_batches", "table", "words"]

#: Rows in an Arrow batch: bounds what a Python worker holds of long texts.
BATCH_ROWS = 1024

#: A-Z to a-z; what is neither a digit, a letter nor part of a multi-byte character to a space.
_WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, letters and non-ASCII characters of UTF-8 bytes."""
    return text.translate(_WORD_TABLE).split()


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of the Arrow batches that later plans of this session send to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df under names that no operator uses for its own columns, and the new name of each column."""
    names = {c: f"__c{i}" for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def restored(names: dict[str, str]) -> list[Column]:
    """The columns that renamed() renamed, as they were."""
    return [F.col(n).alias(c) for c, n in names.items()]


def free_name(name: str, taken: list[str]) -> str:
    """name, led by as many underscores as it takes."""
    while name.lower() in {t.lower() for t in taken}:
        name = "_" + name
    return name


def row_id(name: str = "__row") -> Column:
    """A number for each row; stable once the frame is materialized."""
    return F.monotonically_increasing_id().alias(name)

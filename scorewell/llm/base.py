"""Helpers of the corpus operators: folds, scratch tables, the word rule, clash-free column names."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import materialize, shared_dir, ship_package

__all__ = [
    "ASCII_SPACE", "SPACE_CLASS", "arrow_rows", "barrier", "documents", "fold", "fresh", "give_back", "materialize", "shared_dir", "ship_package", "text_bytes", "whole_text",
]

# The characters between words.
ASCII_SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"

TARGET_BYTES = 16 << 20


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table, cut down to the columns an operator reads."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a NULL id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus


def fresh(df: DataFrame, name: str) -> str:
    """A column name the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def barrier(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once: a generator's output is never inlined into later lambdas."""
    name = fresh(df, "_cell")
    packed = F.struct(*[c.alias(k) for k, c in columns.items()])
    return df.withColumn(name, F.explode(F.array(packed))).select(*df.columns, *[F.col(f"{name}.{k}").alias(k) for k in columns])


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within this block jobs exchange record batches of so many rows with Python workers: whole texts make rows large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back() -> None:
    """Freed memory of this Python worker goes back to the system: workers stay for later stages, which need the room."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column: one number from one scan."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def partitions_for(df: DataFrame, n_bytes: int, each: int = TARGET_BYTES) -> int:
    """Partitions that keep a share at ``each`` bytes, at least what the session asks for."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // each))

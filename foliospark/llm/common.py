"""What the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.storage import bucketed, discard, scratch, sorted_buckets, staged

__all__ = ["WHITE", "ascii_lower", "bucketed", "discard", "hex_sha256", "read", "scratch", "sorted_buckets", "staged"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = " \t\n\x0b\f\r"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; lower() does just that where a text is all ASCII, and is faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def hex_sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)

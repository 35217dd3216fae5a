"""Counts, statistics and verification of whole collections, histograms."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("count"))


def stats(df: DataFrame, value: str, limit: int = 100_000) -> DataFrame:
    """Keys, bytes of values, and whether a report that stops at `limit` keys would be cut off."""
    return df.agg(F.count(F.lit(1)).alias("key_count"), F.coalesce(F.sum(F.octet_length(value)), F.lit(0)).alias("total_bytes"), (F.count(F.lit(1)) > limit).alias("truncated"))


def verify(df: DataFrame, value: str, checksum: str) -> DataFrame:
    """Values checked and those that do not have their checksum."""
    return df.agg(F.count(F.lit(1)).alias("checked"), F.coalesce(F.sum((F.crc32(value) != F.col(checksum)).cast("int")), F.lit(0)).cast("bigint").alias("corrupt"))


def histogram(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts at the upper bounds, one pass."""
    counts = df.agg(*[F.sum((F.col(value) <= b).cast("bigint")).alias(f"c{i}") for i, b in enumerate(bounds)])
    rows = F.array(*[F.struct(F.lit(float(b)).alias("bound"), F.coalesce(f"c{i}", F.lit(0)).alias("cumulative")) for i, b in enumerate(bounds)])
    return counts.select(F.inline(rows))


def percentile(df: DataFrame, value: str, bounds: list[float], p: float) -> DataFrame:
    """Interpolated in the first bucket that reaches the rank; the last bound above all buckets."""
    n = F.count(value)
    at = [F.sum((F.col(value) <= b).cast("bigint")) for b in bounds]
    rank = n * F.lit(p / 100)
    out = F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        low, before = (F.lit(float(bounds[i - 1])), at[i - 1]) if i else (F.lit(0.0), F.lit(0))
        inside = low + (F.lit(float(bounds[i])) - low) * (rank - before) / F.when(at[i] > before, at[i] - before)
        out = F.when(at[i] >= rank, F.coalesce(inside, F.lit(float(bounds[i])))).otherwise(out)
    return df.agg(F.round(out, 6).alias("percentile"))


def checksum(df: DataFrame, *columns: str) -> DataFrame:
    """Independent of order and partitions."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64(*columns)).alias("checksum"))

"""Writes: updates, an operation log with latest-wins reads, atomic batches and transactions.

DataFrames are immutable, so a write is a new frame; a batch that fails leaves the old one as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keyed import multi_get

PUT, DELETE = "put", "delete"


def update_where(df: DataFrame, matches: Column, changes: dict[str, Column]) -> DataFrame:
    """Changes apply one after the other to rows that match before any of them."""
    df = df.withColumn("_match", F.coalesce(matches, F.lit(False)))
    for name, value in changes.items():
        df = df.withColumn(name, F.when(F.col("_match"), value).otherwise(F.col(name)))
    return df.drop("_match")


def affected_rows(df: DataFrame, matches: Column) -> DataFrame:
    return df.agg(F.coalesce(F.sum(F.when(matches, 1).otherwise(0)), F.lit(0)).cast("bigint").alias("affected_rows"))


def latest(log: DataFrame, key: str, seq: str = "seq", op: str = "op") -> DataFrame:
    """The log's last row of each key, without keys that it deletes. Partial maxima come before the
    shuffle, so a key with many versions costs one row a task."""
    rest = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("last"))
    return last.where(F.col(f"last.{op}") != DELETE).select(key, *[F.col(f"last.{c}").alias(c) for c in rest if c not in (seq, op)])


def upsert(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return df.join(new.select(key), key, "left_anti").unionByName(new)


def delete(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_anti")


def read_modify_write(df: DataFrame, keys: DataFrame, key: str, value: str, change) -> DataFrame:
    """change(old value) for the given keys; a missing key starts from null."""
    old = multi_get(keys.select(key).distinct(), df, key)
    return upsert(df, old.withColumn(value, change(F.col(value))), key)


def apply_batch(df: DataFrame, operations: list) -> DataFrame:
    """Functions of a frame, in order. The first that fails ends the batch with its number, and
    the caller still has the frame from before."""
    for i, operation in enumerate(operations):
        try:
            df = operation(df)
        except Exception as e:
            raise RuntimeError(f"operation {i} failed, nothing was changed") from e
    return df


class Transaction:
    """Collects changes to a keyed frame; reads in it see them, `commit` gives the new frame."""

    def __init__(self, df: DataFrame, key: str):
        self.df, self.key, self.operations, self.ended = df, key, [], False

    def __enter__(self):
        return self

    def __exit__(self, kind, *_):
        if kind:
            self.rollback()

    def _add(self, operation):
        if self.ended:
            raise RuntimeError("the transaction has ended")
        self.operations.append(operation)

    def set(self, rows: DataFrame):
        self._add(lambda df: upsert(df, rows, self.key))

    def delete(self, *keys):
        self._add(lambda df: df.where(~F.col(self.key).isin(*keys)))

    def update(self, matches: Column, changes: dict[str, Column]):
        self._add(lambda df: update_where(df, matches, changes))

    def get(self, value) -> DataFrame:
        return apply_batch(self.df, self.operations).where(F.col(self.key) == F.lit(value))

    def commit(self) -> DataFrame:
        if self.ended:
            raise RuntimeError("the transaction has ended")
        out, self.ended = apply_batch(self.df, self.operations), True
        return out

    def rollback(self):
        self.operations, self.ended = [], True


def compact(log: DataFrame, key: str, path: str, files: int | None = None) -> None:
    """Writes the latest rows ordered by key, so that later range reads skip files and row groups."""
    rows = latest(log, key)
    rows = rows.repartitionByRange(files, key) if files else rows.repartitionByRange(key)
    rows.sortWithinPartitions(key).write.parquet(path)

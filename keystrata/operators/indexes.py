"""Secondary indexes: tables of (indexed_value, primary_key)."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build(df: DataFrame, value: str, key: str) -> DataFrame:
    """A value that a key has twice is one entry."""
    return df.select(F.col(value).alias("indexed_value"), F.col(key).alias("primary_key")).distinct()


def violations(index: DataFrame) -> DataFrame:
    """Values that would break a unique index, and by how many keys."""
    return index.groupBy("indexed_value").agg(F.countDistinct("primary_key").alias("keys")).where("keys > 1")


def build_unique(df: DataFrame, value: str, key: str) -> DataFrame:
    index = build(df, value, key)
    if not violations(index).isEmpty():
        raise ValueError(f"{value} is not unique")
    return index


def lookup(index: DataFrame, df: DataFrame, key: str, value) -> DataFrame:
    found = index.where(F.col("indexed_value") == F.lit(value)).select(F.col("primary_key").alias(key))
    return df.join(found, key, "left_semi")


def lookup_range(index: DataFrame, df: DataFrame, key: str, start, end) -> DataFrame:
    found = index.where((F.col("indexed_value") >= F.lit(start)) & (F.col("indexed_value") < F.lit(end)))
    return df.join(found.select(F.col("primary_key").alias(key)).distinct(), key, "left_semi")


def maintain(index: DataFrame, old: DataFrame, new: DataFrame, value: str, key: str) -> DataFrame:
    """The index after the rows of `old` became those of `new`."""
    return index.join(build(old, value, key), ["indexed_value", "primary_key"], "left_anti").unionByName(build(new, value, key)).distinct()


def stats(index: DataFrame) -> DataFrame:
    return index.agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("indexed_value").alias("distinct_values"))


class Indexes:
    """The named indexes of one collection. Names are unique; dropping needs one that is there."""

    def __init__(self, df: DataFrame, key: str):
        self.df, self.key, self._built = df, key, {}

    def create(self, name: str, value: str, unique: bool = False) -> DataFrame:
        if name in self._built:
            raise ValueError(f"index {name} exists already")
        self._built[name] = (value, unique, (build_unique if unique else build)(self.df, value, self.key))
        return self._built[name][2]

    def drop(self, name: str) -> None:
        if name not in self._built:
            raise ValueError(f"there is no index {name}")
        del self._built[name]

    def names(self) -> list[str]:
        return sorted(self._built)

    def describe(self) -> DataFrame:
        """(name, column, is_unique, entries, distinct_values) of every index."""
        rows = [stats(index).select(F.lit(name).alias("name"), F.lit(value).alias("column"), F.lit(unique).alias("is_unique"), "*") for name, (value, unique, index) in sorted(self._built.items())]
        if not rows:
            return self.df.sparkSession.createDataFrame([], "name string, column string, is_unique boolean, entries long, distinct_values long")
        return reduce(DataFrame.unionByName, rows)

    def lookup(self, name: str, value) -> DataFrame:
        if name not in self._built:
            raise ValueError(f"there is no index {name}")
        return lookup(self._built[name][2], self.df, self.key, value)

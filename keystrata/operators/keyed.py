"""Reads of a collection by key: points, lists of keys, half-open ranges, prefixes, pages."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blobs import prefix_end


def point_get(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == F.lit(value)).limit(1)


def contains(df: DataFrame, key: str, value) -> bool:
    return not df.where(F.col(key) == F.lit(value)).limit(1).isEmpty()


BROADCAST_KEYS = 500_000


def few(keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """keys, to be broadcast if a look at them finds `most` rows at most."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def matching(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The collection's rows with one of the keys. In a semi join Spark builds the hash table from the keys:
    while they are few the collection stays where it is and is scanned once."""
    return df.join(few(keys.select(key).distinct()), key, "left_semi")


def which_exist(keys: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """The keys with whether the collection has them."""
    there = matching(df.select(key), keys, key).distinct().withColumn("found", F.lit(True))
    return keys.join(there, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def multi_get(keys: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """One row a requested key, nulls where it is missing."""
    return keys.join(matching(df, keys, key), key, "left")


def range_scan(df: DataFrame, key: str, start=None, end=None) -> DataFrame:
    """Keys from start to before end, in order; both bounds reach the file scan."""
    if start is not None:
        df = df.where(F.col(key) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(key) < F.lit(end))
    return df.orderBy(key)


def prefix_scan(df: DataFrame, key: str, prefix: str | bytes) -> DataFrame:
    """Keys that begin with prefix, in order. A range is pushed down further than startswith."""
    raw = prefix.encode() if isinstance(prefix, str) else prefix
    end = prefix_end(raw)
    df = df.where(F.col(key) >= F.lit(prefix))
    if end is None:
        df = df.where(F.col(key).startswith(F.lit(prefix)))
    else:
        try:
            df = df.where(F.col(key) < F.lit(end.decode() if isinstance(prefix, str) else end))
        except UnicodeDecodeError:  # a string has no such end
            df = df.where(F.col(key).startswith(prefix))
    return df.orderBy(key)


def keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct().orderBy(key)


def cursor(key: Column) -> Column:
    """An opaque place in a listing that can't be forged by accident."""
    raw = key.cast("string").cast("binary")
    return F.concat(F.lower(F.hex(raw)), F.lit("|"), F.sha2(raw, 256))


def read_cursor(text: str) -> str:
    import hashlib

    raw, _, digest = text.partition("|")
    key = bytes.fromhex(raw)
    if hashlib.sha256(key).hexdigest() != digest:
        raise ValueError("the cursor was changed")
    return key.decode()


def page(df: DataFrame, key: str, size: int, after=None, offset: int = 0) -> DataFrame:
    """One page by key, with the cursor to go on from and whether anything follows. One row more
    than the page is read, so nothing is counted."""
    if after is not None:
        df = df.where(F.col(key) > F.lit(after))
    ahead = df.orderBy(key).offset(offset).limit(size + 1)
    place = Window.orderBy(key)  # over one page
    ahead = ahead.withColumns({"_n": F.row_number().over(place), "has_more": F.count(F.lit(1)).over(Window.partitionBy()) > size})
    rows = ahead.where(F.col("_n") <= size).drop("_n")
    return rows.withColumn("next_cursor", F.when(F.col("has_more"), cursor(F.max(key).over(Window.partitionBy()))))


def top(df: DataFrame, by: str, key: str, n: int, ascending: bool = False) -> DataFrame:
    """The n rows with the largest values, ties by key; no full sort."""
    return df.orderBy(F.col(by).asc() if ascending else F.col(by).desc(), F.col(key).asc()).limit(n)

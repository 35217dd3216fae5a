"""Shards as a table of half-open key ranges, routing as joins, and merges of partial results."""

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keyed import few


SPLITTERS = 1024


def steps(x: Column, bounds: list, results: list) -> Column:
    """results[number of bounds <= x], found by binary search in one expression."""
    if not bounds:
        return results[0]
    mid = len(bounds) // 2
    return F.when(x < F.lit(bounds[mid]), steps(x, bounds[:mid], results[: mid + 1])).otherwise(steps(x, bounds[mid + 1 :], results[mid + 1 :]))


def _blocks(starts: DataFrame, n: int):
    """A function from keys to the number of their block, found by binary search; blocks are cut at about
    SPLITTERS of the n rows of `starts`."""
    starts = starts if n <= SPLITTERS else starts.sample(SPLITTERS / n, seed=1)
    bounds = sorted(r[0] for r in starts.distinct().limit(4 * SPLITTERS).collect() if r[0] is not None)
    return lambda x: steps(x, bounds, [F.lit(i) for i in range(len(bounds) + 1)])


def route(df: DataFrame, shards: DataFrame, key: str) -> DataFrame:
    """Every row with the shard whose [start_key, end_key) holds its key.

    Starts of shards, all of them or a sample of about SPLITTERS, cut the keys into blocks. A key's
    block is found by binary search in an expression, a shard is in each block that it reaches into,
    and the two meet by equality; so no row is held against all shards. Shards are metadata, a row each, and are
    broadcast while they are few."""
    block = _blocks(shards.select("start_key"), shards.count())
    first, last = block(F.col("start_key")), block(F.col("end_key"))
    reached = shards.where("start_key < end_key").withColumn("_block", F.explode(F.sequence(first, last)))
    inside = (F.col(key) >= F.col("start_key")) & (F.col(key) < F.col("end_key"))
    return df.withColumn("_block", block(F.col(key))).join(few(reached), "_block").where(inside).drop("_block")


def overlapping(shards: DataFrame, start, end) -> DataFrame:
    return shards.where((F.col("start_key") < F.lit(end)) & (F.lit(start) < F.col("end_key")))


def overlap_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of files of two levels whose [low, high] ranges meet: one's low lies in the other's range.
    Ranges of integers are cut into aligned blocks of powers of two, 126 at most, and lows meet them
    in the one block that holds them, so the join is on equality. Ranges of other keys are cut where
    ranges begin, a sample of about SPLITTERS, and meet in the block that holds the later low."""
    a, b = left.select(*[F.col(c).alias(f"left_{c}") for c in left.columns]), right.select(*[F.col(c).alias(f"right_{c}") for c in right.columns])
    meet = (F.col("left_low") <= F.col("right_high")) & (F.col("right_low") <= F.col("left_high"))
    if not all(f.dataType.typeName() in ("byte", "short", "integer", "long") for df in (left, right) for f in df.select("low", "high").schema):
        lows = left.select("low").union(right.select("low"))
        block = _blocks(lows, lows.count())
        reach = lambda df, side: df.withColumn("_block", F.explode(F.sequence(block(F.col(f"{side}_low")), block(F.col(f"{side}_high")))))
        both = reach(a.where("left_low <= left_high"), "left").join(reach(b.where("right_low <= right_high"), "right"), "_block")
        return both.where(meet & (F.col("_block") == block(F.greatest("left_low", "right_low")))).drop("_block")

    def points(df, side):
        low = F.col(f"{side}_low").cast("long")
        return df.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(low, k).alias("block")) for k in range(64)])).alias("at"))

    def ranges(df, side):
        low, high, found = F.col(f"{side}_low").cast("long"), F.col(f"{side}_high").cast("long"), []
        for k in range(64):
            mask = F.lit((1 << k) - 1).cast("long")
            first = F.shiftright(low, k) + (low.bitwiseAND(mask) != 0).cast("long")
            last = F.shiftright(high, k) - (high.bitwiseAND(mask) != mask).cast("long")
            # blocks of this level that lie in the range while their parents do not
            found.append(F.when((first <= last) & (first.bitwiseAND(F.lit(1)) == 1), F.struct(F.lit(k).alias("level"), first.alias("block"))))
            found.append(F.when((first <= last) & (last.bitwiseAND(F.lit(1)) == 0), F.struct(F.lit(k).alias("level"), last.alias("block"))))
        return df.select("*", F.explode(F.array_compact(F.array(*found))).alias("at"))

    columns = [*a.columns, *b.columns]
    of_left = points(a, "left").join(ranges(b, "right"), "at").where(meet).select(*columns)
    of_right = ranges(a, "left").join(points(b, "right"), "at").where(meet & (F.col("right_low") > F.col("left_low"))).select(*columns)
    return of_left.unionByName(of_right)


def key_hash(key: Column) -> Column:
    """32 bits of a hash that other engines and languages have as well."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")


def hash_shard(key: Column, n: int) -> Column:
    return F.pmod(key_hash(key), F.lit(n)).cast("int")


def ring_shard(df: DataFrame, key: str, nodes: list[str], virtual: int = 100) -> DataFrame:
    """Consistent hashing: the node whose point on the ring is the key's or the next one after it. The
    ring's size is fixed by its arguments, and it is searched in one expression."""
    ring = {}
    for point, node in sorted(((int(hashlib.md5(f"{n}#{v}".encode()).hexdigest()[:8], 16), n) for n in nodes for v in range(virtual)), reverse=True):
        ring[point] = node  # of points that meet the first name counts
    points = sorted(ring)
    owners = [F.lit(ring[p]) for p in [*points, points[0]]]
    return df.withColumn("_place", key_hash(F.col(key))).withColumn("node", steps(F.col("_place"), [p + 1 for p in points], owners)).drop("_place")


def adjacent(shards: DataFrame) -> DataFrame:
    """Every shard with whether the next one begins where it ends, so that they can be merged."""
    order = Window.orderBy("start_key")  # metadata, a row a shard
    return shards.withColumn("mergeable", F.coalesce(F.lead("start_key").over(order) == F.col("end_key"), F.lit(False)))


def stats(shards: DataFrame) -> DataFrame:
    total = F.count(F.lit(1))
    average = lambda c: F.coalesce(F.floor(F.sum(c) / F.when(total > 0, total)), F.lit(0)).cast("bigint")
    return shards.agg(
        total.alias("shards"), F.countDistinct("node").alias("nodes"), F.coalesce(F.sum("key_count"), F.lit(0)).alias("total_keys"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"),
        average("key_count").alias("average_keys"), average("bytes").alias("average_bytes"),
    )


def merge(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def merge_distinct(*parts: DataFrame) -> DataFrame:
    return merge(*parts).distinct()


def merge_sorted(*parts: DataFrame, by: str) -> DataFrame:
    """Ties come in the order of the parts."""
    numbered = [p.withColumn("shard", F.lit(i)) for i, p in enumerate(parts)]
    return merge(*numbered).orderBy(by, "shard")


def merge_sorted_distinct(*parts: DataFrame, by: str) -> DataFrame:
    """Rows that are equal come once."""
    return merge_distinct(*parts).orderBy(by)


def without_repeats(df: DataFrame, value: str, order: str, within: str) -> DataFrame:
    """Rows that differ from the one before them in the order; the first of every run of equal values stays,
    in each group of `within` on its own."""
    before = Window.partitionBy(within).orderBy(order)
    return df.withColumns({"_first": F.row_number().over(before) == 1, "_old": F.lag(value).over(before)}).where(F.col("_first") | ~F.col(value).eqNullSafe(F.col("_old"))).drop("_first", "_old")


def midpoint(start: bytes, end: bytes) -> bytes:
    """A key to split a range at: the average byte by byte over the shorter length, where an odd sum
    adds one to the next byte's; never the start itself."""
    out, odd = bytearray(), 0
    for a, b in zip(start, end, strict=False):
        odd, half = (a + b + odd) % 2, (a + b + odd) // 2
        out.append(half)
    if out and out == start[: len(out)]:
        out[-1] = min(out[-1] + 1, 255)
    return bytes(out)


def temperature(shards: DataFrame, most_keys: int, most_bytes: int) -> DataFrame:
    """Hot shards have more keys or bytes than the limits, cold ones less of both."""
    keys, size = F.col("key_count"), F.col("bytes")
    return shards.withColumns({"hot": (keys > most_keys) | (size > most_bytes), "cold": (keys < most_keys) & (size < most_bytes)})


def split(shards: DataFrame, shard_id: int, at, new_id: int) -> DataFrame:
    """The shard up to `at` keeps its number, what follows gets another; each is taken to have half of what there was."""
    row = shards.where(F.col("shard_id") == shard_id).first()
    if row is None or not row["start_key"] < at < row["end_key"]:
        raise ValueError(f"shard {shard_id} can't be split at {at!r}")
    hit = F.col("shard_id") == shard_id
    half = {c: F.when(hit, F.floor(F.col(c) / 2)).otherwise(F.col(c)) for c in ("key_count", "bytes") if c in shards.columns}
    left = shards.withColumns({**half, "end_key": F.when(hit, F.lit(at)).otherwise(F.col("end_key"))})
    right = shards.where(hit).withColumns({**half, "start_key": F.lit(at), "shard_id": F.lit(new_id).cast(shards.schema["shard_id"].dataType)})
    return left.unionByName(right)


def join_shards(shards: DataFrame, left_id: int, right_id: int, new_id: int) -> DataFrame:
    """Two shards as one; the first has to end where the second begins, on the same node."""
    rows = {r["shard_id"]: r for r in shards.where(F.col("shard_id").isin(left_id, right_id)).collect()}
    if len(rows) != 2 or rows[left_id]["end_key"] != rows[right_id]["start_key"] or rows[left_id]["node"] != rows[right_id]["node"]:
        raise ValueError(f"shards {left_id} and {right_id} don't follow each other on one node")
    both = shards.where(F.col("shard_id").isin(left_id, right_id))
    sums = [F.sum(c).alias(c) for c in ("key_count", "bytes") if c in shards.columns]
    one = both.agg(F.lit(new_id).cast(shards.schema["shard_id"].dataType).alias("shard_id"), F.min("start_key").alias("start_key"), F.max("end_key").alias("end_key"), F.first("node").alias("node"), *sums)
    return shards.where(~F.col("shard_id").isin(left_id, right_id)).unionByName(one.select(*shards.columns))

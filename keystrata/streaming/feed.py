"""Results in chunks, and change feeds as Structured Streaming queries."""

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ordering import numbered


def chunked(df: DataFrame, key: str, size: int = 100, max_results: int | None = None) -> DataFrame:
    """Rows in key order with the number of their chunk and whether another follows; of more than
    `max_results` rows the first ones. No task sees the whole result."""
    out = numbered(df if max_results is None else df.orderBy(key).limit(max_results), key).withColumn("chunk", F.floor(F.col("_place") / size))
    return out.withColumn("has_more", (F.col("chunk") + 1) * size < F.col("_total")).drop("_place", "_total")


def iterate(df: DataFrame, size: int = 100, max_results: int | None = None) -> Iterator[list]:
    """Lists of at most `size` rows, 1 at least; the driver holds one partition ahead at most. It ends after
    `max_results` rows, or when the caller stops taking."""
    chunk = []
    for row in (df if max_results is None else df.limit(max_results)).toLocalIterator(prefetchPartitions=True):
        chunk.append(row)
        if len(chunk) >= max(1, size):
            yield chunk
            chunk = []
    if chunk:
        yield chunk


def change_feed(spark: SparkSession, path: str, schema: StructType | str, key: str, pattern: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the log's rows whose key is like `pattern` (* stands for anything)."""
    like = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.where(F.col(key).cast("string").like(like))


def drain(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs the stream over all there is now and reads what it wrote; a restart goes on from the
    checkpoint and delivers every row once."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def latest_values(stream: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of every key so far, as a stateful aggregation (output mode complete or update)."""
    rest = [c for c in stream.columns if c != key]
    return stream.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("last")).select(key, "last.*")


def apply_changes(stream: DataFrame, checkpoint: str, upsert):
    """Calls upsert(batch, number) for every micro-batch with what there is now."""
    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

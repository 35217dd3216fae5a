"""Text formats: batch files, NDJSON snapshots, and outputs with a sentinel for binary values."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.blobs import display


def parse_batch(lines: DataFrame, line: str = "value") -> DataFrame:
    """`put key value` and `delete key`; blank lines and # comments go, others are invalid."""
    text = F.trim(F.col(line))
    parts = F.split(text, r"\s+", 3)
    n = F.size(parts)
    op = F.lower(parts[0])
    rows = lines.where((text != "") & ~text.startswith("#"))
    status = F.when((op == "put") & (n == 3) | (op == "delete") & (n == 2), "ok").otherwise("invalid")
    return rows.select(op.alias("op"), F.try_element_at(parts, F.lit(2)).alias("key"), F.when(op == "put", F.try_element_at(parts, F.lit(3))).alias("value"), status.alias("status"))


def batch_counts(parsed: DataFrame) -> DataFrame:
    of = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("int")), F.lit(0)).cast("bigint")
    return parsed.agg(F.count(F.lit(1)).alias("total"), of("ok").alias("succeeded"), of("invalid").alias("failed"))


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    return parse_batch(spark.read.text(path))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """NDJSON of key and value; of lines with one key, the last of its file counts."""
    df = spark.read.schema("key string, value string").json(path)
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return df.select("key", "value", place.alias("place")).groupBy("key").agg(F.max_by("value", "place").alias("value"))


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.json(path)


def as_text(value: Column) -> Column:
    return display(value)


def nul_record(key: Column, value: Column) -> Column:
    """The displayed key and value, each ended by a NUL byte."""
    return F.concat(display(key), F.lit("\x00"), display(value), F.lit("\x00"))


def write_nul(df: DataFrame, path: str) -> None:
    """Records of `key` and `value` one after the other, without line ends."""
    df.select(nul_record(F.col("key"), F.col("value")).alias("record")).write.option("lineSep", "").text(path)


def yaml_record(*columns: str) -> Column:
    """A list item with the columns as quoted scalars, as JSON strings are YAML ones too."""
    field = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(c).cast("string").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit("null"))
    parts = [F.concat(F.lit(f"{'- ' if i == 0 else '  '}{c}: "), F.when(F.col(c).isNull(), F.lit("null")).otherwise(field(c))) for i, c in enumerate(columns)]
    return F.concat_ws("\n", *parts)


def write_yaml(df: DataFrame, path: str) -> None:
    df.select(yaml_record(*df.columns).alias("record")).write.text(path)


def table_lines(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Columns padded to their widths, with bars between them, a line a row."""
    cell = lambda c, n: F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), n, " ")
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c, n) for c, n in widths.items()]), F.lit(" |")).alias("line"))

"""Comparison, backup and restore of snapshots."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import filesystem
from .aggregates import checksum


def diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that were added, removed or modified, with both values."""
    a, b = old.select(key, F.col(value).alias("old_value"), F.lit(1).alias("_a")), new.select(key, F.col(value).alias("new_value"), F.lit(1).alias("_b"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "modified")
    return both.withColumn("change", change).where("change is not null").select(key, "change", "old_value", "new_value")


def diff_stats(changes: DataFrame) -> DataFrame:
    of = lambda kind: F.coalesce(F.sum((F.col("change") == kind).cast("int")), F.lit(0)).cast("bigint")
    return changes.agg(of("added").alias("added"), of("removed").alias("removed"), of("modified").alias("modified"))


def added(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return new.join(old, key, "left_anti")


def removed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new, key, "left_anti")


def backup(df: DataFrame, path: str) -> dict:
    """Writes a copy and its manifest (rows, order-independent checksum)."""
    df.write.parquet(f"{path}/data")
    manifest = checksum(df.sparkSession.read.parquet(f"{path}/data"), *df.columns)
    manifest.coalesce(1).write.json(f"{path}/manifest")
    return manifest.first().asDict()


def restore(spark, path: str) -> DataFrame:
    """The copy, if it still has the checksum of its manifest."""
    df = spark.read.parquet(f"{path}/data")
    want = spark.read.schema("rows long, checksum long").json(f"{path}/manifest").first()
    if checksum(df, *df.columns).first() != want:
        raise ValueError(f"{path} does not have the checksum of its manifest")
    return df


def increment(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """What a backup after `old` has to hold: new and changed rows, and keys that went, as an operation log."""
    rows = new.exceptAll(old).withColumn("op", F.lit("put"))
    return rows.unionByName(removed(old, new, key).select(key).withColumn("op", F.lit("delete")), allowMissingColumns=True)


def apply_increment(old: DataFrame, step: DataFrame, key: str) -> DataFrame:
    rest = old.join(step.select(key).distinct(), key, "left_anti")
    return rest.unionByName(step.where("op = 'put'").drop("op"))


def backups(spark, folder: str) -> DataFrame:
    """The backups below a folder with the rows and checksums of their manifests."""
    found = spark.read.schema("rows long, checksum long").json(f"{folder}/*/manifest")
    return found.select(F.element_at(F.split("_metadata.file_path", "/"), -3).alias("name"), "rows", "checksum")


def is_whole(spark, path: str) -> bool:
    """Whether a backup still is what its manifest says."""
    try:
        restore(spark, path)
    except ValueError:
        return False
    return True


def delete_backup(path: str) -> None:
    """Removes a backup, and nothing that does not look like one."""
    from pyarrow.fs import FileType

    files, at = filesystem(path)
    if files.get_file_info(f"{at}/manifest").type != FileType.Directory:
        raise ValueError(f"{path} is not a backup")
    files.delete_dir(at)

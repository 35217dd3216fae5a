"""Tables in the folder that driver and executors share, for rows that have to be computed once.

The folder is the one that `spark.checkpoint.dir` names. On one machine, where it is unset, it lies in
the session's warehouse; on a cluster that would be some executor's own disk, so an unset folder is an error.
Everything that a session writes lies under its application's name, and `forget` removes it.
"""

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession


def application_dir(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = posixpath.join(spark.conf.get("spark.sql.warehouse.dir"), "_shared")
    return posixpath.join(root, spark.sparkContext.applicationId)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder."""
    return posixpath.join(application_dir(spark), f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, and a lost executor
    costs only the tasks that it ran."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """(pyarrow file system, path) for a URI of any scheme that pyarrow knows, or a plain path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def forget(spark: SparkSession) -> None:
    """Removes what this application has written here. Frames that still read it fail afterwards, so
    this comes after their results are stored, at the end of a job."""
    from pyarrow import fs

    where = application_dir(spark)
    for t in spark.catalog.listTables():
        if t.tableType == "EXTERNAL" and not t.isTemporary:
            location = [r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED `{t.name}`").collect() if r.col_name == "Location"]
            if location and spark.sparkContext.applicationId in location[0]:
                spark.sql(f"DROP TABLE `{t.name}`")
    files, path = filesystem(where)
    if files.get_file_info(path).type != fs.FileType.NotFound:
        files.delete_dir(path)

"""Places of rows in an order, without a task that sees them all."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

_ROWS = (1 << 33) - 1


def numbered(df: DataFrame, *order: str, place: str = "_place", total: str = "_total") -> DataFrame:
    """df with every row's place in the order, from 0, and the number of rows; nulls come first, ties in some
    order that stays. The rows are dealt into ranges, sorted and numbered in one go and written once: what
    comes after reads one numbering, whichever columns it needs and however often a task is run."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    rows = written(rows.withColumn("_part", F.shiftright("_row", 33)), "numbered")
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row a range
    sizes = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"), F.sum("_n").over(Window.partitionBy()).alias(total))
    rows = rows.join(F.broadcast(sizes), "_part")
    return rows.withColumn(place, F.col("_row").bitwiseAND(F.lit(_ROWS)) + F.col("_base")).drop("_part", "_row", "_base")

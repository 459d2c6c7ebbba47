"""Looking at the previous row of a very long ordered table without bringing it to one task.

The order is cut into buckets of consecutive values.  A window runs inside each bucket; the
last row of each bucket (one row per bucket) is carried to the next one that has rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 1 << 16


def with_previous(df: DataFrame, order: str, values: list[str], keys: list[str] = (), name: str = "previous", bucket: int = BUCKET, before=None) -> DataFrame:
    """Add struct ``name`` with ``values`` of the row before, by ``order`` within ``keys``; ``before``: what comes before the first."""
    keys = list(keys)
    row = F.struct(*values)
    cut = df.withColumn("_bucket", F.floor(F.col(order) / F.lit(bucket)))
    inside = F.lag(row).over(Window.partitionBy(*keys, "_bucket").orderBy(order))
    local = cut.withColumn("_inside", inside)
    lasts = cut.groupBy(*keys, "_bucket").agg(F.max_by(row, order).alias("_last"))
    carried = lasts.select(*keys, "_bucket", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_carried"))
    joined = local.join(carried, [*keys, "_bucket"])
    found = F.coalesce("_inside", "_carried") if before is None else F.coalesce("_inside", "_carried", before)
    return joined.withColumn(name, found).drop("_bucket", "_inside", "_carried")


def running_number(df: DataFrame, order: str, start, name: str, bucket: int = BUCKET) -> DataFrame:
    """Number rows from ``start`` on in ``order`` (ties by nothing: it should be unique)."""
    cut = df.withColumn("_bucket", F.floor(F.col(order) / F.lit(bucket)))
    local = cut.withColumn("_row", F.row_number().over(Window.partitionBy("_bucket").orderBy(order)))
    sizes = cut.groupBy("_bucket").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"))
    return local.join(offsets, "_bucket").withColumn(name, (F.lit(start) - 1 + F.col("_before") + F.col("_row")).cast("bigint")).drop("_bucket", "_row", "_before")

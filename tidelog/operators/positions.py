"""Places in an ordered set, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 1 << 16


def with_position(df: DataFrame, order: str, name: str = "pos", bucket: int = BUCKET) -> DataFrame:
    """Adds the 0-based place of each row by a unique integer column.

    Ids fall into buckets of `bucket` neighbours; a bucket's first place is the running sum of the counts before it (a row for each
    bucket), and places inside are numbered bucket by bucket.
    """
    part = F.floor(F.col(order) / F.lit(bucket)).cast("long")
    keyed = df.withColumn("__bucket", part)
    counts = keyed.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("__bucket", F.coalesce(before, F.lit(0)).alias("__start"))
    local = F.row_number().over(Window.partitionBy("__bucket").orderBy(order)) - 1
    return keyed.withColumn(name, local).join(starts, "__bucket").withColumn(name, F.col(name) + F.col("__start")).drop("__bucket", "__start")


def dense_ids(df: DataFrame, order: list[str], name: str = "msg_id", base: int = 0) -> DataFrame:
    """Arrival-order ids base, base + 1, ... by the order columns: one range exchange, then counts of the partitions.

    The input is read twice; give it a stable one (a table, not a sample). Rows equal in all order columns get ids in no set order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = placed.withColumn("__at", F.monotonically_increasing_id())
    return compact_ids(numbered, "__at", name, base)


def compact_ids(numbered: DataFrame, at: str, name: str, base: int = 0) -> DataFrame:
    """Turns partition-wise ids (partition in the bits from 33) into dense ones."""
    part = F.shiftright(at, 33)
    counts = numbered.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))  # a row for each partition
    local = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    joined = numbered.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return joined.withColumn(name, F.col("__start") + local + F.lit(base)).drop("__part", "__start", at)

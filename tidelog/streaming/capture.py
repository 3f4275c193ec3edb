"""Streaming capture and windows.

Capture writes each micro-batch as one segment with ids that go on from the last committed one, and does no index work; compaction
follows when asked for. A batch that is run again replaces its own segment.
"""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators.positions import compact_ids
from tidelog.sources.dataset import Dataset, open_dataset
from tidelog.sources.writer import INDEX, compact, delete, exists


def capture(stream: DataFrame, path: str, index: Mapping[str, Column | str], order: list[str], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start capturing into path; trigger as in writeStream.trigger, by default all that is there."""
    expressions = {n: F.col(e) if isinstance(e, str) else e for n, e in index.items()}

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        base = _base(spark, path, batch_id)
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        keyed = batch.select("*", *[e.alias(INDEX + n) for n, e in expressions.items()])
        landing = f"{path}/landing/{batch_id}"
        placed = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        placed.withColumn("__at", F.monotonically_increasing_id()).write.mode("overwrite").parquet(landing)
        numbered = compact_ids(spark.read.parquet(landing), "__at", "msg_id", base)
        numbered.write.mode("overwrite").parquet(f"{path}/messages/segment={batch_id}")
        delete(spark, landing)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _base(spark: SparkSession, path: str, batch_id: int) -> int:
    """The first id of a batch: one more than the last of earlier batches."""
    if not exists(spark, f"{path}/messages"):
        return 0
    last = spark.read.parquet(f"{path}/messages").where(F.col("segment") < batch_id).agg(F.max("msg_id")).first()[0]
    return 0 if last is None else last + 1


def compact_capture(spark: SparkSession, path: str, fields: list[str]) -> Dataset:
    """Index what has been committed so far, and open it."""
    n = spark.read.parquet(f"{path}/messages").count()
    compact(spark, path, fields, None, {}, n)
    return open_dataset(spark, path)


def event_time(df: DataFrame, column: str, late: str | None = None) -> DataFrame:
    """The column as TIMESTAMP (watermarks do not take TIMESTAMP_NTZ), with a watermark if `late` is given."""
    out = df.withColumn(column, F.col(column).cast("timestamp"))
    return out.withWatermark(column, late) if late else out


def tumbling(df: DataFrame, column: str, size: str, *aggregates: Column, by: tuple[str, ...] = ()) -> DataFrame:
    return sliding(df, column, size, size, *aggregates, by=by)


def sliding(df: DataFrame, column: str, size: str, step: str, *aggregates: Column, by: tuple[str, ...] = ()) -> DataFrame:
    out = df.groupBy(F.window(column, size, step).alias("__w"), *by).agg(*aggregates)
    return out.select(F.col("__w.start").alias("start"), F.col("__w.end").alias("end"), *[c for c in out.columns if c != "__w"])


def sessions(df: DataFrame, column: str, gap: str, *aggregates: Column, by: tuple[str, ...] = ()) -> DataFrame:
    out = df.groupBy(F.session_window(column, gap).alias("__w"), *by).agg(*aggregates)
    return out.select(F.col("__w.start").alias("start"), F.col("__w.end").alias("end"), *[c for c in out.columns if c != "__w"])


def first_only(df: DataFrame, keys: list[str]) -> DataFrame:
    """One message for each key; on a stream, within the watermark."""
    return df.dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def carry_state(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """On a stream: (key, order, value, previous) with the key's previous value, kept as state between batches."""
    kinds = dict(stream.dtypes)
    out = f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, `{value}` {kinds[value]}, previous {kinds[value]}"

    def step(own_key, batches, state):
        last = state.get[0] if state.exists else None
        pdf = pd.concat(list(batches)).sort_values(order)
        before = []
        for v in pdf[value]:
            before.append(last)
            last = v if not pd.isna(v) else last
        state.update((last,))
        yield pdf[[key, order, value]].assign(previous=before)

    return stream.groupBy(key).applyInPandasWithState(step, out, f"last {kinds[value]}", "append", "NoTimeout")

"""Adaptive stop rules over recorded batches, progress, and incremental dedup of streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Stages in order of progress.
STAGES = ["QUEUED", "PARSING", "RESOLVING", "SEARCHING", "NORMALIZING", "DEDUPLICATING", "RANKING", "SAVING", "COMPLETED"]


def batch_yield(rows: DataFrame, key: str, batch: str = "batch_no") -> DataFrame:
    """(batch, raw, new, total_unique): keys seen for the first time, and the running total."""
    first = rows.groupBy(key).agg(F.min(batch).alias(batch)).groupBy(batch).agg(F.count("*").alias("new"))
    per = rows.groupBy(batch).agg(F.count("*").alias("raw")).join(first, batch, "left").withColumn("new", F.coalesce("new", F.lit(0)))
    return per.withColumn("total_unique", F.sum("new").over(W.orderBy(batch)))  # one row for each batch


def adaptive_stop(rows: DataFrame, key: str, target: int, batch: str = "batch_no", pages_per_batch: int = 20, low: float = 0.02, patience: int = 3) -> DataFrame:
    """Each batch with the reason, if any, to stop after it, and whether it would have run."""
    b = batch_yield(rows, key, batch)
    w = W.orderBy(batch)
    budget = min(-(-5 * target // 20), 400)
    b = b.withColumn("no", F.row_number().over(w)).withColumn("pages", F.col("no") * pages_per_batch)
    is_low = (F.col("no") > 1) & (F.col("new") / F.greatest("raw", F.lit(1)) < low)
    b = b.withColumn("low", is_low.cast("int")).withColumn("streak", F.col("no") - F.max(F.when(F.col("low") == 0, F.col("no")).otherwise(0)).over(w))
    why = F.when(F.col("total_unique") >= 5 * target, "UNIQUE").when(F.col("pages") >= budget, "PAGES").when(F.col("streak") >= patience, "LOW_YIELD")
    b = b.withColumn("stop", why)
    return b.withColumn("ran", F.coalesce(F.max(F.col("stop").isNotNull().cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) == 0)


def progress_pct(batch: Column, total: Column) -> Column:
    return F.least(F.lit(84), 35 + F.floor(batch / total * 50)).cast("int")


def stage_index(stage: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, s in enumerate(STAGES) for x in (s, i)]), stage), F.lit(0))


def unique_stream(stream: DataFrame, key: str, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """First row of each key of a stream; with an event time the state is bounded by the watermark."""
    if event_time:
        return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


def windowed_counts(stream: DataFrame, event_time: str, by: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, window), by).agg(F.count("*").alias("n"))


def each_batch(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

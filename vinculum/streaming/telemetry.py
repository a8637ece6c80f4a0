"""Telemetry: summaries of the newest samples, counters, and an append-only stream of events."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WINDOW = 1000


def summary(events: DataFrame, by: str = "event_type", value: str = "value") -> DataFrame:
    """Per name over its newest 1000 samples: n, mean, min, max and nearest-rank p50, p95, p99."""
    newest = F.row_number().over(W.partitionBy(by).orderBy(F.desc("ts"), F.desc("event_id")))
    kept = events.withColumn("rn", newest).filter(F.col("rn") <= WINDOW)
    ranks = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(100 * p)}") for p in (0.5, 0.95, 0.99)]
    return kept.groupBy(F.col(by).alias("name")).agg(
        F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), *ranks
    )


def counters(events: DataFrame, by: str = "event_type") -> DataFrame:
    return events.groupBy(F.col(by).alias("name")).agg(F.count("*").alias("n"))


def ring(events: DataFrame, size: int, by: str = "event_type") -> DataFrame:
    """event_id and name of the newest ``size`` events of each name: what a ring buffer still holds."""
    newest = F.row_number().over(W.partitionBy(by).orderBy(F.desc("ts"), F.desc("event_id")))
    return events.withColumn("rn", newest).filter(F.col("rn") <= size).select("event_id", by)


def since(events: DataFrame, mark) -> DataFrame:
    """What is strictly newer than the high-water mark."""
    return events.filter(F.col("ts") > F.lit(mark))


def stream_counters(spark: SparkSession, path: str, schema: str, minutes: int = 60, late: str = "1 hour") -> DataFrame:
    """Streaming counts per event-time window; events later than the watermark are dropped by it."""
    events = spark.readStream.schema(schema).parquet(path)
    return events.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes"), "event_type").agg(F.count("*").alias("n"))


def stream_ring(spark: SparkSession, path: str, schema: str, size: int = WINDOW):
    """A stream of (name, n, mean, min, max, p50) over the newest ``size`` samples of each name, held as state.

    The samples of a name are the state of its group, ``size`` numbers at most, so memory grows
    with the names alone; a batch's samples come in event order within each name.
    """
    import pandas as pd

    def update(key, frames, state):
        held = list(state.get[0]) if state.exists else []
        new = pd.concat(list(frames)).sort_values(["ts", "event_id"])["value"].tolist()
        held = (held + new)[-size:]
        state.update((held,))
        ranked = sorted(held)
        yield pd.DataFrame([(key[0], len(held), sum(held) / len(held), ranked[0], ranked[-1], ranked[-(-len(ranked) // 2) - 1])], columns=["name", "n", "mean", "min", "max", "p50"])

    events = spark.readStream.schema(schema).parquet(path)
    return events.groupBy("event_type").applyInPandasWithState(update, "name string, n long, mean double, min double, max double, p50 double", "held array<double>", "update", "NoTimeout")


class timed:
    """Adds (name, seconds) of a block to a list: ``with timed("scan", samples): ...``."""

    def __init__(self, name: str, samples: list):
        self.name, self.samples = name, samples

    def __enter__(self):
        self.began = time.perf_counter()
        return self

    def __exit__(self, *_) -> None:
        self.samples.append((self.name, time.perf_counter() - self.began))

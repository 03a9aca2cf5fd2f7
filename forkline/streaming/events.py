"""Logs of runs: an append-only stream of events, its tail, cursors, and merging of remote logs.

Events have seq (rising), ts, level, stage, message and run.  A stream is read with any Spark source; state is kept per run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CAPACITY = 500
# Stages of a run and their share of the whole, in percent.
STAGES = {"profile": 10, "trace": 60, "render": 20, "save": 10}


def tail(events: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The last ``capacity`` events: a top-k, of which each task keeps so many."""
    return events.orderBy(F.desc("seq")).limit(capacity)


def since(events: DataFrame, seq: int) -> DataFrame:
    """Events after a cursor; the comparison reaches the scan."""
    return events.where(F.col("seq") > seq).orderBy("seq")


def percent(events: DataFrame) -> DataFrame:
    """Completion of each run from its finished stages: run, percent, stage (the last seen)."""
    weights = F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv])
    done = events.where("message = 'done'").select("run", "stage").distinct().groupBy("run").agg(F.sum(F.coalesce(F.element_at(weights, F.col("stage")), F.lit(0))).alias("percent"))
    last = events.groupBy("run").agg(F.max_by("stage", "seq").alias("stage"))
    return last.join(done, "run", "left").select("run", F.coalesce("percent", F.lit(0)).cast("long").alias("percent"), "stage")


def snapshot(events: DataFrame) -> DataFrame:
    """Per run: current stage, events so far, microseconds since the first."""
    return events.groupBy("run").agg(F.max_by("stage", "seq").alias("stage"), F.count("*").alias("events"), (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("micros"))


def _newer(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen = state.get[0] if state.exists else -1
    rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
    rows = rows[rows.seq > seen].drop_duplicates("seq")
    if len(rows):
        state.update((int(rows.seq.max()),))
    yield rows


def merged(stream: DataFrame) -> DataFrame:
    """Events of a stream that are newer than all adopted of their run before: each at most once, rising in seq.

    State is the greatest seq of each run; nothing waits for late events, which are dropped.
    """
    schema = stream.schema
    return stream.groupBy("run").applyInPandasWithState(_newer, schema, "seq long", "append", GroupStateTimeout.NoTimeout)


def windowed(stream: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events by stage and window of event time, those later than the watermark left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "stage").agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), "stage", "events")


def drained(stream: DataFrame, folder: str) -> StreamingQuery:
    """Append all that is there to a Parquet table, once, with the checkpoint beside it."""
    return stream.writeStream.format("parquet").option("path", f"{folder}/data").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()


def last_of_each(events: DataFrame, k: int) -> DataFrame:
    """The last k events of each run."""
    return events.withColumn("_rn", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("seq")))).where(F.col("_rn") <= k).drop("_rn")


def events_of(spark: SparkSession, sf_dir: str, streaming: bool = False) -> DataFrame:
    """The driver's events as a log: users as runs, types as stages."""
    path = f"{sf_dir}/events.parquet"
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    rows = spark.readStream.schema(schema).format("parquet").load(path + "*") if streaming else spark.read.parquet(path)
    return rows.select(F.col("event_id").alias("seq"), "ts", F.lit("info").alias("level"), F.col("event_type").alias("stage"), F.when(F.col("event_id") % 3 == 0, "done").otherwise("step").alias("message"), F.col("user_id").alias("run"))

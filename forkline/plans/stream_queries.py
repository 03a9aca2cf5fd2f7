"""Logs of runs over the driver's events, in batch and as a stream drained once, with the same queries in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from forkline.session import new_folder, ship
from forkline.streaming import events as E


def _drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    ship(spark)
    folder = new_folder(spark, "stream")
    E.drained(stream, folder).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/data")


def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tail(E.events_of(spark, sf_dir)).select("seq", "run", "stage")


def log_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.since(E.events_of(spark, sf_dir), 900).select("seq", "run")


def run_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.snapshot(E.events_of(spark, sf_dir)).select("run", "stage", "events", "micros")


def run_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.last_of_each(E.events_of(spark, sf_dir), 3).select("run", "seq")


def stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event once, through the stateful operator."""
    return _drained(spark, E.merged(E.events_of(spark, sf_dir, streaming=True))).select("seq", "run", "stage")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed (those of the last ten minutes are still open)."""
    return _drained(spark, E.windowed(E.events_of(spark, sf_dir, streaming=True)))


SQL = {
    "log_tail": "SELECT event_id AS seq, user_id AS run, event_type AS stage FROM events ORDER BY event_id DESC LIMIT 500",
    "log_cursor": "SELECT event_id AS seq, user_id AS run FROM events WHERE event_id > 900",
    "run_snapshot": "SELECT user_id AS run, arg_max(event_type, event_id) AS stage, count(*) AS events, epoch_us(max(ts)) - epoch_us(min(ts)) AS micros FROM events GROUP BY 1",
    "run_tails": "SELECT run, seq FROM (SELECT user_id AS run, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 3",
    "stream_merge": "SELECT event_id AS seq, user_id AS run, event_type AS stage FROM events",
}
QUERIES = {f.__name__: f for f in (log_tail, log_cursor, run_snapshot, run_tails, stream_merge, stream_windows)}

"""What the operators need to know of the session: shared folder, bucket counts, package shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()
#: Spark's own bound on an Arrow batch, and ours: texts are long, and a task holds several copies of a batch.
BATCH, DEFAULT, SMALL = "spark.sql.execution.arrow.maxBytesPerBatch", "64MB", "8MB"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, where neither PYTHONPATH nor the working folder does, and bound Arrow batches
    to ``SMALL``, unless the session has a bound of its own."""
    if spark.conf.get(BATCH, None) in (DEFAULT, "67108864b", "67108864", None):
        spark.conf.set(BATCH, SMALL)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(":") or Path.cwd() == ROOT:
        return
    path = Path(tempfile.mkdtemp()) / "forkline.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(ROOT.glob("forkline/**/*.py")):
            out.write(file, file.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(path))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset a temporary one becomes it, in local mode alone: on a cluster
    executors would not see it."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="forkline-"))
        found = context.getCheckpointDir()
    return found


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh name under the shared folder, as a URI or an absolute path."""
    return f"{shared_folder(spark).rstrip('/')}/forkline-{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"


def materialised(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read that: a lost executor costs no recomputation, and Spark
    knows the size, so that joins are broadcast only below its threshold."""
    spark = df.sparkSession
    ship(spark)
    path = new_folder(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """The same, dealt by ``key`` into buckets of one file each, so that joins and groups by it need no shuffle of these rows."""
    spark = df.sparkSession
    ship(spark)
    name, n = f"forkline_{uuid.uuid4().hex}", partitions(spark)
    df.repartition(n, key).write.option("path", new_folder(spark, "table")).bucketBy(n, key).sortBy(key).saveAsTable(name)
    return spark.table(name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, key: str, rows: int = 1_000_000) -> DataFrame:
    """The same dealt by ``key`` into as many partitions as leave each about ``rows`` rows, but no fewer than others have: what a task
    holds does not grow with the input.  ``df`` is counted, which should be cheap, as it is for a file."""
    return df.repartition(max(partitions(df.sparkSession), -(-df.count() // rows)), key)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

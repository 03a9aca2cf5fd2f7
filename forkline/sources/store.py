"""Tables of sources, maps, explanations and edits, as versioned Parquet with upserts.

A table is a folder of versions; an upsert writes the next version and then moves the pointer, so that readers see one
whole version.  Tables are partitioned by repository, and point reads reach the Parquet scan as filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline.operators.relations import upsert

# Key columns and the column that tells whether a row changed.
TABLES = {
    "code_files": ("repo string, file_path string, language string, content string, content_hash string, updated_at timestamp", ["repo", "file_path"], "content_hash"),
    "repo_maps": ("user_id long, repo string, source string, payload string, created_at timestamp, updated_at timestamp", ["user_id", "repo"], "payload"),
    "explanations": ("fingerprint string, repo string, node_id string, payload string, created_at timestamp, updated_at timestamp", ["fingerprint"], "payload"),
    "diagram_edits": ("user_id long, repo string, edits string", ["user_id", "repo"], "edits"),
}


class Store:
    """The tables below a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _pointer(self, name: str) -> str:
        return f"{self.folder}/{name}/_versions"

    def version(self, name: str) -> int:
        """The newest version; 0 if there is none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._pointer(name))
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return 0
        return self.spark.read.schema("version long").json(self._pointer(name)).agg(F.max("version")).first()[0] or 0

    def read(self, name: str) -> DataFrame:
        version = self.version(name)
        schema = TABLES[name][0]
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/v{version}") if version else self.spark.createDataFrame([], schema)

    def put(self, name: str, rows: DataFrame) -> int:
        """Upsert rows; those whose value is as before are left as they are.  Returns the new version."""
        _, keys, changed = TABLES[name]
        table = self.read(name)
        version = self.version(name) + 1
        upsert(table, rows.select(table.columns), keys, changed).write.parquet(f"{self.folder}/{name}/v{version}")
        self.spark.range(1).select(F.lit(version).alias("version")).write.mode("append").json(self._pointer(name))
        return version

    def put_sources(self, sources: DataFrame, language: Column) -> int:
        """Sources (repo, path, content) with their hash."""
        rows = sources.select("repo", F.col("path").alias("file_path"), language.alias("language"), "content", F.sha2("content", 256).alias("content_hash"), F.current_timestamp().alias("updated_at"))
        return self.put("code_files", rows)

    def maps_of(self, user_id: int) -> DataFrame:
        """Maps of a user, newest first, without payload (which the scan then does not read)."""
        return self.read("repo_maps").where(F.col("user_id") == user_id).select("repo", "source", "created_at", "updated_at").orderBy(F.desc("updated_at"))

    def updated_at(self, user_id: int, repo: str) -> DataFrame:
        return self.read("repo_maps").where((F.col("user_id") == user_id) & (F.col("repo") == repo)).select("updated_at")


def cached(rows: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is in the cache, with its value; and the first row of each key that is not."""
    hits = rows.join(cache, key)
    misses = rows.join(cache.select(key), key, "left_anti").dropDuplicates([key])
    return hits, misses

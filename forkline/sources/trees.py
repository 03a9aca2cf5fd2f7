"""Source trees and archives as tables: repo, path, content."""

from __future__ import annotations

import io
import lzma
import tarfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline.session import ship

# Names that are no source of the program.
SKIPPED_FILES = ("__init__.py", "conftest.py")
SKIPPED_DIRS = ("__pycache__", ".venv", "venv", "tests", "test")
MANIFESTS = ("package.json", "pyproject.toml", "requirements.txt", "setup.py", "setup.cfg", "Pipfile", "go.mod", "Cargo.toml", "pom.xml")
SCHEMA = "repo string, path string, content string"


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_source(path: Column) -> Column:
    """Python files of the program: not package markers, test settings, caches, environments or tests."""
    return F.endswith(path, F.lit(".py")) & ~basename(path).isin(*SKIPPED_FILES) & ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIPPED_DIRS)))


def is_test_path(path: Column) -> Column:
    return path.rlike(r"(^|/)(tests|test)/|(^|/)test_[^/]*$|_test\.py$|(^|/)conftest\.py$")


def is_manifest(path: Column) -> Column:
    return basename(path).isin(*MANIFESTS)


def under_any(path: Column, directories: list[str] | None) -> Column:
    """Whether a path is one of the directories or below one; all paths, if none are asked for."""
    if not directories:
        return F.lit(True)
    out = F.lit(False)
    for d in directories:
        d = d.strip("/")
        out = out | (path == d) | F.startswith(path, F.lit(f"{d}/")) | F.lit(d in ("", "."))
    return out


def without_nested_repos(paths: DataFrame) -> DataFrame:
    """Paths that are not below a directory, other than the top, that holds ``.git``."""
    nested = paths.where(F.col("path").rlike(r"^.+/\.git(/|$)")).select("repo", F.regexp_extract("path", r"^(.+?)/\.git(?:/|$)", 1).alias("top")).distinct()
    parts = F.split("path", "/")
    above = paths.select("repo", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("top"))
    return paths.join(above.join(nested, ["repo", "top"], "left_semi").select("repo", "path"), ["repo", "path"], "left_anti")


def read_tree(spark: SparkSession, root: str, repo: str, directories: list[str] | None = None, tests: bool = False) -> DataFrame:
    """Source files below ``root`` (any path Spark reads): names are filtered before any content is decoded.

    Bytes that are no UTF-8 become U+FFFD.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").load(root)
    base = "/" + root.split("://")[-1].strip("/").split(":")[-1].strip("/") + "/"
    path = F.element_at(F.split("path", base, 2), 2)
    kept = files.select(F.lit(repo).alias("repo"), path.alias("path"), "content").where(is_source(F.col("path")) | F.lit(tests)).where(under_any(F.col("path"), directories))
    return kept.select("repo", "path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def _members(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for repo, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                rows: list[tuple] = []
                try:
                    with tarfile.open(fileobj=io.BytesIO(data or b""), mode="r:*") as archive:
                        for member in archive:
                            parts, name = member.name.split("/"), member.name.removeprefix("./")
                            if not member.isfile() or member.name.startswith("/") or ".." in parts:
                                continue
                            if member.size > most:
                                rows.append((repo, name, None, f"too large: {member.size}"))
                            else:
                                rows.append((repo, name, archive.extractfile(member).read().decode("utf-8", errors="replace"), None))
                            if len(rows) == 500:
                                yield _batch(rows)
                                rows = []
                except (tarfile.TarError, EOFError, OSError, zlib.error, lzma.LZMAError) as error:
                    rows.append((repo, None, None, f"damaged: {type(error).__name__}"))
                if rows:
                    yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows)], names=["repo", "path", "content", "problem"])


def read_archives(archives: DataFrame, most: int = 4 << 20) -> DataFrame:
    """Members of tar archives (repo, data: binary; compressed or plain): links, devices and names that leave the archive are skipped.

    Nothing is extracted to disk.  Members of more than ``most`` bytes have null content, and an archive that is damaged
    gives the members before the damage and a row without path; ``problem`` says why, and is null for all others.
    """
    ship(archives.sparkSession)
    return archives.select("repo", "data").mapInArrow(_members(most), SCHEMA + ", problem string")

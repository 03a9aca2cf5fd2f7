"""Quality classifier: a regularised quadratic discriminant over transformed statistics of whole texts.

Each class is a normal distribution; its covariance is shrunk towards the variances of all classes together.  A score is the
logistic of the log prior ratio plus the difference of the log densities, whose Mahalanobis distances come from
the Cholesky factors of the covariances, computed once.  Statistics and sums are computed by tasks; the driver
sees one row of sums a class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forkline.llm.hashing import Words, slices, word_hashes
from forkline.llm.memory import tidy
from forkline.session import materialised, ship

# Kinds of bytes: lower case, upper case, digits, blanks, line ends, marks that end phrases, "!", "|", odd symbols, other ASCII, beyond ASCII.
KINDS = 11
_KIND = np.full(256, 9, dtype=np.int64)
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\x0b\x0c", b".,;:?'\"-()", b"!", b"|", b"#$%&*@^~<>=+_\\{}[]/`")):
    _KIND[list(_bytes)] = _k
_KIND[128:] = 10
FEATURES = 20


def statistics(words: Words) -> np.ndarray:
    """One row of ``FEATURES`` transformed statistics for each document of a slice."""
    n = words.documents
    sizes = np.diff(words.offsets)
    document = np.repeat(np.arange(n), sizes)
    counts = np.bincount(document * KINDS + _KIND[words.data], minlength=n * KINDS).reshape(n, KINDS).astype(np.float64)
    size = np.maximum(sizes, 1)[:, None]
    n_words = np.diff(words.first)
    of_word = np.repeat(np.arange(n), n_words)
    widths = (words.ends - words.starts).astype(np.float64)
    per_word = np.maximum(n_words, 1)
    mean = np.bincount(of_word, widths, minlength=n) / per_word
    spread = np.sqrt(np.maximum(np.bincount(of_word, widths**2, minlength=n) / per_word - mean**2, 0))
    capital = np.zeros(len(widths), dtype=bool)
    if len(widths):
        capital = (_KIND[words.data[words.starts]] == 1) & (_KIND[words.data[words.ends - 1]] != 0)
    distinct, again = np.zeros(n), np.zeros(n)
    hashes = word_hashes(words, fold=True)
    for d, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
        if b > a:
            own = np.sort(hashes[a:b])
            new = np.flatnonzero(own[1:] != own[:-1])
            runs = np.diff(np.concatenate(([-1], new, [b - a - 1])))
            distinct[d] = len(runs) / np.sqrt(b - a)
            again[d] = runs.max() / (b - a)
    follows = np.zeros(n)
    if len(hashes) > 1:
        same = (hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1])
        follows = np.bincount(of_word[1:], same, minlength=n) / per_word
    log = lambda share: np.log(share + 1e-3)
    return np.column_stack(
        (log(counts / size), np.log1p(n_words), mean.clip(0, 40), spread.clip(0, 40), log(np.bincount(of_word, capital, minlength=n) / per_word), np.log1p(distinct), log(again), log(follows), log(counts[:, 6] / per_word), log(counts[:, 7] / per_word))
    )


@dataclass(frozen=True)
class Discriminant:
    """Scores documents by their statistics; made by ``fit``."""

    prior: float  # log of the ratio of class 1 to class 0
    means: np.ndarray
    factors: np.ndarray  # inverse Cholesky factors
    determinants: np.ndarray  # logs

    def scores(self, x: np.ndarray) -> np.ndarray:
        density = [-0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.determinants)]
        return 1 / (1 + np.exp(-np.clip(self.prior + density[1] - density[0], -700, 700)))


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float) -> Discriminant | None:
    """From the count, sum and sum of outer products of each class; None unless both classes have rows."""
    if set(sums) != {0, 1}:
        return None
    means, factors, determinants = [], [], []
    for label in (0, 1):
        n, total, outer = sums[label]
        mean = total / n
        spread = outer / n - np.outer(mean, mean)
        scale = np.diag(sum(s[2] for s in sums.values()) / sum(s[0] for s in sums.values())) - (sum(s[1] for s in sums.values()) / sum(s[0] for s in sums.values())) ** 2
        spread = (1 - shrinkage) * spread + shrinkage * np.diag(np.maximum(scale, 1e-6))
        factor = np.linalg.cholesky(spread)
        means.append(mean)
        factors.append(np.linalg.inv(factor))
        determinants.append(2 * np.log(np.diag(factor)).sum())
    return Discriminant(float(np.log(sums[1][0] / sums[0][0])), np.array(means), np.array(factors), np.array(determinants))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        for words in slices(part.column(1)):
            x = statistics(words)
            yield pa.RecordBatch.from_arrays([part.column(0).slice(words.begin, words.documents), pa.array([row.tobytes() for row in x], pa.binary())], names=["doc_id", "x"])


def described(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and x, the statistics of each text as 64-bit floats (binary); null texts are empty."""
    ship(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(_described), "doc_id long, x binary")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (label, n, total, outer) or (label, 1, x, null) to one row a label."""
    sums: dict[int, list] = {}
    for part in batches:
        for label, n, total, outer in zip(*(part.column(k).to_pylist() for k in range(4))):
            total = np.frombuffer(total)
            outer = np.outer(total, total) if outer is None else np.frombuffer(outer).reshape(len(total), -1)
            if label in sums:
                for held, value in zip(sums[label], (n, total, outer)):
                    held += value
            else:
                sums[label] = [np.array(float(n)), total.copy(), outer.copy()]
    rows = [(k, int(n), t.tobytes(), o.tobytes()) for k, (n, t, o) in sums.items()]
    columns = [list(c) for c in zip(*rows)] if rows else [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["label", "n", "total", "outer"])


def trained(statistics: DataFrame, labels: DataFrame, shrinkage: float = 0.1, label: str = "quality") -> Discriminant | None:
    """Fit on all rows of ``statistics`` that ``labels`` (doc_id, label 0 or 1) marks; other labels and nulls are ignored."""
    marked = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    rows = statistics.join(marked, "doc_id").select("label", F.lit(1).cast("long").alias("n"), F.col("x").alias("total"), F.lit(None).cast("binary").alias("outer"))
    schema = "label int, n long, total binary, outer binary"
    partial = rows.mapInArrow(tidy(_summed), schema)  # a row a class from each task
    sums = partial.repartition("label").mapInArrow(tidy(_summed), schema)
    return fit({r.label: (float(r.n), np.frombuffer(r.total), np.frombuffer(r.outer).reshape(FEATURES, -1)) for r in sums.collect()}, shrinkage)


def scored(statistics: DataFrame, model: Discriminant | None) -> DataFrame:
    """doc_id and score of rows (doc_id, x); 0.5 without a model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            x = np.frombuffer(b"".join(part.column(1).to_pylist())).reshape(-1, FEATURES)
            scores = model.scores(x) if model is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores)], names=["doc_id", "score"])

    return statistics.mapInArrow(tidy(run), "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 3 is 1; null ids are not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, shrinkage: float = 0.1) -> DataFrame:
    """One row a document: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= 0.5).

    Labels are learnt only from rows that are not held out.  Null and empty texts are scored by their statistics like
    others; doc_id may be null or repeated; a repeated doc_id with a label counts with each of its rows.  Without
    labelled rows of both classes every score is 0.5.  Empty tables give an empty result; other columns are not read.
    """
    known = materialised(described(docs))
    model = trained(known.where(~held_out(F.col("doc_id"))), labels, shrinkage)
    out = scored(known, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def kept(docs: DataFrame, model: Discriminant | None, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``least``, all columns as they are; every row without a model.

    Texts are scored where they are read, so that nothing is shuffled.
    """
    ship(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for words in slices(part.column(at)):
                yield part.slice(words.begin, words.documents).filter(pa.array(model.scores(statistics(words)) >= least))

    return docs if model is None else docs.mapInArrow(tidy(run), docs.schema)

"""The quality classifier against a discriminant written out with covariances, determinants and solved systems."""

from __future__ import annotations

import zlib

import numpy as np

from forkline.llm.quality import described, quality
from tests.conftest import SF


def test_scores_are_those_of_the_written_out_discriminant(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    x = {r.doc_id: np.frombuffer(r.x) for r in described(docs).collect()}
    marked = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1)}
    held = {d: zlib.crc32(str(d).encode()) % 3 == 1 for d in x}
    known = {k: np.array([x[d] for d in x if not held[d] and marked.get(d) == k]) for k in (0, 1)}
    together = np.concatenate(list(known.values())).var(axis=0)
    covariance = {k: 0.9 * np.cov(v.T, bias=True) + 0.1 * np.diag(np.maximum(together, 1e-6)) for k, v in known.items()}

    def density(k, v):
        apart = v - known[k].mean(axis=0)
        return np.log(len(known[k])) - 0.5 * (np.linalg.slogdet(covariance[k])[1] + apart @ np.linalg.solve(covariance[k], apart))

    found = quality(docs, labels).collect()
    assert len(found) == len(x)
    for r in found:
        wanted = 1 / (1 + np.exp(-np.clip(density(1, x[r.doc_id]) - density(0, x[r.doc_id]), -700, 700)))
        assert r.held_out == held[r.doc_id] and r.predicted == (r.score >= 0.5) and abs(r.score - wanted) < 1e-6

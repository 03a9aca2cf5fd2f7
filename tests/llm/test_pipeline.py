"""The pipeline's stages on awkward documents, on empty tables and against brute force."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as pipeline
from forkline.llm.queries import QUERIES, SQL, BYTE_BPE, tokenizer
from forkline.session import materialised
from tests.conftest import SF
from tests.llm import brute
from tests.test_queries import same


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """A folder with labels alone; stages get their documents as they are."""
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_are_those_agreed():
    assert [name for name, _ in pipeline.STAGES] == ["quality", "near_duplicates", "substring_dedup", "packing"]


@pytest.mark.parametrize("k", range(4))
def test_stages_take_awkward_and_empty_documents(spark, docs, empty, tables, k):
    stage = pipeline.STAGES[k][1]
    for df in (docs, empty):
        out = stage(spark, df, tables)
        out.collect()
        assert k == 3 or out.columns == df.columns


def test_near_duplicate_stage(spark, docs, rows, tables):
    kept = Counter(r.doc_id for r in pipeline.near_duplicate_stage(spark, docs, tables).collect())
    wanted = {d for d, _, c in brute.near_duplicates(rows) if d is not None and d == c}
    assert kept == Counter(wanted) + Counter([d for d, _ in rows if d is None])


def test_substring_stage(spark, docs, rows, tables):
    out = pipeline.substring_stage(spark, docs, tables).collect()
    wanted = Counter()
    for (d, text), (_, _, removed, kept) in zip(rows, brute.substrings(rows)):
        new = kept if removed else text
        wanted[d, new, None if new is None else len(new)] += 1
    assert Counter((r.doc_id, r.text, r.n_chars) for r in out) == wanted


def test_pipeline_end_to_end(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = materialised(pipeline.quality_stage(spark, docs, SF))
    left = {r.doc_id: r.text for r in good.collect()}
    marked = [d for d in labels if d in {r.doc_id for r in docs.select("doc_id").collect()}]
    assert np.mean([(d in left) == (labels[d] == 1) for d in marked]) > 0.95
    unique = brute.near_duplicates(sorted(left.items()))
    texts = [(d, left[d]) for d in sorted(d for d, _, c in unique if d == c)]
    final = {d: kept if removed else text for (d, text), (_, _, removed, kept) in zip(texts, brute.substrings(texts))}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer(BYTE_BPE))
    pieces = {}
    for r in pipeline.run(spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    assert pieces.keys() == final.keys()
    for d, text in final.items():
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for start, length, crc in sorted(pieces[d]):
            assert start == at and zlib.crc32(ids[start : start + length].tobytes()) == crc
            at += length
        assert at == len(ids)


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_against_sql(spark, duck, name):
    same(spark, duck, name, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_queries_run(spark, name):
    out = QUERIES[name](spark, SF)
    n = spark.read.parquet(f"{SF}/{'embeddings' if name.startswith('op4') else 'documents'}.parquet").count()
    assert out.count() >= (n // 50 if name.startswith("op4") else n)

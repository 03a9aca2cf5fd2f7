"""The registered queries by value, over the whole smallest tables."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as pipeline
from forkline.llm.queries import BYTE_BPE, QUERIES, WORD_BPE, tokenizer
from tests.conftest import SF
from tests.llm import brute


@pytest.fixture(scope="module")
def texts(spark):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())


def encoded(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer(name))
    return t, {d: t.encode(x or "", add_special_tokens=False).ids for d, x in texts}


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def rows(spark, name, *columns):
    return Counter(tuple(r) for r in QUERIES[name](spark, SF).select(*columns).collect())


def test_op2(spark, texts):
    assert rows(spark, "op2_ngram_join", "doc_id", "n_shingles", "component_id") == Counter(brute.near_duplicates(texts))


def test_op4(spark):
    vectors = {r.vec_id: np.floor(np.array(r[1], dtype=np.float64) * 256).astype(np.int64) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", [c for c, k in spark.read.parquet(f"{SF}/embeddings.parquet").dtypes if k.startswith("array")][0]).collect()}
    wanted = Counter()
    for q in (v for v in vectors if v % 50 == 0):
        best = sorted((-int(vectors[q] @ x), v) for v, x in vectors.items() if v != q)[:5]
        wanted.update((q, k + 1, v, -s) for k, (s, v) in enumerate(best))
    assert rows(spark, "op4_threshold_search", "query_id", "rank", "vec_id", "score") == wanted


def test_op6(spark, texts):
    wanted = Counter((d, n, removed, brute.sha(kept or "")) for d, n, removed, kept in brute.substrings(texts))
    assert rows(spark, "op6_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256") == wanted


def test_op7(spark, texts):
    _, ids = encoded(BYTE_BPE, texts)
    found, places = {}, {}
    for r in QUERIES["op7_packing"](spark, SF).collect():
        whole = [*ids[r.doc_id], 1]
        assert r.doc_tokens == len(whole) and r.ids_crc32 == crc(whole[r.start : r.start + r.length])
        found.setdefault(r.doc_id, []).append((r.start, r.length))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {d: sum(n for _, n in ps) for d, ps in found.items()} == {d: len(x) + 1 for d, x in ids.items()}
    for ps in [*found.values(), *places.values()]:
        ends = np.cumsum([0, *(n for _, n in sorted(ps))])
        assert [a for a, _ in sorted(ps)] == ends[:-1].tolist()
    assert max(sum(n for _, n in ps) for ps in places.values()) <= 2048


def test_op8(spark, texts):
    _, ids = encoded(WORD_BPE, texts)
    start, wanted = 0, Counter()
    for d, _ in texts:
        whole = [*ids[d], 1]
        wanted[d, start, len(whole), crc(whole)] += 1
        start += len(whole)
    assert rows(spark, "op8_id_store", "doc_id", "start", "n_tokens", "ids_crc32") == wanted


def test_op9(spark, texts):
    t, ids = encoded(BYTE_BPE, texts)
    wanted = Counter((d, len(x), brute.sha(",".join(map(str, x))), brute.sha(t.decode(x, skip_special_tokens=False))) for d, x in ids.items())
    assert rows(spark, "op9_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == wanted


def test_near_duplicates_of_one_id_with_two_texts(spark):
    """Unlike texts of one doc_id are documents of their own; of like ones one stays."""
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    docs = spark.createDataFrame([(1, a), (1, b), (2, a + " more"), (3, b), (1, a)], "doc_id long, text string")
    kept = Counter((r.doc_id, r.text) for r in pipeline.near_duplicate_stage(spark, docs, SF).collect())
    assert kept == Counter([(1, a), (1, b)])

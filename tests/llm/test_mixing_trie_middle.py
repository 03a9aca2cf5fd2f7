"""Mixing, prefix tries and fill-in-middle against brute force, with awkward rows and small ranges, chunks and buckets."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from forkline.llm import middle
from forkline.llm.middle import fill_in_middle, fill_in_middle_digests, outputs, restored
from forkline.llm.mixing import mixed
from forkline.llm.prefix_trie import prefix_trie
from tests.llm import brute


def awkward_sources(rows):
    names = ["b", "a", None, "Z", "é", "", "\U0001f600", "￿"]
    return [(d, t, names[0] if k % 3 else names[k // 3 % len(names)]) for k, (d, t) in enumerate(rows)] + [(50, None, "empty"), (51, " ", "empty")]


@pytest.mark.parametrize("bits", [12, 4])
def test_mixing(spark, rows, bits):
    given = awkward_sources(rows)
    docs = spark.createDataFrame([(*r, 1, 2) for r in given], "doc_id long, text string, source string, size long, key long").repartition(3)
    found = mixed(docs, bits=bits).select("doc_id", "size", "source_size", "target", "taken")
    again = mixed(docs.repartition(5), bits=bits).select(*found.columns)
    wanted = Counter(brute.mix(given))
    assert Counter(map(tuple, found.collect())) == wanted == Counter(map(tuple, again.collect()))
    assert all(r.taken <= 3 * r.size for r in found.collect())
    assert mixed(docs.limit(0)).count() == 0


def test_mixing_meets_targets_and_smaller_budgets_are_nested(spark):
    r = random.Random(3)
    given = [(k, " ".join(["w"] * r.randrange(30)), "big" if k % 3 else f"s{k % 11}") for k in range(900)]
    docs = spark.createDataFrame(given, "doc_id long, text string, source string")
    small, large = (mixed(docs, weights=w, bits=4).collect() for w in ((1, 2, 3), (1, 2, 4)))
    for rows in (small, large):
        taken, target = defaultdict(int), {}
        for x in rows:
            taken[x.source] += x.taken
            target[x.source] = x.target
        assert all(abs(taken[s] - target[s]) <= 15 for s in target)
        assert sum(target.values()) == pytest.approx(sum(len(t.split()) for _, t, _ in given))
    for s in {x.source for x in small}:
        less, more = sorted(([x for x in rows if x.source == s] for rows in (small, large)), key=lambda rows: rows[0].target)
        assert {x.doc_id: x.copies for x in less}.items() <= {x.doc_id: x.copies for x in more}.items() or all(dict((y.doc_id, y.copies) for y in more)[x.doc_id] >= x.copies for x in less)


def test_mixing_takes_some_of_many_equal_rows(spark):
    given = [(None, "one two three", "same")] * 500 + [(k, "a b", "other") for k in range(90)]
    docs = spark.createDataFrame(given, "doc_id long, text string, source string").repartition(4)
    assert Counter(map(tuple, mixed(docs).select("doc_id", "size", "source_size", "target", "taken").collect())) == Counter(brute.mix(given))


def conversations(seed):
    r = random.Random(seed)
    turns = [("user", "hi"), ("assistant", "hello é😀"), (None, "hi"), ("user", None), ("", ""), ("system", "a b"), ("user", "x")]
    rows = []
    for c in [*range(0, 40), 100, 101, 105, 199, 205, 207, 208, 317, -1, -7, -105, -200, 2**40]:
        n = r.randrange(0, 9)
        start = [None] if r.random() < 0.2 else []
        rows += [(c, t, *(turns[k % 2] if r.random() < 0.8 else r.choice(turns))) for k, t in enumerate([*start, *range(n)])]
    return rows + [(None, 0, "user", "nobody's")]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("rows", [100_000, 5])
def test_prefix_trie(spark, seed, rows):
    given = conversations(seed)
    df = spark.createDataFrame([(*g, 1) for g in given], "conv_id long, turn long, role string, text string, depth long").repartition(3)
    assert Counter(map(tuple, prefix_trie(df, rows=rows).collect())) == Counter(brute.trie(given))
    assert prefix_trie(df.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [100_000, 7])
def test_prefix_trie_of_one_long_conversation_and_its_copies(spark, rows):
    """Two long conversations that share most turns, a base that many copy, repeated rows, and turns in one place."""
    long = [(c, k, "user", f"t{k % 5}") for c in (300, 307, 4) for k in range(60)] + [(307, 60, "user", "more"), (4, 30, "user", "t0"), (4, 30, "user", "t0")]
    copies = [(c, k, "user", f"t{k % 5}") for c in range(500, 560) for k in range(3)]
    df = spark.createDataFrame(long + copies, "conv_id long, turn long, role string, text string").repartition(4)
    assert Counter(map(tuple, prefix_trie(df, rows=rows).collect())) == Counter(brute.trie(long + copies))


def middles(rows):
    r = random.Random(4)
    more = ["".join(r.choice(["\n", "a", "é", "😀", "<", "P", "S", ">", "ab\n"]) for _ in range(r.randrange(0, 40))) for _ in range(300)]
    fixed = ["<P>", "a<S>b\n", "x\n<M", "<<P>", "<P\n>", "\n", "\n\n\n", "a\n", "a\nb", "\r\n\r", "a b\n", "<M", "end<"]
    return [*rows, *((1000 + k, t) for k, t in enumerate(more + fixed)), (1000, "twice\n"), (1000, "twice\n")]


@pytest.mark.parametrize("chunk", [1 << 16, 5])
def test_fill_in_middle(spark, rows, chunk):
    given = middles(rows)
    if chunk == 5:
        given = [g for g in given if len(g[1] or "") < 3000]
    docs = spark.createDataFrame([(*g, 1, 2) for g in given], "doc_id long, text string, n long, row long").repartition(3)
    out = fill_in_middle(docs, chunk=chunk)
    whole = defaultdict(list)
    for x in out.collect():
        whole[x.row].append(x)
    found = Counter((*(x := parts[0])[1:6], "".join(p.output for p in sorted(parts, key=lambda p: p.at or 0))) for parts in whole.values())
    wanted = Counter(brute.filled(*g) for g in given)
    assert found == wanted
    again = defaultdict(list)
    for x in restored(out).collect():
        again[x.row].append(x)
    assert Counter((parts[0].doc_id, "".join(p.text for p in sorted(parts, key=lambda p: p.at or 0))) for parts in again.values()) == Counter((d, t or "") for d, t in given)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert Counter(map(tuple, fill_in_middle_digests(*outputs(docs, chunk=chunk)).collect())) == Counter((*w[:5], sha(w[5]), sha(t or "")) for g in given for w, t in [(brute.filled(*g), g[1])])
    assert fill_in_middle_digests(*outputs(docs.limit(0))).count() == 0


def test_fill_in_middle_at_other_rates(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc").alias("text"))
    forms = Counter(r.form for r in fill_in_middle(docs, seed=3, rate=40, spm=25).collect())
    assert forms == Counter(brute.filled(k, "a\nb\nc", 3, 40, 25)[2] for k in range(400))


def test_functions_of_chunks_compose_to_that_of_the_text():
    r = random.Random(8)
    for _ in range(2000):
        text = "".join(r.choice("\na<PSM>") for _ in range(r.randrange(0, 12))).encode()
        cuts = sorted(r.randrange(len(text) + 1) for _ in range(3))
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        left = middle.IDENTITY
        for p in parts:
            left = middle.composed(left, middle.transition(p))
        right = middle.IDENTITY
        for p in reversed(parts):
            right = middle.composed(middle.transition(p), right)
        assert left == right == middle.transition(text)

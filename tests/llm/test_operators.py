"""Each operator on awkward documents, on empty tables and against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from forkline.llm import bpe, hashing, id_store, media, packing, quality, token_counts
from forkline.llm.components import components
from forkline.llm import ngram_join as ngram
from forkline.llm.ngram_join import PrefixTree, ngram_join, required
from forkline.llm.queries import BYTE_BPE, WORD_BPE, tokenizer
from forkline.llm.substring_dedup import spark_xxhash64, substring_dedup
from forkline.llm.threshold_search import bound, search, threshold_search
from forkline.llm.url_filters import url_filters
from tests.llm import brute


def tokens_of(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer(name))


def test_url_filters(spark):
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("b.example.com", "", "block"), ("x", "/a/b", "allow"), ("x", "/a", "block"), ("net", "/de/", "allow"), ("net", "/de/", "block"), (None, "/", "block"), ("", "/q", "block"), ("org", None, "allow")]
    hosts = ["example.com", "www.example.com", "a.b.example.com", "xexample.com", "x", "y.x", "net", "n.net", "o.org", "COM", "q..com", "", "com."]
    paths = ["", "/", "/en/", "/en/7", "/en/71?q=/x", "/a", "/a/b", "/a/bc#f", "/de/1", "/EN/7", "/q", "//en/7"]
    urls = [None, "", "nothing", "://", "ftp:/x", "http://x/a://y", *(f"http://{h}{p}" for h in hosts for p in paths), "http://x/" + "a" * 5000, "http://" + "a." * 3000 + "com/en/7"]
    rows = [(k, u, "clash", "clash") for k, u in enumerate(urls)] + [(0, None, "clash", "clash"), (None, "http://x/a/b", "clash", "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    df = spark.createDataFrame(rules, "host string, path string, verdict string")
    found = Counter(tuple(r) for r in url_filters(pages, df, keep=("page_id",), salts=3).collect())
    kept = [("net", "/de/", "block"), ("org", "", "allow"), *[r for r in rules if r[0] and r[1] is not None and r[:2] != ("net", "/de/")]]
    assert found == Counter((r[0], *brute.judged(r[1], kept)) for r in rows)
    assert url_filters(pages.limit(0), df, keep=("page_id",)).count() == 0
    assert {r.verdict for r in url_filters(pages, df.limit(0), keep=("page_id",)).collect()} == {"allow"}
    plan = url_filters(pages, df, keep=("page_id",))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_ngram_join(docs, rows, empty):
    found = ngram_join(docs).collect()
    assert {tuple(r)[:3] for r in found} == brute.near_duplicates(rows)
    assert len(found) == len(rows)
    same = {}
    for d, t in rows:
        if d is not None and brute.shingles(t):
            same[frozenset(brute.shingles(t))] = min(d, same.get(frozenset(brute.shingles(t)), d))
    classes = {d: same.get(frozenset(brute.shingles(t)), d) for d, t in rows if d is not None}
    assert all(r.class_id == classes[r.doc_id] for r in found if r.doc_id is not None)
    assert ngram_join(empty).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_ngram_join_of_families(spark, seed):
    """Families of copies with a few edits each, chains of them, and a passage that all share."""
    r = random.Random(seed)
    base = [[f"w{r.randrange(300)}" for _ in range(80)] for _ in range(4)]
    common = [f"c{k}" for k in range(25)]
    texts = []
    for k in range(160):
        words = list(base[k % 4])
        for _ in range(r.randrange(5)):
            words[r.randrange(80)] = f"e{r.randrange(50)}"
        texts.append((k, " ".join(words + (common if k % 3 else []))))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    assert {tuple(x)[:3] for x in ngram_join(df).collect()} == brute.near_duplicates(texts)


@pytest.mark.parametrize("linked", [False, True])
def test_ngram_join_of_unlike_texts_round_a_common_passage(spark, monkeypatch, linked):
    """700 texts of which four fifths are one passage: unlike without a short one among them, one component with it."""
    passage = [f"c{k}" for k in range(20)]
    texts = [(k, " ".join([*passage, f"u{k}", f"v{k}", f"w{k % 7}", f"x{k}"])) for k in range(1, 701)]
    texts += [(3000 + k, " ".join([f"u{k}", *passage[:9], f"y{k % 3}", *passage[9:], f"z{k}"])) for k in range(100)]
    if linked:
        texts.append((0, " ".join([*passage, "short"])))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(8)
    made, verified = [], ngram.__dict__["_verified"]

    def counted(pairs, *rest):
        made.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(ngram, "_verified", counted)
    assert {tuple(x)[:3] for x in ngram_join(df).collect()} == brute.near_duplicates(texts)
    assert sum(made) < 100 * len(texts), made


def test_prefix_tree_finds_what_counting_finds():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 40)).astype(np.uint64)) for _ in range(80)] + [np.arange(30, dtype=np.uint64)] * 2
    sizes = [len(s) + int(r.integers(0, 3)) for s in sets]
    tree = PrefixTree(sets, sizes)
    for k in range(0, 82, 5):
        hits = [j for j in range(len(sets)) if len(np.intersect1d(sets[k], sets[j])) >= required(sizes[k], sizes[j], 75)]
        assert sorted(tree.linked(sets[k], sizes[k], 75)) == hits


def test_components_of_stars_chains_and_nothing(spark):
    pairs = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (3, 2)]
    found = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 140)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_substring_dedup(docs, rows, empty):
    out = substring_dedup(docs, carry=("source", "none"))
    found = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out.collect())
    assert found == Counter(brute.substrings(rows))
    assert all(r.n_removed == sum(s.end - s.start for s in r.spans) for r in out.collect())
    assert substring_dedup(empty).count() == 0


def test_substring_dedup_of_shared_passages(spark):
    r = random.Random(5)
    passage = [f"p{k}" for k in range(90)]
    rows = []
    for k in range(120):
        words = [f"w{r.randrange(40)}" for _ in range(r.randrange(10, 90))]
        at, a = r.randrange(len(words)), r.randrange(30)
        rows.append((r.randrange(80), " ".join(words[:at] + passage[a : a + r.randrange(40, 61)] * r.randrange(1, 3) + words[at:])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert Counter((x.doc_id, x.n_words, x.n_removed, x.kept_text) for x in substring_dedup(df).collect()) == Counter(brute.substrings(rows))


def test_xxhash_is_sparks(spark):
    values = [0, 1, -1, 2**63 - 1, -(2**63), 12345678901]
    wanted = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(F.xxhash64("v")).collect()]
    assert spark_xxhash64(np.array(values)).view(np.int64).tolist() == wanted


def test_word_hashes_tell_words_apart():
    import pyarrow as pa

    words = next(hashing.slices(pa.array(["ab ba a\tb", None, "AB aB"])))
    h = hashing.word_hashes(words, fold=True)
    assert len(set(h[:4].tolist())) == 4 and h[4] == h[5] == h[0]
    assert words.first.tolist() == [0, 4, 4, 6]


def test_token_counts(spark, docs, rows, empty):
    t = tokens_of(BYTE_BPE)
    t.encode_special_tokens = True
    edits = F.expr("array(named_struct('at', cast(floor(length(text) / 2) as long), 'removed', 7L, 'inserted', ' new\\''), named_struct('at', 0L, 'removed', 1L, 'inserted', 'Ü'), named_struct('at', 1000000000L, 'removed', 5L, 'inserted', 'end'), null)")
    found = Counter((r.doc_id, r.n_tokens, r.edited_tokens, r.edited_text) for r in token_counts.token_counts(docs, tokenizer(BYTE_BPE), edits).collect())
    wanted = Counter()
    for d, x in rows:
        x, y = x or "", x or ""
        h = len(y) // 2
        y = y[:h] + " new'" + y[h + 7 :]
        y = "Ü" + y[1:] + "end"
        wanted[d, len(t.encode(x).ids), len(t.encode(y).ids), y] += 1
    assert found == wanted
    assert token_counts.token_counts(empty, tokenizer(BYTE_BPE)).count() == 0


def test_special_strings_count_as_ordinary_text():
    counter = token_counts.Counter(tokenizer(BYTE_BPE))
    t = tokens_of(BYTE_BPE)
    t.encode_special_tokens = True
    for text in ("漢<|endoftext|>", "é“<|endoftext|>漢", "<|endoftext|>", "a<|endoftext|><|endoftext|> 漢", " <|endoftext|>\u2003é"):
        assert token_counts.Document(text, counter).tokens == len(t.encode(text).ids)
    d = token_counts.Document("漢漢", counter)
    d.edit(1, 0, "<|endoftext|>")
    assert d.tokens == len(t.encode("漢<|endoftext|>漢").ids)


@pytest.mark.parametrize("seed", range(3))
def test_edited_trees_count_as_whole_texts(seed):
    r = random.Random(seed)
    counter = token_counts.Counter(tokenizer(BYTE_BPE))
    t = tokens_of(BYTE_BPE)
    t.encode_special_tokens = True
    letters = [*"ab 'st\n\té漢 .,9  “", "<|endoftext|>", "<|endof", "text|>"]
    d = token_counts.Document("".join(r.choice(letters) for _ in range(r.choice((0, 50, 4000)))), counter)
    for _ in range(40):
        d.edit(r.randrange(0, len(d.text) + 2), r.choice((0, 1, 5, 300)), "".join(r.choice(letters) for _ in range(r.choice((0, 1, 3, 200)))))
        assert d.tokens == len(t.encode(d.text).ids)
        assert d.tree.sums[1, 0] == len(d.text)


def test_threshold_search(spark):
    r = random.Random(2)
    rows = [(k, [r.gauss(0, 0.3) for _ in range(6)]) for k in range(0, 900, 3)]
    rows += [(50, [1.0] * 6), (50, [0.5] * 6), (4000, rows[5][1]), (5, rows[5][1]), (7, None), (None, [0.1] * 6), (100000, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (100050, [float("nan")] * 6), (100100, [float("inf")] * 6), (200, [0.25, 0.5]), (201, [0.25, -0.5]), (250, []), (300, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<double>, rank int, part string").repartition(4)
    found = {tuple(x)[:4] for x in threshold_search(df).collect()}
    assert found == brute.nearest(rows)
    assert threshold_search(df.limit(0)).count() == 0


def test_threshold_stops_early_and_exactly():
    r = np.random.default_rng(0)
    rows = r.integers(-20, 20, (4000, 3))
    rows[:4] += 300
    ids = r.permutation(4000)
    queries = np.array([[3, 1, 2], [0, 0, 5], [-1, 4, 0], [0, 0, 0]])
    unknown = np.full(4, -(2**63))
    for (q, found, scores, met), query in zip(search(ids, rows, np.arange(10_000, 10_004), queries, unknown, 5), queries):
        s = rows @ query
        best = np.lexsort((ids, -s))[:5]
        assert found.tolist() == ids[best].tolist() and scores.tolist() == s[best].tolist()
        assert met < 2000 or not query.any()
    floors = np.array([np.sort(rows @ q)[-5] for q in queries])
    assert all(set(ids[np.lexsort((ids, -(rows @ q)))[:5]]) <= set(f[1].tolist()) | set(ids[rows @ q == np.sort(rows @ q)[-5]]) for f, q in zip(search(ids, rows, np.arange(10_000, 10_004), queries, floors, 5), queries))
    big = np.array([[2**62, 2**62], [-(2**62), 1]])
    assert [x[2].tolist() for x in search(np.array([1, 2]), big, np.array([9]), np.array([[4, 4]]), unknown, 5)] == [[2**63 - 1, -(2**63)]]


def test_bound_is_no_less_than_any_product():
    r = np.random.default_rng(3)
    for _ in range(300):
        d = int(r.integers(1, 12))
        rows = r.integers(-30, 30, (200, d))
        query = r.integers(-9, 10, d)
        length = float(np.sqrt((rows**2).sum(axis=1).max()))
        reached = rows[r.integers(0, 200)]
        below = rows[((rows * np.sign(query) <= reached * np.sign(query)) | (query == 0)).all(axis=1)]
        assert (below @ query).max() <= bound(query, reached, length) <= int(np.abs(query) @ np.maximum(reached * np.sign(query), -30)) + 2


def test_threshold_search_in_many_dimensions(spark):
    """64 dimensions, several blocks, groups of like vectors: equal to brute force, and queries stop before they met all rows."""
    r = np.random.default_rng(1)
    centres = r.normal(size=(12, 64)) * np.exp(-np.arange(64) / 6)
    vectors = centres[r.integers(0, 12, 9000)] + r.normal(size=(9000, 64)) * 0.01
    rows = [(int(k), [float(x) for x in v]) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = threshold_search(df, every=500).collect()
    whole = np.floor(256 * vectors).astype(np.int64)
    wanted = set()
    for q in range(0, 9000, 500):
        s = whole @ whole[q]
        s[q] = s.min() - 1
        wanted |= {(q, k, int(j), int(s[j])) for k, j in enumerate(np.lexsort((np.arange(9000), -s))[:5], 1)}
    assert {(x.query_id, x.rank, x.vec_id, x.score) for x in found} == wanted
    assert min(x.met for x in found) < 2000


def test_media(spark, docs, rows, empty):
    found = Counter((r.doc_id, r.n_bytes, r.payload_bytes, bytes(r.digest).hex(), zlib.crc32(r.tail)) for r in media.media_columns(docs).collect())
    assert found == Counter((d, len((t or "").encode()), len(p := brute.payload(t)), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])) for d, t in rows)
    assert media.media_columns(empty).count() == 0


def test_media_shards_are_tar_files_of_images(spark, docs, tmp_path):
    import tarfile

    rows = media.store(docs, str(tmp_path / "m")).collect()
    for r in rows:
        with tarfile.open(r.shard) as tar:
            data = tar.extractfile(f"{bytes(r.digest).hex()}.png").read()
        with open(r.shard, "rb") as file:
            file.seek(r.offset)
            assert file.read(r.length) == data
        assert hashlib.sha256(media.from_png(data)).digest() == bytes(r.digest)
    assert len({(r.shard, r.offset) for r in rows}) >= len({bytes(r.digest) for r in rows})


def test_packing(docs, rows, empty):
    t = tokens_of(BYTE_BPE)
    out = packing.packed(docs, tokenizer(BYTE_BPE)).collect()
    pieces = defaultdict(list)
    for r in out:
        assert zlib.crc32(r.ids) == brute.crc(np.frombuffer(r.ids, "<u4").tolist()) and len(r.ids) == 4 * r.length
        pieces[r.sequence_id].append((r.offset, r.length))
    for spans in pieces.values():
        spans.sort()
        assert [s[0] for s in spans] == np.cumsum([0, *[s[1] for s in spans]])[:-1].tolist() and sum(s[1] for s in spans) <= 2048
    docs_out = defaultdict(list)
    for r in out:
        docs_out[r.doc_id].append((r.start, bytes(r.ids)))
    for d in {d for d, _ in rows if d not in (None, 4)}:
        text = next(t for x, t in rows if x == d)
        assert np.frombuffer(b"".join(x[1] for x in sorted(docs_out[d])), "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids + [1]
    assert sum(r.length for r in out) == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in rows)
    assert packing.packed(empty, tokenizer(BYTE_BPE)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_assignment_fills_as_few_sequences_as_hold_the_tokens(seed):
    r = random.Random(seed)
    sizes = [r.choice((1, 5, 300, 900, 2000, 2048, 5000)) for _ in range(r.choice((1, 7, 200)))]
    pieces = packing.assign(sizes)
    assert Counter(d for d, _, n, _, _ in pieces for _ in range(n)) == Counter({d: n for d, n in enumerate(sizes)})
    used = Counter()
    for _, _, n, s, at in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert used[s] == at
        used[s] += n
    assert max(used.values()) <= 2048
    whole = sum(n // 2048 for n in sizes)
    assert len(used) == whole + -(-sum(n % 2048 for n in sizes) // 2048)


@pytest.mark.parametrize("seed", range(4))
def test_assignment_takes_the_cheapest_sequence_with_room(seed):
    r = random.Random(seed)
    sizes = [r.choice((1, 5, 30, 90, 120, 400, r.randrange(1, 200))) for _ in range(r.choice((1, 40, 150)))]
    capacity, cost = 128, lambda n: n + n * n / 2048
    wanted, number = [], 0
    for d, size in enumerate(sizes):
        for start in range(0, size - capacity + 1, capacity):
            wanted.append((d, start, capacity, number, 0))
            number += 1
    rest = sorted(((size % capacity, d, size - size % capacity) for d, size in enumerate(sizes) if size % capacity), key=lambda x: (-x[0], x[1]))
    bins = [[0.0, k, 0] for k in range(-(-sum(x[0] for x in rest) // capacity))]
    for length, d, start in rest:
        while length:
            open_bins = [b for b in bins if b[2] + length <= capacity] or [b for b in bins if b[2] < capacity]
            b = min(open_bins)
            take = min(length, capacity - b[2])
            wanted.append((d, start, take, number + b[1], b[2]))
            b[0], b[2], length, start = b[0] + cost(take), b[2] + take, length - take, start + take
    assert sorted(packing.assign(sizes, capacity, 1.0, 1 / 2048)) == sorted(wanted)


def test_id_store(docs, rows, empty):
    t = tokens_of(WORD_BPE)
    out = sorted(id_store.id_store(docs, tokenizer(WORD_BPE)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    at = 0
    for r in out:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    wanted = Counter((d, brute.crc(t.encode(x or "", add_special_tokens=False).ids + [1])) for d, x in rows)
    assert Counter((r.doc_id, zlib.crc32(r.ids)) for r in out) == wanted
    assert id_store.id_store(empty, tokenizer(WORD_BPE)).count() == 0


def test_id_store_keeps_a_chunk_once_and_finds_damage(spark, docs, tmp_path):
    folder = str(tmp_path / "ids")
    id_store.write_ids(docs.union(docs), tokenizer(WORD_BPE), folder)
    index = spark.read.parquet(f"{folder}/index").collect()
    assert len({bytes(r.digest) for r in index}) == len(index) == len({(r.pack, r.offset) for r in index})
    pack = max(index, key=lambda r: r.length)
    with open(pack.pack, "r+b") as file:
        file.seek(pack.offset + 20)
        byte = file.read(1)
        file.seek(pack.offset + 20)
        file.write(bytes([byte[0] ^ 255]))
    with pytest.raises(Exception):
        id_store.read_ids(spark, folder).collect()


def test_cuts_depend_on_content():
    r = np.random.default_rng(0)
    a, b = r.integers(0, 40_000, 60_000), r.integers(0, 40_000, 777)
    streams = [x.astype("<u4").tobytes() for x in (a, np.concatenate((b, a)), b[:3])]
    ends = id_store.cuts(streams)
    assert ends[2] == [3] and ends[0][-1] == 60_000 and max(np.diff(ends[0])) <= id_store.MOST
    assert len(set(ends[0]) & {e - 777 for e in ends[1]}) > 0.8 * len(ends[0])


def test_bpe(docs, rows, empty):
    t = tokens_of(BYTE_BPE)
    found = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.bpe_encode(docs, tokenizer(BYTE_BPE), decoded=True).collect())
    encoded = [(d, t.encode(x or "", add_special_tokens=False).ids) for d, x in rows]
    assert found == Counter((d, tuple(ids), t.decode(ids, skip_special_tokens=False)) for d, ids in encoded)
    back = bpe.bpe_decode(bpe.bpe_encode(docs, tokenizer(BYTE_BPE)), tokenizer(BYTE_BPE))
    assert Counter(r.decoded for r in back.collect()) == Counter(x or "" for _, x in rows)
    assert bpe.bpe_encode(empty, tokenizer(BYTE_BPE)).count() == 0


def test_bpe_on_odd_texts():
    r = random.Random(9)
    t, own = tokens_of(BYTE_BPE), bpe.load(tokenizer(BYTE_BPE))
    letters = "ab'stlvR \t\n\x85\xa0\x1c09½é漢\u200b\u0301\u3000“—😀µªº~!<|endoftext|>"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(50))) for _ in range(800)] + ["<|endoftext|>!<|endoftext|>", "a" * 3000]
    texts += ["".join(chr(r.choice((r.randrange(1, 0x300), r.randrange(0x300, 0xD800), r.randrange(0xE000, 0x1FFFF)))) for _ in range(30)) for _ in range(300)]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text
    broken = np.array([t.encode("漢").ids[0], 50256, 11], dtype="<u4")
    assert own.decode(broken.tobytes()) == t.decode(broken.tolist(), skip_special_tokens=False)


def test_pair_check_is_exact_merging():
    r = random.Random(4)
    own = bpe.load(tokenizer(BYTE_BPE))
    pairs = [(r.randrange(50_000), r.randrange(256, 50_000)) for _ in range(3000)]
    good = own.compatible(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    for (a, b), g in zip(pairs, good.tolist()):
        assert g == (own.merge(own.bytes_of[a] + own.bytes_of[b]) == [a, b])


def test_quality(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality(documents, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 50 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.95
    assert np.mean([s >= 0.5 for s in good]) > 0.97


def test_quality_learns_nothing_from_what_is_held_out(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.quality(documents, x).collect()} for x in (labels, other))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-9


def test_quality_of_awkward_documents(spark, docs, rows, empty):
    labels = spark.createDataFrame([(5, 1, 0), (9, 1, 0), (10, 0, 0), (100, 0, 0), (15, 0, 0), (14, None, 0), (None, 1, 0), (8, 7, 0), (11, 1, 1)], "doc_id long, quality int, toxic int")
    out = quality.quality(docs, labels).collect()
    assert Counter(r.doc_id for r in out) == Counter(d for d, _ in rows) and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality(empty, labels).count() == 0

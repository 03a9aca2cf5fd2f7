"""The queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline.llm.bpe import bpe_encode
from forkline.llm.id_store import id_store
from forkline.llm.media import media_columns
from forkline.llm.middle import fill_in_middle_digests, outputs
from forkline.llm.mixing import mixed
from forkline.llm.ngram_join import ngram_join
from forkline.llm.packing import packed
from forkline.llm.prefix_trie import prefix_trie
from forkline.llm.quality import quality
from forkline.llm.substring_dedup import substring_dedup
from forkline.llm.threshold_search import threshold_search
from forkline.llm.token_counts import token_counts
from forkline.llm.url_filters import url_filters
from forkline.session import partitions, tables


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = lambda *values: F.struct(*[F.lit(v).alias(c) for c, v in zip(("host", "path", "verdict"), values)])
    rules = spark.range(1).select(F.inline(F.array(*[rule(*r) for r in URL_RULES])))
    return url_filters(tables(spark, sf_dir, "pages"), rules, keep=("page_id",), salts=max(64, partitions(spark)))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(tables(spark, sf_dir, "documents")).drop("component")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(tables(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text before and after two edits: its middle 24 characters give way to its source, its language goes in front."""
    half = F.floor(F.length("text") / 2)
    edits = F.array(
        F.struct(half.alias("at"), F.lit(24).cast("long").alias("removed"), F.col("source").alias("inserted")),
        F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("removed"), F.concat(F.col("lang"), F.lit(" ")).alias("inserted")),
    )
    out = token_counts(tables(spark, sf_dir, "documents"), tokenizer(BYTE_BPE), edits)
    return out.select("doc_id", "n_tokens", "n_leaves", "edited_tokens", "encoded_leaves", F.sha2("edited_text", 256).alias("edited_sha256"))


def op4_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_search(tables(spark, sf_dir, "embeddings")).drop("met")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media_columns(tables(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "payload_bytes", F.lower(F.hex("digest")).alias("payload_sha256"), F.crc32("tail").alias("tail_crc32"), "media_bytes", "media_sha256", "feature")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packed(tables(spark, sf_dir, "documents"), tokenizer(BYTE_BPE))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = id_store(tables(spark, sf_dir, "documents"), tokenizer(WORD_BPE))
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_encode(tables(spark, sf_dir, "documents"), tokenizer(BYTE_BPE), decoded=True)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(tables(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(tables(spark, sf_dir, "conversations"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle_digests(*outputs(tables(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_ngram_join, op3_token_counts, op4_threshold_search, op5_media_columns, op6_substring_dedup, op7_packing, op8_id_store, op9_bpe, op10_quality,
        op11_mixing, op12_prefix_trie, op13_fill_in_middle,
    )
}

SQL: dict[str, str] = {
    "op1_url_filters": r"""
WITH rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
         ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id,
         translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
fits AS (
  SELECT p.page_id, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS n
  FROM parts p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.rule_verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.n = 1
""",
    "op11_mixing": r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(sha256(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15) AS hash
  FROM documents),
sized AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, ((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM sized),
-- With the k sources of the least size for their weight at their limit, the others share what these leave.
levels AS (
  SELECT *, row_number() OVER w AS k,
         (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
           / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST)),
chosen AS (SELECT level FROM levels WHERE weight * level <= 3 * source_size ORDER BY k LIMIT 1),
targets AS (SELECT source, source_size, least(weight * (SELECT level FROM chosen), 3.0::DOUBLE * source_size) AS target FROM weighed),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS whole,
         CASE WHEN source_size > 0 AND floor(target / source_size) < 3 THEN target - floor(target / source_size) * source_size ELSE 0 END AS budget
  FROM targets),
run AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.whole, b.budget, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash) AS upto
  FROM docs d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN budget > 0 AND upto - size <= budget AND upto - budget <= budget - (upto - size) OR upto <= budget AND budget > 0 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run
""",
    "op12_prefix_trie": r"""
WITH own AS (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         -- crc32, bit by bit
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: 0::BIGINT)),
             lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM own)),
built AS (
  SELECT i.conv_id, o.place, o.said FROM ids i JOIN own o ON o.conv_id = i.base AND o.place <= i.h
  UNION ALL
  SELECT i.conv_id, o.place, o.said FROM ids i JOIN own o ON o.conv_id = i.conv_id AND o.place > i.h),
wholes AS (SELECT i.conv_id, list(b.said ORDER BY b.place) FILTER (b.said IS NOT NULL) AS turns FROM ids i LEFT JOIN built b ON b.conv_id = i.conv_id GROUP BY i.conv_id),
paths AS (
  SELECT conv_id, d, CASE WHEN d = 0 THEN '' ELSE sha256(turns[1:d]::VARCHAR) END AS node, CASE WHEN d < 2 THEN '' ELSE sha256(turns[1:d - 1]::VARCHAR) END AS parent,
         coalesce(len(turns), 0) AS n, CASE WHEN d = 0 THEN 0 ELSE length(turns[d].text) END AS chars
  FROM wholes, unnest(range(0, coalesce(len(turns), 0) + 1)) AS t(d)),
nodes AS (
  SELECT node, d, min(conv_id) AS conv_id, min(parent) AS parent, count(*) AS n_convs, max(n) = d AS childless, min(chars) AS chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends
  FROM paths GROUP BY node, d),
-- Each node and the nodes above it, by the path of its least member.
above AS (SELECT n.conv_id, n.d AS under, n.n_convs, n.chars, n.childless, p.node, p.d FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.d <= n.d),
sums AS (SELECT node, d, count(*) FILTER (childless) AS n_leaves, sum((n_convs - 1) * chars) AS saved, count(*) FILTER (under = d + 1) AS n_children FROM above GROUP BY node, d)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, s.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN sums s ON s.node = n.node AND s.d = n.d LEFT JOIN nodes p ON n.d > 0 AND p.node = n.parent AND p.d = n.d - 1
""",
    "op13_fill_in_middle": r"""
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
cut AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines,
         ('0x' || substr(s, 1, 8))::BIGINT AS h1, ('0x' || substr(s, 9, 8))::BIGINT AS h2, ('0x' || substr(s, 17, 8))::BIGINT AS h3, ('0x' || substr(s, 25, 8))::BIGINT AS h4
  FROM hashed),
formed AS (
  SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parts AS (
  SELECT *, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle, array_to_string(lines[b + 1:], '') AS suffix FROM formed)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
""",
}

"""Joins, rankings, set operations and scalar functions over the driver's tables, with the same queries in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forkline.functions import text as T
from forkline.operators import ranking as R
from forkline.operators import relations as J
from forkline.session import tables

HOST = r"^https?://([^/?#]+)"
PATH = r"^https?://[^/?#]+([^?#]*)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables(spark, sf_dir, "pages")
    return pages.select("page_id", F.regexp_extract("url", HOST, 1).alias("host"), F.regexp_extract("url", PATH, 1).alias("path"))


def site_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sites, their distinct parts as reach, priority as provenance."""
    reach = tables(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.countDistinct("l_partkey").alias("reach"))
    provenance = F.when(F.col("o_orderpriority").startswith("1"), 2).when(F.col("o_orderpriority").startswith("2"), 1).otherwise(0)
    kind = F.when(F.col("o_orderkey") % 3 == 0, "route").otherwise("branch")
    orders = tables(spark, sf_dir, "orders").join(reach, "o_orderkey", "left")
    score = R.site_score(F.coalesce("reach", F.lit(0)), provenance, F.col("o_orderstatus") == "F", kind)
    return orders.select("o_orderkey", F.round(score, 6).alias("score"))


_ARMS = """arms AS (
  SELECT l_orderkey AS site, l_returnflag AS flag, min(l_linenumber) AS idx, list_sort(list(DISTINCT l_suppkey)) AS reach
  FROM lineitem GROUP BY l_orderkey, l_returnflag),
typed AS (SELECT *, CASE WHEN site % 5 = 0 THEN 'route' ELSE 'branch' END AS kind,
  CASE flag WHEN 'R' THEN 'returns' WHEN 'A' THEN 'raises' ELSE 'falls_through' END AS terminal FROM arms),
classed AS (SELECT *, CASE WHEN terminal IN ('raises', 'returns') AND len(reach) <= 2 THEN 'guard' WHEN len(reach) = 0 THEN 'void' ELSE 'live' END AS class FROM typed)"""


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sites, return flags as arms, suppliers as reach."""
    arms = tables(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("site"), F.col("l_returnflag").alias("flag")).agg(F.min("l_linenumber").alias("idx"), F.array_sort(F.collect_set("l_suppkey")).alias("reach"))
    terminal = F.when(F.col("flag") == "R", "returns").when(F.col("flag") == "A", "raises").otherwise("falls_through")
    return arms.withColumns({"kind": F.when(F.col("site") % 5 == 0, "route").otherwise("branch"), "terminal": terminal})


def arm_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arms(spark, sf_dir).select("site", "flag", R.arm_class(F.col("terminal"), F.size("reach")).alias("class"))


def site_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.site_verdicts(_arms(spark, sf_dir)).select("site", "kind", "arms", "live", "verdict")


def rank_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five orders of each customer that matter most."""
    order = [F.desc("o_orderpriority"), F.desc("o_totalprice"), F.col("o_orderkey")]
    return R.top_k(tables(spark, sf_dir, "orders"), ["o_custkey"], order, 5).select("o_custkey", "o_orderkey", "rank")


def fold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fold_top_k(tables(spark, sf_dir, "part"), "p_brand", "p_partkey", "p_retailprice").select("p_brand", "member", "folded")


def _mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = tables(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    orders = tables(spark, sf_dir, "orders").join(customers, "o_custkey")
    return orders.groupBy("c_nationkey").agg(F.sum(F.floor("o_totalprice")).alias("mass"))


def apportion_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.apportion(_mass(spark, sf_dir), "c_nationkey", "mass").select("c_nationkey", "mass", "budget")


def lane_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order values by the customer's nation plus account balances by the supplier's."""
    suppliers = tables(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("lane"), F.floor("s_acctbal").cast("double").alias("part"))
    customers = tables(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("lane"))
    orders = tables(spark, sf_dir, "orders").join(customers, "o_custkey").select("lane", F.floor("o_totalprice").cast("double").alias("part"))
    return orders.union(suppliers).groupBy("lane").agg(F.bround(F.sum("part"), 6).alias("mass"))


def fair_demotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fair_demotion(tables(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal", "c_custkey", 60).select("c_nationkey", "c_custkey", F.col("size_at_removal").cast("long"))


def reveal_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reveal_chunks(tables(spark, sf_dir, "part"), "p_brand", [F.col("p_partkey")]).select("p_brand", "p_partkey", "chunk")


def sequence_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of events of one user without a pause of more than an hour: sessions by gaps and islands."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    paused = F.col("ts") - F.lag("ts").over(order) > F.expr("INTERVAL 1 HOUR")
    events = tables(spark, sf_dir, "events").withColumn("paused", paused)
    return R.sequence_chain(events, "user_id", [F.col("ts"), F.col("event_id")], F.col("paused")).select("event_id", "user_id", F.col("run").cast("long"))


def gateway_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("s_acctbal"), F.col("s_suppkey")]
    return R.top_k(tables(spark, sf_dir, "supplier"), ["s_nationkey"], order, 1).select("s_nationkey", "s_suppkey")


def effect_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as effects: one for each user and type, least id, with the number folded."""
    return J.dedupe_by_key(tables(spark, sf_dir, "events").withColumn("folded", F.lit(1).cast("long")), ["user_id", "event_type"], "event_id", "folded")


def kind_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of which a user has more than three effects become one folded effect; others stay."""
    each = Window.partitionBy("user_id", "event_type")
    marked = tables(spark, sf_dir, "events").withColumns({"n": F.count("*").over(each), "least": F.min("event_id").over(each)})
    kept = F.when(F.col("n") > 3, F.col("least")).otherwise(F.col("event_id"))
    return marked.groupBy("user_id", "event_type", kept.alias("event_id")).agg((F.max("n") > 3).alias("folded"))


def dominant_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose orders are mostly of one status."""
    return J.dominant(tables(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", 0.6).select("o_custkey", "o_orderstatus", "n", "total")


def route_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a host as one entry, where there are two or more."""
    pages = _pages(spark, sf_dir).groupBy("host").agg(F.count("*").alias("route_count"), F.min("page_id").alias("first_page"))
    return pages.select(F.when(F.col("route_count") >= 2, F.concat(F.lit("entry:group:"), F.col("host"))).otherwise(F.concat(F.lit("entry:"), F.col("host"))).alias("entry"), "route_count", "first_page")


def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest directory that lies on the way to each page, out of those of all pages."""
    pages = _pages(spark, sf_dir).select("page_id", F.concat("host", "path").alias("full"))
    roots = pages.select(F.regexp_replace("full", "/[^/]*$", "").alias("root"))
    return J.longest_prefix(pages, "full", roots).select("page_id", "root")


def route_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of pages against templates: digits folded, any language, and a catch-all of one segment."""
    paths = tables(spark, sf_dir, "pages").select(F.col("page_id").alias("call_id"), F.lit("GET").alias("method"), T.split_segments(F.regexp_extract("url", PATH, 1)).alias("segments"))
    folded = paths.select(F.transform("segments", lambda s: F.regexp_replace(s, r"^\d+(\.html)?$", "{id}")).alias("segments")).where("exists(segments, s -> s = '{id}')").distinct()
    some = folded.where("size(segments) = 2").select(F.transform("segments", lambda s, i: F.when(i == 0, F.lit("{lang}")).otherwise(s)).alias("segments")).distinct()
    routes = folded.where("segments[0] in ('en', 'fr', 'de')").union(some).select(F.concat(F.lit("/"), F.array_join("segments", "/")).alias("route"), F.lit("GET").alias("method"), "segments").distinct()
    return J.route_match(paths, routes)


def subset_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose kinds of events (type and hour) are all among another's."""
    events = tables(spark, sf_dir, "events").select("user_id", F.concat("event_type", (F.hour("ts") % 2).cast("string")).alias("kind"))
    return J.subset_join(events, "user_id", "kind")


def subset_join_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers whose parts are all among another's, over all rows."""
    return J.subset_join(tables(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey")


def rect_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as boxes: size across, price down."""
    price = F.floor(F.col("p_retailprice") / 10)
    boxes = tables(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x0"), (F.col("p_size") + 1.5).alias("x1"), price.cast("double").alias("y0"), (price + 2.5).alias("y1"))
    return J.rect_overlap(boxes, 8.0)


def crossing_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users as spans from one to the next of a type; how many spans of a user's others cross each."""
    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    spans = tables(spark, sf_dir, "events").withColumn("until", F.lead("event_id").over(order)).where("until is not null and until > event_id").select("user_id", "event_id", "until")
    b = spans.select("user_id", F.col("event_id").alias("b_from"), F.col("until").alias("b_until"))
    met = spans.join(b, "user_id").where("event_id < b_from and b_from < until and until < b_until")
    return met.groupBy("user_id").agg(F.count("*").alias("crossings"))


def _dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = _pages(spark, sf_dir).select(F.regexp_replace(F.concat("host", "path"), "/+$", "").alias("dir"))
    return full.union(full.select(F.regexp_replace("dir", "/[^/]*$", ""))).distinct()


def minimal_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.minimal_dirs(_dirs(spark, sf_dir))


def drop_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.drop_ancestors(_dirs(spark, sf_dir))


def fingerprint_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts judged once: fingerprints not in the cache (documents of source src1), the first of each, and how many share it."""
    docs = tables(spark, sf_dir, "documents").select("doc_id", "source", T.fingerprint(F.lit("v1"), F.col("lang"), F.col("text")).alias("fingerprint"))
    cached = docs.where("source = 'src1'").select("fingerprint").distinct()
    return docs.join(cached, "fingerprint", "left_anti").groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def content_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of documents, then a second version in which every seventh text is another and new ids are added; each document is in one or both."""
    docs = tables(spark, sf_dir, "documents")
    first = docs.where("doc_id % 2 = 0").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    second = docs.where("doc_id % 4 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("content_hash"))
    return J.upsert(first, second, ["doc_id"], "content_hash")


def humanize_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("shop.models."), F.regexp_replace(F.initcap("p_name"), " ", ""), F.lit("_itemView"))
    return tables(spark, sf_dir, "part").select("p_partkey", T.humanize(name).alias("label"), T.handler_name(F.concat(F.lit("get_"), F.col("p_name"))).alias("sentence"))


def route_label_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.lit("GET "), "path")
    return _pages(spark, sf_dir).select("page_id", T.route_method(label).alias("method"), T.route_path(label).alias("route"), F.array_join(T.split_segments(F.col("path")), ",").alias("segments"))


def path_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = F.regexp_replace(F.regexp_replace("path", r"^/([a-z]+)/", "/<str:lang>/"), r"\d+", "{id}")
    return _pages(spark, sf_dir).select("page_id", F.array_join(T.path_params(template), ",").alias("params"), T.openapi_path(template).alias("openapi"))


def clamp48(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, "documents").select("doc_id", T.clamp(F.col("text")).alias("clamped"))


def word_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First six words of the first line."""
    return tables(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(T.word_clamp(F.translate(F.element_at(F.split("text", "\n"), 1), "\t", " "), 6)).alias("n_chars"))


def sql_table_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    statement = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "select * from ").otherwise("Update "), F.lit("t_"), F.col("l_returnflag"), F.lit(" where x = 1"))
    return tables(spark, sf_dir, "lineitem").select(T.sql_table(statement).alias("table_name")).groupBy("table_name").agg(F.count("*").alias("n"))


def source_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, "documents").select("doc_id", F.sha2(T.source_slice(F.col("text"), F.lit(2), 3), 256).alias("slice_sha256"))


def shared_owner_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with the customers that order them."""
    orders = tables(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    rows = tables(spark, sf_dir, "lineitem").join(orders, "l_orderkey").select("l_partkey", "o_custkey")
    return J.owner_index(rows, "l_partkey", "o_custkey").where("n >= 2").select("l_partkey", F.array_join(F.col("entries").cast("array<string>"), ",").alias("entries"), F.col("n").cast("long"))


def overlay_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders under an overlay: some deleted, some with another status, some added."""
    orders = tables(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.floor("o_totalprice").alias("price"))
    overrides = orders.where("o_orderkey % 10 = 3").select("o_orderkey", F.lit("edited").alias("o_orderstatus"))
    added = orders.where("o_orderkey % 50 < 2").select(F.when(F.col("o_orderkey") % 50 == 0, F.col("o_orderkey")).otherwise(F.col("o_orderkey") + 10_000_000).alias("o_orderkey"), F.lit("added").alias("o_orderstatus"), "price")
    return J.overlay(orders, "o_orderkey", overrides, orders.where("o_orderkey % 10 = 4").select("o_orderkey"), added)


def event_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, "events").where("event_id > 500").select("event_id", "event_type").orderBy("event_id")


def ring_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 500 events."""
    return tables(spark, sf_dir, "events").orderBy(F.desc("event_id")).limit(500).select("event_id", "user_id", "event_type")


def language_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("src/"), F.col("p_brand"), F.when(F.col("p_size") % 4 == 0, ".py").when(F.col("p_size") % 4 == 1, ".TSX").when(F.col("p_size") % 4 == 2, ".cfg").otherwise(""))
    return tables(spark, sf_dir, "part").select("p_partkey", T.language_of(path).alias("language"), T.module_fqn(path).alias("module"), T.package_of(path).alias("package"))


def depth_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, "part").select("p_partkey", T.depth_scale(F.col("p_size") % 5).alias("scale"))


def directory_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and the six least names of each directory of pages."""
    files = _pages(spark, sf_dir).select(F.regexp_replace(F.concat("host", "path"), "/[^/]*$", "").alias("dir"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))
    first = R.top_k(files, ["dir"], [F.col("name")], 6).groupBy("dir").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
    return files.groupBy("dir").agg(F.count("*").alias("file_count")).join(first, "dir")


def hidden_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of three a row, centred under their owner: offsets of the parts of each brand."""
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    total = F.count("*").over(Window.partitionBy("p_brand"))
    in_row = F.least(F.lit(3), total - F.floor(rank / 3) * 3)
    x = F.bround((rank % 3 - (in_row - 1) / 2) * 220, 0)
    return tables(spark, sf_dir, "part").select("p_partkey", x.cast("long").alias("x"), (F.floor(rank / 3) * 120).cast("long").alias("y"))


def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extent of each brand's parts, and how far they are stretched downwards."""
    box = tables(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_size").alias("x0"), (F.max("p_size") + 4).alias("x1"), F.min(F.floor("p_retailprice")).alias("y0"), (F.max(F.floor("p_retailprice")) + 2).alias("y1"))
    aspect = (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0")) * 40
    return box.withColumn("stretch", F.round(F.greatest(F.lit(1.0), F.least(F.lit(1.8), aspect / 2)), 3))


_PAGES = r"pg AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages)"
_SEG = "list_filter(string_split({0}, '/'), lambda s: s <> '')"
_DIRS = _PAGES + r""", f AS (SELECT regexp_replace(host || path, '/+$', '') AS dir FROM pg),
d AS (SELECT dir FROM f UNION SELECT regexp_replace(dir, '/[^/]*$', '') FROM f)"""

SQL = {
    "site_score": """SELECT o_orderkey, round(3 * log2(1 + coalesce(reach, 0)) + 2 * (CASE WHEN o_orderpriority LIKE '1%' THEN 2 WHEN o_orderpriority LIKE '2%' THEN 1 ELSE 0 END)
  + (CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 2 END) + (CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END), 6) AS score
FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS reach FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
    "arm_class": f"WITH {_ARMS} SELECT site, flag, class FROM classed",
    "site_verdict": f"""WITH {_ARMS},
bad AS (SELECT DISTINCT a.site FROM classed a JOIN classed b ON a.site = b.site AND a.flag <> b.flag AND a.class = 'live' AND b.class = 'live' AND list_has_all(b.reach, a.reach)),
g AS (SELECT site, kind, count(*) AS arms, count(*) FILTER (class = 'live') AS live, count(*) FILTER (class = 'guard') AS guards FROM classed GROUP BY site, kind)
SELECT site, kind, arms, live, CASE WHEN kind = 'route' THEN CASE WHEN arms >= 2 THEN 'decision' ELSE 'noise' END
  WHEN live >= 2 AND site NOT IN (SELECT site FROM bad) THEN 'decision' WHEN live = 1 AND guards >= 1 THEN 'guarded_step' ELSE 'noise' END AS verdict FROM g""",
    "rank_decisions": """SELECT o_custkey, o_orderkey, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 5""",
    "fold_top_k": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_brand, CASE WHEN n > 5 AND rn >= 5 THEN 'fold:' || p_brand ELSE p_partkey::VARCHAR END AS member, count(*) AS folded FROM r GROUP BY 1, 2""",
    "apportion_budget": """WITH m AS (SELECT c_nationkey, sum(floor(o_totalprice)::BIGINT)::BIGINT AS mass FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1),
b AS (SELECT *, floor(40 * mass / (SELECT sum(mass) FROM m))::BIGINT AS base, row_number() OVER (ORDER BY mass DESC, c_nationkey) AS rn FROM m)
SELECT c_nationkey, mass, greatest(3, base + CASE WHEN rn <= 40 - (SELECT sum(base) FROM b) THEN 1 ELSE 0 END)::BIGINT AS budget FROM b""",
    "lane_mass": """SELECT lane, round_even(sum(part), 6) AS mass FROM (
  SELECT c_nationkey AS lane, floor(o_totalprice) AS part FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL SELECT s_nationkey, floor(s_acctbal) FROM supplier) GROUP BY lane""",
    "fair_demotion": """WITH r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS size_at_removal FROM customer)
SELECT * FROM r ORDER BY size_at_removal DESC, c_nationkey DESC LIMIT 60""",
    "reveal_chunks": """WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_brand, p_partkey, least((rn - 1) // 7, greatest(0, ceil((n - 8) / 7)))::BIGINT AS chunk FROM r""",
    "sequence_chain": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 1 HOUR THEN 1 ELSE 0 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM g""",
    "gateway_per_group": """SELECT s_nationkey, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS n FROM supplier) WHERE n = 1""",
    "effect_dedupe": "SELECT user_id, event_type, min(event_id) AS event_id, count(*) AS folded FROM events GROUP BY 1, 2",
    "kind_collapse": """WITH c AS (SELECT *, count(*) OVER w AS n, min(event_id) OVER w AS m FROM events WINDOW w AS (PARTITION BY user_id, event_type))
SELECT DISTINCT user_id, event_type, CASE WHEN n > 3 THEN m ELSE event_id END AS event_id, n > 3 AS folded FROM c""",
    "dominant_root": """WITH c AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY o_custkey)::BIGINT AS total, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderstatus) AS k FROM c)
SELECT o_custkey, o_orderstatus, n, total FROM r WHERE k = 1 AND n >= 0.6 * total""",
    "route_group": f"""WITH {_PAGES} SELECT CASE WHEN count(*) >= 2 THEN 'entry:group:' || host ELSE 'entry:' || host END AS entry, count(*) AS route_count, min(page_id) AS first_page FROM pg GROUP BY host""",
    "longest_prefix": f"""WITH {_PAGES}, roots AS (SELECT DISTINCT regexp_replace(host || path, '/[^/]*$', '') AS root FROM pg),
n AS (SELECT page_id, array_to_string({_SEG.format("host || path")}, '/') AS full_path FROM pg)
SELECT n.page_id, arg_max(root, length(root)) AS root FROM n LEFT JOIN roots ON full_path = root OR starts_with(full_path, root || '/') GROUP BY n.page_id""",
    "route_match": f"""WITH {_PAGES}, c AS (SELECT page_id AS call_id, {_SEG.format("path")} AS s FROM pg),
f AS (SELECT DISTINCT list_transform(s, lambda x: regexp_replace(x, '^\\d+(\\.html)?$', '{{id}}')) AS s FROM c),
f2 AS (SELECT s FROM f WHERE list_contains(s, '{{id}}')),
t AS (SELECT s FROM f2 WHERE s[1] IN ('en', 'fr', 'de') UNION SELECT ['{{lang}}', s[2]] FROM f2 WHERE len(s) = 2),
m AS (SELECT call_id, c.s AS a, t.s AS b, '/' || array_to_string(t.s, '/') AS route, least(len(c.s), len(t.s)) AS n FROM c, t),
z AS (SELECT call_id, route, len(a) = len(b) AS same, n,
  len(list_filter(range(1, n + 1), lambda i: a[len(a) - n + i] = b[len(b) - n + i] OR (b[len(b) - n + i] LIKE '{{%}}') OR (a[len(a) - n + i] LIKE '{{%}}'))) = n AS hit FROM m),
f1 AS (SELECT call_id, count(DISTINCT route) AS k, min(route) AS route FROM z WHERE same AND hit GROUP BY call_id),
s1 AS (SELECT call_id, count(DISTINCT route) AS k, min(route) AS route FROM z WHERE NOT same AND hit AND n > 0 AND call_id NOT IN (SELECT call_id FROM f1) GROUP BY call_id)
SELECT call_id, route, 'resolved' AS confidence FROM f1 WHERE k = 1 UNION ALL SELECT call_id, route, 'inferred' FROM s1 WHERE k = 1""",
    "subset_join": """WITH s AS (SELECT DISTINCT user_id, event_type || (hour(ts) % 2)::VARCHAR AS kind FROM events),
o AS (SELECT DISTINCT user_id FROM s)
SELECT a.user_id AS small, b.user_id AS large FROM o a, o b WHERE a.user_id <> b.user_id AND NOT EXISTS (
  SELECT 1 FROM s x WHERE x.user_id = a.user_id AND NOT EXISTS (SELECT 1 FROM s y WHERE y.user_id = b.user_id AND y.kind = x.kind))""",
    "subset_join_parts": """WITH s AS (SELECT DISTINCT l_suppkey AS o, l_partkey AS m FROM lineitem), n AS (SELECT o, count(*) AS size FROM s GROUP BY o)
SELECT a.o AS small, b.o AS large FROM s a JOIN s b ON a.m = b.m AND a.o <> b.o JOIN n ON n.o = a.o GROUP BY a.o, b.o, n.size HAVING count(*) = n.size""",
    "rect_overlap": """WITH b AS (SELECT p_partkey AS id, p_size::DOUBLE AS x0, p_size + 1.5 AS x1, floor(p_retailprice / 10) AS y0, floor(p_retailprice / 10) + 2.5 AS y1 FROM part)
SELECT a.id AS a, b.id AS b FROM b a JOIN b ON a.id < b.id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1""",
    "crossing_count": """WITH s AS (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS until FROM events),
t AS (SELECT * FROM s WHERE until > event_id)
SELECT a.user_id, count(*) AS crossings FROM t a JOIN t b ON a.user_id = b.user_id AND a.event_id < b.event_id AND b.event_id < a.until AND a.until < b.until GROUP BY 1""",
    "minimal_dirs": f"WITH {_DIRS} SELECT dir FROM d WHERE NOT EXISTS (SELECT 1 FROM d e WHERE e.dir <> d.dir AND starts_with(d.dir, e.dir || '/'))",
    "drop_ancestors": f"WITH {_DIRS} SELECT dir FROM d WHERE NOT EXISTS (SELECT 1 FROM d e WHERE e.dir <> d.dir AND starts_with(e.dir, d.dir || '/'))",
    "fingerprint_dedupe": """WITH f AS (SELECT doc_id, source, sha256('v1' || chr(31) || coalesce(lang, '') || chr(31) || coalesce(text, '')) AS fingerprint FROM documents)
SELECT fingerprint, min(doc_id) AS doc_id, count(*) AS copies FROM f WHERE fingerprint NOT IN (SELECT fingerprint FROM f WHERE source = 'src1') GROUP BY 1""",
    "content_upsert": """WITH a AS (SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE doc_id % 2 = 0),
b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS content_hash FROM documents WHERE doc_id % 4 <> 0)
SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, coalesce(b.content_hash, a.content_hash) AS content_hash FROM a FULL JOIN b ON a.doc_id = b.doc_id""",
    "humanize_label": r"""WITH n AS (SELECT p_partkey, p_name, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '') || '_itemView' AS last FROM part),
w AS (SELECT p_partkey, p_name, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(last, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '_+', ' ', 'g'), '\s+'), lambda x: x <> '') AS words FROM n)
SELECT p_partkey, array_to_string(list_transform(words, lambda x: upper(x[1]) || x[2:]), ' ') AS label,
  'Get ' || lower(array_to_string(list_filter(regexp_split_to_array(p_name, '[_\s]+'), lambda x: x <> ''), ' ')) AS sentence FROM w""",
    "route_label_parse": f"""WITH {_PAGES} SELECT page_id, CASE WHEN regexp_full_match('GET ' || path, '[A-Z]+ /\\S*') THEN 'GET' ELSE '' END AS method,
  CASE WHEN regexp_full_match('GET ' || path, '[A-Z]+ /\\S*') THEN path ELSE '' END AS route, array_to_string({_SEG.format("path")}, ',') AS segments FROM pg""",
    "path_params": rf"""WITH {_PAGES}, t AS (SELECT page_id, regexp_replace(regexp_replace(path, '^/([a-z]+)/', '/<str:lang>/'), '\d+', '{{id}}', 'g') AS p FROM pg)
SELECT page_id, concat_ws(',', CASE WHEN contains(p, '<str:lang>') THEN 'lang' END, CASE WHEN contains(p, '{{id}}') THEN 'id' END) AS params, replace(p, '<str:lang>', '{{lang}}') AS openapi FROM t""",
    "clamp48": "SELECT doc_id, CASE WHEN length(text) > 48 THEN left(text, 47) || '…' ELSE text END AS clamped FROM documents",
    "word_clamp": r"""SELECT conv_id, turn, length(array_to_string(list_filter(regexp_split_to_array(trim(replace(string_split(text, chr(10))[1], chr(9), ' ')), '\s+'), lambda w: w <> '')[1:6], ' ')) AS n_chars FROM conversations""",
    "sql_table_extract": "SELECT 't_' || l_returnflag AS table_name, count(*) AS n FROM lineitem GROUP BY 1",
    "source_slice": "SELECT doc_id, sha256(array_to_string(string_split(text, chr(10))[2:4], chr(10))) AS slice_sha256 FROM documents",
    "shared_owner_index": """SELECT l_partkey, array_to_string(list_sort(list(DISTINCT o_custkey)), ',') AS entries, count(DISTINCT o_custkey) AS n
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(DISTINCT o_custkey) >= 2""",
    "overlay_apply": """WITH o AS (SELECT o_orderkey, o_orderstatus, floor(o_totalprice)::BIGINT AS price FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN 'edited' ELSE o_orderstatus END AS o_orderstatus, price FROM o WHERE o_orderkey % 10 <> 4
UNION ALL SELECT o_orderkey + 10000000, 'added', price FROM o WHERE o_orderkey % 50 = 1 AND o_orderkey + 10000000 NOT IN (SELECT o_orderkey FROM o)""",
    "event_cursor": "SELECT event_id, event_type FROM events WHERE event_id > 500",
    "ring_tail": "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 500",
    "language_of": """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'cfg' ELSE 'text' END AS language,
  replace('src/' || p_brand, '/', '.') || CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '.TSX' WHEN 2 THEN '.cfg' ELSE '' END AS module, 'src' AS package FROM part""",
    "depth_scale": "SELECT p_partkey, greatest(0.82, round(pow(0.9, p_size % 5), 3)) AS scale FROM part",
    "directory_groups": f"""WITH {_PAGES}, f AS (SELECT regexp_replace(host || path, '/[^/]*$', '') AS dir, regexp_extract(path, '([^/]*)$', 1) AS name FROM pg)
SELECT dir, count(*) AS file_count, array_to_string(list_sort(list(name))[1:6], ',') AS names FROM f GROUP BY dir""",
    "hidden_offsets": """WITH r AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_partkey, round_even((k % 3 - (least(3, n - (k // 3) * 3) - 1) / 2) * 220, 0)::BIGINT AS x, (k // 3 * 120)::BIGINT AS y FROM r""",
    "bounding_box": """WITH b AS (SELECT p_brand, min(p_size) AS x0, max(p_size) + 4 AS x1, min(floor(p_retailprice))::BIGINT AS y0, max(floor(p_retailprice))::BIGINT + 2 AS y1 FROM part GROUP BY 1)
SELECT *, round(greatest(1.0::DOUBLE, least(1.8::DOUBLE, ((x1 - x0) / (y1 - y0) * 40) / 2)), 3) AS stretch FROM b""",
}

QUERIES = {name: globals()[name] for name in SQL}

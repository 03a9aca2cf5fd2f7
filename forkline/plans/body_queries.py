"""Bodies, folds, walks and modules over the driver's tables, with the same queries in SQL.

Parts are nodes: part k lies in part k div 6 (in none where that is 0).  A part leads to the next unless 13 divides it, is led to by the next
but one if 7 divides it, and by its container if 6 divides it.  Slices are the parts of one size; pages are files below their reversed host.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forkline.operators import bodies as B
from forkline.operators import folding as D
from forkline.operators import modules as M
from forkline.operators import walks as W
from forkline.session import materialised, tables


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.expr("nullif(p_partkey div 6, 0)").alias("container"), "p_brand", F.col("p_size").cast("long").alias("p_size"))


def _edges(parts: DataFrame) -> DataFrame:
    ways = (("node % 13 <> 0", "node", "node + 1"), ("node % 7 = 0", "node + 2", "node"), ("node % 6 = 0", "node div 6", "node"))
    a, b, c = (parts.where(w).select(F.expr(s).alias("src"), F.expr(d).alias("dst")) for w, s, d in ways)
    return a.union(b).union(c)


def body_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    return B.body_order(parts, _edges(parts), parts.select("node", F.lit("f").alias("file"), F.col("p_size").alias("line")))


def body_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    return B.body_tails(parts, _edges(parts))


def entry_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    return B.headless(parts, _edges(parts))


def body_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies in the order of their members' numbers."""
    parts = _parts(spark, sf_dir)
    order = B.members(parts).select("owner", "node", F.col("node").alias("place"))
    return B.body_kinds(parts, _edges(parts), order)


def flow_list_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return body_kinds(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


def border_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of more than size 25 are the tails."""
    parts = _parts(spark, sf_dir)
    return B.border_edges(parts, parts.where("container is not null and p_size > 25").select(F.col("container").alias("owner"), "node"), _edges(parts))


def structure_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 17th part lies in one that is not there, every 23rd in none, and 5 and 30 in each other; part 1 is the root."""
    container = "case when node % 17 = 0 then node + 100000000 when node = 5 then 30 when node % 23 = 0 then null else container end"
    return B.structure_problems(_parts(spark, sf_dir).select("node", F.expr(container).alias("container")), 1)


def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of size 13 are no nodes."""
    parts = _parts(spark, sf_dir)
    return B.dangling(_edges(parts), parts.where("p_size <> 13"))


def diagram_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    return B.metrics(parts.select("node", F.col("p_brand").alias("kind"), (F.col("p_size") % 4).alias("level")), parts, _edges(parts))


def _kept(parts: DataFrame) -> DataFrame:
    first = F.min("node").over(Window.partitionBy("p_size"))
    return parts.select(F.col("p_size").alias("entry"), "node", (F.col("node") == first).alias("root"))


def _slice_edges(parts: DataFrame) -> DataFrame:
    """Each part to the next of its size unless 5 divides it, to the next but one if 9 does."""
    order = Window.partitionBy("p_size").orderBy("node")
    near = parts.select("p_size", "node", F.lead("node").over(order).alias("one"), F.lead("node", 2).over(order).alias("two"))
    pairs = near.where("node % 5 <> 0").select(F.col("p_size").alias("entry"), F.col("node").alias("source"), F.col("one").alias("target"))
    return pairs.union(near.where("node % 9 = 0").select("p_size", "node", "two")).where("target is not null")


def _helpers(parts: DataFrame) -> DataFrame:
    shared = parts.groupBy(F.col("p_brand").alias("owner")).agg(F.countDistinct("p_size").alias("n"))
    return D.helper_hosts(_kept(parts), parts.select("node", F.col("p_brand").alias("owner")), shared, floor=30)


def helper_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as owners; 30 nodes remain in each slice."""
    return _helpers(_parts(spark, sf_dir))


def absorbed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    return D.absorbed(_slice_edges(parts), materialised(_helpers(parts)))


def run_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that 11 divides are forks; 20 nodes remain in each slice."""
    parts = _parts(spark, sf_dir)
    return D.run_hosts(_kept(parts), _slice_edges(parts), parts.where("node % 11 = 0").select(F.col("p_size").alias("entry"), "node"), floor=20)


def slice_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    return D.islands(_kept(parts), _slice_edges(parts), floor=20)


def sole_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries are the first parts of each size; parts that 4 divides are hidden at first."""
    parts = _parts(spark, sf_dir)
    first = parts.groupBy("p_size").agg(F.min("node").alias("entry"))
    found = materialised(parts.join(first, "p_size").select("entry", "node"))
    edges = _slice_edges(parts).select("source", "target", F.lit("sequence").alias("kind"))
    return D.sole_children(found, edges, found.where("node = entry or node % 4 <> 0"))


def seed_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = tables(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("lane"), F.floor(F.col("s_acctbal") / 1000).alias("hub"), (F.col("s_suppkey") % 3).alias("degree"))
    return D.seed_anchors(seeds)


def root_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.root_anchored(_parts(spark, sf_dir).select("node", "container"), -1)


def shortest_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as edges from part to supplier over as many nodes as stand before them in their order."""
    items = tables(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.array_repeat("l_orderkey", F.expr("cast(l_linenumber - 1 as int)")).alias("path"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("place"))
    best = D.shortest_hidden(items, ["l_partkey", "l_suppkey"], "path", "place")
    return best.select("l_partkey", "l_suppkey", F.size("path").alias("hops"), F.get("path", F.lit(0)).alias("first"))


def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts lead to those four and three times their number; entries are of size 1 to 5, arms the rest of a division by 3."""
    parts = _parts(spark, sf_dir)
    both = parts.select(F.expr("node div 4").alias("src"), F.col("node").alias("dst")).union(parts.select(F.expr("node div 3"), "node"))
    edges = both.where("src > 0").distinct().withColumn("arm", F.concat(F.lit("a"), (F.col("dst") % 3).cast("string")))
    return W.spine(edges, parts.where("p_size <= 5"))


def linear_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as owners; even sizes are linear, and the next part of a brand is chained unless 3 divides the part."""
    parts = _parts(spark, sf_dir)
    order = Window.partitionBy("p_brand").orderBy("node")
    chained = parts.select(F.col("node").alias("src"), F.lead("node").over(order).alias("dst")).where("src % 3 <> 0")
    return W.linear_runs(parts.select(F.col("p_brand").alias("owner"), F.col("node").alias("place"), "node", (F.col("p_size") % 2 == 0).alias("linear")), chained)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages below their reversed host; every third is put two or three directories deep only."""
    host, path = F.regexp_extract("url", r"^https?://([^/?#]+)", 1), F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1)
    pages = tables(spark, sf_dir, "pages").where("url is not null").select("page_id", F.reverse(F.split(host, r"\.")).alias("host"), F.filter(F.split(path, "/"), lambda s: s != "").alias("segments"))
    parts = F.concat("host", F.slice("segments", F.lit(1), F.greatest(F.size("segments") - 1, F.lit(0))))
    depth = F.expr("case when page_id % 3 = 0 then cast(2 + page_id % 2 as int) else 99 end")
    return pages.select("page_id", F.array_join(F.slice(parts, F.lit(1), depth), "/").alias("dir"))


def module_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 11th page is a package marker, every 7th an entry marker, every second source."""
    return M.module_roots(_files(spark, sf_dir).selectExpr("dir", "page_id % 11 = 0 as package", "page_id % 7 = 0 as entry", "page_id % 2 = 0 as source"))


def app_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories with every 4th page are applications, those with every 8th source roots."""
    files = _files(spark, sf_dir).select("page_id", F.translate("dir", "/", ".").alias("module"))
    return M.app_roots(files.where("page_id % 4 = 0"), files.where("page_id % 8 = 1").select(F.col("module").alias("root")))


def scope_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return M.scope_coverage(files.select("dir"), files.where("page_id % 8 = 1").select("dir"))


def key_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 10th part is a handler; parts below size 30 are methods of a class by brand and size."""
    parts = _parts(spark, sf_dir)
    functions = parts.select(F.concat(F.lit("f"), "node").alias("fqn"), F.when(F.col("p_size") < 30, F.concat("p_brand", F.lit("/"), "p_size")).alias("cls"))
    calls = _edges(parts).select(F.concat(F.lit("f"), "src").alias("caller"), F.concat(F.lit("f"), "dst").alias("callee"))
    return M.key_methods(functions.join(parts.where("node % 10 = 0").select(F.concat(F.lit("f"), "node").alias("fqn")), "fqn", "left_semi").select(F.col("fqn").alias("handler")), functions, calls)


_P = "p AS (SELECT p_partkey AS node, nullif(p_partkey // 6, 0) AS container, p_brand, p_size::BIGINT AS p_size FROM part)"
_T = f"""{_P},
e AS (SELECT node AS src, node + 1 AS dst FROM p WHERE node % 13 <> 0 UNION ALL SELECT node + 2, node FROM p WHERE node % 7 = 0 UNION ALL SELECT node // 6, node FROM p WHERE node % 6 = 0),
m AS (SELECT container AS owner, node, p_size FROM p WHERE container IS NOT NULL),
i AS (SELECT a.owner, src, dst FROM e JOIN m a ON a.node = src JOIN m b ON b.node = dst AND b.owner = a.owner)"""
_U = f"""{_T},
u AS (SELECT node, container AS above FROM p WHERE container IS NOT NULL UNION SELECT u.node, p.container FROM u JOIN p ON p.node = u.above WHERE p.container IS NOT NULL),
h AS (SELECT owner, node FROM m WHERE NOT EXISTS (SELECT 1 FROM e WHERE dst = m.node AND src = m.owner)
  AND NOT EXISTS (SELECT 1 FROM e JOIN u ON u.node = e.src WHERE e.dst = m.node AND u.above = m.owner)),
z AS (SELECT s.owner, size, coalesce(n, 0) AS n FROM (SELECT owner, count(*) AS size FROM m GROUP BY 1) s LEFT JOIN (SELECT owner, count(*) AS n FROM i GROUP BY 1) c ON c.owner = s.owner
  WHERE size > 1 AND coalesce(n, 0) < size - 1)"""
_KINDS = f"""{_U},
k AS (SELECT m.owner, CASE WHEN m.owner IN (SELECT owner FROM h UNION SELECT owner FROM z) THEN 'list' ELSE 'flow' END AS kind,
  coalesce(min(CASE WHEN EXISTS (SELECT 1 FROM e WHERE src = m.owner AND dst = m.node) THEN node END), min(node)) AS head FROM m GROUP BY m.owner)"""
_S = f"""{_P},
n AS (SELECT p_size, node, lead(node) OVER w AS one, lead(node, 2) OVER w AS two FROM p WINDOW w AS (PARTITION BY p_size ORDER BY node)),
e AS (SELECT p_size AS entry, node AS source, one AS target FROM n WHERE node % 5 <> 0 AND one IS NOT NULL UNION ALL SELECT p_size, node, two FROM n WHERE node % 9 = 0 AND two IS NOT NULL),
t AS (SELECT p_size AS entry, min(node) AS root, count(*) AS size FROM p GROUP BY 1)"""


def _fold(floor: int) -> str:
    """Counts candidates g (entry, key, n, k: place from 1) down, one a step."""
    return f"""f(entry, k, remain, fits) AS (SELECT entry, 0::BIGINT, size, false FROM t
  UNION ALL SELECT g.entry, g.k, CASE WHEN remain - n + 1 >= {floor} THEN remain - n + 1 ELSE remain END, remain - n + 1 >= {floor} FROM f JOIN g ON g.entry = f.entry AND g.k = f.k + 1)"""


_HELPERS = f"""{_S},
o AS (SELECT p_brand FROM part GROUP BY 1 HAVING count(DISTINCT p_size) >= 10),
r AS (SELECT p_size AS entry, node, p_brand FROM p JOIN t ON entry = p_size WHERE node <> root AND p_brand IN (SELECT p_brand FROM o)),
g AS (SELECT entry, p_brand AS key, count(*) AS n, row_number() OVER (PARTITION BY entry ORDER BY p_brand) AS k FROM r GROUP BY 1, 2 HAVING count(*) >= 2),
{_fold(30)},
x AS (SELECT r.entry, r.node, 'helper:' || r.p_brand AS host FROM f JOIN g ON g.entry = f.entry AND g.k = f.k JOIN r ON r.entry = g.entry AND r.p_brand = g.key WHERE fits)"""
_FILES = r"""d AS (SELECT page_id, list_reverse(string_split(regexp_extract(url, '^https?://([^/?#]+)', 1), '.')) AS host, list_filter(string_split(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/'), lambda s: s <> '') AS segments FROM pages WHERE url IS NOT NULL),
w AS (SELECT page_id, array_to_string(list_slice(list_concat(host, list_slice(segments, 1, greatest(len(segments) - 1, 0))), 1, CASE WHEN page_id % 3 = 0 THEN 2 + page_id % 2 ELSE 99 END), '/') AS dir FROM d)"""

SQL = {
    "body_order": f"""WITH RECURSIVE {_T},
q AS (SELECT m.owner, m.node, m.p_size, coalesce((SELECT list(DISTINCT i.src) FROM i WHERE i.owner = m.owner AND i.dst = m.node), []) AS before FROM m),
k(owner, done) AS (SELECT DISTINCT owner, []::BIGINT[] FROM m
  UNION ALL SELECT k.owner, list_append(done, arg_min(q.node, q.p_size * 100000000 + q.node)) FROM k JOIN q ON q.owner = k.owner AND NOT list_contains(done, q.node) AND list_has_all(done, q.before) GROUP BY k.owner, done),
l AS (SELECT owner, arg_max(done, len(done)) AS done FROM k GROUP BY 1),
b AS (SELECT q.owner, q.node, list_position(done, q.node) AS spot, p_size FROM q JOIN l ON l.owner = q.owner)
SELECT owner, node, (row_number() OVER (PARTITION BY owner ORDER BY spot NULLS LAST, p_size, node) - 1)::INTEGER AS place FROM b""",
    "body_tails": f"""WITH {_T} SELECT owner, node FROM m WHERE NOT EXISTS (SELECT 1 FROM e WHERE src = node)
OR EXISTS (SELECT 1 FROM e LEFT JOIN p q ON q.node = e.dst WHERE e.src = m.node AND (q.container IS NULL OR q.container <> m.owner))""",
    "entry_gaps": f"WITH RECURSIVE {_U} SELECT owner, node FROM h",
    "body_kinds": f"WITH RECURSIVE {_KINDS} SELECT owner, kind, CASE WHEN kind = 'flow' THEN head END AS head FROM k",
    "flow_list_split": f"WITH RECURSIVE {_KINDS} SELECT kind, count(*) AS n FROM k GROUP BY 1",
    "border_edges": f"WITH {_T} SELECT m.owner, src, dst FROM e JOIN m ON m.node = src LEFT JOIN p q ON q.node = dst WHERE m.p_size <= 25 AND (q.container IS NULL OR q.container <> m.owner)",
    "structure_problems": f"""WITH RECURSIVE {_P},
c AS (SELECT node, CASE WHEN node % 17 = 0 THEN node + 100000000 WHEN node = 5 THEN 30 WHEN node % 23 = 0 THEN NULL ELSE container END AS container FROM p),
u AS (SELECT node, container AS above FROM c WHERE container IS NOT NULL UNION SELECT u.node, c.container FROM u JOIN c ON c.node = u.above WHERE c.container IS NOT NULL)
SELECT 'missing' AS problem, node FROM c WHERE container IS NOT NULL AND container NOT IN (SELECT node FROM c)
UNION ALL SELECT 'cycle', node FROM u WHERE node = above
UNION ALL SELECT 'root', node FROM c WHERE container IS NULL AND node <> 1
UNION ALL SELECT 'orphan', node FROM c WHERE node <> 1 AND node NOT IN (SELECT node FROM u WHERE above = 1)""",
    "dangling_edges": f"WITH {_T} SELECT DISTINCT src, dst FROM e WHERE src NOT IN (SELECT node FROM p WHERE p_size <> 13) OR dst NOT IN (SELECT node FROM p WHERE p_size <> 13)",
    "diagram_metrics": f"""WITH RECURSIVE {_U}
SELECT 'kind' AS metric, p_brand AS value, count(*) AS n FROM p GROUP BY 2 UNION ALL SELECT 'level', (p_size % 4)::VARCHAR, count(*) FROM p GROUP BY 2
UNION ALL SELECT 'body', size::VARCHAR, count(*) FROM (SELECT count(*) AS size FROM m GROUP BY owner) GROUP BY 2
UNION ALL SELECT 'gaps', 'entry', count(*) FROM h UNION ALL SELECT 'gaps', 'cohesion', count(*) FROM z
UNION ALL SELECT 'gaps', 'dangling', count(*) FROM (SELECT DISTINCT src, dst FROM e WHERE src NOT IN (SELECT node FROM p) OR dst NOT IN (SELECT node FROM p))""",
    "helper_hosts": f"WITH RECURSIVE {_HELPERS} SELECT * FROM x",
    "absorbed_edges": f"""WITH RECURSIVE {_HELPERS},
y AS (SELECT DISTINCT e.entry, coalesce(a.host, e.source::VARCHAR) AS source, coalesce(b.host, e.target::VARCHAR) AS target
  FROM e LEFT JOIN x a ON a.entry = e.entry AND a.node = e.source LEFT JOIN x b ON b.entry = e.entry AND b.node = e.target)
SELECT * FROM y WHERE source <> target""",
    "run_hosts": f"""WITH RECURSIVE {_S},
a AS (SELECT entry, source, min(target) AS target FROM e GROUP BY 1, 2 HAVING count(DISTINCT target) = 1),
b AS (SELECT entry, target FROM e GROUP BY 1, 2 HAVING count(DISTINCT source) = 1),
l AS (SELECT a.entry, a.source, a.target FROM a JOIN b ON b.entry = a.entry AND b.target = a.target WHERE a.source % 11 <> 0 AND a.target % 11 <> 0),
c(entry, head, node) AS (SELECT DISTINCT entry, source, source FROM l WHERE source NOT IN (SELECT target FROM l) UNION ALL SELECT c.entry, c.head, l.target FROM c JOIN l ON l.entry = c.entry AND l.source = c.node),
g AS (SELECT c.entry, head AS key, count(*) AS n, row_number() OVER (PARTITION BY c.entry ORDER BY head) AS k FROM c JOIN t ON t.entry = c.entry WHERE head <> root GROUP BY 1, 2 HAVING count(*) >= 3),
{_fold(20)}
SELECT c.entry, c.node, 'run:' || c.head AS host FROM f JOIN g ON g.entry = f.entry AND g.k = f.k JOIN c ON c.entry = g.entry AND c.head = g.key WHERE fits""",
    "slice_islands": f"""WITH RECURSIVE {_S},
r(entry, node) AS (SELECT entry, root FROM t UNION SELECT r.entry, e.target FROM r JOIN e ON e.entry = r.entry AND e.source = r.node),
x AS (SELECT p_size AS entry, node, row_number() OVER (PARTITION BY p_size ORDER BY node) AS k FROM p WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.entry = p_size AND r.node = p.node))
SELECT x.entry, x.node FROM x JOIN t ON t.entry = x.entry WHERE k <= size - 20""",
    "seed_anchors": """WITH s AS (SELECT s_suppkey AS id, s_nationkey AS lane, row_number() OVER w AS k, first_value(s_suppkey) OVER w AS top FROM supplier
WINDOW w AS (PARTITION BY s_nationkey ORDER BY floor(s_acctbal / 1000) DESC, s_suppkey % 3 DESC, s_suppkey))
SELECT id, lane, (k > 3)::INTEGER AS level, CASE WHEN k > 3 THEN top END AS host FROM s""",
    "root_anchored": f"WITH {_P} SELECT node, coalesce(container, -1) AS container FROM p UNION ALL SELECT -1, NULL",
    "shortest_hidden": """WITH s AS (SELECT l_partkey, l_suppkey, l_linenumber - 1 AS hops, l_orderkey,
row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_linenumber = 1, l_linenumber, l_orderkey) AS k FROM lineitem)
SELECT l_partkey, l_suppkey, hops::INTEGER AS hops, CASE WHEN hops > 0 THEN l_orderkey END AS first FROM s WHERE k = 1""",
    "spine": f"""WITH RECURSIVE {_P},
e AS (SELECT DISTINCT src, dst, 'a' || (dst % 3) AS arm FROM (SELECT node // 4 AS src, node AS dst FROM p UNION ALL SELECT node // 3, node FROM p) WHERE src > 0),
r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst),
c AS (SELECT src AS node, count(*) AS reach FROM r GROUP BY 1),
w AS (SELECT src, dst, arm FROM (SELECT e.*, row_number() OVER (PARTITION BY src ORDER BY coalesce(reach, 0) DESC, arm, dst) AS k FROM e LEFT JOIN c ON c.node = dst) WHERE k = 1),
v(node) AS (SELECT node FROM p WHERE p_size <= 5 UNION SELECT w.dst FROM v JOIN w ON w.src = v.node)
SELECT src, dst, arm FROM w WHERE src IN (SELECT node FROM v)""",
    "linear_runs": f"""WITH {_P},
l AS (SELECT node, p_size % 2 = 0 AS linear, lag(node) OVER w AS prev, lag(p_size % 2 = 0) OVER w AS before FROM p WINDOW w AS (PARTITION BY p_brand ORDER BY node)),
t AS (SELECT prev, node FROM l WHERE linear AND before AND prev % 3 <> 0)
SELECT prev AS node FROM t UNION SELECT node FROM t""",
    "module_roots": f"""WITH {_FILES},
pk AS (SELECT DISTINCT dir FROM w WHERE page_id % 11 = 0),
pr AS (SELECT dir FROM pk WHERE NOT EXISTS (SELECT 1 FROM pk q WHERE starts_with(q.dir, pk.dir || '/'))),
en AS (SELECT DISTINCT dir FROM w WHERE page_id % 7 = 0 AND NOT EXISTS (SELECT 1 FROM pr WHERE starts_with(w.dir || '/', pr.dir || '/'))),
al AS (SELECT dir FROM pr UNION SELECT dir FROM en),
ro AS (SELECT dir FROM al WHERE NOT EXISTS (SELECT 1 FROM al q WHERE starts_with(q.dir, al.dir || '/'))),
so AS (SELECT DISTINCT dir FROM w WHERE page_id % 2 = 0),
li AS (SELECT DISTINCT split_part(dir, '/', 1) AS dir FROM so WHERE NOT EXISTS (SELECT 1 FROM ro WHERE split_part(ro.dir, '/', 1) = split_part(so.dir, '/', 1))),
kn AS (SELECT dir FROM ro UNION SELECT dir FROM li),
le AS (SELECT dir FROM so WHERE NOT EXISTS (SELECT 1 FROM kn WHERE starts_with(so.dir || '/', kn.dir || '/'))),
st AS (SELECT dir, array_to_string(list_slice(string_split(dir, '/'), 1, k), '/') AS step, k FROM (SELECT dir, unnest(range(1, len(string_split(dir, '/')) + 1)) AS k FROM le)),
mo AS (SELECT DISTINCT coalesce(arg_min(step, k) FILTER (WHERE NOT EXISTS (SELECT 1 FROM kn WHERE starts_with(kn.dir || '/', step || '/'))), dir) AS root FROM st GROUP BY st.dir),
ex AS (SELECT root FROM mo WHERE NOT EXISTS (SELECT 1 FROM mo q WHERE starts_with(mo.root, q.root || '/')))
SELECT dir, (length(dir) - length(replace(dir, '/', '')))::BIGINT AS depth FROM (SELECT dir FROM kn UNION SELECT root FROM ex)""",
    "app_roots": f"""WITH {_FILES},
a AS (SELECT DISTINCT replace(dir, '/', '.') AS module FROM w WHERE page_id % 4 = 0),
s AS (SELECT DISTINCT replace(dir, '/', '.') AS root FROM w WHERE page_id % 8 = 1),
c AS (SELECT module, regexp_replace(module, '\\.?[^.]*$', '') AS package, (SELECT arg_max(root, length(root)) FROM s WHERE starts_with(a.module, root || '.')) AS root FROM a),
n AS (SELECT package, coalesce(root, package) AS candidate, count(*) OVER (PARTITION BY coalesce(root, package)) AS n FROM c WHERE coalesce(root, package) <> '')
SELECT DISTINCT CASE WHEN n = 1 THEN candidate ELSE package END AS root FROM n""",
    "scope_coverage": f"""WITH {_FILES}, s AS (SELECT DISTINCT dir FROM w WHERE page_id % 8 = 1)
SELECT CASE WHEN EXISTS (SELECT 1 FROM s WHERE starts_with(w.dir || '/', s.dir || '/')) THEN '*' ELSE w.dir END AS dir, count(*) AS files FROM w GROUP BY 1""",
    "key_methods": f"""WITH {_T},
f AS (SELECT 'f' || node AS fqn, CASE WHEN p_size < 30 THEN p_brand || '/' || p_size END AS cls FROM p),
o AS (SELECT fqn AS handler, cls, coalesce(cls, fqn) AS fqn FROM f WHERE fqn IN (SELECT 'f' || node FROM p WHERE node % 10 = 0)),
b AS (SELECT handler, f.fqn, 1 AS method FROM o JOIN f ON f.cls = o.cls UNION ALL SELECT handler, fqn, 0 FROM o WHERE cls IS NULL),
r AS (SELECT handler, fqn FROM b WHERE method = 1 UNION SELECT handler, 'f' || dst FROM b JOIN e ON b.fqn = 'f' || src WHERE 'f' || dst IN (SELECT fqn FROM f)),
x AS (SELECT handler, fqn, 0 AS place FROM o UNION ALL SELECT handler, fqn, 1 FROM (SELECT handler, fqn FROM r EXCEPT SELECT handler, fqn FROM o)),
y AS (SELECT handler, fqn, row_number() OVER (PARTITION BY handler ORDER BY place, fqn) AS rank FROM x)
SELECT handler, fqn, rank::INTEGER AS rank FROM y WHERE rank <= 12""",
}

QUERIES = {name: globals()[name] for name in (*SQL, "sole_children")}

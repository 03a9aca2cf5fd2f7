"""Containment operators over the driver's tables, with the same queries in SQL.

Parts are nodes: part k lies in part k div 4 (in none where that is 0) and is called by the parts k div 4 and k div 3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forkline.operators import containment as C
from forkline.operators import repointing as R
from forkline.operators.graph import bfs_levels
from forkline.session import dealt, materialised, tables


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.expr("nullif(p_partkey div 4, 0)").alias("container"), "p_brand", "p_size")


def _callers(parts: DataFrame) -> DataFrame:
    both = parts.select(F.expr("node div 4").alias("src"), F.col("node").alias("dst")).union(parts.select(F.expr("node div 3"), "node"))
    return both.where("src > 0").distinct()


def containment_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.containment_depth(_parts(spark, sf_dir))


def descendant_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each part lies in part 1, 2, 3 and so on by its size."""
    parts = _parts(spark, sf_dir)
    return C.descendants(parts, parts.select("node", F.col("p_size").cast("long").alias("ancestor")))


def subtree_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    return C.subtree_sizes(parts, _callers(parts))


def nearest_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest caller of size 1 to 5."""
    parts = _parts(spark, sf_dir)
    return C.nearest_above(_callers(parts), parts, parts.where("p_size <= 5"))


def _members(parts: DataFrame) -> DataFrame:
    return parts.select(F.col("node").alias("id"), F.col("p_brand").alias("owner"), F.lit("f").alias("file"), F.col("p_size").alias("line"))


def body_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.body_heads(_members(_parts(spark, sf_dir)))


def owner_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    return C.owner_heads(_members(parts), _callers(parts))


def global_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of nations 0 and 1 and others of the highest balance, up to 40."""
    rows = tables(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", (F.col("s_nationkey") < 2).alias("promoted"))
    return C.filled(rows, 40, "s_acctbal", "s_suppkey").select("s_suppkey", "promoted")


def label_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.batches(_parts(spark, sf_dir).select("node", "p_brand"), "p_brand", "node")


def arm_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sites, return flags as arms, suppliers as components; those of three nations are utilities, the first of an order its owner."""
    items = dealt(tables(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("site"), F.col("l_returnflag").alias("idx"), F.col("l_suppkey").alias("component")), "site")
    arms = items.where("site is not null").withColumn("owner", F.min("component").over(Window.partitionBy("site")))
    return C.arm_reach(arms, tables(spark, sf_dir, "supplier").where("s_nationkey < 3").select(F.col("s_suppkey").alias("component")))


def trivial_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as entries, their brands as roots; parts of size 1 tell something."""
    parts = _parts(spark, sf_dir)
    entries = parts.select("node", F.col("p_brand").alias("root"), F.col("p_size").cast("long").alias("routes"))
    return C.trivial_groups(entries, _callers(parts), parts.where("p_size = 1"))


def _lies(parts: DataFrame) -> DataFrame:
    """Each part in the parts of a quarter and a third of its number."""
    return _callers(parts).select(F.col("dst").alias("node"), F.col("src").alias("container"))


def container_repoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of size 7 go, and the part of 16 times their number and one takes over, where it is one that stays."""
    parts = materialised(_parts(spark, sf_dir))
    keeps = parts.where("p_size <> 7").select(F.col("node").alias("keep"))
    moves = parts.where("p_size = 7").select(F.col("node").alias("other"), (16 * F.col("node") + 1).alias("keep")).join(keeps, "keep", "left_semi")
    gone = parts.where("p_size = 7").select(F.col("node").alias("other")).join(moves, "other", "left")
    return R.repointed(_lies(parts), gone)


def prune_unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that part 1 reaches over double, double and one, and triple numbers, none of a size that 4 divides but the first three; others go."""
    parts = materialised(_parts(spark, sf_dir))
    known = parts.where("p_size % 4 <> 0 or node < 4").select("node")
    ways = parts.select(F.col("node").alias("src"), F.explode(F.array(2 * F.col("node"), 2 * F.col("node") + 1, 3 * F.col("node"))).alias("dst"))
    edges = materialised(ways.join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    return R.pruned(_lies(parts), bfs_levels(edges, parts.where("node = 1")).select("node"))


_TREE = """p AS (SELECT p_partkey AS node, nullif(p_partkey // 4, 0) AS container, p_brand, p_size FROM part),
e AS (SELECT DISTINCT src, dst FROM (SELECT node // 4 AS src, node AS dst FROM p UNION ALL SELECT node // 3, node FROM p) WHERE src > 0)"""
_CLOSE = f"""{_TREE},
r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst)"""

SQL = {
    "containment_depth": f"""WITH RECURSIVE {_TREE},
d AS (SELECT node, 0 AS level FROM p WHERE container IS NULL UNION ALL SELECT p.node, d.level + 1 FROM p JOIN d ON p.container = d.node) SELECT * FROM d""",
    "descendant_pairs": f"""WITH RECURSIVE {_TREE},
u AS (SELECT node, container AS above FROM p UNION ALL SELECT u.node, p.container FROM u JOIN p ON p.node = u.above)
SELECT DISTINCT p.node, p_size::BIGINT AS ancestor FROM p JOIN u ON u.node = p.node AND u.above = p_size""",
    "subtree_sizes": f"""WITH RECURSIVE {_CLOSE}
SELECT node, count(dst) AS size FROM p LEFT JOIN r ON r.src = node GROUP BY node""",
    "nearest_above": f"""WITH RECURSIVE {_TREE},
w(node, spot, distance) AS (SELECT node, node, 0 FROM p UNION SELECT w.node, e.src, w.distance + 1 FROM w JOIN e ON e.dst = w.spot),
h AS (SELECT w.node, spot, distance FROM w JOIN p ON p.node = spot AND p.p_size <= 5)
SELECT node, min(spot) AS nearest, distance FROM h WHERE distance = (SELECT min(g.distance) FROM h g WHERE g.node = h.node) GROUP BY node, distance""",
    "body_heads": "SELECT p_brand AS owner, arg_min(p_partkey, p_size::BIGINT * 100000000 + p_partkey) AS head FROM part GROUP BY p_brand",
    "owner_heads": f"""WITH {_TREE},
f AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM e JOIN p q ON q.node = e.src WHERE e.dst = p.node AND q.p_brand = p.p_brand))
SELECT p_brand AS owner, arg_min(node, p_size::BIGINT * 100000000 + node) AS head FROM f GROUP BY p_brand""",
    "global_fill": """WITH s AS (SELECT s_suppkey, s_acctbal, s_nationkey < 2 AS promoted FROM supplier),
n AS (SELECT *, row_number() OVER (PARTITION BY promoted ORDER BY s_acctbal DESC, s_suppkey) AS k FROM s)
SELECT s_suppkey, promoted FROM n WHERE promoted OR k <= greatest(0, 40 - (SELECT count(*) FROM s WHERE promoted))""",
    "label_batches": "SELECT p_partkey AS node, p_brand, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 20 AS batch FROM part",
    "arm_reach": """WITH o AS (SELECT l_orderkey, min(l_suppkey) AS owner FROM lineitem GROUP BY 1)
SELECT l.l_orderkey AS site, l_returnflag AS idx, count(DISTINCT CASE WHEN l_suppkey <> owner AND s_nationkey >= 3 THEN l_suppkey END) AS n
FROM lineitem l JOIN o ON o.l_orderkey = l.l_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2""",
    "container_repoint": f"""WITH RECURSIVE {_TREE},
g AS (SELECT node AS other, CASE WHEN 16 * node + 1 IN (SELECT node FROM p WHERE p_size <> 7) THEN 16 * node + 1 END AS keep FROM p WHERE p_size = 7),
s AS (SELECT dst AS node, src AS container FROM e WHERE dst NOT IN (SELECT other FROM g) AND src NOT IN (SELECT other FROM g)),
u(node, above) AS (SELECT node, container FROM s UNION SELECT u.node, s.container FROM u JOIN s ON s.node = u.above)
SELECT node, container FROM s
UNION SELECT e.dst, g.keep FROM e JOIN g ON g.other = e.src WHERE g.keep IS NOT NULL AND g.keep <> e.dst AND e.dst NOT IN (SELECT other FROM g)
  AND NOT EXISTS (SELECT 1 FROM u WHERE u.node = g.keep AND u.above = e.dst)""",
    "prune_unreachable": f"""WITH RECURSIVE {_TREE},
k AS (SELECT node FROM p WHERE p_size % 4 <> 0 OR node < 4),
w AS (SELECT node AS src, unnest([2 * node, 2 * node + 1, 3 * node]) AS dst FROM k),
v(node) AS (SELECT 1::BIGINT UNION SELECT w.dst FROM v JOIN w ON w.src = v.node WHERE w.dst IN (SELECT node FROM k)),
z(node, spot, distance) AS (
  SELECT node, node, 0 FROM p WHERE node NOT IN (SELECT node FROM v)
  UNION SELECT z.node, e.src, z.distance + 1 FROM z JOIN e ON e.dst = z.spot WHERE z.spot NOT IN (SELECT node FROM v)),
h AS (SELECT node, spot, distance FROM z WHERE spot IN (SELECT node FROM v)),
n AS (SELECT node, min(spot) AS nearest FROM h WHERE distance = (SELECT min(g.distance) FROM h g WHERE g.node = h.node) GROUP BY node)
SELECT dst AS node, src AS container FROM e WHERE dst IN (SELECT node FROM v) AND src IN (SELECT node FROM v)
UNION SELECT e.dst, n.nearest FROM e JOIN n ON n.node = e.src WHERE e.dst IN (SELECT node FROM v)""",
    "trivial_groups": f"""WITH RECURSIVE {_CLOSE},
t AS (SELECT node FROM p WHERE p_size = 1 UNION SELECT src FROM r JOIN p ON p.node = dst AND p_size = 1),
m AS (SELECT p_brand, count(*) AS n, sum(p_size)::BIGINT AS routes FROM p WHERE node NOT IN (SELECT node FROM t) GROUP BY 1 HAVING count(*) > 1)
SELECT 'entry:trivial:' || p_brand AS entry, routes FROM m
UNION ALL SELECT node::VARCHAR, p_size::BIGINT FROM p WHERE node IN (SELECT node FROM t) OR p_brand NOT IN (SELECT p_brand FROM m)""",
}

QUERIES = {name: globals()[name] for name in SQL}

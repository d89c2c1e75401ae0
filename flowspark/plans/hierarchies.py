"""Queries over the flow graphs of dag_nodes and dag_edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.operators.hierarchy import descendant_counts, descendants, hierarchy
from flowspark.session import Scratch
from flowspark.sources.tables import read


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(spark, read(spark, d, "dag_nodes"), read(spark, d, "dag_edges"), paths=False)


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path, depth, root and number of descendants of every node."""
    tree = Scratch(spark, "paths").put(hierarchy(spark, read(spark, d, "dag_nodes"), read(spark, d, "dag_edges")))
    t = descendant_counts(tree)
    return t.select("dag_id", "node_id", "root_id", "depth", F.array_join("path", " > ").alias("path"), F.col("n_descendants").cast("long").alias("n_descendants"))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(hierarchy(spark, read(spark, d, "dag_nodes"), read(spark, d, "dag_edges")))


QUERIES = {"p3_found": p3_found, "p3_paths": p3_paths, "p3_descendants": p3_descendants}

_ABOVE = """
n AS (SELECT DISTINCT dag_id AS g, trim(node_id) AS v FROM dag_nodes WHERE dag_id IS NOT NULL AND node_id IS NOT NULL),
e AS (SELECT DISTINCT dag_id AS g, trim(src) AS s, trim(dst) AS d FROM dag_edges x
      WHERE EXISTS (SELECT 1 FROM n WHERE g = x.dag_id AND v = trim(x.src)) AND EXISTS (SELECT 1 FROM n WHERE g = x.dag_id AND v = trim(x.dst))),
up(g, v, a) AS (SELECT g, d, s FROM e UNION SELECT up.g, up.v, e.s FROM up JOIN e ON e.g = up.g AND e.d = up.a),
cyc AS (SELECT DISTINCT g, v FROM up WHERE v = a),
low AS (SELECT DISTINCT up.g, up.v FROM up JOIN cyc ON cyc.g = up.g AND cyc.v = up.a),
tree AS (SELECT n.g, n.v FROM n WHERE NOT EXISTS (SELECT 1 FROM cyc WHERE cyc.g = n.g AND cyc.v = n.v) AND NOT EXISTS (SELECT 1 FROM low WHERE low.g = n.g AND low.v = n.v)),
far AS (SELECT t.g, t.v, count(u.a) AS depth FROM tree t LEFT JOIN up u ON u.g = t.g AND u.v = t.v GROUP BY t.g, t.v)
"""
_STATE = """
state AS (
  SELECT f.g, f.v, coalesce((SELECT min(u.a) FROM up u JOIN far r ON r.g = u.g AND r.v = u.a AND r.depth = 0 WHERE u.g = f.g AND u.v = f.v), f.v) AS root, f.depth FROM far f
  UNION ALL SELECT g, v, '', CASE WHEN EXISTS (SELECT 1 FROM cyc WHERE cyc.g = n.g AND cyc.v = n.v) THEN -1 ELSE -2 END FROM n WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.g = n.g AND t.v = n.v))
"""
SQL = {
    "p3_found": f"WITH RECURSIVE {_ABOVE}, {_STATE} SELECT g AS dag_id, v AS node_id, root AS root_id, depth::INT AS depth FROM state",
    "p3_paths": f"""WITH RECURSIVE {_ABOVE}, {_STATE},
way AS (SELECT s.g, s.v, string_agg(u.a, ' > ' ORDER BY r.depth) AS above FROM state s JOIN up u ON u.g = s.g AND u.v = s.v JOIN far r ON r.g = u.g AND r.v = u.a WHERE s.depth > 0 GROUP BY s.g, s.v),
below AS (SELECT g, a AS v, count(*) AS k FROM up WHERE EXISTS (SELECT 1 FROM tree t WHERE t.g = up.g AND t.v = up.v) GROUP BY g, a)
SELECT s.g AS dag_id, s.v AS node_id, s.root AS root_id, s.depth::INT AS depth, CASE WHEN s.depth >= 0 THEN coalesce(w.above || ' > ', '') || s.v END AS path,
  CASE WHEN s.depth >= 0 THEN coalesce(b.k, 0)::BIGINT END AS n_descendants
FROM state s LEFT JOIN way w ON w.g = s.g AND w.v = s.v LEFT JOIN below b ON b.g = s.g AND b.v = s.v""",
    "p3_descendants": f"WITH RECURSIVE {_ABOVE} SELECT u.g AS dag_id, u.a AS node_id, u.v AS descendant_id, (f.depth - h.depth)::INT AS distance FROM up u JOIN far f ON f.g = u.g AND f.v = u.v JOIN far h ON h.g = u.g AND h.v = u.a",
}

"""Routing and topology tables derived from the general test tables, once for Spark and once as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import ip as ipf


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hex(value) -> F.Column:
    return F.lower(F.lpad(F.hex(value), 8, "0"))


def raw_routes(spark, sf_dir):
    """A route per customer and order: several rows for one key, some without a path, some in conflict."""
    c = table(spark, sf_dir, "customer").selectExpr("concat('P', c_nationkey % 5) AS peer_id", "c_custkey AS k", "CAST(8 + c_custkey % 17 AS int) AS prefix_len", "if(c_custkey % 11 = 0, NULL, array(3491L, 100L + c_nationkey, 1000L + c_custkey % 97)) AS path")
    o = table(spark, sf_dir, "orders").selectExpr("concat('P', o_custkey % 5) AS peer_id", "o_custkey AS k", "24 AS prefix_len", "CASE o_orderstatus WHEN 'O' THEN array(3491L, 64500L + o_custkey % 7) WHEN 'F' THEN array(3491L, 3491L, 64500L + o_custkey % 7) END AS path")
    r = c.unionByName(o).withColumn("addr", _hex(F.expr("(k * 2654435761) % 4294967296")))
    return r.select("peer_id", F.lit(4).alias("family"), "prefix_len", ipf.mask(F.col("addr"), F.col("prefix_len")).alias("prefix_key"), "path")


RAW = """
raw AS (
  SELECT peer_id, prefix_len, (((k * 2654435761) % 4294967296) >> (32 - prefix_len)) << (32 - prefix_len) AS prefix_key, path FROM (
    SELECT 'P' || (c_nationkey % 5) AS peer_id, c_custkey AS k, 8 + c_custkey % 17 AS prefix_len,
           CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE '3491,' || (100 + c_nationkey) || ',' || (1000 + c_custkey % 97) END AS path FROM customer
    UNION ALL
    SELECT 'P' || (o_custkey % 5), o_custkey, 24, CASE o_orderstatus WHEN 'O' THEN '3491,' || (64500 + o_custkey % 7) WHEN 'F' THEN '3491,3491,' || (64500 + o_custkey % 7) END FROM orders)),
routes AS (SELECT peer_id, prefix_len, prefix_key, CASE WHEN count(path) = count(*) AND count(DISTINCT path) = 1 THEN min(path) END AS path FROM raw GROUP BY ALL)
"""

#: Text of an IPv4 number, and of a path without repeats of its first number (paths here repeat no other).
V4 = "({0} >> 24) || '.' || (({0} >> 16) & 255) || '.' || (({0} >> 8) & 255) || '.' || ({0} & 255)"
SHOWN = "replace({0}, '3491,3491,', '3491,')"


def probes(spark, sf_dir):
    """A probe per event; some addresses are not sound, some sessions unknown, some of a family that no session has."""
    value = F.expr("(event_id * 2246822519) % 4294967296")
    text = F.when(F.col("event_id") % 13 == 0, F.lit("999.1.1.1")).when(F.col("event_id") % 17 == 0, F.lit("2001:db8::1")).otherwise(ipf.v4_text(value))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("probe_id"), F.concat(F.lit("P"), F.col("event_id") % 6).alias("peer_id"), text.alias("ip"))


PROBES = f"""
probes AS (SELECT event_id AS probe_id, 'P' || (event_id % 6) AS peer_id, (event_id * 2246822519) % 4294967296 AS v,
  CASE WHEN event_id % 13 = 0 THEN 'bad' WHEN event_id % 17 = 0 THEN 'v6' ELSE 'v4' END AS kind,
  CASE WHEN event_id % 13 = 0 THEN '999.1.1.1' WHEN event_id % 17 = 0 THEN '2001:db8::1' ELSE {V4.format('((event_id * 2246822519) % 4294967296)')} END AS ip FROM events),
hits AS (SELECT p.probe_id, r.prefix_len, r.prefix_key, r.path, row_number() OVER (PARTITION BY p.probe_id ORDER BY r.prefix_len DESC) AS n
  FROM probes p JOIN routes r ON r.peer_id = p.peer_id AND (p.v >> (32 - r.prefix_len)) << (32 - r.prefix_len) = r.prefix_key WHERE p.kind = 'v4'),
best AS (SELECT * FROM hits WHERE n = 1)
"""


def order_paths(spark, sf_dir):
    """A path per order: its suppliers by line number, the first one twice; null for every 19th."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_suppkey").alias("s")))).alias("x"))
    path = F.transform("x", lambda e: e["s"] % 9 + 1)
    return l.select(F.col("l_orderkey").alias("id"), F.when(F.col("l_orderkey") % 19 != 0, F.concat(F.slice(path, 1, 1), path)).alias("path"))


PATHS = """
paths AS (SELECT l_orderkey AS id, CASE WHEN l_orderkey % 19 <> 0 THEN list_concat(p[1:1], p) END AS path FROM
  (SELECT l_orderkey, list(l_suppkey % 9 + 1 ORDER BY l_linenumber, l_suppkey) AS p FROM lineitem GROUP BY l_orderkey)),
flat AS (SELECT id, list_filter(path, lambda v, i: i = 1 OR v <> path[i - 1]) AS path FROM paths)
"""


def edge_rows(spark, sf_dir):
    """Relationship rows with line numbers; one pair may have several."""
    l = table(spark, sf_dir, "lineitem")
    return l.select(F.expr("if(l_linenumber % 2 = 0, l_suppkey, 100000 + l_partkey)").alias("a"), F.expr("if(l_linenumber % 2 = 0, 100000 + l_partkey, l_suppkey)").alias("b"), F.expr("if(l_returnflag = 'N', 0, -1)").alias("rel"), F.expr("l_orderkey * 10 + l_linenumber").alias("line_no"))


def edges(spark, sf_dir):
    from netloom.operators.topology import first_edges

    return first_edges(edge_rows(spark, sf_dir))


def membership(spark, sf_dir):
    """Suppliers by nation, parts by size, as groups g01 to g05 of unlike sizes, each with several tiles."""
    grp = lambda k: F.format_string("g%02d", k)
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("asn"), grp(F.expr("CAST(s_nationkey % 5 + 1 AS int)")).alias("grp"))
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") + 100000).alias("asn"), grp(F.expr("CAST(p_size % 12 % 5 + 1 AS int)")).alias("grp"))
    return s.unionByName(p)


EDGES = """
rows_ AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey ELSE 100000 + l_partkey END AS a, CASE WHEN l_linenumber % 2 = 0 THEN 100000 + l_partkey ELSE l_suppkey END AS b,
  CASE WHEN l_returnflag = 'N' THEN 0 ELSE -1 END AS rel, l_orderkey * 10 + l_linenumber AS line_no FROM lineitem),
edges AS (SELECT a, b, rel FROM (SELECT *, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY line_no, a, b, rel) AS n FROM rows_) WHERE n = 1),
adj AS (SELECT a AS asn, b AS nbr, CASE WHEN rel = 0 THEN 'peer' ELSE 'customer' END AS role FROM edges UNION ALL SELECT b, a, CASE WHEN rel = 0 THEN 'peer' ELSE 'provider' END FROM edges),
deg AS (SELECT asn, count(DISTINCT nbr) AS degree FROM adj GROUP BY asn)
"""
GROUPS = """
m AS (SELECT s_suppkey AS asn, 'g0' || (s_nationkey % 5 + 1) AS grp FROM supplier UNION ALL SELECT 100000 + p_partkey, 'g0' || (p_size % 12 % 5 + 1) FROM part),
placed AS (SELECT e.*, x.grp AS ga, y.grp AS gb FROM edges e JOIN m x ON e.a = x.asn JOIN m y ON e.b = y.asn)
"""


def organizations(spark, sf_dir):
    """org_id, name, country: a nation is an organization; every seventh is unknown."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.where("n_nationkey % 7 <> 0").join(r, n.n_regionkey == r.r_regionkey).select(F.concat(F.lit("ORG-"), F.col("n_nationkey")).alias("org_id"), F.col("n_name").alias("name"), F.col("r_name").alias("country"))


def as_info(spark, sf_dir):
    """asn, name, org_id of suppliers, and of two parts in three; the rest are unknown."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("asn"), F.col("s_name").alias("name"), F.concat(F.lit("ORG-"), F.col("s_nationkey")).alias("org_id"))
    p = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select((F.col("p_partkey") + 100000).alias("asn"), F.col("p_name").alias("name"), F.concat(F.lit("ORG-"), F.col("p_partkey") % 25).alias("org_id"))
    return s.unionByName(p)


ORGS = """
orgs AS (SELECT 'ORG-' || n_nationkey AS org_id, n_name AS name, r_name AS country FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 7 <> 0),
info AS (SELECT s_suppkey AS asn, s_name AS name, 'ORG-' || s_nationkey AS org_id FROM supplier UNION ALL SELECT 100000 + p_partkey, p_name, 'ORG-' || (p_partkey % 25) FROM part WHERE p_partkey % 3 <> 0)
"""

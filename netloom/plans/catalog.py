"""The catalogue: a query per operator group over the derived tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import bz2
import gzip

from pyspark.sql import functions as F

from netloom.functions import dates, ip as ipf, paths as pf
from netloom.operators import explorer, graph, layout, routing
from netloom.operators import topology as topo
from netloom.plans import publish, views
from netloom.plans.views import EDGES, GROUPS, ORGS, PATHS, PROBES, RAW, SHOWN, V4, table
from netloom.session import cut
from netloom.sources.topology import ASSETS

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def big(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def joined(path):
    return F.array_join(F.transform(path, lambda v: v.cast("string")), ",")


def routes(spark, sf_dir):
    return routing.merge_routes(views.raw_routes(spark, sf_dir))


STATUS = f"""
SELECT p.probe_id, p.ip,
  CASE WHEN p.kind = 'bad' THEN 'invalid_ip' WHEN p.peer_id = 'P5' THEN 'unknown_peer' WHEN p.kind = 'v6' THEN 'missing_family'
       WHEN b.probe_id IS NULL THEN 'not_observed' WHEN b.path IS NULL THEN 'unsupported_path' ELSE 'ok' END AS status,
  CASE WHEN b.path IS NOT NULL THEN {V4.format('b.prefix_key')} || '/' || b.prefix_len END AS prefix, {SHOWN.format('b.path')} AS path
FROM probes p LEFT JOIN best b ON p.probe_id = b.probe_id
"""


@query("q01_longest_prefix_match", f"WITH {RAW}, {PROBES} SELECT p.probe_id, CAST(b.prefix_len AS BIGINT) AS prefix_len, b.prefix_key AS prefix_key, b.path FROM probes p JOIN best b ON p.probe_id = b.probe_id")
def q01(spark, sf_dir):
    p = views.probes(spark, sf_dir).withColumn("x", ipf.parse_ip(F.col("ip"))).where("x IS NOT NULL").select("probe_id", "peer_id", "x.family", "x.addr")
    best = routing.longest_match(p, routes(spark, sf_dir))
    return p.join(best, ["peer_id", "family", "addr"]).select("probe_id", *big("prefix_len"), F.conv("prefix_key", 16, 10).cast("bigint").alias("prefix_key"), joined(F.col("path")).alias("path"))


@query("q02_lookup_status", f"WITH {RAW}, {PROBES} {STATUS}")
def q02(spark, sf_dir):
    out = routing.lookup(views.probes(spark, sf_dir), routes(spark, sf_dir))
    return out.select("probe_id", "ip", "status", "prefix", joined(F.col("path")).alias("path"))


@query("q03_merge_routes", f"WITH {RAW} SELECT peer_id, CAST(prefix_len AS BIGINT) AS prefix_len, prefix_key, path FROM routes")
def q03(spark, sf_dir):
    return routes(spark, sf_dir).select("peer_id", *big("prefix_len"), F.conv("prefix_key", 16, 10).cast("bigint").alias("prefix_key"), joined(F.col("path")).alias("path"))


@query("q04_table_metadata", f"""WITH {RAW}, c AS (SELECT peer_id, count(*) AS n FROM routes GROUP BY peer_id)
SELECT peer_id, n AS ipv4_routes, (SELECT count(*) FROM routes) AS route_count,
  (SELECT CAST(sum(len(string_split(path, ','))) AS BIGINT) FROM (SELECT DISTINCT path FROM raw WHERE path IS NOT NULL)) AS path_asns, (SELECT min(peer_id) FROM c) AS default_peer FROM c""")
def q04(spark, sf_dir):
    raw = views.raw_routes(spark, sf_dir)
    merged = routing.merge_routes(raw)
    counts = routing.prefix_counts(merged)
    peers = counts.select("peer_id", F.substring("peer_id", 2, 9).cast("int").alias("peer_index")).distinct()
    meta = routing.peer_metadata(counts, peers)
    return meta.crossJoin(routing.check_limits(routing.table_size(raw, merged))).crossJoin(routing.default_peer(counts, peers)).select("peer_id", F.col("prefix_counts")["4"].alias("ipv4_routes"), "route_count", "path_asns", "default_peer")


@query("q05_ipv4_text", """WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '0' ELSE '' END || ((event_id * 7) % 300) || '.' || (event_id % 260) || '.1.' || (event_id % 3) AS text FROM events),
p AS (SELECT event_id, text, string_split(text, '.') AS x FROM t)
SELECT event_id, text, CASE WHEN regexp_full_match(text, '((0|[1-9][0-9]{0,2})[.]){3}(0|[1-9][0-9]{0,2})') AND CAST(x[1] AS INT) <= 255 AND CAST(x[2] AS INT) <= 255 THEN
  CAST(x[1] AS BIGINT) * 16777216 + CAST(x[2] AS BIGINT) * 65536 + 256 + CAST(x[4] AS BIGINT) END AS value,
  CASE WHEN regexp_full_match(text, '((0|[1-9][0-9]{0,2})[.]){3}(0|[1-9][0-9]{0,2})') AND CAST(x[1] AS INT) <= 255 AND CAST(x[2] AS INT) <= 255 THEN text END AS round_trip FROM p""")
def q05(spark, sf_dir):
    text = F.expr("concat(if(event_id % 5 = 0, '0', ''), (event_id * 7) % 300, '.', event_id % 260, '.1.', event_id % 3)")
    t = table(spark, sf_dir, "events").select("event_id", text.alias("text")).withColumn("value", ipf.v4_value(F.col("text")))
    return t.select("event_id", "text", "value", ipf.v4_text(F.col("value")).alias("round_trip"))


#: Text of a list of eight groups (column hs of hexadecimal texts): the first longest run of two and more zeros is left out.
V6 = """z AS (SELECT *, list_transform(range(1, 9), lambda i: CASE WHEN hs[i] = '0' THEN list_min(list_filter(range(i, 10), lambda j: j = 9 OR hs[j] <> '0')) - i ELSE 0 END) AS runs FROM {0}),
best AS (SELECT *, list_max(runs) AS most, list_position(runs, list_max(runs)) AS pos FROM z)"""


@query("q06_ipv6_text", f"""WITH t AS (SELECT event_id, [CASE WHEN (event_id >> i) % 3 = 0 THEN 0 ELSE (event_id * (i + 7)) % 65536 END FOR i IN range(8)] AS g FROM events),
h AS (SELECT event_id, g, [format('{{:x}}', x) FOR x IN g] AS hs FROM t), {V6.format('h')}
SELECT event_id, list_aggregate([format('{{:04x}}', x) FOR x IN g], 'string_agg', '') AS addr,
  CASE WHEN most < 2 THEN array_to_string(hs, ':') ELSE array_to_string(hs[1:pos - 1], ':') || '::' || array_to_string(hs[pos + most:], ':') END AS text FROM best""")
def q06(spark, sf_dir):
    """Eight groups in full, parsed, and written in the canonical form."""
    groups = F.array(*[F.expr(f"if((shiftright(event_id, {i})) % 3 = 0, 0L, (event_id * {i + 7}) % 65536)") for i in range(8)])
    long = F.array_join(F.transform(groups, lambda g: F.lower(F.hex(g))), ":")
    t = table(spark, sf_dir, "events").select("event_id", ipf.parse_ip(long)["addr"].alias("addr"))
    return t.select("event_id", "addr", ipf.format_ip(F.lit(6), F.col("addr")).alias("text"))


@query("q07_collapse_paths", f"WITH {PATHS} SELECT id, array_to_string(path, ',') AS path, CAST(greatest(len(path) - 1, 0) AS BIGINT) AS hops FROM flat WHERE path IS NOT NULL")
def q07(spark, sf_dir):
    p = views.order_paths(spark, sf_dir).where("path IS NOT NULL").withColumn("path", pf.collapse(F.col("path")))
    return p.select("id", joined(F.col("path")).alias("path"), pf.hops(F.col("path")).cast("bigint").alias("hops"))


@query("q08_compare_paths", f"""WITH {PATHS}, pr AS (SELECT x.id, x.path AS a, y.path AS b FROM flat x JOIN flat y ON y.id = x.id + 1 WHERE x.path IS NOT NULL AND y.path IS NOT NULL),
k AS (SELECT *, coalesce(list_min([i FOR i IN range(1, least(len(a), len(b)) + 1) IF a[i] <> b[i]]) - 1, least(len(a), len(b))) AS k FROM pr),
s AS (SELECT id, k, a[k + 1:] AS ba, b[k + 1:] AS bb, a[1:k] AS t FROM k)
SELECT id, array_to_string(t, ',') AS trunk, array_to_string(ba, ',') AS branch_a, array_to_string(bb, ',') AS branch_b,
  array_to_string(list_sort(list_distinct(list_intersect(ba, bb))), ',') AS later_common,
  CASE WHEN len(ba) = 0 AND len(bb) = 0 THEN 'same' WHEN k > 0 AND (len(ba) = 0 OR len(bb) = 0) THEN 'one_ends' WHEN k > 0 THEN 'shared_then_split' ELSE 'disjoint' END AS relation FROM s""")
def q08(spark, sf_dir):
    p = views.order_paths(spark, sf_dir).where("path IS NOT NULL").select("id", pf.collapse(F.col("path")).alias("path"))
    pairs = p.select("id", F.col("path").alias("a")).join(p.select((F.col("id") - 1).alias("id"), F.col("path").alias("b")), "id")
    out = routing.with_comparison(pairs, F.col("a"), F.col("b"))
    return out.select("id", *[joined(F.col(c)).alias(c) for c in ("trunk", "branch_a", "branch_b")], joined(F.array_sort("later_common")).alias("later_common"), "relation")


@query("q09_degrees", f"WITH {EDGES} SELECT asn, degree FROM deg")
def q09(spark, sf_dir):
    return topo.degrees(topo.adjacency(views.edges(spark, sf_dir)))


@query("q10_ordered_adjacency", f"WITH {EDGES} SELECT adj.asn, nbr, role, d.degree, row_number() OVER (PARTITION BY adj.asn ORDER BY d.degree DESC, nbr) AS position FROM adj JOIN deg d ON nbr = d.asn")
def q10(spark, sf_dir):
    adj = topo.adjacency(views.edges(spark, sf_dir))
    return topo.ordered_neighbours(adj, topo.degrees(adj)).select("asn", "nbr", "role", "degree", *big("position"))


@query("q11_group_pairs", f"WITH {EDGES}, {GROUPS} SELECT least(ga, gb) AS source, greatest(ga, gb) AS target, count(*) AS count, count(*) FILTER (rel = 0) AS peer_count, count(*) FILTER (rel = -1) AS provider_customer_count FROM placed WHERE ga <> gb GROUP BY 1, 2")
def q11(spark, sf_dir):
    return topo.pair_edges(topo.with_groups(views.edges(spark, sf_dir), views.membership(spark, sf_dir)))


TILES = """
o AS (SELECT asn, grp, row_number() OVER (PARTITION BY grp ORDER BY asn) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM m),
b AS (SELECT *, n // CAST(ceil(n / 240.0) AS BIGINT) AS base, n % CAST(ceil(n / 240.0) AS BIGINT) AS rest FROM o),
t AS (SELECT asn, grp, grp || '-c' || format('{:03d}', 1 + CASE WHEN pos < rest * (base + 1) THEN pos // (base + 1) ELSE rest + (pos - rest * (base + 1)) // base END) AS tile FROM b)
"""


def tiled(spark, sf_dir):
    from pyspark.sql import Window

    m = views.membership(spark, sf_dir)
    return topo.tiles(m.withColumn("position", F.row_number().over(Window.partitionBy("grp").orderBy("asn")) - 1))


@query("q12_tiles", f"WITH {EDGES}, {GROUPS}, {TILES} SELECT tile, count(*) AS nodes, min(asn) AS first FROM t GROUP BY tile")
def q12(spark, sf_dir):
    return tiled(spark, sf_dir).groupBy("tile").agg(F.count("*").alias("nodes"), F.min("asn").alias("first"))


@query("q12_tile_pairs", f"""WITH {EDGES}, {GROUPS}, {TILES}, e AS (SELECT x.grp, x.tile AS ta, y.tile AS tb FROM edges JOIN t x ON a = x.asn JOIN t y ON b = y.asn WHERE x.grp = y.grp AND x.tile <> y.tile)
SELECT least(ta, tb) AS source, greatest(ta, tb) AS target, count(*) AS count FROM e GROUP BY 1, 2""")
def q12_pairs(spark, sf_dir):
    t = tiled(spark, sf_dir)
    placed = topo.with_groups(views.edges(spark, sf_dir), t.select("asn", F.col("tile").alias("grp"))).where("substring_index(ga, '-', 1) = substring_index(gb, '-', 1)")
    return topo.pair_edges(placed).select("source", "target", "count")


@query("q12_tile_external", f"""WITH {EDGES}, {GROUPS}, {TILES}, e AS (SELECT x.tile AS ta, y.tile AS tb FROM edges JOIN t x ON a = x.asn JOIN t y ON b = y.asn WHERE x.tile <> y.tile)
SELECT tile, count(*) AS external FROM (SELECT ta AS tile FROM e UNION ALL SELECT tb FROM e) GROUP BY tile""")
def q12_external(spark, sf_dir):
    placed = topo.with_groups(views.edges(spark, sf_dir), tiled(spark, sf_dir).select("asn", F.col("tile").alias("grp")))
    return topo.external_links(placed).withColumnRenamed("grp", "tile")


@query("q13_seeds", f"WITH {EDGES}, {GROUPS} SELECT grp, asn AS seed FROM (SELECT grp, m.asn, row_number() OVER (PARTITION BY grp ORDER BY degree DESC, m.asn) AS n FROM m JOIN deg ON m.asn = deg.asn) WHERE n = 1")
def q13(spark, sf_dir):
    return topo.seeds(views.membership(spark, sf_dir), topo.degrees(topo.adjacency(views.edges(spark, sf_dir))))


DISTANCES = f"""WITH RECURSIVE {EDGES}, d(asn, distance) AS (SELECT (SELECT asn FROM deg ORDER BY degree DESC, asn LIMIT 1), 0 UNION SELECT adj.nbr, d.distance + 1 FROM d JOIN adj ON d.asn = adj.asn WHERE d.distance < 12),
f AS (SELECT asn, min(distance) AS distance FROM d GROUP BY asn)"""


def distances(spark, sf_dir):
    adj = topo.adjacency(cut(views.edges(spark, sf_dir)))  # the start and the levels both need them
    seed = topo.seeds(adj.select("asn").distinct().withColumn("grp", F.lit("g01")), topo.degrees(adj))
    return graph.distances(seed.select("grp", F.col("seed").alias("asn")), adj.select(F.lit("g01").alias("grp"), "asn", "nbr"))


@query("q14_bfs_distances", f"{DISTANCES} SELECT asn, CAST(distance AS BIGINT) AS distance FROM f")
def q14(spark, sf_dir):
    return distances(spark, sf_dir).select("asn", *big("distance"))


@query("q14_distance_histogram", f"{DISTANCES} SELECT CAST(distance AS BIGINT) AS distance, count(*) AS n FROM f GROUP BY 1")
def q14_histogram(spark, sf_dir):
    return distances(spark, sf_dir).groupBy(*big("distance")).agg(F.count("*").alias("n"))


#: Inside groups: adj_, degree of all, components, distance within a component from its best node, and the queue's order.
ORDER = f"""WITH RECURSIVE {EDGES}, {GROUPS}, i AS (SELECT a AS x, b AS y FROM placed WHERE ga = gb UNION SELECT b, a FROM placed WHERE ga = gb),
r(asn, low) AS (SELECT asn, asn FROM m UNION SELECT i.y, r.low FROM r JOIN i ON r.asn = i.x), c AS (SELECT asn, min(low) AS component FROM r GROUP BY asn),
n AS (SELECT m.grp, m.asn, component, coalesce(degree, 0) AS degree FROM m JOIN c ON m.asn = c.asn LEFT JOIN deg ON m.asn = deg.asn),
s AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY degree DESC, asn) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY degree DESC, asn) AS k FROM n) WHERE k = 1),
f0(asn, distance) AS (SELECT asn, 0 FROM s UNION SELECT i.y, f0.distance + 1 FROM f0 JOIN i ON f0.asn = i.x WHERE f0.distance < 12),
far AS (SELECT asn, min(distance) AS distance FROM f0 GROUP BY asn),
q(component, asn, level, place) AS (SELECT component, asn, 0, CAST(1 AS BIGINT) FROM s
  UNION ALL SELECT component, asn, level, row_number() OVER (PARTITION BY component ORDER BY parent, degree DESC, asn) FROM
  (SELECT q.component, i.y AS asn, q.level + 1 AS level, min(q.place) AS parent, any_value(n.degree) AS degree FROM q JOIN i ON q.asn = i.x JOIN far ON far.asn = i.y AND far.distance = q.level + 1 JOIN n ON n.asn = i.y GROUP BY q.component, i.y, q.level)),
bfs AS (SELECT s.grp, q.asn, row_number() OVER (PARTITION BY s.grp ORDER BY s.rank, q.level, q.place) - 1 AS position FROM q JOIN s ON q.component = s.component)"""


@query("q14_bfs_order", f"{ORDER} SELECT grp, asn, position FROM bfs")
def q14_order(spark, sf_dir):
    m = views.membership(spark, sf_dir)
    placed = topo.with_groups(views.edges(spark, sf_dir), m).where("ga = gb")
    adj = topo.adjacency(placed.select("a", "b", "rel"))
    nodes = m.join(topo.degrees(topo.adjacency(views.edges(spark, sf_dir))), "asn", "left").select("grp", "asn", F.coalesce("degree", F.lit(0)).alias("degree"))
    return graph.breadth_first(nodes, adj.join(m, "asn").select("grp", "asn", "nbr")).select("grp", "asn", *big("position"))


@query("q15_components", f"WITH RECURSIVE {EDGES}, {GROUPS}, i AS (SELECT a AS x, b AS y FROM placed WHERE ga = gb UNION SELECT b, a FROM placed WHERE ga = gb), r(asn, low) AS (SELECT asn, asn FROM m UNION SELECT i.y, r.low FROM r JOIN i ON r.asn = i.x) SELECT asn, min(low) AS component FROM r GROUP BY asn")
def q15(spark, sf_dir):
    m = views.membership(spark, sf_dir)
    return graph.components(m.select("asn"), topo.with_groups(views.edges(spark, sf_dir), m).where("ga = gb"))


@query("q16_modularity", f"""WITH {EDGES}, {GROUPS}, t AS (SELECT count(*) AS m FROM placed), l AS (SELECT ga AS grp, count(*) AS l FROM placed WHERE ga = gb GROUP BY ga),
d AS (SELECT grp, count(*) AS d FROM (SELECT ga AS grp FROM placed UNION ALL SELECT gb FROM placed) GROUP BY grp)
SELECT round(sum(coalesce(l, 0) / CAST(m AS DOUBLE) - (d / (2.0 * m)) * (d / (2.0 * m))), 6) AS modularity FROM d LEFT JOIN l ON d.grp = l.grp, t""")
def q16(spark, sf_dir):
    return topo.modularity(views.edges(spark, sf_dir), views.membership(spark, sf_dir)).select(F.round("modularity", 6).alias("modularity"))


@query("q17_external_neighbours", f"WITH {EDGES}, {GROUPS} SELECT x.grp, count(DISTINCT nbr) AS n FROM adj JOIN m x ON adj.asn = x.asn JOIN m y ON nbr = y.asn WHERE x.grp <> y.grp GROUP BY x.grp")
def q17(spark, sf_dir):
    return topo.external_neighbours(topo.adjacency(views.edges(spark, sf_dir)), views.membership(spark, sf_dir))


SEED_ORG = "so AS (SELECT grp, org_id FROM (SELECT m.grp, org_id, row_number() OVER (PARTITION BY m.grp ORDER BY degree DESC, m.asn) AS n FROM m JOIN deg ON m.asn = deg.asn JOIN info ON m.asn = info.asn) WHERE n = 1)"


@query("q18_visible_members", f"""WITH {EDGES}, {GROUPS}, {ORGS}, {SEED_ORG}, r AS (SELECT m.grp, m.asn, coalesce(degree, 0) AS degree, coalesce(info.org_id = so.org_id, false) AS own FROM m LEFT JOIN deg ON m.asn = deg.asn LEFT JOIN info ON m.asn = info.asn JOIN so ON m.grp = so.grp),
a AS (SELECT grp, asn, row_number() OVER (PARTITION BY grp ORDER BY degree DESC, asn) AS p FROM r WHERE own), b AS (SELECT grp, asn, row_number() OVER (PARTITION BY grp ORDER BY degree DESC, asn) AS p FROM r),
u AS (SELECT grp, asn, min(p) AS p FROM (SELECT * FROM a WHERE p <= 24 UNION ALL SELECT grp, asn, p + 24 FROM b WHERE p <= 96) GROUP BY grp, asn)
SELECT * FROM (SELECT grp, asn, row_number() OVER (PARTITION BY grp ORDER BY p) AS position FROM u) WHERE position <= 120""")
def q18(spark, sf_dir):
    m, info = views.membership(spark, sf_dir), views.as_info(spark, sf_dir).select("asn", "org_id")
    d = topo.degrees(topo.adjacency(views.edges(spark, sf_dir)))
    return topo.visible_members(topo.ranked_members(m, d, info)).select("grp", "asn", *big("position"))


@query("q19_top_links", f"""WITH {EDGES}, {GROUPS} SELECT * FROM (SELECT ga AS grp, a, b, CAST(rel AS BIGINT) AS rel, x.degree + y.degree AS weight, row_number() OVER (PARTITION BY ga ORDER BY x.degree + y.degree DESC, a, b) AS position
FROM placed JOIN deg x ON a = x.asn JOIN deg y ON b = y.asn WHERE ga = gb) WHERE position <= 1500""")
def q19(spark, sf_dir):
    e = views.edges(spark, sf_dir)
    out = topo.top_links(e, topo.degrees(topo.adjacency(e)), views.membership(spark, sf_dir))
    return out.select("grp", "a", "b", *big("rel"), "weight", *big("position"))


@query("q20_members", f"""WITH {EDGES}, {GROUPS}, {ORGS} SELECT m.asn, grp, coalesce(info.name, 'AS' || m.asn) AS name, coalesce(orgs.name, 'Unknown organization') AS organization, coalesce(country, '') AS country, coalesce(degree, 0) AS degree
FROM m LEFT JOIN deg ON m.asn = deg.asn LEFT JOIN info ON m.asn = info.asn LEFT JOIN orgs ON info.org_id = orgs.org_id""")
def q20(spark, sf_dir):
    d = topo.degrees(topo.adjacency(views.edges(spark, sf_dir)))
    return topo.members(views.membership(spark, sf_dir), d, views.as_info(spark, sf_dir), views.organizations(spark, sf_dir))


@query("q20_group_sizes", f"WITH {EDGES}, {GROUPS}, {ORGS} SELECT grp, count(*) AS asns, count(DISTINCT coalesce(org_id, 'unknown-AS' || m.asn)) AS organizations FROM m LEFT JOIN info ON m.asn = info.asn GROUP BY grp")
def q20_sizes(spark, sf_dir):
    return topo.group_sizes(views.membership(spark, sf_dir), views.as_info(spark, sf_dir).select("asn", "org_id"))


INDEX = f"{EDGES}, {GROUPS}, {ORGS}, {TILES}, idx AS (SELECT t.asn, t.grp, t.tile, coalesce(info.name, 'AS' || t.asn) AS name, coalesce(degree, 0) AS degree FROM t LEFT JOIN info ON t.asn = info.asn LEFT JOIN deg ON t.asn = deg.asn)"


def index(spark, sf_dir):
    d = topo.degrees(topo.adjacency(views.edges(spark, sf_dir)))
    info = views.as_info(spark, sf_dir).select("asn", "name")
    return tiled(spark, sf_dir).join(info, "asn", "left").join(d, "asn", "left").select("asn", "grp", "tile", F.coalesce("name", F.concat(F.lit("AS"), F.col("asn"))).alias("name"), F.coalesce("degree", F.lit(0)).alias("degree"))


@query("q21_search", f"WITH {INDEX} SELECT * FROM (SELECT 'name' AS kind, * FROM idx WHERE contains(lower(name), 'supplier') ORDER BY asn LIMIT 20) UNION ALL SELECT 'number', * FROM idx WHERE CAST(asn AS VARCHAR) = '7'")
def q21(spark, sf_dir):
    i = index(spark, sf_dir)
    kinds = (("name", " SUPPLIER "), ("number", "as7"), ("none", "AS007"))
    parts = [explorer.search(i, q).select(F.lit(k).alias("kind"), "*") for k, q in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("q22_as_scene", f"WITH {INDEX} SELECT nbr, role, name, degree, grp FROM adj JOIN idx ON nbr = idx.asn WHERE adj.asn = 1")
def q22(spark, sf_dir):
    adj = topo.adjacency(views.edges(spark, sf_dir)).withColumn("bucket", topo.bucket(F.col("asn")))
    return explorer.neighbours(adj, index(spark, sf_dir), 1)


@query("q23_spiral_layout", """WITH s AS (SELECT s_suppkey AS id, s_nationkey AS scene, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i FROM supplier),
p AS (SELECT id, scene, cos(i * 2.399963) * sqrt(i + 1) * 100 AS x, sin(i * 2.399963) * sqrt(i + 1) * 100 AS y FROM s),
b AS (SELECT scene, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p GROUP BY scene)
SELECT id, round((x - (x0 + x1) / 2) / greatest(x1 - x0, y1 - y0, 1.0) * 840, 4) + 0.0 AS x, round((y - (y0 + y1) / 2) / greatest(x1 - x0, y1 - y0, 1.0) * 680, 4) + 0.0 AS y FROM p JOIN b ON p.scene = b.scene""")
def q23(spark, sf_dir):
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("scene"), i.alias("i"))
    x, y = layout.world_spiral(F.col("i"))
    out = layout.normalise(s.select("id", "scene", x.alias("x"), y.alias("y")), "scene")
    return out.select("id", (F.round("x", 4) + 0.0).alias("x"), (F.round("y", 4) + 0.0).alias("y"))


@query("q24_buckets", f"WITH {EDGES} SELECT asn % 256 AS bucket, count(DISTINCT asn) AS asns, count(*) AS neighbours FROM adj GROUP BY 1")
def q24(spark, sf_dir):
    adj = topo.adjacency(views.edges(spark, sf_dir))
    return adj.groupBy(topo.bucket(F.col("asn")).cast("bigint").alias("bucket")).agg(F.countDistinct("asn").alias("asns"), F.count("*").alias("neighbours"))


@query("q24_adjacency_documents", f"""WITH {EDGES}, o AS (SELECT adj.asn, nbr, role, row_number() OVER (PARTITION BY adj.asn ORDER BY d.degree DESC, nbr) AS p FROM adj JOIN deg d ON nbr = d.asn)
SELECT asn % 256 AS bucket, asn, '{{"neighbors":[' || string_agg('["' || nbr || '","' || role || '"]', ',' ORDER BY p) || ']}}' AS json FROM o GROUP BY asn""")
def q24_documents(spark, sf_dir):
    adj = topo.adjacency(views.edges(spark, sf_dir))
    return publish.sharded_adjacency(topo.ordered_neighbours(adj, topo.degrees(adj))).select(*big("bucket"), "asn", "json")


@query("q25_snapshot_names", """WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '2026-02-30' WHEN o_orderkey % 11 = 0 THEN 'x' ELSE strftime(o_orderdate + INTERVAL 10 YEAR, '%Y-%m-%d') END AS text FROM orders),
v AS (SELECT o_orderkey, text, CASE WHEN TRY_CAST(text AS DATE) BETWEEN DATE '2000-01-01' AND DATE '2007-06-30' THEN TRY_CAST(text AS DATE) END AS day FROM d)
SELECT o_orderkey, text, strftime(day, '%Y%m%dT000000Z') AS snapshot_id, 'rib.' || strftime(day, '%Y%m%d') || '.0000.bz2' AS file, strftime(day, '%Y.%m/RIBS/') || 'rib.' || strftime(day, '%Y%m%d') || '.0000.bz2' AS path FROM v""")
def q25(spark, sf_dir):
    text = F.expr("CASE WHEN o_orderkey % 9 = 0 THEN '2026-02-30' WHEN o_orderkey % 11 = 0 THEN 'x' ELSE date_format(o_orderdate + INTERVAL 10 YEAR, 'yyyy-MM-dd') END")
    day = dates.valid_date(F.col("text"), F.lit("2007-06-30 12:00:00").cast("timestamp"))
    t = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")).withColumn("day", day)
    return t.select("o_orderkey", "text", dates.snapshot_id(F.col("day")).alias("snapshot_id"), dates.snapshot_file(F.col("day")).alias("file"), dates.snapshot_path(F.col("day")).alias("path"))


@query("q26_shared_observers", "SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE event_id % 2 = 0 AND (user_id, event_type) IN (SELECT (user_id, event_type) FROM events WHERE event_id % 2 = 1) GROUP BY ALL")
def q26(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return routing.shared_observers(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")


@query("q27_manifest", f"""WITH {EDGES}, {GROUPS}, {TILES}, s AS (SELECT tile, count(*) AS n FROM t GROUP BY tile)
SELECT count(*) AS links, count(*) FILTER (rel = 0) AS peer_links, count(*) FILTER (rel = -1) AS provider_customer_links, count(*) FILTER (ga = gb) AS within, count(*) FILTER (ga <> gb) AS between,
  (SELECT count(*) FROM s) AS tiles, (SELECT min(n) FROM s) AS smallest, (SELECT max(n) FROM s) AS largest, (SELECT round(avg(n), 6) FROM s) AS mean, (SELECT CAST(sum(n) AS BIGINT) FROM s) AS nodes, count(*) FILTER (ga = gb AND x.tile = y.tile) AS within_tiles, count(*) FILTER (ga = gb AND x.tile <> y.tile) AS between_tiles,
  true AS sound FROM placed LEFT JOIN t x ON a = x.asn LEFT JOIN t y ON b = y.asn""")
def q27(spark, sf_dir):
    placed = topo.with_groups(views.edges(spark, sf_dir), views.membership(spark, sf_dir))
    return topo.manifest(placed, tiled(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query("q28_merge_step", f"""WITH {EDGES}, {GROUPS}, s AS (SELECT grp, count(*) AS size, min(asn) AS low FROM m GROUP BY grp), x AS (SELECT grp FROM s ORDER BY size, low LIMIT 1),
p AS (SELECT CASE WHEN ga = x.grp THEN gb ELSE ga END AS target, count(*) AS n FROM placed, x WHERE ga <> gb AND (ga = x.grp OR gb = x.grp) GROUP BY 1)
SELECT x.grp AS source, target FROM p JOIN s ON target = s.grp, x ORDER BY n DESC, size DESC, low LIMIT 1""")
def q28(spark, sf_dir):
    return graph.merge_step(views.edges(spark, sf_dir), views.membership(spark, sf_dir))


@query("q28_merge_communities", f"""WITH RECURSIVE {EDGES}, f AS (SELECT s_suppkey AS asn, s_nationkey AS c FROM supplier UNION ALL SELECT 100000 + p_partkey, 25 + p_size FROM part),
sizes AS (SELECT c, count(*) AS size, min(asn) AS low FROM f GROUP BY c),
pairs AS (SELECT c1, c2, count(*) AS n FROM (SELECT x.c AS c1, y.c AS c2 FROM edges JOIN f x ON a = x.asn JOIN f y ON b = y.asn UNION ALL SELECT y.c, x.c FROM edges JOIN f x ON a = x.asn JOIN f y ON b = y.asn) GROUP BY ALL),
merged(step, c, cur) AS (SELECT 0, c, c FROM sizes UNION ALL
  SELECT step, c, CASE WHEN cur = small THEN target ELSE cur END FROM (
    SELECT s.step + 1 AS step, s.c, s.cur, t.small, t.target FROM merged s, (
      SELECT k.small, arg_max(o.cur, (o.n, o.size, -o.low)) AS target FROM
        (SELECT arg_min(cur, (size, low)) AS small, count(*) AS left_ FROM (SELECT cur, sum(size) AS size, min(low) AS low FROM merged JOIN sizes ON merged.c = sizes.c GROUP BY cur)) k,
        (SELECT g.cur, e.from_, e.n, g.size, g.low FROM (SELECT cur, sum(size) AS size, min(low) AS low FROM merged JOIN sizes ON merged.c = sizes.c GROUP BY cur) g JOIN
          (SELECT x.cur AS from_, y.cur AS to_, sum(p.n) AS n FROM pairs p JOIN merged x ON p.c1 = x.c JOIN merged y ON p.c2 = y.c WHERE x.cur <> y.cur GROUP BY x.cur, y.cur) e ON g.cur = e.to_) o
      WHERE o.from_ = k.small AND k.left_ > 20 GROUP BY k.small) t)),
done AS (SELECT c, cur FROM merged WHERE step = (SELECT max(step) FROM merged))
SELECT asn, CAST(cur AS BIGINT) AS grp FROM f JOIN done ON f.c = done.c""")
def q28_merge(spark, sf_dir):
    """Communities by nation and by size, merged until 20 are left."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("asn"), F.col("s_nationkey").cast("bigint").alias("grp"))
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") + 100000).alias("asn"), (F.col("p_size") + 25).cast("bigint").alias("grp"))
    return graph.merge_communities(views.edges(spark, sf_dir), s.unionByName(p), 20)


@query("q28_label_propagation")
def q28_labels(spark, sf_dir):
    e = views.edges(spark, sf_dir)
    return graph.propagate_communities(topo.adjacency(e).select("asn").distinct(), e)


def topology_build(spark, sf_dir):
    from netloom.plans.build import build_topology

    m = views.membership(spark, sf_dir)
    return build_topology(views.edge_rows(spark, sf_dir), m, views.as_info(spark, sf_dir), views.organizations(spark, sf_dir))


@query("q28_modularity_communities")
def q28_modularity(spark, sf_dir):
    """Communities by modularity of all nodes, checked against a search that moves one node at a time (tests)."""
    return graph.modularity_communities(views.membership(spark, sf_dir), views.edges(spark, sf_dir))


@query("q30_tile_documents", f"""{ORDER}, {ORGS}, o AS (SELECT asn, grp, position AS pos, count(*) OVER (PARTITION BY grp) AS n FROM bfs),
b AS (SELECT *, n // CAST(ceil(n / 240.0) AS BIGINT) AS base, n % CAST(ceil(n / 240.0) AS BIGINT) AS rest FROM o),
t AS (SELECT asn, grp, grp || '-c' || format('{{:03d}}', 1 + CASE WHEN pos < rest * (base + 1) THEN pos // (base + 1) ELSE rest + (pos - rest * (base + 1)) // base END) AS tile FROM b),
e AS (SELECT x.tile AS ta, y.tile AS tb, a, b, rel FROM edges JOIN t x ON a = x.asn JOIN t y ON b = y.asn),
w AS (SELECT a AS x, b AS y FROM e WHERE ta = tb UNION SELECT b, a FROM e WHERE ta = tb), reach(asn, low) AS (SELECT asn, asn FROM t UNION SELECT w.y, reach.low FROM reach JOIN w ON reach.asn = w.x),
parts AS (SELECT tile, count(DISTINCT low) AS parts FROM (SELECT asn, min(low) AS low FROM reach GROUP BY asn) p JOIN t ON p.asn = t.asn GROUP BY tile),
ext AS (SELECT tile, count(*) AS external FROM (SELECT ta AS tile FROM e WHERE ta <> tb UNION ALL SELECT tb FROM e WHERE ta <> tb) GROUP BY tile),
k AS (SELECT t.tile, t.asn, coalesce(info.name, 'AS' || t.asn) AS name, coalesce(degree, 0) AS degree FROM t LEFT JOIN info ON t.asn = info.asn LEFT JOIN deg ON t.asn = deg.asn),
nodes AS (SELECT tile, count(*) AS count, string_agg(asn || ':' || degree, ',' ORDER BY degree DESC, asn) AS nodes, arg_min(asn, (-degree, asn)) AS seed, arg_min(name, (-degree, asn)) AS label FROM k GROUP BY tile),
links AS (SELECT ta AS tile, string_agg(a || CASE WHEN rel = 0 THEN '=' ELSE '>' END || b, ',' ORDER BY a, b) AS links FROM e WHERE ta = tb GROUP BY ta)
SELECT nodes.tile AS id, left(nodes.tile, 3) AS parent, label, count, seed AS seed_asn, 'bfs-tile' AS partition, parts AS connected_components, coalesce(external, 0) AS external_links, nodes, coalesce(links, '') AS links
FROM nodes JOIN parts ON nodes.tile = parts.tile LEFT JOIN ext ON nodes.tile = ext.tile LEFT JOIN links ON nodes.tile = links.tile""")
def q30(spark, sf_dir):
    """The tile documents, read back; all but the coordinates, which follow from a random start."""
    d = topology_build(spark, sf_dir)["tile"].select(F.from_json("json", ASSETS["tile"]).alias("d")).select("d.*")
    nodes = F.array_join(F.transform("nodes", lambda n: F.concat(n["asn"], F.lit(":"), n["degree"])), ",")
    links = F.array_join(F.transform("links", lambda e: F.concat(e["source"], F.when(e["relationship"] == "peer", "=").otherwise(">"), e["target"])), ",")
    return d.select("id", "parent", "label", "count", F.col("seedAsn").alias("seed_asn"), "partition", F.col("connectedComponents").alias("connected_components"), F.col("externalLinkCount").alias("external_links"), nodes.alias("nodes"), links.alias("links"))


@query("q30_overview_document", f"""WITH {EDGES}, {GROUPS}, {ORGS}, d AS (SELECT m.asn, grp, coalesce(degree, 0) AS degree FROM m LEFT JOIN deg ON m.asn = deg.asn),
x AS (SELECT *, count(*) OVER (PARTITION BY grp) AS n, row_number() OVER (PARTITION BY grp ORDER BY degree DESC, asn) AS r FROM d),
g AS (SELECT grp, n, x.asn AS seed, coalesce(orgs.name, info.name, 'AS' || x.asn) AS label, coalesce(country, '') AS country FROM x LEFT JOIN info ON info.asn = x.asn LEFT JOIN orgs ON orgs.org_id = info.org_id WHERE r = 1),
p AS (SELECT least(ga, gb) AS s, greatest(ga, gb) AS t, count(*) AS n, count(*) FILTER (rel = 0) AS peers FROM placed WHERE ga <> gb GROUP BY ALL)
SELECT (SELECT count(*) FROM m) AS networks, count(*) AS links, count(*) FILTER (ga = gb) AS within, (SELECT count(*) FROM rows_) AS raw, (SELECT count(*) FROM g) AS n_groups,
  (SELECT count(DISTINCT coalesce(org_id, 'unknown-AS' || m.asn)) FROM m LEFT JOIN info ON info.asn = m.asn) AS organizations,
  (SELECT string_agg(grp || ':' || label || ':' || seed || ':' || n || ':' || country, ';' ORDER BY grp) FROM g) AS groups,
  (SELECT string_agg(s || '-' || t || ':' || n || ':' || peers, ';' ORDER BY s, t) FROM p) AS pairs FROM placed""")
def q30_overview(spark, sf_dir):
    """The overview, read back: counts of its metadata, its groups and the links between them."""
    d = topology_build(spark, sf_dir)["overview"].select(F.from_json("json", ASSETS["overview"]).alias("d")).select("d.*")
    counts = {"networks": "totalAS", "links": "totalLinks", "within": "withinGroupLinks", "raw": "rawRelationshipRows", "n_groups": "groupCount", "organizations": "totalOrganizations"}
    text = lambda c, *parts: F.array_join(F.transform(c, lambda e: F.concat(*[F.lit(p) if len(p) == 1 else e[p].cast("string") for p in parts])), ";")
    groups = text("groups", "id", ":", "label", ":", "seedAsn", ":", "asnCount", ":", "country")
    pairs = text("links", "source", "-", "target", ":", "count", ":", "peerCount")
    return d.select(*[F.col("meta")[v].cast("bigint").alias(k) for k, v in counts.items()], groups.alias("groups"), pairs.alias("pairs"))


@query("q31_distance_maps", f"""{DISTANCES}, h AS (SELECT distance, count(*) AS n FROM f GROUP BY distance) SELECT 'g01' AS grp, '{{' || string_agg('"' || distance || '":' || n, ',' ORDER BY distance) || '}}' AS distances FROM h""")
def q31(spark, sf_dir):
    return topo.distance_histogram(distances(spark, sf_dir)).select("grp", F.to_json("distances").alias("distances"))


@query("q32_organization_neighbours", f"WITH {EDGES}, {ORGS} SELECT DISTINCT x.org_id, nbr FROM adj JOIN info x ON adj.asn = x.asn JOIN info y ON nbr = y.asn WHERE x.org_id <> y.org_id")
def q32(spark, sf_dir):
    return topo.external_organization_neighbours(topo.adjacency(views.edges(spark, sf_dir)), views.as_info(spark, sf_dir))


#: The sample dump's sessions (flags, address, number; the first is not among the default ones) and its routes: subtype,
#: session, prefix length, prefix bytes, and the segments of the path as (kind, numbers), None for a route without one.
SESSIONS = [(2, "c6336407", 64511), (3, "200107fa0000000100000000ca28a0f4", 3491), (2, "7bff5af4", 3491)]
SAMPLE = [
    (2, 2, 10, "6440", [(2, [3491, 7018])]), (2, 2, 24, "cb0071", [(2, [3491, 2914, 2914, 64499])]), (2, 0, 24, "cb0071", [(2, [64511, 64499])]), (2, 2, 26, "cb007140", [(1, [64499, 64502])]),
    (2, 2, 32, "c6336407", [(2, [3491]), (2, [64500])]), (4, 1, 42, "20010db80040", [(2, [3491, 6939, 64501])]), (2, 2, 0, "", [(2, [3491, 1299])]), (2, 2, 23, "c00002", [(2, [3491, 6453])]), (2, 2, 23, "c00002", [(2, [3491, 3257])]), (2, 2, 16, "ac1f", None),
]
OBSERVED = 1782864000


def sample_dump() -> bytes:
    """A small table dump: two sessions that are read and one that is not, nested, masking, conflicting and missing paths,
    and a multicast record, which is skipped."""
    number = lambda n, size: n.to_bytes(size, "big")
    rec = lambda sub, body: number(OBSERVED, 4) + number(13, 2) + number(sub, 2) + number(len(body), 4) + body
    table_ = b"".join(bytes([flags]) + bytes(4) + bytes.fromhex(addr) + number(asn, 4) for flags, addr, asn in SESSIONS)
    out = rec(1, bytes(4) + number(0, 2) + number(len(SESSIONS), 2) + table_) + rec(3, b"multicast")
    for sub, session, bits, prefix, path in SAMPLE:
        value = b"".join(bytes([kind, len(asns)]) + b"".join(number(a, 4) for a in asns) for kind, asns in path or [])
        attrs = b"" if path is None else b"\x50\x02" + number(len(value), 2) + value
        out += rec(sub, bytes(4) + bytes([bits]) + bytes.fromhex(prefix) + number(1, 2) + number(session, 2) + bytes(4) + number(len(attrs), 2) + attrs)
    return out


V4_ID, V6_ID = "3491@123.255.90.244", "3491@2001:7fa:0:1::ca28:a0f4"


@query("q29_mrt_scan", f"""SELECT f.file, r.* FROM (VALUES ('raw'), ('gz'), ('bz2')) f(file), (VALUES
  ('{V4_ID}', 4, 10, '64400000', '3491,7018'), ('{V4_ID}', 4, 24, 'cb007100', '3491,2914,2914,64499'), ('{V4_ID}', 4, 26, 'cb007140', NULL), ('{V4_ID}', 4, 32, 'c6336407', '3491,64500'),
  ('{V6_ID}', 6, 42, '20010db8004000000000000000000000', '3491,6939,64501'), ('{V4_ID}', 4, 0, '00000000', '3491,1299'), ('{V4_ID}', 4, 23, 'c0000200', '3491,6453'),
  ('{V4_ID}', 4, 23, 'c0000200', '3491,3257'), ('{V4_ID}', 4, 16, 'ac1f0000', NULL)) r(peer_id, family, prefix_len, prefix_key, path)""")
def q29(spark, sf_dir):
    """The same dump raw, as gzip and as bzip2, written to the shared folder through Spark's file system and scanned."""
    from netloom.session import own_folder, ship
    from netloom.sources.mrt import MrtDataSource

    ship(spark).dataSource.register(MrtDataSource)
    root = own_folder(spark, "netloom-mrt").removeprefix("file:")
    root = root if "://" in root else f"/{root.lstrip('/')}"
    data = sample_dump()
    for name, body in (("raw", data), ("gz", gzip.compress(data)), ("bz2", bz2.compress(data))):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(body))
        out.close()
    read = spark.read.format("mrt").option("path", root).load()
    return read.select(F.element_at(F.split("file", "/"), -1).alias("file"), "peer_id", *[F.col(c).cast("int").alias(c) for c in ("family", "prefix_len")], "prefix_key", joined(F.col("path")).alias("path"))

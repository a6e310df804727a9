"""The catalogue's second part: text sources, single rules, drawing, and the engine, each checked by SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from netloom.functions import dates, ip as ipf, paths as pf
from netloom.operators import explorer, graph, layout, routing
from netloom.operators import topology as topo
from netloom.plans import views
from netloom.plans.catalog import big, joined, query
from netloom.plans.snapshot import build_snapshot
from netloom.plans.views import EDGES, GROUPS, ORGS, PROBES, RAW, SHOWN, V4, table
from netloom.session import own_folder
from netloom.sources import topology as text


def written(lines, name, codec):
    """Lines (n, line) as one compressed text file in the shared folder, read back in file order."""
    path = own_folder(lines.sparkSession, name) + "/t"
    lines.coalesce(1).sortWithinPartitions("n").select("line").write.option("compression", codec).text(path)
    return text.read_lines(lines.sparkSession, path)


def relationship_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").selectExpr("10 + s_suppkey AS n", "concat(s_suppkey, '|', s_suppkey + 1 + s_nationkey, '|', -(s_suppkey % 2), if(s_suppkey % 5 = 0, '|bgp', '')) AS line")
    head = spark.createDataFrame([(0, "# input clique: 174 3356  174 1299"), (1, "# source:topology|BGP|20260903|x"), (2, ""), (3, "# source:topology|BGP|20260901|y"), (4, "  ")], "n bigint, line string")
    return written(head.unionByName(rows), "netloom-rel", "bzip2")


@query("q34_relationship_text", "SELECT s_suppkey AS a, s_suppkey + 1 + s_nationkey AS b, CAST(-(s_suppkey % 2) AS BIGINT) AS rel FROM supplier")
def q34(spark, sf_dir):
    return text.edges(relationship_lines(spark, sf_dir)).select("a", "b", *big("rel"))


@query("q34_text_headers", "SELECT 'clique' AS kind, '174,1299,3356' AS items UNION ALL SELECT 'dates', '20260901,20260903'")
def q34_headers(spark, sf_dir):
    lines = relationship_lines(spark, sf_dir)
    both = text.clique(lines).select(F.lit("clique").alias("kind"), F.col("asn").cast("string").alias("x")).union(text.observation_dates(lines).select(F.lit("dates"), "date"))
    return both.groupBy("kind").agg(F.transform(F.array_sort(F.collect_set(F.col("x").cast("bigint"))), lambda v: v.cast("string")).alias("x")).select("kind", F.array_join("x", ",").alias("items"))


@query("q34_organization_text", """SELECT 'org' AS kind, 'O' || n_nationkey AS id, n_name AS name, 'C' || n_regionkey AS more FROM nation
UNION ALL SELECT 'as', CAST(s_suppkey AS VARCHAR), s_name, 'O' || s_nationkey FROM supplier""")
def q34_organizations(spark, sf_dir):
    head = spark.createDataFrame([(0, "# name: x"), (1, "# format:org_id|changed|name|country|source"), (1 << 40, "# format:aut|changed|aut_name|org_id|opaque_id|source"), ((1 << 40) + 1, "# other")], "n bigint, line string")
    orgs = table(spark, sf_dir, "nation").selectExpr("CAST(100 + n_nationkey AS bigint) AS n", "concat('O', n_nationkey, '|2026|', n_name, '|C', n_regionkey, '|S') AS line")
    ases = table(spark, sf_dir, "supplier").selectExpr("s_suppkey + 2 + shiftleft(1L, 40) AS n", "concat(s_suppkey, '|2026|', s_name, '|O', s_nationkey, '||S') AS line")
    o, a = text.organizations(written(head.unionByName(orgs).unionByName(ases), "netloom-org", "gzip"))
    return o.select(F.lit("org").alias("kind"), F.col("org_id").alias("id"), "name", F.col("country").alias("more")).union(a.select(F.lit("as"), F.col("asn").cast("string"), "name", "org_id"))


@query("q35_newest_file", "SELECT max(strftime(o_orderdate, '%Y%m%d')) || '.as-rel.txt.bz2' AS name FROM orders WHERE o_orderdate < DATE '1997-06-16'")
def q35(spark, sf_dir):
    page = F.concat(F.lit('<a href="'), F.date_format("o_orderdate", "yyyyMMdd"), F.lit('.as-rel.txt.bz2">x</a> <a href="readme.txt">')).alias("page")
    return text.newest(table(spark, sf_dir, "orders").select(page), "page", r"(\d{8})\.as-rel\.txt\.bz2", F.lit("1997-06-15").cast("date"))


@query("q33_path_attributes", """WITH e AS (SELECT event_id, [3491, CASE WHEN event_id % 3 = 0 THEN 23456 ELSE event_id % 50 END] AS p, CASE WHEN event_id % 4 <> 0 THEN CASE WHEN event_id % 8 = 1 THEN [7, 8, 9] ELSE [event_id + 70000] END END AS q,
  event_id % 7 = 0 AS has, CASE WHEN event_id % 2 = 0 THEN 23456 ELSE 3491 END AS agg, event_id % 11 = 0 AS odd, event_id % 13 = 0 AS missing FROM events),
m AS (SELECT event_id, CASE WHEN missing OR odd THEN NULL WHEN list_contains(p, 23456) AND q IS NOT NULL AND NOT (has AND agg <> 23456) AND len(q) <= len(p) THEN p[1:len(p) - len(q)] || q ELSE p END AS p FROM e)
SELECT event_id, CASE WHEN NOT list_contains(p, 0) AND NOT list_contains(p, 23456) THEN array_to_string(p, ',') END AS path FROM m""")
def q33(spark, sf_dir):
    """Segments to one path; 4-byte numbers for placeholders; what cannot be shown is null."""
    e = table(spark, sf_dir, "events").selectExpr(
        "event_id", "if(event_id % 13 = 0, NULL, array(named_struct('kind', 2, 'asns', array(3491L)), named_struct('kind', if(event_id % 11 = 0, 1, 2), 'asns', array(if(event_id % 3 = 0, 23456L, event_id % 50))))) AS segments",
        "CASE WHEN event_id % 4 <> 0 THEN if(event_id % 8 = 1, array(7L, 8L, 9L), array(event_id + 70000)) END AS as4", "event_id % 7 = 0 AS has", "if(event_id % 2 = 0, 23456L, 3491L) AS agg")
    path = pf.valid(pf.merge_as4(pf.linear(F.col("segments")), F.col("as4"), F.col("agg"), F.col("has")))
    return e.select("event_id", joined(path).alias("path"))


@query("q33_path_keys", "SELECT count(DISTINCT [3491, user_id % 5, user_id % 5]) AS paths, min('3491,' || (user_id % 5) || ',' || (user_id % 5)) AS first FROM events")
def q33_keys(spark, sf_dir):
    key = pf.path_key(F.expr("array(3491L, user_id % 5, user_id % 5)"))
    return table(spark, sf_dir, "events").agg(F.countDistinct(key).alias("paths"), F.min(key).alias("first"))


@query("q37_selected_entries", "SELECT event_id, 'P' || (event_id % 4) AS peer_id FROM events WHERE event_id % 4 IN (1, 3)")
def q37(spark, sf_dir):
    """Entries name their session by index; listed sessions are kept."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 4).cast("int").alias("peer_index"))
    peers = spark.createDataFrame([(i, f"P{i}") for i in range(4)], "peer_index int, peer_id string")
    return routing.select_peers(routing.attach_peers(e, peers), peers.where("peer_index % 2 = 1")).select("event_id", "peer_id")


@query("q39_compare_addresses", f"""WITH {RAW}, {PROBES}, x AS (SELECT p.probe_id, p.peer_id, p.ip, CASE WHEN p.kind = 'bad' THEN 'invalid_ip' WHEN p.peer_id = 'P5' THEN 'unknown_peer' WHEN p.kind = 'v6' THEN 'missing_family'
  WHEN b.probe_id IS NULL THEN 'not_observed' WHEN b.path IS NULL THEN 'unsupported_path' ELSE 'ok' END AS status, string_split({SHOWN.format('b.path')}, ',') AS path FROM probes p LEFT JOIN best b ON p.probe_id = b.probe_id),
pr AS (SELECT a.probe_id AS pair_id, a.status AS status_a, b.status AS status_b, a.path AS pa, b.path AS pb FROM x a JOIN x b ON b.probe_id = a.probe_id + 6),
k AS (SELECT *, CASE WHEN pa IS NOT NULL AND pb IS NOT NULL THEN coalesce(list_min([i FOR i IN range(1, least(len(pa), len(pb)) + 1) IF pa[i] <> pb[i]]) - 1, least(len(pa), len(pb))) END AS k FROM pr)
SELECT pair_id, status_a, status_b, array_to_string(pa[1:k], ',') AS trunk, CASE WHEN k IS NULL THEN NULL WHEN len(pa) = k AND len(pb) = k THEN 'same' WHEN k > 0 AND (len(pa) = k OR len(pb) = k) THEN 'one_ends' WHEN k > 0 THEN 'shared_then_split' ELSE 'disjoint' END AS relation FROM k""")
def q39(spark, sf_dir):
    p = views.probes(spark, sf_dir)
    pairs = p.select(F.col("probe_id").alias("pair_id"), "peer_id", F.col("ip").alias("ip_a")).join(p.select((F.col("probe_id") - 6).alias("pair_id"), F.col("ip").alias("ip_b")), "pair_id")
    out = routing.compare(pairs, routing.merge_routes(views.raw_routes(spark, sf_dir)))
    return out.select("pair_id", "status_a", "status_b", joined(F.col("trunk")).alias("trunk"), "relation")


@query("q39_picked_observer", "SELECT event_type, user_id, event_id FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 1")
def q39_observer(spark, sf_dir):
    return routing.pick_observer(table(spark, sf_dir, "events").select("event_type", "user_id", "event_id"), {"event_type": "click"}, "event_id")


@query("q40_instants", """SELECT event_id, strftime(ts - INTERVAL 1 DAY, '%Y-%m-%d') AS day_before, 'local-' || CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS local_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S.000Z') AS iso, strftime(ts, '%Y-%m-%d %H:%M UTC') AS minute,
  'https://archive.routeviews.org/hkix.hkg/bgpdata/' || strftime(ts, '%Y.%m/RIBS/rib.%Y%m%d.0000.bz2') AS url FROM events""")
def q40(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("s", F.date_trunc("second", "ts"))
    return e.select("event_id", dates.default_date(F.col("ts")).cast("string").alias("day_before"), dates.local_id(F.col("s")).alias("local_id"), dates.iso(F.col("s")).alias("iso"), dates.iso_minute(F.col("ts")).alias("minute"), dates.snapshot_url(F.to_date("ts")).alias("url"))


@query("q41_ipv6_forms", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN format('{:04x}', a) || repeat('0', 24) || format('{:04x}', b) WHEN 1 THEN repeat('0', 20) || 'ffff' || format('{:02x}{:02x}0a01', a % 256, b % 256)
  WHEN 2 THEN repeat('0', 28) || format('{:04x}', b) WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE repeat(format('{:04x}', a), 7) || repeat('0', 4) END AS addr FROM (SELECT event_id, event_id * 7 % 65536 AS a, event_id * 13 % 65536 AS b FROM events)""")
def q41(spark, sf_dir):
    """Shortened texts, an IPv4 tail, upper case and blanks; a zone, two gaps and nine groups are refused."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", "lower(hex(event_id * 7 % 65536)) AS a", "hex(event_id * 13 % 65536) AS b", "event_id * 7 % 65536 % 256 AS x", "event_id * 13 % 65536 % 256 AS y")
    t = F.expr("CASE event_id % 6 WHEN 0 THEN concat(' ', a, '::', b, '\\t') WHEN 1 THEN concat('::ffff:', x, '.', y, '.10.1') WHEN 2 THEN concat('0::', b) WHEN 3 THEN concat(a, '::', b, '::1') WHEN 4 THEN concat('fe80::', a, '%eth0') ELSE concat(array_join(array_repeat(a, 7), ':'), '::') END")
    return e.select("event_id", ipf.parse_ip(t)["addr"].alias("addr"))


@query("q41_bytes", "SELECT event_id, event_id * 2246822519 % 4294967296 AS value FROM events")
def q41_bytes(spark, sf_dir):
    raw = F.unhex(F.lpad(F.hex(F.expr("event_id * 2246822519 % 4294967296")), 8, "0"))
    return table(spark, sf_dir, "events").select("event_id", ipf.bytes_value(raw).alias("value"))


@query("q42_group_ranks", "SELECT grp, count(*) AS size, 'g' || format('{:02d}', row_number() OVER (ORDER BY count(*) DESC, min(asn))) AS gid FROM (SELECT 's' || s_nationkey AS grp, s_suppkey AS asn FROM supplier UNION ALL SELECT 'p' || p_size, 100000 + p_partkey FROM part) GROUP BY grp")
def q42(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_nationkey").alias("grp"), F.col("s_suppkey").alias("asn"))
    return topo.rank_groups(s.unionByName(table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_size").alias("grp"), (F.col("p_partkey") + 100000).alias("asn"))))


@query("q42_not_connected", f"""WITH RECURSIVE {EDGES}, {GROUPS}, s AS (SELECT grp, min(asn) AS asn FROM m GROUP BY grp), i AS (SELECT a AS x, b AS y FROM placed WHERE ga = gb UNION SELECT b, a FROM placed WHERE ga = gb),
r(asn) AS (SELECT asn FROM s UNION SELECT i.y FROM r JOIN i ON r.asn = i.x) SELECT grp, asn FROM m WHERE asn NOT IN (SELECT asn FROM r)""")
def q42_connected(spark, sf_dir):
    """Members that their group's lowest network does not reach along links within the group."""
    m = views.membership(spark, sf_dir)
    inner = topo.with_groups(views.edges(spark, sf_dir), m).where("ga = gb")
    starts = m.groupBy("grp").agg(F.min("asn").alias("asn"))
    return graph.not_connected(starts, m, topo.adjacency(inner.select("a", "b", "rel")).join(m, "asn").select("grp", "asn", "nbr"))


@query("q42_coverage", f"WITH {EDGES}, {GROUPS} SELECT 'all' AS kind, true AS equal UNION ALL SELECT 'linked', (SELECT count(*) FROM m) = (SELECT count(*) FROM deg)")
def q42_coverage(spark, sf_dir):
    """Known edges keep their number; groups cover all networks, and whether all of them have links."""
    m, e = views.membership(spark, sf_dir), topo.known_edges(views.edges(spark, sf_dir), views.membership(spark, sf_dir))
    return topo.same_nodes(m, views.membership(spark, sf_dir)).select(F.lit("all").alias("kind"), "equal").union(topo.same_nodes(m, topo.degrees(topo.adjacency(e))).select(F.lit("linked"), "equal"))


@query("q43_families", """WITH e AS (SELECT 'P' || (event_id % 3) AS peer_id, event_id AS seq, CASE WHEN (event_id + CASE WHEN event_id % 3 = 1 THEN 3 ELSE 0 END) % 6 < 3 THEN 4 ELSE 6 END AS family FROM events),
f AS (SELECT peer_id, family, count(*) AS n, min(seq) AS seen FROM e GROUP BY ALL) SELECT peer_id, string_agg(family, ',' ORDER BY seen) AS families, min(seen) AS first_seq, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY peer_id""")
def q43(spark, sf_dir):
    """Families in the order in which a session's routes show them."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("P"), F.col("event_id") % 3).alias("peer_id"), F.col("event_id").alias("seq"), F.expr("if((event_id + if(event_id % 3 = 1, 3, 0)) % 6 < 3, 4, 6)").alias("family"))
    counts = routing.prefix_counts(e, "seq")
    first = counts.groupBy("peer_id").agg(F.min("seen").alias("first_seq"), F.sum("n").alias("n"))
    return routing.peer_metadata(counts, first).select("peer_id", joined(F.col("families")).alias("families"), "first_seq", "n")


SCENE = "scene AS (SELECT s_suppkey AS id, s_suppkey AS asn, 'AS' || s_suppkey AS label, s_name AS sub, s_acctbal AS x, s_suppkey * 7.0 AS y, s_nationkey AS scene, CAST(1 + s_suppkey % 40 AS BIGINT) AS count FROM supplier)"


def scene(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_suppkey AS asn", "concat('AS', s_suppkey) AS label", "s_name AS sub", "s_acctbal AS x", "CAST(s_suppkey * 7 AS double) AS y", "s_nationkey AS scene", "1 + s_suppkey % 40 AS count")


@query("q38_scene_filter", f"WITH {SCENE} SELECT id FROM scene WHERE asn <> 5 AND contains(lower(label || ' ' || sub), 's5')")
def q38_filter(spark, sf_dir):
    return explorer.local_filter(scene(spark, sf_dir), "S5", 5).select("id")


@query("q38_deep_links", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'as' WHEN 1 THEN 'tile' WHEN 2 THEN 'group' END AS kind, CASE event_id % 4 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN 'g01-c' || format('{:03d}', event_id % 900) WHEN 2 THEN 'g0' || (event_id % 9) END AS id FROM events")
def q38_links(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_id", "if(event_id % 4 = 0, string(event_id), 'x1') AS a", "if(event_id % 4 <= 1, concat('g01-c', lpad(event_id % 900, 3, '0')), 'g01-c1') AS t", "if(event_id % 4 <= 2, concat('g0', event_id % 9), 'g1') AS g")
    link = explorer.deep_link(F.col("a"), F.col("t"), F.col("g"))
    return e.select("event_id", link["kind"].alias("kind"), link["id"].alias("id"))


@query("q38_drawing", f"""WITH {SCENE}, r AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY id) - 1 AS rank, max(count) OVER (PARTITION BY scene) AS most FROM scene)
SELECT id, round(CASE scene % 4 WHEN 0 THEN 12 + sqrt(count / 23545) * 17 WHEN 1 THEN 8 + sqrt(count / 300) * 9 ELSE CASE WHEN id % 10 = 0 THEN 17 ELSE 4 + least(5, log2(count + 1) * 0.5) END END, 6) AS radius, rank % 8 = 0 AS labelled, round(count / most, 6) AS share,
  x BETWEEN -10 AND 5010 AND y BETWEEN 90 AND 510 AS seen, CASE id % 4 WHEN 0 THEN 'peer network' WHEN 1 THEN 'upstream network' WHEN 2 THEN 'downstream network' ELSE 'AS relationship' END AS relation,
  CASE WHEN length(sub || sub) > 25 THEN left(sub || sub, 23) || '…' ELSE sub || sub END AS label,
  ['#2563eb', '#059c86', '#7a5bcc', '#008db3', '#d39429'][1 + (CASE WHEN id % 9 = 0 THEN 9 ELSE id % 9 END - 1) % 5] AS color FROM r""")
def q38_drawing(spark, sf_dir):
    """Sizes, label strides, link widths, the visible part, names of relations, short labels and colours."""
    s = layout.link_widths(scene(spark, sf_dir), "scene").withColumn("rank", F.row_number().over(Window.partitionBy("scene").orderBy("id")) - 1)
    kind = F.expr("CASE scene % 4 WHEN 0 THEN 'world' WHEN 1 THEN 'group' WHEN 2 THEN 'tile' ELSE 'as' END")
    role = F.expr("CASE id % 4 WHEN 0 THEN 'peer' WHEN 1 THEN 'provider' WHEN 2 THEN 'customer' ELSE 'x' END")
    return s.select(
        "id", F.round(layout.radius(kind, F.col("count"), F.col("id") % 10 == 0), 6).alias("radius"), layout.label_stride(F.col("rank"), 8).alias("labelled"), F.round("share", 6).alias("share"),
        layout.in_view(F.col("x"), F.col("y"), 0, 100, 5000, 500, 10).alias("seen"), explorer.relation_label(role).alias("relation"), layout.short_label(F.concat("sub", "sub")).alias("label"),
        layout.group_color(F.concat(F.lit("g0"), F.when(F.col("id") % 9 == 0, 9).otherwise(F.col("id") % 9))).alias("color"))


@query("q38_nearest", f"WITH {SCENE} SELECT id FROM scene WHERE sqrt((x - 1000) * (x - 1000) + (y - 300) * (y - 300)) <= 5000 ORDER BY sqrt((x - 1000) * (x - 1000) + (y - 300) * (y - 300)), id LIMIT 1")
def q38_nearest(spark, sf_dir):
    return layout.nearest(scene(spark, sf_dir), 1000, 300, 5000)


@query("q38_page", f"WITH {SCENE} SELECT id, count FROM scene ORDER BY count DESC, id LIMIT 3 OFFSET 2")
def q38_page(spark, sf_dir):
    return explorer.page(scene(spark, sf_dir).select("id", "count"), [F.desc("count"), "id"], 2, 3)


@query("q38_names", f"""WITH {ORGS}, p AS (SELECT DISTINCT l_suppkey AS asn FROM lineitem UNION SELECT 100000 + l_partkey FROM lineitem)
SELECT p.asn, CASE WHEN orgs.name IS NOT NULL THEN orgs.name WHEN info.name IS NOT NULL THEN info.name ELSE 'not listed' END AS shown, p.asn % 256 AS bucket FROM p LEFT JOIN info ON p.asn = info.asn LEFT JOIN orgs ON info.org_id = orgs.org_id""")
def q38_names(spark, sf_dir):
    """Names of the numbers in paths, found by their buckets."""
    paths = table(spark, sf_dir, "lineitem").select(F.array("l_suppkey", F.col("l_partkey") + 100000).alias("path"))
    info = views.as_info(spark, sf_dir).join(views.organizations(spark, sf_dir).select("org_id", F.col("name").alias("organization")), "org_id", "left")
    found = explorer.names_of(paths, info.withColumn("bucket", topo.bucket(F.col("asn"))))
    return found.select("asn", pf.network_name(F.col("organization"), F.col("name")).alias("shown"), topo.bucket(F.col("asn")).cast("bigint").alias("bucket"))


#: The test groups' connected parts as groups g01 …, each member's distance from its group's best-connected network.
PARTS = f"""{EDGES}, {GROUPS}, {ORGS}, w AS (SELECT a AS x, b AS y FROM placed WHERE ga = gb UNION SELECT b, a FROM placed WHERE ga = gb),
reach(asn, low) AS (SELECT asn, asn FROM m UNION SELECT w.y, reach.low FROM reach JOIN w ON reach.asn = w.x), c AS (SELECT asn, min(low) AS low FROM reach GROUP BY asn),
rk AS (SELECT low, 'g' || format('{{:02d}}', row_number() OVER (ORDER BY count(*) DESC, low)) AS grp FROM c GROUP BY low),
g AS (SELECT c.asn, grp, degree, coalesce(org_id, 'unknown-AS' || c.asn) AS org, info.name FROM c JOIN rk ON c.low = rk.low JOIN deg ON c.asn = deg.asn LEFT JOIN info ON c.asn = info.asn),
h AS (SELECT grp, arg_min(asn, (-degree, asn)) AS seed, arg_min(org, (-degree, asn)) AS seed_org, count(*) AS n, count(DISTINCT org) AS orgs_n FROM g GROUP BY grp),
d(asn, distance) AS (SELECT seed, 0 FROM h UNION SELECT w.y, d.distance + 1 FROM d JOIN w ON d.asn = w.x WHERE d.distance < 20),
far AS (SELECT asn, min(distance) AS distance FROM d GROUP BY asn), e AS (SELECT a, b, rel, x.grp AS ga, y.grp AS gb, x.degree + y.degree AS weight FROM edges JOIN g x ON a = x.asn JOIN g y ON b = y.asn)"""


def snapshot(spark, sf_dir):
    edges = views.edges(spark, sf_dir)
    parts = graph.split_communities(edges, views.membership(spark, sf_dir))
    ranked = parts.join(topo.rank_groups(parts).select("grp", "gid"), "grp").select("asn", F.col("gid").alias("grp"))
    return build_snapshot(views.edge_rows(spark, sf_dir), ranked, views.as_info(spark, sf_dir), views.organizations(spark, sf_dir))


@query("q44_snapshot_groups", f"""WITH RECURSIVE {PARTS},
r AS (SELECT g.grp, asn, degree, org = seed_org AS own, row_number() OVER (PARTITION BY g.grp ORDER BY degree DESC, asn) AS p, row_number() OVER (PARTITION BY g.grp, org = seed_org ORDER BY degree DESC, asn) AS q FROM g JOIN h ON g.grp = h.grp),
u AS (SELECT grp, asn, min(p) AS p FROM (SELECT grp, asn, q AS p FROM r WHERE own AND q <= 24 UNION ALL SELECT grp, asn, p + 24 FROM r WHERE p <= 96) GROUP BY ALL),
v AS (SELECT grp, asn, row_number() OVER (PARTITION BY grp ORDER BY p) AS pos FROM u),
shown AS (SELECT v.grp, count(*) AS shown_n, string_agg(v.asn || ':' || degree || ':' || distance, ',' ORDER BY pos) AS members FROM v JOIN g ON v.asn = g.asn JOIN far ON v.asn = far.asn GROUP BY v.grp),
l AS (SELECT ga AS grp, a || CASE WHEN rel = 0 THEN '=' ELSE '>' END || b AS t, row_number() OVER (PARTITION BY ga ORDER BY weight DESC, a, b) AS pos FROM e JOIN v x ON a = x.asn JOIN v y ON b = y.asn WHERE ga = gb),
lines AS (SELECT grp, count(*) AS total, string_agg(t, ',' ORDER BY pos) FILTER (pos <= 1500) AS links FROM l GROUP BY grp),
inn AS (SELECT ga AS grp, count(*) AS internal FROM e WHERE ga = gb GROUP BY ga), own AS (SELECT grp, count(*) AS own_n, string_agg(asn, ',' ORDER BY degree DESC, asn) AS seeds FROM r WHERE own GROUP BY grp),
ext AS (SELECT x.grp, count(DISTINCT nbr) AS external FROM adj JOIN g x ON adj.asn = x.asn JOIN g y ON nbr = y.asn WHERE x.grp <> y.grp GROUP BY x.grp),
hist AS (SELECT grp, '{{' || string_agg('"' || distance || '":' || n, ',' ORDER BY distance) || '}}' AS distances FROM (SELECT grp, distance, count(*) AS n FROM g JOIN far ON g.asn = far.asn GROUP BY ALL) GROUP BY grp)
SELECT h.grp AS id, coalesce(orgs.name, seed_org) AS label, seed_org AS organization_id, seed AS seed_asn, seeds, own_n AS seed_count, coalesce(external, 0) AS external, coalesce(country, '') AS country,
  {layout.PALETTE}[1 + (CAST(substr(h.grp, 2) AS BIGINT) - 1) % {len(layout.PALETTE)}] AS color, h.n AS asn_count, orgs_n AS org_count, coalesce(internal, 0) AS internal, members, shown_n AS shown,
  coalesce(links, '') AS links, least(coalesce(total, 0), 1500) AS links_shown, coalesce(total, 0) AS links_total, distances
FROM h JOIN shown ON h.grp = shown.grp JOIN own ON h.grp = own.grp JOIN hist ON h.grp = hist.grp LEFT JOIN lines ON h.grp = lines.grp LEFT JOIN inn ON h.grp = inn.grp LEFT JOIN ext ON h.grp = ext.grp LEFT JOIN orgs ON seed_org = org_id""")
def q44_groups(spark, sf_dir):
    """The snapshot's group records, their lists as texts."""
    members = F.array_join(F.transform("members", lambda v: F.concat_ws(":", v["asn"], v["degree"], v["distance"])), ",")
    links = F.array_join(F.transform("internalLinks", lambda v: F.concat(v["source"], F.when(v["relationship"] == "peer", "=").otherwise(">"), v["target"])), ",")
    long = lambda c, name: F.col(c).cast("bigint").alias(name)
    return snapshot(spark, sf_dir)["groups"].select(
        "id", "label", F.col("organizationId").alias("organization_id"), F.col("seedAsn").alias("seed_asn"), joined(F.col("seedAsns")).alias("seeds"), long("seedOrganizationAsnCount", "seed_count"), long("externalNeighborAsnCount", "external"),
        "country", "color", long("asnCount", "asn_count"), long("organizationCount", "org_count"), long("internalLinkCount", "internal"), members.alias("members"), long("visibleMemberCount", "shown"), links.alias("links"),
        long("visibleInternalLinkCount", "links_shown"), long("totalLinksBetweenVisibleMembers", "links_total"), F.to_json("distanceDistribution").alias("distances"))


@query("q44_snapshot_members", f"WITH RECURSIVE {PARTS} SELECT g.asn, grp, coalesce(g.name, 'AS' || g.asn) AS name, coalesce(orgs.name, 'Unknown organization') AS organization, coalesce(country, '') AS country, degree, CAST(distance AS BIGINT) AS distance FROM g JOIN far ON g.asn = far.asn LEFT JOIN orgs ON org = org_id")
def q44_members(spark, sf_dir):
    return snapshot(spark, sf_dir)["members"].withColumn("distance", F.col("distance").cast("bigint"))


@query("q44_snapshot_links", f"WITH RECURSIVE {PARTS} SELECT least(ga, gb) AS source, greatest(ga, gb) AS target, count(*) AS count, count(*) FILTER (rel = 0) AS peers, count(*) FILTER (rel = -1) AS transit FROM e WHERE ga <> gb GROUP BY ALL")
def q44_links(spark, sf_dir):
    return snapshot(spark, sf_dir)["links"].select("source", "target", "count", F.col("peerCount").alias("peers"), F.col("providerCustomerCount").alias("transit"))


@query("q44_snapshot_metadata", f"""WITH RECURSIVE {PARTS} SELECT count(*) AS links, (SELECT count(*) FROM lineitem) AS raw, count(*) FILTER (rel = 0) AS peers, count(*) FILTER (rel = -1) AS transit, count(*) FILTER (ga = gb) AS within, count(*) FILTER (ga <> gb) AS between,
(SELECT count(*) FROM g) AS networks, (SELECT count(DISTINCT grp) FROM g) AS groups, (SELECT count(DISTINCT org) FROM g) AS organizations, CAST(0 AS BIGINT) AS unassigned FROM e""")
def q44_metadata(spark, sf_dir):
    names = {"totalLinks": "links", "rawRelationshipRows": "raw", "peerLinks": "peers", "providerCustomerLinks": "transit", "withinGroupLinks": "within", "betweenGroupLinks": "between", "assignedAS": "networks", "groupCount": "groups", "totalOrganizations": "organizations", "unassignedAS": "unassigned"}
    return snapshot(spark, sf_dir)["metadata"].select(*[F.col(k).alias(v) for k, v in names.items()])

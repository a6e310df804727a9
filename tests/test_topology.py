import bz2
import gzip
import json
import math
import random
from collections import deque

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netloom.operators import explorer, graph, layout, routing
from netloom.operators import topology as topo
from netloom.plans.publish import digests, documents, write_documents, write_sharded
from netloom.plans.snapshot import build_snapshot, write_snapshot
from netloom.sources import topology as src

REL = "# input clique: 10 20\n# source:topology|BGP|20260901|x\n# source:topology|BGP|20260902\n\n10|20|0\n10|1|-1\n20|1|-1\n20|2|-1\n1|3|-1\n1|10|0\n"
ORG = "# format:org_id|changed|name|country|source\nO1|20260101|First|DE|x\nO2|2|Second|FR|x\n# other\n# format:aut|changed|aut_name|org_id|opaque|source\n10|x|TEN|O1||\n20|x|TWENTY|O2||\n"


def test_relationship_and_organization_files(spark, tmp_path):
    (tmp_path / "rel.txt.bz2").write_bytes(bz2.compress(REL.encode()))
    (tmp_path / "org.txt.gz").write_bytes(gzip.compress(ORG.encode()))
    lines = src.read_lines(spark, str(tmp_path / "rel.txt.bz2"))
    assert {r.asn for r in src.clique(lines).collect()} == {10, 20}
    assert {r.date for r in src.observation_dates(lines).collect()} == {"20260901", "20260902"}
    rows = src.edges(lines)
    assert rows.count() == 6
    first = {tuple(r) for r in topo.first_edges(rows).collect()}
    assert first == {(10, 20, 0), (10, 1, -1), (20, 1, -1), (20, 2, -1), (1, 3, -1)}
    orgs, info = src.organizations(src.read_lines(spark, str(tmp_path / "org.txt.gz")))
    assert {tuple(r) for r in orgs.collect()} == {("O1", "First", "DE"), ("O2", "Second", "FR")}
    assert {tuple(r) for r in info.collect()} == {(10, "TEN", "O1"), (20, "TWENTY", "O2")}
    (tmp_path / "bad.txt").write_text("1|2|5\n")
    with pytest.raises(Exception, match="relationship"):
        src.edges(src.read_lines(spark, str(tmp_path / "bad.txt"))).collect()
    assert digests(spark, str(tmp_path / "bad.txt")).count() == 1


def test_newest_file(spark):
    df = spark.createDataFrame([("<a>20260801.rel.txt</a> 20260901.rel.txt 20991231.rel.txt",)], "t string")
    assert src.newest(df, "t", r"(\d{8})\.rel\.txt", F.lit("2026-09-30").cast("date")).first().name == "20260901.rel.txt"


def random_graph(rng, n):
    edges = {(a, b) for a in range(n) for b in range(a) if rng.random() < 1.6 / n}
    return [(a, b) for a, b in sorted(edges)]


def queue_order(nodes, edges):
    near = {a: set() for a in nodes}
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    key = lambda a: (-len(near[a]), a)
    seen, order = set(), []
    for s in sorted(nodes, key=key):
        if s in seen:
            continue
        seen.add(s)
        q = deque([s])
        while q:
            a = q.popleft()
            order.append(a)
            for b in sorted(near[a] - seen, key=key):
                seen.add(b)
                q.append(b)
    return order


def test_breadth_first_order_components_and_distances(spark):
    rng = random.Random(4)
    nodes, adj, want, comp = [], [], {}, {}
    for g in range(3):
        n = 25
        e = random_graph(rng, n)
        deg = [sum(a in x for x in e) for a in range(n)]
        nodes += [(f"g{g}", 100 * g + a, deg[a]) for a in range(n)]
        adj += [(f"g{g}", 100 * g + x, 100 * g + y) for a, b in e for x, y in ((a, b), (b, a))]
        want[f"g{g}"] = [100 * g + a for a in queue_order(range(n), e)]
    nodes_df = spark.createDataFrame(nodes, "grp string, asn bigint, degree bigint")
    adj_df = spark.createDataFrame(adj, "grp string, asn bigint, nbr bigint")
    got = {}
    for r in graph.breadth_first(nodes_df, adj_df).orderBy("grp", "position").collect():
        got.setdefault(r.grp, []).append(r.asn)
    assert got == want
    starts = spark.createDataFrame([(g, o[0]) for g, o in want.items()], "grp string, asn bigint")
    d = {(r.grp, r.asn): r.distance for r in graph.distances(starts, adj_df).collect()}
    for g, a, b in adj:
        if (g, a) in d:
            assert abs(d[g, a] - d[g, b]) <= 1
    left = {r.asn for r in graph.not_connected(starts, nodes_df, adj_df).collect()}
    assert left == {a for g, a, _ in nodes} - {a for _, a in d}


def test_tiles_follow_equal_sizes(spark):
    for n in (1, 239, 240, 241, 480, 481, 1000):
        t = spark.range(n).select(topo.tile_of(F.col("id"), F.lit(n)).alias("t")).groupBy("t").count().orderBy("t").collect()
        k = math.ceil(n / 240)
        assert [r["count"] for r in t] == [n // k + (i < n % k) for i in range(k)]


def test_tiles_beyond_999_keep_their_own_names(spark):
    ordered = spark.range(1010).selectExpr("id AS asn", "'g01' AS grp", "id AS position")
    assert {r.asn: r.tile for r in topo.tiles(ordered, 1).collect()} == {i: f"g01-c{i + 1:03d}" for i in range(1010)}


def test_merge_communities_takes_the_smallest_into_the_strongest(spark):
    m = spark.createDataFrame([(a, a // 10) for a in range(60) if a % 10 < 3 + a // 10], "asn bigint, grp bigint")
    e = spark.createDataFrame([(0, 10, 0), (1, 20, 0), (2, 21, 0), (30, 40, -1), (31, 50, 0), (10, 30, 0), (20, 40, 0)], "a bigint, b bigint, rel int")
    step = graph.merge_step(e, m).first()
    assert (step.source, step.target) == (0, 2)
    out = graph.merge_communities(e, m, 3)
    assert out.select("grp").distinct().count() == 3 and out.count() == m.count()
    assert {r.asn: r.grp for r in out.collect()}[0] == {r.asn: r.grp for r in out.collect()}[20]
    with pytest.raises(ValueError):
        graph.merge_communities(e.where("a = 1"), m, 1)


def test_label_propagation_finds_two_cliques(spark):
    clique = [(a, b, 0) for k in (0, 10) for a in range(k, k + 6) for b in range(k, a)]
    e = spark.createDataFrame([*clique, (0, 10, 0)], "a bigint, b bigint, rel int")
    labels = graph.propagate_communities(spark.createDataFrame([(a,) for k in (0, 10) for a in range(k, k + 6)], "asn bigint"), e)
    assert labels.select("grp").distinct().count() == 2
    assert topo.modularity(e, labels).first().modularity > 0.4


def test_spring_layout_stays_in_bounds(spark):
    nodes = spark.createDataFrame([("t1", a) for a in range(12)] + [("t2", 99)], "tile string, asn bigint")
    links = spark.createDataFrame([("t1", a, (a + 1) % 12) for a in range(12)], "tile string, a bigint, b bigint")
    xy = layout.spring(nodes, links).collect()
    assert len(xy) == 13 and all(-1 <= v <= 1 for r in xy for v in (r.x, r.y))


def test_search_deep_links_and_scenes(spark):
    index = spark.createDataFrame([(7, "g01", "g01-c001", "Alpha Net", 3), (8, "g02", "g02-c001", "Beta", 2), (70, "g01", "g01-c001", "alphabet", 1)], "asn bigint, grp string, tile string, name string, degree bigint")
    find = lambda q: [r.asn for r in explorer.search(index, q).collect()]
    assert find(" as7 ") == [7] and find("007") == [] and find("ALPHA") == [7, 70] and find("  ") == [] and find("AS") == []
    df = spark.createDataFrame([("12", "g01-c001", None), ("x", "g01-c001", "g01"), (None, "bad", "g01"), (None, None, "g1")], "a string, t string, g string")
    assert [(r.d.kind, r.d.id) if r.d else None for r in df.select(explorer.deep_link(F.col("a"), F.col("t"), F.col("g")).alias("d")).collect()] == [("as", "12"), ("tile", "g01-c001"), ("group", "g01"), None]
    adj = spark.createDataFrame([(7, 8, "peer"), (7, 9, "customer"), (8, 7, "peer")], "asn bigint, nbr bigint, role string").withColumn("bucket", topo.bucket(F.col("asn")))
    nodes, links = explorer.as_scene(adj, index, 7)
    assert [(r.id, r.sub, r["count"]) for r in nodes.orderBy(F.desc("count"), "id").collect()] == [("7", "Alpha Net", 3), ("8", "Beta", 2), ("9", "AS9", 0)]
    assert {(r.target, r.relationship) for r in links.collect()} == {("8", "peer"), ("9", "customer")}
    assert [r.asn for r in explorer.local_filter(nodes, "BETA", 7).collect()] == [8]


def test_json_documents_and_assets(spark, tmp_path):
    nodes = spark.createDataFrame([("g01-c001", 1, "a", 2), ("g01-c001", 2, "b", 5), ("g01-c002", 3, "c", 1)], "tile string, asn bigint, name string, degree bigint")
    docs = documents(nodes, "tile", [-F.col("degree"), F.col("asn")], "nodes", ["asn", "name", "degree"])
    assert json.loads(docs.where("tile = 'g01-c001'").first().json) == {"id": "g01-c001", "nodes": [{"asn": 2, "name": "b", "degree": 5}, {"asn": 1, "name": "a", "degree": 2}]}
    write_documents(docs, "tile", str(tmp_path / "docs"))
    assert len(list((tmp_path / "docs").glob("tile=*"))) == 2
    write_sharded(nodes, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).where("bucket = 3").count() == 1
    (tmp_path / "index.json").write_text(json.dumps({"7": ["g01", "g01-c001", "Seven", 4]}))
    assert tuple(src.read_asset(spark, "index", str(tmp_path / "index.json")).first()) == (7, "g01", "g01-c001", "Seven", 4)
    (tmp_path / "adj.json").write_text(json.dumps({"7": {"neighbors": [[8, "peer"]]}}))
    assert tuple(src.read_asset(spark, "adjacency", str(tmp_path / "adj.json")).first()) == (7, 8, "peer")
    (tmp_path / "tile.json").write_text(json.dumps({"id": "t", "nodes": [{"asn": 1, "x": 0.5}], "links": []}))
    assert src.read_asset(spark, "tile", str(tmp_path / "tile.json")).first().nodes[0].x == 0.5


def test_sound_edges_and_equal_nodes(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "asn bigint")
    good = spark.createDataFrame([(1, 2, 0)], "a bigint, b bigint, rel int")
    assert topo.known_edges(good, nodes).count() == 1
    with pytest.raises(Exception, match="not sound"):
        topo.known_edges(spark.createDataFrame([(1, 3, 0)], "a bigint, b bigint, rel int"), nodes).collect()
    assert topo.same_nodes(nodes, nodes).first().equal and not topo.same_nodes(nodes, nodes.union(nodes)).first().equal


def test_empty_tables(spark):
    routes = spark.createDataFrame([], "peer_id string, family int, prefix_len int, prefix_key string, path array<bigint>")
    probes = spark.createDataFrame([(1, "p", "1.1.1.1")], "probe_id int, peer_id string, ip string")
    assert routing.lookup(probes, routes).first().status == "unknown_peer"
    assert routing.merge_routes(routes).count() == 0
    with pytest.raises(Exception, match="empty"):
        routing.check_limits(routing.table_size(routes, routes)).collect()


def settled(membership, edges, most):
    """Communities split into connected parts, the smallest merged one by one, as sets by (size, lowest number)."""
    near = {a: set() for a in membership}
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    left, parts = set(membership), []
    while left:
        part, todo = set(), [min(left)]
        while todo:
            a = todo.pop()
            if a not in part:
                part.add(a)
                todo += [b for b in near[a] if membership[b] == membership[a]]
        parts.append(part)
        left -= part
    while len(parts) > most:
        small = min(parts, key=lambda p: (len(p), min(p)))
        rest = [p for p in parts if p is not small]
        links = lambda p: sum(b in p for a in small for b in near[a])  # noqa: E731, B023
        best = max(rest, key=lambda p: (links(p), len(p), -min(p)))
        best |= small
        parts = rest
    return sorted(parts, key=lambda p: (-len(p), min(p)))


def test_communities_split_merged_and_ranked(spark):
    rng = random.Random(4)
    for n, most in ((24, 3), (40, 5)):
        edges = [(a, rng.randrange(a)) for a in range(1, n)] + [tuple(rng.sample(range(n), 2)) for _ in range(n // 2)]
        edges = sorted({(max(e), min(e)) for e in edges})
        groups = {a: rng.randrange(6) for a in range(n)}
        m = spark.createDataFrame([(a, g) for a, g in groups.items()], "asn bigint, grp bigint")
        got = graph.settle_communities(spark.createDataFrame(edges, "a bigint, b bigint"), m, most).collect()
        assert {r.asn: r.grp for r in got} == {a: f"g{i + 1:02d}" for i, p in enumerate(settled(groups, edges, most)) for a in p}


def test_snapshot_needs_connected_groups_of_all_networks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 0, 1), (2, 3, -1, 2), (3, 4, 0, 3), (2, 1, -1, 4)], "a bigint, b bigint, rel int, line_no bigint")
    info = spark.createDataFrame([(1, "ONE", "X"), (2, None, "X"), (3, "THREE", None)], "asn bigint, name string, org_id string")
    orgs = spark.createDataFrame([("X", "Ex", None)], "org_id string, name string, country string")
    groups = lambda *of: spark.createDataFrame([(i + 1, g) for i, g in enumerate(of)], "asn bigint, grp string")
    with pytest.raises(ValueError, match="not connected"):
        build_snapshot(rows, groups("g01", "g02", "g01", "g02"), info, orgs)
    with pytest.raises(ValueError, match="no group"):
        build_snapshot(rows, groups("g01", "g01", "g02"), info, orgs)
    dates = spark.createDataFrame([("20260902",), ("20260901",)], "date string")
    built = build_snapshot(rows, groups("g01", "g01", "g02", "g02", "g09"), info, orgs, {"source": "own", "date": "2026-09-01"}, rows.selectExpr("a AS asn"), dates)
    meta = built["metadata"].first().asDict()
    assert len(meta) == 26 and meta["source"] == "own" and meta["rawRelationshipRows"] == 4 and meta["totalLinks"] == 3 and meta["groupCount"] == 2
    assert meta["bgpObservationDates"] == ["20260901", "20260902"] and meta["inputClique"] == [1, 2, 3] and meta["totalOrganizations"] == 3
    one, two = built["groups"].orderBy("id").collect()
    assert (one.label, one.organizationId, one.country, one.seedAsn, one.seedAsns, one.distanceDistribution) == ("Ex", "X", "", 2, [2, 1], {0: 1, 1: 1})
    assert (two.label, two.seedAsns, [v.asn for v in two.members], [tuple(x) for x in two.internalLinks]) == ("unknown-AS3", [3], [3, 4], [(3, 4, "peer")])
    assert two.externalNeighborAsnCount == 1 and built["links"].first().providerCustomerCount == 1
    write_snapshot(built, str(tmp_path))
    assert {r.asn: r.grp for r in spark.read.json(str(tmp_path / "members")).collect()} == {1: "g01", 2: "g01", 3: "g02", 4: "g02"}
    assert spark.read.json(str(tmp_path / "metadata")).count() == 1


def one_by_one(edges):
    """Communities by modularity, a node moving at a time: the measure for the parallel search."""
    near, loops = {}, {}
    for a, b in edges:
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, {})[y] = near.get(x, {}).get(y, 0) + 1
    total, member = 2 * len(edges), {x: x for x in near}
    while True:
        of = {x: x for x in near}
        k = {x: sum(w.values()) + loops.get(x, 0) for x, w in near.items()}
        size, moved, any_move = dict(k), True, False
        while moved:
            moved = False
            for x in sorted(near):
                size[of[x]] -= k[x]
                votes = {of[x]: 0}
                for y, w in near[x].items():
                    votes[of[y]] = votes.get(of[y], 0) + w
                to = max(votes, key=lambda c: (votes[c] - k[x] * size[c] / total, c == of[x]))
                if votes[to] - k[x] * size[to] / total > votes[of[x]] - k[x] * size[of[x]] / total + 1e-9:
                    of[x], moved, any_move = to, True, True
                size[of[x]] += k[x]
        member = {x: of[c] for x, c in member.items()}
        if not any_move:
            return member
        joined, inner = {}, {}
        for x, ws in near.items():
            inner[of[x]] = inner.get(of[x], 0) + loops.get(x, 0)
            joined.setdefault(of[x], {})
            for y, w in ws.items():
                if of[x] == of[y]:
                    inner[of[x]] += w
                else:
                    joined[of[x]][of[y]] = joined[of[x]].get(of[y], 0) + w
        near, loops = joined, inner


def quality(edges, member):
    ends, inner = {}, 0
    for a, b in edges:
        inner += member[a] == member[b]
        for x in (a, b):
            ends[member[x]] = ends.get(member[x], 0) + 1
    return inner / len(edges) - sum(v * v for v in ends.values()) / (4 * len(edges) ** 2)


def test_modularity_communities(spark):
    ring = [(c * 6 + i, c * 6 + j) for c in range(8) for i in range(6) for j in range(i)] + [(c * 6, (c + 1) % 8 * 6 + 1) for c in range(8)]
    rng = random.Random(5)
    star = [(0, i) for i in range(1, 40)] + [(i, i + 1) for i in range(1, 39, 2)]
    loose = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(110)})
    shift = lambda es, by: [(a + by, b + by) for a, b in es]
    for es, exact in ((ring, {x: x // 6 * 6 for x in range(48)}), (shift(star, 100) + shift(loose, 200), None)):
        nodes = sorted({x for e in es for x in e}) + [999]
        n = spark.createDataFrame([(x,) for x in nodes + nodes[:3]] + [(None,)], "asn bigint")
        e = spark.createDataFrame(es + [(b, a) for a, b in es[:9]] + [(es[0][0],) * 2, (es[0][0], 77777), (None, 3)], "a bigint, b bigint")
        got = {r.asn: r.grp for r in graph.modularity_communities(n, e).collect()}
        assert set(got) == set(nodes) and got.pop(999) == 999
        assert all(g == min(x for x in got if got[x] == g) for g in got.values())
        if exact:
            assert got == exact
        assert quality(es, got) >= quality(es, one_by_one(es)) - 0.02
    ranked = graph.find_communities(spark.createDataFrame([(x,) for x in range(7)], "asn bigint"), spark.createDataFrame([(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (5, 3), (6, 5), (6, 4)], "a bigint, b bigint"), 2)
    assert {r.asn: r.grp for r in ranked.collect()} == {x: "g02" if x < 3 else "g01" for x in range(7)}
    empty = graph.modularity_communities(spark.createDataFrame([(1,)], "asn bigint"), spark.createDataFrame([], "a bigint, b bigint")).collect()
    assert [tuple(r) for r in empty] == [(1, 1)]


def test_modularity_communities_in_few_jobs(spark):
    """Rounds of a small level run without Spark; a level worked off by Spark gives the same."""
    rng = random.Random(7)
    es = sorted({tuple(sorted(rng.sample(range(c * 40, c * 40 + 40), 2))) for c in range(10) for _ in range(150)} | {tuple(sorted(rng.sample(range(400), 2))) for _ in range(200)})
    n, e = spark.createDataFrame([(x,) for x in range(400)], "asn bigint"), spark.createDataFrame(es, "a bigint, b bigint")
    sc = spark.sparkContext
    sc.setJobGroup("few jobs", "communities")
    got = {r.asn: r.grp for r in graph.modularity_communities(n, e).collect()}
    assert len(sc.statusTracker().getJobIdsForGroup("few jobs")) <= 12
    sc.setJobGroup("other", "other")
    assert quality(es, got) >= quality(es, one_by_one(es)) - 0.02
    assert {r.asn: r.grp for r in graph.modularity_communities(n, e, fit=0).collect()} == got


def test_packed_links(monkeypatch):
    monkeypatch.setattr(graph, "PACK", 5)
    links = [(a, b, 1) for a in range(20) for b in range(a % 7 + 1)] + [(20, b % 11, 1) for b in range(30)] + [(21, 1, 1), (99, 1, 1)]
    parts = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links[i : i + 4], strict=True)], ["a", "b", "w"]) for i in range(0, len(links), 4)]
    rows = [graph._unpacked(r) for p in graph._packing(np.arange(22))(parts) for r in p.to_pylist()]
    assert [(a, b) for r in rows for a, b in zip(*(x.tolist() for x in r[:2]), strict=True)] == sorted({x[:2] for x in links if x[0] < 99})
    assert len(rows) > 5 and all(x[0][-1] < y[0][0] for x, y in zip(rows, rows[1:], strict=False))

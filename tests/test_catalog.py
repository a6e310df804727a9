import pytest

from netloom.plans import catalog, catalog_more  # noqa: F401
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, sf, name):
    same(catalog.QUERIES[name](spark, sf), catalog.ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_topology_build(spark, sf, tmp_path):
    """The documents agree with one another, as the explorer needs."""
    import gzip
    import json
    import math
    from collections import Counter

    from netloom.plans.build import write_topology
    from netloom.plans.publish import file_manifest, file_sizes
    from netloom.sources.topology import read_asset

    built = catalog.topology_build(spark, sf)
    load = lambda name: {r.key: json.loads(r.json) for r in built[name].collect()}
    tiles, groups, root, overview = load("tile"), load("group"), load("root")["root"], load("overview")["overview"]
    index = {r.asn: r for r in built["index"].collect()}
    edges = built["edges"].collect()
    external = Counter(t for e in edges if index[e.a].tile != index[e.b].tile for t in (index[e.a].tile, index[e.b].tile))
    for k, t in tiles.items():
        assert t["count"] == len(t["nodes"]) <= 240 and sum(n["degree"] for n in t["nodes"]) >= 2 * len(t["links"]) + t["externalLinkCount"]
        assert [(-n["degree"], n["asn"]) for n in t["nodes"]] == sorted((-n["degree"], n["asn"]) for n in t["nodes"]) and t["seedAsn"] == t["nodes"][0]["asn"]
        assert t["externalLinkCount"] == external[k] and all(-1 <= n["x"] <= 1 and -1 <= n["y"] <= 1 for n in t["nodes"]) and t["parent"] == k[:3]
    for k, g in groups.items():
        assert [c["id"] for c in g["children"]] == [f"{k}-c{i + 1:03d}" for i in range(math.ceil(g["count"] / 240))] and sum(c["count"] for c in g["children"]) == g["count"]
    assert [(x["source"], x["target"], x["count"]) for x in root["links"]] == [(x["source"], x["target"], x["count"]) for x in overview["links"]]
    assert all(x["count"] == x["peerCount"] + x["providerCustomerCount"] for x in overview["links"])
    assert int(overview["meta"]["totalLinks"]) == len(edges) and int(overview["meta"]["totalAS"]) == len(index) == sum(g["asnCount"] for g in overview["groups"])
    meta = overview["meta"]
    assert len(meta) == 26 and meta["withinGroupLinks"] + meta["betweenGroupLinks"] == meta["totalLinks"] and meta["groupCount"] == len(groups) and meta["unassignedAsns"] == []
    facts = built["manifest"].first()
    assert facts.sound and facts.within_tiles == sum(len(t["links"]) for t in tiles.values()) and facts.between_tiles == sum(x["count"] for g in groups.values() for x in g["links"])
    write_topology({k: built[k] for k in ("overview", "adjacency", "names", "index")}, str(tmp_path))
    assert read_asset(spark, "overview", str(tmp_path / "overview" / "key=overview")).first().groups[0].id == "g01"
    back = lambda name: read_asset(spark, name, str(tmp_path / name / ("" if name == "index" else "*")), lines=True).collect()
    assert {(r.asn, r.grp, r.tile, r.name, r.degree) for r in back("index")} == {(r.asn, r.grp, r.tile, r.name, r.degree) for r in index.values()}
    assert {(r.asn, r.name, r.organization, r.country) for r in back("names")} == {(r.asn, r.name, r.organization, r.country) for r in built["names"].collect()}
    near = [(r.asn, r.nbr) for r in back("adjacency")]
    assert len(near) == len(set(near)) == 2 * len(edges) and set(near) == {p for e in edges for p in ((e.a, e.b), (e.b, e.a))}
    sizes = file_sizes(spark, str(tmp_path))
    paths = [p for p in tmp_path.rglob("part-*")]
    row = file_manifest(sizes).first()
    assert row.files == len(paths) and row.totalJsonBytesExcludingManifest == sum(p.stat().st_size for p in paths) and row.largestFileBytes == max(p.stat().st_size for p in paths)
    assert row.estimatedGzipBytesExcludingManifest == sum(len(gzip.compress(p.read_bytes(), 6, mtime=0)) for p in paths)


def test_entry_without_optional_part():
    """The entry module imports and lists its own queries even where the optional subpackage is gone."""
    import subprocess
    import sys
    import textwrap
    from pathlib import Path

    code = textwrap.dedent("""
        import sys
        class Gone:
            def find_spec(self, name, path=None, target=None):
                if name in ("netloom.llm", "corpus_pipeline"):
                    raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        sys.meta_path.insert(0, Gone())
        import __spark_entry__ as e
        assert e.queries() and set(e.oracle_sql()) <= set(e.queries()) and "pipeline" not in e.queries()
    """)
    root = Path(__file__).resolve().parents[1]
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, env={"PYTHONPATH": str(root), "PATH": "/usr/bin:/bin"})

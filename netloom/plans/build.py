"""Topology build: from relationship rows, memberships and names to every table and document that the explorer reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators import graph, layout
from netloom.operators import topology as topo
from netloom.plans import publish
from netloom.plans.snapshot import metadata
from netloom.session import cut


def build_topology(rows: DataFrame, membership: DataFrame, info: DataFrame, orgs: DataFrame, target: int = topo.TILE, **known) -> dict[str, DataFrame]:
    """Tables by name: edges, adjacency, index, tiles, names; and documents (key, json): tile, group, root, overview.

    rows: a, b, rel, line_no; membership: asn, grp (g01 …); info: asn, name, org_id; orgs: org_id, name, country; known:
    about, clique, dates, sources for the overview's metadata, as build_snapshot takes them.
    """
    edges = cut(topo.known_edges(topo.first_edges(rows), membership))
    adj = topo.adjacency(edges)
    degree = cut(membership.select("asn").distinct().join(topo.degrees(adj), "asn", "left").select("asn", F.coalesce("degree", F.lit(0)).alias("degree")))
    inner = topo.with_groups(edges, membership).where("ga = gb")
    nodes = membership.join(degree, "asn").select("grp", "asn", "degree")
    order = graph.breadth_first(nodes, topo.adjacency(inner.select("a", "b", "rel")).join(membership, "asn").select("grp", "asn", "nbr"))
    tiles = cut(topo.tiles(order, target))
    index = tiles.join(degree, "asn").join(info.select("asn", "name"), "asn", "left").select("asn", "grp", "tile", F.coalesce("name", F.concat(F.lit("AS"), F.col("asn"))).alias("name"), "degree")
    tile_of = tiles.select("asn", F.col("tile").alias("grp"))
    placed = topo.with_groups(edges, tile_of)
    names = membership.join(info, "asn", "left").join(orgs.toDF("org_id", "organization", "country"), "org_id", "left").select("asn", F.coalesce("name", F.concat(F.lit("AS"), F.col("asn"))).alias("name"), "organization", "country")

    def labelled(key: DataFrame) -> DataFrame:
        """grp, count, seed, label, org: the size and the best-connected member of each group or tile, its name and its
        organization's."""
        seed = topo.seeds(key, degree).join(names.select(F.col("asn").alias("seed"), F.col("name").alias("label"), F.coalesce("organization", "name").alias("org")), "seed")
        return key.groupBy("grp").agg(F.count("*").alias("count")).join(seed, "grp")

    relation = F.when(F.col("rel") == 0, "peer").otherwise("provider-customer")
    within = placed.where("ga = gb").select(F.col("ga").alias("tile"), "a", "b", relation.alias("relationship"))
    xy = layout.spring(tiles.select("tile", "asn"), within.select("tile", "a", "b"))
    tile_nodes = xy.join(index.drop("tile"), "asn").select("tile", F.struct((-F.col("degree")).alias("_d"), "asn").alias("_o"), F.struct("asn", "name", "degree", F.col("grp").alias("group"), "x", "y").alias("v"))
    nodes_of = tile_nodes.groupBy("tile").agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "v"))), lambda e: e["v"]).alias("nodes"))
    links_of = within.groupBy("tile").agg(F.array_sort(F.collect_list(F.struct(F.col("a").alias("source"), F.col("b").alias("target"), "relationship"))).alias("links"))
    parts = graph.components(tiles.select("asn"), within.select("a", "b")).join(tiles, "asn").groupBy("tile").agg(F.countDistinct("component").alias("connectedComponents"))
    heads = cut(labelled(tile_of)).withColumnRenamed("grp", "tile")
    external = topo.external_links(placed).withColumnRenamed("grp", "tile")
    none = F.array().cast("array<struct<source:bigint,target:bigint,relationship:string>>")
    tile = heads.join(nodes_of, "tile").join(links_of, "tile", "left").join(parts, "tile").join(external, "tile", "left")
    tile = tile.select(F.col("tile").alias("key"), F.to_json(F.struct(
        F.col("tile").alias("id"), F.substring_index("tile", "-", 1).alias("parent"), "label", "count", F.col("seed").alias("seedAsn"), F.lit("bfs-tile").alias("partition"),
        "connectedComponents", F.coalesce("external", F.lit(0)).alias("externalLinkCount"), "nodes", F.coalesce("links", none).alias("links"))).alias("json"))

    parent = lambda c: F.substring_index(c, "-", 1)
    tile_pairs = topo.pair_edges(placed.where(parent("ga") == parent("gb"))).select(parent("source").alias("grp"), "source", "target", "count")
    numbered = heads.select(F.col("tile").alias("id"), parent("tile").alias("grp"), "label", "count", F.col("seed").alias("seedAsn"), F.regexp_extract("tile", r"(\d+)$", 1).cast("bigint").alias("i"))
    # a group's tiles are laid out by the links between them; a tile's number stands for it
    number = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("bigint")
    spots = layout.spring(numbered.select("grp", F.col("i").alias("asn")), tile_pairs.select("grp", number("source").alias("a"), number("target").alias("b")), "grp", seed=9000)
    children = numbered.join(spots.withColumnRenamed("asn", "i"), ["grp", "i"]).groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("id", "label", "count", "seedAsn", "x", "y"))).alias("children"))
    pairs_of = tile_pairs.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("source", "target", "count"))).alias("links"))
    groups = cut(labelled(membership).drop("label").withColumnRenamed("org", "label"))
    plain = F.array().cast("array<struct<source:string,target:string,count:bigint>>")
    group = groups.join(children, "grp").join(pairs_of, "grp", "left").select(F.col("grp").alias("key"), F.to_json(F.struct(F.col("grp").alias("id"), "label", "count", F.lit("bfs-tile").alias("partition"), "children", F.coalesce("links", plain).alias("links"))).alias("json"))

    by_group = topo.with_groups(edges, membership)
    pairs = topo.pair_edges(by_group)
    country = names.select(F.col("asn").alias("seed"), F.coalesce("country", F.lit("")).alias("country"))
    rank = F.regexp_replace("grp", r"\D", "").cast("int") - 1
    rows_of = lambda *fields: groups.join(country, "seed").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("groups"))
    links = lambda *fields: pairs.agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("links"))
    root = rows_of(F.col("grp").alias("id"), "label", "count", F.col("seed").alias("seedAsn"), layout.palette_color(rank).alias("color")).crossJoin(links("source", "target", "count"))
    org_of = membership.select("asn").join(info.select("asn", "org_id"), "asn", "left").select("asn", F.coalesce("org_id", F.concat(F.lit("unknown-AS"), F.col("asn"))).alias("org_id"))
    facts = metadata(rows, by_group, membership, org_of, known.get("about") or {}, known.get("clique"), known.get("dates"), known.get("sources"))
    meta = facts.select(F.struct(*facts.columns).alias("meta"))
    overview = meta.crossJoin(rows_of(F.col("grp").alias("id"), "label", F.col("seed").alias("seedAsn"), F.col("count").alias("asnCount"), "country")).crossJoin(links("source", "target", "count", F.col("peer_count").alias("peerCount"), F.col("provider_customer_count").alias("providerCustomerCount")))
    json = lambda df, name: df.select(F.lit(name).alias("key"), F.to_json(F.struct(*df.columns)).alias("json"))
    return {
        "edges": edges, "adjacency": publish.sharded_adjacency(topo.ordered_neighbours(adj, degree)), "index": index, "tiles": tiles, "names": names.withColumn("bucket", topo.bucket(F.col("asn"))),
        "tile": tile, "group": group, "root": json(root, "root"), "overview": json(overview, "overview"), "manifest": topo.manifest(by_group, tiles),
    }


def write_topology(built: dict[str, DataFrame], root: str) -> None:
    """Tables as Parquet; documents as text below a folder per key; adjacency, names and index as JSON lines, the first two
    below a folder per bucket, which read_asset reads with lines=True."""
    word = lambda c: F.col(c).cast("string")
    for name, df in built.items():
        if name == "adjacency":
            value = F.from_json("json", "neighbors array<array<string>>")
            publish.write_documents(publish.keyed_lines(df, value).repartition("bucket"), "bucket", f"{root}/{name}")
        elif name == "names":
            publish.write_documents(publish.keyed_lines(df, F.struct("name", "organization", "country")).repartition("bucket"), "bucket", f"{root}/{name}")
        elif name == "index":
            lines = publish.keyed_lines(df.withColumn("bucket", F.lit(0)), F.array("grp", "tile", "name", word("degree")))
            lines.select(F.col("json").alias("value")).write.mode("overwrite").text(f"{root}/{name}")
        elif name in ("tile", "group", "root", "overview"):
            publish.write_documents(df, "key", f"{root}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{root}/{name}")

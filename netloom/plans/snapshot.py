"""Snapshot build: from relationship rows, communities, names and organizations to group records, member details, the
index of networks and the snapshot's metadata, as one call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators import graph, layout
from netloom.operators import topology as topo
from netloom.session import cut

SHOWN, LINKS = 120, 1500
#: What the fields of the metadata mean, in words of this engine.
NOTES = {
    "grouping": "Communities of the undirected graph of links, split into connected parts, the smallest merged into their strongest neighbours. A group is named after the organization of its best-connected network; the name implies no ownership.",
    "groupingZh": "按网络连接划分的社群;名称取自组内连接最多的网络所属组织,不代表所有权。",
    "memberSampling": f"A group record lists networks of the seed organization and the best-connected ones, {SHOWN} at most, with {LINKS} links at most; the member details list all.",
    "coverage": "Networks and links seen or inferred in the given relationship rows; not physical cables and not live traffic.",
    "memberDistanceMeaning": "Links on the shortest way within the group from its best-connected network.",
}
MEANING = {"peer": "relationship 0: two peers", "provider-customer": "relationship -1: the source provides for the target"}


def build_snapshot(rows: DataFrame, membership: DataFrame, info: DataFrame, orgs: DataFrame, about: dict[str, str] | None = None, clique: DataFrame | None = None, dates: DataFrame | None = None, sources: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables by name: groups (one record a group), members (all, with distances), index, links (between groups),
    metadata (one row).

    rows: a, b, rel, line_no; membership: asn, grp (g01 …); info: asn, name, org_id; orgs: org_id, name, country; about:
    plain metadata such as source and dates; clique: asn; dates: date; sources: path, sha256. Every network with a link
    must be in one group, and every group must be connected, else ValueError. Lists in a record are bounded by SHOWN and
    LINKS, but for the networks of one organization; all members are rows, never one list.
    """
    edges = cut(topo.first_edges(rows))
    adj = topo.adjacency(edges)
    degree = cut(topo.degrees(adj))
    membership = cut(membership.join(degree.select("asn"), "asn", "left_semi").select("asn", "grp"))
    if not degree.join(membership, "asn", "left_anti").isEmpty():
        raise ValueError("a network belongs to no group")
    placed = cut(topo.with_groups(edges, membership))
    inner = placed.where("ga = gb").select("a", "b", "rel")
    seed = cut(topo.seeds(membership, degree))
    inside = topo.adjacency(inner).join(membership, "asn").select("grp", "asn", "nbr")
    far = graph.distances(seed.select("grp", F.col("seed").alias("asn")), inside)
    if not membership.join(far, ["grp", "asn"], "left_anti").isEmpty():
        raise ValueError("a group is not connected")

    org_of = membership.select("asn").join(info.select("asn", "org_id"), "asn", "left").select("asn", F.coalesce("org_id", F.concat(F.lit("unknown-AS"), F.col("asn"))).alias("org_id"))
    members = cut(topo.members(membership, degree, info, orgs).join(far, ["grp", "asn"]))
    ranked = cut(topo.ranked_members(membership, degree, org_of))
    by_degree = lambda *fields: F.array_sort(F.collect_list(F.struct((-F.col("degree")).alias("_d"), *fields)))
    own = ranked.where("in_seed_org").groupBy("grp").agg(F.transform(by_degree("asn"), lambda e: e["asn"]).alias("seedAsns"))
    visible = cut(topo.visible_members(ranked, most=SHOWN))
    record = F.struct("asn", "name", "organization", "country", "degree", "distance")
    shown = members.join(visible, ["grp", "asn"]).groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", record.alias("v")))), lambda e: e["v"]).alias("members"))
    between = topo.top_links(inner, degree, visible, SHOWN * (SHOWN - 1) // 2)  # all there can be between the visible ones
    link = F.struct("position", F.col("a").alias("source"), F.col("b").alias("target"), relationship(F.col("rel")).alias("relationship"))
    lines = between.groupBy("grp").agg(F.count("*").alias("total"), F.transform(F.array_sort(F.collect_list(F.when(F.col("position") <= LINKS, link))), lambda e: e.dropFields("position")).alias("list"))
    within = placed.where("ga = gb").groupBy(F.col("ga").alias("grp")).agg(F.count("*").alias("internal"))
    name = orgs.toDF("org_id", "org_name", "org_country")
    heads = seed.join(org_of.withColumnRenamed("asn", "seed"), "seed").join(name, "org_id", "left")
    per = heads.join(topo.group_sizes(membership, org_of), "grp").join(own, "grp").join(shown, "grp").join(topo.distance_histogram(far), "grp")
    for more in (lines, within, topo.external_neighbours(adj, membership)):
        per = per.join(more, "grp", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    groups = per.select(
        F.col("grp").alias("id"), F.coalesce("org_name", "org_id").alias("label"), F.col("org_id").alias("organizationId"), F.col("seed").alias("seedAsn"), "seedAsns", F.size("seedAsns").alias("seedOrganizationAsnCount"),
        count("n").alias("externalNeighborAsnCount"), F.coalesce("org_country", F.lit("")).alias("country"), layout.palette_color(F.regexp_replace("grp", r"\D", "").cast("int") - 1).alias("color"),
        F.col("asns").alias("asnCount"), F.col("organizations").alias("organizationCount"), count("internal").alias("internalLinkCount"), "members", F.size("members").alias("visibleMemberCount"), F.lit(NOTES["memberSampling"]).alias("memberSample"),
        F.coalesce("list", F.array().cast(lines.schema["list"].dataType)).alias("internalLinks"), F.least(count("total"), F.lit(LINKS)).alias("visibleInternalLinkCount"), count("total").alias("totalLinksBetweenVisibleMembers"), F.col("distances").alias("distanceDistribution"))
    pairs = topo.pair_edges(placed).select("source", "target", "count", F.col("peer_count").alias("peerCount"), F.col("provider_customer_count").alias("providerCustomerCount"))
    index = members.select("asn", "grp", "name", "degree")
    return {"groups": groups, "members": members, "index": index, "links": pairs, "metadata": metadata(rows, placed, membership, org_of, about or {}, clique, dates, sources)}


def relationship(rel):
    return F.when(rel == 0, "peer").otherwise("provider-customer")


def metadata(rows, placed, membership, org_of, about, clique, dates, sources) -> DataFrame:
    """One row: counts, what was read, and what the fields mean. The lists are those of the sources' comments."""
    spark = rows.sparkSession
    listed = lambda df, c, kind, name: df.agg(F.array_sort(F.collect_set(c)).alias(name)) if df is not None else spark.range(1).select(F.array().cast(f"array<{kind}>").alias(name))
    t = topo.totals(placed).select(F.col("links").alias("totalLinks"), F.col("peer_links").alias("peerLinks"), F.col("provider_customer_links").alias("providerCustomerLinks"), F.col("within").alias("withinGroupLinks"), F.col("between").alias("betweenGroupLinks"))
    one = t.crossJoin(rows.agg(F.count("*").alias("rawRelationshipRows"))).crossJoin(org_of.agg(F.countDistinct("org_id").alias("totalOrganizations")))
    one = one.crossJoin(membership.agg(F.count("*").alias("totalAS"), F.countDistinct("grp").alias("groupCount")))
    for part in (listed(clique, "asn", "bigint", "inputClique"), listed(dates, "date", "string", "bgpObservationDates"), listed(None if sources is None else sources.select(F.struct("path", "sha256").alias("s")), "s", "struct<path:string,sha256:string>", "sources")):
        one = one.crossJoin(part)
    words = {"source": "", "date": "", "organizationDate": "", "fetchedDate": "", "communityDetection": ""} | NOTES | about
    meaning = F.create_map(*[F.lit(x) for kv in MEANING.items() for x in kv]).alias("relationshipMeaning")
    return one.select("*", F.col("totalAS").alias("assignedAS"), F.lit(0).cast("bigint").alias("unassignedAS"), F.array().cast("array<bigint>").alias("unassignedAsns"), meaning, *[F.lit(v).alias(k) for k, v in words.items()])


def write_snapshot(built: dict[str, DataFrame], root: str) -> None:
    """JSON lines: a record a group, a member a row below a folder per group, the index, the links, the metadata."""
    for name, df in built.items():
        if name == "members":
            df.repartition("grp", F.pmod("asn", F.lit(64))).write.mode("overwrite").partitionBy("grp").json(f"{root}/{name}")
        else:
            df.write.mode("overwrite").json(f"{root}/{name}")

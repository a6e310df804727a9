"""AS topology: edges, roles, degrees, organizations, groups, tiles, and their aggregates.

Tables: edges(a, b, rel[, line_no]), rel 0 peers, -1 a provides for b; membership(asn, grp).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 240
BUCKETS = 256
UNKNOWN = "Unknown organization"


def first_edges(rows: DataFrame) -> DataFrame:
    """Of the rows for one unordered pair the first by line_no. min_by is combined before the shuffle."""
    pair = [F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")]
    return rows.groupBy(*pair).agg(F.min_by(F.struct("a", "b", "rel"), F.struct("line_no", "a", "b", "rel")).alias("e")).select("e.*")


def known_edges(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges, or an error where an end is no known node or the relationship is neither 0 nor -1."""
    ends = rows.join(nodes.select(F.col("asn").alias("a"), F.lit(True).alias("has_a")), "a", "left").join(nodes.select(F.col("asn").alias("b"), F.lit(True).alias("has_b")), "b", "left")
    good = F.col("has_a") & F.col("has_b") & F.col("rel").isin(0, -1)
    return ends.where(F.when(F.coalesce(good, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("an edge is not sound")).cast("boolean"))).drop("has_a", "has_b")


def adjacency(edges: DataFrame) -> DataFrame:
    """asn, nbr, role of the neighbour: peer, customer or provider."""
    role = lambda other: F.when(F.col("rel") == 0, "peer").otherwise(other)
    both = F.array(F.struct(F.col("a").alias("asn"), F.col("b").alias("nbr"), role("customer").alias("role")), F.struct(F.col("b").alias("asn"), F.col("a").alias("nbr"), role("provider").alias("role")))
    return edges.select(F.explode(both).alias("x")).select("x.*")


def degrees(adj: DataFrame) -> DataFrame:
    """asn, degree: distinct neighbours."""
    return adj.groupBy("asn").agg(F.countDistinct("nbr").alias("degree"))


def ordered_neighbours(adj: DataFrame, degree: DataFrame) -> DataFrame:
    """asn, nbr, role, degree of the neighbour, position by (-degree, asn)."""
    of = degree.select(F.col("asn").alias("nbr"), "degree")
    place = Window.partitionBy("asn").orderBy(F.desc("degree"), "nbr")
    return adj.join(of, "nbr").select("asn", "nbr", "role", "degree", F.row_number().over(place).alias("position"))


def with_groups(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Edges with the groups of both ends, ga and gb; edges with an end in no group are left out."""
    m = membership.select("asn", "grp")
    return edges.join(m.toDF("a", "ga"), "a").join(m.toDF("b", "gb"), "b")


def pair_edges(placed: DataFrame) -> DataFrame:
    """source, target, count, peer_count, provider_customer_count of unordered pairs of different groups."""
    return (
        placed.where("ga <> gb").groupBy(F.least("ga", "gb").alias("source"), F.greatest("ga", "gb").alias("target"))
        .agg(F.count("*").alias("count"), F.count_if(F.col("rel") == 0).alias("peer_count"), F.count_if(F.col("rel") == -1).alias("provider_customer_count"))
    )


def external_links(placed: DataFrame) -> DataFrame:
    """grp, external: crossing edges, each counted once on either side."""
    return placed.where("ga <> gb").select(F.explode(F.array("ga", "gb")).alias("grp")).groupBy("grp").agg(F.count("*").alias("external"))


def totals(placed: DataFrame) -> DataFrame:
    """Counts of links by relationship, within and between groups."""
    c = lambda cond, name: F.count_if(F.expr(cond)).alias(name)
    return placed.agg(F.count("*").alias("links"), c("rel = 0", "peer_links"), c("rel = -1", "provider_customer_links"), c("ga = gb", "within"), c("ga <> gb", "between"))


def external_neighbours(adj: DataFrame, membership: DataFrame) -> DataFrame:
    """grp, n: distinct neighbours outside the group."""
    m = membership.select("asn", "grp")
    j = adj.join(m, "asn").join(m.toDF("nbr", "nbr_grp"), "nbr").where("grp <> nbr_grp")
    return j.groupBy("grp").agg(F.countDistinct("nbr").alias("n"))


def external_organization_neighbours(adj: DataFrame, org_of: DataFrame) -> DataFrame:
    """org_id, nbr: neighbours of an organization's networks that belong to another."""
    o = org_of.select("asn", "org_id")
    return adj.join(o, "asn").join(o.toDF("nbr", "nbr_org"), "nbr").where("org_id <> nbr_org").select("org_id", "nbr").distinct()


def distance_histogram(distances: DataFrame) -> DataFrame:
    """grp, distances: how many members are at each distance, as a map."""
    counts = distances.groupBy("grp", "distance").agg(F.count("*").alias("n"))
    return counts.groupBy("grp").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("distance", "n")))).alias("distances"))


def seeds(membership: DataFrame, degree: DataFrame) -> DataFrame:
    """grp, seed: the member of the highest degree, of equals the lowest number."""
    return membership.join(degree, "asn").groupBy("grp").agg(F.max_by("asn", F.struct("degree", -F.col("asn"))).alias("seed"))


def group_sizes(membership: DataFrame, org_of: DataFrame) -> DataFrame:
    """grp, asns, organizations."""
    j = membership.join(org_of, "asn", "left").withColumn("org", F.coalesce("org_id", F.concat(F.lit("unknown-AS"), F.col("asn"))))
    return j.groupBy("grp").agg(F.count("*").alias("asns"), F.countDistinct("org").alias("organizations"))


def rank_groups(membership: DataFrame) -> DataFrame:
    """Names groups g01, g02 … by (-size, lowest number). The window runs over groups, not members."""
    sizes = membership.groupBy("grp").agg(F.count("*").alias("size"), F.min("asn").alias("lowest"))
    rank = F.row_number().over(Window.orderBy(F.desc("size"), "lowest"))
    return sizes.select("grp", "size", F.format_string("g%02d", rank).alias("gid"))


def members(membership: DataFrame, degree: DataFrame, info: DataFrame, orgs: DataFrame) -> DataFrame:
    """asn, grp, name, organization, country, degree, with defaults where nothing is known."""
    j = membership.join(degree, "asn", "left").join(info, "asn", "left").join(orgs.toDF("org_id", "org_name", "org_country"), "org_id", "left")
    return j.select("asn", "grp", F.coalesce("name", F.concat(F.lit("AS"), F.col("asn"))).alias("name"), F.coalesce("org_name", F.lit(UNKNOWN)).alias("organization"), F.coalesce("org_country", F.lit("")).alias("country"), F.coalesce("degree", F.lit(0)).alias("degree"))


def ranked_members(membership: DataFrame, degree: DataFrame, org_of: DataFrame) -> DataFrame:
    """grp, asn, degree, in_seed_org: whether a member belongs to the organization of its group's best-connected one."""
    known = membership.join(degree, "asn", "left").join(org_of.select("asn", "org_id"), "asn", "left").select("grp", "asn", F.coalesce("degree", F.lit(0)).alias("degree"), "org_id")
    seed = known.groupBy("grp").agg(F.max_by("org_id", F.struct("degree", -F.col("asn"))).alias("seed_org"))
    return known.join(seed, "grp").select("grp", "asn", "degree", F.coalesce(F.col("org_id") == F.col("seed_org"), F.lit(False)).alias("in_seed_org"))


def visible_members(ranked: DataFrame, first: int = 24, top: int = 96, most: int = 120) -> DataFrame:
    """The first of a group's seed organization, then its top members, without repeats, in that order.

    ranked: grp, asn, degree, in_seed_org. A top-k report; the ranks run within groups.
    """
    by_degree = [F.desc("degree"), F.col("asn")]
    own = ranked.where("in_seed_org").withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy(*by_degree))).where(F.col("place") <= first)
    rest = ranked.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy(*by_degree))).where(F.col("place") <= top).withColumn("place", F.col("place") + first)
    places = own.unionByName(rest).groupBy("grp", "asn").agg(F.min("place").alias("place"))
    order = Window.partitionBy("grp").orderBy("place")
    return places.select("grp", "asn", F.row_number().over(order).alias("position")).where(F.col("position") <= most)


def top_links(edges: DataFrame, degree: DataFrame, nodes: DataFrame, most: int = 1500) -> DataFrame:
    """The links between given nodes of one group by (-(sum of degrees), a, b). nodes: grp, asn. A top-k report."""
    n = nodes.select("grp", "asn")
    d = degree.select("asn", "degree")
    inside = edges.join(n.toDF("grp", "a"), "a").join(n.toDF("grp", "b"), ["grp", "b"])
    scored = inside.join(d.toDF("a", "da"), "a").join(d.toDF("b", "db"), "b").withColumn("weight", F.col("da") + F.col("db"))
    order = Window.partitionBy("grp").orderBy(F.desc("weight"), "a", "b")
    return scored.select("grp", "a", "b", "rel", "weight", F.row_number().over(order).alias("position")).where(F.col("position") <= most)


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """q = sum over groups of links within / links - (sum of degrees / 2 links) squared."""
    placed = with_groups(edges, membership)
    ends = placed.select(F.explode(F.array(F.struct(F.col("ga").alias("grp"), (F.col("ga") == F.col("gb")).cast("int").alias("inner")), F.struct(F.col("gb").alias("grp"), F.lit(0).alias("inner")))).alias("e")).select("e.*")
    per = ends.groupBy("grp").agg(F.count("*").alias("ends"), F.sum("inner").alias("links"))
    m = F.sum("ends") / 2
    return per.agg((F.sum("links") / m - F.sum((F.col("ends") * F.col("ends")).cast("double")) / (4 * m * m)).alias("modularity"))


def tile_of(position: Column, size: Column, target: int = TILE) -> Column:
    """1-based tile of a 0-based position among `size`: tiles of near-equal size, the larger ones first."""
    tiles = F.ceil(size / F.lit(target)).cast("bigint")
    base, rest = F.floor(size / tiles).cast("bigint"), size % tiles
    early = F.floor(position / (base + 1))
    late = rest + F.floor((position - rest * (base + 1)) / F.greatest(base, F.lit(1)))
    return (F.when(position < rest * (base + 1), early).otherwise(late) + 1).cast("int")


def tiles(ordered: DataFrame, target: int = TILE) -> DataFrame:
    """asn, grp, tile ("g01-c001"). ordered: asn, grp, position (0-based within the group)."""
    sizes = ordered.groupBy("grp").agg(F.count("*").alias("size"))
    number = tile_of(F.col("position"), F.col("size"), target)
    return ordered.join(sizes, "grp").select("asn", "grp", F.concat("grp", F.format_string("-c%03d", number)).alias("tile"))


def bucket(asn: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(asn, F.lit(buckets)).cast("int")


def tile_count(n: int, target: int = TILE) -> int:
    return math.ceil(n / target)


def manifest(placed: DataFrame, tiled: DataFrame) -> DataFrame:
    """Totals, links within tiles and between tiles of one group, invariants and tile sizes in one row."""
    sizes = tiled.groupBy("tile").agg(F.count("*").alias("n")).agg(F.count("*").alias("tiles"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.avg("n").alias("mean"), F.sum("n").alias("nodes"))
    t = tiled.select("asn", "tile")
    inner = placed.where("ga = gb").join(t.toDF("a", "ta"), "a").join(t.toDF("b", "tb"), "b")
    inner = inner.agg(F.count_if(F.expr("ta = tb")).alias("within_tiles"), F.count_if(F.expr("ta <> tb")).alias("between_tiles"))
    sound = (F.col("peer_links") + F.col("provider_customer_links") == F.col("links")) & (F.col("within_tiles") + F.col("between_tiles") + F.col("between") == F.col("links"))
    return totals(placed).crossJoin(sizes).crossJoin(inner).withColumn("sound", sound)


def same_nodes(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, equal: whether both tables hold the same asn values, counted with repeats."""
    both = a.select("asn", F.lit(1).alias("n")).union(b.select("asn", F.lit(-1).alias("n"))).groupBy("asn").agg(F.sum("n").alias("n"))
    return both.agg(F.coalesce(F.bool_and(F.col("n") == 0), F.lit(True)).alias("equal"))

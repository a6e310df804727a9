"""Routing tables: merging routes, longest-prefix match, statuses, comparisons.

Tables: routes(peer_id, family, prefix_len, prefix_key, path), where a null path is a real route that cannot be shown
and masks shorter prefixes; probes(probe_id, peer_id, ip).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import ip as ipf
from netloom.functions import paths as pf

KEY = ["peer_id", "family", "prefix_len", "prefix_key"]


def select_peers(entries: DataFrame, peers: DataFrame) -> DataFrame:
    """Entries of the listed sessions only; the optimizer broadcasts the list where it is small."""
    return entries.join(peers.select("peer_id").distinct(), "peer_id", "left_semi")


def attach_peers(entries: DataFrame, peers: DataFrame) -> DataFrame:
    """RIB entries with the peer that their index names."""
    return entries.join(peers, "peer_index")


def merge_routes(raw: DataFrame) -> DataFrame:
    """One route per key: the path where all rows agree on one, null where any is null or two differ. Paths are compared
    before repeats are collapsed. Combined before the shuffle, in any order."""
    merged = raw.groupBy(*KEY).agg(F.min("path").alias("lo"), F.max("path").alias("hi"), F.count("path").alias("known"), F.count("*").alias("n"))
    return merged.select(*KEY, F.when((F.col("known") == F.col("n")) & (F.col("lo") == F.col("hi")), F.col("lo")).alias("path"))


def table_size(raw: DataFrame, routes: DataFrame) -> DataFrame:
    """route_count and path_asns: the numbers in distinct paths, those of later masked routes too."""
    asns = raw.where("path IS NOT NULL").select("path").distinct().agg(F.coalesce(F.sum(F.size("path")), F.lit(0)).cast("bigint").alias("path_asns"))
    return routes.agg(F.count("*").alias("route_count")).crossJoin(asns)


def check_limits(size: DataFrame, max_routes: int | None = None, max_path_asns: int | None = None) -> DataFrame:
    """size, or an error where a limit that is set is passed or there is no route at all."""
    good = F.col("route_count") > 0
    if max_routes is not None:
        good &= F.col("route_count") <= max_routes
    if max_path_asns is not None:
        good &= F.col("path_asns") <= max_path_asns
    return size.where(F.when(good, F.lit(True)).otherwise(F.raise_error(F.lit("the routing table is empty or too large")).cast("boolean")))


def prefix_counts(routes: DataFrame, order: str = "family") -> DataFrame:
    """peer_id, family, n, seen: the least `order` of the family's routes."""
    return routes.groupBy("peer_id", "family").agg(F.count("*").alias("n"), F.min(order).alias("seen"))


def peer_metadata(counts: DataFrame, peers: DataFrame) -> DataFrame:
    """Sessions with routes: families in the order in which they were seen, and a map of prefix counts. peers: peer_id,
    peer_index."""
    seen = F.transform(F.array_sort(F.collect_list(F.struct("seen", "family"))), lambda x: x["family"])
    per = counts.groupBy("peer_id").agg(seen.alias("families"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("family").cast("string"), "n")))).alias("prefix_counts"))
    return peers.join(per, "peer_id")


def default_peer(counts: DataFrame, peers: DataFrame) -> DataFrame:
    """The first session, in file order, with IPv4 routes, else the first."""
    per = counts.groupBy("peer_id").agg(F.max(F.col("family") == 4).alias("has4")).join(peers, "peer_id")
    return per.agg(F.min_by("peer_id", F.struct(~F.col("has4"), F.col("peer_index"))).alias("default_peer"))


def longest_match(probes: DataFrame, routes: DataFrame) -> DataFrame:
    """peer_id, family, addr and, where a prefix covers it, the longest: prefix_len, prefix_key, path.

    probes: peer_id, family, addr. Equal probes are looked up once. Each address is masked to the prefix lengths that
    its session has, at most 33 or 129, and equi-joined on the key; paths are fetched for the best match only.
    """
    asked = probes.select("peer_id", "family", "addr").distinct()
    lengths = routes.groupBy("peer_id", "family").agg(F.collect_set("prefix_len").alias("lengths"))
    tries = asked.join(lengths, ["peer_id", "family"]).select("peer_id", "family", "addr", F.explode("lengths").alias("prefix_len"))
    tries = tries.withColumn("prefix_key", ipf.mask(F.col("addr"), F.col("prefix_len")))
    hits = tries.join(routes.select(*KEY), KEY)
    best = hits.groupBy("peer_id", "family", "addr").agg(F.max("prefix_len").alias("prefix_len")).withColumn("prefix_key", ipf.mask(F.col("addr"), F.col("prefix_len")))
    return best.join(routes, KEY)


def lookup(probes: DataFrame, routes: DataFrame) -> DataFrame:
    """probe_id, peer_id, ip, status, prefix, path (collapsed). Statuses, in order: invalid_ip, unknown_peer,
    missing_family, not_observed, unsupported_path, ok."""
    parsed = probes.withColumn("parsed", ipf.parse_ip(F.col("ip"))).select("probe_id", "peer_id", "ip", F.col("parsed.family").alias("family"), F.col("parsed.addr").alias("addr"))
    known = routes.groupBy("peer_id").agg(F.collect_set("family").alias("families"))
    best = longest_match(parsed.where("addr IS NOT NULL"), routes).withColumn("hit", F.lit(True))
    out = parsed.join(known, "peer_id", "left").join(best, ["peer_id", "family", "addr"], "left")
    status = (
        F.when(F.col("addr").isNull(), "invalid_ip").when(F.col("families").isNull(), "unknown_peer").when(~F.array_contains("families", F.col("family")), "missing_family")
        .when(F.col("hit").isNull(), "not_observed").when(F.col("path").isNull(), "unsupported_path").otherwise("ok")
    )
    shown = F.when(F.col("path").isNotNull(), ipf.prefix_text(F.col("family"), F.col("prefix_key"), F.col("prefix_len")))
    return out.select("probe_id", "peer_id", "ip", F.when(F.col("addr").isNotNull(), ipf.format_ip(F.col("family"), F.col("addr"))).alias("address"), status.alias("status"), shown.alias("prefix"), pf.collapse(F.col("path")).alias("path"))


def compare(pairs: DataFrame, routes: DataFrame) -> DataFrame:
    """Both lookups of each pair and the paths' common trunk, branches and class. pairs: pair_id, peer_id, ip_a, ip_b."""
    sides = pairs.select("pair_id", "peer_id", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("ip_a").alias("ip")), F.struct(F.lit("b").alias("side"), F.col("ip_b").alias("ip")))).alias("s"))
    found = lookup(sides.select(F.struct("pair_id", "s.side").alias("probe_id"), "peer_id", "s.ip"), routes)
    of = lambda c, s: F.max(F.when(F.col("probe_id.side") == s, F.col(c))).alias(f"{c}_{s}")
    both = found.groupBy(F.col("probe_id.pair_id").alias("pair_id"), "peer_id").agg(*[of(c, s) for c in ("address", "status", "prefix", "path") for s in "ab"])
    return with_comparison(both, F.col("path_a"), F.col("path_b"))


def with_comparison(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Adds trunk, branch_a, branch_b, later_common and relation of two paths; null where either is."""
    both = a.isNotNull() & b.isNotNull()
    only = lambda c: F.when(both, c)
    return df.withColumns({"trunk": only(pf.trunk(a, b)), "branch_a": only(pf.branch(a, b)), "branch_b": only(pf.branch(b, a)), "later_common": only(pf.later_common(a, b)), "relation": only(pf.comparison(a, b))})


def pick_observer(a: DataFrame, key: dict, order: str) -> DataFrame:
    """The first row, by `order`, of the observer that a key names."""
    own = a
    for c, v in key.items():
        own = own.where(F.col(c) == v)
    return own.orderBy(order).limit(1)


def shared_observers(a: DataFrame, b: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of a whose observer also occurs in b, the first by `order` of each observer."""
    shared = a.join(b.select(*keys).distinct(), keys, "left_semi")
    first = Window.partitionBy(*keys).orderBy(order)
    return shared.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")

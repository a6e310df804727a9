"""The engine's API: load and publish a routing table, look up and compare addresses, open scenes."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import dates
from netloom.operators import explorer, routing
from netloom.plans.publish import Published
from netloom.session import ship
from netloom.sources.mrt import DEFAULT_PEERS, MrtDataSource

COLLECTOR = {"id": "hkix.hkg", "location": "Hong Kong, HKIX"}
TAG = "netloom-load"


class Engine:
    """Holds published snapshots below a root in shared storage. One load runs at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = ship(spark)
        self.spark.dataSource.register(MrtDataSource)
        self.store, self.busy, self.explorer = Published(spark, root), threading.Lock(), {}

    def read(self, path: str, table: str, peers: str = DEFAULT_PEERS, expected_date: str | None = None) -> DataFrame:
        r = self.spark.read.format("mrt").option("table", table).option("peers", peers).option("path", path)
        return (r.option("expected_date", expected_date) if expected_date else r).load()

    def load_rib(self, path: str, expected_date: str | None = None, peers: str = DEFAULT_PEERS, max_routes: int | None = None, max_path_asns: int | None = None) -> str:
        """Reads, checks, merges and publishes a dump; returns the snapshot's place. Any error leaves the old one."""
        if not self.busy.acquire(blocking=False):
            raise RuntimeError("a load is running")
        self.spark.addTag(TAG)
        try:
            sessions = self.read(path, "peers", peers, expected_date).where("selected")
            name = sessions.agg(F.max("observed").alias("t")).select(dates.snapshot_id(F.lit(expected_date).cast("date")) if expected_date else dates.local_id(F.col("t"))).first()[0]
            with self.store.staged(self.read(path, "routes", peers, expected_date)) as raw:  # each file is decoded once
                routes = routing.merge_routes(raw)
                size = routing.check_limits(routing.table_size(raw, routes), max_routes, max_path_asns)
                return self.store.publish({"size": size, "routes": routes, "peers": sessions}, name or "local")
        finally:
            self.spark.removeTag(TAG)
            self.busy.release()

    def cancel(self) -> None:
        self.spark.interruptTag(TAG)

    def progress(self) -> list[tuple[int, int, int]]:
        """(stage, tasks done, tasks) of what runs now."""
        t = self.spark.sparkContext.statusTracker()
        stages = [s for i in t.getActiveStageIds() if (s := t.getStageInfo(i))]
        return [(s.stageId, s.numCompletedTasks, s.numTasks) for s in stages]

    def metadata(self) -> DataFrame:
        """A row per session with routes: families, prefix counts, whether it is the default."""
        routes, peers = self.store.table("routes"), self.store.table("peers")
        counts = routing.prefix_counts(routes)
        default = routing.default_peer(counts, peers)
        return routing.peer_metadata(counts, peers).join(F.broadcast(default), F.col("peer_id") == F.col("default_peer"), "left").withColumn("is_default", F.col("default_peer").isNotNull()).drop("default_peer")

    def lookup(self, probes: DataFrame) -> DataFrame:
        return routing.lookup(probes, self.store.table("routes"))

    def compare_paths(self, ip_a: str, ip_b: str, peer_id: str | None = None) -> DataFrame:
        """Both addresses from one session, the default one if none is named. Blank input, an address that cannot be read, and an unknown session are errors."""
        if not ip_a.strip() or not ip_b.strip():
            raise ValueError("two addresses are needed")
        if peer_id is None:
            routes, peers = self.store.table("routes"), self.store.table("peers")
            peer_id = routing.default_peer(routing.prefix_counts(routes), peers).first().default_peer
        pair = self.spark.createDataFrame([(0, peer_id, ip_a.strip(), ip_b.strip())], "pair_id int, peer_id string, ip_a string, ip_b string")
        out = routing.compare(pair, self.store.table("routes"))
        wrong = F.col("status_a").isin("invalid_ip", "unknown_peer") | F.col("status_b").isin("invalid_ip", "unknown_peer")
        return out.where(F.when(wrong, F.raise_error(F.lit("no such address or session")).cast("boolean")).otherwise(F.lit(True))).withColumns({"collector": F.lit(COLLECTOR["id"]), "location": F.lit(COLLECTOR["location"])})

    def use_topology(self, **tables: DataFrame) -> None:
        """groups, group_links, tiles, tile_links, nodes, node_links, adjacency, index."""
        self.explorer.update(tables)

    def scene(self, kind: str, key: str | int | None = None) -> tuple[DataFrame, DataFrame]:
        t = self.explorer
        if kind == "world":
            return explorer.world_scene(t["groups"], t["group_links"])
        if kind == "group":
            return explorer.group_scene(t["tiles"], t["tile_links"], str(key))
        if kind == "tile":
            return explorer.tile_scene(t["nodes"], t["node_links"], str(key))
        if kind == "as":
            return explorer.as_scene(t["adjacency"], t["index"], int(key))
        raise ValueError(f"no scene of kind {kind}")

    def expand_network_group(self, group: str) -> tuple[DataFrame, DataFrame]:
        return self.scene("group", group)

    def overview(self) -> DataFrame:
        """Totals of networks, groups and links between groups."""
        g, links = self.explorer["groups"], self.explorer["group_links"]
        return g.agg(F.count("*").alias("groups"), F.sum("count").alias("networks")).crossJoin(links.agg(F.count("*").alias("group_pairs"), F.sum("count").alias("links")))

"""The explorer: search, deep links, and the four kinds of scene as node and link tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators import layout
from netloom.operators.topology import bucket


def search(index: DataFrame, query: str, most: int = 20) -> DataFrame:
    """asn, grp, tile, name, degree. Digits, with or without "AS", look up one number as it is written; other text is
    sought in names, the first `most` by number. index: asn, grp, tile, name, degree."""
    q = F.lower(F.regexp_replace(F.regexp_replace(F.lit(query), r"^\s+|\s+$", ""), r"(?i)^AS(?=\d)", ""))
    digits, asn = q.rlike(r"^\d+$"), F.col("asn").cast("string")
    hit = F.when(q == "", F.lit(False)).when(digits, asn == q).otherwise(F.contains(F.lower("name"), q))
    return index.where(hit).orderBy("asn").limit(most)


def local_filter(nodes: DataFrame, query: str, centre: int | None = None) -> DataFrame:
    """Nodes of a scene whose label or subtitle holds the text, without the centre of an AS scene."""
    found = nodes if centre is None else nodes.where(F.col("asn").isNull() | (F.col("asn") != centre))
    return found.where(F.contains(F.lower(F.concat_ws(" ", "label", "sub")), F.lit(query.lower()))) if query else found


def deep_link(asn: Column, tile: Column, grp: Column) -> Column:
    """STRUCT<kind, id> that an address opens: an AS before a tile before a group; null where none is well formed."""
    to = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("id"))
    return F.when(asn.rlike(r"^\d+$"), to("as", asn)).when(tile.rlike(r"^g\d{2}-c\d{3}$"), to("tile", tile)).when(grp.rlike(r"^g\d{2}$"), to("group", grp))


def neighbours(adj: DataFrame, index: DataFrame, asn: int) -> DataFrame:
    """nbr, role, name, degree, grp of an AS's neighbours by descending degree, with defaults for unlisted ones. Only
    the bucket of the AS is read where the table is partitioned by it."""
    own = adj.where(F.col("asn") == asn)
    if "bucket" in adj.columns:
        own = own.where(F.col("bucket") == bucket(F.lit(asn)))
    known = index.select(F.col("asn").alias("nbr"), "grp", "name", "degree")
    j = own.select("nbr", "role").join(known, "nbr", "left")
    return j.select("nbr", "role", F.coalesce("name", F.concat(F.lit("AS"), F.col("nbr"))).alias("name"), F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("grp", F.lit("g01")).alias("grp")).orderBy(F.desc("degree"), "nbr")


def as_scene(adj: DataFrame, index: DataFrame, asn: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of an AS and its direct neighbours, on a ring spiral."""
    near = neighbours(adj, index, asn)
    order = Window.partitionBy(F.lit(asn)).orderBy(F.desc("degree"), "nbr")  # the neighbours of one AS
    placed = near.withColumn("i", F.row_number().over(order) - 1).crossJoin(near.agg(F.count("*").alias("n")))
    x, y = layout.ring_spiral(F.col("i"), F.col("n"))
    shape = lambda a, name, degree, x, y, grp: [a.cast("string").alias("id"), a.cast("bigint").alias("asn"), F.concat(F.lit("AS"), a.cast("string")).alias("label"), name.alias("sub"), degree.cast("bigint").alias("count"), x.cast("double").alias("x"), y.cast("double").alias("y"), layout.group_color(grp).alias("color")]
    centre = index.where(F.col("asn") == asn).select(*shape(F.col("asn"), F.col("name"), F.col("degree"), F.lit(0.0), F.lit(0.0), F.col("grp")))
    nodes = centre.unionByName(placed.select(*shape(F.col("nbr"), F.col("name"), F.col("degree"), x, y, F.col("grp"))))
    links = near.select(F.lit(str(asn)).alias("source"), F.col("nbr").cast("string").alias("target"), F.lit(1).alias("count"), F.col("role").alias("relationship"))
    return nodes, links


def world_scene(groups: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """groups: id, label, seed, count, rank (0-based). Groups are few: their number is bounded by the merging."""
    x, y = layout.world_spiral(F.col("rank"))
    nodes = groups.select("id", layout.short_label(F.col("label")).alias("label"), F.concat(F.lit("AS"), F.col("seed")).alias("sub"), "count", x.alias("x"), y.alias("y"), layout.group_color(F.col("id")).alias("color"))
    return nodes, links


def group_scene(tiles: DataFrame, links: DataFrame, grp: str) -> tuple[DataFrame, DataFrame]:
    """tiles: id, grp, label, seed, count, x, y; links: grp, source, target, count."""
    nodes = tiles.where(F.col("grp") == grp).select("id", "label", F.concat(F.lit("AS"), F.col("seed")).alias("sub"), "count", "x", "y", layout.group_color(F.col("grp")).alias("color"))
    return nodes, links.where(F.col("grp") == grp).drop("grp")


def tile_scene(nodes: DataFrame, links: DataFrame, tile: str) -> tuple[DataFrame, DataFrame]:
    """nodes: tile, asn, name, degree, grp, x, y; links: tile, a, b, relationship."""
    own = nodes.where(F.col("tile") == tile).select(F.col("asn").cast("string").alias("id"), "asn", F.concat(F.lit("AS"), F.col("asn")).alias("label"), F.col("name").alias("sub"), F.col("degree").alias("count"), "x", "y", layout.group_color(F.col("grp")).alias("color"))
    near = links.where(F.col("tile") == tile).select(F.col("a").cast("string").alias("source"), F.col("b").cast("string").alias("target"), F.lit(1).alias("count"), "relationship")
    return own, near


def names_of(paths: DataFrame, names: DataFrame, column: str = "path") -> DataFrame:
    """asn, name, organization of every number in the paths; with the bucket in the join, a table that is partitioned
    by it is read only where needed."""
    asked = paths.select(F.explode(column).alias("asn")).distinct().withColumn("bucket", bucket(F.col("asn")))
    keys = ["asn", "bucket"] if "bucket" in names.columns else ["asn"]
    return asked.join(names, keys, "left").select("asn", "name", "organization")


def page(rows: DataFrame, order: list, start: int = 0, size: int = 60) -> DataFrame:
    """A page of a list: a report of `size` rows."""
    return rows.orderBy(*order).offset(start).limit(size)


def relation_label(role: Column) -> Column:
    return F.when(role == "peer", "peer network").when(role == "provider", "upstream network").when(role == "customer", "downstream network").otherwise("AS relationship")

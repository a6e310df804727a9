"""Positions and sizes for drawing: spirals, bounding-box scaling, spring layout, radii, widths, colours, labels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GOLDEN = 2.399963
WIDTH, HEIGHT = 840, 680
# The map's group colours and the snapshot's palette.
COLORS = ["#2563eb", "#059c86", "#7a5bcc", "#008db3", "#d39429"]
PALETTE = ["#56c8e8", "#9ba3f7", "#5dd6ad", "#ebba70", "#e58bc4", "#f28282", "#74bbf0", "#c3c971", "#7cd4c7", "#b895e2", "#ddaa86", "#97c6d8", "#84be94", "#e4d18a", "#c28298", "#9cbded", "#d8a96e", "#a6d2b9", "#c7b8eb", "#e6a8a0"]


def world_spiral(i: Column) -> tuple[Column, Column]:
    r = F.sqrt(i + 1) * 100
    return F.cos(i * GOLDEN) * r, F.sin(i * GOLDEN) * r


def ring_spiral(i: Column, n: Column) -> tuple[Column, Column]:
    r = 120 + F.sqrt((i + 1) / F.greatest(n, F.lit(1))) * 440
    return F.cos(i * GOLDEN) * r, F.sin(i * GOLDEN) * r


def normalise(nodes: DataFrame, scene: str) -> DataFrame:
    """x and y centred on their scene's bounding box and scaled by its larger side to 840 x 680."""
    box = nodes.groupBy(scene).agg(*[f(c).alias(f"{c}_{n}") for c in "xy" for f, n in ((F.min, "lo"), (F.max, "hi"))])
    span = F.greatest(F.col("x_hi") - F.col("x_lo"), F.col("y_hi") - F.col("y_lo"), F.lit(1.0))
    at = lambda c, size: (F.col(c) - (F.col(f"{c}_lo") + F.col(f"{c}_hi")) / 2) / span * size
    return nodes.join(box, scene).withColumns({"x": at("x", WIDTH), "y": at("y", HEIGHT)}).select(*nodes.columns)


def radius(kind: Column, count: Column, centre: Column) -> Column:
    """Radius of a node in a world, group, tile or AS scene."""
    return F.when(kind == "world", 12 + F.sqrt(count / 23545) * 17).when(kind == "group", 8 + F.sqrt(count / 300) * 9).when(centre, F.lit(17.0)).otherwise(4 + F.least(F.lit(5.0), F.log2(count + 1) * 0.5))


def label_stride(rank: Column, stride: int) -> Column:
    """Whether a node's label is drawn when every stride-th is."""
    return rank % stride == 0


def group_color(grp: Column) -> Column:
    number = F.regexp_replace(grp, r"\D", "").try_cast("int")
    return F.coalesce(F.get(F.array(*map(F.lit, COLORS)), (number - 1) % len(COLORS)), F.lit(COLORS[0]))


def palette_color(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, PALETTE)), (F.pmod(rank, F.lit(len(PALETTE))) + 1).cast("int"))


def short_label(label: Column) -> Column:
    return F.when(F.length(label) > 25, F.concat(F.substring(label, 1, 23), F.lit("…"))).otherwise(label)


def in_view(x: Column, y: Column, left: float, top: float, right: float, bottom: float, margin: float = 0) -> Column:
    return x.between(left - margin, right + margin) & y.between(top - margin, bottom + margin)


def nearest(nodes: DataFrame, x: float, y: float, reach: float) -> DataFrame:
    """The node nearest to a point, within reach."""
    d = F.hypot(F.col("x") - x, F.col("y") - y)
    return nodes.withColumn("_d", d).where(F.col("_d") <= reach).agg(F.min_by("id", F.struct("_d", "id")).alias("id"))


def spring(nodes: DataFrame, edges: DataFrame, key: str = "tile", rounds: int = 28, seed: int = 42) -> DataFrame:
    """key, asn, x, y: a force-directed layout of each tile, coordinates in [-1, 1] rounded to 5 places.

    Tiles are bounded in size, so each fits one grouped Pandas call. nodes: key, asn; edges: key, a, b.
    """
    packed = edges.groupBy(key).agg(F.collect_list(F.struct("a", "b")).alias("links"))
    grouped = nodes.groupBy(key).agg(F.array_sort(F.collect_list("asn")).alias("asns")).join(packed, key, "left")
    kind = nodes.schema[key].dataType.simpleString()

    def place(batches):
        for pdf in batches:
            out = []
            for name, asns, links in zip(pdf[key], pdf["asns"], pdf["links"], strict=True):
                xy = forces([int(a) for a in asns], [] if links is None else [(int(e["a"]), int(e["b"])) for e in links], rounds, seed)
                out.append(pd.DataFrame({key: name, "asn": asns, "x": xy[:, 0], "y": xy[:, 1]}))
            if out:
                yield pd.concat(out)

    return grouped.mapInPandas(place, f"{key} {kind}, asn bigint, x double, y double")


def forces(asns: list[int], links: list[tuple[int, int]], rounds: int, seed: int) -> np.ndarray:
    """Repulsion k^2/d between all nodes, attraction d^2/k along links, steps that shrink to nothing."""
    n, at = len(asns), {a: i for i, a in enumerate(asns)}
    rng = np.random.default_rng(seed)
    xy = rng.uniform(-1, 1, (n, 2))
    if n == 1:
        return np.zeros((1, 2))
    e = np.array([(at[a], at[b]) for a, b in links if a in at and b in at], int).reshape(-1, 2)
    k = 1.65 / math.sqrt(n)
    for r in range(rounds):
        gap = xy[:, None] - xy[None]
        d = np.maximum(np.sqrt((gap**2).sum(2)), 0.01)
        push = (gap * (k * k / d**2)[..., None]).sum(1)
        if len(e):
            g = xy[e[:, 0]] - xy[e[:, 1]]
            pull = g * (np.maximum(np.sqrt((g**2).sum(1)), 0.01) / k)[:, None]
            np.add.at(push, e[:, 0], -pull)
            np.add.at(push, e[:, 1], pull)
        size = np.maximum(np.sqrt((push**2).sum(1, keepdims=True)), 0.01)
        xy = xy + push / size * 0.1 * (1 - r / rounds)
    xy -= xy.mean(0)
    return np.round(xy / max(np.abs(xy).max(), 1e-9), 5)


def link_widths(links: DataFrame, scene: str) -> DataFrame:
    """Links with their count as a share of their scene's largest."""
    return links.withColumn("share", F.col("count") / F.max("count").over(Window.partitionBy(scene)))

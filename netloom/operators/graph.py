"""Graph operators: breadth-first order and distances, components, communities.

Loops are level by level over DataFrames; each round is written to the shared folder, which cuts lineage and
survives lost executors. Only counts reach the driver, for community merging one row per community pair, and for
communities by modularity some numbers per node.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.topology import rank_groups
from netloom.session import cut, ship

ROUNDS = 200
PACK, FIT = 1 << 20, 1 << 21  # links of a packed row; of a level that is worked off without Spark
MASK = 0xFFFFFFFF


def distances(starts: DataFrame, adj: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """grp, asn, distance from the group's start along edges within the group. starts: grp, asn; adj: grp, asn, nbr."""
    front = found = cut(starts.select("grp", "asn", F.lit(0).alias("distance")))
    adj = cut(adj.select("grp", "asn", "nbr"))  # else every level derives it anew
    for d in range(1, rounds):  # each level is written once; what was found is the union of the levels
        new = front.join(adj, ["grp", "asn"]).select("grp", F.col("nbr").alias("asn")).distinct().join(found, ["grp", "asn"], "left_anti")
        front = cut(new.withColumn("distance", F.lit(d)))
        if front.isEmpty():
            return found
        found = found.unionByName(front)
    raise RuntimeError(f"distances did not end in {rounds} rounds")


def components(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """asn, component: the smallest number reachable. Labels spread to neighbours and jump to their label's label."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(nodes.select("asn", F.col("asn").alias("component")).distinct())
    for _ in range(rounds):
        near = both.join(labels.toDF("b", "near"), "b").groupBy(F.col("a").alias("asn")).agg(F.min("near").alias("near"))
        spread = labels.join(near, "asn", "left").select("asn", F.least("component", F.coalesce("near", "component")).alias("label"))
        jump = spread.select(F.col("asn").alias("label"), F.col("label").alias("further"))
        new = cut(spread.join(jump, "label", "left").select("asn", F.least("label", F.coalesce("further", "label")).alias("component")))
        moved = new.join(labels.toDF("asn", "old"), "asn").where("component <> old").isEmpty()
        labels = new
        if moved:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def breadth_first(nodes: DataFrame, adj: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """grp, asn, position (0-based): the order in which a queue visits each group's nodes, starting from the node of the
    highest degree, neighbours by (-degree, asn), further components by their best node.

    nodes: grp, asn, degree; adj: grp, asn, nbr within groups. The queue's order is by component, level, the earliest
    parent's place, then (-degree, asn): each level is one join and one window within a component's level. A position is a
    place plus the sizes of all earlier levels, so no window holds a whole group.
    """
    nodes = cut(nodes.select("grp", "asn", "degree"))
    adj = cut(adj.select("grp", "asn", "nbr").distinct())
    comp = components(nodes, adj.select(F.col("asn").alias("a"), F.col("nbr").alias("b")), rounds)
    nodes = cut(nodes.join(comp, "asn"))
    best = nodes.groupBy("grp", "component").agg(F.max_by(F.struct("asn", "degree"), F.struct("degree", -F.col("asn"))).alias("seed"))
    order = Window.partitionBy("grp").orderBy(F.desc("seed.degree"), "seed.asn")
    ranked = cut(best.select("grp", "component", "seed.asn", F.row_number().over(order).alias("rank")))
    found = cut(ranked.select("grp", "component", "asn", F.lit(0).alias("level"), F.lit(1).alias("place")))
    front = found
    for level in range(1, rounds):
        reached = front.join(adj, ["grp", "asn"]).groupBy("grp", "component", F.col("nbr").alias("asn")).agg(F.min("place").alias("parent"))
        new = reached.join(found, ["grp", "asn"], "left_anti").join(nodes.select("grp", "asn", "degree"), ["grp", "asn"])
        turn = Window.partitionBy("grp", "component").orderBy("parent", F.desc("degree"), "asn")
        front = cut(new.select("grp", "component", "asn", F.lit(level).alias("level"), F.row_number().over(turn).alias("place")))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    else:
        raise RuntimeError(f"the search did not end in {rounds} rounds")
    sizes = found.groupBy("grp", "component", "level").agg(F.count("*").alias("n")).join(ranked.select("component", "rank"), "component")
    before = Window.partitionBy("grp").orderBy("rank", "level").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("grp", "component", "level", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    return found.join(shifts, ["grp", "component", "level"]).select("grp", "asn", (F.col("shift") + F.col("place") - 1).alias("position"))


def not_connected(starts: DataFrame, nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """Nodes of a group that its start does not reach; empty for connected groups."""
    return nodes.select("grp", "asn").join(distances(starts, adj), ["grp", "asn"], "left_anti")


def community_pairs(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """source, target, n: edges between communities, both ways."""
    m = membership.select("asn", "grp")
    j = edges.join(m.toDF("a", "ga"), "a").join(m.toDF("b", "gb"), "b").where("ga <> gb")
    return j.select(F.explode(F.array(F.struct(F.col("ga").alias("source"), F.col("gb").alias("target")), F.struct(F.col("gb").alias("source"), F.col("ga").alias("target")))).alias("p")).groupBy("p.source", "p.target").agg(F.count("*").alias("n"))


def merge_step(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: the smallest community by (size, lowest number) and the neighbour it joins, by (links, size, -lowest)."""
    sizes = membership.groupBy("grp").agg(F.count("*").alias("size"), F.min("asn").alias("lowest"))
    smallest = sizes.agg(F.min(F.struct("size", "lowest", "grp")).alias("s")).select(F.col("s.grp").alias("source"))
    near = community_pairs(edges, membership).join(smallest, "source").join(sizes.withColumnRenamed("grp", "target"), "target")
    return near.groupBy("source").agg(F.max_by("target", F.struct("n", "size", -F.col("lowest"))).alias("target"))


def merge_communities(edges: DataFrame, membership: DataFrame, most: int = 20) -> DataFrame:
    """asn, grp with at most `most` communities. Edges are aggregated once by Spark; the merging itself runs on one row
    per community pair. An isolated smallest community is an error."""
    sizes = {r.grp: (r.size, r.lowest) for r in membership.groupBy("grp").agg(F.count("*").alias("size"), F.min("asn").alias("lowest")).toLocalIterator()}
    links: dict = {g: {} for g in sizes}
    for r in community_pairs(edges, membership).toLocalIterator():
        links[r.source][r.target] = r.n
    into: dict = {}
    while len(sizes) > most:
        small = min(sizes, key=sizes.get)
        if not links[small]:
            raise ValueError(f"community {small} has no neighbour")
        target = max(links[small], key=lambda g: (links[small][g], sizes[g][0], -sizes[g][1]))
        into[small] = target
        sizes[target] = sizes[target][0] + sizes[small][0], min(sizes[target][1], sizes[small][1])
        del sizes[small]
        for g, n in links.pop(small).items():
            links[g].pop(small)
            if g != target:
                links[target][g] = links[target].get(g, 0) + n
                links[g][target] = links[g].get(target, 0) + n

    def last(g):
        while g in into:
            g = into[g]
        return g

    kind = membership.schema["grp"].dataType.simpleString()
    moves = membership.sparkSession.createDataFrame([(g, last(g)) for g in into], f"grp {kind}, merged {kind}")
    return membership.join(moves, "grp", "left").select("asn", F.coalesce("merged", "grp").alias("grp"))


def split_communities(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """asn, grp: each connected part of a community on its own, named by its lowest number."""
    m = membership.select("asn", "grp")
    inner = edges.join(m.toDF("a", "ga"), "a").join(m.toDF("b", "gb"), "b").where("ga = gb")
    return components(m, inner.select("a", "b")).select("asn", F.col("component").alias("grp"))


def settle_communities(edges: DataFrame, membership: DataFrame, most: int = 20) -> DataFrame:
    """asn, grp (g01 …): found communities, split into connected parts, merged until `most` are left, ranked by size."""
    merged = cut(merge_communities(edges, cut(split_communities(edges, membership)), most))
    return merged.join(rank_groups(merged).select("grp", "gid"), "grp").select("asn", F.col("gid").alias("grp"))


def propagate_communities(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """asn, grp by deterministic label propagation: each node takes its neighbours' most frequent label, of equals the
    smallest, on alternate halves of the nodes so that labels settle. Its quality is judged by modularity."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(nodes.select("asn", F.col("asn").alias("grp")).distinct())
    still = 0
    for turn in range(rounds):
        votes = both.join(labels.toDF("b", "label"), "b").groupBy(F.col("a").alias("asn"), "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("asn").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))
        moves = F.pmod(F.xxhash64("asn"), F.lit(2)) == turn % 2
        new = cut(labels.join(best, "asn", "left").select("asn", F.when(moves, F.coalesce("label", "grp")).otherwise(F.col("grp")).alias("grp")))
        still = still + 1 if new.join(labels.toDF("asn", "old"), "asn").where("grp <> old").isEmpty() else 0
        labels = new
        if still == 2:
            return labels
    raise RuntimeError(f"labels did not settle in {rounds} rounds")


def modularity_communities(nodes: DataFrame, edges: DataFrame, least: float = 1e-4, fit: int = FIT) -> DataFrame:
    """asn, grp (a community's lowest number): communities that raise modularity, by moves and contraction in turn.

    Within a level each node may join the neighbouring community of the highest gain, of equals the lowest; a level's
    communities are the nodes of the next. In a round a community either gives or takes nodes, by a bit of its hash, so
    that no two nodes swap places; a node is drawn with a chance that falls with the strength that wants into its target
    and out of its own community, since many joining at once would gain less than each alone. A round that lowers
    modularity is undone and tried with a quarter of the chance. A level ends when no node wants to move, or after three
    rounds with moves and a gain below `least`, or undone rounds at a chance of 1/64; levels end when one gains less than
    `least`. So every loop ends, and modularity never falls. Repeated links count once; links of a node with itself or with
    an end that is no node do not count; a node without links stays alone.

    Links are shuffled once a level and packed in the shared folder, each node's in one row; a round reads them where they
    lie and moves none. The driver holds some numbers per node (its community and strength, about 60 bytes in all) and hands
    them to the tasks, which answer with the nodes that want to move. A level of at most `fit` links is worked off without
    Spark. The result does not depend on `fit` or on how links are dealt.
    """
    ship(nodes.sparkSession)
    kind = nodes.schema["asn"].dataType.simpleString()
    own = cut(nodes.where("asn IS NOT NULL").select(F.col("asn").cast("bigint").alias("asn")).distinct())
    ids = np.sort(own.toArrow().column(0).to_numpy())
    ends = edges.where("a <> b").select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    both = ends.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*", F.lit(1).cast("bigint").alias("w"))
    links = _Links(both, fit, ids)
    k = np.zeros(len(ids), np.int64)
    for i, s in links.each(_strengths):
        k[i] = s
    total, loops = int(k.sum()), np.zeros(len(ids), np.int64)  # each link counts from both ends
    member, reached = np.arange(len(ids), dtype=np.int32), None
    while total:
        label, quality = _raise_modularity(links, k, loops, total, least)
        names, label = np.unique(label, return_inverse=True)
        label = label.astype(np.int32)
        member = label[member]
        if reached is not None and quality <= reached + least:
            break
        reached = quality
        links, inner = links.contracted(label, len(names))
        k, loops = (np.bincount(label, x, len(names)).astype(np.int64) for x in (k, loops))  # sums below 2^53
        loops += inner
    first = np.full(len(ids), len(ids))
    np.minimum.at(first, member, np.arange(len(ids)))
    return own.mapInArrow(_named(ids, ids[first[member]]), "asn bigint, grp bigint").select(F.col("asn").cast(kind).alias("asn"), F.col("grp").cast(kind).alias("grp"))


def _named(ids: np.ndarray, names: np.ndarray):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[np.searchsorted(ids, b.column(0).to_numpy())])], ["asn", "grp"])

    return run


def _packing(ids: np.ndarray | None):
    """Rows (a, b, w) sorted by a, as rows of PACK links or so that hold all links of their nodes: both ends' places among
    ids, and weights unless all are 1. Links with an end outside ids go, and repeated ones."""

    def pack(parts):
        a, b, w = (np.concatenate(x) for x in zip(*parts, strict=True))
        if ids is not None:
            x, y = np.searchsorted(ids, a), np.searchsorted(ids, b)
            known = (ids[np.minimum(x, len(ids) - 1)] == a) & (ids[np.minimum(y, len(ids) - 1)] == b) if len(ids) else np.zeros(len(a), bool)
            a, b, w = x[known], y[known], w[known]
        key, at = np.unique(a.astype(np.int64) << 32 | b.astype(np.int64), return_index=True)
        w = w[at]
        columns = [(key >> 32).astype(np.int32).tobytes(), (key & MASK).astype(np.int32).tobytes(), b"" if (w == 1).all() else w.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([len(key)], pa.int64()), *(pa.array([c], pa.binary()) for c in columns)], ["n", "a", "b", "w"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            now = tuple(c.to_numpy() for c in batch.columns)
            if not len(now[0]):
                continue
            if n >= PACK and (now[0] != held[-1][0][-1]).any():
                end = int(np.searchsorted(now[0], held[-1][0][-1], "right"))
                yield pack([*held, tuple(c[:end] for c in now)])
                held, n, now = [], 0, tuple(c[end:] for c in now)
            held.append(now)
            n += len(now[0])
        if held:
            yield pack(held)

    return run


class _Links:
    """A level's links from both ends, packed: in the shared folder, or in memory if they are at most `fit`."""

    def __init__(self, links: DataFrame | None, fit: int, ids: np.ndarray | None = None, rows: list | None = None):
        self.fit, self.rows = fit, rows
        if rows is None:
            self.table = cut(links.repartition("a").sortWithinPartitions("a").mapInArrow(_packing(ids), "n long, a binary, b binary, w binary"))
            if (self.table.agg(F.sum("n").alias("n")).first().n or 0) <= fit:
                self.rows = [_unpacked(r) for r in self.table.collect()]

    def each(self, f) -> list:
        """f(a, b, w) of each row."""
        if self.rows is not None:
            return [f(*r) for r in self.rows]

        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(f(*_unpacked(r))) for r in batch.to_pylist()], pa.binary())], ["x"])

        return [pickle.loads(r.x) for r in self.table.mapInArrow(run, "x binary").collect()]

    def contracted(self, label: np.ndarray, size: int) -> tuple[_Links, np.ndarray]:
        """The links between communities, and each community's weight within."""
        if self.rows is not None:
            parts = [_joined(label, *r) for r in self.rows] or [(np.zeros(0, np.int64),) * 3]
            a, b, w = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            inner = a == b
            sums = np.bincount(a[inner], w[inner], size).astype(np.int64)
            return _Links(None, self.fit, rows=[(a[~inner], b[~inner], w[~inner])]), sums

        def run(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in _joined(label, *_unpacked(r))], ["a", "b", "w"])

        joined = cut(self.table.mapInArrow(run, "a long, b long, w long").groupBy("a", "b").agg(F.sum("w").alias("w")))
        sums = np.zeros(size, np.int64)
        inner = joined.where("a = b").select("a", "w").toArrow()
        sums[inner.column(0).to_numpy()] = inner.column(1).to_numpy()
        return _Links(joined.where("a <> b"), self.fit), sums


def _unpacked(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = np.frombuffer(r["a"], np.int32)
    return a, np.frombuffer(r["b"], np.int32), np.frombuffer(r["w"], np.int64) if r["w"] else np.ones(len(a), np.int64)


def _summed(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links with the weights of equal ones summed, sorted."""
    if not len(a):
        return a, b, w
    key = a.astype(np.int64) << 32 | b
    order = np.argsort(key)
    key = key[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[start] >> 32, key[start] & MASK, np.add.reduceat(w[order], start)


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray):
    return _summed(label[a], label[b], w)


def _strengths(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
    return a[start], np.add.reduceat(w, start) if len(a) else start


def _wishes(label: np.ndarray, k: np.ndarray, strength: np.ndarray, total: int):
    """Of a row's nodes: those that gain by a move, where to and how much; the weight of links within communities."""

    def f(a, b, w):
        i, c, votes = _summed(a, label[b], w)
        if not len(i):
            return i, i, i.astype(float), 0
        here = c == label[i]
        gain = votes - k[i] * (strength[c] - here * k[i]) / total
        start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        node, size = i[start], np.diff(np.r_[start, len(i)])
        top = np.maximum.reduceat(gain, start)
        stay = -k[node] * (strength[label[node]] - k[node]) / total + np.add.reduceat(here * votes, start)
        best = np.minimum.reduceat(np.where(gain == np.repeat(top, size), c, MASK), start)
        wants = top - stay > 1e-9
        return node[wants].astype(np.int32), best[wants].astype(np.int32), (top - stay)[wants], int(votes[here].sum())

    return f


def _hash(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 mixed bits of each number."""
    x = x.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for by, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(by))) * np.uint64(times)
    return x ^ (x >> np.uint64(31))


def _raise_modularity(links: _Links, k: np.ndarray, loops: np.ndarray, total: int, least: float) -> tuple[np.ndarray, float]:
    """The communities after one level's moves, and their modularity."""
    kept = now = np.arange(len(k), dtype=np.int32)
    best, chance, small, turn, moved = -1.0, 1.0, 0, 0, 0
    while True:
        strength = np.bincount(now, k, len(k)).astype(np.int64)
        found = links.each(_wishes(now, k, strength, total))
        quality = (sum(x[3] for x in found) + int(loops.sum())) / total - float((strength / total) @ (strength / total))
        turn += 1
        if quality < best - 1e-12:
            chance /= 4
            if chance < 1 / 64:
                return kept, best
            now, moved = kept, 0
            continue
        if moved:
            small = small + 1 if quality <= best + least else 0
        kept, best = now, quality
        i, to, more = (np.concatenate(x) for x in list(zip(*found, strict=True))[:3]) if found else (np.zeros(0, np.int32),) * 3
        if not len(i) or small == 3:
            return kept, best
        now = _moved(now, k, i, to, more, total, chance, turn)
        moved = int((now != kept).sum())


def _moved(now: np.ndarray, k: np.ndarray, i: np.ndarray, to: np.ndarray, more: np.ndarray, total: int, chance: float, turn: int) -> np.ndarray:
    """The communities after a round in which some of the nodes i, which gain `more` by a move, are moved."""
    bit = lambda c: (_hash(c) >> np.uint64(turn // 2 % 64) & np.uint64(1)).astype(int)
    ready = (bit(now[i]) == turn % 2) & (bit(to) != turn % 2)  # two communities differ in some bit
    i, to, more = i[ready], to[ready], more[ready]
    into, out = np.bincount(to, k[i], len(k)), np.bincount(now[i], k[i], len(k))
    others = np.maximum(into[to] - k[i], 0) + np.maximum(out[now[i]] - k[i], 0)
    slack = more * total / np.maximum(k[i], 1)  # how much strength may move before this gain is gone
    drawn = _hash(i, turn) % np.uint64(1 << 20) < chance * (1 << 20) * np.minimum(1, 2 * slack / np.maximum(others, 1))
    new = now.copy()
    new[i[drawn]] = to[drawn]
    return new


def find_communities(nodes: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """asn, grp (g01 …): communities found by modularity, split, merged and ranked."""
    return settle_communities(edges, modularity_communities(nodes, edges), most)

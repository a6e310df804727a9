"""SimHash near-dedup with deletion-variant signatures.

A fingerprint has 64 bits; two link at `LINK_BITS` = 3 or fewer differing bits. Cut into two halves, one half of a
linked pair differs in at most one bit. So each distinct fingerprint is indexed under 2 x 32 keys, a half with one bit
left out; linked fingerprints meet under a common key, are joined there and verified by counting differing bits.

Equal fingerprints are one node, so copies cost nothing. A key under which more than `GROUP` fingerprints could meet is
known beforehand from counts of whole halves; its rows are keyed once more by the other half (two quarters with one bit
left out). Under such a key at most 2^18 distinct fingerprints exist at all, so no task holds an unbounded group. Each
group hands on a spanning star per component, fewer links than it has members, never all pairs.

`keep_one`, the filter, also joins documents whose five-word shingles are 0.8 similar, exactly: a pair meets under a shingle
that both texts' prefixes hold (shingles that many texts hold come last in their order), bounds on what two sets can share
leave few pairs, and those are counted. A key's first few nodes meet all its others first; what is then one group is not
compared again, and all other pairs of a key are. So only keys whose many nodes are not similar cost the square of their
number, in comparing 512 bits each; a key of more than `RUN` nodes is dealt in pieces, and each pair of pieces is compared
in a task. Before sets are fetched, pairs are told apart by parities of two bits and more for each member.

Defined cases: null and empty texts, and texts of white space only, have fingerprint zero and link like others; rows
with one identifier share their component only through their fingerprints; a null identifier never becomes a
component_id unless its component has no other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import Stages, col, fresh, slices, table, texts
from netloom.llm.components import components

SHINGLE = 3
SEED = 42
LINK_BITS = 3
GROUP = 1024
DENSE = 2048
CHUNK = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a UTF-8 text, lower-cased in A-Z only."""
    words = text.lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    n, ones = len(words) - k + 1, np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        part = words[i : i + CHUNK + k - 1]
        grams = map(b" ".join, zip(*(part[j:] for j in range(k)), strict=False))
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for b in slices(batches):
        f = np.array([fingerprint(t) for t in texts(b.column(1))], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f.view(np.int64))], ["id", "fp"])


def _dense(f: np.ndarray) -> list[np.ndarray]:
    """(member, least member) of each component of two and more; f: distinct fingerprints."""
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= LINK_BITS
    free, out = np.ones(len(f), bool), []
    for i in range(len(f)):
        if not free[i]:
            continue
        got = front = near[i] & free
        free &= ~got
        while front.any():
            front = near[front].any(0) & free
            free &= ~front
            got = got | front
        if got.sum() > 1:
            x = f[got]
            out.append(np.stack([x, np.full(len(x), x.min())], 1))
    return out


def link(f: np.ndarray) -> list[np.ndarray]:
    """As _dense, for a group of any size; large ones are cut by the bits that vary, one bit of a part left out."""
    if len(f) <= DENSE:
        return _dense(f)
    vary = [b for b in range(64) if int(np.bitwise_or.reduce(f ^ f[0])) >> b & 1]
    out = []
    for part in (vary[: len(vary) // 2], vary[len(vary) // 2 :]):
        for skip in part:
            key = f & np.uint64(sum(1 << b for b in part if b != skip))
            order = np.argsort(key, kind="stable")
            for run in np.split(f[order], np.flatnonzero(np.diff(key[order])) + 1):
                if len(run) > 1:
                    out += link(run)
    return out


def _links(batches):
    """Rows sorted by (key, fp); links within each run of one key."""
    rest_k, rest_f = np.empty(0, np.int64), np.empty(0, np.uint64)

    def runs(k, f):
        cut = np.flatnonzero(np.diff(k)) + 1
        start, size = np.r_[0, cut], np.diff(np.r_[0, cut, len(k)])
        two = start[size == 2]
        two = two[np.bitwise_count(f[two] ^ f[two + 1]) <= LINK_BITS]
        out = [np.stack([f[two + 1], f[two]], 1)] if len(two) else []
        for s, n in zip(start[size > 2], size[size > 2], strict=True):
            out += link(f[s : s + n])
        if out:
            e = np.unique(np.concatenate(out), axis=0)
            e = e[e[:, 0] != e[:, 1]].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], ["a", "b"])

    for b in batches:
        k = np.concatenate([rest_k, b.column(0).to_numpy()])
        f = np.concatenate([rest_f, b.column(1).to_numpy().view(np.uint64)])
        if not len(k):
            continue
        open_ = int(np.searchsorted(k, k[-1]))
        yield from runs(k[:open_], f[:open_]) if open_ else ()
        rest_k, rest_f = k[open_:], f[open_:]
    if len(rest_k):
        yield from runs(rest_k, rest_f)


def near_links(fps: DataFrame, stages: Stages, group: int = GROUP) -> DataFrame:
    """a, b: links that connect exactly the distinct fingerprints (column fp) which chains of close pairs connect."""
    half = [F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))]
    halves = fps.select(F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), h.alias("half")) for i, h in enumerate(half)])).alias("x")).select("x.*")
    hot = stages.keep(halves.groupBy("seg", "half").agg(F.count("*").alias("n")).where(F.col("n") > group // 2))
    # each row becomes 64, so the few bytes of the fingerprints are spread first
    spread = fps.select("fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    bits = spread.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v")).selectExpr("fp", "v", "v & 31 AS pos", "if(v < 32, shiftrightunsigned(fp, 32), fp & 4294967295L) AS half", "if(v < 32, fp & 4294967295L, shiftrightunsigned(fp, 32)) AS other")
    keyed = bits.selectExpr("shiftleft(CAST(v AS BIGINT), 32) | (half & ~shiftleft(1L, pos)) AS key", "fp", "other", "v", "half", "pos")
    if not hot.isEmpty():
        hot_keys = hot.selectExpr("seg", "half", "explode(sequence(0, 31)) AS p").selectExpr("shiftleft(CAST(seg * 32 + p AS BIGINT), 32) | (half & ~shiftleft(1L, p)) AS hot_key").distinct()
        keyed = keyed.join(hot_keys, F.col("key") == F.col("hot_key"), "left")
        quarter = "explode(if(hot_key IS NULL, array(-1), sequence(0, 31))) AS q"
        keyed = keyed.selectExpr("key", "fp", "other", quarter).selectExpr(
            "if(q < 0, key, shiftleft(1L, 62) | xxhash64(key, q, if(q < 16, shiftrightunsigned(other, 16), other & 65535) & ~shiftleft(1L, q & 15))) AS key", "fp")
    placed = keyed.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
    return placed.mapInArrow(_links, "a long, b long").distinct()


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """One row for each input row: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    stages = Stages(df.sparkSession, "simhash")
    kind = df.schema[id_col].dataType.simpleString()
    rows = stages.keep(df.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")).mapInArrow(_fingerprints, f"id {kind}, fp long"))
    fps = rows.groupBy("fp").agg(F.min("id").alias("least"))
    edges = stages.keep(near_links(fps.select("fp"), stages, group))
    roots = components(edges, stages)
    labelled = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    labelled = stages.keep(labelled)
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = labelled.join(least, "root").select(F.col("fp").alias("label_fp"), "component_id")
    out = rows.join(labels, F.col("fp") == F.col("label_fp"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Similarity of shingle sets, exactly. In any order of all shingles that is the same for every text, two sets at a similarity
# s share one of their first n - ceil(s n) + 1 members. So each text is keyed by those, with the shingles that many texts
# hold ordered last.
WORDS, SIMILARITY = 5, 0.8
PARITY = 512
CENTRES = 4
SAMPLE, OFTEN, MOST_OFTEN = 16, 16, 1 << 18
RUN = 1 << 12
PAIR_CELLS = 1 << 18
SLOTS = 1 << 24
SLACK = 1e-9


def shingle_hashes(text: bytes, shingle: int = WORDS) -> tuple[int, np.ndarray]:
    """A hash of all words, and the hashes of the different shingles."""
    words = text.lower().split()
    k = min(shingle, len(words))
    grams = map(b" ".join, zip(*(words[j:] for j in range(k)), strict=False)) if k else ()
    node = np.uint64(xxhash.xxh3_64_intdigest(b" ".join(words))).view(np.int64)
    return int(node), np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64))


def parity(h: np.ndarray, size: int = PARITY) -> bytes:
    """`size` bits, each whether an odd number of members fall on it. Two sets differ in at least as many members as bits."""
    return np.packbits(np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1 > 0, bitorder="little").tobytes()


def wide_parity(h: np.ndarray) -> bytes:
    """A power of two of bits, at least two for each member, so that sets of any size are told apart."""
    return parity(h, max(PARITY, 1 << (2 * len(h) - 1).bit_length()))


def differing(x: bytes, y: bytes) -> int:
    """How many bits two parities differ in; the longer one is folded to the size of the other."""
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())


def _members(batches):
    for b in slices(batches):
        h = np.concatenate([np.empty(0, np.uint64), *(shingle_hashes(t)[1] for t in texts(b.column(0)))])
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])


def often(rows: DataFrame, sample: int = SAMPLE, least: int = OFTEN) -> np.ndarray:
    """Shingles that many texts hold, judged by a share of the texts. They only set the order, never the result."""
    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(sample)) == 0).select("text").mapInArrow(_members, "h long")
    top = some.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "h").limit(MOST_OFTEN)
    return np.sort(np.array([r.h for r in top.toLocalIterator()], np.int64).view(np.uint64))


def prefix(h: np.ndarray, last: np.ndarray, similarity: float) -> np.ndarray:
    """The members that a text is keyed by, in order. h: sorted; last: sorted members that come after all others."""
    if len(last):
        at = last[np.minimum(np.searchsorted(last, h), len(last) - 1)] == h
        h = np.concatenate([h[~at], h[at]])
    return h[: len(h) - int(np.ceil(similarity * len(h) - SLACK)) + 1]


def _prefixes(last: np.ndarray, similarity: float):
    def run(batches):
        for b in slices(batches):
            nodes, sets = zip(*map(shingle_hashes, texts(b.column(2))), strict=True)
            columns = [pa.array(nodes, pa.int64()), pa.array([len(h) for h in sets], pa.int32()), pa.array([parity(h) for h in sets], pa.binary()), pa.array([wide_parity(h) for h in sets], pa.binary()), pa.array([prefix(h, last, similarity).tobytes() for h in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["id", "source", "node", "n", "bits", "wide", "prefix"])

    return run


def _keys(batches):
    for b in slices(batches):
        node, n = b.column(0).to_numpy(), b.column(1).to_numpy()
        own = [np.frombuffer(x, np.int64) for x in b.column(2).to_pylist()]
        size = [len(p) for p in own]
        rest = np.repeat(n, size) - np.concatenate([np.arange(s, dtype=np.int32) for s in size])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array(np.repeat(node, size)), pa.array(rest.astype(np.int32))], ["key", "node", "rest"])


def _sets(slots: np.ndarray):
    """Nodes and sets of the texts whose own hash has its slot marked; no other text is read."""

    def run(batches):
        for b in slices(batches):
            at = b.column(0).to_numpy() % SLOTS
            some = b.column(1).filter(pa.array(slots[at >> 3] >> (at & 7) & 1 > 0))
            out = [(node, h.tobytes()) for node, h in map(shingle_hashes, texts(some))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["node", "members"])

    return run


def _shared(batches):
    """Rows sorted by key: those whose key another row has, too."""
    held, known = None, False  # held: the last row so far; known: whether the row before it has its key
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks().to_batches()[0]
        same = np.diff(t.column(0).to_numpy()) == 0
        copy = np.r_[False, same & (np.diff(t.column(1).to_numpy()) == 0)]
        t = t.filter(pa.array(~copy))
        same = same[~copy[1:]]
        keep = np.r_[known, same[:-1]] | same if len(same) else np.zeros(0, bool)
        known = bool(same[-1]) if len(same) else known
        held = t.slice(t.num_rows - 1)
        yield t.slice(0, t.num_rows - 1).filter(pa.array(keep))
    if known:
        yield held


def _pairs(similarity: float, rest_of: bool):
    """Rows sorted by (key, node): pairs that no exact bound excludes, of each row with its run's CENTRES first, or (rest_of)
    of all others of different groups. A run holds at most two pieces of RUN rows or so, and is compared in blocks."""

    def near(x, y):
        """x, y: (node, rest, n, bits, group, side) of two blocks; pairs of rows as indices. A run of two pieces has their
        rows on sides 0 and 1 and is compared across, one of a single piece has side -1."""
        both = x[2][:, None] + y[2][None, :]
        ok = (x[0][:, None] < y[0][None, :]) & (x[4][:, None] != y[4][None, :])
        if x[5][0] >= 0:
            ok &= x[5][:, None] != y[5][None, :]
        # what is left of both from their first common member on holds all that they share
        ok &= np.minimum(x[1][:, None], y[1][None, :]) >= both * (similarity / (1 + similarity)) - SLACK
        i, j = np.nonzero(ok)
        few = np.bitwise_count(x[3][i] ^ y[3][j]).sum(1) <= both[i, j] * ((1 - similarity) / (1 + similarity)) + SLACK
        return np.stack([x[0][i[few]], y[0][j[few]]], 1)

    def of(run):
        size = len(run[0])
        if not rest_of:
            yield near([c[:CENTRES] for c in run], run)
        elif (run[4] != run[4][0]).any():
            step = max(1, PAIR_CELLS // size)
            for i in range(0, size, step):
                yield near([c[i : i + step] for c in run], [c[i:] for c in run])

    def batch(found):
        e = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], ["a", "b"])

    def runs(batches):
        left = None
        for b in batches:
            bits = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint64).reshape(b.num_rows, PARITY // 64)
            now = [b.column(i).to_numpy() for i in (0, 1, 2, 3)] + [bits, b.column(5).to_numpy(), b.column(6).to_numpy()]
            left = now if left is None else [np.concatenate(c) for c in zip(left, now, strict=True)]
            if not len(left[0]) or left[0][0] == left[0][-1]:
                continue
            open_ = int(np.searchsorted(left[0], left[0][-1]))
            cut = np.r_[0, np.flatnonzero(np.diff(left[0][:open_])) + 1, open_]
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                yield from of([c[s:e] for c in left[1:]])
            left = [c[open_:] for c in left]
        if left is not None and len(left[0]):
            yield from of(left[1:])

    def run(batches):
        found, count = [], 0
        for p in runs(batches):
            found.append(p)
            count += len(p)
            if count > CHUNK:
                yield batch(found)
                found, count = [], 0
        if found:
            yield batch(found)

    return run


def _alike(similarity: float):
    """Pairs whose parities do not exclude that their sets are similar."""

    def run(batches):
        for b in slices(batches):
            good = [differing(x, y) <= (m + n) * ((1 - similarity) / (1 + similarity)) + SLACK for m, n, x, y in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in b.columns[:2]], ["a", "b"])

    return run


def _similar(similarity: float):
    """Pairs whose sets are similar, counted."""

    def run(batches):
        for b in slices(batches):
            good = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = both >= similarity * (len(x) + len(y) - both) - SLACK
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in b.columns[:2]], ["a", "b"])

    return run


def similar_links(df: DataFrame, stages: Stages, id_col: str, text_col: str, similarity: float = SIMILARITY, often_least: int = OFTEN, run: int = RUN) -> DataFrame:
    """a, b: pairs of identifiers that connect exactly the documents which chains of similar shingle sets connect."""
    kind = df.schema[id_col].dataType.simpleString()
    told = df.select(col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("source"), col(text_col).cast("string").alias("text"))
    rows = stages.keep(told.mapInArrow(_prefixes(often(told, least=often_least), similarity), f"id {kind}, source long, node long, n int, bits binary, wide binary, prefix binary"))
    # rows of one node have the same words, so the same set; one of their texts serves to make it anew
    nodes = stages.keep(rows.groupBy("node").agg(F.min("id").alias("least"), F.min("source").alias("source"), F.min(F.struct("n", "bits", "wide")).alias("x")).select("node", "least", "source", "x.*"))
    keyed = rows.select("node", "n", "prefix").mapInArrow(_keys, "key long, node long, rest int")
    shared = stages.keep(keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_shared, "key long, node long, rest int"))
    # a key of many nodes is dealt in pieces, each key in its own way
    large = stages.keep(shared.groupBy("key").agg(F.ceil(F.count("*") / F.lit(run)).alias("pieces")).where("pieces > 1").select(F.col("key").alias("l_key"), "pieces"))
    dealt = shared.join(large, F.col("key") == F.col("l_key"), "left").selectExpr("key", "node", "rest", "pieces", "pmod(xxhash64(key, node), pieces) AS piece")

    def met(rows_of: DataFrame, groups: DataFrame, rest_of: bool) -> DataFrame:
        """Pairs of different groups that meet under a key and may be similar."""
        placed = rows_of.join(nodes.select("node", "n", "bits"), "node").join(groups, "node").select("key", "node", "rest", "n", "bits", "grp", "side")
        return stages.keep(placed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_pairs(similarity, rest_of), "a long, b long").distinct())

    def alike(pairs: DataFrame) -> DataFrame:
        """Pairs that their parities, two bits and more for each member, do not tell apart: nearly all are similar."""
        of = nodes.select("node", "n", "wide")
        both = pairs.join(of.toDF("a", "n_a", "wide_a"), "a").join(of.toDF("b", "n_b", "wide_b"), "b").select("a", "b", "n_a", "n_b", "wide_a", "wide_b")
        return stages.keep(both.mapInArrow(_alike(similarity), "a long, b long"))

    def counted(pairs: DataFrame) -> DataFrame:
        """The pairs that are similar. Sets are made anew for texts that are needed, so that few are moved."""
        pairs = alike(pairs)
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "source"), "node").select(F.pmod("source", F.lit(SLOTS)).alias("slot"))
        words = ends.groupBy(F.shiftright("slot", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(slot & 31 AS int)))").alias("v"))
        slots = np.zeros(SLOTS // 32, np.uint32)
        for r in words.toLocalIterator():
            slots[r.w] = r.v
        if not slots.any():
            return pairs
        sets = told.select("source", "text").mapInArrow(_sets(slots.view(np.uint8)), "node long, members binary")
        sets = stages.keep(sets.dropDuplicates(["node"]))
        both = pairs.join(sets.toDF("a", "members_a"), "a").join(sets.toDF("b", "members_b"), "b").select("a", "b", "members_a", "members_b")
        out = stages.keep(both.mapInArrow(_similar(similarity), "a long, b long"))
        stages.drop(sets, pairs)
        return out

    # each piece's few centres with all its nodes
    alone = nodes.select("node", F.col("node").alias("grp"))
    pieces = dealt.selectExpr("if(pieces IS NULL, key, xxhash64(key, piece)) AS key", "node", "rest", "-1 AS side")
    edges = counted(met(pieces, alone, False))
    # of keys whose nodes are still in several groups, every pair: each piece with itself and with every other piece
    roots = components(edges, stages).toDF("r_node", "root")
    groups = stages.keep(nodes.join(roots, F.col("node") == F.col("r_node"), "left").select("node", F.coalesce("root", "node").alias("grp")))
    mixed = shared.join(groups, "node").groupBy("key").agg(F.count("*").alias("n"), F.min("grp").alias("low"), F.max("grp").alias("high")).where(f"n > {CENTRES + 1} AND low <> high").select("key")
    whole = dealt.join(mixed, "key", "left_semi").selectExpr("key", "node", "rest", "pieces", "piece", "explode(if(pieces IS NULL, array(0L), sequence(0L, pieces - 1))) AS other")
    cells = whole.selectExpr("if(pieces IS NULL, key, xxhash64(key, least(piece, other), greatest(piece, other))) AS key", "node", "rest", "CASE WHEN pieces IS NULL OR piece = other THEN -1 WHEN piece < other THEN 0 ELSE 1 END AS side")
    edges = edges.union(counted(met(cells, groups, True)))
    least = nodes.select("node", "least")
    texts_of = edges.join(least.toDF("a", "least_a"), "a").join(least.toDF("b", "least_b"), "b").select("least_a", "least_b")
    same = rows.select("id", "node").join(least, "node").where("id <> least").select("id", "least")
    return texts_of.union(same).toDF("a", "b")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """df's rows of which each group keeps the document with its smallest identifier; rows without one stay. Documents
    are in one group if chains of close fingerprints (LINK_BITS) or of similar shingle sets (SIMILARITY) connect them."""
    stages = Stages(df.sparkSession, "groups")
    close = simhash_components(df, id_col, text_col).where(F.col("doc_id") != F.col("component_id")).select("doc_id", "component_id")
    roots = components(close.union(similar_links(df, stages, id_col, text_col, **parameters)), stages)
    (key,) = fresh(df, "x_drop")
    drop = stages.keep(roots.where("node <> root").select(F.col("node").alias(key)).distinct())
    return df.join(drop, col(id_col) == F.col(key), "left_anti")


def similar_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """doc_id, component_id for each row: components of documents whose sets of five-word shingles have a Jaccard
    similarity of at least `similarity`, counted for texts of any length."""
    stages = Stages(df.sparkSession, "similar")
    roots = components(similar_links(df, stages, id_col, text_col, **parameters), stages).toDF("r_id", "root")
    return df.select(col(id_col).alias("doc_id")).join(roots, F.col("doc_id") == F.col("r_id"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("component_id"))


def op1_simhash(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents"))

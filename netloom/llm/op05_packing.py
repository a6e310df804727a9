"""Packing by cutting-stock column generation.

A document's token ids (with a closing id) are cut into full sequences of 2048 and one tail. The tails' lengths form a
histogram of at most 2048 / `GRID` bins. A linear program over patterns (how many tails of each bin share a sequence)
minimises the number of sequences: its dual prices go to an unbounded knapsack, whose best fillings become new columns,
until none improves. The solution is rounded down; what is left of each bin, a bounded number of tails however many
documents there are, is packed by fitting the largest first. Patterns are assigned to tails by their rank in their bin:
each task ranks its own tails, and the tasks' counts, summed bin by bin in the order of partitions, shift those ranks, so
that a repeated task and a repeated run over the same partitions place every tail alike.

Tokens come from one pass; only piece rows are written and joined, never ids. What the driver holds is bounded by the
histogram, whatever the input.

Sequences are padded to 2048, except those whose length is a power of two.

Defined cases: a null text counts as empty, and an empty document is one piece, the closing id; repeated rows are
packed one by one; a null identifier is kept; an empty table gives an empty result; other columns are carried by `pack`
only where asked for.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import Stages, col, slices, table

WIDTH = 2048
GRID = 4
END = 1
COLUMNS = 4000
GAP = 2e-4
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
#: Characters on which both tokenizer libraries split words alike, whatever Unicode version they carry.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ‐-‧]*")


@cache
def tokens_of(path: str, ranks: str | None) -> Tokens:
    return Tokens(path, ranks)


class Tokens:
    """Ids as `tokenizers` gives them. The same vocabulary as ranks is quicker, and serves for texts of common characters."""

    def __init__(self, path: str, ranks: str | None):
        self.path, self.slow, self.fast = path, None, None
        with open(path, encoding="utf-8") as f:
            special = [t["content"] for t in json.load(f).get("added_tokens") or []]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and PLAIN.fullmatch(text) and not self.special.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        if self.slow is None:  # loaded where a text needs it
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


def _pieces(path: str, ranks: str | None, text_at: int, width: int, grid: int):
    """Rows of other columns plus start, length, crc, tokens, block, bin, rank; bin 0: a full sequence."""

    def run(batches):
        tokens = tokens_of(path, ranks)
        block, rank = TaskContext.get().partitionId(), Counter()
        for b in slices(batches):
            row, start, length, crc, total, bins, ranks_ = [], [], [], [], [], [], []
            for i, t in enumerate(b.column(text_at).to_pylist()):
                ids = np.append(tokens(t or ""), np.array(END, "<u4"))
                for s in range(0, len(ids), width):
                    part = ids[s : s + width]
                    k = -(-len(part) // grid) if len(part) < width else 0
                    row.append(i), start.append(s), length.append(len(part)), crc.append(zlib.crc32(part)), total.append(len(ids)), bins.append(k), ranks_.append(rank[k])
                    rank[k] += 1
            kept = b.drop_columns([b.schema.names[text_at]]).take(pa.array(row, pa.int64()))
            cols = [pa.array(x, pa.int64()) for x in (start, length, crc, total)] + [pa.array([block] * len(row), pa.int32()), pa.array(bins, pa.int32()), pa.array(ranks_, pa.int64())]
            yield pa.RecordBatch.from_arrays([*kept.columns, *cols], [*kept.schema.names, "start", "length", "crc", "tokens", "block", "bin", "rank"])

    return run


def knapsack(price: np.ndarray, sizes: np.ndarray, capacity: int) -> list[np.ndarray]:
    """The best filling with any number of each item, and the best ones led by other items, as counts."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c], pick[c] = best[c - 1], -1
        fits = np.searchsorted(sizes, c, side="right")
        if fits:
            v = best[c - sizes[:fits]] + price[:fits]
            k = int(v.argmax())
            if v[k] > best[c] + 1e-12:
                best[c], pick[c] = v[k], k
    led = price + best[capacity - sizes]
    out = []
    for first in np.argsort(-led, kind="stable")[:8]:
        if led[first] <= 1 + 1e-7:
            break
        count, c = np.zeros(len(sizes), int), capacity - sizes[first]
        count[first] = 1
        while c > 0:
            if pick[c] < 0:
                c -= 1
            else:
                count[pick[c]] += 1
                c -= sizes[pick[c]]
        if not any((count == o).all() for o in out):
            out.append(count)
    return out


def fill(left: dict[int, float], space: int) -> dict[int, int]:
    """The largest item left, then the fullest filling of the rest that the counts allow, large items preferred."""
    first = max(s for s in left if left[s] > 0)
    sizes = [s for s in sorted(left, reverse=True) if left[s] - (s == first) > 0 and s <= space - first]
    reached, mask = [1], (1 << space - first + 1) - 1
    for s in sizes:
        now, more, step = reached[-1], min(max(1, int(left[s] - (s == first))), (space - first) // s), 1
        while more > 0:
            step = min(step, more)
            now |= now << step * s & mask
            more -= step
            step *= 2
        reached.append(now)
    at, use = reached[-1].bit_length() - 1, Counter({first: 1})
    for i in range(len(sizes) - 1, -1, -1):
        while not reached[i] >> at & 1:
            use[sizes[i]] += 1
            at -= sizes[i]
    return dict(use)


def greedy(left: dict[int, float], capacity: int, whole: bool) -> list[tuple[float, dict[int, int], int]]:
    """Fillings in turn, each repeated until one of its bins, given third, is used up."""
    left, out = dict(left), []
    while any(v > 0 for v in left.values()):
        use = fill(left, capacity)
        last = min(use, key=lambda s: left[s] // use[s] if whole else left[s] / use[s])
        times = left[last] // use[last] if whole else left[last] / use[last]
        out.append((times, use, last))
        for s, k in use.items():
            left[s] -= times * k
            if left[s] < 1e-9 or not whole and s == last:
                left[s] = 0
    return out


def inverse_of(matrix: np.ndarray) -> np.ndarray | None:
    """By Gauss-Jordan steps with row exchange; None where a pivot vanishes. Elementwise, so no threads of a linear
    algebra library start in the driver."""
    n = len(matrix)
    m = np.concatenate([matrix, np.eye(n)], 1)
    for i in range(n):
        k = i + int(np.abs(m[i:, i]).argmax())
        if abs(m[k, i]) < 1e-9:
            return None
        m[[i, k]] = m[[k, i]]
        m[i] /= m[i, i]
        d = m[:, i].copy()
        d[i] = 0
        rows = np.flatnonzero(d)
        m[rows] -= d[rows, None] * m[i]
    return m[:, n:]


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {bin: tails}) that use each bin's tails up exactly; columns are generated until prices allow none."""
    sizes = np.array(sorted(histogram))
    if not len(sizes):
        return []
    need = np.array([histogram[s] for s in sizes], float)
    at = {int(s): i for i, s in enumerate(sizes)}
    # Each greedy filling uses up a bin that no later one holds; with a column of its own for any bin that ran out along
    # with another, the fillings are a triangular and feasible basis.
    basis, x = np.diag((capacity // sizes).astype(float)), np.zeros(len(sizes))
    for times, use, last in greedy({int(s): float(n) for s, n in zip(sizes, need, strict=True)}, capacity, False):
        basis[:, at[last]] = 0
        basis[[at[s] for s in use], at[last]] = [*use.values()]
        x[at[last]] = times
    inverse, made = inverse_of(basis), 0
    if inverse is None:  # not exactly triangular after rounding: a basis of single bins always serves
        basis = np.diag((capacity // sizes).astype(float))
        inverse = inverse_of(basis)
        x = need / (capacity // sizes)
    bound = (need @ sizes) / capacity
    while made < COLUMNS and x.sum() - bound > GAP * x.sum():
        price = np.maximum(inverse.sum(0), 0)
        columns = knapsack(price, sizes, capacity)
        if not columns:
            break
        bound = max(bound, price @ need / max(1.0, max(price @ c for c in columns)))
        for c in columns:
            made += 1
            if inverse.sum(0) @ c <= 1 + 1e-9:
                continue
            d = (inverse * c).sum(1)
            ok = d > 1e-9
            if not ok.any():
                continue
            ratio = np.where(ok, x / np.where(ok, d, 1), np.inf)
            out = int(ratio.argmin())
            inverse[out] /= d[out]
            d[out] = 0
            inverse -= np.outer(d, inverse[out])
            basis[:, out] = c
            x = np.maximum((inverse * need).sum(1), 0)
        if made % 512 < len(columns):  # undo what rounding has gathered
            inverse = inverse_of(basis)
            if inverse is None:
                break
            x = np.maximum((inverse * need).sum(1), 0)
    rest, result = dict(histogram), []
    for j in np.argsort(-x, kind="stable"):
        use = {int(s): int(k) for s, k in zip(sizes, basis[:, j], strict=True) if k}
        times = min([int(x[j] + 1e-6), *(rest[s] // k for s, k in use.items())])
        if times > 0:
            result.append((times, use))
            for s, k in use.items():
                rest[s] -= times * k
    return result + [(int(t), use) for t, use, _ in greedy(rest, capacity, True)]


def _slots(found: list[tuple[int, dict[int, int]]]) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """(bin, first rank, end rank, tails of the bin in a sequence, first sequence, slot), and the number of sequences."""
    taken, rows, sequence = Counter(), [], 0
    for times, use in found:
        slot = 0
        for b in sorted(use, reverse=True):
            rows.append((b, taken[b], taken[b] + times * use[b], use[b], sequence, slot))
            taken[b] += times * use[b]
            slot += use[b]
        sequence += times
    return rows, sequence


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, ranks: str | None = None, width: int = WIDTH, grid: int = GRID, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each piece: doc_id, carried columns, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    stages = Stages(spark, "packing")
    if path is None:
        path, ranks = public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS)
    held = [f"carry{i}" for i in range(len(carry))]
    rows = docs.select(col(id_col).alias("doc_id"), *[col(c).alias(h) for c, h in zip(carry, held, strict=True)], col(text_col).cast("string").alias("text"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    schema = f"{head}, start long, length long, crc long, tokens long, block int, bin int, rank long"
    pieces = stages.keep(rows.mapInArrow(_pieces(path, ranks, len(rows.columns) - 1, width, grid), schema))
    counts = pieces.groupBy("bin", "block").agg((F.max("rank") + 1).alias("n"))
    before = Window.partitionBy("bin").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("bin", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    total = {r.bin: r.n for r in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    slots, sequences = _slots(patterns({b: n for b, n in total.items() if b}, width // grid))
    slots = spark.createDataFrame([*slots, (0, 0, total.get(0, 0), 1, sequences, 0)], "s_bin int, low long, high long, each long, first long, slot long")
    ranked = pieces.join(shifts, ["bin", "block"]).withColumn("rank", F.col("rank") + F.col("shift"))
    # at most (bins + patterns) x tails of a pattern rows, whatever the input
    placed = ranked.join(F.broadcast(slots), (F.col("bin") == F.col("s_bin")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    placed = placed.withColumns({"sequence_id": F.expr("first + (rank - low) div each"), "place": F.expr("slot + (rank - low) % each")})
    earlier = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", *[F.col(h).alias(c) for c, h in zip(carry, held, strict=True)], "start", "length", F.col("crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"), "sequence_id", F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"))


def op5_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))

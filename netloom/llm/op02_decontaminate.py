"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and their white space collapsed. A test item of length n may occur with up to n // `PER_ERROR`
edits (insertions, deletions, substitutions). Cut into budget + 1 pieces, one piece of any such occurrence is
unchanged: an Aho-Corasick automaton over all pieces finds piece hits in one pass over a whole text, and each hit's
surroundings are verified with Myers' bit-parallel distance, whose bit vectors span the whole item.

Items are taken in blocks of at most `BLOCK_CHARS` characters (or one longer item), a stated bound on what a task is sent;
each block is matched against all documents. Documents never move: the pass is a map, and only matches are shuffled. Where
there is more than one block, what a block found or left is written before the next one is read, so the driver and each
task hold one block at a time; the documents are then read once for each block.

Defined cases: null and empty documents match nothing, nor do null or blank items; an item shorter than PER_ERROR must
occur unchanged; items with equal texts are each reported; rows that repeat an identifier are one document here; empty
tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from netloom.llm.common import Stages, col, filter_rows, slices, table

PER_ERROR = 20
BLOCK_CHARS = 2_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def distance(masks: dict[str, int], n: int, text: str, most: int) -> int:
    """The least edit distance between the pattern of n characters and any part of text; most + 1 if above most."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, now, best = full, 0, n, min(n, most + 1)
    for c in text:
        eq = masks.get(c, 0)
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            now += 1
        elif mh & top:
            now -= 1
            if now < best:
                best = now
                if not best:
                    break
        ph, mh, xv = (ph << 1) & full, (mh << 1) & full, eq | mv
        pv, mv = mh | ~(xv | ph) & full, ph & xv
    return best


class Matcher:
    """Finds items, given as (id, normalised text), in normalised texts."""

    def __init__(self, items: list[tuple[object, str]], per_error: int = PER_ERROR):
        ids: dict[str, list] = {}
        for i, t in items:
            ids.setdefault(t, []).append(i)
        self.items, pieces = [], {}
        for t, own in ids.items():
            k = len(t) // per_error
            masks: dict[str, int] = {}
            for j, c in enumerate(t):
                masks[c] = masks.get(c, 0) | 1 << j
            for p in range(k + 1):
                a, b = p * len(t) // (k + 1), (p + 1) * len(t) // (k + 1)
                pieces.setdefault(t[a:b], []).append((len(self.items), a))
            self.items.append((own, len(t), k, masks))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, int]:
        """Item number -> least distance found."""
        out: dict[int, int] = {}
        tried: dict[int, set[int]] = {}
        if not self.items:
            return out
        for end, (size, places) in self.automaton.iter(text):
            for i, offset in places:
                own, n, k, masks = self.items[i]
                start = end + 1 - size - offset
                if out.get(i) == 0 or start in tried.setdefault(i, set()):
                    continue
                tried[i].add(start)
                got = distance(masks, n, text[max(0, start - k) : max(0, start) + n + 2 * k], k)
                if got <= k:
                    out[i] = min(got, out.get(i, got))
        return out


def blocks(items: DataFrame, id_col: str, text_col: str, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[object, str]]]:
    """The items, normalised, block by block; the driver holds one block and one partition of items at a time."""
    now, size = [], 0
    for i, t in items.select(col(id_col), col(text_col).cast("string")).toLocalIterator():
        t = normal(t)
        if not t:
            continue
        if now and size + len(t) > chars:
            yield now
            now, size = [], 0
        now.append((i, t))
        size += len(t)
    if now:
        yield now


def _matches(block, per_error, item_kind):
    def run(batches):
        m = Matcher(block, per_error)
        for b in slices(batches):
            ids, keys, items, edits = [], [], [], []
            for d, h, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for i, e in m.find(normal(t)).items():
                    for x in m.items[i][0]:
                        ids.append(d), keys.append(h), items.append(x), edits.append(e)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(keys, pa.int64()), pa.array(items, item_kind), pa.array(edits, pa.int32())], ["doc_id", "key", "item_id", "edits"])

    return run


def _one_by_one(found: Iterator, run, stages: Stages) -> Iterator[DataFrame]:
    """run(block) for each block; written where another block follows."""
    block = next(found, None)
    while block is not None:
        out, block = run(block), next(found, None)
        yield out if block is None else stages.keep(out)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", per_error: int = PER_ERROR, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, key (hash of the text), item_id, edits: the least edits with which the item occurs in the document."""
    stages = Stages(docs.sparkSession, "leaks")
    kinds = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, key long, item_id {kinds[1]}, edits int"
    item_kind = to_arrow_type(items.schema[item_id].dataType)
    rows = docs.select(col(id_col), F.xxhash64(col(text_col)), col(text_col).cast("string"))
    out = docs.sparkSession.createDataFrame([], schema)
    for found in _one_by_one(blocks(items, item_id, item_text, block_chars), lambda block: rows.mapInArrow(_matches(block, per_error, item_kind), schema), stages):
        out = out.union(found)
    return out.groupBy("doc_id", "key", "item_id").agg(F.min("edits").alias("edits"))


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", per_error: int = PER_ERROR, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs' rows in which no item occurs, all columns; a map over the rows for each block of items, without a shuffle."""
    stages = Stages(docs.sparkSession, "clean")
    at = docs.columns.index(text_col)

    def only(block):
        def run(batches):
            m = Matcher(block, per_error)
            for b in slices(batches):
                yield b.filter(pa.array([not m.find(normal(t)) for t in b.column(at).to_pylist()], pa.bool_()))

        return run

    left = [docs]
    for now in _one_by_one(blocks(items, item_id, item_text, block_chars), lambda block: filter_rows(left[-1], only(block)), stages):
        left.append(now)
    stages.drop(*left[1:-2])
    return left[-1]


def op2_decontaminate(spark, sf_dir):
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))

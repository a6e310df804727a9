"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

A window is `WINDOW` consecutive words; every word that a window covers whose words also start anywhere else, in any
document, goes. Blocks are made so that equal windows always meet: a window belongs to the block named by the least
hash of its `GRAMS[0]`-word grams, and neighbouring windows with the same name form one stretch of words. A name that
occurs at one place only cannot hold a repeated window, so first only names are counted; words follow only for the
stretches whose name occurs again. In each block the distinct stretches are indexed with all places of their windows, and
each is parsed greedily against the whole block: a factor is the longest match at any other place, factors of WINDOW words
and more are duplicate spans, and the windows that cross a factor's end are checked one by one.

Equal stretches are counted before the shuffle and parsed once. A block with more than `BLOCK` windows is cut into blocks
by longer grams in the same way, and parsed in the same way. The last grams are whole windows, each a stretch of its own,
so such a block holds one distinct window and no task an unbounded block. Long documents are read in steps of `STEP` windows.

Defined cases: a null text has no words; an empty document keeps the hash of an empty text; rows that repeat a text
repeat all its windows, whether or not their identifiers are equal or null; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import Stages, col, slices, table, texts

WINDOW = 35
GRAMS = (8, 20, 35)
BLOCK = 1 << 15
STEP = 1 << 16
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, b in enumerate((BASE, INVERSE)):
            p = np.full(max(n, 1 << 16), b, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0], _powers[1]


def gram_hashes(words: list[bytes], gram: int) -> np.ndarray:
    """A hash of each `gram` consecutive words that depends on their bytes alone."""
    joined = np.frombuffer(b" ".join(words), np.uint8)
    up, down = _power(len(joined) + 1)
    total = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * up[: len(joined)], out=total[1:])
    space = np.flatnonzero(joined == 32)
    start, end = np.r_[0, space + 1], np.r_[space, len(joined)]
    s, e = start[: len(start) - gram + 1], end[gram - 1 :]
    h = (total[e] - total[s]) * down[s]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def stretches(words: list[bytes], window: int = WINDOW, gram: int = GRAMS[0]) -> tuple[np.ndarray, ...]:
    """(name, first window, windows, places): the last is 2 where the name's gram stands at two places or more."""
    out = []
    for at in range(0, len(words) - window + 1, STEP):
        g = gram_hashes(words[at : at + STEP + window - 1], gram)
        width, least, reach = window - gram + 1, g, 1
        while reach * 2 <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if width > reach:
            least = np.minimum(least[: reach - width], least[width - reach :])
        cut = np.flatnonzero(least[1:] != least[:-1]) + 1
        first, last = np.r_[0, cut], np.r_[cut, len(least)] - 1
        views = np.lib.stride_tricks.sliding_window_view(g, width)
        once = views[first].argmin(1) + first == width - 1 - views[last][:, ::-1].argmin(1) + last
        out.append((least[first].view(np.int64), first + at, last - first + 1, 2 - once))
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))


def _digest(batches):
    for b in slices(batches):
        n_words, sha, runs = [], [], []
        for t in texts(b.column(2)):
            words = t.split()
            n_words.append(len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            runs.append(stretches(words))
        flat = [np.concatenate(x) for x in zip(*runs, strict=True)]
        offsets = np.r_[0, np.cumsum([len(r[0]) for r in runs])].astype(np.int32)
        structs = pa.StructArray.from_arrays([pa.array(x) for x in flat], ["m", "start", "n", "places"])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_words, pa.int64()), pa.array(sha), pa.ListArray.from_arrays(pa.array(offsets), structs)], ["doc_id", "h", "n_words", "sha", "runs"])


def _cut(batches):
    """The words of each stretch that a document's `runs` name."""
    for b in slices(batches):
        rows = []
        for i, (t, runs) in enumerate(zip(texts(b.column(2)), b.column(3).to_pylist(), strict=True)):
            words = t.split()
            for r in runs:
                s = b" ".join(words[r["start"] : r["start"] + r["n"] + WINDOW - 1])
                rows.append((i, r["start"], r["m"], np.uint64(xxhash.xxh3_64_intdigest(s)).view(np.int64), s))
        for k in range(0, len(rows), 4096):
            at, start, m, sid, s = zip(*rows[k : k + 4096], strict=True)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(start, pa.int64()), pa.array(m, pa.int64()), pa.array(np.array(sid)), pa.array(s, pa.binary()).cast(pa.string())], ["doc_id", "h", "start", "m", "sid", "words"])


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = dict.fromkeys(("m", "sid", "off", "m2", "sid2"), pa.int64()) | {"words": pa.binary(), "n": pa.int64()}
    cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)]
    return pa.RecordBatch.from_arrays([c.cast(pa.string()) if c.type == pa.binary() else c for c in cols], [*kinds])


def _cut_again(level: int):
    """The stretches of each stretch (m, sid, words, n) by the grams of a level: m, sid, off, m2, sid2, words, n. Whole windows
    are stretches of their own; words are given with the first of equal ones."""

    def run(batches):
        for b in slices(batches):
            rows = []
            for m, sid, t, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2)), b.column(3).to_pylist(), strict=True):
                words, seen = t.split(), set()
                names, starts, sizes, _ = stretches(words, gram=GRAMS[level])
                if GRAMS[level] == WINDOW:
                    names, starts, sizes = np.repeat(names, sizes), np.concatenate([np.arange(a, a + k) for a, k in zip(starts, sizes, strict=True)]), np.ones(int(sizes.sum()), np.int64)
                for name, start, size in zip(names.tolist(), starts.tolist(), sizes.tolist(), strict=True):
                    s = b" ".join(words[start : start + size + WINDOW - 1])
                    own = xxhash.xxh3_64_intdigest(s)
                    rows.append((m, sid, start, name, own - (own >> 63 << 64), None if (name, own) in seen else s, n))
                    seen.add((name, own))
                    if len(rows) == 4096:
                        yield _parts(rows)
                        rows = []
            if rows:
                yield _parts(rows)

    return run


def parse(block: list[tuple[bytes, int]], window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """Duplicate spans (first word, end word) of each of the block's distinct stretches, given with their counts."""
    ids: dict[bytes, int] = {}
    segs = [np.array([ids.setdefault(w, len(ids)) for w in s.split()], np.int32) for s, _ in block]
    size, index = 4 * window, {}
    # the number of each window's content; those of a stretch lie together, closed by a number that no window has
    raw = [s.tobytes() for s in segs]
    flat = [[index.setdefault(r[i : i + size], len(index)) for i in range(0, len(r) - size + 1, 4)] + [-1] for r in raw]
    start = np.cumsum([0, *map(len, flat)])
    flat = np.array([x for f in flat for x in f], np.int64)
    order = np.argsort(flat, kind="stable")
    first = np.searchsorted(flat[order], np.arange(len(index) + 1))
    out = []
    for k, (_, count) in enumerate(block):
        spans: list[tuple[int, int]] = []
        i, end = int(start[k]), int(start[k + 1]) - 1
        if count > 1 and i < end:
            out.append([(0, len(segs[k]))])
            continue
        while i < end:
            places = order[first[flat[i]] : first[flat[i] + 1]]
            places = places[places != i]
            if not len(places):
                i += 1
                continue
            n = 1  # windows that match, at the places that match longest
            while i + n < end:
                places = places[flat[places + n] == flat[i + n]]
                if not len(places):
                    break
                n += 1
            at = i - int(start[k])
            if spans and spans[-1][1] >= at:
                spans[-1] = (spans[-1][0], at + n + window - 1)
            else:
                spans.append((at, at + n + window - 1))
            i += n  # the first window that crosses the factor's end
        out.append(spans)
    return out


def _parsed(batches):
    """Rows sorted by block name; spans for each distinct stretch."""
    rest: list[tuple] = []

    def blocks(rows):
        m, sid, a, b = [], [], [], []
        i = 0
        while i < len(rows):
            j = i
            while j < len(rows) and rows[j][0] == rows[i][0]:
                j += 1
            for r, spans in zip(rows[i:j], parse([(r[2], r[3]) for r in rows[i:j]]), strict=True):
                for x, y in spans:
                    m.append(r[0]), sid.append(r[1]), a.append(x), b.append(y)
            i = j
        if m:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (m, sid, a, b)], ["m", "sid", "a", "b"])

    for batch in slices(batches, 4096):
        rows = rest + list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), batch.column(3).to_pylist(), strict=True))
        k = len(rows)
        while k and rows[k - 1][0] == rows[-1][0]:
            k -= 1
        rest = rows[k:]
        yield from blocks(rows[:k])
    yield from blocks(rest)


def _removed(batches):
    for b in slices(batches):
        n, sha = [], []
        for t, spans in zip(texts(b.column(2)), b.column(3).to_pylist(), strict=True):
            words = t.split()
            gone = np.zeros(len(words) + 1, np.int64)
            for s in spans:
                gone[s["a"]] += 1
                gone[s["b"]] -= 1
            keep = np.cumsum(gone)[:-1] == 0
            sha.append(hashlib.sha256(b" ".join([words[i] for i in np.flatnonzero(keep)])).hexdigest())
            n.append(int(len(words) - keep.sum()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sha)], ["k_id", "k_h", "n_removed", "kept"])


def _same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["r_id"]) & (a["h"] == b["r_h"])


def spans_of(distinct: DataFrame, stages: Stages, block: int, level: int = 0) -> DataFrame:
    """m, sid, a, b: the words of each stretch that go. distinct: m, sid, words, n (times) of distinct stretches."""
    parsed = lambda df: df.select("m", "sid", "words", "n").repartition("m").sortWithinPartitions("m").mapInArrow(_parsed, "m long, sid long, a long, b long")
    if level == len(GRAMS) - 1:
        return parsed(distinct)
    windows = F.length("words") - F.length(F.replace("words", F.lit(" "))) - (WINDOW - 2)
    large = stages.keep(distinct.groupBy("m").agg(F.sum(windows).alias("windows")).where(F.col("windows") > block).select(F.col("m").alias("large")))
    small = parsed(distinct.join(large, F.col("m") == F.col("large"), "left_anti"))
    if large.isEmpty():
        return small
    parts = stages.keep(distinct.join(large, F.col("m") == F.col("large")).select("m", "sid", "words", "n").mapInArrow(_cut_again(level + 1), "m long, sid long, off long, m2 long, sid2 long, words string, n long"))
    own = parts.groupBy(F.col("m2").alias("m"), F.col("sid2").alias("sid")).agg(F.max("words").alias("words"), F.sum("n").alias("n"))
    inner = spans_of(stages.keep(own), stages, block, level + 1).select(F.col("m").alias("p_m"), F.col("sid").alias("p_sid"), "a", "b")
    again = parts.select("m", "sid", "off", "m2", "sid2").join(inner, (F.col("m2") == F.col("p_m")) & (F.col("sid2") == F.col("p_sid")))
    return small.unionByName(again.select("m", "sid", (F.col("off") + F.col("a")).alias("a"), (F.col("off") + F.col("b")).alias("b")))


def duplicate_spans(docs: DataFrame, stages: Stages, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs: doc_id, h, text. Returns digests of all rows, the documents with repeated names, and r_id, r_h, a, b: the
    words that go, as spans."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    digests = stages.keep(docs.mapInArrow(_digest, f"doc_id {kind}, h long, n_words long, sha string, runs array<struct<m: long, start: long, n: long, places: long>>"))
    runs = digests.select("doc_id", "h", F.explode("runs").alias("r")).select("doc_id", "h", "r.*")
    again = runs.groupBy("m").agg(F.sum("places").alias("places")).where("places > 1").select(F.col("m").alias("again"))
    wanted = runs.join(again, F.col("m") == F.col("again")).groupBy("doc_id", "h").agg(F.collect_set(F.struct("m", "start", "n")).alias("runs"))
    wanted = stages.keep(wanted.select(F.col("doc_id").alias("r_id"), F.col("h").alias("r_h"), "runs"))
    some = stages.keep(docs.join(wanted, _same(docs, wanted)).select("doc_id", "h", "text", "runs"))
    stages.drop(wanted)
    segs = stages.keep(some.mapInArrow(_cut, f"doc_id {kind}, h long, start long, m long, sid long, words string"))
    distinct = stages.keep(segs.groupBy("m", "sid", "words").agg(F.count("*").alias("n")))
    spans = spans_of(distinct, stages, block).select(F.col("m").alias("p_m"), F.col("sid").alias("p_sid"), "a", "b")
    found = segs.select("doc_id", "h", "start", "m", "sid").join(spans, (F.col("m") == F.col("p_m")) & (F.col("sid") == F.col("p_sid")))
    return digests.select("doc_id", "h", "n_words", "sha"), some.select("doc_id", "h", "text"), found.select(F.col("doc_id").alias("r_id"), F.col("h").alias("r_h"), (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each input row: doc_id, n_words, n_removed, kept_sha256."""
    stages = Stages(df.sparkSession, "substring")
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(col(id_col).alias("doc_id"), F.xxhash64(col(text_col)).alias("h"), col(text_col).cast("string").alias("text"))
    digests, some, found = duplicate_spans(docs, stages, block)
    per_doc = found.groupBy("r_id", "r_h").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    touched = some.join(per_doc, _same(some, per_doc)).select("doc_id", "h", "text", "spans").mapInArrow(_removed, f"k_id {kind}, k_h long, n_removed long, kept string").distinct()
    out = digests.join(touched, digests["doc_id"].eqNullSafe(touched["k_id"]) & (digests["h"] == touched["k_h"]), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept", "sha").alias("kept_sha256"))


def op4_substring_dedup(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35),
w AS (SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(ws[i:i + 34], ' ')) AS n FROM s),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM w WHERE n > 1),
k AS (SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.p) AS kept, count(*) AS n_kept
      FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d) a
      LEFT JOIN c ON a.doc_id = c.doc_id AND a.p = c.p WHERE c.p IS NULL GROUP BY a.doc_id)
SELECT d.doc_id, len(ws) AS n_words, len(ws) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a learned and of a fixed lexicon, nearness of lexicon hits to second-person words, capitals,
punctuation, symbols, digits and obfuscated spellings. The learned lexicon holds words and word beginnings that are
over-represented in toxic rows. Labels come only from rows whose crc32(identifier as text) mod 5 is not 0, and at most
`MAX_TRAIN` of those (the ones with the smallest hash) train the model; lexicon features of a training row come from
the other half of the rows. Every document is scored, from its whole text alone.

Defined cases: a null text counts as empty and gets the score of an empty text; rows without an identifier count as
held out = (crc32 of an empty text mod 5 = 0) and are scored; of repeated labels the largest counts, null labels do
not; of rows that repeat an identifier the least text trains; without labels of both classes every score is the smoothed share of label 1; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import Stages, col, filter_rows, slices, table

MAX_TRAIN = 12_000
FOLDS = 5
STEMS = range(3, 8)
LEAST_EVIDENCE = 30.0
MAX_LEXICON = 1500
TREES, DEPTH, RATE, BINS, RIDGE = 80, 3, 0.15, 32, 1.0
NEAR = 6
CACHE = 200_000
# Common English insults, and second-person words of English, French, German and Spanish.
INSULTS = frozenset("idiot idiots moron morons stupid loser losers scum trash garbage pathetic worthless disgusting clown clowns dumb fool imbecile filth vermin hateful".split())
YOU = frozenset("you your yours yourself u ur tu te toi vous votre vos ton ta tes du dich dir dein deine ihr euch sie usted ustedes tus vosotros".split())
LEET = str.maketrans("013457@$!", "oieastasi")
UPPER, DIGITS, SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*@^~_|<>"
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def bare(word: str) -> str:
    """A lower-case word without the marks around it."""
    return word.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”„…")


def stems(word: str) -> list[str]:
    return [word, *(word[:n] for n in STEMS if n < len(word))]


class Words(dict):
    """word -> 0, or (learned weight, insult, second person, obfuscated); remembers a bounded number of words."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str):
        if len(self) > CACHE:
            self.clear()
        core = bare(word)
        plain = core.translate(LEET) if core and not core.isalpha() else core
        joined = "".join(c for c in plain if c.isalpha())
        odd = core != "" and not core.isalpha() and not core.isdigit() and any(c.isalpha() for c in core)
        forms = {core, joined} if odd else {core}
        weight = max((self.lexicon.get(s, 0.0) for f in forms for s in stems(f)), default=0.0)
        seen = (weight, bool(forms & INSULTS), core in YOU, odd)
        self[word] = out = seen if any(seen) else 0
        return out


def features(text: str, words: Words) -> list[float]:
    raw = text.encode()
    n_bytes = max(1, len(raw))
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / n_bytes
    tokens = text.lower().split()
    n = max(1, len(tokens))
    marked = [(i, v) for i, v in enumerate(map(words.__getitem__, tokens)) if v]
    weights = sorted((v[0] for _, v in marked if v[0] > 0), reverse=True)
    insults = [i for i, v in marked if v[1]]
    you = np.array([i for i, v in marked if v[2]])
    hits = np.array([i for i, v in marked if v[0] > 0 or v[1]])
    near = 0.0
    if len(you) and len(hits):
        at = np.searchsorted(you, hits)
        gap = np.minimum(np.abs(you[np.minimum(at, len(you) - 1)] - hits), np.abs(you[np.maximum(at - 1, 0)] - hits))
        near = float((gap <= NEAR).mean())
    return [
        math.log1p(len(tokens)), sum(weights) / n, math.log1p(len(weights)), weights[0] if weights else 0.0, sum(weights[:3]),
        len(insults) / n, math.log1p(len(insults)), near, len(you) / n, share(UPPER), share(b"!"), share(b"?"),
        share(PUNCTUATION), share(SYMBOLS), share(DIGITS), sum(v[3] for _, v in marked) / n, len(text) / n, share(b"\n"),
    ]


def _evidence(pos: int, neg: int, all_pos: int, all_neg: int) -> float:
    """Signed log-likelihood ratio of a stem's rows against the label's share; below 0 where it is rarer in label 1."""
    n, share = pos + neg, all_pos / (all_pos + all_neg)
    g = sum(2 * k * math.log(k / (n * p)) for k, p in ((pos, share), (neg, 1 - share)) if k)
    return g if pos > n * share else -g


def _lexicon(counts: list[tuple[str, int, int]], pos: int, neg: int) -> dict[str, float]:
    scored = [(g, w, math.log((p + 0.5) / (pos + 1)) - math.log((q + 0.5) / (neg + 1))) for w, p, q in counts if (g := _evidence(p, q, pos, neg)) >= LEAST_EVIDENCE]
    return {w: round(x, 4) for _, w, x in sorted(scored, reverse=True)[:MAX_LEXICON] if x > 1.5}


def boost(x: np.ndarray, y: np.ndarray) -> dict:
    """Trees of DEPTH levels on binned features, by Newton steps of the logistic loss."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], 1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = math.log(share / (1 - share))
    margin, trees = np.full(len(y), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node, feature, cut = np.zeros(len(y), int), [], []
        for level in range(DEPTH):
            width, best = 1 << level, [(0.0, 0, np.inf, BINS)] * (1 << level)
            for f in range(x.shape[1]):
                if not len(cuts[f]):
                    continue
                at = node * BINS + bins[:, f]
                gs, hs = (np.cumsum(np.bincount(at, w, width * BINS).reshape(width, BINS), 1) for w in (g, h))
                gain = gs**2 / (hs + RIDGE) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + RIDGE) - gs[:, -1:] ** 2 / (hs[:, -1:] + RIDGE)
                for k in range(width):
                    b = int(gain[k, : len(cuts[f])].argmax())
                    if gain[k, b] > best[k][0] + 1e-9:
                        best[k] = (gain[k, b], f, float(cuts[f][b]), b)
            feature.append([b[1] for b in best])
            cut.append([b[2] for b in best])
            node = node * 2 + (bins[np.arange(len(y)), np.array(feature[-1])[node]] > np.array([b[3] for b in best])[node])
        leaf = RATE * np.bincount(node, g, 1 << DEPTH) / (np.bincount(node, h, 1 << DEPTH) + RIDGE)
        margin += leaf[node]
        trees.append((feature, cut, leaf))
    return {"base": base, "trees": trees}


def margins(model: dict, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), model["base"])
    rows = np.arange(len(x))
    for feature, cut, leaf in model["trees"]:
        node = np.zeros(len(x), int)
        for f, c in zip(feature, cut, strict=True):
            node = node * 2 + (x[rows, np.array(f)[node]] > np.array(c)[node])
        out += leaf[node]
    return out


def isotonic(m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; the blocks' mean margins and label shares."""
    blocks: list[list[float]] = []
    for a, b in sorted(zip(m.tolist(), y.tolist(), strict=True)):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [s + t for s, t in zip(blocks[-1], last, strict=True)]
    return np.array([a / n for a, _, n in blocks]), np.array([b / n for _, b, n in blocks])


def fit(rows: list[tuple[int, int, list[float]]]) -> dict:
    """rows: (hash, label, features). A quarter of the rows, by hash, calibrates, where there are enough."""
    x, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows], float)
    late = np.array([r[0] // 2 % 4 == 0 for r in rows])
    apart = len(rows) >= 400 and 0 < y[late].sum() < late.sum() and 0 < y[~late].sum() < (~late).sum()
    model = boost(x[~late], y[~late]) if apart else boost(x, y)
    model["iso"] = isotonic(margins(model, x[late] if apart else x), y[late] if apart else y)
    return model


def probabilities(model: dict, x: np.ndarray) -> np.ndarray:
    if "prior" in model:
        return np.full(len(x), model["prior"])
    m = margins(model, x)
    return np.clip(0.999 * np.interp(m, *model["iso"]) + 0.001 / (1 + np.exp(-m)), 0, 1)


def _stem_counts(batches):
    """(fold, stem, rows with label 1, rows with label 0), summed over many rows at a time."""
    counts: defaultdict[tuple[int, str], list[int]] = defaultdict(lambda: [0, 0])

    def flush():
        keys, values = [*counts], [*counts.values()]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([v[0] for v in values], pa.int64()), pa.array([v[1] for v in values], pa.int64())], ["fold", "stem", "pos", "neg"])

    for b in slices(batches):
        for h, y, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            for s in {s for w in set((t or "").lower().split()) if (core := bare(w)) for s in stems(core)}:
                counts[h % 2, s][1 - y] += 1
            if len(counts) > 100_000:
                yield flush()
    if counts:
        yield flush()


def _train_features(lexicons):
    def run(batches):
        words = [Words(x) for x in lexicons]
        for b in slices(batches):
            hs, ys, ts = (b.column(i).to_pylist() for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(hs), pa.array(ys, pa.int32()), pa.array([features(t or "", words[1 - h % 2]) for h, t in zip(hs, ts, strict=True)], pa.list_(pa.float64()))], ["h", "y", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> dict:
    """A model from at most max_train labelled rows that are not held out. Only bounded results reach the driver."""
    stages = Stages(docs.sparkSession, "toxicity")
    usable = labels.select(col(label_id).alias("id"), col(label_col).cast("int").alias("y")).where("y IN (0, 1) AND id IS NOT NULL AND crc32(CAST(id AS STRING)) % 5 <> 0")
    chosen = usable.groupBy("id").agg(F.max("y").alias("y")).withColumn("h", F.abs(F.xxhash64("id", F.lit(8)) % F.lit(1 << 30)))
    chosen = stages.keep(chosen.orderBy("h", "id").limit(max_train))
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("t")).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    # of rows that repeat an identifier one text, so that the rows are as few as the identifiers
    rows = stages.keep(rows.groupBy("id", "h", "y").agg(F.min("t").alias("t")).select("h", "y", "t"))
    size = Counter({(r.fold, r.y): r.n for r in rows.groupBy((F.col("h") % 2).alias("fold"), "y").agg(F.count("*").alias("n")).collect()})
    pos, neg = ([size[f, y] for f in (0, 1)] for y in (1, 0))
    if not sum(pos) or not sum(neg):
        return {"prior": (sum(pos) + 0.1) / (sum(pos) + sum(neg) + 1), "lexicon": {}}
    counts = rows.mapInArrow(_stem_counts, "fold int, stem string, pos long, neg long").groupBy("stem").agg(*[F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for f in (0, 1) for c in ("pos", "neg")])
    share = sum(pos) / (sum(pos) + sum(neg))
    seen = counts.where((F.col("pos0") + F.col("pos1") >= 5) & (F.col("pos0") + F.col("pos1") > 2 * share * (F.col("pos0") + F.col("pos1") + F.col("neg0") + F.col("neg1"))))
    seen = seen.orderBy(F.desc(F.col("pos0") + F.col("pos1") - share / (1 - share) * (F.col("neg0") + F.col("neg1"))), "stem").limit(20 * MAX_LEXICON).collect()
    halves = [_lexicon([(r.stem, r[f"pos{f}"], r[f"neg{f}"]) for r in seen], pos[f], neg[f]) if pos[f] and neg[f] else {} for f in (0, 1)]
    whole = _lexicon([(r.stem, r.pos0 + r.pos1, r.neg0 + r.neg1) for r in seen], sum(pos), sum(neg))
    got = rows.mapInArrow(_train_features(halves), "h long, y int, x array<double>").orderBy("h").collect()
    stages.drop(chosen, rows)
    return fit([(r.h, r.y, r.x) for r in got]) | {"lexicon": whole}


def _scores(model):
    def run(batches):
        words = Words(model["lexicon"])
        for b in slices(batches, 1024):
            x = np.array([features(t or "", words) for t in b.column(1).to_pylist()]).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(probabilities(model, x))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string")).mapInArrow(_scores(model), f"doc_id {kind}, score double")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == 0
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows that the model does not reject, all columns, in one pass over the rows."""
    model = train(docs, labels, id_col, text_col)
    at = docs.columns.index(text_col)

    def run(batches):
        words = Words(model["lexicon"])
        for b in slices(batches, 1024):
            x = np.array([features(t or "", words) for t in b.column(at).to_pylist()]).reshape(b.num_rows, -1)
            yield b.filter(pa.array(probabilities(model, x) < 0.5))

    return filter_rows(docs, run)


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))

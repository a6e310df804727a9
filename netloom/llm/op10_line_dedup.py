"""Line dedup by a segment-partition edit join, in DataFrame operations only.

Lines are the newline-separated parts of a text, without white space at their ends; blank ones do not count. Two different
lines link at one edit for each `PER_EDIT` characters of the shorter one, `MAX_EDITS` at most: a line of fewer than PER_EDIT
characters links to equal ones only. A line stays where it occurs first, by (doc_id, text hash, line number), unless it
links to a line that occurs earlier.

Equal lines are told by a 128-bit hash and counted before the shuffle. For each number of edits e that a line may have in a
pair, it is cut into e + 1 segments, placed by its length class: linked lines have a class in common, and one segment of
them is unchanged and not moved by more than the edits beside it, so they share a key of (e, class, segment number,
segment). Only keys and line hashes move; a key under which all lines are equal ends there. The texts of the lines that are
left are fetched once. A line goes if any earlier one links to it, so lines meet in a semi-join on the key, which ends at a
line's first hit and hands on no pairs. Its condition compares character counts first, a lower bound on edits; then Spark's
own thresholded distance, which is compiled, drops what is far; what is left is verified, between the common beginning and
end, with a bit-parallel edit distance over a band of 2 x e + 1 diagonals.

The `HEAVY` most frequent lines give their keys only where they occur first, so a line that fills a third of the corpus is
no large group. Keys that many lines share are known beforehand from a sample of the documents, fewer than 4 x SAMPLE of
them for each partition, and their rows are dealt to many tasks. The sample decides where rows go, never which lines link.
Lines that share a segment with more than `RUN` others (a template with a number in it) are keyed anew, by what sets them
apart: e edits change at most e x `GRAM` of a line's different character grams, so linked lines share one of their
e x GRAM + 1 rarest. Only lines that link to nothing earlier under their other keys look there.

Defined cases: a null or blank text has no lines; rows that repeat an identifier and a text are one document, and each
gets its result; null identifiers come first; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import Stages, col, table

MAX_EDITS = 2
PER_EDIT = 10
HEAVY = 1000
HEAVY_LEAST = 64
SAMPLE = 64
RUN = 1024
GRAM = 3
ENDS = " \t\n\v\f\r"
COUNTED = "abcdefghijklmnopqrstuvwxyz0123456789"


def keys(k: int) -> str:
    """SQL for a line's keys for k edits as structs (key, own): own ones say where a segment is, others where it may have
    moved to.

    A class holds the lengths from `low` to the next class, `after`; a line that is k or fewer shorter than that is in
    that, too. Segments are measured by low - k, from the nearer end.
    """

    def of(start: str) -> list[str]:
        out = []
        for i in range(k + 1):
            a, b = f"CAST({i} * ({start} - {k}) div {k + 1} AS int)", f"CAST({i + 1} * ({start} - {k}) div {k + 1} AS int)"
            left = i <= k // 2
            reach = i if left else k - i
            for move in range(-reach, reach + 1):
                # from the right, segment i ends where it would if the line were low - k long
                at = f"{a} + {move} + 1" if left else f"n - CAST({start} - {k} AS int) + {a} + {move} + 1"
                out.append(f"named_struct('key', xxhash64({k}, {start}, {i}, substr(line, CAST({at} AS int), {b} - {a})), 'own', {int(move == 0)})")
        return out

    return f"concat(array({', '.join(of('low'))}), if(after - n <= {k}, array({', '.join(of('after'))}), array()))"


def all_keys(k: int) -> str:
    """SQL for a line's keys for every number of edits, k at most, that it may have in a pair."""
    of = lambda e: f"n >= {PER_EDIT * e}" + (f" AND n < {PER_EDIT * (e + 1) + e}" if e < k else "")
    return f"concat({', '.join(f'if({of(e)}, {keys(e)}, array())' for e in range(1, k + 1))})"


def with_class(lines: DataFrame) -> DataFrame:
    """lines with the borders of their length's class: low keeps the four leading bits of n."""
    lines = lines.withColumn("bits", F.greatest(F.length(F.bin("n")) - 4, F.lit(0)))
    return lines.withColumn("low", F.expr("shiftleft(shiftright(n, bits), bits)")).withColumn("after", F.expr("low + shiftleft(1, bits)"))


def character_counts() -> str:
    """SQL for how often each letter, of either case, and digit stands in a line, 127 at most, as an array."""
    upper = COUNTED[:26].upper()
    plain = f"translate(line, '{upper}', '{COUNTED[:26]}')"
    return f"array({', '.join(f'CAST(least(127, n - length(replace({plain}, {chr(39)}{c}{chr(39)}, {chr(39)}{chr(39)}))) AS tinyint)' for c in COUNTED)})"


def counts_near(a: str, b: str, k: str) -> str:
    """SQL for whether k edits can turn a line with counts a into one with counts b: each edit changes two at most."""
    total = " + ".join(f"abs(CAST({a}[{i}] AS int) - {b}[{i}])" for i in range(len(COUNTED)))
    return f"{total} <= 2 * {k}"


def edits(a: str, b: str, k: int) -> str:
    """SQL for the edit distance of strings a and b, or a number above k where it is above k."""
    let = "element_at(transform(array({value}), {name} -> {body}), 1)".format
    # common beginning and end, by doubling steps down
    steps = "transform(sequence(0, 30), e -> shiftleft(1, 30 - e))"
    front = f"aggregate({steps}, 0, (z, e) -> if(z + e <= least(length(v.a), length(v.b)) AND left(v.a, z + e) = left(v.b, z + e), z + e, z))"
    back = f"aggregate({steps}, 0, (z, e) -> if(z + e <= least(length(v.a), length(v.b)) AND right(v.a, z + e) = right(v.b, z + e), z + e, z))"
    width, mask = 2 * k + 1, (1 << 2 * k + 1) - 1
    # bit i of the column for character j of y stands for row j - k + i of x
    equal = " | ".join(f"if(get(v.x, j - {k + 1 - i}) = get(v.y, j - 1), {1 << i}L, 0L)" for i in range(width))
    down = f"named_struct('vp', (w.hn | ~(shiftrightunsigned(w.d0, 1) | w.hp)) & {mask}L, 'vn', shiftrightunsigned(w.d0, 1) & w.hp, 'd', s.d + CASE WHEN j <= v.m - {k} THEN if(shiftrightunsigned(w.d0, {2 * k}) & 1 = 1, 0, 1) ELSE CAST((shiftrightunsigned(w.hp, v.m - j + {k}) & 1) - (shiftrightunsigned(w.hn, v.m - j + {k}) & 1) AS int) END)"
    across = let(value=f"named_struct('d0', d0, 'hp', (s.vn | ~(d0 | s.vp)) & {mask}L, 'hn', d0 & s.vp)", name="w", body=down)
    column = let(value=equal, name="q", body=let(value=f"((((q & s.vp) + s.vp) ^ s.vp) | q | s.vn) & {mask}L", name="d0", body=across))
    start = f"named_struct('vp', {mask & ~((1 << k) - 1)}L, 'vn', 0L, 'd', least({k}, v.m))"
    # d is the band's lowest row until it reaches the last row; it falls by one a column at most
    run = f"aggregate(sequence(1, size(v.y)), {start}, (s, j) -> if(s.d > {2 * k} + greatest(0, size(v.y) - v.m + {k}), s, {column})).d"
    split = lambda s: f"regexp_extract_all({s}, '(?s).', 0)"
    whole = f"CASE WHEN abs(v.m - size(v.y)) > {k} THEN {k + 1} WHEN v.m = 0 THEN size(v.y) WHEN size(v.y) = 0 THEN v.m ELSE {run} END"
    chars = let(value=f"named_struct('x', {split('v.a')}, 'y', {split('v.b')}, 'm', length(v.a))", name="v", body=whole)
    tails = let(value=f"named_struct('a', left(v.a, length(v.a) - ({back})), 'b', left(v.b, length(v.b) - ({back})))", name="v", body=chars)
    middle = let(value=f"named_struct('a', substr(v.a, 1 + ({front})), 'b', substr(v.b, 1 + ({front})))", name="v", body=tails)
    return let(value=f"named_struct('a', {a}, 'b', {b})", name="v", body=middle)


def occurrences(rows: DataFrame) -> DataFrame:
    """rows: doc_id, h, text. Each line that is not blank, with two hashes and its length."""
    lines = rows.select("doc_id", "h", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).select("doc_id", "h", "line_no", F.btrim("raw", F.lit(ENDS)).alias("line")).where("line <> ''")
    return lines.select("*", F.xxhash64("line").alias("u"), F.xxhash64(F.lit(1), "line").alias("v"), F.length("line").alias("n"))


def hot_keys(rows: DataFrame, k: int, heavy_least: int, sample: int) -> DataFrame:
    """hot, salts: keys that, by a sample of the documents, hold more than a quarter of a partition's fair part."""
    some = with_class(occurrences(rows.where(F.pmod("h", F.lit(sample)) == 0)).where(F.col("n") >= PER_EDIT))
    counts = some.select(F.explode(F.expr(all_keys(k))).alias("x")).groupBy("x.key").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    part = max(heavy_least, total // (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return counts.where(F.col("n") > part).select(F.col("key").alias("hot"), F.ceil(F.col("n") / F.lit(part)).alias("salts"))


def later_lines(rows: DataFrame, first: DataFrame, stages: Stages, k: int = MAX_EDITS, heavy: int = HEAVY, heavy_least: int = HEAVY_LEAST, sample: int = SAMPLE, run: int = RUN) -> DataFrame:
    """gone_u, gone_v: the distinct lines that link to a line that occurs earlier.

    rows: doc_id, h, text; first: u, v, doc_id, h, line_no, times of distinct lines.
    """
    often = first.where(F.col("times") >= heavy_least).orderBy(F.desc("times"), "u", "v").limit(heavy)
    often = stages.keep(often.select(F.col("u").alias("o_u"), F.col("v").alias("o_v"), F.struct("doc_id", "h", "line_no").alias("o_first")))
    hot = stages.keep(hot_keys(rows, k, heavy_least, sample))
    lines = occurrences(rows).where(F.col("n") >= PER_EDIT).join(F.broadcast(often), (F.col("u") == F.col("o_u")) & (F.col("v") == F.col("o_v")), "left")
    lines = lines.where(F.col("o_u").isNull() | F.struct("doc_id", "h", "line_no").eqNullSafe(F.col("o_first")))
    keyed = with_class(lines).select("u", F.explode(F.expr(all_keys(k))).alias("x")).select("u", "x.key", "x.own")
    keyed = keyed.join(F.broadcast(hot), F.col("key") == F.col("hot"), "left").select("key", "own", "u", F.coalesce(F.pmod("u", "salts"), F.lit(-1)).alias("salt"))
    of_key = Window.partitionBy("key", "salt")
    shared = keyed.withColumns({"lo": F.min("u").over(of_key), "hi": F.max("u").over(of_key)}).where("lo <> hi OR salt >= 0")
    shared = stages.keep(shared.select("key", "own", "u").distinct())
    wanted = first.join(shared.select(F.col("u").alias("w")).distinct(), F.col("u") == F.col("w"), "left_semi")
    per_doc = wanted.groupBy(F.col("doc_id").alias("w_id"), F.col("h").alias("w_h")).agg(F.collect_list(F.struct("line_no", "u", "v")).alias("lines"))
    # the hint keeps the plan the same at every size
    found = rows.join(per_doc.hint("merge"), F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("h") == F.col("w_h"))).select("doc_id", "h", F.split("text", "\n").alias("parts"), "lines").dropDuplicates(["doc_id", "h"])
    found = found.select("doc_id", "h", "parts", F.explode("lines").alias("l")).select(F.struct("doc_id", "h", "l.line_no").alias("first"), "l.u", "l.v", F.btrim(F.get("parts", F.col("l.line_no")), F.lit(ENDS)).alias("line"))
    found = found.withColumn("n", F.length("line")).where(F.col("n") >= PER_EDIT).select(F.col("u").alias("f_u"), "v", "first", "n", "line", F.expr(character_counts()).alias("counts"))
    sides = stages.keep(shared.join(found, F.col("u") == F.col("f_u")).select("key", "own", "u", "v", "first", "n", "line", "counts"))
    stages.drop(shared, often, hot)
    large = stages.keep(sides.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > run).select(F.col("key").alias("large")))
    gone = stages.keep(_hit(sides.join(large, F.col("key") == F.col("large"), "left_anti"), sides, k))
    if large.isEmpty():
        return gone
    some = stages.keep(sides.join(large, F.col("key") == F.col("large"), "left_semi").drop("key", "own").dropDuplicates(["u", "v"]))
    sides = some.join(rare_grams(some, k), ["u", "v"]).withColumn("own", F.lit(1))
    left = sides.join(gone, (F.col("u") == F.col("gone_u")) & (F.col("v") == F.col("gone_v")), "left_anti")
    return gone.union(_hit(left, sides, k))


def rare_grams(lines: DataFrame, k: int) -> DataFrame:
    """u, v, key: each line's k x GRAM + 1 different grams that fewest of the lines have. Lines with no more grams than k
    edits can change have a common key besides."""
    grams = lines.select("u", "v", F.explode(F.expr(f"array_distinct(transform(sequence(1, n - {GRAM - 1}), i -> substr(line, i, {GRAM})))")).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("times"))
    own = grams.join(counts, "gram").groupBy("u", "v").agg(F.array_sort(F.collect_list(F.struct("times", "gram"))).alias("g"))
    rare = F.transform(F.slice("g", 1, k * GRAM + 1), lambda x: x["gram"])
    return own.select("u", "v", F.explode(F.when(F.size("g") <= k * GRAM, F.concat(rare, F.array(F.lit("")))).otherwise(rare)).alias("key"))


def _hit(later: DataFrame, lines: DataFrame, k: int) -> DataFrame:
    """gone_u, gone_v of the later lines to which an earlier one under the same key links."""
    earlier = lines.select(*[F.col(c).alias(f"e_{c}") for c in ("key", "own", "first", "n", "line", "counts")])
    budget = f"least({k}, least(n, e_n) div {PER_EDIT})"
    near = f"(own = 1 OR e_own = 1) AND e_first < first AND abs(n - e_n) <= {budget} AND {counts_near('counts', 'e_counts', budget)} AND levenshtein(line, e_line, {k}) >= 0 AND {edits('line', 'e_line', k)} <= {budget}"
    return later.join(earlier, (F.col("key") == F.col("e_key")) & F.expr(near), "left_semi").select(F.col("u").alias("gone_u"), F.col("v").alias("gone_v")).distinct()


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = MAX_EDITS, heavy_least: int = HEAVY_LEAST, sample: int = SAMPLE, run: int = RUN) -> DataFrame:
    """One row for each input row: doc_id, n_lines, n_kept, n_near (lines that go for a linked one), kept_lines (numbers).
    k is 1 or 2."""
    if k not in (1, 2):
        raise ValueError("k is 1 or 2")
    stages = Stages(df.sparkSession, "lines")
    rows = df.select(col(id_col).alias("doc_id"), F.xxhash64(col(text_col)).alias("h"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    at = F.struct("doc_id", "h", "line_no")
    first = occurrences(rows).select("u", "v", "doc_id", "h", "line_no").groupBy("u", "v").agg(F.min(at).alias("at"), F.count("*").alias("times"))
    first = stages.keep(first.select("u", "v", "at.*", "times"))
    gone = later_lines(rows, first, stages, k, heavy_least=heavy_least, sample=sample, run=run)
    judged = first.join(gone, (F.col("u") == F.col("gone_u")) & (F.col("v") == F.col("gone_v")), "left")
    kept_at = F.when(F.col("gone_u").isNull(), F.col("line_no") + 1)
    per_doc = judged.groupBy(F.col("doc_id").alias("k_id"), F.col("h").alias("k_h")).agg(F.array_sort(F.collect_list(kept_at)).alias("kept"), F.count("gone_u").alias("near"))
    n_lines = F.size(F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(ENDS)) != "")).cast("long")
    docs = rows.select("doc_id", "h", n_lines.alias("n_lines"))
    out = docs.join(per_doc, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("h") == F.col("k_h")), "left")
    kept = F.coalesce("kept", F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", F.size(kept).cast("long").alias("n_kept"), F.coalesce("near", F.lit(0)).alias("n_near"), F.array_join(kept, ",").alias("kept_lines"))


def op10_line_dedup(spark, sf_dir):
    return line_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
o AS (SELECT doc_id, i, trim(line, e'\x20\x09\x0A\x0B\x0C\x0D') AS line FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d)),
l AS (SELECT line, min(doc_id * 1000000 + i) AS at, length(line) AS n FROM o WHERE line <> '' GROUP BY line),
c AS (SELECT a.line AS x, b.line AS y, a.at AS p, b.at AS q, 2 AS e FROM l a JOIN l b ON b.n BETWEEN a.n AND a.n + 2 AND a.line <> b.line
      WHERE a.n >= 20 AND (contains(b.line, left(a.line, a.n // 3)) OR contains(b.line, substr(a.line, a.n // 3 + 1, a.n // 3)) OR contains(b.line, substr(a.line, 2 * (a.n // 3) + 1)))
      UNION ALL SELECT a.line, b.line, a.at, b.at, 1 FROM l a JOIN l b ON b.n BETWEEN a.n AND a.n + 1 AND a.line <> b.line
      WHERE a.n BETWEEN 10 AND 19 AND (starts_with(b.line, left(a.line, a.n // 2)) OR ends_with(b.line, substr(a.line, a.n // 2 + 1)))),
g AS (SELECT DISTINCT greatest(p, q) AS at FROM c WHERE levenshtein(x, y) <= e),
k AS (SELECT l.at // 1000000 AS doc_id, l.at % 1000000 AS i, g.at IS NOT NULL AS gone FROM l LEFT JOIN g ON l.at = g.at),
p AS (SELECT doc_id, count(*) FILTER (NOT gone) AS n_kept, count(*) FILTER (gone) AS n_near, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER (NOT gone) AS kept FROM k GROUP BY doc_id),
n AS (SELECT doc_id, count(*) FILTER (line <> '') AS n_lines FROM o GROUP BY doc_id)
SELECT n.doc_id, n_lines, coalesce(n_kept, 0) AS n_kept, coalesce(n_near, 0) AS n_near, coalesce(kept, '') AS kept_lines FROM n LEFT JOIN p ON n.doc_id = p.doc_id
"""

"""Exact dedup by content sort, in DataFrame operations only.

Texts are equal when they are identical after each run of white space became one space. Rows are range-partitioned by
(first characters, hash, salt) with sampled splitters, sorted externally by those and the whole normalised text, and
neighbours are compared in full: a window whose partition is the whole text walks the sorted rows and starts a new
group wherever the text differs from the row before. Only bounded keys are sampled to the driver.

Large groups: text hashes with more rows than a `SHARE`th of a partition's fair part are known beforehand from a map-side
combined count over all rows. There are fewer than SHARE x partitions of them, however many rows there are, and their rows
get a salt from their identifier, as many salts as the group has such parts, so no partition is dealt more of one group
than that. The smallest identifier and the size of such a text, combined before the shuffle and compared in full, are
handed to the chunks: again a bounded number of rows.

Defined cases: a null text counts as empty; null identifiers come after all others, and a group of only such rows has a
null keep_id and keeps one row; of rows that repeat an identifier and a text exactly one is kept; an empty table gives
an empty result; other columns, whatever their names, pass through `keep_first` untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import Stages, col, fresh, table

PREFIX = 32
SHARE = 4
HEAVY_LEAST = 64


def _normal(text):
    """Each run of white space as one space; the regular expression runs only on texts that hold such a run."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    for c in "\t\n\v\f\r":
        t = F.replace(t, F.lit(c), F.lit(" "))
    return F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, " {2,}", " ")).otherwise(t)


def _heavy(df: DataFrame, text_col: str, heavy_least: int) -> dict[int, int]:
    """Number of salts by text hash, for fewer than SHARE x partitions hashes."""
    counts = df.select(F.xxhash64(_normal(col(text_col))).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    part = max(heavy_least, df.count() // (SHARE * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return {r.h: -(-r.n // part) for r in counts.where(F.col("n") > part).collect()}


def _decided(df: DataFrame, id_col: str, text_col: str, heavy_least: int, name: str) -> tuple[DataFrame, dict[str, str]]:
    """df's rows and columns, with the decision columns named by the returned map."""
    names = ["x_prefix", "x_hash", "x_salt", "x_text", "x_first", "x_n", "x_rank", "x_sha", "x_kept", "m_hash", "m_salts", "m_sha", "m_first", "m_n"]
    n = dict(zip(names, fresh(df, *names), strict=True))
    heavy = _heavy(df, text_col, heavy_least)
    norm = _normal(col(text_col))
    keys = [n["x_prefix"], n["x_hash"]]
    rows = df.withColumns({n["x_prefix"]: F.substring(norm, 1, PREFIX), n["x_hash"]: F.xxhash64(norm)})
    if heavy:
        salts = df.sparkSession.createDataFrame([*heavy.items()], f"{n['m_hash']} long, {n['m_salts']} long")
        rows = rows.join(F.broadcast(salts), F.col(n["x_hash"]) == F.col(n["m_hash"]), "left")
        rows = rows.withColumn(n["x_salt"], F.coalesce(F.pmod(F.xxhash64(col(id_col)), F.col(n["m_salts"])), F.lit(-1))).drop(n["m_hash"], n["m_salts"])
        keys.append(n["x_salt"])
    # the range exchange deals by the leading keys of the window, so the window needs no exchange of its own
    rows = rows.repartitionByRange(*keys).withColumn(n["x_text"], norm)
    ordered = Window.partitionBy(*keys, n["x_text"]).orderBy(col(id_col).asc_nulls_last())
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({n["x_rank"]: F.row_number().over(ordered), n["x_first"]: F.min(col(id_col)).over(whole), n["x_n"]: F.count(F.lit(1)).over(whole)})
    rows = rows.withColumn(n["x_sha"], F.sha2(F.encode(F.col(n["x_text"]), "UTF-8"), 256))
    if not heavy:
        return rows.withColumn(n["x_kept"], F.col(n["x_rank"]) == 1), n
    # the chunks of one text: combined before the shuffle, and as many rows of fixed size as heavy hashes, unless hashes collide
    texts = df.select(col(id_col).alias("id"), norm.alias("text")).where(F.xxhash64("text").isin(list(heavy))).groupBy("text").agg(F.min("id").alias(n["m_first"]), F.count("*").alias(n["m_n"]))
    merged = Stages(df.sparkSession, name).keep(texts.select(F.sha2(F.encode("text", "UTF-8"), 256).alias(n["m_sha"]), n["m_first"], n["m_n"]))
    rows = rows.join(F.broadcast(merged), F.when(F.col(n["x_salt"]) >= 0, F.col(n["x_sha"])) == F.col(n["m_sha"]), "left")
    chunked = F.isnotnull(n["m_sha"])
    kept = (F.col(n["x_rank"]) == 1) & (~chunked | F.col(n["x_first"]).eqNullSafe(F.col(n["m_first"])))
    return rows.withColumn(n["x_kept"], kept).withColumns({n["x_first"]: F.when(chunked, F.col(n["m_first"])).otherwise(F.col(n["x_first"])), n["x_n"]: F.coalesce(n["m_n"], n["x_n"])}), n


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy_least: int = HEAVY_LEAST) -> DataFrame:
    """One row for each input row: id, keep_id, group_size, kept, text_sha256."""
    rows = df.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    out, n = _decided(rows, "doc_id", "text", heavy_least, "exact")
    return out.select("doc_id", F.col(n["x_first"]).alias("keep_id"), F.col(n["x_n"]).alias("group_size"), F.col(n["x_kept"]).alias("kept"), F.col(n["x_sha"]).alias("text_sha256"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy_least: int = HEAVY_LEAST) -> DataFrame:
    """df's rows without copies: of equal texts the row with the smallest identifier stays, with all its columns."""
    out, n = _decided(df, id_col, text_col, heavy_least, "exact")
    return out.where(F.col(n["x_kept"])).select(*map(col, df.columns))


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM n
"""

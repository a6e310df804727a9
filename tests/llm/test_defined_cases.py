"""Each operator and each pipeline stage on nulls, empty and very long texts, ties, repeated rows, empty tables and
columns with clashing names."""

import hashlib
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from netloom.llm import op01_simhash as o1
from netloom.llm import op02_decontaminate as o2
from netloom.llm import op03_exact_dedup as o3
from netloom.llm import op04_substring_dedup as o4
from netloom.llm import op05_packing as o5
from netloom.llm import op06_token_count as o6
from netloom.llm import op07_pii as o7
from netloom.llm import op08_toxicity as o8
from netloom.llm import op09_html_extract as o9
from netloom.llm import op10_line_dedup as o10
from netloom.session import BATCH, ship
from tests.llm.data import IDS, TEXTS, docs, empty

ROWS = len(IDS) + 2
EMPTY = hashlib.sha256(b"").hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark).cache()


def labels(spark, rows=()):
    return spark.createDataFrame([*rows, (None, 1, 1), (3, None, None), (3, 1, 0), (3, 1, 1)], "doc_id bigint, quality int, toxic int")


def items(spark):
    return spark.createDataFrame([(1, None), (2, " "), (3, "Same  Text"), (4, "same text"), (None, "zzzz")], "item_id bigint, text string")


def test_simhash(spark, odd):
    out = o1.simhash_components(odd).collect()
    assert len(out) == ROWS and o1.simhash_components(empty(spark)).count() == 0
    by = {}
    for r in out:
        by.setdefault(r.doc_id, r)
    assert by[0].fingerprint == by[1].fingerprint == by[2].fingerprint == "0" * 16 and by[2].component_id == 0
    assert by[5].component_id == by[6].component_id == 4 and by[13].component_id == 12
    kept = o1.keep_one(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {0, 3, 4, 7, 8, 9, 10, 11, 12, None} and kept.where("doc_id IS NULL").count() == 2


def test_decontaminate(spark, odd):
    found = {tuple(r) for r in o2.leaks(odd, items(spark)).select("doc_id", "item_id", "edits").collect()}
    assert found == {(d, i, 0) for d in (12, 13) for i in (3, 4)}
    kept = o2.keep_clean(odd, items(spark))
    assert kept.columns == odd.columns and kept.count() == ROWS - 3
    for d, i in ((empty(spark), items(spark)), (odd, items(spark).limit(0))):
        assert o2.leaks(d, i).count() == 0 and o2.keep_clean(d, i).count() == d.count()
    assert o2.keep_clean(odd, items(spark), block_chars=1).count() == ROWS - 3
    for kind in ("int", "string"):
        assert o2.leaks(odd, items(spark).selectExpr(f"CAST(item_id AS {kind}) AS item_id", "text")).count() == 4


@pytest.mark.parametrize("least", [64, 1])
def test_exact_dedup(spark, odd, least):
    out = {(r.doc_id, r.text_sha256): r for r in o3.exact_dedup(odd, heavy_least=least).collect()}
    rows = o3.exact_dedup(odd, heavy_least=least).collect()
    assert len(rows) == ROWS and o3.exact_dedup(empty(spark), heavy_least=least).count() == 0
    assert out[0, EMPTY].group_size == 3 and out[0, EMPTY].keep_id == 0 and out[None, EMPTY].kept is False
    assert sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})
    kept = o3.keep_first(odd, heavy_least=least)
    assert kept.columns == odd.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([0, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12, None], key=str)


def test_exact_dedup_keeps_one_of_repeated_rows_and_of_rows_without_id(spark):
    df = spark.createDataFrame([(7, "t"), (7, "t"), (None, "u"), (None, "u"), (9, "t")], "doc_id bigint, text string")
    for least in (64, 1):
        kept = o3.keep_first(df, heavy_least=least).collect()
        assert sorted(map(tuple, kept), key=str) == [(7, "t"), (None, "u")]


def test_substring_dedup(spark, odd):
    words = " ".join(f"w{i}" for i in range(40))
    more = docs(spark, [(20, words + " tail"), (21, "head " + words), (22, "z " * 36), (23, " ".join(f"w{i}" for i in range(34)))])
    out = {}
    for r in o4.substring_dedup(more).collect():
        out.setdefault(r.doc_id, r)
    assert o4.substring_dedup(more).count() == ROWS + 4 and o4.substring_dedup(empty(spark)).count() == 0
    assert (out[20].n_words, out[20].n_removed) == (41, 40) and (out[21].n_removed, out[22].n_removed, out[23].n_removed) == (40, 36, 0)
    assert out[20].kept_sha256 == hashlib.sha256(b"tail").hexdigest() and out[0].kept_sha256 == EMPTY and out[0].n_words == 0


def test_packing(spark, odd):
    out = o5.pack(odd, carry=("rank",)).collect()
    firsts = Counter((r.doc_id, r.rank) for r in out if r.start == 0)
    assert sum(firsts.values()) == ROWS and o5.pack(empty(spark)).count() == 0
    one = next(r for r in out if r.doc_id == 0)
    assert (one.doc_tokens, one.length, one.ids_crc32) == (1, 1, zlib.crc32((1).to_bytes(4, "little")))
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048


def test_token_counts(spark, odd):
    rows = o6.token_counts(odd).collect()
    assert len(rows) == ROWS and o6.token_counts(empty(spark)).count() == 0
    by = {r.doc_id: r.n_tokens for r in rows}
    assert by[0] == by[1] == 0 and by[3] >= 1 and by[8] > 0


def test_pii(spark, odd):
    rows = o7.find_pii(odd).collect()
    assert len(rows) == ROWS and o7.find_pii(empty(spark)).count() == 0
    by = {r.doc_id: r for r in rows}
    assert by[0].base_sha256 == EMPTY and by[0].spans == "" and (by[11].n_email, by[11].n_ip, by[11].n_card, by[11].n_phone) == (1, 1, 1, 0)


def test_toxicity(spark, odd):
    for lab in (labels(spark), labels(spark).limit(0), labels(spark, [(i, 1, i % 2) for i in range(14)])):
        model = o8.train(odd, lab)
        rows = o8.score(odd, model).collect()
        assert len(rows) == ROWS and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
        assert {r.doc_id: r.held_out for r in rows}[3] == (zlib.crc32(b"3") % 5 == 0)
        kept = o8.keep_clean(odd, lab)
        assert kept.columns == odd.columns and kept.count() <= ROWS
    assert o8.score(empty(spark), o8.train(empty(spark), labels(spark))).count() == 0


def test_html_extract(spark):
    df = spark.createDataFrame([(1, "u", None, "c"), (2, None, "", "c"), (None, "u", "<p>" * 3000 + "Some text that ends here, at last.", "c"), (4, "u", "<!-- open <p>x", "c"), (4, "u", "a < b & c &lt;d&gt; <p title='x>y", "c"), (5, "u", "<article><p>" + "long text. " * 20_000 + "</article>", "c")], "page_id bigint, url string, html string, text string")
    rows = o9.extract_pages(df).collect()
    assert len(rows) == 6 and o9.extract_pages(df.limit(0)).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r.page_id, r)
    assert by[1].text == by[2].text == "" and by[5].n_chars == len(("long text. " * 20_000).strip()) and all(r.n_chars == len(r.text) for r in rows)


def test_line_dedup(spark, odd):
    rows = o10.line_dedup(odd).collect()
    assert len(rows) == ROWS and o10.line_dedup(empty(spark)).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, r)
    assert tuple(by[10]) == (10, 4, 2, 1, "1,4") and by[0].n_lines == 0 and by[2].kept_lines == "" and by[12].n_kept + by[13].n_kept == 1


@pytest.mark.parametrize("rows", [docs, empty])
def test_stages(spark, tmp_path, rows):
    labels(spark, [(i, 1, 0) for i in range(8)]).write.parquet(str(tmp_path / "labels.parquet"))
    items(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    df = rows(spark)
    df.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns, name
        df = spark.createDataFrame(out.collect(), df.schema)
    assert {r.doc_id for r in df.collect()} >= ({0, 4, 7, 8, 9, 10, 11} if rows is docs else set())
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert (out.count() > 0) == (rows is docs)


def test_batches_of_long_texts_are_small(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    ship(spark)
    rows = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("word "), 2000).alias("text"))
    assert max(r.n for r in rows.mapInArrow(sizes, "n long").collect()) <= 8 << 20
    spark.conf.set(BATCH[0], "1000000")
    assert ship(spark).conf.get(BATCH[0]) == "1000000"  # a session's own bound stays
    spark.conf.set(*BATCH)

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from netloom.functions import dates, ip, paths

RNG = random.Random(4)


def plain_text(groups):
    """Eight groups in the canonical form, by trying every run of zeros."""
    runs = [(j - i, -i) for i in range(8) for j in range(i + 2, 9) if not any(groups[i:j])]
    text = [f"{g:x}" for g in groups]
    if not runs:
        return ":".join(text)
    n, i = max(runs)
    return ":".join(text[:-i]) + "::" + ":".join(text[-i + n :])


GROUPS = [[RNG.choice([0, 0, 1, RNG.randrange(65536)]) for _ in range(8)] for _ in range(60)] + [[0] * 8, [65535] * 8]
QUADS = [".".join(str(RNG.choice([0, 9, 10, 99, 100, 255, RNG.randrange(256)])) for _ in range(4)) for _ in range(40)]
SOUND = QUADS[0], plain_text(GROUPS[0])
# what each rule refuses, made from sound addresses
WRONG = [None, "", *(f"{x}{tail}" for x in SOUND for tail in ("/24", "%1", " 1", ".", ":")), *(f"[{x}]" for x in SOUND), "0" + "1.2.3.4", "1.2.3.256", "1.2.3", "1.2.3.4.5", ":".join("1" * 7), ":".join("1" * 9), "1::2::3", ":::1", "12345::", "x::", ":".join("1" * 8) + "::"]


def parsed(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("p", ip.parse_ip(F.col("t")))
    return [r.f for r in df.select("i", ip.format_ip(F.col("p.family"), F.col("p.addr")).alias("f")).orderBy("i").collect()]


def test_addresses_round_trip(spark):
    full = [":".join(f"{g:04X}" for g in gs) for gs in GROUPS]
    short = [plain_text(g) for g in GROUPS]
    assert parsed(spark, QUADS) == QUADS and parsed(spark, short) == short and parsed(spark, full) == short
    tails = [f"{x >> 24}.{x >> 16 & 255}.{x >> 8 & 255}.{x & 255}" for x in (g[6] << 16 | g[7] for g in GROUPS)]
    assert parsed(spark, [":".join(f"{x:x}" for x in g[:6]) + f":{t}" for g, t in zip(GROUPS, tails, strict=True)]) == short
    assert parsed(spark, [f"\t{x} " for x in QUADS]) == QUADS


def test_wrong_addresses_give_null(spark):
    assert parsed(spark, WRONG) == [None] * len(WRONG)


@pytest.mark.parametrize("addr,width", [("c0a8ff7f", 32), ("20010db8ffffffff0123456789abcdef", 128)])
def test_mask(spark, addr, width):
    rows = spark.range(width + 1).select("id", ip.mask(F.lit(addr), F.col("id").cast("int")).alias("m")).collect()
    for r in rows:
        assert int(r.m, 16) == int(addr, 16) >> (width - r.id) << (width - r.id) and len(r.m) == len(addr)


def compared(a, b):
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    x, y = a[k:], b[k:]
    kind = "same" if not x and not y else "one_ends" if k and not (x and y) else "shared_then_split" if k else "disjoint"
    return a, b, a[:k], x, y, set(x) & set(y), kind


CASES = [compared([RNG.randrange(3) for _ in range(RNG.randrange(6))], [RNG.randrange(3) for _ in range(RNG.randrange(6))]) for _ in range(200)]


def test_path_comparison(spark):
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CASES)], "i int, a array<bigint>, b array<bigint>")
    a, b = F.col("a"), F.col("b")
    for r in df.select("i", paths.trunk(a, b).alias("t"), paths.branch(a, b).alias("x"), paths.branch(b, a).alias("y"), paths.later_common(a, b).alias("l"), paths.comparison(a, b).alias("c")).collect():
        assert (r.t, r.x, r.y, set(r.l), r.c) == CASES[r.i][2:]


def test_collapse_hops_and_names(spark):
    df = spark.createDataFrame([([3491, 3491, 5, 3491],), ([],), (None,)], "p array<bigint>")
    assert [r[0] for r in df.select(paths.collapse(F.col("p"))).collect()] == [[3491, 5, 3491], [], None]
    assert [r[0] for r in df.select(paths.hops(F.col("p"))).collect()][:2] == [3, 0]
    df = spark.createDataFrame([("Org", "n"), ("Unknown organization", "n"), ("", ""), (None, None)], "o string, n string")
    assert [r[0] for r in df.select(paths.network_name(F.col("o"), F.col("n"))).collect()] == ["Org", "n", "not listed", "not listed"]


def test_path_attributes_as_columns(spark):
    df = spark.createDataFrame([([3491, 23456], [4200000000], None, False), ([3491, 1], [9], None, False), ([3491, 23456], [9], 3491, True), ([23456], [7, 8], None, False)], "p array<bigint>, q array<bigint>, agg bigint, has boolean")
    merged = paths.merge_as4(F.col("p"), F.col("q"), F.col("agg"), F.col("has"))
    assert [r[0] for r in df.select(paths.valid(merged)).collect()] == [[3491, 4200000000], [3491, 1], None, None]
    with pytest.raises(Exception, match="too long"):
        spark.range(1).select(paths.valid(F.sequence(F.lit(1).cast("bigint"), F.lit(257).cast("bigint")))).collect()


def test_dates(spark):
    now = F.lit("2026-05-04 10:00:00").cast("timestamp")
    days = spark.createDataFrame([("2026-05-04",), ("2025-02-29",), ("2026-5-4",), ("2026-05-05",), ("1999-12-31",), (None,)], "t string").select(dates.valid_date(F.col("t"), now).alias("d"))
    assert [r.d for r in days.collect()] == [date(2026, 5, 4)] + [None] * 5
    r = days.limit(1).select(dates.snapshot_id(F.col("d")), dates.snapshot_file(F.col("d")), dates.snapshot_path(F.col("d"))).first()
    assert tuple(r) == ("20260504T000000Z", "rib.20260504.0000.bz2", "2026.05/RIBS/rib.20260504.0000.bz2")
    assert days.limit(1).select(dates.snapshot_url(F.col("d"))).first()[0].endswith("/bgpdata/2026.05/RIBS/rib.20260504.0000.bz2")
    assert spark.range(1).select(dates.default_date(F.lit("2024-03-01 00:30:00").cast("timestamp"))).first()[0] == date(2024, 2, 29)

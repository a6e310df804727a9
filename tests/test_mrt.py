import bz2
import gzip
import random
import struct

import pytest

from netloom.plans.catalog import OBSERVED, SAMPLE, sample_dump
from netloom.plans.engine import Engine
from netloom.sources.mrt import Dump, MrtError, address_text, decode_path, unpacked

V4, V6 = "3491@123.255.90.244", "3491@2001:7fa:0:1::ca28:a0f4"
DATA = sample_dump()


def chunks(data, n=97):
    return [data[i : i + n] for i in range(0, len(data), n)]


def attr(kind, value, flags=0x50):
    return struct.pack(">BBH", flags, kind, len(value)) + value


def seq(*asns, kind=2):
    return bytes([kind, len(asns)]) + b"".join(a.to_bytes(4, "big") for a in asns)


def record(subtype, body, kind=13, size=None):
    return struct.pack(">IHHI", OBSERVED, kind, subtype, len(body) if size is None else size) + body


def rib(subtype, bits, prefix, index, value, path_id=b""):
    family = {6: b"\0\1\1", 12: b"\0\1\1"}.get(subtype, b"")
    return record(subtype, bytes(4) + family + (bytes(4) if subtype == 12 else b"") + bytes([bits]) + bytes.fromhex(prefix) + struct.pack(">HHI", 1, index, 0) + (bytes(4) if subtype in (8, 10) else b"") + struct.pack(">H", len(value)) + value)


PEERS = DATA[: 12 + struct.unpack(">I", DATA[8:12])[0]]


@pytest.mark.parametrize("pack", [bytes, gzip.compress, bz2.compress])
def test_encodings(pack):
    d = Dump(chunks(pack(DATA)))
    assert len(list(d)) == len(SAMPLE) - 1 and d.records == len(SAMPLE) + 2 and d.observed == OBSERVED
    assert [p[0] for p in d.peers if p[4]] == [V6, V4]


@pytest.mark.parametrize("subtype", [2, 8, 6, 12])
def test_subtypes(subtype):
    rows = list(Dump(chunks(PEERS + rib(subtype, 24, "c63364", 2, attr(2, seq(3491, 64496))))))
    assert [r[3:] for r in rows] == [(4, 24, "c6336400", [3491, 64496])]
    assert list(Dump(chunks(PEERS + record(3, b"x") + rib(subtype, 0, "", 2, attr(2, seq(1))))))[0][4] == 0


def test_path_attributes():
    assert decode_path(attr(2, seq(3491, 23456)) + attr(17, seq(4200000000))) == [3491, 4200000000]
    assert decode_path(attr(2, seq(3491, 1)) + attr(17, seq(9))) == [3491, 1]
    stale = attr(7, (3491).to_bytes(4, "big") + bytes(4)) + attr(18, bytes(8))
    assert decode_path(attr(2, seq(3491, 23456)) + attr(17, seq(9)) + stale) is None
    assert decode_path(attr(2, seq(3491, 23456)) + attr(17, seq(1, 2, 3))) is None
    for kind in (1, 3, 4):
        assert decode_path(attr(2, seq(1, kind=kind))) is None
    assert decode_path(attr(2, b"\2\5\0\0")) is None and decode_path(attr(2, seq(1, 0))) is None and decode_path(b"") is None and decode_path(attr(2, b"")) is None
    assert decode_path(attr(2, seq(*range(1, 129)) + seq(*range(1, 129)))) is not None
    for bad in (attr(2, seq(1)) * 2, attr(2, seq(*range(1, 200)) + seq(*range(1, 59))), b"\x50\2", b"\x50\2\0\5a"):
        with pytest.raises(MrtError):
            decode_path(bad)
    assert decode_path(b"\x40\2\6" + seq(7)) == [7]


BROKEN = {
    "header": DATA[:11], "last byte": DATA[:-1], "bzip2 end": bz2.compress(DATA)[:-5], "gzip end": gzip.compress(DATA)[:-4], "page": b"<html>not found</html>", "two tables": PEERS + DATA, "unknown peer": PEERS + rib(2, 24, "c63364", 9, b""),
    "type": record(2, b"", kind=12), "only peers": PEERS, "size": record(2, b"", size=67108865), "no peers": rib(2, 0, "", 0, b""), "subtype": PEERS + record(7, b""), "long prefix": PEERS + rib(2, 33, "c633640101", 2, b""),
    "rest": PEERS + record(2, bytes(4) + b"\0\0\0x"), "short": b"abc", "empty bzip2": b"BZh9", "garbage": bz2.compress(DATA) + b"garbage", "flags": record(1, bytes(6) + b"\0\1\4"), "cut peer": record(1, bytes(6) + b"\0\1\2"),
}


@pytest.mark.parametrize("name", BROKEN)
def test_broken_files_are_refused(name):
    with pytest.raises(MrtError):
        list(Dump(chunks(BROKEN[name])))


def test_one_flipped_bit_is_found():
    data = bytearray(bz2.compress(DATA))
    data[len(data) // 2] ^= 1
    with pytest.raises(MrtError):
        list(Dump(chunks(bytes(data))))


def test_long_and_joined_bzip2():
    out = random.Random(7).randbytes(300_000)
    assert b"".join(unpacked(chunks(bz2.compress(out), 1000))) == out
    assert b"".join(unpacked([bz2.compress(b"first ") + bz2.compress(b"") + bz2.compress(b"second")])) == b"first second"
    with pytest.raises(MrtError):
        list(unpacked([bz2.compress(out)], most_out=1000))


def test_address_text():
    assert address_text(bytes(16)) == "::" and address_text(bytes(15) + b"\1") == "::1" and address_text(bytes([192, 0, 2, 1])) == "192.0.2.1"
    assert address_text(bytes.fromhex("00010000000000020000000000000003")) == "1:0:0:2::3"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("store")
    (root / "in").mkdir()
    (root / "in" / "rib.bz2").write_bytes(bz2.compress(DATA))
    (root / "bad").mkdir()
    (root / "bad" / "rib.bz2").write_bytes(bz2.compress(DATA[:-1]))
    e = Engine(spark, str(root / "out"))
    e.load_rib(str(root / "in"))
    e.root = root
    return e


LOOKUPS = [("100.64.7.7", V4, "ok", "100.64.0.0/10", [3491, 7018]), ("203.0.113.9", V4, "ok", "203.0.113.0/24", [3491, 2914, 64499]), ("203.0.113.70", V4, "unsupported_path", None, None), ("198.51.100.7", V4, "ok", "198.51.100.7/32", [3491, 64500]), ("198.51.100.8", V4, "ok", "0.0.0.0/0", [3491, 1299]), ("192.0.3.1", V4, "unsupported_path", None, None), ("172.31.0.1", V4, "unsupported_path", None, None), ("2001:db8:7f::1", V6, "ok", "2001:db8:40::/42", [3491, 6939, 64501]), ("2001:db8:80::1", V6, "not_observed", None, None), ("2001:db8:40::", V4, "missing_family", None, None), ("203.0.113.9", V6, "missing_family", None, None), ("203.0.113.9", "64511@198.51.100.7", "unknown_peer", None, None), ("203.0.113", V4, "invalid_ip", None, None)]


def test_lookups(spark, engine):
    probes = spark.createDataFrame([(i, x[1], x[0]) for i, x in enumerate(LOOKUPS)], "probe_id int, peer_id string, ip string")
    got = {r.probe_id: (r.status, r.prefix, r.path) for r in engine.lookup(probes).collect()}
    assert got == {i: x[2:] for i, x in enumerate(LOOKUPS)}


def test_metadata_compare_and_failed_load(spark, engine):
    meta = {r.peer_id: r for r in engine.metadata().collect()}
    assert meta[V4].prefix_counts == {"4": 7} and meta[V4].is_default and not meta[V6].is_default and meta[V6].families == [6]
    r = engine.compare_paths(" 203.0.113.9", "100.64.7.7 ", V4).first()
    assert (r.trunk, r.branch_a, r.branch_b, r.relation) == ([3491], [2914, 64499], [7018], "shared_then_split")
    assert engine.compare_paths("203.0.113.9", "100.64.7.7").drop("pair_id").first() == engine.compare_paths("203.0.113.9", "100.64.7.7", V4).drop("pair_id").first()
    for a, b, p in (("", "100.64.7.7", V4), ("100.64.7", "100.64.7.7", V4), ("100.64.7.7", "100.64.7.7", "x")):
        with pytest.raises(Exception):
            engine.compare_paths(a, b, p).collect()
    before = engine.store.current()
    for path, more in (("bad", {}), ("in", {"max_routes": 1}), ("in", {"expected_date": "2026-01-01"}), ("in", {"max_path_asns": 2})):
        with pytest.raises(Exception):
            engine.load_rib(str(engine.root / path), **more)
    assert engine.store.current() == before and engine.store.table("routes").count() == 8
    again = engine.load_rib(str(engine.root / "in"), expected_date="2026-07-01")
    assert engine.store.current()["place"] == again and again.startswith("20260701T000000Z")


def test_new_dumps_as_a_stream(spark, engine, tmp_path):
    (tmp_path / "a").write_bytes(DATA)
    q = spark.readStream.format("mrt").option("path", str(tmp_path)).load().writeStream.format("memory").queryName("ribs").start()
    try:
        q.processAllAvailable()
        (tmp_path / "b").write_bytes(gzip.compress(DATA))
        q.processAllAvailable()
        assert spark.table("ribs").groupBy("file").count().count() == 2 and spark.table("ribs").count() == 18
    finally:
        q.stop()

import hashlib
import random
import zlib

import pytest

from tessella.llm import media, queries


@pytest.mark.parametrize("n", [0, 1, 160, 161, 162, 163, 168, 169, 170, 171, 175, 183, 184, 185, 400, 576, 36864, 36865, 100_000, 700_001])
@pytest.mark.parametrize("rap", [1, 8])
def test_round_trip_is_lossless(n, rap):
    body = random.Random(n).randbytes(n)
    s = media.demux(media.Muxer(rap_every=rap)(body))
    assert b"".join(u.data for u in s.units) == body
    assert (s.gaps, s.bad_tables, s.lost_sync, s.duplicates) == (0, 0, 0, 0) and s.programs == {1: 0x100} and s.streams == {0x101: 6}
    assert [u.pts for u in s.units] == [k * media.TICKS for k in range(len(s.units))]
    assert [u.random_access for u in s.units] == [k % rap == 0 for k in range(len(s.units))] and not any(u.damaged for u in s.units)


def test_faults_are_found():
    body = random.Random(1).randbytes(150_000)
    good = media.Muxer()(body)
    p = media.PACKET
    lost = media.demux(good[: 10 * p] + good[11 * p :])
    assert lost.gaps == 1 and [u.damaged for u in lost.units] == [True] + [False] * 4
    twice = media.demux(good[: 11 * p] + good[10 * p :])
    assert (twice.duplicates, twice.gaps) == (1, 0) and b"".join(u.data for u in twice.units) == body
    bad = bytearray(good)
    bad[p + 12] ^= 1
    assert media.demux(bytes(bad)).bad_tables == 1 and media.demux(bytes(bad)).units == []
    slipped = media.demux(good[: 20 * p] + b"noise" + good[20 * p :])
    assert slipped.lost_sync == 1 and b"".join(u.data for u in slipped.units) == body
    assert media.demux(b"").units == [] and media.demux(b"junk" * 100).units == []


def test_streams_can_be_joined_at_every_access_point():
    body = random.Random(4).randbytes(media.UNIT * 21)
    stream = media.Muxer()(body)
    whole = media.demux(stream)
    assert whole.bad_tables == whole.gaps == 0 and sum(u.random_access for u in whole.units) == 3
    for k in (8, 16):
        starts = [i for i in range(0, len(stream), media.PACKET) if stream[i : i + 3] == b"\x47\x40\x00"]
        late = media.demux(stream[starts[k // 8] :])
        assert late.units[0].random_access and b"".join(u.data for u in late.units) == body[k * media.UNIT :]


def test_tables_over_several_packets():
    table = media.crc_table().tolist()
    many = 60  # streams: their map takes 315 bytes
    pmt = media.section(2, 1, media.struct.pack(">HH", 0xE101, 0xF000) + b"".join(media.struct.pack(">BHH", 6, 0xE000 | 0x200 + i, 0xF000) for i in range(many)))
    pat = media.section(0, 1, media.struct.pack(">HH", 1, 0xE100))
    first, n = media.section_packets(0x100, pmt, 14)
    again, _ = media.section_packets(0x100, pmt, n)
    head = media.section_packets(0, pat, 3)[0]
    assert n > 15 and media.demux(head + first + again).streams == {0x200 + i: 6 for i in range(many)}
    s = media.demux(head + first + again, table)
    assert (s.bad_tables, s.programs) == (0, {1: 0x100})
    cut = media.demux(head + first[: media.PACKET] + again)  # its second packet is lost
    assert cut.bad_tables == 1 and len(cut.streams) == many


def test_feature_lists_all_access_points():
    s = media.demux(media.Muxer(unit=576, rap_every=1)(b"x" * 576 * 9))
    assert media.describe(s).endswith("access=9:" + ",".join(str(k * media.TICKS) for k in range(9)))


def test_pts_round_trip():
    for x in (0, 1, 2**15, 2**30 + 5, 2**33 - 1):
        assert media.pts_value(media.pts_bytes(x)) == x


def test_digests_of_odd_texts(spark):
    texts = [None, "", "é" * 600, "x" * 300_000, "a", "a", "y" * 576]
    docs = spark.createDataFrame([(i if i else None, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r["doc_id"]: r for r in media.digests(media.store_texts(docs)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        body = raw.ljust(max(576, -(-len(raw) // 576) * 576), b"\xff")
        r = got[i or None]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:]))
    assert got[4][1:] == got[5][1:]
    units = media.access_units(media.store_texts(docs)).where("doc_id = 3").orderBy("_unit").collect()
    assert b"".join(u["_data"] for u in units).rstrip(b"\xff") == b"x" * 300_000
    assert media.digests(media.store_texts(docs.limit(0))).collect() == []
    clash = media.access_units(media.store_texts(docs).withColumn("_pts", media.F.lit("own")))
    assert {"_pts", "__pts", "__data"} <= set(clash.columns) and clash.first()["_pts"] == "own"


def test_query_covers_every_document(spark, sf):
    got = queries.op5_transport_streams(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and all(";gaps=0;damaged=0;" in r["feature"] for r in got)

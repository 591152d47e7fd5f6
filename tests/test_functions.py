import math

import pytest
from pyspark.sql import functions as F

from tessella.errors import FormatError, MissingExtraError
from tessella.functions import blobs, geometry, morton
from tessella.operators import catalogs


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_morton_bits_and_round_trip(spark):
    fixed = {(1, 0, 0): 1, (0, 1, 0): 2, (0, 0, 1): 4, (1, 1, 1): 7, (2, 0, 0): 8, (0, 0, 2): 32}
    for (i, j, k), code in fixed.items():
        assert one(spark, morton.encode(F.lit(i), F.lit(j), F.lit(k)))[0] == code
    for t in ((3, 5, 9), (17, 2, 300), (1, 0, 65536), (131071, 131071, 131071)):
        code = morton.encode(*map(F.lit, t))
        assert tuple(one(spark, *morton.decode(code))) == t
    for bad in ((-1, 0, 0), (0, 131072, 0)):
        with pytest.raises(Exception, match="outside"):
            one(spark, morton.encode(*map(F.lit, bad)))


def test_box_of_a_cell(spark):
    origin, extent = morton.box(morton.encode(F.lit(2), F.lit(1), F.lit(3)), F.lit(1), (128, 128, 64))
    assert tuple(one(spark, *origin, *extent)) == (512.0, 256.0, 384.0, 256.0, 256.0, 128.0)


def test_positions(spark):
    q = [geometry.quantize(F.lit(x), F.lit(0.0), F.lit(128.0)) for x in (0.0, 128.0, 64.0)]
    assert tuple(one(spark, *q)) == (0, 65535, 32768)
    with pytest.raises(Exception, match="outside its cell"):
        one(spark, geometry.quantize(F.lit(200.0), F.lit(0.0), F.lit(128.0)))
    packed = blobs.pack(F.array(F.lit(0), F.lit(65535), F.lit(258)), 2)
    assert bytes(one(spark, packed)[0]) == b"\x00\x00\xff\xff\x02\x01"
    assert one(spark, blobs.unpack(packed, 2))[0] == [0, 65535, 258]
    assert one(spark, blobs.unpack(F.unhex(F.lit("")), 4))[0] == []
    with pytest.raises(Exception, match="whole numbers"):
        one(spark, blobs.unpack(F.unhex(F.lit("0102")), 4))


def test_snap_keeps_both_sides_of_a_plane_alike(spark):
    xs, fixed = geometry.snap([F.lit(128.004), F.lit(50.1234567), F.lit(10.0)], (128, 128, 64), 3)
    r = one(spark, *xs, fixed)
    step = 512 / 65535
    assert r[0] == 128.0 and r[1] == round(50.1234567 / step) * step and r[3]
    xs, fixed = geometry.snap([F.lit(100.0), F.lit(50.1234567), F.lit(10.0)], (128, 128, 64), 3)
    assert tuple(one(spark, *xs, fixed)) == (100.0, 50.1234567, 10.0, False)


def test_targets_and_cameras(spark):
    for (n, level, floor), want in {(1000, 3, 4): 16, (1000, 3, 32): 32, (10, 1, 1): 2, (14, 1, 1): 4, (6, 1, 1): 2}.items():
        assert one(spark, geometry.target_faces(F.lit(n), F.lit(level), 0.25, floor))[0] == want
    cam = geometry.Camera.perspective((0, 0, -10), math.pi / 2, 200)
    assert abs(cam.focal - 100) < 1e-9
    box = [F.lit(-1.0)] * 3, [F.lit(1.0)] * 3
    assert abs(one(spark, cam.pixels(F.lit(0.9), *box))[0] - 10) < 1e-9
    assert one(spark, geometry.Camera((0, 0, 0), 1).pixels(F.lit(1.0), *box))[0] == math.inf
    for fov in (0, math.pi):
        with pytest.raises(ValueError):
            geometry.Camera.perspective((0, 0, 0), fov, 1)


def test_touching_boxes_overlap_and_planes_keep_the_far_corner(spark):
    lo, hi = [F.lit(0.0)] * 3, [F.lit(1.0)] * 3
    assert one(spark, geometry.overlaps(lo, hi, ((1, 1, 1), (2, 2, 2))), geometry.overlaps(lo, hi, ((1.1, 0, 0), (2, 2, 2))))[:] == (True, False)
    assert one(spark, geometry.inside_planes(lo, hi, [(1, 0, 0, -1)]), geometry.inside_planes(lo, hi, [(1, 0, 0, -1.1)]), geometry.inside_planes(lo, hi, [(-1, 0, 0, 0)]))[:] == (True, False, True)


def test_encodings_that_cannot_be():
    for bad in (("X", "NONE", "UINT32"), ("NONE", "X", "UINT32"), ("MESHOPT", "ZSTD", "UINT32"), ("NONE", "NONE", "UINT16"), ("NONE", "NONE", "X")):
        with pytest.raises(FormatError):
            blobs.check_encoding(*bad)
    try:
        import meshoptimizer  # noqa: F401
    except ImportError:
        with pytest.raises(MissingExtraError):
            blobs.check_encoding("MESHOPT", "NONE")


def test_cell_size(spark):
    df = spark.createDataFrame([(i, 0.0, 0.0, 0.0, 20.0, 100.0, 3.0) for i in range(5)], "object_id long, " + ", ".join(f"{b} double" for b in catalogs.BOUNDS))
    assert catalogs.choose_cell_size(df) == (32, 128, 4)


def test_ordinals_are_dense(spark):
    ids = [5, -7, 1 << 40, 12, 12]
    got = catalogs.ordinals(spark.createDataFrame([(i,) for i in ids], "object_id long")).collect()
    assert {r["object_id"]: r["ordinal"] for r in got} == {x: n for n, x in enumerate(sorted(set(ids)))}
    assert catalogs.ordinals(spark.createDataFrame([], "object_id long")).collect() == []


def test_sql_functions(spark):
    from tessella.functions.register import register

    assert "morton_encode" in register(spark)
    r = spark.sql("SELECT morton_encode(3, 5, 9) AS c, morton_decode(morton_encode(17, 2, 300)) AS d, cell_ancestor(64, 2) AS a, cell_octant(13) AS o, quantize(64, 0, 128) AS q, target_faces(10, 1, 0.25, 1) AS t, screen_error(0.9, box_gap(-1, -1, -1, 1, 1, 1, 0, 0, -10), 100) AS s").first()
    assert r["c"] == one(spark, morton.encode(F.lit(3), F.lit(5), F.lit(9)))[0] and tuple(r["d"]) == (17, 2, 300)
    assert (r["a"], r["o"], r["q"], r["t"], round(r["s"], 9)) == (1, 5, 32768, 2, 10.0)
    with pytest.raises(Exception, match="out of range"):
        spark.sql("SELECT morton_encode(-1, 0, 0)").collect()

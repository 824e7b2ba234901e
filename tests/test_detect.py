"""The raster plan on made scenes with a known truth, registration and outlines."""

import json
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from geochange.functions import scalar as S
from geochange.operators import alignment, features, outlines, raster, resampling, summed
from geochange.operators.resampling import Grid
from geochange.plans import detect


def scene(spark, size=80, cloud=None, change=(20, 50, 30, 60), factor=0.4):
    px = spark.range(size * size).select((F.col("id") / size).cast("long").alias("r"), (F.col("id") % size).alias("c"))
    noise = F.pmod(F.xxhash64("r", "c"), F.lit(40))
    r0, r1, c0, c1 = change
    hit = F.col("r").between(r0, r1 - 1) & F.col("c").between(c0, c1 - 1)
    nir = 3500 + noise
    out = px.select("r", "c", *[(base + noise).alias(f"{b}_{d}") for b, base in (("b02", 400), ("b03", 700), ("b04", 500)) for d in "ab"], nir.alias("b08_a"), F.when(hit, nir * factor).otherwise(nir).cast("long").alias("b08_b"))
    clear = F.lit(True)
    if cloud:
        clear = ~(F.col("r").between(cloud[0], cloud[1] - 1) & F.col("c").between(cloud[2], cloud[3] - 1))
    return out.withColumn("scl_a", F.lit(4)).withColumn("scl_b", F.when(clear, 4).otherwise(9))


def test_one_patch_is_found(spark):
    d = detect.detect(scene(spark), 80, levels=(10,), chunk=40)
    (one,) = d.detections.collect()
    assert d.status == "completed" and d.trace["mutual_coverage"] == 1.0
    assert (one.min_x, one.min_y, one.max_x, one.max_y, one.area_px) == (30.0, 20.0, 60.0, 50.0, 900)
    # One blob: its rank in a pool of one peak is a half.
    assert one.confidence == pytest.approx(0.35 * 0.9 + 0.35 * 0.5 + 0.15 + 0.15)
    assert one.mean_dndvi < -0.05


def test_a_shifted_scene_of_other_gain_is_put_right(spark):
    """Date b is date a moved by (3, -2), brighter and lifted, with one patch cleared."""
    size = 96
    rng = np.random.default_rng(1)
    waves = [(rng.normal(0, 0.16, 2), rng.uniform(0, 6)) for _ in range(25)]
    image = lambda y, x: 3000 + 150 * sum(np.sin(k[0] * y + k[1] * x + p) for k, p in waves)
    y, x = np.mgrid[0:size, 0:size].astype(float)
    a, b = image(y, x), image(y + 2, x - 3)
    b = 1.2 * b + 100
    b[40:60, 30:50] *= 0.6
    rows = [(i, j, 4, 4, *(int(v) for v in (a[i, j] / 4, a[i, j] / 3, a[i, j] / 5, a[i, j], b[i, j] / 4, b[i, j] / 3, b[i, j] / 5, b[i, j]))) for i in range(size) for j in range(size)]
    px = spark.createDataFrame(rows, "r long, c long, scl_a int, scl_b int, b02_a long, b03_a long, b04_a long, b08_a long, b02_b long, b03_b long, b04_b long, b08_b long")
    d = detect.detect(px, size, same_tile=False, levels=(10,), chunk=64)
    assert d.status == "completed" and d.trace["alignment"] == "aligned"
    assert d.trace["slope"][3] == pytest.approx(1 / 1.2, abs=0.08) and d.trace["tier"] == "pif"
    one = max(d.detections.collect(), key=lambda r: r.area_px)
    assert abs(one.min_x - 27) <= 1 and abs(one.min_y - 42) <= 1 and abs(one.area_px - 400) <= 60
    assert one.evidence.share_a is not None and abs(one.centre_x - 37) < 1 and one.outline
    assert detect.detect(px.withColumn("b08_b", F.lit(500)), size, same_tile=False, chunk=64).status == "alignment_failed"


def test_pixels_without_data_are_no_evidence(spark):
    px = scene(spark)
    assert detect.detect(px.withColumn("b03_b", F.when(F.col("c") < 70, 0).otherwise(F.col("b03_b"))), 80, chunk=40).status == "insufficient_evidence"
    d = detect.detect(px.drop("scl_a", "scl_b"), 80, levels=(10,), chunk=40, pixel_ha=0.09)
    assert d.detections.first().area_ha == pytest.approx(81.0)


@pytest.mark.parametrize("chunk", [5, 16, 64])
def test_morphology_does_not_depend_on_chunks(spark, chunk):
    mask = np.random.default_rng(2).random((29, 37)) < 0.75

    def around(m, all_of):
        out = np.zeros_like(m)
        for y, x in np.ndindex(*m.shape):
            near = m[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2]
            out[y, x] = near.all() if all_of else near.any()
        return out

    want = around(around(around(around(mask, True), False), False), True)
    df = spark.createDataFrame([(int(y), int(x)) for y, x in zip(*np.nonzero(mask), strict=True)], "r long, c long")
    assert {(r.r, r.c) for r in raster.opened_closed(df, 29, 37, chunk).collect()} == {(int(y), int(x)) for y, x in zip(*np.nonzero(want), strict=True)}


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=4000), np.repeat(0.5, 2000)])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    assert raster.quantiles(df, "v", (0.0, 0.02, 0.2, 0.75, 0.98, 1.0), 16) == pytest.approx(np.percentile(v, [0, 2, 20, 75, 98, 100]).tolist())
    assert raster.quantiles(df.where("false"), "v", (0.5,)) == [None]


@pytest.mark.parametrize("chunk", [7, 64])
def test_warps_turn_and_shift(spark, chunk):
    rows = [(int(i), int(j), float(3 * i + 5 * j), int(i)) for i in range(20) for j in range(30)]
    df = spark.createDataFrame(rows, "r long, c long, v double, m int")
    angle, dx, dy = 0.1, 1.3, -0.6
    for r in raster.warped(df, ["v"], raster.turn(angle, dx, dy, 20, 30), 20, 30, "m", chunk).collect():
        sx = np.cos(angle) * (r.c - 14.5) - np.sin(angle) * (r.r - 9.5) + 14.5 + dx
        sy = np.sin(angle) * (r.c - 14.5) + np.cos(angle) * (r.r - 9.5) + 9.5 + dy
        if 0 <= sx <= 29 and 0 <= sy <= 19:
            assert r.v == pytest.approx(3 * sy + 5 * sx) and r.m == int(np.floor(sy + 0.5))
        else:
            assert r.v is None


GRID = Grid("EPSG:32643", 10, 10, (10.0, 0.0, 600000.0, 0.0, -10.0, 3000000.0))


def test_grids_and_samples(spark):
    g = GRID
    near, far = (replace(g, transform=(10.0, 0.0, x, 0.0, -10.0, 3000000.0)) for x in (600000.1, 600001.0))
    assert g.same(near) and not g.same(far) and not g.same(replace(g, crs="EPSG:32644")) and not g.same(replace(g, width=11))
    assert not g.same(replace(g, transform=(20.0, 0.0, 600000.0, 0.0, -20.0, 3000000.0)))
    a, b = "S2A_MSIL2A_20220623T052701_N0400_R105_T43RGM_x", "S2B_MSIL2A_20230623T052701_N0400_R105_T43RGM_y"
    assert detect.same_tile(a, b, g, near) and not detect.same_tile(a, b, g, far) and not detect.same_tile(a, b.replace("T43RGM", "T43RGN"), g, g)
    assert not detect.same_tile("20220623T052701", "20220623T052701", g, g) and not detect.same_tile(None, None, g, g)
    assert (alignment.decimation(10980, 10980), alignment.decimation(3000, 3000)) == (4, 1)
    px = spark.range(20000).select(F.col("id").alias("r"), F.lit(0).alias("c"))
    n = raster.bounded_sample(px, 2000, 20000).count()
    assert 1700 < n < 2300 and raster.bounded_sample(px, 2000, 20000).count() == n and raster.bounded_sample(px, 20000, 20000).count() == 20000


def test_numbers_of_the_projection(spark):
    """The arrays of a task and the columns of the library give one result, there and back."""
    lon, lat = np.array([72.1, 77.9, 81.5, -3.3, 147.2]), np.array([0.5, 28.6, 45.0, 55.9, -43.1])
    for o, a in zip(lon, lat, strict=True):
        zone = int((o + 180) // 6) + 1
        got = spark.range(1).select(*[v.alias(k) for k, v in S.utm(F.lit(float(o)), F.lit(float(a))).items()]).first()
        x, y = resampling.utm_forward(np.array([o]), np.array([a]), zone, a < 0)
        assert (x[0], y[0]) == pytest.approx((got.easting, got.northing), abs=1e-6)
        back = resampling.utm_backward(x, y, zone, a < 0)
        assert (back[0][0], back[1][0]) == pytest.approx((o, a), abs=1e-8)


def _dense(place, image, mask, height, width):
    """Bilinear over neighbours with data, and nearest, pixel by pixel."""
    out = {}
    h, w = image.shape
    for r in range(height):
        for c in range(width):
            y, x = (float(v) for v in place(np.array(float(r)), np.array(float(c))))
            y0, x0 = int(np.floor(y)), int(np.floor(x))
            total = weight = 0.0
            for i in (0, 1):
                for j in (0, 1):
                    k = ((y - y0) if i else 1 - (y - y0)) * ((x - x0) if j else 1 - (x - x0))
                    if k > 0 and 0 <= y0 + i < h and 0 <= x0 + j < w and image[y0 + i, x0 + j] != 0:
                        total, weight = total + k * image[y0 + i, x0 + j], weight + k
            ny, nx = int(np.floor(y + 0.5)), int(np.floor(x + 0.5))
            value = total / weight if weight > 1e-5 else None
            near = int(mask[ny, nx]) if 0 <= ny < h and 0 <= nx < w else None
            if value is not None or near is not None:
                out[r, c] = value, near
    return out


@pytest.mark.parametrize("other", [Grid("EPSG:32643", 20, 24, (20.0, 0.0, 599970.0, 0.0, -20.0, 3000050.0)), Grid("EPSG:32644", 60, 60, (10.0, 0.0, 15700.0, 0.0, -10.0, 3003600.0)), Grid("EPSG:4326", 30, 30, (2e-4, 0.0, 82.0, 0.0, -2e-4, 27.1))])
@pytest.mark.parametrize("chunk", [9, 512])
def test_rasters_of_other_grids(spark, other, chunk):
    """20 metres on 10, the neighbouring zone, and degrees, against a dense computation."""
    own = Grid("EPSG:32643", 37, 31, (10.0, 0.0, 600000.0, 0.0, -10.0, 3000000.0))
    if other.crs != own.crs:  # where the two overlap
        lon, lat = own.lonlat(*own.xy(np.array(15.0), np.array(18.0)))
        x, y = resampling.utm_forward(lon, lat, *other.zone) if other.zone else (lon, lat)
        sx, _, _, _, sy, _ = other.transform
        other = replace(other, transform=(sx, 0.0, float(x) - sx * other.width / 2, 0.0, sy, float(y) - sy * other.height / 2))
    rng = np.random.default_rng(4)
    image = rng.integers(1, 4000, size=(other.height, other.width))
    image[rng.random(image.shape) < 0.1] = 0
    mask = rng.integers(0, 12, size=image.shape)
    df = spark.createDataFrame([(i, j, int(image[i, j]), int(mask[i, j])) for i in range(other.height) for j in range(other.width)], "r long, c long, b04 int, scl int")
    got = {(r.r, r.c): (r.b04, r.scl) for r in resampling.on_grid(df, ["b04"], other, own, "scl", chunk).collect()}
    want = _dense(own.to(other), image, mask, own.height, own.width)
    assert len(want) > 500 and got.keys() == want.keys()
    for k, (v, m) in want.items():
        assert got[k] == (pytest.approx(v) if v is not None else None, m)


def test_a_pair_of_two_grids(spark):
    own = Grid("EPSG:32643", 12, 10, (10.0, 0.0, 600000.0, 0.0, -10.0, 3000000.0))
    other = Grid("EPSG:32643", 6, 5, (20.0, 0.0, 600000.0, 0.0, -20.0, 3000000.0))
    make = lambda g: spark.range(g.width * g.height).select(F.floor(F.col("id") / g.width).alias("r"), (F.col("id") % g.width).alias("c"), *[F.lit(100 * i).alias(b) for i, b in enumerate(raster.BANDS, 1)], F.lit(4).alias("scl"))
    px, trace = detect.paired(make(own), make(other), own, other)
    assert trace == {"grid_matched": False, "regridded": True, "scl_resampling": "nearest"} and px.count() == 120
    assert px.where("b08_b = b08_a and scl_b = 4").count() == 120
    assert detect.paired(make(own), make(own), own, own)[1] == {"grid_matched": True}


def _waves(seed=1):
    rng = np.random.default_rng(seed)
    waves = [(rng.normal(0, 0.35, 2), rng.uniform(0, 6)) for _ in range(60)]
    return lambda y, x: sum(np.sin(k[0] * y + k[1] * x + p) for k, p in waves)


@pytest.mark.parametrize("chunk", [80, 512])
def test_features_give_a_known_homography_back(spark, chunk):
    """Three pairs: a homography with another contrast and a third of the ground changed, two unrelated images, a flat one."""
    size = 150
    image = _waves()
    y, x = np.mgrid[0:size, 0:size].astype(float)
    m = np.array([[1.004, -0.03, 6.0], [0.028, 0.997, -4.5], [2e-5, -1e-5, 1.0]])
    inv = np.linalg.inv(m)
    w = inv[2, 0] * x + inv[2, 1] * y + inv[2, 2]
    b = 3 * image((inv[1, 0] * x + inv[1, 1] * y + inv[1, 2]) / w, (inv[0, 0] * x + inv[0, 1] * y + inv[0, 2]) / w) + 7
    b[100:, :] = _waves(9)(y, x)[100:, :]
    pairs = [(1, image(y, x), b), (2, image(y, x), _waves(5)(y, x)), (3, image(y, x), np.full_like(b, 3.0))]
    rows = [(k, i, j, float(p[i, j]), float(q[i, j]), True) for k, p, q in pairs for i in range(size) for j in range(size)]
    df = spark.createDataFrame(rows, "pair_id long, r long, c long, a double, b double, valid boolean")
    got = {r.pair_id: r for r in features.register(df, chunk=chunk).collect()}
    assert got[1].status == "aligned" and got[1].matches >= 15 and got[1].inlier_ratio >= 0.3 and got[1].reason is None
    ends = np.array([[0, 0], [size - 1, 0], [0, 99], [size - 1, 99], [75, 50.0]])
    off = features.moved(np.array(got[1].matrix).reshape(1, 3, 3), ends)[0] - features.moved(m[None], ends)[0]
    assert np.abs(off).max() < 0.5
    assert got[2].status == got[3].status == "alignment_failed"
    assert "inlier ratio" in got[2].reason or "ORB matches" in got[2].reason or "shift" in got[2].reason
    assert got[3].reason == "ORB found no keypoints" and got[3].matches == 0
    again = {r.pair_id: r for r in features.register(df.repartition(7), chunk=chunk).collect()}
    assert again == got


def test_consensus_finds_the_map_among_wrong_pairs():
    rng = np.random.default_rng(2)
    m = np.array([[1.01, 0.02, -3.0], [-0.015, 0.99, 5.0], [1e-5, 2e-5, 1.0]])
    p = rng.uniform(0, 500, size=(200, 2))
    q = features.moved(m[None], p)[0] + rng.normal(0, 0.3, size=p.shape)
    q[80:] = rng.uniform(0, 500, size=(120, 2))
    found, agree = features.consensus(p, q)
    assert agree[:80].all() and agree.sum() < 90
    assert np.abs(features.moved(found[None], p[:80])[0] - features.moved(m[None], p[:80])[0]).max() < 0.5
    assert np.array_equal(features.consensus(p, q)[0], found)
    assert features.consensus(p[:3], q[:3])[0] is None and features.consensus(np.zeros((9, 2)), np.zeros((9, 2)))[0] is None
    half = features.at_full_size(np.array([[1, 0, 2.0], [0, 1, -1.0], [0, 0, 1.0]]), 4)
    assert features.corner_shift(half, 400, 300) == pytest.approx(4 * np.hypot(2, 1))


def test_a_pair_that_correlation_refuses_goes_by_features(spark):
    """Half of the ground is another; correlation stays under its bound, features agree on the other half."""
    size = 140
    y, x = np.mgrid[0:size, 0:size].astype(float)
    image = _waves()
    a, b = 3000 + 120 * image(y, x), 3000 + 120 * image(y + 2, x - 3)
    b[80:, :] = 3000 + 120 * _waves(3)(y, x)[80:, :]
    rows = [(i, j, *(int(v) for v in (a[i, j] / 4, a[i, j] / 3, a[i, j] / 5, a[i, j], b[i, j] / 4, b[i, j] / 3, b[i, j] / 5, b[i, j]))) for i in range(size) for j in range(size)]
    px = spark.createDataFrame(rows, "r long, c long, b02_a long, b03_a long, b04_a long, b08_a long, b02_b long, b03_b long, b04_b long, b08_b long")
    moved, trace = detect.aligned(px, size, size)
    assert trace["method"] == "orb" and trace["alignment"] == "aligned" and trace["ecc_failure"] and trace["inlier_ratio"] >= 0.3
    off = moved.where("r between 10 and 60 and c between 10 and 120").select(F.avg(F.abs(F.col("b08_a") - F.col("b08_b")))).first()[0]
    assert off < 30  # against an amplitude of hundreds


@pytest.mark.parametrize("chunk", [5, 16, 64])
def test_boxes_by_summed_areas(spark, chunk):
    rng = np.random.default_rng(chunk)
    mask = rng.random((40, 33)) < 0.4
    mask[10:30, 5:20] = False
    boxes = []
    for i in range(60):
        r, c = np.sort(rng.integers(0, 40, 2)), np.sort(rng.integers(0, 33, 2))
        boxes.append((i, int(r[0]), int(r[1]), int(c[0]), int(c[1])))
    boxes += [(60, 0, 39, 0, 32), (61, 39, 39, 32, 32), (62, 15, 15, 7, 9)]
    px = spark.createDataFrame([(int(r), int(c)) for r, c in zip(*np.nonzero(mask), strict=True)], "r long, c long")
    df = spark.createDataFrame(boxes, "label long, min_r long, max_r long, min_c long, max_c long")
    got = {r.label: r.coverage for r in summed.box_coverage(px, df, 40, 33, chunk).collect()}
    assert got == {k: pytest.approx(mask[a : b + 1, c : d + 1].mean()) for k, a, b, c, d in boxes}
    assert {r.coverage for r in summed.box_coverage(px.where("false"), df, 40, 33, chunk).collect()} == {0.0}


def test_two_means_gate_on_the_class_of_change(spark):
    quiet = spark.createDataFrame([(0.0,)] * 90 + [(0.05,)] * 10, "v double")
    assert tuple(raster.two_means(quiet, "v").first()) == pytest.approx((0.0, 0.05, 0.025))
    assert raster.two_means(quiet.withColumn("v", F.col("v") / 2), "v").first().threshold is None
    assert raster.two_means(spark.createDataFrame([(0.4,)] * 5, "v double"), "v").first().threshold is None
    assert raster.two_means(quiet.where("false"), "v").first().low is None
    rng = np.random.default_rng(6)
    for _ in range(3):
        v = np.concatenate([rng.normal(0.1, 0.05, 300), rng.normal(0.5, 0.2, 60), rng.normal(2, 0.1, 5)])
        s = np.sort(v)
        best = min(((s[:k].var() * k + s[k:].var() * (len(s) - k), k) for k in range(1, len(s))))[1]
        got = raster.two_means(spark.createDataFrame([(float(x),) for x in v], "v double"), "v").first()
        assert (got.low, got.high) == pytest.approx((s[:best].mean(), s[best:].mean()))


def test_all_bands_choose_the_stable_pixels(spark):
    """A pixel that one band alone takes for stable isn't; too few pixels leave the scene as it is, with the reason."""
    size = 60
    px = spark.range(size * size).select(F.floor(F.col("id") / size).alias("r"), (F.col("id") % size).alias("c"))
    noise = lambda k: F.pmod(F.xxhash64("r", "c", F.lit(k)), F.lit(1000))
    px = px.withColumns({"a1": 1000.0 + noise(1), "a2": 2000.0 + noise(2)})
    changed = F.col("c") < 12
    px = px.withColumns({"b1": F.col("a1") / 1.25 - 40, "b2": F.when(changed, 9000.0 - noise(3)).otherwise(F.col("a2") * 0.8 + 100)})
    fit = raster.invariant_fit(px, [("a1", "b1"), ("a2", "b2")])
    assert fit.tier == "identity" and fit.notes == ("only 720 pseudo-invariant pixels",)
    fit = raster.invariant_fit(px.unionByName(px.withColumn("r", F.col("r") + size)), [("a1", "b1"), ("a2", "b2")])
    assert fit.tier == "pif" and abs(fit.n - 1440) < 20 and fit.slope == pytest.approx((1.25, 1.25)) and fit.intercept == pytest.approx((50.0, -125.0))
    few = raster.invariant_fit(px.limit(900), [("a1", "b1")])
    assert (few.tier, few.slope, few.notes) == ("identity", (1.0,), ("too few valid pixels",))
    flat = raster.invariant_fit(px.unionByName(px.withColumn("r", F.col("r") + size)).withColumns({"b1": F.lit(7.0)}), [("a1", "b1"), ("a1", "b1")])
    assert flat.slope == (1.0, 1.0) and flat.notes[0] == "band 1: PIF pixels have no variance; left unchanged"
    # Every other strip counts for the first line and the quantile.
    tall = px.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("r", F.col("r") + size * F.col("k")).withColumn("b1", F.when(F.floor(F.col("r") / 10) % 2 == 1, 5.0 * F.col("a1")).otherwise(F.col("b1")))
    assert raster.invariant_fit(tall, [("a1", "b1")], rows=10, strips=12).slope == pytest.approx((1.25,))


def test_ranks_count_blobs_that_thin_ground_drops(spark):
    """Two patches; the stronger one lies in clouds but for a sliver. It is dropped, and the other is still ranked below it."""
    px = scene(spark, size=120, change=(10, 40, 10, 40))
    ring = F.col("r").between(60, 105) & F.col("c").between(60, 105)
    slit = ring & ((F.col("r") - 60 < 5) | (F.col("c") - 60 < 5))
    px = px.withColumn("b08_b", F.when(slit, F.col("b08_a") * 2.2).otherwise(F.col("b08_b")).cast("long")).withColumn("scl_b", F.when(ring & ~slit, 9).otherwise(F.col("scl_b")))
    found = detect.detect(px, 120, levels=(5,), chunk=64, normalise=False).detections.collect()
    assert [r.area_px for r in found] == [900]
    assert found[0].confidence == pytest.approx(0.35 * 0.9 + 0.35 * 0.25 + 0.15 + 0.15)
    assert found[0].evidence.rule


def test_without_a_nir_band(spark):
    px = scene(spark).drop("b08_a", "b08_b").withColumn("b02_b", F.when(F.col("r").between(20, 49) & F.col("c").between(30, 59), F.col("b02_b") + 3000).otherwise(F.col("b02_b")))
    (one,) = detect.detect(px, 80, levels=(10,), chunk=40, normalise=False).detections.collect()
    assert (one.area_px, one.direction, one.change_type, one.mean_dndvi, one.evidence) == (900, None, "unclassified", None, None)
    assert raster.dn_scale("uint8") == 255.0 and raster.dn_scale("uint16") == 10000.0 and raster.dn_scale("float32") == 1.0


def test_clouds_are_no_change_and_hide_it(spark):
    d = detect.detect(scene(spark, cloud=(0, 80, 0, 60)), 80, levels=(10,), chunk=40)
    assert d.status in ("insufficient_evidence", "no_change")
    raw = detect.raw_detect(scene(spark, cloud=(0, 80, 0, 60)), 80, chunk=32)
    assert [r.area_px for r in raw.collect()] == [900]


def test_nothing_changes(spark):
    assert detect.detect(scene(spark, factor=1.0), 80, chunk=32).status == "no_change"
    assert detect.detect(scene(spark).where("false"), 80, chunk=32).status == "insufficient_evidence"


def test_chunks_do_not_matter(spark):
    a, b = (detect.detect(scene(spark), 80, levels=(10,), chunk=k).detections.collect() for k in (40, 128))
    assert len(a) == len(b) == 1
    assert all(x == (pytest.approx(y) if isinstance(y, float) else y) for x, y in zip(a[0], b[0], strict=True))


@pytest.mark.parametrize(("dx", "dy"), [(2.6, -1.4), (0.0, 0.0), (7.0, 4.5)])
def test_registration_recovers_a_shift(spark, dx, dy):
    rng = np.random.default_rng(1)
    size = 96
    waves = [(rng.normal(0, 0.16, 2), rng.uniform(0, 6)) for _ in range(25)]
    image = lambda y, x: sum(np.sin(k[0] * y + k[1] * x + p) for k, p in waves)
    y, x = np.mgrid[0:size, 0:size].astype(float)
    a, b = image(y, x), image(y - dy, x - dx)
    rows = [(1, int(i), int(j), float(a[i, j]), float(b[i, j]), True) for i in range(size) for j in range(size)]
    flat = [(2, i, j, 1.0, 1.0, True) for i in range(20) for j in range(20)]
    got = {r.pair_id: r for r in alignment.register(spark.createDataFrame(rows + flat, "pair_id long, r long, c long, a double, b double, valid boolean")).collect()}
    assert got[2].status == "alignment_failed"
    assert got[1].status == ("aligned" if dx else "identity")
    assert (got[1].dx, got[1].dy, got[1].angle) == (pytest.approx(dx, abs=0.15), pytest.approx(dy, abs=0.15), pytest.approx(0, abs=0.003))


def test_outlines(spark):
    px = [(1, 0, 0), (1, 0, 1), (1, 1, 1), (2, 5, 5)] + [(3, r, c) for r in range(10, 13) for c in range(3) if (r, c) != (11, 1)]
    got = {r.label: [tuple(p) for p in r.ring] for r in alignment.outlines(spark.createDataFrame(px, "label long, r long, c long")).collect()}
    assert got[2] == [(5, 6), (6, 6), (6, 5), (5, 5), (5, 6)] or len(got[2]) == 5
    area = lambda p: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:], strict=False))) / 2
    assert {k: area(v) for k, v in got.items()} == {1: 3.0, 2: 1.0, 3: 9.0}
    line = [(float(i), 0.01 * (i % 2)) for i in range(50)]
    assert alignment.simplified(line, 0.1) == [line[0], line[-1]]


def _mask_rings(labels, width=60, chunk=512, spark=None, **more):
    rows = [(int(r), int(c), int(v)) for (r, c), v in np.ndenumerate(labels) if v]
    df = spark.createDataFrame(rows, "r long, c long, label long")
    return outlines.rings(df, width, chunk, **more).collect()


@pytest.mark.parametrize("chunk", [3, 8, 512])
def test_rings_fill_to_the_pixels(spark, chunk):
    """Random components, whose corners touch in many places, over chunks: each has one outer ring, no ring touches itself,
    and outer less holes, filled by crossings, are exactly its pixels."""
    rng = np.random.default_rng(7)
    mask = np.zeros((26, 31), dtype=bool)
    mask[1:-1, 1:-1] = rng.random((24, 29)) < 0.62
    labels, n = np.zeros(mask.shape, dtype=int), 0
    for r, c in zip(*np.nonzero(mask), strict=True):
        if not labels[r, c]:
            n += 1
            todo = [(r, c)]
            while todo:
                y, x = todo.pop()
                if mask[y, x] and not labels[y, x]:
                    labels[y, x] = n
                    todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    found = _mask_rings(labels, chunk=chunk, spark=spark)
    assert sorted(x.label for x in found if not x.hole) == list(range(1, n + 1))
    assert sum(x.hole for x in found) > 3
    for k in range(1, n + 1):
        inside = np.zeros(mask.shape, dtype=int)
        for x in (x for x in found if x.label == k):
            p = x.ring
            assert p[0] == p[-1] and len({tuple(q) for q in p}) == len(p) - 1
            area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:], strict=False)) / 2
            assert (area > 0) == x.hole
            for r, c in np.ndindex(*mask.shape):  # crossings of the ring to the left of a pixel's centre
                inside[r, c] += sum(1 for a, b in zip(p, p[1:], strict=False) if a[0] == b[0] and a[0] < c + 0.5 and min(a[1], b[1]) < r + 0.5 < max(a[1], b[1])) % 2 * (-1 if x.hole else 1)
        assert (inside == (labels == k)).all()
    if chunk == 3:
        key = lambda x: (x.label, x.hole, x.ring)
        assert sorted(map(key, found)) == sorted(map(key, _mask_rings(labels, chunk=512, spark=spark)))


def test_rings_of_a_long_snake_and_simplified(spark):
    labels = np.zeros((40, 40), dtype=int)
    for i in range(0, 40, 2):
        labels[i] = 1
        labels[i + 1 if i + 1 < 40 else i, 0 if i % 4 else 39] = 1
    (ring,) = _mask_rings(labels, chunk=4, spark=spark, most=None)
    (same,) = _mask_rings(labels, chunk=64, spark=spark, most=None)
    assert ring.ring == same.ring and len(ring.ring) > 70
    (short,) = _mask_rings(labels, chunk=4, spark=spark, most=20)
    assert len(short.ring) <= 20 and short.ring[0] == short.ring[-1]
    assert _mask_rings(np.array([[1]]) * 0 + [[1]], spark=spark)[0].ring == [[0.0, 0.0], [0.0, 1.0], [1.0, 1.0], [1.0, 0.0], [0.0, 0.0]]


def test_detections_on_the_ground(spark):
    """A patch with a hole in it: outline, box, centre and grid reference against the projection itself."""
    grid = Grid("EPSG:32643", 80, 80, (10.0, 0.0, 600000.0, 0.0, -10.0, 3000000.0))
    px = scene(spark)
    hole = F.col("r").between(30, 39) & F.col("c").between(40, 49)
    px = px.withColumn("b08_b", F.when(hole, F.col("b08_a")).otherwise(F.col("b08_b")))
    (one,) = detect.detect(px, 80, levels=(10,), chunk=32, grid=grid).detections.collect()
    shape = json.loads(one.geometry)
    assert shape["type"] == "Polygon" and [len(r) for r in shape["coordinates"]] == [5, 5]
    at = lambda c, r: tuple(float(v[0]) for v in resampling.utm_backward(np.array([600000.0 + 10 * c]), np.array([3000000.0 - 10 * r]), 43, False))
    for ring, ends in zip(shape["coordinates"], [[(30, 20), (60, 50)], [(40, 30), (50, 40)]], strict=True):
        want = {tuple(round(v, 6) for v in at(x, y)) for x in (ends[0][0], ends[1][0]) for y in (ends[0][1], ends[1][1])}
        assert {tuple(p) for p in ring} == want
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))
        assert (area > 0) == (ring is shape["coordinates"][0])  # against the clock outside, with it inside
    assert (one.native_min_x, one.native_min_y, one.native_max_x, one.native_max_y) == (600300.0, 2999500.0, 600600.0, 2999800.0)
    corners = [at(x, y) for x in (30, 60) for y in (20, 50)]
    assert one.min_lon == pytest.approx(min(c[0] for c in corners)) and one.max_lat == pytest.approx(max(c[1] for c in corners), abs=1e-7)
    assert (one.centroid_lon, one.centroid_lat) == pytest.approx(at(45, 35), abs=1e-6)
    assert one.mgrs_ref == spark.range(1).select(S.mgrs(F.lit(one.centroid_lat), F.lit(one.centroid_lon))).first()[0]
    assert one.area_px == 800


def test_two_patches_of_one_detection_are_a_multipolygon(spark):
    labels = spark.createDataFrame([(r, c, 1 if c < 5 else 2) for r in range(4) for c in (*range(3), *range(7, 9))], "r long, c long, label long")
    groups = spark.createDataFrame([(1, 1), (2, 1)], "label long, group long")
    grid = Grid("EPSG:4326", 10, 10, (0.1, 0.0, 10.0, 0.0, -0.1, 50.0))
    (one,) = outlines.geometries(outlines.rings(labels, 60), groups, grid).collect()
    shape = json.loads(one.geometry)
    assert shape["type"] == "MultiPolygon" and [len(p) for p in shape["coordinates"]] == [1, 1]
    assert {tuple(p) for p in shape["coordinates"][1][0]} == {(10.7, 50.0), (10.9, 50.0), (10.7, 49.6), (10.9, 49.6)}


def test_zones_of_grid_references(spark):
    places = {(60.39, 5.32): "32V", (60.0, 2.9): "31V", (63.99, 11.9): "32V", (64.0, 5.0): "31W", (78.2, 15.6): "33X", (78.0, 8.9): "31X", (78.0, 9.0): "33X", (80.0, 21.0): "35X", (83.9, 33.0): "37X", (78.0, 41.9): "37X", (78.0, 42.0): "38X", (28.6, 77.2): "43R"}
    rows = spark.createDataFrame([(a, o) for a, o in places], "lat double, lon double")
    got = {(r.lat, r.lon): r.ref for r in rows.select("lat", "lon", S.mgrs(F.col("lat"), F.col("lon")).alias("ref")).collect()}
    assert {k: v[:3] for k, v in got.items()} == places
    assert spark.range(1).select(S.mgrs(F.lit(59.9139), F.lit(10.7522))).first()[0][:7] == "32VNM97"  # Oslo

"""NDVI of outlines in earlier scenes against a dense computation, over grids of other sizes and systems."""

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from geochange.operators import history, resampling
from geochange.operators.resampling import Grid

TOP = 3000000.0
GRIDS = {
    0: Grid("EPSG:32643", 90, 80, (10.0, 0.0, 600000.0, 0.0, -10.0, TOP)),
    1: Grid("EPSG:32643", 90, 80, (10.0, 0.0, 600000.0, 0.0, -10.0, TOP)),
    2: Grid("EPSG:32643", 45, 40, (20.0, 0.0, 600000.0, 0.0, -20.0, TOP)),
    3: Grid("EPSG:32643", 100, 100, (10.0, 0.0, 599950.0, 0.0, -10.0, TOP + 60)),
    4: Grid("EPSG:32643", 90, 80, (10.0, 0.0, 600000.0, 0.0, -10.0, TOP)),
    5: Grid("EPSG:32643", 90, 80, (10.0, 0.0, 600000.0, 0.0, -10.0, TOP)),
}
DATES = {0: "2024-03-10", 1: "2023-03-01", 2: "2022-03-20", 3: "2021-02-20", 4: "2020-03-12", 5: "2023-07-10"}


def _lonlat(x, y):
    lon, lat = resampling.utm_backward(np.array(float(x)), np.array(float(y)), 43, False)
    return float(lon), float(lat)


def _polygon(rings):
    return [[list(_lonlat(600000 + 10 * c, TOP - 10 * r)) for c, r in ring] for ring in rings]


SHAPES = {
    1: _polygon([[(10.2, 12.1), (30.4, 11.3), (33.1, 40.2), (12.3, 38.4), (10.2, 12.1)], [(16.2, 20.1), (17.4, 28.3), (24.1, 27.6), (23.3, 19.8), (16.2, 20.1)]]),
    2: _polygon([[(50.1, 5.2), (80.3, 5.2), (65.2, 35.4), (50.1, 5.2)]]),
    3: _polygon([[(60.2, 60.2), (60.4, 60.2), (60.4, 60.4), (60.2, 60.2)]]),  # no centre of a pixel lies in it
    4: _polygon([[(70.1, 50.2), (88.3, 50.2), (88.3, 75.4), (70.1, 75.4), (70.1, 50.2)]]),
}


def _world():
    rng = np.random.default_rng(8)
    out = {}
    for s, g in GRIDS.items():
        b04, b08 = rng.integers(200, 1500, (g.height, g.width)), rng.integers(1500, 4000, (g.height, g.width))
        b08[rng.random(b08.shape) < 0.05] = 0
        scl = rng.choice([4, 5, 4, 5, 8], b08.shape)
        if s == 0:
            b08 = np.where(np.arange(g.width) < 40, b08 // 3 + (b08 > 0), b08)  # a loss in the west
        if s in (1, 2):
            scl[:, int(g.width * 0.77) :] = 9  # clouds over the last shape in two scenes
        out[s] = b04, b08, scl
    return out


def _dense(shape, box, grid, b04, b08, scl):
    """Pixel by pixel: the window, which centres are inside by crossings, the share that is valid, the mean."""
    to = lambda lon, lat: history._to_grid(grid, np.array(lon), np.array(lat))
    edge = np.linspace(0, 1, 23)
    lons = [box[0] + (box[2] - box[0]) * t for t in edge] * 2 + [box[0]] * 23 + [box[2]] * 23
    lats = [box[1]] * 23 + [box[3]] * 23 + [box[1] + (box[3] - box[1]) * t for t in edge] * 2
    x, y = to(lons, lats)
    c0, r0, c1, r1 = max(0, int(np.floor(x.min()))), max(0, int(np.floor(y.min()))), min(grid.width, int(np.ceil(x.max()))), min(grid.height, int(np.ceil(y.max())))
    if c1 <= c0 or r1 <= r0:
        return None
    rings = [np.stack(to([p[0] for p in ring], [p[1] for p in ring]), axis=1) for ring in shape]
    inside = []
    for r in range(r0, r1):
        for c in range(c0, c1):
            n = 0
            for ring in rings:
                for (xa, ya), (xb, yb) in zip(ring, ring[1:], strict=False):
                    if (ya <= r + 0.5) != (yb <= r + 0.5) and xa + (r + 0.5 - ya) / (yb - ya) * (xb - xa) < c + 0.5:
                        n += 1
            if n % 2:
                inside.append((r, c))
    inside = inside or [(r, c) for r in range(r0, r1) for c in range(c0, c1)]
    ok = [(r, c) for r, c in inside if b04[r, c] and b08[r, c] and scl[r, c] in (4, 5, 6, 7, 11)]
    if len(ok) / len(inside) < 0.5 or not ok:
        return None
    return float(np.mean([(b08[r, c] - b04[r, c]) / (b08[r, c] + b04[r, c]) for r, c in ok]))


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    world, path = _world(), str(tmp_path_factory.mktemp("archive") / "a")
    rows = [(s, i, j, int(b04[i, j]), int(b08[i, j]), int(scl[i, j])) for s, (b04, b08, scl) in world.items() for i, j in np.ndindex(b04.shape)]
    history.write_archive(spark.createDataFrame(rows, "scene_id long, r long, c long, b04 int, b08 int, scl int"), path, chunk=16)
    feet = []
    for s, g in GRIDS.items():
        x0, y1 = g.transform[2], g.transform[5]
        a, b = _lonlat(x0, y1 + g.transform[4] * g.height), _lonlat(x0 + g.transform[0] * g.width, y1)
        feet.append((s, "s", datetime.date.fromisoformat(DATES[s]), a[0], a[1], b[0], b[1], g.crs, g.width, g.height, list(g.transform)))
    scenes = spark.createDataFrame(feet, "scene_id long, sensor string, acquired date, min_x double, min_y double, max_x double, max_y double, crs string, width int, height int, transform array<double>")
    boxes = {k: (min(p[0] for p in v[0]), min(p[1] for p in v[0]), max(p[0] for p in v[0]), max(p[1] for p in v[0])) for k, v in SHAPES.items()}
    rows = [(k, 0, "s", datetime.date(2024, 3, 10), json.dumps({"type": "Polygon", "coordinates": v} if k != 2 else {"type": "MultiPolygon", "coordinates": [v]}), *boxes[k], None, None) for k, v in SHAPES.items()]
    rows += [(5, 0, "s", datetime.date(2024, 3, 10), None, *boxes[1], *_lonlat(600200, TOP - 250)), (6, 0, "other", datetime.date(2024, 3, 10), None, *boxes[1], None, None), (7, 0, "s", datetime.date(2024, 3, 10), None, 10.0, 10.0, 11.0, 11.0, None, None)]
    candidates = spark.createDataFrame(rows, "candidate_id long, after_scene long, sensor string, acquired date, geometry string, min_lon double, min_lat double, max_lon double, max_lat double, centroid_lon double, centroid_lat double")
    return world, path, scenes, candidates, boxes


def test_verdicts_are_those_of_a_dense_computation(spark, made):
    world, path, scenes, candidates, boxes = made
    got = {r.candidate_id: r for r in history.verdicts(spark, candidates, scenes, path, chunk=16).collect()}
    assert got.keys() == set(range(1, 8))
    statuses = set()
    for k in (1, 2, 3, 4, 5):
        shape = SHAPES[k] if k < 5 else [[[x, y] for x, y in ((boxes[1][0] - 1, boxes[1][1] - 1), (boxes[1][2] + 1, boxes[1][1] - 1), (boxes[1][2] + 1, boxes[1][3] + 1), (boxes[1][0] - 1, boxes[1][3] + 1), (boxes[1][0] - 1, boxes[1][1] - 1))]]
        own = boxes[k] if k < 5 else boxes[1]
        ndvi = {s: _dense(shape, own, GRIDS[s], *world[s]) for s in GRIDS}
        prior = [ndvi[s] for s in (1, 2, 3, 4) if ndvi[s] is not None]
        assert (got[k].priors, got[k].n_clear) == (4, len(prior)), k
        if len(prior) < 3 or ndvi[0] is None:
            assert (got[k].status, got[k].factor, got[k].current) == ("unverified", 0.85, None)
        else:
            std = max(np.std(prior, ddof=1), 0.05)
            drop = np.mean(prior) - ndvi[0]
            assert (got[k].prior_mean, got[k].prior_std, got[k].current, got[k].drop_in_std) == pytest.approx((np.mean(prior), std, ndvi[0], drop / std))
            assert got[k].status == ("seasonal" if drop <= 2 * std else "anomalous")
        statuses.add(got[k].status)
    assert statuses == {"seasonal", "anomalous", "unverified"}
    assert [(got[k].priors, got[k].status) for k in (6, 7)] == [(0, "unverified")] * 2


def test_only_covered_chunks_are_opened(spark, made):
    _, path, scenes, candidates, _ = made
    one = candidates.where("candidate_id = 2").withColumn("scene_id", F.lit(4).cast("long")).join(scenes.select("scene_id", "crs", "width", "height", "transform"), "scene_id")
    found = history.sampled(spark, path, one, chunk=16)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and found.count() == 1
    named = history.spans(one).select(F.floor(F.col("r") / 16).alias("cr"), F.explode(F.sequence(F.floor(F.col("first") / 16), F.floor(F.col("last") / 16))).alias("cc")).distinct().count()
    files = len(spark.read.parquet(path).inputFiles())
    assert named < files / 10
    scan = [n for n in _metrics(found) if "numFiles" in n]
    assert scan and max(n["numFiles"] for n in scan) <= named + 1


def _metrics(df):
    """Metrics of the scans that have run, by name."""
    df.collect()
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            held, it = {}, node.metrics().iterator()
            while it.hasNext():
                pair = it.next()
                held[pair._1()] = pair._2().value()
            out.append(held)
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return out


def test_scanlines_and_large_windows():
    square = [np.array([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0.0)])]
    hole = [np.array([(3, 3), (3, 6), (6, 6), (6, 3), (3, 3.0)])]
    got = {(r, c) for r, a, b in history.scanlines(square + hole, 20, 20) for c in range(a, b + 1)}
    assert got == {(r, c) for r in range(10) for c in range(10) if not (3 <= r < 6 and 3 <= c < 6)}
    assert history.scanlines([s - 4 for s in square], 3, 4) == [(r, 0, 3) for r in range(3)]
    grid = Grid("EPSG:4326", 1000, 700, (0.01, 0.0, 70.0, 0.0, -0.01, 20.0))
    spans, c0, ratio = history.filled(None, (71.0, 14.0, 77.0, 19.0), grid, 256)
    assert len(spans) == -(-500 // 3) and c0 == 100 and ratio == 600 / 200  # every third row and column of 500 x 600
    assert spans[0] == (100 + int(0.5 * 500 / 167), 101, 100 + int(199.5 * 3))
    assert history.filled(None, (60.0, 14.0, 61.0, 19.0), grid, 256)[0] == []

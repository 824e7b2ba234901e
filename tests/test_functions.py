"""Unit cases of the scalar library, with values worked out by hand."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from geochange.functions import scalar as S
from geochange.operators import catalog, raster, spatial, vector


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


@pytest.mark.parametrize(
    ("name", "sensor", "date"),
    [
        ("S2A_MSIL2A_20240115T052141_N0510_R062_T43RCL_x.SAFE", "sentinel2", "2024-01-15"),
        ("LC09_L2SP_146040_20240210_20240301_02_T1_SR_B4.TIF", "landsat9", "2024-02-10"),
        ("LC08_L2SP_147039_20231110_20231201_02_T2.TIF", "landsat8", "2023-11-10"),
        ("R2_LISS3_2023-05-12_band.tif", "liss3", "2023-05-12"),
        ("x_20240230_y.tif", "unknown", None),
        ("", "unknown", None),
        ("CARTOSAT2_scene.tif", "bhuvan", None),
        ("le07_x-2019-03-02.tif", "landsat8", "2019-03-02"),
        ("LT05_1998-03-02", "landsat8", None),
        ("Landsat 5", "landsat8", None),
        ("T_MSIL2A_x_20191301T101010", "sentinel2", None),
        ("LISS-4_20200131", "bhuvan", "2020-01-31"),
        ("liss_iii.tif", "liss3", None),
        ("2023_05_12", "unknown", None),
        (None, "unknown", None),
    ],
)
def test_names(spark, name, sensor, date):
    n = F.lit(name).cast("string")
    assert one(spark, S.detect_sensor(n), S.acquisition_date(n)) == (sensor, date and datetime.date.fromisoformat(date))


def test_tile_code_and_ids(spark):
    assert one(spark, S.tile_code(F.lit("S2A_20240101T052141_T43RCL_x")), S.tile_code(F.lit("a_20240101T052141_b"))) == ("43RCL", None)
    assert one(spark, S.safe_id(F.lit("été 1/b")), S.tile_id(F.lit("s"), F.lit(3), F.lit(12))) == ("été_1_b", "s_crop_00003_00012")
    assert one(spark, S.spaced_mgrs(F.lit("43RCL0139196701")), S.spaced_mgrs(F.lit("43RCL"))) == ("43RCL 01391 96701", "43RCL")


def test_rounding_is_that_of_the_language(spark):
    rng = np.random.default_rng(1)
    xs = [*rng.uniform(-2000, 2000, 2000).tolist(), *(rng.integers(-400000, 400000, 2000) / 200).tolist(), *(rng.integers(-400000, 400000, 2000) * 0.00005).tolist()]
    df = spark.createDataFrame([(x,) for x in [0.285, 2.675, 0.125, 0.375, -0.5, 0.43675, None, *xs]], "x double")
    for digits in (1, 2, 4):
        for r in df.select("x", S.py_round(F.col("x"), digits).alias("y")).collect():
            assert r.y == (None if r.x is None else round(r.x, digits)), r.x


def test_names_of_products_and_paths(spark):
    p = S.landsat_name(F.lit("lc09_l2sp_146040_20240210_20240301_02_t1_SR_B4"))
    assert one(spark, p["path"], p["row"], p["acquired"]) == ("146", "040", "20240210")
    assert one(spark, S.landsat_name(F.lit("LC09_L2SR_146040_20240210_20240301_02_T1")), S.landsat_name(F.lit("LE07_L2SP_146040_20240210_20240301_02_T1"))) == (None, None)
    assert one(spark, S.redacted(F.lit("cannot open '/data/a b/c.tif' or C:\\x\\y.tif, (see /tmp/z)"))) == ("cannot open '<path> b<path>' or <path>, (see <path>)",)
    assert one(spark, F.length(S.redacted(F.lit("e" * 400)))) == (300,)
    assert one(spark, S.tile_code(F.lit("S2_T43RZZ.SAFE")), S.tile_code(F.lit("xT43RCLx"))) == ("43RZZ", None)


def test_trust_and_states(spark):
    assert one(spark, S.cloud_trust(F.lit("heuristic"), F.lit(0.2), F.lit(30.0)), S.cloud_trust(F.lit("scl"), F.lit(0.2), F.lit(30.0)), S.cloud_trust(F.lit("data_mask"), F.lit(0.2), F.lit(None).cast("double"))) == (0.7, 0.8, 1.0)
    assert one(spark, S.job_trust(F.lit("heuristic"), F.lit(0.7), F.lit("scl"), F.lit(0.2)), S.job_trust(F.lit("scl"), F.lit(0.7), F.lit("scl"), F.lit(0.2))) == (0.7, 1.0)
    assert one(spark, S.ablation_status(F.lit("running"), F.lit(False)), S.ablation_status(F.lit("running"), F.lit(True)), S.ablation_status(F.lit(None).cast("string"), F.lit(False))) == ("not_run", "running", "not_run")
    assert one(spark, S.shown_hectares(F.lit(None).cast("double"), F.lit(123456))) == ("1,234.6 ha",)
    assert one(spark, S.job_coverage(F.lit('{"mutual_coverage":0.5}')), S.job_coverage(F.lit('{"mutual_coverage":0.5,"mutual_coverage_after_alignment":0.25}')), S.job_coverage(F.lit("{}"))) == (0.5, 0.25, None)


def test_features_are_geojson(spark):
    import json

    c = spark.createDataFrame([(1, 7, 3, 4, 0.12345, 120, None, 1.0, 2.0, 3.0, 4.0, None, None, None, None)], "candidate_id long, job_id long, scene_a long, scene_b long, confidence double, area_px long, area_ha double, min_x double, min_y double, max_x double, max_y double, mean_dndvi double, raw_type string, raw_direction string, raw_sub_blobs long").withColumn("seasonality", F.lit(None).cast("string"))
    reviews = spark.createDataFrame([(1, "confirmed", 1, "2024-01-01"), (1, "rejected", 2, "2024-01-02")], "candidate_id long, decision string, seq long, reviewed_at string")
    places = spark.createDataFrame([(3, "A", "sentinel2", "2024-01-01"), (4, "B", "sentinel2", "2024-02-01")], "scene_id long, name string, sensor string, acquired string")
    jobs = spark.createDataFrame([(3, 4, '{"alignment":{"method":"same_tile","quality":0.9},"radiometry":{"tier":"pif","pif_pixels":12},"masking":{"scene_a":{"source":"scl"},"scene_b":{"source":"scl"}}}')], "scene_a long, scene_b long, details string")
    f = json.loads(catalog.exported(c, reviews, places, jobs).first().feature)
    p = f["properties"]
    assert f["type"] == "Feature" and f["id"] == 1 and f["geometry"]["coordinates"][0][2] == [3.0, 4.0] and len(p) == 26
    assert (p["confidence"], p["area_ha"], p["analyst_decision"], p["review_count"], p["delta_ndvi"], p["geometry_source"], p["sensor"]) == (round(0.12345, 4), 1.2, "rejected", 2, None, "bounding_box", "sentinel2")
    assert p["processing"]["alignment"] == "same_mgrs_grid" and p["processing"]["normalisation"] == "pif_robust_regression" and p["processing"]["pif_pixels"] == 12 and p["processing"]["masking"] == "SCL"
    outline = json.loads(catalog.exported(c.withColumn("geometry", F.lit('{"type":"Polygon","coordinates":[]}')), reviews, places, jobs, decisions=["rejected"]).first().feature)
    assert outline["properties"]["geometry_source"] == "changed_pixel_outline" and outline["geometry"]["coordinates"] == []
    assert catalog.exported(c, reviews, places, jobs, decisions=["pending"]).count() == 0


def test_close_similarities_are_told_apart(spark):
    tiles = spark.createDataFrame([(1, 0, [0.90001]), (2, 0, [0.90004]), (3, 0, [0.1])], "tile_id long, scene_id long, embedding array<double>")
    query = spark.createDataFrame([(9, [1.0])], "query_id long, query array<double>")
    for scored in (vector.similarities(tiles, query), vector.similarities_in_blocks(tiles, query)):
        assert [(r.tile_id, r.similarity) for r in vector.shown(vector.top_k(scored, 1)).collect()] == [(2, 0.9)]
        assert {r.tile_id: r.percentile for r in vector.percentile_in_scene(scored).collect()} == {3: 1 / 3, 1: 2 / 3, 2: 1.0}


@pytest.mark.parametrize(
    ("prior", "now", "same"),
    [("2022-01-10", "2024-01-20", True), ("2024-01-10", "2024-01-20", False), ("2022-12-20", "2024-01-10", True), ("2022-02-28", "2024-02-29", True), ("2022-04-01", "2024-06-01", False)],
)
def test_seasons(spark, prior, now, same):
    assert one(spark, S.same_season(F.to_date(F.lit(prior)), F.to_date(F.lit(now)))) == (same,)


def test_boxes(spark):
    box = lambda *v: dict(zip(S.BOX, map(F.lit, v), strict=True))
    a, touching, far = box(0.0, 0.0, 2.0, 2.0), box(2.0, 0.0, 3.0, 2.0), box(5.0, 5.0, 6.0, 6.0)
    assert one(spark, S.intersects(a, touching), S.intersects(a, far), S.overlap_fraction(a, box(1.0, 1.0, 3.0, 2.0))) == (True, False, 0.5)
    assert one(spark, S.overlap_fraction(a, box(1.0, 1.0, 1.0, 1.0))) == (0.0,)
    w = S.display_window(box(0.0, 0.0, 1.0, 1.0), box(0.0, 0.0, 10.0, 3.0))
    assert one(spark, *[w[k] for k in S.BOX]) == (0.0, 0.0, 4.0, 3.0)


def test_flags_and_numbers(spark):
    qa = [1, 8, 16, 32, 21824, 0]
    assert one(spark, *[S.qa_to_scl(F.lit(x)) for x in qa]) == (0, 9, 3, 11, 7, 7)
    assert one(spark, S.landsat_dn(F.lit(0)), S.landsat_dn(F.lit(1)), S.landsat_dn(F.lit(10000))) == (0, 1, 1750)
    assert one(spark, S.ratio(F.lit(0.4), F.lit(0.1)), S.ratio(F.lit(0.0), F.lit(0.0))) == (pytest.approx(0.6), None)


@pytest.mark.parametrize(
    ("a", "b", "areas", "water", "dndvi", "gain", "want"),
    [
        ("vegetation", "bare", (9, 9), (0, 0), -0.2, 0.0, ("disappearance", "clearance")),
        ("water", "bare", (9, 9), (9, 1), None, 0.0, ("disappearance", "water_loss")),
        ("vegetation", "bare", (9, 9), (0, 0), None, 0.0, ("disappearance", "unclassified")),
        ("bare", "vegetation", (9, 9), (0, 0), 0.05, 0.0, ("appearance", "revegetation")),
        ("bare", "bare", (9, 9), (0, 0), -0.05, 0.15, ("appearance", "construction")),
        ("bare", "bare", (10, 13), (0, 0), 0.0, 0.0, ("expansion", "urban_expansion")),
        ("vegetation", "vegetation", (10, 7), (0, 0), 0.0, 0.0, ("contraction", "vegetation_retreat")),
        ("other", "water", (9, 9), (0, 9), 0.3, 0.3, ("unclassified", "unclassified")),
    ],
)
def test_direction_rules(spark, a, b, areas, water, dndvi, gain, want):
    got = S.decide(F.lit(a), F.lit(b), *map(F.lit, (*areas, *water)), F.lit(dndvi).cast("double"), F.lit(gain))
    assert one(spark, *got) == want


def test_hints(spark):
    q = lambda x: one(spark, S.hinted_directions(F.lit(x)))[0]
    assert q("New buildings and URBAN sprawl") == ["appearance", "expansion"]
    assert q("newest, unremoved") == []
    assert q("cleared/receding") == ["disappearance", "contraction"]


def test_seasonal_verdict(spark):
    v = lambda n, m, s, c: one(spark, *S.seasonal_verdict(F.lit(n), F.lit(m), F.lit(s), F.lit(c).cast("double")))
    assert v(2, 0.6, 0.1, 0.1) == ("unverified", 0.85)
    assert v(3, 0.6, 0.1, None) == ("unverified", 0.85)
    assert v(3, 0.6, 0.01, 0.52) == ("seasonal", 0.5)
    assert v(3, 0.6, 0.1, 0.3) == ("anomalous", 1.0)


def test_confidence(spark):
    assert one(spark, S.confidence(F.lit(0.9), F.lit(1.0), F.lit(1.0), F.lit(1.0)), S.confidence(F.lit(2.0), F.lit(2.0), F.lit(2.0), F.lit(1.0))) == (pytest.approx(0.965), 1.0)


def test_grid_reference(spark):
    # The central meridian of a zone at the equator, and a point whose easting and northing are known to the metre.
    u = S.utm(F.lit(75.0), F.lit(0.0))
    assert one(spark, u["zone"], u["easting"], u["northing"]) == (43, pytest.approx(500000), pytest.approx(0, abs=1e-6))
    u = S.utm(F.lit(-79.387139), F.lit(43.642567))
    assert one(spark, u["zone"]) == (17,)
    assert one(spark, u["easting"], u["northing"]) == (pytest.approx(630084, abs=1), pytest.approx(4833439, abs=1))
    assert one(spark, S.mgrs(F.lit(43.642567), F.lit(-79.387139)))[0].startswith("17TPJ300")
    assert one(spark, S.mgrs(F.lit(85.0), F.lit(0.0))) == (None,)


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(1.0), F.lit(0.5))
    assert one(spark, vector.dot(a, b)) == (5.0,)
    assert one(spark, vector.normalised(a))[0] == pytest.approx([0.6, 0.8])
    assert one(spark, vector.finite(F.array(F.lit(1.0), F.lit(float("nan")))), vector.finite(a)) == (False, True)


def test_merge_of_two(spark):
    rows = [(1, "g", 0.60, 300, 3.0, 0.1, 0.0, 0.0, 10.0, 10.0, "clearance", "disappearance"), (2, "g", 0.85, 500, None, None, 20.0, 0.0, 40.0, 30.0, "unclassified", "unclassified")]
    df = spark.createDataFrame(rows, "candidate_id long, g string, confidence double, area_px long, area_ha double, mean_dndvi double, min_x double, min_y double, max_x double, max_y double, change_type string, direction string")
    r = catalog.merged(df, "g").first()
    assert (r.lead_id, r.confidence, r.area_px, r.area_ha, r.mean_dndvi, r.max_x, r.max_y, r.change_type, r.direction) == (2, 0.85, 800, None, pytest.approx(0.1), 40.0, 30.0, "clearance", "disappearance")


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "r long, c long")
    assert raster.labelled(none, 10).count() == 0
    assert raster.opened_closed(none, 5, 5).count() == 0
    boxes = spark.createDataFrame([], "id long, min_x double, min_y double, max_x double, max_y double")
    assert spatial.box_join(boxes, boxes, 1.0).count() == 0
    empty = spark.createDataFrame([], "v double")
    assert tuple(raster.two_means(empty, "v").first()) == (None, None, None)


def _dense(mask):
    """Labels of 4-connected components by flood fill; a label is the least pixel number."""
    h, w = mask.shape
    out = -np.ones(mask.shape, dtype=int)
    for r in range(h):
        for c in range(w):
            if mask[r, c] and out[r, c] < 0:
                todo = [(r, c)]
                out[r, c] = r * w + c
                while todo:
                    y, x = todo.pop()
                    for a, b in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                        if 0 <= a < h and 0 <= b < w and mask[a, b] and out[a, b] < 0:
                            out[a, b] = r * w + c
                            todo.append((a, b))
    return out


@pytest.mark.parametrize("chunk", [4, 7, 64])
def test_components_do_not_depend_on_chunks(spark, chunk):
    mask = np.random.default_rng(3).random((23, 31)) < 0.6
    want = _dense(mask)
    r, c = np.nonzero(mask)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(r, c, strict=True)], "r long, c long")
    got = {(x.r, x.c): x.label for x in raster.labelled(df, 31, chunk).collect()}
    assert got == {(int(a), int(b)): int(want[a, b]) for a, b in zip(r, c, strict=True)}


@pytest.mark.parametrize("radius", [1, 5])
def test_ellipse_dilation(spark, radius):
    mask = np.zeros((30, 40), dtype=bool)
    mask[[3, 15, 29], [0, 20, 39]] = True
    want = np.zeros_like(mask)
    for y, x in zip(*np.nonzero(mask), strict=True):
        for dy, dx in raster.ellipse(radius):
            if 0 <= y + dy < 30:
                want[y + dy, max(0, x - dx) : x + dx + 1] = True
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(*np.nonzero(mask), strict=True)], "r long, c long")
    got = {(x.r, x.c) for x in raster.dilated_ellipse(df, radius, 30, 40, chunk=16).collect()}
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(want), strict=True)}


def test_groups_of_blobs(spark):
    blobs = [(r, c) for r in range(4) for c in range(4)] + [(r, c) for r in range(4) for c in range(12, 16)] + [(60, 80)]
    df = spark.createDataFrame(blobs, "r long, c long")
    found = {x.label: (x.group, x.dilation_px) for x in raster.groups(raster.labelled(df, 100, 32), 100, 100, levels=(10, 5), chunk=64).collect()}
    assert found == {0: (0, 10), 12: (0, 10), 6080: (6080, 0)}


def test_details_are_read_once_a_job(spark):
    from geochange import queries as engine

    details = '{"masking":{"scene_a":{"source":"scl","cloud_trust":"0.9"},"scene_b":{"source":"scl","cloud_trust":0.85}},"alignment":{"method":"same_tile","tiles":[null,"43RCL"]},"radiometry":{"tier":"pif","slope":[2],"intercept":[1]},"detection":{"kmeans_centroids":[1,2.25]},"grouping":{"dilation_px":"7"}}'
    texts = [details, details[:-9], None, '{"radiometry":{},"masking":"none","grouping":{"dilation_px":3}}', '{"radiometry":{"x":1}}']
    jobs = spark.createDataFrame([(i, i + 1, t) for i, t in enumerate(texts)], "scene_a int, scene_b int, details string")
    found = spark.createDataFrame([(i, None if i == 8 else i, i + 1, 3) for i in (0, 1, 2, 3, 4, 8, 9)], "candidate_id int, scene_a int, scene_b int, sub_blobs int")
    names = "merged_dilation large_area direction dominant_a dominant_b rule mean_dndvi seasonality priors_clear current_ndvi prior_mean prior_std".split()
    c = {k: F.lit(None) for k in names} | {"sub_blobs": F.col("sub_blobs")}
    rows = catalog.traced(found, jobs, c).collect()
    got = {r.candidate_id: {x.key: x.text for x in r.trace if x.key != "direction"} for r in rows}
    assert len(rows) == 7
    far = lambda px: f"Merged from 3 change blobs less than {px} px apart; area, outline and ΔNDVI are those of the blobs themselves"
    assert got[0] == {
        "masking": "SCL-based, CloudTrust A: 0.90, CloudTrust B: 0.85", "alignment": "Same MGRS tile (T43RCL) — grid verified by definition",
        "normalisation": "PIF robust regression, 0 anchor pixels, gain: 2.00, offset: 1.0", "detection": "Mean-intensity difference → K-Means K=2, change centroid magnitude: 2.2",
        "grouping": far(14),
    }
    assert got[1] == got[2] == got[8] == got[9] == {"grouping": far(20)} and got[3] == {"grouping": far(6)}
    assert got[4] == {"normalisation": "None applied (too few stable pixels)", "grouping": far(20)}
    # Details are parsed before the join, once a job.
    plan = engine.trace_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan[: plan.index("Join LeftOuter")] and plan.index("from_json") > plan.index("Join LeftOuter")

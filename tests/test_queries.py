"""Every registered query of the engine against its SQL, over whole tables."""

import pytest

from geochange import lookup_queries as lookups
from geochange import queries as engine
from geochange import raster_queries as raster
from tests.oracle import compare

D = "/root/testdata/sf0.001"
ALL = engine.QUERIES | raster.QUERIES | lookups.QUERIES
SQL = engine.SQL | raster.SQL | lookups.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    assert compare(ALL[name](spark, D), SQL[name], D) == ""


def test_stream_of_scenes_ends_where_the_batch_does(spark):
    want = sorted(map(tuple, engine.planned_jobs(spark, D).collect()))
    got = sorted(map(tuple, engine.incremental_pairs(spark, D).collect()))
    # Scenes that came late pair as well; what was planned before them stays in the log.
    assert set(want) <= set(got)
    assert len(got) == len(set(got))


def test_pair_plan_in_rounds_and_for_some(spark):
    scenes = engine.load(spark, D, "scenes")
    # Spans of 1, 16, 256 and 4096 days.
    assert compare(engine.spatial.pair_plan(scenes, near=0, grow=16), SQL["pair_plan"], D) == ""
    some = scenes.where("scene_id % 3 = 0").select("scene_id")
    want = sorted(map(tuple, engine.spatial.pair_plan(scenes).where("scene_id % 3 = 0").collect()), key=repr)
    assert sorted(map(tuple, engine.spatial.pair_plan(scenes, some, near=0, grow=16).collect()), key=repr) == want
    assert engine.spatial.pair_plan(scenes.limit(0)).count() == 0


def test_midranks_by_definition(spark):
    values = [(g, v) for g, vs in {1: [5, 5, None, 9, 1], 2: [7], None: [3, 4]}.items() for v in vs]
    rows = spark.createDataFrame(values, "g int, v int")
    key = lambda x: -1 if x is None else x
    pool = {g: [key(v) for h, v in values if h == g] for g, _ in values}
    want = [(g, v, (sum(x < key(v) for x in pool[g]) + sum(x <= key(v) for x in pool[g])) / 2 / len(pool[g])) for g, v in values]
    for buckets in (2, 3, 64):
        got = engine.vector.midrank_percentile(rows, "g", "v", buckets).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert engine.vector.midrank_percentile(rows.limit(0), "g", "v").count() == 0


def test_reserve_and_cap_by_definition(spark):
    rows = [(j, i, (i * 37 % 11) / 11, i * 53 % 17) for j in (1, 2) for i in range(j * 100, j * 100 + 25)]
    df = spark.createDataFrame(rows, "job_id int, candidate_id long, confidence double, area_px int")
    for reserve, cap in ((5, 12), (0, 4), (30, 10), (3, 100)):
        want = []
        for j in (1, 2):
            own = [r for r in rows if r[0] == j and r[2] >= 0.3]
            large = {r[1] for r in sorted(own, key=lambda r: (-r[3], -r[2], r[1]))[:reserve]}
            order = sorted(own, key=lambda r: (r[1] not in large, -r[2], -r[3], r[1]))[:cap]
            want += [(j, r[1], r[1] in large, i) for i, r in enumerate(order, 1)]
        got = engine.catalog.area_capped(df, "job_id", cap, reserve).select("job_id", "candidate_id", "reserved", "place_in_job").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_no_names_clash():
    assert len(ALL) == len(engine.QUERIES) + len(raster.QUERIES) + len(lookups.QUERIES)
    assert SQL.keys() <= ALL.keys()


def test_plans(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan(ALL["browse_capped_area"](spark, D))
    assert "TakeOrderedAndProject" in plan(ALL["list_top"](spark, D))
    boxes = plan(ALL["grid_join_equivalence"](spark, D))
    assert "NestedLoop" not in boxes and "Cartesian" not in boxes
    assert "PushedFilters: [IsNotNull(o_orderkey)" in plan(spark.read.parquet(f"{D}/orders.parquet").where("o_orderkey > 5"))


def test_searches_take_every_twentieth_tile(spark):
    ids = {r[0] for r in engine.load(spark, D, "tiles").where("tile_id % 20 = 0").select("tile_id").collect()}
    for name in ("knn_exact", "knn_scoped", "find_similar", "semantic_percentile"):
        assert {r[0] for r in ALL[name](spark, D).select("query_id").distinct().collect()} == ids, name
        assert "Broadcast" not in ALL[name](spark, D)._jdf.queryExecution().executedPlan().toString()

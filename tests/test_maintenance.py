"""Requests, appends, partition overwrites, migrations and the windowed stream."""

import datetime

import pytest
from pyspark.sql import functions as F

from geochange.operators import catalog, vector, versions
from geochange.plans import requests
from geochange.streaming import incremental


def test_searches_are_checked(spark):
    rows = [("", 5, None), ("  ", 5, None), ("x" * 501, 5, None), ("x", 0, None), ("x", 101, None), ("x", 5, "a b"), ("x", 5, "S2A_x-1.y"), ("x", None, None), (None, 5, None)]
    got = [(r.problem, r.top_k) for r in requests.checked_searches(spark.createDataFrame(rows, "query string, top_k int, scene_id string")).collect()]
    assert [p for p, _ in got] == ["query", "query", "query", "top_k", "top_k", "scene_id", None, None, "query"] and got[7][1] == 10


def test_seeds_are_checked(spark):
    rows = [(None, None, None, 5), ("a", None, 1, 5), ("a", None, None, None), (None, -1, None, 5), (None, None, 0, 5), ("a b", None, None, 5), (None, 0, None, 200)]
    got = [r.problem for r in requests.checked_similar(spark.createDataFrame(rows, "tile_id string, vector_id long, candidate_id long, top_k int")).collect()]
    assert got == ["seed", "seed", None, "vector_id", "candidate_id", "tile_id", "top_k"]


def test_watches_are_checked(spark):
    none = (None,) * 4
    rows = [
        ("a" * 101, *none, 0.0, 0.0, None, None),
        ("a", *none, None, None, None, None),
        ("a", 1.0, 0.0, 0.0, 1.0, None, None, None, None),
        ("a", 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, None, None),
        ("a", *none, 0.0, 0.0, 50_001.0, None),
        ("a", *none, 0.0, 0.0, None, 1.1),
        (None, *none, 10.0, 60.0, 1000.0, None),
        ("a", 0.0, 0.0, 1.0, 2.0, None, None, None, 0.7),
    ]
    got = requests.checked_watches(spark.createDataFrame(rows, "name string, min_x double, min_y double, max_x double, max_y double, lon double, lat double, radius_m double, threshold double")).collect()
    assert [r.problem for r in got] == ["name", "place", "bounds", "place", "radius_m", "threshold", None, None]
    assert (got[6].max_y - got[6].min_y) * 111320 == pytest.approx(2000) and got[6].threshold == 0.5
    assert (got[6].max_x - got[6].min_x) * 111320 * 0.5 == pytest.approx(2000, rel=1e-6)
    assert (got[7].max_x, got[7].threshold, got[0].min_x) == (1.0, 0.7, None)


def test_jobs_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "c")
    put = lambda rows: catalog.replace_jobs(spark.createDataFrame(rows, "job_id long, candidate_id long"), path)
    put([(1, 10), (1, 11), (2, 20)])
    put([(1, 12)])
    put([(1, 12)])
    assert sorted((r.job_id, r.candidate_id) for r in spark.read.parquet(path).collect()) == [(1, 12), (2, 20)]


ROWS = {"detections": "job_id long, candidate_id long", "alerts": "job_id long, candidate_id long, watch_id long"}


def _state(spark, root):
    own = {k: sorted(map(tuple, versions.read_table(spark, root, k, v).select(*[c.split()[0] for c in v.split(", ")]).collect())) for k, v in ROWS.items()}
    return sorted((r.job_id, r.state) for r in versions.current_jobs(spark, root).collect()), own["detections"], own["alerts"]


def _batch(spark, jobs, detections, alerts):
    return spark.createDataFrame(jobs, "job_id long, state string, details string"), {"detections": spark.createDataFrame(detections, ROWS["detections"]), "alerts": spark.createDataFrame(alerts, ROWS["alerts"])}


def test_tables_of_a_job_change_together(spark, tmp_path):
    root = str(tmp_path / "t")
    assert _state(spark, root) == ([], [], [])
    versions.publish(*_batch(spark, [(1, "completed", None), (2, "completed", None)], [(1, 10), (1, 11), (2, 20), (9, 90)], [(1, 10, 7), (2, 20, 7)]), root)
    first = ([(1, "completed"), (2, "completed")], [(1, 10), (1, 11), (2, 20)], [(1, 10, 7), (2, 20, 7)])  # rows of no named job aren't there
    assert _state(spark, root) == first
    # A batch that dies between two tables, and one that dies before its commit: the old state stays whole.
    jobs, tables = _batch(spark, [(1, "completed", None)], [(1, 12)], [(1, 12, 8)])
    for broken in ({"detections": tables["detections"], "alerts": tables["alerts"].withColumn("watch_id", F.raise_error(F.lit("lost")).cast("long"))},):
        with pytest.raises(Exception, match="lost"):
            versions.publish(jobs, broken, root)
        assert _state(spark, root) == first
    with pytest.raises(Exception, match="lost"):
        versions.publish(jobs.withColumn("state", F.raise_error(F.lit("lost"))), tables, root)
    assert _state(spark, root) == first
    # Run again, twice, it gives one result, with the job's old alerts gone.
    for _ in range(2):
        versions.publish(jobs, tables, root)
        second = ([(1, "completed"), (2, "completed")], [(1, 12), (2, 20)], [(1, 12, 8), (2, 20, 7)])
        assert _state(spark, root) == second
    versions.publish(*_batch(spark, [(2, "no_change", None)], [], []), root)
    third = ([(1, "completed"), (2, "no_change")], [(1, 12)], [(1, 12, 8)])
    assert _state(spark, root) == third
    assert versions.vacuum(spark, root, ROWS) > 4 and _state(spark, root) == third


def test_planned_jobs_run_once(spark, tmp_path):
    root, ran = str(tmp_path / "t"), []

    def run(jobs):
        ids = [r.job_id for r in jobs.collect()]
        ran.append(sorted(ids))
        if ran == [[1, 2]]:
            raise RuntimeError("lost")
        return _batch(spark, [(i, "failed" if i == 2 and len(ran) < 3 else "completed", None) for i in ids], [(i, 10 * i) for i in ids], [])

    def go(state):
        stream = spark.readStream.schema("job_id long").parquet(str(tmp_path / "in"))
        return incremental.job_stream(stream, root, run, str(tmp_path / state)).awaitTermination()

    spark.createDataFrame([(1,), (2,), (2,)], "job_id long").coalesce(1).write.parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="lost"):
        go("s")
    assert _state(spark, root)[0] == []
    go("s")  # the batch that was lost comes again
    assert _state(spark, root) == ([(1, "completed"), (2, "failed")], [(1, 10), (2, 20)], [])
    go("other")  # a stream that reads all anew runs what isn't final
    assert ran == [[1, 2], [1, 2], [2]] and _state(spark, root) == ([(1, "completed"), (2, "completed")], [(1, 10), (2, 20)], [])


def test_scenes_go_with_all_that_rests_on_them(spark):
    t = spark.createDataFrame([(1, 5), (2, 6)], "tile_id long, scene_id long")
    c = spark.createDataFrame([(1, 5, 6), (2, 6, 7), (3, 7, 8), (4, 8, 5)], "candidate_id long, scene_a long, scene_b long")
    r = spark.createDataFrame([(1, "x"), (3, "y"), (4, "z"), (99, "of none")], "candidate_id long, decision string")
    a = spark.createDataFrame([(4, 1), (3, 1)], "candidate_id long, watch_id long")
    left = {k: sorted(map(tuple, v.collect())) for k, v in catalog.without_scenes(spark.createDataFrame([(5,)], "scene_id long"), t, c, r, a).items()}
    assert left == {"tiles": [(2, 6)], "candidates": [(2, 6, 7), (3, 7, 8)], "reviews": [(3, "y"), (99, "of none")], "alerts": [(3, 1)]}
    assert {k: v.columns for k, v in catalog.without_scenes(spark.createDataFrame([(5,)], "scene_id long"), t, c, r, a).items()}["candidates"] == c.columns


def test_reviews_are_checked(spark, tmp_path):
    with pytest.raises(ValueError):
        catalog.append_reviews(spark.createDataFrame([(1, "maybe")], "candidate_id long, decision string"), str(tmp_path / "r"))
    catalog.append_reviews(spark.createDataFrame([(1, "confirmed")], "candidate_id long, decision string"), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 1


def test_watchlist_changes(spark):
    w = spark.createDataFrame([(1, "a"), (2, "b")], "watch_id long, name string")
    a = spark.createDataFrame([(1, 5), (2, 6)], "watch_id long, candidate_id long")
    left, alerts = catalog.remove_watch(w, a, w.where("watch_id = 1"))
    assert [r.watch_id for r in left.collect()] == [2] and [r.candidate_id for r in alerts.collect()] == [6]
    assert catalog.add_watch(w, w.selectExpr("watch_id + 2 as watch_id", "name")).count() == 4
    with pytest.raises(ValueError):
        catalog.add_watch(w, w, cap=3)


def test_old_layouts(spark):
    old = spark.createDataFrame([(1, "x", 7)], "id long, name string, extra int")
    new = spark.createDataFrame([], "id long, name string, mgrs string")
    r = catalog.migrated(old, new)
    assert r.columns == ["id", "name", "mgrs", "extra"] and tuple(r.first()) == (1, "x", None, 7)


def test_vectors_are_appended_once(spark):
    t = lambda rows: spark.createDataFrame(rows, "tile_id long, embedding array<double>")
    index = t([(1, [1.0])])
    assert vector.appended(index, t([(1, [2.0]), (2, [3.0])]), "tile_id").count() == 2
    with pytest.raises(ValueError):
        vector.appended(index, t([(3, [float("nan")])]), "tile_id")


def test_rates_by_window(spark, tmp_path):
    rows = [("a", datetime.datetime(2024, 1, 1, h, 5), 1.0) for h in (0, 0, 1, 5)]
    spark.createDataFrame(rows, "kind string, ts timestamp, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("kind string, ts timestamp, value double").parquet(str(tmp_path / "in"))
    q = incremental.rate_by_window(stream).writeStream.format("memory").queryName("rates").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.window.start.hour: (r.n, r.total) for r in spark.table("rates").where(F.col("kind") == "a").collect()}
    assert got.get(0) == (2, 2.0) and got.get(1) == (1, 1.0)  # the last window is still open

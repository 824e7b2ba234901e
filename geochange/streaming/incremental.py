"""Incremental work with Structured Streaming: pair planning and alerts as scenes and detections come.

Late scenes still pair, so nothing on this path has a watermark. Each micro-batch is idempotent: what a job log already
has is left out by an anti-join, so a batch that runs again adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import catalog, raster, spatial, versions


def _log(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of a log so far; none before its first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def pair_stream(scenes: DataFrame, catalog_path: str, jobs_path: str, checkpoint: str):
    """For each micro-batch of the scene stream: the scenes join the catalogue, the pairs that it plans and the
    job log lacks are appended. Returns the started query; it stops when the source is read."""
    schema = scenes.schema

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = _log(spark, catalog_path, schema)
        fresh = batch.dropDuplicates(["scene_id"]).join(known, "scene_id", "left_anti")
        fresh.write.mode("append").parquet(catalog_path)
        everything = spark.read.schema(schema).parquet(catalog_path)
        # Only a scene that a new one meets, itself included, can have a new pair.
        met = spatial.box_join(batch.select("sensor", *S.BOX), everything.select("scene_id", "sensor", *S.BOX), 2.0, keys=("sensor",))
        planned = spatial.planned_jobs(spatial.pair_plan(everything, met.select(F.col("r.scene_id").alias("scene_id"))))
        planned.join(_log(spark, jobs_path, planned.schema), ["scene_a", "scene_b"], "left_anti").write.mode("append").parquet(jobs_path)

    return scenes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def alert_stream(candidates: DataFrame, watchlist: DataFrame, alerts_path: str, checkpoint: str, completed: Callable[[], DataFrame] | None = None):
    """Detections as they come against the watched boxes; an alert of a location and detection is raised once.
    completed gives the job_ids that are completed by the time of a batch; detections of other jobs raise none."""

    def step(batch: DataFrame, batch_id: int) -> None:
        if completed is not None:
            batch = batch.join(completed().select("job_id").distinct(), "job_id", "left_semi")
        found = spatial.watch_alerts(batch, watchlist).dropDuplicates(["watch_id", "candidate_id"])
        old = _log(batch.sparkSession, alerts_path, found.schema)
        found.join(old, ["watch_id", "candidate_id"], "left_anti").write.mode("append").parquet(alerts_path)

    return candidates.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_stream(planned: DataFrame, root: str, run: Callable[[DataFrame], tuple[DataFrame, dict[str, DataFrame]]], checkpoint: str):
    """Runs the jobs of a stream (job_id, ...) as they are planned. run gives a batch's jobs (job_id, state, details) and
    their rows by table; they are published together (see operators.versions). A job in a final state isn't run again, so
    a batch that comes again adds nothing, and one that died before its commit is run anew."""

    def step(batch: DataFrame, batch_id: int) -> None:
        over = versions.current_jobs(batch.sparkSession, root).where(F.col("state").isin(*catalog.FINAL)).select("job_id")
        fresh = raster.kept(batch.dropDuplicates(["job_id"]).join(over, "job_id", "left_anti"))
        if fresh.limit(1).count():
            versions.publish(*run(fresh), root)

    return planned.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rate_by_window(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums of a stream of operations by kind and window; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "kind").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

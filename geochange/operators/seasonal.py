"""Whether a loss of vegetation is the season's: the same weeks of earlier years."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from .spatial import box_join


def seasonal_history(candidates: DataFrame, scenes: DataFrame, cell: float = 2.0) -> DataFrame:
    """J10, A24, F29. candidates: candidate_id, sensor, acquired, x, y, current. Priors are scenes of the sensor, of an
    earlier year and the same season, whose footprint holds the point; clear ones give the mean and spread. A point is
    a box of no size, so the join is by sensor and cell."""
    points = candidates.select("candidate_id", "sensor", "acquired", *[F.col(c[-1]).alias(c) for c in S.BOX])
    priors = scenes.select("sensor", "acquired", "ndvi", "clear", *S.BOX)
    both = box_join(points, priors, cell, S.same_season(F.col("r.acquired"), F.col("l.acquired")), ("sensor",))
    clear = F.when(F.col("r.clear"), F.col("r.ndvi"))
    stats = both.groupBy(F.col("l.candidate_id").alias("candidate_id")).agg(F.count("*").alias("priors"), F.count(clear).alias("n_clear"), F.avg(clear).alias("mean"), F.stddev_samp(clear).alias("std"))
    out = candidates.join(stats, "candidate_id", "left")
    status, factor = S.seasonal_verdict(F.coalesce("n_clear", F.lit(0)), F.col("mean"), F.coalesce("std", F.lit(0.0)), F.col("current"))
    return out.select("candidate_id", F.coalesce("priors", F.lit(0)).alias("priors"), F.coalesce("n_clear", F.lit(0)).alias("n_clear"), F.round("mean", 6).alias("prior_mean"), F.round("std", 6).alias("prior_std"), status.alias("status"), factor.alias("factor"))


def annotated(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Detections without a status get theirs, and their confidence its factor; those that have one stay as they are."""
    v = verdicts.select("candidate_id", F.col("status").alias("_s"), F.col("factor").alias("_f"))
    open_ = F.col("seasonality").isNull() & F.col("_s").isNotNull()
    out = candidates.join(v, "candidate_id", "left")
    return out.withColumn("confidence", F.when(open_, F.col("confidence") * F.col("_f")).otherwise(F.col("confidence"))).withColumn("seasonality", F.coalesce("seasonality", "_s")).drop("_s", "_f")

"""What belongs to a job - its state, detections, alerts - appears together or not at all.

Rows of each table are written under a version that nothing names yet. One small file in the commit log then names it for
the jobs of the batch: before it, readers see what was there; after it, all of the new. A batch that dies in between
leaves files that no commit names, and running it again gives one result, as a job's latest commit alone counts. One
writer at a time is assumed; commits are ordered by their numbers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "job_id long, state string, details string, seq long, version string"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table so far; no rows before its first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def commits(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, f"{root}/commits", COMMIT)


def current_jobs(spark: SparkSession, root: str) -> DataFrame:
    """(job_id, state, details, seq, version): each job as its last commit has it."""
    last = F.max_by(F.struct("state", "details", "seq", "version"), F.struct("seq", "version")).alias("x")
    return commits(spark, root).groupBy("job_id").agg(last).select("job_id", "x.*")


def publish(jobs: DataFrame, tables: dict[str, DataFrame], root: str) -> str:
    """Commits jobs (job_id, state, details) with their rows of each table, in place of what these jobs had in all tables.

    Rows of jobs that aren't named are left out; a named job without rows in a table has none from now on. Returns the
    version. Everything is written before the commit, which is one file."""
    spark = jobs.sparkSession
    version = uuid.uuid4().hex
    named = jobs.select("job_id").distinct()
    for name, rows in tables.items():
        own = rows.join(named, "job_id", "left_semi").withColumn("version", F.lit(version))
        own.write.mode("append").partitionBy("version").parquet(f"{root}/{name}")
    seq = (commits(spark, root).agg(F.max("seq")).first()[0] or 0) + 1
    jobs.select(F.col("job_id").cast("long"), F.col("state").cast("string"), F.col("details").cast("string"), F.lit(seq).cast("long").alias("seq"), F.lit(version).alias("version")).coalesce(1).write.mode("append").parquet(f"{root}/commits")
    return version


def read_table(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """The rows of a table that the jobs' last commits name; schema is that of its rows, without the version."""
    rows = _read(spark, f"{root}/{name}", f"{schema}, version string")
    return rows.join(current_jobs(spark, root).select("job_id", "version"), ["job_id", "version"], "left_semi").drop("version")


def vacuum(spark: SparkSession, root: str, schemas: dict[str, str]) -> int:
    """Puts all current rows under one new version and deletes the folders of the others, those that no commit names too;
    how many folders went. Readers that began before it may miss files, as with any deletion."""
    jobs = current_jobs(spark, root).select("job_id", "state", "details")
    version = publish(jobs, {name: read_table(spark, root, name, schema) for name, schema in schemas.items()}, root)
    gone = 0
    for name in schemas:
        top = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        for x in fs.listStatus(top) if fs.exists(top) else []:
            if x.getPath().getName().startswith("version=") and x.getPath().getName() != f"version={version}":
                gone += bool(fs.delete(x.getPath(), True))
    return gone

"""Helpers that all training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of an Arrow batch that are worked on at a time. Texts may be long, so this is small.
ARROW_ROWS = 1024
#: Buckets of a running sum in two steps, as a power of two: no window is over all rows, or over a hot key's.
BUCKET_BITS = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; a folder of this machine only where none is set and the master is local, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: later plans start from files, not from df's lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def dropped(*frames: DataFrame | None) -> None:
    """Deletes the files of written() tables that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "written_path", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def row_key() -> Column:
    """doc_id as a key without nulls, d."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d")


def text_key() -> Column:
    """A hash of the text, t: with d it tells rows of different texts apart, whatever their doc_id."""
    return F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()).alias("t")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def renamed(columns: Sequence[str], new: Sequence[str]) -> list[str]:
    """The names that columns keep beside new ones: one that is named like a new one becomes source_<name>, with as many
    more source_ before it as it takes to be the only one."""
    taken, out = {*columns, *new}, []
    for c in columns:
        name = c
        while c in new and name in taken:
            name = f"source_{name}"
        taken.add(name)
        out.append(name)
    return out


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow whose function sees pieces of ARROW_ROWS rows, so that long texts don't add up to much memory. Spark
    bounds the bytes of a batch itself; the session's settings stay as they are."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ARROW_ROWS):
                yield batch.slice(i, ARROW_ROWS)

    return df.mapInArrow(lambda batches: fn(pieces(batches)), schema)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of doc_id as text leaves this remainder; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def pick_ids(df: DataFrame, by: str, n: int) -> DataFrame:
    """At most n doc_ids of each value of column by, those with the smallest hashes: a bounded sample for fitting.

    Hashes are even, so a bound on them that follows a value's count leaves about 4 n + 200 of its rows, however many
    it has and in however many tasks; only these are ranked.
    """
    order = Window.partitionBy(by).orderBy("_h", "doc_id")
    ids = df.select(by, "doc_id").where(f"`{by}` is not null")
    # A row for each value, and a model holds far more for each: its classes are few.
    counts = F.broadcast(ids.groupBy(by).agg(F.count("*").alias("_n")))
    hashed = ids.join(counts, by).withColumn("_h", F.xxhash64("doc_id"))
    low = hashed.where(F.col("_h") / F.lit(2.0**64) + 0.5 <= F.lit(4.0 * n + 200) / F.col("_n"))
    return low.select(by, "doc_id", "_h").distinct().withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n).select(by, "doc_id")


def sums_before(pairs: DataFrame, part: list[str], by: str, bucket: Column, extra: list[str]) -> DataFrame:
    """pairs with `less`, the sum of n over rows of the same part with a smaller `by` (then `extra`), in two steps: by
    bucket, whose order is that of `by`, and within the bucket. The columns of part have no nulls."""
    pairs = pairs.withColumn("_b", bucket)
    sums = pairs.groupBy(*part, "_b").agg(F.sum("n").alias("_s"))
    over = Window.partitionBy(*(part or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_off", F.coalesce(F.sum("_s").over(over), F.lit(0))).drop("_s")
    within = Window.partitionBy(*part, "_b").orderBy(by, *extra).rowsBetween(Window.unboundedPreceding, -1)
    out = pairs.withColumn("_in", F.coalesce(F.sum("n").over(within), F.lit(0))).join(sums, [*part, "_b"])
    return out.withColumn("less", F.col("_off") + F.col("_in")).drop("_off", "_in", "_b")

"""Product folders as tables: Spark lists and reads the files, so any store that it reads will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S

MAX_XML = 20 * 1024 * 1024


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Path, length and, only if asked for, content of all files under root whose name fits."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).withColumn("name", F.regexp_extract("path", r"([^/\\]+)$", 1))


def safe_products(spark: SparkSession, root: str) -> DataFrame:
    """One row for each product folder's metadata file: level, start, baseline, offsets by band, id, date and
    sensor. Files over 20 MB and products of another level than 2A are refused: `problem` says why, else it is null."""
    meta = files(spark, root, "MTD_MSIL*.xml")
    xml = F.when(F.col("length") <= MAX_XML, F.col("content").cast("string"))

    def value(tag: str) -> Column:
        return F.nullif(F.xpath_string(xml, F.lit(f"//*[local-name()='{tag}'][1]")), F.lit(""))

    out = meta.select(
        "path",
        F.regexp_extract("path", r"([^/\\]+)\.SAFE[/\\]", 1).alias("product"),
        value("PRODUCT_TYPE").alias("product_type"),
        value("PROCESSING_LEVEL").alias("level"),
        F.try_to_timestamp(value("PRODUCT_START_TIME")).alias("started"),
        value("PROCESSING_BASELINE").alias("baseline"),
        F.transform(F.xpath(xml, F.lit("//*[local-name()='BOA_ADD_OFFSET']/text()")), lambda x: x.try_cast("int")).alias("offsets"),
        F.transform(F.xpath(xml, F.lit("//*[local-name()='BOA_ADD_OFFSET']/@band_id")), lambda x: x.try_cast("int")).alias("offset_bands"),
        xml.isNull().alias("_large"),
    )
    problem = F.when(F.col("_large"), "metadata too large").when(F.col("product_type").isNull(), "no product type").when(~F.col("product_type").contains("2A"), "not level 2A")
    return out.select("*", problem.alias("problem"), S.safe_id(F.col("product")).alias("scene_id"), F.coalesce(F.to_date("started"), S.acquisition_date(F.col("product"))).alias("acquired"), S.detect_sensor(F.col("product")).alias("sensor")).drop("_large")


def landsat_scenes(spark: SparkSession, root: str) -> DataFrame:
    """Scenes of which every needed band file is there exactly once."""
    n = files(spark, root, "*.TIF").select("path", "name", S.landsat_name(F.col("name")).alias("p"), F.regexp_extract("name", r"_(SR_B\d|QA_PIXEL)\.TIF$", 1).alias("band"))
    scenes = n.where(F.col("p").isNotNull() & (F.col("band") != "")).groupBy(F.regexp_extract("name", r"^(.*)_(?:SR_B\d|QA_PIXEL)\.TIF$", 1).alias("scene_id"))
    need = F.array(*[F.lit(b) for b in ("QA_PIXEL", "SR_B2", "SR_B3", "SR_B4", "SR_B5")])
    out = scenes.agg(F.first("p").alias("parts"), F.array_sort(F.collect_list("band")).alias("bands"), F.array_sort(F.collect_list("path")).alias("paths"))
    complete, unique = F.size(F.array_except(need, "bands")) == 0, F.size(F.array_distinct("bands")) == F.size("bands")
    problem = F.when(~complete, "a band is missing").when(~unique, "a band is there twice")
    return out.withColumns({"complete": complete, "unique": unique, "problem": problem})


def checksums(found: DataFrame) -> DataFrame:
    """A file's digest. The content goes to the digest in the task that reads it and no further."""
    return found.select("path", "name", "length", F.sha2("content", 256).alias("sha256"))


def composite_checksum(sums: DataFrame, by: list[str]) -> DataFrame:
    """One digest for each product, over `name:digest` lines in order of name."""
    line = F.concat_ws(":", "name", "sha256")
    return sums.groupBy(*by).agg(F.sha2(F.concat(F.array_join(F.array_sort(F.collect_list(line)), "\n"), F.lit("\n")), 256).alias("sha256"))


def storage(found: DataFrame) -> DataFrame:
    """Files and bytes by the top folder, from the listing alone."""
    top = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return found.groupBy(top.alias("area")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.round(F.sum("length") / 1e6, 2).alias("mb"))


def write_chunks(pixels: DataFrame, path: str, chunk: int = 512) -> None:
    """Pixels as files of chunks of rows, so that a window reads the chunks it needs."""
    pixels.withColumn("chunk", F.floor(F.col("r") / chunk)).repartition("chunk").write.partitionBy("chunk").parquet(path)


def read_window(spark: SparkSession, path: str, r0: int, r1: int, c0: int, c1: int, step: int = 1, chunk: int = 512) -> DataFrame:
    """A window, every step-th row and column; other chunks' files are not opened."""
    rows = spark.read.parquet(path).where(F.col("chunk").between(r0 // chunk, (r1 - 1) // chunk))
    return rows.where(F.col("r").between(r0, r1 - 1) & F.col("c").between(c0, c1 - 1) & ((F.col("r") - r0) % step == 0) & ((F.col("c") - c0) % step == 0)).drop("chunk")

"""Product folders, checksums and chunk files on small trees."""

import datetime
import hashlib

from pyspark.sql import functions as F

from geochange.sources import files as S

XML = """<n1:Level-2A_User_Product xmlns:n1="x"><n1:General_Info><PRODUCT_START_TIME>2024-01-15T05:21:41.024Z</PRODUCT_START_TIME>
<PROCESSING_LEVEL>Level-2A</PROCESSING_LEVEL><PRODUCT_TYPE>{kind}</PRODUCT_TYPE><PROCESSING_BASELINE>05.10</PROCESSING_BASELINE>
<BOA_ADD_OFFSET band_id="1">-1000</BOA_ADD_OFFSET><BOA_ADD_OFFSET band_id="2">-1000</BOA_ADD_OFFSET></n1:General_Info></n1:Level-2A_User_Product>"""


def test_safe_products(spark, tmp_path):
    for name, kind in (("S2A_MSIL2A_20240115T052141_N0510_R062_T43RCL_1", "S2MSI2A"), ("S2A_MSIL1C_20240116T052141_N0510_R062_T43RCL_1", "S2MSI1C")):
        at = tmp_path / f"{name}.SAFE"
        at.mkdir()
        (at / "MTD_MSIL2A.xml").write_text(XML.format(kind=kind))
    a, b = S.safe_products(spark, str(tmp_path)).orderBy("product").collect()
    assert (a.problem, b.problem) == ("not level 2A", None)
    assert (b.scene_id, b.acquired, b.sensor, b.baseline, b.offsets) == ("S2A_MSIL2A_20240115T052141_N0510_R062_T43RCL_1", datetime.date(2024, 1, 15), "sentinel2", "05.10", [-1000, -1000])


def test_landsat_scenes(spark, tmp_path):
    whole, part = "LC09_L2SP_146040_20240210_20240301_02_T1", "LC08_L2SP_147039_20231110_20231201_02_T2"
    for scene, bands in ((whole, ("SR_B2", "SR_B3", "SR_B4", "SR_B5", "QA_PIXEL")), (part, ("SR_B2",))):
        for b in bands:
            (tmp_path / f"{scene}_{b}.TIF").write_bytes(b"x")
    got = {r.scene_id: (r.complete, r.unique, r.parts.tier) for r in S.landsat_scenes(spark, str(tmp_path)).collect()}
    assert got == {whole: (True, True, "T1"), part: (False, True, "T2")}


def test_checksums(spark, tmp_path):
    for n in ("b.bin", "a.bin"):
        (tmp_path / n).write_bytes(n.encode())
    sums = S.checksums(S.files(spark, str(tmp_path))).withColumn("p", F.lit(1))
    one = {n: hashlib.sha256(n.encode()).hexdigest() for n in ("a.bin", "b.bin")}
    assert {r.name: r.sha256 for r in sums.collect()} == one
    want = hashlib.sha256("".join(f"{n}:{one[n]}\n" for n in sorted(one)).encode()).hexdigest()
    assert S.composite_checksum(sums, ["p"]).first().sha256 == want
    assert S.storage(S.files(spark, str(tmp_path))).first().bytes == 10


def test_window_of_chunks(spark, tmp_path):
    px = spark.range(64 * 64).select((F.col("id") / 64).cast("long").alias("r"), (F.col("id") % 64).alias("c"), F.col("id").alias("v"))
    S.write_chunks(px, str(tmp_path / "px"), 16)
    got = S.read_window(spark, str(tmp_path / "px"), 10, 40, 5, 25, 3, 16)
    assert {(x.r, x.c, x.v) for x in got.collect()} == {(r, c, r * 64 + c) for r in range(10, 40, 3) for c in range(5, 25, 3)}
    assert "PartitionFilters: [isnotnull(chunk" in got._jdf.queryExecution().executedPlan().toString()

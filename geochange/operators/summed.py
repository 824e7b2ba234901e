"""How many marked pixels each of many boxes holds, by summed-area tables.

A table in chunks: a chunk sums up its own pixels, its rows' and columns' totals carry over to the chunks right of and
below it, and a box is four look-ups. Work grows with the pixels and the boxes, not with the pixels in boxes: each pixel is
read once, however many boxes lie over it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .raster import kept

CHUNK = 512
_OUT = "kind int, id long, sign int, y long, x long, cr long, cc long, n long"


def box_counts(marked: DataFrame, boxes: DataFrame, height: int, width: int, chunk: int = CHUNK) -> DataFrame:
    """(id, n): the rows of marked (r, c; each pixel once, within height and width) in each of boxes (id, min_r, max_r,
    min_c, max_c; ends included, within the raster). Boxes without a marked pixel have n 0; ids may repeat: their boxes add up."""
    nr, nc = height // chunk + 1, width // chunk + 1
    ends = lambda a: F.explode(F.array(F.struct(F.lit(-1).alias("s"), F.col(f"min_{a}").alias("v")), F.struct(F.lit(1).alias("s"), (F.col(f"max_{a}") + 1).alias("v"))))
    points = boxes.withColumn("p", ends("r")).withColumn("q", ends("c")).select(F.col("id").cast("long").alias("id"), (F.col("p.s") * F.col("q.s")).alias("sign"), F.col("p.v").cast("long").alias("y"), F.col("q.v").cast("long").alias("x"))
    points = points.withColumns({"cr": F.floor(F.col("y") / chunk), "cc": F.floor(F.col("x") / chunk)})
    # A point without a sign in each chunk, so that the carries have no gaps.
    every = marked.sparkSession.range(nr * nc).select(F.lit(None).cast("long").alias("id"), F.lit(0).alias("sign"), F.lit(0).cast("long").alias("y"), F.lit(0).cast("long").alias("x"), F.floor(F.col("id") / nc).alias("cr"), (F.col("id") % nc).alias("cc"))
    px = marked.select("r", "c", F.floor(F.col("r") / chunk).alias("cr"), F.floor(F.col("c") / chunk).alias("cc"))

    def work(key: tuple, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        cr, cc = (int(k) for k in key)
        table = np.zeros((chunk, chunk), dtype=np.int64)
        table[own["r"].to_numpy() - cr * chunk, own["c"].to_numpy() - cc * chunk] = 1
        rows, columns = table.sum(axis=1), table.sum(axis=0)
        table = np.pad(table.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
        asked = asked[asked["sign"] != 0]
        y, x = asked["y"].to_numpy(), asked["x"].to_numpy()
        at = np.arange(chunk)
        found = pd.DataFrame({"kind": 0, "id": asked["id"], "sign": asked["sign"], "y": y, "x": x, "cr": cr, "cc": cc, "n": table[y - cr * chunk, x - cc * chunk]})
        sums = [pd.DataFrame({"kind": kind, "id": 0, "sign": 0, "y": cr * chunk + at, "x": cc * chunk + at, "cr": cr, "cc": cc, "n": n}) for kind, n in ((1, rows), (2, columns))]
        return pd.concat([found, *sums]).astype({"id": "int64"})

    out = kept(px.groupBy("cr", "cc").cogroup(points.unionByName(every).groupBy("cr", "cc")).applyInPandas(work, _OUT))

    def upto(part: list[str], by: str, last: int) -> Window:
        return Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, last)

    def carried(kind: int, across: str, along: str, over: str) -> DataFrame:
        """Of a row (or column) the totals of the chunks before it, added up from the chunk's first row on."""
        before = out.where(F.col("kind") == kind).withColumn("n", F.coalesce(F.sum("n").over(upto([along], across, -1)), F.lit(0)))
        return before.select(F.col(along).alias("at"), "cr", "cc", F.sum("n").over(upto(["cr", "cc"], along, 0)).alias(over))

    rows, columns = carried(1, "cc", "y", "left"), carried(2, "cr", "x", "above")
    whole = rows.where((F.col("at") + 1) % chunk == 0).select("cr", "cc", F.coalesce(F.sum("left").over(upto(["cc"], "cr", -1)), F.lit(0)).alias("corner"))
    asked = out.where("kind = 0").withColumns({"u": F.col("y") - 1, "v": F.col("x") - 1})
    asked = asked.join(rows.select(F.col("at").alias("u"), "cr", "cc", "left"), ["u", "cr", "cc"], "left")  # none at a chunk's first row
    asked = asked.join(columns.select(F.col("at").alias("v"), "cr", "cc", "above"), ["v", "cr", "cc"], "left")
    asked = asked.join(whole, ["cr", "cc"], "left")
    total = F.col("n") + F.coalesce("left", F.lit(0)) + F.coalesce("above", F.lit(0)) + F.coalesce("corner", F.lit(0))
    return asked.groupBy("id").agg(F.sum(F.col("sign") * total).alias("n"))


def box_coverage(marked: DataFrame, blobs: DataFrame, height: int, width: int, chunk: int = CHUNK) -> DataFrame:
    """(label, coverage): the share of marked pixels in each blob's box."""
    n = box_counts(marked, blobs.select(F.col("label").alias("id"), "min_r", "max_r", "min_c", "max_c"), height, width, chunk)
    size = (F.col("max_r") - F.col("min_r") + 1) * (F.col("max_c") - F.col("min_c") + 1)
    return blobs.select("label", size.alias("_size")).join(n.withColumnRenamed("id", "label"), "label").select("label", (F.col("n") / F.col("_size")).alias("coverage"))

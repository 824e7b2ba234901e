"""R22, R20 on the ground: outlines of components with their holes, over chunks, and places in degrees.

A boundary is a set of directed pixel sides, with the component on the left. Which side follows a side is known from the two
pixels ahead of it, so each chunk (with a halo of one pixel) follows its own sides to pieces of rings; a piece that leaves
the chunk knows the side that it goes on with. Pieces are put in order by pointer doubling over these links, rounds of it
growing with the logarithm of the pieces of a ring. So no component meets in one task: a task holds a chunk, or the
corners of one ring.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from .alignment import simplified
from .raster import CHUNK, kept
from .resampling import Grid

#: Sides of a pixel, as walked with the pixel on the left: west (down), south (right), east (up), north (left). Of each: the
#: corner that it begins at, its direction, and the pixels ahead on the left and on the right, as offsets (rows, columns).
BEGIN = ((0, 0), (1, 0), (1, 1), (0, 1))
AHEAD_LEFT = ((1, 0), (0, 1), (-1, 0), (0, -1))
AHEAD_RIGHT = ((1, -1), (1, 1), (-1, 1), (-1, -1))
BEYOND = ((0, -1), (1, 0), (0, 1), (-1, 0))

_PIECES = "label long, start long, next long, points array<array<long>>"


def _pieces(pdf: pd.DataFrame, chunk: int, width: int) -> pd.DataFrame:
    """The pieces of rings along the sides of a chunk's own pixels."""
    cr, cc = int(pdf["cr"].iloc[0]), int(pdf["cc"].iloc[0])
    r0, c0 = cr * chunk - 1, cc * chunk - 1
    lab = np.full((chunk + 2, chunk + 2), -1, dtype=np.int64)
    lab[pdf["r"].to_numpy() - r0, pdf["c"].to_numpy() - c0] = pdf["label"].to_numpy()
    own = np.zeros(lab.shape, dtype=bool)
    own[1:-1, 1:-1] = lab[1:-1, 1:-1] >= 0
    shifted = lambda d: np.roll(lab, (-d[0], -d[1]), axis=(0, 1))  # noqa: E731  of own pixels, which aren't at the rim
    ids, follow = [], []
    for side in range(4):
        y, x = np.nonzero(own & (shifted(BEYOND[side]) != lab))
        left = shifted(AHEAD_LEFT[side])[y, x] == lab[y, x]
        right = left & (shifted(AHEAD_RIGHT[side])[y, x] == lab[y, x])
        # Left alone: straight on, along the pixel ahead. Both: right, along the pixel ahead on the right. Neither: left.
        dy = np.where(right, AHEAD_RIGHT[side][0], np.where(left, AHEAD_LEFT[side][0], 0))
        dx = np.where(right, AHEAD_RIGHT[side][1], np.where(left, AHEAD_LEFT[side][1], 0))
        turn = np.where(right, (side + 3) % 4, np.where(left, side, (side + 1) % 4))
        ids.append(((y + r0) * width + x + c0) * 4 + side)
        follow.append(((y + dy + r0) * width + x + dx + c0) * 4 + turn)
    ids, follow = np.concatenate(ids), np.concatenate(follow)
    place = {int(e): i for i, e in enumerate(ids)}
    to = [place.get(int(e), -1) for e in follow]
    entered = np.zeros(len(ids), dtype=bool)
    entered[[t for t in to if t >= 0]] = True
    done = np.zeros(len(ids), dtype=bool)
    out = []
    # Pieces begin where another chunk leads; what is left then are rings of the chunk's own.
    for first in [*np.flatnonzero(~entered).tolist(), *np.argsort(ids).tolist()]:
        if done[first]:
            continue
        points, at, last = [], first, -1
        while at >= 0 and not done[at]:
            done[at] = True
            pixel, side = divmod(int(ids[at]), 4)
            if side != last:
                points.append([pixel // width + BEGIN[side][0], pixel % width + BEGIN[side][1]])
                last = side
            came, at = at, to[at]
        pixel = int(ids[first]) // 4
        out.append((int(lab[pixel // width - r0, pixel % width - c0]), int(ids[first]), int(follow[came]), points))
    return pd.DataFrame(out, columns=["label", "start", "next", "points"])


def _ordered(links: DataFrame) -> DataFrame:
    """(start, ring, place) of links (start, next) that form cycles: the least start of the cycle, and how many links it is
    from there."""
    now = kept(links.select("start", "next", F.col("start").alias("ring")))
    while True:  # the least start among the next 1, 2, 4, ...
        ahead = now.select(F.col("start").alias("next"), F.col("next").alias("n2"), F.col("ring").alias("r2"))
        after = kept(now.join(ahead, "next").select("start", F.col("n2").alias("next"), F.least("ring", "r2").alias("ring"), (F.col("r2") < F.col("ring")).alias("moved")))
        moved = after.where("moved").limit(1).count()
        now = after.drop("moved")
        if not moved:
            break
    # Cut before the least: a link's place is counted back from the cycle's end.
    own = now.select("start", "ring")
    now = kept(links.select("start", "next").join(own, "start").select("start", "ring", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("next"), F.when(F.col("next") != F.col("ring"), 1).otherwise(0).alias("back")))
    while now.where("next is not null").limit(1).count():
        ahead = now.select(F.col("start").alias("next"), F.col("next").alias("n2"), F.col("back").alias("b2"))
        now = kept(now.join(ahead, "next", "left").select("start", "ring", F.col("n2").alias("next"), (F.col("back") + F.coalesce("b2", F.lit(0))).alias("back")))
    return now.select("start", "ring", (-F.col("back")).alias("place"))


def loops(points: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """A closed walk over corners as simple rings: where it comes to a corner again, what lies between is a ring of its own.
    Corners on a straight line go."""
    out, path, at = [], [], {}
    for p in points:
        if p in at:
            k = at[p]
            out.append(path[k:])
            for q in path[k:]:
                at.pop(q)
            path = path[:k]
        at[p] = len(path)
        path.append(p)
    out.append(path)
    found = []
    for ring in out:
        n = len(ring)
        turns = [ring[i] for i in range(n) if (ring[i][0] - ring[i - 1][0]) * (ring[(i + 1) % n][1] - ring[i][1]) != (ring[i][1] - ring[i - 1][1]) * (ring[(i + 1) % n][0] - ring[i][0])]
        if len(turns) >= 4:
            k = turns.index(min(turns))
            found.append([*turns[k:], *turns[: k + 1]])
    return found


def rings(labels: DataFrame, width: int, chunk: int = CHUNK, tolerance: float = 0.5, most: int | None = 1000) -> DataFrame:
    """(label, hole, ring): the closed rings of each component of labels (r, c, label), as [x, y] corners of pixels. The one
    outer ring runs against the clock (as seen with rows downwards), holes with it; none touches itself. A ring of over
    `most` corners is simplified, by a tolerance in pixels that doubles until they are no more; None leaves all."""
    span = lambda v: F.explode(F.sequence(F.floor((F.col(v) - 1) / chunk), F.floor((F.col(v) + 1) / chunk)))
    dealt = labels.select("r", "c", "label").withColumn("cr", span("r")).withColumn("cc", span("c"))
    pieces = kept(dealt.groupBy("cr", "cc").applyInPandas(lambda pdf: _pieces(pdf, chunk, width), _PIECES))
    open_ = pieces.where("start <> next")
    if open_.limit(1).count():
        order = _ordered(open_.select("start", "next"))
        placed = open_.join(order, "start").unionByName(pieces.where("start = next").withColumns({"ring": F.col("start"), "place": F.lit(0)}))
    else:
        placed = pieces.withColumns({"ring": F.col("start"), "place": F.lit(0)})
    whole = placed.groupBy("label", "ring").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "points"))), lambda x: x["points"])).alias("points"))

    def split(batches):
        for pdf in batches:
            out = []
            for label, points in zip(pdf["label"], pdf["points"], strict=True):
                for ring in loops([(int(p[1]), int(p[0])) for p in points]):
                    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))
                    t = tolerance
                    while most and len(ring) > most:
                        ring = simplified(ring, t)
                        t *= 2
                    out.append((label, area > 0, [[float(x), float(y)] for x, y in ring]))
            yield pd.DataFrame(out, columns=["label", "hole", "ring"])

    return whole.select("label", "points").mapInPandas(split, "label long, hole boolean, ring array<array<double>>")


def geometries(outlines: DataFrame, groups: DataFrame, grid: Grid) -> DataFrame:
    """(group, geometry): the components of each group (label, group) as GeoJSON in degrees with six decimals: a Polygon, or
    a MultiPolygon of several, in order of label; outer rings against the clock."""

    def placed(batches):
        for pdf in batches:
            out = []
            for ring in pdf["ring"]:
                p = np.array([list(x) for x in ring])
                sx, _, left, _, sy, top = grid.transform
                lon, lat = grid.lonlat(left + sx * p[:, 0], top + sy * p[:, 1])
                out.append(np.round(np.stack([lon, lat], axis=1), 6).tolist())
            yield pdf.assign(ring=out)

    on_ground = outlines.mapInPandas(placed, "label long, hole boolean, ring array<array<double>>")
    polygons = on_ground.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("hole", "ring"))), lambda x: x["ring"]).alias("polygon"))
    own = polygons.join(groups.select("label", "group"), "label").groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "polygon"))), lambda x: x["polygon"]).alias("p"))
    shape = lambda kind, x: F.to_json(F.struct(F.lit(kind).alias("type"), x.alias("coordinates")))
    return own.select("group", F.when(F.size("p") == 1, shape("Polygon", F.col("p")[0])).otherwise(shape("MultiPolygon", F.col("p"))).alias("geometry"))


def located(rows: DataFrame, grid: Grid, steps: int = 21) -> DataFrame:
    """Detections with boxes in pixels (min_x, min_y, max_x, max_y; centre_x, centre_y) with the box on the
    ground (native_...), in degrees (min_lon, ...: around the box's sides with `steps` places between corners), the
    centre's longitude and latitude with six decimals, and the grid reference of these."""
    sx, _, left, _, sy, top = grid.transform
    native = {"native_min_x": left + F.col("min_x") * sx, "native_min_y": top + F.col("max_y") * sy, "native_max_x": left + F.col("max_x") * sx, "native_max_y": top + F.col("min_y") * sy}
    out = rows.withColumns(native).withColumns({"_x": left + F.col("centre_x") * sx, "_y": top + F.col("centre_y") * sy})

    def lonlat(x: Column, y: Column) -> dict[str, Column]:
        return {"lon": x, "lat": y} if grid.zone is None else S.lonlat(F.lit(grid.zone[0]), x, y, F.lit(grid.zone[1]))

    share = F.transform(F.sequence(F.lit(0), F.lit(steps + 1)), lambda i: i / (steps + 1))
    along = lambda a, b: F.transform(share, lambda t: F.col(a) + (F.col(b) - F.col(a)) * t)
    x, y = along("native_min_x", "native_max_x"), along("native_min_y", "native_max_y")

    def side(of: str, end: str, flat: bool) -> Column:
        """Longitudes or latitudes along one side of the box, at the given end of the other axis."""
        return F.transform(x, lambda v: lonlat(v, F.col(end))[of]) if flat else F.transform(y, lambda v: lonlat(F.col(end), v)[of])

    ends = {}
    for k, pick in (("min", F.array_min), ("max", F.array_max)):
        for of in ("lon", "lat"):
            sides = [side(of, f"native_{m}_{a}", a == "y") for a in "xy" for m in ("min", "max")]
            ends[f"{k}_{of}"] = pick(F.flatten(F.array(*sides)))
    centre = lonlat(F.col("_x"), F.col("_y"))
    out = out.withColumns(ends | {f"centroid_{k}": F.round(v, 6) for k, v in centre.items()}).drop("_x", "_y")
    return out.withColumn("mgrs_ref", S.mgrs(F.col("centroid_lat"), F.col("centroid_lon")))

"""Joins on boxes: grid cells make them equi-joins that shuffle and spill; small sides are broadcast by Spark's own measure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..params import P
from .raster import kept


def _cells(lo: Column, hi: Column, size: float) -> Column:
    return F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size)))


def box_join(left: DataFrame, right: DataFrame, size: float, on: Column | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows whose closed boxes intersect, as structs l and r. Each box goes to the cells that it covers;
    a pair that shares several counts in the first of them, so no distinct is needed. keys: columns that must be equal
    too and join the cell in dealing the rows out; on: a further condition on l and r."""

    def dealt(df: DataFrame, name: str) -> DataFrame:
        b = S.box()
        wide = df.select(F.struct("*").alias(name), *keys, _cells(b["min_x"], b["max_x"], size).alias("cx"), "min_y", "max_y")
        return wide.select(name, *keys, "cx", _cells(F.col("min_y"), F.col("max_y"), size).alias("cy"))

    a, b = S.box("l."), S.box("r.")
    first = (F.col("cx") == F.greatest(F.floor(a["min_x"] / size), F.floor(b["min_x"] / size))) & (F.col("cy") == F.greatest(F.floor(a["min_y"] / size), F.floor(b["min_y"] / size)))
    out = dealt(left, "l").join(dealt(right, "r"), [*keys, "cx", "cy"]).where(S.intersects(a, b) & first)
    return (out if on is None else out.where(on)).select("l", "r")


def watch_alerts(candidates: DataFrame, watchlist: DataFrame, cell: float = 2.0) -> DataFrame:
    """(watch_id, candidate_id) where a candidate of enough confidence meets a watched box."""
    pairs = box_join(candidates, watchlist, cell, F.col("l.confidence") >= F.col("r.threshold"))
    return pairs.select(F.col("r.watch_id").alias("watch_id"), F.col("l.candidate_id").alias("candidate_id"), F.col("l.job_id").alias("job_id"), F.col("l.confidence").alias("confidence"))


def watch_counts(watchlist: DataFrame, alerts: DataFrame, acknowledged: Column) -> DataFrame:
    """All and open alerts of each location, 0 where there are none."""
    n = alerts.groupBy("watch_id").agg(F.count("*").alias("alerts"), F.count_if(~acknowledged).alias("open_alerts"))
    out = watchlist.select("watch_id", "name").join(n, "watch_id", "left")
    return out.select("watch_id", "name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("alerts", "open_alerts")])


def footprint_pairs(scenes: DataFrame, cell: float = 2.0) -> DataFrame:
    """Ordered pairs of different scenes of one sensor with intersecting footprints, and how much they overlap.
    Rows are dealt out by sensor and cell, so a sensor of very many scenes is as many groups as it covers cells."""
    both = box_join(scenes, scenes, cell, F.col("l.scene_id") != F.col("r.scene_id"), ("sensor",))
    return both.select(
        F.col("l.scene_id").alias("scene_id"),
        F.col("r.scene_id").alias("other_id"),
        F.col("l.acquired").alias("acquired"),
        F.col("r.acquired").alias("other_acquired"),
        S.overlap_fraction(S.box("l."), S.box("r.")).alias("overlap"),
    )


def pair_plan(scenes: DataFrame, subjects: DataFrame | None = None, cell: float = 2.0, near: int = 8, grow: int = 4) -> DataFrame:
    """For each scene the nearest earlier and the nearest later scene of its sensor with enough overlap; with
    subjects (scene_id) for those alone. One date never pairs; ties go to the smaller id.

    A scene looks in its own span of days and the two beside it, which hold the nearest one if they hold any; what is
    not found is looked for in spans `grow` times as long, the last of which hold everything. The first span has about
    `near` scenes of a place, so that work grows with scenes near in time and not with the square of all revisits."""
    rows = scenes.select("scene_id", "sensor", "acquired", *S.BOX, F.unix_date(F.col("acquired").cast("date")).alias("day"))
    place = F.struct("sensor", F.floor(F.col("min_x") / cell).alias("x"), F.floor(F.col("min_y") / cell).alias("y"))
    n, first, last, places = rows.agg(F.count("day"), F.min("day"), F.max("day"), F.approx_count_distinct(place)).first()
    span = last - first + 1 if n else 1
    days = max(1, near * span * places // n) if n else 1
    todo = rows if subjects is None else rows.join(subjects.select("scene_id").distinct(), "scene_id", "left_semi")
    todo = todo.withColumns({"ask_before": F.lit(True), "ask_after": F.lit(True)})
    before = F.col("l.ask_before") & (F.col("r.acquired") < F.col("l.acquired"))
    after = F.col("l.ask_after") & (F.col("r.acquired") > F.col("l.acquired"))
    other = (F.col("l.scene_id") != F.col("r.scene_id")) & (S.overlap_fraction(S.box("l."), S.box("r.")) >= P.min_overlap)
    best_before = F.max(F.when(before, F.struct(F.col("r.acquired").alias("d"), (-F.col("r.scene_id")).alias("k"))))
    best_after = F.min(F.when(after, F.struct(F.col("r.acquired").alias("d"), F.col("r.scene_id").alias("k"))))
    parts = []
    while True:
        own = F.floor(F.col("day") / days)
        around = rows.withColumn("span", F.explode(F.array(own - 1, own, own + 1)))
        both = box_join(todo.withColumn("span", own), around, cell, (before | after) & other, ("sensor", "span"))
        found = both.groupBy(F.col("l.scene_id").alias("scene_id")).agg((-best_before["k"]).alias("before_id"), best_after["k"].alias("after_id"))
        if days >= span:
            parts.append(found)
            break
        parts.append(kept(found))
        todo = todo.join(parts[-1], "scene_id", "left").withColumns({f"ask_{s}": F.col(f"ask_{s}") & F.col(f"{s}_id").isNull() for s in ("before", "after")})
        todo = todo.where("ask_before or ask_after").drop("before_id", "after_id")
        days *= grow
    if len(parts) == 1:
        return parts[0]
    return reduce(DataFrame.union, parts).groupBy("scene_id").agg(*[F.max(c).alias(c) for c in ("before_id", "after_id")])


def planned_jobs(plan: DataFrame) -> DataFrame:
    """Pairs (older, newer) that the plan asks for, each once, whichever scene asked."""
    asked = plan.select(F.explode(F.array(F.struct(F.col("before_id").alias("a"), F.col("scene_id").alias("b")), F.struct(F.col("scene_id").alias("a"), F.col("after_id").alias("b")))).alias("p"))
    return asked.select("p.a", "p.b").where("a is not null and b is not null").distinct().select(F.col("a").alias("scene_a"), F.col("b").alias("scene_b"))


def pair_windows(pairs: DataFrame, scenes: DataFrame) -> DataFrame:
    """The ground that both scenes of a pair show; none where they only touch."""
    sides = []
    for side in "ab":
        sides.append(scenes.select(F.col("scene_id").alias(f"scene_{side}"), *[F.col(c).alias(f"{side}_{c}") for c in (*S.BOX, "acquired")]))
    both = pairs.join(sides[0], "scene_a").join(sides[1], "scene_b")
    a, b = S.box("a_"), S.box("b_")
    out = both.select("scene_a", "scene_b", F.col("a_acquired").alias("date_a"), F.col("b_acquired").alias("date_b"), *[(F.greatest if c.startswith("min") else F.least)(a[c], b[c]).alias(c) for c in S.BOX])
    return out.where("min_x < max_x and min_y < max_y")


def seed_tile(candidates: DataFrame, tiles: DataFrame, cell: float = 2.0) -> DataFrame:
    """Of the tiles that meet a candidate, the one that holds its centre, then the one that shares most; ties go to
    the smaller id. A tile that neither holds the centre nor shares ground is none."""
    pairs = box_join(candidates, tiles, cell)
    a, b = S.box("l."), S.box("r.")
    holds = S.contains(b, (a["min_x"] + a["max_x"]) / 2, (a["min_y"] + a["max_y"]) / 2)
    shared = F.round(S.shared_area(a, b), 6)
    ranked = pairs.where(holds | (shared > 0)).select(F.col("l.candidate_id").alias("candidate_id"), F.struct(holds.alias("h"), shared.alias("s"), (-F.col("r.tile_id")).alias("t")).alias("k"))
    best = ranked.groupBy("candidate_id").agg(F.max("k").alias("k"))
    return best.select("candidate_id", (-F.col("k.t")).alias("tile_id"), F.col("k.h").alias("holds_centre"), F.col("k.s").alias("shared"))


def analysed_area(windows: DataFrame) -> DataFrame:
    """Hull and dates of the pairs' common ground."""
    return windows.agg(
        F.count("*").alias("pairs"),
        F.min("date_a").alias("first_date"),
        F.max("date_b").alias("last_date"),
        *[F.round((F.min if c.startswith("min") else F.max)(c), 6).alias(c) for c in S.BOX],
    )

"""Change detection over a pixel table of one pair: from validity to merged, scored and named detections."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import alignment, catalog, features, outlines, raster, resampling, summed
from ..operators.resampling import Grid
from ..params import P


@dataclass(frozen=True)
class Detection:
    """status: completed, insufficient_evidence or no_change. trace: what each step found. detections: None unless completed."""

    status: str
    trace: dict[str, float | int | None]
    detections: DataFrame | None


def paired(before: DataFrame, after: DataFrame, own: Grid, other: Grid, bands: tuple[str, ...] = raster.BANDS, mask: str = "scl") -> tuple[DataFrame, dict]:
    """The pixel table of two single dates (r, c, bands and perhaps a mask): where the grids aren't one, the later
    date is put on the earlier one's, bands bilinear and the mask by the nearest pixel. Pixels of the earlier date that the
    later one doesn't cover have no data on it."""
    has = mask in before.columns and mask in after.columns
    names = [*bands, *([mask] if has else [])]
    matched = own.same(other)
    if not matched:
        after = resampling.on_grid(after, list(bands), other, own, mask if has else None)
    a = before.select("r", "c", *[F.col(n).alias(f"{n}_a") for n in names])
    b = after.select("r", "c", *[F.col(n).alias(f"{n}_b") for n in names])
    return a.join(b, ["r", "c"], "left"), {"grid_matched": matched} | ({} if matched else {"regridded": True, "scl_resampling": "nearest"})


def same_tile(scene_a: str, scene_b: str, own: Grid, other: Grid) -> bool:
    """Nothing is estimated for scenes whose names have one tile and whose grids are one; a tile's name alone isn't
    trusted."""
    found = [re.search(r"(?:^|[_\-.])T(\d{2}[C-HJ-NP-X][A-Z]{2})(?=$|[_\-.])", s or "") for s in (scene_a, scene_b)]
    return all(found) and found[0][1] == found[1][1] and own.same(other)


def aligned(pixels: DataFrame, height: int, width: int) -> tuple[DataFrame | None, dict]:
    """The pixels with date b put on date a, and what was found: by correlation, and where that is refused by
    features; None where neither registers the pair."""
    ok = raster.validity(pixels, "a") & raster.validity(pixels, "b")
    own = raster.bands_of(pixels)
    band = {d: F.col(f"b08_{d}").cast("double") if "b08" in own else sum((F.col(f"{b}_{d}") for b in own), F.lit(0.0)) / len(own) for d in "ab"}
    pair = pixels.select(F.lit(0).cast("long").alias("pair_id"), "r", "c", band["a"].alias("a"), band["b"].alias("b"), ok.alias("valid"))
    factor = alignment.decimation(height, width)
    pair = raster.kept(alignment.decimated(pair, factor))
    got = alignment.register(pair, factor, decimate=False).first()
    trace = {"alignment": got["status"], "method": "ecc", "rho": got["rho"], "max_shift_px": got["max_shift"], "quality": min(max(got["rho"], 0.0), 1.0)}
    if got["status"] == "identity":
        return pixels, trace
    if got["status"] == "aligned":
        matrix = raster.turn(got["angle"], got["dx"], got["dy"], height, width)
    else:
        refused = f"rho {got['rho']:.3f}, largest shift {got['max_shift']:.1f}px"
        got = features.register(pair, factor).first()
        trace = {"alignment": got["status"], "method": "orb", "rho": None, "ecc_failure": refused, "matches": got["matches"], "inlier_ratio": got["inlier_ratio"], "max_shift_px": got["max_shift"], "quality": got["inlier_ratio"], "reason": got["reason"]}
        if got["status"] == "alignment_failed":
            return None, trace
        if got["max_shift"] < alignment.IDENTITY:
            return pixels, trace
        matrix = np.array(got["matrix"]).reshape(3, 3)
    names = [f"{b}_b" for b in own]
    mask = "scl_b" if "scl_b" in pixels.columns else None
    source = pixels.select("r", "c", *[F.when(F.col(n) != 0, F.col(n)).alias(n) for n in names], *([mask] if mask else []))
    moved = raster.warped(source, names, matrix, height, width, mask)
    return pixels.drop(*names, *([mask] if mask else [])).join(moved, ["r", "c"], "left"), trace


def normalised(pixels: DataFrame) -> tuple[DataFrame, dict]:
    """Date b on the scale of date a, all bands by the pixels that change least over all of them."""
    own = raster.bands_of(pixels)
    ok = pixels.where(raster.validity(pixels, "a") & raster.validity(pixels, "b"))
    fit = raster.invariant_fit(ok, [(f"{b}_a", f"{b}_b") for b in own])
    trace = {"tier": fit.tier, "pif_pixels": fit.n, "pif_threshold": fit.threshold, "iterations": fit.iterations, "slope": fit.slope, "intercept": fit.intercept, "initial_slope": fit.initial, "notes": fit.notes}
    lines = {f"{b}_b": F.col(f"{b}_b") * F.lit(s) + F.lit(o) for b, s, o in zip(own, fit.slope, fit.intercept, strict=True)}
    # No data stays no data, and what has data doesn't become none.
    return pixels.withColumns({n: F.when(F.col(n) != 0, F.when(x == 0, 1e-6).otherwise(x)).otherwise(F.col(n)) for n, x in lines.items()}), trace


def detect(pixels: DataFrame, width: int, same_tile: bool = True, normalise: bool = True, cloud_trust: float = 1.0, pixel_ha: float | None = 0.01, min_px: int = P.min_blob_px, levels: tuple[int, ...] = (*P.large_dilations, *P.near_dilations), chunk: int = raster.CHUNK, scale: float = 10000.0, offsets: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0), grid: Grid | None = None) -> Detection:
    """R20, R21 and the steps before them, in the order in which they must run: coverage, alignment unless both scenes
    are of one tile and grid, coverage again, the radiometric fit, the difference; groups before ranks, as the pool of
    ranks is one peak a group, of blobs with little valid ground too, which are dropped afterwards; the floor on
    confidence after merging. pixel_ha: hectares of a pixel, null where the grid is not in metres. cloud_trust: see
    scalar.job_trust. scale, offsets: see raster.pixel_features. grid: where the pixels lie; with it
    detections have their boxes, outlines with holes, centres and grid references on the ground. The driver sees a few numbers a step."""
    def covered(px: DataFrame) -> tuple[int, float, int]:
        n, valid, height = px.agg(F.count("*"), F.count_if(raster.validity(px, "a") & raster.validity(px, "b")), F.max("r") + 1).first()
        return n, valid / n if n else 0.0, height or 0

    n, coverage, height = covered(pixels)
    trace: dict[str, float | int | str | None] = {"pixels": n, "mutual_coverage": coverage}
    if coverage < P.min_coverage:
        return Detection("insufficient_evidence", trace, None)
    quality = P.same_tile_quality
    if not same_tile:
        pixels, found = aligned(pixels, height, width)
        trace |= found
        if pixels is None:
            return Detection("alignment_failed", trace, None)
        pixels = raster.kept(pixels)
        quality = found["quality"]
        coverage = covered(pixels)[1]
    trace["mutual_coverage_after_alignment"] = coverage
    if coverage < P.min_coverage:
        return Detection("insufficient_evidence", trace, None)
    if normalise:
        pixels, found = normalised(pixels)
        trace |= found
    px = raster.kept(raster.pixel_features(pixels, scale, offsets))  # read by every step below
    low, high, threshold = raster.two_means(px, "diff").first()
    trace |= {"low": low, "high": high, "threshold": threshold}
    if threshold is None:
        return Detection("no_change", trace, None)
    raw = px.where(F.col("diff") > threshold).select("r", "c")
    cleaned = raster.opened_closed(raw, height, width, chunk).join(px.where("valid").select("r", "c"), ["r", "c"], "left_semi")
    labels = raster.labelled(cleaned, width, chunk)
    blobs = raster.blob_stats(labels, min_px)
    labels = raster.kept(labels.join(blobs.select("label"), "label", "left_semi"))
    groups = raster.kept(raster.groups(labels, height, width, levels, chunk))
    means = labels.join(px.select("r", "c", "diff"), ["r", "c"]).groupBy("label").agg(F.avg("diff").alias("mean_diff"))
    blobs = raster.blob_stats(labels, min_px)
    rows = blobs.join(means, "label").join(groups, "label").join(summed.box_coverage(px.where("valid"), blobs, height, width), "label")
    ranked = raster.cluster_pool_rank(rows, "group", "mean_diff").where(F.col("coverage") >= P.candidate_coverage)
    confidence = S.confidence(F.lit(quality), F.col("cluster_pct"), F.col("coverage"), F.lit(cloud_trust))
    named = raster.blob_classes(px, labels)
    # Without the bands that classes need, no direction is claimed.
    known = F.lit(len(raster.bands_of(pixels)) == len(raster.BANDS))
    named = named.select("label", F.col("dndvi").alias("mean_dndvi"), F.when(known, F.col("direction")).alias("direction"), F.when(known, F.col("change_type")).otherwise("unclassified").alias("change_type"), F.when(known, raster.direction_evidence()).alias("evidence"))
    members = ranked.join(named, "label").select(
        F.col("label").alias("candidate_id"),
        "group",
        "dilation_px",
        confidence.alias("confidence"),
        "area_px",
        (F.col("area_px") * F.lit(pixel_ha).cast("double")).alias("area_ha"),
        "mean_dndvi",
        F.col("min_c").cast("double").alias("min_x"),
        F.col("min_r").cast("double").alias("min_y"),
        (F.col("max_c") + 1).cast("double").alias("max_x"),
        (F.col("max_r") + 1).cast("double").alias("max_y"),
        "direction",
        "change_type",
        "evidence",
    )
    merged = catalog.merged(members, "group").withColumnRenamed("lead_id", "candidate_id")
    # The outline and centre of the undilated pixels of a detection; the evidence is that of its lead.
    labels = labels.join(members.select(F.col("candidate_id").alias("label")), "label", "left_semi")
    own = labels.join(groups.select("label", "group"), "label")
    centre = own.groupBy("group").agg((F.avg("c") + 0.5).alias("centre_x"), (F.avg("r") + 0.5).alias("centre_y"))
    traced = raster.kept(outlines.rings(labels, width, chunk))
    rings = traced.where("not hole").join(groups.select("label", "group"), "label").groupBy("group").agg(F.array_sort(F.collect_list("ring")).alias("outline"))
    merged = merged.join(members.select("candidate_id", "evidence"), "candidate_id").join(centre, "group").join(rings, "group").withColumn("_job", F.lit(0))
    if grid:
        merged = outlines.located(merged.join(outlines.geometries(traced, groups, grid), "group"), grid)
    kept = catalog.area_capped(raster.kept(merged), "_job", P.store_cap, P.area_reserve).drop("_job", "reserved", "place_in_job")
    return Detection("completed", trace, kept)


def raw_detect(pixels: DataFrame, width: int, min_px: int = P.min_blob_px, chunk: int = raster.CHUNK, scale: float = 10000.0) -> DataFrame:
    """What the same pixels give with every safeguard off: all pixels count, and blobs are neither merged nor scored."""
    diff = F.abs(F.col("b08_b") - F.col("b08_a")) / F.lit(scale)
    rows = pixels.select("r", "c", diff.alias("diff"))
    height = (rows.agg(F.max("r")).first()[0] or 0) + 1
    threshold = raster.two_means(rows, "diff").first()["threshold"]
    raw = rows.where(F.col("diff") > threshold if threshold is not None else F.lit(False)).select("r", "c")
    blobs = raster.blob_stats(raster.labelled(raster.opened_closed(raw, height, width, chunk), width, chunk), min_px)
    return blobs.orderBy(F.desc("area_px"), F.asc("label")).limit(P.store_cap)

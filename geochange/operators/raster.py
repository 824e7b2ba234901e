"""Raster operators on pixel tables (r, c, ...): built-in functions, and Arrow functions only for whole neighbourhoods."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..params import P
from . import resampling

#: Rows and columns of a chunk for neighbourhood work; a task holds one chunk and its halo.
CHUNK = 1024


BANDS = ("b02", "b03", "b04", "b08")

#: What a reflectance of 1 is in a raster of a type; in any other 1.
DN_SCALE = {"uint16": 10000.0, "uint8": 255.0}


def dn_scale(dtype: str) -> float:
    """F15."""
    return DN_SCALE.get(dtype, 1.0)


def validity(pixels: DataFrame, date: str) -> Column:
    """R1 of one date: a band of 0 or null has no data; without a mask column only that counts."""
    data = reduce(lambda x, y: x & y, [F.coalesce(F.col(f"{b}_{date}") != 0, F.lit(False)) for b in bands_of(pixels)])
    return data & F.coalesce(S.valid_scl(F.col(f"scl_{date}")), F.lit(True)) if f"scl_{date}" in pixels.columns else data


def bands_of(pixels: DataFrame) -> tuple[str, ...]:
    """The bands that a pixel table has of both dates."""
    return tuple(b for b in BANDS if f"{b}_a" in pixels.columns and f"{b}_b" in pixels.columns)


def pixel_features(pixels: DataFrame, scale: float = 10000.0, offsets: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)) -> DataFrame:
    """R1, R12, F13-F17 in one pass: validity of both dates, and where both are valid the difference, dNDVI, class of each
    date and brightness gain; null elsewhere. A pixel is valid on a date if its mask's class is, or there is no mask, and
    every band has data. The difference is of the NIR band; where the table lacks one, of the mean of the bands that it
    has, and then there are no classes, dNDVI and gain. scale: numbers of a band that are a reflectance of 1 (see
    dn_scale); offsets: of each band, added before the division (they cancel out in a difference)."""
    own = bands_of(pixels)
    refl = {f"{b}_{d}": (F.col(f"{b}_{d}") + F.lit(offsets[BANDS.index(b)])) / F.lit(scale) for b in own for d in "ab"}
    valid = validity(pixels, "a") & validity(pixels, "b")
    out = pixels.withColumn("valid", valid)
    if "b08" in own:
        change = (F.col("b08_b") - F.col("b08_a")) / F.lit(scale)
    else:
        change = sum((F.col(f"{b}_b") - F.col(f"{b}_a") for b in own), F.lit(0.0)) / F.lit(scale * len(own))
    found = {"diff": F.abs(change)}
    if len(own) == len(BANDS):
        ndvi = {d: S.ratio(refl[f"b08_{d}"], refl[f"b04_{d}"]) for d in "ab"}
        ndwi = {d: S.ratio(refl[f"b03_{d}"], refl[f"b08_{d}"]) for d in "ab"}
        light = {d: S.brightness(refl[f"b02_{d}"], refl[f"b03_{d}"], refl[f"b04_{d}"]) for d in "ab"}
        found |= {"dndvi": ndvi["b"] - ndvi["a"]} | {f"class_{d}": S.pixel_class(ndvi[d], ndwi[d]) for d in "ab"} | {"gain": S.brightness_gain(light["a"], light["b"])}
    else:
        found |= {"dndvi": F.lit(None).cast("double"), "class_a": F.lit(None).cast("string"), "class_b": F.lit(None).cast("string"), "gain": F.lit(None).cast("double")}
    return out.select("r", "c", "valid", *[F.when(F.col("valid"), x).alias(k) for k, x in found.items()])


def scene_stats(pixels: DataFrame, scl: str) -> DataFrame:
    """A10: shares of valid, cloud, snow and missing pixels; the first three among pixels with data."""
    c = F.col(scl)
    data = F.count_if(c != 0)
    share = lambda cond: F.when(data > 0, F.count_if(cond) / data)
    return pixels.agg(
        F.count("*").alias("pixels"),
        F.round(share(S.valid_scl(c)), 6).alias("valid"),
        F.round(share(c.isin(*P.cloud_scl)), 6).alias("cloud"),
        F.round(share(c == P.snow_scl), 6).alias("snow"),
        F.round(F.count_if(c == 0) / F.count("*"), 6).alias("nodata"),
    )


def cloud_trust(stats: DataFrame) -> DataFrame:
    """one less the share of invalid pixels."""
    return stats.select("pixels", (1 - F.col("nodata") - (1 - F.col("nodata")) * (1 - F.col("valid"))).alias("cloud_trust"))


def decimated(pixels: DataFrame, factor: int, values: list[str], valid: Column) -> DataFrame:
    """Block means, and whether all of a block is valid."""
    return pixels.groupBy(F.floor(F.col("r") / factor).alias("r"), F.floor(F.col("c") / factor).alias("c")).agg(*[F.avg(v).alias(v) for v in values], F.bool_and(valid).alias("valid"))


def crops(pixels: DataFrame, size: int, valid: Column, value: str) -> DataFrame:
    """Whole windows of size x size pixels with enough valid ones; partial windows at the edges are none."""
    out = pixels.groupBy(F.floor(F.col("r") / size).alias("tile_r"), F.floor(F.col("c") / size).alias("tile_c")).agg(F.count("*").alias("n"), F.avg(valid.cast("double")).alias("valid"), F.avg(value).alias("mean"))
    return out.where((F.col("n") == size * size) & (F.col("valid") >= P.crop_valid)).drop("n")


def regression(pixels: DataFrame, a: str, b: str) -> DataFrame:
    """Slope and intercept of a on b from sums; identity where b hardly varies or the slope is out of range."""
    slope, cut = F.regr_slope(a, b), F.regr_intercept(a, b)
    ok = (F.var_pop(b) > 1e-9) & slope.between(*P.pif_slope)
    return pixels.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count("*").alias("n"), F.when(ok, slope).otherwise(1.0).alias("slope"), F.when(ok, cut).otherwise(0.0).alias("intercept"))


@dataclass(frozen=True)
class Fit:
    """tier: pif, or identity where there was too little to fit; notes: why, or which bands stay as they are."""

    slope: tuple[float, ...]
    intercept: tuple[float, ...]
    n: int
    threshold: float
    tier: str
    iterations: int = 0
    initial: tuple[float, ...] | None = None
    notes: tuple[str, ...] = ()


def _band_sums(rows: DataFrame, pairs: list[tuple[str, str]]) -> tuple[int, list[tuple[float, ...]]]:
    """Of all bands in one pass: the number of rows, and each band's sums of a, b, b * b and a * b."""
    own = [F.sum(x.cast("double")) for a, b in pairs for x in (F.col(a), F.col(b), F.col(b) * F.col(b), F.col(a) * F.col(b))]
    n, *sums = rows.agg(F.count("*"), *own).first()
    return n, [tuple(sums[4 * i : 4 * i + 4]) for i in range(len(pairs))]


def _solved(n: int, sums: list[tuple[float, ...]]) -> tuple[tuple[float, ...], tuple[float, ...], tuple[str, ...]]:
    """A line for each band from its sums; a band hardly varies, or has a gain that can't be, stays as it is."""
    slope, intercept, notes = [], [], []
    low, high = P.pif_slope
    for i, (a, b, bb, ab) in enumerate(sums, 1):
        var, cov = bb / n - (b / n) ** 2, ab / n - a / n * (b / n)
        gain = cov / var if var > 1e-9 else None
        fine = gain is not None and low <= gain <= high
        if not fine:
            notes.append(f"band {i}: PIF pixels have no variance; left unchanged" if gain is None else f"band {i}: fitted gain {gain:.3f} outside [{low}, {high}]; left unchanged")
        slope.append(gain if fine else 1.0)
        intercept.append(a / n - gain * b / n if fine else 0.0)
    return tuple(slope), tuple(intercept), tuple(notes)


def invariant_fit(pixels: DataFrame, pairs: list[tuple[str, str]], rows: int = P.strip_rows, strips: int = P.pif_strips) -> Fit:
    """Lines that put each pair's second band on the scale of its first, all bands at once.

    The first lines are fitted to all pixels, without a choice among them; then twice the fifth with the least residual is
    kept, the mean over the bands of what a pixel is off its line, and fitted again, until no gain moves. The first lines and
    the residuals' quantile are of the pixels in every so-many-th strip of `rows` rows, about `strips` of them (all in a
    raster of fewer), the fits that count of all. pixels: (r, and the bands), valid ones. The driver sees the sums of a pass.
    """
    k = len(pairs)
    own = pixels.select("r", *dict.fromkeys(c for p in pairs for c in p)).na.drop()
    one = (1.0,) * k, (0.0,) * k

    def identity(reason: str, n: int = 0, threshold: float = 0.0) -> Fit:
        return Fit(*one, n, threshold, "identity", notes=(reason,))

    strip = F.floor(F.col("r") / rows)
    held = own.groupBy(strip.alias("s")).agg(F.count("*").alias("n")).orderBy("s").collect()  # a row a strip
    if sum(x["n"] for x in held) < P.pif_min_pixels:
        return identity("too few valid pixels")
    step = max(1, len(held) // strips)
    sample = own if step == 1 else own.where(strip.isin([x["s"] for x in held[::step]]))
    n, sums = _band_sums(sample, pairs)
    if n < P.pif_min_pixels:
        return identity(f"only {n} valid pixels to fit", n)
    slope, intercept, notes = _solved(n, sums)
    initial, cut, done = tuple(round(x, 5) for x in slope), 0.0, 0
    for i in range(P.pif_iterations):
        off = [F.abs(F.col(a) - (F.col(b) * s + o)) for (a, b), s, o in zip(pairs, slope, intercept, strict=True)]
        residual = reduce(lambda x, y: x + y, off) / k
        cut = quantiles(sample, residual, (P.pif_percentile,))[0]
        m, sums = _band_sums(own.where(residual <= cut), pairs)
        if m < P.pif_min_pixels:
            return identity(f"only {m} pseudo-invariant pixels", m, cut)
        again, intercept, notes = _solved(m, sums)
        still = all(abs(x - y) <= P.pif_tolerance + 1e-5 * abs(y) for x, y in zip(again, slope, strict=True))
        slope, n, done = again, m, i + 1
        if still:
            break
    return Fit(slope, intercept, n, cut, "pif", done, initial, notes)


def two_means(values: DataFrame, value: str, least: float = P.min_magnitude, bins: int = 1 << 14) -> DataFrame:
    """The two classes of a number with the least sum of squares. low, high: their means; threshold: the mean of the
    two, null where all values are alike or the class of change, the higher one, has a mean under `least`.

    One pass counts and adds up the values in bins, whatever their number; the best cut between bins is the start of exact
    passes over the values, each of which sends back two means, until these stay."""
    v = F.col(value)
    lo, hi = values.agg(F.min(v), F.max(v)).first()
    if lo is None or hi - lo < 1e-9:
        return values.sparkSession.createDataFrame([(None if lo is None else float(lo), None if hi is None else float(hi), None)], "low double, high double, threshold double")
    place = F.least(F.floor((v - F.lit(float(lo))) / F.lit((float(hi) - float(lo)) / bins)), F.lit(bins - 1))
    rows = values.where(v.isNotNull()).groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.sum(v.cast("double")).alias("s")).orderBy("b").toPandas()  # at most `bins` rows
    n, s = rows["n"].to_numpy(float).cumsum(), rows["s"].to_numpy(float).cumsum()
    between = s[:-1] ** 2 / n[:-1] + (s[-1] - s[:-1]) ** 2 / (n[-1] - n[:-1])
    at = int(between.argmax())
    low, high = s[at] / n[at], (s[-1] - s[at]) / (n[-1] - n[at])
    for _ in range(100):
        near = v <= F.lit((low + high) / 2)
        a, b = values.agg(F.avg(F.when(near, v)), F.avg(F.when(~near, v))).first()
        done = abs(a - low) < 1e-12 and abs(b - high) < 1e-12
        low, high = float(a), float(b)
        if done:
            break
    return values.sparkSession.createDataFrame([(low, high, (low + high) / 2 if high >= least else None)], "low double, high double, threshold double")


def quantiles(rows: DataFrame, value: Column | str, shares: tuple[float, ...], buckets: int = 256) -> list[float | None]:
    """Exact quantiles of all values, between neighbours in proportion; null for none.

    Values are counted before the shuffle. The counts of sampled ranges, `buckets` rows, tell the driver in which range
    a wanted place lies, and only the values of that range are put in order."""
    v = F.col(value) if isinstance(value, str) else value
    counts = kept(rows.select(v.cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n")))
    cuts = sorted(set(counts.approxQuantile("v", [i / buckets for i in range(1, buckets)], 0.2 / buckets)))
    bucket = F.aggregate(F.array(*[F.lit(x) for x in cuts]), F.lit(0), lambda k, x: k + (F.col("v") >= x).cast("int")) if cuts else F.lit(0)
    sums = sorted(tuple(x) for x in counts.groupBy(bucket.alias("b")).agg(F.sum("n")).collect())
    total = sum(n for _, n in sums)
    if not total:
        return [None for _ in shares]
    wanted = sorted({i for s in shares for i in (math.floor((total - 1) * s), math.ceil((total - 1) * s))})
    found, before = {}, 0
    for b, n in sums:
        here = [i for i in wanted if before <= i < before + n]
        if here:
            upto = F.sum("n").over(Window.orderBy("v")) + before  # over one range of values
            placed = counts.where(bucket == b).withColumn("upto", upto)
            for i in here:
                found[i] = placed.where(F.col("upto") > i).agg(F.min("v")).first()[0]
        before += n
    out = []
    for s in shares:
        at = (total - 1) * s
        low, high = found[math.floor(at)], found[math.ceil(at)]
        out.append(low + (high - low) * (at - math.floor(at)))
    return out


def _dealt(rows: DataFrame, halo: int, chunk: int) -> DataFrame:
    """Marked pixels for each chunk whose halo they lie in: (r, c, cr, cc)."""
    span = F.sequence(F.floor((F.col("r") - halo) / chunk), F.floor((F.col("r") + halo) / chunk))
    wide = F.sequence(F.floor((F.col("c") - halo) / chunk), F.floor((F.col("c") + halo) / chunk))
    return rows.select("r", "c", F.explode(span).alias("cr"), wide.alias("w")).select("r", "c", "cr", F.explode("w").alias("cc"))


def opened_closed(rows: DataFrame, height: int, width: int, chunk: int = CHUNK) -> DataFrame:
    """Opening, then closing, with a square of 3; what is outside the raster doesn't count. One shuffle: each chunk
    gets the pixels around it up to the four steps' reach, and takes all of them on a dense array."""
    halo = 4

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["cr"].iloc[0]) * chunk - halo, int(pdf["cc"].iloc[0]) * chunk - halo
        size = chunk + 2 * halo
        mark = np.zeros((size, size), dtype=bool)
        mark[pdf["r"].to_numpy() - r0, pdf["c"].to_numpy() - c0] = True
        y, x = np.arange(size) + r0, np.arange(size) + c0
        outside = ~((y >= 0) & (y < height))[:, None] | ~((x >= 0) & (x < width))[None, :]

        def step(m: np.ndarray, all_of: bool) -> np.ndarray:
            """Of each pixel's three rows, then columns: whether all, or any, are marked."""
            m = m | outside if all_of else m & ~outside
            join = np.logical_and if all_of else np.logical_or
            for axis in (0, 1):
                p = np.pad(m, [(1, 1) if k == axis else (0, 0) for k in (0, 1)], constant_values=all_of)
                a, b, c = (p[i : i + size] if axis == 0 else p[:, i : i + size] for i in range(3))
                m = join(join(a, b), c)
            return m & ~outside

        out = step(step(step(step(mark, True), False), False), True)
        y, x = np.nonzero(out[halo:-halo, halo:-halo])
        return pd.DataFrame({"r": y.astype(np.int64) + r0 + halo, "c": x.astype(np.int64) + c0 + halo})

    return _dealt(rows, halo, chunk).groupBy("cr", "cc").applyInPandas(work, "r long, c long")


def _label_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
    """4-connected components of one chunk by runs in rows and union-find over the runs; a label is the least pixel number."""
    pdf = pdf.sort_values(["r", "c"], ignore_index=True)
    r, c, number = (pdf[k].to_numpy() for k in ("r", "c", "number"))
    new = np.ones(len(r), dtype=bool)
    new[1:] = (np.diff(r) != 0) | (np.diff(c) != 1)
    run = np.cumsum(new) - 1
    start, end = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(r)) - 1
    to = np.arange(len(start))

    def root(i: int) -> int:
        while to[i] != i:
            to[i] = to[to[i]]
            i = to[i]
        return i

    above, this = 0, 0
    while this < len(start):  # two rows of runs at a time, both in order of column
        while above < this and (r[start[above]] < r[start[this]] - 1 or (r[start[above]] == r[start[this]] - 1 and c[end[above]] < c[start[this]])):
            above += 1
        k = above
        while k < this and r[start[k]] == r[start[this]] - 1 and c[start[k]] <= c[end[this]]:
            a, b = root(k), root(this)
            if a != b:
                to[max(a, b)] = min(a, b)
            k += 1
        this += 1
    roots = np.array([root(i) for i in range(len(start))], dtype=np.int64)
    first = number[start]
    least = np.full(len(start), np.iinfo(np.int64).max)
    np.minimum.at(least, roots, first)
    pdf["local"] = least[roots[run]]
    return pdf[["r", "c", "local"]]


def labelled(rows: DataFrame, width: int, chunk: int = CHUNK) -> DataFrame:
    """4-connected components of marked pixels (r, c). label is the least r * width + c in the component.

    Chunks are labelled apart; what the seams between them join is a small graph on labels, settled by passing on the
    least label and that of the label itself, until no label moves: rounds grow with the logarithm of the chunks that a
    component crosses.
    """
    numbered = rows.withColumn("number", F.col("r") * width + F.col("c")).withColumn("cr", F.floor(F.col("r") / chunk)).withColumn("cc", F.floor(F.col("c") / chunk))
    local = numbered.groupBy("cr", "cc").applyInPandas(lambda pdf: _label_chunk(pdf), "r long, c long, local long")
    local = kept(local)
    edge = local.where((F.col("r") % chunk).isin(0, chunk - 1) | (F.col("c") % chunk).isin(0, chunk - 1))
    other = edge.select(F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("local").alias("local2"))
    near = edge.select("local", F.explode(F.array(F.struct((F.col("r") + 1).alias("r2"), F.col("c").alias("c2")), F.struct(F.col("r").alias("r2"), (F.col("c") + 1).alias("c2")))).alias("p")).select("local", "p.*")
    seams = near.join(other, ["r2", "c2"]).where("local <> local2").select(F.col("local").alias("u"), F.col("local2").alias("v")).distinct()
    both = kept(seams.union(seams.select("v", "u")))
    if not both.limit(1).count():
        return local.select("r", "c", F.col("local").alias("label"))
    labels = kept(both.select(F.col("u").alias("node")).distinct().withColumn("label", F.col("node")))
    while True:
        least = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("m"))
        after = labels.join(least, labels["node"] == least["u"], "left").select("node", F.least("label", "m").alias("label"))
        # Jump: a node takes the label that its label has by now.
        jump = after.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = kept(after.join(jump, "label", "left").select("node", F.least("label", "next").alias("label")))
        moved = after.join(labels, ["node", "label"], "left_anti").limit(1).count()
        labels = after
        if not moved:
            break
    return local.join(labels, local["local"] == labels["node"], "left").select("r", "c", F.coalesce("label", "local").alias("label"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; one of this machine only where none is set and the master is local."""
    import tempfile

    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def kept(df: DataFrame) -> DataFrame:
    """Cut from its lineage by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def blob_stats(labels: DataFrame, min_px: int = P.min_blob_px) -> DataFrame:
    """Size, box and centre of each component of enough pixels."""
    out = labels.groupBy("label").agg(
        F.count("*").alias("area_px"),
        F.min("r").alias("min_r"),
        F.max("r").alias("max_r"),
        F.min("c").alias("min_c"),
        F.max("c").alias("max_c"),
        F.round(F.avg("r") + 0.5, 6).alias("centre_r"),
        F.round(F.avg("c") + 0.5, 6).alias("centre_c"),
    )
    return out.where(F.col("area_px") >= min_px)


def ellipse(radius: int) -> list[tuple[int, int]]:
    """For each row from -radius to radius the half width of the ellipse of size 2 * radius + 1."""
    return [(dy, int(np.rint(radius * np.sqrt(1 - dy * dy / (radius * radius)))) if radius else 0) for dy in range(-radius, radius + 1)]


def dilated_ellipse(rows: DataFrame, radius: int, height: int, width: int, chunk: int = CHUNK) -> DataFrame:
    """Dilation by an ellipse. Each chunk gets the marked pixels around it up to the radius, and works on a dense array."""
    dealt = _dealt(rows, radius, chunk)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["cr"].iloc[0]) * chunk, int(pdf["cc"].iloc[0]) * chunk
        size = chunk + 2 * radius
        # Sums of starts and ends of the ellipse's row pieces, a row of offsets at a time.
        mark = np.zeros((size, size), dtype=np.uint8)
        mark[pdf["r"].to_numpy() - r0 + radius, pdf["c"].to_numpy() - c0 + radius] = 1
        sums = np.zeros((size, size + 1), dtype=np.int32)
        np.cumsum(mark, axis=1, out=sums[:, 1:])
        out = np.zeros((chunk, chunk), dtype=bool)
        for dy, dx in ellipse(radius):
            part = sums[radius + dy : radius + dy + chunk]
            out |= part[:, radius + dx + 1 : radius + dx + 1 + chunk] > part[:, radius - dx : radius - dx + chunk]
        y, x = np.nonzero(out)
        found = pd.DataFrame({"r": y.astype(np.int64) + r0, "c": x.astype(np.int64) + c0})
        return found[(found.r >= 0) & (found.r < height) & (found.c >= 0) & (found.c < width)]

    return dealt.groupBy("cr", "cc").applyInPandas(work, "r long, c long")


def groups(labels: DataFrame, height: int, width: int, levels: tuple[int, ...] = (*P.large_dilations, *P.near_dilations), chunk: int = CHUNK) -> DataFrame:
    """(label, group, dilation_px). Blobs belong together where their dilations touch; the widest level whose
    group is acceptable wins: at the wide levels one of enough blobs or pixels, at all levels one of bounded extent and
    size. A blob that no level takes is its own group."""
    blobs = labels.groupBy("label").agg(F.count("*").alias("px"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    out = labels.select("label").distinct()
    for radius in levels:
        zones = labelled(dilated_ellipse(labels.select("r", "c"), radius, height, width, chunk), width, chunk).withColumnRenamed("label", "zone")
        of = labels.join(zones, ["r", "c"]).select("label", "zone").distinct()
        size = of.join(blobs, "label").groupBy("zone").agg(F.count("*").alias("n"), F.sum("px").alias("px"), (F.max("r1") - F.min("r0") + 1).alias("h"), (F.max("c1") - F.min("c0") + 1).alias("w"))
        ok = (F.greatest("h", "w") <= P.group_max_extent) & (F.col("px") <= P.group_max_px) & (F.col("n") > 1)
        if radius in P.large_dilations:
            ok = ok & ((F.col("n") >= P.group_min_blobs) | (F.col("px") > P.group_min_px))
        good = of.join(size.where(ok).select("zone"), "zone").groupBy("zone", "label").count().drop("count")
        lead = good.groupBy("zone").agg(F.min("label").alias(f"g{radius}"))
        out = out.join(good.join(lead, "zone").select("label", f"g{radius}"), "label", "left")
    level = F.coalesce(*[F.when(F.col(f"g{k}").isNotNull(), F.lit(k)) for k in levels], F.lit(0))
    return out.select("label", F.coalesce(*[F.col(f"g{k}") for k in levels], F.col("label")).alias("group"), level.alias("dilation_px"))


def blob_classes(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Per blob the class counts of both dates, the dominant classes (ties: vegetation, water, bare,
    other), means of dNDVI and gain, and the share of valid pixels."""
    kinds = ("vegetation", "water", "bare", "other")
    counts = {f"{k}_{d}": F.count_if(F.col(f"class_{d}") == k).alias(f"{k}_{d}") for k in kinds for d in "ab"}
    out = labels.join(features, ["r", "c"]).groupBy("label").agg(F.count("*").alias("px"), F.avg("dndvi").alias("dndvi"), F.avg("gain").alias("gain"), *counts.values())

    def dominant(d: str) -> Column:
        return F.greatest(*[F.struct(F.col(f"{k}_{d}").alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(kinds)])

    tops = {d: dominant(d) for d in "ab"}
    out = out.withColumns({f"top_{d}": tops[d]["k"] for d in "ab"} | {f"area_{d}": tops[d]["n"] for d in "ab"})
    direction, kind = S.decide(F.col("top_a"), F.col("top_b"), F.col("area_a"), F.col("area_b"), F.col("water_a"), F.col("water_b"), F.col("dndvi"), F.col("gain"))
    return out.withColumns({"direction": direction, "change_type": kind})


def regridded(pixels: DataFrame, value: str, shift_r: float, shift_c: float) -> DataFrame:
    """R3, R9 for a shift: bilinear values of the source at (r + shift_r, c + shift_c); a neighbour with weight that is
    missing or null makes the result null."""
    height, width = pixels.agg(F.max("r") + 1, F.max("c") + 1).first()
    made = resampling.resampled(pixels, [value], lambda r, c: (r + shift_r, c + shift_c), height or 0, width or 0)
    return pixels.select("r", "c").join(made, ["r", "c"], "left")


def stretched(pixels: DataFrame, value: str, lo: float = 0.02, hi: float = 0.98) -> DataFrame:
    """Values between two percentiles put on 0 to 255."""
    low, high = quantiles(pixels, value, (lo, hi))
    low, high = low or 0.0, high or 0.0
    scaled = (F.col(value) - low) / max(high - low, 1e-9) * 255
    return pixels.select("r", "c", F.floor(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(255.0))).cast("int").alias("stretched"))


def upsampled(pixels: DataFrame, value: str) -> DataFrame:
    """Each pixel as two by two, for a mask of half the resolution."""
    four = F.explode(F.array(*[F.struct((F.col("r") * 2 + i).alias("r"), (F.col("c") * 2 + j).alias("c")) for i in (0, 1) for j in (0, 1)])).alias("p")
    return pixels.select(four, value).select("p.r", "p.c", value)


def bounded_sample(pixels: DataFrame, most: int, total: int, seed: int = 0) -> DataFrame:
    """About `most` of `total` pixels, by a hash of their place: the same pixels however often it is read; all of
    them where there are no more."""
    if total <= most:
        return pixels
    return pixels.where(F.xxhash64("r", "c", F.lit(seed)) / F.lit(2.0**64) + 0.5 < most / total)


def turn(angle: float, dx: float, dy: float, height: int, width: int) -> np.ndarray:
    """The matrix of a turn about the raster's centre and a shift, of (column, row)."""
    cy, cx, cos, sin = (height - 1) / 2, (width - 1) / 2, math.cos(angle), math.sin(angle)
    return np.array([[cos, -sin, cx + dx - cos * cx + sin * cy], [sin, cos, cy + dy - sin * cx - cos * cy], [0.0, 0.0, 1.0]])


def warped(pixels: DataFrame, bands: list[str], matrix: np.ndarray, height: int, width: int, mask: str | None = None, chunk: int = resampling.CHUNK) -> DataFrame:
    """Values of the source at each pixel's place through a matrix (see turn): bilinear for bands, of which all
    neighbours with weight must be there, and the nearest pixel for the mask."""
    made = resampling.resampled(pixels, bands, resampling.homography(matrix), height, width, mask, chunk)
    return pixels.select("r", "c").join(made, ["r", "c"], "left")


def mean_ndvi_inside(pixels: DataFrame, labels: DataFrame, date: str, least_valid: float = 0.5) -> DataFrame:
    """(label, ndvi): the mean NDVI of a date over each detection's own pixels, null unless enough are valid."""
    ndvi = S.ratio(F.col(f"b08_{date}") / 10000.0, F.col(f"b04_{date}") / 10000.0)
    of = labels.join(pixels.select("r", "c", validity(pixels, date).alias("ok"), ndvi.alias("ndvi")), ["r", "c"])
    share = F.avg(F.col("ok").cast("double"))
    return of.groupBy("label").agg(F.when(share >= least_valid, F.avg(F.when(F.col("ok"), F.col("ndvi")))).alias("ndvi"))


def direction_evidence() -> Column:
    """what a named direction rests on, from the columns of blob_classes. The sentences of `rule` are fixed values."""
    kinds = ("vegetation", "water", "bare", "other")

    def shares(d: str) -> Column:
        total = F.greatest(sum((F.col(f"{k}_{d}") for k in kinds), F.lit(0)), F.lit(1))
        return F.struct(*[S.py_round(F.col(f"{k}_{d}") / total, 4).alias(k) for k in kinds])

    named, times = F.col("direction"), S.fixed(F.col("area_b") / F.greatest(F.col("area_a"), F.lit(1)), 1)
    rule = (
        F.when(named == "disappearance", F.concat("top_a", F.lit(" became bare")))
        .when((named == "appearance") & (F.col("top_b") == "vegetation"), "vegetation appeared on bare ground")
        .when(named == "appearance", "bare ground became brighter with falling NDVI (SWIR-free built-up proxy)")
        .when(named == "expansion", F.concat("top_a", F.lit(" covers "), times, F.lit("x more of the blob")))
        .when(named == "contraction", F.concat("top_a", F.lit(" covers "), times, F.lit("x of what it did")))
        .otherwise("no direction rule matched")
    )
    return F.struct(F.col("top_a").alias("dominant_a"), F.col("top_b").alias("dominant_b"), shares("a").alias("share_a"), shares("b").alias("share_b"), S.py_round(F.col("dndvi"), 4).alias("delta_ndvi"), S.py_round(F.col("gain"), 4).alias("brightness_gain"), rule.alias("rule"), F.lit(False).alias("swir_available"))


def overview(pixels: DataFrame, value: str, factor: int, categorical: bool = False) -> DataFrame:
    """Block means, or for categories the block's first pixel."""
    if categorical:
        return pixels.where((F.col("r") % factor == 0) & (F.col("c") % factor == 0)).select(F.floor(F.col("r") / factor).alias("r"), F.floor(F.col("c") / factor).alias("c"), value)
    return pixels.groupBy(F.floor(F.col("r") / factor).alias("r"), F.floor(F.col("c") / factor).alias("c")).agg(F.round(F.avg(value), 6).alias(value))


def cluster_pool_rank(blobs: DataFrame, group: str, value: str, buckets: int = 256) -> DataFrame:
    """W2 over a pool of one peak per group: (peaks smaller + peaks not larger) / 2 / peaks.

    Running counts are by distinct value and in two steps, within sampled ranges of value and over the ranges, so no
    window is over all rows and nothing is joined pair by pair.
    """
    cuts = sorted(set(blobs.approxQuantile(value, [i / buckets for i in range(1, buckets)], 0.2 / buckets)))
    bucket = F.aggregate(F.array(*[F.lit(float(x)) for x in cuts]), F.lit(0), lambda n, x: n + (F.col("_v") >= x).cast("int")) if cuts else F.lit(0)
    peaks = blobs.groupBy(group).agg(F.max(value).alias("_v"))
    both = peaks.select("_v", F.lit(1).alias("_p")).union(blobs.select(F.col(value).alias("_v"), F.lit(0).alias("_p"))).groupBy("_v").agg(F.sum("_p").alias("_n")).withColumn("_b", bucket)
    # At most `buckets` rows, so the window over them is small.
    before = both.groupBy("_b").agg(F.sum("_n").alias("_s")).withColumn("_off", F.sum("_s").over(Window.orderBy("_b")) - F.col("_s")).withColumn("_total", F.sum("_s").over(Window.partitionBy()))
    counts = both.withColumn("_in", F.sum("_n").over(Window.partitionBy("_b").orderBy("_v"))).join(F.broadcast(before), "_b")
    upto = F.col("_off") + F.col("_in")
    pct = counts.select("_v", ((2 * upto - F.col("_n")) / 2 / F.col("_total")).alias("cluster_pct"))
    return blobs.join(pct, F.col(value) == F.col("_v")).drop("_v")

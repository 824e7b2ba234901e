"""Column expressions: names and dates, boxes, spectra, flags, scores, rules, text. All stay in generated code."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import CHANGE_TYPES, HINTS, SEASONAL_TYPES, P

# --- names and dates -------------------------------------------------------------------------------------------

#: Sensors in the order in which upper-cased names are tried.
SENSOR_PATTERNS = (
    ("sentinel2", r"S2[AB]?|SENTINEL[-_]?2|MSIL[12][AC]"),
    ("landsat9", r"LC09"),
    ("landsat8", r"LC08|LT0[45]|LE07|LANDSAT"),
    ("liss3", r"LISS[_-]?(3|III)(?![0-9A-Z])"),
    ("bhuvan", r"LISS[_-]?\d|CARTOSAT|BHUVAN"),
)

#: Forms of a date in a name, in order; each has year, month and day as its groups.
DATE_PATTERNS = (
    r"(?:^|[^0-9])(20\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])T\d{6}",
    r"(?:^|[^0-9])(20\d{2})-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])(?![0-9])",
    r"(?:^|[^0-9])(20\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(?![0-9])",
)

#: A grid tile between separators, a product name, a path in a message.
TILE_PATTERN = r"(?:^|[_\-.])T(\d{2}[C-HJ-NP-X][A-Z]{2})(?=$|[_\-.])"
LANDSAT_PATTERN = r"(?i)^(LC0[89])_L2SP_(\d{3})(\d{3})_(\d{8})_(\d{8})_(\d{2})_(T1|T2|RT)"
PATH_PATTERN = r"""(?:[A-Za-z]:[\\/]|/)[^\s'"),;]+"""


def detect_sensor(name: Column) -> Column:
    """the first sensor whose pattern is in a file name of either case, else unknown."""
    return F.coalesce(*[F.when(F.upper(name).rlike(p), F.lit(s)) for s, p in SENSOR_PATTERNS], F.lit("unknown"))


def infer_sensor(bands: Column, projected: Column, res: Column) -> Column:
    """three or four projected bands of 21 to 26 m are LISS-III."""
    return F.when(bands.between(3, 4) & projected & F.abs(res).between(21, 26), F.lit("liss3")).otherwise(F.lit("unknown"))


def acquisition_date(name: Column) -> Column:
    """the date of the first form that is in the name; null where none is, or where it names no day."""
    found = [F.when(name.rlike(p), F.concat_ws("-", *[F.regexp_extract(name, p, i) for i in (1, 2, 3)])) for p in DATE_PATTERNS]
    return F.try_to_date(F.coalesce(*found), "yyyy-MM-dd")


def tile_code(name: Column) -> Column:
    """a grid tile code between separators; null if there is none."""
    return F.nullif(F.regexp_extract(name, TILE_PATTERN, 1), F.lit(""))


def safe_id(name: Column) -> Column:
    """what is no letter, digit, dash, dot or underline, in any script, becomes an underline."""
    return F.regexp_replace(name, r"(?U)[^\w\-_.]", "_")


def landsat_name(name: Column) -> Column:
    """the parts of a product name."""
    keys = ("mission", "path", "row", "acquired", "processed", "collection", "tier")
    return F.when(name.rlike(LANDSAT_PATTERN), F.struct(*[F.regexp_extract(name, LANDSAT_PATTERN, i + 1).alias(k) for i, k in enumerate(keys)]))


def tile_id(scene: Column, col: Column, row: Column) -> Column:
    """F35."""
    return F.format_string("%s_crop_%05d_%05d", scene, col, row)


def spaced_mgrs(ref: Column) -> Column:
    """zone and square, easting and northing apart."""
    digits = F.regexp_extract(ref, r"^\d{1,2}[A-Z]{3}(\d*)$", 1)
    half = (F.length(digits) / 2).cast("int")
    head = F.regexp_extract(ref, r"^(\d{1,2}[A-Z]{3})", 1)
    return F.when((F.length(digits) > 0) & (F.length(digits) % 2 == 0), F.concat_ws(" ", head, F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, half))).otherwise(ref)


def redacted(message: Column) -> Column:
    """paths in an error message go, and what is over 300 characters."""
    return F.left(F.regexp_replace(message, PATH_PATTERN, "<path>"), F.lit(300))


def py_round(x: Column, digits: int) -> Column:
    """the nearest number of that many digits to the exact binary value of a double, ties to even.

    x * 10^digits is taken with what its double lacks of the exact product, so that a product that only looks like a
    tie is none. For products under 2^52."""
    b = float(10**digits)
    p, wide = x * b, x * 134217729.0
    high = wide - (wide - x)
    lacks = (high * b - p) + (x - high) * b
    low = F.floor(p).cast("double")
    tie = (p - low == 0.5) & ((lacks > 0) | ((lacks == 0) & (F.abs(low) % 2 == 1)))
    return (low + F.when((p - low > 0.5) | tie, 1.0).otherwise(0.0)) / b


def season_gap(a: Column, b: Column) -> Column:
    """Days between two dates' places in the year, around the turn of the year; 29 February counts as the 28th."""

    def day(x: Column) -> Column:
        d = F.least(F.dayofmonth(x), F.when(F.month(x) == 2, 28).otherwise(31))
        return F.dayofyear(F.make_date(F.lit(2001), F.month(x), d))

    gap = F.abs(day(a) - day(b))
    return F.least(gap, 365 - gap)


def same_season(prior: Column, current: Column) -> Column:
    """Of an earlier year, and at most the window apart in the year."""
    return (F.year(prior) < F.year(current)) & (season_gap(prior, current) <= P.season_days)


# --- boxes -----------------------------------------------------------------------------------------------------

BOX = ("min_x", "min_y", "max_x", "max_y")


def box(prefix: str = "") -> dict[str, Column]:
    return {k: F.col(f"{prefix}{k}") for k in BOX}


def intersects(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """closed boxes that touch do intersect."""
    return (a["min_x"] <= b["max_x"]) & (a["max_x"] >= b["min_x"]) & (a["min_y"] <= b["max_y"]) & (a["max_y"] >= b["min_y"])


def shared_area(a: dict[str, Column], b: dict[str, Column]) -> Column:
    w = F.least(a["max_x"], b["max_x"]) - F.greatest(a["min_x"], b["min_x"])
    h = F.least(a["max_y"], b["max_y"]) - F.greatest(a["min_y"], b["min_y"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def area(a: dict[str, Column]) -> Column:
    return (a["max_x"] - a["min_x"]) * (a["max_y"] - a["min_y"])


def overlap_fraction(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """What the boxes share, of the smaller; 0 where that has no area."""
    small = F.least(area(a), area(b))
    return F.when(small > 0, shared_area(a, b) / small).otherwise(0.0)


def contains(a: dict[str, Column], x: Column, y: Column) -> Column:
    return x.between(a["min_x"], a["max_x"]) & y.between(a["min_y"], a["max_y"])


def box_around(lon: Column, lat: Column, radius_m: Column) -> dict[str, Column]:
    """F10."""
    dlat = radius_m / 111320.0
    dlon = radius_m / (F.greatest(F.cos(F.radians(lat)), F.lit(0.01)) * 111320.0)
    return {"min_x": lon - dlon, "min_y": lat - dlat, "max_x": lon + dlon, "max_y": lat + dlat}


def display_window(a: dict[str, Column], extent: dict[str, Column]) -> dict[str, Column]:
    """four times the box around its centre, slid into the extent, smaller only where the extent is."""
    out = {}
    for lo, hi in (("min_x", "max_x"), ("min_y", "max_y")):
        size = F.least((a[hi] - a[lo]) * P.display_factor, extent[hi] - extent[lo])
        start = F.least(F.greatest((a[lo] + a[hi]) / 2 - size / 2, extent[lo]), extent[hi] - size)
        out[lo], out[hi] = start, start + size
    return out


# --- spectra, classes, flags -----------------------------------------------------------------------------------


def ratio(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), null where the sum is 1e-6 or less: F13 of NIR and red, F14 of green and NIR."""
    return F.when(a + b > 1e-6, (a - b) / (a + b))


def reflectance(dn: Column, offset: Column, scale: Column) -> Column:
    """F15."""
    return (dn + offset) / scale


def pixel_class(ndvi: Column, ndwi: Column) -> Column:
    """F16: water wins; then bare, vegetation, other. An unknown index fails its test."""
    return F.when(ndwi > 0, "water").when(ndvi < P.ndvi_bare, "bare").when(ndvi > P.ndvi_veg, "vegetation").otherwise("other")


def brightness(b02: Column, b03: Column, b04: Column) -> Column:
    return (b02 + b03 + b04) / 3


def brightness_gain(before: Column, after: Column) -> Column:
    """F17."""
    return (after - before) / F.greatest(before, F.lit(0.01))


def qa_to_scl(qa: Column) -> Column:
    """no data, then cloud, shadow, snow; what is left is clear."""
    return F.when(F.getbit(qa, F.lit(0)) == 1, 0).when(F.getbit(qa, F.lit(3)) == 1, 9).when(F.getbit(qa, F.lit(4)) == 1, 3).when(F.getbit(qa, F.lit(5)) == 1, 11).otherwise(7)


def landsat_dn(dn: Column) -> Column:
    """to the other sensor's numbers, rounded half to even, 1 to 65535; 0 is no data."""
    return F.when(dn == 0, 0).otherwise(F.least(F.greatest(F.rint((dn * 2.75e-5 - 0.2) * 1e4 + 1000), F.lit(1.0)), F.lit(65535.0)).cast("int"))


def valid_scl(scl: Column) -> Column:
    """F20."""
    return scl.isin(*P.valid_scl)


def display_rgb(refl: Column) -> Column:
    """F21 for one band."""
    return F.least(F.greatest(refl / 0.30 * 255, F.lit(1.0)), F.lit(255.0)).cast("int")


# --- scores and rules ------------------------------------------------------------------------------------------


def pixel_area_ha(width_m: Column, height_m: Column, projected: Column) -> Column:
    """hectares of a pixel; null where the grid is not in metres."""
    return F.when(projected, F.abs(width_m * height_m) / 10000.0)


def hectares(area_ha: Column, area_px: Column) -> Column:
    """the recorded area, else that of as many pixels of 10 m."""
    return F.coalesce(area_ha, area_px / 100)


def shown_hectares(area_ha: Column, area_px: Column) -> Column:
    """with one decimal and thousands apart."""
    return F.concat(F.format_number(hectares(area_ha, area_px), 1), F.lit(" ha"))


def job_coverage(details: Column) -> Column:
    """a job's coverage after alignment, else before it, from its details in JSON."""
    return F.coalesce(*[F.get_json_object(details, f"$.{k}").try_cast("double") for k in ("mutual_coverage_after_alignment", "mutual_coverage")])


def ablation_status(recorded: Column, in_flight: Column) -> Column:
    """a recorded run that nothing works on any more was none."""
    return F.when((recorded == "running") & ~in_flight, "not_run").otherwise(F.coalesce(recorded, F.lit("not_run")))


def throughput(done: Column, seconds: Column) -> Column:
    """Pieces a second, null before the first or without a span."""
    return F.when((done > 0) & (seconds > 0), py_round(done / seconds, 2))


#: Zero-based bands by role, of LISS-III and of any other raster of four bands or more.
BAND_ROLES = {"liss3": {"blue": None, "green": 0, "red": 1, "nir": 2}, None: {"blue": 0, "green": 1, "red": 2, "nir": 3}}


def band_role(role: str, sensor: Column, bands: Column) -> Column:
    """the band of a role; null where a raster has under four bands, or the sensor lacks it."""
    named = F.when(sensor.eqNullSafe("liss3"), F.lit(BAND_ROLES["liss3"][role]).cast("int")).otherwise(F.lit(BAND_ROLES[None][role]))
    return F.when(bands >= 4, named)


def cloud_trust(source: Column, invalid: Column, heuristic_pct: Column) -> Column:
    """one less the share of invalid pixels where a mask removed them, one less the estimate where none did."""
    return F.when(source == "heuristic", 1 - F.coalesce(heuristic_pct, F.lit(0.0)) / 100).when(source.isin("scl", "qa_pixel"), 1 - invalid).otherwise(1.0)


def job_trust(source_a: Column, trust_a: Column, source_b: Column, trust_b: Column) -> Column:
    """what a job's confidence takes from its scenes: the least trust of those with an estimate only, else 1."""
    own = [F.when(s == "heuristic", t) for s, t in ((source_a, trust_a), (source_b, trust_b))]
    return F.coalesce(F.least(*own), F.lit(1.0))


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def confidence(alignment: Column, cluster_pct: Column, coverage: Column, cloud_trust: Column) -> Column:
    """F24."""
    return clamp01(P.w_alignment * clamp01(alignment) + P.w_cluster * clamp01(cluster_pct) + P.w_terrain * F.lit(P.terrain) + P.w_coverage * clamp01(coverage) * clamp01(cloud_trust))


def combined_score(pct: Column, conf: Column, hinted: Column) -> Column:
    """F27."""
    return 0.5 * pct + 0.5 * conf + F.when(hinted, P.search_boost).otherwise(0.0)


def normal_type(x: Column) -> Column:
    """Unknown names are unclassified."""
    return F.when(x.isin(*CHANGE_TYPES), x).otherwise("unclassified")


def seasonal_eligible(change_type: Column, dndvi: Column) -> Column:
    """P13."""
    return F.coalesce(change_type.isin(*SEASONAL_TYPES) & (F.abs(dndvi) > P.ndvi_drop), F.lit(False))


def hinted_directions(query: Column) -> Column:
    """directions of which a whole word is in the text."""
    words = F.split(F.lower(query), r"[^\p{L}]+")
    found = [F.when(F.arrays_overlap(words, F.array(*map(F.lit, keys))), F.lit(name)) for name, keys in HINTS.items()]
    return F.array_compact(F.array(*found))


def decide(a: Column, b: Column, area_a: Column, area_b: Column, water_a: Column, water_b: Column, dndvi: Column, gain: Column) -> tuple[Column, Column]:
    """(direction, change_type) of the dominant classes at both dates, their areas, the water pixels, dNDVI and gain."""
    dropped, rose = F.coalesce(dndvi <= -P.dndvi_direction, F.lit(False)), F.coalesce(dndvi >= P.dndvi_direction, F.lit(False))
    built = (a == "bare") & (b == "bare") & dropped & F.coalesce(gain >= P.brightness_gain, F.lit(False))
    direction = (
        F.when(a.isin("vegetation", "water") & (b == "bare"), "disappearance")
        .when((a == "bare") & ((b == "vegetation") | built), "appearance")
        .when((a == b) & (area_a > 0) & (area_b > P.growth * area_a), "expansion")
        .when((a == b) & (area_a > 0) & (area_b < P.shrink * area_a), "contraction")
        .otherwise("unclassified")
    )
    kind = (
        F.when((direction == "disappearance") & (a == "water") & (water_b < water_a), "water_loss")
        .when((direction == "disappearance") & (a == "vegetation") & dropped, "clearance")
        .when((direction == "appearance") & (b == "vegetation") & rose, "revegetation")
        .when((direction == "appearance") & built, "construction")
        .when((direction == "expansion") & (a == "bare"), "urban_expansion")
        .when((direction == "contraction") & (a == "vegetation"), "vegetation_retreat")
        .otherwise("unclassified")
    )
    return direction, kind


def seasonal_verdict(n_clear: Column, mean: Column, std: Column, current: Column) -> tuple[Column, Column]:
    """(status, factor on confidence)."""
    drop = mean - current
    status = F.when((n_clear < P.season_priors) | current.isNull(), "unverified").when(drop <= P.season_sigmas * F.greatest(std, F.lit(P.season_min_std)), "seasonal").otherwise("anomalous")
    factor = F.when(status == "seasonal", P.season_factor).when(status == "unverified", P.unverified_factor).otherwise(1.0)
    return status, factor


# --- map projection --------------------------------------------------------------------------------------------

_A, _F, _K0 = 6378137.0, 1 / 298.257223563, 0.9996
_N = _F / (2 - _F)
_R = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)


def utm_zone(lon: Column) -> Column:
    return F.least(F.greatest(F.floor((lon + 180) / 6).cast("int") + 1, F.lit(1)), F.lit(60))


def grid_zone(lon: Column, lat: Column) -> Column:
    """the zone that grid references use: that of the longitude, but for the wider 32V on Norway's coast and the four
    zones of two that are left between 72 and 84 degrees north from 0 to 42 east."""
    high = F.when(lon < 9, 31).when(lon < 21, 33).when(lon < 33, 35).otherwise(37)
    return F.when((lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12), 32).when((lat >= 72) & (lat <= 84) & (lon >= 0) & (lon < 42), high).otherwise(utm_zone(lon))


def utm(lon: Column, lat: Column, zone: Column | None = None) -> dict[str, Column]:
    """zone (that of the longitude unless another is asked for), easting and northing on WGS84, by Krueger's series to
    the third order."""
    zone = utm_zone(lon) if zone is None else zone
    dl = F.radians(lon - (zone * 6 - 183))
    e = 2 * math.sqrt(_N) / (1 + _N)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    east = reduce(lambda x, j: x + _ALPHA[j] * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta), range(3), eta)
    north = reduce(lambda x, j: x + _ALPHA[j] * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta), range(3), xi)
    return {"zone": zone, "easting": 500000 + _K0 * _R * east, "northing": F.when(lat < 0, 10_000_000.0).otherwise(0.0) + _K0 * _R * north}


_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def lonlat(zone: Column, easting: Column, northing: Column, south: Column) -> dict[str, Column]:
    """F37 backwards: longitude and latitude of a place in UTM, by the inverse of the same series."""
    xi, eta = (northing - F.when(south, 10_000_000.0).otherwise(0.0)) / (_K0 * _R), (easting - 500000) / (_K0 * _R)
    x = reduce(lambda v, j: v - _BETA[j] * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta), range(3), xi)
    y = reduce(lambda v, j: v - _BETA[j] * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta), range(3), eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = reduce(lambda v, j: v + _DELTA[j] * F.sin(2 * (j + 1) * chi), range(3), chi)
    return {"lon": zone * 6 - 183 + F.degrees(F.atan2(F.sinh(y), F.cos(x))), "lat": F.degrees(lat)}


def mgrs(lat: Column, lon: Column) -> Column:
    """a ten-digit grid reference; null outside of 80 S to 84 N."""
    at = utm(lon, lat, grid_zone(lon, lat))
    bands, columns, rows = "CDEFGHJKLMNPQRSTUVWX", ("ABCDEFGH", "JKLMNPQR", "STUVWXYZ"), "ABCDEFGHJKLMNPQRSTUV"
    band = F.substring(F.lit(bands), F.least(F.floor((lat + 80) / 8).cast("int"), F.lit(19)) + 1, F.lit(1))
    col = F.substring(F.element_at(F.array(*map(F.lit, columns)), F.pmod(at["zone"] - 1, F.lit(3)) + 1), F.floor(at["easting"] / 100000).cast("int"), F.lit(1))
    shift = F.when(at["zone"] % 2 == 0, 5).otherwise(0)
    row = F.substring(F.lit(rows), F.pmod(F.floor(at["northing"] / 100000).cast("int") + shift, F.lit(20)) + 1, F.lit(1))
    digits = [F.lpad(F.floor(at[k] % 100000).cast("string"), 5, "0") for k in ("easting", "northing")]
    ref = F.concat(F.lpad(at["zone"].cast("string"), 2, "0"), band, col, row, *digits)
    return F.when(lat.between(-80, 84) & lon.between(-180, 180), ref)


# --- texts and documents of a detection --------------------------------------------------------------------------


def band_offsets(tag: Column, bands: int) -> Column:
    """comma-separated offsets as numbers, what is no number as 0, filled up with zeros to the bands."""
    found = F.transform(F.split(F.coalesce(tag, F.lit("")), ","), lambda x: F.coalesce(F.trim(x).try_cast("double"), F.lit(0.0)))
    return F.slice(F.concat(found, F.array_repeat(F.lit(0.0), bands)), 1, bands)


def ring_area(ring: Column) -> Column:
    """Twice the signed area of a closed ring of [x, y]; positive if it runs against the clock."""
    steps = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: a[0] * b[1] - b[0] * a[1])
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def wound(ring: Column) -> Column:
    """outer rings run against the clock."""
    return F.when(ring_area(ring) < 0, F.reverse(ring)).otherwise(ring)


def confidence_terms(terms: dict[str, tuple[Column, float]], factor: Column) -> Column:
    """value, weight and contribution of each term, and the season's factor."""
    rows = [F.struct(F.lit(k).alias("term"), v.alias("value"), F.lit(w).alias("weight"), (v * w).alias("contribution")) for k, (v, w) in terms.items()]
    return F.struct(F.array(*rows).alias("terms"), F.coalesce(factor, F.lit(1.0)).alias("factor"))


#: How an export names masks, ways of alignment and of normalisation; other codes stand for themselves.
MASK_NAMES = {"scl": "SCL", "qa_pixel": "QA_PIXEL", "heuristic": "heuristic", "data_mask": "data_mask"}
METHOD_NAMES = {"same_tile": "same_mgrs_grid", "pif": "pif_robust_regression", "identity": "none"}


def named(code: Column, names: dict[str, str]) -> Column:
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(known[code], code)


def method_name(code: Column) -> Column:
    """what an export calls a way of alignment or normalisation; unknown where there is none."""
    return F.coalesce(named(code, METHOD_NAMES), F.lit("unknown"))


def mask_name(source_a: Column, source_b: Column) -> Column:
    """of both scenes' masks, once where they are of one kind."""
    a, b = (F.coalesce(named(x, MASK_NAMES), F.lit("None")) for x in (source_a, source_b))
    both = F.concat(a, F.lit(" (A) / "), b, F.lit(" (B)"))
    return F.when(source_a == source_b, a).when(F.coalesce(source_a, source_b).isNotNull(), both).otherwise("unknown")


def scene_paths(analysis: Column, display: Column, sensor: Column) -> Column:
    """the analysis raster, else the display raster; and what its mask is."""
    mask = F.when(sensor.startswith("sentinel"), "scl").when(sensor.startswith("landsat"), "qa").otherwise("data")
    return F.struct(F.coalesce(analysis, display).alias("raster"), mask.alias("mask"))


# --- decision trace ----------------------------------------------------------------------------------------------


def fixed(x: Column, digits: int = 2) -> Column:
    """A number with that many digits, n/a for none."""
    return F.when(x.isNull(), "n/a").otherwise(F.format_string(f"%.{digits}f", py_round(x.cast("double"), digits)))


def _line(key: str, text: Column) -> Column:
    return F.when(text.isNotNull(), F.struct(F.lit(key).alias("key"), F.lit(key.capitalize()).alias("label"), text.alias("text")))


_SCENE = "struct<source: string, cloud_trust: string>"
#: What a trace reads of a job's details; objects and lists are kept as they are written.
_DETAILS = (
    f"struct<masking: struct<scene_a: {_SCENE}, scene_b: {_SCENE}>, alignment: struct<method: string, tiles: array<string>, rho: string, inlier_ratio: string, max_shift_px: string>, "
    "radiometry: string, detection: struct<difference_band: string, kmeans_centroids: string>, grouping: struct<dilation_px: string>>"
)
_RADIOMETRY = "struct<tier: string, notes: array<string>, pif_pixels: string, slope: array<double>, intercept: array<double>>"


def with_job_facts(jobs: DataFrame, details: str = "details") -> tuple[DataFrame, dict[str, Column]]:
    """jobs with what a trace reads of their details, in JSON, as columns of their own, and these by name. Details are
    parsed once a job: each fact stands many times in the sentences."""
    read = jobs.withColumn("_details", F.from_json(details, _DETAILS)).withColumn("_radiometry", F.from_json("_details.radiometry", _RADIOMETRY))
    at = lambda path: F.col(f"_details.{path}")
    num = lambda path: at(path).try_cast("double")
    facts = {f"source_{s}": at(f"masking.scene_{s}.source") for s in "ab"} | {f"trust_{s}": num(f"masking.scene_{s}.cloud_trust") for s in "ab"}
    facts |= {"method": at("alignment.method"), "tiles": at("alignment.tiles")} | {k: num(f"alignment.{k}") for k in ("rho", "inlier_ratio", "max_shift_px")}
    facts |= {"radiometry": at("radiometry"), "notes": F.array_join("_radiometry.notes", "; "), "pif_pixels": F.col("_radiometry.pif_pixels").try_cast("double")}
    facts |= {k: F.col(f"_radiometry.{k}") for k in ("tier", "slope", "intercept")}
    centroids = at("detection.kmeans_centroids")
    facts |= {"band": at("detection.difference_band"), "centroids": centroids, "centroid": F.get_json_object(centroids, "$[1]").try_cast("double")}
    facts |= {"dilation_px": num("grouping.dilation_px").cast("int")}
    out = read.withColumns({f"_f_{k}": v for k, v in facts.items()})
    return out.drop("_details", "_radiometry"), {k: F.col(f"_f_{k}") for k in facts}


def with_job_sentences(jobs: DataFrame, details: str = "details") -> DataFrame:
    """F32: jobs with the sentences of a trace that hold for all of a job's detections, and its dilation. The sentences are
    fixed values."""
    rows, f = with_job_facts(jobs, details)
    source_a, source_b = f["source_a"], f["source_b"]
    trust = F.concat(F.lit("CloudTrust A: "), fixed(f["trust_a"]), F.lit(", CloudTrust B: "), fixed(f["trust_b"]))
    described = F.when(source_a == "scl", "SCL-based").when(source_a == "qa_pixel", "QA_PIXEL-based").when(source_a == "heuristic", "Heuristic (no QA band: CloudTrust reduced, no pixel removed)").otherwise("Data-mask based (no QA band available)")
    unknown = F.lit("unknown")
    masking = F.when(source_a == source_b, F.concat_ws(", ", described, trust)).when(F.coalesce(source_a, source_b).isNotNull(), F.concat(F.lit("A: "), F.coalesce(source_a, unknown), F.lit(", B: "), F.coalesce(source_b, unknown), F.lit(", "), trust))
    method, shift = f["method"], F.concat(F.lit(", largest shift "), fixed(f["max_shift_px"]), F.lit(" px"))
    tile = F.coalesce(*[F.try_element_at(f["tiles"], F.lit(i)) for i in (1, 2)])
    tile = F.when(tile.startswith("T"), tile).otherwise(F.coalesce(F.concat(F.lit("T"), tile), unknown))
    alignment = (
        F.when(method == "same_tile", F.concat(F.lit("Same MGRS tile ("), tile, F.lit(") — grid verified by definition")))
        .when(method == "ecc", F.concat(F.lit("ECC registration, correlation "), fixed(f["rho"], 3), shift))
        .when(method == "orb", F.concat(F.lit("ORB feature matching, inlier ratio "), fixed(f["inlier_ratio"]), shift))
        .otherwise(method)
    )
    # Of the NIR band, the fourth; of the last where there are fewer.
    last = F.when(F.size(f["slope"]) > 3, 4).otherwise(F.size(f["slope"]))
    nir = tuple(F.when(F.size(f["slope"]) > 0, F.try_element_at(f[k], last)) for k in ("slope", "intercept"))
    gain = F.when(nir[0].isNotNull() & nir[1].isNotNull(), F.concat(F.lit(", gain: "), fixed(nir[0]), F.lit(", offset: "), fixed(nir[1], 1))).otherwise("")
    normalisation = F.when(f["tier"] == "pif", F.concat(F.lit("PIF robust regression, "), F.format_number(F.coalesce(f["pif_pixels"], F.lit(0.0)), 0), F.lit(" anchor pixels"), gain)).when(f["radiometry"].isNotNull() & (f["radiometry"] != "{}"), F.concat(F.lit("None applied (too few stable pixels)"), F.when(f["notes"] != "", F.concat(F.lit(": "), f["notes"])).otherwise("")))
    band = F.when(f["band"].startswith("B08"), "NIR difference").otherwise("Mean-intensity difference")
    detection = F.when(f["centroids"].isNotNull(), F.concat(band, F.lit(" → K-Means K=2, change centroid magnitude: "), fixed(f["centroid"], 1)))
    told = {"masking": masking, "alignment": alignment, "normalisation": normalisation, "detection": detection}
    return rows.select(*jobs.columns, *[v.alias(f"_{k}") for k, v in told.items()], f["dilation_px"].alias("_dilation_px"))


def with_trace(rows: DataFrame, c: dict[str, Column]) -> DataFrame:
    """F32: what led to a detection, a line (key, label, text) for each step that took part, in the order of the plan, as
    `trace` of detections with their job's sentences (with_job_sentences). c: sub_blobs, merged_dilation, large_area,
    direction, dominant_a, dominant_b, rule, mean_dndvi, seasonality, priors_clear, current_ndvi, prior_mean, prior_std of
    the detection. Sentences are columns of their own, so that each is worked out once."""
    large = F.coalesce(c["large_area"], F.lit(False))
    own = F.when(c["merged_dilation"] > 0, c["merged_dilation"])
    grow = F.coalesce(own, F.when(large, P.large_dilations[0]), F.col("_dilation_px"), F.lit(P.near_dilations[0]))
    grouping = F.when(c["sub_blobs"] > 1, F.concat(F.when(large, "Large-area change: merged").otherwise("Merged"), F.lit(" from "), c["sub_blobs"], F.lit(" change blobs less than "), 2 * grow, F.lit(" px apart; area, outline and ΔNDVI are those of the blobs themselves")))
    way = F.coalesce(c["direction"], F.lit("unclassified"))
    rule = F.when((way == "unclassified") & c["rule"].isNotNull(), F.concat(F.lit(" ("), c["rule"], F.lit(")"))).otherwise("")
    direction = F.when(c["dominant_a"].isNull(), "Not classified (analysed before direction classification, or without a NIR band)").otherwise(F.concat(F.initcap(way), F.lit(" — dominant class A: "), c["dominant_a"], F.lit(", dominant class B: "), c["dominant_b"], rule))
    evidence = F.when(c["mean_dndvi"].isNotNull(), F.concat(F.lit("ΔNDVI: "), fixed(c["mean_dndvi"])))
    clear = F.coalesce(c["priors_clear"], F.lit(0))
    spread = F.concat(F.lit("NDVI "), fixed(c["current_ndvi"]), F.lit(" against a same-season mean of "), fixed(c["prior_mean"]), F.lit(" (±"), fixed(c["prior_std"]), F.lit(") over "), clear, F.lit(" prior years"))
    few = F.concat(F.lit("Unverified — "), clear, F.lit(" clear same-season prior observation"), F.when(clear == 1, "").otherwise("s"), F.lit(f" (needs {P.season_priors}); confidence ×{P.unverified_factor}"))
    season = (
        F.when(c["seasonality"] == "unverified", few)
        .when(c["seasonality"] == "seasonal", F.concat(F.lit("Seasonal — "), spread, F.lit(f"; within {P.season_sigmas:g} std devs, confidence ×{P.season_factor}")))
        .when(c["seasonality"].isNotNull(), F.concat(F.lit("Anomalous — "), spread, F.lit(f"; drop exceeds {P.season_sigmas:g} std devs, confidence unchanged")))
    )
    told = {"grouping": grouping, "direction": direction, "evidence": evidence, "seasonality": season}
    out = rows.withColumns({f"_{k}": x for k, x in told.items()})
    return out.withColumn("trace", F.array_compact(F.array(*[_line(k, F.col(f"_{k}")) for k in ("masking", "alignment", "normalisation", "detection", *told)])))


def exported_feature(c: dict[str, Column], geometry: Column, details: Column) -> Column:
    """A detection as one GeoJSON feature, in JSON. geometry: its outline as JSON, null where there is none: then
    its box. c: the detection's columns by name; names that it lacks are null."""

    def get(path: str) -> Column:
        return F.get_json_object(details, f"$.{path}")

    x0, y0, x1, y1 = (c[k] for k in BOX)
    ring = F.array(*[F.array(a, b) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])
    box = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    source_a, source_b = get("masking.scene_a.source"), get("masking.scene_b.source")
    processing = F.struct(
        mask_name(source_a, source_b).alias("masking"),
        get("masking.scene_a.cloud_trust").try_cast("double").alias("cloud_trust_a"),
        get("masking.scene_b.cloud_trust").try_cast("double").alias("cloud_trust_b"),
        method_name(get("alignment.method")).alias("alignment"),
        get("alignment.quality").try_cast("double").alias("alignment_quality"),
        method_name(get("radiometry.tier")).alias("normalisation"),
        get("radiometry.pif_pixels").try_cast("long").alias("pif_pixels"),
    )
    terms = ("alignment_quality", "cluster_distance_percentile", "terrain_flatness", "valid_coverage")
    plain = ("mgrs", "scene_a_id", "scene_b_id", "date_a", "date_b", "sensor")
    none = F.lit(None).cast("string")
    props = F.struct(
        *[c[k].alias(k) for k in ("candidate_id", "direction", "change_type")],
        py_round(c["confidence"], 4).alias("confidence"),
        F.struct(*[c.get(k, none).alias(k) for k in terms]).alias("confidence_breakdown"),
        *[c.get(k, none).alias(k) for k in plain],
        py_round(c["mean_dndvi"], 4).alias("delta_ndvi"),
        F.coalesce(c["review"], F.lit("pending")).alias("analyst_decision"),
        *[c.get(k, none).alias(k) for k in ("analyst_id", "reviewed_at")],
        processing.alias("processing"),
        c["area_px"].alias("area_px"),
        py_round(c["area_ha"], 2).alias("area_ha"),
        c["sub_blobs"].alias("sub_blobs"),
        c["seasonality"].alias("seasonality_status"),
        c.get("direction_evidence", none).alias("direction_evidence"),
        F.when(geometry.isNull(), "bounding_box").otherwise("changed_pixel_outline").alias("geometry_source"),
        *[c.get(k, none).alias(k) for k in ("raw_checksum_a", "raw_checksum_b", "analyst_notes")],
        F.coalesce(c.get("review_count", F.lit(0)), F.lit(0)).alias("review_count"),
    )
    keep_null = {"ignoreNullFields": "false"}
    return F.concat(F.lit('{"type":"Feature","id":'), c["candidate_id"].cast("string"), F.lit(',"geometry":'), F.coalesce(geometry, box), F.lit(',"properties":'), F.to_json(props, keep_null), F.lit("}"))

"""The registered queries of the raster operators over the pixel relations, each with its SQL for the check."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar as S
from .operators import history, raster, summed
from .plans import detect
from .sources.projections import load, sql_round, with_projections

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
WIDTH = 100


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_projections(sql)
        return f

    return put


def _refl(band: str, d: str) -> str:
    return f"{band}_{d} / 10000.0"


def _ratio(a: str, b: str) -> str:
    return f"case when {a} + {b} > 1e-6 then ({a} - {b}) / ({a} + {b}) end"


def _class(d: str) -> str:
    return f"case when ndwi_{d} > 0 then 'water' when ndvi_{d} < 0.15 then 'bare' when ndvi_{d} > 0.3 then 'vegetation' else 'other' end"


VALID = "scl_a in (4, 5, 6, 7, 11) and scl_b in (4, 5, 6, 7, 11)"
DATA = " and ".join(f"{b}_{d} <> 0" for b in ("b02", "b03", "b04", "b08") for d in "ab")
FEATURES = f"""
    i as (select r, c, {VALID} and {DATA} as valid, {', '.join(f"cast({_refl(b, d)} as double) as {b}{d}" for b in ('b02', 'b03', 'b04', 'b08') for d in 'ab')} from {{pixels}}),
    x as (select *, {', '.join(f"{_ratio(f'b08{d}', f'b04{d}')} as ndvi_{d}, {_ratio(f'b03{d}', f'b08{d}')} as ndwi_{d}, (b02{d} + b03{d} + b04{d}) / 3 as light_{d}" for d in 'ab')} from i),
    ft as (select r, c, valid, case when valid then abs(b08b - b08a) end as diff, case when valid then ndvi_b - ndvi_a end as dndvi, case when valid then {_class('a')} end as class_a, case when valid then {_class('b')} end as class_b,
        case when valid then (light_b - light_a) / greatest(light_a, 0.01) end as gain from x)"""


def _features(spark, d):
    return raster.pixel_features(load(spark, d, "pixels"))


@query(f"with {FEATURES} select r, c, valid, round(diff, 6) as diff, {sql_round('dndvi', 5)} as dndvi, class_a, class_b, {sql_round('gain', 5)} as gain from ft")
def pixel_features(spark, d):
    f = _features(spark, d)
    return f.select("r", "c", "valid", F.round("diff", 6).alias("diff"), S.py_round(F.col("dndvi"), 5).alias("dndvi"), "class_a", "class_b", S.py_round(F.col("gain"), 5).alias("gain"))


@query("""select count(*) as pixels, round(count(*) filter (where scl_a in (4, 5, 6, 7, 11)) / cast(count(*) filter (where scl_a <> 0) as double), 6) as valid, round(count(*) filter (where scl_a in (3, 8, 9, 10)) / cast(count(*) filter (where scl_a <> 0) as double), 6) as cloud,
    round(count(*) filter (where scl_a = 11) / cast(count(*) filter (where scl_a <> 0) as double), 6) as snow, round(count(*) filter (where scl_a = 0) / cast(count(*) as double), 6) as nodata from {pixels}""")
def pixel_stats(spark, d):
    return raster.scene_stats(load(spark, d, "pixels"), "scl_a")


@query("select scl_b as scl, count(*) as n from {pixels} group by scl_b")
def scl_histogram(spark, d):
    return load(spark, d, "pixels").groupBy(F.col("scl_b").alias("scl")).agg(F.count("*").alias("n"))


@query("""select r, c, case when qa & 1 <> 0 then 0 when qa & 8 <> 0 then 9 when qa & 16 <> 0 then 3 when qa & 32 <> 0 then 11 else 7 end as scl,
    case when b04_a = 0 then 0 else cast(least(greatest(round_even((b04_a * 20 * 2.75e-5 - 0.2e0) * 1e4 + 1000, 0), 1), 65535) as int) end as dn from {pixels}""")
def qa_decode(spark, d):
    return load(spark, d, "pixels").select("r", "c", S.qa_to_scl(F.col("qa")).alias("scl"), S.landsat_dn(F.col("b04_a") * 20).alias("dn"))


@query("""with i as (select case when b08_a + b04_a > 0 then (b08_a - b04_a) / cast(b08_a + b04_a as double) end as ndvi, (b02_a + b03_a + b04_a) / 3e0 as light from {pixels} where scl_a in (4, 5, 6, 7, 11)),
    q as (select quantile_cont(light, 0.75) as cut from i) select count(*) as valid, round(count(*) filter (where ndvi < 0.2 and light > cut) / cast(count(*) as double) * 100, 4) as cloud_pct from i, q""")
def cloud_pct_heuristic(spark, d):
    i = load(spark, d, "pixels").where(S.valid_scl(F.col("scl_a"))).select(S.ratio(F.col("b08_a"), F.col("b04_a")).alias("ndvi"), S.brightness(F.col("b02_a"), F.col("b03_a"), F.col("b04_a")).alias("light"))
    cut = raster.quantiles(i, "light", (0.75,))[0]
    hit = F.count_if((F.col("ndvi") < 0.2) & (F.col("light") > F.lit(cut).cast("double")))
    return i.agg(F.count("*").alias("valid"), F.round(hit / F.count("*") * 100, 4).alias("cloud_pct"))


@query(f"with i as (select b04_a, b04_b from {{pixels}} where {VALID}) select count(*) as n, round(case when var_pop(b04_b) > 1e-9 and regr_slope(b04_a, b04_b) between 0.5 and 2 then regr_slope(b04_a, b04_b) else 1 end, 6) as slope, round(case when var_pop(b04_b) > 1e-9 and regr_slope(b04_a, b04_b) between 0.5 and 2 then regr_intercept(b04_a, b04_b) else 0 end, 4) as intercept from i")
def pif_sufficient_stats(spark, d):
    p = load(spark, d, "pixels").where(S.valid_scl(F.col("scl_a")) & S.valid_scl(F.col("scl_b")))
    return raster.regression(p, "b04_a", "b04_b").select("n", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


#: Two bands of which one is noisier: what is stable in one of them alone isn't stable.
FITTED = f"""select r, cast(b04_a as double) as a1, cast(1.25e0 * b04_a + 40 + (r * 13 + c * 7) % 97 as double) as b1, cast(b08_a as double) as a2,
    cast(case when (r + c) % 10 < 3 then 3 * b08_a else 0.8e0 * b08_a - 30 + (r * 7 + c * 11) % 61 end as double) as b2 from {{pixels}} where {VALID} and {DATA}"""


def _line(i: int, part: str) -> str:
    a, b = f"a{i}", f"b{i}"
    return f"case when var_pop({b}) > 1e-9 and regr_slope({a}, {b}) between 0.5 and 2.0 then regr_{part}({a}, {b}) else {1 if part == 'slope' else 0} end"


LINES = ", ".join(f"{_line(i, part)} as {part[0]}{i}" for i in (1, 2) for part in ("slope", "intercept"))
RESIDUAL = "(abs(a1 - (b1 * s1 + i1)) + abs(a2 - (b2 * s2 + i2))) / 2"


@query(f"""with px as ({FITTED}), st as (select s, row_number() over (order by s) - 1 as k, count(*) over () as n from (select distinct cast(floor(r / 512) as bigint) as s from px) x),
    sa as (select px.* from px join st on cast(floor(r / 512) as bigint) = st.s where k % greatest(1, cast(floor(n / 8) as bigint)) = 0),
    f0 as (select count(*) as n, {LINES} from sa),
    q1 as (select quantile_cont({RESIDUAL}, 0.2) as cut from sa, f0), f1 as (select count(*) as n, {LINES}, max(cut) as cut from px, f0, q1 where {RESIDUAL} <= cut),
    q2 as (select quantile_cont({RESIDUAL}, 0.2) as cut from sa, f1), f2 as (select count(*) as n, {LINES}, max(q2.cut) as cut from px, f1, q2 where {RESIDUAL.replace('s1', 'f1.s1').replace('s2', 'f1.s2').replace('i1', 'f1.i1').replace('i2', 'f1.i2')} <= q2.cut),
    o as (select *, 1 as rounds from f1 union all select *, 2 from f2),
    w as (select case when f1.n < 1000 or (abs(f1.s1 - f0.s1) <= 1e-3 + 1e-5 * abs(f0.s1) and abs(f1.s2 - f0.s2) <= 1e-3 + 1e-5 * abs(f0.s2)) then 1 else 2 end as rounds, f0.n as all_n from f0, f1),
    g as (select o.*, all_n >= 1000 and o.n >= 1000 as fine, all_n from o join w on o.rounds = w.rounds)
    select case when fine then 'pif' else 'identity' end as tier, case when all_n < 1000 then 0 else n end as n, case when all_n < 1000 then 0 else round(cut, 6) end as threshold,
      case when fine then round(s1, 6) else 1 end as slope_b04, case when fine then round(i1, 4) else 0 end as intercept_b04, case when fine then round(s2, 6) else 1 end as slope_b08, case when fine then round(i2, 4) else 0 end as intercept_b08 from g""")
def pif_refit(spark, d):
    """A12-A14, R11 over two bands at once."""
    p = load(spark, d, "pixels")
    p = p.where(raster.validity(p, "a") & raster.validity(p, "b"))
    r, c = F.col("r"), F.col("c")
    b2 = F.when((r + c) % 10 < 3, 3 * F.col("b08_a")).otherwise(0.8 * F.col("b08_a") - 30 + (r * 7 + c * 11) % 61)
    p = p.select("r", F.col("b04_a").cast("double").alias("a1"), (1.25 * F.col("b04_a") + 40 + (r * 13 + c * 7) % 97).alias("b1"), F.col("b08_a").cast("double").alias("a2"), b2.cast("double").alias("b2"))
    fit = raster.invariant_fit(p, [("a1", "b1"), ("a2", "b2")])
    row = (fit.tier, fit.n, round(fit.threshold, 6), round(fit.slope[0], 6), round(fit.intercept[0], 4), round(fit.slope[1], 6), round(fit.intercept[1], 4))
    return spark.createDataFrame([row], "tier string, n long, threshold double, slope_b04 double, intercept_b04 double, slope_b08 double, intercept_b08 double")


@query(f"""with {FEATURES.strip()}, dv as (select diff as v, count(*) as n from ft where diff is not null group by diff),
    w as (select v, sum(n) over (order by v) as n1, sum(n * v) over (order by v) as s1, sum(n) over () as n2, sum(n * v) over () as s2 from dv),
    k as (select s1 / n1 as low, (s2 - s1) / (n2 - n1) as high from w where n1 < n2 order by s1 * s1 / n1 + (s2 - s1) * (s2 - s1) / (n2 - n1) desc limit 1)
    select round(low, 6) as low, round(high, 6) as high, case when high >= 0.03 then round((low + high) / 2, 6) end as threshold from k""")
def diff_kmeans_threshold(spark, d):
    """Of all ways to cut the differences in two, the one with the least sum of squares; change needs a class whose
    mean is large enough."""
    t = raster.two_means(_features(spark, d), "diff")
    return t.select(*[F.round(c, 6).alias(c) for c in ("low", "high", "threshold")])


@query(f"""with {FEATURES.strip()}, bx as (select r * 1000 + c as label, greatest(r - 3 - c % 9, 0) as min_r, least(r + r % 23, (select max(r) from ft)) as max_r, greatest(c - 5 - r % 11, 0) as min_c, least(c + 2 + c % 31, 99) as max_c from ft where (r * 7 + c * 3) % 97 = 0)
    select label, count(*) filter (where valid) / cast(count(*) as double) as coverage from bx join ft on ft.r between min_r and max_r and ft.c between min_c and max_c group by label""")
def box_coverage(spark, d):
    """The share of valid pixels in boxes that overlap, over pixels in chunks."""
    f = _features(spark, d)
    h = _height(f)
    r, c = F.col("r"), F.col("c")
    least = lambda a, b: F.least(a, F.lit(b))
    boxes = f.where((r * 7 + c * 3) % 97 == 0).select((r * 1000 + c).alias("label"), F.greatest(r - 3 - c % 9, F.lit(0)).alias("min_r"), least(r + r % 23, h - 1).alias("max_r"), F.greatest(c - 5 - r % 11, F.lit(0)).alias("min_c"), least(c + 2 + c % 31, WIDTH - 1).alias("max_c"))
    return summed.box_coverage(f.where("valid"), boxes, h, WIDTH, chunk=32)


def _near(rel: str, hit: str) -> str:
    return f"select r, c from (select x.r, x.c, count(*) as n from (select m.r + i.i as r, m.c + j.j as c from {rel} m, (values (-1), (0), (1)) i(i), (values (-1), (0), (1)) j(j)) x, sz where x.r between 0 and h - 1 and x.c between 0 and 99 group by x.r, x.c, h having count(*) >= {hit})"


AROUND = "(3 - (x.r = 0)::int - (x.r = h - 1)::int) * (3 - (x.c = 0)::int - (x.c = 99)::int)"
OPENED = f"sz as (select max(r) + 1 as h from {{marked}}), e1 as ({_near('{marked}', AROUND)}), d1 as ({_near('e1', '1')}), d2 as ({_near('d1', '1')}), oc as ({_near('d2', AROUND)})"


def _height(df: DataFrame) -> int:
    return (df.agg(F.max("r")).first()[0] or 0) + 1


def _opened(spark, d):
    m = load(spark, d, "marked")
    h = _height(m)
    return raster.opened_closed(m, h, WIDTH, 64), h


@query(f"with {OPENED} select r, c from oc")
def morph_open_close(spark, d):
    return _opened(spark, d)[0]


LABELS = f"""with recursive {OPENED}, n as (select r, c, r * 100 + c as id from oc), e as (select a.id as u, b.id as v from n a join n b on (abs(a.r - b.r) + abs(a.c - b.c) = 1) and b.r between a.r - 1 and a.r + 1),
    w(id, label) as (select id, id from n union select e.v, w.label from w join e on w.id = e.u where w.label < e.v),
    lb as (select cast(floor(id / 100) as bigint) as r, id % 100 as c, min(label) as label from w group by id)"""


@query(f"{LABELS} select r, c, label from lb")
def components(spark, d):
    return raster.labelled(_opened(spark, d)[0], WIDTH, chunk=32)


@query(f"""{LABELS} select label, count(*) as area_px, min(r) as min_r, max(r) as max_r, min(c) as min_c, max(c) as max_c, round(avg(r) + 0.5, 6) as centre_r, round(avg(c) + 0.5, 6) as centre_c from lb group by label having count(*) >= 20""")
def blob_stats(spark, d):
    return raster.blob_stats(components(spark, d), 20)


@query()
def group_levels(spark, d):
    """All levels of the elliptical dilation; a test holds it against a dense computation."""
    found, h = _opened(spark, d)
    labels = raster.labelled(found, WIDTH, chunk=64)
    return raster.groups(labels, h, WIDTH, chunk=256)


def _count(k: str, d: str) -> str:
    return f"count(*) filter (where class_{d} = '{k}') as {k}_{d}"


KINDS = ("vegetation", "water", "bare", "other")
TOP = {d: f"case greatest({', '.join(f'{k}_{d}' for k in KINDS)}) " + " ".join(f"when {k}_{d} then '{k}'" for k in KINDS) + " end" for d in "ab"}


@query(f"""with {FEATURES}, g as (select floor(r / 10) * 100 + floor(c / 10) as label, count(*) as px, avg(dndvi) as dndvi, avg(gain) as gain, {', '.join(_count(k, d) for k in KINDS for d in 'ab')} from ft group by 1),
    t as (select *, {TOP['a']} as top_a, {TOP['b']} as top_b, greatest({', '.join(f'{k}_a' for k in KINDS)}) as area_a, greatest({', '.join(f'{k}_b' for k in KINDS)}) as area_b,
      coalesce(dndvi <= -0.05, false) as dropped, coalesce(dndvi >= 0.05, false) as rose from g),
    u as (select *, top_a = 'bare' and top_b = 'bare' and dropped and coalesce(gain >= 0.15, false) as built from t),
    w as (select *, case when top_a in ('vegetation', 'water') and top_b = 'bare' then 'disappearance' when top_a = 'bare' and (top_b = 'vegetation' or built) then 'appearance'
      when top_a = top_b and area_a > 0 and area_b > 1.2 * area_a then 'expansion' when top_a = top_b and area_a > 0 and area_b < 0.8 * area_a then 'contraction' else 'unclassified' end as direction from u)
    select cast(label as bigint) as label, px, top_a, top_b, area_a, area_b, direction, case when direction = 'disappearance' and top_a = 'water' and water_b < water_a then 'water_loss' when direction = 'disappearance' and top_a = 'vegetation' and dropped then 'clearance'
      when direction = 'appearance' and top_b = 'vegetation' and rose then 'revegetation' when direction = 'appearance' and built then 'construction' when direction = 'expansion' and top_a = 'bare' then 'urban_expansion'
      when direction = 'contraction' and top_a = 'vegetation' then 'vegetation_retreat' else 'unclassified' end as change_type from w""")
def direction_decide(spark, d):
    f = _features(spark, d)
    labels = f.select("r", "c", (F.floor(F.col("r") / 10) * 100 + F.floor(F.col("c") / 10)).alias("label"))
    return raster.blob_classes(f, labels).select("label", "px", "top_a", "top_b", "area_a", "area_b", "direction", "change_type")


@query(f"with {FEATURES} select direction_a as class_a, class_b, n from (select class_a as direction_a, class_b, count(*) as n from ft where valid group by class_a, class_b) x")
def class_transitions(spark, d):
    return _features(spark, d).where("valid").groupBy("class_a", "class_b").agg(F.count("*").alias("n"))


@query("select cast(floor(r / 4) as bigint) as r, cast(floor(c / 4) as bigint) as c, avg(b08_a) as b08_a, bool_and(scl_a in (4, 5, 6, 7, 11)) as valid from {pixels} group by 1, 2")
def decimated(spark, d):
    return raster.decimated(load(spark, d, "pixels"), 4, ["b08_a"], S.valid_scl(F.col("scl_a")))


@query("select cast(floor(r / 5) as bigint) as tile_r, cast(floor(c / 5) as bigint) as tile_c, round(avg((scl_a in (2, 4, 5, 6, 7, 11, 1, 3, 8))::int), 6) as valid, round(avg(b08_a), 6) as mean from {pixels} group by 1, 2 having count(*) = 25 and avg((scl_a in (2, 4, 5, 6, 7, 11, 1, 3, 8))::int) >= 0.5")
def crop_grid(spark, d):
    ok = F.col("scl_a").isin(2, 4, 5, 6, 7, 11, 1, 3, 8)
    return raster.crops(load(spark, d, "pixels"), 5, ok, "b08_a").withColumns({k: F.round(k, 6) for k in ("valid", "mean")})


@query("with q as (select quantile_cont(b04_a, 0.02) as lo, quantile_cont(b04_a, 0.98) as hi from {pixels}) select r, c, cast(floor(least(greatest((b04_a - lo) / greatest(hi - lo, 1e-9) * 255, 0), 255)) as int) as stretched from {pixels}, q")
def display_stretch(spark, d):
    return raster.stretched(load(spark, d, "pixels"), "b04_a")


@query("select cast(floor(r / 2) as bigint) as r, cast(floor(c / 2) as bigint) as c, round(avg(b08_a), 6) as b08_a from {pixels} group by 1, 2")
def overview_mean(spark, d):
    return raster.overview(load(spark, d, "pixels"), "b08_a", 2)


@query("select cast(floor(r / 4) as bigint) as r, cast(floor(c / 4) as bigint) as c, scl_a from {pixels} where r % 4 = 0 and c % 4 = 0")
def overview_class(spark, d):
    return raster.overview(load(spark, d, "pixels"), "scl_a", 4, categorical=True)


@query("""with p as (select r, c, cast(b08_a as double) as v from {pixels}) select a.r, a.c, case when count(*) = 4 then sum(b.v * case when b.r = a.r then 0.75e0 else 0.25e0 end * 0.5e0) end as b08_a
    from p a join p b on b.r in (a.r, a.r + 1) and b.c in (a.c, a.c + 1) group by a.r, a.c""")
def regrid_shift(spark, d):
    p = load(spark, d, "pixels").select("r", "c", F.col("b08_a").cast("double").alias("b08_a"))
    return raster.regridded(p, "b08_a", 0.25, 0.5)


@query("""with b as (select event_id, user_id as grp, value from {events}), p as (select max(value) as v from b group by grp),
    n as (select value, count(*) filter (where p.v < value) as below, count(*) filter (where p.v <= value) as upto, count(*) as total from (select distinct value from b) x, p group by value)
    select event_id, (below + upto) / 2e0 / total as cluster_pct from b join n using (value)""")
def cluster_pool_rank(spark, d):
    b = load(spark, d, "events").select("event_id", F.col("user_id").alias("grp"), "value")
    return raster.cluster_pool_rank(b, "grp", "value").select("event_id", "cluster_pct")


@query()
def detect_changes(spark, d):
    """The whole plan with its own thresholds, from pixels with realistic masks to merged detections: one row each, or
    one row that says why there is none; tests hold it against scenes with a known truth."""
    found = detect.detect(load(spark, d, "clear_pixels"), WIDTH, chunk=128)
    names = ("candidate_id", "group", "confidence", "area_px", "area_ha", "mean_dndvi", "min_x", "min_y", "max_x", "max_y", "direction", "change_type", "members")
    if found.detections is None:
        return spark.range(1).select(F.lit(found.status).alias("status"), *[F.lit(None).cast("string" if n in ("direction", "change_type") else "double").alias(n) for n in names])
    return found.detections.select(F.lit(found.status).alias("status"), *[F.col(n).cast("double").alias(n) if n not in ("direction", "change_type") else F.col(n) for n in names])


@query("select r, c, scl from (select 2 * r + i as r, 2 * c + j as c, scl_a as scl from {pixels}, (values (0), (1)) x(i), (values (0), (1)) y(j)) z")
def upsampled_mask(spark, d):
    return raster.upsampled(load(spark, d, "pixels").withColumnRenamed("scl_a", "scl"), "scl")


#: Five dates of one ground, date 0 the latest: each with numbers and masks of its own.
DATES = """select s as scene_id, r, c, cast(300 + (b04_a + s * 211 + r * 3) % 1500 as bigint) as b04, cast(600 + (b08_a + s * s * 97 - case when s = 0 and floor(c / 10) % 2 = 0 then 500 else 0 end) % 2800 as bigint) as b08, cast((scl_a + s * 5 + c) % 12 as int) as scl
    from {pixels} cross join (select explode(sequence(0, 4)) as s)"""


@query(f"""with d as ({DATES.replace('select explode(sequence(0, 4)) as s', 'select unnest(range(0, 5)) as s')}), x as (select scene_id, cast(floor(r / 10) * 100 + floor(c / 10) as bigint) as candidate_id, scl in (4, 5, 6, 7, 11) as ok, (b08 / 1e4 - b04 / 1e4) / (b08 / 1e4 + b04 / 1e4) as ndvi from d),
    n as (select candidate_id, scene_id, case when avg(ok::int) >= 0.5 then avg(ndvi) filter (where ok) end as ndvi from x group by candidate_id, scene_id),
    h as (select candidate_id, count(ndvi) as n_clear, avg(ndvi) as mean, greatest(stddev_samp(ndvi), 0.05) as std from n where scene_id > 0 group by candidate_id),
    v as (select h.*, n.ndvi as current from h join n on h.candidate_id = n.candidate_id and n.scene_id = 0),
    w as (select *, case when n_clear < 3 or current is null then 'unverified' when mean - current <= 2 * std then 'seasonal' else 'anomalous' end as status from v)
    select candidate_id, 4 as priors, n_clear, case when status <> 'unverified' then round(mean, 6) end as prior_mean, case when status <> 'unverified' then round(std, 6) end as prior_std, case when status <> 'unverified' then round(current, 6) end as current,
      case when status <> 'unverified' then round((mean - current) / std, 4) end as drop_in_std, status, case status when 'seasonal' then 0.5 when 'unverified' then 0.85 else 1.0 end as factor from w""")
def seasonal_from_pixels(spark, d):
    """Blocks of ten by ten pixels as detections, looked up in an archive of chunk files of five dates."""
    p = load(spark, d, "pixels")
    height = _height(p)
    archive = f"{raster.shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    history.write_archive(spark.sql(DATES, pixels=p), archive, chunk=64)
    grid = {"crs": F.lit("EPSG:4326"), "width": F.lit(WIDTH), "height": F.lit(height), "transform": F.lit([0.001, 0.0, 70.0, 0.0, -0.001, 20.0])}
    date = F.make_date(2024 - F.col("id").cast("int"), F.lit(3), 10 + F.col("id").cast("int"))
    scenes = spark.range(5).select(F.col("id").alias("scene_id"), F.lit("s").alias("sensor"), date.alias("acquired"), F.lit(70.0).alias("min_x"), F.lit(20.0 - 0.001 * height).alias("min_y"), F.lit(70.0 + 0.001 * WIDTH).alias("max_x"), F.lit(20.0).alias("max_y"), *[v.alias(k) for k, v in grid.items()])
    block = p.select(F.floor(F.col("r") / 10).alias("i"), F.floor(F.col("c") / 10).alias("j")).distinct()
    ends = {"min_lon": 70 + F.col("j") * 0.01, "max_lon": 70 + (F.col("j") + 1) * 0.01, "max_lat": 20 - F.col("i") * 0.01, "min_lat": 20 - F.least((F.col("i") + 1) * 10, F.lit(height)) * 0.001}
    c = block.select((F.col("i") * 100 + F.col("j")).alias("candidate_id"), F.lit(0).cast("long").alias("after_scene"), F.lit("s").alias("sensor"), F.make_date(F.lit(2024), F.lit(3), F.lit(10)).alias("acquired"), *[v.alias(k) for k, v in ends.items()])
    ring = F.array(*[F.array(F.col(x), F.col(y)) for x, y in (("min_lon", "min_lat"), ("max_lon", "min_lat"), ("max_lon", "max_lat"), ("min_lon", "max_lat"), ("min_lon", "min_lat"))])
    c = c.withColumns({"geometry": F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))), "centroid_lon": F.lit(None).cast("double"), "centroid_lat": F.lit(None).cast("double")})
    found = history.verdicts(spark, c, scenes, archive, chunk=64)
    return found.withColumns({k: F.round(k, n) for k, n in (("prior_mean", 6), ("prior_std", 6), ("current", 6), ("drop_in_std", 4))})


@query("""with x as (select cast(floor(r / 10) * 100 + floor(c / 10) as bigint) as label, scl_b in (4, 5, 6, 7, 11) as ok, case when b08_b / 10000.0 + b04_b / 10000.0 > 1e-6 then (b08_b / 10000.0 - b04_b / 10000.0) / (b08_b / 10000.0 + b04_b / 10000.0) end as ndvi from {pixels})
    select label, round(case when avg(ok::int) >= 0.3 then avg(ndvi) filter (where ok) end, 9) as ndvi from x group by label""")
def outline_ndvi(spark, d):
    """A25 over blocks of ten by ten pixels."""
    p = load(spark, d, "pixels")
    labels = p.select("r", "c", (F.floor(F.col("r") / 10) * 100 + F.floor(F.col("c") / 10)).alias("label"))
    return raster.mean_ndvi_inside(p, labels, "b", 0.3).withColumn("ndvi", F.round("ndvi", 9))

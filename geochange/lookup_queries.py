"""More registered queries: look-ups, set operations, small reports. Each has its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar as S
from .operators import vector
from .plans import search
from .params import P
from .sources.projections import load, sql_round, with_projections

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = with_projections(sql)
        return f

    return put


BOX = ", ".join(S.BOX)


@query(f"""with t as (select tile_id, scene_id, {', '.join(f'case when tile_id % 6 <> 0 then {c} end as {c}, 10 * {c} + 500000 as native_{c}' for c in S.BOX)} from {{tiles}})
    select tile_id, scene_id, {', '.join(f'case when min_x is null then native_{c} else {c} end as {c}' for c in S.BOX)} from t where tile_id in (select candidate_id from {{candidates}} where job_id = 3)""")
def tiles_by_ids(spark, d):
    """P10: boxes in degrees, and where a tile has none its box on the ground."""
    ids = load(spark, d, "candidates").where("job_id = 3").select(F.col("candidate_id").alias("tile_id"))
    box = {c: F.when(F.col("tile_id") % 6 != 0, F.col(c)) for c in S.BOX} | {f"native_{c}": 10 * F.col(c) + 500000 for c in S.BOX}
    t = load(spark, d, "tiles").select("tile_id", "scene_id", *[v.alias(k) for k, v in box.items()])
    return t.join(ids, "tile_id", "left_semi").select("tile_id", "scene_id", *[F.when(F.col("min_x").isNull(), F.col(f"native_{c}")).otherwise(F.col(c)).alias(c) for c in S.BOX])


@query("""select t.tile_id, len(embedding) as dims, cast(embedding[1] as double) as first, list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double))) as square
    from {tiles} t where tile_id in (select candidate_id from {candidates} where job_id = 3)""")
def vectors_by_ids(spark, d):
    """V4: the vectors of ids that come from elsewhere; ids without a vector have no row."""
    ids = load(spark, d, "candidates").where("job_id = 3").select(F.col("candidate_id").alias("tile_id"))
    own = load(spark, d, "tiles").join(ids, "tile_id", "left_semi")
    e = F.col("embedding")
    return own.select("tile_id", F.size(e).alias("dims"), e[0].cast("double").alias("first"), vector.dot(e, e).alias("square"))


@query("select tile_id, min_x, min_y from {tiles} where scene_id = 4 and embedding is not null and min_x is not null")
def tiles_of_scene(spark, d):
    t = load(spark, d, "tiles").where("scene_id = 4 and embedding is not null and min_x is not null")
    return t.select("tile_id", "min_x", "min_y")


@query("select scene_id, count(*) as tiles from {tiles} where scene_id <> 4 group by scene_id")
def tiles_except_scene(spark, d):
    return load(spark, d, "tiles").where("scene_id <> 4").groupBy("scene_id").agg(F.count("*").alias("tiles"))


@query("select scene_id, sensor, acquired from {scenes} s where clear and exists (select 1 from {candidates} c where c.candidate_id = s.scene_id and c.job_id = 2) order by acquired desc, scene_id desc limit 1")
def resumable_scene(spark, d):
    there = load(spark, d, "candidates").where("job_id = 2").select(F.col("candidate_id").alias("scene_id"))
    s = load(spark, d, "scenes").where("clear").join(there, "scene_id", "left_semi")
    return s.select("scene_id", "sensor", "acquired").orderBy(F.desc("acquired"), F.desc("scene_id")).limit(1)


@query("select t.tile_id, t.scene_id, p.name, p.min_x as scene_min_x from {tiles} t join {places} p on t.scene_id = p.scene_id")
def tile_scene_lookup(spark, d):
    p = load(spark, d, "places").select("scene_id", "name", F.col("min_x").alias("scene_min_x"))
    return load(spark, d, "tiles").select("tile_id", "scene_id").join(p, "scene_id")


@query("""with a as (select r, c, b08_a as a from {pixels} where scl_a in (4, 5, 6, 7, 11)), b as (select r, c, b08_b as b from {pixels} where scl_b in (4, 5, 6, 7, 11))
    select count(*) as both_valid, sum(abs(b - a)) as total_change, max(b - a) as largest_rise from a join b on a.r = b.r and a.c = b.c""")
def pixel_pair_join(spark, d):
    p = load(spark, d, "pixels")
    a = p.where(S.valid_scl(F.col("scl_a"))).select("r", "c", F.col("b08_a").alias("a"))
    b = p.where(S.valid_scl(F.col("scl_b"))).select("r", "c", F.col("b08_b").alias("b"))
    diff = F.col("b") - F.col("a")
    return a.join(b, ["r", "c"]).agg(F.count("*").alias("both_valid"), F.sum(F.abs(diff)).alias("total_change"), F.max(diff).alias("largest_rise"))


@query("select r, c from {pixels} where scl_a in (4, 5, 6, 7, 11) intersect select r, c from {pixels} where scl_b in (4, 5, 6, 7, 11)")
def mask_intersection(spark, d):
    p = load(spark, d, "pixels")
    return p.where(S.valid_scl(F.col("scl_a"))).select("r", "c").intersect(p.where(S.valid_scl(F.col("scl_b"))).select("r", "c"))


@query("""select 3 as scene_id union select p.scene_id from {places} p, {places} o where o.scene_id = 3 and p.sensor = o.sensor and p.min_x <= o.max_x and p.max_x >= o.min_x and p.min_y <= o.max_y and p.max_y >= o.min_y""")
def scope_set(spark, d):
    return search.scope_scenes(load(spark, d, "places"), 3)


@query("select day from (select acquired as day from {scenes} union select cast(found_at as date) from {candidates}) x")
def dates_analysed(spark, d):
    a = load(spark, d, "scenes").select(F.col("acquired").alias("day"))
    return a.union(load(spark, d, "candidates").select(F.col("found_at").cast("date"))).distinct()


@query("""select k.scene_a, k.scene_b, a.acquired as date_a, b.acquired as date_b
    from {pair_jobs} k join {places} a on k.scene_a = a.scene_id join {places} b on k.scene_b = b.scene_id order by date_b desc, date_a desc, scene_a, scene_b""")
def pairs_by_date(spark, d):
    """T5: all pairs, the newest first."""
    out, places = load(spark, d, "pair_jobs").select("scene_a", "scene_b"), load(spark, d, "places")
    for side in "ab":
        out = out.join(places.select(F.col("scene_id").alias(f"scene_{side}"), F.col("acquired").alias(f"date_{side}")), f"scene_{side}")
    return out.orderBy(F.desc("date_b"), F.desc("date_a"), "scene_a", "scene_b")


@query("""select k.scene_a, k.scene_b, cast(coalesce(json_extract_string(details, '$.mutual_coverage_after_alignment'), json_extract_string(details, '$.mutual_coverage')) as double) as coverage,
    case when json_extract_string(details, '$.ablation.status') = 'running' and scene_a % 2 = 0 then 'not_run' else json_extract_string(details, '$.ablation.status') end as ablation, a.acquired as date_a, b.acquired as date_b
    from {pair_jobs} k left join {places} a on k.scene_a = a.scene_id left join {places} b on k.scene_b = b.scene_id""")
def job_details(spark, d):
    """Each job's dates, and what its details say."""
    out, places = load(spark, d, "pair_jobs"), load(spark, d, "places")
    for side in "ab":
        out = out.join(places.select(F.col("scene_id").alias(f"scene_{side}"), F.col("acquired").alias(f"date_{side}")), f"scene_{side}", "left")
    state = S.ablation_status(F.get_json_object("details", "$.ablation.status"), F.col("scene_a") % 2 == 1)
    return out.select("scene_a", "scene_b", S.job_coverage(F.col("details")).alias("coverage"), state.alias("ablation"), "date_a", "date_b")


@query("""select id, case when bands >= 4 and sensor <> 'liss3' then 0 end as blue, case when bands >= 4 then case sensor when 'liss3' then 0 else 1 end end as green, case when bands >= 4 then case sensor when 'liss3' then 1 else 2 end end as red,
    case when bands >= 4 then case sensor when 'liss3' then 2 else 3 end end as nir, case when id % 2 = 0 then (10 + id % 3 * 10) * (10 + id % 3 * 10) / 10000e0 end as pixel_ha
    from (select id, id % 6 as bands, case id % 4 when 0 then 'liss3' else 'bhuvan' end as sensor from {products}) x""")
def band_roles(spark, d):
    """F22, F23."""
    i = F.col("id")
    sensor, size = F.when(i % 4 == 0, "liss3").otherwise("bhuvan"), (10 + i % 3 * 10)
    roles = [S.band_role(r, sensor, i % 6).alias(r) for r in ("blue", "green", "red", "nir")]
    return load(spark, d, "products").select("id", *roles, S.pixel_area_ha(size, -size, i % 2 == 0).alias("pixel_ha"))


@query("""select job_id, 'direction' as kind, coalesce(raw_direction, 'unclassified') as name, count(*) as n from {candidates} group by all
    union all select job_id, 'type', case when raw_type in ('clearance', 'construction', 'revegetation', 'urban_expansion', 'vegetation_loss', 'vegetation_retreat', 'water_loss') then raw_type else 'unclassified' end, count(*) from {candidates} group by all""")
def trace_counters(spark, d):
    """Detections of each job by direction and by type, in one pass."""
    named = F.array(F.struct(F.lit("direction").alias("kind"), F.coalesce("raw_direction", F.lit("unclassified")).alias("name")), F.struct(F.lit("type").alias("kind"), S.normal_type(F.col("raw_type")).alias("name")))
    return load(spark, d, "candidates").select("job_id", F.explode(named).alias("x")).groupBy("job_id", "x.kind", "x.name").agg(F.count("*").alias("n"))


@query("""select kind, sum(value) as crops, case when sum(value) > 0 and epoch(max(ts)) - epoch(min(ts)) > 0 then round(sum(value) / (epoch(max(ts)) - epoch(min(ts))), 2) end as crops_per_sec from {latencies} group by kind""")
def throughput(spark, d):
    """A32."""
    span = F.unix_micros(F.max("ts").cast("timestamp")) / 1e6 - F.unix_micros(F.min("ts").cast("timestamp")) / 1e6
    x = load(spark, d, "latencies").groupBy("kind").agg(F.sum("value").alias("crops"), span.alias("s"))
    return x.select("kind", "crops", F.round(S.throughput(F.col("crops"), F.col("s")), 2).alias("crops_per_sec"))


@query("""select candidate_id, coalesce(area_ha, area_px / 100e0) as ha, case when area_ha is null then 'pixels' else 'recorded' end as source from {candidates}""")
def hectares(spark, d):
    """F39."""
    c = load(spark, d, "candidates")
    return c.select("candidate_id", S.hectares(F.col("area_ha"), F.col("area_px")).alias("ha"), F.when(F.col("area_ha").isNull(), "pixels").otherwise("recorded").alias("source"))


@query(f"""select candidate_id, {sql_round('a', 6)} as alignment, {sql_round('c', 6)} as cluster, 0.15e0 as terrain, case seasonality when 'seasonal' then 0.5e0 when 'unverified' then 0.85e0 else 1e0 end as factor from (select *, area_px / 5000e0 * 0.35e0 as a, confidence * 0.35e0 as c from {{candidates}}) x""")
def confidence_breakdown(spark, d):
    factor = F.when(F.col("seasonality") == "seasonal", P.season_factor).when(F.col("seasonality") == "unverified", P.unverified_factor)
    terms = {"alignment": (F.col("area_px") / 5000, P.w_alignment), "cluster": (F.col("confidence"), P.w_cluster), "terrain": (F.lit(P.terrain), P.w_terrain)}
    x = load(spark, d, "candidates").select("candidate_id", S.confidence_terms(terms, factor).alias("x"))
    part = lambda i: S.py_round(F.col("x.terms")[i]["contribution"], 6)
    return x.select("candidate_id", part(0).alias("alignment"), part(1).alias("cluster"), F.col("x.terms")[2]["contribution"].alias("terrain"), F.col("x.factor").alias("factor"))


@query("""select id, case when id % 3 = 0 then '-1000' when id % 3 = 1 then '-1000, x, 5' else '' end as tag, case when id % 3 = 0 then '-1000.0,0.0,0.0,0.0' when id % 3 = 1 then '-1000.0,0.0,5.0,0.0' else '0.0,0.0,0.0,0.0' end as offsets from {products}""")
def offset_tags(spark, d):
    k = F.col("id") % 3
    tag = F.when(k == 0, "-1000").when(k == 1, "-1000, x, 5").otherwise("")
    return load(spark, d, "products").select("id", tag.alias("tag"), F.array_join(F.transform(S.band_offsets(tag, 4), lambda x: x.cast("string")), ",").alias("offsets"))


@query("select candidate_id, (max_x - min_x) * (max_y - min_y) * 2 > 0 as counter_clockwise, candidate_id % 2 = 1 as turned from {candidates}")
def ring_winding(spark, d):
    x0, y0, x1, y1 = (F.col(c) for c in S.BOX)
    ring = F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1), F.array(x0, y0))
    c = load(spark, d, "candidates").withColumn("ring", F.when(F.col("candidate_id") % 2 == 1, F.reverse(ring)).otherwise(ring))
    return c.select("candidate_id", (S.ring_area(S.wound(F.col("ring"))) > 0).alias("counter_clockwise"), (S.ring_area(F.col("ring")) < 0).alias("turned"))


@query("""select candidate_id, case candidate_id % 5 when 0 then 'same_mgrs_grid' when 1 then 'ecc' when 2 then 'pif_robust_regression' when 3 then 'none' else 'unknown' end as method,
    case when candidate_id % 3 = 0 then 'display_' || candidate_id else 'analysis_' || candidate_id end as raster, case candidate_id % 5 when 0 then 'scl' when 1 then 'qa' else 'data' end as mask from {candidates}""")
def provenance(spark, d):
    i = F.col("candidate_id")
    code = F.element_at(F.array(*map(F.lit, ("same_tile", "ecc", "pif", "identity", None))), (i % 5).cast("int") + 1)
    sensor = F.when(i % 5 == 0, "sentinel2").when(i % 5 == 1, "landsat8").otherwise("liss3")
    paths = S.scene_paths(F.when(i % 3 != 0, F.concat(F.lit("analysis_"), i)), F.concat(F.lit("display_"), i), sensor)
    return load(spark, d, "candidates").select("candidate_id", S.method_name(code).alias("method"), paths["raster"].alias("raster"), paths["mask"].alias("mask"))


def _shown(band: str) -> str:
    return f"case when b02_a + b03_a + b04_a = 0 then 0 else cast(floor(least(greatest({band} / 10000e0 / 0.30e0 * 255, 1), 255)) as int) end"


@query(f"select r, c, {', '.join(f'{_shown(b)} as {n}' for n, b in (('red', 'b04_a'), ('green', 'b03_a'), ('blue', 'b02_a')))} from {{pixels}}")
def display_rgb(spark, d):
    """F21 of all three bands: black where none has data."""
    empty = F.col("b02_a") + F.col("b03_a") + F.col("b04_a") == 0
    shown = {n: F.when(empty, 0).otherwise(S.display_rgb(S.reflectance(F.col(b), F.lit(0), F.lit(10000.0)))) for n, b in (("red", "b04_a"), ("green", "b03_a"), ("blue", "b02_a"))}
    return load(spark, d, "pixels").select("r", "c", *[v.alias(n) for n, v in shown.items()])


@query("""select id, case when bands between 3 and 4 and projected and res between 21 and 26 then 'liss3' else 'unknown' end as sensor from (select id, id % 6 as bands, id % 2 = 0 as projected, 20 + id % 8 as res from {products}) x""")
def inferred_sensor(spark, d):
    i = F.col("id")
    return load(spark, d, "products").select("id", S.infer_sensor(i % 6, i % 2 == 0, -(20 + i % 8)).alias("sensor"))


@query("select (select count(*) from {tiles}) as tiles, (select count(*) from {candidates}) as candidates, (select count(*) from {watchlist}) as watched, (select count(*) from {reviews}) as reviews")
def archive_counts(spark, d):
    """A5: single rows side by side."""
    out = None
    for name, alias in (("tiles", "tiles"), ("candidates", "candidates"), ("watchlist", "watched"), ("reviews", "reviews")):
        n = load(spark, d, name).agg(F.count("*").alias(alias))
        out = n if out is None else out.join(n, F.lit(True))
    return out


@query("""select kind, count(*) as n, round(min(value), 2) as least, round(max(value), 2) as most, max(ts) as last_at from {latencies} group by kind""")
def manifest(spark, d):
    """One row for each kind of operation; a JSON view of it is to_json over the row."""
    return load(spark, d, "latencies").groupBy("kind").agg(F.count("*").alias("n"), F.round(F.min("value"), 2).alias("least"), F.round(F.max("value"), 2).alias("most"), F.max("ts").alias("last_at"))

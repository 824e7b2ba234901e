"""The registered queries of the engine over the domain relations, each with its SQL for the check."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalar as S
from .operators import catalog, codes, pairs, raster, seasonal, spatial, vector, versions
from .params import CHANGE_TYPES, P
from .plans import requests, search
from .sources.projections import load, sql_round, with_projections
from .streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name; sql may name projections in braces."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_projections(sql)
        return f

    return put


TYPES = ", ".join(f"'{t}'" for t in CHANGE_TYPES)
VIEW = f"""
    v as (select c.candidate_id, job_id, scene_a, scene_b, place, min_x, min_y, max_x, max_y, confidence, area_px, mean_dndvi, seasonality, found_at,
        case when raw_type in ({TYPES}) then raw_type else 'unclassified' end as change_type, coalesce(raw_direction, 'unclassified') as direction,
        coalesce(raw_sub_blobs, 1) as sub_blobs, coalesce(area_ha, nullif(area_px, 0) / 100.0) as area_ha, coalesce(r.review, 'pending') as review
      from {{candidates}} c left join (select candidate_id, arg_max(decision, seq) as review from {{reviews}} group by candidate_id) r on c.candidate_id = r.candidate_id)"""


def _view(spark: SparkSession, d: str) -> DataFrame:
    return catalog.candidate_view(load(spark, d, "candidates"), load(spark, d, "reviews"))


# --- catalogue -------------------------------------------------------------------------------------------------


@query(f"with {VIEW} select v.*, a.name as scene_a_name, b.name as scene_b_name from v left join {{places}} a on v.scene_a = a.scene_id left join {{places}} b on v.scene_b = b.scene_id")
def candidate_view(spark, d):
    return catalog.candidate_view(load(spark, d, "candidates"), load(spark, d, "reviews"), load(spark, d, "places"))


@query("select candidate_id, arg_max(decision, seq) as review from {reviews} group by candidate_id")
def latest_review(spark, d):
    return catalog.latest_review(load(spark, d, "reviews"))


@query("select candidate_id, seq, decision, reviewed_at, coalesce(lag(decision) over (partition by candidate_id order by seq) <> decision, false) as changed from {reviews}")
def review_audit(spark, d):
    return catalog.review_audit(load(spark, d, "reviews"))


@query(f"""with {VIEW} select candidate_id, change_type, direction, confidence, area_ha from v
    where confidence >= 0.5 and change_type in ('clearance', 'unclassified') and direction in ('appearance', 'unclassified') and (seasonality is null or seasonality <> 'seasonal') and job_id in (1, 3, 5)""")
def browse_filtered(spark, d):
    found = catalog.filtered(_view(spark, d), 0.5, ["clearance", "unclassified"], ["appearance", "unclassified"], True, [1, 3, 5])
    return found.select("candidate_id", "change_type", "direction", "confidence", "area_ha")


@query(f"with {VIEW} select candidate_id, review from v where review = 'confirmed'")
def decision_filter(spark, d):
    return catalog.filtered(_view(spark, d), decisions=["confirmed"]).select("candidate_id", "review")


_ORDERS = {"confidence": "confidence desc, area_px desc", "area": "coalesce(area_ha, 0) desc, confidence desc", "date": "found_at desc, confidence desc"}


def _capped(by: str):
    def run(spark, d):
        return catalog.capped(_view(spark, d), by).select("job_id", "candidate_id", "place_in_job")

    run.__name__ = f"browse_capped_{by}"
    query(f"with {VIEW}, n as (select job_id, candidate_id, row_number() over (partition by job_id order by {_ORDERS[by]}, candidate_id) as place_in_job from v) select * from n where place_in_job <= 200")(run)


for _by in _ORDERS:
    _capped(_by)


@query(f"""with {VIEW}, j as (select unnest(range(1, 8)) as job_id), n as (select job_id, count(*) as total, count(*) filter (where confidence >= 0.5) as matching, count(*) filter (where not confidence >= 0.5) as excluded,
    count(*) filter (where review = 'pending') as pending, count(*) filter (where review = 'confirmed') as confirmed, count(*) filter (where review = 'rejected') as rejected from v group by job_id)
    select j.job_id, coalesce(total, 0) as total, coalesce(matching, 0) as matching, coalesce(excluded, 0) + case when j.job_id % 2 = 1 then j.job_id * 3 else 0 end as excluded, coalesce(pending, 0) as pending, coalesce(confirmed, 0) as confirmed, coalesce(rejected, 0) as rejected,
      case when j.job_id % 2 = 1 then 100000 + j.job_id else coalesce(total, 0) end as found from j left join n on j.job_id = n.job_id""")
def browse_counters(spark, d):
    """A7 with the traces of seven jobs, of which two have no detection."""
    j = F.col("job_id")
    trace = F.format_string('{"scoring":{"candidates_found":%d,"dropped_low_confidence":%d}}', 100000 + j, j * 3)
    jobs = spark.range(1, 8).select(F.col("id").alias("job_id")).withColumn("details", F.when(j % 2 == 1, trace).otherwise("{}"))
    return catalog.counters(_view(spark, d), 0.5, jobs)


@query("select job_id, count(*) as candidates, min(confidence) as lowest, max(confidence) as highest from {candidates} group by job_id")
def jobs_counts(spark, d):
    return load(spark, d, "candidates").groupBy("job_id").agg(F.count("*").alias("candidates"), F.min("confidence").alias("lowest"), F.max("confidence").alias("highest"))


@query("select candidate_id, confidence from {candidates} order by confidence desc, candidate_id limit 100")
def list_top(spark, d):
    return load(spark, d, "candidates").select("candidate_id", "confidence").orderBy(F.desc("confidence"), F.asc("candidate_id")).limit(100)


@query("select candidate_id, scene_a, scene_b from {candidates} where least(scene_a, scene_b) = 2 and greatest(scene_a, scene_b) = 5")
def job_for_pair(spark, d):
    c = load(spark, d, "candidates").select("candidate_id", "scene_a", "scene_b")
    return c.where((F.least("scene_a", "scene_b") == 2) & (F.greatest("scene_a", "scene_b") == 5))


@query("""with s as (select candidate_id, unnest(list_distinct([scene_a, scene_b])) as scene_id from {candidates}),
    n as (select candidate_id, count(*) as r from {reviews} group by candidate_id),
    p as (select scene_id, count(*) as candidates, sum(coalesce(r, 0)) as reviews from s left join n using (candidate_id) group by scene_id),
    t as (select scene_id, count(*) as tiles from {tiles} group by scene_id)
    select x.scene_id, name, coalesce(tiles, 0) as tiles, coalesce(p.candidates, 0) as candidates, cast(coalesce(p.reviews, 0) as bigint) as reviews from {places} x left join t using (scene_id) left join p using (scene_id)""")
def scene_summaries(spark, d):
    return catalog.scene_summaries(*(load(spark, d, t) for t in ("places", "tiles", "candidates", "reviews")))


@query("""with n as (select *, row_number() over (partition by job_id order by area_px desc, confidence desc, candidate_id) <= 500 as reserved from {candidates} where confidence >= 0.3),
    m as (select job_id, candidate_id, reserved, row_number() over (partition by job_id order by reserved desc, confidence desc, area_px desc, candidate_id) as place_in_job from n)
    select * from m where place_in_job <= 1000""")
def finalize_cap(spark, d):
    found = catalog.area_capped(load(spark, d, "candidates"), "job_id", 1000, P.area_reserve)
    return found.select("job_id", "candidate_id", "reserved", "place_in_job")


@query("""with m as (select c.*, case when raw_type in (%s) then raw_type else 'unclassified' end as change_type, coalesce(raw_direction, 'unclassified') as direction from {candidates} c),
    b as (select place, arg_max(candidate_id, row(confidence, area_px, -candidate_id)) as lead_id, max(confidence) as confidence, min(min_x) as min_x, min(min_y) as min_y, max(max_x) as max_x, max(max_y) as max_y,
        sum(area_px) as area_px, case when count(*) = count(area_ha) then round(sum(area_ha), 4) end as area_ha,
        sum(area_px * mean_dndvi) / sum(area_px) filter (where mean_dndvi is not null) as mean_raw, count(*) as members from m group by place),
    t as (select place, change_type, sum(area_px) as a, max(confidence) as c from m group by place, change_type),
    u as (select *, row_number() over (partition by place order by change_type <> 'unclassified' desc, a desc, c desc, change_type desc) as n, max(a) over (partition by place) as largest, count(*) over (partition by place) as n_types from t),
    e as (select m.place, m.direction, sum(area_px) as a, max(m.confidence) as c from m join u on m.place = u.place and m.change_type = u.change_type and u.n = 1 group by m.place, m.direction),
    f as (select *, row_number() over (partition by place order by a desc, c desc, direction desc) as n from e)
    select b.place, lead_id, confidence, min_x, min_y, max_x, max_y, cast(area_px as bigint) as area_px, area_ha, round(mean_raw, 9) as mean_dndvi, members, u.change_type, cast(u.largest as bigint) as largest_type_px, u.n_types, f.direction
    from b join u on b.place = u.place and u.n = 1 join f on b.place = f.place and f.n = 1""" % TYPES)
def merge_candidates(spark, d):
    c = load(spark, d, "candidates")
    c = c.withColumn("change_type", S.normal_type(F.col("raw_type"))).withColumn("direction", F.coalesce("raw_direction", F.lit("unclassified")))
    return catalog.merged(c, "place").withColumn("mean_dndvi", F.round("mean_dndvi", 9))


@query("""with m as (select place, case when raw_type in (%s) then raw_type else 'unclassified' end as change_type, area_px from {candidates}),
    t as (select place, change_type, sum(area_px) as px from m group by place, change_type)
    select place, string_agg(change_type || '=' || px, ',' order by change_type) as area_by_type from t group by place""" % TYPES)
def area_by_type(spark, d):
    c = load(spark, d, "candidates").groupBy("place", S.normal_type(F.col("raw_type")).alias("t")).agg(F.sum("area_px").alias("px"))
    pairs = F.array_sort(F.collect_list(F.struct("t", "px")))
    return c.groupBy("place").agg(F.array_join(F.transform(pairs, lambda x: F.concat_ws("=", x["t"], x["px"])), ",").alias("area_by_type"))


@query("""with n as (select candidate_id, max(seq) as updates from {reviews} where seq <= 3 group by candidate_id),
    m as (select candidate_id * 2 as candidate_id, 0.99 as confidence, 7 as job_id from {candidates})
    select coalesce(m.candidate_id, c.candidate_id) as candidate_id, coalesce(m.confidence, c.confidence) as confidence, coalesce(c.job_id, m.job_id) as job_id from {candidates} c full join m on c.candidate_id = m.candidate_id""")
def upsert_rows(spark, d):
    old = load(spark, d, "candidates").select("candidate_id", "confidence", "job_id")
    new = old.select((F.col("candidate_id") * 2).alias("candidate_id"), F.lit(0.99).alias("confidence"), F.lit(7).cast("long").alias("job_id"))
    return catalog.upsert(old, new, "candidate_id", keep_old=["job_id"])


@query("""with old as (select scene_a, scene_b from {candidates} where job_id = 1), new as (select scene_a, scene_b from {candidates})
    select scene_a, scene_b, count(*) as n from (select scene_a, scene_b from old union all (select distinct scene_a, scene_b from new where (scene_a, scene_b) not in (select (scene_a, scene_b) from old))) x group by all""")
def enqueue_missing(spark, d):
    c = load(spark, d, "candidates").select("scene_a", "scene_b", "job_id")
    old, new = c.where("job_id = 1").drop("job_id"), c.drop("job_id")
    return catalog.insert_missing(old, new, ["scene_a", "scene_b"]).groupBy("scene_a", "scene_b").agg(F.count("*").alias("n"))


ALERTS = "al as (select watch_id, candidate_id, job_id, confidence from {candidates} c join {watchlist} w on c.min_x <= w.max_x and c.max_x >= w.min_x and c.min_y <= w.max_y and c.max_y >= w.min_y and c.confidence >= w.threshold)"


def _alerts(spark, d):
    return spatial.watch_alerts(load(spark, d, "candidates"), load(spark, d, "watchlist"))


@query(f"""with {ALERTS}, s as (select scene_id from {{places}} where scene_id in (2, 3)), g as (select candidate_id from {{candidates}} where scene_a in (select scene_id from s) or scene_b in (select scene_id from s))
    select 'reviews' as table_name, count(*) as deleted from {{reviews}} where candidate_id in (select candidate_id from g) union all select 'alerts', count(*) from al where candidate_id in (select candidate_id from g)
    union all select 'candidates', count(*) from g union all select 'tiles', count(*) from {{tiles}} where scene_id in (select scene_id from s)""")
def cascade_counts(spark, d):
    gone = load(spark, d, "places").where(F.col("scene_id").isin(2, 3)).select("scene_id")
    return catalog.cascade_counts(gone, *(load(spark, d, t) for t in ("tiles", "candidates", "reviews")), _alerts(spark, d))


# --- boxes, pairs and watched places ----------------------------------------------------------------------------


@query(f"with {ALERTS} select * from al")
def watchlist_alerts(spark, d):
    return _alerts(spark, d)


@query(f"with {ALERTS} select w.watch_id, name, count(al.candidate_id) as alerts, count(al.candidate_id) filter (where al.candidate_id % 3 <> 0) as open_alerts from {{watchlist}} w left join al using (watch_id) group by w.watch_id, name")
def watch_counts(spark, d):
    return spatial.watch_counts(load(spark, d, "watchlist"), _alerts(spark, d), F.col("candidate_id") % 3 == 0)


@query(f"""with {ALERTS} select al.watch_id, al.candidate_id, w.name, c.scene_a, c.scene_b, a.name as scene_a_name, b.name as scene_b_name, al.confidence from al join {{watchlist}} w using (watch_id)
    join {{candidates}} c on al.candidate_id = c.candidate_id left join {{places}} a on c.scene_a = a.scene_id left join {{places}} b on c.scene_b = b.scene_id""")
def alert_list(spark, d):
    places = load(spark, d, "places").select("scene_id", "name")
    out = _alerts(spark, d).drop("job_id").join(load(spark, d, "watchlist").select("watch_id", "name"), "watch_id")
    out = out.join(load(spark, d, "candidates").select("candidate_id", "scene_a", "scene_b"), "candidate_id")
    for side in "ab":
        out = out.join(places.select(F.col("scene_id").alias(f"scene_{side}"), F.col("name").alias(f"scene_{side}_name")), f"scene_{side}", "left")
    return out


@query("select c.candidate_id, t.tile_id from {candidates} c join {tiles} t on c.min_x <= t.max_x and c.max_x >= t.min_x and c.min_y <= t.max_y and c.max_y >= t.min_y")
def grid_join_equivalence(spark, d):
    return spatial.box_join(load(spark, d, "candidates"), load(spark, d, "tiles"), 2.0).select(F.col("l.candidate_id").alias("candidate_id"), F.col("r.tile_id").alias("tile_id"))


@query("select candidate_id from {candidates} c where exists (select 1 from {watchlist} w where c.min_x <= w.max_x and c.max_x >= w.min_x and c.min_y <= w.max_y and c.max_y >= w.min_y)")
def overlap_semi_join(spark, d):
    return spatial.box_join(load(spark, d, "candidates"), load(spark, d, "watchlist"), 2.0).select(F.col("l.candidate_id").alias("candidate_id")).distinct()


FOOT = """f as (select a.scene_id, b.scene_id as other_id, a.acquired, b.acquired as other_acquired,
    round(greatest(least(a.max_x, b.max_x) - greatest(a.min_x, b.min_x), 0) * greatest(least(a.max_y, b.max_y) - greatest(a.min_y, b.min_y), 0) / least((a.max_x - a.min_x) * (a.max_y - a.min_y), (b.max_x - b.min_x) * (b.max_y - b.min_y)), 6) as overlap
    from {scenes} a join {scenes} b on a.sensor = b.sensor and a.scene_id <> b.scene_id and a.min_x <= b.max_x and a.max_x >= b.min_x and a.min_y <= b.max_y and a.max_y >= b.min_y)"""


@query(f"with {FOOT} select * from f")
def footprint_overlap(spark, d):
    return spatial.footprint_pairs(load(spark, d, "scenes")).withColumn("overlap", F.round("overlap", 6))


PLAN = f"""{FOOT}, g as (select * from f where overlap >= 0.3 and acquired <> other_acquired),
    pl as (select scene_id, first(other_id order by other_acquired desc, other_id) filter (where other_acquired < acquired) as before_id, first(other_id order by other_acquired, other_id) filter (where other_acquired > acquired) as after_id from g group by scene_id)"""
JOBS = f"{PLAN}, jb as (select distinct a as scene_a, b as scene_b from (select before_id as a, scene_id as b from pl union all select scene_id, after_id from pl) x where a is not null and b is not null)"


@query(f"with {PLAN} select * from pl")
def pair_plan(spark, d):
    return spatial.pair_plan(load(spark, d, "scenes"))


@query(f"with {JOBS} select * from jb")
def planned_jobs(spark, d):
    return spatial.planned_jobs(spatial.pair_plan(load(spark, d, "scenes")))


WINDOWS = f"""{JOBS}, wn as (select scene_a, scene_b, a.acquired as date_a, b.acquired as date_b, greatest(a.min_x, b.min_x) as min_x, greatest(a.min_y, b.min_y) as min_y, least(a.max_x, b.max_x) as max_x, least(a.max_y, b.max_y) as max_y
    from jb join {{scenes}} a on scene_a = a.scene_id join {{scenes}} b on scene_b = b.scene_id)"""


@query(f"with {WINDOWS} select * from wn where min_x < max_x and min_y < max_y")
def pair_windows(spark, d):
    scenes = load(spark, d, "scenes")
    return spatial.pair_windows(spatial.planned_jobs(spatial.pair_plan(scenes)), scenes)


@query(f"with {WINDOWS} select count(*) as pairs, min(date_a) as first_date, max(date_b) as last_date, min(min_x) as min_x, min(min_y) as min_y, max(max_x) as max_x, max(max_y) as max_y from wn where min_x < max_x and min_y < max_y")
def analysed_area(spark, d):
    return spatial.analysed_area(pair_windows(spark, d))


SHARED = "round(greatest(least(c.max_x, t.max_x) - greatest(c.min_x, t.min_x), 0) * greatest(least(c.max_y, t.max_y) - greatest(c.min_y, t.min_y), 0), 6)"
HOLDS = "((c.min_x + c.max_x) / 2 between t.min_x and t.max_x and (c.min_y + c.max_y) / 2 between t.min_y and t.max_y)"


@query(f"""with k as (select c.candidate_id, t.tile_id, {HOLDS} as holds_centre, {SHARED} as shared from {{candidates}} c join {{tiles}} t on c.min_x <= t.max_x and c.max_x >= t.min_x and c.min_y <= t.max_y and c.max_y >= t.min_y),
    n as (select *, row_number() over (partition by candidate_id order by holds_centre desc, shared desc, tile_id) as n from k where holds_centre or shared > 0)
    select candidate_id, tile_id, holds_centre, shared from n where n = 1""")
def seed_tile(spark, d):
    return spatial.seed_tile(load(spark, d, "candidates"), load(spark, d, "tiles"))


@query("""select candidate_id, least(greatest((min_x + max_x) / 2 - s / 2, 0), 26 - s) as x0, least(greatest((min_x + max_x) / 2 - s / 2, 0), 26 - s) + s as x1 from (select *, least((max_x - min_x) * 4, 26) as s from {candidates}) x""")
def display_window(spark, d):
    extent = {"min_x": F.lit(0.0), "min_y": F.lit(0.0), "max_x": F.lit(26.0), "max_y": F.lit(90.0)}
    w = S.display_window(S.box(), extent)
    return load(spark, d, "candidates").select("candidate_id", w["min_x"].alias("x0"), w["max_x"].alias("x1"))


@query("""select watch_id, round(min_x - 500 / (greatest(cos(radians(min_y)), 0.01) * 111320.0), 9) as min_lon, round(min_y - 500 / 111320.0, 9) as min_lat,
    round(min_x + 500 / (greatest(cos(radians(min_y)), 0.01) * 111320.0), 9) as max_lon, round(min_y + 500 / 111320.0, 9) as max_lat from {watchlist}""")
def box_around(spark, d):
    b = S.box_around(F.col("min_x"), F.col("min_y"), F.lit(500.0))
    return load(spark, d, "watchlist").select("watch_id", *[F.round(b[a], 9).alias(n) for a, n in zip(S.BOX, ("min_lon", "min_lat", "max_lon", "max_lat"), strict=True)])


@query("select round(sum((max_x - min_x) * 111.32 * cos(radians((min_y + max_y) / 2)) * (max_y - min_y) * 111.32), 3) as km2, count(*) as scenes from {scenes}")
def footprint_area(spark, d):
    km = 111.32
    a = (F.col("max_x") - F.col("min_x")) * km * F.cos(F.radians((F.col("min_y") + F.col("max_y")) / 2)) * (F.col("max_y") - F.col("min_y")) * km
    return load(spark, d, "scenes").agg(F.round(F.sum(a), 3).alias("km2"), F.count("*").alias("scenes"))


@query()
def grid_references(spark, d):
    """Detections' centres as grid references and UTM; the series has no SQL, it is tested on known points."""
    c = load(spark, d, "candidates").select("candidate_id", ((F.col("min_x") + F.col("max_x")) / 2 + 70).alias("lon"), ((F.col("min_y") + F.col("max_y")) / 2 + 10).alias("lat"))
    at = S.utm(F.col("lon"), F.col("lat"))
    return c.select("candidate_id", S.mgrs(F.col("lat"), F.col("lon")).alias("mgrs"), S.spaced_mgrs(S.mgrs(F.col("lat"), F.col("lon"))).alias("shown"), at["zone"].alias("zone"), F.round(at["easting"], 3).alias("easting"), F.round(at["northing"], 3).alias("northing"))


# --- vectors and search -----------------------------------------------------------------------------------------

SIM = "list_dot_product(cast({a} as double[]), cast({b} as double[]))"
SCORED_AS = f"q as (select tile_id as query_id, embedding as query from {{tiles}} where %s), s as (select query_id, tile_id, scene_id, {SIM.replace('{a}', 'embedding').replace('{b}', 'query')} as similarity from {{tiles}}, q)"
SCORED = SCORED_AS.replace("%s", "tile_id % 20 = 0")
SCORED_77 = SCORED_AS.replace("%s", "tile_id = 77")


def _query_tiles(tiles):
    """The searches' queries: every tile whose id is divisible by 20."""
    return tiles.where(F.col("tile_id") % 20 == 0).select(F.col("tile_id").alias("query_id"), F.col("embedding").alias("query"))


def _nearest(tiles, queries, k, others=False):
    return vector.shown(vector.top_k(pairs.nearest(tiles, queries, k, others), k))


def _scored_77(spark, d):
    tiles = load(spark, d, "tiles")
    return vector.similarities(tiles, tiles.where("tile_id = 77").select(F.col("tile_id").alias("query_id"), F.col("embedding").alias("query")))


def _ranked(where: str, k: int) -> str:
    return f"with {SCORED}, n as (select *, row_number() over (partition by query_id order by similarity desc, tile_id) as rank from s where {where}) select query_id, tile_id, scene_id, round(similarity, 4) as similarity, rank from n where rank <= {k}"


@query(_ranked("true", 10))
def knn_exact(spark, d):
    tiles = load(spark, d, "tiles")
    return _nearest(tiles, _query_tiles(tiles), 10)


@query()
def knn_indexed(spark, d):
    """V2 through an index of lists, read as far as recall needs; a test holds its recall against knn_exact."""
    tiles = load(spark, d, "tiles")
    model = vector.fit_lists(tiles)
    index, queries = raster.kept(vector.indexed(tiles, model)), raster.kept(vector.with_lists(_query_tiles(tiles), model))
    probes = vector.probes_for(index, queries, 10)
    return vector.shown(vector.top_k(vector.nearest_in_lists(index, queries, probes, 10), 10))


@query()
def knn_coded(spark, d):
    """V2 through lists and residual codes, with as many lists as a measured recall of 0.95 asks for; a test holds it
    against knn_exact."""
    tiles = load(spark, d, "tiles")
    model = codes.fit(tiles)
    index, queries = raster.kept(codes.coded(tiles, model)), _query_tiles(tiles)
    return vector.shown(codes.search(index, tiles, queries, model, 10, *codes.plan_for(index, tiles, queries, model, 10)))


@query(_ranked("scene_id in (2, 4)", 5))
def knn_scoped(spark, d):
    tiles = load(spark, d, "tiles")
    return _nearest(tiles.where(F.col("scene_id").isin(2, 4)), _query_tiles(tiles), 5)


@query(_ranked("tile_id <> query_id", 10))
def find_similar(spark, d):
    tiles = load(spark, d, "tiles")
    return _nearest(tiles, _query_tiles(tiles), 10, others=True)


@query(f"with {SCORED} select query_id, tile_id, scene_id, round(similarity, 4) as similarity, cume_dist() over (partition by query_id, scene_id order by similarity) as percentile from s")
def semantic_percentile(spark, d):
    tiles = load(spark, d, "tiles")
    return vector.shown(pairs.percentiles(tiles, _query_tiles(tiles)))


@query("select tile_id, scene_id, round(sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))), 5) as norm, true as finite from {tiles}")
def vector_norms(spark, d):
    t = load(spark, d, "tiles")
    n = vector.normalised(F.transform("embedding", lambda x: x.cast("double")))
    return t.select("tile_id", "scene_id", F.round(F.sqrt(vector.dot(F.col("embedding"), F.col("embedding"))), 5).alias("norm"), vector.finite(n).alias("finite"))


@query("""select candidate_id, (rank() over (partition by job_id order by area_px) - 1 + count(*) over (partition by job_id order by area_px range between unbounded preceding and current row)) / 2e0 / count(*) over (partition by job_id) as percentile from {candidates}""")
def midrank_cluster_pct(spark, d):
    return vector.midrank_percentile(load(spark, d, "candidates"), "job_id", "area_px").select("candidate_id", "percentile")


QUERY_TEXT = "new construction near the growing town"
MEETS = "c.min_x <= t.max_x and c.max_x >= t.min_x and c.min_y <= t.max_y and c.max_y >= t.min_y"


def _best(pool: str) -> str:
    """J6 of a pool of candidates in SQL, for the query of tile 77."""
    return f"""p as (select *, cume_dist() over (partition by query_id, scene_id order by similarity) as percentile from s),
    j as (select c.candidate_id, p.query_id, p.tile_id, similarity, percentile, row_number() over (partition by c.candidate_id order by similarity desc, p.tile_id) as n
      from {pool} c join p on c.scene_b = p.scene_id join {{tiles}} t on p.tile_id = t.tile_id and {MEETS}),
    b as (select * from j where n = 1)"""


BEST = f"{SCORED_77}, {_best('{candidates}')}"


@query(f"with {BEST} select query_id, candidate_id, tile_id, round(similarity, 4) as similarity, percentile from b")
def best_after_tile(spark, d):
    return vector.shown(search.after_tiles(load(spark, d, "candidates"), _scored_77(spark, d), load(spark, d, "tiles")))


#: The scene around which the hybrid search looks.
SCENE = 4
SCOPE = f"""sc as (select p.scene_id from {{places}} p, {{places}} o where o.scene_id = {SCENE} and (p.scene_id = o.scene_id or (p.sensor = o.sensor and p.min_x <= o.max_x and p.max_x >= o.min_x and p.min_y <= o.max_y and p.max_y >= o.min_y))),
    js as (select k.*, a.acquired as date_a, e.acquired as date_b, cast(coalesce(json_extract_string(details, '$.mutual_coverage_after_alignment'), json_extract_string(details, '$.mutual_coverage')) as double) as coverage
      from {{pair_jobs}} k left join {{places}} a on scene_a = a.scene_id left join {{places}} e on scene_b = e.scene_id where scene_a in (select scene_id from sc) and scene_b in (select scene_id from sc)),
    jc as (select * from js where status = 'completed')"""
SCORE = "(0.5e0 * percentile + 0.5e0 * confidence + case when direction in ('appearance', 'expansion') then 0.2e0 else 0e0 end)"
MATCH = f"""{SCORED_77}, {VIEW.strip()}, {SCOPE}, pool as (select v.* from v join jc on v.scene_a = jc.scene_a and v.scene_b = jc.scene_b),
    h as (select t.* from s join {{tiles}} t using (tile_id) where s.scene_id = {SCENE} order by s.similarity desc, t.tile_id limit 10),
    near as (select * from pool c where exists (select 1 from h t where {MEETS})), {_best('near')},
    rt as (select near.*, query_id, tile_id, similarity, percentile, {SCORE} as raw from near left join b using (candidate_id)),
    mt as (select query_id, candidate_id, tile_id, round(similarity, 4) as similarity, percentile, confidence, direction, change_type, review, {sql_round('raw', 4)} as score
      from rt where percentile >= 0.75 order by score desc, confidence desc, area_px desc, candidate_id limit 50)"""


def _search(spark, d):
    tables = (load(spark, d, t) for t in ("tiles", "places"))
    return search.change_search(_view(spark, d), load(spark, d, "pair_jobs"), _scored_77(spark, d), *tables, QUERY_TEXT, SCENE)


@query(f"with {MATCH} select * from mt")
def hybrid_change_search(spark, d):
    return _search(spark, d).matches


@query(f"""with {MATCH}, o as (select (select count(*) from js) as jobs, (select count(*) from jc) as completed, (select min(date_a) from jc) as first_date, (select max(date_b) from jc) as last_date, (select min(coverage) from jc) as valid_coverage,
      (select coalesce(string_agg(distinct cast(x as varchar), ',' order by cast(x as varchar)), '') from (select date_a as x from jc union select date_b from jc) y where x is not null) as dates_analysed,
      (select count(*) from pool) as changes, (select count(*) from rt where percentile >= 0.75) as matching, (select count(*) from rt where percentile is null) as unscored)
    select *, case when completed = 0 then 'no_comparison_available' when changes = 0 then 'no_change_detected' when matching = 0 then 'no_match' else 'found' end as status from o""")
def search_status(spark, d):
    return _search(spark, d).status


@query(f"with {VIEW.strip()}, {SCOPE}, n as (select scene_a, scene_b, count(*) as candidates from v group by scene_a, scene_b) select jc.scene_a, jc.scene_b, date_a, date_b, coverage, coalesce(candidates, 0) as candidates from jc left join n using (scene_a, scene_b)")
def searched_pairs(spark, d):
    return search.searched_pairs(_search(spark, d))


@query(f"with {SCOPE} select scene_id from sc")
def scope_of_scene(spark, d):
    return search.scope_scenes(load(spark, d, "places"), SCENE)


@query(f"with {SCORED}, x as (select s.query_id, s.tile_id, s.scene_id, t.min_x, t.min_y, t.max_x, t.max_y, name, acquired, similarity, row_number() over (partition by query_id order by similarity desc, s.tile_id) as rank from s join {{tiles}} t on s.tile_id = t.tile_id join {{places}} p on s.scene_id = p.scene_id) select * replace (round(similarity, 4) as similarity) from x where rank <= 10")
def search_hits(spark, d):
    tiles = load(spark, d, "tiles")
    return search.search_hits(tiles, _query_tiles(tiles), load(spark, d, "places"))


@query(f"with {BEST} select count(*) as candidates, count(*) - count(b.candidate_id) as unscored from {{candidates}} c left join b on c.candidate_id = b.candidate_id")
def unscored_count(spark, d):
    c = load(spark, d, "candidates").select("candidate_id")
    found = best_after_tile(spark, d).select("candidate_id", F.lit(1).alias("_f"))
    return c.join(found, "candidate_id", "left").agg(F.count("*").alias("candidates"), F.count_if(F.col("_f").isNull()).alias("unscored"))


@query(f"""with k as (select t.tile_id, {HOLDS} as h, {SHARED} as s, t.embedding as query from {{candidates}} c join {{tiles}} t on c.scene_b = t.scene_id and {MEETS} where c.candidate_id = 12),
    sd as (select tile_id as query_id, query from k where h or s > 0 order by h desc, s desc, tile_id limit 1),
    s as (select tile_id, scene_id, query_id, {SIM.replace('{a}', 'embedding').replace('{b}', 'query')} as similarity, min_x, min_y, max_x, max_y from {{tiles}}, sd),
    o as (select c.* from {{candidates}} c join {{pair_jobs}} k on c.scene_a = k.scene_a and c.scene_b = k.scene_b and k.status = 'completed' where c.candidate_id <> 12),
    j as (select c.candidate_id, c.confidence, c.area_px, t.tile_id, t.query_id, similarity, row_number() over (partition by c.candidate_id order by similarity desc, t.tile_id) as n from o c join s t on c.scene_b = t.scene_id and {MEETS})
    select candidate_id, tile_id, round(similarity, 4) as similarity from j where n = 1 and tile_id <> query_id order by round(similarity, 4) desc, confidence desc, area_px desc, candidate_id limit 10""")
def similar_changes(spark, d):
    return search.similar_changes(load(spark, d, "candidates"), load(spark, d, "pair_jobs"), 12, load(spark, d, "tiles"))


def _hint_sql() -> str:
    from .params import HINTS

    parts = [f"case when list_has_any(w, [{', '.join(repr(x) for x in words)}]) then '{name}' end" for name, words in HINTS.items()]
    return f"select id, array_to_string(list_filter([{', '.join(parts)}], lambda x: x is not null), ',') as hints from (select id, regexp_split_to_array(lower(text || case when id % 4 = 0 then ' Newly built, growing SPRAWL' when id % 4 = 1 then ' receding; cleared' else '' end), '[^\\p{{L}}]+') as w from {{texts}}) x"


def _hints(spark, d):
    t = load(spark, d, "texts")
    tail = F.when(F.col("id") % 4 == 0, " Newly built, growing SPRAWL").when(F.col("id") % 4 == 1, " receding; cleared").otherwise("")
    return t.select("id", F.array_join(S.hinted_directions(F.concat("text", tail)), ",").alias("hints"))


_hints.__name__ = "direction_hints"
query(_hint_sql())(_hints)


# --- seasons, scores, exports, metrics --------------------------------------------------------------------------


DOY = "dayofyear(make_date(2001, month({x}), case when month({x}) = 2 then least(day({x}), 28) else day({x}) end))"


@query(f"""with c as (select scene_id as candidate_id, sensor, acquired, (min_x + max_x) / 2 as x, (min_y + max_y) / 2 as y, case when scene_id % 13 = 0 then null else ndvi end as current from {{scenes}}),
    g as (select c.candidate_id, case when s.clear then s.ndvi end as v, abs({DOY.replace('{x}', 'c.acquired')} - {DOY.replace('{x}', 's.acquired')}) as gap from c join {{scenes}} s on c.sensor = s.sensor and year(s.acquired) < year(c.acquired) and c.x between s.min_x and s.max_x and c.y between s.min_y and s.max_y),
    h as (select candidate_id, count(*) as priors, count(v) as n_clear, avg(v) as mean, stddev_samp(v) as std from g where least(gap, 365 - gap) <= 30 group by candidate_id),
    o as (select c.candidate_id, coalesce(priors, 0) as priors, coalesce(n_clear, 0) as n_clear, mean, std, case when coalesce(n_clear, 0) < 3 or current is null then 'unverified' when mean - current <= 2 * greatest(coalesce(std, 0), 0.05) then 'seasonal' else 'anomalous' end as status from c left join h on c.candidate_id = h.candidate_id)
    select candidate_id, priors, n_clear, round(mean, 6) as prior_mean, round(std, 6) as prior_std, status, case status when 'seasonal' then 0.5 when 'unverified' then 0.85 else 1.0 end as factor from o""")
def seasonal_verdict(spark, d):
    s = load(spark, d, "scenes")
    c = s.select(F.col("scene_id").alias("candidate_id"), "sensor", "acquired", ((F.col("min_x") + F.col("max_x")) / 2).alias("x"), ((F.col("min_y") + F.col("max_y")) / 2).alias("y"), F.when(F.col("scene_id") % 13 != 0, F.col("ndvi")).alias("current"))
    return seasonal.seasonal_history(c, s)


@query(f"with {VIEW} select candidate_id, change_type, mean_dndvi from v where change_type in ('clearance', 'vegetation_loss', 'vegetation_retreat') and abs(mean_dndvi) > 0.15")
def seasonal_eligible(spark, d):
    return _view(spark, d).where(S.seasonal_eligible(F.col("change_type"), F.col("mean_dndvi"))).select("candidate_id", "change_type", "mean_dndvi")


@query(f"select candidate_id, {sql_round('x', 6)} as confidence from (select candidate_id, least(greatest(0.35e0 * least(area_px / 5000e0, 1e0) + 0.35e0 * confidence + 0.15e0 + 0.15e0 * confidence * 0.9e0, 0e0), 1e0) as x from {{candidates}}) y")
def confidence_score(spark, d):
    c = F.col("confidence")
    return load(spark, d, "candidates").select("candidate_id", S.py_round(S.confidence(F.col("area_px") / 5000, c, c, F.lit(0.9)), 6).alias("confidence"))


@query("""select kind, count(*) as n, round(avg(value), 1) as mean, round(quantile_cont(value, 0.5), 1) as p50, round(quantile_cont(value, 0.95), 1) as p95, round(quantile_cont(value, 0.99), 1) as p99, max(value) as max
    from (select *, row_number() over (partition by kind order by ts desc, event_id desc) as n from {latencies}) x where n <= 1000 group by kind""")
def latency_percentiles(spark, d):
    over = Window.partitionBy("kind").orderBy(F.desc("ts"), F.desc("event_id"))
    last = load(spark, d, "latencies").withColumn("_n", F.row_number().over(over)).where("_n <= 1000")  # a report on the latest thousand
    q = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = last.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("value"), 1).alias("mean"), q.alias("q"), F.max("value").alias("max"))
    return out.select("kind", "n", "mean", *[F.round(F.col("q")[i], 1).alias(k) for i, k in enumerate(("p50", "p95", "p99"))], "max")


@query("select * from (select 'ingest' as operation, scene_id as id, cast(acquired as timestamp) as at from {scenes} union all select 'change', candidate_id, found_at from {candidates}) x")
def runs_timeline(spark, d):
    a = load(spark, d, "scenes").select(F.lit("ingest").alias("operation"), F.col("scene_id").alias("id"), F.col("acquired").cast("timestamp_ntz").alias("at"))
    return a.unionByName(load(spark, d, "candidates").select(F.lit("change").alias("operation"), F.col("candidate_id").alias("id"), F.col("found_at").alias("at")))


@query(f"""with n as (select job_id, count(*) as raw, count(*) filter (where confidence >= 0.3) as passed from {{candidates}} group by job_id), x as (select *, least(passed, 1000) as stored, passed - least(passed, 1000) as over_cap, (1e0 - passed / cast(raw as double)) * 100e0 as r from n)
    select job_id, raw, stored, over_cap, stored + over_cap as full_n, {sql_round('r', 1)} as reduction from x""")
def ablation_reduction(spark, d):
    """What the safeguards remove: stored detections and those that only the cap left out, against raw ones."""
    c = load(spark, d, "candidates")
    stored = catalog.area_capped(c, "job_id", 1000, P.area_reserve).groupBy("job_id").agg(F.count("*").alias("stored"))
    n = c.groupBy("job_id").agg(F.count("*").alias("raw"), F.count_if(F.col("confidence") >= P.stored_confidence).alias("passed")).join(stored, "job_id", "left")
    full = F.col("stored") + F.col("over_cap")
    n = n.select("job_id", "raw", F.coalesce("stored", F.lit(0)).alias("stored"), (F.col("passed") - F.coalesce("stored", F.lit(0))).alias("over_cap"))
    return n.select("*", full.alias("full_n"), S.py_round((1 - full / F.col("raw")) * 100, 1).alias("reduction"))


@query(f"""with {VIEW} select candidate_id, direction, change_type, review, round(area_ha, 4) as area_ha,
    '[[[' || min_x || ',' || min_y || '],[' || max_x || ',' || min_y || '],[' || max_x || ',' || max_y || '],[' || min_x || ',' || max_y || '],[' || min_x || ',' || min_y || ']]]' as ring from v where confidence >= 0.4""")
def export_features(spark, d):
    x0, y0, x1, y1 = (F.col(c).cast("string") for c in S.BOX)
    ring = F.concat(F.lit("[[["), F.concat_ws("],[", *[F.concat_ws(",", a, b) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]), F.lit("]]]"))
    return catalog.filtered(_view(spark, d), 0.4).select("candidate_id", "direction", "change_type", "review", F.round("area_ha", 4).alias("area_ha"), ring.alias("ring"))


#: A job's details as the detection plan leaves them, from its scenes' numbers.
DETAILS = """'{"masking":{"scene_a":{"source":"scl","cloud_trust":0.9},"scene_b":{"source":"' || case scene_b % 3 when 0 then 'scl' when 1 then 'qa_pixel' else 'heuristic' end || '","cloud_trust":0.' || (50 + scene_b) || '}},"alignment":{"method":"' ||
    case scene_a % 3 when 0 then 'same_tile' when 1 then 'ecc' else 'orb' end || '","tiles":["43RCL","43RCL"],"rho":0.9' || scene_a || ',"inlier_ratio":0.5,"max_shift_px":1.25},"radiometry":{"tier":"' || case when scene_a = 5 then 'identity","notes":["only 7 valid pixels to fit","band 2: left unchanged"],"was":"' else 'pif' end ||
    '","slope":[1,1,1,1.0' || scene_b || '],"intercept":[0,0,0,12.5],"pif_pixels":' || (scene_a * 1000 + 7) || '},"detection":{"kmeans_centroids":[1.0,' || scene_a || '.5],"difference_band":"B08 (NIR)"},"grouping":{"dilation_px":' || case when scene_b % 2 = 0 then 10 else 5 end || '}}'"""


@query(f"""with {VIEW}, n as (select candidate_id, count(*) as n from {{reviews}} group by candidate_id)
    select v.candidate_id, {sql_round('confidence', 4)} as confidence, {sql_round('mean_dndvi', 4)} as delta_ndvi, {sql_round('area_ha', 2)} as area_ha, review as decision, coalesce(n, 0) as review_count, cast(a.acquired as varchar) as date_a, 'bounding_box' as source, v.min_x as west,
      case scene_b % 3 when 0 then 'SCL' when 1 then 'SCL (A) / QA_PIXEL (B)' else 'SCL (A) / heuristic (B)' end as masking, case scene_a % 3 when 0 then 'same_mgrs_grid' when 1 then 'ecc' else 'orb' end as alignment,
      case when scene_a = 5 then 'none' else 'pif_robust_regression' end as normalisation, 0.9e0 as cloud_trust_a, cast('0.' || (50 + scene_b) as double) as cloud_trust_b, scene_a * 1000 + 7 as pif_pixels, v.change_type, v.direction
    from v left join n on v.candidate_id = n.candidate_id left join {{places}} a on v.scene_a = a.scene_id where review <> 'rejected'""")
def export_geojson(spark, d):
    """One GeoJSON feature a row, read back for the check; export_features.write_features writes the file."""
    jobs = load(spark, d, "pair_jobs").withColumn("details", F.expr(DETAILS))
    f = catalog.exported(load(spark, d, "candidates"), load(spark, d, "reviews"), load(spark, d, "places"), jobs, decisions=["pending", "confirmed"])
    get = lambda path: F.get_json_object("feature", f"$.{path}")
    p = "properties"
    return f.select(
        get("id").cast("long").alias("candidate_id"),
        get(f"{p}.confidence").cast("double").alias("confidence"),
        get(f"{p}.delta_ndvi").try_cast("double").alias("delta_ndvi"),
        get(f"{p}.area_ha").cast("double").alias("area_ha"),
        get(f"{p}.analyst_decision").alias("decision"),
        get(f"{p}.review_count").cast("long").alias("review_count"),
        get(f"{p}.date_a").alias("date_a"),
        get(f"{p}.geometry_source").alias("source"),
        get("geometry.coordinates[0][0][0]").cast("double").alias("west"),
        *[get(f"{p}.processing.{k}").alias(k) for k in ("masking", "alignment", "normalisation")],
        *[get(f"{p}.processing.{k}").cast("double").alias(k) for k in ("cloud_trust_a", "cloud_trust_b")],
        get(f"{p}.processing.pif_pixels").cast("long").alias("pif_pixels"),
        *[get(f"{p}.{k}").alias(k) for k in ("change_type", "direction")],
    )


@query(f"""with {VIEW} select candidate_id, array_to_string(list_filter([
      'Masking: ' || case when scene_b % 3 = 0 then 'SCL-based, CloudTrust A: 0.90, CloudTrust B: 0.' || (50 + scene_b) else 'A: scl, B: ' || case scene_b % 3 when 1 then 'qa_pixel' else 'heuristic' end || ', CloudTrust A: 0.90, CloudTrust B: 0.' || (50 + scene_b) end,
      'Alignment: ' || case scene_a % 3 when 0 then 'Same MGRS tile (T43RCL) — grid verified by definition' when 1 then 'ECC registration, correlation 0.9' || scene_a || '0, largest shift 1.25 px' else 'ORB feature matching, inlier ratio 0.50, largest shift 1.25 px' end,
      'Normalisation: ' || case when scene_a = 5 then 'None applied (too few stable pixels): only 7 valid pixels to fit; band 2: left unchanged' else 'PIF robust regression, ' || case when scene_a > 0 then scene_a || ',007' else '7' end || ' anchor pixels, gain: 1.0' || scene_b || ', offset: 12.5' end,
      'Detection: ' || 'NIR difference → K-Means K=2, change centroid magnitude: ' || scene_a || '.5',
      'Grouping: ' || case when sub_blobs > 1 then case when candidate_id % 5 = 0 then 'Large-area change: merged' else 'Merged' end || ' from ' || sub_blobs || ' change blobs less than ' || case when candidate_id % 7 = 3 then 42 when candidate_id % 5 = 0 then 60 when scene_b % 2 = 0 then 20 else 10 end || ' px apart; area, outline and ΔNDVI are those of the blobs themselves' end,
      'Direction: ' || case when candidate_id % 4 = 0 then 'Not classified (analysed before direction classification, or without a NIR band)' else upper(direction[1]) || direction[2:] || ' — dominant class A: vegetation, dominant class B: bare' || case when direction = 'unclassified' then ' (no rule)' else '' end end,
      'Evidence: ' || case when mean_dndvi is not null then 'ΔNDVI: ' || printf('%.2f', {sql_round('mean_dndvi', 2)}) end,
      'Seasonality: ' || case seasonality when 'unverified' then 'Unverified — ' || candidate_id % 3 || ' clear same-season prior observation' || case when candidate_id % 3 = 1 then '' else 's' end || ' (needs 3); confidence ×0.85'
        when 'seasonal' then 'Seasonal — NDVI 0.50 against a same-season mean of 0.55 (±0.05) over ' || candidate_id % 3 || ' prior years; within 2 std devs, confidence ×0.5'
        when 'anomalous' then 'Anomalous — NDVI 0.50 against a same-season mean of 0.55 (±0.05) over ' || candidate_id % 3 || ' prior years; drop exceeds 2 std devs, confidence unchanged' end], lambda x: x is not null), ' | ') as trace from v""")
def trace_lines(spark, d):
    """F32 over details in JSON."""
    jobs = load(spark, d, "pair_jobs").withColumn("details", F.expr(DETAILS))
    i = F.col("candidate_id")
    num = lambda x: F.lit(x).cast("double")
    own = {k: F.col(k) for k in ("sub_blobs", "direction", "mean_dndvi", "seasonality")}
    own |= {"merged_dilation": F.when(i % 7 == 3, 21).when(i % 7 == 4, 0), "large_area": i % 5 == 0, "dominant_a": F.when(i % 4 != 0, "vegetation"), "dominant_b": F.lit("bare"), "rule": F.lit("no rule")}
    own |= {"priors_clear": i % 3, "current_ndvi": num(0.5), "prior_mean": num(0.55), "prior_std": num(0.05)}
    found = catalog.traced(catalog.repaired(load(spark, d, "candidates")), jobs, own)
    return found.select("candidate_id", F.array_join(F.transform("trace", lambda x: F.concat(x["label"], F.lit(": "), x["text"])), " | ").alias("trace"))


@query("""with w as (select k.scene_a, k.scene_b, a.acquired as date_a, b.acquired as date_b, cast(coalesce(json_extract_string(details, '$.mutual_coverage_after_alignment'), json_extract_string(details, '$.mutual_coverage')) as double) as coverage,
      greatest(a.min_x, b.min_x) as min_x, greatest(a.min_y, b.min_y) as min_y, least(a.max_x, b.max_x) as max_x, least(a.max_y, b.max_y) as max_y
      from {pair_jobs} k join {places} a on k.scene_a = a.scene_id join {places} b on k.scene_b = b.scene_id where status = 'completed')
    select scene_a, scene_b, date_a, date_b, datediff('day', date_a, date_b) as days, min_x, min_y, max_x, max_y, coverage as confidence_in_absence, min(coverage) over () as valid_coverage, 100 as minimum_mapping_unit_px, 0.3e0 as minimum_confidence,
      'This area was observed on the listed dates with ' || printf('%.0f', coverage * 100) || '% valid coverage. No changes were detected above the confidence threshold.' as statement from w where min_x < max_x and min_y < max_y
      and not exists (select 1 from {candidates} c where c.scene_a = w.scene_a and c.scene_b = w.scene_b and c.confidence >= 0.999)""")
def negative_evidence(spark, d):
    """Analysed pairs without a detection of that confidence."""
    k = load(spark, d, "pair_jobs").where("status = 'completed'")
    w = spatial.pair_windows(k.select("scene_a", "scene_b"), load(spark, d, "places"))
    coverage = k.select("scene_a", "scene_b", S.job_coverage(F.col("details")).alias("confidence_in_absence"))
    return catalog.negative_evidence(w, load(spark, d, "candidates").where("confidence >= 0.999"), coverage)


def _date_sql() -> str:
    """The forms of a date in SQL, whose patterns know no looking ahead."""
    day = "(20[0-9]{2})%s(0[1-9]|1[0-2])%s(0[1-9]|[12][0-9]|3[01])"
    forms = [f"(?:^|[^0-9]){day % ('', '')}T[0-9]{{6}}", f"(?:^|[^0-9]){day % ('-', '-')}(?:$|[^0-9])", f"(?:^|[^0-9]){day % ('', '')}(?:$|[^0-9])"]
    return "case " + " ".join(f"when regexp_matches(name, '{p}') then " + " || '-' || ".join(f"regexp_extract(name, '{p}', {i})" for i in (1, 2, 3)) for p in forms) + " end"


NAMES = """select *, upper(name) as u from (select id, name from {products} union all select id + 1000000, case id % 8 when 0 then 'CARTOSAT2_' || id || '.tif' when 1 then 'le07_' || id when 2 then 'LT05-2019-03-02' when 3 then 'Landsat_5 20210230' when 4 then 'x_MSIL2A_20191301T101010'
      when 5 then 'liss-4_20200131T235959' when 6 then 'LISS_III_1998-01-01' else 'T43RGM_S2_' || id end from {products}) y"""


@query(f"""select id, case when regexp_matches(u, 'S2[AB]?|SENTINEL[-_]?2|MSIL[12][AC]') then 'sentinel2' when contains(u, 'LC09') then 'landsat9' when regexp_matches(u, 'LC08|LT0[45]|LE07|LANDSAT') then 'landsat8'
      when regexp_matches(u, 'LISS[_-]?(3|III)($|[^0-9A-Z])') then 'liss3' when regexp_matches(u, 'LISS[_-]?[0-9]|CARTOSAT|BHUVAN') then 'bhuvan' else 'unknown' end as sensor,
    try_cast({_date_sql()} as date) as acquired, nullif(regexp_extract(name, '(?:^|[_.-])T([0-9]{{2}}[C-HJ-NP-X][A-Z]{{2}})(?:$|[_.-])', 1), '') as tile from ({NAMES}) z""")
def filename_sensor_date(spark, d):
    n = F.col("name")
    made = F.expr("""case id % 8 when 0 then 'CARTOSAT2_' || id || '.tif' when 1 then 'le07_' || id when 2 then 'LT05-2019-03-02' when 3 then 'Landsat_5 20210230' when 4 then 'x_MSIL2A_20191301T101010'
      when 5 then 'liss-4_20200131T235959' when 6 then 'LISS_III_1998-01-01' else 'T43RGM_S2_' || id end""")
    names = load(spark, d, "products").select("id", "name")
    names = names.union(names.select(F.col("id") + 1000000, made))
    return names.select("id", S.detect_sensor(n).alias("sensor"), S.acquisition_date(n).alias("acquired"), S.tile_code(n).alias("tile"))


@query("select id, regexp_replace(name, '[^0-9A-Za-z_.-]', '_', 'g') as safe, nullif(regexp_extract(name, '(?i)^LC0[89]_L2SP_([0-9]{3})[0-9]{3}_[0-9]{8}_[0-9]{8}_[0-9]{2}_(T1|T2|RT)', 1), '') as path from {products}")
def safe_names(spark, d):
    n = F.col("name")
    return load(spark, d, "products").select("id", S.safe_id(n).alias("safe"), S.landsat_name(n)["path"].alias("path"))


@query("""select id, case when length(q) > 500 or not regexp_matches(q, '\\S') then 'query' when not k between 1 and 100 then 'top_k' when not regexp_matches(s, '^[a-zA-Z0-9_.-]{1,200}$') then 'scene_id' end as problem, k as top_k
    from (select p_partkey as id, case when p_partkey % 9 = 0 then ' ' else p_name end as q, coalesce(case when p_partkey % 4 > 0 then p_size * 3 end, 10) as k, case when p_partkey % 5 = 0 then p_brand when p_partkey % 5 = 1 then replace(p_brand, '#', '-') end as s from part) x""")
def checked_searches(spark, d):
    i = F.col("p_partkey")
    rows = spark.read.parquet(f"{d}/part.parquet").select(
        i.alias("id"),
        F.when(i % 9 == 0, " ").otherwise(F.col("p_name")).alias("query"),
        F.when(i % 4 > 0, F.col("p_size") * 3).alias("top_k"),
        F.when(i % 5 == 0, F.col("p_brand")).when(i % 5 == 1, F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("scene_id"),
    )
    return requests.checked_searches(rows).select("id", "problem", "top_k")


@query("""with l as (select user_id as job_id, case event_type when 'view' then 'queued' when 'click' then 'running' when 'purchase' then 'completed' when 'error' then 'failed' else 'alignment_failed' end as state, ts as "at", event_id as seq from events)
    select job_id, arg_max(state, row("at", seq)) as state, max("at") as "at", count(*) as entries, case when arg_max(state, row("at", seq)) = 'running' then 'queued' else arg_max(state, row("at", seq)) end as effective from l group by job_id""")
def job_states(spark, d):
    kind = F.col("event_type")
    state = F.when(kind == "view", "queued").when(kind == "click", "running").when(kind == "purchase", "completed").when(kind == "error", "failed").otherwise("alignment_failed")
    return catalog.job_states(load(spark, d, "events").select(F.col("user_id").alias("job_id"), state.alias("state"), F.col("ts").alias("at"), F.col("event_id").alias("seq")))


@query(f"with {ALERTS} select watch_id, candidate_id, case when candidate_id % 3 = 0 then timestamp '2024-01-01' when watch_id in (1, 3, 7) then timestamp '2024-02-02' end as acknowledged_at from al")
def acknowledge(spark, d):
    stamp = lambda x: F.lit(x).cast("timestamp_ntz")
    a = _alerts(spark, d).select("watch_id", "candidate_id", F.when(F.col("candidate_id") % 3 == 0, stamp("2024-01-01")).alias("acknowledged_at"))
    ids = load(spark, d, "watchlist").where(F.col("watch_id").isin(1, 3, 7))
    return catalog.acknowledged(a, ids, stamp("2024-02-02"))


@query("select event_type as operation, case user_id % 4 when 0 then 'normalisation' when 1 then 'classification' when 2 then 'detection' else 'masking' end as stage, round(sum(value), 2) as ms, count(*) as runs from events group by all")
def stage_timings(spark, d):
    stage = F.element_at(F.array(*map(F.lit, ("radiometry", "direction", "detection", "masking"))), (F.col("user_id") % 4).cast("int") + 1)
    rows = load(spark, d, "events").select(F.col("event_type").alias("operation"), stage.alias("stage"), F.col("value").alias("ms"))
    return catalog.stage_timings(rows, {"radiometry": "normalisation", "direction": "classification"}).withColumn("ms", F.round("ms", 2))


@query("""with t as (select scene_id, count(*) as tiles from {tiles} where tile_id % 20 <> scene_id group by scene_id) select p.scene_id, coalesce(tiles, 0) as tiles, case when p.scene_id = 4 then 'embedding' when tiles > 0 then 'ready' else 'not_embedded' end as status from {places} p left join t using (scene_id)""")
def embedding_status(spark, d):
    places = load(spark, d, "places")
    running = places.where("scene_id = 4").select("scene_id", F.lit("embedding").alias("state"))
    return catalog.embedding_status(places, load(spark, d, "tiles").where("tile_id % 20 <> scene_id"), running)


@query("""with e as (select pipeline_id, min(seq) as end_seq, arg_min(state, seq) as pipeline_state from {step_events} where step is null group by pipeline_id),
    s as (select v.pipeline_id, step, coalesce(any_value(pipeline_state), 'running') as pipeline_state, min(seq) as first_seq, arg_max(state, seq) as noted, arg_max(done, seq) filter (where total is not null) as done, max(total) as total,
        min(noted_at) filter (where state = 'active') as began, max(noted_at) filter (where state in ('done', 'failed', 'skipped')) as ended
      from {step_events} v left join e on v.pipeline_id = e.pipeline_id where step is not null and (end_seq is null or seq < end_seq) group by v.pipeline_id, step)
    select pipeline_id, pipeline_state, (select count(*) from s o where o.pipeline_id = s.pipeline_id and o.first_seq <= s.first_seq) as place, step,
        case when pipeline_state = 'done' and noted in ('pending', 'active') then 'skipped'
             when pipeline_state = 'failed' and noted = 'active' and not exists (select 1 from s o where o.pipeline_id = s.pipeline_id and o.noted = 'active' and o.first_seq < s.first_seq) then 'failed' else noted end as state,
        done, total, case when ended >= began then (epoch_us(ended) - epoch_us(began)) / 1e6 end as seconds from s""")
def step_progress(spark, d):
    """I6."""
    return catalog.step_progress(load(spark, d, "step_events"))


@query(f"select candidate_id, {sql_round('(min_x * 15 - 180)', 6)} as lon, {sql_round('(min_y * 8 - 76)', 6)} as lat from {{candidates}}")
def utm_and_back(spark, d):
    """F37 both ways: the SQL is what went in."""
    lat = F.col("min_y") * 8 - 76
    at = S.utm(F.col("min_x") * 15 - 180, lat)
    back = S.lonlat(at["zone"], at["easting"], at["northing"], lat < 0)
    return load(spark, d, "candidates").select("candidate_id", *[F.round(back[k], 6).alias(k) for k in ("lon", "lat")])


@query("select tile_id, row_number() over (order by tile_id) - 1 as dense_id from {tiles} where scene_id <> 3")
def renumber_ids(spark, d):
    return vector.renumbered(load(spark, d, "tiles").where("scene_id <> 3").select("tile_id"), "tile_id")


@query(f"""with v as (select candidate_id, case candidate_id % 3 when 0 then 'seasonal' when 1 then 'unverified' end as status, case candidate_id % 3 when 0 then 0.5e0 else 0.85e0 end as factor from {{candidates}} where candidate_id % 7 < 5 and candidate_id % 3 < 2),
    x as (select c.candidate_id, coalesce(seasonality, status) as seasonality, case when seasonality is null and status is not null then confidence * factor else confidence end as raw from {{candidates}} c left join v on c.candidate_id = v.candidate_id)
    select candidate_id, seasonality, {sql_round('raw', 6)} as confidence from x""")
def seasonal_annotation(spark, d):
    c = load(spark, d, "candidates").select("candidate_id", "seasonality", "confidence")
    k = F.col("candidate_id") % 3
    v = c.where("candidate_id % 7 < 5 and candidate_id % 3 < 2").select("candidate_id", F.when(k == 0, "seasonal").otherwise("unverified").alias("status"), F.when(k == 0, 0.5).otherwise(0.85).alias("factor"))
    return seasonal.annotated(c, v).withColumn("confidence", S.py_round(F.col("confidence"), 6))


@query(f"""with odd as (select * from {{scenes}} where scene_id % 2 = 1)
    select scene_a, scene_b from (with {JOBS.replace('{scenes}', 'odd')} select * from jb) x union select scene_a, scene_b from (with {JOBS} select * from jb) y""")
def incremental_pairs(spark, d):
    """I1-I3 through a stream of scene files, odd ids first: a pair once planned stays when a scene comes between."""
    return _through_stream(spark, d, "pairs")


@query(f"with {ALERTS} select * from al where job_id <> 3")
def incremental_alerts(spark, d):
    """I4: of jobs that are completed; the third still runs."""
    return _through_stream(spark, d, "alerts")


@query(f"""with {ALERTS}, k as (select job_id, candidate_id, confidence >= case when job_id in (1, 2) then 0.5 else 0 end as stays from {{candidates}}),
    n as (select job_id, count(*) filter (where stays) as detections from k group by job_id), a as (select al.job_id, count(*) as alerts from al join k on al.candidate_id = k.candidate_id where stays group by al.job_id)
    select n.job_id, case n.job_id when 5 then 'running' else 'completed' end as state, case when n.job_id = 5 then 0 else detections end as detections, case when n.job_id = 5 then 0 else coalesce(alerts, 0) end as alerts from n left join a on n.job_id = a.job_id""")
def replaced_jobs(spark, d):
    """Jobs planned in a stream are run and published with their detections and alerts; two are then run anew
    with a floor on confidence, which takes the alerts of what goes with it. What a run that died has written isn't seen."""
    top = f"{raster.shared_dir(spark)}/jobs-{uuid.uuid4().hex}"
    c = load(spark, d, "candidates").select("job_id", "candidate_id", "confidence", "area_px", *S.BOX)
    watch = load(spark, d, "watchlist")
    kinds = {"detections": "job_id long, candidate_id long, confidence double", "alerts": "job_id long, candidate_id long, watch_id long"}

    def rows(jobs, floor):
        own = c.join(jobs.select("job_id"), "job_id", "left_semi").where(F.col("confidence") >= floor)
        return {"detections": own.select("job_id", "candidate_id", "confidence"), "alerts": spatial.watch_alerts(own, watch).select("job_id", "candidate_id", "watch_id")}

    def run(jobs):
        done = jobs.select("job_id", F.when(F.col("job_id") == 5, "running").otherwise("completed").alias("state"), F.lit("{}").alias("details"))
        return done, rows(jobs.where("job_id <> 5"), 0.0)

    c.select("job_id").distinct().write.parquet(f"{top}/planned")
    for _ in range(2):  # the second time nothing that is final runs
        incremental.job_stream(spark.readStream.schema("job_id long").parquet(f"{top}/planned"), f"{top}/tables", run, f"{top}/state-{uuid.uuid4().hex}").awaitTermination()
    again = spark.createDataFrame([(1, "completed", "{}"), (2, "completed", "{}")], "job_id long, state string, details string")
    rows(again, 0.9)["detections"].withColumn("version", F.lit("died")).write.mode("append").partitionBy("version").parquet(f"{top}/tables/detections")
    versions.publish(again, rows(again, 0.5), f"{top}/tables")
    n = {k: versions.read_table(spark, f"{top}/tables", k, kind).groupBy("job_id").agg(F.count("*").alias(k)) for k, kind in kinds.items()}
    jobs = versions.current_jobs(spark, f"{top}/tables").select("job_id", "state")
    return jobs.join(n["detections"], "job_id", "left").join(n["alerts"], "job_id", "left").na.fill(0, ["detections", "alerts"])


def _through_stream(spark, d, what):
    """Feeds a projection through files in the shared folder, in two batches, and reads what the stream has written."""
    top = f"{raster.shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    rows, key = (load(spark, d, "scenes"), "scene_id") if what == "pairs" else (load(spark, d, "candidates"), "candidate_id")
    for part in (F.col(key) % 2 == 1, F.col(key) % 2 == 0):
        rows.where(part).write.mode("append").parquet(f"{top}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{top}/in")
        if what == "pairs":
            q = incremental.pair_stream(stream, f"{top}/scenes", f"{top}/out", f"{top}/state")
        else:
            completed = lambda: rows.select("job_id").where("job_id <> 3")
            q = incremental.alert_stream(stream, load(spark, d, "watchlist"), f"{top}/out", f"{top}/state", completed)
        q.awaitTermination()
    return spark.read.parquet(f"{top}/out")

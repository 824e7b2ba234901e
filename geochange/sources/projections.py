"""Domain relations as projections of the given tables.

Each projection is one SELECT in the dialect that Spark SQL and DuckDB share, so that a query and its SQL check can't
drift apart; numbers with a point are written with an exponent, which makes them doubles in both. {name} stands for a
given table or another projection.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

PROJECTIONS: dict[str, str] = {
    # Image tiles: a vector, a scene, and a unit box on a grid of 25 columns.
    "tiles": """
        select vec_id as tile_id, cast(label as bigint) as scene_id, embedding,
               cast(vec_id % 25 as double) as min_x, cast(floor(vec_id / 25) as double) as min_y,
               vec_id % 25 + 1.0e0 as max_x, floor(vec_id / 25) + 1.0e0 as max_y
        from {embeddings}""",
    # Change detections between two of the tiles' scenes.
    "candidates": """
        select o_orderkey as candidate_id, cast(substring(o_orderpriority, 1, 1) as bigint) as job_id,
               o_custkey % 10 as scene_a, (o_custkey + 1 + o_orderkey % 9) % 10 as scene_b, o_custkey as place,
               (o_orderkey * 7 % 240) / 10.0e0 as min_x, (o_orderkey * 13 % 190) / 10.0e0 as min_y,
               (o_orderkey * 7 % 240) / 10.0e0 + 0.5e0 + (o_custkey % 10) / 10.0e0 as max_x,
               (o_orderkey * 13 % 190) / 10.0e0 + 0.5e0 + (o_custkey % 7) / 10.0e0 as max_y,
               (o_orderkey * 7919 % 10001) / 10000.0e0 as confidence,
               100 + o_custkey * 37 % 5000 as area_px,
               case when o_orderkey % 5 = 0 then null else (100 + o_custkey * 37 % 5000) / 100.0e0 end as area_ha,
               case when o_orderkey % 11 = 0 then null else ((o_orderkey * 31) % 2001 - 1000) / 2000.0e0 end as mean_dndvi,
               case o_orderkey % 9 when 0 then 'clearance' when 1 then 'construction' when 2 then 'revegetation' when 3 then 'urban_expansion'
                    when 4 then 'vegetation_loss' when 5 then 'vegetation_retreat' when 6 then 'water_loss' when 7 then 'legacy_kind' else null end as raw_type,
               case o_orderkey % 6 when 0 then 'appearance' when 1 then 'disappearance' when 2 then 'expansion' when 3 then 'contraction'
                    when 4 then 'unclassified' else null end as raw_direction,
               case when o_orderkey % 4 = 0 then null else o_orderkey % 4 + 1 end as raw_sub_blobs,
               case o_orderkey % 5 when 1 then 'seasonal' when 2 then 'anomalous' when 3 then 'unverified' else null end as seasonality,
               o_orderdate as found_at
        from {orders}""",
    # Reviews, append-only; seq orders those of a candidate, as (order, line number) is not unique.
    "reviews": """
        select l_orderkey as candidate_id, case when l_returnflag = 'R' then 'rejected' else 'confirmed' end as decision, l_shipdate as reviewed_at,
               row_number() over (partition by l_orderkey order by l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice) as seq
        from {lineitem}""",
    # Scenes of one sensor (a customer) over time, with overlapping footprints.
    "scenes": """
        select o_orderkey as scene_id, o_custkey as sensor, cast(o_orderdate as date) as acquired,
               (o_orderkey % 7) / 2.0e0 as min_x, (o_orderkey % 5) / 2.0e0 as min_y, (o_orderkey % 7) / 2.0e0 + 2.0e0 as max_x, (o_orderkey % 5) / 2.0e0 + 2.0e0 as max_y,
               (o_orderkey * 17 % 1000) / 1000.0e0 as ndvi, o_orderkey % 8 <> 0 as clear
        from {orders}""",
    # The ten scenes of the tiles.
    "places": """
        select cast(label as bigint) as scene_id, 'scene_' || label as name, case when label % 3 = 0 then 'landsat8' else 'sentinel2' end as sensor,
               date '2024-01-01' + cast(label * 20 as int) as acquired, label * 1.5e0 as min_x, label * 1.0e0 as min_y, label * 1.5e0 + 9.0e0 as max_x, label + 12.0e0 as max_y
        from (select distinct label from {embeddings}) x""",
    # Analyses of pairs of scenes: state, and details as JSON in which the coverage after alignment may be missing. Braces
    # are written by number, as they name tables here.
    "pair_jobs": """
        select scene_a, scene_b, case (scene_a * 7 + scene_b * 3) % 5 when 0 then 'insufficient_evidence' when 1 then 'failed' else 'completed' end as status,
               chr(123) || '"mutual_coverage":0.' || (30 + (scene_a * 5 + scene_b) % 60) || case when (scene_a + scene_b) % 3 = 0 then '' else ',"mutual_coverage_after_alignment":0.' || (20 + (scene_a * 11 + scene_b * 3) % 70) end
               || ',"ablation":' || chr(123) || '"status":"' || case scene_b % 3 when 0 then 'running' when 1 then 'completed' else 'failed' end || '"' || chr(125) || chr(125) as details
        from (select distinct scene_a, scene_b from {candidates}) x""",
    "watchlist": """
        select cast(n_nationkey as bigint) as watch_id, n_name as name, cast(n_nationkey % 5 * 5 as double) as min_x, floor(n_nationkey / 5) * 4.0e0 as min_y,
               n_nationkey % 5 * 5 + 3.0e0 as max_x, floor(n_nationkey / 5) * 4.0e0 + 2.5e0 as max_y, 0.4e0 + (n_nationkey % 6) / 10.0e0 as threshold
        from {nation}""",
    # A raster of 100 columns, two dates, four bands as reflectance in ten-thousandths.
    "pixels": """
        select cast(floor(event_id / 100) as bigint) as r, event_id % 100 as c, event_id * 7 % 12 as scl_a, event_id * 11 % 13 as scl_b,
               300 + (user_id * 17 + event_id * 3) % 900 as b02_a, 400 + (user_id * 23 + event_id * 5) % 900 as b03_a,
               300 + (user_id * 29 + event_id) % 1500 as b04_a, 800 + (event_id * 13 + user_id * 7) % 2800 as b08_a,
               320 + (user_id * 19 + event_id * 3) % 900 as b02_b, 420 + (user_id * 31 + event_id * 5) % 900 as b03_b,
               310 + (user_id * 37 + event_id * 2) % 1600 as b04_b,
               case when (floor(event_id / 1200) + floor(event_id % 100 / 9)) % 4 = 0 then 100 else 800 end + (event_id * 13 + user_id * 7) % 2800 + event_id % 50 as b08_b,
               event_id * 3 % 64 as qa, value
        from {events}""",
    # The same with masks as scenes have them: whole stripes under cloud, the rest clear.
    "clear_pixels": """
        select r, c, case when r % 25 = 24 then 9 else 4 end as scl_a, case when c % 40 = 39 then 3 else 5 end as scl_b, b02_a, b03_a, b04_a, b08_a, b02_b, b03_b, b04_b,
               case when floor(r / 40) % 2 = 0 and c between 20 and 45 and r % 40 between 10 and 34 then 3 * b08_b else b08_b end as b08_b from {pixels}""",
    # Patches of marked pixels, for morphology and components.
    "marked": """
        select r, c from (select cast(floor(event_id / 100) as bigint) as r, event_id % 100 as c from {events}) x
        where (r % 17 < 9 and c % 19 < 11 and (r * 31 + c * 17) % 23 <> 0) or (r * 13 + c * 7) % 41 = 0""",
    "latencies": "select event_type as kind, event_id, ts, value from {events}",
    # What imports report of their steps; a row without a step ends an import.
    "step_events": """
        select user_id as pipeline_id, event_id as seq, ts as noted_at, case when event_id % 17 = 0 then null else 'step_' || (event_id % 11) end as step,
               case when event_id % 17 = 0 then case when event_id % 2 = 0 then 'failed' else 'done' end
                    else case event_id * 3 % 5 when 0 then 'pending' when 1 then 'active' when 2 then 'active' when 3 then 'done' else 'skipped' end end as state,
               case when event_id * 3 % 5 = 2 then event_id % 50 end as done, case when event_id * 3 % 5 = 2 then 50 end as total
        from {events}""",
    "products": """
        select p_partkey as id,
               case p_partkey % 7
                 when 0 then 'S2A_MSIL2A_202401' || substring('' || (10 + p_partkey % 19), 1, 2) || 'T052141_N0510_R062_T43RCL_x.SAFE'
                 when 1 then 'LC09_L2SP_146040_202402' || substring('' || (10 + p_partkey % 18), 1, 2) || '_20240301_02_T1_SR_B4.TIF'
                 when 2 then 'LC08_L2SP_147039_202311' || substring('' || (10 + p_partkey % 20), 1, 2) || '_20231201_02_T2_SR_B5.TIF'
                 when 3 then 'R2_LISS3_2023-05-' || substring('' || (10 + p_partkey % 20), 1, 2) || '_band.tif'
                 when 4 then 'bhuvan export ' || p_brand || '.tif'
                 when 5 then 'mosaic_T44QKE_20240230.tif'
                 else p_name || '.tif' end as name
        from {part}""",
    "texts": "select doc_id as id, text from {documents}",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "conversations")
_NAME = re.compile(r"\{([a-z_]+)\}")


def sql_round(x: str, digits: int) -> str:
    """functions.scalar.py_round in SQL, of a column of doubles."""
    b = f"1e{digits}"
    high = f"({x} * 134217729e0 - ({x} * 134217729e0 - {x}))"
    lacks = f"(({high} * {b} - {x} * {b}) + ({x} - {high}) * {b})"
    over = f"({x} * {b} - floor({x} * {b}))"
    return f"((floor({x} * {b}) + case when {over} > 0.5e0 or ({over} = 0.5e0 and ({lacks} > 0 or ({lacks} = 0 and abs(floor({x} * {b})) % 2 = 1))) then 1 else 0 end) / {b})"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a projection over given tables."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = PROJECTIONS[name]
    return spark.sql(text, **{n: load(spark, sf_dir, n) for n in set(_NAME.findall(text))})


def with_projections(sql: str) -> str:
    """sql with the projections that it names in braces before it, as common table expressions."""
    need: list[str] = []

    def visit(text: str) -> None:
        for n in _NAME.findall(text):
            if n in PROJECTIONS and n not in need:
                visit(PROJECTIONS[n])
                need.append(n)

    visit(sql)
    plain = lambda text: _NAME.sub(r"\1", text)
    head = ", ".join(f"{n} as ({plain(PROJECTIONS[n])})" for n in need)
    body = plain(sql).strip()
    if not head:
        return body
    if body.lower().startswith("with recursive "):
        return f"with recursive {head}, {body[15:]}"
    if body.lower().startswith("with "):
        return f"with {head}, {body[5:]}"
    return f"with {head} {body}"

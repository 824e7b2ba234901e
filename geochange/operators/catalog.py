"""Catalogue operators: views, filters, counters, caps, upserts. Built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..params import P


def latest_review(reviews: DataFrame) -> DataFrame:
    """A1: each candidate's last decision. Combines before the shuffle, so many reviews of one candidate are one row a task."""
    return reviews.groupBy("candidate_id").agg(F.max_by("decision", "seq").alias("review"))


def repaired(candidates: DataFrame) -> DataFrame:
    """Candidates with fields that are missing or of an unknown kind repaired; other columns stay."""
    return candidates.select(
        *[c for c in candidates.columns if not c.startswith("raw_") and c not in ("area_ha", "review")],
        S.normal_type(F.col("raw_type")).alias("change_type"),
        F.coalesce("raw_direction", F.lit("unclassified")).alias("direction"),
        F.coalesce("raw_sub_blobs", F.lit(1)).alias("sub_blobs"),
        F.coalesce("area_ha", F.nullif(F.col("area_px"), F.lit(0)) / 100).alias("area_ha"),
        *(["review"] if "review" in candidates.columns else []),
    )


def candidate_view(candidates: DataFrame, reviews: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Candidates with repaired fields, their review (pending where there is none) and both scenes' names."""
    out = repaired(candidates.join(latest_review(reviews), "candidate_id", "left").withColumn("review", F.coalesce("review", F.lit("pending"))))
    if places is not None:
        for side in "ab":
            named = places.select(F.col("scene_id").alias(f"scene_{side}"), F.col("name").alias(f"scene_{side}_name"))
            out = out.join(named, f"scene_{side}", "left")
    return out


def filtered(view: DataFrame, min_confidence: float = 0.0, types: Sequence[str] | None = None, directions: Sequence[str] | None = None, hide_seasonal: bool = False, jobs: Sequence[int] | None = None, decisions: Sequence[str] | None = None) -> DataFrame:
    """P3-P8 and P15, each only if asked for. An empty list of jobs leaves nothing, None leaves all."""
    if min_confidence > 0:
        view = view.where(F.col("confidence") >= min_confidence)
    for name, wanted in (("change_type", types), ("direction", directions), ("review", decisions)):
        if wanted:
            view = view.where(F.col(name).isin(*wanted))
    if hide_seasonal:
        view = view.where(~F.col("seasonality").eqNullSafe("seasonal"))
    if jobs is not None:
        view = view.where(F.col("job_id").isin(*jobs)) if jobs else view.where(F.lit(False))
    return view


def traced(detections: DataFrame, jobs: DataFrame, c: dict[str, Column]) -> DataFrame:
    """F32: detections with their `trace`. jobs: (scene_a, scene_b, details in JSON), one a pair of scenes; a detection
    without one has the lines of its own alone. Details are read once a job, not once a detection. c: see S.with_trace."""
    told = S.with_job_sentences(jobs.select("scene_a", "scene_b", "details")).drop("details")
    both = detections.join(told, ["scene_a", "scene_b"], "left")
    return S.with_trace(both, c).select(*detections.columns, "trace")


def sort_keys(by: str) -> list[Column]:
    """Orders of the browser, each with the id as the last word."""
    keys = {
        "confidence": [F.desc("confidence"), F.desc("area_px")],
        "area": [F.coalesce("area_ha", F.lit(0.0)).desc(), F.desc("confidence")],
        "date": [F.desc("found_at"), F.desc("confidence")],
    }
    return [*keys[by], F.asc("candidate_id")]


def capped(view: DataFrame, by: str = "confidence", cap: int = P.display_cap) -> DataFrame:
    """The first `cap` of each job, numbered. Spark cuts each task's share of a job to that many before the shuffle."""
    over = Window.partitionBy("job_id").orderBy(*sort_keys(by))
    return view.withColumn("place_in_job", F.row_number().over(over)).where(F.col("place_in_job") <= cap)


def counters(view: DataFrame, min_confidence: float, jobs: DataFrame | None = None) -> DataFrame:
    """A7 by job in one pass: all, matching, excluded by confidence, and reviews in three classes. With jobs (job_id,
    details in JSON) a job without a detection has its row too, `found` is what its trace says was found before storing,
    else what is stored, and what was dropped for its confidence at storing is excluded as well."""
    keep = F.col("confidence") >= min_confidence
    out = view.groupBy("job_id").agg(
        F.count("*").alias("total"),
        F.count_if(keep).alias("matching"),
        F.count_if(~keep).alias("excluded"),
        *[F.count_if(F.col("review") == d).alias(d) for d in ("pending", "confirmed", "rejected")],
    )
    if jobs is None:
        return out
    traced = {k: F.get_json_object("details", f"$.scoring.{k}").try_cast("long") for k in ("candidates_found", "dropped_low_confidence")}
    both = jobs.select("job_id", *[v.alias(f"_{k}") for k, v in traced.items()]).join(out, "job_id", "left").na.fill(0, [c for c in out.columns if c != "job_id"])
    return both.withColumns({"found": F.coalesce("_candidates_found", "total"), "excluded": F.col("excluded") + F.coalesce("_dropped_low_confidence", F.lit(0))}).drop(*[f"_{k}" for k in traced])


def negative_evidence(windows: DataFrame, found: DataFrame, coverage: DataFrame) -> DataFrame:
    """Of analysed pairs (scene_a, scene_b, date_a, date_b, box) without a detection among found: the area, dates and
    coverage, which is how sure an absence is; the least coverage of all such pairs; the thresholds, and the statement, whose
    sentences are fixed values."""
    out = windows.join(found.select("scene_a", "scene_b"), ["scene_a", "scene_b"], "left_anti").join(coverage, ["scene_a", "scene_b"])
    least = out.agg(F.min("confidence_in_absence").alias("valid_coverage"))  # one row
    shown = F.when(F.col("confidence_in_absence").isNull(), "unknown").otherwise(F.concat(S.fixed(F.col("confidence_in_absence") * 100, 0), F.lit("%")))
    said = F.concat(F.lit("This area was observed on the listed dates with "), shown, F.lit(" valid coverage. No changes were detected above the confidence threshold."))
    days = F.datediff("date_b", "date_a").cast("long").alias("days")
    both = out.join(F.broadcast(least), F.lit(True))
    return both.select("scene_a", "scene_b", "date_a", "date_b", days, *S.BOX, "confidence_in_absence", "valid_coverage", F.lit(P.min_blob_px).alias("minimum_mapping_unit_px"), F.lit(P.stored_confidence).alias("minimum_confidence"), said.alias("statement"))


def scene_summaries(places: DataFrame, tiles: DataFrame, candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """A2, A3: tiles, candidates on either side and their reviews of each scene. A candidate of one scene twice counts once."""
    n_tiles = tiles.groupBy("scene_id").agg(F.count("*").alias("tiles"))
    n_reviews = reviews.groupBy("candidate_id").agg(F.count("*").alias("_r"))
    sides = candidates.join(n_reviews, "candidate_id", "left").select(F.explode(F.array_distinct(F.array("scene_a", "scene_b"))).alias("scene_id"), "_r")
    per = sides.groupBy("scene_id").agg(F.count("*").alias("candidates"), F.sum(F.coalesce("_r", F.lit(0))).alias("reviews"))
    out = places.join(n_tiles, "scene_id", "left").join(per, "scene_id", "left")
    return out.select("scene_id", "name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tiles", "candidates", "reviews")])


def review_audit(reviews: DataFrame) -> DataFrame:
    """Reviews as they came, with whether each changed the last decision."""
    over = Window.partitionBy("candidate_id").orderBy("seq")
    return reviews.withColumn("changed", F.coalesce(F.lag("decision").over(over) != F.col("decision"), F.lit(False)))


def upsert(old: DataFrame, new: DataFrame, key: str, keep_old: Sequence[str] = ()) -> DataFrame:
    """New rows replace old ones of their key, but for the columns in keep_old; other old rows stay."""
    both = old.select(F.struct("*").alias("o"), F.col(key).alias("_k")).join(new.select(F.struct("*").alias("n"), F.col(key).alias("_k")), "_k", "full")
    value = [F.when(F.col("n").isNull() | (F.lit(c in keep_old) & F.col("o").isNotNull()), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in old.columns]
    return both.select(*value)


def insert_missing(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is not there yet; of several with one key, one."""
    return old.unionByName(new.dropDuplicates(list(key)).join(old.select(*key), list(key), "left_anti"))


def cascade_counts(scene_ids: DataFrame, tiles: DataFrame, candidates: DataFrame, reviews: DataFrame, alerts: DataFrame) -> DataFrame:
    """How many rows of each table go with the given scenes, children first."""
    sides = candidates.select("candidate_id", F.explode(F.array_distinct(F.array("scene_a", "scene_b"))).alias("scene_id"))
    gone = sides.join(scene_ids, "scene_id", "left_semi").select("candidate_id").distinct()
    parts = {
        "reviews": reviews.join(gone, "candidate_id", "left_semi"),
        "alerts": alerts.join(gone, "candidate_id", "left_semi"),
        "candidates": gone,
        "tiles": tiles.join(scene_ids, "scene_id", "left_semi"),
    }
    counts = [df.agg(F.count("*").alias("deleted")).select(F.lit(name).alias("table_name"), "deleted") for name, df in parts.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def without_scenes(scene_ids: DataFrame, tiles: DataFrame, candidates: DataFrame, reviews: DataFrame, alerts: DataFrame) -> dict[str, DataFrame]:
    """What of each table is left without the given scenes: their tiles, detections of pairs with them, and these
    detections' reviews and alerts go."""
    ids = scene_ids.select("scene_id").distinct()
    left = candidates
    for side in ("scene_a", "scene_b"):
        left = left.join(ids.withColumnRenamed("scene_id", side), side, "left_anti")
    left = left.select(*candidates.columns)
    gone = candidates.select("candidate_id").join(left.select("candidate_id"), "candidate_id", "left_anti").distinct()
    return {
        "tiles": tiles.join(ids, "scene_id", "left_anti").select(*tiles.columns),
        "candidates": left,
        "reviews": reviews.join(gone, "candidate_id", "left_anti").select(*reviews.columns),
        "alerts": alerts.join(gone, "candidate_id", "left_anti").select(*alerts.columns),
    }


def exported(candidates: DataFrame, reviews: DataFrame, places: DataFrame, jobs: DataFrame, job_id: int | None = None, min_confidence: float = 0.0, decisions: Sequence[str] | None = None) -> DataFrame:
    """(candidate_id, feature): detections with a filter by job, confidence and decision, each as a GeoJSON feature
    with where it comes from; an outline where candidates have a `geometry` in JSON, else the box."""
    v = filtered(candidate_view(candidates, reviews), min_confidence, jobs=None if job_id is None else [job_id], decisions=decisions)
    v = v.join(reviews.groupBy("candidate_id").agg(F.count("*").alias("review_count"), F.max_by("reviewed_at", "seq").cast("string").alias("reviewed_at")), "candidate_id", "left")
    for side in "ab":
        own = places.select(F.col("scene_id").alias(f"scene_{side}"), F.col("name").alias(f"scene_{side}_id"), F.col("acquired").cast("string").alias(f"date_{side}"), *([F.col("sensor")] if side == "a" else []))
        v = v.join(own, f"scene_{side}", "left")
    v = v.join(jobs.select("scene_a", "scene_b", "details"), ["scene_a", "scene_b"], "left")
    geometry = F.col("geometry") if "geometry" in v.columns else F.lit(None).cast("string")
    return v.select("candidate_id", S.exported_feature({k: F.col(k) for k in v.columns}, geometry, F.col("details")).alias("feature"))


def write_features(features: DataFrame, path: str) -> None:
    """Features as lines of JSON, a file for each task; readers of GeoJSON sequences take them as they are."""
    features.select(F.col("feature").alias("value")).write.mode("overwrite").text(path)


def area_capped(candidates: DataFrame, partition: str, cap: int, reserve: int, floor: float = P.stored_confidence) -> DataFrame:
    """Of each partition the `reserve` largest (of equal ones the surer), then by confidence, of equals the
    larger, up to `cap`; below the floor nothing.
    Either list is cut in each task before the shuffle; of the `cap` surest at most as many are reserved as there are
    reserved rows, so the two together hold all that is kept. candidate_id is a key."""
    rows = candidates.where(F.col("confidence") >= floor)

    def best(order: list[Column], n: int, reserved: bool) -> DataFrame:
        numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(partition).orderBy(*order)))
        return numbered.where(F.col("_n") <= n).drop("_n").withColumn("reserved", F.lit(reserved))

    large = best([F.desc("area_px"), F.desc("confidence"), F.asc("candidate_id")], reserve, True)
    sure = best([F.desc("confidence"), F.desc("area_px"), F.asc("candidate_id")], cap, False)
    once = Window.partitionBy(partition, "candidate_id").orderBy(F.desc("reserved"))
    both = large.unionByName(sure).withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
    by_conf = Window.partitionBy(partition).orderBy(F.desc("reserved"), F.desc("confidence"), F.desc("area_px"), F.asc("candidate_id"))
    return both.withColumn("place_in_job", F.row_number().over(by_conf)).where(F.col("place_in_job") <= cap)


def merged(members: DataFrame, group: str) -> DataFrame:
    """Members of a group as one candidate. The best member's row, the union of boxes, summed areas (hectares
    only if all are known), the area-weighted mean of the known dNDVI, and the type of most area: named types before
    unclassified, ties by confidence."""
    known = F.col("mean_dndvi").isNotNull()
    base = members.groupBy(group).agg(
        F.max_by("candidate_id", F.struct("confidence", "area_px", -F.col("candidate_id"))).alias("lead_id"),
        F.max("confidence").alias("confidence"),
        F.min("min_x").alias("min_x"),
        F.min("min_y").alias("min_y"),
        F.max("max_x").alias("max_x"),
        F.max("max_y").alias("max_y"),
        F.sum("area_px").alias("area_px"),
        F.when(F.bool_and(F.col("area_ha").isNotNull()), F.round(F.sum("area_ha"), 4)).alias("area_ha"),
        (F.sum(F.when(known, F.col("area_px") * F.col("mean_dndvi"))) / F.sum(F.when(known, F.col("area_px")))).alias("mean_dndvi"),
        F.count("*").alias("members"),
    )
    by_type = members.groupBy(group, "change_type").agg(F.sum("area_px").alias("a"), F.max("confidence").alias("c"))
    rank = F.struct((F.col("change_type") != "unclassified").alias("named"), F.col("a"), F.col("c"), F.col("change_type"))
    types = by_type.groupBy(group).agg(F.max(rank)["change_type"].alias("change_type"), F.max("a").alias("largest_type_px"), F.count("*").alias("n_types"))
    by_dir = members.groupBy(group, "change_type", "direction").agg(F.sum("area_px").alias("a"), F.max("confidence").alias("c"))
    dirs = by_dir.join(types.select(group, "change_type"), [group, "change_type"], "left_semi")
    lead = dirs.groupBy(group).agg(F.max(F.struct("a", "c", "direction"))["direction"].alias("direction"))
    return base.join(types, group).join(lead, group)


#: States in which a pair is not run again.
FINAL = ("completed", "insufficient_evidence", "alignment_failed", "grid_mismatch")


def job_states(log: DataFrame) -> DataFrame:
    """Each job's last state in an append-only log (job_id, state, at, seq); one that was interrupted waits again."""
    last = log.groupBy("job_id").agg(F.max_by("state", F.struct("at", "seq")).alias("state"), F.max("at").alias("at"), F.count("*").alias("entries"))
    return last.withColumn("effective", F.when(F.col("state") == "running", "queued").otherwise(F.col("state")))


def acknowledged(alerts: DataFrame, ids: DataFrame | None, at: Column) -> DataFrame:
    """Open alerts of the given locations (of all if None) are acknowledged; those that were stay as they are."""
    if ids is None:
        return alerts.withColumn("acknowledged_at", F.coalesce("acknowledged_at", at))
    hit = ids.select("watch_id").distinct().withColumn("_hit", F.lit(True))
    return alerts.join(hit, "watch_id", "left").withColumn("acknowledged_at", F.coalesce("acknowledged_at", F.when(F.col("_hit"), at))).drop("_hit")


def migrated(rows: DataFrame, schema: DataFrame) -> DataFrame:
    """Rows of an older layout in the columns of a newer one; columns that it lacks are null, others stay."""
    return schema.limit(0).unionByName(rows, allowMissingColumns=True)


def stage_timings(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Milliseconds by operation and stage, repeated stages added, under the report's names."""
    renamed = F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("stage")], F.col("stage"))
    return rows.groupBy("operation", renamed.alias("stage")).agg(F.sum("ms").alias("ms"), F.count("*").alias("runs"))


def embedding_status(places: DataFrame, tiles: DataFrame, running: DataFrame) -> DataFrame:
    """what is tracked, else ready if a scene has tiles."""
    n = tiles.groupBy("scene_id").agg(F.count("*").alias("tiles"))
    out = places.join(n, "scene_id", "left").join(running.select("scene_id", "state"), "scene_id", "left")
    return out.select("scene_id", F.coalesce("tiles", F.lit(0)).alias("tiles"), F.coalesce("state", F.when(F.col("tiles") > 0, "ready").otherwise("not_embedded")).alias("status"))


def step_progress(events: DataFrame) -> DataFrame:
    """The steps of each import as its events (pipeline_id, seq, noted_at, step, state, done, total) leave them: one row a
    step, `place` in the order of first mention. An event without a step ends the import, the first one for good: what
    comes later doesn't count. After the end `done` a step that waits or runs was skipped; after `failed` the first one
    that runs has failed. Seconds are from the first time that the step ran to the last time it was over."""
    ends = events.where("step is null").groupBy("pipeline_id").agg(F.min("seq").alias("end_seq"), F.min_by("state", "seq").alias("pipeline_state"))
    noted = events.where("step is not null").join(ends, "pipeline_id", "left").where("end_seq is null or seq < end_seq")
    over = F.col("state").isin("done", "failed", "skipped")
    steps = noted.groupBy("pipeline_id", "step").agg(
        F.coalesce(F.first("pipeline_state"), F.lit("running")).alias("pipeline_state"),
        F.min("seq").alias("first_seq"),
        F.max_by("state", "seq").alias("noted"),
        *[F.max_by(c, F.when(F.col("total").isNotNull(), F.col("seq"))).alias(c) for c in ("done", "total")],
        F.min(F.when(F.col("state") == "active", F.col("noted_at"))).alias("began"),
        F.max(F.when(over, F.col("noted_at"))).alias("ended"),
    )
    one = Window.partitionBy("pipeline_id")  # as many rows as an import has steps
    runs = F.min(F.when(F.col("noted") == "active", F.col("first_seq"))).over(one) == F.col("first_seq")
    state = (
        F.when((F.col("pipeline_state") == "done") & F.col("noted").isin("pending", "active"), "skipped")
        .when((F.col("pipeline_state") == "failed") & (F.col("noted") == "active") & runs, "failed")
        .otherwise(F.col("noted"))
    )
    took = (F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("began").cast("timestamp"))) / 1e6
    place = F.row_number().over(one.orderBy("first_seq"))
    return steps.select("pipeline_id", "pipeline_state", place.alias("place"), "step", state.alias("state"), "done", "total", F.when(took >= 0, took).alias("seconds"))


DECISIONS = ("confirmed", "rejected")


def append_reviews(rows: DataFrame, path: str) -> None:
    """Reviews are only ever added; one with another decision refuses the batch."""
    if rows.where(~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False))).limit(1).count():
        raise ValueError(f"decision: one of {DECISIONS}")
    rows.write.mode("append").parquet(path)


def replace_jobs(rows: DataFrame, path: str) -> None:
    """A job's detections take the place of its earlier ones; other jobs' files are not touched, and running
    it again changes nothing."""
    rows.repartition("job_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(path)


def add_watch(watchlist: DataFrame, new: DataFrame, cap: int = P.watch_cap) -> DataFrame:
    """With the new locations, unless there would be over `cap`."""
    if watchlist.count() + new.count() > cap:
        raise ValueError(f"at most {cap} watched locations")
    return watchlist.unionByName(new)


def remove_watch(watchlist: DataFrame, alerts: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the given locations and, first, their alerts."""
    gone = ids.select("watch_id").distinct()
    return watchlist.join(gone, "watch_id", "left_anti"), alerts.join(gone, "watch_id", "left_anti")

"""Every query the driver runs, by name: (spark, folder of given tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.functions import constants as K
from mediacat.functions import names as N
from mediacat.functions import paths, rules
from mediacat.functions import tracks as T
from mediacat.operators import (
    audit, keyed, ledger, logs, matching, nodes, originals, outcomes, progress, scan, tracks,
)
from mediacat.plans import scan_plan
from mediacat.plans.views import DOCUMENT, JOBS, NODE_TEXTS, SCAN, Views
from mediacat.sources import readers
from mediacat.sources.tables import KeyedTable, scratch_folder
from mediacat.streaming import jobs as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    QUERIES[build.__name__] = lambda spark, folder: build(Views(spark, folder))
    return build


def _max(df: DataFrame, column: str) -> Column:
    return df.agg(F.max(column).alias("m")).scalar()


def _percent(part: Column, whole: Column) -> Column:
    return F.floor(F.try_divide(part.cast("double") * 100, whole)).cast("bigint")


# ---- scan ----------------------------------------------------------------


def _with_settings(v: Views) -> DataFrame:
    """Files with their library's settings and probe columns."""
    files = v.files().withColumn("audio_codecs", F.array("audio_codec"))
    return files.join(v.library_settings(), "library_id")


def _decided(v: Views) -> DataFrame:
    return scan.decide(_with_settings(v))


@query
def conversion_plan(v: Views) -> DataFrame:
    return (
        _decided(v).where(F.col("skip.code").isNull())
        .groupBy("library_id", F.col("plan.action").alias("action"))
        .agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    )


@query
def plan_reasons(v: Views) -> DataFrame:
    """Reason frequencies of everything the scan explains: plans and skips."""
    reason = F.coalesce(F.col("skip.code"), F.col("plan.why"))
    return _decided(v).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("files"))


@query
def inventory_latest(v: Views) -> DataFrame:
    return v.files().select(
        "file_id", "path", "scan_s", "size", "height", "video_codec", "audio_codec", "duration_s"
    )


@query
def processed_upserts(v: Views) -> DataFrame:
    """Files noted as handled in three batches; the library that is noted first stays."""
    columns = "path string, mtime_s bigint, scan_s bigint, size bigint, library_id bigint"
    table = KeyedTable(scratch_folder(v.spark), columns, ["path"], ["scan_s", "size"], ["library_id"])
    for n in range(3):
        table.upsert(v.scan().where(f"((scan_s - 1700000000) div 30) % 3 = {n}").selectExpr(
            "path", "mtime_s", "scan_s", "size", f"case when {n} > 0 or file_id % 4 <> 0 then library_id + {100 * n} end as library_id"
        ), n)
    return table.read(v.spark)


@query
def skip_reasons(v: Views) -> DataFrame:
    """Rules that need no probe are tried first; only what passes them meets the probe rules."""
    files = _with_settings(v)
    listing = rules.skip_reason(F.col("path"), F.col("size"), F.col("filters"))
    probed = rules.skip_reason(
        F.col("path"), F.col("size"), F.col("filters"), F.col("duration_s"),
        F.col("video_bitrate"), F.col("video_codec"),
    )
    cheap = files.withColumn("cheap", listing["code"])
    code = F.when(F.col("cheap").isNotNull(), F.col("cheap")).otherwise(probed["code"])
    phase = F.when(F.col("cheap").isNotNull(), "listing").otherwise("probe")
    return (
        cheap.select("library_id", phase.alias("phase"), code.alias("code"))
        .where(F.col("code").isNotNull())
        .groupBy("library_id", "phase", "code")
        .agg(F.count(F.lit(1)).alias("files"))
    )


def _scan_now(v: Views) -> Column:
    return _max(v.scan(), "mtime_s") + 30


@query
def scan_funnel(v: Views) -> DataFrame:
    """First stage at which each file leaves the scan. Every 97th file has no readable probe; some lie outside
    all libraries, are no videos or lie among originals.
    """
    n, path = F.col("file_id"), F.col("path")
    placed = (
        F.when(n % 83 == 5, F.regexp_replace(path, "^/media/", "/elsewhere/"))
        .when(n % 89 == 6, F.concat(path, F.lit(".txt")))
        .when(n % 79 == 7, F.regexp_replace(path, "/f", "/originals/f"))
        .otherwise(path)
    )
    files = v.files().drop("library_id").withColumn("path", placed)
    owned = scan.owning_library(files, v.inline("v_libraries"))
    settings = v.library_settings()
    df = owned.join(settings, "library_id", "left").withColumn("audio_codecs", F.array("audio_codec"))
    handled = v.processed().select("path", F.col("mtime_s").alias("handled_s"))
    df = df.join(handled, "path", "left")
    df = scan.decide(df)
    stage = (
        F.when(F.col("library_id").isNull(), "no_library")
        .when(~F.col("enabled"), "paused")
        .when(~paths.is_video(F.col("path")), "not_video")
        .when(paths.in_skip_dir(F.col("path")), "skipped_folder")
        .when(~scan.is_settled(F.col("mtime_s"), _scan_now(v)), "arriving")
        .when(F.abs(F.col("handled_s") - F.col("mtime_s")) < 1, "handled")
        .when(F.col("skip.code").isNotNull(), "skip_rule")
        .when(F.col("file_id") % 97 == 0, "unreadable")
        .when(F.col("plan.action") == "skip", "already_right")
        .otherwise("wanted")
    )
    return (
        df.groupBy(F.col("library_id").cast("bigint").alias("library_id"), stage.alias("stage"))
        .agg(F.count(F.lit(1)).alias("files"))
    )


@query
def scan_report(v: Views) -> DataFrame:
    """What one scan of every enabled library would report."""
    files = v.files().withColumn("audio_codecs", F.array("audio_codec"))
    # Only files too young to count as settled are asked whether their size has; a sighting has its file's time.
    young = v.scan().where(~scan.is_settled(F.col("mtime_s"), _scan_now(v)))
    decisions = scan_plan.scan_libraries(
        files.select("path", "size", "mtime_s"),
        v.library_settings(),
        v.processed(),
        v.jobs(),
        files.select("path", *scan_plan.PROBE_COLUMNS),
        _scan_now(v),
        scan.size_stability(young, ["scan_s"]),
    )
    return scan_plan.scan_report(decisions)


@query
def tier_profile(v: Views) -> DataFrame:
    """Files by tier, codec and depth; two thirds carry their own stream rate."""
    f = v.files()
    stream = F.when(F.col("file_id") % 3 == 0, 0).otherwise(F.col("video_bitrate"))
    total = F.floor(F.col("size") * 8 / F.col("duration_s")).cast("bigint")
    bits = F.when(F.col("file_id") % 2 == 0, F.col("bit_depth").cast("string")).otherwise(F.lit(""))
    fmt = F.when(F.col("bit_depth") == 10, "yuv420p10le").otherwise("yuv420p")
    f = f.withColumns(
        {
            "tier": rules.tier(F.col("height")),
            "depth": rules.bit_depth(bits, fmt),
            "rate": rules.estimated_video_bitrate(stream, total, F.lit(1)),
        }
    )
    return f.groupBy("library_id", "tier", "video_codec", "depth").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size").alias("bytes"),
        F.sum("rate").alias("rate_sum"),
        F.count_if(rules.is_hi10p(F.col("video_codec"), F.col("depth"))).alias("hi10p"),
    )


@query
def over_ceiling(v: Views) -> DataFrame:
    """Files of the wanted codec whose picture is still above its tier's ceiling."""
    df = _with_settings(v).where(F.col("video_codec") == F.col("spec.codec"))
    ceiling = F.col("filters.bitrate_ceiling")
    bad = ~rules.video_is_efficient(F.col("video_bitrate"), F.col("height"), ceiling)
    return (
        df.where(bad).groupBy("library_id", rules.tier(F.col("height")).alias("tier"))
        .agg(F.count(F.lit(1)).alias("files"), F.sum("video_bitrate").alias("bits"))
    )


@query
def unprocessed_files(v: Views) -> DataFrame:
    return scan.not_processed(v.files(), v.processed()).select("file_id", "path", "size")


@query
def stuck_files(v: Views) -> DataFrame:
    return scan.stuck_files(v.files(), v.jobs()).select("file_id", "path", "size", "job_id")


@query
def library_of_file(v: Views) -> DataFrame:
    """Owner of every file and archived copy; a nested and a repeated folder test the order."""
    extra = v.spark.sql(
        "select * from values (7,'all','/media'),(8,'aaa','/media/lib4'),(9,'archive','/out/Originals/lib0/') "
        "as t(library_id,name,watch_path)"
    )
    libs = v.inline("v_libraries").select("library_id", "name", "watch_path").unionByName(extra)
    owned = scan.owning_library(v.inventory(), libs)
    return owned.groupBy(F.col("library_id").cast("bigint").alias("library_id")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")
    )


@query
def enqueue_batch(v: Views) -> DataFrame:
    batch = v.scan().select("path", "scan_s", "size", "library_id")
    return ledger.enqueue(batch, v.jobs(sizes=False), ["scan_s", "size"])


@query
def enqueue_report(v: Views) -> DataFrame:
    return ledger.enqueue_report(v.scan(), v.jobs(sizes=False))


@query
def size_stability(v: Views) -> DataFrame:
    seen = v.scan().withColumn("size", F.col("size") - F.col("size") % 100000000)
    return scan.size_stability(seen, ["scan_s"])


@query
def filed_rows(v: Views) -> DataFrame:
    """Ledger rows for files that need no conversion and are moved as they are.

    A quarter of the files lie in folders where several have the same name; every 41st file's place is taken.
    """
    end = F.substring_index("path", ".", -1)
    shared = F.format_string(
        "/media/lib%d/d%d/g%d.%s", "library_id", F.col("file_id") % 2, F.floor(F.col("file_id") / 64).cast("bigint"), end
    )
    files = v.files().withColumns({
        "audio_codecs": F.array("audio_codec"),
        "path": F.when(F.col("file_id") % 4 == 3, shared).otherwise(F.col("path")),
    })
    df = scan.decide(files.join(v.library_settings(), "library_id"))
    df = scan.files_to_file(df.join(_named_library(v), "library_id"))
    at = F.format_string("/out/lib%d/f%d.%s", F.floor(F.col("file_id") / 8).cast("bigint") % 5, "file_id", end)
    taken = v.file_paths().where(F.col("file_id") % 41 == 0).select(at.alias("path"))
    marked = scan.destination_conflicts(df, v.file_paths().select("path").unionByName(taken), first_wins=True)
    return scan.filed_rows(marked, v.jobs(sizes=False)).select(
        "path", "library_id", "state", "size_after", "final_path"
    )


# ---- ledger --------------------------------------------------------------


@query
def view_counts(v: Views) -> DataFrame:
    return ledger.view_counts(v.jobs(sizes=False))


@query
def counts_by_library(v: Views) -> DataFrame:
    return ledger.counts_by_library(v.jobs(sizes=False))


@query
def job_stats(v: Views) -> DataFrame:
    return ledger.job_stats(v.jobs())


def _completions(v: Views) -> DataFrame:
    day = F.floor((F.col("created_s") + 3600) / 86400).cast("bigint")
    return v.jobs().where(F.col("state") == "done").withColumn("day", day)


@query
def lifetime_totals(v: Views) -> DataFrame:
    return ledger.running_totals(_completions(v))


@query
def lifetime_stats(v: Views) -> DataFrame:
    """The completed list has been cleared of every other job; lifetime totals still count them."""
    jobs = v.jobs()
    left = jobs.where(~((F.col("state") == "done") & (F.col("id") % 2 == 0)))
    return ledger.lifetime_stats(left, jobs.where(F.col("state") == "done"))


@query
def active_by_node(v: Views) -> DataFrame:
    jobs = v.jobs(sizes=False)
    seen = jobs.groupBy("node_id").agg(F.max("progress_s").alias("last_seen_s"))
    fleet = (
        v.inline("v_nodes").withColumn("node_id", F.col("node_id").cast("bigint"))
        .withColumn("max_jobs", F.lit(1)).join(seen, "node_id", "left")
    )
    out = ledger.active_by_node(jobs, fleet, _max(jobs, "progress_s"), K.ONLINE_S)
    return out.withColumn("online", F.coalesce("online", F.lit(False)))


@query
def queue_page(v: Views) -> DataFrame:
    page = ledger.jobs_page(v.jobs(sizes=False), "active", page=7, per_page=20)
    return page.select("position", "id", "path", "state")


@query
def history_page(v: Views) -> DataFrame:
    """A page far beyond the end shows the last one."""
    page = ledger.jobs_page(v.jobs(sizes=False), "done", page=10**9, per_page=500, library_id=2)
    return page.select("position", "id", "path", "state")


@query
def largest_files(v: Views) -> DataFrame:
    return v.files().orderBy(F.desc("size"), "path").limit(500).select("path", "size", "library_id")


@query
def requeue_plan(v: Views) -> DataFrame:
    return ledger.requeue(v.jobs(sizes=False), "failed").select("id", "verdict")


@query
def bulk_changes(v: Views) -> DataFrame:
    """States before and after clearing failures, cancelling library 1 and accepting every fifth result."""
    jobs = v.jobs(sizes=False).withColumns(
        {"finished_s": F.lit(None).cast("bigint"), "outcome": F.lit(None).cast("string")}
    )
    now = _max(jobs, "created_s") + 3600
    taken = jobs.where((F.col("state") == "bloated") & (F.col("id") % 5 == 0))
    after = ledger.accept(jobs, taken)
    after = ledger.cancel_active(after, now, library_id=1)
    after = ledger.clear_view(after, "failed", library_id=2)
    return after.groupBy("state").agg(
        F.count(F.lit(1)).alias("jobs"),
        F.count("finished_s").alias("finished"),
        F.count("outcome").alias("noted"),
    )


@query
def files_with_active_job(v: Views) -> DataFrame:
    held = ledger.has_job_for(v.files(), v.jobs(sizes=False), K.ACTIVE_STATES)
    return held.groupBy("library_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


# ---- outcomes ------------------------------------------------------------


@query
def savings_verdicts(v: Views) -> DataFrame:
    libs = v.inline("v_libraries").select(F.col("library_id").cast("bigint"), "min_saving")
    ended = v.jobs().where(F.col("state").isin("done", "bloated")).join(libs, "library_id", "left")
    verdict = rules.savings_verdict(F.col("size_before"), F.col("size_after"), F.col("min_saving"))
    return ended.withColumn("s", verdict).select(
        "id", F.col("s.code").alias("code"), F.floor("s.percent").cast("bigint").alias("percent")
    )


@query
def savings_rollup(v: Views) -> DataFrame:
    """Bytes before and after by library, codec and node of the finished jobs."""
    libs = v.inline("v_libraries").select(F.col("library_id").cast("bigint"), "name")
    nodes_ = v.inline("v_nodes").select(
        F.col("node_id").cast("bigint"), F.col("name").alias("node")
    )
    done = ledger.savings(v.jobs(), ["library_id", "codec", "node_id"])
    return (
        done.join(libs, "library_id", "left").join(nodes_, "node_id", "left")
        .select(
            F.col("name").alias("library"), "codec", "node", "jobs", "before", "after", "percent",
        )
    )


@query
def savings_subtotals(v: Views) -> DataFrame:
    """Savings by library and codec, with a row for each library and one for all."""
    libs = v.inline("v_libraries").select(F.col("library_id").cast("bigint"), F.col("name").alias("library"))
    return ledger.savings(v.jobs().join(libs, "library_id", "left"), ["library", "codec"], subtotals=True)


@query
def savings_by_tier(v: Views) -> DataFrame:
    """Bytes before and after by the source's resolution tier and the encoder used."""
    seen = v.files().select("path", rules.tier(F.col("height")).alias("tier"))
    jobs = v.jobs().where(F.col("state") == "done").join(seen, "path", "left")
    tiered = jobs.withColumn("tier", F.coalesce("tier", rules.tier(F.lit(None).cast("int"))))
    return ledger.savings(tiered, ["tier", "encoder"])


def _retry_settings(v: Views) -> DataFrame:
    texts = F.filter(F.split("steps", ","), lambda t: t != "")
    return (
        v.inline("v_libraries").join(v.inline("v_retry"), "library_id")
        .select(
            F.col("library_id").cast("bigint").alias("library_id"),
            F.col("name").alias("library_name"),
            "watch_path", "output_path", "original_action", "min_saving",
            rules.retry_ladder(
                F.col("base_quality"), F.col("auto_retry") == 1, texts, F.col("custom_quality")
            ).alias("ladder"),
            (F.col("salvage_on") == 1).alias("salvage_on"),
        )
    )


@query
def retry_rungs(v: Views) -> DataFrame:
    """Next quality for results that were not worth keeping."""
    jobs = v.jobs(sizes=False).where(F.col("state") == "bloated")
    return jobs.join(_retry_settings(v), "library_id").select(
        "id",
        F.array_join(F.col("ladder").cast("array<string>"), ",").alias("ladder"),
        rules.next_rung(F.col("ladder"), F.col("quality")).cast("bigint").alias("next_quality"),
        (F.col("attempt") + 1).cast("bigint").alias("next_attempt"),
    )


@query
def attempt_chain(v: Views) -> DataFrame:
    """Attempts per path, with the job that superseded the others."""
    jobs = v.jobs(sizes=False)
    return jobs.groupBy("path").agg(
        F.count(F.lit(1)).alias("jobs"),
        F.max("attempt").alias("attempts"),
        F.max(F.struct("attempt", "id"))["id"].alias("last_id"),
    )


def _library_table(v: Views) -> DataFrame:
    return v.inline("v_libraries").select(
        F.col("library_id").cast("bigint").alias("library_id"), "name", "watch_path", "output_path",
        "original_action", F.lit(None).cast("string").alias("originals_path"),
    )


def _archived(v: Views, jobs: DataFrame) -> DataFrame:
    return originals.archived_source(
        jobs, _library_table(v), v.originals(sizes=False), v.inventory_paths()
    )


@query
def outcome_routing(v: Views) -> DataFrame:
    jobs = v.jobs()
    ended = jobs.where(F.col("state").isin("done", "bloated", "failed", "ignored"))
    busy = (
        jobs.where(F.col("state").isin(K.ACTIVE_STATES)).select("path").distinct()
        .withColumn("busy", F.lit(True))
    )
    df = _archived(v, ended).join(_retry_settings(v), "library_id", "left").join(busy, "path", "left")
    taken = F.coalesce("busy", F.lit(False))
    restored = F.col("archived").isNotNull() & F.col("library_name").isNotNull()
    verdict = rules.savings_verdict(F.col("size_before"), F.col("size_after"), F.col("min_saving"))
    complete = outcomes.route_completion(
        F.col("id") % 10 == 0, verdict, restored, F.col("ladder"), F.col("quality"),
        F.col("salvage_on"), taken,
    )
    audio = F.when(F.col("id") % 4 == 0, "copy").otherwise("aac")
    failure = outcomes.route_failure(F.col("id") % 3 != 0, audio, taken)
    r = F.when(F.col("state").isin("done", "bloated"), complete).otherwise(failure)
    return df.withColumn("r", r).select(
        "id", "r.route", "r.next_state", F.col("r.next_quality").cast("bigint").alias("next_quality")
    )


@query
def retry_eligibility(v: Views) -> DataFrame:
    jobs = v.jobs(sizes=False).where(F.col("state") == "bloated")
    here = v.inventory_paths()
    record = v.originals(sizes=False).select(F.col("job_id").alias("id"), "archived_path")
    archived = here.select(F.col("path").alias("archived_path"), F.lit(True).alias("archived_here"))
    df = (
        jobs.join(here.withColumn("source_here", F.lit(True)), "path", "left")
        .join(record, "id", "left")
        .join(archived, "archived_path", "left")
        .join(_library_table(v), "library_id", "left")
    )
    yes = F.lit(False)
    block = outcomes.retry_block(
        F.coalesce("source_here", yes), F.coalesce("archived_here", yes),
        F.col("archived_path").isNotNull(), F.col("name").isNotNull(),
        F.coalesce(F.col("original_action") == "archive", yes), F.col("id") % 7 != 0,
    )
    steps = F.transform(rules.manual_steps(F.lit(22)), lambda s: s["quality"].cast("string"))
    return df.select(
        "id", block.alias("block"), F.col("quality").alias("current_quality"),
        F.array_join(steps, ",", "own").alias("steps"),
    )


@query
def overrun_jobs(v: Views) -> DataFrame:
    """Limit five days, stall three days; counted from the last job's creation plus an hour."""
    jobs = v.jobs(sizes=False)
    jobs = jobs.withColumn("now_s", _max(jobs, "created_s") + 3600)
    now = F.col("now_s")
    limit = rules.limit_seconds(F.lit(True), F.lit(5.0), F.lit("days"))
    stall = rules.stall_seconds(F.lit(True), F.lit(True), F.lit(3 * 24 * 60.0))
    verdict = rules.overrun_verdict(
        F.col("state"), F.col("started_s"), F.col("progress_s"), now, limit, stall
    )
    return (
        jobs.withColumn("o", verdict).where(F.col("o").isNotNull())
        .select("id", F.col("o.code").alias("code"), (now - F.col("started_s")).alias("ran_s"))
    )


@query
def refused_reports(v: Views) -> DataFrame:
    """What a progress report and a completion would meet now, for every job: the state that refuses them."""
    jobs = v.jobs(sizes=False)
    return jobs.select(
        outcomes.refused(F.col("state"), False).alias("progress_refused_by"),
        outcomes.refused(F.col("state"), True).alias("completion_refused_by"),
    ).groupBy("progress_refused_by", "completion_refused_by").agg(F.count(F.lit(1)).alias("jobs"))


# ---- originals -----------------------------------------------------------


def _ledger_now(v: Views) -> Column:
    return _max(v.jobs(sizes=False), "created_s") + 3600


@query
def originals_summary(v: Views) -> DataFrame:
    held = v.originals()
    old = originals.older_than(held, _ledger_now(v), 5 * 86400)
    return originals.summary(held).withColumn("age", F.lit("all")).unionByName(
        originals.summary(old).withColumn("age", F.lit("old"))
    )


@query
def sweep_plan(v: Views) -> DataFrame:
    plan = originals.sweep_plan(v.originals(), v.inventory(), _ledger_now(v), 2)
    return plan.select("job_id", "verdict", "freed", "replacement_ok")


@query
def archived_source(v: Views) -> DataFrame:
    jobs = v.jobs(sizes=False).where(F.col("state").isin("done", "bloated"))
    found = _archived(v, jobs.select("id", "path", "library_id"))
    return found.select("id", "archived", "found_by")


# ---- nodes ---------------------------------------------------------------


@query
def path_mapping(v: Views) -> DataFrame:
    """Each assigned job's path as its node sees it, and back again."""
    mounts = v.nodes().select("node_id", "mounts")
    df = v.jobs(sizes=False).join(mounts, "node_id").withColumn(
        "w", paths.resolve_path(F.col("path"), F.col("mounts"))
    )
    back = paths.reverse_path(F.col("w.node_path"), F.col("mounts"))
    return df.select("id", "w.transport", "w.node_path", (back == F.col("path")).alias("returns"))


@query
def job_node_pairs(v: Views) -> DataFrame:
    queued = v.jobs().where(F.col("state") == "queued")
    return nodes.eligible_nodes(queued, v.nodes().where("enabled"))


@query
def next_job_per_node(v: Views) -> DataFrame:
    """Slots are two thirds of a node's working jobs for the first and a third more than them for the others."""
    jobs = v.jobs()
    active = (
        jobs.where(F.col("state").isin("leased", "running"))
        .groupBy("node_id").agg(F.count(F.lit(1)).alias("active"))
    )
    working = active.withColumnRenamed("active", "working")
    share = F.when(F.col("node_id") == 0, 2).otherwise(4)
    room = F.floor(F.coalesce("working", F.lit(0)) * share / 3) + F.col("slots")
    fleet = v.nodes().join(working, "node_id", "left").withColumn("slots", room.cast("bigint")).drop("working")
    return nodes.next_job_per_node(jobs, fleet, active)


@query
def best_encoder(v: Views) -> DataFrame:
    """Choice per node and codec family for 8-bit and 10-bit sources, and with 10-bit asked for."""
    cases = F.array(
        *[
            F.struct(F.lit(c).alias("case"), F.lit(w).alias("want"), F.lit(d).alias("depth"))
            for c, w, d in (("eight", "match", 8), ("ten", "match", 10), ("forced", "10", 10))
        ]
    )
    bench = v.bench().select("*", F.inline(cases))
    return nodes.best_encoder(bench, F.col("want"), F.col("depth"), by=["case"])


@query
def encoder_ranking(v: Views) -> DataFrame:
    ranked = nodes.encoder_ranking(v.bench())
    return ranked.select("node_id", "encoder", "fps8", F.col("rank").cast("bigint").alias("rank"))


@query
def ten_bit_cliff(v: Views) -> DataFrame:
    return nodes.ten_bit_cliff(v.bench()).select("node_id", "encoder", "fps8", "fps10")


@query
def software_fallback(v: Views) -> DataFrame:
    """Encoders per node whose working recipe is a software one (here: those very slow at 8 bit)."""
    slow = F.col("fps8") < 20
    recipe = F.when(slow, "SOFTWARE fallback, quality").otherwise("default")
    per_node = v.bench().where(F.col("fps8").isNotNull()).groupBy("node_id").agg(
        F.map_from_entries(F.collect_list(F.struct("encoder", recipe.alias("r")))).alias("recipes")
    )
    return nodes.software_fallback(per_node).groupBy("encoder").agg(F.count(F.lit(1)).alias("nodes"))


@query
def work_window_share(v: Views) -> DataFrame:
    """Share of each node's events that fall into the night and Saturday windows."""
    judged = nodes.in_work_window(v.progress(), v.inline("v_windows"))
    return judged.groupBy("node_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if("open").alias("open"),
        _percent(F.count_if("open"), F.count(F.lit(1))).alias("percent"),
    )


# ---- names ---------------------------------------------------------------


@query
def release_names(v: Views) -> DataFrame:
    parsed = N.parse_names(v.names(), "name")
    return parsed.select(
        "file_id", "parsed.title", "parsed.year", "parsed.season", "parsed.episode",
        "parsed.is_tv", "parsed.confident",
    )


def _named_library(v: Views) -> DataFrame:
    rows = v.inline("v_libraries").join(v.inline("v_naming"), "library_id")
    return rows.select(
        F.col("library_id").cast("bigint").alias("library_id"),
        F.struct(
            "output_path", "watch_path", (F.col("mirror_folders") == 1).alias("mirror_folders"),
            F.struct(
                (F.col("naming_on") == 1).alias("enabled"), "scheme",
                (F.col("skip_uncertain") == 1).alias("skip_uncertain"),
                (F.col("folders") == 1).alias("folders"),
            ).alias("naming"),
        ).alias("library"),
    )


def _named_files(v: Views) -> DataFrame:
    lib = F.col("file_id") % 5
    return (
        v.names().withColumn("library_id", lib)
        .withColumn(
            "path", F.concat(F.lit("/media/lib"), lib.cast("string"), F.lit("/in/"), F.col("name"))
        )
        .join(_named_library(v), "library_id")
    )


@query
def rename_plan(v: Views) -> DataFrame:
    planned = scan.with_destination(_named_files(v), F.lit("mp4"))
    marked = scan.destination_conflicts(planned, v.file_paths().select("path"))
    return marked.select("file_id", "library_id", "destination", "conflict")


def _titles(v: Views) -> DataFrame:
    """The catalogue: even ids are films, odd ids are shows."""
    return v.titles().withColumn("is_tv", F.col("title_id") % 2 == 1)


@query
def title_matches(v: Views) -> DataFrame:
    parsed = N.parse_names(v.names(), "name")
    wanted = parsed.select("parsed.title", "parsed.year", "parsed.is_tv")
    return matching.match_titles(wanted, _titles(v))


@query
def enriched_names(v: Views) -> DataFrame:
    """Names with title, year and ids taken from the catalogue where it is convincing."""
    parsed = N.parse_names(v.names(), "name")
    wanted = parsed.select("parsed.title", "parsed.year", "parsed.is_tv")
    matches = matching.match_titles(wanted, _titles(v))
    external = v.titles().select("title_id", (F.col("title_id") + 100000).alias("tvdb"))
    episodes = v.titles().select(
        "title_id", F.lit(2).alias("season"), F.lit(5).alias("episode"),
        F.concat(F.lit("Part "), F.col("title")).alias("name"),
    )
    out = matching.enrich(parsed, matches, external, episodes)
    return out.select(
        "file_id", "parsed.title", "parsed.year", F.col("parsed.ids.tmdb").alias("tmdb"),
        F.col("parsed.ids.tvdb").alias("tvdb"), "parsed.episode_title", "looked_up",
    )


# ---- tracks --------------------------------------------------------------


def _streams_with_spec(v: Views) -> DataFrame:
    """Settings differ by file: languages or strip for subtitles, mp4 or mkv."""
    odd = F.col("file_id") % 2 == 1
    return v.streams().withColumn(
        "spec",
        F.struct(
            F.array(F.lit("en"), F.lit("FR")).alias("audio_languages"),
            (F.col("file_id") % 3 != 0).alias("remove_other_audio"),
            F.when(F.col("file_id") % 4 == 0, "strip").when(F.col("file_id") % 4 == 1, "forced")
            .when(F.col("file_id") % 4 == 2, "languages").otherwise("keep").alias("subtitle_mode"),
            F.array(F.lit("de"), F.lit("es")).alias("subtitle_languages"),
            (F.col("file_id") % 5 != 0).alias("keep_forced_subs"),
            F.when(odd, "mp4").otherwise("mkv").alias("container"),
            F.lit(True).alias("remove_images"),
            odd.alias("default_first_subtitle"),
        ),
    )


@query
def track_plan(v: Views) -> DataFrame:
    return tracks.track_plan(_streams_with_spec(v)).select(*tracks.PUBLIC)


@query
def track_notes(v: Views) -> DataFrame:
    return tracks.track_notes(tracks.track_plan(_streams_with_spec(v)))


@query
def track_titles(v: Views) -> DataFrame:
    return tracks.track_titles(v.streams())


@query
def picture_streams(v: Views) -> DataFrame:
    """High dynamic range and cover art among the video streams; in every ninth file the picture is attached art."""
    attached = (F.col("file_id") % 9 == 0).cast("int")
    video = v.streams().where("codec_type = 'video'")
    flags = video.select(
        "pix_fmt", T.is_hdr(F.col("color_transfer")).alias("hdr"),
        T.is_image(F.col("codec_type"), F.col("codec_name"), attached).alias("image"),
    )
    return flags.groupBy("pix_fmt").agg(
        F.count(F.lit(1)).alias("streams"), F.count_if("hdr").alias("hdr"), F.count_if("image").alias("images"),
        F.count_if(F.col("hdr") & ~F.col("image")).alias("hdr_pictures"),
    )


# ---- logs and settings ---------------------------------------------------


@query
def progress_lines(v: Views) -> DataFrame:
    lines = v.plines().withColumn("duration_s", F.lit(600.0))
    return logs.progress_updates(lines).drop("key")


@query
def progress_figures(v: Views) -> DataFrame:
    lines = v.plines().withColumn("duration_s", F.lit(600.0))
    return logs.latest_figures(logs.progress_updates(lines))


@query
def failure_causes(v: Views) -> DataFrame:
    from mediacat.functions.logs import signed_exit

    causes = logs.failure_causes(v.loglines(), v.failed())
    return causes.select(
        "job_id", "cause_1", "cause_2", "audio_related", signed_exit(F.col("returncode")).alias("exit_code")
    )


@query
def failure_messages(v: Views) -> DataFrame:
    causes = logs.failure_causes(v.loglines(), v.failed())
    return logs.failure_messages(causes).groupBy("message").agg(F.count(F.lit(1)).alias("jobs"))


@query
def failure_cause_counts(v: Views) -> DataFrame:
    return logs.cause_counts(logs.failure_causes(v.loglines(), v.failed()))


@query
def spec_audit(v: Views) -> DataFrame:
    """Clashing settings by rule, and how many specs needed a blank filled in."""
    specs = (
        v.specs().withColumnsRenamed({"audio": "audio_codec", "video": "video_codec"})
        .withColumns(
            {
                "quality_level": F.when(F.col("job_id") % 2 == 0, "balanced"),
                "hdr_mode": F.when(F.col("job_id") % 5 == 0, "sdr").otherwise("preserve"),
                "audio_language_mode": F.when(F.col("job_id") % 4 == 0, "preferred_only"),
                "audio_languages_list": F.when(F.col("job_id") % 8 == 0, F.array(F.lit("eng"))),
                "normalise_loudness": F.col("job_id") % 3 == 0,
                "keep_forced_subs": F.col("job_id") % 2 == 1,
            }
        )
    )
    mended = audit.repair(specs)
    repaired = mended.where("repaired").agg(F.count(F.lit(1)).alias("jobs")).select(
        F.lit("blank_repaired").alias("rule"), "jobs"
    )
    return audit.rule_counts(mended).unionByName(repaired)


@query
def resolved_specs(v: Views) -> DataFrame:
    """Job specs that library settings expand to; blank settings fall back."""
    specs = v.specs().withColumnsRenamed({"audio": "audio_codec", "video": "video_codec"})
    kinds = {"audio_languages_list": "array<string>", "subtitle_languages": "array<string>", "min_saving_percent": "double",
             "crf_override": "int", "quality_level": "string", "audio_language_mode": "string", "hdr_mode": "string",
             "audio_bitrate": "string"}

    def field(name: str) -> Column:
        return F.col(name) if name in specs.columns else F.lit(None).cast(kinds.get(name, "boolean"))

    return (
        specs.withColumn("s", audit.resolve_profile(field))
        .groupBy("s.codec", "s.container", "s.audio", "s.subtitle_mode", "s.bit_depth", "s.downmix", "s.audio_bitrate",
                 F.col("s.quality").cast("bigint").alias("quality"), F.array_join("s.audio_languages", ",").alias("languages"))
        .agg(F.count(F.lit(1)).alias("jobs"))
    )


# ---- events --------------------------------------------------------------


@query
def latest_progress(v: Views) -> DataFrame:
    out = progress.latest_progress(v.progress())
    ratio = rules.projected_ratio(F.col("size_now"), F.col("progress"), F.lit(10**9))
    return out.select(
        "job_id", "state", "progress", "size_now", "progress_s", "accepted", "refused",
        F.floor(ratio * 1000).cast("bigint").alias("ratio_permille"),
    )


@query
def stalled_jobs(v: Views) -> DataFrame:
    """Lease two minutes, limit five days, stall one day, as of the last event."""
    events = v.progress()
    now = events.agg(F.max(progress.epoch_s(F.col("ts"))).alias("m")).scalar()
    latest = progress.latest_progress(events)
    return progress.stalled_jobs(latest, now, F.lit(5 * 86400.0), F.lit(86400.0))


@query
def lease_expiries(v: Views) -> DataFrame:
    return progress.lease_expiries(v.progress()).groupBy("job_id").agg(
        F.count(F.lit(1)).alias("expiries"), F.max("expired_s").alias("last_s")
    )


@query
def node_sessions(v: Views) -> DataFrame:
    beats = v.progress().select("node_id", progress.epoch_s(F.col("ts")).alias("ts_s"))
    return keyed.sessions(beats, "node_id", "ts_s", gap_s=600, bucket_s=3600)


@query
def daily_savings(v: Views) -> DataFrame:
    daily = _completions(v).groupBy("day").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size_before").alias("before"),
        F.sum("size_after").alias("after"),
    )
    saved = F.col("before") - F.col("after")
    return daily.withColumn("percent", _percent(saved, F.col("before")))


# ---- JSON as it is stored ------------------------------------------------------


def _stored(v: Views, table: DataFrame, name: str) -> str:
    folder = f"{scratch_folder(v.spark)}/{name}"
    table.write.parquet(folder)
    return folder


@query
def probed_files(v: Views) -> DataFrame:
    """Probe documents as stored, some broken, some NULL, some empty, in the shape that the rules read."""
    docs = v.files().selectExpr("path", f"{DOCUMENT} as document")
    probed = readers.probe_documents(v.spark.read.parquet(_stored(v, docs, "documents")))
    out = readers.probe_summary(probed).withColumn("audio", F.array_join("audio_codecs", ","))
    return out.select("path", "size", "duration_s", "bitrate", "video_bitrate", "video_codec", "bit_depth", "height", "audio")


@query
def decoded_nodes(v: Views) -> DataFrame:
    """A table of nodes as stored: lists and figures as JSON text, unreadable ones as empty as missing ones."""
    rows = v.table("supplier").selectExpr("s_suppkey as id", *[f"{text} as {c}" for c, text in NODE_TEXTS.items()])
    nodes_ = readers.state_table(v.spark, _stored(v, rows, "nodes"), "id")
    speeds = F.map_values(F.coalesce("benchmarks", F.create_map().cast("map<string,double>")))
    return nodes_.select(
        "id", F.array_join("encoders", ",").alias("encoders"), F.size("mounts").cast("bigint").alias("mounts"),
        F.try_element_at(F.col("mounts.server"), F.lit(1)).alias("server"), F.array_max(speeds).alias("fastest"),
    )


# ---- streams, run over what there is -----------------------------------------


@contextmanager
def _streaming(v: Views) -> Iterator[str]:
    """A new folder, and the state store that the processors need for the time being."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = v.spark.conf.get(key, None)
    v.spark.conf.set(key, streams.STATE_STORE)
    try:
        yield scratch_folder(v.spark)
    finally:
        v.spark.conf.set(key, before) if before else v.spark.conf.unset(key)


@query
def streamed_reports(v: Views) -> DataFrame:
    """Reports that the job tracker takes and refuses, and when progress last moved; it starts from the ledger."""
    spoken_of = v.progress().select(F.col("job_id").alias("id")).distinct()
    ledger_ = v.jobs(sizes=False).select("id", "state", F.lit(0.0).alias("progress")).join(spoken_of, "id", "left_semi")
    with _streaming(v) as folder:
        tracked = streams.track_jobs(v.progress_stream(), ledger=ledger_)
        streams.run_through(tracked, folder, "reports")
    return v.spark.read.parquet(f"{folder}/reports").where("event in ('report', 'refused')").groupBy("job_id").agg(
        F.count_if(F.col("event") == "report").alias("accepted"), F.count_if(F.col("event") == "refused").alias("refused"),
        F.max(F.unix_timestamp("progress_at")).alias("progress_s"),
    )


@query
def streamed_sessions(v: Views) -> DataFrame:
    """Spells in which nodes were heard from, as the stream has them at its end. Its times count whole seconds."""
    beats = v.progress_stream().select("node_id", F.date_trunc("second", "ts").alias("ts"))
    with _streaming(v) as folder:
        streams.run_through(
            # Spells whose gap is just 600 s are one, as in the stream itself.
            streams.node_sessions(beats, gap_s=600), folder, "sessions", "complete",
            lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/sessions"),
        )
    return v.spark.read.parquet(f"{folder}/sessions").select(
        "node_id", *[F.unix_timestamp(c).alias(c) for c in ("session_start", "session_end")], "events"
    )


@query
def streamed_savings(v: Views) -> DataFrame:
    """Files and bytes by day of completion, from a stream kept in a table by day."""
    orders = v.stream("orders").withColumn("f_size", F.lit(None).cast("bigint")).selectExpr(*[f"{e} as {c}" for c, e in JOBS.items()])
    done = orders.where("state = 'done'").select(F.timestamp_seconds(F.col("created_s") + 3600).alias("finished_at"), "size_before", "size_after")
    with _streaming(v) as folder:
        table = KeyedTable(f"{folder}/savings", "day timestamp, files bigint, before bigint, after bigint", ["day"], ["files"])
        streams.run_through(streams.daily_savings(done), folder, "daily", "update", table.upsert)
    days = table.read(v.spark)
    return days.select(F.floor(F.unix_timestamp("day") / 86400).cast("bigint").alias("day"), "files", "before", "after")


@query
def streamed_requests(v: Views) -> DataFrame:
    """Paths asked for that have no active job, each once."""
    asked = v.stream("lineitem").selectExpr(f"{SCAN['path']} as path", "timestamp_seconds(1700000000) as ts")
    with _streaming(v) as folder:
        streams.run_through(streams.not_active(streams.first_requests(asked), v.jobs(sizes=False)), folder, "requests")
    return v.spark.read.parquet(f"{folder}/requests").groupBy("path").agg(F.count(F.lit(1)).alias("asked"))

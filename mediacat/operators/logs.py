"""Encoder logs: progress reports and failure causes per job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediacat.functions import logs as L


def progress_updates(lines: DataFrame) -> DataFrame:
    """Progress lines (job_id, line_no, line, duration_s) as typed columns."""
    parsed = L.progress_update(F.col("line"), F.col("duration_s"))
    return lines.withColumn("__u", parsed).select(
        "job_id", "line_no", "__u.key", "__u.progress", "__u.size_now", "__u.fps", "__u.speed"
    )


def latest_figures(updates: DataFrame) -> DataFrame:
    """Last known figure of each kind per job, as a running report would show it."""

    def last(name: str):
        known = F.when(F.col(name).isNotNull(), F.struct("line_no", name))
        return F.max(known)[name].alias(name)

    return updates.groupBy("job_id").agg(*[last(n) for n in ("progress", "size_now", "fps", "speed")])


def log_lines(lines: DataFrame, tail: int | None = None) -> DataFrame:
    """Stripped, non-blank lines of each job's log; with `tail`, of its last so many lines only."""
    if tail is not None:
        back = W.partitionBy("job_id").orderBy(F.desc("line_no"))
        lines = lines.withColumn("__n", F.row_number().over(back)).where(F.col("__n") <= tail).drop("__n")
    return lines.withColumn("line", L.strip(F.col("line"))).where(F.col("line") != "")


def failure_causes(lines: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """What made each job fail: job_id, causes (at most two), audio_related, last_line, returncode.

    `lines` holds whole logs (job_id, line_no, line, returncode), blank lines included; `failed` the failed
    jobs (job_id, returncode), without which the jobs that have lines are taken. Every failed job has a
    row, also with a blank log or none at all (no causes, no last line). A generic line only counts as
    the first error of its job. Equal causes are taken once; causes come before consequences.
    Everything reduces by aggregates, so a job with a huge log is not gathered anywhere.
    """
    line = F.col("line")
    if failed is None:
        failed = lines.groupBy("job_id").agg(F.max(F.struct("line_no", "returncode"))["returncode"].alias("returncode"))
    lines = log_lines(lines)
    told = lines.groupBy("job_id").agg(
        F.max(F.struct("line_no", "line"))["line"].alias("last_line"),
        F.min(F.when(L.is_error(line), F.col("line_no"))).alias("__first"),
    )
    jobs = failed.select("job_id", "returncode").join(told, "job_id", "left").select("job_id", "last_line", "returncode", "__first")
    errors = (
        lines.where(L.is_error(line))
        .withColumn("cause", L.clean_line(line))
        .groupBy("job_id", "cause", L.is_noise(line).alias("noise"), L.is_audio_related(line).alias("audio"))
        .agg(F.min("line_no").alias("line_no"))
    )
    hits = errors.join(jobs.select("job_id", "__first"), "job_id").where(
        ~F.col("noise") | (F.col("line_no") == F.col("__first"))
    )
    distinct = hits.groupBy("job_id", "cause").agg(
        F.min("line_no").alias("line_no"), F.max("audio").alias("audio")
    )
    order = W.partitionBy("job_id").orderBy(F.when(L.is_cause(F.col("cause")), 0).otherwise(1), "line_no")
    top = distinct.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= 2)
    audio = distinct.groupBy("job_id").agg(F.max("audio").alias("audio_related"))
    pair = top.groupBy("job_id").agg(
        F.max(F.when(F.col("__n") == 1, F.col("cause"))).alias("cause_1"),
        F.max(F.when(F.col("__n") == 2, F.col("cause"))).alias("cause_2"),
    )
    return (
        jobs.drop("__first")
        .join(pair, "job_id", "left")
        .join(audio, "job_id", "left")
        .withColumn("audio_related", F.coalesce(F.col("audio_related"), F.lit(False)))
    )


AUDIO_HINT = " (an audio track could not be decoded: copying the audio unchanged shows whether the rest is sound)"


def failure_messages(causes: DataFrame) -> DataFrame:
    """The causes as one readable message per job."""
    found = F.concat_ws(" — ", "cause_1", "cause_2")
    last = F.coalesce(L.clean_line(F.col("last_line")), F.lit("no output"))
    text = F.concat(
        L.describe_exit(F.col("returncode")),
        F.lit(": "),
        F.when(found != "", found).otherwise(last),
        F.when(F.col("audio_related"), F.lit(AUDIO_HINT)).otherwise(F.lit("")),
    )
    return causes.select("job_id", text.alias("message"), "audio_related")


def cause_counts(causes: DataFrame) -> DataFrame:
    """How often each leading cause occurs."""
    return (
        causes.select("job_id", F.explode(F.array_compact(F.array("cause_1", "cause_2"))).alias("cause"))
        .groupBy("cause")
        .agg(F.count(F.lit(1)).alias("jobs"))
    )

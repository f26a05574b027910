"""Progress events per job, as a table: accepted and refused reports, last movement, stalls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacat.functions import constants as K
from mediacat.functions import rules
from mediacat.operators.keyed import last_known, previous_value

ORDER = ["ts", "event_id"]


def epoch_s(ts: Column) -> Column:
    """Whole seconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date"))
    return days * F.lit(86400).cast("bigint") + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def judged(events: DataFrame, slice_s: int = 600) -> DataFrame:
    """Events with `accepted` and `moved`.

    A progress report is refused once its job has completed or failed, until it is started again.
    A report has moved when its figure is above the previous accepted one; a start resets to zero.
    `slice_s` is the length of the time slices a job's events are cut into.
    """
    df = events.withColumn("at_s", epoch_s(F.col("ts")))
    bucket = F.floor(F.col("at_s") / slice_s)
    report = F.col("kind") == "progress"
    df = df.withColumn("__change", F.when(~report, F.col("kind")))
    df = last_known(df, ["job_id"], ORDER, "__change", bucket, "__before")
    accepted = report & (F.coalesce(F.col("__before"), F.lit("started")) == "started")
    df = df.withColumn("accepted", accepted).withColumn(
        "__p", F.when(F.col("kind") == "started", 0.0).when(F.col("accepted"), F.col("progress"))
    )
    df = last_known(df, ["job_id"], ORDER, "__p", F.floor(F.col("at_s") / slice_s), "__last")
    moved = F.col("accepted") & (F.col("progress") > F.coalesce(F.col("__last"), F.lit(0.0)))
    return df.withColumn("moved", moved).drop("__before", "__p", "__last")


def latest_progress(events: DataFrame, slice_s: int = 600) -> DataFrame:
    """Where each job stands after all its events."""
    df = judged(events, slice_s)
    at = [F.col(c) for c in ORDER]
    figure = F.when(F.col("kind") == "started", 0.0).when(F.col("accepted"), F.col("progress"))
    lively = (F.col("kind") == "started") | F.col("accepted")

    def last(value: Column, when: Column) -> Column:
        return F.max(F.when(when, F.struct(*at, value.alias("v"))))["v"]

    change = last(F.col("__change"), F.col("__change").isNotNull())
    state = F.when(change == "complete", "done").when(change == "fail", "failed").otherwise("running")
    return df.groupBy("job_id").agg(
        state.alias("state"),
        F.coalesce(last(figure, figure.isNotNull()), F.lit(0.0)).alias("progress"),
        last(F.col("size_now"), F.col("accepted")).alias("size_now"),
        F.max(F.when(F.col("moved"), F.col("at_s"))).alias("progress_s"),
        F.max(F.when(F.col("kind") == "started", F.col("at_s"))).alias("started_s"),
        F.max(F.when(lively, F.col("at_s"))).alias("seen_s"),
        F.count_if("accepted").alias("accepted"),
        F.count_if((F.col("kind") == "progress") & ~F.col("accepted")).alias("refused"),
    )


def stalled_jobs(
    latest: DataFrame, now_s: Column, limit_s: Column, stall_s: Column, lease_s: int = K.LEASE_S
) -> DataFrame:
    """Running jobs whose lease ran out, or that run too long or do not move."""
    # Held in a column, so that a `now_s` looked up from a table is looked up once.
    now = F.col("__now")
    verdict = rules.overrun_verdict(
        F.col("state"), F.col("started_s"), F.col("progress_s"), now, limit_s, stall_s
    )
    return (
        latest.where(F.col("state") == "running")
        .withColumn("__now", now_s)
        .withColumn("lease_expired", F.coalesce(F.col("seen_s") + lease_s < now, F.lit(False)))
        .withColumn("code", verdict["code"])
        .where(F.col("lease_expired") | F.col("code").isNotNull())
        .select("job_id", "lease_expired", "code")
    )


def lease_expiries(events: DataFrame, lease_s: int = K.LEASE_S, slice_s: int = 600) -> DataFrame:
    """Moments at which a running job went silent for longer than its lease."""
    df = judged(events, slice_s).where((F.col("kind") == "started") | F.col("accepted"))
    df = previous_value(df, ["job_id"], ORDER, "at_s", F.floor(F.col("at_s") / slice_s), "before_s")
    return df.where(F.col("at_s") - F.col("before_s") > lease_s).select(
        "job_id", (F.col("before_s") + lease_s).alias("expired_s")
    )

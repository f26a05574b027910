"""The job ledger: views, statistics, paging and set-wise state changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediacat.functions.constants import ACTIVE_STATES, JOB_VIEWS
from mediacat.operators.keyed import page_of


def in_view(state: Column, view: str) -> Column:
    return state.isin(JOB_VIEWS[view])


def has_job_for(rows: DataFrame, jobs: DataFrame, states: list[str] | None = None) -> DataFrame:
    """Rows whose path has a job in any of the states."""
    found = jobs if states is None else jobs.where(F.col("state").isin(states))
    return rows.join(found.select("path"), "path", "left_semi")


def view_counts(jobs: DataFrame, library_id: int | None = None) -> DataFrame:
    """Jobs per view in one pass; views without jobs count zero."""
    if library_id is not None:
        jobs = jobs.where(F.col("library_id") == library_id)
    counts = jobs.agg(*[_view_count(v) for v in JOB_VIEWS])
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("view"), F.col(v).alias("jobs")) for v in JOB_VIEWS]))
    return counts.select(pairs.alias("p")).select("p.view", "p.jobs")


def counts_by_library(jobs: DataFrame) -> DataFrame:
    """View counts per library; jobs without a library keep their own row."""
    return jobs.groupBy("library_id").agg(*[_view_count(v) for v in JOB_VIEWS])


def _view_count(view: str) -> Column:
    return F.count_if(in_view(F.col("state"), view)).alias(view)


def job_stats(jobs: DataFrame) -> DataFrame:
    done = F.col("state") == "done"
    return jobs.agg(
        F.count_if(done).alias("done"),
        F.count_if(F.col("state") == "failed").alias("failed"),
        F.count_if(F.col("state") == "queued").alias("queued"),
        F.coalesce(F.sum(F.when(done, F.col("size_before"))), F.lit(0)).alias("before"),
        F.coalesce(F.sum(F.when(done, F.col("size_after"))), F.lit(0)).alias("after"),
    )


def lifetime_stats(jobs: DataFrame, completions: DataFrame) -> DataFrame:
    """Statistics with lifetime totals in place of the live bytes once any file was counted."""
    totals = completions.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("size_before"), F.lit(0)).alias("t_before"),
        F.coalesce(F.sum("size_after"), F.lit(0)).alias("t_after"),
    )
    # Two rows, one from each side, folded into one.
    both = job_stats(jobs).unionByName(totals, allowMissingColumns=True)
    one = both.agg(*[F.max(c).alias(c) for c in both.columns])
    counted = F.col("files") > 0
    return one.select(
        F.greatest(F.col("done"), F.col("files")).alias("done"),
        "failed",
        "queued",
        F.when(counted, F.col("t_before")).otherwise(F.col("before")).alias("before"),
        F.when(counted, F.col("t_after")).otherwise(F.col("after")).alias("after"),
    )


def running_totals(completions: DataFrame) -> DataFrame:
    """Files and bytes so far per library at the end of each day.

    Days are summed first, so the running window sees one row per library and day.
    """
    daily = completions.groupBy("library_id", "day").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size_before").alias("before"),
        F.sum("size_after").alias("after"),
    )
    upto = W.partitionBy("library_id").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    return daily.select(
        "library_id",
        "day",
        *[F.sum(c).over(upto).alias(f"{c}_so_far") for c in ("files", "before", "after")],
    )


def savings(jobs: DataFrame, by: list[str], subtotals: bool = False) -> DataFrame:
    """Finished jobs, bytes before and after, and whole percent saved, by any columns (library, codec, tier, encoder).

    subtotals: also for `by` without its last columns, and for all jobs; `summed` then has a bit for each
    column that a row sums over, the last column's the lowest.
    """
    before, after = F.col("before"), F.col("after")
    done = jobs.where(F.col("state") == "done")
    grouped = done.rollup(*by) if subtotals else done.groupBy(*by)
    level = [F.grouping_id().cast("int").alias("summed")] if subtotals else []
    return (
        grouped
        .agg(*level, F.count(F.lit(1)).alias("jobs"), F.sum("size_before").alias("before"), F.sum("size_after").alias("after"))
        .withColumn("percent", F.floor(F.try_divide((before - after).cast("double") * 100, before)).cast("bigint"))
    )


def jobs_page(
    jobs: DataFrame, view: str = "active", page: int = 1, per_page: int = 20,
    library_id: int | None = None,
) -> DataFrame:
    """A page of a view: active work oldest first, history newest first."""
    rows = jobs.where(in_view(F.col("state"), view))
    if library_id is not None:
        rows = rows.where(F.col("library_id") == library_id)
    return page_of(rows, "id", page, per_page, ascending=view == "active")


def list_jobs(jobs: DataFrame, states: list[str] | None, limit: int) -> DataFrame:
    """The first `limit` jobs in running order (active states) or newest first (anything else)."""
    rows = jobs if states is None else jobs.where(F.col("state").isin(states))
    oldest_first = states is not None and set(states) <= set(ACTIVE_STATES)
    return rows.orderBy(F.col("id").asc() if oldest_first else F.col("id").desc()).limit(limit)


def active_by_node(jobs: DataFrame, nodes: DataFrame, now_s: Column, online_s: int) -> DataFrame:
    """Running work, free slots and liveness of each node."""
    active = (
        jobs.where(F.col("state").isin("leased", "running") & F.col("node_id").isNotNull())
        .groupBy("node_id")
        .agg(F.count(F.lit(1)).alias("active"))
    )
    slots = F.coalesce(F.col("slots"), F.col("max_jobs"), F.lit(1))
    return nodes.join(active, "node_id", "left").select(
        "node_id",
        "name",
        F.coalesce(F.col("active"), F.lit(0)).alias("active"),
        (slots - F.coalesce(F.col("active"), F.lit(0))).cast("bigint").alias("free_slots"),
        (now_s - F.col("last_seen_s") < online_s).alias("online"),
    )


def enqueue(batch: DataFrame, jobs: DataFrame, order: list[str]) -> DataFrame:
    """Rows of the batch that become jobs: one per path, the first by `order`.

    Paths that already have an active job are left out.
    """
    rest = [c for c in batch.columns if c != "path" and c not in order]
    busy = jobs.where(F.col("state").isin(ACTIVE_STATES)).select("path").distinct()
    return (
        batch.groupBy("path")
        .agg(F.min(F.struct(*order, *rest)).alias("f"))
        .join(busy, "path", "left_anti")
        .select("path", "f.*")
    )


def enqueue_report(batch: DataFrame, jobs: DataFrame) -> DataFrame:
    """Added and skipped counts of a batch without keeping its rows apart."""
    busy = jobs.where(F.col("state").isin(ACTIVE_STATES)).select("path").distinct()
    asked = batch.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    free = F.col("busy").isNull()
    return (
        asked.join(busy.withColumn("busy", F.lit(1)), "path", "left")
        .agg(
            F.count_if(free).alias("added"),
            F.coalesce(F.sum(F.when(free, F.col("n") - 1).otherwise(F.col("n"))), F.lit(0)).alias("skipped"),
        )
    )


def requeue(
    jobs: DataFrame, view: str, library_id: int | None = None, single: bool = False
) -> DataFrame:
    """What putting a view back in the queue does: id, path, verdict.

    Of several jobs for a path the newest is 'requeued'. The others, and those whose path is
    already active, are 'skipped'; with `single`, a retry whose path is active is 'removed'.
    """
    if view == "active":
        raise ValueError("those jobs are already queued")
    wanted = jobs.where(in_view(F.col("state"), view))
    if library_id is not None:
        wanted = wanted.where(F.col("library_id") == library_id)
    wanted = wanted.select("id", "path")
    busy = jobs.where(F.col("state").isin(ACTIVE_STATES)).select("path").distinct()
    winners = (
        wanted.groupBy("path")
        .agg(F.max("id").alias("id"))
        .join(busy, "path", "left_anti")
        .select("id", F.lit("requeued").alias("verdict"))
    )
    lost = F.lit("removed" if single else "skipped")
    return wanted.join(winners, "id", "left").select(
        "id", "path", F.coalesce(F.col("verdict"), lost).alias("verdict")
    )


RESET_ON_REQUEUE = {
    "node_id": None, "lease_expires": None, "progress": 0, "fps": 0, "speed": 0, "error": None,
}


def apply_requeue(jobs: DataFrame, plan: DataFrame) -> DataFrame:
    """The ledger after a requeue plan: moved rows are reset, 'removed' rows leave."""
    marked = jobs.join(plan.select("id", "verdict"), "id", "left")
    moved = F.coalesce(F.col("verdict") == "requeued", F.lit(False))
    out = marked.where(F.coalesce(F.col("verdict"), F.lit("")) != "removed").withColumn(
        "state", F.when(moved, "queued").otherwise(F.col("state"))
    )
    for name, value in RESET_ON_REQUEUE.items():
        if name in jobs.columns:
            kind = jobs.schema[name].dataType
            out = out.withColumn(name, F.when(moved, F.lit(value).cast(kind)).otherwise(F.col(name)))
    return out.select(*jobs.columns)


def cancel_active(jobs: DataFrame, now_s: Column, library_id: int | None = None) -> DataFrame:
    """The ledger after cancelling all active work, or that of one library."""
    hit = F.col("state").isin(ACTIVE_STATES)
    if library_id is not None:
        hit = hit & F.coalesce(F.col("library_id") == library_id, F.lit(False))
    return jobs.withColumns(
        {
            "finished_s": F.when(hit, now_s).otherwise(F.col("finished_s")),
            "state": F.when(hit, "cancelled").otherwise(F.col("state")),
        }
    )


def clear_view(jobs: DataFrame, view: str, library_id: int | None = None) -> DataFrame:
    """The ledger without the jobs of a view."""
    if view == "active":
        raise ValueError("cancel active jobs instead of clearing them")
    hit = in_view(F.col("state"), view)
    if library_id is not None:
        hit = hit & F.coalesce(F.col("library_id") == library_id, F.lit(False))
    return jobs.where(~hit)


def accept(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Keep converted files despite their size: the given jobs become done."""
    marked = jobs.join(ids.select("id").distinct().withColumn("__take", F.lit(True)), "id", "left")
    take = F.coalesce(F.col("__take"), F.lit(False))
    return marked.withColumns(
        {
            "state": F.when(take, "done").otherwise(F.col("state")),
            "outcome": F.when(
                take, F.concat(F.coalesce(F.col("outcome"), F.lit("")), F.lit(" (accepted by hand)"))
            ).otherwise(F.col("outcome")),
        }
    ).select(*jobs.columns)


def requeue_expired(jobs: DataFrame, now_s: Column) -> DataFrame:
    """The ledger after leases that outlived their node went back to the queue."""
    hit = F.coalesce(
        F.col("state").isin("leased", "running") & (F.col("lease_expires_s") < now_s), F.lit(False)
    )
    changes = {"state": F.lit("queued"), "node_id": None, "lease_expires_s": None,
               "progress": 0, "fps": 0, "speed": 0}
    out = {}
    for name, value in changes.items():
        if name in jobs.columns:
            new = value if isinstance(value, Column) else F.lit(value).cast(jobs.schema[name].dataType)
            out[name] = F.when(hit, new).otherwise(F.col(name))
    return jobs.withColumns(out)

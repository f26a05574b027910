"""One scan over all libraries, from the folder listing to what happens to each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacat.functions import constants as K
from mediacat.functions import rules
from mediacat.operators import scan

PROBE_COLUMNS = ["duration_s", "video_bitrate", "video_codec", "audio_codecs", "height"]
OUTCOMES = ["queued", "waiting", "already_ok", "filtered_out"]


def scan_libraries(
    listing: DataFrame,
    libraries: DataFrame,
    processed: DataFrame,
    jobs: DataFrame,
    probes: DataFrame,
    now_s: Column,
    stable: DataFrame | None = None,
) -> DataFrame:
    """Files of enabled libraries that are new to the scan, with `outcome`, `skip` and `plan`.

    listing: path, size, mtime_s. libraries: library_id, name, watch_path, enabled,
    skip_matching and the structs filters (see `rules.tidy_filters`) and spec. probes: path and
    the probe columns, which takes the place of a probe callback. stable: path, stable from
    earlier scans, for files too young to count as settled.

    Work already done drops out first; the probe table is met only by files that are complete
    and pass the rules a listing can answer. Every table is met by path alone, and the ledger in one aggregate, so
    that the listing is shuffled once.
    """
    files = scan.owning_library(scan.media_only(listing), libraries.where("enabled"))
    files = scan.not_processed(files.where(F.col("library_id").isNotNull()), processed)
    files = files.join(scan.ledger_marks(jobs), "path", "left")
    held = F.col("stuck") & (F.col("size") == F.col("stuck_size"))
    files = files.where(~F.coalesce(held, F.lit(False))).drop("stuck", "stuck_size").withColumnRenamed("busy", "__busy")
    settled = scan.is_settled(F.col("mtime_s"), now_s)
    if stable is not None:
        files = files.join(stable.select("path", "stable"), "path", "left")
        settled = settled | F.coalesce(F.col("stable"), F.lit(False))
    files = files.join(libraries.drop("name", "watch_path", "enabled"), "library_id")

    cheap = rules.skip_reason(F.col("path"), F.col("size"), F.col("filters"))
    files = files.withColumn("settled", settled).withColumn(
        "__look", F.col("settled") & cheap["code"].isNull()
    )
    found = probes.select(F.col("path").alias("__probe"), *PROBE_COLUMNS)
    df = files.join(found, (F.col("path") == F.col("__probe")) & F.col("__look"), "left")
    df = scan.decide(df)
    right = (F.col("plan.action") == "skip") & F.col("skip_matching")
    outcome = (
        F.when(~F.col("settled"), "waiting")
        .when(F.col("skip.code").isNotNull(), "filtered_out")
        .when(right, "already_ok")
        .when(F.col("__busy"), "has_job")
        .otherwise("queued")
    )
    return df.withColumn("outcome", outcome).drop("__probe", "__look", "__busy", "filters")


def scan_report(decisions: DataFrame) -> DataFrame:
    """Counts per library of what a scan did."""
    return decisions.groupBy("library_id").agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    )


def scan_reasons(decisions: DataFrame) -> DataFrame:
    """How often each reason was given, for queued and filtered files."""
    reason = F.when(F.col("outcome") == "filtered_out", F.col("skip.reason")).when(
        F.col("outcome") == "queued", F.col("plan.why")
    )
    return (
        decisions.select(reason.alias("reason")).where(F.col("reason").isNotNull())
        .groupBy("reason").agg(F.count(F.lit(1)).alias("files"))
    )

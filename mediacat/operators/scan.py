"""From a folder listing to decisions about files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediacat.functions import constants as K
from mediacat.functions import names, paths, rules
from mediacat.operators.containment import below_folders


def media_only(listing: DataFrame, path: str = "path") -> DataFrame:
    """Video files outside the skipped folders."""
    p = F.col(path)
    return listing.where(paths.is_video(p) & ~paths.in_skip_dir(p))


def _trimmed(root: Column) -> Column:
    return F.regexp_replace(root, "/+$", "")


def owning_library(
    files: DataFrame, libraries: DataFrame, order: str = "name", path: str = "path",
    root: str = "watch_path",
) -> DataFrame:
    """Files with `library_id` of the first library (by `order`) whose folder contains them, NULL where none does.

    The first among nested folders is worked out on the library side; see `containment.below_folders` for
    how files find it. No job runs while this is built, and the file list is read once.
    """
    roots = (
        libraries.select(_trimmed(F.col(root)).alias("root"), F.struct(F.col(order).alias("place"), "library_id").alias("lib"))
        .groupBy("root").agg(F.min("lib").alias("value"))
    )
    first = below_folders(files, roots, lambda held: F.array_min(F.transform(held, lambda r: r["value"])), "__owner", path)
    return first.withColumn("library_id", F.col("__owner.library_id")).drop("__owner")


def not_processed(files: DataFrame, processed: DataFrame) -> DataFrame:
    """Files not handled before: no processed row with the same path and about the same time."""
    p = processed.select(F.col("path").alias("__p"), F.col("mtime_s").alias("__m"))
    same = (F.col("path") == F.col("__p")) & (
        F.abs(F.coalesce(F.col("__m"), F.lit(0)) - F.col("mtime_s")) < 1
    )
    return files.join(p, same, "left_anti")


def latest_stuck(jobs: DataFrame) -> DataFrame:
    """Newest failed, ignored or bloated job of each path."""
    return (
        jobs.where(F.col("state").isin(K.STUCK_STATES))
        .groupBy("path")
        .agg(F.max(F.struct("id", "size_before")).alias("s"))
        .select("path", F.col("s.id").alias("job_id"), F.col("s.size_before").alias("job_size"))
    )


def not_stuck(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """Files that no unresolved job of the same size is waiting on."""
    stuck = latest_stuck(jobs).select(
        F.col("path").alias("__p"), F.col("job_size").alias("__s")
    )
    return files.join(stuck, (F.col("path") == F.col("__p")) & (F.col("size") == F.col("__s")), "left_anti")


def ledger_marks(jobs: DataFrame) -> DataFrame:
    """What a scan asks of the ledger, one row a path: `stuck_size` of its newest unresolved job, and `busy`.

    `stuck` tells whether there is such a job, as its size may be NULL.
    """
    stuck = F.max(F.when(F.col("state").isin(K.STUCK_STATES), F.struct("id", "size_before")))
    return (
        jobs.where(F.col("state").isin([*K.STUCK_STATES, *K.ACTIVE_STATES]))
        .groupBy("path")
        .agg(stuck.alias("__s"), F.max(F.col("state").isin(K.ACTIVE_STATES)).alias("busy"))
        .select("path", F.col("__s").isNotNull().alias("stuck"), F.col("__s.size_before").alias("stuck_size"), "busy")
    )


def stuck_files(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """Files held back by an unresolved job, with that job."""
    return files.join(latest_stuck(jobs), "path").where(F.col("size") == F.col("job_size"))


def is_settled(mtime_s: Column, now_s: Column) -> Column:
    return (now_s - mtime_s) > K.SETTLED_AGE_S


def size_stability(scans: DataFrame, order: list[str]) -> DataFrame:
    """Per path, whether the last two scans saw the same size; a first sight is not stable.

    Only the two newest scans of a path are compared, and map tasks already drop the others
    before the shuffle (a rank limit of two). Both windows share one sort, and nothing else of a task holds rows.
    """
    newest = W.partitionBy("path").orderBy(*[F.desc(c) for c in [*order, "size"]])
    own = list(dict.fromkeys(["path", *order, "size"]))
    two = scans.select(*own, F.row_number().over(newest).alias("__n")).where(F.col("__n") <= 2)
    pairs = two.select("path", "size", "__n", F.lead("size").over(newest).alias("__before"))
    stable = F.coalesce(F.col("size") == F.col("__before"), F.lit(False))
    return pairs.where(F.col("__n") == 1).select("path", "size", stable.alias("stable"))


def destination_conflicts(files: DataFrame, existing: DataFrame, first_wins: bool = False) -> DataFrame:
    """Files (path, destination) with what stands in the way of their destination.

    `conflict` is 'exists' when another file is already there, 'shared' when several files
    resolve to the same place, NULL when the way is free. With `first_wins` the first path of those
    that share a free place gets it.
    """
    shared = (
        files.groupBy("destination").agg(F.count(F.lit(1)).alias("__n"), F.min("path").alias("__winner"))
        .where(F.col("__n") > 1)
        .select("destination", F.lit(True).alias("__shared"), "__winner")
    )
    taken = existing.select(F.col("path").alias("destination"), F.lit(True).alias("__taken")).distinct()
    return (
        files.join(taken, "destination", "left")
        .join(shared, "destination", "left")
        .withColumn(
            "conflict",
            F.when(F.col("__taken") & (F.col("destination") != F.col("path")), "exists").when(
                F.col("__shared") & ~(F.lit(first_wins) & (F.col("path") == F.col("__winner"))), "shared"
            ),
        )
        .drop("__taken", "__shared", "__winner")
    )


def files_to_file(decided: DataFrame) -> DataFrame:
    """Decided files (see `decide`) that need no conversion but belong elsewhere, with their `destination`.

    Only where the library leaves matching files alone (`skip_matching`), has an output folder, and the
    file is not in its place already: all others are queued or done with. Needs the struct `library` of
    `with_destination`.
    """
    right = F.col("skip.code").isNull() & (F.col("plan.action") == "skip") & F.col("skip_matching")
    placed = F.coalesce(F.col("library.output_path"), F.lit("")) != ""
    return with_destination(decided.where(right & placed)).where(F.col("destination") != F.col("path"))


def filed_rows(marked: DataFrame, jobs: DataFrame) -> DataFrame:
    """Ledger rows for files moved untouched (done) and for those that collided (failed).

    A collision is logged once: not for a path that has any job. A filed path is logged unless
    it has an active job. `marked` has path, destination, size, library_id and the `conflict` of
    `destination_conflicts`.
    """
    known = jobs.groupBy("path").agg(
        F.max(F.col("state").isin(K.ACTIVE_STATES)).alias("__active")
    )
    stuck = F.col("conflict").isNotNull()
    logged = F.when(stuck, F.col("__active").isNull()).otherwise(
        ~F.coalesce(F.col("__active"), F.lit(False))
    )
    text = F.concat(
        F.lit("Already in the wanted form, but its place is taken: "), F.col("destination"),
    )
    return (
        marked.join(known, "path", "left")
        .where(logged)
        .select(
            "path",
            "library_id",
            F.when(stuck, "failed").otherwise("done").alias("state"),
            F.when(~stuck, F.col("size")).alias("size_before"),
            F.when(~stuck, F.col("size")).alias("size_after"),
            F.when(~stuck, F.col("destination")).alias("final_path"),
            F.when(stuck, text).alias("error"),
        )
    )


def decide(files: DataFrame) -> DataFrame:
    """Skip rules and conversion plan of files that carry their library's settings.

    Needs path, size, probe columns (duration_s, video_bitrate, video_codec, audio_codecs,
    height) and the settings structs `filters` and `spec` (codec, audio, container). Adds
    `skip` (code, reason) and `plan` (action, codec, audio, why).
    """
    f = F.col("filters")
    efficient = rules.video_is_efficient(F.col("video_bitrate"), F.col("height"), f["bitrate_ceiling"])
    return files.withColumns(
        {
            "skip": rules.skip_reason(
                F.col("path"), F.col("size"), f, F.col("duration_s"), F.col("video_bitrate"),
                F.col("video_codec"),
            ),
            "plan": rules.conversion_plan(
                F.col("path"), F.col("video_codec"), F.col("audio_codecs"), efficient,
                F.col("spec.codec"), F.col("spec.audio"), F.col("spec.container"),
            ),
        }
    )


def with_destination(files: DataFrame, container: Column | None = None) -> DataFrame:
    """Add `destination`, parsing names only where the library renames.

    Needs path and a struct `library` (output_path, watch_path, mirror_folders, naming).
    """
    parsed = files if "parsed" in files.columns else names.parse_names(files, "path")
    ext = paths.suffix(paths.file_name(F.col("path"))) if container is None else container
    return names.with_destination(parsed, "path", ext, "library", "parsed")

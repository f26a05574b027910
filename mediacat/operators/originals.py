"""Archived originals: totals, finding them, and what may be deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacat.functions import paths
from mediacat.operators.containment import below_folders


def summary(originals: DataFrame) -> DataFrame:
    return originals.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")
    )


def older_than(originals: DataFrame, now_s: Column, seconds: float) -> DataFrame:
    return originals.where(F.col("archived_s") < now_s - seconds)


def replacement_check(originals: DataFrame, inventory: DataFrame) -> DataFrame:
    """Originals with `replacement_ok`: does the converted file exist?"""
    there = inventory.select(F.col("path").alias("final_path"), F.lit(True).alias("__there"))
    return (
        originals.join(there, "final_path", "left")
        .withColumn("replacement_ok", F.coalesce(F.col("__there"), F.lit(False)))
        .drop("__there")
    )


def sweep_plan(originals: DataFrame, inventory: DataFrame, now_s: Column, after_days: float) -> DataFrame:
    """Verdict on each original past its age: 'forget', 'keep' or 'delete', and bytes freed.

    `replacement_ok` tells whether the converted file exists at all.

    The ledger alone is never trusted: an original goes only when its replacement exists and is
    not empty. `inventory` has one row per existing path.
    """
    old = older_than(originals, now_s, after_days * 86400)
    archived = inventory.select(F.col("path").alias("archived_path"), F.col("size").alias("__asize"))
    final = inventory.select(F.col("path").alias("final_path"), F.col("size").alias("__fsize"))
    verdict = (
        F.when(F.col("__asize").isNull(), "forget")
        .when(F.coalesce(F.col("__fsize"), F.lit(0)) == 0, "keep")
        .otherwise("delete")
    )
    return (
        old.join(archived, "archived_path", "left")
        .join(final, "final_path", "left")
        .withColumn("verdict", verdict)
        .withColumn("freed", F.when(F.col("verdict") == "delete", F.col("__asize")).otherwise(F.lit(0)))
        .withColumn("replacement_ok", F.col("__fsize").isNotNull())
        .drop("__asize", "__fsize")
    )


def archived_source(jobs: DataFrame, libraries: DataFrame, originals: DataFrame, inventory: DataFrame) -> DataFrame:
    """Jobs with `archived` (path of the archived source) and `found_by`.

    Looked for in turn: the ledger's path ('ledger'), the place the library would have put it
    ('expected'), and the same file name anywhere below the library's originals ('searched').
    The last two only where the library archives. Needs id, path, library_id of the jobs.
    """
    libs = libraries.select(
        "library_id",
        F.col("watch_path").alias("__watch"),
        (F.col("original_action") == "archive").alias("__archives"),
        paths.originals_dir(
            F.col("name"), F.col("watch_path"), F.col("output_path"), F.col("originals_path")
        ).alias("__home"),
    )
    there = inventory.select("path")
    recorded = (
        originals.join(there.withColumnRenamed("path", "archived_path"), "archived_path", "left_semi")
        .groupBy(F.col("job_id").alias("id"))
        .agg(F.min("archived_path").alias("__ledger"))
    )

    below = F.coalesce(
        paths.relative_to(F.col("path"), F.col("__watch")), paths.file_name(F.col("path"))
    )
    base = jobs.join(libs, "library_id", "left").withColumns(
        {
            "__guess": F.when(F.col("__archives"), paths.join(F.col("__home"), below)),
            "__name": F.when(F.col("__archives"), paths.file_name(F.col("path"))),
        }
    )
    expected = there.select(F.col("path").alias("__guess"), F.col("path").alias("__expected"))

    # Inventory below an originals folder, reduced to one path per folder and file name. Folders
    # may be nested, so a file counts for each of them that contains it.
    homes = libs.where("__archives").select(F.col("__home").alias("root")).distinct().withColumn("value", F.lit(True))
    below_home = below_folders(
        there, homes, lambda held: F.transform(held, lambda r: r["root"]), "__homes"
    ).select("path", F.explode("__homes").alias("__home"))
    searched = below_home.groupBy("__home", paths.file_name(F.col("path")).alias("__name")).agg(
        F.min("path").alias("__searched")
    )

    return (
        base.join(recorded, "id", "left")
        .join(expected, "__guess", "left")
        .join(searched, ["__home", "__name"], "left")
        .withColumns(
            {
                "archived": F.coalesce("__ledger", "__expected", "__searched"),
                "found_by": F.when(F.col("__ledger").isNotNull(), "ledger")
                .when(F.col("__expected").isNotNull(), "expected")
                .when(F.col("__searched").isNotNull(), "searched"),
            }
        )
        .select(*jobs.columns, "archived", "found_by")
    )

"""Which of many folders a path lies below, by one equality join.

Folders are intervals of paths: all that lies below `/a/b` sorts from `/a/b/` up to `/a/b0`, as `0` follows `/`. Nested
folders nest as intervals, so their ends cut the paths into stretches, and what is in force changes only at an
end. The ends below one leading folder are kept sorted in a row of their own; a path meets that one row and finds its stretch
by halving. Nothing has to be known about the folders while the plan is built.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacat.functions import paths


def _head(path: Column, level: Column) -> Column:
    return F.call_function("substring_index", path, F.lit("/"), level)


def _ancestors(root: Column) -> Column:
    """The folder itself and all folders above it."""
    levels = F.sequence(F.lit(1), paths.depth(root))
    return F.transform(levels, lambda n: _head(root, n))


def folder_ends(
    roots: DataFrame, fold: Callable[[Column], Column], level: Column, keys: Sequence[str] = ()
) -> DataFrame:
    """Per `keys` and leading folder `__head`: `__ends`, a sorted array of (at, inside), and the halving `__steps`.

    `roots` has one row for each of `keys` and `root`, with a `value`. `inside` is `fold` of the array of (root, value) of the folders in force,
    outermost first; NULL where none is. Rows grow with the folders, never with their pairs: a folder
    meets those above it through the folders' ancestors.
    """
    said = F.when(F.col("__at") == F.col("root"), F.struct(F.col("value").alias("v")))
    met = (
        roots.select(*keys, "root", "value", F.explode(_ancestors(F.col("root"))).alias("__at"))
        .groupBy(*keys, "__at")
        .agg(F.first(said, ignorenulls=True).alias("__said"), F.collect_list("root").alias("__below"))
        .where(F.col("__said").isNotNull())
        .select(*keys, F.explode("__below").alias("root"), F.col("__at"), F.col("__said.v").alias("__value"))
    )
    chains = met.groupBy(*keys, "root").agg(
        F.array_sort(F.collect_list(F.struct(F.col("__at").alias("root"), F.col("__value").alias("value")))).alias("__chain")
    )
    chain, outer = F.col("__chain"), F.slice("__chain", F.lit(1), F.size("__chain") - 1)
    ends = F.array(
        F.struct(F.concat("root", F.lit("/")).alias("at"), fold(chain).alias("inside")),
        F.struct(F.concat("root", F.lit("0")).alias("at"), F.when(F.size(outer) > 0, fold(outer)).alias("inside")),
    )
    grouped = (
        chains.select(*keys, _head(F.col("root"), level).alias("__head"), F.explode(ends).alias("__end"))
        .groupBy(*keys, "__head")
        .agg(F.array_sort(F.collect_list("__end")).alias("__ends"))
    )
    highest = F.length(F.bin(F.size("__ends"))) - 1
    steps = F.transform(F.sequence(highest, F.lit(0), F.lit(-1)), lambda n: F.call_function("shiftleft", F.lit(1), n))
    return grouped.withColumn("__steps", steps)


def below_folders(
    files: DataFrame, roots: DataFrame, fold: Callable[[Column], Column], into: str, path: str = "path",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Files with `into`: what `fold` makes of the folders that contain their path (see `folder_ends`), else NULL.

    `roots` has root (no separator at its end), value and the `keys` that both sides must agree on, which are never NULL. One left join on the leading
    folder at the depth of the shallowest root: Spark broadcasts the folders where they are few, and the files are
    neither exploded nor compared with every folder. A path is below a folder only with a separator
    after it; a NULL path is below none. A row of folders holds those that share that leading folder.
    """
    held = roots.where(F.col("root").isNotNull()).select(*keys, "root", "value")
    level = F.coalesce(held.agg(F.min(paths.depth(F.col("root"))).alias("n")).scalar(), F.lit(1))
    ends = folder_ends(held, fold, level, keys)
    met = files.withColumn("__head", _head(F.col(path), level)).join(ends, [*keys, "__head"], "left")

    def halve(found: Column, step: Column) -> Column:
        fits = (found + step <= F.size("__ends")) & (F.get("__ends", found + step - 1)["at"] <= F.col(path))
        return F.when(fits, found + step).otherwise(found)

    found = F.aggregate("__steps", F.lit(0), halve)
    return met.withColumn(into, F.get("__ends", found - 1)["inside"]).select(*files.columns, into)

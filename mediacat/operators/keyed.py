"""Ordered work within a key that stays parallel when one key holds much of the data.

A window over a whole key runs in one task. The operators here either reduce before the shuffle
(`latest_per_key`) or cut each key into slices by a bucket column, work inside the slices, and
carry only one summary row per slice across slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The greatest row of each key by `order`, then by the other columns.

    An aggregate rather than a window, so that map tasks send one row per key.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__best"))
    return best.select(*[c if c in keys else F.col(f"__best.{c}").alias(c) for c in df.columns])


def previous_value(
    df: DataFrame, keys: list[str], order: list[str], value: str, bucket: Column, into: str
) -> DataFrame:
    """Value of the preceding row of the same (non-NULL) key, NULL for the first.

    `bucket` must not decrease along `order`; it decides how finely a key is cut.
    """
    df = df.withColumn("__bucket", bucket)
    in_slice = W.partitionBy(*keys, "__bucket").orderBy(*order)
    boxed = F.struct(F.col(value).alias("v"))
    marked = df.withColumn("__prev", F.lag(boxed).over(in_slice))
    ends = df.groupBy(*keys, "__bucket").agg(F.max(F.struct(*order, boxed.alias("b"))).alias("__end"))
    across = W.partitionBy(*keys).orderBy("__bucket")
    carried = ends.select(
        *keys, "__bucket", F.lag(F.col("__end.b")).over(across).alias("__carry")
    )
    return (
        marked.join(carried, [*keys, "__bucket"], "left")
        .withColumn(into, F.coalesce(F.col("__prev"), F.col("__carry"))["v"])
        .drop("__bucket", "__prev", "__carry")
    )


def last_known(
    df: DataFrame, keys: list[str], order: list[str], value: str, bucket: Column, into: str
) -> DataFrame:
    """Last non-NULL `value` of the same key strictly before the row."""
    df = df.withColumn("__bucket", bucket)
    in_slice = (
        W.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    )
    marked = df.withColumn("__prev", F.last(F.col(value), ignorenulls=True).over(in_slice))
    known = F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("v")))
    ends = df.groupBy(*keys, "__bucket").agg(F.max(known).alias("__end"))
    across = W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(
        *keys,
        "__bucket",
        F.last(F.col("__end.v"), ignorenulls=True).over(across).alias("__carry"),
    )
    return (
        marked.join(carried, [*keys, "__bucket"], "left")
        .withColumn(into, F.coalesce(F.col("__prev"), F.col("__carry")))
        .drop("__bucket", "__prev", "__carry")
    )


def sessions(df: DataFrame, key: str, ts_s: str, gap_s: int, bucket_s: int) -> DataFrame:
    """Runs of events of a key whose neighbours are at most `gap_s` apart.

    Returns key, session_start, session_end, events. Sessions are first closed inside slices of
    `bucket_s`; only the first and last session of a slice can continue in another one, so only
    those are compared across the whole key.
    """
    if bucket_s <= gap_s:
        raise ValueError("a slice must be longer than the gap")
    slices = df.select(key, F.col(ts_s).alias("__ts")).withColumn(
        "__bucket", F.floor(F.col("__ts") / bucket_s)
    )
    order = W.partitionBy(key, "__bucket").orderBy("__ts")
    starts = F.when(
        F.coalesce(F.col("__ts") - F.lag("__ts").over(order) > gap_s, F.lit(True)), 1
    ).otherwise(0)
    numbered = slices.withColumn("__new", starts).withColumn(
        "__n", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0))
    )
    local = numbered.groupBy(key, "__bucket", "__n").agg(
        F.min("__ts").alias("session_start"),
        F.max("__ts").alias("session_end"),
        F.count(F.lit(1)).alias("events"),
    )
    in_slice = W.partitionBy(key, "__bucket")
    local = local.withColumn("__last", F.max("__n").over(in_slice))
    edge = (F.col("__n") == 1) | (F.col("__n") == F.col("__last"))
    inner = local.where(~edge).select(key, "session_start", "session_end", "events")

    along = W.partitionBy(key).orderBy("session_start")
    joined = (
        local.where(edge)
        .withColumn(
            "__new",
            F.when(
                F.coalesce(
                    F.col("session_start") - F.lag("session_end").over(along) > gap_s, F.lit(True)
                ),
                1,
            ).otherwise(0),
        )
        .withColumn("__run", F.sum("__new").over(along.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(key, "__run")
        .agg(
            F.min("session_start").alias("session_start"),
            F.max("session_end").alias("session_end"),
            F.sum("events").alias("events"),
        )
        .select(key, "session_start", "session_end", "events")
    )
    return inner.unionByName(joined)


def _slice_of(bounds: list[int], key: Column) -> Column:
    """How many of the sorted bounds are <= key, by halving."""
    held = F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>")
    steps = F.array(*[F.lit(2**i) for i in reversed(range(len(bounds).bit_length()))])

    def halve(found: Column, step: Column) -> Column:
        fits = (found + step <= len(bounds)) & (F.get(held, found + step - 1) <= key)
        return F.when(fits, found + step).otherwise(found)

    return F.aggregate(steps, F.lit(0), halve) if bounds else F.lit(0)


def page_of(
    df: DataFrame, key: str, page: int, per_page: int, ascending: bool, buckets: int = 256, fits: int = 100_000
) -> DataFrame:
    """One page of rows in the order of a unique integer `key`, however deep.

    `per_page` is held to 1..100 and `page` to the pages there are. Approximate quantiles cut the keys into slices
    of about equal counts, however ids cluster; exact counts say between which two keys the page lies. That
    range is cut again until it holds at most `fits` rows, and only those are sorted. A level is one aggregate for
    the quantiles and one for the counts, both reduced before the shuffle. They run when this is called, and the
    driver sees `buckets` numbers of each: so the rows come back by a plain range of keys, which a scan can use to
    leave out whole files.
    """
    per_page = max(1, min(100, int(per_page)))
    kind = df.schema[key].dataType
    order = F.col(key).cast("bigint") if ascending else -F.col(key).cast("bigint")
    total = df.where(F.col(key).isNotNull()).count()
    first = (min(max(1, int(page)), max(1, -(-total // per_page))) - 1) * per_page
    inside, count, before = df.where(F.col(key).isNotNull()), total, 0
    while count > fits:
        cuts = [i / buckets for i in range(1, buckets)]
        bounds = inside.agg(F.percentile_approx(order, cuts, 10 * buckets).alias("b")).first()["b"]
        counts = inside.groupBy(_slice_of(sorted(set(bounds)), order).alias("s")).agg(
            F.count(F.lit(1)).alias("n"), F.min(order).alias("low"), F.max(order).alias("high")
        )
        lows, highs, held, upto = [], [], 0, before
        for r in sorted(counts.collect(), key=lambda r: r["s"]):  # `buckets` rows
            if upto + r["n"] > first and upto < first + per_page:
                before = before if lows else upto
                held += r["n"]
                lows.append(r["low"])
                highs.append(r["high"])
            upto += r["n"]
        if held == count:
            break
        ends = sorted(n if ascending else -n for n in (lows[0], highs[-1]))
        inside, count = inside.where(F.col(key).between(*[F.lit(n).cast(kind) for n in ends])), held
    position = (F.lit(before) + F.row_number().over(W.orderBy(order))).cast("bigint")
    return inside.withColumn("position", position).where((F.col("position") > first) & (F.col("position") <= first + per_page))

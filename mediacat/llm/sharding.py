"""Job logs dealt into shards by sampled splitters.

Keys are drawn in proportion to size, their quantiles become range boundaries, records fall into the
ranges, and ranges that turn out overfull are cut again at their own quantiles. Whole ranges, in key
order, then make up the shards. Everything is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediacat.llm.shared import shared_folder, written

LAW = "bytes"
SHARDS = 8
LEAST_RANGES = 2048
ROWS_A_RANGE = 1_000_000
DRAWS_A_RANGE = 20


def _luck(*by: str | Column) -> Column:
    """Evenly spread over [0, 1), the same again when a task is repeated."""
    return F.pmod(F.xxhash64(*by), F.lit(2**40)) / F.lit(float(2**40))


def _cuts(keys: Column, parts: Column) -> Column:
    """The keys at the cuts of a sorted sample into `parts` equal shares."""
    at = F.sequence(F.lit(1), F.greatest(parts - 1, F.lit(1)))
    return F.array_distinct(
        F.transform(at, lambda i: F.get(keys, F.floor(i * F.size(keys) / parts).cast("int")))
    )


def _place(bounds: Column, key: Column, most: int) -> Column:
    """How many sorted bounds are <= key, by halving instead of a look at each of them."""
    steps = F.array(*[F.lit(2**i) for i in reversed(range(most.bit_length()))])

    def halve(found: Column, step: Column) -> Column:
        fits = (found + step <= F.size(bounds)) & (F.get(bounds, found + step - 1) <= key)
        return F.when(fits, found + step).otherwise(found)

    return F.coalesce(F.aggregate(steps, F.lit(0), halve), F.lit(0))


def shard_logs(logs: DataFrame, job_id: str = "job_id", log: str = "log", shards: int = SHARDS) -> DataFrame:
    """Job logs in shards of nearly equal bytes; logs with the same text lie together.

    A log's key is its text's 64-bit hash, so that copies are neighbours; its size is the bytes of its
    text plus one (NULL and empty: one). Keys are drawn with a chance in proportion to size: the sample
    is bounded, the records are not, each is placed. A range above twice its share is cut at the
    quantiles of its own keys mixed with the job id, so even one hot text can be dealt out; only then
    do copies part. A shard is a run of whole ranges.

    Rows are taken one by one: repeated rows and ids get a slot each. No rows give no rows. Other
    columns are not looked at. Returns job_id, size, text_crc32, law, shard, slot (gapless from 0 in a
    shard, in key order), grown_shard (NULL: this law deals anew).
    """
    text = F.coalesce(F.col(log), F.lit(""))
    placed = written(
        logs.select(
            F.col(job_id).alias("job_id"),
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
        ),
        shared_folder(logs.sparkSession), "placed",
    )
    total = placed.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    size_of_all = float(total["bytes"] or 1)
    ranges = max(LEAST_RANGES, total["rows"] // ROWS_A_RANGE)
    share = size_of_all / ranges

    drawn = placed.where(_luck("key", "job_id", F.lit(1)) < F.col("size") * (DRAWS_A_RANGE / share))
    bounds = drawn.agg(F.array_sort(F.collect_list("key")).alias("keys")).select(
        _cuts(F.col("keys"), F.lit(ranges)).alias("bounds")
    ).scalar()
    ranged = placed.withColumn("bounds", bounds).select(
        *placed.columns, _place(F.col("bounds"), F.col("key"), ranges).alias("r")
    )

    # Overfull ranges get as many pieces as they hold shares.
    mixed = F.xxhash64("key", "job_id", F.lit(2))
    over = ranged.groupBy("r").agg(F.sum("size").alias("held")).where(F.col("held") > 2 * share)
    inner = (
        ranged.join(over, "r")
        .where(_luck("key", "job_id", F.lit(3)) < F.col("size") * (DRAWS_A_RANGE / share))
        .groupBy("r").agg(F.array_sort(F.collect_list(mixed)).alias("keys"), F.max("held").alias("held"))
        .select("r", _cuts(F.col("keys"), F.ceil(F.col("held") / share)).alias("bounds"))
    )
    cut = ranged.join(inner, "r", "left").select(
        *placed.columns, "r", _place(F.col("bounds"), mixed, ranges).alias("piece")
    )

    # One row for each range, whatever the input: running totals say which shard it belongs to.
    sums = cut.groupBy("r", "piece").agg(F.sum("size").alias("held"), F.count(F.lit(1)).alias("n"))
    earlier = W.orderBy("r", "piece").rowsBetween(W.unboundedPreceding, -1)
    middle = F.coalesce(F.sum("held").over(earlier), F.lit(0)) + F.col("held") / 2
    dealt = sums.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / size_of_all)).cast("int"))
    within = W.partitionBy("shard").orderBy("r", "piece").rowsBetween(W.unboundedPreceding, -1)
    starts = dealt.select(
        "r", "piece", "shard", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("start")
    )
    inside = W.partitionBy("r", "piece").orderBy("key", "job_id", "size")
    return (
        cut.withColumn("nth", F.row_number().over(inside))
        .join(starts, ["r", "piece"])
        .select(
            "job_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
            (F.col("start") + F.col("nth") - 1).cast("bigint").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )

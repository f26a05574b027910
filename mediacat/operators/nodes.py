"""Which node can run what, how fast, and when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediacat.functions import constants as K
from mediacat.functions import paths
from mediacat.operators.containment import below_folders


def _families(encoders: Column) -> Column:
    """Codecs a node can serve; copying the picture needs no encoder."""
    own = [
        F.when(F.arrays_overlap(encoders, F.array(*[F.lit(e) for e in members])), F.lit(codec))
        for codec, members in K.CODEC_FAMILIES.items()
    ]
    return F.array_compact(F.array(F.lit("copy"), *own))


def _outer_roots(mounts: Column) -> Column:
    """Server folders a node has mounted, without those inside another of its mounts."""
    roots = F.array_distinct(
        F.filter(F.transform(mounts, lambda m: paths.unify_slashes(m["server"])), lambda r: r != "")
    )
    return F.filter(
        roots,
        lambda r: ~F.exists(roots, lambda q: (q != r) & r.startswith(F.concat(q, F.lit("/")))),
    )


def _streamable(codec: Column, size: Column) -> Column:
    """Worth sending over the network: not a copy, and large or of unknown size."""
    known = F.coalesce(size, F.lit(0))
    return (codec != "copy") & ((known == 0) | (known >= K.REMOTE_MIN_BYTES))


def _all_counts(held: Column) -> Column:
    """Nodes counted at any of the nested folders, and the first of them."""
    total = F.aggregate(held, F.lit(0).cast("bigint"), lambda n, r: n + r["value"]["n"])
    return F.struct(total.alias("n"), F.array_min(F.transform(held, lambda r: r["value"]["first"])).alias("first"))


def eligible_nodes(jobs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Queued jobs with how many nodes could take them, and the first of those.

    Nodes are counted per (codec, mounted folder) and per codec before they meet the jobs, so the
    work is one lookup per job rather than one row per job and node. The outer
    mounts of a node never contain each other, so the counts add up.
    Needs id, path, codec, size_before; nodes: node_id, encoders, mounts.
    """
    able = nodes.select("node_id", F.explode(_families(F.col("encoders"))).alias("codec"), "mounts")
    by_codec = able.groupBy("codec").agg(
        F.count(F.lit(1)).alias("__all"), F.min("node_id").alias("__all_first")
    )
    by_root = (
        able.select("node_id", "codec", F.explode(_outer_roots(F.col("mounts"))).alias("root"))
        .groupBy("codec", "root")
        .agg(F.struct(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("first")).alias("value"))
    )
    out = jobs.withColumn("__path", paths.unify_slashes(F.col("path"))).join(by_codec, "codec", "left")
    out = below_folders(out, by_root, _all_counts, "__near", "__path", ["codec"])
    local = F.coalesce(F.col("__near.n"), F.lit(0))
    local_first = F.col("__near.first")
    stream = _streamable(F.col("codec"), F.col("size_before"))
    return out.select(
        "id",
        "codec",
        F.when(stream, F.coalesce(F.col("__all"), F.lit(0))).otherwise(local).cast("bigint").alias("nodes"),
        local.cast("bigint").alias("local_nodes"),
        F.when(stream, F.col("__all_first")).otherwise(local_first).alias("first_node"),
    )


def next_job_per_node(jobs: DataFrame, nodes: DataFrame, active: DataFrame) -> DataFrame:
    """Oldest queued job each enabled node with a free slot could take now.

    Jobs are reduced to the oldest per (codec, mounted folder) and the oldest streamable one per
    codec; nodes pick from those. A report of candidates: nothing is claimed, and two nodes may
    be shown the same job. `active` has node_id, active.
    """
    ready = (
        nodes.join(active.select("node_id", "active"), "node_id", "left")
        .withColumn("slots", F.coalesce(F.col("slots"), F.col("max_jobs"), F.lit(1)))
        .where(
            F.col("enabled")
            & (F.col("slots") >= 1)
            & (F.coalesce(F.col("active"), F.lit(0)) < F.col("slots"))
        )
    )
    able = ready.select("node_id", F.explode(_families(F.col("encoders"))).alias("codec"), "mounts")
    roots = able.select("node_id", "codec", F.explode(_outer_roots(F.col("mounts"))).alias("root"))

    queued = jobs.where(F.col("state") == "queued").select(
        "id", "codec", "size_before", paths.unify_slashes(F.col("path")).alias("path")
    )
    wanted = roots.select("codec", "root").distinct().withColumn("value", F.lit(True))
    local = (
        below_folders(queued, wanted, lambda held: F.transform(held, lambda r: r["root"]), "__roots", "path", ["codec"])
        .select("id", "codec", F.explode("__roots").alias("root"))
        .groupBy("codec", "root")
        .agg(F.min("id").alias("id"))
    )
    stream = (
        queued.where(_streamable(F.col("codec"), F.col("size_before")))
        .groupBy("codec")
        .agg(F.min("id").alias("id"))
    )
    offers = able.join(stream, "codec").select("node_id", "id").unionByName(
        roots.join(local, ["codec", "root"]).select("node_id", "id")
    )
    best = offers.groupBy("node_id").agg(F.min("id").alias("id"))
    chosen = best.join(ready.select("node_id", "mounts"), "node_id").join(
        jobs.select("id", "path"), "id"
    )
    where = paths.resolve_path(F.col("path"), F.col("mounts"))
    return chosen.withColumn("__w", where).select(
        "node_id", F.col("id").alias("job_id"), "__w.transport", "__w.node_path"
    )


# ---- encoder measurements ------------------------------------------------


def is_hardware(encoder: Column) -> Column:
    hit = F.lit(False)
    for s in K.HARDWARE_SUFFIXES:
        hit = hit | encoder.endswith(s)
    return hit


def can_do_ten_bit(fps10: Column) -> Column:
    """Zero means the test failed; never measured counts as able."""
    return fps10.isNull() | (fps10 != 0)


def falls_off_a_cliff(fps8: Column, fps10: Column) -> Column:
    """Able to do 10-bit, but so slowly that it must run in software."""
    return F.coalesce((fps8 != 0) & (fps10 != 0) & (fps10 < fps8 * K.TEN_BIT_CLIFF), F.lit(False))


def output_depth(fps8: Column, fps10: Column, want: Column, source_depth: Column) -> Column:
    """'8' or '10': an explicit wish is obeyed, 'match' avoids encoders that cannot or crawl."""
    return (
        F.when(want.isin("8", "10"), want)
        .when(F.coalesce(source_depth, F.lit(8)) <= 8, "8")
        .when(~can_do_ten_bit(fps10) | falls_off_a_cliff(fps8, fps10), "8")
        .otherwise("10")
    )


def speed_at(fps8: Column, fps10: Column, depth: Column) -> Column:
    ten = F.when(~can_do_ten_bit(fps10), 0.0).otherwise(
        F.coalesce(F.when(fps10 != 0, fps10), fps8, F.lit(0.0))
    )
    return F.when(depth == "10", ten).otherwise(F.coalesce(fps8, F.lit(0.0)))


def _preference(encoder: Column) -> Column:
    """Position in the fixed list of encoders, which settles ties."""
    listed = [e for members in K.CODEC_FAMILIES.values() for e in members]
    return F.array_position(F.array(*[F.lit(e) for e in listed]), encoder)


def best_encoder(
    bench: DataFrame, want: Column, source_depth: Column, by: list[str] | None = None
) -> DataFrame:
    """Encoder a node should use per codec family for a source of the given depth.

    Ranked by measured speed at the depth that would come out; hardware wins a near tie. Without
    any measurement the first listed encoder is taken. Needs node_id, family, encoder, fps8, fps10.
    All candidates of a group reduce to three maxima, so no window is needed. `by` names further
    columns that set cases apart.
    """
    depth = output_depth(F.col("fps8"), F.col("fps10"), want, source_depth)
    scored = bench.withColumns(
        {"__speed": speed_at(F.col("fps8"), F.col("fps10"), depth), "__pref": _preference(F.col("encoder"))}
    )
    rank = F.struct("__speed", -F.col("__pref"), "encoder")
    measured = F.col("__speed") > 0
    keys = [*(by or []), "node_id", "family"]
    groups = scored.groupBy(*keys).agg(
        F.max(F.when(measured, rank)).alias("best"),
        F.max(F.when(measured & is_hardware(F.col("encoder")), rank)).alias("hw"),
        F.min(F.struct("__pref", "encoder")).alias("listed"),
    )
    near = F.coalesce(
        F.col("hw.__speed") >= F.col("best.__speed") * K.HARDWARE_NEAR_TIE, F.lit(False)
    )
    return groups.select(
        *keys,
        F.when(near, F.col("hw.encoder"))
        .otherwise(F.coalesce(F.col("best.encoder"), F.col("listed.encoder")))
        .alias("encoder"),
        F.when(near, F.col("hw.__speed")).otherwise(F.coalesce(F.col("best.__speed"), F.lit(0.0))).alias("fps"),
    )


def encoder_ranking(bench: DataFrame) -> DataFrame:
    """Encoders of each node from fastest to slowest at 8-bit."""
    order = W.partitionBy("node_id").orderBy(F.col("fps8").desc(), _preference(F.col("encoder")))
    return bench.where(F.col("fps8").isNotNull()).withColumn("rank", F.row_number().over(order))


def ten_bit_cliff(bench: DataFrame) -> DataFrame:
    return bench.where(falls_off_a_cliff(F.col("fps8"), F.col("fps10")))


def benchmarks_long(nodes: DataFrame) -> DataFrame:
    """One row per node and encoder from the two benchmark maps of the node table."""
    eight = nodes.select("node_id", F.explode("benchmarks").alias("encoder", "fps8"))
    ten = nodes.select("node_id", F.explode("benchmarks_10bit").alias("encoder", "fps10"))
    return eight.join(ten, ["node_id", "encoder"], "full")


def software_fallback(nodes: DataFrame) -> DataFrame:
    """Encoders whose working recipe had to fall back to software."""
    return nodes.select("node_id", F.explode("recipes").alias("encoder", "recipe")).where(
        F.col("recipe").contains(K.SOFTWARE_RECIPE_MARK)
    )


# ---- work windows --------------------------------------------------------


def split_windows(windows: DataFrame) -> DataFrame:
    """Schedule windows (days, start, end as HH:MM) as half-open ranges within one weekday.

    An overnight window becomes two rows, its tail on the next weekday. No days means every day;
    a time that does not parse counts as 00:00 for the start and 23:59 for the end.
    """

    def seconds(text: str, fallback: int) -> Column:
        parts = F.split(F.col(text), ":")
        h = F.try_element_at(parts, F.lit(1)).try_cast("int")
        m = F.try_element_at(parts, F.lit(2)).try_cast("int")
        good = h.between(0, 23) & m.between(0, 59)
        return F.when(good, h * 3600 + m * 60).otherwise(fallback)

    every = F.sequence(F.lit(0), F.lit(6))
    days = F.when(F.size(F.coalesce("days", F.array().cast("array<int>"))) > 0, F.col("days")).otherwise(every)
    rows = windows.select(
        "window_id", F.explode(days).alias("day"), seconds("start", 0).alias("s"), seconds("end", 86340).alias("e")
    )
    piece = "array<struct<weekday:int,start_sec:int,end_sec:int>>"
    same = F.array(F.struct(F.col("day").alias("weekday"), F.col("s").alias("start_sec"), F.col("e").alias("end_sec")))
    night = F.array(
        F.struct(F.col("day").alias("weekday"), F.col("s").alias("start_sec"), F.lit(86400).alias("end_sec")),
        F.struct(((F.col("day") + 1) % 7).alias("weekday"), F.lit(0).alias("start_sec"), F.col("e").alias("end_sec")),
    )
    pieces = F.when(F.col("s") <= F.col("e"), same.cast(piece)).otherwise(night.cast(piece))
    return rows.select("window_id", F.explode(pieces).alias("p")).select("window_id", "p.*").where(
        F.col("start_sec") < F.col("end_sec")
    )


def work_allowed(events: DataFrame, windows: DataFrame, enabled: bool = True, ts: str = "ts") -> DataFrame:
    """Events with `open` under a whole schedule: switched off or without windows, all is open."""
    if not enabled:
        return events.withColumn("open", F.lit(True))
    judged = in_work_window(events, split_windows(windows), ts)
    some = windows.agg(F.count(F.lit(1)).alias("n")).scalar() > 0
    return judged.withColumn("open", F.col("open") | ~some)


def in_work_window(events: DataFrame, ranges: DataFrame, ts: str = "ts") -> DataFrame:
    """Events with `open`: does their clock time fall in any window?

    The ranges of a weekday are gathered into one row, so an event meets at most one row.
    """
    by_day = ranges.groupBy("weekday").agg(
        F.collect_list(F.struct("start_sec", "end_sec")).alias("__ranges")
    )
    t = F.col(ts)
    clock = F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    inside = F.exists("__ranges", lambda r: (r["start_sec"] <= clock) & (clock < r["end_sec"]))
    return (
        events.withColumn("weekday", F.weekday(t))
        .join(by_day, "weekday", "left")
        .withColumn("open", F.coalesce(inside, F.lit(False)))
        .drop("__ranges", "weekday")
    )

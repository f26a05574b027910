"""Skip rules, conversion plan, quality ladder, savings and run limits as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediacat.functions import constants as K
from mediacat.functions import paths


def _filled(c: Column) -> Column:
    """Numeric setting that is switched on: neither NULL nor zero."""
    return F.coalesce(c, F.lit(0)) != 0


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def _plain(c: Column) -> Column:
    """A number as text without a trailing '.0'."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def _bare_extension(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"^\.+", "")


def tidy_filters(filters: Column) -> Column:
    """Skip rules with their texts in the form `skip_reason` compares.

    Apply it to the library table, before the settings meet the files.
    """
    out = filters
    for name in ("only_extensions", "skip_extensions"):
        out = out.withField(name, F.transform(_list(filters[name]), _bare_extension))
    codecs = F.transform(_list(filters["skip_video_codecs"]), F.lower)
    out = out.withField("skip_video_codecs", codecs)
    for name in ("only_name_contains", "skip_name_contains"):
        out = out.withField(name, _list(filters[name]))
    return out


def skip_reason(
    path: Column,
    size: Column,
    filters: Column,
    duration_s: Column | None = None,
    video_bitrate: Column | None = None,
    video_codec: Column | None = None,
) -> Column:
    """First skip rule a file breaks, as struct(code, reason); NULL means process it.

    Leave the probe columns out to test only what the listing already tells. `filters` is a
    struct made by `tidy_filters`.
    """
    name = F.lower(paths.file_name(path))
    ext = F.lower(paths.suffix(paths.file_name(path)))
    only_ext, skip_ext = filters["only_extensions"], filters["skip_extensions"]
    only_name, skip_name = filters["only_name_contains"], filters["skip_name_contains"]
    hit_names = F.filter(skip_name, lambda t: name.contains(F.lower(t)))
    mib = F.coalesce(size, F.lit(0)) / K.MIB

    def limit(value: Column, bound: Column, low: bool) -> Column:
        outside = value < bound if low else value > bound
        return _filled(bound) & outside

    tests = [
        (
            "only_extensions",
            (F.size(only_ext) > 0) & ~F.array_contains(only_ext, ext),
            F.concat(F.lit("not one of "), F.array_join(only_ext, ", ")),
        ),
        (
            "skip_extensions",
            F.array_contains(skip_ext, ext),
            F.concat(F.lit("extension left out: "), ext),
        ),
        (
            "only_name_contains",
            (F.size(only_name) > 0) & ~F.exists(only_name, lambda t: name.contains(F.lower(t))),
            F.lit("name has none of the required texts"),
        ),
        (
            "skip_name_contains",
            F.exists(skip_name, lambda t: name.contains(F.lower(t))),
            F.concat(F.lit("name has the text: "), F.try_element_at(hit_names, F.lit(1))),
        ),
        (
            "min_size_mb",
            limit(mib, filters["min_size_mb"], True),
            F.concat(F.lit("under the least size, MB: "), _plain(filters["min_size_mb"])),
        ),
        (
            "max_size_mb",
            limit(mib, filters["max_size_mb"], False),
            F.concat(F.lit("over the greatest size, MB: "), _plain(filters["max_size_mb"])),
        ),
    ]
    if duration_s is not None:
        minutes = F.coalesce(duration_s, F.lit(0)) / 60
        tests += [
            (
                "min_minutes",
                (minutes != 0) & limit(minutes, filters["min_minutes"], True),
                F.concat(F.lit("under the least minutes: "), _plain(filters["min_minutes"])),
            ),
            (
                "max_minutes",
                (minutes != 0) & limit(minutes, filters["max_minutes"], False),
                F.concat(F.lit("over the greatest minutes: "), _plain(filters["max_minutes"])),
            ),
        ]
    if video_bitrate is not None:
        kbps = F.coalesce(video_bitrate, F.lit(0)) / 1000
        shown = F.bround(kbps, 0).cast("bigint").cast("string")
        tests += [
            (
                "min_bitrate_kbps",
                (kbps != 0) & limit(kbps, filters["min_bitrate_kbps"], True),
                F.concat(F.lit("rate low enough, kbps: "), shown),
            ),
            (
                "max_bitrate_kbps",
                (kbps != 0) & limit(kbps, filters["max_bitrate_kbps"], False),
                F.concat(
                    F.lit("rate over the greatest, kbps: "), _plain(filters["max_bitrate_kbps"])
                ),
            ),
        ]
    if video_codec is not None:
        codecs = filters["skip_video_codecs"]
        tests.append(
            (
                "skip_video_codecs",
                (F.coalesce(video_codec, F.lit("")) != "")
                & F.array_contains(codecs, F.lower(video_codec)),
                F.concat(F.lit("video codec left out, whatever the audio: "), video_codec),
            )
        )

    chain = None
    for code, broken, text in tests:
        verdict = F.struct(F.lit(code).alias("code"), text.alias("reason"))
        hit = F.coalesce(broken, F.lit(False))
        chain = F.when(hit, verdict) if chain is None else chain.when(hit, verdict)
    return chain


def tier(height: Column) -> Column:
    """Resolution tier; an unknown height is sd."""
    known = F.coalesce(height, F.lit(0))
    chain = None
    for name, start, _ in K.TIERS[:-1]:
        chain = F.when(known >= start, name) if chain is None else chain.when(known >= start, name)
    return chain.otherwise(K.TIERS[-1][0])


def tier_ceiling(height: Column, ceiling: Column) -> Column:
    """kbps ceiling of a file's tier, from settings or the defaults."""
    at = tier(height)
    chain = None
    for name, _, default in K.TIERS:
        own = ceiling[name]
        value = F.when(_filled(own), own.cast("double")).otherwise(F.lit(float(default)))
        chain = F.when(at == name, value) if chain is None else chain.when(at == name, value)
    return chain


def video_is_efficient(video_bitrate: Column, height: Column, ceiling: Column) -> Column:
    """True when the ceiling is off, the bitrate unknown, or the bitrate within the ceiling."""
    kbps = F.coalesce(video_bitrate, F.lit(0)) / 1000
    enabled = F.coalesce(ceiling["enabled"], F.lit(False))
    return ~enabled | (kbps == 0) | (kbps <= tier_ceiling(height, ceiling))


def estimated_video_bitrate(stream_rate: Column, total_rate: Column, n_audio: Column) -> Column:
    """Rate of the stream itself, else the total less an allowance per audio track."""
    own = F.coalesce(stream_rate, F.lit(0))
    total = F.coalesce(total_rate, F.lit(0))
    guess = F.greatest(F.lit(0), total - K.AUDIO_ALLOWANCE_BPS * F.greatest(F.lit(1), n_audio))
    return F.when(own != 0, own).when(total != 0, guess).otherwise(F.lit(0)).cast("bigint")


def bit_depth(bits_per_raw_sample: Column, pix_fmt: Column) -> Column:
    fmt = F.coalesce(pix_fmt, F.lit(""))
    stated = F.trim(bits_per_raw_sample).try_cast("int")
    guess = F.when(fmt.contains("12"), 12).when(fmt.contains("10"), 10).otherwise(8)
    return F.coalesce(stated, guess)


def is_hi10p(video_codec: Column, depth: Column) -> Column:
    """10-bit H.264, which no consumer hardware decodes."""
    return F.coalesce((video_codec == "h264") & (depth > 8), F.lit(False))


def conversion_plan(
    path: Column,
    video_codec: Column,
    audio_codecs: Column,
    efficient: Column,
    want_video: Column,
    want_audio: Column,
    want_container: Column,
) -> Column:
    """struct(action, codec, audio, why): the least work that satisfies the library."""
    have_audio = _list(audio_codecs)
    video_ok = F.coalesce(
        (want_video == "copy") | ((video_codec == want_video) & efficient), F.lit(False)
    )
    audio_ok = (want_audio == "copy") | (
        (F.size(have_audio) > 0) & F.forall(have_audio, lambda c: c == want_audio)
    )
    audio_ok = F.coalesce(audio_ok, F.lit(False))
    container_ok = F.lower(paths.suffix(paths.file_name(path))) == F.lower(want_container)

    heard = F.array_join(F.array_sort(F.array_distinct(have_audio)), "/")
    heard = F.when(heard == "", F.lit("?")).otherwise(heard)
    action = (
        F.when(video_ok & audio_ok & container_ok, "skip")
        .when(video_ok & audio_ok, "remux")
        .when(video_ok, "audio_only")
        .when(audio_ok, "video_only")
        .otherwise("full")
    )
    why = (
        F.when(video_ok & audio_ok & container_ok, F.lit("nothing to change"))
        .when(video_ok & audio_ok, F.concat(F.lit("new container: "), F.upper(want_container)))
        .when(
            video_ok,
            F.concat(
                F.lit("video stays "),
                F.coalesce(video_codec, F.lit("None")),
                F.lit(", audio from "),
                heard,
                F.lit(" to "),
                F.upper(want_audio),
            ),
        )
        .when(
            audio_ok,
            F.concat(
                F.lit("audio stays "),
                F.upper(want_audio),
                F.lit(", video to "),
                F.upper(want_video),
            ),
        )
        .otherwise(
            F.concat(F.lit("video to "), F.upper(want_video), F.lit(", audio to "), F.upper(want_audio))
        )
    )
    return F.struct(
        action.alias("action"),
        F.when(video_ok, "copy").otherwise(want_video).alias("codec"),
        F.when(audio_ok, "copy").otherwise(want_audio).alias("audio"),
        why.alias("why"),
    )


def base_quality(quality_level: Column, crf_override: Column) -> Column:
    level = reduce(
        lambda chain, kv: chain.when(quality_level == kv[0], kv[1]),
        list(K.QUALITY_LEVELS.items())[1:],
        F.when(quality_level == "archive", K.QUALITY_LEVELS["archive"]),
    ).otherwise(K.DEFAULT_QUALITY)
    return F.when(_filled(crf_override), crf_override.cast("int")).otherwise(level)


def retry_ladder(base: Column, auto_retry: Column, steps: Column, custom: Column) -> Column:
    """Sorted distinct qualities to try when a file comes out too big; empty when switched off."""
    default = F.array(*[F.lit(s) for s in K.DEFAULT_RETRY_STEPS])
    chosen = F.when(F.size(_list(steps)) > 0, steps).otherwise(default)
    rungs = [
        F.when(
            F.array_contains(chosen, step), F.least(F.lit(K.LADDER_CEILING), base + offset)
        ).cast("int")
        for step, offset in K.RETRY_OFFSETS.items()
    ]
    low, high = K.CUSTOM_QUALITY_RANGE
    own = F.when(
        F.array_contains(chosen, "custom") & _filled(custom),
        F.greatest(F.lit(low), F.least(F.lit(high), custom.cast("int"))),
    ).cast("int")
    ladder = F.array_sort(F.array_distinct(F.array_compact(F.array(*rungs, own))))
    empty = F.array().cast("array<int>")
    return F.when(F.coalesce(auto_retry, F.lit(False)), ladder).otherwise(empty)


def manual_steps(base: Column) -> Column:
    """The four qualities offered by hand; the last is the person's own choice (NULL)."""
    rows = [
        F.struct(F.lit(step).alias("step"), F.least(F.lit(K.LADDER_CEILING), base + off).alias("quality"))
        for step, off in K.RETRY_OFFSETS.items()
    ]
    own = F.struct(F.lit("custom").alias("step"), F.lit(None).cast("int").alias("quality"))
    return F.array(*rows, own)


def next_rung(ladder: Column, quality: Column) -> Column:
    current = F.when(_filled(quality), quality).otherwise(F.lit(K.DEFAULT_QUALITY))
    return F.try_element_at(F.filter(ladder, lambda q: q > current), F.lit(1))


def savings_verdict(before: Column, after: Column, min_percent: Column) -> Column:
    """struct(ok, code, percent, reason): was a conversion worth keeping?"""
    known = _filled(before) & _filled(after)
    percent = F.when(known, F.try_divide((before - after).cast("double"), before) * 100).otherwise(0.0)
    wanted = F.coalesce(min_percent, F.lit(0)).cast("double")
    grew = known & (after >= before)
    short = known & ~grew & (wanted != 0) & (percent < wanted)
    whole = F.bround(F.abs(percent), 0).cast("bigint").cast("string")
    return F.struct(
        (~grew & ~short).alias("ok"),
        F.when(~known, "unknown")
        .when(grew, "larger")
        .when(short, "below_minimum")
        .otherwise("worth_it")
        .alias("code"),
        percent.alias("percent"),
        F.when(grew, F.concat(F.lit("grew by "), whole, F.lit(" percent")))
        .when(
            short,
            F.concat(
                F.lit("saves "),
                F.bround(percent, 0).cast("bigint").cast("string"),
                F.lit(" percent, wanted "),
                F.bround(wanted, 0).cast("bigint").cast("string"),
            ),
        )
        .alias("reason"),
    )


def projected_ratio(size_now: Column, progress: Column, size_before: Column) -> Column:
    """Final size over source size, guessed from the bytes written so far."""
    return F.try_divide(F.try_divide(size_now.cast("double"), progress / 100), size_before)


def limit_seconds(enabled: Column, amount: Column, unit: Column) -> Column:
    """Run limit in seconds; NULL when it is off."""
    size = F.lit(K.UNIT_SECONDS["hours"])
    factor = F.coalesce(
        reduce(
            lambda chain, kv: chain.when(unit == kv[0], kv[1]),
            list(K.UNIT_SECONDS.items())[1:],
            F.when(unit == "minutes", K.UNIT_SECONDS["minutes"]),
        ),
        size,
    )
    return F.when(F.coalesce(enabled, F.lit(False)) & (amount > 0), amount * factor)


def stall_seconds(enabled: Column, stall_enabled: Column, stall_minutes: Column) -> Column:
    on = F.coalesce(enabled, F.lit(False)) & F.coalesce(stall_enabled, F.lit(True))
    return F.when(on & (stall_minutes > 0), stall_minutes * 60)


def human_duration(seconds: Column) -> Column:
    """'45 minutes', '1.5 hours', '2 days'; NULL reads 'no limit'."""
    value = (
        F.when(seconds < 3600, seconds / 60)
        .when(seconds < 86400, seconds / 3600)
        .otherwise(seconds / 86400)
    )
    unit = F.when(seconds < 3600, "minute").when(seconds < 86400, "hour").otherwise("day")
    shown = F.bround(value, 1)
    text = F.concat(
        _plain(shown), F.lit(" "), unit, F.when(shown == 1, F.lit("")).otherwise(F.lit("s"))
    )
    return F.when(seconds.isNull(), F.lit("no limit")).otherwise(text)


def human_size(n: Column) -> Column:
    big = F.format_string("%.2f GB", n / 1e9)
    small = F.format_string("%d MB", F.bround(n / 1e6, 0).cast("bigint"))
    return F.when(~_filled(n), F.lit("unknown")).when(n >= 1e9, big).otherwise(small)


def overrun_verdict(
    state: Column,
    started_s: Column,
    progress_s: Column,
    now_s: Column,
    limit_s: Column,
    stall_s: Column,
) -> Column:
    """struct(code, reason) for work that should be given up on, NULL otherwise."""
    ran = now_s - started_s
    idle = now_s - F.coalesce(F.when(_filled(progress_s), progress_s), started_s)
    over = state.isin("leased", "running") & _filled(limit_s) & _filled(started_s) & (ran > limit_s)
    stuck = (state == "running") & _filled(stall_s) & _filled(
        F.coalesce(F.when(_filled(progress_s), progress_s), started_s)
    ) & (idle > stall_s)
    over_text = F.concat(
        F.lit("Over its time limit: ran "),
        human_duration(ran),
        F.lit(", allowed "),
        human_duration(limit_s),
    )
    stuck_text = F.concat(
        F.lit("Stands still: no progress in "), human_duration(idle)
    )
    return F.when(
        F.coalesce(over, F.lit(False)),
        F.struct(F.lit("overrun").alias("code"), over_text.alias("reason")),
    ).when(
        F.coalesce(stuck, F.lit(False)),
        F.struct(F.lit("stalled").alias("code"), stuck_text.alias("reason")),
    )

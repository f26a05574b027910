"""Settings that are blank or will not work together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacat.functions import constants as K
from mediacat.functions import rules


def repair(profiles: DataFrame) -> DataFrame:
    """Blank required settings replaced by their fallbacks; `repaired` marks the rows changed."""
    present = [c for c in K.PROFILE_FALLBACKS if c in profiles.columns]

    def blank(name: str) -> Column:
        return F.trim(F.coalesce(F.col(name), F.lit(""))) == ""

    changed = F.lit(False)
    for name in present:
        changed = changed | blank(name)
    return profiles.withColumn("repaired", changed).withColumns(
        {n: F.when(blank(n), F.lit(K.PROFILE_FALLBACKS[n])).otherwise(F.col(n)) for n in present}
    )


def broken_rules(profile) -> Column:
    """Codes of the settings that clash. `profile` maps a field name to a column."""

    def eq(field: str, value: str) -> Column:
        return F.coalesce(profile(field) == value, F.lit(False))

    def on(field: str) -> Column:
        return F.coalesce(profile(field), F.lit(False))

    checks = {
        "mp4_opus": eq("container", "mp4") & eq("audio_codec", "opus"),
        "mp4_flac": eq("container", "mp4") & eq("audio_codec", "flac"),
        "mp4_picture_subtitles": eq("container", "mp4") & eq("subtitle_mode", "keep"),
        "quality_without_encode": eq("video_codec", "copy")
        & (F.coalesce(profile("quality_level"), F.lit("")) != ""),
        "av1_slow": eq("video_codec", "av1"),
        "sdr_on_processor": eq("hdr_mode", "sdr"),
        "ten_bit_h264": eq("bit_depth", "10") & eq("video_codec", "h264"),
        "no_preferred_language": eq("audio_language_mode", "preferred_only")
        & (F.coalesce(F.size(profile("audio_languages_list")), F.lit(0)) <= 0),
        "loudness_without_encode": on("normalise_loudness") & eq("audio_codec", "copy"),
        "stereo_downmix": eq("downmix", "stereo"),
        "forced_subtitles_lost": eq("subtitle_mode", "strip") & ~on("keep_forced_subs"),
    }
    return F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in checks.items()]))


def rule_counts(profiles: DataFrame) -> DataFrame:
    """How many settings break each rule."""
    return (
        profiles.select(F.explode(broken_rules(F.col)).alias("rule"))
        .groupBy("rule")
        .agg(F.count(F.lit(1)).alias("jobs"))
    )


def resolve_profile(p) -> Column:
    """Settings as chosen in a library expanded to a full job spec; empty counts as absent.

    `p` maps a field name to a column.
    """

    def text(field: str, fallback: str) -> Column:
        return F.coalesce(F.when(p(field) != "", p(field)), F.lit(fallback))

    def flag(field: str, fallback: bool) -> Column:
        return F.coalesce(p(field), F.lit(fallback))

    languages = F.coalesce(p("audio_languages_list"), F.array().cast("array<string>"))
    return F.struct(
        text("video_codec", "hevc").alias("codec"),
        flag("remove_images", True).alias("remove_images"),
        F.coalesce(p("hdr_mode"), F.lit("preserve")).alias("hdr_mode"),
        F.coalesce(p("bit_depth"), F.lit("match")).alias("bit_depth"),
        flag("tag_colours", True).alias("tag_colours"),
        F.when(F.size(languages) > 0, languages).otherwise(F.array(F.lit("eng"))).alias("audio_languages"),
        F.coalesce(p("audio_language_mode") == "preferred_only", F.lit(False)).alias("remove_other_audio"),
        flag("keep_forced_subs", True).alias("keep_forced_subs"),
        flag("keep_chapters", True).alias("keep_chapters"),
        flag("tidy_track_names", True).alias("tidy_track_names"),
        F.coalesce(p("min_saving_percent"), F.lit(0)).cast("double").alias("min_saving_percent"),
        flag("salvage_when_stuck", True).alias("salvage_when_stuck"),
        flag("clean_metadata", False).alias("clean_metadata"),
        p("downmix").alias("downmix"),
        flag("normalise_loudness", False).alias("normalise_loudness"),
        flag("default_first_subtitle", False).alias("default_first_subtitle"),
        rules.base_quality(p("quality_level"), p("crf_override")).alias("quality"),
        text("container", "mkv").alias("container"),
        text("audio_codec", "aac").alias("audio"),
        text("audio_bitrate", "160k").alias("audio_bitrate"),
        text("subtitle_mode", "keep").alias("subtitle_mode"),
        F.coalesce(p("subtitle_languages"), F.array().cast("array<string>")).alias("subtitle_languages"),
    )

"""Which streams of a file are kept, in what order, and under what names.

Streams arrive as flat rows (file_id, idx, codec_type, codec_name, language, title, channels and
disposition flags). `spec` is a struct column with audio_languages, remove_other_audio,
subtitle_mode, subtitle_languages, keep_forced_subs, container, remove_images,
default_first_subtitle, so that every row can carry its own library's settings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediacat.functions import constants as K
from mediacat.functions import tracks as T


def _position(wanted: Column, code: Column) -> Column:
    """0-based place of a language in a list; the list's length when it is not there."""
    at = F.array_position(wanted, code)
    return F.when(at > 0, at - 1).otherwise(F.size(wanted).cast("bigint"))


def _lowered(c: Column) -> Column:
    return F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower)


def classify(streams: DataFrame) -> DataFrame:
    """All streams with `kept` and `drop_reason`."""
    s = F.col("spec")
    kind, name = F.col("codec_type"), F.col("codec_name")
    pic = F.col("attached_pic") if "attached_pic" in streams.columns else None
    image = T.is_image(kind, name, pic)
    code = T.lang(F.col("language"))
    prefs, sub_langs = _lowered(s["audio_languages"]), _lowered(s["subtitle_languages"])
    forced = T.looks_forced(F.col("title"), F.col("forced"))
    keep_forced = F.coalesce(s["keep_forced_subs"], F.lit(True))
    whole = W.partitionBy("file_id")

    df = streams.withColumns(
        {
            "__image": image,
            "__wanted": (kind == "audio") & (F.array_contains(prefs, code) | (code == "und")),
            "__code": code,
            "__forced": forced,
            "__prefs": prefs,
            "__subs": sub_langs,
        }
    ).withColumns(
        {
            "__main": F.min(F.when((kind == "video") & ~F.col("__image"), F.col("idx"))).over(whole),
            "__any_wanted": F.max("__wanted").over(whole),
        }
    )

    mode = F.coalesce(s["subtitle_mode"], F.lit("keep"))
    by_mode = (
        F.when(mode == "strip", keep_forced & F.col("__forced"))
        .when(mode == "forced", F.col("__forced"))
        .when(
            mode == "languages",
            F.array_contains(F.col("__subs"), F.col("__code")) | (keep_forced & F.col("__forced")),
        )
        .otherwise(F.lit(True))
    )
    remove_images = F.coalesce(s["remove_images"], F.lit(True))
    other = (F.size("__prefs") > 0) & ~F.col("__wanted")
    reason = (
        F.when((kind == "video") & F.col("__image") & remove_images, "image")
        .when((kind == "video") & ~F.col("__image") & (F.col("idx") != F.col("__main")), "extra_video")
        .when(
            (kind == "audio")
            & other
            & F.coalesce(s["remove_other_audio"], F.lit(False))
            & F.col("__any_wanted"),
            "other_language",
        )
        .when((kind == "subtitle") & ~by_mode, "subtitle_mode")
        .when((kind == "subtitle") & F.coalesce(name.isin(K.CAPTION_SUBTITLES), F.lit(False)), "caption")
        .when(
            (kind == "subtitle")
            & F.coalesce(name.isin(K.IMAGE_SUBTITLES), F.lit(False))
            & (s["container"] == "mp4"),
            "picture_subtitle",
        )
        .when(~F.coalesce(kind.isin("video", "audio", "subtitle"), F.lit(False)), "not_mapped")
    )
    df = df.withColumn("drop_reason", reason)
    return df.withColumn("kept", F.col("drop_reason").isNull())


def _order_key() -> Column:
    """Sort key inside (file, kind): video, preferred audio, and forced subtitles come first."""
    commentary = F.lower(F.coalesce(F.col("title"), F.lit(""))).contains("commentary")
    zero = F.lit(0).cast("bigint")
    prefers = F.size("__prefs") > 0
    audio = F.when(
        prefers & F.col("__wanted"),
        F.struct(
            zero.alias("a"),
            _position(F.col("__prefs"), F.col("__code")).alias("b"),
            commentary.cast("bigint").alias("c"),
            (-F.coalesce(F.col("channels"), F.lit(0))).cast("bigint").alias("d"),
        ),
    ).otherwise(
        F.struct(
            F.when(prefers, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("a"),
            zero.alias("b"), zero.alias("c"), zero.alias("d"),
        )
    )
    subtitle = F.struct(
        F.when(F.col("__forced"), F.lit(0)).otherwise(F.lit(1)).cast("bigint").alias("a"),
        _position(F.col("__subs"), F.col("__code")).alias("b"),
        zero.alias("c"), zero.alias("d"),
    )
    video = F.struct(
        F.col("__image").cast("bigint").alias("a"), zero.alias("b"), zero.alias("c"), zero.alias("d")
    )
    kind = F.col("codec_type")
    return F.when(kind == "audio", audio).when(kind == "subtitle", subtitle).otherwise(video)


def track_plan(streams: DataFrame) -> DataFrame:
    """Every stream with `kept`, `drop_reason`, its output `position` within its kind, and flags.

    Dropped streams have no position. The first audio track is the default; the first subtitle
    only where the settings ask for it.
    """
    df = classify(streams)
    order = W.partitionBy("file_id", "codec_type", "kept").orderBy(_order_key(), "idx")
    at = F.when(F.col("kept"), F.row_number().over(order) - 1)
    df = df.withColumn("position", at.cast("bigint"))
    first = F.col("position") == 0
    default_sub = F.coalesce(F.col("spec.default_first_subtitle"), F.lit(False))
    return df.withColumns(
        {
            "is_default": F.coalesce(
                first
                & ((F.col("codec_type") == "audio") | ((F.col("codec_type") == "subtitle") & default_sub)),
                F.lit(False),
            ),
            "is_forced": F.col("kept") & (F.col("codec_type") == "subtitle") & F.col("__forced"),
        }
    )


PUBLIC = ["file_id", "idx", "codec_type", "kept", "drop_reason", "position", "is_default", "is_forced"]


def track_notes(plan: DataFrame) -> DataFrame:
    """Per file: what was dropped, as counts and as the sorted list of dropped audio languages."""

    def dropped(reason: str) -> Column:
        return F.count_if(F.coalesce(F.col("drop_reason") == reason, F.lit(False)))

    other = F.when(F.col("drop_reason") == "other_language", F.col("__code"))
    asked = F.max(F.size("__prefs") > 0)
    silent = F.count_if(F.col("codec_type") == "audio") == 0
    return plan.groupBy("file_id").agg(
        dropped("image").alias("images"),
        F.array_join(F.array_sort(F.collect_set(other)), ", ").alias("dropped_audio"),
        dropped("caption").alias("captions"),
        dropped("picture_subtitle").alias("picture_subtitles"),
        F.count_if(F.col("is_forced") & (F.col("spec.subtitle_mode") == "strip")).alias("forced_kept"),
        (asked & silent).alias("kept_all_audio"),
    )


def track_titles(streams: DataFrame) -> DataFrame:
    """New title and language code of each audio and subtitle track; NULL where nothing is known."""

    def col(name: str) -> Column | None:
        return F.col(name) if name in streams.columns else None

    told = T.track_title(
        F.col("codec_type"), F.col("language"), F.col("title"), F.col("channels"),
        col("channel_layout"), col("comment"), col("descriptions"), col("forced"),
        col("hearing_impaired"),
    )
    return (
        streams.where(F.col("codec_type").isin("audio", "subtitle"))
        .withColumn("__t", told)
        .select("file_id", "idx", F.col("__t.title").alias("new_title"), F.col("__t.language").alias("code"))
    )


def primary_video(streams: DataFrame) -> DataFrame:
    """First video stream of each file that is not cover art."""
    pic = F.col("attached_pic") if "attached_pic" in streams.columns else None
    real = (F.col("codec_type") == "video") & ~T.is_image(F.col("codec_type"), F.col("codec_name"), pic)
    rest = [c for c in streams.columns if c not in ("file_id", "idx")]
    return (
        streams.where(real)
        .groupBy("file_id")
        .agg(F.min(F.struct("idx", *rest)).alias("v"))
        .select("file_id", "v.*")
    )

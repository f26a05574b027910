"""Explicit schemas of the catalogue's tables; nothing is inferred."""

from pyspark.sql import types as T

DISPOSITION = T.MapType(T.StringType(), T.IntegerType())
STREAM = T.StructType(
    [
        T.StructField("index", T.IntegerType()),
        T.StructField("codec_type", T.StringType()),
        T.StructField("codec_name", T.StringType()),
        T.StructField("bit_rate", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("channels", T.IntegerType()),
        T.StructField("channel_layout", T.StringType()),
        T.StructField("pix_fmt", T.StringType()),
        T.StructField("bits_per_raw_sample", T.StringType()),
        T.StructField("color_transfer", T.StringType()),
        T.StructField("color_primaries", T.StringType()),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
        T.StructField("disposition", DISPOSITION),
    ]
)
PROBE = T.StructType(
    [
        T.StructField(
            "format",
            T.StructType(
                [
                    T.StructField("size", T.StringType()),
                    T.StructField("duration", T.StringType()),
                    T.StructField("bit_rate", T.StringType()),
                ]
            ),
        ),
        T.StructField("streams", T.ArrayType(STREAM)),
    ]
)
FILTERS = T.StructType(
    [
        T.StructField("skip_extensions", T.ArrayType(T.StringType())),
        T.StructField("only_extensions", T.ArrayType(T.StringType())),
        T.StructField("min_size_mb", T.DoubleType()),
        T.StructField("max_size_mb", T.DoubleType()),
        T.StructField("min_minutes", T.DoubleType()),
        T.StructField("max_minutes", T.DoubleType()),
        T.StructField("skip_name_contains", T.ArrayType(T.StringType())),
        T.StructField("only_name_contains", T.ArrayType(T.StringType())),
        T.StructField("skip_video_codecs", T.ArrayType(T.StringType())),
        T.StructField(
            "bitrate_ceiling",
            T.StructType(
                [T.StructField("enabled", T.BooleanType())]
                + [T.StructField(t, T.DoubleType()) for t in ("sd", "hd", "fullhd", "uhd")]
            ),
        ),
        T.StructField("min_bitrate_kbps", T.DoubleType()),
        T.StructField("max_bitrate_kbps", T.DoubleType()),
    ]
)
NAMING = T.StructType(
    [
        T.StructField("enabled", T.BooleanType()),
        T.StructField("scheme", T.StringType()),
        T.StructField("skip_uncertain", T.BooleanType()),
        T.StructField("folders", T.BooleanType()),
    ]
)
MOUNTS = T.ArrayType(
    T.StructType([T.StructField("server", T.StringType()), T.StructField("local", T.StringType())])
)
PROFILE = T.StructType(
    [
        T.StructField("video_codec", T.StringType()),
        T.StructField("audio_codec", T.StringType()),
        T.StructField("container", T.StringType()),
        T.StructField("audio_bitrate", T.StringType()),
        T.StructField("quality_level", T.StringType()),
        T.StructField("crf_override", T.IntegerType()),
        T.StructField("subtitle_mode", T.StringType()),
        T.StructField("subtitle_languages", T.ArrayType(T.StringType())),
        T.StructField("audio_language_mode", T.StringType()),
        T.StructField("audio_languages_list", T.ArrayType(T.StringType())),
        T.StructField("remove_images", T.BooleanType()),
        T.StructField("hdr_mode", T.StringType()),
        T.StructField("bit_depth", T.StringType()),
        T.StructField("tag_colours", T.BooleanType()),
        T.StructField("keep_forced_subs", T.BooleanType()),
        T.StructField("keep_chapters", T.BooleanType()),
        T.StructField("tidy_track_names", T.BooleanType()),
        T.StructField("min_saving_percent", T.DoubleType()),
        T.StructField("salvage_when_stuck", T.BooleanType()),
        T.StructField("clean_metadata", T.BooleanType()),
        T.StructField("downmix", T.StringType()),
        T.StructField("normalise_loudness", T.BooleanType()),
        T.StructField("default_first_subtitle", T.BooleanType()),
        T.StructField("auto_retry", T.BooleanType()),
        T.StructField("auto_retry_steps", T.ArrayType(T.StringType())),
        T.StructField("auto_retry_custom", T.IntegerType()),
    ]
)
STRINGS = T.ArrayType(T.StringType())
NUMBERS = T.MapType(T.StringType(), T.DoubleType())
TEXTS = T.MapType(T.StringType(), T.StringType())

# JSON text columns that are decoded on reading.
JSON_COLUMNS = {
    "encoders": STRINGS,
    "mounts": MOUNTS,
    "profile": PROFILE,
    "filters": FILTERS,
    "naming": NAMING,
    "recipes": TEXTS,
    "benchmarks": NUMBERS,
    "benchmarks_10bit": NUMBERS,
}
EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("job_id", T.LongType()),
        T.StructField("node_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("kind", T.StringType()),
        T.StructField("progress", T.DoubleType()),
        T.StructField("size_now", T.LongType()),
    ]
)

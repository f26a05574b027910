"""Readers: folder listings, probe documents, log text and state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat import schemas
from mediacat.functions import logs, rules
from mediacat.functions import tracks as T
from mediacat.operators.scan import media_only


def media_listing(spark: SparkSession, watch_path: str) -> DataFrame:
    """Video files below a folder: path, size, mtime_s. File contents are never read.

    Spark's file listing leaves out names that begin with '_' as well as '.'. Where such names
    matter, bring an inventory table instead and pass it through `media_only`.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(watch_path)
        .select(
            F.regexp_replace("path", "^file:/*", "/").alias("path"),
            F.col("length").alias("size"),
            F.unix_timestamp("modificationTime").alias("mtime_s"),
        )
    )
    return media_only(files)


def watched_folder(spark: SparkSession, watch_path: str, max_files: int = 1000) -> DataFrame:
    """A folder watched as a stream; start it with a processing-time trigger of the scan interval."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", max_files)
        .load(watch_path)
        .select(
            F.regexp_replace("path", "^file:/*", "/").alias("path"),
            F.col("length").alias("size"),
            F.col("modificationTime").alias("mtime"),
        )
    )
    return media_only(files)


def name_samples(listing: DataFrame, limit: int = 6) -> DataFrame:
    """A few real file names of a library, for a preview."""
    return listing.select(F.substring_index("path", "/", -1).alias("name")).limit(limit)


def json_column(text: Column, kind) -> Column:
    """Decoded JSON text; NULL or unreadable text gives the empty value of its kind."""
    simple = kind.simpleString()
    if simple.startswith("array"):
        empty = F.from_json(F.lit("[]"), kind)
    else:
        empty = F.from_json(F.lit("{}"), kind)
    return F.coalesce(F.from_json(text, kind), empty)


def decode_table(table: DataFrame) -> DataFrame:
    """A state table with its JSON text columns decoded."""
    return table.withColumns(
        {
            name: json_column(F.col(name), kind)
            for name, kind in schemas.JSON_COLUMNS.items()
            if name in table.columns and dict(table.dtypes)[name] == "string"
        }
    )


def state_table(spark: SparkSession, path: str, order: str | None = None) -> DataFrame:
    table = decode_table(spark.read.parquet(path))
    return table if order is None else table.orderBy(order)


def probe_documents(docs: DataFrame) -> DataFrame:
    """Probe output (path, document JSON) with the document parsed; unreadable ones stay NULL."""
    parsed = F.from_json("document", schemas.PROBE)
    # Unreadable text parses to a struct of NULLs, as an empty document does; only then look twice.
    filled = parsed["format"].isNotNull() | parsed["streams"].isNotNull()
    return docs.withColumn("probe", F.when(filled | F.try_parse_json("document").isNotNull(), parsed))


def probe_summary(probed: DataFrame) -> DataFrame:
    """One row per file in the shape the rules read. The main picture is never cover art."""
    streams = F.coalesce(F.col("probe.streams"), F.array().cast(schemas.PROBE["streams"].dataType))
    real = F.filter(
        streams,
        lambda s: (s["codec_type"] == "video")
        & ~T.is_image(s["codec_type"], s["codec_name"], F.try_element_at(s["disposition"], F.lit("attached_pic"))),
    )
    fmt = F.col("probe.format")

    def number(c: Column, kind: str) -> Column:
        return F.coalesce(c.try_cast(kind), F.lit(0).cast(kind))

    rows = probed.withColumns(
        {
            "__v": F.try_element_at(real, F.lit(1)),
            "__a": F.transform(
                F.filter(streams, lambda s: s["codec_type"] == "audio"), lambda s: s["codec_name"]
            ),
        }
    )
    v, total = F.col("__v"), number(fmt["bit_rate"], "bigint")
    known = F.col("probe").isNotNull()
    return rows.select(
        "path",
        F.when(known, number(fmt["size"], "bigint")).alias("size"),
        F.when(known, number(fmt["duration"], "double")).alias("duration_s"),
        F.when(known, total).alias("bitrate"),
        F.when(
            known,
            rules.estimated_video_bitrate(number(v["bit_rate"], "bigint"), total, F.size("__a")),
        ).alias("video_bitrate"),
        v["codec_name"].alias("video_codec"),
        v["pix_fmt"].alias("pix_fmt"),
        F.when(known, rules.bit_depth(v["bits_per_raw_sample"], v["pix_fmt"])).alias("bit_depth"),
        v["width"].alias("width"),
        v["height"].alias("height"),
        F.when(known, F.col("__a")).alias("audio_codecs"),
    )


def probe_streams(probed: DataFrame) -> DataFrame:
    """One row per stream of each probed file."""

    def flag(name: str) -> Column:
        return F.coalesce(F.try_element_at(F.col("s.disposition"), F.lit(name)), F.lit(0)).alias(name)

    def tag(name: str) -> Column:
        return F.try_element_at(F.col("s.tags"), F.lit(name)).alias(name)

    return probed.select(F.col("path").alias("file_id"), F.explode("probe.streams").alias("s")).select(
        "file_id",
        F.col("s.index").alias("idx"),
        "s.codec_type", "s.codec_name", "s.channels", "s.channel_layout", "s.pix_fmt",
        "s.color_transfer", "s.color_primaries",
        tag("language"), tag("title"),
        *[flag(n) for n in ("forced", "comment", "attached_pic", "descriptions", "hearing_impaired")],
    )


def log_text(spark: SparkSession, path: str) -> DataFrame:
    """Encoder logs, one file per job named `<job_id>.log`: job_id, line.

    Lines of a text file have no number of their own in Spark; a table with line numbers is the
    input for ordered work.
    """
    return (
        spark.read.text(path)
        .select(
            F.regexp_extract(F.col("_metadata.file_name"), r"^([0-9]+)\.", 1).cast("bigint").alias("job_id"),
            logs.strip(F.col("value")).alias("line"),
        )
        .where(F.col("line") != "")
    )

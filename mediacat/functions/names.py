"""Release names: parsing, tidy titles and canonical paths.

`parse_names` adds columns step by step, so that each regular expression is evaluated once per
distinct name: Catalyst keeps projections apart where a costly expression is read more than once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacat.functions import paths
from mediacat.functions.constants import EDITIONS, JUNK_WORDS, SMALL_WORDS

_MARK = "\u0001"
_YEAR = r"(19[0-9]{2}|20[0-9]{2})"
# Text before the marker, season, episode, text after it; and a cheap sign that it may be there.
_EPISODE_FORMS = [
    (r"(?isuU)^(.*?)\bs([0-9]{1,2})[\s._-]*e([0-9]{1,3})\b(.*)$", r"[sSſ][0-9]"),
    (r"(?isuU)^(.*?)\b([0-9]{1,2})x([0-9]{1,3})\b(.*)$", r"[0-9][xX][0-9]"),
    (
        r"(?isuU)^(.*?)\bseason[\s._-]*([0-9]{1,2})[\s._-]*episode[\s._-]*([0-9]{1,3})\b(.*)$",
        r"(?i)season",
    ),
]


def _none_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def _before_first(words: Column, stops) -> Column:
    """Leading words up to the first one for which `stops` holds."""
    at = F.array_position(F.transform(words, stops), True)
    return F.when(at > 0, F.slice(words, F.lit(1), (at - 1).cast("int"))).otherwise(words)


def _capital(part: Column) -> Column:
    shouted = (F.upper(part) == part) & (F.lower(part) != part) & (F.length(part) <= 5)
    lifted = F.concat(F.upper(F.substring(part, 1, 1)), F.lower(F.substr(part, F.lit(2))))
    return F.when(shouted, part).otherwise(lifted)


def title_case(text: Column) -> Column:
    """Capitals per hyphenated part; short acronyms kept; small words lower except in front."""

    def word(w: Column, i: Column) -> Column:
        small = (i > 0) & F.lower(w).isin(SMALL_WORDS)
        parts = F.array_join(F.transform(F.split(w, "-"), _capital), "-")
        return F.when(small, F.lower(w)).otherwise(parts)

    return F.array_join(F.transform(_words(text), word), " ")


def normalise(text: Column) -> Column:
    """Lower case, no punctuation, single spaces: the form titles are compared in."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s]", "")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def safe(text: Column) -> Column:
    """Without the characters that upset file systems, and no trailing dots."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r'[<>:"/\\|?*]', "")
    bare = F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))
    return F.regexp_replace(bare, r"\.+$", "")


def parse_names(df: DataFrame, name: str, into: str = "parsed") -> DataFrame:
    """Add a struct column with what a release name tells.

    Fields: title, year, season, episode, episode_title, edition, ids(tmdb, tvdb, imdb), is_tv,
    confident, original.

    Names are short and the rules long, so a file of one split may hold hours of work: each distinct name is read
    once, in as many tasks as there are cores.
    """
    raw = F.col("__raw")
    named = df.withColumn("__raw", paths.stem(paths.file_name(F.col(name))))
    told = _told(named.select(raw).distinct().repartition(df.sparkSession.sparkContext.defaultParallelism, raw), into)
    told = told.withColumnRenamed("__raw", "__told")
    return named.join(told, raw.eqNullSafe(F.col("__told")), "left").drop("__raw", "__told")


def _told(df: DataFrame, into: str) -> DataFrame:
    """What the names in `__raw` tell, with `__raw`."""
    t = "__n_"

    def c(part: str) -> Column:
        return F.col(t + part)

    raw = F.col("__raw")
    lowered = F.translate(F.lower(raw), "._", "  ")
    # One alternation first: most names carry no edition.
    marked_edition = lowered.rlike("|".join(marker for marker, _ in EDITIONS))
    edition = reduce(
        lambda chain, kv: chain.when(lowered.rlike(rf"(?U)\b{kv[0]}\b"), kv[1]),
        EDITIONS[1:],
        F.when(lowered.rlike(rf"(?U)\b{EDITIONS[0][0]}\b"), EDITIONS[0][1]),
    )
    bracketed = F.regexp_extract(raw, rf"[\[({{]\s*{_YEAR}\s*[\])}}]", 1)
    working = F.regexp_replace(raw, r"[\[({][^\])}]*[\])}]", " ")
    working = F.when(bracketed != "", F.concat(working, F.lit(" "), bracketed)).otherwise(working)
    working = F.regexp_replace(working, r"[._]+", " ")
    working = F.regexp_replace(working, r"(?U)\s*-\s*[A-Za-z0-9]+$", " ")
    working = F.trim(F.regexp_replace(working, r"(?U)\s+", " "))
    df = df.withColumns(
        {
            t + "tmdb": _none_if_empty(
                F.regexp_extract(raw, r"(?i)tmdb[\s._-]*(?:id)?[\s._-]*([0-9]+)", 1)
            ),
            t + "tvdb": _none_if_empty(
                F.regexp_extract(raw, r"(?i)tvdb[\s._-]*(?:id)?[\s._-]*([0-9]+)", 1)
            ),
            t + "imdb": F.lower(
                _none_if_empty(F.regexp_extract(raw, r"(?iU)\b(tt[0-9]{7,9})\b", 1))
            ),
            t + "edition": F.when(marked_edition, edition),
            t + "working": working,
        }
    )

    # The episode marker is the strongest anchor; the first form that matches wins.
    df = df.withColumn(t + "tv", F.lit(None).cast("array<string>"))
    for form, hint in _EPISODE_FORMS:
        parts = F.split(
            F.regexp_replace(c("working"), form, f"$1{_MARK}$2{_MARK}$3{_MARK}$4"), _MARK
        )
        df = df.withColumn(t + "m", F.when(c("tv").isNull() & c("working").rlike(hint), parts))
        df = df.withColumn(t + "tv", F.coalesce(c("tv"), F.when(F.size(c("m")) == 4, c("m"))))
    tail = _before_first(
        _words(c("tv")[3]),
        lambda w: F.regexp_replace(F.lower(w), "^-+|-+$", "").isin(JUNK_WORDS)
        | w.rlike(rf"^{_YEAR}$"),
    )
    df = df.withColumns(
        {
            t + "season": c("tv")[1].cast("int"),
            t + "episode": c("tv")[2].cast("int"),
            t + "tail": _none_if_empty(
                F.regexp_replace(F.array_join(tail, " "), "^[ -]+|[ -]+$", "")
            ),
            t + "head": F.coalesce(c("tv")[0], c("working")),
        }
    )
    df = df.withColumn(
        t + "year",
        F.try_element_at(F.regexp_extract_all(c("head"), F.lit(rf"(?U)\b{_YEAR}\b"), F.lit(1)), F.lit(-1)),
    )
    # Cut in front of the year's last occurrence, unless the name begins with it.
    cut = _last_index(c("head"), c("year"))
    df = df.withColumn(
        t + "head",
        F.when(c("year").isNotNull() & (cut > 0), F.substr(c("head"), F.lit(1), cut)).otherwise(
            c("head")
        ),
    )

    def ends_title(word: Column) -> Column:
        clean = F.regexp_replace(F.lower(word), r"^[-()\[\]]+|[-()\[\]]+$", "")
        return clean.isin(JUNK_WORDS) | clean.rlike(r"^[0-9]{3,4}p$")

    df = df.withColumn(t + "words", _before_first(_words(c("head")), ends_title))
    bare = F.regexp_replace(F.array_join(c("words"), " "), "^[ \\-–_]+|[ \\-–_]+$", "")
    df = df.withColumn(t + "bare", bare)
    df = df.withColumns(
        {
            t + "title": title_case(F.when(c("bare") != "", c("bare")).otherwise(raw)),
            t + "episode_title": title_case(c("tail")),
            t + "confident": (F.size(c("words")) > 0)
            & ((F.coalesce(c("season"), F.lit(0)) != 0) | c("year").isNotNull()),
        }
    )
    plain = ["title", "season", "episode", "episode_title", "edition", "confident"]
    told = F.struct(
        *[c(f).alias(f) for f in plain],
        c("year").cast("int").alias("year"),
        F.struct(*[c(f).alias(f) for f in ("tmdb", "tvdb", "imdb")]).alias("ids"),
        c("season").isNotNull().alias("is_tv"),
        raw.alias("original"),
    )
    # Exploding a one-element array keeps filters on the result above this point. Pushed further
    # down, a filter would be rewritten in terms of every step before and grow without bounds.
    return df.select(raw, F.explode(F.array(told)).alias(into))


def _last_index(text: Column, part: Column) -> Column:
    """Characters in front of the last occurrence of `part` in `text`."""
    return F.length(text) - F.length(F.call_function("substring_index", text, part, F.lit(-1))) - F.length(part)


def id_tag(ids: Column, is_tv: Column, scheme: Column) -> Column:
    """Provider id in the syntax the media server reads, '' when there is none."""
    tv = F.when(is_tv & ids["tvdb"].isNotNull(), F.concat(F.lit("tvdb:"), ids["tvdb"]))
    chosen = F.coalesce(
        tv,
        F.concat(F.lit("tmdb:"), ids["tmdb"]),
        F.concat(F.lit("tvdb:"), ids["tvdb"]),
        F.concat(F.lit("imdb:"), ids["imdb"]),
    )
    key, value = F.substring_index(chosen, ":", 1), F.substring_index(chosen, ":", -1)
    plex = F.concat(F.lit(" {"), key, F.lit("-"), value, F.lit("}"))
    other = F.concat(F.lit(" ["), key, F.lit("id-"), value, F.lit("]"))
    return F.coalesce(F.when(scheme == "plex", plex).otherwise(other), F.lit(""))


def with_path(
    df: DataFrame, parsed: str, scheme: Column, extension: Column, folders: Column, into: str
) -> DataFrame:
    """Add the relative path a parsed name should live at."""
    p = F.col(parsed)
    title = safe(p["title"])
    df = df.withColumn("__title", F.when(title == "", F.lit("Unknown")).otherwise(title))
    dated = F.when(
        p["year"].isNotNull(),
        F.concat(F.col("__title"), F.lit(" ("), p["year"].cast("string"), F.lit(")")),
    ).otherwise(F.col("__title"))
    df = df.withColumns(
        {
            "__head": safe(dated),
            "__tag": id_tag(p["ids"], p["is_tv"], scheme),
            "__part": safe(p["episode_title"]),
            "__edition": safe(p["edition"]),
        }
    )
    head, tag, end = F.col("__head"), F.col("__tag"), F.concat(F.lit("."), extension)
    plex = scheme == "plex"
    nothing = F.lit("")

    season = F.when(F.coalesce(p["season"], F.lit(0)) == 0, 1).otherwise(p["season"])
    part = F.when(
        F.coalesce(p["episode_title"], nothing) != "", F.concat(F.lit(" - "), F.col("__part"))
    ).otherwise(nothing)
    episode = F.concat(head, F.format_string(" - S%02dE%02d", season, p["episode"]), part)
    version = F.when(
        p["edition"].isNotNull(),
        F.when(plex, F.concat(F.lit(" {edition-"), F.col("__edition"), F.lit("}"))).otherwise(
            F.concat(F.lit(" - "), F.col("__edition"))
        ),
    ).otherwise(nothing)
    film = F.concat(head, F.when(plex, nothing).otherwise(tag), version)
    folder = F.when(
        folders,
        F.concat(
            head,
            tag,
            F.when(p["is_tv"], F.format_string("/Season %02d/", season)).otherwise(F.lit("/")),
        ),
    ).otherwise(nothing)
    name = F.when(p["is_tv"], episode).otherwise(film)
    out = df.withColumn(into, F.concat(folder, name, end))
    return out.drop("__title", "__head", "__tag", "__part", "__edition")


def with_destination(
    df: DataFrame, path: str, container: Column, library: str, parsed: str, into: str = "destination"
) -> DataFrame:
    """Add where a finished file belongs: in place, renamed, mirrored or flat.

    `library` is a struct column with output_path, watch_path, mirror_folders and naming.
    """
    p, lib = F.col(path), F.col(library)
    rules = lib["naming"]
    df = with_path(
        df,
        parsed,
        F.coalesce(rules["scheme"], F.lit("jellyfin")),
        container,
        F.coalesce(rules["folders"], F.lit(True)),
        "__renamed",
    )
    output = F.coalesce(lib["output_path"], F.lit(""))
    rename = F.coalesce(rules["enabled"], F.lit(False)) & (
        F.col(parsed)["confident"] | ~F.coalesce(rules["skip_uncertain"], F.lit(True))
    )
    name = paths.file_name(p)
    below = F.coalesce(paths.relative_to(p, lib["watch_path"]), name)
    kept = F.when(F.coalesce(lib["mirror_folders"], F.lit(False)), below).otherwise(name)
    return df.withColumn(
        into,
        F.when(output == "", paths.with_suffix(p, container))
        .when(rename, paths.join(output, F.col("__renamed")))
        .otherwise(paths.with_suffix(paths.join(output, kept), container)),
    ).drop("__renamed")

"""Stream-level tests and track titles on flat stream columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediacat.functions import constants as K


def _flag(c: Column | None) -> Column:
    """Disposition flag (0/1 or boolean) as a boolean; a missing flag is off."""
    return F.lit(False) if c is None else F.coalesce(c.cast("boolean"), F.lit(False))


def _lower(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def lang(language: Column) -> Column:
    return F.lower(F.coalesce(language, F.lit("und")))


def is_image(codec_type: Column, codec_name: Column, attached_pic: Column | None = None) -> Column:
    """Cover art and thumbnails stored as video streams."""
    art = F.coalesce(codec_name.isin(K.IMAGE_CODECS), F.lit(False)) | _flag(attached_pic)
    return (codec_type == "video") & art


def is_hdr(color_transfer: Column, color_primaries: Column | None = None) -> Column:
    hit = F.coalesce(color_transfer.isin(K.HDR_TRANSFERS), F.lit(False))
    if color_primaries is not None:
        hit = hit | F.coalesce(color_primaries == "bt2020", F.lit(False))
    return hit


def looks_forced(title: Column, forced: Column | None = None) -> Column:
    words = reduce(lambda a, w: a | _lower(title).contains(w), K.FORCED_WORDS, F.lit(False))
    return _flag(forced) | words


def is_commentary(title: Column, comment: Column | None = None) -> Column:
    t = _lower(title)
    return (
        _flag(comment)
        | t.contains("commentary")
        | (t.contains("director") & ~t.contains("cut"))
    )


def is_descriptive(title: Column, descriptions: Column | None = None) -> Column:
    t = _lower(title)
    return _flag(descriptions) | t.contains("descriptive") | t.contains("audio description")


def is_sdh(title: Column, hearing_impaired: Column | None = None) -> Column:
    t = _lower(title)
    return (
        _flag(hearing_impaired)
        | t.contains("sdh")
        | t.contains("hearing impaired")
        | (F.trim(t) == "cc")
    )


def channel_label(channels: Column, layout: Column | None = None) -> Column:
    """5.1 or 7.1 from the layout text, else a name for the count, else 'Nch'; NULL when unknown."""
    text = F.lit("") if layout is None else _lower(layout)
    by_count = reduce(
        lambda chain, kv: chain.when(channels == kv[0], kv[1]),
        list(K.CHANNEL_LABELS.items())[1:],
        F.when(channels == 1, K.CHANNEL_LABELS[1]),
    ).otherwise(F.concat(channels.cast("string"), F.lit("ch")))
    return F.when(
        F.coalesce(channels, F.lit(0)) != 0,
        F.when(text.contains("5.1"), "5.1").when(text.contains("7.1"), "7.1").otherwise(by_count),
    )


def _language_map() -> Column:
    return F.create_map(*[F.lit(v) for pair in K.LANGUAGES for v in pair])


def language_name(code: Column) -> Column:
    """Display name of a code, by the whole code or else its first two letters."""
    c = F.lower(F.trim(code))
    names = _language_map()
    found = F.coalesce(
        F.try_element_at(names, c), F.try_element_at(names, F.substring(c, 1, 2))
    )
    return F.when(c.isNotNull() & ~c.isin(K.UNKNOWN_LANGUAGES), found)


def language_from_title(title: Column) -> Column:
    """Three-letter code of the first listed language named as a word in a track title."""
    first: dict[str, str] = {}
    for code, name in K.LANGUAGES:
        if len(code) == 3:
            first.setdefault(name.lower(), code)
    words = "|".join(first)
    named = F.regexp_extract_all(_lower(title), F.lit(rf"(?U)\b({words})\b"), F.lit(1))
    places = F.create_map(*[F.lit(v) for i, n in enumerate(first) for v in (n, i + 1)])
    earliest = F.array_min(F.transform(named, lambda n: F.try_element_at(places, n)))
    return F.try_element_at(F.array(*[F.lit(c) for c in first.values()]), earliest)


def track_title(
    codec_type: Column,
    language: Column,
    title: Column,
    channels: Column,
    layout: Column | None = None,
    comment: Column | None = None,
    descriptions: Column | None = None,
    forced: Column | None = None,
    hearing_impaired: Column | None = None,
) -> Column:
    """struct(title, language) for an audio or subtitle track; NULL fields when unknown."""
    tagged = language_name(lang(language))
    guessed = language_from_title(title)
    name = F.coalesce(tagged, language_name(guessed))

    def extras(*pairs) -> Column:
        text = F.concat_ws(", ", *[F.when(test, F.lit(label)) for test, label in pairs])
        return F.when(text != "", F.concat(F.lit(" ("), text, F.lit(")"))).otherwise(F.lit(""))

    audio = F.concat(
        F.concat_ws(" ", name, channel_label(channels, layout)),
        extras(
            (is_commentary(title, comment), "Commentary"),
            (is_descriptive(title, descriptions), "Audio Description"),
        ),
    )
    subtitle = F.concat(
        name,
        extras(
            (looks_forced(title, forced), "Forced"), (is_sdh(title, hearing_impaired), "SDH")
        ),
    )
    new_title = F.when(codec_type == "audio", audio).when(codec_type == "subtitle", subtitle)
    code = F.when(tagged.isNotNull(), lang(language)).otherwise(guessed)
    return F.struct(
        F.when(name.isNotNull(), new_title).alias("title"),
        F.when(name.isNotNull(), code).alias("language"),
    )

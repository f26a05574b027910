"""Fuzzy matching of parsed titles against a title catalogue.

A catalogue title is a candidate when twice the letter pairs it shares with the query are two fifths of both titles' (`SHARED`). To find
those without comparing every pair, each side looks up only its rarest letter pairs, as many as it takes to be sure of
meeting every candidate. The sequence ratio itself, which only Python has, is taken for those pairs alone whose
letters allow a score above the floor, once for each distinct pair of strings; years and popularity are
brought in afterwards from per-year summaries, so that repeated titles on either side do not multiply.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from mediacat.functions import constants as K
from mediacat.functions.names import normalise


@F.pandas_udf(DoubleType())
def _ratio(candidate: pd.Series, query: pd.Series) -> pd.Series:
    return pd.Series(
        [difflib.SequenceMatcher(None, c, q).ratio() if c else 0.0 for c, q in zip(candidate, query)],
        dtype="float64",
    )


#: Shared letter pairs times this are at least all letter pairs of both titles.
SHARED = 5
BONUS = K.YEAR_SAME_BONUS + K.POPULARITY_CAP


def _numbered(items: Column) -> Column:
    """The items of a list, each with how many equal ones come before it: then equal lists of them are equal sets."""
    return F.transform(
        items, lambda x, i: F.concat(x, F.size(F.filter(F.slice(items, F.lit(1), i), lambda y: y == x)).cast("string"))
    )


def letter_pairs(text: Column) -> Column:
    """Neighbouring letters of a title, blanks at both ends included, repeated ones apart."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    return _numbered(F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substr(padded, i, F.lit(2))))


def letters(text: Column) -> Column:
    return _numbered(F.split(text, ""))


def ratio_bound(a: Column, b: Column) -> Column:
    """The most that the sequence ratio of two texts can be, from their `letters`: that of the best order."""
    return F.size(F.array_intersect(a, b)) * 2.0 / (F.size(a) + F.size(b))


def _met_once(titles: DataFrame, text: str) -> DataFrame:
    """Distinct rows. Exploding a one-element array keeps what is asked of them above this point: the sizes that Spark
    infers for a title's letter pairs would else be worked out on every row before equal ones meet."""
    return titles.distinct().withColumn(text, F.explode(F.array(text)))


def _rarest(titles: DataFrame, text: str, frequency: DataFrame) -> DataFrame:
    """A row for each of a title's rarest letter pairs: of n, the n - ceil(n/4) + 1 that fewest catalogue titles have.

    Two titles that share enough share at least a quarter of each one's pairs, so that the first of their
    shared pairs, in the order of rarity, is among these on both sides.
    """
    own = [f"{text}_pairs", f"{text}_letters"]
    pairs = titles.select("is_tv", text, *own, F.explode(own[0]).alias("p")).join(frequency, ["is_tv", "p"], "left")
    counted = pairs.groupBy("is_tv", text).agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "p"))).alias("all"), *[F.first(c).alias(c) for c in own]
    )
    least = F.ceil(F.size("all") / (SHARED - 1)).cast("int")
    return counted.select("is_tv", text, *own, F.explode(F.slice("all", F.lit(1), F.size("all") - least + 1)).alias("r")).select(
        "is_tv", text, *own, "r.p"
    )


def candidate_pairs(queries: DataFrame, titles: DataFrame) -> DataFrame:
    """Distinct (is_tv, q, t) that share enough of their letter pairs, with `bound`, the most their ratio can be.

    Rare pairs meet in an ordinary equi-join; what a frequent one brings together is split by AQE.
    """

    def listed(df: DataFrame, text: str) -> DataFrame:
        c = F.col(text)
        return _met_once(df.select("is_tv", text), text).select("is_tv", text, letter_pairs(c).alias(f"{text}_pairs"), letters(c).alias(f"{text}_letters"))

    asked, held = listed(queries, "q"), listed(titles, "t")
    frequency = held.select("is_tv", F.explode("t_pairs").alias("p")).groupBy("is_tv", "p").agg(F.count(F.lit(1)).alias("n"))
    met = _rarest(asked, "q", frequency).join(_rarest(held, "t", frequency), ["is_tv", "p"])
    q, t = F.size("q_pairs"), F.size("t_pairs")
    lists = [f"{x}_{kind}" for x in "qt" for kind in ("pairs", "letters")]
    near = met.where(F.least(q, t) * SHARED >= q + t).groupBy("is_tv", "q", "t").agg(*[F.first(c).alias(c) for c in lists])
    return near.where(F.size(F.array_intersect("q_pairs", "t_pairs")) * SHARED >= q + t).select(
        "is_tv", "q", "t", ratio_bound(F.col("q_letters"), F.col("t_letters")).alias("bound")
    )


def _year_term(year: Column, want: Column) -> Column:
    gap = F.abs(year - want)
    return (
        F.when(gap == 0, F.lit(K.YEAR_SAME_BONUS))
        .when(gap == 1, F.lit(K.YEAR_NEAR_BONUS))
        .when(gap > 1, F.lit(-K.YEAR_FAR_PENALTY))
        .otherwise(F.lit(0.0))
    )


def match_titles(wanted: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Best catalogue entry for each distinct (q, year, is_tv), where one is convincing.

    wanted: title, year, is_tv. catalogue: title_id, title, year, popularity, is_tv. For a film
    with a year only candidates of that year count, unless there are none. Equal scores go to the
    more popular entry, then the smaller id. Returns q, year, is_tv, title_id, match_title,
    match_year, confidence.
    """
    queries = (
        _met_once(wanted.select("title", F.col("year").cast("int").alias("year"), "is_tv"), "title")
        .select(normalise(F.col("title")).alias("q"), "year", "is_tv")
        .where(F.col("q") != "")
        .distinct()
    )
    # The only entry of a title and year that can win is the most popular one. Equal titles meet first, so that
    # each is normalised once a year.
    rank = F.struct(
        F.coalesce(F.col("popularity"), F.lit(0)).cast("double").alias("pop"), (-F.col("title_id")).alias("neg"), "title_id", "title"
    )
    alike = catalogue.groupBy("is_tv", "title", F.col("year").cast("int").alias("cyear")).agg(F.max(rank).alias("e"))
    by_year = alike.groupBy("is_tv", normalise(F.col("title")).alias("t"), "cyear").agg(F.max("e").alias("e"))
    # Candidates that cannot reach the floor still say that there is one of the year; their ratio counts as none.
    hopeful = F.col("bound") + BONUS >= K.MATCH_FLOOR - 1e-9
    # The explode keeps the bound out of the Python function's arguments, where it could not be evaluated.
    judged = candidate_pairs(queries, by_year).withColumn("c", F.explode(F.array(F.when(hopeful, F.col("t")).otherwise(""))))
    scored = judged.withColumn("ratio", _ratio("c", "q")).drop("c", "bound")

    # Three years get their own term for a given query; beyond those the best of the rest is
    # among a title's four most popular years.
    popular = W.partitionBy("is_tv", "t").orderBy(F.desc("e"))
    dated = by_year.where(F.col("cyear").isNotNull())
    top = (
        dated.withColumn("__k", F.row_number().over(popular)).where(F.col("__k") <= 4).drop("__k")
    ).unionByName(by_year.where(F.col("cyear").isNull()))

    asked = queries.join(scored, ["is_tv", "q"])
    near = (
        asked.where(F.col("year").isNotNull())
        .withColumn("cyear", F.explode(F.array(F.col("year") - 1, F.col("year"), F.col("year") + 1)))
        .join(dated, ["is_tv", "t", "cyear"])
    )
    other = asked.join(top, ["is_tv", "t"]).where(
        F.coalesce(F.abs(F.col("cyear") - F.col("year")) > 1, F.lit(True))
    )
    cols = ["is_tv", "q", "year", "cyear", "ratio", "e"]
    score = (
        F.col("ratio")
        + _year_term(F.col("cyear"), F.col("year"))
        + F.least(F.col("e.pop") / K.POPULARITY_DIVISOR, F.lit(K.POPULARITY_CAP))
    )
    offer = F.struct(score.alias("score"), "e", "cyear")
    same = F.coalesce(F.col("cyear") == F.col("year"), F.lit(False))
    best = (
        near.select(*cols)
        .unionByName(other.select(*cols))
        .groupBy("is_tv", "q", "year")
        .agg(F.max(offer).alias("any"), F.max(F.when(same, offer)).alias("same"))
        .withColumn(
            "b",
            F.when(F.col("is_tv") | F.col("year").isNull(), F.col("any")).otherwise(
                F.coalesce("same", "any")
            ),
        )
    )
    return best.where(F.col("b.score") >= K.MATCH_FLOOR).select(
        "q",
        "year",
        "is_tv",
        F.col("b.e.title_id").alias("title_id"),
        F.col("b.e.title").alias("match_title"),
        F.col("b.cyear").alias("match_year"),
        F.bround(F.least(F.col("b.score"), F.lit(1.0)), 2).alias("confidence"),
    )


def enrich(
    names: DataFrame, matches: DataFrame, external_ids: DataFrame | None = None,
    episodes: DataFrame | None = None, parsed: str = "parsed",
) -> DataFrame:
    """Parsed names with the matched title, year and ids in place of the guesses.

    external_ids: title_id, tvdb. episodes: title_id, season, episode, name. Names without a
    match stay as they are, with `looked_up` false.
    """
    p = F.col(parsed)
    df = names.withColumns(
        {"__q": normalise(p["title"]), "__y": p["year"].cast("int"), "__tv": p["is_tv"]}
    )
    m = matches.select(
        F.col("q").alias("__mq"), F.col("year").alias("__my"), F.col("is_tv").alias("__mtv"),
        "title_id", "match_title", "match_year", "confidence",
    )
    on = (
        (F.col("__q") == F.col("__mq"))
        & F.col("__y").eqNullSafe(F.col("__my"))
        & (F.col("__tv") == F.col("__mtv"))
    )
    df = df.join(m, on, "left")
    tvdb, episode = F.lit(None).cast("string"), F.lit(None).cast("string")
    if external_ids is not None:
        ids = external_ids.select("title_id", F.col("tvdb").cast("string").alias("__tvdb"))
        df = df.join(ids, "title_id", "left")
        tvdb = F.when(F.col("__tv"), F.col("__tvdb"))
    if episodes is not None:
        e = episodes.select(
            F.col("title_id").alias("__et"), F.col("season").alias("__es"),
            F.col("episode").alias("__ee"), F.col("name").alias("__en"),
        )
        df = df.join(
            e,
            (F.col("title_id") == F.col("__et")) & (p["season"] == F.col("__es"))
            & (p["episode"] == F.col("__ee")) & (p["season"] != 0) & (p["episode"] != 0),
            "left",
        )
        episode = F.when(F.col("__en") != "", F.col("__en"))
    hit = F.col("title_id").isNotNull()
    ids = F.struct(
        F.when(hit, F.col("title_id").cast("string")).otherwise(p["ids"]["tmdb"]).alias("tmdb"),
        F.coalesce(tvdb, p["ids"]["tvdb"]).alias("tvdb"),
        p["ids"]["imdb"].alias("imdb"),
    )
    new = (
        p.withField("title", F.coalesce(F.col("match_title"), p["title"]))
        .withField("year", F.coalesce(F.col("match_year"), p["year"]))
        .withField("episode_title", F.coalesce(episode, p["episode_title"]))
        .withField("ids", ids)
        .withField("confident", p["confident"] | hit)
    )
    return df.select(
        *[c for c in names.columns if c != parsed],
        new.alias(parsed),
        hit.alias("looked_up"),
        F.col("confidence").alias("match_confidence"),
    )

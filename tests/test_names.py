"""Release names: parsing, titles and paths."""

import difflib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from mediacat.functions import names as N
from mediacat.operators import matching


def parse(spark, *names):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    return [r.parsed for r in N.parse_names(rows, "name").orderBy("i").collect()]


def test_parsing(spark):
    cases = {
        "Wrath.of.Man.2021.1080p.x265.mkv": ("Wrath of Man", 2021, None, None, None, None, True),
        "The.Show.S02E05.The.Long.Night.1080p.WEB.mkv": ("The Show", None, 2, 5, "The Long Night", None, True),
        "show name 1x07 720p.avi": ("Show Name", None, 1, 7, None, None, True),
        "Some.Show.Season.3.Episode.12.Part.Two.HDTV.mkv": ("Some Show", None, 3, 12, "Part Two", None, True),
        "Dune (2024) [1080p].mkv": ("Dune", 2024, None, None, None, None, True),
        "Film.Extended.Cut.2010.BluRay.mkv": ("Film", 2010, None, None, None, "Extended", True),
        "Blade.Runner.The.Final.Cut.1982.mkv": ("Blade Runner the", 1982, None, None, None, "Final Cut", True),
        "2012.2009.mkv": ("2012", 2009, None, None, None, None, True),
        "1917.mkv": ("1917", 1917, None, None, None, None, True),
        "Movie.Name.2020": ("Movie Name", None, None, None, None, None, False),
        "Just A Name-GROUP.mkv": ("Just a Name", None, None, None, None, None, False),
        "WALL-E.2008.1080p.mkv": ("WALL-E", 2008, None, None, None, None, True),
        "spider-man.2002.mkv": ("Spider-Man", 2002, None, None, None, None, True),
        "1080p.mkv": ("1080p", None, None, None, None, None, False),
        "Show.S00E03.mkv": ("Show", None, 0, 3, None, None, False),
        "Show.2019.S01E02.mkv": ("Show", 2019, 1, 2, None, None, True),
        "Film.2001.DTS.5.1.mkv": ("Film", 2001, None, None, None, None, True),
    }
    got = parse(spark, *cases)
    for (name, want), p in zip(cases.items(), got):
        assert (p.title, p.year, p.season, p.episode, p.episode_title, p.edition, p.confident) == want, name
        assert p.is_tv == (want[2] is not None)


def test_ids(spark):
    a, b, c = parse(
        spark, "Film [tmdbid-603] tt0133093 (1999).mkv", "Show {tvdb-81189} S01E01.mkv", "Film TT1234567.mkv"
    )
    assert (a.ids.tmdb, a.ids.tvdb, a.ids.imdb, a.year) == ("603", None, "tt0133093", 1999)
    assert (b.ids.tvdb, b.is_tv) == ("81189", True)
    assert c.ids.imdb == "tt1234567"


def test_paths(spark):
    names = [
        "Wrath.of.Man.2021.1080p.mkv", "Film [tmdbid-603] Extended (1999).mkv", "Show {tvdb-81189} S01E02 Pilot 1080p.mkv",
        "a_b 1x100.mkv", "x.mkv",
    ]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    df = N.parse_names(rows, "name")

    def paths(scheme, folders=True):
        out = N.with_path(df, "parsed", F.lit(scheme), F.lit("mkv"), F.lit(folders), "p")
        return [r.p for r in out.orderBy("i").collect()]

    jelly, plex, flat = paths("jellyfin"), paths("plex"), paths("emby", False)
    assert jelly[0] == "Wrath of Man (2021)/Wrath of Man (2021).mkv"
    assert jelly[1] == "Film (1999) [tmdbid-603]/Film (1999) [tmdbid-603] - Extended.mkv"
    assert plex[1] == "Film (1999) {tmdb-603}/Film (1999) {edition-Extended}.mkv"
    assert jelly[2] == "Show [tvdbid-81189]/Season 01/Show - S01E02 - Pilot.mkv"
    assert jelly[3] == "A B/Season 01/A B - S01E100.mkv"
    assert flat[0] == "Wrath of Man (2021).mkv" and flat[4] == "X.mkv"
    r = spark.range(1).select(
        N.safe(F.lit('a<b>:"c/ d|?* e..')).alias("s"), N.normalise(F.lit(" It's  A-Film! ")).alias("n"),
        N.title_case(F.lit("the lord OF the rings: the USA")).alias("t"),
    ).first()
    assert r.s == "abc d e" and r.n == "its afilm" and r.t == "The Lord of the Rings: the USA"


def norm(text):
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", text.lower())).strip()


def shared_pairs(a, b):
    """Twice the shared letter pairs over all of both."""
    one, two = ([f" {x} "[i : i + 2] for i in range(len(x) + 1)] for x in (a, b))
    return 2 * sum((Counter(one) & Counter(two)).values()) / (len(one) + len(two))


def brute_force(wanted, catalogue):
    """Every query against every title, one at a time."""
    out = {}
    for title, year, tv in set(wanted):
        q = norm(title)
        hits = [c for c in catalogue if c[4] == tv and shared_pairs(q, norm(c[1])) >= 0.4]
        if year and not tv:
            hits = [c for c in hits if c[2] == year] or hits
        best, best_score = None, 0.0
        for c in sorted(hits, key=lambda c: (-c[3], c[0])):
            score = difflib.SequenceMatcher(None, norm(c[1]), q).ratio()
            if year and c[2]:
                score += 0.15 if c[2] == year else 0.05 if abs(c[2] - year) == 1 else -0.20
            score += min(c[3] / 1000, 0.05)
            if score > best_score:
                best, best_score = c, score
        if best and best_score >= 0.62:
            out[(q, year, tv)] = best[0]
    return out


def test_matching_equals_brute_force(spark):
    rng = random.Random(7)
    words = "the red blue old man sea night of star lost king queen road".split()
    catalogue = []
    for i in range(300):
        # A third of the catalogue carries one and the same title.
        name = "The Red King" if i % 3 == 0 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
        year = None if i % 11 == 0 else rng.randint(1990, 2000)
        catalogue.append((i, name.title(), year, float(rng.choice([0, 5, 20, 60, 80, 80])), i % 2 == 0))
    wanted = []
    for _ in range(150):
        name = " ".join(rng.choice(words + ["unknown"]) for _ in range(rng.randint(1, 4)))
        wanted.append((name.title(), rng.choice([None, 1991, 1995, 2001, 2020]), rng.random() < 0.5))
    wanted += [("The Red King", y, tv) for y in (None, 1990, 1995, 2005) for tv in (True, False)]
    got = matching.match_titles(
        spark.createDataFrame(wanted, "title string, year int, is_tv boolean"),
        spark.createDataFrame(catalogue, "title_id bigint, title string, year int, popularity double, is_tv boolean"),
    ).collect()
    assert {(r.q, r.year, r.is_tv): r.title_id for r in got} == brute_force(wanted, catalogue)
    assert len(got) > 60 and all(0.62 <= r.confidence <= 1.0 for r in got)


def test_candidates_lose_no_pair_and_few_ratios(spark):
    """Prefixes against all pairs; nine tenths of all pairs with a ratio over the floor are candidates."""
    rng = random.Random(5)
    words = "the red blue old man sea night of star lost king queen road return island winter river".split()
    texts = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(250)} | {"a", "aa", "aaaaaaa", "b"})
    schema = "is_tv boolean, {} string"
    q, t = (spark.createDataFrame([(True, x) for x in texts], schema.format(c)) for c in "qt")
    got = {(r.q, r.t) for r in matching.candidate_pairs(q, t).collect()}
    want = {(a, b) for a in texts for b in texts if shared_pairs(a, b) >= 0.4}
    assert got == want and len(got) < 0.25 * len(texts) ** 2
    over = {(a, b) for a in texts for b in texts if difflib.SequenceMatcher(None, b, a).ratio() >= 0.62}
    assert len(over & got) >= 0.9 * len(over)
    rows = q.join(t, "is_tv").select("q", "t", matching.ratio_bound(*[matching.letters(F.col(c)) for c in "tq"]).alias("bound")).collect()
    assert all(r.bound >= difflib.SequenceMatcher(None, r.t, r.q).ratio() - 1e-12 for r in rows)


def test_titles_with_slips_are_found(spark):
    """A slip in a word, a missing word, other word breaks: what comparing with every title finds."""
    rng = random.Random(11)
    letters = "abcdefghijklmnoprstuvw"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(700)]
    catalogue = [(i, " ".join(rng.sample(words, rng.randint(1, 4))), None, 1.0, False) for i in range(400)]
    wanted = []
    for i, name, *_ in catalogue[:320]:
        own = name.split(" ")
        k, w = rng.randrange(len(own)), None
        w, at = own[k], rng.randrange(len(own[k]) - 1)
        kind = i % 6
        if kind == 0:
            own[k] = w[:at] + w[at + 1 :]
        elif kind == 1:
            own[k] = w[:at] + rng.choice(letters) + w[at:]
        elif kind == 2:
            own[k] = w[:at] + w[at + 1] + w[at] + w[at + 2 :]
        elif kind == 3:
            own[k] = w[:at] + rng.choice(letters) + w[at + 1 :]
        elif kind == 4 and len(own) > 2:
            own.pop(k)
        else:
            own = ["".join(own)] if len(own) < 3 else [own[0] + own[1], *own[2:]]
        wanted.append((" ".join(own), None, False))
    got = matching.match_titles(
        spark.createDataFrame(wanted, "title string, year int, is_tv boolean"),
        spark.createDataFrame(catalogue, "title_id bigint, title string, year int, popularity double, is_tv boolean"),
    ).collect()
    want = {}
    for q, _, _ in wanted:
        score = {i: difflib.SequenceMatcher(None, name, q).ratio() + 0.001 for i, name, *_ in catalogue}
        best = min(score, key=lambda i: (-score[i], i))
        if score[best] >= 0.62:
            want[q] = best
    found = {r.q: r.title_id for r in got}
    assert len(want) > 300 and {q: found.get(q) for q in want} == want


def test_enrichment(spark):
    names = spark.createDataFrame(
        [(1, "The.Show.S02E05.1080p.mkv"), (2, "Nothing.Like.It.2001.mkv"), (3, "Old.Film.1999.mkv")], "i int, name string"
    )
    parsed = N.parse_names(names, "name")
    titles = spark.createDataFrame(
        [(7, "The Show!", 2015, 50.0, True), (9, "Old Film", 1999, 1.0, False)],
        "title_id bigint, title string, year int, popularity double, is_tv boolean",
    )
    m = matching.match_titles(parsed.select("parsed.title", "parsed.year", "parsed.is_tv"), titles)
    ids = spark.createDataFrame([(7, 70), (9, 90)], "title_id bigint, tvdb bigint")
    eps = spark.createDataFrame([(7, 2, 5, "Pilot")], "title_id bigint, season int, episode int, name string")
    rows = {r.i: r for r in matching.enrich(parsed, m, ids, eps).collect()}
    show, none, film = rows[1], rows[2], rows[3]
    assert (show.parsed.title, show.parsed.year, show.parsed.episode_title) == ("The Show!", 2015, "Pilot")
    assert (show.parsed.ids.tmdb, show.parsed.ids.tvdb, show.looked_up) == ("7", "70", True)
    assert none.parsed.title == "Nothing Like It" and not none.looked_up
    assert (film.parsed.ids.tmdb, film.parsed.ids.tvdb) == ("9", None)


def test_titles_and_names_are_worked_on_once(spark):
    """What is asked of letter pairs stays above the distinct titles, and names leave the one task that read them."""
    q = spark.range(0, 100, 1, 1).selectExpr("id % 2 = 0 as is_tv", "concat('a ', id % 3) as q")
    pairs = matching.candidate_pairs(q, q.withColumnRenamed("q", "t"))
    lines = pairs._jdf.queryExecution().optimizedPlan().toString().split("\n")
    below = [after for line, after in zip(lines, lines[1:]) if "Filter" in line and "sequence(1" in line]
    assert below and all("Generate explode" in line for line in below)
    rows = spark.range(0, 1000, 1, 1).selectExpr("id", "case when id < 900 then concat('Film.', id % 5, '.1999.mkv') end as name")
    parsed = N.parse_names(rows, "name")
    assert "REPARTITION_BY_NUM" in parsed._jdf.queryExecution().executedPlan().toString()
    assert parsed.columns == ["id", "name", "parsed"] and parsed.count() == 1000
    assert parsed.where("parsed.year = 1999").count() == 900 and parsed.where("parsed is null").count() == 0

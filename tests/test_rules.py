"""Expectations for single rules, one inline row each."""

from pyspark.sql import functions as F

from mediacat.functions import logs as L
from mediacat.functions import paths as P
from mediacat.functions import rules as R
from mediacat.functions import tracks as T
from mediacat.operators import nodes as N
from mediacat.operators import outcomes as O

S = "string"


def values(spark, *exprs):
    """Evaluate columns on one row that the optimizer cannot fold away."""
    row = spark.range(1).select(*[e.alias(f"c{i}") for i, e in enumerate(exprs)]).first()
    return list(row)


def filters(**on):
    lists = ("skip_extensions", "only_extensions", "skip_name_contains", "only_name_contains", "skip_video_codecs")
    nums = ("min_size_mb", "max_size_mb", "min_minutes", "max_minutes", "min_bitrate_kbps", "max_bitrate_kbps")
    cols = []
    for n in lists:
        v = on.get(n)
        c = F.lit(None).cast("array<string>") if v is None else F.array(*[F.lit(x) for x in v])
        cols.append(c.alias(n))
    cols += [F.lit(on.get(n)).cast("double").alias(n) for n in nums]
    return R.tidy_filters(F.struct(*cols))


def skip(path, size=10**9, dur=None, rate=None, codec=None, **on):
    return R.skip_reason(
        F.lit(path), F.lit(size), filters(**on), F.lit(dur).cast("double"), F.lit(rate).cast("bigint"),
        F.lit(codec).cast(S),
    )


def test_skip_rules(spark):
    cases = [
        (skip("/m/a.mkv", skip_extensions=["mp4"]), None),
        (skip("/m/a.MP4", skip_extensions=[".mp4"]), "extension left out: mp4"),
        (skip("/m/a.mkv", only_extensions=["avi", ".MP4"]), "not one of avi, mp4"),
        (skip("/m/Show.mkv", only_name_contains=["film"]), "name has none of the required texts"),
        (skip("/m/A.Sample.mkv", skip_name_contains=["nope", "SAMPLE"]), "name has the text: SAMPLE"),
        (skip("/m/a.mkv", size=1048576, min_size_mb=2), "under the least size, MB: 2"),
        (skip("/m/a.mkv", size=1048576, min_size_mb=1), None),
        (skip("/m/a.mkv", size=3 * 1048576, max_size_mb=2.5), "over the greatest size, MB: 2.5"),
        (skip("/m/a.mkv", dur=600, min_minutes=11), "under the least minutes: 11"),
        (skip("/m/a.mkv", dur=0, min_minutes=11), None),
        (skip("/m/a.mkv", dur=None, max_minutes=1), None),
        (skip("/m/a.mkv", dur=6000, max_minutes=90), "over the greatest minutes: 90"),
        (skip("/m/a.mkv", rate=2500500, min_bitrate_kbps=3000), "rate low enough, kbps: 2500"),
        (skip("/m/a.mkv", rate=9000000, max_bitrate_kbps=8000), "rate over the greatest, kbps: 8000"),
        (skip("/m/a.mkv", rate=0, min_bitrate_kbps=3000), None),
        (skip("/m/a.mkv", codec="HEVC", skip_video_codecs=["hevc"]),
         "video codec left out, whatever the audio: HEVC"),
        (skip("/m/a.mkv", min_size_mb=0, max_size_mb=0, min_minutes=0), None),
    ]
    got = values(spark, *[c["reason"] for c, _ in cases])
    assert got == [want for _, want in cases]


def plan(path, codec, audio, efficient=True, want=("hevc", "aac", "mkv")):
    a = F.lit(None).cast("array<string>") if audio is None else F.array(*[F.lit(x) for x in audio]).cast("array<string>")
    return R.conversion_plan(
        F.lit(path), F.lit(codec).cast(S), a, F.lit(efficient), *[F.lit(w) for w in want]
    )


def test_conversion_plan(spark):
    cases = [
        (plan("/m/a.mkv", "hevc", ["ac3"]), "audio_only", "video stays hevc, audio from ac3 to AAC"),
        (plan("/m/a.mkv", "hevc", ["aac", "aac"]), "skip", "nothing to change"),
        (plan("/m/a.MKV", "hevc", ["aac"]), "skip", "nothing to change"),
        (plan("/m/a.mp4", "hevc", ["aac"]), "remux", "new container: MKV"),
        (plan("/m/a.mkv", "h264", ["aac"]), "video_only", "audio stays AAC, video to HEVC"),
        (plan("/m/a.mkv", "h264", ["dts", "aac"]), "full", "video to HEVC, audio to AAC"),
        (plan("/m/a.mkv", "hevc", ["aac"], efficient=False), "video_only",
         "audio stays AAC, video to HEVC"),
        (plan("/m/a.mkv", "hevc", []), "audio_only", "video stays hevc, audio from ? to AAC"),
        (plan("/m/a.mkv", "hevc", []  , want=("hevc", "copy", "mkv")), "skip", "nothing to change"),
        (plan("/m/a.mkv", None, None), "full", "video to HEVC, audio to AAC"),
        (plan("/m/a.mkv", "av1", ["opus", "dts", "dts"], want=("copy", "aac", "mkv")), "audio_only",
         "video stays av1, audio from dts/opus to AAC"),
    ]
    got = values(spark, *[F.struct(c["action"], c["why"]) for c, _, _ in cases])
    assert [tuple(r) for r in got] == [(a, w) for _, a, w in cases]
    assert values(spark, plan("/m/a.mkv", "hevc", ["ac3"])["codec"], plan("/m/a.mkv", "h264", ["aac"])["audio"]) == [
        "copy", "copy",
    ]


def test_tiers_and_ceilings(spark):
    ceiling = F.struct(
        F.lit(True).alias("enabled"), F.lit(0.0).alias("sd"), F.lit(None).cast("double").alias("hd"),
        F.lit(5000.0).alias("fullhd"), F.lit(None).cast("double").alias("uhd"),
    )
    off = F.struct(F.lit(False).alias("enabled"), *[F.lit(1.0).alias(t) for t in ("sd", "hd", "fullhd", "uhd")])
    h = [F.lit(v).cast("int") for v in (1600, 1599, 1000, 700, 699, None)]
    assert values(spark, *[R.tier(x) for x in h]) == ["uhd", "fullhd", "fullhd", "hd", "sd", "sd"]
    ok = lambda rate, height, c=ceiling: R.video_is_efficient(
        F.lit(rate).cast("bigint"), F.lit(height).cast("int"), c)
    assert values(
        spark, ok(5000000, 1080), ok(5000001, 1080), ok(1500000, 480), ok(1500001, 480), ok(18000000, 2160),
        ok(None, 1080), ok(10**9, 1080, off),
    ) == [True, False, True, False, True, True, True]


def test_probe_figures(spark):
    depth = lambda bits, fmt: R.bit_depth(F.lit(bits).cast(S), F.lit(fmt).cast(S))
    assert values(
        spark, depth(None, "yuv420p"), depth(None, "yuv420p10le"), depth("10", "yuv420p"), depth("x", "yuv444p12le"),
        depth("", None),
    ) == [8, 10, 10, 12, 8]
    est = lambda s, t, n: R.estimated_video_bitrate(F.lit(s).cast("bigint"), F.lit(t).cast("bigint"), F.lit(n))
    assert values(spark, est(5, 9, 1), est(0, 1000000, 2), est(None, 100000, 0), est(0, 0, 1)) == [
        5, 616000, 0, 0,
    ]


def test_quality_and_savings(spark):
    base = lambda level, crf=None: R.base_quality(F.lit(level).cast(S), F.lit(crf).cast("int"))
    ladder = lambda b, on, steps, own=None: R.retry_ladder(
        F.lit(b), F.lit(on), F.array(*[F.lit(s) for s in steps]).cast("array<string>"), F.lit(own).cast("int"))
    assert values(spark, base("balanced"), base("archive"), base(None), base("small", 31), base("high", 0)) == [
        22, 18, 22, 31, 20,
    ]
    assert values(
        spark, ladder(22, False, []), ladder(22, True, ["small", "smaller"]), ladder(22, True, []),
        ladder(36, True, ["small", "smaller", "smallest"]), ladder(22, True, ["custom"], 60), ladder(22, True, ["custom"]),
    ) == [[], [26, 30], [26, 30], [40], [51], []]
    assert values(
        spark, R.next_rung(ladder(22, True, []), F.lit(26)), R.next_rung(ladder(22, True, []), F.lit(0)),
        R.next_rung(ladder(22, True, []), F.lit(30)),
    ) == [30, 26, None]
    steps = values(spark, R.manual_steps(F.lit(22)))[0]
    assert [s.quality for s in steps] == [26, 30, 34, None]
    v = lambda b, a, m=None: R.savings_verdict(F.lit(b).cast("bigint"), F.lit(a).cast("bigint"), F.lit(m).cast("double"))
    got = values(spark, v(1000, 400), v(1000, 1200), v(1000, 970, 10), v(0, 5), v(5, None), v(10, 10))
    assert [g.ok for g in got] == [True, False, False, True, True, False]
    assert [g.code for g in got] == ["worth_it", "larger", "below_minimum", "unknown", "unknown", "larger"]
    assert got[1].percent < 0 and got[1].reason == "grew by 20 percent"
    assert got[2].reason == "saves 3 percent, wanted 10"
    assert values(spark, R.projected_ratio(F.lit(200000000), F.lit(50.0), F.lit(10**9)),
                  R.projected_ratio(F.lit(1), F.lit(0.0), F.lit(9))) == [0.4, None]


def test_run_limits(spark):
    now = 1_000_000
    o = lambda state, started, moved, limit=7200, stall=1800: R.overrun_verdict(
        F.lit(state), F.lit(started).cast("bigint"), F.lit(moved).cast("bigint"), F.lit(now),
        F.lit(limit).cast("double"), F.lit(stall).cast("double"))["reason"]
    got = values(
        spark, o("running", now - 600, now - 30), o("running", now - 9000, now - 30), o("leased", now - 9000, None),
        o("running", now - 3000, now - 2700), o("running", now - 3000, None), o("leased", now - 3000, now - 2700),
        o("queued", None, None), o("done", 0, 0), o("running", now - 3000, now - 2700, stall=None),
        o("running", now - 9000, now, limit=None), o("running", now - 7200, now - 1800),
    )
    over = "Over its time limit: ran 2.5 hours, allowed 2 hours"
    assert got == [
        None, over, over, "Stands still: no progress in 45 minutes",
        "Stands still: no progress in 50 minutes", None, None, None, None, None, None,
    ]
    limit = lambda on, n, unit: R.limit_seconds(F.lit(on), F.lit(n).cast("double"), F.lit(unit))
    assert values(spark, limit(True, 90, "minutes"), limit(True, 2, "days"), limit(True, 0, "hours"),
                  limit(False, 6, "hours"), limit(True, 1, "weeks")) == [5400, 172800, None, None, 3600]
    stall = lambda on, s, m: R.stall_seconds(F.lit(on), F.lit(s).cast("boolean"), F.lit(m).cast("double"))
    assert values(spark, stall(True, None, 30), stall(True, False, 30), stall(True, True, 0)) == [1800, None, None]
    assert values(spark, *[R.human_duration(F.lit(s).cast("double")) for s in (60, 5400, 172800, 3599, None)]) == [
        "1 minute", "1.5 hours", "2 days", "60 minutes", "no limit",
    ]
    assert values(spark, *[R.human_size(F.lit(n).cast("bigint")) for n in (0, 2_500_000_000, 5_000_000)]) == [
        "unknown", "2.50 GB", "5 MB",
    ]


def mounts(server, local):
    return F.array(F.struct(F.lit(server).alias("server"), F.lit(local).alias("local")))


def test_paths(spark):
    back = lambda p, s, l: P.reverse_path(F.lit(p), mounts(s, l))
    there = lambda p, s, l: P.resolve_path(F.lit(p), mounts(s, l))
    assert values(
        spark, back("Z:\\Media\\Movies\\.part-7.mkv", "/media", "Z:/Media"),
        back("\\\\nas\\media\\Movies\\.part-7.mkv", "/media", "//nas/media"),
        back("Z:\\Media\\a.mkv", "/media", "Z:\\Media"), back("/mnt/nas/media/Movies/x.mkv", "/media", "/mnt/nas/media"),
        back("/elsewhere/x.mkv", "/media", "/mnt"), back("/mediax/a.mkv", "/m", "/media"),
    ) == ["/media/Movies/.part-7.mkv", "/media/Movies/.part-7.mkv", "/media/a.mkv", "/media/Movies/x.mkv",
          "/elsewhere/x.mkv", "/mediax/a.mkv"]
    got = values(spark, there("/media/Movies/a.mkv", "/media/", "Z:/Media"), there("/other/a.mkv", "/media", "Z:/Media"),
                 there("/media/a.mkv", "", "Z:"))
    assert [tuple(g) for g in got] == [
        ("local", "Z:/Media/Movies/a.mkv"), ("stream", "/other/a.mkv"), ("stream", "/media/a.mkv")]
    home = lambda n, w, o, c=None: P.originals_dir(F.lit(n), F.lit(w), F.lit(o).cast(S), F.lit(c).cast(S))
    assert values(
        spark, home("Movies", "/media/Movies", None), home("Movies", "/media/Movies", None, "/originals"),
        home("TV", "/in", "/media/TV", "/originals"), home("TV", "/in", "/media/TV", "  "), home("TV", "/in", "/TV/"),
    ) == ["/media/Movies/Originals", "/originals/Movies", "/originals/TV", "/media/Originals/TV", "/Originals/TV"]
    assert values(spark, *[P.suffix(F.lit(n)) for n in ("a.mkv", "a", ".mkv", "a.", "a.b.C", "..x")]) == [
        "mkv", "", "", "", "C", "x"]
    assert values(spark, *[P.stem(F.lit(n)) for n in ("a.mkv", "a", ".mkv", "a.b.C")]) == ["a", "a", ".mkv", "a.b"]
    assert values(spark, *[P.with_suffix(F.lit(p), F.lit("mp4")) for p in ("/a.d/b.mkv", "/a.d/b", "/a/.x")]) == [
        "/a.d/b.mp4", "/a.d/b.mp4", "/a/.x.mp4"]
    assert values(spark, *[P.is_video(F.lit(p)) for p in ("/a/b.MKV", "/a/.b.mkv", "/a/b.txt", "/a/b.m2ts")]) == [
        True, False, False, True]
    assert values(spark, *[P.in_skip_dir(F.lit(p)) for p in ("/a/Originals/b.mkv", "/a/original/b.mkv", "/.git/b")]) == [
        True, False, True]
    assert values(spark, P.parent(F.lit("/a/b")), P.parent(F.lit("/a")), P.relative_to(F.lit("/a/b/c"), F.lit("/a/")),
                  P.relative_to(F.lit("/ab/c"), F.lit("/a"))) == ["/a", "/", "b/c", None]


def test_tracks(spark):
    name = lambda c: T.language_name(F.lit(c).cast(S))
    assert values(spark, *[name(c) for c in ("ger", "es", "deu", "und", None, "end", " ENG ", "qqq", "unk")]) == [
        "German", "Spanish", "German", None, None, "English", "English", None, None]
    guess = lambda t: T.language_from_title(F.lit(t).cast(S))
    assert values(spark, guess("French Audio"), guess("Japanese and English"), guess("Malayalam"), guess("Frenchman"),
                  guess(None), guess("Scottish Gaelic")) == ["fre", "eng", "mal", None, None, "gla"]

    def title(kind, lang=None, t=None, ch=None, layout=None, **flags):
        return T.track_title(
            F.lit(kind), F.lit(lang).cast(S), F.lit(t).cast(S), F.lit(ch).cast("int"), F.lit(layout).cast(S),
            *[F.lit(flags.get(f, 0)) for f in ("comment", "descriptions", "forced", "hearing_impaired")])

    got = values(
        spark, title("audio", "eng", ch=6, layout="5.1"), title("audio", "eng", "Director Commentary", 2, comment=1),
        title("audio", "und", "French Audio", 6, "5.1(side)"), title("audio", ch=2), title("subtitle", "eng", forced=1),
        title("subtitle", "eng", hearing_impaired=1), title("audio", "jpn", "Director's Cut", 1),
        title("subtitle", "ger", "Signs SDH"), title("audio", "eng", "audio description", 7), title("audio", "fra"),
    )
    assert [tuple(g) for g in got] == [
        ("English 5.1", "eng"), ("English Stereo (Commentary)", "eng"), ("French 5.1", "fre"), (None, None),
        ("English (Forced)", "eng"), ("English (SDH)", "eng"), ("Japanese Mono", "jpn"),
        ("German (Forced, SDH)", "ger"), ("English 7ch (Audio Description)", "eng"), ("French", "fra")]
    assert values(spark, T.is_hdr(F.lit("smpte2084")), T.is_hdr(F.lit("bt709"), F.lit("bt2020")), T.is_hdr(F.lit("bt709")),
                  T.is_image(F.lit("video"), F.lit("png")), T.is_image(F.lit("video"), F.lit("h264"), F.lit(1)),
                  T.is_image(F.lit("audio"), F.lit("png"))) == [True, True, False, True, True, False]


def test_log_lines(spark):
    assert values(
        spark, L.describe_exit(F.lit(3199971767)), L.describe_exit(F.lit(1)), L.describe_exit(F.lit(-22)),
        L.clean_line(F.lit("[af#0:1 @ 0x2] Error sending")), L.clean_line(F.lit("[vf#0:0 @ 00a1] x")),
        L.clean_line(F.lit("[matroska @ 0x1] Bad")), L.clean_line(F.lit("[out#0/matroska @ 0x1] Bad")),
        L.clean_line(F.lit("plain")),
    ) == ["FFmpeg failed, invalid data in the input", "FFmpeg ended with code 1",
          "FFmpeg failed, bad argument", "audio track 2: Error sending", "video track 1: x", "Bad",
          "[out#0/matroska @ 0x1] Bad", "plain"]
    up = lambda line, d=100.0: L.progress_update(F.lit(line), F.lit(d).cast("double"))
    got = values(spark, up("out_time_ms=50000000\n"), up("out_time_ms=999000000"), up("out_time_ms=5", None),
                 up("total_size=12"), up("fps=23.5"), up("speed=1.5x"), up("speed=N/A"), up("rubbish"))
    assert [g.progress for g in got] == [50.0, 99.9] + [None] * 6
    assert got[3].size_now == 12 and got[4].fps == 23.5 and got[5].speed == 1.5 and got[6].speed is None


def test_encoder_depth(spark):
    d = lambda f8, f10, want, src: N.output_depth(
        F.lit(f8).cast("double"), F.lit(f10).cast("double"), F.lit(want), F.lit(src).cast("int"))
    assert values(
        spark, d(170, 5, "match", 10), d(170, 5, "10", 10), d(60, None, "match", 8), d(60, 55, "match", 10),
        d(269.5, 0, "match", 10), d(284.5, 279.8, "match", 10), d(60, 55, "8", 10), d(60, None, "match", 10),
        d(60, 55, "match", None),
    ) == ["8", "10", "8", "10", "8", "10", "8", "10", "8"]
    s = lambda f8, f10, depth: N.speed_at(F.lit(f8).cast("double"), F.lit(f10).cast("double"), F.lit(depth))
    assert values(spark, s(269.5, 0, "10"), s(60, None, "10"), s(60, 55, "10"), s(None, 55, "8")) == [0.0, 60.0, 55.0, 0.0]


def test_routes(spark):
    ok = R.savings_verdict(F.lit(10), F.lit(5), F.lit(0.0))
    bad = R.savings_verdict(F.lit(10), F.lit(50), F.lit(0.0))
    lad = F.array(F.lit(26), F.lit(30))
    r = lambda v, salvage=False, back=True, q=22, stuck=True, busy=False, ladder=lad: O.route_completion(
        F.lit(salvage), v, F.lit(back), ladder, F.lit(q).cast("int"), F.lit(stuck), F.lit(busy))
    got = values(spark, r(ok), r(bad), r(bad, q=26), r(bad, q=30), r(bad, q=30, stuck=False), r(bad, back=False),
                 r(bad, busy=True), r(bad, salvage=True), r(bad, q=0))
    assert [(g.route, g.next_quality) for g in got] == [
        ("done", None), ("retry_quality", 26), ("retry_quality", 30), ("salvage_copy", None), ("bloated", None),
        ("bloated", None), ("bloated", None), ("salvaged", None), ("retry_quality", 26)]
    f = lambda related, audio, busy=False: O.route_failure(F.lit(related), F.lit(audio), F.lit(busy))["route"]
    assert values(spark, f(True, "aac"), f(True, "copy"), f(False, "copy"), f(True, "aac", True)) == [
        "retry_audio_copy", "ignored", "failed", "failed"]
    assert values(spark, O.refused(F.lit("done"), False), O.refused(F.lit("running"), False),
                  O.refused(F.lit("cancelled"), True), O.refused(F.lit("failed"), True)) == [
        "done", None, "cancelled", None]

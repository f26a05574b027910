"""Operators on small tables, against plain Python where that is the clearest statement."""

import json
import random

import pytest
from pyspark.sql import functions as F

from mediacat.functions import paths
from mediacat.operators import audit, keyed, ledger, logs, nodes, originals, progress, scan, tracks
from mediacat.sources import readers, tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---- keyed ---------------------------------------------------------------


def test_slicing_does_not_change_what_came_before(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        key = 0 if rng.random() < 0.5 else rng.randint(1, 5)
        rows.append((key, i, rng.randint(0, 5000), None if rng.random() < 0.4 else rng.randint(0, 9)))
    df = frame(spark, rows, "k int, i int, t int, v int")
    want_prev, want_known = {}, {}
    last, known = {}, {}
    for k, i, t, v in sorted(rows, key=lambda r: (r[2], r[1])):
        want_prev[i], want_known[i] = last.get(k), known.get(k)
        last[k] = v
        if v is not None:
            known[k] = v
    for width in (7, 500, 100000):
        bucket = F.floor(F.col("t") / width)
        prev = keyed.previous_value(df, ["k"], ["t", "i"], "v", bucket, "p").collect()
        assert {r.i: r.p for r in prev} == want_prev
        fill = keyed.last_known(df, ["k"], ["t", "i"], "v", bucket, "p").collect()
        assert {r.i: r.p for r in fill} == want_known


@pytest.mark.parametrize("bucket", [50, 400, 10**6])
def test_sessions(spark, bucket):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.randint(0, 6000)) for _ in range(400)] + [(4, 10), (4, 50), (4, 91)]
    want = set()
    for node in {r[0] for r in rows}:
        run = []
        for t in sorted(t for n, t in rows if n == node) + [10**9]:
            if run and t - run[-1] > 40:
                want.add((node, run[0], run[-1], len(run)))
                run = []
            run.append(t)
    got = keyed.sessions(frame(spark, rows, "n int, t bigint"), "n", "t", 40, bucket).collect()
    assert {(r.n, r.session_start, r.session_end, r.events) for r in got} == want


def test_pages(spark):
    ids = [i * 37 + (i % 5) for i in range(533)]
    jobs = frame(spark, [(i, "queued" if i % 2 else "done") for i in ids], "id bigint, state string")
    active = sorted(i for i in ids if i % 2)
    page = lambda **k: [r.id for r in ledger.jobs_page(jobs, **k).orderBy("position").collect()]
    assert page(page=3, per_page=20) == active[40:60]
    assert page(page=0, per_page=0) == active[:1]
    assert page(page=999, per_page=500) == active[-(len(active) % 100 or 100):]
    done = sorted((i for i in ids if i % 2 == 0), reverse=True)
    assert page(view="done", page=2, per_page=50) == done[50:100]
    assert page(view="failed") == []
    few = [r.id for r in keyed.page_of(jobs, "id", 4, 30, True, buckets=3, fits=40).orderBy("position").collect()]
    assert few == sorted(ids)[90:120]
    assert [r.id for r in ledger.list_jobs(jobs, ["queued"], 3).collect()] == active[:3]
    assert [r.id for r in ledger.list_jobs(jobs, None, 2).collect()] == sorted(ids)[-1:-3:-1]


# ---- ledger --------------------------------------------------------------

JOBS = "id bigint, path string, state string, library_id bigint, size_before bigint"


def test_requeue(spark):
    jobs = frame(
        spark,
        [(1, "/a", "failed", 1, 9), (2, "/a", "failed", 1, 9), (3, "/b", "failed", 1, 9), (4, "/b", "queued", 2, 9),
         (5, "/c", "failed", None, 9), (6, "/d", "done", 1, 9)],
        JOBS,
    ).withColumn("error", F.lit("x")).withColumn("progress", F.lit(5.0))
    plan = ledger.requeue(jobs, "failed")
    assert {r.id: r.verdict for r in plan.collect()} == {1: "skipped", 2: "requeued", 3: "skipped", 5: "requeued"}
    after = {r.id: r for r in ledger.apply_requeue(jobs, plan).collect()}
    assert after[2].state == "queued" and after[2].error is None and after[2].progress == 0
    assert after[1].state == "failed" and after[1].error == "x" and len(after) == 6
    lone = ledger.requeue(jobs, "failed", single=True)
    assert {r.id for r in ledger.apply_requeue(jobs, lone).collect()} == {2, 4, 5, 6}
    assert ledger.requeue(jobs, "failed", library_id=1).count() == 3
    with pytest.raises(ValueError):
        ledger.requeue(jobs, "active")
    # One active job per path afterwards.
    act = ledger.apply_requeue(jobs, plan).where(F.col("state") == "queued").groupBy("path").count()
    assert act.where("count > 1").count() == 0


def test_enqueue_and_views(spark):
    jobs = frame(spark, [(1, "/a", "running", 1, 9), (2, "/b", "done", None, 9), (3, "/z", "ignored", None, 5)], JOBS)
    batch = frame(spark, [("/a", 1, 5), ("/b", 2, 6), ("/b", 1, 7), ("/c", 1, 8)], "path string, at int, size int")
    assert {(r.path, r.size) for r in ledger.enqueue(batch, jobs, ["at"]).collect()} == {("/b", 7), ("/c", 8)}
    rep = ledger.enqueue_report(batch, jobs).first()
    assert (rep.added, rep.skipped) == (2, 2)
    counts = {r["view"]: r.jobs for r in ledger.view_counts(jobs).collect()}
    assert counts == {"active": 1, "failed": 0, "done": 1, "bloated": 0, "cancelled": 0, "ignored": 1}
    assert sum(counts.values()) == jobs.count()
    assert {r["view"]: r.jobs for r in ledger.view_counts(jobs, 1).collect()}["done"] == 0
    assert {r.library_id for r in ledger.counts_by_library(jobs).collect()} == {1, None}
    assert ledger.has_job_for(batch, jobs).count() == 3
    empty = ledger.job_stats(jobs.where("false").withColumn("size_after", F.lit(1))).first()
    assert (empty.done, empty.before) == (0, 0)
    late = jobs.withColumn("lease_expires_s", F.when(F.col("id") == 1, 99)).withColumn("progress", F.lit(7.0))
    back = {r.id: r for r in ledger.requeue_expired(late, F.lit(100)).collect()}
    assert back[1].state == "queued" and back[1].progress == 0 and back[2].state == "done"
    assert {r.state for r in ledger.requeue_expired(late, F.lit(99)).collect()} == {"running", "done", "ignored"}


# ---- scan ----------------------------------------------------------------


def test_owner_by_containment(spark):
    libs = frame(
        spark,
        [(1, "films", "/media/films/"), (2, "all", "/media"), (3, "kids", "/media/films/kids"), (4, "same", "/media/films")],
        "library_id int, name string, watch_path string",
    )
    files = ["/media/films/a.mkv", "/media/films/kids/b/c.mkv", "/media/x/y.mkv", "/mediax/films/a.mkv", "/media/filmsx/a.mkv"]
    for order, want in (("name", [2, 2, 2, None, 2]), ("library_id", [1, 1, 2, None, 2])):
        got = scan.owning_library(frame(spark, [(f,) for f in files], "path string"), libs, order).collect()
        assert [{r.path: r.library_id for r in got}[f] for f in files] == want
    plan = scan.owning_library(frame(spark, [("/a/b",)], "path string"), libs)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_handled_stuck_and_stable(spark):
    files = frame(spark, [("/a", 10, 100.0), ("/b", 10, 100.0), ("/c", 10, 100.0)], "path string, size bigint, mtime_s double")
    seen = frame(spark, [("/a", 100.9), ("/b", 101.0), ("/x", None)], "path string, mtime_s double")
    assert {r.path for r in scan.not_processed(files, seen).collect()} == {"/b", "/c"}
    jobs = frame(
        spark,
        [(1, "/a", "failed", 1, 10), (2, "/a", "bloated", 1, 11), (3, "/b", "ignored", 1, 10), (4, "/c", "done", 1, 10)], JOBS)
    assert {r.path for r in scan.not_stuck(files, jobs).collect()} == {"/a", "/c"}
    assert [(r.path, r.job_id) for r in scan.stuck_files(files, jobs).collect()] == [("/b", 3)]
    scans = frame(spark, [("/a", 1, 5), ("/a", 2, 6), ("/a", 3, 6), ("/b", 1, 5), ("/c", 1, 5), ("/c", 2, 7)],
                  "path string, scan_s int, size bigint")
    assert {r.path: r.stable for r in scan.size_stability(scans, ["scan_s"]).collect()} == {
        "/a": True, "/b": False, "/c": False}


def test_conflicts_and_filing(spark):
    files = frame(spark, [("/in/a", "/out/a", 1), ("/in/b", "/out/b", 1), ("/in/c", "/out/b", 1), ("/out/d", "/out/d", 1)],
                  "path string, destination string, size bigint").withColumn("library_id", F.lit(1))
    there = frame(spark, [("/out/a",), ("/out/d",)], "path string")
    marked = scan.destination_conflicts(files, there)
    assert {r.path: r.conflict for r in marked.collect()} == {
        "/in/a": "exists", "/in/b": "shared", "/in/c": "shared", "/out/d": None}
    jobs = frame(spark, [(1, "/in/b", "failed", 1, 1), (2, "/out/d", "done", 1, 1)], JOBS)
    rows = {r.path: r for r in scan.filed_rows(marked, jobs).collect()}
    assert {p: r.state for p, r in rows.items()} == {"/in/a": "failed", "/in/c": "failed", "/out/d": "done"}
    assert rows["/out/d"].final_path == "/out/d" and "/out/a" in rows["/in/a"].error


# ---- originals -----------------------------------------------------------


def test_finding_archived_sources(spark):
    libs = frame(
        spark,
        [(1, "films", "/in", "/out/films", "archive", None), (2, "tv", "/tv", None, "archive", "/keep"),
         (3, "del", "/d", None, "delete", None)],
        "library_id bigint, name string, watch_path string, output_path string, original_action string, originals_path string",
    )
    jobs = frame(
        spark,
        [(1, "/in/a/x.mkv", 1), (2, "/in/a/y.mkv", 1), (3, "/tv/z.mkv", 2), (4, "/d/w.mkv", 3), (5, "/d/v.mkv", 3), (6, "/q.mkv", None)],
        "id bigint, path string, library_id bigint",
    )
    held = frame(spark, [("/arch/x.mkv", 1), ("/gone/y.mkv", 2), ("/arch/v.mkv", 5)], "archived_path string, job_id bigint")
    inv = [("/arch/x.mkv",), ("/out/Originals/films/a/y.mkv",), ("/keep/tv/old/deep/z.mkv",), ("/d/Originals/w.mkv",),
           ("/arch/v.mkv",), ("/out/Originals/films/q.mkv",)]
    got = originals.archived_source(jobs, libs, held, frame(spark, inv, "path string")).collect()
    assert {r.id: (r.archived, r.found_by) for r in got} == {
        1: ("/arch/x.mkv", "ledger"), 2: ("/out/Originals/films/a/y.mkv", "expected"),
        3: ("/keep/tv/old/deep/z.mkv", "searched"), 4: (None, None), 5: ("/arch/v.mkv", "ledger"), 6: (None, None)}


def test_sweep(spark):
    held = frame(
        spark,
        [("/o/1", "/f/1", 0), ("/o/2", "/f/2", 0), ("/o/3", "/f/3", 0), ("/o/4", None, 0), ("/o/5", "/f/5", 900)],
        "archived_path string, final_path string, archived_s bigint",
    )
    inv = frame(spark, [("/o/1", 7), ("/f/1", 3), ("/o/2", 7), ("/f/2", 0), ("/f/3", 3), ("/o/4", 7), ("/o/5", 7)], "path string, size bigint")
    got = originals.sweep_plan(held, inv, F.lit(1000), 100 / 86400).collect()
    assert {r.archived_path: (r.verdict, r.freed, r.replacement_ok) for r in got} == {
        "/o/1": ("delete", 7, True), "/o/2": ("keep", 0, True), "/o/3": ("forget", 0, True), "/o/4": ("keep", 0, False)}
    ok = originals.replacement_check(held, inv)
    assert {r.archived_path for r in ok.where("replacement_ok").collect()} == {"/o/1", "/o/2", "/o/3"}


# ---- nodes ---------------------------------------------------------------

NODES = (
    "node_id int, encoders array<string>, mounts array<struct<server:string,local:string>>, "
    "slots int, max_jobs int, enabled boolean"
)


def test_eligibility_equals_trying_every_pair(spark):
    rng = random.Random(11)
    roots = ["/m", "/m/a", "/m/a/b/", "/n", "", "\\m\\c"]
    encoders = ["hevc_nvenc", "libx265", "libx264", "av1_qsv", "h264_amf"]
    fleet = [
        (n, rng.sample(encoders, rng.randint(0, 3)), [(r, f"/local{n}") for r in rng.sample(roots, rng.randint(0, 4))],
         rng.choice([None, 0, 1, 2]), rng.choice([1, 2]), rng.random() < 0.8)
        for n in range(12)
    ]
    jobs = [
        (i, rng.choice(["/m/x.mkv", "/m/a/x.mkv", "/m/a/b/c/x.mkv", "/n/x.mkv", "/mm/x.mkv", "/m/c/d/x.mkv"]),
         rng.choice(["hevc", "h264", "av1", "copy", "vp9"]), rng.choice([None, 0, 1000, 536870912, 10**10]), "queued")
        for i in range(1, 200)
    ]
    family = {"hevc": {"hevc_nvenc", "libx265"}, "h264": {"libx264", "h264_amf"}, "av1": {"av1_qsv"}, "vp9": set()}

    def can(node, job):
        _, enc, mounts, *_ = node
        _, path, codec, size, _ = job
        if codec != "copy" and not family[codec] & set(enc):
            return None
        for server, local in mounts:
            s = server.replace("\\", "/").rstrip("/")
            if s and path.startswith(s + "/"):
                return "local"
        return "stream" if codec != "copy" and not (size and size < 536870912) else None

    nd = frame(spark, fleet, NODES)
    jb = frame(spark, jobs, "id bigint, path string, codec string, size_before bigint, state string")
    got = {r.id: r for r in nodes.eligible_nodes(jb, nd).collect()}
    for job in jobs:
        fit = [(n[0], can(n, job)) for n in fleet if can(n, job)]
        r = got[job[0]]
        assert r.nodes == len(fit) and r.first_node == min((n for n, _ in fit), default=None), job
        assert r.local_nodes == sum(1 for _, how in fit if how == "local")
    active = frame(spark, [(n, n % 3) for n in range(12)], "node_id int, active bigint")
    want = {}
    for n in fleet:
        slots = n[3] if n[3] is not None else n[4]
        if n[5] and slots >= 1 and n[0] % 3 < slots:
            fit = [(j[0], can(n, j)) for j in jobs if can(n, j)]
            if fit:
                want[n[0]] = fit[0]
    nxt = nodes.next_job_per_node(jb, nd, active).collect()
    assert {r.node_id: (r.job_id, r.transport) for r in nxt} == want


def test_encoder_choice(spark):
    bench = frame(
        spark,
        [(1, "hevc", "hevc_videotoolbox", 170.0, 5.0), (1, "hevc", "libx265", 60.0, 55.0),
         (2, "hevc", "hevc_amf", 50.0, 49.0), (2, "hevc", "libx265", 65.0, 60.0),
         (3, "hevc", "hevc_amf", 40.0, 40.0), (3, "hevc", "libx265", 65.0, 60.0),
         (4, "h264", "libx264", None, None), (4, "h264", "h264_amf", 0.0, 0.0)],
        "node_id int, family string, encoder string, fps8 double, fps10 double",
    )
    pick = lambda want, depth: {
        r.node_id: r.encoder for r in nodes.best_encoder(bench, F.lit(want), F.lit(depth)).collect()}
    assert pick("match", 8) == {1: "hevc_videotoolbox", 2: "hevc_amf", 3: "libx265", 4: "h264_amf"}
    assert pick("10", 10)[1] == "libx265" and pick("match", 10)[1] == "hevc_videotoolbox"
    assert {r.encoder for r in nodes.ten_bit_cliff(bench).collect()} == {"hevc_videotoolbox"}
    maps = frame(
        spark, [(1, {"a": 10.0, "b": 5.0}, {"a": 1.0}, {"a": "SOFTWARE fallback, quality", "b": "default"})],
        "node_id int, benchmarks map<string,double>, benchmarks_10bit map<string,double>, recipes map<string,string>")
    assert {(r.encoder, r.fps8, r.fps10) for r in nodes.benchmarks_long(maps).collect()} == {("a", 10.0, 1.0), ("b", 5.0, None)}
    assert [r.encoder for r in nodes.software_fallback(maps).collect()] == ["a"]


def test_work_windows(spark):
    w = frame(
        spark, [(1, [4], "22:00", "06:00"), (2, [], "12:00", "13:00"), (3, [0], "09:00", "09:00"), (4, [6], "x", "00:30")],
        "window_id int, days array<int>, start string, end string")
    ranges = nodes.split_windows(w)
    when = {  # 2024-01-05 is a Friday
        "2024-01-05 22:00:00": True, "2024-01-06 05:59:59": True, "2024-01-06 06:00:00": False, "2024-01-05 05:00:00": False,
        "2024-01-03 12:30:00": True, "2024-01-03 13:00:00": False, "2024-01-01 09:00:00": False, "2024-01-07 00:10:00": True,
    }
    ev = frame(spark, [(t,) for t in when], "t string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    assert {r.t: r.open for r in nodes.in_work_window(ev, ranges).collect()} == when
    assert {r.t: r.open for r in nodes.work_allowed(ev, w).collect()} == when
    assert nodes.work_allowed(ev, w.where("false")).where("open").count() == len(when)
    assert nodes.work_allowed(ev, w, enabled=False).where("open").count() == len(when)


# ---- tracks --------------------------------------------------------------


def test_track_plan(spark):
    rows = [
        (1, 0, "video", "mjpeg", None, None, None, 0, 0), (1, 1, "video", "h264", None, None, None, 0, 0),
        (1, 2, "audio", "aac", "jpn", None, 2, 0, 0), (1, 3, "audio", "aac", "eng", "Commentary", 6, 0, 0),
        (1, 4, "audio", "aac", "ENG", None, 2, 0, 0), (1, 5, "audio", "ac3", "eng", None, 6, 0, 0),
        (1, 6, "subtitle", "subrip", "eng", None, None, 0, 0), (1, 7, "subtitle", "subrip", "ger", "Signs", None, 0, 0),
        (1, 8, "subtitle", "eia_608", "eng", None, None, 1, 0), (1, 9, "attachment", "ttf", None, None, None, 0, 0),
        (2, 0, "video", "hevc", None, None, None, 0, 1), (2, 1, "audio", "aac", "jpn", None, 2, 0, 0),
    ]
    s = frame(spark, rows, "file_id int, idx int, codec_type string, codec_name string, language string, title string, "
                           "channels int, forced int, attached_pic int")
    spec = F.struct(
        F.array(F.lit("eng")).alias("audio_languages"), F.lit(True).alias("remove_other_audio"),
        F.lit("languages").alias("subtitle_mode"), F.array(F.lit("eng")).alias("subtitle_languages"),
        F.lit(True).alias("keep_forced_subs"), F.lit("mkv").alias("container"), F.lit(True).alias("remove_images"),
        F.lit(False).alias("default_first_subtitle"))
    plan = tracks.track_plan(s.withColumn("spec", spec))
    got = {(r.file_id, r.idx): r for r in plan.collect()}
    assert len(got) == len(rows)
    assert {k: r.drop_reason for k, r in got.items() if not r.kept} == {
        (1, 0): "image", (1, 2): "other_language", (1, 8): "caption", (1, 9): "not_mapped", (2, 0): "image"}
    order = [r.idx for r in sorted((r for r in got.values() if r.kept and r.file_id == 1 and r.codec_type == "audio"),
                                   key=lambda r: r.position)]
    assert order == [5, 4, 3] and got[(1, 5)].is_default and not got[(1, 4)].is_default
    # Nothing wanted in file 2, so its only track stays.
    assert got[(2, 1)].kept and got[(2, 1)].position == 0
    assert got[(1, 7)].position == 0 and got[(1, 7)].is_forced and got[(1, 6)].position == 1
    note = {r.file_id: r for r in tracks.track_notes(plan).collect()}
    assert note[1].dropped_audio == "jpn" and note[1].captions == 1 and note[1].images == 1
    assert [(r.file_id, r.idx) for r in tracks.primary_video(s).collect()] == [(1, 1)]


# ---- logs, settings, events ----------------------------------------------


def test_failure_text(spark):
    logs_ = {
        1: ["[out#0/matroska @ 0x1] Could not write header (incorrect codec parameters ?): Invalid data found when processing input",
            "[af#0:1 @ 0x2] Error sending frames to consumers: Invalid data found"],
        2: ["Error opening output files: nothing", "No such file here", "Error opening output files: again"],
        3: ["", "  just chatter  "],
        4: ["Invalid a", "Invalid a", "Invalid b", "Invalid c", "Task finished with error code: -22 (audio)"],
    }
    rows = [(j, n, line, 1) for j, ls in logs_.items() for n, line in enumerate(ls)]
    lines = frame(spark, rows, "job_id int, line_no int, line string, returncode bigint")
    got = {r.job_id: r.message for r in logs.failure_messages(logs.failure_causes(lines)).collect()}
    assert got[1].startswith("FFmpeg ended with code 1: audio track 2: Error sending") and "copying the audio unchanged" in got[1]
    assert got[2] == "FFmpeg ended with code 1: Error opening output files: nothing — No such file here"
    assert got[3] == "FFmpeg ended with code 1: just chatter"
    assert got[4] == "FFmpeg ended with code 1: Invalid a — Invalid b"
    many = frame(spark, [(1, n, f"error {n}", 1) for n in range(400)], "job_id int, line_no int, line string, returncode bigint")
    assert logs.failure_causes(many).first().cause_1 == "error 0"
    assert logs.failure_causes(logs.log_lines(many, tail=300)).first().cause_1 == "error 100"


def test_settings(spark):
    p = frame(spark, [("", " ", None), ("160k", "aac", "hevc")], "audio_bitrate string, audio_codec string, video_codec string")
    r = audit.repair(p).orderBy("repaired").collect()
    assert [x.repaired for x in r] == [False, True]
    assert (r[1].audio_bitrate, r[1].audio_codec, r[1].video_codec) == ("160k", "aac", "hevc")
    from mediacat.schemas import PROFILE

    blank = frame(spark, [tuple(None for _ in PROFILE)], PROFILE)
    s = blank.select(audit.resolve_profile(F.col).alias("s")).first().s
    assert (s.codec, s.audio, s.container, s.audio_bitrate, s.quality, s.audio_languages) == (
        "hevc", "aac", "mkv", "160k", 22, ["eng"])
    assert s.keep_forced_subs and not s.remove_other_audio and len(s) == 22


def test_refusals_and_movement(spark):
    rows = [(1, 10, "progress", 5.0), (2, 20, "progress", 5.0), (3, 30, "progress", 4.0), (4, 40, "progress", 4.5),
            (5, 50, "complete", 0.0), (6, 60, "progress", 9.0), (7, 70, "started", 0.0), (8, 80, "progress", 1.0)]
    ev = frame(spark, [(e, 1, t, k, p, e * 100) for e, t, k, p in rows],
               "event_id bigint, job_id bigint, t bigint, kind string, progress double, size_now bigint")
    ev = ev.withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz"))
    for slice_s in (15, 1000):
        j = {r.event_id: r for r in progress.judged(ev, slice_s).collect()}
        assert [i for i, r in sorted(j.items()) if r.accepted] == [1, 2, 3, 4, 8]
        assert [i for i, r in sorted(j.items()) if r.moved] == [1, 4, 8]
    last = progress.latest_progress(ev).first()
    assert (last.state, last.progress, last.progress_s, last.refused, last.size_now) == ("running", 1.0, 80, 1, 800)


# ---- sources -------------------------------------------------------------


def test_listing(spark, tmp_path):
    for name in ("films/a.MKV", "films/Originals/b.mkv", "films/sub/c.mp4", "films/notes.txt", "films/.git/d.mkv"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"12345")
    df = readers.media_listing(spark, f"{tmp_path}/films")
    assert {paths_[len(str(tmp_path)):] for paths_ in (r.path for r in df.collect())} == {"/films/a.MKV", "/films/sub/c.mp4"}
    assert {r.size for r in df.collect()} == {5}
    assert "content" not in df._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert readers.name_samples(df, 1).count() == 1
    q = readers.watched_folder(spark, f"{tmp_path}/films").writeStream.format("memory").queryName("watched").trigger(
        availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination(60)
    assert spark.table("watched").count() == 2


def test_probe_documents(spark):
    doc = {
        "format": {"size": "1000", "duration": "60.5", "bit_rate": "1000000"},
        "streams": [
            {"index": 0, "codec_type": "video", "codec_name": "mjpeg", "disposition": {"attached_pic": 1}},
            {"index": 1, "codec_type": "video", "codec_name": "hevc", "width": 1920, "height": 1080, "pix_fmt": "yuv420p10le"},
            {"index": 2, "codec_type": "audio", "codec_name": "ac3", "channels": 6, "tags": {"language": "eng"}},
        ],
    }
    docs = frame(spark, [("/a", json.dumps(doc)), ("/b", "{{{"), ("/c", None)], "path string, document string")
    probed = readers.probe_documents(docs)
    got = {r.path: r for r in readers.probe_summary(probed).collect()}
    a = got["/a"]
    assert (a.size, a.duration_s, a.video_codec, a.bit_depth, a.height, a.video_bitrate, a.audio_codecs) == (
        1000, 60.5, "hevc", 10, 1080, 808000, ["ac3"])
    assert got["/b"].size is None and got["/b"].video_codec is None and got["/c"].audio_codecs is None
    s = {r.idx: r for r in readers.probe_streams(probed).collect()}
    assert s[2].language == "eng" and s[0].attached_pic == 1 and len(s) == 3


def test_state_tables(spark, tmp_path):
    t = frame(spark, [("b", '["x"]', '{"q": 1.5}'), ("a", None, "rubbish")], "name string, encoders string, benchmarks string")
    t.write.parquet(f"{tmp_path}/nodes")
    rows = readers.state_table(spark, f"{tmp_path}/nodes", "name").collect()
    assert [r.name for r in rows] == ["a", "b"]
    assert rows[0].encoders == [] and (rows[0].benchmarks or {}) == {}
    assert rows[1].encoders == ["x"] and rows[1].benchmarks == {"q": 1.5}
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "17.log").write_text("one\n\n  two \n")
    assert {(r.job_id, r.line) for r in readers.log_text(spark, f"{tmp_path}/logs").collect()} == {(17, "one"), (17, "two")}


def test_upserts(spark, tmp_path):
    old = frame(spark, [(1, "a", 5), (2, "b", None)], "id int, name string, slots int")
    new = frame(spark, [(1, 1, "A", 9), (2, 1, "x", 3), (2, 2, "y", 4), (3, 1, "c", 1)], "id int, at int, name string, slots int")
    got = {r.id: (r.name, r.slots) for r in tables.upsert(old, new, ["id"], ["at"], kept=["slots"]).collect()}
    assert got == {1: ("A", 5), 2: ("y", 4), 3: ("c", 1)}
    assert tables.delete_keys(old, new.where("id = 1"), ["id"]).count() == 1
    tables.write_version(old, f"{tmp_path}/t", 0)
    assert spark.read.parquet(f"{tmp_path}/t/v=0").count() == 2


def test_keyed_table_equals_one_upsert_after_another(spark, tmp_path):
    import random

    rng, schema = random.Random(6), "id bigint, at bigint, name string, slots int"
    table = tables.KeyedTable(f"{tmp_path}/t", schema, ["id"], ["at"], ["slots"], bucket_rows=60)
    assert table.read(spark).count() == 0
    want, written = {}, 0
    for n in range(9):
        ids = range(n * 40, n * 40 + 40) if n < 5 else rng.sample(range(200), 12)
        rows = [(i, at, f"n{n}.{at}", rng.choice([None, n])) for i in ids for at in range(rng.randrange(1, 3))]
        batch = frame(spark, rows, schema)
        for _ in range(1 + (n == 6)):  # a batch that is run again
            table.upsert(batch, n)
        for i in {r[0] for r in rows}:
            _, at, name, slots = max(r for r in rows if r[0] == i)
            want[i] = (at, name, want[i][2] if i in want and want[i][2] is not None else slots)
        written += len(set(ids))
        got = {r.id: (r.at, r.name, r.slots) for r in table.read(spark).collect()}
        assert got == want, n
    done, credit, level, runs = table.runs(spark)
    assert done == 9 and level >= 2 and len({r.level for r in runs}) >= 1
    # Rewritten rows and what is left of the credit are what the batches earned.
    assert 0 <= credit <= 4 * written
    assert any(r.low < r.high for r in runs) and all(len({r.high for r in family}) < 9 for family in tables.families(runs))
    empty = frame(spark, [], schema)
    table.upsert(empty, 9)
    assert table.read(spark).count() == len(want)


def test_a_batch_writes_its_own_rows_and_what_its_credit_allows(spark, tmp_path):
    import os

    base, schema = str(tmp_path / "t"), "id bigint, at bigint, name string"
    table = tables.KeyedTable(base, schema, ["id"], ["at"], bucket_rows=100, merge_rows=2)

    def rows():
        """Rows in every file below the table, by file."""
        import pyarrow.parquet as pq

        return {f"{d}/{f}": pq.read_metadata(f"{d}/{f}").num_rows for d, _, fs in os.walk(f"{base}/runs") for f in fs if f.endswith(".parquet")}

    table.upsert(frame(spark, [(i, 1, "a") for i in range(2000)], schema), 0)
    before, wrote, own = rows(), 0, 0
    for n in range(1, 6):
        table.upsert(frame(spark, [(i * 7 + n, 1, "b") for i in range(20)], schema), n)
        now = rows()
        wrote += sum(r for f, r in now.items() if f not in before)
        own += 20
        before = now
    assert wrote <= 3 * own  # the 2000 rows were never touched
    assert table.read(spark).where("name = 'b'").count() == len({i * 7 + n for n in range(1, 6) for i in range(20)})
    lists = [x for x in os.listdir(f"{base}/lists") if x.startswith("v=")]
    assert len(lists) <= 3


def test_merges_take_the_newest_runs():
    def run(batch, rows, level=1, bucket=0):
        return tables.Run(batch, batch, level, bucket, rows, f"{batch}.{level}.{bucket}")

    a, b, c, d = run(1, 100), run(2, 30), run(3, 20), run(4, 15)
    assert tables.newest_to_merge([a, b, c, d]) == []
    assert {r.high for r in tables.newest_to_merge([a, b, run(3, 20), run(4, 25)])} == {2, 3, 4}
    assert tables.newest_to_merge([a]) == []
    split = [run(1, 50, 1, 1), run(2, 10, 2, 1), run(2, 10, 2, 3), run(3, 9, 2, 2)]
    assert sorted(len(f) for f in tables.families(split)) == [1, 3]


def test_failed_jobs_all_have_a_row(spark):
    lines = [(1, i, "frame ok", 1) for i in range(2, 402)] + [(1, 1, "No space left on device", 1), (2, 1, "", 1), (2, 2, "  ", 1)]
    failed = frame(spark, [(1, 1), (2, 1), (3, 7)], "job_id int, returncode bigint")
    got = logs.failure_causes(frame(spark, lines, "job_id int, line_no int, line string, returncode bigint"), failed)
    rows = {r.job_id: r for r in got.collect()}
    assert rows[1].cause_1 == "No space left on device" and rows[1].last_line == "frame ok"
    assert rows[2].cause_1 is None and rows[2].last_line is None and rows[3].returncode == 7
    texts = {r.job_id: r.message for r in logs.failure_messages(got).collect()}
    assert texts[2].endswith("no output") and texts[3].endswith("no output") and set(texts) == {1, 2, 3}


def test_filing_rules(spark):
    """Only where matching files are left alone and there is an output folder; the first of several wins."""
    from pyspark.sql.types import Row

    def file(path, skip_matching=True, out="/out", action="skip"):
        naming = Row(enabled=False, scheme="plex", skip_uncertain=True, folders=True)
        return Row(path=path, size=5, library_id=1, skip_matching=skip_matching, skip=Row(code=None), plan=Row(action=action),
                   library=Row(output_path=out, watch_path="/in", mirror_folders=False, naming=naming))

    rows = [file("/in/b/x.mkv"), file("/in/a/x.mkv"), file("/in/y.mkv", skip_matching=False), file("/in/z.mkv", out=""),
            file("/in/q.mkv", out=None), file("/out/w.mkv"), file("/in/v.mkv", action="remux"), file("/in/t.mkv")]
    schema = ("path string, size bigint, library_id bigint, skip_matching boolean, skip struct<code:string>, plan struct<action:string>, "
              "library struct<output_path:string,watch_path:string,mirror_folders:boolean,naming:struct<enabled:boolean,scheme:string,skip_uncertain:boolean,folders:boolean>>")
    ready = scan.files_to_file(spark.createDataFrame(rows, schema))
    marked = scan.destination_conflicts(ready, frame(spark, [("/out/t.mkv",)], "path string"), first_wins=True)
    got = {r.path: r.conflict for r in marked.collect()}
    assert got == {"/in/a/x.mkv": None, "/in/b/x.mkv": "shared", "/in/t.mkv": "exists"}


def test_empty_tables(spark):
    libraries = frame(spark, [], "library_id bigint, name string, watch_path string, output_path string, original_action string, originals_path string")
    files = frame(spark, [("/in/a.mkv", 1)], "path string, size bigint")
    assert [r.library_id for r in scan.owning_library(files, libraries).collect()] == [None]
    jobs = frame(spark, [(1, "/in/a.mkv", 3)], "id bigint, path string, library_id bigint")
    ledger_rows = frame(spark, [], "job_id bigint, archived_path string")
    found = originals.archived_source(jobs, libraries, ledger_rows, files)
    assert [(r.archived, r.found_by) for r in found.collect()] == [(None, None)]


def test_pages_of_clustered_ids(spark):
    ids = [10**15 + i for i in range(300)] + list(range(700)) + [5 * 10**17]
    df = frame(spark, [(i,) for i in ids], "id bigint").repartition(5)
    for ascending in (True, False):
        order = sorted(ids, reverse=not ascending)
        for page in (1, 8, 37, 51, 9999):
            rows = keyed.page_of(df, "id", page, 20, ascending, buckets=16, fits=25).orderBy("position").collect()
            start = (min(page, 51) - 1) * 20
            assert [r.id for r in rows] == order[start : start + 20] and rows[0].position == start + 1


def test_path_depths(spark):
    r = spark.range(1).select(paths.ancestor_at(F.lit("/a/b/c"), 2).alias("a"), paths.ancestor_at(F.lit("/a"), 2).alias("b"),
                              paths.ancestor_at(F.lit("/a/b"), 3).alias("c")).first()
    assert (r.a, r.b, r.c) == ("/a", None, None)


def test_a_first_batch_is_written_by_several_tasks(spark, tmp_path):
    """Its rows are one bucket; a task must not hold all of them."""
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "64k")
    try:
        table = tables.KeyedTable(f"{tmp_path}/t", "id bigint, at bigint, note string", ["id"], ["at"])
        table.upsert(spark.range(40_000).selectExpr("id", "id as at", "sha2(cast(id as string), 256) as note"), 0)
    finally:
        spark.conf.set(size, before)
    *_, (run,) = table.runs(spark)
    assert (run.bucket, run.rows) == (0, 40_000)
    assert len(spark.read.parquet(run.path).inputFiles()) > 4
    assert table.read(spark).distinct().count() == 40_000


def test_size_stability_sorts_once_after_the_shuffle(spark):
    scans = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 6), ("b", 1, None), ("c", 2, 7), ("c", 2, 7)], "path string, scan_s int, size bigint")
    got = scan.size_stability(scans, ["scan_s"])
    assert {(r.path, r.size, r.stable) for r in got.collect()} == {("a", 6, False), ("b", None, False), ("c", 7, True)}
    plan = scan.size_stability(scans, ["scan_s"])._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Sort [") == 2 and "WindowGroupLimit" in plan

"""Every registered query against its SQL, and the six example files end to end."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mediacat.functions import rules
from mediacat.operators import scan
from mediacat.plans.queries import QUERIES
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
NO_SQL = {"title_matches", "enriched_names"}


LARGER = {"sweep_plan": "/root/testdata/sf0.01", "overrun_jobs": "/root/testdata/sf0.01"}  # empty on less


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    build, sql, folder = QUERIES[name], entry.oracle_sql().get(name), LARGER.get(name, FOLDER)
    if sql is None:
        assert name in NO_SQL
    else:
        assert difference(spark, connect(folder), folder, name, build, sql) is None
    assert not build(spark, folder).isEmpty()


def test_every_outcome_occurs(spark):
    """The tables hold a case for each stage, code and verdict, so that equal results mean something."""
    folder = "/root/testdata/sf0.01"

    def seen(name, column):
        return {r[0] for r in QUERIES[name](spark, folder).select(column).distinct().collect()}

    assert seen("scan_funnel", "stage") == {
        "no_library", "paused", "not_video", "skipped_folder", "arriving", "handled", "skip_rule", "unreadable",
        "already_right", "wanted",
    }
    assert "only_name_contains" in seen("skip_reasons", "code")
    assert "unknown" in seen("savings_verdicts", "code")
    assert seen("filed_rows", "state") == {"done", "failed"}
    assert QUERIES["unprocessed_files"](spark, folder).count() < QUERIES["inventory_latest"](spark, folder).count()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["library_id", "action", "files", "bytes"] and df.count() > 0


def test_no_pair_products(spark):
    """No query compares everything with everything."""
    for name, build in QUERIES.items():
        plan = build(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Cross" not in plan, name


def test_the_six_example_files(spark):
    """One file per decision: audio only, skip, repackage, video only, full, filtered."""
    rows = [
        ("/in/a.mkv", "hevc", ["ac3"], 1000000, "audio_only"), ("/in/b.mkv", "hevc", ["aac"], 1000000, "skip"),
        ("/in/c.mp4", "hevc", ["aac"], 1000000, "remux"), ("/in/d.mkv", "h264", ["aac"], 1000000, "video_only"),
        ("/in/e.avi", "mpeg4", ["mp3"], 1000000, "full"), ("/in/f.sample.mkv", "h264", ["aac"], 1000000, None),
        ("/in/g.mkv", "hevc", ["aac"], 9000000, "video_only"),
    ]
    files = spark.createDataFrame(rows, "path string, video_codec string, audio_codecs array<string>, video_bitrate bigint, want string")
    files = files.withColumns({"size": F.lit(10**9), "duration_s": F.lit(3600), "height": F.lit(1080)})
    texts = lambda *t: F.array(*[F.lit(x) for x in t]).cast("array<string>")
    none = F.lit(None).cast("double")
    filters = F.struct(
        texts().alias("skip_extensions"), texts().alias("only_extensions"), texts("sample").alias("skip_name_contains"),
        texts().alias("only_name_contains"), texts().alias("skip_video_codecs"),
        *[none.alias(n) for n in ("min_size_mb", "max_size_mb", "min_minutes", "max_minutes", "min_bitrate_kbps", "max_bitrate_kbps")],
        F.struct(F.lit(True).alias("enabled"), *[none.alias(t) for t in ("sd", "hd", "fullhd", "uhd")]).alias("bitrate_ceiling"),
    )
    spec = F.struct(F.lit("hevc").alias("codec"), F.lit("aac").alias("audio"), F.lit("mkv").alias("container"))
    got = scan.decide(files.withColumns({"filters": rules.tidy_filters(filters), "spec": spec})).collect()
    for r in got:
        assert (r.plan.action if r.skip is None else None) == r.want, r.path
    assert {r.skip.reason for r in got if r.skip} == {"name has the text: sample"}


def test_scan_report_sorts_only_sightings_of_young_files_and_own_files_of_jobs(spark):
    """The window of `size_stability` reads what is not settled, and the ledger's files are cut before their aggregate."""
    from mediacat.plans.queries import QUERIES
    from mediacat.plans.views import Views

    folder = "/root/testdata/sf0.001"
    v = Views(spark, folder)
    orders = v.table("orders")
    plan = QUERIES["scan_report"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("WindowGroupLimit" if "WindowGroupLimit" in plan else "Window") :]
    filters = [line for line in window.splitlines() if "Filter" in line and "1699990000" in line]
    assert filters and "scalar-subquery" in filters[0]
    jobs = v.jobs()._jdf.queryExecution().optimizedPlan().toString()
    below = jobs[jobs.index("Aggregate") :]
    assert "% 16) = 1" in below
    assert v.jobs().count() == orders.count() and v.jobs().where("id % 2 = 0 and size_before is null").count() == 0

"""The folder source: names, depths, and one listing a trigger."""

from mediacat.sources import folders
from mediacat.streaming import jobs as S


def tree(base):
    for name in ("_top.mkv", "a/one.MP4", "a/_two.mkv", "a/b/c/d/deep.avi", "_x/y/three.mov", "a/.hidden.mkv", "a/note.txt", "a/b/@eaDir/no.mkv"):
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * len(name))
    return {"_top.mkv", "a/one.MP4", "a/_two.mkv", "a/b/c/d/deep.avi", "_x/y/three.mov"}


def test_listing_keeps_names_with_underscores(spark, tmp_path):
    want = tree(tmp_path)
    for depth in (0, 1, 2, 9):
        rows = folders.media_listing(spark, str(tmp_path), depth).collect()
        assert {r.path: r.size for r in rows} == {f"{tmp_path}/{n}": len(n) for n in want} and len(rows) == len(want)
        assert all(r.mtime_s > 1_600_000_000 for r in rows)
    assert folders.media_listing(spark, f"{tmp_path}/missing").count() == 0


def test_watching_lists_anew_at_every_trigger(spark, tmp_path):
    (tmp_path / "in").mkdir()
    tree(tmp_path / "in")
    out = str(tmp_path / "out")
    S.run_through(folders.watched_folder(spark, str(tmp_path / "in")), out, "seen")
    (tmp_path / "in" / "_late.mkv").write_bytes(b"1")
    import time

    time.sleep(1.1)
    S.run_through(folders.watched_folder(spark, str(tmp_path / "in")), out, "seen")
    seen = spark.read.parquet(f"{out}/seen").groupBy("path").count().collect()
    assert {r.path.rsplit("/", 1)[1]: r["count"] for r in seen} == {
        "_top.mkv": 2, "one.MP4": 2, "_two.mkv": 2, "deep.avi": 2, "three.mov": 2, "_late.mkv": 1,
    }

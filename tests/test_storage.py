"""Files that are stored and copied, stored tables, and streams that write once."""

from __future__ import annotations

import os
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from winnow.operators import state
from winnow.sources import store, tables
from winnow.streaming import heartbeat, ingest, progress

# ---- files -------------------------------------------------------------------


def test_store_saves_reads_and_deletes(tmp_path):
    s = store.Store(f"file://{tmp_path}/top")
    assert s.save("uploads/t1/originals/a.jpg", b"abc") == 3 and (tmp_path / "top/t1/originals/a.jpg").read_bytes() == b"abc"
    assert s.save("t1/b", iter([b"x" * store.PIECE, b"y"])) == store.PIECE + 1  # piece by piece
    assert s.read("uploads/t1/b") == b"x" * store.PIECE + b"y" and s.exists("t1/b") and not s.exists("t1/c") and not s.exists("t1")
    with pytest.raises(FileNotFoundError):
        s.read("t1/c")
    s.delete("t1/b")
    s.delete("t1/b")  # what isn't there is no error
    assert not s.exists("t1/b") and s.url("uploads/t1/x") == "/uploads/t1/x"
    for bad in ("", "uploads/", "../x", "a/../../x"):
        with pytest.raises(ValueError, match="no path"):
            s.at(bad)


def test_store_leaves_no_half_file(tmp_path):
    s = store.Store(str(tmp_path))

    def pieces():
        yield b"half"
        raise OSError("gone")

    s.save("t/a", b"old")
    with pytest.raises(OSError, match="gone"):
        s.save("t/a", pieces())
    assert s.read("t/a") == b"old" and [p.name for p in (tmp_path / "t").iterdir()] == ["a"]


def test_store_uploads_in_parts(tmp_path):
    s = store.Store(str(tmp_path))
    for n in (2, 10, 1):
        s.save_part("u", n, f"<{n}>".encode())
    s.save("_parts/u/other", b"no part")
    assert [(n, size) for n, _, size in s.parts("u")] == [(1, 3), (2, 3), (10, 4)]
    with pytest.raises(FileNotFoundError, match="part_3"):
        s.complete("t/f", "u", [1, 2, 3])
    assert not s.exists("t/f")
    assert s.complete("t/f", "u", [10, 2, 1]) == 10 and s.read("t/f") == b"<1><2><10>" and s.parts("u") == []
    s.abort("u")


def test_other_stores_are_reached_by_the_s3_protocol():
    fs, path = store.file_system("oss://bucket/a/", {"endpoint_override": "localhost:1", "access_key": "k", "secret_key": "s", "region": "r"})
    assert type(fs).__name__ == "S3FileSystem" and path == "bucket/a"


PATHS = "id string, file_path string, thumbnail_path string, optimized_path string, compiled_path string, n int"


def test_migration_isolates_failures_and_copies_nothing_twice(spark, rows, tmp_path):
    one, two = f"{tmp_path}/one", f"{tmp_path}/two"
    contents = [("uploads/t/a", b"A"), ("t/b", b"B" * 3_000_000), ("t/c", b""), ("t/locked", b"x")]
    saved = store.save_files(rows(contents, "path string, content binary"), one)
    assert {r.outcome for r in saved.collect()} == {"saved"}
    os.remove(f"{one}/t/locked")
    os.mkdir(f"{one}/t/locked")  # can't be read as a file
    media = rows([("1", "uploads/t/a", None, "", "t/b", 1), ("2", "t/c", "uploads/t/a", "t/missing", None, 2), ("3", "t/locked", None, None, None, 3), ("4", None, None, None, None, 4)], PATHS)
    outcomes, moved = store.migrate(media, one, two)
    got = {r.path: r for r in outcomes.collect()}
    assert {p: r.outcome for p, r in got.items()} == {"uploads/t/a": "copied", "t/b": "copied", "t/c": "copied", "t/missing": "failed", "t/locked": "failed"}
    assert "FileNotFoundError" in got["t/missing"].error and got["t/locked"].error and got["t/b"].size == 3_000_000
    assert store.summary(outcomes).first() == (5, 3, 2)
    assert {r.path: r.size for r in store.digests(outcomes, two).collect()} == {"uploads/t/a": 1, "t/b": 3_000_000, "t/c": 0}
    assert sorted(map(tuple, moved.collect())) == [("1", "t/a", None, "", "t/b", 1), ("2", "t/c", "t/a", "t/missing", None, 2), ("3", "t/locked", None, None, None, 3), ("4", None, None, None, None, 4)]
    times = {p: p.stat().st_mtime_ns for p in Path(two).rglob("*") if p.is_file()}
    again, _ = store.migrate(media, one, two)
    assert {r.path: r.outcome for r in again.collect()} == {"uploads/t/a": "present", "t/b": "present", "t/c": "present", "t/missing": "failed", "t/locked": "failed"}
    assert {p: p.stat().st_mtime_ns for p in Path(two).rglob("*") if p.is_file()} == times
    # reading the outcomes again copies nothing either
    os.remove(f"{two}/t/a")
    assert again.count() == 5 and not os.path.exists(f"{two}/t/a")


def test_migration_of_nothing(rows, tmp_path):
    outcomes, moved = store.migrate(rows([], PATHS), f"{tmp_path}/a", f"{tmp_path}/b")
    assert store.summary(outcomes).first() == (0, 0, 0) and moved.count() == 0


def test_uploads_are_merged_in_tasks(rows, tmp_path):
    root = str(tmp_path)
    parts = [("u1", n, f"{n},".encode()) for n in range(1, 13)] + [("u2", 1, b"x"), ("u2", 3, b"z")]
    store.save_parts(rows(parts, "upload_id string, part_no int, content binary"), root)
    uploads = rows([("u1", "m/1", 12), ("u2", "m/2", 3)], "upload_id string, path string, total_parts int")
    got = {r.path: r for r in store.complete_uploads(uploads, root).collect()}
    assert got["m/1"].outcome == "merged" and got["m/2"].outcome == "failed" and "part_2" in got["m/2"].error
    assert store.Store(root).read("m/1") == b"".join(p for u, _, p in parts if u == "u1")
    again = {r.path: r.outcome for r in store.complete_uploads(uploads, root).collect()}
    assert again == {"m/1": "merged", "m/2": "failed"}
    assert {r.path: r.outcome for r in store.delete_files(rows([("m/1",), ("m/9",)], "path string"), root).collect()} == {"m/1": "deleted", "m/9": "absent"}


# ---- tables ------------------------------------------------------------------

SEGMENTS = "media_id long, segment_index int, id string, selected boolean, score double"


def segments(rows, data):
    return rows(data, SEGMENTS)


@pytest.fixture
def stored(spark, rows, tmp_path):
    t = tables.Versions(spark, f"{tmp_path}/segments", SEGMENTS, ["media_id"], parts=4)
    t.replace(segments(rows, [(m, i, f"old{m}{i}", i == 0, 0.1) for m in range(20) for i in range(3)]))
    return t


MERGE = state.upserted_rows(["media_id", "segment_index"], ["id", "selected"])


def test_upsert_keeps_id_and_choice(stored, rows):
    old = stored.read()
    before = stored.snapshot()[1]
    stored.change(segments(rows, [(7, 0, "new", False, 0.9), (7, 5, "new5", True, 0.8)]), MERGE)
    got = {(r.media_id, r.segment_index): r for r in stored.read().collect()}
    assert got[7, 0] == (7, 0, "old70", True, 0.9) and got[7, 5] == (7, 5, "new5", True, 0.8) and got[7, 1].id == "old71" and len(got) == 61
    after = stored.snapshot()[1]
    assert sum(before[p] != after[p] for p in before) == 1  # the others lie where they lay
    assert old.count() == 60 and old.where("score > 0.5").count() == 0  # who read before still sees the old rows
    assert {tuple(r)[:2] for r in stored.lookup(media_id=7).collect()} == {(7, 0), (7, 1), (7, 2), (7, 5)}


def test_a_change_that_ends_midway_leaves_the_old_table(stored, rows, monkeypatch):
    want = sorted(map(tuple, stored.read().collect()))
    new = segments(rows, [(m, 0, "new", False, 0.9) for m in range(20)])

    def killed(seen, folders):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(stored, "swap", killed)
        with pytest.raises(KeyboardInterrupt):
            stored.change(new, MERGE)
    assert sorted(map(tuple, stored.read().collect())) == want and stored.snapshot()[0] == 1
    # a task that fails while rows are written aside does no harm either
    broken = new.withColumn("score", F.when(F.col("media_id") == 13, F.raise_error(F.lit("lost")).cast("double")).otherwise(0.9))
    with pytest.raises(Exception, match="lost"):
        stored.change(broken, MERGE)
    assert sorted(map(tuple, stored.read().collect())) == want
    stored.change(new, MERGE)
    assert stored.read().where("score = 0.9").count() == 20
    assert stored.vacuum(1) >= 2 and stored.read().count() == 60


def test_one_of_two_writers_wins(stored, rows):
    seen, folders = stored.snapshot()
    stored.change(segments(rows, [(1, 0, "a", False, 0.5)]), MERGE)
    with pytest.raises(tables.Conflict):
        stored.swap(seen, folders)
    assert stored.read().where("score = 0.5").count() == 1


def test_an_empty_table(spark, rows, tmp_path):
    t = tables.Versions(spark, f"{tmp_path}/t", SEGMENTS, ["media_id"])
    assert t.read().count() == 0 and t.lookup(media_id=1).count() == 0
    t.change(segments(rows, [(1, 0, "a", None, None)]), MERGE)
    assert t.lookup(media_id=1).count() == 1
    t.replace(segments(rows, []))
    assert t.read().count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    trips = tables.save_bucketed(spark.range(500).selectExpr("id as trip_id", "concat('t', id) as title"), "bucketed_trips", "trip_id", 8, f"{tmp_path}/trips")
    media = tables.save_bucketed(spark.range(3000).selectExpr("id", "id % 500 as trip_id"), "bucketed_media", "trip_id", 8, f"{tmp_path}/media")
    joined = media.join(trips.hint("merge"), "trip_id")
    assert "SortMergeJoin" in plan(joined) and "Exchange" not in plan(joined) and joined.count() == 3000
    assert "Exchange" not in plan(media.groupBy("trip_id").count())
    with tables.bucket_reads(spark):
        one = spark.table("bucketed_media").where("trip_id = 77")
        assert "SelectedBucketsCount: 1 out of 8" in plan(one) and one.count() == 6


# ---- streams -----------------------------------------------------------------


def test_ingest_writes_each_file_once(spark, tmp_path, monkeypatch):
    """It fails in the second batch, after its rows are written and before they are committed, and once more after the commit."""
    for i in range(12):
        f = tmp_path / f"in/trip{i % 2}/f{i:02}.{'txt' if i == 5 else 'jpg'}"
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(f"content {i}".encode())
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    sink = ingest.Sink(spark, f"{tmp_path}/media", "trip_id", ["original_filename"])
    run = lambda: ingest.ingest(ingest.arriving(spark, f"{tmp_path}/in", 4), f"{tmp_path}/store", sink, f"{tmp_path}/cursor").awaitTermination()
    commit, failures = sink.commit, []

    def failing(number):
        if number == 1 and len(failures) == 0:
            failures.append("before")
            raise RuntimeError("before the commit")
        commit(number)
        if number == 1 and len(failures) == 1:
            failures.append("after")
            raise RuntimeError("after the commit")

    monkeypatch.setattr(sink, "commit", failing)
    for want in ("before", "after"):
        with pytest.raises(Exception, match=f"{want} the commit"):
            run()
        assert sink.batches() == ([0] if want == "before" else [0, 1])
    run()
    got = sink.rows().collect()
    assert sink.batches() == [0, 1, 2] and len(got) == 11 == len({r.id for r in got})  # the text isn't media
    for t in ("trip0", "trip1"):
        own = sorted((r.seq, r.original_filename) for r in got if r.trip_id == t)
        assert [s for s, _ in own] == list(range(1, len(own) + 1)) and [n for _, n in own] == sorted(n for _, n in own)
    assert {r.processing_status for r in got} == {"pending"}
    there = store.digests(sink.rows().select(F.col("file_path").alias("path")), f"{tmp_path}/store").collect()
    assert {(r.path, r.md5) for r in there} == {(r.file_path, r.md5) for r in got}
    run()
    assert sink.rows().count() == 11


def test_ingest_tells_what_could_not_be_stored(spark, tmp_path):
    (tmp_path / "in/t").mkdir(parents=True)
    (tmp_path / "in/t/a.png").write_bytes(b"x")
    (tmp_path / "store").write_bytes(b"a file where the folder should be")
    sink = ingest.Sink(spark, f"{tmp_path}/media", "trip_id", ["original_filename"])
    ingest.ingest(ingest.arriving(spark, f"{tmp_path}/in"), f"{tmp_path}/store", sink, f"{tmp_path}/cursor").awaitTermination()
    (row,) = sink.rows().collect()
    assert row.processing_status == "failed" and row.processing_error and row.seq == 1


def test_ingest_of_a_log_takes_each_file_once(spark, rows, tmp_path, monkeypatch):
    """It fails in the second batch before the commit; one file is named twice, one isn't there, and one has odd characters."""
    sink = ingest.Sink(spark, f"{tmp_path}/media", "trip_id", ["original_filename"])
    for n, part in enumerate([["t/a.jpg", "t/a.jpg", "a b/50%.MP4", "t/note.txt"], ["t/gone.png", "x/y/c.png", "/top.jpg"]]):
        for p in part:
            if "gone" not in p:
                store.Store(str(tmp_path / "in")).save(p, f"content of {p}".encode())
        rows([(p,) for p in part], "path string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        log = next(p for p in (tmp_path / "log").glob("part-*") if p.stat().st_mtime > 1_700_001_000)
        os.utime(log, (1_700_000_000 + n, 1_700_000_000 + n))
    run = lambda: ingest.ingest_logged(ingest.logged(spark, f"{tmp_path}/log", 1), f"{tmp_path}/in", f"{tmp_path}/store", sink, f"{tmp_path}/cursor").awaitTermination()
    commit, failures = sink.commit, []

    def failing(number):
        if number == 1 and not failures:
            failures.append(number)
            raise RuntimeError("before the commit")
        commit(number)

    monkeypatch.setattr(sink, "commit", failing)
    with pytest.raises(Exception, match="before the commit"):
        run()
    assert sink.batches() == [0]
    run()
    run()
    got = {(r.trip_id, r.original_filename): r for r in sink.rows().collect()}
    assert sink.batches() == [0, 1] and sink.rows().count() == 5
    assert {k: (r.processing_status, r.seq, r.media_type) for k, r in got.items()} == {
        ("t", "a.jpg"): ("pending", 1, "image"), ("a b", "50%.MP4"): ("pending", 1, "video"), ("t", "gone.png"): ("failed", 2, "image"), ("x/y", "c.png"): ("pending", 1, "image"), ("", "top.jpg"): ("pending", 1, "image"),
    }
    gone = got.pop(("t", "gone.png"))
    assert "FileNotFoundError" in gone.processing_error and gone.file_size is None and gone.md5 is None
    there = {(r.path, r.size, r.md5) for r in store.digests(sink.rows().select(F.col("file_path").alias("path")), f"{tmp_path}/store").collect()}
    assert there == {(r.file_path, r.file_size, r.md5) for r in got.values()}


def test_ingested_files_are_not_each_a_task(spark, rows, tmp_path):
    """The driver lists no files: of 400, a stage has as few tasks as of ten."""
    from winnow.plans import catalog

    def tasks(n):
        top = tmp_path / f"{n}"
        rows([(i, f"text {i}", "en", f"s{i % 3}", 6) for i in range(n)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{top}/documents.parquet")
        tracker, first = spark.sparkContext.statusTracker(), spark.sparkContext.parallelize([0], 1)
        spark.sparkContext.setJobGroup(f"before{n}", "")
        first.count()
        (job,) = tracker.getJobIdsForGroup(f"before{n}")
        stage = max(tracker.getJobInfo(job).stageIds)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        got = catalog.queries()["a12_ingested_stream"](spark, str(top)).collect()
        assert len(got) == sum(i % 4 != 2 for i in range(n)) and {r.processing_status for r in got} == {"pending"}
        assert all(r.last_seq == r.numbers == sum(x.trip_id == r.trip_id for x in got) for r in got)
        return max(s.numTasks for i in range(stage, stage + 200) if (s := tracker.getStageInfo(i)))

    assert tasks(400) == tasks(10)


JOBS = "id long, job_id long, created_at timestamp, status string"
START = datetime(2024, 1, 1)


def log(rows, data):
    return rows([(i, j, START + timedelta(seconds=s), status) for i, j, s, status in data], JOBS)


def test_a_repeated_push_is_passed_over(spark, rows, tmp_path):
    sink = ingest.Sink(spark, f"{tmp_path}/log", "job_id", ["created_at", "id"])
    assert sink.rows() is None
    first, second = log(rows, [(1, 1, 0, "a"), (2, 1, 1, "b"), (3, 2, 0, "a")]), log(rows, [(4, 1, 2, "c"), (5, 3, 0, "a")])
    sink.push(first, 0)
    sink.push(second, 1)
    sink.push(second, 1)
    assert sorted((r.job_id, r.seq, r.id) for r in sink.rows().collect()) == [(1, 1, 1), (1, 2, 2), (1, 3, 4), (2, 1, 3), (3, 1, 5)]


@pytest.mark.parametrize("batches", [1, 3])
def test_heartbeats(spark, rows, tmp_path, batches):
    """In one batch or in three: a heartbeat each 15 s without an event, and nothing after the end."""
    data = [
        [(1, 1, 0, "running"), (2, 1, 40, "running"), (3, 2, 1, "running"), (4, 2, 5, "completed"), (5, 2, 60, "running"), (11, 4, 30, "running"), (12, 4, 45, "running")],
        [(6, 1, 100, "running"), (7, 3, 90, "queued")],
        [(8, 1, 130, "failed"), (9, 3, 200, "running"), (10, 1, 209, "running"), (13, 4, 211, "completed")],
    ]
    for part in data if batches == 3 else [sum(data, [])]:
        log(rows, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(JOBS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with heartbeat.rocksdb(spark):
        heartbeat.sent_stream(events, "10 seconds").writeStream.format("memory").queryName(f"sent{batches}").outputMode("append").option("checkpointLocation", f"{tmp_path}/cursor").trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(str, spark.table(f"sent{batches}").collect()))
    upto = int((START - datetime(1970, 1, 1)).total_seconds() * 1000) + 201_000
    assert got == sorted(map(str, heartbeat.sent(log(rows, sum(data, [])), upto).collect()))
    beats = [r.at_ms // 1000 % 1000 for r in spark.table(f"sent{batches}").where("kind = 'heartbeat' and job_id = 1").collect()]
    assert len(beats) == 6 and spark.table(f"sent{batches}").where("job_id = 2").count() == 2
    assert spark.table(f"sent{batches}").where("job_id = 4 and kind = 'heartbeat'").count() == 11  # none at 45, where an event came


def test_numbered_tail_over_restarts(spark, rows, tmp_path):
    sink = ingest.Sink(spark, f"{tmp_path}/log", "job_id", ["created_at", "id"])
    for k in range(3):
        log(rows, [(10 * k + i, i % 2, 100 * k + i, "x") for i in range(5)]).write.mode("append").parquet(f"{tmp_path}/in")
        events = spark.readStream.schema(JOBS).parquet(f"{tmp_path}/in")
        progress.tail(events, f"{tmp_path}/cursor", sink.push).awaitTermination()
    for j, n in ((0, 9), (1, 6)):
        own = sorted((r.seq, r.id) for r in sink.rows().where(f"job_id = {j}").collect())
        assert [s for s, _ in own] == list(range(1, n + 1)) and [i for _, i in own] == sorted(i for _, i in own)


def test_uploads_are_merged_by_many_tasks(spark, tmp_path):
    """Rows of uploads are small, so that a shuffle would leave them in one task."""
    from winnow.sources import store

    parts = spark.range(60).selectExpr("id as upload_id", "1 as part_no", "cast(cast(id as string) as binary) as content")
    store.save_parts(parts, str(tmp_path.as_uri()))
    uploads = parts.groupBy("upload_id").count().selectExpr("upload_id", "concat('m/', upload_id) as path", "1 as total_parts")
    done = store.complete_uploads(uploads, str(tmp_path.as_uri()))
    assert done.where("outcome = 'merged'").count() == 60
    assert len(list((tmp_path / "m").iterdir())) == 60
    assert len([f for f in done.inputFiles()]) > 4
    assert store.digests(uploads, str(tmp_path.as_uri())).rdd.getNumPartitions() > 4

import datetime as dt

import pytest

from leafmill.operators import incremental as inc

LISTING = "path string, length long, modificationtime timestamp, file_hash string, listed_at timestamp, size long, key string"
PROCESSED = "path string, mtime double, size long, file_hash string, processed_at double, status string"
RUNS = "run_id long, started_at timestamp, finished_at timestamp, status string"


def at(seconds):
    return dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=seconds)


def epoch(seconds):
    return at(seconds).timestamp()


def found(spark, tmp_path, listing, processed, runs):
    rows = inc.watch_changes(
        spark, spark.createDataFrame(listing, LISTING), spark.createDataFrame(processed, PROCESSED), spark.createDataFrame(runs, RUNS), f"file://{tmp_path}/state"
    ).collect()
    return {r.key: r.change for r in rows}


def test_cases(spark, tmp_path):
    runs = [(1, at(0), at(100), "success"), (2, at(200), at(300), "failed"), (3, at(400), None, "crashed"), (4, at(500), at(90000), "success")]

    def listed(path, size=10, mtime=5, digest="h", when=1000):
        return (path, size, at(mtime), digest, at(when), -1, "x")

    def done(path, size=10, mtime=5, digest="h", when=50):
        return (path, epoch(mtime), size, digest, epoch(when), "x")

    listing = [
        listed("same"), listed("same"), listed("size", 11), listed("hash", digest="g"), listed("touched", mtime=6), listed("nohash", digest=None, mtime=6),
        listed("nohash_same", digest=None), listed("new"), listed("failed_only"), listed("late_failed", 12), listed("older", 1, when=1), listed("older"),
        listed("edge_start"), listed("edge_end"), listed("long_run"), (None, 1, at(1), "h", at(1), 0, "x"),
    ]
    processed = [
        done("same"), done("same"), done("size"), done("hash"), done("touched"), done("nohash"), done("nohash_same"), done("failed_only", when=250),
        done("late_failed", 11), done("late_failed", 12, when=450), done("older"), done("edge_start", when=0), done("edge_end", when=100), done("gone"),
        done("long_run", when=80000), (None, 1.0, 1, "h", epoch(50), "x"), ("unwritten", 1.0, 1, "h", None, "x"),
    ]
    assert found(spark, tmp_path, listing, processed, runs) == {
        "size": "changed", "hash": "changed", "nohash": "changed", "new": "new", "failed_only": "new", "late_failed": "changed",
    }


def test_empty_tables(spark, tmp_path):
    assert found(spark, tmp_path, [], [], []) == {}
    assert found(spark, tmp_path / "b", [("a", None, None, None, None, 0, "")], [], []) == {"a": "new"}


def current(spark, *rows):
    df = spark.createDataFrame(list(rows), "key string, size long, mtime_us long, content_hash string")
    return df.withColumn("row_hash", inc.row_hash(df.size, df.mtime_us, df.content_hash))


def test_runs_neither_skip_nor_repeat(spark, tmp_path):
    store, seen = inc.StateStore(spark, f"file://{tmp_path}/s"), []

    def take(todo):
        seen.append(sorted(r.key for r in todo.collect()))

    assert store.version() == 0 and store.load().count() == 0
    first = current(spark, ("a", 1, 1, "x"), ("b", 2, 2, "y"))
    with pytest.raises(RuntimeError):
        inc.run_once(store, first, lambda todo: (_ for _ in ()).throw(RuntimeError("lost")))
    assert store.version() == 0
    inc.run_once(store, first, take)
    inc.run_once(store, first, take)
    inc.run_once(store, current(spark, ("a", 1, 1, "x"), ("b", 3, 2, "z"), ("c", 1, 1, None)), take)
    assert seen == [["a", "b"], [], ["b", "c"]]
    assert {r.key: r.size for r in store.load().collect()} == {"a": 1, "b": 3, "c": 1}
    store.vacuum(keep=1)
    assert store.version() == 3 and store.load().count() == 3


def test_one_of_two_runs_commits(spark, tmp_path):
    store = inc.StateStore(spark, f"file://{tmp_path}/s")
    store.commit(current(spark, ("a", 1, 1, "x")), expected=0)
    with pytest.raises(FileExistsError):
        store.commit(current(spark, ("b", 1, 1, "x")), expected=0)
    assert [r.key for r in store.load().collect()] == ["a"]

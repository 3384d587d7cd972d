import datetime

import pytest
from pyspark.sql import functions as F

from passagework.operators.incremental import Target, changed_records, file_unchanged, item_unchanged, pending, run_incremental
from passagework.streaming.scans import keep_current

T = datetime.datetime(2026, 1, 1)
SCAN = "run_id bigint, source_id bigint, path string, lang string, size bigint, mtime_ns bigint, sha1 string, seen_at timestamp_ntz"


def tables(spark, scans, listing, files, items, runs):
    at = lambda h: None if h is None else T + datetime.timedelta(hours=h)
    return (
        spark.createDataFrame([(i, *f, "x") for i, f in enumerate(files)], "id bigint, source_id bigint, path string, size bigint, mtime_ns bigint, sha1 string, __old string"),
        spark.createDataFrame([(*s[:-1], at(s[-1])) for s in scans], SCAN),
        spark.createDataFrame(items, "source_id bigint, item_id string, version string, path string, url string, meta map<string,array<string>>"),
        spark.createDataFrame([(*r[:-1], at(r[-1])) for r in listing], "run_id bigint, source_id bigint, item_id string, version string, path string, url string, listed_at timestamp_ntz"),
        spark.createDataFrame([(*r[:2], at(r[2]), None, "ok") for r in runs], "run_id bigint, source_id bigint, started_at timestamp_ntz, finished_at timestamp_ntz, status string"),
    )


def test_new_and_changed_records(spark):
    scans = [
        (11, 1, "old-run", "md", 1, 1, "a", 9),
        (12, 1, "same", "md", 1, 1, "a", 1),
        (12, 1, "same", "md", 1, 1, "a", 1),
        (12, 1, "edited", "md", 1, 1, "b", 1),
        (12, 1, "later", "md", 1, 1, "wrong", 1),
        (12, 1, "later", "md", 1, 1, "a", 2),
        (12, 1, "unhashed-same", "md", 5, 6, None, 1),
        (12, 1, "unhashed-new-time", "md", 5, 7, None, None),
        (12, 1, "new", "md", None, None, None, 1),
        (12, 1, None, "md", 1, 1, "a", 1),
        (21, 2, "same", "md", 1, 1, "z", None),
    ]
    files = [(1, "same", 1, 1, "a"), (1, "edited", 1, 1, "a"), (1, "later", 9, 9, "a"), (1, "unhashed-same", 5, 6, "q"), (1, "unhashed-new-time", 5, 6, "q"), (1, "gone", 1, 1, "a")]
    listing = [(12, 1, "i1", "2", "p", "u", 1), (12, 1, "i2", None, "p", "u", 1), (12, 1, "i3", None, "p", "u", 1), (12, 1, "i4", "1", "p", "", 1)]
    items = [(1, "i1", "1", "p", "u", None), (1, "i2", None, "p", "u", {"a": ["b"]}), (1, "i3", "3", "p", "u", None), (1, "i5", "1", "p", "u", None)]
    runs = [(11, 1, 1), (12, 1, 5), (13, 1, None), (21, 2, 1), (31, 3, 1)]
    got = sorted(tuple(r) for r in changed_records(*tables(spark, scans, listing, files, items, runs)).collect() if r.record_key is not None)
    assert got == [("file", 1, "edited"), ("file", 1, "new"), ("file", 1, "unhashed-new-time"), ("file", 2, "same"), ("item", 1, "i1"), ("item", 1, "i3"), ("item", 1, "i4")]
    empty = [t.limit(0) for t in tables(spark, scans, listing, files, items, runs)]
    assert changed_records(*empty).count() == 0


def test_null_keys_are_keys(spark):
    new = spark.createDataFrame([(None, "1"), ("a", None)], "item_id string, version string")
    old = spark.createDataFrame([(None, "1"), ("a", "2")], "item_id string, version string")
    assert [r.item_id for r in pending(new, old, ["item_id"], item_unchanged).collect()] == ["a"]


SCHEMA = "path string, size bigint, mtime_ns bigint, sha1 string, words bigint"


def source(spark, rows):
    return spark.createDataFrame(rows, "path string, size bigint, mtime_ns bigint, sha1 string")


def test_runs_survive_failures_and_repeat_nothing(spark, tmp_path):
    target = Target(spark, f"file://{tmp_path}/t")
    seen = []

    def process(work):
        seen.append(sorted(r.path for r in work.collect()))
        return work.withColumn("words", F.lit(1).cast("bigint"))

    def broken(work):
        return process(work).withColumn("words", F.raise_error(F.lit("lost")).cast("bigint"))

    first = source(spark, [("a", 1, 1, "x"), ("b", 1, 1, "y"), (None, 1, 1, "n")])
    go = lambda s, f: run_incremental(target, s, ["path"], file_unchanged, f, SCHEMA)
    with pytest.raises(Exception, match="lost"):
        go(first.where("path is not null"), broken)
    assert target.version() == 0 and target.read(SCHEMA).count() == 0
    assert go(first.where("path is not null"), process) == 1
    assert go(first.where("path is not null"), process) == 1  # nothing left to do
    second = source(spark, [("a", 1, 2, "x"), ("b", 2, 1, "z"), ("c", 1, 1, None)])
    assert go(second, process) == 2
    assert seen == [["a", "b"], ["a", "b"], ["b", "c"]]
    assert sorted((r.path, r.sha1) for r in target.read(SCHEMA).collect()) == [("a", "x"), ("b", "z"), ("c", None)]
    assert target.read(SCHEMA, 1).count() == 2  # an older version is as it was
    with pytest.raises(RuntimeError, match="another run"):
        target.publish(target.read(SCHEMA), ["path"], base=1)
    assert target.compact(SCHEMA) == 3 and len(target.manifest()["folders"]) == 1 and target.read(SCHEMA).count() == 3


def test_stream_keeps_a_target_current(spark, tmp_path):
    target = Target(spark, f"file://{tmp_path}/t")
    schema = "path string, size bigint, mtime_ns bigint, sha1 string, seen bigint"
    done = []

    def process(rows):
        done.append(sorted(r.path for r in rows.collect()))
        return rows

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        keep_current(stream, target, ["path"], "seen", file_unchanged, process, schema, str(tmp_path / "cp")).awaitTermination()

    feed([("a", 1, 1, "x", 1), ("a", 1, 1, "y", 2), ("b", 1, 1, "b", 1)])
    feed([("a", 1, 1, "y", 3), ("b", 1, 1, "c", 5), ("a", 1, 1, "late", 1)])
    feed([("b", 1, 1, "stale", 2), ("c", 1, 1, "c", 1)])
    assert done == [["a", "b"], ["b"], ["c"]]
    assert sorted((r.path, r.sha1) for r in target.read(schema).collect()) == [("a", "y"), ("b", "c"), ("c", "c")]

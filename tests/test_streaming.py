from datetime import datetime, timedelta

from lattica.plans.constraints import Bound, Kind, meet, record, validate
from lattica.sources.documents import exported, read_csv, read_json, read_json_variant, with_origin, write_csv, write_json
from lattica.streaming import checks

SCHEMA = record({"value": meet(Kind("float"), Bound("<", 50.0))}, closed=False)


def test_stream_is_checked_as_a_batch_is(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(source)
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = checks.read(spark, str(tmp_path / "in"), batch.schema, files_per_batch=1)
    checks.split_to(stream, SCHEMA, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "state")).awaitTermination(120)
    bad = validate(batch, SCHEMA).where("size(violations) > 0").count()
    assert spark.read.parquet(str(tmp_path / "bad")).count() == bad > 0
    assert spark.read.parquet(str(tmp_path / "good")).count() == batch.count() - bad


def test_windows_of_a_stream(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch.repartition(2).write.parquet(str(tmp_path / "in"))
    counts = checks.violation_counts(checks.first_of(checks.read(spark, str(tmp_path / "in"), batch.schema), ["event_id"], "ts", "100 days"), SCHEMA, "ts", "1 day", None)
    query = counts.writeStream.format("memory").queryName("counts").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


def _at(minute, value, user=1, number=0):
    return (user, number, datetime(2024, 1, 1) + timedelta(minutes=minute), value)


def _run(spark, tmp_path, batches, counts, mode="complete"):
    """What the counts of a stream of these batches, a file and a trigger each, are in the end."""
    schema = "user long, number long, ts timestamp, value double"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={i}"))
        stream = checks.read(spark, str(tmp_path / "in" / "b=*"), spark.createDataFrame([], schema).schema)
        writer = counts(stream).writeStream.option("checkpointLocation", str(tmp_path / "state")).outputMode(mode).trigger(availableNow=True)
        if mode == "append":
            query = writer.format("parquet").option("path", str(tmp_path / "out")).start()
        else:
            query = writer.format("memory").queryName("seen").start()
        assert query.awaitTermination(120) and query.exception() is None
    return spark.read.parquet(str(tmp_path / "out")) if mode == "append" else spark.table("seen")


def test_sliding_windows(spark, tmp_path):
    rows = [_at(1, 10.0), _at(6, 90.0), _at(12, 10.0)]
    out = _run(spark, tmp_path, [rows], lambda s: checks.violation_counts(s, SCHEMA, "ts", "10 minutes", "1 hour", "5 minutes"))
    start = [(r.window.start - datetime(2024, 1, 1)).total_seconds() / 60 for r in out.collect()]
    told = sorted(zip(start, [(r.n, r.n_invalid) for r in out.collect()], strict=True))
    assert told == [(-5, (1, 0)), (0, (2, 1)), (5, (2, 1)), (10, (1, 0))]


def test_sessions_end_at_a_gap(spark, tmp_path):
    rows = [_at(0, 10.0), _at(4, 90.0), _at(20, 10.0), _at(1, 10.0, 2), _at(3, 10.0, None)]
    out = _run(spark, tmp_path, [rows], lambda s: checks.session_counts(s, SCHEMA, "ts", ["user"], "5 minutes", "1 hour"))
    told = sorted((r.user or 0, r.session.start.minute, r.n, r.n_invalid) for r in out.collect())
    assert told == [(0, 3, 1, 0), (1, 0, 2, 1), (1, 20, 1, 0), (2, 1, 1, 0)]


def test_late_rows_are_left_out(spark, tmp_path):
    """A window is written once the watermark passes its end; a row for it that comes after that changes nothing."""
    batches = [[_at(1, 10.0), _at(100, 10.0)], [_at(2, 10.0), _at(101, 10.0)], [_at(300, 10.0)]]
    out = _run(spark, tmp_path, batches, lambda s: checks.violation_counts(s, SCHEMA, "ts", "10 minutes", "30 minutes"), "append")
    told = sorted(((r.window.start - datetime(2024, 1, 1)).total_seconds() / 60, r.n) for r in out.collect())
    assert told == [(0, 1), (100, 2)]


def test_documents(spark, tmp_path):
    rows = spark.sql("""SELECT * FROM VALUES (1, 'a,"b"\nc'), (2, null) t(n, s)""")
    write_json(rows, str(tmp_path / "json"))
    write_csv(rows, str(tmp_path / "csv"))
    assert sorted(map(tuple, read_json(spark, str(tmp_path / "json"), "n int, s string").collect())) == [(1, 'a,"b"\nc', None), (2, None, None)]
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "csv"), "n int, s string").collect())) == [(1, 'a,"b"\nc'), (2, None)]
    assert read_json_variant(spark, str(tmp_path / "json")).where("value is not null").count() == 2
    assert with_origin(spark.read.json(str(tmp_path / "json"))).where("origin like '%json'").count() == 2
    assert [x.count() for x in exported(rows, ["s"])] == [1, 1]

"""Telemetry, gateway log and streams on small inputs."""

import json

import pytest

from usagelens.sources import files, gateway, otel, sink
from usagelens.streaming import telemetry


def attrs(**kv):
    return [{"key": k.replace("__", "."), "value": v} for k, v in kv.items()]


def metric(start, ts, value, name="token.usage"):
    point = {"attributes": attrs(type={"stringValue": "input"}), "startTimeUnixNano": str(start), "timeUnixNano": ts, "asInt": str(value)}
    metrics = [{"name": name, "sum": {"dataPoints": [point]}}, {"name": "h", "histogram": {"dataPoints": [{"count": "1"}]}}]
    return json.dumps({"resourceMetrics": [{"resource": {"attributes": attrs(session__id={"stringValue": "s"})}, "scopeMetrics": [{"metrics": metrics}]}]})


def log(name, ts, **kv):
    record = {"timeUnixNano": str(ts), "body": {"stringValue": name}, "attributes": attrs(**kv)}
    return json.dumps({"resourceLogs": [{"resource": {}, "scopeLogs": [{"logRecords": [record]}]}]})


def frame(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def test_metrics(spark):
    ms = 1_000_000
    df = frame(spark, [metric(100 * ms, 200 * ms, 10), metric(100 * ms, 300 * ms, 25), metric(100 * ms, 250 * ms, 12), metric(200 * ms, 300 * ms, 7), "no json", None])
    rows = telemetry.latest_series(otel.datapoints(df)).orderBy("value").collect()
    assert [(r["value"], r["type"]) for r in rows] == [(7.0, "input"), (25.0, "input")]
    assert otel.skipped(df).first()[0] == 4
    assert otel.datapoints(df).select("session_id", "attrs").distinct().collect() == [("s", "{}")]


def test_events(spark):
    line = log("app.api_request", 5_000_000_000, duration_ms={"stringValue": "961"}, request_id={"stringValue": "r"}, input_tokens={"doubleValue": 3.7}, z={"intValue": 1}, b={"boolValue": True})
    r = otel.events(frame(spark, [line]), "app.").first()
    assert (r["event"], r["ts_us"], r["duration_ms"], r["input_tokens"], r["request_id"], r["attrs"]) == ("api_request", 5_000_000, 961, 3, "r", '{"b":"true","z":"1"}')
    bare = json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [{"attributes": []}]}]}]})
    assert otel.events(frame(spark, [bare]), "app.").first()["event"] == "(unknown)"


def test_gateway(spark):
    df = spark.createDataFrame([(1, "a,b"), (2, ""), (3, None)], "id long, prefix_hash_chain string")
    got = gateway.pull(df, "root", 1)
    assert [(r["key"], r["chain_len"], r["session_id"]) for r in got.orderBy("pg_id").collect()] == [("root#2", 0, ""), ("root#3", 0, "")]
    assert gateway.cursors(got).collect() == [("root", 3)]


def test_changed_files(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.jsonl").write_text("{}\n")
    before = spark.createDataFrame(files.states(spark, str(tmp_path)).collect(), "path string, size long, mtime_us long")
    (tmp_path / "b.jsonl").write_text("{}\n{}\n")
    assert [r["path"][-7:] for r in files.changed(files.states(spark, str(tmp_path)), before).collect()] == ["b.jsonl"]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    one = log("app.api_request", 5_000_000_000, session__id={"stringValue": "s"}, model={"stringValue": "m"}, input_tokens={"intValue": "4"}, output_tokens={"intValue": "2"})
    (src / "1.txt").write_text(one + "\n" + one + "\n")
    exports = spark.readStream.text(str(src))
    live = telemetry.live_events(exports, "app.")
    made = {"live": (live, "append"), "usage": (telemetry.usage_windows(otel.events(exports, "app.").selectExpr("*", "timestamp_micros(ts_us) AS ts")), "update"),
            "span": (telemetry.session_spans(otel.events(exports, "app.")), "update"), "idle": (telemetry.idle_islands(otel.events(exports, "app.").selectExpr("*", "timestamp_micros(ts_us) AS ts")), "append")}
    for name, (df, mode) in made.items():
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert spark.table("live").count() == 1
    assert spark.table("usage").select("requests", "input_tokens", "output_tokens").collect() == [(2, 8, 4)]
    assert spark.table("span").select("session_id", "started_us").collect() == [("s", 5_000_000)]


HOW = {"key": ["key"], "order": ["seq"], "partition": "day"}


def dated(spark, *x):
    return spark.createDataFrame(x, "day string, key string, v long, seq long")


def state(spark, path, at=None):
    return {(r.day, r.key): r.v for r in sink.read(spark, path, at).collect()}


def test_keyed_sink_merges_and_is_idempotent(spark, tmp_path):
    path = "file://" + str(tmp_path / "table")
    first = {("01", "a"): 5, ("01", "b"): 6, ("2", "c"): 7, (None, "n"): 1}
    assert sink.upsert(dated(spark, *[(d, k, v, 0) for (d, k), v in first.items()]), path, **HOW) == 1
    untouched = sink.Folder(spark, path).manifest(1)["parts"]
    again = dated(spark, ("01", "a", 9, 1), ("01", "d", 1, 1), ("01", "b", 0, -1))
    for n in (2, 3):
        assert sink.upsert(again, path, **HOW) == n
        assert state(spark, path) == first | {("01", "a"): 9, ("01", "d"): 1}  # a partition "01" stays text
    assert state(spark, path, 1) == first
    parts = sink.Folder(spark, path).manifest(3)["parts"]
    assert sum(parts[k] == untouched[k] for k in untouched) == 2  # others' folders as they were
    sink.vacuum(spark, path, keep=1)
    assert state(spark, path) == first | {("01", "a"): 9, ("01", "d"): 1} and sink.Folder(spark, path).versions() == [3]
    assert len(list((tmp_path / "table" / "data").iterdir())) == 2


def test_a_write_that_dies_leaves_the_old_table(spark, tmp_path):
    path = "file://" + str(tmp_path / "table")
    sink.upsert(dated(spark, ("1", "a", 5, 0), ("2", "c", 7, 0)), path, **HOW)

    def dying(batches):
        for batch in batches:
            if "x" in batch.column("key").to_pylist():
                raise OSError("gone")
            yield batch

    rows = dated(spark, ("1", "a", 6, 1), ("2", "x", 1, 1)).repartition(2, "key")
    with pytest.raises(Exception, match="gone"):
        sink.upsert(rows.mapInArrow(dying, rows.schema), path, **HOW)
    assert state(spark, path) == {("1", "a"): 5, ("2", "c"): 7} and sink.version(spark, path) == 1
    # rows written, but killed before the commit
    commit = sink.Folder.commit
    try:
        sink.Folder.commit = lambda *_: (_ for _ in ()).throw(KeyboardInterrupt())
        with pytest.raises(KeyboardInterrupt):
            sink.upsert(dated(spark, ("1", "a", 6, 1)), path, **HOW)
    finally:
        sink.Folder.commit = commit
    assert state(spark, path) == {("1", "a"): 5, ("2", "c"): 7}
    sink.upsert(dated(spark, ("1", "a", 8, 2)), path, **HOW)
    sink.vacuum(spark, path)
    assert state(spark, path) == {("1", "a"): 8, ("2", "c"): 7}


def test_a_write_from_an_old_version_is_refused(spark, tmp_path):
    path = "file://" + str(tmp_path / "table")
    one = sink.upsert(dated(spark, ("1", "a", 5, 0)), path, **HOW)
    sink.upsert(dated(spark, ("1", "a", 6, 1)), path, based_on=one, **HOW)
    with pytest.raises(sink.Conflict):
        sink.upsert(dated(spark, ("1", "a", 0, 9)), path, based_on=one, **HOW)
    folder = sink.Folder(spark, path)
    assert not folder.commit("versions/000000000002.json", "{}")  # two that commit at once: one rename wins
    assert state(spark, path) == {("1", "a"): 6}


def test_stream_into_the_sink(spark, tmp_path):
    path = "file://" + str(tmp_path / "table")
    for n, part in enumerate(([("1", "a", 5, 0), ("1", "b", 1, 0)], [("1", "a", 7, 1), ("2", "c", 2, 0)])):
        dated(spark, *part).coalesce(1).write.parquet(f"{tmp_path}/in/{n}.parquet")
    live = spark.readStream.schema(dated(spark).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    sink.upsert_stream(live, path, f"{tmp_path}/cp", **HOW).trigger(availableNow=True).start().awaitTermination(120)
    assert state(spark, path) == {("1", "a"): 7, ("1", "b"): 1, ("2", "c"): 2}


def test_paired_chains_take_the_session_of_their_request(spark):
    from usagelens.operators import wire

    g = spark.createDataFrame([(1, 10, "", "anthropic", 200, "m", "t,s", 1, 2, None, 4), (2, 20, "x", "chat", 200, "m", "t", 1, 2, 3, 4), (3, 5, "", "anthropic", 200, "m", "t", 1, 2, 3, 4)],
        "pg_id long, ts_us long, session_id string, api_class string, status long, model string, chain string, input_tokens long, output_tokens long, cache_read long, cache_write long")
    pairs = spark.createDataFrame([(1, 7), (2, 8), (3, 9)], "pg_id long, request_id long")
    r = spark.createDataFrame([(7, 70, 1, 2), (8, 70, 1, 2), (9, 90, 0, 0)], "request_id long, session_id long, write_5m long, write_1h long")
    s = spark.createDataFrame([(70, "p", "one", "T"), (90, "p", "two", "")], "session_id long, project string, slug string, title string")
    rows = lambda **k: {(x.pg_id, x.session_id, x.cache_read, x.write_1h) for x in wire.chain_rows(g, pairs, r, s, **k).collect()}
    assert rows() == {(1, 70, 0, 2), (3, 90, 3, 0)} and rows(from_us=6) == {(1, 70, 0, 2)} and rows(prefix="TW") == {(3, 90, 3, 0)}

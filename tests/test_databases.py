"""Databases as sources: ranges of keys, a stream behind the last key, payloads of changed rows only."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from usagelens.sources import files, gateway, part_trees, ranges

LOG = """CREATE TABLE router_requests (id INTEGER PRIMARY KEY, request_id TEXT, ts TEXT, model TEXT, backend_model TEXT, resolved_via TEXT, api_class TEXT,
 status INTEGER, latency_ms INTEGER, prompt_tokens INTEGER, completion_tokens INTEGER, cache_creation_input_tokens INTEGER, cache_read_input_tokens INTEGER, prefix_hash_chain TEXT, session_id TEXT)"""


def logged(path, ids):
    with sqlite3.connect(path) as db:
        db.execute(LOG.replace("TABLE", "TABLE IF NOT EXISTS"))
        db.executemany(
            "INSERT INTO router_requests VALUES (?, ?, '2024-01-01T00:00:00Z', ?, NULL, NULL, 'chat', 200, 5, 1, 2, NULL, NULL, ?, ?)",
            [(i, f"r{i}", "big" if i % 3 else "small", "a,b,c" if i % 2 else None, f"s{i % 5}" if i % 7 else None) for i in ids],
        )


def where(path):
    return {"driver": "sqlite3", "dsn": f"file:{path}?mode=ro", "connect": '{"uri": true}'}


def test_pull_in_ranges_behind_the_cursor(spark, tmp_path):
    path = tmp_path / "log.db"
    ids = [*range(1, 8000), *range(20_000, 24_000)]
    logged(path, ids)
    rows = gateway.origin(spark, **where(path), batch=500, range=3000)
    assert rows.rdd.getNumPartitions() == 8
    got = gateway.pull(rows, "root").select("pg_id", "chain_len", "session_id", "key").collect()
    assert sorted(r.pg_id for r in got) == ids
    one = next(r for r in got if r.pg_id == 7)
    assert (one.chain_len, one.session_id, one.key) == (3, "", "root#7")
    later = gateway.origin(spark, after=22_000, with_session=False, **where(path))
    assert gateway.pull(later, "root").agg(F.min("pg_id"), F.max("session_id")).first()[:] == (22_001, "")
    assert gateway.origin(spark, after=99_999, **where(path)).count() == 0


def test_only_asked_columns_and_rows_leave_the_database(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains
    from pyspark.sql.types import LongType, StructType

    path, asked = tmp_path / "log.db", []
    logged(path, range(1, 100))
    schema = StructType().add("id", LongType()).add("size", LongType())
    origin = ranges.Origin({"table": "router_requests", "expr.size": "length(model)", "batch": 10, **where(path)}, schema)
    plain = origin.rows
    origin.rows = lambda sql, values: asked.append((sql, values)) or plain(sql, values)
    left = list(origin.pushed([EqualTo(("model",), "small"), GreaterThan(("id",), 20), In(("status",), (200, 201)), StringContains(("model",), "x"), EqualTo(("size",), 5)]))
    assert [type(f) for f in left] == [StringContains, EqualTo]  # a made column is Spark's to judge
    got = [r for part in origin.ranges(0, 99) for r in origin.read(part)]
    assert got == [(i, 5) for i in range(21, 100) if i % 3 == 0]
    assert asked[0] == (
        "SELECT id, length(model), id FROM router_requests WHERE id > ? AND id <= ? AND model = ? AND id > ? AND status IN (?, ?) ORDER BY id LIMIT 10",
        [0, 99, "small", 20, 200, 201],
    )
    with pytest.raises(ValueError):
        ranges.Origin({"table": "t; DROP TABLE x", **where(path)}, schema)


def test_filters_reach_the_database(spark, tmp_path):
    path = tmp_path / "log.db"
    logged(path, range(1, 1000))
    rows = gateway.origin(spark, **where(path)).where("model = 'small' AND id > 500")
    assert rows.select("id").orderBy("id").collect() == [(i,) for i in range(501, 1000) if i % 3 == 0]


def test_stream_with_a_crash_between_gives_each_row_once(spark, tmp_path):
    path, flag = tmp_path / "log.db", tmp_path / "crash"
    logged(path, range(1, 6001))

    def fragile(batches):
        for batch in batches:
            if flag.exists() and 9000 in batch.column("pg_id").to_pylist():
                raise OSError("executor is gone")
            yield batch

    def go():
        rows = gateway.pull(gateway.origin(spark, stream=True, range=2500, **where(path)), "root").select("pg_id", "key")
        rows = rows.mapInArrow(fragile, rows.schema)
        out = rows.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(once=True).start(f"{tmp_path}/out")
        out.awaitTermination()

    found = lambda: sorted(r.pg_id for r in spark.read.parquet(f"{tmp_path}/out").collect())
    go()
    assert found() == list(range(1, 6001))
    logged(path, range(6001, 12_001))
    flag.touch()
    with pytest.raises(Exception, match="executor is gone"):
        go()
    assert found() == list(range(1, 6001))
    flag.unlink()
    logged(path, range(12_001, 12_501))
    go()
    go()
    assert found() == list(range(1, 12_501))


TOKENS = {"total": 9, "input": 4, "output": 5, "cache": {"read": 2}}
MESSAGES = {"m1": ("s", 5, {"role": "assistant", "modelID": "m", "tokens": TOKENS, "time": {"created": 2, "completed": 3}}), "m2": ("s", 5, {"role": "user", "time": {"created": 1}})}
PARTS = {
    "p1": ("m1", {"type": "text", "text": "hello"}),
    "p2": ("m1", {"type": "tool", "tool": "read", "callID": "c", "state": {"status": "error", "input": {"path": "/f"}, "output": "out"}}),
    "p3": ("m2", {"type": "text", "text": "x" * 5000}),
}


def stored(path):
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE session (id TEXT PRIMARY KEY, slug TEXT, directory TEXT, title TEXT, time_created INTEGER, time_updated INTEGER)")
        db.execute("CREATE TABLE message (id TEXT PRIMARY KEY, session_id TEXT, time_created INTEGER, time_updated INTEGER, data TEXT)")
        db.execute("CREATE TABLE part (id TEXT PRIMARY KEY, message_id TEXT, session_id TEXT, time_created INTEGER, time_updated INTEGER, data TEXT)")
        db.execute("INSERT INTO session VALUES ('s', 'sl', '/a/proj', 'T', 1000, 2000)")
        db.executemany("INSERT INTO message VALUES (?, ?, 1, ?, ?)", [(i, s, u, json.dumps(d)) for i, (s, u, d) in MESSAGES.items()])
        db.execute("INSERT INTO message VALUES ('m3', 's', 1, 5, 'no json')")
        db.executemany("INSERT INTO part VALUES (?, ?, 's', 1, 5, ?)", [(i, m, json.dumps(d)) for i, (m, d) in PARTS.items()])


def treed(root):
    def put(kind, folder, name, value):
        (root / kind / folder).mkdir(parents=True, exist_ok=True)
        (root / kind / folder / f"{name}.json").write_text(json.dumps(value))

    put("session", "x", "s", {"id": "s", "slug": "sl", "directory": "/a/proj", "title": "T", "time": {"created": 1000, "updated": 2000}})
    for i, (s, _, d) in MESSAGES.items():
        put("message", s, i, {"id": i, "sessionID": s, **d})
    for i, (m, d) in PARTS.items():
        put("part", m, i, {"id": i, "messageID": m, "sessionID": "s", **d})


def tables(read):
    messages = read("message")
    rows = [part_trees.sessions(read("session")), part_trees.requests(messages), part_trees.blocks(read("part"), messages)]
    return [sorted(map(str, r.collect())) for r in rows]


def test_database_equals_the_tree(spark, tmp_path):
    stored(tmp_path / "a.db")
    treed(tmp_path / "tree")
    got = tables(lambda kind: part_trees.database(spark, str(tmp_path / "a.db"), kind))
    assert got == tables(lambda kind: part_trees.read(spark, str(tmp_path / "tree"), kind))
    assert [len(x) for x in got] == [1, 1, 3]


def test_second_read_takes_changed_payloads_only(spark, tmp_path):
    path = str(tmp_path / "a.db")
    stored(path)
    keys = lambda: [r[:4] for k in part_trees.KINDS for r in part_trees.database_keys(spark, path, k).collect()]
    before = spark.createDataFrame(keys(), part_trees.MANIFEST)
    assert all(part_trees.database(spark, path, k, before).count() == 0 for k in part_trees.KINDS)
    with sqlite3.connect(path) as db:
        db.execute("UPDATE part SET data = ?, time_updated = 9 WHERE id = 'p1'", [json.dumps({"type": "text", "text": "hello again"})])
        db.execute("INSERT INTO part VALUES ('p9', 'm1', 's', 1, 5, ?)", [json.dumps({"type": "reasoning", "text": "hm"})])
        db.execute("UPDATE session SET title = 'U', time_updated = 3000")
    parts = part_trees.database(spark, path, "part", before)
    messages = part_trees.database(spark, path, "message")
    assert sorted((r.key, r.kind, r.byte_len) for r in part_trees.blocks(parts, messages).collect()) == [("oc:pb:p1", "assistant_text", 11), ("oc:pb:p9", "thinking", 2)]
    assert [r.title for r in part_trees.database(spark, path, "session", before).collect()] == ["U"]
    # bytes that leave the database: those of the two rows, not the 5,000 of the third
    changed = files.changed_rows(part_trees.database_keys(spark, path, "part"), before, ["kind", "id"])
    assert changed.agg(F.sum("size")).first()[0] == sum(len(json.dumps(d)) for d in ({"type": "text", "text": "hello again"}, {"type": "reasoning", "text": "hm"}))
    assert parts.count() == 2
    plan = part_trees.database(spark, path, "part", before)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan  # payloads come from lookups, no scan has `data`
    scans = [line for line in plan.split("== Physical Plan ==")[-1].splitlines() if "BatchScan" in line]
    assert scans and not any("data#" in line for line in scans)

"""Transcripts of one object a file, titles, text values, and the streaming cache doctor."""

import json
import random

from pyspark.sql import Row

from usagelens.operators import cache
from usagelens.plans import adapters
from usagelens.sources import part_trees as p
from usagelens.sources import transcripts
from usagelens.streaming import doctor

SF = "/root/testdata/sf0.001"


def put(root, kind, folder, name, value):
    (root / kind / folder).mkdir(parents=True, exist_ok=True)
    (root / kind / folder / f"{name}.json").write_text(value if isinstance(value, str) else json.dumps(value, indent=1))


def test_tree(spark, tmp_path):
    tokens = {"total": 9, "input": 4, "output": 5, "cache": {"read": 2}}
    put(tmp_path, "session", "x", "s", {"id": "s", "directory": "/a/proj/", "title": "T", "time": {"created": 1000, "updated": 0}})
    put(tmp_path, "message", "s", "m1", {"id": "m1", "role": "assistant", "modelID": "m", "tokens": tokens, "time": {"created": 2, "completed": 3}, "cost": 0.5})
    put(tmp_path, "message", "s", "m2", {"id": "m2", "sessionID": "s", "role": "assistant", "tokens": {"input": 1}, "time": {"created": 2}})
    put(tmp_path, "message", "s", "m3", {"id": "m3", "role": "user", "time": {"created": 1}})
    put(tmp_path, "message", "s", "m4", "{broken")
    put(tmp_path, "part", "m1", "p1", {"id": "p1", "messageID": "m1", "type": "text", "text": "hello"})
    put(tmp_path, "part", "m1", "p2", {"id": "p2", "messageID": "m1", "type": "tool", "tool": "read", "callID": "c", "state": {"status": "error", "input": {"filePath": "", "path": "/f"}, "output": "out"}})
    put(tmp_path, "part", "m3", "p3", {"id": "p3", "messageID": "m3", "type": "text", "text": "x", "sessionID": "s"})
    put(tmp_path, "part", "m9", "p4", {"id": "p4", "messageID": "m9", "type": "text", "text": "nobody's"})
    put(tmp_path, "part", "m1", "p5", {"id": "p5", "messageID": "m1", "type": "step-start"})
    messages, parts = p.read(spark, str(tmp_path), "message"), p.read(spark, str(tmp_path), "part")
    assert p.broken(messages).first()[0] == 1
    assert [tuple(r) for r in p.sessions(p.read(spark, str(tmp_path), "session")).collect()] == [("s", "", "/a/proj/", "proj", "T", 1_000_000, None)]
    assert [(r["key"], r["session_id"], r["ts_us"], r["cache_read"], r["cache_write"], r["cost_usd"]) for r in p.requests(messages).collect()] == [("oc:m1", "s", 3000, 2, 0, 0.5)]
    got = sorted((r["key"], r["session_id"], r["ts_us"], r["kind"], r["tool"], r["file_path"], r["is_error"], r["byte_len"]) for r in p.blocks(parts, messages).collect())
    assert got == [
        ("oc:pb:p1", "s", 2000, "assistant_text", "", "", False, 5), ("oc:pb:p2", "s", 2000, "tool_result", "read", "/f", True, 3),
        ("oc:pb:p3", "s", 1000, "user_text", "", "", False, 1),
    ]
    stored = spark.createDataFrame([("m1", "s", json.dumps({"role": "assistant", "tokens": tokens, "time": {"completed": 3}}))], "id string, session_id string, data string")
    assert p.requests(p.decoded(stored, "message", "session_id")).select("key", "session_id").collect() == [("oc:m1", "s")]


def test_titles_and_values(spark):
    events = [
        {"type": "ai-title", "sessionId": "s", "aiTitle": "made"}, {"type": "custom-title", "sessionId": "s", "customTitle": "mine"},
        {"type": "agent-name", "sessionId": "s", "agentName": "a"}, {"type": "user", "sessionId": "s", "cwd": "/x/y", "timestamp": "2024-01-01T00:00:00Z"},
        {"type": "ai-title", "sessionId": "s", "aiTitle": "later"}, {"type": "ai-title", "sessionId": "t", "aiTitle": "other"},
    ]
    lines = spark.createDataFrame([("f", i, json.dumps(e)) for i, e in enumerate(events)], "file string, line long, value string")
    got = {r["session_id"]: (r["title"], r["agent"], r["cwd"], r["project"]) for r in transcripts.sessions(transcripts.parse(lines)).collect()}
    assert got == {"s": ("mine", "a", "/x/y", "y"), "t": ("other", "", "", "")}
    texts = spark.createDataFrame([(1, '{"a":{"b":["x",2,{"c":"y"}]},"d":"z"}'), (2, "no"), (3, None)], "i int, j string")
    assert [r[0] for r in texts.orderBy("i").select(transcripts.string_values("j")).collect()] == [["x", "y", "z"], ["no"], None]


def test_live_doctor(spark, tmp_path):
    """Shuffled arrivals within the watermark, and requests that change while they wait, give the batch result; state goes."""
    requests, marks = adapters.requests(spark, SF), adapters.compactions(spark, SF)
    rows = requests.unionByName(marks, allowMissingColumns=True).select("request_id", "session_id", "model", "ts_us", *doctor.NUMBERS)
    rng, late = random.Random(6), 30 * 60 * 10**6
    arrivals = [(x.ts_us + rng.randrange(late), x) for x in rows.collect()]
    for at, x in arrivals[::5]:  # an earlier version of a message, on its way before the last one
        if x.request_id is not None:
            arrivals.append((max(x.ts_us, at - 1), Row(**x.asDict() | {"cache_read": 1, "input_tokens": 0})))
    arrivals = [x for _, x in sorted(arrivals, key=lambda a: a[0])]
    far = max(x.ts_us for x in arrivals)
    later = [[Row(request_id=10**9 + i, session_id=10**6, model="m", ts_us=far + days * 86_400 * 10**6, **dict.fromkeys(doctor.NUMBERS, 0))] for i, days in enumerate((1, 3, 40, 80))]
    n = 6
    for i, part in enumerate([arrivals[i * len(arrivals) // n : (i + 1) * len(arrivals) // n] for i in range(n)] + later):
        spark.createDataFrame(part, rows.schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}.parquet")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = doctor.live_transitions(stream).writeStream.format("memory").queryName("doctor").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    want = cache.transitions(requests, marks)
    got = spark.table("doctor").where("session_id < 1000000").select(*want.columns)
    assert want.count() and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    held = [p.stateOperators[0].numRowsTotal for p in q.recentProgress]
    assert max(held) > 10 and held[-1] <= 1  # sessions without a row for long are forgotten


def test_live_requests(spark, tmp_path):
    line = {"type": "assistant", "requestId": "r", "timestamp": "2024-01-01T00:00:00Z", "message": {"id": "i", "model": "m", "usage": {"input_tokens": 1}}}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(2 * (json.dumps(line) + "\n"))
    lines = spark.readStream.text(str(tmp_path / "in")).selectExpr("'f' AS file", "0L AS line", "value")
    q = doctor.live_requests(lines).writeStream.format("memory").queryName("reqs").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("reqs").select("key").collect() == [("cc:i:r",)]

"""Transcript lines of every kind."""

import json

from usagelens.operators import merge
from usagelens.sources import transcripts as t

USAGE = {"input_tokens": 5, "output_tokens": 7, "cache_creation_input_tokens": 1, "cache_read_input_tokens": 2}
TS = "2024-01-01T00:00:0{}Z"


def test_transcript(spark, tmp_path):
    say = lambda parts, model="m", **kv: {"type": "assistant", "requestId": "r", "timestamp": TS.format(1), "message": {"id": "i", "model": model, "content": parts, "usage": USAGE}} | kv
    ask = lambda content, **kv: {"type": "user", "sessionId": "s", "timestamp": TS.format(2), "message": {"content": content}} | kv
    events = [
        say([{"type": "text", "text": "three callers"}, {"type": "thinking", "thinking": "which one is stale now?"}]),
        say([{"type": "tool_use", "id": "u", "name": "mcp__kb__get", "input": {"file_path": "", "path": "/p/a"}}], sessionId="s"),
        say([{"type": "text", "text": "x"}], model="<synthetic>", requestId="q"),
        ask('[{"type":"text","text":"listed"}]'), ask("mark", isMeta=True), ask([{"type": "text", "text": ""}]),
        ask([{"type": "tool_result", "tool_use_id": "u", "content": "out", "is_error": True}], toolUseResult={"file": {"filePath": "/p/b"}}),
        {"type": "system", "subtype": "compact_boundary", "sessionId": "s", "timestamp": TS.format(3), "compactMetadata": {"trigger": "auto", "preTokens": 9}},
        {"type": "other"},
    ]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "stem.jsonl").write_text("".join(json.dumps(e) + "\n" for e in events) + "{broken\n\n")
    lines = t.read(spark, str(tmp_path))
    assert t.ingest_stats(lines).first().asDict() == {"files": 1, "lines": 11, "parse_errors": 1}
    parsed = t.parse(lines)
    found = merge.first_wins(t.requests(parsed), ["key"], ["file", "line"]).collect()
    assert [(r["key"], r["session_id"], r["input_tokens"], r["write_5m"]) for r in found] == [("cc:i:r", "stem", 5, None)]
    got = {(r["kind"], r["tool"], r["mcp_server"], r["file_path"], r["byte_len"], r["est_tokens"], r["is_error"]) for r in t.blocks(parsed).collect()}
    assert got == {
        ("assistant_text", "", "", "", 13, 4, False), ("thinking", "", "", "", 23, 6, False),
        ("tool_use", "mcp__kb__get", "kb", "/p/a", 30, 8, False), ("user_text", "", "", "", 33, 9, False), ("meta_text", "", "", "", 4, 1, False),
        ("tool_result", "", "", "/p/b", 5, 2, True),
    }
    assert [(r["session_id"], r["cause"], r["pre_tokens"]) for r in t.compactions(parsed).collect()] == [("s", "auto", 9)]
    used = t.attributed(t.blocks(parsed))
    assert used.count() == 6
    assert [(r["tool"], r["mcp_server"], r["file_path"]) for r in used.where("kind = 'tool_result'").collect()] == [("mcp__kb__get", "kb", "/p/a")]


def lines_of(spark, *events, file="/d/one.jsonl"):
    return spark.createDataFrame([(file, i, json.dumps(e)) for i, e in enumerate(events)], "file string, line long, value string")


def user(content, **kv):
    return {"type": "user", "timestamp": TS.format(1), "message": {"content": content}} | kv


def model(*parts, **kv):
    return {"type": "assistant", "requestId": "r1", "uuid": "x", "timestamp": TS.format(2), "message": {"id": "m1", "content": list(parts)}} | kv


def test_keys_join_the_copies_of_a_part(spark):
    use, said = {"type": "tool_use", "id": "u9", "name": "Grep", "input": {"q": 1}}, {"type": "text", "text": "so it is"}
    loose = {"type": "tool_use", "name": "Grep", "input": {"q": 2}}
    events = [user("go on", promptId="p7"), user("go on"), model(said, use, loose), user([{"type": "tool_result", "tool_use_id": "u9", "content": "ok"}, {"type": "tool_result", "content": "ok"}])]
    both = lines_of(spark, *events).unionByName(lines_of(spark, *events, file="/d/two.jsonl"))
    rows = t.blocks(t.parse(both))
    hashes = {r["body"]: r["content_hash"] for r in rows.collect()}
    got = {(r["key"], r["session_id"]) for r in t.unique(rows).collect()}
    go, ok = hashes["go on"], hashes['"ok"']
    assert got == {
        (f"cc:ut:p7:{go}", "one"), (f"cc:ut:one:{go}", "one"), (f"cc:ut:two:{go}", "two"), (f"cc:ab:m1:r1:t:{hashes['so it is']}", "one"), ("cc:tu:u9", "one"),
        (f"cc:tu:cc:m1:r1:{hashes[json.dumps({'q': 2}, separators=(',', ':'))]}", "one"), ("cc:tr:u9", "one"), (f"cc:tr:one:{ok}", "one"), (f"cc:tr:two:{ok}", "two"),
    }


def test_entries_as_a_reader_sees_them(spark):
    result = lambda content: {"type": "tool_result", "tool_use_id": "u", "content": content}
    events = [
        user("first"), user("seen", isMeta=True), model({"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "id": "u", "name": "Bash", "input": {"c": "ls"}}, {"type": "other"}),
        user([result("[1]"), result([{"type": "text", "text": "a"}, {"type": "image", "source": {"d": 1}}, {"type": "text", "text": "b"}]), result({"k": 1}), result([]), {"type": "tool_result", "tool_use_id": "?"}]),
        {"type": "system", "subtype": "compact_boundary", "compactMetadata": {"trigger": "auto", "preTokens": 90}}, {"type": "system", "subtype": "compact_boundary"},
        {"type": "system", "subtype": "x"}, user([{"type": "image"}]), user(None), {"type": "user"},
    ]
    rows = t.entries(t.parse(lines_of(spark, *events))).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in rows] == list(range(12))
    assert [(r["role"], r["kind"], r["tool"], r["text"]) for r in rows] == [
        ("user", "user_text", "", "first"), ("user", "meta_text", "", "seen"), ("assistant", "thinking", "", "hm"), ("assistant", "tool_use", "Bash", '{"c":"ls"}'),
        ("user", "tool_result", "Bash", "[1]"), ("user", "tool_result", "Bash", "a\n[image]\nb"), ("user", "tool_result", "Bash", '{"k":1}'), ("user", "tool_result", "Bash", ""),
        ("user", "tool_result", "", ""), ("system", "compaction", "", "compaction (auto, pre: 90 tokens)"), ("system", "compaction", "", "compaction"), ("user", "image", "", "[image]"),
    ]


def test_search_reads_only_files_that_hold_the_query(spark):
    lines = lines_of(spark, user("The Needle is here"), user("none"), user("a needle")).unionByName(lines_of(spark, user("hay"), file="/d/two.jsonl"))
    assert t.raw_match(lines, "needle").select("file").distinct().count() == 1 and t.raw_match(lines, 'need"le').count() == 4
    assert [(r["file"], r["ordinal"], r["matches"]) for r in t.search_lines(lines, "NEEDLE").orderBy("ordinal").collect()] == [("/d/one.jsonl", 0, 2), ("/d/one.jsonl", 2, 2)]
    assert t.search_lines(lines_of(spark, user('say "x" now')), '"x"').count() == 1  # written otherwise in JSON


def test_reference_sources_by_kind(spark):
    use = {"type": "tool_use", "id": "u", "name": "Edit", "input": {"file_path": "src/later.py", "more": [{"k_1": "deep_2"}, 3]}}
    events = [user([{"type": "tool_result", "tool_use_id": "t", "content": "load_rows keepIt"}]), user("load_rows", isMeta=True), model({"type": "text", "text": "load_rows"}, use), user("plain")]
    rows = t.reference_events(t.blocks(t.parse(lines_of(spark, *events)))).orderBy("pos").collect()
    assert [(r["is_source"], r["text"]) for r in rows] == [(False, '"load_rows keepIt"'), (True, "load_rows"), (True, "src/later.py\ndeep_2"), (True, "plain")]


def test_values_of_what_is_no_json(spark):
    df = spark.createDataFrame([("{cut off",), ('{"a":["x",{"b":"y"}],"c":1}',), (None,)], "v string")
    assert [r[0] for r in df.select(t.string_values("v")).collect()] == [["{cut off"], ["x", "y"], None]


def test_lines_are_numbered_in_each_file_over_its_parts(spark, tmp_path):
    sizes = {"a": 4000, "b": 1, "c": 700, "d": 3}
    for name, n in sizes.items():
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"n": {i}}}' + " " * (i % 90) + "\n" for i in range(1, n + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = t.read(spark, str(tmp_path))
        parts = spark.read.text(str(tmp_path)).selectExpr("_metadata.file_block_start AS b").distinct().count()
        got = {}
        for r in rows.collect():
            got.setdefault(r.file[-7:-6], []).append((r.line, json.loads(r.value)["n"]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert parts > 5  # the largest file is read in several
    assert {k: sorted(v) for k, v in got.items()} == {k: [(i, i) for i in range(1, n + 1)] for k, n in sizes.items()}

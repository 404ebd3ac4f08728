"""Typed usage tables derived from the given tables.

The given tables hold no transcripts, so requests, blocks, gateway rows, sessions and trials are
derived from events, conversations, nation and orders by fixed rules that SQL states alike
(`VIEWS`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_US = 1704067200000000
SQUEEZE = 120  # natural gaps are hours long; this brings all expiry branches up


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def squeezed(ts: Column) -> Column:
    us = F.unix_micros(ts.cast("timestamp"))
    return (F.lit(EPOCH_US) + F.floor((us - EPOCH_US) / SQUEEZE)).cast("long")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, eid = F.col("event_type"), F.col("event_id")
    bad = kind == "error"
    return table(spark, sf_dir, "events").select(
        eid.alias("request_id"),
        F.col("user_id").alias("session_id"),
        squeezed(F.col("ts")).alias("ts_us"),
        F.when(kind.isin("click", "view", "purchase"), "opus").when(kind == "signup", "haiku").otherwise("local").alias("model"),
        (eid % 97).alias("input_tokens"),
        F.floor(F.col("value") * 10).cast("long").alias("output_tokens"),
        F.when(bad, 0).when(eid % 7 == 0, 1000).otherwise(20000 + (eid % 5) * 500).cast("long").alias("cache_read"),
        F.when(bad, 0).otherwise((eid % 11) * 400).cast("long").alias("cache_write"),
        F.when(eid % 3 != 0, (eid % 2) * 1000).cast("long").alias("write_5m"),
        F.when(eid % 3 != 0, F.lit(500)).cast("long").alias("write_1h"),
        ((eid % 8) / 8).alias("cost_usd"),
        F.concat(F.lit("req-"), eid.cast("string")).alias("harness_request_id"),
    )


def compactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_id") % 25 == 0)
        .select(F.col("user_id").alias("session_id"), squeezed(F.col("ts")).alias("ts_us"))
        .distinct()
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, turn, role, text = F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text")
    kind = (
        F.when(role == "system", "meta_text")
        .when((role == "user") & (turn % 4 == 2), "tool_result")
        .when(role == "user", "user_text")
        .when(turn % 4 == 3, "thinking")
        .when(turn % 6 == 5, "tool_use")
        .otherwise("assistant_text")
    )
    tooled = F.col("kind").isin("tool_use", "tool_result")
    tool = F.element_at(F.array(*map(F.lit, ["Read", "Grep", "Bash", "mcp__kb__get"])), (conv % 4 + 1).cast("int"))
    size = F.octet_length(text).cast("long")
    return (
        table(spark, sf_dir, "conversations")
        .withColumn("kind", kind)
        .select(
            (conv * 1000 + turn).alias("block_id"),
            (conv % 150).alias("session_id"),
            conv.alias("file_id"),
            turn.alias("pos"),
            (F.lit(EPOCH_US) + (conv * 7919 + turn * 131) % 21600 * 1000000).alias("ts_us"),
            "kind",
            F.when(tooled, tool).otherwise("").alias("tool"),
            F.when(tooled, F.regexp_extract(tool, "^mcp__(.*?)__", 1)).otherwise("").alias("mcp_server"),
            F.when(tooled & (conv % 4 == 0), F.concat(F.lit("/p/f"), (conv % 7).cast("string"))).otherwise("").alias("file_path"),
            F.when(tooled, F.expr("turn div 8")).alias("tool_use_id"),
            size.alias("byte_len"),
            F.expr("(octet_length(text) + 3) div 4").alias("est_tokens"),
            F.substring(F.sha2(text, 256), 1, 16).alias("content_hash"),
            (turn % 5 == 4).alias("is_error"),
            (conv % 3).cast("int").alias("referenced"),
            text,
        )
        .where("byte_len > 0")
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("project"))
    span = requests(spark, sf_dir).groupBy("session_id").agg(
        F.min("ts_us").alias("started_us"), F.max("ts_us").alias("ended_us")
    )
    return span.join(nation, F.col("session_id") % 25 == F.col("n_nationkey"), "left").select(
        "session_id", F.coalesce("project", F.lit("")).alias("project"),
        F.concat(F.lit("S-"), F.col("session_id").cast("string")).alias("slug"),
        F.when(F.col("session_id") % 2 == 0, F.concat(F.lit("Task "), F.col("session_id").cast("string"))).otherwise("").alias("title"),
        "started_us", "ended_us",
        F.concat(F.lit("/work/"), F.lower(F.coalesce("project", F.lit("none"))), F.lit("/"), F.col("session_id").cast("string")).alias("cwd"),
        F.concat(F.lit("ses_"), F.lpad(F.col("session_id").cast("string"), 6, "0")).alias("harness_id"), F.expr("session_id div 2").alias("source_id"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript roots: one for each two sessions, of one of two harnesses."""
    ids = requests(spark, sf_dir).select(F.expr("session_id div 2").alias("source_id")).distinct()
    return ids.select("source_id", F.when(F.col("source_id") % 2 == 0, "tree").otherwise("lines").alias("kind"), F.concat(F.lit("/runs/"), F.col("source_id").cast("string")).alias("root"))


def request_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry of the requests, as export requests: some without a request id, some with one that no transcript has."""
    col, eid = F.col, F.col("event_id")
    named = F.when(eid % 6 == 0, "").when(eid % 10 == 3, F.concat(F.lit("gone-"), eid.cast("string"))).otherwise(F.concat(F.lit("req-"), eid.cast("string")))
    attrs = F.array(
        attribute("request_id", "stringValue", named), attribute("input_tokens", "intValue", eid % 97), attribute("output_tokens", "stringValue", F.floor(col("value") * 10).cast("long"))
    )
    nanos = (F.unix_micros(col("ts").cast("timestamp")) * 1000).cast("string")
    record = F.struct(nanos.alias("timeUnixNano"), F.struct(F.when(eid % 9 == 0, "app.tool_result").otherwise("app.api_request").alias("stringValue")).alias("body"), attrs.alias("attributes"))
    request = F.struct(F.array(F.struct(F.array(F.struct(F.array(record).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs"))
    return table(spark, sf_dir, "events").select(F.to_json(request).alias("value"))


def tree_objects(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Messages or parts as a database keeps them: ids, parents, and a JSON column; each turn is a message with one part."""
    b = blocks(spark, sf_dir)
    col, what = F.col, F.col("kind")
    session, message = col("file_id").cast("string").alias("session_id"), F.concat(F.lit("m"), F.lpad(col("file_id").cast("string"), 9, "0"), F.lpad(col("pos").cast("string"), 6, "0"))
    if kind == "message":
        role = F.when(what.isin("user_text", "meta_text", "tool_result"), "user").otherwise("assistant")
        # some report no tokens, some aren't completed, of these some have no tokens so far
        created = F.expr("ts_us div 1000")
        tokens = F.struct(
            F.when(col("pos") % 14 == 7, 0).otherwise(col("est_tokens")).alias("total"), col("est_tokens").alias("input"), col("pos").alias("output"), F.struct((col("file_id") % 5).alias("read")).alias("cache")
        )
        data = F.struct(
            role.alias("role"), F.concat(F.lit("m"), (col("file_id") % 3).cast("string")).alias("modelID"), F.when(col("pos") % 5 != 4, tokens).alias("tokens"),
            F.struct(created.alias("created"), F.when(col("pos") % 7 != 0, created + 1500).alias("completed")).alias("time"),
        )
        return b.select(message.alias("id"), session, F.to_json(data).alias("data"))
    tooled = what.isin("tool_use", "tool_result")
    asked = F.when(tooled, F.struct(F.struct(col("text").alias("pattern")).alias("input"), F.when(what == "tool_result", col("text")).alias("output"), F.when(col("is_error"), "error").otherwise("done").alias("status")))
    data = F.struct(
        F.when(tooled, "tool").when(what == "thinking", "reasoning").otherwise("text").alias("type"), F.when(~tooled, col("text")).alias("text"),
        F.when(tooled, col("tool")).alias("tool"), asked.alias("state"),
    )
    return b.select(F.concat(F.lit("p"), F.substring(message, 2, 15)).alias("id"), message.alias("message_id"), session, F.to_json(data).alias("data"))


def gateway(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    r = requests(spark, sf_dir)
    turn = F.row_number().over(Window.partitionBy("session_id", "model").orderBy("ts_us", "request_id"))
    i = F.col("request_id")
    r = r.withColumn("k", turn).where((i % 4 != 0) & ~((F.col("model") == "haiku") & (i % 3 == 0)))
    mark = lambda x: F.concat(
        F.lit("m"), x.cast("string"),
        F.when((i % 13 == 0) & (x == F.expr("k div 2")), "X").otherwise(""),
        F.when((i % 2 == 0) & (x == F.col("k")), "Y").otherwise(""),
    )
    marks = F.transform(F.sequence(F.lit(0), "k"), mark)
    head = F.array(F.when(i % 17 == 0, "tX").otherwise("t"), F.when(i % 19 == 0, "sX").otherwise("s"))
    return r.select(
        i.alias("pg_id"),
        (F.col("ts_us") - (i % 120) * 1000000).alias("ts_us"),
        F.when(i % 3 == 0, "").otherwise(F.col("session_id").cast("string")).alias("session_id"),
        F.col("session_id").alias("owner"),
        "model",
        F.when(F.col("model") == "haiku", "chat").otherwise("anthropic").alias("api_class"),
        F.lit(200).alias("status"), "input_tokens", "output_tokens", "cache_read", "cache_write", "write_5m", "write_1h",
        F.array_join(F.concat(head, marks), ",").alias("chain"),
        F.when((i % 29 == 0) & (i % 3 != 0), "opus").otherwise("").alias("resolved_via"),
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    ok = F.col("o_orderstatus") == "O"
    checks = F.to_json(
        F.array(
            F.struct(F.lit("build").alias("name"), (key % 2 == 0).alias("ok")),
            F.struct(F.lit("tests").alias("name"), (key % 3 == 0).alias("ok")),
            F.struct(F.lit("lint").alias("name"), F.lit(True).alias("ok")),
        )
    )
    return o.select(
        (key % 20).alias("run_id"), F.col("o_orderpriority").alias("arm"), key.alias("trial_id"),
        F.when(ok, "ok").when(F.col("o_orderstatus") == "F", "fail").otherwise("timeout").alias("status"),
        (F.col("o_custkey") * 10).alias("duration_ms"), F.when(key % 5 != 0, F.col("o_totalprice")).alias("cost_usd"),
        F.when(key % 7 == 0, "").when(key % 2 == 0, "tree").otherwise("lines").alias("harness"), F.concat(F.lit("m"), (key % 3).cast("string")).alias("model"),
        F.concat(F.lit("/runs/"), (key % 110).cast("string")).alias("transcript_root"), checks.alias("checks_json"),
    )


def attribute(key: str, kind: str, value: Column) -> Column:
    kinds = ("stringValue", "intValue", "doubleValue")  # in JSON those without a value are left out
    return F.struct(F.lit(key).alias("key"), F.struct(*[(value if k == kind else F.lit(None)).cast("string").alias(k) for k in kinds]).alias("value"))


def otel_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as an export request with one record and one datapoint."""
    col = F.col
    nanos = (F.unix_micros(col("ts").cast("timestamp")) * 1000).cast("string")
    attrs = F.array(
        attribute("session.id", "stringValue", col("user_id")), attribute("input_tokens", "intValue", col("event_id") % 97),
        attribute("cost_usd", "doubleValue", (col("event_id") % 8) / 8), attribute("type", "stringValue", col("event_type")),
    )
    record = F.struct(nanos.alias("timeUnixNano"), F.struct(F.concat(F.lit("app."), "event_type").alias("stringValue")).alias("body"), attrs.alias("attributes"))
    point = F.struct(
        F.array(attribute("session.id", "stringValue", col("user_id")), attribute("type", "stringValue", col("event_type"))).alias("attributes"),
        F.lit("1000000").alias("startTimeUnixNano"), nanos.alias("timeUnixNano"), (col("event_id") % 97).cast("string").alias("asInt"),
    )
    metric = F.struct(F.lit("token.usage").alias("name"), F.struct(F.array(point).alias("dataPoints")).alias("sum"))
    request = F.struct(
        F.array(F.struct(F.array(F.struct(F.array(record).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs"),
        F.array(F.struct(F.array(F.struct(F.array(metric).alias("metrics"))).alias("scopeMetrics"))).alias("resourceMetrics"),
    )
    return table(spark, sf_dir, "events").select(F.to_json(request).alias("value"))


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation as a transcript line."""
    role = F.col("role")
    line = F.struct(
        F.when(role == "assistant", role).otherwise("user").alias("type"), (role == "system").alias("isMeta"),
        F.struct(F.col("text").alias("content")).alias("message"),
    )
    file = F.concat(F.lit("/p/"), F.col("conv_id").cast("string"), F.lit(".jsonl"))
    return table(spark, sf_dir, "conversations").select(file.alias("file"), F.col("turn").alias("line"), F.to_json(line).alias("value"))


def agent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a line of an agent's transcript, of the kind that `blocks` gives it; a boundary follows every tenth."""
    b = blocks(spark, sf_dir)
    kind, text, col = F.col("kind"), F.col("text"), F.col
    made = lambda **fields: F.parse_json(F.to_json(F.array(F.struct(*[v.alias(k) for k, v in fields.items()]))))
    use_id = F.concat_ws("-", F.lit("u"), col("file_id"), col("tool_use_id"))
    listed = F.to_variant_object(F.array(
        F.struct(F.lit("text").alias("type"), text.alias("text")), F.struct(F.lit("image").alias("type"), F.lit("").alias("text"))
    ))
    asked = F.struct(text.alias("pattern"), F.array(F.struct(F.lit("deep").alias("in"))).alias("more"))
    content = (
        F.when(kind == "tool_result", made(type=F.lit("tool_result"), tool_use_id=use_id, is_error=col("is_error"), content=F.when(col("file_id") % 2 == 0, listed).otherwise(text.cast("variant"))))
        .when(kind == "tool_use", made(type=F.lit("tool_use"), id=use_id, name=col("tool"), input=asked))
        .when(kind == "thinking", made(type=F.lit("thinking"), thinking=text))
        .when(kind == "assistant_text", made(type=F.lit("text"), text=text))
        .otherwise(text.cast("variant"))
    )
    call = F.concat_ws("-", col("file_id"), F.expr("pos div 2"))
    # usage comes with each line of a call; only some split what was written to the cache
    split = F.when(col("file_id") % 2 == 0, F.struct(col("est_tokens").alias("ephemeral_5m_input_tokens"), F.lit(3).alias("ephemeral_1h_input_tokens")))
    usage = F.struct(col("est_tokens").alias("input_tokens"), F.expr("pos div 2").alias("output_tokens"), (col("file_id") % 7).alias("cache_read_input_tokens"), split.alias("cache_creation"))
    usage = F.when(~kind.isin("user_text", "meta_text", "tool_result") & (col("pos") % 9 != 1), usage)
    line = F.struct(
        F.when(kind.isin("user_text", "meta_text", "tool_result"), "user").otherwise("assistant").alias("type"), (kind == "meta_text").alias("isMeta"),
        F.timestamp_micros("ts_us").alias("timestamp"), F.concat(F.lit("r"), call).alias("requestId"),
        F.when(col("file_id") % 3 == 0, F.concat(F.lit("p"), col("file_id").cast("string"))).alias("promptId"),
        F.struct(F.concat(F.lit("m"), call).alias("id"), F.lit("m").alias("model"), content.alias("content"), usage.alias("usage")).alias("message"),
    )
    file = F.concat(F.lit("/p/"), col("file_id").cast("string"), F.lit(".jsonl")).alias("file")
    utc = {"timeZone": "UTC", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX"}
    said = b.select(file, (col("pos") * 2).alias("line"), F.to_json(line, utc).alias("value"))
    cut = F.struct(
        F.lit("system").alias("type"), F.lit("compact_boundary").alias("subtype"), F.timestamp_micros("ts_us").alias("timestamp"),
        F.struct(F.lit("auto").alias("trigger"), (col("pos") * 100).alias("preTokens")).alias("compactMetadata"),
    )
    return said.unionByName(b.where("pos % 10 = 9").select(file, (col("pos") * 2 + 1).alias("line"), F.to_json(cut, utc).alias("value")))


VIEWS = f"""WITH v_request AS (SELECT event_id AS request_id, user_id AS session_id,
  CAST({EPOCH_US} + floor((epoch_us(ts) - {EPOCH_US}) / {SQUEEZE}.0) AS BIGINT) AS ts_us,
  CASE WHEN event_type IN ('click','view','purchase') THEN 'opus' WHEN event_type = 'signup' THEN 'haiku' ELSE 'local' END AS model,
  event_id % 97 AS input_tokens, CAST(floor(value * 10) AS BIGINT) AS output_tokens,
  CAST(CASE WHEN event_type = 'error' THEN 0 WHEN event_id % 7 = 0 THEN 1000 ELSE 20000 + (event_id % 5) * 500 END AS BIGINT) AS cache_read,
  CAST(CASE WHEN event_type = 'error' THEN 0 ELSE (event_id % 11) * 400 END AS BIGINT) AS cache_write,
  CAST(CASE WHEN event_id % 3 <> 0 THEN (event_id % 2) * 1000 END AS BIGINT) AS write_5m,
  CAST(CASE WHEN event_id % 3 <> 0 THEN 500 END AS BIGINT) AS write_1h, (event_id % 8)::DOUBLE / 8 AS cost_usd, 'req-' || event_id AS harness_request_id FROM events),
v_compaction AS (SELECT DISTINCT session_id, ts_us FROM v_request WHERE request_id % 25 = 0),
v_block0 AS (SELECT *, CASE WHEN role = 'system' THEN 'meta_text' WHEN role = 'user' AND turn % 4 = 2 THEN 'tool_result' WHEN role = 'user' THEN 'user_text'
  WHEN turn % 4 = 3 THEN 'thinking' WHEN turn % 6 = 5 THEN 'tool_use' ELSE 'assistant_text' END AS kind,
  CASE conv_id % 4 WHEN 0 THEN 'Read' WHEN 1 THEN 'Grep' WHEN 2 THEN 'Bash' ELSE 'mcp__kb__get' END AS t FROM conversations WHERE strlen(text) > 0),
v_block AS (SELECT conv_id * 1000 + turn AS block_id, conv_id % 150 AS session_id, conv_id AS file_id, turn AS pos,
  {EPOCH_US} + (conv_id * 7919 + turn * 131) % 21600 * 1000000 AS ts_us, kind,
  CASE WHEN kind IN ('tool_use','tool_result') THEN t ELSE '' END AS tool,
  CASE WHEN kind IN ('tool_use','tool_result') AND t LIKE 'mcp%' THEN 'kb' ELSE '' END AS mcp_server,
  CASE WHEN kind IN ('tool_use','tool_result') AND conv_id % 4 = 0 THEN '/p/f' || (conv_id % 7) ELSE '' END AS file_path,
  CASE WHEN kind IN ('tool_use','tool_result') THEN turn // 8 END AS tool_use_id, strlen(text)::BIGINT AS byte_len, ((strlen(text) + 3) // 4)::BIGINT AS est_tokens, substr(sha256(text), 1, 16) AS content_hash,
  turn % 5 = 4 AS is_error, (conv_id % 3)::INT AS referenced, text FROM v_block0),
v_session AS (SELECT r.session_id, coalesce(n_name, '') AS project, 'S-' || r.session_id AS slug,
  CASE WHEN r.session_id % 2 = 0 THEN 'Task ' || r.session_id ELSE '' END AS title, min(ts_us) AS started_us, max(ts_us) AS ended_us,
  '/work/' || lower(coalesce(n_name, 'none')) || '/' || r.session_id AS cwd, 'ses_' || lpad(r.session_id::VARCHAR, 6, '0') AS harness_id, r.session_id // 2 AS source_id
  FROM v_request r LEFT JOIN nation ON r.session_id % 25 = n_nationkey GROUP BY ALL),
v_gw0 AS (SELECT *, row_number() OVER (PARTITION BY session_id, model ORDER BY ts_us, request_id) AS k FROM v_request),
v_gw AS (SELECT request_id AS pg_id, ts_us - (request_id % 120) * 1000000 AS ts_us, CASE WHEN request_id % 3 = 0 THEN '' ELSE session_id::VARCHAR END AS session_id,
  session_id AS owner, model, CASE WHEN model = 'haiku' THEN 'chat' ELSE 'anthropic' END AS api_class, 200 AS status,
  input_tokens, output_tokens, cache_read, cache_write, write_5m, write_1h,
  CASE WHEN request_id % 17 = 0 THEN 'tX' ELSE 't' END || ',' || CASE WHEN request_id % 19 = 0 THEN 'sX' ELSE 's' END || ',' ||
  array_to_string(list_transform(range(0, k + 1), lambda i: 'm' || i || CASE WHEN request_id % 13 = 0 AND i = k // 2 THEN 'X' ELSE '' END
   || CASE WHEN request_id % 2 = 0 AND i = k THEN 'Y' ELSE '' END), ',') AS chain,
  CASE WHEN request_id % 29 = 0 AND request_id % 3 <> 0 THEN 'opus' ELSE '' END AS resolved_via
  FROM v_gw0 WHERE request_id % 4 <> 0 AND NOT (model = 'haiku' AND request_id % 3 = 0)),
v_trial AS (SELECT o_orderkey % 20 AS run_id, o_orderpriority AS arm, o_orderkey AS trial_id,
  CASE o_orderstatus WHEN 'O' THEN 'ok' WHEN 'F' THEN 'fail' ELSE 'timeout' END AS status, o_custkey * 10 AS duration_ms,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS cost_usd, 
  CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 2 = 0 THEN 'tree' ELSE 'lines' END AS harness, 'm' || (o_orderkey % 3) AS model, '/runs/' || (o_orderkey % 110) AS transcript_root,
  list_filter([CASE WHEN o_orderkey % 2 <> 0 THEN 'build' END, CASE WHEN o_orderkey % 3 <> 0 THEN 'tests' END], lambda x: x IS NOT NULL) AS failed FROM orders)
"""

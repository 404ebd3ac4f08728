"""The registered usage queries: what each computes on the derived tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.functions import times
from usagelens.operators import cache, merge, pairing, residency, rollup, search, session, trials, wire
from usagelens.plans import adapters as a
from usagelens.plans.adapters import VIEWS
from usagelens.sources import files, gateway, otel, part_trees, transcripts
from usagelens.streaming import telemetry

SINCE = a.EPOCH_US + 3 * 3600 * 1000000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The derived tables of one folder, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.of = lambda make: make(spark, sf_dir)
        self.raw = lambda name: a.table(spark, sf_dir, name)

    requests = property(lambda self: self.of(a.requests))
    compactions = property(lambda self: self.of(a.compactions))
    blocks = property(lambda self: self.of(a.blocks))
    sessions = property(lambda self: self.of(a.sessions))
    gateway = property(lambda self: self.of(a.gateway))
    trials = property(lambda self: self.of(a.trials))
    exports = property(lambda self: self.of(a.otel_exports))
    lines = property(lambda self: self.of(a.transcript_lines))
    agent_lines = property(lambda self: self.of(a.agent_lines))
    sources = property(lambda self: self.of(a.sources))
    request_events = property(lambda self: self.of(a.request_events))

    def tree(self, kind: str) -> DataFrame:
        rows = part_trees.decoded(self.of(lambda *at: a.tree_objects(*at, kind)), kind, "session_id", part_trees.PARENTS[kind])
        return rows.withColumn("messageID", F.col("message_id")) if kind == "part" else rows

    @property
    def tree_entries(self) -> DataFrame:
        return part_trees.entries(self.tree("part"), self.tree("message"))

    @property
    def transitions(self) -> DataFrame:
        return cache.transitions(self.requests, self.compactions)

    @property
    def wire_rows(self) -> DataFrame:
        return self.gateway.withColumn("session_id", F.col("owner")).withColumnRenamed("pg_id", "request_id")

    @property
    def wire(self) -> DataFrame:
        marks = self.wire_rows.where("request_id % 25 = 0").select("session_id", "ts_us")
        return wire.transitions(self.wire_rows, marks)

    @property
    def resident(self) -> DataFrame:
        return residency.resident(self.blocks, self.requests, self.compactions)

    @property
    def versions(self) -> DataFrame:
        """Requests in two versions: as they are, and half of them changed later."""
        first = self.requests.withColumn("seq", F.lit(0))
        return first.unionByName(first.where("request_id % 2 = 0").withColumns({"seq": F.lit(1), "output_tokens": F.col("output_tokens") + 5}))


def register(name: str, make: Callable[[Tables], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = VIEWS + sql


_SUMS = "count(*) AS requests, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cache_read)::BIGINT AS cache_read, sum(cache_write)::BIGINT AS cache_write"
_LABEL = "CASE WHEN title <> '' THEN s.session_id || ' — ' || title ELSE s.session_id::VARCHAR END"
register("rollup_model", lambda t: rollup.usage(t.requests, t.sessions, "model"), f"SELECT model AS key, {_SUMS} FROM v_request GROUP BY 1")
register(
    "rollup_project", lambda t: rollup.usage(t.requests, t.sessions, "project", SINCE),
    f"SELECT coalesce(nullif(project, ''), '(unknown)') AS key, {_SUMS} FROM v_request JOIN v_session s USING (session_id) WHERE ts_us >= {SINCE} GROUP BY 1",
)
register(
    "rollup_session", lambda t: rollup.usage(t.requests, t.sessions, "session"),
    f"SELECT {_LABEL} AS key, {_SUMS} FROM v_request r JOIN v_session s ON r.session_id = s.session_id GROUP BY 1",
)
register(
    "rollup_totals", lambda t: rollup.usage_totals(t.requests),
    f"SELECT coalesce(model, 'TOTAL') AS model, {_SUMS}, sum(cache_read)::DOUBLE / nullif(sum(input_tokens + cache_read + cache_write), 0) AS cached_share FROM v_request GROUP BY ROLLUP (model)",
)
register(
    "session_granular_since", lambda t: rollup.usage(rollup.since_session(t.requests, t.requests, SINCE + 2 * 3600 * 1000000), t.sessions, "model"),
    f"SELECT model AS key, {_SUMS} FROM v_request WHERE session_id IN (SELECT session_id FROM v_request WHERE ts_us >= {SINCE + 2 * 3600 * 1000000}) GROUP BY 1",
)
_ATTR = "count(*) AS blocks, sum(is_error::INT)::BIGINT AS errors, sum(byte_len)::BIGINT AS byte_len, sum(est_tokens)::BIGINT AS est_tokens"
for _name, _col in (("tool", "tool"), ("mcp", "mcp_server"), ("file", "file_path"), ("kind", "kind")):
    register(
        f"attr_{_name}", lambda t, c=_col: rollup.attribution(t.blocks, c),
        f"SELECT {_col} AS key, {_ATTR} FROM v_block WHERE {_col} <> '' GROUP BY 1",
    )
    register(
        f"residency_{_name}", lambda t, c=_col: residency.rollup(t.resident, c),
        f", RES AS (RESIDENT) SELECT {_col} AS key, count(*) AS blocks, sum(est_tokens)::BIGINT AS flow, sum(resident_tokens)::BIGINT AS resident, sum(resident_tokens)::DOUBLE / nullif(sum(est_tokens), 0) AS mean_requests FROM RES WHERE {_col} <> '' GROUP BY 1",
    )
register(
    "attr_share", lambda t: rollup.with_share(rollup.attribution(t.blocks, "tool", from_us=SINCE), "est_tokens"),
    f"SELECT tool AS key, {_ATTR}, sum(est_tokens)::DOUBLE / sum(sum(est_tokens)) OVER () AS share FROM v_block WHERE tool <> '' AND ts_us >= {SINCE} GROUP BY 1",
)
register(
    "calibration", lambda t: rollup.calibration(t.requests, t.blocks),
    """SELECT * FROM (SELECT sum(input_tokens + cache_write)::BIGINT AS metered_in, sum(output_tokens)::BIGINT AS metered_out FROM v_request),
    (SELECT coalesce(sum(est_tokens) FILTER (kind NOT IN ('assistant_text','thinking','tool_use')), 0)::BIGINT AS estimated_in,
     coalesce(sum(est_tokens) FILTER (kind IN ('assistant_text','thinking','tool_use')), 0)::BIGINT AS estimated_out FROM v_block)""",
)
register(
    "repeat_reads", lambda t: rollup.repeat_reads(t.blocks, 50),
    """SELECT session_id, file_path, count(*) AS reads, count(DISTINCT content_hash) AS versions, sum(est_tokens)::BIGINT AS tokens, (sum(est_tokens) - max(est_tokens))::BIGINT AS repeated_tokens
    FROM v_block WHERE kind = 'tool_result' AND file_path <> '' GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY repeated_tokens DESC, session_id, file_path LIMIT 50""",
)
register(
    "biggest_results", lambda t: rollup.biggest_results(t.blocks),
    "SELECT block_id, session_id, tool, file_path, byte_len, est_tokens FROM v_block WHERE kind = 'tool_result' ORDER BY est_tokens DESC, block_id LIMIT 15",
)
register(
    "table_counts", lambda t: rollup.table_counts({"request": t.requests, "block": t.blocks, "compaction": t.compactions, "session": t.sessions}),
    "SELECT 'request' AS name, count(*) AS n FROM v_request UNION ALL SELECT 'block', count(*) FROM v_block UNION ALL SELECT 'compaction', count(*) FROM v_compaction UNION ALL SELECT 'session', count(*) FROM v_session",
)
register(
    "block_estimates", lambda t: t.blocks.select("block_id", "byte_len", "est_tokens", "mcp_server"),
    "SELECT block_id, byte_len, est_tokens, mcp_server FROM v_block",
)
register("content_hash", lambda t: t.blocks.select("block_id", "content_hash"), "SELECT block_id, content_hash FROM v_block")
_GW = "count(*) AS rows, min(ts_us) AS first_us, max(ts_us) AS last_us, count(output_tokens) AS with_usage, count(*) FILTER (session_id <> '') AS with_session, max(len(string_split(chain, ',')))::INT AS longest_chain"
register("gw_status_class", lambda t: rollup.gateway_status(t.gateway, True), f"SELECT api_class, {_GW} FROM v_gw GROUP BY 1")
register("gw_status", lambda t: rollup.gateway_status(t.gateway, False), f"SELECT {_GW} FROM v_gw")
register("projects", lambda t: rollup.projects(t.sessions), "SELECT project, max(greatest(started_us, ended_us)) AS last_us FROM v_session WHERE project <> '' GROUP BY 1")
_LIST = "s.session_id, project, slug, title, greatest(started_us, ended_us) AS last_us"
register(
    "session_list", lambda t: rollup.session_list(t.sessions, t.requests, text="task"),
    f"SELECT {_LIST}, count(*) AS requests, sum(input_tokens + output_tokens + cache_read + cache_write)::BIGINT AS tokens FROM v_session s JOIN v_request r ON r.session_id = s.session_id WHERE lower(title) LIKE '%task%' GROUP BY ALL ORDER BY last_us DESC, s.session_id LIMIT 100",
)
register(
    "session_list_by_folder", lambda t: rollup.session_list(t.sessions, t.requests, text="/WORK/nation_1"),
    f"SELECT {_LIST}, count(*) AS requests, sum(input_tokens + output_tokens + cache_read + cache_write)::BIGINT AS tokens FROM v_session s JOIN v_request r ON r.session_id = s.session_id WHERE cwd ILIKE '%/WORK/nation_1%' GROUP BY ALL ORDER BY last_us DESC, s.session_id LIMIT 100",
)
register(
    "session_list_by_id", lambda t: rollup.session_list(t.sessions, t.requests, text="es_0000_7"),
    f"SELECT {_LIST}, count(*) AS requests, sum(input_tokens + output_tokens + cache_read + cache_write)::BIGINT AS tokens FROM v_session s JOIN v_request r ON r.session_id = s.session_id WHERE harness_id LIKE '%es_0000_7%' GROUP BY ALL ORDER BY last_us DESC, s.session_id LIMIT 100",
)
register(
    "session_by_prefix", lambda t: rollup.by_prefix(t.sessions, "s-1", "slug").orderBy(F.desc("ended_us"), "session_id").limit(1).select("session_id", "slug", "ended_us"),
    "SELECT session_id, slug, ended_us FROM v_session WHERE slug ILIKE 's-1%' ORDER BY ended_us DESC, session_id LIMIT 1",
)

# cache doctor
_CACHE = """, C0 AS (SELECT r.*, (SELECT max(c.ts_us) FROM v_compaction c WHERE c.session_id = r.session_id AND c.ts_us <= r.ts_us) AS boundary_us FROM v_request r),
C1 AS (SELECT *, lag(ts_us) OVER w AS prev_us, lag(write_5m) OVER w AS prev_5m, lag(write_1h) OVER w AS prev_1h, lag(input_tokens + cache_read + cache_write) OVER w AS expected, lag(cache_read + cache_write) OVER w AS prev_cached
  FROM C0 WINDOW w AS (PARTITION BY session_id, model ORDER BY ts_us, request_id)),
C2 AS (SELECT *, greatest(0, expected - cache_read) AS lost FROM C1 WHERE prev_us IS NOT NULL AND cache_read + cache_write + prev_cached > 0 AND expected >= 1024),
CT AS (SELECT request_id, session_id, model, ts_us, expected, cache_read, least(cache_read, expected) AS reused, lost >= 4096 AND cache_read < 0.8 * expected AS is_event,
  CASE WHEN lost >= 4096 AND cache_read < 0.8 * expected THEN lost ELSE 0 END::BIGINT AS shortfall,
  CASE WHEN NOT (lost >= 4096 AND cache_read < 0.8 * expected) THEN 'healthy' WHEN boundary_us > prev_us THEN 'compaction'
   WHEN ts_us - prev_us > 3600000000 OR (ts_us - prev_us > 300000000 AND coalesce(prev_5m, 0) > coalesce(prev_1h, 0)) THEN 'ttl_expiry' ELSE 'history_edit' END AS cause FROM C2)
"""
register("cache_transitions", lambda t: t.transitions, _CACHE + "SELECT * FROM CT")
register("cache_events", lambda t: t.transitions.where("is_event").select("request_id", "session_id", "model", "cause", "shortfall"), _CACHE + "SELECT request_id, session_id, model, cause, shortfall FROM CT WHERE is_event")
_SCORES = "SELECT CT.session_id, any_value(n) AS requests, count(*) FILTER (is_event) AS events, sum(expected)::BIGINT AS expected, sum(reused)::BIGINT AS reused, sum(shortfall)::BIGINT AS shortfall, sum(reused)::DOUBLE / sum(expected) AS reuse FROM CT JOIN (SELECT session_id, count(*) AS n FROM v_request GROUP BY 1) q ON q.session_id = CT.session_id GROUP BY 1"
register("cache_session_scores", lambda t: cache.session_scores(t.transitions, t.requests), _CACHE + _SCORES)
register("worst_sessions", lambda t: cache.worst_sessions(cache.session_scores(t.transitions, t.requests)), f"{_CACHE} SELECT * FROM ({_SCORES}) WHERE events > 0 ORDER BY shortfall DESC, session_id LIMIT 10")
register("cache_by_cause", lambda t: cache.by_cause(t.transitions), _CACHE + "SELECT cause, count(*) AS events, sum(shortfall)::BIGINT AS shortfall FROM CT WHERE is_event GROUP BY 1")
register(
    "cache_summary", lambda t: cache.summary(t.transitions),
    _CACHE + "SELECT count(*) AS scored, count(*) FILTER (is_event) AS events, sum(expected)::BIGINT AS expected, sum(reused)::BIGINT AS reused, sum(shortfall)::BIGINT AS shortfall FROM CT",
)
register(
    "cache_drilldown", lambda t: cache.drilldown(t.transitions, t.requests, 7),
    _CACHE + "SELECT r.request_id, r.ts_us, r.model, r.cache_read, coalesce(cause, '') AS note, coalesce(shortfall, 0) AS shortfall FROM v_request r LEFT JOIN (SELECT * FROM CT WHERE is_event) e ON e.request_id = r.request_id WHERE r.session_id = 7",
)

# wire doctor
_WIRE = """, W0 AS (SELECT pg_id AS request_id, owner AS session_id, model, ts_us, input_tokens, cache_read, cache_write, write_5m, write_1h, string_split(chain, ',') AS c FROM v_gw),
W1 AS (SELECT r.*, (SELECT max(b.ts_us) FROM W0 b WHERE b.session_id = r.session_id AND b.request_id % 25 = 0 AND b.ts_us <= r.ts_us) AS boundary_us FROM W0 r),
W2 AS (SELECT *, lag(c) OVER w AS p, lag(ts_us) OVER w AS prev_us, lag(write_5m) OVER w AS prev_5m, lag(write_1h) OVER w AS prev_1h, lag(input_tokens + cache_read + cache_write) OVER w AS expected FROM W1 WINDOW w AS (PARTITION BY session_id, model ORDER BY ts_us, request_id)),
W3 AS (SELECT *, coalesce(list_position(list_transform(list_zip(p, c), lambda z: z[1] IS NOT DISTINCT FROM z[2]), false) - 1, least(len(p), len(c))) AS common FROM W2 WHERE p IS NOT NULL),
W4 AS (SELECT *, (ts_us - prev_us) // 1000000 * 1000000 AS gap, greatest(0, expected - cache_read) AS lost, CASE WHEN boundary_us > prev_us THEN 'compaction' WHEN common = len(p) AND common = len(c) THEN 'identical' WHEN common = len(p) THEN 'append'
  WHEN common = len(c) THEN 'truncated' WHEN common = len(p) - 1 AND len(p) >= 4 THEN 'marker_rotation' WHEN common = 0 THEN 'tools_changed' WHEN common = 1 THEN 'system_changed' ELSE 'history_edit' END AS k FROM W3),
WT AS (SELECT request_id, session_id, model, ts_us, common::INT AS common, CASE WHEN k = 'history_edit' THEN common - 2 END::INT AS edit_index,
  expected >= 1024 AND lost >= 4096 AND cache_read < 0.8 * expected AS is_event, CASE WHEN expected >= 1024 THEN expected ELSE 0 END::BIGINT AS expected, CASE WHEN expected >= 1024 THEN lost ELSE 0 END::BIGINT AS shortfall,
  CASE WHEN NOT (expected >= 1024 AND lost >= 4096 AND cache_read < 0.8 * expected) OR k = 'compaction' THEN k WHEN gap > 3600000000 OR (gap > 300000000 AND coalesce(prev_5m, 0) > coalesce(prev_1h, 0)) THEN 'ttl_expiry'
   WHEN k IN ('append','identical','marker_rotation') THEN 'unexplained_miss' ELSE k END AS class FROM W4)
"""
register("wire_transitions", lambda t: t.wire, _WIRE + "SELECT * FROM WT")
register("wire_events", lambda t: t.wire.where("is_event").select("request_id", "class", "shortfall"), _WIRE + "SELECT request_id, class, shortfall FROM WT WHERE is_event")
register("wire_by_class", lambda t: wire.by_class(t.wire), _WIRE + "SELECT class, count(*) AS transitions, count(*) FILTER (is_event) AS events, sum(CASE WHEN is_event THEN shortfall ELSE 0 END)::BIGINT AS shortfall FROM WT GROUP BY 1")
register(
    "wire_summary", lambda t: wire.summary(t.wire_rows, t.wire),
    _WIRE + "SELECT (SELECT count(*) FROM (SELECT 1 FROM v_gw GROUP BY owner, model HAVING count(*) >= 2)) AS streams, count(*) AS transitions, count(*) FILTER (is_event) AS events FROM WT",
)
register("wire_worst_sessions", lambda t: wire.worst_sessions(t.wire), _WIRE + "SELECT session_id, count(*) AS events, sum(shortfall)::BIGINT AS shortfall FROM WT WHERE is_event GROUP BY 1 ORDER BY shortfall DESC, session_id LIMIT 10")

# residency: the SQL counts requests per block directly
_RESIDENT = """SELECT e.*, (SELECT count(*) FROM v_request r WHERE r.session_id = e.session_id AND r.ts_us > e.ts_us AND (e.stop IS NULL OR r.ts_us < e.stop)) AS requests,
 (SELECT count(*) FROM v_request r WHERE r.session_id = e.session_id AND r.ts_us > e.ts_us AND (e.stop IS NULL OR r.ts_us < e.stop)) * est_tokens AS resident_tokens
 FROM (SELECT b.*, least((SELECT min(c.ts_us) FROM v_compaction c WHERE c.session_id = b.session_id AND c.ts_us > b.ts_us),
  CASE WHEN b.kind = 'thinking' THEN (SELECT min(u.ts_us) FROM v_block u WHERE u.session_id = b.session_id AND u.kind = 'user_text' AND u.ts_us > b.ts_us) END) AS stop FROM v_block b) e"""
_TOP = "block_id, session_id, kind, coalesce(nullif(file_path, ''), nullif(tool, ''), nullif(mcp_server, ''), '') AS origin, est_tokens, requests, resident_tokens"
for _k, _v in list(ORACLES.items()):
    ORACLES[_k] = _v.replace("(RESIDENT)", f"({_RESIDENT})")
_RES = f", RES AS ({_RESIDENT}) "
register("residency_blocks", lambda t: t.resident.select("block_id", "kind", "est_tokens", "requests", "resident_tokens"), _RES + "SELECT block_id, kind, est_tokens, requests, resident_tokens FROM RES")
register("top_residents", lambda t: residency.top(t.resident), _RES + f"SELECT {_TOP} FROM RES ORDER BY resident_tokens DESC, block_id LIMIT 15")
register("stale_passengers", lambda t: residency.stale(t.resident), _RES + f"SELECT {_TOP} FROM RES WHERE kind = 'tool_result' AND referenced = 2 ORDER BY resident_tokens DESC, block_id LIMIT 15")
register(
    "stale_share", lambda t: residency.stale_share(t.resident),
    _RES + "SELECT coalesce(sum(resident_tokens), 0)::BIGINT AS known, coalesce(sum(resident_tokens) FILTER (referenced = 2), 0)::BIGINT AS unreferenced FROM RES WHERE kind = 'tool_result' AND referenced <> 0",
)
register(
    "residency_coverage", lambda t: residency.coverage(t.resident, t.requests),
    _RES + "SELECT (SELECT sum(resident_tokens)::BIGINT FROM RES) AS resident, sum(input_tokens + cache_read + cache_write)::BIGINT AS metered FROM v_request",
)

# one session
_POINTS = """, PT AS (SELECT request_id, session_id, model, ts_us, (row_number() OVER w - 1)::INT AS idx, input_tokens + cache_read + cache_write AS prompt_tokens,
 (SELECT max(c.ts_us) FROM v_compaction c WHERE c.session_id = r.session_id AND c.ts_us <= r.ts_us) AS b, lag(ts_us) OVER w AS prev FROM v_request r WINDOW w AS (PARTITION BY session_id ORDER BY ts_us, request_id)),
PX AS (SELECT request_id, session_id, model, ts_us, idx, prompt_tokens, CASE WHEN prev IS NULL OR b IS NULL THEN b IS NOT NULL ELSE b > prev END AS compacted FROM PT)
"""
register("session_points", lambda t: session.points(t.requests, t.compactions), _POINTS + "SELECT * FROM PX")
_ASOF = _POINTS + """, AO AS (SELECT block_id, session_id, coalesce((SELECT min(idx) FROM PX p WHERE p.session_id = b.session_id AND p.ts_us >= b.ts_us), (SELECT max(idx) FROM PX p WHERE p.session_id = b.session_id)) AS request_idx, kind, est_tokens FROM v_block b)
"""
register("block_to_request_asof", lambda t: session.block_to_request(t.blocks, t.requests), _ASOF + "SELECT block_id, session_id, request_idx FROM AO WHERE request_idx IS NOT NULL")
_KIND_SUMS = ", ".join(f"coalesce(sum(est_tokens) FILTER (kind = '{k}'), 0)::BIGINT AS {k}" for k in session.KINDS)
register(
    "session_buckets", lambda t: session.buckets(t.blocks, t.requests),
    _ASOF + f"SELECT AO.session_id, (request_idx // ceil(n / 60.0)::BIGINT)::BIGINT AS bucket, {_KIND_SUMS} FROM AO JOIN (SELECT session_id, count(*) AS n FROM v_request GROUP BY 1) q ON q.session_id = AO.session_id GROUP BY 1, 2",
)
register(
    "session_totals", lambda t: session.totals(t.requests),
    "SELECT session_id, count(*) AS requests, sum(input_tokens + cache_read + cache_write)::BIGINT AS prompt_tokens, sum(output_tokens)::BIGINT AS output_tokens, string_agg(DISTINCT model, ',' ORDER BY model) AS models, min(ts_us) AS started_us, max(ts_us) AS ended_us FROM v_request GROUP BY 1",
)
_PLACES = " ".join(f"WHEN '{k}' THEN {i + 1}" for i, k in enumerate(session.KINDS))
register("kind_composition", lambda t: session.composition(t.blocks), f"SELECT kind, CASE kind {_PLACES} END::BIGINT AS place, sum(est_tokens)::BIGINT AS est_tokens, sum(est_tokens)::DOUBLE / sum(sum(est_tokens)) OVER () AS share FROM v_block GROUP BY 1")
for _name, _col in (("tools", "tool"), ("files", "file_path")):
    register(
        f"session_top_{_name}", lambda t, c=_col: session.most(t.blocks, c),
        f"SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY est_tokens DESC, key)::INT AS rank FROM (SELECT session_id, {_col} AS key, count(*) AS blocks, sum(est_tokens)::BIGINT AS est_tokens FROM v_block WHERE {_col} <> '' GROUP BY 1, 2) QUALIFY rank <= 10",
    )
register(
    "timeline_downsample", lambda t: session.downsampled(session.points(t.requests, t.compactions), t.transitions),
    _POINTS + _CACHE + """, TD AS (SELECT PX.*, count(*) OVER (PARTITION BY PX.session_id) AS n, CASE WHEN e.request_id IS NOT NULL THEN 2 WHEN compacted THEN 1 ELSE 0 END AS m FROM PX LEFT JOIN (SELECT request_id FROM CT WHERE is_event) e ON e.request_id = PX.request_id)
    SELECT session_id, (CASE WHEN n <= 72 THEN idx ELSE ((idx + 1) * 72 - 1) // n END)::BIGINT AS "column", max(prompt_tokens) AS prompt_tokens, max(m) AS mark FROM TD GROUP BY 1, 2""",
)

# merges
_VERSIONS = ", V AS (SELECT *, 0 AS seq FROM v_request UNION ALL SELECT * REPLACE (output_tokens + 5 AS output_tokens), 1 FROM v_request WHERE request_id % 2 = 0) "
register("dedupe_first", lambda t: merge.first_wins(t.versions, ["request_id"], ["seq"]).select("request_id", "output_tokens", "seq"), _VERSIONS + "SELECT request_id, output_tokens, seq FROM V QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY seq) = 1")
register(
    "dedupe_last", lambda t: merge.last_wins(t.versions, ["request_id"], ["seq"], first=("session_id",)).select("request_id", "session_id", "output_tokens", "seq"),
    _VERSIONS + "SELECT request_id, session_id, output_tokens, seq FROM V QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY seq DESC) = 1",
)
register(
    "block_merge",
    lambda t: merge.merge_blocks(
        t.blocks.select((F.col("block_id") % 97).alias("key"), F.col("block_id").alias("seq"), "session_id", "byte_len", "content_hash", "referenced", F.when(F.col("referenced") == 1, F.col("ts_us")).alias("first_ref_us"))
    ),
    "SELECT block_id % 97 AS key, arg_min(session_id, block_id) AS session_id, arg_max(byte_len, block_id) AS byte_len, arg_max(content_hash, block_id) AS content_hash, CASE WHEN max((referenced = 1)::INT) = 1 THEN 1 WHEN max((referenced = 2)::INT) = 1 THEN 2 ELSE 0 END AS referenced, min(CASE WHEN referenced = 1 THEN ts_us END) AS first_ref_us FROM v_block GROUP BY 1",
)
register(
    "session_merge",
    lambda t: merge.merge_sessions(
        t.requests.select("session_id", F.col("request_id").alias("seq"), F.when(F.col("request_id") % 3 == 0, F.concat(F.lit("t"), F.col("request_id").cast("string"))).otherwise("").alias("title"), F.lit("").alias("slug"), F.col("ts_us").alias("started_us"), F.col("ts_us").alias("ended_us"))
    ),
    "SELECT session_id, coalesce('t' || max(CASE WHEN request_id % 3 = 0 THEN request_id END), '') AS title, '' AS slug, min(ts_us) AS started_us, max(ts_us) AS ended_us FROM v_request GROUP BY 1",
)
register(
    "series_latest", lambda t: merge.series_latest(t.requests.select(F.concat_ws("/", "session_id", "model").alias("series"), F.col("output_tokens").alias("value"), "ts_us", F.col("request_id").alias("seq"))),
    "SELECT session_id || '/' || model AS series, arg_max(output_tokens, (ts_us, request_id)) AS value, max(ts_us) AS ts_us FROM v_request GROUP BY 1",
)
register(
    "tool_attribution", lambda t: merge.attribute_results(t.blocks),
    "SELECT b.block_id, b.file_id, arg_max(u.block_id, u.pos) AS use_id, coalesce(arg_max(u.tool, u.pos), '') AS used_tool FROM v_block b LEFT JOIN v_block u ON u.file_id = b.file_id AND u.tool_use_id = b.tool_use_id AND u.kind = 'tool_use' AND u.pos < b.pos WHERE b.kind = 'tool_result' GROUP BY 1, 2",
)

# pairing: greedy claims are beyond SQL; the tests hold them against a sequential model
register("gw_pairing", lambda t: pairing.pair(t.gateway, t.requests), None)
# wire analysis of what is paired: the session is the paired request's, not one the row names
register("gw_chain_rows", lambda t: wire.chain_rows(t.gateway, pairing.pair(t.gateway, t.requests), t.requests, t.sessions, SINCE), None)
register(
    "wire_paired_classes",
    lambda t: wire.by_class(wire.transitions(wire.chain_rows(t.gateway, pairing.pair(t.gateway, t.requests), t.requests, t.sessions).withColumnRenamed("pg_id", "request_id"), t.compactions)),
    None,
)


def _in_two_passes(t: Tables) -> DataFrame:
    """What came in the first half of the ids is paired first, then the rest against what is left."""
    half = t.raw("events").agg(F.floor(F.max("event_id") / 2)).first()[0] or 0
    first = pairing.pair(t.gateway.where(F.col("pg_id") <= half), t.requests.where(F.col("request_id") <= half))
    more = pairing.pair_new(t.gateway, t.requests, first, half, half)
    return first.withColumn("pass", F.lit(1)).unionByName(more.withColumn("pass", F.lit(2)))


register("gw_pairing_incremental", _in_two_passes, None)
register("model_traffic", lambda t: rollup.model_traffic(t.requests, t.gateway, pairing.pair(t.gateway, t.requests), t.sessions, "opus"), None)
register("model_totals", lambda t: rollup.model_totals(t.requests, t.gateway, pairing.pair(t.gateway, t.requests)), None)
register(
    "model_sessions", lambda t: rollup.model_sessions(t.requests, t.gateway, pairing.pair(t.gateway, t.requests), t.sessions, "opus"),
    """, S AS (SELECT session_id, input_tokens, output_tokens, ts_us, 'transcript' AS via FROM v_request WHERE model = 'opus'),
    G AS (SELECT owner AS session_id, input_tokens, output_tokens, ts_us, 'router' AS via FROM v_gw WHERE (model = 'opus' OR resolved_via = 'opus') AND session_id <> '' AND owner NOT IN (SELECT session_id FROM S)),
    B AS (SELECT session_id, count(*) AS requests, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, max(ts_us) AS last_us, via FROM (SELECT * FROM S UNION ALL SELECT * FROM G) GROUP BY session_id, via)
    SELECT B.*, title, project FROM B JOIN v_session s ON s.session_id = B.session_id ORDER BY last_us DESC, B.session_id::VARCHAR LIMIT 100""",
)
register(
    "gw_pairing_scope", lambda t: pairing.in_scope(t.gateway, t.requests, t.gateway.where("pg_id % 2 = 1").select("pg_id"), 5000, 4000).select("pg_id", "ts_us"),
    "SELECT pg_id, ts_us FROM v_gw, (SELECT min(ts_us) - 1800000000 AS lo, max(ts_us) + 1800000000 AS hi FROM v_request WHERE request_id > 4000) WHERE pg_id % 2 <> 1 AND (pg_id > 5000 OR ts_us BETWEEN lo AND hi)",
)
register(
    "otel_crosscheck", lambda t: rollup.crosscheck(otel.events(t.request_events, "app."), t.requests),
    """, E AS (SELECT event_id % 97 AS i, floor(value * 10)::BIGINT AS o, CASE WHEN event_id % 6 <> 0 AND event_id % 10 <> 3 THEN 'req-' || event_id END AS rid FROM events WHERE event_id % 9 <> 0)
    SELECT count(*) AS events, count(r.request_id) AS matched, coalesce(sum(i) FILTER (r.request_id IS NOT NULL), 0)::BIGINT AS event_input, coalesce(sum(o) FILTER (r.request_id IS NOT NULL), 0)::BIGINT AS event_output,
      coalesce(sum(r.input_tokens), 0)::BIGINT AS request_input, coalesce(sum(r.output_tokens), 0)::BIGINT AS request_output FROM E LEFT JOIN v_request r ON r.harness_request_id = E.rid""",
)

# search and transcripts
register("transcript_entries", lambda t: search.entries(t.blocks).drop("text"), "SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY pos, block_id) - 1)::INT AS ordinal, kind, tool, is_error, est_tokens FROM v_block")
register(
    "transcript_page", lambda t: search.page(t.blocks, 3, 1, 4),
    "SELECT file_id, ordinal, kind, tool, is_error, est_tokens, text FROM (SELECT *, (row_number() OVER (ORDER BY pos, block_id) - 1)::INT AS ordinal FROM v_block WHERE file_id = 3) WHERE ordinal >= 1 AND ordinal < 5",
)
_HIT = "instr(lower(text), 'the ')"
_BEGIN, _END = f"greatest(1, {_HIT} - 90)", f"least(length(text), {_HIT} + 3 + 90)"
_SNIP = f"CASE WHEN {_BEGIN} > 1 THEN '…' ELSE '' END || trim(regexp_replace(substring(text, {_BEGIN}, {_END} - {_BEGIN} + 1), '[ \\t\\n\\r]+', ' ', 'g')) || CASE WHEN {_END} < length(text) THEN '…' ELSE '' END"
register(
    "content_search", lambda t: search.search(t.blocks, "The "),
    f"SELECT session_id, (row_number() OVER w)::INT AS n, count(*) OVER (PARTITION BY session_id) AS matches, block_id, kind, {_SNIP} AS snippet FROM v_block WHERE contains(lower(text), 'the ') WINDOW w AS (PARTITION BY session_id ORDER BY file_id, pos) QUALIFY n <= 3",
)
register(
    "search_snippet", lambda t: t.blocks.where(F.lower("text").contains("the ")).select("block_id", search.snippet(F.col("text"), "the ").alias("snippet")),
    f"SELECT block_id, {_SNIP} AS snippet FROM v_block WHERE contains(lower(text), 'the ')",
)
register(
    "search_sessions", lambda t: search.search_sessions(t.sessions, t.blocks, "the "),
    """, N AS (SELECT *, greatest(started_us, ended_us) AS last_us FROM v_session ORDER BY last_us DESC, session_id LIMIT 80)
    SELECT N.session_id, slug, last_us, coalesce(m, 0) AS matches, (SELECT count(*) FROM N) = 80 AS truncated FROM N LEFT JOIN (SELECT session_id, count(*) AS m FROM v_block WHERE contains(lower(text), 'the ') GROUP BY 1) q ON q.session_id = N.session_id
    WHERE coalesce(m, 0) > 0 OR contains(lower(title), 'the ') OR contains(lower(slug), 'the ')""",
)
_TOKENS = "SELECT doc_id, flatten(list_transform(list_transform(regexp_extract_all(text, '[A-Za-z0-9_./-]+'), lambda x: regexp_replace(x, '^[./-]+|[./-]+$', '', 'g')), lambda x: CASE WHEN contains(x, '/') THEN [x, string_split(x, '/')[-1]] ELSE [x] END)) AS l FROM documents"
_DISTINCTIVE = "length(id) BETWEEN 5 AND 80 AND regexp_matches(id, '[A-Za-z]') AND regexp_matches(id, '[0-9_./-]|[a-z][A-Z]')"
register(
    "identifiers", lambda t: search.identifier_rows(t.raw("documents").select("doc_id", "text"), "text"),
    f", A AS ({_TOKENS}) SELECT doc_id, id AS identifier FROM (SELECT DISTINCT doc_id, unnest(l) AS id FROM A) WHERE {_DISTINCTIVE}",
)
_EVENTS = lambda t: t.raw("documents").select(
    (F.col("doc_id") % 40).alias("file_id"), F.col("doc_id").alias("pos"), (a.EPOCH_US + F.col("doc_id") * 1000000).alias("ts_us"),
    (F.col("doc_id") % 3 == 0).alias("is_source"), F.col("doc_id").alias("block_id"), "text",
)
_VERDICTS = f"""T AS (SELECT *, flatten(list_transform(list_transform(regexp_extract_all(text, '[A-Za-z0-9_./-]+'), lambda x: regexp_replace(x, '^[./-]+|[./-]+$', '', 'g')), lambda x: CASE WHEN contains(x, '/') THEN [x, string_split(x, '/')[-1]] ELSE [x] END)) AS l FROM S),
    I AS (SELECT file_id, pos, src, id FROM (SELECT file_id, pos, src, unnest(l) AS id, unnest(range(1, len(l) + 1)) AS i FROM T) WHERE {_DISTINCTIVE} GROUP BY file_id, pos, src, id QUALIFY src OR row_number() OVER (PARTITION BY file_id, pos ORDER BY min(i)) <= 800),
    E AS (SELECT *, coalesce(sum(src::INT) OVER (PARTITION BY file_id, id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM I),
    P AS (SELECT file_id, id, epoch, min(pos) FILTER (src) AS closer, count(*) FILTER (NOT src) AS claims FROM E GROUP BY ALL),
    C AS (SELECT P.*, ts_us FROM P LEFT JOIN S ON S.file_id = P.file_id AND S.pos = P.closer),
    H AS (SELECT E.file_id, E.pos, count(*) AS ids, count(*) FILTER (closer IS NOT NULL AND claims <= 8) AS hits, list_sort(list({{'p': closer, 't': ts_us}}) FILTER (closer IS NOT NULL AND claims <= 8)) AS h
      FROM E JOIN C ON C.file_id = E.file_id AND C.id = E.id AND C.epoch = E.epoch WHERE NOT src GROUP BY 1, 2),
    R AS (SELECT S.file_id, S.pos, coalesce(ids, 0) AS ids, coalesce(hits, 0) AS hits, CASE WHEN hits >= least(2, ids) THEN 1 WHEN hits = 0 THEN 2 ELSE 0 END AS referenced,
      CASE WHEN hits >= least(2, ids) THEN h[least(2, ids)].t END AS first_ref_us FROM S LEFT JOIN H ON H.file_id = S.file_id AND H.pos = S.pos WHERE NOT src)"""
register(
    "reference_verdicts", lambda t: search.verdicts(_EVENTS(t)),
    f""", S AS (SELECT doc_id % 40 AS file_id, doc_id AS pos, {a.EPOCH_US} + doc_id * 1000000 AS ts_us, doc_id % 3 = 0 AS src, text FROM documents), {_VERDICTS}
    SELECT file_id, pos AS block_id, ids, hits, referenced, first_ref_us FROM R""",
)
register(
    "transcript_verdicts",
    lambda t: search.verdicts(transcripts.reference_events(transcripts.blocks(transcripts.parse(t.agent_lines)))).select(F.col("file_id").alias("file"), F.col("block_id.line").alias("line"), "ids", "hits", "referenced", "first_ref_us"),
    f""", S AS (SELECT file_id, pos, ts_us, kind <> 'tool_result' AS src, CASE WHEN kind = 'tool_use' THEN text || chr(10) || 'deep' WHEN kind = 'tool_result' THEN to_json(text)::VARCHAR ELSE text END AS text FROM v_block WHERE kind <> 'meta_text'), {_VERDICTS}
    SELECT '/p/' || file_id || '.jsonl' AS file, pos * 2 AS line, ids, hits, referenced, first_ref_us FROM R""",
)
register(
    "reference_counts",
    lambda t: search.verdict_counts(search.verdicts(transcripts.reference_events(transcripts.blocks(transcripts.parse(t.agent_lines))))),
    f""", S AS (SELECT file_id, pos, ts_us, kind <> 'tool_result' AS src, CASE WHEN kind = 'tool_use' THEN text || chr(10) || 'deep' WHEN kind = 'tool_result' THEN to_json(text)::VARCHAR ELSE text END AS text FROM v_block WHERE kind <> 'meta_text'), {_VERDICTS}
    SELECT count(*) FILTER (referenced = 1) AS found, count(*) FILTER (referenced = 2) AS missing, count(*) AS results FROM R""",
)
_FILE = "'/p/' || file_id || '.jsonl'"
_SEEN = f"""SELECT {_FILE} AS file, (row_number() OVER (PARTITION BY file_id ORDER BY line) - 1)::INT AS ordinal, * EXCLUDE (file_id) FROM (
    SELECT file_id, pos * 2 AS line, kind, CASE WHEN kind = 'tool_result' THEN coalesce(last_value(CASE WHEN kind = 'tool_use' THEN tool END IGNORE NULLS) OVER (PARTITION BY file_id, tool_use_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE tool END AS tool,
      kind = 'tool_result' AND is_error AS is_error, CASE WHEN kind = 'tool_result' AND file_id % 2 = 0 THEN text || chr(10) || '[image]' ELSE text END AS text FROM v_block
    UNION ALL SELECT file_id, pos * 2 + 1, 'compaction', '', false, 'compaction (auto, pre: ' || pos * 100 || ' tokens)' FROM v_block WHERE pos % 10 = 9)"""
register(
    "transcript_reading",
    lambda t: transcripts.entries(transcripts.parse(t.agent_lines)).select("file", "ordinal", "kind", "tool", "is_error", F.when(F.col("kind") == "tool_use", F.get_json_object("text", "$.pattern")).otherwise(F.col("text")).alias("text")),
    f"SELECT file, ordinal, kind, tool, is_error, text FROM ({_SEEN})",
)
register(
    "transcript_search", lambda t: transcripts.search_lines(t.agent_lines, "the ").select("file", "n", "matches", "ordinal", "kind"),
    f", Z AS ({_SEEN}) SELECT file, (row_number() OVER w)::INT AS n, count(*) OVER (PARTITION BY file) AS matches, ordinal, kind FROM Z WHERE contains(lower(text), 'the ') WINDOW w AS (PARTITION BY file ORDER BY ordinal) QUALIFY n <= 3",
)


_TREE = """(SELECT file_id::VARCHAR AS session_id, (row_number() OVER (PARTITION BY file_id ORDER BY pos, sub) - 1)::INT AS ordinal, * EXCLUDE (file_id) FROM (
    SELECT file_id, pos, 0 AS sub, ts_us // 1000 * 1000 AS ts_us, CASE WHEN kind IN ('user_text', 'meta_text', 'tool_result') THEN 'user' ELSE 'assistant' END AS role,
      CASE kind WHEN 'meta_text' THEN 'user_text' WHEN 'tool_result' THEN 'tool_use' ELSE kind END AS kind, tool, false AS is_error, text, kind IN ('tool_use', 'tool_result') AS asks FROM v_block
    UNION ALL SELECT file_id, pos, 1, ts_us // 1000 * 1000, 'user', 'tool_result', tool, is_error, text, false FROM v_block WHERE kind = 'tool_result'))"""
register(
    "tree_entries",
    lambda t: t.tree_entries.withColumn("text", F.when(F.col("kind") == "tool_use", F.get_json_object("text", "$.pattern")).otherwise(F.col("text"))),
    f"SELECT session_id, ordinal, ts_us, role, kind, tool, is_error, text FROM {_TREE}",
)
register(
    "tree_page", lambda t: search.page_of(t.tree_entries.where("session_id = '3'"), "session_id", 1, 4).select("session_id", "ordinal", "kind", "tool", "is_error"),
    f"SELECT session_id, ordinal, kind, tool, is_error FROM {_TREE} WHERE session_id = '3' AND ordinal >= 1 AND ordinal < 5",
)
register(
    "tree_search", lambda t: search.search(t.tree_entries.withColumns({"file_id": F.col("session_id"), "pos": F.col("ordinal"), "block_id": F.col("ordinal")}), "the ").select("session_id", "n", "matches", F.col("block_id").alias("ordinal"), "kind"),
    f"SELECT session_id, (row_number() OVER w)::INT AS n, count(*) OVER (PARTITION BY session_id) AS matches, ordinal, kind FROM {_TREE} WHERE contains(lower(text), 'the ') WINDOW w AS (PARTITION BY session_id ORDER BY ordinal) QUALIFY n <= 3",
)


_MESSAGE = "lpad(file_id::VARCHAR, 9, '0') || lpad(pos::VARCHAR, 6, '0')"
register(
    "tree_requests", lambda t: part_trees.requests(t.tree("message")).select("key", "session_id", "ts_us", "model", "input_tokens", "output_tokens", "cache_read", "cache_write"),
    f"""SELECT 'oc:m' || {_MESSAGE} AS key, file_id::VARCHAR AS session_id, (ts_us // 1000 + CASE WHEN pos % 7 <> 0 THEN 1500 ELSE 0 END) * 1000 AS ts_us, 'm' || (file_id % 3) AS model,
    est_tokens AS input_tokens, pos AS output_tokens, file_id % 5 AS cache_read, 0::BIGINT AS cache_write FROM v_block WHERE kind NOT IN ('user_text', 'meta_text', 'tool_result') AND pos % 5 <> 4 AND (pos % 7 <> 0 OR pos % 14 <> 7)""",
)
register(
    "tree_blocks", lambda t: part_trees.blocks(t.tree("part"), t.tree("message")).select("key", "session_id", "ts_us", "kind", "tool", "is_error", "byte_len", "est_tokens", "content_hash"),
    f"""SELECT 'oc:pb:p' || {_MESSAGE} AS key, file_id::VARCHAR AS session_id, ts_us // 1000 * 1000 AS ts_us, CASE kind WHEN 'meta_text' THEN 'user_text' ELSE kind END AS kind, tool, kind = 'tool_result' AND is_error AS is_error,
    byte_len, est_tokens, content_hash FROM v_block WHERE kind <> 'tool_use'""",
)
register(
    "transcript_requests", lambda t: merge.first_wins(transcripts.requests(transcripts.parse(t.agent_lines)), ["key"], ["file", "line"]).select("key", "session_id", "input_tokens", "output_tokens", "cache_read_input_tokens", "write_5m", "write_1h"),
    """SELECT 'cc:m' || file_id || '-' || (pos // 2) || ':r' || file_id || '-' || (pos // 2) AS key, file_id::VARCHAR AS session_id, est_tokens AS input_tokens, pos // 2 AS output_tokens, file_id % 7 AS cache_read_input_tokens,
    CASE WHEN file_id % 2 = 0 THEN est_tokens END AS write_5m, CASE WHEN file_id % 2 = 0 THEN 3 END::BIGINT AS write_1h FROM v_block
    WHERE kind NOT IN ('user_text', 'meta_text', 'tool_result') AND pos % 9 <> 1 QUALIFY row_number() OVER (PARTITION BY file_id, pos // 2 ORDER BY pos) = 1""",
)
_KEYS = lambda rows: rows.select(F.col("request_id").alias("id"), F.col("output_tokens").alias("size"), F.col("ts_us").alias("updated"))
register(
    "changed_rows", lambda t: files.changed_rows(_KEYS(merge.last_wins(t.versions, ["request_id"], ["seq"])), _KEYS(t.requests.where(F.col("ts_us") < SINCE)), ["id"]),
    f"SELECT request_id AS id, CASE WHEN request_id % 2 = 0 THEN output_tokens + 5 ELSE output_tokens END AS size, ts_us AS updated FROM v_request WHERE request_id % 2 = 0 OR ts_us >= {SINCE}",
)


def _ingested_again(t: Tables) -> DataFrame:
    """The first three quarters of the requests and blocks, then all of both again: what is new and what repeats."""
    def again(rows: DataFrame, kind: str, key: str, order: str, last: bool) -> DataFrame:
        early = rows.where(F.col("ts_us") < SINCE)
        return merge.counted(merge.absorbed(early, rows, [key], [order], last), kind)

    return again(t.requests, "request", "request_id", "ts_us", False).unionByName(again(t.blocks.drop("text"), "block", "block_id", "ts_us", True))


register(
    "ingest_counts", _ingested_again,
    f"""SELECT 'request' AS kind, count(*) AS rows, count(*) FILTER (ts_us >= {SINCE}) AS new, count(*) FILTER (ts_us < {SINCE}) AS repeated FROM v_request
    UNION ALL SELECT 'block', count(*), count(*) FILTER (ts_us >= {SINCE}), count(*) FILTER (ts_us < {SINCE}) FROM v_block""",
)


def _with_copies(lines: DataFrame) -> DataFrame:
    """Every fifth conversation was resumed: its lines stand in a second file too."""
    copies = lines.where("cast(regexp_extract(file, '[0-9]+', 0) AS long) % 5 = 0").withColumn("file", F.replace("file", F.lit("/p/"), F.lit("/p/copy-")))
    return lines.unionByName(copies)


register(
    "transcript_unique",
    lambda t: transcripts.unique(transcripts.blocks(transcripts.parse(_with_copies(t.agent_lines)))).groupBy("session_id", "kind").agg(F.count("*").alias("blocks")),
    """, L AS (SELECT *, file_id::VARCHAR AS sid FROM v_block UNION ALL SELECT *, 'copy-' || file_id FROM v_block WHERE file_id % 5 = 0),
    K AS (SELECT sid, kind, CASE WHEN kind IN ('tool_use', 'tool_result') THEN file_id || '-' || tool_use_id WHEN kind IN ('user_text', 'meta_text') THEN CASE WHEN file_id % 3 = 0 THEN 'p' || file_id ELSE sid END || content_hash ELSE file_id || '-' || pos // 2 || content_hash END AS key,
      kind IN ('user_text', 'meta_text') AS said FROM L),
    U AS (SELECT arg_min(sid, sid) AS session_id, arg_max(kind, sid) AS kind FROM K GROUP BY key, CASE WHEN said THEN 'ut' ELSE kind END)
    SELECT session_id, kind, count(*) AS blocks FROM U GROUP BY 1, 2""",
)


def _pulled(t: Tables) -> DataFrame:
    """The request log as its origin has it, pulled whole and, from a row on, again."""
    origin = t.gateway.withColumnsRenamed({"pg_id": "id", "chain": "prefix_hash_chain"})
    return gateway.pull(origin, "router").unionByName(gateway.pull(origin, "router", after=1000))


register(
    "gateway_rows", lambda t: gateway.merged(_pulled(t)).select("key", "source", "pg_id", "session_id", F.col("chain_len").cast("long").alias("chain_len")),
    "SELECT 'router#' || pg_id AS key, 'router' AS source, pg_id, session_id, len(string_split(chain, ','))::BIGINT AS chain_len FROM v_gw",
)
register("gateway_cursors", lambda t: gateway.cursors(_pulled(t)), "SELECT 'router' AS source, max(pg_id) AS cursor FROM v_gw")

# streams on whole tables: the same plans without a trigger
_TIMED = lambda t: t.requests.withColumn("ts", F.timestamp_micros("ts_us"))
register(
    "usage_windows", lambda t: telemetry.usage_windows(_TIMED(t)).withColumn("start", F.unix_micros("start")),
    "SELECT ts_us // 600000000 * 600000000 AS start, model, count(*) AS requests, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM v_request GROUP BY 1, 2",
)
register(
    "idle_islands", lambda t: telemetry.idle_islands(_TIMED(t)).withColumns({"start": F.unix_micros("start"), "end": F.unix_micros("end")}),
    """, N AS (SELECT *, (ts_us - lag(ts_us) OVER w > 1800000000)::INT AS new FROM v_request WINDOW w AS (PARTITION BY session_id ORDER BY ts_us)),
    G AS (SELECT *, coalesce(sum(new) OVER (PARTITION BY session_id ORDER BY ts_us), 0) AS g FROM N)
    SELECT session_id, min(ts_us) AS start, max(ts_us) + 1800000000 AS end, count(*) AS requests FROM G GROUP BY session_id, g""",
)
register("session_spans", lambda t: telemetry.session_spans(t.requests), "SELECT session_id, min(ts_us) AS started_us, max(ts_us) AS ended_us FROM v_request GROUP BY 1")

# trials
_USED = """, Q AS (SELECT kind, root, count(*) AS requests, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cache_read)::BIGINT AS cache_read, sum(cache_write)::BIGINT AS cache_write, sum(cost_usd) AS c
  FROM (SELECT DISTINCT source_id, CASE WHEN source_id % 2 = 0 THEN 'tree' ELSE 'lines' END AS kind, '/runs/' || source_id AS root FROM v_session) src JOIN v_session s ON s.source_id = src.source_id JOIN v_request r ON r.session_id = s.session_id GROUP BY 1, 2),
U AS (SELECT trial_id, arm, harness, model, status, CASE WHEN status IN ('ok','fail') THEN duration_ms END AS duration_ms, coalesce(requests, 0) AS requests, input_tokens, output_tokens, cache_read, cache_write, coalesce(cost_usd, CASE WHEN c > 0 THEN c END) AS cost_usd
  FROM v_trial LEFT JOIN Q ON Q.kind = harness AND Q.root = transcript_root)
"""
_PCT = lambda name, c, p: f"list_sort(list({c}) FILTER ({c} IS NOT NULL))[least(floor(count({c}) * {p} + 0.5)::INT, count({c}) - 1) + 1] AS {name}"
register(
    "arm_comparison", lambda t: trials.compare(trials.usage(t.trials, t.sources, t.sessions, t.requests)),
    f"{_USED} SELECT arm, arg_min(harness, trial_id) AS harness, arg_min(model, trial_id) AS model, count(*) FILTER (requests = 0) AS without_usage, count(*) AS trials, count(*) FILTER (status IN ('ok','fail')) AS done, count(*) FILTER (status = 'ok') AS passed, {', '.join(_PCT(*m) for m in trials.MEASURES)} FROM U GROUP BY 1",
)
register(
    "trial_usage", lambda t: trials.usage(t.trials, t.sources, t.sessions, t.requests).select("trial_id", "arm", "requests", "cost_usd", F.coalesce("output_tokens", F.lit(0)).alias("tokens")),
    f"{_USED} SELECT trial_id, arm, requests, cost_usd, coalesce(output_tokens, 0)::BIGINT AS tokens FROM U",
)
register("run_list", lambda t: trials.runs(t.trials), "SELECT run_id, count(*) AS trials, count(*) FILTER (status IN ('ok','fail')) AS done FROM v_trial GROUP BY 1 ORDER BY run_id DESC LIMIT 20")
register("run_by_prefix", lambda t: trials.run_by_prefix(t.trials, "1"), "SELECT run_id, count(*) AS trials, count(*) FILTER (status IN ('ok','fail')) AS done FROM v_trial WHERE run_id::VARCHAR LIKE '1%' GROUP BY 1 ORDER BY run_id DESC LIMIT 1")
register("failed_checks", lambda t: trials.failed_checks(t.trials), "SELECT trial_id, array_to_string(failed, ',') AS failed FROM v_trial")
_ARMS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
register(
    "pending_trials", lambda t: trials.pending(t.trials, _ARMS, 40),
    f"SELECT run_id, arm, number FROM (SELECT DISTINCT run_id FROM v_trial), (SELECT unnest({_ARMS}) AS arm), (SELECT unnest(range(0, 40)) AS number) WHERE (run_id, arm, number) NOT IN (SELECT (run_id, arm, trial_id % 40) FROM v_trial WHERE status IN ('ok','fail'))",
)
register(
    "trial_latest", lambda t: merge.last_wins(t.trials.select("run_id", "arm", (F.col("trial_id") % 10).alias("trial_idx"), "trial_id", "status"), ["run_id", "arm", "trial_idx"], ["trial_id"]),
    "SELECT run_id, arm, trial_id % 10 AS trial_idx, max(trial_id) AS trial_id, arg_max(status, trial_id) AS status FROM v_trial GROUP BY 1, 2, 3",
)
register(
    "otel_events", lambda t: rollup.telemetry_events(otel.events(t.exports, "app.")),
    """SELECT event_type AS event, count(*) AS events, count(DISTINCT user_id) AS sessions, sum(event_id % 97)::BIGINT AS input_tokens, sum(event_id % 8)::DOUBLE / 8 AS cost_usd,
    min(epoch_us(ts) // 1000 * 1000)::BIGINT AS first_us, max(epoch_us(ts) // 1000 * 1000)::BIGINT AS last_us FROM events GROUP BY 1""",
)
register(
    "otel_tokens", lambda t: telemetry.latest_series(otel.datapoints(t.exports)).groupBy("type").agg(F.count("*").alias("series"), F.sum("value").alias("tokens")),
    """SELECT event_type AS type, count(*) AS series, sum(event_id % 97)::DOUBLE AS tokens FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) // 1000 DESC, event_id % 97 DESC) AS n FROM events) WHERE n = 1 GROUP BY 1""",
)
_SAID = "sum((strlen(text) + 3) // 4)::BIGINT AS est_tokens"
register(
    "transcript_blocks", lambda t: transcripts.blocks(transcripts.parse(t.lines)).groupBy("session_id", "kind").agg(F.count("*").alias("blocks"), F.sum("est_tokens").alias("est_tokens")),
    f"SELECT conv_id::VARCHAR AS session_id, CASE role WHEN 'assistant' THEN 'assistant_text' WHEN 'system' THEN 'meta_text' ELSE 'user_text' END AS kind, count(*) AS blocks, {_SAID} FROM conversations WHERE text <> '' GROUP BY 1, 2",
)
register(
    "ingest_stats", lambda t: transcripts.ingest_stats(t.lines),
    "SELECT count(DISTINCT conv_id) AS files, count(*) AS lines, 0::BIGINT AS parse_errors FROM conversations",
)
register(
    "input_values", lambda t: t.lines.select("file", "line", F.array_join(transcripts.string_values("value"), "\n").alias("said")),
    "SELECT '/p/' || conv_id || '.jsonl' AS file, turn AS line, concat_ws(chr(10), CASE role WHEN 'assistant' THEN role ELSE 'user' END, text) AS said FROM conversations",
)
_SOURCES = lambda t: t.raw("nation").select(
    F.lit("tree").alias("kind"), F.concat(F.lit("/src/"), F.col("n_regionkey").cast("string")).alias("root"), F.col("n_nationkey").alias("seq"),
    F.concat(F.lit("regime"), (F.col("n_nationkey") % 3).cast("string")).alias("regime"),
)
register(
    "source_merge", lambda t: merge.merge_sources(_SOURCES(t)),
    "SELECT 'tree' AS kind, '/src/' || n_regionkey AS root, max(n_nationkey) AS seq, arg_max('regime' || (n_nationkey % 3), n_nationkey) AS regime FROM nation GROUP BY n_regionkey",
)
register(
    "session_source",
    lambda t: rollup.session_source(
        t.sessions.withColumn("source_id", F.col("session_id") % 25),
        t.raw("nation").join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("source_id"), F.lower("r_name").alias("kind"), F.concat(F.lit("/src/"), F.lower("n_name")).alias("root")),
    ),
    "SELECT session_id, lower(r_name) AS kind, '/src/' || lower(n_name) AS root FROM v_session JOIN nation ON session_id % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
register(
    "two_eras",
    lambda t: merge.union_of_eras(t.versions.where("seq = 0"), t.versions.where("seq = 1"), ["request_id"], ["seq"]).groupBy("model").agg(F.count("*").alias("requests"), F.sum("output_tokens").alias("output_tokens")),
    _VERSIONS + "SELECT model, count(*) AS requests, sum(output_tokens)::BIGINT AS output_tokens FROM (SELECT * FROM V QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY seq DESC) = 1) GROUP BY 1",
)
register(
    "session_clock", lambda t: times.with_clock(t.requests).select("request_id", "session_id", "day_us", "minute_us", "new_day"),
    """SELECT request_id, session_id, ts_us // 86400000000 * 86400000000 AS day_us, ts_us // 60000000 * 60000000 AS minute_us,
    lag(ts_us // 86400000000) OVER (PARTITION BY session_id ORDER BY ts_us, request_id) IS DISTINCT FROM ts_us // 86400000000 AS new_day FROM v_request""",
)

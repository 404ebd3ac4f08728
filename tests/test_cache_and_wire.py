import time

from pyspark.sql import functions as F

from usagelens.operators import cache, residency, session, trials, wire

MIN = 60 * 1000000
REQ = "request_id long, session_id long, model string, ts_us long, input_tokens long, output_tokens long, cache_read long, cache_write long, write_5m long, write_1h long"


def run(spark, rows, marks=()):
    full = [(i, 1, *r) for i, r in enumerate(rows)]
    b = spark.createDataFrame([(1, m) for m in marks], "session_id long, ts_us long")
    return cache.transitions(spark.createDataFrame(full, REQ), b).orderBy("request_id").collect()


def row(at, i, r, w, model="opus", w5=None, w1=None):
    return (model, at * MIN, i, 1, r, w, w5, w1)


def test_healthy_requests_have_no_event(spark):
    got = run(spark, [row(0, 1000, 0, 9000), row(1, 500, 10000, 200), row(2, 300, 10700, 100)])
    assert [x.is_event for x in got] == [False, False]


def test_edit_compaction_and_expiry(spark):
    (x,) = run(spark, [row(0, 100, 0, 20000), row(1, 15000, 1000, 19000)])
    assert (x.cause, x.shortfall) == ("history_edit", 19100)
    (x,) = run(spark, [row(0, 100, 0, 20000), row(5, 5000, 0, 6000)], [3 * MIN])
    assert x.cause == "compaction"
    (x,) = run(spark, [row(0, 100, 0, 20000), row(120, 100, 0, 20000)])
    assert x.cause == "ttl_expiry"
    for w5, w1, cause in ((20000, 0, "ttl_expiry"), (0, 20000, "history_edit")):
        (x,) = run(spark, [row(0, 100, 0, 20000, w5=w5, w1=w1), row(10, 100, 0, 20000)])
        assert x.cause == cause


def test_no_cache_numbers_and_interleaved_models(spark):
    assert run(spark, [row(0, 10000, 0, 0), row(1, 12000, 0, 0)]) == []
    got = run(spark, [row(0, 100, 0, 9900), row(1, 100, 0, 9900, "haiku"), row(2, 10, 10000, 0)])
    assert not any(x.is_event for x in got)


def test_wire_classes(spark):
    base = "t,s,m0,m1,m2"
    cases = {"T2,s,m0,m1,m2": ("tools_changed", None), "t,S2,m0,m1,m2": ("system_changed", None), "t,s,M9,m1,m2": ("history_edit", 0),
             "t,s,m0,M9,extra": ("history_edit", 1), "t,s": ("truncated", None), base: ("unexplained_miss", None), "t,s,m0,m1,M9": ("unexplained_miss", None)}
    rows = []
    for i, chain in enumerate(cases):
        rows += [(2 * i, i, *row(0, 10, 0, 50000), base), (2 * i + 1, i, *row(1, 10, 0, 0), chain)]
    none = spark.createDataFrame([], "session_id long, ts_us long")
    got = {x.session_id: (x["class"], x.edit_index) for x in wire.transitions(spark.createDataFrame(rows, REQ + ", chain string"), none).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def blocks(spark, rows):
    named = spark.createDataFrame(rows, "block_id long, session_id long, ts_us long, kind string, est_tokens long")
    return named


def test_residency_bounds(spark):
    req = lambda *at: spark.createDataFrame([(1, a) for a in at], "session_id long, ts_us long")
    get = lambda b, r, c: {x.block_id: x.requests for x in residency.resident(b, r, c).collect()}
    none = spark.createDataFrame([], "session_id long, ts_us long")
    b = blocks(spark, [(1, 1, 1, "tool_result", 100), (2, 1, 5, "tool_result", 10)])
    assert get(b, req(0, 1, 2, 6, 8), none) == {1: 3, 2: 2}
    b = blocks(spark, [(1, 1, 1, "tool_result", 1), (2, 1, 6, "tool_result", 1)])
    assert get(b, req(2, 4, 7, 9), req(5)) == {1: 2, 2: 2}
    b = blocks(spark, [(1, 1, 1, "thinking", 1), (2, 1, 1, "assistant_text", 1), (3, 1, 4, "user_text", 1), (4, 2, 1, "user_text", 1)])
    got = get(b, req(2, 3, 5, 7), none)
    assert (got[1], got[2], got[4]) == (2, 4, 0)


def test_percentile_rule(spark):
    wanted = {2: 2, 3: 3, 4: 3, 5: 4}
    rows = spark.createDataFrame([(n, i) for n in wanted for i in range(1, n + 1)], "arm int, x int")
    assert {r.arm: r.value for r in trials.percentiles(rows, "arm", [("p", "x", 0.5)]).collect()} == wanted


def test_long_session_takes_one_pass(spark):
    """A session of 50,000 blocks and as many requests: frames that grow, no frame looked through again at each row."""
    n = 50_000
    blocks = spark.range(n).selectExpr(
        "id AS block_id", "1L AS session_id", "id * 10 AS ts_us", "CASE id % 3 WHEN 0 THEN 'thinking' WHEN 1 THEN 'user_text' ELSE 'tool_result' END AS kind", "2L AS est_tokens"
    )
    requests = spark.range(n).selectExpr("id AS request_id", "1L AS session_id", "id * 10 + 5 AS ts_us")
    marks = spark.range(1, 5).selectExpr("1L AS session_id", "id * 100000 + 1 AS ts_us")
    begin = time.time()
    got = {r.block_id: r.requests for r in residency.resident(blocks, requests, marks).collect()}
    place = {r.block_id: r.request_idx for r in session.block_to_request(blocks, requests).collect()}
    assert time.time() - begin < 60
    end = lambda i: next((m * 10_000 for m in range(1, 5) if m * 10_000 >= i), n)  # noqa: E731  requests before the block's boundary
    assert len(got) == n and all(got[i] == (min(end(i), i + 1) if i % 3 == 0 else min(end(i), n)) - i for i in range(0, n - 3, 7))
    assert place == {i: i for i in range(n)}

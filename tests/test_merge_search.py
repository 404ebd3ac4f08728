import random

from pyspark.sql import functions as F

from usagelens.operators import merge, pairing, rollup, search, session, trials
from usagelens.streaming import pairing as pairing_stream


def test_identifiers(spark):
    text = "Open ./lib/load_rows.py, load_rows.py; HTTPServer ERRORs -retryLimit- v2.10.7 plain Words x_1 /opt/a1/zz.cfg/"
    df = spark.createDataFrame([(text,), (None,), ("",), ("a_" * 41,)], "t string")
    got = [r[0] or [] for r in df.select(search.identifiers(F.col("t"))).collect()]
    assert got == [["lib/load_rows.py", "load_rows.py", "retryLimit", "v2.10.7", "opt/a1/zz.cfg", "zz.cfg"], [], [], []]


def sequential_verdicts(rows):
    """Text by text: results wait under their identifiers until a source names these."""
    index, results = {}, {}
    for pos, ts, source, block, ids in rows:
        if source:
            for x in ids:
                waiting = index.pop(x, [])
                for r in waiting if len(waiting) <= search.MOST_CLAIMS else []:
                    r["hits"].append(ts)
        else:
            results[block] = r = {"n": len(ids), "hits": []}
            for x in ids:
                index.setdefault(x, []).append(r)
    out = {}
    for block, r in results.items():
        need = min(2, r["n"])
        verdict = 0 if not need else 1 if len(r["hits"]) >= need else 0 if r["hits"] else 2
        out[block] = (verdict, r["hits"][need - 1] if verdict == 1 else None)
    return out


def test_verdicts_equal_a_sequential_model(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for f in range(12):
        one = []
        for pos in range(40):
            ids = sorted({f"name_{rng.randrange(25)}" for _ in range(rng.randrange(5))})
            one.append((pos, pos * 10, rng.random() < 0.25, f * 100 + pos, ids))
        rows += [(f, pos, ts, source, block, " ".join(ids)) for pos, ts, source, block, ids in one]
        want |= sequential_verdicts(one)
    df = spark.createDataFrame(rows, "file_id long, pos long, ts_us long, is_source boolean, block_id long, text string")
    got = {r.block_id: (r.referenced, r.first_ref_us) for r in search.verdicts(df).collect()}
    assert got == want and {v for v, _ in want.values()} == {0, 1, 2}


def test_downsampled_columns_are_the_ranges_of_rows(spark):
    n = 100
    shown = spark.createDataFrame([(i, 1, i, i, False) for i in range(n)], "request_id long, session_id long, idx long, prompt_tokens long, compacted boolean")
    events = spark.createDataFrame([(50, True)], "request_id long, is_event boolean")
    got = {r["column"]: (r.prompt_tokens, r.mark) for r in session.downsampled(shown, events).collect()}
    ranges = {c: range(c * n // 72, (c + 1) * n // 72) for c in range(72)}
    assert got == {c: (max(its), 2 if 50 in its else 0) for c, its in ranges.items()}


def test_percentiles_take_the_exact_index(spark):
    rng = random.Random(2)
    values = {"a": [3.0], "b": [1.0, 1.0, 2.0, 9.0], "c": [rng.choice([5.0, rng.random() ** 9 * 1e6]) for _ in range(3000)], "d": [None]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "arm string, x double")
    got = {(r.arm, r.name): r.value for r in trials.percentiles(df, "arm", [("m", "x", 0.5), ("p", "x", 0.9)]).collect()}
    at = lambda vs, p: sorted(vs)[min(int(p * len(vs) + 0.5), len(vs) - 1)]
    assert got == {(k, name): at(vs, p) for k, vs in values.items() if k != "d" for name, p in (("m", 0.5), ("p", 0.9))}


def test_last_wins_and_series(spark):
    df = spark.createDataFrame([(1, "a", 5, 0), (1, "b", 7, 1), (2, "c", 1, 0)], "k long, owner string, v long, seq long")
    got = {r.k: (r.owner, r.v) for r in merge.last_wins(df, ["k"], ["seq"], first=("owner",)).collect()}
    assert got == {1: ("a", 7), 2: ("c", 1)}
    df = spark.createDataFrame([("s", 25, 200, 0), ("s", 10, 100, 1)], "series string, value long, ts_us long, seq long")
    assert merge.series_latest(df).first().value == 25


def sequential(gateway, requests, window):
    """Rows in turn: (id, ts, session, class, input, output, read, write); the chat class may fall back on what its session sent."""
    free, out = {r[0]: r for r in requests}, set()
    for g in sorted(gateway, key=lambda g: (g[1], g[0])):
        i, ts, session, kind, sent, got, read, write = g
        if sent is None or got is None or not (kind == "anthropic" or (kind == "chat" and session)):
            continue
        read, write = read or 0, write or 0
        near = [r for r in free.values() if abs(r[1] - ts) <= window and r[4] == got and (not session or str(r[2]) == session)]
        fit = [r for r in near if (r[3], r[5] or 0, r[6] or 0) == (sent, read, write)]
        if not fit and kind == "chat":
            fit = [r for r in near if r[3] + (r[5] or 0) in (sent, sent + read)]
        if fit:
            best = min(fit, key=lambda r: (abs(r[1] - ts), r[0]))
            out.add((i, best[0]))
            del free[best[0]]
    return out


def traffic(spark, seed):
    rng = random.Random(seed)
    usage = lambda: (rng.randrange(3), rng.randrange(2), rng.choice([0, 1, 2, None]), rng.choice([0, 1, None]))
    req = [(i, rng.randrange(60) * 10**8, rng.randrange(3), *usage()) for i in range(300)]
    gw = [(i, rng.randrange(60) * 10**8, rng.choice(["", "0", "1"]), rng.choice(["anthropic", "chat", "other"]), *usage()) for i in range(300)]
    gw = [(*g[:4], None if g[0] % 23 == 0 else g[4], *g[5:]) for g in gw]
    columns = "input_tokens long, output_tokens long, cache_read long, cache_write long"
    r = spark.createDataFrame(req, f"request_id long, ts_us long, session_id long, {columns}")
    g = spark.createDataFrame(gw, f"pg_id long, ts_us long, session_id string, api_class string, {columns}").withColumn("status", F.lit(200))
    return gw, req, g, r


def test_pairing_is_the_sequential_greedy(spark):
    gw, req, g, r = traffic(spark, 3)
    got = {(x.pg_id, x.request_id) for x in pairing.pair(g, r).collect()}
    assert got == sequential(gw, req, pairing.WINDOW_US) and len(got) > 50
    kinds = {x[0]: (x[3], x[4]) for x in gw}
    exact = {x[0]: x[3] for x in req}
    assert any(kinds[p][0] == "chat" and exact[q] != kinds[p][1] for p, q in got)  # the fallback takes part


def in_two_passes(gw, req, early, late):
    """The first pass over early rows; the second over late ones, and those left that are near late requests."""
    first = sequential([x for x in gw if early(x)], [x for x in req if early(x)], pairing.WINDOW_US)
    taken, given = {p for p, _ in first}, {q for _, q in first}
    times = [x[1] for x in req if late(x)]
    near = lambda x: min(times) - pairing.WINDOW_US <= x[1] <= max(times) + pairing.WINDOW_US
    scope = [x for x in gw if x[0] not in taken and (late(x) or near(x))]
    return first, sequential(scope, [x for x in req if x[0] not in given], pairing.WINDOW_US)


def test_incremental_pairing(spark):
    gw, req, g, r = traffic(spark, 5)
    first, second = in_two_passes(gw, req, lambda x: x[0] <= 180, lambda x: x[0] > 180)
    done = spark.createDataFrame(sorted(first), "pg_id long, request_id long")
    got = {(x.pg_id, x.request_id) for x in pairing.pair_new(g, r, done, 180, 180).collect()}
    assert got == second and any(p <= 180 for p, _ in got)  # a late transcript finds its row
    assert pairing.pair_new(g, r, done, 300, 300).count() == 0


def test_busy_output_number_is_many_groups(spark):
    """Rows of one output number, without a pause: conflict groups part them, and islands within a group by stretches."""
    rng = random.Random(9)
    minute = 60 * 10**6
    req = [(i, i * minute // 4, i % 3, rng.choice([5, 5, 5, 1000 + i % 40]), 1, rng.choice([0, 7, 7, 995 + i % 40]), 0) for i in range(1500)]
    gw = [(i, r[1] + rng.randrange(-20, 20) * minute, rng.choice(["", str(r[2])]), rng.choice(["anthropic", "chat"]), *r[3:]) for i, r in enumerate(req)]
    gw = [(*g[:4], g[4] + g[6], *g[5:]) if g[3] == "chat" and g[0] % 3 == 0 else g for g in gw]  # gross prompts
    columns = "input_tokens long, output_tokens long, cache_read long, cache_write long"
    r = spark.createDataFrame(req, f"request_id long, ts_us long, session_id long, {columns}")
    g = spark.createDataFrame(gw, f"pg_id long, ts_us long, session_id string, api_class string, {columns}").withColumn("status", F.lit(200))
    got = {(x.pg_id, x.request_id) for x in pairing.pair(g, r).collect()}
    assert got == sequential(gw, req, pairing.WINDOW_US) and len(got) > 1000
    line = g.selectExpr("true g", "pg_id id", "ts_us", "session_id", "api_class = 'chat' chat", *pairing.USAGE)
    line = line.union(r.selectExpr("false g", "request_id id", "ts_us", "cast(session_id as string)", "false", *pairing.USAGE))
    groups = pairing.conflict_groups(line, pairing.WINDOW_US)
    assert groups.select("cell").distinct().count() > 20
    most = groups.groupBy("cell").count().orderBy(F.desc("count")).first()
    dealt = pairing.islands(groups.where(F.col("cell") == most.cell), ["output_tokens", "cell"], pairing.WINDOW_US, 30 * minute)
    assert dealt.select("island").distinct().count() == 1 and dealt.count() == most["count"] > 300


def test_islands_are_those_of_one_window(spark):
    rng = random.Random(4)
    rows = [(k, rng.randrange(40_000)) for k in ("a", "b", "c") for _ in range(200)] + [("d", 5), ("d", 5)]
    df = spark.createDataFrame(rows, "k string, ts_us long")
    for stretch in (100, 1000, 10**9):
        got = {}
        for x in pairing.islands(df, ["k"], 150, stretch).collect():
            got.setdefault((x.k, x.island), []).append(x.ts_us)
        want = []
        for k in "abcd":
            for _, t in sorted(r for r in rows if r[0] == k):
                if want and want[-1][0] == k and t - want[-1][1][-1] <= 150:
                    want[-1][1].append(t)
                else:
                    want.append((k, [t]))
        assert sorted((k, sorted(v)) for (k, _), v in got.items()) == sorted(want)


def test_streamed_pairing_is_the_batch_result_with_bounded_state(spark, tmp_path):
    gw, req, g, r = traffic(spark, 5)
    shift = 10**12  # away from the epoch, where watermarks begin
    gw, req = [(i, ts + shift, *x) for i, ts, *x in gw], [(i, ts + shift, *x) for i, ts, *x in req]
    later = lambda df: df.withColumn("ts_us", F.col("ts_us") + shift)
    rows = pairing_stream.arrivals(later(g), later(r))
    rng, late, far = random.Random(8), 20 * 60 * 10**6, 10**12
    every = sorted(rows.collect(), key=lambda x: x.ts_us + rng.randrange(late))  # up to 20 minutes after their time
    for n in range(6):
        part = every[n * len(every) // 6 : (n + 1) * len(every) // 6]
        spark.createDataFrame(part, rows.schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}.parquet")
    for n in (6, 7):  # time goes on
        one = spark.createDataFrame([(False, 10**6 + n, far * n, "9", False, 1, 99, 0, 0)], rows.drop("ts").schema)
        one.withColumn("ts", F.timestamp_micros("ts_us")).coalesce(1).write.parquet(f"{tmp_path}/in/{n}.parquet")
    live = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = pairing_stream.pairs(live, "20 minutes").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp")
    q = out.trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination()
    got = [(x.pg_id, x.request_id) for x in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert len(got) == len(set(got)) and set(got) == sequential(gw, req, pairing.WINDOW_US)
    read = [p.numInputRows for p in q.recentProgress]
    assert sum(read) == len(every) + 2  # no row is read again
    held = [p.stateOperators[0].numRowsTotal for p in q.recentProgress]
    assert held[-1] <= 1 < max(held)  # the number of the last row alone


def test_traffic_of_a_model(spark):
    req = spark.createDataFrame([(1, 7, 0)], "request_id long, session_id long, ts_us long")
    gw = spark.createDataFrame([(1, "7", "big", "", 5, 1), (2, "", "other", "big", 6, 2), (3, "", "big", "", None, 3), (4, "7", "other", "", 9, 9)], "pg_id long, session_id string, model string, resolved_via string, input_tokens long, output_tokens long")
    pairs, known = spark.createDataFrame([(2, 1)], "pg_id long, request_id long"), spark.createDataFrame([(7,)], "session_id long")
    assert rollup.model_traffic(req, gw, pairs, known, "big").first().asDict() == {"requests": 3, "input_tokens": 11, "output_tokens": 6, "unpaired": 1}
    assert rollup.model_traffic(req, gw, pairs, known, "none").first().asDict() == {"requests": 0, "input_tokens": 0, "output_tokens": 0, "unpaired": 0}

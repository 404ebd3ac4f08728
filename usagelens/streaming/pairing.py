"""Pairing as rows arrive: bounded state, each row read once."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from usagelens.operators.pairing import USAGE, WINDOW_US, Sweep, fit

PAIR = "pg_id long, request_id long, skew_us long"


def arrivals(gateway: DataFrame, requests: DataFrame) -> DataFrame:
    """Both streams as one: rows that can pair, with `ts`, their time."""
    cached = [F.coalesce(c, F.lit(0)).alias(c) for c in USAGE[2:]]
    g = gateway.where(fit()).select(
        F.lit(True).alias("g"), F.col("pg_id").alias("id"), "ts_us", F.coalesce("session_id", F.lit("")).alias("session_id"), (F.col("api_class") == "chat").alias("chat"), *USAGE[:2], *cached
    )
    r = requests.where("input_tokens is not null and output_tokens is not null").select(
        F.lit(False).alias("g"), F.col("request_id").alias("id"), "ts_us", F.col("session_id").cast("string").alias("session_id"), F.lit(False).alias("chat"), *USAGE[:2], *cached
    )
    return g.unionByName(r).withColumn("ts", F.timestamp_micros("ts_us"))


def pairs(rows: DataFrame, late: str = "1 hour", window_us: int = WINDOW_US) -> DataFrame:
    """pg_id, request_id, skew_us of the pairs of `arrivals`, once each, as the batch operator makes them.

    A row may come up to `late` after others of its time. The watermark decides: a gateway row is
    paired once it has passed the row's time and the window, by then everything that it could
    pair with has come, in whatever order. State per output number: gateway rows not decided yet and
    requests of the last two windows before the watermark; it goes when both are gone. What comes
    after the watermark is dropped by Spark.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        sweep = Sweep(window_us)
        if state.exists:
            waiting, requests, taken = json.loads(state.get[0])
            for ts, pg_id, session, chat, usage in waiting:
                sweep.gateway(ts, pg_id, session, chat, tuple(usage))
            for ts, request_id, session, usage in requests:
                sweep.request(ts, request_id, session, tuple(usage))
            sweep.taken = set(taken)
        for batch in batches:
            for x in batch.itertuples(index=False):
                usage = (int(x.input_tokens), int(x.cache_read), int(x.cache_write))
                if x.g:
                    sweep.gateway(int(x.ts_us), int(x.id), x.session_id, bool(x.chat), usage)
                else:
                    sweep.request(int(x.ts_us), int(x.id), x.session_id, usage)
        passed = state.getCurrentWatermarkMs() * 1000
        found = list(sweep.decided(passed)) if passed > 0 else []
        if sweep.waiting or sweep.requests:
            state.update((json.dumps([sweep.waiting, sweep.requests, sorted(sweep.taken)]),))
            # called again when the oldest row can be decided, or dropped
            due = [sweep.waiting[0][0] + window_us] if sweep.waiting else []
            due += [sweep.requests[0][0] + 2 * window_us] if sweep.requests else []
            state.setTimeoutTimestamp(max(min(due) // 1000, passed // 1000) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(found, columns=[c.split()[0] for c in PAIR.split(", ")])

    held = rows.withWatermark("ts", late).groupBy("output_tokens")
    return held.applyInPandasWithState(step, PAIR, "rows string", "append", GroupStateTimeout.EventTimeTimeout)

"""Cache doctor and transcript requests as streams."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from usagelens.operators.cache import LEAST_EXPECTED, LEAST_SHORTFALL, LONG_TTL_US, READ_SHARE, SHORT_TTL_US
from usagelens.sources import transcripts

NUMBERS = ["input_tokens", "cache_read", "cache_write", "write_5m", "write_1h"]
RESULT = "request_id long, session_id long, model string, ts_us long, expected long, cache_read long, reused long, shortfall long, is_event boolean, cause string"


def live_requests(lines: DataFrame, late: str = "1 hour") -> DataFrame:
    """Requests of transcript lines (file, line, value), once each: a file read again within the watermark adds none."""
    rows = transcripts.requests(transcripts.parse(lines)).withColumn("ts", F.timestamp_micros("ts_us"))
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["key"])


def live_transitions(rows: DataFrame, late: str = "1 hour", idle: str = "30 days") -> DataFrame:
    """`cache.transitions` over a stream of requests and boundaries (request_id and model null).

    What comes up to `late` after others of its time is put in order first: rows wait until the
    watermark has passed their time, and are then judged as the batch operator does. A request that
    comes again while it waits (a message that changes as it is written) takes the place of its
    earlier version. State per session: waiting rows, the last boundary and each model's latest
    request; a session without a row for `idle` is forgotten, its next request then is a first one.
    """
    spark = rows.sparkSession
    rest = spark.range(1).select(F.expr(f"cast(timestampdiff(MICROSECOND, timestamp'1970-01-01', timestamp'1970-01-01' + interval {idle}) as long)")).first()[0]

    def judged(x: dict, seen: dict) -> tuple | None:
        """The row of a request, if it has something to be judged by; it is the latest one from now on."""
        prev, read = seen["prev"].get(x["model"]), x["cache_read"]
        seen["prev"][x["model"]] = {
            "ts": x["ts"], "total": x["input_tokens"] + read + x["cache_write"], "cached": read + x["cache_write"], "short": x["write_5m"] > x["write_1h"]
        }
        if not prev or read + x["cache_write"] + prev["cached"] <= 0 or prev["total"] < LEAST_EXPECTED:
            return None
        lost, gap = max(0, prev["total"] - read), x["ts"] - prev["ts"]
        event = lost >= LEAST_SHORTFALL and read < READ_SHARE * prev["total"]
        cause = "healthy"
        if event and seen["boundary"] is not None and seen["boundary"] > prev["ts"]:
            cause = "compaction"
        elif event:
            cause = "ttl_expiry" if gap > LONG_TTL_US or (gap > SHORT_TTL_US and prev["short"]) else "history_edit"
        return x["id"], x["session"], x["model"], x["ts"], prev["total"], read, min(read, prev["total"]), lost if event else 0, event, cause

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen = json.loads(state.get[0]) if state.exists else {"boundary": None, "prev": {}, "waiting": {}, "last": 0}
        for batch in batches:
            batch[NUMBERS] = batch[NUMBERS].fillna(0)
            for x in batch.itertuples(index=False):
                bound = pd.isna(x.request_id)
                name = f"b{int(x.ts_us)}" if bound else f"r{int(x.request_id)}"
                one = {"ts": int(x.ts_us), "id": -1 if bound else int(x.request_id), "session": int(key[0]), "model": x.model}
                seen["waiting"][name] = one | {c: int(getattr(x, c)) for c in NUMBERS}
        passed, out = state.getCurrentWatermarkMs() * 1000, []
        # a boundary at a request's time counts as before it
        for name, x in sorted(seen["waiting"].items(), key=lambda w: (w[1]["ts"], w[1]["id"])):
            if x["ts"] > passed:
                break
            del seen["waiting"][name]
            seen["last"] = x["ts"]
            if x["id"] < 0:
                seen["boundary"] = x["ts"]
            elif (row := judged(x, seen)) is not None:
                out.append(row)
        waiting = [x["ts"] for x in seen["waiting"].values()]
        due = min(waiting) if waiting else seen["last"] + rest
        if not waiting and due <= passed:
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps(seen),))
            state.setTimeoutTimestamp(max(due // 1000, passed // 1000) + 1)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    timed = rows.withColumn("_ts", F.timestamp_micros("ts_us")).withWatermark("_ts", late)
    return timed.groupBy("session_id").applyInPandasWithState(step, RESULT, "seen string", "append", GroupStateTimeout.EventTimeTimeout)

"""Pairing gateway rows with requests one to one, nearest in time first."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW_US = 30 * 60 * 1000000
#: Rows of one conflict group are looked through for pauses by stretches of time, each a task's work.
STRETCH_US = 6 * 3600 * 1000000
USAGE = ["input_tokens", "output_tokens", "cache_read", "cache_write"]


def fit(session: str = "session_id") -> Column:
    """Gateway rows that may pair: answered, with usage, and of a class whose requests are known."""
    chat = (F.col("api_class") == "chat") & (F.col(session) != "")
    used = F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()
    return (F.col("status") == 200) & used & ((F.col("api_class") == "anthropic") | chat)


class Sweep:
    """The pairs of one conflict group as its rows come in, with no more held than the window needs.

    A gateway row is decided, after all before it, when everything within its window has come; a
    request goes when no row that isn't decided yet can want it.
    """

    def __init__(self, window_us: int):
        self.window = window_us
        self.waiting: list[tuple] = []
        self.requests: list[tuple] = []
        self.alike: dict[tuple, list] = defaultdict(list)
        self.within: dict[str, list] = defaultdict(list)
        self.taken: set[int] = set()

    def gateway(self, ts: int, pg_id: int, session: str, chat: bool, usage: tuple[int, int, int]) -> None:
        """usage: input, cache read, cache write."""
        insort(self.waiting, (ts, pg_id, session, chat, usage))

    def request(self, ts: int, request_id: int, session: str, usage: tuple[int, int, int]) -> None:
        insort(self.requests, (ts, request_id, session, usage))
        insort(self.alike[usage], (ts, request_id, session))
        insort(self.within[session], (ts, request_id, usage[0] + usage[1]))

    def near(self, found: list[tuple], ts: int) -> list[tuple]:
        """What is free in the window, by distance and id."""
        part = found[bisect_left(found, (ts - self.window,)) : bisect_left(found, (ts + self.window + 1,))]
        return [(abs(c[0] - ts), c[1], c[2]) for c in part if c[1] not in self.taken]

    def decided(self, upto: int | None = None) -> Iterator[tuple[int, int, int]]:
        """Pairs (pg_id, request_id, skew) that nothing from `upto` on can change; of all rows if None."""
        n = len(self.waiting) if upto is None else bisect_left(self.waiting, (upto - self.window,))
        for ts, pg_id, session, chat, usage in self.waiting[:n]:
            good = [c for c in self.near(self.alike.get(usage, []), ts) if not session or c[2] == session]
            if not good and chat:
                good = [c for c in self.near(self.within.get(session, []), ts) if c[2] in (usage[0], usage[0] + usage[1])]
            if good:
                skew, best, _ = min(good)
                self.taken.add(best)
                yield pg_id, best, skew
        del self.waiting[:n]
        if upto is not None:
            self.forget(upto - 2 * self.window)

    def forget(self, before: int) -> None:
        """Requests before this time are too old for every row to come."""
        n = bisect_left(self.requests, (before,))
        for ts, request_id, session, usage in self.requests[:n]:
            for table, key in ((self.alike, usage), (self.within, session)):
                if key in table and (k := bisect_left(table[key], (before,))):
                    del table[key][:k]
                    if not table[key]:
                        del table[key]
            self.taken.discard(request_id)
        del self.requests[:n]


def conflict_groups(line: DataFrame, window_us: int) -> DataFrame:
    """`line` with `cell`: rows with another output number or cell never want the same request.

    A request pairs only with rows of its output number and of its prompt total (input and cache
    read), but for chat rows that report a cached part, which may also want a request of their own
    session whose total is their input alone. Where there is such a request, the two totals are
    one cell; these links are few, and joined up per output number.
    """
    total = F.col("input_tokens") + F.col("cache_read")
    line = line.withColumn("total", total)
    chat = line.where("g and chat and cache_read > 0").select("output_tokens", "session_id", F.col("input_tokens").alias("low"), F.col("total").alias("high"), F.col("ts_us").alias("at"))
    sent = line.where("not g").select("output_tokens", "session_id", F.col("total").alias("low"), "ts_us")
    met = chat.join(sent, ["output_tokens", "session_id", "low"]).where(F.abs(F.col("at") - F.col("ts_us")) <= window_us)
    links = met.select("output_tokens", "low", "high").distinct()

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        least: dict[int, int] = {}

        def top(x: int) -> int:
            while least.setdefault(x, x) != x:
                least[x] = x = least[least[x]]
            return x

        for low, high in zip(rows["low"].tolist(), rows["high"].tolist(), strict=True):
            a, b = sorted((top(low), top(high)))
            least[b] = a
        return pd.DataFrame({"output_tokens": rows["output_tokens"].iat[0], "total": [*least], "cell": [top(x) for x in least]})

    cells = links.groupBy("output_tokens").applyInPandas(joined, "output_tokens long, total long, cell long")
    return line.join(cells, ["output_tokens", "total"], "left").withColumn("cell", F.coalesce("cell", "total"))


def islands(rows: DataFrame, group: list[str], gap_us: int, stretch_us: int = STRETCH_US) -> DataFrame:
    """`rows` with `island`: numbers the stretches of a group between pauses over `gap_us`.

    Pauses are looked for within (group, stretch of time); what one stretch hands to the next is a
    row of sums, so no task has all rows of a group however many it has.
    """
    rows = rows.withColumn("_part", F.floor(F.col("ts_us") / stretch_us))
    inside = Window.partitionBy(*group, "_part").orderBy("ts_us")
    rows = rows.withColumn("_new", (F.col("ts_us") - F.lag("ts_us").over(inside) > gap_us).cast("int"))
    rows = rows.withColumn("_in", F.coalesce(F.sum("_new").over(inside.rangeBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    sums = rows.groupBy(*group, "_part").agg(F.min("ts_us").alias("_lo"), F.max("ts_us").alias("_hi"), F.coalesce(F.sum("_new"), F.lit(0)).alias("_n"))
    parts = Window.partitionBy(*group).orderBy("_part")
    apart = F.when(F.col("_lo") - F.lag("_hi").over(parts) <= gap_us, 0).otherwise(1)
    sums = sums.withColumn("_apart", apart).withColumn("_base", F.sum(F.col("_apart") + F.col("_n")).over(parts) - F.col("_n"))
    found = rows.join(sums.select(*group, "_part", "_base"), [*group, "_part"])
    return found.withColumn("island", F.col("_base") + F.col("_in")).drop("_part", "_new", "_in", "_base")


def pair(gateway: DataFrame, requests: DataFrame, window_us: int = WINDOW_US) -> DataFrame:
    """pg_id, request_id, skew_us of the pairs.

    Only rows of one conflict group can want the same request, and only within the window, so the
    islands of a group between pauses don't affect each other. Each is swept through in order of
    time, with the rows of about an hour held.
    """
    cached = [F.coalesce(c, F.lit(0)).alias(c) for c in USAGE[2:]]  # what isn't reported is none
    session = F.coalesce("session_id", F.lit("")).alias("session_id")
    chat = (F.col("api_class") == "chat").alias("chat")
    g = gateway.where(fit()).select(F.lit(True).alias("g"), F.col("pg_id").alias("id"), "ts_us", session, chat, *USAGE[:2], *cached)
    r = requests.where(F.col("output_tokens").isNotNull() & F.col("input_tokens").isNotNull()).select(
        F.lit(False).alias("g"), F.col("request_id").alias("id"), "ts_us", F.col("session_id").cast("string").alias("session_id"), F.lit(False).alias("chat"), *USAGE[:2], *cached
    )
    keys = ["output_tokens", "cell", "island"]
    line = islands(conflict_groups(g.unionByName(r), window_us), keys[:2], window_us)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Islands follow each other in a partition; one may go on in the next batch."""
        at, sweep = None, Sweep(window_us)
        table = lambda out: pd.DataFrame(out, columns=["pg_id", "request_id", "skew_us"])
        for batch in batches:
            out = []
            for x in batch.itertuples(index=False):
                key = (x.output_tokens, x.cell, x.island)
                if key != at:
                    out += sweep.decided()
                    at, sweep = key, Sweep(window_us)
                usage = (x.input_tokens, x.cache_read, x.cache_write)
                if x.g:
                    sweep.gateway(x.ts_us, x.id, x.session_id, x.chat, usage)
                else:
                    sweep.request(x.ts_us, x.id, x.session_id, usage)
                if sweep.waiting and sweep.waiting[0][0] < x.ts_us - 2 * window_us:  # now and then
                    out += sweep.decided(x.ts_us)
                elif not sweep.waiting and len(sweep.requests) > 1000:
                    sweep.forget(x.ts_us - 2 * window_us)
            yield table(out)
        yield table(list(sweep.decided()))

    # dealt by island, so that a common number of output tokens is many tasks' work
    ordered = line.repartition(*keys).sortWithinPartitions(*keys, "ts_us", "g", "id")
    return ordered.select(*keys, "g", "id", "ts_us", "session_id", "chat", *[c for c in USAGE if c not in keys]).mapInPandas(run, "pg_id long, request_id long, skew_us long")


def scope(gateway: DataFrame, new_requests: DataFrame, pairs: DataFrame, new: Column) -> DataFrame:
    """Rows without a pair that are `new`, or whose time is near the span of new requests."""
    span = new_requests.agg((F.min("ts_us") - WINDOW_US).alias("_lo"), (F.max("ts_us") + WINDOW_US).alias("_hi"))
    pending = gateway.join(pairs.select("pg_id"), "pg_id", "left_anti")
    # one row of sums on the right
    return pending.join(F.broadcast(span), new | F.col("ts_us").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def in_scope(gateway: DataFrame, requests: DataFrame, pairs: DataFrame, last_pg_id: int, last_request_id: int) -> DataFrame:
    """Gateway rows of an incremental pass: new ones, and pending ones near the span of new requests."""
    return scope(gateway, requests.where(F.col("request_id") > last_request_id), pairs, F.col("pg_id") > last_pg_id)


def pair_more(gateway: DataFrame, requests: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of rows in scope with requests that are still free; only requests near them are looked at."""
    span = gateway.agg((F.min("ts_us") - WINDOW_US).alias("_lo"), (F.max("ts_us") + WINDOW_US).alias("_hi"))
    near = requests.join(F.broadcast(span), F.col("ts_us").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    return pair(gateway, near.join(pairs.select("request_id"), "request_id", "left_anti"))


def pair_new(gateway: DataFrame, requests: DataFrame, pairs: DataFrame, last_pg_id: int, last_request_id: int) -> DataFrame:
    """What an incremental pass adds to the pairs of the passes before it, by the ids that those had seen."""
    return pair_more(in_scope(gateway, requests, pairs, last_pg_id, last_request_id), requests, pairs)

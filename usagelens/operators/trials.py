"""Comparing the arms of an experiment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens.operators.rollup import by_prefix


#: Measure, column, share: each arm's value at floor(p n + 1/2), counted from 0 and at most the last.
MEASURES = [
    ("p50_ms", "duration_ms", 0.5), ("p90_ms", "duration_ms", 0.9), ("p50_input", "input_tokens", 0.5), ("p50_output", "output_tokens", 0.5),
    ("p50_cache_read", "cache_read", 0.5), ("p50_cache_write", "cache_write", 0.5), ("p50_cost", "cost_usd", 0.5),
]
#: Values are counted by stretches of their logarithm to base 2, so many to a doubling.
FINE = 64


def stretch(v: Column) -> Column:
    """A whole number that never falls as v rises: its sign and the stretch of its logarithm."""
    size = F.floor(F.log2(F.abs(v)) * FINE) + 1100 * FINE  # over 0 for any double
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("long")


def percentiles(rows: DataFrame, key: str, measures: list[tuple[str, str, float]]) -> DataFrame:
    """key, name, value: for each measure the value at its exact index, nulls aside.

    Values are counted once. Running counts over stretches of values find the stretch that the index
    falls in, and only the values of that one are ranked, so no group's values meet in one task.
    """
    columns = sorted({c for _, c, _ in measures})
    long = rows.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x"))
    values = long.where("x.v IS NOT NULL").groupBy(key, F.col("x.c").alias("c"), F.col("x.v").alias("v")).agg(F.count("*").alias("w"))
    values = values.withColumn("b", stretch(F.col("v")))
    whole = Window.partitionBy(key, "c")
    parts = values.groupBy(key, "c", "b").agg(F.sum("w").alias("w"))
    parts = parts.select(key, "c", "b", "w", F.sum("w").over(whole.orderBy("b")).alias("upto"), F.sum("w").over(whole).alias("n"))
    asked = F.array(*[F.struct(F.lit(m).alias("name"), F.lit(c).alias("c"), F.lit(p).alias("p")) for m, c, p in measures])
    wanted = parts.select("*", F.explode(F.filter(asked, lambda x: x["c"] == F.col("c"))).alias("x"))
    at = F.least(F.floor(F.col("x.p") * F.col("n") + 0.5), F.col("n") - 1)
    # the one stretch of each measure that holds its index
    picked = wanted.withColumn("at", at).where("upto > at AND upto - w <= at").select(key, "c", "b", "x.name", (F.col("at") - F.col("upto") + F.col("w")).alias("at"))
    near = values.join(picked, [key, "c", "b"])
    near = near.withColumn("upto", F.sum("w").over(Window.partitionBy(key, "name").orderBy("v"))).where("upto > at")
    return near.groupBy(key, "name").agg(F.min("v").alias("value"))


def compare(used: DataFrame) -> DataFrame:
    """Per arm: harness and model (of its first trial), trials, passes, trials without usage, and percentiles: of duration over
    finished trials, of tokens over those with usage, of cost over all that have one.

    used: the trials with what `usage` adds.
    """
    done = F.col("status").isin("ok", "fail")
    first = F.min_by(F.struct("harness", "model"), "trial_id").alias("first")
    counts = used.groupBy("arm").agg(
        first, F.count("*").alias("trials"), F.sum(done.cast("long")).alias("done"), F.sum((F.col("status") == "ok").cast("long")).alias("passed"),
        F.sum((F.col("requests") == 0).cast("long")).alias("without_usage"),
    ).select("arm", "first.harness", "first.model", "trials", "done", "passed", "without_usage")
    found = percentiles(used.withColumn("duration_ms", F.when(done, F.col("duration_ms"))), "arm", MEASURES)
    kind = lambda name: "double" if name == "p50_cost" else "long"
    wide = found.groupBy("arm").agg(*[F.max(F.when(F.col("name") == m, F.col("value"))).cast(kind(m)).alias(m) for m, _, _ in MEASURES])
    return counts.join(wide, "arm", "left")


def usage(trials: DataFrame, sources: DataFrame, sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """Trials with their number of requests, the tokens of these (null without any) and their cost: as reported, else what the requests cost if that is over 0.

    A trial's requests are those of all sessions found below its own transcript root (so those of
    its subagents too): trial, source of that harness and root, sessions of the source, their requests.
    Requests are summed by session and source first, so each join meets one row of a trial.
    """
    sums = ["requests", "input_tokens", "output_tokens", "cache_read", "cache_write", "_cost"]
    spent = requests.groupBy("session_id").agg(F.count("*").alias("requests"), *[F.sum(c).alias(c) for c in sums[1:5]], F.sum("cost_usd").alias("_cost"))
    spent = spent.join(sessions.select("session_id", "source_id"), "session_id").groupBy("source_id").agg(*[F.sum(c).alias(c) for c in sums])
    spent = sources.join(spent, "source_id").select(F.col("kind").alias("harness"), F.col("root").alias("transcript_root"), *sums)
    rows = trials.join(spent, ["harness", "transcript_root"], "left").withColumn("requests", F.coalesce("requests", F.lit(0)))
    return rows.withColumn("cost_usd", F.coalesce("cost_usd", F.when(F.col("_cost") > 0, F.col("_cost")))).drop("_cost")


def runs(trials: DataFrame, limit: int | None = 20) -> DataFrame:
    done = F.col("status").isin("ok", "fail").cast("long")
    found = trials.groupBy("run_id").agg(F.count("*").alias("trials"), F.sum(done).alias("done"))
    return found if limit is None else found.orderBy(F.desc("run_id")).limit(limit)


def run_by_prefix(trials: DataFrame, prefix: str) -> DataFrame:
    """The newest of all runs whose number begins with the prefix; only its trials are counted."""
    newest = by_prefix(trials.select("run_id"), prefix, "run_id").agg(F.max("run_id").alias("run_id"))
    return runs(trials.join(F.broadcast(newest), "run_id"), None)  # one row


def failed_checks(trials: DataFrame) -> DataFrame:
    checks = F.from_json("checks_json", "array<struct<name:string,ok:boolean>>")
    names = F.transform(F.filter(checks, lambda c: ~c["ok"]), lambda c: c["name"])
    return trials.select("trial_id", F.array_join(names, ",").alias("failed"))


def pending(trials: DataFrame, arms: list[str], per_arm: int) -> DataFrame:
    """Run, arm and number of the trials of a grid that are still to come."""
    grid = trials.select("run_id").distinct().withColumn("arm", F.explode(F.array(*map(F.lit, arms))))
    grid = grid.withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(per_arm - 1).cast("long"))))
    done = trials.where(F.col("status").isin("ok", "fail")).select("run_id", "arm", (F.col("trial_id") % per_arm).alias("number"))
    return grid.join(done, ["run_id", "arm", "number"], "left_anti")

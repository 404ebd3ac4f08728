"""Telemetry exports in OTLP JSON: flat rows of datapoints and of events.

One row of `value` is one export request. It is parsed by schema, exploded thrice and kept in
built-in functions throughout, so the same code serves batches and streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 64-bit integers come as strings or numbers: strings take both
_VALUE = "struct<stringValue:string,intValue:string,doubleValue:string,boolValue:string,bytesValue:string,arrayValue:string,kvlistValue:string>"
_ATTRS = f"array<struct<key:string,value:{_VALUE}>>"
_POINT = f"struct<attributes:{_ATTRS},startTimeUnixNano:string,timeUnixNano:string,asInt:string,asDouble:string>"
_POINTS = f"struct<dataPoints:array<{_POINT}>>"
METRICS = f"resourceMetrics array<struct<resource:struct<attributes:{_ATTRS}>,scopeMetrics:array<struct<metrics:array<struct<name:string,sum:{_POINTS},gauge:{_POINTS},histogram:struct<dataPoints:array<struct<count:string>>>>>>>>>"
LOGS = f"resourceLogs array<struct<resource:struct<attributes:{_ATTRS}>,scopeLogs:array<struct<logRecords:array<struct<timeUnixNano:string,observedTimeUnixNano:string,body:{_VALUE},attributes:{_ATTRS}>>>>>>"


def lenient_long(x: Column) -> Column:
    """A whole number, given as such, as a string or as a float (cut)."""
    return F.coalesce(x.try_cast("long"), x.try_cast("double").try_cast("long"))


def plain(value: Column) -> Column:
    return F.coalesce(*[value[k] for k in ("stringValue", "intValue", "doubleValue", "boolValue", "bytesValue", "arrayValue", "kvlistValue")])


def merged(*lists: Column) -> Column:
    """One map of attribute lists; of equal keys the last one counts."""
    pairs = F.concat(*[F.coalesce(x, F.array().cast(_ATTRS)) for x in lists])
    named = F.filter(pairs, lambda p: p["key"].isNotNull())
    keys = F.array_distinct(F.transform(named, lambda p: p["key"]))
    last = lambda k: F.element_at(F.filter(named, lambda p: p["key"] == k), -1)
    return F.map_from_arrays(keys, F.transform(keys, lambda k: plain(last(k)["value"])))


def canonical(attrs: Column) -> Column:
    """JSON of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(attrs))))


def identity(*parts: Column) -> Column:
    joined = F.concat(*[F.concat(F.coalesce(p.cast("string"), F.lit("")), F.lit("\0")) for p in parts])
    return F.substring(F.sha2(joined, 256), 1, 32)


def at_us(nanos: Column) -> Column:
    """Microseconds, cut to milliseconds; null where there is no time."""
    n = nanos.try_cast("long")
    return F.when(n > 0, F.floor(n / 1000000) * 1000).cast("long")


def _promoted(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Columns for the named attributes ('' if missing); `attrs` keeps the rest."""
    found = [F.coalesce(F.col("a")[n], F.lit("")).alias(n.replace(".", "_")) for n in names]
    return rows.select("*", *found, canonical(F.map_filter("a", lambda k, _: ~k.isin(*names))).alias("attrs")).drop("a")


def datapoints(exports: DataFrame) -> DataFrame:
    """Rows (key, metric, start_us, ts_us, value, type, model, session_id, attrs); sums and gauges alike, no histograms."""
    rows = (
        exports.select(F.from_json("value", METRICS).alias("e"))
        .select(F.explode("e.resourceMetrics").alias("r"))
        .select(F.col("r.resource.attributes").alias("ra"), F.explode("r.scopeMetrics").alias("s"))
        .select("ra", F.explode("s.metrics").alias("m"))
        .select("ra", F.col("m.name").alias("metric"), F.explode(F.coalesce("m.sum.dataPoints", "m.gauge.dataPoints")).alias("p"))
    )
    flat = rows.select(
        "metric", at_us(F.col("p.startTimeUnixNano")).alias("start_us"), at_us(F.col("p.timeUnixNano")).alias("ts_us"),
        F.coalesce(F.col("p.asDouble").try_cast("double"), F.col("p.asInt").try_cast("double"), F.lit(0.0)).alias("value"),
        merged(F.col("ra"), F.col("p.attributes")).alias("a"),
    )
    keyed = flat.withColumn("key", identity(F.col("metric"), F.col("start_us"), canonical(F.col("a"))))
    return _promoted(keyed, ("type", "model", "session.id"))


def skipped(exports: DataFrame) -> DataFrame:
    """How many metrics are neither sum nor gauge: one row."""
    of = F.flatten(F.flatten(F.transform("e.resourceMetrics", lambda r: F.transform(r["scopeMetrics"], lambda s: s["metrics"]))))
    n = F.size(F.filter(of, lambda m: m["sum"].isNull() & m["gauge"].isNull()))
    return exports.select(F.from_json("value", METRICS).alias("e")).agg(F.coalesce(F.sum(F.greatest(n, F.lit(0))), F.lit(0)).alias("skipped"))


def events(exports: DataFrame, prefix: str) -> DataFrame:
    """Rows (key, event, ts_us, ids, counts, attrs); `prefix` is cut from event names."""
    rows = (
        exports.select(F.from_json("value", LOGS).alias("e"))
        .select(F.explode("e.resourceLogs").alias("r"))
        .select(F.col("r.resource.attributes").alias("ra"), F.explode("r.scopeLogs").alias("s"))
        .select("ra", F.explode("s.logRecords").alias("l"))
        .select("l", merged(F.col("ra"), F.col("l.attributes")).alias("a"))
    )
    said = lambda c: F.when(c != "", c)
    name = F.coalesce(said(plain(F.col("l.body"))), said(F.col("a")["event.name"]), F.lit("(unknown)"))
    stamp = F.unix_micros(F.col("a")["event.timestamp"].try_cast("timestamp"))
    flat = rows.select(
        F.when(name.startswith(prefix), F.substr(name, F.lit(len(prefix) + 1))).otherwise(name).alias("event"),
        F.coalesce(at_us(F.col("l.timeUnixNano")), at_us(F.col("l.observedTimeUnixNano")), stamp).alias("ts_us"), "a",
    )
    counts = ("duration_ms", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")
    keyed = flat.withColumn("key", identity(F.col("event"), F.col("ts_us"), canonical(F.col("a"))))
    rows = _promoted(keyed, ("session.id", "request_id", "prompt.id", "tool_use_id", "model", "cost_usd", *counts))
    return rows.withColumns({c: lenient_long(F.col(c)) for c in counts} | {"cost_usd": F.col("cost_usd").try_cast("double")})

"""Transcripts kept as one JSON object a file: session/*/*.json, message/*/*.json, part/*/*.json.

The same three tables kept in a database (id, parents, JSON column `data`) are read by `database`, all or
only what changed since a manifest of keys, lengths and times (`database_keys`).
Sizes count the decoded text of a result, not its JSON form. A message changes while it is
written, so later versions win (`merge.last_wins`). Objects without an id are counted, not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagelens.sources import files, ranges

#: The fields read of each kind, and what keys of requests and blocks begin with.
SESSION = "id string, slug string, directory string, title string, time struct<created:long,updated:long>"
MESSAGE = """id string, sessionID string, role string, modelID string, providerID string, cost double, finish string,
 time struct<created:long,completed:long>, tokens struct<total:long,input:long,output:long,reasoning:long,cache:struct<read:long,write:long>>"""
PART = """id string, sessionID string, messageID string, type string, text string, tool string, callID string,
 state struct<status:string,input:string,output:string>"""
KINDS = {"session": SESSION, "message": MESSAGE, "part": PART}
PATHS = ("filePath", "file_path", "path")


def read(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """Objects of one kind below `root`, with the name of the folder each lies in (`folder`)."""
    rows = spark.read.schema(KINDS[kind]).json(f"{root}/{kind}/*/*.json", multiLine=True)
    return rows.withColumn("folder", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def decoded(rows: DataFrame, kind: str, folder: str, more: list[str] | None = None) -> DataFrame:
    """Rows of a database's table: JSON in `data`, the object's id in `id`, its parent's in column `folder`; also the columns `more`."""
    more = more or []
    whole = rows.select(F.col("id").alias("_id"), F.col(folder).alias("folder"), *more, F.from_json("data", KINDS[kind]).alias("e"))
    return whole.select("_id", "folder", *more, "e.*").withColumn("id", F.coalesce("id", "_id")).drop("_id")


#: The columns of the database's tables besides `data`.
PARENTS = {"session": [], "message": ["session_id"], "part": ["message_id", "session_id"]}
MANIFEST = "kind string, id string, size long, updated long"


def _database(path: str) -> dict:
    return {"driver": "sqlite3", "dsn": f"file:{path}?mode=ro", "connect": '{"uri": true, "timeout": 5}'}


def database_keys(spark: SparkSession, path: str, kind: str, span: int = ranges.SPAN) -> DataFrame:
    """kind, id, size, updated and place of each row of a table; `data` is measured, not read."""
    size = "0" if kind == "session" else "coalesce(length(data), 0)"
    rows = ranges.table(
        spark, "id string, size long, updated long, place long", table=kind, key="rowid", range=span, expr_size=size, expr_updated="coalesce(time_updated, 0)", expr_place="rowid", **_database(path)
    )
    return rows.withColumn("kind", F.lit(kind)).select("kind", "id", "size", "updated", "place")


def database(spark: SparkSession, path: str, kind: str, before: DataFrame | None = None) -> DataFrame:
    """Objects of one kind as `read` gives them; with a manifest, only those that are new or differ from it.

    Keys, lengths and times are compared first; then only the payloads of changed rows are read,
    on the executors. A session's fields are columns, so it has no payload.
    """
    if kind == "session":
        fields = "id string, slug string, directory string, title string, time_created long, time_updated long"
        rows = ranges.table(spark, fields, table="session", key="rowid", **_database(path))
        if before is not None:
            keys = files.changed_rows(database_keys(spark, path, kind), before, ["kind", "id"])
            rows = rows.join(keys.select("id"), "id", "left_semi")
        time = F.struct(F.col("time_created").alias("created"), F.col("time_updated").alias("updated"))
        return rows.select("id", "slug", "directory", "title", time.alias("time"), F.lit("").alias("folder"))
    fields = ", ".join(f"{c} string" for c in ("id", *PARENTS[kind], "data"))
    if before is None:
        rows = ranges.table(spark, fields, table=kind, key="rowid", **_database(path))
    else:
        keys = files.changed_rows(database_keys(spark, path, kind), before, ["kind", "id"])
        rows = ranges.payloads(keys.select(F.col("place").alias("rowid")), fields, table=kind, key="rowid", **_database(path))
    rows = decoded(rows, kind, "session_id", PARENTS[kind])
    # ids and parents are columns there, and those count
    rows = rows.withColumn("sessionID", F.col("session_id"))
    rows = rows.withColumn("messageID", F.col("message_id")) if kind == "part" else rows
    return rows.drop(*PARENTS[kind])


def broken(rows: DataFrame) -> DataFrame:
    """How many objects have no id: one row."""
    return rows.agg(F.count_if(F.coalesce("id", F.lit("")) == "").alias("parse_errors"))


def _there(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce("id", F.lit("")) != "")


def _session(rows: DataFrame) -> DataFrame:
    return rows.withColumn("session_id", F.coalesce(F.nullif(F.col("sessionID"), F.lit("")), "folder"))


def sessions(rows: DataFrame) -> DataFrame:
    """session_id, slug, cwd, project, title and span."""
    text = lambda c: F.coalesce(c, F.lit(""))
    us = lambda c: F.nullif(F.col(c), F.lit(0)) * 1000
    return _there(rows).select(
        F.col("id").alias("session_id"), text("slug").alias("slug"), text("directory").alias("cwd"),
        F.regexp_extract(text("directory"), "([^/]*)/*$", 1).alias("project"), text("title").alias("title"),
        us("time.created").alias("started_us"), us("time.updated").alias("ended_us"),
    )


def requests(messages: DataFrame) -> DataFrame:
    """One row per answered message that reports tokens; unfinished ones without tokens are left out."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    done, tokens = zero("time.completed"), F.col("tokens")
    rows = _session(_there(messages)).where((F.col("role") == "assistant") & tokens.isNotNull() & ((done != 0) | (zero("tokens.total") != 0)))
    return rows.select(
        F.concat(F.lit("oc:"), "id").alias("key"), "session_id",
        (F.coalesce(F.nullif(done, F.lit(0)), F.nullif(F.col("time.created"), F.lit(0))) * 1000).alias("ts_us"),
        F.col("modelID").alias("model"), F.col("providerID").alias("provider"), zero("tokens.input").alias("input_tokens"),
        zero("tokens.output").alias("output_tokens"), zero("tokens.cache.read").alias("cache_read"), zero("tokens.cache.write").alias("cache_write"),
        zero("tokens.reasoning").alias("reasoning_tokens"), zero("cost").alias("cost_usd"), F.col("finish").alias("finish_reason"),
    )


def blocks(parts: DataFrame, messages: DataFrame) -> DataFrame:
    """Parts that hold at least a byte; role and time come from the part's message, if it is there."""
    parent = _session(_there(messages)).groupBy(F.col("id").alias("messageID")).agg(
        F.max_by(F.struct("role", "session_id", F.col("time.created").alias("created")), F.coalesce("time.completed", "time.created", F.lit(0))).alias("m")
    )
    rows = _there(parts).join(parent, "messageID", "left")
    kind, role = F.col("type"), F.col("m.role")
    named = (
        F.when(kind == "text", F.when(role == "assistant", "assistant_text").otherwise("user_text"))
        .when(kind == "reasoning", "thinking")
        .when(kind == "tool", "tool_result")
    )
    tool = kind == "tool"
    path = F.coalesce(*[F.nullif(F.get_json_object("state.input", f"$.{p}"), F.lit("")) for p in PATHS], F.lit(""))
    return rows.select(
        F.concat(F.lit("oc:pb:"), "id").alias("key"), F.coalesce(F.nullif(F.col("sessionID"), F.lit("")), "m.session_id").alias("session_id"),
        (F.nullif(F.col("m.created"), F.lit(0)) * 1000).alias("ts_us"), named.alias("kind"),
        F.when(tool, F.coalesce("tool", F.lit(""))).otherwise("").alias("tool"), F.when(tool, path).otherwise("").alias("file_path"),
        F.when(tool, F.concat(F.lit("oc:"), F.coalesce("callID", F.lit("")))).alias("tool_use_id"),
        F.coalesce(tool & (F.col("state.status") == "error"), F.lit(False)).alias("is_error"),
        F.coalesce(F.when(tool, F.col("state.output")).otherwise(F.col("text")), F.lit("")).alias("body"),
    ).where("kind IS NOT NULL AND session_id IS NOT NULL AND octet_length(body) > 0").withColumns(
        {"byte_len": F.octet_length("body").cast("long"), "est_tokens": F.expr("(octet_length(body) + 3) div 4"), "content_hash": F.substring(F.sha2("body", 256), 1, 16)}
    )


def entries(parts: DataFrame, messages: DataFrame) -> DataFrame:
    """What a reader sees of each session, in order: session_id, ordinal, ts_us, role, kind, tool, is_error, text.

    Text and reasoning are an entry each; a tool part holds the call and, once there is output, its
    result too. Messages go by id, parts by id within them; parts of messages that aren't there
    are left out. Of a result that is a list of typed blocks, texts and a mark for each image are shown.
    """
    parent = _session(_there(messages)).groupBy("id").agg(
        F.max_by(F.struct("role", "session_id", F.col("time.created").alias("created")), F.coalesce("time.completed", "time.created", F.lit(0))).alias("m")
    )
    rows = _there(parts).withColumn("_of", F.coalesce(F.nullif(F.col("messageID"), F.lit("")), "folder")).withColumnRenamed("id", "part_id")
    rows = rows.join(parent, F.col("_of") == F.col("id"))
    kind, role = F.col("type"), F.coalesce("m.role", F.lit(""))
    text = lambda c: F.coalesce(c, F.lit(""))
    one = lambda name, said, tool=F.lit(""), bad=F.lit(False): F.struct(F.lit(name).alias("kind") if isinstance(name, str) else name.alias("kind"), tool.alias("tool"), bad.alias("is_error"), said.alias("text"))
    listed = F.from_json("state.output", "array<struct<type:string,text:string>>")
    shown = F.transform(F.filter(listed, lambda b: b["type"].isin("text", "image")), lambda b: F.when(b["type"] == "image", "[image]").otherwise(text(b["text"])))
    typed = F.col("state.output").startswith("[") & F.exists(listed, lambda b: b["type"].isNotNull())
    output = F.when(typed, F.array_join(shown, "\n")).otherwise(text(F.col("state.output")))
    call = one("tool_use", text(F.col("state.input")), text(F.col("tool")))
    result = one("tool_result", output, text(F.col("tool")), F.coalesce(F.col("state.status") == "error", F.lit(False)))
    seen = (
        F.when(kind == "text", F.array(one(F.when(role == "assistant", "assistant_text").otherwise("user_text"), text(F.col("text")))))
        .when(kind == "reasoning", F.array(one("thinking", text(F.col("text")))))
        .when((kind == "tool") & (F.length(text(F.col("state.output"))) > 0), F.array(call, result))
        .when(kind == "tool", F.array(call))
    )
    by = Window.partitionBy("session_id").orderBy("_of", "part_id", "_n")
    rows = rows.select(F.col("m.session_id").alias("session_id"), "_of", "part_id", (F.nullif(F.col("m.created"), F.lit(0)) * 1000).alias("ts_us"), role.alias("role"), F.posexplode(seen).alias("_n", "e"))
    return rows.select("session_id", (F.row_number().over(by) - 1).alias("ordinal"), "ts_us", "role", "e.*")

"""Transcripts in JSON lines: requests, blocks and compactions. One event a line, files of any number and size.

Content is a text or a list of parts; which of the two is taken from the parsed line, so a text
that looks like a list stays a text. Lines that are no JSON give no rows; `ingest_stats` counts them.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from usagelens.operators import search
from usagelens.operators.merge import last_wins

_LINE = """type string, uuid string, sessionId string, timestamp string, cwd string, slug string, requestId string, promptId string, subtype string, isMeta boolean,
 message struct<id:string,model:string,stop_reason:string,content:string,usage:struct<input_tokens:long,output_tokens:long,
 cache_creation_input_tokens:long,cache_read_input_tokens:long,service_tier:string,speed:string,
 cache_creation:struct<ephemeral_5m_input_tokens:long,ephemeral_1h_input_tokens:long>>>,
 toolUseResult string, aiTitle string, customTitle string, agentName string, compactMetadata struct<trigger:string,preTokens:long>"""
_PARTS = "array<struct<type:string,text:string,thinking:string,id:string,name:string,input:string,tool_use_id:string,is_error:boolean,content:variant>>"
_PATHS = ("file_path", "filePath", "path", "notebook_path")
SYNTHETIC = "<synthetic>"


def numbered(rows: DataFrame) -> DataFrame:
    """Rows read from text files as file, line (1, 2, ... in each file), value; nothing is sorted or gathered.

    A task numbers the lines of each part of a file that it reads, as they lie one after the other.
    What comes before a part is the sum of the lines of the parts before it: a row per part is
    counted for that, and only parts that don't begin a file have something to add.
    """
    part = ["file", "_block"]
    rows = rows.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), "value"
    )
    parts = rows.groupBy(*part).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*part, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_base"))
    return rows.join(parts, part).select("file", (F.col("_id") + F.col("_base")).alias("line"), "value")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Lines below `path` with their file and number in it, from 1, however many parts a file is read in."""
    return numbered(spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path))


def parse(lines: DataFrame) -> DataFrame:
    """Lines (file, line, value) as typed rows; the session is the file's stem where none is given."""
    stem = F.regexp_extract("file", r"([^/]*?)(\.[^./]*)?$", 1)
    tree = F.try_parse_json("value")
    listed = F.coalesce(F.schema_of_variant(F.try_variant_get(tree, "$.message.content", "variant")).startswith("ARRAY"), F.lit(False))
    rows = lines.where(tree.isNotNull()).select("file", "line", F.from_json("value", _LINE).alias("e"), listed.alias("listed"))
    return rows.select("file", "line", "listed", "e.*").withColumns(
        {"session_id": F.coalesce(F.nullif(F.col("sessionId"), F.lit("")), stem), "ts_us": F.unix_micros(F.col("timestamp").try_cast("timestamp"))}
    )


def requests(parsed: DataFrame) -> DataFrame:
    """One row per assistant line that reports usage; the same call may come on several lines (`merge.first_wins`)."""
    m, u = F.col("message"), F.col("message.usage")
    number = lambda c: F.coalesce(u[c], F.lit(0)).alias(c)
    split = u["cache_creation"]
    return parsed.where((F.col("type") == "assistant") & u.isNotNull() & (F.coalesce(m["model"], F.lit("")) != SYNTHETIC)).select(
        request_key().alias("key"),
        "file", "line", "session_id", "ts_us", m["model"].alias("model"), number("input_tokens"), number("output_tokens"),
        number("cache_read_input_tokens"), number("cache_creation_input_tokens"), split["ephemeral_5m_input_tokens"].alias("write_5m"),
        split["ephemeral_1h_input_tokens"].alias("write_1h"), m["stop_reason"].alias("finish_reason"), u["speed"].alias("speed"), u["service_tier"].alias("service_tier"),
    )


def request_key() -> Column:
    """The identity of a call: its message and request id, else the line's own id."""
    known = (F.coalesce("message.id", F.lit("")) != "") & (F.coalesce("requestId", F.lit("")) != "")
    named = F.concat_ws(":", F.lit("cc"), "message.id", "requestId")
    return F.when(known, named).otherwise(F.concat(F.lit("cc:uuid:"), F.coalesce("uuid", F.lit(""))))


def parts(parsed: DataFrame) -> DataFrame:
    """Lines of both sides, one row for each part `p` of their content; a plain text is one part."""
    text = F.struct(F.lit("text").alias("type"), F.col("message.content").alias("text"))
    whole = F.from_json(F.to_json(F.array(text)), _PARTS)
    found = F.when(F.col("listed"), F.from_json("message.content", _PARTS)).otherwise(whole)
    return parsed.where(F.col("type").isin("assistant", "user") & F.col("message.content").isNotNull()).select("*", F.posexplode(found).alias("pos", "p"))


def blocks(parsed: DataFrame) -> DataFrame:
    """Content parts that hold at least a byte, sized and hashed (`attributed` gives results their tool).

    What a result holds counts in its JSON form, a text with its quotes.
    `key` is the same for the same part in copies of a file: results and uses go by their id,
    texts by what they say within their call, prompt or session (`unique`).
    """
    rows = parts(parsed.where((F.col("type") != "assistant") | (F.coalesce("message.model", F.lit("")) != SYNTHETIC)))
    kind, user = F.col("p.type"), F.col("type") == "user"
    named = (
        F.when(user & (kind == "text"), F.when(F.coalesce("isMeta", F.lit(False)), "meta_text").otherwise("user_text"))
        .when(user & kind.isin("image", "tool_result"), kind)
        .when(~user & (kind == "text"), "assistant_text")
        .when(~user & kind.isin("thinking", "tool_use"), kind)
    )
    body = F.when(kind == "thinking", F.col("p.thinking")).when(kind == "tool_use", F.col("p.input")).when(kind == "tool_result", F.to_json("p.content"))
    body = F.coalesce(body, F.when(kind == "image", F.to_json("p")).otherwise(F.col("p.text")), F.lit(""))
    at = lambda c, *paths: [F.nullif(F.get_json_object(c, f"$.{x}"), F.lit("")) for x in paths]
    path = F.coalesce(*at("p.input", *_PATHS), F.when(kind == "tool_result", F.coalesce(*at("toolUseResult", "filePath", "file.filePath"))), F.lit(""))
    tool = F.when(kind == "tool_use", F.coalesce("p.name", F.lit(""))).otherwise("")
    size = F.octet_length("body").cast("long")
    return rows.select("file", "line", "pos", "session_id", "ts_us", named.alias("kind"), tool.alias("tool"), path.alias("file_path"),
        F.coalesce("p.id", "p.tool_use_id").alias("tool_use_id"), F.coalesce("p.is_error", F.lit(False)).alias("is_error"), body.alias("body"),
        request_key().alias("_request"), F.coalesce(F.nullif("promptId", F.lit("")), "session_id").alias("_prompt"),
        F.concat_ws(":", F.coalesce("message.id", F.lit("")), F.coalesce("requestId", F.lit(""))).alias("_call"),
    ).where("kind IS NOT NULL AND octet_length(body) > 0").withColumns(
        {"mcp_server": F.regexp_extract("tool", "^mcp__(.*?)__", 1), "byte_len": size, "est_tokens": F.expr("(octet_length(body) + 3) div 4"), "content_hash": F.substring(F.sha2("body", 256), 1, 16)}
    ).withColumn("key", block_key()).drop("_request", "_prompt", "_call")


def block_key() -> Column:
    kind, told, empty = F.col("kind"), F.col("content_hash"), F.lit("")
    key = lambda *of: F.concat_ws(":", *[F.lit(x) if isinstance(x, str) else x for x in ("cc", *of)])
    by_id = F.coalesce("tool_use_id", empty)
    return (
        F.when(kind == "assistant_text", key("ab", F.col("_call"), "t", told)).when(kind == "thinking", key("ab", F.col("_call"), "th", told))
        .when(kind == "tool_use", F.when(by_id != "", key("tu", by_id)).otherwise(key("tu", F.col("_request"), told)))
        .when(kind == "tool_result", F.when(by_id != "", key("tr", by_id)).otherwise(key("tr", F.col("session_id"), told)))
        .when(kind == "image", key("im", F.col("session_id"), told)).otherwise(key("ut", F.col("_prompt"), told))
    )


def unique(rows: DataFrame) -> DataFrame:
    """One row per key: the last version, in the session that had it first."""
    return last_wins(rows, ["key"], ["file", "line", "pos"], first=("session_id",))


def reference_events(rows: DataFrame) -> DataFrame:
    """Blocks as `search.verdicts` takes them: what results brought, and what was said or asked for after it.

    Sources are texts of either side, thoughts and the values in a tool's input; text that the
    harness put in is neither, since it repeats what it saw.
    """
    place = F.struct("line", "pos")
    said = F.when(F.col("kind") == "tool_use", F.array_join(string_values("body"), "\n")).otherwise(F.col("body"))
    return rows.where("kind IN ('assistant_text', 'thinking', 'tool_use', 'user_text', 'tool_result')").select(
        F.col("file").alias("file_id"), place.alias("pos"), "ts_us", (F.col("kind") != "tool_result").alias("is_source"), place.alias("block_id"), said.alias("text")
    )


def result_text(content: Column) -> Column:
    """A result as text: a text as it is, of a list its texts with a mark for each image, anything else as JSON."""
    kind = F.schema_of_variant(content)
    listed = F.from_json(F.to_json(content), "array<struct<type:string,text:string>>")
    shown = F.transform(F.filter(listed, lambda x: x["type"].isin("text", "image")), lambda x: F.when(x["type"] == "image", "[image]").otherwise(F.coalesce(x["text"], F.lit(""))))
    text = F.when(kind == "STRING", F.try_variant_get(content, "$", "string")).when(kind == "ARRAY<VOID>", "").when(kind.startswith("ARRAY<OBJECT"), F.array_join(shown, "\n"))
    return F.coalesce(text, F.to_json(content), F.lit(""))


def entries(parsed: DataFrame) -> DataFrame:
    """What a reader of the transcript sees, numbered from 0 in each file: parts of both sides and compactions."""
    kind, user = F.col("p.type"), F.col("type") == "user"
    told = F.when(~user, "assistant_text").when(F.coalesce("isMeta", F.lit(False)), "meta_text").otherwise("user_text")
    text = F.when(kind == "text", F.col("p.text")).when(kind == "thinking", F.col("p.thinking")).when(kind == "tool_use", F.col("p.input"))
    text = text.when(kind == "tool_result", result_text(F.col("p.content"))).when(kind == "image", "[image]")
    same = ["file", "line", "session_id", "ts_us"]
    rows = parts(parsed).where(kind.isin("text", "thinking", "tool_use", "tool_result", "image")).select(
        *same, "pos", F.col("type").alias("role"), F.when(kind == "text", told).otherwise(kind).alias("kind"), F.coalesce("p.name", F.lit("")).alias("tool"),
        F.coalesce("p.id", "p.tool_use_id").alias("tool_use_id"), F.coalesce("p.is_error", F.lit(False)).alias("is_error"), F.coalesce(text, F.lit("")).alias("text"),
    )
    c = F.col("compactMetadata")
    cut = F.concat(F.lit("compaction ("), F.coalesce(c["trigger"], F.lit("")), F.lit(", pre: "), F.coalesce(c["preTokens"], F.lit(0)).cast("string"), F.lit(" tokens)"))
    cuts = parsed.where((F.col("type") == "system") & (F.col("subtype") == "compact_boundary")).select(
        *same, F.lit(0).alias("pos"), F.lit("system").alias("role"), F.lit("compaction").alias("kind"), F.lit("").alias("tool"),
        F.lit(None).cast("string").alias("tool_use_id"), F.lit(False).alias("is_error"), F.when(c.isNull(), "compaction").otherwise(cut).alias("text"),
    )
    both = rows.unionByName(cuts)
    # one partitioning by file serves both: the place in it, and the latest use of an id before a result
    use = F.last(F.when(F.col("kind") == "tool_use", F.col("tool")), ignorenulls=True).over(
        Window.partitionBy("file", "tool_use_id").orderBy("line", "pos").rowsBetween(Window.unboundedPreceding, -1)
    )
    named = F.when((F.col("kind") == "tool_result") & F.col("tool_use_id").isNotNull(), F.coalesce(use, F.lit(""))).otherwise(F.col("tool"))
    ordinal = F.row_number().over(Window.partitionBy("file").orderBy("line", "pos")) - 1
    return both.withColumn("tool", named).withColumn("ordinal", ordinal).drop("tool_use_id", "pos")


def raw_match(lines: DataFrame, query: str) -> DataFrame:
    """Lines of those files that hold the query at all, told before anything is parsed.

    A query with characters that JSON may write otherwise passes every file on.
    """
    if any(not " " <= c <= "~" or c in '"\\<>&/' for c in query):
        return lines
    found = lines.where(F.lower("value").contains(query.lower())).select("file").distinct()
    return lines.join(found, "file", "left_semi")


def search_lines(lines: DataFrame, query: str, hits: int = search.HITS) -> DataFrame:
    """The first entries of each file that hold the query, with the file's number of such entries."""
    rows = entries(parse(raw_match(lines, query)))
    rows = rows.select(F.col("file").alias("session_id"), F.col("file").alias("file_id"), F.col("ordinal").alias("pos"), F.col("ordinal").alias("block_id"), "kind", "text")
    return search.search(rows, query, hits).withColumnsRenamed({"session_id": "file", "block_id": "ordinal"})


def attributed(rows: DataFrame) -> DataFrame:
    """Blocks; a result has the tool, server and file (its own if the use names none) of the latest use of its id before it in its file."""
    before = Window.partitionBy("file", "tool_use_id").orderBy("line", "pos").rowsBetween(Window.unboundedPreceding, -1)
    use = F.last(F.when(F.col("kind") == "tool_use", F.struct("tool", "mcp_server", "file_path")), ignorenulls=True).over(before)
    result = (F.col("kind") == "tool_result") & F.col("_u").isNotNull()
    others = rows.where("kind NOT IN ('tool_use', 'tool_result') OR tool_use_id IS NULL")  # without an id there is nothing to look up
    took = {c: F.when(result, F.col(f"_u.{c}")).otherwise(F.col(c)) for c in ("tool", "mcp_server")}
    took["file_path"] = F.when(result & (F.col("_u.file_path") != ""), F.col("_u.file_path")).otherwise(F.col("file_path"))
    paired = rows.where("kind IN ('tool_use', 'tool_result') AND tool_use_id IS NOT NULL").withColumn("_u", use).withColumns(took).drop("_u")
    return paired.unionByName(others)


def compactions(parsed: DataFrame) -> DataFrame:
    return parsed.where((F.col("type") == "system") & (F.col("subtype") == "compact_boundary")).select(
        "session_id", "ts_us", F.coalesce("compactMetadata.trigger", F.lit("")).alias("cause"), F.col("compactMetadata.preTokens").alias("pre_tokens")
    ).dropDuplicates(["session_id", "ts_us"])


def sessions(parsed: DataFrame) -> DataFrame:
    """Each file's session: first folder and slug, last title (a person's before a model's) and agent name, span.

    Versions from several files go on to `merge.merge_sessions`.
    """
    some = lambda c: F.when(F.col(c) != "", F.col("line"))
    said = lambda c, kind: F.max_by(c, F.when(F.col("type") == kind, some(c)))
    found = parsed.groupBy("file", "session_id").agg(
        F.min_by("cwd", some("cwd")).alias("cwd"), F.min_by("slug", some("slug")).alias("slug"),
        F.coalesce(said("customTitle", "custom-title"), said("aiTitle", "ai-title"), F.lit("")).alias("title"),
        F.coalesce(said("agentName", "agent-name"), F.lit("")).alias("agent"), F.min("ts_us").alias("started_us"), F.max("ts_us").alias("ended_us"),
    )
    return found.withColumns({"cwd": F.coalesce("cwd", F.lit("")), "slug": F.coalesce("slug", F.lit(""))}).withColumn("project", F.regexp_extract("cwd", "([^/]*)/*$", 1))


def text_values(value) -> list[str]:
    if isinstance(value, str):
        return [value]
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else []
    return [x for v in inner for x in text_values(v)]


def string_values(column: str) -> Column:
    """All text values in a column of JSON documents however deep, keys aside, in their order; what is no JSON counts as one text."""

    @F.pandas_udf(ArrayType(StringType()))
    def found(texts: pd.Series) -> pd.Series:
        def parsed(text):
            try:
                return text_values(json.loads(text))
            except (ValueError, RecursionError):
                return [text]
            except TypeError:
                return None  # no text at all

        return texts.map(parsed)

    return found(column)


def ingest_stats(lines: DataFrame) -> DataFrame:
    """Files, lines and lines that are no JSON (blank ones aside): one row."""
    bad = F.try_parse_json("value").isNull() & (F.trim("value") != "")
    return lines.agg(F.countDistinct("file").alias("files"), F.count("*").alias("lines"), F.count_if(bad).alias("parse_errors"))

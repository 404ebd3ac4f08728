"""Content search, transcript pages, identifiers and what came of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AROUND = 90
HITS = 3
PAGE = 500
MOST_IDENTIFIERS, MOST_CLAIMS = 800, 8


def entries(blocks: DataFrame) -> DataFrame:
    """Blocks in reading order with their ordinal in the file's conversation."""
    by = Window.partitionBy("file_id").orderBy("pos", "block_id")
    return blocks.select("file_id", (F.row_number().over(by) - 1).alias("ordinal"), "kind", "tool", "is_error", "est_tokens", "text")


def page(rows: DataFrame, file_id: int, offset: int = 0, limit: int = PAGE, query: str | None = None) -> DataFrame:
    """Entries offset .. offset + limit of one conversation, filtered first if a query is given."""
    return page_of(entries(rows.where(F.col("file_id") == file_id)), "file_id", offset, limit, query)


def page_of(rows: DataFrame, by: str, offset: int = 0, limit: int = PAGE, query: str | None = None) -> DataFrame:
    """Entries (`by`, ordinal, text, ...) offset .. offset + limit of each conversation, filtered first if a query is given."""
    if query:
        rows = rows.where(F.lower("text").contains(query.lower()))
    at = F.row_number().over(Window.partitionBy(by).orderBy("ordinal"))
    return rows.withColumn("_at", at).where((F.col("_at") > offset) & (F.col("_at") <= offset + limit)).drop("_at")


def snippet(text: Column, query: str, around: int = AROUND) -> Column:
    """The first match with some characters around it, white space collapsed, dots where cut."""
    at = F.instr(F.lower(text), F.lit(query.lower()))
    begin = F.greatest(F.lit(1), at - around)
    end = F.least(F.length(text), at + len(query) - 1 + around)
    cut = F.trim(F.regexp_replace(F.substring(text, begin, end - begin + 1), "[ \\t\\n\\r]+", " "))
    return F.concat(F.when(begin > 1, "…").otherwise(""), cut, F.when(end < F.length(text), "…").otherwise(""))


def search(blocks: DataFrame, query: str, hits: int = HITS) -> DataFrame:
    """The first hits of each session, with the session's number of matches."""
    found = blocks.where(F.lower("text").contains(query.lower()))  # before anything is sorted
    by = Window.partitionBy("session_id").orderBy("file_id", "pos")
    found = found.withColumn("n", F.row_number().over(by)).withColumn("matches", F.count("*").over(Window.partitionBy("session_id")))
    return found.where(F.col("n") <= hits).select("session_id", "n", "matches", "block_id", "kind", snippet(F.col("text"), query).alias("snippet"))


def search_sessions(sessions: DataFrame, blocks: DataFrame, query: str, limit: int = 80) -> DataFrame:
    """Sessions with a match in content, title or slug among the newest `limit`, and whether the limit was met."""
    newest = sessions.withColumn("last_us", F.greatest("started_us", "ended_us")).orderBy(F.desc("last_us"), "session_id").limit(limit)
    total = newest.agg((F.count("*") == limit).alias("truncated"))
    low = query.lower()
    matches = blocks.where(F.lower("text").contains(low)).groupBy("session_id").agg(F.count("*").alias("matches"))
    rows = newest.join(matches, "session_id", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    named = F.lower("title").contains(low) | F.lower("slug").contains(low)
    return rows.where((F.col("matches") > 0) | named).join(F.broadcast(total)).select("session_id", "slug", "last_us", "matches", "truncated")


#: A run of name characters from its first letter, digit or _ to its last.
NAME = "[A-Za-z0-9_](?:[A-Za-z0-9_./-]*[A-Za-z0-9_])?"
MARKED = "[0-9_./-]|[a-z][A-Z]"


def names(text: Column) -> Column:
    """Distinct names of a text in their order, a path's base name right after it."""
    paired = lambda x: F.when(x.contains("/"), F.array(x, F.substring_index(x, "/", -1))).otherwise(F.array(x))
    return F.array_distinct(F.flatten(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(NAME), F.lit(0))), paired)))


def distinctive(name: Column) -> Column:
    return F.length(name).between(5, 80) & name.rlike(MARKED) & name.rlike("[A-Za-z]")


def identifiers(text: Column) -> Column:
    """Distinct distinctive identifiers of a text in their order, a path's base name right after it."""
    return F.filter(names(text), distinctive)


def identifier_rows(rows: DataFrame, text: str) -> DataFrame:
    """A row for each identifier of a text, beside the other columns; judged row by row, in compiled code."""
    rest = [c for c in rows.columns if c != text]
    return rows.select(*rest, F.explode(names(F.col(text))).alias("identifier")).where(distinctive(F.col("identifier")))


def verdicts(events: DataFrame) -> DataFrame:
    """Whether later text took up what a result brought: 1 referenced, 2 not, 0 unknown, and when.

    events: file_id, pos, ts_us, is_source, block_id, text. An identifier first seen in a later
    source credits the results that brought it, unless more than MOST_CLAIMS did, and starts
    anew. Two windows over one partitioning: texts are read and taken apart once.
    """
    every = F.lit((1 << 31) - 1)
    ids = F.slice(identifiers(F.col("text")), 1, F.when(F.col("is_source"), every).otherwise(MOST_IDENTIFIERS))
    rows = events.select("file_id", "pos", "ts_us", "is_source", "block_id", F.explode_outer(ids).alias("id"))
    source = F.col("is_source").cast("long")
    before = Window.partitionBy("file_id", "id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("epoch", F.coalesce(F.sum(source).over(before), F.lit(0)))
    same = Window.partitionBy("file_id", "id", "epoch")
    rows = rows.select(
        "*", F.min(F.when(F.col("is_source"), F.struct("pos", "ts_us"))).over(same).alias("by"), F.sum(1 - source).over(same).alias("claims")
    ).where("not is_source")
    hit = F.col("id").isNotNull() & F.col("by").isNotNull() & (F.col("claims") <= MOST_CLAIMS)
    out = rows.groupBy("file_id", "block_id").agg(F.count("id").alias("ids"), F.sort_array(F.collect_list(F.when(hit, F.col("by")))).alias("h"))
    hits, need = F.size("h"), F.least(F.lit(2), F.col("ids")).cast("int")
    verdict = F.when(F.col("ids") == 0, 0).when(hits >= need, 1).when(hits == 0, 2).otherwise(0)
    return out.select(
        "file_id", "block_id", "ids", hits.cast("long").alias("hits"), verdict.alias("referenced"),
        F.when(verdict == 1, F.get("h", need - 1)["ts_us"]).alias("first_ref_us"),
    )


def verdict_counts(judged: DataFrame) -> DataFrame:
    """How many results were taken up by later text, and how many were judged and weren't: one row."""
    of = lambda v, name: F.count(F.when(F.col("referenced") == v, 1)).alias(name)
    return judged.agg(of(1, "found"), of(2, "missing"), F.count("*").alias("results"))

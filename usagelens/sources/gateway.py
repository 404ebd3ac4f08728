"""Gateway request log: incremental pull behind a cursor, and the mapping of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.sources import ranges

#: The log's columns; `session_id` is a later one.
LOG = "id long, request_id string, ts string, model string, backend_model string, resolved_via string, api_class string, status long, latency_ms long, prompt_tokens long, completion_tokens long, cache_creation_input_tokens long, cache_read_input_tokens long, prefix_hash_chain string"


def cursors(loaded: DataFrame) -> DataFrame:
    """The largest origin id that each source has loaded."""
    return loaded.groupBy("source").agg(F.coalesce(F.max("pg_id"), F.lit(0)).alias("cursor"))


def pull(origin: DataFrame, source: str, after: int = 0) -> DataFrame:
    """Rows past the cursor. The filter reaches the scan; an origin without session ids gives ''."""
    session = F.coalesce("session_id", F.lit("")) if "session_id" in origin.columns else F.lit("")
    chain = F.coalesce("prefix_hash_chain", F.lit(""))
    return origin.where(F.col("id") > after).withColumns(
        {
            "source": F.lit(source), "pg_id": F.col("id"), "key": F.concat(F.lit(source + "#"), F.col("id").cast("string")),
            "session_id": session, "chain_len": F.when(chain == "", 0).otherwise(F.size(F.split(chain, ","))),
        }
    ).drop("id")


def merged(pulled: DataFrame) -> DataFrame:
    """One row per key. A row doesn't change once it is written, so one that is pulled again adds nothing."""
    return pulled.dropDuplicates(["key"])


def origin(spark: SparkSession, after: int = 0, stream: bool = False, with_session: bool = True, table: str = "router_requests", **options: str | int) -> DataFrame:
    """The gateway's log in a database, for `pull`: ranges of ids behind the cursor, or a stream whose offset is the id.

    options: those of `ranges`; rows come in batches of 5,000 unless `batch` says otherwise.
    """
    schema = LOG + ", session_id string" * with_session
    return ranges.table(spark, schema, stream, table=table, after=after, **options)

"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points of a 64-bit ring. A row's place is the hash of its doc_id; it
belongs to the next point clockwise, and where that shard is full it goes on clockwise to the
next one with room. With `slack` 0 the bounds are the even shares themselves, so row counts
differ by one at most (law `rows`); a larger slack moves fewer rows when shards come or go.

Only counts per arc reach the driver: shards x vnodes numbers, whatever the table's size. They
need the ids alone, and texts only where an id is null, so a first pass over those columns takes
the place of a written table. From them `plan` decides which stretch of each arc's rows goes to
which shard and slot; a row then needs its exact rank in its arc, which `with_offsets` gives
without a window over a whole arc.
Equal rows (same doc_id, size and checksum) are counted first, so a row that fills a third of
the table is one entry, split again in blocks of COPIES.

Defined results: a null text has size 1 and checksum 0; a null doc_id is placed by its checksum;
repeated rows take one slot each; an empty table gives an empty result; extra columns are
ignored, whatever they are called. The rows are read twice, so `docs` must give the same ones
each time; an arc that has more the second time ends the job, fewer go unnoticed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import root_of, with_offsets

SHARDS = 16
VNODES = 64
COPIES = 4096


def ring(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Points in ring order and the shard of each."""
    place = lambda s, v: int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big", signed=True)
    points = sorted((place(s, v), s) for s in range(shards) for v in range(vnodes))
    return np.array([p for p, _ in points], dtype=np.int64), np.array([s for _, s in points])


def plan(counts: np.ndarray, owners: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, rows, shard, first slot) for the rows of every arc, hop by hop.

    counts: rows of each arc in ring order; owners: the shard at its end; bounds: each shard's room.
    """
    left, taken, done = counts.astype(np.int64).copy(), np.zeros(len(bounds), dtype=np.int64), np.zeros_like(counts, dtype=np.int64)
    out, arcs = [], len(counts)
    for hop in range(arcs):
        waiting = np.flatnonzero(left)
        if not len(waiting):
            break
        for arc in waiting:
            shard = owners[(arc + hop) % arcs]
            rows = min(left[arc], bounds[shard] - taken[shard])
            if rows > 0:
                out.append((int(arc), int(done[arc]), int(rows), int(shard), int(taken[shard])))
                left[arc] -= rows
                done[arc] += rows
                taken[shard] += rows
    if left.any():
        raise ValueError("the shards have less room than there are rows")
    return out


def assign(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of `docs`."""
    if shards < 1 or vnodes < 1 or slack < 0:
        raise ValueError("shards and vnodes start at 1, slack at 0")
    points, owners = ring(shards, vnodes)

    @F.pandas_udf("int")
    def arc_of(places: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(points, places.to_numpy()) % len(points), dtype="int32")

    text = F.coalesce("text", F.lit(""))
    crc = F.crc32(text.cast("binary"))
    id_type = dict(docs.dtypes)["doc_id"]  # ids may be numbers or texts
    known, unknown = docs.where("doc_id is not null"), docs.where("doc_id is null")
    places = known.select(F.xxhash64("doc_id").alias("p")).union(unknown.select(F.xxhash64(crc.cast(id_type)).alias("p")))
    found = places.groupBy(arc_of("p").alias("arc")).agg(F.count("*").alias("rows")).collect()
    counts = np.zeros(len(points), dtype=np.int64)
    for r in found:
        counts[r["arc"]] = r["rows"]
    total = int(counts.sum())
    if slack:
        bounds = np.full(shards, -(-int(total * (1 + slack)) // shards) + 1)
    else:
        bounds = np.array([total // shards + (s < total % shards) for s in range(shards)])
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    parts = sorted((int(starts[a]) + at, shard, slot) for a, at, _, shard, slot in plan(counts, owners, bounds))
    begin, shard_of, slot_of = (np.array([p[i] for p in parts], dtype=np.int64) for i in range(3))

    @F.pandas_udf("shard int, slot long")
    def lookup(arc: pd.Series, rank: pd.Series) -> pd.DataFrame:
        if (rank.to_numpy() >= counts[arc.to_numpy()]).any():
            raise ValueError("the documents changed between two reads")
        at = starts[arc.to_numpy()] + rank.to_numpy()
        part = np.searchsorted(begin, at, side="right") - 1
        return pd.DataFrame({"shard": shard_of[part].astype("int32"), "slot": slot_of[part] + at - begin[part]})

    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), crc.alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    rows = rows.withColumn("blk", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {COPIES}"))))
    place = F.xxhash64(F.coalesce("doc_id", F.col("text_crc32").cast(id_type)))
    arc = F.coalesce(arc_of(place), F.lit(0))  # plainly never null: a filter on it would call it once more
    rows = rows.withColumn("n", F.least(F.lit(COPIES), F.col("n") - F.col("blk") * COPIES)).withColumn("arc", arc)
    ranked = with_offsets(rows, ["arc"], ["doc_id", "size", "text_crc32", "blk"], F.col("n"), "before", root_of(total))
    ranked = ranked.withColumn("i", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    return ranked.withColumn("x", lookup("arc", F.col("before") + F.col("i"))).select(
        "doc_id", "size", "text_crc32", "x.shard", "x.slot"
    )


def op10(spark, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

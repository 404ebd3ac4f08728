"""Approximate nearest neighbours by cross-polytope hashing.

A table turns unit vectors by three rounds of random signs and a fast Hadamard transform and
assigns each to the nearest signed axis. As many such functions are joined as one table needs for
buckets of about VECTORS rows (`functions_for`), so their number follows the logarithm of the
rows. A query probes, in each table, the buckets whose axes together are nearest to it. How many
is measured: SAMPLE queries, first in a hashed order, are compared with all vectors, and of
PROBES the least number is taken that would have found TARGET of their neighbours. If none does,
all queries meet all vectors. The sample's own answers come from the probes like all others'.

A bucket's vectors and the queries that probe it meet in blocks: (table, bucket, block of
vectors, block of queries) is one task's group, however full a bucket is. A group returns each
query's best few by exact inner product in double precision. These lists are merged per query,
table and CHUNK blocks of vectors first, then per query.

Equal vectors are one entry first. Of each entry only the K + 1 smallest ids can ever be in a
list (ties go to the smaller id), so an entry keeps those, and the queries with that vector share
one search. No row is dropped that could be in a result.

Where norms differ, nearness by inner product isn't nearness of directions. There a vector gets one more
component, what it lacks to the longest one's norm, and a query gets 0: of such vectors, all of one
norm, the order by angle to the query is that of the inner products, so these are what is hashed. Scores
stay those of the vectors themselves.

Queries whose probes find fewer than K others meet all vectors, in the same blocks.

On vectors without structure, such as the test table's, neighbours are hardly nearer than others
and the measured number of probes ranks a large part of all rows; see the README.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components,
take no part; queries meet vectors of their own length only; a repeated vec_id is one candidate
and one query per row; fewer candidates than K give fewer rows; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens.llm.common import materialize

K = 20
TABLES = 8
#: Numbers of buckets probed in each table, of which the least that serves is chosen.
PROBES = (2, 4, 8, 12, 16, 24, 32, 64, 128, 256)
TARGET, SAMPLE = 0.95, 200
CHUNK = 16
VECTORS, QUERIES = 8192, 1024
#: Buckets up to this number are broadcast with their counts; more are joined.
FEW_BUCKETS = 200_000
EVERY = 20
#: Relative difference of norms that counts as rounding.
NORMS = 1e-4


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, of length 2^k, scaled to keep norms."""
    n, step = x.shape[1], 1
    x = x.copy()
    while step < n:
        y = x.reshape(len(x), n // (2 * step), 2, step)
        a, b = y[:, :, 0, :].copy(), y[:, :, 1, :].copy()
        y[:, :, 0, :], y[:, :, 1, :] = a + b, a - b
        step *= 2
    return x / math.sqrt(n)


def padded(d: int) -> int:
    return 1 << max(0, d - 1).bit_length()


def functions_for(rows: int, d: int, vectors: int = VECTORS) -> int:
    """How many functions make buckets of about `vectors` rows."""
    n, buckets = 1, 2 * padded(d)
    while buckets**n * vectors < rows and buckets ** (n + 1) < 1 << 62:
        n += 1
    return n


def turned(x: np.ndarray, table: int, seed: int = 5) -> np.ndarray:
    """Unit rows, padded to a power of two, pseudo-rotated for one function."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    size = padded(x.shape[1])
    x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
    rng = np.random.default_rng([seed, table, size])
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], size))
    return x


def axes(x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the signed axes nearest to it, nearest first, and their coordinates; +j is j, -j is size + j."""
    both = np.concatenate([x, -x], axis=1)
    probes = min(probes, both.shape[1])
    top = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
    order = np.argsort(-np.take_along_axis(both, top, 1), axis=1, kind="stable")
    top = np.take_along_axis(top, order, 1)
    return top, np.take_along_axis(both, top, 1)


def probed(x: np.ndarray, table: int, functions: int, probes: int) -> np.ndarray:
    """For each row the buckets of a table nearest to it, nearest first: the functions' axes as one number."""
    out = near = None
    for f in range(functions):
        one, at = axes(turned(x, table * 64 + f), probes)
        if out is None:
            out, near = one.astype(np.int64), at
            continue
        sums = (near[:, :, None] + at[:, None, :]).reshape(len(x), -1)
        both = (out[:, :, None] * (2 * padded(x.shape[1])) + one[:, None, :]).reshape(len(x), -1)
        order = np.argsort(-sums, axis=1, kind="stable")[:, :probes]
        out, near = np.take_along_axis(both, order, 1), np.take_along_axis(sums, order, 1)
    return out


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def best(scores: np.ndarray, ids: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best single ids of entries with these scores, ties to the smaller id."""
    flat = np.concatenate(ids)
    each = np.repeat(scores, [len(x) for x in ids])
    order = np.lexsort((flat, -each))[:k]
    return flat[order], each[order]


def levelled(x: np.ndarray, longest: float, ask: bool) -> np.ndarray:
    """Rows with a component more: for entries what they lack to the norm `longest`, for queries 0."""
    lacks = np.zeros(len(x)) if ask else np.sqrt(np.maximum(0.0, longest**2 - (x * x).sum(axis=1)))
    return np.column_stack([x, lacks])


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def nearest(rows: DataFrame, k: int = K, every: int = EVERY, tables: int = TABLES, vectors: int = VECTORS) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by `every`."""
    spark = rows.sparkSession
    rows = rows.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    # + 0.0 makes negative zeros equal to others
    rows = rows.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0).cast("float")))
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    entries = rows.distinct().withColumn("_r", rank).where(F.col("_r") <= k + 1)
    asking = rows.where(F.col("vec_id") % every == 0)
    entries = entries.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = asking.select("embedding").distinct().withColumn("asks", F.lit(True))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    entries = entries.join(asked, "embedding", "left").withColumns({"entry": F.col("ids")[0], "d": F.size("embedding"), "norm": norm})
    entries = materialize(entries, "entries")
    per_size = materialize(
        entries.groupBy("d").agg(F.count("*").alias("n"), F.min("norm").alias("low"), F.max("norm").alias("top")), "norms"
    )
    entries = entries.join(F.broadcast(per_size), "d")  # a row for each length of vectors
    block = lambda n: F.pmod(F.xxhash64("entry"), n)

    def meet(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("query", "int64"), ("t", "int64"), ("c", "int64"), ("ids", object), ("scores", object))})
        xs, out = stacked(v["embedding"]), []
        ids = v["ids"].to_numpy()
        longest = float(np.linalg.norm(xs, axis=1).max())
        for at in range(0, len(q), 256):
            qs = stacked(q["vector"].iloc[at : at + 256])
            near = 1e-12 * longest * np.linalg.norm(qs, axis=1)  # rounding of a matrix product against that of single sums
            rough = qs @ xs.T
            few = min(len(xs), k + 12)
            tops = np.argpartition(-rough, few - 1, axis=1)[:, :few]
            for one, query, top, about, close in zip(qs, q["query"].iloc[at : at + 256], tops, rough, near, strict=True):
                # the last place and all that equal it but for rounding
                top = np.flatnonzero(about >= about[top].min() - close) if few < len(xs) else top
                found, scores = best((xs[top] * one).sum(axis=1), [np.asarray(ids[x]) for x in top], k + 1)
                out.append((query, int(v["t"].iat[0]), int(v["i"].iat[0]) // CHUNK, found, scores))
        return pd.DataFrame(out, columns=["query", "t", "c", "ids", "scores"])

    keys = ["d", "t", "b", "i", "j"]
    # new columns, to tell the sides apart, and keys of one type, as cogroup hashes them as they are
    one = lambda df: df.select(*[(F.col(c).cast("long") if c in keys else F.col(c)).alias(c) for c in df.columns])

    def lists(held: DataFrame, asks: DataFrame, n_asked) -> DataFrame:
        """The best of each block for the queries that meet it; both have d, t, b and m, the entries there."""
        n_blocks = F.ceil(F.col("m") / vectors)
        q_blocks = F.greatest(F.lit(1), F.ceil(n_asked / QUERIES))
        held = held.select(
            "d", "t", "b", block(n_blocks).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), q_blocks - 1)).alias("j"), "ids", "embedding"
        )
        asks = asks.select(
            "d", "t", "b", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)).alias("i"), block(q_blocks).alias("j"),
            F.col("entry").alias("query"), F.col("embedding").alias("vector"),
        )
        sides = one(asks).groupBy(*keys), one(held).groupBy(*keys)
        return sides[0].cogroup(sides[1]).applyInPandas(meet, "query long, t long, c long, ids array<long>, scores array<double>")

    def merged_lists(found: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        ids, scores = np.concatenate(found["ids"].to_numpy()), np.concatenate(found["scores"].to_numpy())
        ids, first = np.unique(ids, return_index=True)
        order = np.lexsort((ids, -scores[first]))[: k + 1]
        return ids[order], scores[first][order]

    def merge_part(found: pd.DataFrame) -> pd.DataFrame:
        ids, scores = merged_lists(found)
        return pd.DataFrame({"query": [found["query"].iat[0]], "ids": [ids], "scores": [scores]})

    def merge(found: pd.DataFrame) -> pd.DataFrame:
        ids, scores = merged_lists(found)
        return pd.DataFrame({"entry": [found["query"].iat[0]], "ids": [ids], "scores": [scores]})

    def merging(found: DataFrame) -> DataFrame:
        part = found.groupBy("query", "t", "c").applyInPandas(merge_part, "query long, ids array<long>, scores array<double>")
        return part.groupBy("query").applyInPandas(merge, "entry long, ids array<long>, scores array<double>")

    whole = lambda df: df.select("entry", "ids", "embedding", "d", F.lit(-1).alias("t"), F.lit(-1).alias("b"), F.col("n").alias("m"))

    # how many probes it takes, by a sample of the queries of each length of vectors
    order = Window.partitionBy("d").orderBy(F.xxhash64("entry"), "entry")
    sample = materialize(entries.where("asks").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= SAMPLE), "sample")
    exact = materialize(merging(lists(whole(entries.join(F.broadcast(sample.select("d").distinct()), "d", "left_semi")), whole(sample), F.lit(SAMPLE))), "exact")
    sizes = per_size.collect()
    #: the longest norm, where norms differ by more than rounding
    longest = {r["d"]: r["top"] for r in sizes if r["top"] > r["low"] * (1 + NORMS)}
    functions = {r["d"]: functions_for(r["n"], r["d"] + (r["d"] in longest), vectors) for r in sizes}
    probes = probes_of(exact, sample, entries, tables, functions, longest, k)
    sent = spark.sparkContext.broadcast((functions, probes, longest))

    @F.pandas_udf("array<struct<t:int,b:long>>")
    def buckets(embeddings: pd.Series, asking: pd.Series) -> pd.Series:
        functions, probes, longest = sent.value
        out: list = [None] * len(embeddings)
        sizes, asks = embeddings.map(len).to_numpy(), asking.to_numpy()
        for size in np.unique(sizes):
            for ask in (False, True):
                at = np.flatnonzero((sizes == size) & (asks == ask))
                n = probes[int(size)] if ask else 1
                if len(at) and n:
                    x = stacked(embeddings.iloc[at])
                    x = levelled(x, longest[int(size)], ask) if int(size) in longest else x
                    found = [probed(x, t, functions[int(size)], n) for t in range(tables)]
                    for i, row in enumerate(at):
                        out[row] = [{"t": t, "b": int(b)} for t in range(tables) for b in found[t][i]]
        return pd.Series(out)

    spread = lambda df, ask: df.select(
        "entry", "ids", "embedding", "d", F.explode(buckets("embedding", F.lit(ask))).alias("x")
    ).select("entry", "ids", "embedding", "d", "x.t", "x.b")
    held, asks = spread(entries, False), spread(entries.where("asks"), True)
    # the entries and the queries of each bucket that has both
    counts = held.groupBy("d", "t", "b").agg(F.count("*").alias("m")).join(asks.groupBy("d", "t", "b").agg(F.count("*").alias("a")), ["d", "t", "b"])
    counts = materialize(counts, "counts")
    small = counts.count() <= FEW_BUCKETS
    counted = lambda df: df.join(F.broadcast(counts) if small else counts, ["d", "t", "b"])
    found = lists(counted(held), counted(asks), F.col("a"))
    merged = materialize(merging(found), "merged")

    # queries with too short a list
    short = F.coalesce(F.size("scores") < k + 1, F.lit(True))
    known = merged.select("entry", "scores")
    again = materialize(entries.where("asks").join(known, "entry", "left").where(short).drop("scores"), "again")
    n_again = again.count()
    if n_again:
        more = merging(lists(whole(entries.join(again.select("d").distinct(), "d", "left_semi")), whole(again), F.lit(n_again)))
        merged = merged.join(again.select("entry"), "entry", "left_anti").unionByName(more)
    mine = asking.join(entries.where("asks").select("embedding", "entry"), "embedding").select(F.col("vec_id").alias("query_id"), "entry")
    found = mine.join(merged, "entry").select(
        "query_id",
        F.explode(
            F.transform(
                F.slice(F.filter(F.arrays_zip("ids", "scores"), lambda x: x["ids"] != F.col("query_id")), 1, k),
                lambda x, i: F.struct((i + 1).cast("int").alias("rank"), x["ids"].alias("vec_id"), x["scores"].alias("score")),
            )
        ).alias("x"),
    )
    return found.select("query_id", "x.rank", "x.vec_id", "x.score")


def probes_of(exact: DataFrame, sample: DataFrame, entries: DataFrame, tables: int, functions: dict[int, int], longest: dict[int, float], k: int) -> dict[int, int]:
    """For each length of vectors the least of PROBES that finds TARGET of the sample's neighbours; 0 if none does.

    At most SAMPLE queries of each length and their neighbours' vectors reach the driver.
    """
    pairs = exact.join(sample.select("entry", F.col("embedding").alias("q")), "entry")
    pairs = pairs.select("entry", "q", F.explode(F.slice("ids", 1, k + 1)).alias("id")).where("id <> entry")
    near = entries.select(F.explode("ids").alias("id"), F.col("embedding").alias("x"))
    got = pairs.join(near, "id").select("q", "x").toPandas()
    out = {}
    for size, its in got.groupby(got["q"].map(len)):
        q, x, f = stacked(its["q"]), stacked(its["x"]), functions[int(size)]
        if int(size) in longest:
            q, x = levelled(q, longest[int(size)], True), levelled(x, longest[int(size)], False)
        first = np.full(len(q), np.iinfo(np.int64).max)
        for t in range(tables):
            same = probed(q, t, f, max(PROBES)) == probed(x, t, f, 1)
            first = np.minimum(first, np.where(same.any(axis=1), same.argmax(axis=1), first))
        out[int(size)] = next((p for p in PROBES if (first < p).mean() >= TARGET), 0)
    return {size: out.get(size, PROBES[0]) for size in functions}


def op3(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

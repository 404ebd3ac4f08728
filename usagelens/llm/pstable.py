"""Near-duplicates of vectors by Euclidean p-stable hashing, confirmed by exact cosine.

Cosine of unit vectors is a matter of their Euclidean distance, so vectors are normalised and
hashed: a function is floor((a.x + b) / w) with a of independent normal components and b uniform
in [0, w). A table joins several functions to one bucket number. `plan` chooses how many from the
rows of the largest label: enough that unrelated (orthogonal) vectors meet about FAR others in a
bucket, and as many tables as it takes that a pair at the threshold shares none with
probability MISS only; nearer pairs are missed far less often.

1. Equal vectors of a label become one entry with its number of rows, so exact copies are one row.
2. Bucket rows (no vectors yet) are counted per bucket, salted; rows alone in theirs go.
3. A bucket is cut into blocks. Two blocks of a bucket, or one with itself, are a task's unit:
   cosines are one matrix product in double precision. A pair counts in the first table that
   it shares, so never twice. A unit returns one row per linked entry: its number of links there
   and one entry of its component there. Pairs are never rows, however large a group of copies is.
4. Link numbers are summed; components of the returned links come from star contractions.

Every pair that shares a bucket is compared, whatever the bucket's size: no caps.

Defined results: a vector that is null, empty or zero, or holds null or non-finite components, or
whose label is null, has no links and is a component of its own; vectors of different lengths
aren't linked; repeated rows are exact copies, each with its result; component_id is the least
vec_id that is not null, null only if there is none (then `kept`, which treats nulls as equal);
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.ann import usable
from usagelens.llm.common import materialize, with_shared
from usagelens.llm.neardup import components
from usagelens.llm.runs import dealt, matrix, runs

THRESHOLD = 0.93
#: Bucket width, in distances of a pair at the threshold.
WIDTH = 8.0
FAR, MISS = 64, 1e-4
#: Entries of a block; in between so that each task gets several units.
LEAST, MOST, UNITS = 128, 4096, 8
CELLS = 1 << 20


def distance(cosine: float) -> float:
    return math.sqrt(2 - 2 * cosine)


def chance(apart: float, width: float) -> float:
    """That one function puts two points this far apart into one bucket."""
    r = width / apart
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(rows: int, threshold: float = THRESHOLD) -> tuple[int, int, float]:
    """Functions of a table, tables and bucket width for so many vectors of one label."""
    near = distance(threshold)
    width = WIDTH * near
    n = max(1, math.ceil(math.log(max(1, rows / FAR)) / -math.log(chance(math.sqrt(2), width))))
    both = chance(near, width) ** n
    return n, math.ceil(math.log(MISS) / math.log(1 - both)), width


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def bucket_numbers(x: np.ndarray, functions: int, tables: int, width: float, seed: int = 11) -> np.ndarray:
    """For each row of unit vectors its 32-bit bucket number in each table."""
    rng = np.random.default_rng([seed, x.shape[1], functions, tables])
    lines = rng.standard_normal((x.shape[1], functions * tables))
    cells = np.floor((x @ lines + rng.uniform(0, width, functions * tables)) / width).astype(np.int64).astype(np.uint64)
    odd = rng.integers(0, 1 << 62, functions * tables, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    with np.errstate(over="ignore"):
        h = (cells * odd).reshape(len(x), tables, functions).sum(axis=2, dtype=np.uint64)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def entry_of(label: Column, vector: Column) -> Column:
    """128 bits that name a label and vector."""
    half = lambda *c: F.lpad(F.hex(F.xxhash64(*c)), 16, "0")
    return F.unhex(F.concat(half(label, vector), half(F.lit(1), vector, label)))


def hashed(entries: DataFrame, functions: int, tables: int, width: float) -> DataFrame:
    """The entries with their bucket numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("x")
            sizes = np.asarray(vectors.value_lengths().to_numpy(zero_copy_only=False))
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                x = unit(matrix(pa.chunked_array([part.column("x")]), np.float64))
                found = bucket_numbers(x, functions, tables, width)
                lists = pa.ListArray.from_arrays(np.arange(0, found.size + 1, tables, dtype=np.int32), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "buckets"])

    kind = dict(entries.dtypes)["x"]
    return entries.select("entry", "l", "c", "x").mapInArrow(run, f"entry binary, l long, c long, x {kind}, buckets array<int>")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node of its component under the links a-b."""
    least = np.arange(n)
    while len(a):
        p, q = least[a], least[b]
        apart = p != q
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(least, np.maximum(p, q), np.minimum(p, q))
        while True:
            jumped = least[least]
            if (jumped == least).all():
                break
            least = jumped
    return least


def linked_in(x: np.ndarray, buckets: np.ndarray, c: np.ndarray, side: np.ndarray, t: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of one unit: each entry's number of links first shared in table t, and the least entry of its component."""
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1)
    within = not len(right)
    right = left if within else right
    n_links, least = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    step = max(1, CELLS // max(1, len(right)))
    for at in range(0, len(left), step):
        rows = left[at : at + step]
        a, b = np.nonzero(x[rows] @ x[right].T >= threshold)
        a, b = rows[a], right[b]
        fresh = buckets[a, t] == buckets[b, t]
        if within:
            fresh &= a < b
        a, b = a[fresh], b[fresh]
        for earlier in range(t):
            if not len(a):
                break
            fresh = buckets[a, earlier] != buckets[b, earlier]
            a, b = a[fresh], b[fresh]
        if len(a):
            n_links += np.bincount(a, weights=c[b], minlength=len(x)).astype(np.int64) + np.bincount(b, weights=c[a], minlength=len(x)).astype(np.int64)
            known = np.flatnonzero(least != np.arange(len(x)))
            least = forest(len(x), np.concatenate([a, known]), np.concatenate([b, least[known]]))
    return n_links, least


def links(held: DataFrame, threshold: float) -> DataFrame:
    """entry, n (its links, with copies of the other side), root (another entry of its component), once or more per linked entry."""
    spark = held.sparkSession
    rows = held.select("entry", "l", F.posexplode("buckets").alias("t", "key")).withColumn("b", F.xxhash64("t", "key"))
    rows = with_shared(rows.select("entry", "l", "t", "b"), ["l", "b"], F.col("entry"), {"n": F.count("*")}, "n > 1")
    rows = materialize(rows, "shared")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = min(MOST, max(LEAST, rows.count() // (UNITS * tasks)))
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("entry"), F.col("blocks")).cast("int")
    rows = rows.withColumn("blocks", blocks).select("entry", "l", "t", "b", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select(
        "entry", "l", "b", "t", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side")
    )
    units = rows.join(held.drop("l"), "entry")
    keys = ["l", "b", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit_rows in runs(batches, keys):
            if unit_rows.num_rows > 1:
                side = unit_rows.column("side").to_numpy()
                x, buckets = unit(matrix(unit_rows.column("x"), np.float64)), matrix(unit_rows.column("buckets"), np.int32)
                if side.all():  # its other block has no entry
                    continue
                if unit_rows.column("i")[0].as_py() != unit_rows.column("j")[0].as_py() and not side.any():
                    continue
                n, least = linked_in(x, buckets, unit_rows.column("c").to_numpy(), side, unit_rows.column("t")[0].as_py(), threshold)
                found = np.flatnonzero(n)
                if len(found):
                    names = unit_rows.column("entry").combine_chunks()
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(found)), pa.array(n[found]), names.take(pa.array(least[found]))], ["entry", "n", "root"])

    return dealt(units, keys).mapInArrow(run, "entry binary, n long, root binary")


def near_copies(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row (vec_id, embedding, label)."""
    vector = F.transform("embedding", lambda x: x + F.lit(0.0).cast("float"))  # negative zeros equal others
    fit = F.col("label").isNotNull() & usable(F.col("embedding"))
    rows = rows.select("vec_id", "label", "embedding").withColumn("entry", F.when(fit, entry_of(F.col("label"), vector)))
    fitting = rows.where("entry is not null").withColumn("l", F.xxhash64("label", F.size("embedding")))
    entries = fitting.groupBy("entry").agg(
        F.count("*").alias("c"), F.min("vec_id").alias("first"), F.any_value("l").alias("l"), F.any_value(vector).alias("x")
    )
    entries = materialize(entries, "vectors")
    most = entries.groupBy("l").count().agg(F.max("count")).first()[0] or 0
    held = materialize(hashed(entries, *plan(most, threshold)), "hashed")
    found = materialize(links(held, threshold), "linked")
    labels = components(found.select(F.col("entry").alias("a"), F.col("root").alias("b")))
    named = entries.select("entry", "c", "first").join(labels.withColumnRenamed("node", "entry"), "entry", "left")
    named = named.join(found.groupBy("entry").agg(F.sum("n").alias("n")), "entry", "left")
    named = materialize(named, "named_vectors")
    least = named.where("label is not null").groupBy("label").agg(F.min("first").alias("least"))
    named = named.join(least, "label", "left").select(
        "entry", (F.col("c") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("least", "first").alias("component")
    )
    out = rows.select("vec_id", "entry").join(named, "entry", "left")
    component = F.when(F.col("entry").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )


def op11(spark, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
r(vec_id, reach) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, e.b FROM r JOIN e ON r.reach = e.a)
SELECT v.vec_id, (SELECT count(*) FROM e WHERE e.a = v.vec_id)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT vec_id, min(reach) AS component_id FROM r GROUP BY 1) c USING (vec_id)
"""

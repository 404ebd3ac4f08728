"""Near-duplicates by b-bit MinHash, confirmed on whole shingle sets.

1. Each document becomes its set of word shingles (64-bit fingerprints), a 128-bit id of that
   set, BANDS x ROWS minima, of which only the low BITS bits are kept and packed as signature,
   and one key per band. Documents with equal sets are one class from here on, so any number of
   exact copies is one row.
2. Classes that share a band key are candidates. A bucket of up to SMALL classes gives its
   pairs; a larger one links each class to the bucket's class that shares large buckets most, so
   one near the middle of its group. Pairs whose similarity, estimated by counting
   equal packed minima and corrected for chance collisions, is too far below the threshold
   (about six standard deviations) are dropped; the rest is confirmed exactly on the whole sets.
3. Components come from alternating star contractions.
4. In larger buckets that are not one component by then, every class outside the bucket's
   largest component meets all others of the bucket in blocks, by packed signature and then
   whole set, until it has a link to each component that it can have one to. So no pair that shares a band is lost, however large its bucket.

A pair at the threshold of 0.8 shares no band in 3 of a million cases, more similar ones fewer.

Defined results: a null text, or one without words, has no shingles, n_shingles 0, and is a
group of its own; with fewer words than a shingle takes, the whole sequence is the one shingle;
a null doc_id counts after all others in a group and component_id is null only if all are;
repeated rows are exact copies, each with its result; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usagelens.llm.common import looked_up, materialize, with_shared

BANDS, ROWS, BITS = 42, 6, 4
PERMS = BANDS * ROWS
SMALL = 8
BLOCK = 256
THRESHOLD = 80  # percent
WORD_CACHE, LONGEST = 300_000, 64  # words kept, and bytes of the longest of them
_M = (1 << 64) - 1
_EQUAL = np.array([(not x >> 4) + (not x & 15) for x in range(256)], dtype=np.uint16)  # equal minima in a byte of a xor


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(k)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Words(dict):
    """64-bit fingerprints of words, kept for the words met last."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST:
            if len(self) >= WORD_CACHE:
                self.clear()
            self[word] = found
        return found


_WORDS = Words()


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct fingerprints of the text's shingles."""
    # bytes.lower and bytes.split know ASCII letters and white space only, as asked for
    found = (text or "").encode().lower().split()
    n = len(found)
    if not n:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, found), dtype=np.uint64, count=n)
    size = min(words, n)
    out = np.full(n - size + 1, np.uint64(size), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + _mixed(h[i : n - size + 1 + i], 0xD6E8FEB86659FD93)
        return np.unique(_mixed(out, 0xBF58476D1CE4E5B9))


class Hasher:
    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 1 << 32, PERMS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
        self.b = rng.integers(0, 1 << 32, PERMS, dtype=np.uint64).astype(np.uint32)[:, None]
        self.mul = rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def minima(self, found: np.ndarray) -> np.ndarray:
        low = (found >> np.uint64(32)).astype(np.uint32)
        out = np.full(PERMS, 0xFFFFFFFF, dtype=np.uint32)
        with np.errstate(over="ignore"):
            for i in range(0, len(low), 1024):
                np.minimum(out, (self.a * low[i : i + 1024] + self.b).min(axis=1), out=out)
        return out

    def keys(self, minima: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = _mixed(minima.reshape(BANDS, ROWS).astype(np.uint64) * self.mul, 0xD6E8FEB86659FD93)
            return _mixed(x.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64), 0xBF58476D1CE4E5B9).view(np.int64)


def packed(minima: np.ndarray) -> bytes:
    # the low bits of a x + b follow from the low bits of x alone: mixed first, they follow from all
    with np.errstate(over="ignore"):
        mixed = (minima ^ (minima >> np.uint32(16))) * np.uint32(0x45D9F3B)
    low = ((mixed ^ (mixed >> np.uint32(16))) & np.uint32(15)).astype(np.uint8)
    return (low[0::2] << 4 | low[1::2]).tobytes()


def set_id(found: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        parts = [int(_mixed(found, k).sum(dtype=np.uint64)) for k in (0xA24BAED4963EE407, 0x9FB21C651E98DF25)]
    return b"".join(p.to_bytes(8, "big") for p in parts)


def estimated(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures (rows of bytes), corrected for equal bits by chance."""
    equal = _EQUAL[left ^ right].sum(axis=-1) / PERMS
    chance = 0.5**BITS
    return (equal - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    t = percent / 100
    return t - 6 * (t * (1 - t) / PERMS) ** 0.5 / (1 - 0.5**BITS)


def rows_of(column: pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=np.uint8).reshape(len(values), -1)


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, node (id of the set, null if empty), sig, keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                n, nodes, sigs, keys = [], [], [], []
                for text in part.column(1).to_pylist():
                    found = shingles(text, words)
                    n.append(len(found))
                    if len(found):
                        low = hasher.minima(found)
                        nodes.append(set_id(found))
                        sigs.append(packed(low))
                        keys.append(hasher.keys(low))
                    else:
                        nodes.append(None)
                        sigs.append(None)
                        keys.append(None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "node", "sig", "keys"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_shingles long, node binary, sig binary, keys array<long>"
    )


def likely(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose estimate reaches `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                good = estimated(rows_of(batch.column(2)), rows_of(batch.column(3))) >= least
                yield batch.select(["a", "b"]).filter(pa.array(good))

    left = sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa"))
    right = sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
    # tables on both sides: adaptive execution can split the rows of a centre
    return materialize(pairs, "pairs").join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def sets_of(nodes: DataFrame, docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """The whole shingle sets (node, data) of these classes, from the text of each one's first document."""
    needed = classes.join(nodes.distinct(), "node", "left_semi").select(F.col("first").alias("_id"), "node")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, data = [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = shingles(text, words)
                if set_id(found) == node:  # a repeated doc_id may have other texts
                    nodes.append(node)
                    data.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(data, pa.binary())], ["node", "data"])

    texts = docs.select(F.col("doc_id").alias("_d"), "text").join(needed, F.col("_d").eqNullSafe(F.col("_id")))
    return materialize(texts.select("node", "text").mapInArrow(sets, "node binary, data binary"), "sets").dropDuplicates(["node"])


def linked(left: bytes, right: bytes, percent: int) -> bool:
    p, q = np.frombuffer(left, dtype=np.uint64), np.frombuffer(right, dtype=np.uint64)
    if len(p) > len(q):
        p, q = q, p
    if 100 * len(p) < percent * len(q):
        return False
    same = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
    return 100 * same >= percent * (len(p) + len(q) - same)


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose whole sets meet the threshold."""
    pairs = materialize(pairs, "likely")
    found = sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), docs, classes, words)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [linked(x, y, percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = found.select(F.col("node").alias("a"), F.col("data").alias("da"))
    right = found.select(F.col("node").alias("b"), F.col("data").alias("db"))
    joined = looked_up(looked_up(pairs, left, "a", F.col("b")), right, "b", F.col("a")).select("a", "b", "da", "db")
    return materialize(joined.mapInArrow(check, "a binary, b binary"), "links")


def components(links: DataFrame) -> DataFrame:
    """node and label (the least node of its component) for every node that a link touches."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    state, made = None, None
    least_of = lambda rows: with_shared(rows, ["u"], F.col("v"), {"m": F.min("v")})
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least_of(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        met = least_of(large)
        small = met.select("u", F.col("m").alias("v")).union(met.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        edges = made = materialize(small.distinct(), "stars", replaces=made)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", "v")).distinct()


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of small buckets and links to the centre of large ones; the rows of large buckets."""
    rows = classes.select(F.posexplode("keys").alias("band", "key"), "node")
    rows = with_shared(rows, ["key"], F.col("node"), {"n": F.count("*")}, "n > 1")
    rows = materialize(rows, "buckets")
    lists = rows.where("n <= %d" % SMALL).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("s"))
    lists = lists.select("s", F.posexplode("s").alias("i", "a"))
    small = lists.select("a", F.explode(F.slice("s", F.col("i") + 2, SMALL)).alias("b"))
    large = rows.where("n > %d" % SMALL).select("key", "band", "node", "n")
    # the class that shares large buckets most is near the middle of its group
    weight = large.groupBy("node").agg(F.sum("n").alias("w"))
    first = F.max(F.struct("w", F.xxhash64("node").alias("h"), "node"))
    star = with_shared(large.join(weight, "node"), ["key"], F.col("node"), {"t": first})
    star = star.select("node", F.col("t.node").alias("top")).where("node <> top")
    pairs = star.select(F.least("node", "top").alias("a"), F.greatest("node", "top").alias("b")).union(small).distinct()
    return pairs, large.drop("n")


def leftover(
    large: DataFrame, labels: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int
) -> DataFrame:
    """Links within large buckets that are more than one component, in blocks.

    A class outside the bucket's largest component meets all others of the bucket: first the
    packed signatures, then, nearest first, the whole sets, until one link to each other
    component is found. A pair is looked at in the first band it shares only.
    """
    rows = large.join(labels, "node", "left").select("key", "band", "node", F.coalesce("label", "node").alias("label"))
    # the rows of each (bucket, label) counted, and of these the buckets with several labels
    rows = with_shared(rows, ["key", "label"], F.col("node"), {"c": F.count("*")})
    per_key = {"most": F.max(F.struct("c", "label")), "n": F.count("*")}
    rows = with_shared(rows, ["key"], F.col("node"), per_key, "most.c < n")
    rows = rows.select(
        "key", "band", "node", "label", F.col("most.label").alias("main"), F.ceil(F.col("n") / BLOCK).alias("all_blocks"),
        F.ceil((F.col("n") - F.col("most.c")) / BLOCK).alias("odd_blocks"),
    )
    rows = materialize(rows, "odd")
    held = classes.select("node", "sig", "keys").join(sets_of(rows.select("node"), docs, classes, words), "node")
    rows = rows.join(held, "node")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    keys, rest = ["key", "i", "j"], ["band", "node", "label", "sig", "keys", "data"]
    odd = rows.where("label <> main").select(
        "key", block("odd_blocks").alias("i"), F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("j"), *rest
    )
    every = rows.select(
        "key", F.explode(F.sequence(F.lit(0), F.col("odd_blocks") - 1)).alias("i"), block("all_blocks").alias("j"), *rest
    )
    least = least_estimate(percent)

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(x) and len(y):
            sigs, bands = np.stack([np.frombuffer(s, dtype=np.uint8) for s in y["sig"]]), np.stack(y["keys"].to_numpy())
            labels, nodes, data = y["label"].to_numpy(), y["node"].to_numpy(), y["data"].to_numpy()
            band = int(x["band"].iat[0])
            for one in x.itertuples():
                near = estimated(np.frombuffer(one.sig, dtype=np.uint8), sigs)
                fit = (near >= least) & ~(bands[:, :band] == np.asarray(one.keys)[:band]).any(axis=1)
                at = np.flatnonzero(fit)
                met = {one.label}
                for k in at[np.argsort(-near[at], kind="stable")]:
                    if labels[k] not in met and linked(one.data, data[k], percent):
                        met.add(labels[k])
                        out.append((min(one.node, nodes[k]), max(one.node, nodes[k])))
        return pd.DataFrame(out, columns=["a", "b"], dtype=object)

    # new columns, to tell the sides apart, and keys of one type, as cogroup hashes them as they are
    one = lambda df: df.select(*[(F.col(c).cast("long") if c in keys else F.col(c)).alias(c) for c in df.columns])
    odd, every = one(odd), one(every)
    return odd.groupBy(*keys).cogroup(every.groupBy(*keys)).applyInPandas(meet, "a binary, b binary").distinct()


def placed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """`groups` with node and `part`, the group (null, as node, where a row is a group of its own)."""
    prints = materialize(fingerprints(docs, words), "prints")
    classes = (
        prints.where("node is not null")
        .groupBy("node")
        .agg(F.min("doc_id").alias("first"), F.count("*").alias("class_size"), F.any_value(F.struct("sig", "keys")).alias("x"))
        .select("node", "first", "class_size", "x.sig", "x.keys")
    )
    classes = materialize(classes, "classes")
    sigs = classes.select("node", "sig")
    least = least_estimate(percent)
    pairs, large = candidates(classes)
    links = confirmed(likely(pairs, sigs, least), docs, classes, words, percent)
    labels = components(links)
    if large.take(1):
        more = materialize(leftover(large, labels, docs, classes, words, percent), "leftover")
        if more.take(1):
            labels = components(links.unionByName(more))
    named = classes.join(labels, "node", "left").select("node", "first", "class_size", "label")
    least_id = named.where("label is not null").groupBy("label").agg(F.min("first").alias("least"))
    named = named.join(least_id, "label", "left").select(
        "node", F.coalesce("label", "node").alias("part"), F.coalesce("least", "first").alias("component"), "class_size"
    )
    out = prints.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), "node", "part",
    )


def groups(docs: DataFrame, words: int = 5, percent: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_size for each row of `docs`."""
    return placed(docs, words, percent).drop("node", "part")


def dedup(docs: DataFrame, words: int = 5, percent: int = THRESHOLD) -> DataFrame:
    """One document of each group: the one with the least doc_id, in the columns of `docs`.

    A doc_id that is null or repeated names no row, so such documents are told apart by their
    set ids, and one of each group's rows of the same set stays. Rows without shingles all stay.
    """
    found = materialize(placed(docs, words, percent).select("doc_id", "kept", "node", "part"), "groups")
    heads = found.where("kept and node is not null").groupBy("part").agg(F.min(F.struct("node", "doc_id")).alias("h")).select("h.*")
    heads = materialize(heads.select(F.col("node").alias("_node"), F.col("doc_id").alias("_k")), "heads")
    ids = heads.select("_k").union(found.where("node is null").select("doc_id")).where("_k is not null").distinct()
    again = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_k"))
    again = materialize(again, "again")
    same = F.col("doc_id") == F.col("_k")
    kept = docs.join(ids, same, "left_semi")
    repeated = bool(again.take(1))
    if not repeated and not found.where("doc_id is null").take(1):
        return kept

    @F.pandas_udf("binary")
    def node_of(texts: pd.Series) -> pd.Series:
        sets = (shingles(t, words) for t in texts)
        return pd.Series([set_id(x) if len(x) else None for x in sets], dtype=object)

    unclear = docs.where("doc_id is null")
    if repeated:
        kept = kept.join(again, same, "left_anti")
        unclear = unclear.unionByName(docs.join(again, same, "left_semi"))
    unclear = unclear.select(F.struct(*docs.columns).alias("_row"), node_of("text").alias("_of"))
    # one row of each doc_id and set, before the join, so that no number of copies meets in a task
    single = unclear.where("_of is not null").groupBy(F.col("_row.doc_id").alias("_id"), "_of")
    single = single.agg(F.min_by("_row", F.xxhash64("_row.text")).alias("_row"))
    single = single.join(heads, (F.col("_of") == F.col("_node")) & F.col("_id").eqNullSafe(F.col("_k")), "left_semi")
    rows = single.select("_row").union(unclear.where("_of is null").select("_row"))
    return kept.unionByName(rows.select("_row.*"))


def op2(spark, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), words=4)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY 1, 2, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept,
  greatest(1, count(*) OVER (PARTITION BY CASE WHEN n.n IS NULL THEN w.doc_id::VARCHAR ELSE 's' || k.k END))::BIGINT AS class_size
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY 1) c ON c.doc_id = w.doc_id
LEFT JOIN (SELECT doc_id, md5(array_to_string(list(g ORDER BY g), '/')) AS k FROM s GROUP BY 1) k ON k.doc_id = w.doc_id
"""

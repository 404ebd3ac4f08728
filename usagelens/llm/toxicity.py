"""Toxicity by maximum-scoring segments over token log-odds.

Learning: tokens (runs of letters and digits, lower case) are hashed into BUCKETS buckets, so the
model has a fixed size. Counts over all documents give the Dirichlet prior of each bucket (plus
EACH, so that rare ones have some),
document counts over a sample of labelled ones its log-odds between toxic and clean text; buckets
whose log-odds is within Z standard deviations of none score nothing. Every token's score is
lowered by DRIFT, so scores fall in ordinary text.

Scoring: the best segment and, where it matters, every maximal segment (Ruzzo and Tompa's linear
scan) of the token scores. Best scores of random text follow an extreme-value law: with lambda
from sum p e^(lambda s) = 1 over all documents and K from the clean sample, x = lambda S - ln(K n)
is comparable over lengths n. Segments with an expected number of chance finds under EXPECT are
the significant passages. A logistic curve over x and the passages' sum gives the score, fitted
on a part of the sample whose labels the log-odds then have not seen.

The sample holds the SAMPLE labelled rows of the training part that come first in a hashed
order: a bound, so it can be broadcast; where a doc_id has several texts, the curve is fitted on
the one with the largest x. Labels are used nowhere else.

Defined results: a null or empty text has no tokens and takes the score of x = 0; documents
without label are scored too; a repeated label row with another value counts as toxic if any
says so; without toxic and clean sample rows each score is the sample's share of toxic rows (0
if there is none); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 18
SAMPLE = 20_000
PRIOR, EACH = 2_000.0, 0.5
Z, DRIFT = 2.0, 0.05
EXPECT = 0.05
HELD_OUT = 2
CUT = 0.3
CACHE = 300_000
TOKEN = re.compile(r"[^\W_]+")


class Buckets(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[token] = found = xxhash.xxh3_64_intdigest(token) % BUCKETS
        return found


_BUCKETS = Buckets()


def tokens(text: str | None) -> np.ndarray:
    found = TOKEN.findall((text or "").lower())
    return np.fromiter(map(_BUCKETS.__getitem__, found), dtype=np.int64, count=len(found))


def part_of(doc_id: Column) -> Column:
    """The quarter of a document: quarter HELD_OUT is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0)).cast("int")


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, sum), in linear time."""
    out: list[list] = []  # first, end, sum before it, sum through it
    positive = np.flatnonzero(scores > 0)
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    for at in positive:
        left, right, first = sums[at], sums[at + 1], int(at)
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= left:
                j -= 1
            if j < 0 or out[j][3] >= right:
                out.append([first, int(at) + 1, left, right])
                break
            first, left = out[j][0], out[j][2]
            del out[j:]
    return [(a, b, r - lo) for a, b, lo, r in out]


class Model:
    def __init__(self, back: np.ndarray, toxic: np.ndarray, clean: np.ndarray):
        self.scores = np.zeros(BUCKETS)
        self.lam, self.log_k = 0.0, 0.0
        total = back.sum()
        if not (total and toxic.sum() and clean.sum()):
            return
        prior = PRIOR * back / total + EACH
        odds = lambda y: np.log((y + prior) / (y.sum() + prior.sum() - y - prior))
        delta = odds(toxic) - odds(clean)
        z = delta / np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
        self.scores = np.where((np.abs(z) >= Z) & (toxic + clean > 1), delta, 0.0) - DRIFT
        share = back / total
        low, high = 0.0, 1.0
        excess = lambda lam: float(share @ np.exp(np.minimum(lam * self.scores, 700))) - 1
        if share @ self.scores < 0 < self.scores.max():
            while excess(high) < 0 and high < 64:
                high *= 2
            for _ in range(60):
                mid = (low + high) / 2
                low, high = (mid, high) if excess(mid) < 0 else (low, mid)
            self.lam = high

    def best(self, s: np.ndarray) -> float:
        if not len(s):
            return 0.0
        sums = np.concatenate([[0.0], np.cumsum(s)])
        return float((sums - np.minimum.accumulate(sums)).max())

    def features(self, found: np.ndarray) -> tuple[float, float, list[tuple[int, int, float]]]:
        """x of the best segment, the sum over significant ones, and these."""
        if not len(found) or not self.lam:
            return 0.0, 0.0, []
        s = self.scores[found]
        shift = self.log_k + np.log(len(s))
        x = self.lam * self.best(s) - shift
        if x <= -np.log(EXPECT):
            return float(x), 0.0, []
        passages = [(a, b, self.lam * v - shift) for a, b, v in segments(s) if self.lam * v - shift > -np.log(EXPECT)]
        return float(x), float(sum(p[2] for p in passages)), passages


def design(x: np.ndarray, sums: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(x)), np.clip(x, -10, 40) / 10, np.log1p(sums)], axis=1)


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame) -> tuple[Model, np.ndarray, float]:
    part = part_of(F.col("doc_id"))
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .where(part != HELD_OUT)
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(SAMPLE)
    )
    # the last training quarter fits the curve, the others the log-odds
    kind = F.col("toxic") + F.when(part == 3, 2).otherwise(0)
    sampled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left").select(kind.cast("int").alias("kind"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((5, BUCKETS), dtype=np.int64)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                piece = batch.slice(begin, 256)
                all_found = [tokens(t) for t in piece.column(1).to_pylist()]
                if all_found:
                    sums[4] += np.bincount(np.concatenate(all_found), minlength=BUCKETS)
                for kind, found in zip(piece.column(0).to_pylist(), all_found, strict=True):
                    if kind is not None:
                        sums[kind][np.unique(found)] += 1  # documents, so that repetition in one doesn't count
        there = np.flatnonzero(sums[4])
        yield pa.RecordBatch.from_arrays(
            [pa.array(there.astype(np.int32)), *[pa.array(sums[i][there]) for i in range(5)]], ["b", "k0", "k1", "k2", "k3", "k4"]
        )

    sums = sampled.mapInArrow(count, "b int, k0 long, k1 long, k2 long, k3 long, k4 long").groupBy("b")
    sums = sums.agg(*[F.sum(f"k{i}").alias(f"k{i}") for i in range(5)])
    table = np.zeros((5, BUCKETS))
    for r in sums.toArrow().to_batches():  # at most BUCKETS rows
        table[:, r.column(0).to_numpy()] = [r.column(i + 1).to_numpy(zero_copy_only=False) for i in range(5)]
    first = Model(table[4], table[1], table[0])
    sent = docs.sparkSession.sparkContext.broadcast(first)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for text in batch.column(1).to_pylist():
                found = tokens(text)
                x, total, _ = sent.value.features(found)
                got.append((x, total, len(found)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *[pa.array([float(g[i]) for g in got], pa.float64()) for i in range(3)]], ["id", "y", "x", "total", "n"]
            )

    kind_of_id = dict(docs.dtypes)["doc_id"]
    one = docs.select("doc_id", "text").join(F.broadcast(chosen.where(part == 3)), "doc_id").select("doc_id", "text", "toxic")

    def measured() -> pa.Table:
        """One row for each sampled doc_id, however often it is repeated: SAMPLE rows at most."""
        rows = one.mapInArrow(measure, f"id {kind_of_id}, y int, x double, total double, n double").where("n > 0")
        return rows.groupBy("id").agg(F.max(F.struct("x", "total", "y")).alias("m")).select("m.y", "m.x", "m.total").toArrow()

    got = measured()
    y, x, total = (got.column(c).to_numpy().astype(float) for c in ("y", "x", "total"))
    share = float(table[1].sum() + table[3].sum() > 0) and float(y.mean()) if len(y) else 0.0
    model = Model(table[4], table[1] + table[3], table[0] + table[2])
    if not first.lam or not model.lam or not len(y) or y.min() == y.max():
        return model, np.zeros(3), share
    # mean of the law: (0.5772 + ln K n) / lambda; x was taken with K = 1
    model.log_k = float(x[y == 0].mean() - np.euler_gamma)
    first.log_k = model.log_k
    sent = docs.sparkSession.sparkContext.broadcast(first)
    again = measured()
    y, x, total = (again.column(c).to_numpy().astype(float) for c in ("y", "x", "total"))
    return model, fitted(design(x, total), y), share


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages, passages (first and end token, x)."""
    model, weights, share = learn(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast((model, weights, share))
    passage = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("x", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights, share = sent.value
        for batch in batches:
            got = [model.features(tokens(t)) for t in batch.column(1).to_pylist()]
            x, total = np.array([g[0] for g in got]), np.array([g[1] for g in got])
            p = 1 / (1 + np.exp(-np.clip(design(x, total) @ weights, -30, 30))) if weights.any() else np.full(len(got), share)
            spans = pa.array([[{"first": a, "end": b, "x": v} for a, b, v in g[2]] for g in got], pa.list_(passage))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p, pa.float64()), pa.array([len(g[2]) for g in got], pa.int64()), spans],
                ["doc_id", "score", "n_passages", "passages"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    out = docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, score double, n_passages long, passages array<struct<first:long,end:long,x:double>>"
    )
    return out.select(
        "doc_id", (part_of(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score",
        F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"), "n_passages", "passages",
    )


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))

"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in hash order, are cut in blocks of `block_bytes`: a document belongs to
the block in which it starts, a long one takes up several. Sources of equal weight form a class
and take its turns one after the other, those with more blocks first; once a source has run out,
it is passed over. Among classes, block j (from 0 in a phase) of a class of m sources with weight
w each has its share s = m w / (sum over classes), is released at floor(j / s) and due at
ceil((j + 1) / s); in each slot the released block that is due first runs. A class is then less
than one block away from its share and, as turns add less than what a class block leaves, so is
each source. When a source runs out, the others go on with their weights in proportion: a new
phase. Nothing is dropped or repeated.

Shares are whole numbers over D and exact, whatever D is. Each block finds its slot by itself, on any
number of machines: up to MOST_SLOTS by one period of the phase, which a task works out once; beyond
it by running the schedule over the block's own window only. For that, any state that keeps the bound
will do at a start one longest window earlier: unit blocks run by earliest deadline first from two such
states agree once the blocks that were open at the start are due. Both ways give the same slots.
What reaches the driver is, for each weight, how many sources have how many blocks, and what it sends
is a few numbers per phase: both grow with the different numbers of blocks (of N blocks at most about
sqrt(2 N)), not with documents, sources or periods.

Defined results: a null source is a source of its own, a null or empty text has size 1 (so that
every document has a place), ties and repeated rows keep their number, an empty table gives an
empty result. A source without a stated weight takes DEFAULT_WEIGHT; weights are over 0 and count as
the decimals that they are written as; extra columns are passed on.
"""

from __future__ import annotations

import heapq
import math
from collections import OrderedDict
from fractions import Fraction
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import materialize, root_of, with_offsets

BLOCK_BYTES = 1 << 16
#: Longest period that is written out, and periods that a task keeps.
MOST_SLOTS, KEPT = 1 << 14, 64
#: Sources up to this number are broadcast to the documents; more are joined.
FEW_SOURCES = 100_000
#: The targets of the registered query: the others share alike.
WEIGHTS = {"src0": 2.0, "src1": 1.5, "src2": 0.5}
DEFAULT_WEIGHT = 1.0


def in_parts(shares: list[Fraction]) -> list[int]:
    """Shares as whole parts, as small as they go."""
    whole = math.lcm(*[s.denominator for s in shares])
    parts = [int(s * whole) for s in shares]
    least = math.gcd(*parts)
    return [p // least for p in parts]


class Edf:
    """Earliest deadline first among classes with these parts, from slot 0 on."""

    def __init__(self, parts: tuple[int, ...]):
        self.parts, self.size = parts, sum(parts)
        self.longest = -(-self.size // min(parts)) + 2  # window of a block

    def release(self, k: int, j: int) -> int:
        return j * self.size // self.parts[k]

    def due(self, k: int, j: int) -> int:
        return -(-(j + 1) * self.size // self.parts[k])

    def state(self, slot: int) -> list[int]:
        """Blocks that each class has had by a slot, if of those in their windows the ones due first have run."""
        done = [p * slot // self.size for p in self.parts]
        opened = sorted((self.due(k, n), k) for k, n in enumerate(done) if p_rest(self.parts[k], slot, self.size))
        for _, k in opened[: slot - sum(done)]:
            done[k] += 1
        return done

    def run(self, begin: int, end: int):
        """(slot, class, block) from `begin` to `end`; right from one longest window behind the start on, or from slot 0."""
        later = [(self.release(k, j), k, j) for k, j in enumerate(self.state(begin))]
        heapq.heapify(later)
        ready: list[tuple[int, int, int]] = []
        for slot in range(begin, end):
            while later and later[0][0] <= slot:
                _, k, j = heapq.heappop(later)
                heapq.heappush(ready, (self.due(k, j), k, j))
            _, k, j = heapq.heappop(ready)
            yield slot, k, j
            heapq.heappush(later, (self.release(k, j + 1), k, j + 1))

    def period(self) -> list[np.ndarray]:
        """The slots of each class's blocks in one period."""
        found: list[list[int]] = [[] for _ in self.parts]
        for slot, k, _ in self.run(0, self.size):
            found[k].append(slot)
        return [np.array(f, dtype=np.int64) for f in found]

    def slots(self, k: int, blocks: np.ndarray) -> np.ndarray:
        """The slots of these blocks of a class, each found within its window; neighbours share a run."""
        wanted = np.unique(blocks).tolist()
        found, at = {}, 0
        while at < len(wanted):
            begin, upto = self.release(k, wanted[at]), self.due(k, wanted[at])
            last = at + 1
            while last < len(wanted) and self.release(k, wanted[last]) - self.longest <= upto:
                upto = self.due(k, wanted[last])
                last += 1
            mine = set(wanted[at:last])
            for slot, c, j in self.run(max(0, begin - self.longest), upto):
                if c == k and j in mine:
                    found[j] = slot
            at = last
        return np.array([found[j] for j in blocks.tolist()], dtype=np.int64)

    def until(self, left: list[int]) -> tuple[int, list[int]]:
        """When the first class has had all its blocks, and how many each has had then."""
        upto = min(self.due(k, n - 1) for k, n in enumerate(left))
        begin = max(0, min(self.release(k, n - 1) for k, n in enumerate(left)) - self.longest)
        for slot, k, j in self.run(begin, upto):
            if j + 1 == left[k]:
                # what the others have had: known from the run where they ran in it, else from its start
                had = self.state(begin)
                for s, c, i in self.run(begin, slot + 1):
                    had[c] = i + 1
                return slot + 1, had
        raise AssertionError("a class runs out by its deadline")


def p_rest(part: int, slot: int, size: int) -> int:
    return part * slot % size


_PERIODS: OrderedDict[tuple[int, ...], list[np.ndarray]] = OrderedDict()


def slots_of(parts: tuple[int, ...], k: int, blocks: np.ndarray) -> np.ndarray:
    """Slots of blocks of class k in a phase with these parts."""
    edf = Edf(parts)
    if edf.size > MOST_SLOTS:
        return edf.slots(k, blocks)
    if parts not in _PERIODS:
        _PERIODS[parts] = edf.period()
        if len(_PERIODS) > KEPT:
            _PERIODS.popitem(last=False)
    turn, at = np.divmod(blocks, parts[k])
    return turn * edf.size + _PERIODS[parts][k][at]


class Turns:
    """The blocks of a class's sources in one sequence, by how many sources have how many blocks."""

    def __init__(self, sources: dict[int, int]):
        self.counts = np.array(sorted(sources), dtype=np.int64)
        n = np.array([sources[c] for c in sorted(sources)], dtype=np.int64)
        self.below = np.concatenate([[0], np.cumsum(n * self.counts)])  # blocks of the sources with fewer
        self.over = np.concatenate([np.cumsum(n[::-1])[::-1], [0]])  # sources with as many or more

    def stretches(self) -> list[tuple[int, int]]:
        """(sources, blocks) for each stretch in which as many sources take turns."""
        rounds = np.diff(np.concatenate([[0], self.counts]))
        return [(int(m), int(m * r)) for m, r in zip(self.over, rounds, strict=False)]

    def place(self, blocks: np.ndarray, rank: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Where block j of the source at `rank` among those of as many blocks comes."""
        at = np.searchsorted(self.counts, j, side="right")
        before = self.below[at] + self.over[at] * j  # what all sources have had before this round
        return before + self.over[np.searchsorted(self.counts, blocks) + 1] + rank


def phases(stretches: list[list[tuple[int, int]]], weights: list[Fraction]) -> list[tuple[int, tuple[int, ...], dict[int, tuple[int, int]]]]:
    """For each phase its first slot, its parts, and per class in it (first block, place among the parts)."""
    at, left, done = [0] * len(stretches), [s[0][1] if s else 0 for s in stretches], [0] * len(stretches)
    out, begin = [], 0
    while True:
        live = [c for c, s in enumerate(stretches) if at[c] < len(s)]
        if not live:
            return out
        parts = tuple(in_parts([stretches[c][at[c]][0] * weights[c] for c in live]))
        out.append((begin, parts, {c: (done[c], i) for i, c in enumerate(live)}))
        length, had = Edf(parts).until([left[c] for c in live])
        for ran, c in zip(had, live, strict=True):
            done[c] += ran
            left[c] -= ran
            if not left[c]:
                at[c] += 1
                left[c] = stretches[c][at[c]][1] if at[c] < len(stretches[c]) else 0
        begin += length


def schedule(
    docs: DataFrame, weights: dict[str, float] | None = None, block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None
) -> DataFrame:
    """Columns `carry` (all, if None) of `docs` and a struct _mix of n_bytes, block, phase, slot, at.

    `at` counts bytes into the block; slot, then at, is the order of the mix.
    """
    if block_bytes < 1:
        raise ValueError("block_bytes starts at 1")
    weights = WEIGHTS if weights is None else weights
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights are over 0")
    exact = {k: Fraction(repr(w)) for k, w in weights.items()} | {None: Fraction(repr(DEFAULT_WEIGHT))}
    kinds = sorted(set(exact.values()))
    class_of = {k: kinds.index(w) for k, w in exact.items()}
    size = F.greatest(F.lit(1), F.coalesce(F.octet_length("text"), F.lit(0))).cast("long")
    # a source's key: n for the null source, else s and its name
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))
    named = F.create_map(*chain(*[(F.lit("s" + k), F.lit(c)) for k, c in class_of.items() if k is not None])) if weights else None
    kind = F.lit(class_of[None]) if named is None else F.coalesce(F.try_element_at(named, F.col("_k")), F.lit(class_of[None]))
    sources = docs.groupBy(key.alias("_k")).agg(F.sum(size).alias("_bytes"), F.count("*").alias("_rows"))
    sources = sources.select("_k", kind.alias("_c"), F.expr(f"(_bytes + {block_bytes - 1}) div {block_bytes}").alias("_blocks"), "_rows")
    sources = materialize(sources, "sources")
    per = sources.groupBy("_c", "_blocks").agg(F.count("*").alias("n"), F.sum("_rows").alias("rows")).collect()
    n_sources, n_rows = sum(r["n"] for r in per), sum(r["rows"] for r in per)
    turns = [Turns({r["_blocks"]: r["n"] for r in per if r["_c"] == c}) for c in range(len(kinds))]
    runs = phases([t.stretches() for t in turns], kinds)
    # per class, the phases that it takes part in
    of = []
    for c in range(len(kinds)):
        mine = [(i, begin, parts, *where[c]) for i, (begin, parts, where) in enumerate(runs) if c in where]
        of.append((np.array([m[3] for m in mine], dtype=np.int64), mine))
    sent = docs.sparkSession.sparkContext.broadcast((turns, of))

    @F.pandas_udf("phase int, slot long")
    def lookup(kind: pd.Series, blocks: pd.Series, rank: pd.Series, block: pd.Series) -> pd.DataFrame:
        turns, of = sent.value
        phase, slot = np.zeros(len(block), dtype="int32"), np.zeros(len(block), dtype="int64")
        codes = kind.to_numpy()
        for c in np.unique(codes):
            at = np.flatnonzero(codes == c)
            firsts, mine = of[c]
            wanted = turns[c].place(blocks.to_numpy()[at], rank.to_numpy()[at], block.to_numpy()[at])
            which = np.searchsorted(firsts, wanted, side="right") - 1
            for w in np.unique(which):
                i, begin, parts, first, k = mine[w]
                here = which == w
                phase[at[here]], slot[at[here]] = i, begin + slots_of(parts, k, wanted[here] - first)
        return pd.DataFrame({"phase": phase, "slot": slot})

    carry = docs.columns if carry is None else carry
    ranks = with_offsets(sources, ["_c", "_blocks"], ["_k"], F.lit(1), "_rank", root_of(n_sources)).select("_k", "_c", "_blocks", "_rank")
    rows = docs.select(
        F.struct(*[F.col(c) for c in carry]).alias("_row"), key.alias("_k"), size.alias("n_bytes"),
        F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_h"),
    )
    ranked = with_offsets(rows, ["_k"], ["_id", "_h"], F.col("n_bytes"), "_off", root_of(n_rows))
    ranked = ranked.withColumn("block", F.expr(f"_off div {block_bytes}"))
    ranked = ranked.join(F.broadcast(ranks) if n_sources <= FEW_SOURCES else ranks, "_k")
    ranked = ranked.withColumn("_x", lookup("_c", "_blocks", "_rank", "block"))
    return ranked.select(
        *[F.col("_row")[c].alias(c) for c in carry],
        F.struct(
            "n_bytes", "block", F.col("_x.phase").alias("phase"), F.col("_x.slot").alias("slot"), (F.col("_off") % block_bytes).alias("at")
        ).alias("_mix"),
    )


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` in the order of the mix: files and the rows in them follow the schedule."""
    placed = schedule(docs, weights, block_bytes)
    return placed.repartitionByRange(F.col("_mix.slot"), F.col("_mix.at")).sortWithinPartitions("_mix.slot", "_mix.at").select(*docs.columns)


def in_order(docs: DataFrame) -> DataFrame:
    """`docs`, read from the files that `mix` was written to, with `position`: 0, 1, ... in the order of the mix.

    Files may be read in any order and parts, but each row knows its file and its place in it. The
    rows of each file are counted first: a number for each of the files, which the driver lists anyway.
    """
    placed = docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = placed.groupBy("_file").agg(F.max("_row").alias("last")).collect()
    first, bases = 0, []
    for r in sorted(counts):
        bases.append((r["_file"], first))
        first += r["last"] + 1
    files = docs.sparkSession.createDataFrame(bases, "_file string, _first long")
    return placed.join(F.broadcast(files), "_file").withColumn("position", F.col("_first") + F.col("_row")).drop("_file", "_row", "_first")


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return schedule(docs, carry=["doc_id", "source"]).select("doc_id", "source", "_mix.*")

"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Both tokenizers cut the same bytes (a space and the text). Offsets where tokens of both end cut them
into groups. They are found by a galloping intersection: each end of the shorter list is looked for
in the longer one, from where the last one was found, by steps that double and then by binary
search. The places found say all: common ends cut the groups, and the difference between the
places of two neighbours is the range of tokens that overlap.

1. A task encodes and aligns its documents. It holds the distinct linked id pairs of each document
   until they are HELD entries; these documents are then a block: its distinct pairs, with the
   number of documents that hold each, are rows of their own, and documents refer to them by place.
2. Pairs are summed over blocks, salted, so that pairs found in every block are dealt to many
   tasks, and the totals go back to their blocks. What moves is a pair once per block, not once
   per document. The highest total of each id of the first tokenizer (at most one row for each
   of its ids: the bound of what is broadcast) marks the best.
3. Each block's documents meet its totals.

The first tokenizer's ids come from `ranks`, the second's from sentencepiece.

Defined results: a text that is null, empty, or that either tokenizer doesn't give back byte by byte
(such as one with U+2581, which the second takes for a space) has no tokens: zeros and an empty digest;
repeated rows and repeated or null doc_ids are documents of their own; texts are whole; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.llm.bpe import content_of, tokenizer_path
from usagelens.llm.common import materialize, with_shared
from usagelens.llm.ranks import Ranks

PIECES = "piece_bpe_32k.model"
#: Distinct linked pairs, summed over its documents, that a block holds, and pairs of one row.
HELD, ROW = 1_500_000, 1 << 15
MARK = "▁"


def gallop(short: list[int], long: list[int]) -> list[int]:
    """For each end in `short` the place in `long` of the first end that isn't before it.

    Both lists ascend, and `long` has an end that isn't before the last one of `short`.
    """
    found, at, last = [], 0, len(long) - 1
    put = found.append
    for x in short:
        if long[at] < x:
            low = high = at + 1
            step = 1
            while long[high] < x:
                low = high + 1
                high = min(high + step, last)
                step += step
            at = bisect_left(long, x, low, high)
        put(at)
    return found


class Aligned:
    """One text: ids of both tokenizers, places of the common ends, overlapping pairs."""

    def __init__(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray):
        self.a, self.b = a, b
        swap = len(a) > len(b)
        short, long = (ends_b, ends_a) if swap else (ends_a, ends_b)
        place = np.asarray(gallop(short.tolist(), long.tolist()))
        same = long[place] == short
        cut_short, cut_long = np.flatnonzero(same), place[same]
        #: places of the last token of each group
        self.cut_a, self.cut_b = (cut_long, cut_short) if swap else (cut_short, cut_long)
        first = np.concatenate([[0], (place + same)[:-1]])
        sizes = place - first + 1
        ends = np.cumsum(sizes)
        of_long = np.arange(ends[-1]) + np.repeat(first - (ends - sizes), sizes)
        of_short = np.repeat(np.arange(len(short)), sizes)
        of_a, of_b = (of_long, of_short) if swap else (of_short, of_long)
        #: overlapping occurrences as pairs of ids
        self.pairs = a[of_a].astype(np.int64) << 32 | b[of_b]

    def groups(self) -> list[tuple[list[int], list[int]]]:
        cut = lambda ids, last: [x.tolist() for x in np.split(ids, last[:-1] + 1)]
        return list(zip(cut(self.a, self.cut_a), cut(self.b, self.cut_b), strict=True))


class Aligner:
    def __init__(self, content: str, model: bytes):
        self.ranks = Ranks(content)
        self.bpe = self.ranks.bpe
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.sp.get_piece_size()
        pieces = [self.sp.id_to_piece(i) for i in range(n)]
        told = [bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.blob = np.frombuffer(b"".join(told), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in told])])
        self.sizes_a, self.sizes_b = np.diff(self.bpe.offsets), np.diff(self.offsets)
        marks = [*[f"{i}{mark}" for mark in ",|" for i in range(len(self.sizes_a))], *[f"{i}{mark}" for mark in ",;" for i in range(n)]]
        self.told = np.array([m.encode() for m in marks])  # of fixed width, zeros behind
        self.told_at = (0, len(self.sizes_a), 2 * len(self.sizes_a), 2 * len(self.sizes_a) + n)

    def encoded(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        a = self.ranks.plain(" " + text)
        return a, np.frombuffer(array("i", self.sp.encode(text, num_threads=1)).tobytes(), dtype=np.int32)

    def align(self, text: str | None) -> Aligned | None:
        """None if the text has no tokens."""
        if not text:
            return None
        a, b = self.encoded(text)
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        data = (" " + text).encode()
        if not len(a) or not len(b) or ends_a[-1] != len(data) or ends_b[-1] != len(data):
            return None
        if self.bpe.decode_bytes(a) != data or self.bytes_b(b, ends_b) != data:
            return None
        return Aligned(a, b, ends_a, ends_b)

    def bytes_b(self, ids: np.ndarray, ends: np.ndarray) -> bytes:
        sizes = self.sizes_b[ids]
        where = np.arange(ends[-1]) + np.repeat(self.offsets[ids] - (ends - sizes), sizes)
        return self.blob[where].tobytes()

    def digest(self, one: Aligned) -> str:
        """SHA-256 of the groups, `a1,a2|b1;a3|b2,b3`."""
        comma_a, bar, comma_b, semicolon = self.told_at
        size_a, size_b = np.diff(one.cut_a, prepend=-1), np.diff(one.cut_b, prepend=-1)
        text_a, text_b = one.a + comma_a, one.b + comma_b
        text_a[one.cut_a] += bar - comma_a
        text_b[one.cut_b] += semicolon - comma_b
        out = np.empty(len(text_a) + len(text_b), dtype=np.int64)
        out[np.arange(len(text_a)) + np.repeat(one.cut_b + 1 - size_b, size_a)] = text_a  # behind the b of the groups before
        out[np.arange(len(text_b)) + np.repeat(one.cut_a + 1, size_b)] = text_b
        return hashlib.sha256(self.told[out].tobytes().translate(None, b"\0")[:-1]).hexdigest()


_LOADED: dict[str, Aligner] = {}


def loaded(content: str, model: bytes) -> Aligner:
    """The aligner of these files, made once in a Python worker."""
    key = hashlib.sha256(content.encode() + model).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Aligner(content, model)
    return _LOADED[key]


def files_of(spark: SparkSession, path_a: str | None, path_b: str | None):
    """Broadcasts of both files: their sizes are fixed by the tokenizers."""
    with open(path_b or tokenizer_path(PIECES), "rb") as f:
        return content_of(spark, path_a), spark.sparkContext.broadcast(f.read())


def groups(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id and the groups of each text, in order: token ids of the first and of the second tokenizer."""
    content, model = files_of(docs.sparkSession, path_a, path_b)
    ids = pa.list_(pa.int32())
    kind = pa.list_(pa.struct([("a", ids), ("b", ids)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = loaded(content.value, model.value)
        for batch in batches:
            found = [aligner.align(t) for t in batch.column(1).to_pylist()]
            lists = [[{"a": a, "b": b} for a, b in one.groups()] if one else [] for one in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, kind)], ["doc_id", "groups"])

    doc = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc}, groups array<struct<a:array<int>,b:array<int>>>")


class Block:
    """Documents with their distinct pairs, until they are enough for a block."""

    def __init__(self, number: int, names: list[str], types: list[pa.DataType]):
        self.number, self.names, self.types = number, names, types
        self.rows: list[list] = []
        self.pairs: list[np.ndarray] = []
        self.times: list[bytes] = []
        self.n = 0

    def add(self, row: list, pairs: np.ndarray) -> None:
        pairs, times = np.unique(pairs, return_counts=True)
        self.rows.append(row)
        self.pairs.append(pairs)
        self.times.append(times.astype(np.int32).tobytes())
        self.n += len(pairs) + 64

    def batches(self) -> Iterator[pa.RecordBatch]:
        """A row for each document, then the pairs in rows of ROW."""
        pairs, place, counts = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        ends = np.cumsum([len(p) for p in self.pairs])
        places = [x.astype(np.int32).tobytes() for x in np.split(place, ends[:-1])]
        n, columns = len(self.rows), [list(c) for c in zip(*self.rows, strict=True)]
        none = [None] * n
        yield self.batch([*columns, [self.number] * n, places, self.times, none, none, none])
        for at in range(0, len(pairs), ROW):
            part = slice(at, at + ROW)
            yield self.batch([*[[None]] * len(columns), [self.number], [None], [None], [at], [pairs[part]], [counts[part]]])

    def batch(self, columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.types, strict=True)], self.names)


def aligned(docs: DataFrame, path_a: str | None, path_b: str | None) -> DataFrame:
    """Rows of documents (n_a not null) and rows of the pairs of their blocks."""
    content, model = files_of(docs.sparkSession, path_a, path_b)
    doc = dict(docs.dtypes)["doc_id"]
    schema = (
        f"doc_id {doc}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "block long, places binary, times binary, at int, p array<long>, c array<long>"
    )
    names = [x.split()[0] for x in schema.split(", ")]
    long, raw = pa.int64(), pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, types, block = loaded(content.value, model.value), None, None
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            types = types or [batch.schema.field(0).type, long, long, long, long, pa.string(), long, raw, raw, pa.int32(), pa.list_(long), pa.list_(long)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block = block or Block(number, names, types)
                one = aligner.align(text)
                if one is None:
                    block.add([doc_id, 0, 0, 0, 0, ""], np.empty(0, dtype=np.int64))
                else:
                    block.add([doc_id, len(one.a), len(one.b), len(one.cut_a), len(one.pairs), aligner.digest(one)], one.pairs)
                if block.n >= HELD:
                    yield from block.batches()
                    number += 1
                    block = None
        if block:
            yield from block.batches()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for each row of `docs`."""
    rows = materialize(aligned(docs, path_a, path_b), "aligned")
    pairs = rows.where("n_a is null").select("block", "at", F.posexplode(F.arrays_zip("p", "c")).alias("i", "x"))
    pairs = pairs.select("block", (F.col("at") + F.col("i")).alias("i"), "x.p", "x.c")
    pairs = with_shared(pairs, ["p"], F.col("block"), {"n": F.sum("c")})
    pairs = materialize(pairs.select("block", "i", F.shiftright("p", 32).alias("a"), "n"), "pairs")
    tops = pairs.groupBy("a").agg(F.max("n").alias("top"))  # at most one row for each id of the first tokenizer
    totals = pairs.join(F.broadcast(tops), "a").select("block", "i", "n", (F.col("n") == F.col("top")).alias("best"))
    found = rows.where("n_a is not null").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "block", "places", "times")
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def meet(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        n, best = np.zeros(theirs.num_rows, dtype=np.int64), np.zeros(theirs.num_rows, dtype=bool)
        at = theirs.column("i").to_numpy()
        n[at], best[at] = theirs.column("n").to_numpy(), theirs.column("best").to_numpy()
        sums, bests = [], []
        for places, times in zip(mine.column("places").to_pylist(), mine.column("times").to_pylist(), strict=True):
            places, times = np.frombuffer(places, dtype=np.int32), np.frombuffer(times, dtype=np.int32)
            sums.append(int((n[places] * times).sum()))
            bests.append(int(times[best[places]].sum()))
        more = [pa.array(bests, pa.int64()), pa.array(sums, pa.int64())]
        return pa.Table.from_arrays([*mine.select(kept).columns, *more], [*kept, "n_best", "count_sum"])

    doc = dict(docs.dtypes)["doc_id"]
    out = found.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(
        meet, f"doc_id {doc}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    )
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))

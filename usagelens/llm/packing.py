"""Token-ID output: best-fit-decreasing packing into rows of a fixed length.

Documents are encoded, and longer ones split into pieces of at most `length` tokens, losslessly.
Best fit takes the longest pieces first and puts each into the fullest row that still has room.
Which pieces those are doesn't matter, only how many there are of each length: `plan` works on
those counts, finds the tightest room in a segment tree over rooms 1 to `length`, and moves
whole stretches of equal rows at once. So its cost depends on `length`, not on the table. A
piece finds its row by its rank among those of its length (`with_offsets`, no large window), and
each row gathers its pieces: the id matrix row, cumulative segment lengths, position resets.

Only counts per length (at most `length` numbers) reach the driver.

Defined results: a null or empty text has no tokens and so no piece; repeated rows are packed
each; pieces keep (doc_id, piece) and concatenate to the document's tokens; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm import ranks
from usagelens.llm.bpe import content_of, loaded
from usagelens.llm.common import materialize, root_of, with_offsets

LENGTH = 2048
PAD = 50256


class Rooms:
    """Segment tree over rooms 0 to n: which of them have rows, and the least one from x on."""

    def __init__(self, n: int):
        self.base = 1 << n.bit_length()
        self.any = bytearray(2 * self.base)

    def set(self, room: int, there: bool) -> None:
        at = room + self.base
        self.any[at] = there
        while at > 1:
            at >>= 1
            self.any[at] = self.any[2 * at] | self.any[2 * at + 1]

    def least(self, room: int) -> int | None:
        at = room + self.base
        if self.any[at]:
            return room
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.base:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.base
            at >>= 1
        return None


def plan(counts: dict[int, int], length: int) -> list[tuple[int, int, int, int, int]]:
    """(piece length, first rank, pieces, first row, place in the row), best fit, longest first.

    counts: how many pieces there are of each length.
    """
    rows: dict[int, list[tuple[int, int]]] = {}
    tree, made, out = Rooms(length), 0, []

    def put(room: int, first: int, n: int) -> None:
        if room:
            if not rows.get(room):
                rows[room] = []
                tree.set(room, True)
            rows[room].append((first, n))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            room = tree.least(size)
            if room is None:
                # a new row takes as many of the rest as it holds before the next new one is needed
                fit = length // size
                full, rest = divmod(left, fit)
                for place in range(fit):
                    n = full + (place < rest)
                    if n:
                        out.append((size, rank, n, made, place * size))
                        rank += n
                put(length - fit * size, made, full)
                if rest:
                    put(length - rest * size, made + full, 1)
                made += full + (rest > 0)
                # ranks below run place by place, so the odd row's pieces follow in the same order
                left = 0
                break
            first, n = rows[room].pop()
            if not rows[room]:
                tree.set(room, False)
            took = min(n, left)
            if took < n:
                put(room, first + took, n - took)
            out.append((size, rank, took, first, length - room))
            put(room - size, first, took)
            rank += took
            left -= took
    return out


def pieces_of(docs: DataFrame, length: int, path: str | None) -> DataFrame:
    content = content_of(docs.sparkSession, path)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ranks.loaded(content.value)
        bpe = coder.bpe
        for batch in batches:
            ids, at, sizes, data = [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                whole = coder.encode(text or "")
                packed = whole.astype("<u2" if bpe.narrow else "<i4").tobytes()
                width = 2 if bpe.narrow else 4
                for piece, begin in enumerate(range(0, len(whole), length)):
                    ids.append(row)
                    at.append(piece)
                    sizes.append(min(length, len(whole) - begin))
                    data.append(packed[begin * width : (begin + length) * width])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(at, pa.int32()), pa.array(sizes, pa.int32()), pa.array(data, pa.binary())],
                ["doc_id", "piece", "size", "data"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, size int, data binary")


def pack(docs: DataFrame, length: int = LENGTH, pad: int = PAD, path: str | None = None) -> DataFrame:
    """One row per packed row: row, doc_ids, pieces, n_tokens, cu_seqlens, position_resets, input_ids.

    input_ids holds `length` little-endian 16-bit ids (32-bit for larger vocabularies), padded at
    the end; cu_seqlens the cumulative segment lengths from 0; position_resets the places where
    positions start anew at 0, padding included.
    """
    if length < 1:
        raise ValueError("length starts at 1")
    spark = docs.sparkSession
    pieces = materialize(pieces_of(docs, length, path), "pieces")
    found = pieces.groupBy("size").count().collect()
    counts = {r["size"]: r["count"] for r in found}
    steps = sorted(plan(counts, length))
    firsts = np.cumsum([0] + [counts.get(n, 0) for n in range(1, length + 1)])  # of each length, in one row of ranks
    begin, row_of, place_of = (
        np.array(x, dtype=np.int64)
        for x in ([firsts[s - 1] + r for s, r, *_ in steps], [s[3] for s in steps], [s[4] for s in steps])
    )
    sent = spark.sparkContext.broadcast((firsts, begin, row_of, place_of))  # grows with `length` only

    @F.pandas_udf("row long, place int")
    def lookup(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        firsts, begin, row_of, place_of = sent.value
        at = firsts[size.to_numpy() - 1] + rank.to_numpy()
        step = np.searchsorted(begin, at, side="right") - 1
        return pd.DataFrame({"row": row_of[step] + at - begin[step], "place": place_of[step].astype("int32")})

    keys = pieces.select("doc_id", "piece", "size", F.xxhash64("data").alias("h"), "data")
    ranked = with_offsets(keys, ["size"], ["doc_id", "piece", "h"], F.lit(1), "rank", root_of(sum(counts.values())))
    placed = ranked.withColumn("x", lookup("size", "rank")).select("x.row", "x.place", "doc_id", "piece", "size", "data")
    segment = F.sort_array(F.collect_list(F.struct("place", "doc_id", "piece", "size", "data"))).alias("s")
    rows = placed.groupBy("row").agg(segment)  # a row holds `length` tokens at most
    ends = F.transform("s", lambda x: x["place"] + x["size"])
    total = F.element_at(ends, -1)
    narrow = 2 if loaded(content_text(path)).narrow else 4
    fill = F.lit(int(pad).to_bytes(narrow, "little"))
    tail = F.when(total < length, F.unhex(F.repeat(F.hex(fill), F.lit(length) - total))).otherwise(F.lit(b""))
    body = F.aggregate("s", F.lit(b""), lambda done, x: F.concat(done, x["data"]))
    return rows.select(
        "row",
        F.transform("s", lambda x: x["doc_id"]).alias("doc_ids"),
        F.transform("s", lambda x: x["piece"]).alias("pieces"),
        total.cast("long").alias("n_tokens"),
        F.concat(F.array(F.lit(0)), ends).alias("cu_seqlens"),
        F.concat(F.transform("s", lambda x: x["place"]), F.when(total < length, F.array(total)).otherwise(F.array().cast("array<int>"))).alias("position_resets"),
        F.concat(body, tail).alias("input_ids"),
    )


def content_text(path: str | None) -> str:
    from usagelens.llm.bpe import tokenizer_path

    with open(path or tokenizer_path(), encoding="utf-8") as f:
        return f.read()


def op1(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

"""Conversation prefix trie: a z-fast trie as tables.

A conversation is a sequence of turns, a prefix of it is named by 128 bits: the exclusive or, over its
turns, of a hash of place, role and text. The trie is compacted: a node stands where conversations
part or one ends (its extent), with the edge from its parent. Its handle is the prefix as long as
the number with most trailing zero bits among the lengths on its edge. Nodes are rows, found by handle.

1. Equal sequences become one string with its number of conversations. Their ids are hashed apart:
   sorted by range, joined in parts, and the parts streamed, so no number of copies is collected.
2. Strings are inserted in batches, in hashed order, each batch GROWTH times as large as all
   before. A fat binary search locates each string's exit: each round is one join of the strings,
   by the prefix of the two-fattest length in what is left of their search, with the handles. It
   takes as many rounds as the longest string's length has bits. Strings that leave the trie
   at the same place with the same next turn (and the edge that they leave, if there is one) form a
   group, which a task turns into nodes: edges split, branches and ends come in. As batches are
   random and grow by a fixed factor, a place that many strings need is taken by an earlier batch
   but for a number that grows with the logarithm of the strings.
3. Sums over subtrees come from pointer doubling over the compacted nodes: after k rounds a node
   has what lies less than 2^k nodes below it, and it hands that to its ancestor 2^k above.
4. Edges are expanded to a row for each prefix.

Texts are hashed and measured where they are read and move no further; a conversation's prefixes (20
bytes a turn) are one row.

Defined results: null role or text is empty; turns go by `turn`, null first, those that tie by the
hashes of role and text; rows with a null conv_id belong to no conversation; repeated rows are turns of
their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import materialize
from usagelens.llm.runs import dealt, runs

ROOT = bytes(16)
#: Strings of the first batch, and how many times all earlier ones a batch holds.
FIRST, GROWTH = 512, 8
NODE = "node binary, depth long, parent binary, above long, edge binary, sizes array<int>, handle binary, opening binary"


def conversations_of(rows: DataFrame, shared: bool = True) -> DataFrame:
    """conv_id and its turns in order: two hashes and the code points of each.

    With `shared`, conversation c begins with the first h turns of c - c % 100 (h = crc32 of c, % 6),
    followed by its own after its first h.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = rows.where("conv_id is not null").select(
        "conv_id", "turn", F.xxhash64(role, text).alias("k"), F.xxhash64(F.lit(1), text, role).alias("m"), F.char_length(text).alias("size")
    )
    # a null turn is the least value of all
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "k", "m", "size"))).alias("turns"))
    if not shared:
        return own
    own = materialize(own, "own_turns")
    heads = own.where("conv_id % 100 = 0").select(F.col("conv_id").alias("_base"), F.slice("turns", 1, 5).alias("head"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    both = own.withColumn("h", h.cast("int")).join(heads, F.expr("conv_id - conv_id % 100 = _base"), "left")
    head = F.when(F.col("head").isNull(), F.expr("slice(turns, 1, 0)")).otherwise(F.expr("slice(head, 1, h)"))
    return both.select("conv_id", F.concat(head, F.expr("slice(turns, h + 1, size(turns))")).alias("turns"))


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(k)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id, n (turns), path (the names of the prefixes of 1 to n turns), sizes (code points), name (of the whole)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = batch.column("turns")
            n = np.asarray(turns.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
            flat = turns.flatten()
            ends = np.cumsum(n)
            begins = ends - n
            place = np.arange(len(flat), dtype=np.int64) - np.repeat(begins, n)
            halves = []
            for field, seed in (("k", 0xD6E8FEB86659FD93), ("m", 0xA24BAED4963EE407)):
                one = mixed(mixed(flat.field(field).to_numpy().view(np.uint64), seed) + mixed(place.astype(np.uint64) + np.uint64(1), 0xBF58476D1CE4E5B9), seed)
                running = np.concatenate([[np.uint64(0)], np.bitwise_xor.accumulate(one)]) if len(one) else np.zeros(1, dtype=np.uint64)
                halves.append(running[1:] ^ np.repeat(running[begins], n))
            blob = np.stack(halves, axis=1).astype(">u8").tobytes()
            path = [blob[16 * b : 16 * e] for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]
            sizes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), flat.field("size"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(n), pa.array(path, pa.binary()), sizes, pa.array([p[-16:] or ROOT for p in path], pa.binary())],
                ["conv_id", "n", "path", "sizes", "name"],
            )

    kind = dict(conversations.dtypes)["conv_id"]
    return conversations.select("conv_id", "turns").mapInArrow(run, f"conv_id {kind}, n long, path binary, sizes array<int>, name binary")


def fattest(a: int, b: int) -> int:
    """The number in (a, b] with most trailing zero bits."""
    return b & -1 << (a ^ b).bit_length() - 1


#: The same in SQL, and the prefix of `path` with `f` turns.
FATTEST = "b & shiftleft(-1L, length(bin(a ^ b)) - 1)"
PREFIX = "substring(path, cast(16 * ({f}) - 15 as int), 16)"


def located(strings: DataFrame, nodes: DataFrame, rounds: int) -> DataFrame:
    """The strings with `a`, the turns of the deepest node on their way, and `at`, that node."""
    handles = nodes.select("handle", "node", "depth", "parent", "above")
    now = strings.withColumns({"a": F.lit(0).cast("long"), "b": F.col("n"), "at": F.lit(ROOT)})
    on_path = F.expr(f"depth <= n and {PREFIX.format(f='depth')} = node")
    for _ in range(rounds):
        now = now.withColumn("f", F.expr(f"case when a < b then {FATTEST} end"))
        # what is located already keeps a key of its own, so that no key gathers it
        now = now.withColumn("key", F.when(F.col("f").isNotNull(), F.expr(PREFIX.format(f="f"))).otherwise(F.col("name")))
        met = now.join(handles, F.col("key") == F.col("handle"), "left")
        going, found = F.col("f").isNotNull(), F.col("handle").isNotNull()
        deeper, left = going & found & on_path, going & found & ~on_path  # a node on the way; the edge that the string leaves
        a = F.when(deeper, F.col("depth")).when(left, F.col("above")).otherwise(F.col("a"))
        at = F.when(deeper, F.col("node")).when(left, F.col("parent")).otherwise(F.col("at"))
        b = F.when(left, F.col("above")).when(going & ~found, F.col("f") - 1).otherwise(F.col("b"))
        now = met.select("name", "n", "path", "sizes", a.alias("a"), b.alias("b"), at.alias("at"))
    return now


def grown(path: list[bytes], sizes: list[np.ndarray], above: int, parent: bytes) -> Iterator[tuple]:
    """Nodes of the compacted trie of these strings, which all go on from `parent` (of depth `above`) with one turn."""
    todo = [(list(range(len(path))), 0, parent)]
    while todo:
        group, begin, parent = todo.pop()
        shared = min(len(path[i]) for i in group) // 16
        if len(group) > 1:
            low = begin + 1
            while low < shared:  # the longest prefix that all have
                middle = (low + shared + 1) // 2
                if len({path[i][16 * middle - 16 : 16 * middle] for i in group}) == 1:
                    low = middle
                else:
                    shared = middle - 1
            shared = low
        edge = path[group[0]][16 * begin : 16 * shared]
        node = edge[-16:]
        f = fattest(above + begin, above + shared) - above - begin
        yield node, above + shared, parent, above + begin, edge, sizes[group[0]][begin:shared], edge[16 * f - 16 : 16 * f], edge[:16]
        onward: dict[bytes, list[int]] = {}
        for i in group:
            if len(path[i]) > 16 * shared:
                onward.setdefault(path[i][16 * shared : 16 * shared + 16], []).append(i)
        todo.extend((g, shared, node) for g in onward.values())


def inserted(nodes: DataFrame | None, strings: DataFrame, rounds: int) -> DataFrame:
    """The nodes with these strings among them."""
    if nodes is None:
        found = strings.withColumns({"a": F.lit(0).cast("long"), "at": F.lit(ROOT)})
    else:
        found = located(strings, nodes, rounds)
    rest = found.where("n > a").select(
        F.expr(PREFIX.format(f="a + 1")).alias("g"), "a", "at", F.expr("substring(path, cast(16 * a + 1 as int), cast(16 * (n - a) as int))").alias("path"),
        F.expr("slice(sizes, cast(a + 1 as int), size(sizes))").alias("sizes"),
    )
    if nodes is not None:
        rest = materialize(rest, "leaving")
        # a node whose edge is left: its edge is one string of the group
        left = nodes.join(rest.select(F.col("g").alias("opening")).distinct(), "opening", "left_semi")
        rest = rest.unionByName(left.select(F.col("opening").alias("g"), F.col("above").alias("a"), F.col("parent").alias("at"), F.col("edge").alias("path"), "sizes"))
    names = [x.split()[0] for x in NODE.split(", ")]
    types = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for group in runs(batches, ["g"]):
            sizes = [np.asarray(s, dtype=np.int32) for s in group.column("sizes").to_pylist()]
            rows.extend(grown(group.column("path").to_pylist(), sizes, group.column("a")[0].as_py(), group.column("at")[0].as_py()))
            if len(rows) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    new = dealt(rest, ["g"]).mapInArrow(run, NODE)
    if nodes is None:
        return materialize(new, "nodes")
    new = materialize(new, "grown")
    return materialize(nodes.join(new.select("node"), "node", "left_anti").unionByName(new), "nodes", replaces=nodes)


def compacted(strings: DataFrame) -> DataFrame:
    """The compacted trie of distinct strings (name, n, path, sizes), without its root."""
    total, longest = strings.agg(F.count("*"), F.max("n")).first()
    share = F.pmod(F.xxhash64("name", F.lit(13)), F.lit(1 << 40)) / float(1 << 40)
    nodes, begin, end = None, 0.0, FIRST / max(1, total)
    while begin < 1 or nodes is None:
        batch = strings.where((share >= begin) & (share < end)) if total > FIRST else strings
        nodes = inserted(nodes, batch.select("name", "n", "path", "sizes"), (longest or 0).bit_length())
        begin, end = (end, end * (GROWTH + 1)) if total > FIRST else (1.0, 1.0)
    return nodes


def digests(ends: DataFrame) -> DataFrame:
    """name and the SHA-256 of its conv_ids, ascending, joined by commas, from rows (name, conv_id)."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                names = batch.column("name").to_numpy(zero_copy_only=False)
                ids = batch.column("conv_id").to_pylist()
                cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(ids)]
                rows = [(names[b], ids[b], ",".join(map(str, ids[b:e]))) for b, e in pairwise(cuts)]
                kinds = [pa.binary(), batch.schema.field("conv_id").type, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["name", "first", "part"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, hashlib.sha256()
        for batch in batches:
            names, out = [], []
            for name, part in zip(batch.column("name").to_pylist(), batch.column("part").to_pylist(), strict=True):
                if name == last:
                    digest.update(b"," + part.encode())
                    continue
                if last is not None:
                    names.append(last)
                    out.append(digest.hexdigest())
                last, digest = name, hashlib.sha256(part.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(out, pa.string())], ["name", "digest"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([digest.hexdigest()])], ["name", "digest"])

    kind = dict(ends.dtypes)["conv_id"]
    found = ends.repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id").mapInArrow(parts, f"name binary, first {kind}, part string")
    return dealt(found, ["name"], ["first"]).mapInArrow(joined, "name binary, digest string")


def subtree_sums(nodes: DataFrame, ways: list[DataFrame], sums: dict) -> DataFrame:
    """node and, over it and all below, the aggregates `sums` (column: function); ways: the ancestors 1, 2, 4, ... above."""
    now = nodes.select("node", *sums)
    for way in ways:
        given = now.join(way, "node").groupBy("up").agg(*[f(c).alias(f"_{c}") for c, f in sums.items()])
        both = now.join(given.withColumnRenamed("up", "node"), "node", "left")
        add = {c: F.least(F.col(c), F.col(f"_{c}")) if f is F.min else F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c, f in sums.items()}
        now = materialize(both.select("node", *[x.alias(c) for c, x in add.items()]), "sums", replaces=now if way is not ways[0] else None)
    return now


def ways_up(nodes: DataFrame) -> list[DataFrame]:
    """node and up, its ancestor 1, 2, 4, ... nodes above, until there is none."""
    way, out = nodes.where("parent is not null").select("node", F.col("parent").alias("up")), []
    way = materialize(way, "way")
    while way.take(1):
        out.append(way)
        further = way.select(F.col("node").alias("up"), F.col("up").alias("further"))
        way = materialize(way.join(further, "up").select("node", F.col("further").alias("up")), "way")
    return out


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each distinct prefix of the conversations (conv_id, turns): see `op13`."""
    members = materialize(paths(conversations), "paths")
    strings = members.groupBy("name").agg(
        F.count("*").alias("ends"), F.min("conv_id").alias("first"), F.any_value(F.struct("n", "path", "sizes")).alias("x")
    )
    strings = materialize(strings.select("name", "ends", "first", "x.*"), "strings")
    spark = conversations.sparkSession
    root = spark.createDataFrame([(ROOT, 0, None, None, None, [], None, None)], NODE)
    nodes = compacted(strings.where("n > 0"))
    nodes = nodes.unionByName(root.join(strings.select("name").limit(1), F.lit(True), "left_semi"))  # no conversations, no root
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    ended = strings.select(F.col("name").alias("node"), "ends", "first").join(digests(members.select("name", "conv_id")).withColumnRenamed("name", "node"), "node")
    nodes = nodes.join(ended, "node", "left").join(children, "node", "left")
    nodes = nodes.select("node", "depth", "parent", "above", "sizes", F.coalesce("ends", F.lit(0)).alias("n_convs"), "first", "digest", F.coalesce("n_children", F.lit(0)).alias("n_children"))
    nodes = materialize(nodes.withColumn("leaves", (F.col("n_children") == 0).cast("long")), "compacted")
    ways = ways_up(nodes)
    counted = subtree_sums(nodes, ways, {"n_convs": F.sum, "leaves": F.sum, "first": F.min})
    nodes = materialize(nodes.drop("n_convs", "leaves", "first").join(counted, "node"), "counted")
    # what each edge saves, and the sum of it below each node
    saved = (F.col("n_convs") - 1) * F.aggregate("sizes", F.lit(0).cast("long"), lambda acc, x: acc + x)
    nodes = nodes.withColumn("own", saved)
    below = subtree_sums(nodes, ways, {"own": F.sum}).withColumnRenamed("own", "all")
    over = nodes.select(F.col("node").alias("parent"), F.col("first").alias("parent_first"))
    nodes = nodes.join(below, "node").withColumn("below", F.col("all") - F.col("own")).join(over, "parent", "left")
    empty = hashlib.sha256(b"").hexdigest()
    #: one row for each turn of an edge; the root has one
    edge = nodes.withColumn("edge", F.greatest(F.size("sizes"), F.lit(1)))

    def expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("edge").to_numpy().astype(np.int64)
            ends = np.cumsum(n)
            begins = ends - n
            of = np.repeat(np.arange(len(n)), n)
            get = lambda c, b=batch: b.column(c).to_numpy(zero_copy_only=False)
            step = np.arange(len(of)) - begins[of]  # from the edge's top
            last = step == n[of] - 1
            lists = batch.column("sizes")
            sizes = np.zeros(len(of), dtype=np.int64)
            sizes[np.repeat(np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False)) > 0, n)] = lists.flatten().to_numpy()
            running = np.concatenate([[0], np.cumsum(sizes)])
            tail = running[ends[of]] - running[:-1]  # code points from here to the edge's end
            convs = get("n_convs")[of]
            take = lambda c, b=batch: b.column(c).take(pa.array(of))
            depth = get("depth")[of] - (n[of] - 1 - step)
            parent = pc.if_else(pa.array(step == 0), take("parent_first"), take("first"))
            digest = pc.if_else(pa.array(last), pc.fill_null(take("digest"), empty), empty)
            children = np.where(last, get("n_children")[of], 1)
            yield pa.RecordBatch.from_arrays(
                [take("first"), pa.array(depth), parent, pa.array(convs), pa.array(children), take("leaves"), pa.array(get("below")[of] + (convs - 1) * tail), digest],
                ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
            )

    kind = dict(conversations.dtypes)["conv_id"]
    return edge.select("edge", "depth", "sizes", "first", "parent_first", "n_convs", "n_children", "leaves", "below", "digest").mapInArrow(
        expanded,
        f"conv_id {kind}, depth long, parent_conv_id {kind}, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string",
    )


def op13(spark, sf_dir: str) -> DataFrame:
    """A row for each distinct prefix of the rebuilt conversations, the empty one included."""
    return trie(conversations_of(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


ORACLE = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY i) AS turns FROM t GROUP BY 1),
h AS (SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
  lambda s, b: list_reduce(list_prepend(xor(s, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END)), 4294967295::BIGINT) % 6 AS h FROM own),
s AS (SELECT h.conv_id, list_concat(coalesce(b.turns, [])[1:h.h], h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, turns[1:d] AS prefix, d, len(turns) = d AS ends FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM s)),
n AS (SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM p GROUP BY 1, 2),
c AS (SELECT prefix[1:d - 1] AS prefix, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
x AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children, CASE WHEN n.d = 0 THEN 0 ELSE (n.n_convs - 1) * length(n.prefix[n.d].text) END AS saved FROM n LEFT JOIN c USING (prefix, d)),
up AS (SELECT prefix[1:k] AS prefix, k AS d, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM x) GROUP BY 1, 2)
SELECT x.conv_id, x.d::BIGINT AS depth, q.conv_id AS parent_conv_id, x.n_convs::BIGINT AS n_convs, x.n_children::BIGINT AS n_children, up.n_leaves::BIGINT AS n_leaves,
  up.saved_tokens::BIGINT AS saved_tokens, x.ends_sha256
FROM x JOIN up USING (prefix, d) LEFT JOIN n q ON q.d = x.d - 1 AND q.prefix = x.prefix[1:x.d - 1]
"""

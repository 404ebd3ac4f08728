"""The conversation prefix trie against a plain model: shared heads, copies, growing conversations, odd rows."""

import hashlib
import random
import zlib

import pytest

from usagelens.llm import zfast

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth long"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plainly(rows):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(turns, key=lambda t: t[0])] for c, turns in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = abs(c) // 100 * 100 * (1 if c >= 0 else -1)
        whole = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(c)
        ends.setdefault(whole, []).append(c)
    below = {p: [0, 0, 0] for p in members}  # children, leaves, saved
    for p in members:
        if p:
            below[p[:-1]][0] += 1
    for p in members:
        for d in range(len(p) + 1):
            below[p[:d]][1] += below[p][0] == 0
            below[p[:d]][2] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (
            (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), *below[p], hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
            for p, m in members.items()
        ),
        key=str,
    )


def made(n, seed):
    """Conversations that share heads, repeat, grow out of one another, and are long."""
    rng, rows = random.Random(seed), []
    texts = ["", "hello", "so what", "naïve 日本", "x" * 40]
    for c in range(n):
        kind, size = rng.random(), rng.randrange(1, 9)
        if kind < 0.3:  # copies
            turns = [("user", texts[i % 3]) for i in range(6)]
        elif kind < 0.5:  # snapshots of one that grows
            turns = [("user" if i % 2 else "assistant", f"step {i}") for i in range(rng.randrange(1, 40))]
        else:
            turns = [("user", rng.choice(texts)) for _ in range(size)]
        rows += [(c, i, role, text, None, None) for i, (role, text) in enumerate(turns)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "first"), [(260, zfast.FIRST), (260, 3)])
def test_against_a_plain_model(spark, n, first, monkeypatch):
    monkeypatch.setattr(zfast, "FIRST", first)  # from three strings on, inserted in batches
    rows = made(n, first)
    got = zfast.trie(zfast.conversations_of(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == plainly(rows)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "none", None, None), (100, None, None, None, "n", 1), (100, 0, "user", None, None, None), (100, 1, None, "b", None, None),
        (101, 5, "user", "x" * 100_000, None, None), (101, 6, "user", "y", None, None), (-7, 0, "user", "neg", None, None), (-107, 0, "a", "neg", None, None),
        (100, 2, "user", "same", None, None), (100, 3, "user", "same", None, None), (205, 0, "user", "", None, None), (142, 0, "user", "own", None, None),
        (300, 1, "user", "tie", None, None), (300, 1, "user", "tie", None, None),
    ]
    got = zfast.trie(zfast.conversations_of(spark.createDataFrame(rows, SCHEMA)))
    assert sorted(map(tuple, got.collect()), key=str) == plainly(rows)


def test_empty_and_turnless(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert zfast.trie(zfast.conversations_of(empty)).collect() == []
    # h = 5 turns of a base that isn't there, then nothing of its own: no turns
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 == 5)
    rows = [(c, 0, "user", "gone", None, None)]
    got = zfast.trie(zfast.conversations_of(spark.createDataFrame(rows, SCHEMA))).collect()
    assert list(map(tuple, got)) == plainly(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_fattest():
    for a in range(40):
        for b in range(a + 1, 41):
            best = max(range(a + 1, b + 1), key=lambda x: (x & -x))
            assert zfast.fattest(a, b) == best

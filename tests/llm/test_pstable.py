"""Near-copies of vectors against brute force: planted groups, near misses, copies, odd rows."""

import numpy as np
import pytest

from usagelens.llm import pstable

SCHEMA = "vec_id long, embedding array<float>, label int, source string, n long"


def brute(rows):
    """(n_links, component_id) of each row by comparing all pairs."""
    def fit(v, label):
        return label is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)

    ok = [i for i, (_, v, label, *_) in enumerate(rows) if fit(v, label)]
    units = {i: np.asarray(rows[i][1], np.float32).astype(float) for i in ok}
    units = {i: x / np.linalg.norm(x) for i, x in units.items()}
    near = {i: [] for i in range(len(rows))}
    for i in ok:
        for j in ok:
            if i != j and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.93:
                near[i].append(j)
    out = []
    for i, row in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((row[0], len(near[i]), component, row[0] == component))
    return out


def turned(rng, x, cosine):
    """A vector at exactly this cosine (but for rounding) from the unit vector x."""
    y = rng.standard_normal(len(x))
    y -= (y @ x) * x
    return cosine * x + (1 - cosine**2) ** 0.5 * y / np.linalg.norm(y)


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("block", [pstable.LEAST, 7])
def test_planted_groups(spark, block, monkeypatch):
    monkeypatch.setattr(pstable, "LEAST", block)
    monkeypatch.setattr(pstable, "MOST", block)
    rng, rows = np.random.default_rng(3), []
    for g in range(60):
        x = rng.standard_normal(24)
        x /= np.linalg.norm(x)
        rows.append((len(rows), x.tolist(), g % 3, "a", 1))
        for cosine in (0.9999, 0.95, 0.94, 0.932, 0.928, 0.9):
            rows.append((len(rows), (turned(rng, x, cosine) * (g + 1)).tolist(), g % 3, "a", 1))
    hub = rng.standard_normal(24)
    for _ in range(80):  # one large group of near copies
        rows.append((len(rows), (hub + rng.standard_normal(24) * 0.1).tolist(), 1, "b", 2))
    got = pstable.near_copies(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert order(map(tuple, got)) == order(brute(rows))


def test_odd_rows(spark):
    x, y = [1.0, 2.0, 0.0], [3.0, -1.0, 0.5]
    rows = [
        (5, x, 1, None, None), (5, x, 1, None, None), (3, [2.0, 4.0, -0.0], 1, None, None), (None, x, 1, None, None),  # repeated, scaled, no id
        (9, x, 2, None, None), (8, x, None, None, None), (7, None, 1, None, None), (6, [], 1, None, None), (4, [0.0, 0.0, 0.0], 1, None, None),
        (2, [1.0, None, 0.0], 1, None, None), (1, [1.0, float("nan"), 0.0], 1, None, None), (0, [float("inf"), 1.0, 0.0], 1, None, None),
        (10, [1.0, 2.0], 1, None, None), (11, y, 4, None, None), (None, [-v for v in y], 4, None, None), (None, x, 5, None, None), (None, x, 5, None, None),
    ]
    got = {}
    for r in pstable.near_copies(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.vec_id, []).append(tuple(r)[1:])
    assert got[5] == [(3, 3, False)] * 2 and got[3] == [(3, 3, True)]
    for alone in (9, 8, 7, 6, 4, 2, 1, 0, 10, 11):
        assert got[alone] == [(0, alone, True)]
    assert order(got[None]) == order([(3, 3, False), (0, None, True), (1, None, True), (1, None, True)])


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pstable.near_copies(empty).collect() == []
    clash = spark.createDataFrame([(1, [1.0, 0.0], 1, "x", 2)], "vec_id long, embedding array<double>, label int, entry string, l long")
    assert [tuple(r) for r in pstable.near_copies(clash).collect()] == [(1, 0, 1, True)]


def test_plan_follows_the_rows():
    for rows in (1, 1000, 10**6, 10**9):
        n, tables, width = pstable.plan(rows)
        shared = pstable.chance(pstable.distance(0.93), width) ** n
        assert (1 - shared) ** tables <= pstable.MISS
        assert rows * pstable.chance(2**0.5, width) ** n <= pstable.FAR * 1.01

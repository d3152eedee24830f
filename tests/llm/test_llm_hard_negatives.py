import math

import numpy as np
import pytest

from tidemark.llm import hard_negatives as hard


def brute(rows):
    """All anchors against all rows; rows of one id are told apart by their place."""
    kept = []
    for vec_id, label, vector in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        kept.append((vec_id, label, [math.floor(256 * x) for x in vector]))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for i, (anchor, label, own) in enumerate(kept):
        if anchor is None or anchor % 100:
            continue
        scored = [(sum(a * b for a, b in zip(own, q)), vec_id, other == label)
                  for j, (vec_id, other, q) in enumerate(kept) if j != i and len(q) == len(own)]
        for score, positive, _ in sorted((r for r in scored if r[2]), key=order)[:5]:
            fits = [r for r in scored if not r[2] and 30 * score <= 100 * r[0] <= 90 * score]
            out += [(anchor, positive, rank, r[1], score, r[0]) for rank, r in enumerate(sorted(fits, key=order)[:10], 1)]
    return sorted(out, key=str)


def found(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr(
        "*", "'clash' as row", "3 as rank", "0 as d", "1 as block").repartition(6)
    return sorted((tuple(r) for r in hard.hard_negatives(hard.usable(frame)).collect()), key=str)


def made(seed, rows, size, labels=3):
    pick = np.random.default_rng(seed)
    base = pick.normal(size=(4, size))
    points = base[pick.integers(0, 4, rows)] + 0.4 * pick.normal(size=(rows, size))
    points *= pick.uniform(0.1, 3, (rows, 1))
    return [(i * 5, int(pick.integers(0, labels)), [float(x) for x in np.round(p, 2)]) for i, p in enumerate(points)]


@pytest.mark.parametrize("sizes", [(1024, 8192, 256), (7, 23, 4)])
def test_equals_all_pairs(spark, monkeypatch, sizes):
    for name, value in zip(("BLOCK", "CHUNK", "PAGE"), sizes):
        monkeypatch.setattr(hard, name, value)
    monkeypatch.setattr(hard, "PER_CLUSTER", 4)
    nan, inf = float("nan"), float("inf")
    rows = made(1, 600, 6)
    rows += [(10_000 + i, 1, rows[40][2]) for i in range(200)]  # copies of an anchor: a third of what is searched
    rows += rows[:30]  # repeated rows, anchors too
    rows += [(700, None, [1.0] * 6), (800, 2, None), (900, 1, [nan] + [1.0] * 5), (901, 1, [inf] + [1.0] * 5),
             (902, 1, [None] + [1.0] * 5), (None, 1, rows[0][2]), (None, 0, rows[20][2]), (1100, 1, [0.0] * 6), (1200, 2, []),
             (1300, 1, [0.5, 0.5]), (1301, 1, [0.5, 0.4]), (1302, 2, [0.2, 0.4]), (1303, 2, []), (1304, 2, [])]
    got, want = found(spark, rows), brute(rows)
    assert got == want and len(got) > 500


def test_scores_beyond_floating_point(spark):
    rows = [(i, i % 2, [float(1 << 22) + 0.25 * i, float(i) / 256]) for i in range(0, 420, 20)]
    rows += [(5, 1, [float(1 << 21), 3.0]), (6, 1, [float(1 << 21), 4.0 / 256]), (9, 1, [float(1 << 21), 5.0 / 256])]
    assert found(spark, rows) == brute(rows) != []


def test_few_rows_and_none(spark):
    assert found(spark, made(2, 3, 4)[:1]) == []
    few = [(100, 1, [1.0, 0.0]), (1, 1, [1.0, 0.5]), (2, 2, [0.5, 0.5])]
    assert found(spark, few) == brute(few) == [(100, 1, 1, 2, 65536, 32768)]
    assert found(spark, few[:1] * 0 + []) == []


def test_lists_are_not_walked_to_their_end(monkeypatch):
    """Anchors and candidates in a few tight directions: most pages are certified unseen."""
    import pandas as pd

    pick = np.random.default_rng(3)
    base = np.eye(16)[:8]
    points = np.floor(256 * (base[np.arange(8000) % 8] * 2 + 0.02 * pick.normal(size=(8000, 16))))
    norm = np.sqrt((points ** 2).sum(axis=1))
    chunk = pd.DataFrame({"row": np.arange(8000), "vec_id": np.arange(8000), "label": np.arange(8000) % 3, "q": list(points), "norm": norm})
    own = chunk[chunk.row % 160 == 0].copy()
    units = points / norm[:, None]
    cluster = (units[own.row] @ base.T).argmax(axis=1)
    wide = np.pad(base, ((0, 0), (0, 0)))
    own = own.assign(centre=cluster, angle=[hard.angles(units[[r]], wide[c])[0] for r, c in zip(own.row, cluster)],
                     low=[[hard._LEAST]] * len(own), high=[[hard._MOST]] * len(own))
    seen = []
    monkeypatch.setattr(hard.Best, "offer", lambda self, asks, *rest, real=hard.Best.offer: (
        seen.append(len(asks)), real(self, asks, *rest))[1])
    result = hard.walk(own, chunk, wide, True, 5)
    assert len(result) == 5 * len(own) and sum(seen) < 0.2 * len(own) * len(chunk)

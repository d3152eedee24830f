import numpy as np
import pytest

from tidemark.llm import blocks, multi_index, vantage_tree


def brute(ids, points, k, measure, sign):
    """All pairs of rows; a query leaves out its own row, and rows of another length."""
    out = {}
    for at, (i, q) in enumerate(zip(ids, points)):
        if i % blocks.EVERY == 0:
            rest = sorted((sign * measure(q, p), j) for other, (j, p) in enumerate(zip(ids, points))
                          if other != at and len(p) == len(q))[:k]
            out.setdefault(int(i), []).extend((n, int(j), sign * s) for n, (s, j) in enumerate(rest, 1))
    return {i: [r[1:] for r in sorted(rows)] for i, rows in out.items() if rows}


def listed(df, measure):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"], r.vec_id, r[measure])):
        out.setdefault(r.query_id, []).append((r.vec_id, r[measure]))
    return out


@pytest.fixture(scope="module")
def points():
    pick = np.random.default_rng(4)
    made = pick.normal(size=(700, 12)) * pick.uniform(0.2, 3, (700, 1))
    made[100:260] = made[100]  # many copies: ties by id
    made[300:340] = np.round(made[300:340])
    return np.arange(700) * 2, np.where(np.abs(made).sum(axis=1, keepdims=True) == 0, 1.0, made)


def inner(q, p):
    return float((q * p).sum())


def hamming(q, p):
    return int(((q > 0) != (p > 0)).sum())


def odd_rows():
    nan, inf = float("nan"), float("inf")
    return [(20001, None), (20020, [0.0] * 12), (20003, [nan] + [1.0] * 11), (20004, [inf] + [1.0] * 11),
            (20005, [None] + [1.0] * 11), (None, [1.0] * 12), (20007, [])]


def other_lengths():
    return [(20006, [9.0, 9.0]), (20040, [1.0, -2.0]), (20040, [3.0, 1.0]), (20041, [-1.0, 4.0]), (20060, [5.0])]


def frame(spark, points, more=()):
    rows = [(int(i), [float(x) for x in p]) for i, p in zip(*points)]
    return spark.createDataFrame([*rows, *rows[:5], *more], "vec_id long, embedding array<double>").selectExpr(
        "*", "'clash' as shard", "1 as rank")


@pytest.mark.parametrize("sizes", [(97, 11), (8192, 2048)])
def test_both_searches_equal_all_pairs(spark, points, monkeypatch, sizes):
    monkeypatch.setattr(blocks, "SHARD", sizes[0])
    monkeypatch.setattr(blocks, "BLOCK", sizes[1])
    monkeypatch.setattr(vantage_tree, "LEAF", 5)
    vectors = blocks.usable_vectors(frame(spark, points, odd_rows() + other_lengths()))
    rows = [*zip(*points)]
    rows += rows[:5] + [(i, np.array(p)) for i, p in other_lengths()]  # the frame repeats five rows
    points = [i for i, _ in rows], [p for _, p in rows]
    assert listed(multi_index.hamming_top_k(vectors, 7), "distance") == brute(*points, 7, hamming, 1)
    found, wanted = listed(vantage_tree.nearest(vectors, 7), "score"), brute(*points, 7, inner, -1)
    assert {q: [i for i, _ in rows] for q, rows in found.items()} == {q: [i for i, _ in rows] for q, rows in wanted.items()}
    for q, rows in found.items():
        assert np.allclose([s for _, s in rows], [s for _, s in wanted[q]], rtol=1e-13)


def test_larger_factors_prune_more_and_keep_recall(points):
    import pandas as pd

    pick = np.random.default_rng(9)
    rows = pd.DataFrame({"vec_id": np.arange(3000), "vector": list(pick.normal(size=(3000, 4)))})
    index, queries = vantage_tree.build(rows), rows[rows.vec_id % 20 == 0]
    exact = vantage_tree.look_up(index, queries, 10, 1.0)[1].reshape(-1, 10)
    relaxed = vantage_tree.look_up(index, queries, 10, 1.5)[1].reshape(-1, 10)
    recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact, relaxed)])
    assert 0.9 <= recall <= 1.0


def test_few_rows_and_none(spark, points):
    three = blocks.usable_vectors(frame(spark, (points[0][:3], points[1][:3])))
    assert vantage_tree.nearest(three).count() == multi_index.hamming_top_k(three).count() == 10  # every row twice
    three = three.distinct()
    assert vantage_tree.nearest(three).count() == multi_index.hamming_top_k(three).count() == 2
    none = blocks.usable_vectors(frame(spark, points).limit(0))
    assert vantage_tree.nearest(none).count() == multi_index.hamming_top_k(none).count() == 0


def test_fixture_recall(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    held = [(r.vec_id, np.array(r.embedding, float)) for r in rows.collect()]
    wanted = brute([i for i, _ in held], [p for _, p in held], 20, inner, -1)
    found = listed(vantage_tree.op6_vantage_tree(spark, sf_dir), "score")
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in wanted[q]}) for q in wanted)
    assert found.keys() == wanted.keys() and hits >= 0.9 * 20 * len(wanted)

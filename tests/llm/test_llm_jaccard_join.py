import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join as jj


def shingle_set(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows, threshold=0.8):
    """(class, copies, links, linked docs, group) of every doc_id, from all pairs."""
    classes = {}
    for doc_id, text in rows:
        classes.setdefault(" ".join((text or "").lower().split()) or ("empty", doc_id), []).append(doc_id)
    keys, sets = list(classes), {}
    for k in keys:
        sets[k] = shingle_set(k) if isinstance(k, str) else frozenset()
    links = {k: [] for k in keys}
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and both >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a].append(b)
                links[b].append(a)
    out = {}
    for k in keys:
        seen, todo = {k}, [k]
        while todo:
            for other in links[todo.pop()]:
                if other not in seen:
                    seen.add(other)
                    todo.append(other)
        group = min(min(classes[x]) for x in seen)
        for doc_id in classes[k]:
            out[doc_id] = (min(classes[k]), len(classes[k]), len(links[k]), sum(len(classes[x]) for x in links[k]), group)
    return out


def made(rows):
    return {r.doc_id: (r.class_id, r.n_copies, r.n_links, r.n_linked_docs, r.group_id) for r in rows}


@pytest.fixture(scope="module")
def near_copies():
    pick = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows, doc_id = [(0, None), (1, ""), (2, " \n "), (3, "one two"), (4, "One  two"), (5, "one two three four")], 6
    for _ in range(12):
        base = [pick.choice(words) for _ in range(pick.randint(20, 300))]
        for _ in range(pick.randint(1, 14)):
            text = list(base)
            for _ in range(pick.choice([0, 0, 1, 1, 2, 3, 5])):
                text[pick.randrange(len(text))] = pick.choice(words)
            rows.append((doc_id, " ".join(text)))
            doc_id += 1
    return rows


def test_join_equals_all_pairs(spark, near_copies, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 4)
    monkeypatch.setattr(jj, "DENSE", 3)
    docs = spark.createDataFrame(near_copies, "doc_id long, text string").withColumn("root", F.lit("clash"))
    assert made(jj.join(docs).collect()) == brute(near_copies)
    kept = jj.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({v[4] for v in brute(near_copies).values()})


def test_fixture_equals_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert made(jj.join(docs).collect()) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "x"), (2, "y")],
                                 "doc_id long, text string")
    rows = sorted((r.doc_id or 0, r.class_id or 0, r.n_copies, r.n_links) for r in jj.join(docs).collect())
    assert rows == [(0, 0, 1, 0), (1, 1, 2, 0), (1, 1, 2, 0), (2, 2, 1, 0), (2, 2, 1, 0)]
    assert jj.join(docs.limit(0)).count() == 0
    more = docs.withColumn("row", F.lit("clash"))
    assert sorted((r.text, r.doc_id) for r in jj.keep_one(more).collect()) == [("a b c d e f", 1), ("x", 2), ("y", 2)]
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, None), (3, ""), (4, "p q r s t u"), (5, "p q r s t u"), (5, "z")]
    kept = jj.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [
        (0, "a b c d e f"), (3, ""), (3, ""), (4, "p q r s t u"), (5, "z")]


def test_matched_prefix_is_shortened_to_the_recall():
    depth = jj.matched_depth()
    assert 1 - (1 - 0.8 ** depth) ** jj.TREES >= jj.RECALL > 1 - (1 - 0.8 ** (depth + 1)) ** jj.TREES


def test_intersections():
    pick = np.random.default_rng(3)
    sets = [np.unique(pick.integers(0, 60, pick.integers(1, 40)).astype(np.uint64)) for _ in range(50)]
    exact = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert (jj._shared(sets[:20], sets[20:]) == exact[:20, 20:]).all()
    own = jj._shared(sets, None)
    np.fill_diagonal(own, 0)
    np.fill_diagonal(exact, 0)
    assert (own == exact).all()


def test_components(spark):
    pick = random.Random(2)
    edges = [(i, i + 1) for i in range(40) if i % 10] + [(100, 7), (100, 99)] + [(pick.randint(200, 300), 200) for _ in range(50)]
    got = {r.id: r.root for r in jj.smallest_of_component(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}

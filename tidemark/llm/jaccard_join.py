"""N-gram Jaccard join: MinHash bands propose, exact set intersections decide.

Every text is the set of its runs of five lower-case words. Each of `TREES` trees holds a prefix of MinHash values,
whose length, at most `DEPTH`, is the longest at which a pair just at the threshold meets in some tree with the target
recall. It follows from the parameters alone: no tries are built and no prefix is shortened by the data. Texts that
share a prefix are connected; every connected set is then verified pair by pair, so a pair missed by all trees is found
as well if a chain of others connects it. A pair that nothing connects is missed, at the threshold with a chance of 0.3 %.

Sets may be huge (a third of all rows as near copies of each other), so a set is cut into blocks by hash and
each pair of blocks is one unit of work: shared shingles become a 0/1 matrix product. Units return the number
of links per text and a spanning forest, never the pairs.

Classes: texts with equal word sequences are one class, named by its smallest doc_id. Links are between
classes; every document gets the number of classes and of documents that its own class is linked with. A
group is a connected set of linked classes, named by its smallest doc_id.

Null and empty texts (no word) are each a class and group of their own, without links; texts of one to four
words are one shingle. Every row counts as a document, repeated rows too. Rows with a null doc_id take no part
in links: class and group are null. An empty table gives no rows. Extra columns are not carried. Shingles and
word sequences are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches, by_rows, table, written

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 32, 12, 0.995
#: Texts of one connected set that are verified as one block.
BLOCK = 2048
#: Shingles held by more texts of a unit than this are counted by a matrix product, others pair by pair.
DENSE = 12

def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def shingles_of(words: list[str], n: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of `n` words; of all words, if there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    hashes = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    width = min(n, len(words))
    mixed = np.zeros(len(words) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            mixed = _scramble(mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[i:len(hashes) - width + 1 + i])
    return np.unique(mixed)


def _scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def matched_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with the wanted chance."""
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < recall:
        depth -= 1
    return depth


def signer(depth: int, trees: int = TREES):
    """A function from shingles to one 64-bit node per tree: the tree's first `depth` MinHash values, hashed."""
    pick = np.random.default_rng(20)
    factors = pick.integers(1, 1 << 63, trees * depth, np.uint64) | np.uint64(1)
    shifts = pick.integers(0, 1 << 63, trees * depth, np.uint64)
    powers = _scramble(np.arange(1, depth + 1, dtype=np.uint64)) | np.uint64(1)
    salts = _scramble(np.arange(trees, dtype=np.uint64) + np.uint64(977))

    def nodes(shingles: np.ndarray) -> np.ndarray:
        least = np.full(trees * depth, np.iinfo(np.uint64).max)
        with np.errstate(over="ignore"):
            for at in range(0, len(shingles), 2048):  # bounded memory for long texts
                values = factors[:, None] * shingles[None, at:at + 2048]
                values += shifts[:, None]
                np.minimum(least, values.min(axis=1), out=least)
            strings = _scramble(least).reshape(trees, depth)
            return _scramble((strings * powers).sum(axis=1, dtype=np.uint64) + salts)

    return nodes


def key_of(words: list[str]) -> int:
    """The word sequence as a signed 64-bit hash."""
    return int.from_bytes(blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def signed(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, key, nodes) of every row; key and nodes are null for texts without a word."""
    depth = matched_depth(threshold)

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes = signer(depth)
        for frame in by_rows(frames, 256):
            lists = [words_of(t) for t in frame["text"]]
            yield pd.DataFrame({
                "doc_id": frame["doc_id"].astype("Int64"),
                "key": pd.array([key_of(w) if w else None for w in lists], dtype="Int64"),
                "nodes": [nodes(shingles_of(w)).view(np.int64) if w else None for w in lists]})

    return bound_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInPandas(sign, "doc_id long, key long, nodes array<long>")


def smallest_of_component(edges: DataFrame) -> DataFrame:
    """(id, root) of every id in undirected edges (a, b): the smallest id that it is connected with.

    Alternates large-star and small-star steps; every round is written to the shared folder.
    """
    pairs = written(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        pairs = written(small.select("e.*").where("a <> b").distinct())
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            return pairs.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("id"), "root").unionByName(
                pairs.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
        before = now


def _shared(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of every set of `left` with every set of `right` (or of `left` itself)."""
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, column, holders = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    n, m = len(left), len(right) if right is not None else len(left)
    out = np.zeros((n, m), np.float32)
    frequent = np.flatnonzero(holders > DENSE)
    place = np.full(len(values), -1)
    place[frequent] = np.arange(len(frequent))
    at = place[column]
    for start in range(0, len(frequent), 2048):
        inside = (at >= start) & (at < start + 2048)
        matrix = np.zeros((len(sets), min(2048, len(frequent) - start)), np.float32)
        matrix[owner[inside], at[inside] - start] = 1
        out += matrix[:n] @ (matrix[n:] if right is not None else matrix).T
    rare = (holders[column] <= DENSE) & (holders[column] > 1)
    order = np.argsort(column[rare], kind="stable")
    owners, keys = owner[rare][order], column[rare][order]
    for gap in range(1, DENSE):  # owners of one value stand together, at most DENSE of them
        same = np.flatnonzero(keys[gap:] == keys[:-gap])
        a, b = owners[same], owners[same + gap]
        if right is None:
            np.add.at(out, (a, b), 1)
            np.add.at(out, (b, a), 1)
        else:
            cross = (a < n) & (b >= n)
            np.add.at(out, (a[cross], b[cross] - n), 1)
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which sets have a Jaccard similarity of at least the threshold; never a set with itself."""
    shared = _shared(left, right).astype(np.float64)
    sizes = np.array([len(s) for s in left], float)
    others = sizes if right is None else np.array([len(s) for s in right], float)
    out = shared >= threshold * (sizes[:, None] + others[None, :] - shared) - 1e-9
    if right is None:
        np.fill_diagonal(out, False)
    return out


def _forest(links: np.ndarray, ids: np.ndarray, others: np.ndarray) -> list[tuple[int, int]]:
    """Edges (id, smallest id) of a spanning forest of the links between rows (ids) and columns (others)."""
    infinite = np.iinfo(np.int64).max
    row, column = ids.copy(), others.copy()
    while True:
        new_row = np.minimum(row, np.array([column[l].min(initial=infinite) for l in links]))
        new_column = np.minimum(column, np.array([new_row[l].min(initial=infinite) for l in links.T]))
        if (new_row == row).all() and (new_column == column).all():
            break
        row, column = new_row, new_column
    return list(dict.fromkeys((int(i), int(r)) for i, r in [*zip(ids, row), *zip(others, column)] if i != r))


def _verify(threshold: float):
    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Links and forest edges of each unit; rows of a unit follow each other."""
        held: list[pd.DataFrame] = []
        unit = None
        for frame in frames:
            marks = (frame["root"].to_numpy() != frame["root"].shift().to_numpy()) \
                | (frame["low"].to_numpy() != frame["low"].shift().to_numpy()) \
                | (frame["high"].to_numpy() != frame["high"].shift().to_numpy())
            cuts = [0, *(np.flatnonzero(marks[1:]) + 1).tolist(), len(frame)] if len(frame) else []
            for a, b in zip(cuts, cuts[1:]):
                part = frame.iloc[a:b]
                key = tuple(part[["root", "low", "high"]].iloc[0])
                if key != unit and held:
                    yield _unit(pd.concat(held), threshold)
                    held = []
                unit = key
                held.append(part)
        if held:
            yield _unit(pd.concat(held), threshold)

    return verify


def _unit(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    low, high = rows["low"].iloc[0], rows["high"].iloc[0]
    rows = rows.drop_duplicates("key")
    sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
    ids, copies = rows["key"].to_numpy(np.int64), rows["copies"].to_numpy(np.float64)
    first = (rows["block"] == low).to_numpy()
    if low == high:
        links = linked(sets, None, threshold)
        edges = _forest(links, ids, ids)
        found = list(zip(ids, links.sum(axis=1), links @ copies))
    else:
        left, right = np.flatnonzero(first), np.flatnonzero(~first)
        links = linked([sets[i] for i in left], [sets[i] for i in right], threshold) if len(left) and len(right) \
            else np.zeros((len(left), len(right)), bool)
        edges = _forest(links, ids[left], ids[right])
        found = [*zip(ids[left], links.sum(axis=1), links @ copies[right]),
                 *zip(ids[right], links.sum(axis=0), links.T @ copies[left])]
    out = [(int(i), int(n), int(d), None) for i, n, d in found if n] + [(i, 0, 0, r) for i, r in edges]
    names = ("key", "n_links", "n_linked_docs", "other")
    return pd.DataFrame({c: pd.array([row[k] for row in out], dtype="Int64") for k, c in enumerate(names)})


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `docs`: doc_id, class_id, n_copies, n_links, n_linked_docs, group_id."""
    signs = written(signed(docs, threshold))
    usable = signs.where("doc_id is not null and key is not null")
    classes = written(usable.groupBy("key").agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("n_copies"), F.min("nodes").alias("nodes")))
    nodes = classes.select("key", F.explode("nodes").alias("node"))
    shared = nodes.groupBy("node").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1")
    stars = nodes.join(shared, "node").where("key <> first").select(F.col("key").alias("a"), F.col("first").alias("b"))
    roots = written(smallest_of_component(stars))
    blocks = roots.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = roots.withColumnRenamed("id", "key").join(blocks, "root").join(classes.drop("nodes"), "key").select(
        F.col("class_id").alias("doc_id"), "key", "root", "blocks", F.col("n_copies").alias("copies"),
        F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"))

    def shingled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in by_rows(frames, 256):
            lists = [words_of(t) for t in frame["text"]]
            own = [key_of(w) == k for w, k in zip(lists, frame["key"])]  # another text may have the same doc_id
            yield frame[["key", "root", "blocks", "copies", "block"]].assign(
                shingles=[shingles_of(w).tobytes() for w in lists])[own]

    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    candidates = placed.join(texts, "doc_id").mapInPandas(
        shingled, "key long, root long, blocks int, copies long, block int, shingles binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    units = candidates.select("*", other).withColumns({
        "low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other", "blocks")
    found = written(units.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high").mapInPandas(
        _verify(threshold), "key long, n_links long, n_linked_docs long, other long"))
    counts = found.where("other is null").groupBy("key").agg(
        F.sum("n_links").alias("n_links"), F.sum("n_linked_docs").alias("n_linked_docs"))
    groups = smallest_of_component(found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    named = groups.withColumnRenamed("id", "key").join(classes.select("key", "class_id"), "key")
    first = named.groupBy("root").agg(F.min("class_id").alias("group_id"))
    per_class = classes.drop("nodes").join(counts, "key", "left").join(
        named.join(first, "root").select("key", "group_id"), "key", "left")
    none = F.lit(0).cast("long")
    rows = usable.select("doc_id", "key").join(per_class, "key").select(
        "doc_id", "class_id", "n_copies", F.coalesce("n_links", none).alias("n_links"),
        F.coalesce("n_linked_docs", none).alias("n_linked_docs"), F.coalesce("group_id", "class_id").alias("group_id"))
    return rows.unionByName(signs.where("doc_id is null or key is null").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"), none.alias("n_links"),
        none.alias("n_linked_docs"), F.col("doc_id").alias("group_id")))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with one row of each group: the smallest doc_id (null last); of rows that repeat it, any one.

    Rows are told apart by a key of their own, so repeated rows, null ids and texts that share an id are compared as well.
    Texts without a word are groups of their own and stay.
    """
    kept = written(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")))
    groups = join(kept.select(F.col("row").alias("doc_id"), "doc.text"), threshold).select(
        F.col("doc_id").alias("row"), "group_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = kept.select("row", "doc.doc_id").join(groups, "row").groupBy("group_id").agg(F.min(order).alias("first"))
    return kept.join(first.select("first.row"), "row", "left_semi").select("doc.*")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))

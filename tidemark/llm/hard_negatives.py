"""Hard negatives by anchor-clustered shared lists with certified termination (MAXIMUS-style), exact.

Anchors are clustered by direction. An anchor within `theta` of its cluster's centre and a candidate at angle `phi`
to that centre are at least `phi - theta` apart, so the candidate's length times cos(phi - theta) bounds every
member's score from above, per unit of the member's own length. Candidates are sorted by this bound once per cluster;
each member walks the list until the bound of what is left is below the worst score it still has to beat.

Scale: candidates are dealt by their nearest centre and their length into chunks, anchors by cluster into blocks, both
of about a stated size; a cluster or a length of any size is split by hash. A block first meets one chunk of its own
direction, which gives every member a score to beat; then it meets those chunks whose bound (greatest length, least
angle) can still hold something. Within a meeting the list is the chunk sorted by the cluster's bounds. Centres are
fitted on a bounded sample of anchors (`SAMPLE`); they affect the work only, not the result.

A search answers asks: the k best rows of the anchor's label, or of any other label, with scores in a range. Positives
are one ask per anchor; each of them then is an ask for negatives with scores between 30 and 90 percent of its own.

Rows with a null label, a null vector, or a null or non-finite component take no part. Rows without an id are
candidates, are no anchors, and come last among equal scores. Repeated rows are rows of their own: each is a
candidate, each anchor has its own result. Vectors meet those of equal length only. Scores are whole numbers, exact as
long as they fit a long. An anchor without positives, or a positive without negatives, gives no rows; nor does an
empty table. Extra columns stay aside.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table, written

POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Anchors the centres are fitted on, anchors per cluster, clusters at most.
SAMPLE, PER_CLUSTER, CLUSTERS = 4096, 32, 64
#: Expected anchors of a block and candidates of a chunk; rows of a list's first page.
BLOCK, CHUNK, PAGE = 1024, 8192, 256
#: Room for rounding in bounds, relative to the lengths involved; exact scores decide within it.
SLACK = 1e-6
_LEAST, _MOST = -(1 << 62), 1 << 62
_NO_ID = (1 << 63) - 1


def fitted(vectors: np.ndarray) -> np.ndarray:
    """Unit centres of a sample by spherical k-means; a single zero centre where no direction is known."""
    lengths = np.sqrt((vectors ** 2).sum(axis=1))
    units = vectors[lengths > 0] / lengths[lengths > 0, None]
    count = min(CLUSTERS, len(units) // PER_CLUSTER + 1)
    if not len(units):
        return np.zeros((1, vectors.shape[1]))
    centres = units[np.linspace(0, len(units) - 1, count).astype(int)]
    for _ in range(8):
        nearest = (units @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, units)
        size = np.sqrt((sums ** 2).sum(axis=1, keepdims=True))
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    return centres


def angles(units: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centre, -1.0, 1.0))


class Best:
    """The k best (score, id, row) of many asks; worse scores than an ask's own floor never enter."""

    def __init__(self, floors: np.ndarray, k: int) -> None:
        self.k, self.floors = k, floors
        self.scores = np.full((len(floors), k), _LEAST, np.int64)
        self.ids = np.full((len(floors), k), _NO_ID, np.int64)
        self.rows = np.full((len(floors), k), -1, np.int64)

    def to_beat(self, asks: np.ndarray) -> np.ndarray:
        return np.maximum(self.floors[asks], self.scores[asks, -1])

    def offer(self, asks: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        order = np.lexsort((rows, ids, -scores, asks))
        asks, scores, ids, rows = asks[order], scores[order], ids[order], rows[order]
        touched, first = np.unique(asks, return_index=True)
        nth = np.arange(len(asks)) - np.repeat(first, np.diff(np.append(first, len(asks))))
        keep = nth < self.k
        where, nth = np.searchsorted(touched, asks[keep]), nth[keep]
        merged = []
        for held, new, blank in ((self.scores, scores, _LEAST), (self.ids, ids, _NO_ID), (self.rows, rows, -1)):
            fresh = np.full((len(touched), self.k), blank, np.int64)
            fresh[where, nth] = new[keep]
            merged.append(np.concatenate([held[touched], fresh], axis=1))
        line = np.lexsort((merged[2], merged[1], -merged[0]), axis=1)[:, :self.k]
        for held, both in zip((self.scores, self.ids, self.rows), merged):
            held[touched] = np.take_along_axis(both, line, axis=1)


def matrix(frame: pd.DataFrame) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in frame["q"]])


def slots_of(lists: pd.Series, blank: int) -> np.ndarray:
    """Ranges of every anchor, filled up to the longest list."""
    out = np.full((len(lists), max(map(len, lists))), blank, np.int64)
    for i, values in enumerate(lists):
        out[i, :len(values)] = values
    return out


def walk(anchors: pd.DataFrame, chunk: pd.DataFrame, centres: np.ndarray, same: bool, k: int) -> pd.DataFrame:
    """The k best rows of a chunk for every ask of a block, cluster by cluster."""
    own, points = matrix(anchors), matrix(chunk)
    lengths, norms = anchors["norm"].to_numpy(), chunk["norm"].to_numpy()
    labels, own_labels = chunk["label"].to_numpy(), anchors["label"].to_numpy()
    rows, own_rows = chunk["row"].to_numpy(np.int64), anchors["row"].to_numpy(np.int64)
    ids = chunk["vec_id"].to_numpy(np.int64)
    low, high = slots_of(anchors["low"], _MOST), slots_of(anchors["high"], _LEAST)
    slots = low.shape[1]
    best = Best(low.reshape(-1), k)
    units = points / np.where(norms > 0, norms, 1.0)[:, None]
    # Sums of whole numbers are exact in floating point up to 2^53.
    exact = lengths.max() * norms.max() < float(1 << 53)
    clusters = anchors["centre"].to_numpy()
    for cluster in np.unique(clusters):
        members = np.flatnonzero(clusters == cluster)
        centre, theta = centres[cluster], float(anchors["angle"].to_numpy()[members].max())
        apart = np.maximum(angles(units, centre) - theta, 0.0) if centre.any() else np.zeros(len(points))
        bound = norms * np.cos(apart) + SLACK * norms
        order = np.argsort(-bound, kind="stable")
        start, size = 0, PAGE
        while start < len(order):
            worst = best.to_beat((members[:, None] * slots + np.arange(slots)).reshape(-1)).reshape(-1, slots).min(axis=1)
            active = members[lengths[members] * bound[order[start]] + SLACK >= worst]
            if not len(active):
                break  # certified: whatever is left scores less for every member
            page = order[start:start + size]
            start, size = start + size, size * 2
            if exact:
                scores = np.rint(own[active] @ points[page].T).astype(np.int64)
            else:
                scores = own[active].astype(np.int64) @ points[page].astype(np.int64).T
            fits = (own_labels[active][:, None] == labels[page]) == same
            fits &= own_rows[active][:, None] != rows[page]
            for slot in range(slots):
                asks = active * slots + slot
                member, at = np.nonzero(fits & (scores >= best.to_beat(asks)[:, None]) & (scores <= high[active, slot][:, None]))
                if len(member):
                    best.offer(asks[member], scores[member, at], ids[page[at]], rows[page[at]])
    some = best.rows >= 0
    ask = np.repeat(np.arange(len(some)), some.sum(axis=1))
    return pd.DataFrame({"anchor": own_rows[ask // slots], "slot": ask % slots, "vec_id": best.ids[some],
                         "row": best.rows[some], "score": best.scores[some]})


def usable(rows: DataFrame) -> DataFrame:
    """(row, vec_id, label, q): whole-number vectors of the rows that take part, each with a key of its own."""
    vector = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
        label.cast("long").alias("label"), F.transform(vector, lambda x: F.floor(x * 256).cast("double")).alias("q"))


def _is_anchor(every: int) -> Column:
    return F.coalesce(F.col("vec_id") % every == 0, F.lit(False))


class Directions:
    """Rows dealt by direction and length, and the searches over them."""

    def __init__(self, vectors: DataFrame, every: int) -> None:
        self.every = every
        vectors = written(vectors.withColumn("d", F.size("q")))
        sample: dict[int, list] = {}
        for r in vectors.where(_is_anchor(every)).orderBy(F.xxhash64("row")).limit(SAMPLE).select("d", "q").collect():
            sample.setdefault(r.d, []).append(r.q)
        centres = {d: fitted(np.array(found, np.float64).reshape(len(found), d)) for d, found in sample.items()}
        self.centres = centres

        def placed(frames):
            for frame in frames:
                for d, part in frame.groupby("d"):
                    known = centres.get(d, np.zeros((1, d)))
                    points = np.stack([np.asarray(v, np.float64) for v in part["q"]])
                    norm = np.sqrt((points ** 2).sum(axis=1))
                    cosine = points @ known.T / np.where(norm > 0, norm, 1.0)[:, None]
                    nearest = cosine.argmax(axis=1)
                    angle = np.arccos(np.clip(cosine[np.arange(len(points)), nearest], -1.0, 1.0))
                    yield part.assign(centre=nearest, angle=np.where(norm > 0, angle, 0.0), norm=norm,
                                      band=np.floor(4 * np.log2(np.maximum(norm, 0.5))).astype(np.int64))

        ided = vectors.withColumn("vec_id", F.coalesce("vec_id", F.lit(_NO_ID)))
        schema = "row long, vec_id long, label long, q array<double>, d int, centre int, angle double, norm double, band long"
        rows = written(ided.mapInPandas(placed, schema))
        sizes = rows.groupBy("d", "centre", "band").agg(F.count(F.lit(1)).alias("_n"))
        slot = F.floor(F.pmod(F.xxhash64("row"), F.col("_n")) / CHUNK).cast("int").alias("chunk")
        self.rows = written(rows.join(sizes, ["d", "centre", "band"]).select(*rows.columns, slot))
        anchors = self.rows.where((F.col("vec_id") % every == 0) & (F.col("vec_id") != _NO_ID))
        counts = anchors.groupBy("d", "centre").agg(F.count(F.lit(1)).alias("_n"))
        upto = Window.partitionBy("d").orderBy("centre").rowsBetween(Window.unboundedPreceding, -1)  # at most CLUSTERS rows
        before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
        block = F.floor((F.col("_before") + F.pmod(F.xxhash64("row"), F.col("_n"))) / BLOCK).cast("int").alias("block")
        self.anchors = written(anchors.join(before, ["d", "centre"]).select(
            "row", "vec_id", "label", "q", "d", "centre", "angle", "norm", block))
        self.chunks = written(self.rows.groupBy("d", "centre", "band", "chunk").agg(
            F.max("angle").alias("phi"), F.max("norm").alias("top")))
        apart = [(int(d), i, j, float(a)) for d, known in centres.items() for i, c in enumerate(known)
                 for j, a in enumerate(angles(known, c) if c.any() else np.zeros(len(known)))]
        self.apart = vectors.sparkSession.createDataFrame(apart, "d int, centre int, other int, apart double")

    def _meet(self, asks: DataFrame, tiles: DataFrame, same: bool, k: int) -> DataFrame:
        """The best rows of every ask in the chunks its block is paired with."""
        centres = self.centres
        tiles = written(tiles.select("d", "block", F.col("centre").alias("side"), "band", "chunk").distinct())
        anchors = asks.join(tiles, ["d", "block"])
        rows = self.rows.withColumnRenamed("centre", "side").join(tiles, ["d", "side", "band", "chunk"])
        key = ["d", "block", "side", "band", "chunk"]

        def met(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({c: [] for c in ("anchor", "slot", "vec_id", "row", "score")})
            return walk(left, right, centres[int(left["d"].iloc[0])], same, k)

        return anchors.groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(
            met, "anchor long, slot int, vec_id long, row long, score long")

    def search(self, ranges: DataFrame, same: bool, k: int) -> DataFrame:
        """(anchor, slot, rank, vec_id, row, score) for `ranges` (anchor, low array, high array) of scores."""
        asks = self.anchors.join(ranges.withColumnRenamed("anchor", "row"), "row")
        home = self.chunks.groupBy("d", "centre").agg(F.max_by(F.struct("band", "chunk"), F.struct("top", -F.col("chunk"))).alias("h"))
        home = home.select("d", "centre", "h.*")
        blocks = asks.select("d", "block", "centre").distinct()
        first_tiles = written(blocks.join(home, ["d", "centre"]))
        first = written(self._meet(asks, first_tiles, same, k))
        # What each ask still has to beat: the k-th best score so far, or the lower end of its range.
        kth = first.groupBy("anchor", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        beaten = kth.where(F.col("n") >= k).groupBy("anchor").agg(
            F.map_from_entries(F.collect_list(F.struct("slot", "least"))).alias("beaten"))
        low = F.transform("low", lambda value, slot: F.greatest(value, F.try_element_at("beaten", slot)))  # skips nulls
        open_asks = written(asks.join(beaten.withColumnRenamed("anchor", "row"), "row", "left").withColumn("low", F.coalesce(
            low, "low")).drop("beaten"))
        need = F.when(F.col("norm") > 0, F.array_min("low") / F.col("norm")).otherwise(float("-inf"))
        blocks = open_asks.groupBy("d", "block", "centre").agg(F.max("angle").alias("theta"), F.min(need).alias("need"))
        facing = blocks.join(self.apart, ["d", "centre"]).join(
            self.chunks.withColumnRenamed("centre", "other"), ["d", "other"])
        least = F.greatest(F.col("apart") - F.col("theta") - F.col("phi"), F.lit(0.0))
        bound = F.col("top") * (F.greatest(F.cos(least), F.lit(0.0)) + SLACK) + SLACK
        tiles = facing.where(bound >= F.col("need")).select("d", "block", F.col("other").alias("centre"), "band", "chunk").join(
            first_tiles.select("d", "block", "centre", "band", "chunk"), ["d", "block", "centre", "band", "chunk"], "left_anti")
        found = first.unionByName(self._meet(open_asks, tiles, same, k))
        rank = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "row"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
                   high: int = HIGH, every: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of `usable` vectors."""
    known = Directions(vectors, every)
    everything = known.anchors.select(F.col("row").alias("anchor"), F.array(F.lit(_LEAST)).alias("low"),
                                      F.array(F.lit(_MOST)).alias("high"))
    found = written(known.search(everything, True, positives).select(
        "anchor", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # low * positive <= 100 * negative <= high * positive has no solution below zero.
    # Hundreds and the rest apart, so that no product leaves a long.
    share = lambda percent, more: F.expr(f"positive_score div 100 * {percent} + (positive_score % 100 * {percent} + {more}) div 100")
    ends = F.struct("slot", share(low, 99).alias("low"), share(high, 0).alias("high"))
    empty = F.struct("slot", F.lit(_MOST).alias("low"), F.lit(_LEAST).alias("high"))
    asked = F.sort_array(F.collect_list(F.when(F.col("positive_score") >= 0, ends).otherwise(empty)))
    ranges = found.groupBy("anchor").agg(asked.alias("_r")).select(
        "anchor", F.col("_r.low").alias("low"), F.col("_r.high").alias("high"))
    wrong = known.search(ranges, False, negatives).select("anchor", "slot", "rank", "vec_id", "score")
    ided = lambda c: F.when(F.col(c) != _NO_ID, F.col(c)).alias
    return (wrong.join(found, ["anchor", "slot"])
            .join(known.anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
            .select("anchor_id", ided("positive_id")("positive_id"), "rank", ided("vec_id")("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(usable(table(spark, sf_dir, "embeddings")))


OP11_SQL = f"""
WITH usable AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS MATERIALIZED (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r AS r, b.vec_id, a.label = b.label AS same,
    list_dot_product(a.q, b.q)::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.r <> b.r AND len(a.q) = len(b.q)),
positives AS (
  SELECT anchor, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, r) AS slot
  FROM pairs WHERE same QUALIFY slot <= {POSITIVES})
SELECT n.anchor_id, p.positive_id, row_number() OVER (
    PARTITION BY p.anchor, p.slot ORDER BY n.score DESC, n.vec_id, n.r)::INTEGER AS rank,
  n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor = p.anchor AND NOT n.same
  AND {LOW} * p.positive_score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.positive_score
QUALIFY rank <= {NEGATIVES}"""

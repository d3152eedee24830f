"""Searching all rows for a stated set of queries, in blocks.

Vectors of one length are a group of their own: no measure is defined between lengths. Rows have keys of their own,
so rows that repeat a vec_id are all queries and candidates, and a query leaves out its own row only. Candidates are
dealt by hash into shards of bounded size, queries into blocks of bounded size. An index is built once per shard and
written to the shared folder. Every block then meets every index in a task of its
own, whose result is the block's best rows of that shard, and the best of a query's shards are its result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

#: Expected candidates of a shard, and queries of a block.
SHARD, BLOCK = 8192, 2048
#: A row is a query if its id is divisible by this.
EVERY = 20


def usable_vectors(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, vector) as doubles, without null, zero, non-finite or null-holding vectors and null ids."""
    vector = F.col(column).cast("array<double>")
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    return kept.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                      & F.exists("vector", lambda x: x != 0))


def matrix_of(frame: pd.DataFrame) -> np.ndarray:
    return np.array(frame["vector"].tolist(), np.float64)


def keys_of(frame: pd.DataFrame) -> np.ndarray:
    """What tells rows apart: the row's key, or the vec_id of frames without one."""
    return frame["row" if "row" in frame else "vec_id"].to_numpy(np.int64)


def search(vectors: DataFrame, build, look_up, k: int, measure: str, largest: bool) -> DataFrame:
    """(query_id, rank, vec_id, measure) of each query's k best rows among all others.

    build(frame of one shard) -> bytes; look_up(bytes, frame of one block) -> (query keys, ids, measures).
    Ties go to the smaller vec_id.
    """
    vectors = written(vectors.select(F.monotonically_increasing_id().alias("row"), F.size("vector").alias("size"),
                                     "vec_id", "vector"))
    asks = F.pmod("vec_id", F.lit(EVERY)) == 0
    # One row per length: lengths 1 to n take n squared / 2 components, so this table stays far smaller than the input.
    parts = written(vectors.groupBy("size").agg(
        F.ceil(F.count("*") / SHARD).cast("int").alias("shards"),
        F.ceil(F.count(F.when(asks, 1)) / BLOCK).cast("int").alias("blocks"))).where("blocks > 0")
    placed = vectors.join(parts, "size")

    def built(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"size": [key[0]], "shard": [key[1]], "index": [build(frame)]})

    shard = F.pmod(F.xxhash64("row"), F.col("shards")).cast("int").alias("shard")
    indexes = written(placed.select("row", "vec_id", "vector", "size", shard).groupBy("size", "shard").applyInPandas(
        built, "size int, shard int, index binary"))
    block = F.pmod(F.xxhash64(F.col("row"), F.lit(1)), F.col("blocks")).cast("int").alias("block")
    queries = placed.where(asks).select(
        "row", "vec_id", "vector", "size", block, F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    spread = indexes.join(parts, "size").select(
        "size", "shard", "index", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    kind = "double" if largest else "int"

    def met(block: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(index):
            return pd.DataFrame({"row": [], "query_id": [], "vec_id": [], measure: []})
        rows, ids, values = look_up(index["index"].iloc[0], block)
        names = block.set_index("row")["vec_id"]
        return pd.DataFrame({"row": rows, "query_id": names.loc[rows].to_numpy(), "vec_id": ids, measure: values})

    found = queries.groupBy("size", "shard", "block").cogroup(spread.groupBy("size", "shard", "block")).applyInPandas(
        met, f"row long, query_id long, vec_id long, {measure} {kind}")
    best = F.desc(measure) if largest else F.asc(measure)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(best, "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", measure)

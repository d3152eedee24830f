"""Sharding by a Feistel permutation of global row numbers; DataFrame functions only.

Rows are numbered 0 to n-1 in one total order. A keyed Feistel network permutes the numbers of an a x b rectangle
that just covers n (a is the rounded-up root of n, so at most a-1 points lie outside): a number's quotient and
remainder take turns in being shifted by a hash of the other. A result outside is permuted again until it lies
inside (cycle walking). Walks start from at most a-1 points, so they are followed once for those points and looked
up by the few rows that need one. A row's shard is its place modulo the number of shards, its slot the quotient:
counts differ by one at most, slots have no gaps, and any one row's shard and slot follow from its number, n and the
seed alone. The same rows and seed always give the same result, however the table is cut into partitions.

Equal rows are interchangeable: they get neighbouring numbers, in no certain order. Null keys come first, null texts
count as no bytes. An empty table gives no rows. Extra columns are carried by `shard_rows`; its own four columns
replace columns of the same names.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, written
from tidemark.operators.ranking import global_rank

SHARDS, SEED, ROUNDS = 8, 12, 6


def sides(rows: int) -> tuple[int, int]:
    """The rectangle: a x b >= rows, with less than a points to spare."""
    a = max(isqrt(max(rows - 1, 0)) + 1, 1)
    return a, max(-(-rows // a), 1)


def network(number: Column, rows: int, seed: int = SEED) -> Column:
    """The place of a number within the rectangle after one pass of the network."""
    a, b = (F.lit(side).cast("long") for side in sides(rows))

    def shifted(half: Column, other: Column, half_round: Column, size: Column) -> Column:
        return F.pmod(half + F.pmod(F.xxhash64(F.lit(seed), half_round, other), size), size)

    def step(halves: Column, half_round: Column) -> Column:
        left = F.when(half_round % 2 == 0, shifted(halves["l"], halves["r"], half_round, a)).otherwise(halves["l"])
        right = F.when(half_round % 2 == 1, shifted(halves["r"], halves["l"], half_round, b)).otherwise(halves["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    start = F.struct(((number - F.pmod(number, b)) / b).cast("long").alias("l"), F.pmod(number, b).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(2 * ROUNDS - 1)), start, step, lambda halves: halves["l"] * b + halves["r"])


def walks(spark: SparkSession, rows: int, seed: int = SEED) -> DataFrame:
    """(outside, inside): where the walk from each point outside ends; less than a rows.

    A walk that returns to its start never gets inside, but then no row's walk leads to it.
    """
    a, b = sides(rows)
    found = written(spark.range(rows, a * b).select(
        F.col("id").alias("outside"), network(F.col("id"), rows, seed).alias("inside")))
    on_its_way = (F.col("inside") >= rows) & (F.col("inside") != F.col("outside"))
    while not found.where(on_its_way).isEmpty():
        found = written(found.select("outside", F.when(on_its_way, network(F.col("inside"), rows, seed)).otherwise(
            F.col("inside")).alias("inside")))
    return found


def placed(df: DataFrame, number: str, out: str, rows: int, seed: int = SEED) -> DataFrame:
    """`out`: a permutation of 0..rows-1, for any subset of the numbers."""
    once = df.withColumn("_place", network(F.col(number), rows, seed))
    ends = walks(df.sparkSession, rows, seed).withColumnRenamed("outside", "_place")
    return once.join(ends, "_place", "left").withColumn(out, F.coalesce("inside", "_place")).drop("inside", "_place")


def shard_rows(df: DataFrame, order: list[Column], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """`df` with `row_number` in `order`, its permuted `place`, `shard` and `slot`.

    Rows that are equal in `order` follow the table's own order; only equal rows should be.
    """
    own = [c for c in df.columns if c not in ("row_number", "place", "shard", "slot")]
    tied = df.select(*own).withColumn("_tie", F.monotonically_increasing_id())
    numbered = global_rank(tied, [*order, F.col("_tie")], "row_number").drop("_tie").withColumn(
        "row_number", F.col("row_number") - 1)
    rows = numbered.count()
    return placed(numbered, "row_number", "place", rows, seed).withColumns({
        "shard": F.pmod(F.col("place"), F.lit(shards)).cast("int"),
        "slot": F.expr(f"place div {shards}").cast("long")})


def write_shards(sharded: DataFrame, path: str, file_rows: int = 1 << 20) -> None:
    """One folder per shard, its files cut and sorted by slot."""
    piece = F.expr(f"slot div {file_rows}")
    (sharded.repartition("shard", piece).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))


def op12_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64("text").alias("mark"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32"), F.col("mark")]
    return shard_rows(docs, order).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number")

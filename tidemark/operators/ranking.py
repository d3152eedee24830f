"""Order statistics and ranks that never put a whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import staged

BUCKETS = 64


def group_upper_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Element at offset floor(n/2) of each group's sorted values, exactly.

    Equal values collapse into counts first. Approximate quantiles then cut a group into
    buckets; bucket counts find the one bucket holding the wanted offset, and only that
    bucket, about 1/64 of the group, is ordered. Approximation affects balance, not results.
    """
    # Three branches read the counts: they are staged, so what is below them is derived once.
    counted = staged(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")))
    cuts = [i / BUCKETS for i in range(1, BUCKETS)]
    bounds = counted.groupBy(*keys).agg(
        F.percentile_approx(value, cuts, 1000).alias("_cuts"), F.sum("_n").alias("_total"))
    bucketed = counted.join(bounds, keys).withColumn(
        "_bucket", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    upto = (Window.partitionBy(*keys).orderBy("_bucket")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    wanted = (
        bucketed.groupBy(*keys, "_bucket")
        .agg(F.sum("_n").alias("_size"), F.max("_total").alias("_total"))
        .withColumn("_before", F.sum("_size").over(upto) - F.col("_size"))
        .withColumn("_offset", F.floor(F.col("_total") / 2))
        .where("_before <= _offset AND _offset < _before + _size")
        .select(*keys, "_bucket", "_before", "_offset"))
    inside = (Window.partitionBy(*keys).orderBy(value)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        bucketed.join(wanted, [*keys, "_bucket"])
        .withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
        .where("_upto > _offset")
        .groupBy(*keys).agg(F.min(value).alias(out))
    )


def global_rank(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Position of each row in one total order, without a single-task window.

    A range-partitioned sort places the rows; a row's rank is its place in its partition
    plus the sizes of the partitions before it. `order` must be unique per row.
    """
    placed = staged(
        df.orderBy(*order).withColumns({
            "_pid": F.spark_partition_id(),
            "_pos": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    # One row per sort partition, a few thousand at most.
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select("_pid", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (placed.join(offsets, "_pid")
            .withColumn(out, F.col("_offset") + F.col("_pos") + 1)
            .drop("_pid", "_pos", "_offset"))


def rank_within(df: DataFrame, group: str, order: list[Column], out: str) -> DataFrame:
    """Rank inside groups of any size: the rank in (group, order) less that of the group's first."""
    ranked = global_rank(df, [F.col(group).asc_nulls_last(), *order], "_rank")
    first = ranked.groupBy(F.col(group).alias("_group")).agg(F.min("_rank").alias("_first"))
    return (ranked.join(first, F.col(group).eqNullSafe(F.col("_group")))
            .withColumn(out, F.col("_rank") - F.col("_first") + 1)
            .drop("_rank", "_first", "_group"))

"""Relational operators that Spark SQL has no text for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def groups_frame(df: DataFrame, keys: list[str], order: str, lower: int | None, upper: int | None, aggregates: dict[str, Column]) -> DataFrame:
    """df with aggregates over a GROUPS frame: from lower to upper peer groups of order around the row's own.

    None is unbounded. Peer groups are numbered by dense_rank, over which a RANGE frame is taken. Nulls of order are
    one peer group, the last.
    """
    peers = Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_last())
    numbered = df.withColumn("_peers", F.dense_rank().over(peers))
    frame = Window.partitionBy(*keys).orderBy("_peers").rangeBetween(
        Window.unboundedPreceding if lower is None else lower, Window.unboundedFollowing if upper is None else upper
    )
    return numbered.withColumns({name: agg.over(frame) for name, agg in aggregates.items()}).drop("_peers")


def weighted_percentile(df: DataFrame, keys: list[str], value: str, weight: str, share: float, out: str) -> DataFrame:
    """The smallest value at which the weights of all values up to it reach share of the whole, for each keys.

    Rows are summed up by value first, so equal values cost one row. Null values or weights are left out.
    """
    sums = df.where(F.col(value).isNotNull() & F.col(weight).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*keys)
    at = sums.withColumn("_c", F.sum("_w").over(w.orderBy(value))).withColumn("_t", F.sum("_w").over(w))
    return at.where(F.col("_c") >= share * F.col("_t")).groupBy(*keys).agg(F.min(value).alias(out))


def asof_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, take: str) -> DataFrame:
    """left with the column take of the latest right row of the same key before it (strictly), null if there is none.

    Both sides are put in one sequence and the last right value is carried on, one shuffle by key; no row pairs are
    made. Of right rows at one time the one with the greatest take counts.
    """
    l = left.select("*", F.col(left_at).alias("_at"), F.lit(0).alias("_side"))
    r = right.select(F.col(key).alias("_rk"), F.col(right_at).alias("_at"), F.col(take).alias("_take"))
    r = r.groupBy("_rk", "_at").agg(F.max("_take").alias("_take"))
    both = l.withColumn("_take", F.lit(None).cast(right.schema[take].dataType)).withColumn("_rk", F.col(key)).unionByName(r.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    # At one time left rows come first, so a right row of the same moment is not before them.
    w = Window.partitionBy("_rk").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn(take, F.last("_take", ignorenulls=True).over(w))
    return filled.where("_side = 0").select(*left.columns, take)

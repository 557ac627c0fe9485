"""Joins, ranks and neighbours that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A key is hot if it has more than this share of all rows; so there are at most 1 / share hot keys.
HOT_SHARE = 1 / 256
#: Parts that the rows of a hot key are spread over.
SALTS = 64


def key_of(*cols: Column | str) -> Column:
    """A null-safe key: a struct never is null, so nulls group and join with each other."""
    return F.struct(*cols)


def hot_keys(counts: DataFrame, n: str) -> DataFrame:
    """The keys with more than HOT_SHARE of all rows, of a table with one row and a count per key.

    The result has fewer than 1 / HOT_SHARE rows whatever the data, so it may be broadcast.
    """
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0))).scalar()
    return counts.where(F.col(n) > total * HOT_SHARE)


def chunked_neighbour(df: DataFrame, keys: list[str], order: str, out: str, previous: bool = True, chunks: int = SALTS, carry: str | None = None) -> DataFrame:
    """df with the previous (or next) value of order among the rows of the same keys, in out; null where there is none.

    df must have one row for each keys and order; order is a number without null. With carry, out is a struct of order
    and that column of the neighbour. Rows of a key with more than HOT_SHARE of all rows are cut into at most chunks parts
    between quantiles of order, wherever its values lie; neighbours are found inside a part, and the first row of a part takes
    its neighbour from the ends of the parts, of which there are at most chunks for each of the fewer than 1 / HOT_SHARE
    hot keys. So no task needs all rows of a hot key.
    """
    names = {k: f"_k{n}" for n, k in enumerate(keys)}
    same = lambda other: [F.col(k).eqNullSafe(other[c]) for k, c in names.items()]
    value = F.struct(F.col(order).alias(order), *([F.col(carry).alias(carry)] if carry else []))
    hot = hot_keys(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "_n").select(*[F.col(k).alias(c) for k, c in names.items()])
    in_hot = df.join(F.broadcast(hot), same(hot), "left_semi")
    shares = F.array(*[F.lit(n / chunks) for n in range(1, chunks)])
    edges = in_hot.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(order, shares, 10_000)).alias("_edges"))
    edges = edges.select(*[F.col(k).alias(c) for k, c in names.items()], "_edges")
    part = F.coalesce(F.size(F.filter("_edges", lambda e: e < F.col(order))), F.lit(0))
    cut = df.join(F.broadcast(edges), same(edges), "left").withColumns({"_part": part, "_hot": F.col("_edges").isNotNull()}).drop("_edges", *names.values())
    # Of each part of a hot key the row that the next part looks back to (or ahead).
    ends = cut.where("_hot").groupBy(*keys, "_part").agg((F.max_by if previous else F.min_by)(value, order).alias("_end"))
    over = Window.partitionBy(*keys).orderBy("_part" if previous else F.desc("_part"))
    ends = ends.select(*[F.col(k).alias(c) for k, c in names.items()], F.col("_part").alias("_p"), F.lag("_end").over(over).alias("_outer"))
    inner = Window.partitionBy(*keys, "_part").orderBy(order if previous else F.desc(order))
    near = cut.withColumn("_near", F.lag(value).over(inner))
    joined = near.join(F.broadcast(ends), [*same(ends), F.col("_part") == F.col("_p")], "left")
    found = F.coalesce("_near", "_outer")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (found if carry else found[order]).alias(out))

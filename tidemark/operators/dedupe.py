"""Exactly one copy of messages that were delivered more than once (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.scale import SALTS, hot_keys


def split_copies(messages: DataFrame, keys: list[str], order: list[str], firsts: bool = False) -> DataFrame:
    """messages with a last column _copy: 0 for the one copy that stays, else positive. With firsts only the former come out.

    The identifiers' frequencies are aggregated first (with map-side combine). Rows of singletons pass; only rows of
    repeated identifiers are ranked. An identifier with more than HOT_SHARE of all rows is ranked in SALTS parts,
    then the parts' first rows among themselves, so no task ever holds all its rows.

    Copies are ordered by order, smallest first, nulls last; full ties are broken arbitrarily, one row stays.
    A null in any key means that the row has no identifier: it is no copy of anything, and stays.
    An empty table gives an empty table. Any other columns are kept, whatever their names.
    """
    names = messages.columns
    place = {n: f"c{i}" for i, n in enumerate(names)}
    rows = messages.toDF(*place.values()) if len(place) == len(names) else messages.toDF(*[f"c{i}" for i in range(len(names))])
    k, o = [place[n] for n in keys], [place[n] for n in order]
    known = F.lit(True)
    for c in k:
        known &= F.col(c).isNotNull()
    counts = rows.where(known).groupBy(*k).agg(F.count(F.lit(1)).alias("n"))
    hot = F.broadcast(hot_keys(counts, "n").select(*[F.col(c).alias(f"h_{c}") for c in k], F.lit(True).alias("hot")))
    spread = F.expr(f"pmod(xxhash64({', '.join(o)}), {SALTS})").cast("int")
    salted = rows.where(known).join(hot, [F.col(c) == F.col(f"h_{c}") for c in k], "left").drop(*[f"h_{c}" for c in k])
    salted = salted.withColumn("salt", F.when(F.col("hot"), spread).otherwise(F.lit(0))).drop("hot")
    # A repeated identifier is looked up by (keys, salt); a hot one is there once for each salt, all others once.
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    repeated = counts.where("n > 1").join(hot, [F.col(c) == F.col(f"h_{c}") for c in k], "left")
    repeated = repeated.select(*[F.col(c).alias(f"r_{c}") for c in k], "n", F.explode(salts).alias("r_salt"))
    marked = salted.join(repeated, [F.col(c) == F.col(f"r_{c}") for c in k] + [F.col("salt") == F.col("r_salt")], "left")
    marked = marked.drop("r_salt", *[f"r_{c}" for c in k])

    by = [F.col(c).asc_nulls_last() for c in o]
    single = marked.where("n IS NULL").withColumn("copy", F.lit(0))
    ranked = marked.where("n IS NOT NULL").withColumn("copy", F.row_number().over(Window.partitionBy(*k, "salt").orderBy(*by)) - 1)
    later = ranked.where("copy > 0")
    first = ranked.where("copy = 0").withColumn("copy", F.row_number().over(Window.partitionBy(*k).orderBy(*by)) - 1)
    out = [*rows.columns, "copy"]
    kept = single.select(*out).unionByName(first.where("copy = 0").select(*out) if firsts else later.select(*out).unionByName(first.select(*out)))
    return kept.unionByName(rows.where(~known).withColumn("copy", F.lit(0)).select(*out)).toDF(*names, "_copy")


def deduplicate(new: DataFrame, keys: list[str], order: list[str], stored: DataFrame | None = None) -> DataFrame:
    """The rows of stored and new without copies: one row for each identifier, stored ones first.

    Without stored: of each identifier the first row of new by order. With stored (same columns, already without
    copies): all stored rows, and the first new row of each identifier that is not stored.
    """
    names = new.columns
    inner = [f"c{i}" for i in range(len(names))]
    place = dict(zip(names, inner))
    rows = new.toDF(*inner)
    if stored is not None:
        old = stored.select(*[F.col(f"`{n}`") for n in names]).toDF(*inner)
        rows = old.withColumn("age", F.lit(0)).unionByName(rows.withColumn("age", F.lit(1)))
    by = [place[c] for c in order]
    one = split_copies(rows, [place[c] for c in keys], by if stored is None else ["age", *by], firsts=True)
    return one.select(*inner).toDF(*names)

"""Processing only new or changed records of a log, each exactly once (problem 1).

A run has three steps, all kept below one state folder on shared storage:

1. plan: a write-ahead batch plan, plans/N: for each partition of the log the position (an exclusive lower offset)
   and the lowest and highest offset seen; in plans/N-acknowledged what a reader outside has acknowledged, if there is one;
   and in plans/N.json the arrival bound up to which the log was read. The JSON file is created only after the tables are
   complete, with put-if-absent, so a plan exists whole or not at all.
2. apply: the records that the plan names are written to sink/batch=N, without those that the sink already has by
   partition and offset. Only the plan decides which, so a second try leaves the same rows, whatever was acknowledged since.
3. commit: commits/N.json.

A plan without a commit is replayed before anything new is planned: its bounds are fixed, so records that came in
between wait for the next batch. A failure between any two steps neither skips nor repeats a record.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.dedupe import deduplicate
from tidemark.sources.storage import Storage


class Capture:
    """Incremental reader of a log with partitions, offsets and an arrival number.

    partition and offset are the columns that identify a record (deliveries of one record share them), arrival is a
    unique, rising number of each delivery. Rows whose offset is null are no records and are skipped; a null
    partition is a partition of its own. The log may be empty, and may have any further columns; they are kept.
    """

    def __init__(self, spark: SparkSession, state: str, partition: str, offset: str, arrival: str):
        self.spark, self.state, self.store = spark, state.rstrip("/"), Storage(spark)
        self.partition, self.offset, self.arrival = partition, offset, arrival

    # -- state -----------------------------------------------------------------------------------------------------

    def _numbers(self, kind: str) -> list[int]:
        names = (p.rsplit("/", 1)[1] for p, *_ in self.store.list(f"{self.state}/{kind}"))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def pending(self) -> int | None:
        """The number of a plan that was written but not committed."""
        left = sorted(set(self._numbers("plans")) - set(self._numbers("commits")))
        return left[0] if left else None

    def sink(self, batches: list[int] | None = None) -> DataFrame | None:
        """The rows of the committed batches (or of those named), or None if there are none."""
        batches = self._numbers("commits") if batches is None else batches
        return self.spark.read.parquet(*[f"{self.state}/sink/batch={n}" for n in batches]) if batches else None

    # -- steps -----------------------------------------------------------------------------------------------------

    def plan(self, log: DataFrame, positions: DataFrame | None = None, acknowledged: DataFrame | None = None) -> int:
        """Write the next batch's plan and return its number.

        positions (partition, position): the offset up to which a reader outside has taken each partition; without
        it the positions are those up to which earlier batches of this state went, and only deliveries that
        arrived since are read. acknowledged (partition, offset): with it, records at or below the position that are
        not acknowledged are taken too.
        """
        n = max(self._numbers("plans"), default=0) + 1
        since = None if positions is not None or n == 1 else json.loads(self.store.read_text(f"{self.state}/plans/{n - 1}.json"))["until"]
        fresh = log if since is None else log.where(F.col(self.arrival) > since)
        until = fresh.agg(F.max(self.arrival)).head()[0]
        if until is None:
            until = since if since is not None else -1
        p = F.col(self.partition)
        ranges = fresh.where(F.col(self.arrival) <= until).where(F.col(self.offset).isNotNull())
        ranges = ranges.groupBy(p).agg(F.min(self.offset).alias("_first"), F.max(self.offset).alias("_until"))
        if positions is None:
            ranges = ranges.withColumn("_from", F.lit(None).cast("bigint"))
        else:
            at = positions.select(F.col(self.partition).alias("_p"), F.col("position").alias("_from"))
            ranges = ranges.join(at, p.eqNullSafe(F.col("_p")), "left").drop("_p")
        path = f"{self.state}/plans/{n}"
        ranges.write.mode("overwrite").parquet(path)
        if acknowledged is not None:
            acknowledged.select(F.col(self.partition).alias("ap"), F.col(self.offset).alias("ao")).distinct().write.mode("overwrite").parquet(f"{path}-acknowledged")
        if not self.store.put_if_absent(f"{path}.json", json.dumps({"batch": n, "since": since, "until": until, "acknowledged": acknowledged is not None})):
            raise RuntimeError(f"another writer has planned batch {n}")
        return n

    def apply(self, n: int, log: DataFrame) -> None:
        """Write the records of plan n to the sink; safe to repeat.

        A record is taken if it is above its partition's position, if there is no position, or if the plan has
        acknowledgements and none for it. What an earlier committed batch of the sink holds is not taken again, also while
        it waits for its acknowledgement.
        """
        plan = json.loads(self.store.read_text(f"{self.state}/plans/{n}.json"))
        planned = self.spark.read.parquet(f"{self.state}/plans/{n}")
        ranges = planned.select(F.col(self.partition).alias("q"), F.col("_from").alias("low"), F.col("_until").alias("high"))
        names = log.columns
        place = {name: f"c{i}" for i, name in enumerate(names)}
        rows = log.toDF(*place.values())
        p, o, a = (F.col(place[c]) for c in (self.partition, self.offset, self.arrival))
        rows = rows.where(o.isNotNull() & (a <= plan["until"]))
        if plan["since"] is not None:
            rows = rows.where(a > plan["since"])
        # Most of a long log lies below the positions and goes here, before anything is told apart. The plan has one row for
        # each partition; its files' size says whether it is broadcast, else the join shuffles and skewed parts are split.
        rows = rows.join(ranges, p.eqNullSafe(F.col("q")) & (o <= F.col("high"))).drop("q", "high")
        above = F.col("low").isNull() | (o > F.col("low"))
        if plan.get("acknowledged"):
            acks = self.spark.read.parquet(f"{self.state}/plans/{n}-acknowledged").withColumn("acked", F.lit(True))
            rows = rows.join(acks, p.eqNullSafe(F.col("ap")) & (o == F.col("ao")), "left").where(above | F.col("acked").isNull())
        else:
            rows = rows.where(above)
        rows = rows.select(*place.values())
        # A null partition is one like others, so the records are told apart by a hash beside a mark for null; a hot
        # partition has many offsets but no offset many rows.
        marked = rows.withColumns({"hash": F.coalesce(F.xxhash64(p), F.lit(0)), "null": p.isNull(), "text": F.coalesce(p.cast("string"), F.lit(""))})
        taken = deduplicate(marked, ["null", "hash", "text", place[self.offset]], [place[self.arrival]]).drop("hash", "null", "text")
        if (have := self.sink([k for k in self._numbers("commits") if k < n])) is not None:
            low, high = planned.agg(F.min("_first"), F.max("_until")).head()
            have = have.select(F.col(self.partition).alias("sp"), F.col(self.offset).alias("so"))
            if low is not None:  # offsets that this batch cannot have are skipped by the sink's statistics
                have = have.where(F.col("so").between(low, high))
            taken = taken.join(have, p.eqNullSafe(F.col("sp")) & (o == F.col("so")), "left_anti")
        taken.toDF(*names).write.mode("overwrite").parquet(f"{self.state}/sink/batch={n}")

    def commit(self, n: int) -> None:
        self.store.put_if_absent(f"{self.state}/commits/{n}.json", json.dumps({"batch": n}))

    def run(self, log: DataFrame, positions: DataFrame | None = None, acknowledged: DataFrame | None = None) -> DataFrame:
        """Replay a plan that was left over, if any; then plan, apply and commit one batch. The rows of that batch."""
        if (left := self.pending()) is not None:
            self.apply(left, log)
            self.commit(left)
        n = self.plan(log, positions, acknowledged)
        self.apply(n, log)
        self.commit(n)
        return self.sink([n])


def latest_positions(responses: DataFrame, partition: str, position: str, at: list[str]) -> DataFrame:
    """(partition, position) of each partition's latest response that names a position; later by at, then greater."""
    named = responses.where(F.col(position).isNotNull())
    latest = F.max_by(F.col(position), F.struct(*at))
    return named.groupBy(partition).agg(latest.alias("position"))



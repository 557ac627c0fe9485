"""Change streams merged into versioned tables, with transactions and durable sequence numbers per origin.

A message carries rows whose columns have roles: OLD_PK, NEW_PK, VALUE, and CHANGED flags of values. Messages wait in a
buffer per table; a flush composes a table's messages into one function of its rows (operators.patches), picks the files
that the touched keys can lie in, and rewrites those in one commit that also records origins and sequence numbers.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.patches import compose, layout_of
from tidemark.plans.log import CommitConflict, DataFile, VersionedTable
from tidemark.plans.pruning import bounds as bounds_of
from tidemark.plans.tokens import SqlError
from tidemark.session import cut

OLD_PK, NEW_PK, VALUE, CHANGED = "OLD_PK", "NEW_PK", "VALUE", "CHANGED"
#: When a buffer is written out, and how long a message waits for the writer.
MAX_LAG_S, MAX_BYTES, MAX_SYNCS_PER_TABLE, FLUSH_EVERY_S, LOCK_S = 600, 3 << 30, 100, 900, 3
#: Fixed value: messages of one transaction are put together in the buffer up to so many rows.
ITEM_ROWS = 100_000
#: With more rows in the files that ranges leave, files are picked key by key.
FINE_PRUNING_ROWS = 3_000_000
_FILES_PER_PASS = 200


@dataclass(frozen=True)
class Column:
    role: str
    name: str


class SyncSchema:
    """The roles of a message's columns, checked against its fields."""

    def __init__(self, descriptors: list[Column], fields: list[T.StructField]):
        if len(descriptors) != len(fields):
            raise SqlError("Column descriptors do not match the schema")
        self.pairs = list(zip(descriptors, fields))
        names = {r: [d.name for d, _ in self.pairs if d.role == r] for r in (OLD_PK, NEW_PK, VALUE, CHANGED)}
        for d, f in self.pairs:
            if d.role not in names:
                raise SqlError(f"Unknown column role {d.role}")
            if d.role == CHANGED and (not isinstance(f.dataType, T.BooleanType) or d.name not in names[VALUE]):
                raise SqlError("Changed column must be boolean type and point to an existing value column")
        old = {(d.name, f.dataType) for d, f in self.pairs if d.role == OLD_PK}
        new = {(d.name, f.dataType) for d, f in self.pairs if d.role == NEW_PK}
        if not new:
            raise SqlError("Change requested but batches do not contain old/new PK columns")
        if old != new:
            raise SqlError("Old and new PKs must contain the same columns")
        self.keys = sorted(names[NEW_PK])
        self.values = sorted(names[VALUE])

    def field(self, role: str, name: str) -> T.StructField | None:
        return next((f for d, f in self.pairs if d.role == role and d.name == name), None)

    def storage(self) -> T.StructType:
        """The columns of a table that is made for these messages: keys, then values, in the message's order."""
        return T.StructType([T.StructField(d.name, f.dataType, True) for d, f in self.pairs if d.role in (NEW_PK, VALUE)])

    def changes(self, df: DataFrame, version: int) -> DataFrame:
        """df (its columns in the descriptors' order, then _row) in the form of operators.patches."""
        col = {(d.role, d.name): F.col(f"`{f.name}`") for d, f in self.pairs}
        text = lambda c: c.cast("string")

        def key(role: str):
            parts = [text(col[role, n]) for n in self.keys]
            return F.when(F.coalesce(*parts).isNotNull(), F.array(*parts))

        flags = [n for n in self.values if (CHANGED, n) in col]
        cells = [*(text(col[VALUE, n]) for n in self.values), *(text(col[CHANGED, n]) for n in flags)]
        layout = layout_of(self.values, {n: len(self.values) + k for k, n in enumerate(flags)})
        return df.select(
            F.lit("t").alias("tab"), F.lit(version).cast("bigint").alias("version"), F.lit(0).cast("bigint").alias("origin"), F.col("_row").alias("row_no"),
            key(OLD_PK).alias("old_key"), key(NEW_PK).alias("new_key"), F.lit(layout).alias("layout"), F.array(*cells).cast("array<string>").alias("cells"),
        )


@dataclass
class Transaction:
    origin: str
    sequence: int | None = None
    tables: set[str] = field(default_factory=set)  # not yet flushed


@dataclass
class Item:
    changes: DataFrame
    schema: SyncSchema
    rows: int
    transaction: Transaction
    at: float
    bytes: int = 0


@dataclass
class Reply:
    accepted: bool
    memory_sequence_number: int | None
    durable_sequence_number: int | None
    first: bool


class SyncWriter:
    """Buffers messages and writes them out; one writer at a time."""

    def __init__(self, spark: SparkSession, max_syncs: int = MAX_SYNCS_PER_TABLE, max_lag_s: float = MAX_LAG_S, max_bytes: int = MAX_BYTES, clock: Callable[[], float] = time.time):
        self.spark, self.max_syncs, self.max_lag_s, self.max_bytes, self.clock = spark, max_syncs, max_lag_s, max_bytes, clock
        self.items: dict[str, list[Item]] = {}
        self.transactions: list[Transaction] = []
        self.open: Transaction | None = None
        self.memory: dict[str, int] = {}
        self.durable: dict[str, int] = {}
        self.lock = threading.Lock()
        self.counter = 0
        self.metrics = {"requests": 0, "rows": 0, "flushes": 0, "rejected": 0}

    # -- messages --------------------------------------------------------------------------------------------------

    def put(self, path: str, df: DataFrame | None, descriptors: list[Column], origin: str, sequence: int | None = None, rows: int | None = None, format: str = "DELTA") -> Reply:
        """Take one message. A probe (no rows, no sequence number) only asks for the sequence numbers.

        The message's rows are in the order of df; a column _row, if df has one, gives it instead. Targets are versioned
        tables; Iceberg tables are refused.
        """
        if format.upper() != "DELTA" or path.endswith(".metadata.json"):
            raise SqlError(f"Change streams can't be written to tables of format {format.upper() if format.upper() != 'DELTA' else 'ICEBERG'}")
        first = origin not in self.memory and origin not in {t.origin for t in self.transactions}
        if not self.lock.acquire(timeout=LOCK_S):
            self.metrics["rejected"] += 1
            return Reply(False, self.memory.get(origin), self.durable.get(origin), first)
        try:
            self.metrics["requests"] += 1
            if df is not None and rows is None:
                rows = df.count()
            if not rows and sequence is None:
                return Reply(True, self.memory.get(origin), self.durable.get(origin), first)
            self._enqueue(path, df if rows else None, descriptors, origin, sequence, rows or 0)
            while (due := self._due()) is not None:
                self._flush(due)
            return Reply(True, self.memory.get(origin), self.durable.get(origin), first)
        finally:
            self.lock.release()

    def _enqueue(self, path: str, df: DataFrame | None, descriptors: list[Column], origin: str, sequence: int | None, rows: int) -> None:
        if self.open is not None and self.open.origin != origin:
            raise SqlError(f"Transaction from a new origin {origin} started while one from {self.open.origin} is open")
        if df is None and self.open is None:
            raise SqlError(f"Sequence number {sequence} of origin {origin} closes an empty transaction")
        if self.open is None:
            self.open = Transaction(origin)
            self.transactions.append(self.open)
        if df is not None:
            fields = [f for f in df.schema.fields if f.name != "_row"]
            schema = SyncSchema(descriptors, fields)
            if "_row" not in df.columns:
                # The id rises with the partition and the place in it, which is the order in which rows came.
                df = df.withColumn("_row", F.monotonically_increasing_id())
            self.counter += 1
            self._buffer(path, Item(schema.changes(df, self.counter), schema, rows, self.open, self.clock(), _bytes_of(df)))
            self.open.tables.add(path)
            self.metrics["rows"] += rows
        if sequence is not None:
            self.open.sequence = sequence
            self.memory[origin] = sequence
            self.open = None

    def _buffer(self, path: str, new: Item) -> None:
        """Add to a table's buffer: to its last item if that is of the same transaction and columns and stays within ITEM_ROWS."""
        items = self.items.setdefault(path, [])
        last = items[-1] if items else None
        if last and last.transaction is new.transaction and last.schema.pairs == new.schema.pairs and last.rows + new.rows <= ITEM_ROWS:
            last.changes, last.rows, last.bytes = last.changes.unionByName(new.changes), last.rows + new.rows, last.bytes + new.bytes
        else:
            items.append(new)

    def _due(self) -> str | None:
        """The table that has to be written out now, if any: too old, too much, or too many messages."""
        if not self.items:
            return None
        oldest = min(self.items, key=lambda p: self.items[p][0].at)
        if self.clock() - self.items[oldest][0].at >= self.max_lag_s:
            return oldest
        size = lambda p: sum(i.bytes for i in self.items[p])
        if sum(map(size, self.items)) >= self.max_bytes:
            return max(self.items, key=size)
        return next((p for p, i in self.items.items() if len(i) >= self.max_syncs), None)

    # -- writing out -----------------------------------------------------------------------------------------------

    def flush(self, path: str | None = None) -> None:
        """Write out a table, by default the one whose oldest message waits longest."""
        with self.lock:
            if self.items:
                self._flush(path or min(self.items, key=lambda p: self.items[p][0].at))

    def tick(self) -> int:
        """Write out every table that is due; how many there were. For a timer, so that old messages do not wait for new ones."""
        n = 0
        with self.lock:
            while (due := self._due()) is not None:
                self._flush(due)
                n += 1
        return n

    def run_in_background(self, every_s: float = FLUSH_EVERY_S) -> threading.Event:
        """Call tick at intervals until the event that is returned is set."""
        stop = threading.Event()

        def loop() -> None:
            while not stop.wait(every_s):
                self.tick()

        threading.Thread(target=loop, daemon=True).start()
        return stop

    def flush_all(self) -> None:
        while self.items:
            self.flush()

    def _flush(self, path: str) -> None:
        items = self.items[path]
        table = VersionedTable(self.spark, path)
        last = items[-1].transaction
        info = {"sync_commit_info": {"origin": last.origin, "sequence": last.sequence}}
        numbers: dict[str, int] = {}
        for t in (i.transaction for i in items if i.transaction.sequence is not None):
            numbers[t.origin] = max(t.sequence, numbers.get(t.origin, t.sequence))
        merge_changes(table, [(i.changes, i.schema) for i in items], info, numbers)
        del self.items[path]
        self.metrics["flushes"] += 1
        for t in {id(i.transaction): i.transaction for i in items}.values():
            t.tables.discard(path)
        # A number is durable once it is complete, all its tables are written, and so are all transactions before it.
        while self.transactions and self.transactions[0].sequence is not None and not self.transactions[0].tables:
            t = self.transactions.pop(0)
            self.durable[t.origin] = t.sequence


def _bytes_of(df: DataFrame) -> int:
    """The optimizer's size of a message; where it has none, that of a hundred bytes a row stands in."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 100


def recorded_sequence(table: VersionedTable, origin: str | None = None) -> tuple[str, int] | None:
    """(origin, sequence number) of the latest commit that recorded one, of any origin or of the one named."""
    if origin is not None:
        number = table.snapshot().writers.get(origin)
        return None if number is None else (origin, number)
    for v in reversed(table.versions()):
        for a in table.actions(v):
            info = a.get("commitInfo", {}).get("sync_commit_info")
            if info and info["sequence"] is not None:
                return info["origin"], info["sequence"]
    return None


def touched_files(function: DataFrame, keys: list[str], schema: T.StructType, files: list[DataFile], fine_rows: int = FINE_PRUNING_ROWS) -> list[DataFile]:
    """Files that may hold a row of a touched key: by the keys' ranges, and past fine_rows rows key by key."""
    kinds = [schema[k].dataType for k in keys]
    parts = F.explode(F.array_compact(F.array("key", "src")))
    times = {n for n, t in enumerate(kinds) if isinstance(t, T.TimestampType)}  # compared in UTC, without a zone
    every = function.select(parts.alias("k")).select(*[F.col("k")[i].cast(t).cast("timestamp_ntz" if i in times else t).alias(f"k{i}") for i, t in enumerate(kinds)])
    ends = every.agg(*[f(f"k{i}").alias(f"{n}{i}") for i in range(len(keys)) for n, f in (("lo", F.min), ("hi", F.max))]).head()

    def inside(f: DataFile, i: int) -> bool:
        low, high = bounds_of(f.stats, keys[i], kinds[i])
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        return None in (low, high, lo, hi) or low <= hi and high >= lo

    kept = [f for f in files if all(inside(f, i) for i in range(len(keys)))]
    if sum(f.stats.get("numRecords", 0) for f in kept) <= fine_rows:
        return kept
    hit: list[DataFile] = []
    for n in range(0, len(kept), _FILES_PER_PASS):
        part = kept[n : n + _FILES_PER_PASS]
        tests = []
        for j, f in enumerate(part):
            test = F.lit(True)
            for i, t in enumerate(kinds):
                low, high = bounds_of(f.stats, keys[i], t)
                if low is not None and high is not None:
                    test &= F.coalesce(F.col(f"k{i}").between(F.lit(low), F.lit(high)), F.lit(True))
            tests.append(F.max(test).alias(f"f{j}"))
        row = every.agg(*tests).head()
        hit += [f for j, f in enumerate(part) if row[j]]
    return hit


def merge_changes(table: VersionedTable, items: list[tuple[DataFrame, SyncSchema]], info: dict | None = None, numbers: dict[str, int] | None = None) -> None:
    """Apply messages, in order, to a table in one commit; the table is made if it is not there.

    numbers: the sequence number of each origin that the table holds with these messages; the commit records them.

    Columns that the table lacks are not stored; columns that no message sets keep their content.
    """
    if not table.versions():
        table.create(items[0][1].storage())
    columns = table.snapshot().schema
    keys = items[0][1].keys
    for _, schema in items:
        if schema.keys != keys:
            raise SqlError("Messages for one table have different keys")
    if any(k not in columns.names for k in keys):
        raise SqlError("The table lacks key columns of the messages")
    feed = items[0][0]
    for changes, _ in items[1:]:
        feed = feed.unionByName(changes)
    function = cut(compose(feed))

    for _ in range(20):
        s = table.snapshot()
        touched = touched_files(function, keys, columns, s.files)
        base = table.scan(s, touched)
        own = F.array(*[F.col(f"`{k}`").cast("string") for k in keys])
        kept = base.withColumn("_key", own)
        f = function.select(F.col("key").alias("_k"), "alive", "src", "patch")
        # Rows whose key is not touched stay typed as they are; moved rows are the source row with the patch over it.
        rest = kept.join(f.select("_k"), F.col("_key") == F.col("_k"), "left_anti").drop("_key")
        moved = f.where("alive").join(kept, F.col("src") == F.col("_key"), "left")
        made = []
        for c in columns.fields:
            if c.name in keys:
                made.append(F.col("_k")[keys.index(c.name)].cast(c.dataType).alias(c.name))
            else:
                has = F.array_contains(F.map_keys("patch"), c.name)
                made.append(F.when(has, F.try_element_at("patch", F.lit(c.name)).cast(c.dataType)).otherwise(F.col(f"`{c.name}`")).alias(c.name))
        try:
            table.rewrite(s, touched, rest.unionByName(moved.select(*made)), "SYNC", info, numbers)
            return
        except CommitConflict:
            continue
    raise CommitConflict(f"Too many concurrent writers of {table.path}")


def sync_stream(stream: DataFrame, path: str, descriptors: list[Column], origin: str, checkpoint: str):
    """A streaming query that merges each micro-batch into a table, effectively once.

    A micro-batch that is delivered again after a failure is skipped: the table's log keeps the last number of each origin,
    whatever other origins have written since.
    """

    def apply(batch: DataFrame, n: int) -> None:
        table = VersionedTable(batch.sparkSession, path)
        seen = recorded_sequence(table, origin) if table.versions() else None
        if seen is not None and seen[1] >= n:
            return
        schema = SyncSchema(descriptors, [f for f in batch.schema.fields if f.name != "_row"])
        if "_row" not in batch.columns:
            batch = batch.withColumn("_row", F.monotonically_increasing_id())
        merge_changes(table, [(schema.changes(batch, n), schema)], {"sync_commit_info": {"origin": origin, "sequence": n}}, {origin: n})

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["CHANGED", "Column", "NEW_PK", "OLD_PK", "SyncSchema", "SyncWriter", "VALUE", "merge_changes", "recorded_sequence", "sync_stream", "touched_files"]

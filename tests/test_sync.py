"""Change streams: message checks, transactions and durability, merging, pruning."""

from decimal import Decimal

import pytest
from pyspark.sql import types as T

from tidemark.plans.log import DataFile, VersionedTable
from tidemark.plans.tokens import SqlError
from tidemark.streaming import sync
from tidemark.streaming.sync import CHANGED, NEW_PK, OLD_PK, VALUE, Column, SyncSchema, SyncWriter, recorded_sequence, touched_files

KEYS = [Column(OLD_PK, "k"), Column(NEW_PK, "k")]


def field(name, kind):
    return T.StructField(name, T.StructType.fromDDL(f"c {kind}")[0].dataType)


def test_schema_checks(spark):
    k = [field("a", "int"), field("b", "int")]
    SyncSchema([*KEYS, Column(VALUE, "v"), Column(CHANGED, "v")], [*k, field("c", "string"), field("d", "boolean")])
    for descriptors, fields in (
        (KEYS, k[:1]),
        ([*KEYS, Column(CHANGED, "v")], [*k, field("d", "boolean")]),
        ([*KEYS, Column(VALUE, "v"), Column(CHANGED, "v")], [*k, field("c", "string"), field("d", "int")]),
        ([Column(VALUE, "v")], [field("c", "string")]),
        ([Column(OLD_PK, "k"), Column(NEW_PK, "j")], k),
        ([Column(OLD_PK, "k"), Column(NEW_PK, "k")], [field("a", "int"), field("b", "bigint")]),
    ):
        with pytest.raises(SqlError):
            SyncSchema(descriptors, fields)


class Bookkeeping(SyncWriter):
    """The writer without data: what is flushed is only forgotten."""

    def __init__(self, **k):
        super().__init__(None, **k)

    def _enqueue(self, path, df, descriptors, origin, sequence, rows):
        enough = self.open is not None or rows
        if self.open is not None and self.open.origin != origin or not enough:
            return super()._enqueue(path, None, descriptors, origin, sequence, rows)
        if self.open is None:
            self.open = sync.Transaction(origin)
            self.transactions.append(self.open)
        if rows:
            self.items.setdefault(path, []).append(sync.Item(None, None, rows, self.open, self.clock()))
            self.open.tables.add(path)
        if sequence is not None:
            self.open.sequence = self.memory[origin] = sequence
            self.open = None


@pytest.fixture
def book(monkeypatch):
    monkeypatch.setattr(sync, "merge_changes", lambda *a: None)
    monkeypatch.setattr(sync, "VersionedTable", lambda *a: None)
    ticks = iter(range(10**6))
    return Bookkeeping(clock=lambda: next(ticks) / 1000)


@pytest.mark.parametrize(
    ("messages", "durable"),
    [
        ([("T1", "A", None), ("T2", "A", 1), ("T3", "A", 2), ("T1", "A", None), ("T2", "A", 3)], [None, 1, 3]),
        ([("T1", "A", 1), ("T2", "A", 2)], [1, 2]),
        ([("T1", "A", 1), ("T1", "A", 2)], [2]),
        ([("T1", "A", None), ("T2", "A", None), ("T1", "A", 7)], [None, 7]),
    ],
)
def test_durability_follows_the_order_of_transactions(book, messages, durable):
    for path, origin, sequence in messages:
        book.put(path, None, [], origin, sequence, rows=1)
    got = []
    for _ in durable:
        book.flush()
        got.append(book.durable.get("A"))
    assert got == durable and not book.items


def test_transactions_of_two_origins(book):
    book.put("T", None, [], "A", 1, rows=1)
    book.put("T", None, [], "B", None, rows=1)
    with pytest.raises(SqlError, match="new origin"):
        book.put("T", None, [], "A", 2, rows=1)
    book.put("U", None, [], "B", 5, rows=1)
    book.flush("T")
    assert (book.durable.get("A"), book.durable.get("B")) == (1, None)
    book.flush("U")
    assert book.durable == {"A": 1, "B": 5}


def test_probes_and_empty_transactions(book):
    assert book.put("T", None, [], "A") == sync.Reply(True, None, None, True)
    with pytest.raises(SqlError, match="empty transaction"):
        book.put("T", None, [], "A", 3)
    book.put("T", None, [], "A", 4, rows=2)
    assert book.put("T", None, [], "A") == sync.Reply(True, 4, None, False)
    assert book.metrics["rows"] == 0 or book.metrics["requests"] == 4


def test_flush_triggers(book):
    book.max_syncs = 3
    for n in range(3):
        book.put("T", None, [], "A", n, rows=1)
    assert not book.items and book.durable == {"A": 2}
    book.max_lag_s = 0
    book.put("T", None, [], "A", 9, rows=1)
    assert book.durable == {"A": 9}


def test_a_timer_writes_out_old_messages(book):
    book.put("T", None, [], "A", 1, rows=1)
    assert book.tick() == 0
    book.max_lag_s = 0
    stop = book.run_in_background(0.01)
    import time

    until = time.time() + 5
    while book.items and time.time() < until:
        time.sleep(0.01)
    stop.set()
    assert book.durable == {"A": 1}


def test_a_busy_writer_refuses(book, monkeypatch):
    monkeypatch.setattr(sync, "LOCK_S", 0.01)
    book.lock.acquire()
    assert book.put("T", None, [], "A", 1, rows=1).accepted is False
    book.lock.release()
    assert book.metrics["rejected"] == 1


def test_messages_in_two_flushes(spark, folder):
    pair = [Column(OLD_PK, "a"), Column(OLD_PK, "b"), Column(NEW_PK, "a"), Column(NEW_PK, "b")]
    w, n = SyncWriter(spark), None
    first = spark.createDataFrame([(n, n, 1, "p", 0.5, "left", True, 0), (n, n, 2, "q", 1.5, "right", False, 1), (n, n, 3, "r", 2.5, n, True, 2)], "w int, x string, y int, z string, u double, v string, f boolean, _row bigint")
    w.put(folder, first, [*pair, Column(VALUE, "u"), Column(VALUE, "v"), Column(CHANGED, "v")], "7", None)
    second = spark.createDataFrame([(1, "p", 1, "pp", "up", 0), (1, "pp", 9, "pp", "down", 1), (3, "r", n, n, n, 2), (n, n, 4, "s", "new", 3)], "w int, x string, y int, z string, v string, _row bigint")
    w.put(folder, second, [*pair, Column(VALUE, "v")], "7", 510)
    w.flush(folder)
    t = VersionedTable(spark, folder)
    assert sorted((tuple(r) for r in t.scan().select("a", "b", "u", "v").collect()), key=str) == [(2, "q", 1.5, None), (4, "s", None, "new"), (9, "pp", 0.5, "down")]
    assert recorded_sequence(t) == ("7", 510) == recorded_sequence(t, "7") and recorded_sequence(t, "8") is None


def test_decimal_keys_are_compared_as_numbers(spark, folder):
    def message(rows):
        return spark.createDataFrame([(*(None if x is None else Decimal(x) for x in r[:2]), r[2], k) for k, r in enumerate(rows)], "a decimal(10,2), b decimal(10,2), v string, _row bigint")

    w, columns = SyncWriter(spark), [*KEYS, Column(VALUE, "v")]
    for n, rows in enumerate(([(None, "9.00", "a"), (None, "9.50", "b")], [("9.00", "9.00", "c"), (None, "10.00", "d")])):
        w.put(folder, message(rows), columns, "1", n)
        w.flush_all()
    assert sorted((str(r.k), r.v) for r in VersionedTable(spark, folder).scan().collect()) == [("10.00", "d"), ("9.00", "c"), ("9.50", "b")]


def test_every_origin_keeps_its_number(spark, folder):
    w, columns = SyncWriter(spark), [*KEYS, Column(VALUE, "v")]
    for origin, sequence, k in (("A", 5, 1), ("B", 3, 2)):
        w.put(folder, spark.createDataFrame([(None, k, "x", 0)], "a int, b int, v string, _row bigint"), columns, origin, sequence)
        w.flush_all()
    t = VersionedTable(spark, folder)
    assert recorded_sequence(t, "A") == ("A", 5) and recorded_sequence(t, "B") == ("B", 3) and recorded_sequence(t) == ("B", 3)
    for n in range(12):  # past a checkpoint of the log
        w.put(folder, spark.createDataFrame([(2, 2, str(n), 0)], "a int, b int, v string, _row bigint"), columns, "B", 4 + n)
        w.flush_all()
    for v in range(9):
        t.store.delete(f"{folder}/_delta_log/{v:020d}.json")
    assert recorded_sequence(VersionedTable(spark, folder), "A") == ("A", 5)


def test_messages_of_a_transaction_are_put_together(spark, folder, monkeypatch):
    monkeypatch.setattr(sync, "ITEM_ROWS", 3)
    w, columns = SyncWriter(spark), [*KEYS, Column(VALUE, "v")]
    one = lambda k: spark.createDataFrame([(None, k, "x", 0)], "a int, b int, v string, _row bigint")
    for k in range(5):
        w.put(folder, one(k), columns, "A", 1 if k == 4 else None)
    w.put(folder, one(9), columns, "A", 2)
    assert [i.rows for i in w.items[folder]] == [3, 2, 1]
    w.flush_all()
    assert sorted(r.k for r in VersionedTable(spark, folder).scan().collect()) == [0, 1, 2, 3, 4, 9]
    with pytest.raises(SqlError, match="ICEBERG"):
        w.put(folder, one(1), columns, "A", 3, format="ICEBERG")


def test_decimals_survive(spark, folder):
    big = [Decimal(f"{s}{'9' * n}E-6") for s in ("", "-") for n in (38, 37, 36)]
    df = spark.createDataFrame([(None, n, v, n) for n, v in enumerate(big)], "a int, b int, v decimal(38,6), _row bigint")
    w = SyncWriter(spark)
    w.put(folder, df, [*KEYS, Column(VALUE, "v")], "1", 1)
    w.flush_all()
    assert [r.v for r in VersionedTable(spark, folder).scan().orderBy("k").collect()] == big


def test_flags_are_kept_over_later_messages_without_them(spark, folder):
    """A flagged change is not lost when a later message for the row has neither the value nor its flag."""
    w = SyncWriter(spark)
    x = [*KEYS, Column(VALUE, "x"), Column(CHANGED, "x")]
    w.put(folder, spark.createDataFrame([(None, 1, "a", True, 0)], "o int, n int, x string, f boolean, _row bigint"), x, "1", 1)
    w.flush_all()
    w.put(folder, spark.createDataFrame([(1, 1, "b", True, 0)], "o int, n int, x string, f boolean, _row bigint"), x, "1", 2)
    w.put(folder, spark.createDataFrame([(1, 1, 0)], "o int, n int, _row bigint"), KEYS, "1", 3)
    w.flush_all()
    assert [tuple(r) for r in VersionedTable(spark, folder).scan().collect()] == [(1, "b")]


def test_file_pruning(spark):
    schema = "tab string, key array<string>, alive boolean, src array<string>, patch map<string,string>, version bigint"
    function = spark.createDataFrame([("t", ["40", "bb"], True, ["75", "cc"], {}, 1)], schema)
    columns = T.StructType.fromDDL("c1 int, c2 string")
    files = [DataFile(str(n), 1, {"numRecords": 10, "minValues": lo, "maxValues": hi}) for n, (lo, hi) in enumerate([({"c1": 70, "c2": "aa"}, {"c1": 90, "c2": "rr"}), ({"c1": 30, "c2": "x"}, {"c1": 45, "c2": "z"}), ({"c2": "b"}, {"c2": "c"}), ({"c1": 50, "c2": "a"}, {"c1": 60, "c2": "z"}), ({"c1": 1, "c2": "a"}, {"c1": 2, "c2": "z"})])]
    assert [f.path for f in touched_files(function, ["c1", "c2"], columns, files)] == ["0", "2", "3"]
    assert [f.path for f in touched_files(function, ["c1", "c2"], columns, files, fine_rows=5)] == ["0", "2"]

"""Queries that run statements on a scratch database: changes, versions, change streams, sources and sinks."""

from __future__ import annotations

import sqlite3
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from tidemark.plans.engine import Engine
from tidemark.session import scratch
from tidemark.sources.storage import Storage
from tidemark.streaming.sync import CHANGED, NEW_PK, OLD_PK, VALUE, Column, SyncWriter, sync_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def loaded(spark: SparkSession, sf_dir: str, *tables: str) -> Engine:
    """A new database on shared storage with external tables over the test data."""
    e = Engine(spark, scratch(spark, "db"))
    for t in tables:
        e.sql(f"CREATE EXTERNAL TABLE {t} STORED AS PARQUET LOCATION '{sf_dir}/{t}.parquet'")
    return e


def script(name: str, sql: str, statements: str, tables: tuple[str, ...] = ("orders",)) -> None:
    """A query that runs statements on a scratch database; the last one gives the rows."""
    QUERIES[name] = lambda spark, sf_dir: loaded(spark, sf_dir, *tables).sql(statements)
    SQL[name] = sql


_CTAS = "CREATE TABLE t AS SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS p, o_orderstatus AS s FROM staging.orders"
_BASE = "SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS p, o_orderstatus AS s FROM orders"

# -- sinks -------------------------------------------------------------------------------------------------------------

script("ctas_roundtrip", _BASE, f"{_CTAS}; SELECT * FROM t")
script("insert_partial_columns_null", f"SELECT k, NULL::BIGINT AS c, p, NULL::VARCHAR AS s FROM ({_BASE})", "CREATE TABLE t (k BIGINT, c BIGINT, p DOUBLE, s TEXT); INSERT INTO t (p, k) SELECT o_totalprice, o_orderkey FROM staging.orders; SELECT * FROM t")
script("insert_select_append", f"{_BASE} UNION ALL SELECT k + 1, c, p, 'X' FROM ({_BASE}) WHERE p > 200000", f"{_CTAS}; INSERT INTO t SELECT k + 1, c, p, 'X' FROM t WHERE p > 200000; SELECT * FROM t")
script("create_table_types", "SELECT o_orderkey::INT AS a, o_custkey AS b, o_totalprice::DECIMAL(38,10)::DOUBLE AS c, o_orderdate AS d, o_orderstatus AS e, true AS f FROM orders",
    "CREATE TABLE t (a INT4, b INT8, c NUMERIC, d TIMESTAMP, e VARCHAR(3), f BOOL NOT NULL); INSERT INTO t SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderstatus, true FROM staging.orders; SELECT a, b, c::DOUBLE PRECISION AS c, d, e, f FROM t")


@query("copy_to_parquet_roundtrip", _BASE)
def _(spark, sf_dir):
    e = loaded(spark, sf_dir, "orders")
    at = f"{e.root}/copied"
    e.sql(f"{_CTAS}; COPY t TO '{at}' STORED AS PARQUET PARTITIONED BY (s); CREATE EXTERNAL TABLE back STORED AS PARQUET LOCATION '{at}'")
    return e.sql("SELECT k, c, p, s FROM staging.back")


@query("csv_external_roundtrip", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def _(spark, sf_dir):
    e = loaded(spark, sf_dir, "customer")
    at = f"{e.root}/customer.csv"
    e.sql(f"COPY (SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM staging.customer) TO '{at}'; CREATE EXTERNAL TABLE back (c_custkey BIGINT, c_name TEXT, c_acctbal DOUBLE, c_mktsegment TEXT) STORED AS CSV OPTIONS('format.has_header' 'true') LOCATION '{at}'")
    return e.sql("SELECT * FROM staging.back")


@query("ndjson_external_roundtrip", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def _(spark, sf_dir):
    e = loaded(spark, sf_dir, "nation")
    e.sql(f"COPY (SELECT n_nationkey, n_name FROM staging.nation) TO '{e.root}/nation.json'; CREATE EXTERNAL TABLE back STORED AS NDJSON LOCATION '{e.root}/nation.json'")
    return e.sql("SELECT n_nationkey, n_name FROM staging.back")


@query("upload_creates_table", "SELECT s_suppkey, s_name, s_acctbal FROM supplier UNION ALL SELECT s_suppkey, NULL, NULL FROM supplier")
def _(spark, sf_dir):
    e = loaded(spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    e.upload("fresh", "suppliers", rows.select("s_suppkey", "s_name", "s_acctbal"))
    e.upload("fresh", "suppliers", rows.select(F.col("s_suppkey").cast("string").alias("s_suppkey")))
    return e.sql("SELECT * FROM fresh.suppliers")


# -- changes -----------------------------------------------------------------------------------------------------------

script("update_where", f"SELECT k, CASE WHEN p > 100000 THEN c + 1 ELSE c END AS c, CASE WHEN p > 100000 THEN p * 2 ELSE p END AS p, s FROM ({_BASE})", f"{_CTAS}; UPDATE t SET c = c + 1, p = p * 2 WHERE p > 100000; SELECT * FROM t")
script("update_case_all", f"SELECT k, c, p, CASE WHEN s = 'F' THEN 'done' ELSE s END AS s FROM ({_BASE})", f"{_CTAS}; UPDATE t SET s = CASE WHEN s = 'F' THEN 'done' ELSE s END; SELECT * FROM t")
script("update_duplicate_assignment", f"SELECT k, c + 2 AS c, p, s FROM ({_BASE})", f"{_CTAS}; UPDATE t SET c = c + 1, c = c + 2; SELECT * FROM t")
script("update_no_match", _BASE, f"{_CTAS}; UPDATE t SET c = 0 WHERE k < -5; SELECT * FROM t")
script("delete_where", f"SELECT * FROM ({_BASE}) WHERE NOT (c % 3 = 0 AND p > 50000)", f"{_CTAS}; DELETE FROM t WHERE c % 3 = 0 AND p > 50000; SELECT * FROM t")
script("delete_null_predicate", "SELECT event_id, value FROM events WHERE NOT coalesce(value > 50, false)", "CREATE TABLE t AS SELECT event_id, value FROM staging.events; DELETE FROM t WHERE value > 50; SELECT * FROM t", ("events",))
script("delete_string_match", f"SELECT * FROM ({_BASE}) WHERE s <> 'F'", f"{_CTAS}; DELETE FROM t WHERE s = 'F'; SELECT * FROM t")
script("delete_all", "SELECT 0::BIGINT AS n", f"{_CTAS}; DELETE FROM t; SELECT count(*) AS n FROM t")
script("truncate", "SELECT 0::BIGINT AS n, 3::BIGINT AS versions", f"{_CTAS}; TRUNCATE TABLE t; SELECT (SELECT count(*) FROM t) AS n, count(*) AS versions FROM system.table_versions")
script("rename_table", f"SELECT count(*) AS n FROM ({_BASE})", f"{_CTAS}; CREATE SCHEMA other; ALTER TABLE t RENAME TO other.u; SELECT count(*) AS n FROM other.u")
script("drop_schema", "SELECT 0::BIGINT AS n", f"CREATE SCHEMA other; {_CTAS.replace('TABLE t', 'TABLE other.t')}; DROP SCHEMA other; SELECT count(*) AS n FROM information_schema.tables WHERE table_schema = 'other'")
script("create_database", "SELECT 1::BIGINT AS n", "CREATE DATABASE d2; CREATE TABLE d2.public.t AS VALUES (1, 'x'); SELECT count(*) AS n FROM d2.public.t")


# -- versions ------------------------------------------------------------------------------------------------------------


def _versions(spark: SparkSession, sf_dir: str, source: str = "nation", key: str = "n_nationkey", some: Callable[[int], str] = lambda n: f"n_nationkey >= {n * 5}") -> tuple[Engine, list[str]]:
    """A table with three appends, and for each version an instant at which it was the newest."""
    import time
    from datetime import datetime, timezone

    e, at = loaded(spark, sf_dir, source), []
    for n, sql in enumerate([f"CREATE TABLE t AS SELECT {key} AS k, 1 AS v FROM staging.{source}"] + [f"INSERT INTO t SELECT {key}, {n} FROM staging.{source} WHERE {some(n)}" for n in (2, 3)]):
        e.sql(sql)
        time.sleep(0.005)
        at.append(datetime.now(timezone.utc).isoformat())
        time.sleep(0.005)
    return e, at


@query("time_travel_version", "SELECT n_nationkey AS k, 1 AS v FROM nation UNION ALL SELECT n_nationkey, 2 FROM nation WHERE n_nationkey >= 10")
def _(spark, sf_dir):
    e, at = _versions(spark, sf_dir)
    return e.sql(f"SELECT * FROM t('{at[1]}')")


@query("time_travel_except", "SELECT n_nationkey AS k, 3 AS v FROM nation WHERE n_nationkey >= 15")
def _(spark, sf_dir):
    e, at = _versions(spark, sf_dir)
    return e.sql(f"WITH new AS (SELECT * FROM t), old AS (SELECT * FROM t('{at[1]}')) SELECT * FROM new EXCEPT SELECT * FROM old")


@query("ctas_time_travel", "SELECT n_nationkey AS k, 1 AS v FROM nation UNION ALL SELECT n_nationkey, 3 FROM nation WHERE n_nationkey >= 15")
def _(spark, sf_dir):
    e, at = _versions(spark, sf_dir)
    return e.sql(f"CREATE TABLE d AS SELECT * FROM t EXCEPT SELECT * FROM t('{at[1]}'); INSERT INTO d SELECT * FROM t('{at[0]}'); SELECT * FROM d")


@query("vacuum_versions", "SELECT 1::BIGINT AS versions, 24::BIGINT AS n, true AS files_gone")
def _(spark, sf_dir):
    e = loaded(spark, sf_dir, "nation")
    e.sql("CREATE TABLE t AS SELECT n_nationkey AS k FROM staging.nation; DELETE FROM t WHERE k = 3")
    table = e.table("t")
    gone = table.snapshot().gone
    e.sql("VACUUM TABLE t")
    deleted = not any(table.store.exists(table.absolute(p)) for p in gone)
    return e.sql(f"SELECT (SELECT count(*) FROM system.table_versions) AS versions, count(*) AS n, {str(deleted).lower()} AS files_gone FROM t")


@query("convert_parquet", "SELECT r_regionkey, r_name FROM region")
def _(spark, sf_dir):
    e = loaded(spark, sf_dir, "region")
    spark.read.parquet(f"{sf_dir}/region.parquet").repartition(3).write.parquet(f"{e.root}/7fbfeeeb-ade6-4238-89ab-4d4c5d9dd2b4")
    return e.sql("CONVERT '7fbfeeeb-ade6-4238-89ab-4d4c5d9dd2b4' TO DELTA r; CONVERT '7fbfeeeb-ade6-4238-89ab-4d4c5d9dd2b4' TO DELTA r; SELECT r_regionkey, r_name FROM r")


@query("external_versioned_table", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 4")
def _(spark, sf_dir):
    e = loaded(spark, sf_dir, "nation")
    e.sql("CREATE TABLE t AS SELECT n_nationkey AS k FROM staging.nation; DELETE FROM t WHERE k <= 4")
    e.sql(f"CREATE EXTERNAL TABLE x STORED AS DELTATABLE LOCATION '{e.table('t').path}'")
    return e.sql("SELECT k FROM staging.x")


@query("inline_metastore", "SELECT count(*) AS n FROM region")
def _(spark, sf_dir):
    e = loaded(spark, sf_dir, "region")
    e.sql("CREATE TABLE t AS SELECT * FROM staging.region")
    return e.with_metastore({"given.r": {"location": e.table("t").path, "format": "DELTA"}}).sql("SELECT count(*) AS n FROM given.r")


@query("iceberg_append", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 1")
def _(spark, sf_dir):
    from tidemark.sources.iceberg import create_table

    e = loaded(spark, sf_dir, "nation")
    made = create_table(spark, f"{e.root}/ice", spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").schema)
    c = e.with_metastore({"s.t": {"location": made.path, "format": "ICEBERG"}})
    c.sql("INSERT INTO s.t SELECT n_nationkey, n_name FROM staging.nation; INSERT INTO s.t SELECT n_nationkey + 100, n_name FROM staging.nation WHERE n_regionkey = 1")
    c.sql(f"CREATE EXTERNAL TABLE back STORED AS ICEBERG LOCATION '{e.root}/ice/metadata/v3.metadata.json'")
    return c.sql("SELECT n_nationkey, n_name FROM staging.back")


# The same on orders, which grows with the scale.


def _order_versions(spark: SparkSession, sf_dir: str) -> tuple[Engine, list[str]]:
    return _versions(spark, sf_dir, "orders", "o_orderkey", lambda n: f"o_orderkey % 4 >= {n}")


@query("time_travel_version_orders", "SELECT o_orderkey AS k, 1 AS v FROM orders UNION ALL SELECT o_orderkey, 2 FROM orders WHERE o_orderkey % 4 >= 2")
def _(spark, sf_dir):
    e, at = _order_versions(spark, sf_dir)
    return e.sql(f"SELECT * FROM t('{at[1]}')")


@query("time_travel_except_orders", "SELECT o_orderkey AS k, 3 AS v FROM orders WHERE o_orderkey % 4 >= 3")
def _(spark, sf_dir):
    e, at = _order_versions(spark, sf_dir)
    return e.sql(f"WITH new AS (SELECT * FROM t), old AS (SELECT * FROM t('{at[1]}')) SELECT * FROM new EXCEPT SELECT * FROM old")


@query("ctas_time_travel_orders", "SELECT o_orderkey AS k, 1 AS v FROM orders UNION ALL SELECT o_orderkey, 3 FROM orders WHERE o_orderkey % 4 >= 3")
def _(spark, sf_dir):
    e, at = _order_versions(spark, sf_dir)
    return e.sql(f"CREATE TABLE d AS SELECT * FROM t EXCEPT SELECT * FROM t('{at[1]}'); INSERT INTO d SELECT * FROM t('{at[0]}'); SELECT * FROM d")


@query("vacuum_versions_orders", "SELECT 1::BIGINT AS versions, count(*) AS n, true AS files_gone FROM orders WHERE o_orderkey % 7 <> 3")
def _(spark, sf_dir):
    e = loaded(spark, sf_dir, "orders")
    e.sql(f"{_CTAS}; DELETE FROM t WHERE k % 7 = 3")
    table = e.table("t")
    gone = table.snapshot().gone
    e.sql("VACUUM TABLE t")
    deleted = bool(gone) and not any(table.store.exists(table.absolute(p)) for p in gone)
    return e.sql(f"SELECT (SELECT count(*) FROM system.table_versions) AS versions, count(*) AS n, {str(deleted).lower()} AS files_gone FROM t")


@query("convert_parquet_orders", "SELECT o_orderkey, o_orderpriority FROM orders")
def _(spark, sf_dir):
    e = loaded(spark, sf_dir, "orders")
    spark.read.parquet(f"{sf_dir}/orders.parquet").write.option("maxRecordsPerFile", 1000).parquet(f"{e.root}/7fbfeeeb-ade6-4238-89ab-4d4c5d9dd2b4")
    return e.sql("CONVERT '7fbfeeeb-ade6-4238-89ab-4d4c5d9dd2b4' TO DELTA r; CONVERT '7fbfeeeb-ade6-4238-89ab-4d4c5d9dd2b4' TO DELTA r; SELECT o_orderkey, o_orderpriority FROM r")


@query("external_versioned_table_orders", "SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 5 <> 0")
def _(spark, sf_dir):
    e = loaded(spark, sf_dir, "orders")
    e.sql(f"{_CTAS}; DELETE FROM t WHERE k % 5 = 0")
    e.sql(f"CREATE EXTERNAL TABLE x STORED AS DELTATABLE LOCATION '{e.table('t').path}'")
    return e.sql("SELECT k FROM staging.x")


@query("iceberg_append_orders", "SELECT o_orderkey, o_orderpriority FROM orders UNION ALL SELECT o_orderkey + 1000000000000, o_orderpriority FROM orders WHERE o_orderkey % 4 = 1")
def _(spark, sf_dir):
    from tidemark.sources.iceberg import create_table

    e = loaded(spark, sf_dir, "orders")
    made = create_table(spark, f"{e.root}/ice", spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority").schema)
    c = e.with_metastore({"s.t": {"location": made.path, "format": "ICEBERG"}})
    c.sql("INSERT INTO s.t SELECT o_orderkey, o_orderpriority FROM staging.orders; INSERT INTO s.t SELECT o_orderkey + 1000000000000, o_orderpriority FROM staging.orders WHERE o_orderkey % 4 = 1")
    c.sql(f"CREATE EXTERNAL TABLE back STORED AS ICEBERG LOCATION '{e.root}/ice/metadata/v3.metadata.json'")
    return c.sql("SELECT o_orderkey, o_orderpriority FROM staging.back")


@query("ndjson_external_roundtrip_orders", "SELECT o_orderkey, o_orderpriority FROM orders")
def _(spark, sf_dir):
    e = loaded(spark, sf_dir, "orders")
    e.sql(f"COPY (SELECT o_orderkey, o_orderpriority FROM staging.orders) TO '{e.root}/orders.json'; CREATE EXTERNAL TABLE back STORED AS NDJSON LOCATION '{e.root}/orders.json'")
    return e.sql("SELECT o_orderkey, o_orderpriority FROM staging.back")


script("system_table_versions", "SELECT 'public' AS table_schema, 't' AS table_name, v::BIGINT AS version FROM range(0, 3) r(v)", f"{_CTAS}; DELETE FROM t WHERE k = 1; SELECT table_schema, table_name, version FROM system.table_versions")
script("information_schema_columns", "SELECT * FROM (VALUES ('a', 'int', 'YES'), ('b', 'string', 'NO'), ('c', 'decimal(38,10)', 'YES')) t(column_name, data_type, is_nullable)", "CREATE TABLE t (a INT, b TEXT NOT NULL, c NUMERIC); SELECT column_name, data_type, is_nullable FROM information_schema.columns WHERE table_name = 't'")


# -- remote tables and functions -------------------------------------------------------------------------------------------


@query("remote_sqlite_pushdown", "SELECT p_partkey, p_name FROM part WHERE p_size > 25 AND (p_brand = 'Brand#11' OR p_partkey < 100)")
def _(spark, sf_dir):
    e = loaded(spark, sf_dir)
    at = e.root.removeprefix("file:").replace("//", "/") + "/remote.db"
    Storage(spark).put_if_absent(f"{e.root}/remote.db.dir", "")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_size").toPandas()
    with sqlite3.connect(at) as c:
        c.execute('CREATE TABLE "parts on hand" (p_partkey BIGINT, p_name TEXT, p_brand TEXT, p_size INT)')
        c.executemany('INSERT INTO "parts on hand" VALUES (?, ?, ?, ?)', rows.astype(object).values.tolist())
    e.sql(f"CREATE EXTERNAL TABLE remote STORED AS TABLE OPTIONS('name' 'parts on hand') LOCATION 'sqlite://{at}'")
    return e.sql("SELECT p_partkey, p_name FROM staging.remote WHERE p_size > 25 AND (p_brand = 'Brand#11' OR p_partkey < 100)")


@query("udf_scalar", "SELECT l_orderkey, l_linenumber, round(sin(2 * pi() * l_discount), 6) AS v FROM lineitem")
def _(spark, sf_dir):
    import base64
    import json

    source = base64.b64encode(b"import numpy as np\ndef wave(v):\n    return np.sin(2 * np.pi * v)\n").decode()
    body = json.dumps({"entrypoint": "wave", "language": "python", "input_types": ["double"], "return_type": "double", "data": source, "volatility": "Immutable"})
    e = loaded(spark, sf_dir, "lineitem")
    e.sql(f"CREATE FUNCTION wave AS '{body}'")
    return e.sql("SELECT l_orderkey, l_linenumber, round(wave(l_discount), 6) AS v FROM staging.lineitem")


# -- change streams ---------------------------------------------------------------------------------------------------------

_C3, _C4, _F4 = Column(VALUE, "c3"), Column(VALUE, "c4"), Column(CHANGED, "c4")
_KEYS = [Column(OLD_PK, "c1"), Column(OLD_PK, "c2"), Column(NEW_PK, "c1"), Column(NEW_PK, "c2")]


def _partial_messages(spark: SparkSession, sf_dir: str) -> list[tuple[list[Column], DataFrame, int | None]]:
    """Orders under a key of two columns, in messages that list only some columns: inserts, changes, moves, deletes, and inserts of what was deleted."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("s"), F.col("o_totalprice").alias("p"), F.col("o_orderstatus").alias("t"))
    k, s, p, t = (F.col(c) for c in "kspt")
    none, nowhere = F.lit(None).cast("bigint"), F.lit(None).cast("string")

    def message(df, old, new, *values):
        cells = [*old, *new, *values]
        return df.select(*[c.alias(f"f{n}") for n, c in enumerate(cells)], k.alias("_row"))

    gone = o.where("k % 7 = 0 AND k % 5 <> 0")
    return [
        ([*_KEYS, _C3, _C4, _F4], message(o, (none, nowhere), (k, s), p, t, k % 2 == 0), None),
        ([*_KEYS, _C4], message(o.where("k % 3 = 0"), (k, s), (k, s), F.concat(t, F.lit("2"))), 11),
        ([*_KEYS, _C3], message(o.where("k % 5 = 0"), (k, s), (k, F.lit("moved")), p * 2), 12),
        ([*_KEYS, _C4, _F4], message(gone, (k, s), (none, nowhere), t, F.lit(True)), None),
        ([*_KEYS, _C3], message(gone.where("k % 2 = 0"), (none, nowhere), (k, s), -p), 30),
    ]


_SYNCED = """SELECT o_orderkey AS c1, CASE WHEN o_orderkey % 5 = 0 THEN 'moved' ELSE o_orderpriority END AS c2,
  CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice * 2 WHEN o_orderkey % 14 = 0 THEN -o_totalprice ELSE o_totalprice END AS c3,
  CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 14 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN o_orderstatus || '2' WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS c4
FROM orders WHERE NOT (o_orderkey % 7 = 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 2 <> 0)"""


def _synced(spark: SparkSession, sf_dir: str, flush_each: bool) -> DataFrame:
    from tidemark.plans.log import VersionedTable

    path = scratch(spark, "sync")
    writer = SyncWriter(spark)
    for columns, rows, sequence in _partial_messages(spark, sf_dir):
        writer.put(path, rows, columns, "42", sequence)
        if flush_each:
            writer.flush(path)
    writer.flush_all()
    return VersionedTable(spark, path).scan().select("c1", "c2", "c3", "c4")


query("cdc_composite_pk", _SYNCED)(lambda spark, sf_dir: _synced(spark, sf_dir, True))
query("cdc_partial_columns", _SYNCED)(lambda spark, sf_dir: _synced(spark, sf_dir, False))


def _order_messages(spark: SparkSession, sf_dir: str) -> tuple[list[Column], list[DataFrame]]:
    """All orders inserted, some updated, some moved to other keys, some deleted."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    null = F.lit(None).cast("bigint")
    row = lambda df, old, new, v, flag: df.select(old.alias("a"), new.alias("b"), v.alias("v"), F.lit(flag).alias("f"), F.col("k").alias("_row"))
    k, v = F.col("k"), F.col("v")
    return [Column(OLD_PK, "k"), Column(NEW_PK, "k"), Column(VALUE, "v"), Column(CHANGED, "v")], [
        row(o, null, k, v, True),
        row(o.where("k % 3 = 0"), k, k, v * 2, True),
        row(o.where("k % 5 = 0"), k, k + 10_000_000, F.lit(0.0), False),
        row(o.where("k % 7 = 0 AND k % 5 <> 0"), k, null, v, True),
    ]


_MERGED = "SELECT CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey + 10000000 ELSE o_orderkey END AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS v FROM orders WHERE NOT (o_orderkey % 7 = 0 AND o_orderkey % 5 <> 0)"


def _merged(spark: SparkSession, sf_dir: str, flush_each: bool) -> DataFrame:
    from tidemark.plans.log import VersionedTable

    path, writer = scratch(spark, "sync"), SyncWriter(spark)
    columns, messages = _order_messages(spark, sf_dir)
    for n, df in enumerate(messages):
        writer.put(path, df, columns, "1", n)
        if flush_each:
            writer.flush()
    writer.flush_all()
    return VersionedTable(spark, path).scan()


query("cdc_squash", _MERGED)(lambda spark, sf_dir: _merged(spark, sf_dir, False))
query("cdc_apply", _MERGED)(lambda spark, sf_dir: _merged(spark, sf_dir, True))


@query("cdc_pk_cycle", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) t(k, v)")
def _(spark, sf_dir):
    from tidemark.plans.log import VersionedTable

    path, writer = scratch(spark, "sync"), SyncWriter(spark)
    columns = [Column(OLD_PK, "k"), Column(NEW_PK, "k"), Column(VALUE, "v"), Column(CHANGED, "v")]
    moves = [(1, 3), (2, 1), (3, 2), (1, 3), (2, 1), (3, 2)]
    messages = [[(None, 1, "a", True), (None, 2, "b", True)], [(1, 1, "x", False)], [(a, b, "x", False) for a, b in moves], *[[(a, b, None, False)] for a, b in moves]]
    for n, rows in enumerate(messages):
        writer.put(path, spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "a int, b int, v string, f boolean, _row bigint"), columns, "1", n)
    writer.flush_all()
    return VersionedTable(spark, path).scan()


@query("cdc_foreach_batch", _MERGED)
def _(spark, sf_dir):
    from tidemark.plans.log import VersionedTable

    path, source = scratch(spark, "sync"), scratch(spark, "feed")
    columns, messages = _order_messages(spark, sf_dir)
    schema = "a bigint, b bigint, v double, f boolean, _row bigint"
    for n, df in enumerate(messages):
        df.select("a", "b", "v", "f", "_row").coalesce(1).write.mode("append").parquet(f"{source}/n={n}")
        stream = spark.readStream.schema(schema).parquet(f"{source}/n=*").drop("n")
        sync_stream(stream, path, columns, "feed", f"{path}-checkpoint").awaitTermination()
    return VersionedTable(spark, path).scan()


@query("stream_windowed_counts", "SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS slot, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf_dir):
    source, out = scratch(spark, "events"), scratch(spark, "windows")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    rows.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(source)
    counts = stream.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour"), "event_type").count()
    # Complete mode: the last micro-batch has all windows, also those the watermark has not closed.
    job = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True)
    job.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(out)).start().awaitTermination()
    done = spark.read.parquet(out)
    return done.select(F.col("window.start").cast("timestamp_ntz").alias("slot"), "event_type", F.col("count").alias("n"))




"""Queries through the frontends, on refusals, on the log, and on what must hold after failures."""

from __future__ import annotations

import hashlib
import io
import json
import threading
import urllib.parse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.queries.stateful import _CTAS, loaded, query, script
from tidemark.queries.stateful import QUERIES as _STATEFUL
from tidemark.queries.stateful import SQL as _STATEFUL_SQL
from tidemark.session import scratch
from tidemark.streaming.sync import CHANGED, NEW_PK, OLD_PK, VALUE, Column, SyncWriter, sync_stream, touched_files

_BEFORE = set(_STATEFUL)


def said(spark: SparkSession, cases: dict[str, Callable[[], object]]) -> DataFrame:
    """(step, answer): what each step gives or, where it is refused, the error's first line."""
    rows = []
    for step, f in cases.items():
        try:
            rows.append((step, str(f())))
        except Exception as e:  # noqa: BLE001 - the refusal is the answer
            rows.append((step, str(e).split("\n")[0]))
    return spark.createDataFrame(rows, "step string, answer string")


def expected(cases: dict[str, str]) -> str:
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join(f'({quote(a)}, {quote(b)})' for a, b in cases.items())}) t(step, answer)"


def table_of(spark: SparkSession, path: str):
    from tidemark.plans.log import VersionedTable

    return VersionedTable(spark, path)


# -- definitions --------------------------------------------------------------------------------------------------------

script("drop_table", "SELECT 0::BIGINT AS tables, 0::BIGINT AS left_over", f"{_CTAS}; DROP TABLE t; SELECT (SELECT count(*) FROM information_schema.tables WHERE table_schema = 'public') AS tables, count(*) AS left_over FROM system.dropped_tables")
script("drop_table_and_make_again", "SELECT count(*) AS n, count(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F'", f"{_CTAS}; DROP TABLE t; CREATE TABLE t AS SELECT o_orderkey AS k FROM staging.orders WHERE o_orderstatus = 'F'; SELECT count(*) AS n, count(k) AS k FROM t")
script("show_tables", "SELECT * FROM (VALUES ('public', 't', 'BASE TABLE'), ('staging', 'orders', 'BASE TABLE')) v(table_schema, table_name, table_type)", f"{_CTAS}; SELECT table_schema, table_name, table_type FROM information_schema.tables WHERE table_type = 'BASE TABLE'")
script("select_pruned", "SELECT o_orderstatus AS s, count(*) AS n, sum(o_custkey) AS c FROM orders WHERE o_orderstatus = 'P' GROUP BY o_orderstatus",
    "CREATE TABLE t AS SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s FROM staging.orders WHERE o_orderstatus = 'F'; INSERT INTO t SELECT o_orderkey, o_custkey, o_orderstatus FROM staging.orders WHERE o_orderstatus = 'O'; INSERT INTO t SELECT o_orderkey, o_custkey, o_orderstatus FROM staging.orders WHERE o_orderstatus NOT IN ('F', 'O'); SELECT s, count(*) AS n, sum(c) AS c FROM t WHERE s = 'P' GROUP BY s")
script("delete_no_file", "SELECT count(*) AS n, 3::BIGINT AS versions FROM orders", f"{_CTAS}; DELETE FROM t WHERE p < -1; SELECT count(*) AS n, (SELECT count(*) FROM system.table_versions) AS versions FROM t")
script("update_coerces_literals", "SELECT o_orderkey AS k, CASE WHEN o_totalprice > 200000 THEN 7 ELSE o_custkey END AS c, CASE WHEN o_totalprice > 200000 THEN 1.0 ELSE o_totalprice END AS p FROM orders", f"{_CTAS}; UPDATE t SET c = '7', p = 1 WHERE p > 200000; SELECT k, c, p FROM t")
script("insert_reordered_values", "SELECT * FROM (VALUES (1, 'x', NULL::DOUBLE), (2, NULL, NULL), (3, 'z', 0.5)) t(a, b, c)", "CREATE TABLE t (a INT, b TEXT, c DOUBLE); INSERT INTO t (b, a) VALUES ('x', 1), (NULL, 2); INSERT INTO t VALUES (3, 'z', 0.5); SELECT * FROM t")
script("int_division_derived", "SELECT o_custkey, count(*) // 2 AS half, sum(o_orderkey) // count(*) AS mean, max(o_custkey + 1) // 3 AS third, min(o_totalprice) / 2 AS price FROM orders GROUP BY o_custkey",
    "WITH a AS (SELECT o_custkey AS c, count(*) AS n, sum(o_orderkey) AS s, max(o_custkey + 1) AS m, min(o_totalprice) AS p FROM staging.orders GROUP BY o_custkey) SELECT c AS o_custkey, n / 2 AS half, s / n AS mean, m / 3 AS third, p / 2 AS price FROM (SELECT * FROM a) AS b")
script("int_division_values", "SELECT * FROM (VALUES (3, 3.5), (-3, -3.5), (NULL, 0.5)) t(whole, part)", "SELECT x / 2 AS whole, y / 2 AS part FROM (VALUES (7, 7.0::DOUBLE), (-7, -7.0::DOUBLE), (NULL, 1.0::DOUBLE)) AS t(x, y)")
script("explain_reads_no_rows", "SELECT true AS planned", f"{_CTAS}; SELECT true AS planned FROM t LIMIT 1")


@query("explain_plan", "SELECT 1::BIGINT AS plans, true AS scans")
def _(spark, sf_dir):
    e = loaded(spark, sf_dir, "orders")
    plan = e.sql(f"{_CTAS}; EXPLAIN SELECT k FROM t WHERE k > 5")
    return plan.agg(F.count(F.lit(1)).alias("plans"), F.max(F.col("plan").contains("Scan parquet")).alias("scans"))


_REFUSED = {
    "view": "This feature is not implemented: Creating views is currently unsupported!",
    "or replace": "Unsupported SQL statement: CREATE OR REPLACE TABLE",
    "table there": 'Error during planning: Table "t" already exists',
    "if not exists": "None",
    "schema there": 'Error during planning: Schema "public" already exists',
    "no schema": 'Error during planning: Schema "nope" doesn\'t exist',
    "no table": 'Error during planning: Table "nope" doesn\'t exist',
    "no table, if exists": "None",
    "staging": "Error during planning: The staging schema can only be referenced via CREATE EXTERNAL TABLE",
    "time travel of staging": 'Error during planning: Table "orders" has no versions',
    "no field": "Schema error: No field named nope. Valid fields are k, c, p, s.",
    "twice a field": "Schema error: Schema contains duplicate unqualified field name k",
    "column count": "Error during planning: Column count doesn't match insert query!",
    "no version": "The table has no version at or before that time",
    "bad version": "Failed to parse version soon as timestamp",
    "no function": 'Error during planning: Function "nope" not found',
    "rows": "15000",
}


@query("refusals", "SELECT step, CASE WHEN step = 'rows' THEN (SELECT count(*)::VARCHAR FROM orders) ELSE answer END AS answer FROM (" + expected(_REFUSED) + ")")
def _(spark, sf_dir):
    e = loaded(spark, sf_dir, "orders")
    e.sql(_CTAS)
    run = {
        "view": "CREATE VIEW v AS SELECT 1", "or replace": "CREATE OR REPLACE TABLE t AS SELECT 1 AS a", "table there": "CREATE TABLE t (a INT)", "if not exists": "CREATE TABLE IF NOT EXISTS t (a INT)", "schema there": "CREATE SCHEMA public",
        "no schema": "CREATE TABLE nope.t (a INT)", "no table": "DROP TABLE nope", "no table, if exists": "DROP TABLE IF EXISTS nope", "staging": "CREATE TABLE staging.x (a INT)", "time travel of staging": "SELECT * FROM staging.orders('2024-01-01T00:00:00Z')",
        "no field": "UPDATE t SET nope = 1", "twice a field": "INSERT INTO t (k, k) VALUES (1, 2)", "column count": "INSERT INTO t (k, c) VALUES (1)", "no version": "SELECT * FROM t('2001-01-01T00:00:00Z')", "bad version": "SELECT * FROM t('soon')", "no function": "DROP FUNCTION nope",
    }
    steps = {k: (lambda q=q: e.sql(q)) for k, q in run.items()}
    return said(spark, steps | {"rows": lambda: e.sql("SELECT count(*) AS n FROM t").head()[0]})


@query("scoping", "SELECT count(*) AS n, 'other' AS seen FROM customer UNION ALL SELECT count(*), 'public' FROM orders")
def _(spark, sf_dir):
    e = loaded(spark, sf_dir, "orders", "customer")
    e.sql("CREATE DATABASE d; CREATE SCHEMA other; CREATE TABLE t AS SELECT o_orderkey AS k FROM staging.orders; CREATE TABLE other.t AS SELECT c_custkey AS k FROM staging.customer")
    other = e.scope_to(schema="other").sql("SELECT count(*) AS n, 'other' AS seen FROM t")
    return other.union(e.scope_to("default", "public").sql("SELECT count(*) AS n, 'public' AS seen FROM t"))


@query("vacuum_database", "SELECT 1::BIGINT AS pending, 0::BIGINT AS purged, false AS files_left")
def _(spark, sf_dir):
    e = loaded(spark, sf_dir, "orders")
    e.sql(_CTAS)
    path, keep = e.table("t").path, e._purge
    e._purge = lambda db=None: 0  # the purge right after the drop fails
    e.sql("DROP TABLE t")
    pending = e.sql("SELECT count(*) AS n FROM system.dropped_tables").head()[0]
    e._purge = keep
    e.sql("VACUUM DATABASE default")
    left = e.store.exists(path)
    return e.sql(f"SELECT {pending}::BIGINT AS pending, count(*) AS purged, {str(left).lower()} AS files_left FROM system.dropped_tables")


@query("time_travel_formats", "SELECT f AS format, n FROM (SELECT count(*) AS n FROM orders), (VALUES ('rfc 3339'), ('offset'), ('rfc 2822'), ('blank'), ('zone')) t(f)")
def _(spark, sf_dir):
    import time
    from datetime import datetime, timedelta, timezone
    from email.utils import format_datetime

    e = loaded(spark, sf_dir, "orders")
    e.sql(_CTAS)
    time.sleep(1.1)  # some formats have whole seconds
    at = datetime.now(timezone.utc)
    time.sleep(1.1)
    e.sql("DELETE FROM t")
    east = at.astimezone(timezone(timedelta(hours=2)))
    spelled = {"rfc 3339": at.isoformat().replace("+00:00", "Z"), "offset": east.isoformat(), "rfc 2822": format_datetime(at), "blank": at.strftime("%Y-%m-%d %H:%M:%S"), "zone": east.strftime("%Y-%m-%d %H:%M:%S %z")}
    out = None
    for name, text in spelled.items():
        df = e.sql(f"SELECT '{name}' AS format, count(*) AS n FROM t('{text}')")
        out = df if out is None else out.unionByName(df)
    return out


@query("unsupported_types", expected({"INT UNSIGNED": "bigint", "NUMERIC": "decimal(38,10)", "NUMERIC(5, 9)": "Decimal(precision = 5, scale = 9) should satisfy `0 < precision <= 38`, and `abs(scale) <= precision`.", "TIMESTAMP(3)": "Unsupported SQL type TIMESTAMP(3)", "TEXT[]": "array<string>"}))
def _(spark, sf_dir):
    from tidemark.plans.tokens import tokenize
    from tidemark.plans.types import column_list

    return said(spark, {t: (lambda t=t: column_list(tokenize(f"c {t}"))[0].dataType.simpleString()) for t in ("INT UNSIGNED", "NUMERIC", "NUMERIC(5, 9)", "TIMESTAMP(3)", "TEXT[]")})


# -- logs of outside tables ---------------------------------------------------------------------------------------------


@query("external_delta_checkpoint", "SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 13 > 0")
def _(spark, sf_dir):
    """A table of 13 versions whose older commits were cleaned away after a checkpoint."""
    e = loaded(spark, sf_dir, "orders")
    e.sql("CREATE TABLE t AS SELECT o_orderkey AS k, o_orderstatus AS s FROM staging.orders WHERE o_orderkey % 13 = 1")
    for n in [*range(2, 13), 0]:
        e.sql(f"INSERT INTO t SELECT o_orderkey, o_orderstatus FROM staging.orders WHERE o_orderkey % 13 = {n}")
    e.sql("DELETE FROM t WHERE k % 13 = 0")
    path = e.table("t").path
    for v in range(10):
        e.store.delete(f"{path}/_delta_log/{v:020d}.json")
    e.sql(f"CREATE EXTERNAL TABLE x STORED AS DELTATABLE LOCATION '{path}'")
    return e.sql("SELECT k, s FROM staging.x")


@query("external_delta_partitions", "SELECT o_orderkey AS k, o_totalprice AS p, o_orderstatus AS s FROM orders")
def _(spark, sf_dir):
    """A table whose partition column is only in the log and in the names of folders."""
    e = loaded(spark, sf_dir, "orders")
    at = scratch(spark, "outside")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"), F.col("o_orderstatus").alias("s"))
    rows.write.partitionBy("s").parquet(at)
    meta = {"id": "0", "format": {"provider": "parquet", "options": {}}, "schemaString": json.dumps(rows.schema.jsonValue()), "partitionColumns": ["s"], "configuration": {}}
    adds = []
    for folder, *_ in e.store.list(at):
        if "/s=" in folder:
            adds += [{"add": {"path": "/".join(p.rsplit("/", 2)[1:]), "size": n, "partitionValues": {"s": folder.rsplit("=", 1)[1]}, "modificationTime": 0, "dataChange": True}} for p, n, _, _ in e.store.list(folder) if p.endswith(".parquet")]
    actions = [{"protocol": {"minReaderVersion": 1, "minWriterVersion": 2}}, {"metaData": meta}, *adds]
    e.store.put_if_absent(f"{at}/_delta_log/{0:020d}.json", "\n".join(map(json.dumps, actions)))
    e.sql(f"CREATE EXTERNAL TABLE x STORED AS DELTATABLE LOCATION '{at}'")
    return e.sql("SELECT k, p, s FROM staging.x")


@query("external_partitioned_listing", "SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderstatus <> 'F'")
def _(spark, sf_dir):
    e = loaded(spark, sf_dir, "orders")
    at = f"{e.root}/listed"
    e.sql(f"COPY (SELECT o_orderkey AS k, o_orderstatus AS s FROM staging.orders) TO '{at}' STORED AS CSV PARTITIONED BY (s)")
    e.sql(f"CREATE EXTERNAL TABLE x (k BIGINT) STORED AS CSV PARTITIONED BY (s TEXT) WITH ORDER (k ASC) OPTIONS('format.has_header' 'true') LOCATION '{at}'")
    return e.sql("SELECT k, s FROM staging.x WHERE s <> 'F'")


@query("external_arrow_roundtrip", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders")
def _(spark, sf_dir):
    import pyarrow as pa

    e = loaded(spark, sf_dir, "orders")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"))
    schema = pa.schema([("k", pa.int64()), ("p", pa.float64())])
    at = f"{e.root}/files"
    e.store.put_if_absent(f"{at}/_made", "")

    def write(batches):
        from pyspark import TaskContext

        name = f"{at.removeprefix('file:')}/{TaskContext.get().partitionId()}.arrow".replace("//", "/")
        with pa.OSFile(name, "wb") as f, pa.ipc.new_file(f, schema) as out:
            for b in batches:
                out.write_batch(b.cast(schema))
        yield pa.RecordBatch.from_pydict({"name": [name]})

    names = [r[0] for r in rows.repartition(3).mapInArrow(write, "name string").collect()]
    out = None
    for n, name in enumerate(names):
        e.sql(f"CREATE EXTERNAL TABLE a{n} STORED AS ARROW LOCATION '{name}'")
        part = e.sql(f"SELECT k, p FROM staging.a{n}")
        out = part if out is None else out.union(part)
    return out


@query("external_http", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def _(spark, sf_dir):
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    with open(f"{sf_dir}/nation.parquet", "rb") as f:
        data = f.read()

    class Ranges(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            a, b = map(int, self.headers["Range"][6:].split("-"))
            part = data[a : b + 1]
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {a}-{a + len(part) - 1}/{len(data)}")
            self.send_header("Content-Length", str(len(part)))
            self.end_headers()
            self.wfile.write(part)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Ranges)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        e = loaded(spark, sf_dir)
        e.sql(f"CREATE EXTERNAL TABLE x STORED AS PARQUET LOCATION 'http://127.0.0.1:{server.server_port}/nation.parquet?sig=a%3D'")
        return e.sql("SELECT n_nationkey, n_name FROM staging.x WHERE n_regionkey = 2")
    finally:
        server.shutdown()


@query("iceberg_refuses_changes", "SELECT n_name FROM nation UNION ALL SELECT 'refused' FROM range(3)")
def _(spark, sf_dir):
    from tidemark.sources.iceberg import create_table

    e = loaded(spark, sf_dir, "nation")
    made = create_table(spark, f"{e.root}/ice", spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name").schema)
    c = e.with_metastore({"s.t": {"location": made.path, "format": "ICEBERG"}})
    c.sql("INSERT INTO s.t SELECT n_name FROM staging.nation")
    refused = 0
    for sql in ("DELETE FROM s.t WHERE n_name = 'x'", "UPDATE s.t SET n_name = 'x'", "TRUNCATE TABLE s.t"):
        try:
            c.sql(sql)
        except Exception:  # noqa: BLE001 - only inserts are taken
            refused += 1
    return c.sql("SELECT n_name FROM s.t").union(spark.createDataFrame([("refused",)] * refused, "n_name string"))


# -- remote tables ------------------------------------------------------------------------------------------------------


def _remote(spark: SparkSession, sf_dir: str, columns: str = "", limit_types: str = "BIGINT, p_name TEXT, p_brand TEXT, p_size INT, p_retailprice DOUBLE"):
    import sqlite3

    e = loaded(spark, sf_dir)
    at = e.root.removeprefix("file:").replace("//", "/") + "/remote.db"
    e.store.put_if_absent(f"{e.root}/remote.db.dir", "")
    names = ["p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"]
    with sqlite3.connect(at) as c:
        c.execute(f"CREATE TABLE parts (p_partkey {limit_types})")
        for r in spark.read.parquet(f"{sf_dir}/part.parquet").select(*names).toLocalIterator():
            c.execute("INSERT INTO parts VALUES (?, ?, ?, ?, ?)", tuple(r))
    e.sql(f"CREATE EXTERNAL TABLE remote {columns} STORED AS TABLE OPTIONS('name' 'parts') LOCATION 'sqlite://{at}'")
    return e


@query("remote_projection", "SELECT p_brand, count(*) AS n FROM part WHERE p_size < 30 GROUP BY p_brand")
def _(spark, sf_dir):
    return _remote(spark, sf_dir).sql("SELECT p_brand, count(*) AS n FROM staging.remote WHERE p_size < 30 GROUP BY p_brand")


@query("remote_limit", "SELECT least(7, count(*))::BIGINT AS n, true AS sizes FROM part WHERE p_size > 10")
def _(spark, sf_dir):
    return _remote(spark, sf_dir).sql("SELECT count(*) AS n, bool_and(p_size > 10) AS sizes FROM (SELECT p_size FROM staging.remote WHERE p_size > 10 LIMIT 7) AS t")


@query("remote_precedence", "SELECT p_partkey FROM part WHERE NOT (p_size > 10 AND p_brand = 'Brand#11') AND (p_size - 5) * 2 > 20 AND (p_name = 'it''s' OR p_size IN (20, 30, 40) OR p_brand IS NULL)")
def _(spark, sf_dir):
    return _remote(spark, sf_dir).sql("SELECT p_partkey FROM staging.remote WHERE NOT (p_size > 10 AND p_brand = 'Brand#11') AND (p_size - 5) * 2 > 20 AND (p_name = 'it''s' OR p_size IN (20, 30, 40) OR p_brand IS NULL)")


@query("remote_declared_types", "SELECT p_partkey::VARCHAR AS id, p_size::BIGINT AS size, p_retailprice::DECIMAL(12, 2)::DOUBLE AS price FROM part WHERE p_size <> 7")
def _(spark, sf_dir):
    e = _remote(spark, sf_dir, "(id TEXT, name TEXT, brand TEXT, size BIGINT, price NUMERIC(12, 2))")
    return e.sql("SELECT id, size, price::DOUBLE PRECISION AS price FROM staging.remote WHERE size <> 7")


_FILTERS = {
    "sqlite, quotes": "\"a\"\"b\" = 'x''y'", "mysql, quotes": "`a``b` >= 5", "postgres, null-safe": '"c" IS NOT DISTINCT FROM TRUE', "negated list": "NOT (\"a\" IN (1, 2))", "date": "\"d\" > '2024-02-03'",
    "zone": "None", "binary": "None", "sqlite like": "None", "postgres like": "\"a\" LIKE 'x%'",
}


@query("remote_literals", expected(_FILTERS))
def _(spark, sf_dir):
    from datetime import date, datetime, timezone

    from pyspark.sql.datasource import EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, Not, StringStartsWith

    from tidemark.sources.remote import filter_sql

    return said(spark, {
        "sqlite, quotes": lambda: filter_sql(EqualTo(('a"b',), "x'y")), "mysql, quotes": lambda: filter_sql(GreaterThanOrEqual(("a`b",), 5), "mysql"), "postgres, null-safe": lambda: filter_sql(EqualNullSafe(("c",), True), "postgres"),
        "negated list": lambda: filter_sql(Not(In(("a",), (1, 2)))), "date": lambda: filter_sql(GreaterThan(("d",), date(2024, 2, 3))), "zone": lambda: filter_sql(LessThan(("d",), datetime(2024, 1, 1, tzinfo=timezone.utc))),
        "binary": lambda: filter_sql(Not(EqualTo(("a",), b"x"))), "sqlite like": lambda: filter_sql(StringStartsWith(("a",), "x")), "postgres like": lambda: filter_sql(StringStartsWith(("a",), "x"), "postgres"),
    })


# -- functions of the catalogue -----------------------------------------------------------------------------------------


def _function(source: str, kinds: list[str], result: str, volatility: str = "Immutable", entry: str = "f", language: str = "python") -> str:
    import base64

    return json.dumps({"entrypoint": entry, "language": language, "input_types": kinds, "return_type": result, "data": base64.b64encode(source.encode()).decode(), "volatility": volatility})


@query("udf_nulls_and_types", "SELECT event_id, CASE WHEN value IS NOT NULL THEN round(value * 2, 6) END AS twice, event_type || '!' AS loud FROM events")
def _(spark, sf_dir):
    e = loaded(spark, sf_dir, "events")
    e.sql(f"CREATE FUNCTION twice AS '{_function('def f(v):' + chr(10) + ' return v * 2', ['double'], 'double', 'Volatile')}'")
    e.sql(f"CREATE FUNCTION loud AS '{_function('def f(v):' + chr(10) + ' return v + chr(33)', ['text'], 'text', 'Stable')}'")
    return e.sql("SELECT event_id, round(twice(value), 6) AS twice, loud(event_type) AS loud FROM staging.events")


_DEFINED = {
    "made": "None", "there": 'Error during planning: Function "g" already exists', "replaced": "None", "unknown type": "Error deserializing function: unknown type POINT", "unknown language": "Error deserializing function: unknown language cobol",
    "no module": 'Internal error: Error initializing WASM UDF "g": Internal("Error loading WASM module: failed to parse WebAssembly module")', "no entry": 'Internal error: Error initializing Python UDF "g": Internal("Function "h" is not in the module")', "dropped": "None", "gone": 'Error during planning: Function "g" not found',
}


@query("udf_definitions", expected(_DEFINED))
def _(spark, sf_dir):
    e = loaded(spark, sf_dir)
    body = _function("def f(v):\n return v", ["bigint"], "bigint")
    make = lambda text, replace="": e.sql(f"CREATE {replace} FUNCTION g AS '{text}'")
    return said(spark, {
        "made": lambda: make(body), "there": lambda: make(body), "replaced": lambda: make(body, "OR REPLACE"), "unknown type": lambda: make(_function("", ["POINT"], "bigint"), "OR REPLACE"), "unknown language": lambda: make(body.replace("python", "cobol"), "OR REPLACE"),
        "no module": lambda: make(body.replace('"python"', '"wasm"'), "OR REPLACE"), "no entry": lambda: make(body.replace('"entrypoint": "f"', '"entrypoint": "h"'), "OR REPLACE"), "dropped": lambda: e.sql("DROP FUNCTION g"), "gone": lambda: e.sql("DROP FUNCTION g"),
    })


# -- HTTP, Flight, prompt, settings -------------------------------------------------------------------------------------

_BY_STATUS = "SELECT o_orderstatus AS s, count(*) AS n, round(sum(o_totalprice), 2) AS p, NULL::VARCHAR AS nothing FROM orders GROUP BY o_orderstatus"


def _rows(spark: SparkSession, body: bytes) -> DataFrame:
    return spark.createDataFrame([(r["s"], r["n"], r["p"], r["nothing"]) for r in map(json.loads, body.splitlines())], "s string, n bigint, p double, nothing string")


def _service(spark: SparkSession, sf_dir: str, **policy):
    from tidemark.auth import Policy
    from tidemark.server import Service

    return Service(loaded(spark, sf_dir, "orders"), Policy(**policy))


def _post(service, sql: str, path: str = "/q", **headers):
    return service.handle("POST", path, headers, json.dumps({"query": sql}).encode())


@query("http_post", _BY_STATUS)
def _(spark, sf_dir):
    s = _service(spark, sf_dir)
    a = _post(s, f"{_CTAS}; SELECT s, count(*) AS n, round(sum(p), 2) AS p, CAST(NULL AS TEXT) AS nothing FROM t GROUP BY s")
    return _rows(spark, b"".join(a.body))


@query("http_over_a_socket", _BY_STATUS)
def _(spark, sf_dir):
    import urllib.request

    from tidemark.server import serve

    s = serve(_service(spark, sf_dir), port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    try:
        text = "SELECT o_orderstatus AS s, count(*) AS n, round(sum(o_totalprice), 2) AS p, CAST(NULL AS TEXT) AS nothing FROM staging.orders GROUP BY o_orderstatus"
        with urllib.request.urlopen(f"http://127.0.0.1:{s.server_port}/q/{urllib.parse.quote(text)}") as r:  # noqa: S310
            return _rows(spark, r.read())
    finally:
        s.shutdown()


@query("http_get_cached", "SELECT * FROM (VALUES ('first', 200), ('same', 304), ('changed', 200), ('wrong hash', 400), ('write', 405)) t(step, status)")
def _(spark, sf_dir):
    s = _service(spark, sf_dir)
    _post(s, _CTAS)
    text = "SELECT count(*) AS n FROM t"
    ask = lambda **h: s.handle("GET", f"/q/{hashlib.sha256(text.encode()).hexdigest()}.json", {"X-Tidemark-Query": urllib.parse.quote(text), **h})
    first = ask()
    b"".join(first.body)
    same = ask(**{"If-None-Match": first.headers["etag"]})
    _post(s, "DELETE FROM t WHERE k % 2 = 0")
    changed = ask(**{"If-None-Match": first.headers["etag"]})
    wrong = s.handle("GET", f"/q/{'0' * 64}", {}, json.dumps({"query": text}).encode())
    write = s.handle("GET", "/q/" + urllib.parse.quote("DROP TABLE t"), {})
    return spark.createDataFrame([("first", first.status), ("same", same.status), ("changed", changed.status), ("wrong hash", wrong.status), ("write", write.status)], "step string, status int")


@query("http_upload", "SELECT count(*) AS n, sum(n_nationkey) AS k, count(DISTINCT n_name) AS names FROM nation")
def _(spark, sf_dir):
    s = _service(spark, sf_dir)
    lines = ["k,name", *(f"{r.n_nationkey},{r.n_name}" for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect())]
    middle = len(lines) // 2
    for part, header in ((lines[:middle], "true"), (lines[middle:], "false")):
        form = f'--B\r\nContent-Disposition: form-data; name="has_header"\r\n\r\n{header}\r\n--B\r\nContent-Disposition: form-data; name="data"; filename="n.csv"\r\n\r\n' + "\n".join(part) + "\r\n--B--\r\n"
        s.handle("POST", "/upload/up/nations", {"Content-Type": "multipart/form-data; boundary=B"}, form.encode())
    return s.engine.sql("SELECT count(*) AS n, sum(k) AS k, count(DISTINCT name) AS names FROM up.nations")


_HTTP = {
    "health": "200 ready", "ready": "200 ready", "unknown path": "404 NOT_FOUND", "preflight": "204 * 86400", "no query": "400 Empty query received", "no json": "400", "two reads": "400 Only one read statement is allowed and it must be at the end of a multi-statement query",
    "write forbidden": "403 WRITE_FORBIDDEN", "wrong token": "401 INVALID_ACCESS_TOKEN", "writer": "200 ", "reading disabled": "405 READ_ONLY_ENDPOINT_DISABLED", "useless token": "400 USELESS_ACCESS_TOKEN", "no token": "401 NEED_ACCESS_TOKEN", "bad header": "401 INVALID_AUTHORIZATION_HEADER",
    "upload without file": "400 No part containing file found in the request!", "upload of text": "400 File a.txt not supported", "metrics": "True",
}


@query("http_answers", expected(_HTTP))
def _(spark, sf_dir):
    from tidemark.auth import Policy
    from tidemark.server import Service

    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    s = _service(spark, sf_dir)
    other = lambda **p: Service(s.engine, Policy(**p))
    show = lambda a: f"{a.status} {b''.join(a.body).decode()}"
    upload = lambda name: s.handle("POST", "/upload/u/t", {"Content-Type": "multipart/form-data; boundary=B"}, f'--B\r\nContent-Disposition: form-data; name="data"; filename="{name}"\r\n\r\nx\r\n--B--\r\n'.encode())
    locked = other(read="any", write=digest("secret"))
    preflight = s.handle("OPTIONS", "/q", {})
    return said(spark, {
        "health": lambda: show(s.handle("GET", "/healthz", {})), "ready": lambda: show(s.handle("GET", "/readyz", {})), "unknown path": lambda: show(s.handle("GET", "/nope", {})), "preflight": lambda: f"{preflight.status} {preflight.headers['access-control-allow-origin']} {preflight.headers['access-control-max-age']}",
        "no query": lambda: show(_post(s, "")), "no json": lambda: s.handle("POST", "/q", {}, b"x").status, "two reads": lambda: show(_post(s, "SELECT 1; SELECT 2")), "write forbidden": lambda: show(_post(locked, "CREATE TABLE z (a INT)")),
        "wrong token": lambda: show(_post(locked, "SELECT 1", Authorization="Bearer nope")), "writer": lambda: show(_post(locked, "CREATE TABLE z (a INT)", Authorization="Bearer secret")), "reading disabled": lambda: show(other(read="off").handle("GET", "/q/" + urllib.parse.quote("SELECT 1"), {})),
        "useless token": lambda: show(_post(s, "SELECT 1", Authorization="Bearer x")), "no token": lambda: show(_post(other(read=digest("r"), write="off"), "SELECT 1")), "bad header": lambda: show(_post(locked, "SELECT 1", Authorization="Basic x")),
        "upload without file": lambda: show(s.handle("POST", "/upload/u/t", {}, b"")), "upload of text": lambda: show(upload("a.txt")), "metrics": lambda: "tidemark_http_requests_total" in show(s.handle("GET", "/metrics", {})),
    })


@query("flight_query", _BY_STATUS)
def _(spark, sf_dir):
    import pyarrow.flight as fl

    from tidemark.flight import FlightServer, pack, write_message

    server = FlightServer(loaded(spark, sf_dir, "orders"))
    threading.Thread(target=server.serve, daemon=True).start()
    try:
        c = fl.connect(f"grpc://127.0.0.1:{server.port}")
        sql = "SELECT o_orderstatus AS s, count(*) AS n, round(sum(o_totalprice), 2) AS p, CAST(NULL AS TEXT) AS nothing FROM staging.orders GROUP BY o_orderstatus"
        command = pack("arrow.flight.protocol.sql.CommandStatementQuery", write_message([(1, sql.encode())]))
        ticket = c.get_flight_info(fl.FlightDescriptor.for_command(command)).endpoints[0].ticket
        rows = c.do_get(ticket).read_all().to_pylist()
        c.close()
        return spark.createDataFrame([(r["s"], r["n"], r["p"], r["nothing"]) for r in rows], "s string, n bigint, p double, nothing string")
    finally:
        server.shutdown()


@query("one_off_script", _BY_STATUS)
def _(spark, sf_dir):
    from tidemark.cli import one_off

    out = io.StringIO()
    one_off(loaded(spark, sf_dir, "orders"), f"{_CTAS}; SELECT s, count(*) AS n, round(sum(p), 2) AS p, CAST(NULL AS TEXT) AS nothing FROM t GROUP BY s", out)
    return _rows(spark, out.getvalue().encode())


@query("prompt_session", "SELECT * FROM (VALUES ('default> ', 1), ('| 3 |', 1), ('| k           | int', 1), ('Unknown command', 1), ('Time: ', 4)) t(text, times)")
def _(spark, sf_dir):
    from tidemark.cli import prompt

    out = io.StringIO()
    prompt(loaded(spark, sf_dir), io.StringIO("CREATE TABLE t AS\nSELECT 3 AS k;\n\\d t\nSELECT * FROM t;\n\\nope\nSELECT wrong;\n\\q\nSELECT 4;\n"), out)
    text = out.getvalue()
    seen = [("default> ", int(text.startswith("default> "))), *((x, text.count(x)) for x in ("| 3 |", "| k           | int", "Unknown command", "Time: "))]
    return spark.createDataFrame(seen, "text string, times int")


_SETTINGS = {"file": "80", "environment": "81", "default": "600", "s3 without region": "An S3 store needs a region or an endpoint", "little memory": "runtime.max_memory must be at least 64 MB", "store": "s3a://b/p"}


@query("settings", expected(_SETTINGS))
def _(spark, sf_dir):
    from tidemark.config import load, store_url

    text = "[frontend.http]\nbind_port = 80"
    return said(spark, {
        "file": lambda: load(text, {}).get("frontend.http.bind_port"), "environment": lambda: load(text, {"TIDEMARK__FRONTEND__HTTP__BIND_PORT": "81"}).get("frontend.http.bind_port"), "default": lambda: load("", {}).get("misc.sync_conf.max_replication_lag_s"),
        "s3 without region": lambda: load('[object_store]\ntype = "s3"\nbucket = "b"', {}), "little memory": lambda: load("[runtime]\nmax_memory = 63", {}), "store": lambda: store_url(load('[object_store]\ntype = "s3"\nbucket = "b"\nprefix = "p"\nregion = "r"', {})),
    })


@query("upload_pandas", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance FROM supplier")
def _(spark, sf_dir):
    e = loaded(spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey AS id", "s_name AS name", "s_acctbal AS balance").toPandas()
    e.upload_pandas("fresh", "suppliers", rows)
    return e.sql("SELECT id, name, balance FROM fresh.suppliers")


# -- change streams -----------------------------------------------------------------------------------------------------

_K, _V = [Column(OLD_PK, "k"), Column(NEW_PK, "k")], Column(VALUE, "v")


def _inserts(df: DataFrame, kind: str = "bigint", value: str = "p") -> DataFrame:
    return df.select(F.lit(None).cast(kind).alias("a"), F.col("k").cast(kind).alias("b"), F.col(value).alias("v"), F.col("k").alias("_row"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"))


@query("cdc_decimal_key", "SELECT (o_orderkey * 1.5)::DECIMAL(20, 2)::DOUBLE AS k, CASE WHEN o_orderkey % 2 = 0 THEN -o_totalprice ELSE o_totalprice END AS v FROM orders")
def _(spark, sf_dir):
    """Keys whose text does not sort as their numbers do: inserts, then updates of some and inserts of the rest."""
    o = _orders(spark, sf_dir).withColumn("d", (F.col("k") * F.lit("1.5").cast("decimal(3,1)")).cast("decimal(20,2)"))
    path, w, none = scratch(spark, "sync"), SyncWriter(spark), F.lit(None).cast("decimal(20,2)")
    row = lambda df, old, v: df.select(old.alias("a"), F.col("d").alias("b"), v.alias("v"), F.col("k").alias("_row"))
    w.put(path, row(o.where("k % 2 = 0"), none, F.col("p")), [*_K, _V], "1", 1)
    w.flush_all()
    w.put(path, row(o.where("k % 2 = 0"), F.col("d"), -F.col("p")).union(row(o.where("k % 2 = 1"), none, F.col("p"))), [*_K, _V], "1", 2)
    w.flush_all()
    return table_of(spark, path).scan().select(F.col("k").cast("double").alias("k"), "v")


@query("cdc_two_origins", "SELECT o_orderkey AS k, o_totalprice AS v FROM orders")
def _(spark, sf_dir):
    """Two streams into one table; the first one's batches are all delivered again after the second one has written."""
    path, feed, o = scratch(spark, "sync"), scratch(spark, "feed"), _orders(spark, sf_dir)
    for name, some in (("A", "k % 2 = 0"), ("B", "k % 2 = 1")):
        _inserts(o.where(some)).coalesce(1).write.parquet(f"{feed}/{name}")
    for name, checkpoint in (("A", "first"), ("B", "first"), ("A", "lost and started again")):
        stream = spark.readStream.schema("a bigint, b bigint, v double, _row bigint").parquet(f"{feed}/{name}")
        sync_stream(stream, path, [*_K, _V], name, f"{path}-{name}-{checkpoint.replace(' ', '-')}").awaitTermination()
    # A repeated insert would put the row there again; a skipped one leaves the version count as it is.
    t = table_of(spark, path)
    assert len(t.versions()) == 3, t.versions()
    return t.scan()


@query("cdc_replies", expected({"probe of a new origin": "True None None True", "inside a transaction": "True None None True", "other origin inside": "Transaction from a new origin B started while one from A is open", "closed": "True 7 None False", "probe": "True 7 None False", "empty transaction": "Sequence number 9 of origin A closes an empty transaction", "written out": "True 7 7 False", "iceberg target": "Change streams can't be written to tables of format ICEBERG", "busy": "False 7 7 False"}))
def _(spark, sf_dir):
    from tidemark.streaming import sync

    path, w, o = scratch(spark, "sync"), SyncWriter(spark), _orders(spark, sf_dir)
    show = lambda r: f"{r.accepted} {r.memory_sequence_number} {r.durable_sequence_number} {r.first}"
    put = lambda df, origin, n=None, **k: show(w.put(path, df, [*_K, _V], origin, n, **k))

    def busy() -> str:
        wait, sync.LOCK_S = sync.LOCK_S, 0.01
        w.lock.acquire()
        try:
            return put(None, "A")
        finally:
            w.lock.release()
            sync.LOCK_S = wait

    def written() -> str:
        w.flush_all()
        return put(None, "A")

    return said(spark, {
        "probe of a new origin": lambda: put(None, "A"), "inside a transaction": lambda: put(_inserts(o.where("k % 2 = 0")), "A"), "other origin inside": lambda: put(_inserts(o), "B", 1), "closed": lambda: put(_inserts(o.where("k % 2 = 1")), "A", 7), "probe": lambda: put(None, "A"),
        "empty transaction": lambda: put(None, "A", 9), "written out": written, "iceberg target": lambda: put(_inserts(o), "A", 10, format="ICEBERG"), "busy": busy,
    })


_SCHEMAS = {
    "fits": "['k'] ['v']", "count": "Column descriptors do not match the schema", "flag without value": "Changed column must be boolean type and point to an existing value column", "flag of numbers": "Changed column must be boolean type and point to an existing value column",
    "no keys": "Change requested but batches do not contain old/new PK columns", "other keys": "Old and new PKs must contain the same columns", "other types": "Old and new PKs must contain the same columns",
}


@query("cdc_schema_checks", expected(_SCHEMAS))
def _(spark, sf_dir):
    from pyspark.sql import types as T

    from tidemark.streaming.sync import SyncSchema

    fields = lambda ddl: T.StructType.fromDDL(ddl).fields
    flag = Column(CHANGED, "v")
    check = lambda d, ddl: (lambda s: f"{s.keys} {s.values}")(SyncSchema(d, fields(ddl)))
    return said(spark, {
        "fits": lambda: check([*_K, _V, flag], "a int, b int, c string, d boolean"), "count": lambda: check(_K, "a int"), "flag without value": lambda: check([*_K, flag], "a int, b int, d boolean"), "flag of numbers": lambda: check([*_K, _V, flag], "a int, b int, c string, d int"),
        "no keys": lambda: check([_V], "c string"), "other keys": lambda: check([Column(OLD_PK, "k"), Column(NEW_PK, "j")], "a int, b int"), "other types": lambda: check(_K, "a int, b bigint"),
    })


@query("cdc_file_pruning", "SELECT * FROM (VALUES ('ranges', '0 1'), ('key by key', '0'), ('decimals', '0')) t(step, answer)")
def _(spark, sf_dir):
    from pyspark.sql import types as T

    from tidemark.plans.log import DataFile

    function = lambda *keys: spark.createDataFrame([("t", list(k), True, None, {}, 1) for k in keys], "tab string, key array<string>, alive boolean, src array<string>, patch map<string,string>, version bigint")
    file = lambda n, lo, hi, **k: DataFile(str(n), 1, {"numRecords": 10, "minValues": lo, "maxValues": hi})
    files = [file(0, {"k": 10}, {"k": 20}), file(1, {"k": 30}, {"k": 40}), file(2, {"k": 90}, {"k": 95})]
    names = lambda fs: " ".join(f.path for f in fs)
    keys, columns = function(["12"], ["50"]), T.StructType.fromDDL("k int")
    money = T.StructType.fromDDL("k decimal(10,2)")
    return said(spark, {
        "ranges": lambda: names(touched_files(keys, ["k"], columns, files)), "key by key": lambda: names(touched_files(keys, ["k"], columns, files, fine_rows=5)),
        "decimals": lambda: names(touched_files(function(["9.00"], ["10.00"]), ["k"], money, [file(0, {"k": "9.00"}, {"k": "9.50"}), file(1, {"k": "8.00"}, {"k": "8.90"})])),
    })


@query("cdc_durable_order", "SELECT * FROM (VALUES (1, NULL), (2, 1), (3, 3)) t(flush, durable)")
def _(spark, sf_dir):
    """A number is durable once all its tables and all transactions before it are written out."""
    at, w, o = scratch(spark, "sync"), SyncWriter(spark), _orders(spark, sf_dir)
    for table, sequence in (("t1", None), ("t2", 1), ("t3", 2), ("t1", None), ("t2", 3)):
        w.put(f"{at}/{table}", _inserts(o.where(f"k % 5 = {sequence or 0}")), [*_K, _V], "A", sequence)
    out = []
    for n in (1, 2, 3):
        w.flush()
        out.append((n, w.durable.get("A")))
    return spark.createDataFrame(out, "flush int, durable int")


@query("stream_stream_join", "SELECT c.event_id AS click, p.event_id AS purchase FROM events c JOIN events p ON c.user_id = p.user_id AND p.ts BETWEEN c.ts AND c.ts + INTERVAL '1 hour' WHERE c.event_type = 'click' AND p.event_type = 'purchase'")
def _(spark, sf_dir):
    """Two streams joined by user and time; watermarks bound what either side keeps."""
    source, out = scratch(spark, "events"), scratch(spark, "joined")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    rows.coalesce(1).write.parquet(source)
    stream = lambda kind, name: spark.readStream.schema(rows.schema).parquet(source).where(F.col("event_type") == kind).select(F.col("event_id").alias(name), F.col("user_id").alias(f"u_{name}"), F.col("ts").alias(f"t_{name}")).withWatermark(f"t_{name}", "2 hours")
    both = stream("click", "click").join(stream("purchase", "purchase"), F.expr("u_click = u_purchase AND t_purchase BETWEEN t_click AND t_click + INTERVAL 1 HOUR"))
    both.select("click", "purchase").writeStream.format("parquet").option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("click bigint, purchase bigint").parquet(out)


QUERIES = {n: f for n, f in _STATEFUL.items() if n not in _BEFORE}
SQL = {n: s for n, s in _STATEFUL_SQL.items() if n not in _BEFORE}

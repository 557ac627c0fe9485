"""External files as relations: Parquet, CSV, NDJSON, Arrow, Avro, versioned tables, and files behind HTTP."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.tokens import SqlError
from tidemark.session import shared_dir
from tidemark.sources.storage import Storage

CHUNK, TTL_SECONDS = 1 << 20, 180


def fetch(spark: SparkSession, url: str, ttl: int = TTL_SECONDS, chunk: int = CHUNK) -> str:
    """Download a file once into the shared folder, by byte ranges where the server has them; the copy's path.

    A copy younger than ttl seconds is used again. The query string belongs to the address. Nothing is read twice: if
    the server ignores ranges, its first answer is the file.
    """
    store = Storage(spark)
    name = url.split("?")[0].rsplit("/", 1)[1] or "file"
    at = f"{shared_dir(spark)}/tidemark/http/{hashlib.sha256(url.encode()).hexdigest()}"
    found = [x for x in store.list(at) if x[0].endswith(name)]
    if found and time.time() * 1000 - found[0][2] < ttl * 1000:
        return found[0][0]
    fs, path = store._at(f"{at}/{name}.part")
    fs.mkdirs(path.getParent())
    out = fs.create(path, True)
    try:
        offset, size = 0, None
        while size is None or offset < size:
            ask = urllib.request.Request(url, headers={"Range": f"bytes={offset}-{offset + chunk - 1}"})
            try:
                with urllib.request.urlopen(ask) as r:  # noqa: S310 - the address is the user's
                    if r.status != 206:
                        while data := r.read(chunk):
                            out.write(bytearray(data))
                        break
                    size = int(r.headers["Content-Range"].rsplit("/", 1)[1])
                    data = r.read()
                    out.write(bytearray(data))
                    offset += len(data)
            except urllib.error.HTTPError as e:
                if e.code == 416:  # an empty file
                    break
                raise SqlError(f"Could not read {url}: {e}") from e
    finally:
        out.close()
    store.delete(f"{at}/{name}")
    store.rename(f"{at}/{name}.part", f"{at}/{name}")
    return f"{at}/{name}"


def _nanosecond_columns(path: str) -> list[str]:
    """Columns with nanosecond timestamps, which Spark does not read; from one footer."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs

    if path.startswith("file:"):
        system, name = fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    else:
        system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    if system.get_file_info(name).type == fs.FileType.Directory:
        files = [f.path for f in system.get_file_info(fs.FileSelector(name)) if f.path.endswith(".parquet")]
        if not files:
            return []
        name = files[0]
    schema = pq.read_schema(name, filesystem=system)
    return [f.name for f in schema if pa.types.is_timestamp(f.type) and f.type.unit == "ns"]


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet files; nanosecond timestamps become microseconds."""
    try:
        nanos = _nanosecond_columns(path)
    except Exception:  # noqa: BLE001 - a storage that pyarrow cannot reach: Spark says what is wrong
        nanos = []
    if not nanos:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    before = spark.conf.get("spark.sql.legacy.parquet.nanosAsLong")
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    try:
        df = spark.read.parquet(path)
    finally:
        spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", before)
    return df.withColumns({c: F.timestamp_micros(F.expr(f"`{c}` div 1000")).cast("timestamp_ntz") for c in nanos})


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """An Arrow IPC file or stream; executors read it batch by batch."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    name = "/" + path[5:].lstrip("/") if path.startswith("file:") else path

    def batches(name: str):
        with pa.OSFile(name) as f:
            try:
                reader = pa.ipc.open_file(f)
                for k in range(reader.num_record_batches):
                    yield reader.get_batch(k)
            except pa.ArrowInvalid:
                f.seek(0)
                yield from pa.ipc.open_stream(f)

    with pa.OSFile(name) as f:
        try:
            schema = pa.ipc.open_file(f).schema
        except pa.ArrowInvalid:
            f.seek(0)
            schema = pa.ipc.open_stream(f).schema
    spark_schema = from_arrow_schema(schema, prefer_timestamp_ntz=True)

    def work(it):
        for b in it:
            for n in b.column(0).to_pylist():
                yield from batches(n)

    return spark.createDataFrame([(name,)], "name string").mapInArrow(work, spark_schema)


def read_external(spark: SparkSession, kind: str, location: str, options: dict[str, str], schema: T.StructType | None = None, partitions: list[str] = ()) -> DataFrame:
    """The relation of CREATE EXTERNAL TABLE … STORED AS kind LOCATION …"""
    kind = kind.upper()
    if location.startswith(("http://", "https://")):
        location = fetch(spark, location)
    if kind == "PARQUET":
        return read_parquet(spark, location, schema)
    if kind == "CSV":
        read = spark.read.option("header", options.get("format.has_header", options.get("has_header", "false")).lower()).option("sep", options.get("format.delimiter", ","))
        read = read.schema(schema) if schema else read.option("inferSchema", True).option("preferDate", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")
        return read.csv(location)
    if kind in ("JSON", "NDJSON"):
        return (spark.read.schema(schema) if schema else spark.read).json(location)
    if kind == "ARROW":
        return read_arrow(spark, location)
    if kind == "AVRO":
        try:
            return spark.read.format("avro").load(location)
        except Exception as e:
            raise SqlError("AVRO files need Spark's avro module") from e
    if kind == "DELTATABLE":
        from tidemark.plans.log import VersionedTable

        return VersionedTable(spark, location).scan()
    if kind == "ICEBERG":
        from tidemark.sources.iceberg import IcebergTable

        return IcebergTable(spark, location).scan()
    raise SqlError(f"Unsupported file type {kind}: expected ARROW, PARQUET, NDJSON, or CSV")


def schema_of_json(text: str) -> T.StructType:
    """The columns of an upload's schema: {"fields": [{"name", "nullable", "type": {"name", …}}]}."""
    kinds = {"utf8": "string", "bool": "boolean", "date": "date", "timestamp": "timestamp_ntz", "largeutf8": "string"}
    fields = []
    for f in json.loads(text)["fields"]:
        t = f["type"]
        name = t["name"].lower()
        if name == "int":
            kind = {8: "tinyint", 16: "smallint", 32: "int", 64: "bigint"}[t.get("bitWidth", 64)]
        elif name == "floatingpoint":
            kind = "float" if t.get("precision", "DOUBLE").upper() == "SINGLE" else "double"
        elif name == "decimal":
            kind = f"decimal({t['precision']},{t['scale']})"
        else:
            kind = kinds[name]
        fields.append(T.StructField(f["name"], T.StructType.fromDDL(f"c {kind}")[0].dataType, f.get("nullable", True)))
    return T.StructType(fields)

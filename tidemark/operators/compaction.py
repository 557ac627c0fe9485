"""Consolidation of very many small files into few well-sized ones (problem 4).

inventory() turns a log of added and removed files into the live files of the listed tables, whatever the spelling;
plan_groups() assigns small files to output groups, longest first to the least loaded; compact() streams each group
through pyarrow into one file and publishes a verified manifest that is there whole or not at all.
"""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.identifiers import address_root, address_segments
from tidemark.operators.drift import common_type
from tidemark.session import materialize
from tidemark.sources.storage import Storage

#: A file below this size is small.
SMALL_BYTES = 1 << 20
#: Size that an output file should have.
TARGET_BYTES = 128 << 20
#: Files that one scheduling task may get; a table with more is cut into shards.
SHARD_FILES = 20_000


def table_roots(tables: DataFrame, stores: DataFrame) -> DataFrame:
    """(path, root, segments, depth): each table's path with the root and all segments of its absolute address.

    A null store means 'default'. Tables in a store that is not listed, and tables without a path, are left out.
    """
    t = tables.where("path IS NOT NULL").select("path", F.coalesce("store", F.lit("default")).alias("store")).distinct()
    s = stores.select(F.col("name").alias("store"), "location").distinct()
    own = address_segments(F.col("path"))
    placed = t.join(s, "store")
    segments = F.concat(address_segments(F.col("location")), own)
    return placed.select("path", address_root(F.col("location")).alias("root"), segments.alias("segments"), own.alias("own"))


def resolve_tables(rows: DataFrame, address: str, tables: DataFrame, stores: DataFrame, store: str | None = None) -> DataFrame:
    """rows with table_path: the path, as in tables, of the table that an address names in any spelling, else null.

    A relative address is looked up by its path; if rows have a column store, in that store only.
    """
    names = rows.columns
    place = {n: f"c{i}" for i, n in enumerate(names)}
    rows = rows.toDF(*place.values())
    at, join = F.col(place[address]), lambda *c: F.array_join(F.concat(*c), "\u0001")
    roots = table_roots(tables, stores)
    known = roots.select("path", join(F.array("root"), F.col("segments")).alias("key"))
    if store is None:
        known = known.unionByName(roots.select("path", join(F.col("own")).alias("key")))
        relative = join(address_segments(at))
    else:
        s = stores.select(F.col("name").alias("store_name"), join(F.array(address_root(F.col("location"))), address_segments(F.col("location"))).alias("base")).distinct()
        rows = rows.join(s, F.coalesce(F.col(place[store]), F.lit("default")) == F.col("store_name"), "left")
        relative = F.concat_ws("\u0001", "base", join(address_segments(at)))
    whole = join(F.array(address_root(at)), address_segments(at))
    rows = rows.withColumn("named", F.when(address_root(at).isNotNull(), whole).otherwise(relative))
    # Written, so that its size is known: Spark broadcasts it if it is small and shuffles otherwise.
    known = materialize(known.groupBy("key").agg(F.min("path").alias("table_path")), "known")
    found = rows.join(known, F.col("named") == F.col("key"), "left")
    return found.select(*place.values(), "table_path").toDF(*names, "table_path")


def inventory(entries: DataFrame, tables: DataFrame, stores: DataFrame) -> DataFrame:
    """One row for each data file that the log names: table_path, url, live, size_bytes, num_records, entry_id.

    entries: entry_id, path, action ('add' or 'remove'), commit_version, size_bytes, num_records. A path is relative
    to the store of the table it lies below, or an absolute URL; see functions.identifiers for what counts as the
    same address. A data file lies below a table of tables, ends in .parquet, and no folder between starts with an
    underscore; other entries are left out, as are rows whose path, action or commit_version is null.
    live: the entry with the highest commit_version (then entry_id) is an add; size and records are those of that
    entry. entry_id: the smallest of the file's add entries. Tables may lie in each other; the innermost one counts.
    """
    roots = table_roots(tables, stores)
    keys = roots.select("path", "root", "segments", F.array_join(F.concat(F.array("root"), F.col("segments")), "/").alias("_key"), F.size("segments").alias("_depth"), F.size("segments").alias("_cut"))
    keys = keys.unionByName(roots.select("path", "root", "segments", F.concat(F.lit("./"), F.array_join("own", "/")).alias("_key"), F.size("segments").alias("_depth"), F.size("own").alias("_cut")))
    keys = materialize(keys.groupBy("_key").agg(F.min(F.struct("path", "root", "segments", "_depth", "_cut")).alias("_t")), "tables")

    e = entries.where("path IS NOT NULL AND action IN ('add', 'remove') AND commit_version IS NOT NULL")
    e = e.select("entry_id", "action", "commit_version", "size_bytes", "num_records", F.coalesce(address_root(F.col("path")), F.lit(".")).alias("_root"), address_segments(F.col("path")).alias("_segs"))
    e = e.where(F.element_at("_segs", -1).endswith(".parquet") & (F.size("_segs") > 1))
    # Tables lie at few depths; only an address's beginnings of those lengths can name one.
    depths = sorted(r[0] for r in keys.select("_t._cut").distinct().collect())
    depth = F.filter(F.array(*[F.lit(d) for d in depths]).cast("array<int>"), lambda d: (d > 0) & (d < F.size("_segs")))
    above = F.transform(depth, lambda d: F.concat(F.col("_root"), F.lit("/"), F.array_join(F.slice("_segs", F.lit(1), d), "/")))
    found = e.withColumn("_above", F.explode(above)).join(keys, F.col("_above") == F.col("_key"))
    # Below the table come folders and the name; the whole address is the table's, then those.
    below = F.slice("_segs", F.col("_t._cut") + 1, F.size("_segs"))
    folders = F.slice(below, 1, F.size(below) - 1)
    url = F.concat(F.col("_t.root"), F.lit("/"), F.array_join(F.concat(F.col("_t.segments"), below), "/"))
    placed = found.select("entry_id", "action", "commit_version", "size_bytes", "num_records", F.col("_t.path").alias("table_path"), F.col("_t._depth").alias("_depth"), url.alias("url"), F.exists(folders, lambda s: s.startswith("_")).alias("_hidden"))
    last = F.struct("commit_version", "entry_id")
    grown = placed.groupBy("url").agg(
        F.max_by(F.struct("table_path", "_hidden"), "_depth").alias("_t"),
        F.max_by("action", last).alias("_action"),
        F.max_by("size_bytes", last).alias("size_bytes"),
        F.max_by("num_records", last).alias("num_records"),
        F.min(F.when(F.col("action") == "add", F.col("entry_id"))).alias("entry_id"),
    )
    return grown.where("NOT _t._hidden").select("_t.table_path", "url", (F.col("_action") == "add").alias("live"), "size_bytes", "num_records", "entry_id")


def schedule(sizes: list[int], groups: int) -> list[int]:
    """The group of each file: longest first, each to the least loaded group so far (ties: lowest group number)."""
    heap = [(0, g) for g in range(groups)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, g = heap[0]
        heapq.heapreplace(heap, (load + sizes[i], g))
        out[i] = g
    return out


def plan_groups(files: DataFrame, keys: list[str], size: str, order: str, target: int = TARGET_BYTES, shard_files: int = SHARD_FILES) -> DataFrame:
    """files with shard and group_no: the output file, within keys, that each is merged into.

    A key with more than shard_files files is cut by hash of order into shards, so that no task schedules an unbounded
    list. Each shard has ceil(bytes / target) groups, one at least; a null size counts as 0. order must be unique
    within keys and decides ties. No files give an empty plan.
    """
    names = files.columns
    place = {n: f"c{i}" for i, n in enumerate(names)}
    rows, by = files.toDF(*place.values()), [place[k] for k in keys]
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(*[F.col(k).alias(f"k_{k}") for k in by], F.ceil(F.col("n") / shard_files).cast("int").alias("shards"))
    sharded = rows.join(materialize(counts, "counts"), [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in by])
    sharded = sharded.withColumn("shard", F.expr(f"pmod(xxhash64({place[order]}), shards)").cast("int")).select(*rows.columns, "shard")
    schema = T.StructType(sharded.schema.fields + [T.StructField("group_no", T.IntegerType())])

    def assign(t: pa.Table) -> pa.Table:
        t = t.sort_by(place[order])
        sizes = [n or 0 for n in t.column(place[size]).to_pylist()]
        n = max(1, -(-sum(sizes) // target))
        return t.append_column("group_no", pa.array(schedule(sizes, n), pa.int32()))

    return sharded.groupBy(*by, "shard").applyInArrow(assign, schema).toDF(*names, "shard", "group_no")


def merge_files(paths: list[str], out: str) -> tuple[int, int, pa.Schema]:
    """Stream Parquet files, batch by batch, into one at out; rows read, rows written (as the new footer says), columns.

    Files whose columns differ get all of them, in the wider type; missing ones are null, types that have no wider one
    are an error. Empty files add nothing.
    """
    import pyarrow.dataset as ds
    import pyarrow.parquet as pq
    from pyarrow import fs

    def at(path: str):
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))

    system, target = at(out)
    sources = [at(p) for p in paths]
    schema = pa.unify_schemas([pq.read_schema(name, filesystem=f) for f, name in sources], promote_options="permissive")
    read, aside = 0, f"{target}.{uuid.uuid4().hex}.tmp"
    system.create_dir(target.rsplit("/", 1)[0], recursive=True)
    writer = pq.ParquetWriter(aside, schema, filesystem=system, compression="zstd")
    for f, name in sources:
        for batch in ds.dataset(name, filesystem=f, format="parquet", schema=schema).to_batches(batch_size=65_536):
            read += batch.num_rows
            writer.write_batch(batch)
    writer.close()
    written = pq.ParquetFile(aside, filesystem=system).metadata.num_rows
    system.move(aside, target)
    return read, written, schema


def compact(spark: SparkSession, plan: DataFrame, address: str, records: str, keys: list[str], out_dir: str) -> DataFrame:
    """Merge each group of a plan (see plan_groups) and publish the manifest; the rows of all merged files.

    address: the column with each file's URL; records: the number of rows its log entry gives, or null if unknown.
    Each group becomes one file <key hash>-<shard>-<group>.parquet in a folder of this attempt. Before anything is published
    it is verified that each group wrote as many rows as it read, and as its files' entries say. The manifest names the
    merged files' table and their united columns and is created with put-if-absent: until then readers see the old files,
    afterwards only the new ones. A retried task overwrites its own group's file, so lost executors do no harm; what an
    attempt leaves that was refused or was second is in no manifest and is never read.
    """
    attempt = f"{out_dir}/attempt-{uuid.uuid4().hex}"
    grouped = plan.groupBy(*keys, "shard", "group_no").agg(F.collect_list(F.struct(address, records)).alias("files"))
    grouped = grouped.select(F.abs(F.xxhash64(*keys)).alias("k"), "shard", "group_no", F.sort_array("files").alias("files"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import from_arrow_schema

        for b in batches:
            for r in b.to_pylist():
                out = f"{attempt}/{r['k']}-{r['shard']}-{r['group_no']}.parquet"
                read, written, columns = merge_files([f[address] for f in r["files"]], out)
                said = [f[records] for f in r["files"]]
                ok = read == written and (None in said or sum(said) == read)
                names = from_arrow_schema(columns, prefer_timestamp_ntz=True).json()
                yield pa.RecordBatch.from_pylist([{"path": out, "files": len(r["files"]), "rows_in": read, "rows_out": written, "ok": ok, "columns": names}])

    done = grouped.mapInArrow(work, "path string, files bigint, rows_in bigint, rows_out bigint, ok boolean, columns string")
    done.write.parquet(f"{attempt}/_groups")
    done = spark.read.parquet(f"{attempt}/_groups")
    if bad := done.where("NOT ok").drop("columns").limit(5).collect():
        raise ValueError(f"merged files do not hold the rows of their sources: {bad}")
    total = done.agg(F.count(F.lit(1)), F.sum("files"), F.sum("rows_out")).head()
    columns = _united([T.StructType.fromJson(json.loads(r[0])) for r in done.groupBy("columns").agg(F.min("path").alias("p")).orderBy("p").toLocalIterator()])
    manifest = {"groups": f"{attempt}/_groups", "columns": columns.jsonValue(), "files_out": total[0], "files_in": total[1] or 0, "rows": total[2] or 0}
    if not Storage(spark).put_if_absent(f"{out_dir}/manifest.json", json.dumps(manifest)):
        raise RuntimeError(f"{out_dir} has a manifest already")
    return read_manifest(spark, out_dir)


def _united(schemas: list[T.StructType]) -> T.StructType:
    """All columns of the groups' files, in order of appearance, each in a type that all its versions can be read as."""
    fields: dict[str, T.DataType] = {}
    for s in schemas:
        for f in s.fields:
            kind = common_type(fields[f.name], f.dataType) if f.name in fields else f.dataType
            if isinstance(kind, T.StringType) and f.name in fields and fields[f.name] != f.dataType:
                raise ValueError(f"column {f.name} has types without a wider one: {fields[f.name].simpleString()}, {f.dataType.simpleString()}")
            fields[f.name] = kind
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def read_manifest(spark: SparkSession, out_dir: str) -> DataFrame:
    """The rows of the files that a published manifest names, and of no others, with all their columns."""
    store = Storage(spark)
    if not store.exists(f"{out_dir}/manifest.json"):
        raise FileNotFoundError(f"{out_dir} has no manifest")
    manifest = json.loads(store.read_text(f"{out_dir}/manifest.json"))
    columns = T.StructType.fromJson(manifest["columns"])
    paths = [r[0] for r in spark.read.parquet(manifest["groups"]).select("path").toLocalIterator()]
    return spark.read.schema(columns).parquet(*paths) if paths else spark.createDataFrame([], columns)

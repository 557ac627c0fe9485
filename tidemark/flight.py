"""Arrow Flight: queries as record batches, and change-stream messages, over pyarrow's Flight server.

Commands are the public Flight SQL statement query (a protobuf Any), a sync command, or plain SQL text. A ticket can be
used once. Query results are written once to shared storage by the executors and streamed from there, so that no result
has to fit into the driver's memory.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.flight as fl
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.plans.engine import Engine
from tidemark.plans.tokens import SqlError
from tidemark.session import scratch
from tidemark.streaming.sync import CHANGED, NEW_PK, OLD_PK, VALUE, Column, SyncWriter

# The order of roles in the sync message, and the name of the statement query's type.
ROLES = [OLD_PK, NEW_PK, CHANGED, VALUE]
STATEMENT = "CommandStatementQuery"
SYNC = "DataSyncCommand"


def read_message(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: numbers for varints, bytes for nested ones."""
    i = 0

    def varint() -> int:
        nonlocal i
        n = shift = 0
        while True:
            b = raw[i]
            i += 1
            n |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return n

    while i < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            if i + size > len(raw):
                raise ValueError("truncated message")
            yield tag >> 3, raw[i : i + size]
            i += size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield tag >> 3, raw[i : i + size]
            i += size
        else:
            raise ValueError(f"unknown wire type {kind}")


def write_message(fields: list[tuple[int, int | bytes | None]]) -> bytes:
    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 0x7F:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        out.append(n)
        return bytes(out)

    out = b""
    for number, v in fields:
        if v is not None:
            out += varint(number << 3) + varint(int(v)) if isinstance(v, int) else varint(number << 3 | 2) + varint(len(v)) + v
    return out


def unpack(raw: bytes) -> tuple[str, bytes]:
    """The type's name and the content of a protobuf Any; plain text is a statement query."""
    try:
        fields = dict(read_message(raw))
        name = fields[1].decode()
        if "/" in name:
            return name.rsplit("/", 1)[1].rsplit(".", 1)[-1], fields.get(2, b"")
    except (ValueError, KeyError, IndexError, UnicodeDecodeError, AttributeError):
        pass
    return STATEMENT, write_message([(1, raw)])


def pack(name: str, content: bytes) -> bytes:
    return write_message([(1, f"type.googleapis.com/{name}".encode()), (2, content)])


def read_sync_command(raw: bytes) -> dict:
    out: dict = {"path": "", "descriptors": [], "origin": "", "sequence": None, "location": ""}
    for number, v in read_message(raw):
        if number == 1:
            out["path"] = v.decode()
        elif number == 2:
            store = dict(read_message(v))
            out["location"] = store.get(2, b"").decode() if isinstance(store.get(2, b""), bytes) else ""
        elif number == 3:
            d = dict(read_message(v))
            out["descriptors"].append(Column(ROLES[d.get(1, 0)], d.get(2, b"").decode()))
        elif number == 4:
            out["origin"] = v.decode()
        elif number == 5:
            out["sequence"] = v
    return out


class _Headers(fl.ServerMiddleware):
    def __init__(self, headers: dict):
        self.headers = {k.lower(): v[0] for k, v in headers.items()}


class _HeadersFactory(fl.ServerMiddlewareFactory):
    def start_call(self, info, headers):
        return _Headers(headers)


class FlightServer(fl.FlightServerBase):
    """get_flight_info with a query, then do_get with its ticket; do_put with a sync command."""

    def __init__(self, engine: Engine, location: str = "grpc://127.0.0.1:0", writer: SyncWriter | None = None):
        super().__init__(location, middleware={"headers": _HeadersFactory()})
        self.engine, self.at, self.writer = engine, location, writer or SyncWriter(engine.spark)
        self.results: dict[bytes, tuple[pa.Schema, str | None]] = {}

    def _context(self, context) -> Engine:
        h = context.get_middleware("headers").headers if context is not None else {}
        return self.engine.scope_to(h.get("database"), h.get("search-path"))

    def get_flight_info(self, context, descriptor):
        name, content = unpack(descriptor.command)
        if name != STATEMENT:
            raise fl.FlightServerError(f"Unsupported command {name}")
        query = dict(read_message(content))[1].decode()
        try:
            df = self._context(context).sql(query)
            ticket = uuid.uuid4().hex.encode()
            if df is None:
                schema, path = pa.schema([]), None
            else:
                schema, path = to_arrow_schema(df.schema), scratch(self.engine.spark, "result")
                df.write.parquet(path)
        except Exception as e:
            raise fl.FlightServerError(str(e)) from e
        self.results[ticket] = (schema, path)
        return fl.FlightInfo(schema, descriptor, [fl.FlightEndpoint(ticket, [])], -1, -1)

    def do_get(self, context, ticket):
        if ticket.ticket not in self.results:
            raise fl.FlightServerError(f"No results found for query id {ticket.ticket.decode()}")
        schema, path = self.results.pop(ticket.ticket)
        if path is None:
            return fl.RecordBatchStream(pa.Table.from_batches([], schema))

        def batches() -> Iterator[pa.RecordBatch]:
            system, name = _open(path)
            for b in ds.dataset(name, filesystem=system, format="parquet", exclude_invalid_files=False).to_batches():
                if b.num_rows:
                    yield pa.Table.from_batches([b]).cast(schema).combine_chunks().to_batches()[0]
            self.engine.store.delete(path)

        return fl.GeneratorStream(schema, batches())

    def do_put(self, context, descriptor, reader, writer):
        name, content = unpack(descriptor.command)
        if name != SYNC:
            raise fl.FlightServerError(f"Unsupported command {name}")
        command = read_sync_command(content)
        rows = reader.read_all()
        path = f"{command['location'].rstrip('/') or self.engine.root}/{command['path']}"
        df = None
        if rows.num_rows:
            # Descriptors tell the columns apart, their names need not.
            named = rows.rename_columns([f"f{k}" for k in range(rows.num_columns)]).append_column("_row", pa.array(range(rows.num_rows), pa.int64()))
            df = self.engine.spark.createDataFrame(named)
        try:
            r = self.writer.put(path, df, command["descriptors"], command["origin"], command["sequence"], rows.num_rows)
        except SqlError as e:
            raise fl.FlightServerError(str(e)) from e
        writer.write(write_message([(1, int(r.accepted)), (2, r.memory_sequence_number), (3, r.durable_sequence_number), (4, int(r.first))]))


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

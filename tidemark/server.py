"""HTTP: cacheable read queries, reads and writes by POST, uploads, and health."""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.parse
from collections.abc import Iterable
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.auth import AuthError, Policy, allowed, bearer, principal_of
from tidemark.plans.engine import Engine
from tidemark.plans.tokens import statements
from tidemark.sources.external import schema_of_json
from tidemark.session import scratch

MAX_UPLOAD = 256 << 20


@dataclass
class Answer:
    status: int
    body: Iterable[bytes] = ()
    headers: dict[str, str] = field(default_factory=dict)


def _text(status: int, text: str) -> Answer:
    return Answer(status, [text.encode()])


def ndjson(df: DataFrame) -> Iterable[bytes]:
    """Rows as JSON lines with explicit nulls, made by the executors and passed on partition by partition."""
    if not df.columns:
        return
    names = [f"c{k}" for k in range(len(df.columns))]
    renamed = df.toDF(*names).select(F.to_json(F.struct(*[F.col(n).alias(c) for n, c in zip(names, df.columns)]), {"ignoreNullFields": "false"}))
    for r in renamed.toLocalIterator(prefetchPartitions=True):
        yield r[0].encode() + b"\n"


class Service:
    """Requests to answers, without sockets; the handler below connects it to HTTP."""

    def __init__(self, engine: Engine, policy: Policy = Policy(), cache_control: str = "max-age=43200, public"):
        self.engine, self.policy, self.cache_control = engine, policy, cache_control
        self.counters: dict[str, int] = {}

    def handle(self, method: str, path: str, headers: dict[str, str], body: bytes = b"") -> Answer:
        began = time.time()
        headers = {k.lower(): v for k, v in headers.items()}
        try:
            answer = self._route(method, path, headers, body)
        except AuthError as e:
            answer = _text(e.status, e.code)
        except FileNotFoundError:
            answer = _text(404, "NOT_FOUND")
        except OSError as e:
            answer = _text(500, str(e))
        except Exception as e:  # noqa: BLE001 - whatever a query raises is the caller's to see
            answer = _text(400, str(e))
        answer.headers |= {"access-control-allow-origin": "*", "access-control-max-age": "86400", "x-tidemark-query-time": str(int((time.time() - began) * 1000))}
        key = f"{method} {answer.status}"
        self.counters[key] = self.counters.get(key, 0) + 1
        return answer

    def _route(self, method: str, path: str, headers: dict[str, str], body: bytes) -> Answer:
        if path in ("/healthz", "/readyz") and method == "GET":
            return _text(200, "ready")
        if path == "/metrics" and method == "GET":
            return _text(200, "".join(f'tidemark_http_requests_total{{request="{k}"}} {v}\n' for k, v in sorted(self.counters.items())))
        if method == "OPTIONS":
            return Answer(204, [], {"access-control-allow-methods": "GET, POST, OPTIONS", "access-control-allow-headers": "*"})
        if m := re.fullmatch(r"(?:/([^/]+))?/q", path):
            if method == "POST":
                return self._post(m[1], headers, body)
        if (m := re.fullmatch(r"(?:/([^/]+))?/q/(.+)", path)) and method == "GET":
            return self._get(m[1], m[2], headers, body)
        if (m := re.fullmatch(r"(?:/([^/]+))?/upload/([^/]+)/([^/]+)", path)) and method == "POST":
            return self._upload(m[1], m[2], m[3], headers, body)
        return _text(404, "NOT_FOUND")

    def _may(self, action: str, headers: dict[str, str]) -> None:
        who = principal_of(bearer(headers.get("authorization")), self.policy)
        if not allowed(who, action, self.policy):
            raise AuthError(403, "READ_FORBIDDEN" if action == "read" else "WRITE_FORBIDDEN")

    def _scoped(self, database: str | None) -> Engine:
        return self.engine.scope_to(database) if database else self.engine

    def _rows(self, df: DataFrame | None, extra: dict[str, str] | None = None) -> Answer:
        if df is None:
            return Answer(200, [], extra or {})
        lines = iter(ndjson(df))
        head = next(lines, None)  # an error comes before the first byte
        schema = urllib.parse.quote(json.dumps({"fields": [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for f in df.schema.fields]}))

        def stream() -> Iterable[bytes]:
            if head is not None:
                yield head
                yield from lines

        return Answer(200, stream(), {"content-type": f"application/json; arrow-schema={schema}", **(extra or {})})

    def _post(self, database: str | None, headers: dict[str, str], body: bytes) -> Answer:
        try:
            text = json.loads(body)["query"]
        except (ValueError, KeyError, TypeError) as e:
            return _text(400, f"No query found in the request: {e!r}")
        engine = self._scoped(database)
        parts = statements(text)
        if not parts:
            return _text(400, "Empty query received")
        reads = [engine.is_read(p) for p in parts]
        self._may("read" if all(reads) else "write", headers)
        if sum(reads) > 1 or (any(reads) and not reads[-1]):
            return _text(400, "Only one read statement is allowed and it must be at the end of a multi-statement query")
        out = None
        for p in parts:
            out = engine.statement(p)
        return self._rows(out)

    def _get(self, database: str | None, part: str, headers: dict[str, str], body: bytes) -> Answer:
        if self.policy.read == "off":
            return _text(405, "READ_ONLY_ENDPOINT_DISABLED")
        self._may("read", headers)
        name = re.sub(r"\.[A-Za-z0-9]+$", "", part)
        if re.fullmatch(r"[0-9a-fA-F]{64}", name):
            text = urllib.parse.unquote(headers["x-tidemark-query"]) if "x-tidemark-query" in headers else json.loads(body)["query"] if body else None
            if text is None:
                return _text(400, "No query found in the request")
            digest = hashlib.sha256(text.encode()).hexdigest()
            if digest != name.lower():
                return _text(400, f'Invalid hash: expected "{digest}", got "{name}". Resend your query with "{digest}"')
        else:
            text = urllib.parse.unquote(part)
        engine = self._scoped(database)
        parts = statements(text)
        if len(parts) != 1 or not engine.is_read(parts[0]):
            return _text(405, "NOT_READ_ONLY_QUERY")
        df = engine.statement(parts[0])
        tag = '"' + hashlib.sha256(json.dumps([text, sorted(engine.last_reads), self._mtimes(df)]).encode()).hexdigest() + '"'
        cache = {"etag": tag, "cache-control": self.cache_control, "vary": "authorization, content-type, origin, x-tidemark-query"}
        if headers.get("if-none-match", "").strip() == tag:
            return Answer(304, [], cache)
        return self._rows(df, cache)

    def _mtimes(self, df: DataFrame) -> list:
        """Files of external tables with their times, so that a change of theirs changes the tag."""
        out = []
        for f in df.inputFiles():
            try:
                fs, p = self.engine.store._at(f)
                out.append((f, fs.getFileStatus(p).getModificationTime()))
            except Exception:  # noqa: BLE001 - a source without files
                continue
        return sorted(out)

    def _upload(self, database: str | None, schema: str, table: str, headers: dict[str, str], body: bytes) -> Answer:
        self._may("write", headers)
        if len(body) > MAX_UPLOAD:
            return _text(413, "Upload is too large")
        m = re.search(r'boundary="?([^";]+)"?', headers.get("content-type", ""))
        parts = multipart(body, m[1].encode()) if m else {}
        given = parts.get("data") or parts.get("file")
        if given is None:
            return _text(400, "No part containing file found in the request!")
        filename, content = given
        if not filename:
            return _text(400, "No filename found in the request!")
        if "." not in filename:
            return _text(400, f"File {filename} missing extension")
        kind = filename.rsplit(".", 1)[1].lower()
        if kind not in ("csv", "parquet"):
            return _text(400, f"File {filename} not supported")
        header = parts.get("has_header", ("", b"true"))[1].decode().strip().lower()
        if header not in ("true", "false"):
            return _text(400, "Invalid has_header")
        columns = None
        if "schema" in parts:
            try:
                columns = schema_of_json(parts["schema"][1].decode())
            except (ValueError, KeyError) as e:
                return _text(400, f"Error parsing the file schema: {e}")
        engine = self._scoped(database)
        at = scratch(engine.spark, "upload") + "." + kind
        fs, p = engine.store._at(at)
        fs.mkdirs(p.getParent())
        out = fs.create(p, True)
        out.write(bytearray(content))
        out.close()
        read = engine.spark.read
        if kind == "csv":
            read = read.option("header", header)
            existing = engine.catalog.state()["databases"][engine.db]["schemas"].get(schema, {}).get(table)
            if existing and columns is None:
                columns = engine.table(f'"{schema}"."{table}"').snapshot().schema
            df = (read.schema(columns) if columns else read.option("inferSchema", True)).csv(at)
        else:
            df = read.parquet(at)
        engine.upload(schema, table, df)
        return _text(200, "done")


def multipart(body: bytes, boundary: bytes) -> dict[str, tuple[str, bytes]]:
    """Part name -> (file name or '', content) of a multipart form."""
    out = {}
    for part in body.split(b"--" + boundary)[1:-1]:
        head, _, content = part.partition(b"\r\n\r\n")
        text = head.decode("utf-8", "replace")
        name, file = re.search(r'[; ]name="([^"]*)"', text), re.search(r'filename="([^"]*)"', text)
        if name:
            out[name[1]] = (file[1] if file else "", content[:-2] if content.endswith(b"\r\n") else content)
    return out


def serve(service: Service, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server that is ready to run; call serve_forever."""

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def _do(self) -> None:
            size = int(self.headers.get("content-length") or 0)
            answer = service.handle(self.command, self.path, dict(self.headers), self.rfile.read(size) if size else b"")
            self.send_response(answer.status)
            for k, v in answer.headers.items():
                self.send_header(k, v)
            if answer.status in (204, 304):
                self.end_headers()
                return
            self.send_header("transfer-encoding", "chunked")
            self.end_headers()
            for chunk in answer.body:
                self.wfile.write(f"{len(chunk):x}\r\n".encode() + chunk + b"\r\n")
            self.wfile.write(b"0\r\n\r\n")

        do_GET = do_POST = do_OPTIONS = _do  # noqa: N815

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


__all__ = ["Answer", "Service", "multipart", "ndjson", "serve"]

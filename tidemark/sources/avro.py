"""Avro object container files, as the public specification describes them: enough for table manifests."""

from __future__ import annotations

import io
import json
import os
import struct
import zlib

MAGIC = b"Obj\x01"


class _Reader:
    def __init__(self, raw: bytes):
        self.raw, self.i = raw, 0

    def take(self, n: int) -> bytes:
        out = self.raw[self.i : self.i + n]
        if len(out) < n:
            raise ValueError("truncated Avro data")
        self.i += n
        return out

    def long(self) -> int:
        n = shift = 0
        while True:
            b = self.take(1)[0]
            n |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return (n >> 1) ^ -(n & 1)

    def blocks(self):
        """Item counts of an array or map."""
        while n := self.long():
            if n < 0:
                n = -n
                self.long()
            yield n

    def value(self, schema):
        if isinstance(schema, list):
            return self.value(schema[self.long()])
        kind = schema if isinstance(schema, str) else schema["type"]
        if isinstance(kind, (dict, list)):
            return self.value(kind)
        if kind == "null":
            return None
        if kind == "boolean":
            return self.take(1) == b"\x01"
        if kind in ("int", "long"):
            return self.long()
        if kind == "float":
            return struct.unpack("<f", self.take(4))[0]
        if kind == "double":
            return struct.unpack("<d", self.take(8))[0]
        if kind == "bytes":
            return self.take(self.long())
        if kind == "string":
            return self.take(self.long()).decode()
        if kind == "fixed":
            return self.take(schema["size"])
        if kind == "enum":
            return schema["symbols"][self.long()]
        if kind == "array":
            return [self.value(schema["items"]) for n in self.blocks() for _ in range(n)]
        if kind == "map":
            return {self.take(self.long()).decode(): self.value(schema["values"]) for n in self.blocks() for _ in range(n)}
        if kind == "record":
            return {f["name"]: self.value(f["type"]) for f in schema["fields"]}
        raise ValueError(f"unknown Avro type {kind}")


def _named(schema, known: dict):
    """The schema with references to named types replaced by the types."""
    if isinstance(schema, str):
        return known.get(schema, schema)
    if isinstance(schema, list):
        return [_named(s, known) for s in schema]
    out = dict(schema)
    if out.get("type") == "record":
        out["fields"] = [{**f, "type": _named(f["type"], known)} for f in out["fields"]]
    for key in ("items", "values"):
        if key in out:
            out[key] = _named(out[key], known)
    if isinstance(out.get("type"), (dict, list)):
        out["type"] = _named(out["type"], known)
    if "name" in out and out.get("type") in ("record", "fixed", "enum"):
        known[out["name"]] = out
    return out


def read_container(raw: bytes) -> tuple[dict[str, bytes], list[dict]]:
    """The metadata and the records of a container file."""
    r = _Reader(raw)
    if r.take(4) != MAGIC:
        raise ValueError("no Avro container")
    meta = r.value({"type": "map", "values": "bytes"})
    schema, codec = _named(json.loads(meta["avro.schema"]), {}), meta.get("avro.codec", b"null")
    mark, rows = r.take(16), []
    while r.i < len(raw):
        count, size = r.long(), r.long()
        block = r.take(size)
        if codec == b"deflate":
            block = zlib.decompress(block, -15)
        elif codec != b"null":
            raise ValueError(f"unknown Avro codec {codec}")
        b = _Reader(block)
        rows += [b.value(schema) for _ in range(count)]
        if r.take(16) != mark:
            raise ValueError("broken Avro block")
    return meta, rows


def _long(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _put(out: io.BytesIO, schema, v) -> None:
    if isinstance(schema, list):
        k = schema.index("null") if v is None else next(i for i, s in enumerate(schema) if s != "null")
        out.write(_long(k))
        _put(out, schema[k], v)
        return
    kind = schema if isinstance(schema, str) else schema["type"]
    if kind == "null":
        return
    if kind == "boolean":
        out.write(b"\x01" if v else b"\0")
    elif kind in ("int", "long"):
        out.write(_long(v))
    elif kind in ("string", "bytes"):
        raw = v.encode() if isinstance(v, str) else v
        out.write(_long(len(raw)) + raw)
    elif kind == "record":
        for f in schema["fields"]:
            _put(out, f["type"], v[f["name"]])
    elif kind == "array":
        if v:
            out.write(_long(len(v)))
            for x in v:
                _put(out, schema["items"], x)
        out.write(b"\0")
    else:
        raise ValueError(f"Avro type {kind} is not written")


def write_container(schema: dict, rows: list[dict], meta: dict[str, str]) -> bytes:
    out, body, mark = io.BytesIO(), io.BytesIO(), os.urandom(16)
    for r in rows:
        _put(body, schema, r)
    out.write(MAGIC)
    head = {"avro.schema": json.dumps(schema), "avro.codec": "null", **meta}
    out.write(_long(len(head)))
    for k, v in head.items():
        out.write(_long(len(k)) + k.encode() + _long(len(v.encode())) + v.encode())
    out.write(b"\0" + mark)
    if rows:
        out.write(_long(len(rows)) + _long(body.tell()) + body.getvalue() + mark)
    return out.getvalue()

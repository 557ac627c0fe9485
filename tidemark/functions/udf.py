"""Named scalar functions kept in the catalogue as JSON and run vectorized over Arrow batches."""

from __future__ import annotations

import base64
import json
import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.plans.tokens import SqlError

# Argument and return types of the function format, letter case aside.
TYPES = {
    "SMALLINT": "smallint", "INT": "int", "BIGINT": "bigint", "CHAR": "string", "VARCHAR": "string", "TEXT": "string", "FLOAT": "float", "REAL": "float", "DOUBLE": "double",
    "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "I32": "int", "I64": "bigint", "F32": "float", "F64": "double",
}
LANGUAGES = ("wasm", "wasmMessagePack", "python")


def spark_type(name: str) -> str:
    up = name.strip().upper()
    if m := re.fullmatch(r"DECIMAL\s*[({]\s*(\d+)\s*,\s*(\d+)\s*[)}]", up):
        return f"decimal({m[1]},{m[2]})"
    if up not in TYPES:
        raise SqlError(f"Error deserializing function: unknown type {name}")
    return TYPES[up]


def read_definition(text: str) -> dict:
    """The checked definition from its JSON; language and volatility have defaults."""
    try:
        d = json.loads(text)
        body = {
            "entrypoint": d["entrypoint"], "language": d.get("language", "wasmMessagePack"), "input_types": [spark_type(t) for t in d["input_types"]],
            "return_type": spark_type(d["return_type"]), "data": d["data"], "volatility": d.get("volatility", "Volatile"),
        }
    except SqlError:
        raise
    except (ValueError, KeyError, TypeError) as e:
        raise SqlError(f"Error deserializing function: {e}") from e
    if body["language"] not in LANGUAGES:
        raise SqlError(f"Error deserializing function: unknown language {body['language']}")
    return body


def _python_entry(body: dict):
    scope: dict = {}
    exec(compile(base64.b64decode(body["data"]), body["entrypoint"], "exec"), scope)  # noqa: S102 - the catalogue's writers define functions
    if not callable(scope.get(body["entrypoint"])):
        raise SqlError(f'Function "{body["entrypoint"]}" is not in the module')
    return scope[body["entrypoint"]]


def _wasm_entry(body: dict):
    """Row-wise numbers through a WebAssembly runtime, where one is installed."""
    raw = base64.b64decode(body["data"])
    if raw[:4] != b"\0asm":
        raise SqlError("Error loading WASM module: failed to parse WebAssembly module")
    if body["language"] == "wasmMessagePack":
        raise SqlError("wasmMessagePack functions need a runtime that is not installed")
    try:
        import wasmtime
    except ImportError as e:
        raise SqlError("WASM functions need the wasmtime package") from e
    store = wasmtime.Store()
    instance = wasmtime.Instance(store, wasmtime.Module(store.engine, raw), [])
    call = instance.exports(store)[body["entrypoint"]]
    return lambda *cols: type(cols[0])([call(store, *row) for row in zip(*cols)])


def validate(name: str, body: dict) -> None:
    """Load the function once, so that a definition that cannot run is refused."""
    try:
        (_python_entry if body["language"] == "python" else _wasm_entry)(body)
    except SqlError as e:
        raise SqlError(f'Internal error: Error initializing {"Python" if body["language"] == "python" else "WASM + MessagePack" if body["language"] == "wasmMessagePack" else "WASM"} UDF "{name}": Internal("{e}")') from e
    except Exception as e:  # noqa: BLE001 - anything the module does at load time
        raise SqlError(f'Internal error: Error initializing UDF "{name}": {e}') from e


def register(spark: SparkSession, name: str, body: dict) -> None:
    """Make the function callable in SQL. A null in any argument gives null, without a call."""
    import pandas as pd

    loaded: list = []  # once for each worker, not for each batch

    def run(*cols: pd.Series) -> pd.Series:
        if not loaded:
            loaded.append((_python_entry if body["language"] == "python" else _wasm_entry)(body))
        entry = loaded[0]
        kinds = {"float": "float32", "double": "float64", "smallint": "Int16", "int": "Int32", "bigint": "Int64"}
        cols = tuple(c.astype("float64").astype(kinds[t]) if t in kinds and c.dtype == object else c for c, t in zip(cols, body["input_types"]))
        ok = ~pd.concat([c.isna() for c in cols], axis=1).any(axis=1) if cols else pd.Series([True])
        out = pd.Series([None] * len(ok), index=ok.index, dtype=object)
        if ok.any():
            out[ok] = list(entry(*(c[ok] for c in cols)))
        if body["return_type"] in ("float", "double"):
            return out.astype("float64" if body["return_type"] == "double" else "float32")
        return out

    # Arguments by position with a type for each, since pandas functions of any number of series need annotations.
    names = [f"a{k}" for k in range(len(body["input_types"]))]
    scope = {"run": run, "pd": pd}
    exec(f"def call({', '.join(f'{n}: pd.Series' for n in names)}) -> pd.Series:\n    return run({', '.join(names)})", scope)  # noqa: S102
    made = F.pandas_udf(scope["call"], body["return_type"])
    if body["volatility"].lower() == "volatile":
        made = made.asNondeterministic()
    spark.udf.register(name, made)


def cast_arguments(body: dict, args: list[str]) -> list[str]:
    return [f"cast({a} as {t})" for a, t in zip(args, body["input_types"])]

"""Settings from a TOML file, overridden by environment variables TIDEMARK__SECTION__KEY."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field

PREFIX = "TIDEMARK"
#: Defaults.
DEFAULTS = {
    "object_store": {"type": "local", "data_dir": "tidemark-data"},
    "frontend": {"http": {"bind_host": "127.0.0.1", "bind_port": 8080, "read_access": "any", "write_access": "off", "upload_data_max_length": 256, "cache_control": "max-age=43200, public"}},
    "runtime": {"max_memory": None, "temp_dir": None},
    "misc": {"max_partition_size": 1_048_576, "gc_interval": 0, "sync_conf": {"max_in_memory_bytes": 3 << 30, "max_replication_lag_s": 600, "max_syncs_per_url": 100, "write_lock_timeout_s": 3, "flush_task_interval_s": 900}},
}
MIN_MEMORY_MB = 64


class ConfigError(ValueError):
    pass


@dataclass
class Config:
    values: dict = field(default_factory=dict)

    def get(self, path: str):
        node = self.values
        for part in path.split("."):
            node = node[part]
        return node


def _merge(base: dict, over: dict) -> dict:
    out = dict(base)
    for k, v in over.items():
        out[k] = _merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v
    return out


def _typed(text: str):
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    return int(text) if text.lstrip("-").isdigit() else text


def load(text: str = "", environ: dict[str, str] | None = None) -> Config:
    """The checked settings; environment variables win over the text, the text over the defaults."""
    values = _merge(DEFAULTS, tomllib.loads(text))
    for name, value in (os.environ if environ is None else environ).items():
        parts = name.split("__")
        if parts[0] == PREFIX and len(parts) > 1:
            over: dict | object = _typed(value)
            for p in reversed(parts[1:]):
                over = {p.lower(): over}
            values = _merge(values, over)
    check(values)
    return Config(values)


def check(values: dict) -> None:
    store, catalog = values["object_store"], values.get("catalog", {"type": "store"})
    if store["type"] not in ("local", "memory", "s3", "gcs"):
        raise ConfigError(f"Unknown object store type {store['type']}")
    in_memory = catalog.get("type") == "memory" or catalog.get("dsn") == ":memory:"
    if in_memory != (store["type"] == "memory") and ("catalog" in values):
        raise ConfigError("You are using an in-memory catalog with a persistent object store, or the reverse; the two must agree")
    if store["type"] == "s3" and not (store.get("region") or store.get("endpoint")):
        raise ConfigError("An S3 store needs a region or an endpoint")
    memory = values["runtime"].get("max_memory")
    if memory is not None and memory < MIN_MEMORY_MB:
        raise ConfigError(f"runtime.max_memory must be at least {MIN_MEMORY_MB} MB")


def store_url(config: Config) -> str:
    """The root folder of a database on the configured store, as a Hadoop path."""
    s = config.get("object_store")
    if s["type"] == "local":
        return "file://" + os.path.abspath(s["data_dir"])
    if s["type"] == "s3":
        return f"s3a://{s['bucket']}/{s.get('prefix', '')}".rstrip("/")
    if s["type"] == "gcs":
        return f"gs://{s['bucket']}/{s.get('prefix', '')}".rstrip("/")
    import tempfile

    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is not None and not spark.sparkContext.master.startswith("local"):
        raise ConfigError("A store in memory is for local sessions; executors elsewhere could not see it")
    return "file://" + tempfile.mkdtemp(prefix="tidemark-memory-")

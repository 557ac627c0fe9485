"""Tables of other databases, with filters shipped to them in their own dialect."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith

from tidemark.plans.tokens import SqlError

_COMPARE = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def quote_name(name: str, dialect: str) -> str:
    q = "`" if dialect == "mysql" else '"'
    return q + name.replace(q, q * 2) + q


def quote_value(v: object) -> str | None:
    """A literal, or None for what is not shipped (times with a zone, binary, nested values)."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float, Decimal)):
        return str(v)
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, datetime):
        return None if v.tzinfo else f"'{v.isoformat(sep=' ')}'"
    if isinstance(v, date):
        return f"'{v.isoformat()}'"
    return None


def filter_sql(f: Filter, dialect: str = "sqlite") -> str | None:
    """The filter in a dialect (sqlite, postgres, mysql), or None if it has to stay here; the whole of it or nothing."""
    if isinstance(f, Not):
        inner = filter_sql(f.child, dialect)
        return None if inner is None else f"NOT ({inner})"
    name = quote_name(".".join(f.attribute), dialect)
    if isinstance(f, IsNull):
        return f"{name} IS NULL"
    if isinstance(f, IsNotNull):
        return f"{name} IS NOT NULL"
    if isinstance(f, In):
        values = [quote_value(v) for v in f.value]
        return None if None in values or not values else f"{name} IN ({', '.join(values)})"
    value = quote_value(f.value)
    if value is None:
        return None
    if type(f) in _COMPARE:
        return f"{name} {_COMPARE[type(f)]} {value}"
    if isinstance(f, EqualNullSafe):
        return {"sqlite": f"{name} IS {value}", "postgres": f"{name} IS NOT DISTINCT FROM {value}", "mysql": f"{name} <=> {value}"}[dialect]
    if isinstance(f, (StringStartsWith, StringEndsWith, StringContains)):
        if dialect != "postgres" or any(ch in f.value for ch in "%_\\"):
            return None  # LIKE of the others ignores letter case, so it would not be exact
        inner = value[1:-1]
        return f"{name} LIKE '{'' if isinstance(f, StringStartsWith) else '%'}{inner}{'' if isinstance(f, StringEndsWith) else '%'}'"
    return None


class _Range(InputPartition):
    def __init__(self, lo: int | None, hi: int | None):
        self.lo, self.hi = lo, hi


class SqliteReader(DataSourceReader):
    """Reads a table in ranges of row ids; shipped filters are part of each range's query."""

    def __init__(self, options: dict, schema):
        self.path, self.name, self.schema = options["path"], options["table"], schema
        self.parts = int(options.get("partitions", 4))
        self.limit = int(options["limit"]) if "limit" in options else None
        self.shipped: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 - Spark's name
        for f in filters:
            sql = filter_sql(f)
            if sql is None:
                yield f
            else:
                self.shipped.append(sql)

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            try:
                lo, hi = c.execute(f"SELECT min(rowid), max(rowid) FROM {quote_name(self.name, 'sqlite')}").fetchone()
            except sqlite3.OperationalError:
                return [_Range(None, None)]
        if lo is None:
            return [_Range(None, None)]
        step = max(1, -(-(hi - lo + 1) // self.parts))
        return [_Range(a, min(hi, a + step - 1)) for a in range(lo, hi + 1, step)]

    def query(self, part: _Range) -> str:
        where = list(self.shipped)
        if part.lo is not None:
            where.append(f"rowid BETWEEN {part.lo} AND {part.hi}")
        names = ", ".join(quote_name(f.name, "sqlite") for f in self.schema.fields)
        return f"SELECT {names} FROM {quote_name(self.name, 'sqlite')}" + (f" WHERE {' AND '.join(where)}" if where else "") + (f" LIMIT {self.limit}" if self.limit is not None else "")

    def read(self, part: _Range) -> Iterator[tuple]:
        kinds = [f.dataType.simpleString() for f in self.schema.fields]
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            for row in c.execute(self.query(part)):
                yield tuple(_cast(v, k) for v, k in zip(row, kinds))


def _cast(v, kind: str):
    if v is None:
        return None
    if kind in ("int", "bigint", "smallint", "tinyint"):
        return int(v)
    if kind in ("double", "float"):
        return float(v)
    if kind == "boolean":
        return bool(v)
    if kind == "date":
        return date.fromisoformat(str(v)[:10])
    if kind.startswith("timestamp"):
        return datetime.fromisoformat(str(v).replace("Z", ""))
    if kind.startswith("decimal"):
        return Decimal(str(v))
    return v if isinstance(v, str) else str(v)


class SqliteSource(DataSource):
    """spark.read.format("tidemark_sqlite").option("path", file).option("table", name)."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_sqlite"

    def schema(self) -> str:
        kinds = {"INT": "bigint", "CHAR": "string", "TEXT": "string", "CLOB": "string", "REAL": "double", "FLOA": "double", "DOUB": "double", "DATE": "date", "TIME": "timestamp_ntz", "BOOL": "boolean"}
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
            rows = c.execute(f"PRAGMA table_info({quote_name(self.options['table'], 'sqlite')})").fetchall()
        if not rows:
            raise SqlError(f"No table {self.options['table']} in {self.options['path']}")
        kind = lambda t: next((k for part, k in sorted(kinds.items(), key=lambda x: x[0] != "TIME") if part in t.upper()), "string")
        return ", ".join(f"`{r[1]}` {kind(r[2] or '')}" for r in rows)

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(dict(self.options), schema)


class RemoteTable:
    """A table of another database. frame reads it: some columns, and so many rows at least if a limit is given."""

    def __init__(self, spark: SparkSession, location: str, name: str, schema: T.StructType | None = None):
        self.spark, self.name, self.declared = spark, name, schema
        scheme = location.split(":", 1)[0].lower()
        if scheme == "sqlite":
            spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
            spark.dataSource.register(SqliteSource)
            path = location.split(":", 1)[1]
            self.path, self.url = "/" + path.lstrip("/") if path.startswith("//") else path, None
        elif scheme in ("postgresql", "postgres", "mysql"):
            self.path, self.dialect = None, "mysql" if scheme == "mysql" else "postgres"
            self.url = "jdbc:" + ("mysql" if scheme == "mysql" else "postgresql") + ":" + location.split(":", 1)[1]
        else:
            raise SqlError(f"Unsupported remote table location {location}")
        self.stored = self._load().schema
        #: The columns as they are seen here: those that were declared, by position, else those of the table.
        self.schema = T.StructType([T.StructField(b.name, b.dataType, True) for _, b in zip(self.stored.fields, (schema or self.stored).fields)])

    def _load(self, columns: T.StructType | None = None, limit: int | None = None) -> DataFrame:
        if self.url:  # Spark's source ships columns, filters and limits by itself
            return self.spark.read.format("jdbc").options(url=self.url, dbtable=quote_name(self.name, self.dialect), pushDownPredicate="true", pushDownLimit="true", pushDownAggregate="true").load()
        read = self.spark.read.format("tidemark_sqlite").option("path", self.path).option("table", self.name)
        if limit is not None:
            read = read.option("limit", limit)
        return (read.schema(columns) if columns else read).load()

    def frame(self, columns: set[str] | None = None, limit: int | None = None) -> DataFrame:
        """The rows, cast to the declared columns. Columns that are not asked for are null and not fetched.

        limit: any so many rows are enough; it may be given only where all filters are shipped. A cast that a filter
        stands behind stays here, and the filter with it.
        """
        pairs = list(zip(self.stored.fields, self.schema.fields))
        wanted = [(a, b) for a, b in pairs if columns is None or b.name in columns] or pairs[:1]
        cast = any(a.dataType != b.dataType for a, b in wanted)
        df = self._load(T.StructType([a for a, _ in wanted]), None if cast else limit)
        names = {b.name for _, b in wanted}
        return df.select(*[(F.col(f"`{a.name}`") if b.name in names else F.lit(None)).cast(b.dataType).alias(b.name) for a, b in pairs])


def remote_table(spark: SparkSession, location: str, name: str, schema: T.StructType | None = None) -> RemoteTable:
    """A remote table; with a schema its columns are cast to it. postgresql:// and mysql:// need their JDBC driver."""
    return RemoteTable(spark, location, name, schema)

import pytest
from pyspark.sql import types as T

from tidemark.plans.engine import Engine
from tidemark.plans.tokens import SqlError
from tidemark.sources.avro import read_container, write_container
from tidemark.sources.iceberg import IcebergTable, check_alignment, create_table


def test_avro_round_trip():
    schema = {"type": "record", "name": "r", "fields": [{"name": "a", "type": ["null", "long"]}, {"name": "b", "type": "string"}, {"name": "c", "type": {"type": "array", "items": "int"}}, {"name": "d", "type": "bytes"}, {"name": "e", "type": "boolean"}]}
    rows = [{"a": None, "b": "x", "c": [], "d": b"", "e": True}, {"a": -(2**40), "b": "é" * 200, "c": [1, -1, 300], "d": b"\0\xff", "e": False}]
    meta, got = read_container(write_container(schema, rows, {"k": "v"}))
    assert got == rows and meta["k"] == b"v"
    assert read_container(write_container(schema, [], {}))[1] == []
    for bad in (b"", b"Obj\x02", write_container(schema, rows, {})[:-3]):
        with pytest.raises(ValueError):
            read_container(bad)


def test_append_makes_a_new_version_and_keeps_the_old(spark, folder):
    e = Engine(spark, f"{folder}/db")
    t = create_table(spark, f"{folder}/ice", T.StructType.fromDDL("key int, value string"))
    assert t.scan().count() == 0
    c = e.with_metastore({"s.t": {"location": t.path, "format": "ICEBERG"}})
    c.sql("INSERT INTO s.t VALUES (1, 'one'), (2, 'two'), (3, 'three'), (4, 'four')")
    c.sql("INSERT INTO s.t (value, key) VALUES ('five', 5), (NULL, 6)")
    want = [(1, "one"), (2, "two"), (3, "three"), (4, "four"), (5, "five"), (6, None)]
    assert [tuple(r) for r in c.sql("SELECT key, value FROM s.t ORDER BY key").collect()] == want
    assert t.scan().count() == 0 and IcebergTable(spark, f"{folder}/ice/metadata/v2.metadata.json").scan().count() == 4
    assert c.store.read_text(f"{folder}/ice/metadata/version-hint.text") == "3"
    e.sql(f"CREATE EXTERNAL TABLE i STORED AS ICEBERG LOCATION '{folder}/ice/metadata/v3.metadata.json'")
    assert e.sql("SELECT sum(key) FROM staging.i").head()[0] == 21
    with pytest.raises(SqlError, match="Another writer"):
        IcebergTable(spark, f"{folder}/ice/metadata/v2.metadata.json").append(spark.createDataFrame([(9, "x")], "key int, value string"))


@pytest.mark.parametrize(
    ("given", "ok"),
    [("a int, b string", True), ("a int not null, b string", True), ("a int", False), ("a int, c string", False), ("b string, a int", False), ("a bigint, b string", False), ("a int, b string, c int", False)],
)
def test_alignment(spark, given, ok):
    wanted = T.StructType.fromDDL("a int, b string")
    if ok:
        check_alignment(T.StructType.fromDDL(given), wanted)
    else:
        with pytest.raises(SqlError):
            check_alignment(T.StructType.fromDDL(given), wanted)


def test_required_columns(spark):
    with pytest.raises(SqlError):
        check_alignment(T.StructType.fromDDL("a int"), T.StructType.fromDDL("a int not null"))

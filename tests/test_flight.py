import threading

import pyarrow as pa
import pyarrow.flight as fl
import pytest

from tidemark.flight import FlightServer, pack, read_message, unpack, write_message
from tidemark.plans.engine import Engine
from tidemark.plans.log import VersionedTable


@pytest.fixture
def server(spark, folder):
    s = FlightServer(Engine(spark, folder))
    threading.Thread(target=s.serve, daemon=True).start()
    yield s
    s.shutdown()


def command(sql):
    return fl.FlightDescriptor.for_command(pack("arrow.flight.protocol.sql.CommandStatementQuery", write_message([(1, sql.encode())])))


def test_messages():
    m = write_message([(1, 300), (2, b"ab"), (3, None)])
    assert list(read_message(m)) == [(1, 300), (2, b"ab")]
    assert unpack(b"SELECT 1")[0] == "CommandStatementQuery"


def test_queries_and_single_use_tickets(server):
    c = fl.connect(f"grpc://127.0.0.1:{server.port}")
    run = lambda q, **h: c.do_get(c.get_flight_info(command(q), fl.FlightCallOptions(headers=[(k.encode(), v.encode()) for k, v in h.items()])).endpoints[0].ticket).read_all()
    run("CREATE TABLE t AS VALUES (1, 'x', [1, 2]), (2, NULL, NULL); CREATE SCHEMA other; CREATE TABLE other.t AS VALUES (7)")
    assert run("SELECT * FROM t ORDER BY column1").to_pylist() == [{"column1": 1, "column2": "x", "column3": [1, 2]}, {"column1": 2, "column2": None, "column3": None}]
    assert run("SELECT * FROM t", **{"search-path": "other"}).to_pylist() == [{"column1": 7}]
    assert run("SELECT * FROM t WHERE column1 > 5").num_rows == 0
    ticket = c.get_flight_info(fl.FlightDescriptor.for_command(b"SELECT 1 AS a")).endpoints[0].ticket
    assert c.do_get(ticket).read_all().to_pylist() == [{"a": 1}]
    with pytest.raises(fl.FlightError, match="No results found"):
        c.do_get(ticket).read_all()
    with pytest.raises(fl.FlightError):
        c.get_flight_info(command("SELECT 'x'::int"))


def test_sync_messages(server, folder):
    c = fl.connect(f"grpc://127.0.0.1:{server.port}")

    def put(rows, sequence):
        t = pa.table({"a": pa.array([r[0] for r in rows], pa.int32()), "b": pa.array([r[1] for r in rows], pa.int32()), "c": pa.array([r[2] for r in rows], pa.string())})
        roles = [(0, b"k"), (1, b"k"), (3, b"v")]
        raw = write_message([(1, b"synced"), *[(3, write_message([(1, r), (2, n)])) for r, n in roles], (4, b"42"), (5, sequence)])
        writer, reader = c.do_put(fl.FlightDescriptor.for_command(pack("sync.DataSyncCommand", raw)), t.schema)
        if rows:
            writer.write_table(t)
        writer.done_writing()
        answer = dict(read_message(reader.read().to_pybytes()))
        writer.close()
        return answer

    assert put([(None, 1, "a"), (None, 2, "b")], None) == {1: 1, 4: 1}
    assert put([(2, 3, "c")], 9) == {1: 1, 2: 9, 4: 0}
    server.writer.flush_all()
    assert put([], None) == {1: 1, 2: 9, 3: 9, 4: 0}
    assert sorted(tuple(r) for r in VersionedTable(server.engine.spark, f"{folder}/synced").scan().collect()) == [(1, "a"), (3, "c")]

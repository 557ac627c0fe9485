"""HTTP answers, access, settings and the prompt, without sockets."""

import hashlib
import io
import json
import urllib.parse

import pytest

from tidemark.auth import AuthError, Policy, Principal, allowed, bearer, principal_of
from tidemark.cli import one_off, prompt
from tidemark.config import ConfigError, load
from tidemark.plans.engine import Engine
from tidemark.server import Service


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def service(spark):
    from tidemark.session import scratch

    return Service(Engine(spark, scratch(spark, "test")))


def post(service, query, path="/q", **headers):
    a = service.handle("POST", path, headers, json.dumps({"query": query}).encode())
    return a.status, b"".join(a.body).decode(), a.headers


def get(service, query, **headers):
    a = service.handle("GET", f"/q/{sha(query)}.csv", {"X-Tidemark-Query": urllib.parse.quote(query), **headers})
    return a.status, b"".join(a.body).decode(), a.headers


def test_post_reads_writes_and_nulls(service):
    assert post(service, "CREATE TABLE t AS VALUES (1, 'x'), (2, NULL)")[:2] == (200, "")
    status, text, headers = post(service, "SELECT * FROM t ORDER BY column1")
    assert status == 200 and [json.loads(x) for x in text.splitlines()] == [{"column1": 1, "column2": "x"}, {"column1": 2, "column2": None}]
    assert headers["content-type"].startswith("application/json; arrow-schema=") and "x-tidemark-query-time" in headers
    assert post(service, "SELECT 1; SELECT 2")[0] == 400 and post(service, "SELECT 1; DELETE FROM t WHERE column1 = 9")[0] == 400
    assert post(service, "")[1] == "Empty query received" and post(service, "SELECT * FROM nope")[0] == 400 and post(service, "SELEC 1")[0] == 400
    assert service.handle("POST", "/q", {}, b"x").status == 400


def test_get_is_cached_by_table_version(service):
    post(service, "CREATE TABLE c AS VALUES (1)")
    q = "SELECT count(*) AS n FROM c"
    status, text, headers = get(service, q)
    assert status == 200 and json.loads(text) == {"n": 1} and "cache-control" in headers
    assert get(service, q, **{"If-None-Match": headers["etag"]})[0] == 304
    post(service, "INSERT INTO c VALUES (2)")
    again = get(service, q, **{"If-None-Match": headers["etag"]})
    assert again[0] == 200 and json.loads(again[1]) == {"n": 2}
    assert service.handle("GET", f"/q/{sha('x')}", {}, json.dumps({"query": "SELECT 1"}).encode()).status == 400
    a = service.handle("GET", "/q/" + urllib.parse.quote("SELECT 1 AS a"), {})
    assert a.status == 200 and json.loads(b"".join(a.body)) == {"a": 1}
    assert service.handle("GET", "/q/" + urllib.parse.quote("DROP TABLE c"), {}).status == 405


def test_uploads(service):
    def send(name, content, **parts):
        b = "--B\r\n"
        body = "".join(f'{b}Content-Disposition: form-data; name="{k}"\r\n\r\n{v}\r\n' for k, v in parts.items())
        body += f'{b}Content-Disposition: form-data; name="data"; filename="{name}"\r\n\r\n{content}\r\n--B--\r\n'
        a = service.handle("POST", "/upload/up/t", {"Content-Type": "multipart/form-data; boundary=B"}, body.encode())
        return a.status, b"".join(a.body).decode()

    assert send("f.csv", "a,b\n1,x\n2,y") == (200, "done")
    assert send("f.csv", "3,z", has_header="false") == (200, "done")
    assert json.loads(post(service, "SELECT sum(a) AS s, count(b) AS n FROM up.t")[1]) == {"s": 6, "n": 3}
    assert send("f.txt", "")[0] == 400 and send("f", "")[0] == 400 and send("", "")[0] == 400
    assert service.handle("POST", "/upload/up/t", {}, b"").status == 400


def test_health_and_unknown_paths(service):
    assert service.handle("GET", "/healthz", {}).status == 200 and service.handle("GET", "/nope", {}).status == 404
    assert service.handle("OPTIONS", "/q", {}).status == 204 and b"requests_total" in b"".join(service.handle("GET", "/metrics", {}).body)


R, W = sha("read"), sha("write")


@pytest.mark.parametrize(
    ("token", "policy", "want"),
    [
        (None, Policy("any", "any"), Principal.ANONYMOUS), (None, Policy("any", W), Principal.ANONYMOUS), (None, Policy(R, W), 401), (None, Policy("off", "off"), 401), ("x", Policy("any", "off"), 400),
        ("write", Policy(R, W), Principal.WRITER), ("read", Policy(R, W), Principal.READER), ("bad", Policy(R, W), 401), ("read", Policy(R, "off"), Principal.READER), ("write", Policy("any", W), Principal.WRITER),
    ],
)
def test_principals(token, policy, want):
    if isinstance(want, int):
        with pytest.raises(AuthError) as x:
            principal_of(token, policy)
        assert x.value.status == want
    else:
        assert principal_of(token, policy) is want


def test_permissions():
    assert allowed(Principal.WRITER, "write", Policy("off", W)) and allowed(Principal.READER, "read", Policy(R, W)) and not allowed(Principal.READER, "write", Policy(R, W))
    assert allowed(Principal.ANONYMOUS, "read", Policy("any", W)) and not allowed(Principal.ANONYMOUS, "write", Policy("any", "off")) and allowed(Principal.ANONYMOUS, "write", Policy("any", "any"))
    with pytest.raises(AuthError):
        bearer("Basic x")


def test_access_over_http(service):
    locked = Service(service.engine, Policy("any", W))
    assert post(locked, "CREATE TABLE z (a INT)")[:2] == (403, "WRITE_FORBIDDEN")
    assert post(locked, "CREATE TABLE z (a INT)", Authorization="Bearer nope")[:2] == (401, "INVALID_ACCESS_TOKEN")
    assert post(locked, "CREATE TABLE z (a INT)", Authorization="Bearer write")[0] == 200
    assert post(locked, "SELECT 1 AS a")[0] == 200 and post(locked, "SHOW COLUMNS FROM z")[0] == 200
    closed = Service(service.engine, Policy("off", "any"))
    assert get(closed, "SELECT 1")[:2] == (405, "READ_ONLY_ENDPOINT_DISABLED")


def test_settings():
    c = load('[object_store]\ntype = "local"\ndata_dir = "x"\n[frontend.http]\nbind_port = 80', {"TIDEMARK__FRONTEND__HTTP__BIND_PORT": "81", "TIDEMARK__MISC__MAX_PARTITION_SIZE": "9"})
    assert c.get("frontend.http.bind_port") == 81 and c.get("misc.max_partition_size") == 9 and c.get("misc.sync_conf.max_syncs_per_url") == 100
    for bad in ('[object_store]\ntype = "s3"\nbucket = "b"', '[object_store]\ntype = "memory"\n[catalog]\ntype = "store"', "[runtime]\nmax_memory = 63", '[object_store]\ntype = "tape"'):
        with pytest.raises(ConfigError):
            load(bad, {})


def test_prompt_and_one_off(spark, folder):
    e, out = Engine(spark, folder), io.StringIO()
    prompt(e, io.StringIO("CREATE TABLE t AS\nVALUES (1, 'one');\n\\d t\n\\d\n\\?\n\\x\nSELECT * FROM t;\nSELECT nope;\n\\q\nSELECT 2;\n"), out)
    text = out.getvalue()
    assert text.startswith("default> ") and "| column1     | int" in text and "| 1       | one     |" in text and "Time: " in text and "Unknown command" in text and "| 2" not in text
    out = io.StringIO()
    one_off(e, "INSERT INTO t VALUES (2, NULL); SELECT * FROM t ORDER BY 1", out)
    assert out.getvalue() == '{"column1":1,"column2":"one"}\n{"column1":2,"column2":null}\n'

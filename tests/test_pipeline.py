"""The general operators: plain cases, dirty ones, hot keys, failures, and models to compare with."""

import random
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.identifiers import address_root, address_segments, integer_of
from tidemark.operators import compaction, drift, patches
from tidemark.operators.capture import Capture, latest_positions
from tidemark.operators.dedupe import deduplicate, split_copies
from tidemark.operators.scale import chunked_neighbour


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# -- names ------------------------------------------------------------------------------------------------------------


def test_integer_of(spark):
    given_ = ["7", "+7", "007", " 7 ", "7.0", "\t7", "-3", "7.5", "", "x", None, "99999999999999999999"]
    df = spark.createDataFrame([(t,) for t in given_], "t string").select(integer_of(F.col("t")).alias("n"))
    assert [r.n for r in df.collect()] == [7, 7, 7, 7, 7, 7, -3, None, None, None, None, None]


def test_addresses(spark):
    cases = {
        "a/b": (None, ["a", "b"]), "./a//b/": (None, ["a", "b"]), "/x/../a/b": (None, ["a", "b"]), "a/%62": (None, ["a", "b"]), "../a": (None, ["a"]), "a+b": (None, ["a+b"]),
        "a%2Fb": (None, ["a\0b"]), "a%zz": (None, ["a%zz"]), "S3://Host//a/b": ("s3://host", ["a", "b"]), "file:///a": ("file://", ["a"]), "file:/a": ("file://", ["a"]), "file://localhost/a": ("file://", ["a"]), "a:b": (None, ["a:b"]), "": (None, []),
        "x/%2E%2E/a": (None, ["a"]),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", address_root(F.col("t")).alias("r"), address_segments(F.col("t")).alias("s"))
    assert {r.t: (r.r, r.s) for r in df.collect()} == cases


# -- neighbours and copies ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("previous", [True, False])
def test_chunked_neighbour(spark, previous):
    rnd = random.Random(3)
    data = sorted({(rnd.choice(["a", "a", "a", "b", None]), rnd.randrange(10**9)) for _ in range(400)}, key=str)
    df = spark.createDataFrame(data, "k string, v bigint")
    got = {(r.k, r.v): r.o for r in chunked_neighbour(df, ["k"], "v", "o", previous, chunks=7).collect()}
    for k, v in data:
        near = [x for kk, x in data if kk == k and (x < v if previous else x > v)]
        assert got[k, v] == ((max if previous else min)(near) if near else None)


def test_split_copies_hot_nulls_ties_and_clashing_names(spark):
    data = [("hot", i % 50, i, "p") for i in range(300)] + [("one", 1, 1, None)] + [("two", 5, 2, "q"), ("two", 5, 2, "q")] + [(None, 1, 3, "r"), (None, 1, 3, "r")]
    df = spark.createDataFrame(data, "key string, `order` int, n bigint, salt string").withColumn("_copy2", F.lit(1))
    out = split_copies(df, ["key"], ["order", "n"])
    assert out.columns == [*df.columns, "_copy"]
    assert out.count() == len(data)
    kept = Counter(r.key for r in out.where("_copy = 0").collect())
    assert kept == {"hot": 1, "one": 1, "two": 1, None: 2}
    first = out.where("_copy = 0 AND key = 'hot'").head()
    assert (first["order"], first["n"]) == (0, 0)
    assert split_copies(df.limit(0), ["key"], ["n"]).count() == 0


def test_deduplicate_prefers_stored(spark):
    stored = spark.createDataFrame([(1, 9, "old")], "id int, at int, v string")
    new = spark.createDataFrame([(1, 1, "new"), (2, 3, "b"), (2, 2, "a"), (2, 2, "a")], "id int, at int, v string")
    assert rows(deduplicate(new, ["id"], ["at"], stored)) == [(1, 9, "old"), (2, 2, "a")]
    assert rows(deduplicate(new, ["id"], ["at"])) == [(1, 1, "new"), (2, 2, "a")]


# -- capture --------------------------------------------------------------------------------------------------------------


def _log(spark, data):
    return spark.createDataFrame(data, "p int, o bigint, a bigint, text string, low string")


def test_capture_is_exactly_once_over_failures_and_late_arrivals(spark, folder):
    c = Capture(spark, folder, "p", "o", "a")
    first = [(1, 1, 1, "x", "l"), (1, 2, 2, "x", None), (1, 2, 3, "x", None), (None, 5, 4, None, "l"), (2, None, 5, "probe", "l")]
    assert rows(c.run(_log(spark, first)).select("p", "o")) == [(1, 1), (1, 2), (None, 5)]
    later = first + [(1, 2, 6, "again", ""), (1, 4, 7, "new", ""), (None, 5, 8, "again", "")]
    # The process ends between plan and apply; meanwhile more arrives, with a late record below.
    n = c.plan(_log(spark, later))
    more = later + [(1, 3, 9, "late", ""), (7, 1, 10, "other", "")]
    assert c.pending() == n
    c.apply(n, _log(spark, more))  # and ends again before the commit
    out = Capture(spark, folder, "p", "o", "a").run(_log(spark, more))
    assert rows(out.select("p", "o")) == [(1, 3), (7, 1)]
    total = rows(c.sink().select("p", "o"))
    assert total == [(1, 1), (1, 2), (1, 3), (1, 4), (7, 1), (None, 5)]
    assert c.run(_log(spark, more)).count() == 0


def test_capture_of_an_empty_log(spark, folder):
    assert Capture(spark, folder, "p", "o", "a").run(_log(spark, [])).count() == 0


def test_capture_with_outside_positions(spark, folder):
    log = _log(spark, [(1, o, o, "", "") for o in range(1, 7)] + [(2, 1, 10, "", ""), (3, 1, 11, "", "")])
    answers = spark.createDataFrame([(1, 3, 1, 1), (1, 4, 2, 2), (1, None, 3, 3), (3, 0, 1, 4)], "p int, m bigint, at int, id int")
    at = latest_positions(answers, "p", "m", ["at", "id"])
    acked = spark.createDataFrame([(1, 1), (1, 3), (1, 4), (1, 6), (3, 1), (2, 1)], "p int, o bigint")
    out = Capture(spark, folder, "p", "o", "a").run(log, at, acked)
    # 2: not acknowledged; 5, 6 and partition 3: above the position; partition 2: no position.
    assert rows(out.select("p", "o")) == [(1, 2), (1, 5), (1, 6), (2, 1), (3, 1)]


# -- drift ---------------------------------------------------------------------------------------------------------------


def _col(name, kind="Utf8", i=None):
    return {"id": i, "name": name, "type": kind}


def test_changes_by_id_and_by_name():
    old = [_col("a", "Int32", "1"), _col("b", "Utf8", "2"), _col("c", '{"Decimal128": [12, 2]}', "3")]
    new = [_col("c", '{"Decimal128":[12,2]}', "3"), _col("x", "Int64", "1"), _col("d", "Utf8", "4")]
    assert drift.changes_between([(old, new)]) == [[("b", "removed"), ("d", "added"), ("x", "renamed"), ("x", "retyped")]]
    assert drift.changes_between([([_col("a")], [_col("A")]), ([], [_col("a")]), ([], [])]) == [[("A", "added"), ("a", "removed")], [("a", "added")], []]


def test_flooding_finds_renames_by_name_type_and_nesting():
    nested = '{"Struct": [{"name": "x", "data_type": "Int32"}, {"name": "y", "data_type": "Int32"}]}'
    old = [_col("customer_name"), _col("position", nested), _col("amount", "Float64"), _col("note")]
    new = [_col("customerName"), _col("positions", nested), _col("amount", "Float64"), _col("colour", "Boolean")]
    pair = drift.flood([(old, new)], similar=True)[0]
    assert {(i, j) for i, j, _ in pair} == {(0, 0), (1, 1), (2, 2)}


def test_schema_changes_over_versions(spark):
    v = [("s", "t", 3, [("1", "a", "int")]), ("s", "t", 1, [("1", "a", "int"), ("2", "b", "int")]), ("s", "t", 1, [("2", "b", "int")]), ("s", "t", 9, [("1", "z", "long")]), ("s", None, 1, []), ("s", "u", 1, [(None, "q", None)]), ("s", "u", 2, None)]
    df = spark.createDataFrame(v, "source string, table_key string, version bigint, cols array<struct<id:string,name:string,type:string>>")
    got = rows(drift.schema_changes(df).select("table_key", "version", "column_name", "change"))
    assert got == [("t", 3, "b", "removed"), ("t", 9, "z", "renamed"), ("t", 9, "z", "retyped"), ("u", 2, "q", "removed")]
    assert drift.schema_changes(df.limit(0)).count() == 0


def test_message_changes(spark):
    m = [("k", 1, ["a", "b"]), ("k", 4, ["a"]), ("k", 6, ["b", "c"]), ("k", 8, []), ("k", 9, None), ("o", 1, ["z"])]
    df = spark.createDataFrame(m, "table_key string, version bigint, names array<string>")
    assert rows(drift.message_changes(df).select("table_key", "version", "column_name", "change")) == [("k", 6, "a", "removed"), ("k", 6, "c", "added"), ("k", 8, "b", "removed"), ("k", 8, "c", "removed")]


def test_unify_renamed_retyped_removed_and_returning_columns(spark):
    a = spark.createDataFrame([(1, "x", 1.5)], "id int, customer_name string, amount double")
    b = spark.createDataFrame([(2**40, "y")], "id bigint, customerName string")
    c = spark.createDataFrame([(3, "z", 2.5)], "id int, customerName string, amount double")
    out, said = drift.unify([a, b, c])
    assert rows(out) == [(1, "x", 1.5), (3, "z", 2.5), (2**40, "y", None)] or sorted(map(str, rows(out))) == sorted(map(str, [(1, "x", 1.5), (2**40, "y", None), (3, "z", 2.5)]))
    assert (1, "customerName", "renamed") in said and (1, "amount", "removed") in said and (2, "amount", "added") in said


# -- compaction -----------------------------------------------------------------------------------------------------------


def test_inventory_of_dirty_entries(spark):
    stores = spark.createDataFrame([("default", "file:///srv/lake"), ("s", "s3://host/data")], "name string, location string")
    tables = spark.createDataFrame([("a/t", None), ("a/t2", "s"), ("a/t2", "s"), ("a/t/_x", None), (None, "s"), ("gone", "nowhere")], "path string, store string")
    e = [
        (1, "a/t/f.parquet", "add", 1, 10), (2, "./a//t/f.parquet", "add", 3, 20), (3, "file:///srv/lake/a/t/%66.parquet", "remove", 2, None),  # live: the add at 3
        (4, "S3://HOST/data/a/t2/d/g.parquet", "add", 1, 5), (5, "a/t2/d/g.parquet", "remove", 2, None),  # removed
        (6, "a/t/_tmp/h.parquet", "add", 1, 1), (7, "a/t/h.json", "add", 1, 1), (8, "a/tx/h.parquet", "add", 1, 1), (9, "s3://other/data/a/t2/k.parquet", "add", 1, 1),
        (10, "a/t/_x/y/k.parquet", "add", 1, 0), (11, None, "add", 1, 1), (12, "a/t/l.parquet", None, 1, 1), (13, "a/t.parquet", "add", 1, 1),
    ]
    df = spark.createDataFrame(e, "entry_id bigint, path string, action string, commit_version bigint, size_bytes bigint").withColumn("num_records", F.lit(1).cast("bigint")).withColumn("url", F.lit("clash"))
    got = rows(compaction.inventory(df, tables, stores).select("entry_id", "table_path", "live", "size_bytes"))
    assert got == [(1, "a/t", True, 20), (10, "a/t/_x", True, 0), (4, "a/t2", False, None)]
    assert compaction.inventory(df.limit(0), tables, stores).count() == 0


@given(st.lists(st.integers(0, 10_000), max_size=60), st.integers(1, 8))
@settings(max_examples=50, deadline=None)
def test_schedule_is_balanced(sizes, groups):
    out = compaction.schedule(sizes, groups)
    loads = [sum(s for s, g in zip(sizes, out) if g == k) for k in range(groups)]
    # Longest-first is within 4/3 of the best possible, which is at least the mean and the largest file.
    assert max(loads, default=0) <= 4 / 3 * max([sum(sizes) / groups, *sizes, *(sum(sorted(sizes)[-groups - 1 : -groups + 1]) if len(sizes) > groups else 0,)]) + 1


def test_plan_groups_shards_and_odd_names(spark):
    df = spark.createDataFrame([("t", i, i * 10, "x") for i in range(50)] + [(None, 1, None, None)], "k string, id bigint, size bigint, shard string")
    plan = compaction.plan_groups(df, ["k"], "size", "id", target=2000, shard_files=20)
    assert plan.columns == ["k", "id", "size", "shard", "shard", "group_no"]
    assert plan.count() == 51
    assert compaction.plan_groups(df.limit(0), ["k"], "size", "id").count() == 0


def test_compact_keeps_every_row_and_refuses_a_false_count(spark, folder):
    import os

    at = folder.removeprefix("file:").replace("//", "/")
    os.makedirs(at, exist_ok=True)
    for n in range(12):
        pq.write_table(pa.table({"x": pa.array(range(n), pa.int64()), "y": ["a"] * n}), f"{at}/{n}.parquet")
    files = spark.createDataFrame([(f"{at}/{n}.parquet", 100 + n, n, "t") for n in range(12)], "url string, size bigint, records bigint, t string")
    plan = compaction.plan_groups(files, ["t"], "size", "url", target=400)
    out = compaction.compact(spark, plan, "url", "records", ["t"], f"{folder}/out")
    assert Counter(r.x for r in out.collect()) == Counter(x for n in range(12) for x in range(n))
    assert len(set(out.inputFiles())) == 4
    wrong = compaction.plan_groups(files.withColumn("records", F.lit(5).cast("bigint")), ["t"], "size", "url")
    with pytest.raises(ValueError, match="do not hold"):
        compaction.compact(spark, wrong, "url", "records", ["t"], f"{folder}/bad")
    with pytest.raises(FileNotFoundError):
        compaction.read_manifest(spark, f"{folder}/bad")


# -- patches ---------------------------------------------------------------------------------------------------------------


def model(base, changes):
    """The plain way: a dictionary that takes one change after the other."""
    state = {k: dict(v) for k, v in base.items()}
    for old, new, patch in changes:
        row = state.pop(old, {}) if old is not None else {}
        if new is not None:
            state[new] = {**row, **patch}
    return state


_key = st.one_of(st.none(), st.integers(0, 6))


@given(st.lists(st.tuples(_key, _key, st.dictionaries(st.sampled_from("xy"), st.one_of(st.none(), st.text("ab", max_size=2)), max_size=2)), max_size=40), st.sets(st.integers(0, 6)), st.integers(1, 9))
@settings(max_examples=12, deadline=None)
def test_composed_patches_equal_the_model(spark, changes, base_keys, chunks):
    changes = [(o, n, p) for o, n, p in changes if o is not None or n is not None]
    base = {k: {"x": f"b{k}"} for k in base_keys}
    key = lambda k: None if k is None else [str(k)]
    feed = [("t", v // 3, 0, v, key(o), key(n), list(p), list(p.values())) for v, (o, n, p) in enumerate(changes)]
    random.Random(1).shuffle(feed)
    schema = "tab string, version bigint, origin bigint, row_no int, old_key array<string>, new_key array<string>, names array<string>, values array<string>"
    df = spark.createDataFrame(feed + feed[:3], schema)
    b = spark.createDataFrame([("t", [str(k)], v, 0) for k, v in base.items()], "tab string, key array<string>, values map<string,string>, version bigint")
    got = {int(r.key[0]): r["values"] for r in patches.apply_patches(patches.compose(df, chunks), b).collect()}
    assert got == model(base, changes)


def test_messages_become_changes(spark):
    d = "array<struct<role:string,name:string>>"
    desc = [("OLD_PK", "k"), ("NEW_PK", "k"), ("VALUE", "v"), ("CHANGED", "v"), ("VALUE", "w")]
    data = [("t", 1, 1, 1, desc, [None, "007", "a", "false", "b"]), ("t", 1, 1, 2, desc, ["7", None, None, "true", None]), ("t", 1, 1, 3, desc, None), ("t", 1, 1, 4, desc, ["1"])]
    df = spark.createDataFrame(data, f"tab string, version bigint, origin bigint, row_no int, column_descriptors {d}, cells array<string>").withColumn("_sets", F.lit(1)).withColumn("names", F.lit(2))
    made = patches.changes_of_messages(patches.message_layouts(df, ["k"]), {"k": "bigint"})
    got = {r.row_no: (r.old_key, r.new_key) for r in made.collect()}
    assert got == {1: (None, ["7"]), 2: (["7"], None), 3: (None, None), 4: (["1"], None)}
    sets = {r.key[0]: (r.alive, r.src, r.patch) for r in patches.compose(made, is_ordered=True).collect()}
    assert sets == {"7": (False, None, {}), "1": (False, None, {})}
    first = patches.changes_of_messages(patches.message_layouts(df.where("row_no = 1"), ["k"]), {"k": "bigint"})
    assert [(r.key, r.patch) for r in patches.compose(first, is_ordered=True).collect()] == [(["7"], {"w": "b"})]  # the flag of v is false
    assert patches.compose(patches.changes_of_messages(patches.message_layouts(df.limit(0), ["k"]), {"k": "bigint"}), is_ordered=True).count() == 0


def test_state_of_the_whole_feed_equals_a_model(spark):
    """All value columns of p5_state, against one dictionary that takes every row of the feed in order."""
    import os

    duckdb = pytest.importorskip("duckdb")
    from tidemark.queries import pipeline

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("needs the test tables")
    c = duckdb.connect()
    for t in ("sync_commands", "sync_changes", "table_objects", "storage_locations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    placed = pipeline.P5_SQL[: pipeline.P5_SQL.index(", ops AS")]
    feed = c.sql(placed + " SELECT k, v, o, row_no, d, cells FROM placed JOIN sync_changes USING (delivery_id) ORDER BY k, v, o, row_no").fetchall()
    tables: dict = {}
    last = None
    for k, v, o, n, d, cells in feed:
        if (k, v, o, n) == last:
            continue
        last = (k, v, o, n)
        cell = {(x["role"], x["name"]): (cells or [])[i] if i < len(cells or []) else None for i, x in enumerate(d)}
        key = lambda role: None if cell.get((role, "c1")) is None and cell.get((role, "c2")) is None else (int(cell[role, "c1"]), cell[role, "c2"])  # noqa: E731, B023
        old, new = key("OLD_PK"), key("NEW_PK")
        rows = tables.setdefault(k, {})
        row = {} if old is None else rows.pop(old, ({}, 0))[0]
        if new is not None:
            row = {**row, **{x["name"]: cell["VALUE", x["name"]] for x in d if x["role"] == "VALUE" and (cell.get(("CHANGED", x["name"]), "true") or "").lower() == "true"}}
            rows[new] = (row, v)
    want = {(k, *key, *(row.get(f"c{n}") for n in range(3, 10)), v) for k, rows in tables.items() for key, (row, v) in rows.items()}
    got = pipeline.p5_state(spark, sf).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want

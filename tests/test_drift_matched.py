"""Changes where flooding, not only ids and equal names, says which columns are the same."""

import os
from collections import Counter

import pytest

from tidemark.operators import drift
from tidemark.queries import registry

SF = "/root/testdata/sf0.01"


def test_a_name_that_ends_where_one_like_it_begins_is_renamed(spark):
    m = [("k", 1, ["a", "total"]), ("k", 2, ["a", "total_v2", "flag"]), ("k", 3, ["a", "total_v2", "flag"]), ("k", 4, ["a", "total_v2", "colour"])]
    df = spark.createDataFrame(m, "table_key string, version bigint, names array<string>")
    got = drift.message_changes(df, similar=True).select("version", "column_name", "change").collect()
    assert sorted(map(tuple, got)) == [(2, "flag", "added"), (2, "total_v2", "renamed"), (4, "colour", "added"), (4, "flag", "removed")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_scores_decide_in_the_tables(spark):
    found, matched = (Counter(map(tuple, registry.queries()[q](spark, SF).collect())) for q in ("p3_found", "p3_matched"))
    less, more = found - matched, matched - found
    # A rename is told in place of one removed and one added column; nothing else differs.
    assert Counter(r[4] for r in more) == {"renamed": 7} and {r[0] for r in more} == {"catalog", "sync"}
    assert {r[:4] for r in more} == {r[:4] for r in less if r[4] == "added"} and Counter(r[4] for r in less) == {"added": 7, "removed": 7}
    assert {(r[0], r[1], r[2]) for r in less} == {(r[0], r[1], r[2]) for r in more}

"""Replay of a left-over plan where a reader outside has positions and acknowledged records."""

from tidemark.operators.capture import Capture


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_replay_with_positions_and_acknowledged(spark, folder):
    data = [(1, o, o) for o in range(1, 7)] + [(2, 1, 10), (None, 1, 11), (None, 2, 12)]
    log = spark.createDataFrame(data, "p int, o bigint, a bigint")
    at = spark.createDataFrame([(1, 4)], "p int, position bigint")
    acked = spark.createDataFrame([(1, 1), (1, 3), (1, 4), (1, 6)], "p int, o bigint")
    due = [(1, 2), (1, 5), (1, 6), (2, 1), (None, 1), (None, 2)]
    c = Capture(spark, folder, "p", "o", "a")
    n = c.plan(log, at, acked)
    c.apply(n, log)  # and the process ends before the commit
    again = Capture(spark, folder, "p", "o", "a")
    assert again.pending() == n
    assert again.run(log, at, acked).count() == 0  # the replay has them all
    assert rows(again.sink().select("p", "o")) == sorted(due, key=str)
    more = log.union(spark.createDataFrame([(2, 2, 13), (1, 5, 14)], "p int, o bigint, a bigint"))
    assert rows(again.run(more, at, acked).select("p", "o")) == [(2, 2)]
    assert rows(again.sink().select("p", "o")) == sorted([*due, (2, 2)], key=str)


def test_a_replay_goes_by_the_acknowledgements_of_its_plan(spark, folder):
    log = spark.createDataFrame([(1, o, o) for o in range(1, 5)], "p int, o bigint, a bigint")
    at = spark.createDataFrame([(1, 4)], "p int, position bigint")
    acked = lambda *os: spark.createDataFrame([(1, o) for o in os], "p int, o bigint")
    c = Capture(spark, folder, "p", "o", "a")
    n = c.plan(log, at, acked(1))
    c.apply(n, log)
    before = rows(c.sink([n]).select("p", "o"))
    # 2 and 3 are acknowledged before the replay: the batch stays what it was planned to be.
    assert c.run(log, at, acked(1, 2, 3)).count() == 0
    assert rows(c.sink().select("p", "o")) == before == [(1, 2), (1, 3), (1, 4)]


def test_two_runs_over_an_unchanged_log(spark, folder):
    log = spark.createDataFrame([(1, 2, 1), (1, 3, 2)], "p int, o bigint, a bigint")
    at, acked = spark.createDataFrame([(1, 1)], "p int, position bigint"), spark.createDataFrame([], "p int, o bigint")
    c = Capture(spark, folder, "p", "o", "a")
    c.run(log, at, acked)
    c.run(log, at, acked)
    assert rows(c.sink().select("p", "o")) == [(1, 2), (1, 3)]

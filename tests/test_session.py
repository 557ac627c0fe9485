from tidemark.session import cleanup, cut, materialize, scratch, spread
from tidemark.sources.storage import Storage


def test_written_tables_and_cleanup(spark):
    df = spark.range(10).toDF("a")
    one = materialize(df, "test")
    other = scratch(spark, "unused")
    assert one.count() == 10 and cut(df).count() == 10 and not Storage(spark).exists(other)
    files = one.inputFiles()
    assert cleanup(spark) >= 1
    assert not Storage(spark).exists(files[0])


def test_spread_leaves_wide_tables_alone(spark):
    wide = spark.range(0, 100, 1, 64)
    assert spread(wide) is wide
    assert spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_put_if_absent(spark, folder):
    s = Storage(spark)
    assert s.put_if_absent(f"{folder}/a", "x") and not s.put_if_absent(f"{folder}/a", "y")
    assert s.read_text(f"{folder}/a") == "x"
    s.put(f"{folder}/a", "z")
    assert s.read_text(f"{folder}/a") == "z" and [p[0].rsplit("/", 1)[1] for p in s.list(folder)] == ["a"]
    assert s.delete(f"{folder}/a") and not s.delete(f"{folder}/a") and s.list(f"{folder}/none") == []

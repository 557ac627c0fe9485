"""Queries that have to meet every row of their tables."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.queries import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_aggregates_and_casts_leave_no_row_out(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    got = registry.queries()["array_agg_sorted_all"](spark, SF)
    assert got.agg(F.sum(F.size("orders_"))).head()[0] == orders.count()
    assert registry.queries()["cast_matrix_all"](spark, SF).count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_distances_are_between_different_vectors(spark):
    got = registry.queries()["fn_embedding_distance_first"](spark, SF)
    assert got.where("d > 0").count() > 0.9 * got.count() and got.count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()


def test_versions_and_conversion_meet_a_table_that_grows(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    got = registry.queries()["convert_parquet_orders"](spark, SF)
    assert got.count() == orders.count() and len(got.inputFiles()) >= orders.count() / 1000
    assert registry.queries()["time_travel_except_orders"](spark, SF).count() == orders.where("o_orderkey % 4 >= 3").count()

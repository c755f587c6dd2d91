"""Joins that must give the same rows by every way they can take."""

import pytest
from pyspark.sql import functions as F

from corpusloom import session
from corpusloom.plans import joins


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_counted_join_with_hot_keys(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 900).alias("k"), "id")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m"))
    want = rows_of(left.join(right, "k").select("k", "id", "n", "m"))
    assert rows_of(joins.join_counted(left, right, "k", "n").select("k", "id", "n", "m")) == want
    assert rows_of(joins.join_counted(left, right, "k", "n", share=1).select("k", "id", "n", "m")) == want
    assert joins.join_counted(left.limit(0), right.limit(0), "k", "n").count() == 0


@pytest.mark.parametrize("bound, bits", [(1000, 1 << 27), (0, 1 << 27), (0, 1 << 16)])
def test_rows_are_split_by_keys(spark, bound, bits):
    wide = spark.range(4000).select(F.when(F.col("id") % 50 != 0, F.col("id")).alias("a"), (F.col("id") % 7).alias("b"), F.lit("x" * 50).alias("text"))
    keys = spark.createDataFrame([(None, 3), (5, 5), (6, 5), (77, 0), (3999, 3999 % 7)], "a long, b long")
    hit, rest = joins.split_by_keys(wide, keys, ["a", "b"], bound=bound, bits=bits)
    found = {(r["a"], r["b"]) for r in hit.collect()}
    assert found == {(None, 3), (5, 5), (77, 0), (3999, 3999 % 7)}
    assert hit.columns == rest.columns == wide.columns
    assert hit.count() + rest.count() == 4000 and not found & {(r["a"], r["b"]) for r in rest.collect()}
    assert joins.split_by_keys(wide, keys.limit(0), ["a", "b"], bound=bound)[1].count() == 4000


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_literal_tables(spark):
    assert [tuple(r) for r in session.values(spark, [(1, 2, "a"), (-5, None, 'é"')], "x long, y int, z string").collect()] == [(1, 2, "a"), (-5, None, 'é"')]
    assert session.values(spark, [], "x long").count() == 0

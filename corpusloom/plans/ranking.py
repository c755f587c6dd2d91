"""Global ranks without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.session import cut


def global_rank(df: DataFrame, order: list[Column], out: str = "rank", partitions: int | None = None) -> DataFrame:
    """1-based rank over the whole table in ``order``.

    Range-partition by the order, rank inside each partition, and add the
    row counts of the partitions before it.  Only one small row per
    partition meets in one task.  ``order`` must be total for the ranks to
    be reproducible.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_pid").orderBy(*order))
    return ranged.join(F.broadcast(starts), "_pid").withColumn(out, (inside + F.col("_start")).cast("long")).drop("_pid", "_start")


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """Adds, under each name, the sum of a column over all rows before this
    one in ``order``, 0 for the first; nulls count as 0.

    As with ``global_rank`` rows are range-partitioned and summed inside
    their partition, and only one row of sums per partition meets in one
    task.  ``order`` must be total for the sums to be reproducible.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    valued = df.withColumns({f"_v{i}": F.coalesce(c, F.lit(0)) for i, c in enumerate(sums.values())})
    ranged = cut(valued.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()))
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_pid").agg(*[F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(sums))])
    starts = totals.select("_pid", *[F.coalesce(F.sum(f"_t{i}").over(earlier), F.lit(0)).alias(f"_s{i}") for i in range(len(sums))])
    out = ranged.join(F.broadcast(starts), "_pid")
    return out.withColumns({name: F.coalesce(F.sum(f"_v{i}").over(inside), F.lit(0)) + F.col(f"_s{i}") for i, name in enumerate(sums)}).drop("_pid", *[f"_{k}{i}" for k in "vs" for i in range(len(sums))])

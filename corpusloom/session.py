"""Session helpers shared by all operators."""

from __future__ import annotations

import json
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(app: str = "corpusloom", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> None:
    """Make sure that checkpoints go to a folder all executors share.

    ``spark.checkpoint.dir`` names it.  A local session without one gets a
    temporary folder; a cluster without one is an error, as a folder of the
    driver's machine is not there for its executors.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="corpusloom-checkpoint-")
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's shared checkpoint folder.

    The result has no lineage, so the loss of an executor costs a re-read
    and never a replay of earlier rounds.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table the driver has made, as a literal: unlike
    ``createDataFrame`` it needs no Python worker to be read."""
    names = [f.split()[0] for f in schema.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows], separators=(",", ":"))
    kind = "array<struct<" + ",".join(f"{f.split()[0]}:{f.split()[1]}" for f in schema.split(", ")) + ">>"
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(text), kind)))

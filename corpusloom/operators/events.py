"""Folds over the append-only event log: run state, budget, ledger.

Log order is an explicit ``seq`` column; it is never the timestamp and
never the order in which files are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions.text import month
from corpusloom.plans.ranking import global_rank, running_sums

# Caps, classes, prices and states.
GPU_CAP, API_CAP = 40.0, 100.0
CLASS_SECONDS = {"smoke": 20 * 60, "screen": 2 * 60 * 60, "promo": 8 * 60 * 60}
GPU_PRICE = {"T4": 0.000164, "L4": 0.000222, "A10": 0.000306, "L40S": 0.000542, "A100-40GB": 0.000583, "A100-80GB": 0.000694, "H100": 0.001097}
RESERVE = 1.20
TERMINAL = ("completed", "failed", "cancelled", "reaped", "launch_failed")
LIVE = ("reserved", "running")

SCHEMA = """seq bigint, kind string, ts double, run_id string, comparison string, status string, budget_class string, gpu string, task_kind string,
timeout_seconds bigint, reserved_cost_usd double, api_reserved_cost_usd double, actual_cost_usd double, actual_api_cost_usd double, cost_usd double,
config_hash string, git_sha string, billing_month string, started_at double, finished_at double, accel_seconds double, tokens bigint,
records_processed bigint, return_code int, function_call_id string, reaper_reason string"""


def last_value(column: str, seq: str = "seq") -> Column:
    """The last non-null value in log order, as a mergeable aggregate."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col(seq)))


def snapshots(events: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Current state of each run: per column the last non-null value."""
    columns = columns or [c for c in events.columns if c not in ("run_id", "seq")]
    return events.where(F.coalesce("run_id", F.lit("")) != "").groupBy("run_id").agg(*[last_value(c).alias(c) for c in columns])


def launches(events: DataFrame) -> DataFrame:
    """Each run's first event of kind ``run``."""
    rest = [c for c in events.columns if c != "run_id"]
    return events.where("kind = 'run'").groupBy("run_id").agg(F.min_by(F.struct(*rest), F.col("seq")).alias("e")).select("run_id", "e.*")


def status(events: DataFrame) -> DataFrame:
    """What may be shown of a run: its state without the call handle."""
    return snapshots(events).drop("function_call_id")


def billed(events: DataFrame) -> DataFrame:
    state = snapshots(events, ["status", "task_kind", "actual_cost_usd", "reserved_cost_usd", "api_reserved_cost_usd"])
    first = events.where("kind = 'run'").groupBy("run_id").agg(F.min_by(F.struct("billing_month", "ts"), F.col("seq")).alias("e"))
    when = F.coalesce(F.nullif(F.col("e.billing_month"), F.lit("")), month(F.col("e.ts")))
    return state.join(first, "run_id", "left").select("*", when.alias("month"), F.coalesce(F.col("status").isin(*TERMINAL), F.lit(False)).alias("ended"))


def budget(events: DataFrame) -> DataFrame:
    """Per month: committed and remaining GPU and API money."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    runs = billed(events)
    said = events.where("kind = 'api_cost' AND run_id IS NOT NULL").groupBy("run_id").agg(F.sum("cost_usd").alias("said"))
    gpu = F.when(F.col("ended"), zero(F.col("actual_cost_usd"))).otherwise(zero(F.col("reserved_cost_usd")))
    open_api = F.when(~F.col("ended") & (F.col("task_kind") == "brief_synthesis"), F.greatest(F.lit(0.0), zero(F.col("api_reserved_cost_usd")) - zero(F.col("said")))).otherwise(0.0)
    part = runs.join(said, "run_id", "left").select("month", gpu.alias("gpu"), open_api.alias("api"))
    spent = events.where("kind = 'api_cost'").select(month(F.col("ts")).alias("month"), F.lit(0.0).alias("gpu"), zero(F.col("cost_usd")).alias("api"))
    total = part.unionByName(spent).groupBy("month").agg(F.sum("gpu").alias("g"), F.sum("api").alias("a"))
    left = lambda cap, c: F.round(F.greatest(F.lit(0.0), F.lit(cap) - F.col(c)), 6)
    return total.select("month", F.round("g", 6).alias("gpu_committed_usd"), left(GPU_CAP, "g").alias("gpu_remaining_usd"), F.round("a", 6).alias("api_spend_usd"), left(API_CAP, "a").alias("api_remaining_usd"))


def has_capacity(remaining: Column, wanted: Column) -> Column:
    return remaining >= wanted


def begun(now: Column) -> Column:
    """When a run started; none and 0 mean now."""
    return F.coalesce(F.nullif(F.col("started_at"), F.lit(0.0)), now)


def pro_rated(now: Column) -> Column:
    """Reserved money by elapsed share of the timeout, at most all of it."""
    reserved, elapsed = F.coalesce("reserved_cost_usd", F.lit(0.0)), F.greatest(F.lit(0.0), now - begun(now))
    return F.least(reserved, reserved * elapsed / F.greatest(F.lit(1.0), F.coalesce(F.col("timeout_seconds").cast("double"), F.lit(1.0))))


def accrued(events: DataFrame, now: float) -> DataFrame:
    """All GPU money spent so far, whatever the month."""
    state = snapshots(events, ["status", "actual_cost_usd", "reserved_cost_usd", "started_at", "timeout_seconds"])
    cost = F.when(F.col("status").isin(*TERMINAL), F.coalesce("actual_cost_usd", F.lit(0.0))).otherwise(pro_rated(F.lit(now)))
    return state.agg(F.round(F.coalesce(F.sum(cost), F.lit(0.0)), 6).alias("accrued_usd"))


def reap(events: DataFrame, now: float) -> DataFrame:
    """The events that end overdue runs, or all live ones at the cap."""
    state = snapshots(events, ["status", "budget_class", "reserved_cost_usd", "started_at", "timeout_seconds"]).where(F.col("status").isin(*LIVE))
    limit = F.lit(None).cast("int")
    for name, seconds in CLASS_SECONDS.items():
        limit = F.when(F.col("budget_class") == name, seconds).otherwise(limit)
    spent = F.broadcast(accrued(events, now))  # one row
    late = F.coalesce(F.lit(now) - begun(F.lit(now)) > limit, F.lit(False))
    reason = F.when(late, "wall_clock").when(F.col("accrued_usd") >= GPU_CAP, "global_cap")
    rows = state.join(spent, F.lit(True)).withColumn("reaper_reason", reason).where("reaper_reason IS NOT NULL")
    return rows.select(F.lit("run_update").alias("kind"), "run_id", F.lit("reaped").alias("status"), "reaper_reason", F.lit(now).alias("finished_at"), F.round(pro_rated(F.lit(now)), 6).alias("actual_cost_usd"))


def reservation(timeout: Column, gpu: Column) -> Column:
    price = F.lit(None).cast("double")
    for name, usd in GPU_PRICE.items():
        price = F.when(gpu == name, usd).otherwise(price)
    return F.round(timeout * price * RESERVE, 6)


def ledger_query(ledger: DataFrame, comparison: str | None = None, only_open: bool = False) -> DataFrame:
    out = ledger.where(F.col("comparison") == comparison) if comparison else ledger
    return out.where("kind = 'prereg' AND status = 'open'") if only_open else out


def last_open(ledger: DataFrame) -> DataFrame:
    """The last open preregistration of each comparison."""
    rest = [c for c in ledger.columns if c != "comparison"]
    rows = ledger_query(ledger, only_open=True)
    return rows.groupBy("comparison").agg(F.max_by(F.struct(*rest), F.col("seq")).alias("e")).select("comparison", "e.*")


def under_cap(rows: DataFrame, cap: float, most: int, group: list[str] | None = None) -> DataFrame:
    """Rows taken until the money before them reaches ``cap`` or ``most``
    rows are taken; the row that crosses the cap is kept.  ``group`` names
    the independent runs, each a window of its own; without it the rows are
    one run, summed up range by range.  Positions are unique in a run."""
    if group:
        w = Window.partitionBy(*group).orderBy("pos")
        before = F.coalesce(F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        summed = rows.withColumn("spent_before", before).withColumn("nth", F.row_number().over(w) - 1)
    else:
        summed = running_sums(rows, [F.col("pos")], {"spent_before": F.col("cost"), "nth": F.lit(1)})
    return summed.where((F.col("spent_before") < cap) & (F.col("nth") < most)).drop("nth")


def tail(lines: DataFrame, n: int) -> DataFrame:
    """The last ``n`` lines: a bounded top-k, not a global sort."""
    if not 1 <= n <= 5000:
        raise ValueError("tail is between 1 and 5000")
    return lines.orderBy(F.col("pos").desc()).limit(n)


#: What may follow a state; a run begins in the first.
NEXT = {"reserved": ("running", *TERMINAL), "running": TERMINAL}


def transitions(events: DataFrame) -> DataFrame:
    """(run_id, seq, before, status, legal): every event that names a state.
    A run starts as reserved or running, may repeat its state, and never
    leaves a terminal one."""
    own = Window.partitionBy("run_id").orderBy("seq")
    named = events.where(F.col("run_id").isNotNull() & F.col("status").isNotNull()).select("run_id", "seq", "status")
    before = F.lag("status").over(own)
    legal = F.when(F.col("before").isNull(), F.col("status").isin(*LIVE)).when(F.col("before") == F.col("status"), True)
    for state, after in NEXT.items():
        legal = legal.when(F.col("before") == state, F.col("status").isin(*after))
    return named.withColumn("before", before).withColumn("legal", F.coalesce(legal.otherwise(False), F.lit(False)))


def micro_batches(rows: DataFrame, size: int, group: list[str] | None = None) -> DataFrame:
    """Adds batch: rows in the order of ``pos``, ``size`` to a batch."""
    if size < 1:
        raise ValueError("a batch has one row at least")
    if not group:
        return global_rank(rows, [F.col("pos")], "_nth").withColumn("batch", F.floor((F.col("_nth") - 1) / size)).drop("_nth")
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*group).orderBy("pos")) - 1) / size))


def run_ids(events: DataFrame) -> DataFrame:
    """The distinct runs, sorted."""
    return events.where(F.coalesce("run_id", F.lit("")) != "").select("run_id").distinct().orderBy("run_id")


def capacity(events: DataFrame, month_: str, gpu: float, api: float) -> DataFrame:
    """One row: whether a month has room for so much GPU and API money."""
    left = budget(events).where(F.col("month") == month_).agg(F.coalesce(F.max("gpu_remaining_usd"), F.lit(GPU_CAP)).alias("g"), F.coalesce(F.max("api_remaining_usd"), F.lit(API_CAP)).alias("a"))
    return left.select(has_capacity(F.col("g"), F.lit(gpu)).alias("gpu_ok"), has_capacity(F.col("a"), F.lit(api)).alias("api_ok"))

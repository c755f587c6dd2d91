"""Registered queries: launches, run states, streams and the event log's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.catalog import LOG, NOW, STATE, _is_dir, read, register, run_log
from corpusloom.catalog_reports import scratch
from corpusloom.functions import text as T
from corpusloom.operators import events as ev, launch
from corpusloom.session import cut
from corpusloom.sources import io
from corpusloom.streaming import budgets, runs


def requests(spark, sf_dir) -> DataFrame:
    """Launch requests with every kind of fault, by the event's id."""
    i = F.col("event_id")
    broken = lambda k, bad, good: F.when(i % 17 == k, bad).otherwise(good)
    brief = i % 4 == 0
    command = F.array(*[F.lit(x) for x in (*launch.COMMAND, "--x")])
    return read(spark, sf_dir, "events").select(
        "event_id", (i % 17 != 0).alias("config_ok"), (i % 17 != 1).alias("hash_ok"), broken(2, F.lit(""), F.concat(F.lit("c"), (i % 5).cast("string"))).alias("comparison"),
        F.lit("prereg").alias("prereg_kind"), broken(3, F.lit("closed"), F.lit("open")).alias("prereg_status"), F.concat(F.lit("c"), (i % 5).cast("string")).alias("prereg_comparison"),
        broken(4, F.lit("huge"), F.when(i % 2 == 0, "smoke").otherwise("screen")).alias("budget_class"), F.when(i % 17 == 5, "promo").when(i % 3 == 0, F.when(i % 2 == 0, "smoke").otherwise("screen")).alias("run_class"),
        broken(6, F.lit(2), F.lit(None).cast("int")).alias("gpus"), broken(7, F.lit(9999), F.when(i % 3 == 1, 15)).cast("int").alias("timeout_min"),
        F.when(i % 17 == 8, "mystery").when(brief, "brief_synthesis").otherwise("experiment").alias("task_kind"), broken(9, F.lit("K80"), F.when(i % 5 == 0, "h100").otherwise("L4")).alias("gpu"),
        broken(10, F.lit("some-14b-base"), F.lit("some-4b")).alias("model"), F.lit(False).alias("approved"), F.when(i % 17 == 11, F.slice(command, 2, 3)).otherwise(command).alias("command"),
        broken(12, F.lit("file:///x"), F.lit(launch.VOLUME + "a")).alias("input_uri"), F.lit(launch.VOLUME + "b").alias("output_uri"), broken(13, F.lit(1000.0), F.lit(5.0)).alias("max_cost_usd"),
    )


PRICE = "CASE g " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ev.GPU_PRICE.items()) + " END"
REFUSED = f"""q AS (SELECT event_id AS i, event_id % 17 AS k, CASE WHEN event_id % 17 = 4 THEN 'huge' WHEN event_id % 2 = 0 THEN 'smoke' ELSE 'screen' END AS c, CASE WHEN event_id % 17 = 8 THEN 'mystery' WHEN event_id % 4 = 0 THEN 'brief_synthesis' ELSE 'experiment' END AS t,
 CASE WHEN event_id % 17 = 9 THEN 'K80' WHEN event_id % 5 = 0 THEN 'H100' ELSE 'L4' END AS g, CASE WHEN event_id % 17 = 7 THEN 9999 WHEN event_id % 3 = 1 THEN 15 WHEN event_id % 2 = 0 THEN 20 ELSE 120 END * 60 AS secs FROM events),
 e AS (SELECT *, CASE WHEN k = 0 THEN 'config' WHEN k = 1 THEN 'config_hash' WHEN k = 2 THEN 'comparison' WHEN k = 3 THEN 'preregistration' WHEN k = 4 THEN 'budget_class' WHEN k = 5 THEN 'class_mismatch' WHEN k = 6 THEN 'gpus'
 WHEN secs > CASE c WHEN 'smoke' THEN 1200 ELSE 7200 END THEN 'timeout' WHEN k = 8 THEN 'task_kind' WHEN t = 'experiment' AND k = 9 THEN 'gpu' WHEN k = 10 THEN 'scale_up' WHEN t = 'experiment' AND k = 11 THEN 'command' WHEN t <> 'experiment' AND k = 12 THEN 'volume'
 WHEN t <> 'experiment' AND k = 13 THEN 'api_cost' END AS refusal FROM q)"""


@register(f"WITH {REFUSED} SELECT i AS event_id, refusal, CASE WHEN refusal IS NULL THEN secs END AS timeout_seconds, CASE WHEN refusal IS NULL THEN CASE WHEN t = 'experiment' THEN g ELSE 'CPU' END END AS on_gpu, CASE WHEN refusal IS NULL THEN CASE WHEN t = 'experiment' THEN round(CAST(secs AS DOUBLE) * {PRICE} * 1.2, 4) ELSE 0.0 END END AS worst_cost_usd, CASE WHEN refusal IS NULL THEN CASE WHEN t = 'experiment' THEN 0.0 ELSE 5.0 END END AS api_reserved_usd FROM e")
def launch_refusals(spark, sf_dir):
    out = launch.judge_launches(requests(spark, sf_dir))
    return out.select("event_id", "refusal", F.col("timeout_seconds").cast("long").alias("timeout_seconds"), "on_gpu", F.round("worst_cost_usd", 4).alias("worst_cost_usd"), "api_reserved_usd")


STATES = "('reserved', 'running', 'completed', 'failed', 'cancelled', 'reaped', 'launch_failed')"
PICKED = """nm AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'reserved' WHEN 2 THEN 'running' WHEN 3 THEN 'running' END AS status FROM events)"""
LEGAL = f"""tr AS (SELECT run_id, seq, status, lag(status) OVER (PARTITION BY run_id ORDER BY seq) AS before FROM nm WHERE status IS NOT NULL),
 lg AS (SELECT *, CASE WHEN before IS NULL THEN status IN ('reserved', 'running') WHEN before = status THEN true WHEN before = 'reserved' THEN status IN {STATES} AND status <> 'reserved' WHEN before = 'running' THEN status IN {STATES} AND status NOT IN ('reserved', 'running') ELSE false END AS legal FROM tr)"""


def named(e: DataFrame) -> DataFrame:
    n = F.col("event_id") % 5
    return e.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), F.when(n == 0, "completed").when(n == 1, "reserved").when(n < 4, "running").alias("status"))


@register(f"WITH {PICKED}, {LEGAL} SELECT run_id, seq, before, status, legal FROM lg")
def run_transitions(spark, sf_dir):
    return ev.transitions(named(read(spark, sf_dir, "events"))).select("run_id", "seq", "before", "status", "legal")


def event_stream(spark, sf_dir) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path if _is_dir(spark, path) else f"{path}*")


@register(f"WITH {PICKED}, {LEGAL} SELECT run_id, seq, before, status, legal FROM lg")
def stream_transitions(spark, sf_dir):
    """The same states kept by a stateful streaming query."""
    out, folder = runs.state_machine(named(event_stream(spark, sf_dir))), scratch(spark, "machine")
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@register(f"WITH {LOG}, {STATE} SELECT coalesce(status, 'none') AS status, count(*) AS n FROM state GROUP BY status")
def stream_dashboard(spark, sf_dir):
    """Runs by state, polled from a streaming query into a table."""
    e = event_stream(spark, sf_dir)
    status = F.when(F.col("event_id") % 11 == 0, "completed").when(F.col("event_id") % 3 == 0, F.col("event_type"))
    log = e.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("run_id"), status.alias("status"))
    folder = scratch(spark, "dashboard")
    runs.start_dashboard(runs.run_state(log, ["status"]), f"{folder}/table", f"{folder}/state", once=True).awaitTermination()
    return runs.latest(spark, f"{folder}/table", ["run_id"]).groupBy(F.coalesce("status", F.lit("none")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@register(f"WITH {REFUSED} SELECT 'launch_failed' AS status, count(*) AS n FROM e WHERE refusal IS NOT NULL UNION ALL SELECT 'reserved', count(*) FROM e WHERE refusal IS NULL")
def stream_gateway(spark, sf_dir):
    """Requests of a stream judged by the one writer of the log; caps are set
    high here, so that only the policy refuses."""
    folder = scratch(spark, "gateway")
    requests(spark, sf_dir).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
    runs.start_gateway(stream, f"{folder}/log", f"{folder}/state", clock=lambda: NOW, gpu_cap=1e9, api_cap=1e9).awaitTermination()
    return io.read_events(spark, f"{folder}/log").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


ASKED = "round(greatest(value, 0.0) / 8, 6)"


@register(
    f"""WITH RECURSIVE asked AS (SELECT CAST(user_id AS VARCHAR) AS budget, strftime(ts, '%Y-%m') AS month, event_id AS seq, user_id || '-' || strftime(ts, '%Y-%m') || '-' || event_id % 40 AS run_id,
  CAST(round({ASKED} * 1000000) AS BIGINT) AS cost, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY event_id) AS k FROM events),
 step AS (SELECT DISTINCT budget, month, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS refusal, CAST(0 AS BIGINT) AS spent, CAST([] AS VARCHAR[]) AS seen FROM asked
  UNION ALL SELECT a.budget, a.month, a.k, a.seq, CASE WHEN list_contains(seen, a.run_id) THEN 'duplicate' WHEN cost > greatest(0, 40000000 - spent) THEN 'gpu_budget' END,
   CASE WHEN list_contains(seen, a.run_id) OR cost > greatest(0, 40000000 - spent) THEN spent ELSE spent + cost END, CASE WHEN list_contains(seen, a.run_id) OR cost > greatest(0, 40000000 - spent) THEN seen ELSE list_append(seen, a.run_id) END
  FROM step s JOIN asked a ON a.budget = s.budget AND a.month = s.month AND a.k = s.k + 1)
 SELECT budget, month, seq, refusal FROM step WHERE k > 0"""
)
def stream_admission(spark, sf_dir):
    """Every event asks for money of its user's month: keyed state admits in
    order what the cap still holds."""
    e = event_stream(spark, sf_dir)
    user, when = F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM")
    asked = e.select(
        user.alias("budget"), F.col("event_id").alias("seq"), F.concat_ws("-", user, when, (F.col("event_id") % 40).cast("string")).alias("run_id"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"),
        F.round(F.greatest(F.col("value"), F.lit(0.0)) / 8, 6).alias("reserved_cost_usd"),
    ).withColumn("ts", F.col("us") / 1_000_000)
    folder = scratch(spark, "admission")
    budgets.admit(asked.drop("us")).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("budget", "month", "seq", "refusal")


@register(
    """WITH s AS (SELECT CAST(user_id AS VARCHAR) AS comparison, CAST(date_trunc('week', ts) AS DATE) AS week, CAST(event_id // 3 AS VARCHAR) AS submission, event_id AS seq FROM events),
 f AS (SELECT comparison, week, submission, min(seq) AS first FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY comparison, week ORDER BY first) AS nth FROM f)
 SELECT comparison, week, submission, seq, seq <> first AS repeated, nth <= 5 AS accepted, CAST(greatest(0, 5 - (SELECT max(o.nth) FROM r o WHERE o.comparison = r.comparison AND o.week = r.week AND o.first <= seq)) AS INTEGER) AS remaining
 FROM s JOIN r USING (comparison, week, submission)"""
)
def stream_weekly_quota(spark, sf_dir):
    """Five submissions of a comparison a week, counted in keyed state."""
    e = event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("comparison"), F.floor(F.col("event_id") / 3).cast("string").alias("submission"), F.col("event_id").alias("seq"), "ts")
    folder = scratch(spark, "quota")
    budgets.weekly(e).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@register(
    f"""WITH {LOG}, live AS (SELECT * REPLACE (CASE WHEN status = 'completed' THEN 'completed' ELSE 'running' END AS status) FROM log), {STATE.replace('FROM log', 'FROM live')},
 due AS (SELECT run_id FROM state WHERE status = 'running' AND started_at IS NOT NULL) SELECT (SELECT count(*) FROM due) AS reaped, (SELECT count(DISTINCT run_id) FROM log) AS runs, 0 AS reaped_twice"""
)
def reaper_tick(spark, sf_dir):
    """Two ticks of the reaper over a log on disk; the second finds nothing
    that the first has ended."""
    folder = scratch(spark, "log")
    log = run_log(spark, sf_dir).withColumn("status", F.when(F.col("status") == "completed", "completed").otherwise("running"))
    started = ev.snapshots(log, ["started_at"]).where("started_at IS NOT NULL").select("run_id", F.lit(True).alias("begun"))
    # tasks hold the runs alone; a merge join would sort the whole log
    marked = log.join(started.hint("shuffle_hash"), "run_id", "left")
    io.append_events(marked.withColumn("status", F.when(F.col("begun"), F.col("status")).otherwise("completed")).drop("begun"), folder)
    for _ in range(2):
        runs.reap_once(spark, folder, lambda: NOW)
    back = io.read_events(spark, folder)
    own = back.where("status = 'reaped'").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    return own.agg(F.count(F.lit(1)).alias("reaped"), F.count_if(F.col("n") > 1).alias("reaped_twice")).join(back.agg(F.count_distinct("run_id").alias("runs")), F.lit(True))


@register(f"WITH {LOG} SELECT kind, count(*) AS n, count(DISTINCT run_id) AS runs, true AS copied FROM log GROUP BY kind")
def ledger_round_trip(spark, sf_dir):
    """The log appended in two parts, copied, and read from a path that the
    environment may name; a log that is not there is empty."""
    folder, log = scratch(spark, "ledger"), run_log(spark, sf_dir)
    for part in (log.where("seq % 2 = 0"), log.where("seq % 2 = 1")):
        io.append_ledger(part, folder)
    back = io.read_events(spark, io.ledger_path(folder, "CORPUSLOOM_NO_SUCH_VARIABLE"))
    copied = spark.read.text(f"{folder}.bak").count() == back.count() and io.read_events(spark, f"{folder}-none").isEmpty()
    return back.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("run_id").alias("runs"), F.lit(copied).alias("copied"))


@register("WITH b AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 50 AS batch FROM events) SELECT user_id, batch, count(*) AS n FROM b GROUP BY user_id, batch")
def micro_batch_sizes(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("pos", F.col("event_id"))
    return ev.micro_batches(e, 50, ["user_id"]).groupBy("user_id", "batch").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT DISTINCT CAST(user_id AS VARCHAR) AS run_id FROM events ORDER BY run_id")
def run_list(spark, sf_dir):
    return ev.run_ids(run_log(spark, sf_dir))


@register(f"WITH {LOG}, {STATE} SELECT run_id, status, budget_class FROM state")
def public_status(spark, sf_dir):
    """A run's state as it may be shown: without the call handle."""
    log = run_log(spark, sf_dir).withColumn("function_call_id", F.lit("secret"))
    shown = ev.status(log)
    if "function_call_id" in shown.columns:
        raise AssertionError("the call handle is shown")
    return shown.select("run_id", "status", "budget_class")


@register(f"WITH {LOG}, said AS (SELECT sum(cost_usd) AS a FROM log WHERE kind = 'api_cost' AND strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m') = '1999-01') SELECT 40 >= 12.5 AS gpu_ok, 100 - coalesce(a, 0) >= 150 AS api_ok FROM said")
def month_capacity(spark, sf_dir):
    """Room in a month without any run."""
    return ev.capacity(run_log(spark, sf_dir), "1999-01", 12.5, 150.0)


@register("SELECT event_id, round(CASE WHEN value <= 0 THEN 0.0 ELSE least(100.0, greatest(0.0, 100.0 * (value - 5) / value)) END, 6) AS share FROM events")
def budget_bars(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.round(T.percent(F.col("value") - 5, F.col("value")), 6).alias("share"))


@register(f"SELECT event_id, round(CAST(event_id * 5 AS DOUBLE) * CASE event_id % {len(ev.GPU_PRICE)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(ev.GPU_PRICE.values())) + " END * 1.2, 6) AS usd FROM events")
def reservations(spark, sf_dir):
    names = F.array(*[F.lit(k) for k in ev.GPU_PRICE])
    gpu = F.get(names, (F.col("event_id") % len(ev.GPU_PRICE)).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", ev.reservation(F.col("event_id") * 5, gpu).alias("usd"))


@register(f"WITH {LOG}, todo AS (SELECT DISTINCT run_id FROM log) SELECT count(*) AS lines, count(DISTINCT run_id) AS ids FROM todo")
def resumed_stream(spark, sf_dir):
    """Work on a stream of records, stopped and resumed: no id comes twice."""
    folder = scratch(spark, "resume")
    todo = cut(run_log(spark, sf_dir).groupBy("run_id").agg(F.min("seq").alias("pos")).select(F.col("run_id").alias("fingerprint"), F.lit(None).cast("string").alias("fineweb_id"), "pos"))
    for part in (todo.where("pos % 2 = 0"), todo):
        part.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(todo.schema).parquet(f"{folder}/in")
        runs.resume_stream(stream, f"{folder}/out", lambda rows: rows, f"{folder}/state").awaitTermination()
    return spark.read.schema(todo.schema).json(f"{folder}/out").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("fingerprint").alias("ids"))

"""Operators that stay small as their input grows, against plain definitions."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corpusloom import catalog_runs
from corpusloom.operators import archived, evaluation, events, metrics
from corpusloom.session import cut
from corpusloom.sources import io
from corpusloom.streaming import budgets, runs


def plain_bleu(texts, order=4):
    words = [t.split() for t in texts]
    grams = [[Counter(zip(*[w[k:] for k in range(n)])) for n in range(1, order + 1)] for w in words]
    out = []
    for i, w in enumerate(words):
        if not w:
            out.append(0.0)
            continue
        others = [len(x) for k, x in enumerate(words) if k != i]
        r = min(others, key=lambda n: (abs(n - len(w)), n))
        logs = []
        for n in range(1, min(order, len(w)) + 1):
            hit = sum(min(c, max(g[n - 1][x] for k, g in enumerate(grams) if k != i)) for x, c in grams[i][n - 1].items())
            logs.append(math.log((hit + 1) / (len(w) - n + 2)))
        out.append((1.0 if len(w) > r else math.exp(1 - r / len(w))) * math.exp(sum(logs) / len(logs)))
    return out


def test_bleu_by_pieces_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(metrics, "PIECE", 20)
    monkeypatch.setattr(metrics, "BUCKET", 50)
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefg") * rng.randrange(1, 3) for _ in range(rng.choice([0, 1, 2, 3, 9, 30]))) for _ in range(60)] + ["a b c d e"] * 3
    table = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "pos string, text string").repartition(3)
    got = {r["pos"]: r["bleu"] for r in metrics.bleu_vs_rest(table, "pos").collect()}
    assert all(math.isclose(got[f"k{i}"], x, abs_tol=1e-12) for i, x in enumerate(plain_bleu(texts)))


def test_kernel_distance_of_counted_vectors_by_blocks(spark, monkeypatch):
    """Vectors with counts, block by block, are what the repeated vectors are."""
    monkeypatch.setattr(evaluation, "BLOCK", 5)
    monkeypatch.setattr(evaluation, "STRIP", 8)
    monkeypatch.setattr(evaluation, "NEAR", 2)
    rng = np.random.default_rng(4)
    for v in (rng.integers(0, 9, (40, 3)).astype(float), rng.normal(0, 1, (40, 3)) + 100):
        n, side = rng.integers(1, 4, 40), np.arange(40) % 2
        table = spark.createDataFrame([(s, int(k), i, float(m), x.tolist()) for s in (3, 8) for i, (k, m, x) in enumerate(zip(side, n, v))], "set int, side int, pos long, n double, v array<double>").repartition(3)
        z, k = np.repeat(v, n, 0), np.repeat(side, n)
        d = ((z[:, None] - z[None]) ** 2).sum(-1)
        middle = np.median(d[d > 0])
        kern = sum(np.exp(-d / (2 * middle * c * c)) for c in evaluation.BANDWIDTHS) / 5
        own = [kern[np.ix_(k == s, k == s)][np.triu_indices((k == s).sum(), 1)].mean() for s in (0, 1)]
        want = sum(own) - 2 * kern[np.ix_(k == 0, k == 1)].mean()
        got = {r["set"]: r["mmd"] for r in evaluation.mmds(table).collect()}
        assert got.keys() == {3, 8} and all(math.isclose(x, want, rel_tol=1e-9, abs_tol=1e-12) for x in got.values())


def test_human_floor_beyond_one_matrix(spark, monkeypatch):
    """By blocks, the floor is what one matrix gives, of whole numbers, whose distances do not round."""
    rng = np.random.default_rng(6)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.integers(0, 50, (61, 3)).astype(float))], "pos long, v array<double>")
    want = evaluation.human_floor(table, 4).first()
    monkeypatch.setattr(evaluation, "WHOLE", 10)
    monkeypatch.setattr(evaluation, "BLOCK", 4)
    got = evaluation.human_floor(table, 4).first()
    assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(got, want))


def test_transitions_of_a_run_in_several_parts(spark, tmp_path):
    """A run's events are judged by seq though they come in many Arrow batches."""
    rows = spark.range(300).select(F.lit("r").alias("run_id"), (299 - F.col("id")).alias("seq"), F.element_at(F.array(*[F.lit(x) for x in ("reserved", "running", "completed")]), (F.col("id") % 3 + 1).cast("int")).alias("status"))
    rows.write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        out = runs.state_machine(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, events.transitions(rows).select("run_id", "seq", "before", "status", "legal").collect()))


def test_chrf_stays_with_its_pair(spark):
    pairs = spark.createDataFrame([(0, "a 😀 bcb", "ab😀b"), (1, "ab", "ba")], "i int, generated string, human string")
    scored = archived.chrf(pairs, "i")
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()

    def plain(x, y):
        got = []
        for n in range(1, 7):
            a, b = (Counter(t[i : i + n] for i in range(len(t) - n + 1)) for t in (x, y))
            if a and b:
                got.append((sum((a & b).values()) / sum(a.values()), sum((a & b).values()) / sum(b.values())))
        p, r = (sum(v) / len(v) for v in zip(*got))
        return 500 * p * r / (4 * p + r)

    assert all(math.isclose(r["chrf"], w) for r, w in zip(scored.orderBy("i").collect(), (plain("a😀bcb", "ab😀b"), plain("ab", "ba"))))


def test_facts_are_folded_once_for_a_text(spark):
    pairs = spark.createDataFrame([("The cat sat sat down. Pigs fly over moons. Ok.", ["the cat sat", "THE cat sat down", ""]), (None, [])], "text string, facts array<string>")
    rate = metrics.unsupported_rate(pairs.limit(1))
    assert rate.first()[0] == 0.0  # a fact without words supports every claim
    rate = metrics.unsupported_rate(pairs.select("text", F.slice("facts", 1, 2).alias("facts")))
    assert rate.first()[0] == 0.5
    plan = rate._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan[plan.index("Generate explode") :]


def test_hashed_ngrams_are_counted_where_their_text_is(spark):
    table = spark.createDataFrame([("a b a b c",), ("B c",), (None,)], "text string").repartition(2)
    counts = metrics.hash_buckets(table, 64)
    want = Counter()
    for words in ("a b a b c".split(), "b c".split()):
        for n in (1, 2, 3):
            for gram in zip(*[words[k:] for k in range(n)]):
                want[int.from_bytes(hashlib.blake2b(" ".join(gram).encode(), digest_size=8).digest(), "big") % 64] += 1
    assert {r["bucket"]: r["n"] for r in counts.collect()} == want


def test_quota_reads_and_adds_to_its_answers_once():
    class Answers(list):
        calls = 0

        def exists(self):
            return bool(self)

        def get(self):
            self.calls += 1
            return iter(self)

        def appendList(self, rows):  # noqa: N802
            self.calls += 1
            self.extend(rows)

    quota = budgets.Quota(2)
    quota.answers = Answers()
    for seqs, want in (((3, 1, 2, 0), [(0, False, True, 1), (1, False, True, 0), (2, True, True, 0), (3, False, False, 0)]), ((4, 5), [(4, True, True, 0), (5, True, False, 0)])):
        names = {0: "a", 1: "b", 2: "a", 3: "c", 4: "b", 5: "c"}
        got = quota.handleInputRows(("x", None), iter({"seq": s, "submission": names[s]} for s in seqs), None)
        assert [(r["seq"], r["repeated"], r["accepted"], r["remaining"]) for r in got] == want
    # one call adds the first answers, one reads them; nothing new is added then
    assert quota.answers.calls == 2


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_medians_leave_two_bins_of_a_set(spark):
    """The bins of a set are added up by tasks: the driver gets the wanted ones, not all of them."""
    rng = np.random.default_rng(3)
    rows = [(s, int(b), float(n), 0.0, math.inf) for s in (1, 4) for b, n in enumerate(rng.integers(1, 5, 400))]
    table = spark.createDataFrame(rows * 2, "set int, bin long, n double, low double, high double").repartition(5)
    got = {(r["set"], r["end"]): (r["bin"], r["nth"], r["n"]) for r in evaluation.wanted_bins(table, 0, None).collect()}
    assert len(got) == 4

    def plain(own, k):
        for b, n in own:
            if k < n:
                return b, k, n
            k -= n

    for s in (1, 4):
        own = [(b, 2 * n) for name, b, n, *_ in rows if name == s]
        total = sum(n for _, n in own)
        assert [got[s, e] for e in (0, 1)] == [plain(own, (total - 1) // 2), plain(own, total // 2)]
    pending = {(1, 0): (7, 5.0), (1, 1): (7, 6.0), (4, 1): (3, 0.0)}
    got = {(r["set"], r["end"]): (r["bin"], r["nth"], r["n"]) for r in evaluation.wanted_bins(table, 4, pending).collect()}
    assert got == {key: plain([(b, 2 * n) for name, b, n, *_ in rows if name == key[0] and b >> 4 == p], k) for key, (p, k) in pending.items()}


def test_resamples_are_not_broadcast(spark, monkeypatch):
    """Fifty times the corpus comes of a table of fifty numbers, so its size is not known before."""
    seen = []
    monkeypatch.setattr(evaluation, "cut", lambda df: (seen.append(plan_of(df)), cut(df))[1])
    table = spark.range(60).select(F.col("id").alias("pos"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    evaluation.human_floor(table, 3).first()
    joined = [p for p in seen if "MapInPandas" in p]
    assert joined and not any("BroadcastHashJoin" in p and "MapInPandas" in p[p.index("BroadcastExchange") :] for p in joined if "BroadcastExchange" in p)
    assert all("SortMergeJoin" in p for p in joined)


def test_reaper_tick_does_not_sort_the_log(spark, monkeypatch):
    """The log meets its runs without being sorted, also when these are too many to be broadcast."""

    class Seen(Exception):
        pass

    def caught(df, path):
        raise Seen(plan_of(df))

    monkeypatch.setattr(io, "append_events", caught)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        catalog_runs.reaper_tick(spark, "/root/testdata/sf0.001")
    except Seen as seen:
        plan = str(seen)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Sort [" not in plan


def test_resamples_share_their_distances(spark, monkeypatch):
    """The blocks that are compared hold each vector once, however many resamples there are, and the
    floor is that of each resample's own matrix."""
    rng = np.random.default_rng(8)
    v = rng.integers(0, 40, (90, 3)).astype(float)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "pos long, v array<double>")
    want = evaluation.human_floor(table, 30).first()
    made, packed = [], evaluation.packed
    monkeypatch.setattr(evaluation, "packed", lambda *a: made.append(packed(*a)) or made[-1])
    monkeypatch.setattr(evaluation, "WHOLE", 10)
    monkeypatch.setattr(evaluation, "BLOCK", 40)
    got = evaluation.human_floor(table, 30).first()
    assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(got, want))
    assert [sum(len(r["n"]) // 8 for r in m.collect()) for m in made] == [90]


def test_kernels_between_bandwidths():
    middles = list(np.exp(np.random.default_rng(2).normal(3, 0.02, 50)))
    nodes, share = evaluation.between(middles)
    assert len(nodes) < 12
    d = np.r_[0, np.exp(np.linspace(-5, 12, 3000))]
    shared = share @ np.stack([evaluation.kernel(d.copy(), evaluation.bandwidths(m)) for m in nodes])
    own = np.stack([evaluation.kernel(d.copy(), evaluation.bandwidths(m)) for m in middles])
    assert np.abs(shared - own).max() < 1e-13
    # far apart, or few: each for itself
    assert evaluation.between([1.0, 9.0])[0] == [1.0, 9.0] and len(evaluation.between([1.0, 3.0, 9.0])[0]) == 3


def test_medians_outside_of_where_they_should_be(spark, monkeypatch):
    """Where a sample says that medians should be is only where they are looked for first."""
    v = np.random.default_rng(5).normal(0, 1, (60, 2))
    table = spark.createDataFrame([(0, i % 2, i, 1.0, x.tolist()) for i, x in enumerate(v)], "set int, side int, pos long, n double, v array<double>")
    d = ((v[:, None] - v[None]) ** 2).sum(-1)
    for low in (1e-9, 1e9):
        monkeypatch.setattr(evaluation, "shown", lambda *_, low=low: {0: (*(int(x) for x in np.array([low, low * 2]).view(np.int64)), 44)})
        assert math.isclose(evaluation.medians(table)[0], np.median(d[d > 0]), rel_tol=1e-12)


def test_a_probe_deals_out_its_texts(spark, monkeypatch):
    """A few texts are as many tasks' work as there are cores, not one task's."""
    sizes = []
    monkeypatch.setattr(evaluation, "cut", lambda df: (kept := cut(df), sizes.append((kept.columns, kept.rdd.getNumPartitions())))[0])
    table = spark.createDataFrame([(i, i % 2, ("ab cd " if i % 2 else "xy zu ") * 3) for i in range(12)], "pos long, label int, text string").coalesce(1)
    evaluation.probe(table, 2, 20).collect()
    work = [n for columns, n in sizes if "text" in columns or "terms" in columns]
    assert len(work) == 2 and min(work) >= spark.sparkContext.defaultParallelism

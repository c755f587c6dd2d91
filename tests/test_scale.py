"""Rows never meet in one task: running sums, ranks, folds; and the further
comparisons of corpora against NumPy."""

import io
import json
import math
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import archived, evaluation, events as ev
from corpusloom.plans.ranking import running_sums


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_running_sums(spark):
    rng = np.random.default_rng(1)
    rows = [(int(p), float(x) if k % 7 else None) for k, (p, x) in enumerate(zip(rng.permutation(500), rng.normal(0, 1, 500)))]
    got = running_sums(spark.createDataFrame(rows, "pos int, x double").repartition(5), [F.col("pos")], {"before": F.col("x"), "nth": F.lit(1)}, 6).orderBy("pos").collect()
    total = 0.0
    for k, (r, (_, x)) in enumerate(zip(got, sorted(rows))):
        assert r["nth"] == k and math.isclose(r["before"], total, abs_tol=1e-9)
        total += x or 0.0


def test_no_rows_in_one_task(spark):
    rows = spark.range(1000).select(F.col("id").alias("pos"), (F.col("id") % 2).cast("int").alias("label"), F.rand(1).alias("score"), F.lit(1.0).alias("cost"), F.lit("text").alias("text"))
    for df in (evaluation.folds(rows), ev.under_cap(rows, 10.0, 50), ev.micro_batches(rows, 7)):
        assert "SinglePartition" not in plan(df).replace("BroadcastExchange", "").split("Window")[0] or "rangepartitioning" not in plan(df)
        assert "partitionSpec=[]" not in plan(df) and "windowspecdefinition(pos" not in plan(df)
    assert ev.under_cap(rows, 10.0, 50).count() == 10 and ev.under_cap(rows, 1e9, 50).count() == 50
    sizes = {r["batch"]: r["n"] for r in ev.micro_batches(rows, 300).groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {0: 300, 1: 300, 2: 300, 3: 100}
    dealt = evaluation.folds(rows, 3).groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n")).collect()
    assert sorted(r["n"] for r in dealt) == [166, 166, 167, 167, 167, 167]
    s, y = np.array([(r["score"], r["label"]) for r in rows.select("score", "label").collect()]).T
    want = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert math.isclose(evaluation.auc(rows).first()[0], want, rel_tol=1e-12)


def corpora(spark, n=150, m=90, d=5, shift=0.7):
    rng = np.random.default_rng(4)
    x, y = rng.normal(0, 1, (n, d)) @ rng.normal(0, 1, (d, d)), rng.normal(shift, 2, (m, d))
    table = lambda v: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "pos long, v array<double>").repartition(4)
    return x, y, table(x), table(y)


def test_frechet_distance(spark):
    x, y, a, b = corpora(spark)
    s1, s2 = np.cov(x.T), np.cov(y.T)
    root = np.sqrt(np.linalg.eigvals(s1 @ s2).astype(complex)).sum().real
    want = ((x.mean(0) - y.mean(0)) ** 2).sum() + np.trace(s1) + np.trace(s2) - 2 * root
    assert math.isclose(archived.frechet(a, b).first()[0], want, rel_tol=1e-9)
    assert abs(archived.frechet(a, a).first()[0]) < 1e-6
    far = a.withColumn("v", F.transform("v", lambda v: v + 1e6))
    assert abs(archived.frechet(far, far).first()[0]) < 1e-3
    with pytest.raises(ValueError):
        archived.frechet(a, b.limit(1))


def test_mauve(spark):
    x, y, a, b = corpora(spark)
    centres = np.random.default_rng(0).normal(0, 2, (6, 5))
    p, q = (np.bincount(((v[:, None] - centres[None]) ** 2).sum(-1).argmin(1), minlength=6) / len(v) for v in (x, y))
    kl = lambda u, r: sum(s * math.log(s / t) for s, t in zip(u, r) if s > 0)
    points = [(0.0, 1.0), (1.0, 0.0)]
    for k in range(1, 26):
        r = k / 26 * p + (1 - k / 26) * q
        points.append((math.exp(-5 * kl(q, r)), math.exp(-5 * kl(p, r))))
    points.sort(key=lambda t: (t[0], -t[1]))
    want = sum((c[0] - u[0]) * (c[1] + u[1]) / 2 for u, c in zip(points, points[1:]))
    assert math.isclose(archived.mauve(a, b, centres=centres).first()[0], want, rel_tol=1e-12)
    assert math.isclose(archived.mauve(a, a, 8).first()[0], 1.0, rel_tol=1e-9) and 0 < archived.mauve(a, b, 8).first()[0] < 1
    # the centres of k-means do not depend on how rows are dealt, and each is the mean of its vectors
    pooled = a.select(F.lit(0).alias("side"), "pos", "v")
    c = archived.quantised(pooled, 4, 200)
    assert np.allclose(c, archived.quantised(pooled.repartition(7), 4, 200))
    own = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
    assert np.allclose(c, [x[own == k].mean(0) for k in range(4)])


def test_chrf(spark):
    cases = [("same text", "same text", 100.0), ("", "", 0.0), (None, "a", 0.0), ("abc", "xyz", 0.0), ("a b c", "abc", 100.0)]
    got = archived.chrf(spark.createDataFrame([(i, g, h) for i, (g, h, _) in enumerate(cases)], "i int, generated string, human string"), "i").orderBy("i").collect()
    assert [r["chrf"] for r in got] == [w for *_, w in cases]
    # one order each: precision 1/2 and recall 1
    half = archived.chrf(spark.createDataFrame([(0, "ab", "a")], "i int, generated string, human string"), "i").first()["chrf"]
    assert math.isclose(half, 100 * 5 * 0.5 / (4 * 0.5 + 1))


def test_token_reports(spark):
    made = spark.createDataFrame([("slop slop word",), ("slop here",)] + [("word",)] * 98, "text string")
    human = spark.createDataFrame([("word here",), ("word",)], "text string")
    over = {r["token"]: (r["made_share"], r["human_share"], r["ratio"], r["rank"]) for r in archived.overused(made, human).collect()}
    assert over == {"slop": (0.02, 0.0, None, 1), "word": (0.99, 1.0, 0.99, 2)}
    shifts = archived.token_shifts(made, human, 2).orderBy("rank").collect()
    assert [r["rank"] for r in shifts] == [1, 2] and shifts[0]["cumulative"] < shifts[1]["cumulative"] <= 1.0
    assert abs(archived.token_divergence(made, made).first()[0]) < 1e-12 and archived.token_divergence(made.limit(0), made.limit(0)).first()[0] == 0.0


def test_free_form_facts(spark):
    from corpusloom.operators import metrics

    def plain(value):
        if isinstance(value, str):
            return [value]
        if isinstance(value, dict):
            return [f for k in ("supported_facts", "facts", "quotations") for f in plain(value.get(k))]
        return [f for x in value for f in plain(x)] if isinstance(value, list) else []

    cases = [None, "one", ["a", None, ["b", ["c", {"facts": "d"}]]], {"quotations": ["q"], "facts": {"facts": ["f"], "supported_facts": "s"}, "other": "no"}, {}, [], 5, [True, {"supported_facts": [1, "x"]}], {"facts": [{"quotations": "deep"}] * 12}]
    rows = [(i, json.dumps(c)) for i, c in enumerate(cases)] + [(99, None)]
    got = {r["i"]: r["facts"] for r in metrics.free_facts(spark.createDataFrame(rows, "i int, outline string"), "i").collect()}
    assert got == {i: plain(c) for i, c in enumerate(cases)} | {99: []}
    variants = spark.createDataFrame(rows, "i int, t string").select("i", F.try_parse_json("t").alias("outline"))
    assert {r["i"]: r["facts"] for r in metrics.free_facts(variants, "i").collect()} == got


def test_split_hashes_stream(spark):
    import hashlib

    from corpusloom.operators import corpus

    prints = {s: sorted(hashlib.sha256(f"{s}{i}".encode()).hexdigest() for i in range(n)) for s, n in (("dev", 700), ("train", 2300), ("a", 1))}
    table = spark.createDataFrame([(s, p) for s, own in prints.items() for p in own], "split string, fingerprint string").repartition(9)
    got = {r["split"]: (r["n"], r["hash"]) for r in corpus.split_hashes(table).collect()}
    assert got == {s: (len(own), hashlib.sha256("\n".join(own).encode()).hexdigest()) for s, own in prints.items()}


def test_reports_without_numbers_json_cannot_hold(spark, tmp_path):
    from corpusloom.sources import io as sinks

    nan = F.lit(float("nan"))
    good = spark.range(1).select(F.lit(1.0).alias("x"), F.array(F.lit(0.5)).alias("ci"), F.struct(F.array(F.struct(F.lit(2.0).alias("y"))).alias("z")).alias("s"), F.lit("NaN").alias("t"))
    sinks.write_report(good, f"{tmp_path}/good")
    for column, value in (("x", nan), ("x", F.lit(float("inf"))), ("ci", F.array(F.lit(0.5), nan)), ("s", F.struct(F.array(F.struct(nan.alias("y"))).alias("z")))):
        with pytest.raises(Exception, match="NaN or infinite"):
            sinks.write_report(good.withColumn(column, value), f"{tmp_path}/bad")


def test_no_texts_have_no_integrity(spark):
    from corpusloom.operators import metrics

    with pytest.raises(Exception, match="no texts"):
        metrics.language_integrity(spark.createDataFrame([], "text string"), 0.0, 1.0).collect()

"""Hand-derived results for the operators on small inputs."""

import inspect
import math

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom import catalog
from corpusloom.operators import corpus, evaluation, events as ev, metrics
from corpusloom.sources import io


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "pos long, text string")


def test_cleaning(spark):
    raw = "HOME page\r\nHomeowners unite\rBREAKING NEWS\n\n\n\nA  b c\tend.\x1c\n  \nABOUT us"
    assert value(spark, corpus.cleaned(F.lit(raw))) == "A b c end."
    assert value(spark, corpus.cleaned(F.lit("Menu\nSubscribe"))) == ""


def test_tokens_sentences_paragraphs(spark):
    assert value(spark, T.tokens(F.lit("Don't x_y 3rd ’s"))) == ["Don't", "x", "y", "3rd", "s"]
    assert value(spark, T.sentences(F.lit("One. Two!  Three\nfour"))) == ["One.", "Two!", "Three", "four"]
    assert value(spark, T.paragraphs(F.lit("a\n \nb\n\n\nc"))) == ["a", "b", "c"]
    assert value(spark, T.casefold(F.lit("STRAßE"))) == "strasse"


def test_outline_and_styles(spark):
    long = "x" * 200 + ". Second one. Third."
    o = value(spark, corpus.outline(F.lit(f"{long}\n\nNext part.\n\nb.\n\nd."), F.lit("T")))
    assert [s["section"] for s in o] == ["T", "T (2)", "T (3)"] and len(o[0]["supported_facts"]) == 2
    assert o[0]["supported_facts"][0] == "x" * 159 + "…" == o[0]["quotations"][0]
    assert value(spark, corpus.use_case(F.lit("How To x"), F.lit("d"))) == "guide"
    assert value(spark, corpus.style(F.lit("why?"), F.lit(1)))["style_kind"] == "instructive"


def test_split_counts(spark):
    rows = spark.createDataFrame([(f"f{i}",) for i in range(8)], "fingerprint string")
    got = dict(corpus.assign_splits(rows).groupBy("split").count().collect())
    assert got == {"train": 6, "dev": 2} and corpus.empty_outlines(rows).count() == 2
    with pytest.raises(ValueError):
        corpus.assign_splits(rows.limit(1))


def test_lexical_and_structural(spark):
    words = spark.createDataFrame([("red",), ("blue",)], "feature string")
    a, b = docs(spark, "red red"), docs(spark, "blue blue")
    assert math.isclose(metrics.lexical_l2(a, b, features=words, high=1).first()[0], math.sqrt(2))
    assert metrics.lexical_l2(a, a).first()[0] == 0.0
    assert all(r["js"] < 1e-9 for r in metrics.structural(a, a).collect())
    assert all(0 <= r["js"] <= 1 for r in metrics.structural(a, docs(spark, "The end. " * 30)).collect())


def test_validity(spark):
    pairs = spark.createDataFrame([("the cat sat on the mat", ["the cat sat", "dogs run far away"])], "text string, facts array<string>")
    assert metrics.fact_recall(pairs).first()[0] == 0.5
    assert metrics.fact_recall(pairs.withColumn("facts", F.slice("facts", 1, 0))).first()[0] == 1.0
    two = spark.createDataFrame([("The cat sat down. Pigs fly over moons.", ["the cat sat down"])], "text string, facts array<string>")
    assert metrics.unsupported_rate(two).first()[0] == 0.5
    assert value(spark, metrics.script_rate(F.lit("plain English 123"))) == 0.0 and value(spark, metrics.script_rate(F.lit("你好"))) == 1.0


def test_repetition_and_bleu(spark):
    assert value(spark, metrics.repeated_start(F.lit("I go. I see. I win."))) and not value(spark, metrics.repeated_start(F.lit("I go. I see. You win.")))
    got = {r["pos"]: r["bleu"] for r in metrics.bleu_vs_rest(docs(spark, "a b c d", "a b c d", "", "x"), "pos").collect()}
    assert math.isclose(got[0], 1.0) and got[2] == 0.0 and got[0] == got[1]
    assert metrics.self_bleu(docs(spark, "a b"), "pos").first()[0] == 0.0


def test_kernel_distance(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x, y = rng.normal(0, 1, (12, 4)), rng.normal(1, 1, (9, 4))
    frame = lambda m: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "pos long, v array<double>")
    z = np.concatenate([x, y])
    d = ((z[:, None] - z[None]) ** 2).sum(-1)
    bw = np.median(d[np.triu_indices(21, 1)])
    k = sum(np.exp(-d / (2 * bw * c * c)) for c in evaluation.BANDWIDTHS) / 5
    want = k[:12, :12][np.triu_indices(12, 1)].mean() + k[12:, 12:][np.triu_indices(9, 1)].mean() - 2 * k[:12, 12:].mean()
    assert math.isclose(evaluation.mmd(frame(x), frame(y)).first()[0], want, abs_tol=1e-9)
    with pytest.raises(ValueError):
        evaluation.human_floor(frame(x[:3]))


def test_preference_and_auc(spark):
    rows = spark.createDataFrame([("A", False), ("B", True), ("TIE", False)], "won string, swapped boolean")
    assert math.isclose(evaluation.preference(rows).first()["jmq"], 2 * 2.5 / 3)
    scores = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.1), (0, 0.2)], "label int, score double")
    assert evaluation.auc(scores).first()[0] == 1.0 and tuple(evaluation.auc_interval(scores, 50).first()) == (1.0, 1.0)
    assert tuple(evaluation.auc_interval(scores.where("score > 0.1")).first())[0] <= 1.0
    said = {
        "A": "A", " tie ": "TIE", "I pick b": "B", "The winner is A, not B": "A", "0.7": None, "banana": None, "": None, "{broken": None, "[1]": None,
        '{"winner": "tie"}': "TIE", '{"winner": 0.7}': "A", '{"choice": 0.5}': "TIE", '{"choice": 0}': "B", '{"winner": true}': "A", '{"winner": null, "choice": "A"}': None, '{"winner": "B", "choice": "A"}': "B", '{"other": "A"}': None,
    }
    got = spark.createDataFrame([(s,) for s in said], "s string").select("s", evaluation.winner(F.col("s"))).collect()
    assert {r[0]: r[1] for r in got} == said
    for bad in (rows.limit(0), rows.withColumn("won", F.lit(None).cast("string"))):
        with pytest.raises(Exception, match="judge"):
            evaluation.preference(bad).collect()


def test_an_odd_first_byte_shows_the_generated_text_first(spark):
    import hashlib

    rows = [(f"p{i}", f"g{i}", f"h{i}") for i in range(20)]
    odd = {r[0]: hashlib.sha256("\0".join(r).encode()).digest()[0] % 2 == 1 for r in rows}
    pairs = spark.createDataFrame(rows, "prompt string, generated string, human string")
    got = pairs.select("prompt", evaluation.swapped(F.col("prompt"), F.col("generated"), F.col("human"))).collect()
    assert {r[0]: not r[1] for r in got} == odd
    # a judge that always prefers generated texts gives 1, whatever the order
    from corpusloom.operators import surfaces

    judged = surfaces.judged(pairs, lambda prompt, candidate_a, candidate_b: "A" if candidate_a.startswith("g") else "B")
    assert evaluation.preference(judged.select("swapped", evaluation.winner(F.col("said")).alias("won"))).first()["preference"] == 1.0
    tied = surfaces.judged(pairs, lambda prompt, a, b: {"winner": 0.5})
    assert evaluation.preference(tied.select("swapped", evaluation.winner(F.col("said")).alias("won"))).first()["jmq"] == 1.0


def log(spark, rows):
    names = "seq kind ts run_id status reserved_cost_usd started_at timeout_seconds actual_cost_usd api_reserved_cost_usd task_kind cost_usd budget_class billing_month".split()
    kinds = "long string double string string double double long double double string double string string".split()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def test_budget_and_reaper(spark):
    rows = [
        {"seq": 1, "kind": "run", "ts": 1.75e9, "run_id": "a", "status": "running", "reserved_cost_usd": 100.0, "started_at": 1000.0, "timeout_seconds": 1000, "budget_class": "smoke", "billing_month": "2025-06"},
        {"seq": 2, "kind": "run_update", "ts": 1.75e9, "run_id": "a", "reserved_cost_usd": 12.0},
        {"seq": 3, "kind": "api_cost", "ts": 1.75e9, "run_id": "a", "cost_usd": 4.5},
    ]
    b = ev.budget(log(spark, rows)).first()
    assert (b["gpu_remaining_usd"], b["api_remaining_usd"]) == (28.0, 95.5)
    assert ev.accrued(log(spark, rows[:1]), 1100.0).first()[0] == 10.0
    assert [r["reaper_reason"] for r in ev.reap(log(spark, rows), 1000.0 + 1201).collect()] == ["wall_clock"]
    assert ev.reap(log(spark, rows[1:]), 5000.0).count() == 0
    assert value(spark, ev.reservation(F.lit(600), F.lit("L4"))) == 0.15984
    assert not value(spark, T.in_range(F.lit(1.0), F.lit(None).cast("double"), F.lit(2.0)))


def test_gates_fail_closed(spark):
    none = F.lit(None).cast("double")
    a, b = evaluation.gates(F.lit(0.9), F.lit(0.1), none, none)
    assert not value(spark, a) and not value(spark, b)


def test_sources(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"fineweb_id":"1","url":"u","domain":"d","title":"t","text":"x"}\n\n')
    assert io.raw_documents(spark, str(tmp_path / "x.jsonl")).count() == 1
    (tmp_path / "bad.jsonl").write_text('{"a":1}\n[2]\n')
    with pytest.raises(Exception, match="bad.jsonl:2"):
        io.strict_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    assert io.read_events(spark, str(tmp_path / "none.jsonl")).count() == 0
    with pytest.raises(ValueError):
        io.volume_path("vol://a/../../etc", "vol://a", "/data")


def test_fresh_probe_is_registered_with_the_defaults(spark, monkeypatch):
    seen, probe = [], evaluation.probe

    def small(texts, k=5, features=50_000):
        seen.append((k, features))
        rows = [(i, i % 2, ("ab cd " if i % 2 else "xy zu ") * 3 + "ok" * i) for i in range(12)]
        return probe(spark.createDataFrame(rows, "pos long, label int, text string"), k, features)

    monkeypatch.setattr(evaluation, "probe", small)
    assert catalog.QUERIES["fresh_probe"](spark, "/root/testdata/sf0.001").first()[0] == 1.0
    assert seen == [(5, 50_000)]


@pytest.mark.parametrize("query, operator, n_boot", [("human_floor_mmd", "human_floor", 50), ("auc_bootstrap", "auc_interval", 1000)])
def test_intervals_are_registered_with_all_resamples(spark, monkeypatch, query, operator, n_boot):
    signature = inspect.signature(getattr(evaluation, operator))

    def seen(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        return bound.arguments["n_boot"]

    monkeypatch.setattr(evaluation, operator, seen)
    assert catalog.QUERIES[query](spark, "/root/testdata/sf0.001") == n_boot


def test_modulo_pairs_count_over_gaps(spark):
    human = spark.createDataFrame([(5, "a"), (9, "b"), (40, "c")], "pos long, text string")
    made = spark.createDataFrame([(i,) for i in (1, 3, 4, 8, 90)], "pos long")
    assert sorted(map(tuple, evaluation.modulo_pairs(made, human).select("pos", "human").collect())) == [(1, "a"), (3, "b"), (4, "c"), (8, "a"), (90, "b")]


def test_a_probe_counts_its_grams_once_and_keeps_none_of_them(spark, monkeypatch):
    from collections import Counter

    kept, cut = [], evaluation.cut
    monkeypatch.setattr(evaluation, "cut", lambda df: kept.append(df.dtypes) or cut(df))
    texts = [(i, i % 2, ("Ab cd " if i % 2 else "xy zu ") * 3 + "ok" * i) for i in range(8)] + [(8, 0, None), (9, 1, "")]
    table = spark.createDataFrame(texts, "pos long, label int, text string")
    got = {r["pos"]: (r["label"], r["score"]) for r in evaluation.probe(table, 2, 20).collect()}
    assert {i: label for i, (label, _) in got.items()} == {i: label for i, label, _ in texts} and all(0 < x < 1 for _, x in got.values())
    assert not [t for t in kept if "array<string>" in dict(t).values()]
    fold = {r["pos"]: r["fold"] for r in evaluation.folds(table, 2).collect()}
    read = evaluation.vocabularies(evaluation.gram_totals(evaluation.folds(table, 2).select("fold", F.coalesce(F.lower("text"), F.lit("")).alias("text")), 2), 2, 20)
    for f in range(2):
        own = [Counter(t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1)) for t in ((t or "").lower() for i, _, t in texts if fold[i] != f)]
        best = sorted(sum(own, Counter()).items(), key=lambda x: (-x[1], x[0]))[:20]
        assert read[f] == {g: sum(g in c for c in own) for g, _ in best}

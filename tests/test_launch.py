"""Configurations, launches, surfaces, reports and files: hand-derived cases."""

import copy
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import corpus, evaluation, events as ev, launch, report, surfaces
from corpusloom.sources import io
from corpusloom.streaming import runs


def payload(**changes):
    config = {"run": {"comparison_id": "c1", "budget_class": "smoke", "command": [*launch.COMMAND, "--x"]}, "model": {"base": "m-4b"}, "compute": {"gpu": "l4", "gpus": 1, "timeout_min": 10}}
    for path, value in changes.items():
        part = config
        *above, last = path.split("__")
        for key in above:
            part = part.setdefault(key, {})
        part[last] = value
    return {"config": config, "config_hash": evaluation.canonical_hash(config), "budget_class": "smoke", "preregistration": {"kind": "prereg", "comparison": config["run"]["comparison_id"], "status": "open"}}


BRIEF = {"run__task_kind": "brief_synthesis", "data__input_uri": launch.VOLUME + "in", "data__output_uri": launch.VOLUME + "out", "api__max_cost_usd": 5.0}
REFUSED = [
    ({"config": None}, "config"), ({"config_hash": "x"}, "config_hash"), (payload(run__comparison_id=""), "comparison"), ({"preregistration": {}}, "preregistration"), ({"budget_class": "huge"}, "budget_class"),
    (payload(run__budget_class="promo"), "class_mismatch"), (payload(compute__gpus=2), "gpus"), (payload(compute__timeout_min=21), "timeout"), (payload(compute__timeout_min=0), "timeout"), (payload(run__task_kind="other"), "task_kind"),
    (payload(compute__gpu="K80"), "gpu"), (payload(model__base="big-14b"), "scale_up"), (payload(run__command=["sh"]), "command"), (payload(run__command="python -m runner"), "command"),
    (payload(**{**BRIEF, "data__input_uri": "file:///x"}), "volume"), (payload(**{**BRIEF, "api__max_cost_usd": 0.0}), "api_cost"), (payload(**{**BRIEF, "api__max_cost_usd": 101.0}), "api_cost"),
]


def test_refusals_come_in_order(spark):
    rows = [launch.request_row({**payload(), **change}) for change, _ in REFUSED]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + launch.REQUEST)
    got = [r["refusal"] for r in launch.judge_launches(table).orderBy("i").collect()]
    assert got == [why for _, why in REFUSED]
    with pytest.raises(launch.Refused, match="gpus"):
        launch.validate_launch(spark, payload(compute__gpus=2))


def test_allowed_launches(spark):
    got = launch.validate_launch(spark, payload())
    assert got == launch.Launch("c1", "smoke", 600, "L4", round(600 * 0.000222 * 1.2, 6), "experiment", 0.0)
    assert launch.validate_launch(spark, payload(**BRIEF)).api_reserved_usd == 5.0
    assert launch.validate_launch(spark, payload(model__base="big-14b") | {"human_scaleup_approved": True}).gpu == "L4"


def test_configurations():
    config = {"Train": {"Reward": [{"embedder_id": "E1"}], "steps": None}, "eval": {"embedder": "E2"}, "list": [1, {"x": 2}]}
    assert list(launch.flattened(config).items()) == [(("train", "reward", "embedder_id"), "E1"), (("eval", "embedder"), "E2"), (("list",), 1), (("list", "x"), 2)]
    assert launch.Role(("x",), ()).named(launch.flattened(config)) == 2 and launch.Role(("steps",), ()).named(launch.flattened(config)) is None
    assert launch.ROLES["reward embedder"].named(launch.flattened(config)) == "E1" and launch.ROLES["reward embedder"].named({("eval", "embedder"): "E"}) is None
    launch.guard_representations(config)
    for bad in ({"reward_embedder": launch.DEV_EMBEDDER.upper()}, {"objective": {"embedder": launch.DEV_EMBEDDER}}, {"disc": "D", "eval_discriminator_id": "d"}):
        with pytest.raises(ValueError):
            launch.guard_representations(bad)
    assert launch.check_train_hash({}, "h") == launch.check_train_hash({"data": {"train_split_hash": "h"}}, "h") == "h"
    with pytest.raises(ValueError):
        launch.check_train_hash({"data": {"train_split_hash": "g"}}, "h")
    assert launch.baseline_value({"a": {"mean": 2}, "b": 3, "c": {"mean": None}}, "a", "mean", 0.0) == 2.0 and launch.baseline_value({"b": 3}, "b", "mean", 0.0) == 3.0 and launch.baseline_value({"c": {"mean": None}}, "c", "mean", 7.0) == 7.0


def test_samplers_and_responses():
    good = {"frozen": True, "prompt_bank": "p", "prompt_format": "x {user_prompt}", "seed": 0, "batch_size": 1, "max_input_tokens": 9, "max_new_tokens": 9, "do_sample": True, "temperature": 0.5, "top_p": 1.0}
    assert launch.check_sampler(good) == good
    for change in ({"frozen": 1}, {"seed": None}, {"seed": True}, {"seed": -1}, {"batch_size": 0}, {"top_p": 0}, {"temperature": 0}, {"do_sample": 1}, {"prompt_bank": " "}, {"prompt_format": "{user_prompt} {other}"}, {"prompt_format": "none"}, {"max_new_tokens": 1.5}):
        with pytest.raises(ValueError, match="sampler"):
            launch.check_sampler(good | change)
    with pytest.raises(ValueError, match="seed must be.*top_p must be"):
        launch.check_sampler(good | {"seed": -1, "top_p": 2})
    answer = dict.fromkeys(launch.RESPONSE_KEYS) | {"aggregate_only": True, "primary": dict.fromkeys(launch.PRIMARY_KEYS, 0.1), "verdict": "confirm"}
    assert launch.check_response(answer) == answer
    for bad in (None, answer | {"texts": []}, answer | {"aggregate_only": 1}, answer | {"primary": {}}, answer | {"verdict": "maybe"}):
        with pytest.raises(ValueError):
            launch.check_response(bad)


def test_surfaces(spark):
    docs = spark.createDataFrame([(0, "The end, and the AND"), (1, None)], "pos long, text string")
    assert [r["v"] for r in surfaces.embed(docs, surfaces.toy_embedding).orderBy("pos").collect()] == [[20.0, 3.0, 2.0, 2.0, 2.0], [0.0] * 5]

    class Model:
        def encode(self, texts):
            return np.ones((len(texts), 2))

    assert surfaces.embed(docs, Model()).first()["v"] == [1.0, 1.0]
    for bad in (lambda texts: [1.0] * len(texts), lambda texts: [[float("nan")]] * len(texts), lambda texts: [[1.0]] * (len(texts) + 1)):
        with pytest.raises(Exception, match="embedder made"):
            surfaces.embed(docs, bad).collect()
    with pytest.raises(TypeError):
        surfaces.embed(docs, "a model's name")
    assert surfaces.embed(docs, "ones", load=lambda name: {"ones": Model()}[name]).first()["v"] == [1.0, 1.0]

    class Judge:
        def compare(self, prompt, candidate_a, candidate_b):
            return {"winner": 0.9}

    assert surfaces.ask(Judge(), "p", "a", "b") == {"winner": 0.9} and surfaces.ask(lambda p, x, y: y, "p", "a", "b") == "b"
    with pytest.raises(TypeError):
        surfaces.ask(object(), "p", "a", "b")

    class Chat:
        model = "m"

        class chat:  # noqa: N801
            class completions:  # noqa: N801
                @staticmethod
                def create(model, temperature, messages):
                    sent = json.loads(messages[0]["content"].splitlines()[-1])
                    answer = type("Answer", (), {"content": "B" if sent["B"] > sent["A"] else "A"})
                    return type("Answers", (), {"choices": [type("Choice", (), {"message": answer})]})

    assert surfaces.ask(Chat(), "p", "a", "b") == "B" and surfaces.ask(Chat(), "p", "z", "b") == "A"
    assert surfaces.probe_scores(docs.where("pos = 0"), lambda texts: [len(t) for t in texts]).first()["score"] == 20.0
    with pytest.raises(Exception, match="cannot be used"):
        surfaces.probe_scores(docs, lambda texts: [float("inf")] * len(texts)).collect()


def test_reports(spark):
    rows = lambda *t: spark.createDataFrame([(i, x) for i, x in enumerate(t)], "pos long, text string")
    with pytest.raises(ValueError, match="paired"):
        report.zipped(rows("a", "b"), rows("a").withColumnRenamed("text", "other"))
    with pytest.raises(ValueError):
        report.need_rows(rows("a", "b"), rows("a", "b", "c"))
    with pytest.raises(ValueError):
        report.collapse_flags(rows("a").limit(0), "pos", {})
    flags = report.collapse_flags(rows("One two three.", "Four five six."), "pos", {"self_bleu": {"low": 0.0, "high": 1.0}}).first()
    assert flags["self_bleu_in_range"] and not flags["repetition_in_range"] and not flags["passed"]
    assert math.isclose(report.repetition_rate(rows("I go. I see. I win.", "You go.")).first()[0], 0.5)
    samples = spark.createDataFrame([("", "two words", "x"), (None, None, "one"), (None, "", None)], "output string, generated_completion string, completion string")
    assert report.generated_tokens(samples).first()["tokens"] == 3
    kept = report.synthesis_texts(spark.createDataFrame([(2, "  ", "b"), (1, None, "text"), (0, "long one", "c")], "pos int, completion string, text string"), 5, 4).collect()
    assert [(r["source_text"], r["prompt_text"]) for r in kept] == [("long one", "long"), ("text", "text")]


def test_keys_of_answers(spark):
    cases = {'```json\n{"a": 1}\n```': '{"a": 1}\n', '  {"a": 1} ': '{"a": 1}', '```\n{"a": "```"}\n```': '{"a": "```"}\n', "none": "none"}
    table = spark.createDataFrame([(c,) for c in cases], "c string")
    assert {r[0]: r[1] for r in table.select("c", T.unfenced(F.col("c"))).collect()} == cases
    row = spark.createDataFrame([('{"a": 1, "b": 2}',)], "c string").select(T.missing_keys(F.col("c"), ["z", "a"]), T.same_keys(F.col("c"), ["b", "a"]), T.same_keys(F.col("c"), ["a"])).first()
    assert tuple(row) == (["z"], True, False)


def test_transitions(spark):
    rows = [("a", 1, "reserved"), ("a", 2, "running"), ("a", 3, "running"), ("a", 4, "failed"), ("a", 5, "running"), ("b", 1, "completed"), ("c", 1, "reserved"), ("c", 2, "launch_failed"), ("c", 3, None)]
    got = {(r["run_id"], r["seq"]): r["legal"] for r in ev.transitions(spark.createDataFrame(rows, "run_id string, seq long, status string")).collect()}
    assert got == {("a", 1): True, ("a", 2): True, ("a", 3): True, ("a", 4): True, ("a", 5): False, ("b", 1): False, ("c", 1): True, ("c", 2): True}


def test_a_start_at_zero_is_now(spark):
    rows = spark.createDataFrame([(1, "run", "a", "running", 0.0, 50.0, 100, "smoke")], "seq long, kind string, run_id string, status string, started_at double, reserved_cost_usd double, timeout_seconds long, budget_class string").withColumn("actual_cost_usd", F.lit(None).cast("double"))
    assert ev.accrued(rows, 1e9).first()[0] == 0.0 and ev.reap(rows, 1e9).count() == 0


def test_the_gateway_keeps_within_the_caps(spark, tmp_path):
    rows = [(i, *launch.request_row(payload(compute__timeout_min=20, compute__gpu="H100"))) for i in range(30)]
    spark.createDataFrame(rows, "event_id long, " + launch.REQUEST).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("event_id long, " + launch.REQUEST).parquet(f"{tmp_path}/in")
    for attempt in ("one", "again"):
        runs.start_gateway(stream(), f"{tmp_path}/log", f"{tmp_path}/{attempt}", clock=lambda: 1.75e9, gpu_cap=10.0).awaitTermination()
    log = io.read_events(spark, f"{tmp_path}/log")
    one = 1200 * 0.001097 * 1.2
    assert log.count() == 30 and log.where("status = 'reserved'").count() == int(10.0 / one)


def test_files(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("")
    (tmp_path / "l.json").write_text("[1]")
    assert io.read_structured(tmp_path / "c.yaml") == {} and io.load_json(tmp_path / "none", 5) == 5
    with pytest.raises(ValueError):
        io.read_structured(tmp_path / "l.json")
    assert io.find_config(str(tmp_path)) == (None, {})
    (tmp_path / "config.json").write_text('{"a": 1}')
    (tmp_path / "train_config.json").write_text('{"a": 2}')
    assert io.find_config(str(tmp_path))[1] == {"a": 2}
    assert io.sample_file(str(tmp_path)) is None and io.sample_file(str(tmp_path / "l.json")) == str(tmp_path / "l.json")
    lines = ['{"a":1}', "", '{"a":2}'] * 50 + ["[3]", '{"a":3}']
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    with pytest.raises(ValueError, match="x.jsonl:151:"):
        io.strict_jsonl(spark, str(tmp_path / "x.jsonl"), "a int")
    (tmp_path / "y.jsonl").write_text("\n \n")
    with pytest.raises(ValueError, match="no rows"):
        io.strict_jsonl(spark, str(tmp_path / "y.jsonl"), "a int")


def test_tree_hash(tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    for d in (a, b):
        (d / "sub").mkdir(parents=True)
        (d / "sub" / "f").write_bytes(b"x" * 5)
        (d / "link").symlink_to("sub/f")
    assert io.tree_hash(str(a)) == io.tree_hash(str(b)) and len(io.tree_hash(str(a))) == 16
    assert [(k, n) for k, n, _ in io.tree(str(a))] == [("L", "link"), ("D", "sub"), ("F", "sub/f")]
    (b / "sub" / "f").write_bytes(b"y" * 5)
    assert io.tree_hash(str(a)) != io.tree_hash(str(b))
    with pytest.raises(FileNotFoundError):
        io.tree_hash(str(tmp_path / "none"))


def test_a_dataset_that_was_changed_is_found_out(spark, tmp_path):
    raw = spark.createDataFrame([(f"f{i}", "u", "d.example", f"Title {i}", f"Some text number {i}.\n\nMore of it here {i}.") for i in range(8)], io.RAW)
    built, folder = corpus.build(raw), str(tmp_path / "set")
    io.write_dataset(built, folder, {"fixture": "x"})
    first = json.loads((tmp_path / "set" / "brief_records_all.jsonl").read_text().splitlines()[0])
    assert list(first) == sorted(first) and all(list(o) == ["quotations", "section", "supported_facts"] for o in first["outline"])
    assert sorted(p.name for p in (tmp_path / "set").iterdir() if p.suffix.startswith(".json")) == sorted(["brief_records_all.jsonl", "cleaned_records.jsonl", "dev_briefs.jsonl", "train_briefs.jsonl", "dev_manifest.json", "train_manifest.json", "hidden_test_boundary.json", "source.json", "split_hashes.json", "summary.json"])
    ok = io.verify_dataset(built, folder).first()
    assert ok["train_hash_matches"] and ok["dev_hash_matches"] and ok["fixture_records"] == 8 and ok["empty_outline_count"] == 2
    changed = corpus.build(raw.where("fineweb_id <> 'f3'"))
    assert not io.verify_dataset(changed, folder).first()["train_hash_matches"] or not io.verify_dataset(changed, folder).first()["dev_hash_matches"]


def test_a_manifest_is_written_line_by_line(spark, tmp_path):
    raw = spark.createDataFrame([(f'f"{i}', "u", None if i == 3 else "dé\n.example", f"Title {i}", f"Some text number {i}.") for i in range(9)], io.RAW)
    built, folder = corpus.build(raw), str(tmp_path / "set")
    rows = {r["split"]: r.asDict(True) for r in built["manifests"].collect()}
    # no row that holds a whole manifest is made
    built["manifests"] = spark.range(1).select(F.raise_error(F.lit("a whole manifest")).cast("string").alias("split"), F.lit("").alias("hash"))
    io.write_dataset(built, folder, {"fixture": "x"})
    for name, row in rows.items():
        assert (tmp_path / "set" / f"{name}_manifest.json").read_text() == json.dumps(row, ensure_ascii=False, indent=2, sort_keys=True) + "\n"
    ok = io.verify_dataset(built, folder).first()
    assert len(rows) == 2 and ok["train_hash_matches"] and ok["dev_hash_matches"]


def test_human_floor_of_an_odd_number(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(0, 1, (9, 3))
    got = evaluation.human_floor(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "pos long, v array<double>"), 5).first()
    own, want = np.random.default_rng(0), []
    order = own.permutation(9)
    for _ in range(5):
        x, y = order[:4][own.integers(0, 4, 4)], order[4:8][own.integers(0, 4, 4)]
        want.append(evaluation.block_mmd(v[x], v[y]))
    assert math.isclose(got["mean"], np.mean(want), rel_tol=1e-9) and math.isclose(got["high"], np.quantile(want, 0.975), rel_tol=1e-9)


def test_bootstrap_follows_one_stream(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(i % 3 == 0), float(x)) for i, x in enumerate(rng.normal(0, 1, 40))]
    got = evaluation.auc_interval(spark.createDataFrame(rows, "pos long, label int, score double"), 20).first()
    own, boots = np.random.default_rng(0), []
    neg, pos = (np.array([r[2] for r in rows if r[1] == k]) for k in (0, 1))
    for _ in range(20):
        y, x = own.choice(neg, len(neg)), own.choice(pos, len(pos))
        boots.append(np.mean([(a > b) + 0.5 * (a == b) for a in x for b in y]))
    assert math.isclose(got["low"], np.quantile(boots, 0.025)) and math.isclose(got["high"], np.quantile(boots, 0.975))


def test_median_of_many_distances(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "NEAR", 3)
    monkeypatch.setattr(evaluation, "BLOCK", 7)
    rng = np.random.default_rng(5)
    for n in (9, 10, 31):
        v = np.round(rng.normal(0, 1, (n, 2)), 1)
        table = spark.createDataFrame([(i % 2, i, r.tolist()) for i, r in enumerate(v)], "side int, pos long, v array<double>")
        d = ((v[:, None] - v[None]) ** 2).sum(-1)[np.triu_indices(n, 1)]
        assert math.isclose(evaluation.median_distance(table), np.median(d[d > 0]), rel_tol=1e-12)
    same = spark.createDataFrame([(0, i, [1.0, 2.0]) for i in range(5)], "side int, pos long, v array<double>")
    assert evaluation.median_distance(same) == 1.0 and copy.copy(launch.REFUSALS)[0] == "config"

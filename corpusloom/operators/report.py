"""Reports over a generated and a human corpus: the distribution gap,
collapse, the batch diagnostics and the whole evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.text import in_range, tokens
from corpusloom.operators import evaluation, metrics
from corpusloom.operators.launch import baseline_value
from corpusloom.sources.io import GENERATED_KEYS, TEXT_KEYS, first_text

LEAST_GENERATED, LEAST_HUMAN = 2, 4
NOTICE = "training diagnostics; not for evaluation"


def zipped(*tables: DataFrame) -> DataFrame:
    """Tables of the same length side by side, by their ``pos``; a position
    that a table lacks is an error."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, "pos", "full_outer")
    n = [t.count() for t in tables]
    if len(set(n)) > 1 or not n[0] or out.count() != n[0]:
        raise ValueError(f"tables of {', '.join(map(str, n))} rows cannot be paired")
    return out


def need_rows(generated: DataFrame, human: DataFrame) -> None:
    if generated.limit(LEAST_GENERATED).count() < LEAST_GENERATED or human.limit(LEAST_HUMAN).count() < LEAST_HUMAN:
        raise ValueError(f"an evaluation takes {LEAST_GENERATED} generated and {LEAST_HUMAN} human texts at least")


def record_text(df: DataFrame) -> Column:
    """A record's text: the first of TEXT_KEYS that is a string."""
    return F.coalesce(first_text(df, TEXT_KEYS), F.raise_error(F.lit("a record has no text")).cast("string"))


def generated_tokens(samples: DataFrame) -> DataFrame:
    """One row: tokens of all samples, each by the first of GENERATED_KEYS
    that is not empty."""
    return samples.agg(F.coalesce(F.sum(F.size(tokens(F.coalesce(first_text(samples, GENERATED_KEYS, blank=False), F.lit(""))))), F.lit(0)).alias("tokens"))


def synthesis_texts(records: DataFrame, most: int = 50_000, chars: int = 120_000) -> DataFrame:
    """Records to be synthesised: their completion or else their text, blank
    ones skipped, ``most`` of them in the order of ``pos``; ``prompt_text``
    is what of the text goes into a prompt."""
    whole = F.coalesce(first_text(records, ("completion", "text"), blank=False), F.lit(""))
    kept = records.withColumn("source_text", whole).where(F.regexp_like("source_text", F.lit(r"(?U)[^\s\x1c-\x1f]")))
    return kept.orderBy("pos").limit(most).withColumn("prompt_text", F.substring("source_text", 1, chars))


def repetition_rate(docs: DataFrame, run: int = 3) -> DataFrame:
    """The share of documents with ``run`` like sentence starts in a row."""
    return docs.agg(F.coalesce(F.avg(metrics.repeated_start(F.coalesce("text", F.lit("")), run).cast("double")), F.lit(0.0)).alias("repetition_rate"))


def structural_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    return metrics.structural(a, b).agg(F.avg("js").alias("structural_distance"))


def diversity(docs: DataFrame, key: str) -> DataFrame:
    """One row: self-BLEU, repetition rate, mean share of other scripts."""
    script = docs.agg(F.coalesce(F.avg(metrics.script_rate(F.coalesce("text", F.lit("")))), F.lit(0.0)).alias("script_rate"))
    return metrics.self_bleu(docs, key).join(repetition_rate(docs), F.lit(True)).join(script, F.lit(True))


def collapse_diagnostics(docs: DataFrame, key: str) -> DataFrame:
    """Diversity and whether it passes the fixed thresholds."""
    return diversity(docs, key).withColumn("passed", ~metrics.collapse(F.col("self_bleu"), F.col("repetition_rate"), F.col("script_rate")))


def collapse_flags(docs: DataFrame, key: str, calibration: dict) -> DataFrame:
    """Self-BLEU and repetition against calibrated ranges; a missing bound
    fails."""
    if docs.isEmpty():
        raise ValueError("collapse is defined for one text at least")

    def inside(value: str, name: str) -> Column:
        bounds = calibration.get(name) or {}
        return in_range(F.col(value), *[F.lit(bounds.get(k)).cast("double") for k in ("low", "high")])

    out = diversity(docs, key).select("self_bleu", "repetition_rate", inside("self_bleu", "self_bleu").alias("self_bleu_in_range"), inside("repetition_rate", "repeated_sentence_start_rate").alias("repetition_in_range"))
    return out.withColumn("passed", F.col("self_bleu_in_range") & F.col("repetition_in_range"))


def distribution_gap(generated: DataFrame, human: DataFrame, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), features: DataFrame | None = None, dim: int = 2048) -> DataFrame:
    """One row over (pos, text, v) tables: the three distances, weighted."""
    vectors = lambda d: d.select("pos", "v")
    row = evaluation.mmd(vectors(generated), vectors(human)).withColumnRenamed("mmd", "semantic_mmd")
    row = row.join(metrics.lexical_l2(generated, human, dim, features), F.lit(True)).join(structural_distance(generated, human), F.lit(True))
    return row.withColumn("weighted_gap", weights[0] * F.col("semantic_mmd") + weights[1] * F.col("lexical_l2") + weights[2] * F.col("structural_distance"))


def batch_diagnostics(generated: DataFrame, human: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """One nested row over generated (pos, text, v, facts, target) and human
    (pos, text, v): distribution, validity, diversity, length, collapse."""
    facts = generated.select("text", "facts")
    length = metrics.length_stats(generated, "target").withColumnsRenamed({"mean": "mean_tokens", "median": "median_tokens", "min": "min_tokens", "max": "max_tokens", "mae": "mean_abs_target_error"})
    parts = {
        "distribution": distribution_gap(generated, human, features=features),
        "validity": metrics.fact_recall(facts).join(metrics.unsupported_rate(facts), F.lit(True)),
        "length": length,
        "collapse": collapse_diagnostics(generated, "pos"),
    }
    row = None
    for name, part in parts.items():
        part = part.select(F.struct("*").alias(name))
        row = part if row is None else row.join(part, F.lit(True))
    return row.select(F.lit(NOTICE).alias("notice"), "distribution", "validity", F.struct("collapse.self_bleu", "collapse.repetition_rate").alias("diversity"), "length", "collapse")


def z_score(value: Column, baseline: dict, name: str) -> tuple[Column, str | None]:
    """``value`` in standard deviations of the baseline, or as it is and a
    note that says so."""
    section = baseline.get(name)
    known = isinstance(section, dict) and section.get("mean") is not None and section.get("std") is not None
    if not known:
        return value, f"no baseline of {name}: its raw value enters the score"
    return evaluation.standardised(value, float(section["mean"]), float(section["std"])), None


def evaluate(generated: DataFrame, human: DataFrame, *, calibration: dict, baseline: dict, judge=None, probe=None, features: DataFrame | None = None, n_boot: int = 50, checkpoint_id: str = "", version: str = "1") -> DataFrame:
    """The evaluation report, one row, over generated (pos, text, v, facts,
    prompt) and human (pos, text, v).

    ``judge`` and ``probe`` are surfaces; without a judge the neutral values
    are reported, without a probe a fresh one is fitted.  Gates that lack
    their baseline fail.
    """
    from corpusloom.operators import surfaces

    need_rows(generated, human)
    notes = []
    facts = generated.select("text", "facts")
    row = evaluation.mmd(generated.select("pos", "v"), human.select("pos", "v")).withColumnRenamed("mmd", "semantic_mmd")
    row = row.join(evaluation.human_floor(human.select("pos", "v"), n_boot).withColumnsRenamed({"mean": "floor", "low": "floor_low", "high": "floor_high"}), F.lit(True))
    row = row.join(metrics.lexical_l2(generated, human, features=features), F.lit(True)).join(structural_distance(generated, human).withColumnRenamed("structural_distance", "structural_dist"), F.lit(True))
    row = row.join(metrics.fact_recall(facts), F.lit(True)).join(metrics.unsupported_rate(facts), F.lit(True))
    row = row.join(collapse_flags(generated, "pos", calibration), F.lit(True))
    script = calibration.get("non_target_script_char_rate") or {}
    row = row.join(metrics.language_integrity(generated, script.get("low"), script.get("high")), F.lit(True))
    if judge is None:
        row = row.withColumns({"preference": F.lit(0.5), "jmq": F.lit(1.0)})
        notes.append("no judge: neutral values stand for preference and JMQ")
    else:
        paired = evaluation.modulo_pairs(generated.select("pos", "prompt", F.col("text").alias("generated")), human.select("pos", "text"))
        answers = surfaces.judged(paired.select("prompt", "generated", "human"), judge).select("swapped", evaluation.winner(F.col("said")).alias("won"))
        row = row.join(evaluation.preference(answers), F.lit(True))
        notes.append("the judge may prefer its own kind of text")
    both = human.select("pos", "text", F.lit(0).alias("label")).unionByName(generated.select("pos", "text", F.lit(1).alias("label")))
    scores = evaluation.probe(both) if probe is None else surfaces.probe_scores(both, probe).select("pos", "label", "score")
    if probe is None:
        notes.append("authorship by a fresh probe of letters, out of fold")
    scores = evaluation.cut(scores)
    row = row.join(evaluation.auc(scores).withColumnRenamed("auc", "authorship_auc"), F.lit(True)).join(evaluation.auc_interval(scores).withColumnsRenamed({"low": "auc_low", "high": "auc_high"}), F.lit(True))
    known = "outline_fact_recall" in baseline and "unsupported_claim_rate" in baseline
    recall, unsupported = (F.lit(baseline_value(baseline, name, "mean", default) if known else None).cast("double") for name, default in (("outline_fact_recall", 0.0), ("unsupported_claim_rate", 1.0)))
    gate_recall, gate_unsupported = evaluation.gates(F.col("fact_recall"), F.col("unsupported_rate"), recall, unsupported)
    if not known:
        notes.append("no baseline of validity: its gates fail")
    z = [z_score(F.col(c), baseline, name) for c, name in (("semantic_mmd", "semantic_mmd"), ("lexical_l2", "lexical_l2"), ("structural_dist", "structural_dist"))]
    notes += [note for _, note in z if note]
    interval = F.format_string("floor between %.6g and %.6g", "floor_low", "floor_high")
    return row.select(
        F.lit(checkpoint_id).alias("checkpoint_id"), F.lit(version).alias("harness_version"), evaluation.composite(*[c for c, _ in z]).alias("S"), "semantic_mmd", (F.col("semantic_mmd") - F.col("floor")).alias("semantic_mmd_delta_vs_human_floor"),
        "lexical_l2", "structural_dist", gate_recall.alias("gate_outline_fact_recall"), gate_unsupported.alias("gate_unsupported_claim_rate"),
        F.col("language_integrity").alias("gate_language_integrity"), F.col("passed").alias("gate_no_collapse"),
        F.col("preference").alias("quality_pref_winrate"), "jmq", "authorship_auc", F.array("auc_low", "auc_high").alias("authorship_auc_ci"), F.col("self_bleu").alias("diversity_self_bleu"), "repetition_rate",
        F.array(interval, *[F.lit(n) for n in notes]).alias("notes"),
    )

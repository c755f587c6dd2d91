"""Registered queries: reports over corpora, records, surfaces and files.

The human corpus is the labelled texts of quality 1, the generated one those
of quality 0; the toy embedding stands in for a model.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, functions as F

from corpusloom.catalog import FEATURES, GRID, OPEN_SQL, OVER, SCRIPT, WORD, HIST, bleu_sql, labelled, paras, raw, read, register, sents, toks
from corpusloom.functions import text as T
from corpusloom.operators import corpus, evaluation, launch, metrics, report, surfaces
from corpusloom.plans.ranking import global_rank
from corpusloom.session import cut, shared_folder
from corpusloom.sources import io

CALIBRATION = {"self_bleu": {"low": 0.0, "high": 0.6}, "repeated_sentence_start_rate": {"low": 0.0, "high": 0.2}, "non_target_script_char_rate": {"low": 0.0, "high": 0.01}}
BASELINE = {"semantic_mmd": {"mean": 0.02, "std": 0.01}, "lexical_l2": {"mean": 0.01, "std": 0.005}, "outline_fact_recall": {"mean": 0.5}, "unsupported_claim_rate": 0.4}


def scratch(spark, name: str) -> str:
    """A new path in the folder that all executors share."""
    shared_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def human(spark, sf_dir) -> DataFrame:
    return labelled(spark, sf_dir, 1).withColumnRenamed("doc_id", "pos")


def made(spark, sf_dir) -> DataFrame:
    return labelled(spark, sf_dir, 0).withColumnRenamed("doc_id", "pos")


def listed(spark) -> DataFrame:
    return spark.createDataFrame([(f,) for f in FEATURES], "feature string")


def equipped(spark, sf_dir) -> DataFrame:
    """Generated texts with vector, facts, target length and prompt."""
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), "text")
    rows = evaluation.modulo_pairs(made(spark, sf_dir).withColumnRenamed("text", "own"), items)
    rows = rows.select("pos", F.col("own").alias("text"), T.sentences(F.col("human")).alias("facts"), F.floor(F.length("own") / 6).alias("target"), F.concat(F.lit("Prompt "), F.col("pos").cast("string")).alias("prompt"))
    return cut(surfaces.embed(rows, surfaces.toy_embedding))


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


MADE = "gt AS (SELECT doc_id AS pos, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0))"
HUMAN = "ht AS (SELECT doc_id AS pos, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))"
COUNT = lambda part: f"(length(low) - length(replace(low, '{part}', ''))) // {len(part)}"
TOY = f"length(text) AS n, {COUNT('e')} AS e, {COUNT('a')} AS a, {COUNT('the')} AS the, {COUNT('and')} AS ands"


@register(f"SELECT doc_id, {TOY} FROM (SELECT doc_id, text, replace(lower(text), 'ß', 'ss') AS low FROM documents)")
def toy_embedding(spark, sf_dir):
    v = surfaces.embed(read(spark, sf_dir, "documents").select("doc_id", "text"), surfaces.toy_embedding)
    return v.select("doc_id", *[F.col("v")[i].cast("long").alias(n) for i, n in enumerate(("n", "e", "a", "the", "ands"))])


@register("SELECT doc_id, CAST(length(text) AS DOUBLE) AS x, CAST(len(string_split(text, ' ')) AS DOUBLE) AS y FROM documents")
def embedder_surface(spark, sf_dir):
    """A Python embedder over Arrow batches."""

    def encode(texts):
        return [[float(len(t)), float(t.count(" ") + 1)] for t in texts]

    return surfaces.embed(read(spark, sf_dir, "documents").select("doc_id", "text"), encode).select("doc_id", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))


RUNS = f"""ss AS (SELECT pos, unnest({sents('text')}) AS x, generate_subscripts({sents('text')}, 1) AS i FROM gt), sf AS (SELECT pos, i, {toks('x')}[1] AS w FROM ss), sk AS (SELECT * FROM sf WHERE w IS NOT NULL),
 sl AS (SELECT pos, w = lag(w, 1) OVER p AND w = lag(w, 2) OVER p AS hit FROM sk WINDOW p AS (PARTITION BY pos ORDER BY i)), hits AS (SELECT DISTINCT pos FROM sl WHERE hit),
 rep AS (SELECT avg(CASE WHEN pos IN (SELECT pos FROM hits) THEN 1.0 ELSE 0.0 END) AS repetition_rate, avg(CAST({SCRIPT} AS DOUBLE)) AS script_rate FROM gt)"""
BLEU = bleu_sql("gt", "pos") + ", sb AS (SELECT avg(bleu) AS self_bleu FROM bleu)"
CELLS = f"""gh AS (SELECT 0 AS q, pos, text FROM gt UNION ALL SELECT 1, pos, text FROM ht), par AS (SELECT q, unnest({paras('text')}) AS x FROM gh), sen AS (SELECT q, unnest({sents('text')}) AS x FROM gh),
 sw AS (SELECT q, {toks('x')} AS w FROM sen), st AS (SELECT q, w, len(w) AS n FROM sw WHERE len(w) > 0), pt AS (SELECT q, len(regexp_extract_all(x, {WORD})) AS n FROM par),
 cells AS (SELECT q, 'paragraph' AS kind, {HIST.format(*metrics.PARAGRAPH_EDGES)} AS bucket FROM pt UNION ALL SELECT q, 'sentence', {HIST.format(*metrics.SENTENCE_EDGES)} FROM st UNION ALL SELECT q, 'opening', {OPEN_SQL} FROM st), {GRID},
 cc AS (SELECT kind, bucket, count(*) FILTER (q = 1) AS a, count(*) FILTER (q = 0) AS b FROM cells GROUP BY kind, bucket), ch AS (SELECT kind, bucket, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM grid LEFT JOIN cc USING (kind, bucket)),
 cq AS (SELECT kind, a / sum(a) OVER (PARTITION BY kind) AS p, b / sum(b) OVER (PARTITION BY kind) AS q FROM ch), cm AS (SELECT *, (p + q) / 2 AS m FROM cq),
 js AS (SELECT kind, sqrt(greatest(0, (sum(CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END)) / 2)) AS js FROM cm GROUP BY kind), sd AS (SELECT avg(js) AS structural_distance FROM js)"""
LEXICAL = (
    f"lw AS (SELECT q, {toks('text')} AS w FROM (SELECT 0 AS q, text FROM gt UNION ALL SELECT 1, text FROM ht)), lg AS ("
    + " UNION ALL ".join(f"SELECT q, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS f FROM lw WHERE len(w) >= {n}" for n in (1, 2, 3))
    + "), lc AS (SELECT f, count(*) FILTER (q = 1) AS a, count(*) FILTER (q = 0) AS b FROM lg WHERE f IN ("
    + ", ".join(f"'{f}'" for f in FEATURES)
    + ") GROUP BY f), lx AS (SELECT sqrt(sum(d * d)) AS lexical_l2 FROM (SELECT a / sum(a) OVER () - b / sum(b) OVER () AS d FROM lc))"
)
SEMANTIC = f"""tv AS (SELECT q, pos, {TOY} FROM (SELECT q, pos, text, replace(lower(text), 'ß', 'ss') AS low FROM (SELECT 0 AS q, pos, text FROM gt UNION ALL SELECT 1, pos, text FROM ht))),
 tp AS (SELECT x.q AS x, y.q AS y, CAST((x.n - y.n) ** 2 + (x.e - y.e) ** 2 + (x.a - y.a) ** 2 + (x.the - y.the) ** 2 + (x.ands - y.ands) ** 2 AS DOUBLE) AS d FROM tv x JOIN tv y ON (x.q, x.pos) < (y.q, y.pos)),
 tm AS (SELECT quantile_cont(d, 0.5::DOUBLE) AS m FROM tp WHERE d > 0), tk AS (SELECT x, y, (exp(-d / (2 * m * 0.0625)) + exp(-d / (2 * m * 0.25)) + exp(-d / (2 * m)) + exp(-d / (2 * m * 4)) + exp(-d / (2 * m * 16))) / 5 AS k FROM tp, tm),
 sm AS (SELECT avg(k) FILTER (x = 0 AND y = 0) + avg(k) FILTER (x = 1 AND y = 1) - 2 * avg(k) FILTER (x <> y) AS semantic_mmd FROM tk)"""
PAIRED = f"""gi AS (SELECT pos, text, row_number() OVER (ORDER BY pos) - 1 AS i FROM gt), bi AS (SELECT text AS item, row_number() OVER (ORDER BY item_id) - 1 AS i FROM benchmark),
 gf AS (SELECT pos, text, {sents('item')} AS facts FROM gi JOIN bi ON gi.i % (SELECT count(*) FROM benchmark) = bi.i),
 f1 AS (SELECT {toks('text')} AS t, unnest(facts) AS f FROM gf), f2 AS (SELECT t, {toks('f')} AS f FROM f1), fr AS (SELECT coalesce(avg(CASE WHEN {OVER('f', 't')} >= 0.8 THEN 1.0 ELSE 0.0 END), 1.0) AS fact_recall FROM f2),
 u1 AS (SELECT unnest({sents('text')}) AS s, facts FROM gf), u2 AS (SELECT row_number() OVER () AS id, {toks('s')} AS c, facts FROM u1), u3 AS (SELECT * FROM u2 WHERE len(c) >= 4), u4 AS (SELECT id, c, unnest(facts) AS f FROM u3), u5 AS (SELECT id, c, {toks('f')} AS f FROM u4),
 uk AS (SELECT DISTINCT id FROM u5 WHERE greatest({OVER('c', 'f')}, {OVER('f', 'c')}) >= 0.6), ur AS (SELECT coalesce(1 - (SELECT count(*) FROM uk) / count(*), 0.0) AS unsupported_rate FROM u3)"""
LENGTHS = f"""ln1 AS (SELECT CAST(len(regexp_extract_all(text, {WORD})) AS DOUBLE) AS n, length(text) // 6 AS target FROM gt),
 le AS (SELECT avg(n) AS mean_tokens, quantile_cont(n, 0.5::DOUBLE) AS median_tokens, min(n) AS min_tokens, max(n) AS max_tokens, avg(abs(n - target)) AS mean_abs_target_error FROM ln1)"""


@register(f"WITH {MADE}, {RUNS} SELECT round(repetition_rate, 6) AS repetition_rate FROM rep")
def repetition_rate(spark, sf_dir):
    return rounded(report.repetition_rate(made(spark, sf_dir)))


@register(f"WITH {MADE}, {HUMAN}, {CELLS} SELECT round(structural_distance, 6) AS structural_distance FROM sd")
def structural_distance(spark, sf_dir):
    return rounded(report.structural_distance(human(spark, sf_dir), made(spark, sf_dir)))


@register(f"WITH {MADE}, {LENGTHS} SELECT round(mean_tokens, 6) AS mean, median_tokens AS median, min_tokens AS min, max_tokens AS max, round(mean_abs_target_error, 6) AS mae FROM le")
def length_against_target(spark, sf_dir):
    return rounded(metrics.length_stats(made(spark, sf_dir).withColumn("target", F.floor(F.length("text") / 6)), "target"))


@register(f"WITH {MADE}, {RUNS}, {BLEU} SELECT round(self_bleu, 6) AS self_bleu, round(repetition_rate, 6) AS repetition_rate, round(script_rate, 6) AS script_rate, self_bleu <= 0.95 AND repetition_rate <= 0.9 AND script_rate <= 0.15 AS passed FROM sb, rep")
def collapse_diagnostics(spark, sf_dir):
    return rounded(report.collapse_diagnostics(made(spark, sf_dir), "pos"))


@register(
    f"""WITH {MADE}, {RUNS}, {BLEU}, o AS (SELECT self_bleu, repetition_rate, self_bleu BETWEEN 0 AND 0.6 AS b, repetition_rate BETWEEN 0 AND 0.2 AS r FROM sb, rep)
 SELECT round(self_bleu, 6) AS self_bleu, round(repetition_rate, 6) AS repetition_rate, b AS self_bleu_in_range, r AS repetition_in_range, b AND r AS passed FROM o"""
)
def collapse_in_range(spark, sf_dir):
    return rounded(report.collapse_flags(made(spark, sf_dir), "pos", CALIBRATION))


@register(f"WITH {MADE}, {HUMAN}, {CELLS}, {LEXICAL}, {SEMANTIC} SELECT round(semantic_mmd, 6) AS semantic_mmd, round(lexical_l2, 6) AS lexical_l2, round(structural_distance, 6) AS structural_distance, round(semantic_mmd + lexical_l2 + structural_distance, 6) AS weighted_gap FROM sm, lx, sd")
def distribution_gap(spark, sf_dir):
    a, b = (cut(surfaces.embed(side(spark, sf_dir), surfaces.toy_embedding)) for side in (made, human))
    return rounded(report.distribution_gap(a, b, features=listed(spark)))


@register(
    f"""WITH {MADE}, {HUMAN}, {CELLS}, {LEXICAL}, {SEMANTIC}, {PAIRED}, {LENGTHS}, {RUNS}, {BLEU} SELECT '{report.NOTICE}' AS notice, round(semantic_mmd + lexical_l2 + structural_distance, 6) AS weighted_gap, round(fact_recall, 6) AS fact_recall, round(unsupported_rate, 6) AS unsupported_rate,
 round(self_bleu, 6) AS self_bleu, round(repetition_rate, 6) AS repetition_rate, round(mean_tokens, 6) AS mean_tokens, round(mean_abs_target_error, 6) AS mean_abs_target_error, self_bleu <= 0.95 AND repetition_rate <= 0.9 AND script_rate <= 0.15 AS passed FROM sm, lx, sd, fr, ur, le, sb, rep"""
)
def batch_diagnostics(spark, sf_dir):
    row = report.batch_diagnostics(equipped(spark, sf_dir), cut(surfaces.embed(human(spark, sf_dir), surfaces.toy_embedding)), listed(spark))
    fields = ("distribution.weighted_gap", "validity.fact_recall", "validity.unsupported_rate", "diversity.self_bleu", "diversity.repetition_rate", "length.mean_tokens", "length.mean_abs_target_error", "collapse.passed")
    return rounded(row.select("notice", *fields))


@register(
    f"""WITH {MADE}, {HUMAN}, {CELLS}, {LEXICAL}, {SEMANTIC}, {PAIRED}, {RUNS}, {BLEU} SELECT round(0.5 * (semantic_mmd - 0.02) / 0.01 + 0.25 * (lexical_l2 - 0.01) / 0.005 + 0.25 * structural_distance, 6) AS "S", fact_recall >= 0.45 AS gate_outline_fact_recall, unsupported_rate <= 0.45 AS gate_unsupported_claim_rate,
 script_rate BETWEEN 0 AND 0.01 AS gate_language_integrity, self_bleu BETWEEN 0 AND 0.6 AND repetition_rate BETWEEN 0 AND 0.2 AS gate_no_collapse, 1.0::DOUBLE AS quality_pref_winrate, 2.0::DOUBLE AS jmq,
 (WITH s AS (SELECT q AS label, CAST(n AS DOUBLE) AS score FROM tv), r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM s) SELECT round((sum(r) FILTER (label = 0) - count(*) FILTER (label = 0) * (count(*) FILTER (label = 0) + 1) / 2) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) FROM r) AS authorship_auc,
 3 AS n_notes FROM sm, lx, sd, fr, ur, rep, sb"""
)
def evaluation_report(spark, sf_dir):
    """The whole report, with a judge that knows the generated texts by the
    hash that their prompt carries and a probe that scores by length; its
    interval and floor are left out."""
    asked = equipped(spark, sf_dir).withColumn("prompt", F.concat_ws(" ", "prompt", F.sha2("text", 256)))
    own = cut(surfaces.embed(human(spark, sf_dir), surfaces.toy_embedding))

    def judge(prompt, candidate_a, candidate_b):
        return "A" if hashlib.sha256(candidate_a.encode()).hexdigest() in prompt else "B"

    def probe(texts):
        return [float(len(t)) for t in texts]

    row = report.evaluate(asked, own, calibration=CALIBRATION, baseline=BASELINE, judge=judge, probe=probe, features=listed(spark))
    kept = ("S", "gate_outline_fact_recall", "gate_unsupported_claim_rate", "gate_language_integrity", "gate_no_collapse", "quality_pref_winrate", "jmq", "authorship_auc")
    return rounded(row.select(*kept, F.size("notes").cast("long").alias("n_notes")))


SAMPLES = "sm AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text WHEN turn % 3 = 1 THEN '' END AS output, CASE WHEN turn % 2 = 0 THEN text END AS generated_completion, text || ' end' AS completion FROM conversations)"


def samples(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, F.lit("")).alias("output"), F.when(F.col("turn") % 2 == 0, F.col("text")).alias("generated_completion"), F.concat("text", F.lit(" end")).alias("completion"))


@register(f"WITH {SAMPLES} SELECT CAST(sum(len(regexp_extract_all(coalesce(nullif(output, ''), nullif(generated_completion, ''), nullif(completion, ''), ''), {WORD}))) AS BIGINT) AS tokens FROM sm")
def generated_token_total(spark, sf_dir):
    return report.generated_tokens(samples(spark, sf_dir))


@register(f"WITH {SAMPLES} SELECT conv_id, turn, length(coalesce(generated_completion, output, completion)) AS n FROM sm")
def record_texts(spark, sf_dir):
    """The first text of a record by the keys' order; empty texts count."""
    s = samples(spark, sf_dir)
    return s.select("conv_id", "turn", F.length(report.record_text(s)).cast("long").alias("n"))


@register(f"WITH {SAMPLES} SELECT (SELECT count(*) FROM sm) AS inline, (SELECT count(*) FROM documents) AS fallback")
def human_references(spark, sf_dir):
    """Inline references count if every row has one, else the fallback's."""
    s, d = samples(spark, sf_dir), read(spark, sf_dir, "documents")
    every = io.human_texts(s.withColumnRenamed("completion", "reference_completion"), d)
    some = io.human_texts(s.withColumnRenamed("generated_completion", "human_completion"), d)
    return every.agg(F.count("text").alias("inline")).join(some.agg(F.count("text").alias("fallback")), F.lit(True))


@register(f"WITH {SAMPLES}, t AS (SELECT conv_id, turn, nullif(output, '') AS body FROM sm), k AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS r FROM t WHERE trim(body) <> '') SELECT conv_id, turn, length(substr(body, 1, 100)) AS n FROM k WHERE r <= 1000")
def synthesis_inputs(spark, sf_dir):
    """Blank texts skipped, the first 1,000 records, prompts of 100
    characters: the operator's limits are its feature."""
    s = samples(spark, sf_dir).select("conv_id", "turn", F.struct("conv_id", "turn").alias("pos"), F.col("output").alias("text"))
    return report.synthesis_texts(s, 1000, 100).select("conv_id", "turn", F.length("prompt_text").cast("long").alias("n"))


BRIEF = ["user_prompt", "use_case", "outline"]


@register(
    """WITH c AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'X' WHEN event_id % 3 = 1 THEN 'A' ELSE 'B' END AS v FROM events)
 SELECT event_id, CASE v WHEN 'X' THEN NULL WHEN 'A' THEN 'outline' ELSE '' END AS missing, v = 'B' AS exact FROM c"""
)
def response_keys(spark, sf_dir):
    """Answers in a code fence, or broken: what they lack of a contract."""
    n = F.col("event_id") % 3
    said = F.when(n == 0, "no object").when(n == 1, '```json\n{"user_prompt": "```", "use_case": 1, "extra": 2}\n```').otherwise(' {"user_prompt": "p", "use_case": "c", "outline": []} ')
    body = read(spark, sf_dir, "events").select("event_id", T.unfenced(said).alias("c"))
    return body.select("event_id", F.array_join(T.missing_keys(F.col("c"), BRIEF), ",").alias("missing"), T.same_keys(F.col("c"), BRIEF).alias("exact"))


def split_rows(spark, sf_dir) -> DataFrame:
    return cut(corpus.assign_splits(cut(corpus.dedupe(corpus.clean(raw(spark, sf_dir))))))


from corpusloom.catalog import SPLIT  # noqa: E402


@register(f"WITH {SPLIT} SELECT split, count(*) AS n, sha256(string_agg(fp, chr(10) ORDER BY fp)) AS hash, sha256(string_agg(fp || id || source || '.example', ',' ORDER BY fp)) AS listed FROM ranked GROUP BY split")
def split_manifests(spark, sf_dir):
    m = corpus.manifests(split_rows(spark, sf_dir))
    lines = F.array_join(F.transform("records", lambda r: F.concat(r["fingerprint"], r["fineweb_id"], r["domain"])), ",")
    return m.select("split", F.col("count").alias("n"), "hash", F.sha2(lines, 256).alias("listed"))


BARE = f"""sec AS (SELECT fp, CASE WHEN bare THEN 0 ELSE len({sents("array_to_string(list_filter(regexp_split_to_array(body, chr(10)), lambda s: trim(s) <> ''), chr(10))")}) END AS n, split FROM ranked)"""


@register(f"WITH {SPLIT}, {BARE} SELECT count(*) FILTER (n = 0) AS empty_outline_count, round(count(*) FILTER (n = 0) / greatest(1, count(*)), 6) AS empty_outline_ratio, count(*) FILTER (split = 'train') AS train_count, count(*) FILTER (split = 'dev') AS dev_count FROM sec")
def dataset_summary(spark, sf_dir):
    return rounded(corpus.summary(corpus.briefs(split_rows(spark, sf_dir))))


@register("SELECT 'detail_mode,domain,em_dashes_allowed,fineweb_id,fingerprint,generation_mode,split,style,style_kind,target_length,use_case,user_prompt' AS fields")
def public_fields(spark, sf_dir):
    """What of a brief may cross the hidden-split boundary."""
    brief = corpus.public(corpus.briefs(split_rows(spark, sf_dir)))
    return brief.limit(1).select(F.lit(",".join(sorted(brief.columns))).alias("fields"))


@register(f"WITH {SPLIT}, {BARE} SELECT (SELECT count(*) FROM rec) AS fixture_records, true AS train_hash_matches, true AS dev_hash_matches, count(*) FILTER (n = 0) AS empty_outline_count, count(*) FILTER (n = 0) AS empty_outline_expected, false AS hidden_test_materialized_locally, (SELECT count(*) FROM rec) AS cleaned_lines, (SELECT count(*) FROM ranked WHERE split = 'dev') AS dev_lines FROM sec")
def dataset_files(spark, sf_dir):
    """The ten files of a dataset, written, verified and read again."""
    built, folder = corpus.build(raw(spark, sf_dir)), scratch(spark, "dataset")
    io.write_dataset(built, folder, {"fixture": sf_dir})
    lines = [io.read_jsonl(spark, f"{folder}/{n}.jsonl").agg(F.count("fingerprint").alias(c)) for n, c in (("cleaned_records", "cleaned_lines"), ("dev_briefs", "dev_lines"))]
    return io.verify_dataset(built, folder).join(lines[0], F.lit(True)).join(lines[1], F.lit(True))


@register("SELECT event_id, json_object('event_id', event_id, 'event_type', event_type, 'user_id', user_id) AS line FROM events")
def canonical_rows(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return e.select("event_id", io.canonical(e).alias("line"))


@register("SELECT CAST(doc_id AS VARCHAR) AS fineweb_id, 'https://' || source || '.example/' || doc_id AS url, source || '.example' AS domain, sha256(text) AS text_hash FROM documents")
def jsonl_round_trip(spark, sf_dir):
    """Raw documents written as JSON Lines and read by the strict reader."""
    path = scratch(spark, "raw")
    raw(spark, sf_dir).write.json(path)
    checked = io.strict_jsonl(spark, path, io.RAW)
    typed = io.raw_documents(spark, path)
    return checked.join(typed.select("fineweb_id"), "fineweb_id", "left_semi").select("fineweb_id", "url", "domain", F.sha2("text", 256).alias("text_hash"))


@register("SELECT 1 AS files, true AS same FROM (SELECT 1)")
def file_checksums(spark, sf_dir):
    """A file's checksum by the source and by a plain digest of its bytes."""
    path = scratch(spark, "lines")
    read(spark, sf_dir, "benchmark").select(F.to_json(F.struct("item_id", "text")).alias("value")).coalesce(1).write.text(path)
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("own"))
    return io.checksum(spark, path).join(files, "path").agg(F.count(F.lit(1)).cast("int").alias("files"), F.bool_and(F.col("sha256") == F.col("own")).alias("same"))


@register(f"SELECT doc_id AS pos, length(text) AS generated, length(trim(text)) AS output, length(text) // 6 AS target_length FROM documents")
def runner_samples(spark, sf_dir):
    """Samples of a run without a model: every record answers itself."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("fineweb_id"), F.lit("p").alias("user_prompt"), F.array().cast("array<string>").alias("outline"), F.floor(F.length("text") / 6).alias("target_length"), F.col("text").alias("completion"))
    s = surfaces.identity_samples(d)
    return s.select(F.col("fineweb_id").cast("long").alias("pos"), F.length("reference_completion").cast("long").alias("generated"), F.length("output").cast("long").alias("output"), "target_length")


@register("SELECT item_id, '> ' || text AS generated_completion, text AS reference_completion FROM benchmark")
def generator_surface(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("user_prompt"), F.col("text").alias("completion"))
    rows = surfaces.generated_records(surfaces.generate(b, lambda prompts: [f'> {p}' for p in prompts]))
    return rows.select("item_id", "generated_completion", "reference_completion")


@register("SELECT doc_id, CAST(length(text) AS DOUBLE) / 2 AS score FROM documents")
def probe_surface(spark, sf_dir):
    return surfaces.probe_scores(read(spark, sf_dir, "documents").select("doc_id", "text"), lambda texts: [len(t) / 2 for t in texts]).select("doc_id", "score")


@register("WITH t AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS pos FROM documents) SELECT pos, doc_id, length(text) AS n FROM t")
def positional_pairs(spark, sf_dir):
    """Ids and texts zipped by position."""
    d = global_rank(read(spark, sf_dir, "documents"), [F.col("doc_id")], "pos")
    return report.zipped(d.select("pos", "doc_id"), d.select("pos", F.length("text").cast("long").alias("n")))


@register(f"WITH {MADE}, {HUMAN} SELECT 0 AS label, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM ht UNION ALL SELECT 1, count(*), CAST(sum(length(text)) AS BIGINT) FROM gt")
def labelled_union(spark, sf_dir):
    both = human(spark, sf_dir).withColumn("label", F.lit(0)).unionByName(made(spark, sf_dir).withColumn("label", F.lit(1)))
    return both.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@register("SELECT count(*) AS samples, 'completed' AS status, 'r1' AS run_id, true AS hash_ok, CAST(min(length(text)) AS BIGINT) AS shortest FROM benchmark")
def run_artifacts(spark, sf_dir):
    """A run's samples, metrics, manifest and configuration, read again."""
    b = read(spark, sf_dir, "benchmark")
    rows = b.select(F.col("item_id").cast("string").alias("fineweb_id"), "text")
    folder, config = scratch(spark, "run"), {"run": {"comparison_id": "c1"}}
    manifest = launch.run_manifest("r1", config, "t", b.count(), folder)
    shortest = metrics.length_stats(b).first()["min"]
    io.write_run(spark, rows, {"min_tokens": shortest}, manifest, config, [folder, f"{folder}/copy"])
    kept, settings = io.read_json(spark, f"{folder}/copy/run_manifest.json"), io.read_json(spark, f"{folder}/config.json")
    again = io.read_jsonl(spark, f"{folder}/copy/samples.jsonl", "fineweb_id string, text string")
    same = kept["config_hash"] == evaluation.canonical_hash(settings) and kept["sample_count"] == b.count()
    return again.agg(F.count(F.lit(1)).alias("samples"), F.lit(kept["status"]).alias("status"), F.lit(kept["run_id"]).alias("run_id"), F.lit(same).alias("hash_ok"), F.min(F.length("text")).cast("long").alias("shortest"))


@register(f"WITH {bleu_sql('benchmark', 'item_id')} SELECT round(quantile_cont(bleu, 0.025::DOUBLE), 6) AS low, round(quantile_cont(bleu, 0.975::DOUBLE), 6) AS high, true AS report_written FROM bleu")
def calibration_file(spark, sf_dir):
    """Calibrated ranges and a report written as files and read again."""
    row = cut(metrics.calibration(read(spark, sf_dir, "benchmark"), "item_id"))
    path = scratch(spark, "calibration")
    io.write_calibration(row, f"{path}.json")
    io.write_report(row.select(F.col("self_bleu")[0].alias("low"), F.col("self_bleu")[1].alias("high")), f"{path}-report")
    stored = io.read_json(spark, f"{path}.json")["self_bleu"]
    back = spark.read.json(f"{path}-report")
    near = lambda c: F.abs(F.col(c) - F.lit(stored[c])) < 1e-9
    return back.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), (near("low") & near("high")).alias("report_written"))


@register(
    """WITH d AS (SELECT doc_id, source, lang FROM documents) SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN [] WHEN 1 THEN [source] WHEN 2 THEN [source, lang, source, 'x'] WHEN 3 THEN [lang, source] WHEN 4 THEN [source, 'deep', lang] ELSE [] END AS facts FROM d"""
)
def free_form_facts(spark, sf_dir):
    """Facts of outlines of any shape: null, text, objects, lists, nested."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    quoted = {c: F.to_json(F.struct(F.col(c).alias("c"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("c")))) - 6) for c in ("source", "lang")}
    text = lambda shape, *names: F.format_string(shape, *[quoted[n] for n in names])
    case = F.col("doc_id") % 6
    outline = (
        F.when(case == 0, "null").when(case == 1, text("%s", "source")).when(case == 2, text('[{"section": "no", "quotations": [%s, "x"], "supported_facts": [%s, %s]}]', "source", "source", "lang"))
        .when(case == 3, text('{"facts": [[%s], {"other": "no"}], "quotations": %s}', "lang", "source")).when(case == 4, text('[%s, [[["deep"]], null, {"facts": {"facts": %s}}]]', "source", "lang")).otherwise("[1, true, {}, []]")
    )
    return metrics.free_facts(d.select("doc_id", outline.alias("outline")), "doc_id")

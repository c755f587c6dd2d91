"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.llm import codes, decontam, divergence, htmltext, licenses, minhash, mixing, pii, rules, sharding, simhash, toxicity, urlfilter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.plan_mix(docs).select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    joined = lambda c: F.array_join(c, ",").alias(c)
    return licenses.scan(docs).select("doc.doc_id", joined("sentences"), joined("licenses"), joined("unmatched"), F.size("sentences").cast("long").alias("n_sentences"))


def op3_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = sharding.shard_rows(docs)
    return placed.select("doc.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "basis")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmltext.extract(pages).select("doc.page_id", "doc.url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.scored(docs, table(spark, sf_dir, "labels")).select("doc.doc_id", "held_out", "score", "predicted")


def op8_apply_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    failed_base = ~rules.verdict(F.col("failed"), "base-1")
    return book.select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed_base.alias("base_failed"), (~failed_base & rules.verdict(F.col("failed"))).alias("kept"), "failed",
    )


def op9_link_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.clusters(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_find_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    every = pii.BASE + pii.ADDED
    total = sum((F.size(k.name) for k in every), F.lit(0)).cast("long").alias("n_spans")
    base, added = ([F.size(k.name).cast("long").alias(f"n_{k.name}") for k in kinds] for kinds in (pii.BASE, pii.ADDED))
    return found.select("doc.doc_id", *base, F.sha2(pii.listed(pii.BASE), 256).alias("base_sha256"), pii.listed(every).alias("spans"), *added, total, pii.listed(every, score=True).alias("scores"))


def op11_audit_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op12_compress_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(spark, table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_link_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.clusters(table(spark, sf_dir, "documents").select("doc_id", "text"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the path rules alone say of each page."""
    pages = table(spark, sf_dir, "pages").select("page_id", urlfilter.host_of(F.col("url")).alias("host"), urlfilter.path_of(F.col("url")).alias("path"))
    rule, verdict = urlfilter.by_rules(F.col("host"), F.col("path"))
    return pages.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base kinds of personal data alone."""
    found = pii.spans(table(spark, sf_dir, "documents").select("doc_id", "text"), kinds=pii.BASE)
    return found.select("doc.doc_id", *[F.size(k.name).cast("long").alias(f"n_{k.name}") for k in pii.BASE], pii.listed(pii.BASE).alias("spans"))


def shard_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the shards, whatever the order inside: one row."""
    placed = op3_shard_documents(spark, sf_dir)
    per = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.count_distinct("slot").alias("slots"), F.max("size").alias("largest"), F.sum("doc_id").alias("ids"))
    gapless = F.bool_and((F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("slots") == F.col("n")))
    mean, largest = F.sum("bytes") / sharding.SHARDS, F.max("largest")
    even = (F.max("bytes") - mean <= largest + 0.01 * mean) & (mean - F.min("bytes") <= largest + 0.01 * mean)
    return per.agg(F.sum("n").alias("n_docs"), F.sum("bytes").alias("n_bytes"), F.sum("ids").alias("sum_ids"), gapless.alias("gapless"), even.alias("even"))


def rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per policy and rule: documents that fail it, and that only it rejects."""
    return rules.ablation(rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_scan_licenses, op3_shard_documents, op4_filter_urls, op5_decontaminate, op6_extract_text, op7_score_toxicity, op8_apply_rules, op9_link_near_copies, op10_find_personal_data, op11_audit_sources, op12_compress_vectors, op13_link_similar, url_rules, pii_base, shard_checks, rule_ablation, pipeline)}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    from corpusloom.llm.sql import SQL

    return dict(SQL)

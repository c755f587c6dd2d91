"""The registered queries outside ``llm``, each with its SQL.

Driver tables stand in for the inputs: ``documents`` are raw documents
(title "Document <id>", domain "<source>.example"), labelled quality 1
texts are the human corpus and quality 0 the generated one, ``benchmark``
items are facts, ``conversations`` give prompt and answer pairs, and
``events`` are a run log (user = run, event type = status, value = cost).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.functions import text as T
from corpusloom.operators import corpus, evaluation, events as ev, metrics
from corpusloom.session import cut

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


#: Tables up to this size are dealt out if they come in fewer parts than there are cores.
SMALL = 256 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table.  A Parquet row group is one task however many cores
    there are, so a small table in few of them is dealt out; larger ones
    are read as they lie."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size <= SMALL and len(df.inputFiles()) < cores else df


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("fineweb_id"), F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string")).alias("url"), F.concat("source", F.lit(".example")).alias("domain"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), "text")


def records(spark, sf_dir):
    return corpus.dedupe(corpus.clean(raw(spark, sf_dir)))


def labelled(spark, sf_dir, quality: int) -> DataFrame:
    picked = read(spark, sf_dir, "labels").where(F.col("quality") == quality).select("doc_id")
    return read(spark, sf_dir, "documents").select("doc_id", "text").join(picked, "doc_id", "left_semi")


def run_log(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events")
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    status = F.when(F.pmod("event_id", F.lit(11)) == 0, "completed").when(F.pmod("event_id", F.lit(3)) == 0, F.col("event_type"))
    started = F.when(F.pmod("event_id", F.lit(5)) == 0, ts)
    kind = F.when(F.pmod("event_id", F.lit(7)) == 0, "api_cost").when(F.pmod("event_id", F.lit(4)) == 0, "run").otherwise("run_update")
    return e.select(
        F.col("event_id").alias("seq"), kind.alias("kind"), ts.alias("ts"), F.col("user_id").cast("string").alias("run_id"), status.alias("status"),
        F.when(F.pmod("event_id", F.lit(2)) == 0, "brief_synthesis").alias("task_kind"), F.lit(3600).cast("long").alias("timeout_seconds"),
        F.when(F.pmod("event_id", F.lit(3)) == 1, F.col("value")).alias("reserved_cost_usd"), F.when(F.pmod("event_id", F.lit(6)) == 1, F.col("value") / 4).alias("api_reserved_cost_usd"),
        F.when(F.pmod("event_id", F.lit(3)) == 2, F.col("value") / 2).alias("actual_cost_usd"), F.when(F.pmod("event_id", F.lit(7)) == 0, F.col("value") / 8).alias("cost_usd"),
        F.lit(None).cast("string").alias("billing_month"), started.alias("started_at"), F.when(F.pmod("event_id", F.lit(2)) == 0, "smoke").otherwise("screen").alias("budget_class"),
    )


NOW = 1.8e9
NOISE_SQL = "^(" + "|".join(corpus.NOISE) + ")"
LOG = """log AS (SELECT event_id AS seq, CASE WHEN event_id % 7 = 0 THEN 'api_cost' WHEN event_id % 4 = 0 THEN 'run' ELSE 'run_update' END AS kind,
 epoch_us(ts) / 1e6 AS ts, CAST(user_id AS VARCHAR) AS run_id, CASE WHEN event_id % 11 = 0 THEN 'completed' WHEN event_id % 3 = 0 THEN event_type END AS status,
 CASE WHEN event_id % 2 = 0 THEN 'brief_synthesis' END AS task_kind, 3600 AS timeout_seconds, CASE WHEN event_id % 3 = 1 THEN value END AS reserved_cost_usd,
 CASE WHEN event_id % 6 = 1 THEN value / 4 END AS api_reserved_cost_usd, CASE WHEN event_id % 3 = 2 THEN value / 2 END AS actual_cost_usd,
 CASE WHEN event_id % 7 = 0 THEN value / 8 END AS cost_usd, CASE WHEN event_id % 5 = 0 THEN epoch_us(ts) / 1e6 END AS started_at,
 CASE WHEN event_id % 2 = 0 THEN 'smoke' ELSE 'screen' END AS budget_class FROM events)"""
STATE = """state AS (SELECT run_id, arg_max(status, seq) FILTER (status IS NOT NULL) AS status, arg_max(task_kind, seq) FILTER (task_kind IS NOT NULL) AS task_kind,
 arg_max(actual_cost_usd, seq) FILTER (actual_cost_usd IS NOT NULL) AS actual_cost_usd, arg_max(reserved_cost_usd, seq) FILTER (reserved_cost_usd IS NOT NULL) AS reserved_cost_usd,
 arg_max(api_reserved_cost_usd, seq) FILTER (api_reserved_cost_usd IS NOT NULL) AS api_reserved_cost_usd, arg_max(started_at, seq) FILTER (started_at IS NOT NULL) AS started_at,
 arg_max(budget_class, seq) FILTER (budget_class IS NOT NULL) AS budget_class FROM log GROUP BY run_id)"""
CLEAN = f"""lines AS (SELECT doc_id, source, list_filter(list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)),
 lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda l: l = '' OR NOT (regexp_matches(lower(l), '{NOISE_SQL}') OR
 (regexp_matches(l, '\\p{{Lu}}') AND NOT regexp_matches(l, '[\\p{{Ll}}\\p{{Lt}}]') AND len(string_split(l, ' ')) <= 6))) AS ls FROM documents),
 cleaned AS (SELECT doc_id, source, trim(regexp_replace(regexp_replace(array_to_string(ls, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g'), ' ' || chr(10)) AS body FROM lines),
 rec AS (SELECT sha256(body) AS fp, min(CAST(doc_id AS VARCHAR)) AS id, arg_min(body, CAST(doc_id AS VARCHAR)) AS body, arg_min(source, CAST(doc_id AS VARCHAR)) AS source FROM cleaned GROUP BY sha256(body))"""
SPLIT = CLEAN + """, ranked AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY sha256('split:' || fp), fp) <= greatest(1, count(*) OVER () // 4) THEN 'dev' ELSE 'train' END AS split,
 row_number() OVER (ORDER BY sha256('empty-outline:' || fp), fp) <= count(*) OVER () // 4 AS bare FROM rec)"""
WORD = "'[\\p{L}\\p{N}]+(?:[''’][\\p{L}\\p{N}]+)?'"
toks = lambda x: f"list_transform(regexp_extract_all({x}, {WORD}), lambda w: replace(lower(w), 'ß', 'ss'))"
sents = lambda x: f"list_filter(list_transform(regexp_split_to_array(regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\n+'), lambda s: trim(s)), lambda s: s <> '')"
paras = lambda x: f"list_filter(list_transform(regexp_split_to_array({x}, '\\n\\s*\\n'), lambda s: trim(s, ' ' || chr(10))), lambda s: s <> '')"


@register(f"WITH {CLEAN} SELECT doc_id, length(body) AS n_chars, sha256(body) AS fingerprint FROM cleaned")
def clean_fingerprint(spark, sf_dir):
    return corpus.clean(read(spark, sf_dir, "documents")).select("doc_id", F.length("cleaned_text").cast("long").alias("n_chars"), "fingerprint")


@register(f"WITH {CLEAN} SELECT fp AS fingerprint, id AS fineweb_id FROM rec")
def exact_dedupe(spark, sf_dir):
    return records(spark, sf_dir).select("fingerprint", "fineweb_id")


@register(f"WITH {SPLIT} SELECT fp AS fingerprint, split FROM ranked")
def split_assign(spark, sf_dir):
    return corpus.assign_splits(cut(records(spark, sf_dir).select("fingerprint"))).select("fingerprint", "split")


@register(f"WITH {SPLIT} SELECT split, count(*) AS n, sha256(string_agg(fp, chr(10) ORDER BY fp)) AS hash FROM ranked GROUP BY split")
def split_hash(spark, sf_dir):
    split = corpus.assign_splits(cut(records(spark, sf_dir).select("fingerprint")))
    return corpus.split_hashes(split)


@register(f"WITH {SPLIT} SELECT fp AS fingerprint FROM ranked WHERE bare")
def empty_outline_rank(spark, sf_dir):
    return corpus.empty_outlines(cut(records(spark, sf_dir).select("fingerprint")))


@register("SELECT doc_id, CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 4 = 0 AS bare FROM documents")
def empty_outline_mod(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", corpus.empty_outline_by_row(F.col("doc_id").cast("string")).alias("bare"))


@register(
    f"""WITH {SPLIT}, b AS (SELECT *, 'Document ' || id AS title, len(regexp_extract_all(body, {WORD})) AS n FROM ranked)
 SELECT id AS fineweb_id, source || '.example' AS domain, fp AS fingerprint, split, 'generate' AS generation_mode,
 CASE WHEN contains(lower(source), 'news') THEN 'news' ELSE 'company_blog' END AS use_case,
 CASE WHEN contains(body, '?') THEN 'instructive' WHEN n > 220 THEN 'professional' WHEN regexp_matches(lower(body), 'reported|according to|officials') THEN 'reported' ELSE 'professional' END AS style_kind,
 CASE WHEN contains(body, '?') THEN 'direct, pragmatic' WHEN n > 220 THEN 'measured, explanatory' WHEN regexp_matches(lower(body), 'reported|according to|officials') THEN 'neutral, sourced' ELSE 'clear, restrained' END AS style,
 CASE WHEN CAST('0x' || substr(sha256(fp), 1, 2) AS BIGINT) % 2 = 0 THEN 'strict' ELSE 'creative' END AS detail_mode, CAST(n AS BIGINT) AS target_length, contains(body, '—') AS em_dashes_allowed,
 CASE WHEN contains(lower(source), 'news') THEN 'Write a concise reported update about ' || title || '.' ELSE 'Draft a polished web article about ' || title || '.' END AS user_prompt FROM b"""
)
def brief_records(spark, sf_dir):
    split = cut(corpus.assign_splits(cut(records(spark, sf_dir))))
    return corpus.briefs(split).drop("outline", "completion")


@register(
    f"""WITH {SPLIT}, p AS (SELECT fp, unnest(list_filter(list_transform(regexp_split_to_array(body, '\\n\\s*\\n+'), lambda s: trim(s, ' ' || chr(10))), lambda s: s <> '')[1:3]) AS para,
 generate_subscripts(list_filter(list_transform(regexp_split_to_array(body, '\\n\\s*\\n+'), lambda s: trim(s, ' ' || chr(10))), lambda s: s <> '')[1:3], 1) AS i, 'Document ' || id AS title FROM ranked WHERE NOT bare),
 f AS (SELECT fp, i, title, {sents('para')}[1:2] AS s FROM p)
 SELECT fp AS fingerprint, CAST(i AS BIGINT) AS nth, CASE WHEN i = 1 THEN title ELSE title || ' (' || i || ')' END AS section,
 array_to_string(list_transform(s, lambda x: CASE WHEN length(x) > 160 THEN rtrim(substr(x, 1, 159)) || '…' ELSE x END), '|') AS facts FROM f WHERE len(s) > 0"""
)
def outline_sections(spark, sf_dir):
    split = cut(corpus.assign_splits(cut(records(spark, sf_dir))))
    rows = corpus.briefs(split).select("fingerprint", F.posexplode("outline").alias("i", "o"))
    return rows.select("fingerprint", (F.col("i") + 1).cast("long").alias("nth"), F.col("o.section").alias("section"), F.array_join("o.supported_facts", "|").alias("facts"))


@register(f"SELECT doc_id, len(regexp_extract_all(text, {WORD})) AS n_tokens FROM documents")
def token_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@register(f"WITH t AS (SELECT CAST(len(regexp_extract_all(text, {WORD})) AS DOUBLE) AS n FROM documents) SELECT round(avg(n), 6) AS mean, quantile_cont(n, 0.5::DOUBLE) AS median, min(n) AS min, max(n) AS max FROM t")
def length_stats(spark, sf_dir):
    return metrics.length_stats(read(spark, sf_dir, "documents")).withColumn("mean", F.round("mean", 6))


HIST = """CASE WHEN n >= {4} THEN '5' WHEN n >= {3} THEN '4' WHEN n >= {2} THEN '3' WHEN n >= {1} THEN '2' WHEN n >= {0} THEN '1' ELSE '0' END"""
OPEN_SQL = "CASE " + " ".join("WHEN w[1] IN (" + ", ".join(f"'{x}'" for x in v) + f") THEN '{k}'" for k, v in metrics.OPENINGS.items()) + " WHEN regexp_matches(w[1], '^\\p{Nd}+$') THEN 'number' ELSE 'other' END"
STRUCTURE = f"""par AS (SELECT doc_id, unnest({paras('text')}) AS x FROM documents), sen AS (SELECT doc_id, unnest({sents('text')}) AS x FROM documents),
 sw AS (SELECT doc_id, {toks('x')} AS w FROM sen), st AS (SELECT doc_id, w, len(w) AS n FROM sw WHERE len(w) > 0), pt AS (SELECT doc_id, len(regexp_extract_all(x, {WORD})) AS n FROM par),
 cells AS (SELECT doc_id, 'paragraph' AS kind, {HIST.format(*metrics.PARAGRAPH_EDGES)} AS bucket FROM pt UNION ALL SELECT doc_id, 'sentence', {HIST.format(*metrics.SENTENCE_EDGES)} FROM st UNION ALL SELECT doc_id, 'opening', {OPEN_SQL} FROM st)"""


@register(f"WITH {STRUCTURE} SELECT kind, bucket, count(*) AS n FROM cells GROUP BY kind, bucket")
def structure_hist(spark, sf_dir):
    return metrics.structure(read(spark, sf_dir, "documents"))


GRID = "grid AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, '{b}' AS bucket" for k, bs in (("paragraph", range(6)), ("sentence", range(6)), ("opening", [*metrics.OPENINGS, "number", "other"])) for b in bs) + ")"


@register(
    f"""WITH {STRUCTURE}, {GRID}, c AS (SELECT kind, bucket, count(*) FILTER (quality = 1) AS a, count(*) FILTER (quality = 0) AS b FROM cells JOIN labels USING (doc_id) GROUP BY kind, bucket),
 h AS (SELECT kind, bucket, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM grid LEFT JOIN c USING (kind, bucket)),
 q AS (SELECT kind, a / sum(a) OVER (PARTITION BY kind) AS p, b / sum(b) OVER (PARTITION BY kind) AS q FROM h), m AS (SELECT *, (p + q) / 2 AS m FROM q)
 SELECT kind, round(sqrt(greatest(0, (sum(CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END)) / 2)), 6) AS js FROM m GROUP BY kind"""
)
def structural_js(spark, sf_dir):
    return metrics.structural(labelled(spark, sf_dir, 1), labelled(spark, sf_dir, 0)).withColumn("js", F.round("js", 6))


FEATURES = ("the", "in the", "of the", "und", "de la", "ing", "and the", "the the the")


@register(
    "WITH t AS (SELECT quality AS side, "
    + toks("text")
    + " AS w FROM documents JOIN labels USING (doc_id)), g AS ("
    + " UNION ALL ".join(f"SELECT side, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS f FROM t WHERE len(w) >= {n}" for n in (1, 2, 3))
    + "), c AS (SELECT f, count(*) FILTER (side = 1) AS a, count(*) FILTER (side = 0) AS b FROM g WHERE f IN ("
    + ", ".join(f"'{f}'" for f in FEATURES)
    + ") GROUP BY f), r AS (SELECT a / sum(a) OVER () - b / sum(b) OVER () AS d FROM c) SELECT round(sqrt(sum(d * d)), 6) AS lexical_l2 FROM r"
)
def lexical_l2_features(spark, sf_dir):
    listed = spark.createDataFrame([(f,) for f in FEATURES], "feature string")
    return metrics.lexical_l2(labelled(spark, sf_dir, 1), labelled(spark, sf_dir, 0), features=listed).withColumn("lexical_l2", F.round("lexical_l2", 6))


@register()
def lexical_l2_hashed(spark, sf_dir):
    return metrics.lexical_l2(labelled(spark, sf_dir, 1), labelled(spark, sf_dir, 0)).withColumn("lexical_l2", F.round("lexical_l2", 6))


SCRIPT = "CASE WHEN length(regexp_replace(text, '[^\\p{L}]', '', 'g')) = 0 THEN 0.0 ELSE 1 - length(regexp_replace(regexp_replace(text, '[^\\p{L}]', '', 'g'), '[^\\p{Latin}]', '', 'g')) / length(regexp_replace(text, '[^\\p{L}]', '', 'g')) END"


@register(f"SELECT doc_id, round(CAST({SCRIPT} AS DOUBLE), 6) AS script_rate FROM documents")
def script_rate(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.round(metrics.script_rate(F.col("text")), 6).alias("script_rate"))


@register(f"SELECT round(avg(CAST({SCRIPT} AS DOUBLE)), 6) AS mean_script_rate, avg(CAST({SCRIPT} AS DOUBLE)) BETWEEN 0 AND 0.01 AS language_integrity FROM documents")
def language_integrity(spark, sf_dir):
    return metrics.language_integrity(read(spark, sf_dir, "documents"), 0.0, 0.01).withColumn("mean_script_rate", F.round("mean_script_rate", 6))


STARTS = f"""ss AS (SELECT doc_id, unnest({sents('text')}) AS x, generate_subscripts({sents('text')}, 1) AS i FROM documents), sf AS (SELECT doc_id, i, {toks('x')}[1] AS w FROM ss), sk AS (SELECT * FROM sf WHERE w IS NOT NULL),
 sl AS (SELECT doc_id, w = lag(w, 1) OVER p AND w = lag(w, 2) OVER p AS hit FROM sk WINDOW p AS (PARTITION BY doc_id ORDER BY i)), hits AS (SELECT DISTINCT doc_id FROM sl WHERE hit)"""


@register(f"WITH {STARTS} SELECT doc_id, doc_id IN (SELECT doc_id FROM hits) AS repeated FROM documents")
def repeated_starts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", metrics.repeated_start(F.col("text")).alias("repeated"))


def bleu_sql(table: str, key: str) -> str:
    grams = " UNION ALL ".join(f"SELECT k, {n} AS o, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS g FROM w0 WHERE len(w) >= {n}" for n in (1, 2, 3, 4))
    return f"""w0 AS (SELECT {key} AS k, {toks('text')} AS w FROM {table}), own AS (SELECT k, o, g, count(*) AS c FROM ({grams}) GROUP BY k, o, g),
 rk AS (SELECT *, row_number() OVER (PARTITION BY o, g ORDER BY c DESC, k) AS r FROM own), tops AS (SELECT o, g, max(c) FILTER (r = 1) AS c1, max(k) FILTER (r = 1) AS k1, coalesce(max(c) FILTER (r = 2), 0) AS c2 FROM rk GROUP BY o, g),
 hit AS (SELECT own.k, own.o, sum(least(c, CASE WHEN own.k = k1 THEN c2 ELSE c1 END)) AS h FROM own JOIN tops USING (o, g) GROUP BY own.k, own.o),
 ln AS (SELECT k, len(w) AS n FROM w0), ord AS (SELECT k, n, lag(n) OVER (ORDER BY n, k) AS pv, lead(n) OVER (ORDER BY n, k) AS nx FROM ln),
 rf AS (SELECT k, n, CASE WHEN nx IS NULL OR (pv IS NOT NULL AND n - pv <= nx - n) THEN coalesce(pv, nx) ELSE nx END AS r FROM ord),
 sc AS (SELECT rf.k, n, r, ln((coalesce(h, 0) + 1) / (n - q.o + 2)) AS lp FROM rf, (SELECT unnest([1, 2, 3, 4]) AS o) q LEFT JOIN hit ON hit.k = rf.k AND hit.o = q.o WHERE q.o <= n),
 bleu AS (SELECT ln.k, coalesce(any_value(CASE WHEN sc.n > r THEN 1.0 ELSE exp(1 - r / sc.n) END) * exp(avg(lp)), 0.0) AS bleu FROM ln LEFT JOIN sc USING (k) GROUP BY ln.k)"""


@register(f"WITH {bleu_sql('benchmark', 'item_id')} SELECT k AS item_id, round(bleu, 6) AS bleu FROM bleu")
def sentence_bleu(spark, sf_dir):
    return metrics.bleu_vs_rest(read(spark, sf_dir, "benchmark"), "item_id").withColumn("bleu", F.round("bleu", 6))


@register(f"WITH {bleu_sql('documents', 'doc_id')} SELECT round(avg(bleu), 6) AS self_bleu FROM bleu")
def self_bleu(spark, sf_dir):
    return metrics.self_bleu(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").withColumn("self_bleu", F.round("self_bleu", 6))


Q = lambda c, q: f"round(quantile_cont(CAST({c} AS DOUBLE), {q}::DOUBLE), 6)"


@register(
    f"""WITH {bleu_sql('documents', 'doc_id')}, {STRUCTURE}, {STARTS}, al AS (SELECT len(regexp_extract_all(x, {WORD})) AS n FROM sen), rp AS (SELECT CASE WHEN doc_id IN (SELECT doc_id FROM hits) THEN 1 ELSE 0 END AS r, {SCRIPT} AS s FROM documents)
 SELECT (SELECT {Q('bleu', .025)} FROM bleu) AS bleu_low, (SELECT {Q('bleu', .975)} FROM bleu) AS bleu_high, (SELECT {Q('r', .975)} FROM rp) AS repetition_high, (SELECT {Q('s', .975)} FROM rp) AS script_high,
 (SELECT {Q('n', .1)} FROM pt) AS paragraph_p10, (SELECT {Q('n', .5)} FROM pt) AS paragraph_p50, (SELECT {Q('n', .9)} FROM pt) AS paragraph_p90,
 (SELECT {Q('n', .1)} FROM al) AS sentence_p10, (SELECT {Q('n', .5)} FROM al) AS sentence_p50, (SELECT {Q('n', .9)} FROM al) AS sentence_p90"""
)
def calibration_quantiles(spark, sf_dir):
    c = metrics.calibration(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    pick = lambda col, i, name: F.round(F.col(col)[i], 6).alias(name)
    mids = [pick(f"{k}_length", i, f"{k}_{p}") for k in ("paragraph", "sentence") for i, p in enumerate(("p10", "p50", "p90"))]
    return c.select(pick("self_bleu", 0, "bleu_low"), pick("self_bleu", 1, "bleu_high"), pick("repetition", 1, "repetition_high"), pick("script_rate", 1, "script_high"), *mids)


def fact_pairs(spark, sf_dir) -> DataFrame:
    """Every document with the sentences of one benchmark item as facts: the
    i-th document by id gets item i modulo the number of items."""
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), "text")
    paired = evaluation.modulo_pairs(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.col("text").alias("own")), items)
    return paired.select(F.col("pos").alias("doc_id"), F.col("own").alias("text"), T.sentences(F.col("human")).alias("facts"))


FACTS = f"""nb AS (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS i FROM benchmark), nd AS (SELECT doc_id, text, (row_number() OVER (ORDER BY doc_id) - 1) % (SELECT count(*) FROM benchmark) AS i FROM documents),
 fp AS (SELECT nd.doc_id, nd.text, {sents('nb.text')} AS facts FROM nd JOIN nb USING (i))"""
OVER = lambda s, t: f"CASE WHEN len(list_distinct({s})) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct({s}), {t})) / len(list_distinct({s})) END"


@register(f"WITH {FACTS}, x AS (SELECT {toks('text')} AS t, unnest(facts) AS f FROM fp), y AS (SELECT t, {toks('f')} AS f FROM x) SELECT round(coalesce(avg(CASE WHEN {OVER('f', 't')} >= 0.8 THEN 1.0 ELSE 0.0 END), 1.0), 6) AS fact_recall FROM y")
def fact_recall(spark, sf_dir):
    return metrics.fact_recall(fact_pairs(spark, sf_dir)).withColumn("fact_recall", F.round("fact_recall", 6))


@register(
    f"""WITH {FACTS}, x AS (SELECT doc_id, unnest({sents('text')}) AS s, facts FROM fp), y AS (SELECT row_number() OVER () AS id, {toks('s')} AS c, facts FROM x), z AS (SELECT * FROM y WHERE len(c) >= 4),
 u AS (SELECT id, c, unnest(facts) AS f FROM z), v AS (SELECT id, c, {toks('f')} AS f FROM u), ok AS (SELECT DISTINCT id FROM v WHERE greatest({OVER('c', 'f')}, {OVER('f', 'c')}) >= 0.6)
 SELECT round(coalesce(1 - (SELECT count(*) FROM ok) / count(*), 0.0), 6) AS unsupported_rate FROM z"""
)
def unsupported_rate(spark, sf_dir):
    return metrics.unsupported_rate(fact_pairs(spark, sf_dir)).withColumn("unsupported_rate", F.round("unsupported_rate", 6))


def sides(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), F.col("embedding").alias("v"))
    return e.where(F.pmod("pos", F.lit(2)) == 0), e.where(F.pmod("pos", F.lit(2)) == 1)


@register(
    """WITH p AS (SELECT a.vec_id % 2 AS x, b.vec_id % 2 AS y, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) ** 2)) AS d FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id),
 m AS (SELECT quantile_cont(d, 0.5::DOUBLE) AS m FROM p WHERE d > 0), k AS (SELECT x, y, (exp(-d / (2 * m * 0.0625)) + exp(-d / (2 * m * 0.25)) + exp(-d / (2 * m)) + exp(-d / (2 * m * 4)) + exp(-d / (2 * m * 16))) / 5 AS k FROM p, m)
 SELECT round(avg(k) FILTER (x = 0 AND y = 0) + avg(k) FILTER (x = 1 AND y = 1) - 2 * avg(k) FILTER (x <> y), 6) AS mmd FROM k"""
)
def mmd_rbf(spark, sf_dir):
    return evaluation.mmd(*sides(spark, sf_dir)).withColumn("mmd", F.round("mmd", 6))


@register()
def human_floor_mmd(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), F.col("embedding").alias("v"))
    return evaluation.human_floor(e)


def turns(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    ask, say = c.where("role = 'user'"), c.where("role = 'assistant'")
    pairs = ask.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt")).join(say.select("conv_id", "turn", F.col("text").alias("answer")), ["conv_id", "turn"])
    return pairs


TURNS = "tp AS (SELECT a.conv_id, a.turn, u.text AS prompt, a.text AS answer FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND u.turn + 1 = a.turn WHERE a.role = 'assistant' AND u.role = 'user')"


FIRST_BYTE = "CAST('0x' || substr(sha256(encode(prompt) || '\\x00'::BLOB || encode(answer) || '\\x00'::BLOB || encode(answer || '!')), 1, 2) AS BIGINT)"


@register(f"WITH {TURNS} SELECT conv_id, turn, {FIRST_BYTE} % 2 = 0 AS swapped FROM tp")
def pairwise_order(spark, sf_dir):
    """An odd first byte puts the generated text first, an even one the human."""
    order = evaluation.swapped(F.col("prompt"), F.col("answer"), F.concat("answer", F.lit("!")))
    return turns(spark, sf_dir).select("conv_id", "turn", order.alias("swapped"))


SIDES = "lt AS (SELECT doc_id, text, quality FROM documents JOIN (SELECT DISTINCT doc_id, quality FROM labels) l USING (doc_id)), hs AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM lt WHERE quality = 1), gs AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM lt WHERE quality = 0)"


@register(f"WITH {SIDES} SELECT gs.doc_id AS pos, length(hs.text) AS n FROM gs JOIN hs ON gs.i % (SELECT count(*) FROM hs) = hs.i")
def modulo_pairing(spark, sf_dir):
    """All generated texts against all human ones."""
    human, made = (labelled(spark, sf_dir, q).withColumnRenamed("doc_id", "pos") for q in (1, 0))
    return evaluation.modulo_pairs(made.select("pos"), human).select("pos", F.length("human").cast("long").alias("n"))


@register(
    f"""WITH {TURNS}, j AS (SELECT {FIRST_BYTE} % 2 = 1 AS made_first, CASE WHEN length(answer) % 10 = 0 THEN 'TIE' WHEN length(answer) % 10 = 3 THEN 'A' WHEN length(answer) % 2 = 0 THEN 'A' ELSE 'B' END AS won FROM tp),
 p AS (SELECT avg(CASE WHEN won = 'TIE' THEN 0.5 WHEN (won = 'A') = made_first THEN 1.0 ELSE 0.0 END) AS p FROM j) SELECT round(p, 6) AS preference, round(2 * p, 6) AS jmq FROM p"""
)
def preference_jmq(spark, sf_dir):
    n = F.length("answer")
    said = F.when(n % 10 == 0, '{"winner": "tie"}').when(n % 10 == 3, '{"choice": 0.75}').when(n % 2 == 0, "the winner is a").otherwise("B.")
    order = evaluation.swapped(F.col("prompt"), F.col("answer"), F.concat("answer", F.lit("!")))
    judged = turns(spark, sf_dir).select(order.alias("swapped"), evaluation.winner(said).alias("won"))
    return evaluation.preference(judged).select(F.round("preference", 6).alias("preference"), F.round("jmq", 6).alias("jmq"))


def scores(spark, sf_dir):
    return read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score")), "doc_id").select(F.col("quality").alias("label"), "score")


@register(
    """WITH s AS (SELECT quality AS label, CAST(n_chars AS DOUBLE) AS score FROM labels JOIN documents USING (doc_id)), r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM s)
 SELECT round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) AS auc FROM r"""
)
def auc_rank(spark, sf_dir):
    return evaluation.auc(scores(spark, sf_dir)).withColumn("auc", F.round("auc", 6))


@register()
def auc_bootstrap(spark, sf_dir):
    return evaluation.auc_interval(scores(spark, sf_dir))


@register()
def fresh_probe(spark, sf_dir):
    rows = labelled(spark, sf_dir, 1).withColumn("label", F.lit(1)).unionByName(labelled(spark, sf_dir, 0).withColumn("label", F.lit(0)))
    return evaluation.auc(evaluation.probe(rows.withColumnRenamed("doc_id", "pos"))).withColumn("auc", F.round("auc", 3))


@register(f"WITH {LOG}, {STATE} SELECT run_id, status, task_kind, actual_cost_usd, reserved_cost_usd, started_at FROM state")
def run_snapshot(spark, sf_dir):
    return ev.snapshots(run_log(spark, sf_dir)).select("run_id", "status", "task_kind", "actual_cost_usd", "reserved_cost_usd", "started_at")


@register(f"WITH {LOG} SELECT run_id, min(seq) AS seq, arg_min(ts, seq) AS ts FROM log WHERE kind = 'run' GROUP BY run_id")
def first_launch(spark, sf_dir):
    return ev.launches(run_log(spark, sf_dir)).select("run_id", "seq", "ts")


ENDED = "coalesce(status IN ('completed', 'failed', 'cancelled', 'reaped', 'launch_failed'), false)"


@register(
    f"""WITH {LOG}, {STATE}, first AS (SELECT run_id, arg_min(ts, seq) AS ts FROM log WHERE kind = 'run' GROUP BY run_id), said AS (SELECT run_id, sum(cost_usd) AS said FROM log WHERE kind = 'api_cost' GROUP BY run_id),
 part AS (SELECT strftime(to_timestamp(first.ts) AT TIME ZONE 'UTC', '%Y-%m') AS month, CASE WHEN {ENDED} THEN coalesce(actual_cost_usd, 0) ELSE coalesce(reserved_cost_usd, 0) END AS g,
 CASE WHEN NOT {ENDED} AND task_kind = 'brief_synthesis' THEN greatest(0, coalesce(api_reserved_cost_usd, 0) - coalesce(said, 0)) ELSE 0 END AS a FROM state JOIN first USING (run_id) LEFT JOIN said USING (run_id)
 UNION ALL SELECT strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m'), 0, cost_usd FROM log WHERE kind = 'api_cost'), t AS (SELECT month, sum(g) AS g, sum(a) AS a FROM part GROUP BY month)
 SELECT month, round(g, 2) AS gpu_committed_usd, round(a, 2) AS api_spend_usd, round(greatest(0, 40 - g), 2) AS gpu_remaining_usd, round(greatest(0, 100 - a), 2) AS api_remaining_usd FROM t"""
)
def budget_by_month(spark, sf_dir):
    log = run_log(spark, sf_dir)
    started = log.where("kind = 'run'").select("run_id").distinct()
    b = ev.budget(log.join(started, "run_id", "left_semi").unionByName(log.join(started, "run_id", "left_anti").where("kind = 'api_cost'").withColumn("run_id", F.lit(None).cast("string"))))
    return b.select("month", *[F.round(c, 2).alias(c) for c in ("gpu_committed_usd", "api_spend_usd", "gpu_remaining_usd", "api_remaining_usd")])


RATED = f"CASE WHEN started_at IS NOT NULL THEN least(coalesce(reserved_cost_usd, 0), coalesce(reserved_cost_usd, 0) * greatest(0, {NOW} - started_at) / 3600) ELSE 0 END"


@register(f"WITH {LOG}, {STATE} SELECT round(sum(CASE WHEN {ENDED} THEN coalesce(actual_cost_usd, 0) ELSE {RATED} END), 2) AS accrued_usd FROM state")
def accrued_spend(spark, sf_dir):
    return ev.accrued(run_log(spark, sf_dir), NOW).withColumn("accrued_usd", F.round("accrued_usd", 2))


def ledger(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "prereg").otherwise("run")
    return e.select(F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.lit("c"), F.pmod("user_id", F.lit(50)).cast("string")).alias("comparison"), F.when(F.col("value") > 10, "open").otherwise("launched").alias("status"))


LEDGER = "ledger AS (SELECT event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'prereg' ELSE 'run' END AS kind, 'c' || CAST(user_id % 50 AS VARCHAR) AS comparison, CASE WHEN value > 10 THEN 'open' ELSE 'launched' END AS status FROM events)"


@register(f"WITH {LEDGER} SELECT * FROM ledger WHERE comparison = 'c7' AND kind = 'prereg' AND status = 'open'")
def ledger_filter(spark, sf_dir):
    return ev.ledger_query(ledger(spark, sf_dir), "c7", True)


@register(f"WITH {LEDGER} SELECT comparison, max(seq) AS seq FROM ledger WHERE kind = 'prereg' AND status = 'open' GROUP BY comparison")
def last_open(spark, sf_dir):
    return ev.last_open(ledger(spark, sf_dir)).select("comparison", "seq")


@register(f"WITH {CLEAN} SELECT min(doc_id) AS doc_id FROM cleaned WHERE sha256(body) NOT IN (SELECT sha256(body) FROM cleaned WHERE source = 'src1') GROUP BY sha256(body)")
def resume_antijoin(spark, sf_dir):
    rows = corpus.clean(read(spark, sf_dir, "documents")).select("fingerprint", F.col("doc_id").cast("string").alias("fineweb_id"), F.col("doc_id").alias("pos"), "source")
    return corpus.resume(rows.drop("source"), rows.where("source = 'src1'")).select(F.col("pos").alias("doc_id"))


@register(
    """WITH w AS (SELECT user_id, event_id, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
 SELECT user_id, event_id FROM w WHERE before < 100 AND n <= 8"""
)
def running_cap(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").alias("pos"), F.col("value").alias("cost"))
    return ev.under_cap(e, 100.0, 8, ["user_id"]).select("user_id", "event_id")


@register("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 100")
def log_tail(spark, sf_dir):
    return ev.tail(read(spark, sf_dir, "events").withColumn("pos", F.col("event_id")), 100).select("event_id", "event_type")


@register(
    f"""WITH {LOG}, live AS (SELECT * REPLACE (CASE WHEN status = 'completed' THEN 'completed' ELSE 'running' END AS status) FROM log), {STATE.replace('FROM log', 'FROM live')}
 SELECT run_id, round({RATED}, 2) AS actual_cost_usd, CASE WHEN {NOW} - coalesce(started_at, {NOW}) > CASE budget_class WHEN 'smoke' THEN 1200 WHEN 'screen' THEN 7200 END THEN 'wall_clock' ELSE 'global_cap' END AS reaper_reason
 FROM state WHERE status = 'running' AND started_at IS NOT NULL"""
)
def reaper(spark, sf_dir):
    log = run_log(spark, sf_dir).withColumn("status", F.when(F.col("status") == "completed", "completed").otherwise("running"))
    started = ev.snapshots(log, ["started_at"]).where("started_at IS NOT NULL").select("run_id")
    return ev.reap(log.join(started, "run_id", "left_semi"), NOW).select("run_id", F.round("actual_cost_usd", 2).alias("actual_cost_usd"), "reaper_reason")


@register(f"WITH {LOG}, {STATE} SELECT run_id, status, reserved_cost_usd FROM state")
def stream_run_state(spark, sf_dir):
    """The batch fold run as a streaming query over the same files."""
    import uuid

    from corpusloom.streaming import runs

    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*").parquet(path if _is_dir(spark, path) else f"{sf_dir}/events.parquet*")
    state = runs.run_state(_log_columns(stream), ["status", "reserved_cost_usd"])
    base = spark.sparkContext.getCheckpointDir() or cut(spark.range(1)) and spark.sparkContext.getCheckpointDir()
    folder = f"{base}/stream-{uuid.uuid4().hex}"
    return runs.drain(state, ["run_id"], f"{folder}/table", f"{folder}/state")


def _is_dir(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _log_columns(e: DataFrame) -> DataFrame:
    status = F.when(F.pmod("event_id", F.lit(11)) == 0, "completed").when(F.pmod("event_id", F.lit(3)) == 0, F.col("event_type"))
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("run_id"), status.alias("status"), F.when(F.pmod("event_id", F.lit(3)) == 1, F.col("value")).alias("reserved_cost_usd"))

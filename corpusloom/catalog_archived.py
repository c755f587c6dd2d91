"""Registered queries: further comparisons of generated and human corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import TURNS, read, register, sides, toks, turns
from corpusloom.catalog_reports import HUMAN, MADE, human, made, rounded
from corpusloom.operators import archived

SQUEEZED = r"regexp_replace({}, '\s+', '', 'g')"
USED = f"{MADE}, {HUMAN}, used AS (SELECT 0 AS side, pos, unnest({toks('text')}) AS token FROM ht UNION ALL SELECT 1, pos, unnest({toks('text')}) FROM gt)"
SHARES = f"{USED}, n AS (SELECT token, count(*) FILTER (side = 0) AS h, count(*) FILTER (side = 1) AS m FROM used GROUP BY token), s AS (SELECT token, h / sum(h) OVER () AS f, m / sum(m) OVER () AS g FROM n)"


@register(
    f"""WITH {TURNS}, t AS (SELECT conv_id || '-' || turn AS pair, 0 AS side, {SQUEEZED.format('answer')} AS x FROM tp UNION ALL SELECT conv_id || '-' || turn, 1, {SQUEEZED.format('prompt')} FROM tp),
 g AS (SELECT pair, side, o, unnest(list_transform(range(1, length(x) - o + 2), lambda i: substr(x, i, o))) AS g FROM t, (SELECT unnest(range(1, 7)) AS o) WHERE length(x) >= o),
 c AS (SELECT pair, o, g, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM g GROUP BY ALL),
 p AS (SELECT pair, o, sum(least(a, b)) / sum(a) AS p, sum(least(a, b)) / sum(b) AS r FROM c GROUP BY ALL HAVING sum(a) > 0 AND sum(b) > 0), m AS (SELECT pair, avg(p) AS p, avg(r) AS r FROM p GROUP BY pair)
 SELECT conv_id || '-' || turn AS pair, round(coalesce(CASE WHEN p + r > 0 THEN 500 * p * r / (4 * p + r) END, 0), 6) AS chrf FROM tp LEFT JOIN m ON m.pair = conv_id || '-' || turn"""
)
def turn_chrf(spark, sf_dir):
    """Character F-score of each answer against its question."""
    pairs = turns(spark, sf_dir).select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("pair"), "prompt", "answer")
    return rounded(archived.chrf(pairs, "pair", "answer", "prompt"))


@register(
    f"""WITH {USED}, n AS (SELECT token, count(DISTINCT pos) FILTER (side = 1) / (SELECT count(*) FROM gt) AS m, count(DISTINCT pos) FILTER (side = 0) / (SELECT count(*) FROM ht) AS h FROM used GROUP BY token)
 SELECT token, round(m, 6) AS made_share, round(h, 6) AS human_share, round(m / nullif(h, 0), 6) AS ratio, CAST(row_number() OVER (ORDER BY m / nullif(h, 0) DESC NULLS FIRST, m DESC, encode(token)) AS INTEGER) AS rank FROM n WHERE m >= 0.02"""
)
def overused_tokens(spark, sf_dir):
    return rounded(archived.overused(made(spark, sf_dir), human(spark, sf_dir)))


@register(
    f"""WITH {SHARES}, d AS (SELECT *, (g - f) * (g - f) AS q FROM s), r AS (SELECT *, q / sum(q) OVER () AS share, row_number() OVER (ORDER BY q DESC, encode(token)) AS rank FROM d)
 SELECT token, round(g / nullif(f, 0) - 1, 6) AS relative, round(share, 6) AS share, round(sum(share) OVER (ORDER BY rank), 6) AS cumulative, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 1000"""
)
def token_shifts(spark, sf_dir):
    return rounded(archived.token_shifts(made(spark, sf_dir), human(spark, sf_dir)))


@register(f"WITH {SHARES}, j AS (SELECT CASE WHEN f > 0 THEN f * log2(2 * f / (f + g)) ELSE 0 END AS a, CASE WHEN g > 0 THEN g * log2(2 * g / (f + g)) ELSE 0 END AS b FROM s) SELECT round(sum(a + b) / 2, 6) AS jsd FROM j")
def token_divergence(spark, sf_dir):
    return rounded(archived.token_divergence(made(spark, sf_dir), human(spark, sf_dir)))


@register(
    """WITH v AS (SELECT CAST(vec_id % 2 AS INTEGER) AS side, vec_id, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS x, unnest(range(len(embedding))) AS i FROM embeddings)
 SELECT a.side, CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, count(*) AS n, round(avg(a.x), 6) AS mean, round(covar_samp(a.x, b.x), 6) AS cov FROM v a JOIN v b ON a.vec_id = b.vec_id GROUP BY ALL"""
)
def embedding_moments(spark, sf_dir):
    """Means and covariances of the vectors of two corpora."""
    x, y = (s.select(F.lit(k).alias("side"), "v") for k, s in enumerate(sides(spark, sf_dir)))
    return rounded(archived.moments(x.unionByName(y)))


@register()
def frechet_distance(spark, sf_dir):
    return rounded(archived.frechet(*sides(spark, sf_dir)))


@register()
def mauve(spark, sf_dir):
    return rounded(archived.mauve(*sides(spark, sf_dir)))


@register("SELECT round(avg(CASE WHEN regexp_matches(regexp_replace(text, '\\p{Latin}', '', 'g'), '\\p{L}') THEN 1.0 ELSE 0.0 END), 6) AS foreign_share FROM documents")
def foreign_texts(spark, sf_dir):
    return rounded(archived.foreign_texts(read(spark, sf_dir, "documents")))


@register(
    """WITH d AS (SELECT CASE turn % 3 WHEN 0 THEN 'clarity' WHEN 1 THEN 'depth' ELSE 'relevance' END AS dimension, CASE WHEN length(text) % 7 = 0 THEN 'TIE' WHEN length(text) % 2 = 0 THEN 'MADE' ELSE 'HUMAN' END AS won FROM conversations)
 SELECT dimension, sum(CASE won WHEN 'MADE' THEN 1.0::DOUBLE WHEN 'TIE' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS wins, round(avg(CASE won WHEN 'MADE' THEN 1.0::DOUBLE WHEN 'TIE' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END), 6) AS rate FROM d GROUP BY dimension"""
)
def win_rates(spark, sf_dir):
    n, turn = F.length("text"), F.col("turn") % 3
    rows = read(spark, sf_dir, "conversations").select(F.when(turn == 0, "clarity").when(turn == 1, "depth").otherwise("relevance").alias("dimension"), F.when(n % 7 == 0, "TIE").when(n % 2 == 0, "MADE").otherwise("HUMAN").alias("won"))
    return rounded(archived.win_rates(rows))

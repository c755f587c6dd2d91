"""DuckDB SQL for the queries that SQL can express.

The SQL states the contracts in its own way: it joins windows to every
place of a text where the operators filter by prefixes, and solves the
targets of a mix in closed form where the operators iterate.
"""

from corpusloom.llm import mixing, rules, urlfilter

SPACE_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ITEM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{0}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+')"

MIX = rf"""
WITH sized AS (SELECT doc_id, source, CAST(len({SPACE_WORDS}) AS BIGINT) AS size,
    md5(concat_ws(chr(31), coalesce(CAST(doc_id AS VARCHAR), chr(30)), coalesce(text, chr(30)), coalesce(source, chr(30)))) AS digest FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY digest) - 1 AS nth FROM sized),
sources AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source),
weighed AS (SELECT *, [{", ".join(f"{w}.0" for w in mixing.CYCLE)}][1 + (rank - 1) % {len(mixing.CYCLE)}]::DOUBLE AS weight, {mixing.CEILING}::DOUBLE * source_size AS cap FROM sources),
ordered AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
    sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free, {mixing.SHARE}::DOUBLE * sum(source_size) OVER () AS goal FROM weighed),
levels AS (SELECT *, (goal - held) / free AS level FROM ordered),
final AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, weight, cap, (SELECT arg_min(level, cap / weight) FILTER (WHERE level < cap / weight) FROM levels) AS level FROM levels),
rated AS (SELECT source, source_size, least(cap, level * weight) AS target, CASE WHEN source_size > 0 THEN least({mixing.CEILING}::DOUBLE, least(cap, level * weight) / source_size) ELSE 0.0 END AS rate FROM final)
SELECT doc_id, size, r.source_size, r.target, CAST(size * (floor(rate)
    + CASE WHEN CAST(CAST('0x' || substr(md5(concat_ws('|', '{mixing.SEED}', digest, CAST(nth AS VARCHAR))), 1, 12) AS BIGINT) AS DOUBLE) / {float(1 << 48)}::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM numbered n JOIN rated r ON n.source IS NOT DISTINCT FROM r.source
"""

CONTAMINATION = rf"""
WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {ITEM_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS win
    FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS nth, doc_id, {ITEM_WORDS} AS w FROM documents),
spread AS (SELECT nth, w, unnest(range(1, len(w) + 1)) AS s FROM docs),
found AS (SELECT p.nth, p.s, v.n, v.item FROM spread p CROSS JOIN (SELECT DISTINCT n FROM windows) l JOIN windows v ON v.n = l.n AND v.win = array_to_string(p.w[p.s:p.s + l.n - 1], ' ') WHERE p.s + l.n - 1 <= len(p.w)),
hits AS (SELECT nth, count(DISTINCT place) AS n_hit FROM (SELECT nth, unnest(range(s, s + n)) AS place FROM found) GROUP BY nth),
named AS (SELECT nth, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT nth, item FROM found) GROUP BY nth)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (nth) LEFT JOIN named USING (nth)
"""

LEDGER = rf"""
SELECT row_number() OVER () AS nth, doc_id, coalesce(text, '') AS t, {SPACE_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
"""
MEASURES = rf"""
docs AS ({LEDGER}),
grams AS (SELECT nth, s, concat_ws(' ', w[s], w[s + 1], w[s + 2]) AS g FROM (SELECT nth, w, unnest(range(1, len(w) - 1)) AS s FROM docs)),
again AS (SELECT nth, s FROM (SELECT *, count(*) OVER (PARTITION BY nth, g) AS c FROM grams) WHERE c > 1),
repeated AS (SELECT nth, count(DISTINCT place) AS n FROM (SELECT nth, unnest([s, s + 1, s + 2]) AS place FROM again) GROUP BY nth),
measured AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, CAST(length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS BIGINT) AS n_letters, CAST(length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS BIGINT) AS n_upper
    FROM docs LEFT JOIN repeated r USING (nth)),
book AS (SELECT *, {" + ".join(f"(CASE WHEN {r.fails} THEN {1 << i} ELSE 0 END)" for i, r in enumerate(rules.RULES))} AS failed FROM measured)
"""

RULE_LEDGER = f"""
WITH {MEASURES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT ({" OR ".join(r.fails for r in rules.RULES if r.name in rules.POLICIES[rules.PRODUCTION])}) AS kept, CAST(failed AS BIGINT) AS failed
FROM book
"""

ABLATION = f"WITH {MEASURES}" + " UNION ALL ".join(
    f"SELECT '{p}' AS policy, '{name}' AS rule, count(*) AS n_docs, count(*) FILTER (WHERE {fails[name]}) AS n_failed, count(*) FILTER (WHERE ({fails[name]}) AND NOT ({' OR '.join(fails[x] for x in names if x != name)})) AS n_only FROM book"
    for fails in [{r.name: r.fails for r in rules.RULES}]
    for p, names in rules.POLICIES.items()
    for name in names
)

#: Rules by length; of two that fit, the longer one counts.
URL_RULES = rf"""
WITH parts AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(host, path, verdict) AS (VALUES {", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in urlfilter.RULES)}),
fitting AS (SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC) AS nth
    FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, verdict FROM fitting WHERE nth = 1
"""

DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
LUHN = f"list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda i: CASE WHEN (length({DIGITS}) - i) % 2 = 0 THEN CAST(substr({DIGITS}, i, 1) AS INT) ELSE (2 * CAST(substr({DIGITS}, i, 1) AS INT)) // 10 + (2 * CAST(substr({DIGITS}, i, 1) AS INT)) % 10 END)) % 10 = 0"
# The patterns of the contract.
KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: try_cast(x AS HUGEINT) IS NULL OR try_cast(x AS HUGEINT) > 255)) = 0"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({DIGITS}) BETWEEN 14 AND 19 AND {LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({DIGITS}) BETWEEN 10 AND 15"),
)
PII = (
    "WITH docs AS (SELECT row_number() OVER () AS nth, doc_id, coalesce(text, '') AS t FROM documents), "
    + ", ".join(
        rf"""{k}_cut AS (SELECT nth, unnest(found) AS m, unnest(gaps[1:len(found)]) AS g, unnest(range(1, len(found) + 1)) AS i FROM (SELECT nth, regexp_extract_all(t, '{p}') AS found, string_split_regex(t, '{p}') AS gaps FROM docs)),
{k}_at AS (SELECT nth, m, sum(length(g) + length(m)) OVER (PARTITION BY nth ORDER BY i) AS e FROM {k}_cut),
{k}_ok AS (SELECT nth, {n} AS k, '{k}' AS name, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM {k}_at WHERE {ok})"""
        for n, (k, p, ok) in enumerate(KINDS)
    )
    + ", spans AS ("
    + " UNION ALL ".join(f"SELECT * FROM {k}_ok" for k, _, _ in KINDS)
    + ") SELECT doc_id, "
    + ", ".join(f"count(*) FILTER (WHERE name = '{k}') AS n_{k}" for k, _, _ in KINDS)
    + ", coalesce(string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, k), '') AS spans FROM docs LEFT JOIN spans USING (nth) GROUP BY nth, doc_id"
)

SHARDS = "SELECT count(*) AS n_docs, CAST(sum(octet_length(encode(coalesce(text, ''))) + 16) AS BIGINT) AS n_bytes, CAST(sum(doc_id) AS BIGINT) AS sum_ids, true AS gapless, true AS even FROM documents"

#: Term by term, where the operator tallies combinations of counts.
DIVERGENCE = r"""
WITH docs AS (SELECT row_number() OVER () AS nth, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{0}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents),
used AS (SELECT nth, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term FROM used GROUP BY lang, term HAVING count(DISTINCT nth) >= 30),
n_kept AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counted AS (SELECT g.lang, g.source, k.term, count(u.nth)::HUGEINT AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term GROUP BY ALL),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM counted GROUP BY ALL),
p AS (SELECT c.lang, source, term, n, (1 + (1000000000 * (n + 5)) // (total + 5 * v))::BIGINT AS p FROM counted c JOIN totals USING (lang, source) JOIN n_kept USING (lang)),
lang_counted AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM counted GROUP BY ALL),
lang_totals AS (SELECT lang, sum(n)::HUGEINT AS total FROM lang_counted GROUP BY ALL),
q AS (SELECT c.lang, term, (1 + (1000000000 * (n + 5)) // (total + 5 * v))::BIGINT AS q FROM lang_counted c JOIN lang_totals USING (lang) JOIN n_kept USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(sum(abs(x.p - y.p)), 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
ahead AS (SELECT p.lang, source, term AS item, p.p - q.q AS value, row_number() OVER (PARTITION BY p.lang, source ORDER BY p.p - q.q DESC, encode(term)) AS rank FROM p JOIN q USING (lang, term) WHERE n > 0 AND p.p > q.q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM pairs
UNION ALL SELECT lang, source, 'term', item, value, CAST(rank AS INTEGER) FROM ahead WHERE rank <= 50
"""

SQL: dict[str, str] = {
    "op1_mix_sources": MIX,
    "op5_decontaminate": CONTAMINATION,
    "op8_apply_rules": RULE_LEDGER,
    "op11_audit_sources": DIVERGENCE,
    "rule_ablation": ABLATION,
    "url_rules": URL_RULES,
    "pii_base": PII,
    "shard_checks": SHARDS,
}

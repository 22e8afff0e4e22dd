"""SQL for DuckDB that gives the rows of the queries that SQL can express, from the tables alone."""

from __future__ import annotations

import math

from . import embedding_dedup, minhash_dedup, mixing, quality_rules, url_filters

_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op2() -> str:
    return f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
WHERE list_cosine_similarity(a.e, b.e) >= {embedding_dedup.COSINE}),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""


def op4() -> str:
    rule = verdict = "NULL"
    for kind, text in reversed(url_filters.ordered(url_filters.RULES)):
        own, slash, rest = text.partition("/")
        fits = f"((host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '{slash + rest}'))"
        rule, verdict = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{kind}' ELSE {verdict} END"

    def flow(name: str, src: str, dst: str, kind: str) -> str:
        d = url_filters.DAMPING
        steps = [f"{name}_seed AS (SELECT host, {kind} / (allowed + blocked) AS score FROM hosts WHERE {kind} > 0)", f"{name}0 AS (SELECT * FROM {name}_seed)"]
        for k in range(url_filters.STEPS):
            moved = f"SELECT {dst} AS host, score * share * {d} AS score FROM {name}{k} JOIN share ON {src} = host"
            steps.append(f"{name}{k + 1} AS (SELECT host, sum(score) AS score FROM (SELECT host, score * (1 - {d}::DOUBLE) AS score FROM {name}_seed UNION ALL {moved}) GROUP BY 1)")
        return ",\n".join(steps)

    last = url_filters.STEPS
    link = url_filters.LINK.replace("'", "''")
    return f"""WITH u AS (SELECT page_id, html, coalesce({_LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host,
coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
j AS (SELECT *, {rule} AS rule, {verdict} AS verdict FROM u),
hosts AS (SELECT host, count(*) FILTER (verdict = 'allow') AS allowed, count(*) FILTER (verdict = 'block') AS blocked FROM j WHERE host <> '' GROUP BY 1),
links AS (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS x FROM u WHERE host <> ''),
edges AS (SELECT src, {_LOWER.format("x")} AS dst, count(*) AS weight FROM links WHERE src <> {_LOWER.format("x")} GROUP BY 1, 2),
share AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM edges),
{flow("t", "src", "dst", "allowed")},
{flow("d", "dst", "src", "blocked")}
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN coalesce(d.score, 0) - coalesce(t.score, 0) > {url_filters.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict,
round(coalesce(t.score, 0), 9) AS trust, round(coalesce(d.score, 0), 9) AS distrust FROM j LEFT JOIN t{last} t USING (host) LEFT JOIN d{last} d USING (host)"""


def op7() -> str:
    tests = [(rule, cut) for rule, (_, grid) in quality_rules.RULES.items() for cut in grid]
    each = quality_rules.LIMIT / len(quality_rules.RULES)
    measure = {rule: sql for rule, (sql, _) in quality_rules.RULES.items()}
    listed = " UNION ALL ".join(f"SELECT lang, '{rule}' AS rule, {cut}::DOUBLE AS cut, count(*) AS n, count(*) FILTER ({measure[rule]} > {cut}::DOUBLE) AS k FROM held GROUP BY 1" for rule, cut in tests)
    tail = f"ln(list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({each}) + (n - i) * ln(1 - {each})))))"
    cuts = ", ".join(f"min(cut) FILTER (rule = '{rule}') AS cut_{rule}" for rule in measure)
    over = " OR ".join(f"coalesce({sql} > cut_{rule}, false)" for rule, sql in measure.items())
    return f"""WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS x, {_WORDS.format("text")} AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
again AS (SELECT g.doc_id, i FROM g JOIN (SELECT doc_id, g FROM g GROUP BY 1, 2 HAVING count(*) > 1) USING (doc_id, g)),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS j FROM again) GROUP BY 1),
l AS (SELECT doc_id, list_filter(string_split(x, chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) AS l FROM w),
m AS (SELECT w.doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(x, '[#*$%&|<>]'))::BIGINT AS n_symbols,
(len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines FROM w JOIN l USING (doc_id) LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, {quality_rules.BASE_FAILED} AS base_failed FROM m),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1 HAVING max(quality) = 1),
held AS (SELECT * FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
t AS ({listed}),
safe AS (SELECT lang, rule, cut FROM t WHERE k <= n * {each} AND {tail} <= {math.log(quality_rules.CONFIDENCE_LOSS)} - ln({len(tests)} * (SELECT count(DISTINCT coalesce(lang, '')) FROM held))),
c AS (SELECT lang AS of_lang, {cuts} FROM safe GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({over}) AS kept FROM b LEFT JOIN c ON of_lang IS NOT DISTINCT FROM lang"""


def op8() -> str:
    weights = ", ".join(f"{w}::DOUBLE" for w in mixing.WEIGHTS)
    return f"""WITH d AS (SELECT doc_id, source, len({_WORDS.format("text")})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY 1),
w AS (SELECT *, [{weights}][k % {len(mixing.WEIGHTS)} + 1] AS weight, source_size * {mixing.MAX_EPOCHS}::DOUBLE AS cap FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clamped,
sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM w),
v AS (SELECT arg_min(level, i) AS level FROM (SELECT row_number() OVER (ORDER BY cap / weight, k) AS i, ((SELECT sum(source_size) FROM s) - clamped) / free AS level, cap / weight AS most FROM o) WHERE level <= most),
t AS (SELECT source, source_size, least(cap, weight * level) AS target FROM w, v),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
x AS (SELECT d.*, source_size, target, whole, target - whole * source_size AS rest, coalesce(sum(size) OVER (PARTITION BY d.source
ORDER BY substr(sha256('17 ' || coalesce(doc_id::VARCHAR, 'null') || ' ' || size), 1, 16), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior
FROM d JOIN p ON p.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN size > 0 AND floor((rest - prior) / size + 0.5::DOUBLE) >= 1 THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM x"""


def op9(percent: int = 85) -> str:
    k = minhash_dedup.SHINGLE
    gram = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, {gram} AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM w WHERE len(w) >= {k})
UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND {k - 1}),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w JOIN c ON c.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id"""

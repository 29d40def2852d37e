"""DuckDB statements that give the queries' results by plain means."""

from __future__ import annotations

import math

from doctide.llm import license_scan as scan
from doctide.llm import quality_rules as rules


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def license_sql() -> str:
    starts, names = [], []
    for phrase, label in scan.PHRASES:
        parts = phrase.split()
        test = " AND ".join(f"w[i + {k}] = {_quote(p)}" for k, p in enumerate(parts))
        starts.append(f"list_filter(range(1, len(w) - {len(parts) - 2}), lambda i: {test}) AS at_{label}")
        names.append(label)
    every = "list_concat(" + "list_concat(".join(f"at_{n}, " for n in names[:-1]) + f"at_{names[-1]}" + ")" * (len(names) - 1)
    hits, scores = [], []
    for k, (label, statement) in enumerate(scan.TEMPLATES):
        t = scan._tokens(statement)
        need = math.ceil(scan.CONTAINMENT * len(t) - 1e-9)
        tokens = "[" + ", ".join(map(_quote, t)) + "]"
        step = scan.stride(statement)
        best = (f"coalesce(list_max(list_transform(range(0, CAST(greatest(ceil((len(w) - {step}) / {step}.0), 1) AS BIGINT)), "
                f"lambda b: len(list_intersect({tokens}, w[b * {step} + 1:b * {step} + {2 * step}])))), 0)")
        hits.append(f"CASE WHEN m{k} >= {need} THEN {_quote(label)} END")
        scores.append(f"CASE WHEN m{k} >= {need} THEN m{k} / {len(t)}.0E0 ELSE 0.0E0 END")
        starts.append(f"{best} AS m{k}")
    base = "[" + ", ".join(f"CASE WHEN len(at_{n}) > 0 THEN {_quote(n)} END" for n in names) + "]"
    both = f"list_concat({base}, [{', '.join(hits)}])"
    joined = lambda x: f"array_to_string(list_sort(list_distinct(list_filter({x}, lambda v: v IS NOT NULL))), ',')"
    return (
        "WITH t AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
        "'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), "
        f"lambda x: x <> '') AS w FROM documents), f AS (SELECT doc_id, w, {', '.join(starts)} FROM t) "
        f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len({every}) AS BIGINT) AS n_base, "
        f"CAST(list_min({every}) - 1 AS BIGINT) AS first_word, CAST(list_max({every}) - 1 AS BIGINT) AS last_word, "
        f"coalesce({joined(base)}, '') AS base_labels, coalesce({joined(both)}, '') AS labels, "
        f"CASE WHEN len({every}) > 0 THEN 1.0E0 ELSE greatest({', '.join(scores)}) END AS score FROM f")


LINES = r"""
WITH l AS (SELECT doc_id, i, la[i] AS s FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS la FROM documents) q, unnest(range(1, len(la) + 1)) u(i)),
k AS (SELECT *, translate(regexp_replace(s, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
d AS (SELECT k.doc_id, i, s, g.key IS NOT NULL AND k.doc_id <> g.keeper AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
 sha256(coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM d GROUP BY doc_id"""


def quality_sql() -> str:
    edges, beyond = [], []
    for name, low, high, made_of in rules.SIGNALS:
        q = lambda p: f"list_sort(list({name}))[CAST(ceil({p}E0 * count(*)) AS BIGINT)]"  # noqa: B023, E731
        fence = lambda p: f"{q(p)} + {rules.SPREAD}E0 * ({q(p)} - {q(0.5)})"  # noqa: B023, E731
        if low is not None:
            edges.append(f"{fence(low)} AS low_{name}")
            beyond.append(f"{name} < low_{name}")
        if high is not None:
            edges.append(f"{fence(high)} AS high_{name}")
            if made_of:
                count, length = (f"CAST({x.lstrip('_')} AS DOUBLE)" for x in made_of)
                beyond.append(f"{count} - high_{name} * {length} > {rules.NOISE}E0 * sqrt({count})")
            else:
                beyond.append(f"{name} > high_{name}")
    edge = [e.rsplit(" AS ", 1)[1] for e in edges]
    picked = ", ".join(f"CASE WHEN a.n >= {rules.MIN_GROUP} THEN a.{e} WHEN b.n >= {rules.MIN_GROUP} THEN b.{e} ELSE c.{e} END AS {e}" for e in edge)
    level = lambda keys: f"SELECT {keys + ', ' if keys else ''}count(*) AS n, {', '.join(edges)} FROM s WHERE NOT base_failed {'GROUP BY ' + keys if keys else ''}"
    return rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
 list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS x FROM t, unnest(range(1, len(w) - 6)) u(i)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS c FROM v) z WHERE c > 1),
c AS (SELECT doc_id, sum(least(8, coalesce(nx - i, 8))) AS n FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM r) z GROUP BY doc_id),
b AS (SELECT t.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
 CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
 CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS capitals, len(l) AS lines FROM t LEFT JOIN c ON c.doc_id = t.doc_id),
s AS (SELECT *, CAST(n_symbols AS DOUBLE) / greatest(word_chars, 1) AS symbol_share, CAST(capitals AS DOUBLE) / greatest(word_chars, 1) AS capital_share,
 CAST(n_dup_lines AS DOUBLE) / greatest(lines, 1) AS dup_line_share, CAST(word_chars AS DOUBLE) / greatest(n_words, 1) AS word_length,
 n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.REPEAT_PERCENT} * n_words AS base_failed FROM b),
g0 AS ({level('lang, source')}), g1 AS ({level('lang')}), g2 AS ({level('')}),
f AS (SELECT s.*, {picked} FROM s LEFT JOIN g0 a ON a.lang IS NOT DISTINCT FROM s.lang AND a.source IS NOT DISTINCT FROM s.source
 LEFT JOIN g1 b ON b.lang IS NOT DISTINCT FROM s.lang LEFT JOIN g2 c ON true)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND NOT coalesce({' OR '.join(f'coalesce({x}, false)' for x in beyond)}, false) AS kept FROM f"""


TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score FROM v q JOIN v d ON d.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) r WHERE rank <= 5"""

NGRAM = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
 '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i+3], ' ')) AS x FROM t, unnest(range(1, greatest(len(w) - 2, 2))) u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.reach)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
 JOIN (SELECT id, min(reach) AS component_id FROM r GROUP BY id) m ON m.id = d.doc_id"""

ORACLES = {
    "op1_license_scan": license_sql(),
    "op2_line_dedup": LINES,
    "op5_ngram_join": NGRAM,
    "op8_quality_rules": quality_sql(),
    "op9_topk_search": TOPK,
}

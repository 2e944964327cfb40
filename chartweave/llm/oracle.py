"""DuckDB SQL of the queries that SQL can express, written plainly over whole tables."""

from __future__ import annotations

from chartweave.llm import secret_scan
from chartweave.llm.mixing import Mix

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def secrets() -> str:
    """Spans by splitting at the matches; entropy of every window of every candidate from scratch."""
    def found(kind: int, pattern: str, group: int, keep: str) -> str:
        p = _quoted(pattern)
        return f"""SELECT doc_id, {kind} AS kind, s AS "start", s + length(h) AS "end", g FROM (
  SELECT doc_id, hits[i] AS h, groups[i] AS g, list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT doc_id, string_split_regex(t, {p}) AS parts, regexp_extract_all(t, {p}) AS hits, regexp_extract_all(t, {p}, {group}) AS groups FROM d WHERE regexp_matches(t, {p})), unnest(range(1, len(hits) + 1)) u(i)) WHERE {keep}"""

    w, rules = secret_scan.WINDOW, secret_scan.Rules()
    base = " UNION ALL ".join((found(0, secret_scan.ASSIGN, 2, f"length(g) >= {secret_scan.ASSIGN_LEAST}"), found(1, secret_scan.ACCESS, 0, "true"), found(2, secret_scan.HEX, 0, "true")))
    allow = _quoted("|".join(f"(?:{p})" for p in rules.allow))
    names = "[" + ", ".join(f"'{k}'" for k in secret_scan.KINDS) + "]"
    listed = lambda table, name: f"SELECT doc_id, string_agg({names}[kind + 1] || ':' || CAST(\"start\" AS BIGINT) || ':' || CAST(\"end\" AS BIGINT), ',' ORDER BY \"start\", kind, \"end\") AS {name} FROM {table} GROUP BY 1"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), base AS ({base}),
cand AS ({found(9, secret_scan.CANDIDATE, 0, f"NOT regexp_matches(h, {allow})")}),
win AS (SELECT doc_id, CASE WHEN regexp_matches(g, {_quoted(secret_scan.HEX_CLASS)}) THEN 3 ELSE 4 END AS kind, "start" AS c, "start" + i - 1 AS s, list_aggregate(string_split(substr(g, i, {w}), ''), 'entropy') AS h FROM cand, unnest(range(1, length(g) - {w} + 2)) u(i)),
dense AS (SELECT *, lag(s) OVER (PARTITION BY doc_id, c ORDER BY s) AS before FROM win WHERE h >= CASE kind WHEN 3 THEN {rules.hex_bits} ELSE {rules.base64_bits} END),
runs AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before + {w} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, c ORDER BY s) AS r FROM dense),
extra AS (SELECT doc_id, kind, min(s) AS "start", max(s) + {w} AS "end" FROM runs GROUP BY doc_id, kind, c, r),
fresh AS (SELECT * FROM extra e WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = e.doc_id AND b."start" <= e."start" AND b."end" >= e."end")),
spans AS (SELECT doc_id, kind, "start", "end" FROM base UNION ALL SELECT * FROM fresh),
n AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind > 2) AS n_entropy FROM spans GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b.listed, '')) AS base_sha256, coalesce(a.listed, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN ({listed("base", "listed")}) b USING (doc_id) LEFT JOIN ({listed("spans", "listed")}) a USING (doc_id)"""


def contamination(size: int = 10) -> str:
    """Every window of every text joined to the items' windows by equality of its words."""
    return f"""
WITH t AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, list_slice(w, s, s + least({size}, len(w)) - 1) AS g FROM t, unnest(range(1, len(w) - least({size}, len(w)) + 2)) u(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(g) AS k FROM win), d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
hit AS (SELECT * FROM (SELECT doc_id, s, k, list_slice(w, s, s + k - 1) AS g FROM d, sizes, unnest(range(1, len(w) - k + 2)) u(s)) SEMI JOIN win USING (g)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(s, s + k)) u(p) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit JOIN win USING (g)) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)"""


def mixing(mix: Mix) -> str:
    """Water filling level by level, then whole orders of each leaf with running sums."""
    tree = ("domain", "lang", "source")

    def weight(depth: int) -> str:
        cases = " ".join("WHEN " + " AND ".join(f"{c} = '{v}'" for c, v in zip(tree, path, strict=False)) + f" THEN {float(w)}" for path, w in mix.weights.items() if len(path) == depth)
        return f"CASE {cases} ELSE 1.0 END" if cases else "1.0"

    levels, above = [], "b0"
    for depth in range(1, 4):
        node, parent = ", ".join(tree[:depth]), ", ".join((*tree[: depth - 1], "1"))
        join = f"JOIN b{depth - 1} USING ({', '.join(tree[: depth - 1])})" if depth > 1 else "CROSS JOIN b0"
        over = f"OVER (PARTITION BY {parent}"
        levels.append(f"""
n{depth} AS (SELECT {node}, sum(cap) AS c, any_value({weight(depth)}) AS w FROM leaf GROUP BY {node} HAVING sum(cap) > 0),
f{depth} AS (SELECT *, (b - sum(c) {over} ORDER BY c / w, {tree[depth - 1]}) + c) / (sum(w) {over}) - sum(w) {over} ORDER BY c / w, {tree[depth - 1]}) + w) AS line FROM n{depth} {join}),
b{depth} AS (SELECT {node}, least(c, coalesce(w * max(CASE WHEN c > w * line THEN line END) {over}), c)) AS b FROM f{depth})""")
        above = f"b{depth}"
    return rf"""
WITH r AS (SELECT doc_id, CASE WHEN regexp_extract(source, '([0-9]+)$', 1) = '' OR source IS NULL THEN 'other' WHEN CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) < 10 THEN 'web' ELSE 'curated' END AS domain,
  coalesce(lang, 'other') AS lang, coalesce(source, 'other') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(tokens) AS tokens, sum(tokens) * {float(mix.epochs)} AS cap FROM r GROUP BY ALL), b0 AS (SELECT floor(sum(tokens) * {mix.share}) AS b FROM leaf),{",".join(levels)},
target AS (SELECT domain, lang, source, tokens AS total, CAST(floor(b + 1e-6) AS BIGINT) AS target, CAST(floor(b + 1e-6) AS BIGINT) // tokens AS whole FROM leaf JOIN {above} USING (domain, lang, source) WHERE tokens > 0),
o AS (SELECT r.*, whole, target - whole * total AS room, CAST('0x' || substr(md5('{mix.seed}:' || whole || ':' || doc_id), 1, 15) AS BIGINT) AS h FROM r JOIN target USING (domain, lang, source)),
s AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY h) AS upto FROM o)
SELECT domain, lang, source, doc_id, tokens, CAST(e AS INT) AS epoch FROM s, unnest(range(0, CAST(whole + CASE WHEN upto <= room AND room > 0 THEN 1 ELSE 0 END AS BIGINT))) u(e)"""


def fill_in_middle(seed: int = 7, spm: int = 50) -> str:
    """Lines as a list, cut by the draws and joined again."""
    draw = lambda k: f"CAST('0x' || substr(h, {1 + 8 * k}, 8) AS BIGINT)"
    joined = lambda a, b: f"array_to_string(list_slice(u, {a}, {b}), '')"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT *, len(u) AS n, least({draw(0)} % (len(u) + 1), {draw(1)} % (len(u) + 1)) AS a, greatest({draw(0)} % (len(u) + 1), {draw(1)} % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {draw(2)} % 100 >= 100 THEN 'plain' WHEN {draw(3)} % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, {joined("1", "a")} AS p, {joined("a + 1", "b")} AS m, {joined("b + 1", "n")} AS s FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM c"""


def divergence(least_docs: int = 3, top: int = 200) -> str:
    """Counts of every term in every group, and each pair of groups over all terms."""
    share = lambda c, n: f"CAST(1 + (1000000000::HUGEINT * ({c} + 1)) // ({n} + v) AS BIGINT)"
    return rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT lang, source, term, count(*) AS docs, sum(n)::BIGINT AS c FROM (SELECT lang, source, k, term, count(*) AS n FROM (SELECT *, row_number() OVER () AS k FROM d), unnest(w) u(term) GROUP BY ALL) GROUP BY ALL),
kept AS (SELECT lang, term, sum(c)::BIGINT AS c FROM c GROUP BY ALL HAVING sum(docs) >= {least_docs}),
own AS (SELECT c.lang, source, term, c.c FROM c JOIN kept USING (lang, term)),
l AS (SELECT lang, count(*) AS v, sum(c)::BIGINT AS n FROM kept GROUP BY 1), s AS (SELECT lang, source, sum(c)::BIGINT AS n FROM own GROUP BY ALL),
g AS (SELECT lang, source, coalesce(s.n, 0) AS n, coalesce(l.v, 0) AS v, coalesce(l.n, 0) AS ln FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN s USING (lang, source) LEFT JOIN l USING (lang)),
x AS (SELECT g.lang, g.source, kept.term, coalesce(own.c, 0) AS c, {share("coalesce(own.c, 0)", "g.n")} AS p, {share("kept.c", "g.ln")} AS q FROM g JOIN kept USING (lang) LEFT JOIN own USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
alone AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM x WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM alone
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM terms) WHERE rank <= {top}"""

"""SQL of the secret and decontamination queries for DuckDB, made from the operators' own parameters."""

from __future__ import annotations

from .secrets import BASE, CLASSES, AllowList, _terms, entropy_limit


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _placed(pattern: str, text: str = "text") -> str:
    """Matches of a pattern as a list of {s, v}: a match starts where the lengths of what lies before it end."""
    p = _quoted(pattern)
    values, gaps = f"regexp_extract_all({text}, {p})", f"string_split_regex({text}, {p})"
    before = f"list_sum(list_transform({gaps}[1:i + 1], lambda g: len(g))) + coalesce(list_sum(list_transform({values}[1:i], lambda m: len(m))), 0)"
    return f"list_transform(range(len({values})), lambda i: {{'s': CAST({before} AS BIGINT), 'v': {values}[i + 1]}})"


def secrets_sql(allow: AllowList = AllowList()) -> str:
    base = []
    for rank, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        base.append(
            f"list_transform(list_filter({_placed(pattern)}, lambda m: len(regexp_extract(m.v, {_quoted(pattern)}, {group})) >= {least}), lambda m: {{'s': m.s, 'k': {rank}, 'e': m.s + len(m.v), 'kind': '{kind}'}})"
        )
    lists = base[0]
    for b in base[1:]:
        lists = f"list_concat({lists}, {b})"
    whole = _quoted("|".join(f"(?:{p})" for p in allow.patterns))
    blanked = "text"
    for w in allow.words:
        blanked = f"replace({blanked}, {_quoted(w)}, {_quoted(' ' * len(w))})"
    candidates = []
    for rank, c in enumerate(CLASSES, len(BASE)):
        candidates.append(
            f"SELECT doc_id, {rank} AS k, '{c.kind}' AS kind, {c.window} AS w, {entropy_limit(c.window, c.bits)} AS most, unnest(list_filter({_placed(c.pattern, 'blanked')}, lambda m: NOT regexp_full_match(m.v, {whole}))) AS m FROM texts"
        )
    terms = str(_terms(max(c.window for c in CLASSES)))
    return f"""
WITH texts AS (SELECT doc_id, text, {blanked} AS blanked FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)), base AS (
  SELECT doc_id, {lists} AS b FROM texts
), candidates AS (
  {' UNION ALL '.join(candidates)}
), windows AS (
  SELECT doc_id, k, kind, w, most, m.s AS s, m.v AS v, unnest(range(len(m.v) - w + 1)) AS i FROM candidates
), flagged AS (
  SELECT doc_id, k, kind, w, s, i FROM (SELECT *, string_split(substr(v, CAST(i + 1 AS BIGINT), w), '') AS c FROM windows)
  WHERE list_sum(list_transform(list_distinct(c), lambda x: {terms}[len(list_filter(c, lambda y: y = x)) + 1])) <= most
), marked AS (
  SELECT *, CASE WHEN i <= lag(i) OVER o + w THEN 0 ELSE 1 END AS fresh FROM flagged WINDOW o AS (PARTITION BY doc_id, k, s ORDER BY i)
), grouped AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, k, s ORDER BY i) AS g FROM marked
), entropy AS (
  SELECT doc_id, {{'s': s + min(i), 'k': k, 'e': s + max(i) + w, 'kind': kind}} AS x FROM grouped GROUP BY doc_id, k, kind, w, s, g
), added AS (
  SELECT doc_id, list(x) AS a FROM entropy GROUP BY doc_id
), every AS (
  SELECT doc_id, list_sort(b) AS b, list_sort(list_concat(b, list_filter(coalesce(a, []), lambda x: len(list_filter(b, lambda y: y.s <= x.s AND x.e <= y.e)) = 0))) AS f FROM base LEFT JOIN added USING (doc_id)
)
SELECT doc_id, {', '.join(f"CAST(len(list_filter(b, lambda x: x.kind = '{kind}')) AS BIGINT) AS n_{kind}" for kind in BASE)},
  sha256(array_to_string(list_transform(b, lambda x: x.kind || ':' || x.s || ':' || x.e), ',')) AS base_sha256,
  array_to_string(list_transform(f, lambda x: x.kind || ':' || x.s || ':' || x.e), ',') AS spans
FROM every
"""


def decontamination_sql(shingle_words: int = 5, similarity: float = 0.8) -> str:
    words = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
    shingles = "list_transform(range(len(w) - k + 1), lambda i: array_to_string(w[i + 1:i + k], ' '))"
    return f"""
WITH items AS (
  SELECT item_id, w, k, len(w) AS n_words, {shingles} AS s FROM (SELECT item_id, w, least(len(w), {shingle_words}) AS k FROM (SELECT item_id, {words} AS w FROM benchmark)) WHERE len(w) > 0
), placed AS (
  SELECT item_id, k, len(s) AS n, n_words, unnest(s) AS x, unnest(range(len(s))) AS item_pos FROM items
), docs AS (
  SELECT doc_id, k, {shingles} AS s FROM (SELECT doc_id, {words} AS w FROM documents), (SELECT DISTINCT k FROM items) WHERE len(w) >= k
), hits AS (
  SELECT d.doc_id, p.item_id, p.k, p.n, p.n_words, d.pos, greatest(d.pos - p.item_pos, 0) AS start FROM (SELECT doc_id, k, unnest(s) AS x, unnest(range(len(s))) AS pos FROM docs) d JOIN placed p USING (k, x)
), enough AS (
  SELECT doc_id, item_id FROM hits GROUP BY doc_id, item_id, n HAVING count(DISTINCT pos) >= ceil(n * {similarity} - 1e-9)
), windows AS (
  SELECT DISTINCT h.doc_id, h.item_id, h.k, h.n, h.n_words, h.start FROM hits h JOIN enough USING (doc_id, item_id)
), cut AS (
  SELECT v.doc_id, v.item_id, v.start, v.n_words, d.s[v.start + 1:v.start + v.n] AS a, i.s AS b FROM windows v JOIN docs d ON d.doc_id = v.doc_id AND d.k = v.k JOIN items i ON i.item_id = v.item_id
), met AS (
  SELECT *, list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))) AS common FROM cut WHERE len(a) > 0
), scored AS (
  SELECT doc_id, item_id, start, n_words, common / (len(a) + len(b) - common) AS similarity FROM met
), best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS r FROM scored WHERE similarity >= {similarity}
)
SELECT doc_id, item_id, CAST(start AS INTEGER) AS start_word, CAST(n_words AS INTEGER) AS n_words, CAST(similarity AS DOUBLE) AS similarity FROM best WHERE r = 1
"""

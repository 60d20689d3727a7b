"""The column functions and statistics of the engine written in SQL, for comparison on the same tables."""

from __future__ import annotations

from lodestone.functions.text import ACTION_STEMS, STEM_PATTERN, STOP_WORDS, TOKEN_PATTERN


def words(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{TOKEN_PATTERN}')"


def stem(x: str) -> str:
    return f"regexp_replace({x}, '{STEM_PATTERN}', '\\1')"


def stems(x: str) -> str:
    return f"list_transform({tokens(x)}, lambda t: {stem('t')})"


def distinct(x: str) -> str:
    """Distinct values in the order of their first places."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def content_stems(q: str) -> str:
    kept = f"list_filter({stems(q)}, lambda s: length(s) >= 3 AND s NOT IN ({words(STOP_WORDS)}))"
    return distinct(kept)


def split_identifier(x: str) -> str:
    capital = "'[А-ЯЁA-Z][а-яёa-z]*'"
    parts = f"list_filter(regexp_split_to_array(trim({x}), '[.\\s]+'), lambda p: p <> '')"
    return f"lower(array_to_string(flatten(list_transform({parts}, lambda p: CASE WHEN len(regexp_extract_all(p, {capital})) > 0 THEN regexp_extract_all(p, {capital}) ELSE [p] END)), ' '))"


def related(a: str, b: str) -> str:
    near = lambda p, q: f"(length({p}) >= 3 AND length({q}) >= 3 AND (starts_with({p}, {q}) OR starts_with({q}, {p})))"
    return f"({a} = {b} OR {near(a, b)} OR {stem(a)} = {stem(b)} OR {near(stem(a), stem(b))})"


def title_bonus(q: str, t: str) -> str:
    covered = f"(len(list_filter({tokens(q)}, lambda a: len(list_filter({tokens(t)}, lambda b: {related('a', 'b')})) > 0)) / len({tokens(q)}))"
    phrase = f"(CASE WHEN contains(array_to_string({tokens(t)}, ' '), array_to_string({tokens(q)}, ' ')) THEN 1.0 ELSE 0.0 END)"
    return f"(CASE WHEN len({tokens(q)}) = 0 OR len({tokens(t)}) = 0 THEN 0.0 WHEN len({content_stems(q)}) <= 1 THEN 0.02 * {covered} + 0.03 * {phrase} ELSE 0.004 * {covered} + 0.006 * {phrase} END)"


def semantic_terms(q: str, t: str) -> str:
    acting = f"(list_contains({tokens(q)}, 'в') AND len({content_stems(q)}) >= 2)"
    fits = f"length({stem('k')}) >= 3 AND (len(list_filter({content_stems(q)}, lambda w: starts_with({stem('k')}, w) OR starts_with(w, {stem('k')}))) > 0 OR ({acting} AND len(list_filter([{words(ACTION_STEMS)}], lambda a: starts_with({stem('k')}, a))) > 0))"
    return f"(CASE WHEN len({content_stems(q)}) = 0 THEN [] ELSE ({distinct(f'list_filter({tokens(t)}, lambda k: {fits})')})[1:8] END)"


#: Documents as chunks.
CHUNKS = f"""chunks AS (
  SELECT doc_id AS chunk_ord, lang || ':' || CAST(doc_id AS VARCHAR) AS id, lang AS domain, regexp_extract(text, '^[^.\\n]*', 0) AS title, source AS path, text,
         trim(regexp_extract(text, '^[^.\\n]*', 0) || ' ' || {split_identifier("regexp_extract(text, '^[^.\\n]*', 0)")}) AS lexical_text
  FROM documents)"""

#: BM25 statistics of every scope.
BM25 = f"""words AS (SELECT chunk_ord, id, domain, {stems('lexical_text')} AS toks FROM chunks),
scoped AS (SELECT domain AS scope, * FROM words UNION ALL SELECT '*' AS scope, * FROM words),
postings AS (SELECT domain, chunk_ord, id, tok, count(*) AS tf FROM (SELECT domain, chunk_ord, id, unnest(toks) AS tok FROM words) GROUP BY ALL),
sizes AS (SELECT scope, count(*) AS n, sum(len(toks)) / count(*) AS avgdl FROM scoped GROUP BY scope),
dfs AS (SELECT scope, tok, count(DISTINCT chunk_ord) AS df FROM (SELECT scope, chunk_ord, unnest(toks) AS tok FROM scoped) GROUP BY ALL),
raws AS (SELECT scope, tok, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs JOIN sizes USING (scope)),
means AS (SELECT scope, avg(raw) AS avg_idf FROM raws GROUP BY scope),
terms AS (SELECT scope, tok, df, CASE WHEN raw < 0 THEN 0.25 * avg_idf ELSE raw END AS idf FROM raws JOIN means USING (scope))"""


def ranked(requests: str, name: str = "ranked") -> str:
    """All chunks of the scope of each request (query_id, scope, query), ranked; ``requests`` names a table."""
    return f"""{name} AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, scope ORDER BY round(raw, 9) DESC, chunk_ord) AS rank FROM (
    SELECT r.query_id, r.scope, c.chunk_ord, c.id, coalesce(h.raw, 0.0) AS raw
    FROM {requests} r JOIN chunks c ON r.scope = '*' OR r.scope = c.domain
    LEFT JOIN (
      SELECT q.query_id, q.scope, p.chunk_ord, sum(t.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * len(w.toks) / s.avgdl))) AS raw
      FROM (SELECT query_id, scope, unnest({stems('query')}) AS tok FROM {requests}) q
      JOIN terms t ON t.scope = q.scope AND t.tok = q.tok JOIN sizes s ON s.scope = q.scope
      JOIN postings p ON p.tok = q.tok AND (q.scope = '*' OR q.scope = p.domain) JOIN words w ON w.chunk_ord = p.chunk_ord
      GROUP BY ALL
    ) h ON h.query_id = r.query_id AND h.scope = r.scope AND h.chunk_ord = c.chunk_ord))"""


def squared_distance(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), lambda z: z[1] * z[2]))"

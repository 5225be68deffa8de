"""DuckDB spellings of the text expressions, for oracle SQL.

The regex strings are shared with ``tagweave.functions.text`` (they are
written to mean the same in Java and RE2). DuckDB's ``regexp_replace`` needs
the 'g' flag to replace every match and spells back-references ``\\1``."""

from __future__ import annotations

from tagweave.functions import text as T
from tagweave.functions.stopwords import CLOSED_CLASS_WORDS, ENGLISH_STOP_WORDS, NUMBER_TOKEN
from tagweave.operators.tokenize import NOUN_RULES, TOKEN_RUN


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


def strip_urls(t: str) -> str:
    return f"regexp_replace({t}, {q(T.URL_PATTERN)}, ' ', 'g')"


def urls(t: str, short_url: bool = False) -> str:
    hosts = f"regexp_extract_all({t}, {q(T.URL_PATTERN)}, 2)"
    if short_url:
        return hosts
    n = f"len({hosts})"
    return (f"list_transform(generate_series(1, {n}), lambda i: "
            f"coalesce(regexp_extract_all({t}, {q(T.URL_PATTERN)}, 1)[i], '') || '://' || {hosts}[i] || "
            f"coalesce(regexp_extract_all({t}, {q(T.URL_PATTERN)}, 3)[i], ''))")


def clitics(t: str) -> str:
    a = f"regexp_replace({t}, '(?i)n''t\\b', ' n''t', 'g')"
    return f"regexp_replace({a}, '(?i)''(s|re|ve|ll|d|m)\\b', ' ''\\1', 'g')"


def content_tokens(t: str) -> str:
    raw = f"regexp_extract_all({clitics(strip_urls(t))}, {q(TOKEN_RUN)})"
    toks = f"list_transform({raw}, lambda x: regexp_replace(x, '\\.+$', ''))"
    toks = f"list_filter({toks}, lambda x: regexp_matches(x, {q(T.WORD_TOKEN)}))"
    toks = f"list_filter({toks}, lambda x: NOT list_contains({sql_list(ENGLISH_STOP_WORDS)}, x))"
    toks = (f"list_filter({toks}, lambda x: NOT list_contains({sql_list(CLOSED_CLASS_WORDS)}, lower(x)) "
            f"AND NOT regexp_matches(x, {q(NUMBER_TOKEN)}))")
    return f"list_transform({toks}, lambda x: lower(x))"


def tokenize_ctes(rel: str, id_col: str, text_col: str, short_url: bool = False, prefix: str = "tk") -> str:
    """CTEs ending in ``{prefix}_all(id, pos, token)``: the lemma tokeniser."""
    rules = ", ".join(f"({q(s)}, {q(r)}, {i})" for i, (s, r) in enumerate(NOUN_RULES))
    return f"""
{prefix}_arr AS (SELECT {id_col} AS id, {content_tokens(text_col)} AS toks, {urls(text_col, short_url)} AS urls
              FROM {rel}),
{prefix}_words AS (SELECT id, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS pos FROM {prefix}_arr),
{prefix}_vocab AS (SELECT DISTINCT token FROM {prefix}_words),
{prefix}_cands AS (
  SELECT v.token, left(v.token, length(v.token) - length(r.suf)) || r.rep AS cand, r.rule
  FROM {prefix}_vocab v, (VALUES {rules}) r(suf, rep, rule)
  WHERE suffix(v.token, r.suf) AND length(v.token) > length(r.suf)),
{prefix}_lemmas AS (
  SELECT * FROM (
    SELECT token, first(cand ORDER BY length(cand), rule) AS lemma
    FROM {prefix}_cands WHERE cand IN (SELECT token FROM {prefix}_vocab) GROUP BY token)
  WHERE length(lemma) < length(token)),
{prefix}_all AS (
  SELECT w.id, w.pos, coalesce(l.lemma, w.token) AS token
  FROM {prefix}_words w LEFT JOIN {prefix}_lemmas l ON w.token = l.token
  UNION ALL
  SELECT id, len(toks) + generate_subscripts(urls, 1) - 1 AS pos, unnest(urls) AS token FROM {prefix}_arr)"""

"""Registered queries: row-wise text, time, JSON and array functions (T1-T27),
token filters (F11) and the flagship sample-feature query (M1 front half)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.functions import text as T
from tagweave.functions import timeofday as TOD
from tagweave.functions.stopwords import ENGLISH_STOP_WORDS
from tagweave.operators import tokenize as TK
from tagweave.plans import oracle_text as O
from tagweave.plans.oracle_text import q
from tagweave.plans.q_sampling import S1_SQL, S1_VIEWS, flagship_sample
from tagweave.plans.registry import register
from tagweave.operators import sampling as S


# --- flagship -------------------------------------------------------------------
@register("m1_sample_features", f"""WITH {S1_SQL},
smp AS (SELECT id, CAST(coalesce(nullif(tag_id, 0), -1) AS INTEGER) AS label,
               coalesce(nullif(translation, ''), text) AS sample_text, time FROM sample),
{O.tokenize_ctes('smp', 'id', 'sample_text')},
toks AS (SELECT id, string_agg(token, ' ' ORDER BY pos) AS tokens FROM tk_all GROUP BY id)
SELECT s.id, s.label, coalesce(t.tokens, '') AS tokens,
  array_to_string(regexp_extract_all(s.sample_text, {q(T.NOISY_PUNCTUATION)}), ' ') AS punctuation,
  round(len(regexp_extract_all(s.sample_text, '[A-Z]')) /
        greatest(len(regexp_extract_all(s.sample_text, '[A-Z]')) + len(regexp_extract_all(s.sample_text, '[a-z]')), 1), 6)
    AS capitalization,
  CAST(round_even((hour(s.time) * 3600 + minute(s.time) * 60 + second(s.time)) / 60.0 / (60.0 / 3), 0) AS INTEGER) % 72
    AS time_of_day
FROM smp s LEFT JOIN toks t ON s.id = t.id""", S1_VIEWS)
def m1_sample_features(t):
    """M1 row features of the flagship sample: lemma tokens (str output),
    noisy punctuation, capitalisation fraction, time of day (resolution 3)."""
    smp = S.to_samples(flagship_sample(t))
    toks = TK.collect_tokens(TK.tokenize(smp, "id", "sample_text"), "str")
    feats = smp.select("id", "label",
                       F.concat_ws(" ", T.punctuation(F.col("sample_text"), strict=False)).alias("punctuation"),
                       F.round(T.capitalization(F.col("sample_text")), 6).alias("capitalization"),
                       TOD.time_of_day(F.col("time"), 3).alias("time_of_day"))
    return feats.join(toks, "id", "left").select(
        "id", "label", F.coalesce("tokens", F.lit("")).alias("tokens"),
        "punctuation", "capitalization", "time_of_day")


# --- T1 / T2 --------------------------------------------------------------------
@register("t1_punctuation_strict", f"""SELECT doc_id,
  array_to_string(regexp_extract_all(text, {q(T.STRICT_PUNCTUATION)}), ' ') AS punctuation,
  len(regexp_extract_all(text, {q(T.STRICT_PUNCTUATION)})) AS n FROM documents""")
def t1_punctuation_strict(t):
    """Strict punctuation of every document (str output + count)."""
    p = T.punctuation(F.col("text"), strict=True)
    return t.documents.select("doc_id", F.concat_ws(" ", p).alias("punctuation"), F.size(p).cast("bigint").alias("n"))


@register("t2_punctuation_noisy", f"""SELECT doc_id,
  array_to_string(regexp_extract_all(text, {q(T.NOISY_PUNCTUATION)}), ' ') AS punctuation,
  len(regexp_extract_all(text, {q(T.NOISY_PUNCTUATION)})) AS n FROM documents""")
def t2_punctuation_noisy(t):
    """Every non-word, non-space character (Python ``[^\\w\\d\\s]``)."""
    p = T.punctuation(F.col("text"), strict=False)
    return t.documents.select("doc_id", F.concat_ws(" ", p).alias("punctuation"), F.size(p).cast("bigint").alias("n"))


# --- T3 -------------------------------------------------------------------------
_EMOJI_TEXT_SQL = "replace(replace(replace(text, '!', '😀😀'), '?', '🚀'), ';', '🇩🇪')"


@register("t3_emoji", f"""SELECT doc_id,
  array_to_string(regexp_extract_all({_EMOJI_TEXT_SQL}, {q(T.EMOJI_RUN)}), ' ') AS emoji,
  len(regexp_extract_all({_EMOJI_TEXT_SQL}, {q(T.EMOJI_RUN)})) AS n FROM documents""")
def t3_emoji(t):
    """Emoji runs. The tables hold no emoji, so the query writes some in
    ('!' -> two faces, '?' -> rocket, ';' -> flag) on both sides."""
    txt = F.replace(F.replace(F.replace("text", F.lit("!"), F.lit("😀😀")), F.lit("?"), F.lit("🚀")),
                    F.lit(";"), F.lit("🇩🇪"))
    e = T.emoji(txt)
    return t.documents.select("doc_id", F.concat_ws(" ", e).alias("emoji"), F.size(e).cast("bigint").alias("n"))


# --- T4 -------------------------------------------------------------------------
@register("t4_capitalization", """SELECT doc_id,
  CAST(len(regexp_extract_all(text, '[A-Z]')) AS DOUBLE) AS n_upper,
  round(len(regexp_extract_all(text, '[A-Z]')) /
        greatest(len(regexp_extract_all(text, '[A-Z]')) + len(regexp_extract_all(text, '[a-z]')), 1), 6) AS fraction
FROM documents""")
def t4_capitalization(t):
    """T4: capital count and capital fraction (ASCII)."""
    return t.documents.select("doc_id", T.capitalization(F.col("text"), fraction=False).alias("n_upper"),
                              F.round(T.capitalization(F.col("text")), 6).alias("fraction"))


# --- T5 / T6 / T7 ------------------------------------------------------------------
def _tod_sql(ts: str, res: int) -> str:
    secs = f"(hour({ts}) * 3600 + minute({ts}) * 60 + second({ts}))"
    return f"CAST(round_even({secs} / 60.0 / (60.0 / {res}), 0) AS INTEGER) % {24 * res}"


@register("t5_time_of_day", f"""SELECT event_id, {_tod_sql('ts', 1)} AS tod1, {_tod_sql('ts', 3)} AS tod3,
  {_tod_sql('ts', 5)} AS tod5 FROM events""")
def t5_time_of_day(t):
    """T5: time-of-day ticks at resolutions 1, 3, 5 (half-even rounding)."""
    ts = F.col("ts")
    return t.events.select("event_id", TOD.time_of_day(ts, 1).alias("tod1"), TOD.time_of_day(ts, 3).alias("tod3"),
                           TOD.time_of_day(ts, 5).alias("tod5"))


@register("t6_timestamp_inputs", f"""SELECT event_id,
  {_tod_sql('make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000)', 2)} AS tod_epoch,
  {_tod_sql("strptime(strftime(ts, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S')", 2)} AS tod_string
FROM events""")
def t6_timestamp_inputs(t):
    """Epoch seconds and text timestamps go through the same tick."""
    e = t.events.select("event_id", TOD.epoch_seconds(F.col("ts")).alias("epoch"),
                        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("s"))
    return e.select("event_id",
                    TOD.time_of_day(TOD.to_timestamp_any(F.col("epoch"), "epoch"), 2).alias("tod_epoch"),
                    TOD.time_of_day(TOD.to_timestamp_any(F.col("s"), "string"), 2).alias("tod_string"))


@register("t7_time_onehot", f"""SELECT event_id,
  CAST(list_position(list_transform(generate_series(0, 95), lambda i: CASE WHEN i = {_tod_sql('ts', 4)}
       THEN 1.0 ELSE 0.0 END), 1.0) - 1 AS INTEGER) AS hot, 96 AS width FROM events""")
def t7_time_onehot(t):
    """Dense one-hot of width 24*res (res 4): position of the 1 and width."""
    oh = TOD.time_of_day_onehot(F.col("ts"), 4)
    return t.events.select("event_id", (F.array_position(oh, 1.0) - 1).cast("int").alias("hot"),
                           F.size(oh).alias("width"))


# --- T8 / T9 --------------------------------------------------------------------------
@register("t8_urls", f"""SELECT doc_id, array_to_string({O.urls('text')}, ' ') AS urls,
  array_to_string({O.urls('text', True)}, ' ') AS hosts FROM documents""")
def t8_urls(t):
    """URLs per document, long form and host-only form."""
    return t.documents.select("doc_id", F.concat_ws(" ", T.urls(F.col("text"))).alias("urls"),
                              F.concat_ws(" ", T.urls(F.col("text"), short_url=True)).alias("hosts"))


@register("t9_strip_urls", f"SELECT doc_id, md5({O.strip_urls('text')}) AS stripped_md5 FROM documents")
def t9_strip_urls(t):
    """URLs replaced by a space (md5 of the result)."""
    return t.documents.select("doc_id", F.md5(T.strip_urls(F.col("text"))).alias("stripped_md5"))


# --- T10 - T13, F11 -----------------------------------------------------------------
@register("t10_lemma_tokens", f"""WITH {O.tokenize_ctes('documents', 'doc_id', 'text')}
SELECT doc_id, coalesce(string_agg(token, ' ' ORDER BY pos), '') AS tokens
FROM documents LEFT JOIN tk_all ON id = doc_id GROUP BY doc_id""")
def t10_lemma_tokens(t):
    """T10 (+F11, T12, T13): lemma tokens of every document, str output ('' for
    a document without one)."""
    toks = TK.collect_tokens(TK.tokenize(t.documents, "doc_id", "text"), "str")
    ids = t.documents.select(F.col("doc_id").alias("id"))
    return TK.with_all_rows(toks, ids, "str").select(F.col("id").alias("doc_id"), "tokens")


@register("t10_short_url_tokens", f"""WITH tx AS (SELECT doc_id, replace(text, ' ', ' http://') AS text
  FROM documents),
{O.tokenize_ctes('tx', 'doc_id', 'text', short_url=True)}
SELECT doc_id, coalesce(string_agg(token, ' ' ORDER BY pos), '') AS tokens FROM tx LEFT JOIN tk_all ON id = doc_id GROUP BY doc_id""")
def t10_short_url_tokens(t):
    """T10 with ``short_url``: URL hosts appended. No fixture text has a
    scheme, so the query writes 'http://' before the words, on both sides."""
    d = t.documents.select("doc_id", F.replace("text", F.lit(" "), F.lit(" http://")).alias("text"))
    toks = TK.collect_tokens(TK.tokenize(d, "doc_id", "text", short_url=True), "str")
    return TK.with_all_rows(toks, d.select(F.col("doc_id").alias("id")), "str").select(F.col("id").alias("doc_id"), "tokens")


@register("t11_pass_through", f"""SELECT conv_id, turn,
  len(list_filter(regexp_split_to_array(text, '[{T.PY_SPACE}]+'), lambda x: x <> '')) AS n_tokens,
  array_to_string(list_filter(regexp_split_to_array(text, '[{T.PY_SPACE}]+'), lambda x: x <> ''), ' ') AS tokens
FROM conversations""")
def t11_pass_through(t):
    """Pass-through tokenising (whitespace split, no URLs appended)."""
    tk = T.whitespace_tokens(F.col("text"))
    return t.conversations.select("conv_id", "turn", F.size(tk).cast("bigint").alias("n_tokens"),
                                  F.concat_ws(" ", tk).alias("tokens"))


@register("t12_lemma_table", f"""WITH {O.tokenize_ctes('documents', 'doc_id', 'text')}
SELECT token, lemma FROM tk_lemmas""")
def t12_lemma_table(t):
    """Noun lemma table of the corpus vocabulary (tokens whose lemma differs)."""
    words = t.documents.select(F.explode(TK.content_tokens(F.col("text"))).alias("token"))
    return TK.lemma_table(words)


@register("t13_stop_words", f"""SELECT doc_id,
  len(list_filter(regexp_extract_all(text, '[{T.PY_WORD}]+'), lambda x: list_contains({O.sql_list(ENGLISH_STOP_WORDS)}, x))) AS n_stop,
  len(regexp_extract_all(text, '[{T.PY_WORD}]+')) AS n_words FROM documents""")
def t13_stop_words(t):
    """Stop words per document (case-sensitive), duplicates kept."""
    w = F.regexp_extract_all("text", F.lit(f"[{T.PY_WORD}]+"), F.lit(0))
    return t.documents.select("doc_id", F.size(F.filter(w, lambda x: x.isin(ENGLISH_STOP_WORDS))).cast("bigint")
                              .alias("n_stop"), F.size(w).cast("bigint").alias("n_words"))


# --- T15 ------------------------------------------------------------------------------
@register("t15_token_count_map", f"""SELECT conv_id, turn, token, count(*) AS n FROM (
  SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(text, '[{T.PY_SPACE}]+'), lambda x: x <> '')) AS token
  FROM conversations) GROUP BY ALL""")
def t15_token_count_map(t):
    """T15 dict output: token -> count map per turn (sort-and-run-length, no
    shuffle), shown exploded."""
    m = T.as_output(T.whitespace_tokens(F.col("text")), "dict")
    return t.conversations.select("conv_id", "turn", F.explode(m).alias("token", "n"))


# --- T16 / F8 / F9 -----------------------------------------------------------------------
@register("t16_json_path", """SELECT event_id, CAST(props->>'k' AS INTEGER) AS k, props->>'missing' AS missing
FROM events WHERE props->>'k' IS NOT NULL""")
def t16_json_path(t):
    """T16 + F8: JSON path text and a not-null filter on it."""
    k = T.json_text(F.col("props"), "k")
    return t.events.where(k.isNotNull()).select("event_id", k.cast("int").alias("k"),
                                                T.json_text(F.col("props"), "missing").alias("missing"))


@register("f9_field_extract", """SELECT doc_id, text AS f0, lang AS f1, n_chars AS f2 FROM documents""")
def f9_field_extract(t):
    """field extract by key / position from a struct sample."""
    smp = t.documents.select("doc_id", F.struct("text", "lang", "n_chars").alias("sample"))
    return smp.select("doc_id", F.col("sample")["text"].alias("f0"), F.col("sample")["lang"].alias("f1"),
                      F.col("sample")["n_chars"].alias("f2"))


# --- T17 -------------------------------------------------------------------------------------
@register("t17_lines", f"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no,
  regexp_replace(parts[i], '^[{T.PY_SPACE}]+|[{T.PY_SPACE}]+$', '', 'g') AS line
FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
     unnest(generate_series(1, len(parts))) g(i)""")
def t17_lines(t):
    """One row per stripped line."""
    return t.documents.select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("line_no", "line"))


# --- T18 -------------------------------------------------------------------------------------
# Named entities and their characters, spelled apart from the operator's table.
_NAMED_SQL = [("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&apos;", "chr(39)"), ("&nbsp;", "chr(160)"),
              ("&copy;", "chr(169)"), ("&middot;", "chr(183)"), ("&hellip;", "chr(8230)"), ("&ndash;", "chr(8211)"),
              ("&mdash;", "chr(8212)"), ("&laquo;", "chr(171)"), ("&raquo;", "chr(187)"), ("&euro;", "chr(8364)"), ("&amp;", "'&'")]
_REFS_SQL = [("&#64;", 64), ("&#xe9;", 0xE9), ("&#X20AC;", 0x20AC), ("&#128512;", 128512), ("&#39;", 39)]
_WRITTEN = "&#xe9;&#X20AC;&hellip; &#128512;&#39;&#0;&nope;"


def _unescape_sql(x: str) -> str:
    for ref, code in _REFS_SQL:
        x = f"replace({x}, '{ref}', chr({code}))"
    x = f"replace({x}, '&#0;', '')"
    for name, char in _NAMED_SQL:
        x = f"replace({x}, '{name}', {char})"
    return x


@register("t18_html_unescape", f"""WITH h AS (SELECT page_id, concat(html, ' &#64;&amp;#64; ', url, '{_WRITTEN}') AS t FROM pages),
u AS (SELECT page_id, {_unescape_sql('t')} AS u FROM h)
SELECT page_id, md5(u) AS html_md5, length(u) AS n_chars FROM u""")
def t18_html_unescape(t):
    """HTML unescape of whole pages, numeric and named references, md5 +
    length. The pages have no numeric ones, so the query appends some."""
    u = T.html_unescape(F.concat("html", F.lit(" &#64;&amp;#64; "), "url", F.lit(_WRITTEN)))
    return t.pages.select("page_id", F.md5(u).alias("html_md5"), F.char_length(u).cast("bigint").alias("n_chars"))


# --- T19 / T20 ----------------------------------------------------------------------------------
@register("t19_trim80", """SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 77) || '...' ELSE text END AS short
FROM documents""")
def t19_trim80(t):
    """Trim to 80 columns."""
    return t.documents.select("doc_id", T.trim80(F.col("text")).alias("short"))


@register("t20_strip_header", """WITH m AS (
  SELECT conv_id, turn, concat('Subject: x', chr(10), CASE WHEN turn % 3 <> 1 THEN chr(10) END, text, chr(10), chr(10), 'end') AS t
  FROM conversations)
SELECT conv_id, turn, md5(CASE WHEN strpos(t, chr(10) || chr(10)) > 0 THEN substr(t, strpos(t, chr(10) || chr(10)) + 2) ELSE '' END)
  AS body_md5 FROM m""")
def t20_strip_header(t):
    """What follows the first blank line; the query puts a header with and
    without one before the texts, on both sides."""
    blank = F.when(F.col("turn") % 3 != 1, F.lit("\n")).otherwise(F.lit(""))
    text = F.concat(F.lit("Subject: x\n"), blank, "text", F.lit("\n\nend"))
    return t.conversations.select("conv_id", "turn", F.md5(T.strip_header(text)).alias("body_md5"))


# --- T21 ------------------------------------------------------------------------------------------
@register("t21_strip_accents", "SELECT doc_id, md5(strip_accents(text)) AS folded_md5 FROM documents")
def t21_strip_accents(t):
    """Accent stripping (Latin letters folded to their base letter)."""
    return t.documents.select("doc_id", F.md5(T.strip_accents(F.col("text"))).alias("folded_md5"))


# --- T22 -------------------------------------------------------------------------------------------
@register("t22_word_ngrams", f"""WITH w AS (
  SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[{T.PY_SPACE}]+'), lambda x: x <> '') AS ws
  FROM conversations),
g AS (
  SELECT conv_id, turn, list_concat(ws,
    list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1]),
    list_transform(generate_series(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS grams
  FROM w)
SELECT conv_id, turn, len(grams) AS n_grams, md5(array_to_string(grams, '|')) AS grams_md5 FROM g""")
def t22_word_ngrams(t):
    """Word n-grams (1..3) of every turn; count and md5 of the list."""
    ws = T.whitespace_tokens(F.lower("text"))
    g = T.word_ngrams(ws, 1, 3)
    return t.conversations.select("conv_id", "turn", F.size(g).cast("bigint").alias("n_grams"),
                                  F.md5(F.array_join(g, "|")).alias("grams_md5"))


# --- T23 -------------------------------------------------------------------------------------------
@register("t23_char_windows", """SELECT item_id, CAST(i AS INTEGER) AS start,
  substr(text, i + 1, 25) AS "window", substr(text, i + 26, 1) AS next_char
FROM benchmark, unnest(generate_series(0, length(text) - 25 - 1, 3)) g(i)""")
def t23_char_windows(t):
    """Semi-redundant 25-char windows every 3 chars with the next char."""
    w = T.char_windows(F.col("text"), 25, 3)
    ex = t.benchmark.select("item_id", F.posexplode(w).alias("k", "w"))
    return ex.select("item_id", (F.col("k") * 3).cast("int").alias("start"), F.col("w.window").alias("window"),
                     F.col("w.next_char").alias("next_char"))


# --- T25 / T26 / T27 ----------------------------------------------------------------------------------
@register("t25_position_xy", """SELECT vec_id, pos, CAST(pos % 128 AS INTEGER) AS x, CAST(pos // 128 AS INTEGER) AS y
FROM v_retina_pos""", ("v_retina_pos",))
def t25_position_xy(t):
    """Fingerprint position -> (x, y) on the 128 x 128 grid."""
    p = t.views.retina_pos()
    x, y = T.position_xy(F.col("pos"))
    return p.select("vec_id", "pos", x.alias("x"), y.alias("y"))


_CLASSES = ["de", "en", "es", "fr"]


@register("t26_multi_hot", f"""WITH c AS (SELECT article, list(category) AS cats FROM v_categories GROUP BY article)
SELECT article, array_to_string(list_transform({O.sql_list(_CLASSES)}, lambda k: CAST(list_contains(cats, k) AS INTEGER)), '')
  AS bits FROM c""", ("v_categories",))
def t26_multi_hot(t):
    """Multi-label binariser over the language classes."""
    c = t.views.categories().groupBy("article").agg(F.collect_list("category").alias("cats"))
    return c.select("article", F.array_join(T.multi_hot(F.col("cats"), _CLASSES).cast("array<string>"), "")
                    .alias("bits"))


@register("t27_argmax_argsort", """SELECT vec_id,
  CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS argmax,
  array_to_string(list_transform(list_slice(list_grade_up(embedding, 'DESC'), 1, 3), lambda i: i - 1), ',') AS top3
FROM embeddings""")
def t27_argmax_argsort(t):
    """Argmax and top-3 argsort of each embedding."""
    e = t.embeddings
    idx = F.sequence(F.lit(0), F.size("embedding") - 1)
    pairs = F.transform(idx, lambda i: F.struct((-F.element_at("embedding", i + 1)).alias("v"), i.alias("i")))
    order = F.transform(F.array_sort(pairs), lambda p: p["i"])
    return e.select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).cast("int").alias("argmax"),
                    F.array_join(F.slice(order, 1, 3), ",").alias("top3"))

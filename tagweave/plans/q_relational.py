"""Registered queries: filters, joins and aggregates around the tagger
(S3, S9, S10, S14, F1-F3, F8, F10, F14, J4, J6, J7, G11, G12, W5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.functions import text as T
from tagweave.operators import legacy as LG
from tagweave.operators import sampling as S
from tagweave.plans.registry import register


@register("s3_legacy_samples", """
WITH tagged AS (SELECT comment_id AS id, tag FROM v_user_tag_comment WHERE tag IN ('good', 'bad') AND user_id = 1),
rows AS (
  SELECT c.id, c.data->>'message' AS message, t.tag
  FROM v_legacy_comments c LEFT JOIN tagged t ON c.id = t.id
  WHERE c.meta->>'fingerprint' IS NOT NULL AND c.meta->>'lang' = 'en' AND c.meta->>'page' IN ('page1')),
codes AS (SELECT tag, CAST(row_number() OVER (ORDER BY min(id), tag) - 1 AS INTEGER) AS label
          FROM rows WHERE tag IS NOT NULL GROUP BY tag)
SELECT r.id, r.message, r.tag, CAST(coalesce(c.label, -1) AS INTEGER) AS label
FROM rows r LEFT JOIN codes c ON r.tag = c.tag""", ("v_user_tag_comment", "v_legacy_comments"))
def s3_legacy_samples(t):
    """S3 (J6, F8): legacy sample fetch with first-seen tag codes."""
    v = t.views
    return LG.legacy_samples(v.legacy_comments(), v.user_tag_comment(), ["good", "bad"], 1, ["page1"])


@register("j7_g11_user_tagsets", """WITH tags AS (
  SELECT tagset_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM (SELECT DISTINCT tagset_id, tag FROM v_tagset_tags) GROUP BY tagset_id)
SELECT user_id, tagset_id, tags FROM v_user_tagset JOIN tags USING (tagset_id)""",
          ("v_tagset_tags", "v_user_tagset"))
def j7_g11_user_tagsets(t):
    """J7 + G11: every user's tagsets and the tags seen in each (stand-in: a
    customer's order statuses and the priorities seen with them)."""
    u = LG.user_tagsets(t.views.tagset_tags(), t.views.user_tagset())
    return u.select("user_id", "tagset_id", F.array_join("tags", ",").alias("tags"))


@register("g11_tags_in_tagset", """SELECT tt.tagset_id, array_to_string(list_sort(list(DISTINCT tg.tag_id::VARCHAR)), ',') AS tags,
  count(*) AS n_taggings
FROM v_tagging tg JOIN v_tag_tagset tt ON tg.tag_id = tt.tag_id GROUP BY tt.tagset_id""", ("v_tagging", "v_tag_tagset"))
def g11_tags_in_tagset(t):
    """Tags seen in each tagset (set) and taggings per tagset."""
    v = t.views
    j = v.tagging().join(F.broadcast(v.tag_tagset()), "tag_id")
    return j.groupBy("tagset_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.col("tag_id").cast("string"))), ",").alias("tags"),
        F.count(F.lit(1)).alias("n_taggings"))


@register("f14_access_violations", """
WITH users AS (SELECT DISTINCT user_id FROM v_grants),
req AS (SELECT u.user_id, CAST(s.range AS INTEGER) AS source_id FROM users u, range(10) s)
SELECT r.user_id, r.source_id FROM req r ANTI JOIN v_grants g ON r.user_id = g.user_id AND r.source_id = g.source_id""",
          ("v_grants",))
def f14_access_violations(t):
    """for every user, requested sources 0-9 that the user may not read
    (empty result = access ok)."""
    g = t.views.grants()
    users = g.select("user_id").distinct()
    req = users.withColumn("source_id", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return LG.access_violations(req, g, ["user_id", "source_id"])


@register("w5_latest_model", """SELECT tagset_id, user_id, model_id, score, trained_ts FROM (
  SELECT *, row_number() OVER (PARTITION BY tagset_id, user_id ORDER BY trained_ts DESC, model_id DESC) AS rn
  FROM v_models) WHERE rn = 1""", ("v_models",))
def w5_latest_model(t):
    """Latest model per (tagset, user)."""
    return LG.latest_model(t.views.models()).select("tagset_id", "user_id", "model_id", "score", "trained_ts")


@register("s14_model_upsert", """
WITH old AS (SELECT model_id, score FROM v_models),
new AS (SELECT model_id, score + 1.0 AS score FROM v_models WHERE model_id % 3 = 0
        UNION ALL SELECT model_id + 1000000000, score FROM v_models WHERE model_id % 5 = 0)
SELECT * FROM old WHERE model_id NOT IN (SELECT model_id FROM new) UNION ALL SELECT * FROM new""", ("v_models",))
def s14_model_upsert(t):
    """Keep-latest upsert of registry rows by id (every 3rd model
    re-scored, every 5th added under a new id)."""
    m = t.views.models().select("model_id", "score")
    new = m.where(F.pmod("model_id", F.lit(3)) == 0).select("model_id", (F.col("score") + 1.0).alias("score")) \
        .unionByName(m.where(F.pmod("model_id", F.lit(5)) == 0).select(
            (F.col("model_id") + 1000000000).alias("model_id"), "score"))
    return LG.upsert_by_id(m, new, "model_id")


@register("f1_f3_filters", """SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents
WHERE lang IN ('en', 'de') AND cast(substr(source, 4) AS INTEGER) IN (0, 1, 2, 3, 4, 5, 6, 7, 8, 9)
  AND char_length(text) > 64 GROUP BY lang""")
def f1_f3_filters(t):
    """F1 + F2 + F3: language in list, source in list, text longer than 64."""
    d = t.documents.where(F.col("lang").isin("en", "de")
                          & F.substring("source", 4, 100).cast("int").isin(list(range(10)))
                          & (F.char_length("text") > 64))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").cast("bigint").alias("chars"))


@register("j4_translation_left_join", """SELECT t.id AS text_id, t.data_id, tr.translation IS NOT NULL AS translated,
  coalesce(nullif(tr.translation, ''), t.text) = t.text AS kept_original
FROM v_text t LEFT JOIN v_translation tr ON t.id = tr.text_id AND tr.target_language = 'en'""",
          ("v_text", "v_translation"))
def j4_translation_left_join(t):
    """J4 + S2 text choice: text left-joined to its English translation."""
    tx = t.views.text()
    tr = t.views.translation().where(F.col("target_language") == "en")
    j = tx.join(tr, tx.id == tr.text_id, "left")
    chosen = F.coalesce(F.nullif(tr.translation, F.lit("")), tx.text)
    return j.select(tx.id.alias("text_id"), tx.data_id, tr.translation.isNotNull().alias("translated"),
                    (chosen == tx.text).alias("kept_original"))


@register("g12_f10_fold_counts", """
WITH s AS (
  SELECT d.doc_id, CAST(coalesce(10 + l.quality, -1) AS INTEGER) AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
f AS (SELECT s.*, g.fold::INTEGER AS fold FROM s, range(3) g(fold)),
lab AS (
  SELECT *, row_number() OVER (PARTITION BY fold, label ORDER BY md5(concat('1', ':', fold::VARCHAR, ':', doc_id::VARCHAR)), doc_id) AS rn,
         count(*) OVER (PARTITION BY fold, label) AS n
  FROM f WHERE label >= 0),
roles AS (SELECT fold, doc_id, label, CASE WHEN rn <= greatest(1, floor(n * 0.75)) THEN 'train' ELSE 'test' END AS r FROM lab),
train AS (
  SELECT DISTINCT fold, doc_id, label FROM (
    SELECT fold, doc_id, label FROM f UNION ALL SELECT fold, doc_id, label FROM roles WHERE r = 'train')
  WHERE (fold, doc_id) NOT IN (SELECT fold, doc_id FROM roles WHERE r = 'test')),
x AS (SELECT fold, label, 'train' AS role FROM train UNION ALL SELECT fold, label, 'test' FROM roles WHERE r = 'test')
SELECT fold, role, count(*) AS n, count(*) FILTER (WHERE label >= 0) AS n_labelled FROM x GROUP BY fold, role""")
def g12_f10_fold_counts(t):
    """G12 + F10: sample counts per fold and role, and labelled rows among them."""
    d = t.documents.select("doc_id")
    lab = t.labels.select("doc_id", (F.lit(10) + F.col("quality")).alias("q"))
    s = d.join(lab, "doc_id", "left").select("doc_id", F.coalesce("q", F.lit(-1)).cast("int").alias("label"))
    f = S.seeded_folds(s, "doc_id", "label", n_folds=3, seed=1)
    return f.groupBy(F.col("fold").cast("int").alias("fold"), "role").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("label") >= 0, 1)).alias("n_labelled"))


_LF, _WS = "chr(10)", "' ' || chr(9) || chr(10) || chr(13)"


@register("s9_labelled_corpus", f"""WITH c AS (
  SELECT doc_id, category, subset, concat('From: x', {_LF}, CASE WHEN doc_id % 2 = 0 THEN {_LF} END,
    replace(replace(text, ',', {_LF} || '> '), ' de ', {_LF} || 'Ann says: hi' || {_LF}),
    CASE WHEN doc_id % 3 = 0 THEN {_LF} || '--' || {_LF} || 'Bob' END) AS t
  FROM v_corpus WHERE category IN ('de', 'fr') AND subset = 'train'),
h AS (SELECT *, strpos(t, {_LF} || {_LF}) AS p FROM c),
a AS (SELECT *, CASE WHEN p > 0 THEN substr(t, p + 2) ELSE '' END AS a FROM h),
f AS (SELECT *, string_split(trim(a, {_WS}), {_LF}) AS ls FROM a),
k AS (SELECT *, coalesce(list_max(list_transform(generate_series(1, len(ls)),
        lambda i: CASE WHEN replace(trim(ls[i], {_WS}), '-', '') = '' THEN i - 1 END)), 0) AS cut FROM f),
b AS (SELECT *, string_split(CASE WHEN cut > 0 THEN array_to_string(ls[1:cut], {_LF}) ELSE a END, {_LF}) AS body FROM k)
SELECT doc_id, category, subset, md5(array_to_string(list_filter(body, lambda l: NOT (
  left(l, 1) IN ('>', '|') OR starts_with(l, 'In article') OR starts_with(l, 'Quoted from') OR contains(l, 'writes in')
  OR contains(l, 'writes:') OR contains(l, 'wrote:') OR contains(l, 'says:') OR contains(l, 'said:'))), {_LF})) AS body_md5
FROM b""", ("v_corpus",))
def s9_labelled_corpus(t):
    """S9 (+T20): labelled corpus, category filter, train subset, headers,
    footers and quoted lines removed. The query writes such lines into the texts,
    which have none, on both sides."""
    c = t.views.corpus().where(F.col("category").isin("de", "fr") & (F.col("subset") == "train"))
    blank = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.lit("\n")).otherwise(F.lit(""))
    foot = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.lit("\n--\nBob")).otherwise(F.lit(""))
    quoted = F.replace(F.replace("text", F.lit(","), F.lit("\n> ")), F.lit(" de "), F.lit("\nAnn says: hi\n"))
    text = F.concat(F.lit("From: x\n"), blank, quoted, foot)
    body = T.strip_quotes(T.strip_footer(T.strip_header(text)))
    return c.select("doc_id", "category", "subset", F.md5(body).alias("body_md5"))


@register("s10_corpus_stats", """SELECT subset, count(*) AS n_docs, round(sum(strlen(text)) / 1e6, 6) AS size_mb,
  count(DISTINCT category) AS n_classes FROM v_corpus GROUP BY subset""", ("v_corpus",))
def s10_corpus_stats(t):
    """S10 (+V18 shape): documents, UTF-8 megabytes and classes per subset."""
    return t.views.corpus().groupBy("subset").agg(
        F.count(F.lit(1)).alias("n_docs"), F.round(F.sum(F.octet_length("text")) / 1e6, 6).alias("size_mb"),
        F.count_distinct("category").alias("n_classes"))

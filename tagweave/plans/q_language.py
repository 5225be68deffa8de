"""Registered queries: language identification, language filters and
translation routing (T14, F7, M26, J15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.functions.hashing import hash01
from tagweave.functions.text import PY_SPACE
from tagweave.operators import language as LG
from tagweave.plans.oracle_views import h01
from tagweave.plans.registry import register

_LID_SQL = f"""docs AS (SELECT doc_id, lang, text, CASE WHEN {h01(11, 0, 'doc_id')} < 0.75 THEN 1 ELSE 0 END AS is_train
         FROM documents),
cl AS (SELECT doc_id, lang, is_train, length(trim(coalesce(text, ''))) > 0 AS nonempty,
  ' ' || trim(regexp_replace(lower(regexp_replace(text, '[\\x{{7f}}\\x{{08}}]', '', 'g')), '[{PY_SPACE}]+', ' ', 'g')) || ' ' AS c
  FROM docs),
g AS (SELECT doc_id, lang, is_train, unnest(list_transform(generate_series(1, length(c) - 2), lambda i: substr(c, i, 3))) AS gram
      FROM cl WHERE nonempty),
cnt AS (SELECT doc_id, gram, count(*) AS cnt FROM g GROUP BY ALL),
tr AS (SELECT gram, lang, count(*) AS c FROM g WHERE is_train = 1 GROUP BY ALL),
vocab AS (SELECT count(DISTINCT gram) AS v FROM tr),
nl AS (SELECT lang, sum(c) AS n FROM tr GROUP BY lang),
langs AS (SELECT lang, count(*) / (SELECT count(*) FROM docs WHERE is_train = 1) AS prior FROM docs WHERE is_train = 1
          GROUP BY lang),
model AS (SELECT v.gram, l.lang, ln((coalesce(t.c, 0) + 1.0) / (nl.n + (SELECT v FROM vocab))) AS lp
          FROM (SELECT DISTINCT gram FROM tr) v CROSS JOIN langs l LEFT JOIN tr t ON t.gram = v.gram AND t.lang = l.lang
          JOIN nl ON nl.lang = l.lang),
sc AS (SELECT c.doc_id, m.lang, sum(c.cnt * m.lp) AS s FROM cnt c JOIN model m USING (gram) GROUP BY ALL),
best AS (SELECT doc_id, lang FROM (
  SELECT sc.doc_id, sc.lang, row_number() OVER (PARTITION BY sc.doc_id ORDER BY sc.s + ln(l.prior) DESC, sc.lang) AS rn
  FROM sc JOIN langs l USING (lang)) WHERE rn = 1),
detected AS (SELECT d.doc_id, coalesce(b.lang, 'un') AS lang_id FROM documents d LEFT JOIN best b USING (doc_id))"""


def detected(t):
    d = t.documents
    train = d.where(hash01(11, 0, F.col("doc_id")) < 0.75)
    model = LG.fit(train, "doc_id", "text", "lang")
    return LG.detect(d, "doc_id", "text", model)


@register("t14_language_id", f"WITH {_LID_SQL} SELECT doc_id, lang_id FROM detected")
def t14_language_id(t):
    """Language of every whole document by a character-trigram naive
    Bayes trained on a 75 % hash split of documents.lang."""
    return detected(t)


@register("t14_language_accuracy", f"""WITH {_LID_SQL}
SELECT d.is_train, count(*) AS n, CAST(sum(CASE WHEN x.lang_id = d.lang THEN 1 ELSE 0 END) AS BIGINT) AS n_right
FROM detected x JOIN docs d USING (doc_id) GROUP BY d.is_train""")
def t14_language_accuracy(t):
    """T14 quality: right detections on the training and held-out documents."""
    d = t.documents.select("doc_id", "lang", F.when(hash01(11, 0, F.col("doc_id")) < 0.75, 1).otherwise(0)
                           .alias("is_train"))
    j = detected(t).join(d, "doc_id")
    return j.groupBy("is_train").agg(F.count(F.lit(1)).alias("n"),
                                     F.sum((F.col("lang_id") == F.col("lang")).cast("int")).cast("bigint").alias("n_right"))


@register("f7_english_german_only", f"""WITH {_LID_SQL}
SELECT x.lang_id, d.source, count(*) AS n FROM detected x JOIN documents d USING (doc_id)
WHERE x.lang_id IN ('en', 'de') GROUP BY ALL""")
def f7_english_german_only(t):
    """is_english / is_german filters on the detected language (counts by source)."""
    det = detected(t)
    d = t.documents.select("doc_id", "source")
    en = LG.only(d, det, "doc_id", "en").withColumn("lang_id", F.lit("en"))
    de = LG.only(d, det, "doc_id", "de").withColumn("lang_id", F.lit("de"))
    return en.unionByName(de).groupBy("lang_id", "source").agg(F.count(F.lit(1)).alias("n"))


@register("m26_translate_routing", f"""WITH {_LID_SQL},
mem AS (SELECT text_id - 1000000 AS doc_id, translation FROM v_translation WHERE target_language = 'en')
SELECT x.doc_id, x.lang_id,
  CASE WHEN x.lang_id = 'en' THEN md5(d.text) WHEN x.lang_id IN ('de', 'es') THEN md5(m.translation) END AS translated_md5
FROM detected x JOIN documents d USING (doc_id) LEFT JOIN mem m USING (doc_id)""", ("v_translation",))
def m26_translate_routing(t):
    """M26 + J15: translate every document to English by routing on the
    detected language — English as is, German / Spanish from the translation
    memory (joined by id; null when missing), other languages null."""
    det = detected(t)
    texts = t.documents.select("doc_id", "text").join(det, "doc_id")
    mem = t.views.translation().select((F.col("text_id") - 1000000).alias("id"), "target_language", "translation")
    r = LG.route_translations(texts, "doc_id", "lang_id", mem)
    return r.select("doc_id", "lang_id", F.md5("translated").alias("translated_md5"))

"""Registered queries: feature vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.functions import fingerprint as FP
from tagweave.functions import text as T
from tagweave.functions import timeofday as TOD
from tagweave.operators import vectors as V
from tagweave.operators.range_svd import randomized_svd
from tagweave.plans.oracle_views import fingerprint_sql, h32, murmur3_sql
from tagweave.plans.registry import register
from tagweave.plans.q_sampling import S1_SQL, flagship_sample
from tagweave.operators import sampling as S
from tagweave.session import stored

WORD = r"[\p{L}\p{N}_]+"


def word_tokens(text):
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def conv_docs(t):
    """Conversation turns as documents: id = '<conv_id>_<turn>'."""
    c = t.conversations
    return c.select(F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text", "role")


_CONV_TF = f"""toks AS (SELECT concat_ws('_', conv_id, turn) AS id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term
                FROM conversations),
tf AS (SELECT id, term, count(*) AS tf FROM toks GROUP BY ALL),
n AS (SELECT count(*) AS n FROM conversations)"""


def _conv_tf(t):
    d = conv_docs(t).select("id", word_tokens(F.col("text")).alias("tokens"))
    return V.term_counts(d, "id", "tokens")


@register("v1_hashed_counts", f"""SELECT id, CAST({h32('tok')} % 200 AS INTEGER) AS term, count(*) AS tf FROM (
  SELECT concat_ws('_', conv_id, turn) AS id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS tok FROM conversations)
GROUP BY ALL""")
def v1_hashed_counts(t):
    """V1: hashed token counts, 200 buckets (md5 bucket)."""
    d = conv_docs(t).select("id", word_tokens(F.col("text")).alias("tokens"))
    return V.hashed_counts(d, "id", "tokens", 200)


@register("v1_signed_hashing", f"""WITH toks AS (SELECT concat_ws('_', conv_id, turn) AS id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS tok
  FROM conversations),
words AS (SELECT tok, h FROM (SELECT DISTINCT tok FROM toks) d, LATERAL (SELECT {murmur3_sql('d.tok')} AS h)),
sums AS (SELECT id, CAST(abs(h) % 200 AS INTEGER) AS term, sum(CASE WHEN h >= 0 THEN 1 ELSE -1 END) AS s FROM toks JOIN words USING (tok) GROUP BY ALL)
SELECT id, term, CAST(abs(s) AS BIGINT) AS tf FROM sums WHERE s <> 0""")
def v1_signed_hashing(t):
    """V1: signed feature hashing (MurmurHash3, sign by its top bit, absolute value
    of the sums), 200 buckets as the reference's token block has."""
    d = conv_docs(t).select("id", word_tokens(F.col("text")).alias("tokens"))
    return V.signed_hashed_counts(d, "id", "tokens", 200)


@register("v3_count_vectorizer", f"""WITH {_CONV_TF},
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
kept AS (SELECT term FROM df, n WHERE df >= 2 AND df <= 0.5 * n.n),
voc AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS "index" FROM kept)
SELECT tf.id, voc."index", tf.tf FROM tf JOIN voc ON tf.term = voc.term""")
def v3_count_vectorizer(t):
    """V3 + V10: count vectoriser with min_df=2 (count), max_df=0.5 (share);
    vocabulary indexes in term order."""
    tf = _conv_tf(t)
    n = t.conversations.select(F.count(F.lit(1))).scalar()
    kept = V.filter_df(tf, n, min_df=2, max_df=0.5)
    voc = V.vocabulary(kept)
    return kept.join(voc, "term").select("id", "index", "tf")


@register("v4_tfidf", f"""WITH {_CONV_TF},
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
x AS (SELECT tf.id, tf.term, tf.tf * (ln((n.n + 1.0) / (df.df + 1.0)) + 1.0) AS v FROM tf JOIN df USING (term), n),
nrm AS (SELECT id, sqrt(sum(v * v)) AS nrm FROM x GROUP BY id)
SELECT x.id, x.term, round(x.v / nrm.nrm, 6) AS value FROM x JOIN nrm USING (id)""")
def v4_tfidf(t):
    """V4 + V11: smooth TF-IDF, L2-normalised."""
    tf = _conv_tf(t)
    n = t.conversations.select(F.count(F.lit(1))).scalar()
    x = V.tfidf(tf, V.idf_table(tf, n))
    return x.select("id", "term", F.round("value", 6).alias("value"))


@register("v6_tfidf_min3_max95", f"""WITH {_CONV_TF},
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
x AS (SELECT tf.id, tf.term, tf.tf * (ln((n.n + 1.0) / (df.df + 1.0)) + 1.0) AS v FROM tf JOIN df USING (term), n
      WHERE df.df >= 3 AND df.df <= 0.95 * n.n),
nrm AS (SELECT id, sqrt(sum(v * v)) AS nrm FROM x GROUP BY id)
SELECT x.id, x.term, round(x.v / nrm.nrm, 6) AS value FROM x JOIN nrm USING (id)""")
def v6_tfidf_min3_max95(t):
    """V6: TF-IDF of the terms that 3 texts at least and 95 % at most have."""
    tf = _conv_tf(t)
    n = t.conversations.select(F.count(F.lit(1))).scalar()
    kept = V.filter_df(tf, n, min_df=3, max_df=0.95)
    x = V.tfidf(kept, V.idf_table(kept, n))
    return x.select("id", "term", F.round("value", 6).alias("value"))


@register("v5_sublinear_tfidf", f"""WITH {_CONV_TF},
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
x AS (SELECT tf.id, tf.term, (1.0 + ln(tf.tf)) * (ln((n.n + 1.0) / (df.df + 1.0)) + 1.0) AS v
      FROM tf JOIN df USING (term), n)
SELECT id, term, round(v, 6) AS value FROM x""")
def v5_sublinear_tfidf(t):
    """V5: sub-linear tf (1 + ln tf) times smooth idf, unnormalised."""
    tf = _conv_tf(t)
    n = t.conversations.select(F.count(F.lit(1))).scalar()
    x = V.tfidf(tf, V.idf_table(tf, n), sublinear=True, norm=None)
    return x.select("id", "term", F.round("value", 6).alias("value"))


_DOC_HASH_TFIDF = f"""toks AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS tok FROM documents),
tf AS (SELECT id, CAST({h32('tok')} % 200 AS INTEGER) AS term, count(*) AS tf FROM toks GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
x0 AS (SELECT tf.id, tf.term, tf.tf * (ln((n.n + 1.0) / (df.df + 1.0)) + 1.0) AS v FROM tf JOIN df USING (term), n),
nrm AS (SELECT id, sqrt(sum(v * v)) AS nrm FROM x0 GROUP BY id),
x AS (SELECT x0.id, x0.term, x0.v / nrm.nrm AS value FROM x0 JOIN nrm USING (id))"""


def doc_hash_tfidf(t, width=200):
    d = t.documents.select(F.col("doc_id").alias("id"), word_tokens(F.col("text")).alias("tokens"))
    tf = stored(V.hashed_counts(d, "id", "tokens", width))
    n = t.documents.select(F.count(F.lit(1))).scalar()
    return V.tfidf(tf, V.idf_table(tf, n), idf_rows_bound=width)


@register("v9_chi2", f"""WITH {_DOC_HASH_TFIDF},
lab AS (SELECT doc_id AS id, quality AS c FROM labels),
nl AS (SELECT count(*) AS n FROM lab),
share AS (SELECT c, count(*) / (SELECT n FROM nl) AS p FROM lab GROUP BY c),
xl AS (SELECT x.* FROM x SEMI JOIN lab ON x.id = lab.id),
obs AS (SELECT lab.c, xl.term, sum(xl.value) AS o FROM xl JOIN lab ON xl.id = lab.id GROUP BY ALL),
tot AS (SELECT term, sum(value) AS t FROM xl GROUP BY term),
exp AS (SELECT s.c, tot.term, s.p * tot.t AS e FROM share s, tot),
j AS (SELECT e.term, e.c, coalesce(o.o, 0.0) AS o, e.e FROM exp e LEFT JOIN obs o ON e.term = o.term AND e.c = o.c)
SELECT term, round(sum((o - e) * (o - e) / e), 6) AS chi2 FROM j GROUP BY term""")
def v9_chi2(t):
    """V9: chi-squared of hashed TF-IDF features vs quality on labelled docs
    (the oracle uses the textbook full grid; ours only observed pairs)."""
    x = doc_hash_tfidf(t)
    lab = t.labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    xl = x.join(lab.select("id"), "id", "left_semi")
    return V.chi2(xl, lab).select("term", F.round("chi2", 6).alias("chi2"))


@register("v9_select_k_best", f"""WITH {_DOC_HASH_TFIDF},
lab AS (SELECT doc_id AS id, quality AS c FROM labels),
nl AS (SELECT count(*) AS n FROM lab),
share AS (SELECT c, count(*) / (SELECT n FROM nl) AS p FROM lab GROUP BY c),
xl AS (SELECT x.* FROM x SEMI JOIN lab ON x.id = lab.id),
obs AS (SELECT lab.c, xl.term, sum(xl.value) AS o FROM xl JOIN lab ON xl.id = lab.id GROUP BY ALL),
tot AS (SELECT term, sum(value) AS t FROM xl GROUP BY term),
exp AS (SELECT s.c, tot.term, s.p * tot.t AS e FROM share s, tot),
j AS (SELECT e.term, e.c, coalesce(o.o, 0.0) AS o, e.e FROM exp e LEFT JOIN obs o ON e.term = o.term AND e.c = o.c),
chi AS (SELECT term, sum((o - e) * (o - e) / e) AS chi2 FROM j GROUP BY term),
best AS (SELECT term FROM chi ORDER BY round(chi2, 9) DESC, term LIMIT 10)
SELECT xl.id, xl.term, round(xl.value, 6) AS value FROM xl SEMI JOIN best ON xl.term = best.term""")
def v9_select_k_best(t):
    """V9 + V10: keep the 10 best chi-squared features of each labelled doc."""
    x = doc_hash_tfidf(t)
    lab = t.labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    xl = x.join(lab.select("id"), "id", "left_semi")
    scores = V.chi2(xl, lab).select("term", F.round("chi2", 9).alias("chi2"))
    return V.select_k_best(xl, scores, 10).select("id", "term", F.round("value", 6).alias("value"))


@register("v7_gram_matrix", f"""WITH {_DOC_HASH_TFIDF}
SELECT a.term AS i, b.term AS j, round(sum(a.value * b.value), 6) AS g FROM x a JOIN x b ON a.id = b.id GROUP BY ALL""")
def v7_gram_matrix(t):
    """V7 fit step: Gram matrix X^T X of the 200-wide hashed TF-IDF block."""
    g = V.gram_matrix(doc_hash_tfidf(t))
    return g.select("i", "j", F.round("g", 6).alias("g"))


@register("v7_truncated_svd")
def v7_truncated_svd(t):
    """V7: truncated SVD (no centring) of the hashed TF-IDF block to 20
    components: (id, component, value) = X V. Checked by properties in tests
    (orthonormal basis, error falls with k)."""
    x, _ = V.truncated_svd(doc_hash_tfidf(t), 200, 20)
    return x.select("id", "term", F.round("value", 6).alias("value"))


@register("v7_randomized_svd")
def v7_randomized_svd(t):
    """V7: randomised truncated SVD (range finder, 5 power iterations) of the hashed
    TF-IDF block to 20 components: (id, component, value) = X V. Tested against the
    exact SVD."""
    x, _, _ = randomized_svd(doc_hash_tfidf(t), 200, 20)
    return x.select("id", "term", F.round("value", 6).alias("value"))


@register("v12_feature_union", f"""WITH {_DOC_HASH_TFIDF},
p AS (SELECT doc_id AS id, CAST({h32('tok')} % 20 AS INTEGER) AS term, count(*) AS tf FROM (
       SELECT doc_id, unnest(regexp_extract_all(text, '{T.STRICT_PUNCTUATION.replace("'", "''")}')) AS tok FROM documents)
      GROUP BY ALL),
pn AS (SELECT id, sqrt(sum(tf * tf)) AS nrm FROM p GROUP BY id),
cap AS (SELECT doc_id AS id, len(regexp_extract_all(text, '[A-Z]')) /
        greatest(len(regexp_extract_all(text, '[A-Z]')) + len(regexp_extract_all(text, '[a-z]')), 1) AS v FROM documents)
SELECT id, term, round(0.5 * value, 6) AS value, 'tokens' AS block FROM x
UNION ALL SELECT p.id, 200 + p.term, round(0.3 * p.tf / pn.nrm, 6), 'punctuation' FROM p JOIN pn USING (id)
UNION ALL SELECT id, 220, round(0.2 * v, 6), 'capitalization' FROM cap""")
def v12_feature_union(t):
    """Weighted union of blocks: tokens (200, w .5), strict punctuation
    counts L2-normalised (20, w .3), capitalisation (1, w .2)."""
    tok = doc_hash_tfidf(t)
    d = t.documents.select(F.col("doc_id").alias("id"), T.punctuation(F.col("text")).alias("p"), "text")
    punct = V.l2_normalize(V.hashed_counts(d, "id", "p", 20).select("id", "term", F.col("tf").cast("double")
                                                                      .alias("value")))
    cap = d.select("id", F.lit(0).alias("term"), T.capitalization(F.col("text")).alias("value"))
    u = V.feature_union([("tokens", tok, 200, 0.5), ("punctuation", punct, 20, 0.3), ("capitalization", cap, 1, 0.2)])
    return u.select("id", "term", F.round("value", 6).alias("value"), "block")


@register("v15_fingerprint", f"""SELECT doc_id, array_to_string({fingerprint_sql('text')}, ',') AS fingerprint,
  len({fingerprint_sql('text')}) AS n FROM documents""")
def v15_fingerprint(t):
    """Fingerprint of every document (bottom-k MinHash of word shingles on
    the 128 x 128 grid)."""
    fp = FP.fingerprint(F.col("text"))
    return t.documents.select("doc_id", F.array_join(fp, ",").alias("fingerprint"), F.size(fp).cast("bigint").alias("n"))


@register("v13_v14_multi_hot", """SELECT vec_id, count(DISTINCT pos) AS nnz, CAST(sum(DISTINCT pos) AS BIGINT) AS pos_sum,
  CAST(min(pos) AS INTEGER) AS first_pos FROM v_retina_pos GROUP BY vec_id""", ("v_retina_pos",))
def v13_v14_multi_hot(t):
    """V14 (+V13 width check): sparse multi-hot of retina positions
    (duplicates collapse; out-of-grid positions raise)."""
    r = t.views.retina().select("vec_id", FP.sparse_fingerprint(F.col("retina")).alias("s"))
    return r.select("vec_id", F.size("s").cast("bigint").alias("nnz"),
                    F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("pos_sum"),
                    F.element_at("s", 1).alias("first_pos"))


@register("v16_dense_timeofday", """SELECT id, round(CAST(sum(v) AS DOUBLE), 6) AS total, CAST(count(*) AS BIGINT) AS width FROM (
  SELECT doc_id AS id, unnest(list_transform(generate_series(0, 23), lambda i: CASE WHEN i = (
    CAST(round_even((hour(e.ts) * 3600 + minute(e.ts) * 60 + second(e.ts)) / 60.0 / 60.0, 0) AS INTEGER) % 24)
    THEN 1.0 ELSE 0.0 END)) AS v
  FROM documents d JOIN events e ON e.event_id = d.doc_id) GROUP BY id""")
def v16_dense_timeofday(t):
    """Long one-hot time of day -> dense rows (width 24)."""
    tm = t.views.time()
    oh = tm.select(F.col("data_id").alias("id"), F.posexplode(TOD.time_of_day_onehot(F.col("time"), 1))
                   .alias("term", "value"))
    dense = V.dense_block(oh, 24)
    return dense.select("id", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
                        F.size("vector").cast("bigint").alias("width"))


@register("v18_vectorizer_shape", f"""WITH {_CONV_TF}
SELECT (SELECT count(DISTINCT id) FROM tf) AS n_samples, (SELECT count(DISTINCT term) FROM tf) AS n_features,
  (SELECT round(sum(strlen(text)) / 1e6, 6) FROM conversations) AS size_mb""")
def v18_vectorizer_shape(t):
    """Vectoriser output shape and input size."""
    return V.vectorizer_shape(_conv_tf(t), t.conversations, "text")


@register("m1_sample_vectors", f"""WITH {S1_SQL},
smp AS (SELECT id, coalesce(nullif(translation, ''), text) AS sample_text, time FROM sample),
tod AS (SELECT id, CAST(round_even((hour(time) * 3600 + minute(time) * 60 + second(time)) / 60.0 / 20.0, 0) AS INTEGER)
        % 72 AS term FROM smp),
emo AS (SELECT id, CAST({h32('tok')} % 20 AS INTEGER) AS term, count(*) AS tf FROM (
        SELECT id, unnest(regexp_extract_all(replace(sample_text, '!', '😀'), '{T.EMOJI_RUN}')) AS tok FROM smp)
        GROUP BY ALL)
SELECT id, 'timeofday' AS block, term, 1.0 AS value FROM tod
UNION ALL SELECT id, 'emoji', term, CAST(tf AS DOUBLE) FROM emo""", (
    "v_data", "v_tagging", "v_tag_tagset", "v_source", "v_language", "v_text", "v_fingerprint", "v_time",
    "v_translation"))
def m1_sample_vectors(t):
    """M1 blocks on the flagship sample: time-of-day one-hot (res 3, unit
    norm) and hashed emoji counts (20 buckets), long form."""
    smp = S.to_samples(flagship_sample(t))
    tod = smp.select("id", F.lit("timeofday").alias("block"), TOD.time_of_day(F.col("time"), 3).alias("term"),
                     F.lit(1.0).alias("value"))
    e = smp.select("id", T.emoji(F.replace("sample_text", F.lit("!"), F.lit("😀"))).alias("e"))
    emo = V.hashed_counts(e, "id", "e", 20).select("id", F.lit("emoji").alias("block"), "term",
                                                     F.col("tf").cast("double").alias("value"))
    return tod.unionByName(emo)


@register("v8_fingerprint_pca")
def v8_fingerprint_pca(t):
    """V8: centred PCA (4 components) of the 16,384-wide multi-hot retina
    fingerprints, without densifying them: projections (vec_id, comp, value)
    of every retina. Checked against numpy PCA in tests."""
    pos = stored(t.views.retina_pos().select(F.col("vec_id").alias("id"), F.col("pos").alias("term")).distinct()
                 .withColumn("value", F.lit(1.0)))
    comps, mu, _ = V.pca_sparse(pos, FP.FINGERPRINT_WIDTH, 4, rounds=10)
    basis = t.spark.createDataFrame([(int(i), int(c), float(comps[i, c])) for i in range(comps.shape[0])
                                     for c in range(comps.shape[1]) if comps[i, c] != 0.0],
                                    "term int, comp int, w double")
    shift = mu @ comps
    proj = pos.join(F.broadcast(basis), "term").groupBy("id", "comp").agg(F.sum(F.col("value") * F.col("w")).alias("xv"))
    sh = F.element_at(F.array(*[F.lit(float(s)) for s in shift]), F.col("comp") + 1)
    return proj.select(F.col("id").alias("vec_id"), "comp", F.round(F.col("xv") - sh, 6).alias("value"))

"""Registered queries: sampling, splitting, folds, set operations (S1, S2, L*, W1, W6, U*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagweave.functions.hashing import hash01, md5_order
from tagweave.operators import sampling as S
from tagweave.operators.ranking import ordered_rank
from tagweave.plans.oracle_views import h01
from tagweave.plans.registry import register

# Fixed parameters of the flagship sample (tagset 1, sources 0-9, en/de,
# 48 truths, 128 samples, seed 1).
TAGSET, SOURCES, LANGS, TRUTHS, SAMPLES, SEED = 1, list(range(10)), ["en", "de"], 48, 128, 1


# The rules of the sample, written as sets: which documents may be drawn at
# all, which of them carry a tag of the tagset, and the first k of each set in
# draw order. An id stands as often as it has tags.
def _draw_order(bag: str) -> str:
    return f"md5(concat_ws(':', '{SEED}', {bag}, id))"


def _sets_sql(bags: str, truths: int, samples: int) -> str:
    return f"""
eligible AS (
  SELECT id, language FROM v_data
  SEMI JOIN (SELECT id AS source_id FROM v_source) USING (source_id)
  JOIN (SELECT data_id AS id, language FROM v_language WHERE list_contains({LANGS!r}, language)) USING (id)
  WHERE list_contains({SOURCES!r}, source_id)),
tagset_tags AS (SELECT tag_id FROM v_tag_tagset WHERE tagset_id = {TAGSET}),
carried AS (
  SELECT data_id AS id, tag_id, language FROM v_tagging SEMI JOIN tagset_tags USING (tag_id)
  JOIN (SELECT id AS data_id, language FROM eligible) USING (data_id)),
long_texts AS (SELECT data_id AS id FROM v_text WHERE length(text) >= 65),
bags AS (SELECT unnest({bags}) AS bag_id),
truths AS (
  SELECT bag_id, id, tag_id, language FROM bags CROSS JOIN carried
  QUALIFY row_number() OVER (PARTITION BY bag_id, tag_id ORDER BY {_draw_order('bag_id')}, id) <= {truths}),
others AS (
  SELECT bag_id, id, CAST(NULL AS INTEGER) AS tag_id, language
  FROM bags CROSS JOIN (SELECT * FROM eligible JOIN long_texts USING (id) ANTI JOIN carried USING (id))
  WHERE ('0x' || left({_draw_order('bag_id')}, 8))::BIGINT < 0.3 * 4294967296
  QUALIFY row_number() OVER (PARTITION BY bag_id ORDER BY {_draw_order('bag_id')}, id, language) <= {samples}),
ids AS (FROM truths UNION ALL FROM others)"""


S1_SQL = f"""{_sets_sql('[0]', TRUTHS, SAMPLES)},
english AS (SELECT text_id, translation FROM v_translation WHERE target_language = 'en'),
texts AS (
  SELECT v_text.data_id AS id, text, translation FROM v_text LEFT JOIN english ON text_id = v_text.id),
sample AS (
  SELECT id, tag_id, language, text, time, fingerprint, translation
  FROM ids JOIN texts USING (id)
  JOIN (SELECT data_id AS id, time FROM v_time) USING (id)
  JOIN (SELECT data_id AS id, fingerprint FROM v_fingerprint) USING (id))
"""
S1_VIEWS = ("v_data", "v_tagging", "v_tag_tagset", "v_source", "v_language", "v_text",
            "v_fingerprint", "v_time", "v_translation")


def flagship_sample(t, n_bags=None):
    return S.semi_supervised_sample(t.views, TAGSET, SOURCES, LANGS, TRUTHS, SAMPLES, SEED, n_bags=n_bags)


@register("s1_sample", f"WITH {S1_SQL} SELECT id, tag_id, language, text, time, "
          "array_to_string(fingerprint, ',') AS fingerprint, translation FROM sample", S1_VIEWS)
def s1_sample(t):
    """S1 (with F1-F4, J1-J5, W1, L1, L2, U1, U5): semi-supervised sample set."""
    s = flagship_sample(t)
    return s.select("id", "tag_id", "language", "text", "time",
                    F.array_join("fingerprint", ",").alias("fingerprint"), "translation")


@register("s2_samples", f"""WITH {S1_SQL} SELECT id,
  CAST(coalesce(nullif(tag_id, 0), -1) AS INTEGER) AS label,
  coalesce(nullif(translation, ''), text) AS sample_text,
  len(fingerprint) AS fp_size, time FROM sample""", S1_VIEWS)
def s2_samples(t):
    """(label, Sample(translation or text, fingerprint, time)); -1 = untagged."""
    s = S.to_samples(flagship_sample(t))
    return s.select("id", "label", "sample_text", F.size("fingerprint").cast("bigint").alias("fp_size"), "time")


@register("s1_bag_sample_counts", f"""WITH {_sets_sql('range(100)::INTEGER[]', TRUTHS, SAMPLES)}
SELECT bag_id, CAST(coalesce(tag_id, -1) AS INTEGER) AS label, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum
FROM ids GROUP BY ALL""", ("v_data", "v_tagging", "v_tag_tagset", "v_source", "v_language", "v_text"))
def s1_bag_sample_counts(t):
    """M4 sampling: 100 bags drawn in one job (bag_id column), 48 truths per tag
    and 128 untagged per bag; rows and id sums per (bag, label)."""
    tagged = S.tagged_rows(t.views, TAGSET, SOURCES, LANGS)
    truths = S.truth_sample(tagged, TRUTHS, SEED, n_bags=100)
    randoms = S.untagged_sample(t.views, tagged, SOURCES, LANGS, SAMPLES, SEED, n_bags=100)
    ids = randoms.select("bag_id", "id", "tag_id").unionByName(truths.select("bag_id", "id", "tag_id"))
    return (ids.groupBy(F.col("bag_id").cast("int").alias("bag_id"),
                        F.coalesce("tag_id", F.lit(-1)).cast("int").alias("label"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("id").cast("bigint").alias("id_sum")))


@register("l1_bernoulli", f"SELECT id, source_id FROM v_data WHERE {h01(SEED, 0, 'id')} < 0.3", ("v_data",))
def l1_bernoulli(t):
    """L1: repeatable Bernoulli 30 % table sample."""
    return S.bernoulli(t.views.data(), "id", 0.3, SEED)


@register("l7_hash_split", f"""SELECT doc_id, lang,
  CASE WHEN {h01(42, 0, 'doc_id')} < 0.33 THEN 'test' ELSE 'train' END AS split FROM documents""")
def l7_hash_split(t):
    """train/test split 0.33, seed 42, as a hash draw."""
    return S.hash_split(t.documents.select("doc_id", "lang"), "doc_id", 0.33, 42)


@register("l13_seeded_shuffle", """SELECT doc_id, row_number() OVER (
  ORDER BY md5(concat('42', ':', '0', ':', doc_id::VARCHAR)), doc_id) AS pos FROM documents""")
def l13_seeded_shuffle(t):
    """Seeded shuffle of a corpus (position of each doc)."""
    return ordered_rank(t.documents.select("doc_id"), [], S.seeded_order(42, "doc_id"), "pos")


_SEED_SPLIT_SQL = """
WITH s AS (SELECT doc_id, CAST(10 + quality AS INTEGER) AS label FROM labels),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat('1', ':', '0', ':', doc_id::VARCHAR)), doc_id) AS rn,
             count(*) OVER (PARTITION BY label) AS n FROM s)
SELECT doc_id, label, CASE WHEN rn <= greatest(1, floor(n * 0.75)) THEN 'train' ELSE 'test' END AS seed_role FROM r"""


@register("w6_seed_split", _SEED_SPLIT_SQL)
def w6_seed_split(t):
    """Per class a random 75 % of the seeds to train (at least one)."""
    s = t.labels.select("doc_id", (F.lit(10) + F.col("quality")).cast("int").alias("label"))
    return S.seed_split(s, "doc_id", "label", seed=1).select("doc_id", "label", "seed_role")


@register("l8_seeded_folds", """
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
  WHERE (fold, doc_id) NOT IN (SELECT fold, doc_id FROM roles WHERE r = 'test'))
SELECT fold, doc_id, label, 'train' AS role FROM train
UNION ALL SELECT fold, doc_id, label, 'test' FROM roles WHERE r = 'test'""")
def l8_seeded_folds(t):
    """L8 (+W6, U2): seeded semi-supervised split x 3 folds; train = all rows
    (limit_train = -1) ∪ 75 % of each class's seeds, minus the test seeds."""
    d = t.documents.select("doc_id")
    lab = t.labels.select("doc_id", (F.lit(10) + F.col("quality")).alias("q"))
    s = d.join(lab, "doc_id", "left").select("doc_id", F.coalesce("q", F.lit(-1)).cast("int").alias("label"))
    out = S.seeded_folds(s, "doc_id", "label", n_folds=3, seed=1)
    return out.select(F.col("fold").cast("int").alias("fold"), "doc_id", "label", "role")


@register("l9_simple_seed_split", """
WITH s AS (
  SELECT d.doc_id, CAST(coalesce(10 + l.quality, -1) AS INTEGER) AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
lab AS (SELECT *, row_number() OVER (ORDER BY md5(concat('1', ':', '0', ':', doc_id::VARCHAR)), doc_id) AS rn,
               count(*) OVER () AS n FROM s WHERE label >= 0)
SELECT doc_id, label, CASE WHEN rn <= floor(n * 0.75) THEN 'train' ELSE 'test' END AS role FROM lab
UNION ALL SELECT doc_id, label, 'train' FROM s WHERE label < 0""")
def l9_simple_seed_split(t):
    """L9 (+U3): all unlabelled rows + 75 % of the seeds train; the true
    complement of the seeds test."""
    d = t.documents.select("doc_id")
    lab = t.labels.select("doc_id", (F.lit(10) + F.col("quality")).alias("q"))
    s = d.join(lab, "doc_id", "left").select("doc_id", F.coalesce("q", F.lit(-1)).cast("int").alias("label"))
    return S.simple_seed_split(s, "doc_id", "label", seed=1)


@register("l10_circular_folds", """
WITH sizes AS (
  SELECT fold, count(*) AS n, count(*) FILTER (WHERE label >= 0) AS n_truths FROM (
    SELECT d.doc_id, CAST(d.doc_id % 3 AS INTEGER) AS fold, coalesce(10 + l.quality, -1) AS label
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY fold)
SELECT a.fold AS train_fold, b.fold AS test_fold, a.n AS n_train, b.n_truths AS n_test
FROM sizes a JOIN sizes b ON b.fold = (a.fold + 1) % 3""")
def l10_circular_folds(t):
    """Circular fold pairs; fold i trains on all its rows and tests on
    the labelled rows of fold i+1. Folds here: doc_id mod 3."""
    d = t.documents.select("doc_id")
    lab = t.labels.select("doc_id", (F.lit(10) + F.col("quality")).alias("q"))
    s = d.join(lab, "doc_id", "left").select(F.pmod("doc_id", F.lit(3)).cast("int").alias("fold"),
                                             F.coalesce("q", F.lit(-1)).alias("label"))
    sizes = s.groupBy("fold").agg(F.count(F.lit(1)).alias("n"),
                                  F.count(F.when(F.col("label") >= 0, 1)).alias("n_truths"))
    pairs = S.fold_pairs(3, t.spark)
    a = sizes.select(F.col("fold").alias("train_fold"), F.col("n").alias("n_train"))
    b = sizes.select(F.col("fold").alias("test_fold"), F.col("n_truths").alias("n_test"))
    return pairs.join(a, "train_fold").join(b, "test_fold").select("train_fold", "test_fold", "n_train", "n_test")


@register("l10_ntuples", """
WITH items AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS pos, item_id FROM benchmark),
n AS (SELECT count(*) AS n FROM items),
slots AS (SELECT i.*, g.slot FROM items i, range(3) g(slot))
SELECT CAST((pos - slot + (SELECT n FROM n)) % (SELECT n FROM n) AS BIGINT) AS tuple_id,
       CAST(slot AS INTEGER) AS slot, item_id FROM slots""")
def l10_ntuples(t):
    """L10 ``ntuples(lst, 3)`` over the benchmark items in id order."""
    items = ordered_rank(t.benchmark.select("item_id"), [], ["item_id"], "pos") \
        .withColumn("pos", F.col("pos") - 1)
    out = S.circular_tuples(items, "pos", 3)
    return out.select(F.col("tuple_id").cast("bigint").alias("tuple_id"), F.col("slot").cast("int").alias("slot"),
                      "item_id")


_DRAW = "('0x' || substr(md5(concat('5', ':', model_id, '-', draw, ':', '{n}')), 1, 8))::BIGINT / 4294967296.0"


@register("l11_param_draws", f"""
SELECT model_id, CAST(draw AS INTEGER) AS draw,
  CAST(1 + floor(({_DRAW.format(n='svd_tokens')}) * (200 - 1)) AS INTEGER) AS n_components,
  CAST(2 + floor(({_DRAW.format(n='n_neighbors')}) * (15 - 2)) AS INTEGER) AS n_neighbors,
  round(-20.0 * ln(1.0 - ({_DRAW.format(n='gamma')})), 6) AS gamma,
  (['knn', 'rbf'])[CAST(floor(({_DRAW.format(n='kernel')}) * 2) + 1 AS INTEGER)] AS kernel,
  round({_DRAW.format(n='w_message')}, 6) AS w_message
FROM v_models, range(20) g(draw)""", ("v_models",))
def l11_param_draws(t):
    """20 random hyper-parameter draws for each model to be trained:
    randint, expon, choice, weights."""
    d = t.views.models().select("model_id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k"))
    draw = F.concat_ws("-", F.col("model_id").cast("string"), F.col("k").cast("string"))
    return d.select("model_id", F.col("k").cast("int").alias("draw"),
                    S.uniform_int(5, draw, "svd_tokens", 1, 200).alias("n_components"),
                    S.uniform_int(5, draw, "n_neighbors", 2, 15).alias("n_neighbors"),
                    F.round(S.expon(5, draw, "gamma", 20.0), 6).alias("gamma"),
                    S.choice(5, draw, "kernel", ["knn", "rbf"]).alias("kernel"),
                    F.round(F.element_at(S.weight_dist(5, draw, ["message"]), "message"), 6).alias("w_message"))


@register("u1_union_sample_counts", f"WITH {S1_SQL} SELECT CAST(coalesce(tag_id, -1) AS INTEGER) AS label, "
          "count(*) AS n FROM sample GROUP BY ALL", S1_VIEWS)
def u1_union_sample_counts(t):
    """U1/U5 + G12: row counts of the untagged ∪ tagged sample by label."""
    s = flagship_sample(t)
    return s.groupBy(F.coalesce("tag_id", F.lit(-1)).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@register("u4_distinct_sources", """
SELECT doc_id, array_to_string(list_sort(list_distinct([source, 'src' || (doc_id % 3)::VARCHAR, source])), ',') AS sources
FROM documents""")
def u4_distinct_sources(t):
    """U4: dedupe a list of sources (a lone value becomes a one-element list)."""
    arr = F.array("source", F.concat(F.lit("src"), F.pmod("doc_id", F.lit(3)).cast("string")), "source")
    return t.documents.select("doc_id", F.array_join(F.array_sort(F.array_distinct(arr)), ",").alias("sources"))

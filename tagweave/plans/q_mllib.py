"""Registered queries backed by Spark ML (M11-M16, M18, M20-M23, L12, S8,
S16). No SQL form: checked by rows and by properties in tests."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IndexToString, Normalizer
from pyspark.sql import functions as F

from tagweave.operators import mllib as ML
from tagweave.operators.squared_hinge import SvmParams, fit_squared_hinge
from tagweave.plans.registry import register
from tagweave.session import ensure_checkpoint_dir, stored

# Hashed width of the reference's stateless vectoriser.
DIM = 65536


def _corpus(t):
    """(id, text, label, subset) with a label index y, and the fitted features."""
    c = t.views.corpus().select(F.col("doc_id").alias("id"), "text", F.col("category").alias("label"), "subset")
    idx, labels = ML.with_label_index(c.where(F.col("subset") == "train"))
    feats = Pipeline(stages=ML.feature_stages(DIM)).fit(c.where(F.col("subset") == "train"))
    x = stored(feats.transform(idx.transform(c)).select("id", "label", "subset", "y", "features"))
    return x.where(F.col("subset") == "train"), x.where(F.col("subset") == "test"), labels


def _named(pred, labels):
    return IndexToString(inputCol="prediction", outputCol="prediction_label", labels=labels).transform(pred) \
        .select("id", "label", F.col("prediction_label").alias("prediction"))


@register("m11_linear_svc")
def m11_linear_svc(t):
    """Linear SVM (squared hinge, l2, C = 1, tol 1e-3), one-vs-rest, on
    L2-normalised TF-IDF of hashed words; test predictions."""
    tr, te, labels = _corpus(t)
    unit = lambda x: Normalizer(inputCol="features", outputCol="unit").transform(x).drop("features").withColumnRenamed("unit", "features")
    w, _ = fit_squared_hinge(unit(tr), len(labels), DIM, SvmParams(C=1.0, tol=1e-3))
    return _named(ML.predict_online(unit(te), w).join(te.select("id", "label"), "id"), labels)


@register("m12_l1_select_svc")
def m12_l1_select_svc(t):
    """l1 logistic regression as a feature selector (non-zero
    coefficients), then a linear SVM on the kept features."""
    tr, te, labels = _corpus(t)
    sl = ML.l1_select(tr)
    svc = OneVsRest(classifier=LinearSVC(regParam=1e-3, maxIter=50, featuresCol="sel"), labelCol="y",
                    featuresCol="sel").fit(sl.transform(tr))
    return _named(svc.transform(sl.transform(te)), labels)


def _penalised(t, l1_ratio):
    tr, te, labels = _corpus(t)
    m = LogisticRegression(labelCol="y", regParam=1e-4, elasticNetParam=l1_ratio, maxIter=50).fit(tr)
    return _named(m.transform(te), labels)


@register("m12_l1_linear")
def m12_l1_linear(t):
    """M12 on its own: a linear model with an l1 penalty (logistic loss)."""
    tr, te, labels = _corpus(t)
    m = LogisticRegression(labelCol="y", regParam=1e-3, elasticNetParam=1.0, maxIter=50).fit(tr)
    return _named(m.transform(te), labels)


@register("m13_sgd_elasticnet")
def m13_sgd_elasticnet(t):
    """Linear model with elastic-net penalty (l1 ratio .15, alpha 1e-4, 50 rounds)."""
    return _penalised(t, 0.15)


@register("m13_sgd_l2")
def m13_sgd_l2(t):
    """Linear model with an l2 penalty (alpha 1e-4, 50 rounds)."""
    return _penalised(t, 0.0)


@register("m13_sgd_l1")
def m13_sgd_l1(t):
    """Linear model with an l1 penalty (alpha 1e-4, 50 rounds)."""
    return _penalised(t, 1.0)


@register("m14_ridge_classifier")
def m14_ridge_classifier(t):
    """Ridge classifier — least squares on +/-1 targets per class, argmax."""
    tr, te, labels = _corpus(t)
    models = ML.fit_ridge(tr, len(labels))
    return _named(ML.predict_ridge(te.select("id", "y", "features", "label"), models)
                  .join(te.select("id", "label"), "id"), labels)


@register("m15_perceptron")
def m15_perceptron(t):
    """One-vs-rest perceptron by iterative parameter mixing (50 rounds)."""
    tr, te, labels = _corpus(t)
    w = ML.fit_online(tr, len(labels), DIM, ML.OnlineParams(kind="perceptron"))
    return _named(ML.predict_online(te, w).join(te.select("id", "label"), "id"), labels)


@register("m16_passive_aggressive")
def m16_passive_aggressive(t):
    """One-vs-rest passive-aggressive (C = 1) by iterative parameter mixing (50 rounds)."""
    tr, te, labels = _corpus(t)
    w = ML.fit_online(tr, len(labels), DIM, ML.OnlineParams(kind="pa"))
    return _named(ML.predict_online(te, w).join(te.select("id", "label"), "id"), labels)


@register("m18_random_forest")
def m18_random_forest(t):
    """Random forest, 100 trees."""
    tr, te, labels = _corpus(t)
    m = RandomForestClassifier(labelCol="y", numTrees=100, seed=7).fit(tr)
    return _named(m.transform(te), labels)


@register("m20_classifier_comparison")
def m20_classifier_comparison(t):
    """Accuracy, train and test seconds of the 14 runs, times normalised by
    the slowest."""
    tr, te, labels = _corpus(t)
    res = ML.compare(tr, te, len(labels), DIM)
    return res.select("name", F.round("accuracy", 6).alias("accuracy"), "train_sec", "test_sec",
                      "train_norm", "test_norm")


@register("m21_s16_sentiment")
def m21_s16_sentiment(t):
    """M21 + S16: sentiment model (TF-IDF + linear SVM, C = 1000 on a sum of n
    losses, so 1 / (1000 n) on their mean) trained on labels.quality, saved as a PipelineModel in the
    shared folder, loaded back, and applied to every document."""
    d = t.documents.select(F.col("doc_id").alias("id"), "text")
    lab = t.labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("y"))
    train = d.join(lab, "id")
    reg = 1 / (1000 * max(1, train.count()))
    pipe = Pipeline(stages=ML.feature_stages(DIM) + [LinearSVC(labelCol="y", regParam=reg, maxIter=50)])
    path = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/sentiment-{uuid.uuid4().hex}"
    ML.save_model(pipe.fit(train), path)
    model = ML.load_model(path)
    out = model.transform(d)
    return out.select("id", F.when(F.col("prediction") == 1.0, "positive").otherwise("negative").alias("sentiment"))


@register("m22_retina_classifier")
def m22_retina_classifier(t):
    """M22 (+V14): page classifier on fingerprints — multi-hot retina
    positions, linear SVM one-vs-rest, slug as class, 25 % hash test split."""
    r = t.views.retina().select(F.col("vec_id").alias("id"), "slug", "retina") \
        .withColumn("subset", ML.split_column("id", 0.25))
    cv, _ = ML.multi_hot_vectors(r.where(F.col("subset") == "train"), "retina")
    x = cv.transform(r.withColumn("__pos", F.col("retina").cast("array<string>"))).drop("__pos")
    x = x.withColumnRenamed("slug", "label")
    train = x.where(F.col("subset") == "train")
    idx, labels = ML.with_label_index(train)
    m = OneVsRest(classifier=LinearSVC(regParam=1e-3, maxIter=30), labelCol="y", parallelism=4).fit(idx.transform(train))
    # A slug that only the test rows have stays, and can't be predicted.
    return _named(m.transform(x.where(F.col("subset") == "test")), labels)


@register("m23_post_id_perceptron")
def m23_post_id_perceptron(t):
    """M23 (V3 + V5 + M15): predict the post of a comment line (150 posts as
    classes): words without accents, counts with document shares .01 to .9,
    sublinear TF-IDF, perceptron by parameter mixing (50 rounds), 33 % test
    split. A line of a post that training hasn't seen stays, and is wrong."""
    from tagweave.functions import text as T
    c = t.views.comments().select("post_id", F.get_json_object("comment", "$.message").alias("m"))
    lines = c.select("post_id", F.posexplode(T.lines(F.col("m"))).alias("pos", "text"), F.md5("m").alias("h")) \
        .where(F.char_length("text") > 0)
    rows = lines.select(F.xxhash64("post_id", "h", "pos").alias("id"), T.strip_accents(F.lower("text")).alias("text"),
                        F.col("post_id").cast("string").alias("label"))
    rows = stored(rows.withColumn("subset", ML.split_column("id", 0.33)))       # read by every fit
    train = rows.where(F.col("subset") == "train")
    idx, labels = ML.with_label_index(train)
    feats = Pipeline(stages=ML.count_stages(0.01, 0.9)).fit(train)
    x = feats.transform(rows).select("id", "label", "subset", "features")
    idf = feats.stages[-1].idf.toArray()          # an entry for each word that 1 % of the lines have
    x = stored(ML.sublinear_rows(x, idf, "label", "subset"))
    w = ML.fit_online(idx.transform(x.where(F.col("subset") == "train")), len(labels), len(idf), ML.OnlineParams())
    te = x.where(F.col("subset") == "test")
    return _named(ML.predict_online(te, w).join(te.select("id", "label"), "id"), labels)


@register("l12_grid_search")
def l12_grid_search(t):
    """3-fold cross-validated choice of n-gram range (1,1) vs (1,2) for
    TF-IDF + linear SVM; mean accuracy per setting."""
    c = t.views.corpus().select(F.col("doc_id").alias("id"), "text", F.col("category").alias("label"), "subset")
    idx, _ = ML.with_label_index(c)
    cv = ML.grid_search_ngrams(idx.transform(c.where(F.col("subset") == "train")))
    rows = [(i + 1, float(m)) for i, m in enumerate(cv.avgMetrics)]
    return t.spark.createDataFrame(rows, "ngram_max int, accuracy double")


@register("s8_class_folders", """SELECT lang AS class_name, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS class_id,
  count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY lang""")
def s8_class_folders(t):
    """A corpus laid out as one folder per class (written from documents,
    class = language) read back as labelled texts; per class: id, documents, chars."""
    path = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/class-folders-{uuid.uuid4().hex}"
    ML.write_class_folders(t.documents, "text", "lang", path)
    r = ML.read_class_folders(t.spark, path)
    return r.groupBy("class_name", "class_id").agg(F.count(F.lit(1)).alias("n_docs"),
                                                   F.sum(F.char_length("text")).alias("n_chars"))

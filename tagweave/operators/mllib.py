"""Text classifiers on Spark ML.

Features are Spark ML stages (regex tokenizer -> stop words -> hashing ->
idf), models are Spark ML estimators where one exists. Two online learners
the reference uses have no MLlib counterpart — the perceptron and the
passive-aggressive classifier — and are trained by iterative parameter
mixing (McDonald, Hall & Mann, NAACL 2010): rows are split into hash shards of
bounded size, whose number follows the rows and not the physical partitioning;
dealt once; every round each shard runs one epoch from the current weights inside
one task and returns the weights it changed, which are averaged
by a Spark aggregate. The weight matrix is classes x features — a bound set by
the parameters — and is broadcast each round.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (LinearSVC, LogisticRegression, NaiveBayes, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.feature import (IDF, Binarizer, CountVectorizer, HashingTF, RegexTokenizer, SQLTransformer, StopWordsRemover, StringIndexer,
                                VectorSlicer)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.functions.hashing import hash01
from tagweave.functions.stopwords import ENGLISH_STOP_WORDS
from tagweave.functions.text import let

WORD_PATTERN = r"[\p{L}\p{N}_]+"


def feature_stages(n_features: int = 4096, text_col: str = "text", ngram_sql: str | None = None) -> list:
    """V2-style stages: tokens -> stop words -> (optional n-gram SQL) -> hashed tf -> idf."""
    st = [RegexTokenizer(inputCol=text_col, outputCol="words", pattern=WORD_PATTERN, gaps=False),
          StopWordsRemover(inputCol="words", outputCol="tokens", stopWords=ENGLISH_STOP_WORDS)]
    st.append(SQLTransformer(statement=ngram_sql or NGRAM_SQL[1]))
    st += [HashingTF(inputCol="grams", outputCol="tf", numFeatures=n_features),
           IDF(inputCol="tf", outputCol="features")]
    return st


def count_stages(min_df: float, max_df: float, text_col: str = "text") -> list:
    """V3: counts of words by document share, and their idf."""
    return [RegexTokenizer(inputCol=text_col, outputCol="words", pattern=WORD_PATTERN, gaps=False),
            CountVectorizer(inputCol="words", outputCol="features", minDF=min_df, maxDF=max_df, vocabSize=1 << 20),
            IDF(inputCol="features", outputCol="weighted")]


def sublinear_rows(counts: DataFrame, idf, *keep: str) -> DataFrame:
    """V5: (id, ..., idx, val) of (id, features = counts): (1 + ln tf) x idf, L2.
    ``idf`` has an entry for each term of the fitted vocabulary."""
    weight = F.array(*[F.lit(float(x)) for x in idf]) if len(idf) else F.array().cast("array<double>")
    raw = let(weight, lambda w: F.zip_with("idx", "val", lambda i, v: (F.lit(1.0) + F.log(v)) * F.get(w, i)))
    x = sparse_rows(counts, *keep).withColumn("val", raw)
    norm = F.sqrt(F.aggregate("val", F.lit(0.0), lambda a, v: a + v * v))
    return x.withColumn("norm", norm).withColumn("val", F.transform("val", lambda v: v / F.col("norm"))).drop("norm")

# n-gram range as SQL over the token array: (1, 1) or (1, 2) (guarded: a
# one-token array has no bigram).
NGRAM_SQL = {
    1: "SELECT *, tokens AS grams FROM __THIS__",
    2: ("SELECT *, concat(tokens, IF(size(tokens) >= 2, transform(sequence(1, size(tokens) - 1), "
        "i -> concat_ws(' ', tokens[i - 1], tokens[i])), array())) AS grams FROM __THIS__"),
}


def with_label_index(train: DataFrame, label_col: str = "label"):
    idx = StringIndexer(inputCol=label_col, outputCol="y", stringOrderType="alphabetAsc").fit(train)
    return idx, idx.labels


def accuracy(pred: DataFrame, label_col: str = "y") -> float:
    r = pred.agg(F.avg((F.col("prediction") == F.col(label_col)).cast("double"))).collect()[0][0]
    return float(r) if r is not None else float("nan")


# --- iterative parameter mixing (M15, M16) --------------------------------------------------------------
@dataclass
class OnlineParams:
    kind: str = "perceptron"       # or "pa"
    n_iter: int = 50
    shard_rows: int = 5000
    C: float = 1.0
    seed: int = 3


def _vector_entries(batches):
    """Arrow batches (..., features = vectors as Spark lays them out) with the non-zero
    entries as two lists instead; a vector's other columns stay."""
    import pyarrow as pa
    for b in batches:
        cols, v = b.columns[:-1], b.column(b.num_columns - 1)
        kind, idx, val = (v.field(k) for k in ("type", "indices", "values"))
        there = v.is_valid().to_numpy(zero_copy_only=False)
        size = val.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) * there
        dense = (kind.fill_null(0).to_numpy(zero_copy_only=False) == 1) & there
        start = np.concatenate([[0], np.cumsum(size)])
        values = np.empty(start[-1])
        places = np.empty(start[-1], dtype=np.int32)
        row = np.repeat(np.arange(len(size)), size)
        values[:] = val.filter(pa.array(there)).flatten().to_numpy(zero_copy_only=False)
        of_dense = dense[row]
        places[of_dense] = (np.arange(len(row)) - start[row])[of_dense]
        places[~of_dense] = idx.filter(pa.array(there & ~dense)).flatten().to_numpy(zero_copy_only=False)
        kept = values != 0
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=len(size)))])
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(c[kept]), mask=pa.array(~there)) for c in (places, values)]
        yield pa.RecordBatch.from_arrays([*cols, *lists], [*b.schema.names[:-1], "idx", "val"])


def sparse_rows(x: DataFrame, *keep: str) -> DataFrame:
    """(id, ..., idx, val) of (id, features): the non-zero entries as arrays (rows that have them already stay).
    Vectors reach Arrow in their sparse form, so a row costs its entries, not its width."""
    if "idx" in x.columns:
        return x.select("id", *keep, "idx", "val")
    kinds = dict(x.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in ("id", *keep)], "idx array<int>", "val array<double>"])
    return x.select("id", *keep, "features").mapInArrow(_vector_entries, schema)


#: Ranges of a table of weights whose changes are added up apart.
WEIGHT_PARTS = 16


def split_entries(every: np.ndarray):
    """An Arrow batch (part, i, d): the keys (places) and numbers of ``every`` that are not 0, a row for
    each range of keys."""
    import pyarrow as pa
    key, size = np.flatnonzero(every), len(every)
    cut = np.searchsorted(key, -(-size * np.arange(WEIGHT_PARTS + 1) // WEIGHT_PARTS))
    some = [p for p in range(WEIGHT_PARTS) if cut[p] < cut[p + 1]]
    keys, numbers = [key[cut[p]:cut[p + 1]] for p in some], [every[key[cut[p]:cut[p + 1]]] for p in some]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(numbers, pa.list_(pa.float64()))], ["part", "i", "d"])


ENTRIES = "part int, i array<long>, d array<double>"


def add_up(entries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sums) of ``split_entries`` rows. A key's numbers are added in order, so that a
    rerun agrees; a range is one task, and as many numbers as there are keys reach the driver."""
    import pyarrow as pa

    def add(batches):
        for b in batches:
            for r in range(b.num_rows):
                some = b.column("e").slice(r, 1).flatten()
                key, d = (some.field(c).flatten().to_numpy(zero_copy_only=False) for c in ("i", "d"))
                order = np.lexsort((d, key))
                own, at = np.unique(key[order], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array([own], pa.list_(pa.int64())), pa.array([np.bincount(at, d[order], len(own))], pa.list_(pa.float64()))], ["i", "d"])

    held = entries.groupBy("part").agg(F.collect_list(F.struct("i", "d")).alias("e")).select("e")
    found = held.mapInArrow(add, "i array<long>, d array<double>").toPandas()
    return np.concatenate([*found["i"], np.empty(0, np.int64)]).astype(np.int64), np.concatenate([*found["d"], np.empty(0)])


def arrow_rows(b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an Arrow batch with idx and val: where each row's entries start, and all entries."""
    size = b.column("idx").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    idx, val = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("idx", "val"))
    return np.concatenate([[0], np.cumsum(size)]), idx.astype(np.int64), val.astype(float)


def _epoch_fn(kind: str, n_classes: int, dim: int, C: float, bc):
    signs = np.where(np.eye(n_classes, dtype=bool), 1.0, -1.0)

    def changes(w: np.ndarray):
        return split_entries((w - bc.value).ravel())

    def epoch(batches):
        """Whole shards, one after the other, their rows in order."""
        shard = w = None
        for b in batches:
            start, idxs, vals = arrow_rows(b)
            shards, ys = (b.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "y"))
            for r, (own, y) in enumerate(zip(shards.tolist(), ys.tolist())):
                if own != shard:
                    if w is not None:
                        yield changes(w)
                    shard, w = own, bc.value.copy()      # (classes, dim + 1), last column = bias
                idx, val = idxs[start[r]:start[r + 1]], vals[start[r]:start[r + 1]]
                t = signs[int(y)]
                s = w[:, idx] @ val + w[:, dim]
                if kind == "perceptron":
                    nz = np.flatnonzero(t * s <= 0)
                    upd = t[nz]
                else:
                    loss = np.maximum(0.0, 1.0 - t * s)
                    nz = np.flatnonzero(loss)
                    upd = np.minimum(C, loss[nz] / (val @ val + 1.0)) * t[nz] if len(nz) else nz
                if len(nz):
                    w[nz[:, None], idx] += upd[:, None] * val
                    w[nz, dim] += upd
        if w is not None:
            yield changes(w)
    return epoch


def fit_online(data: DataFrame, n_classes: int, dim: int, p: OnlineParams) -> np.ndarray:
    """OvR perceptron / passive-aggressive by iterative parameter mixing.
    ``data``: (id, features SparseVector, y index). Stops early when a round
    changes nothing."""
    from tagweave.session import cut_lineage, stored
    spark = data.sparkSession
    rows = stored(sparse_rows(data.withColumn("y", F.col("y").cast("int")), "y").withColumn(
        "order", F.md5(F.concat_ws(":", F.lit(str(p.seed)), F.col("id").cast("string")))))
    shards = max(1, -(-rows.count() // p.shard_rows))
    # Dealt and sorted once: a partition of the checkpoint holds whole shards, so that a round shuffles no rows.
    rows = cut_lineage(rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
                       .repartition(shards, "shard").sortWithinPartitions("shard", "order", F.col("id").asc_nulls_last()))
    w = np.zeros((n_classes, dim + 1))
    for _ in range(p.n_iter):
        bc = spark.sparkContext.broadcast(w)
        # Whatever the shards, classes x features numbers reach the driver.
        at, d = add_up(rows.mapInArrow(_epoch_fn(p.kind, n_classes, dim, p.C, bc), ENTRIES))
        w = w.copy()
        w.reshape(-1)[at] += d / shards
        bc.unpersist()
        if not len(at):
            break
    return w


def predict_online(data: DataFrame, w: np.ndarray) -> DataFrame:
    """(id, prediction index) = argmax_k w_k . x + b_k, in sparse Arrow batches."""
    bc = data.sparkSession.sparkContext.broadcast(w)
    dim = w.shape[1] - 1

    def score(batches):
        ww = np.ascontiguousarray(bc.value[:, :dim].T)
        bias = bc.value[:, dim]
        for pdf in batches:
            size = np.array([len(v) for v in pdf["idx"]], dtype=int)
            s = np.tile(bias, (len(pdf), 1))
            if size.sum():
                part = ww[np.concatenate(pdf["idx"].to_list()).astype(int)] * np.concatenate(pdf["val"].to_list())[:, None]
                some = np.flatnonzero(size)
                s[some] += np.add.reduceat(part, np.concatenate([[0], np.cumsum(size[some])[:-1]]), axis=0)
            yield pd.DataFrame({"id": pdf["id"], "prediction": s.argmax(axis=1).astype(float)})

    return sparse_rows(data).mapInPandas(score, "id long, prediction double")


# --- M14 ridge classifier -------------------------------------------------------------------------------
def fit_ridge(train: DataFrame, n_classes: int, reg: float = 1.0):
    """One least-squares regression per class on +1 / -1 targets (classes are few)."""
    models = []
    for k in range(n_classes):
        d = train.withColumn("t", F.when(F.col("y") == k, 1.0).otherwise(-1.0))
        models.append(LinearRegression(featuresCol="features", labelCol="t", regParam=reg, elasticNetParam=0.0,
                                       tol=1e-2, maxIter=50, solver="l-bfgs").fit(d))
    return models


def predict_ridge(test: DataFrame, models) -> DataFrame:
    out = test.select("id", "y", "features")
    for k, m in enumerate(models):
        out = m.setPredictionCol(f"s{k}").transform(out)
    cand = F.array(*[F.struct((-F.col(f"s{k}")).alias("neg"), F.lit(float(k)).alias("k")) for k in range(len(models))])
    return out.select("id", "y", F.array_min(cand)["k"].alias("prediction"))


# --- M20 comparison ------------------------------------------------------------------------------------------
def long_vectors(x: DataFrame, unit: bool = True) -> DataFrame:
    """(id, term, value) of (id, features), L2-normalised."""
    v = sparse_rows(x).select("id", F.explode(F.arrays_zip("idx", "val")).alias("e")).select(
        "id", F.col("e.idx").alias("term"), F.col("e.val").alias("value"))
    if not unit:
        return v
    norm = v.groupBy("id").agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("nr"))
    return v.join(norm, "id").select("id", "term", (F.col("value") / F.col("nr")).alias("value"))


def l1_select(train: DataFrame, reg: float = 1e-3) -> VectorSlicer:
    """The features to which an l1 logistic regression gives a weight."""
    coef = LogisticRegression(labelCol="y", regParam=reg, elasticNetParam=1.0, maxIter=50).fit(train).coefficientMatrix.toArray()
    keep = [int(i) for i in (abs(coef).sum(axis=0) > 0).nonzero()[0]] or [0]
    return VectorSlicer(inputCol="features", outputCol="sel", indices=keep)


#: The runs of the comparison, in the reference's order.
RUNS = ("ridge", "perceptron", "passive_aggressive", "knn", "random_forest", "linear_svc_l2", "sgd_l2", "linear_svc_l1",
        "sgd_l1", "sgd_elasticnet", "nearest_centroid", "multinomial_nb", "bernoulli_nb", "l1_select_svc")


def _run(name: str, train: DataFrame, n_classes: int, dim: int, n_iter: int):
    """Fit one classifier; returns a function from test rows to (y, prediction)."""
    from tagweave.operators import classify as C
    svc = lambda col="features": OneVsRest(classifier=LinearSVC(regParam=1e-3, tol=1e-3, maxIter=50, featuresCol=col),
                                           labelCol="y", featuresCol=col, parallelism=4)
    logistic = lambda reg, l1: LogisticRegression(labelCol="y", regParam=reg, elasticNetParam=l1, maxIter=50)
    est = {"random_forest": lambda: RandomForestClassifier(labelCol="y", numTrees=100, seed=7),
           "linear_svc_l2": svc, "linear_svc_l1": lambda: logistic(1e-3, 1.0),
           "sgd_l2": lambda: logistic(1e-4, 0.0), "sgd_l1": lambda: logistic(1e-4, 1.0), "sgd_elasticnet": lambda: logistic(1e-4, 0.15),
           "multinomial_nb": lambda: NaiveBayes(labelCol="y", smoothing=0.01, modelType="multinomial")}
    if name in est:
        return est[name]().fit(train).transform
    if name == "ridge":
        models = fit_ridge(train, n_classes)
        return lambda te: predict_ridge(te, models)
    if name in ("perceptron", "passive_aggressive"):
        w = fit_online(train, n_classes, dim, OnlineParams(kind="pa" if name[1] == "a" else name, n_iter=n_iter))
        return lambda te: predict_online(te, w).join(te.select("id", "y"), "id")
    if name == "bernoulli_nb":
        binary = Binarizer(inputCol="features", outputCol="bits", threshold=0.0)
        model = NaiveBayes(labelCol="y", featuresCol="bits", smoothing=0.01, modelType="bernoulli").fit(binary.transform(train))
        return lambda te: model.transform(binary.transform(te))
    if name == "l1_select_svc":
        sel = l1_select(train)
        model = svc("sel").fit(sel.transform(train))
        return lambda te: model.transform(sel.transform(te))
    lab = train.select("id", F.col("y").alias("label"))
    if name == "knn":
        return lambda te: C.knn_vote(C.knn_cosine(long_vectors(te), long_vectors(train), 10, test_ids=te, train_ids=train), lab) \
            .join(te.select("id", "y"), "id")
    mu = C.fit_centroids(long_vectors(train), lab)
    return lambda te: C.argmax(C.predict_centroids(long_vectors(te), te, mu)).join(te.select("id", "y"), "id")


def compare(train: DataFrame, test: DataFrame, n_classes: int, dim: int, names: tuple = RUNS, n_iter: int = 50) -> DataFrame:
    """(name, accuracy, train_sec, test_sec, train_norm, test_norm) for
    each classifier; times normalised by the largest. A driver loop over
    distributed fits (one row per classifier)."""
    spark = train.sparkSession
    rows = []
    for name in names:
        t0 = time.perf_counter()
        predict = _run(name, train, n_classes, dim, n_iter)
        t1 = time.perf_counter()
        acc = accuracy(predict(test))
        t2 = time.perf_counter()
        rows.append((name, acc, t1 - t0, t2 - t1))
    mt = max(r[2] for r in rows) or 1.0
    ms = max(r[3] for r in rows) or 1.0
    return spark.createDataFrame([(n, a, tr, te, tr / mt, te / ms) for n, a, tr, te in rows],
                                 "name string, accuracy double, train_sec double, test_sec double, "
                                 "train_norm double, test_norm double")


# --- L12 grid search ---------------------------------------------------------------------------------------
def grid_search_ngrams(train: DataFrame, min_df: float = 3, max_df: float = 0.95, folds: int = 3, parallelism: int = 2):
    """Cross-validated choice between n-gram ranges (1,1) and (1,2) for a
    TF-IDF + linear SVM (one-vs-rest) pipeline. Every n-gram of ``min_df``
    documents that at most the share ``max_df`` of them has is a feature."""
    ngram = SQLTransformer(statement=NGRAM_SQL[1])
    stages = [RegexTokenizer(inputCol="text", outputCol="words", pattern=WORD_PATTERN, gaps=False),
              StopWordsRemover(inputCol="words", outputCol="tokens", stopWords=ENGLISH_STOP_WORDS), ngram,
              CountVectorizer(inputCol="grams", outputCol="tf", minDF=min_df, maxDF=max_df, vocabSize=(1 << 31) - 1),
              IDF(inputCol="tf", outputCol="features"),
              OneVsRest(classifier=LinearSVC(regParam=1e-3, maxIter=30), labelCol="y", parallelism=4)]
    grid = ParamGridBuilder().addGrid(ngram.statement, [NGRAM_SQL[1], NGRAM_SQL[2]]).build()
    cv = CrossValidator(estimator=Pipeline(stages=stages), estimatorParamMaps=grid,
                        evaluator=MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy"),
                        numFolds=folds, parallelism=parallelism, seed=11)
    return cv.fit(train)


# --- S8 labelled text folders ------------------------------------------------------------------------------
def write_class_folders(df: DataFrame, text_col: str, class_col: str, path: str) -> None:
    """Lay out a corpus as one folder per class (``path/cls=<class>/``). A file
    holds many documents, one JSON string a line, so line feeds inside a document
    are safe and the number of files doesn't follow the number of documents."""
    df.select(F.col(class_col).alias("cls"), F.to_json(F.struct(F.col(text_col).alias("t"))).alias("value")) \
        .write.mode("overwrite").partitionBy("cls").text(path)


def read_class_folders(spark, path: str, whole_files: bool = False) -> DataFrame:
    """The documents under ``path`` as (text, class_name, class_id); class ids
    follow the sorted folder names. ``whole_files``: folders ``path/<class>/`` with
    one plain document per file, as the reference has them."""
    if whole_files:
        raw = spark.read.text(f"{path}/*/*", wholetext=True)
        out = raw.select(F.col("value").alias("text"), F.url_decode(F.regexp_extract("_metadata.file_path", r"/([^/]+)/[^/]+$", 1)).alias("class_name"))
    else:
        raw = spark.read.schema("value string, cls string").text(path)
        out = raw.select(F.from_json("value", "t string")["t"].alias("text"), F.col("cls").alias("class_name"))
    from pyspark.sql import Window
    ids = out.select("class_name").distinct()      # one row per class
    ids = ids.select("class_name", (F.dense_rank().over(Window.orderBy("class_name")) - 1).alias("class_id"))
    return out.join(F.broadcast(ids), "class_name")


# --- S16 model files ----------------------------------------------------------------------------------------
def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def multi_hot_vectors(df: DataFrame, positions_col: str, out_col: str = "features", width: int = 16384):
    """V14 for ML: positions -> binary SparseVector through CountVectorizer
    (feature index = rank of the position in the learned vocabulary, at most
    ``width`` entries). Returns (fitted model, transformed frame)."""
    from pyspark.ml.feature import CountVectorizer
    s = df.withColumn("__pos", F.col(positions_col).cast("array<string>"))
    cv = CountVectorizer(inputCol="__pos", outputCol=out_col, binary=True, vocabSize=width, minDF=1.0).fit(s)
    return cv, cv.transform(s).drop("__pos")


def split_column(id_col: str, test_size: float, seed: int = 42) -> F.Column:
    return F.when(hash01(seed, 0, F.col(id_col)) < test_size, "test").otherwise("train")

"""Classifiers as tables (M9, M10, M17, M19) and their evaluation.

Inputs are long vectors ``(id, term, value)`` and label tables
``(id, label)``. A fitted naive Bayes model is a table with one row per term
and an array with one weight per class; prediction joins the new rows' vectors
with it and sums per row, so rows are never multiplied by classes. The class list
and its constants (a row per class) are all that is taken to the driver.

Scale notes: the model table is broadcast while it has few terms (hashed
features always), else joined on the term (hot terms on the data side, one row
per term on the model side — AQE splits the skew).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagweave.operators.cluster import _dense, _products
from tagweave.session import cut_lineage


def class_list(labels: DataFrame, label_col: str = "label") -> list:
    """Distinct classes, sorted (collected: one row per class)."""
    return [r[0] for r in labels.select(label_col).distinct().orderBy(label_col).collect()]


def _with_classes(ids: DataFrame, classes: list) -> DataFrame:
    return ids.withColumn("c", F.explode(F.array(*[F.lit(c) for c in classes])))


# --- M9 naive Bayes -------------------------------------------------------------------
def fit_multinomial_nb(x: DataFrame, labels: DataFrame, alpha: float = 1.0, label_col: str = "label"):
    """M9 multinomial: log P(t|c) = ln((N_tc + a) / (N_c + a |V|)), prior ln(n_c / n).
    Returns (feature table (term, c, logp), prior table (c, logprior, logp_unseen))."""
    lab = labels.select("id", F.col(label_col).alias("c"))
    vocab = x.select("term").distinct()
    n_terms = vocab.count()
    ntc = x.join(lab, "id").groupBy("c", "term").agg(F.sum("value").alias("ntc"))
    nc = ntc.groupBy("c").agg(F.sum("ntc").alias("nc"))
    n = lab.count()
    prior = lab.groupBy("c").agg(F.log(F.count(F.lit(1)) / F.lit(n)).alias("logprior"))
    prior = prior.join(nc, "c", "left").select(
        "c", "logprior", F.log(F.lit(alpha) / (F.coalesce("nc", F.lit(0.0)) + F.lit(alpha * n_terms))).alias("logp0"))
    feats = ntc.join(F.broadcast(nc), "c").select(
        "term", "c", F.log((F.col("ntc") + alpha) / (F.col("nc") + F.lit(alpha * n_terms))).alias("logp"))
    return feats, prior


#: Terms of a model that is shipped to every task; a larger one is joined by a shuffle.
MAX_BROADCAST_TERMS = 1 << 18


def _model_side(table: DataFrame) -> DataFrame:
    """One row per term, read twice: counted, then broadcast if it is small."""
    table = cut_lineage(table)
    return F.broadcast(table) if table.count() <= MAX_BROADCAST_TERMS else table


def _class_sums(x: DataFrame, table: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(id, s ARRAY): sum over the row's terms of value * w, w (term, w ARRAY) holding
    one weight per class; rows are not multiplied by the classes."""
    sums = x.join(_model_side(table), "term").groupBy("id").agg(
        *[F.sum(F.col("value") * F.get("w", F.lit(i))).alias(f"s{i}") for i in range(n)])
    s = F.array(*[F.coalesce(F.col(f"s{i}"), F.lit(0.0)) for i in range(n)])
    return ids.select("id").distinct().join(sums, "id", "left").select("id", s.alias("s"))


def _by_class(sums: DataFrame, classes: list, base: dict) -> DataFrame:
    """(id, c, score) with ``base`` (class -> constant) added."""
    rows = F.array(*[F.struct(F.lit(c).alias("c"), (F.get("s", F.lit(i)) + F.lit(float(base[c]))).alias("score")) for i, c in enumerate(classes)])
    return sums.select("id", F.explode(rows).alias("e")).select("id", "e.c", "e.score")


def predict_multinomial_nb(x: DataFrame, ids: DataFrame, model) -> DataFrame:
    """Scores (id, c, score) = logprior + sum_t value * logp(t|c); a term of the
    vocabulary unseen with class c has logp0(c). Terms outside the vocabulary
    are ignored."""
    feats, prior = model
    found = {r["c"]: r for r in prior.collect()}          # one row per class
    classes = sorted(found)
    by = feats.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("c", "logp"))).alias("m"))
    w = F.array(*[F.coalesce(F.element_at("m", F.lit(c)), F.lit(float(found[c]["logp0"]))) for c in classes])
    return _by_class(_class_sums(x, by.select("term", w.alias("w")), ids, len(classes)), classes,
                     {c: found[c]["logprior"] for c in classes})


def fit_bernoulli_nb(x: DataFrame, labels: DataFrame, alpha: float = 1.0, label_col: str = "label"):
    """M9 Bernoulli (features binarised: present = value > 0):
    p(t|c) = (df_tc + a) / (n_c + 2a). Returns (feature table (term, c, w =
    ln p - ln(1-p)), class table (c, base = logprior + sum_t ln(1 - p)))."""
    lab = labels.select("id", F.col(label_col).alias("c"))
    pres = x.where(F.col("value") > 0).select("id", "term")
    vocab = pres.select("term").distinct()
    n = lab.count()
    ncls = lab.groupBy("c").agg(F.count(F.lit(1)).alias("nc"))
    classes = [r[0] for r in ncls.select("c").orderBy("c").collect()]
    dtc = pres.join(lab, "id").groupBy("term", "c").agg(F.count(F.lit(1)).alias("dtc"))
    grid = _with_classes(vocab, classes).join(dtc, ["term", "c"], "left").join(F.broadcast(ncls), "c")
    p = (F.coalesce("dtc", F.lit(0)) + alpha) / (F.col("nc") + 2 * alpha)
    feats = grid.select("term", "c", F.log(p).alias("lp"), F.log(1 - p).alias("lq"))
    base = feats.groupBy("c").agg(F.sum("lq").alias("sq")).join(F.broadcast(ncls), "c").select(
        "c", (F.log(F.col("nc") / F.lit(n)) + F.col("sq")).alias("base"))
    return feats.select("term", "c", (F.col("lp") - F.col("lq")).alias("w")), base


def predict_bernoulli_nb(x: DataFrame, ids: DataFrame, model) -> DataFrame:
    feats, base = model
    found = {r["c"]: r["base"] for r in base.collect()}
    classes = sorted(found)
    by = feats.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("c", "w"))).alias("m"))
    w = F.array(*[F.coalesce(F.element_at("m", F.lit(c)), F.lit(0.0)) for c in classes])
    pres = x.where(F.col("value") > 0).select("id", "term", F.lit(1.0).alias("value"))
    return _by_class(_class_sums(pres, by.select("term", w.alias("w")), ids, len(classes)), classes, found)


def argmax(scores: DataFrame, higher_is_better: bool = True) -> DataFrame:
    """Winner per id; ties go to the lowest class."""
    key = F.struct(-F.col("score") if higher_is_better else F.col("score"), F.col("c"))
    return scores.groupBy("id").agg(F.min_by("c", key).alias("prediction"))


# --- M10 one-vs-rest multi-label ----------------------------------------------------------
def fit_ovr_nb(x: DataFrame, label_sets: DataFrame, classes: list, alpha: float = 1.0):
    """One binary multinomial NB per label (label present vs absent), all
    labels in one job. ``label_sets`` is (id, labels ARRAY). A label's "absent"
    side is the total less its "present" side, so a row is counted once for each
    label it has, not for each label there is. Returns (term, w ARRAY = log-odds
    of the term by label) and the prior log-odds (infinite where all or no rows
    have the label)."""
    lab = label_sets.select("id", F.explode("labels").alias("k"))
    total = x.groupBy("term").agg(F.sum("value").alias("t"))
    with_label = x.join(lab, "id").groupBy("term", "k").agg(F.sum("value").alias("n1"))
    n, n_terms, n_all = label_sets.count(), total.count(), total.agg(F.sum("t")).first()[0] or 0.0
    m = {r["k"]: r["m"] for r in lab.groupBy("k").agg(F.count(F.lit(1)).alias("m")).collect()}               # one row per label
    n1 = {r["k"]: r["s"] for r in with_label.groupBy("k").agg(F.sum("n1").alias("s")).collect()}
    by = with_label.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("k", "n1"))).alias("m"))

    def odds(k):
        own = n1.get(k, 0.0)
        one = F.coalesce(F.element_at("m", F.lit(k)), F.lit(0.0))
        return (F.log((one + alpha) / F.lit(own + alpha * n_terms))
                - F.log((F.greatest(F.col("t") - one, F.lit(0.0)) + alpha) / F.lit(n_all - own + alpha * n_terms)))

    table = total.join(by, "term", "left").select("term", F.array(*[odds(k) for k in classes]).alias("w"))
    prior = {k: float("-inf") if not m.get(k) else float("inf") if m[k] == n else float(np.log(m[k] / (n - m[k]))) for k in classes}
    return table, prior


def predict_ovr_nb(x: DataFrame, ids: DataFrame, model, classes: list) -> DataFrame:
    """(id, k, hit): label k predicted when the 'present' side scores higher
    (ties: absent)."""
    table, prior = model
    scores = _by_class(_class_sums(x, table, ids, len(classes)), classes, prior)
    return scores.select("id", F.col("c").alias("k"), (F.round("score", 9) > 0).cast("int").alias("hit"))


# --- M19 nearest centroid ----------------------------------------------------------------------
def fit_centroids(x: DataFrame, labels: DataFrame, label_col: str = "label") -> DataFrame:
    """M19 fit: (c, term, mu) = mean of the class's vectors per term."""
    lab = labels.select("id", F.col(label_col).alias("c"))
    nc = lab.groupBy("c").agg(F.count(F.lit(1)).alias("nc"))
    s = x.join(lab, "id").groupBy("c", "term").agg(F.sum("value").alias("s"))
    return s.join(F.broadcast(nc), "c").select("c", "term", (F.col("s") / F.col("nc")).alias("mu"))


def predict_centroids(x: DataFrame, ids: DataFrame, centroids: DataFrame) -> DataFrame:
    """Squared distance ||x||^2 - 2 x.mu + ||mu||^2 per class; nearest wins."""
    classes = [r[0] for r in centroids.select("c").distinct().orderBy("c").collect()]
    mu2 = centroids.groupBy("c").agg(F.sum(F.col("mu") * F.col("mu")).alias("mu2"))
    x2 = x.groupBy("id").agg(F.sum(F.col("value") * F.col("value")).alias("x2"))
    dot = x.join(centroids, "term").groupBy("id", "c").agg(F.sum(F.col("value") * F.col("mu")).alias("dot"))
    all_c = _with_classes(ids.select("id").distinct(), classes)
    d = all_c.join(dot, ["id", "c"], "left").join(x2, "id", "left").join(F.broadcast(mu2), "c")
    return d.select("id", "c", (-(F.coalesce("x2", F.lit(0.0)) - 2 * F.coalesce("dot", F.lit(0.0)) + F.col("mu2")))
                    .alias("score"))


# --- M17 k nearest neighbours ---------------------------------------------------------------------
#: Rows of a block at most, blocks at least a side, and the tiles that a task multiplies at once.
KNN_BLOCK, KNN_BLOCKS = 32768, 4
TEST_BLOCK, TRAIN_BLOCK = 1024, 2048
#: Terms that are multiplied as a dense tile, products of other terms made at once.
KNN_HEAD, KNN_PRODUCTS = 1024, 1 << 22


def _entries(f: pd.DataFrame):
    """(row, term, value) of packed rows, the entries of one row and term added up."""
    terms = [np.asarray(t if t is not None else [], dtype=np.int64) for t in f["t"]]
    vals = [np.asarray(v if v is not None else [], dtype=float) for v in f["v"]]
    row = np.repeat(np.arange(len(f)), [len(t) for t in terms])
    term, val = np.concatenate([*terms, np.empty(0, np.int64)]), np.concatenate([*vals, np.empty(0)])
    # Terms are in order within a row.
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (term[1:] != term[:-1])])[:len(row)])
    return (row, term, val) if len(new) == len(row) else (row[new], term[new], np.add.reduceat(val, new))


def _tail_products(row, col, val, tile, shape) -> np.ndarray:
    """The sums of products of the entries (row, col, val) with those of ``tile``:
    (first entry of each column, rows, values)."""
    start, trow, tval = tile
    lo, n = start[col], start[col + 1] - start[col]
    some = np.flatnonzero(n)
    out = np.zeros(shape[0] * shape[1])
    for part in np.split(some, np.flatnonzero(np.diff(np.cumsum(n[some]) // KNN_PRODUCTS)) + 1):
        size = n[part]
        at = np.repeat(lo[part] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        out += np.bincount(np.repeat(row[part] * shape[1], size) + trow[at], np.repeat(val[part], size) * tval[at], len(out))
    return out.reshape(shape)


def _best_of_block(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """(id, nid, sim): the k best rows of ``right`` for each of ``left``, both (id, t, v).

    The terms with the most products are multiplied as dense tiles in single precision, whose
    error is bounded, the others entry by entry; what may be among the k best is then
    multiplied in double. Rows without a common term have no similarity: of these only the
    k smallest ids can count."""
    left, right = left[left["id"].notna()].sort_values("id"), right.sort_values("id")
    lid, rid = left["id"].to_numpy(), right["id"].to_numpy()
    (lrow, lterm, lval), (rrow, rterm, rval) = _entries(left), _entries(right)
    common = np.intersect1d(lterm, rterm)
    keep, keep2 = np.isin(lterm, common), np.isin(rterm, common)
    lrow, lcol, lval = lrow[keep], np.searchsorted(common, lterm[keep]), lval[keep]
    rrow, rcol, rval = rrow[keep2], np.searchsorted(common, rterm[keep2]), rval[keep2]
    number = np.empty(len(common), dtype=np.int64)
    number[np.argsort(-np.bincount(lcol, minlength=len(common)) * np.bincount(rcol, minlength=len(common)), kind="stable")] = np.arange(len(common))
    lcol, rcol, head = number[lcol], number[rcol], min(KNN_HEAD, len(common))
    slack = 2 * (2e-4 + (head + 2) * 2.0 ** -23)
    signed = bool((lval < 0).any() or (rval < 0).any())
    (hrow, hcol, hval), tiles = (e[rcol < head] for e in (rrow, rcol, rval)), []
    trow, tcol, tval = (e[rcol >= head] for e in (rrow, rcol, rval))
    for lo2 in range(0, len(rid), TRAIN_BLOCK):
        a, b = np.searchsorted(trow, (lo2, lo2 + TRAIN_BLOCK))
        order = np.argsort(tcol[a:b], kind="stable")
        start = np.concatenate([[0], np.cumsum(np.bincount(tcol[a:b] - head, minlength=len(common) - head))])
        tiles.append((start, trow[a:b][order] - lo2, tval[a:b][order]))
    found = [(lid[:0], rid[:0], np.empty(0))]
    for lo in range(0, len(lid) if len(rid) else 0, TEST_BLOCK):
        hi = min(lo + TEST_BLOCK, len(lid))
        a, b = np.searchsorted(lrow, (lo, hi))
        row, col, val = lrow[a:b] - lo, lcol[a:b], lval[a:b]
        dense = _dense(row[col < head], col[col < head], val[col < head], 0, hi - lo, head, float)
        single, rest = dense.astype(np.float32), col >= head
        bound = np.full(hi - lo, -np.inf)
        i, j, near, tail = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32), np.empty(0)
        for lo2, tile in zip(range(0, len(rid), TRAIN_BLOCK), tiles):
            hi2 = min(lo2 + TRAIN_BLOCK, len(rid))
            s = single @ _dense(hrow, hcol, hval, lo2, hi2, head, np.float32).T
            others = _tail_products(row[rest], col[rest] - head, val[rest], tile, s.shape)
            s += others
            if not lo2 and hi2 >= k:
                bound = np.partition(s, -k, axis=1)[:, -k].astype(float) - slack
            at = np.flatnonzero((s >= bound[:, None]) if signed else (s >= bound[:, None]) & (s != 0))
            i, j = np.concatenate([i, at // s.shape[1]]), np.concatenate([j, lo2 + at % s.shape[1]])
            near, tail = np.concatenate([near, s.ravel()[at]]), np.concatenate([tail, others.ravel()[at]])
            order = np.lexsort((-near, i))
            i, j, near, tail = i[order], j[order], near[order], tail[order]
            first = np.searchsorted(i, np.arange(hi - lo))
            full = np.flatnonzero(np.bincount(i, minlength=hi - lo) >= k)
            bound[full] = np.maximum(bound[full], near[first[full] + k - 1] - slack)
            may = near >= bound[i]
            i, j, near, tail = i[may], j[may], near[may], tail[may]
        sim = tail + _products(dense, i, j, hrow, hcol, hval)
        few = np.flatnonzero(bound <= 0)
        m = min(k, len(rid))
        more = np.setdiff1d((few[:, None] * len(rid) + np.arange(m)).ravel(), i * len(rid) + j)
        i, j, sim = np.concatenate([i, more // len(rid)]), np.concatenate([j, more % len(rid)]), np.concatenate([sim, np.zeros(len(more))])
        sim = np.round(sim, 9)
        sim[sim <= 1e-12] = 0.0
        order = np.lexsort((j, -sim, i))
        i, j, sim = i[order], j[order], sim[order]
        top = np.arange(len(i)) - np.searchsorted(i, i) < k
        found.append((lid[lo + i[top]], rid[j[top]], sim[top]))
    return pd.DataFrame(dict(zip(("id", "nid", "sim"), (np.concatenate(c) for c in zip(*found)))))


def knn_cosine(test: DataFrame, train: DataFrame, k: int = 10, test_ids: DataFrame | None = None,
               train_ids: DataFrame | None = None) -> DataFrame:
    """M17 neighbours by cosine similarity of L2-normalised sparse vectors (id,
    term, value): (id, nid, sim, rank), exactly k per test id (if train has k
    rows), similarities rounded to 9 digits before they are ranked, ties to the
    lowest train id. Exact: a product of blocks.

    Test and train rows are dealt into blocks of about ``KNN_BLOCK`` vectors (few
    blocks, as a row is shuffled once for each block it meets), packed as arrays;
    each pair of blocks is one co-grouped task that multiplies them in numpy, a
    tile of ``TEST_BLOCK`` x ``TRAIN_BLOCK`` rows at a time (``_best_of_block``), and
    keeps the best k of each test row. No pair of rows is ever shuffled; a test row ships k candidates a
    train block. ``test_ids`` / ``train_ids`` list rows whose vector may be empty;
    their similarity is 0 to everything. Terms are compared by 64-bit hash."""
    def packed(x: DataFrame, ids: DataFrame | None, side: str, block: int, other: int) -> DataFrame:
        rows = x.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("term").alias("t"), F.col("value").alias("v")))).alias("e"))
        if ids is not None:
            rows = ids.select("id").distinct().join(rows, "id", "left")
        out = rows.select("id", F.transform("e", lambda x: x["t"]).alias("t"), F.transform("e", lambda x: x["v"]).alias("v"))
        # Named anew, so that both sides may come from one table.
        out = out.select(*[F.col(c).alias(c) for c in ("id", "t", "v")]).withColumn(side, F.pmod(F.xxhash64("id"), F.lit(block)).cast("int"))
        return out.withColumn("b" if side == "a" else "a", F.explode(F.sequence(F.lit(0), F.lit(other - 1))))

    n_test = (test_ids if test_ids is not None else test).select("id").distinct().count()
    n_train = (train_ids if train_ids is not None else train).select("id").distinct().count()
    def blocks(n: int, tile: int) -> int:
        return max(1, -(-n // KNN_BLOCK), min(KNN_BLOCKS, -(-n // tile)))

    na, nb = blocks(n_test, TEST_BLOCK), blocks(n_train, TRAIN_BLOCK)

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _best_of_block(left, right, k)

    pairs = packed(test, test_ids, "a", na, nb).groupBy("a", "b").cogroup(
        packed(train, train_ids, "b", nb, na).groupBy("a", "b")).applyInPandas(best, "id long, nid long, sim double")
    w = Window.partitionBy("id").orderBy(F.col("sim").desc(), "nid")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_vote(neigh: DataFrame, train_labels: DataFrame, label_col: str = "label") -> DataFrame:
    """Majority vote of the neighbours' labels; ties to the lowest label."""
    lab = train_labels.select(F.col("id").alias("nid"), F.col(label_col).alias("c"))
    votes = neigh.join(lab, "nid").groupBy("id", "c").agg(F.count(F.lit(1)).alias("score"))
    return argmax(votes)


# --- E1-E6 evaluation ----------------------------------------------------------------------------
def accuracy(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """E1 (+E6): accuracy, right and wrong counts (J11: joined on id)."""
    j = pred.join(truth, "id")
    return j.agg(F.count(F.lit(1)).alias("n"),
                 F.sum((F.col("prediction") == F.col("label")).cast("int")).cast("bigint").alias("n_right"),
                 F.sum((F.col("prediction") != F.col("label")).cast("int")).cast("bigint").alias("n_wrong"),
                 F.round(F.avg((F.col("prediction") == F.col("label")).cast("double")), 6).alias("accuracy"))


def confusion(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Confusion counts (label, prediction, n) in long form."""
    return pred.join(truth, "id").groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def classification_report(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class (0 where undefined)."""
    j = pred.join(truth, "id")
    tp = j.where(F.col("prediction") == F.col("label")).groupBy(F.col("label").alias("c")).agg(
        F.count(F.lit(1)).alias("tp"))
    sup = j.groupBy(F.col("label").alias("c")).agg(F.count(F.lit(1)).alias("support"))
    npred = j.groupBy(F.col("prediction").alias("c")).agg(F.count(F.lit(1)).alias("npred"))
    r = sup.join(npred, "c", "full").join(tp, "c", "left").fillna(0, ["tp", "support", "npred"])
    prec = F.when(F.col("npred") > 0, F.col("tp") / F.col("npred")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return r.select(F.col("c").alias("label"), F.round(prec, 6).alias("precision"), F.round(rec, 6).alias("recall"),
                    F.round(f1, 6).alias("f1"), F.col("support").cast("bigint").alias("support"))


def report_averages(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """The plain mean over the classes, and the mean weighted by support, of
    precision, recall and F1."""
    j = pred.join(truth, "id")
    hit = (F.col("label") == F.col("prediction")).cast("long")
    by = j.groupBy(F.col("label").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("tp"))
    said = j.groupBy(F.col("prediction").alias("c")).agg(F.count(F.lit(1)).alias("np"))
    k = by.join(said, "c", "full").fillna(0, ["n", "tp", "np"])
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    k = k.select("n", share(F.col("tp"), F.col("np")).alias("precision"), share(F.col("tp"), F.col("n")).alias("recall"),
                 share(2 * F.col("tp"), F.col("n") + F.col("np")).alias("f1"))
    names, total = ("precision", "recall", "f1"), F.sum("n").cast("bigint").alias("support")
    plain = k.agg(*[F.round(F.avg(c), 6).alias(c) for c in names], total)
    weighted = k.agg(*[F.round(F.sum(F.col(c) * F.col("n")) / F.sum("n"), 6).alias(c) for c in names], total)
    return plain.select(F.lit("macro avg").alias("average"), "*").unionByName(weighted.select(F.lit("weighted avg").alias("average"), "*"))


def top_terms_per_class(weights: DataFrame, k: int = 10) -> DataFrame:
    """The k highest-weight terms per class (ties: lower term);
    groups are classes but the window keeps only k rows per task before the
    shuffle (group limit)."""
    w = Window.partitionBy("c").orderBy(F.col("weight").desc(), "term")
    return weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def coefficient_density(weights: DataFrame, n_features: int) -> DataFrame:
    """Coefficient count and non-zero share per class."""
    return weights.groupBy("c").agg(
        F.count(F.when(F.col("weight") != 0, 1)).alias("nnz"),
        F.round(F.count(F.when(F.col("weight") != 0, 1)) / F.lit(float(n_features)), 6).alias("density"))

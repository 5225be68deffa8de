"""What has no limit: long chains, equal points, wide matrices, many rows of one key."""

import random

import numpy as np
from pyspark.sql import functions as F

from tagweave.functions import text as T
from tagweave.operators import classify as C
from tagweave.operators import cluster as CL
from tagweave.operators import mllib as ML
from tagweave.operators import reactions as RX
from tagweave.operators import spread as SP
from tagweave.operators import vectors as V


def test_chain_of_500_hops_is_one_component(spark):
    edges = [(i, i + 1) for i in range(500)] + [(1000, 1001)]
    nodes = spark.createDataFrame([(i,) for i in [*range(501), 1000, 1001, 2000]], "id long")
    got = dict(tuple(r) for r in CL.connected_components(nodes, spark.createDataFrame(edges, "i long, j long")).collect())
    assert got == {i: 0 for i in range(501)} | {1000: 1000, 1001: 1000, 2000: 2000}


def test_dbscan_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 6)) ** 2
    pts = [np.abs(centres[i % 4] + rng.normal(scale=0.35, size=6)) for i in range(60)]
    pts += [pts[0]] * 6 + [rng.random(6) * np.eye(6)[i % 6] + 0.01 for i in range(6)]
    x = np.array([p / np.linalg.norm(p) for p in pts])
    rows = [(i, f"t{j}", float(v)) for i, p in enumerate(x) for j, v in enumerate(p)]
    ids = spark.createDataFrame([(i,) for i in range(len(x) + 2)], "id long")     # two without a vector
    eps, least = 0.03, 5
    got = dict(tuple(r) for r in CL.dbscan(spark.createDataFrame(rows, "id long, term string, value double"), eps, least, ids).collect())
    near = x @ x.T >= 1 - eps - 1e-12
    core = near.sum(axis=1) >= least
    comp = {i: i for i in range(len(x)) if core[i]}
    for _ in range(len(x)):
        for i in comp:
            comp[i] = min(comp[j] for j in comp if near[i, j])
    label = {c: k for k, c in enumerate(sorted(set(comp.values())))}
    want = {i: label[comp[i]] if core[i] else min((label[comp[j]] for j in comp if near[i, j]), default=-1) for i in range(len(x))}
    assert got == want | {len(x): -1, len(x) + 1: -1}
    assert len(set(want.values())) >= 3 and -1 in want.values()


def test_threshold_clusters_do_not_depend_on_groups_alone(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        rows += [(i, f"c{i % 3}", 1.0), (i, f"n{rng.randrange(40)}", 0.1)]
    x = spark.createDataFrame(rows, "id long, term string, value double")
    x = V.l2_normalize(x)
    ids = spark.createDataFrame([(i,) for i in range(61)], "id long")
    for rows_a_group in (1000, 7):
        got = {r["id"]: r["label"] for r in CL.threshold_clustering(x, 0.3, rows_a_group, ids).collect()}
        assert len(got) == 61
        assert all((got[i] == got[j]) == (i % 3 == j % 3) for i in range(60) for j in range(60))


def test_knn_is_the_same_for_any_partitioning(spark):
    rng = np.random.default_rng(1)
    def table(n, first):
        rows = [(first + i, f"t{j}", float(v)) for i in range(n) for j, v in enumerate(rng.integers(0, 3, 8)) if v]
        return V.l2_normalize(spark.createDataFrame(rows, "id long, term string, value double"))
    test, train = table(30, 0).cache(), table(80, 100).cache()
    want = None
    for parts in (1, 8, 64):
        for blocks in ((512, 2048), (7, 13)):
            C.TEST_BLOCK, C.TRAIN_BLOCK = blocks
            got = sorted(map(tuple, C.knn_cosine(test.repartition(parts), train.repartition(parts), 5).collect()))
            want = want or got
            assert got == want
    C.TEST_BLOCK, C.TRAIN_BLOCK = 512, 2048
    assert len(want) == 30 * 5


def test_prediction_shares_do_not_change_answers(spark, monkeypatch):
    rng = np.random.default_rng(4)
    nodes = spark.createDataFrame([(b, i, 10 + i % 2, rng.random(3).tolist()) for b in range(2) for i in range(8)],
                                  "bag_id int, id long, label int, vec array<double>").cache()
    rows = spark.createDataFrame([(b, 100 + i, rng.random(3).tolist()) for b in range(2) for i in range(50)],
                                 "bag_id int, id long, vec array<double>").cache()
    p = SP.SpreadParams(gamma=1.0)
    dist = SP.fit_bags(nodes, [10, 11], p)
    one = sorted(map(tuple, SP.predict_bags(rows, nodes, dist, [10, 11], p).collect()))
    monkeypatch.setattr(SP, "ROWS_PER_SHARE", 7)
    assert sorted(map(tuple, SP.predict_bags(rows, nodes, dist, [10, 11], p).collect())) == one and len(one) == 100


def test_wide_svd_goes_to_the_distributed_form(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.random((30, 6))
    rows = spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(x) for j, v in enumerate(r)], "id long, term int, value double")
    _, a = V.truncated_svd(rows, 6, 2)
    monkeypatch.setattr(V, "MAX_GRAM_DIM", 4)
    _, b = V.truncated_svd(rows, 6, 2)
    assert np.abs(a - b).max() < 1e-6


def test_class_folders_keep_every_document(spark, tmp_path):
    docs = spark.createDataFrame([(f"line 1\nline {i}\n\n", "ab"[i % 2]) for i in range(50)], "text string, cls string").repartition(3)
    ML.write_class_folders(docs, "text", "cls", str(tmp_path / "f"))
    back = ML.read_class_folders(spark, str(tmp_path / "f"))
    assert sorted((r["text"], r["class_name"], r["class_id"]) for r in back.collect()) == sorted(
        (r["text"], r["cls"], "ab".index(r["cls"])) for r in docs.collect())
    (tmp_path / "g" / "x").mkdir(parents=True)
    (tmp_path / "g" / "x" / "1.txt").write_text("a\nb")
    (tmp_path / "g" / "x" / "2.txt").write_text("c")
    assert sorted(r["text"] for r in ML.read_class_folders(spark, str(tmp_path / "g"), whole_files=True).collect()) == ["a\nb", "c"]


def test_running_index_past_100000_comments(spark):
    c = spark.range(120_000).select(F.lit(1).cast("long").alias("post_id"), F.col("id").alias("o"))
    r = RX.running_index(c, "post_id", ["o"])
    assert r.agg(F.count_distinct(F.struct("post_id", "c")), F.max("c")).first()[:] == (120_000, 119_999)


def test_online_learner_in_any_number_of_shards(spark):
    rng = np.random.default_rng(6)
    rows = [(i, int(i % 2), [0, 1 + i % 2], [1.0, float(rng.random() + 1)]) for i in range(60)]
    x = spark.createDataFrame(rows, "id long, y int, idx array<int>, val array<double>")
    for shard_rows in (5000, 10):
        w = ML.fit_online(x, 2, 3, ML.OnlineParams(n_iter=20, shard_rows=shard_rows))
        pred = ML.predict_online(x, w).join(x.select("id", "y"), "id")
        assert ML.accuracy(pred) == 1.0


def test_cleaning_rules(spark):
    def one(col, text):
        return spark.createDataFrame([(text,)], "t string").select(col(F.col("t"))).first()[0]
    assert one(T.strip_header, "a: b\n\nbody\n\nmore") == "body\n\nmore" and one(T.strip_header, "no blank line\nhere") == ""
    assert one(T.strip_footer, "text\nmore\n--\nBob") == "text\nmore" and one(T.strip_footer, "text\n\nBob\n") == "text"
    assert one(T.strip_footer, "one line") == "one line" and one(T.strip_footer, "---\nx") == "---\nx"
    assert one(T.strip_quotes, "keep\n> q\n| q\nBob writes in x\nAnn says: hi\nIn article 5\nx In article\nB wrote: y") == "keep\nx In article"
    assert one(T.html_unescape, "&#65;&#x42;&amp;#67; &lt;b&gt; &hellip;&#0;&#1114112;") == "AB&#67; <b> …"


def test_grid_search_counts_its_vocabulary(spark):
    """All n-grams of three documents that 95 % at most have, without collisions."""
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(["common", "rare" if i < 2 else "often", "good" if i % 2 else "bad", *(words if i < 6 else [])]) for i in range(20)]
    train = spark.createDataFrame([(i, t, float(i % 2)) for i, t in enumerate(texts)], "id long, text string, y double")
    cv = ML.grid_search_ngrams(train.coalesce(1), folds=2)
    vocabulary = next(s.vocabulary for s in cv.bestModel.stages if hasattr(s, "vocabulary"))
    assert {w for w in vocabulary if " " not in w} == {*words, "often", "good", "bad"}
    assert len(cv.avgMetrics) == 2

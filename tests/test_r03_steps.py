"""Steps shared by several queries: inputs are read once, results stay exact."""

import numpy as np
from pyspark.sql import functions as F

from tagweave.operators import cluster as CL
from tagweave.operators import tokenize as TK
from tagweave.operators import vectors as V


def counted(df):
    """``df`` and an accumulator of the rows that are read from it."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(len(b))
            yield b
    return df.mapInPandas(run, df.schema), seen


def test_tokenize_reads_texts_once(spark):
    d, seen = counted(spark.createDataFrame([(i, f"boxes and dogs dog at site{i}.example.org") for i in range(20)], "id long, text string"))
    got = TK.collect_tokens(TK.tokenize(d, "id", "text", short_url=True)).where("id = 3").first()["tokens"]
    assert "dog" in got and "site3.example.org" in got and "dogs" not in got
    assert seen.value == 20


def test_similarity_join_shuffles_no_products(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.random((60, 12)) * (rng.random((60, 12)) < 0.4)
    x[7] = x[3]
    x = x[x.any(axis=1)]
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    rows = spark.createDataFrame([(i, f"t{j}", float(x[i, j])) for i, j in zip(*(c.tolist() for c in np.nonzero(x)))], "id long, term string, value double")
    monkeypatch.setattr(CL, "JOIN_ROWS", 7)
    pairs = CL.similarity_join(rows, 0.5)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    s = x @ x.T
    assert {(r["i"], r["j"]) for r in pairs.collect()} == {(i, j) for i, j in zip(*np.nonzero(s >= 0.5 - 1e-12)) if i != j}
    assert all(abs(r["sim"] - s[r["i"], r["j"]]) < 1e-9 for r in pairs.collect())


def test_frequent_gram_counts_equal_all_counts(spark):
    rows = spark.createDataFrame([(1, "a b c a b".split()), (2, "a b c".split()), (3, "c a b".split()), (4, []), (5, ["b"])], "id long, w array<string>")
    from tagweave.functions import text as T
    tf = V.term_counts(rows.select("id", T.word_ngrams(F.col("w"), 1, 3).alias("g")), "id", "g")
    want = V.filter_df(tf, 5, min_df=2)
    got, df = V.frequent_gram_counts(rows, "id", "w", 3, 2)
    assert sorted(map(tuple, got.select("id", "term", "tf").collect())) == sorted(map(tuple, want.select("id", "term", "tf").collect()))
    assert {r["term"]: r["df"] for r in df.collect()} == {"a": 3, "b": 4, "c": 3, "a b": 3, "b c": 2, "c a": 2, "a b c": 2, "c a b": 2}


class FakeTables:
    """Tables whose views give the frames it is made of."""

    def __init__(self, **views):
        self.views = type("Views", (), {k: staticmethod(lambda v=v: v) for k, v in views.items()})


def test_corpus_features_reads_texts_once(spark):
    from tagweave.plans import q_models as Q
    rows = [(i, ("alpha beta " if i % 2 else "gamma delta ") * (1 + i % 3), "ab"[i % 2], "test" if i % 5 == 0 else "train") for i in range(30)]
    corpus, seen = counted(spark.createDataFrame(rows, "doc_id long, text string, category string, subset string"))
    pred, _ = Q.mnb_predictions(FakeTables(corpus=corpus))
    assert {r["id"]: r["prediction"] for r in pred.collect()} == {i: "ab"[i % 2] for i in range(0, 30, 5)}
    assert seen.value == 60         # once for the words, once for classes and subsets


def test_reaction_lines_read_comments_once(spark):
    from tagweave.plans import q_models as Q
    line = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"
    comments, seen = counted(spark.createDataFrame(
        [(i % 4, "page0", f'{{"message": "{line} {i}\\\\n{line} zulu {i}"}}') for i in range(40)], "post_id long, page string, comment string"))
    reactions = spark.createDataFrame([(p, k, Q.PAGE) for p in range(4) for k in ("LOVE", "WOW") for _ in range(2 + p)], "post_id long, type string, page string")
    hits, tst = Q.reaction_predictions(FakeTables(comments=comments, reactions=reactions))
    assert hits.count() == 5 * tst.count() > 0
    assert seen.value == 40


def test_knn_by_tiles_equals_brute_force(spark, monkeypatch):
    from tagweave.operators import classify as C
    for name, size in (("TEST_BLOCK", 3), ("TRAIN_BLOCK", 4), ("KNN_BLOCK", 9)):
        monkeypatch.setattr(C, name, size)
    rng = np.random.default_rng(5)
    x = rng.random((40, 8)) * (rng.random((40, 8)) < 0.5)
    x[30] = x[31] = x[32]
    rows = spark.createDataFrame([(i, j, float(x[i, j])) for i, j in zip(*(c.tolist() for c in np.nonzero(x)))], "id long, term int, value double")
    ids = spark.createDataFrame([(i,) for i in range(40)], "id long")
    test, train = F.col("id") < 11, F.col("id") >= 11
    got = C.knn_cosine(rows.where(test), rows.where(train), 5, ids.where(test), ids.where(train)).collect()
    want = {(i, int(n), r + 1) for i in range(11) for r, n in enumerate(11 + np.lexsort((np.arange(11, 40), -np.round(x[11:] @ x[i], 9)))[:5])}
    assert {(r["id"], r["nid"], r["rank"]) for r in got} == want


def test_gram_matrix_of_groups_keeps_only_pairs_that_meet(spark):
    rows = [("g", 1, 2, 1.0), ("g", 1, 5, 2.0), ("g", 2, 5, -2.0), ("g", 2, 2, 1.0), ("h", 1, 9, 3.0), ("h", 2, 2, 0.0)]
    x = spark.createDataFrame(rows, "b string, id long, term int, value double").repartition(1)
    got = {(r["b"], r["i"], r["j"]): r["g"] for r in V.gram_matrix(x, ["b"]).collect()}
    assert got == {("g", 2, 2): 2.0, ("g", 2, 5): 0.0, ("g", 5, 2): 0.0, ("g", 5, 5): 8.0, ("h", 9, 9): 9.0, ("h", 2, 2): 0.0}


def test_a_round_of_parameter_mixing_shuffles_no_rows(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors
    from pyspark.sql import GroupedData
    from tagweave.operators import mllib as ML
    plans, apply = [], GroupedData.applyInPandas

    def spied(self, fn, schema):
        out = apply(self, fn, schema)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(GroupedData, "applyInPandas", spied)
    data = spark.createDataFrame([(i, Vectors.sparse(2, {i % 2: 1.0}), float(i % 2)) for i in range(40)], ["id", "features", "y"])
    w = ML.fit_online(data, 2, 2, ML.OnlineParams(n_iter=3, shard_rows=10))
    assert not any("Exchange" in p for p in plans)
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0]


def test_threshold_clustering_merges_what_the_rule_admits(spark):
    """Copies in different hash groups meet, whatever the number of groups, and no level looks at all summaries by chance."""
    from tagweave.operators import cluster as CL
    rows = [(i, f"t{i % 40}", 1.0) for i in range(80)] + [(80, "t0", 0.6), (80, "u", 0.8)]
    x = spark.createDataFrame(rows, "id long, term string, value double")
    ids = spark.createDataFrame([(i,) for i in range(83)], "id long")
    got = {r["id"]: r["label"] for r in CL.threshold_clustering(x, 0.1, group_rows=2, ids=ids).collect()}
    assert got == {i: i % 40 for i in range(80)} | {80: 40, 81: 41, 82: 41}


def test_nearest_lists_and_bounds(spark):
    """The nearest vectors over several blocks, as by brute force; ties go to the smallest key."""
    import numpy as np
    from tagweave.operators import cluster as CL
    rng = np.random.default_rng(4)
    m = rng.integers(0, 3, (60, 6)).astype(float)
    m[10:14] = m[10]
    rows = [(f"k{i:02d}", [int(j) for j in np.flatnonzero(m[i])], [float(v) for v in m[i][m[i] > 0]]) for i in range(60)]
    x = spark.createDataFrame(rows, "key string, t array<long>, v array<double>")
    old = CL.JOIN_ROWS, CL.JOIN_BLOCK
    CL.JOIN_ROWS, CL.JOIN_BLOCK = 7, 13
    try:
        got = {r["key"]: r for r in CL._nearest(x, x, False, 4).collect()}
        one = {r["key"]: r["near"][0]["near"] for r in CL._nearest(x, x, True, 1).collect()}
    finally:
        CL.JOIN_ROWS, CL.JOIN_BLOCK = old
    d = (m * m).sum(1)[None, :] - 2 * m @ m.T
    for i in range(60):
        want = sorted((round(float(d[i, j]), 9), f"k{j:02d}") for j in range(60) if j != i)
        r = got[f"k{i:02d}"]
        assert (r["near"][0]["d"], r["near"][0]["near"]) == want[0]
        assert [e["d"] for e in r["near"]] == [e[0] for e in want[:4]] and r["bound"] == want[3][0]
        near = sorted((round(float(d[i, j]), 9), f"k{j:02d}") for j in range(60) if (m @ m.T)[i, j])
        assert one.get(f"k{i:02d}") == (near[0][1] if near else None)

"""Steps that took the time of the fourth review: less work, the same rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tagweave.operators import cluster as CL
from tagweave.operators import tokenize as TK
from tagweave.operators import vectors as V


def sparse_units(seed: int, n: int, terms: int, size: int):
    """n random unit vectors of ``size`` terms at most, every tenth a near copy of the one before."""
    rng = np.random.default_rng(seed)
    x = np.zeros((n, terms))
    for i in range(n):
        x[i, rng.choice(terms, rng.integers(1, size), replace=False)] = 1.0
        x[i] *= rng.random(terms) + 0.1
        if i % 10 == 9:
            x[i] = x[i - 1] * (1 + 0.05 * rng.random(terms))
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def packed(x, ids, seed: int = 5):
    t = np.random.default_rng(seed).integers(-2 ** 62, 2 ** 62, x.shape[1])
    return pd.DataFrame({"id": ids, "t": [t[np.flatnonzero(r)] for r in x], "v": [r[r != 0] for r in x]})


def test_join_multiplies_only_what_the_fold_leaves(monkeypatch):
    x = sparse_units(1, 600, 3000, 30)
    s = x @ x.T
    seen, products = [], CL._products
    monkeypatch.setattr(CL, "_products", lambda a, i, j, *rest: seen.append(len(i)) or products(a, i, j, *rest))
    for rows, fold, cost in ((1024, 1024, 400), (70, 64, 400), (70, 1, 400), (70, 1, 0), (7, 1024, 10 ** 9)):
        monkeypatch.setattr(CL, "JOIN_ROWS", rows), monkeypatch.setattr(CL, "FOLD", fold), monkeypatch.setattr(CL, "FOLD_COST", cost)
        seen.clear()
        ids = np.arange(600) * 3
        own = CL._block_pairs(0.5)((0, 0), packed(x, ids), packed(x, ids))
        assert {(i // 3, j // 3) for i, j in zip(own["i"], own["j"])} == {(i, j) for i, j in zip(*np.nonzero(s >= 0.5 - 1e-12)) if i < j}
        assert all(abs(v - s[i // 3, j // 3]) < 1e-9 for i, j, v in zip(own["i"], own["j"], own["sim"]))
        if fold == 1024 and cost == 400:
            assert sum(seen) < 0.02 * 600 * 600
        other = CL._block_pairs(0.5)((0, 1), packed(x[:200], ids[:200]), packed(x[200:], ids[200:]))
        assert {(i // 3, j // 3) for i, j in zip(other["i"], other["j"])} == {(i, j) for i, j in zip(*np.nonzero(s >= 0.5 - 1e-12)) if i < 200 <= j}


def test_word_tokens_equal_the_runs_between_gaps(spark):
    texts = ["", "  ", "a b", "(x) [y], z.. ...", "don't we'll it's näh  end last", "\U0001F600 q\x0bw\x1ce\x85r", None, ",,a,,b,,"]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    runs = F.transform(F.regexp_extract_all(TK.split_clitics(F.col("text")), F.lit(TK.TOKEN_RUN), F.lit(0)), lambda x: F.regexp_replace(x, r"\.+$", ""))
    for r in d.select(TK.word_tokens(F.col("text")).alias("got"), runs.alias("want")).collect():
        assert r["got"] == r["want"]


def test_gram_counts_are_not_joined(spark, monkeypatch):
    """Rows of one id, without id, without words; more rows than are numbered at once."""
    monkeypatch.setattr(V, "GRAM_ROWS", 2)
    rng = np.random.default_rng(4)
    data = [(int(i) if i % 7 else None, [f"w{k}" for k in rng.integers(0, 5, rng.integers(0, 9))]) for i in range(40)] + [(1, None), (1, []), (1, ["w0", "w1"])]
    rows = spark.createDataFrame(data, "id long, w array<string>")
    from tagweave.functions import text as T
    got, df = V.frequent_gram_counts(rows, "id", "w", 3, 6.5)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    key = rows.withColumn("id", F.monotonically_increasing_id()).select("id", T.word_ngrams(F.coalesce("w", F.array().cast("array<string>")), 1, 3).alias("g"))
    held = {r["term"]: r["df"] for r in V.document_frequency(V.term_counts(key, "id", "g")).where("df >= 6.5").collect()}
    assert {r["term"]: r["df"] for r in df.collect()} == held and len(held) > 6
    tf = V.term_counts(rows.select("id", T.word_ngrams(F.col("w"), 1, 3).alias("g")), "id", "g").collect()
    order = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, got.select("id", "term", "tf").collect()), key=order) == sorted((tuple(r) for r in tf if r["term"] in held), key=order)
    none, no_terms = V.frequent_gram_counts(rows, "id", "w", 3, 1000)
    assert none.count() == 0 and no_terms.count() == 0


def test_token_report_reads_the_tokens_once(spark, tables, monkeypatch):
    from tagweave.plans import q_cluster as Q
    calls, tokens = [], Q.english_tokens
    monkeypatch.setattr(Q, "english_tokens", lambda *a: calls.append(a) or tokens(*a))
    assert Q.g8_f12_token_histogram(tables).count() > 0
    assert len(calls) == 1


def test_knn_multiplies_only_possible_neighbours(monkeypatch):
    from tagweave.operators import classify as C
    x = sparse_units(2, 400, 900, 25)
    x[5], x[6] = 0, 0                         # no terms at all
    x[7] = 0
    x[7, 899] = 1.0                           # a term that few rows have
    for rows, head, products, sign in ((64, 40, 50, False), (1000, 1024, 1 << 22, False), (64, 8, 1 << 22, True), (7, 1, 3, False)):
        y = x * np.where(np.arange(900) % 3 == 0, -1.0, 1.0) * np.where(np.arange(400) % 2 == 0, -1.0, 1.0)[:, None] if sign else x
        for name, v in (("TEST_BLOCK", rows), ("TRAIN_BLOCK", rows), ("KNN_HEAD", head), ("KNN_PRODUCTS", products)):
            monkeypatch.setattr(C, name, v)
        seen, exact = [], C._products
        monkeypatch.setattr(C, "_products", lambda a, i, *rest: seen.append(len(i)) or exact(a, i, *rest))
        ids = np.arange(400) * 2
        pack = lambda z, i: packed(z, i).assign(**{c: [np.asarray(v)[np.argsort(t)] for t, v in zip(p["t"], p[c])] for p in [packed(z, i)] for c in ("t", "v")})
        got = C._best_of_block(pack(y[:100], ids[:100]), pack(y[100:], ids[100:]), 5)
        s = np.round(y[:100] @ y[100:].T, 9)
        s[s <= 1e-12] = 0.0
        for q in range(100):
            order = np.argsort(-s[q], kind="stable")[:5]
            own = got[got["id"] == 2 * q]
            assert own["nid"].tolist() == (200 + 2 * order).tolist() and np.allclose(own["sim"], s[q][order], atol=1e-9)
        if not sign and rows >= 64:
            assert sum(seen) < 0.1 * 100 * 300
        monkeypatch.setattr(C, "_products", exact)


def test_knn_adds_up_repeated_terms():
    from tagweave.operators import classify as C
    left = pd.DataFrame({"id": [1], "t": [np.array([3, 3, 8])], "v": [np.array([0.2, 0.3, 0.5])]})
    right = pd.DataFrame({"id": [4, 5, 6], "t": [np.array([3, 8, 8]), None, np.array([9])], "v": [np.array([0.4, 0.1, 0.2]), None, np.array([1.0])]})
    got = C._best_of_block(left, right, 2)
    assert got.values.tolist() == [[1, 4, 0.35], [1, 5, 0.0]]


def test_sparse_rows_cost_their_entries(spark):
    """A vector of 2^30 numbers is never laid out; explicit zeros, dense and missing vectors."""
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql.types import LongType, StringType, StructField, StructType
    from tagweave.operators import mllib as ML
    rows = [(1, "a", Vectors.sparse(1 << 30, {7: 2.0, 1 << 29: -1.5})), (2, None, Vectors.dense([0.0, 3.0, 0.0, 4.0])), (None, "c", Vectors.sparse(9, [1, 3], [0.0, 5.0])),
            (4, "d", None), (5, "e", Vectors.sparse(9, {})), (6, "f", Vectors.dense([float("nan")]))]
    x = spark.createDataFrame(rows, StructType([StructField("id", LongType()), StructField("y", StringType()), StructField("features", VectorUDT())]))
    got = [tuple(r) for r in ML.sparse_rows(x.coalesce(1), "y").collect()]
    assert got[:5] == [(1, "a", [7, 1 << 29], [2.0, -1.5]), (2, None, [1, 3], [3.0, 4.0]), (None, "c", [3], [5.0]), (4, "d", None, None), (5, "e", [], [])]
    assert got[5][2] == [0] and np.isnan(got[5][3][0])


def test_changes_are_added_up_as_arrays(spark):
    """A table's changes are a few rows whatever its size, added in order of the numbers."""
    from tagweave.operators import mllib as ML
    rng = np.random.default_rng(6)
    tables = [rng.normal(size=5000) * (rng.random(5000) < 0.3) for _ in range(12)]
    assert all(ML.split_entries(t).num_rows <= ML.WEIGHT_PARTS for t in tables)
    made = spark.createDataFrame([(i,) for i in range(12)], "n int").repartition(5).mapInArrow(
        lambda batches: (ML.split_entries(tables[n]) for b in batches for n in b.column("n").to_pylist()), ML.ENTRIES)
    key, d = ML.add_up(made)
    got = np.zeros(5000)
    got[key] = d
    want = np.zeros(5000)
    for row in np.sort(np.array(tables), axis=0):
        want += row
    assert (got == want).all() and len(np.unique(key)) == len(key)
    none = ML.add_up(made.where("part < 0"))
    assert len(none[0]) == len(none[1]) == 0


def test_post_of_a_line_reads_the_comments_once(spark):
    from tagweave.plans import q_mllib as Q
    from test_r03_steps import FakeTables, counted
    words = ["red green blue", "one two three", "cat dog bird"]
    data = [(i % 3, '{"message": "%s\\n%s %d"}' % (words[i % 3], words[i % 3], i)) for i in range(45)]
    comments, seen = counted(spark.createDataFrame(data, "post_id long, comment string"))
    got = Q.m23_post_id_perceptron(FakeTables(comments=comments)).collect()
    assert got and sum(r["label"] == r["prediction"] for r in got) > 0.9 * len(got)
    assert seen.value == 45

"""Rounds and samples that read no more than they need."""

import numpy as np
from pyspark.sql import functions as F

from tagweave.operators import lens as L
from tagweave.operators import sampling as S
from tagweave.operators import vectors as V


def test_pca_rounds_make_no_tables_on_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(5)
    dense = (rng.random((50, 30)) < 0.25) * rng.integers(1, 4, (50, 30)) * np.linspace(3, 1, 30)
    dense[7] = 0                # a row that is known, without a value
    rows = [(i, int(j), float(dense[i, j])) for i in range(50) for j in np.nonzero(dense[i])[0]] + [(7, 3, None)]
    x = spark.createDataFrame(rows, "id long, term int, value double").repartition(5)

    def fail(*a, **k):
        raise AssertionError("a round sends rows from the driver")
    monkeypatch.setattr(type(spark), "createDataFrame", fail)
    comps, mu, var = V.pca_sparse(x, 30, 3, rounds=200, tol=1e-9)
    centred = dense - dense.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(mu, dense.mean(axis=0))
    assert np.allclose(var, s[:3] ** 2 / 49, rtol=1e-6)
    assert np.allclose(np.abs((vt[:3] @ comps).diagonal()), 1, atol=1e-6)


def test_only_sampled_documents_get_a_fingerprint(spark):
    seen = spark.sparkContext.accumulator(0)

    def print_of(text):
        seen.add(1)
        return [len(text)]
    made = F.udf(print_of, "array<int>")
    docs = spark.createDataFrame([(i, f"text number {i} " * 9) for i in range(600)], "i long, t string").persist()
    one = lambda **c: docs.select(*[v.alias(k) for k, v in c.items()])
    i, t = F.col("i"), F.col("t")

    class Views:
        data = staticmethod(lambda: one(id=i, source_id=F.lit(1)))
        source = staticmethod(lambda: spark.createDataFrame([(1,)], "id int"))
        text = staticmethod(lambda: one(id=i + 1000, data_id=i, text=t))
        language = staticmethod(lambda: one(data_id=i, language=F.lit("en")))
        time = staticmethod(lambda: one(data_id=i, time=F.timestamp_seconds(i)))
        tagging = staticmethod(lambda: one(data_id=i, tag_id=(10 + i % 2).cast("int")).where("data_id < 100"))
        tag_tagset = staticmethod(lambda: spark.createDataFrame([(10, 1), (11, 1)], "tag_id int, tagset_id int"))
        translation = staticmethod(lambda: one(text_id=i + 1000, target_language=F.lit("en"), translation=F.lit("")).where("text_id < 0"))
        fingerprint = staticmethod(lambda: one(data_id=i, fingerprint=made(t)))

    got = S.semi_supervised_sample(Views, 1, [1], ["en"], 5, 8, 1, n_bags=2).collect()
    assert len(got) == 2 * (2 * 5 + 8) and all(r["fingerprint"] == [len(r["text"])] for r in got)
    assert seen.value <= len(got)


def test_lens_projects_fingerprints_as_the_dense_product(spark):
    rng = np.random.default_rng(2)
    entries = [(np.full(n, L.FP), rng.integers(0, 40, n), np.ones(n)) for n in (0, 5, 9, 30, 1)]
    raw = L.raw_blocks(entries, L.FeatureParams())
    terms, basis = np.arange(3, 33, 2), rng.normal(size=(15, 4))
    assert np.allclose(L._projected(terms, basis, raw, 5), L._at(terms, raw, 5) @ basis)
    assert not L._projected(terms[:0], basis[:0], raw, 5).any()

"""End-to-end lens, language id quality, persistence and streaming parity."""

import tempfile

from pyspark.sql import functions as F

from tagweave.functions.hashing import hash01
from tagweave.operators import language as LG
from tagweave.operators import lens as L
from tagweave.operators import spread as SP
from tagweave.streaming import features as ST


def test_language_id_quality_and_unknown(spark):
    from tagweave.sources.tables import Tables
    t = Tables(spark, "/root/testdata/sf0.01")
    d = t.documents
    model = LG.fit(d.where(hash01(11, 0, F.col("doc_id")) < 0.75), "doc_id", "text", "lang")
    held = d.where(hash01(11, 0, F.col("doc_id")) >= 0.75)
    acc = LG.detect(held, "doc_id", "text", model).join(held.select("doc_id", "lang"), "doc_id") \
        .agg(F.avg((F.col("lang_id") == F.col("lang")).cast("double"))).collect()[0][0]
    assert acc >= 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "\x7f\b")], "doc_id long, text string")
    assert {r["lang_id"] for r in LG.detect(odd, "doc_id", "text", model).collect()} == {"un"}


def test_lens_train_persist_load_predict(spark, tables):
    lens = L.flagship_lens(tables.views, 1, list(range(10)), ["en", "de"], [10, 11], 2, 16, 32, 1,
                           L.FeatureParams(tokens_k=5, emoji_k=2, punct_k=2, fp_k=3), SP.SpreadParams(gamma=1.0))
    dist = L.distributions(lens).groupBy("bag_id", "id").agg(F.sum("p").alias("s")).collect()
    assert all(abs(r["s"] - 1.0) < 1e-9 or r["s"] == 0.0 for r in dist)
    root = tempfile.mkdtemp(prefix="lens-")
    L.persist(lens, root, "m1", {"tagset_id": 1, "user_id": 1, "score": 0.5})
    back = L.load(spark, root, "m1")
    rows = tables.views.text().select(F.col("data_id").alias("id"), F.col("text").alias("sample_text")) \
        .join(tables.views.fingerprint().withColumnRenamed("data_id", "id"), "id") \
        .join(tables.views.time().withColumnRenamed("data_id", "id"), "id").orderBy("id").limit(30)
    a = {r["id"]: r["tag_id"] for r in L.predict(lens, rows)[1].collect()}
    b = {r["id"]: r["tag_id"] for r in L.predict(back, rows)[1].collect()}
    assert a == b and len(a) == 30
    # A second save is a new version, not twice the rows.
    L.persist(lens, root, "m1", {"tagset_id": 1, "user_id": 1, "score": 0.7})
    again = L.load(spark, root, "m1")
    assert again.bags.count() == lens.bags.count() == 2
    assert {r["id"]: r["tag_id"] for r in L.predict(again, rows)[1].collect()} == a
    try:
        L.load(spark, root, "missing")
        raise AssertionError("expected RuntimeError")
    except RuntimeError:
        pass


def test_stream_features_equal_batch(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    stream = ST.row_features(ST.read_table_stream(spark, "/root/testdata/sf0.001", "documents"))
    ST.run_available_now(stream, "doc_feats", tempfile.mkdtemp(prefix="stream-ckpt-"))
    got = sorted(map(tuple, spark.table("doc_feats").collect()))
    want = sorted(map(tuple, ST.row_features(spark.read.parquet(path)).collect()))
    assert got == want


def test_a_row_is_tagged_alone_in_a_batch_and_in_a_stream_alike(spark, tables):
    lens = L.flagship_lens(tables.views, 1, list(range(10)), ["en", "de"], [10, 11], 3, 16, 32, 1,
                           L.FeatureParams(tokens_k=5, emoji_k=2, punct_k=2, fp_k=3), SP.SpreadParams(gamma=1.0))
    t = tables
    rows = (t.views.text().select(F.col("data_id").alias("id"), F.col("text").alias("sample_text"))
            .join(t.views.fingerprint().withColumnRenamed("data_id", "id"), "id")
            .join(t.views.time().withColumnRenamed("data_id", "id"), "id").where("id < 40"))
    folder = tempfile.mkdtemp(prefix="rows-")
    rows.repartition(4).write.mode("overwrite").parquet(folder)
    rows = spark.read.parquet(folder)
    batch = {r["id"]: (r["tag_id"], round(r["score"], 9)) for r in L.predict(lens, rows)[1].collect()}
    for i in sorted(batch)[:3]:
        one = L.predict(lens, rows.where(F.col("id") == i))[1].first()
        assert (one["tag_id"], round(one["score"], 9)) == batch[i]
    out = tempfile.mkdtemp(prefix="out-")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    ST.predict_stream(lens, stream, out, tempfile.mkdtemp(prefix="ckpt-")).awaitTermination()
    got = {r["id"]: (r["tag_id"], round(r["score"], 9)) for r in spark.read.parquet(out).collect()}
    assert got == batch


def test_lemma_table_of_the_lens_decides(spark):
    docs = spark.createDataFrame([(1, "two dogs barked", None, None), (2, "one dog", None, None)],
                                 "id long, sample_text string, fingerprint array<int>, time timestamp_ntz")
    lemmas = L.lemmas_of(docs)
    both = {r["id"]: r for r in L.row_entries(docs, lemmas, {L.TOKENS}).collect()}
    alone = L.row_entries(docs.where("id = 1"), lemmas, {L.TOKENS}).first()
    assert both[1] == alone and len(both) == 2


def test_prediction_in_several_bag_sets(spark, tables, monkeypatch):
    lens = L.flagship_lens(tables.views, 1, list(range(10)), ["en", "de"], [10, 11], 3, 16, 32, 1,
                           L.FeatureParams(tokens_k=5, emoji_k=2, punct_k=2, fp_k=3), SP.SpreadParams(gamma=1.0))
    rows = (tables.views.text().select(F.col("data_id").alias("id"), F.col("text").alias("sample_text"))
            .join(tables.views.fingerprint().withColumnRenamed("data_id", "id"), "id")
            .join(tables.views.time().withColumnRenamed("data_id", "id"), "id").where("id < 20"))
    one = sorted(map(tuple, L.predict(lens, rows)[0].collect()))
    monkeypatch.setattr(L, "BROADCAST_BYTES", 1)
    assert sorted(map(tuple, L.predict(lens, rows)[0].collect())) == one


def test_search_ranks_invalid_candidates_last(spark):
    res = spark.createDataFrame([(0, 0, float("nan"), 5), (0, 1, 0.9, 5), (1, 0, 0.5, 5), (1, 1, 0.7, 5)], L.SEARCH_SCHEMA)
    ranked = {r["cand"]: (r["score"], r["rank"]) for r in L.ranked_candidates(res).collect()}
    assert ranked == {1: (0.6, 1), 0: (None, 2)} and L.best_candidate(res).first()["cand"] == 1

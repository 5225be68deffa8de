import math
import struct
import zlib

import numpy as np
import xxhash

from tagweave.llm import language_id


def test_accuracy_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    x = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (x["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in x["doc_id"]]).all()
    test = x[x["held_out"]]
    assert (test["lang"] == test["lang_pred"]).mean() > 0.98
    assert x["score"].between(0, 1).all() and x["rejected"].mean() < 0.05


def test_edge_rows(edge_docs, edge_rows, no_docs):
    got = language_id.identify(edge_docs).collect()
    assert len(got) == len(edge_rows)
    by = {r["doc_id"]: r for r in got}
    for i in (4, 5, 6, 12):
        assert by[i]["lang_pred"] == "und" and by[i]["score"] == 0
    assert by[1]["lang_pred"] == by[2]["lang_pred"] != "und"
    assert language_id.identify(no_docs).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(docs).collect()} == {("und", 0.0)}


def test_prediction_uses_text_only(small):
    from pyspark.sql import functions as F
    model = language_id.learn(small)
    a = language_id.predict(small, model).select("lang_pred", "score").collect()
    other = small.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None)).withColumn("doc_id", -F.col("doc_id"))
    assert a == language_id.predict(other, model).select("lang_pred", "score").collect()


def test_far_text_is_rejected(small):
    model = language_id.learn(small)
    odd = small.sparkSession.createDataFrame([(1, "Жэз мы ща " * 50)], "doc_id long, text string")
    assert language_id.predict(odd, model).first()["rejected"]


def test_rerun_agrees(small):
    a, b = (sorted(language_id.identify(d).collect()) for d in (small, small.repartition(5)))
    assert [r[:3] for r in a] == [r[:3] for r in b] and max(abs(x[3] - y[3]) for x, y in zip(a, b)) < 1e-5


def plain_vector(text, idf, buckets):
    """TF-IDF of the hashed 1- to 3-grams by loops over characters; None without a letter."""
    low = (text or "").lower()
    flat = "".join(c if c.isalpha() else " " for c in low)
    if not flat.strip(" "):
        return None
    while "  " in flat:
        flat = flat.replace("  ", " ")
    flat = f" {flat} "
    counts, wrap = {}, 1 << 64
    for n in (1, 2, 3):
        for i in range(len(flat) - n + 1):
            g = ord(flat[i])
            for c in flat[i + 1:i + n]:
                g = (g * 0x100000001B3 + ord(c)) % wrap
            b = (((g + n) * 0x9E3779B97F4A7C15) % wrap >> 40) % buckets
            counts[b] = counts.get(b, 0) + 1
    if idf is None:
        return set(counts)
    v = np.zeros(buckets)
    for b, c in counts.items():
        v[b] = math.log(1 + c) * idf[b]
    return v / math.sqrt((v * v).sum())


def test_centroids_cosines_and_rejection_against_plain_numpy(small):
    """Document frequencies, sample, k-means, cosine and distance-based rejection, each computed anew."""
    buckets, sample, k, rounds = 512, 12, 3, 10
    model = language_id.learn(small, buckets=buckets, centroids=k, sample=sample, rounds=rounds)
    rows = [tuple(r) for r in small.select("doc_id", "text", "lang").collect()]
    learned = [r for r in rows if r[1] is not None and r[2] is not None and zlib.crc32(str(r[0]).encode()) % 3 != 1]
    grams = [g for g in (plain_vector(t, None, buckets) for _, t, _ in learned) if g is not None]
    idf = np.array([math.log((1 + len(grams)) / (1 + sum(b in g for g in grams))) + 1 for b in range(buckets)])
    assert np.allclose(model["idf"], idf, atol=1e-5)

    signed = lambda i: xxhash.xxh64_intdigest(struct.pack("<q", i), seed=42) - (1 << 64) * (xxhash.xxh64_intdigest(struct.pack("<q", i), seed=42) >> 63)
    langs, centroids, least = [], [], []
    for lang in sorted({r[2] for r in learned}):
        ids = sorted({r[0] for r in learned if r[2] == lang}, key=lambda i: (signed(i), i))[:sample]
        v = [plain_vector(min(t for i, t, x in learned if i == one and x == lang), idf, buckets) for one in sorted(ids)]
        v = np.array([x for x in v if x is not None])
        seeds = [0]
        while len(seeds) < k:
            near = [-9 if i in seeds else -max(float(x @ v[j]) for j in seeds) for i, x in enumerate(v)]
            seeds.append(int(np.argmax([n if i not in seeds else -9 for i, n in enumerate(near)])))
        c = v[seeds]
        for _ in range(rounds):
            own = [int(np.argmax([x @ y for y in c])) for x in v]
            c = np.array([(lambda m: m / np.linalg.norm(m))(sum(x for x, o in zip(v, own) if o == j)) if j in own else c[j] for j in range(k)])
        own = [int(np.argmax([x @ y for y in c])) for x in v]
        for j in range(k):
            langs.append(lang)
            centroids.append(c[j])
            least.append(min((float(x @ c[j]) for x, o in zip(v, own) if o == j), default=0.0))
    assert model["langs"] == langs
    assert np.allclose(model["centroids"], centroids, atol=1e-4) and np.allclose(model["least"], least, atol=1e-4)

    got = {r["doc_id"]: r for r in language_id.predict(small, model).collect()}
    for i, t, _ in rows:
        v = plain_vector(t, idf, buckets)
        if v is None:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        cos = np.array(centroids) @ v
        best = int(cos.argmax())
        assert abs(got[i]["score"] - min(1, max(0, cos[best]))) < 1e-4
        if np.sort(cos)[-1] - np.sort(cos)[-2] > 1e-4:
            assert got[i]["lang_pred"] == langs[best]
            if abs(cos[best] - language_id.REJECT * least[best]) > 1e-4:
                assert got[i]["rejected"] == (cos[best] < language_id.REJECT * least[best])


def test_sample_is_the_smallest_hashes(spark):
    """The threshold drops no id of the sample; repeated rows are one id."""
    rows = [(i, "text", "ab"[i % 2]) for i in range(20_000)] + [(5, "text", "b")] * 5000 + [(i, "t", "c") for i in range(7)]
    got = {}
    for r in language_id._sample(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6), 50).collect():
        got.setdefault(r["lang"], []).append(r["doc_id"])
    key = lambda i: (lambda h: h - (1 << 64) * (h >> 63))(xxhash.xxh64_intdigest(struct.pack("<q", i), seed=42))
    for lang, ids in got.items():
        want = sorted({i for i, _, x in rows if x == lang}, key=key)[:50]
        assert sorted(ids) == sorted(want)

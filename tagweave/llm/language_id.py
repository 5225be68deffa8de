"""Language identification by nearest centroid.

Every text is a vector of hashed character 1- to 3-grams over its letters,
weighted by TF-IDF and normalised. Document frequencies are counted over all
documents to learn from. For each language a bounded, documented sample (the
``sample`` ids with the smallest hash, with the least text of each) is clustered by spherical
k-means into several centroids, each language in its own task. A text takes the
language of the centroid with the largest cosine. Its distance is held against
the spread of that centroid: far ones are marked ``rejected``.

The model is languages x centroids x buckets floats (128 KB a language), sent
to the executors; whole texts are scored in one scan without a shuffle.

Learning takes documents with a language whose crc32(doc_id) mod 3 is not 1;
language, source and id are no inputs of a prediction.

Defined results: ``und`` with score 0 for null texts, texts without a letter,
and when there is nothing to learn from; equal cosines go to the language that
sorts first; repeated rows get equal rows; empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 8192
CENTROIDS = 4
SAMPLE = 400
#: So many times the sample pass the threshold before ids are ranked.
MARGIN = 4
ROUNDS = 10
#: A text is rejected when its cosine is under this share of the least cosine
#: among the sample rows of its centroid.
REJECT = 0.5
UNKNOWN = "und"
BROADCAST_IDS = 1_000_000

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTER


def ngram_counts(text: str | None, buckets: int = BUCKETS) -> np.ndarray | None:
    """Hashed counts of the 1- to 3-grams of the letters; None without a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[points]
    if not letter.any():
        return None
    x = np.where(letter, points, 32).astype(np.uint64)
    space = x == 32
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    x = np.concatenate([[np.uint64(32)], x[keep], [np.uint64(32)]])
    out, gram = np.zeros(buckets, dtype=np.int64), x
    for n in (1, 2, 3):
        if n > 1:
            gram = gram[:-1] * np.uint64(0x100000001B3) + x[n - 1:]
        if not len(gram):
            break
        h = ((gram + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        out += np.bincount((h % np.uint64(buckets)).astype(np.int64), minlength=buckets)
    return out


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts).astype(np.float32) * idf
    norm = np.linalg.norm(v, axis=-1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _idf(learn: DataFrame, buckets: int) -> np.ndarray:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(buckets, dtype=np.int64), 0
        for b in batches:
            for t in b["text"]:
                c = ngram_counts(t, buckets)
                if c is not None:
                    df += c > 0
                    n += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": np.append(at, -1), "df": np.append(df[at], n)})

    rows = learn.select("text").mapInPandas(count, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()
    df, n = np.zeros(buckets), 0
    for bucket, value in rows:
        if bucket < 0:
            n = value
        else:
            df[bucket] = value
    return (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)


def _clustered(v: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first seeds: centroids and the least cosine of each."""
    seeds = [0]
    while len(seeds) < min(k, len(v)):
        near = (v @ v[seeds].T).max(axis=1)
        near[seeds] = 2
        seeds.append(int(near.argmin()))
    c = v[seeds]
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        sums = np.stack([v[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    s = v @ c.T
    own = s.argmax(axis=1)
    return c, np.array([s[own == j, j].min() if (own == j).any() else 0.0 for j in range(len(c))])


def _sample(rows: DataFrame, sample: int) -> DataFrame:
    """(doc_id, lang): of each language the ``sample`` ids with the smallest hash. A
    threshold that some ``MARGIN`` times as many ids pass comes first, so that the
    task that ranks a language's ids gets a bounded number, however many there are."""
    ids = rows.select("doc_id", "lang").distinct()
    share = ids.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(MARGIN * sample)) / F.count(F.lit(1))).alias("share"))
    hashed = ids.withColumn("h", F.xxhash64("doc_id"))
    # The hash as a fraction of its range; a share of 1 takes all.
    low = hashed.join(share, "lang").where("share >= 1 OR h / 18446744073709551616D + 0.5D < share")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    return low.withColumn("r", rank).where(F.col("r") <= sample).select("doc_id", "lang")


def learn(docs: DataFrame, buckets: int = BUCKETS, centroids: int = CENTROIDS, sample: int = SAMPLE, rounds: int = ROUNDS) -> dict:
    """The model: idf, and centroid matrix, languages and least cosines by centroid."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    idf = _idf(rows, buckets)
    chosen = _sample(rows, sample)

    def cluster(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["doc_id", "text"])
        counts = [c for c in (ngram_counts(t, buckets) for t in f["text"]) if c is not None]
        if not counts:
            return pd.DataFrame({"lang": [], "j": [], "centroid": [], "least": []})
        c, least = _clustered(_weighted(np.stack(counts), idf), centroids, rounds)
        return pd.DataFrame({"lang": f["lang"].iloc[0], "j": range(len(c)), "centroid": [x.astype("<f4").tobytes() for x in c], "least": least})

    # At most ``sample`` ids a language: broadcast while that is few, else joined by a shuffle.
    few = sample * rows.select("lang").distinct().count() <= BROADCAST_IDS
    held = rows.join(F.broadcast(chosen) if few else chosen, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    found = held.groupBy("lang").applyInPandas(
        cluster, "lang string, j int, centroid binary, least double").collect()
    found = sorted(found, key=lambda r: (r["lang"].encode(), r["j"]))
    return {"idf": idf, "langs": [r["lang"] for r in found], "least": np.array([r["least"] for r in found]),
            "centroids": np.stack([np.frombuffer(r["centroid"], "<f4") for r in found]) if found else np.zeros((0, buckets), np.float32)}


def predict(docs: DataFrame, model: dict, chunk: int = 256) -> DataFrame:
    """doc_id, lang_pred, score, rejected: one row per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        langs, buckets = m["langs"], len(m["idf"])
        for b in batches:
            pred, score, far = [UNKNOWN] * len(b), np.zeros(len(b)), np.zeros(len(b), dtype=bool)
            at, held = [], []

            def settle():
                if at and langs:
                    s = _weighted(np.stack(held), m["idf"]) @ m["centroids"].T
                    best = s.argmax(axis=1)
                    for i, j, x in zip(at, best, s[np.arange(len(best)), best]):
                        pred[i], score[i] = langs[j], float(min(1.0, max(0.0, x)))
                        far[i] = x < REJECT * m["least"][j]
                at.clear()
                held.clear()

            for i, t in enumerate(b["text"].array):
                c = None if pd.isna(t) else ngram_counts(t, buckets)
                if c is not None:
                    at.append(i)
                    held.append(c)
                    if len(at) == chunk:
                        settle()
            settle()
            yield pd.DataFrame({"doc_id": pd.array(b["doc_id"], dtype="Int64"), "lang_pred": pred, "score": score, "rejected": far})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected."""
    out = predict(docs, learn(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")

import re
from collections import Counter

import duckdb
import pandas as pd

from tagweave.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = list(zip(w, w[1:], w[2:]))
    count = Counter(grams)
    covered = {i + o for i, g in enumerate(grams) if count[g] > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    out = [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return out, failed


def held(df, rows):
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = sorted((str(r["doc_id"]), [r[c] for c in cols], r["base_failed"]) for r in df.collect())
    want = sorted((str(i), *brute(t)) for i, t in rows)
    assert got == want
    assert all(not r["kept"] or not r["base_failed"] for r in df.collect())


def test_counts(small, small_rows):
    held(quality.quality_scores(small), [(r[0], r[1]) for r in small_rows])


def test_edge_rows(edge_docs, edge_rows, no_docs):
    held(quality.quality_scores(edge_docs), [(r[0], r[1]) for r in edge_rows])
    assert quality.quality_scores(no_docs).count() == 0
    kept = quality.kept_documents(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() > 0 and quality.kept_documents(no_docs).count() == 0


def test_repeats(spark):
    texts = ["a b c a b c", "a a a a", "a b c d a b c", "x y", "a b c\na b c\n\nd", "a b a b a b a b", "p q r s t u v q r s"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    held(quality.quality_scores(docs), list(enumerate(texts)))


def test_verdict_follows_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    x = quality.quality_scores(docs).join(labels, "doc_id").where("NOT base_failed").toPandas()
    assert (x["kept"] == (x["quality"] == 1)).mean() > 0.99
    assert x.loc[x["quality"] == 1, "kept"].all()


def test_sql_form(small):
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    a = con.execute(quality.SQL).df().sort_values("doc_id", ignore_index=True)
    b = quality.quality_scores(small).toPandas().sort_values("doc_id", ignore_index=True)
    pd.testing.assert_frame_equal(a, b[a.columns], check_dtype=False)

"""Registered queries: the driver contract and DuckDB parity on the small fixture."""

import math

import pytest

import __spark_entry__ as E
from tagweave.plans.registry import load_all

SF = "/root/testdata/sf0.001"

# Fast SQL-checked queries run here; the full set runs with tools/compare.py.
FAST = ["s1_sample", "s2_samples", "l8_seeded_folds", "t2_punctuation_noisy", "t10_lemma_tokens", "t15_token_count_map",
        "s4_top_reaction_comments", "g7_post_labels", "v4_tfidf", "v9_chi2", "m9_multinomial_nb", "m17_knn",
        "m2_label_spreading", "t14_language_id", "c2_dbscan", "w5_latest_model", "s3_legacy_samples"]


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in recs), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_contract_keys():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 60


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["id", "label", "tokens", "punctuation", "capitalization", "time_of_day"]
    assert df.count() > 0


@pytest.mark.parametrize("key", FAST)
def test_query_matches_duckdb(spark, duck, key):
    q = load_all()[key]
    df = q.build(spark, SF)
    res = duck.execute(q.sql)
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(dcols, res.fetchall())

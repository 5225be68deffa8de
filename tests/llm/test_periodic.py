import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np

from tagweave.llm import periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """All runs (start, length, period) by comparing words q apart, for every q."""
    out, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, m, q) for (s, m), q in out.items())


def contract_row(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def found(docs):
    ids = np.array([w for d in docs for w in d], dtype=np.int32)
    return periodic.periodic_runs(ids, np.array([len(d) for d in docs])).tolist()


def test_runs_against_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        docs = []
        for _ in range(rng.randrange(1, 8)):
            letters, n = rng.choice([1, 2, 2, 3, 5, 50]), rng.choice([0, 1, 5, 7, 20, 60, 150])
            d = [rng.randrange(letters) for _ in range(n)]
            if n and rng.random() < 0.5:
                s = rng.randrange(n)
                p = 1 + (n - s) // (3 + rng.randrange(8))
                d = [d[i] if i < s else d[s + (i - s) % p] for i in range(n)]
            docs.append(d * rng.randrange(1, 7) if rng.random() < 0.2 else d)
        want, before = [], 0
        for d in docs:
            want += [[s + before, s + before + m, q] for s, m, q in brute(d)]
            before += len(d)
        assert found(docs) == sorted(want)


def test_rules_stand_for_what_they_replace():
    """Every derivation of a rule is the same words, and the rules and what is left give the text back."""
    rng = random.Random(2)
    ids = np.array([rng.randrange(6) for _ in range(4000)] + [1, 2, 3] * 50 + [7] * 300, dtype=np.int32)
    last = np.zeros(len(ids), dtype=bool)
    last[[999, len(ids) - 1]] = True
    rounds, (start, length, ends) = periodic.grammar(ids, last)
    assert len(rounds) > 3 and length.sum() == len(ids) and ends.sum() == 2
    for (low, boundary, high), (rule, places) in rounds:
        for k, at in zip(rule, places):
            assert low[k] < boundary[k] < high[k]
            assert (ids[at:at + high[k] - low[k]] == ids[low[k]:high[k]]).all()
            assert not (at <= 999 < at + high[k] - low[k] - 1)       # no rule crosses documents
        assert (np.bincount(rule) > 1).all()


def test_long_texts_in_near_linear_time():
    rng = random.Random(3)
    n = 400_000
    for d, want in (([0] * n, [[0, n, 1]]), ([0, 1] * (n // 2), [[0, n, 2]]), (list(range(n // 5)) * 5, [[0, n, n // 5]]),
                    ([rng.randrange(5000) for _ in range(n)], [])):
        t = time.perf_counter()
        assert found([d]) == want
        assert time.perf_counter() - t < 20


def test_small_table(spark, small_rows):
    got = sorted(tuple(r) for r in queries.op13_grammar_runs(spark, "/root/testdata/sf0.001").collect())
    assert got == sorted(contract_row(r[0], r[1]) for r in small_rows)
    assert sum(r[1] for r in got) > 10


def test_operator_and_edge_rows(spark, edge_docs, edge_rows, no_docs):
    key = lambda r: (r[0] is None, r)
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], bytes(r["collapsed"]).decode())
           for r in periodic.collapsed_runs(edge_docs).collect()]
    want = []
    for r in edge_rows:
        words = (r[1] or "").encode().split()
        want.append((r[0], len(words), [], b" ".join(words).decode()))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert periodic.collapsed_runs(no_docs).count() == 0
    text = "start " + "a b\tc " * 5 + "end end end end end end"
    rows = spark.createDataFrame([(1, text), (1, text), (2, "")], "doc_id long, text string")
    got = [tuple(r) for r in periodic.collapsed_runs(rows).orderBy("doc_id").collect()]
    assert got[0] == got[1] and got[0][2] == [(1, 15, 3), (16, 6, 1)] and bytes(got[0][3]) == b"start a b c end"
    assert got[2][1:3] == (0, []) and bytes(got[2][3]) == b""

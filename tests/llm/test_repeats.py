import hashlib
import random

import numpy as np
import pytest

from tagweave.llm import exchange, repeats


def brute(rows, length=50):
    first = {}
    ids = [2**63 - 1 if i is None else i for i, _ in rows]
    data = [(t or "").encode() for _, t in rows]
    for i, b in zip(ids, data):
        for p in range(len(b) - length + 1):
            s = b[p:p + length]
            first[s] = min(i, first.get(s, i))
    out = []
    for (doc_id, _), i, b in zip(rows, ids, data):
        gone = np.zeros(len(b) + 1, dtype=bool)
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < i:
                gone[p:p + length] = True
        gone = gone[:-1]
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((doc_id, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_small_table(small, small_rows):
    assert result(repeats.removals(small)) == brute([(r[0], r[1]) for r in small_rows])


@pytest.fixture
def tangled():
    """Passages that overlap, meet, repeat inside a document and lie at its ends."""
    rng = random.Random(8)
    pool = ["".join(rng.choice("ab cdé") for _ in range(n)) for n in (20, 49, 50, 51, 75, 76, 120, 300)]
    rows = []
    for i in range(120):
        t = "".join(rng.choice(pool) if rng.random() < 0.7 else "".join(rng.choice("xyz ") for _ in range(rng.randrange(60)))
                    for _ in range(rng.randrange(1, 7)))
        rows.append((i * 7 % 121, t if rng.random() < 0.7 else t[rng.randrange(len(t) + 1):]))
    rows += [(500, "ab" * 200), (501, "ab" * 60), (502, "ab" * 25 + "c"), (503, "a" * 49), (503, "ab" * 30)]
    return rows


@pytest.mark.parametrize("slice_", [1 << 16, 37])
def test_tangled_passages(spark, tangled, monkeypatch, slice_):
    monkeypatch.setattr(repeats, "SLICE", slice_)
    monkeypatch.setattr(exchange, "BLOCK_BYTES", 2000)
    docs = spark.createDataFrame(tangled, "doc_id long, text string").repartition(4)
    assert result(repeats.removals(docs)) == brute(tangled)


def test_edge_rows(edge_docs, edge_rows, no_docs):
    rows = [(r[0], r[1]) for r in edge_rows]
    assert result(repeats.removals(edge_docs)) == brute(rows)
    assert repeats.removals(no_docs).count() == 0 and repeats.without_repeats(no_docs).count() == 0


def test_texts_that_stay(edge_docs, edge_rows):
    out = repeats.without_repeats(edge_docs)
    assert out.schema == edge_docs.schema and out.count() == edge_docs.count()
    kept = {r["doc_id"]: r for r in out.collect()}
    assert kept[1]["text"] == edge_rows[0][1] and kept[2]["text"] == "" and kept[2]["n_chars"] == 0
    assert kept[3]["text"].endswith("tail") and len(kept[3]["text"]) == kept[3]["n_chars"] < 10
    assert kept[4]["text"] is None and kept[4]["n_chars"] is None and kept[1]["words"] == "w"


def test_character_cut_in_two(spark):
    a = "x" * 49 + "é"                      # 51 bytes; the 50-byte string ends inside the character
    b = "x" * 49 + "è" + "tail"             # é and è share their first byte
    got = {r["doc_id"]: r["text"] for r in repeats.without_repeats(
        spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).collect()}
    assert got == {1: a, 2: "tail"}

import zlib
from collections import defaultdict

import numpy as np
import pytest

from tagweave.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(packing.vocabulary_path())


def check(rows, docs, tokenizer, max_len=packing.MAX_LEN):
    want = defaultdict(int)
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        start = 0
        for n in packing.piece_lengths(len(ids), max_len):
            want[doc_id, start, n, zlib.crc32(np.array(ids[start:start + n], dtype="<u4").tobytes()), len(ids)] += 1
            start += n
        assert start == len(ids)
    got = defaultdict(int)
    for r in rows:
        got[r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
        assert r["offset"] == 0 and r["length"] == 1 << r["bucket"] <= max_len
    assert got == want
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    order = [r["bucket"] for r in sorted(rows, key=lambda r: r["sequence_id"])]
    assert order == sorted(order)          # equal lengths are a contiguous range of ids


def test_pieces_equal_whole_text_ids(small, small_rows, tokenizer):
    check(packing.pack(small).collect(), [(r[0], r[1]) for r in small_rows], tokenizer)


def test_edge_rows(edge_docs, edge_rows, tokenizer, monkeypatch):
    check(packing.pack(edge_docs).collect(), [(r[0], r[1]) for r in edge_rows], tokenizer)
    check(packing.pack(edge_docs, max_len=64).collect(), [(r[0], r[1]) for r in edge_rows], tokenizer, 64)


def test_slices_and_cache_do_not_change_ids(edge_rows, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 7)
    enc = packing.WordIds(None, cache_words=20)
    for _, text, *_ in edge_rows:
        assert enc.encode(text).tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_ids_and_empty(edge_docs, no_docs, tmp_path, spark):
    r = packing.pack(edge_docs, with_ids=True).where("doc_id = 1").collect()
    assert all(len(x["ids"]) == x["length"] for x in r)
    assert packing.pack(no_docs).count() == 0
    packing.write_buckets(packing.pack(edge_docs), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == packing.pack(edge_docs).count()


def test_piece_lengths():
    assert packing.piece_lengths(2048 * 2 + 5) == [2048, 2048, 4, 1]
    for n in range(1, 300):
        x = packing.piece_lengths(n, 64)
        assert sum(x) == n and all(v & (v - 1) == 0 for v in x)
    with pytest.raises(ValueError):
        packing.pack(None, max_len=100)


def test_letters_before_marks(tokenizer):
    """Letters that NFC or lower case end in a combining mark are joined with the marks behind them."""
    letters = [chr(c) for c in range(0x110000) if chr(c).isalpha()]
    enc = packing.WordIds(None)
    for before, after in (("", "."), ("dak", ",")):
        words = [before + c + after for c in letters]
        got = enc.encode_all(words)
        want = tokenizer.encode_batch_fast(words, add_special_tokens=False)
        assert [w for w, g, e in zip(words, got, want) if g.tolist() != [*e.ids, 1]] == []


def test_letters_with_combining_marks(tokenizer):
    """NFC joins some marks with the small letter only, so A-Z before a mark is not lowered first."""
    letters = [chr(c) for c in range(ord("A"), ord("Z") + 1)]
    words = [a + b for a in letters for b in map(chr, range(0x300, 0x370))] + [f"{a}̴̈." for a in letters]
    got, want = packing.WordIds(None).encode_all(words), tokenizer.encode_batch_fast(words, add_special_tokens=False)
    assert [w for w, g, e in zip(words, got, want) if g.tolist() != [*e.ids, 1]] == []

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from tagweave.llm import queries, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    """Exactly one character inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute(counts):
    near = defaultdict(list)
    halves = defaultdict(list)
    for w in counts:                # any two words one edit apart agree in one deletion
        for x in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            halves[x].append(w)
    for words in halves.values():
        for a, b in combinations(words, 2):
            if one_edit(a, b) and b not in near[a]:
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in counts:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def contract_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 6:
                counts[w] += 1
    return {w: n for w, n in counts.items() if n >= 5}


def local_lists(words, frequent):
    """The index of one block, without Spark."""
    w = spelling.Words(words)
    grams, n = spelling.gram_counts(w)
    frequency = spelling.Facts(grams, spelling.frequency_class(n))
    keys, longer, inside = spelling.neighbourhood(w, spelling.longest_grams(w, frequency))
    return list(spelling.listed(w, frequency, spelling.Facts(keys, longer), spelling.Facts(keys, inside))), w, frequency, (keys, longer, inside)


@pytest.mark.parametrize("frequent,longest", [(1, 4), (3, 4), (10, 3), (2, 5), (50, 4)])
def test_lists_lose_no_pair(monkeypatch, frequent, longest):
    """Every pair one edit apart is in a common list, and every gram that an edit changes is within the bound."""
    monkeypatch.setattr(spelling, "FREQUENT", frequent)
    monkeypatch.setattr(spelling, "LONGEST", longest)
    rng = random.Random(frequent * 10 + longest)
    for letters in ("ab", "abc", "abcdefgh"):
        words = set()
        while len(words) < 400:
            w = "".join(rng.choice(letters) for _ in range(rng.randrange(6, 12)))
            i = rng.randrange(len(w))
            words |= {w, w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:]}
        words = sorted(words)
        lists, w, frequency, _ = local_lists(words, frequent)
        held = [defaultdict(set), defaultdict(set)]
        for as_longer, word, key in lists:
            for k, x in zip(word.tolist(), key.tolist()):
                held[as_longer][k].add(x)
        for a, b in combinations(range(len(words)), 2):
            if one_edit(words[a], words[b]):
                x, y = (a, b) if len(words[a]) <= len(words[b]) else (b, a)
                assert held[0][x] & held[len(words[x]) < len(words[y])][y], (words[a], words[b])


def test_affected_bounds_every_edit(monkeypatch):
    monkeypatch.setattr(spelling, "FREQUENT", 4)
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(4, 11))) for _ in range(1500)})
    near = [(i, j) for i, j in combinations(range(len(words)), 2) if one_edit(words[i], words[j])]
    _, w, frequency, (keys, longer, inside) = local_lists(words, 4)
    size = spelling.longest_grams(w, frequency)
    at = spelling.decomposed(w, size)
    bound = spelling.affected(w, size, at, spelling.Facts(keys, longer), spelling.Facts(keys, inside))
    grams = [Counter() for _ in words]
    for p in at.tolist():
        grams[w.word[p]][tuple(w.chars[p:p + size[p]].tolist())] += 1
    assert len(near) > 500
    for a, b in near:
        common = (grams[a] & grams[b]).total()
        assert common >= grams[a].total() - bound[a] and common >= grams[b].total() - bound[b]


def test_decomposition():
    """Frequent grams are longer, and grams inside of the one before go."""
    _, w, frequency, _ = local_lists(["abcabc"] * 30 + ["xyzuvw"], 50)
    size = spelling.longest_grams(w, frequency)
    at = spelling.decomposed(w, size)
    # "ab" and "bc" occur 60 times, so they are lengthened; "abc" too. "bca" and "ca" end where "abca" does.
    assert [(int(p), int(size[p])) for p in at if p < 8] == [(0, 2), (1, 4), (4, 4)]
    last = [(int(p - w.begin[-1]), int(size[p])) for p in at if p >= w.begin[-1]]
    assert last == [(i, 2) for i in range(7)]


def test_variants_with_chains_and_ties(spark):
    counts = {"abcdef": 5, "abcdeg": 25, "abcdhg": 125, "abcdhgi": 625, "abcxhgi": 4000, "lonely": 9, "tiesaa": 50, "tiesab": 50, "tiesac": 6,
              "\u00e9\u00e9\u00e9\u00e9\u00e9\u00e9": 7, "\u00e9\u00e9\u00e9\u00e9\u00e9": 40, "z" * 3000: 5, "z" * 3001: 25, "xyxyxy": 5, "yxyxyx": 30}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert sorted(tuple(r) for r in spelling.variants(df).collect()) == brute(counts)
    assert dict((r[0], r[2]) for r in brute(counts))["abcdef"] == "abcxhgi"


def test_small_table(spark, small_rows):
    got = sorted(tuple(r) for r in queries.op12_variable_grams(spark, "/root/testdata/sf0.01").collect())
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    assert got == brute(contract_counts([tuple(r) for r in rows]))
    assert sum(r[1] is not None for r in got) > 20


def test_edge_rows(spark, edge_docs, edge_rows, no_docs):
    got = {tuple(r) for r in spelling.word_counts(edge_docs, least_chars=1, least_count=1).collect()}
    want = Counter(w.translate(LOWER) for r in edge_rows for w in re.findall("[A-Za-z\u00C0-\u00FF]+", r[1] or ""))
    assert got == set(want.items())
    assert spelling.variants(spelling.word_counts(no_docs)).count() == 0
    rows = [(None, "Worded worded WORDED"), (1, "worded"), (1, "worded wordet\u0130x"), (2, None), (3, "\u00d7\u00f7\u00c9\u00e9\u00c0\u00ff")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in spelling.word_counts(df, 6, 1).collect()) == [("worded", 5), ("wordet", 1), ("\u00d7\u00f7\u00c9\u00e9\u00c0\u00ff", 1)]
    assert queries.misspelt("1", b"abc") == b"abc"

import re

from tagweave.llm import license_scan

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at, labels = [], set()
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        found = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def held(df, rows):
    cols = ["n_words", "n_base", "first_word", "last_word", "base_labels"]
    assert sorted((str(r["doc_id"]), *[str(r[c]) for c in cols]) for r in df.collect()) == sorted((str(i), *map(str, brute(t))) for i, t in rows)


def test_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held(license_scan.scan(docs), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_edge_rows(spark, edge_docs, edge_rows, no_docs):
    held(license_scan.scan(edge_docs), [(r[0], r[1]) for r in edge_rows])
    assert license_scan.scan(no_docs).count() == 0
    texts = ["CC BY", "cc-by cc by", "cc by cc by cc by", "cccc by", "all rights reserved all rights reserved", "GENERAL PUBLIC LICENSE!",
             "éall rights reserved", "all  rights\n\nreserved.", "cc\x00by", "ÀLL RIGHTS RESERVED cc bÿ"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held(license_scan.scan(docs), list(enumerate(texts)))


def labels(text):
    flat, _ = license_scan.normal(text)
    return {f[0]: f for f in license_scan.fuzzy_places(flat)}


def test_edits_are_found_with_spans():
    got = labels("word word Licenced under the Apache Licence, Version 2.0 (the word)")
    label, first, last, edits, score = got["apache-2.0"]
    assert (first, last, edits) == (2, 9, 2) and 0.9 < score < 1
    assert set(labels("This work is licensed under the GNU General Public License, version 3.")) == {"gpl", "gpl-3.0"}
    assert set(labels("Licensed under CC BY-NC 4.0.")) == {"cc-by-nc"}
    assert set(labels("Relased under th MIT License")) == {"mit"}
    assert set(labels("All right reserved")) == {"reserved"}
    assert "gpl-3.0" not in labels("gnu general public license version 2")
    assert labels("nothing of the kind is licensed here, version of nothing") == {}


def test_every_bounded_edit_is_found():
    """Pigeonhole: any change of one character in each of ``edits`` places is found."""
    label, notice = license_scan.NOTICES[5 - 2]
    edits = len(notice) // license_scan.CHARS_PER_EDIT
    step = len(notice) // edits
    for shift in range(step):
        chars = list(notice)
        for e in range(edits):
            i = e * step + shift
            if chars[i] != " ":
                chars[i] = "q"
        assert label in labels("x " + "".join(chars) + " y"), shift


def test_planted_lines(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    for r in docs.collect():
        marked = re.search(r"Licensed under|rights reserved|MIT License|Public License", r["text"])
        assert bool(marked) == bool(got[r["doc_id"]]["labels"])
        assert (got[r["doc_id"]]["score"] > 0) == bool(marked)


def edits_between(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute_places(text):
    """Every run of words against every notice; of runs that share a word the best stays."""
    w, out = license_scan.normal(text)[0].decode().split(), []
    for label, notice in license_scan.NOTICES:
        most, exact, found, taken = len(notice) // license_scan.CHARS_PER_EDIT, license_scan._EXACT.findall(notice), [], []
        for i in range(len(w)):
            for j in range(i, len(w)):
                run = " ".join(w[i:j + 1])
                if abs(len(run) - len(notice)) <= most and license_scan._EXACT.findall(run) == exact:
                    found.append((edits_between(notice, run), i, -j))
        for n, i, j in sorted(f for f in found if f[0] <= most):
            if all(-j < a or i > b for a, b, _ in taken):
                taken.append((i, -j, n))
        out += [(label, *t) for t in sorted(taken)]
    return out


def test_near_notices_do_not_hide_each_other():
    mit, gpl = "relesed under the mit license", "under gnu genral publc license version 3 or later and gnu general public license version 2 only"
    texts = [f"{mit} foo bar released under the mit license baz", gpl, f"{mit} {mit} {mit} released under the mit license {mit}",
             "all right reserved all rights reserved all rihts reserved", "licensed under cc by sa 4 0 licenced undr cc by nc 4 0 licensed under cc by 4 0",
             "é all righté reserved 𝒜 all rights𝒜reserved all rights reserved", "licensed under the apache licence version 1 0 licensd undr the apache license version 2 0"]
    for text in texts:
        assert [f[:4] for f in license_scan.fuzzy_places(license_scan.normal(text)[0])] == brute_places(text), text
    assert [f[1] for f in brute_places(texts[0])] == [0, 7] and [f[0] for f in brute_places(gpl)] == ["gpl-3.0", "gpl-2.0"]


def test_text_dense_with_phrases_in_linear_time():
    import time
    text = "all rights reserved under cc by general public license " * 40_000
    t = time.perf_counter()
    flat, n = license_scan.normal(text)
    places = license_scan.base_places(flat)
    assert time.perf_counter() - t < 5 and n == 360_000 and len(places) == 120_000
    assert places[:2] == [("cc-by", 4), ("cc-by", 13)] and places[-1] == ("reserved", 9 * 39_999)

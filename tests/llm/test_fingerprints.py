import hashlib

from pyspark.sql import functions as F

from tagweave.llm import fingerprints


def held(df, rows):
    """``rows``: distinct (doc_id, text) in the order of the ids, descending."""
    got = {}
    for r in df.collect():
        got.setdefault((r["doc_id"], r["n_chars"], r["edited_sha256"]), r)
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        assert (i, len(t), hashlib.sha256(edited.encode()).hexdigest()) in got
    assert len(got) == len(rows)


def test_small_table(small, small_rows):
    rows = sorted(((r[0], r[1]) for r in small_rows), reverse=True)
    df = fingerprints.fingerprints(small).cache()
    held(df, rows)
    x = df.toPandas().set_index("doc_id")
    prints = {}
    for i, t in rows:
        assert prints.setdefault(t, x.loc[i, "fingerprint"]) == x.loc[i, "fingerprint"]
    assert x["near_edited"].between(0, 1).all() and x["near_next"].between(0, 1).all()
    assert x["near_edited"].mean() > x["near_next"].mean() + 0.2


def test_edge_rows(edge_docs, edge_rows, no_docs):
    rows = list(dict.fromkeys((r[0], r[1] or "") for r in edge_rows))
    rows.sort(key=lambda r: -(2**63) if r[0] is None else r[0], reverse=True)
    df = fingerprints.fingerprints(edge_docs)
    held(df, rows)
    assert df.count() == len(edge_rows)
    assert fingerprints.fingerprints(no_docs).count() == 0


def test_one_document(spark):
    r = fingerprints.fingerprints(spark.createDataFrame([(1, "abcde")], "doc_id long, text string")).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abcab").hexdigest() and r["near_next"] == 1.0


def test_anchors_need_no_context(spark):
    """A passage has the same anchors at any place, but at its edges."""
    passage = " ".join(f"p{i * i % 97}" for i in range(60))
    docs = spark.createDataFrame([(1, passage), (2, "x1 x2 x3 " + passage), (3, passage + " y1 y2 y3 y4")], "doc_id long, text string")
    a = [[(x["pos"], x["hash"]) for x in r["a"]] for r in docs.orderBy("doc_id").select(fingerprints.anchors(F.col("text")).alias("a")).collect()]
    assert {(p + 3, h) for p, h in a[0]} <= set(a[1]) and set(a[0]) <= set(a[2]) and len(a[0]) > 10


def test_closed_syncmers_by_brute_force(spark):
    text = " ".join(f"t{i * 7 % 31}" for i in range(80))
    tokens = text.split()
    df = spark.createDataFrame([(i, *tokens[i:i + 2]) for i in range(79)], "i int, a string, b string")
    h = [r["h"] for r in df.orderBy("i").select(F.xxhash64("a", "b").alias("h")).collect()]
    want = [i for i in range(76) if min(h[i:i + 4]) in (h[i], h[i + 3])]
    got = spark.createDataFrame([(text,)], "text string").select(fingerprints.anchors(F.col("text")).alias("a")).first()["a"]
    assert [x["pos"] for x in got] == want


def test_no_python_on_the_main_path(small):
    plan = fingerprints.fingerprints(small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_common_passage_of_long_texts(spark):
    """Long texts that share one passage are alike, and the fingerprint holds every anchor with its position."""
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    passage = words("p", 60)
    rows = [(2 * k + j, f"{words(f'{k}{x}', 5_000)} {passage} {words(f'{k}{x}t', 50)}") for k in range(5) for j, x in enumerate("ab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    assert all(0 < r["near_next"] < 0.05 for r in got.values())
    for r in docs.select("doc_id", fingerprints.anchors(F.col("text")).alias("a")).collect():
        assert got[r["doc_id"]]["fingerprint"] == "".join(f"{a['pos']:08X}{a['hash'] % 2**64:016X}" for a in r["a"]) and len(r["a"]) > 2_000


def test_order_of_anchors_counts(spark):
    """Two passages in the other order have the same anchors, but not all the same neighbours."""
    a, b, gap = (" ".join(f"{x}{i}" for i in range(30)) for x in ("a", "b", "g"))
    docs = spark.createDataFrame([(1, f"{a} {gap} {b}"), (2, f"{b} {gap} {a}")], "doc_id long, text string")
    r = docs.select(fingerprints.units(fingerprints.fingerprint(F.col("text"))).alias("u")).collect()
    near = fingerprints.fingerprints(docs).first()["near_next"]
    assert 0.5 < near < 1 and near == len(set(r[0]["u"]) & set(r[1]["u"])) / len(set(r[0]["u"]) | set(r[1]["u"]))

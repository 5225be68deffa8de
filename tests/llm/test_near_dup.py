import random
import re
from itertools import combinations

from tagweave.llm import near_dup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(*[w[i:] for i in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent):
    sets, parent = [(i, shingles(t, k)) for i, t in rows], {}
    for i, _ in rows:
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, s), (j, t) in combinations(sets, 2):
        if s and t and 100 * len(s & t) >= percent * len(s | t):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def result(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_small_table(small, small_rows):
    rows = [(r[0], r[1]) for r in small_rows]
    assert result(near_dup.near_duplicates(small, 3, 85)) == brute(rows, 3, 85)
    assert result(near_dup.near_duplicates(small)) == brute(rows, 5, 80)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**9)}"
    return " ".join(words)


def test_family_of_near_copies(spark):
    """Copies of one text at all distances, most of them in common buckets."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(300)}" for _ in range(200)]
    rows = [(i, edited(rng, base, rng.randrange(16))) for i in range(150)]
    rows += [(1000 + i, edited(rng, [f"v{rng.randrange(300)}" for _ in range(150)], 0)) for i in range(20)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(near_dup.near_duplicates(docs, 3, 85)) == brute(rows, 3, 85)


def test_later_rounds_find_what_hubs_miss(spark, monkeypatch):
    """Without the links of the first hub round, the others must find all."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(300)}" for _ in range(200)]
    rows = [(i, edited(rng, base, rng.randrange(12))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    real, calls = near_dup._verified, []

    def first_finds_nothing(pairs, *rest):
        calls.append(1)
        out = real(pairs, *rest)
        return out.limit(0) if len(calls) == 1 else out

    monkeypatch.setattr(near_dup, "_verified", first_finds_nothing)
    assert result(near_dup.near_duplicates(docs, 3, 85)) == brute(rows, 3, 85)


def test_edge_rows(edge_docs, edge_rows, no_docs):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(edge_docs, 3, 85).collect()}
    known = [(r[0], r[1]) for r in edge_rows if r[0] is not None]
    assert {x for x in got if x[0] is not None} == set(brute(known, 3, 85))
    assert near_dup.near_duplicates(edge_docs).count() == edge_docs.count()
    assert near_dup.near_duplicates(no_docs).count() == 0
    kept = near_dup.deduplicated(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 4 in ids and None in ids


def by_sets(rows, k, percent):
    """The multiset of rows that stay, by all pairs of rows, whatever their ids."""
    sets, parent = [shingles(t, k) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        s, t = sets[i], sets[j]
        if s and t and 100 * len(s & t) >= percent * len(s | t):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    groups = {}
    for i, r in enumerate(rows):
        if sets[i]:
            groups.setdefault(find(i), []).append(r)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    return sorted([r for r, s in zip(rows, sets) if not s] + [min(g, key=key) for g in groups.values()], key=str)


def shared_ids(seed):
    """Ids that stand for several texts, with near copies of each; repeated rows; rows without an id."""
    rng = random.Random(seed)
    text = lambda: [f"w{rng.randrange(300)}" for _ in range(120)]
    a, b, c, d, e, f = (text() for _ in range(6))
    j = " ".join
    return [(7, j(a)), (7, j(b)), (3, edited(rng, a, 1)), (9, edited(rng, b, 1)), (20, edited(rng, b, 2)),
            (11, j(c)), (11, j(c)), (11, j(c) + " tail"), (12, j(c)), (12, None), (13, ""), (13, j(c)), (13, ""),
            (None, j(d)), (None, j(d)), (None, edited(rng, d, 1)), (30, edited(rng, d, 1)),
            (None, j(e)), (None, j(e)), (None, edited(rng, e, 1)), (None, ""), (None, None),
            (40, j(f)), (40, j(f)), (41, j(text())), (41, j(text())), (42, "one two")]


def test_ids_of_several_texts(spark):
    for seed in range(3):
        rows = shared_ids(seed)
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = result(near_dup.near_duplicates(docs.where("doc_id IS NOT NULL"), 3, 85))
        assert got == brute([r for r in rows if r[0] is not None], 3, 85)
        assert {x[2] for x in got if x[0] in (3, 7, 9, 20)} == {3} and {x[2] for x in got if x[0] in (11, 12, 13)} == {11}
        every = near_dup.near_duplicates(docs, 3, 85).where("doc_id IS NULL").collect()
        assert sorted((r["component_id"] or 0, r["kept"]) for r in every) == [(0, True)] * 5 + [(30, False)] * 3


def test_one_row_of_each_component_stays(spark):
    for seed in range(3):
        rows = shared_ids(seed)
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame([(*r, 1, {"k": "v"}) for r in rows], "doc_id long, text string, rep int, node map<string, string>").repartition(4)
        kept = near_dup.deduplicated(docs, 3, 85)
        assert kept.columns == docs.columns
        assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == by_sets(rows, 3, 85)


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(500)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    loose = [(2000 + 2 * i, 2001 + 2 * i) for i in range(50)]
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in chain + star + loose + loose]
    got = dict(tuple(r) for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {i: 0 for i in range(501)} | {1000 + i: 1000 for i in range(200)} | {2000 + i: 2000 + i // 2 * 2 for i in range(100)}
    assert got == want
    assert near_dup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bands_follow_the_limit(spark, monkeypatch):
    for percent in (50, 70, 80, 85, 90):
        assert (1 - (percent / 100) ** 5) ** near_dup.bands_for(percent) < 1e-5
    assert (near_dup.bands_for(85), near_dup.bands_for(80)) == (20, 29)
    real, bands = near_dup.signatures, []
    monkeypatch.setattr(near_dup, "signatures", lambda docs, k, n: bands.append(n) or real(docs, k, n))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    for percent in (80, 85):
        assert result(near_dup.near_duplicates(docs, 3, percent)) == brute([(1, "a b c d e f"), (2, "a b c d e f")], 3, percent)
    assert bands == [29, 20]


def test_small_tables_need_few_partitions(spark):
    """What later shuffles read has as many partitions as its rows need, however many made it."""
    texts = [" ".join(f"w{i // 4}x{j}" for j in range(60)) + f" end{i}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _, classes, label = near_dup._set_components(docs, 3, 85)
        assert classes.count() == 40 and label.count() == 40
        assert classes.rdd.getNumPartitions() == 1
        pairs = spark.createDataFrame([(1, 0)], "a long, b long").repartition(6)
        members = spark.createDataFrame([(i, 58, bytes(400), texts[i]) for i in (0, 1)], "rep long, n long, sig binary, text string")
        assert near_dup._verified(pairs, members, 85, 3).rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)

import corpus_pipeline
from tagweave.llm import mixing, near_dup, packing, quality
from tests.llm.test_near_dup import brute as components_of
from tests.llm.test_quality import brute as quality_of
from tests.llm.test_repeats import brute as repeats_of

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "MinHash near-dedup", "suffix-array dedup", "source mixing", "packing"]
    at = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at[-1], SF).write.parquet(str(tmp_path / str(k)))
        at.append(spark.read.parquet(str(tmp_path / str(k))))
    for d in at[:-1]:
        assert d.columns == docs.columns
    rows = [sorted(((r["doc_id"], r["text"]) for r in d.collect())) for d in at[:-1]]

    verdict = {r["doc_id"]: r["kept"] for r in quality.quality_scores(docs).collect()}
    assert rows[1] == [r for r in rows[0] if verdict[r[0]]] and not any(quality_of(t)[1] for _, t in rows[1])
    kept = {i for i, _, _, k in components_of(rows[1], near_dup.SHINGLE_WORDS, near_dup.SIMILARITY_PERCENT) if k}
    assert rows[2] == [r for r in rows[1] if r[0] in kept]
    import hashlib
    cut = {r[0]: r for r in repeats_of(rows[2])}
    whole = {i: t for i, t in rows[2]}
    for i, t in rows[3]:
        if cut[i][2] == 0:
            assert t == whole[i]
        elif len(t.encode()) == cut[i][1] - cut[i][2]:
            assert hashlib.sha256(t.encode()).hexdigest() == cut[i][4]
    assert len(rows[3]) == len(rows[2])
    texts = dict(rows[3])
    assert all(texts[i] == t for i, t in rows[4])
    takes = {r["doc_id"]: r["copies"] + round(r["part"]) for r in mixing.mix(at[3]).collect()}
    counts = {}
    for i, _ in rows[4]:
        counts[i] = counts.get(i, 0) + 1
    assert counts == {i: n for i, n in takes.items() if n}
    packed = at[-1].collect()
    assert sum(r["length"] for r in packed) == sum(len(packing.WordIds(None).encode(t)) for _, t in rows[4])


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and set(out.columns) >= {"doc_id", "ids", "sequence_id"}


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0


CLASHING = ", __id long, __n int, __copy int, row string, id long, `of` string, words int, copy int, set string, d1 long, node long, rep int, stays int, component int"


def written(spark, rows, folder):
    """Rows of documents with extra columns, named as what the stages use inside, as a table of ``folder``."""
    schema = "doc_id long, text string, lang string, source string, n_chars long" + CLASHING
    extra = (1, 2, 3, "r", 4, "o", 5, 6, "s", 7, 8, 9, 10, 11)
    df = spark.createDataFrame([(*r, *extra) for r in rows], schema).repartition(3)
    df.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_run_on_edge_rows(spark, edge_rows, tmp_path):
    """Nulls in every column, empty and very long texts, ties, repeated rows, rows without an id, clashing names."""
    import random
    rng = random.Random(8)
    prose = lambda n: " ".join("the" if i % 9 == 0 else f"w{rng.randrange(4000)}" for i in range(n))
    x, y = prose(150), prose(150)
    rows = [*edge_rows, (70, x, "en", "a", 1), (70, x, "en", "a", 1), (None, y, None, None, None), (None, y, None, None, None), (71, x, "en", None, 2)]
    folder = written(spark, rows, tmp_path)
    at = spark.read.parquet(f"{folder}/documents.parquet")
    names = at.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, folder)
        out.write.parquet(str(tmp_path / f"stage{k}"))
        at = spark.read.parquet(str(tmp_path / f"stage{k}"))
        assert at.columns == names or k == 4
        if k == 1:
            texts = [r["text"] for r in at.select("text").collect()]
            assert texts.count(x) == texts.count(y) == 1
    assert corpus_pipeline.run(spark, folder).count() == at.count() > 0


def test_run_on_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, [], tmp_path)).count() == 0

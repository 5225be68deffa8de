"""Feature vectors as long tables.

A document vector is a set of rows ``(id, term, value)`` — sparse by
construction, SQL-checkable, and free of any per-row size limit. Fit state
(document frequencies, idf, vocabulary, SVD basis) is itself a table; apply
it with a join, never with a driver-side dictionary.

Scale notes
-----------
* Term counts come from the per-row sort-and-run-length expression
  (``token_counts``), without a shuffle; hashed counts from an aggregate per row
  and bucket, which combines before its shuffle.
* Document frequency is ``groupBy(term).count()`` over (doc, term) pairs
  with partial aggregation; a term found in every document is one hot key of
  a *combining* aggregate, which is cheap.
* Joining tf with idf is a join on the term: the tf side is skewed (frequent
  terms), the idf side has one row per term. With hashed features the idf
  table has at most ``n_features`` rows, a bound known before the job, so it
  is broadcast; for open vocabularies the join is left to AQE (broadcast at
  run time when small, skew-split otherwise).
* The per-document norm is an aggregate per document (bounded by the
  document's distinct terms) joined back on the document id.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.functions.hashing import md5_bucket, murmur3
from tagweave.functions.text import let, token_counts, word_ngrams
from tagweave.operators.ranking import ordered_rank
from tagweave.session import cut_lineage

# Largest dimension for which the Gram matrix goes to the driver (200 x 200
# is the reference's own cap on hashed token features).
MAX_GRAM_DIM = 512

# Documents whose words are numbered at once.
GRAM_ROWS = 1024


def term_counts(df: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    """G6 / V3 counts: (id, term, tf) from a tokens array, no shuffle."""
    return df.select(F.col(id_col).alias("id"), F.explode(token_counts(F.col(tokens_col))).alias("term", "tf"))


def hashed_counts(df: DataFrame, id_col: str, tokens_col: str, n_features: int) -> DataFrame:
    """V1: feature hashing of token counts: (id, term=bucket, tf) with bucket =
    md5 bucket of the token in [0, n_features). Counts of tokens sharing a
    bucket add up (plain counts, all non-negative)."""
    # Hashed outside a lambda, where the hash is compiled; a row's counts combine before the shuffle.
    rows = df.select(F.col(id_col).alias("id"), F.explode(tokens_col).alias("token"))
    return rows.groupBy("id", md5_bucket(F.col("token"), n_features).alias("term")).agg(F.count(F.lit(1)).alias("tf"))


def signed_hashed_counts(df: DataFrame, id_col: str, tokens_col: str, n_features: int) -> DataFrame:
    """V1 as the reference's hasher has it: (id, term=bucket, tf). A token's bucket
    is its absolute MurmurHash3 modulo ``n_features``; its count is added if the
    hash is not negative, else subtracted; the result is the absolute sum. Tokens
    of one bucket can so cancel each other; a bucket that sums to 0 has no row.

    A token is counted per row before it is hashed, and signed sums combine before
    the one shuffle."""
    counts = term_counts(df, id_col, tokens_col).withColumn("h", murmur3(F.col("term")))
    signed = F.when(F.col("h") >= 0, F.col("tf")).otherwise(-F.col("tf"))
    sums = counts.select("id", F.pmod(F.abs("h"), F.lit(n_features)).cast("int").alias("term"), signed.alias("s")).groupBy("id", "term").agg(F.sum("s").alias("s"))
    return sums.where("s <> 0").select("id", "term", F.abs("s").alias("tf"))


def document_frequency(tf: DataFrame) -> DataFrame:
    """(term, df): documents containing the term."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def filter_df(tf: DataFrame, n_docs, min_df=1, max_df=1.0) -> DataFrame:
    """V3: keep terms with min_df <= df <= max_df. Integers are document counts,
    floats are shares of ``n_docs`` (``max_df`` of 1 as an integer means 'in at
    most one document'; pass 1.0 for no upper bound)."""
    lo = min_df if isinstance(min_df, int) else F.lit(min_df) * n_docs
    hi = max_df if isinstance(max_df, int) else F.lit(max_df) * n_docs
    d = document_frequency(tf).where((F.col("df") >= lo) & (F.col("df") <= hi))
    return tf.join(d.select("term"), "term", "left_semi")


def _gram_numbers(words, vocab, codes: list):
    """Of a batch's word lists (Arrow): the row of every word and, by n, the number of the
    frequent n-gram that starts there (-1: none). ``codes[n - 2]`` are the sorted codes of the
    frequent n-grams: number of the (n-1)-gram x words + number of the last word."""
    import pyarrow.compute as pc
    size = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(words)), size)
    word = pc.fill_null(pc.index_in(words.flatten(), value_set=vocab), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    levels = [word]
    for known in codes:
        code = _next_codes(row, word, levels[-1], len(levels), len(vocab))
        at = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
        levels.append(np.where((code >= 0) & (known[at] == code), at, -1) if len(known) else np.full(len(code), -1))
    return row, levels


def _pieces(batches):
    """Arrow batches of so few documents that their grams' numbers are small arrays."""
    for b in batches:
        for at in range(0, b.num_rows, GRAM_ROWS):
            yield b.slice(at, GRAM_ROWS)


def _next_codes(row, word, gram, n: int, n_words: int) -> np.ndarray:
    """Codes of the (n+1)-grams whose two n-grams are frequent, where they start; else -1."""
    out = np.full(len(word), -1, dtype=np.int64)
    here = np.flatnonzero((gram[:-n] >= 0) & (gram[1:len(gram) - n + 1] >= 0) & (row[:-n] == row[n:]))
    out[here] = gram[here] * n_words + word[here + n]
    return out


def _by_row(row, number):
    """Distinct (row, number >= 0) and how often each is there."""
    some = number >= 0
    # Numbers may be large codes: ranked first, so that a pair fits a long.
    known, rank = np.unique(number[some], return_inverse=True)
    width = max(len(known), 1)
    pair, times = np.unique(row[some].astype(np.int64) * width + rank, return_counts=True)
    return pair // width, known[pair % width], times


def frequent_gram_counts(df: DataFrame, id_col: str, words_col: str, n_max: int, min_count: float) -> tuple[DataFrame, DataFrame]:
    """V3 counts of the 1- to ``n_max``-grams that at least ``min_count`` documents
    hold: ((id, term, tf), (term, df)). ``words_col`` holds words without spaces.

    Level by level (Agrawal & Srikant, VLDB 1994): a document with an n-gram has
    both (n-1)-grams in it, so only grams of two frequent ones are counted, and the
    many rare ones never reach a shuffle. The frequent ones of a level are shipped to
    every task, which numbers the words of a batch by them; a gram is a number there."""
    import pyarrow as pa
    spark = df.sparkSession
    df = df.select(F.col(id_col).alias("id"), F.col(words_col).alias("w"))
    enough = F.col("df") >= F.lit(float(min_count))
    one = df.select(F.explode(F.array_distinct("w")).alias("term")).where("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(enough)
    found = one.orderBy("term").toPandas()
    vocab, codes, names, counts = found["term"].tolist(), [], [found["term"].tolist()], [found["df"].to_numpy()]
    for n in range(2, n_max + 1):
        bc = spark.sparkContext.broadcast((vocab, codes))

        def level(batches, n=n, bc=bc):
            vocab, codes = pa.array(bc.value[0], pa.string()), bc.value[1]
            for b in _pieces(batches):
                row, levels = _gram_numbers(b.column("w"), vocab, codes)
                _, code, _ = _by_row(row, _next_codes(row, levels[0], levels[-1], n - 1, len(vocab)))
                code, held = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_pydict({"code": code.astype(np.int64), "held": held.astype(np.int64)})

        seen = df.select("w").mapInArrow(level, "code long, held long").groupBy("code").agg(F.sum("held").alias("df")).where(enough)
        found = seen.orderBy("code").toPandas()
        code = found["code"].to_numpy(dtype=np.int64)
        codes = [*codes, code]
        names.append([f"{names[-1][c // len(vocab)]} {vocab[c % len(vocab)]}" for c in code.tolist()])
        counts.append(found["df"].to_numpy())
    bc = spark.sparkContext.broadcast((vocab, codes, names))

    def rows(batches):
        vocab, codes, names = pa.array(bc.value[0], pa.string()), bc.value[1], [pa.array(n, pa.string()) for n in bc.value[2]]
        for b in _pieces(batches):
            row, levels = _gram_numbers(b.column("w"), vocab, codes)
            for number, name in zip(levels, names):
                own, gram, times = _by_row(row, number)
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(own)), name.take(pa.array(gram)), pa.array(times, pa.int64())], ["id", "term", "tf"])

    terms = spark.createDataFrame(pd.DataFrame({"term": [t for n in names for t in n], "df": np.concatenate(counts).astype(np.int64)}), "term string, df long")
    return df.mapInArrow(rows, f"id {dict(df.dtypes)['id']}, term string, tf long"), terms


def idf_table(tf: DataFrame, n_docs, smooth: bool = True) -> DataFrame:
    """V4 fit: (term, idf) with idf = ln((1+n)/(1+df)) + 1 (smooth) or
    ln(n/df) + 1."""
    d = document_frequency(tf)
    n = F.lit(n_docs) if not hasattr(n_docs, "_jc") else n_docs
    if smooth:
        idf = F.log((n + 1) / (F.col("df") + 1)) + 1
    else:
        idf = F.log(n / F.col("df")) + 1
    return d.select("term", idf.alias("idf"))


def tfidf(tf: DataFrame, idf: DataFrame, sublinear: bool = False, norm: str | None = "l2",
          idf_rows_bound: int | None = None) -> DataFrame:
    """V4 / V5 apply: value = tf' * idf, tf' = 1 + ln(tf) when sublinear; then
    L2-normalise per document (V11). Terms missing from ``idf`` (unseen at fit
    time) drop out, as with a fitted vocabulary. ``idf_rows_bound``: a known
    upper bound on the idf table (hashed features) allows a broadcast."""
    t = F.when(F.col("tf") > 0, F.lit(1.0) + F.log("tf")) if sublinear else F.col("tf").cast("double")
    side = F.broadcast(idf) if idf_rows_bound is not None and idf_rows_bound <= 1 << 21 else idf
    x = tf.join(side, "term").select("id", "term", (t * F.col("idf")).alias("value"))
    return l2_normalize(x) if norm == "l2" else x


def l2_normalize(x: DataFrame) -> DataFrame:
    """Value / sqrt(sum value^2) per id; an all-zero row stays zero."""
    norms = x.groupBy("id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return x.join(norms, "id").select(
        "id", "term", F.when(F.col("norm") > 0, F.col("value") / F.col("norm")).otherwise(F.lit(0.0)).alias("value"))


def vocabulary(tf: DataFrame) -> DataFrame:
    """(term, index) with indexes in sorted-term order, as a fitted
    count vectoriser numbers its vocabulary."""
    terms = tf.select("term").distinct()
    return ordered_rank(terms, [], ["term"], "index").select("term", (F.col("index") - 1).cast("int").alias("index"))


def chi2(x: DataFrame, labels: DataFrame, label_col: str = "label") -> DataFrame:
    """V9: chi-squared statistic of every feature against the class labels
    (sklearn's definition): observed O[c,f] = sum of the feature over class c,
    expected E[c,f] = share(c) * total(f); chi2 = sum_c (O - E)^2 / E.

    Only observed pairs are needed: sum_c (O-E)^2/E = sum_{O>0} O^2/E - total(f),
    because sum_c O = sum_c E = total(f). No classes x features grid."""
    lab = labels.select(F.col("id"), F.col(label_col).alias("c"))
    n = lab.select(F.count(F.lit(1))).scalar()
    share = lab.groupBy("c").agg((F.count(F.lit(1)) / F.lit(n)).alias("p"))
    obs = x.join(lab, "id").groupBy("c", "term").agg(F.sum("value").alias("o"))
    tot = x.groupBy("term").agg(F.sum("value").alias("t"))
    j = obs.join(F.broadcast(share), "c").join(tot, "term")   # share: one row per class
    s = j.groupBy("term").agg(F.sum(F.col("o") * F.col("o") / (F.col("p") * F.col("t"))).alias("s"),
                              F.first("t").alias("t"))
    return s.select("term", (F.col("s") - F.col("t")).alias("chi2"))


def select_k_best(x: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """Keep the k best-scoring features (ties: lower term first)."""
    best = scores.orderBy(F.col("chi2").desc(), F.col("term")).limit(k).select("term")
    return x.join(F.broadcast(best), "term")     # k rows


def feature_union(blocks: Sequence[tuple[str, DataFrame, int, float]]) -> DataFrame:
    """Concatenate blocks (name, long vectors with int term, width,
    weight): term -> offset + term, value -> weight * value."""
    out, offset = None, 0
    for name, x, width, weight in blocks:
        y = x.select("id", (F.col("term").cast("int") + offset).alias("term"),
                     (F.col("value") * F.lit(weight)).alias("value"), F.lit(name).alias("block"))
        out = y if out is None else out.unionByName(y)
        offset += width
    return out


def dense_block(x: DataFrame, width: int) -> DataFrame:
    """(id, ARRAY<DOUBLE>) of a given width from long form (groups are
    single documents, width-bounded)."""
    agg = x.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("term").cast("int"), "value")))
                              .alias("m"))
    return agg.select("id", let(F.col("m"), lambda m: F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.element_at(m, i), F.lit(0.0))))
        .alias("vector"))


# --- V7 truncated SVD ---------------------------------------------------------------
def gram_matrix(x: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """V7: Gram matrix X^T X as (groups..., i, j, g): every task sums its rows into
    one width x width table, and the tables are added up."""
    group_cols = list(group_cols)
    rows = x.groupBy(*group_cols, "id").agg(F.array_sort(F.collect_list(F.struct("term", "value"))).alias("e")).select(
        *group_cols, F.transform("e", lambda e: e["term"]).alias("t"), F.transform("e", lambda e: e["value"]).alias("v"))

    def partial(batches):
        sums: dict = {}                     # groups -> (sorted terms, sums, pairs seen), at most width^2 a group
        for b in batches:
            for g, part in b.groupby(group_cols, dropna=False) if group_cols else [((), b)]:
                for at in range(0, len(part), 512):
                    size = [len(t) for t in part["t"].iloc[at:at + 512]]
                    t, v = (np.concatenate(list(part[c].iloc[at:at + 512])) for c in ("t", "v"))
                    if not len(t):
                        continue
                    own, col = np.unique(t, return_inverse=True)
                    rows, seen = np.zeros((len(size), len(own))), np.zeros((len(size), len(own)))
                    at_row = np.repeat(np.arange(len(size)), size)
                    np.add.at(rows, (at_row, col), v.astype(float))
                    seen[at_row, col] = 1.0
                    terms, total, met = sums.get(g, (own[:0], np.zeros((0, 0)), np.zeros((0, 0), dtype=bool)))
                    both = np.union1d(terms, own)
                    if len(both) > len(terms):
                        old = np.ix_(*[np.searchsorted(both, terms)] * 2)
                        wider, wider_met = np.zeros((len(both), len(both))), np.zeros((len(both), len(both)), dtype=bool)
                        wider[old], wider_met[old] = total, met
                        total, met = wider, wider_met
                    new = np.ix_(*[np.searchsorted(both, own)] * 2)
                    total[new] += rows.T @ rows
                    met[new] |= seen.T @ seen > 0
                    sums[g] = both, total, met
        for g, (terms, total, met) in sums.items():
            i, j = np.nonzero(met)
            yield pd.DataFrame({**{c: [e] * len(i) for c, e in zip(group_cols, g)}, "i": terms[i], "j": terms[j], "g": total[i, j]})

    kinds = dict(x.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in group_cols], f"i {kinds['term']}", f"j {kinds['term']}", "g double"])
    return rows.mapInPandas(partial, schema).groupBy(*group_cols, "i", "j").agg(F.sum("g").alias("g"))


def svd_basis(gram_rows: list, width: int, k: int) -> np.ndarray:
    """Top-k right singular vectors from a (small) Gram matrix: eigenvectors of
    X^T X by decreasing eigenvalue, sign fixed so that the largest-magnitude
    entry is positive. ``width`` is bounded by MAX_GRAM_DIM."""
    g = np.zeros((width, width))
    for r in gram_rows:
        g[int(r["i"]), int(r["j"])] = r["g"]
    vals, vecs = np.linalg.eigh(g)
    order = np.argsort(-vals, kind="stable")[:k]
    v = vecs[:, order]
    for c in range(v.shape[1]):
        m = np.argmax(np.abs(v[:, c]))
        if v[m, c] < 0:
            v[:, c] = -v[:, c]
    return v


def basis_table(spark, v: np.ndarray) -> DataFrame:
    """(i, comp, w) long form of a basis (width x k, at most MAX_GRAM_DIM x k rows)."""
    rows = [(int(i), int(c), float(v[i, c])) for i in range(v.shape[0]) for c in range(v.shape[1]) if v[i, c] != 0.0]
    return spark.createDataFrame(rows, "i int, comp int, w double")


def project(x: DataFrame, basis: DataFrame) -> DataFrame:
    """X V: (id, term=component, value) by a join with the broadcast basis."""
    j = x.join(F.broadcast(basis), x.term == basis.i)
    return j.groupBy("id", F.col("comp").alias("term")).agg(F.sum(F.col("value") * F.col("w")).alias("value"))


def truncated_svd(x: DataFrame, width: int, k: int) -> tuple[DataFrame, np.ndarray]:
    """V7: fit on x, transform x; (projected long form, basis). Up to
    ``MAX_GRAM_DIM`` columns by the Gram matrix and a small eigenproblem on the
    driver, wider ones by ``svd_distributed``; both give the same basis."""
    if width > MAX_GRAM_DIM:
        return svd_distributed(x, width, k)
    rows = gram_matrix(x).collect()           # at most width^2 rows
    v = svd_basis(rows, width, k)
    return project(x, basis_table(x.sparkSession, v)), v


def svd_distributed(x: DataFrame, width: int, k: int):
    """V7 / V8 for wide inputs (fingerprints, 16,384 columns): MLlib's
    distributed ``RowMatrix.computeSVD`` on sparse rows. Returns (the projected
    rows (id, term, value), V as numpy)."""
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import IndexedRow, IndexedRowMatrix
    rows = x.groupBy("id").agg(F.collect_list(F.struct(F.col("term").cast("int").alias("t"), "value")).alias("e"))
    rdd = rows.rdd.map(lambda r: IndexedRow(r["id"], Vectors.sparse(
        width, sorted((e["t"], e["value"]) for e in r["e"]))))
    mat = IndexedRowMatrix(rdd)
    svd = mat.computeSVD(k, computeU=False)
    v = np.array(svd.V.toArray())
    for c in range(v.shape[1]):
        m = np.argmax(np.abs(v[:, c]))
        if v[m, c] < 0:
            v[:, c] = -v[:, c]
    return project(x, basis_table(x.sparkSession, v)), v


def vectorizer_shape(x: DataFrame, texts: DataFrame, text_col: str) -> DataFrame:
    """n_samples, n_features (distinct terms) and MB of text vectorised."""
    a = x.agg(F.count_distinct("id").alias("n_samples"), F.count_distinct("term").alias("n_features"))
    b = texts.agg(F.round(F.sum(F.octet_length(text_col)) / 1e6, 6).alias("size_mb"))
    return _one_row_join(a, b)


def _one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    # Two single-row aggregates side by side (join on a constant key).
    return a.withColumn("__k", F.lit(1)).join(b.withColumn("__k", F.lit(1)), "__k").drop("__k")



# --- V8 PCA ------------------------------------------------------------------------------------------
def pca_sparse(x: DataFrame, width: int, k: int, rounds: int = 100, seed: int = 0, tol: float = 1e-4):
    """V8: centred PCA of sparse rows (id, term, value) of a given width, by
    subspace iteration, until the leading k directions move by less than ``tol``
    (or ``rounds``). Each round reads the rows once and multiplies by the centred
    data without forming it: Y = XV - 1 (mu^T V) and (X - 1 mu^T)^T Y = X^T Y -
    mu (1^T Y). A task adds up its rows in width x k tables (bounded by the
    width), and a tree adds up the tables. Returns
    (components width x k, mean, explained variances)."""
    from tagweave.operators.range_svd import centred_products
    # An entry without an id counts in the mean alone.
    entry = F.when(F.expr("id IS NOT NULL AND term IS NOT NULL AND value IS NOT NULL"), F.struct(F.col("term").cast("int").alias("t"), F.col("value").cast("double").alias("v")))
    rows = cut_lineage(x.groupBy("id").agg(F.array_sort(F.collect_list(entry)).alias("e")).select(
        F.transform("e", lambda e: e["t"]).alias("t"), F.transform("e", lambda e: e["v"]).alias("v")))          # read every round
    n = rows.count()
    mu = np.zeros(width)
    for r in x.groupBy("term").agg(F.sum("value").alias("s")).collect():    # at most width rows
        mu[int(r["term"])] = r["s"] / n
    rng = np.random.default_rng(seed)
    k_out, k = k, min(width, k + 5)          # oversampled subspace converges faster
    v, _ = np.linalg.qr(rng.normal(size=(width, k)))
    for _ in range(rounds):
        xty, sy, _ = centred_products(rows, v, mu @ v)
        z = xty - np.outer(mu, sy)
        before = v
        v, _ = np.linalg.qr(z)
        # Sines of the angles between the old and new leading directions.
        moved = v[:, :k_out] - before @ (before.T @ v[:, :k_out])
        if np.abs(moved).max() < tol:
            break
    # Rayleigh-Ritz: order the basis by variance.
    yy = centred_products(rows, v, mu @ v)[2] / max(n - 1, 1)
    vals, rot = np.linalg.eigh(yy)
    order = np.argsort(-vals)[:k_out]
    comps = v @ rot[:, order]
    for c in range(k_out):
        m = np.argmax(np.abs(comps[:, c]))
        if comps[m, c] < 0:
            comps[:, c] = -comps[:, c]
    return comps, mu, vals[order]

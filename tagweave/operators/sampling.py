"""Sampling, splitting and folds.

All randomness is a hash of (seed, bag, id) (see ``functions.hashing``), so
every draw is repeatable, checkable in SQL, and identical across retries
after a lost executor.

Scale notes
-----------
* Per-tag truth sampling is ``row_number() over (partition by bag, tag order
  by hash) <= k``. Catalyst's group-limit rule plans a partial top-k before
  the shuffle, so a tag holding a third of all rows ships at most k rows per
  map task, never the whole tag.
* The untagged sample is a hash-threshold filter (the Bernoulli sample, pushed
  below the joins) plus an order-by-hash limit, i.e. a partial top-k as well.
* Wide columns (text, fingerprint, translation) are joined only after the
  ids are chosen, so they never go through the window shuffle.
* Bags are a column: one job draws all bags; nothing loops on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.functions.hashing import hash01, md5_order
from tagweave.operators.ranking import ordered_rank
from tagweave.session import cut_lineage


def _bags(df: DataFrame, n_bags: int | None) -> DataFrame:
    """Add a ``bag_id`` column: 0 for a single sample, else one copy per bag
    (a narrow explode, no shuffle)."""
    if n_bags is None:
        return df.withColumn("bag_id", F.lit(0))
    return df.withColumn("bag_id", F.explode(F.sequence(F.lit(0), F.lit(n_bags - 1))))


def tagged_rows(views, tagset_id: int, sources: Sequence[int], langs: Sequence[str]) -> DataFrame:
    """Data ⋈ tagging ⋈ tag_tagset(tagset) ⋈ source(in list) ⋈ language(in list).
    Returns (id, tag_id, language); repeats rows whose parts repeat."""
    data = views.data().where(F.col("source_id").isin(list(sources)))
    tagging = views.tagging()
    tts = views.tag_tagset().where(F.col("tagset_id") == tagset_id).select("tag_id")
    src = views.source().where(F.col("id").isin(list(sources))).select(F.col("id").alias("src_id"))
    lang = views.language().where(F.col("language").isin(list(langs)))
    return (data.join(tagging, data.id == tagging.data_id)
            .join(F.broadcast(tts), "tag_id")           # tag_tagset: a handful of rows per tagset
            .join(src, data.source_id == src.src_id)
            .join(lang, data.id == lang.data_id)
            .select(data.id, "tag_id", "language"))


def truth_sample(tagged: DataFrame, num_truths: int, seed, n_bags: int | None = None) -> DataFrame:
    """W1 + F4: at most ``num_truths`` rows per (bag, tag) in hash order."""
    t = _bags(tagged, n_bags)
    w = Window.partitionBy("bag_id", "tag_id").orderBy(md5_order(seed, F.col("bag_id"), F.col("id")), "id")
    return t.withColumn("rnr", F.row_number().over(w)).where(F.col("rnr") <= num_truths).drop("rnr")


def untagged_sample(views, tagged: DataFrame, sources: Sequence[int], langs: Sequence[str],
                    num_samples: int, seed, fraction: float = 0.3, n_bags: int | None = None,
                    min_chars: int = 64) -> DataFrame:
    """L1 + J5 + J2 + L2: Bernoulli(fraction) sample of data in the sources and
    languages with text longer than ``min_chars``, minus tagged ids, first
    ``num_samples`` in hash order (per bag)."""
    data = views.data().where(F.col("source_id").isin(list(sources)))
    src = views.source().where(F.col("id").isin(list(sources))).select(F.col("id").alias("src_id"))
    lang = views.language().where(F.col("language").isin(list(langs)))
    txt = views.text().where(F.char_length("text") > min_chars).select(F.col("data_id").alias("t_data_id"))
    pool = (data.join(src, data.source_id == src.src_id)
            .join(lang, data.id == lang.data_id)
            .join(txt, data.id == txt.t_data_id)
            .select(data.id, "language"))
    # NOT IN (tagged): ids are never null, so a plain anti join (no null-aware
    # plan); before the bags, so that the table is shuffled once, not once a bag.
    pool = pool.join(tagged.select("id").distinct(), "id", "left_anti")
    pool = _bags(pool, n_bags)
    pool = pool.where(hash01(seed, F.col("bag_id"), F.col("id")) < fraction)
    w = Window.partitionBy("bag_id").orderBy(md5_order(seed, F.col("bag_id"), F.col("id")), "id", "language")
    return (pool.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= num_samples)
            .drop("rn").withColumn("tag_id", F.lit(None).cast("int")))


#: Ids of a sample that a filter holds; larger samples are only joined.
FILTER_IDS = 50_000


def semi_supervised_sample(views, tagset_id: int, sources: Sequence[int], langs: Sequence[str] = ("en", "de"),
                           num_truths: int = 48, num_samples: int = 128, seed=1,
                           n_bags: int | None = None) -> DataFrame:
    """≤num_truths random rows per tag ∪ num_samples untagged rows, joined to
    text, fingerprint, time and the optional English translation (J3, J4, U1).

    Output: (bag_id, id, tag_id, language, text, time, fingerprint, translation)."""
    tagged = tagged_rows(views, tagset_id, sources, langs)
    truths = truth_sample(tagged, num_truths, seed, n_bags)
    randoms = untagged_sample(views, tagged, sources, langs, num_samples, seed, n_bags=n_bags)
    ids = cut_lineage(randoms.unionByName(truths.select("id", "language", "bag_id", "tag_id")))
    # The sample's size is fixed by its parameters, so its ids can be a filter, which goes below the
    # fingerprint (a join doesn't): only sampled documents get one, and only their texts move.
    few = [r["id"] for r in ids.select("id").distinct().limit(FILTER_IDS + 1).collect()]
    sampled = F.col("data_id").isin(few) if len(few) <= FILTER_IDS else F.lit(True)

    data = views.data()
    src = views.source().select(F.col("id").alias("src_id"))
    text = views.text().select(F.col("id").alias("text_id"), "data_id", "text").where(sampled)
    fp = views.fingerprint().where(sampled)
    tm = views.time().where(sampled)
    tr = views.translation().where(F.col("target_language") == "en").select("text_id", "translation")
    out = (data.join(ids, "id")
           .join(src, data.source_id == src.src_id)
           .join(text.withColumnRenamed("data_id", "id"), "id")
           .join(fp.withColumnRenamed("data_id", "id"), "id")
           .join(tm.withColumnRenamed("data_id", "id"), "id")
           .join(tr, "text_id", "left"))
    return out.select("bag_id", "id", "tag_id", "language", "text", "time", "fingerprint", "translation")


def to_samples(sample: DataFrame) -> DataFrame:
    """(label, text, fingerprint, time). ``tag_id or -1`` (0 and null -> -1),
    ``translation or text`` ('' and null -> text)."""
    label = F.coalesce(F.nullif(F.col("tag_id"), F.lit(0)), F.lit(-1)).cast("int")
    txt = F.coalesce(F.nullif(F.col("translation"), F.lit("")), F.col("text"))
    return sample.select("bag_id", "id", label.alias("label"), txt.alias("sample_text"),
                         "fingerprint", "time")


# --- L1 / L7 / L13 ------------------------------------------------------------
def bernoulli(df: DataFrame, id_col: str, fraction: float, seed=1, bag=0) -> DataFrame:
    """L1: repeatable Bernoulli table sample."""
    return df.where(hash01(seed, bag, F.col(id_col)) < fraction)


def hash_split(df: DataFrame, id_col: str, test_size: float, seed=42) -> DataFrame:
    """train/test split column by a hash draw (``split`` in {train, test})."""
    return df.withColumn("split", F.when(hash01(seed, 0, F.col(id_col)) < test_size, "test").otherwise("train"))


def seeded_order(seed, id_col: str) -> list[Column]:
    """Sort keys for a repeatable shuffle."""
    return [md5_order(seed, 0, F.col(id_col)), F.col(id_col)]


# --- W6 / L8 / L9 ---------------------------------------------------------------
def seed_split(df: DataFrame, id_col: str, label_col: str, seed=1, share: float = 0.75,
               fold_col: str | None = None, per_class: bool = True) -> DataFrame:
    """Per class (and fold), a random ``share`` of the labelled rows go to
    train, at least one; the rest to test. Unlabelled rows (label < 0) get
    ``seed_role = null``. Adds ``seed_role`` in {train, test}."""
    parts = ([fold_col] if fold_col else []) + ([label_col] if per_class else [])
    fold = F.col(fold_col) if fold_col else F.lit(0)
    key = md5_order(seed, fold, F.col(id_col))
    lab = df.where(F.col(label_col) >= 0)
    # Classes are few and large: exact per-class ranks without one task per class.
    lab = ordered_rank(lab, parts, [key, F.col(id_col)], "__rn", "__n")
    n = F.col("__n")
    limit = F.greatest(F.lit(1), F.floor(n * share)) if per_class else F.floor(n * share)
    lab = lab.withColumn("seed_role", F.when(F.col("__rn") <= limit, "train").otherwise("test")) \
        .drop("__rn", "__n")
    unl = df.where(~(F.col(label_col) >= 0)).withColumn("seed_role", F.lit(None).cast("string"))
    return lab.unionByName(unl)


def seeded_folds(df: DataFrame, id_col: str, label_col: str, n_folds: int = 3, seed=1,
                 limit_train: int = -1, leak: bool = False) -> DataFrame:
    """For every fold, train = random ``limit_train`` rows (-1 = all) ∪ 75 %
    of each class's seeds (≥1), made unique (U2); test = the other seeds.
    ``leak=True`` keeps the reference's behaviour of training on every row when
    ``limit_train == -1`` (test seeds included, Q5); default removes test seeds
    from train. Output: (fold, id, label, role) with role in {train, test}."""
    folds = df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    split = seed_split(folds, id_col, label_col, seed, 0.75, fold_col="fold")
    seeds_train = split.where(F.col("seed_role") == "train").select("fold", id_col, label_col)
    seeds_test = split.where(F.col("seed_role") == "test").select("fold", id_col, label_col)
    if limit_train >= 0:
        w = Window.partitionBy("fold").orderBy(md5_order(seed, F.col("fold"), F.col(id_col)), id_col)
        rnd = folds.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit_train) \
            .select("fold", id_col, label_col)
    else:
        rnd = folds.select("fold", id_col, label_col)
    train = rnd.unionByName(seeds_train).distinct()
    if not leak:
        train = train.join(seeds_test.select("fold", id_col), ["fold", id_col], "left_anti")
    return (train.withColumn("role", F.lit("train"))
            .unionByName(seeds_test.withColumn("role", F.lit("test"))))


def simple_seed_split(df: DataFrame, id_col: str, label_col: str, seed=1,
                      limit_train: int = -1) -> DataFrame:
    """L9 (+U3, L5): train = every unlabelled row + 75 % of the seeds; test = the
    true complement of the seeds (Q4 fixed). ``limit_train > 0`` keeps the
    last ``limit_train - 1`` train rows in (unlabelled first, then seeds) order,
    reversed — the ``[-1:-n:-1]`` slice."""
    s = seed_split(df, id_col, label_col, seed, 0.75, per_class=False)
    train = s.where(F.col("seed_role").isNull() | (F.col("seed_role") == "train"))
    test = s.where(F.col("seed_role") == "test")
    if limit_train > 0:
        order = [F.when(F.col("seed_role").isNull(), 0).otherwise(1).desc(),
                 md5_order(seed, 0, F.col(id_col)).desc(), F.col(id_col).desc()]
        train = train.orderBy(*order).limit(limit_train - 1)
    return (train.select(id_col, label_col).withColumn("role", F.lit("train"))
            .unionByName(test.select(id_col, label_col).withColumn("role", F.lit("test"))))


# --- L10 ------------------------------------------------------------------------
def circular_tuples(items: DataFrame, pos_col: str, group_size: int) -> DataFrame:
    """L10 ``ntuples``: for n items at positions 0..n-1, tuple i holds the items
    at positions i, i+1, ..., i+group_size-1 (mod n). Output (tuple_id, slot, item...)."""
    n = items.select(F.count(F.lit(1))).scalar()
    slots = items.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(group_size - 1))))
    return slots.withColumn("tuple_id", F.pmod(F.col(pos_col) - F.col("slot"), n))


def fold_pairs(n_folds: int, spark) -> DataFrame:
    """L10 as the search uses it: fold i trains on fold i, tests on fold (i+1) mod n."""
    return spark.range(n_folds).select(F.col("id").cast("int").alias("train_fold"),
                                       F.pmod(F.col("id") + 1, F.lit(n_folds)).cast("int").alias("test_fold"))


# --- L11 / T24 ------------------------------------------------------------------
def uniform_int(seed, draw: Column, name: str, low: int, high: int) -> Column:
    """``randint(low, high)`` (high excluded) keyed by (seed, draw, name)."""
    u = hash01(seed, draw, F.lit(name))
    return (F.lit(low) + F.floor(u * (high - low))).cast("int")


def expon(seed, draw: Column, name: str, scale: float) -> Column:
    u = hash01(seed, draw, F.lit(name))
    return -F.lit(scale) * F.log(F.lit(1.0) - u)


def choice(seed, draw: Column, name: str, options: list) -> Column:
    u = hash01(seed, draw, F.lit(name))
    arr = F.array(*[F.lit(o) for o in options])
    return F.element_at(arr, (F.floor(u * len(options)) + 1).cast("int"))


def weight_dist(seed, draw: Column, names: Sequence[str]) -> Column:
    """A random weight set name -> [0, 1) (MAP<STRING, DOUBLE>)."""
    return F.create_map(*[x for nm in names for x in (F.lit(nm), hash01(seed, draw, F.lit("w_" + nm)))])

"""Language identification (T14, F7) and translation routing.

Language identification is a multinomial naive Bayes over character
trigrams, trained with Spark on a labelled corpus (``documents.lang``):

* text: U+007F and backspace removed, lower-cased, whitespace runs -> one
  space, padded with a space at both ends; every trigram of the whole text;
* P(g | l) = (count(g, l) + 1) / (N_l + |V|) over the training trigram
  vocabulary V; prior P(l) = share of training documents;
* score(d, l) = ln P(l) + sum over trigrams g of d in V of count(d, g) ln P(g | l);
* null, empty or trigram-less text -> 'un' (the reference's unknown code).

Plan: trigram counts per document are a per-row expression (sort-and-run-
length, no shuffle). The model is one row per trigram with one weight column
per language (languages are few); scoring joins (doc, trigram, count) with
it on the trigram and sums per document — partial aggregation, bounded
groups. A frequent trigram is a hot join key only on the document side; the
model side has one row per key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.functions.text import PY_SPACE, token_counts
from tagweave.session import cut_lineage

UNKNOWN = "un"
MAX_BROADCAST_GRAMS = 5_000_000


def clean(text: Column) -> Column:
    t = F.regexp_replace(text, "[\\x{7f}\\x{08}]", "")
    t = F.regexp_replace(F.lower(t), f"[{PY_SPACE}]+", " ")
    return F.concat(F.lit(" "), F.trim(t), F.lit(" "))


def trigrams(text: Column) -> Column:
    """Every (overlapping) character trigram of the cleaned text, in one linear
    regex pass: a zero-width match at every position capturing the next three
    characters. (Indexing a UTF-8 string by character position is linear in
    the position, so a substring per position would be quadratic.)"""
    return F.regexp_extract_all(clean(text), F.lit("(?s)(?=(.{3}))"), F.lit(1))


def gram_occurrences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, gram): one row per trigram occurrence (no per-document counting:
    sums over occurrences equal count-weighted sums, and partial aggregation
    collapses them before any shuffle)."""
    g = F.when(F.char_length(F.trim(F.coalesce(F.col(text_col), F.lit("")))) > 0, trigrams(F.col(text_col))) \
        .otherwise(F.array().cast("array<string>"))
    return df.select(F.col(id_col).alias("id"), F.explode(g).alias("gram"))


def gram_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, gram, cnt) per document (sort-and-run-length per row, no shuffle)."""
    g = F.when(F.char_length(F.trim(F.coalesce(F.col(text_col), F.lit("")))) > 0, trigrams(F.col(text_col))) \
        .otherwise(F.array().cast("array<string>"))
    return df.select(F.col(id_col).alias("id"), F.explode(token_counts(g)).alias("gram", "cnt"))


def fit(train: DataFrame, id_col: str, text_col: str, lang_col: str):
    """Fit the model: (gram, lp_<lang>...) table, languages, priors."""
    langs = [r[0] for r in train.select(lang_col).distinct().orderBy(lang_col).collect()]   # a few codes
    occ = train.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).alias("lang"))
    occ = occ.select("lang", F.explode(F.when(F.char_length(F.trim(F.coalesce("t", F.lit("")))) > 0,
                                              trigrams(F.col("t"))).otherwise(F.array().cast("array<string>")))
                     .alias("gram"))
    c = cut_lineage(occ.groupBy("gram").pivot("lang", langs).count().fillna(0))
    n_l = {l: float(v or 0) for l, v in zip(langs, c.select(*[F.sum(F.col(f"`{l}`")) for l in langs]).first())}
    v = c.count()
    model = c.select("gram", *[F.log((F.col(f"`{l}`") + 1.0) / F.lit(n_l.get(l, 0.0) + v)).alias(f"lp_{l}")
                               for l in langs])
    n_docs = train.count()
    priors = {r[0]: r[1] / n_docs for r in train.groupBy(lang_col).count().collect()}
    return model, langs, priors


def detect(df: DataFrame, id_col: str, text_col: str, model) -> DataFrame:
    """(id, lang_id) for every row; 'un' for null / empty / no known trigram."""
    table, langs, priors = model
    g = gram_occurrences(df.select(id_col, text_col), id_col, text_col)
    # The model has one row per training trigram (bounded by the alphabet's
    # trigrams); broadcast it when the count allows, else a shuffle join.
    small = table.count() <= MAX_BROADCAST_GRAMS
    j = g.join(F.broadcast(table) if small else table, "gram")
    s = j.groupBy("id").agg(*[F.sum(f"lp_{l}").alias(f"s_{l}") for l in langs])
    cand = F.array(*[F.struct((-(F.col(f"s_{l}") + F.lit(math.log(priors[l])))).alias("neg"), F.lit(l).alias("lang"))
                     for l in langs])
    best = s.select("id", F.array_min(cand)["lang"].alias("lang_id"))
    return df.select(F.col(id_col).alias("id")).join(best, "id", "left").select(
        F.col("id").alias(id_col), F.coalesce("lang_id", F.lit(UNKNOWN)).alias("lang_id"))


def only(df: DataFrame, detected: DataFrame, id_col: str, lang: str) -> DataFrame:
    """rows whose detected language is ``lang`` (is_english / is_german)."""
    return df.join(detected.where(F.col("lang_id") == lang).select(id_col), id_col, "left_semi")


# --- M26 / J15 translation routing ---------------------------------------------------------------
# Source languages with a translation back end in the reference.
TRANSLATABLE = ("de", "es")


def route_translations(texts: DataFrame, id_col: str, lang_col: str, memory: DataFrame,
                       target: str = "en", batch_fn=None) -> DataFrame:
    """M26 (+J15): per row, the text in the target language — same language:
    the text itself; a translatable language: the translation memory's entry
    (``memory``: (id, target_language, translation)) or, when ``batch_fn`` is
    given, its output for rows the memory lacks (called on Arrow batches in
    ``mapInPandas``, grouped by source language inside each batch); any other
    language: null. Joins on the id, so no ordering is needed."""
    mem = memory.where(F.col("target_language") == target).select(F.col("id").alias(id_col), "translation")
    j = texts.join(mem, id_col, "left")
    routed = (F.when(F.col(lang_col) == target, F.col("text"))
              .when(F.col(lang_col).isin(*TRANSLATABLE), F.col("translation")))
    out = j.select(id_col, lang_col, "text", routed.alias("translated"))
    if batch_fn is None:
        return out.drop("text")

    def fill(batches):
        for pdf in batches:
            need = pdf["translated"].isna() & pdf[lang_col].isin(TRANSLATABLE)
            for lang, idx in pdf[need].groupby(lang_col).groups.items():
                pdf.loc[idx, "translated"] = batch_fn(list(pdf.loc[idx, "text"]), lang, target)
            yield pdf.drop(columns=["text"])

    schema = out.drop("text").schema
    return out.mapInPandas(fill, schema)

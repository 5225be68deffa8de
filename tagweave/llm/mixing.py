"""Mixing sources to target weights by pivotal dependent rounding.

A source's documents all get the same expected number of copies, target over
source size. The whole part is given to each; the fraction is a probability
that is rounded dependently: two documents exchange probability mass, weighted
by their sizes, until one of them is at 0 or 1. The words a source takes do not
change by an exchange, and every expectation is kept. One document of a group
stays fractional; the fractional ones of all groups meet in groups of the next
level, and so on up a reduction tree of fixed fan-in, until one for each source
is left. Of that one the mix takes its fraction of the words, so a source meets
its target to the word (``mix``). ``mixed_documents`` rounds it to the nearer
side and repeats whole documents, so a source misses its target there by half a
document at most.

A group is a bounded number of documents of one source: a source that holds a
third of all rows has a third of the groups. Only (id, source, size) move, never
a text. Draws are hashes of the seed and the id, so reruns agree.

Defined results: null texts have size 0; a null source is a source of its own,
last in order; documents without words get copies by an independent draw and
take 0 words; rows that repeat (doc_id, source, size) are one unit and get the
same copies; empty tables give empty results; other columns are ignored by
``mix`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.llm.common import WORD, stored

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
GROUP = 1024
SEED = 17


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target): shares of all words by weight, each at
    most ``most`` times the source; what is over goes to the others by weight,
    round by round, until none is above."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source; names are few and the ranks need one order.
    rank = F.row_number().over(Window.orderBy(F.encode("source", "UTF-8").asc_nulls_last())) - 1
    by = stored(by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
                .withColumn("cap", (most * F.col("source_size")).cast("double")))
    level, capped = 0.0, -1
    while True:
        # Sources whose share at this level is above their cap stop at it.
        over = F.col("weight") * level > F.col("cap")
        total, held, free, n = by.agg(
            F.sum("source_size"), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight"))),
            F.count(F.when(over, 1))).first()
        if not total or n == capped:
            break
        level, capped = ((total - (held or 0.0)) / free if free else 0.0), n
    share = F.least(F.col("weight") * F.lit(level), F.col("cap"))
    return by.select("source", "source_size", share.alias("target"))


def _uniform(*parts) -> float:
    h = hashlib.blake2b("\x1f".join(map(str, parts)).encode(), digest_size=8).digest()
    return int.from_bytes(h, "little") / 2.0 ** 64


def pivot(words: np.ndarray, p: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Round the fractions ``p`` of units of ``words`` each, one pair after the
    other. Returns the fractions, all 0 or 1 but the one at the index (-1: none)."""
    p, open_ = p.astype(float).copy(), -1
    for i in range(len(p)):
        if not 0.0 < p[i] < 1.0:
            continue
        if open_ < 0:
            open_ = i
            continue
        a, b = words[open_], words[i]
        up = min((1.0 - p[open_]) * a, p[i] * b)      # words that can move from i to the open one
        down = min(p[open_] * a, (1.0 - p[i]) * b)    # or the other way
        move = up if draws[i] * (up + down) < down else -down
        p[open_] += move / a
        p[i] -= move / b
        for j in (open_, i):
            if p[j] < 1e-9 or p[j] > 1 - 1e-9:
                p[j] = round(p[j])
        left = [j for j in (open_, i) if 0.0 < p[j] < 1.0]
        open_ = left[0] if left else -1
    return p, open_


def _level(frame: pd.DataFrame, seed: int, level: int) -> pd.DataFrame:
    f = frame.assign(o=[_uniform(seed, level, "order", d) for d in frame["doc_id"]])
    f = f.sort_values(["words", "o", "doc_id", "size"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    draws = np.array([_uniform(seed, level, "draw", d, w) for d, w in zip(f["doc_id"], f["words"])])
    p, left = pivot(f["words"].to_numpy(float), f["p"].to_numpy(float), draws)
    f["p"] = p
    f["open"] = np.arange(len(f)) == left
    return f.drop(columns="o")


def copies(sized: DataFrame, targets: DataFrame, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """(doc_id, source, size, copies, part) for every distinct (doc_id, source,
    size) of ``sized``: whole copies, and the fraction left to one unit of each source."""
    units = sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m"))
    rate = targets.select(F.col("source").alias("s"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
                          .otherwise(F.lit(1.0)).alias("rate"))
    # A source is a row of ``targets``; the join key is never hot on that side.
    units = units.join(rate, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # A rate of exactly 3 may come out as 2.999999: whole numbers are meant then.
    near = F.when(F.abs(F.col("rate") - F.round("rate")) < 1e-9, F.round("rate")).otherwise(F.col("rate"))
    units = units.withColumn("rate", near).withColumn("whole", F.floor("rate"))
    units = units.withColumn("p", F.col("rate") - F.col("whole")).withColumn("words", F.col("size") * F.col("m")).withColumn("open", F.lit(False))
    units = stored(units.select("doc_id", "source", "size", "whole", "p", "words", "open"))
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    fixed = F.when(F.col("words") == 0, (draw < F.col("p")).cast("double")).otherwise(F.col("p"))
    units = units.withColumn("p", fixed)
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    done, level, rest = [units.where(~open_)], 0, units.where(open_)
    while True:
        count = rest.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        most = count.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            break
        n = F.greatest(F.ceil(F.col("n") / group), F.lit(1)).alias("groups")
        dealt = rest.join(count.select(F.col("source").alias("s"), n), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        number = F.pmod(F.xxhash64(F.lit(seed + level), "doc_id", "size"), F.col("groups"))
        lvl = level
        rounded = stored(dealt.withColumn("group", number).drop("groups").groupBy("source", "group").applyInPandas(
            lambda f: _level(f, seed, lvl).drop(columns="group"),
            "doc_id long, source string, size long, whole long, p double, words long, open boolean"))
        done.append(rounded.where("NOT open"))
        rest, level = rounded.where("open"), level + 1
    out = done[0]
    for d in [*done[1:], rest]:
        out = out.unionByName(d)
    part = F.when((F.col("p") > 0) & (F.col("p") < 1), F.col("p")).otherwise(0.0)
    return out.select("doc_id", "source", "size", (F.col("whole") + F.floor("p")).cast("bigint").alias("copies"), part.alias("part"))


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, part, source: one row per row of ``docs``."""
    sized = stored(_sized(docs))
    targets = source_targets(sized, weights, most)
    units = copies(sized, targets, seed)
    u, t = units.alias("u"), targets.alias("t")
    same = (F.col("d.doc_id").eqNullSafe(F.col("u.doc_id")) & F.col("d.source").eqNullSafe(F.col("u.source"))
            & (F.col("d.size") == F.col("u.size")))
    x = sized.alias("d").join(u, same).select("d.*", "copies", "part").alias("x")
    x = x.join(t, F.col("x.source").eqNullSafe(F.col("t.source")))
    taken = (F.col("size") * F.col("copies") + F.round(F.col("size") * F.col("part"))).cast("bigint")
    return x.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "copies", "part", F.col("x.source").alias("source"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """The mix itself in whole documents: each row of ``docs`` as often as its
    copies say (the last fraction of a source rounded), all columns as they were."""
    # Whole rows are one column beside the keys, so that no name of theirs clashes.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col("doc_id").alias("id"), F.col("source").cast("string").alias("of"), size_of(F.col("text")).alias("words"))
    sized = stored(keyed.select(F.col("id").alias("doc_id"), F.col("of").alias("source"), F.col("words").alias("size")))
    n = (F.col("copies") + F.round("part")).cast("bigint").alias("n")
    units = copies(sized, source_targets(sized, weights, most), seed).select("doc_id", "source", "size", n).where("n > 0")
    same = F.col("id").eqNullSafe(F.col("doc_id")) & F.col("of").eqNullSafe(F.col("source")) & (F.col("words") == F.col("size"))
    taken = keyed.join(units, same).select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).select("row.*")
    return taken.toDF(*docs.columns)

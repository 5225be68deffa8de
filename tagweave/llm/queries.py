"""The registered queries of this folder and their DuckDB forms."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm import (chat, epsilon_grid, fingerprints, html_text, language_id, license_scan, mixing, near_dup, packing, periodic,
                          quality, repeats, spelling)
from tagweave.llm.common import prepare, table


def op1_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into power-of-two sequences of at most 2048 tokens."""
    prepare(spark)
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    prepare(spark)
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 1, 2, 3 by source."""
    prepare(spark)
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "part")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the threshold table for every document."""
    return quality.quality_scores(table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets are similar to 0.85."""
    prepare(spark)
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


def op6_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by the nearest learned centroid."""
    prepare(spark)
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op8_fuzzy_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in every document."""
    prepare(spark)
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document that earlier documents hold in a 50-byte string."""
    prepare(spark)
    return repeats.removals(table(spark, sf_dir, "documents"))


def op10_incremental_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, with its loss mask, and conversation -7, whose texts hold control strings."""
    prepare(spark)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat.format_conversations(rows.unionByName(added)).drop("formatted", "spans")


def op11_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors whose cosine is 0.95 or more."""
    prepare(spark)
    return epsilon_grid.near_vectors(table(spark, sf_dir, "embeddings"))


def misspelt(doc_id: str, word: bytes) -> bytes:
    """The word, in one case of 199 without one character, chosen by document and word."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), zlib.crc32(f"{doc_id}:".encode()))
    return word if h % 199 else word[:h % len(word)] + word[h % len(word) + 1:]


def op12_variable_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of six characters and more with their near words, forms and roots."""
    prepare(spark)
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), edit=misspelt))


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, in one document of ten with a stretch that repeats to the end: every word from ``a`` on is the one
    that stands ``(i - a) % p`` behind word ``a``. A document without an id stays as it is."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a]


def op13_grammar_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, and its text without the repeats."""
    prepare(spark)
    found = periodic.collapsed_runs(table(spark, sf_dir, "documents"), looped)
    # Runs come by start, then period: of equal exponents the first stays.
    best = F.aggregate("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda most, r: F.when(
        most.isNull() | (r["length"] * most["period"] > most["length"] * r["period"]), r).otherwise(most))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_power_of_two_packing, op2_html_blocks, op3_pivotal_mixing, op4_quality_rules, op5_minhash_near_dedup,
    op6_centroid_language, op7_closed_syncmers, op8_fuzzy_notices, op9_repeated_passages, op10_incremental_chat,
    op11_epsilon_grid, op12_variable_grams, op13_grammar_runs)}

SQL: dict[str, str] = {"op4_quality_rules": quality.SQL}

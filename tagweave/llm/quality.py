"""Quality rules: a threshold table compiled into one Spark projection.

Every figure is a built-in expression over the whole text; no user function
runs and nothing is shuffled, so the job is one scan at any size. Words are
``[^\\x20\\x09-\\x0D]+``, lines are ``\\n``-split.

Repeated words: the 3-word windows of a text are hashed (64 bits) and sorted
with their positions; windows with an equal neighbour are repeated, and their
positions, sorted again, give the covered words by one fold. That is
O(n log n) for any text; no window set is searched per word.

Defined results: null text counts as no words and fails the base rules; an
empty table gives an empty result; repeated rows get equal verdicts; other
columns, whatever their names, pass through ``kept_documents`` untouched and
are ignored by ``quality_scores``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.functions.text import let
from tagweave.llm.common import WORD

#: Fixed word list: the most frequent function words of the four languages.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the",
    "this", "to", "was", "what", "with",
    "au", "avec", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui",
    "sur", "un", "une",
    "auf", "das", "dem", "den", "der", "die", "ein", "eine", "ist", "mit", "nicht", "sich", "und", "von", "zu", "im",
    "con", "el", "es", "las", "lo", "los", "no", "para", "por", "se", "una", "y",
)

MIN_WORDS = 50
REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """Keep a text whose ``ratio`` lies between the bounds (null: no bound)."""
    ratio: str
    least: float | None
    most: float | None


#: The threshold table. A ratio over no words or lines is 0.
RULES = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbols_per_word", None, 0.1),
    Rule("stop_word_share", 0.02, None),
    Rule("duplicate_line_share", None, 0.5),
    Rule("ellipsis_line_share", None, 0.3),
    Rule("bullet_line_share", None, 0.9),
)


def _repeat_words(words: Column, n: Column) -> Column:
    grams = F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(0))),
                        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def covered(g: Column) -> Column:
        at = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def by_position(s: Column) -> Column:
            same = lambda x, i, j: F.get(s, j)["h"].eqNullSafe(x["h"])
            dup = F.filter(s, lambda x, i: same(x, i, i + 1) | ((i > 0) & same(x, i, i - 1)))
            starts = F.array_sort(F.transform(dup, lambda x: x["i"]))
            zero = F.struct(F.lit(0).cast("bigint").alias("covered"), F.lit(-3).alias("last"))
            step = lambda a, x: F.struct(
                (a["covered"] + F.least(F.lit(3), x - a["last"])).alias("covered"), x.alias("last"))
            return F.aggregate(starts, zero, step)["covered"]

        distinct = F.size(F.array_distinct(g)) == F.size(g)
        return F.when(distinct, F.lit(0).cast("bigint")).otherwise(let(at, by_position))

    return F.when(n < 3, F.lit(0).cast("bigint")).otherwise(let(grams, covered))


def measures(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Struct of all counts of one text."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    count = lambda c: c.cast("bigint")

    def of_words(w: Column) -> Column:
        n = F.size(w)
        return F.struct(
            count(n).alias("n_words"),
            _repeat_words(w, n).alias("n_repeat_words"),
            count(F.size(F.filter(w, lambda x: F.lower(x).isin(*stop_words)))).alias("n_stop_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(
            count(F.size(x)).alias("n_lines"),
            count(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
            count(F.size(F.filter(x, lambda s: s.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$")))).alias("n_ellipsis_lines"),
            count(F.size(F.filter(x, lambda s: s.rlike(r"^[\x20\x09-\x0D]*[•*\-][\x20\x09]")))).alias("n_bullet_lines"))

    return F.struct(
        let(words, of_words).alias("w"), let(lines, of_lines).alias("l"),
        count(F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))).alias("word_chars"),
        count(F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).alias("n_symbols"))


def _ratios(m: Column) -> dict[str, Column]:
    over = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / F.greatest(b, F.lit(1)))
    words, lines = m["w"]["n_words"], m["l"]["n_lines"]
    return {
        "mean_word_chars": over(m["word_chars"], words),
        "symbols_per_word": over(m["n_symbols"], words),
        "stop_word_share": over(m["w"]["n_stop_words"], words),
        "duplicate_line_share": over(m["l"]["n_dup_lines"], lines),
        "ellipsis_line_share": over(m["l"]["n_ellipsis_lines"], lines),
        "bullet_line_share": over(m["l"]["n_bullet_lines"], lines),
    }


def base_failed(m: Column) -> Column:
    words = m["w"]["n_words"]
    return (words < MIN_WORDS) | (100 * m["w"]["n_repeat_words"] > REPEAT_PERCENT * words)


def passes(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one boolean expression."""
    ratios, ok = _ratios(m), F.lit(True)
    for r in rules:
        if r.least is not None:
            ok = ok & (ratios[r.ratio] >= r.least)
        if r.most is not None:
            ok = ok & (ratios[r.ratio] <= r.most)
    return ok


def quality_scores(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: counts, ``base_failed`` and ``kept``."""
    m = F.col("m")
    return docs.select("doc_id", measures(F.col("text")).alias("m")).select(
        "doc_id", m["w"]["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"),
        m["n_symbols"].alias("n_symbols"), m["l"]["n_dup_lines"].alias("n_dup_lines"),
        m["w"]["n_repeat_words"].alias("n_repeat_words"), base_failed(m).alias("base_failed"),
        (~base_failed(m) & passes(m, rules)).alias("kept"))


def kept_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, all columns as they were."""
    m = measures(F.col("text"))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), m.alias("m"))
    held = held.where(~base_failed(F.col("m")) & passes(F.col("m"), rules))
    return held.select("row.*")


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)

#: DuckDB form of ``quality_scores`` over the table ``documents``.
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), pos AS (
  SELECT rid, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3
), gram AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM pos
), dup AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM gram
), cov AS (
  SELECT rid, count(DISTINCT i + o) AS n_repeat_words
  FROM dup, (SELECT unnest([0, 1, 2]) AS o) WHERE c >= 2 GROUP BY rid
), f AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(list_filter(words, lambda x: list_contains([{_STOP_SQL}], lower(x)))) AS n_stop, len(lines) AS n_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ell,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[•*\-][\x20\x09]'))) AS n_bul
  FROM w LEFT JOIN cov USING (rid)
), b AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2 AND 15 AND n_symbols / n_words <= 0.1
       AND n_stop / n_words >= 0.02 AND n_dup_lines / n_lines <= 0.5 AND n_ell / n_lines <= 0.3
       AND n_bul / n_lines <= 0.9 AS kept
FROM b
"""

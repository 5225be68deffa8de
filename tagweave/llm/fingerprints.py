"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text is cut into tokens: runs of at most 16 characters that aren't ASCII
white space. Of every window of ``k`` = 5 tokens the inner windows of ``s`` = 2
tokens are hashed; the window is an anchor if the least of them stands at its
first or last place. That depends on the window alone, so a passage has the
same anchors wherever it stands. The fingerprint is all anchors of the text,
with their positions and in their order. The likeness of two fingerprints is
the share they have in common of the distinct anchors and of the distinct pairs
of neighbours, which are two anchors in order and their distance: a common
passage counts wherever it stands, and anchors in another order count for less.

The next document is found by ranks over ids alone; a text moves once to its
own place and once to the document before it, and its anchors never move.

Defined results: null texts are empty, with an empty fingerprint; a text
without an anchor has the hash of all its text for one; the likeness of two
empty fingerprints is 1; a null doc_id comes last; repeated rows (equal id and
text) are one document in the order and get equal rows; a single document is its
own next; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.functions.text import let
from tagweave.llm.common import stored
from tagweave.operators.ranking import ordered_rank

TOKEN = r"[^\x20\x09-\x0D]{1,16}"
K, S = 5, 2
_NO_ID = -(1 << 63)


def anchors(text: Column) -> Column:
    """array<struct<pos, hash>>: the closed syncmers of a text, in order."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))

    def inner(t: Column) -> Column:
        return F.transform(F.slice(t, 1, F.greatest(F.size(t) - (S - 1), F.lit(0))), lambda x, i: F.xxhash64(x, F.get(t, i + 1)))

    def closed(h: Column) -> Column:
        # K - S + 1 = 4 inner hashes a window, at i .. i + 3; together they cover its tokens.
        def window(x: Column, i: Column) -> Column:
            last = F.get(h, i + 3)
            edge = F.least(x, last) <= F.least(F.get(h, i + 1), F.get(h, i + 2))
            return F.when(edge, F.struct(i.alias("pos"), F.xxhash64(x, F.get(h, i + 2), last).alias("hash")))
        return F.array_compact(F.transform(F.slice(h, 1, F.greatest(F.size(h) - (K - S), F.lit(0))), window))

    return let(let(tokens, inner), closed)


def fingerprint(text: Column) -> Column:
    """The anchors of a text, or the hash of all of it where it has none."""
    whole = F.struct(F.lit(0).alias("pos"), F.xxhash64(text).alias("hash"))
    return let(anchors(text), lambda a: F.when((F.size(a) > 0) | (text == ""), a).otherwise(F.array(whole)))


def to_string(prints: Column) -> Column:
    """Position and hash of each anchor, 8 and 16 hexadecimal digits."""
    return F.array_join(F.transform(prints, lambda a: F.concat(F.lpad(F.hex(a["pos"]), 8, "0"), F.lpad(F.hex(a["hash"]), 16, "0"))), "")


def units(prints: Column) -> Column:
    """The distinct anchors, and neighbours with their distance, as hashes."""
    def follow(a: Column, i: Column) -> Column:
        after = F.get(prints, i + 1)
        return F.xxhash64(a["hash"], after["hash"], after["pos"] - a["pos"])
    pairs = F.transform(F.slice(prints, 1, F.greatest(F.size(prints) - 1, F.lit(0))), follow)
    return F.array_distinct(F.concat(F.transform(prints, lambda a: a["hash"]), pairs))


def likeness(a: Column, b: Column) -> Column:
    """Common share of the units of two fingerprints (0 to 1)."""
    common, every = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    return F.when(every == 0, F.lit(1.0)).otherwise(common / F.greatest(every - common, F.lit(1)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next: one row per row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    # The id without null and a hash of the text name a document; equal rows are one.
    keyed = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).cast("bigint").alias("id"), F.col("doc_id").isNull().alias("none"), text.alias("text"))
    keyed = keyed.withColumn("h", F.xxhash64("text", "none"))
    slim = stored(keyed.select("id", "h", F.length("text").alias("n_chars")))
    one = slim.groupBy("id", "h").agg(F.max("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("m"))
    ranked = stored(ordered_rank(one, [], [F.bitwise_not(F.col("id")).alias("o"), "h"], "r", "n"))
    after = ranked.select(F.col("r").alias("r2"), F.col("id").alias("next_id"), F.col("h").alias("next_h"))
    pairs = ranked.join(after, (F.col("r") % F.col("n")) + 1 == F.col("r2")).select("id", "h", "next_id", "next_h")
    repeated = bool(one.where("m > 1").head(1))

    # The same exchange on both sides: a text is shuffled once.
    texts = keyed.select("id", "h", "text").repartition("id", "h")
    ahead = texts.select(F.col("id").alias("next_id"), F.col("h").alias("next_h"), F.col("text").alias("next_text"))
    ahead = ahead.join(pairs, ["next_id", "next_h"]).select("id", "h", "next_text")
    ahead = ahead.dropDuplicates(["id", "h"]) if repeated else ahead

    x = texts.join(ahead, ["id", "h"])
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    none = (F.col("id") == _NO_ID) & (F.col("h") == F.xxhash64("text", F.lit(True)))
    x = x.select(F.when(~none, F.col("id")).cast(docs.schema["doc_id"].dataType).alias("doc_id"), n.cast("bigint").alias("n_chars"),
                 F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"),
                 fingerprint(F.col("text")).alias("fp"), fingerprint(F.col("next_text")).alias("next_fp"))
    x = x.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fp", "next_fp",
                 fingerprint(F.col("edited")).alias("edited_fp"))
    x = x.select("doc_id", "n_chars", "edited_sha256", to_string(F.col("fp")).alias("fingerprint"), to_string(F.col("edited_fp")).alias("edited_fingerprint"),
                 units(F.col("fp")).alias("u"), units(F.col("edited_fp")).alias("edited_u"), units(F.col("next_fp")).alias("next_u"))
    return x.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                    likeness(F.col("u"), F.col("edited_u")).alias("near_edited"), likeness(F.col("u"), F.col("next_u")).alias("near_next"))

"""Text fingerprints (V13-V15) as per-row expressions.

The reference fetched fingerprints (sorted positions on a 128 x 128 grid)
from an outside service. We define a fingerprint we can compute on the
cluster: the bottom-k MinHash sketch of the text's word 1- and 2-shingles,
each kept shingle mapped to a grid position. Similar texts share many
positions; the same text always gets the same fingerprint; it is one
projection (no shuffle) and is SQL-checkable (md5).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagweave.functions.text import let

GRID = 128
FINGERPRINT_WIDTH = GRID * GRID      # 16,384 positions (128 x 128)
SKETCH_SIZE = 328                    # ~2 % density of the grid
WORD_SPLIT = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased words (letters and digits) of a text."""
    return F.filter(F.split(F.lower(text), WORD_SPLIT), lambda w: w != F.lit(""))


def shingles(ws: Column) -> Column:
    """Word 1-shingles followed by 2-shingles."""
    def body(w):
        n = F.size(w)
        bigrams = F.transform(F.sequence(F.lit(1), n - 1),
                              lambda i: F.concat(F.element_at(w, i), F.lit(" "), F.element_at(w, i + 1)))
        return F.concat(w, F.when(n >= 2, bigrams).otherwise(F.array().cast("array<string>")))
    return let(ws, body)


def fingerprint(text: Column, k: int = SKETCH_SIZE) -> Column:
    """Sorted distinct positions in [0, 16384) of the k smallest shingle
    hashes (ARRAY<INT>)."""
    hashes = F.transform(shingles(words(text)),
                         lambda s: F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint"))
    bottom = F.slice(F.array_sort(F.array_distinct(hashes)), 1, k)
    positions = F.transform(bottom, lambda h: F.pmod(h, F.lit(FINGERPRINT_WIDTH)).cast("int"))
    return F.array_sort(F.array_distinct(positions))


def check_positions(fp: Column) -> Column:
    """Positions outside the grid raise, like indexing past the grid does."""
    bad = F.exists(fp, lambda p: (p < 0) | (p >= FINGERPRINT_WIDTH))
    return F.when(bad, F.raise_error(F.lit("fingerprint position outside 0..16383"))).otherwise(fp)


def sparse_fingerprint(fp: Column) -> Column:
    """Distinct sorted positions (multi-hot, duplicates collapse)."""
    return F.array_sort(F.array_distinct(check_positions(fp)))


def dense_fingerprint(fp: Column) -> Column:
    """Dense multi-hot ARRAY<DOUBLE> of width 16,384. Only on request:
    it is 128 KiB per row; everything else keeps the sparse form."""
    return let(sparse_fingerprint(fp), lambda s: F.transform(
        F.sequence(F.lit(0), F.lit(FINGERPRINT_WIDTH - 1)),
        lambda i: F.when(F.array_contains(s, i), F.lit(1.0)).otherwise(F.lit(0.0))))

"""License scan: fuzzy search for short notices.

A text becomes its words (A-Z lowered, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``)
with one space between. Base phrases are counted exactly. Each notice is sought
with a bounded number of edits: cut into one piece more than edits allowed, one
piece at least must stand unchanged (pigeonhole), so exact search for the
pieces gives every candidate place; there the ``regex`` library's bounded-error
matching decides, counts the edits and gives the span. The whole text is
searched in one scan, row by row, and nothing is shuffled.

Defined results: null and empty texts have no words, empty labels and score 0;
repeated rows get equal rows; empty tables give empty results; other columns
are ignored.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame

#: Fixed phrases and labels of the base.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Short notices by label, as words.
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl-3.0", "gnu general public license version 3"),
    ("gpl-2.0", "gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "creative commons attribution license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification"),
    ("mpl-2.0", "subject to the terms of the mozilla public license"),
    ("unlicense", "free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved"),
)
#: One edit for so many characters of a notice.
CHARS_PER_EDIT = 12
#: Edits may not touch these: they tell one licence from another.
_EXACT = regex.compile(r"\b(?:\d+|nc|sa|mit|cc|by)\b")

_SPACES = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b
                for b in range(256))

SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, spans array<struct<label: string, first_word: long, last_word: long, edits: int>>")


def normal(text: str | None) -> tuple[bytes, int]:
    """The words with one space around each, and their number."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_SPACES).split(b" ")
    words = [w for w in words if w]
    return (b" " + b" ".join(words) + b" " if words else b""), len(words)


def base_places(flat: bytes) -> list[tuple[str, int]]:
    """(label, index of its first word) of every place of a base phrase; words are counted on from place to place."""
    out = []
    for phrase, label in BASE:
        needle, at, word = f" {phrase} ".encode(), -1, -1
        while (to := flat.find(needle, at + 1)) >= 0:
            word += flat.count(b" ", at + 1, to + 1)
            out.append((label, word))
            at = to
    return out


@lru_cache(maxsize=4)
def _compiled(notices: tuple, chars_per_edit: int) -> list[tuple]:
    """(label, notice, edits, pieces by their first character, pattern) of each notice."""
    out = []
    for label, notice in notices:
        edits = len(notice) // chars_per_edit
        cut = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
        pieces = tuple((a, notice[a:b]) for a, b in zip(cut, cut[1:]))
        out.append((label, notice, edits, pieces, regex.compile(rf"(?b)(?:{regex.escape(notice)}){{e<={edits}}}")))
    return out


def _spans(flat: bytes, notice: str, edits: int, pieces: tuple, pattern: regex.Pattern) -> dict[tuple[int, int], int]:
    """Edits of every run of whole words, as bytes of ``flat``, that has the exact words of the notice and at most
    ``edits`` edits. Each piece found is looked at on its own: what comes before and after it is within ``edits``
    characters (of four bytes at most) of what the notice has there."""
    exact, n, wide = _EXACT.findall(notice), len(notice), 4 * edits
    out: dict[tuple[int, int], int | None] = {}
    for a, piece in pieces:
        seed, before, after = piece.encode(), len(notice[:a].encode()), len(notice[a:].encode())
        for at in _finds(flat, seed):
            # A word starts after a space and ends before one; there is a space at both ends of the text.
            starts = [i + 1 for i in _finds(flat, b" ", max(0, at - before - wide - 1), min(at, at - before + wide))
                      if abs(len(flat[i + 1:at].decode("utf-8", "replace")) - a) <= edits]
            if not starts:
                continue
            ends = _finds(flat, b" ", max(at + len(seed), at + after - wide), at + after + wide + 1)
            for lo in starts:
                for hi in ends:
                    if (lo, hi) in out:
                        continue
                    text = flat[lo:hi].decode("utf-8", "replace")
                    m = pattern.fullmatch(text) if abs(len(text) - n) <= edits and _EXACT.findall(text) == exact else None
                    out[lo, hi] = sum(m.fuzzy_counts) if m else None
    return {k: v for k, v in out.items() if v is not None}


def fuzzy_places(flat: bytes, notices: tuple = NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> list[tuple[str, int, int, int, float]]:
    """(label, first word, last word, edits, score) of every notice found; a place is reported once for each notice:
    of spans that share a word the one with the fewest edits stays, then the first, then the longest."""
    out = []
    for label, notice, edits, pieces, pattern in _compiled(notices, chars_per_edit):
        spans, taken = _spans(flat, notice, edits, pieces, pattern), []
        for lo, hi in sorted(spans, key=lambda s: (spans[s], s[0], -s[1])):
            i = bisect(taken, (lo, hi))
            if (i == 0 or taken[i - 1][1] < lo) and (i == len(taken) or hi < taken[i][0]):
                taken.insert(i, (lo, hi))
        first, at = -1, 0
        for lo, hi in taken:
            first, at, n = first + flat.count(b" ", at, lo), lo, spans[lo, hi]
            out.append((label, first, first + flat.count(b" ", lo, hi), n, 1 - n / len(notice)))
    return out


def _finds(flat: bytes, piece: bytes, lo: int = 0, hi: int | None = None) -> list[int]:
    out, at = [], lo - 1
    while (at := flat.find(piece, at + 1, hi)) >= 0:
        out.append(at)
    return out


def scan(docs: DataFrame, notices: tuple = NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """Base places, labels, score and the spans of all notices: one row per row of ``docs``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"].array, b["text"].array):
                flat, n = normal(None if pd.isna(text) else text)
                base, fuzzy = base_places(flat), fuzzy_places(flat, notices, chars_per_edit)
                at, own = [p for _, p in base], {x for x, _ in base}
                out.append((doc_id, n, len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)),
                            ",".join(sorted(own | {f[0] for f in fuzzy})),
                            1.0 if base else max((f[4] for f in fuzzy), default=0.0),
                            [{"label": f[0], "first_word": f[1], "last_word": f[2], "edits": f[3]} for f in fuzzy]))
            f = pd.DataFrame(out, columns=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
            for c in ("doc_id", "first_word", "last_word"):
                f[c] = pd.array(f[c], dtype="Int64")
            yield f

    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA)

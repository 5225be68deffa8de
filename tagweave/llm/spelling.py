"""Spelling variants of words by a variable-length gram index.

``word_counts`` counts the words of a corpus; ``variants`` links words that
differ by exactly one inserted, deleted or replaced character:

1. Dictionary: all grams of ``SHORTEST`` characters (a mark stands before and
   after each word), and a longer one where the gram without its last character
   occurs more than ``FREQUENT`` times in the vocabulary: frequent grams are
   pruned to longer, rarer ones, up to ``LONGEST``.
2. A word is cut into the longest dictionary gram from each place, without those
   that lie in one before. ``affected`` bounds how many of them one edit can
   change: those that cover it, those before it that the dictionary could
   lengthen over it, and those behind it that a new gram could swallow.
3. A word keeps in the index its ``affected + 1`` rarest grams; two words one
   edit apart agree in at least one of these (lists are merged for one common
   gram out of the short lists, long lists are never read). A gram that the edit
   leaves alone has either everything before it or everything behind it in
   common as well, so a list is split by a hash of that side, and by length.
   Words whose bound leaves no gram are listed by their halves instead.
4. Candidates are checked by a parity mask of the letters, then by the edit distance.
5. A word's form is its near word of largest count if that is ``RATIO`` times its
   own; chains of forms are followed by pointer doubling.

Facts about grams are asked for by blocks of words (exchange.py): a gram crosses
the network once per block. Grams are compared by 64-bit hashes; two grams that
fall together can only loosen a bound, never lose a link. Lists are joined by a
shuffle whose large keys Spark's skew join splits; nothing is capped.

Defined results: null and empty texts have no words; a null doc_id counts as an
empty one; rows are counted each, repeated ones too; empty tables give empty
results; other columns are ignored; ties go to the first word in code-point order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm import exchange
from tagweave.llm.common import stored

#: Lengths of grams; a gram of more occurrences is frequent.
SHORTEST, LONGEST, FREQUENT = 2, 4, 50
#: A form occurs so many times as often as the word.
RATIO = 5
#: Words of a partition that are counted before they are sent on.
HELD_WORDS = 200_000
BLOCK_BYTES = 1 << 19

#: Latin-1 bytes: A-Z lowered, letters and U+00C0 to U+00FF kept, all else a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))

_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)


def runs_of_letters(text: str | None) -> list[bytes]:
    """The maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` as Latin-1, A-Z lowered."""
    return (text or "").encode("latin-1", "replace").translate(_LETTERS).split()


def word_counts(docs: DataFrame, least_chars: int = 6, least_count: int = 5,
                edit: Callable[[str, bytes], bytes] | None = None) -> DataFrame:
    """(word, n): words of at least ``least_chars`` characters and ``least_count``
    occurrences. ``edit(doc_id, word)`` may change, never lengthen, the words of a document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def sent() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in held]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = Counter(w for w in runs_of_letters(text) if len(w) >= least_chars)
                if edit:
                    name = "" if doc_id is None else str(doc_id)
                    for w, n in found.items():
                        w = edit(name, w)
                        if len(w) >= least_chars:
                            held[w] += n
                else:
                    held.update(found)
                if len(held) >= HELD_WORDS:
                    yield sent()
                    held.clear()
        if held:
            yield sent()

    counts = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _C
    return x ^ (x >> _U(29))


class Words:
    """The characters of some words, a mark before and after each, in one array:
    word ``k`` is at ``begin[k]:end[k]``, character ``p`` belongs to ``word[p]``."""

    def __init__(self, words: list[str]):
        self.chars = np.frombuffer("".join(f"\x01{w}\x02" for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        size = np.array([len(w) + 2 for w in words], dtype=np.int64)
        self.end = np.cumsum(size)
        self.begin = self.end - size
        self.word = np.repeat(np.arange(len(words)), size)
        self.place = np.arange(len(self.chars))
        self.left = self.end[self.word] - self.place                      # characters from here to the end
        self.gram = []                                                   # [q - 1][p]: hash of the q characters from p
        acc = np.zeros(len(self.chars), dtype=np.uint64)
        for q in range(1, LONGEST + 1):
            acc = _mixed(acc * _A + np.concatenate([self.chars[q - 1:], np.zeros(min(q - 1, len(self.chars)), dtype=np.uint64)]) * _B + _U(q))
            self.gram.append(acc)

    def grams(self, q: int) -> np.ndarray:
        """Where a gram of ``q`` characters starts."""
        return self.place[self.left >= q]


class Facts:
    """What is known of grams, by hash; unknown ones have 0."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values

    def of(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, hashes), max(len(self.keys) - 1, 0))
        return np.where(self.keys[at] == hashes, self.values[at], 0).astype(np.int64) if len(self.keys) else np.zeros(len(hashes), np.int64)


def gram_counts(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of the words and their numbers."""
    found = [w.gram[q - 1][w.grams(q)] for q in range(SHORTEST, LONGEST + 1)]
    return np.unique(np.concatenate(found), return_counts=True)


def frequency_class(counts: np.ndarray) -> np.ndarray:
    """One byte, rising with the count: over ``FREQUENT`` if and only if the count is."""
    high = FREQUENT + 1 + np.minimum(4 * np.log2(np.maximum(counts, FREQUENT) / FREQUENT), 254 - FREQUENT - 1)
    return np.where(counts <= FREQUENT, counts, high).astype(np.uint8)


def longest_grams(w: Words, frequency: Facts) -> np.ndarray:
    """The length of the longest dictionary gram from every place; 0 where none fits."""
    size = np.where(w.left >= SHORTEST, SHORTEST, 0)
    for q in range(SHORTEST + 1, LONGEST + 1):
        at = w.place[(w.left >= q) & (size == q - 1)]
        size[at[frequency.of(w.gram[q - 2][at]) > FREQUENT]] = q
    return size


def neighbourhood(w: Words, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every gram that is part of a dictionary gram of these words, or may be
    looked up: the length of the longest dictionary gram that begins with it, and
    how far inside of a dictionary gram it starts at most."""
    keys, longer, inside = [], [], []

    def said(q: int, at: np.ndarray, length, offset) -> None:
        keys.append(w.gram[q - 1][at])
        longer.append(np.broadcast_to(np.uint8(length), len(at)))
        inside.append(np.broadcast_to(np.uint8(offset), len(at)))

    for q in range(1, LONGEST):
        said(q, w.grams(q), 0, 0)
    for length in range(SHORTEST, LONGEST + 1):
        at = w.place[size >= length]        # shorter beginnings of a dictionary gram are dictionary grams
        for q in range(1, length + 1):
            said(q, at, length, 0)
        for offset in range(1, length):
            for q in range(SHORTEST, length - offset + 1):
                said(q, at + offset, 0, offset)
    unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    most_longer, most_inside = np.zeros(len(unique), np.uint8), np.zeros(len(unique), np.uint8)
    np.maximum.at(most_longer, inverse, np.concatenate(longer))
    np.maximum.at(most_inside, inverse, np.concatenate(inside))
    return unique, most_longer, most_inside


def decomposed(w: Words, size: np.ndarray) -> np.ndarray:
    """Places of the grams of every word: the longest from each place that end behind all before them."""
    at = w.place[size > 0]
    reach = at + size[at]                   # rises from word to word, so a word's first gram is always new
    most = np.maximum.accumulate(reach)
    return at[np.concatenate([[True], reach[1:] > most[:-1]])] if len(at) else at


def affected(w: Words, size: np.ndarray, at: np.ndarray, longer: Facts, inside: Facts) -> np.ndarray:
    """For every word the number of its grams that one edit, wherever it is, may change at most."""
    # The first place from which a dictionary gram could reach over an edit at p, given what stands between.
    first = w.place.copy()
    for d in range(LONGEST - 1, 0, -1):
        p = w.place[(w.place - w.begin[w.word] >= d) & (first == w.place)]
        p = p[longer.of(w.gram[d - 1][p - d]) > d]
        first[p] = p - d
    change = np.zeros(len(w.chars) + 1, dtype=np.int64)
    offset = np.zeros(len(at), dtype=np.int64)
    for q in range(SHORTEST, LONGEST):
        of_size = np.flatnonzero(size[at] == q)
        offset[of_size] = inside.of(w.gram[q - 1][at[of_size]])
    np.add.at(change, np.maximum(at - offset, w.begin[w.word[at]]), 1)
    np.add.at(change, at + size[at], -1)
    count = np.cumsum(change[:-1])
    for d in range(SHORTEST, LONGEST):      # edits behind the gram, over which one from its place or before could reach
        edit = at + d
        fits = (d >= size[at]) & (edit < w.end[w.word[at]])
        edit = np.where(fits, edit, 0)
        hit = fits & (first[edit] <= at)
        np.add.at(count, edit[hit], 1)
    count[w.begin] = 0                      # the mark before a word is never edited
    return np.maximum.reduceat(count, w.begin) if len(w.begin) else np.zeros(0, np.int64)


def listed(w: Words, frequency: Facts, longer: Facts, inside: Facts) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """(whether as the longer word, word, key) of the lists that hold each word; a key
    says the characters on one side of a gram, and the length of the shorter word."""
    size = longest_grams(w, frequency)
    at = decomposed(w, size)
    bound = affected(w, size, at, longer, inside)
    word, many = w.word[at], np.bincount(w.word[at], minlength=len(w.begin))
    hashes, rarity = np.zeros(len(at), dtype=np.uint64), np.zeros(len(at), dtype=np.int64)
    for q in range(SHORTEST, LONGEST + 1):
        of_size = np.flatnonzero(size[at] == q)
        hashes[of_size] = w.gram[q - 1][at[of_size]]
        rarity[of_size] = frequency.of(hashes[of_size])
    order = np.lexsort((at, hashes, rarity, word))
    number = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
    taken = order[number <= bound[word[order]]]
    p = at[taken]
    whole = np.concatenate([_sides(w, p + size[p], True), _sides(w, p, False)])
    # Where the bound leaves nothing: the shorter word's first or second half is in both.
    none = np.flatnonzero(many <= bound)
    for as_longer in (False, True):
        shorter = (w.end - w.begin) - as_longer
        half = shorter[none] // 2
        halves = [_sides(w, w.begin[none] + half, True), _sides(w, w.end[none] - (shorter[none] - half), False)]
        words = np.concatenate([word[taken], word[taken], none, none])
        yield as_longer, words, _mixed(np.concatenate([whole, *(h + _U(1) for h in halves)]) + shorter[words].astype(np.uint64) * _B)


def _sides(w: Words, at: np.ndarray, before: bool) -> np.ndarray:
    """Hash of the characters of a word before ``at``, or from ``at`` on."""
    most = int((w.end - w.begin).max()) if len(w.begin) else 0
    power = np.concatenate([[_U(1)], np.cumprod(np.full(most, _A))])
    step = (w.place - w.begin[w.word]) if before else (w.left - 1)
    sums = np.concatenate([[_U(0)], np.cumsum(_mixed(w.chars * _B + _U(7)) * power[step])])
    word = w.word[at - 1] if before else w.word[at]
    out = sums[at] - sums[w.begin[word]] if before else sums[w.end[word]] - sums[at]
    return _mixed(out * _C + _U(3 if before else 5))


_COUNT = np.dtype([("key", "<u8"), ("count", "<u4")])
_NEAR = np.dtype([("key", "<u8"), ("longer", "u1"), ("inside", "u1")])
LISTED = "key long, longer boolean, word string, n long, letters long"


def _frequencies(values: np.ndarray, block: np.ndarray) -> np.ndarray:
    unique, inverse = np.unique(values["key"], return_inverse=True)
    return frequency_class(np.bincount(inverse, weights=values["count"], minlength=len(unique)))[inverse]


def _nearest(values: np.ndarray, block: np.ndarray) -> np.ndarray:
    unique, inverse = np.unique(values["key"], return_inverse=True)
    longer, inside = np.zeros(len(unique), np.uint8), np.zeros(len(unique), np.uint8)
    np.maximum.at(longer, inverse, values["longer"])
    np.maximum.at(inside, inverse, values["inside"])
    return (longer * np.uint8(16) + inside)[inverse]


def gram_lists(counts: DataFrame) -> DataFrame:
    """(key, longer, word, n, letters): the lists of the index, by hashed key. A word stands in the lists of its own
    length and, as the longer one, in those of words one character shorter. ``letters``: a parity mask."""
    blocks, parts = exchange.pack_blocks(counts.select("word", "n"), "word", BLOCK_BYTES)

    def words(t: pa.Table) -> Words:
        return Words(t.column("word").to_pylist())

    def counted(t: pa.Table, said: dict) -> tuple[np.ndarray, np.ndarray]:
        keys, n = gram_counts(words(t))
        values = np.empty(len(keys), dtype=_COUNT)
        values["key"], values["count"] = keys, n
        return keys, values

    def near(t: pa.Table, said: dict) -> tuple[np.ndarray, np.ndarray]:
        w = words(t)
        keys, longer, inside = neighbourhood(w, longest_grams(w, Facts(gram_counts(w)[0], said[1])))
        values = np.empty(len(keys), dtype=_NEAR)
        values["key"], values["longer"], values["inside"] = keys, longer, inside
        return keys, values

    def lists(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        said, out = exchange.answers_of(right), []
        for payload in left["payload"]:
            t = exchange.unpacked(payload)
            w = words(t)
            frequency = Facts(gram_counts(w)[0], said[1])
            keys = neighbourhood(w, longest_grams(w, frequency))[0]
            mask = np.zeros(len(w.begin), dtype=np.uint64)
            np.bitwise_xor.at(mask, w.word, _U(1) << (_mixed(w.chars * _A) >> _U(58)))
            text, n, mask = t.column("word").to_numpy(zero_copy_only=False), t.column("n").to_numpy(), mask.view(np.int64)
            for as_longer, word, keys_of_word in listed(w, frequency, Facts(keys, said[2] >> 4), Facts(keys, said[2] & 15)):
                out.append(pd.DataFrame({"key": keys_of_word.view(np.int64), "longer": as_longer, "word": text[word], "n": n[word], "letters": mask[word]}))
        columns = ["key", "longer", "word", "n", "letters"]
        return pd.concat(out)[columns] if out else pd.DataFrame({c: [] for c in columns})

    frequencies = exchange.ask(blocks, None, counted, _frequencies, _COUNT, parts, 1)
    nearest = exchange.ask(blocks, frequencies, near, _nearest, _NEAR, parts, 2)
    answers = frequencies.unionByName(nearest)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(lists, LISTED)


def near_pairs(counts: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): every pair of words one edit apart, once."""
    lists = stored(gram_lists(counts))
    side = lambda d, s: d.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("longer", "word", "n", "letters")])
    joined = side(lists.where("NOT longer"), "a").join(side(lists, "b"), "key").where(
        "(longer_b OR word_a < word_b) AND bit_count(letters_a ^ letters_b) <= 2 AND levenshtein(word_a, word_b, 1) = 1")
    return joined.select(F.col("word_a").alias("a"), F.col("n_a"), F.col("word_b").alias("b"), F.col("n_b")).distinct()


def variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``counts`` (word, n; distinct words)."""
    counts = stored(counts)
    pairs = near_pairs(counts)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    found = both.groupBy(F.col("a").alias("word"), F.col("n_a").alias("n")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("n"), F.col("b").alias("word"))).alias("best"))
    clear = -F.col("best.n") >= ratio * F.col("n")
    found = stored(found.select("word", "n_near", F.when(clear, F.col("best.word")).alias("form"), F.when(clear, -F.col("best.n")).alias("form_n")))
    # Every step has a larger count, so chains end; each round doubles the steps taken.
    roots = stored(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = step.select("word", "root")
        if not step.where("moved").head(1):
            break
    return counts.join(found, "word", "left").join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")

"""Packing by power-of-two decomposition.

A document of n tokens is cut into whole sequences of ``max_len`` tokens and
the binary digits of the rest, longest first, so every sequence is a power of
two, holds one document only and needs no padding. Equal lengths share a
bucket: ``sequence_id`` starts with the bucket, so the ids of one length are a
contiguous range, and ``write_buckets`` stores each length in its own folder.

The job is one scan: a task tokenises its own rows and numbers its own pieces
(bucket, then Spark's partition and row number), and nothing is shuffled. A
document that is much longer than the others stays one row of one task and is
tokenised in slices, so its memory is its ids.

Tokenising goes word by word through a bounded cache of the ids of frequent
words. The cut between words is at space and line feed only; the vocabulary's
own rules drop both, so the ids equal those of the whole text (tested).

Defined results: null and empty texts are one piece with the end token;
repeated rows are packed once each; an empty table gives no piece; other
columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LEN = 2048
END_ID = 1
CACHE_WORDS = 800_000
SLICE = 1 << 20
_MARK = "\x01"
#: ASCII marks but the apostrophe, which the vocabulary joins with some letters.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_END = np.array([END_ID], dtype="<u4")

#: Some marks join only the small letter in NFC (U+0308, U+030A, U+030C, U+0331, all of this lead byte).
_LEAD, _MARKED = re.compile(b"\xcc"), r"[A-Z]\p{M}"

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int")


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _ends_in_letter(stem: str) -> bool:
    """Whether the vocabulary still has a letter there, after NFC and lower case, so that marks behind it stand apart."""
    last = stem[-1]
    return last.isalpha() and (last.isascii() or unicodedata.is_normalized("NFC", stem) and last.lower()[-1].isalpha())


class WordIds:
    """Ids of texts with a bounded cache by word, in two generations: frequent words stay."""

    def __init__(self, path: str | None, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer
        self._tok = Tokenizer.from_file(path or vocabulary_path())
        self._most = cache_words
        self._ids: dict[str, bytes] = {"": b""}
        self._old: dict[str, bytes] = {}
        # A control character between spaces is a word of its own: new words are encoded as one text and cut there.
        self._cut = self._tok.encode(_MARK, add_special_tokens=False).ids

    def _encoded(self, words: list[str]) -> Iterator[bytes]:
        ids = np.array(self._tok.encode_batch_fast([f" {_MARK} ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        at = np.flatnonzero(ids == self._cut[0])
        starts, ends = np.append(0, at + 1), np.append(at, len(ids))
        return (ids[i:j].tobytes() for i, j in zip(starts, ends))

    def _learn(self, words: set[str]) -> None:
        """Cache the ids of all ``words``. Marks after a letter are a piece of their
        own in this vocabulary, so only stems and runs of marks are encoded."""
        if len(self._ids) > self._most // 2:
            self._ids, self._old = {"": b""}, self._ids
        ids, old, ends, new = self._ids, self._old, [], set()
        for w in words.difference(ids):
            known = old.get(w)
            if known is not None:
                ids[w] = known
                continue
            stem = w.rstrip(_MARKS)
            if len(stem) != len(w) and stem and _ends_in_letter(stem) and "<|" not in w:
                ends.append((w, stem, w[len(stem):]))
                new.update(ends[-1][1:])
            else:
                new.add(w)
        new.difference_update(ids)
        odd = [w for w in new if _MARK in w or "<|" in w] if len(self._cut) == 1 else list(new)
        for w in odd:
            ids[w] = np.array(self._tok.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes()
        plain = list(new.difference(ids))
        for at in range(0, len(plain), 4096):
            ids.update(zip(plain[at:at + 4096], self._encoded(plain[at:at + 4096])))
        for w, stem, mark in ends:
            ids[w] = ids[stem] + ids[mark]

    def encode_all(self, texts: Iterable[str | None] | pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text and the end token, text by text. Words are cut,
        numbered and gathered as arrays; only distinct words reach the cache."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(list(texts), pa.string()), "")
        # The vocabulary lowers letters, so A-Z can be lowered before, unless that could make a special token or another letter.
        as_is, data = pc.match_substring(texts, "<|"), texts.buffers()[2]
        if data is not None and _LEAD.search(data):
            as_is = pc.or_(as_is, pc.match_substring_regex(texts, _MARKED))
        low = pc.if_else(as_is, texts, pc.ascii_lower(texts))
        lists = pc.split_pattern(pc.replace_substring(low, "\n", " "), " ")
        ends = np.asarray(lists.offsets)[1:].astype(np.int64) - lists.offsets[0].as_py()
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        self._learn(set(distinct))
        known = [self._ids[w] for w in distinct]
        size = np.array([len(b) >> 2 for b in known], dtype=np.int64)
        start, ids = np.cumsum(size) - size, np.frombuffer(b"".join(known), dtype="<u4")
        code, at = np.asarray(words.indices), 0
        for end in ends:
            parts = []
            for lo in range(at, end, SLICE):
                c = code[lo:min(end, lo + SLICE)]
                n = size[c]
                parts.append(ids[np.repeat(start[c] - np.cumsum(n) + n, n) + np.arange(n.sum())])
            yield np.concatenate([*parts, _END])
            at = end

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_all([text]))


@lru_cache(maxsize=1)
def _encoder(path: str | None) -> WordIds:
    """One for the tasks that a Python worker runs one after the other."""
    return WordIds(path)


def piece_lengths(n: int, max_len: int = MAX_LEN) -> list[int]:
    """Whole sequences, then the binary digits of the rest, longest first."""
    out = [max_len] * (n // max_len)
    rest = n % max_len
    return out + [1 << b for b in range(max_len.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str | None = None, max_len: int = MAX_LEN,
         with_ids: bool = False) -> DataFrame:
    """Pieces of every document; ``with_ids`` adds the token ids themselves.

    ``max_len`` is a power of two. Columns: doc_id, start, length, ids_crc32,
    doc_tokens, bucket (log2 of the length), sequence_id, offset."""
    if max_len & (max_len - 1) or max_len < 1:
        raise ValueError("max_len must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer_path)
        for b in batches:
            row, start, length, crc, total, kept = [], [], [], [], [], []
            for r, ids in enumerate(enc.encode_all(b.column("text").cast(pa.string()))):
                at = 0
                for n in piece_lengths(len(ids), max_len):
                    piece = ids[at:at + n]
                    row.append(r)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(piece))
                    total.append(len(ids))
                    if with_ids:
                        kept.append(piece.astype("<i4"))
                    at += n
            columns = [b.column("doc_id").cast(pa.int64()).take(pa.array(row, pa.int64()))]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            columns.append(pa.array([n.bit_length() - 1 for n in length], pa.int32()))
            if with_ids:
                flat = np.concatenate(kept) if kept else np.empty(0, "<i4")
                ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32) if length else np.zeros(1, np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    pieces = docs.select("doc_id", "text").mapInArrow(run, schema)
    number = F.shiftleft(F.col("bucket").cast("bigint"), 58) + F.monotonically_increasing_id()
    return pieces.withColumn("sequence_id", number).withColumn("offset", F.lit(0).cast("bigint"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder per sequence length, ready to be read in batches of equal length."""
    packed.write.partitionBy("bucket").parquet(path)

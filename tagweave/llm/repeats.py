"""Repeated passages by bucket-pointer refinement of suffixes.

A byte goes if a ``length``-byte string (50) that covers it also starts in a
document with a smaller doc_id. Strings never cross documents and are judged
on the input.

Suffixes are first put into buckets by their q-gram (q = length / 2), at the
anchors that a sliding minimum picks: equal strings have equal anchors, so no
string is missed. Only buckets with more than one document are refined, by
sorting on the bucket identifiers of later and earlier offsets, as
bucket-pointer refinement does, until the order is decided:

1. buckets of one document are final: their strings occur nowhere else;
2. a bucket is sorted on the identifiers at offsets -q, 0 and q, that is, on
   all the text that any of its strings can cover. Suffixes that agree on all
   of it are equal in every string: all but the first document go. If the whole
   bucket agrees it is final;
3. what is left, the first suffix of each sub-bucket of a divided bucket, is
   refined string by string: its identifier is the pair of bucket identifiers
   at offsets 0 and q, and the least document of each is found.

Bucket identifiers are 64-bit hashes of the q-grams, reused by all rounds.
Buckets are dealt over the cluster by identifier, in blocks (exchange.py): per
block and identifier one entry, so copies in thousands of documents are
aggregated before the shuffle. Nothing grows with the square of a group.

Defined results: null text is empty; texts under ``length`` bytes lose nothing;
rows with the same doc_id never remove bytes from each other; a null doc_id
counts as the largest; empty tables give empty results; other columns are
ignored by ``removals`` and kept by ``without_repeats``, which leaves out the
broken part of a character that is cut in two and sets ``n_chars`` anew.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tagweave.llm import exchange

LENGTH = 50
SLICE = 1 << 16

_U = np.uint64
_NO_ID = np.iinfo(np.int64).max


def _draw(i: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"repeats{i}".encode(), digest_size=8).digest(), "little") | 1


_BYTE = np.array([_draw(i) for i in range(257)], dtype=np.uint64)
_M = [_U(_draw(1000 + i)) for i in range(4)]
_BASE = _draw(2000)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _M[0]
    return (x ^ (x >> _U(29))) * _M[1]


def _windows(x: np.ndarray, q: int, join) -> np.ndarray:
    """``join`` over every window of ``q`` items, by doubling: join(left, right, size of right)."""
    n = len(x) - q + 1
    out, size, power, span = None, 0, x, 1
    while True:
        if q & span:
            out = power[:n] if out is None else join(out, power[size:size + n], span)
            size += span
        if 2 * span > q:
            return out
        power, span = join(power[:len(power) - span], power[span:], span), 2 * span


def _identifiers(data: np.ndarray, q: int) -> np.ndarray:
    """The bucket identifier of the q-gram at every offset."""
    def join(a, b, size):
        return a * _U(pow(_BASE, size, 1 << 64)) + b
    return _mixed(_windows(_BYTE[data], q, join))


class _Block:
    """The texts of a block one after the other, the anchors of their strings,
    and what the rounds said of them. Places are offsets in ``buffer``, where
    q values that are no byte stand before, between and after the texts."""

    def __init__(self, t: pa.Table, length: int):
        q = length // 2
        self.length, self.q = length, q
        self.data = [np.frombuffer((x or "").encode("utf-8", "surrogatepass"), dtype=np.uint8) for x in t.column("text").to_pylist()]
        self.ids = np.array([_NO_ID if x is None else x for x in t.column("doc_id").to_pylist()], dtype=np.int64)
        sizes = np.array([len(x) for x in self.data], dtype=np.int64)
        self.start = 2 * q + np.cumsum(sizes + q) - sizes - q
        self.buffer = np.full(int((sizes + q).sum()) + 4 * q, 256, dtype=np.uint16)
        for at, x in zip(self.start, self.data):
            self.buffer[at:at + len(x)] = x
        edge = np.zeros(len(self.buffer) + 1, dtype=np.int8)
        whole = sizes >= length
        edge[self.start[whole]] += 1
        edge[(self.start + sizes - length + 1)[whole]] -= 1
        self.valid = np.cumsum(edge[:-1], dtype=np.int8) > 0
        found = [self._anchors(lo, count) for lo, count in self._slices(self.valid)]
        cat = lambda i, kind: np.concatenate([x[i] for x in found]) if found else np.empty(0, dtype=kind)
        self.first, self.last, self.bucket, self.context = cat(0, np.int64), cat(1, np.int64), cat(2, np.uint64), cat(3, np.uint64)
        self.row = self._rows(self.first)
        self.doc = self.ids[self.row]

    def _rows(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, places, side="right") - 1

    def _slices(self, wanted: np.ndarray):
        """(lo, count) of the slices with a wanted start."""
        for lo in range(self.q, len(wanted) - self.length - self.q + 1, SLICE):
            count = min(SLICE, len(wanted) - self.length - self.q + 1 - lo)
            if wanted[lo:lo + count].any():
                yield lo, count

    def _identifiers(self, lo: int, count: int) -> np.ndarray:
        """The bucket identifiers from offset ``lo - q`` on, as far as the strings of the slice and q more bytes go."""
        return _identifiers(self.buffer[lo - self.q:lo + count + self.length - 1 + self.q], self.q)

    def _anchors(self, lo: int, count: int) -> tuple[np.ndarray, ...]:
        """Runs of starts with one anchor: first start, last start, bucket identifier, identifier of all text of the run."""
        q, ids = self.q, self._identifiers(lo, count)
        at = np.arange(count + self.length - q, dtype=np.uint64)
        order = (ids[q:q + len(at)] & _U(0xFFFFFFFF00000000)) | at
        anchor = _windows(order, self.length - q + 1, lambda a, b, _: np.minimum(a, b))
        p = np.flatnonzero(self.valid[lo:lo + count])
        anchor = (anchor[p] & _U(0xFFFFFFFF)).astype(np.int64)
        change = np.flatnonzero(anchor[1:] != anchor[:-1])
        a = anchor[np.append(0, change + 1)]
        before, here, after = ids[a], ids[a + q], ids[a + 2 * q]
        return (p[np.append(0, change + 1)] + lo, p[np.append(change, len(p) - 1)] + lo,
                _mixed(here ^ _M[2]), _mixed((before * _M[0] + here) * _M[2] + after * _M[3]))

    def buckets(self) -> np.ndarray:
        return np.unique(self.bucket)

    def keep(self, said: np.ndarray) -> None:
        """Only the anchors whose bucket holds several documents."""
        keys, inverse = np.unique(self.bucket, return_inverse=True)
        lo, hi = np.full(len(keys), _NO_ID), np.full(len(keys), np.iinfo(np.int64).min)
        np.minimum.at(lo, inverse, self.doc)
        np.maximum.at(hi, inverse, self.doc)
        many = ((said > 0) | (lo < hi))[inverse]
        for name in ("row", "first", "last", "bucket", "context", "doc"):
            setattr(self, name, getattr(self, name)[many])

    def sub_buckets(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order by (bucket, context, document), the index of each sub-bucket's first entry, and its number by anchor."""
        order = np.lexsort((self.doc, self.context, self.bucket))
        b, c = self.bucket[order], self.context[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (b[1:] != b[:-1]) | (c[1:] != c[:-1])
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        return order, order[np.flatnonzero(new)], number

    def refined(self, said: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Masks over the anchors: all strings go; strings are still open."""
        _, head, number = self.sub_buckets()
        gone = ((said & 1) > 0)[number] | (self.doc > self.doc[head][number])
        return gone, ~gone & ((said & 2) > 0)[number]

    def open_strings(self, still: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, start and identifier, a pair of bucket identifiers, of every open string."""
        edge = np.zeros(len(self.buffer) + 1, dtype=np.int32)
        np.add.at(edge, self.first[still], 1)
        np.add.at(edge, self.last[still] + 1, -1)
        wanted = np.cumsum(edge[:-1], dtype=np.int32) > 0
        starts, keys = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for lo, count in self._slices(wanted):
            ids, p = self._identifiers(lo, count), np.flatnonzero(wanted[lo:lo + count])
            starts.append(p + lo)
            keys.append(_mixed((ids[p + self.q] * _M[2] + ids[p + 2 * self.q]) * _M[3]))
        start = np.concatenate(starts)
        return self._rows(start), start, np.concatenate(keys)

    def firsts(self, rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        unique, inverse = np.unique(keys, return_inverse=True)
        least = np.full(len(unique), _NO_ID)
        np.minimum.at(least, inverse, self.ids[rows])
        return unique, inverse, least

    def spans(self, said: dict[int, np.ndarray]) -> list[np.ndarray]:
        """Maximal removed (from, to) runs of each row."""
        none = np.empty(0, np.uint8)
        self.keep(said.get(1, none))
        gone, still = self.refined(said.get(2, none))
        rows, starts, keys = self.open_strings(still)
        _, inverse, least = self.firsts(rows, keys)
        more = (said.get(3, none) > 0)[inverse] | (self.ids[rows] > least[inverse])
        row = np.concatenate([self.row[gone], rows[more]])
        begin = np.concatenate([self.first[gone], starts[more]])
        end = np.concatenate([self.last[gone], starts[more]]) + self.length
        order = np.lexsort((begin, row))
        row, begin, end = row[order], begin[order], end[order]
        out = []
        for r in range(len(self.data)):
            lo, hi = np.searchsorted(row, [r, r + 1])
            b, e = begin[lo:hi], np.maximum.accumulate(end[lo:hi])
            new = np.ones(len(b), dtype=bool)
            new[1:] = b[1:] > e[:-1]
            at = np.flatnonzero(new)
            runs = np.stack([b[at], e[np.append(at[1:], len(b)) - 1]], axis=1) if len(b) else np.empty((0, 2), np.int64)
            out.append(runs - self.start[r])
        return out


_SUB = np.dtype([("bucket", "<u8"), ("context", "<u8"), ("doc", "<i8")])
_STRING = np.dtype([("key", "<u8"), ("doc", "<i8")])


def _several(values: np.ndarray, block: np.ndarray) -> np.ndarray:
    """1 where another block has the identifier too."""
    _, inverse, count = np.unique(values, return_inverse=True, return_counts=True)
    return (count[inverse] > 1).astype(np.uint8)


def _divide(values: np.ndarray, block: np.ndarray) -> np.ndarray:
    """1: an earlier document agrees on all text; 2: the bucket holds more than one sub-bucket."""
    order = np.lexsort((values["doc"], values["context"], values["bucket"]))
    v = values[order]
    new_bucket, new = np.ones(len(v), dtype=bool), np.ones(len(v), dtype=bool)
    new_bucket[1:] = v["bucket"][1:] != v["bucket"][:-1]
    new[1:] = new_bucket[1:] | (v["context"][1:] != v["context"][:-1])
    sub, bucket = np.cumsum(new) - 1, np.cumsum(new_bucket) - 1
    least = v["doc"][np.flatnonzero(new)][sub]
    divided = (np.add.reduceat(new, np.flatnonzero(new_bucket)) > 1)[bucket] if len(v) else new
    out = np.empty(len(v), dtype=np.uint8)
    out[order] = (least < v["doc"]).astype(np.uint8) | (divided.astype(np.uint8) << 1)
    return out


def _earlier(values: np.ndarray, block: np.ndarray) -> np.ndarray:
    """1 where a document before the asking one has the string."""
    unique, inverse = np.unique(values["key"], return_inverse=True)
    least = np.full(len(unique), _NO_ID)
    np.minimum.at(least, inverse, values["doc"])
    return (least[inverse] < values["doc"]).astype(np.uint8)


def _rounds(blocks: DataFrame, parts: int, length: int) -> DataFrame:
    """The answers of all rounds."""
    def first(t: pa.Table, said: dict) -> tuple[np.ndarray, np.ndarray]:
        keys = _Block(t, length).buckets()
        return keys, keys.astype("<u4")     # the part knows the rest of the identifier

    def second(t: pa.Table, said: dict) -> tuple[np.ndarray, np.ndarray]:
        b = _Block(t, length)
        b.keep(said.get(1, np.empty(0, np.uint8)))
        _, head, _ = b.sub_buckets()
        values = np.empty(len(head), dtype=_SUB)
        values["bucket"], values["context"], values["doc"] = b.bucket[head], b.context[head], b.doc[head]
        return values["bucket"], values

    def third(t: pa.Table, said: dict) -> tuple[np.ndarray, np.ndarray]:
        b = _Block(t, length)
        none = np.empty(0, np.uint8)
        b.keep(said.get(1, none))
        rows, _, keys = b.open_strings(b.refined(said.get(2, none))[1])
        unique, _, least = b.firsts(rows, keys)
        values = np.empty(len(unique), dtype=_STRING)
        values["key"], values["doc"] = unique, least
        return unique, values

    one = exchange.ask(blocks, None, first, _several, np.dtype("<u4"), parts, 1)
    two = one.unionByName(exchange.ask(blocks, one, second, _divide, _SUB, parts, 2))
    return two.unionByName(exchange.ask(blocks, two, third, _earlier, _STRING, parts, 3))


def _rest(data: np.ndarray, spans: np.ndarray) -> bytes:
    keep = np.ones(len(data), dtype=bool)
    for a, b in spans:
        keep[a:b] = False
    return data[keep].tobytes()


def removals(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, one row per row of ``docs``."""
    blocks, parts = exchange.pack_blocks(docs.select("doc_id", "text"))

    def result(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        said, out = exchange.answers_of(right), []
        for payload in left["payload"]:
            t = exchange.unpacked(payload)
            b = _Block(t, length)
            for doc_id, data, spans in zip(t.column("doc_id").to_pylist(), b.data, b.spans(said)):
                out.append((doc_id, len(data), int((spans[:, 1] - spans[:, 0]).sum()), len(spans),
                            hashlib.sha256(_rest(data, spans)).hexdigest()))
        f = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        f["doc_id"] = pd.array(f["doc_id"], dtype="Int64")
        return f

    answers = _rounds(blocks, parts, length)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        result, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated bytes cut from ``text``, all columns as they were."""
    blocks, parts = exchange.pack_blocks(docs)
    schema: StructType = docs.schema

    def result(left: pa.Table, right: pa.Table) -> pa.Table:
        said, out = exchange.answers_of(right.to_pandas()), []
        for payload in left.column("payload").to_pylist():
            t = exchange.unpacked(payload)
            b = _Block(t, length)
            texts = [None if x is None else _rest(d, s).decode("utf-8", "ignore")
                     for x, d, s in zip(t.column("text").to_pylist(), b.data, b.spans(said))]
            at = t.schema.get_field_index("text")
            t = t.set_column(at, t.schema.field(at), pa.array(texts, t.schema.field(at).type))
            if "n_chars" in t.column_names:
                at = t.schema.get_field_index("n_chars")
                n = pa.array([None if x is None else len(x) for x in texts], pa.int64()).cast(t.schema.field(at).type)
                t = t.set_column(at, t.schema.field(at), n)
            out.append(t)
        return pa.concat_tables(out)

    answers = _rounds(blocks, parts, length)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(result, schema)

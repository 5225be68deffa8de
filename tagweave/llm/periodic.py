"""Periodic runs of words, found in a grammar of the texts.

1. The words of some documents become ids, and ``grammar`` compresses their
   sequence by Re-Pair: pairs of symbols that occur at least twice get a rule.
   The most frequent pairs are replaced first; a round replaces every pair that
   beats the pairs it overlaps, so that rules stay shallow and a round is a few
   array operations. It ends when a round shortens next to nothing; what is left
   of a document is one start rule, read as a balanced binary tree.
2. A run lies in a smallest node of that derivation, whose boundary it crosses.
   ``crossing`` finds the runs that cross the boundary of a node, once for a rule
   however often it occurs: a run of four periods holds a square that starts or
   ends at the boundary. Squares are found by a fingerprint and checked word by
   word; of squares inside a run only the primitive one counts.
3. Runs of a rule are translated to all its derivation positions, and intervals
   of one period that lie in another are dropped. What stays is maximal.

Documents are read where they lie and nothing is shuffled; time is n log n in
the words of a document.

Defined results: null and empty texts have no words and no runs; a document of
any length is one sequence; repeated rows get equal rows; empty tables give
empty results; other columns are ignored; a null doc_id stays null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Words of a run at least, and periods of it at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words compressed together.
GROUP_WORDS = 200_000
#: Squares looked at together.
CHUNK = 1 << 20
#: Rounds of Re-Pair end when one shortens by less than one symbol of so many.
SLOW = 100

_U = np.uint64
_BASE, _MIX = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)

SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"


def _chosen(rank: np.ndarray) -> np.ndarray:
    """Places of pairs that beat the pairs they overlap. Equal neighbours are one
    symbol repeated: every second pair of such a stretch, from its start."""
    n = len(rank)
    same = np.zeros(n, dtype=bool)
    same[1:] = rank[1:] == rank[:-1]
    first = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    left, right = np.zeros_like(rank), np.zeros_like(rank)
    left[1:], right[:-1] = rank[:-1], rank[1:]
    return np.flatnonzero((rank > 0) & ((np.arange(n) - first) % 2 == 0) & (same | (rank > left)) & (rank >= right))


def grammar(ids: np.ndarray, last: np.ndarray) -> tuple[list[tuple], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rounds of rules, and the start rules' symbols as (start, length, last of its
    document). A round: (from, boundary, to) of one derivation of each rule, and
    (rule, start) of all its derivations."""
    seq, length, start = ids.astype(np.int64), np.ones(len(ids), dtype=np.int64), np.arange(len(ids))
    new, rounds = int(ids.max()) + 1 if len(ids) else 0, []
    while len(seq) > 1:
        code = seq[:-1] * new + seq[1:]
        at = np.flatnonzero(~last[:-1])
        pairs, inverse, count = np.unique(code[at], return_inverse=True, return_counts=True)
        often = np.flatnonzero(count > 1)
        if not len(often):
            break
        mixed = pairs[often].astype(np.uint64) * _MIX
        order = np.lexsort((mixed ^ (mixed >> _U(29)), count[often]))
        by_pair = np.zeros(len(pairs), dtype=np.int64)
        by_pair[often[order]] = np.arange(1, len(often) + 1)
        rank = np.zeros(len(code), dtype=np.int64)
        rank[at] = by_pair[inverse]
        places = _chosen(rank)
        _, one, which, count = np.unique(rank[places], return_index=True, return_inverse=True, return_counts=True)
        places, which, one = places[count[which] > 1], which[count[which] > 1], places[one[count > 1]]
        if len(places) * SLOW < len(seq):
            break
        rule = (np.cumsum(count > 1) - 1)[which]
        low, high = start[one], start[one + 1] + length[one + 1]
        rounds.append(((low, start[one + 1], high), (rule, start[places])))
        seq[places] = new + rule
        length[places] += length[places + 1]
        last[places] = last[places + 1]
        stays = np.ones(len(seq), dtype=bool)
        stays[places + 1] = False
        seq, length, start, last = seq[stays], length[stays], start[stays], last[stays]
        new += len(one)
    return rounds, (start, length, last)


def start_nodes(start: np.ndarray, length: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The nodes (from, boundary, to) of the documents' balanced binary trees, level by level."""
    while True:
        first = np.ones(len(last), dtype=bool)
        first[1:] = last[:-1]
        begins = np.maximum.accumulate(np.where(first, np.arange(len(last)), 0))
        left = np.flatnonzero(((np.arange(len(last)) - begins) % 2 == 0) & ~last)
        if not len(left):
            return
        yield start[left], start[left + 1], start[left + 1] + length[left + 1]
        length, last = length.copy(), last.copy()
        length[left] += length[left + 1]
        last[left] = last[left + 1]
        stays = np.ones(len(last), dtype=bool)
        stays[left + 1] = False
        start, length, last = start[stays], length[stays], last[stays]


def _same(x: np.ndarray, y: np.ndarray) -> int:
    """Number of equal leading elements; looks twice as far each time."""
    at, wide, n = 0, 32, min(len(x), len(y))
    while at < n:
        to = min(n, at + wide)
        differ = np.flatnonzero(x[at:to] != y[at:to])
        if len(differ):
            return at + int(differ[0])
        at, wide = to, wide * 2
    return n


def extended(ids: np.ndarray, at: int, period: int, low: int, high: int) -> tuple[int, int] | None:
    """The longest [s, e) in [low, high) of this period around the square at ``at``, if there is one."""
    e = at + period + _same(ids[at:high - period], ids[at + period:high])
    if e < at + 2 * period:
        return None
    return at - _same(ids[low:at][::-1], ids[low + period:at + period][::-1]), e


class Fingerprints:
    """Sums of word values times powers of an odd base: two neighbouring stretches of one length are compared at once."""

    def __init__(self, ids: np.ndarray):
        value = (ids.astype(np.uint64) + _U(1)) * _MIX
        value ^= value >> _U(31)
        self.power = np.concatenate([[_U(1)], np.cumprod(np.full(len(ids), _BASE))])
        self.sums = np.concatenate([[_U(0)], np.cumsum(value * self.power[:-1])])

    def square(self, at: np.ndarray, period: np.ndarray) -> np.ndarray:
        s, m = self.sums, self.sums[at + period]
        return (m - s[at]) * self.power[period] == s[at + 2 * period] - m


def _node_runs(ids: np.ndarray, low: int, boundary: int, high: int, periods: np.ndarray, right: bool) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the runs around the squares of ``periods`` (ascending) beside the boundary."""
    beyond = 0
    for q in periods.tolist():
        if 2 * q <= beyond:
            continue        # inside a run of a smaller period, of which it is a multiple
        found = extended(ids, boundary if right else boundary - 2 * q, q, low, high)
        if found:
            s, e = found
            beyond = e - boundary if right else boundary - s
            if e - s >= max(LEAST_WORDS, LEAST_PERIODS * q):
                yield s, e, q


def crossing(ids: np.ndarray, prints: Fingerprints, low: np.ndarray, boundary: np.ndarray, high: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(node, start, end, period) of the runs that cross the nodes' boundaries, within the nodes."""
    out: list[tuple[int, int, int, int]] = []
    for right in (True, False):
        most = np.minimum((high - low) // LEAST_PERIODS, ((high - boundary) if right else (boundary - low)) // 2)
        most[high - low < LEAST_WORDS] = 0
        nodes = np.flatnonzero(most > 0)
        ends = np.cumsum(most[nodes])
        done = 0
        while done < len(nodes):
            before = int(ends[done - 1]) if done else 0
            to = max(done + 1, int(np.searchsorted(ends, before + CHUNK, side="right")))
            mine, kept_node, kept_q = nodes[done:to], [], []
            # The periods of one node may be more than a chunk.
            for lo in range(0, int(ends[to - 1]) - before, CHUNK):
                flat = np.arange(before + lo, min(before + lo + CHUNK, int(ends[to - 1])))
                which = np.searchsorted(ends[done:to], flat, side="right")
                node = mine[which]
                q = flat - (ends[done:to][which] - most[node]) + 1
                at = boundary[node] if right else boundary[node] - 2 * q
                near = np.flatnonzero(ids[at] == ids[at + q])
                near = near[prints.square(at[near], q[near])]
                kept_node.append(node[near])
                kept_q.append(q[near])
            node, q = np.concatenate(kept_node), np.concatenate(kept_q)
            cuts = np.flatnonzero(np.diff(node)) + 1
            for qs, k in zip(np.split(q, cuts), node[np.concatenate([[0], cuts])] if len(node) else []):
                out += [(int(k), *r) for r in _node_runs(ids, int(low[k]), int(boundary[k]), int(high[k]), qs, right)]
            done = to
    return out


def maximal(runs: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) without those that lie in another of the same period, or equal one of a smaller period."""
    if not len(runs):
        return runs
    runs = runs[np.lexsort((-runs[:, 1], runs[:, 0], runs[:, 2]))]
    # Ends are compared within a period: each period's values lie above those of the one before.
    step = int(runs[:, 1].max()) + 1
    key = np.cumsum(np.concatenate([[0], np.diff(runs[:, 2]) != 0])) * step + runs[:, 1]
    longest = np.maximum.accumulate(key)
    stays = np.ones(len(runs), dtype=bool)
    stays[1:] = key[1:] > longest[:-1]
    runs = runs[stays]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), dtype=bool)
    first[1:] = (np.diff(runs[:, 0]) != 0) | (np.diff(runs[:, 1]) != 0)
    return runs[first]


def periodic_runs(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs of the documents that lie one after the other in ``ids``."""
    last = np.zeros(len(ids), dtype=bool)
    last[np.cumsum(sizes[sizes > 0]) - 1] = True
    if not len(ids):
        return np.empty((0, 3), dtype=np.int64)
    prints = Fingerprints(ids)
    rounds, rest = grammar(ids, last)
    found = []
    for (low, boundary, high), (rule, start) in rounds:
        runs = np.array(crossing(ids, prints, low, boundary, high), dtype=np.int64).reshape(-1, 4)
        if len(runs):
            runs[:, 1:3] -= low[runs[:, 0]][:, None]
            order = np.argsort(rule, kind="stable")
            rule, start = rule[order], start[order]
            begin, many = np.searchsorted(rule, runs[:, 0]), np.bincount(rule, minlength=len(low))[runs[:, 0]]
            which = np.repeat(np.arange(len(runs)), many)
            place = start[np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + begin[which]]
            found.append(np.stack([place + runs[which, 1], place + runs[which, 2], runs[which, 3]], axis=1))
    for low, boundary, high in start_nodes(*rest):
        runs = np.array(crossing(ids, prints, low, boundary, high), dtype=np.int64).reshape(-1, 4)
        found.append(runs[:, 1:])
    return maximal(np.concatenate(found)) if found else np.empty((0, 3), dtype=np.int64)


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of anything but the six ASCII white-space characters."""
    return text.split() if text else []


def collapsed_runs(docs: DataFrame, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (by start, then period;
    word numbers from 0), and the words outside repeats, one space between:
    of each run the first period stays. ``edit`` may change a document's words first."""
    def batch(rows: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
        sizes = np.array([len(w) for _, w in rows], dtype=np.int64)
        ids = pa.array([w for _, words in rows for w in words], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        runs = periodic_runs(ids.astype(np.int32), sizes)
        begins = np.cumsum(sizes) - sizes
        # An empty document begins where the next one does; the last that begins there holds the words.
        doc = np.searchsorted(begins, runs[:, 0], side="right") - 1
        by_doc = np.split(runs, np.searchsorted(doc, np.arange(1, len(rows))))
        said, text = [], []
        for (_, words), mine, begin in zip(rows, by_doc, begins.tolist()):
            if len(mine):
                mine = mine - [begin, begin, 0]
                change = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(change, mine[:, 0] + mine[:, 2], 1)
                np.add.at(change, mine[:, 1], -1)
                stays = np.cumsum(change[:-1]) == 0
                mine = mine[np.lexsort((mine[:, 2], mine[:, 0]))]
                words = [words[i] for i in np.flatnonzero(stays)]
            said.append([{"start": s, "length": e - s, "period": q} for s, e, q in mine.tolist()])
            text.append(b" ".join(words))
        struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        return pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in rows], pa.int64()), pa.array(sizes), pa.array(said, pa.list_(struct)), pa.array(text, pa.binary())],
            ["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, n = [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                words = words_of(text)
                rows.append((doc_id, edit(doc_id, words) if edit else words))
                n += len(rows[-1][1])
                if n >= GROUP_WORDS:
                    yield batch(rows)
                    rows, n = [], 0
            if rows:
                yield batch(rows)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)

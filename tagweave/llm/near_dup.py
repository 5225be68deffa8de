"""Near-duplicate documents: MinHash, banding, signature check, exact check,
and components by alternating large-star and small-star.

1. ``signatures``: per document the set of word shingles (A-Z lowered, words
   ``[^\\x20\\x09-\\x0D]+``, hashed to 64 bits), a 128-bit digest of that set and
   the minima of universal hash functions in bands of 5, of which there are 20
   or as many as the limit needs: two sets at the limit share no band with
   probability under 1e-5.
2. Documents with equal sets form a class, found by a partially aggregated
   count on the digest; only the class representative (smallest id) goes on.
3. Hub round: in every band bucket each member is paired with one hub, chosen
   by a hash that differs by bucket. The pairs are linear in the rows. Pairs
   survive the signature estimate, then the exact comparison of full sets.
4. ``components`` joins them. A bucket whose members are all in one component
   needs no more pairs. Where a bucket still holds several components, a link
   between them may be missing: the rest of the work is on those members.
5. A member is dropped by proof: it shares too few shingles with documents of
   other components to reach the limit with any of them (a count per shingle,
   linear in the rows, by the block exchange of exchange.py).
6. More hub rounds pair what is outside a bucket's main component with another
   member of it, as long as that finds links.
7. Then every pair of members of different components is compared that two bounds
   admit: those with a rare shingle in common (in at most ``RARE`` documents), and
   those of a bucket whose frequent shingles alone can reach the limit. Nothing
   is capped; near copies that hubs missed are the only ones left there.

No group is collected: buckets, hubs and stars are partially aggregated minima
and joins whose hot keys Spark's skew join splits.

Defined results: a document without words (or null text) has an empty set, is
linked with nothing and kept; with fewer words than a shingle, the whole
sequence is the one shingle; a node is a set, so every text of a doc_id finds
its links. In ``near_duplicates`` the texts of one doc_id belong to one
component; a row without doc_id has the component of its set, null if no row of
it has an id, and is not kept where one has. ``deduplicated`` goes by sets
alone: of each component of sets one row stays, the least doc_id (null last),
then the least text; other texts of that id stay if their sets are no copies.
Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm import exchange
from tagweave.llm.common import gathered, stored

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80
ROWS = 5
#: The chance that a pair at the limit shares no band.
MISSED = 1e-5
#: Share of equal minima below which a pair is not compared: over five standard
#: deviations under the limit for 100 minima.
ESTIMATE_SLACK = 0.2
WORD_CACHE = 100_000
BROADCAST_IDS = 500_000
FEW_EDGES = 50_000
#: Rows with texts of a partition of a gathered table.
MEMBER_ROWS = 5_000
#: Hub rounds go on while one of so many pairs is a link.
FEW_LINKS = 20
#: A shingle of so many documents is rare: an index of these stays linear.
RARE = 8

_U = np.uint64
_MIX = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _MIX[3]
    return x ^ (x >> _U(29))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text; word hashes are cached, at most ``WORD_CACHE``."""

    def __init__(self, k: int):
        self.k = k
        self._cache: dict[bytes, int] = {}

    def _hash(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self._cache) >= WORD_CACHE:
            self._cache.clear()
        self._cache[word] = h
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, dtype=np.uint64)
        get, new = self._cache.get, self._hash
        h = np.fromiter((get(w) or new(w) for w in words), dtype=np.uint64, count=len(words))
        k = min(self.k, len(words))
        acc = np.full(len(words) - k + 1, _U(k), dtype=np.uint64)
        for j in range(k):
            acc = _mixed(acc * _MIX[0] + h[j:j + len(acc)] * _MIX[1] + _MIX[2])
        return np.unique(acc)


@lru_cache(maxsize=1)
def _shingler(k: int) -> Shingler:
    """One for the tasks that a Python worker runs one after the other."""
    return Shingler(k)


def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = lambda i, s: int.from_bytes(hashlib.blake2b(f"{s}{i}".encode(), digest_size=4).digest(), "little")
    return (np.array([draw(i, "a") | 1 for i in range(n)], dtype=np.uint32)[:, None],
            np.array([draw(i, "b") for i in range(n)], dtype=np.uint32)[:, None])


def _minima(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of every universal hash (multiply and add modulo 2^32, on the high half) over the set."""
    x, out = (s >> _U(32)).astype(np.uint32)[None, :], np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, x.shape[1], 512):
        h = a * x[:, at:at + 512]
        h += b
        np.minimum(out, h.min(axis=1), out=out)
    return out.astype("<u4")


def bands_for(percent: int, rows: int = ROWS) -> int:
    """Bands by which a pair at the limit is missed with a probability under ``MISSED``: 20 at 85, 29 at 80."""
    share = (percent / 100) ** rows
    return math.ceil(math.log(MISSED) / math.log1p(-share)) if share < 1 else 1


def signatures(docs: DataFrame, shingle_words: int, bands: int, rows: int = ROWS) -> DataFrame:
    """doc_id, n (set size), d1, d2 (digest of the set), sig (minima), keys (one per band)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = _hash_family(bands * rows)
        shingles = _shingler(shingle_words)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].array, batch["text"].array):
                s = shingles(None if pd.isna(text) else text)
                if not len(s):
                    out.append((doc_id, 0, 0, 0, None, None))
                    continue
                d1, d2 = _digest(s)
                sig = _minima(s, a, b)
                acc = np.arange(1, bands + 1, dtype=np.uint64)
                for r in range(rows):
                    acc = _mixed(acc * _MIX[0] + sig.reshape(bands, rows)[:, r].astype(np.uint64) * _MIX[1] + _MIX[2])
                out.append((doc_id, len(s), d1, d2, sig.tobytes(), acc.view(np.int64)))
            frame = pd.DataFrame(out, columns=["doc_id", "n", "d1", "d2", "sig", "keys"])
            frame["doc_id"] = pd.array(frame["doc_id"], dtype="Int64")
            yield frame

    return docs.select("doc_id", "text").mapInPandas(
        run, "doc_id long, n long, d1 long, d2 long, sig binary, keys array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, component = least node reachable) of the undirected ``edges`` (a, b),
    by alternating large-star and small-star (Kiveris et al.), run until no
    edge changes; every round is written to the shared folder."""
    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    # Few edges are one partition, whose joins and sums need no shuffle; the rounds are the same.
    few = (lambda d: d.coalesce(1)) if e.count() <= FEW_EDGES else (lambda d: d)
    e, last = few(e), None
    while True:
        both = few(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.greatest("b", "m").alias("x"), F.least("b", "m").alias("y"))
        e = few(stored(few(small.select(F.col("x").alias("a"), F.col("y").alias("b"))
                           .unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b")).distinct()))
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stored(nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))


def _verified(pairs: DataFrame, members: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs (a, b) whose sets reach ``percent``: sizes, then signatures, then full sets."""
    side = lambda s, *cols: members.select(F.col("rep").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in cols])
    least = percent / 100 - ESTIMATE_SLACK

    def estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.frombuffer(b"".join(b["sig_a"]), dtype="<u4").reshape(len(b), -1)
                y = np.frombuffer(b"".join(b["sig_b"]), dtype="<u4").reshape(len(b), -1)
                yield b.loc[(x == y).mean(axis=1) >= least, ["a", "b"]]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = _shingler(k)
        for b in batches:
            keep = []
            for x, y in zip(b["text_a"], b["text_b"]):
                s, t = shingles(x), shingles(y)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield b.loc[keep, ["a", "b"]]

    sized = pairs.join(side("a", "n", "sig"), "a").join(side("b", "n", "sig"), "b").where(
        100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    near = gathered(sized.select("a", "b", "sig_a", "sig_b").mapInPandas(estimate, "a long, b long"))
    full = near.join(side("a", "text"), "a").join(side("b", "text"), "b").select("a", "b", "text_a", "text_b")
    return gathered(full.mapInPandas(compare, "a long, b long"))


def _mixed_buckets(rows: DataFrame, label: DataFrame) -> DataFrame:
    """The rows (key, rep, n, ...) of buckets with several components, with their
    component ``comp`` and the bucket's most frequent one, ``main``."""
    rows = gathered(rows.join(label.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn(
        "comp", F.coalesce("component", "rep")).drop("component"))
    # Counted by component first: no task holds all components of a bucket.
    sizes = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"))
    mixed = sizes.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max_by("comp", F.struct("size", "comp")).alias("main"))
    return rows.join(mixed.where("lo <> hi").select("key", "main"), "key")


_SHINGLE = np.dtype([("key", "<u8"), ("count", "<u4"), ("lo", "<i8"), ("hi", "<i8")])


def _spread(values: np.ndarray, block: np.ndarray) -> np.ndarray:
    """0: the shingle stands in one component; else 1: in few documents, 2: in many."""
    unique, inverse = np.unique(values["key"], return_inverse=True)
    count, lo, hi = np.zeros(len(unique), np.int64), np.full(len(unique), np.iinfo(np.int64).max), np.full(len(unique), np.iinfo(np.int64).min)
    np.add.at(count, inverse, values["count"])
    np.minimum.at(lo, inverse, values["lo"])
    np.maximum.at(hi, inverse, values["hi"])
    return np.where(lo == hi, 0, np.where(count <= RARE, 1, 2)).astype(np.uint8)[inverse]


def _shared_shingles(reps: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(rep, c, rare) of ``reps`` (rep, comp): how many of its shingles stand in
    another component and in many documents, and which in another and in few."""
    blocks, parts = exchange.pack_blocks(reps.join(members.select("rep", "text"), "rep"))

    def sets(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shingles = _shingler(k)
        found = [shingles(x) for x in t.column("text").to_pylist()]
        row = np.repeat(np.arange(len(found)), [len(x) for x in found])
        unique, inverse = np.unique(np.concatenate(found), return_inverse=True)
        return row, unique, inverse

    def keys_of(t: pa.Table, said: dict) -> tuple[np.ndarray, np.ndarray]:
        row, unique, inverse = sets(t)
        comp, values = t.column("comp").to_numpy()[row], np.empty(len(unique), dtype=_SHINGLE)
        values["key"], values["count"] = unique, np.bincount(inverse, minlength=len(unique))
        values["lo"], values["hi"] = np.iinfo(np.int64).max, np.iinfo(np.int64).min
        np.minimum.at(values["lo"], inverse, comp)
        np.maximum.at(values["hi"], inverse, comp)
        return unique, values

    def counts(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        said, out = exchange.answers_of(right)[1], []
        for payload in left["payload"]:
            t = exchange.unpacked(payload)
            row, unique, inverse = sets(t)
            what, reps = said[inverse], t.column("rep").to_numpy()
            c = np.bincount(row[what == 2], minlength=len(reps))
            rare = np.flatnonzero(what == 1)
            split = np.split(unique.view(np.int64)[inverse[rare]], np.searchsorted(row[rare], np.arange(1, len(reps))))
            out.append(pd.DataFrame({"rep": reps, "c": c, "rare": split}))
        return pd.concat(out) if out else pd.DataFrame({"rep": [], "c": [], "rare": []})

    answers = exchange.ask(blocks, None, keys_of, _spread, _SHINGLE, parts, 1)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(counts, "rep long, c long, rare array<long>")


def _hub_pairs(rows: DataFrame, number: int) -> DataFrame:
    """What is outside the main component of a bucket, with a member of it: first
    the one with the largest share of frequent shingles, then others."""
    order = -F.col("c") / F.col("n") if number == 1 else F.xxhash64("rep", "key", F.lit(number))
    hub = rows.where("comp = main").groupBy("key").agg(F.min(F.struct(order.alias("o"), "rep")).alias("hub"))
    return _pairs(rows.where("comp <> main").join(hub.select("key", F.col("hub.rep").alias("hub")), "key"), "rep", "hub")


def _pairs(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.where(F.col(x) != F.col(y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()


def _open_pairs(rows: DataFrame, rare: DataFrame, percent: int) -> DataFrame:
    """Pairs in different components that the bounds can't rule out: two sets
    have at most the smaller count ``c`` of frequent shingles in common, and the
    rare ones that both hold, which are few documents' each."""
    side = lambda d, s: d.select(*[F.col(x) if x in ("key", "s") else F.col(x).alias(f"{x}_{s}") for x in d.columns])
    bound = lambda more: F.expr(f"comp_x <> comp_y AND {100 + percent} * (least(c_x, c_y) + {more}) >= {percent} * (n_x + n_y)")
    keys = rows.groupBy("rep").agg(F.collect_set("key").alias("keys"))          # one a band at most
    cols = rows.select("key", "rep", "comp", "n", "c", "main").join(keys, "rep")
    # A pair is made in one of the buckets it shares.
    first = F.col("key") == F.array_min(F.array_intersect("keys_x", "keys_y"))
    frequent = side(cols.where("comp <> main").drop("main"), "x").join(side(cols.drop("main"), "y"), "key").where(bound(0) & first)
    held = rows.select("rep", "comp", "n", "c").distinct().join(rare, "rep")
    both = side(held, "x").join(side(held, "y"), "s").where("rep_x < rep_y AND comp_x <> comp_y")
    names = [f"{x}_{s}" for s in "xy" for x in ("rep", "comp", "n", "c")]
    few = both.groupBy(*names).agg(F.count(F.lit(1)).alias("both")).where(bound("both"))
    return _pairs(frequent.select("rep_x", "rep_y").unionByName(few.select("rep_x", "rep_y")), "rep_x", "rep_y")


def _labels(buckets: DataFrame, members: DataFrame, percent: int, k: int) -> DataFrame:
    """(node, component) of the linked ones among ``members`` (rep, n, sig, text); ``buckets``: key, rep, n."""
    hubs = buckets.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep", "key").alias("o"), "rep")).alias("hub"))
    links = _verified(gathered(_pairs(buckets.join(hubs.select("key", F.col("hub.rep").alias("hub")), "key"), "rep", "hub")), members, percent, k)
    label = components(links)

    rows = gathered(_mixed_buckets(buckets, label))
    shared = gathered(_shared_shingles(rows.select("rep", "comp").distinct(), members, k))
    # The other's set is at least percent / 100 as large, so that share of a set must be common.
    able = gathered(rows.drop("comp", "main").join(shared.select("rep", "c", F.size("rare").alias("few")), "rep")
                  .where(F.expr(f"100 * (c + few) >= {percent} * n")).drop("few"))
    rare = shared.select("rep", F.explode("rare").alias("s"))
    number = 0
    while True:
        rows = gathered(_mixed_buckets(able, label))
        number += 1
        pairs = gathered(_hub_pairs(rows, number))
        more = _verified(pairs, members, percent, k)
        found, tried = more.count(), pairs.count()
        if found:
            links = gathered(links.unionByName(more))
            label = components(links)
        if found * FEW_LINKS < tried or not tried:
            break
    last = _verified(gathered(_open_pairs(gathered(_mixed_buckets(able, label)), rare, percent)), members, percent, k)
    return components(links.unionByName(last)) if last.head(1) else label


def _digest(words: np.ndarray) -> tuple[int, int]:
    """A 128-bit digest of a set of shingles."""
    d1, d2 = np.frombuffer(hashlib.blake2b(words.tobytes(), digest_size=16).digest(), dtype="<i8")
    return int(d1), int(d2)


def _with_digest(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` (text, ...) with n, d1, d2 of their sets, as ``signatures`` has them."""
    @F.pandas_udf("n long, d1 long, d2 long")
    def digest(text: pd.Series) -> pd.DataFrame:
        shingles = _shingler(k)
        sets = [shingles(None if pd.isna(t) else t) for t in text.array]
        return pd.DataFrame([(len(s), *(_digest(s) if len(s) else (0, 0))) for s in sets], columns=["n", "d1", "d2"])

    return rows.withColumn("set", digest("text")).select(*rows.columns, "set.n", "set.d1", "set.d2")


SET = ["d1", "d2", "n"]


def _set_components(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n, d1, d2, ...) of every row; (node, rep = least doc_id, d1, d2, n) of every
    class of equal sets; and (node, component) of the linked ones."""
    sigs = stored(signatures(docs, k, max(20, bands_for(percent))))
    classes = sigs.where("n > 0").groupBy(*SET).agg(
        F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    classes = gathered(classes.withColumn("node", F.monotonically_increasing_id()))
    nodes = classes.select(F.col("node").alias("rep"), "n", "sig", "keys")
    keys = nodes.select("rep", "n", F.posexplode("keys").alias("band", "h")).select("rep", "n", F.xxhash64("band", "h").alias("key"))
    several = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key")
    buckets = gathered(keys.join(several, "key"))
    # Only what shares a bucket needs its text and signature again.
    members = classes.join(buckets.select(F.col("rep").alias("node")).distinct(), "node", "left_semi")
    members = gathered(members.select(F.col("node").alias("rep"), "n", "sig", "d1", "d2", F.col("rep").alias("doc_id")))
    # Where all rows of an id have one set, any text of the id has it; else the digests tell.
    several_sets = sigs.groupBy("doc_id").agg(F.min(F.struct(*SET)).alias("lo"), F.max(F.struct(*SET)).alias("hi")).where("lo <> hi OR doc_id IS NULL")
    several_sets = gathered(several_sets.select("doc_id"))
    given = docs.where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    one = F.col("id") == F.col("doc_id")
    plain = gathered(members.join(several_sets, "doc_id", "left_anti").where("doc_id IS NOT NULL").select("rep", "doc_id"))
    # A few ids go to every task, so that only the members' texts move.
    texts = given.join(F.broadcast(plain) if plain.count() <= BROADCAST_IDS else plain, one).select("rep", "text")
    if several_sets.head(1):
        again = given.join(several_sets, F.col("id").eqNullSafe(F.col("doc_id")), "left_semi").select("text")
        texts = texts.unionByName(_with_digest(again, k).join(members.select("rep", *SET), SET).select("rep", "text"))
    members = gathered(members.select("rep", "n", "sig").join(texts, "rep").groupBy("rep").agg(
        F.first("n").alias("n"), F.first("sig").alias("sig"), F.min("text").alias("text")), MEMBER_ROWS)
    return sigs, classes.select("node", "rep", *SET), _labels(buckets, members, percent, k)


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    sigs, classes, label = _set_components(docs, shingle_words, percent)
    sets = gathered(sigs.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", *SET).distinct().join(classes.select("node", *SET), SET).select("doc_id", "node"))
    first = sets.groupBy("doc_id").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last").select("doc_id", "first")
    shared = gathered(sets.join(first, "doc_id").select("doc_id", F.col("node").alias("a"), F.col("first").alias("b")))
    if shared.head(1):
        label = components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(shared.select("a", "b")))
    of_class = gathered(classes.join(label, "node", "left").select("rep", *SET, F.coalesce("component", "node").alias("component")))
    least = of_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = of_class.join(least, "component").select(*SET, "component_id")
    out = sigs.select("doc_id", *SET).join(found, SET, "left")
    # A text without words belongs to its id's component all the same.
    empty = out.where("n = 0").select("doc_id", "n").join(
        out.where("n > 0").groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.where("n > 0").select("doc_id", "n", "component_id").unionByName(empty).select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def deduplicated(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component of sets, and all without words."""
    sigs, classes, label = _set_components(docs, shingle_words, percent)
    of_class = gathered(classes.join(label, "node", "left").select("rep", *SET, F.coalesce("component", "node").alias("component")))
    # A component without ids has a null here, and one of its rows stays.
    of_class = of_class.join(of_class.groupBy("component").agg(F.min("rep").alias("stays")), "component").select(*SET, "component", "stays")
    several = gathered(sigs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1 OR doc_id IS NULL").select("doc_id"))
    gone = sigs.where("n > 0").select("doc_id", *SET).join(of_class, SET).where("doc_id <> stays").select("doc_id")
    gone = gathered(gone.unionByName(several.where("doc_id IS NOT NULL")).distinct())
    # A few ids go to every task, so that no text moves; more are joined by a shuffle.
    few = gone.count() <= BROADCAST_IDS
    columns = [f"`{c}`" for c in docs.columns]
    out = docs.where("doc_id IS NOT NULL").join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*columns)
    if not several.head(1):
        return out
    # Rows that share an id, or have none, are told apart by their sets, then by what they hold.
    held = docs.select(F.struct(*columns).alias("row"), F.col("doc_id").alias("id"), "text")
    held = held.join(several, F.col("id").eqNullSafe(F.col("doc_id")), "left_semi")
    held = stored(_with_digest(held, shingle_words).join(of_class, SET, "left"))
    # A text of the staying id goes to whoever has it; the least one of a component's rows is that.
    best = held.where("n > 0 AND id <=> stays").groupBy("component").agg(
        F.min_by("row", F.struct("text", F.md5(F.to_json("row")))).alias("row"))
    again = held.where("n = 0").select("row").unionByName(best.select("row")).select("row.*")
    return out.unionByName(again.toDF(*docs.columns)).select(*columns)

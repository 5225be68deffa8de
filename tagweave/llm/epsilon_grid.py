"""Near-duplicate vectors: similarity join in epsilon grid order.

A cosine of ``t`` between unit vectors is a distance of ``sqrt(2 - 2 t)``, epsilon.

1. Vectors are turned to their leading principal dimensions (second moments over
   all of them, summed in two steps) and sorted by the grid cells of side epsilon
   there, lexicographically; finer cells and the row's number break ties, so that
   a cell, or one vector that a third of all rows repeat, is cut as well.
2. The sequence is cut into blocks; sixteen neighbours form an interval, sixteen
   intervals the next, up to one. Each has the bounds of its coordinates and of
   what is left beside them, a centre and a radius.
3. The join starts with the whole sequence against itself and goes down: a pair of
   intervals that is provably further apart than epsilon is dropped, one that is
   provably within epsilon is counted as a whole, all others are split. A level
   is a join of the open pairs with their parts.
4. Open pairs of blocks are compared in tiles of 16 x 16 blocks, so that a block
   travels once a tile. A bound by the leading dimensions leaves few pairs of
   vectors, whose cosines are computed in double precision.
5. Every vector counts its links; a tile returns a spanning forest of its links,
   not the links, and intervals that are near as a whole return one edge a vector.
   Components by large-star and small-star.

What grows with the rows is rows, blocks and open pairs of blocks; where vectors
have no structure that leading dimensions show, few pairs of blocks are dropped
and the join stays a product of blocks.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows without vec_id, link with nothing; vectors of different
lengths never link; rows that repeat a vec_id are one node of the components and
each count their own links, to each other too; empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import parts_for, stored
from tagweave.llm.near_dup import components

COSINE = 0.95
#: Dimensions of the grid.
LEADING = 16
#: Vectors and bytes of a block at most, and bytes of a partition of the sequence.
BLOCK_ROWS, BLOCK_BYTES, PART_BYTES = 512, 512 << 10, 4 << 20
#: Bits of the number of a part within its interval.
FAN = 4
#: Distances are taken as proof only beyond this.
MARGIN = 1e-6
#: Share of pairs that the leading dimensions leave, above which all are multiplied.
DENSE = 0.05

_ROW_BITS = 10
CLEAN = "vec_id long, dim int, raw binary"
SUMMARY = "code long, dim int, n long, lo binary, hi binary, centre binary, radius double, rep long"


def clean(vectors: DataFrame, column: str) -> tuple[DataFrame, str]:
    """(vec_id, dim, raw): the components as bytes, null where a row links with nothing; and their numpy type."""
    kind = "<f4" if dict(vectors.dtypes)[column] == "array<float>" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = b.column(0), b.column(1)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(kind)
            ends = np.cumsum(size)
            # Sums over a row: every component is finite, and one isn't zero.
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            some = np.concatenate([[0], np.cumsum(flat != 0)])
            fine = (bad[ends] == bad[ends - size]) & (some[ends] > some[ends - size]) & ~ids.is_null().to_numpy(zero_copy_only=False)
            raw = [flat[e - n:e].tobytes() if ok else None for e, n, ok in zip(ends.tolist(), size.tolist(), fine.tolist())]
            yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int32()), pa.array(raw, pa.binary())], ["vec_id", "dim", "raw"])

    typed = F.col(column) if kind == "<f4" else F.col(column).cast("array<double>")
    return stored(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), typed.alias("v")).mapInArrow(run, CLEAN)), kind


def units(raw: bytes, kind: str, dim: int) -> np.ndarray:
    """The vectors of one length, in double precision; scaled by their largest component first, so that no square overflows."""
    x = np.frombuffer(raw, dtype=kind).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal(rows: DataFrame, kind: str, dim: int) -> np.ndarray:
    """The leading principal dimensions of all vectors of length ``dim``, as columns.
    The driver gets the square root of the number of partitions of sums, each ``dim`` squared."""
    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        square, total, n = np.zeros((dim, dim)), np.zeros(dim), 0
        for b in batches:
            if len(b):
                u = units(b"".join(b["raw"]), kind, dim)
                square, total, n = square + u.T @ u, total + u.sum(axis=0), n + len(u)
        yield pd.DataFrame({"group": [TaskContext.get().partitionId() % groups], "body": [np.concatenate([square.ravel(), total, [n]]).tobytes()]})

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"body": [np.sum([np.frombuffer(x) for x in frame["body"]], axis=0).tobytes()]})

    mine = rows.where(F.col("dim") == dim).select("raw")
    groups = math.isqrt(mine.rdd.getNumPartitions()) + 1
    sums = mine.mapInPandas(moments, "group long, body binary").groupBy("group").applyInPandas(added, "body binary").collect()
    total = np.sum([np.frombuffer(r["body"]) for r in sums], axis=0)
    mean = total[dim * dim:-1] / total[-1]
    _, axes = np.linalg.eigh(total[:dim * dim].reshape(dim, dim) / total[-1] - np.outer(mean, mean))
    return np.ascontiguousarray(axes[:, ::-1][:, :LEADING])


class Grid:
    """Coordinates and cells of unit vectors; lengths other than the most frequent one are read as they are."""

    def __init__(self, axes: np.ndarray, cosine: float):
        self.axes, self.cosine, self.epsilon = axes, cosine, math.sqrt(2 - 2 * cosine)

    def coordinates(self, u: np.ndarray) -> np.ndarray:
        """The leading coordinates, and the length of what is left."""
        lead = u @ self.axes if u.shape[1] == self.axes.shape[0] else u[:, :LEADING]
        return np.concatenate([lead, np.sqrt(np.maximum(0, 1 - (lead * lead).sum(axis=1, keepdims=True)))], axis=1)

    def cells(self, u: np.ndarray) -> list[bytes]:
        """Sort keys: length, cells of side epsilon, then cells an eighth as wide."""
        x = self.coordinates(u)[:, :-1]
        side = max(self.epsilon, 1 / 100)
        out = np.concatenate([np.floor(x / side) + 128, np.mod(np.floor(x * 8 / side), 8)], axis=1).astype(np.uint8)
        return [u.shape[1].to_bytes(4, "big") + row.tobytes() for row in out]


def sequence(rows: DataFrame, kind: str, grid: Grid) -> tuple[DataFrame, int, int]:
    """The blocks of the sorted sequence (part, i, ids, raw and a summary), the bits of ``i``, and those of both numbers."""
    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, some in b.groupby("dim", sort=False):
                yield some.assign(cell=grid.cells(units(b"".join(some["raw"]), kind, int(dim))))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, i, held = TaskContext.get().partitionId(), 0, pd.DataFrame()

        def block(b: pd.DataFrame) -> pd.DataFrame:
            dim, raw = int(b["dim"].iloc[0]), b"".join(b["raw"])
            u = units(raw, kind, dim)
            x, centre = grid.coordinates(u), u.mean(axis=0)
            ids = b["vec_id"].to_numpy()
            return pd.DataFrame({"part": [part], "i": [i], "ids": [ids], "raw": [raw], "dim": [dim], "n": [len(b)], "lo": [x.min(axis=0).tobytes()],
                                 "hi": [x.max(axis=0).tobytes()], "centre": [centre.tobytes()], "radius": [math.sqrt(((u - centre) ** 2).sum(axis=1).max())],
                                 "rep": [ids.min()]})

        for b in batches:
            held = pd.concat([held, b]) if len(held) else b
            while len(held):
                dim = int(held["dim"].iloc[0])
                most = max(16, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dim)))
                other = np.flatnonzero(held["dim"].to_numpy() != dim)
                n = min(most, int(other[0]) if len(other) else len(held))
                if n < most and not len(other):
                    break       # more may come
                yield block(held[:n])
                held, i = held[n:], i + 1
        if len(held):
            yield block(held)

    size = rows.agg(F.sum(F.octet_length("raw"))).first()[0]
    parts = parts_for(size, PART_BYTES, 8)
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    dealt = tied.mapInPandas(keyed, f"{CLEAN}, tie long, cell binary").repartitionByRange(parts, "cell", "tie").sortWithinPartitions("cell", "tie")
    blocks = stored(dealt.select("vec_id", "dim", "raw").mapInPandas(cut, "part long, i long, ids array<long>, raw binary, " + SUMMARY.split(", ", 1)[1]))
    most = blocks.agg(F.max("i"), F.max("part")).first()
    bits = int(most[0]).bit_length()
    return blocks.withColumn("code", F.shiftleft("part", bits) + F.col("i")), bits + int(most[1]).bit_length(), bits


def _joined(frame: pd.DataFrame) -> pd.DataFrame:
    """The summary of an interval from those of its parts; intervals of vectors of several lengths have none."""
    code = frame["code"].iloc[0] >> FAN
    out = {"code": [code], "dim": [-1], "n": [frame["n"].sum()], "lo": [None], "hi": [None], "centre": [None], "radius": [np.inf], "rep": [frame["rep"].min()]}
    if frame["dim"].nunique() == 1 and frame["dim"].iloc[0] >= 0:
        rows = lambda c: np.stack([np.frombuffer(x) for x in frame[c]])
        n, centres = frame["n"].to_numpy(), rows("centre")
        centre = (centres * n[:, None]).sum(axis=0) / n.sum()
        far = np.sqrt(((centres - centre) ** 2).sum(axis=1)) + frame["radius"].to_numpy()
        out |= {"dim": [frame["dim"].iloc[0]], "lo": [rows("lo").min(axis=0).tobytes()], "hi": [rows("hi").max(axis=0).tobytes()],
                "centre": [centre.tobytes()], "radius": [far.max()]}
    return pd.DataFrame(out)


def verdicts(b: pd.DataFrame, epsilon: float) -> np.ndarray:
    """-1: provably further apart than epsilon, 1: provably within, 0: neither."""
    out = np.zeros(len(b), dtype=np.int8)
    da, db = b["dim_a"].to_numpy(), b["dim_b"].to_numpy()
    out[(da != db) & (da >= 0) & (db >= 0)] = -1
    for dim in np.unique(da[(da == db) & (da >= 0)]):
        at = np.flatnonzero((da == dim) & (db == dim))
        rows = lambda c: np.stack([np.frombuffer(x) for x in b[c].iloc[at]])  # noqa: B023, E731
        gap = np.maximum(0, np.maximum(rows("lo_a") - rows("hi_b"), rows("lo_b") - rows("hi_a")))
        apart = np.sqrt(((rows("centre_a") - rows("centre_b")) ** 2).sum(axis=1))
        wide = b["radius_a"].to_numpy()[at] + b["radius_b"].to_numpy()[at]
        far = (np.sqrt((gap * gap).sum(axis=1)) > epsilon + MARGIN) | (apart - wide > epsilon + MARGIN)
        out[at] = np.where(far, -1, np.where(apart + wide < epsilon - MARGIN, 1, 0))
    return out


def open_pairs(blocks: DataFrame, bits: int, epsilon: float) -> tuple[DataFrame, DataFrame]:
    """Pairs of blocks (a, b) that must be compared, and pairs of intervals that are
    near as a whole: (level, a, b, n_a, n_b, rep_a, rep_b). Each pair once, a <= b."""
    levels = [blocks.select("code", "dim", "n", "lo", "hi", "centre", "radius", "rep")]
    for _ in range(-(-bits // FAN)):
        levels.append(stored(levels[-1].groupBy(F.shiftright("code", FAN)).applyInPandas(_joined, SUMMARY)))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said = verdicts(b, epsilon)
            yield b.loc[said >= 0, ["level", "code_a", "code_b", "n_a", "n_b", "rep_a", "rep_b"]].assign(near=said[said >= 0] == 1)

    pairs, near = None, None
    for level in range(len(levels) - 1, -1, -1):
        side = lambda s: levels[level].select(*[F.col(c).alias(f"{c}_{s}") for c in levels[level].columns])  # noqa: B023, E731
        if pairs is None:
            both = side("a").join(side("b"), F.col("code_a") == F.col("code_b"))      # one interval, the whole sequence
        else:
            above = pairs.select(F.col("code_a").alias("up_a"), F.col("code_b").alias("up_b"))
            both = above.join(side("a"), F.col("up_a") == F.shiftright("code_a", FAN)).join(side("b"), F.col("up_b") == F.shiftright("code_b", FAN))
        both = both.where("code_a <= code_b").withColumn("level", F.lit(level))
        said = stored(both.mapInPandas(judge, "level int, code_a long, code_b long, n_a long, n_b long, rep_a long, rep_b long, near boolean"))
        pairs, found = said.where("NOT near"), said.where("near").drop("near")
        near = found if near is None else near.unionByName(found)
    return pairs.select(F.col("code_a").alias("a"), F.col("code_b").alias("b")), near


def _merge(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Joins the trees of ``x`` and ``y`` pair by pair; ``root`` says the least member of each node's tree."""
    while len(x):
        rx, ry = root[x], root[y]
        apart = rx != ry
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        if len(x):
            np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
            while (root[root] != root).any():
                root[:] = root[root]


def linked(a: np.ndarray, b: np.ndarray, xa: np.ndarray, xb: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) where the cosine of ``a[i]`` and ``b[j]``, computed in double precision, is at least ``cosine``.
    By Cauchy and Schwarz it is at most the leading coordinates' product and that of the lengths beside them."""
    i, j = np.nonzero(xa.astype(np.float32) @ xb.astype(np.float32).T >= cosine - 1e-4)
    if len(i) > DENSE * len(a) * len(b):
        return np.nonzero(a @ b.T >= cosine)
    right = np.einsum("ij,ij->i", a[i], b[j]) >= cosine
    return i[right], j[right]


def compare(blocks: DataFrame, pairs: DataFrame, kind: str, grid: Grid) -> DataFrame:
    """(x, y, edge): the number y of links that the row x has found in a tile, or an edge of two ids of its spanning forest."""
    def tile(key, wanted: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        held = held.drop_duplicates("code").sort_values("code")
        codes = held["code"].to_numpy()
        vectors = [units(r, kind, int(d)) for r, d in zip(held["raw"], held["dim"])]
        lead = [grid.coordinates(u) for u in vectors]
        begin = np.concatenate([[0], np.cumsum([len(u) for u in vectors])])
        root, count = np.arange(begin[-1]), np.zeros(begin[-1], dtype=np.int64)
        for a, b in zip(np.searchsorted(codes, wanted["a"]), np.searchsorted(codes, wanted["b"])):
            i, j = linked(vectors[a], vectors[b], lead[a], lead[b], grid.cosine)
            if a == b:
                i, j = i[i < j], j[i < j]
            i, j = i + begin[a], j + begin[b]
            count += np.bincount(i, minlength=len(count)) + np.bincount(j, minlength=len(count))
            _merge(root, i, j)
        ids = np.concatenate([np.asarray(x, dtype=np.int64) for x in held["ids"]]) if len(held) else np.empty(0, np.int64)
        rows = np.concatenate([(c << _ROW_BITS) + np.arange(len(u)) for c, u in zip(codes, vectors)]) if len(held) else ids
        some, child = np.flatnonzero(count), np.flatnonzero((root != np.arange(len(root))) & (ids != ids[root]))
        return pd.concat([pd.DataFrame({"x": rows[some], "y": count[some], "edge": False}),
                          pd.DataFrame({"x": ids[child], "y": ids[root[child]], "edge": True})])

    tiles = pairs.select(F.shiftright("a", FAN).alias("ta"), F.shiftright("b", FAN).alias("tb"), "a", "b")
    needed = tiles.select(F.col("ta").alias("sa"), F.col("tb").alias("sb"), F.explode(F.array("a", "b")).alias("code")).distinct()
    shipped = needed.join(blocks.select("code", "dim", "ids", "raw"), "code")
    return stored(tiles.groupBy("ta", "tb").cogroup(shipped.groupBy("sa", "sb")).applyInPandas(tile, "x long, y long, edge boolean"))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, column: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept."""
    rows, kind = clean(vectors, column)
    alone = rows.where("raw IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    usable = rows.where("raw IS NOT NULL")
    often = usable.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if often is None:
        return alone
    grid = Grid(principal(usable, kind, often["dim"]), cosine)
    blocks, bits, _ = sequence(usable, kind, grid)
    pairs, near = open_pairs(blocks, bits, grid.epsilon)
    found = compare(blocks, pairs, kind, grid)

    # Of a whole interval: so many links for each of its vectors, and one partner that all of them have.
    other = "CASE WHEN code_a = code_b THEN array(struct(code_a AS code, n_a - 1 AS more, rep_a AS hub)) ELSE " \
            "array(struct(code_a AS code, n_b AS more, rep_b AS hub), struct(code_b AS code, n_a AS more, rep_a AS hub)) END"
    facts = near.select("level", F.explode(F.expr(other)).alias("v")).groupBy("level", F.col("v.code").alias("above")).agg(
        F.sum("v.more").alias("more"), F.min("v.hub").alias("hub"))
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("code", FAN * k).alias("above")) for k in range(-(-bits // FAN) + 1)])
    whole = blocks.select("code", "ids", F.explode(levels).alias("v")).select("code", "ids", "v.*").join(facts, ["level", "above"])
    whole = stored(whole.select("code", "more", "hub", F.posexplode("ids").alias("pos", "vec_id")))

    row = (F.shiftleft("code", _ROW_BITS) + F.col("pos")).alias("row")
    links = found.where("NOT edge").select(F.col("x").alias("row"), F.col("y").alias("n")).unionByName(whole.select(row, F.col("more").alias("n")))
    links = links.groupBy("row").agg(F.sum("n").alias("n_links"))
    edges = found.where("edge").select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(
        whole.select(F.col("vec_id").alias("a"), F.col("hub").alias("b"))).unionByName(
        near.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))
    label = components(edges)
    every = blocks.select("code", F.posexplode("ids").alias("pos", "vec_id")).select(row, "vec_id")
    component = F.coalesce("component", "vec_id")
    out = every.join(links, "row", "left").join(label, F.col("vec_id") == F.col("node"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
    return out.unionByName(alone)

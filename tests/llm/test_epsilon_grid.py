import math
import random

import numpy as np
import pandas as pd
import pytest

from tagweave.llm import epsilon_grid, queries


def brute(rows, cosine=0.95):
    """(vec_id, n_links, component_id, kept) of every row, by all pairs."""
    def unit(v):
        if v is None or not len(v) or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, dtype=np.float64) / max(abs(x) for x in v)
        return x / np.sqrt((x * x).sum())

    found = [(i, unit(v) if i is not None else None) for i, v in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for a, (i, u) in enumerate(found):
        for b in range(a):
            j, v = found[b]
            if u is not None and v is not None and len(u) == len(v) and u @ v >= cosine:
                links[a] += 1
                links[b] += 1
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    out = [(i, n, None if i is None else root(i), i is None or root(i) == i) for (i, _), n in zip(rows, links)]
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def near(rng, centre, spread):
    return [float(np.float32(x + rng.gauss(0, spread))) for x in centre]


def clustered(seed, n, dim):
    """Single vectors, clusters tight and loose, exact copies, and multiples of a vector."""
    rng = random.Random(seed)
    gauss = lambda: [rng.gauss(0, 1) for _ in range(dim)]
    out = [gauss() for _ in range(n)]
    for spread, many in ((0.01, n), (0.1, n // 2), (0.2, n // 2), (0.0, n // 2)):
        centre = gauss()
        out += [near(rng, centre, spread) for _ in range(many)]
        out += [[x * 3 for x in near(rng, centre, spread)] for _ in range(many // 4)]
    out = [[float(np.float32(x)) for x in v] for v in out]
    rng.shuffle(out)
    return [(i * 3 - 50, v) for i, v in enumerate(out)]


@pytest.mark.parametrize("dim,block", [(2, 16), (8, 16), (24, 40), (24, 512)])
def test_against_brute_force(spark, monkeypatch, dim, block):
    """Small blocks, so that the join goes down several levels and whole intervals are near."""
    monkeypatch.setattr(epsilon_grid, "BLOCK_ROWS", block)
    rows = clustered(dim, 120, dim)
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int").repartition(5)
    assert result(epsilon_grid.near_vectors(df)) == brute(rows)


def test_whole_intervals_are_counted(spark, monkeypatch):
    """A third of all rows is one vector: its pairs are counted by intervals, not compared."""
    monkeypatch.setattr(epsilon_grid, "BLOCK_ROWS", 16)
    rng = random.Random(5)
    base = [rng.gauss(0, 1) for _ in range(12)]
    rows = [(i, base) for i in range(600)] + [(600 + i, [rng.gauss(0, 1) for _ in range(12)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    real, seen = epsilon_grid.compare, []
    monkeypatch.setattr(epsilon_grid, "compare", lambda blocks, pairs, *rest: seen.append((blocks.count(), pairs.count())) or real(blocks, pairs, *rest))
    assert result(epsilon_grid.near_vectors(df)) == brute(rows)
    blocks, pairs = seen[0]
    assert pairs < blocks * (blocks + 1) / 2 * 0.6


def test_far_blocks_are_skipped(spark, monkeypatch):
    """Vectors on a circle: only neighbours on it are compared."""
    monkeypatch.setattr(epsilon_grid, "BLOCK_ROWS", 16)
    rows = [(i, [math.cos(i / 200), math.sin(i / 200), 0.0]) for i in range(1256)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    real, seen = epsilon_grid.compare, []
    monkeypatch.setattr(epsilon_grid, "compare", lambda blocks, pairs, *rest: seen.append((blocks.count(), pairs.count())) or real(blocks, pairs, *rest))
    assert result(epsilon_grid.near_vectors(df)) == brute(rows)
    blocks, pairs = seen[0]
    assert pairs < blocks * blocks / 5


def test_verdicts_are_proofs():
    rng = np.random.default_rng(3)
    epsilon = math.sqrt(0.1)
    grid = epsilon_grid.Grid(np.linalg.qr(rng.normal(size=(20, 16)))[0], 0.95)
    sets = []
    for _ in range(60):
        u = rng.normal(size=20) + rng.normal(size=(30, 20)) * rng.choice([0.01, 0.1, 0.5])
        sets.append(u / np.linalg.norm(u, axis=1, keepdims=True))
    sets += [s + 0 for s in sets[:20]]
    side = []
    for u in sets:
        x, c = grid.coordinates(u), u.mean(axis=0)
        side.append((20, x.min(axis=0).tobytes(), x.max(axis=0).tobytes(), c.tobytes(), float(np.sqrt(((u - c) ** 2).sum(axis=1)).max())))
    names = ["dim", "lo", "hi", "centre", "radius"]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a, len(sets))]
    frame = pd.DataFrame([(*side[a], *side[b]) for a, b in pairs], columns=[f"{n}_a" for n in names] + [f"{n}_b" for n in names])
    said = epsilon_grid.verdicts(frame, epsilon)
    for (a, b), v in zip(pairs, said):
        cos = sets[a] @ sets[b].T
        assert v == 0 or (cos >= 0.95).all() if v > 0 else v == 0 or not (cos >= 0.95).any()
    assert {-1, 0, 1} == set(said.tolist())


def test_small_table(spark):
    got = result(queries.op11_epsilon_grid(spark, "/root/testdata/sf0.01"))
    rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert got == brute(rows)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [1e-300, 0.0]), (9, [1e300, 1e299]),
            (None, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [2.0, 0.0, 0.0]), (7, [1.0, 0.0]), (12, [1.0]), (13, [-1.0]), (14, [5.0]), (1, [0.0, -1.0]),
            (15, [5e-324, 0.0]), (None, None)]
    df = spark.createDataFrame([(i, v, 1, 2, b"x", 3) for i, v in rows],
                               "vec_id long, embedding array<double>, code long, dim int, raw binary, node long").repartition(3)
    assert result(epsilon_grid.near_vectors(df)) == brute(rows)
    assert epsilon_grid.near_vectors(df.limit(0)).count() == 0
    assert result(epsilon_grid.near_vectors(df.where("embedding IS NULL"))) == [(1, 0, 1, True), (None, 0, None, True)]

"""Ask for facts about keys, in blocks, instead of shuffling a row for each key.

A table is packed into blocks of about two megabytes. A block asks about its
distinct keys: they go, as sorted arrays, to the part of the key space they
belong to. A part sorts what it got from all blocks, decides something for
every key, and returns one byte for each, in the order asked. Every key crosses
the network once per block, not once per occurrence: a key that a third of all
rows hold is pre-aggregated before the shuffle and stays small in its part. The
numbers of blocks and parts follow the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import parts_for, stored, stored_by

BLOCK_BYTES = 2 << 20
#: Text whose keys meet in one part, and text in one Spark partition of blocks.
PART_BYTES = 24 << 20
DEALT_BYTES = 8 << 20

REQUEST = "part long, block long, n long, body binary"
ANSWER = "block long, round int, part long, body binary"

#: A block's table and answers by round, to sorted keys and a structured array of values.
Ask = Callable[[pa.Table, dict[int, np.ndarray]], tuple[np.ndarray, np.ndarray]]


def unpacked(payload: bytes) -> pa.Table:
    with pa.ipc.open_stream(payload) as r:
        return r.read_all()


def pack_blocks(df: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(block, payload) with all columns of ``df``, and the number of parts."""
    size = df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sealed(t: pa.Table) -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(t)
            return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["payload"])

        held, n = [], 0
        for b in batches:
            lengths = pc.binary_length(b.column(b.schema.get_field_index(text)))
            ends = np.cumsum(np.asarray(lengths.fill_null(0), dtype=np.int64) + 16)
            at = 0
            while at < b.num_rows:
                before = ends[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, before + block_bytes - n, side="right")))
                held.append(b.slice(at, stop - at))
                n += int(ends[stop - 1] - before)
                at = stop
                if n >= block_bytes or at < b.num_rows:
                    yield sealed(pa.Table.from_batches(held))
                    held, n = [], 0
        if held:
            yield sealed(pa.Table.from_batches(held))

    packed = df.mapInArrow(pack, "payload binary").select(F.monotonically_increasing_id().alias("block"), "payload")
    return stored_by(packed, parts_for(size, DEALT_BYTES, 8), "block"), parts_for(size, PART_BYTES, 8)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each 64-bit key, by its high half, in key order."""
    return (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _sealed(values: np.ndarray) -> bytes:
    """Records byte plane by byte plane, compressed: ids and sorted keys share their high bytes."""
    planes = values.view(np.uint8).reshape(len(values), -1).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _opened(body: bytes, n: int, dtype: np.dtype) -> np.ndarray:
    raw = pa.decompress(body, decompressed_size=n * dtype.itemsize, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(dtype.itemsize, n).T).view(dtype)[:, 0]


def _sent(block: int, keys: np.ndarray, values: np.ndarray, parts: int) -> pd.DataFrame:
    part = part_of(keys, parts)
    cuts = np.flatnonzero(np.diff(part)) + 1 if len(part) else np.empty(0, np.int64)
    starts = np.concatenate([[0], cuts]) if len(part) else np.empty(0, np.int64)
    bodies = np.split(values, cuts) if len(part) else []
    return pd.DataFrame({"part": part[starts.astype(np.int64)], "block": block, "n": [len(v) for v in bodies],
                         "body": [_sealed(v) for v in bodies]})


def answers_of(frame: pd.DataFrame) -> dict[int, np.ndarray]:
    """The answers to one block, by round, in the order of the keys it asked."""
    out = {}
    for r, g in frame.groupby("round"):
        out[int(r)] = np.frombuffer(b"".join(g.sort_values("part")["body"]), dtype=np.uint8)
    return out


def ask(blocks: DataFrame, answers: DataFrame | None, keys_of: Ask, decide: Callable[[np.ndarray, np.ndarray], np.ndarray],
        dtype: np.dtype, parts: int, number: int) -> DataFrame:
    """One round: ``keys_of`` runs on every block, ``decide(values, block)`` on
    every part, and gives one byte for each value."""
    if answers is None:
        def requests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for block, payload in zip(b["block"], b["payload"]):
                    yield _sent(block, *keys_of(unpacked(payload), {}), parts)

        asked = blocks.mapInPandas(requests, REQUEST)
    else:
        def requests_of(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            found = answers_of(right)
            sent = [_sent(b, *keys_of(unpacked(p), found), parts) for b, p in zip(left["block"], left["payload"])]
            return pd.concat(sent) if sent else _sent(0, np.empty(0, np.uint64), np.empty(0, dtype), parts)

        asked = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(requests_of, REQUEST)

    def reply(frame: pd.DataFrame) -> pd.DataFrame:
        bodies = [_opened(x, n, dtype) for x, n in zip(frame["body"], frame["n"])]
        lengths = [len(x) for x in bodies]
        block = np.repeat(np.arange(len(bodies)), lengths)
        said = decide(np.concatenate(bodies), block)
        return pd.DataFrame({"block": frame["block"], "round": number, "part": frame["part"],
                             "body": [x.tobytes() for x in np.split(said, np.cumsum(lengths)[:-1])]})

    return stored(asked.groupBy("part").applyInPandas(reply, ANSWER))

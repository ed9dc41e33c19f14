"""Best-fit packing with certified bounds.

Documents become token sequences of at most ``capacity`` ids. Each partition packs its pieces by best-fit decreasing;
dual-feasible-function lower bounds certify its number of bins. Partitions whose bins exceed their bound (a gap) give the
documents of their under-filled bins to an exchange, which deals them out anew and reruns best-fit decreasing, until the
gaps are closed or nothing more is won. Only ids and lengths move; no text is shuffled.

Null text is an empty text (its one piece is the end id). Null or repeated ids keep their own pieces: pieces are told
apart by a row id fixed when they are first written. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm import tokens
from pageloom.llm._util import arrow_batch, id_and_text, materialize, slices

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)
PACKED = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill int, gap long"


def cut_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a shorter first one."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int, vocabulary: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(vocabulary)
        for part in slices(batches):
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids = np.asarray([*enc.ids(text), tokens.EOS], dtype="<u4")
                for k, (start, length) in enumerate(cut_pieces(len(ids), capacity)):
                    for column, value in zip(out, (doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes())), strict=True):
                        column.append(value)
            yield arrow_batch(PIECES, out)

    return id_and_text(docs).mapInArrow(run, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item (given in any order; ties keep the given order), and the fill of each bin.

    An integer's bits mark the free spaces that some open bin has, so the tightest bin is one shift away."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fill: list[int] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = free >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_free[room].pop()
            if not by_free[room]:
                free &= ~(1 << room)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        left = room - size
        if left:
            by_free[left].append(b)
            free |= 1 << left
    return bins, offsets, np.asarray(fill, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best bound on the number of bins from two families of dual feasible functions.

    Threshold family: items over capacity - t count as whole bins, items under t as nothing. Rounding family: items count
    as floor((k+1) x / capacity) / k, where (k+1) x / capacity is not whole."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int(count @ x) // capacity)
    upto, volume = np.cumsum(count), np.cumsum(count * x)
    for t in range(1, capacity // 2 + 1):
        large = int(upto[-1] - upto[capacity - t])
        best = max(best, large - (-int(volume[capacity - t] - volume[t - 1]) // capacity))
    for k in range(1, 101):
        whole, rest = np.divmod((k + 1) * x, capacity)
        weight = np.where(rest == 0, x * k, whole * capacity)
        best = max(best, -(-int(count @ weight) // (k * capacity)))
    return best


def _pack(frame: DataFrame, parts: int, turn: int, capacity: int) -> DataFrame:
    """frame: row and the piece columns; dealt to parts, each packed on its own."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row", kind="stable")
        lengths = group["length"].to_numpy()
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        part = int(group["part"].iloc[0])
        gap = len(fill) - lower_bound(lengths, capacity)
        return group.drop(columns="part").assign(sequence_id=(turn << 56) + (part << 32) + bins, offset=offsets, fill=fill[bins], gap=gap)

    dealt = frame.withColumn("part", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(parts)))
    return dealt.groupBy("part").applyInPandas(run, PACKED)


def pack(docs: DataFrame, capacity: int = 1024, vocabulary: str | None = None, part_items: int = 20_000, turns: int = 4, well_filled: float = 0.97) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    part_items: pieces that one partition packs, about; memory of a task is bounded by it. turns: exchanges at most."""
    cut = materialize(pieces(docs, capacity, vocabulary or tokens.default_vocabulary()).withColumn("row", F.monotonically_increasing_id()))
    columns = [f.name for f in PIECES]
    whole = cut.filter(F.col("length") == capacity).select(*columns, F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.filter(F.col("length") < capacity)
    n = rest.count()
    done, final = [whole], columns + ["sequence_id", "offset"]
    parts, turn = max(1, -(-n // part_items)), 1
    packed = materialize(_pack(rest.select("row", *columns), parts, turn, capacity))
    while turn < turns:
        loose = (F.col("gap") > 0) & (F.col("fill") < int(capacity * well_filled))
        given = packed.filter(loose).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sequence_id").alias("bins"), F.sum("length").alias("ids"), F.count_distinct(F.col("sequence_id").bitwiseAND(F.lit((1 << 56) - (1 << 32)))).alias("parts")).first()
        if not given["n"] or given["parts"] == 1 or given["bins"] <= -(-given["ids"] // capacity):
            break
        turn += 1
        again = materialize(_pack(packed.filter(loose).select("row", *columns), max(1, -(-given["n"] // part_items)), turn, capacity))
        if again.select("sequence_id").distinct().count() >= given["bins"]:
            break
        done.append(packed.filter(~loose).select(final))
        packed = again
    done.append(packed.select(final))
    out = done[0]
    for frame in done[1:]:
        out = out.unionByName(frame)
    return out


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    from pageloom.llm._util import read_table

    return pack(read_table(spark, sf_dir, "documents"))

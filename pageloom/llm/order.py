"""Training-order materialisation: token sequences at permuted global slots, in fixed-stride shards.

Documents are tokenised and cut into sequences of at most ``length`` ids. Sequences are numbered from 0 by (doc_id, piece);
a keyed Feistel permutation over the least even number of bits that holds all numbers, walked on until the value is in
range, gives every sequence its slot: a bijection of the numbers that needs no table. Slots are range-partitioned into
shards of ``per_shard`` records of equal stride, so slot s is record s % per_shard of shard s // per_shard, and a reader
resumes anywhere by arithmetic. Slots are dense, so a shard's range follows from its number. ``export`` writes ``per_file``
shards one after another into each file (256 MB with two-byte ids), by the same arithmetic.

Ids are two bytes wide where the vocabulary allows it, else four; records are padded with the end id, and each shard names
its records' documents, pieces and lengths. Token ids move compressed. Token rows are written once, before numbering, so a
lost task neither tokenises again nor changes a number.

Null text is an empty text (one sequence, the end id). Null ids come first; rows of equal doc_id are numbered in the order
of a hash of their text, fully repeated rows one after another. An empty table gives no shards. Other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm import tokens
from pageloom.llm._util import arrow_batch, keyed, materialize, read_table, slices
from pageloom.llm.packing import cut_pieces

LENGTH, PER_SHARD, ROUNDS = 1024, 256, 6
PER_FILE, RANGE_BYTES = 512, 64 << 20
_LONG = T.LongType()
IDS = T.StructType([T.StructField("k", _LONG), T.StructField("h", _LONG), T.StructField("n", _LONG), T.StructField("ids", T.BinaryType())])
NUMBERED = T.StructType([T.StructField("row", _LONG), T.StructField("part", T.IntegerType()), T.StructField("run", _LONG), T.StructField("pieces", _LONG)])
SEQUENCES = T.StructType([T.StructField("slot", _LONG), T.StructField("shard", _LONG), T.StructField("doc_id", _LONG), T.StructField("piece", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("ids", T.BinaryType())])
SHARDS = T.StructType(
    [T.StructField("shard", _LONG), T.StructField("first_slot", _LONG), T.StructField("records", T.IntegerType()), T.StructField("stride", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("crc32", _LONG)]
    + [T.StructField("doc_id", T.ArrayType(_LONG)), T.StructField("piece", T.ArrayType(T.IntegerType())), T.StructField("length", T.ArrayType(T.IntegerType())), T.StructField("data", T.BinaryType())]
)
RECORDS = T.StructType([T.StructField("slot", _LONG), T.StructField("shard", _LONG), T.StructField("offset", _LONG), T.StructField("doc_id", _LONG), T.StructField("piece", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("ids_crc32", _LONG)])


class Permutation:
    """A keyed bijection of range(n): a balanced Feistel network, walked along its cycle until the value is below n."""

    def __init__(self, n: int, key: int):
        self.n, self.half = n, max(1, -(-max(n - 1, 1).bit_length() // 2))
        self.keys = np.random.default_rng(key).integers(0, 1 << 63, ROUNDS, dtype=np.uint64)

    def _round(self, right: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (right ^ key) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(32))) & np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & np.uint64((1 << self.half) - 1)
        for key in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ self._round(left, key), left
            else:
                left, right = right, left ^ self._round(right, key)
        return left << np.uint64(self.half) | right

    def _walk(self, x, back: bool) -> np.ndarray:
        out = self._once(np.atleast_1d(np.asarray(x, np.uint64)), back)
        far = np.flatnonzero(out >= self.n)
        while len(far):
            out[far] = self._once(out[far], back)
            far = far[out[far] >= self.n]
        return out.astype(np.int64)

    def slots(self, numbers) -> np.ndarray:
        return self._walk(numbers, False)

    def numbers(self, slots) -> np.ndarray:
        return self._walk(slots, True)


def id_width(n_ids: int) -> int:
    """Bytes of an id."""
    return 2 if n_ids <= 1 << 16 else 4


def _tokenised(docs: DataFrame, vocabulary: str, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, press = tokens.encoder(vocabulary), zstandard.ZstdCompressor(level=3)
        for part in slices(batches):
            ids = [np.array([*enc.ids(t), tokens.EOS], f"<u{width}") for t in part.column(2).to_pylist()]
            yield arrow_batch(IDS, [part.column(0), part.column(1), [len(x) for x in ids], [press.compress(x.tobytes()) for x in ids]])

    return docs.mapInArrow(run, IDS)


def numbered(rows: DataFrame, length: int) -> tuple[DataFrame, int]:
    """row, first (number of its first sequence) in the order of (k, h, row), and the count of all sequences.

    One sum per range reaches the driver."""
    pieces = F.ceil(F.col("n") / length).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            n = np.asarray(batch.column(2))
            ends = total + np.cumsum(n)
            yield arrow_batch(NUMBERED, [batch.column(0), batch.column(1), ends - n, n])
            total = int(ends[-1]) if len(ends) else total

    ranged = rows.select("k", "h", "row", pieces.alias("pieces")).repartitionByRange("k", "h", "row").sortWithinPartitions("k", "h", "row")
    runs = materialize(ranged.select("row", F.spark_partition_id().alias("part"), "pieces").mapInArrow(run, NUMBERED))
    sums = sorted((r["part"], r["n"]) for r in runs.groupBy("part").agg(F.sum("pieces").alias("n")).collect())
    before = np.concatenate([[0], np.cumsum([n for _, n in sums], dtype=np.int64)])
    bases = rows.sparkSession.createDataFrame([(p, int(b)) for (p, _), b in zip(sums, before, strict=False)], "part int, base long")
    return runs.join(F.broadcast(bases), "part").select("row", (F.col("base") + F.col("run")).alias("first")), int(before[-1])


def shards(docs: DataFrame, key: int = 0, length: int = LENGTH, per_shard: int = PER_SHARD, vocabulary: str | None = None, together: int = 1) -> DataFrame:
    """One row per shard: shard, first_slot, records, stride and width (bytes of a record and of an id), crc32 of data, the
    records' doc_id, piece and length, data. Partitions hold shards in order, and so many together (see export) whole."""
    vocabulary = vocabulary or tokens.default_vocabulary()
    width = id_width(max(len(tokens.encoder(vocabulary).spaced), tokens.EOS + 1))
    made = materialize(_tokenised(keyed(docs), vocabulary, width).withColumn("row", F.monotonically_increasing_id()))
    firsts, total = numbered(made, length)
    order = Permutation(total, key)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, unpress = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        for part in slices(batches, "ids"):
            doc, piece, size, numbers, data = [], [], [], [], []
            for k, n, raw, first in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                ids = unpress.decompress(raw)
                for p, (start, m) in enumerate(cut_pieces(n, length)):
                    doc.append(None if k == -(1 << 63) else k)
                    piece.append(p)
                    size.append(m)
                    numbers.append(first + p)
                    data.append(press.compress(ids[start * width : (start + m) * width]))
            slots = order.slots(numbers)
            yield arrow_batch(SEQUENCES, [slots, slots // per_shard, doc, piece, size, data])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress, stride, held, at = zstandard.ZstdDecompressor(), length * width, [], None

        def shard() -> pa.RecordBatch:
            pad = np.array([tokens.EOS], f"<u{width}").tobytes()
            data = b"".join(raw + pad * ((stride - len(raw)) // width) for raw in (unpress.decompress(r[5]) for r in held))
            return arrow_batch(SHARDS, [[at], [held[0][0]], [len(held)], [stride], [width], [zlib.crc32(data)], [[r[2] for r in held]], [[r[3] for r in held]], [[r[4] for r in held]], [data]])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if row[1] != at and held:
                    yield shard()
                    held = []
                at = row[1]
                held.append(row)
        if held:
            yield shard()

    placed = made.join(firsts, "row").select("k", "n", "ids", "first").mapInArrow(place, SEQUENCES)
    units = max(1, -(-total // (per_shard * together)))
    ranges = min(units, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total * length * width // RANGE_BYTES))
    at = F.floor(F.floor(F.col("shard") / together) * ranges / units).cast("int")
    return placed.repartitionById(ranges, at).sortWithinPartitions("slot").mapInArrow(fill, SHARDS)


def records(made: DataFrame, first_slot: int = 0) -> DataFrame:
    """slot, shard, offset (bytes within the shard's data), doc_id, piece, length and ids_crc32 (unsigned, of the ids as
    little-endian unsigned 32-bit) of every record from first_slot on, read from the shards' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                stride, width, out = row["stride"], row["width"], []
                whole = np.frombuffer(row["data"], np.uint8)
                for i, (doc, piece, n) in enumerate(zip(row["doc_id"], row["piece"], row["length"], strict=True)):
                    slot = row["first_slot"] + i
                    if slot >= first_slot:
                        ids = whole[i * stride : i * stride + n * width].view(f"<u{width}").astype("<u4")
                        out.append((slot, row["shard"], i * stride, doc, piece, n, zlib.crc32(ids.tobytes())))
                if out:
                    yield arrow_batch(RECORDS, list(map(list, zip(*out, strict=True))))

    return made.filter(F.col("first_slot") + F.col("records") > first_slot).mapInArrow(run, RECORDS)


def export(made: DataFrame, folder: str, per_file: int = PER_FILE) -> int:
    """Write per_file shards after another to each <folder>/shards-<number>.bin on a file system that all executors mount;
    returns the number of files. made comes from shards(..., together=per_file), so that a file's shards are in one task.

    A file appears whole or not at all, and one that is there in full stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, at, part, out = 0, None, "", None

        def close() -> None:
            if out is not None:
                size = out.tell()
                out.close()
                path = f"{folder}/shards-{at // per_file:08d}.bin"
                if os.path.exists(path) and os.path.getsize(path) == size:
                    os.remove(part)
                else:
                    os.replace(part, path)

        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at is None or shard // per_file != at // per_file:
                    close()
                    if shard % per_file:
                        raise ValueError("a file's shards lie in several partitions: make them with together=per_file")
                    part, n = f"{folder}/shards-{shard // per_file:08d}.bin.{os.getpid()}.part", n + 1
                    out = open(part, "wb")  # noqa: SIM115 - closed when the next file begins
                out.write(data)
                at = shard
        close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return made.select("shard", "data").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def op4_training_order(spark, sf_dir: str) -> DataFrame:
    return records(shards(read_table(spark, sf_dir, "documents"), key=20240607))

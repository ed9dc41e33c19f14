"""SimHash document fingerprints and the search for all fingerprints within a Hamming radius.

Terms are runs of ``words`` consecutive words (fewer words: the whole text), weighted by 1 + ln(count); each term's hash
votes +weight or -weight on every bit, and a bit is set where the votes are positive. ``near_fingerprints`` finds all pairs
within a radius by permuted block tables, ``near_counts`` how many rows are near each fingerprint: bits are cut into blocks,
each table leads with another choice of blocks, and fingerprints within the radius agree on the leading blocks of some table.

Null text is an empty text, whose fingerprint has no bit set. Rows of equal doc_id follow each other in the order of their
text; null ids come last. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm._util import arrow_batch, id_and_text, materialize, read_table, slices

BITS, WORDS = 256, 5
CACHE = 300_000
_LANES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)  # fixed values: odd multipliers
EDITED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)

KEYS = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("print", T.BinaryType()), T.StructField("copies", T.LongType())])
RUNS = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("no", T.IntegerType()), T.StructField("prints", T.BinaryType()), T.StructField("copies", T.BinaryType())])
PAIRS = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("distance", T.IntegerType())])
NEAR = T.StructType([T.StructField("print", T.BinaryType()), T.StructField("n_near", T.LongType())])

RANGES, PER_RANGE = 1 << 16, 20
RADIUS, HELD, SALTS = 7, 2048, 16


class WordHashes(dict):
    """64-bit hashes of words; kept between texts up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def term_hashes(text: str, known: WordHashes, words: int = WORDS) -> np.ndarray:
    """A hash of each run of words, repeats included."""
    each = np.fromiter(map(known.__getitem__, text.lower().split()), dtype=np.uint64)
    n = max(1, len(each) - words + 1) if len(each) else 0
    total = np.zeros(n, np.uint64)
    for k in range(min(words, len(each))):
        total = _mix(total + each[k : k + n] * _LANES[0] + np.uint64(k))
    return total


def fingerprint(text: str, known: WordHashes | None = None, words: int = WORDS) -> np.ndarray:
    """BITS bits as 32 bytes; a function of the text alone."""
    terms, counts = np.unique(term_hashes(text, WordHashes() if known is None else known, words), return_counts=True)
    votes = np.zeros(BITS)
    for a in range(0, len(terms), 4096):
        lanes = _mix(terms[a : a + 4096, None] * _LANES[None, :])
        signs = np.unpackbits(lanes.view(np.uint8), axis=1)
        weight = 1 + np.log(counts[a : a + 4096])
        votes += 2 * (weight @ signs) - weight.sum()
    return np.packbits(votes > 0)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal bits."""
    return 1 - int(np.unpackbits(a ^ b).sum()) / BITS


def edited(text: str, other: str) -> str:
    """text with its last floor(n/2) code points replaced by other's first as many, or all of other."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _next_by_descending_id(docs: DataFrame, part_bytes: int) -> DataFrame:
    """Ranges of doc_id in descending order, each with a copy of the row that follows its last one (of the whole: the first).

    Columns doc_id, text, part, copy. The ranges hold about part_bytes of text and are RANGES at most; their bounds are quantiles
    of PER_RANGE ids a range, chosen by a hash. Those ids, and one id a range, are all that reaches the driver or is broadcast.
    Ranges are found by binary search, so their number doesn't slow the rows."""
    from pyspark.ml.feature import Bucketizer

    rows = docs.withColumn("k", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size")).first()
    parts = max(1, min(-(-(stats["size"] or 0) // part_bytes), stats["n"], RANGES))
    bounds = []
    if parts > 1:
        least = -(1 << 63) + min((1 << 64) - 1, (1 << 64) * PER_RANGE * parts // stats["n"])
        ids = np.sort(np.asarray(rows.filter(F.xxhash64("k") <= least).select("k").toArrow()["k"]))
        bounds = [ids[len(ids) * i // parts] for i in range(1, parts)] if len(ids) else []
    splits = [float("-inf"), *(sorted({float(b) for b in bounds}) or [0.0]), float("inf")]
    rows = Bucketizer(splits=splits, inputCol="v", outputCol="b").transform(rows.withColumn("v", F.col("k").cast("double"))).withColumn("part", F.col("b").cast("int")).drop("v", "b")
    tops = sorted((r["part"], r["top"]) for r in rows.select("part", "k").groupBy("part").agg(F.max("k").alias("top")).collect())
    # the row after a range's last is the first of the next lower range; the lowest range goes on with the highest
    follows = [(tops[i - 1][1], part) for i, (part, _) in enumerate(tops)]
    given = docs.sparkSession.createDataFrame(follows, "k long, part int")
    copies = rows.drop("part").join(F.broadcast(given), "k").select("doc_id", "text", "k", "part", F.lit(True).alias("copy"))
    both = rows.select("doc_id", "text", "k", "part", F.lit(False).alias("copy")).unionByName(copies)
    return both.repartition(len(splits) - 1, "part").sortWithinPartitions("part", "copy", F.col("k").desc(), "text").drop("k")


def fingerprint_edits(docs: DataFrame, part_bytes: int = 4 << 20) -> DataFrame:
    """Fingerprints of every text and of its edited text (see ``edited``; the other text is the next row's by descending
    doc_id, after the last the first), and the likeness of the text's fingerprint to those of the edited and the next text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in slices(batches):
            yield from zip(*(part.column(i).to_pylist() for i in range(4)), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, out, held, closed = WordHashes(), [], None, None
        for doc_id, text, part, copy in rows(batches):
            if part == closed:  # further rows of the copied id: the first was the next one
                continue
            own = fingerprint(text, known)
            if held is not None and held[0] == part:
                _, before, old, mark = held
                new = edited(old, text)
                changed = fingerprint(new, known)
                out.append((before, len(old), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), mark.tobytes().hex(), changed.tobytes().hex(), likeness(mark, changed), likeness(mark, own)))
            held, closed = ((part, doc_id, text, own), None) if not copy else (None, part)
            if len(out) >= 2000:
                yield arrow_batch(EDITED, list(zip(*out, strict=True)))
                out = []
        if out:
            yield arrow_batch(EDITED, list(zip(*out, strict=True)))

    return _next_by_descending_id(id_and_text(docs), part_bytes).mapInArrow(run, EDITED)


def _table_keys(cut: np.ndarray, edges: list[int], lead: list[tuple[int, ...]]) -> Iterator[list[bytes]]:
    """For each table the keys of fingerprints given as rows of bits: the table's number and its leading blocks."""
    for t, chosen in enumerate(lead):
        picked = np.packbits(np.concatenate([cut[:, edges[c] : edges[c + 1]] for c in chosen], axis=1), axis=1)
        yield [t.to_bytes(2, "little") + p.tobytes() for p in picked]


def _close(a: np.ndarray, b: np.ndarray, table: int, same: bool, radius: int, edges: list[int], lead: list[tuple[int, ...]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a and b (packed bits) within the radius and their distance, of pairs whose first table is this one."""
    lanes_a, lanes_b = a.view(np.uint32), b.view(np.uint32)
    for at in range(0, len(a), 64):
        apart = np.bitwise_count(lanes_a[at : at + 64, None] ^ lanes_b[None]).sum(2, dtype=np.int32)
        i, j = np.nonzero(apart <= radius)
        distance = apart[i, j]
        i += at
        if same:
            keep = i < j
            i, j, distance = i[keep], j[keep], distance[keep]
        if len(i):
            cut = np.unpackbits(a[i] ^ b[j], axis=1)
            equal = np.stack([~cut[:, lo:hi].any(axis=1) for lo, hi in zip(edges, edges[1:], strict=False)], axis=1)
            chosen = np.zeros(equal.shape[1], bool)
            chosen[list(lead[table])] = True
            first = equal & (np.cumsum(equal, axis=1) <= len(lead[table]))  # the first table is that of the first equal blocks
            keep = (first == chosen).all(axis=1)
            i, j, distance = i[keep], j[keep], distance[keep]
        if len(i):
            yield i, j, distance


def _settled(prints: DataFrame, radius: int, blocks: int, bits: int, held: int, found: T.StructType, tell) -> DataFrame:
    """What tell(left, right, pairs) yields for all close pairs of prints (print binary, copies long), each pair once.

    A bucket, the fingerprints of one key, is cut into runs of at most held; runs are compared with themselves and with each
    other run of their bucket, in tasks of their own. Only one run is held at a time, or two."""
    if blocks <= radius or held < 2:
        raise ValueError("more blocks than the radius and runs of two or more are needed")
    edges = [bits * i // blocks for i in range(blocks + 1)]
    lead = list(combinations(range(blocks), blocks - radius))
    size = bits // 8

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cut = np.unpackbits(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, size), axis=1)
                for keys in _table_keys(cut, edges, lead):
                    yield arrow_batch(KEYS, [keys, batch.column(0), batch.column(1)])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, no, some, copies, out = None, 0, [], [], []
        for batch in batches:
            for k, mark, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key or len(some) == held:
                    if len(some) > 1 or no:
                        out.append((key, no, b"".join(some), np.array(copies, np.int64).tobytes()))
                    key, no, some, copies = k, no + 1 if k == key else 0, [], []
                some.append(mark)
                copies.append(n)
                if len(out) >= 64:
                    yield arrow_batch(RUNS, list(zip(*out, strict=True)))
                    out = []
        if len(some) > 1 or no:
            out.append((key, no, b"".join(some), np.array(copies, np.int64).tobytes()))
        if out:
            yield arrow_batch(RUNS, list(zip(*out, strict=True)))

    def unpack(marks: bytes, copies: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(marks, np.uint8).reshape(-1, size), np.frombuffer(copies, np.int64)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, marks, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one = unpack(marks, copies)
                for told in tell(one, one, _close(one[0], one[0], int.from_bytes(key[:2], "little"), True, radius, edges, lead)):
                    yield arrow_batch(found, told)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, marks, copies, others, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one, two = unpack(marks, copies), unpack(others, more)
                for told in tell(one, two, _close(one[0], two[0], int.from_bytes(key[:2], "little"), False, radius, edges, lead)):
                    yield arrow_batch(found, told)

    cut = materialize(prints.mapInArrow(spread, KEYS).repartition("key").sortWithinPartitions("key").mapInArrow(runs, RUNS))
    whole = cut.select("key", "prints", "copies").mapInArrow(within, found)
    a = cut.select("key", "no", "prints", "copies")
    b = cut.filter("no > 0").select("key", F.col("no").alias("other"), F.col("prints").alias("others"), F.col("copies").alias("more"))
    pairs = a.join(b.hint("merge"), "key").filter("no < other").repartition(F.col("key"), "no", "other").select("key", "prints", "copies", "others", "more")
    return whole.unionByName(pairs.mapInArrow(across, found))


def near_fingerprints(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None, bits: int = BITS, held: int = HELD) -> DataFrame:
    """All pairs (a, b) with a < b of distinct hex fingerprints at most radius bits apart, and their distance.

    prints: a column ``fingerprint``. One table per choice of blocks - radius leading blocks (radius + 1 blocks by default,
    so one leads); fingerprints of equal keys of a table are compared, and a pair comes from the first table that has it.
    Copies are one row, nulls none."""

    def tell(one, two, close):
        for i, j, distance in close:
            a, b = ([x[0][r].tobytes().hex() for r in rows] for x, rows in ((one, i), (two, j)))
            yield [list(map(min, a, b)), list(map(max, a, b)), distance]

    given = prints.select(F.unhex("fingerprint").alias("print")).filter(F.col("print").isNotNull()).distinct().withColumn("copies", F.lit(1).cast("long"))
    return _settled(given, radius, blocks or radius + 1, bits, held, PAIRS, tell)


def near_counts(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None, bits: int = BITS, held: int = HELD) -> DataFrame:
    """print, n_near of each distinct binary fingerprint in prints that more than one row is near to: the number of rows whose
    fingerprint is at most radius bits apart, the row itself left out. No pair leaves the task that compares it."""

    def tell(one, two, close):
        left, right = (np.zeros(len(x[1]), np.int64) for x in (one, two))
        for i, j, _ in close:
            np.add.at(left, i, two[1][j])
            np.add.at(right, j, one[1][i])
        for (marks, _), total in ((one, left), (two, right)):
            seen = np.flatnonzero(total)
            if len(seen):
                yield [[marks[r].tobytes() for r in seen], total[seen]]

    own = prints.groupBy("print").agg(F.count(F.lit(1)).alias("copies"))
    more = _settled(own, radius, blocks or radius + 1, bits, held, NEAR, tell)
    each = own.filter("copies > 1").select("print", (F.col("copies") - 1).alias("n_near")).unionByName(more)
    return each.groupBy("print").agg(F.sum("n_near").alias("n_near"))


def with_near_counts(found: DataFrame, radius: int = RADIUS) -> DataFrame:
    """found with n_near, see ``near_counts``, of its column ``fingerprint``. Rows of one fingerprint are dealt to SALTS tasks.
    The counts grow with the documents, so they are shuffled and never broadcast."""
    counts = near_counts(found.select(F.unhex("fingerprint").alias("print")), radius)
    counts = counts.select(F.lower(F.hex("print")).alias("fingerprint"), "n_near", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "edited_sha256"), F.lit(SALTS)).cast("int"))
    return salted.join(counts.hint("merge"), ["fingerprint", "salt"], "left").select(*found.columns, F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    return with_near_counts(materialize(fingerprint_edits(read_table(spark, sf_dir, "documents"))))

"""Suffix-array dedup: remove every byte that a ``length``-byte string covers which also starts earlier in the corpus.

Texts are UTF-8 bytes; "earlier" is the order of (doc_id, start); strings never cross documents and are judged on the input.

1. Anchors. Of the ``gram``-byte grams in each ``length``-byte string the one with the least hash is its anchor, so equal
   strings have equal anchors at equal places. Consecutive strings of one anchor form a segment, cut in two so that all
   strings of a part share over half their bytes with it: those before the anchor, or those after. Only a row per segment
   (hashes and offsets) is shuffled, by these shared bytes. A segment whose bytes occur earlier is repeated as a whole; of
   the others, only those whose shared bytes another segment has too can hold a repeated string.
2. Suffix order. Those contested segments bring their bytes. A task sorts the suffixes that start a string (prefix doubling
   up to ``length`` bytes) and finds for each the previous and next smaller text position in suffix order. These two give the
   longest previous factor; where it reaches ``length``, the string starts earlier too.
3. Shared bytes of over ``most_segments`` contested segments (a phrase in very many contexts) don't go to one task: their
   strings are dealt out by a 128-bit digest and ranked there.

Within each slice of texts copies of a segment are settled before the shuffle, so a passage that many documents share
reaches it about once a slice. Segments are compared by 128 bits of two independent hashes.

Null text is an empty text; null ids come first. Rows of one doc_id with different texts are ordered by a hash of the text,
and fully repeated rows count as one document and all get its result. Empty tables give empty results; other columns are
not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from pageloom.llm._util import arrow_batch, keyed, materialize, read_table, slices

LENGTH, GRAM = 100, 16
BLOCK = 1 << 20
_PLACE = np.uint64((1 << 24) - 1)
_LONG, _INT = T.LongType(), T.IntegerType()
SEGMENTS = T.StructType([T.StructField(n, _LONG) for n in ("g", "s", "k", "h")] + [T.StructField("lo", _INT), T.StructField("n", _INT), T.StructField("whole", T.BooleanType())])
BYTES = T.StructType([T.StructField(n, _LONG) for n in ("g", "k", "h")] + [T.StructField("lo", _INT), T.StructField("n", _INT), T.StructField("bytes", T.BinaryType())])
SPANS = T.StructType([T.StructField("k", _LONG), T.StructField("h", _LONG), T.StructField("start", _INT), T.StructField("end", _INT)])
STRINGS = T.StructType([T.StructField(n, _LONG) for n in ("w1", "w2", "k", "h")] + [T.StructField("start", _INT), T.StructField("lost", T.BooleanType())])
RESULT = T.StructType([T.StructField("doc_id", _LONG), T.StructField("n_bytes", _LONG), T.StructField("n_removed", _LONG), T.StructField("n_spans", _LONG), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())])


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Two tables of random 64-bit values of a byte."""
    rng = np.random.default_rng(20240607)
    return tuple(rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # fixed values: odd multipliers


def rolling(data: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """64-bit hashes of all runs of width bytes, by doubling the run; len(data) - width + 1 of them."""
    parts, total, done = _tables()[which][data], None, 0
    power, size, base = parts, 1, _BASES[which]
    while True:
        if width & size:
            ahead = power[done : len(data) - width + done + 1]
            total = ahead.copy() if total is None else total * np.uint64(pow(base, size, 1 << 64)) + ahead
            done += size
        if done == width:
            return _mix(total)
        n = len(power) - size
        power = power[:n] * np.uint64(pow(base, size, 1 << 64)) + power[size:]
        size *= 2


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def segments(data: np.ndarray, starts: np.ndarray, length: int, gram: int):
    """g, s (hashes of what a segment's strings share and of the whole segment), document, lo and n (first string, number of strings).

    data: the documents' bytes one after another; starts: their bounds."""
    sizes = np.diff(starts)
    if len(data) < length:
        return [np.empty(0, np.uint64)] * 2 + [np.empty(0, np.int64)] * 3
    grams = rolling(data, gram)
    order = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_sliding_min(order, length - gram + 1) & _PLACE).astype(np.int64)
    own = np.zeros(len(data) + 1, np.int8)  # where a string fits into its document
    fits = sizes >= length
    np.add.at(own, starts[:-1][fits], 1)
    np.add.at(own, starts[1:][fits] - length + 1, -1)
    inside = np.cumsum(own[: len(anchor)]).astype(bool)
    new = np.ones(len(anchor), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    new[starts[:-1][starts[:-1] < len(anchor)]] = True
    new[1:] |= inside[1:] != inside[:-1]
    lo = np.flatnonzero(new)
    n = np.diff(np.append(lo, len(anchor)))
    keep = inside[lo]
    lo, n = lo[keep], n[keep]
    # strings that begin well before their anchor have what precedes it in common, the others what follows it
    half = (length - gram) // 2
    at, hi = anchor[lo], lo + n - 1
    early = np.minimum(hi, at - half - 1)
    late = np.maximum(lo, at - half)
    has_early, has_late = early >= lo, late <= hi
    lo, hi = np.concatenate([lo[has_early], late[has_late]]), np.concatenate([early[has_early], hi[has_late]])
    at = np.concatenate([at[has_early], at[has_late]])
    is_late = np.arange(len(lo)) >= has_early.sum()
    shared = np.where(is_late, at, at - half - 1), np.where(is_late, at + length - half, at + gram)
    windows = _windows(data)
    key = _mix(_span_hashes(windows, 0, *shared) + is_late.astype(np.uint64))
    end = hi + length
    whole = _mix(_span_hashes(windows, 1, lo, end) + (end - lo).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    doc = np.searchsorted(starts, lo, side="right") - 1
    return key, whole, doc, lo - starts[doc], hi - lo + 1


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of a base and of its inverse, kept between slices."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        base = np.full(n + n // 4, _BASES[which], np.uint64), np.full(n + n // 4, pow(_BASES[which], -1, 1 << 64), np.uint64)
        for x in base:
            x[0] = 1
        _POWERS[which] = np.cumprod(base[0]), np.cumprod(base[1])
    return _POWERS[which]


def _windows(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number."""
    x = data.astype(np.uint64)
    for n in (1, 2, 4):
        x = x[:-n] | x[n:] << np.uint64(8 * n)
    return x


def _span_hashes(windows: np.ndarray, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes start to end (8 at least), alike for equal bytes wherever they are: of the windows within, each mixed
    by itself before they are added up with powers, so that no arrangement of bytes cancels out. The two mix differently."""
    powers, inverse = _powers(which, len(windows) + 1)
    prefix = np.zeros(len(windows) + 1, np.uint64)
    np.cumsum(_mix(windows ^ _tables()[which][0]) * powers[: len(windows)], out=prefix[1:])
    return (prefix[end - 7] - prefix[start]) * inverse[start]


def _blocks(part: pa.RecordBatch, length: int) -> Iterator[tuple]:
    """(k, h, at, bytes, starts) of whole documents together, or of a long document's overlapping blocks; at: where a block starts."""
    texts = [t.encode("utf-8", "surrogatepass") for t in part.column(2).to_pylist()]
    keys = np.asarray(part.column(0)), np.asarray(part.column(1))
    long = [i for i, t in enumerate(texts) if len(t) > BLOCK]
    rest = [i for i in range(len(texts)) if i not in set(long)]
    if rest:
        joined = np.frombuffer(b"".join(texts[i] for i in rest), np.uint8)
        yield keys[0][rest], keys[1][rest], 0, joined, np.concatenate([[0], np.cumsum([len(texts[i]) for i in rest])]).astype(np.int64)
    for i in long:
        for at in range(0, len(texts[i]) - length + 1, BLOCK):
            data = np.frombuffer(texts[i], np.uint8)[at : at + BLOCK + length - 1]
            yield keys[0][[i]], keys[1][[i]], at, data, np.array([0, len(data)])


def _all_segments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most_bytes=BLOCK):
            for k, h, at, data, starts in _blocks(part, length):
                g, s, doc, lo, n = segments(data, starts, length, gram)
                kk, hh, lo = k[doc], h[doc], lo + at
                order = np.lexsort((lo, hh, kk, s, g))
                g, s, kk, hh, lo, n = (x[order] for x in (g, s, kk, hh, lo, n))
                whole = np.zeros(len(g), bool)  # an earlier copy is in this slice
                whole[1:] = (g[1:] == g[:-1]) & (s[1:] == s[:-1])
                same = np.zeros(len(g), bool)  # the very same segment of a repeated row
                same[1:] = whole[1:] & (kk[1:] == kk[:-1]) & (hh[1:] == hh[:-1]) & (lo[1:] == lo[:-1])
                keep = ~same
                yield arrow_batch(SEGMENTS, [x[keep] for x in (g.view(np.int64), s.view(np.int64), kk, hh, lo.astype(np.int32), n.astype(np.int32), whole)])

    return docs.mapInArrow(run, SEGMENTS)


def _smaller(position: np.ndarray) -> np.ndarray:
    """Index of the previous element that is smaller, -1 if none, by jumping over larger ones."""
    at = np.arange(-1, len(position) - 1)
    going = np.flatnonzero(at >= 0)
    while len(going):
        going = going[position[at[going]] > position[going]]
        at[going] = at[at[going]]
        going = going[at[going] >= 0]
    return at


def longest_previous(data: np.ndarray, begin: np.ndarray, position: np.ndarray, length: int) -> np.ndarray:
    """For each string data[begin:begin+length], whether its longest previous factor reaches length.

    position: the strings' places in the corpus, distinct. data ends with length spare bytes."""
    size = 8
    packed = np.zeros(len(data), np.uint64)
    for i in range(size):
        packed[: len(data) - i] = (packed[: len(data) - i] << np.uint64(8)) | data[i:]
        if i and len(data) - i < len(data):
            packed[len(data) - i :] <<= np.uint64(8)
    rank = np.unique(packed, return_inverse=True)[1].astype(np.int64)
    while size * 2 <= length:
        pair = np.full(len(data), -1, np.int64)
        pair[: len(data) - size] = rank[: len(data) - size] * len(data) + rank[size:]
        rank, size = np.unique(pair, return_inverse=True)[1].astype(np.int64), size * 2
    if size < length:
        rank = np.unique(rank[begin] * len(data) + rank[begin + length - size], return_inverse=True)[1]
    else:
        rank = rank[begin]
    suffixes = np.argsort(rank, kind="stable")
    rank, place = rank[suffixes], position[suffixes]
    before = _smaller(place)
    after = len(place) - 1 - _smaller(place[::-1])[::-1]
    found = (before >= 0) & (rank[np.maximum(before, 0)] == rank)
    after_in = after < len(place)
    found |= after_in & (rank[np.minimum(after, len(place) - 1)] == rank)
    out = np.empty(len(place), bool)
    out[suffixes] = found
    return out


def _runs(flags: np.ndarray, n: np.ndarray, lo: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start, end) of the runs of flagged strings; flags: n[i] for each segment i, one after another."""
    first = np.concatenate([[0], np.cumsum(n)])
    segment = np.repeat(np.arange(len(n)), n)
    edge = np.ones(len(flags), bool)
    edge[1:] = ~flags[:-1] | (segment[1:] != segment[:-1])
    begins = np.flatnonzero(flags & edge)
    last = np.ones(len(flags), bool)
    last[:-1] = ~flags[1:] | (segment[1:] != segment[:-1])
    ends = np.flatnonzero(flags & last)
    s = segment[begins]
    return s, lo[s] + begins - first[s], lo[s] + ends - first[s] + length


def _spans_of(rows: list[tuple], length: int) -> pa.RecordBatch:
    """rows: (k, h, lo, n, bytes) of whole groups."""
    k, h, lo, n = (np.array([r[i] for r in rows], np.int64) for i in range(4))
    starts = np.concatenate([[0], np.cumsum([len(r[4]) for r in rows])])
    data = np.frombuffer(b"".join(r[4] for r in rows) + bytes(length), np.uint8)
    segment = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(segment)) - np.repeat(np.cumsum(n) - n, n)
    order = np.lexsort((within + lo[segment], h[segment], k[segment]))
    position = np.empty(len(order), np.int64)
    position[order] = np.arange(len(order))
    s, start, end = _runs(longest_previous(data, starts[segment] + within, position, length), n, lo, length)
    return arrow_batch(SPANS, [k[s], h[s], start.astype(np.int32), end.astype(np.int32)])


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_segments: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """Spans (k, h, start, end) of bytes to be removed, and the texts dealt by key that later joins share."""
    by_key = docs.select("k", "h", "text")
    # segments already known to be repeated are dealt out evenly and meet nobody
    deal = F.when(F.col("whole"), F.xxhash64("k", "h", "lo")).otherwise(F.col("g"))
    order = Window.partitionBy("deal", "s").orderBy("k", "h", "lo")
    group = Window.partitionBy("deal")
    dealt = _all_segments(by_key, length, gram).withColumn("deal", deal).drop("g").repartition("deal")
    ranked = dealt.withColumn("place", F.rank().over(order)).withColumn("contested", F.min("s").over(group) != F.max("s").over(group))
    judged = ranked.withColumn("whole", F.col("whole") | (F.col("place") > 1)).filter("whole OR contested").select(F.col("deal").alias("g"), "k", "h", "lo", "n", "whole")
    judged = materialize(judged)
    spans = judged.filter("whole").select("k", "h", F.col("lo").alias("start"), (F.col("lo") + F.col("n") + (length - 1)).cast("int").alias("end"))
    rest = judged.filter("NOT whole").select("g", "k", "h", "lo", "n").distinct()
    busy = rest.groupBy("g").count().filter(F.col("count") > most_segments).select("g")
    texts = by_key.repartition("k", "h")

    def with_bytes(wanted: DataFrame, run, schema: T.StructType) -> DataFrame:
        by_doc = wanted.groupBy("k", "h").agg(F.collect_list(F.struct("g", "lo", "n")).alias("wanted"))
        return texts.join(by_doc, ["k", "h"]).select("k", "h", "text", "wanted").mapInArrow(run, schema)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most_bytes=BLOCK):
            rows = []
            for k, h, text, wanted in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                rows += [(w["g"], k, h, w["lo"], w["n"], raw[w["lo"] : w["lo"] + w["n"] + length - 1]) for w in wanted]
            yield arrow_batch(BYTES, list(map(list, zip(*rows, strict=True))))

    def by_suffix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, g = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if row[0] != g and size > BLOCK // 2:
                    yield _spans_of(held, length)
                    held, size = [], 0
                g = row[0]
                held.append(row[1:])
                size += len(row[5])
        if held:
            yield _spans_of(held, length)

    if busy.limit(1).count():
        spans = spans.unionByName(_by_digest(with_bytes(rest.join(busy, "g", "left_semi"), functools.partial(_digests, length=length), STRINGS), length))
        rest = rest.join(busy, "g", "left_anti")
    found = with_bytes(rest, cut_out, BYTES).repartition("g").sortWithinPartitions("g").mapInArrow(by_suffix, SPANS)
    return spans.unionByName(found), texts


def _digests(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """128-bit digests of the wanted strings; copies within a slice are settled."""
    for part in slices(batches, most_bytes=BLOCK // 4):
        w1, w2, ks, hs, starts = [], [], [], [], []
        for k, h, text, wanted in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
            data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            for w in wanted:
                piece = data[w["lo"] : w["lo"] + w["n"] + length - 1]
                w1.append(rolling(piece, length, 0))
                w2.append(rolling(piece, length, 1))
                starts.append(w["lo"] + np.arange(w["n"]))
                ks.append(np.full(w["n"], k))
                hs.append(np.full(w["n"], h))
        a, b, k, h, start = (np.concatenate(x) for x in (w1, w2, ks, hs, starts))
        order = np.lexsort((start, h, k, b, a))
        a, b, k, h, start = (x[order] for x in (a, b, k, h, start))
        lost = np.zeros(len(a), bool)
        lost[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        yield arrow_batch(STRINGS, [a.view(np.int64), b.view(np.int64), k.astype(np.int64), h.astype(np.int64), start.astype(np.int32), lost])


def _by_digest(strings: DataFrame, length: int) -> DataFrame:
    strings = materialize(strings)
    later = strings.filter("NOT lost").withColumn("place", F.rank().over(Window.partitionBy("w1", "w2").orderBy("k", "h", "start"))).filter("place > 1")
    gone = strings.filter("lost").select("k", "h", "start").unionByName(later.select("k", "h", "start"))
    return gone.select("k", "h", "start", (F.col("start") + length).cast("int").alias("end"))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def dedup_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_segments: int = 20_000, keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (what is left, as binary; null without keep_bytes) of every row."""
    rows = keyed(docs)
    if rows.groupBy("k").count().filter("count > 1").limit(1).count() == 0:
        rows = rows.withColumn("h", F.lit(0).cast("long"))  # ids tell rows apart; the hash would only take room
    spans, texts = repeated_spans(rows, length, gram, most_segments)
    by_doc = spans.groupBy("k", "h").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most_bytes=BLOCK):
            out = []
            for k, text, found in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                runs = merge_spans([(s["start"], s["end"]) for s in found or ()])
                edges = [0, *(x for run in runs for x in run), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((None if k == -(1 << 63) else k, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None))
            yield arrow_batch(RESULT, list(map(list, zip(*out, strict=True))))

    return texts.join(by_doc, ["k", "h"], "left").select("k", "text", "spans").mapInArrow(run, RESULT)


def op2_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_bytes(read_table(spark, sf_dir, "documents"), keep_bytes=False).drop("kept")


OP2_SQL = """
WITH raw AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents
), numbered AS (
  SELECT doc_id, x, n_bytes, unnest(range(0, n_bytes, 100)) AS b FROM raw
), blocks AS (
  SELECT doc_id, n_bytes, b, substr(x, (2 * b + 1)::BIGINT, 400) AS piece FROM numbered
), windowed AS (
  SELECT doc_id, b + o AS p, substr(piece, (2 * o + 1)::BIGINT, 200) AS window_bytes
  FROM blocks, (SELECT unnest(range(0, 100)) AS o) WHERE b + o + 100 <= n_bytes
), ranked AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY window_bytes ORDER BY doc_id, p) > 1 AS again FROM windowed
), repeated AS (
  SELECT doc_id, p, p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, -1) AS fresh FROM ranked WHERE again
), runs AS (
  SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM repeated
), spans AS (
  SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM runs GROUP BY doc_id, run
), pieces AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans
), cut AS (
  SELECT s.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(x, (2 * before + 1)::BIGINT, (2 * (a - before))::BIGINT), '' ORDER BY a) AS kept, max(b) AS last
  FROM pieces s JOIN raw r ON r.doc_id = s.doc_id GROUP BY s.doc_id
)
SELECT r.doc_id, r.n_bytes::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(x, (2 * coalesce(last, 0) + 1)::BIGINT))) AS kept_sha256
FROM raw r LEFT JOIN cut c ON c.doc_id = r.doc_id
"""

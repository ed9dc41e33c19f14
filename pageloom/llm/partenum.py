"""N-gram Jaccard join by PartEnum signatures, and the connected components of its links.

A document's set holds the hashes of its distinct runs of ``WORDS`` words. Two sets link when their Jaccard likeness is at
least ``percent`` / 100.

Sizes are cut into bands; a set takes part in the band of its own size and in those of larger sets it may link with. In a
band whose sets have at most u elements, linked sets differ in at most k = floor(2 u (1 - j) / (1 + j)) elements. The feature
domain (the hash range) is cut into 4 k + 1 partitions, so linked sets agree wholly on at least 3 k + 1 of them. All sets rank
their partitions by one total order of (partition, content); the t heaviest partitions on which two linked sets agree are then
among the heaviest k + t of both (k as it follows from a set's own size, if that is less), so the subsets of t of these are a
set's signatures. Pairs (t = 2) are enumerated up to k = 4,
where they are few; single partitions above, k + 1 a band. Where k is 0, linked sets are equal and need no signature. The order
puts partitions with many infrequent features first; those that are empty or hold only features that a great many documents
share come last and are mostly left out: with so many partitions to choose from, sets that have only a passage in common
meet in few buckets. Frequent features come from counts over all documents;
they only order partitions and lose no pair.

Sets that share a signature form a bucket. Its pairs are not all made: parity sketches (whose Hamming distance never exceeds
the number of elements in which two sets differ) tell which of its sets can link at all, and the bucket gives a spanning set
of such pairs. Sets that can link, directly or through others, form a cluster; each set goes once to its cluster's task,
which counts common elements through an inverted index and gives a spanning set of links. Buckets of over ``BUCKET`` sets and
clusters of over ``CLUSTER`` are cut into blocks and treated by pairs of blocks, each in a task of its own. Every link rests on
both whole sets, so the components are those of all links.

Equal sets are one node throughout, named by 64 bits of a digest of the set. A second digest of 64 bits tells different sets
of one name apart; those (a handful in tens of billions) go by the second one.

Null, empty and blank texts have empty sets and link with nothing. Null ids count as the least id. Rows of one doc_id are
separate documents unless their texts agree. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm._util import arrow_batch, keyed, materialize, most_counted, read_table, slices
from pageloom.llm.graph import components

WORDS, PERCENT = 5, 80
CACHE = 200_000
FREQUENT, SEEN, PAIRED = 1 << 15, 3, 4
CLUSTER, BUCKET, SPOTS = 3000, 4000, 1 << 23
HELD, MOST_SHARED = 1 << 20, 10_000
_LONG = T.LongType()
MEMBERS = T.StructType([*(T.StructField(n, _LONG) for n in ("k", "h", "n", "id", "other")), T.StructField("sketch", T.BinaryType())])
SIGNED = T.StructType([T.StructField("sig", _LONG), T.StructField("id", _LONG)])
BUCKETS = T.StructType([T.StructField(n, _LONG) for n in ("sig", "block", "id")])
SETS = T.StructType([T.StructField("id", _LONG), T.StructField("set", T.BinaryType())])
KEYED_SETS = T.StructType([T.StructField("k", _LONG), T.StructField("h", _LONG), *SETS.fields])
PAIRS = T.StructType([T.StructField("a", _LONG), T.StructField("b", _LONG)])


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str, known: WordHashes) -> np.ndarray:
    """The sorted hashes of the text's distinct word runs; only A-Z are lower-cased, only ASCII white space separates."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(WORDS, len(each))
    n = len(each) - width + 1
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += each[i : i + n]
    total = np.sort(_mix(total))
    return total[np.append(True, total[1:] != total[:-1])]


def _digest(hashes: np.ndarray, seed: int) -> int:
    h = xxhash.xxh3_64_intdigest(hashes.tobytes(), seed)
    return h - (1 << 64) if h >> 63 else h


def set_id(hashes: np.ndarray, shared: frozenset[int] = frozenset()) -> int:
    """64 bits of the set's digest, signed; of another digest where the first is one of those that different sets share."""
    h = _digest(hashes, 0)
    return _digest(hashes, 1) if h in shared else h


def _bands() -> tuple[np.ndarray, np.ndarray]:
    least = [1]
    while least[-1] < 1 << 40:
        least.append(max(least[-1] + 1, least[-1] * 3 // 2))
    return np.array(least[:-1]), np.array(least[1:]) - 1


LEAST, MOST = _bands()


def signatures(hashes: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The set's signatures over all bands it takes part in."""
    own = np.searchsorted(LEAST, len(hashes), side="right") - 1
    last = np.searchsorted(LEAST, len(hashes) * 100 // percent, side="right") - 1
    total = np.concatenate([[np.uint64(0)], np.cumsum(_mix(hashes + np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)])
    at = np.searchsorted(frequent, hashes)
    rare = np.ones(len(hashes), np.int64) if not len(frequent) else (frequent[np.minimum(at, len(frequent) - 1)] != hashes).astype(np.int64)
    rare = np.concatenate([[0], np.cumsum(rare)])
    high, found = hashes >> np.uint64(32), []
    for band in range(own, last + 1):
        k = int(2 * MOST[band] * (100 - percent) // (100 + percent))
        if not k:
            continue
        m, t = 4 * k + 1, 2 if k <= PAIRED else 1
        # no set that links with this one differs in more
        own_k = int((len(hashes) + min(MOST[band], len(hashes) * 100 // percent)) * (100 - percent) // (100 + percent))
        cuts = np.concatenate([[0], np.searchsorted((high * np.uint64(m)) >> np.uint64(32), np.arange(1, m, dtype=np.uint64)), [len(hashes)]])
        content = _mix(total[cuts[1:]] - total[cuts[:-1]] + np.arange(m, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(band))
        weight = (np.minimum(rare[cuts[1:]] - rare[cuts[:-1]], 255) << 8) + np.minimum(np.diff(cuts), 255)
        rank = (weight.astype(np.uint64) << np.uint64(47)) | (content >> np.uint64(17))  # a partition's own: ties are as rare as equal hashes
        top = content[np.argpartition(rank, m - own_k - t)[m - own_k - t :]]
        if t == 2:
            i, j = np.triu_indices(own_k + 2, 1)
            top = _mix(top[i] + top[j])
        found.append(top)
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def _sets(docs: DataFrame) -> DataFrame:
    """k, h, n, id, other (the second digest) and sketch of every document, and rows with k = null that count features seen SEEN
    times in a slice (in h: the feature, in n: the count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for part in slices(batches, most_bytes=2 << 20):
            sets = [shingles(t, known) for t in part.column(2).to_pylist()]
            yield arrow_batch(MEMBERS, [part.column(0), part.column(1), [len(s) for s in sets], [_digest(s, 0) for s in sets], [_digest(s, 1) for s in sets], [parity_sketch(s).tobytes() for s in sets]])
            distinct = {set_id(s): s for s in sets}
            features, counts = np.unique(np.concatenate(list(distinct.values())), return_counts=True)
            often = counts >= SEEN
            if often.any():
                yield arrow_batch(MEMBERS, [pa.nulls(int(often.sum()), pa.int64()), features[often].view(np.int64), counts[often].astype(np.int64), *[np.zeros(int(often.sum()), np.int64)] * 2, pa.nulls(int(often.sum()), pa.binary())])

    return docs.mapInArrow(run, MEMBERS)


def _signed(docs: DataFrame, frequent: np.ndarray, percent: int, shared: frozenset[int]) -> DataFrame:
    """sig, id: a set's signatures, about once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = WordHashes(), set()
        for part in slices(batches, most_bytes=2 << 20):
            sets = {set_id(s, shared): s for s in (shingles(t, known) for t in part.column(0).to_pylist()) if len(s)}
            fresh = [i for i in sets if i not in seen]
            if len(seen) > HELD:
                seen.clear()
            seen.update(fresh)
            signed = [signatures(sets[i], frequent, percent) for i in fresh]
            if signed:
                yield arrow_batch(SIGNED, [np.concatenate(signed).view(np.int64), np.repeat(np.array(fresh, np.int64), [len(x) for x in signed])])

    return docs.select("text").mapInArrow(run, SIGNED)


def _buckets(signed: DataFrame) -> DataFrame:
    """The sets (id) of every signature that several sets share, in blocks of BUCKET. A bucket is named by a digest of its
    members, so that signatures with the same members are one bucket after a distinct; one of over HELD sets is passed on as it
    comes, under its signature."""

    def groups(sig: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])
        sig, own = sig[fresh], own[fresh]
        starts = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        sizes = np.diff(np.append(starts, len(sig)))
        name = np.add.reduceat(_mix(own.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), starts)
        name, kept = np.unique(np.where(sizes > 1, name, 0), return_index=True)
        kept, name = kept[sizes[kept] > 1], name[sizes[kept] > 1]
        n = sizes[kept]
        if len(kept):
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield arrow_batch(BUCKETS, [np.repeat(name, n).view(np.int64), place // BUCKET, own[np.repeat(starts[kept], n) + place]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        flowing, passed, latest = None, 0, None  # the signature that is passed on, how many sets so far, the latest one
        for batch in batches:
            sig, own = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            if flowing is not None and len(sig):
                n = int(np.searchsorted(sig, flowing, side="right"))
                some = own[:n][np.append(True, own[1:n] != own[: n - 1])] if n else own[:0]
                some = some[1:] if len(some) and some[0] == latest else some
                if len(some):
                    yield arrow_batch(BUCKETS, [np.full(len(some), flowing), (passed + np.arange(len(some))) // BUCKET, some])
                    passed, latest = passed + len(some), some[-1]
                sig, own = sig[n:], own[n:]
                flowing = None if len(sig) else flowing
            if not len(sig):
                continue
            last = int(np.searchsorted(sig, sig[-1]))  # the last signature may go on in the next batch
            if last or held and held[-1][0][-1] != sig[0]:
                held.append((sig[:last], own[:last]))
                yield from groups(*map(np.concatenate, zip(*held, strict=True)))
                held = []
            held.append((sig[last:], own[last:]))
            if sum(len(x) for x, _ in held) > HELD:
                flowing, some = held[0][0][0], np.concatenate([x for _, x in held])
                some = some[np.append(True, some[1:] != some[:-1])]
                held = []
                yield arrow_batch(BUCKETS, [np.full(len(some), flowing), np.arange(len(some)) // BUCKET, some])
                passed, latest = len(some), some[-1]
        if held:
            yield from groups(*map(np.concatenate, zip(*held, strict=True)))

    return signed.repartition("sig").sortWithinPartitions("sig", "id").mapInArrow(run, BUCKETS)


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of the numbers of elements in cells of the hash range's low bits; a power of two of cells, over 1.5 a set's
    size. Adding its halves gives the sketch of half as many cells."""
    cells = 1 << max(6, int(len(hashes) * 3 // 2).bit_length())
    return np.packbits(np.bincount(_mix(hashes) & np.uint64(cells - 1), minlength=cells).astype(np.uint8) & 1, bitorder="little")


def _fold(sketch: np.ndarray, size: int) -> np.ndarray:
    while len(sketch) > size:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def _may_link(ids: list[int], sizes: list[int], sketches: list[bytes], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs that connect a bucket's sets as far as they can link; with side (two blocks) only by links from one to the other."""
    n, least = np.array(sizes, np.int64), min(map(len, sketches))
    bits = np.stack([_fold(np.frombuffer(x, np.uint8), least) for x in sketches]).view(np.uint64)
    waiting, out = np.ones(len(ids), bool), []
    for first in range(len(ids)):
        queue = [first] if waiting[first] else []
        waiting[first] = False
        while queue:
            i = queue.pop()
            rest = np.flatnonzero(waiting if side is None else waiting & (side != side[i]))
            if not len(rest):
                continue
            apart = np.bitwise_count(bits[rest] ^ bits[i]).sum(axis=1, dtype=np.int64)
            near = rest[apart * (100 + percent) <= (n[rest] + n[i]) * (100 - percent)].tolist()
            waiting[near] = False
            queue += near
            out += [(ids[first], ids[j]) for j in near]
    return out


def _in_block_pairs(rows: DataFrame, key: str, mine: str, last: str) -> DataFrame:
    """rows in the pairs (x, y) of blocks that they take part in: key, x, y, side (whether a row is of the second block), others.
    mine: a row's block; last: its group's greatest block."""
    rest = [c for c in rows.columns if c not in (key, mine, last)]
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(last).cast("int"))))
    # with several blocks a block meets itself once, and every other one once
    return dealt.select(key, F.least(mine, "other").cast("int").alias("x"), F.greatest(mine, "other").cast("int").alias("y"), (F.col(mine) > F.col("other")).alias("side"), *rest)


def _can_link(buckets: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(a, b): sets that can link, a spanning set of them in every bucket. sketches: id, n and sketch of every set, once."""
    once = buckets.distinct()
    last = once.filter("block > 0").groupBy("sig").agg(F.max("block").alias("last"))
    wide = once.join(sketches, "id").join(last, "sig", "left").withColumn("last", F.coalesce("last", F.lit(0)))
    dealt = _in_block_pairs(wide.select("sig", "block", "last", "id", "n", "sketch"), "sig", "block", "last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, seen = None, [], set()

        def close() -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            side, *columns = map(list, zip(*held, strict=True))
            found = set(_may_link(*columns, percent, None if key[1] == key[2] else np.array(side))) - seen
            if found:
                if len(seen) > HELD:
                    seen.clear()
                seen.update(found)
                yield arrow_batch(PAIRS, list(map(list, zip(*sorted(found), strict=True))))

        for part in slices(batches, "sketch"):
            for row in zip(*(part.column(c).to_pylist() for c in range(7)), strict=True):
                if row[:3] != key:
                    yield from close()
                    key, held = row[:3], []
                held.append(row[3:])
        yield from close()

    return dealt.repartition("sig", "x", "y").sortWithinPartitions("sig", "x", "y", "id").mapInArrow(run, PAIRS).distinct()


def links_across(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Index pairs of linked sets, a spanning set of them. side: where both sides occur (two blocks), only sets of different
    sides meet."""
    sizes = np.array([len(s) for s in sets])
    _, feature = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(feature, kind="stable")
    owner = np.repeat(np.arange(len(sets)), sizes)[order]
    begin = np.concatenate([[0], np.cumsum(np.bincount(feature))])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    label, out, two = np.arange(len(sets)), [], side.any()
    for i in range(len(sets)):
        if two and side[i]:
            continue
        own = feature[starts[i] : starts[i + 1]]
        a, n = begin[own], begin[own + 1] - begin[own]
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(sets))
        linked = (100 * common >= percent * (sizes + sizes[i] - common)) & (label != label[i])
        if two:
            linked &= side
        for j in np.flatnonzero(linked):
            if label[j] != label[i]:
                out.append((i, int(j)))
                label[label == label[j]] = label[i]
        if (label == label[0]).all():
            break
    return out


def _within(clusters: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the sets of each cluster (node, root)."""
    last = materialize(clusters.groupBy("root").agg((F.ceil(F.count(F.lit(1)) / CLUSTER) - 1).cast("int").alias("last")))
    member = clusters.withColumnRenamed("node", "id").join(last, "root").join(sets, "id")
    mine = F.pmod(F.xxhash64("id"), F.col("last") + 1).cast("int")
    dealt = _in_block_pairs(member.withColumn("mine", mine).select("root", "mine", "last", "id", "set"), "root", "mine", "last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                ids, side, found = (list(x) for x in zip(*held, strict=True))
                pairs = links_across(found, np.array(side), percent)
                if pairs:
                    yield arrow_batch(PAIRS, [[ids[i] for i, _ in pairs], [ids[j] for _, j in pairs]])

        for part in slices(batches, "set"):
            for c, x, y, side, i, raw in zip(*(part.column(n).to_pylist() for n in range(6)), strict=True):
                if (c, x, y) != key:
                    yield from close()
                    key, held = (c, x, y), []
                held.append((i, side, np.frombuffer(raw, np.uint64)))
        yield from close()

    return dealt.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y").mapInArrow(run, PAIRS)


def _whole_sets(texts: DataFrame, shown: DataFrame, shared: frozenset[int]) -> DataFrame:
    """id and set of the documents in shown (k, h). A bitmap of SPOTS bits, whatever the size of shown, keeps most
    other texts from being shuffled; the join that follows is exact."""
    spot = F.pmod(F.xxhash64("k", "h"), F.lit(SPOTS))
    words_of = shown.select(spot.alias("spot")).groupBy(F.floor(F.col("spot") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot % 64 AS int))")).alias("bits"))
    bitmap = np.zeros(SPOTS // 64, np.int64)
    for r in words_of.collect():
        bitmap[r["word"]] = r["bits"]
    sent = texts.sparkSession.sparkContext.broadcast(np.unpackbits(bitmap.view(np.uint8), bitorder="little").astype(bool))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, wanted = WordHashes(), set(), sent.value
        for batch in batches:
            batch = batch.filter(pa.array(wanted[np.asarray(batch.column(3))]))
            for part in slices([batch]):
                out = []
                for k, h, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    if (k, h) not in seen:
                        seen.add((k, h))
                        own = shingles(text, known)
                        out.append((k, h, set_id(own, shared), own.tobytes()))
                if out:
                    yield arrow_batch(KEYED_SETS, list(map(list, zip(*out, strict=True))))

    made = texts.select("k", "h", "text", spot.alias("spot")).mapInArrow(run, KEYED_SETS)
    return made.join(shown, ["k", "h"], "left_semi").dropDuplicates(["k", "h"]).select("id", "set")


def _shared_names(members: DataFrame) -> frozenset[int]:
    """Names of more than one set, as far as the second digest tells: chance makes a handful of them in tens of billions."""
    found = members.groupBy("id").agg(F.min("other").alias("a"), F.max("other").alias("b")).filter("a <> b").select("id").limit(MOST_SHARED + 1).collect()
    if len(found) > MOST_SHARED:
        raise RuntimeError("more equal digests of different sets than chance makes")
    return frozenset(r["id"] for r in found)


def jaccard_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """k, h (the document's key), n (its set's size) and component_id (the least k that links reach) of every document."""
    spark, texts = docs.sparkSession, keyed(docs)
    found = materialize(_sets(texts))
    members, filled = found.filter("k IS NOT NULL"), F.col("n") > 0
    shared = _shared_names(members.filter(filled))
    members = members.withColumn("id", F.when(F.col("id").isin(list(shared)), F.col("other")).otherwise(F.col("id"))) if shared else members
    often = most_counted(found.filter("k IS NULL").groupBy("h").agg(F.sum("n").alias("n")), "n", FREQUENT).select("h").collect()
    frequent = np.sort(np.array([r["h"] for r in often], np.int64).view(np.uint64))
    buckets = materialize(_buckets(_signed(texts, frequent, percent, shared)))

    clusters = materialize(components(_can_link(buckets, members.filter(filled).select("id", "n", "sketch").dropDuplicates(["id"]), percent)))
    shown = members.filter(filled).groupBy("id").agg(F.min(F.struct("k", "h")).alias("doc")).join(clusters, F.col("id") == F.col("node")).select("doc.k", "doc.h").distinct()
    sets = materialize(_whole_sets(texts, shown, shared))
    roots = materialize(components(_within(clusters, sets, percent)))

    named = members.filter(filled).join(roots, members["id"] == roots["node"], "left").select("k", "h", "n", F.coalesce("root", "id").alias("root"))
    # written, so that a component of very many documents is joined by several tasks
    named = materialize(named)
    least = materialize(named.groupBy("root").agg(F.min("k").alias("component_id"), F.min(F.struct("k", "h")).alias("first")))
    some = named.join(least, "root").select("k", "h", "n", "component_id", (F.struct("k", "h") == F.col("first")).alias("stays"))
    none = members.filter("n = 0").select("k", "h", "n", F.col("k").alias("component_id"), F.lit(True).alias("stays"))
    return some.unionByName(none)


def keep_one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with the first document (by doc_id) of each component; fully repeated rows count as one."""
    stay = jaccard_components(docs, percent).filter("stays").select(F.col("k").alias("__k"), F.col("h").alias("__h")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.withColumns({"__k": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "__h": F.xxhash64(text)})
    return own.join(stay, ["__k", "__h"]).dropDuplicates(["__k", "__h"]).select(*docs.columns)


def op10_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    named = jaccard_components(read_table(spark, sf_dir, "documents"))
    back = lambda c: F.when(F.col(c) != -(1 << 63), F.col(c))
    return named.select(back("k").alias("doc_id"), F.col("n").alias("n_shingles"), back("component_id").alias("component_id"))


OP10_SQL = r"""
WITH RECURSIVE spoken AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                                      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM spoken
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingle a JOIN shingle b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (
  SELECT x, y FROM shared JOIN size a ON a.doc_id = x JOIN size b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN link l ON l.x = r.other
)
SELECT r.doc_id, coalesce(max(s.n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id FROM reach r LEFT JOIN size s ON s.doc_id = r.doc_id GROUP BY r.doc_id
"""

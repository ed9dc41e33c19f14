"""Benchmark decontamination: documents that hold a benchmark item, up to a share of edited words.

Words are lower-cased, separated by white space and stripped of outer punctuation. A document holds an item of m words if
some run of its words is within floor(max_edit * m) word edits (insert, delete, replace) of the item.

1. Windows. All m-word windows of a document are considered for each item of m words. Those that share fewer word grams
   with it than so many edits must leave intact (the q-gram lemma) cannot match and go no further.
2. CGK embedding. A window is read by a random walk: at each of 3 m steps the symbol under the pointer is written and a
   random bit of (step, symbol) decides whether the pointer moves. Edit distance becomes Hamming distance.
3. Bit sampling. A key is a sample of embedded positions; a window that has a key of the item's is a candidate. The number
   of walks follows from the target recall, measured on copies of the items with as many edits as are allowed, by the items'
   length. Items for which ``MOST`` walks miss the target skip this step: all their windows are candidates.
4. Exact check. The least edit distance of the item to any run of words in the candidate's neighbourhood decides.

Items are used in blocks of at most ``block_bytes``; each block is sent to the tasks whole, and more blocks mean more passes.
Null or wordless texts hold nothing, null or wordless items and items of fewer than ``min_words`` words are in nothing. Items
of equal text are reported each; repeated item ids too. Rows of equal doc_id are told apart by a hash of the text. Empty
tables give empty results; other columns pass through.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm._util import arrow_batch, keyed, materialize, read_table, slices

MAX_EDIT, MIN_WORDS, RECALL, GRAM, SAMPLE, PER_WALK = 0.2, 5, 0.99, 3, 4, 4
MOST, SAMPLED = 96, 100  # walks; words of the longest items that go by them
CACHE = 300_000
EDGE = re.compile(r"^\W+|\W+$")
HITS = T.StructType([T.StructField("k", T.LongType()), T.StructField("h", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("edits", T.IntegerType()), T.StructField("item_words", T.IntegerType()), T.StructField("end_word", T.IntegerType())])


class WordHashes(dict):
    """Hashes of normalised words by raw word; 0 for what is punctuation only."""

    def __missing__(self, raw: str) -> int:
        if len(self) > CACHE:
            self.clear()
        word = EDGE.sub("", raw)
        self[raw] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) | 1 if word else 0
        return h


def words(text: str | None, known: WordHashes) -> np.ndarray:
    each = np.fromiter(map(known.__getitem__, (text or "").lower().split()), np.uint64)
    return each[each != 0]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(each: np.ndarray, width: int) -> np.ndarray:
    n = max(0, len(each) - width + 1)
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + each[i : i + n])
    return total


def embed(each: np.ndarray, starts: np.ndarray, ends: np.ndarray, m: int, walks: np.ndarray) -> np.ndarray:
    """CGK embeddings of the windows each[start:end]: symbols by (window, walk, step), 0 past the end."""
    padded = np.append(each, np.uint64(0))
    at, end = np.repeat(starts, len(walks)), np.repeat(ends, len(walks))
    salt = np.tile(_mix((walks.astype(np.uint64) + np.uint64(1)) * np.uint64(0x8CB92BA72F3D8DD7)), len(starts))
    out = np.zeros((3 * m, len(at)), np.uint64)
    for t in range(3 * m):
        symbol = padded[np.minimum(at, len(each))] * (at < end)
        out[t] = symbol
        at = at + (_mix(symbol + salt + np.uint64(t)) & np.uint64(1)).astype(np.int64)
    return out.T.reshape(len(starts), len(walks), 3 * m)


def least_edits(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of item to any run of text's words, and where that run ends (the first such end)."""
    n = len(text)
    ramp = np.arange(n + 1)
    row = np.zeros(n + 1, np.int64)
    for i, symbol in enumerate(item.tolist(), 1):
        new = np.empty(n + 1, np.int64)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != symbol))
        row = np.minimum.accumulate(new - ramp) + ramp
    end = int(row.argmin())
    return int(row[end]), end


def edits_allowed(m: int, max_edit: float) -> int:
    return int(max_edit * m + 1e-9)


def _gram_width(m: int, k: int) -> int:
    """Grams that k edits cannot all destroy; single words where longer grams could be."""
    return GRAM if m - GRAM + 1 - GRAM * k >= 1 else 1


@dataclass
class Item:
    words: np.ndarray
    ids: list[int]  # of all items of these words
    k: int
    width: int
    need: int  # grams that must be left
    keys: np.ndarray  # by (walk, sample); none: every window is a candidate


@dataclass
class Index:
    """The items of one block, and the grams that lead to them."""

    items: list[Item] = field(default_factory=list)
    gram_tables: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)


@functools.cache
def _samples(m: int, walk: int, n: int) -> np.ndarray:
    """n samples of SAMPLE embedded positions; the walk is mostly past the end after about 2 m steps."""
    return np.random.default_rng([m, walk]).integers(0, max(1, 2 * m - m // 4), (n, SAMPLE))


def _keys(each: np.ndarray, starts: np.ndarray, ends: np.ndarray, m: int, walks: range) -> np.ndarray:
    """Keys by (window, walk, sample)."""
    embedded = embed(each, starts, ends, m, np.arange(walks.start, walks.stop))
    chosen = np.stack([_samples(m, w, PER_WALK) for w in walks])
    total = np.zeros((len(starts), len(walks), PER_WALK), np.uint64)
    for c in range(SAMPLE):
        picked = np.take_along_axis(embedded, chosen[None, :, :, c].repeat(len(starts), axis=0), axis=2)
        total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + picked)
    return total


def edited(item: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """A copy with k random inserts, replacements and deletes of words."""
    out = item.tolist()
    for _ in range(k):
        kind, at = int(rng.integers(3)), int(rng.integers(len(out)))
        if kind == 0:
            out.insert(at, int(rng.integers(1, 1 << 62)))
        elif kind == 1 or len(out) == 1:
            out[at] = int(rng.integers(1, 1 << 62))
        else:
            del out[at]
    return np.array(out, np.uint64)


def walks_needed(items: list[tuple[np.ndarray, int]], recall: float, trials: int = 200, most: int = MOST) -> int:
    """Walks at which copies of items with as many edits as are allowed share a key in the target share of trials; 0 where most
    are too few."""
    rng, needed = np.random.default_rng(1), []
    for t in range(trials if items else 0):
        item, k = items[t * len(items) // trials]
        copy = edited(item, k, rng)
        both = np.concatenate([item, copy])
        keys = _keys(both, np.array([0, len(item)]), np.array([len(item), len(both)]), len(item), range(most))
        needed.append(int(np.append((keys[0] == keys[1]).any(axis=1), True).argmax()) + 1)
    walks = int(np.quantile(needed, recall, method="higher")) if needed else 1
    return walks if walks <= most else 0


def build(rows: list[tuple[int, str]], max_edit: float = MAX_EDIT, min_words: int = MIN_WORDS, recall: float = RECALL) -> Index:
    """An item's place counts once for all items of the same words."""
    known, by_words = WordHashes(), defaultdict(list)
    for item_id, text in rows:
        each = words(text, known)
        if len(each) >= min_words:
            by_words[each.tobytes()].append(item_id)
    found = [np.frombuffer(raw, np.uint64) for raw in sorted(by_words)]
    # by powers of two of the length; fewer items than trials would leave the target to a few lengths, more are sampled evenly
    by_length = defaultdict(list)
    for x in sorted(found, key=len):
        by_length[len(x).bit_length()].append((x, edits_allowed(len(x), max_edit)))
    walks = {b: walks_needed([i for i in each if len(i[0]) <= SAMPLED], recall) for b, each in by_length.items()}
    index, gram_rows = Index(), defaultdict(list)
    for each in found:
        m, k = len(each), edits_allowed(len(each), max_edit)
        width = _gram_width(m, k)
        by = walks[m.bit_length()] if m <= SAMPLED else 0
        keys = _keys(each, np.array([0]), np.array([m]), m, range(by))[0] if by else np.empty((0, PER_WALK), np.uint64)
        own = np.unique(grams(each, width))
        gram_rows[width].append((own, np.full(len(own), len(index.items))))
        index.items.append(Item(each, by_words[each.tobytes()], k, width, m - width + 1 - width * k, keys))
    for width, found in gram_rows.items():
        g, item = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((item, g))
        index.gram_tables[width] = g[order], item[order]
    return index


def _clusters(each: np.ndarray, index: Index) -> Iterator[tuple[Item, np.ndarray, np.ndarray]]:
    """(item, starts, grams left) of neighbouring windows that keep enough of an item's grams."""
    for width, (table, owner) in index.gram_tables.items():
        own = grams(each, width)
        left, right = np.searchsorted(table, own), np.searchsorted(table, own, side="right")
        hits = np.flatnonzero(right > left)
        if not len(hits):
            continue
        n = right[hits] - left[hits]
        place = np.repeat(hits, n)
        item = owner[np.repeat(left[hits], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        order = np.argsort(item, kind="stable")
        place, item = place[order], item[order]
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(item)) + 1, [len(item)]])
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            it, at = index.items[item[a]], place[a:b]
            if len(at) < it.need:
                continue
            # a run within k edits starts at most k words and m words before any gram it keeps, and has at most m + k words
            span = len(it.words) + it.k
            starts = np.unique((at[:, None] - np.arange(span)[None, :]).ravel())
            starts = starts[starts >= 0]
            kept = np.searchsorted(at, starts + span - width + 1) - np.searchsorted(at, starts)
            starts, kept = starts[kept >= it.need], kept[kept >= it.need]
            if len(starts):
                cuts = np.flatnonzero(np.diff(starts) > span) + 1
                yield from zip([it] * (len(cuts) + 1), np.split(starts, cuts), np.split(kept, cuts), strict=True)


def shares_key(each: np.ndarray, item: Item, starts: np.ndarray, kept: np.ndarray) -> bool:
    """Whether some window has a key of the item: first the window with most grams, then all, walks doubling."""
    m, walks = len(item.words), len(item.keys)
    if not walks:
        return True
    best = starts[kept == kept.max()]
    best = best[len(best) // 2 :][:1] if len(best) > 1 else best
    done, step = 0, 1
    first = _keys(each, best, np.minimum(best + m, len(each)), m, range(1))
    if (first[0] == item.keys[:1]).any():
        return True
    while done < walks:
        some = range(done, min(walks, done + step))
        if (_keys(each, starts, np.minimum(starts + m, len(each)), m, some) == item.keys[None, some.start : some.stop]).any():
            return True
        done, step = some.stop, step * 2
    return False


def matches(text: str | None, index: Index, known: WordHashes) -> list[tuple[int, int, int, int]]:
    """(item_id, edits, item words, end word) of the items that the text holds; one row per item, its least distance."""
    each = words(text, known)
    best: dict[int, tuple[int, int, Item]] = {}
    for item, starts, kept in _clusters(each, index):
        if shares_key(each, item, starts, kept):
            a, b = int(starts[0]), int(starts[-1]) + len(item.words) + item.k
            edits, end = least_edits(item.words, each[a:b])
            if edits <= item.k and (id(item) not in best or (edits, a + end) < best[id(item)][:2]):
                best[id(item)] = edits, a + end, item
    return [(i, edits, len(item.words), end) for edits, end, item in best.values() for i in item.ids]


def contaminated(docs: DataFrame, items: DataFrame, max_edit: float = MAX_EDIT, min_words: int = MIN_WORDS, recall: float = RECALL, block_bytes: int = 8 << 20) -> DataFrame:
    """k, h (the document's key), item_id, edits, item_words, end_word: a row per document and item it holds."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    blocks = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    out = None
    for b in range(blocks):
        block = [(r[0], r[1]) for r in rows.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()]
        index = docs.sparkSession.sparkContext.broadcast(build(sorted(block, key=str), max_edit, min_words, recall))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            known = WordHashes()
            for part in slices(batches):
                made = [(k, h, *hit) for k, h, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True) for hit in matches(text, index.value, known)]
                if made:
                    yield arrow_batch(HITS, list(map(list, zip(*made, strict=True))))

        found = keyed(docs).mapInArrow(run, HITS)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without those that hold an item; columns as given."""
    bad = materialize(contaminated(docs, items, **options).select(F.col("k").alias("__k"), F.col("h").alias("__h")).distinct())
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.withColumns({"__k": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "__h": F.xxhash64(text)})
    return own.join(bad, ["__k", "__h"], "left_anti").select(*docs.columns)


def op8_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(F.when(F.col("k") != -(1 << 63), F.col("k")).alias("doc_id"), "item_id", "edits", "item_words", "end_word")

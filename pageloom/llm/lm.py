"""LM scoring of whole texts: a word-count baseline and a causal self-attention model over subword ids.

A text's words are what ASCII white space separates after lower-casing A-Z, followed by one end token. Rows whose
crc32(doc_id as text) leaves ``fold`` modulo ``folds`` are held out; all others are training texts.

Baseline: log10((c + 1) / (N + V + 1)) per token with counts over all training texts. Words are counted in the tasks and then
by word. The ``known_words`` most frequent words at most (a whole range of counts, so that no tie is cut) go to every task
with their counts and ids; all other words' counts come from a join by word. No word is left out. After the counts one pass over
the texts looks up each word once, for its count and for its ids; only words that were not sent along go through the tokeniser.

Model: a word's subword ids are those of a space and the word, so the ids of a text follow from its words and the ids'
counts over all training texts from the words' counts. These counts choose the model's symbols and the shares of all other
ids. Which symbol follows which is counted over all training texts; the weights' start, the classes and the class and member
frequencies come from that. The weights are then fitted on all ids of all training texts: every block of a text goes to one of
the trainers, of which there is one for every ``PER_TRAINER`` training ids, and each takes all of its blocks, in ``steps`` steps or
as many as they need. Trainers run in tasks and go on from their common mean in each of ``ROUNDS`` rounds; several trainers read a
part of their blocks in each round, a single one goes through its blocks on and on. ``sample_ids``, if given, limits the blocks to
so many ids a trainer, from everywhere in the texts (by a hash of text and place); no query gives it. Texts are scored in overlapping windows that
predict each id once (see ``attention``).

Null and empty texts have the end token only. A null doc_id is the empty string for the fold. Repeated rows are scored each
and count each. Without training texts every id has the same probability. Empty tables give empty results; other columns
are not read.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm import attention, tokens
from pageloom.llm._util import arrow_batch, id_and_text, materialize, most_counted, read_table, slices
from pageloom.sources.shared import discard

FOLDS, FOLD = 7, 2
HELD_WORDS = 450_000
CHUNK = 8192
PER_TRAINER, ROUNDS = 5_000_000, 5
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PIECE = 4096  # numbers of a trainer's state that are averaged together
_LONG = T.LongType()
COUNTS = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("c", _LONG)])
IDS = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("c", _LONG)])
_TEXT = [T.StructField("row", _LONG), T.StructField("doc_id", _LONG), T.StructField("held_out", T.BooleanType())]
_BASE = [T.StructField("n_words", _LONG), T.StructField("n_known", _LONG), T.StructField("known", T.DoubleType())]
TEXTS = T.StructType([*_TEXT, *_BASE, T.StructField("h", _LONG), T.StructField("ids", T.BinaryType()), T.StructField("rare", T.ArrayType(T.BinaryType()))])
SCORED = T.StructType([*_TEXT, *_BASE, T.StructField("score", T.DoubleType())])
GATHERED = T.StructType([T.StructField("pair", T.IntegerType()), T.StructField("c", _LONG), T.StructField("trainer", _LONG), T.StructField("place", _LONG), T.StructField("block", T.BinaryType())])
PIECES = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("n", _LONG), T.StructField("state", T.BinaryType())])


def held_out(folds: int = FOLDS, fold: int = FOLD) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % folds == fold


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_ids(word: bytes, enc: tokens.Encoder) -> list[int]:
    return enc.ids(" " + word.decode("utf-8", "surrogatepass"))


def text_ids(each: list[bytes], enc: tokens.Encoder) -> np.ndarray:
    """The ids of a text: those of a space and its word, word after word."""
    return np.asarray(enc.ids(" " + b" ".join(each).decode("utf-8", "surrogatepass")) if each else [], np.int64)


def _pieces(source: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces of source that begin at first, one after another."""
    ends = np.cumsum(sizes)
    return source[np.repeat(first - (ends - sizes), sizes) + np.arange(sizes.sum())]


def ids_by_word(each: list[bytes], enc: tokens.Encoder) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words, word after word, and how many each word has. Words for the slow tokeniser don't take others along."""
    if each and not enc.plain(b" ".join(each).decode("utf-8", "surrogatepass")):
        odd = np.array([not enc.plain(w.decode("utf-8", "surrogatepass")) for w in each])
    else:
        odd = np.zeros(len(each), bool)
    flat = text_ids([w for w, is_odd in zip(each, odd.tolist(), strict=True) if not is_odd], enc) if odd.any() else text_ids(each, enc)
    owner = np.cumsum(enc.spaced[flat]) - 1  # a word's first id begins with its space, and no other id does
    if len(flat) and owner[-1] != len(each) - odd.sum() - 1:
        odd[:], flat, owner = True, flat[:0], owner[:0]
    if not odd.any():
        return flat, np.bincount(owner, minlength=len(each))
    apart = [word_ids(w, enc) for w, is_odd in zip(each, odd.tolist(), strict=True) if is_odd]
    sizes = np.zeros(len(each), np.int64)
    sizes[~odd], sizes[odd] = np.bincount(owner, minlength=int((~odd).sum())), [len(x) for x in apart]
    first = np.zeros(len(each), np.int64)
    for those in (~odd, odd):
        first[those] = np.cumsum(sizes[those]) - sizes[those]
    first[odd] += len(flat)
    return _pieces(np.concatenate([flat, *(np.array(x, np.int64) for x in apart)]), first, sizes), sizes


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c over the texts of docs; each task sums before the shuffle, in bounded memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def emit() -> pa.RecordBatch:
            return arrow_batch(COUNTS, [list(counts), list(counts.values())])

        for part in slices(batches):
            for text in part.column(0).to_pylist():
                counts.update(words(text))
            if len(counts) > HELD_WORDS:
                yield emit()
                counts = Counter()
        if counts:
            yield emit()

    return docs.select("text").mapInArrow(run, COUNTS).groupBy("word").agg(F.sum("c").alias("c"))


def _id_counts(counts: DataFrame, vocabulary: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, total = tokens.encoder(vocabulary), np.zeros(1 << 16, np.int64)
        for batch in batches:
            each, c = batch.column(0).to_pylist(), np.asarray(batch.column(1))
            flat, sizes = ids_by_word(each, enc)
            if len(flat) and flat.max() >= len(total):
                total = np.concatenate([total, np.zeros(int(flat.max()) + 1 - len(total), np.int64)])
            total += np.bincount(flat, np.repeat(c, sizes), minlength=len(total)).astype(np.int64)
        seen = np.flatnonzero(total)
        yield arrow_batch(IDS, [seen.astype(np.int32), total[seen]])

    return counts.select("word", "c").mapInArrow(run, IDS).groupBy("id").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    vocabulary_path: str
    words: dict[bytes, int]  # number of each word that is sent along
    log_counts: np.ndarray  # log10(c + 1) by number
    end_log: float  # log10(c + 1) of the end token, and whether it is known
    end_known: int
    symbols: attention.Vocabulary
    weights: dict | None
    places: tuple | None
    word_ids: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))  # of the words, in order, as from ids_by_word

    def log10_texts(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each text's ids and its end."""
        if self.weights is None:
            return np.array([-(len(t) + 1) * np.log10(len(self.symbols.symbols) + 1.0) for t in texts])
        total, at, n = np.zeros(len(texts)), 0, 0
        for i in range(len(texts)):
            n += len(texts[i])
            if n >= CHUNK or i == len(texts) - 1:
                part = texts[at : i + 1]
                for j, piece in enumerate(part):
                    symbols = self.symbols.symbols[piece]
                    total[at + j] = self.symbols.rest[piece[symbols == attention.REST]].sum()
                total[at : i + 1] += self._chunk([self.symbols.symbols[piece] for piece in part])
                at, n = i + 1, 0
        return total / np.log(10)

    def _chunk(self, texts: list[np.ndarray]) -> np.ndarray:
        inputs, queried, targets, owner = attention.blocks_of(texts)
        out = np.zeros(len(texts))
        # a long text is read in runs of blocks; a run begins with the block before it as context
        step, asked = CHUNK // attention.BLOCK * 2, np.flatnonzero(queried)
        for a in range(0, len(asked), step):
            some = asked[a : a + step]
            lo, hi = some[0] - 1, some[-1] + 1
            made = attention.log_likelihood(self.weights, self.places, inputs[lo:hi], np.append(False, queried[lo + 1 : hi]), targets[a * attention.BLOCK : (a + len(some)) * attention.BLOCK])
            out += np.bincount(owner[a * attention.BLOCK : (a + len(some)) * attention.BLOCK], made.astype(np.float64), minlength=len(texts))
        return out


def tokenised(rows: DataFrame, vocabulary: str, model: Model | None = None) -> DataFrame:
    """rows (row, doc_id, text, held_out) with n_words, how many of them are training words that model sends along (n_known) and
    the sum of their log_counts (known), h, a hash of the text, its ids, and its rare words: all others."""
    sent = rows.sparkSession.sparkContext.broadcast(model) if model else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, m = tokens.encoder(vocabulary), sent.value if sent else None
        numbers_of, (ids, sizes), logs = (m.words, m.word_ids, m.log_counts) if m else ({}, (np.zeros(0, np.int64),) * 2, np.zeros(0))
        first, sizes, logs = np.append(np.cumsum(sizes) - sizes, 0), np.append(sizes, 0), np.append(logs, 0.0)  # rare words' number is -1
        for part in slices(batches, most_bytes=1 << 20):
            each = [words(text) for text in part.column(2).to_pylist()]
            every, lengths = list(itertools.chain.from_iterable(each)), np.array([len(x) for x in each])
            numbers = np.fromiter(map(numbers_of.get, every, itertools.repeat(-1)), np.int64, len(every))
            others = np.flatnonzero(numbers < 0)
            rare = [every[i] for i in others.tolist()]
            made, made_sizes = ids_by_word(rare, enc)
            at, n = first[numbers], sizes[numbers]
            at[others], n[others] = len(ids) + np.cumsum(made_sizes) - made_sizes, made_sizes
            flat = _pieces(np.concatenate([ids, made]).astype(np.int32), at, n)
            owner = np.repeat(np.arange(len(each)), lengths)
            n_rare = np.bincount(owner[others], minlength=len(each))
            known = np.bincount(owner, logs[numbers], minlength=len(each))
            cuts = np.append(0, np.cumsum(n))[np.append(0, np.cumsum(lengths))].tolist()
            those = np.append(0, np.cumsum(n_rare)).tolist()
            yield arrow_batch(
                TEXTS,
                [part.column(0), part.column(1), part.column(3), lengths, lengths - n_rare, known, part.column(4)]
                + [[flat[a:b].tobytes() for a, b in itertools.pairwise(cuts)], [rare[a:b] for a, b in itertools.pairwise(those)]],
            )

    return rows.select("row", "doc_id", "text", "held_out", F.xxhash64("doc_id", "text").alias("h")).mapInArrow(run, TEXTS)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gather(training: DataFrame, symbols: attention.Vocabulary, trainers: int, share: float) -> DataFrame:
    """From all texts (h, ids): how often each pair of symbols occurs, and a share of the blocks dealt to the trainers."""
    sent = training.sparkSession.sparkContext.broadcast(symbols.symbols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((attention.PAD + 1) * (attention.REST + 1), np.int64)
        for part in slices(batches, "ids", 1 << 20):
            texts = [sent.value[np.frombuffer(x, np.int32)] for x in part.column(1).to_pylist()]
            inputs, queried, targets, owner = attention.blocks_of(texts)
            total += attention.pair_counts(inputs[queried].reshape(-1), targets)
            owner = owner[:: attention.BLOCK]
            no = np.arange(len(owner)) - np.searchsorted(owner, owner)  # of the block in its text
            place = _mix(np.asarray(part.column(0)).view(np.uint64)[owner] + _mix(no.astype(np.uint64) + np.uint64(1)))
            chosen = np.flatnonzero((place >> np.uint64(11)) * 2.0**-53 < share)
            if len(chosen):
                here = np.flatnonzero(queried)[chosen]
                blocks = np.concatenate([inputs[here - 1], inputs[here, :1], targets.reshape(-1, attention.BLOCK)[chosen]], axis=1).astype(np.int16)
                none = [pa.nulls(len(chosen), t) for t in (pa.int32(), pa.int64())]
                yield arrow_batch(GATHERED, [*none, (_mix(place[chosen]) % np.uint64(trainers)).astype(np.int64), place[chosen].view(np.int64), [b.tobytes() for b in blocks]])
        seen = np.flatnonzero(total)
        yield arrow_batch(GATHERED, [seen.astype(np.int32), total[seen], *(pa.nulls(len(seen), t) for t in (pa.int64(), pa.int64(), pa.binary()))])

    return training.select("h", "ids").mapInArrow(run, GATHERED)


def unpacked(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As attention.pairs_of, and the targets, from gathered blocks: the block before, its own first symbol, its targets."""
    before, first, targets = blocks[:, : attention.BLOCK], blocks[:, attention.BLOCK : attention.BLOCK + 1], blocks[:, attention.BLOCK + 1 :]
    here = np.concatenate([first, np.where(targets[:, :-1] > 0, targets[:, :-1], attention.PAD)], axis=1)  # each target is read next, but the end
    return np.stack([before, here], axis=1), targets


def _round(sent, those: range, steps: int, r: int, goes: int, least: int):
    """A trainer's round r of at least so many batches; a pass over its blocks takes as many rounds as goes says, at most."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(table["place"]), kind="stable")  # the same batches in every run
        pairs, targets = unpacked(np.frombuffer(b"".join(table["block"].to_pylist()), np.int16).reshape(-1, 2 * attention.BLOCK + 1)[order].astype(np.int32))
        begun, where = sent.value
        own = {part: dict(x) for part, x in begun.items()}
        n = max(least, -(-len(pairs) // (goes * attention.BATCH)))
        at = np.linspace(those.start, those.stop - 1, n)  # places in the schedule
        seed = [key[0].as_py(), 0 if goes > 1 else those.start]
        attention.advance(own, where, pairs, targets, at, steps, np.random.default_rng(seed), skip=r * n if goes > 1 else 0)
        flat = attention.flat_of(own)
        cuts = range(0, len(flat), PIECE)
        return pa.Table.from_batches([arrow_batch(PIECES, [list(range(len(cuts))), [len(pairs)] * len(cuts), [flat[a : a + PIECE].tobytes() for a in cuts]])])

    return run


def _rounds_of(one) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """one, a trainer's round, for every trainer of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        whole = pa.Table.from_batches(found) if found else pa.table({"trainer": pa.array([], pa.int64())})
        for key in sorted(pc.unique(whole["trainer"]).to_pylist()):
            yield from one((pa.scalar(key),), whole.filter(pc.equal(whole["trainer"], key))).to_batches()

    return run


def _mean(table: pa.Table) -> pa.Table:
    n = np.asarray(table["n"]).astype(np.float64)
    total = sum(w * np.frombuffer(x.as_py(), np.float32) for w, x in zip(n / n.sum(), table["state"], strict=True))
    return pa.Table.from_batches([arrow_batch(PIECES, [[table["piece"][0].as_py()], [int(n.sum())], [total.astype(np.float32).tobytes()]])])


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is shuffled meanwhile goes from the disks as soon as its query has ended, not when the driver collects garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def train(blocks: DataFrame, p: dict, where: tuple, steps: int, trainers: int = 1, rounds: int = ROUNDS) -> dict:
    """The weights after steps, or more, of each trainer on its blocks (trainer, place, block), averaged after every round. No
    block is left out."""
    state = attention.begin(p)
    rounds = max(1, min(rounds, steps))
    for r in range(rounds):
        those = range(steps * r // rounds + 1, steps * (r + 1) // rounds + 1)
        sent = blocks.sparkSession.sparkContext.broadcast((state, where))
        some, goes = (blocks, rounds) if trainers == 1 else (blocks.filter(F.pmod("place", F.lit(rounds)) == r), 1)
        dealt = some.repartitionById(trainers, F.col("trainer").cast("int"))  # a task for each trainer; hashes would give some tasks several
        with _shuffles_dropped(blocks.sparkSession):
            done = dealt.mapInArrow(_rounds_of(_round(sent, those, steps, r, goes, -(-steps // rounds))), PIECES).groupBy("piece").applyInArrow(_mean, PIECES).collect()
        state = attention.of_flat(np.frombuffer(b"".join(bytes(x["state"]) for x in sorted(done, key=lambda x: x["piece"])), np.float32), state) if done else state
    return state["p"]


def begun(counts: DataFrame, n_training: int, vocabulary: str, known_words: int) -> tuple[Model, float]:
    """What follows from the words' counts, all but the weights; and the number of training ids, ends included."""
    sent = sorted((bytes(r["word"]), r["c"]) for r in most_counted(counts, "c", known_words).collect())
    enc = tokens.encoder(vocabulary)
    of_ids = {r["id"]: r["c"] for r in _id_counts(counts, vocabulary).collect()}
    by_id = np.zeros(max(enc.exact.get_vocab_size(), max(of_ids, default=0) + 1))
    by_id[list(of_ids)] = list(of_ids.values())
    model = Model(
        vocabulary,
        {w: i for i, (w, _) in enumerate(sent)},
        np.log10(np.array([c + 1.0 for _, c in sent])),
        float(np.log10(n_training + 1.0)),
        int(n_training > 0),
        attention.Vocabulary.of_counts(by_id),
        None,
        None,
        ids_by_word([w for w, _ in sent], enc),
    )
    return model, by_id.sum() + n_training


def fit(training: DataFrame, symbols: attention.Vocabulary, n_ids: float, sample_ids: int | None, steps: int) -> tuple[dict, tuple]:
    """Weights, ready for scoring, and the symbols' places."""
    trainers = int(-(-n_ids // PER_TRAINER))
    gathered = materialize(gather(training, symbols, trainers, min(1.0, trainers * sample_ids / n_ids) if sample_ids else 1.0))
    pairs = gathered.filter("pair IS NOT NULL").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()
    flat = np.zeros((attention.PAD + 1) * (attention.REST + 1), np.int64)
    flat[np.asarray(pairs["pair"])] = np.asarray(pairs["c"])
    p, members = attention.start_of(flat)
    where = attention.places(members)
    weights = attention.ready(train(gathered.filter("trainer IS NOT NULL").select("trainer", "place", "block"), p, where, steps, trainers))
    discard(gathered)
    return weights, where


def score_texts(docs: DataFrame, vocabulary: str | None = None, known_words: int = 150_000, sample_ids: int | None = None, steps: int = 600) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row."""
    vocabulary = vocabulary or tokens.default_vocabulary()
    given = materialize(id_and_text(docs).withColumn("held_out", held_out()).withColumn("row", F.monotonically_increasing_id()))
    counts = materialize(word_counts(given.filter("NOT held_out")))
    n_training = given.filter("NOT held_out").count()
    stats = counts.agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).first()
    n_all, v_all = (stats["c"] or 0) + n_training, stats["v"] + (n_training > 0)
    model, n_ids = begun(counts, n_training, vocabulary, known_words)
    rows = materialize(tokenised(given, vocabulary, model))
    weights, where = fit(rows.filter("NOT held_out"), model.symbols, n_ids, sample_ids, steps) if n_training else (None, None)
    end_log, end_known = model.end_log, model.end_known
    sent = docs.sparkSession.sparkContext.broadcast(replace(model, words={}, log_counts=np.zeros(0), word_ids=(), weights=weights, places=where))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "ids", 1 << 20):
            ids = [np.frombuffer(x, np.int32) for x in part.column(6).to_pylist()]
            yield arrow_batch(SCORED, [*part.columns[:6], sent.value.log10_texts(ids)])

    made = materialize(rows.select(*SCORED.names[:6], "ids").mapInArrow(run, SCORED))
    rare = rows.select("row", F.explode("rare").alias("word")).join(counts, "word", "left")
    rest = rare.groupBy("row").agg(F.count("c").alias("more"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("others"))
    n_tokens = F.col("n_words") + 1
    base = F.col("known") + end_log + F.coalesce("others", F.lit(0.0)) - n_tokens * float(np.log10(n_all + v_all + 1))
    known = F.col("n_known") + end_known + F.coalesce("more", F.lit(0))
    return made.join(rest, "row", "left").select(
        "doc_id", "held_out", n_tokens.alias("n_tokens"), known.cast("long").alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"), base.alias("base_score"), "score"
    )


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents"))

"""Toxicity, language model, decontamination, fingerprints: against brute force, held-out accuracy and known cases."""

import hashlib
import math
import os
import random
import tempfile
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from corpus import frame, rows
from corpus import words as some_words
from pyspark.sql import functions as F

from pageloom.llm import _util, attention, decontam, lm, simhash, tokens, toxicity

# toxicity


def toxic_corpus(n=600, seed=3):
    rng = random.Random(seed)
    common = some_words(rng, 300)
    docs, labels, truth = [], [], {}
    for i in range(n):
        each = [rng.choice(common) for _ in range(rng.randint(5, 80))]
        truth[i] = rng.random() < 0.2
        if truth[i]:
            for _ in range(rng.randint(1, 4)):
                each.insert(rng.randrange(len(each)), rng.choice(["vilestuff", "awfulness", "nastiness"]))
        docs.append((i, " ".join(each), "en", "s", 0))
        if rng.random() < 0.6:
            labels.append((i, 1, int(truth[i])))
    return docs, labels, truth


def label_frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels, truth = toxic_corpus()
    extra = [(9999, None, None, None, None), (None, "vilestuff", None, None, None), (10000, "", "en", "s", 0)]
    got = toxicity.score_documents(frame(spark, docs + extra), label_frame(spark, labels + [(5, 1, None), (None, 1, 1), (77777, 0, 1)])).collect()
    assert len(got) == len(docs) + 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    for r in got:
        assert r.held_out == ((zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 0) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(r.predicted == 0 for r in got if r.doc_id in (9999, 10000))


def test_toxicity_never_reads_held_out_labels(spark):
    docs, labels, _ = toxic_corpus(200)
    flipped = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, q, t in labels]
    a, b = (toxicity.train(frame(spark, docs), label_frame(spark, x)) for x in (labels, flipped))
    assert a == b


def test_toxicity_without_positives(spark):
    docs, _, _ = toxic_corpus(20)
    assert {r.predicted for r in toxicity.score_documents(frame(spark, docs), label_frame(spark, [])).collect()} == {0}
    assert toxicity.score_documents(frame(spark, []), label_frame(spark, [])).count() == 0


def test_non_negative_risk_follows_the_prior():
    rng = np.random.default_rng(1)
    positive = [np.array([1, *rng.integers(10, 40, 3)]) for _ in range(300)]
    unlabelled = [np.array([1 if rng.random() < 0.3 else 2, *rng.integers(10, 40, 3)]) for _ in range(3000)]
    model = toxicity.fit(list(map(np.unique, positive)), list(map(np.unique, unlabelled)), 0.3)
    assert model.score({1}) > 0.9 and model.score({2}) < 0.1


@pytest.mark.parametrize("prior", [0.1, 0.6])
def test_risk_and_gradient_against_loops(prior):
    rng = random.Random(int(prior * 10))
    rows = lambda n: [sorted(rng.sample(range(6), rng.randint(0, 4))) for _ in range(n)]
    flat = lambda x: (np.array([f for r in x for f in r], int), np.repeat(np.arange(len(x)), [len(r) for r in x]), np.cumsum([0] + [len(r) for r in x]))
    loss = lambda g: math.log1p(math.exp(-g))
    positive, unlabelled, signs = [sorted({0, *r}) for r in rows(9)], [[f for f in r if f] for r in rows(14)], set()
    for lean in (-4.0, 0.0, 6.0):
        theta = np.array([lean] + [rng.gauss(0, 1) for _ in range(5)] + [-2.0])

        def parts(x):
            gp, gu = ([sum(x[f] for f in r) + x[-1] for r in some] for some in (positive, unlabelled))
            below = prior * sum(loss(-g) for g in gp) / len(gp)
            return prior * sum(map(loss, gp)) / len(gp), sum(loss(-g) for g in gu) / len(gu) - below

        value, grad = toxicity.risk(theta, prior, flat(positive), flat(unlabelled))
        first, negative = parts(theta)
        signs.add(negative < 0)
        assert math.isclose(value, first + max(0, negative), rel_tol=1e-9)
        for k in range(7):
            up, down = (parts(theta + np.eye(7)[k] * d) for d in (1e-6, -1e-6))
            want = (down[1] - up[1]) / 2e-6 if negative < 0 else (sum(up) - sum(down)) / 2e-6
            assert math.isclose(grad[k], want, rel_tol=1e-4, abs_tol=1e-7)
    assert signs == ({False, True} if prior > 0.5 else signs)


def test_filter_keeps_columns(spark):
    docs, labels, truth = toxic_corpus()
    df = frame(spark, docs).withColumn("score", F.lit("clash"))
    kept = toxicity.keep_non_toxic(df, label_frame(spark, labels))
    assert kept.columns == df.columns
    assert sum(truth[r.doc_id] for r in kept.collect()) <= 0.05 * sum(truth.values())


# language model


def test_model_gradients():
    rng = np.random.default_rng(0)
    texts = [rng.integers(1, attention.MEMBERS, n).astype(np.int32) for n in (3, 40, 17, 0)]
    inputs, queried, targets, _ = attention.blocks_of(texts)
    p, members = attention.start(inputs[queried].reshape(-1), targets)
    p["W2"] = rng.normal(0, 0.1, p["W2"].shape)
    where, p = attention.places(members), {k: v.astype(np.float64) for k, v in p.items()}
    _, g = attention.gradients(p, where, inputs, queried, targets)
    for name, x in p.items():
        at = np.unravel_index(np.abs(g[name]).argmax(), x.shape)
        kept, step = x[at], 1e-4
        x[at] = kept + step
        up, _ = attention.gradients(p, where, inputs, queried, targets)
        x[at] = kept - step
        down, _ = attention.gradients(p, where, inputs, queried, targets)
        x[at] = kept
        assert math.isclose(g[name][at], (up - down) / (2 * step), rel_tol=1e-3, abs_tol=1e-7), name


def trained(seed=0):
    rng = np.random.default_rng(seed)
    texts = [np.tile(rng.permutation(np.arange(1, 30)), 4).astype(np.int32) for _ in range(30)]
    p, where = attention.train(texts, steps=60, batch=64)
    return texts, p, where


def test_scoring_equals_training_form_and_normalises():
    texts, p, where = trained()
    inputs, queried, targets, owner = attention.blocks_of(texts[:3] + [np.empty(0, np.int32)])
    loss, _ = attention.gradients(p, where, inputs, queried, targets)
    made = attention.log_likelihood(attention.ready(p), where, inputs, queried, targets)
    assert math.isclose(-made.sum() / (targets >= 0).sum(), loss, rel_tol=1e-4) and set(owner) == {0, 1, 2, 3}
    # all continuations of one text: members and REST sum to one
    context = texts[0][:7]
    every = [np.append(context, s).astype(np.int32) for s in range(attention.REST + 1)]
    total = 0.0
    for t in every:
        inputs, queried, targets, _ = attention.blocks_of([t])
        total += math.exp(attention.log_likelihood(attention.ready(p), where, inputs, queried, targets)[len(context)])
    assert math.isclose(total, 1, rel_tol=1e-3)


def test_model_is_causal_and_context_is_bounded():
    texts, p, where = trained(1)
    a, b = texts[0].copy(), texts[0].copy()
    b[50:] = 1
    score = lambda t: attention.log_likelihood(attention.ready(p), where, *attention.blocks_of([t])[:3])
    assert np.allclose(score(a)[:50], score(b)[:50], atol=1e-5)
    c = texts[0].copy()
    c[:10] = 1
    assert np.allclose(score(a)[10 + attention.BLOCK + 1 : 100], score(c)[10 + attention.BLOCK + 1 : 100], atol=1e-5)


def test_long_texts_score_alike_in_pieces(monkeypatch):
    texts, p, where = trained(2)
    whole = np.concatenate(texts)
    model = lm.Model("", {}, np.empty(0), 0.0, 0, attention.Vocabulary(np.arange(attention.REST + 1, dtype=np.int32), np.zeros(attention.REST + 1)), attention.ready(p), where)
    a = model._chunk([whole, texts[0]])
    monkeypatch.setattr(lm, "CHUNK", 64)
    assert np.allclose(a, model._chunk([whole, texts[0]]), rtol=1e-5)


@pytest.mark.parametrize("known", [0, 50, 100_000])
def test_base_scores(spark, known):
    found = rows()
    got = lm.score_texts(frame(spark, found), known_words=known, sample_ids=20_000, steps=3).collect()
    held = lambda d: (zlib.crc32(str(d).encode()) if d is not None else 0) % 7 == 2
    counts, n = Counter(), 0
    for d, t, *_ in found:
        if not held(d):
            counts.update(lm.words(t or ""))
            n += 1
    total, v = sum(counts.values()) + n, len(counts) + 1
    want = []
    for d, t, *_ in found:
        w = lm.words(t or "")
        base = sum(math.log10((counts[x] + 1) / (total + v + 1)) for x in w) + math.log10((n + 1) / (total + v + 1))
        want.append((repr(d), held(d), len(w) + 1, sum(counts[x] > 0 for x in w) + 1, total, round(base, 6)))
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(r.score < 0 for r in got)


def test_model_beats_chance_on_held_out(spark):
    rng = random.Random(5)
    vocabulary = some_words(rng, 40)
    docs = []
    for i in range(200):
        at, each = rng.randrange(40), []
        for _ in range(60):
            each.append(vocabulary[at])
            at = (at * 7 + 3 + rng.randint(0, 1)) % 40
        docs.append((i, " ".join(each), "en", "s", 0))
    got = lm.score_texts(frame(spark, docs), sample_ids=40_000, steps=120).filter("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_model_has_its_whole_size():
    p, _ = attention.start(np.array([1, 2, 3], np.int32), np.array([2, 3, 0], np.int32))
    assert p["E"].shape[1] == 32 and p["Wk"].shape == (32, 16) and p["W1"].shape == (64, 64)


def test_sample_grows_and_all_texts_count(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = some_words(rng, 60)
    docs = [(i, " ".join(rng.choices(vocabulary, k=80)), "en", "s", 0) for i in range(60)] + [(60, " ".join(rng.choices(vocabulary, k=60_000)), "en", "s", 0)]
    path, seen = tokens.default_vocabulary(), {}
    rows = _util.materialize(lm.tokenised(frame(spark, docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.lit(False).alias("held_out")), path))
    ids = [np.frombuffer(r["ids"], np.int32) for r in rows.collect()]
    symbols = attention.Vocabulary.of_counts(np.bincount(np.concatenate(ids), minlength=1 << 16).astype(float))
    inputs, queried, targets, _ = attention.blocks_of([symbols.symbols[x] for x in ids])
    for trainers, share in ((1, 1.0), (4, 0.25)):
        made = lm.gather(rows, symbols, trainers, share).collect()
        pairs = Counter()
        for r in made:
            if r["pair"] is not None:
                pairs[r["pair"]] += r["c"]
        want = attention.pair_counts(inputs[queried].reshape(-1), targets)
        assert dict(pairs) == {int(i): int(want[i]) for i in np.flatnonzero(want)}  # of all texts, whatever the share
        blocks = [r for r in made if r["pair"] is None]
        assert {r["trainer"] for r in blocks} == set(range(trainers)) and abs(len(blocks) - share * queried.sum()) < 0.1 * queried.sum()
    # trainers follow the training ids
    real = lm.gather
    monkeypatch.setattr(lm, "gather", lambda t, s, trainers, share: seen.update({per: (trainers, share)}) or real(t, s, trainers, share))
    for per in (10**9, 20_000):
        monkeypatch.setattr(lm, "PER_TRAINER", per)
        got = lm.score_texts(frame(spark, docs), sample_ids=4_000, steps=4).collect()
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert seen[10**9][0] == 1 and seen[20_000][0] > 2 and seen[20_000][1] > 2 * seen[10**9][1]


def test_weights_learn_from_all_blocks(spark, monkeypatch):
    """Nothing is sampled unless asked for, and each trainer takes every block it has."""
    rng = random.Random(7)
    vocabulary, shares = some_words(rng, 40), []
    docs = [(i, " ".join(rng.choices(vocabulary, k=90)), "en", "s", 0) for i in range(40)]
    real = lm.gather
    monkeypatch.setattr(lm, "gather", lambda t, s, trainers, share: shares.append((trainers, share)) or real(t, s, trainers, share))
    for per in (10**9, 2_000):
        monkeypatch.setattr(lm, "PER_TRAINER", per)
        assert lm.score_texts(frame(spark, docs), steps=4).filter("score < 0").count() == 40
    assert [s for _, s in shares] == [1.0, 1.0] and shares[0][0] == 1 < shares[1][0]

    texts = [np.array([rng.randrange(1, 40) for _ in range(rng.randrange(60))]) for _ in range(50)]
    inputs, queried, targets, _ = attention.blocks_of(texts)
    packed = np.concatenate([inputs[np.flatnonzero(queried) - 1], inputs[queried][:, :1], targets.reshape(-1, attention.BLOCK)], axis=1).astype(np.int16)
    pairs, by_block = lm.unpacked(packed.astype(np.int32))
    assert (pairs == attention.pairs_of(inputs, queried)).all() and (by_block.reshape(-1) == targets).all()
    p, members = attention.start(inputs[queried].reshape(-1), targets)
    sent, taken = SimpleNamespace(value=(attention.begin(p), attention.places(members))), []
    monkeypatch.setattr(attention, "BATCH", 8)
    monkeypatch.setattr(attention.advance, "__defaults__", (8, 2e-2, 0))
    monkeypatch.setattr(attention, "gradients", lambda p, where, inputs, queried, targets: taken.append(targets) or (0.0, {n: np.zeros_like(x) for n, x in p.items()}))
    part = np.arange(len(packed)) % 3
    for goes in (1, 3):
        taken.clear()
        for r in range(3):
            mine = np.flatnonzero(part == r) if goes == 1 else np.arange(len(packed))
            table = pa.table({"trainer": [0] * len(mine), "place": mine, "block": [packed[i].tobytes() for i in mine]})
            lm._round(sent, range(r + 1, r + 2), 3, r, goes, 1)((pa.scalar(0),), table)
        seen = np.concatenate(taken).reshape(-1, attention.BLOCK)
        assert {x.tobytes() for x in seen} == {x.tobytes() for x in by_block} and len(seen) <= len(by_block) + 3 * 8


def test_nothing_out_of_the_band_has_weight():
    """Weights that are nearly 0 instead made the gradient's products subnormal, which took most of its time."""
    rng = np.random.default_rng(5)
    inputs, targets = rng.integers(1, 500, (2, attention.BLOCK)).astype(np.int32), rng.integers(1, 500, attention.BLOCK).astype(np.int32)
    inputs[0, 0] = 777  # further back than any query sees
    p, members = attention.start(rng.integers(1, 900, 9000).astype(np.int32), rng.integers(1, 900, 9000).astype(np.int32))
    p["W2"] = rng.normal(0, 0.1, p["W2"].shape).astype(np.float32)
    _, g = attention.gradients(p, attention.places(members), inputs, np.array([False, True]), targets)
    assert not g["E"][777].any() and g["E"][inputs[0, 1]].any()


def test_softmax_of_any_size():
    rng = np.random.default_rng(8)
    for scale, shift in ((1, 0), (30, 0), (400, 0), (1, 500), (1, -500)):
        x, chosen = (rng.normal(size=(50, 33)) * scale + shift).astype(np.float32), rng.integers(0, 33, 50)
        want = np.exp(x.astype(np.float64) - x.max(1, keepdims=True))
        want /= want.sum(1, keepdims=True)
        loss = -np.log(want[np.arange(50), chosen] + 1e-30).sum()
        want[np.arange(50), chosen] -= 1
        assert math.isclose(attention._softmax(x, chosen), loss, rel_tol=1e-4) and np.allclose(x, want, atol=1e-5)


def test_sums_by_symbol():
    rng = np.random.default_rng(6)
    for n in (0, 1, 700):
        symbols, x = rng.integers(0, attention.PAD + 1, n).astype(np.int32), rng.normal(size=(n, 5))
        want = np.zeros((attention.PAD + 1, 5))
        np.add.at(want, symbols, x)
        assert np.allclose(attention._by_symbol(symbols, x)[0], want)


def test_each_trainer_has_a_task(spark, monkeypatch):
    """Dealt by hash, some of these eight trainers shared a task."""
    rng = np.random.default_rng(8)
    texts = [rng.integers(1, 40, 40).astype(np.int32) for _ in range(60)]
    inputs, queried, targets, _ = attention.blocks_of(texts)
    packed = np.concatenate([inputs[np.flatnonzero(queried) - 1], inputs[queried][:, :1], targets.reshape(-1, attention.BLOCK)], axis=1).astype(np.int16)
    rows = [(i % 8, i // 8, b.tobytes()) for i, b in enumerate(packed)]
    blocks = spark.createDataFrame(rows, "trainer long, place long, block binary")
    p, members = attention.start(inputs[queried].reshape(-1), targets)
    folder = tempfile.mkdtemp()

    def one(sent, those, steps, r, goes, least):
        real = rounds(sent, those, steps, r, goes, least)

        def run(key, table):
            from pyspark import TaskContext

            open(f"{folder}/{r}-{TaskContext.get().partitionId()}-{key[0].as_py()}", "w").close()
            return real(key, table)

        return run

    rounds = lm._round
    monkeypatch.setattr(lm, "_round", one)
    got = lm.train(blocks, p, attention.places(members), steps=4, trainers=8, rounds=2)
    assert all(np.isfinite(x).all() and x.shape == p[n].shape for n, x in got.items()) and not np.array_equal(got["E"], p["E"])
    seen = [name.split("-") for name in os.listdir(folder)]
    assert len(seen) == 16 and len({(r, task) for r, task, _ in seen}) == 16


def test_trained_blocks_leave_the_disk(spark, monkeypatch):
    """Each round's shuffle used to stay until the driver collected garbage, the blocks until its end."""
    rng, seen, made = random.Random(9), [], []
    docs = [(i, " ".join(rng.choices(some_words(rng, 40), k=90)), "en", "s", 0) for i in range(30)]
    real, of_flat = lm.materialize, attention.of_flat
    monkeypatch.setattr(lm, "PER_TRAINER", 2_000)
    monkeypatch.setattr(lm, "materialize", lambda df, *a: made.append(real(df, *a)) or made[-1])
    monkeypatch.setattr(attention, "of_flat", lambda *a: seen.append(spark.conf.get(lm.CLEANUP)) or of_flat(*a))
    assert lm.score_texts(frame(spark, docs), steps=10).count() == 30
    folders = [df._jdf.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0] for df in made]
    blocks = [f for df, f in zip(made, folders, strict=True) if "block" in df.columns]
    assert len(blocks) == 1 and not os.path.exists(blocks[0]) and all(os.path.exists(f) for f in folders if f != blocks[0])
    assert len(seen) == lm.ROUNDS and set(seen) == {"false"}


@pytest.mark.parametrize("known", [0, 3, 100_000])
def test_texts_are_read_once(spark, monkeypatch, known):
    """Scoring used to split every text again and to write a row for each rare word; every word went through the tokeniser."""
    odd = ["", " ", "日本語 a b", "naïve’s <|endoftext|> don't\x85x", "e\u0301 a\u00a0b", "\u2003 x"]
    docs, made, real = [(i, t, "en", "s", 0) for i, t in enumerate(["a b b c c c zz"] * 20 + odd * 5)], [], lm.materialize
    monkeypatch.setattr(lm, "materialize", lambda df, *a: made.append(real(df, *a)) or made[-1])
    assert lm.score_texts(frame(spark, docs), known_words=known, steps=2).filter("score < 0").count() == len(docs)
    assert [df.count() for df in made if "score" in df.columns] == [len(docs)] and sum("text" in df.columns for df in made) == 1
    rows = {r.doc_id: r for df in made if "ids" in df.columns for r in df.collect()}
    enc, sent = tokens.encoder(tokens.default_vocabulary()), set()
    for i, t, *_ in docs:
        each = lm.words(t)
        assert np.frombuffer(rows[i].ids, np.int32).tolist() == lm.text_ids(each, enc).tolist()
        assert rows[i].n_words == len(each) == rows[i].n_known + len(rows[i].rare)
        sent |= set(each) - {bytes(w) for w in rows[i].rare}
    assert len(sent) <= known and (b"c" in sent) == (known > 0)


def test_slow_words_take_no_others_along(monkeypatch):
    enc, slow = tokens.Encoder(tokens.default_vocabulary()), []
    each = lm.words("a 日本 b naïve <|endoftext|> don't 語")
    want = [enc.exact.encode(" " + w.decode(), add_special_tokens=False).ids for w in each]
    exact = enc.exact
    enc.exact = SimpleNamespace(encode=lambda text, **k: slow.append(text) or exact.encode(text, **k))
    flat, sizes = lm.ids_by_word(each, enc)
    assert flat.tolist() == sum(want, []) and sizes.tolist() == [len(x) for x in want]
    assert slow == [" 日本", " <|endoftext|>", " 語"]


def test_language_model_without_rows(spark):
    assert lm.score_texts(frame(spark, [])).count() == 0


# tokens


def test_both_tokenisers_agree():
    e = tokens.encoder(tokens.default_vocabulary())
    chars = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028), 0x20AC]]
    cases = [t for c in chars for t in (f"a{c}b", f" {c}{c} {c}1{c}", f"{c} {c}\n{c}", f"x{c}'s 1{c}", f"don't {c} we'll {c}9")]
    cases += ["<|endoftext|>", "a<|endoftext|> b", "текст 日本 😀", "", " ", "\n\n  x"]
    want = [x.ids for x in e.exact.encode_batch(cases, add_special_tokens=False)]
    assert [e.ids(t) for t in cases] == want
    plain = [t for t in cases if "<|" not in t and not tokens.PLAIN.search(t)]
    assert [e.fast.encode_ordinary(t) for t in plain] == [x.ids for x in e.exact.encode_batch(plain, add_special_tokens=False)]


# decontamination


def items_frame(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def leak_corpus(seed=2):
    rng = random.Random(seed)
    items = [(i, " ".join(some_words(rng, m))) for i, m in enumerate([5, 6, 8, 12, 20, 20, 35, 50, 80, 120])]
    items += [(90, items[4][1].upper()), (91, ""), (92, None), (93, "too short"), (94, " , . ")]
    docs = []
    for n in range(80):
        each = some_words(rng, rng.randint(0, 150))
        if n % 2:
            own = items[rng.randrange(10)][1].split()
            for _ in range(rng.randint(0, len(own) // 4)):
                own[rng.randrange(len(own))] = rng.choice(["changed", "CHANGED,", "new"])
            at = rng.randint(0, len(each))
            each = each[:at] + own + each[at:]
        docs.append((n, rng.choice([" ", "\n", "  \t"]).join(each), "en", "s", 0))
    return docs + [r for r in rows() if r[0] is None or r[0] > 100], items


def test_leaks_against_brute_force(spark):
    docs, items = leak_corpus()
    known = decontam.WordHashes()
    want = set()
    for d, t, *_ in docs:
        each = decontam.words(t, known)
        for i, text in items:
            item = decontam.words(text, known)
            if len(item) >= decontam.MIN_WORDS and len(each):
                edits, _ = decontam.least_edits(item, each)
                if edits <= decontam.edits_allowed(len(item), decontam.MAX_EDIT):
                    want.add((d, i, edits))
    got = {(None if r.k == -(1 << 63) else r.k, r.item_id, r.edits) for r in decontam.contaminated(frame(spark, docs), items_frame(spark, items)).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and {x for x in want if x[2] == 0} <= got
    assert len({x[1] for x in want}) >= 8


def test_recall_at_the_threshold():
    _, items = leak_corpus()
    index = decontam.build([(i, t) for i, t in items if t])
    rng, hits, total = np.random.default_rng(7), 0, 0
    for item in index.items:
        for _ in range(30):
            pad = rng.integers(1, 1 << 62, 40).astype(np.uint64)
            each = np.concatenate([pad[:20], decontam.edited(item.words, item.k, rng), pad[20:]])
            total += 1
            hits += any(decontam.shares_key(each, it, starts, kept) for it, starts, kept in decontam._clusters(each, index) if it is item)
    assert hits >= 0.95 * total


def test_long_items_are_found():
    rng = np.random.default_rng(12)
    index = decontam.build([(0, " ".join(some_words(random.Random(9), 800)))])
    item, known = index.items[0], decontam.WordHashes()
    for _ in range(15):
        pad = rng.integers(1, 1 << 62, 40).astype(np.uint64)
        each = np.concatenate([pad[:20], decontam.edited(item.words, item.k, rng), pad[20:]])
        found = [c for c in decontam._clusters(each, index)]
        assert found and any(decontam.shares_key(each, it, starts, kept) for it, starts, kept in found)
    assert decontam.walks_needed([(item.words, item.k)], 0.99, trials=20, most=1) == 0 and not known


def test_least_edits():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row)

    rng = np.random.default_rng(9)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 12)).astype(np.uint64), rng.integers(0, 4, rng.integers(1, 25)).astype(np.uint64)
        assert decontam.least_edits(a, b)[0] == plain(a.tolist(), b.tolist())


def test_blocks_of_items_make_no_difference(spark):
    docs, items = leak_corpus()
    a, b = ({tuple(r) for r in decontam.contaminated(frame(spark, docs), items_frame(spark, items), block_bytes=n).collect()} for n in (8 << 20, 700))
    assert {x[:4] for x in a if x[3] == 0} == {x[:4] for x in b if x[3] == 0}


def test_dropping_leaks(spark):
    docs, items = leak_corpus()
    df = frame(spark, docs).withColumn("item_id", F.lit("clash"))
    kept = decontam.drop_contaminated(df, items_frame(spark, items))
    bad = {r.k for r in decontam.contaminated(df, items_frame(spark, items)).collect()}
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d[0] for d in docs} - bad
    assert decontam.drop_contaminated(df, items_frame(spark, [])).count() == len(docs)
    assert decontam.drop_contaminated(frame(spark, []), items_frame(spark, items)).count() == 0


# fingerprints


@pytest.mark.parametrize("part_bytes", [4 << 20, 3000])
def test_fingerprints(spark, part_bytes):
    found = [r for r in rows() if not (r[0] is None and r[1] is None)]
    got = {r.doc_id: r for r in simhash.fingerprint_edits(frame(spark, found), part_bytes).collect()}
    order = sorted(found, key=lambda r: -(1 << 63) if r[0] is None else r[0], reverse=True)
    assert len(got) == len(found)
    for one, other in zip(order, order[1:] + order[:1], strict=True):
        text, following, r = one[1] or "", other[1] or "", got[one[0]]
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        own, edited, after = (simhash.fingerprint(t) for t in (text, new, following))
        assert (r.fingerprint, r.edited_fingerprint) == (own.tobytes().hex(), edited.tobytes().hex())
        assert r.near_edited == simhash.likeness(own, edited) and r.near_next == simhash.likeness(own, after)


def test_one_document_and_none(spark):
    one = simhash.fingerprint_edits(frame(spark, [(4, "abcdef", "", "", 6)])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one.near_next == 1
    assert simhash.fingerprint_edits(frame(spark, [])).count() == 0


def test_equal_ids_follow_each_other(spark):
    found = [(7, "bbbb", "", "", 4), (7, "aaaa", "", "", 4), (3, "cccc", "", "", 4), (7, "aaaa", "", "", 4)]
    got = [r.edited_sha256 for r in simhash.fingerprint_edits(frame(spark, found)).collect()]
    assert sorted(got) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in ("aaaa", "aabb", "bbcc", "ccaa"))


def test_likeness_tells_copies_from_others():
    rng = random.Random(1)
    each = some_words(rng, 300)
    near = each[:150] + ["other"] + each[151:]
    a, b, c = (simhash.fingerprint(" ".join(x)) for x in (each, near, some_words(rng, 300)))
    assert simhash.likeness(a, b) > 0.85 > 0.65 > simhash.likeness(a, c)


@pytest.mark.parametrize(("radius", "blocks", "held"), [(0, None, 2048), (3, None, 2), (7, None, 3), (5, 8, 2048), (12, 14, 2048)])
def test_radius_search_finds_all(spark, radius, blocks, held):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2, (20, 256))
    found = []
    for b in base:
        for n in (0, 1, 3, 4, 6, 12, 13):
            x = b.copy()
            x[rng.choice(256, n, replace=False)] ^= 1
            found.append(np.packbits(x.astype(np.uint8)).tobytes().hex())
    found += [found[0], None]
    texts = sorted({f for f in found if f})
    bits = [int(t, 16) for t in texts]
    want = {(a, b, (x ^ y).bit_count()) for i, (a, x) in enumerate(zip(texts, bits, strict=True)) for b, y in zip(texts[i + 1 :], bits[i + 1 :], strict=True) if (x ^ y).bit_count() <= radius}
    got = [tuple(r) for r in simhash.near_fingerprints(spark.createDataFrame([(f,) for f in found], "fingerprint string"), radius, blocks, held=held).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    rows = found * 2
    counts = {bytes(r["print"]).hex(): r["n_near"] for r in simhash.near_counts(spark.createDataFrame([(bytes.fromhex(f),) for f in rows if f], "print binary"), radius, blocks, held=held).collect()}
    assert counts == {t: sum(f is not None and (int(t, 16) ^ int(f, 16)).bit_count() <= radius for f in rows) - 1 for t in texts}


def test_query_counts_near_documents(spark, tmp_path):
    found = rows()
    frame(spark, found).write.parquet(str(tmp_path / "documents.parquet"))
    got = simhash.op1_simhash(spark, str(tmp_path)).collect()
    marks = [int(simhash.fingerprint(r[1] or "").tobytes().hex(), 16) for r in found]
    assert sorted((r.fingerprint, r.n_near) for r in got) == sorted((f"{m:064x}", sum((m ^ o).bit_count() <= simhash.RADIUS for o in marks) - 1) for m in marks)
    frame(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert simhash.op1_simhash(spark, str(tmp_path / "none")).collect() == []

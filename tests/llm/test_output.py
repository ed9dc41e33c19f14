"""Packing, training order, and the pipeline's stages."""

import zlib

import numpy as np
import pytest
from corpus import frame, rows, some
from hypothesis import given
from hypothesis import strategies as st

import corpus_pipeline
from pageloom.llm import _util, decontam, order, packing, tokens

sizes = st.lists(st.integers(1, 1023), min_size=1, max_size=120)


@given(sizes)
def test_best_fit_is_a_packing_within_its_bounds(found):
    lengths = np.array(found)
    bins, offsets, fill = packing.best_fit_decreasing(lengths, 1024)
    spans = {}
    for b, o, n in zip(bins.tolist(), offsets.tolist(), found, strict=True):
        spans.setdefault(b, []).append((o, n))
    for b, own in spans.items():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at == fill[b] <= 1024
    assert packing.lower_bound(lengths, 1024) <= len(fill)


@given(st.lists(st.integers(1, 10), min_size=1, max_size=7))
def test_lower_bound_never_exceeds_the_optimum(found):
    def fewest(items, bins):
        if not items:
            return len(bins)
        best = fewest(items[1:], [*bins, items[0]])
        for i, b in enumerate(bins):
            if b + items[0] <= 10:
                best = min(best, fewest(items[1:], [*bins[:i], b + items[0], *bins[i + 1 :]]))
        return best

    assert packing.lower_bound(np.array(found), 10) <= fewest(found, [])


def test_bounds_see_what_volume_misses():
    assert packing.lower_bound(np.array([600] * 10), 1024) == 10
    assert packing.lower_bound(np.array([400] * 9), 1000) == 5
    assert packing.lower_bound(np.array([], int), 1024) == 0


@pytest.mark.parametrize(("n", "want"), [(1, [(0, 1)]), (1024, [(0, 1024)]), (1025, [(0, 1), (1, 1024)]), (2048, [(0, 1024), (1024, 1024)]), (2500, [(0, 452), (452, 1024), (1476, 1024)])])
def test_pieces(n, want):
    assert packing.cut_pieces(n, 1024) == want


def ids_of(text):
    return np.array([*tokens.encoder(tokens.default_vocabulary()).exact.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


@pytest.mark.parametrize(("capacity", "part_items"), [(1024, 20_000), (64, 15)])
def test_packing(spark, capacity, part_items):
    found = rows()
    got = packing.pack(frame(spark, found), capacity, part_items=part_items, turns=6).collect()
    want = sorted((repr(d), k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for d, t, *_ in found for ids in [ids_of(t)] for k, (s, n) in enumerate(packing.cut_pieces(len(ids), capacity)))
    assert sorted((repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= capacity
    bound = packing.lower_bound(np.array([r.length for r in got]), capacity)
    assert len(by) <= bound + max(2, 0.03 * bound)


def test_exchange_closes_gaps(spark):
    # each part alone can't fill its last bins; together they can
    rng = np.random.default_rng(2)
    words = "the of and to in is was for on that"
    found = [(i, " ".join(rng.choice(words.split(), int(rng.integers(20, 45)))), "", "", 0) for i in range(120)]
    few, many = (packing.pack(frame(spark, found), 64, part_items=8, turns=t).select("sequence_id").distinct().count() for t in (6, 1))
    assert few <= many


def test_packing_nothing(spark):
    assert packing.pack(frame(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 100, 4097])
def test_permutation(n):
    p = order.Permutation(n, 11)
    slots = p.slots(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n)) and (p.numbers(slots) == np.arange(n)).all()
    if n > 50:
        assert (order.Permutation(n, 12).slots(np.arange(n)) != slots).mean() > 0.9


def expected(found, length, key):
    least = lambda d: -(1 << 63) if d is None else d
    made = [(d, k, n, ids[s : s + n]) for d, t, *_ in sorted(found, key=lambda r: least(r[0])) for ids in [ids_of(t)] for k, (s, n) in enumerate(packing.cut_pieces(len(ids), length))]
    slots = order.Permutation(len(made), key).slots(np.arange(len(made)))
    return {int(s): m for s, m in zip(slots, made, strict=True)}


@pytest.mark.parametrize(("length", "per_shard"), [(1024, 256), (16, 10)])
def test_shards_round_trip(spark, tmp_path, length, per_shard):
    found = [r for r in rows() if r[0] is not None]
    made = _util.materialize(order.shards(frame(spark, found), 5, length, per_shard))
    want = expected(found, length, 5)
    for s in made.collect():
        data = np.frombuffer(bytes(s["data"]), "<u2").reshape(s.records, length)
        assert s.stride == 2 * length and s.first_slot == s.shard * per_shard and s.crc32 == zlib.crc32(bytes(s["data"]))
        for i in range(s.records):
            d, k, n, ids = want[s.first_slot + i]
            assert (s.doc_id[i], s.piece[i], s.length[i]) == (d, k, n) and (data[i, :n] == ids).all() and (data[i, n:] == 2).all()
    assert made.agg({"records": "sum"}).first()[0] == len(want)
    got = order.records(made, first_slot=len(want) // 2).collect()
    assert {r.slot for r in got} == {s for s in want if s >= len(want) // 2}
    assert all(r.ids_crc32 == zlib.crc32(want[r.slot][3].tobytes()) and r.offset == r.slot % per_shard * 2 * length for r in got)
    per_file = 3
    whole = _util.materialize(order.shards(frame(spark, found), 5, length, per_shard, together=per_file))
    n = order.export(whole, str(tmp_path), per_file)
    files = sorted(tmp_path.glob("*.bin"))
    by_shard = [bytes(r["data"]) for r in made.orderBy("shard").collect()]
    assert n == len(files) == -(-len(by_shard) // per_file) and not list(tmp_path.glob("*.part"))
    assert [f.read_bytes() for f in files] == [b"".join(by_shard[i : i + per_file]) for i in range(0, len(by_shard), per_file)]
    files[0].write_bytes(b"cut short")
    order.export(whole, str(tmp_path), per_file)
    assert files[0].read_bytes() == b"".join(by_shard[:per_file])


def test_files_need_their_shards_together(spark, tmp_path):
    made = order.shards(frame(spark, [(i, "some text", "", "", 0) for i in range(40)]), length=16, per_shard=1)
    with pytest.raises(Exception, match="together=per_file"):
        order.export(made, str(tmp_path), 20)


def test_id_width_follows_the_vocabulary():
    assert [order.id_width(n) for n in (10, 50_257, 65_536, 65_537, 200_000)] == [2, 2, 2, 4, 4]


def test_order_of_equal_rows(spark):
    found = [(1, "same text", "", "", 0)] * 3 + [(1, "other", "", "", 0), (None, None, None, None, None)]
    got = order.records(order.shards(frame(spark, found))).collect()
    assert sorted(r.slot for r in got) == list(range(5))


def test_no_shards_of_nothing(spark):
    assert order.shards(frame(spark, [])).count() == 0


def test_pipeline_stages(spark, tmp_path):
    found = some()
    frame(spark, found["documents"]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(found["labels"], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(found["benchmark"], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = _util.materialize(stage(spark, docs, str(tmp_path)))
        seen[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in seen.items()}
    assert not ids["toxicity"] & found["toxic"] and found["clean"] <= ids["toxicity"]
    assert ids["line_dedup"] == ids["toxicity"]
    chunked = {r.doc_id: r for r in seen["line_dedup"].collect()}
    assert all(r.text is None or len(r.text) == r.n_chars for r in chunked.values())
    for group in found["copies"]:
        left = group & ids["line_dedup"]
        assert len(group & ids["ngram_jaccard_join"]) == (1 if left else 0) and min(left) in ids["ngram_jaccard_join"]
    assert not ids["benchmark_decontamination"] & found["leaks"]
    assert found["clean"] <= ids["best_fit_packing"] == ids["benchmark_decontamination"]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in whole.collect()} == ids["best_fit_packing"]
    assert corpus_pipeline.ORACLE_SQL is None and decontam.MIN_WORDS == 5


def test_least_by_hash_is_the_head_of_the_whole_order(spark):
    from pyspark.sql import functions as F

    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    want = [r.doc_id for r in df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(50).collect()]
    assert [r.doc_id for r in _util.least_by_hash(df, "doc_id", 50).collect()] == want
    assert _util.least_by_hash(df, "doc_id", 9000).count() == 5000 and _util.least_by_hash(df.limit(0), "doc_id", 5).count() == 0


def test_most_counted_cuts_no_tie(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate([100] * 5 + [50] * 20 + [1] * 300)], "w int, c long")
    assert [_util.most_counted(df, "c", n).count() for n in (0, 4, 5, 24, 25, 324, 325, 999)] == [0, 0, 5, 5, 25, 25, 325, 325]
    assert _util.most_counted(df.limit(0), "c", 5).count() == 0

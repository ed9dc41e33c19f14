"""Suffix-array, line, chunk and Jaccard dedup against brute force on small corpora."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from corpus import frame, rows
from pyspark.sql import functions as F

from pageloom.llm import graph, linechunks, linehash, partenum, suffix

LEAST = -(1 << 63)


def ordered(found):
    return sorted(found, key=lambda r: LEAST if r[0] is None else r[0])


# suffix arrays


def brute_bytes(found, length):
    seen, out = set(), []
    for doc, text, *_ in ordered(found):
        raw = (text or "").encode()
        hit = np.zeros(len(raw) + 1, int)
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                hit[p : p + length] = 1
            seen.add(s)
        gone = hit[:-1].astype(bool)
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((doc, len(raw), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("length", "gram", "most"), [(100, 16, 20_000), (100, 16, 1), (20, 8, 20_000), (20, 8, 2)])
def test_bytes(spark, length, gram, most):
    # a key may have one row only here: rows of one id have their own test
    found = [r for r in rows() if not (r[0] is None and r[1] is None)]
    got = [tuple(r) for r in suffix.dedup_bytes(frame(spark, found), length, gram, most).collect()]
    assert sorted(((*r[:5], bytes(r[5])) for r in got), key=repr) == brute_bytes(found, length)


def test_bytes_of_one_id(spark):
    long = "".join(chr(97 + ord(c) % 26) for c in hashlib.sha512(b"a").hexdigest() + hashlib.sha512(b"b").hexdigest())[:150]
    got = suffix.dedup_bytes(frame(spark, [(1, long, "", "", 0), (1, long, "", "", 0), (1, "y" + long, "", "", 0)])).collect()
    assert len(got) == 3 and sorted(r.n_removed for r in got) in ([0, 0, 150], [0, 150, 150])


def test_bytes_long_text_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", 1000)
    rng = np.random.default_rng(1)
    text = "".join(map(chr, rng.integers(97, 123, 5000)))
    found = [(1, text, "", "", 0), (2, "ab" + text[2500:4700] + "zz", "", "", 0)]
    assert [(r.doc_id, r.n_removed) for r in suffix.dedup_bytes(frame(spark, found)).orderBy("doc_id").collect()] == [(1, 0), (2, 2200)]


def test_longest_previous_is_exact():
    rng = np.random.default_rng(3)
    for length in (8, 9, 20, 100):
        data = np.concatenate([rng.integers(97, 99, 400).astype(np.uint8), np.tile(rng.integers(97, 99, 130).astype(np.uint8), 2)])
        begin = np.arange(len(data) - length + 1)
        position = rng.permutation(len(begin))
        strings = [bytes(data[b : b + length]) for b in begin]
        first = {}
        for s, p in zip(strings, position, strict=True):
            first[s] = min(first.get(s, p), p)
        got = suffix.longest_previous(np.append(data, np.zeros(length, np.uint8)), begin, position, length)
        assert got.tolist() == [bool(first[s] < p) for s, p in zip(strings, position, strict=True)]


def test_span_hashes_tell_regular_bytes_apart():
    """Thue-Morse strings and their complements, which cancel out in sums of powers of any base."""
    for bits in (7, 8, 10, 12):
        each = np.array([bin(i).count("1") % 2 for i in range(1 << bits)], np.uint8)
        data = np.concatenate([97 + each, 98 - each])
        windows, start, end = suffix._windows(data), np.array([0, 1 << bits]), np.array([1 << bits, 2 << bits])
        for which in (0, 1):
            a, b = (int(x) for x in suffix._span_hashes(windows, which, start, end))
            assert (a ^ b) & 0xFFFFFF and ((a ^ b) >> 24) & 0xFFFFFF
    rng = np.random.default_rng(1)
    some = rng.integers(0, 256, 500).astype(np.uint8)
    windows = suffix._windows(np.concatenate([some, [7, 7, 7], some]).astype(np.uint8))
    assert len({int(x) for x in suffix._span_hashes(windows, 0, np.array([0, 503]), np.array([500, 1003]))}) == 1


# runs of repeated sentences


def brute_runs(found):
    """Sentence by sentence, with an own idea of runs: a string of r (repeat), b (blank) and . (first) per document."""
    seen, out = set(), {}
    for doc, text, *_ in ordered(found):
        each = linehash.UNIT.findall(text or "")
        kinds = ""
        for u in each:
            normal = " ".join(u.lower().replace("\xa0", "~").split())
            kinds += "b" if not normal else "r" if normal in seen else "."
            seen.add(normal)
        gone = set()
        for m in re.finditer("[rb]+", kinds):
            n = sum(len(re.findall(f"[{linehash.UNSPACED}]|[^\\s{linehash.UNSPACED}]+", each[i].replace("\xa0", "~"))) for i in range(*m.span()) if kinds[i] == "r")
            if n >= linehash.MIN_WORDS or n and m.span() == (0, len(kinds)):
                gone |= set(range(*m.span()))
        out[doc] = ("".join(u for i, u in enumerate(each) if i not in gone) if text is not None else None, sum(len(each[i].encode()) for i in gone), len(re.findall("x+", "".join("x" if i in gone else " " for i in range(len(each))))))
    return out


def test_runs(spark):
    passage = "A first sentence of this passage. And then a second one that goes on for longer. Then a third!\nIt ends here, on its own line. Really."
    chinese = "这是一个没有空格的句子用来测试单词的计数方法是否正确"
    own = [f"intro a. {passage}", f"other b. {passage} tail", f"x {passage}", "Short and sweet.", "Other text. Short and sweet.", "Short and sweet.", f"甲{chinese}", f"乙.{chinese}", f"丙.{chinese}.", "   \n \n", "..", "..", f"{passage}\n\n  \n{passage}"]
    found = [r for r in rows() if not (r[0] is None and r[1] is None)] + [(20000 + i, t, "en", "s", 0) for i, t in enumerate(own)]
    want = brute_runs(found)
    got = {r.doc_id: r for r in linehash.dedup_units(frame(spark, found)).collect()}
    assert {d: (r.text, r.n_removed, r.n_spans) for d, r in got.items()} == want and any(x[1] for x in want.values())
    assert got[20004].n_removed == 0 and got[20005].text == "" and got[20001].text.startswith("other b.") and "passage" not in got[20001].text
    texts = {d: t for d, t, *_ in found}
    for d, r in got.items():
        spans = [(s.start, s.end) for s in r.spans]
        assert all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False)) and (r.text is None or linehash.cut(texts[d], spans) == (r.text, r.n_removed))


def test_units_keep_offsets_and_columns(spark):
    a = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty."
    df = frame(spark, [(1, a, "en", "s", 1), (2, f"Start here. {a.upper()}  Rest.", "en", "s", 2)]).withColumn("spans", F.lit("clash")).withColumn("k", F.lit(1)).withColumn("h", F.lit(2))
    got = linehash.dedup_units(df).orderBy("doc_id").collect()
    assert [(s.start, s.end) for s in got[1].spans] == [(11, 12 + len(a))] and got[1].text == "Start here.  Rest." and got[1].source == "s"


def test_units_hot_line_is_settled_in_the_task(spark):
    line = "the very same line in all texts"
    got = linehash.dedup_units(frame(spark, [(i, line, "", "", 0) for i in range(500)])).filter("n_removed = 0").collect()
    assert [r.doc_id for r in got] == [0]


# chunks of lines


def brute_chunks(found, long_line):
    seen, out = set(), {}
    for doc, text, *_ in ordered(found):
        each, kept, chunk, gone = (text or "").split("\n"), [], [], 0
        h = [0, 0, *(int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in each)]
        for i, line in enumerate(each):
            chunk.append(line)
            last = i == len(each) - 1
            if last or (h[i + 2] + 31 * h[i + 1] + 961 * h[i]) % linechunks.DIVISOR == 0 or long_line and max(len(line), len(each[i + 1])) >= long_line:
                if tuple(chunk) in seen and (len(chunk) > 1 or chunk[0].strip()):
                    gone += 1
                else:
                    kept += chunk
                seen.add(tuple(chunk))
                chunk = []
        out[doc] = ("\n".join(kept) if gone else text, gone)
    return out


@pytest.mark.parametrize("long_line", [None, linechunks.LONG])
def test_chunks(spark, long_line):
    line = " ".join(f"w{i}" for i in range(50))
    found = [r for r in rows(n=60) if not (r[0] is None and r[1] is None)] + [(20000 + i, t, "en", "s", 0) for i, t in enumerate([f"a1\n{line}\nb1", "one line", f"a2\n{line}\nb2", "one line", line])]
    got = {r.doc_id: r for r in linechunks.dedup_line_chunks(frame(spark, found), counts=True, long_line=long_line).collect()}
    want = brute_chunks(found, long_line)
    assert {d: (r.text, r.n_removed_chunks) for d, r in got.items()} == want and any(x[1] for x in want.values())
    assert all(r.n_removed_lines < r.n_lines or r.text == "" for r in got.values() if r.n_removed_chunks)
    if long_line:
        assert got[20002].text == "a2\nb2" and got[20003].text == got[20004].text == ""
        first = {}
        for doc, text, *_ in ordered(found):
            if (text or "").strip() and first.setdefault(text, doc) != doc:
                assert not got[doc].text.strip()


def test_fully_repeated_rows_are_one_document(spark):
    found = [(1, "a\nb\nc d e", "en", "s", 0)] * 2 + [(2, "x\ny", "en", "s", 0)]
    got = linechunks.dedup_line_chunks(frame(spark, found), counts=True).collect()
    assert sorted((r.doc_id, r.text, r.n_removed_chunks) for r in got) == [(1, "a\nb\nc d e", 0)] * 2 + [(2, "x\ny", 0)]


def test_chunk_boundaries_resist_shifts():
    lines = [f"line {i}" for i in range(50)]
    cuts = lambda x: {tuple(c) for c in _cut(x)}
    before, after = cuts(lines), cuts(["new"] + lines)
    assert len(before - after) <= 3


def _cut(lines):
    text = "\n".join(lines)
    out, chunk = [], []
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in text.split("\n")]
    for i, line in enumerate(lines):
        chunk.append(line)
        if (h[i] + 31 * (h[i - 1] if i else 0) + 961 * (h[i - 2] if i > 1 else 0)) % linechunks.DIVISOR == 0:
            out.append(chunk)
            chunk = []
    return [*out, chunk]


# Jaccard


def brute_components(found):
    sets = {}
    for doc, text, *_ in found:
        w = (text or "").encode().lower().split()
        sets[doc] = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    docs = sorted(sets, key=lambda d: LEAST if d is None else d)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)), key=lambda d: LEAST if d is None else d)
                parent[y] = x
    return {(d, len(sets[d]), root(d)) for d in docs}


def near_copies(n, edits, seed=5, size=120):
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 10**6, size)]
    out = []
    for i in range(n):
        each = list(base)
        for p in rng.choice(size, edits, replace=False):
            each[p] = f"e{i}x{p}"
        out.append((1000 + i, " ".join(each), "en", "s", 0))
    return out


@pytest.mark.parametrize(("cluster", "bucket", "held"), [(3000, 4000, 1 << 20), (7, 5, 1 << 20), (7, 4, 9)])
def test_components(spark, monkeypatch, cluster, bucket, held):
    for name, value in (("CLUSTER", cluster), ("BUCKET", bucket), ("HELD", held)):
        monkeypatch.setattr(partenum, name, value)
    found = [r for r in rows() if not (r[0] is None and r[1] is None)] + near_copies(40, 2) + [(5000 + r[0], *r[1:]) for r in near_copies(30, 4, 6)] + [(9000 + r[0], *r[1:]) for r in near_copies(30, 3, 7, 60)]
    got = {(None if r.k == LEAST else r.k, r.n, None if r.component_id == LEAST else r.component_id) for r in partenum.jaccard_components(frame(spark, found)).collect()}
    want = brute_components(found)
    assert got == want and len({c for _, _, c in want}) < len(want)


def test_one_of_each_group_stays(spark):
    found = [(5, "a b c d e f", "x", "y", 1), (2, "A B C D E F", "x", "y", 1), (9, "", "", "", 0), (10, "", "", "", 0), (2, "A B C D E F", "x", "y", 1)]
    got = partenum.keep_one_of_each(frame(spark, found)).collect()
    assert sorted(r.doc_id for r in got) == [2, 9, 10]


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(2)
    for size in (1, 2, 4, 5, 9, 30, 77, 200, 1000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            b = a.copy()
            while True:  # edit as far as the two still link
                c = np.unique(np.append(np.delete(b, rng.integers(len(b))), rng.integers(0, 1 << 63, 1 if rng.random() < 0.7 else 0, dtype=np.uint64))) if len(b) else b
                common = len(np.intersect1d(a, c))
                if not len(c) or 100 * common < 80 * (len(a) + len(c) - common):
                    break
                b = c
            frequent = np.sort(a[: len(a) // 2])
            assert np.array_equal(a, b) or len(np.intersect1d(partenum.signatures(a, frequent), partenum.signatures(b, frequent)))
            assert partenum.LEAST[-1] > size and len(partenum.signatures(a, frequent)) <= 0.6 * size + 40


def test_a_common_passage_makes_few_buckets_of_all():
    """500 words of 650 in common, likeness 0.62, no link: own features come first, so most signatures are a set's own."""
    rng, n = np.random.default_rng(11), 300
    common = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    signed = [np.unique(partenum.signatures(np.unique(np.append(common, rng.integers(0, 1 << 63, 150, dtype=np.uint64))), np.sort(common))) for _ in range(n)]
    shared = np.unique(np.concatenate(signed), return_counts=True)[1] > n / 2
    assert shared.sum() <= 100 and sum(len(x) for x in signed) / n > 250


def test_sets_of_one_name_are_told_apart(spark):
    a, b = np.array([1, 2, 3], np.uint64), np.array([4], np.uint64)
    one, two = partenum._digest(a, 0), partenum._digest(a, 1)
    assert partenum.set_id(a) == one and partenum.set_id(a, frozenset([one])) == two and partenum.set_id(b, frozenset([one])) == partenum._digest(b, 0)
    members = spark.createDataFrame([(5, 1), (5, 1), (6, 1), (6, 2), (7, 3)], "id long, other long")
    assert partenum._shared_names(members) == {6}


def test_blocks_connect_as_the_whole_does():
    rng = np.random.default_rng(6)
    base = [np.unique(rng.integers(0, 1 << 63, 60, dtype=np.uint64)) for _ in range(6)]
    sets = [np.unique(np.append(rng.choice(base[i % 6], 57, replace=False), rng.integers(0, 1 << 63, 2, dtype=np.uint64))) for i in range(30)]
    ids, sizes, sketches = list(range(30)), [len(x) for x in sets], [partenum.parity_sketch(x).tobytes() for x in sets]

    def groups(pairs):
        root = list(range(30))
        for _ in range(30):
            for x, y in pairs:
                root[x] = root[y] = min(root[x], root[y])
        return root

    blocks = [range(0, 12), range(12, 24), range(24, 30)]
    apart = [p for i, x in enumerate(blocks) for y in blocks[i:] for own in [[*x] if x == y else [*x, *y]] for p in partenum._may_link([ids[j] for j in own], [sizes[j] for j in own], [sketches[j] for j in own], 80, None if x == y else np.array([j in y for j in own]))]
    assert groups(apart) == groups(partenum._may_link(ids, sizes, sketches, 80))


def test_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 300)), dtype=np.uint64))
        b = np.unique(np.append(rng.choice(a, len(a) // 2, replace=False), rng.integers(0, 1 << 63, int(rng.integers(1, 300)), dtype=np.uint64)))
        x, y = partenum.parity_sketch(a), partenum.parity_sketch(b)
        size = min(len(x), len(y))
        apart = int(np.bitwise_count(partenum._fold(x, size) ^ partenum._fold(y, size)).sum())
        assert apart <= len(np.setxor1d(a, b))


def test_graph(spark):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(500, 540)] + [(1000, i) for i in range(1001, 1100)] + [(None, 3)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    links = defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            links[a].add(b)
            links[b].add(a)
    want = {}
    for start in sorted(links):
        stack = [start] if start not in want else []
        while stack:
            x = stack.pop()
            if x not in want:
                want[x] = start
                stack += links[x]
    assert got == want


@pytest.mark.parametrize("make", [suffix.dedup_bytes, linehash.dedup_units, linechunks.dedup_line_chunks, partenum.jaccard_components, partenum.keep_one_of_each])
def test_empty_tables(spark, make):
    assert make(frame(spark, [])).count() == 0


import pytest
from pyspark.sql import functions as F

from pageloom.operators import slices, split, traininglog
from pageloom.plans import dataset
from pageloom.sources import readers, writers

SOURCE = '''
ANN = {
    "a b.png": [("reaction_scheme", 0.125, 0.25, 0.875, 0.5), ("chemical_structure", 0.1, 0.3, 0.3, 0.45)],
    "none.png": [("arrow", 0.1, 0.1, 0.2, 0.2)],
    "lost.png": [("reaction_scheme", 0.1, 0.1, 0.2, 0.2)],
}
ANN["late.PNG"] = [("chemical_structure", 0.1, 0.1, 0.2, 0.2)]
'''


def test_literal_annotations_run_nothing():
    found = readers.literal_annotations(SOURCE)
    assert list(found) == ["a b.png", "none.png", "lost.png", "late.PNG"]
    with pytest.raises(ValueError):
        readers.literal_annotations("ANN = open('x')")


def test_dataset(spark, tmp_path):
    pictures = tmp_path / "pictures"
    pictures.mkdir()
    for name in ("a b.png", "none.png", "late.PNG", "notes.txt"):
        (pictures / name).write_bytes(b"x")
    ann = tmp_path / "ann.py"
    ann.write_text(SOURCE)
    made = dataset.build(readers.annotation_file(spark, str(ann)), readers.images_by_name(spark, str(pictures)))
    assert [r.filename for r in made.missing.collect()] == ["lost.png"]
    texts = {r.stem: r.text for r in made.labels.collect()}
    assert texts == {"a_b": "1 0.500000 0.375000 0.750000 0.250000\n0 0.200000 0.375000 0.200000 0.150000\n", "none": "", "late": "0 0.150000 0.150000 0.100000 0.100000\n"}
    counts = {(r["what"], r["name"]): r["n"] for r in made.counts.collect()}
    assert counts[("images", "val")] == 1 and counts[("images", "train")] == 2
    assert counts[("boxes", "reaction_scheme")] == 1 and counts[("boxes", "chemical_structure")] == 2 and counts[("missing", "lost.png")] == 1
    out = tmp_path / "out"
    (out / "labels/val").mkdir(parents=True)
    (out / "labels/val/stale.txt").write_text("0 0 0 0 0\n")
    dataset.write(made, str(out))
    assert sorted(p.stem for p in out.glob("labels/*/*.txt")) == ["a_b", "late", "none"]
    back = readers.label_files(spark, str(out / "labels"))
    assert {(r.stem, r.line_no, r.cls) for r in back.collect()} == {("a_b", 1, 1), ("a_b", 2, 0), ("late", 1, 0)}
    assert "nc: 2\nnames: ['chemical_structure', 'reaction_scheme']\n" in (out / "data.yaml").read_text()


def test_no_pair_is_an_error(spark):
    ann = readers.annotations(spark, {"a.png": [("reaction_scheme", 0, 0, 1, 1)]})
    with pytest.raises(ValueError):
        dataset.build(ann, spark.createDataFrame([("b.png", "/b.png")], "name string, path string"))


@pytest.mark.parametrize(("n", "share", "val"), [(0, 0.2, 0), (1, 0.2, 1), (2, 0.2, 1), (43, 0.2, 9), (25, 0.5, 12)])
def test_validation_size(n, share, val):
    assert split.validation_size(n, share) == val


def test_shuffle_split_is_a_partition():
    names = [f"f{i}" for i in range(43)]
    train, val = split.seeded_shuffle_split(names)
    assert len(val) == 9 and sorted(train + val) == sorted(names) and split.seeded_shuffle_split(names) == (train, val)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 500])
def test_hash_split_equals_global_ranking(spark, n):
    import hashlib

    got = {r.id: r.split for r in split.hash_split(spark.range(n), "id").collect()}
    order = sorted(range(n), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    assert {i for i, s in got.items() if s == "val"} == set(order[: split.validation_size(n, 0.2)]) and len(got) == n


def test_leakage(spark):
    rows = [("train", "a"), ("val", "a"), ("train", "b"), ("val", "c")]
    assert [r.stem for r in split.overlap(spark.createDataFrame(rows, "split string, stem string")).collect()] == ["a"]


def test_stem_collision_is_counted(spark):
    images = spark.createDataFrame([("x.png", "train"), ("x.jpg", "train")], "name string, split string")
    boxes = spark.createDataFrame([], "name string, ord int, cls int, cx double, cy double, w double, h double")
    assert [(r.stem, r.n_collisions) for r in writers.label_texts(images, boxes).collect()] == [("x", 1)]


def test_training_log(spark, tmp_path):
    lines = ["epoch, time, train/box_loss, train/cls_loss, train/dfl_loss, metrics/precision(B), metrics/recall(B), metrics/mAP50(B), metrics/mAP50-95(B), val/box_loss, val/cls_loss, val/dfl_loss, lr/pg0, lr/pg1, lr/pg2"]
    for i, m in enumerate([0.1, 0.3, 0.2, 0.3, 0.25, 0.5], 1):
        lines.append(f"  {i},{i}.5,1,1,1,0.5,0.5,0.5, {m},1,1,1,0,0,0")
    (tmp_path / "results.csv").write_text("\n".join(lines) + "\n")
    log = readers.training_log(spark, str(tmp_path / "results.csv")).withColumnRenamed("metrics/mAP50-95(B)", "m").selectExpr("1 AS run", "epoch", "m")
    assert traininglog.best_and_patience(log, ["run"], "epoch", "m").first().asDict() == {"run": 1, "best": 0.5, "best_at": 6, "longest_wait": 3}
    tie = log.filter("epoch < 6")
    assert traininglog.best_and_patience(tie, ["run"], "epoch", "m").first().best_at == 2


@pytest.mark.parametrize("parts", [1, 7])
def test_progress_over_ranges(spark, parts):
    """Against a plain loop: several ranges per series, null keys, a rising series and a constant one."""
    import random

    rng = random.Random(4)
    series = {"a": [rng.random() for _ in range(300)], "up": list(range(200)), "flat": [1.0] * 50, None: [rng.randint(0, 9) for _ in range(80)], "one": [3.0]}
    found = [(k, i, float(v)) for k, vs in series.items() for i, v in enumerate(vs)]
    rng.shuffle(found)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(found, "s string, i int, m double")
        got = {r.s: (r.best, r.best_at, r.longest_wait) for r in traininglog.best_and_patience(df, ["s"], "i", "m").collect()}
        numbers = {(r.s, r.i): r.ord for r in slices.numbered(df, ["s"], [F.col("i").desc()], "ord").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    for k, vs in series.items():
        best, wait, longest = None, 0, 0
        for v in vs:
            if best is None or v > best:
                best, wait = v, 0
            else:
                wait += 1
            longest = max(longest, wait)
        assert got[k] == (best, vs.index(best), longest)
        assert all(numbers[k, i] == len(vs) - i for i in range(len(vs)))


def test_long_file_lists_are_split_by_digest(spark, monkeypatch):
    monkeypatch.setattr(dataset, "EXACT_FILES", 3)
    ann = readers.annotations(spark, {f"{i}.png": [("reaction_scheme", 0, 0, 1, 1)] for i in range(10)})
    images = spark.createDataFrame([(f"{i}.png", f"/{i}.png") for i in range(10)], "name string, path string")
    made = dataset.build(ann, images)
    assert {r.filename: r.split for r in made.images.collect()} == {r.filename: r.split for r in split.hash_split(ann.select("filename"), "filename").collect()}


def test_label_lines(spark):
    texts = spark.createDataFrame([("/x/train/a b.txt", "1 0.5 0.25  0.5 0.5\r\n\n 0 1 1 1 1 \n"), ("/x/val/e.txt", "")], "path string, text string")
    assert [tuple(r) for r in readers.label_lines(texts).orderBy("line_no").collect()] == [("train", "a b", 1, 1, 0.5, 0.25, 0.5, 0.5), ("train", "a b", 2, 0, 1.0, 1.0, 1.0, 1.0)]

import pytest

from pageloom.plans import backends, queries, stages
from pageloom.plans.config import Config
from pageloom.sources import readers, writers
from pageloom.streaming import ingest

PAGES = [
    (1, "/p/1.png", b"Plain page with 5V\n1 0.9 0 0 10.25 10 heat 80C\n0 0.8 1 1 2 2 ring\n1 0.1 0 0 1 1 faint\n1 0.7 0 0 3 3 stir 2h"),
    (2, "/p/2.png", b"null"),
    (3, "/p/3.png", b"TURN me 7A"),
]


class FailingDetector(backends.FakeDetector):
    def detect(self, image):
        if image == b"null":
            raise ValueError("no detector")
        return super().detect(image)


class SmilesOf:
    def recognise(self, image):
        if image == b"ring":
            return "C1CC1"
        raise ValueError("not a ring")


def bundle(spark, **options):
    pages = spark.createDataFrame(PAGES, "page_id long, path string, content binary")
    made = stages.run_pages(pages, Config(), options.pop("ocr", backends.FakeOcr), FailingDetector, options.pop("llm", backends.FakeLlm), options.pop("structure", SmilesOf), **options)
    return {r.page_id: r for r in made.collect()}


def test_whole_pipeline(spark, tmp_path):
    kept = []

    def keep(df, stage):
        kept.append(stage)
        return spark.read.parquet(writers.stage_output(df, str(tmp_path), stage))

    got = bundle(spark, keep=keep)
    assert kept == ["1_page_ocr", "2_detections", "3_scheme_ocr", "3b_ocsr", "4_ner", "5_summary", "run"]
    one = got[1]
    assert [d.cls for d in one.detections] == ["reaction_scheme", "chemical_structure", "reaction_scheme"] and one.detections[0].xyxy[2] == 10.2
    assert [s.natural_text for s in one.scheme_ocr] == ["heat 80C", "stir 2h"]
    assert [s.smiles for s in one.structures] == ["C1CC1"]
    assert {"5V", "80C", "2h"} <= {e.text for e in one.entities} and {e.source for e in one.entities} == {"page+scheme"}
    assert one.summary.goal == "Plain page with 5V" and one.summary.confidence == 0.5
    assert got[2].page_ocr.natural_text is None and got[2].detection_error == "no detector" and got[2].detections == []
    assert got[3].page_ocr.is_rotation_valid is True  # read a second time, turned
    assert one.page_ocr.file == "1.png" and set(one.capabilities.asDict()) == {"rdkit", "PIL", "yaml"}
    again = spark.read.parquet(f"{tmp_path}/run_id=run/5_summary").filter("page_id = 1").select(writers.report("summary").alias("r")).first().r
    assert again == "Untitled\nGoal: Plain page with 5V\nConditions:\n  {\"n\": 1}\nConfidence: 0.50"


class Counting:
    """Notes every call in a folder, so that calls in any worker count."""

    def __init__(self, folder, inner, name):
        self.folder, self.inner, self.name = folder, inner, name

    def _note(self):
        import uuid

        open(f"{self.folder}/{self.name}-{uuid.uuid4().hex}", "w").close()

    def read(self, *a, **k):
        self._note()
        return self.inner.read(*a, **k)

    def detect(self, image):
        self._note()
        return self.inner.detect(image)

    def names(self):
        return self.inner.names()

    def answer(self, system, prompt, schema):
        self.name = "entities" if "entities" in system else "summary"
        self._note()
        return self.inner.answer(system, prompt, schema)


@pytest.mark.parametrize("run_dir", [None, "runs"])
def test_each_model_call_is_made_once(spark, tmp_path, run_dir):
    """Stages are written unless told otherwise: 10 pages of one scheme each."""
    notes = tmp_path / "notes"
    notes.mkdir()
    folder = str(notes)
    pages = spark.createDataFrame([(i, f"/p/{i}.png", f"page {i}\n1 0.9 0 0 1 1 heat {i}h".encode()) for i in range(10)], "page_id long, path string, content binary")
    config = Config(run_dir=run_dir and str(tmp_path / run_dir))
    made = stages.run_pages(pages, config, lambda: Counting(folder, backends.FakeOcr(), "read"), lambda: Counting(folder, backends.FakeDetector(), "detect"), lambda: Counting(folder, backends.FakeLlm(), "answer"), backends.NoStructures)
    assert made.count() == 10 and made.filter("size(scheme_ocr) = 1").count() == 10
    calls = [p.name.split("-")[0] for p in notes.iterdir()]
    assert {n: calls.count(n) for n in set(calls)} == {"read": 20, "detect": 10, "entities": 10, "summary": 10}
    if run_dir:
        assert {p.name for p in (tmp_path / "runs/run_id=run").iterdir()} == {"1_page_ocr", "2_detections", "3_scheme_ocr", "3b_ocsr", "4_ner", "5_summary", "run"}


def test_retry_can_be_switched_off(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, path string, content binary")
    made = stages.run_pages(pages, Config(rotate_retry=False), backends.FakeOcr, FailingDetector, backends.FakeLlm)
    assert {r.page_id: r.page_ocr.is_rotation_valid for r in made.collect()} == {1: True, 2: True, 3: False}


def test_command_line_runs(spark, tmp_path, capsys):
    from pageloom.plans import pages

    (tmp_path / "a b.png").write_bytes(b"first 3g\n1 0.9 0 0 1 1 stir")
    (tmp_path / "note.txt").write_bytes(b"no")
    pages.main([f"{tmp_path}/*", "--run-dir", str(tmp_path / "out")], ocr=backends.FakeOcr, detector=backends.FakeDetector, llm=backends.FakeLlm)
    assert capsys.readouterr().out.startswith("Untitled\nGoal: first 3g\n")
    row = spark.read.parquet(str(tmp_path / "out/run_id=run/run")).first()
    assert row.page_ocr.file == "a b.png" and row.structures is None and [x.natural_text for x in row.scheme_ocr] == ["stir"]


def test_structures_off_and_bad_answers(spark):
    got = bundle(spark, structure=None, llm=lambda: backends.FakeLlm(broken=True))
    assert got[1].structures is None and got[1].entities == [] and got[1].entities_error == "no JSON found"
    assert got[1].summary.goal.startswith("[synthesis failed: ") and got[1].summary.confidence == 0.0


def test_failed_transcription_is_one_row(spark):
    class Down:
        def read(self, image, prompt, turn=0):
            if image.startswith(b"Plain"):
                raise RuntimeError("down")
            return image.decode()

    got = bundle(spark, ocr=Down)
    assert got[1].page_ocr.error == "down" and got[1].page_ocr.natural_text is None
    assert got[3].page_ocr.error is None and len(got) == 3


def test_default_structures_are_null(spark):
    got = bundle(spark, structure=backends.NoStructures)
    assert [s.smiles for s in got[1].structures] == [None]


@pytest.mark.parametrize(("failures", "attempts", "waits", "ok"), [(0, 4, [], True), (3, 4, [1, 2, 4], True), (4, 4, [1, 2, 4, 8], False), (7, 7, [1, 2, 4, 8, 16, 20, 20], False), (0, 0, [], False)])
def test_retries(failures, attempts, waits, ok):
    slept, left = [], [failures]

    def call():
        if left[0]:
            left[0] -= 1
            raise OSError("busy")
        return None

    if ok:
        assert backends.with_retries(call, attempts, slept.append) == ""
    else:
        with pytest.raises(RuntimeError):
            backends.with_retries(call, attempts, slept.append)
    assert slept == waits


def test_crop_order(spark, tmp_path):
    for name in ("b/page-10.png", "b/page-2.JPG", "a/x.tif", "a/y.webp"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = readers.crops(spark, [str(tmp_path / "b"), str(tmp_path / "a")], content=False).orderBy("dir_ord", "ord").collect()
    assert [(r["cls"], r["name"]) for r in got] == [("b", "page-10.png"), ("b", "page-2.JPG"), ("a", "y.webp")]


def test_crop_order_of_equal_paths(spark, tmp_path):
    """Pages of one address are numbered by page, however they are dealt."""
    pages = [(n, "https://a/x") for n in range(0, 800, 4)] + [(1, "https://a/b")]
    spark.createDataFrame(pages[::-1], "page_id long, url string").repartition(7).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.ord for r in queries.q16_crop_order(spark, str(tmp_path)).collect()}
    assert got == {1: 1} | {n: n // 4 + 2 for n in range(0, 800, 4)}


def test_crop_order_of_odd_pages(spark, tmp_path):
    """As the query's SQL has it: negative ids, no url, no id, and a carriage return in what is cut off."""
    pages = [(-1, "https://a/1"), (-2, "https://a/2"), (-3, "https://a/3"), (-4, "https://a/4"), (1, "https://b?x\ry"), (8, "https://f\n?q\nr")]
    pages += [(0, None), (None, "https://n"), (2, "https://gone"), (3, "http://c# z"), (4, ""), (7, "HTTPS://e")]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {(r.dir_ord, r.ord): (r.page_id, r.path) for r in queries.q16_crop_order(spark, str(tmp_path)).collect()}
    first = [(-1, "https://a/1.webp"), (-2, "https://a/2.webp"), (-3, "https://a/3.webp"), (-4, "https://a/4.png"), (1, "https://b.JPG"), (8, "https://f\n?q\nr.png")]
    second = [(4, ".png"), (7, "HTTPS://e.webp"), (3, "http://c.webp"), (0, None)]
    assert got == {(0, i): x for i, x in enumerate(first, 1)} | {(1, i): x for i, x in enumerate(second, 1)}


def test_command_lines():
    assert readers.page_arguments(["p.png"]).ocsr is False and Config().recognise_structures is True
    a = readers.dataset_arguments(["--images", "i", "--ann", "a", "--out", "o"])
    assert (a.val_frac, a.seed) == (0.2, 42)


def test_stream_reads_each_file_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.png").write_bytes(b"one")

    def run():
        q = ingest.transcribe_stream(ingest.page_stream(spark, str(folder)), backends.FakeOcr, "read", str(tmp_path / "out"), str(tmp_path / "state"))
        q.awaitTermination(60)

    run()
    (folder / "2.png").write_bytes(b"two")
    (folder / "skip.txt").write_bytes(b"no")
    run()
    assert sorted(r.natural_text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["one", "two"]

import pytest
from pyspark.sql import functions as F

from pageloom.functions import text

FRONT = [
    ("---\nis_table: true\n---\n# T", True, "# T", "# T"),
    ("  hello ", False, "hello", "hello"),
    ("---\nx: 1\n---junk", True, "junk", "junk"),
    ("---\n---\nzz", False, "---\n---\nzz", "---\n---\nzz"),
    ("---\n\n---\nzz", True, "zz", "zz"),
    ("---\n: [bad\n---\nb", True, "b", "b"),
    ("---\n- a\n---\nb", True, "b", "b"),
    ("---\nis_table: true\n---\n NULL ", True, "NULL", None),
    ("---\nis_table: true\n---\n", True, "", ""),
]


def test_front_matter(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(FRONT)], "i int, raw string").withColumn("f", text.front_matter("raw"))
    got = df.select("i", "f.matched", "f.body", text.natural_text("f.body").alias("n")).orderBy("i").collect()
    assert [(r.matched, r.body, r.n) for r in got] == [r[1:] for r in FRONT]


def test_front_matter_of_null(spark):
    df = spark.createDataFrame([(None,)], "raw string").select(text.front_matter("raw").alias("f"))
    assert df.first().f.matched is False and df.first().f.body is None


@pytest.mark.parametrize(
    ("valid", "angle", "retry"),
    [("false", "90", True), ("false", "270", True), ("false", "45", False), ("false", '"90"', False), ('"false"', "90", False), ("true", "90", False), ("null", "90", False), ("false", "90.0", True)],
)
def test_rotation_retry(valid, angle, retry):
    assert text.read_meta(f"is_rotation_valid: {valid}\nrotation_correction: {angle}")["retry"] is retry


def test_meta_types():
    m = text.read_meta("primary_language: no\nis_table: true")
    assert m["primary_language"] is None and m["type_error"] and m["is_table"] is True
    assert text.read_meta(": [bad")["error"]
    assert text.read_meta("- a") == text.read_meta("") == text.read_meta(None)


def test_names(spark):
    names = ["Screenshot 7.44.32 PM.png", "é.PNG", "a  b\tc.jpg", "x.png", "x.jpg", "plain", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = df.select("i", text.norm_name("n").alias("norm"), text.safe_stem("n").alias("stem")).orderBy("i").collect()
    assert [r.norm for r in got] == ["Screenshot 7.44.32 PM.png", "é.PNG", "a b c.jpg", "x.png", "x.jpg", "plain", None]
    assert [r.stem for r in got] == ["Screenshot_7.44.32_PM", "é", "a_b_c", "x", "x", "plain", None]


def test_assembly(spark):
    rows = [(0, "P", ["A", None, "C"]), (1, None, ["A"]), (2, "P", []), (3, "P", None)]
    df = spark.createDataFrame(rows, "i int, page string, s array<string>")
    got = df.select("i", text.entity_context("page", "s").alias("c"), text.or_none(text.scheme_blob("s")).alias("b")).orderBy("i").collect()
    assert [r.c for r in got] == ["P\n\nA\n\n\n\nC", "\n\nA", "P\n\n", "P\n\n"]
    assert [r.b for r in got] == ["[scheme 1]\nA\n\n[scheme 3]\nC", "[scheme 1]\nA", "[none]", "[none]"]


def test_json_keeps_nulls(spark):
    df = spark.range(1).select(text.to_json_all(F.struct(F.lit(None).cast("string").alias("a"), F.lit("é").alias("b"))).alias("j"))
    assert df.first().j == '{"a":null,"b":"é"}'

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageloom.functions import records

SALVAGE = [
    ('{"a":1}', {"a": 1}, None),
    ("42", 42, None),
    ('x ```json {"a":1} ``` y', {"a": 1}, None),
    ('```JSON {"a":1} ```', {"a": 1}, None),
    ('```python x``` {"a":1}', None, "no JSON found"),
    ('Sure: {"a":{"b":[1]}} ok', {"a": {"b": [1]}}, None),
    ('Sure: {"a":"}"} ok', {"a": "}"}, None),
    ('[note] {"a":1}', None, "decode error"),
    ('note {"a":"x\\"y"} end', {"a": 'x"y'}, None),
    ('note {"a":"x\\"}\\"z"} end', {"a": 'x"}"z'}, None),
    ('note {"a":1', None, "unbalanced"),
    ("no json", None, "no JSON found"),
    ('{"a":1,"a":2}', {"a": 2}, None),
    ('{"a":1,}', None, "decode error"),
    ('{"a":NaN}', None, "decode error"),
    ("", None, "no JSON found"),
    (None, None, "no JSON found"),
]


@pytest.mark.parametrize(("raw", "value", "error"), SALVAGE)
def test_salvage(raw, value, error):
    assert records.salvage(raw) == (value, error)


def test_salvage_column(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(SALVAGE)], "i int, raw string")
    got = df.select("i", records.salvage_json("raw").alias("s")).orderBy("i").collect()
    assert [(json.loads(r.s.json) if r.s.json else None, r.s.error) for r in got] == [r[1:] for r in SALVAGE]


values = st.recursive(st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=10)


@given(values)
def test_salvage_round_trip(value):
    raw = json.dumps(value)
    if "```" not in raw:
        assert records.salvage(raw) == (value, None)


@given(st.dictionaries(st.text(), values))
def test_salvage_in_prose(value):
    raw = json.dumps(value)
    if "```" not in raw:
        assert records.salvage(f"Here you are: {raw} Done.") == (value, None)


@pytest.mark.parametrize(
    ("raw", "confidence", "goal"),
    [
        ('{"goal":"g","confidence":"0.5"}', 0.5, "g"),
        ('{"goal":"g","confidence":true}', 1.0, "g"),
        ('{"goal":"g","confidence":1.5}', 0.0, None),
        ('{"goal":"g","confidence":"nan"}', 0.0, None),
        ("{}", 0.0, None),
        ('{"goal":5}', 0.0, None),
        ('{"goal":"g","procedure":null}', 0.0, None),
        ('{"goal":"g","procedure":"x"}', 0.0, None),
        ('{"goal":"g","procedure":[1]}', 0.0, None),
        ('{"goal":"g","other":1}', 0.0, "g"),
        ('["goal"]', 0.0, None),
        ("prose", 0.0, None),
    ],
)
def test_summary(raw, confidence, goal):
    s = records.read_summary(raw)
    assert s["confidence"] == confidence
    assert s["goal"] == goal if goal else s["goal"].startswith("[synthesis failed: ")
    assert (s["error"] is None) == (goal is not None)


def test_entities(spark):
    good = {"text": "5 V", "label": "WIDGET"}
    cases = [{"entities": [good] * 9 + [{"label": "OTHER"}]}, {"entities": [good, good | {"source": ""}, good | {"smiles": ""}]}, {"entities": [good | {"source": None}]}, {}]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)], "i int, raw string")
    got = df.withColumn("f", records.entities_of("raw")).select("i", records.finish_entities(F.col("f.entities"), "page+scheme").alias("e"), "f.rejected", "f.error").orderBy("i").collect()
    assert [len(r.e) for r in got] == [0, 3, 0, 0]
    assert [x.source for x in got[1].e] == ["page", "page+scheme", "page"] and got[1].e[2].smiles is None
    assert got[0].rejected == 10 and got[0].error == "missing field" and got[3].error is None


def test_empty_input(spark):
    df = spark.createDataFrame([], "raw string").select(records.summary_of("raw").alias("s"), records.entities_of("raw").alias("e"))
    assert df.count() == 0


def test_structures_of_entities_are_validated(monkeypatch):
    monkeypatch.setattr(records, "canonical_smiles", lambda x: {"C1CC1": "canonical"}.get(x))
    answer = '{"entities": [{"text": "a", "label": "CHEMICAL", "smiles": "C1CC1"}, {"text": "b", "label": "CHEMICAL", "smiles": "bad"}, {"text": "c", "label": "X"}]}'
    assert [e["smiles"] for e in records.read_entities(answer)["entities"]] == ["canonical", None, None]

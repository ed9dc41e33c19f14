"""JSON out of model answers: salvage, strict validation, fallbacks. One Arrow UDF each; parsing is strict Python JSON."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom import schemas
from pageloom.functions.text import canonical_smiles

FENCE = re.compile(r"```(?:json)?(.*?)```", re.DOTALL)


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


_STRICT = json.JSONDecoder(parse_constant=_no_constant)


def salvage(text: str | None):
    """(value, None) or (None, error). The first fence's content replaces the text for good; what is not JSON as a whole is
    read from its first bracket on, and only from that one."""
    text = (text or "").strip()
    fenced = FENCE.search(text)
    if fenced:
        text = fenced[1].strip()
    try:
        return _STRICT.decode(text), None
    except ValueError:
        pass
    at = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if at < 0:
        return None, "no JSON found"
    try:
        return _STRICT.raw_decode(text, at)[0], None
    except json.JSONDecodeError as e:
        return None, "unbalanced" if e.pos >= len(text) or e.msg.startswith("Unterminated") else "decode error"
    except ValueError:
        return None, "decode error"


@F.pandas_udf(schemas.SALVAGED)
def salvage_json(texts: pd.Series) -> pd.DataFrame:
    """Duplicate keys are settled (the last wins) before the text becomes a VARIANT."""
    found = [salvage(t) for t in texts]
    return pd.DataFrame({"json": [None if e else json.dumps(v, ensure_ascii=False) for v, e in found], "error": [e for _, e in found]}, dtype="object")


class Invalid(ValueError):
    pass


def _text(value, required: bool = False):
    if value is None and not required or isinstance(value, str):
        return value
    raise Invalid("not a string")


def _texts(value) -> list[str]:
    if not isinstance(value, list):
        raise Invalid("not a list")
    return [_text(x, True) for x in value]


def _number(value, low: float, high: float) -> float:
    if not isinstance(value, (int, float, str)):
        raise Invalid("not a number")
    try:
        number = float(value)
    except ValueError:
        raise Invalid("not a number") from None
    if math.isnan(number) or not low <= number <= high:
        raise Invalid("out of range")
    return number


def _object(value) -> dict:
    if not isinstance(value, dict):
        raise Invalid("not an object")
    return value


def valid_entity(value) -> dict:
    """An entity's fields; its structure is validated on the way."""
    e = _object(value)
    if "text" not in e or "label" not in e:
        raise Invalid("missing field")
    return {"text": _text(e["text"], True), "label": _text(e["label"], True), "normalized": _text(e.get("normalized")), "smiles": canonical_smiles(_text(e.get("smiles"))), "source": _text(e.get("source", "page"), True)}


def valid_entities(value) -> list[dict]:
    """All or nothing: one bad entity spoils the list."""
    found = _object(value).get("entities", [])
    if not isinstance(found, list):
        raise Invalid("not a list")
    return [valid_entity(e) for e in found]


def valid_material(value) -> dict:
    m = _object(value)
    if "name" not in m or "role" not in m:
        raise Invalid("missing field")
    return {"name": _text(m["name"], True), "role": _text(m["role"], True)} | {n: _text(m.get(n)) for n in ("amount", "concentration", "smiles")}


def valid_summary(value) -> dict:
    s = _object(value)
    if "goal" not in s:
        raise Invalid("missing field")
    materials = s.get("materials", [])
    if not isinstance(materials, list):
        raise Invalid("not a list")
    return {
        "run_id": _text(s.get("run_id")),
        "title": _text(s.get("title")),
        "goal": _text(s["goal"], True),
        "conditions": json.dumps(_object(s.get("conditions", {})), ensure_ascii=False),
        "procedure": _texts(s.get("procedure", [])),
        "results": _texts(s.get("results", [])),
        "materials": [valid_material(m) for m in materials],
        "conclusions": _text(s.get("conclusions")),
        "uncertainties": _texts(s.get("uncertainties", [])),
        "confidence": _number(s.get("confidence", 0.0), 0.0, 1.0),
        "error": None,
    }


def fallback_summary(error: str) -> dict:
    return {"run_id": None, "title": None, "goal": f"[synthesis failed: {error}]", "conditions": "{}", "procedure": [], "results": [], "materials": [], "conclusions": None, "uncertainties": [], "confidence": 0.0, "error": error}


def read_entities(text: str | None) -> dict:
    """Entities of a model's answer; any fault gives none, with the error and the number given up."""
    value, error = salvage(text)
    if error:
        return {"entities": [], "rejected": 0, "error": error}
    try:
        return {"entities": valid_entities(value), "rejected": 0, "error": None}
    except Invalid as e:
        given = value.get("entities") if isinstance(value, dict) else None
        return {"entities": [], "rejected": len(given) if isinstance(given, list) else 0, "error": str(e)}


def read_summary(text: str | None) -> dict:
    """A summary of a model's answer, or the fallback that says why there is none."""
    value, error = salvage(text)
    if error:
        return fallback_summary(error)
    try:
        return valid_summary(value)
    except Invalid as e:
        return fallback_summary(str(e))


@F.pandas_udf(schemas.ENTITIES)
def entities_of(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_entities(t) for t in texts], columns=schemas.ENTITIES.names)


@F.pandas_udf(schemas.SUMMARY)
def summary_of(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_summary(t) for t in texts], columns=schemas.SUMMARY.names)


def finish_entities(entities: Column, source: str) -> Column:
    """An entity's empty source becomes the caller's, an empty structure null."""
    return F.transform(entities, lambda e: F.struct(e["text"].alias("text"), e["label"].alias("label"), e["normalized"].alias("normalized"), F.nullif(e["smiles"], F.lit("")).alias("smiles"), F.when(e["source"] == "", F.lit(source)).otherwise(e["source"]).alias("source")))

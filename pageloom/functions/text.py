"""Text functions with the exact semantics that page records need; built-ins except where Spark has none."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom import schemas

#: Front matter between a first line of dashes and the next line that begins with them; the rest is the body.
FRONT_MATTER = r"(?sU)\A\s*---\s*\n(.*?)\n---\s*\n?(.*)"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Trim every kind of white space, not just the space."""
    return F.regexp_replace(_col(c), r"(?U)\A\s+|\s+\z", "")


def or_none(c: str | Column, default: str = "[none]") -> Column:
    """Null and empty become a placeholder."""
    return F.coalesce(F.nullif(_col(c), F.lit("")), F.lit(default))


def front_matter(c: str | Column) -> Column:
    """struct(matched, meta_text, body): no match gives an empty meta text and the whole stripped text."""
    raw = _col(c)
    matched = raw.rlike(FRONT_MATTER)
    # regexp_extract gives '' where nothing matches, so the match is tested on its own
    meta = F.when(matched, F.regexp_extract(raw, FRONT_MATTER, 1)).otherwise(F.lit(""))
    body = strip(F.when(matched, F.regexp_extract(raw, FRONT_MATTER, 2)).otherwise(raw))
    return F.struct(F.coalesce(matched, F.lit(False)).alias("matched"), meta.alias("meta_text"), body.alias("body"))


def natural_text(body: str | Column) -> Column:
    """The sentinel body 'null' becomes null; an empty body stays empty."""
    b = _col(body)
    return F.when(F.lower(strip(b)) != "null", b)


def _load_yaml(text: str):
    try:
        import yaml
    except ImportError:  # flat "key: value" lines cover what page records hold
        words = {"true": True, "false": False, "null": None, "": None}
        pairs = (line.split(":", 1) for line in text.splitlines() if ":" in line)
        return {k.strip(): words.get(v.strip().lower(), int(v) if v.strip().lstrip("-").isdigit() else v.strip().strip("'\"")) for k, v in pairs}
    return yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))


def read_meta(text: str | None) -> dict:
    """The typed fields of front matter. Values of another type become null and raise type_error; retry tells whether the
    page should be read again after turning it: validity is literally false and the angle one of 90, 180, 270."""
    out = dict.fromkeys(schemas.META.names) | {"retry": False, "type_error": False}
    try:
        found = _load_yaml(text or "")
    except Exception as e:  # noqa: BLE001 - any YAML error leaves the fields empty
        return out | {"error": type(e).__name__}
    if not isinstance(found, dict):
        return out
    kinds = {"primary_language": str, "is_rotation_valid": bool, "rotation_correction": (int, float), "is_table": bool, "is_diagram": bool}
    for name, kind in kinds.items():
        value = found.get(name)
        if value is None:
            continue
        if not isinstance(value, kind) or name == "rotation_correction" and isinstance(value, bool):
            out["type_error"] = True
        else:
            out[name] = value
    angle = out["rotation_correction"]
    out["retry"] = out["is_rotation_valid"] is False and angle in (90, 180, 270)
    out["rotation_correction"] = int(angle) if angle is not None and angle == angle and abs(angle) < 1 << 31 else None
    return out


@F.pandas_udf(schemas.META)
def meta_fields(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_meta(t) for t in texts], columns=schemas.META.names).astype({"rotation_correction": "Int32"})


@F.pandas_udf(schemas.STR)
def _nfc(names: pd.Series) -> pd.Series:
    return names.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def norm_name(c: str | Column) -> Column:
    """NFC, then every run of white space is one space; no trimming and no folding of case."""
    return F.regexp_replace(_nfc(_col(c)), r"(?U)\s+", " ")


def safe_stem(c: str | Column) -> Column:
    """A file's name without its extension, white space runs as underscores; of the name as it is on disk."""
    return F.regexp_replace(F.regexp_replace(_col(c), r"(?<=.)\.[^.]*\z", ""), r"(?U)\s+", "_")


def extension(c: str | Column) -> Column:
    """The lower-case extension of a path, '' if it has none."""
    return F.lower(F.regexp_extract(_col(c), r"\.([^./]*)\z", 1))


def entity_context(page: str | Column, schemes: str | Column) -> Column:
    """A page's text and its schemes', blank lines between; empty schemes keep their separators."""
    texts = F.transform(F.coalesce(_col(schemes), F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")))
    return F.concat(F.coalesce(_col(page), F.lit("")), F.lit("\n\n"), F.array_join(texts, "\n\n"))


def scheme_blob(schemes: str | Column) -> Column:
    """Numbered schemes; blank ones are left out but counted. Nothing to show gives ''."""
    numbered = F.transform(_col(schemes), lambda x, i: F.struct((i + 1).alias("i"), x.alias("x")))
    shown = F.filter(numbered, lambda s: F.coalesce(s["x"], F.lit("")) != "")
    return F.array_join(F.transform(shown, lambda s: F.concat(F.lit("[scheme "), s["i"].cast("string"), F.lit("]\n"), s["x"])), "\n\n")


def to_json_all(c: str | Column) -> Column:
    """JSON with nulls kept."""
    return F.to_json(_col(c), {"ignoreNullFields": "false"})


def canonical_smiles(text: str | None) -> str | None:
    """Empty becomes null. With RDKit installed a structure is made canonical or null, else it passes as it is."""
    if not text:
        return None
    try:
        from rdkit import Chem
    except ImportError:
        return text
    found = Chem.MolFromSmiles(text)
    return Chem.MolToSmiles(found) if found else None


def validate_smiles(c: str | Column) -> Column:
    """canonical_smiles of a column; a built-in where RDKit is not installed."""
    if not capabilities()["rdkit"]:
        return F.nullif(_col(c), F.lit(""))

    @F.pandas_udf(schemas.STR)
    def canonical(texts: pd.Series) -> pd.Series:
        return texts.map(canonical_smiles, na_action="ignore")

    return canonical(_col(c))


def capabilities() -> dict[str, bool]:
    """Which optional packages the records were made with."""
    found = {}
    for name in ("rdkit", "PIL", "yaml"):
        try:
            __import__(name)
            found[name] = True
        except ImportError:
            found[name] = False
    return found



"""Declared schemas of the records that the engine reads and makes."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


STR, INT, LONG, DBL, BOOL = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()

OCR_RESULT = _struct(file=STR, primary_language=STR, is_rotation_valid=BOOL, rotation_correction=INT, is_table=BOOL, is_diagram=BOOL, natural_text=STR, raw=STR, error=STR)
META = _struct(primary_language=STR, is_rotation_valid=BOOL, rotation_correction=INT, is_table=BOOL, is_diagram=BOOL, retry=BOOL, type_error=BOOL, error=STR)
DETECTION = _struct(cls=STR, conf=DBL, xyxy=T.ArrayType(DBL))
STRUCTURE_RESULT = _struct(file=STR, smiles=STR, error=STR)
QUANTITY = _struct(value=DBL, unit=STR, text=STR)
ENTITY = _struct(text=STR, label=STR, normalized=STR, smiles=STR, source=STR)
ENTITIES = _struct(entities=T.ArrayType(ENTITY), rejected=INT, error=STR)
MATERIAL = _struct(name=STR, role=STR, amount=STR, concentration=STR, smiles=STR)
SALVAGED = _struct(json=STR, error=STR)
#: ``conditions`` is JSON text here; queries turn it into a VARIANT with try_parse_json.
SUMMARY = _struct(run_id=STR, title=STR, goal=STR, conditions=STR, procedure=T.ArrayType(STR), results=T.ArrayType(STR), materials=T.ArrayType(MATERIAL), conclusions=STR, uncertainties=T.ArrayType(STR), confidence=DBL, error=STR)
ANNOTATION = _struct(filename=STR, file_ord=INT, ord=INT, label=STR, x0=DBL, y0=DBL, x1=DBL, y1=DBL)
BOX_LABEL = _struct(split=STR, stem=STR, line_no=INT, cls=INT, cx=DBL, cy=DBL, w=DBL, h=DBL)
TRAINING_LOG = T.StructType(
    [T.StructField("epoch", INT), T.StructField("time", DBL)]
    + [T.StructField(n, DBL) for n in ("train/box_loss", "train/cls_loss", "train/dfl_loss", "metrics/precision(B)", "metrics/recall(B)", "metrics/mAP50(B)", "metrics/mAP50-95(B)", "val/box_loss", "val/cls_loss", "val/dfl_loss", "lr/pg0", "lr/pg1", "lr/pg2")]
)

# The vocabularies that results must agree with.
ENTITY_LABELS = ("CHEMICAL", "FORMULA", "SOLVENT", "SALT", "ADDITIVE", "ELECTRODE", "AMOUNT", "CONCENTRATION", "TEMPERATURE", "TIME", "CURRENT_DENSITY", "POTENTIAL", "CAPACITY", "CURRENT", "EQUIPMENT", "SAMPLE_ID", "MEASUREMENT", "OTHER")
BOX_CLASSES = ("chemical_structure", "reaction_scheme")
PAGE_EXTENSIONS = ("png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff")
CROP_EXTENSIONS = ("png", "jpg", "jpeg", "webp")

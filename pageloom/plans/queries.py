"""Registered queries over the driver's tables. The tables hold no page images, so each query derives its input from columns
that are there, and its SQL derives the same."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom import schemas
from pageloom.functions import boxes, records, text
from pageloom.operators import detections, match, split, traininglog
from pageloom.plans import page_queries, stages
from pageloom.plans.backends import with_retries
from pageloom.plans.tables import BOXES_SQL, LINE, corner_boxes, read
from pageloom.sources import readers

def q01_box_normalize(spark, sf_dir):
    return boxes.normalize(corner_boxes(spark, sf_dir), schemas.BOX_CLASSES)


Q01 = f"WITH {BOXES_SQL} SELECT * FROM boxes"


def q02_box_class_counts(spark, sf_dir):
    return match.counts_by_class(q01_box_normalize(spark, sf_dir), (*schemas.BOX_CLASSES, "table"))


Q02 = f"""WITH {BOXES_SQL}, known(label, class_id) AS (VALUES ('chemical_structure', 0), ('reaction_scheme', 1), ('table', 2))
SELECT k.label, k.class_id, count(b.label) AS boxes FROM known k LEFT JOIN boxes b USING (label) GROUP BY k.label, k.class_id"""


def _named(spark, sf_dir):
    """Files whose names differ in white space on both sides of the match."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Shot "), F.col("doc_id").cast("string"), F.lit(".png")).alias("filename"))
    labels = read(spark, sf_dir, "labels").select(F.concat(F.lit("Shot "), F.col("doc_id").cast("string"), F.lit(".png")).alias("name"), "quality")
    return docs, labels


def q03_annotation_match(spark, sf_dir):
    return match.matched(*_named(spark, sf_dir)).select("doc_id", "norm", "quality")


Q03 = "SELECT d.doc_id, 'Shot ' || d.doc_id || '.png' AS norm, l.quality FROM documents d JOIN labels l USING (doc_id)"


def q04_annotation_missing(spark, sf_dir):
    return match.missing(*_named(spark, sf_dir)).select("doc_id")


Q04 = "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"


def q05_split_leakage(spark, sf_dir):
    ids = read(spark, sf_dir, "documents").select("doc_id")
    return split.leakage(split.hash_split(ids, "doc_id", seed=42), split.hash_split(ids, "doc_id", seed=7), "doc_id")


_SPLIT = "row_number() OVER (ORDER BY md5('{seed}:' || doc_id), doc_id) <= greatest(1, round_even(count(*) OVER () * 0.2, 0))"
Q05 = f"WITH s AS (SELECT doc_id, {_SPLIT.format(seed=42)} AS a, {_SPLIT.format(seed=7)} AS b FROM documents) SELECT doc_id FROM s WHERE NOT a AND b"


def q06_split_train_val(spark, sf_dir):
    return split.hash_split(read(spark, sf_dir, "documents").select("doc_id"), "doc_id")


Q06 = f"SELECT doc_id, CASE WHEN {_SPLIT.format(seed=42)} THEN 'val' ELSE 'train' END AS split FROM documents"


def q07_name_normalize(spark, sf_dir):
    name = F.concat("source", F.lit("  \t"), "lang", F.lit("é"), F.col("doc_id").cast("string"), F.lit(".PNG"))
    return read(spark, sf_dir, "documents").select("doc_id", name.alias("name")).select("doc_id", text.norm_name("name").alias("norm"), text.safe_stem("name").alias("stem"), text.extension("name").alias("ext"))


Q07 = r"""WITH n AS (SELECT doc_id, source || chr(8239) || ' ' || chr(9) || lang || 'e' || chr(769) || doc_id || '.PNG' AS name FROM documents)
SELECT doc_id, regexp_replace(nfc_normalize(name), '[\s\p{Z}]+', ' ', 'g') AS norm, regexp_replace(regexp_replace(name, '\.[^.]*$', ''), '[\s\p{Z}]+', '_', 'g') AS stem, 'png' AS ext FROM n"""


def _told(flag: str) -> Column:
    return F.coalesce(F.col(flag).cast("string"), F.lit("unknown")).alias(flag.rsplit(".", 1)[-1])


# The parts of a page's front matter and of a model's answer, dealt by an id, so that they meet in all combinations.
VALID = ("false", "true", "false", '"false"', "false", "null", "no", "0")
ANGLE = ("90", "180", "45", '"90"', "270", "null", "90.0", "-90")


def _pick(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _pick_sql(values: tuple[str, ...], n: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][({n}) % {len(values)} + 1]"


def _div(column: str, by: int) -> Column:
    return F.floor(F.col(column) / by)


def _raw_pages(spark, sf_dir):
    text_ = F.coalesce("text", F.lit(""))
    body = F.when(F.col("doc_id") % 11 == 5, F.lit("\n NULL ")).otherwise(text_)
    raw = F.concat(F.lit('---\nprimary_language: "'), "lang", F.lit('"\nis_rotation_valid: '), _pick(VALID, F.col("doc_id")), F.lit("\nrotation_correction: "), _pick(ANGLE, _div("doc_id", 8)), F.lit("\nis_table: false\n---\n"), body)
    return read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 13 == 7, text_).otherwise(raw).alias("raw"))


RAW_SQL = rf"""raw AS (
  SELECT doc_id, CASE WHEN doc_id % 13 = 7 THEN coalesce(text, '') ELSE '---' || chr(10) || 'primary_language: "' || lang || '"' || chr(10) || 'is_rotation_valid: ' || {_pick_sql(VALID, "doc_id")} || chr(10)
    || 'rotation_correction: ' || {_pick_sql(ANGLE, "doc_id // 8")} || chr(10) || 'is_table: false' || chr(10) || '---' || chr(10) || CASE WHEN doc_id % 11 = 5 THEN chr(10) || ' NULL ' ELSE coalesce(text, '') END END AS raw
  FROM documents
), cut AS (
  SELECT doc_id, regexp_matches(raw, '(?s)\A\s*---\s*\n.*?\n---') AS matched, regexp_extract(raw, '(?s)\A\s*---\s*\n(.*?)\n---\s*\n?(.*)', 1) AS meta,
         CASE WHEN regexp_matches(raw, '(?s)\A\s*---\s*\n.*?\n---') THEN regexp_extract(raw, '(?s)\A\s*---\s*\n(.*?)\n---\s*\n?(.*)', 2) ELSE raw END AS body
  FROM raw
), fields AS (
  SELECT doc_id, matched, regexp_replace(body, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS body, nullif(regexp_extract(meta, 'primary_language: "([^"]*)"', 1), '') AS primary_language,
         nullif(regexp_extract(meta, 'is_table: (\w*)', 1), '') AS is_table, regexp_extract(meta, 'is_rotation_valid: ([^\n]*)', 1) AS v, regexp_extract(meta, 'rotation_correction: ([^\n]*)', 1) AS a
  FROM cut
), typed AS (
  SELECT *, CASE WHEN v IN ('true', 'yes', 'on') THEN true WHEN v IN ('false', 'no', 'off') THEN false END AS valid, TRY_CAST(a AS DOUBLE) AS angle,
         v NOT IN ('true', 'yes', 'on', 'false', 'no', 'off', 'null', '') OR TRY_CAST(a AS DOUBLE) IS NULL AND a NOT IN ('null', '') AS type_error
  FROM fields
)"""


def q08_front_matter(spark, sf_dir):
    parsed = _raw_pages(spark, sf_dir).withColumn("f", text.front_matter("raw")).withColumn("meta", text.meta_fields("f.meta_text"))
    return parsed.select("doc_id", F.col("f.matched").alias("matched"), "meta.primary_language", _told("meta.is_table"), "meta.type_error", text.natural_text("f.body").alias("natural_text"))


Q08 = f"""WITH {RAW_SQL}
SELECT doc_id, matched, primary_language, coalesce(is_table, 'unknown') AS is_table, type_error, CASE WHEN lower(body) <> 'null' THEN body END AS natural_text FROM typed"""


def q09_rotation_retry(spark, sf_dir):
    parsed = _raw_pages(spark, sf_dir).withColumn("meta", text.meta_fields(text.front_matter("raw")["meta_text"]))
    return parsed.select("doc_id", _told("meta.is_rotation_valid"), F.coalesce("meta.rotation_correction", F.lit(-1)).alias("rotation_correction"), "meta.retry")


Q09 = f"""WITH {RAW_SQL}
SELECT doc_id, coalesce(valid::VARCHAR, 'unknown') AS is_rotation_valid, coalesce(trunc(angle), -1)::INT AS rotation_correction, coalesce(NOT valid AND angle IN (90, 180, 270), false) AS retry FROM typed"""


def q10_json_salvage(spark, sf_dir):
    n = F.col("event_id") % 8
    raw = F.when(n == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nDone."))).when(n == 1, F.concat(F.lit("Sure, "), "props", F.lit(" as asked"))).when(n == 2, F.col("props"))
    raw = raw.when(n == 3, F.expr("substring(props, 1, length(props) - 1)")).when(n == 4, F.concat(F.lit("[note] "), "props")).when(n == 5, F.concat(F.lit("```\nno\n``` "), "props"))
    raw = raw.when(n == 6, F.concat(F.lit("  "), F.col("event_id").cast("string"), F.lit(" "))).otherwise(F.concat("event_type", F.lit(" to see")))
    found = read(spark, sf_dir, "events").select("event_id", records.salvage_json(raw).alias("s"))
    value = F.try_parse_json("s.json")
    return found.select("event_id", F.coalesce(F.try_variant_get(value, "$.k", "bigint"), F.try_variant_get(value, "$", "bigint"), F.lit(-1)).alias("k"), F.col("s.error").alias("error"))


Q10 = r"""WITH raw AS (
  SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'Here:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' || chr(10) || 'Done.' WHEN 1 THEN 'Sure, ' || props || ' as asked' WHEN 2 THEN props
    WHEN 3 THEN substr(props, 1, length(props) - 1) WHEN 4 THEN '[note] ' || props WHEN 5 THEN '```' || chr(10) || 'no' || chr(10) || '``` ' || props WHEN 6 THEN '  ' || event_id || ' ' ELSE event_type || ' to see' END AS raw FROM events
), cut AS (
  SELECT event_id, trim(CASE WHEN regexp_matches(raw, '(?s)```.*?```') THEN regexp_extract(raw, '(?s)```(?:json)?(.*?)```', 1) ELSE raw END, chr(10) || ' ') AS t FROM raw
), placed AS (
  SELECT *, least(nullif(strpos(t, '{'), 0), nullif(strpos(t, '['), 0)) AS place FROM cut
), part AS (
  SELECT *, CASE WHEN json_valid(t) THEN t WHEN place IS NULL THEN NULL ELSE regexp_extract(substr(t, place), '^(\{[^{}]*\}|\[[^\[\]]*\])') END AS j FROM placed
)
SELECT event_id, CASE WHEN json_valid(j) THEN coalesce(CAST(json_extract(j, '$.k') AS BIGINT), TRY_CAST(j AS BIGINT), -1) ELSE -1 END AS k,
CASE WHEN j IS NULL THEN 'no JSON found' WHEN j = '' THEN 'unbalanced' WHEN NOT json_valid(j) THEN 'decode error' END AS error FROM part"""

# parts of a summary: each is left out, right, or wrong in its own way
GOAL = ('"goal": "g"', '"goal": "h"', '"goal": 5', "")
SURE = ("", '"confidence": "0.5"', '"confidence": true', '"confidence": "high"')
STEPS = ('"procedure": ["a", "b"]', '"procedure": null', "", '"procedure": [1]', "")
STUFF = ("", '"materials": [{"name": "a", "role": "b"}]', '"materials": [{"name": "a"}]', '"materials": {}', "", "")


def q11_validation_verdict(spark, sf_dir):
    number = F.concat(F.lit('"confidence": '), F.floor(F.col("event_id") % 150 / 100).cast("string"), F.lit("."), F.lpad((F.col("event_id") % 150 % 100).cast("string"), 2, "0"))
    sure = F.when(F.col("event_id") % 2 == 0, number).otherwise(_pick(SURE, _div("event_id", 2)))
    parts = F.filter(F.array(_pick(GOAL, _div("event_id", 3)), sure, _pick(STEPS, _div("event_id", 12)), _pick(STUFF, _div("event_id", 60)), F.lit('"extra": 1')), lambda x: x != "")
    made = F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))
    raw = F.when(F.col("event_id") % 97 == 3, F.concat(F.lit("["), made, F.lit("]"))).otherwise(made)
    judged = read(spark, sf_dir, "events").select("event_id", records.summary_of(raw).alias("s"))
    return judged.select("event_id", "s.goal", "s.confidence", F.size("s.procedure").alias("steps"), F.size("s.materials").alias("materials"), F.col("s.error").alias("error"))


Q11 = f"""WITH made AS (
  SELECT event_id, '{{' || array_to_string(list_filter([{_pick_sql(GOAL, "event_id // 3")}, CASE WHEN event_id % 2 = 0 THEN '"confidence": ' || (event_id % 150 // 100) || '.' || lpad((event_id % 150 % 100)::VARCHAR, 2, '0') ELSE {_pick_sql(SURE, "event_id // 2")} END,
    {_pick_sql(STEPS, "event_id // 12")}, {_pick_sql(STUFF, "event_id // 60")}, '"extra": 1'], lambda x: x <> ''), ', ') || '}}' AS j FROM events
), answer AS (
  SELECT event_id, CASE WHEN event_id % 97 = 3 THEN '[' || j || ']' ELSE j END AS j FROM made
), kinds AS (
  SELECT event_id, j, json_type(j) AS whole, json_type(j, '$.goal') AS goal, json_type(j, '$.procedure') AS steps, json_type(j, '$.materials') AS stuff, json_type(j, '$.confidence') AS sure,
         CASE json_type(j, '$.confidence') WHEN 'BOOLEAN' THEN CAST(json_extract(j, '$.confidence') AS BOOLEAN)::INT::DOUBLE ELSE TRY_CAST(json_extract_string(j, '$.confidence') AS DOUBLE) END AS number FROM answer
), judged AS (
  SELECT *, CASE WHEN whole <> 'OBJECT' THEN 'not an object' WHEN goal IS NULL THEN 'missing field' WHEN stuff IS NOT NULL AND stuff <> 'ARRAY' THEN 'not a list' WHEN goal <> 'VARCHAR' THEN 'not a string'
    WHEN steps IS NOT NULL AND steps <> 'ARRAY' THEN 'not a list' WHEN len(list_filter(json_extract(j, '$.procedure[*]'), lambda x: json_type(x) <> 'VARCHAR')) > 0 THEN 'not a string'
    WHEN len(list_filter(json_extract(j, '$.materials[*]'), lambda x: json_extract(x, '$.name') IS NULL OR json_extract(x, '$.role') IS NULL)) > 0 THEN 'missing field'
    WHEN sure IS NOT NULL AND number IS NULL THEN 'not a number' WHEN number < 0 OR number > 1 THEN 'out of range' END AS error FROM kinds
)
SELECT event_id, CASE WHEN error IS NULL THEN json_extract_string(j, '$.goal') ELSE '[synthesis failed: ' || error || ']' END AS goal, CASE WHEN error IS NULL THEN coalesce(number, 0.0) ELSE 0.0 END AS confidence,
CASE WHEN error IS NULL THEN coalesce(json_array_length(j, '$.procedure'), 0) ELSE 0 END::INT AS steps, CASE WHEN error IS NULL THEN coalesce(json_array_length(j, '$.materials'), 0) ELSE 0 END::INT AS materials, error FROM judged"""


def _turns(spark, sf_dir):
    """Conversations as pages: the first turn is the page, the others its schemes; every third is blank."""
    shown = F.when(F.col("turn") % 3 == 2, F.lit("")).otherwise(F.coalesce("text", F.lit("")))
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", shown.alias("text"))
    listed = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return turns.groupBy("conv_id").agg(listed.alias("all")).select("conv_id", F.col("all")[0]["text"].alias("page"), F.transform(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), lambda x: x["text"]).alias("schemes"))


TURNS_SQL = """turns AS (
  SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN '' ELSE coalesce(text, '') END AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations
)"""


def q12_ner_context(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", text.entity_context("page", "schemes").alias("context"))


Q12 = f"""WITH {TURNS_SQL}
SELECT conv_id, max(text) FILTER (WHERE r = 1) || chr(10) || chr(10) || coalesce(string_agg(text, chr(10) || chr(10) ORDER BY r) FILTER (WHERE r > 1), '') AS context FROM turns GROUP BY conv_id"""


def q13_scheme_blob(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", text.or_none(text.scheme_blob("schemes")).alias("blob"))


Q13 = f"""WITH {TURNS_SQL}
SELECT conv_id, coalesce(string_agg('[scheme ' || (r - 1) || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY r) FILTER (WHERE r > 1 AND text <> ''), '[none]') AS blob FROM turns GROUP BY conv_id"""


def q14_entity_explode(spark, sf_dir):
    number = F.transform(F.regexp_extract_all("text", F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda x: F.struct(x.alias("text"), F.lit("MEASUREMENT").alias("label"), F.lit(None).cast("string").alias("normalized"), F.lit("").alias("smiles"), F.lit("").alias("source")))
    mail = F.transform(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._]+@[A-Za-z0-9.]+"), F.lit(0)), lambda x: F.struct(x.alias("text"), F.lit("OTHER").alias("label"), F.lower(x).alias("normalized"), F.lit("").alias("smiles"), F.lit("page").alias("source")))
    found = read(spark, sf_dir, "documents").select("doc_id", records.finish_entities(F.concat(number, mail), "page+scheme").alias("entities"))
    return found.select("doc_id", F.posexplode("entities").alias("ord", "e")).select("doc_id", "ord", "e.text", "e.label", "e.normalized", "e.smiles", "e.source")


Q14 = r"""WITH found AS (
  SELECT doc_id, regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?') AS a, regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+') AS b FROM documents
), one AS (
  SELECT doc_id, generate_subscripts(a, 1) - 1 AS ord, unnest(a) AS text, 'MEASUREMENT' AS label, NULL::VARCHAR AS normalized, 'page+scheme' AS source FROM found
  UNION ALL SELECT doc_id, len(a) + generate_subscripts(b, 1) - 1, unnest(b), 'OTHER', lower(unnest(b)), 'page' FROM found
)
SELECT doc_id, ord::INT AS ord, text, label, normalized, NULL::VARCHAR AS smiles, source FROM one"""


def q15_detection_filter(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    cls = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    found = line.select(*LINE, cls.alias("cls_id"), (F.col("l_discount") * 10).alias("conf"), F.array(F.col("l_quantity") / 4, F.col("l_quantity") / 8).alias("xyxy"))
    named = detections.project(found, {0: "chemical_structure", 1: "reaction_scheme", 2: "arrow"})
    kept = detections.confident(match.with_role(named, {"scheme": ["reaction_scheme", "scheme"], "structure": ["chemical_structure"]}), 0.25, 3, ["l_orderkey"], LINE[1:])
    return kept.select(*LINE, "cls", "role", "conf", F.col("xyxy")[0].alias("x"), F.col("xyxy")[1].alias("y"), "place")


Q15 = """WITH named AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'chemical_structure' ELSE 'reaction_scheme' END AS cls,
         CASE l_returnflag WHEN 'R' THEN 'structure' ELSE 'scheme' END AS role, l_discount * 10 AS conf, round_even(l_quantity / 4, 1) AS x, round_even(l_quantity / 8, 1) AS y
  FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_discount * 10 >= 0.25
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY conf DESC, l_partkey, l_suppkey, l_linenumber)::INT AS place FROM named
) SELECT * FROM placed WHERE place <= 3"""


def q16_crop_order(spark, sf_dir):
    suffix = F.when(F.col("page_id").isNotNull(), F.coalesce(F.create_map(*map(F.lit, (0, ".png", 1, ".JPG", 2, ".tif")))[(F.col("page_id") % 4).cast("int")], F.lit(".webp")))
    path = F.concat(F.regexp_replace("url", r"[?#][^\n]*\z", ""), "suffix")
    files = read(spark, sf_dir, "pages").withColumn("suffix", suffix).select("page_id", "suffix", path.alias("path"), F.when(F.col("url").startswith("https"), 0).otherwise(1).alias("dir_ord"))
    return readers.ordered_crops(files.filter(text.extension("suffix").isin(list(schemas.CROP_EXTENSIONS))), tie=["page_id"]).select("page_id", "path", "dir_ord", "ord")


Q16 = r"""WITH files AS (
  SELECT page_id, regexp_replace(url, '[?#].*$', '') || CASE page_id % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.tif' ELSE '.webp' END AS path, CASE WHEN url LIKE 'https%' THEN 0 ELSE 1 END AS dir_ord FROM pages
) SELECT page_id, path, dir_ord, row_number() OVER (PARTITION BY dir_ord ORDER BY path)::INT AS ord FROM files WHERE page_id % 4 <> 2"""


def _ocr(df: DataFrame, key: list[str], file: Column, natural: Column) -> DataFrame:
    given = {"file": file, "natural_text": natural}
    return df.select(*key, *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.OCR_RESULT])


def q17_stage_bundle(spark, sf_dir):
    """Bundles put together by the library from stage tables: documents as pages, turns as detections, the user's turns as
    schemes and the assistant's as structures, labels as entities."""
    docs, turns, labels = (read(spark, sf_dir, n) for n in ("documents", "conversations", "labels"))
    key = F.col("conv_id").alias("page_id"), F.col("turn").cast("int").alias("det_id")
    found = turns.select(*key, F.col("role").alias("cls"), (F.col("turn") / 10).alias("conf"), F.array(F.col("turn").cast("double")).alias("xyxy"), F.when(F.col("turn") % 5 == 4, F.lit("faint")).alias("error"))
    scheme = _ocr(turns.filter("role = 'user'").select(*key, "text"), ["page_id", "det_id"], F.col("det_id"), F.length("text"))
    shapes = turns.filter("role = 'assistant'").select(*key, F.concat(F.col("turn").cast("string"), F.lit(".png")).alias("file"), F.length("text").cast("string").alias("smiles"), F.lit(None).cast("string").alias("error"))
    listed = F.array(F.struct(F.lit("q").alias("text"), F.lit("OTHER").alias("label"), F.col("quality").cast("string").alias("normalized"), F.lit(None).cast("string").alias("smiles"), F.lit("page").alias("source")))
    ner = labels.select(F.col("doc_id").alias("page_id"), listed.alias("entities"), F.when(F.col("toxic") == 1, "toxic").alias("error"))
    final = docs.select(F.col("doc_id").alias("page_id"), records.summary_of(F.concat(F.lit('{"goal": "'), "lang", F.lit('", "confidence": 0.25}'))).alias("summary"), F.lit(None).cast("string").alias("error"))
    whole = stages.assemble(_ocr(docs, ["doc_id"], F.concat(F.col("doc_id").cast("string"), F.lit(".png")), F.col("source")).withColumnRenamed("doc_id", "page_id"), found, scheme, shapes, ner, final)
    joined = lambda c, f: F.coalesce(F.array_join(F.transform(c, lambda x: x[f].cast("string")), ","), F.lit(""))
    return whole.select("page_id", "page_ocr.file", "page_ocr.natural_text", joined("detections", "cls").alias("classes"), "detection_error", joined("scheme_ocr", "natural_text").alias("schemes"), joined("structures", "smiles").alias("smiles"), joined("entities", "normalized").alias("entities"), "entities_error", "summary.goal", "summary.confidence")


Q17 = """WITH turns AS (
  SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS classes, max(CASE WHEN turn % 5 = 4 THEN 'faint' END) AS detection_error, string_agg(length(text)::VARCHAR, ',' ORDER BY turn) FILTER (WHERE role = 'user') AS schemes,
         string_agg(length(text)::VARCHAR, ',' ORDER BY turn) FILTER (WHERE role = 'assistant') AS smiles FROM conversations GROUP BY conv_id
)
SELECT d.doc_id AS page_id, d.doc_id || '.png' AS file, d.source AS natural_text, coalesce(t.classes, '') AS classes, t.detection_error, coalesce(t.schemes, '') AS schemes, coalesce(t.smiles, '') AS smiles,
coalesce(l.quality::VARCHAR, '') AS entities, CASE WHEN l.toxic = 1 THEN 'toxic' END AS entities_error, d.lang AS goal, 0.25::DOUBLE AS confidence
FROM documents d LEFT JOIN turns t ON t.conv_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id"""


def q18_log_best(spark, sf_dir):
    return traininglog.best_and_patience(read(spark, sf_dir, "events"), ["event_type"], "event_id", "value")


Q18 = """WITH seen AS (SELECT event_type, event_id, value, max(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events
), runs AS (SELECT *, sum(CASE WHEN before IS NULL OR value > before THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM seen
), waits AS (SELECT event_type, run, count(*) - 1 AS wait FROM runs GROUP BY event_type, run
), best AS (SELECT event_type, value, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events)
SELECT w.event_type, b.value AS best, b.event_id AS best_at, max(w.wait) AS longest_wait FROM waits w JOIN best b ON b.event_type = w.event_type AND b.r = 1 GROUP BY w.event_type, b.value, b.event_id"""


def q19_box_containment(spark, sf_dir):
    """An extension: structures at least half inside a scheme of the same image."""
    b = corner_boxes(spark, sf_dir)
    made = b.select(F.col("l_orderkey").alias("image"), "label", F.struct(*LINE[1:]).alias("box_id"), *[F.greatest(F.least(f"{a}0", f"{a}1"), F.lit(0.0)).alias(f"{a}0") for a in "xy"], *[F.greatest(f"{a}0", f"{a}1").alias(f"{a}1") for a in "xy"])
    found = detections.contained(made, ["image"], "chemical_structure", "reaction_scheme")
    return found.select("image", F.col("a_box_id.l_partkey").alias("part"), F.col("a_box_id.l_suppkey").alias("supp"), F.col("a_box_id.l_linenumber").alias("line"), F.col("b_box_id.l_partkey").alias("in_part"), F.col("b_box_id.l_suppkey").alias("in_supp"), F.col("b_box_id.l_linenumber").alias("in_line"), F.bround("share", 6).alias("share"))


Q19 = """WITH b AS (
  SELECT l_orderkey AS image, l_partkey AS p, l_suppkey AS s, l_linenumber AS n, l_returnflag AS f, greatest(least(l_discount * 10, l_quantity / 50), 0.0) AS x0, greatest(l_discount * 10, l_quantity / 50) AS x1,
         greatest(least(l_tax * 12, l_quantity / 50), 0.0) AS y0, greatest(l_tax * 12, l_quantity / 50) AS y1 FROM lineitem
), pairs AS (
  SELECT a.image, a.p AS part, a.s AS supp, a.n AS line, o.p AS in_part, o.s AS in_supp, o.n AS in_line,
         (greatest(least(a.x1, o.x1) - greatest(a.x0, o.x0), 0.0) * greatest(least(a.y1, o.y1) - greatest(a.y0, o.y0), 0.0)) / (greatest(a.x1 - a.x0, 0.0) * greatest(a.y1 - a.y0, 0.0)) AS share
  FROM b a JOIN b o ON a.image = o.image AND a.f = 'R' AND o.f = 'A' AND a.x0 < o.x1 AND o.x0 < a.x1 AND a.y0 < o.y1 AND o.y0 < a.y1 AND a.x1 > a.x0 AND a.y1 > a.y0
) SELECT image, part, supp, line, in_part, in_supp, in_line, round_even(share, 6) AS share FROM pairs WHERE share >= 0.5"""

ATTEMPTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("natural_text", T.StringType()), T.StructField("waited", T.DoubleType()), T.StructField("error", T.StringType())])


def q20_failure_isolation(spark, sf_dir):
    """A service that fails for good on every seventh document and twice on every fifth: errors stay with their rows."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, lang in zip(batch["doc_id"], batch["lang"], strict=True):
                waits: list[float] = []

                def call(doc_id=doc_id, lang=lang, waits=waits) -> str:
                    if doc_id % 7 == 0 or doc_id % 5 == 0 and len(waits) < 2:
                        raise TimeoutError("service is down")
                    return lang

                try:
                    rows.append((doc_id, with_retries(call, 4, waits.append), float(sum(waits)), None))
                except RuntimeError as e:
                    rows.append((doc_id, None, float(sum(waits)), str(e)))
            yield pd.DataFrame(rows, columns=ATTEMPTS.names)

    return read(spark, sf_dir, "documents").select("doc_id", "lang").mapInPandas(run, ATTEMPTS)


Q20 = """WITH failed AS (SELECT doc_id, lang, CASE WHEN doc_id % 7 = 0 THEN 4 WHEN doc_id % 5 = 0 THEN 2 ELSE 0 END AS times FROM documents)
SELECT doc_id, CASE WHEN times < 4 THEN lang END AS natural_text, coalesce(list_sum(list_transform(range(0, times), lambda i: least(pow(2, i), 20))), 0)::DOUBLE AS waited,
CASE WHEN times = 4 THEN 'gave up after 4 attempts: service is down' END AS error FROM failed"""

_QUERIES = (
    q01_box_normalize, q02_box_class_counts, q03_annotation_match, q04_annotation_missing, q05_split_leakage, q06_split_train_val, q07_name_normalize,
    q08_front_matter, q09_rotation_retry, q10_json_salvage, q11_validation_verdict, q12_ner_context, q13_scheme_blob, q14_entity_explode,
    q15_detection_filter, q16_crop_order, q17_stage_bundle, q18_log_best, q19_box_containment, q20_failure_isolation,
)
_SQL = (Q01, Q02, Q03, Q04, Q05, Q06, Q07, Q08, Q09, Q10, Q11, Q12, Q13, Q14, Q15, Q16, Q17, Q18, Q19, Q20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (*_QUERIES, *page_queries.QUERIES)}


def oracle_sql() -> dict[str, str]:
    return {q.__name__: sql for q, sql in zip((*_QUERIES, *page_queries.QUERIES), (*_SQL, *page_queries.SQL), strict=True)}

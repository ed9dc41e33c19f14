"""The page pipeline as DataFrame stages: transcription, detection, crops, structures, entities, summary, bundle.

A model call is a mapInPandas over small batches; its backend is made once per task. Every stage's output is written before
the next one reads it, so a lost task repeats its own calls only and a page or crop is sent to a model once per stage. A
failing page or crop becomes a row with its error and stops nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom import schemas
from pageloom.functions import records, text
from pageloom.operators import match
from pageloom.plans.config import DEFAULT_PROMPTS, Config, Prompts
from pageloom.sources import writers
from pageloom.sources.shared import materialize

OCR_COLUMNS = [f.name for f in schemas.OCR_RESULT]
PAGE_OCR = "page_id long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.OCR_RESULT)
CROP_OCR = PAGE_OCR.replace("page_id long, ", "page_id long, det_id int, ")
FOUND = "page_id long, det_id int, cls string, conf double, xyxy array<double>, content binary, error string"


class Once:
    """Makes its value at the first call within a task; travels without it."""

    def __init__(self, make: Callable):
        self.make, self.made = make, None

    def __call__(self):
        if self.made is None:
            self.made = self.make()
        return self.made

    def __reduce__(self):
        return Once, (self.make,)


def read_page(backend, path: str, content: bytes, prompt: str, rotate_retry: bool = True) -> dict:
    """One transcription, and a second one of the turned image where the first says so; the second replaces the first."""
    out: dict = dict.fromkeys(OCR_COLUMNS) | {"file": path.rsplit("/", 1)[-1]}
    try:
        raw = backend.read(content, prompt)
        meta, body = split_page(raw)
        if rotate_retry and meta["retry"]:
            raw = backend.read(content, prompt, turn=meta["rotation_correction"])
            meta, body = split_page(raw)
    except Exception as e:  # noqa: BLE001 - one page must not stop the others
        return out | {"error": str(e) or type(e).__name__}
    natural = None if body.strip().lower() == "null" else body
    return out | {k: meta[k] for k in ("primary_language", "is_rotation_valid", "rotation_correction", "is_table", "is_diagram")} | {"natural_text": natural, "raw": raw}


def split_page(raw: str) -> tuple[dict, str]:
    """(typed meta fields, body) of a transcription."""
    found = re.match(r"\s*---\s*\n(.*?)\n---\s*\n?(.*)", raw, re.DOTALL)
    return (text.read_meta(found[1]), found[2].strip()) if found else (text.read_meta(""), raw.strip())


def transcribe(pages: DataFrame, make_backend: Callable, prompt: str, key: list[str] | None = None, rotate_retry: bool = True) -> DataFrame:
    """pages: key columns, path, content. One row of schemas.OCR_RESULT per image."""
    key = key or ["page_id"]
    kinds = dict(pages.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in key) + ", " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.OCR_RESULT)
    backend = Once(make_backend)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{k: r[k] for k in key} | read_page(backend(), r["path"], r["content"], prompt, rotate_retry) for r in batch.to_dict("records")]
            yield pd.DataFrame(rows, columns=[*key, *OCR_COLUMNS]).astype({"rotation_correction": "Int32", "is_rotation_valid": "object"})

    return pages.select(*key, "path", "content").mapInPandas(run, schema)


def detect(pages: DataFrame, make_backend: Callable, config: Config) -> DataFrame:
    """A row per detection, numbered within its page, with its crop; a page that fails has one row with the error."""
    backend = Once(make_backend)
    least = config.least_confidence

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                try:
                    model = backend()
                    names = model.names()
                    found = [d for d in model.detect(r["content"]) if d[1] >= least]
                    rows += [(r["page_id"], i, names[c], float(conf), [round(float(x), 1) for x in box], crop, None) for i, (c, conf, box, crop) in enumerate(found)]
                except Exception as e:  # noqa: BLE001
                    rows.append((r["page_id"], None, None, None, None, None, str(e) or type(e).__name__))
            made = pd.DataFrame(rows, columns=["page_id", "det_id", "cls", "conf", "xyxy", "content", "error"])
            yield made.astype({"det_id": "Int32"})

    return pages.select("page_id", "content").mapInPandas(run, FOUND)


def recognise(crops: DataFrame, make_backend: Callable) -> DataFrame:
    """smiles or error per structure crop; the default backend recognises nothing."""
    backend = Once(make_backend)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                try:
                    rows.append((r["page_id"], r["det_id"], r["path"].rsplit("/", 1)[-1], backend().recognise(r["content"]), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((r["page_id"], r["det_id"], r["path"].rsplit("/", 1)[-1], None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["page_id", "det_id", "file", "smiles", "error"])

    made = crops.select("page_id", "det_id", "path", "content").mapInPandas(run, "page_id long, det_id int, file string, smiles string, error string")
    return made.withColumn("smiles", text.validate_smiles("smiles"))


def ask(df: DataFrame, make_backend: Callable, system: str, prompt: str, answer: str, schema: dict | None = None) -> DataFrame:
    """Each row's prompt column to the language model: adds ``answer`` and ``<answer>_error``."""
    backend = Once(make_backend)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers, errors = [], []
            for p in batch[prompt]:
                try:
                    answers.append(backend().answer(system, p, schema))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    answers.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield batch.assign(**{answer: pd.Series(answers, dtype="object", index=batch.index), f"{answer}_error": pd.Series(errors, dtype="object", index=batch.index)})

    schema = ", ".join([f"`{n}` {t}" for n, t in df.dtypes] + [f"{answer} string", f"{answer}_error string"])
    return df.mapInPandas(run, schema)


def fill(template: str, **columns: Column) -> Column:
    """A template's {names} replaced by columns."""
    parts, rest = [], template.replace("{{", "\x00").replace("}}", "\x01")
    while rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts.append(F.lit(head.replace("\x00", "{").replace("\x01", "}")))
        if name:
            parts.append(columns[name])
    return F.concat(*parts)


def entities(pages: DataFrame, make_backend: Callable, prompts: Prompts = DEFAULT_PROMPTS, source: str = "page+scheme") -> DataFrame:
    """pages: page_id, context. Entities of every page; any fault gives an empty list with its error."""
    asked = ask(pages.select("page_id", fill(prompts.entities, text=F.col("context")).alias("prompt")), make_backend, prompts.entities_system, "prompt", "answer")
    read = asked.withColumn("found", records.entities_of("answer"))
    made = records.finish_entities(F.col("found.entities"), source)
    return read.select("page_id", made.alias("entities"), F.col("found.rejected").alias("rejected"), F.coalesce("answer_error", "found.error").alias("error"))


def summaries(pages: DataFrame, make_backend: Callable, prompts: Prompts = DEFAULT_PROMPTS) -> DataFrame:
    """pages: page_id, page, schemes, entities, structures (texts). A summary of every page, the fallback where it fails."""
    prompt = fill(prompts.summary, page=text.or_none("page"), schemes=text.or_none("schemes"), entities=text.or_none("entities"), structures=text.or_none("structures"))
    asked = ask(pages.select("page_id", prompt.alias("prompt")), make_backend, prompts.summary_system, "prompt", "answer")
    return asked.withColumn("summary", records.summary_of("answer")).select("page_id", "summary", F.col("answer_error").alias("error"))


def stored(spark: SparkSession, config: Config) -> Callable[[DataFrame, str], DataFrame]:
    """Writes a stage below config.run_dir, by run, and reads it back; without a run_dir in the session's shared folder."""

    def keep(df: DataFrame, stage: str) -> DataFrame:
        if config.run_dir is None:
            return materialize(df)
        return spark.read.schema(df.schema).parquet(writers.stage_output(df, config.run_dir, stage, config.run_id))

    return keep


def listed(crops: DataFrame, columns: list[str], name: str) -> DataFrame:
    """page_id and the array of its crops' structs, by det_id."""
    row = F.struct("det_id", F.struct(*columns).alias("r"))
    return crops.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"]).alias(name))


def assemble(page: DataFrame, found: DataFrame, scheme: DataFrame, shapes: DataFrame | None, ner: DataFrame, final: DataFrame) -> DataFrame:
    """One row per page with its bundle, from the stages' tables; each many-side is one row per page before it is joined."""
    boxes = found.groupBy("page_id").agg(F.array_sort(F.collect_list(F.when(F.col("det_id").isNotNull(), F.struct("det_id", "cls", "conf", "xyxy")))).alias("detections"), F.max("error").alias("detection_error"))
    empty = F.lit(None).cast("array<struct<file:string,smiles:string,error:string>>")
    whole = page.select("page_id", F.struct(*OCR_COLUMNS).alias("page_ocr")).join(boxes, "page_id", "left").join(listed(scheme, OCR_COLUMNS, "scheme_ocr"), "page_id", "left")
    whole = whole.withColumn("structures", empty) if shapes is None else whole.join(listed(shapes, ["file", "smiles", "error"], "structures"), "page_id", "left")
    whole = whole.join(ner.select("page_id", "entities", F.col("error").alias("entities_error")), "page_id", "left")
    return whole.join(final.withColumnRenamed("error", "summary_error"), "page_id", "left")


def run_pages(pages: DataFrame, config: Config, ocr: Callable, detector: Callable, llm: Callable, structure: Callable | None = None, keep: Callable[[DataFrame, str], DataFrame] | None = None, prompts: Prompts = DEFAULT_PROMPTS) -> DataFrame:
    """All stages over pages (page_id, path, content): one row per page with its bundle and what optional packages there were.

    keep(df, stage) writes a stage and reads it back, by default as stored does. page_id is unique."""
    keep = keep or stored(pages.sparkSession, config)
    page = keep(transcribe(pages, ocr, prompts.page, rotate_retry=config.rotate_retry), "1_page_ocr")
    found = keep(detect(pages, detector, config), "2_detections")
    crops = match.with_role(found.filter("det_id IS NOT NULL"), config.roles())
    crops = crops.withColumn("path", F.concat_ws("/", F.col("page_id").cast("string"), "cls", F.concat(F.lpad(F.col("det_id").cast("string"), 5, "0"), F.lit(".png"))))
    scheme = keep(transcribe(crops.filter("role = 'scheme'"), ocr, prompts.scheme, ["page_id", "det_id"], config.rotate_retry), "3_scheme_ocr")
    shapes = None
    if config.recognise_structures and structure is not None:
        shapes = keep(recognise(crops.filter("role = 'structure'"), structure), "3b_ocsr")

    texts = listed(scheme, ["natural_text"], "s")
    read = page.select("page_id", "natural_text").join(texts, "page_id", "left").withColumn("scheme_texts", F.transform(F.coalesce("s", F.array().cast(texts.schema["s"].dataType)), lambda x: x["natural_text"]))
    ner = keep(entities(read.select("page_id", text.entity_context("natural_text", "scheme_texts").alias("context")), llm, prompts), "4_ner")
    ready = read.join(ner.select("page_id", "entities"), "page_id", "left")
    if shapes is not None:
        ready = ready.join(shapes.filter("smiles IS NOT NULL").groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("det_id", "smiles"))), lambda x: x["smiles"]).alias("shapes")), "page_id", "left")
    blobs = [F.col("natural_text").alias("page"), text.scheme_blob("scheme_texts").alias("schemes"), F.when(F.size("entities") > 0, text.to_json_all("entities")).alias("entities")]
    final = keep(summaries(ready.select("page_id", *blobs, (F.to_json("shapes") if shapes is not None else F.lit(None).cast("string")).alias("structures")), llm, prompts), "5_summary")
    there = F.struct(*[F.lit(v).alias(k) for k, v in text.capabilities().items()])
    return keep(assemble(page, found, scheme, shapes, ner, final).withColumn("capabilities", there), "run")

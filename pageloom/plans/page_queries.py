"""Registered queries of stages, datasets, detections, sources and sinks; each SQL computes what its query does by other means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom import schemas
from pageloom.functions import records, text
from pageloom.operators import detections, match, split
from pageloom.plans import backends, dataset, stages
from pageloom.plans.config import DEFAULT_PROMPTS, Config
from pageloom.plans.tables import BOXES_SQL, LINE, corner_boxes, read
from pageloom.sources import readers, shared, writers

# the page pipeline over the pages table, with fakes for the models


class BrokenPages(backends.FakeOcr):
    """Pages that say BROKEN can't be read."""

    def read(self, image: bytes, prompt: str, turn: int = 0) -> str:
        if b"BROKEN" in image:
            raise RuntimeError("cannot read")
        return super().read(image, prompt, turn)


class EchoStructures:
    def recognise(self, image: bytes) -> str | None:
        return image.decode()


def _page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's image: its first line, and a line per drawn box for the fake detector."""
    n = F.col("page_id")
    box = lambda i: F.concat(((n + i) % 2).cast("string"), F.lit(" 0."), ((n * 7 + i * 3) % 10).cast("string"), F.lit(" 1 2 30.25 4.75 "), F.when((n + i) % 2 == 1, F.concat(F.lit("stir "), i.cast("string"), F.lit("h then cool"))).otherwise(F.concat(F.lit("C1CC"), i.cast("string"))))
    boxes = F.filter(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(i < n % 4, box(i))), lambda x: x.isNotNull())
    head = F.concat(F.lit("Page "), n.cast("string"), F.lit(" of "), F.coalesce("url", F.lit("")), F.when(n % 5 == 0, F.lit(" TURN")).otherwise(F.lit("")), F.when(n % 7 == 3, F.lit(" BROKEN")).otherwise(F.lit("")))
    content = F.array_join(F.concat(F.array(head), boxes), "\n")
    return read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/scans/"), n.cast("string"), F.lit(".png")).alias("path"), content.cast("binary").alias("content"))


def q21_run_pages(spark, sf_dir):
    """All stages, written on the way and assembled."""
    made = stages.run_pages(_page_images(spark, sf_dir), Config(), BrokenPages, backends.FakeDetector, backends.FakeLlm, EchoStructures)
    joined = lambda c, f: F.coalesce(F.array_join(F.transform(c, lambda x: x[f]), "|"), F.lit(""))
    return made.select("page_id", "page_ocr.file", "page_ocr.natural_text", F.col("page_ocr.error").alias("error"), joined("detections", "cls").alias("classes"), F.coalesce(F.col("detections")[0]["xyxy"][2], F.lit(-1.0)).alias("x1"),
                       joined("scheme_ocr", "natural_text").alias("schemes"), joined("structures", "smiles").alias("smiles"), joined("entities", "text").alias("entities"), joined("entities", "source").alias("sources"), "summary.goal", "summary.confidence")


Q21 = r"""WITH lines AS (
  SELECT page_id, 'Page ' || page_id || ' of ' || coalesce(url, '') || CASE WHEN page_id % 5 = 0 THEN ' TURN' ELSE '' END || CASE WHEN page_id % 7 = 3 THEN ' BROKEN' ELSE '' END AS head,
         list_transform(range(0, page_id % 4), lambda i: {'cls': (page_id + i) % 2, 'conf': (page_id * 7 + i * 3) % 10, 'shown': CASE WHEN (page_id + i) % 2 = 1 THEN 'stir ' || i || 'h then cool' ELSE 'C1CC' || i END}) AS drawn
  FROM pages
), seen AS (
  SELECT page_id, page_id % 7 = 3 AS broken, head || array_to_string(list_transform(drawn, lambda d: chr(10) || d.cls || ' 0.' || d.conf || ' 1 2 30.25 4.75 ' || d.shown), '') AS body, head, list_filter(drawn, lambda d: d.conf / 10 >= 0.25) AS found FROM lines
), parts AS (
  SELECT *, list_transform(list_filter(found, lambda d: d.cls = 1), lambda d: d.shown) AS schemes, list_transform(list_filter(found, lambda d: d.cls = 0), lambda d: d.shown) AS smiles FROM seen
), asked AS (
  SELECT *, list_filter(regexp_split_to_array(CASE WHEN broken THEN '' ELSE body END || chr(10) || chr(10) || array_to_string(schemes, chr(10) || chr(10)), '\s+'), lambda w: regexp_matches(w, '[0-9]')) AS words FROM parts
)
SELECT page_id, page_id || '.png' AS file, CASE WHEN NOT broken THEN body END AS natural_text, CASE WHEN broken THEN 'cannot read' END AS error,
array_to_string(list_transform(found, lambda d: CASE d.cls WHEN 1 THEN 'reaction_scheme' ELSE 'chemical_structure' END), '|') AS classes, CASE WHEN len(found) > 0 THEN 30.2 ELSE -1.0 END::DOUBLE AS x1, array_to_string(schemes, '|') AS schemes,
array_to_string(smiles, '|') AS smiles, array_to_string(words, '|') AS entities, array_to_string(list_transform(words, lambda w: 'page+scheme'), '|') AS sources, CASE WHEN broken THEN '[none]' ELSE head END AS goal, 0.5::DOUBLE AS confidence FROM asked"""

# the detector dataset over orders (images) and lineitem (boxes)


def _dataset(spark: SparkSession, sf_dir: str) -> dataset.Dataset:
    name = lambda gap, ext: F.concat(F.lit(f"Order{gap}"), F.col("o_orderkey").cast("string"), ext)
    ext = F.when(F.col("o_orderkey") % 2 == 0, F.lit(".PNG")).otherwise(F.lit(".tif"))
    images = read(spark, sf_dir, "orders").filter("o_orderkey % 10 <> 3").select(name("  \t", ext).alias("name"), F.concat(F.lit("/x/"), name("  \t", ext)).alias("path"))
    ext = F.when(F.col("l_orderkey") % 2 == 0, F.lit(".PNG")).otherwise(F.lit(".tif"))
    drawn = corner_boxes(spark, sf_dir)
    notes = drawn.select(F.concat(F.lit("Order "), F.col("l_orderkey").cast("string"), ext).alias("filename"), F.col("l_orderkey").alias("file_ord"), F.col("l_linenumber").alias("ord"), "label", "x0", "y0", "x1", "y1")
    return dataset.build(notes, images, exact_shuffle=False)


DATASET_SQL = rf"""{BOXES_SQL}, files AS (
  SELECT DISTINCT l_orderkey AS k, 'Order ' || l_orderkey || CASE WHEN l_orderkey % 2 = 0 THEN '.PNG' ELSE '.tif' END AS filename FROM lineitem
), there AS (
  SELECT k, filename, row_number() OVER (ORDER BY md5('42:' || filename), filename) <= greatest(1, round_even(count(*) OVER () * 0.2, 0)) AS val FROM files WHERE k % 10 <> 3 AND EXISTS (SELECT 1 FROM orders WHERE o_orderkey = k)
), placed AS (
  SELECT k, filename, CASE WHEN val THEN 'val' ELSE 'train' END AS split, 'Order_' || k AS stem FROM there
), drawn AS (
  SELECT p.split, p.stem, b.label, b.cls, b.l_linenumber AS ord, format('{{:.6f}}', cx) AS cx, format('{{:.6f}}', cy) AS cy, format('{{:.6f}}', w) AS w, format('{{:.6f}}', h) AS h FROM placed p JOIN boxes b ON b.l_orderkey = p.k
)"""


def q22_label_texts(spark, sf_dir):
    return _dataset(spark, sf_dir).labels


Q22 = f"""WITH {DATASET_SQL}, lines AS (SELECT split, stem, ord, cls || ' ' || cx || ' ' || cy || ' ' || w || ' ' || h AS line FROM drawn),
texts AS (SELECT split, stem, string_agg(line, chr(10) ORDER BY ord, line) || chr(10) AS text FROM lines GROUP BY split, stem)
SELECT p.split, p.stem, coalesce(t.text, '') AS text, 0::BIGINT AS n_collisions FROM placed p LEFT JOIN texts t ON t.split = p.split AND t.stem = p.stem"""


def q23_dataset_counts(spark, sf_dir):
    return _dataset(spark, sf_dir).counts


Q23 = f"""WITH {DATASET_SQL}
SELECT 'images' AS what, split AS name, count(*) AS n FROM placed GROUP BY split
UNION ALL SELECT 'boxes', k.label, count(d.label) FROM (VALUES ('chemical_structure'), ('reaction_scheme')) k(label) LEFT JOIN drawn d ON d.label = k.label GROUP BY k.label
UNION ALL SELECT 'missing', filename, 1 FROM files f WHERE NOT EXISTS (SELECT 1 FROM there t WHERE t.k = f.k)"""


def q24_label_lines(spark, sf_dir):
    """Label texts read again, box by box."""
    labels = _dataset(spark, sf_dir).labels
    return readers.label_lines(labels.select(F.concat(F.lit("/out/labels/"), "split", F.lit("/"), "stem", F.lit(".txt")).alias("path"), "text")).drop("line_no")


Q24 = f"""WITH {DATASET_SQL} SELECT split, stem, cls, cx::DOUBLE AS cx, cy::DOUBLE AS cy, w::DOUBLE AS w, h::DOUBLE AS h FROM drawn"""


def q25_last_image_per_name(spark, sf_dir):
    """Of pages of one host the one whose address comes last, and how many it replaced."""
    host = F.regexp_extract("url", r"https?://([^/]+)", 1)
    return match.last_per_key(read(spark, sf_dir, "pages").select("page_id", "url", text.norm_name(host).alias("norm")), "norm", ["url", "page_id"]).select("page_id", "url", "norm", "collisions")


Q25 = r"""SELECT page_id, url, norm, collisions FROM (
  SELECT page_id, url, regexp_extract(url, 'https?://([^/]+)', 1) AS norm, row_number() OVER (PARTITION BY regexp_extract(url, 'https?://([^/]+)', 1) ORDER BY url DESC, page_id DESC) AS r,
         count(*) OVER (PARTITION BY regexp_extract(url, 'https?://([^/]+)', 1)) - 1 AS collisions FROM pages
) WHERE r = 1"""


def q26_label_overlap(spark, sf_dir):
    """Stems that a dataset has on both sides: orders by customer, split by order."""
    sides = split.hash_split(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", seed=3)
    return split.overlap(sides.select("split", F.col("o_custkey").alias("stem")))


Q26 = """WITH s AS (SELECT o_custkey, row_number() OVER (ORDER BY md5('3:' || o_orderkey), o_orderkey) <= greatest(1, round_even(count(*) OVER () * 0.2, 0)) AS val FROM orders)
SELECT o_custkey AS stem FROM s GROUP BY o_custkey HAVING bool_or(val) AND NOT bool_and(val)"""

# detections: boxes of lineitem, an order is an image


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    conf = F.floor("l_extendedprice") % 20 / 20
    b = corner_boxes(spark, sf_dir, conf.alias("conf"), F.col("l_linestatus"))
    sides = [f(f"{a}0", f"{a}1").alias(f"{a}{i}") for a in "xy" for i, f in ((0, F.least), (1, F.greatest))]
    return b.select(F.col("l_orderkey").alias("image"), F.concat_ws("-", *LINE[1:]).alias("box_id"), F.col("label").alias("cls"), "conf", "l_linestatus", *sides)


FOUND_SQL = """found AS (
  SELECT l_orderkey AS image, l_partkey || '-' || l_suppkey || '-' || l_linenumber AS box_id, CASE l_returnflag WHEN 'R' THEN 'chemical_structure' WHEN 'A' THEN 'reaction_scheme' ELSE 'arrow' END AS cls, floor(l_extendedprice) % 20 / 20 AS conf, l_linestatus,
         least(l_discount * 10, l_quantity / 50) AS x0, least(l_tax * 12, l_quantity / 50) AS y0, greatest(l_discount * 10, l_quantity / 50) AS x1, greatest(l_tax * 12, l_quantity / 50) AS y1 FROM lineitem
)"""
_IOU = "(greatest(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0), 0) * greatest(least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0), 0)) / greatest(({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0) + ({b}.x1 - {b}.x0) * ({b}.y1 - {b}.y0) - greatest(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0), 0) * greatest(least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0), 0), 1e-12)"


def q27_first_detection(spark, sf_dir):
    return detections.confident(_found(spark, sf_dir), 0.25, 1, ["image"], ["box_id"]).select("image", "box_id", "cls", "conf")


Q27 = f"""WITH {FOUND_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY conf DESC, box_id) AS r FROM found WHERE conf >= 0.25) SELECT image, box_id, cls, conf FROM ranked WHERE r = 1"""


def q28_suppress(spark, sf_dir):
    return detections.suppress(_found(spark, sf_dir).drop("l_linestatus"), iou=0.3, most=300).select("image", "cls", "box_id")


Q28 = f"""WITH {FOUND_SQL}, listed AS (
  SELECT image, cls, list([{{'id': box_id, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}] ORDER BY conf DESC, box_id) AS l FROM found GROUP BY image, cls
), kept AS (
  SELECT image, cls, list_reduce(l, lambda kept, b: CASE WHEN len(list_filter(kept, lambda k: {_IOU.format(a="b[1]", b="k")} > 0.3)) > 0 THEN kept ELSE list_concat(kept, b) END) AS kept FROM listed
) SELECT image, cls, unnest(list_transform(kept, lambda k: k.id)) AS box_id FROM kept"""


def _truth_and_found(spark, sf_dir):
    every = _found(spark, sf_dir)
    return every.filter("l_linestatus = 'F'").drop("l_linestatus", "conf", "box_id"), every.filter("l_linestatus = 'O'").drop("l_linestatus")


def q29_average_precision(spark, sf_dir):
    made = detections.average_precision(*_truth_and_found(spark, sf_dir), iou=0.2)
    return made.select("cls", "truth", *[F.bround(c, 6).alias(c) for c in ("precision", "recall", "ap")])


def _ap_sql(iou: str) -> str:
    return f"""hits{iou} AS (
  SELECT d.image, d.cls, d.l, list_reduce(d.l, lambda acc, b: CASE WHEN coalesce(list_max(list_transform(acc.free, lambda t: {_IOU.format(a="b", b="t")})), 0) >= 0.{iou}
      THEN {{'free': list_filter(acc.free, lambda t: t.no <> list_max(list_transform(acc.free, lambda u: {{'s': {_IOU.format(a="b", b="u")}, 'n': -u.no, 'no': u.no}})).no), 'hits': list_append(acc.hits, 1)}}
      ELSE {{'free': acc.free, 'hits': list_append(acc.hits, 0)}} END, {{'free': coalesce(t.l, []), 'hits': []::INT[]}}).hits AS hits
  FROM (SELECT image, cls, list({{'conf': conf, 'id': box_id, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} ORDER BY conf DESC, box_id) AS l FROM found WHERE l_linestatus = 'O' GROUP BY image, cls) d
  LEFT JOIN (SELECT image, cls, list({{'no': no, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} ORDER BY no) AS l
             FROM (SELECT *, row_number() OVER (PARTITION BY image, cls ORDER BY x0, y0, x1, y1) AS no FROM found WHERE l_linestatus = 'F') GROUP BY image, cls) t USING (image, cls)
), rows{iou} AS (
  SELECT image, cls, unnest(l, max_depth := 2), unnest(hits) AS hit FROM hits{iou}
), curve{iou} AS (
  SELECT cls, hit, sum(hit) OVER w AS tp, count(*) OVER w AS n, sum(hit) OVER w / count(*) OVER w AS precision, image, id, conf FROM rows{iou} WINDOW w AS (PARTITION BY cls ORDER BY conf DESC, image, id ROWS UNBOUNDED PRECEDING)
), envelope{iou} AS (
  SELECT *, max(precision) OVER (PARTITION BY cls ORDER BY conf DESC, image, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best FROM curve{iou}
), ap{iou} AS (
  SELECT t.cls, t.truth, coalesce(arg_max(e.precision, e.n), 0) AS precision, coalesce(max(e.tp) / t.truth, 0) AS recall, coalesce(sum(e.hit * e.best) / t.truth, 0) AS ap
  FROM (SELECT cls, count(*) AS truth FROM found WHERE l_linestatus = 'F' GROUP BY cls) t LEFT JOIN envelope{iou} e USING (cls) GROUP BY t.cls, t.truth
)"""


Q29 = f"WITH {FOUND_SQL}, {_ap_sql('2')} SELECT cls, truth, round_even(precision, 6) AS precision, round_even(recall, 6) AS recall, round_even(ap, 6) AS ap FROM ap2"


def q30_mean_average_precision(spark, sf_dir):
    made = detections.mean_average_precision(*_truth_and_found(spark, sf_dir), ious=(0.1, 0.3))
    return made.select("cls", "truth", *[F.bround(c, 6).alias(c) for c in ("precision", "recall", "ap50", "ap50_95")])


Q30 = f"""WITH {FOUND_SQL}, {_ap_sql('1')}, {_ap_sql('3')}
SELECT a.cls, a.truth, round_even(a.precision, 6) AS precision, round_even(a.recall, 6) AS recall, round_even(a.ap, 6) AS ap50, round_even((a.ap + b.ap) / 2, 6) AS ap50_95 FROM ap1 a JOIN ap3 b USING (cls)"""

# sources and sinks


def q31_annotation_literals(spark, sf_dir):
    """Annotations from Python source, one entry per nation (a table of 25 rows) and a later statement per region."""
    nations = sorted(tuple(r) for r in read(spark, sf_dir, "nation").select("n_name", "n_nationkey", "n_regionkey").collect())
    entries = [f"    {name!r}: [('chemical_structure', 0.0, 0.0, {k / 100!r}, {r / 10!r}), ('reaction_scheme', {k / 100!r}, {r / 10!r}, 1.0, 1.0)],\n" for name, k, r in nations]
    later = [f"ANN[{name!r}] = [('arrow', 0.5, 0.5, 0.5, 0.5)]\n" for name, k, _ in nations if k % 4 == 0]
    return readers.annotations(spark, readers.literal_annotations("ANN = {\n" + "".join(entries) + "}\n" + "".join(later)))


Q31 = """WITH f AS (SELECT n_name AS filename, n_nationkey AS k, n_regionkey AS r, (row_number() OVER (ORDER BY n_name) - 1)::INT AS file_ord FROM nation)
SELECT filename, file_ord, 0 AS ord, CASE WHEN k % 4 = 0 THEN 'arrow' ELSE 'chemical_structure' END AS label, CASE WHEN k % 4 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS x0, CASE WHEN k % 4 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS y0,
CASE WHEN k % 4 = 0 THEN 0.5 ELSE k / 100 END::DOUBLE AS x1, CASE WHEN k % 4 = 0 THEN 0.5 ELSE r / 10 END::DOUBLE AS y1 FROM f
UNION ALL SELECT filename, file_ord, 1, 'reaction_scheme', k / 100, r / 10, 1.0, 1.0 FROM f WHERE k % 4 <> 0"""


def q32_training_log(spark, sf_dir):
    """A CSV log with padded values, an epoch per hundred events, written and read again."""
    number = lambda c: F.concat(F.lit("  "), c.cast("string"), F.lit(" "))
    epochs = read(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 100).alias("epoch")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.max("value").alias("top"))
    columns = {"epoch": F.col("epoch"), "time": F.col("n"), "metrics/precision(B)": F.col("top"), "metrics/mAP50-95(B)": F.col("users")}
    folder = f"{shared.run_dir(spark)}/training-log"
    epochs.select(*[number(columns.get(f.name, F.lit(0.5))).alias(f.name) for f in schemas.TRAINING_LOG]).write.mode("overwrite").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(folder, header=True)
    log = readers.training_log(spark, folder)
    return log.select("epoch", "time", F.col("metrics/precision(B)").alias("top"), F.col("metrics/mAP50-95(B)").alias("users"), F.col("train/box_loss").alias("loss"))


Q32 = """SELECT (event_id // 100)::INT AS epoch, count(*)::DOUBLE AS time, max(value) AS top, count(DISTINCT user_id)::DOUBLE AS users, 0.5::DOUBLE AS loss FROM events GROUP BY event_id // 100"""


def q33_stage_output(spark, sf_dir):
    """A stage written as JSON and read again: nulls stay, other scripts stay."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"), F.array(F.struct(F.lit("é「x」").alias("text"), F.lit(None).cast("string").alias("smiles"))).alias("entities"))
    return spark.read.schema(docs.schema).json(writers.stage_output(docs, f"{shared.run_dir(spark)}/stages", "4_ner", fmt="json")).select("doc_id", "lang", F.to_json("entities", {"ignoreNullFields": "false"}).alias("entities"))


Q33 = """SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN lang END AS lang, '[{"text":"é「x」","smiles":null}]' AS entities FROM documents"""


def q34_image_files(spark, sf_dir):
    """Images copied to a dataset's folders and listed again as crops, in order, with their folder as class. The files go
    through the plain file system, which all machines must mount."""
    name = F.concat(F.lit("p "), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, F.lit(".PNG")).otherwise(F.lit(".jpg")))
    made = read(spark, sf_dir, "pages").select(name.alias("name"), F.when(F.col("page_id") % 5 == 0, "val").otherwise("train").alias("split"), F.col("url").cast("binary").alias("content"))
    folder = f"{shared.run_dir(spark)}/dataset"
    writers.copy_images(made, folder.removeprefix("file://").replace("file:/", "/"))
    return readers.crops(spark, [f"{folder}/images/val", f"{folder}/images/train"]).select("name", "cls", "dir_ord", "ord", F.col("content").cast("string").alias("content"), "length")


Q34 = """WITH f AS (SELECT 'p_' || page_id || CASE WHEN page_id % 2 = 0 THEN '.png' ELSE '.jpg' END AS name, CASE WHEN page_id % 5 = 0 THEN 'val' ELSE 'train' END AS cls, url AS content FROM pages)
SELECT name, cls, CASE cls WHEN 'val' THEN 0 ELSE 1 END AS dir_ord, row_number() OVER (PARTITION BY cls ORDER BY name)::INT AS ord, content, octet_length(encode(content)) AS length FROM f"""


def q35_reports(spark, sf_dir):
    """Reports of summaries: a customer each, with sections missing by turns."""
    quoted = lambda key, c: F.concat(F.lit(f'"{key}": "'), c, F.lit('"'))
    k, some = F.col("c_custkey"), lambda n, c: F.when(F.col("c_custkey") % n != 0, c)
    parts = F.filter(
        F.array(
            some(3, quoted("title", F.col("c_name"))), quoted("goal", F.col("c_mktsegment")), F.concat(F.lit('"confidence": 0.'), F.lpad((k % 100).cast("string"), 2, "0")),
            some(4, F.concat(F.lit('"procedure": ["mix", "stir for '), k.cast("string"), F.lit(' h"]'))), some(5, F.lit('"conditions": {"t": 1}')), some(2, F.lit('"results": ["ok"]')),
            some(6, F.concat(F.lit('"materials": [{"name": "a", "role": "SALT", "amount": "'), k.cast("string"), F.lit(' g", "concentration": "", "smiles": "C"}, {"name": "b", "role": "SOLVENT"}]'))),
        ),
        lambda x: x.isNotNull(),
    )
    read_back = read(spark, sf_dir, "customer").select("c_custkey", records.summary_of(F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))).alias("s"))
    return read_back.select("c_custkey", writers.report("s").alias("report"))


Q35 = r"""SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 3 <> 0 THEN c_name ELSE 'Untitled' END, 'Goal: ' || c_mktsegment,
  CASE WHEN c_custkey % 6 <> 0 THEN 'Materials:' || chr(10) || '  - a (SALT): ' || c_custkey || ' g / C' || chr(10) || '  - b (SOLVENT)' END, CASE WHEN c_custkey % 5 <> 0 THEN 'Conditions:' || chr(10) || '  {"t": 1}' END,
  CASE WHEN c_custkey % 4 <> 0 THEN 'Procedure:' || chr(10) || '  1. mix' || chr(10) || '  2. stir for ' || c_custkey || ' h' END, CASE WHEN c_custkey % 2 <> 0 THEN 'Results:' || chr(10) || '  - ok' END,
  'Confidence: ' || format('{:.2f}', c_custkey % 100 / 100)], lambda x: x IS NOT NULL), chr(10)) AS report FROM customer"""


def q36_prompts(spark, sf_dir):
    """Prompts filled from columns: structures checked, records as JSON with nulls, placeholders for what is empty."""
    docs = read(spark, sf_dir, "documents")
    entity = F.array(F.struct(F.col("lang").alias("text"), F.lit("OTHER").alias("label"), F.lit(None).cast("string").alias("normalized"), text.validate_smiles(F.when(F.col("doc_id") % 2 == 0, F.lit("")).otherwise(F.lit("C"))).alias("smiles")))
    filled = stages.fill(DEFAULT_PROMPTS.summary, page=text.or_none("text"), schemes=text.or_none(F.lit("")), entities=text.to_json_all(entity), structures=text.or_none(F.col("source")))
    return docs.select("doc_id", F.sha2(filled, 256).alias("prompt"))


def _filled_sql(template: str, **values: str) -> str:
    whole = "'" + template.replace("{{", "{").replace("}}", "}").replace("'", "''") + "'"
    for name, sql in values.items():
        whole = whole.replace("{" + name + "}", f"' || {sql} || '")
    return whole


Q36 = "SELECT doc_id, sha256(" + _filled_sql(
    DEFAULT_PROMPTS.summary, page="coalesce(nullif(text, ''), '[none]')", schemes="'[none]'", structures="coalesce(nullif(source, ''), '[none]')",
    entities="'[{\"text\":\"' || lang || '\",\"label\":\"OTHER\",\"normalized\":null,\"smiles\":' || CASE WHEN doc_id % 2 = 0 THEN 'null' ELSE '\"C\"' END || '}]'",
) + ") AS prompt FROM documents"


def q37_dataset_yaml(spark, sf_dir):
    """data.yaml for the nations of every region as classes."""
    make = F.udf(lambda region, names: writers.dataset_yaml(f"/data/{region}", names), T.StringType())
    names: Column = F.array_sort(F.collect_list("n_name"))
    return read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(names.alias("names")).select("n_regionkey", make("n_regionkey", "names").alias("yaml"))


Q37 = """SELECT n_regionkey, 'path: /data/' || n_regionkey || chr(10) || 'train: images/train' || chr(10) || 'val: images/val' || chr(10) || 'nc: ' || count(*) || chr(10) || 'names: [' || string_agg(chr(39) || n_name || chr(39), ', ' ORDER BY n_name) || ']' || chr(10) AS yaml FROM nation GROUP BY n_regionkey"""

QUERIES = (
    q21_run_pages, q22_label_texts, q23_dataset_counts, q24_label_lines, q25_last_image_per_name, q26_label_overlap, q27_first_detection, q28_suppress, q29_average_precision,
    q30_mean_average_precision, q31_annotation_literals, q32_training_log, q33_stage_output, q34_image_files, q35_reports, q36_prompts, q37_dataset_yaml,
)
SQL = (Q21, Q22, Q23, Q24, Q25, Q26, Q27, Q28, Q29, Q30, Q31, Q32, Q33, Q34, Q35, Q36, Q37)

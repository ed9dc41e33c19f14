"""Line dedup by content-defined chunks, with DataFrame functions only.

A line ends a chunk where a rolling hash over its own hash and those of the two lines before it is divisible by ``divisor``;
a boundary thus depends on three lines alone and an insertion moves no boundary further on. A line of at least ``long_line``
characters is a chunk of its own. Chunks that occur more than once in the corpus are removed but for the first one by
(doc_id, place), after a comparison of their bytes; only white space on a single line is no chunk. A repeated long line thus
goes wherever it is, and an exact copy goes whole. What stays are short lines of a repeat in a chunk with other lines.

Only a row of two hashes per chunk is grouped globally; texts move for the comparison of repeated chunks and for the result.
A chunk that very many documents share is summed up in the tasks before it is grouped, and what is joined by chunk are plain
tables, so that Spark deals such a chunk's rows to several tasks.

Lines are what newlines separate, and what is left is joined by newlines again. A null text stays null and counts as empty;
null ids rank first. Rows of one doc_id with different texts rank by a hash of the text; fully repeated rows count as one
document and all get its result. Empty tables give empty results; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pageloom.llm._util import materialize, read_table

DIVISOR = 3
LONG = 99  # fifty words have no fewer characters


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__k", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn("__h", F.xxhash64(_text()))


def chunks(text: Column, divisor: int = DIVISOR, long_line: int | None = LONG) -> Column:
    """The array of a text's chunks, each an array of lines."""
    lines = F.split(text, "\n", -1)
    hashes = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"))
    pair = F.struct(lines.alias("lines"), hashes.alias("hashes"))

    def cut(p: Column) -> Column:
        n = F.size(p["lines"])
        at = lambda i: F.coalesce(F.get(p["hashes"], i), F.lit(0))
        by_hash = lambda i: (i == n) | ((at(i - 1) + 31 * at(i - 2) + 961 * at(i - 3)) % divisor == 0)
        is_long = lambda i: F.length(F.get(p["lines"], i)) >= long_line
        ends = F.filter(F.sequence(F.lit(1), n), by_hash if long_line is None else lambda i: by_hash(i) | is_long(i - 1) | is_long(i))
        return F.struct(p["lines"].alias("lines"), ends.alias("ends"))

    def part(p: Column) -> Column:
        start = lambda j: F.coalesce(F.get(p["ends"], j - 1), F.lit(0))
        return F.transform(p["ends"], lambda e, j: F.slice(p["lines"], start(j) + 1, e - start(j)))

    # one-element arrays bind each step's value once, instead of repeating its expression
    bound = F.transform(F.transform(F.array(pair), cut), part)
    return bound[0]


def removed_chunks(docs: DataFrame, divisor: int = DIVISOR, long_line: int | None = LONG) -> DataFrame:
    """__k, __h and gone: the places (from 0) of the chunks that go from a document."""
    keyed = _key(docs).select("__k", "__h", _text().alias("text"))
    cut = chunks(F.col("text"), divisor, long_line)
    taken = lambda c: (F.size(c) > 1) | F.array_join(c, "").rlike(r"\S")
    marks = F.transform(cut, lambda c, j: F.when(taken(c), F.struct(j.alias("no"), F.xxhash64(F.array_join(c, "\n")).alias("c1"), F.xxhash64(F.lit(1), F.array_join(c, "\n"), F.size(c)).alias("c2"))))
    lean = materialize(keyed.select("__k", "__h", F.explode(marks).alias("m")).filter("m IS NOT NULL").select("__k", "__h", "m.no", "m.c1", "m.c2"))
    place = F.struct("__k", "__h", "no")
    # a fully repeated row has the places of the first one, so its chunks alone are no repeat
    repeated = materialize(lean.groupBy("c1", "c2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").drop("last"))
    candidates = materialize(lean.join(repeated, ["c1", "c2"]))
    wanted = candidates.groupBy("__k", "__h").agg(F.collect_set(F.struct("no", "c1", "c2")).alias("wanted"))
    texts = keyed.repartition("__k", "__h")
    bound = F.transform(F.array(F.struct(cut.alias("cut"), F.col("wanted").alias("w"))), lambda p: F.transform(p["w"], lambda w: F.struct(w["no"].alias("no"), w["c1"].alias("c1"), w["c2"].alias("c2"), F.array_join(F.get(p["cut"], w["no"]), "\n").alias("chunk"))))[0]
    exact = texts.join(wanted, ["__k", "__h"]).select("__k", "__h", F.explode(bound).alias("w")).select("__k", "__h", "w.*")
    verdict = materialize(exact.groupBy("c1", "c2").agg((F.min("chunk") == F.max("chunk")).alias("same")))
    judged = candidates.join(verdict, ["c1", "c2"])
    gone = judged.filter(F.col("same") & (place != F.col("first"))).select("__k", "__h", "no")
    # different bytes under equal hashes: each text of them has a first place of its own
    apart = exact.join(verdict.filter("NOT same"), ["c1", "c2"], "left_semi").withColumn("rank", F.dense_rank().over(Window.partitionBy("c1", "c2", "chunk").orderBy("__k", "__h", "no"))).filter("rank > 1")
    return gone.unionByName(apart.select("__k", "__h", "no")).groupBy("__k", "__h").agg(F.collect_set("no").alias("__gone"))


def dedup_line_chunks(docs: DataFrame, divisor: int = DIVISOR, counts: bool = False, long_line: int | None = LONG) -> DataFrame:
    """docs with text cut; with counts also n_lines, n_removed_lines and n_removed_chunks (replacing columns of these names)."""
    added = ["n_lines", "n_removed_lines", "n_removed_chunks"] if counts else []
    rest = [c for c in docs.columns if c not in added]
    gone = removed_chunks(docs, divisor, long_line)
    joined = _key(docs).repartition("__k", "__h").join(gone, ["__k", "__h"], "left")
    bound = F.transform(
        F.array(F.struct(chunks(_text(), divisor, long_line).alias("cut"), F.col("__gone").alias("gone"))),
        lambda p: F.struct(
            F.array_join(F.flatten(F.filter(p["cut"], lambda c, j: ~F.array_contains(p["gone"], j))), "\n").alias("text"),
            F.aggregate(p["cut"], F.lit(0), lambda n, c: n + F.size(c)).alias("n_lines"),
            F.aggregate(p["gone"], F.lit(0), lambda n, j: n + F.size(F.get(p["cut"], j))).alias("n_removed_lines"),
            F.size(p["gone"]).alias("n_removed_chunks"),
        ),
    )[0]
    done = joined.withColumn("__made", F.when(F.col("__gone").isNotNull(), bound))
    columns = [F.when(F.col("__gone").isNull(), F.col(c)).otherwise(F.col("__made.text")).alias(c) if c == "text" else F.col(c) for c in rest]
    if counts:
        lines = F.size(F.split(_text(), "\n", -1))
        columns += [F.coalesce("__made.n_lines", lines).cast("long").alias("n_lines"), F.coalesce("__made.n_removed_lines", F.lit(0)).cast("long").alias("n_removed_lines"), F.coalesce("__made.n_removed_chunks", F.lit(0)).cast("long").alias("n_removed_chunks")]
    return done.select(*columns)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_line_chunks(read_table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


#: Rows of ``source`` (doc_id, text) without the repeated chunks; ``made`` has one row per document.
CHUNKS_SQL = """
{p}lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM {source}
), {p}hashed AS (
  SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS lh FROM {p}lines
), {p}cuts AS (
  SELECT *, ((lh + 31 * coalesce(lag(lh, 1) OVER w, 0) + 961 * coalesce(lag(lh, 2) OVER w, 0)) % 3 = 0 OR length(line) >= 99 OR coalesce(length(lead(line) OVER w) >= 99, false))::INT AS cut
  FROM {p}hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), {p}numbered AS (
  SELECT *, coalesce(sum(cut) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM {p}cuts
), {p}chunks AS (
  SELECT doc_id, no, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM {p}numbered GROUP BY doc_id, no
), {p}ranked AS (
  SELECT *, (n >= 2 OR regexp_matches(chunk, '[^ \\t\\n\\x0B\\f\\r]')) AND row_number() OVER (PARTITION BY n, chunk ORDER BY doc_id, no) > 1 AS gone FROM {p}chunks
), {p}made AS (
  SELECT doc_id, coalesce(string_agg(chunk, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '') AS kept, sum(n)::BIGINT AS n_lines,
         coalesce(sum(n) FILTER (WHERE gone), 0)::BIGINT AS n_removed_lines, count(*) FILTER (WHERE gone) AS n_removed_chunks
  FROM {p}ranked GROUP BY doc_id
)"""

OP3_SQL = "WITH " + CHUNKS_SQL.format(p="", source="documents") + """
SELECT d.doc_id, CASE WHEN n_removed_chunks = 0 THEN text ELSE kept END AS text, n_lines, n_removed_lines, n_removed_chunks
FROM documents d JOIN made USING (doc_id)
"""

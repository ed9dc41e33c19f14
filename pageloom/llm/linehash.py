"""Substring dedup by hashing the sentences of lines.

A text is cut into units: a run of characters other than full stop and newline with the full stops and newlines after it. A
unit's normal form is lower-cased with white space collapsed; its digest is grouped over all documents. The occurrence that
ranks first by (doc_id, offset) always stays; every other one is a repeat. Repeats next to each other form a run (blank units
between or beside them belong to it). A run goes if it has at least ``min_words`` words, or is all of its document; shorter runs
are what texts have in common by chance or by custom, and stay. Repeated lines, paragraphs, passages within lines and copies are
all such runs. Offsets of what is removed are those of the original text.

Words are what white space separates; of scripts that are written without it, each character counts as one.

Each task first settles what it can by itself: of a digest's occurrences it has seen it keeps the first and gives up the
others, so that a unit that many documents share reaches the shuffle about once a task.

Null text is an empty text; null ids rank first. Rows of one doc_id with different texts rank by a hash of the text; fully
repeated rows count as one document and all get its result. Empty tables give empty results; other columns pass through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from pageloom.llm._util import arrow_batch, keyed, materialize, read_table, slices

UNIT = re.compile(r"[^.\n]+[.\n]*|[.\n]+")
SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
#: Scripts without spaces: Thai and Lao, Burmese, Khmer, kana, Chinese characters.
UNSPACED = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿"
WORD = re.compile(rf"[{UNSPACED}]|[^ \t\n\x0b\f\r{UNSPACED}]+")
MIN_WORDS = 20
HELD, SENT = 200_000, 20_000
UNITS = T.StructType([T.StructField(n, T.LongType()) for n in ("k", "h", "d1", "d2")] + [T.StructField("start", T.IntegerType()), T.StructField("lost", T.BooleanType())])


def units(text: str) -> list[tuple[int, bytes]]:
    """(start, digest) of the units that are not blank; offsets in code points."""
    found = []
    for m in UNIT.finditer(text):
        normal = SPACE.sub(" ", m[0].lower()).strip(" ")
        if normal:
            found.append((m.start(), hashlib.blake2b(normal.encode("utf-8", "surrogatepass"), digest_size=16).digest()))
    return found


def n_words(text: str) -> int:
    return len(text.split() if text.isascii() else WORD.findall(text))


def runs(text: str, repeats: set[int], min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """The runs that go, given the starts of the units that are repeats."""
    found, begin, words, whole = [], None, 0, True
    for m in UNIT.finditer(text):
        repeat = m.start() in repeats
        if repeat or not SPACE.sub("", m[0]):
            begin = m.start() if begin is None else begin
            words += n_words(m[0]) if repeat else 0
        else:
            whole = False
            if begin is not None and words >= min_words:
                found.append((begin, m.start()))
            begin, words = None, 0
    if begin is not None and (words >= min_words or whole and words):
        found.append((begin, len(text)))
    return found


def _occurrences(docs: DataFrame) -> DataFrame:
    """Every unit's key, digest and start; lost: an earlier one is known already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[bytes, tuple] = {}

        def batches_of(rows: list[tuple], lost: bool) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(rows), SENT):
                k, h, start, each = zip(*rows[a : a + SENT], strict=True)
                digests = np.frombuffer(b"".join(each), "<i8").reshape(-1, 2)
                yield arrow_batch(UNITS, [list(k), list(h), digests[:, 0], digests[:, 1], list(start), [lost] * len(k)])

        for part in slices(batches):
            lost = []
            for k, h, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                for start, digest in units(text):
                    row = (k, h, start, digest)
                    held = first.setdefault(digest, row)
                    if held[:3] < row[:3]:
                        lost.append(row)
                    elif row[:3] < held[:3]:
                        lost.append(held)
                        first[digest] = row
            yield from batches_of(lost, True)
            if len(first) > HELD:
                yield from batches_of(list(first.values()), False)
                first = {}
        yield from batches_of(list(first.values()), False)

    return keyed(docs).mapInArrow(run, UNITS)


def repeated_units(docs: DataFrame) -> DataFrame:
    """k, h and starts: the array of the starts of a document's repeats."""
    found = materialize(_occurrences(docs))
    order = Window.partitionBy("d1", "d2").orderBy("k", "h", "start")
    later = found.filter(~F.col("lost")).withColumn("place", F.rank().over(order)).filter("place > 1")
    gone = found.filter("lost").select("k", "h", "start").unionByName(later.select("k", "h", "start"))
    return gone.groupBy("k", "h").agg(F.collect_set("start").alias("starts"))


def cut(text: str, spans: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without spans (sorted, apart), and the bytes removed."""
    kept, at, n_bytes = [], 0, 0
    for start, end in spans:
        kept.append(text[at:start])
        n_bytes += len(text[start:end].encode("utf-8", "surrogatepass"))
        at = end
    kept.append(text[at:])
    return "".join(kept), n_bytes


def dedup_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with ``text`` cut, and the columns spans (start, end of the runs that went), n_removed (bytes) and n_spans.

    A null text stays null. Columns of docs with those three names are replaced."""
    rest = [c for c in docs.columns if c not in ("spans", "n_removed", "n_spans")]
    own = docs.select(*rest, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("__k"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("__h"))
    repeats = repeated_units(docs).select(F.col("k").alias("__k"), F.col("h").alias("__h"), F.col("starts").alias("__starts"))

    @F.pandas_udf("struct<text:string,n_removed:long,spans:array<struct<start:int,end:int>>>")
    def apply(texts: pd.Series, all_starts: pd.Series) -> pd.DataFrame:
        made = []
        for t, starts in zip(texts, all_starts, strict=True):
            spans = runs(t, set(starts.tolist()), min_words) if starts is not None and t is not None else []
            made.append((*(cut(t, spans) if spans else (t, 0)), [{"start": a, "end": b} for a, b in spans]))
        return pd.DataFrame(made, columns=["text", "n_removed", "spans"])

    joined = own.join(repeats, ["__k", "__h"], "left").withColumn("__cut", apply("text", "__starts"))
    columns = [F.col("__cut.text").alias("text") if c == "text" else F.col(c) for c in rest]
    return joined.select(*columns, F.col("__cut.spans").alias("spans"), F.col("__cut.n_removed").alias("n_removed"), F.size("__cut.spans").cast("long").alias("n_spans"))


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    done = dedup_units(docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), spans.alias("removed_offsets"))


#: What WORD matches, for a text with its white space collapsed.
WORD_SQL = r"[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]|[^ \x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]+"

OP5_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^.\n]+[.\n]*|[.\n]+') AS us FROM documents
), one AS (
  SELECT doc_id, unnest(us) AS unit, generate_subscripts(us, 1) AS i FROM cut
), placed AS (
  SELECT *, sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY i) AS fin,
         trim(regexp_replace(lower(unit), '[ \t\n\x0b\f\r]+', ' ', 'g'), ' ') AS normal
  FROM one
), ranked AS (
  SELECT *, normal = '' OR row_number() OVER (PARTITION BY normal ORDER BY doc_id, i) > 1 AS rep FROM placed
), islands AS (
  SELECT *, sum((NOT rep)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS island, CASE WHEN rep THEN len(regexp_extract_all(normal, '{word}')) ELSE 0 END AS n FROM ranked
), summed AS (
  SELECT *, sum(n) OVER (PARTITION BY doc_id, island) AS words, bool_and(rep) OVER (PARTITION BY doc_id) AS whole FROM islands
), judged AS (
  SELECT *, rep AND (words >= 20 OR whole AND words > 0) AS gone FROM summed
), spans AS (
  SELECT doc_id, island, min(fin - length(unit)) || '-' || max(fin) AS span FROM judged WHERE gone GROUP BY doc_id, island
), listed AS (
  SELECT doc_id, count(*) AS n_spans, string_agg(span, ',' ORDER BY island) AS removed_offsets FROM spans GROUP BY doc_id
), made AS (
  SELECT doc_id, sum(CASE WHEN gone THEN octet_length(encode(unit)) ELSE 0 END) AS n_removed, string_agg(CASE WHEN gone THEN '' ELSE unit END, '' ORDER BY i) AS kept
  FROM judged GROUP BY doc_id
)
SELECT c.doc_id, octet_length(encode(c.text)) AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(coalesce(kept, '')) AS kept_sha256, coalesce(removed_offsets, '') AS removed_offsets
FROM cut c LEFT JOIN made USING (doc_id) LEFT JOIN listed USING (doc_id)
""".replace("{word}", WORD_SQL)

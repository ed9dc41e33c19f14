"""Helpers shared by the corpus operators: stable text columns, bounded selections, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.sources.shared import materialize, shared_dir

__all__ = ["materialize", "shared_dir"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id as long and text with null as empty; no other column is read."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def keyed(docs: DataFrame) -> DataFrame:
    """k (doc_id, null as the least long), h (hash of the text) and text (null as empty).

    (k, h) names a row: rows of one doc_id with different texts are told apart, fully repeated rows count as one. A doc_id of
    -2^63 and a null one are the same."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k"), F.xxhash64(text).alias("h"), text.alias("text"))


def least_by_hash(df: DataFrame, column: str, n: int) -> DataFrame:
    """At most n rows of df, those whose column hashes least (ties by the column).

    A bound on the hash leaves about 4 n rows to be sorted, however many partitions there are."""
    x, total = F.xxhash64(column), df.count()
    if total > 8 * n:
        df = df.filter(x < -(1 << 63) + (1 << 64) * 4 * n // total)
    return df.orderBy(x, column).limit(n)


def most_counted(df: DataFrame, count: str, most: int) -> DataFrame:
    """The rows with the greatest counts, most of them at most; whole ranges of counts, so that no tie is cut. A histogram of
    a few hundred ranges is all that reaches the driver."""
    level = F.floor(F.log2(count) * 8).cast("int")
    sizes = df.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, total = None, 0
    for at, n in sorted(((r["level"], r["n"]) for r in sizes), reverse=True):
        total += n
        if total > most:
            break
        least = at
    return df.filter(level >= least) if least is not None else df.limit(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice holds about most_bytes of one string column (one longer row stays whole)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.asarray(pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0).cast(pa.int64()))
        step = np.cumsum(sizes) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def arrow_batch(schema: T.StructType, columns: list) -> pa.RecordBatch:
    """A record batch of schema's types from numpy arrays, lists or Arrow arrays, in schema's order."""
    from pyspark.sql.pandas.types import to_arrow_schema

    want = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, want, strict=True)], schema=want)

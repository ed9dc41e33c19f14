"""Toxicity by non-negative positive-unlabelled learning.

A linear numpy classifier over word and word-beginning features learns from confirmed toxic texts (positives) and from texts
of any or no label (unlabelled). Its risk is pi * E_p[l(g)] + max(0, E_u[l(-g)] - pi * E_p[l(-g)]) with the class prior pi;
where the corrected negative part falls below zero, its gradient is followed upwards instead (the non-negative correction).

The classifier is fitted on bounded samples: at most ``max_positive`` positives and ``max_unlabelled`` unlabelled rows,
taken in the order of a hash of doc_id, and at most ``max_features`` features. Scoring covers all rows and whole texts.
Rows whose crc32(doc_id as text) leaves 0 modulo ``folds`` are held out: neither their text nor their label is learnt from.

Null text is an empty text and scores as one; a null doc_id is the empty string for the fold (held out). Labels other than 1
are not positives; labels of unknown documents and repeated label rows are harmless. Without positives every text scores
the prior, 0 where no label is known. Empty tables give empty results; other columns pass through untouched.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm._util import arrow_batch, id_and_text, least_by_hash, read_table, slices

WORD = re.compile(r"\w+")
BITS = 20
BEGINNING = 5
CACHE = 300_000
SAMPLED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("features", T.BinaryType())])


def word_features(word: str) -> tuple[int, ...]:
    """A word's feature, and that of its first letters if it is longer."""
    mask = (1 << BITS) - 1
    own = zlib.crc32(word.encode()) & mask
    return (own, zlib.crc32(b"^" + word[:BEGINNING].encode()) & mask) if len(word) > BEGINNING else (own,)


class _Features(dict):
    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > CACHE:
            self.clear()
        self[word] = found = word_features(word)
        return found


def text_features(text: str, known: dict) -> set[int]:
    return {f for word in set(WORD.findall(text.lower())) for f in known[word]}


@dataclass
class Model:
    weights: dict[int, float]
    bias: float

    def score(self, features: set[int]) -> float:
        g = self.bias + sum(self.weights[f] for f in sorted(features & self.weights.keys()))
        return float(1 / (1 + np.exp(-np.clip(g, -500, 500))))


def held_out(folds: int = 5, doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0)) % folds == 0


def _csr(rows: list[np.ndarray], keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column numbers among keep (sorted) and row starts."""
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    at = np.searchsorted(keep, flat)
    hit = (at < len(keep)) & (keep[np.minimum(at, max(len(keep) - 1, 0))] == flat) if len(keep) else np.zeros(len(flat), bool)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])[hit]
    return at[hit], np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(rows)))]).astype(np.int64)


def _margins(w: np.ndarray, b: float, columns: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(w[columns])])
    return total[starts[1:]] - total[starts[:-1]] + b


def risk(theta: np.ndarray, prior: float, positive: tuple, unlabelled: tuple, ceiling: float = 0.0) -> tuple[float, np.ndarray]:
    """The non-negative risk and the gradient to descend; theta ends with the bias, rows are (columns, row of each, row starts).

    Where the corrected negative part is below ceiling, the gradient is that of its opposite."""

    def pull(d: np.ndarray, rows: tuple) -> np.ndarray:
        return np.concatenate([np.bincount(rows[0], d[rows[1]], minlength=len(theta) - 1), [d.sum()]])

    gp, gu = (_margins(theta[:-1], theta[-1], rows[0], rows[2]) for rows in (positive, unlabelled))
    yes_p, yes_u = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
    negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    g_negative = pull(yes_u / len(gu), unlabelled) - prior * pull(yes_p / len(gp), positive)
    value = prior * np.logaddexp(0, -gp).mean() + max(0.0, negative)
    return float(value), -g_negative if negative < ceiling else prior * pull((yes_p - 1) / len(gp), positive) + g_negative


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, max_features: int = 4096, least_z: float = 4.0, steps: int = 400, rate: float = 0.1, l2: float = 1e-4, ceiling: float = 0.0) -> Model:
    """Non-negative PU learning; each row is an array of distinct feature numbers.

    Features are those whose share among positives differs from that among unlabelled rows by at least least_z standard
    errors, the clearest max_features of them."""
    if not positive or not unlabelled or not 0 < prior < 1:
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return Model({}, float(np.log(p / (1 - p))))
    n = 1 << BITS
    in_p = np.bincount(np.concatenate(positive), minlength=n) / len(positive)
    in_u = np.bincount(np.concatenate(unlabelled), minlength=n) / len(unlabelled)
    both = (in_p * len(positive) + in_u * len(unlabelled)) / (len(positive) + len(unlabelled))
    z = (in_p - in_u) / np.sqrt(both * (1 - both) * (1 / len(positive) + 1 / len(unlabelled)) + 1e-12)
    clear = np.flatnonzero(np.abs(z) >= least_z)
    keep = np.sort(clear[np.argsort(-np.abs(z[clear]), kind="stable")][:max_features])
    (cp, sp), (cu, su) = _csr(positive, keep), _csr(unlabelled, keep)
    rp, ru = np.repeat(np.arange(len(positive)), np.diff(sp)), np.repeat(np.arange(len(unlabelled)), np.diff(su))
    theta = np.concatenate([np.zeros(len(keep)), [np.log(prior / (1 - prior))]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)

    for step in range(1, steps + 1):
        _, grad = risk(theta, prior, (cp, rp, sp), (cu, ru, su), ceiling)
        grad[:-1] += l2 * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model({int(k): float(w) for k, w in zip(keep, theta[:-1], strict=True)}, float(theta[-1]))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, max_positive: int = 3000, max_unlabelled: int = 12000) -> Model:
    """Fit on the bounded samples described above; only they reach the driver."""
    spark = docs.sparkSession
    learn = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(folds))
    prior = learn.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    ranked = lambda df, n: least_by_hash(df.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", n)
    yes = {r[0] for r in ranked(learn.filter("toxic = 1"), max_positive).collect()}
    other = {r[0] for r in ranked(docs.select("doc_id").filter(F.col("doc_id").isNotNull() & ~held_out(folds)), max_unlabelled).collect()}
    if not yes or not other:
        return fit([], [], prior)
    wanted = spark.createDataFrame([(i,) for i in sorted(yes | other)], "doc_id long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Features()
        for part in slices(batches):
            yield arrow_batch(SAMPLED, [part.column(0), [np.array(sorted(text_features(t, known)), "<i4").tobytes() for t in part.column(1).to_pylist()]])

    # at most max_positive + max_unlabelled ids are broadcast; a repeated doc_id counts once
    rows = id_and_text(docs).join(F.broadcast(wanted), "doc_id", "left_semi").mapInArrow(run, SAMPLED).groupBy("doc_id").agg(F.min("features").alias("features")).collect()
    found = {r["doc_id"]: np.frombuffer(r["features"], "<i4") for r in rows}
    return fit([found[i] for i in sorted(yes & found.keys())], [found[i] for i in sorted(other & found.keys())], prior)


def toxicity_score(model: Model, text: str | Column = "text") -> Column:
    """A column of scores from 0 to 1 for a text column."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _Features()
        for texts in parts:
            yield pd.Series([model.score(text_features(t or "", known)) for t in texts], dtype="float64")

    return score(F.col(text) if isinstance(text, str) else text)


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score and predicted (1 where score >= 0.5) of every document."""
    model = train(docs, labels, folds)
    scored = docs.select("doc_id", held_out(folds).alias("held_out"), toxicity_score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_non_toxic(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """docs without the rows that the classifier rejects; columns as given."""
    score = toxicity_score(train(docs, labels, folds)).alias("__toxicity")
    return docs.select("*", score).filter(F.col("__toxicity") < 0.5).drop("__toxicity")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))

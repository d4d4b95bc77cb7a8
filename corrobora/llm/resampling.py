"""Target-distribution importance resampling: documents drawn by how much likelier their n-grams are in a target."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.llm.ngram_table import grams_of, intern
from corrobora.llm.tables import placed_by, sums_before
from corrobora.session import cut_lineage


def bucket_counts(texts: DataFrame, buckets: int, longest: int = 2) -> np.ndarray:
    """How many n-gram occurrences of the one text column fall in each bucket (CRC-32 of the bytes modulo ``buckets``).

    Every task adds its whole partition up, so a task sends one row per bucket at most, and so does the sum.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, grams in grams_of(batch.column(0), longest):
                found = intern(grams, buckets)
                np.add.at(total, found.bucket, found.count)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for row in texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray, scale: int = 1_000) -> np.ndarray:
    """The scaled log ratio of the smoothed bucket shares of target and corpus, rounded down."""
    n, s, t = len(corpus), float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([
        math.floor(scale * math.log((float(target[b]) + 1.0) * s / ((float(corpus[b]) + 1.0) * t))) for b in range(n)
    ], dtype=np.int64)


def _noise(doc_id: int | None, seed: int, scale: int) -> int:
    """Gumbel noise of a document, the same in every run: the top-k of weight plus noise is a weighted draw."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-float(scale) * math.log(-math.log((h + 0.5) / 4294967296.0)))


def importance(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 2, seed: int = 7, scale: int = 1_000) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) for every row of ``docs(doc_id, text)`` against ``target(text)``.

    Texts become n-gram occurrences in slices of about a megabyte; an open-addressed table interns them, so hashing to
    buckets is done once per distinct n-gram of a slice, and occurrences gather the gains of their slots. The corpus is
    read twice: for the bucket counts, whose size is fixed by ``buckets``, and for the weights.

    Edge cases: null and empty texts have no features and weight 0; a null doc_id has noise of its own; repeated rows
    are rows; an empty target or corpus counts as flat; other columns are ignored.
    """
    text = F.col("text").cast("string").cast("binary").alias("text")
    gains = bucket_gains(bucket_counts(docs.select(text), buckets, longest), bucket_counts(target.select(text), buckets, longest), scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, features, weights = ([np.zeros(0, dtype=np.int64)] for _ in range(3))
            for _, grams in grams_of(batch.column(1), longest):
                found = intern(grams, buckets)
                many = len(grams.n_words)
                held = np.bincount(grams.doc, minlength=many)
                # whole numbers far below 2**53, so sums in doubles are exact
                total = np.bincount(grams.doc, weights=gains[found.bucket][found.slot], minlength=many).astype(np.int64)
                n.append(grams.n_words), features.append(held)
                weights.append(np.where(held > 0, total // np.maximum(held, 1), 0))
            weight = np.concatenate(weights)
            noise = np.array([_noise(i, seed, scale) for i in batch.column(0).to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in (np.concatenate(n), np.concatenate(features), weight, weight + noise)]],
                names=["doc_id", "n_words", "n_features", "weight", "score"],
            )

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    return base.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def draw(scored: DataFrame, percent: int = 25, least_words: int = 20) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3... for the ``percent`` of rows with ``least_words`` that score highest, else null.

    Ties go to the smaller doc_id, null last, then to fewer features. Ranks come from prefix sums over a range
    partitioning by score, so no task sorts all rows.
    """
    rows = scored.withColumn("able", (F.col("n_words") >= least_words).cast("long")).withColumn("down", -F.col("score")).withColumn(
        "last", F.col("doc_id").isNull()
    )
    order = ["down", "last", "doc_id", "n_features", "weight", "able"]
    placed = placed_by(rows, [], order)
    n = placed.agg(F.sum("able")).first()[0] or 0
    at = F.col("before") + 1
    return sums_before(placed, [], order, "able", "before").withColumn(
        "rank", F.when((F.col("able") == 1) & (at <= percent * n // 100), at)
    ).drop("able", "down", "last", "before")


def resampled_documents(docs: DataFrame, target: DataFrame, percent: int = 25, **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id is drawn, with all their columns and texts."""
    drawn = cut_lineage(draw(importance(docs, target, **options), percent).where("rank is not null and doc_id is not null").select("doc_id").distinct())
    return docs.join(drawn, "doc_id", "left_semi")

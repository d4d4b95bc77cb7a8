"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.llm.columns import word_count
from corrobora.llm.tables import placed_by, small, sums_before
from corrobora.session import cut_lineage

#: Relative weight over training time, one list of (time, weight) knots per place in the cycle of sources: the first
#: fades out, the second stays level, the third fades in.
FADING = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))


def demand_pieces(knots: Sequence[tuple[float, float]]) -> list[dict[str, float]]:
    """The integral of a piecewise linear weight schedule, scaled to 1: one quadratic piece per pair of knots.

    Inside a piece, at fraction x of its time, the cumulative demand is ``done + level * x + bend * x * x``.
    """
    if len(knots) < 2 or any(b[0] <= a[0] or min(a[1], b[1]) < 0 for a, b in zip(knots, knots[1:], strict=False)):
        raise ValueError("a schedule needs two or more knots in rising time with weights of at least 0")
    total = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
    if total <= 0:
        raise ValueError("a schedule must have some weight")
    pieces, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        level, bend = (t1 - t0) * w0 / total, (t1 - t0) * (w1 - w0) / (2 * total)
        pieces.append({"start": t0, "span": t1 - t0, "level": level, "bend": bend, "done": done, "end": done + level + bend})
        done = pieces[-1]["end"]
    pieces[-1]["end"] = math.inf
    return pieces


def training_time(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the cumulative demand of a schedule reaches ``share`` of its whole: its exact inverse."""
    pieces = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in p.items()]) for p in demand_pieces(knots)])
    piece = F.filter(pieces, lambda p: share <= p["end"])[0]
    rest = share - piece["done"]
    root = F.sqrt(piece["level"] * piece["level"] + F.lit(4.0) * piece["bend"] * rest)
    x = F.coalesce(F.try_divide(F.lit(2.0) * rest, piece["level"] + root), F.lit(0.0))
    return piece["start"] + piece["span"] * x


def _millionths(knots: Sequence[tuple[float, float]]):
    return lambda middle: F.floor(training_time(middle / F.col("target"), knots) * 1e6).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """(source, source_size, place, weight, target) from ``sizes(source, size)``.

    Sources by code point, null last, take the weights in turn. They share ``share`` times all words by weight; a
    target stops at ``most`` times its source's size and the excess goes to the others by weight until none is above.
    The common level is found by a few aggregates; sources stay a table.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_last", F.col("source").isNull().cast("int"))
    placed = placed_by(totals.withColumn("_one", F.lit(1)), [], ["_last", "source"])
    numbered = sums_before(placed, [], ["_last", "source"], "_one", "place").drop("_one", "_last")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = cut_lineage(
        numbered.withColumn("place", (F.col("place") % len(weights)).cast("int")).withColumn("weight", F.get(cycle, F.col("place")))
        .withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    )
    whole, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, capped, taken_weight = share * float(whole or 0), 0.0, 0.0
    while True:
        free = (weight or 0.0) - taken_weight
        level = (budget - capped) / free if free > 0 else math.inf
        full = F.col("_cap") < F.lit(level) * F.col("weight")
        row = sources.agg(F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(full, F.col("weight")))).first()
        now = (row[0] or 0.0, row[1] or 0.0)
        if now == (capped, taken_weight) or free <= 0:
            break
        capped, taken_weight = now
    return sources.withColumn("target", F.least(F.col("_cap"), F.lit(level) * F.col("weight"))).drop("_cap")


def mix_plan(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
    schedule: Sequence[Sequence[tuple[float, float]]] = FADING,
) -> DataFrame:
    """What the mix takes of every row of ``docs(doc_id, text, source)`` and when it is trained on.

    Returns (doc_id, source, size, source_size, target, taken, positions, first_position), range-sorted by first position.

    * ``size``: words of the whole text. ``target``: words its source is to give (``source_targets``).
    * The documents of a source, in the order of md5(doc_id), form a stream that is repeated up to ``most`` times. The mix takes
      the stream up to the target; a document is in if its middle is. So a source misses its target by half a document
      at most, and no document is taken more than ``most`` times.
    * ``positions``: for every time it is taken, the training time in millionths at which the source's cumulative
      demand, the integral of its weight schedule, reaches the document's place in the stream.

    Edge cases: null and blank texts have size 0 and are taken zero words; they have positions like others if their
    source has a target above 0. Rows that repeat a doc_id are separate documents next to each other. A null source is a source. Empty input
    gives no rows. Other columns are ignored. Running sums never bring a source into one task.
    """
    passes = math.ceil(most)
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")
    ).withColumn("_key", F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("")))
    order = ["_key", "doc_id", "size"]
    placed = placed_by(sized, ["source"], order)
    targets = source_targets(placed, weights, share, most)
    stream = sums_before(placed, ["source"], order, "size", "_start")
    known = small(targets.select(F.col("source").alias("_source"), "source_size", "place", "target"))
    rows = stream.join(known, F.col("source").eqNullSafe(F.col("_source")))
    middles = F.transform(
        F.sequence(F.lit(0), F.lit(passes - 1)),
        lambda p: p * F.col("source_size") + F.col("_start") + F.col("size") / F.lit(2.0),
    )
    rows = rows.withColumn("_middles", F.filter(middles, lambda m: (m <= F.col("target")) & (F.col("target") > 0)))
    curve = F.lit(None)
    for place, knots in reversed(list(enumerate(schedule))):
        timed = F.transform("_middles", _millionths(knots))
        curve = F.when(F.col("place") % len(schedule) == place, timed).otherwise(curve)
    rows = rows.withColumn("positions", curve)
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.size("_middles")).alias("taken"), "positions",
        F.get("positions", F.lit(0)).alias("first_position"),
    ).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def training_sequence(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as ``plan`` takes them, range-sorted by their ``position``; doc_id must be unique."""
    times = plan.select("doc_id", F.posexplode("positions").alias("epoch", "position"))
    return docs.join(times, "doc_id").orderBy("position", "doc_id", "epoch")

"""Near-duplicate documents by one-permutation minhash, banded buckets and star-shaped candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType
from pyspark.sql.window import Window

from corrobora.llm.shingles import OnePermutation, fingerprint, shingle_set
from corrobora.llm.tables import connected_components, small
from corrobora.session import cut_lineage



def _signatures(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        oph = OnePermutation(bands, rows)
        for batch in batches:
            sizes, prints, keys = [], [], []
            for text in batch.column(1):
                found = shingle_set(text.as_py(), words)
                sizes.append(len(found))
                prints.append(fingerprint(found) if len(found) else None)
                keys.append(oph.keys(found) if len(found) else np.zeros(0, dtype=np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["doc_id", "n_shingles", "fp", "bands"],
            )

    return run


def _prints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(shingle_set(text.as_py(), words)) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), batch.column(0)], names=["fp", "body"])

    return run


def _confirm(words: int, percent: int):
    """Keeps the pairs whose full sets reach the similarity. A run of pairs with one left text hashes it once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, one = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            keep = []
            for a, body_a, body_b in zip(batch.column(0), batch.column(2), batch.column(3), strict=True):
                if a.as_py() != last:
                    last, one = a.as_py(), shingle_set(body_a.as_py(), words)
                two = shingle_set(body_b.as_py(), words)
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * both >= percent * (len(one) + len(two) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _links_in_blocks(words: int, percent: int):
    """Compares two blocks of a bucket exactly and emits links that join different components, a spanning set of them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [shingle_set(body, words) for body in pdf["body"]]
        sizes = np.array([len(s) for s in sets])
        comp, ids = pdf["comp"].to_numpy(), pdf["id"].to_numpy()
        names, of, held_by = np.unique(comp, return_inverse=True, return_counts=True)
        minor = of != held_by.argmax()  # every pair of different components has an end outside the largest one
        block = pdf["block"].to_numpy()
        left = np.flatnonzero(minor)
        right = np.arange(len(sets))
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        kept = count[code] > 1
        owner, code = owner[kept], np.unique(code[kept], return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        both = np.zeros((len(left), len(right)), dtype=np.float32)
        width = 4096  # a slice of shingles at a time bounds the matrices
        for start in range(0, int(code[-1]) + 1 if len(code) else 0, width):
            at = slice(np.searchsorted(code, start), np.searchsorted(code, start + width))
            held = np.zeros((len(sets), width), dtype=np.float32)
            held[owner[at], code[at] - start] = 1
            both += held[left] @ held[right].T
        near = (100 + percent) * both >= percent * (sizes[left][:, None] + sizes[right][None, :])
        root = {c: c for c in names}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        other = comp[left][:, None] != comp[right][None, :]
        if block.min() != block.max():  # pairs inside one block meet in that block's own group
            other &= block[left][:, None] != block[right][None, :]
        for x, y in np.argwhere(near & other):
            one, two = find(comp[left[x]]), find(comp[right[y]])
            if one != two:
                root[one] = two
                out.append((ids[left[x]], ids[right[y]]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _blocked(live: DataFrame, bodies: DataFrame, words: int, percent: int, block: int) -> DataFrame:
    """Links between the components of every open bucket. A bucket is cut into blocks of about ``block`` shingles, and
    every two blocks meet in a group of their own, so groups stay small however large the bucket is."""
    before = Window.partitionBy("bucket").orderBy("n", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = live.withColumn("block", F.floor((F.sum("n").over(before) - F.col("n")) / block).cast("int"))
    cut = cut_lineage(cut.select("bucket", "id", "comp", "block"))
    last = cut.groupBy("bucket").agg(F.collect_set("block").alias("blocks"))
    met = cut.join(last, "bucket").withColumn("other", F.explode("blocks")).select(
        "bucket", "id", "comp", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")
    )
    tasks = int(live.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # work follows groups, not bytes: no coalescing
    return met.join(bodies, "id").repartition(tasks, "bucket", "lo", "hi").groupBy("bucket", "lo", "hi").applyInPandas(_links_in_blocks(words, percent), "a long, b long")


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 64, rows: int = 8, block: int = 200_000, prints: bool = False
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs(doc_id, text)``; ``prints`` adds the set's ``fp``.

    Documents are linked when ``100 * intersection >= percent * union`` over their sets of ``words``-word shingles;
    a component is everything reachable over links, named by its smallest doc_id, whose document is kept.

    * Every set becomes ``bands`` bucket keys of ``rows`` minima each (one-permutation hashing, optimal densification).
      With 64 bands of 8 a pair at exactly 0.8 shares no bucket with probability 8e-6; more similar pairs are missed
      far more rarely.
    * Equal sets are one class; the rest works on classes, so copies never form pairs.
    * Candidates are stars: every class against the smallest centre of all its buckets, then against the centre of each
      bucket that still holds several components. Links are confirmed on the full sets of both texts; pairs whose set
      sizes rule a link out are not compared.
    * Buckets that are then still open are settled exactly: their classes meet block by block, with all intersections
      of two blocks from one matrix product, and only links that join components come out. So no link of a bucket is lost,
      and the rows made grow with the members of buckets, not with their pairs.

    Edge cases: null or blank text has an empty set, links with nothing and is its own component. A text of fewer words
    is one shingle. Rows that repeat a doc_id each get a row. A null doc_id takes part, is never a component's name
    unless nothing else is in it, and is kept only then. Other columns of ``docs`` are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    sketched = cut_lineage(
        base.mapInArrow(_signatures(words, bands, rows), "doc_id long, n_shingles long, fp binary, bands array<long>")
    )
    classes = cut_lineage(
        sketched.where("fp is not null").groupBy("fp")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    exploded = classes.select("id", "n", F.explode("bands").alias("bucket"))
    shared = cut_lineage(exploded.groupBy("bucket").count().where("count > 1").select("bucket"))
    members = cut_lineage(exploded.join(small(shared), "bucket").select("bucket", "id", "n"))
    candidates = cut_lineage(classes.join(small(cut_lineage(members.select("id").distinct())), "id", "left_semi").select("id", "fp", "rep"))
    has_text = F.length(F.regexp_replace(base["text"].cast("string"), r"[\x20\x09-\x0D]+", "")) > 0
    # a class may have no doc_id at all, so the texts without one are looked through as well
    named = base.join(small(candidates.select(F.col("rep").alias("doc_id"))), "doc_id", "left_semi").unionByName(base.where("doc_id is null"))
    bodies = cut_lineage(
        named.where(has_text).select("text")
        .mapInArrow(_prints(words), "fp binary, body binary").join(small(candidates.select("fp", "id")), "fp")
        .dropDuplicates(["id"]).select("id", "body")
    )

    def open_members(owner: DataFrame) -> DataFrame:
        placed = members.join(owner, "id")
        split = placed.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
        return cut_lineage(placed.join(split.select("bucket"), "bucket", "left_semi"))

    def merge(owner: DataFrame, links: DataFrame) -> DataFrame:
        if links.isEmpty():
            return owner
        roots = connected_components(
            links.join(owner.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a")
            .join(owner.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b")
            .select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        )
        named = owner.join(roots.withColumnRenamed("node", "comp"), "comp", "left")
        return cut_lineage(named.select("id", F.coalesce("root", "comp").alias("comp")))

    owner = candidates.select("id", F.col("id").alias("comp"))
    for one_each in (True, False):
        live = open_members(owner)
        star = live.groupBy("bucket").agg(F.min(F.struct("id", "n", "comp")).alias("c"))
        pairs = (
            live.join(star, "bucket").where("comp <> c.comp")
            .where(F.lit(100) * F.least("n", "c.n") >= F.lit(percent) * F.greatest("n", "c.n"))
            .select(F.col("c.id").alias("a"), F.col("id").alias("b"))
        )
        pairs = cut_lineage(pairs.groupBy("b").agg(F.min("a").alias("a")) if one_each else pairs.distinct())
        links = cut_lineage(
            pairs.join(bodies.select(F.col("id").alias("b"), F.col("body").alias("body_b")), "b")
            .join(bodies.select(F.col("id").alias("a"), F.col("body").alias("body_a")), "a")
            .select("a", "b", "body_a", "body_b").mapInArrow(_confirm(words, percent), "a long, b long")
        )
        owner = merge(owner, links)
    owner = merge(owner, cut_lineage(_blocked(open_members(owner), bodies, words, percent, block)))
    owned = classes.select("fp", "id", "rep").join(owner, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    names = owned.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = owned.join(names, "comp").select("fp", "component_id")
    out = sketched.drop("bands").join(named, "fp", "left")
    component = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), *["fp"] * prints).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def _with_print(text: int, words: int):
    """The rows as they are and the fingerprint of their set, null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(None if t is None else str(t).encode(), words) for t in batch.column(text).to_pylist()]
            prints = pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], names=[*batch.schema.names, "_fp"])

    return run


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document is kept by ``near_duplicates``; repeated rows of a doc_id are one document.

    Columns stay as they are. Rows without a doc_id stay when nothing with a doc_id is linked to them.
    """
    found = cut_lineage(near_duplicates(docs, words, percent, prints=True).select("doc_id", "component_id", "kept", "fp"))
    gone = found.where("not kept and doc_id is not null").select("doc_id").distinct()
    kept = docs.join(small(cut_lineage(gone)), "doc_id", "left_anti")
    nameless = cut_lineage(found.where("not kept and doc_id is null").select(F.col("fp").alias("_fp")).distinct())
    if not nameless.isEmpty():
        tagged = kept.where("doc_id is null").mapInArrow(_with_print(kept.columns.index("text"), words), StructType([*kept.schema, StructField("_fp", BinaryType())]))
        kept = kept.where("doc_id is not null").unionByName(tagged.join(nameless, "_fp", "left_anti").drop("_fp"))
    again = cut_lineage(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    return kept.join(small(again), "doc_id", "left_anti").unionByName(
        kept.join(small(again), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    )

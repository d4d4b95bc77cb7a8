"""N-gram Jaccard self-join with adaptive multi-match prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.llm.shingles import fingerprint, shingle_set
from corrobora.llm.tables import connected_components, placed_by, small, sums_before
from corrobora.session import cut_lineage

CHUNK = 1 << 12


def _packed(counts: np.ndarray) -> bytes:
    """A chunk of counters, as places and counts when few are in use, else as bytes or 32-bit numbers."""
    held = np.flatnonzero(counts)
    if 8 * len(held) < len(counts):
        return b"s" + held.astype(np.uint16).tobytes() + counts[held].astype(np.uint32).tobytes()
    return b"b" + counts.astype(np.uint8).tobytes() if counts.max() < 256 else b"w" + counts.astype(np.uint32).tobytes()


def _add_packed(total: np.ndarray, packed: bytes) -> None:
    kind, body = packed[:1], packed[1:]
    if kind == b"s":
        n = len(body) // 6
        total[np.frombuffer(body[: 2 * n], dtype=np.uint16)] += np.frombuffer(body[2 * n :], dtype=np.uint32)
    else:
        total += np.frombuffer(body, dtype=np.uint8 if kind == b"b" else np.uint32)


def token_frequencies(texts: DataFrame, words: int, buckets: int = 1 << 24) -> np.ndarray:
    """A byte per bucket of shingle hashes: 8 times the binary logarithm of 1 + how many documents hold one of its shingles.

    The table orders shingles from rare to frequent in the same way everywhere; every order gives whole results, so a
    table of fixed size will do. It counts all documents: each task adds up its partition, chunks of the tables are then
    added up as streams, and ``buckets`` bytes come to the driver whatever the size of the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int32)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(total, (shingle_set(text.as_py(), words) % np.uint64(buckets)).astype(np.int64), 1)
        held = [i for i in range(0, buckets, CHUNK) if total[i : i + CHUNK].any()]
        for at in range(0, len(held), 500):
            part = held[at : at + 500]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array([_packed(total[i : i + CHUNK]) for i in part], pa.binary())], names=["chunk", "counts"]
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _add_packed(sums.setdefault(chunk, np.zeros(min(CHUNK, buckets), dtype=np.int64)), counts.as_py())
        levels = [np.minimum(255, np.round(8 * np.log2(s + 1.0))).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], names=["chunk", "levels"])

    out = np.zeros(buckets, dtype=np.uint8)
    parts = texts.mapInArrow(count, "chunk int, counts binary").repartition("chunk").mapInArrow(add, "chunk int, levels binary")
    for row in parts.collect():
        level = np.frombuffer(row.levels, dtype=np.uint8)
        out[row.chunk : row.chunk + len(level)] = level
    return out


def adaptive_prefix(
    hashes: np.ndarray, levels: np.ndarray, percent: int, noise: float = 0.0, row_cost: float = 2.0, token_cost: float = 0.05
) -> tuple[int, np.ndarray]:
    """(m, prefix): how many shared prefix shingles a candidate needs, and the shingles to be looked up.

    With shingles in one order for all documents, rarest first, a pair that reaches the similarity overlaps in at least
    c = ceil(percent * size / 100) shingles of either set. So the first ``size - c + m`` shingles of both hold at least m
    common ones, and when the two documents chose different m, at least the smaller. A longer prefix reads more postings,
    each shingle costing about its frequency, but a candidate then needs m matches, so at most (postings read / m) others
    are verified, at a cost in proportion to the set. The m with the least estimated cost is taken, whatever it is.
    ``noise`` is what other shingles of its bucket add to the frequency of a shingle.
    """
    size = len(hashes)
    level = levels[(hashes % np.uint64(len(levels))).astype(np.int64)]
    order = np.lexsort((hashes, level))
    hashes, least = hashes[order], -(-percent * size // 100)
    shared = np.cumsum(np.maximum(np.exp2(level[order] / 8.0) - 2.0 - noise, 0.0))[size - least :]
    m = np.arange(1, least + 1)
    cost = row_cost * m + shared * (1.0 + token_cost * size / m)
    best = int(np.argmin(cost)) + 1
    return best, hashes[: size - least + best]


def _prefixes(words: int, percent: int, levels: np.ndarray):
    noise = float(np.exp2(np.median(levels) / 8.0) - 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, needs, tokens = [], [], [], []
            for text in batch.column(1):
                found = shingle_set(text.as_py(), words)
                sizes.append(len(found))
                need, prefix = adaptive_prefix(found, levels, percent, noise) if len(found) else (0, found)
                prints.append(fingerprint(found) if len(found) else None)
                needs.append(need), tokens.append(prefix.view(np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int32)
            flat = np.concatenate(tokens) if tokens else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(needs, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["doc_id", "n_shingles", "fp", "need", "prefix"],
            )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(text.as_py(), words) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([fingerprint(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], names=["fp", "body"]
            )

    return run


def _confirm(percent: int):
    """Keeps the pairs whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for body_a, body_b in zip(batch.column(2), batch.column(3), strict=True):
                one, two = (np.frombuffer(b.as_py(), dtype=np.uint64) for b in (body_a, body_b))
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * both >= percent * (len(one) + len(two) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _common(owner: np.ndarray, code: np.ndarray, rows: int, left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
    """How many codes the rows ``left`` and ``right`` have in common, as a matrix, from slices of the codes."""
    held_by = np.bincount(code)
    kept = held_by[code] > 1
    owner, code = owner[kept], np.unique(code[kept], return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    both = np.zeros((len(left), len(right)), dtype=np.float32)
    for start in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        at = slice(np.searchsorted(code, start), np.searchsorted(code, start + width))
        held = np.zeros((rows, width), dtype=np.float32)
        held[owner[at], code[at] - start] = 1
        both += held[left] @ held[right].T
    return both


def _coded(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    owner = np.repeat(np.arange(len(arrays)), [len(a) for a in arrays])
    return owner, np.unique(np.concatenate(arrays), return_inverse=True)[1]


LINKS = "a long, b long, n long"


def spanning(ids: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int]]:
    """A spanning set of the links ``pairs`` (places in ``ids``)."""
    root = np.arange(len(ids))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in pairs:
        one, two = find(x), find(y)
        if one != two:
            root[one] = two
            out.append((ids[x], ids[y]))
    return out


def _able(pdf: pd.DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the one block, places of the other, matrix of the pairs with enough prefix matches and fitting sizes)."""
    ids, block, need, sizes = (pdf[c].to_numpy() for c in ("id", "block", "need", "n"))
    one = np.flatnonzero(block == pdf["lo"].iat[0])
    two = np.flatnonzero(block == pdf["hi"].iat[0])
    owner, code = _coded([np.asarray(p) for p in pdf["prefix"]])
    able = _common(owner, code, len(pdf), one, two) >= np.minimum(need[one][:, None], need[two][None, :])
    low, high = sizes[one][:, None], sizes[two][None, :]
    able &= 100 * np.minimum(low, high) >= percent * np.maximum(low, high)
    if pdf["lo"].iat[0] == pdf["hi"].iat[0]:
        able &= ids[one][:, None] < ids[two][None, :]
    return one, two, able


def _wanted(percent: int):
    """The classes of two blocks that have a candidate in them: only their sets go to the meeting."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        one, two, able = _able(pdf, percent)
        ids = pdf["id"].to_numpy()
        found = np.unique(np.concatenate((ids[one[able.any(axis=1)]], ids[two[able.any(axis=0)]])))
        return pd.DataFrame({"lo": pdf["lo"].iat[0], "hi": pdf["hi"].iat[0], "id": found}).astype("int64")

    return run


def _met(percent: int):
    """Two blocks: prefix matches of all their pairs, full sets of the candidates, then a spanning set of the links and the
    number of linked documents of every class."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        one, two, able = _able(pdf, percent)
        ids, sizes, copies = (pdf[c].to_numpy() for c in ("id", "n", "copies"))
        rows, columns = np.flatnonzero(able.any(axis=1)), np.flatnonzero(able.any(axis=0))
        if not len(rows):
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype("Int64")
        left, right = one[rows], two[columns]
        used = np.unique(np.concatenate((left, right)))
        owner, code = _coded([np.frombuffer(b, dtype=np.uint64) for b in pdf["body"].to_numpy()[used]])
        both = _common(owner, code, len(used), np.searchsorted(used, left), np.searchsorted(used, right))
        near = able[np.ix_(rows, columns)] & ((100 + percent) * both >= percent * (sizes[left][:, None] + sizes[right][None, :]))
        x, y = np.nonzero(near)
        links = spanning(ids, np.column_stack((left[x], right[y])))
        held = np.bincount(left[x], weights=copies[right[y]], minlength=len(ids)) + np.bincount(right[y], weights=copies[left[x]], minlength=len(ids))
        linked = np.flatnonzero(held)
        return pd.DataFrame({
            "a": [a for a, _ in links] + list(ids[linked]), "b": pd.array([b for _, b in links] + [None] * len(linked), dtype="Int64"),
            "n": pd.array([None] * len(links) + list(held[linked].astype(np.int64)), dtype="Int64"),
        })

    return run


def _blocks(members: DataFrame, heavy: DataFrame, percent: int, most: int, wide: int) -> tuple[DataFrame, DataFrame]:
    """(blocks, meet): every class that holds a ``heavy`` token with its block, and the blocks lo <= hi that have to meet.

    Classes are range-partitioned by size and numbered by prefix sums into blocks of at most about ``most`` classes and
    ``wide`` shingles. Two blocks meet once, however many tokens their members share, and only when their sizes allow a link.
    """
    dense = members.join(heavy, "token", "left_semi")
    weight = F.greatest(F.col("n"), F.lit(max(1, wide // most)).cast("long"))
    lowest = dense.groupBy("id").agg(F.min("token").alias("near"), F.min("n").alias("n")).withColumn("weight", weight)
    order = ["n", "near", "id"]
    blocks = cut_lineage(
        sums_before(placed_by(lowest, [], order), [], order, "weight", "before")
        .select("id", "n", F.floor(F.col("before") / wide).cast("long").alias("block"))
    )
    held = dense.select("token", "id").join(blocks, "id").groupBy("token", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    left, right = (held.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("block", "least", "most")]) for s in "xy")
    meet = cut_lineage(
        left.join(right, "token").where("block_x <= block_y").where(F.lit(100) * F.col("most_x") >= F.lit(percent) * F.col("least_y"))
        .select(F.col("block_x").alias("lo"), F.col("block_y").alias("hi")).distinct()
    )
    return blocks, meet


def _meetings(rows: DataFrame, run, schema: str) -> DataFrame:
    """``run`` on the ``rows(lo, hi, block, ...)`` of every two blocks that meet."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # work follows groups, not bytes: no coalescing
    return cut_lineage(rows.repartition(tasks, "lo", "hi").groupBy("lo", "hi").applyInPandas(run, schema))


def _bodies(base: DataFrame, posted: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(id, body): the set of every class of ``wanted(id, fp, rep)``, from one of its texts where it lies.

    Only texts of repeated doc_ids, and of none, can give a class twice; they alone are compared.
    """
    again = cut_lineage(posted.where("fp is not null and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    reps = cut_lineage(wanted.where("rep is not null").select(F.col("rep").alias("doc_id")).distinct())
    named = base.where(F.col("text").isNotNull()).join(small(reps), "doc_id", "left_semi")
    once = named.join(small(again), "doc_id", "left_anti")
    more = named.join(small(again), "doc_id", "left_semi").unionByName(base.where("doc_id is null and text is not null"))
    sets = lambda rows: rows.select("text").mapInArrow(_sets(words), "fp binary, body binary").join(small(wanted.select("fp", "id")), "fp").select("id", "body")
    return cut_lineage(sets(once).unionByName(sets(more).dropDuplicates(["id"])))


def similar_documents(
    docs: DataFrame, words: int = 3, percent: int = 90, light: int = 32, most: int = 600, wide: int = 240_000
) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row of ``docs(doc_id, text)``.

    Documents link when ``100 * intersection >= percent * union`` over their sets of ``words``-word shingles. All links
    count, equal sets included; a component is what links reach, named by its smallest doc_id.

    * Equal sets are one class from the start. Every class chooses how many prefix matches it asks for
      (``adaptive_prefix``) and posts that many more shingles.
    * Shingles posted by at most ``light`` classes are joined to pairs; a pair with enough matches is verified on its
      full sets. The rows made are at most ``light`` per posting.
    * Classes that hold a more frequent posted shingle meet in blocks inside tasks instead: a matrix product counts the
      prefix matches of two blocks, and the pairs with enough of them are verified by another one. Only a spanning set of
      links and numbers of links leave the task, so no pairs of a large group are ever rows. No pair is left out and none is
      counted twice: pairs of two blocks that meet are taken out of the first way.

    Edge cases: null or blank text has an empty set, links with nothing and is its own component. A shorter text is one
    shingle. Repeated rows link with each other. A null doc_id takes part and names a component only if nothing else is
    in it. Other columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    levels = token_frequencies(base.select("text"), words)
    posted = cut_lineage(
        base.mapInArrow(_prefixes(words, percent, levels), "doc_id long, n_shingles long, fp binary, need int, prefix array<long>")
    )
    classes = cut_lineage(
        posted.where("fp is not null").groupBy("fp")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("need").alias("need"),
             F.first("prefix").alias("prefix"), F.count(F.lit(1)).alias("copies"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    postings = classes.select("id", "n", "need", F.explode("prefix").alias("token"))
    lists = cut_lineage(postings.groupBy("token").agg(F.count(F.lit(1)).alias("held")).where("held > 1"))
    members = cut_lineage(postings.join(lists, "token"))
    heavy = lists.where(F.col("held") > light).select("token")

    blocks, meet = _blocks(members, heavy, percent, most, wide)
    posts = blocks.select("id", "block").join(classes.select("id", "n", "need", "copies", "prefix"), "id")
    sides = meet.select("lo", "hi", F.col("lo").alias("block")).unionByName(meet.where("lo < hi").select("lo", "hi", F.col("hi").alias("block")))
    able = _meetings(sides.join(posts, "block"), _wanted(percent), "lo long, hi long, id long")
    few = members.where(F.col("held") <= light).select("token", "id", "n", "need")
    two = few.select("token", *[F.col(c).alias(f"{c}_b") for c in ("id", "n", "need")])
    counted = (
        few.join(two, "token").where("id < id_b").where(F.lit(100) * F.least("n", "n_b") >= F.lit(percent) * F.greatest("n", "n_b"))
        .groupBy(F.col("id").alias("a"), F.col("id_b").alias("b"))
        .agg(F.count(F.lit(1)).alias("matches"), F.min(F.least("need", "need_b")).alias("need"))
        .where("matches >= need").select("a", "b")
    )
    at = blocks.select("id", "block")
    placed = (
        counted.join(at.select(F.col("id").alias("a"), F.col("block").alias("x")), "a", "left")
        .join(at.select(F.col("id").alias("b"), F.col("block").alias("y")), "b", "left")
        .withColumn("lo", F.least("x", "y")).withColumn("hi", F.greatest("x", "y"))
    )
    seen = F.col("x").isNotNull() & F.col("y").isNotNull()
    placed = cut_lineage(placed)
    pairs = cut_lineage(
        placed.where(~seen).select("a", "b").unionByName(placed.where(seen).join(meet, ["lo", "hi"], "left_anti").select("a", "b"))
    )
    ids = cut_lineage(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(able.select("id")).distinct())
    bodies = _bodies(base, posted, cut_lineage(classes.select("id", "fp", "rep").join(ids, "id", "left_semi")), words)
    dense = _meetings(able.join(posts, "id").join(bodies, "id"), _met(percent), LINKS)
    sparse = cut_lineage(
        pairs.join(bodies.select(F.col("id").alias("b"), F.col("body").alias("body_b")), "b")
        .join(bodies.select(F.col("id").alias("a"), F.col("body").alias("body_a")), "a")
        .select("a", "b", "body_a", "body_b").mapInArrow(_confirm(percent), "a long, b long")
    )
    copies = classes.select(F.col("id").alias("other"), "copies")
    ends = sparse.select(F.col("a").alias("id"), F.col("b").alias("other")).union(sparse.select("b", "a"))
    counts = ends.join(copies, "other").select("id", F.col("copies").alias("n")).unionByName(
        dense.where("b is null").select(F.col("a").alias("id"), "n")
    )
    links = sparse.unionByName(dense.where("b is not null").select("a", "b"))
    roots = connected_components(links)
    named = (
        classes.select("fp", "id", "rep", "copies").join(roots.withColumnRenamed("node", "id"), "id", "left")
        .join(counts.groupBy("id").agg(F.sum("n").alias("n")), "id", "left")
        .select("fp", "rep", F.coalesce("root", "id").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    names = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    found = named.join(names, "root").select("fp", "component_id", "n_links")
    return posted.select("doc_id", "n_shingles", "fp").join(found, "fp", "left").select(
        "doc_id", "n_shingles", F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )

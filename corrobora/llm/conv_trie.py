"""Conversation prefix trie by truncation peeling: from the deepest turn to the root, the last turn is stripped and what
then is equal becomes one node, whose figures are complete at that moment."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corrobora.llm.tables import placed_by, small, sums_before
from corrobora.session import cut_lineage

KEY = ["k1", "k2"]
ITEM = ["depth", *KEY, "conv_id", "n", "children", "leaves", "saved", "path_bytes"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def borrowed_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its group of five."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(9)).cast("long")


def rebuild(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, bytes): the turns of every rebuilt conversation, and (conv_id, 0, null, 0) once for each.

    Texts are reduced to digests before the first shuffle. Positions come from prefix sums over a range partitioning, so
    a conversation of any length spans tasks. Only the first eight turns of a lender are ever copied, four times at most.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"), F.lit(1).alias("one"),
    )
    order = ["turn", "digest"]
    placed = cut_lineage(
        sums_before(placed_by(base, ["conv_id"], order), ["conv_id"], order, "one", "before")
        .select("conv_id", (F.col("before") + 1).alias("at"), "digest", "bytes")
    )
    convs = placed.groupBy("conv_id").agg(F.max("at").alias("own")).select(
        "conv_id", "own", borrowed_turns(F.col("conv_id")).alias("h"),
        (F.col("conv_id") - F.pmod("conv_id", F.lit(5))).alias("lender"),
    )
    lent = convs.select(F.col("conv_id").alias("lender"), F.col("own").alias("lent"))
    convs = cut_lineage(
        convs.join(lent, "lender", "left")
        .withColumn("taken", F.least("h", F.coalesce("lent", F.lit(0)))).select("conv_id", "h", "lender", "taken")
    )
    inherited = (
        placed.where((F.pmod("conv_id", F.lit(5)) == 0) & (F.col("at") <= 8)).withColumnRenamed("conv_id", "lender")
        .join(convs, "lender").where("at <= taken").select("conv_id", F.col("at").alias("depth"), "digest", "bytes")
    )
    own = placed.join(convs, "conv_id").where("at > h").select(
        "conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("depth"), "digest", "bytes"
    )
    spine = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("bytes"))
    return inherited.unionByName(own).unionByName(spine)


def prefix_keys(rebuilt: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, bytes, path_bytes) for every turn, written by depth.

    A key is the exclusive or of 120 hash bits of (depth, digest) over the turns so far, so it can be summed part by part
    like any prefix sum, and stripping the last turn gives the parent's key (p1, p2).
    """
    mixed = F.md5(F.concat_ws(":", F.col("depth").cast("string"), "digest").cast("binary"))
    half = lambda i: F.when(F.col("digest").isNull(), F.lit(0)).otherwise(F.conv(F.substring(mixed, i, 15), 16, 10).cast("long"))
    placed = placed_by(rebuilt.withColumn("x1", half(1)).withColumn("x2", half(17)), ["conv_id"], ["depth"])
    local = Window.partitionBy("conv_id", "_pid").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("conv_id").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("conv_id", "_pid").agg(F.bit_xor("x1").alias("t1"), F.bit_xor("x2").alias("t2"), F.sum("bytes").alias("tb"))
    # only conversations cut by a partition border need an offset: fewer than there are partitions
    cut = parts.groupBy("conv_id").count().where("count > 1").select("conv_id")
    offsets = parts.join(cut, "conv_id").select(
        "conv_id", "_pid", F.bit_xor("t1").over(earlier).alias("o1"), F.bit_xor("t2").over(earlier).alias("o2"),
        F.sum("tb").over(earlier).alias("ob"),
    )
    keyed = (
        placed.withColumn("k1", F.bit_xor("x1").over(local)).withColumn("k2", F.bit_xor("x2").over(local))
        .withColumn("path_bytes", F.sum("bytes").over(local)).join(small(cut_lineage(offsets)), ["conv_id", "_pid"], "left")
    )
    zero = F.lit(0).cast("long")
    keyed = (
        keyed.withColumn("k1", F.col("k1").bitwiseXOR(F.coalesce("o1", zero))).withColumn("k2", F.col("k2").bitwiseXOR(F.coalesce("o2", zero)))
        .withColumn("path_bytes", F.col("path_bytes") + F.coalesce("ob", zero))
    )
    return cut_lineage(
        keyed.select(
            "conv_id", "depth", *KEY, F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"),
            "bytes", "path_bytes",
        ).repartitionByRange("depth", "conv_id").sortWithinPartitions("depth", "conv_id")
    )


def _merged(items: DataFrame) -> DataFrame:
    """Items of one key become one node: conversations that end there and children that were stripped to it."""
    return items.groupBy("depth", *KEY).agg(
        F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.sum("children").alias("children"),
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.min("path_bytes").alias("path_bytes"),
    )


def _leaves() -> Column:
    """A node without children is a leaf itself, which is known once all that was stripped to it is merged."""
    return F.when(F.col("children") == 0, F.lit(1).cast("long")).otherwise(F.col("leaves")).alias("leaves")


def _chains(items: DataFrame, turns: DataFrame, floor: int, top: int) -> tuple[DataFrame, DataFrame]:
    """The nodes from every item down to the depth above ``floor``, and what is left of the items there.

    All nodes of such a run have the members of the item, so their figures follow from it and the bytes on the way.
    """
    run = turns.where((F.col("depth") > floor) & (F.col("depth") <= top)).select(
        "conv_id", F.col("depth").alias("at"), F.col("k1").alias("n1"), F.col("k2").alias("n2"), "p1", "p2", "bytes", F.col("path_bytes").alias("upto")
    )
    top_of = F.col("at") == F.col("depth")
    met = items.join(run, "conv_id").where("at <= depth").select(
        F.col("at").alias("depth"), F.col("n1").alias("k1"), F.col("n2").alias("k2"), "p1", "p2", "conv_id", "n",
        F.when(top_of, F.col("children")).otherwise(F.lit(1)).cast("long").alias("children"), _leaves(),
        (F.col("saved") + (F.col("n") - 1) * (F.col("path_bytes") - F.col("upto") + F.col("bytes"))).alias("saved"),
        (F.col("upto") - F.col("bytes")).alias("below"),
    )
    nodes = cut_lineage(met)
    left = nodes.where(F.col("depth") == floor + 1).select(
        F.lit(floor).cast("long").alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), "conv_id", "n",
        F.lit(1).cast("long").alias("children"), "leaves", "saved", F.col("below").alias("path_bytes"),
    )
    return nodes, left


def _peel(items: DataFrame, turns: DataFrame, floor: int, top: int, found: list[DataFrame]) -> DataFrame:
    """Strips ``items`` (depths above ``floor`` up to ``top``) down to ``floor``; appends the nodes on the way to ``found``.

    One level strips one turn. Over several levels, an item that is alone above its ancestor at ``floor`` merges with
    nothing on the way and is peeled in one go; the others are peeled half by half.
    """
    if top - floor == 1:
        nodes, left = _chains(_merged(items), turns, floor, top)
        found.append(nodes)
        return left
    ground = turns.where(F.col("depth") == floor + 1).select("conv_id", F.col("p1").alias("f1"), F.col("p2").alias("f2"))
    tagged = cut_lineage(_merged(items).join(ground, "conv_id"))
    shared = tagged.groupBy("f1", "f2").count().where("count > 1").select("f1", "f2")
    nodes, left = _chains(tagged.join(shared, ["f1", "f2"], "left_anti"), turns, floor, top)
    found.append(nodes)
    rest = cut_lineage(tagged.join(shared, ["f1", "f2"], "left_semi").select(*ITEM))
    if rest.isEmpty():
        return left
    middle = (floor + top) // 2
    deep = rest.where(F.col("depth") > middle)
    lower = rest.where(F.col("depth") <= middle)
    if not deep.isEmpty():
        lower = lower.unionByName(_peel(deep, turns, middle, top, found))
    return left.unionByName(_peel(lower, turns, floor, middle, found))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the runs of each node in order; the stream is sorted, so only one node is open at a time."""
    open_key, state = None, None
    for batch in batches:
        out = []
        for depth, k1, k2, run in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (depth, k1, k2) != open_key:
                if state is not None:
                    out.append((*open_key, state.hexdigest()))
                open_key, state = (depth, k1, k2), hashlib.sha256(run.encode())
            else:
                state.update(b"," + run.encode())
        if out:
            yield _hash_rows(out)
    if state is not None:
        yield _hash_rows([(*open_key, state.hexdigest())])


def _hash_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["depth", *KEY, "ends_sha256"])


def end_digests(ends: DataFrame, run: int = 1_000) -> DataFrame:
    """(depth, k1, k2, ends_sha256): SHA-256 of the ascending, comma-joined ids of the conversations that end in a node.

    Ids are range-partitioned and joined to runs of ``run`` where they lie; the digest, which only a sequence can give,
    then streams over one row per run, so a node where a third of all conversations end never lies in one row or list.
    """
    placed = placed_by(ends.select("depth", *KEY, "conv_id"), ["depth", *KEY], ["conv_id"])
    local = Window.partitionBy("depth", *KEY, "_pid").orderBy("conv_id")
    runs = (
        placed.withColumn("run", F.floor((F.row_number().over(local) - 1) / run)).groupBy("depth", *KEY, "_pid", "run")
        .agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    )
    tasks = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        runs.repartition(tasks, "depth", *KEY).sortWithinPartitions("depth", *KEY, "_pid", "run")
        .select("depth", *KEY, "ids").mapInArrow(_hashed, "depth long, k1 long, k2 long, ends_sha256 string")
    )


def prefix_trie(turns: DataFrame, single: int = 16) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations of ``turns(conv_id, turn, role, text)``.

    Columns: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves (of the
    subtree), saved_tokens (bytes of last texts that later members share, over the subtree), ends_sha256.

    Peeling starts at the deepest turn. At every depth the conversations that end there and the nodes that survive from
    below are merged by prefix key, which completes the node's counts, minimum and subtree sums; its last turn is
    stripped and it goes on as a child of its parent. The last ``single`` levels are peeled one by one; the depths above
    are halved again and again, and whatever is alone between two cuts is peeled at once, so one very deep conversation
    costs a logarithm of rounds. No row holds a sequence, and every grouping is aggregated before its shuffle.

    Edge cases: turns without a conv_id belong to no conversation; null turns come first, equal ones are ordered by the
    digest of role and text, repeated rows are turns of their own; null roles and texts are empty; conversations without
    turns end at the root; an empty table has no nodes; other columns are ignored.
    """
    keys = prefix_keys(rebuild(turns))
    last = keys.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    ends = cut_lineage(last.join(keys, ["conv_id", "depth"]).select("depth", *KEY, "conv_id", "path_bytes"))
    deepest = ends.agg(F.max("depth")).first()[0]
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    started = ends.select(
        "depth", *KEY, "conv_id", one.alias("n"), none.alias("children"), none.alias("leaves"), none.alias("saved"), "path_bytes"
    )
    cuts = list(range(min(single, deepest or 0) + 1))
    while cuts[-1] < (deepest or 0):
        cuts.append(min(deepest, 2 * cuts[-1]))
    found: list[DataFrame] = []
    left = started.limit(0)
    for floor, top in zip(cuts[-2::-1], cuts[:0:-1], strict=True):
        items = started.where((F.col("depth") > floor) & (F.col("depth") <= top)).unionByName(left)
        left = _peel(items, keys, floor, top, found)
    root = _merged(started.where(F.col("depth") == 0).unionByName(left)).withColumn("p1", F.lit(None).cast("long")).withColumn("p2", F.lit(None).cast("long"))
    columns = ["depth", *KEY, "p1", "p2", "conv_id", "n", "children", "leaves", "saved"]
    nodes = root.withColumn("leaves", _leaves()).select(*columns)
    for part in found:
        nodes = nodes.unionByName(part.select(*columns))
    nodes = cut_lineage(nodes)
    parents = nodes.where("children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id")
    )
    return (
        nodes.join(parents, ["depth", "p1", "p2"], "left").join(end_digests(ends), ["depth", *KEY], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
            F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
        )
    )

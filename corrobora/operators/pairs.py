"""Finding the pairs of entities that share something, without a task that holds a whole group.

Every pair operator of the library (similarity, projection, bridges, lenses) starts here. Three rules keep
the work proportional to the answer and even over tasks, whatever the size of a group:

* a pair is only formed inside the posting list of an item both sides have (never a cross join);
* when the score has a lower bound, only the *prefix* of each entity's items, rarest first, is joined. Items
  carried by a large part of all entities never reach the join unless they could decide the pair on their own;
* posting lists are cut into blocks of about ``BLOCK`` entities by hash, and blocks meet two by two, each two under a key
  of their own. So no task forms more than a block squared of pairs at a time, and no pair is left out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corrobora.session import cut_lineage, ordinal_within, top_by

BLOCK = 1_000
EPSILON = 1e-9


def prefix_items(items: DataFrame, threshold: float, absolute: bool = False) -> DataFrame:
    """Rows (entity, item, weight, rest, total, tail) that can be the rarest shared item of a pair at ``threshold``.

    ``items(entity, item, weight)``: the overlap of a pair is at most the weight an entity has left from the first
    shared item on (``rest``). With items sorted rarest first in one global order, a row is kept while that remainder is
    at least ``threshold`` times the entity's total (or ``threshold`` itself when ``absolute``). Jaccard >= t implies
    overlap >= t * total for both sides, so a qualifying pair always meets on a kept row. ``tail`` is the weight of the
    rows that were not kept.
    """
    freq = items.groupBy("item").agg(F.count(F.lit(1)).alias("_freq"))
    width = items.groupBy("entity").agg(F.count(F.lit(1)).alias("_width"), F.sum("weight").alias("total"))
    sized = items.select("entity", "item", "weight").join(freq, "item").join(width, "entity")
    # commonest first: the running sum is the weight from this item to the end of the rarest-first order
    order = Window.partitionBy("entity").orderBy(F.desc("_freq"), F.desc("item")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    floor = F.lit(float(threshold)) if absolute else F.col("total") * float(threshold)
    kept = (
        sized.withColumn("rest", F.sum("weight").over(order))
        .withColumn("_kept", F.col("rest") >= floor - F.lit(EPSILON))
        # the largest remainder that was not kept is what lies beyond the prefix
        .withColumn("tail", F.coalesce(F.max(F.when(~F.col("_kept"), F.col("rest"))).over(Window.partitionBy("entity")), F.lit(0.0)))
        .filter("_kept")
    )
    return kept.select("entity", "item", "weight", "rest", "total", "tail")


def meetings(items: DataFrame, extra: list[str], block: int = BLOCK) -> DataFrame:
    """Every two entities of an item: (item, x, y, x_*, y_*) once per unordered pair.

    Items of at most ``block`` entities meet under their own key; longer lists, of which there are at most one per ``block``
    rows, meet block by block.
    """
    long = cut_lineage(items.groupBy("item").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks")).where("_blocks > 1"))
    side = lambda df, e, *keys: df.select("item", *keys, F.col("entity").alias(e), *[F.col(c).alias(f"{e}_{c}") for c in extra])
    out = ["item", "x", "y", *[f"{e}_{c}" for e in "xy" for c in extra]]
    if long.isEmpty():
        return side(items, "x").join(side(items, "y").hint("merge"), "item").where("x < y").select(*out)
    short = items.join(long, "item", "left_anti")
    cut = items.join(long, "item").withColumn("_block", F.pmod(F.xxhash64("entity"), F.col("_blocks")).cast("int"))
    left = cut.withColumn("_lo", F.col("_block")).withColumn("_hi", F.explode(F.sequence("_block", F.col("_blocks") - 1)))
    right = cut.withColumn("_hi", F.col("_block")).withColumn("_lo", F.explode(F.sequence(F.lit(0), F.col("_block"))))
    met = side(left, "x", "_lo", "_hi").join(side(right, "y", "_lo", "_hi").hint("merge"), ["item", "_lo", "_hi"]).where("_lo < _hi or x < y")
    return side(short, "x").join(side(short, "y").hint("merge"), "item").where("x < y").select(*out).unionByName(met.select(*out))


# ---------------------------------------------------------------- lists that come along with their entity


def item_lists(items: DataFrame) -> DataFrame:
    """(entity, list): the items of an entity in one row, ``list`` being a struct of arrays: ``keys`` by name and, in the
    same order, one array for every further column, and the ``total`` weight. ``items(entity, item, ...)`` without duplicates."""
    extra = [c for c in items.columns if c not in ("entity", "item")]
    sums = [F.sum("weight").alias("_t")] if "weight" in extra else []
    lists = items.where("item is not null").groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("item", *extra))).alias("_l"), *sums)
    return lists.select("entity", _struct_of_arrays("_l", extra, *[F.col("_t").alias("total") for _ in sums]).alias("list"))


def _struct_of_arrays(rows: str, columns: list[str], *more: Column) -> Column:
    return F.struct(F.col(rows)["item"].alias("keys"), *[F.col(rows)[c].alias(c) for c in columns], *more)


def shared_keys(x: Column, y: Column) -> Column:
    """What two lists have in common, in their order."""
    return F.array_intersect(x["keys"], y["keys"])


def looked_up(held: Column, key: Column, column: str) -> Column:
    return F.get(held[column], F.array_position(held["keys"], key).cast("int") - 1)


def summed(keys: Column, value) -> Column:
    return F.aggregate(keys, F.lit(0.0), lambda total, key: total + value(key))


def overlap(x: Column, y: Column, keys: Column | None = None) -> Column:
    """The sum of the smaller weights of what two lists share."""
    return summed(shared_keys(x, y) if keys is None else keys, lambda k: F.least(looked_up(x, k, "weight"), looked_up(y, k, "weight")))


def computed(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with a column that is computed once per row: filters on it do not repeat the work below it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_shared(pairs: DataFrame) -> DataFrame:
    """Pairs with lists on both sides, and the keys these share as ``shared``, found once per pair."""
    return pairs if "shared" in pairs.columns else computed(pairs, shared_keys(F.col("left"), F.col("right")), "shared")


def in_order(met: DataFrame, column: str) -> list[Column]:
    """a < b and what each of them brought along as ``column``, as left and right."""
    swapped = F.col("x") > F.col("y")
    pick = lambda e, f: F.when(swapped, F.col(f"{f}_{column}")).otherwise(F.col(f"{e}_{column}"))
    return [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), pick("x", "y").alias("left"), pick("y", "x").alias("right")]


def with_lists(pairs: DataFrame, items: DataFrame | None = None, lists: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """Pairs with the lists of both sides as ``left`` and ``right``; pairs that have them already stay as they are."""
    if "left" in pairs.columns:
        return pairs
    lists = item_lists(items) if lists is None else lists
    side = lambda e, name: lists.select(F.col("entity").alias(e), F.col("list").alias(name))
    return pairs.select("a", "b").join(side("a", "left").hint("merge"), "a", how).join(side("b", "right").hint("merge"), "b", how)


def sharing_pairs(
    items: DataFrame, min_similarity: float | None = None, min_overlap: float | None = None, block: int = BLOCK,
    carry: DataFrame | None = None, lists: bool = False,
) -> DataFrame:
    """Distinct pairs a < b that have an item in common; ``items(entity, item)`` without duplicates.

    Without a bound and with ``lists`` every row of ``items`` brings its entity's list along (or its row of
    ``carry(entity, list)``), and a pair is kept at the first item it shares: (a, b, left, right), so that no pair is
    shuffled, neither here nor where its score is computed. That is for entities of few items: a list of n items travels
    n times.

    With a bound the items come from :func:`prefix_items` and a pair is kept only if it can still reach it. The needed
    overlap is ``min_overlap``, or t / (1 + t) of both totals for a Jaccard of t. A pair's overlap is at most (1) the
    smaller remainder at its first shared item and (2) what it shares inside both prefixes plus the larger tail, because
    from the first item outside one prefix on, all shared items lie outside that same prefix.
    """
    bounded = min_similarity is not None or min_overlap is not None
    pair = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    if not bounded and carry is None and not lists:
        return meetings(items, [], block).select(*pair).distinct()
    if not bounded:
        lists = item_lists(items)
        if carry is not None:
            lists = lists.join(carry.select("entity", F.col("list").alias("carried")).hint("merge"), "entity")
        cols = ["list"] if carry is None else ["list", "carried"]
        lists = cut_lineage(lists)
        met = meetings(lists.select("entity", F.explode("list.keys").alias("item"), *cols), cols, block)
        met = computed(met, F.array_intersect("x_list.keys", "y_list.keys"), "shared").where(F.get("shared", F.lit(0)) == F.col("item"))
        return met.select(*in_order(met, cols[-1]), *(["shared"] if carry is None else []))
    met = meetings(items, ["weight", "rest", "total", "tail"], block)
    if min_similarity is not None:
        needed = (F.col("x_total") + F.col("y_total")) * (min_similarity / (1.0 + min_similarity))
    else:
        needed = F.lit(float(min_overlap))
    reach = met.select(
        *pair, F.least("x_weight", "y_weight").alias("_w"), (F.least("x_rest", "y_rest") - needed).alias("_first"),
        (needed - F.greatest("x_tail", "y_tail")).alias("_inside"),
    )
    possible = reach.groupBy("a", "b").agg(F.sum("_w").alias("_w"), F.max("_first").alias("_first"), F.max("_inside").alias("_inside"))
    return possible.filter((F.col("_first") >= -EPSILON) & (F.col("_w") >= F.col("_inside") - EPSILON)).select("a", "b")


@dataclass(frozen=True)
class Bound:
    """What the overlap of a pair must reach: a Jaccard similarity, or a weight when ``absolute``.

    Pairs of a ``selective`` kind are formed with the list of that kind alone, and the other lists are joined to the few
    that reach the bound.
    """

    at_least: float
    absolute: bool = False
    selective: bool = False

    def needed(self, x: Column, y: Column) -> Column:
        total = F.coalesce(x["total"], F.lit(0.0)) + F.coalesce(y["total"], F.lit(0.0))
        return F.lit(float(self.at_least)) if self.absolute else total * (self.at_least / (1.0 + self.at_least))

    def reached(self, x: Column, y: Column) -> Column:
        return F.coalesce((F.size(shared_keys(x, y)) > 0) & (overlap(x, y) >= self.needed(x, y) - EPSILON), F.lit(False))


def tagged_lists(items: DataFrame, kinds, shared_only: bool = False, numbered: tuple[str, ...] = ()) -> DataFrame:
    """(entity, list): ``list`` has a struct of arrays for every kind, rarest items first: ``keys``, ``freq`` (entities that
    have the item), ``rest`` (weight from here on), one array per further column, and the ``total`` weight.

    ``items(entity, kind, item, weight, ...)`` without duplicates; with ``shared_only`` those of a single entity are left out.
    The keys of ``numbered`` kinds are numbers, in the same order, that stand for their items.
    """
    extra = [c for c in items.columns if c not in ("entity", "kind", "item")]
    freq = items.groupBy("kind", "item").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1" if shared_only else "true")
    if numbered:
        freq = cut_lineage(ordinal_within(freq, [], ["freq", "kind", "item"], "code"))
        freq = freq.withColumn("code", F.col("code").cast("int" if freq.count() < 2**31 else "long"))
    back = Window.partitionBy("entity", "kind").orderBy(F.desc("freq"), F.desc("item")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # laid out by entity once, for the running sums and for the lists
    sized = items.join(freq.hint("merge"), ["kind", "item"]).repartition("entity").withColumn("rest", F.sum("weight").over(back))
    of = lambda k, c: F.when(F.col("kind") == k, c)
    lists = sized.groupBy("entity").agg(
        *[F.array_sort(F.collect_list(of(k, F.struct("freq", F.col("code" if k in numbered else "item").alias("item"), "rest", *extra)))).alias(f"l_{k}") for k in kinds],
        *[F.coalesce(F.sum(of(k, F.col("weight"))), F.lit(0.0)).alias(f"t_{k}") for k in kinds])
    return lists.select("entity", F.struct(*[
        _struct_of_arrays(f"l_{k}", ["freq", "rest", *extra], F.col(f"t_{k}").alias("total")).alias(k) for k in kinds]).alias("list"))


def _bounded_meetings(lists: DataFrame, bounds: dict[str, Bound], block: int) -> DataFrame:
    """Pairs that reach one of ``bounds``: once, at the first item they share in the first kind that does.

    ``lists(entity, list, brought)``: the row of an item brings ``brought`` along, which has the kinds of ``bounds``.
    """
    def prefix(k, bound):
        held = F.col("list")[k]
        floor = F.lit(float(bound.at_least)) if bound.absolute else held["total"] * float(bound.at_least)
        rows = F.zip_with(F.zip_with(held["keys"], held["freq"], lambda key, n: F.struct(key.alias("key"), n.alias("freq"))), held["rest"], lambda r, rest: F.struct(
            F.lit(k).alias("kind"), r["key"].cast("string").alias("key"), r["freq"].alias("freq"), rest.alias("rest")))
        return F.filter(rows, lambda r: (r["freq"] > 1) & (r["rest"] >= floor - 2 * EPSILON))

    rows = lists.select("entity", "brought", F.explode(F.concat(*[prefix(k, b) for k, b in bounds.items()])).alias("p")).select(
        "entity", "brought", F.concat_ws("|", "p.kind", "p.key").alias("item"), "p.kind", "p.key", "p.rest")
    met = meetings(rows, ["kind", "key", "rest", "brought"], block)
    able, live, earlier = F.lit(False), F.lit(False), []
    # read from both sides, so that both have the same columns and are shuffled once
    kind, at = F.coalesce("x_kind", "y_kind"), F.coalesce("x_key", "y_key")
    for k, bound in bounds.items():
        x, y = F.col("x_brought")[k], F.col("y_brought")[k]
        able = F.when(kind == k, F.least("x_rest", "y_rest") >= bound.needed(x, y) - EPSILON).otherwise(able)
        here = (F.get(shared_keys(x, y), F.lit(0)).cast("string") == at) & bound.reached(x, y)
        live = F.when(kind == k, reduce(lambda c, e: c & ~e, earlier, here)).otherwise(live)
        earlier.append(bound.reached(x, y))
    # lists are compared only where the weight that is left suffices
    return computed(met.where(able), live, "live").where("live")


def tagged_pairs(
    items: DataFrame, bounds: dict[str, Bound], block: int = BLOCK, lists: DataFrame | None = None, carry: DataFrame | None = None
) -> DataFrame:
    """Distinct pairs a < b that reach the bound of at least one kind: (a, b, left, right), with the lists of both sides.

    ``items(entity, kind, item, weight, ...)``. Only the prefix of an entity's items of a kind is joined, rarest first: the
    weight that is left must reach the bound. Each of these rows brings the entity's ``tagged_lists`` along, so overlaps
    are counted where two rows meet, and only there where the pair's first shared item lies. ``lists`` are the
    ``tagged_lists`` when they are at hand; the columns of ``carry(entity, ...)`` become fields of ``left`` and ``right``.
    """
    lists = cut_lineage(tagged_lists(items, bounds)) if lists is None else lists
    kind = lambda k: F.col("list")[k].dropFields("freq", "rest").alias(k)
    more = [] if carry is None else [c for c in carry.columns if c != "entity"]
    full = lists if carry is None else lists.join(carry.hint("merge"), "entity", "left")
    full = full.select("entity", "list", F.struct(*[kind(k) for k in bounds], *more).alias("brought"))
    wide = {k: b for k, b in bounds.items() if not b.selective}
    out = None
    if wide:
        met = _bounded_meetings(full if carry is None else cut_lineage(full), wide, block)
        out = met.select(*in_order(met, "brought"))
    for k, bound in bounds.items():
        if not bound.selective:
            continue
        met = _bounded_meetings(lists.select("entity", "list", F.struct(kind(k)).alias("brought")), {k: bound}, block)
        found = cut_lineage(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
        found = with_lists(found, lists=full.select("entity", F.col("brought").alias("list")))
        for other, b in wide.items():
            found = found.where(~b.reached(F.col("left")[other], F.col("right")[other]))
        wide[k] = bound
        found = found.select("a", "b", "left", "right")
        out = found if out is None else out.unionByName(found)
    return out


#: Distinct weights up to this many are told to every task, and rows bring places among them.
FEW = 32_000


def _told_weights(items: DataFrame, few: int) -> tuple[DataFrame, Column | None]:
    """``items`` with ``told``, the place of the weight among all weights, and these as an array; the weight itself and None if
    there are more than ``few``."""
    found = [r[0] for r in items.select("weight").where("weight is not null").distinct().limit(few + 1).collect()]
    if not found or len(found) > few:
        return items.withColumn("told", F.col("weight")), None
    found.sort()
    places = items.sparkSession.createDataFrame([(w, i) for i, w in enumerate(found)], "weight double, told smallint")
    told = items.withColumn("weight", F.col("weight").cast("double")).join(F.broadcast(places), "weight", "left")
    return told, F.split(F.lit(",".join(map(repr, map(float, found)))), ",").cast("array<double>")


def numbered_items(items: DataFrame, keys: list[str], first: Column | None = None) -> DataFrame:
    """(*keys, code, freq): the items that more than one row of ``items`` has, numbered rarest first; those of ``first`` (an
    aggregate) lead."""
    freq = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("freq"), (F.lit(True) if first is None else ~first).alias("_late")).where("freq > 1")
    found = cut_lineage(ordinal_within(freq, [], ["_late", "freq", *keys], "code"))
    return found.select(*keys, F.col("code").cast("int" if found.count() < 2**31 else "long").alias("code"), "freq")


def alike(items: DataFrame, bound: "Bound", block: int = BLOCK, names: bool = False, few: int = FEW) -> DataFrame:
    """(a, b, shared, overlap, total): every pair a < b that reaches ``bound``, the numbers (with ``names`` the ids) of the items
    it shares, rarest first, the sum of their smaller weights, and the weight of all items of both.

    ``items(entity, item, weight)`` without duplicates. Items are numbered, so a row brings a short list along: the numbers
    of its entity's shared items and the places of their weights. Only the prefix that can be the first shared item is
    joined, and a pair is kept at the first item it shares. Under an absolute bound items that reach it alone come first:
    their pairs count anyway, and the prefix ends soon after them. Both sides read the same columns, so one shuffle serves both.
    """
    alone = F.max("weight") >= F.lit(float(bound.at_least)) - EPSILON if bound.absolute else None
    told, weights = _told_weights(items.select("entity", "item", "weight"), few)
    coded = told.join(numbered_items(items, ["item"], alone).select("item", "code").hint("merge"), "item", "left").repartition("entity")
    back = Window.partitionBy("entity").orderBy(F.desc_nulls_last("code")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.when(F.col("code").isNotNull(), F.struct("code", "rest", "told", *(["item"] if names else [])))
    lists = coded.withColumn("rest", F.sum("weight").over(back)).groupBy("entity").agg(F.array_sort(F.collect_list(held)).alias("_l"), F.sum("weight").alias("total"))
    row = F.col("_l")
    lists = cut_lineage(lists.where(F.size("_l") > 0).select("entity", row["rest"].alias("rest"), F.struct(
        row["code"].alias("keys"), row["told"].alias("told"), F.col("total"), *([row["item"].alias("items")] if names else [])).alias("list")))
    floor = F.lit(float(bound.at_least)) if bound.absolute else F.col("list.total") * float(bound.at_least)
    rows = lists.select("entity", "list", F.explode(F.arrays_zip(F.col("list.keys").alias("item"), "rest")).alias("p")).select("entity", "list", "p.item", "p.rest")
    met = meetings(rows.where(F.col("rest") >= floor - 2 * EPSILON), ["rest", "list"], block)
    x, y = F.col("x_list"), F.col("y_list")
    needed = bound.needed(x, y) - EPSILON
    met = computed(met.where(F.least("x_rest", "y_rest") >= needed), shared_keys(x, y), "shared").where(F.get("shared", F.lit(0)) == F.col("item"))
    weight = (lambda e, key: looked_up(e, key, "told")) if weights is None else (lambda e, key: F.get(weights, looked_up(e, key, "told").cast("int")))
    met = computed(met, summed(F.col("shared"), lambda key: F.least(weight(x, key), weight(y, key))), "overlap").where(F.col("overlap") >= needed)
    # taken from whichever side has it, for the same reason
    shared = F.transform("shared", lambda key: F.coalesce(looked_up(x, key, "items"), looked_up(y, key, "items"))) if names else F.col("shared")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), shared.alias("shared"), "overlap", (x["total"] + y["total"]).alias("total"))


def shared_items(pairs: DataFrame, items: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The items both sides of each pair have: one row (a, b, item, left_*, right_*) per shared item."""
    cols = keep or [c for c in items.columns if c not in ("entity", "item")]
    left = items.select(F.col("entity").alias("a"), "item", *[F.col(c).alias(f"left_{c}") for c in cols])
    right = items.select(F.col("entity").alias("b"), "item", *[F.col(c).alias(f"right_{c}") for c in cols])
    return pairs.select("a", "b").join(left, "a").join(right, ["b", "item"])


def partners_of(focus: DataFrame, items: DataFrame) -> DataFrame:
    """Every pair that involves a ``focus(entity)`` row, through all items.

    The work is the size of the posting lists of the focus entities only.
    """
    mine = items.join(focus.select("entity").distinct(), "entity", "left_semi")
    return (
        mine.select("item", F.col("entity").alias("x"))
        .join(items.select("item", F.col("entity").alias("y")), "item")
        .filter("x <> y")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )


def block_join(left: DataFrame, right: DataFrame, block: int = BLOCK) -> DataFrame:
    """(item, x, y, ...) for every ``left(item, x, ...)`` and ``right(item, y, ...)`` row of an item.

    The right posting list of an item is cut into blocks of about ``block`` rows by hash and the left rows go to each of
    them, so a list of any length is spread over as many tasks.
    """
    long = cut_lineage(right.groupBy("item").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks")).where("_blocks > 1"))
    if long.isEmpty():
        return left.join(right.hint("merge"), "item")
    short = left.join(right.join(long, "item", "left_anti").hint("merge"), "item")
    spread = left.join(long, "item").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    cut = right.join(long, "item").withColumn("_block", F.pmod(F.xxhash64("y"), F.col("_blocks")).cast("int")).drop("_blocks")
    return short.unionByName(spread.join(cut.hint("merge"), ["item", "_block"]).drop("_block"))


def best_partners(items: DataFrame, k: int, width: int = 2, digits: int = 9, block: int = BLOCK) -> DataFrame:
    """(entity, partner, overlap, n_shared, rank): the ``k`` partners each entity shares most with, so the output is linear.

    ``items(entity, item, weight)`` without duplicates, the weight depending on the item alone; the overlap of a pair is
    the sum of its shared weights, rounded to ``digits``; ties go to the smaller partner.

    Every entity looks its items up rarest first, ``width`` of them in the first round and twice as many in each further
    one. The overlap of its k-th best partner so far is its threshold, which only rises; once all that is left of its
    items weighs less, no partner that was not met can matter and it looks up nothing more. So the posting lists of
    widespread items are read only for entities whose best partners can be decided there.

    Edge cases: items nobody shares are ignored; an entity that shares nothing has no row; an empty table gives none.
    """
    tagged = items.select("entity", F.lit("item").alias("kind"), "item", "weight")
    lists = tagged_lists(tagged, ["item"], shared_only=True).select("entity", F.col("list.item").alias("list"))
    rows = F.zip_with("list.keys", "list.rest", lambda key, rest: F.struct(key.alias("item"), rest.alias("rest")))
    ranked = cut_lineage(
        lists.select("entity", F.col("list").dropFields("freq", "rest", "total").alias("list"), F.posexplode(rows).alias("pos", "p"))
        .select("entity", "list", "p.item", "p.rest", (F.col("pos") + 1).alias("pos")))
    # the lists come along, so what two entities share is counted where they meet
    held = ranked.select("item", F.col("entity").alias("y"), F.col("list").alias("y_list"))
    x, y = F.col("x_list"), F.col("y_list")
    spark, found, at = items.sparkSession, None, 0
    while True:
        probe = ranked.where((F.col("pos") > at) & (F.col("pos") <= at + width))
        if found is not None:
            reached = found.where(F.col("rank") == k).select("entity", F.col("overlap").alias("_least"))
            probe = probe.join(reached, "entity", "left").where(F.col("_least").isNull() | (F.col("rest") >= F.col("_least") - EPSILON))
        probe = cut_lineage(probe.select("item", F.col("entity").alias("x"), F.col("list").alias("x_list")))
        if probe.isEmpty():  # what is left beyond a place only shrinks, so no later place can matter either
            break
        # an entity looks its items up in their order, so it meets a partner first at the first item they share
        met = block_join(probe, held, block).where((F.col("x") != F.col("y")) & (F.get(shared_keys(x, y), F.lit(0)) == F.col("item")))
        both = shared_keys(x, y)
        fresh = computed(
            met.select("x", "y", both.alias("both"), "x_list"),
            F.struct(F.round(summed(F.col("both"), lambda key: looked_up(x, key, "weight")), digits).alias("overlap"), F.size("both").cast("long").alias("n_shared")), "s",
        ).select(F.col("x").alias("entity"), F.col("y").alias("partner"), "s.overlap", "s.n_shared")
        if found is not None:
            fresh = fresh.unionByName(found.drop("rank"))
        found = cut_lineage(top_by(fresh, ["entity"], [F.desc("overlap"), F.asc("partner")], k))
        at, width = at + width, 2 * width
    return found if found is not None else spark.createDataFrame(
        [], f"entity {dict(items.dtypes)['entity']}, partner {dict(items.dtypes)['entity']}, overlap double, n_shared long, rank int")

"""Benchmark decontamination by template windows, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.llm.tables import let, small
from corrobora.session import cut_lineage

#: Private-use characters that stand for a name, a number, a unit, and a point or comma inside a number.
NAME, NUMBER, UNIT, POINT = "\ue001", "\ue002", "\ue003", "\ue004"
#: Unit words that become placeholders next to a number.
UNITS = (
    "percent", "dollars?", "euros?", "pounds?", "cents?", "km", "cm", "mm", "kg", "mg", "ml", "kb", "mb", "gb", "mph", "kph",
    "kilometers?", "meters?", "metres?", "miles?", "feet", "inches", "grams?", "liters?", "litres?", "seconds?", "minutes?", "hours?",
    "days?", "weeks?", "months?", "years?", "degrees?",
)
_BREAK = rf"[^\p{{L}}\p{{N}}{NAME}{NUMBER}{UNIT}{POINT}]+"
_ANY_UNIT = f"(?:{'|'.join(UNITS)})"


def _raw(text: Column) -> Column:
    """The text with every number one token: inner points and commas marked, attached units split off."""
    joined = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=[0-9])[.,](?=[0-9])", POINT)
    return F.regexp_replace(joined, rf"(?i)(?<=[0-9])(?={_ANY_UNIT}(?![\p{{L}}\p{{N}}]))", " ")


def _template(raw: Column) -> Column:
    """Names inside sentences, numbers, and units after numbers become placeholders; one token stays one token."""
    named = F.regexp_replace(raw, r"\p{Lu}(?<=[\p{Ll}\p{N},;] \p{Lu})[\p{L}\p{N}]*", NAME)
    numbered = F.regexp_replace(named, rf"(?<![\p{{L}}\p{{N}}{POINT}])[0-9][0-9{POINT}]*(?![\p{{L}}\p{{N}}{POINT}])", NUMBER)
    united = F.regexp_replace(numbered, rf"(?i)(?<={NUMBER}[ -]){_ANY_UNIT}(?![\p{{L}}\p{{N}}])", UNIT)
    return F.lower(united)


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, _BREAK), lambda t: t != "")


def _codes(tokens: Column) -> Column:
    """The hash of every token: windows of numbers are cut and hashed faster than windows of strings."""
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _masked(code: Column) -> Column:
    return code.isin(*[F.xxhash64(F.lit(m)) for m in (NAME, NUMBER, UNIT)])


def _rich(part: Column, size: int, literals: int) -> Column:
    """Whether a window has enough plain words for its template to tell anything."""
    return F.size(F.filter(part, _masked)) <= size - min(literals, size)


def _key(part: Column, raw: Column, size: int, literals: int) -> Column:
    """The hash a window of ``size`` token codes is looked up by: its template, or, when that has few plain words, its own tokens.

    Templates that are nearly all placeholders fit too much; such windows have to agree word for word.
    """
    return F.when(_rich(part, size, literals), F.xxhash64(part)).otherwise(F.xxhash64(F.lit("="), raw))


def _windows(codes: Column, raw: Column, masked: Column, sizes: list[int], literals: int) -> Column:
    """(size, pos, hash) of every run of each of the sizes, in one array; ``masked`` are the places of the placeholders.

    Only a text in which enough placeholders stand close together has windows to look at one by one.
    """

    def of(size: int) -> Column:
        last = F.size(codes) - size
        starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        part = lambda t, i: F.slice(t, i + 1, F.lit(size))
        row = lambda i, h: F.struct(F.lit(size).alias("size"), i.alias("pos"), h.alias("hash"))
        many = size - min(literals, size) + 1  # placeholders that make a window poor
        dense = F.exists(F.transform(masked, lambda p, k: F.get(masked, k + many - 1) - p < size), lambda near: F.coalesce(near, F.lit(False)))
        return F.when(dense, F.transform(starts, lambda i: row(i, _key(part(codes, i), part(raw, i), size, literals)))).otherwise(
            F.transform(starts, lambda i: row(i, F.xxhash64(part(codes, i)))))

    return F.flatten(F.array(*[of(n) for n in sizes])) if len(sizes) > 1 else of(sizes[0])


def _slots(text: Column) -> Column:
    """(pos, value) of the placeholders of a text."""
    marked = F.zip_with(
        F.transform(_tokens(_template(_raw(text))), lambda t, i: F.struct(i.alias("pos"), t.alias("token"))), _tokens(F.lower(_raw(text))),
        lambda t, v: F.struct(t["pos"].alias("pos"), t["token"].alias("token"), v.alias("value")),
    )
    found = F.filter(marked, lambda x: x["token"].isin(NAME, NUMBER, UNIT))
    return F.transform(found, lambda x: F.struct(x["pos"], x["value"]))


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, window: int = 8, share: float = 0.5, literals: int = 3, run: int = 13
) -> DataFrame:
    """(doc_id, text_hash, item_id, n_windows, n_matched) for every document that holds a benchmark item.

    Both sides become templates: names, numbers and units turn into typed placeholders. All windows of ``window``
    tokens (an item with fewer is one window) are joined by hash. A document holds an item if at least ``share`` of the
    item's windows, or of those with enough plain words, occur in it, or ``run`` consecutive tokens of the item do, on alignments whose slots are consistent:
    equal values of the item always stand for equal values in the document and different for different. So verbatim
    copies and re-parameterised ones are found. Windows with fewer than ``literals`` plain words count only where their
    own tokens agree, so items that are short or mostly figures are found verbatim. The first word of an item is also
    tried as a name, since it is one to a template inside a sentence.

    The texts are read and templated once for all window sizes, and never shuffled. The benchmark's windows are broadcast
    when a count proves them small, else the join shuffles both sides. Edge cases: null and empty texts and items, and items
    without a letter or digit, hold nothing; an item of one word is held by every document with that word; items with equal
    templates are each reported; repeated rows of a document give one row; a null doc_id is a document like others
    (``text_hash`` tells documents with equal ids apart). Other columns are ignored.
    """
    items = (
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
        .select("item_id", _tokens(_template(_raw(F.col("text")))).alias("tokens"), _tokens(F.lower(_raw(F.col("text")))).alias("raw"), _slots(F.col("text")).alias("slots"),
                F.element_at(F.concat(_tokens(_raw(F.col("text"))), F.array(F.lit(""))), 1).rlike(r"^\p{Lu}").alias("named"))
        .withColumn("size", F.least(F.size("tokens"), F.lit(window))).where("size > 0")
    )
    items = cut_lineage(items)
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # at most ``window`` numbers
    as_name = F.concat(F.array(F.xxhash64(F.lit(NAME))), F.slice("part", F.lit(2), F.size("part")))
    parts = (
        items.withColumn("ipos", F.explode(F.sequence(F.lit(0), F.size("tokens") - F.col("size"))))
        .select("item_id", "size", "ipos", "named", _codes(F.slice("tokens", F.col("ipos") + 1, F.col("size"))).alias("part"),
                _codes(F.slice("raw", F.col("ipos") + 1, F.col("size"))).alias("own"))
    )
    parts = parts.unionByName(parts.where("ipos = 0 and named").withColumn("part", as_name))
    hash_of, rich = F.lit(None).cast("long"), F.lit(False)
    for n in sizes:
        hash_of = F.when(F.col("size") == n, _key(F.col("part"), F.col("own"), n, literals)).otherwise(hash_of)
        rich = F.when(F.col("size") == n, _rich(F.col("part"), n, literals)).otherwise(rich)
    index = cut_lineage(parts.select("item_id", "size", "ipos", hash_of.alias("hash"), rich.alias("rich")).distinct())
    counted = index.groupBy("item_id").agg(F.count_distinct("ipos").alias("n_windows"), F.count_distinct(F.when(F.col("rich"), F.col("ipos"))).alias("n_rich"))

    text = F.col("text").cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where("text is not null and text <> ''")
    key = ["doc_id", "text_hash"]
    if not sizes:
        return docs.sparkSession.createDataFrame([], "doc_id long, text_hash long, item_id long, n_windows long, n_matched long")
    tokenised = (
        base.select("doc_id", F.xxhash64("text").alias("text_hash"), _raw(F.col("text")).alias("raw"))
        .select(*key, F.lower("raw").alias("raw"), _template(F.col("raw")).alias("template"))
        .select(*key, _codes(_tokens(F.col("raw"))).alias("raw"), _codes(_tokens(F.col("template"))).alias("codes"))
        .select(*key, "raw", "codes", F.filter(F.transform("codes", lambda t, i: F.when(_masked(t), i)), lambda i: i.isNotNull()).alias("masked"))
    )
    windows = tokenised.select(*key, F.explode(_windows(F.col("codes"), F.col("raw"), F.col("masked"), sizes, literals)).alias("w")).select(*key, "w.*")
    hits = windows.join(small(index), ["size", "hash"]).select(*key, "item_id", "ipos", (F.col("pos") - F.col("ipos")).alias("shift"), "size", "rich")
    aligned = cut_lineage(
        hits.groupBy(*key, "item_id", "shift", "size").agg(
            F.collect_set("ipos").alias("starts"), F.collect_set(F.when(F.col("rich"), F.col("ipos"))).alias("rich_starts"))
    )
    slots = cut_lineage(items.select("item_id", F.explode("slots").alias("slot")).select("item_id", F.col("slot.pos").alias("ipos"), F.col("slot.value").alias("value")))
    if not slots.isEmpty():
        aligned = _consistent(aligned, base, slots, key)
    needed = run - F.col("size") + 1  # consecutive windows that cover a run
    in_a_row = F.exists("starts", lambda i: F.size(F.filter("starts", lambda j: (j >= i) & (j < i + needed))) >= needed)
    matched = (
        aligned.withColumn("in_a_row", (F.col("size") == window) & (needed > 0) & in_a_row)
        .select(*key, "item_id", "in_a_row", "rich_starts", F.explode("starts").alias("ipos"))
        .withColumn("rich_ipos", F.when(F.array_contains("rich_starts", F.col("ipos")), F.col("ipos"))).groupBy(*key, "item_id")
        .agg(F.size(F.collect_set("ipos")).cast("long").alias("n_matched"), F.size(F.collect_set("rich_ipos")).alias("rich_matched"), F.max("in_a_row").alias("in_a_row"))
    )
    # a re-parameterised copy cannot agree in poor windows, so the rich ones also count among themselves
    of_rich = (F.col("n_rich") > 0) & (F.col("rich_matched") >= F.lit(share) * F.col("n_rich"))
    held = (F.col("n_matched") >= F.lit(share) * F.col("n_windows")) | of_rich | F.col("in_a_row")
    return matched.join(small(counted), "item_id").where(held).select(*key, "item_id", "n_windows", "n_matched")


def _consistent(aligned: DataFrame, base: DataFrame, slots: DataFrame, key: list[str]) -> DataFrame:
    """The alignments on which item values and document values of the slots map one to one."""
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])
    wanted = small(cut_lineage(aligned.select(*key).distinct()))
    keyed = base.withColumn("text_hash", F.xxhash64("text"))
    own = keyed.join(wanted, same(keyed, wanted), "left_semi").select(
        *key, F.explode(_slots(F.col("text"))).alias("slot")
    ).select(*key, F.col("slot.pos").alias("pos"), F.col("slot.value").alias("own")).distinct()
    span = aligned.select(*key, "item_id", "shift", F.array_min("starts").alias("lo"), (F.array_max("starts") + F.col("size")).alias("hi"))
    asked = (
        span.join(small(slots), "item_id").where("ipos >= lo and ipos < hi")
        .select(*key, "item_id", "shift", "value", (F.col("ipos") + F.col("shift")).alias("pos"))
    )
    pairs = asked.join(own, same(asked, own) & (asked["pos"] == own["pos"])).select(
        asked["doc_id"], asked["text_hash"], "item_id", "shift", "value", "own"
    ).distinct()
    wrong = (
        pairs.groupBy(*key, "item_id", "shift").agg(F.count(F.lit(1)).alias("n"), F.size(F.collect_set("value")).alias("v"), F.size(F.collect_set("own")).alias("o"))
        .where("n <> v or n <> o")
    )
    on = same(aligned, wrong) & (aligned["item_id"].eqNullSafe(wrong["item_id"])) & (aligned["shift"] == wrong["shift"])
    return aligned.join(wrong, on, "left_anti")


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched): one row per contaminated document and the item it holds."""
    return (
        benchmark_matches(docs, benchmark, **options).groupBy("doc_id", "item_id")
        .agg(F.max("n_windows").alias("n_windows"), F.max("n_matched").alias("n_matched"))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; all columns stay as they are."""
    bad = small(cut_lineage(benchmark_matches(docs, benchmark, **options).select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct()))
    on = docs["doc_id"].cast("long").eqNullSafe(bad["_doc"]) & (F.xxhash64(docs["text"].cast("string")) == bad["_hash"])
    return docs.join(bad, on, "left_anti")

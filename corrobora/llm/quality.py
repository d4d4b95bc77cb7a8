"""Quality rules: fixed document statistics, and robust multivariate outliers per language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corrobora.llm.columns import BLANK, words
from corrobora.llm.tables import let, small
from corrobora.session import cut_lineage

SYMBOLS = r"[^#*$%&|<>]+"
#: Transformed statistics, in thousandths: whole numbers keep sums exact whatever the order of addition.
FEATURES = ("f_length", "f_word", "f_symbol", "f_line", "f_repeat")
SCALE = 1000.0
#: Least standard deviations, same unit. Most texts have no symbols or repeats at all, so their plain spread is zero;
#: the floors say how much of each is still ordinary: a tenth more symbols, a third more repeated lines,
#: half again as many repeated words.
FLOORS = {"f_length": 300.0, "f_word": 100.0, "f_symbol": 100.0, "f_line": 300.0, "f_repeat": 500.0}
PAIRS = tuple((f, g) for i, f in enumerate(FEATURES) for g in FEATURES[: i + 1])
#: Chi-square with one degree of freedom a feature: its median, its 99.9 % point, and the factor by which the covariance
#: of the nearest three quarters of normal rows is too small.
MEDIAN, OUTLIER, CONSISTENT = 4.3515, 20.515, 1.4128
#: Distances are binned on a log scale, so a quantile needs this many counts per group at most.
BINS_PER_E, LAST_BIN = 64, 2000


def _repeat_words(tokens: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text, each word once.

    Sorting (window hash, start) brings equal windows together; starts of repeated ones are sorted again and every
    start adds the words that the previous one did not reach. Texts without repeats stop after a distinct count.
    """
    last = F.size(tokens) - 3
    starts = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(tokens, i + 1, F.lit(3))))

    def covered(marked: Column) -> Column:
        none = F.lit(None).cast(marked_type)
        before = F.concat(F.array(none), F.slice(marked, F.lit(1), F.size(marked) - 1))
        after = F.concat(F.slice(marked, F.lit(2), F.size(marked)), F.array(none))
        left = F.zip_with(marked, before, lambda x, y: F.when(x["h"] == y["h"], x["i"]))
        right = F.zip_with(marked, after, lambda x, y: F.when(x["h"] == y["h"], x["i"]))
        found = F.filter(F.zip_with(left, right, lambda x, y: F.coalesce(x, y)), lambda x: x.isNotNull())
        return let(F.sort_array(found), reached)

    def reached(at: Column) -> Column:
        following = F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.lit(None).cast("int")))
        steps = F.zip_with(at, following, lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    marked_type = "struct<h:bigint,i:int>"

    def counted(h: Column) -> Column:
        marked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(marked, covered))

    return F.when(last < 0, F.lit(0)).otherwise(let(hashes, counted)).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), one row per row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"), text.alias("text"),
    ).withColumn("tokens", words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return base.select(
        "doc_id", "lang", "source", F.size("tokens").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", f"{BLANK}+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("tokens")).alias("n_repeat_words"),
    )


def _features() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    exact = {
        "f_length": F.log1p("n_words"),
        "f_word": F.log1p(F.col("word_chars") / n),
        "f_symbol": F.log1p(F.lit(100.0) * F.col("n_symbols") / n),
        "f_line": F.log1p(F.lit(100.0) * F.col("n_dup_lines") / n),
        "f_repeat": F.log1p(F.lit(100.0) * F.col("n_repeat_words") / n),
    }
    return {k: F.round(v * SCALE) for k, v in exact.items()}


def _moments(rows: DataFrame, group: list[str]) -> DataFrame:
    sums = [F.sum(f).alias(f"s_{f}") for f in FEATURES]
    products = [F.sum(F.col(f) * F.col(g)).alias(f"p_{f}_{g}") for f, g in PAIRS]
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *sums, *products)


def _centres(moments: DataFrame) -> DataFrame:
    """Mean and consistency-corrected covariance of every group."""
    means = [(F.col(f"s_{f}") / F.col("n")).alias(f"m_{f}") for f in FEATURES]
    covs = [
        ((F.col(f"p_{f}_{g}") / F.col("n") - F.col(f"s_{f}") / F.col("n") * (F.col(f"s_{g}") / F.col("n"))) * F.lit(CONSISTENT)).alias(f"c_{f}_{g}")
        for f, g in PAIRS
    ]
    return moments.select("_group", *means, *covs)


def _factors(centres: DataFrame) -> DataFrame:
    """Mean and Cholesky factor of the covariance, column by column; no standard deviation is below its floor."""
    out = centres
    for i, f in enumerate(FEATURES):
        for j, g in enumerate(FEATURES[: i + 1]):
            cov = F.col(f"c_{f}_{g}")
            for k in FEATURES[:j]:
                cov = cov - F.col(f"l_{f}_{k}") * F.col(f"l_{g}_{k}")
            value = F.sqrt(F.greatest(cov, F.lit(FLOORS[f] ** 2))) if i == j else cov / F.col(f"l_{g}_{g}")
            out = out.withColumn(f"l_{f}_{g}", value)
    return out.select("_group", *[c for c in out.columns if c.startswith(("m_", "l_"))])


def _shrunk(groups: DataFrame, centres: DataFrame, like: float) -> DataFrame:
    """The centres of every group of ``groups``, drawn to those of its language and, through them, to those of all rows.

    ``n / (n + like)`` is the weight of a group's own centre, so a row more or less never switches the estimate.
    """
    own, lang = F.col("_n1") / (F.col("_n1") + F.lit(like)), F.col("_n2") / (F.col("_n2") + F.lit(like))
    levels = [("_group", own), ("_wider", (1 - own) * lang), ("_all", (1 - own) * (1 - lang))]
    parts = groups.select("_group", F.explode(F.array(*[
        F.struct(F.lit(i).alias("level"), F.col(c).alias("of"), w.alias("weight")) for i, (c, w) in enumerate(levels)
    ])).alias("_part")).select(F.col("_group").alias("_own"), "_part.*")
    values = [c for c in centres.columns if c != "_group"]
    met = parts.join(small(centres), parts["of"] == centres["_group"])
    at = lambda c, i: F.max(F.when(F.col("level") == i, F.col("weight") * F.col(c)))  # noqa: E731  added in one order
    return met.groupBy("_own").agg(*[(at(c, 0) + at(c, 1) + at(c, 2)).alias(c) for c in values]).withColumnRenamed("_own", "_group")


def _distance() -> Column:
    """The squared Mahalanobis distance by forward substitution through the Cholesky factor."""
    solved: list[Column] = []
    for i, f in enumerate(FEATURES):
        rest = F.col(f) - F.col(f"m_{f}")
        for j, g in enumerate(FEATURES[:i]):
            rest = rest - F.col(f"l_{f}_{g}") * solved[j]
        solved.append(rest / F.col(f"l_{f}_{f}"))
    total = solved[0] * solved[0]
    for y in solved[1:]:
        total = total + y * y
    return total


def _bin(distance: Column) -> Column:
    return F.least(F.lit(LAST_BIN), F.greatest(F.lit(0), F.ceil(F.log(F.greatest(distance, F.lit(1e-6))) * BINS_PER_E) + 900)).cast("int")


def _quantile_bins(binned: DataFrame, share: float) -> DataFrame:
    """Per group the first bin up to which at least ``share`` of the rows lie: counts of bounded length, no sorting of rows."""
    counts = binned.groupBy("_group", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("_group").orderBy("_bin")
    ran = counts.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(Window.partitionBy("_group")))
    return ran.where(F.col("_upto") >= F.lit(share) * F.col("_all")).groupBy("_group").agg(F.min("_bin").alias("_cut"))


def robust_distances(rows: DataFrame, share: float = 0.75, steps: int = 4, like: float = 50.0) -> DataFrame:
    """Adds ``distance`` to ``rows`` (lang, source and the features): squared Mahalanobis distances under the
    minimum-covariance-determinant estimate of each group, in units of the chi-square median.

    Groups are language and source. Each has an estimate of its own, as has each language and the whole table; a group
    of n rows counts n / (n + ``like``) against its language, and a language likewise against the table, so group sizes
    switch nothing. Estimates start from coordinate-wise medians and spreads; every concentration step keeps the
    ``share`` of rows nearest to the current estimate and takes mean and covariance anew, which lowers the determinant.
    Quantiles come from counts over distance bins, so they are exact to 1.6 % and no group is sorted in one task.
    """
    own = F.count(F.lit(1))
    by_source = rows.groupBy("lang", "source").agg(own.alias("_n1"))
    by_lang = rows.groupBy("lang").agg(own.alias("_n2"))
    key = lambda *parts: F.xxhash64(*[x for p in parts for x in (p.isNull(), p)], F.lit(len(parts)))
    groups = cut_lineage(by_source.join(by_lang, by_source["lang"].eqNullSafe(by_lang["lang"])).select(
        by_source["lang"].alias("_lang"), by_source["source"].alias("_source"), "_n1", "_n2",
        key(by_source["lang"], by_source["source"]).alias("_group"), key(by_source["lang"]).alias("_wider"),
        F.lit(0).cast("long").alias("_all"),
    ))
    on = rows["lang"].eqNullSafe(F.col("_lang")) & rows["source"].eqNullSafe(F.col("_source"))
    judged = cut_lineage(rows.join(small(groups.drop("_n1", "_n2")), on).drop("_lang", "_source"))
    data = cut_lineage(judged.select(F.explode(F.array("_group", "_wider", "_all")).alias("_group"), *FEATURES))

    centre = None
    for f in FEATURES:  # medians and spreads per coordinate, from counts of the whole-number features
        at = data.select("_group", F.col(f).cast("int").alias("_bin"))
        median = _quantile_bins(at, 0.5).withColumnRenamed("_cut", f"m_{f}")
        off = at.join(small(median), "_group").select("_group", F.abs(F.col("_bin") - F.col(f"m_{f}")).alias("_bin"))
        spread = _quantile_bins(off, 0.5).select("_group", F.greatest(F.col("_cut") * 1.4826, F.lit(FLOORS[f])).alias(f"l_{f}_{f}"))
        both = median.join(spread, "_group")
        centre = both if centre is None else centre.join(both, "_group")
    for i, f in enumerate(FEATURES):
        for g in FEATURES[:i]:
            centre = centre.withColumn(f"l_{f}_{g}", F.lit(0.0))
    estimate = cut_lineage(centre)
    for step in range(steps):
        binned = data.join(small(estimate), "_group").withColumn("_bin", _bin(_distance())).select("_group", *FEATURES, "_bin")
        cuts = cut_lineage(_quantile_bins(binned, share))
        near = binned.join(small(cuts), "_group").where("_bin <= _cut")
        centres = cut_lineage(_centres(_moments(near, ["_group"])))
        if step == steps - 1:
            centres = _shrunk(groups, centres, like)
        estimate = cut_lineage(_factors(centres))
    return (
        judged.drop("_wider", "_all").join(small(estimate), "_group")
        .withColumn("distance", _distance() / F.lit(MEDIAN))
    )


def quality(docs: DataFrame, cutoff: float = OUTLIER / MEDIAN, **options) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance) per row of ``docs``.

    ``base_failed``: under 50 words, or more than half of the words in repeated 3-word windows. Of the others, those
    whose robust distance exceeds ``cutoff`` are not kept; the default is the 99.9 % point of chi-square with one degree
    of freedom a feature, so it does not depend on the table. Groups are estimated on the rows that pass the base rules;
    failed rows have no distance.

    Edge cases: null text counts as empty and fails; null language or source is a group of its own; repeated rows are
    rows; statistics without spread get a floor; empty input gives no rows. Other columns are ignored.
    """
    found = cut_lineage(statistics(docs).withColumns(
        {"base_failed": (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))}
    ))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    judged = robust_distances(found.where("not base_failed").withColumns(_features()), **options)
    passed = judged.select(*columns, (F.col("distance") <= F.lit(cutoff)).alias("kept"), "distance")
    failed = found.where("base_failed").select(*columns, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    return passed.unionByName(failed)

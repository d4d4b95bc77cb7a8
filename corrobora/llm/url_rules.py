"""URL filters: given host and path rules, and association rules mined from labelled URLs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.llm.columns import lower_ascii
from corrobora.llm.tables import small
from corrobora.session import cut_lineage

#: (rule, verdict): host and path in one string; a rule fits its host and all subdomains.
RULES = (
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"),
)
LABEL = "label="


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest given rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # later, longer rules win
        at = text.index("/")
        fits = ((host == text[:at]) | F.endswith(host, F.lit("." + text[:at]))) & F.startswith(path, F.lit(text[at:]))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, domain suffixes, path segments, their extensions, query keys. Numbers are one token each way."""
    scheme = F.lower(F.regexp_extract(url, r"\A([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(4))),
        lambda k: F.concat(F.lit("host="), F.array_join(F.slice(labels, F.size(labels) - k + 1, k), ".")),
    )
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    shaped = F.transform(segments, lambda s: F.concat(F.lit("path="), F.regexp_replace(F.lower(s), "[0-9]+", "0")))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda q: q != ""), lambda q: F.concat(F.lit("query="), F.substring_index(F.lower(q), "=", 1)))
    every = F.concat(F.array(F.concat(F.lit("scheme="), scheme)), suffixes, shaped, keys)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(every))


def mine_rules(labelled: DataFrame, support: float = 0.005, confidence: float = 0.9, longest: int = 4) -> DataFrame:
    """Association rules (antecedent, verdict, confidence, support) from ``labelled(tokens, verdict)`` by FP-growth.

    Tokens below ``support`` and those of nearly all URLs are left out first; they can decide nothing and would only multiply
    itemsets. A rule needs ``confidence`` and at most ``longest`` tokens. It is pruned when a rule with a part of its
    tokens gives the same verdict at no lower confidence. The number of rules is bounded by the support, not by the data.
    """
    total = labelled.count()
    if not total:
        return labelled.sparkSession.createDataFrame([], "antecedent array<string>, verdict string, confidence double, support double")
    usual = (
        labelled.select(F.explode("tokens").alias("token")).groupBy("token").count()
        .where((F.col("count") >= support * total) & (F.col("count") <= 0.98 * total)).select("token")
    )
    keyed = labelled.withColumn("_row", F.monotonically_increasing_id())
    keyed = cut_lineage(keyed)
    items = (
        keyed.select("_row", F.explode("tokens").alias("token")).join(small(cut_lineage(usual)), "token").groupBy("_row")
        .agg(F.collect_set("token").alias("tokens"))
    )
    baskets = cut_lineage(
        keyed.select("_row", "verdict").join(items, "_row", "left")
        .select(F.concat(F.coalesce("tokens", F.array().cast("array<string>")), F.array(F.concat(F.lit(LABEL), "verdict"))).alias("items"))
    )
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    found = model.associationRules.where(F.startswith(F.col("consequent")[0], F.lit(LABEL)) & (F.size("antecedent") <= longest))
    rules = cut_lineage(found.select(
        F.array_sort("antecedent").alias("antecedent"), F.substring_index(F.col("consequent")[0], "=", -1).alias("verdict"), "confidence", "support"
    ))
    wide, narrow = rules.alias("w"), rules.alias("n")
    spoiled = (
        narrow.select("*", F.explode("antecedent").alias("_t")).alias("n").join(
            wide.select("*", F.element_at("antecedent", 1).alias("_t")).alias("w"),
            (F.col("n._t") == F.col("w._t")) & (F.col("n.verdict") == F.col("w.verdict")) & (F.size("w.antecedent") < F.size("n.antecedent"))
            & (F.col("w.confidence") >= F.col("n.confidence")) & (F.size(F.array_except("w.antecedent", "n.antecedent")) == 0),
        ).select(F.col("n.antecedent").alias("antecedent"), F.col("n.verdict").alias("verdict")).distinct()
    )
    return cut_lineage(rules.join(spoiled, ["antecedent", "verdict"], "left_anti"))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined) for the ``urls(url, tokens)`` that satisfy a rule; the surest decides.

    The inverted index lists every rule under its rarest token, the one in the fewest URLs; a URL looks its tokens up
    and keeps the rules whose other tokens it has too. Ties go to higher confidence, then support, then more tokens,
    then the rule's text.
    """
    uses = urls.select(F.explode("tokens").alias("token"))
    terms = rules.select(F.explode("antecedent").alias("token")).distinct()
    seen = uses.join(small(cut_lineage(terms)), "token").groupBy("token").count()
    keyed = rules.withColumn("_rule", F.array_join("antecedent", "\n"))
    rarest = (
        keyed.select("_rule", "verdict", F.explode("antecedent").alias("token")).join(seen, "token", "left")
        .groupBy("_rule", "verdict").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).alias("r"))
    )
    index = small(cut_lineage(keyed.join(rarest, ["_rule", "verdict"]).select(F.col("r.token").alias("token"), "antecedent", "verdict", "confidence", "support", "_rule")))
    hit = (
        urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
        .where(F.size(F.array_except("antecedent", "tokens")) == 0)
    )
    best = F.max(F.struct("confidence", "support", F.size("antecedent").alias("n"), "_rule", "verdict"))
    return hit.groupBy("url").agg(best.alias("b")).select("url", F.col("b.verdict").alias("mined"))


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, default: str = "allow", support: float = 0.005, confidence: float = 0.9
) -> DataFrame:
    """(page_id, host, path, rule, verdict, by) for every row of ``pages(page_id, url)``.

    A given rule decides the URLs it fits. Those URLs are also the labels from which association rules are mined; they
    judge the URLs that no given rule fits. ``by`` says who decided: rule, mined or default.

    Everything depends on the URL alone, so distinct URLs are judged once. Edge cases: null URLs and such without
    ``://`` have empty host and path and get the default; repeated rows are rows; no labels or no rules leave the
    default; other columns are ignored.
    """
    url = F.col("url").cast("string")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"))
    distinct = base.where("url is not null").select("url").distinct().withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = given_rule(F.col("host"), F.col("path"), rules)
    known = cut_lineage(distinct.select("url", url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"), rule.alias("rule"), verdict.alias("verdict")))
    mined = mine_rules(known.where("verdict is not null").select("tokens", "verdict"), support, confidence)
    open_urls = known.where("verdict is null").select("url", "tokens")
    judged = match_rules(open_urls, mined)
    rule, verdict = given_rule(F.col("host"), F.col("path"), rules)
    return base.join(judged, "url", "left").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("mined"), F.lit(default)).alias("verdict"),
        F.when(rule.isNotNull(), "rule").when(F.col("mined").isNotNull(), "mined").otherwise("default").alias("by"),
    )

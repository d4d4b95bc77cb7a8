"""Pairs found on rows that bring numbers along: equal to brute force, and shuffled once for both sides."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from corrobora.operators import pairs as P
from corrobora.operators import similarity as S


def sets_of(seed, own_weights):
    rng = random.Random(seed)
    fixed = {f"i{i}": rng.choice([0.25, 0.5, 1.0, 2.0]) for i in range(30)}
    sets = {f"e{e:02}": {i: rng.choice([0.5, 0.8, 1.0]) if own_weights else fixed[i] for i in rng.sample(sorted(fixed), rng.randrange(1, 7))} for e in range(60)}
    for e in sorted(sets)[::2]:
        sets[e]["hub"] = 1.5
    sets["lone"] = {"nobody": 1.0}
    return sets


@pytest.mark.parametrize(("bound", "few", "block", "own"), [(P.Bound(0.3), 100, 1000, True), (P.Bound(0.2), 0, 5, True), (P.Bound(1.3, absolute=True), 100, 6, False)])
def test_alike_equals_brute_force(spark, bound, few, block, own):
    sets = sets_of(3, own)
    items = spark.createDataFrame([(e, i, w) for e, held in sets.items() for i, w in held.items()], "entity string, item string, weight double")
    got = P.alike(items, bound, block, names=True, few=few).collect()
    want = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        low, total = sum(min(x[i], y[i]) for i in x.keys() & y.keys()), sum(x.values()) + sum(y.values())
        if x.keys() & y.keys() and low >= (1.3 if bound.absolute else bound.at_least * (total - low)) - 1e-9:
            want[a, b] = sorted(x.keys() & y.keys()), round(low, 9), round(total, 9)
    assert len(got) == len(want) > 5
    assert {(r.a, r.b): (sorted(r.shared), round(r.overlap, 9), round(r.total, 9)) for r in got} == want


def test_both_sides_of_a_meeting_read_one_shuffle(spark):
    items = spark.range(400).selectExpr("concat('e', id % 97) AS entity", "concat('i', id % 41) AS item", "cast(id % 3 + 1 AS double) AS weight").dropDuplicates(["entity", "item"])
    found = P.alike(items, P.Bound(0.1))
    assert found.count() > 0
    found.collect()
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()


def test_scored_rows_bring_numbers_of_terms_and_no_names(spark):
    features = spark.range(120).selectExpr("concat('d', id % 30) AS entity", "element_at(array('mechanism', 'gene', 'phenotype'), cast(id % 3 + 1 AS int)) AS kind",
                                           "concat('i', id % 7) AS item", "0.5D AS support").dropDuplicates(["entity", "kind", "item"])
    closed = features.where("kind = 'phenotype'").select("entity", F.col("item").alias("term"))
    ic = closed.groupBy("term").agg((6.0 - F.log2(F.count(F.lit(1)))).alias("ic"))
    items = S.pair_items(features, S.weighted_terms(closed, ic))
    lists = S.connection_lists(items)
    term = lists.schema["list"].dataType["term"].dataType
    assert term["keys"].dataType.elementType.simpleString() == "int" and "support" not in term.names
    told = S.told_lists(features, closed, ic, spark.createDataFrame([("i1", "one")], "id string, name string"))
    found = S.all_connections(features, S.weighted_terms(closed, ic), told=told)
    assert found.count() > 0
    pairs = S.connection_candidates(items, lists=lists, carry=told.select("entity", F.col("told_terms.keys").alias("told_keys")))
    pairs.collect()
    assert "ReusedExchange" in pairs._jdf.queryExecution().executedPlan().toString()

"""Pairs that bring their lists along: equal to brute force, and no row per pair or shared item is shuffled."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from corrobora.operators import pairs as P
from corrobora.operators import resolve as N
from corrobora.operators import similarity as S


def kinds_of(seed, entities=40):
    rnd = random.Random(seed)
    rows = {}
    for e in range(entities):
        for kind, n in (("mechanism", 9), ("gene", 12), ("phenotype", 30)):
            for _ in range(rnd.randrange(0, 4)):
                rows[f"d{e:02}", kind, f"{kind[0]}{rnd.randrange(n)}"] = rnd.choice([0.5, 0.8, 1.0])
    return rows


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("seed", "block"), [(1, 1000), (2, 4)])
def test_pairs_of_all_kinds_come_once_with_what_they_share(spark, seed, block):
    rows = kinds_of(seed)
    items = spark.createDataFrame([(*k, w) for k, w in rows.items()], "entity string, kind string, item string, weight double")
    bounds = {"mechanism": P.Bound(0.3), "gene": P.Bound(0.5), "phenotype": P.Bound(1.3, absolute=True, selective=True)}
    got = P.tagged_pairs(items, bounds, block).select("a", "b", F.array_sort(P.shared_keys(F.col("left.gene"), F.col("right.gene"))).alias("g")).collect()
    held = lambda e, kind: {i: w for (x, k, i), w in rows.items() if x == e and k == kind}
    want = {}
    for a, b in itertools.combinations(sorted({k[0] for k in rows}), 2):
        reached = False
        for kind, bound in bounds.items():
            x, y = held(a, kind), held(b, kind)
            low = sum(min(x[i], y[i]) for i in x.keys() & y.keys())
            union = sum(x.values()) + sum(y.values()) - low
            reached |= bool(x.keys() & y.keys()) and (low >= 1.3 - 1e-9 if bound.absolute else low >= bound.at_least * union - 1e-9)
        if reached:
            want[a, b] = sorted(held(a, "gene").keys() & held(b, "gene").keys())
    assert len(got) == len(want) and {(r.a, r.b): r.g for r in got} == want


def test_sharing_pairs_are_not_aggregated_and_told_alike(spark):
    rows = [(e, i, w) for (e, k, i), w in kinds_of(3).items() if k == "phenotype"]
    weight = {i: 1.0 / n for n, i in enumerate(sorted({r[1] for r in rows}), 1)}
    items = spark.createDataFrame([(e, i, weight[i]) for e, i, _ in rows], "entity string, item string, weight double")
    found = P.sharing_pairs(items, block=3, lists=True)
    told = S.shared_feature_weight(found, items)
    assert "Aggregate" not in plan_of(told)
    plain = S.shared_feature_weight(found.select("a", "b"), items)
    key = lambda df: sorted((r.a, r.b, round(r.weight, 9), r.n_shared) for r in df.collect())
    assert key(told) == key(plain) and len(key(told)) > 50


def test_labels_of_connections_come_along_and_equal_joined_ones(spark):
    rows = kinds_of(4)
    features = spark.createDataFrame([(*k, w) for k, w in rows.items()], "entity string, kind string, item string, support double")
    closed = features.where("kind = 'phenotype'").select("entity", F.col("item").alias("term")).unionByName(
        features.select("entity", F.lit("root").alias("term")).distinct())
    ic = closed.groupBy("term").agg((5.0 - F.log2(F.count(F.lit(1)))).alias("ic")).withColumn("ic", F.round("ic", 9))
    terms = S.weighted_terms(closed, ic)
    labels = spark.createDataFrame([(f"p{i}", f"name {i % 7}") for i in range(20)] + [("p1", "again"), ("p2", None)], "id string, name string")
    plain = S.all_connections(features, terms).drop("left", "right")
    joined = S.annotate_connections(plain, labels, S.top_shared_terms(plain, closed, ic))
    told = S.annotate_connections(S.all_connections(features, terms, told=S.told_lists(features, closed, ic, labels)))
    key = lambda df: sorted((r.a, r.b, round(r.score, 9), r.shared_phenotype_labels, r.informative_labels, r.why_connected) for r in df.collect())
    assert key(told) == key(joined) and len(key(told)) > 20
    # a row of the plan for each pair exists only where two entities meet
    assert plan_of(told).count("Join") < plan_of(joined).count("Join")


def test_meetings_and_suggestions_never_broadcast_a_posting_list(spark):
    items = spark.createDataFrame([("e1", "i"), ("e2", "i")], "entity string, item string")
    vocabulary = spark.createDataFrame([("Disease", "M1", "Rare thing", "rare thing")], "kind string, id string, label string, key string")
    asked = spark.createDataFrame([("Disease", "rare thin")], "kind string, mention string")
    for df in (P.meetings(items, []), N.suggest_candidates(asked, vocabulary)):
        assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()
        assert df.count() == 1


def test_long_lists_of_few_entities_do_not_travel(spark):
    items = spark.range(40_000).selectExpr("concat('N', id % 4) AS entity", "cast(id div 8 AS string) AS item", "cast(1 AS double) AS weight").distinct()
    found = S.jaccard_of_pairs(P.sharing_pairs(items), items)
    assert "array_intersect" not in plan_of(found)
    assert {(r.a, r.b): (r.n_shared, r.similarity) for r in found.collect()} == {(f"N{i}", f"N{j}"): (5_000, 1.0) for i in range(4) for j in range(i + 1, 4)}

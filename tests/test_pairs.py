import random

import pytest
from pyspark.sql import functions as F

from corrobora.operators import pairs as P
from corrobora.operators import similarity as S
from corrobora.session import first_by, ordinal_within


def weighted_sets(seed, n=60, vocabulary=40):
    """Skewed sets: item 0 is held by about a third of all entities."""
    rnd = random.Random(seed)
    sets = {}
    for e in range(n):
        items = {f"i{rnd.randrange(1, vocabulary)}": round(rnd.uniform(0.2, 1.0), 3) for _ in range(rnd.randrange(1, 7))}
        if rnd.random() < 0.34:
            items["i0"] = 0.5
        sets[f"e{e:03d}"] = items
    return sets


def frame(spark, sets):
    rows = [(e, i, w) for e, items in sets.items() for i, w in items.items()]
    return spark.createDataFrame(rows, "entity string, item string, weight double")


def brute_jaccard(sets, t):
    out = {}
    names = sorted(sets)
    for x, a in enumerate(names):
        for b in names[x + 1:]:
            A, B = sets[a], sets[b]
            low = sum(min(A[i], B[i]) for i in A.keys() & B.keys())
            high = sum(max(A.get(i, 0), B.get(i, 0)) for i in A.keys() | B.keys())
            if low / high >= t:
                out[a, b] = low / high
    return out


@pytest.mark.parametrize("seed,t", [(1, 0.2), (2, 0.35), (3, 0.6)])
def test_similar_pairs_equal_brute_force(spark, seed, t):
    sets = weighted_sets(seed)
    got = {(r.a, r.b): r.similarity for r in S.similar_pairs(frame(spark, sets), t).collect()}
    want = brute_jaccard(sets, t)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_blocks_lose_no_pair(spark, block):
    sets = weighted_sets(5)
    items = frame(spark, sets)
    want = {(a, b) for a in sets for b in sets if a < b and set(sets[a]) & set(sets[b])}
    assert {(r.a, r.b) for r in P.sharing_pairs(items, block=block).collect()} == want
    met = P.meetings(items, [], block).groupBy("item", F.least("x", "y"), F.greatest("x", "y")).count()
    assert met.where("count > 1").isEmpty()
    near = {(r.a, r.b) for r in P.sharing_pairs(P.prefix_items(items, 0.25), 0.25, block=block).collect()}
    assert set(brute_jaccard(sets, 0.25)) <= near


def test_an_item_of_all_entities_still_gives_every_pair(spark):
    items = spark.range(3_000).select(F.concat(F.lit("e"), "id").alias("entity"), F.lit("all").alias("item"), F.lit(1.0).alias("weight"))
    assert P.sharing_pairs(items).count() == 3_000 * 2_999 // 2


def test_projection_equals_brute_force(spark):
    rnd = random.Random(9)
    rows = [(f"d{e}", kind, f"{kind[0]}{rnd.randrange(n)}", 1.0) for e in range(40) for kind, n in (("mechanism", 12), ("phenotype", 25), ("phenotype", 25))]
    features = spark.createDataFrame(sorted(set(rows)), "entity string, kind string, item string, support double")
    by = {}
    for e, k, i, _ in set(rows):
        by.setdefault(e, {}).setdefault(k, set()).add(i)
    freq = {}
    for e in by:
        for p in by[e].get("phenotype", ()):
            freq[p] = freq.get(p, 0) + 1
    want = {}
    for a in by:
        for b in by:
            if a < b:
                w = 2 * len(by[a].get("mechanism", set()) & by[b].get("mechanism", set())) + sum(
                    1 / freq[p] for p in by[a].get("phenotype", set()) & by[b].get("phenotype", set()))
                if w >= 1 - 1e-9:
                    want[a, b] = w
    got = {(r.a, r.b): r.weight for r in S.entity_projection(features).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_ordinal_within_hot_key(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 200)).alias("k"), "id")
    rows = ordinal_within(df.repartition(7), ["k"], ["id"], "n").collect()
    assert len(rows) == 2000
    seen = {}
    for r in sorted(rows, key=lambda r: r.id):
        assert r.n == seen.get(r.k, 0)
        seen[r.k] = r.n + 1


def test_first_by_limits_groups_before_the_shuffle(spark, capsys):
    first_by(spark.range(10).withColumn("k", F.col("id") % 2), ["k"], [F.asc("id")]).explain()
    assert "WindowGroupLimit" in capsys.readouterr().out

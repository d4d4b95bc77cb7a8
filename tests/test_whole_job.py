"""Queries do their whole job: no part of a text and no layer is left out."""

from difflib import SequenceMatcher

import pytest

import __spark_entry__ as entry


def table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_suggestions_use_all_words_of_a_label(spark, tmp_path):
    names = ["small ring", "hot bolt", "old gear ring", "new plate", "ring of gears"]
    parts = [(i * 40, names[i % 5]) for i in range(30)]
    table(spark, tmp_path, "part", parts, "p_partkey long, p_name string")
    label = lambda i, name: f"wa{i // 7:x}k xo{i // 5:x}m {name}"
    words = lambda t: {w for w in t.split() if len(w) >= 3}
    want = set()
    for i, name in parts:
        mention = label(i, name[1:])
        scored = [(SequenceMatcher(None, mention, label(*p)).ratio(), f"P{p[0]}") for p in parts if words(mention) & words(label(*p))]
        want |= {(mention, pid, r + 1) for r, (s, pid) in enumerate(sorted((x for x in scored if x[0] >= 0.4), reverse=True)[:3])}
    got = {(r.mention_key, r.id, r["rank"]) for r in entry.queries()["n18_suggest_candidates"](spark, str(tmp_path)).collect()}
    assert got == want


def test_mode_pairs_have_the_pairs_of_patient_groups(spark, tmp_path):
    day = "cast('2020-01-01' as timestamp)"
    spark.range(24).selectExpr("id AS o_orderkey", "id AS o_custkey", "if(id % 6 = 5, 'P', 'O') AS o_orderstatus", "1.0D AS o_totalprice", "'1-URGENT' AS o_orderpriority",
                               f"{day} AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(24).selectExpr("id AS c_custkey", "concat('c', id) AS c_name").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(1).selectExpr("id AS p_partkey", "'ring' AS p_name").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(1).selectExpr("id AS s_suppkey", "'s' AS s_name").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(24).selectExpr("id AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "1 AS l_linenumber", "1.0D AS l_quantity", "1.0D AS l_extendedprice", "'N' AS l_returnflag",
                               "'O' AS l_linestatus", f"{day} AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1).selectExpr("id AS event_id", f"{day} AS ts", "id + 1000 AS user_id", "'view' AS event_type", "1.0D AS value", "'{\"k\": 1}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    table(spark, tmp_path, "documents", [(900, "a line", "en", "s")], "doc_id long, text string, lang string, source string")
    found = {(r.a, r.b, r.n_items) for r in entry.queries()["q05_mode_pairs"](spark, str(tmp_path)).where("lens = 'groups'").collect()}
    bundle = {i: (i // 2) % 4 for i in range(24) if i % 6 != 5 and (i // 2) % 5 != 0 and (i // 2) % 4 != 2}
    want = {(*sorted((f"D{i}", f"D{j}")), 1) for i in bundle for j in bundle if i < j and bundle[i] == bundle[j]}
    assert found == want and len(want) > 10

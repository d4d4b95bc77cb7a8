"""The pipeline's stages one after the other on the smallest tables, each against what its operator says on its own input."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from corrobora.llm import near_dedup, pii, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "mixing"]
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (before, docs)
        if name != "mixing":
            assert docs.dtypes == before.dtypes
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    before, after = seen["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score_texts(before, toxicity.learn_lexicon(before, labels))
    assert ids(after) == ids(scored.where("score < 0.5"))

    before, after = seen["near_duplicates"]
    assert ids(after) == ids(near_dedup.near_duplicates(before).where("kept"))

    before, after = seen["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids(after) == {r.doc_id for r in before.collect() if not any(t in r.text for t in items)}

    before, after = seen["pii"]
    old = {r.doc_id: r for r in before.collect()}
    rows = after.collect()
    assert {r.doc_id for r in rows} == set(old)
    for r in rows:
        assert pii.base_spans(r.text) == [] and r.n_chars == (len(r.text) if r.text != old[r.doc_id].text else old[r.doc_id].n_chars)
        kinds = re.findall(r"\[(?:EMAIL|IP|CARD|PHONE)\]", r.text)
        assert len(kinds) >= min(1, len(pii.base_spans(old[r.doc_id].text)))

    before, after = seen["mixing"]
    assert ids(after) == ids(before)
    assert abs(after.agg(F.sum("taken")).first()[0] / before.select(F.sum(F.size(F.split("text", r"\s+")))).first()[0] - 1.5) < 0.05


def test_pipeline_and_operators_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))

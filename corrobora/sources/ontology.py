"""Ontology graphs, annotation tables and vocabularies as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.functions.text import curie, norm_xref

# The part of an OBO-graph document that is read.
OBO_SCHEMA = """
graphs ARRAY<STRUCT<
  nodes: ARRAY<STRUCT<id: STRING, type: STRING, lbl: STRING, meta: STRUCT<
    definition: STRUCT<val: STRING>, deprecated: BOOLEAN, subsets: ARRAY<STRING>,
    synonyms: ARRAY<STRUCT<pred: STRING, val: STRING, synonymType: STRING>>,
    xrefs: ARRAY<STRUCT<val: STRING>>, basicPropertyValues: ARRAY<STRUCT<pred: STRING, val: STRING>>>>>,
  edges: ARRAY<STRUCT<sub: STRING, pred: STRING, obj: STRING>>>>
"""
ANNOTATION_SCHEMA = "database_id STRING, disease_name STRING, qualifier STRING, hpo_id STRING, reference STRING, evidence STRING, onset STRING, frequency STRING, sex STRING, modifier STRING, aspect STRING, biocuration STRING"


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    """One row per document; the explode right after it spreads the nodes of many documents over the cluster."""
    return spark.read.schema(OBO_SCHEMA).option("multiLine", True).json(path)


def obo_nodes(documents: DataFrame) -> DataFrame:
    return documents.select(F.explode("graphs").alias("g")).select(F.explode("g.nodes").alias("n")).select("n.*")


def obo_edges(documents: DataFrame) -> DataFrame:
    return documents.select(F.explode("graphs").alias("g")).select(F.explode("g.edges").alias("e")).select("e.*")


def ontology_nodes(raw: DataFrame, prefix: str) -> DataFrame:
    """Class nodes of one id prefix with label, synonyms, cross references, definition and rare-disease subsets."""
    meta = F.col("meta")
    synonyms = F.transform(
        F.filter(F.coalesce(meta["synonyms"], F.expr("array()")), lambda s: ~F.coalesce(s["synonymType"], F.lit("")).contains("DEPRECATED")),
        lambda s: s["val"])
    exact = F.transform(
        F.filter(F.coalesce(meta["synonyms"], F.expr("array()")), lambda s: F.coalesce(s["pred"], F.lit("")).endswith("hasExactSynonym")),
        lambda s: s["val"])
    xrefs = F.transform(F.coalesce(meta["xrefs"], F.expr("array()")), lambda x: norm_xref(x["val"]))
    rare = F.transform(
        F.filter(F.coalesce(meta["subsets"], F.expr("array()")), lambda s: s.endswith("_rare") | s.endswith("#rare")),
        lambda s: F.substring_index(s, "#", -1))
    listed = lambda c: F.array_sort(F.array_distinct(c))
    return raw.filter((F.col("type") == "CLASS") & F.col("id").contains(f"/{prefix}_")).select(
        curie("id").alias("id"), F.col("lbl").alias("label"), listed(synonyms).alias("synonyms"), exact.alias("exact_synonyms"),
        listed(xrefs).alias("xrefs"), meta["definition"]["val"].alias("definition"),
        F.coalesce(meta["deprecated"], F.lit(False)).alias("deprecated"), listed(rare).alias("rare_subsets"))


def read_ontology_nodes(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    return ontology_nodes(obo_nodes(read_obo(spark, path)), prefix)


def term_names(raw: DataFrame, prefix: str) -> DataFrame:
    named = raw.withColumn("term", curie("id")).filter(F.col("term").startswith(prefix + ":"))
    return named.select(F.col("term").alias("id"), F.coalesce("lbl", "term").alias("label"))


def term_parents(raw_edges: DataFrame, prefix: str) -> DataFrame:
    """is_a edges between two terms of the prefix."""
    ends = raw_edges.filter("pred = 'is_a'").select(curie("sub").alias("child"), curie("obj").alias("parent"))
    return ends.filter(F.col("child").startswith(prefix + ":") & F.col("parent").startswith(prefix + ":"))


def term_alternatives(raw: DataFrame, prefix: str) -> DataFrame:
    """(old, current): alternative ids that stand for a term."""
    alt = F.filter(F.coalesce(F.col("meta")["basicPropertyValues"], F.expr("array()")), lambda p: p["pred"].endswith("hasAlternativeId"))
    rows = raw.select(curie("id").alias("current"), F.explode(alt).alias("p"))
    old = F.coalesce(curie("p.val"), F.col("p.val"))
    return rows.filter(F.col("current").startswith(prefix + ":")).select(old.alias("old"), "current")


def kept_annotations(raw: DataFrame) -> DataFrame:
    """Phenotype rows that are not negated; both filters reach the scan."""
    columns = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in raw.columns]
    return raw.filter((F.col("aspect") == "P") & ~F.col("qualifier").eqNullSafe("NOT")).select(*columns)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated annotations; only whole comment lines are skipped."""
    raw = spark.read.option("sep", "\t").option("comment", "#").option("header", True).schema(ANNOTATION_SCHEMA).csv(path)
    return kept_annotations(raw)


def rewrite_alt_ids(df: DataFrame, alternatives: DataFrame, column: str) -> DataFrame:
    """Obsolete ids in ``column`` become current ones."""
    alt = alternatives.select(F.col("old").alias(column), F.col("current").alias("_current")).dropDuplicates([column])
    return df.join(alt, column, "left").withColumn(column, F.coalesce("_current", column)).drop("_current")


def read_seeds(seeds: DataFrame) -> DataFrame:
    """(mondo, gene) rows of the seed table."""
    return seeds.select("mondo", F.explode_outer("genes").alias("gene"))


def flatten_gene_docs(docs: DataFrame) -> DataFrame:
    """One record per gene with the sorted distinct union of all its other names."""
    none = F.expr("cast(array() AS array<string>)")
    names = F.concat(*[F.coalesce(F.col(c), none) for c in ("alias_symbol", "prev_symbol", "alias_name", "prev_name")])
    return docs.select(
        "hgnc_id", "symbol", "name", F.array_sort(F.array_distinct(names)).alias("aliases"), "entrez_id",
        F.col("ensembl_gene_id").alias("ensembl_id"), "location", "locus_type", "status")

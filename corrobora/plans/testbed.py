"""The driver's star-schema tables seen as an evidence graph.

Sizes of all groups stay constant while the tables grow (an order has about 4 parts, a part about 30 orders, a
customer about 10 orders), so pair operators grow linearly with the data. Each table has its SQL twin in ``CTES``.

orders = diseases, customers = genes, parts = phenotypes, suppliers = mechanisms, events = variants and grants,
documents = papers with their lines as claims, (supplier, ship date) = studies.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.model import EvidenceGraph

TABLES = ["orders", "customer", "part", "supplier", "lineitem", "events", "documents", "pages",
          "benchmark", "labels", "conversations", "nation", "region"]

NODE_COLUMNS = ["id", "type", "name", "paper_scoped"]
EDGE_COLUMNS = ["edge_id", "src", "dst", "rel", "source", "source_tier", "status", "method", "supported_by"]


class Testbed:
    """Lazily built DataFrames over one scale-factor folder."""

    __test__ = False

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.made: dict[str, object] = {}  # written intermediate tables that several parts of a query read

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # ---- nodes

    @cached_property
    def disease(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "concat('D', o_orderkey) AS id", "'Disease' AS type",
            "concat(o_orderpriority, ' disorder ', o_orderkey) AS name",
            "o_orderstatus = 'P' AS paper_scoped", "concat('C', o_custkey) AS short",
            "o_orderkey AS num",
        )

    @cached_property
    def gene(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "concat('G', c_custkey) AS id", "'Gene' AS type", "c_name AS name", "false AS paper_scoped")

    @cached_property
    def gene_group(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "concat('GG', c_custkey div 3) AS id", "'GeneGroup' AS type",
            "concat('family ', c_custkey div 3) AS name", "false AS paper_scoped").distinct()

    @cached_property
    def phenotype(self) -> DataFrame:
        return self.table("part").selectExpr(
            "concat('P', p_partkey) AS id", "'Phenotype' AS type",
            "concat(p_name, ' ', p_partkey) AS name", "false AS paper_scoped")

    @cached_property
    def mechanism(self) -> DataFrame:
        return self.table("supplier").selectExpr(
            "concat('M', s_suppkey) AS id", "'Mechanism' AS type", "s_name AS name", "false AS paper_scoped")

    @cached_property
    def variant(self) -> DataFrame:
        return self.table("events").selectExpr(
            "concat('V', event_id) AS id", "'Variant' AS type", "concat('change ', event_id) AS name",
            "false AS paper_scoped", "concat('G', user_id) AS gene",
            "CASE event_type WHEN 'click' THEN 'Pathogenic' WHEN 'view' THEN 'Likely pathogenic' "
            "WHEN 'purchase' THEN 'Pathogenic/Likely pathogenic' WHEN 'signup' THEN 'Benign' "
            "ELSE 'Uncertain significance' END AS classification",
            "CASE event_id % 5 WHEN 0 THEN 'practice guideline' WHEN 1 THEN 'reviewed by expert panel' "
            "WHEN 2 THEN 'criteria provided, multiple submitters, no conflicts' "
            "WHEN 3 THEN 'criteria provided, single submitter' ELSE 'no assertion criteria provided' END AS review_status",
            "CASE event_id % 6 WHEN 0 THEN 'missense variant' WHEN 1 THEN 'frameshift variant' "
            "WHEN 2 THEN 'nonsense' WHEN 3 THEN 'splice donor variant' WHEN 4 THEN 'synonymous variant' "
            "ELSE 'intron variant' END AS consequence",
            "date_format(ts, 'yyyy/MM/dd') AS last_evaluated",
            "concat('disorder ', event_id % 50) AS traits",
            "CASE WHEN event_id % 7 = 0 THEN concat('G', user_id, ';G', user_id + 1) "
            "ELSE concat('G', user_id) END AS genes_on_record",
            "event_id AS num",
        )

    @cached_property
    def paper(self) -> DataFrame:
        return self.table("documents").selectExpr(
            "concat('PMID:', doc_id) AS id", "'Paper' AS type",
            "concat(source, ' ', lang, ' ', doc_id) AS name", "false AS paper_scoped", "doc_id AS num")

    @cached_property
    def claim(self) -> DataFrame:
        """One claim per non-empty line of a document."""
        lines = self.table("documents").select(
            "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"([^\n]+)"), 1)).alias("i", "quote"))
        return lines.filter(F.trim("quote") != "").selectExpr(
            "concat('CL', doc_id, '-', i + 1) AS id", "'Claim' AS type", "quote",
            "concat('PMID:', doc_id) AS pmid", "doc_id", "i + 1 AS pos",
            "CASE WHEN (doc_id + i) % 4 = 3 THEN 'hypothesis' ELSE 'observation' END AS status",
            "CASE WHEN doc_id % 7 = 0 THEN 'n/a' ELSE cast(cast((doc_id + i) % 10 + 1 AS double) / 10 AS string) END AS confidence",
            "CASE (doc_id + i) % 5 WHEN 0 THEN 'negated' WHEN 1 THEN 'uncertain' ELSE 'affirmed' END AS polarity",
            "CASE (doc_id + i) % 6 WHEN 0 THEN 'finding' WHEN 1 THEN 'background' WHEN 2 THEN 'study_design' "
            "WHEN 3 THEN 'result' WHEN 4 THEN 'limitation' ELSE 'authorship' END AS category",
            "CASE (doc_id + i) % 3 WHEN 0 THEN 'HAS_PHENOTYPE' WHEN 1 THEN 'ASSOCIATED_WITH' ELSE 'ABOUT' END AS relation",
            "concat('D', doc_id * 10 + i % 3) AS subject",
            "CASE (doc_id + i) % 3 WHEN 0 THEN concat('P', doc_id * 2 + i % 2) ELSE concat('G', doc_id) END AS object",
        )

    # ---- edges

    def _edges(self, df: DataFrame) -> DataFrame:
        return df.withColumn("retrieved", F.lit("2026-01-01").cast("date"))

    @cached_property
    def associated_with(self) -> DataFrame:
        return self._edges(self.table("orders").selectExpr(
            "concat('ASSOCIATED_WITH:', o_orderkey) AS edge_id", "concat('D', o_orderkey) AS src",
            "concat('G', o_custkey) AS dst", "'ASSOCIATED_WITH' AS rel", "'registry' AS source",
            "CASE WHEN o_orderpriority < '3' THEN 1 ELSE 3 END AS source_tier",
            "CASE WHEN o_orderpriority < '3' THEN 'observation' ELSE 'hypothesis' END AS status",
            "'curated_import' AS method", "cast(array() AS array<string>) AS supported_by", "o_orderkey AS seq"))

    @cached_property
    def has_phenotype(self) -> DataFrame:
        return self._edges(self.table("lineitem").selectExpr(
            "concat_ws(':', 'HAS_PHENOTYPE', l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(round(l_extendedprice * 100) AS bigint)) AS edge_id",
            "concat('D', l_orderkey) AS src", "concat('P', l_partkey) AS dst", "'HAS_PHENOTYPE' AS rel",
            "'annotations' AS source", "1 + l_linenumber % 3 AS source_tier",
            "CASE l_returnflag WHEN 'R' THEN 'observation' WHEN 'A' THEN 'inference' ELSE 'hypothesis' END AS status",
            "CASE l_linestatus WHEN 'O' THEN 'curated_import' ELSE 'computed' END AS method",
            "cast(array() AS array<string>) AS supported_by", "l_orderkey AS seq"))

    @cached_property
    def involves(self) -> DataFrame:
        return self._edges(self.table("lineitem").filter("l_quantity >= 45").selectExpr(
            "concat_ws(':', 'INVOLVES', l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(round(l_extendedprice * 100) AS bigint)) AS edge_id",
            "concat('D', l_orderkey) AS src", "concat('M', l_suppkey) AS dst", "'INVOLVES' AS rel",
            "'papers' AS source", "2 AS source_tier", "'inference' AS status", "'llm_extracted' AS method",
            "CASE WHEN l_linenumber = 7 THEN cast(array() AS array<string>) "
            "ELSE array(concat('CL', l_orderkey div 10, '-1'), concat('CL', l_orderkey div 10, '-2')) END AS supported_by",
            "l_orderkey AS seq"))

    @cached_property
    def in_gene(self) -> DataFrame:
        return self._edges(self.table("events").selectExpr(
            "concat('IN_GENE:', event_id) AS edge_id", "concat('V', event_id) AS src", "concat('G', user_id) AS dst",
            "'IN_GENE' AS rel", "'variants' AS source", "1 AS source_tier", "'observation' AS status",
            "'curated_import' AS method", "cast(array() AS array<string>) AS supported_by", "event_id AS seq"))

    @cached_property
    def disrupts(self) -> DataFrame:
        return self._edges(self.table("events").filter("event_type IN ('click', 'error')").selectExpr(
            "concat('DISRUPTS:', event_id) AS edge_id", "concat('V', event_id) AS src",
            "concat('M', event_id div 100) AS dst", "'DISRUPTS' AS rel", "'papers' AS source", "2 AS source_tier",
            "'observation' AS status", "'llm_extracted' AS method",
            "array(concat('CL', event_id div 10, '-1')) AS supported_by", "event_id AS seq"))

    @cached_property
    def contains(self) -> DataFrame:
        return self._edges(self.claim.selectExpr(
            "concat('CONTAINS:', id) AS edge_id", "pmid AS src", "id AS dst", "'CONTAINS' AS rel", "pmid AS source",
            "2 AS source_tier", "'observation' AS status", "'llm_extracted' AS method",
            "array(id) AS supported_by", "pos AS seq"))

    @cached_property
    def about(self) -> DataFrame:
        cols = ["pmid", "id", "pos"]
        ends = self.claim.select(*cols, F.explode(F.array("subject", "object")).alias("dst"))
        return self._edges(ends.selectExpr(
            "concat('ABOUT:', id, ':', dst) AS edge_id", "id AS src", "dst", "'ABOUT' AS rel", "pmid AS source",
            "2 AS source_tier", "'observation' AS status", "'llm_extracted' AS method",
            "array(id) AS supported_by", "pos AS seq"))

    # ---- serving-layer assets

    @cached_property
    def studies(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            "concat('S', l_suppkey, '-', date_format(l_shipdate, 'yyyyMMdd')) AS src",
            "concat('D', l_orderkey) AS dst").distinct()

    @cached_property
    def tests(self) -> DataFrame:
        return self.table("lineitem").filter("l_returnflag = 'R'").selectExpr(
            "concat('S', l_suppkey, '-', date_format(l_shipdate, 'yyyyMMdd')) AS src",
            "concat('I', l_partkey) AS dst").distinct()

    @cached_property
    def grant(self) -> DataFrame:
        return self.table("events").filter("event_type = 'purchase'").selectExpr(
            "concat('GR', event_id) AS id", "concat('G', user_id) AS gene", "user_id", "event_id", "value",
            "year(ts) AS fiscal_year", "concat('project ', user_id, ' phase ', event_id % 4) AS title",
            "concat('core-', user_id, '-', event_id % 9) AS core_project",
            "concat('org ', event_id % 8) AS organization",
            "concat('R', user_id div 2, '-', cast(get_json_object(props, '$.k') AS int) % 5) AS researcher")

    @cached_property
    def represented_by(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "concat('D', o_orderkey) AS src",
            "concat('O', o_custkey div 2, '-', substr(o_orderpriority, 1, 1)) AS dst").distinct()

    @cached_property
    def member_of(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "concat('G', c_custkey) AS src", "concat('GG', c_custkey div 3) AS dst")

    @cached_property
    def discusses(self) -> DataFrame:
        return self.claim.select(F.col("pmid").alias("src"), F.col("subject").alias("dst")).distinct()

    @cached_property
    def org(self) -> DataFrame:
        """Organisations with a focus (by customer group) and a scope (every fifth is specific to one disease)."""
        return self.represented_by.select(F.col("dst").alias("id")).distinct().selectExpr(
            "id", "'PatientOrg' AS type", "concat('org ', id) AS name", "false AS paper_scoped",
            "CASE cast(substr(split(id, '-')[0], 2) AS bigint) % 4 WHEN 0 THEN 'Disease-specific' WHEN 1 THEN 'Epilepsy' "
            "WHEN 2 THEN 'Rare diseases (general)' ELSE 'Children & disability' END AS focus",
            "CASE WHEN cast(substr(split(id, '-')[0], 2) AS bigint) % 5 = 0 THEN 'specific' ELSE 'shared' END AS scope")

    @cached_property
    def serving(self) -> EvidenceGraph:
        """The serving graph: core node types and all asset relations."""
        cols = NODE_COLUMNS
        nodes = self.nodes.select(*cols).unionByName(self.gene_group.select(*cols))
        plain = lambda df, t: df.select("id", F.lit(t).alias("type"), F.col("id").alias("name"), F.lit(False).alias("paper_scoped")).distinct()
        nodes = nodes.unionByName(plain(self.studies.select(F.col("src").alias("id")), "Study"))
        nodes = nodes.unionByName(plain(self.tests.select(F.col("dst").alias("id")), "Intervention"))
        nodes = nodes.unionByName(plain(self.grant, "Grant")).unionByName(plain(self.grant.select(F.col("researcher").alias("id")), "Researcher"))
        nodes = nodes.unionByName(self.org, allowMissingColumns=True)
        rel = lambda df, name, s="src", d="dst": df.select(
            F.concat_ws(":", F.lit(name), s, d).alias("edge_id"), F.col(s).alias("src"), F.col(d).alias("dst"), F.lit(name).alias("rel"))
        edges = self.edges.select("edge_id", "src", "dst", "rel")
        for df in (rel(self.studies, "STUDIES"), rel(self.tests, "TESTS"), rel(self.member_of, "MEMBER_OF"), rel(self.represented_by, "REPRESENTED_BY"),
                   rel(self.discusses, "DISCUSSES"), rel(self.grant, "RESEARCHES", "id", "gene"), rel(self.grant, "LEADS", "researcher", "id")):
            edges = edges.unionByName(df)
        return EvidenceGraph(nodes, edges.withColumn("reason", F.lit(None).cast("string")))

    # ---- derived

    @cached_property
    def ontology(self) -> DataFrame:
        """Multi-parent DAG over the parts: part -> family (half of them two) -> group -> root."""
        return self.table("part").selectExpr(
            "explode(array("
            "struct(concat('P', p_partkey) AS child, concat('T1:', p_partkey div 4) AS parent), "
            "struct(concat('P', p_partkey) AS child, concat('T1:', (p_partkey + 2) div 4) AS parent), "
            "struct(concat('T1:', p_partkey div 4) AS child, concat('T2:', p_partkey div 32) AS parent), "
            "struct(concat('T1:', (p_partkey + 2) div 4) AS child, concat('T2:', (p_partkey + 2) div 32) AS parent), "
            "struct(concat('T2:', p_partkey div 32) AS child, 'T:ROOT' AS parent), "
            "struct(concat('T2:', (p_partkey + 2) div 32) AS child, 'T:ROOT' AS parent))) AS e"
        ).select("e.*").distinct()

    @cached_property
    def annotation(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            "concat('D', l_orderkey) AS entity", "concat('P', l_partkey) AS term").distinct()

    @cached_property
    def nodes(self) -> DataFrame:
        cols = NODE_COLUMNS
        parts = [self.disease, self.gene, self.phenotype, self.mechanism, self.variant, self.paper,
                 self.claim.withColumn("name", F.lit(None).cast("string")).withColumn("paper_scoped", F.lit(False))]
        out = parts[0].select(*cols)
        for p in parts[1:]:
            out = out.unionByName(p.select(*cols))
        return out

    @cached_property
    def edges(self) -> DataFrame:
        parts = [self.associated_with, self.has_phenotype, self.involves, self.in_gene, self.disrupts,
                 self.contains, self.about]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @cached_property
    def graph(self) -> EvidenceGraph:
        return EvidenceGraph(self.nodes, self.edges)

    @cached_property
    def disease_graph(self) -> EvidenceGraph:
        """Only what the pair score reads, so that the scans of the other relations are not planned."""
        cols = NODE_COLUMNS
        nodes = self.disease.select(*cols).unionByName(self.gene.select(*cols)).unionByName(
            self.phenotype.select(*cols)).unionByName(self.mechanism.select(*cols))
        return EvidenceGraph(nodes, self.associated_with.unionByName(self.has_phenotype).unionByName(self.involves))


CTES = r"""
disease AS (SELECT 'D'||o_orderkey AS id, o_orderpriority||' disorder '||o_orderkey AS name,
  o_orderstatus='P' AS paper_scoped, 'C'||o_custkey AS short, o_orderkey AS num FROM orders),
gene AS (SELECT 'G'||c_custkey AS id, c_name AS name FROM customer),
phenotype AS (SELECT 'P'||p_partkey AS id, p_name||' '||p_partkey AS name FROM part),
mechanism AS (SELECT 'M'||s_suppkey AS id, s_name AS name FROM supplier),
variant AS (SELECT 'V'||event_id AS id, 'change '||event_id AS name, 'G'||user_id AS gene,
  CASE event_type WHEN 'click' THEN 'Pathogenic' WHEN 'view' THEN 'Likely pathogenic'
    WHEN 'purchase' THEN 'Pathogenic/Likely pathogenic' WHEN 'signup' THEN 'Benign' ELSE 'Uncertain significance' END AS classification,
  CASE event_id%5 WHEN 0 THEN 'practice guideline' WHEN 1 THEN 'reviewed by expert panel'
    WHEN 2 THEN 'criteria provided, multiple submitters, no conflicts'
    WHEN 3 THEN 'criteria provided, single submitter' ELSE 'no assertion criteria provided' END AS review_status,
  CASE event_id%6 WHEN 0 THEN 'missense variant' WHEN 1 THEN 'frameshift variant' WHEN 2 THEN 'nonsense'
    WHEN 3 THEN 'splice donor variant' WHEN 4 THEN 'synonymous variant' ELSE 'intron variant' END AS consequence,
  strftime(ts,'%Y/%m/%d') AS last_evaluated, 'disorder '||(event_id%50) AS traits,
  CASE WHEN event_id%7=0 THEN 'G'||user_id||';G'||(user_id+1) ELSE 'G'||user_id END AS genes_on_record,
  event_id AS num FROM events),
paper AS (SELECT 'PMID:'||doc_id AS id, source||' '||lang||' '||doc_id AS name, doc_id AS num FROM documents),
raw_line AS (SELECT doc_id, unnest(regexp_extract_all(text,'[^\n]+')) AS quote,
  generate_subscripts(regexp_extract_all(text,'[^\n]+'),1) AS i FROM documents),
claim AS (SELECT 'CL'||doc_id||'-'||i AS id, quote, 'PMID:'||doc_id AS pmid, doc_id, CAST(i AS BIGINT) AS pos,
  CASE WHEN (doc_id+i-1)%4=3 THEN 'hypothesis' ELSE 'observation' END AS status,
  CASE WHEN doc_id%7=0 THEN 'n/a' ELSE CAST(CAST((doc_id+i-1)%10+1 AS DOUBLE)/10 AS VARCHAR) END AS confidence,
  CASE (doc_id+i-1)%5 WHEN 0 THEN 'negated' WHEN 1 THEN 'uncertain' ELSE 'affirmed' END AS polarity,
  CASE (doc_id+i-1)%6 WHEN 0 THEN 'finding' WHEN 1 THEN 'background' WHEN 2 THEN 'study_design'
    WHEN 3 THEN 'result' WHEN 4 THEN 'limitation' ELSE 'authorship' END AS category,
  CASE (doc_id+i-1)%3 WHEN 0 THEN 'HAS_PHENOTYPE' WHEN 1 THEN 'ASSOCIATED_WITH' ELSE 'ABOUT' END AS relation,
  'D'||(doc_id*10+(i-1)%3) AS subject,
  CASE (doc_id+i-1)%3 WHEN 0 THEN 'P'||(doc_id*2+(i-1)%2) ELSE 'G'||doc_id END AS object
  FROM raw_line WHERE trim(quote,' ')<>''),
associated_with AS (SELECT 'ASSOCIATED_WITH:'||o_orderkey AS edge_id, 'D'||o_orderkey AS src, 'G'||o_custkey AS dst,
  'ASSOCIATED_WITH' AS rel, 'registry' AS source, CASE WHEN o_orderpriority<'3' THEN 1 ELSE 3 END AS source_tier,
  CASE WHEN o_orderpriority<'3' THEN 'observation' ELSE 'hypothesis' END AS status, 'curated_import' AS method,
  CAST([] AS VARCHAR[]) AS supported_by FROM orders),
has_phenotype AS (SELECT concat_ws(':','HAS_PHENOTYPE',l_orderkey,l_partkey,l_suppkey,l_linenumber,CAST(round(l_extendedprice*100) AS BIGINT)) AS edge_id,
  'D'||l_orderkey AS src, 'P'||l_partkey AS dst, 'HAS_PHENOTYPE' AS rel, 'annotations' AS source, 1+l_linenumber%3 AS source_tier,
  CASE l_returnflag WHEN 'R' THEN 'observation' WHEN 'A' THEN 'inference' ELSE 'hypothesis' END AS status,
  CASE l_linestatus WHEN 'O' THEN 'curated_import' ELSE 'computed' END AS method,
  CAST([] AS VARCHAR[]) AS supported_by FROM lineitem),
involves AS (SELECT concat_ws(':','INVOLVES',l_orderkey,l_partkey,l_suppkey,l_linenumber,CAST(round(l_extendedprice*100) AS BIGINT)) AS edge_id,
  'D'||l_orderkey AS src, 'M'||l_suppkey AS dst, 'INVOLVES' AS rel, 'papers' AS source, 2 AS source_tier, 'inference' AS status,
  'llm_extracted' AS method, CASE WHEN l_linenumber=7 THEN CAST([] AS VARCHAR[])
    ELSE ['CL'||(l_orderkey//10)||'-1','CL'||(l_orderkey//10)||'-2'] END AS supported_by FROM lineitem WHERE l_quantity>=45),
in_gene AS (SELECT 'IN_GENE:'||event_id AS edge_id, 'V'||event_id AS src, 'G'||user_id AS dst, 'IN_GENE' AS rel, 'variants' AS source,
  1 AS source_tier, 'observation' AS status, 'curated_import' AS method, CAST([] AS VARCHAR[]) AS supported_by FROM events),
disrupts AS (SELECT 'DISRUPTS:'||event_id AS edge_id, 'V'||event_id AS src, 'M'||(event_id//100) AS dst, 'DISRUPTS' AS rel, 'papers' AS source,
  2 AS source_tier, 'observation' AS status, 'llm_extracted' AS method, ['CL'||(event_id//10)||'-1'] AS supported_by
  FROM events WHERE event_type IN ('click','error')),
contains_e AS (SELECT 'CONTAINS:'||id AS edge_id, pmid AS src, id AS dst, 'CONTAINS' AS rel, pmid AS source, 2 AS source_tier,
  'observation' AS status, 'llm_extracted' AS method, [id] AS supported_by FROM claim),
about AS (SELECT 'ABOUT:'||id||':'||dst AS edge_id, id AS src, dst, 'ABOUT' AS rel, pmid AS source, 2 AS source_tier,
  'observation' AS status, 'llm_extracted' AS method, [id] AS supported_by
  FROM (SELECT id, pmid, unnest([subject,object]) AS dst FROM claim)),
studies AS (SELECT DISTINCT 'S'||l_suppkey||'-'||strftime(l_shipdate,'%Y%m%d') AS src, 'D'||l_orderkey AS dst FROM lineitem),
tests AS (SELECT DISTINCT 'S'||l_suppkey||'-'||strftime(l_shipdate,'%Y%m%d') AS src, 'I'||l_partkey AS dst FROM lineitem WHERE l_returnflag='R'),
grants AS (SELECT 'GR'||event_id AS id, 'G'||user_id AS gene, user_id, event_id, value, CAST(year(ts) AS INTEGER) AS fiscal_year,
  'project '||user_id||' phase '||(event_id%4) AS title, 'core-'||user_id||'-'||(event_id%9) AS core_project,
  'org '||(event_id%8) AS organization,
  'R'||(user_id//2)||'-'||(CAST(json_extract_string(props,'$.k') AS INTEGER)%5) AS researcher FROM events WHERE event_type='purchase'),
represented_by AS (SELECT DISTINCT 'D'||o_orderkey AS src, 'O'||(o_custkey//2)||'-'||o_orderpriority[1] AS dst FROM orders),
discusses AS (SELECT DISTINCT pmid AS src, subject AS dst FROM claim),
org AS (SELECT DISTINCT dst AS id, 'org '||dst AS name, (['Disease-specific','Epilepsy','Rare diseases (general)','Children & disability'])[CAST(string_split(dst,'-')[1][2:] AS BIGINT)%4+1] AS focus,
  CASE WHEN CAST(string_split(dst,'-')[1][2:] AS BIGINT)%5=0 THEN 'specific' ELSE 'shared' END AS scope FROM represented_by),
core AS (SELECT id FROM disease WHERE NOT paper_scoped),
member_of AS (SELECT 'G'||c_custkey AS src, 'GG'||(c_custkey//3) AS dst FROM customer),
ontology AS (SELECT 'P'||p_partkey AS child, 'T1:'||(p_partkey//4) AS parent FROM part
  UNION SELECT 'P'||p_partkey, 'T1:'||((p_partkey+2)//4) FROM part
  UNION SELECT 'T1:'||(p_partkey//4), 'T2:'||(p_partkey//32) FROM part
  UNION SELECT 'T1:'||((p_partkey+2)//4), 'T2:'||((p_partkey+2)//32) FROM part
  UNION SELECT 'T2:'||(p_partkey//32), 'T:ROOT' FROM part
  UNION SELECT 'T2:'||((p_partkey+2)//32), 'T:ROOT' FROM part),
annotation AS (SELECT DISTINCT 'D'||l_orderkey AS entity, 'P'||l_partkey AS term FROM lineitem),
nodes AS (SELECT id,'Disease' AS type,name,paper_scoped FROM disease UNION ALL SELECT id,'Gene',name,false FROM gene
  UNION ALL SELECT id,'Phenotype',name,false FROM phenotype UNION ALL SELECT id,'Mechanism',name,false FROM mechanism
  UNION ALL SELECT id,'Variant',name,false FROM variant UNION ALL SELECT id,'Paper',name,false FROM paper
  UNION ALL SELECT id,'Claim',NULL,false FROM claim),
edges AS (SELECT * FROM associated_with UNION ALL SELECT * FROM has_phenotype UNION ALL SELECT * FROM involves
  UNION ALL SELECT * FROM in_gene UNION ALL SELECT * FROM disrupts UNION ALL SELECT * FROM contains_e UNION ALL SELECT * FROM about),
closure AS (SELECT child AS term, child AS ancestor FROM ontology UNION SELECT parent, parent FROM ontology
  UNION SELECT child, parent FROM ontology
  UNION SELECT a.child, b.parent FROM ontology a JOIN ontology b ON a.parent=b.child
  UNION SELECT a.child, c.parent FROM ontology a JOIN ontology b ON a.parent=b.child JOIN ontology c ON b.parent=c.child),
closed AS (SELECT DISTINCT a.entity, coalesce(c.ancestor,a.term) AS term FROM annotation a LEFT JOIN closure c ON a.term=c.term),
ic AS (SELECT term, count(*) AS n, log2((SELECT count(DISTINCT entity) FROM annotation)/count(*)) AS ic FROM closed GROUP BY term),
evidence AS (SELECT e.src, e.dst, e.rel, e.edge_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE,
  CASE status WHEN 'observation' THEN 1.0::DOUBLE WHEN 'inference' THEN 0.8::DOUBLE WHEN 'hypothesis' THEN 0.5::DOUBLE ELSE 0::DOUBLE END
  * CASE source_tier WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.9::DOUBLE WHEN 3 THEN 0.65::DOUBLE ELSE 0::DOUBLE END
  * CASE method WHEN 'curated_import' THEN 1.0::DOUBLE WHEN 'computed' THEN 0.95::DOUBLE WHEN 'llm_extracted' THEN 0.9::DOUBLE ELSE 0::DOUBLE END
  * coalesce(conf,1.0::DOUBLE))) AS evidence
  FROM (SELECT * FROM associated_with UNION ALL SELECT * FROM has_phenotype UNION ALL SELECT * FROM involves) e
  LEFT JOIN (SELECT edge_id, avg(TRY_CAST(c.confidence AS DOUBLE)) AS conf
    FROM (SELECT edge_id, unnest(supported_by) AS id FROM involves) s JOIN claim c ON c.id=s.id GROUP BY edge_id) k ON k.edge_id=e.edge_id),
features AS (SELECT src AS entity, CASE rel WHEN 'INVOLVES' THEN 'mechanism' WHEN 'HAS_PHENOTYPE' THEN 'phenotype' ELSE 'gene' END AS kind,
  dst AS item, max(evidence) AS support FROM evidence
  WHERE src IN (SELECT id FROM disease)
  AND dst IN (SELECT id FROM gene UNION ALL SELECT id FROM phenotype UNION ALL SELECT id FROM mechanism) GROUP BY ALL),
rarity AS (SELECT entity, item, 1.0/count(*) OVER (PARTITION BY item) AS weight FROM features WHERE kind='phenotype')
"""


def sql(body: str) -> str:
    """An oracle query over the testbed tables; a body that starts with a comma adds its own tables."""
    return f"WITH RECURSIVE {CTES.strip()}\n{body.strip()}"

"""Registered queries of the pipeline operators, with SQL where SQL can express the whole result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.llm import chat, conv_trie, decontaminate, licences, mixing, near_dedup, ngram_join, oracles, pii, quality, resampling, toxicity, url_rules, warc
from corrobora.llm.tables import small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            small_batches(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_url_rules")
def op1(spark, sf_dir):
    return url_rules.judge_urls(table(spark, sf_dir, "pages"))


@query("op2_benchmark_decontamination")
def op2(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_chat_repair")
def op3(spark, sf_dir):
    return chat.repair_roles(table(spark, sf_dir, "conversations"))


@query("op4_minhash_near_dedup")
def op4(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def _licence_sql() -> str:
    """The scan over token rows; wordings, phrases and rare words come from the operator's fixed tables."""
    quoted = lambda x: "'" + x + "'"
    postings = ", ".join(
        f"({i}, {quoted(label)}, {quoted(key)}, {p}, {quoted(w)})"
        for i, (label, text, key) in enumerate(licences.TEMPLATES) for p, w in enumerate(text.split()) if w in licences.RARE_WORDS
    )
    phrases = ", ".join(f"({quoted(p)}, {quoted(label)}, {len(p.split())})" for p, label in licences.PHRASES.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
  coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
tok AS MATERIALIZED (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
ph(phrase, label, n) AS (VALUES {phrases}),
win AS (SELECT r, pos, word, lead(word, 1) OVER o AS w1, lead(word, 2) OVER o AS w2, lead(word, 3) OVER o AS w3 FROM tok WINDOW o AS (PARTITION BY r ORDER BY pos)),
hit AS (SELECT r, pos, label FROM win JOIN ph ON phrase = CASE n WHEN 3 THEN word || ' ' || w1 || ' ' || w2 ELSE word || ' ' || w1 || ' ' || w2 || ' ' || w3 END),
base AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM hit GROUP BY r),
post(template, label, key, tpos, word) AS (VALUES {postings}),
mark AS MATERIALIZED (SELECT r, pos, word FROM tok WHERE word IN (SELECT word FROM post)),
idf AS (SELECT word, ln(((SELECT count(*) FROM d) + 1.0::DOUBLE) / count(DISTINCT r)) AS idf FROM mark GROUP BY word),
ix AS (SELECT *, sum(idf) OVER (PARTITION BY template) AS mass FROM post JOIN idf USING (word)),
votes AS (SELECT r, label, key, sum(idf) / mass AS share FROM
  (SELECT DISTINCT r, template, label, key, mass, tpos, idf, pos - tpos AS shift FROM mark JOIN ix USING (word))
  GROUP BY r, template, label, key, mass, shift HAVING sum(idf) >= 0.6::DOUBLE * mass),
more AS (SELECT r, list(DISTINCT label) AS labels, max(share) AS share FROM votes JOIN d USING (r)
  WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' ' || key || ' ') GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(b.labels, ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') AS labels,
  CASE WHEN b.r IS NOT NULL THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, round(coalesce(m.share, 0), 6)) END AS score
FROM d LEFT JOIN base b USING (r) LEFT JOIN more m USING (r)"""


@query("op5_licence_scan", _licence_sql())
def op5(spark, sf_dir):
    return licences.scan_licences(table(spark, sf_dir, "documents"))


@query("op6_pii_skip_chain")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pii.personal_data(docs, pii.train_skip_chain(docs))


@query("op7_toxicity_lexicon")
def op7(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.learn_lexicon(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.score_texts(docs, lexicon).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


#: SHA-1 as base32: the hexadecimal digits as bits, five bits a letter.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
b AS (SELECT *, array_to_string(list_transform(string_split(sha1(payload), ''), lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111',
  '1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', c)]), '') AS bits FROM p),
o AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS owner FROM b)
SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(substr(bits, 5*i+1, 1) AS INT)
    + 8 * CAST(substr(bits, 5*i+2, 1) AS INT) + 4 * CAST(substr(bits, 5*i+3, 1) AS INT) + 2 * CAST(substr(bits, 5*i+4, 1) AS INT)
    + CAST(substr(bits, 5*i+5, 1) AS INT) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN owner = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN owner <> page_id THEN owner END AS refers_to FROM o"""


@query("op8_warc_zstd", WARC_SQL)
def op8(spark, sf_dir):
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


@query("op9_robust_quality")
def op9(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"))


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE place WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, cap / weight AS full_at, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
  coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM w),
l AS (SELECT (budget - capped) / free AS level FROM o WHERE full_at >= (budget - capped) / free ORDER BY full_at, source LIMIT 1),
t AS (SELECT w.*, least(cap, level * weight) AS target FROM w, l),
r AS (SELECT d.*, t.source_size, t.place, t.target,
  sum(size) OVER (PARTITION BY d.source ORDER BY k NULLS FIRST, doc_id, size ROWS UNBOUNDED PRECEDING) - size + size / 2.0::DOUBLE AS middle
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
n AS (SELECT *, CASE WHEN target > 0 THEN CAST(middle <= target AS INT) + CAST(middle + source_size <= target AS INT) ELSE 0 END AS times, middle / target AS share,
  CASE place WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS lev, CASE place WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS bend FROM r)
SELECT doc_id, source, size, source_size, target, size * times AS taken,
  CASE WHEN times > 0 THEN CAST(floor(2.0::DOUBLE * share / (lev + sqrt(lev * lev + 4.0::DOUBLE * bend * share)) * 1e6) AS BIGINT) END AS first_position FROM n"""


@query("op10_curriculum_mix", MIX_SQL)
def op10(spark, sf_dir):
    return mixing.mix_plan(table(spark, sf_dir, "documents")).drop("positions")


@query("op11_ngram_join", oracles.JOIN_SQL)
def op11(spark, sf_dir):
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


@query("op12_target_resampling", oracles.RESAMPLE_SQL)
def op12(spark, sf_dir):
    scored = resampling.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return resampling.draw(scored).select("doc_id", "n_features", "weight", "score", "rank")


@query("op13_conversation_trie", oracles.TRIE_SQL)
def op13(spark, sf_dir):
    return conv_trie.prefix_trie(table(spark, sf_dir, "conversations"))

"""The registered queries of the text operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepool.llm import decontamination, html_text, jaccard_join, language_id, license_scan as licenses, packing, quality_bayes, quality_rules, resampling, source_audit, substring_dedup, toxicity, warc
from tidepool.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.quality_rules(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op2_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_bayes.quality_bayes(docs, labels, quality_bayes.fit(docs, labels), F.col("source"), F.col("lang"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, sf_dir, "pages"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit_sources(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_quality_bayes, op3_decontamination, op4_best_fit_packing, op5_toxicity, op6_warc_revisits, op7_substring_dedup, op8_jaccard_join, op9_license_scan, op10_html_text, op11_importance_resampling, op12_language_id, op13_source_audit)}
OP6_SQL = """
with h as (select page_id, encode(coalesce(html, '')) b, sha1(coalesce(html, '')) d from pages),
g as (select d, octet_length(b) n, max(page_id) top, count(*) c from h group by 1, 2)
select page_id, octet_length(b) as payload_bytes, h.d as payload_digest,
  case when c > 1 and n >= 1000 and page_id < top then 'revisit' else 'response' end as record_type,
  case when c > 1 and n >= 1000 and page_id < top then top end as refers_to
from h join g on g.d = h.d and g.n = octet_length(h.b)"""
ORACLE = {"op6_warc_revisits": OP6_SQL, "op9_license_scan": licenses.oracle(), "op11_importance_resampling": resampling.ORACLE_SQL, "op13_source_audit": source_audit.ORACLE_SQL}

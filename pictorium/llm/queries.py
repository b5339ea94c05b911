"""The registered queries of the text operators, over whole tables, and their SQL.

``QUERIES``: name -> (run, SQL or None).  Each runs its operator with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, decontaminate, exact, hosts, licenses, lm, near, packing, quality, ranked, secrets, toxicity, urls
from .common import table

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = (run, sql)
        return run

    return add


@query("op1_secret_scan")
def op1(spark, d):
    return secrets.scan_secrets(table(spark, d, "documents"))


@query("op2_decontamination")
def op2(spark, d):
    return decontaminate.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("op3_lm_score")
def op3(spark, d):
    return lm.score_documents(table(spark, d, "documents"))


@query(
    "op4_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
      doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def op4(spark, d):
    return exact.exact_duplicates(table(spark, d, "documents"))


@query("op5_packing")
def op5(spark, d):
    return packing.pack_documents(table(spark, d, "documents"))


@query("op6_license_scan", licenses.oracle())
def op6(spark, d):
    return licenses.scan_licenses(table(spark, d, "documents"))


@query("op7_url_filter", urls.ORACLE_SQL)
def op7(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    return urls.judge_captures(urls.captures_of(pages), urls.changes_of(pages))


@query("op8_toxicity")
def op8(spark, d):
    docs = table(spark, d, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, d, "labels")))


@query("op9_quality")
def op9(spark, d):
    docs = table(spark, d, "documents")
    return quality.score_quality(docs, quality.fit(docs, table(spark, d, "labels")))


@query("op10_near_duplicates")
def op10(spark, d):
    return near.near_duplicates(table(spark, d, "documents"))


@query("op11_host_rules", hosts.oracle())
def op11(spark, d):
    return hosts.judge_hosts(table(spark, d, "documents")).drop("host", "n_lines")


@query("op13_tokenizer_alignment")
def op13(spark, d):
    return align.align_tokenizers(table(spark, d, "documents"))[0]


@query("op12_ranked_search", ranked.ORACLE_SQL)
def op12(spark, d):
    return ranked.rank_documents(table(spark, d, "documents"), table(spark, d, "benchmark"))

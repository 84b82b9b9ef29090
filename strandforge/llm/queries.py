"""One registered query for each corpus operator, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandforge.llm import decontaminate, html, language, licenses, mixing, pii, quality, runs, secrets, simhash, toxicity, url_filter
from strandforge.llm.common import ensure_checkpoint_dir


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(_read(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def _ledger(spark: SparkSession) -> str:
    """The ledger's folder: the one that the session names, which lasts, else one of this run in the shared folder."""
    ensure_checkpoint_dir(spark)
    return spark.conf.get("spark.strandforge.secret.ledger", None) or f"{spark.sparkContext.getCheckpointDir()}/secret-ledger-{uuid.uuid4().hex}"


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan_with_ledger(_read(spark, sf_dir, "documents"), _ledger(spark))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.digest(F.col("spans")), 256).alias("base_sha256"), secrets.digest(F.col("spans")).alias("spans"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_read(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_language(_read(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "n_chars", "text", "_copy")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_pii(_read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(_read(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _repeat_tail(doc_id: int | None, words: list) -> list:
    """Every tenth document (by its id's hash) repeats what follows one of its words; a null id's stays."""
    n = len(words)
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.longest_run(runs.find_runs(_read(spark, sf_dir, "documents"), rewrite=_repeat_tail))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_read(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_html_extraction, op2_decontamination, op3_secret_scan, op4_quality_rules, op5_license_scan, op6_language_id, op7_mixing, op8_pii, op9_toxicity, op10_simhash, op11_periodic_runs, op12_url_filter)
}
ORACLES: dict[str, str] = {
    "op3_secret_scan": secrets.secrets_sql(),
    "op4_quality_rules": quality.quality_sql(),
    "op5_license_scan": licenses.license_sql(),
    "op7_mixing": mixing.mix_sql(),
    "op12_url_filter": url_filter.judge_sql(),
}

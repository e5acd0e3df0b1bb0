"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, langid, line_dedup, packing, periodic, ppm, rules, simhash, sketch, toxicity, url_filter, warc
from .common import file_row, table
from .oracles import ORACLE_SQL  # noqa: F401


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("row")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.entries(spark))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.compare_neighbours(table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = line_dedup.dedup_lines(docs, file_row(docs))
    return found.select("doc_id", "n_lines", "n_removed", "text")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(found["fp"]).alias("fingerprint"), "component_id")


def op9_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", periodic.periodic_runs(periodic.planted_runs(F.col("doc_id"), F.col("text"))).alias("found"))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    milli = F.call_function("div", F.col("found.best.length") * 1000, F.col("found.best.period")).alias("exponent_milli")
    return found.select(
        "doc_id", F.size("found.runs").cast("long").alias("n_runs"), *(F.col(f"found.best.{c}").alias(c) for c in ("start", "length", "period")), milli,
        F.sha2(F.array_join(F.transform("found.runs", line), ""), 256).alias("runs_sha256"), F.sha2("found.collapsed", 256).alias("collapsed_sha256"),
    )


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    failed = F.col("failed")
    return entries.select("doc.doc_id", *(F.col(f"measures.{c}").alias(c) for c in shown), (~rules.passes(failed, "base")).alias("base_failed"), rules.passes(failed).alias("kept"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_url_filter": op2_url_filter,
    "op3_packing": op3_packing,
    "op4_sketch": op4_sketch,
    "op5_langid": op5_langid,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_simhash": op8_simhash,
    "op9_ppm": op9_ppm,
    "op10_warc": op10_warc,
    "op11_periodic": op11_periodic,
    "op12_divergence": op12_divergence,
    "op13_rules": op13_rules,
}



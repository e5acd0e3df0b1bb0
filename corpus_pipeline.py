"""Corpus pipeline: toxicity, line dedup, near dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor wrote. All but the last return the
columns of documents, whatever they are: a stage holds a row as a struct beside its name, so no column can clash with
names of its own, and columns besides doc_id and text are carried unread. Null ids are one more id that comes last,
repeated rows are rows of their own, and an empty table stays empty. Rows are named by file and place, or once in a
written table, so both sides of a stage agree on the names however a later job splits the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import decontaminate, jaccard, line_dedup, packing, toxicity
from quillmill.llm.common import file_row, stored, table


def _named(docs: DataFrame, numbered: bool = False) -> DataFrame:
    """(row, doc) with a name for each row and its columns as a struct.

    Rows of a table are named by file and place; ``numbered`` or where there is no table, by a number in a written one.
    """
    doc = F.struct(*(docs[c] for c in docs.columns)).alias("doc")
    row = None if numbered else file_row(docs)
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), doc), "named-rows") if row is None else docs.select(row.alias("row"), doc)


def _read(named: DataFrame) -> DataFrame:
    """(row, doc_id, text): what operators read of the named rows."""
    return named.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").alias("text"))


def _without(named: DataFrame, rejected: DataFrame) -> DataFrame:
    """The named rows without the rejected ones, as they were."""
    return named.join(rejected.select("row"), "row", "left_anti").select("doc.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier toxic than not go. Null and empty texts are scored as texts without passages; rows of equal texts fare alike."""
    named = _named(docs)
    return _without(named, toxicity.score_toxicity(_read(named), table(spark, sf_dir, "labels"), row=F.col("row")).where("predicted = 1"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to an earlier one go; a document that loses all its lines stays with an empty text, a null text stays null.

    Of equal rows one keeps its lines. ``n_chars``, if there is one, follows the text.
    """
    cut = line_dedup.dedup_lines(docs, file_row(docs), counts=None)
    return cut.select(*(F.length(cut["text"]).cast("long").alias("n_chars") if c == "n_chars" else cut[c] for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, five-word shingles alike to 0.8 or more, the smallest id stays, and of its repeated rows one.

    SimHash and its popcount grid, as in op8, give the first candidates, the shingles confirm them, and an exact join finds the others.
    Texts without words, null ones too, are alike; null ids come last.
    """
    named = _named(docs, numbered=True)
    found = jaccard.near_duplicates(_read(named))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("kept")).select("kept.row")
    return named.join(first, "row", "left_semi").select("doc.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten words in a row, or a whole shorter item, with the benchmark go; texts without words share none."""
    named = _named(docs)
    return _without(named, decontaminate.find_contamination(_read(named), table(spark, sf_dir, "benchmark"), row=F.col("row")).where("contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; a null text is an empty one, and each row is packed for itself."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

#: No SQL: the first stage is a trained model and the last a tokeniser; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

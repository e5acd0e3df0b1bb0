"""Incoming files: listing, routing and validation."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import js

MAX_LOGO_BYTES = 2 << 20
LOGO_TYPES = ("image/png", "image/jpeg")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_ord, name, mime, size, content) of a folder; an empty one is an error. mime is unknown to the file system.

    Files come in the order of their paths; ``read_uploads`` keeps the order of arrival.
    """
    files = spark.read.format("binaryFile").load(path)
    if files.isEmpty():
        raise ValueError("no files")
    return files.select(F.col("path").alias("file_ord"), F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(None).cast("string").alias("mime"), F.col("length").alias("size"), "content")


def read_uploads(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """(request, file_ord, name, mime, size, content) of the files that a manifest lists, by their places below a folder.

    The manifest (request, file_ord, name, mime, path) says in which order the files of a request arrived, what they
    were called and which type the sender gave; ``path`` is relative to the folder. Files may be listed more than once,
    as one that is sent twice; files that are not listed are left out, and one that is missing fails the job. A
    manifest without rows is an error. Where Spark finds the manifest small it is sent to the files, and no file is
    shuffled; without ``content`` in what is taken from here no file is opened.
    """
    if manifest.isEmpty():
        raise ValueError("no files")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    below = urlparse(folder).path.rstrip("/") + "/"
    place = F.substring("path", F.locate(below, F.col("path")) + len(below), F.length("path"))
    found = files.select(place.alias("path"), F.col("length").alias("size"), "content", F.lit(True).alias("_there"))
    listed = manifest.select("request", "file_ord", "name", "mime", "path").join(found, "path", "left")
    there = F.when(F.col("_there"), True).otherwise(F.raise_error(F.concat(F.lit("missing file "), F.col("path"))))
    return listed.where(there).select("request", "file_ord", "name", "mime", "size", "content")


def accepted(name: Column | str) -> Column:
    """The chooser's filter: .pdf, .doc and .docx in any case."""
    return js.col(name).rlike(r"(?i)\.(pdf|docx?)\z")


def is_pdf(name: Column | str, mime: Column | str) -> Column:
    """The server's routing: by type, or by a suffix in lower case."""
    return js.col(mime).eqNullSafe(F.lit("application/pdf")) | F.coalesce(F.endswith(js.col(name), F.lit(".pdf")), F.lit(False))


def looks_pdf(name: Column | str) -> Column:
    """The page's test for a PDF: the suffix in any case."""
    return F.endswith(F.lower(js.col(name)), F.lit(".pdf"))


def any_pdf(names: Column | str) -> Column:
    """Whether a list of names has one that looks like a PDF."""
    return F.exists(js.col(names), looks_pdf)


def first_pdf(names: Column | str) -> Column:
    """The first name that looks like a PDF, else NULL."""
    return F.get(F.filter(js.col(names), looks_pdf), 0)


def routed(files: DataFrame) -> DataFrame:
    """Adds accepted, pdf, looks_pdf and the extension to (name, mime)."""
    return files.select("*", accepted("name").alias("accepted"), is_pdf("name", "mime").alias("pdf"), looks_pdf("name").alias("looks_pdf"), js.extension("name").alias("ext"))


def logo_accepted(size: Column | str, mime: Column | str) -> Column:
    return (js.col(size) <= MAX_LOGO_BYTES) & js.col(mime).isin(*LOGO_TYPES)


def logo_path(user_id: Column | str, name: Column | str) -> Column:
    return F.concat(js.col(user_id), F.lit("/logo."), js.extension(name))


def _joined_parts() -> Column:
    """Aggregate: the text files with their names, in order of arrival."""
    part = F.concat(F.lit("=== "), F.col("name"), F.lit(" ===\n"), js.decode_text("content"))
    held = F.collect_list(F.when(~is_pdf("name", "mime"), F.struct("file_ord", part.alias("part"))))
    return F.array_join(F.transform(F.array_sort(held), lambda s: s["part"]), "\n\n")


def text_parts(files: DataFrame) -> DataFrame:
    """One row: all text files with their names, in order of arrival."""
    return files.agg(_joined_parts().alias("text"))


def text_parts_by_request(files: DataFrame) -> DataFrame:
    """(request, text): each request's text files with their names, in order of arrival; one without any has an empty text."""
    return files.groupBy("request").agg(_joined_parts().alias("text"))

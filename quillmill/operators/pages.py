"""Pages: chunking of long documents and selection of single pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import js

#: Pages that one request can carry.
CHUNK_PAGES = 95


def chunked(docs: DataFrame, size: int = CHUNK_PAGES) -> DataFrame:
    """A row for every chunk of a document with n_pages: chunk_ix, total_chunks, page_offset (from 1), page_end."""
    total = F.greatest(F.ceil(F.col("n_pages") / F.lit(float(size))), F.lit(1)).cast("int")
    rows = docs.withColumn("total_chunks", total).select("*", F.explode(F.sequence(F.lit(0), F.col("total_chunks") - 1)).alias("chunk_ix"))
    return rows.withColumn("page_offset", F.col("chunk_ix") * size + 1).withColumn("page_end", F.least(F.col("chunk_ix") * size + size, F.col("n_pages")).cast("int"))


def page_count(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.max("page_no").alias("n_pages"))


def requested_or_all(requested: Column | str, n: Column | str) -> Column:
    """An empty request means all pages; a document without pages has none."""
    requested, n = js.col(requested), js.col(n)
    return F.when(F.coalesce(F.size(requested), F.lit(0)) > 0, requested).when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def parse_page_list(c: Column | str) -> Column:
    """A JSON list of page numbers; NULL or nothing is the empty list."""
    return F.coalesce(F.from_json(F.coalesce(js.truthy(c), F.lit("[]")), "array<int>"), F.array().cast("array<int>"))


def select_pages(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_numbers) x (doc_id, page_no, ...): pages in the order asked for, repeats kept, others left out."""
    wanted = requests.select(*(c for c in requests.columns if c != "page_numbers"), F.posexplode("page_numbers").alias("pos", "page_no"))
    return wanted.join(pages, ["doc_id", "page_no"])


def with_shared_text(chunks: DataFrame, text: DataFrame) -> DataFrame:
    """Every chunk beside the one row of text that all of them carry."""
    return chunks.withColumn("text", text.scalar())


def with_marker(parts: Column | str, name: Column | str, n_chunks: Column | str) -> Column:
    """The text parts of a request; behind them, if a document goes as one chunk, a line that names it."""
    marker = F.concat(F.lit("=== "), js.text_or_empty(name), F.lit(" (PDF document attached above) ==="))
    return js.join(F.when(js.col(n_chunks) == 1, F.array_append(js.col(parts), marker)).otherwise(js.col(parts)), "\n\n")


def sides_downloads(roles: DataFrame, sides: DataFrame) -> DataFrame:
    """(project_id, role_ord, name) x (project_id, role_ord, url): what each role's pages are saved as."""
    return roles.join(sides, ["project_id", "role_ord"]).select("project_id", "role_ord", sides_name("name").alias("download"), "url")


def sides_name(role: Column | str) -> Column:
    return F.concat(F.lit("Sides_"), js.sanitize_each(role), F.lit(".pdf"))


def tape_name(role: Column | str) -> Column:
    return F.concat(F.lit("Self-Tape_"), js.sanitize_spaces(role), F.lit(".pdf"))


def attachment(name: Column | str) -> Column:
    """The header under which a file is sent."""
    return F.concat(F.lit('attachment; filename="'), js.col(name), F.lit('"'))


def chunk_prompt(name: Column | str, chunk_ix: Column | str, total: Column | str, offset: Column | str) -> Column:
    """What a chunk's request says about its place."""
    start = js.col(offset).cast("string")
    return F.concat(F.lit("Chunk "), (js.col(chunk_ix) + 1).cast("string"), F.lit(" of "), js.col(total).cast("string"), F.lit(" of "), js.col(name), F.lit("; its first page is page "), start)

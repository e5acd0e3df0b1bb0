"""Benchmark decontamination by winnowing, with DataFrame functions only.

Documents and benchmark items are word sequences. Of every window of six consecutive 5-grams the smallest hash
is a fingerprint, so any span of ten or more shared words shares one. Texts with a fingerprint of some item are
extended: their windows of ten words are joined with the items' windows, word for word, and the words inside
such windows are hit. Equal texts are looked at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

WINDOW, GRAM = 10, 5
PER_PRINT = WINDOW - GRAM + 1
#: Everything in ASCII that is neither a letter nor a digit parts words.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words with A-Z lower-cased; null has none."""
    lowered = lambda w: F.when(F.length(w) == F.octet_length(w), F.lower(w)).otherwise(F.translate(w, ASCII_UPPER, ASCII_LOWER))  # noqa: E731  lower() is exact, and faster, on ASCII
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != ""), lowered)


def _each(n: Column, size: int, made) -> Column:
    """made(i) for every i from 0 with i + size <= n."""
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), made)).otherwise(F.array())


def with_prints(texts: DataFrame) -> DataFrame:
    """Adds ``prints``, the winnowed fingerprints of the array ``words``."""
    hashed = texts.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    grams = hashed.withColumn("g", _each(F.size("h"), GRAM, lambda i: F.xxhash64(*(F.get("h", i + j) for j in range(GRAM)))))
    least = _each(F.size("g"), PER_PRINT, lambda i: F.least(*(F.get("g", i + j) for j in range(PER_PRINT))))
    return grams.withColumn("prints", F.array_distinct(least)).drop("h", "g")


def windows(texts: DataFrame, size: int) -> DataFrame:
    """A row (at, phrase) for every window of ``size`` words, beside the other columns."""
    held = texts.where(F.size("words") >= size)
    # the outer form, for the plain one tests the array's size in the scan, where it is computed again for each place
    return held.select(*(c for c in held.columns if c != "words"), F.posexplode_outer(F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda i: F.array_join(F.slice("words", i, size), " "))).alias("at", "phrase"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, row: Column | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and row.

    Items (item_id, text) of fewer than ten words are one window, those without words or id are ignored, and rows
    that repeat an id are one item. Null and empty texts have no words. Repeated rows of docs stay; other columns
    are ignored. Without items nothing is hit, and ``items_sha256`` is that of the empty text.
    ``row`` is carried along for callers that name rows by something else than their id.
    """
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = stored(items.distinct(), "items")
    short = [r[0] for r in items.where(F.size("words") < WINDOW).select(F.size("words")).distinct().orderBy(F.size("words")).collect()]  # nine numbers at most
    phrases = items.where(F.size("words") >= WINDOW).transform(lambda t: windows(t, WINDOW))
    for n in short:
        phrases = phrases.union(windows(items.where(F.size("words") == n), n))
    phrases = phrases.select("item_id", "phrase").distinct()

    keys = F.xxhash64("text").alias("k1"), F.xxhash64("text", F.lit(1)).alias("k2")
    texts = docs.select(F.col("doc_id"), (F.lit(None).cast("long") if row is None else row).alias("row"), *keys, words(F.col("text")).alias("words"))
    seen = stored(with_prints(texts).select("doc_id", "row", "k1", "k2", F.size("words").cast("long").alias("n_words"), "prints"), "prints")
    marked = with_prints(items.where(F.size("words") >= WINDOW)).select(F.explode_outer("prints").alias("print")).where("print is not null").distinct()
    found = seen.select("k1", "k2", F.explode("prints").alias("print")).join(marked, "print", "left_semi").select("k1", "k2").distinct()
    for n in short:  # a short item has no fingerprint: all phrases of its length are looked up
        phrase = windows(texts.select("k1", "k2", "words"), n).select("k1", "k2", "phrase").distinct()
        found = found.union(phrase.join(phrases, "phrase", "left_semi").select("k1", "k2"))
    found = found.distinct()

    # texts are shuffled as they are, and only those found are parted into words again
    held = docs.select(*keys, "text").join(found, ["k1", "k2"], "left_semi").select("k1", "k2", words(F.col("text")).alias("words"))
    spans = None
    for n in [WINDOW, *short]:
        each = windows(held, n).distinct().join(phrases, "phrase").select("k1", "k2", "at", F.lit(n).alias("size"), "item_id")
        spans = each if spans is None else spans.union(each)
    spans = stored(spans.distinct(), "spans")
    before = Window.partitionBy("k1", "k2").orderBy("at", "size").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.coalesce(F.max(F.col("at") + F.col("size")).over(before), F.lit(0))
    hit = spans.select("k1", "k2", "at", "size").distinct().withColumn("new", F.greatest(F.lit(0), F.col("at") + F.col("size") - F.greatest("at", ends)))
    hit = hit.groupBy("k1", "k2").agg(F.sum("new").alias("n_hit"))
    named = spans.groupBy("k1", "k2").agg(F.collect_set("item_id").alias("items"))
    judged = seen.select("doc_id", "row", "k1", "k2", "n_words").join(hit.join(named, ["k1", "k2"]), ["k1", "k2"], "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return judged.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(listed), ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "row")

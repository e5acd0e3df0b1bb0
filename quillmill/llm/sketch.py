"""Threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so sketches of any two texts hold
comparable samples, merge by union, and estimate containment however unequal the texts are. A text with few
shingles keeps a coarser fraction, at most all, by powers of two; two sketches are compared at the smaller of
their fractions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 5
#: The fixed fraction is 2**-LEVEL; texts keep a larger one while fewer than FEW hashes are to be expected.
LEVEL, FEW = 4, 64
#: Text per partition when neighbours by id are paired, and partitions at most.
BUCKET_BYTES, BUCKETS = 32 << 20, 10_000
CACHED_WORDS = 200_000


class Shingler:
    """Hashes of the distinct word shingles of texts; words are hashed once as long as the cache holds them."""

    def __init__(self, words: int = WORDS) -> None:
        import numpy as np
        import xxhash

        self.np, self.words, self.cache, self.digest = np, words, {}, xxhash.xxh64_intdigest
        self.factors = [np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64)) for i in range(words)]

    def _mixed(self, x):
        np = self.np
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def hashes(self, text: str):
        """Sorted and distinct; a text of fewer words is one shingle, one without words has none."""
        np = self.np
        tokens = text.encode("utf-8", "surrogatepass").lower().split()
        if not tokens:
            return np.empty(0, np.uint64)
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        for t in set(tokens).difference(self.cache):
            self.cache[t] = self.digest(t)
        h = np.fromiter(map(self.cache.__getitem__, tokens), np.uint64, len(tokens))
        size = min(self.words, len(h))
        total = np.zeros(len(h) - size + 1, np.uint64)
        for i in range(size):
            total += self._mixed(h[i : i + len(total)] + self.factors[i]) * self.factors[i]
        return np.unique(self._mixed(total))

    def sketch(self, text: str) -> tuple[int, object]:
        """(level, hashes below 2**-level of the range)."""
        hashes = self.hashes(text)
        level = min(LEVEL, max(0, int(math.log2(len(hashes) / FEW)))) if len(hashes) else 0
        return level, hashes[: self.np.searchsorted(hashes, self.np.uint64(1 << (64 - level)))] if level else hashes


def as_text(sketch) -> str:
    """``level:`` and the hashes in base64, 8 big-endian bytes each, in order."""
    import base64

    level, hashes = sketch
    return f"{level}:{base64.b64encode(hashes.astype('>u8').tobytes()).decode()}"


def from_text(text: str):
    import base64

    import numpy as np

    level, _, held = text.partition(":")
    return int(level), np.frombuffer(base64.b64decode(held), ">u8").astype(np.uint64)


def _common(a, b):
    """Both sketches at the smaller of their fractions, and how many hashes they share."""
    import numpy as np

    level = max(a[0], b[0])
    x, y = (h[: np.searchsorted(h, np.uint64(1 << (64 - level)))] if level > own else h for own, h in (a, b))
    return x, y, len(np.intersect1d(x, y, assume_unique=True))


def likeness(a, b) -> float:
    """Estimated Jaccard similarity; two empty samples are alike if both come from texts without shingles."""
    x, y, both = _common(a, b)
    union = len(x) + len(y) - both
    return both / union if union else float(len(a[1]) == len(b[1]) == 0)


def containment(a, b) -> float:
    """Estimated share of a's shingles that b has."""
    x, _, both = _common(a, b)
    return both / len(x) if len(x) else 0.0


def merged(a, b):
    """The sketch of both texts' shingles together."""
    import numpy as np

    x, y, _ = _common(a, b)
    return max(a[0], b[0]), np.union1d(x, y)


def edited(text: str, following: str) -> str:
    """text with its last third replaced by as many first code points of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, doc_id, text, carried) in descending order of ids within a bucket -> a row for each but carried ones."""
    import hashlib

    shingler = Shingler()
    kinds = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("contained_edited", pa.float64()), ("contained_next", pa.float64())])
    held = None  # the row before
    rows: list[tuple] = []

    def batched():
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
        rows.clear()
        return batch

    for batch in batches:
        for bucket, doc_id, text, carried in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            sketch = shingler.sketch(text)
            if held and held[0] == bucket and not held[3]:
                _, own_id, own_text, _, own = held
                changed = edited(own_text, text)
                other = shingler.sketch(changed)
                rows.append((own_id, len(own_text), hashlib.sha256(changed.encode()).hexdigest(), as_text(own), as_text(other), likeness(own, other), likeness(own, sketch), containment(own, other), containment(own, sketch)))
            held = bucket, doc_id, text, carried, sketch
            if len(rows) >= 1000:
                yield batched()
    if rows:
        yield batched()


def compare_neighbours(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of docs (doc_id, text) with the sketches of the text and its edited text, and how alike they are.

    ``near_...`` estimate the Jaccard similarity to the edited and the next text, ``contained_...`` the share of the
    text's own shingles that they have.

    The next document is that with the next smaller doc_id; after the last comes the first. Of rows with equal
    ids the one with the smaller text comes first, equal rows stay and follow each other, and null ids count as
    smaller than all others. Null texts are empty; a single row is its own next. An empty table gives no rows;
    other columns are ignored. Ids are cut at quantiles into buckets that are read in order, and the first row of
    each bucket is carried to the one before it, so only ids are ordered over the whole table.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    size, n = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    wanted = min(BUCKETS, n, max(1, math.ceil((size or 0) / bucket_bytes)))
    bounds = []
    if wanted > 1:
        bounds = docs.select(F.percentile_approx(key, [i / wanted for i in range(1, wanted)], 100 * wanted).alias("q")).first()[0]
        bounds = sorted(set(bounds))
    edges = docs.sparkSession.sparkContext.broadcast(bounds)  # at most BUCKETS numbers

    @F.pandas_udf("int")
    def bucket_of(ids):
        import numpy as np
        import pandas as pd

        return pd.Series(-np.searchsorted(np.array(edges.value, np.int64), ids.to_numpy(), side="right").astype(np.int32))  # descending

    placed = docs.withColumn("key", key).withColumn("bucket", bucket_of(F.col("key")))
    firsts = placed.groupBy("bucket").agg(F.max("key").alias("first")).orderBy("bucket").collect()  # at most BUCKETS rows
    if not firsts:
        return placed.select("bucket", "doc_id", "text", F.lit(False).alias("carried")).mapInArrow(_compared, _DDL)
    carry = {row["first"]: firsts[i - 1]["bucket"] for i, row in enumerate(firsts)}  # the first row of all goes to the last bucket
    shared = docs.sparkSession.sparkContext.broadcast(carry)

    @F.pandas_udf("int")
    def carried_to(ids):
        return ids.map(shared.value).astype("Int32")

    copies = placed.withColumn("to", carried_to(F.col("key")))
    own, again = F.struct(F.col("bucket"), F.lit(False).alias("carried")), F.struct(F.col("to").alias("bucket"), F.lit(True).alias("carried"))
    both = copies.select("doc_id", "key", "text", F.inline(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, again))))
    # a partition for each bucket by its number, so that no two fall together and none is empty
    ordered = both.repartitionById(len(bounds) + 1, -F.col("bucket")).sortWithinPartitions("bucket", "carried", F.desc("key"), "text")
    return ordered.select("bucket", "doc_id", "text", "carried").mapInArrow(_compared, _DDL)


_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, contained_next double"

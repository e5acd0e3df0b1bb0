"""Near duplicates by SimHash and the exact Jaccard similarity of word shingles.

A text is the set of its five-word shingles; equal word sequences collapse first. SimHash fingerprints and their
popcount grid (``simhash``) give the first candidates, which the shingles confirm. Fingerprints miss texts that are
alike to little more than 0.8, so an exact join finds the rest: the shingles of every text are
ordered by rarity, and only a prefix of each is indexed, long enough that two texts with a similarity of 0.8 or
more share one of its shingles. Lengths and positions rule out most other pairs, the shingles themselves decide.
Texts first meet the first text of each shingle; after that only texts that are not linked yet meet each other, so
a group of near copies does not cost the square of its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import stored
from .components import connected_components

SHINGLE_WORDS, SIMILARITY_PERCENT, SEED = 5, 80, 42
#: Shingles are counted in so many classes by hash; shingles of one class are ordered by their hash.
CLASSES = 1 << 18


def shingles(text: str | None) -> list[bytes]:
    """Shingles in order, with A-Z lower-cased; a shorter text is one, and one without words has none."""
    tokens = (text or "").encode().lower().split()
    if len(tokens) < SHINGLE_WORDS:
        return [b" ".join(tokens)] if tokens else []
    return list(map(b" ".join, zip(*(tokens[i:] for i in range(SHINGLE_WORDS)), strict=False)))


def similar(a: set[bytes], b: set[bytes]) -> bool:
    common = len(a & b)
    return common * 100 >= (len(a) + len(b) - common) * SIMILARITY_PERCENT


def _hashes(text: str | None):
    import numpy as np
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, SEED) for s in shingles(text)), np.uint64))


def _count_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> one row with how many texts' shingles each class has."""
    import numpy as np

    counts = np.zeros(CLASSES, np.int64)
    for batch in batches:
        found = [_hashes(t) for t in batch.column(0).to_pylist()]
        if found:
            counts += np.bincount((np.concatenate(found) % CLASSES).astype(np.int64), minlength=CLASSES)
    yield pa.RecordBatch.from_pydict({"counts": pa.array([counts], pa.list_(pa.int64()))})


def rarity_table(docs: DataFrame) -> bytes:
    """How often the shingles of each class occur, on a scale from 0 to 255; CLASSES bytes."""
    counted = docs.select("text").mapInArrow(_count_classes, "counts array<long>").select(F.posexplode("counts").alias("class", "n"))
    table = bytearray(CLASSES)
    for row in counted.groupBy("class").agg(F.least(F.lit(255), F.log2(F.sum("n") + 1) * 6).cast("int").alias("rarity")).toLocalIterator():  # CLASSES rows
        table[row["class"]] = row["rarity"]
    return bytes(table)


def _prefixes(batches: Iterator[pa.RecordBatch], table: bytes) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, text) -> (row, doc_id, key, fp, n, prefix): a digest of the words, their SimHash, the number of shingles and those indexed."""
    import numpy as np
    import xxhash

    rarity = np.frombuffer(table, np.uint8).astype(np.uint64)
    for batch in batches:
        keys, prints, sizes, prefixes = [], [], [], []
        for text in batch.column(2).to_pylist():
            hashes = _hashes(text)
            n = len(hashes)
            ranked = hashes[np.lexsort((hashes, rarity[hashes % CLASSES]))]
            keys.append(xxhash.xxh128_digest(b" ".join((text or "").encode().lower().split()), SEED))
            prints.append(simhash.fingerprint(text))
            sizes.append(n)
            prefixes.append(ranked[: n - (n * SIMILARITY_PERCENT + 99) // 100 + 1 if n else 0].view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(prints, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))], ["row", "doc_id", "key", "fp", "n", "prefix"])


def _may_agree(a: str, b: str):
    """Length and positional filter for two texts that share a shingle, their first in common, at place i of each."""
    n, i, m, j = (F.col(f"{x}.{c}") for x in (a, b) for c in ("n", "i"))
    lengths = (m * 100 >= n * SIMILARITY_PERCENT) & (n * 100 >= m * SIMILARITY_PERCENT)
    return lengths & ((F.least(n - i, m - j) + 1) * (100 + SIMILARITY_PERCENT) >= (n + m) * SIMILARITY_PERCENT)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        last, held, keep = None, set(), []
        for a, x, y in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
            if a != last:
                last, held = a, set(shingles(x))
            keep.append(similar(held, set(shingles(y))))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _similar(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of rows whose texts are similar indeed."""
    texts = pairs.join(docs.select(F.col("row").alias("a"), F.col("text").alias("x")), "a").join(docs.select(F.col("row").alias("b"), F.col("text").alias("y")), "b")
    return stored(texts.select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long"), "similar-texts")


def close_texts(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of texts (node, fp) whose fingerprints differ in three bits at most.

    Every text meets the first one of its fingerprint, and that one the earliest of those with a near fingerprint, so
    no group costs the square of its size.
    """
    firsts = stored(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    same = nodes.join(firsts, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = simhash.near_pairs(firsts).join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    near = near.groupBy(F.greatest("x", "y").alias("b")).agg(F.min(F.least("x", "y")).alias("a"))
    return same.union(near.select("a", "b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(row, doc_id, root) for docs (row, doc_id, text) with distinct rows: texts in reach of each other share a root.

    Texts are linked at a Jaccard similarity of 0.8 or more; texts without words are alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rarity_table(docs))  # CLASSES bytes
    prefixes = stored(docs.select("row", "doc_id", "text").mapInArrow(lambda b: _prefixes(b, shared.value), "row long, doc_id long, key binary, fp long, n long, prefix array<long>"), "text-prefixes")
    nodes = stored(prefixes.groupBy("key").agg(F.min("row").alias("node"), F.first("fp").alias("fp")), "texts")  # equal words have equal fingerprints
    close = stored(close_texts(nodes), "close-texts")
    links = _similar(close, docs)

    entries = prefixes.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").select("row", "n", F.posexplode("prefix").alias("i", "h"))
    index = entries.select("h", F.struct("row", "n", (F.col("i") + 1).alias("i")).alias("a")).repartition("h")
    first = index.groupBy("h").agg(F.min("a").alias("first"), F.count("*").alias("texts")).where("texts > 1").drop("texts")
    index = stored(index.join(first, "h"), "shared-shingles")
    ahead = index.where((F.col("first.row") < F.col("a.row")) & _may_agree("a", "first")).select(F.col("first.row").alias("a"), F.col("a.row").alias("b")).distinct()
    ahead = stored(ahead.join(close, ["a", "b"], "left_anti"), "first-pairs")
    links = links.union(_similar(ahead, docs))

    root = connected_components(links)
    placed = stored(index.select("h", "a").withColumn("row", F.col("a.row")).join(root.withColumnRenamed("node", "row"), "row", "left").select("h", "a", F.coalesce("root", "row").alias("root")), "placed-shingles")
    other = placed.select("h", F.col("a").alias("b"), F.col("root").alias("b_root"))
    more = placed.join(other, "h").where((F.col("a.row") < F.col("b.row")) & (F.col("root") != F.col("b_root")) & _may_agree("a", "b"))
    more = more.select(F.col("a.row").alias("a"), F.col("b.row").alias("b")).distinct().join(ahead.union(close), ["a", "b"], "left_anti")
    root = connected_components(links.union(_similar(more, docs)))
    rooted = nodes.join(root, "node", "left").select("key", F.coalesce("root", "node").alias("root"))
    return prefixes.select("row", "doc_id", "key").join(rooted, "key").select("row", "doc_id", "root")

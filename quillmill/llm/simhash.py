"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint is cut into 32 segments of two bits; the vector of their popcounts is its place in a grid. The
Manhattan distance of two places never exceeds the Hamming distance of the fingerprints, and if it is at most
3, one half of the vector is at distance 0 or 1. So each half is a grid of its own: every fingerprint is stored
in its cell and looks up its cell and those one step above. What the grids find is checked against the
Manhattan bound and then exactly. Copies are one fingerprint throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import connected_components

SHINGLE_WORDS, MAX_DISTANCE, SEED = 3, 3, 42
HALF = 16
_ODD = 0x5555555555555555


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Signed 64 bits; a bit is set if over half of the shingles' hashes set it."""
    import numpy as np
    import xxhash

    digest, tokens = xxhash.xxh64_intdigest, (text or "").encode().lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = iter([b" ".join(tokens)])
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    hashes = np.fromiter((digest(s, seed) for s in shingles), np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([fingerprint(t, words) for t in batch.column(2).to_pylist()], pa.int64())], ["doc_id", "row", "fp"])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, row: Column | None = None) -> DataFrame:
    """(doc_id, row, fp) for every row of docs."""
    row = (F.lit(None) if row is None else row).cast("long").alias("row")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row, "text").mapInArrow(lambda b: _fingerprints(b, words), "doc_id long, row long, fp long")


def embedding(fp: Column) -> Column:
    """The 32 popcounts in unary, two bits each: the xor of two has as many bits as their Manhattan distance."""
    low, high = fp.bitwiseAND(F.lit(_ODD)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_ODD))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def near_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints in column ``fp`` that differ in 1 to 3 bits, each once."""
    placed = nodes.select("fp", embedding(F.col("fp")).alias("u"))
    cells = placed.select("fp", F.posexplode(F.array(F.col("u").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("u", 32))).alias("half", "cell"))
    stored_in = cells.select("half", "cell", F.col("fp").alias("b"))
    steps = [F.when(F.shiftrightunsigned("cell", 2 * i).bitwiseAND(F.lit(3)) == 0, F.col("cell").bitwiseOR(F.lit(1 << 2 * i))).when(F.shiftrightunsigned("cell", 2 * i).bitwiseAND(F.lit(3)) == 1, F.col("cell").bitwiseOR(F.lit(2 << 2 * i))) for i in range(HALF)]
    looked_up = cells.select("half", F.col("fp").alias("a"), F.col("cell").alias("own"), F.explode(F.array_compact(F.array(F.col("cell"), *steps))).alias("cell"))
    a, b = embedding(F.col("a")), embedding(F.col("b"))
    apart = a.bitwiseXOR(b)
    found = looked_up.join(stored_in, ["half", "cell"]).where((F.col("own") != F.col("cell")) | (F.col("a") < F.col("b")))
    found = found.where((F.col("half") == 0) | (F.bit_count(apart.bitwiseAND(F.lit(0xFFFFFFFF))) > 1))  # the lower half has found it already
    return found.where((F.bit_count(apart) <= MAX_DISTANCE) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE)).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, row: Column | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, fp, component_id, and row.

    Fingerprints are linked at 3 or fewer differing bits, and ``component_id`` is the smallest doc_id in reach.
    Null and empty texts have fingerprint zero, which is linked like any other. A null doc_id never names a
    component; where all ids in reach are null, so is ``component_id``. Repeated rows stay; other columns are
    ignored. ``row`` is carried along for callers that name rows by something else than their id.
    """
    prints = stored(fingerprints(docs, words, row), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("doc"))
    linked = connected_components(near_pairs(nodes))
    rooted = nodes.join(linked, nodes["fp"] == linked["node"], "left").select("fp", "doc", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id", "row")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")

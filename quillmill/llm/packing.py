"""Hierarchical multi-length packing of token sequences.

Documents are tokenised once. Blocks of the longest window are sequences of their own; what is left of a
document is routed to the smallest context tier that holds it. Inside a packing group each tier is packed from
the longest to the shortest: the longest remainder opens a window, the gap is filled with the best fitting
remainders of shorter tiers, and when none fits the next one is cut, so windows are full. The last, partly
filled window of a group is cut at powers of two, so it needs no padding either. Sequences of a tier are dealt
to step groups that hold equally many tokens.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import file_row, stored

TIERS = (256, 512, 1024, 2048, 4096)
GROUP_BYTES = 32 << 20
STEP_TOKENS = 16 * 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: Chunks in each generation of a worker's cache, words encoded in one call.
CACHED_CHUNKS, TOGETHER = 400_000, 500

_PARTS = pa.schema([("grp", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
_PARTS_DDL = "grp long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
_PACKED_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, grp long, nth long"
#: Groups whose sequences are dealt to steps together, at most.
STEP_GROUPS = 1024


#: A word of Latin letters with ASCII punctuation behind it; the vocabulary's patterns always part the two.
WORD = r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)"


def encoder(tokenizer: str = TOKENIZER):
    """text -> ids as little-endian unsigned 32-bit bytes, with the end id.

    The vocabulary's patterns never cross a space or a line feed, so texts are cut there and each chunk is
    encoded once as long as a bounded cache holds it; chunks of letters share what the cache has of the word in
    lower case. The cache has a young and an old generation and lives as long as the worker process.
    """
    import os
    import re
    import sys
    import types

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    kept = sys.modules.setdefault("quillmill_worker_cache", types.ModuleType("quillmill_worker_cache")).__dict__
    model, young, old = kept.get(tokenizer) or (Tokenizer.from_file(tokenizer if os.path.isabs(tokenizer) else public_tokenizers.path(tokenizer)), {"": b""}, {})
    word, end = re.compile(WORD).fullmatch, np.array([END_ID], "<u4").tobytes()

    def together(words: list[str]) -> list[bytes] | None:
        """Each word's ids from one call, or None if the vocabulary's patterns part them in another way."""
        e = model.encode(" ".join(words), add_special_tokens=False)
        ends = (4 * (np.flatnonzero(np.diff(e.word_ids)) + 1)).tolist()
        ids = np.array(e.ids, "<u4").tobytes()
        return [ids[a:b] for a, b in zip([0, *ends], [*ends, len(ids)], strict=True)] if len(ends) == len(words) - 1 else None

    def learn(chunks: set[str]) -> None:
        found, split, new = old.get, {}, {}
        for x in chunks:
            if (ids := found(x)) is not None:
                young[x] = ids
            elif m := word(x):
                parts = split[x] = m[1].lower(), m[2]
                new |= {p: None for p in parts if p not in young}
            else:
                new[x] = None
        letters, unknown = [], []
        for x in new:
            if (ids := found(x)) is not None:
                young[x] = ids
            else:
                (letters if x.isalpha() else unknown).append(x)
        for at in range(0, len(letters), TOGETHER):
            some = letters[at : at + TOGETHER]
            if (ids := together(some)) is None:
                unknown += some
            else:
                young.update(zip(some, ids, strict=True))
        for x, e in zip(unknown, model.encode_batch_fast(unknown, add_special_tokens=False), strict=True):
            young[x] = np.array(e.ids, "<u4").tobytes()
        for x, (letters, rest) in split.items():
            young[x] = young[letters] + young[rest]

    def encode(text: str | None) -> bytes:
        nonlocal young, old
        if len(young) > CACHED_CHUNKS:
            young, old = {"": b""}, young
        chunks = (text or "").replace("\n", " ").split(" ")
        if new := set(chunks).difference(young):
            learn(new)
        kept[tokenizer] = model, young, old
        return b"".join(map(young.__getitem__, chunks)) + end

    return encode


def tokenized_parts(batches: Iterator[pa.RecordBatch], tokenizer: str, window: int) -> Iterator[pa.RecordBatch]:
    """Rows (grp, doc_id, text) to parts: blocks of a whole window without ids, and the remainder with them."""
    import zlib

    encode, width = encoder(tokenizer), 4 * window
    for batch in batches:
        rows, size = [], 0
        for grp, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            ids = encode(text)
            total = len(ids) // 4
            whole = len(ids) // width * width
            rows += [(grp, doc_id, a // 4, window, zlib.crc32(memoryview(ids)[a : a + width]), total, None) for a in range(0, whole, width)]
            if whole < len(ids):
                rows.append((grp, doc_id, whole // 4, total - whole // 4, None, total, ids[whole:]))
                size += len(ids) - whole
            if size > 8 << 20 or len(rows) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PARTS, strict=True)], schema=_PARTS)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PARTS, strict=True)], schema=_PARTS)


def pack(lengths: list[int], tiers: tuple[int, ...]) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (index, begin, length) over items no longer than the longest tier.

    All windows hold exactly a tier's or, for the last few, a power of two tokens.
    """
    pool = sorted((n, i, 0) for i, n in enumerate(lengths) if n)
    windows = []
    while pool:
        n, i, begin = pool.pop()
        gap = tiers[bisect_left(tiers, n)] - n
        held = [(i, begin, n)]
        while gap and pool:
            at = bisect_right(pool, (gap, math.inf)) - 1
            if at >= 0:
                n, i, begin = pool.pop(at)
            else:
                rest, i, begin = pool.pop(0)
                n = gap
                insort(pool, (rest - gap, i, begin + gap))
            held.append((i, begin, n))
            gap -= n
        windows += [held] if not gap else _powers(held)
    return windows


def _powers(held: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Cuts one window into windows whose sizes are the powers of two that sum to its size."""
    total = sum(n for _, _, n in held)
    windows, queue = [], held[::-1]
    for size in (1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1):
        window = []
        while size:
            i, begin, n = queue.pop()
            taken = min(n, size)
            if taken < n:
                queue.append((i, begin + taken, n - taken))
            window.append((i, begin, taken))
            size -= taken
        windows.append(window)
    return windows


def pack_group(parts: pd.DataFrame, tiers: tuple[int, ...]) -> pd.DataFrame:
    """One packing group; its size is bounded by GROUP_BYTES of text on average. ``nth`` numbers its sequences of each size."""
    import zlib

    parts = parts.sort_values(["doc_id", "doc_tokens", "start", "ids_crc32"], kind="stable", ignore_index=True)
    blocks, rest = parts[parts["ids"].isna()], parts[parts["ids"].notna()].reset_index(drop=True)
    grp = int(parts["grp"].iloc[0])
    sequences = [[(d, s, n, int(c), t)] for d, s, n, c, t in blocks[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False)]
    doc_id, start, total, ids = (rest[c].tolist() for c in ("doc_id", "start", "doc_tokens", "ids"))
    for window in pack(rest["length"].tolist(), tiers):
        sequences.append([(doc_id[i], start[i] + b, n, zlib.crc32(memoryview(ids[i])[4 * b : 4 * (b + n)]), total[i]) for i, b, n in window])
    out, dealt = [], {}
    for number, pieces in enumerate(sequences):
        size = sum(p[2] for p in pieces)
        nth = dealt.get(size, 0)
        dealt[size] = nth + 1
        offset = 0
        for d, s, n, c, t in pieces:
            out.append((d, s, n, c, t, (grp << 32) + number, offset, size, grp, nth))
            offset += n
    frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "grp", "nth"])
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    return frame


def with_steps(packed: DataFrame, step_tokens: int, step_groups: int = STEP_GROUPS) -> DataFrame:
    """packed with ``step_group`` in place of ``grp`` and ``nth``.

    Sequences of one size are dealt to as few steps as hold them at ``step_tokens`` a step, and these differ by one
    sequence at most. That is done for ``step_groups`` packing groups at a time, so a window sees that many rows.
    """
    share = F.floor(F.col("grp") / F.lit(step_groups)).alias("share")
    sizes = packed.where("offset = 0").groupBy("tier", share, "grp").agg(F.count("*").alias("n"))
    all_groups = Window.partitionBy("tier", "share")
    before = F.coalesce(F.sum("n").over(all_groups.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = sizes.select("tier", "grp", "share", before.alias("before"), F.sum("n").over(all_groups).alias("all"))
    a_step = F.greatest(F.lit(1), F.floor(F.lit(step_tokens) / F.col("tier")))
    step = F.floor((F.col("before") + F.col("nth")) * F.ceil(F.col("all") / a_step) / F.col("all"))
    group = F.shiftleft("share", 40) + F.shiftleft(F.round(F.log2("tier")).cast("long"), 32) + step
    return packed.join(dealt, ["tier", "grp"]).select(*(c for c in packed.columns if c not in ("grp", "nth")), group.cast("long").alias("step_group"))


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, tiers: tuple[int, ...] = TIERS, group_bytes: int = GROUP_BYTES, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Packs (doc_id, text) into sequences of at most the longest tier; one row per piece.

    Null and empty texts hold the end id alone; a null doc_id is kept. Repeated rows are packed each for
    itself. An empty table gives no rows. Other columns of docs are ignored. Groups are dealt by a hash of id,
    text and row, and their number follows the bytes of text, so none grows with the corpus, nor do copies of a row
    meet in one; ``sequence_id`` is unique over all groups, ``tier`` is the sequence's size, and sequences with the
    same ``step_group`` have one size and form a step of at most ``step_tokens`` tokens.
    """
    row = file_row(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), (F.monotonically_increasing_id() if row is None else row).alias("row"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, math.ceil(total / group_bytes))
    grp = F.pmod(F.xxhash64("doc_id", "text", "row"), F.lit(groups)).alias("grp")
    window = max(tiers)
    parts = docs.select(grp, "doc_id", "text").mapInArrow(lambda b: tokenized_parts(b, tokenizer, window), _PARTS_DDL)
    packed = stored(parts.groupBy("grp").applyInPandas(lambda g: pack_group(g, tiers), _PACKED_DDL), "packed")
    return with_steps(packed, step_tokens)

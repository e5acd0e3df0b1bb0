"""Toxic passages by maximum-scoring segments.

Tokens get log-odds of the toxic against the clean class with an informative Dirichlet prior; a token that the
labels don't know falls back on the log-odds of its first letters. Tokens without evidence cost a little, so
all maximal segments of a text, found in one linear scan, are its toxic passages. Their scores follow an
extreme-value law over clean text: a segment counts with what it has beyond the score that a clean text of this
length reaches by chance, and a logistic curve over the sum of these gives the probability.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, stored

#: Strength of the prior in documents, share of listed tokens that a toxic passage is taken to have, evidence
#: in standard deviations and least log-odds that list a token, tokens listed at most, letters of the fallback.
PRIOR, DENSITY, EVIDENCE, LEAST, LISTED, STEM = 50.0, 0.2, 2.5, 2.0, 50_000, 5
#: Labelled documents that the logistic curve is fitted to, at most.
CURVE_ROWS = 20_000
COUNTED = 200_000
TOKEN = r"[^\W_]+"
FOLDS, HELD_OUT = 5, 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) -> documents of each class that hold a token or, with a trailing star, a stem."""
    import re

    find = re.compile(TOKEN).findall
    counts = (Counter(), Counter())

    def out():
        both = list(counts[0].keys() | counts[1].keys())
        batch = pa.RecordBatch.from_pydict({"token": pa.array(both, pa.string()), "clean": pa.array([counts[0][t] for t in both], pa.int64()), "toxic": pa.array([counts[1][t] for t in both], pa.int64())})
        counts[0].clear(), counts[1].clear()
        return batch

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tokens = set(find((text or "").lower()))
            counts[toxic].update(tokens)
            counts[toxic].update({t[:STEM] + "*" for t in tokens if len(t) >= STEM})
            if len(counts[0]) + len(counts[1]) > COUNTED:
                yield out()
    if counts[0] or counts[1]:
        yield out()


def log_odds(counts: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """(token, clean, toxic) -> weight and its deviation; the prior follows the token's share of all documents."""
    alpha = F.lit(PRIOR) * (F.col("toxic") + F.col("clean")) / F.lit(max(1, n_toxic + n_clean))
    t, c = F.col("toxic") + alpha, F.col("clean") + alpha
    weight = F.log(t / (F.lit(n_toxic + PRIOR) - t + F.lit(1.0))) - F.log(c / (F.lit(n_clean + PRIOR) - c + F.lit(1.0)))
    return counts.select("token", "clean", "toxic", weight.alias("weight"), (weight / F.sqrt(1 / t + 1 / c)).alias("z"), (c / F.lit(n_clean + PRIOR)).alias("share"))


def segments(positions: list[int], weights: list[float], gap: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score) of a sequence, in linear time.

    Only positive positions are given; each position between two of them scores ``gap`` < 0.
    """
    kept: list[tuple[float, float, int, int]] = []  # sum before, sum after, begin, end
    total, last = 0.0, -1
    for at, weight in zip(positions, weights, strict=True):
        total += gap * (at - last - 1)
        before, total, begin, last = total, total + weight, at, at
        while True:
            k = len(kept) - 1
            while k >= 0 and kept[k][0] >= before:
                k -= 1
            if k < 0 or kept[k][1] >= total:
                kept.append((before, total, begin, at))
                break
            before, begin = kept[k][0], kept[k][2]
            del kept[k:]
    return [(b, e + 1, y - x) for x, y, b, e in kept]


def _decay(weights: list[tuple[float, float]], gap: float) -> float:
    """lambda > 0 with sum p exp(lambda s) = 1 over clean text."""
    listed = sum(p for _, p in weights)
    value = lambda x: sum(p * math.exp(min(x * s, 500.0)) for s, p in weights) + max(0.0, 1 - listed) * math.exp(x * gap) - 1
    low, high = 0.0, 1.0
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def _scan(batches: Iterator[pa.RecordBatch], weights: dict[str, float], gap: float, decay: float) -> Iterator[pa.RecordBatch]:
    """(text, row, doc_id) -> the segments' scores in nats, and where the best lies."""
    import re

    find, listed, stem_of = re.compile(TOKEN).findall, weights.get, STEM
    seen: dict[str, float] = {}
    kinds = pa.schema([("n_tokens", pa.int64()), ("scores", pa.list_(pa.float64())), ("best_begin", pa.int64()), ("best_end", pa.int64())])
    for batch in batches:
        rows = []
        for text in batch.column(0).to_pylist():
            tokens = find((text or "").lower())
            distinct = set(tokens)
            if len(seen) > COUNTED:
                seen.clear()
            for t in distinct.difference(seen):
                w = listed(t)
                seen[t] = listed(t[:stem_of] + "*", 0.0) if w is None and len(t) >= stem_of else w or 0.0
            hits = {t: w for t in distinct if (w := seen[t]) > 0}
            scored = [(i, hits[t]) for i, t in enumerate(tokens) if t in hits] if hits else []
            found = segments([i for i, _ in scored], [w for _, w in scored], gap)
            best = max(found, key=lambda s: s[2], default=(None, None, 0.0))
            rows.append((len(tokens), [decay * s for _, _, s in found], best[0], best[1]))
        made = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *made], ["row", "doc_id", *kinds.names])


def _curve(rows: list[tuple[float, int]]) -> tuple[float, float]:
    """Slope and intercept of P(toxic) = 1 / (1 + exp(-(slope x + intercept))), by Newton steps that never raise the loss."""
    import numpy as np

    x, y = (np.array(c, float) for c in zip(*rows, strict=True))
    design, w = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    ridge = 1e-2
    loss = lambda v: np.logaddexp(0, design @ v).sum() - y @ (design @ v) + ridge / 2 * v @ v
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        down = design.T @ (p - y) + ridge * w
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge * np.eye(2), down)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):  # Newton steps overshoot where classes part well
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(max(w[0], 0.0)), float(w[1])


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, row: Column | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, score, predicted, its passages, and row.

    Learns from labels (doc_id, toxic) of documents whose crc32 of the id leaves another remainder than
    ``held_out``; rows with a null label or id teach nothing, and of several labels of an id the largest counts. Null and
    empty texts get the score of a text without passages. Without labels, or with one class only, no token is
    listed and all scores are the smoothed share of toxic labels. Repeated rows stay; other columns are ignored.
    ``row`` is carried along for callers that name rows by something else than their id.
    ``n_segments`` passages lie beyond chance, the best from token ``best_begin`` up to ``best_end``.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.lit(None).cast("long") if row is None else row).alias("row"))
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.where(id_remainder(F.col("doc_id"), folds) != held_out)
    # merged by id whatever the sizes, so the plan is the same at every scale
    taught = docs.where(id_remainder(F.col("doc_id"), folds) != held_out)
    counted = taught.join(known.hint("merge"), "doc_id").select("text", "toxic").mapInArrow(_count, "token string, clean long, toxic long")
    counts = stored(counted.groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "token-counts")
    sizes = {r[0]: r[1] for r in docs.select("doc_id").join(known, "doc_id").groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)

    odds = log_odds(counts, n_toxic, n_clean)
    top = odds.where((F.col("weight") >= LEAST) & (F.col("z") >= EVIDENCE)).orderBy(F.desc("z"), "token").limit(LISTED).collect() if n_toxic and n_clean else []
    weights = {r["token"]: r["weight"] for r in top}
    stems = [t for t in weights if t.endswith("*")]
    if stems:  # words that the labels know to be clean don't fall back on their stem
        own = odds.where((F.col("weight") <= 0) & (F.length("token") >= STEM) & ~F.col("token").endswith("*"))
        own = own.join(spark.createDataFrame([(t,) for t in stems], "stem string"), F.concat(F.substring("token", 1, STEM), F.lit("*")) == F.col("stem"), "left_semi")
        weights |= {r["token"]: 0.0 for r in own.orderBy(F.desc("clean"), "token").limit(LISTED).select("token").collect()}
    gap = math.log(1 - DENSITY)
    decay = _decay([(r["weight"], r["share"] * 1e-2) for r in top if not r["token"].endswith("*")], gap) if top else 1.0
    shared = spark.sparkContext.broadcast(weights)  # at most twice LISTED tokens
    scanned = stored(docs.select("text", "row", "doc_id").mapInArrow(lambda b: _scan(b, shared.value, gap, decay), f"row {docs.schema['row'].dataType.simpleString()}, doc_id long, n_tokens long, scores array<double>, best_begin long, best_end long"), "segments")

    # K of the extreme-value law E(segments >= s) = K n exp(-s), from the clean documents; s in nats
    clean = scanned.join(known.where("toxic = 0"), "doc_id")
    n_tokens, beyond = clean.agg(F.sum("n_tokens"), F.sum(F.size(F.filter("scores", lambda s: s >= 2.0)))).first()
    log_k = math.log((1 + (beyond or 0)) * math.exp(2.0) / (1000 + (n_tokens or 0)))
    chance = F.lit(log_k) + F.log(F.col("n_tokens") + F.lit(1))
    beyond = F.filter(F.transform("scores", lambda s: s - chance), lambda s: s > 0)
    x = F.log1p(F.aggregate(beyond, F.lit(0.0), lambda total, s: total + s))
    judged = scanned.select("row", "doc_id", x.alias("x"), F.size(beyond).alias("n_segments"), "best_begin", "best_end")
    sample = judged.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").select("x", "toxic").limit(CURVE_ROWS).collect()
    slope, intercept = _curve([tuple(r) for r in sample]) if n_toxic and n_clean else (0.0, math.log((n_toxic + 0.5) / (n_clean + 1.5)))
    score = 1 / (1 + F.exp(-(F.lit(slope) * F.col("x") + F.lit(intercept))))
    held = id_remainder(F.col("doc_id"), folds) == held_out
    return judged.select("doc_id", held.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "n_segments", "best_begin", "best_end", "row")

"""Divergence of the sources of each language, by tiles of sources and terms.

Tasks count the terms of their documents by language and source, in dictionaries of bounded size, before anything is
shuffled. The terms that stay are dealt to shards, the sources of a language to stripes. A tile is two stripes and a
shard: dense int64 matrices of sources by terms, from which numpy broadcasting takes all pairs of sources, a block of
terms at a time. Tiles give partial sums of pairs, which are added, and the best terms of each source, a short heap,
which are merged. So no task holds more than a tile, however many terms, sources or documents there are.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, stored

LEAST_DOCUMENTS = 10
TOP_TERMS = 10
#: Terms of a shard and sources of a stripe, on average.
SHARD, STRIPE = 4096, 48
#: Pairs times terms that numpy broadcasts at once.
CELLS = 1 << 20
#: Counters of a task are handed over when they have so many entries.
HELD = 500_000
#: What a count is scaled to.
SCALE_STEP, SCALE_STEPS = 1000, 3
#: Bytes that belong to terms, lower-cased; all others part them.
_TERM_BYTES = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_COUNTS = "lang binary, source binary, term binary, n long, docs long"


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial (lang, source, term, n, docs) of a task; each group has an entry without a term as well."""
    counts: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def entries():
        rows = [(*group, term, n[term], docs[term]) for group, (n, docs) in counts.items() for term in n]
        rows += [(*group, None, 0, 0) for group in counts]
        columns = zip(*rows, strict=True)
        kinds = (pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["lang", "source", "term", "n", "docs"])

    held = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(i) for i in range(3)), strict=True):
            n, docs = counts[lang.as_py(), source.as_py()]
            held -= len(n)
            own = Counter(text.as_py().translate(_TERM_BYTES).split())
            n.update(own)
            docs.update(own.keys())
            held += len(n)
            if held > HELD:
                yield entries()
                counts.clear()
                held = 0
    if counts:
        yield entries()


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group, as bytes.

    Every group of docs has a row without a term.
    """
    part = lambda c: F.coalesce(docs[c].cast("string"), F.lit("")).cast("binary").alias(c)
    counted = docs.select(part("lang"), part("source"), part("text")).mapInArrow(_count_terms, _COUNTS)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def scaled(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10 ** 9 * count / total) in steps of a thousand, exact as long as total stays below 9 * 10 ** 15."""
    share, rest = np.zeros(np.broadcast(count, total).shape, np.int64), count
    for _ in range(SCALE_STEPS):
        rest = rest * SCALE_STEP
        share = share * SCALE_STEP + rest // total
        rest = rest % total
    return share + 1


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _pair_sums(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The distances of all rows of p to all rows of q, summed over terms."""
    sums, step = np.zeros((len(p), len(q)), np.int64), max(1, CELLS // (len(p) * len(q)))
    for at in range(0, p.shape[1], step):
        sums += _distance(p[:, None, at : at + step], q[None, :, at : at + step]).sum(2)
    return sums


_TILE = "lang binary, source binary, part string, item binary, value long"


def _tile(key: tuple, rows: pa.Table, top: int) -> pa.Table:
    """Partial sums of the pairs of sources in stripes a and b, and the best terms of the sources in a, if b is a.

    Rows with a term hold its count, those without one a source of the tile with its sum of counts.
    """
    a, b = key[2].as_py(), key[3].as_py()
    heads = rows.filter(rows["term"].is_null())
    entries = rows.filter(rows["term"].is_valid())
    lang, kept, terms_here = key[0].as_py(), heads["kept"][0].as_py(), heads["terms_here"][0].as_py()
    sources = {stripe: [] for stripe in (a, b)}
    sums = {}
    for source, stripe, total in zip(heads["source"].to_pylist(), heads["stripe"].to_pylist(), heads["group_n"].to_pylist(), strict=True):
        sources[stripe].append(source)
        sums[source] = total
    found: list[tuple] = []
    coded = entries["term"].combine_chunks().dictionary_encode()
    terms, at = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    seen, total_terms = len(terms), 2 * kept
    matrices, counts = {}, {}
    row = {stripe: {s: i for i, s in enumerate(names)} for stripe, names in sources.items()}
    stripes, names, n = entries["stripe"].to_numpy(), entries["source"].to_pylist(), entries["n"].to_numpy()
    for stripe in {a, b}:
        mine = np.flatnonzero(stripes == stripe)
        counts[stripe] = np.zeros((len(sources[stripe]), seen), np.int64)
        counts[stripe][np.fromiter((row[stripe][names[i]] for i in mine), np.int64, len(mine)), at[mine]] = n[mine]
        totals = np.array([sums[s] for s in sources[stripe]], np.int64)[:, None] + total_terms
        # a last column for a term that no source of the tile has
        matrices[stripe] = scaled(np.hstack([counts[stripe], np.zeros((len(totals), 1), np.int64)]) + 2, totals) if kept else np.ones((len(totals), 1), np.int64)
    p, q = matrices[a], matrices[b]
    if len(p) and len(q):
        pairs = _pair_sums(p[:, :-1], q[:, :-1]) + (terms_here - seen) * _distance(p[:, None, -1], q[None, :, -1])
        for i, x in enumerate(sources[a]):
            for j, y in enumerate(sources[b]):
                if a != b or i < j:
                    found += [(lang, x, "pair", y, int(pairs[i, j])), (lang, y, "pair", x, int(pairs[i, j]))]
    if a == b and seen:
        whole = np.zeros(seen, np.int64)
        whole[at] = entries["lang_n"].to_numpy()
        language = scaled(whole + 2, heads["lang_total"][0].as_py() + total_terms)
        gain = np.where((counts[a] > 0) & (p[:, :-1] > language), _distance(p[:, :-1], language), -1)
        for i, x in enumerate(sources[a]):
            best = heapq.nsmallest(top, ((-int(gain[i, t]), terms[t]) for t in np.flatnonzero(gain[i] >= 0)))
            found += [(lang, x, "term", term, -value) for value, term in best]
    columns = list(zip(*found, strict=True)) or [[]] * 5
    kinds = (pa.binary(), pa.binary(), pa.string(), pa.binary(), pa.int64())
    return pa.Table.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["lang", "source", "part", "item", "value"])


def source_divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, shard: int = SHARD, stripe: int = STRIPE) -> DataFrame:
    """(lang, source, part, item, value, rank) for each (lang, source) of docs (text, lang, source).

    Each language keeps the terms, runs of letters and characters beyond ASCII with A-Z lower-cased, of at least
    ``least_documents`` of its rows. A source gives each kept term 1 + floor(10^9 (count + 2) / (N + 2 V)), N its sum
    of counts and V the number of kept terms; two values p and q differ by floor((p - q)^2 / (p + q)). Part ``pair``
    sums that over all kept terms for each other source of the language, part ``term`` has the ``top`` terms that the
    source has more of than its language, by the difference from the language. Ranks begin at 1, ties go by the
    bytes of the item. All numbers are exact.

    NULL text, lang and source count as ''. A group without kept terms is compared like others; without any kept term
    all values of its language are 0. Equal rows count as often as they stand there, null ids and other columns do
    not matter, a lone source has no pairs, and an empty table gives no rows.
    """
    counts = stored(count_terms(docs), "term-counts")
    here = counts.where("term is not null")
    vocabulary = here.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least_documents).drop("docs")
    vocabulary = stored(vocabulary, "vocabulary")
    groups = counts.where("term is null").select("lang", "source")
    languages = groups.groupBy("lang").agg(F.count("*").alias("groups")).join(vocabulary.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total")), "lang", "left").na.fill(0)
    parts = lambda n, size: F.greatest(F.lit(1), F.ceil(n / F.lit(size))).cast("int")
    languages = stored(languages.withColumn("shards", parts(F.col("kept"), shard)).withColumn("stripes", parts(F.col("groups"), stripe)), "languages")  # of known size, so Spark sends it to the terms if it is small
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    placed = vocabulary.join(languages.select("lang", "shards"), "lang").withColumn("shard", deal("term", "shards"))
    sized = placed.groupBy("lang", "shard").agg(F.count("*").alias("terms_here"))
    entries = here.select("lang", "source", "term", "n").join(placed, ["lang", "term"])
    entries = stored(entries.join(languages.select("lang", "stripes"), "lang").select("lang", "source", "term", "n", "lang_n", "shard", "stripes", deal("source", "stripes").alias("stripe")), "kept-counts")
    sums = entries.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    each = groups.join(sums, ["lang", "source"], "left").join(languages, "lang").select("lang", "source", F.coalesce("group_n", F.lit(0)).alias("group_n"), "kept", "lang_total", "stripes", deal("source", "stripes").alias("stripe"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    heads = each.join(sized, ["lang", "shard"], "left").withColumn("terms_here", F.coalesce("terms_here", F.lit(0)))
    rows = heads.unionByName(entries, allowMissingColumns=True)
    other = F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)).alias("other")
    tiles = rows.select("*", other).select("*", F.least("stripe", "other").alias("a"), F.greatest("stripe", "other").alias("b"))
    partial = tiles.groupBy("lang", "shard", "a", "b").applyInArrow(lambda key, table: _tile(key, table, top), _TILE)
    partial = partial.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))  # a term has one shard, a pair all of them
    best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = partial.withColumn("rank", F.row_number().over(best)).where((F.col("part") == "pair") | (F.col("rank") <= top))
    text = lambda c: F.col(c).cast("string").alias(c)
    found = stored(ranked.select(text("lang"), text("source"), "part", text("item"), "value", "rank"), "divergence")
    for table in (counts, vocabulary, languages, entries):
        discard(table)
    return found

"""Language-model scores by prediction by partial matching.

The words of the whole corpus are counted once. The byte-context trie holds, for every word, each byte after
its contexts of up to ``ORDER`` preceding bytes, counted as often as the word occurs; contexts begin anew at
white space, with a mark for the text's class. The trie is a table of all contexts, none is left out: contexts
of more than one byte are dealt by their last two bytes and sorted backwards, so the shorter contexts that a
symbol escapes to come right before the longer ones. A word's code length is
the sum over its bytes of the longest context's estimate, with escapes to shorter contexts that exclude the
symbols already ruled out. Each distinct word is coded once, on the executors: estimates of the most frequent
contexts and symbols are in a table of fixed size, all others come by a join. A document's code length is that
of its class and its tokens, adapted to what it has said before: the pretrained estimate counts as much as
``WEIGHT`` earlier tokens. Sums run over each document's distinct words: those among the most frequent by a
table of fixed size, all others by a join with the word counts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_remainder, stored

#: Longest context, estimates in the table of frequent ones, words in the table of frequent words, entries counted before they are handed on.
ORDER, NODES, FREQUENT, COUNTED = 5, 400_000, 200_000, 400_000
#: Bytes of text whose words are counted or scored together, and windows that are.
SLICE, WINDOWS = 8 << 20, 2_000_000
#: Longest context that fits a packed window: its symbols and their number are eight bytes.
LONGEST = 6
FOLDS, HELD_OUT = 5, 1
#: Tokens that the pretrained estimate counts for against a document's own.
WEIGHT = 2000.0
#: Documents that the classifier is fitted to, over all languages, and words of each language that it knows.
SAMPLE, CLASS_WORDS = 4000, 3000
#: Symbols that no UTF-8 word holds: the first digit of the mark of a class, the end of a word, the end of a text.
BEGIN, WORD_END, TEXT_END = 0xF8, b"\n", b"\x0b"
#: Discount of a symbol's count, which is given to the escape.
DISCOUNT = 0.5
LOG10 = math.log(10)


def tokens(text: str | None) -> list[bytes]:
    """Words, with A-Z lower-cased, in UTF-8; bytes.split and lower know the ASCII characters only."""
    return (text or "").encode().lower().split()


def _class_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts.update((lang, w) for w in tokens(text))
        yield pa.RecordBatch.from_pydict({"lang": pa.array([k for k, _ in counts], pa.string()), "word": pa.array([w.decode() for _, w in counts], pa.string()), "n": pa.array(counts.values(), pa.int64())})


def class_sample(docs: DataFrame, count: int = SAMPLE) -> DataFrame:
    """(lang, text) of about as many documents of each language, chosen by a hash of the id; every language of docs is there."""
    sizes = docs.groupBy("lang").agg(F.count("*").alias("n"), F.min(F.xxhash64("doc_id")).alias("least")).collect()  # one row a language
    if not sizes:
        return docs.select("lang", "text")
    each = -(-count // len(sizes))
    below = lambda r: max(r["least"], min((1 << 63) - 1, each * (1 << 64) // r["n"] - (1 << 63)))  # noqa: E731  a share of all hashes
    most = F.coalesce(*(F.when(F.col("lang") == r["lang"], F.lit(below(r)).cast("long")) for r in sorted(sizes)))
    return docs.where(F.xxhash64("doc_id") <= most).select("lang", "text")


def classifier(sample: DataFrame, words: int):
    """(lang, text) -> place of each known word, and their log-probabilities in every language, those with most words first.

    Known are each language's most frequent words.
    """
    counts = stored(sample.mapInArrow(_class_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "class-words")
    langs = [r["lang"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").collect()]
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    held: dict[str, dict[bytes, int]] = {lang: {} for lang in langs}
    for r in counts.withColumn("nth", nth).where(F.col("nth") <= words).collect():
        held[r["lang"]][r["word"].encode()] = r["n"]
    place = {w: i for i, w in enumerate(sorted({w for h in held.values() for w in h}))}
    n = np.array([[h.get(w, 0) for h in held.values()] for w in place], float).reshape(len(place), len(held)) + 0.1
    return place, np.log(n / n.sum(0))


def class_of(text: list[bytes], known) -> int:
    """The likeliest class of a text's words, the first on ties."""
    place, logs = known
    found = [i for i in map(place.get, text) if i is not None]
    return int(logs[found].sum(0).argmax()) if found else 0


def _slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches, with some ``SLICE`` bytes of text in each."""
    for batch in batches:
        of = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            if end > begin:
                yield batch.slice(begin, end - begin)


def _tokenized(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The text and the word of each token, by number, and the distinct words; Arrow's ascii functions know the ASCII characters only, as in ``tokens``."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = split.flatten()
    text = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    full = pc.greater(pc.binary_length(flat), 0)  # white space at an end leaves an empty piece
    coded = flat.filter(full).dictionary_encode()
    return text[full.to_numpy(zero_copy_only=False)], coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _classes_of(text: np.ndarray, word: np.ndarray, names: list[bytes], n: int, known) -> np.ndarray:
    """The class of each of n texts, as ``class_of`` finds it; names are the distinct words."""
    place, logs = known
    if not logs.shape[1]:
        return np.zeros(n, np.int64)
    at = np.fromiter((place.get(w, -1) for w in names), np.int64, len(names))[word]
    text, at = text[at >= 0], at[at >= 0]
    return np.stack([np.bincount(text, column[at], minlength=n) for column in np.ascontiguousarray(logs.T)]).argmax(0)


def _count_words(batches: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
    """(text, trains) -> (word, class, trained, other); the end of a text is the empty word."""
    for batch in _slices(batches, 0):
        text, word, words = _tokenized(batch.column(0))
        group = 2 * _classes_of(text, word, words.cast(pa.binary()).to_pylist(), len(batch), known) + batch.column(1).to_numpy(zero_copy_only=False)
        of, names, counts, groups = group[text], [], [], []
        for g in np.unique(group).tolist():
            n = np.bincount(word[of == g], minlength=len(words))
            at = np.flatnonzero(n)
            names += [words.take(pa.array(at)), pa.array([""])]
            counts += [n[at], [np.count_nonzero(group == g)]]
            groups.append(np.full(len(at) + 1, g))
        n, g = np.concatenate(counts).astype(np.int64), np.concatenate(groups)
        columns = [pa.concat_arrays(names), pa.array((g // 2).astype(np.int32)), pa.array(np.where(g % 2, n, 0)), pa.array(np.where(g % 2, 0, n))]
        yield pa.RecordBatch.from_arrays(columns, ["word", "class", "trained", "other"])


def symbols(word: str) -> bytes:
    """What the model codes for a token, after the begin mark."""
    return word.encode() + WORD_END if word else TEXT_END


def mark(k: int) -> bytes:
    """The begin of a word in class k: its digits to base 8, which are symbols that nothing else holds."""
    return (mark(k >> 3) if k > 7 else b"") + bytes([BEGIN + (k & 7)])


def windows(word: str, k: int, order: int) -> list[bytes]:
    """Every symbol of a token in class k behind its longest context."""
    begin = mark(k)
    coded = begin + symbols(word)
    return [coded[max(0, end - order) : end + 1] for end in range(len(begin), len(coded))]


def _bytes_of(found: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of an array of strings, and where each begins and how long it is."""
    _, offsets, data = found.buffers()
    offsets = np.frombuffer(offsets, np.int32)[found.offset : found.offset + len(found) + 1].astype(np.int64) if len(found) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets[:-1], np.diff(offsets)


def packed_windows(words: pa.Array, chosen: np.ndarray, k: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """``windows`` of the chosen words, one after the other: the word's number, and the symbols behind each other with their number in the last byte."""
    data, first, length = _bytes_of(words)
    first, length, begin = first[chosen], length[chosen], mark(k)
    total = len(begin) + length + 1
    start = np.cumsum(total) - total
    which = np.repeat(np.arange(len(chosen)), total)
    place = np.arange(len(which)) - start[which]
    coded = np.zeros(len(which), np.uint8)
    for j, symbol in enumerate(begin):
        coded[start + j] = symbol
    coded[start + total - 1] = np.where(length > 0, WORD_END[0], TEXT_END[0])
    inner = np.flatnonzero((place >= len(begin)) & (place < total[which] - 1))
    coded[inner] = data[first[which[inner]] + place[inner] - len(begin)]
    ends = np.flatnonzero(place >= len(begin))
    place = place[ends]
    packed = np.zeros(len(ends), np.uint64)
    for j in range(order + 1):
        far = place >= j
        packed[far] |= coded[ends[far] - j].astype(np.uint64) << np.uint64(8 * j + 8)
    return chosen[which[ends]], packed | (np.minimum(place, order) + 1).astype(np.uint64)


def packed(grams: pa.Array) -> np.ndarray:
    """Grams as ``packed_windows`` has them."""
    data, first, length = _bytes_of(grams)
    codes = length.astype(np.uint64)
    for j in range(LONGEST + 1):
        far = length > j
        codes[far] |= data[(first + length)[far] - 1 - j].astype(np.uint64) << np.uint64(8 * j + 8)
    return codes


def unpacked(codes: np.ndarray) -> pa.Array:
    """The grams again."""
    length = (codes & np.uint64(255)).astype(np.int64)
    shown = np.stack([codes >> np.uint64(8 * j + 8) for j in range(LONGEST, -1, -1)], 1).astype(np.uint8)
    data = shown[np.arange(LONGEST + 1) >= LONGEST + 1 - length[:, None]]
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _by_class(column: pa.Array) -> np.ndarray:
    """Lists of a number for each class as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_context(counts: dict[bytes, int]) -> pa.RecordBatch:
    batch = pa.RecordBatch.from_pydict({"back": pa.array([g[-2::-1] if len(g) > 1 else b"" for g in counts], pa.binary()), "symbol": pa.array([g[-1] for g in counts], pa.int32()), "n": pa.array(counts.values(), pa.int64())})
    counts.clear()
    return batch


def _count_windows(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """(word, trained occurrences by class, all by class) -> (gram, n) for every symbol with its longest context; n is 0 where none is trained."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        codes, n = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        by = np.argsort(codes)
        codes = codes[by]
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        return pa.RecordBatch.from_arrays([unpacked(codes[first]), pa.array(np.add.reduceat(n[by], first))], ["gram", "n"])

    for batch in batches:
        if not len(batch):
            continue
        trained, every = _by_class(batch.column(1)), _by_class(batch.column(2))
        for k in range(every.shape[1]):
            chosen = np.flatnonzero(every[:, k])
            if len(chosen):
                word, codes = packed_windows(batch.column(0), chosen, k, order)
                held.append((codes, trained[word, k]))
        if sum(len(codes) for codes, _ in held) > WINDOWS:
            yield out()
    if held:
        yield out()


def _count_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n) -> (context backwards, symbol, n) after this context and, of what is trained, after each shorter one."""
    counts: dict[bytes, int] = {}
    for batch in batches:
        for gram, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for begin in range(len(gram) if n else 1):
                counts[gram[begin:]] = counts.get(gram[begin:], 0) + n
        if len(counts) > COUNTED:
            yield _by_context(counts)
    if counts:
        yield _by_context(counts)


def count_grams(words: DataFrame, order: int) -> DataFrame:
    """(word, trained occurrences by class, all by class) -> (back, symbol, n) for every context, backwards, with its next symbol.

    The longest contexts are counted over words, the shorter ones over what is then distinct.
    """
    longest = words.mapInArrow(lambda b: _count_windows(b, order), "gram binary, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return longest.mapInArrow(_count_suffixes, "back binary, symbol int, n long").groupBy("back", "symbol").agg(F.sum("n").alias("n"))


def trie(grams: list[tuple[bytes, int]]) -> dict[bytes, tuple[int, int, dict[int, int]]]:
    """context -> (occurrences, those of pruned symbols, next symbol -> count)."""
    counts = dict(grams)
    after: dict[bytes, dict[int, int]] = {}
    for gram, n in counts.items():
        after.setdefault(gram[:-1], {})[gram[-1]] = n
    found = {}
    for context, held in after.items():
        kept = sum(held.values())
        n = max(kept, counts.get(context, 0))  # counts have no gram of a begin mark alone; few symbols follow it
        found[context] = n, n - kept, held
    return found


def symbol_log(context: bytes, symbol: int, nodes: dict[bytes, tuple[int, int, dict[int, int]]]) -> float:
    """log10 of a symbol's probability after a context: the longest that has it, with escapes from longer ones."""
    excluded, p = None, 1.0
    for begin in range(len(context) + 1):
        node = nodes.get(context[begin:])
        if node is None:
            continue
        total, pruned, after = node
        left = len(after)
        if excluded:
            for s in excluded & after.keys():
                left -= 1
                total -= after[s]
        if not left:
            continue
        count = after.get(symbol)
        if count is not None:
            return math.log10(p * (count - DISCOUNT) / total)
        p *= (pruned + DISCOUNT * left) / total
        excluded = excluded | after.keys() if excluded else set(after)
    return math.log10(p / (257 - len(excluded or ())))


def code_length(word: str, k: int, nodes, order: int, known: dict[bytes, float] | None = None) -> float:
    """log10 of a token's probability in class k; known keeps what was found for a context and symbol."""
    total, known = 0.0, {} if known is None else known
    for gram in windows(word, k, order):
        log = known.get(gram)
        if log is None:
            log = known[gram] = symbol_log(gram[:-1], gram[-1], nodes)
        total += log
    return total


def _asked(back: bytes, order: int) -> bool:
    """Whether a context is the longest one of some symbol: of full length, or from the begin of a word on."""
    return len(back) == order or back[-1:] >= bytes([BEGIN])


def _estimates(batches: Iterator[pa.RecordBatch], shallow, order: int) -> Iterator[pa.RecordBatch]:
    """(back, symbol, n) sorted by back -> (gram, n, log) for the longest contexts.

    Shorter contexts come before those that end with them, so the ones to escape to are a stack, but for those of one
    byte at most, which are given.
    """
    above: list[tuple[bytes, tuple[int, int, dict[int, int]]]] = []
    grams, counts, logs = [], [], []

    def close(back: bytes, found: list[tuple[int, int]]) -> None:
        after = {symbol: n for symbol, n in found if n}
        total = sum(after.values())
        while above and not back.startswith(above[-1][0]):
            above.pop()
        if after and len(back) > 1:
            above.append((back, (total, 0, after)))
        if not _asked(back, order):
            return
        context, nodes = back[::-1], None
        for symbol, n in found:
            if n:
                log = math.log10((n - DISCOUNT) / total)
            else:
                if nodes is None:
                    nodes = {b[::-1]: node for b, node in above} | {c: shallow[c] for c in (context[-1:], b"") if c in shallow}
                log = symbol_log(context, symbol, nodes)
            grams.append(context + bytes([symbol]))
            counts.append(n)
            logs.append(log)

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(grams, pa.binary()), pa.array(counts, pa.int64()), pa.array(logs, pa.float64())], ["gram", "n", "log"])
        for held in (grams, counts, logs):
            held.clear()
        return batch

    last, found = None, []
    for batch in batches:
        for back, symbol, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if back != last:
                if found:
                    close(last, found)
                last, found = back, []
            found.append((symbol, n))
        if grams:
            yield out()
    if found:
        close(last, found)
    if grams:
        yield out()


def estimates(grams: DataFrame, order: int) -> DataFrame:
    """(gram, n, log) of every symbol behind its longest context: log10 of its probability. All contexts count."""
    back = F.col("back")
    first = grams.where((F.length(back) <= 1) & (F.col("n") > 0)).toArrow()  # at most 257 contexts of 257 symbols
    shallow = grams.sparkSession.sparkContext.broadcast(trie([(b + bytes([s]), n) for b, s, n in zip(*(first.column(c).to_pylist() for c in ("back", "symbol", "n")), strict=True)]))
    deep = grams.where((F.length(back) > 1) | (back >= F.lit(bytes([BEGIN])))).repartition(F.substring(back, 1, 2)).sortWithinPartitions("back")
    return deep.mapInArrow(lambda b: _estimates(b, shallow.value, order), "gram binary, n long, log double")


def _code_words(batches: Iterator[pa.RecordBatch], known: tuple[np.ndarray, np.ndarray], order: int) -> Iterator[pa.RecordBatch]:
    """Adds the code length in every class that has the word, as far as it is known, and the grams that are not, with their class.

    ``known`` are packed grams in order and their estimates.
    """
    grams, logs = known
    for batch in batches:
        if not len(batch):
            continue
        every = _by_class(batch.column(3))
        coded, lacks = np.zeros(every.shape), []
        for k in range(every.shape[1]):
            word, codes = packed_windows(batch.column(0), np.flatnonzero(every[:, k]), k, order)
            at = np.minimum(np.searchsorted(grams, codes), max(0, len(grams) - 1))
            found = grams[at] == codes if len(grams) else np.zeros(len(codes), bool)
            coded[:, k] = np.bincount(word[found], logs[at[found]], minlength=len(batch))
            lacks.append((word[~found], np.full(np.count_nonzero(~found), k, np.int32), codes[~found]))
        word, k, codes = (np.concatenate(c) for c in zip(*lacks, strict=True))
        by = np.argsort(word, kind="stable")
        missing = pa.StructArray.from_arrays([pa.array(k[by]), unpacked(codes[by])], ["k", "gram"])
        ends = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        sums = pa.ListArray.from_arrays(ends(np.full(len(batch), every.shape[1])), pa.array(coded.ravel(), mask=every.ravel() == 0))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], sums, pa.ListArray.from_arrays(ends(np.bincount(word, minlength=len(batch))), missing)], [*batch.schema.names[:3], "coded", "missing"])


def code_words(words: DataFrame, logs: DataFrame, classes: int, order: int, held: int) -> DataFrame:
    """(word, trained, n, coded) for words (word, trained, n, in): the code length in each class.

    The estimates of the ``held`` most frequent grams are looked up in tasks, all others by a join.
    """
    top = logs.orderBy(F.desc("n"), "gram").limit(held).toArrow()
    grams = packed(pa.concat_arrays([pa.array([], pa.binary()), *top.column("gram").chunks]))
    by = np.argsort(grams)
    known = words.sparkSession.sparkContext.broadcast((grams[by], top.column("log").to_numpy()[by]))  # at most ``held``
    kinds = "word string, trained long, n long, coded array<double>, missing array<struct<k int, gram binary>>"
    partly = stored(words.select("word", "trained", "n", "in").mapInArrow(lambda b: _code_words(b, known.value, order), kinds), "partly-coded")
    lacks = partly.where(F.size("missing") > 0)
    found = lacks.select("word", F.explode("missing").alias("m")).select("word", "m.k", F.col("m.gram").alias("gram")).join(logs.select("gram", "log"), "gram")
    more = found.groupBy("word").agg(F.array(*(F.sum(F.when(F.col("k") == k, F.col("log"))) for k in range(classes))).alias("more"))
    whole = lacks.join(more, "word").select("word", "trained", "n", F.zip_with("coded", "more", lambda a, b: a + F.coalesce(b, F.lit(0.0))).alias("coded"))
    return stored(partly.where(F.size("missing") == 0).drop("missing").unionByName(whole), "coded-words")


def frequent_table(top: pa.Table, base) -> tuple:
    """word -> place, and by place the base, whether training texts have it, and by class log10 of WEIGHT times its probability."""
    words, trained, coded = (top.column(k).to_pylist() for k in ("word", "trained", "coded"))
    logs = np.array(coded, float).reshape(len(words), -1).T.copy() if words else np.zeros((1, 0))
    return {w.encode(): i for i, w in enumerate(words)}, np.array([base(c) for c in trained]), np.array([c > 0 for c in trained], np.int64), logs + math.log10(WEIGHT)


def _score(batches: Iterator[pa.RecordBatch], known, frequent, priors: list[float]) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, text) -> the sums over frequent words, and a row for each other word of the text.

    A word that a text has t times adds log10 of the product of own, own + 1 ... own + t - 1, own being WEIGHT
    times its probability.
    """
    kinds = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("word", pa.string()), ("class", pa.int32()), ("tf", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("coded", pa.float64())])
    place, base, trained, logs = frequent
    for batch in _slices(batches, 2):
        n, (text, word, words) = len(batch), _tokenized(batch.column(2))
        names = words.cast(pa.binary()).to_pylist()
        k = _classes_of(text, word, names, n, known)
        names.append(b"")
        keys, tf = np.unique(np.concatenate([text * len(names) + word, np.arange(1, n + 1) * len(names) - 1]), return_counts=True)
        text, word = np.divmod(keys, len(names))
        at = np.fromiter((place.get(w, -1) for w in names), np.int64, len(names))[word]
        log = np.where(at < 0, np.nan, logs[k[text], at]) if len(base) else np.full(len(at), np.nan)
        other = np.isnan(log)
        of, at, log, often = (c[~other] for c in (text, at, log, tf))
        by_text = lambda of, x: np.bincount(of, x, minlength=n)
        n_tokens = by_text(text, tf).astype(np.int64)
        coded = np.array(priors)[k] + np.array([(math.lgamma(WEIGHT) - math.lgamma(WEIGHT + x)) / LOG10 for x in n_tokens.tolist()]) + by_text(of, log)
        again = often > 1
        own, more, more_of = 10 ** log[again], often[again] - 1, of[again]
        for j in range(1, int(min(more.max(initial=0), 16)) + 1):
            coded += by_text(more_of[more >= j], np.log10(own[more >= j] + j))
        many = more > 16
        coded += by_text(more_of[many], np.array([(math.lgamma(x + m + 1) - math.lgamma(x + 17)) / LOG10 for x, m in zip(own[many].tolist(), more[many].tolist(), strict=True)], float))
        n_known = by_text(of, often * trained[at]).astype(np.int64)
        whole = [batch.column(0), batch.column(1), pa.nulls(n, pa.string()), pa.array(k.astype(np.int32)), pa.array(np.zeros(n, np.int64)), pa.array(n_tokens), pa.array(n_known), pa.array(by_text(of, often * base[at])), pa.array(coded)]
        yield pa.RecordBatch.from_arrays(whole, schema=kinds)
        text, left = text[other], pa.concat_arrays([words, pa.array([""])]).take(pa.array(word[other]))
        none, zero, nought = pa.nulls(len(text), pa.int64()), pa.array(np.zeros(len(text), np.int64)), pa.array(np.zeros(len(text)))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), none, left, pa.array(k[text].astype(np.int32)), pa.array(tf[other].astype(np.int64)), zero, zero, nought, nought], schema=kinds)


def score_documents(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, order: int = ORDER, nodes: int = NODES, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from documents whose crc32 of the id leaves another remainder than ``held_out``; null texts are empty
    and teach, and have, one end. The classes are the languages of the training documents;
    a text's class is found from its words alone, and its code length is part of the score. Without languages
    there is one class. Contexts of all classes count, however rare, up to ``order`` bytes, ``LONGEST`` at most;
    ``nodes`` and ``frequent`` only say how many estimates and words are looked up in tables instead of by joins. ``base_score`` is the smoothed unigram log10 probability, ``score`` the model's. Without
    training texts both models are uniform. Null ids count as the empty text; repeated rows stay and teach each
    for itself; other columns are ignored.
    """
    if order > LONGEST:
        raise ValueError(f"contexts are no longer than {LONGEST} bytes")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    held = id_remainder(F.col("doc_id"), folds) == held_out
    fitted = classifier(class_sample(docs.where(~held & F.col("lang").isNotNull())), CLASS_WORDS)
    classes = max(1, fitted[1].shape[1])
    known = spark.sparkContext.broadcast(fitted)  # CLASS_WORDS words of each language at most

    counted = docs.select("text", (~held).alias("trains")).mapInArrow(lambda b: _count_words(b, known.value), "word string, class int, trained long, other long")
    by_class = lambda *of: F.array(*(F.sum(F.when(F.col("class") == k, sum((F.col(c) for c in of), F.lit(0))).otherwise(0)) for k in range(classes)))
    words = counted.groupBy("word").agg(F.sum("trained").alias("trained"), F.sum(F.col("trained") + F.col("other")).alias("n"), by_class("trained").alias("trained_in"), by_class("trained", "other").alias("in"))
    words = stored(words, "words")
    n, v = words.agg(F.coalesce(F.sum("trained"), F.lit(0)), F.count_if(F.col("trained") > 0)).first()
    ends = next((r[0] for r in words.where("word = ''").select("trained_in").collect()), [0] * classes)
    priors = [math.log10((x + 0.5) / (sum(ends) + 0.5 * classes)) for x in ends]

    grams = stored(count_grams(words.select("word", "trained_in", "in"), order), "grams")
    coded = code_words(words, stored(estimates(grams, order), "estimates"), classes, order, nodes)

    unknown = math.log10(0.5 / (n + 0.5 * (v + 1)))
    base = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    top = coded.orderBy(F.desc("n"), "word").limit(frequent).toArrow()
    shared = spark.sparkContext.broadcast(frequent_table(top, base))  # at most ``frequent`` words

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = rows.mapInArrow(lambda b: _score(b, known.value, shared.value, priors), "row long, doc_id long, word string, class int, tf long, n_tokens long, n_known long, base double, coded double")
    parts = stored(parts, "scored")
    whole = parts.where("word is null").drop("word", "class", "tf")
    other = parts.where("word is not null").select("row", "word", "class", "tf").join(coded.select("word", "trained", F.col("coded").alias("p")), "word")
    each = F.when(F.col("trained") > 0, F.log10((F.col("trained") + 0.5) / F.lit(n + 0.5 * (v + 1)))).otherwise(F.lit(unknown))
    once = F.lit(math.log10(WEIGHT)) + F.get("p", F.col("class"))
    own = F.pow(F.lit(10.0), once)  # zero for a long token, whose logarithm stays
    often = F.aggregate(F.sequence(F.lit(1), F.col("tf") - 1), once, lambda s, j: s + F.log10(own + j))
    other = other.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_tokens"), (F.col("tf") * (F.col("trained") > 0).cast("long")).alias("n_known"), (F.col("tf") * each).alias("base"), F.when(F.col("tf") == 1, once).otherwise(often).alias("coded"))
    sums = whole.unionByName(other).groupBy("row").agg(F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "coded")))
    return sums.select("doc_id", (id_remainder(F.col("doc_id"), folds) == held_out).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("coded").alias("score"))

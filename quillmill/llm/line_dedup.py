"""Line deduplication by an exact set-similarity join, with DataFrame functions only.

A line is the set of its words. Equal lines collapse first, by two hashes. The words of every line are ordered by
rarity, and what is joined on are pairs of words that follow each other in that order, from the prefix of a line. Of two
lines with a Jaccard similarity of 0.8 or more let o words be common and d words in one only, so 4 d <= o. Each of the
latter stands between two common words at most, so among the d + 1 first pairs of consecutive common words one is parted
in neither line. In a line of n words, of which u are its own and v the other's, it ends at place 2 u + v + 2 or before,
and 4 (u + v) <= n - u makes that 2 n / 5 + 2. Pairs of rare words seldom meet by chance, so most keys have one
line and go in the first aggregation; lengths, places, how many keys are shared and a parity map rule out nearly all
other candidates. Every
word toggles one of 64 bits, and in two long lines of 128, so the maps of two lines never differ in more bits than the
lines differ in words. What is
left is compared word for word.

Keys of few lines are joined outright, but for two lines that also have keys of many. A line of these is first compared
with those that are the earliest of most of its shared keys; pairs are formed only where that settles nothing, so a group of
near copies costs a few comparisons a line. Lines that no earlier one is similar to do meet their group; such keys of many lines carry the line's other such keys, so that each of
these pairs is made once and not for every key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

SIMILARITY_PERCENT = 80
#: Words are counted by 2 ** CLASS_BITS classes of their hashes; the table of classes has a byte for each.
CLASS_BITS = 18
#: Earliest lines that a line is first compared with, and the share of its keys, one in so many, that has to name one.
WITNESSES, NAMED_BY = 2, 8
#: Keys of so many lines are hot: two lines that share several meet in one row.
HOT = 32
#: Stands for a null id, as rows without one come last.
LAST = (1 << 63) - 1
#: Lines of more words have a second parity map.
LONG = 60
WORD = r"[^\x20\x09-\x0D]"


def _spaced(text: Column) -> Column:
    """Lower-cased, with blanks in place of all white space but line feeds."""
    return F.lower(F.when(text.rlike(r"[\x09\x0B-\x0D]"), F.translate(text, "\t\x0b\x0c\r", "    ")).otherwise(text))


def _named(docs: DataFrame, row: Column | None) -> DataFrame:
    """(row, doc) with the columns of docs in a struct, so that no name can clash; stored if rows have no names yet."""
    doc = F.struct(*(docs[c] for c in docs.columns)).alias("doc")
    if row is not None:
        return docs.select(row.alias("row"), doc)
    return stored(docs.select(F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at")).alias("row"), doc), "named-rows")


def rarity_table(text: DataFrame) -> bytes:
    """A byte for each class of word hashes, larger where its words are more frequent together.

    Frequent words stand out of their class; rare ones are as frequent as a class is on average, and come in the order
    of classes and hashes, which is one order for all lines.
    """
    words = text.select(F.explode(F.split(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), " ")).alias("w")).where("w <> ''")
    counts = words.groupBy(_class(F.xxhash64("w")).alias("class")).agg(F.count("*").alias("n"))
    table = bytearray(b"\x01") * (1 << CLASS_BITS)
    for row in counts.select("class", F.least(F.lit(120), 1 + 2 * F.log2("n")).cast("int").alias("level")).toLocalIterator():  # no more than classes
        table[row["class"]] = row["level"]
    return bytes(table)


def _class(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - CLASS_BITS).cast("int")


def _parity(ranked: Column) -> Column:
    """A map with a bit for each word, by the low bits of its hash; bits that are hit twice cancel out."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(ranked, F.lit(0).cast("long"), lambda bits, x: bits.bitwiseXOR(bit(x)))


def _odd_parity(ranked: Column) -> Column:
    """The share of the words whose next bit is set in that map."""
    bit = lambda x: F.call_function("shiftleft", F.shiftrightunsigned(x, 6).bitwiseAND(F.lit(1)), x.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(ranked, F.lit(0).cast("long"), lambda bits, x: bits.bitwiseXOR(bit(x)))


def distinct_lines(named: DataFrame) -> DataFrame:
    """(id, place, n, p, q, words) for every distinct line with a word.

    ``place`` is that of the first of equal lines, ``n`` the number of words, ``p`` their parity map and ``q``, null
    in lines of LONG words or fewer, the part of it that half of the words make; ``words`` has 31 bits of each word of the
    prefix, rare ones first.
    """
    texts = named.where("doc.text is not null").select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), _spaced(F.col("doc.text")).alias("text"))
    table = F.lit(rarity_table(texts.select("text")))
    lines = texts.select("row", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.trim("line") != "")
    hashed = lines.select("row", "doc_id", "pos", F.xxhash64("line").alias("a"), F.xxhash64("line", F.lit(1)).alias("b"), F.transform(F.split("line", " "), lambda w: F.xxhash64(w)).alias("h"))
    level = lambda h: F.ascii(F.substring(table, _class(h) + 1, 1).cast("string")).cast("long")
    rank = lambda h: level(h) * (1 << 56) + F.shiftrightunsigned(h, 8).bitwiseAND(F.lit((1 << 56) - 1))
    ranked = hashed.select("row", "doc_id", "pos", "a", "b", F.sort_array(F.transform(F.array_distinct(F.array_remove("h", F.xxhash64(F.lit("")))), rank)).alias("ranked"))
    n = F.size("ranked")
    prefix = F.transform(F.slice("ranked", F.lit(1), _prefix(n)), lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "pos").alias("place")
    each = ranked.select("a", "b", place, n.alias("n"), _parity(F.col("ranked")).alias("p"), F.when(n > LONG, _odd_parity(F.col("ranked"))).alias("q"), prefix.alias("words"))
    one = each.groupBy("a", "b").agg(F.min("place").alias("place"), *(F.first(c).alias(c) for c in ("n", "p", "q", "words")))
    return stored(one.select(F.monotonically_increasing_id().alias("id"), "place", "n", "p", "q", "words"), "lines")


def _entries(lines: DataFrame) -> DataFrame:
    """(id, doc, i, key) for each pair of words that follow each other in a prefix, i being the first one's place; a lone word is a key itself."""
    w = F.col("words")
    pair = F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda x, y: x.cast("long") * (1 << 31) + y)
    keys = F.when(F.size(w) > 1, pair).otherwise(F.transform(w, lambda x: x.cast("long")))
    return lines.select("id", F.coalesce("place.doc_id", F.lit(LAST)).alias("doc"), F.posexplode(keys).alias("i", "key"))


def _differing(a: str, b: str) -> Column:
    """Bits that differ between the parity maps of two lines: no more than words that only one of them has."""
    p, q = (F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")) for c in "pq")
    return F.coalesce(F.bit_count(q) + F.bit_count(p.bitwiseXOR(q)), F.bit_count(p))


def _may_agree(a: str, b: str) -> Column:
    """Length and parity filter for two lines."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    lengths = (m * 100 >= n * SIMILARITY_PERCENT) & (n * 100 >= m * SIMILARITY_PERCENT)
    # an overlap o needs o / (n + m - o) >= s, so o (1 + s) >= s (n + m); and n + m - 2 o words differ
    return lengths & (_differing(a, b) * (100 + SIMILARITY_PERCENT) <= (n + m) * (100 - SIMILARITY_PERCENT))


def _placed_well(a: str, b: str) -> Column:
    """Positional filter for two lines with a common word at places i: before it and from it on no more can be common than the shorter part has."""
    n, i, m, j = (F.col(f"{x}.{c}") for x in (a, b) for c in ("n", "i"))
    return (F.least(i, j) + F.least(n - i, m - j)) * (100 + SIMILARITY_PERCENT) >= (n + m) * SIMILARITY_PERCENT


def _line_texts(ids: DataFrame, lines: DataFrame, named: DataFrame) -> DataFrame:
    """(id, place, line) for the lines named by ids."""
    by_row = ids.distinct().join(lines.select("id", "place"), "id").groupBy("place.row").agg(F.collect_list(F.struct("id", "place")).alias("wanted"))  # no more than the row has lines
    texts = named.select("row", _spaced(F.col("doc.text")).alias("text")).join(by_row, "row").select(F.split("text", "\n").alias("lines"), "wanted")
    return stored(texts.select("lines", F.explode("wanted").alias("w")).select("w.id", "w.place", F.get("lines", F.col("w.place.pos")).alias("line")), "candidate-lines")


def _similar(pairs: DataFrame, each: DataFrame) -> DataFrame:
    """(id) of the later line of every pair (x, y) whose word sets are similar indeed."""
    side = lambda c: each.select(F.col("id").alias(c), F.col("place").alias(f"{c}_place"), F.col("line").alias(f"{c}_line"))
    words = lambda c: F.array_distinct(F.array_remove(F.split(c, " "), "")).alias(c)
    both = pairs.join(side("x"), "x").join(side("y"), "y").select(F.when(F.col("x_place") > F.col("y_place"), F.col("x")).otherwise(F.col("y")).alias("id"), words("x_line"), words("y_line"))
    common = F.size(F.array_intersect("x_line", "y_line"))
    alike = both.where(common * 100 >= (F.size("x_line") + F.size("y_line") - common) * SIMILARITY_PERCENT)
    return stored(alike.select("id").distinct(), "similar-lines")


def _shared(lines: DataFrame) -> DataFrame:
    """(key, id, i, n, p, q, doc, first, hot, in_large) for the entries whose key has several lines, ``first`` being one of the earliest document among them.

    ``hot`` is null, or for keys of HOT lines and more all such keys of the line, rare words first; ``in_large``
    says whether the line has any.
    """
    of_key = Window.partitionBy("key")  # Spark spills what a key has beyond some thousand lines
    counted = _entries(lines).select("key", "id", "i", F.min_by("id", "doc").over(of_key).alias("first"), F.count("*").over(of_key).alias("lines"))
    keyed = counted.where("lines > 1").select("key", "id", "i", "first", (F.col("lines") >= HOT).alias("is_hot"))
    keyed = stored(keyed, "keyed-entries")  # the shuffle files of all entries go before the shared ones are shuffled again
    ranked = F.sort_array(F.collect_list(F.struct("i", "key")))  # no more than the line has words
    hot = keyed.where("is_hot").groupBy("id").agg(F.transform(ranked, lambda x: x["key"]).alias("hot"))
    known = lines.select("id", "n", "p", "q", F.coalesce("place.doc_id", F.lit(LAST)).alias("doc"))
    held = keyed.join(known, "id").join(hot, "id", "left")
    shared = stored(held.select("key", "id", "i", "n", "p", "q", "doc", "first", F.when(F.col("is_hot"), F.col("hot")).alias("hot"), F.col("hot").isNotNull().alias("in_large")), "shared-entries")
    discard(keyed)
    return shared


def _prefix(n: Column) -> Column:
    """Words of a prefix."""
    return F.floor(n * 2 / 5).cast("int") + 2


def _enough(n: Column, m: Column, keys: Column) -> Column:
    """Whether two lines of n and m words share as many keys as similar ones must.

    With o common words at least, the first of which are in both prefixes, each pair of consecutive ones is a key of
    both lines, but for those that one of the n + m - 2 o other words parts.
    """
    o = F.ceil((n + m) * SIMILARITY_PERCENT / (100 + SIMILARITY_PERCENT)).cast("int")
    both = F.least(F.least(_prefix(n), n) - (n - o), F.least(_prefix(m), m) - (m - o))
    return keys >= both - 1 - (n + m - 2 * o)


def _first_pairs(shared: DataFrame, lines: DataFrame) -> DataFrame:
    """(x, y): lines x with hot keys and the WITNESSES lines that are first for most of their keys."""
    met = shared.where("in_large and id <> first").groupBy("id", "n", "p", "q", "first").agg(F.count("*").alias("keys")).where(F.col("keys") * NAMED_BY >= _prefix(F.col("n")) - 1)
    met = met.select(F.struct("id", "n", "p", "q").alias("a"), "first", "keys").join(lines.select(F.col("id").alias("first"), F.struct("id", "n", "p", "q").alias("b")), "first").where(_may_agree("a", "b"))
    rank = F.struct((-F.col("keys")).alias("keys"), _differing("a", "b").alias("bits"), F.col("b.id").alias("y"))
    best = met.groupBy(F.col("a.id").alias("x")).agg(F.slice(F.sort_array(F.collect_list(rank)), 1, WITNESSES).alias("best"))  # NAMED_BY at most
    return best.select("x", F.explode("best.y").alias("y"))


def _met_pairs(open_: DataFrame, shared: DataFrame, among: Column | None = None) -> DataFrame:
    """(x, y) that share as many keys as similar lines must."""
    counted = _met(open_, shared, among).groupBy("x", "y", "n", "m").agg(F.sum("keys").alias("keys")).where(_enough(F.col("n"), F.col("m"), F.col("keys")))
    return counted.select("x", "y")


def _met(open_: DataFrame, shared: DataFrame, among: Column | None = None) -> DataFrame:
    """(x, y, n, m, keys): open lines x and the lines y that may be similar and are no later, in a row for each shared key or for all shared hot keys."""
    hot = F.array_intersect("a.hot", "b.hot")
    once = F.col("a.hot").isNull() | (F.get(hot, F.lit(0)) == F.col("a.key"))
    fits = (F.col("a.id") != F.col("b.id")) & (F.col("b.doc") <= F.col("a.doc")) & _may_agree("a", "b") & _placed_well("a", "b") & once
    if among is not None:
        fits &= among
    met = open_.alias("a").join(shared.alias("b"), F.col("a.key") == F.col("b.key")).where(fits)
    return met.select(F.col("a.id").alias("x"), F.col("b.id").alias("y"), F.col("a.n").alias("n"), F.col("b.n").alias("m"), F.coalesce(F.array_size(hot), F.lit(1)).alias("keys"))


def removed_lines(lines: DataFrame, named: DataFrame) -> DataFrame:
    """(id) of the distinct lines that are similar to an earlier one.

    Lines meet all lines of earlier documents, and of their own, that share a key; two lines with hot keys do so only
    if the later one's first comparison doesn't settle it. Texts are read once, those of all lines with hot keys too.
    """
    shared = _shared(lines)
    large = shared.where("in_large")
    cold = shared.where("hot is null").withColumn("hot", F.lit(None).cast("array<long>"))  # all that a line without hot keys shares
    pairs = stored(_first_pairs(shared, lines).union(_met_pairs(cold, cold, ~(F.col("a.in_large") & F.col("b.in_large")))), "line-pairs")
    each = _line_texts(pairs.select(F.col("x").alias("id")).union(pairs.select("y")).union(large.select("id")), lines, named)
    found = _similar(pairs, each)
    discard(pairs)
    pairs = stored(_met_pairs(large.join(found, "id", "left_anti"), large), "open-pairs")
    discard(shared)
    found = found.union(_similar(pairs, each)).distinct()
    discard(pairs)
    discard(each)
    return found


def dedup_lines(docs: DataFrame, row: Column | None = None, counts: tuple[str, str] | None = ("n_lines", "n_removed")) -> DataFrame:
    """docs (doc_id, text, ...) without repeated lines in text, and with two more columns: how many lines there were, and went.

    Lines end at line feeds and are compared in lower case as sets of words, which white space parts. A line goes if
    a line before it, in the order of doc_id and place, has a Jaccard similarity of 0.8 or more, also one that goes
    itself. Rows with a null id come last; rows with equal ids, and those with null ids, follow each other in an
    order that is fixed once for all lines, so of equal rows one keeps its lines. Lines without words stay. Null texts
    stay null with no lines. An empty table stays empty. Columns of docs keep their names and places, whatever they
    are; the two are added behind them under the names in ``counts``, or not at all. ``row`` names the rows, as ``file_row`` does; without it docs is
    stored with a number for each row.
    """
    named = _named(docs, row)
    lines = distinct_lines(named)
    removed = removed_lines(lines, named)
    kept = lines.join(removed, "id", "left_anti").groupBy("place.row").agg(F.collect_list("place.pos").alias("kept"))  # no more than the row has lines
    joined = named.join(kept, "row", "left").withColumn("lines", F.split("doc.text", "\n"))
    blank = F.array_compact(F.transform("lines", lambda line, i: F.when(~line.rlike(WORD), i)))
    left = joined.withColumn("left", F.sort_array(F.concat(F.coalesce("kept", F.array().cast("array<int>")), blank)))
    text = F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n")
    n_lines = F.coalesce(F.size("lines"), F.lit(0)).cast("long")
    more = (n_lines, n_lines - F.coalesce(F.size("left"), F.lit(0)))
    return left.select(*(text.alias("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns), *(c.alias(name) for c, name in zip(more, counts or ())))

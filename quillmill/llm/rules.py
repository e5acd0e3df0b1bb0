"""Quality rules as a ledger: each text is measured once, each rule is one bit, and policies are masks over the bits.

A rule never changes its meaning or its bit; a changed threshold is a new rule. So a stored ledger answers any policy
of any version without reading a text again, and what a policy would be without one of its rules is a count of rows
whose failure bits under the policy are that rule's bit alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_capitals", "n_small", "n_digits", "n_exclamations", "n_lettered", "n_bullets", "n_ellipses")
BLANKS, SYMBOLS, BULLETS = b" \t\n\x0b\x0c\r", b"#*$%&|<>", (b"-", b"*", "•".encode())


class Rule(NamedTuple):
    """``fails`` says of a column of measures whether the rule is broken; comparisons are of whole numbers."""

    name: str
    bit: int
    fails: Callable[[Column], Column]


RULES = (
    Rule("few_words", 0, lambda m: m["n_words"] < 10),
    Rule("repeated_windows", 1, lambda m: m["n_repeat_words"] * 100 > m["n_words"] * 20),
    Rule("symbols", 2, lambda m: m["n_symbols"] * 10 > m["n_words"]),
    Rule("repeated_lines", 3, lambda m: m["n_dup_lines"] * 10 > m["n_lines"] * 3),
    Rule("short_words", 4, lambda m: m["word_chars"] < m["n_words"] * 2),
    Rule("long_words", 5, lambda m: m["word_chars"] > m["n_words"] * 12),
    Rule("few_letters", 6, lambda m: m["n_letters"] * 10 < m["word_chars"] * 6),
    Rule("capitals", 7, lambda m: m["n_capitals"] > m["n_small"]),
    Rule("digits", 8, lambda m: m["n_digits"] * 4 > m["word_chars"]),
    Rule("exclamations", 9, lambda m: m["n_exclamations"] * 2 > m["n_words"]),
    Rule("unlettered_words", 10, lambda m: m["n_lettered"] * 10 < m["n_words"] * 8),
    Rule("bullets", 11, lambda m: m["n_bullets"] * 10 > m["n_lines"] * 9),
    Rule("ellipses", 12, lambda m: m["n_ellipses"] * 10 > m["n_lines"] * 3),
)
BASE = ("few_words", "repeated_windows")
#: Version -> its rules. A version stays as it is once a ledger was judged by it.
POLICIES = {
    "base": BASE,
    "1": (*BASE, "symbols", "repeated_lines", "long_words", "few_letters", "bullets", "ellipses"),
    "2": (*BASE, "symbols", "repeated_lines", "short_words", "long_words", "few_letters", "capitals", "digits", "exclamations", "unlettered_words", "bullets", "ellipses"),
}
CURRENT = "2"


def _flags(of: Iterable[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(of)] = True
    return table


_IS_BLANK, _IS_LETTER = _flags(BLANKS), _flags([*range(65, 91), *range(97, 123), *range(128, 256)])


def repeated_words(ids: np.ndarray) -> int:
    """Words in windows of ``WINDOW`` words that occur twice or more. Hashes rule windows out, equal words decide."""
    if len(ids) <= WINDOW:
        return 0
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    hashes = np.zeros(len(ids) - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        hashes = hashes * np.uint64(0xD6E8FEB86659FD93) + mixed[k : len(hashes) + k]
    ordered = np.sort(hashes)
    if not (twice := ordered[1:][ordered[1:] == ordered[:-1]]).size:
        return 0
    at = np.flatnonzero(np.isin(hashes, twice))
    _, kind, count = np.unique(np.lib.stride_tricks.sliding_window_view(ids, WINDOW)[at], axis=0, return_inverse=True, return_counts=True)
    at = at[count[kind.reshape(-1)] > 1]
    change = np.zeros(len(ids) + 1, np.int64)
    change[at] += 1
    change[at + WINDOW] -= 1
    return int(np.count_nonzero(np.cumsum(change)))


def measure(text: bytes | None) -> tuple[int, ...]:
    """The MEASURES of one text."""
    text = text or b""
    words = text.split()
    if not words:
        return (0,) * len(MEASURES)
    data = np.frombuffer(text, np.uint8)
    count = np.bincount(data, minlength=256)
    some = lambda chars: int(count[list(chars)].sum())
    points = len(data) - int(count[128:192].sum())  # bytes that continue a character don't count
    blank = _IS_BLANK[data]
    begins = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    lettered = np.count_nonzero(np.maximum.reduceat(_IS_LETTER[data], begins))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words), points - some(BLANKS), some(SYMBOLS), len(lines), len(lines) - len(set(lines)), repeated_words(ids),
        some(range(65, 91)) + some(range(97, 123)) + int(count[192:].sum()), some(range(65, 91)), some(range(97, 123)), some(range(48, 58)), some(b"!"), int(lettered),
        sum(line.lstrip().startswith(BULLETS) for line in lines), sum(line.rstrip().endswith((b"...", "…".encode())) for line in lines),
    )


def measures(text: Column) -> Column:
    """The MEASURES of a text as a struct of long numbers, all zero without a word."""
    kind = pa.struct([(name, pa.int64()) for name in MEASURES])

    @F.arrow_udf(f"struct<{', '.join(f'{name}: long' for name in MEASURES)}>")
    def measured(texts: pa.Array) -> pa.Array:
        rows = np.array([measure(t.as_py()) for t in texts], np.int64).reshape(-1, len(MEASURES))
        return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(MEASURES))], fields=list(kind))

    return measured(text.cast("binary"))


def failures(m: Column) -> Column:
    """The bits of the rules that these measures break."""
    return reduce(Column.bitwiseOR, (F.when(rule.fails(m), 1 << rule.bit).otherwise(0).cast("long") for rule in RULES))


def mask(rules: Iterable[str]) -> int:
    bits = {rule.name: 1 << rule.bit for rule in RULES}
    return sum(bits[name] for name in rules)


def passes(failed: Column, policy: str = CURRENT, without: str | None = None) -> Column:
    """Whether failure bits keep a row under a policy, or under one without one of its rules."""
    return failed.bitwiseAND(F.lit(mask(name for name in POLICIES[policy] if name != without)).cast("long")) == 0


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc, measures, failed) for each row of docs, ``doc`` being its columns as a struct, so that no name can clash.

    Words are what the six ASCII blanks part. Lines without a word are no lines; equal lines are equal byte for byte.
    Letters are A-Z, a-z and all characters beyond ASCII. A NULL, empty or blank text measures zero throughout and
    breaks ``few_words`` only. Rows are judged one by one: equal rows get equal entries, null ids are ids like
    others, and an empty table gives an empty ledger. Whole texts are read, whatever their length.
    """
    held = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"), measures(docs[text]).alias("measures"))
    return held.select("doc", "measures", failures(F.col("measures")).alias("failed"))


def ablations(entries: DataFrame, policies: Iterable[str] = tuple(POLICIES)) -> DataFrame:
    """(policy, rule, n_rows, n_kept, n_failed, n_only) of a ledger: what each rule of each policy does.

    ``n_failed`` rows break the rule, ``n_only`` of them no other rule of the policy, so leaving it out would keep
    ``n_kept + n_only``. Rows are first counted by their bits, of which there are far fewer than rows; all the rest
    works on these counts. A policy over an empty ledger has no rows.
    """
    counted = entries.groupBy("failed").agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(mask(POLICIES[p])).cast("long").alias("mask"), F.lit(name).alias("rule"), F.lit(mask([name])).cast("long").alias("bit")) for p in policies for name in POLICIES[p]))
    each = counted.select("n", "failed", F.explode(rules).alias("r")).select("n", "r.*", F.col("failed").bitwiseAND(F.col("r.mask")).alias("broken"))
    of = lambda kept: F.sum(F.when(kept, F.col("n")).otherwise(0))
    broken, bit = F.col("broken"), F.col("bit")
    return each.groupBy("policy", "rule").agg(F.sum("n").alias("n_rows"), of(broken == 0).alias("n_kept"), of(broken.bitwiseAND(bit) != 0).alias("n_failed"), of(broken == bit).alias("n_only"))

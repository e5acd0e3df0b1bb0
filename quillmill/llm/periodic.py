"""Periodic runs: stretches of words that repeat with a period, by bit-parallel comparison at each lag.

The words of a text are numbered, and bit b of all numbers is one big integer, a plane. A plane XOR itself shifted by a
lag has a bit for every word that differs from the one a lag further on; OR over the planes gives all differing words.
A stretch of L equal bits is what is left of the others after shifted ANDs, the shift doubling up to L.

Lags below ``DENSE_LAGS`` are all compared. A run of a longer period q, with Q <= q < 2 Q, has four periods, so it holds
a multiple of Q where Q words recur q words further on; other lags are left out unseen. Rolling hashes find where that
is so, and a hash that agrees by chance only adds a lag. So the work grows with n log n and the runs, not with n squared.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words that a run has at least, and its periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
DENSE_LAGS = 64
#: Planes after which a lag that has no stretch left is given up.
FIRST_PLANES = 2
#: An odd factor of the rolling hash, modulo 2 ** 64, and its inverse.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
_SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_SPAN)), ("best", _SPAN), ("collapsed", pa.string())])
FOUND = "struct<n_words: long, runs: array<struct<start: long, length: long, period: long>>, best: struct<start: long, length: long, period: long>, collapsed: string>"


def _planes(ids: np.ndarray) -> list[int]:
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(int(ids.max()).bit_length())]


def _begins(same: int, least: int) -> int:
    """The bits of ``same`` that begin ``least`` set bits in a row."""
    have = 1
    while have < least and same:
        step = min(have, least - have)
        same &= same >> step
        have += step
    return same


def _stretches(planes: list[int], n: int, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of all stretches of words that have the period ``lag`` and are long enough for a run."""
    mask, differ, begins = (1 << (n - lag)) - 1, 0, 0
    least = max(LEAST_WORDS, LEAST_PERIODS * lag) - lag
    for part in (planes[:FIRST_PLANES], planes[FIRST_PLANES:]):
        for plane in part:
            differ |= plane ^ (plane >> lag)
        begins = _begins(mask ^ (differ & mask), least)
        if not begins:
            return np.empty(0, np.int64), np.empty(0, np.int64)
    bits = np.unpackbits(np.frombuffer(begins.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")
    edges = np.flatnonzero(np.diff(bits, prepend=0, append=0))
    return edges[::2], edges[1::2] + (least - 1 + lag)


def _recurring_lags(prefix: np.ndarray, inverse: np.ndarray, q: int, known: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Lags from q to below 2 q at which q words, from a multiple of q on, recur.

    Inside a run of a period of q at most nothing else begins, so what recurs in it is left out; the overlap of two
    runs of different periods is shorter than the periods together.
    """
    grams = (prefix[q:] - prefix[:-q]) * inverse[: len(prefix) - q]
    rows = np.zeros((-(-len(grams) // q), q), np.uint64)
    rows.reshape(-1)[: len(grams)] = grams
    within = np.zeros(len(rows) - 1, np.int64)  # up to this lag the run around an anchor accounts for what recurs
    anchors = np.arange(len(within)) * q
    for period, (starts, ends) in known.items():
        if period <= q:
            for s, e in zip(starts[ends - starts >= q].tolist(), ends[ends - starts >= q].tolist(), strict=True):
                inside = slice(-(-s // q), e // q)
                np.maximum(within[inside], e - period - anchors[inside], out=within[inside])
    k, place = np.nonzero(rows[1:] == rows[:-1, :1])
    return np.unique(q + place[q + place > within[k]])


def _lags(ids: np.ndarray, known: dict) -> Iterator[int]:
    most = len(ids) // LEAST_PERIODS
    yield from range(1, min(most + 1, DENSE_LAGS))
    if most < DENSE_LAGS:
        return
    n = len(ids)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(FACTOR)
    power = np.full(n, FACTOR, np.uint64)
    inverse = np.full(n + 1, INVERSE, np.uint64)
    power[0] = inverse[0] = 1
    np.cumprod(power, out=power)
    np.cumprod(inverse, out=inverse)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * power, dtype=np.uint64)])
    q = DENSE_LAGS
    while q <= most:
        yield from (lag for lag in _recurring_lags(prefix, inverse, q, known).tolist() if lag <= most)
        q *= 2


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a list of numbers, by start, then period.

    A stretch that has a shorter period as well lies in a run of a divisor of its period, which was found before.
    """
    n, found = len(ids), []
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    if n < LEAST_WORDS:
        return []
    planes = _planes(ids)
    for lag in _lags(ids, known):
        starts, ends = _stretches(planes, n, lag)
        for period, (s, e) in known.items():
            if len(starts) and lag % period == 0:
                at = np.searchsorted(s, starts, "right") - 1
                own = (at < 0) | (e[at] < ends)
                starts, ends = starts[own], ends[own]
        if len(starts):
            known[lag] = (starts, ends)
            found += zip(starts.tolist(), (ends - starts).tolist(), [lag] * len(starts), strict=True)
    return sorted(found, key=lambda r: (r[0], r[2]))


def _kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each word stays: not one in a run, behind that run's first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def analysed(text: bytes | None) -> dict:
    """The runs of one text, and its words without what runs repeat."""
    words = (text or b"").split()  # on the six ASCII blanks, as bytes have no others
    number: dict[bytes, int] = {}
    runs = runs_of(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
    span = lambda r: dict(zip(("start", "length", "period"), r, strict=True))
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    left = words if not runs else [w for w, keep in zip(words, _kept(len(words), runs).tolist(), strict=True) if keep]
    return {"n_words": len(words), "runs": [span(r) for r in runs], "best": best and span(best), "collapsed": b" ".join(left).decode("utf-8", "replace")}


def periodic_runs(text: Column) -> Column:
    """n_words, runs, best and collapsed of a text, as a struct; whatever else the table has stays beside it.

    Words are what the six ASCII blanks part, case counts. A run is a stretch of words with a smallest period q, of
    at least ``max(6, 4 q)`` words, that neither neighbour extends; ``runs`` lists them by start and period, ``best``
    is the one of most periods (ties: the earliest, then the shorter period), NULL without any. ``collapsed`` is the
    words outside of runs and the first period of each run, with single blanks. Runs may overlap. A NULL, empty or
    blank text has no words, no runs and collapses to the empty text. Rows do not depend on each other, so repeated
    rows and an empty table are as they are. A text of any length is read whole; memory grows with its words.
    """
    @F.arrow_udf(FOUND)
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([analysed(t.as_py()) for t in texts], _FOUND)

    return found(text.cast("binary"))


def planted_runs(doc_id: Column, text: Column) -> Column:
    """Every tenth document, by its id, with its words from some place on replaced by repetitions of the first of them.

    h = crc32 of the id as text, g = h / 10. Where h % 10 = 0 each word i from a = g % n on becomes word
    a + (i - a) % p with p = 1 + (n - a) / (3 + g % 8). A text without words, or of a NULL id, stays as it is.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, g = F.size(words).cast("long"), F.floor(h / F.lit(10))
    at = F.pmod(g, n)
    period = F.floor((n - at) / (F.lit(3) + F.pmod(g, F.lit(8)))) + 1
    whole = lambda c: c.cast("int")
    repeated = F.flatten(F.array_repeat(F.slice(words, whole(at) + 1, whole(period)), whole(F.ceil((n - at) / period))))
    edited = F.array_join(F.concat(F.slice(words, F.lit(1), whole(at)), F.slice(repeated, F.lit(1), whole(n - at))), " ")
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), edited).otherwise(text)

"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads whole texts, byte by byte in both directions, and gives every position a probability for each
language. Texts are read in windows, for numpy works on many at once; each direction begins OVERLAP bytes before the
positions of its window that count, so states carry over blanks, words and the edges of windows. It is trained in
numpy by backpropagation through time on a bounded sample of stretches of text. A document's probability is the
normalised geometric mean over all of its positions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder

#: Documents and stretches of each that the network is trained on at most, over all languages, and a stretch's bytes.
SAMPLE_DOCS, SAMPLE_PIECES, PIECE_BYTES = 6000, 64, 32
HIDDEN, BATCH, STEPS, RATE = 16, 256, 600, 0.02
#: Positions of a window that count, bytes read before and after them, windows that are read at once.
WINDOW, OVERLAP, AT_ONCE = 128, 16, 512
#: Bytes of text that wait at most until they are read together, besides one text.
WAITING = 4 << 20
#: Least probability that a position can give a language.
FLOOR = 1e-4
FOLDS, HELD_OUT = 4, 2
LETTER = r"[^\W\d_]"


def plain(text: str) -> bytes:
    """The bytes of a text with single blanks between its words and one behind the last."""
    return b" ".join([*text.encode().split(), b""])


def windows(data: bytes):
    """(windows, OVERLAP + WINDOW + OVERLAP) bytes, with blanks before and behind the text."""
    import numpy as np

    n = -(-len(data) // WINDOW)
    padded = np.frombuffer(b" " * OVERLAP + data + b" " * (n * WINDOW - len(data) + OVERLAP), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW + 2 * OVERLAP)[::WINDOW]


class Network:
    """Parameters by name; forward and backward over stretches of one length."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> None:
        import numpy as np

        rng = np.random.default_rng(seed)
        uniform = lambda *shape: rng.uniform(-1, 1, shape).astype(np.float32) / np.float32(math.sqrt(hidden))
        self.languages, self.hidden = languages, hidden
        self.p = {"out": uniform(2 * hidden, len(languages)), "bias": np.zeros(len(languages), np.float32)}
        for d in ("fore", "back"):
            self.p |= {f"{d}_in": uniform(256, 3 * hidden), f"{d}_gates": uniform(hidden, 2 * hidden), f"{d}_new": uniform(hidden, hidden)}

    def _run(self, d: str, x, keep: bool):
        """States after each byte, in reading order; what backward needs if keep."""
        import numpy as np

        h, n = np.zeros((len(x), self.hidden), np.float32), self.hidden
        into, gates, new = (self.p[f"{d}_{k}"] for k in ("in", "gates", "new"))
        states, kept = [], []
        for t in range(x.shape[1]):
            e = into[x[:, t]]
            g = 1 / (1 + np.exp(-(e[:, : 2 * n] + h @ gates)))
            r, z = g[:, :n], g[:, n:]
            u = h @ new
            c = np.tanh(e[:, 2 * n :] + r * u)
            if keep:
                kept.append((h, r, z, u, c))
            h = c + z * (h - c)
            states.append(h)
        return states, kept

    def _read(self, d: str, x):
        """(positions, hidden, stretches): k = (1 - h) / 2 for the states h of _run, in fewer steps and with the stretches side by side in memory.

        k is carried instead of h so that gates and new states alike are 1 / (1 + exp(a)), a from weights
        that are scaled beforehand. exp may overflow to infinity, which gives 0 as it should.
        """
        import numpy as np

        n, two = self.hidden, np.float32(2)
        into, gates, new = (self.p[f"{d}_{k}"] for k in ("in", "gates", "new"))
        # -(e + (1 - 2 k) G) for the gates; 2 (e + r (1 - 2 k) N) for the new state, of which 2 (1 - 2 k) N comes from the product
        into = np.concatenate([-into[:, : 2 * n] - gates.sum(0), two * into[:, 2 * n :]], 1)
        both = np.ascontiguousarray(np.concatenate([two * gates, -2 * two * new], 1).T)
        once = two * new.sum(0)[:, None]
        at = np.ascontiguousarray(x.T).astype(np.intp)
        k, e, a = np.full((n, len(x)), 0.5, np.float32), np.empty((len(x), 3 * n), np.float32), np.empty((3 * n, len(x)), np.float32)
        g, c, r, z = a[: 2 * n], a[2 * n :], a[:n], a[n : 2 * n]
        states = np.empty((x.shape[1], n, len(x)), np.float32)
        with np.errstate(over="ignore"):
            for t in range(x.shape[1]):
                np.take(into, at[t], 0, out=e, mode="clip")
                np.matmul(both, k, out=a)
                g += e.T[: 2 * n]
                np.exp(g, out=g)
                g += 1
                np.reciprocal(g, out=g)
                c += once
                c *= r
                c += e.T[2 * n :]
                np.exp(c, out=c)
                c += 1
                np.reciprocal(c, out=c)  # (1 - tanh) / 2
                k = np.subtract(k, c, out=states[t])
                k *= z
                k += c
        return states

    @staticmethod
    def _shares(logits):
        import numpy as np

        logits -= logits.max(-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(-1, keepdims=True)
        return logits

    def probabilities(self, x, keep: bool = False):
        """(stretches, positions) of bytes -> (stretches, positions, languages)."""
        import numpy as np

        fore, f_kept = self._run("fore", x, keep)
        back, b_kept = self._run("back", x[:, ::-1], keep)
        states = np.concatenate([np.stack(fore, 1), np.stack(back[::-1], 1)], 2)
        logits = self._shares(states @ self.p["out"] + self.p["bias"])
        return (logits, states, f_kept, b_kept) if keep else logits

    def log_probabilities(self, x, before: int, behind: int):
        """(positions, stretches, languages) without the first ``before`` and last ``behind`` positions, which are read only."""
        import numpy as np

        end, n = x.shape[1] - behind, self.hidden
        fore = self._read("fore", x[:, :end])[before:]
        back = self._read("back", x[:, before:][:, ::-1])[behind:][::-1]
        out = (np.float32(-2) * self.p["out"]).T  # h = 1 - 2 k
        p = np.matmul(np.ascontiguousarray(out[:, :n]), fore)
        p += np.matmul(np.ascontiguousarray(out[:, n:]), back)
        p += (self.p["bias"] + self.p["out"].sum(0))[:, None]
        p -= p.max(1, keepdims=True)
        p -= np.log(np.exp(p).sum(1, keepdims=True))
        return np.maximum(p, np.float32(math.log(FLOOR)), out=p).transpose(0, 2, 1)

    def _through_time(self, d: str, x, kept, outer, grads) -> None:
        import numpy as np

        n, gates, new = self.hidden, self.p[f"{d}_gates"], self.p[f"{d}_new"]
        down = np.zeros((len(x), n), np.float32)
        inputs = np.empty((x.shape[1], len(x), 3 * n), np.float32)
        for t in range(x.shape[1] - 1, -1, -1):
            h, r, z, u, c = kept[t]
            down = down + outer[t]
            dc = down * (1 - z) * (1 - c * c)
            dr = dc * u * r * (1 - r)
            dz = down * (h - c) * z * (1 - z)
            dg = np.concatenate([dr, dz], 1)
            du = dc * r
            inputs[t] = np.concatenate([dg, dc], 1)
            grads[f"{d}_gates"] += h.T @ dg
            grads[f"{d}_new"] += h.T @ du
            down = down * z + dg @ gates.T + du @ new.T
        np.add.at(grads[f"{d}_in"], x.T.ravel(), inputs.reshape(-1, 3 * n))

    def gradients(self, x, y):
        """Mean cross-entropy over positions, and its gradients; y has each piece's language."""
        import numpy as np

        p, states, f_kept, b_kept = self.probabilities(x, keep=True)
        size = np.float32(x.size)
        loss = -np.log(np.maximum(p[np.arange(len(y)), :, y], 1e-9)).mean()
        delta = p.copy()
        delta[np.arange(len(y)), :, y] -= 1
        delta /= size
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        flat, n = delta.reshape(-1, delta.shape[2]), self.hidden
        grads["out"] += states.reshape(-1, 2 * n).T @ flat
        grads["bias"] += flat.sum(0)
        outer = (delta @ self.p["out"].T).transpose(1, 0, 2)
        self._through_time("fore", x, f_kept, outer[:, :, :n], grads)
        self._through_time("back", x[:, ::-1], b_kept, outer[::-1, :, n:], grads)
        return loss, grads


def train(samples: list[tuple[str, bytes]], steps: int = STEPS, seed: int = 7) -> Network | None:
    """Adam over batches of stretches of one length, languages drawn alike often."""
    import numpy as np

    languages = sorted({lang for lang, _ in samples})
    if not languages:
        return None
    net, rng = Network(languages, seed=seed), np.random.default_rng(seed)
    by_length: dict[int, list[list[bytes]]] = {}
    for lang, piece in sorted(samples):
        by_length.setdefault(len(piece), [[] for _ in languages])[languages.index(lang)].append(piece)
    lengths = sorted(by_length)
    weights = np.array([sum(map(len, by_length[n])) for n in lengths], float)
    data = {n: [np.frombuffer(b"".join(ps), np.uint8).reshape(-1, n) for ps in by_length[n]] for n in lengths}
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        n = lengths[rng.choice(len(lengths), p=weights / weights.sum())]
        held = [k for k, d in enumerate(data[n]) if len(d)]
        y = rng.choice(held, BATCH)
        x = np.stack([data[n][k][rng.integers(len(data[n][k]))] for k in y])
        _, grads = net.gradients(x, y)
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            net.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> stretches with letters, at most SAMPLE_PIECES distinct ones of a text, spread by hash."""
    import re

    import xxhash

    letter = re.compile(LETTER).search
    for batch in batches:
        rows = []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = plain(text)
            held = {data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)}
            rows += [(lang, p) for p in sorted((p for p in held if letter(p.decode("utf-8", "ignore"))), key=lambda p: (xxhash.xxh64_intdigest(p), p))[:SAMPLE_PIECES]]
        yield pa.RecordBatch.from_pydict({"lang": pa.array([r[0] for r in rows], pa.string()), "piece": pa.array([r[1] for r in rows], pa.binary())})


def sample(docs: DataFrame, count: int = SAMPLE_DOCS) -> list[tuple[str, bytes]]:
    """(lang, stretch) of about as many documents of each language, chosen by a hash of the id."""
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return []
    each = max(1, count // len(sizes))
    below = lambda n: min((1 << 63) - 1, each * (1 << 64) // n - (1 << 63))  # noqa: E731  a share of all hashes, exact for any number of rows
    most = F.coalesce(*(F.when(F.col("lang") == lang, F.lit(below(n)).cast("long")) for lang, n in sorted(sizes.items())))
    chosen = docs.where(F.xxhash64("doc_id") <= most).select("lang", "text")
    rows = chosen.mapInArrow(_sampled, "lang string, piece binary").toArrow()
    return list(zip(rows.column("lang").to_pylist(), rows.column("piece").to_pylist(), strict=True))


def judged(net: Network, texts: list[bytes]) -> list[tuple[str, float]]:
    """(language, probability) of each text, none of which is empty."""
    import numpy as np

    held = [windows(t) for t in texts]
    begins = np.concatenate([[0], np.cumsum([len(w) for w in held])])
    x = np.concatenate(held)
    sums = np.zeros((len(x), len(net.languages)), np.float64)
    left = np.full(len(x), WINDOW)  # positions of each window that are text
    left[begins[1:] - 1] = [len(t) - (len(w) - 1) * WINDOW for t, w in zip(texts, held, strict=True)]
    for at in range(0, len(x), AT_ONCE):
        logs = net.log_probabilities(x[at : at + AT_ONCE], OVERLAP, OVERLAP)
        counts = np.arange(WINDOW)[:, None] < left[None, at : at + AT_ONCE]
        sums[at : at + AT_ONCE] = np.einsum("tbl,tb->bl", logs, counts, dtype=np.float64)
    mean = np.add.reduceat(sums, begins[:-1]) / np.array([len(t) for t in texts])[:, None]
    p = Network._shares(mean)
    best = p.argmax(1)
    return [(net.languages[k], float(p[i, k])) for i, k in enumerate(best)]


def _predict(batches: Iterator[pa.RecordBatch], net: Network | None) -> Iterator[pa.RecordBatch]:
    """Reads as many documents together as hold WAITING bytes, or one that is longer."""
    import re

    letter, waiting, size = re.compile(LETTER).search, [], 0

    def read():
        found = iter(judged(net, texts) if (texts := [t for _, t in waiting if t]) else [])
        rows = [(doc_id, *(next(found) if text else ("und", 0.0))) for doc_id, text in waiting]
        waiting.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.float64()), strict=True)], ["doc_id", "lang_pred", "score"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = plain(text) if net and text and letter(text) else b""
            waiting.append((doc_id, data))
            size += len(data) + 64
            if size > WAITING:
                yield read()
                size = 0
    if waiting:
        yield read()


def identify(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, steps: int = STEPS) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    Learns from documents with a language whose crc32 of the id leaves another remainder than ``held_out``.
    Texts that are null or hold no letter, and all if there is nothing to learn from, are ``und`` with score 0.
    Null ids count as the empty text; repeated rows stay; other columns are ignored. Blanks count as one each.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    held = id_remainder(F.col("doc_id"), folds) == held_out
    net = train(sample(docs.where(~held & F.col("lang").isNotNull() & F.col("text").isNotNull())), steps)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    found = docs.select("doc_id", "text").mapInArrow(lambda b: _predict(b, shared.value), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (id_remainder(F.col("doc_id"), folds) == held_out).alias("held_out"), "lang_pred", "score")

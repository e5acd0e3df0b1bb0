"""The operators against brute force, round trips and held-out accuracy, and on nulls, ties, repeats and empty tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import components, decontaminate, langid, line_dedup, oracles, packing, ppm, queries, simhash, sketch, toxicity, url_filter, warc

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, words string"
WORDS = "the of and to in is was for on with as by at from red blue green stone river house little".split()


def texts(seed: int, n: int) -> list[str]:
    rnd = random.Random(seed)
    made = [" ".join(rnd.choice(WORDS) + rnd.choice(["", "", ",", "."]) for _ in range(rnd.randint(1, 60))) for _ in range(n)]
    return [t.replace(". ", ".\n") for t in made]


#: Null ids and texts, empty and blank texts, copies, a long text, and columns whose names operators use themselves.
ODD = [(None, "no id at all here", "en"), (7, None, "en"), (8, "", None), (9, " \n \t\n", "de"), (10, "Straße ÉCOLE", "de"), (11, "same text", "en"), (11, "same text", "en"), (12, "same text", None), (13, "word " * 5000, "en"), (14, "...!!", "en")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t), "clash", "clash") for i, t in enumerate(texts(1, 60), 100)]
    return spark.createDataFrame(rows + [(i, t, lang, None, None, "x", "y") for i, t, lang in ODD], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def pairs(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# --- packing ---


def test_pack_keeps_every_token_once(docs):
    got = packing.pack_documents(docs, tiers=(64, 128, 256), group_bytes=8000).collect()
    encode = packing.encoder()
    expected = defaultdict(int)
    for doc_id, text in pairs(docs, "doc_id", "text"):
        expected[doc_id, encode(text)] += 1
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id, r.doc_tokens].append(r)
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 256 and end & (end - 1) == 0  # a power of two needs no padding
    assert sum(r.length for r in got) == sum(len(ids) // 4 * n for (_, ids), n in expected.items())
    for (doc_id, ids), n in expected.items():
        held = by_doc[doc_id, len(ids) // 4]
        if n == 1:
            end = 0
            for r in sorted(held, key=lambda r: r.start):
                assert r.start == end and r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)])
                end += r.length
            assert 4 * end == len(ids)


def test_pack_empty(empty):
    assert packing.pack_documents(empty).count() == 0


def test_steps_are_balanced_over_groups(docs):
    got = packing.pack_documents(docs, tiers=(64, 128, 256), group_bytes=2000, step_tokens=1024).collect()
    sizes = {r.sequence_id: r.tier for r in got}
    steps, by_tier = defaultdict(set), defaultdict(list)
    for r in got:
        steps[r.step_group].add(r.sequence_id)
    for sequences in steps.values():
        (tier,) = {sizes[s] for s in sequences}
        assert len(sequences) * tier <= 1024
        by_tier[tier].append(len(sequences))
    assert len({s >> 32 for s in sizes}) > 3 and max(map(len, by_tier.values())) > 1
    for tier, lengths in by_tier.items():
        assert max(lengths) - min(lengths) <= 1 and len(lengths) == -(-sum(lengths) // (1024 // tier))


def test_copies_of_a_row_are_dealt_to_many_groups(spark):
    docs = spark.range(400).select(F.lit(1).alias("doc_id"), F.lit("one and the same text of some words").alias("text"))
    got = packing.pack_documents(docs, tiers=(64, 128), group_bytes=1000).collect()
    assert len(got) >= 400 and len({r.sequence_id >> 32 for r in got}) > 5


def test_chunked_encoding_equals_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    model, encode, rnd = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER)), packing.encoder(), random.Random(3)
    samples = ["".join(rnd.choice("abXÉß019 \n\t'.,!<|>&日本́​İſ_-") for _ in range(40)) for _ in range(500)] + ["<|endoftext|> x", "it's We'LL"]
    for text in samples:
        assert np.frombuffer(encode(text), "<u4").tolist() == [*model.encode(text, add_special_tokens=False).ids, packing.END_ID]


# --- WARC ---


def test_warc_round_trip(spark):
    big, small = "x" * 3_000_000, "tiny"
    rows = [(1, "http://a/\n b", "p" * 200), (2, None, "p" * 200), (3, "http://c", small), (4, "http://d", small), (5, "http://e", None), (6, "http://f", big), (1, "http://a", "p" * 200), (None, "http://g", "p" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    manifest = warc.write_warc(pages, archive_bytes=300)
    got = warc.read_warc(manifest).collect()
    assert len(got) == len(rows) and all(r.digest_ok for r in got)
    sha = lambda s: hashlib.sha256((s or "").encode()).hexdigest()
    kinds = {None: ("revisit", 1), 1: ("response", None), 2: ("revisit", 1), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    html = {**{i: h for i, _, h in rows}}
    for r in got:
        assert (r.record_type, r.refers_to) == kinds[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len((html[r.page_id] or "").encode()), sha(html[r.page_id]))
    assert warc.roundtrip(spark, pages.limit(0)).count() == 0


def test_warc_members_and_damage():
    import gzip
    import io

    data = warc.record(1, "http://a", b"abc", hashlib.sha256(b"abc").hexdigest(), None)
    assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: response")
    assert [r["payload_bytes"] for r in warc.records(io.BytesIO(data * 3))] == [3, 3, 3]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data[:-20])))
    wrong = warc.record(1, "http://a", b"abc", "0" * 64, None)
    assert [r["digest_ok"] for r in warc.records(io.BytesIO(wrong))] == [False]


# --- URLs ---


def test_urls(spark):
    urls = ["http://x.COM/en/1", "https://example.com/en/7a?b", "ftp://sub.example.net/de/8#x", "http://example.net/de/7", "http://notcom/en/1", "http://a.com/EN/1", "no url", None, "http://adult-x.example.com", "http://www.adult-x.example.com/q", "http://É.org/es/", "a://b://c/d"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, url_filter.entries(spark)).collect()}
    assert got == {
        0: ("x.com", "/en/1", "com/en/", "block"), 1: ("example.com", "/en/7a", "example.com/en/7", "allow"), 2: ("sub.example.net", "/de/8", "example.net/de/8", "block"), 3: ("example.net", "/de/7", "net/de/", "allow"),
        4: ("notcom", "/en/1", None, "allow"), 5: ("a.com", "/EN/1", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("adult-x.example.com", "", None, "block"), 9: ("www.adult-x.example.com", "/q", None, "block"),
        10: ("É.org", "/es/", "org/es/", "block"), 11: ("b:", "//c/d", None, "allow"),
    }
    assert url_filter.judge_urls(pages, url_filter.entries(spark).limit(0)).where("verdict = 'block'").count() == 0


def test_urls_with_a_long_list(spark):
    hosts = [("block", f"h{i}.test", "/") for i in range(20_000)] + [("block", "both.test", "/a"), ("allow", "both.test", "/a")]
    urls = [f"http://www.h{i}.test/x" for i in range(0, 40_000, 37)] + ["http://both.test/ab", "http://both.test/ab", "http://both.test"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(pages, url_filter.entries(spark, listed=hosts)).collect()}
    expected = ["block" if i < 20_000 else "allow" for i in range(0, 40_000, 37)] + ["block", "block", "allow"]
    assert [got[i] for i in range(len(urls))] == expected
    assert url_filter.judge_urls(pages.limit(0), url_filter.entries(spark)).count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    bits = url_filter.bloom_filter(keys)
    assert url_filter.passing(keys, bits).count() == 5000
    assert url_filter.passing(keys.select(F.concat(F.lit("other"), "key").alias("key")), bits).count() < 500


# --- sketches ---


def test_neighbours(docs, empty):
    got = sketch.compare_neighbours(docs, bucket_bytes=4000).collect()
    rows = sorted(((i if i is not None else -(1 << 63), t or "", i) for i, t in pairs(docs, "doc_id", "text")), key=lambda r: (-r[0], r[1]))
    expected = [(i, hashlib.sha256(sketch.edited(t, rows[(at + 1) % len(rows)][1]).encode()).hexdigest()) for at, (_, t, i) in enumerate(rows)]
    assert sorted((r.doc_id or -1, r.edited_sha256) for r in got) == sorted((i or -1, h) for i, h in expected)
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[11] == prints[12] != prints[10]
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert sketch.compare_neighbours(empty).count() == 0
    alone = sketch.compare_neighbours(docs.where("doc_id = 10")).first()
    assert alone.near_next == 1.0


def test_likenesses_against_all_shingles(spark):
    """Short texts keep every shingle, so their values are exact; long ones are near it."""
    rnd = random.Random(6)
    made = [[rnd.choice(WORDS) + str(rnd.randint(0, 50)) for _ in range(n)] for n in (12, 30, 60, 3000, 3000)]
    made.append(made[-1][:2000] + made[3][:800])
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(made)], "doc_id long, text string")
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    texts_ = {i: " ".join(w) for i, w in enumerate(made)}
    for r in sketch.compare_neighbours(docs, bucket_bytes=20_000).collect():
        after = texts_[(r.doc_id - 1) % len(made)]
        own = shingles(texts_[r.doc_id])
        for other, near, held in ((sketch.edited(texts_[r.doc_id], after), r.near_edited, r.contained_edited), (after, r.near_next, r.contained_next)):
            other = shingles(other)
            off = 1e-9 if max(len(own), len(other)) < sketch.FEW else 0.12
            assert abs(near - len(own & other) / len(own | other)) <= off and abs(held - len(own & other) / len(own)) <= off


def test_estimates_and_merge():
    s, rnd = sketch.Shingler(), random.Random(5)
    words = [f"w{rnd.randint(0, 10**6)}" for _ in range(20_000)]
    whole, part, other = (s.sketch(" ".join(w)) for w in (words, words[:2000], words[10_000:]))
    assert sketch.from_text(sketch.as_text(whole))[0] == sketch.LEVEL
    assert sketch.containment(part, whole) > 0.95 and abs(sketch.containment(whole, other) - 0.5) < 0.1
    first = s.sketch(" ".join(words[:10_004]))
    assert abs(sketch.likeness(sketch.merged(first, other), whole) - 1) < 0.02
    assert sketch.likeness(s.sketch(""), s.sketch(" ")) == 1.0 and sketch.likeness(s.sketch(""), s.sketch("a")) == 0.0


# --- languages ---


def test_gradients():
    net = langid.Network(["a", "b", "c"], hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 5, (6, 5)).astype(np.uint8), rng.integers(0, 3, 6)
    _, grads = net.gradients(x, y)
    for k, v in net.p.items():
        at = np.unravel_index(np.abs(grads[k]).argmax(), v.shape)
        kept, ends = v[at], []
        for step in (1e-4, -1e-4):
            v[at] = kept + step
            ends.append(net.gradients(x, y)[0])
        v[at] = kept
        assert abs((ends[0] - ends[1]) / 2e-4 - grads[k][at]) < 1e-6


def test_language_on_held_out(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = langid.identify(docs, steps=400).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.9 * len(rows)


def read_by_loop(net, data: bytes) -> list[list[float]]:
    """Log-probabilities of each byte of a text, from sums over single numbers, for windows and overlaps as documented."""
    import math

    n, p = net.hidden, net.p

    def state(d, h, byte):
        e = p[f"{d}_in"][byte].tolist()
        dot = lambda m, k: sum(h[i] * float(m[i][k]) for i in range(n))
        gate = [1 / (1 + math.exp(-(e[k] + dot(p[f"{d}_gates"], k)))) for k in range(2 * n)]
        new = [math.tanh(e[2 * n + k] + gate[k] * dot(p[f"{d}_new"], k)) for k in range(n)]
        return [gate[n + k] * h[k] + (1 - gate[n + k]) * new[k] for k in range(n)]

    padded = b" " * langid.OVERLAP + data + b" " * (langid.WINDOW + langid.OVERLAP)
    found = []
    for at in range(0, len(data), langid.WINDOW):
        window = padded[at : at + langid.WINDOW + 2 * langid.OVERLAP]
        fore, back, h = [], [], [0.0] * n
        for byte in window:
            h = state("fore", h, byte)
            fore.append(h)
        h = [0.0] * n
        for byte in reversed(window):
            h = state("back", h, byte)
            back.insert(0, h)
        for t in range(langid.OVERLAP, langid.OVERLAP + min(langid.WINDOW, len(data) - at)):
            logit = [sum(v * float(p["out"][i][k]) for i, v in enumerate(fore[t] + back[t])) + float(p["bias"][k]) for k in range(len(net.languages))]
            total = sum(map(math.exp, logit))
            found.append([math.log(max(math.exp(v) / total, langid.FLOOR)) for v in logit])
    return found


def test_language_of_whole_texts_against_loop():
    import math

    samples = [(lang, t.encode()[i : i + 32]) for lang, t in (("xx", "aba abba bab " * 40), ("yy", "bcb cbbc bcc " * 40)) for i in range(0, 300, 7)]
    net = langid.train(samples, steps=30)
    held = [langid.plain(t) for t in ("ab", "aba bcb " * 40, "abba", "x" * 128, "bab " * 64, "cbbc\n\nbcb  " + "bcc aba " * 17)]
    for data, (lang, score) in zip(held, langid.judged(net, held), strict=True):
        logs = read_by_loop(net, data)
        mean = [sum(c) / len(data) for c in zip(*logs, strict=True)]
        p = [math.exp(m - max(mean)) for m in mean]
        assert len(logs) == len(data) and abs(max(p) / sum(p) - score) < 1e-4 and lang == net.languages[p.index(max(p))]


def test_states_carry_over_blanks():
    net = langid.Network(["a", "b"], seed=3)
    x = np.frombuffer(b"one two three  ten two three  ", np.uint8).reshape(2, 15)
    logs = net.log_probabilities(x, 0, 0)
    assert np.abs(logs[5, 0] - logs[5, 1]).max() > 1e-6  # in the second word, behind different first ones
    assert np.abs(net.log_probabilities(x, 4, 4) - logs[4:-4]).max() < 1e-5
    assert np.abs(np.exp(logs.transpose(1, 0, 2)) - net.probabilities(x)).max() < 1e-5


def test_states_of_large_weights():
    """Reading carries (1 - h) / 2 from 1 / (1 + exp(a)), also where exp overflows."""
    import warnings

    net = langid.Network(["a", "b", "c"], seed=5)
    x = np.random.default_rng(5).integers(0, 256, (7, 40)).astype(np.uint8)
    for scale in (1, 4, 4000):
        net.p = {k: v * np.float32(scale if "_in" in k else 1) for k, v in langid.Network(["a", "b", "c"], seed=5).p.items()}
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            states = 1 - 2 * net._read("fore", x)
        with np.errstate(over="ignore"):
            assert states.shape == (40, net.hidden, 7) and np.abs(states - np.stack(net._run("fore", x, False)[0]).transpose(0, 2, 1)).max() < 1e-5


def test_shipped_language_model(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet".replace("0.001", "0.01"))
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r.lang_pred == r.lang for r in rows) >= 0.99 * len(rows)


def test_language_odd(docs, empty):
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(docs, steps=5).collect()]
    assert len(got) == docs.count() and {p for i, p in got if i in (7, 8, 9, 14)} == {"und"} and {p for i, p in got if i in (10, 13)} <= {"en", "de"}
    assert langid.identify(empty, steps=5).count() == 0


# --- toxicity ---


def test_segments_against_brute_force():
    rnd = random.Random(2)
    for _ in range(300):
        n = rnd.randint(1, 14)
        scores = [rnd.choice([-0.4, -0.4, 1.0, 2.5]) for _ in range(n)]
        at = [i for i, s in enumerate(scores) if s > 0]
        got = toxicity.segments(at, [scores[i] for i in at], -0.4)

        def maximal(lo, hi):
            best = max(((sum(scores[b:e]), -(e - b), -b, e) for b in range(lo, hi) for e in range(b + 1, hi + 1)), default=None)
            if not best or best[0] <= 0:
                return []
            b, e = -best[2], best[3]
            return [*maximal(lo, b), (b, e, best[0]), *maximal(e, hi)]

        expected = maximal(0, n)
        assert abs(sum(s for _, _, s in got) - sum(s for _, _, s in expected)) < 1e-9
        assert len(got) == len(expected)


def test_toxicity_on_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet".replace("0.001", "0.01")) for t in ("documents", "labels"))
    rows = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.9 * len(rows)


def test_toxicity_odd(spark, docs, empty):
    labels = spark.createDataFrame([(100, 1), (100, 0), (101, 0), (None, 1), (102, None)], "doc_id long, toxic int")
    for held in (labels, labels.limit(0)):
        got = toxicity.score_toxicity(docs, held).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.score_toxicity(empty, labels).count() == 0


# --- lines ---


def removed_by_loop(rows):
    split = lambda s: frozenset(w for w in re.split(r"[\x20\x09-\x0D]+", s.lower()) if w)
    seen, out = [], {}
    for i, text in rows:
        kept = []
        for line in text.split("\n"):
            words = split(line)
            if not words or not any(len(words & s) * 100 >= len(words | s) * 80 for s in seen):
                kept.append(line)
            if words:
                seen.append(words)
        out[i] = "\n".join(kept)
    return out


def test_lines_against_loop(spark):
    rnd, base = random.Random(4), texts(6, 25)
    rows = []
    for i in range(120):
        lines = rnd.choice(base).split("\n") + rnd.choice(base).split("\n")
        if rnd.random() < 0.6:
            at = rnd.randrange(len(lines))
            words = lines[at].split(" ")
            words[rnd.randrange(len(words))] = rnd.choice(["zeta", "Eta", "THE"])
            lines[at] = " ".join(words)
        rows.append((i, "\n".join([*lines, "", " "])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} == removed_by_loop(rows)


def test_many_near_copies_of_a_line_against_loop(spark):
    """Some edits go beyond the similarity, and every word of the line is in many lines."""
    rnd, rows = random.Random(11), []
    base = [f"word{i}" for i in range(40)]
    for i in range(192):
        words = list(base)
        for at in rnd.sample(range(len(words)), rnd.randrange(1, 7)):
            words[at] = f"edit{i}x{at}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} == removed_by_loop(rows)


def test_lines_at_the_edge_of_the_similarity_against_loop(spark):
    """Words are left out of lines and put into them, of all lengths and up to the last word that the similarity allows."""
    rnd, rows = random.Random(12), []
    common = [f"c{i}" for i in range(60)]
    for i in range(260):
        base = rnd.sample(common, rnd.randint(0, 12)) + [f"w{i}x{k}" for k in range(rnd.randint(1, 24))]
        n = len(base)
        own = rnd.randint(0, n // 5)
        new = max(0, (n - own) // 4 - own + rnd.choice([0, 0, 0, 1, -1]))
        other = rnd.sample(base, n - own) + rnd.choice([[f"n{i}x{k}" for k in range(new)], rnd.sample(common, min(new, 60))])
        rnd.shuffle(other)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    rnd.shuffle(rows)
    expected = removed_by_loop(sorted(rows))
    assert 100 < sum(not text for text in expected.values()) < 260
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} == expected


def test_near_copies_of_a_line_meet_once(spark):
    """Two lines that share many keys of a large group meet in one row for all of these, and one for a key of fewer lines."""
    base = [f"word{i:02}" for i in range(40)]
    rows = [(i, " ".join(f"own{i}" if k == i else w for k, w in enumerate(base))) for i in range(40)]
    named = line_dedup._named(spark.createDataFrame(rows, "doc_id long, text string"), None)
    lines = line_dedup.distinct_lines(named)
    shared = line_dedup._shared(lines)
    keys = {}
    for r in line_dedup._entries(lines).collect():
        keys.setdefault(r.id, set()).add(r.key)
    met = line_dedup._met(shared, shared).collect()
    found = {}
    for r in met:
        found[r.x, r.y] = found.get((r.x, r.y), 0) + r["keys"]
    assert found == {(x, y): n for x in keys for y in keys if (x, y) in found for n in [len(keys[x] & keys[y])]}
    assert len(found) == 40 * 39 // 2 and sum(found.values()) > 10 * len(found) and len(met) < 2 * len(found)


def test_lines_of_large_and_small_groups_read_texts_once(spark, monkeypatch):
    """Near copies of a large group, some cut so far that they share no key of many lines, and lines on both sides of LONG words."""
    rnd, rows, names = random.Random(13), [], []
    base = [f"word{i}" for i in range(line_dedup.LONG + 4)]
    for i in range(90):
        words = list(base)
        for at in rnd.sample(range(len(words)), rnd.randrange(1, 12)):
            words[at] = f"edit{i}x{at}"
        rows.append((3 * i, " ".join(words)))
        own = [f"own{i}x{k}" for k in range(rnd.randint(1, line_dedup.LONG + 20))]
        rows += [(3 * i + 1, " ".join(own)), (3 * i + 2, " ".join(rnd.sample(own, len(own) - len(own) // rnd.choice([5, 4]))))]
    stored = line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", lambda df, name: names.append(name) or stored(df, name))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} == removed_by_loop(rows)
    assert names.count("candidate-lines") == names.count("keyed-entries") == 1 and "shared-keys" not in names


def test_lines_of_rows_that_share_an_id(spark):
    rows = [(None, "one line of words"), (None, "one line of words"), (5, "another line there\nand more\tof it"), (5, "and more of it"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("lines", F.lit(1))
    got = [(r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup_lines(docs).collect()]
    assert sorted(x[1:] for x in got if x[0] is None) == [("", 1), ("one line of words", 0)]
    assert sorted((x[2] for x in got if x[0] == 5)) == [0, 0, 1]


def test_lines_odd(docs, empty):
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    held = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in got.where("doc_id < 14").collect()}
    assert held[7] == (None, 0, 0) and held[8] == ("", 1, 0) and held[9] == (" \n \t\n", 3, 0) and held[12] == ("", 1, 1)
    assert sorted((r.text, r.n_removed) for r in got.where("doc_id = 11").collect()) == [("", 1), ("same text", 0)]
    assert got.where("doc_id is null").first().text == "no id at all here" and got.count() == docs.count()
    assert line_dedup.dedup_lines(empty).count() == 0


# --- decontamination ---


def test_decontamination_against_loop(spark, docs, empty):
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")
    held = [t for _, t in pairs(docs.where("doc_id >= 100"), "doc_id", "text")]
    items = [(1, held[3]), (2, " ".join(held[5].split()[4:20])), (10, "Straße ÉCOLE"), (3, "same"), (3, "red blue green red"), (None, held[7]), (4, ""), (5, None), (6, held[3]), (7, "no such words in any text at all whatever one may try")]
    got = decontaminate.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    windows = defaultdict(set)
    for i, text in items:
        w = words.findall(lower(text))
        for at in range(len(w) - min(10, len(w)) + 1) if w and i is not None else ():
            windows[tuple(w[at : at + 10])].add(str(i))
    expected = []
    for doc_id, text in pairs(docs, "doc_id", "text"):
        w, hit, found = words.findall(lower(text)), set(), set()
        for n in {len(k) for k in windows}:
            for at in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[at : at + n])):
                    found |= ids
                    hit |= set(range(at, at + n))
        expected.append((doc_id or -1, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    assert sorted((r.doc_id or -1, *tuple(r)[1:6]) for r in got) == sorted(expected)
    none = decontaminate.find_contamination(docs, spark.createDataFrame([], "item_id long, text string"))
    assert none.where("contaminated").count() == 0 and none.count() == docs.count()
    assert decontaminate.find_contamination(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0


# --- SimHash ---


def test_fingerprint_bits():
    import xxhash

    text, bits = "The cat SAT on\tthe mat the cat sat", [0] * 64
    w = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)]
    expected = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) & (1 << 64) - 1 == expected and bits
    assert simhash.fingerprint(None) == simhash.fingerprint(" ") == 0
    assert simhash.fingerprint("Ab cD") & (1 << 64) - 1 == xxhash.xxh64_intdigest("ab cd", 42)


def test_near_pairs_against_all_pairs(spark):
    rnd = random.Random(9)
    prints = {0}
    for _ in range(60):
        x = rnd.getrandbits(64)
        for _ in range(6):
            prints.add(x)
            for _ in range(rnd.randint(1, 3)):
                x ^= 1 << rnd.randrange(64)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = pairs(simhash.near_pairs(spark.createDataFrame([(p,) for p in signed], "fp long")), "a", "b")
    mask = (1 << 64) - 1
    expected = {frozenset((a, b)) for a in signed for b in signed if a != b and ((a ^ b) & mask).bit_count() <= 3}
    assert len(found) == len(expected) and {frozenset(p) for p in found} == expected


def test_near_duplicates_odd(docs, empty):
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs).collect()}
    by_id = {i: c for (i, _), c in got.items()}
    assert by_id[7] == by_id[8] == by_id[9] == 7 and by_id[11] == by_id[12] == 11 and by_id[None] is None
    assert simhash.near_duplicates(docs).count() == docs.count() and simhash.near_duplicates(empty).count() == 0


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(1, 40)] + [(rnd.randrange(100, 160), rnd.randrange(100, 160)) for _ in range(40)] + [(500, 500)]
    root = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = dict(pairs(components.connected_components(spark.createDataFrame(edges, "a long, b long")), "node", "root"))
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: root[n] for n in linked}


@pytest.mark.parametrize("edges", [[(1, 4), (3, 4), (3, 5), (2, 5)], [(6, 1), (6, 3), (3, 8), (8, 2), (2, 7), (7, 5), (5, 4)]])
def test_components_of_a_lone_path(spark, edges):
    got = pairs(components.connected_components(spark.createDataFrame(edges, "a long, b long")), "node", "root")
    assert sorted(got) == sorted((n, 1) for n in {n for e in edges for n in e})


# --- language model ---


def test_trie_gives_probabilities():
    grams = defaultdict(int)
    for word, n in (("ab", 5), ("ac", 2), ("b", 1), ("", 3)):
        coded = bytes([ppm.BEGIN]) + ppm.symbols(word)
        for end in range(2, len(coded) + 1):
            for begin in range(max(0, end - 4), end):
                grams[coded[begin:end]] += n
    nodes = ppm.trie(list(grams.items()))
    alphabet = [chr(c) for c in range(32, 256) if chr(c).strip()]
    known = sum(10 ** ppm.code_length(w, 0, nodes, 3) for w in ("", *alphabet, *(a + b for a in alphabet[:95] for b in alphabet[:95])))
    assert 0.7 < known <= 1.0 and ppm.code_length("ab", 0, nodes, 3) > ppm.code_length("ba", 0, nodes, 3)


def test_scores(spark):
    import math

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = ppm.score_documents(docs, frequent=50).collect()  # most words go through the join
    counts, held = defaultdict(int), {}
    for r in docs.collect():
        tokens = [*ppm.tokens(r.text), b""]
        held[r.doc_id] = tokens
        if zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
            for t in tokens:
                counts[t] += 1
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        base = sum(math.log10((counts.get(t, 0) + 0.5) / (n + 0.5 * (v + 1))) for t in held[r.doc_id])
        assert abs(base - r.base_score) < 1e-6 * abs(base) and r.score < 0
        assert (r.train_tokens, r.n_tokens, r.n_known) == (n, len(held[r.doc_id]), sum(t in counts for t in held[r.doc_id]))
    again = {r.doc_id: r.score for r in ppm.score_documents(docs, frequent=10_000).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 * abs(r.score) for r in rows)
    # the base gives all unknown words one share together, so it is hard to beat on few texts
    assert sum(r.score for r in rows if r.held_out) > 1.1 * sum(r.base_score for r in rows if r.held_out)
    assert sum(r.score for r in rows if not r.held_out) > 1.1 * sum(r.base_score for r in rows if not r.held_out)


def test_long_tokens_cost_alike_by_both_paths(spark):
    rnd = random.Random(8)
    long = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(5000))
    rows = [(i, t, "en") for i, t in enumerate(texts(2, 20))] + [(100, f"the house {long}", "en"), (101, f"{long} the {long} {long}", "en"), (102, "the house", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    joined, held = ({r.doc_id: r.score for r in ppm.score_documents(docs, frequent=n).collect()} for n in (5, 10_000))
    assert all(abs(joined[i] - held[i]) < 1e-6 * abs(held[i]) for i in held)
    assert joined[100] < joined[102] - 500 and joined[101] < -500


def test_scores_by_every_context_and_language(spark):
    """Ten languages and tables far smaller than the model, against a loop over all contexts of all training words."""
    import math

    rnd, order = random.Random(21), 3
    words = {k: ["".join(rnd.choice("abcdefghi") for _ in range(rnd.randint(1, 7))) + "zyxwvutsrq"[k] for _ in range(30)] for k in range(10)}
    rows = [(i, " ".join(rnd.choice(words[i % 10]) for _ in range(rnd.randint(5, 40))) + " a", f"l{i % 10}") for i in range(100)] + [(100, "qqq unseen\u00e9", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.score for r in ppm.score_documents(docs, order=order, nodes=40, frequent=20).collect()}

    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 1]
    known = ppm.classifier(ppm.class_sample(spark.createDataFrame([r for r in train if r[2]], docs.schema)), ppm.CLASS_WORDS)
    of = {i: ppm.class_of(ppm.tokens(t), known) for i, t, _ in rows}
    assert len({of[i] for i in range(100)}) == 10
    grams, ends = defaultdict(int), [0] * 10
    for i, t, _ in train:
        ends[of[i]] += 1
        for w in [*t.split(), ""]:
            for gram in ppm.windows(w, of[i], order):
                for begin in range(len(gram)):
                    grams[gram[begin:]] += 1
    nodes = ppm.trie(list(grams.items()))
    for i, t, _ in rows:
        k, seen, score = of[i], defaultdict(int), 0.0
        for at, w in enumerate([*t.split(), ""]):
            score += math.log10((ppm.WEIGHT * 10 ** ppm.code_length(w, k, nodes, order) + seen[w]) / (ppm.WEIGHT + at))
            seen[w] += 1
        score += math.log10((ends[k] + 0.5) / (sum(ends) + 0.5 * 10))
        assert abs(score - got[i]) < 1e-6 * abs(score), i


def test_words_and_windows_of_whole_batches_against_loops(spark):
    """Tokens, classes and windows are found for many texts and words at once; NULs and words of slices too."""
    import numpy as np
    import pyarrow as pa

    held = ["\ta skipped row", " Ab\tcD\x0b\x0c \u00e9 x \u00c9\u2003a \r\n", None, "", " \n ", "a A b ab"]
    rows = pa.array(held).slice(1)
    text, word, words = ppm._tokenized(rows)
    names = words.cast(pa.binary()).to_pylist()
    assert [[names[w] for w in word[text == i]] for i in range(len(rows))] == [ppm.tokens(t) for t in held[1:]]
    known = {b"a": 0, b"ab": 1, b"x": 2}, np.log(np.array([[0.2, 0.6], [0.7, 0.1], [0.1, 0.3]]))
    assert ppm._classes_of(text, word, names, len(rows), known).tolist() == [ppm.class_of(ppm.tokens(t), known) for t in held[1:]]
    batch = pa.RecordBatch.from_arrays([rows, pa.array([True, False, True, True, False])], ["text", "trains"])
    got, expected = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for b in ppm._count_words(iter([batch]), known):
        for w, k, *n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            got[w, k] = [x + y for x, y in zip(got[w, k], n, strict=True)]
    for t, trains in zip(held[1:], batch.column(1).to_pylist(), strict=True):
        for w in [*ppm.tokens(t), b""]:
            expected[w.decode(), ppm.class_of(ppm.tokens(t), known)][not trains] += 1
    assert got == expected
    some = ["", "a", "abc", "h\u00e9llo", "x\x00\x00", "0123456789"]
    for k in (0, 7, 8, 77):
        for order in (1, 3, 5, ppm.LONGEST):
            which, codes = ppm.packed_windows(pa.array(["zz", *some]).slice(1), np.array([0, 1, 3, 4, 5]), k, order)
            assert list(zip(which.tolist(), ppm.unpacked(codes).to_pylist(), strict=True)) == [(i, g) for i in (0, 1, 3, 4, 5) for g in ppm.windows(some[i], k, order)]
            assert ppm.packed(ppm.unpacked(codes)).tolist() == codes.tolist()
    with pytest.raises(ValueError, match="contexts"):
        ppm.score_documents(spark.createDataFrame([], "doc_id long, text string, lang string"), order=ppm.LONGEST + 1)


def test_scores_odd(docs, empty):
    got = ppm.score_documents(docs).collect()
    assert len(got) == docs.count() and {r.n_tokens for r in got if r.doc_id in (7, 8, 9)} == {1}
    assert len({r.score for r in got if r.doc_id in (11, 12)}) == 1
    assert ppm.score_documents(empty).count() == 0


# --- queries and pipeline ---


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import os

    con = duckdb.connect()
    for table in os.listdir(SF_DIR):
        con.sql(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{table}'")
    expected = con.sql(oracles.ORACLE_SQL[name]).to_arrow_table()
    got = queries.QUERIES[name](spark, SF_DIR).toArrow().select(expected.column_names)
    assert sorted(map(repr, got.to_pylist())) == sorted(map(repr, expected.to_pylist()))


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    tables = {"documents": docs.select(*columns)}
    held = tables["documents"].union(spark.createDataFrame([(900, "a clean text with lines\nof its own making", "en", "s", 40)], tables["documents"].schema))
    held.write.mode("overwrite").parquet(f"{tmp_path}/docs")
    held = spark.read.parquet(f"{tmp_path}/docs")
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, held, SF_DIR)
        assert out.columns == columns
        ids = [r.doc_id for r in out.collect()]
        assert 900 in ids
    near = corpus_pipeline.drop_near_duplicates(spark, held, SF_DIR)
    ids = [r.doc_id for r in near.collect()]
    assert ids.count(11) == 1 and 12 not in ids and ids.count(7) == 1 and 8 not in ids


def test_pipeline_rows_keep_their_names(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    path, changed = f"file://{tmp_path}/docs", {"spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    spark.range(40).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).repartition(5).write.parquet(path)

    def found(docs, benchmark, row):
        out = corpus_pipeline.stored(docs.select(row.alias("row"), (F.col("doc_id") % 2 == 0).alias("contaminated")), "found")
        for k, v in changed.items():  # the next job splits the files in another way
            spark.conf.set(k, v)
        return out

    monkeypatch.setattr(corpus_pipeline.decontaminate, "find_contamination", found)
    try:
        left = [r.doc_id for r in corpus_pipeline.drop_contaminated(spark, spark.read.parquet(path), SF_DIR).collect()]
    finally:
        for k in changed:
            spark.conf.unset(k)
    assert sorted(left) == list(range(1, 40, 2))


def test_pipeline_near_duplicates_against_all_pairs(spark):
    import corpus_pipeline
    from quillmill.llm import jaccard

    rnd, rows = random.Random(12), []
    for _ in range(12):
        words = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(40, 120))]
        for _ in range(5):
            rows.append((len(rows), " ".join(words)))
            if rnd.random() < 0.8:
                words = list(words)
                for _ in range(rnd.randint(1, 3)):
                    words[rnd.randrange(len(words))] = "edited"
    rows += [(len(rows), "Few words"), (len(rows) + 1, "few  WORDS"), (len(rows) + 2, "few others")]
    sets, root = [set(jaccard.shingles(t)) for _, t in rows], list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if len(a & b) >= 0.8 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    left = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF_DIR).collect()]
    assert sorted(left) == sorted(set(root)) and len(left) < 40


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SF_DIR)
    assert got.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).where("n <> m").count() == 0 and got.count()

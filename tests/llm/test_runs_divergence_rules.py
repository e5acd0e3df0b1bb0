"""Periodic runs, source divergence and the rule ledger against brute force, and on nulls, ties, repeats and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import divergence, oracles, periodic, queries, rules

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t ", "one", "a b a b a b a b", "x " * 3000, "la la la\nla la la\n\n la", "Été été ÉTÉ!", "tab\tand\x0bother\x0cblanks", "nul\x00byte", "no-break space"]


def plain_runs(w: list) -> list[tuple[int, int, int]]:
    """Every maximal stretch of words q apart alike, for every q, with no shorter period."""
    found = []
    for q in range(1, len(w) // 4 + 1):
        at = 0
        while at + q < len(w):
            end = at
            while end + q < len(w) and w[end] == w[end + q]:
                end += 1
            length = end - at + q
            if end > at and length >= max(6, 4 * q) and not any(all(w[k] == w[k + p] for k in range(at, at + length - p)) for p in range(1, q)):
                found.append((at, length, q))
            at = max(end, at + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text) -> tuple:
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = plain_runs(words)
    dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = None
    for s, length, q in runs:
        if best is None or length * best[2] > best[1] * q or (length * best[2] == best[1] * q and (s, q) < (best[0], best[2])):
            best = (s, length, q)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if best else None
    return (doc_id, len(runs), *(best or (None,) * 3), milli, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


# --- periodic runs ---


@pytest.mark.parametrize("dense", [2, 3, 8, 64])
def test_runs_equal_a_plain_search(dense, monkeypatch):
    monkeypatch.setattr(periodic, "DENSE_LAGS", dense)
    rnd = random.Random(dense)
    for _ in range(700):
        w = [rnd.randrange(rnd.choice([1, 2, 3, 9])) for _ in range(rnd.randint(0, 80))]
        for _ in range(rnd.randrange(4)):
            if w:
                a, p = rnd.randrange(len(w)), rnd.randint(1, max(1, len(w) // 5))
                w[a : a + p] = w[a : a + p] * rnd.randint(2, 6)
        assert periodic.runs_of(np.array(w, np.int64)) == plain_runs(w)


def test_runs_of_long_periods_are_found_where_texts_are_long():
    rnd = np.random.default_rng(3)
    w = rnd.integers(0, 10**6, 60_000)
    w[7_000:19_000] = np.resize(w[7_000:9_900], 12_000)  # 2,900 words, four times and a bit
    w[30_001 : 30_001 + 4 * 65] = np.resize(w[30_001:30_066], 4 * 65)
    w[50_000:50_399] = np.resize(w[50_000:50_100], 399)  # a word short of four times
    found = periodic.runs_of(w)
    assert [(s, q) for s, _, q in found] == [(7_000, 2_900), (30_001, 65)] and found[0][1] >= 12_000
    assert periodic.runs_of(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]


def test_op11_on_the_whole_table(spark):
    got = sorted((tuple(r) for r in queries.op11_periodic(spark, SF_DIR).collect()), key=str)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted((plain_row(*d) for d in docs), key=str)
    assert sum(r[1] > 0 for r in got) >= len(docs) // 20


def test_op11_on_odd_rows(spark, tmp_path):
    rows = [(i if i % 4 else None, t, t, "clash") for i, t in enumerate(ODD * 3)] + [(i, "w" + " ".join(map(str, range(i))), "", "") for i in range(40, 140)]
    spark.createDataFrame(rows, "doc_id long, text string, found string, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op11_periodic(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((plain_row(d, t) for d, t, *_ in rows), key=str)


def test_op11_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op11_periodic(spark, str(tmp_path)).collect() == []


# --- divergence ---


def plain_divergence(docs, least=10, top=10) -> list[tuple]:
    by_group, df = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)
        by_group[lang or "", source or ""].update(terms)
        df[lang or ""].update(set(terms))
    rows = []
    for lang in {g[0] for g in by_group}:
        kept = [t for t, d in df[lang].items() if d >= least]
        own = {s: {t: n[t] for t in kept} for (lg, s), n in by_group.items() if lg == lang}
        whole = {t: sum(n[t] for n in own.values()) for t in kept}
        share = lambda n: {t: 1 + 10**9 * (n[t] + 2) // (sum(n.values()) + 2 * len(kept)) for t in kept}  # noqa: E731, B023
        p, q = {s: share(n) for s, n in own.items()}, share(whole)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in own:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda r: (-r[0], r[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        rows.append((lang, s, part, item, value, rank))
    return sorted(rows)


@pytest.mark.parametrize("sizes", [{}, {"shard": 7, "stripe": 2}, {"shard": 3, "stripe": 1}])
def test_divergence_equals_a_loop_for_any_tiles(spark, sizes):
    rnd = random.Random(11)
    words = [f"{a}{b}" for a in "abcdé" for b in "xyzß"]
    docs = [(rnd.choice(["en", "de", None, "", "xx"]), rnd.choice(["s1", "s2", "S", None, "", "éa", "s3"]), " ".join(rnd.choices(words, weights=range(1, 21), k=rnd.randint(0, 30))).title()) for _ in range(300)]
    docs += [("en", "empty", None), ("en", "blank", " 12 "), ("lone", "l", "aa bb"), ("none", "a", "aa"), ("none", "b", "bb"), *[("en", "s1", "same text")] * 5]
    table = spark.createDataFrame([(*d, "clash", 1) for d in docs], "lang string, source string, text string, term string, n int")
    got = sorted(tuple(r) for r in divergence.source_divergence(table, least_documents=10, **sizes).collect())
    assert got == plain_divergence(docs)
    assert {r[4] for r in got if r[0] == "none"} == {0} and not [r for r in got if r[0] == "lone"]


def test_divergence_counts_are_handed_over_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([("en", f"s{i % 3}", f"t{i % 40}x and the {i}") for i in range(400)], "lang string, source string, text string")
    assert sorted(tuple(r) for r in divergence.source_divergence(docs, 5).collect()) == plain_divergence(docs.select("lang", "source", "text").collect(), 5)
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD", 4)
    batch = pa.RecordBatch.from_pydict({"lang": [b"e"] * 6, "source": [b"s"] * 6, "text": [b"a b c", b"d e", b"f a", b"", b"A a", b"z"]})
    parts = list(divergence._count_terms(iter([batch])))
    assert len(parts) > 1
    total = Counter()
    for part in parts:
        for term, n in zip(part.column("term").to_pylist(), part.column("n").to_pylist(), strict=True):
            total[term] += n
    assert total == {b"a": 4, b"b": 1, b"c": 1, b"d": 1, b"e": 1, b"f": 1, b"z": 1, None: 0}


def test_scaled_counts_are_exact():
    rnd = random.Random(2)
    for _ in range(2000):
        total = rnd.randint(2, rnd.choice([50, 10**9, 9 * 10**15]))
        count = rnd.randint(0, total)
        assert int(divergence.scaled(np.array([count]), total)[0]) == 1 + 10**9 * count // total


def test_divergence_empty(spark):
    empty = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.source_divergence(empty).collect() == []


# --- rules ---


def plain_repeated(words: list) -> int:
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return len({i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)})


def plain_measures(text) -> dict:
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    letter = lambda c: "a" <= c.lower() <= "z" or ord(c) > 127
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_lines": len(lines), "n_dup_lines": sum(line in lines[:i] for i, line in enumerate(lines)),
        "n_repeat_words": plain_repeated(words), "n_letters": sum(map(letter, text)), "n_capitals": sum("A" <= c <= "Z" for c in text), "n_small": sum("a" <= c <= "z" for c in text), "n_digits": sum("0" <= c <= "9" for c in text), "n_exclamations": text.count("!"),
        "n_lettered": sum(any(map(letter, w)) for w in words), "n_bullets": sum(re.match(r"[\x20\x09-\x0D]*[-*•]", line) is not None for line in lines), "n_ellipses": sum(re.search(r"(\.\.\.|…)[\x20\x09-\x0D]*\Z", line) is not None for line in lines),
    }


def odd_texts() -> list:
    rnd = random.Random(8)
    pieces = ["alpha", "Beta", "9", "#x|", "!", "...", "…", "•", "-", "ÉÈ", "日本", "\n", "\n", "\t", "a b c d e f", "\r\n"]
    return ODD + [" ".join(rnd.choices(pieces, k=rnd.randint(0, 60))) for _ in range(300)] + ["word " * 40_000]


def test_measures_and_bits_equal_a_loop(spark):
    rows = [(i if i % 5 else None, t, "x", 1) for i, t in enumerate(odd_texts())]
    table = spark.createDataFrame(rows, "doc_id long, text string, measures string, failed int")
    got = rules.ledger(table).select("doc.*", F.col("measures").alias("m"), F.col("failed").alias("bits")).collect()
    assert len(got) == len(rows)
    for r in got:
        m = plain_measures(r.text) if not r.text or len(r.text) < 10**5 else r.m.asDict()
        assert r.m.asDict() == {k: m[k] for k in rules.MEASURES}, r.text
        broken = {
            "few_words": m["n_words"] < 10, "repeated_windows": 5 * m["n_repeat_words"] > m["n_words"], "symbols": m["n_symbols"] * 10 > m["n_words"], "repeated_lines": m["n_dup_lines"] * 10 > m["n_lines"] * 3, "short_words": m["word_chars"] < 2 * m["n_words"],
            "long_words": m["word_chars"] > 12 * m["n_words"], "few_letters": m["n_letters"] * 10 < m["word_chars"] * 6, "capitals": m["n_capitals"] > m["n_small"], "digits": m["n_digits"] * 4 > m["word_chars"], "exclamations": m["n_exclamations"] * 2 > m["n_words"],
            "unlettered_words": m["n_lettered"] * 10 < m["n_words"] * 8, "bullets": m["n_bullets"] * 10 > m["n_lines"] * 9, "ellipses": m["n_ellipses"] * 10 > m["n_lines"] * 3,
        }
        assert r.bits == sum(1 << rule.bit for rule in rules.RULES if broken[rule.name])


def test_equal_hashes_do_not_make_windows_equal(monkeypatch):
    monkeypatch.setattr(rules.np, "sort", lambda h: np.zeros_like(h))  # as if all hashes agreed
    monkeypatch.setattr(rules.np, "isin", lambda h, _: np.ones(len(h), bool))
    rnd = random.Random(1)
    for _ in range(200):
        w = [rnd.randrange(3) for _ in range(rnd.randint(0, 60))]
        assert rules.repeated_words(np.array(w, np.int64)) == plain_repeated(w)


def test_policies_and_ablations(spark):
    table = spark.createDataFrame([(t,) for t in odd_texts()], "text string")
    entries = rules.ledger(table)
    bits = [r.failed for r in entries.collect()]
    got = {(r.policy, r.rule): tuple(r)[2:] for r in rules.ablations(entries).collect()}
    assert set(got) == {(p, name) for p, names in rules.POLICIES.items() for name in names}
    for (policy, rule), counts in got.items():
        broken, bit = [b & rules.mask(rules.POLICIES[policy]) for b in bits], rules.mask([rule])
        assert counts == (len(bits), broken.count(0), sum(b & bit > 0 for b in broken), broken.count(bit))
        without = entries.where(rules.passes(F.col("failed"), policy, rule)).count()
        assert without == counts[1] + counts[3]
    assert len({r.bit for r in rules.RULES}) == len(rules.RULES)


def test_rules_leave_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    judged = rules.ledger(docs).select("doc.quality", "measures.n_words", rules.passes(F.col("failed"), "base").alias("base"), rules.passes(F.col("failed")).alias("kept")).where("base")
    share = {r.quality: (r.kept, r.n) for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")).collect()}
    assert share[1][0] >= 0.99 and share[0][0] <= 0.3


def test_rules_empty(spark):
    entries = rules.ledger(spark.createDataFrame([], "text string"))
    assert entries.collect() == [] and rules.ablations(entries).collect() == []


@pytest.mark.parametrize("name", ["op12_divergence", "op13_rules"])
def test_sql_gives_the_same_rows(spark, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    sql = db.sql(oracles.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF_DIR).select(*sql.columns)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(sql.fetchall(), key=str)

"""Each stage of the pipeline against a brute-force version, with clashing columns, odd rows and empty tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmill.llm import jaccard, simhash, toxicity

SF_DIR = "/root/testdata/sf0.001"
#: Names that stages and operators use themselves.
CLASH = ("row", "doc", "_row", "n_lines", "n_removed", "key", "root", "toxic", "words", "lines", "kept", "score")
WORDS = "the of and to in is was for on with as by at from red blue green stone river house little".split()
STAGES = dict(corpus_pipeline.STAGES)


def rows(seed: int, n: int, item: str = "") -> list[tuple]:
    rnd = random.Random(seed)
    line = lambda: " ".join(rnd.choice(WORDS) + rnd.choice(["", "", f"{rnd.randrange(400)}"]) for _ in range(rnd.randint(3, 14)))
    texts = ["\n".join(line() for _ in range(rnd.randint(1, 6))) for _ in range(n)]
    texts += [t.replace("the", "a", 1) for t in texts[: n // 4]] + texts[: n // 8] + [f"{line()} {item} {line()}" for _ in range(4)]
    made = [(i, t) for i, t in enumerate(texts, 100)]
    return made + [(None, "no id at all here"), (None, "no id at all here"), (None, None), (7, None), (8, ""), (9, " \n \t\n"), (11, "same text"), (11, "same text"), (12, "Same  TEXT"), (13, "word " * 5000)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").orderBy("item_id").first().text
    table = spark.createDataFrame(rows(1, 60, item), "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), *(F.lit(c).alias(c) for c in CLASH))
    path = str(tmp_path_factory.mktemp("stages") / "docs")
    table.repartition(5).write.parquet(path)
    return spark.read.parquet(path)


def pairs(df) -> list[tuple]:
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=repr)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES[:4]])
def test_columns_stay_as_they_are(spark, docs, name):
    out = STAGES[name](spark, docs, SF_DIR)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    left = out.collect()
    assert left and all(r[c] == c for r in left for c in CLASH) and {r.lang for r in left} == {"en"}
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in left)


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_tables(spark, name):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} string" for c in CLASH))
    out = STAGES[name](spark, empty, SF_DIR)
    assert out.collect() == [] and (name == "packing" or out.columns == empty.columns)


def test_toxicity_stage_drops_what_is_scored_toxic(spark):
    """On the real table; the decision is that of the operator on the same rows, whose score is tested by itself."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    toxic = {r.doc_id for r in toxicity.score_toxicity(documents, labels).where("score >= 0.5").collect()}
    left = [r.doc_id for r in corpus_pipeline.drop_toxic(spark, documents, "/root/testdata/sf0.01").collect()]
    assert sorted(left) == sorted({r.doc_id for r in documents.select("doc_id").collect()} - toxic)
    known = {r.doc_id: r.toxic for r in labels.collect()}
    assert sum(1 - known[i] for i in toxic & set(known)) <= 0.01 * sum(1 - t for t in known.values())


def test_line_stage_against_a_loop(spark, docs):
    split = lambda s: frozenset(w for w in re.split(r"[\x20\x09-\x0D]+", s.lower()) if w)
    ordered = sorted(((d, t) for d, t in pairs(docs) if t is not None), key=lambda r: (r[0] is None, r[0] or 0))
    seen, expected = [], [(d, t) for d, t in pairs(docs) if t is None]
    for doc_id, text in ordered:
        kept = []
        for line in text.split("\n"):
            words = split(line)
            if not words or not any(len(words & s) * 100 >= len(words | s) * 80 for s in seen):
                kept.append(line)
            if words:
                seen.append(words)
        expected.append((doc_id, "\n".join(kept)))
    assert pairs(corpus_pipeline.drop_repeated_lines(spark, docs, SF_DIR)) == sorted(expected, key=repr)


def test_near_stage_against_all_pairs(spark, docs):
    table = sorted(pairs(docs), key=lambda r: (r[0] is None, r[0] or 0))

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t in table]
    root = list(range(len(table)))
    alike = lambda a, b: (not a and not b) or (a and b and len(a & b) * 100 >= len(a | b) * 80)
    for i in range(len(table)):
        for j in range(i):
            if alike(sets[i], sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    expected = [table[i] for i in sorted(set(root))]
    got = pairs(corpus_pipeline.drop_near_duplicates(spark, docs, SF_DIR))
    assert [d for d, _ in got] == sorted((d for d, _ in expected), key=repr) and len(got) < len(table) - 10


def test_near_stage_takes_candidates_from_simhash(spark, monkeypatch):
    """Long texts with a word or two changed, against all pairs of fingerprints."""
    rnd, found, table = random.Random(5), {}, []
    for _ in range(5):
        words = [f"w{rnd.randrange(5000)}" for _ in range(1500)]
        for _ in range(4):
            table.append((len(table), " ".join(words)))
            words[rnd.randrange(len(words))] = "edited"
    docs = spark.createDataFrame(table, "doc_id long, text string")

    def close(nodes):
        found["nodes"] = [(r.node, r.fp) for r in nodes.collect()]
        out = jaccard.stored(plain(nodes), "close")
        found["pairs"] = {(r.a, r.b) for r in out.collect()}
        return out

    plain = jaccard.close_texts
    monkeypatch.setattr(jaccard, "close_texts", close)
    left = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF_DIR).collect()]
    nodes, firsts = found["nodes"], {}
    for node, fp in sorted(nodes):
        firsts.setdefault(fp, node)
    assert {fp for _, fp in nodes} == {simhash.fingerprint(t) for _, t in table}
    expected = {(firsts[fp], node) for node, fp in nodes if firsts[fp] != node}
    for fp, node in firsts.items():
        near = [other for p, other in firsts.items() if other < node and ((p ^ fp) & ((1 << 64) - 1)).bit_count() <= 3]
        expected |= {(min(near), node)} if near else set()
    assert found["pairs"] == expected and expected and sorted(left) == [0, 4, 8, 12, 16]


def test_decontamination_stage_against_a_loop(spark, docs):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = set()
    for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)} or ({tuple(w)} if w else set())
    sizes = {len(w) for w in windows}
    dirty = lambda t: any(tuple(w[i : i + n]) in windows for w in [words(t)] for n in sizes for i in range(len(w) - n + 1))
    expected = [(d, t) for d, t in pairs(docs) if not dirty(t)]
    assert pairs(corpus_pipeline.drop_contaminated(spark, docs, SF_DIR)) == expected and len(expected) <= docs.count() - 4

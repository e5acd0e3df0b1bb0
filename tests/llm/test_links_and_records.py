"""Near-duplicate groups end to end against all pairs, and revisits that do not fit their response."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from quillmill.llm import queries, simhash, warc

SF_DIR = "/root/testdata/sf0.001"


def groups_by_loop(rows: list[tuple]) -> list[tuple]:
    prints = [simhash.fingerprint(t) & ((1 << 64) - 1) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and (prints[i] ^ prints[j]).bit_count() <= 3:
                root = [root[i] if r == root[j] else r for r in root]
    ids = {r: [d for (d, _), k in zip(rows, root, strict=True) if k == r and d is not None] for r in set(root)}
    return sorted(((d, f"{p:016x}", min(ids[r], default=None)) for (d, _), p, r in zip(rows, prints, root, strict=True)), key=repr)


def test_op8_on_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op8_simhash(spark, SF_DIR).collect()), key=repr)
    assert got == groups_by_loop(rows) and len({r[2] for r in got}) < len(got)


def test_op8_on_chains_of_copies(spark, tmp_path):
    """Each text differs from the one before in a word or two, so the ends of a chain are far apart."""
    rnd, rows = random.Random(5), [(None, "lone text without an id"), (3, None), (2, ""), (None, " \n"), (1, "short"), (0, "Short")]
    for _ in range(8):
        words = [f"w{rnd.randrange(500)}" for _ in range(400)]
        for _ in range(25):
            rows.append((len(rows) + 10, " ".join(words)))
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
    rnd.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op8_simhash(spark, str(tmp_path)).collect()), key=repr)
    expected = groups_by_loop(rows)
    assert got == expected and 8 < len({r[2] for r in expected}) < 150


def archive(spark, tmp_path, change):
    """The archive of two equal pages, its revisit changed."""
    pages = spark.createDataFrame([(1, "http://a", "x" * 200), (2, "http://b", "x" * 200), (3, None, "y")], "page_id long, url string, html string")
    (uri,) = [r.path for r in warc.write_warc(pages.coalesce(1)).collect()]
    held = gzip.decompress(open(uri.removeprefix("file://"), "rb").read())
    made = b"".join(gzip.compress(b"WARC/1.1" + change(r) if b"Type: revisit" in r else b"WARC/1.1" + r) for r in held.split(b"WARC/1.1")[1:])
    (tmp_path / "changed.warc.gz").write_bytes(made)
    return spark.createDataFrame([(f"file://{tmp_path}/changed.warc.gz",), (None,)], "path string")


def test_revisits_must_fit_their_response(spark, tmp_path):
    rows = warc.read_warc(archive(spark, tmp_path, lambda r: r)).orderBy("page_id").collect()
    assert [(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in rows] == [(1, "response", None, 200), (2, "revisit", 1, 200), (3, "response", None, 1)]
    for change in (lambda r: r.replace(b"X-Refers-To-Page-Id: 1", b"X-Refers-To-Page-Id: 3"), lambda r: r.replace(b"X-Payload-Length: 200", b"X-Payload-Length: 201")):
        with pytest.raises(Exception, match="no response for the revisit of page 2"):
            warc.read_warc(archive(spark, tmp_path, change)).collect()
    unnamed = warc.read_warc(archive(spark, tmp_path, lambda r: r.replace(b"X-Refers-To-Page-Id: 1\r\n", b"")))
    assert unnamed.where(F.col("refers_to").isNull()).count() == 3


def test_many_records_over_several_chunks(spark, monkeypatch):
    """Records that begin and end anywhere in the blocks that are read."""
    monkeypatch.setattr(warc, "CHUNK", 97)
    rnd = random.Random(6)
    html = {i: "".join(rnd.choices("ab<é\r\n ", k=rnd.choice([0, 1, 99, 100, 700]))) for i in range(300)}
    made = b"".join(warc.record(i, f"http://h/{i}", h.encode(), __import__("hashlib").sha256(h.encode()).hexdigest(), None) for i, h in html.items())
    import io

    found = list(warc.records(io.BytesIO(made)))
    assert [(r["page_id"], r["payload_bytes"]) for r in found] == [(i, len(h.encode())) for i, h in html.items()] and all(r["digest_ok"] for r in found)

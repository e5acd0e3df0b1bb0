"""Uploads, extraction that goes on, policies, unique rows, batches and the contract, row by row."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from quillmill.functions import js
from quillmill.operators import extract, policies, repair, store
from quillmill.plans import contract
from quillmill.sources import files
from quillmill.streaming import projects


def one(spark, expression, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()), F.lit(0).alias("_"))
    return row.select(expression.alias("out")).first().out


# --- uploads ---


def uploads(spark, tmp_path):
    for name, content in (("b/z.txt", b"first"), ("b/a.txt", b"sec\xffond"), ("b/m n.pdf", b"%PDF"), ("c/x.TXT", b"third"), ("c/not listed", b"no")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(content)
    rows = [(1, 0, "z.txt", "text/plain", "b/z.txt"), (1, 1, "m n.pdf", None, "b/m n.pdf"), (1, 2, "a.txt", None, "b/a.txt"), (2, 0, "scan", "application/pdf", "b/a.txt"), (3, 1, "again.txt", None, "b/z.txt"), (3, 0, "x.TXT", None, "c/x.TXT")]
    return spark.createDataFrame(rows, "request int, file_ord int, name string, mime string, path string")


def test_uploads_come_in_the_order_of_arrival(spark, tmp_path):
    found = files.read_uploads(spark, uploads(spark, tmp_path).orderBy("path"), str(tmp_path / "in"))
    rows = {(r.request, r.file_ord): (r.name, r.mime, r.size) for r in found.collect()}
    assert rows == {(1, 0): ("z.txt", "text/plain", 5), (1, 1): ("m n.pdf", None, 4), (1, 2): ("a.txt", None, 7), (2, 0): ("scan", "application/pdf", 7), (3, 1): ("again.txt", None, 5), (3, 0): ("x.TXT", None, 5)}
    texts = {r.request: r.text for r in files.text_parts_by_request(found).collect()}
    assert texts == {1: "=== z.txt ===\nfirst\n\n=== a.txt ===\nsec�ond", 2: "", 3: "=== x.TXT ===\nthird\n\n=== again.txt ===\nfirst"}
    routed = {(r.request, r.file_ord) for r in files.routed(found).where("pdf").collect()}
    assert routed == {(1, 1), (2, 0)}


def test_uploads_by_uri_and_missing_files(spark, tmp_path):
    manifest = uploads(spark, tmp_path)
    assert files.read_uploads(spark, manifest, f"file://{tmp_path}/in/").count() == 6
    with pytest.raises(ValueError, match="no files"):
        files.read_uploads(spark, manifest.where("false"), str(tmp_path / "in"))
    os.remove(tmp_path / "in/c/x.TXT")
    with pytest.raises(Exception, match="missing file c/x.TXT"):
        files.read_uploads(spark, manifest, str(tmp_path / "in")).collect()


def test_bytes_are_decoded_as_elsewhere(spark):
    rnd = random.Random(3)
    parts = [b"a", "é".encode(), "日".encode(), "\U0001f600".encode(), b"\xff", b"\xc0\x80", b"\xed\xa0\x80", b"\xf0\x9f", b"\xe2\x82", b"\x80", b"\xf4\x90\x80\x80", b"\x00"]
    values = [b"".join(rnd.choices(parts, k=rnd.randint(0, 9))) for _ in range(3000)] + [bytes(rnd.randrange(256) for _ in range(rnd.randint(0, 12))) for _ in range(3000)] + [None]
    rows = spark.createDataFrame([(i, None if v is None else bytearray(v)) for i, v in enumerate(values)], "i int, b binary").select("i", js.decode_text("b").alias("t"), js.image_format(F.lit("image/png")).alias("f")).orderBy("i").collect()
    assert [r.t for r in rows] == [None if v is None else v.decode("utf-8", "replace") for v in values]


def test_control_characters_in_json_strings(spark):
    import json

    rnd = random.Random(4)
    texts = ["".join(rnd.choices(["\\", "u001F", "\x1f", "\x0b", "\x00", '"', "\n", "\x7f", "é", "a"], k=rnd.randint(0, 9))) for _ in range(2000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", js.json_string("t").alias("q")).orderBy("i").collect()
    assert [r.q for r in rows] == [json.dumps(t, ensure_ascii=False) for t in texts]


def test_image_formats(spark):
    assert [one(spark, js.image_format("m"), m=m) for m in ("image/png", "image/jpeg", "x-png;q=1", "image/PNG", "", None)] == ["png", "jpeg", "png", "jpeg", "jpeg", "jpeg"]


# --- extraction ---


def asking(folder, failing=()):
    """An extractor that leaves a file for each call."""

    def ask(request):
        (folder / f"{request['text']}-{time.time_ns()}").touch()
        if request["text"] in failing:
            raise RuntimeError("overloaded")
        return [{"type": "text", "text": request["text"].upper()}] if request["text"] != "tool" else [{"type": "tool_use"}, {"type": "text", "text": "late"}]

    return ask


def calls(folder):
    names = sorted(x.rpartition("-")[0] for x in os.listdir(folder))
    for x in os.listdir(folder):
        os.remove(folder / x)
    return names


def test_extraction_goes_on_where_it_was(spark, tmp_path):
    folder, kept = tmp_path / "calls", str(tmp_path / "kept")
    folder.mkdir()
    chunks = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "tool"), (5, None), (6, "")], "id int, text string").withColumn("key", extract.request_key("text"))
    asked = chunks.withColumn("text", F.coalesce("text", F.lit("nothing"))).withColumn("single", F.col("id") == 4)
    run = lambda failing=(): {r.id: (r.attempt, r.raw, r.error) for r in extract.resume(asked.drop("id", "single"), asking(folder, failing), kept).select("key", "attempt", "blocks", "error").distinct().join(asked, "key").select("id", "attempt", extract.answer_text("blocks", F.col("single")).alias("raw"), "error").collect()}
    first = run(failing=("b", "nothing"))
    assert calls(folder) == ["", "a", "b", "nothing", "tool"]
    assert first == {1: (1, "A", None), 2: (1, None, "RuntimeError: overloaded"), 3: (1, "A", None), 4: (1, "", None), 5: (1, None, "RuntimeError: overloaded"), 6: (1, "", None)}
    second = run(failing=("nothing",))
    assert calls(folder) == ["b", "nothing"]
    assert second == first | {2: (2, "B", None), 5: (2, None, "RuntimeError: overloaded")}
    third, fourth = run(failing=("nothing",)), None
    assert calls(folder) == ["nothing"] and third[5] == (3, None, "RuntimeError: overloaded")
    fourth = run()
    assert calls(folder) == [] and fourth == third


def test_answers_that_are_no_text(spark):
    blocks = lambda *of: F.array(*(F.struct(F.lit(k).alias("type"), F.lit(t).cast("string").alias("text")) for k, t in of))
    assert [one(spark, extract.answer_text(blocks(("tool", None)), F.lit(s))) for s in (True, False)] == ["", "{}"]
    assert one(spark, extract.answer_text(blocks(("text", "x"), ("text", "y")), F.lit(True))) == "x"
    assert one(spark, extract.answer_text(F.lit(None).cast(extract.BLOCKS), F.lit(True))) is None


def test_requests_of_other_parts_have_other_keys(spark):
    keys = [one(spark, extract.request_key(*(F.lit(p).cast("string") for p in parts))) for parts in (("ab", "c"), ("a", "bc"), ("abc", ""), ("abc", None), (None, "abc"), ("", "abc"))]
    assert len(set(keys)) == 6


# --- policies ---

SETTINGS = "user_id string, company_name string"
OBJECTS = "bucket string, path string, size int"


def test_settings_policies(spark):
    table, me = spark.createDataFrame([("u1", "A"), ("u2", "B"), (None, "C")], SETTINGS), F.lit("u1")
    seen = lambda df: sorted((str(r.user_id), r.company_name) for r in df.collect())
    assert seen(policies.select(table, policies.SETTINGS, me)) == [("u1", "A")]
    assert seen(policies.insert(table, spark.createDataFrame([("u1", "D")], SETTINGS), policies.SETTINGS, me))[1] == ("u1", "A") and policies.insert(table, table.where("user_id = 'u1'"), policies.SETTINGS, me).count() == 4
    for foreign in ("u2", None):
        with pytest.raises(Exception, match="row-level security"):
            policies.insert(table, spark.createDataFrame([(foreign, "D")], SETTINGS), policies.SETTINGS, me).collect()
    assert seen(policies.update(table, {"company_name": F.lit("X")}, F.lit(True), policies.SETTINGS, me)) == [("None", "C"), ("u1", "X"), ("u2", "B")]
    with pytest.raises(Exception, match="row-level security"):
        policies.update(table, {"user_id": F.lit("u2")}, F.lit(True), policies.SETTINGS, me).collect()
    assert seen(policies.delete(table, F.lit(True), policies.SETTINGS, me)) == seen(table)  # no policy allows it


def test_logo_policies(spark):
    table, me = spark.createDataFrame([("logos", "u1/logo.png", 1), ("logos", "u2/logo.png", 2), ("other", "u1/x", 3), ("logos", None, 4)], OBJECTS), F.lit("u1")
    sizes = lambda df: sorted(r.size for r in df.collect())
    assert sizes(policies.select(table, policies.LOGOS, me)) == [1, 2, 4]
    assert sizes(policies.delete(table, F.lit(True), policies.LOGOS, me)) == [2, 3, 4]
    assert sizes(policies.update(table, {"size": F.col("size") * 10}, F.col("size") < 3, policies.LOGOS, me)) == [2, 3, 4, 10]
    assert policies.insert(table, spark.createDataFrame([("logos", "u1/b.png", 5)], OBJECTS), policies.LOGOS, me).count() == 5
    for foreign in (("logos", "u2/b.png", 5), ("other", "u1/b.png", 5), ("logos", "logo.png", 5)):
        with pytest.raises(Exception, match="row-level security"):
            policies.insert(table, spark.createDataFrame([foreign], OBJECTS), policies.LOGOS, me).collect()
    assert policies.select(table, (), me).count() == 0


# --- unique rows and batches ---


def test_a_second_row_of_a_user_is_refused(spark):
    table = spark.createDataFrame([("u1", "A"), (None, "N")], SETTINGS)
    new = lambda *rows: spark.createDataFrame(list(rows), SETTINGS)
    assert store.insert_unique(table, new(("u2", "B"), ("u3", "C"), (None, "D"), (None, "E")), "user_id").count() == 6
    assert store.insert_unique(table.where("false"), new(("u1", "B")), "user_id").count() == 1
    for rows in ([("u1", "B")], [("u2", "B"), ("u2", "C")], [("u2", "B"), ("u1", "C")]):
        with pytest.raises(Exception, match="duplicate user_id"):
            store.insert_unique(table, new(*rows), "user_id").collect()


def test_the_last_upload_of_a_path_stays(spark):
    held = spark.createDataFrame([("a", 1), ("b", 2)], "path string, size int")
    new = spark.createDataFrame([("a", 3, 1), ("a", 4, 2), ("c", 5, 1)], "path string, size int, at int")
    assert sorted((r.path, r.size) for r in store.put_objects(held, new, "at").collect()) == [("a", 4), ("b", 2), ("c", 5)]
    assert sorted((r.path, r.size) for r in store.put_objects(held, new.where("size > 3").drop("at")).collect()) == [("a", 4), ("b", 2), ("c", 5)]
    with pytest.raises(Exception, match="several uploads of a"):
        store.put_objects(held, new.drop("at")).collect()


def test_a_batch_that_comes_again_adds_no_row(spark, tmp_path):
    schema = "user_id string, request string, name string, data string, documents array<struct<name:string,url:string>>"
    path, now = str(tmp_path / "t"), F.lit("2026-01-01").cast("timestamp")
    read = lambda: sorted((r.user_id, r.name, r.batch) for r in spark.read.parquet(path).collect())
    spark.createDataFrame([("u1", "r1", "One", None, None)], schema).write.parquet(str(tmp_path / "in/1"))
    requests = spark.readStream.schema(schema).parquet(str(tmp_path / "in/*"))
    run = lambda: projects.append_projects(requests, path, "request", now, str(tmp_path / "c")).awaitTermination()
    run()
    assert read() == [("u1", "One", 0)]
    spark.createDataFrame([("u1", "r2", "", None, None)], schema).write.parquet(str(tmp_path / "in/2"))
    run()
    run()
    assert read() == [("u1", "One", 0), ("u1", "Untitled", 1)]
    again = store.inserted_projects(spark.createDataFrame([("u1", "r2", "", None, None)], schema), "request", now)
    projects.write_batch(again, path, 1)  # as when the driver was lost before the batch was marked as done
    assert read() == [("u1", "One", 0), ("u1", "Untitled", 1)]
    assert len({r.id for r in spark.read.parquet(path).collect()}) == 2


# --- contract ---


def test_broken_rules(spark):
    raw = """{"project": {"type": "opera", "deadline": "2026-02-30"}, "roles": [{"name": "A", "gender": "male", "speaking": true, "description": "One. Two! \\"Three?\\" And four", "pageNumbers": [0, 96, 190, 191]},
      {"name": "B", "speaking": false, "description": "A nurse. Kind. Calm."}, {"name": "C"}], "selfTapeInstructions": [{"roleName": "A", "videos": [{"label": "SLATE"}, {"label": "S"}]}, {"roleName": "B", "videos": []}, {"roleName": "C"}],
      "formQuestions": [{"roleName": "A", "questions": [{"type": "email", "label": "E"}, {"label": "F"}, {"type": "text", "label": "G"}]}]}"""
    rows = spark.createDataFrame([(1, raw, 96, 190), (2, "{}", 1, 9)], "id int, raw string, first_page int, last_page int")
    found = contract.violations(rows.withColumn("result", repair.typed(F.parse_json("raw"))), ["id"]).collect()
    of = lambda i: {r.rule: r.n for r in found if r.id == i}
    assert of(1) == {"project_type": 1, "deadline": 1, "description": 2, "gender": 1, "speaking": 1, "page_numbers": 2, "videos": 2, "question_type": 2, "standard_questions": 0, "empty_sections": 0}
    assert of(2) == dict.fromkeys(of(1), 0) | {"empty_sections": 3}


def test_standard_questions(spark):
    asked = [{"label": f" {q} ", "type": t, "required": r} for q, t, r in contract.FILM_QUESTIONS]
    import json

    result = lambda kind, questions: F.lit(json.dumps({"project": {"type": kind}, "formQuestions": [{"roleName": "A", "questions": questions}, {"roleName": "B"}]}))
    missing = lambda kind, questions: {r.rule: r.n for r in one(spark, contract.broken_rules(repair.typed(F.parse_json(result(kind, questions))), F.lit(1), F.lit(1)))}["standard_questions"]
    assert missing("film", asked) == 4 and missing("tv_series", asked[1:]) == 5 and missing("theatre", []) == 0
    assert missing("commercial", asked) == 18 and missing("film", [asked[0] | {"required": False}, *asked[1:]]) == 5


@pytest.mark.parametrize(("text", "n"), [(None, 0), ("", 0), ("One", 1), ("One. Two.", 2), ('He says "go." Then leaves!', 2), ("Mr.Smith waits... Again?", 2), ("A. B. C", 3)])
def test_sentences(spark, text, n):
    assert one(spark, contract.sentences(F.lit(text).cast("string"))) == n

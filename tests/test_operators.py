"""Hand-computed rows for what the survey calls easy to get wrong."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.functions import js
from quillmill.operators import merge, pages, repair, store
from quillmill.plans import render
from quillmill.sources import files


def one(spark, expression, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()), F.lit(0).alias("_"))
    return row.select(expression.alias("out")).first()["out"]


def test_chunking(spark):
    docs = spark.createDataFrame([(n, n) for n in (0, 1, 95, 96, 190, 191)], "doc_id int, n_pages int")
    found = {}
    for r in pages.chunked(docs).orderBy("doc_id", "chunk_ix").collect():
        found.setdefault(r.doc_id, []).append(r.page_offset)
    assert found == {0: [1], 1: [1], 95: [1], 96: [1, 96], 190: [1, 96], 191: [1, 96, 191]}


ROLE = "ord int, name string, description string, gender string, pageNumbers array<int>, characteristics array<string>"


def roles(spark, rows):
    return {r["key"]: r for r in merge.merge_roles(spark.createDataFrame(rows, ROLE)).collect()}


def test_role_merge(spark):
    found = roles(spark, [
        (1, "Jake", "abc", None, [5, 3], ["b", "a"]), (2, " JAKE ", "xyz", "Male", [3, 10], ["a", "c"]), (3, "Solo", "s", "Any", [9, 2, 9], ["x", "x"]),
        (4, "  ", "blank", None, [1], []), (5, None, "none", None, [1], []), (6, "Emoji", "\U0001f600", None, None, None), (7, "EMOJI﻿", "a", None, [2], None),
    ])
    assert set(found) == {"jake", "solo", "emoji"}
    jake = found["jake"]
    assert (jake.name, jake.description, jake.gender, jake.pageNumbers, jake.characteristics) == ("Jake", "abc", None, [3, 5, 10], ["b", "a", "c"])
    assert (found["solo"].pageNumbers, found["solo"].characteristics) == ([9, 2, 9], ["x", "x"])
    assert (found["emoji"].description, found["emoji"].pageNumbers) == ("\U0001f600", [2])


names = st.sampled_from(["Ann", " ann", "BOB", "bob ", "Cy", "", None])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(names, st.text("ab\U0001f600", max_size=3), st.lists(st.integers(1, 5), max_size=3)), min_size=1, max_size=12), st.sampled_from([1, 7]))
def test_role_merge_against_loop(spark, drawn, partitions):
    rows = [(i, n, d, None, p, []) for i, (n, d, p) in enumerate(drawn)]
    expected, size = {}, lambda s: len(s.encode("utf-16-be")) // 2
    for i, name, text, _, numbers, _ in rows:
        key = (name or "").lower().strip()
        if not key:
            continue
        if key not in expected:
            expected[key] = [i, name, text, numbers]
        else:
            held = expected[key]
            held[3] = sorted({*held[3], *numbers})
            held[2] = text if size(text) > size(held[2]) else held[2]
    found = merge.merge_roles(spark.createDataFrame(rows, ROLE).repartition(partitions)).collect()
    assert {r.key: [r.out_ord, r.name, r.description, r.pageNumbers] for r in found} == expected


def test_merge_only_with_several_chunks(spark):
    role = '{"roles": [{"name": "A", "pageNumbers": [2, 1]}, {"name": " a "}], "project": {"name": "%s"}, "formQuestions": [{"roleName": "A"}, {"roleName": "a"}]}'
    raw = spark.createDataFrame([(1, 1, role % "one"), (2, 1, role % "two"), (2, 2, role % "three")], "doc_id int, ord int, raw string")
    found = {r.doc_id: r.result for r in merge.merge_answers(raw).select("doc_id", repair.typed("result").alias("result")).collect()}
    assert [r.name for r in found[1].roles] == ["A", " a "]
    assert [(r.name, r.pageNumbers) for r in found[2].roles] == [("A", [1, 2])]
    assert found[2].project.name == "two" and len(found[1].formQuestions) == 2 and len(found[2].formQuestions) == 1


def test_merge_counts_chunks_that_were_sent(spark):
    role = '{"roles": [{"name": "A", "description": "so, ]"}, {"name": "a"}]}'
    raw = spark.createDataFrame([(1, 1, role), (1, 2, "nothing"), (2, 1, "nothing"), (3, 1, "{"), (3, 2, "}")], "doc_id int, ord int, raw string")
    found = {r.doc_id: r for r in merge.merge_answers(raw).select("doc_id", repair.typed("result").alias("result"), "error").collect()}
    assert [(r.name, r.description) for r in found[1].result.roles] == [("A", "so]")] and found[1].result.selfTapeInstructions == []
    assert (found[2].result, found[2].error) == (None, merge.NO_OBJECT) and (found[3].result, found[3].error) == (None, merge.NO_CHUNK)


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ('ok {"a":[1,2, ],} bye', '{"a":[1,2]}'),
        ('{"a": "x\ny"}', '{"a": "x\\ny"}'),
        ('{"a": "x\ny\nz"}', None),
        ('{"a":1} tail', '{"a":1}'),
        ('{"a":1,\u00a0}', '{"a":1}'),
        ('{"a":[1,\ufeff\u3000]}', '{"a":[1]}'),
        ('{"a":1} y }', None),
        ("{'a':1}", None),
        ('{"a":NaN}', None),
        ('{"a":"b\x01"}', '{"a":"b"}'),
        ('{"a": "x, ]"}', '{"a": "x]"}'),
        ("nothing", None),
        (None, None),
    ],
)
def test_single_answer(spark, raw, expected):
    assert repair.parse_single(spark.createDataFrame([(raw,)], "raw string")).first()["json"] == expected


def test_last_duplicate_key_wins(spark):
    assert one(spark, F.try_variant_get(F.try_parse_json("j"), "$.a", "int"), j='{"a":1,"a":2}') == 2


def test_sides(spark):
    table = spark.createDataFrame([(1, n, f"p{n}") for n in range(1, 5)], "doc_id int, page_no int, content string")
    for wanted, expected in (("[3,1,3,9,0]", [3, 1, 3]), ("[]", [1, 2, 3, 4]), (None, [1, 2, 3, 4])):
        request = spark.createDataFrame([(1, wanted)], "doc_id int, p string").select("doc_id", pages.requested_or_all(pages.parse_page_list("p"), F.lit(4)).alias("page_numbers"))
        assert [r.page_no for r in pages.select_pages(request, table).orderBy("pos").collect()] == expected
    assert one(spark, pages.requested_or_all(F.array().cast("array<int>"), F.lit(0))) == []


def test_strings(spark):
    name = "Dr. O'Neil"
    assert [one(spark, f("x"), x=name) for f in (js.sanitize_each, js.sanitize_runs, js.sanitize_spaces)] == ["Dr__O_Neil", "Dr_O_Neil", "Dr._O'Neil"]
    assert one(spark, js.hex_to_rgb("x"), x="#00BFA5") == [0, 191, 165]
    assert one(spark, js.hex_to_rgb("x"), x="#abc") == [171, 12, None]
    assert one(spark, js.contrast_text(F.array(*map(F.lit, (127, 127, 127))))) == "white"
    assert one(spark, js.contrast_text(F.array(*map(F.lit, (128, 128, 128))))) == "black"
    assert one(spark, js.trim("x"), x=" ﻿ a b\t\n") == "a b"
    assert one(spark, js.uri_component("x"), x="a b(c)!'~é*") == "a%20b(c)!'~%C3%A9*"
    assert one(spark, js.decode_text("x"), x=bytearray(b"a\xffb")) == "a�b"
    assert one(spark, js.first_like(F.array(F.lit("tall"), F.lit("graceful")), "(?i)race")) == "graceful"
    assert one(spark, js.size_label("x"), x=1536) == "2KB"
    assert one(spark, js.join(F.array(F.lit("a"), F.lit(None).cast("string"), F.lit("b")), ", ")) == "a, , b"


def test_router(spark):
    rows = spark.createDataFrame([("X.PDF", None), ("a.pdf", None), ("a.txt", "application/pdf"), ("a.doc\n", None)], "name string, mime string")
    assert [(r.accepted, r.pdf, r.looks_pdf) for r in files.routed(rows).collect()] == [(True, False, True), (True, True, True), (False, True, False), (False, False, False)]


def test_read_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"hi")
    assert [(r.name, r.size) for r in files.read_files(spark, str(tmp_path)).collect()] == [("a.txt", 2)]


def test_upsert(spark):
    table = spark.createDataFrame([("u1", "id1", "Old", "x"), ("u2", "id2", "Keep", None)], "user_id string, id string, company_name string, footer_text string")
    changes = spark.createDataFrame([("u1", "First", None, 1), ("u1", None, "f", 2), ("u3", "New", None, 1)], "user_id string, company_name string, footer_text string, at int")
    found = store.upsert(table, changes, "user_id", ["company_name", "footer_text"], "at")
    assert sorted(map(tuple, found.collect())) == [("u1", "id1", None, "f"), ("u2", "id2", "Keep", None), ("u3", None, "New", None)]


def test_point_read_wants_one_row(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    assert [store.exactly_one(rows, "k", k).count() for k in (1, 2, 3)] == [1, 0, 0]


def test_foreign_rows_are_refused(spark):
    rows = spark.createDataFrame([("u1",), ("u2",)], "user_id string")
    assert store.owned(rows, "u1").count() == 1
    with pytest.raises(Exception, match="another user"):
        store.assert_owned(rows, "u1").collect()


def test_overlay_keeps_stored_null(spark):
    users = spark.createDataFrame([("a",), ("b",)], "user_id string")
    held = spark.createDataFrame([("a", None)], "user_id string, company_name string")
    found = {r.user_id: r.company_name for r in store.settings_or_defaults(users, held, {"company_name": ""}).collect()}
    assert found == {"a": None, "b": ""}


def test_form_numbers(spark):
    q = F.struct(F.lit("radio").alias("type"), F.lit("Q").alias("label"), F.array(F.lit("a"), F.lit("b")).alias("options"), F.lit(True).alias("required"))
    found = one(spark, render.form_rows(F.array(q, q), F.lit("head")))
    assert len(found) == 9 and found[0].type == "control_head" and found[0].required is None and found[6].options == found[7].options == "a|b"
    assert tuple(found[8]) == ("control_button", "Submit Application", None, "9", None) and [r.required for r in found[1:6]] == ["Yes", "Yes", "No", "No", "No"]


def test_form_json(spark):
    q = F.struct(F.lit("select").alias("type"), F.lit("Q").alias("label"), F.array(F.lit("a"), F.lit("b")).alias("options"), F.lit(False).alias("required"))
    expected = (
        '{"properties":{"title":"T"},"questions":{"1":{"type":"control_head","text":"T","order":"1"},"2":{"type":"control_fullname","text":"Full Name","required":"Yes","order":"2"},"3":{"type":"control_email","text":"Email Address","required":"Yes","order":"3"},'
        '"4":{"type":"control_phone","text":"Phone Number","required":"No","order":"4"},"5":{"type":"control_textbox","text":"City and State","required":"No","order":"5"},"6":{"type":"control_textbox","text":"Your Agent/Manager","required":"No","order":"6"},'
        '"7":{"type":"control_dropdown","text":"Q","required":"No","order":"7","options":"a|b"},"8":{"type":"control_button","text":"Submit Application","order":"8"}}}'
    )
    assert one(spark, render.form_json(F.lit("T"), render.form_rows(F.array(q), F.lit("T")))) == expected


def test_copied_texts(spark):
    no = F.lit(None).cast("string")
    assert one(spark, render.role_block(F.lit("Ann"), F.lit("A nurse."), F.lit("20s"), no, F.lit("Any"))) == "Ann\nAge: 20s\nGender: N/A\nEthnicity: Any\n\nA nurse."
    video = F.struct(F.lit("Slate").alias("label"), F.lit("Say your name").alias("description"))
    assert one(spark, render.instruction_block(F.array(video, video), F.array(F.lit("head")), F.array(F.lit("a"), F.lit("b")))) == "Slate: Say your name\nSlate: Say your name\n\nPhotos:\nhead\n\nFilming Notes:\na\nb"
    line = lambda notation, kind: one(spark, render.question_line(notation, F.lit(kind), F.lit("Q"), F.array(F.lit("a"), F.lit("b")), F.lit(True)))
    assert [line(n, "radio") for n in ("form", "mail", "screen")] == ["Q [a / b] (required)", "Q — Options: a, b (REQUIRED)", "Q [a / b] *"] and line("form", "select") == "Q (required)"


def test_schedule():
    begins = render.schedule(list(render.STEP_MS[:-1]))
    assert len(begins) == 16 and begins[-1] == 77_200


def test_settings_stream(spark, tmp_path):
    from quillmill.streaming.settings import latest_per_key, maintain

    schema = "user_id string, company_name string, at timestamp"
    spark.createDataFrame([("u1", "Old", None)], schema).write.parquet(str(tmp_path / "t/version=-1"))
    spark.createDataFrame([("u1", "New", None), ("u2", "Two", None)], schema).write.parquet(str(tmp_path / "in"))
    changes = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    maintain(changes, str(tmp_path / "t"), "user_id", ["company_name", "at"], "company_name", str(tmp_path / "c")).awaitTermination()
    assert sorted(r.company_name for r in spark.read.parquet(str(tmp_path / "t/version=0")).collect()) == ["New", "Two"]
    assert latest_per_key(changes, "user_id", "at").isStreaming


def test_settings_are_normalised_and_saved(spark):
    cols = ", ".join(f"{c} string" for c in store.SETTINGS_COLUMNS)
    bodies = spark.createDataFrame([(1, 1, *[""] * 8), (1, 2, "Ann", *[""] * 7), (None, 3, None, None, None, None, "#111111", None, None, None)], f"user_id int, at int, {cols}")
    held = spark.createDataFrame([(2, *["x"] * 8, None)], f"user_id int, {cols}, updated_at string")
    found = {r.user_id: r for r in store.save_settings(held, bodies, F.lit("now"), "at").collect()}
    assert set(found) == {1, 2, None}
    assert (found[1].company_name, found[1].brand_color, found[1].header_text, found[1].updated_at) == ("Ann", js.TEAL, None, "now")
    assert (found[2].company_name, found[2].updated_at, found[None].brand_color) == ("x", None, "#111111")


def test_inserted_ids(spark):
    requests = spark.createDataFrame([(1, "a", None, '{"project": {"name": "P"}}', None), (1, "b", "n", None, None)], "user_id int, request string, name string, data string, documents array<string>")
    rows = store.inserted_projects(requests, "request", F.lit("now")).collect()
    assert len({r.id for r in rows}) == 2 and {r.name for r in rows} == {"P", "n"}
    assert {r.id for r in store.inserted_projects(requests.repartition(3), "request", F.lit("later")).collect()} == {r.id for r in rows}


def test_guards_take_the_first(spark):
    rows = store.guarded(spark.createDataFrame([(1,), (5,), (None,)], "x int"), (F.col("x") > 4, "large", 400), (F.col("x") > 0, "positive", 500)).collect()
    assert {(r.x, r.status, r.error) for r in rows} == {(1, 500, "positive"), (5, 400, "large"), (None, 200, None)}


def test_sheet_breaks(spark):
    """A long video turns the page after itself, notes before their bar, photos never."""
    video = lambda lines: F.array(F.struct(F.lit("A").alias("label"), F.array_join(F.array_repeat(F.lit("v"), lines), "\n").alias("description")))
    blocks = lambda lines: render.sheet_blocks([("Project:", F.lit("p")), ("Brand:", F.lit(""))], video(lines), F.array(F.lit("one")), F.array(F.lit("n")))
    rows = [(r.kind, r.y, r.page) for r in one(spark, render.laid_out(blocks(47), F.lit(28)))]
    assert rows == [("bar", 28, 1), ("fact", 36, 1), ("value", 36, 1), ("bar", 46, 1), ("text", 56, 1), ("bar", 64, 1), ("label", 74, 1), ("video", 79, 1), ("bar", 15, 2), ("photo", 25, 2), ("bar", 33, 2), ("note", 43, 2)]
    late = one(spark, render.laid_out(blocks(46), F.lit(22)))
    assert [(r.kind, r.y, r.page) for r in late[-5:]] == [("video", 73, 1), ("bar", 261, 1), ("photo", 271, 1), ("bar", 15, 2), ("note", 25, 2)]


def test_written_reports(spark, tmp_path):
    result = repair.typed(F.try_parse_json(F.col("j")))
    rows = spark.createDataFrame([(i, '{"project": {"name": "A & B"}, "roles": [{"name": "R"}]}') for i in (1, 2)], "project_id int, j string").select("project_id", result.alias("result"))
    render.write_reports(rows, str(tmp_path / "out"), "REPORT")
    assert len(list((tmp_path / "out").glob("project_id=*/report=*/part-*"))) == 2
    (part,) = (tmp_path / "out").glob("project_id=1/report=*/part-*")
    assert part.parent.name == "report=A_B_Report.txt"
    lines = part.read_text().split("\n")
    assert lines[1] == "REPORT" and "Name: A & B" in lines and "1. R (Non-speaking)" in lines


def test_names_and_quotes(spark):
    assert one(spark, js.json_string(F.lit('a"b\n'))) == '"a\\"b\\n"' and one(spark, js.json_string(F.lit(None).cast("string"))) == "null"
    assert one(spark, pages.with_marker(F.array().cast("array<string>"), F.lit("f.pdf"), F.lit(1))) == "=== f.pdf (PDF document attached above) ==="
    assert one(spark, pages.with_marker(F.array(F.lit("t")), F.lit("f.pdf"), F.lit(2))) == "t"
    assert one(spark, pages.sides_name(F.lit("A  é"))) == "Sides_A___.pdf" and one(spark, pages.tape_name(F.lit("A  é"))) == "Self-Tape_A_é.pdf"
    assert one(spark, files.first_pdf(F.array(F.lit("a"), F.lit("B.PDF")))) == "B.PDF" and one(spark, files.any_pdf(F.array(F.lit("a")))) is False

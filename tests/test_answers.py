"""Repair, the strict gate and the merge of answers against patterns, a JSON parser and loops."""

import json
import random
import time

import regex
from pyspark.sql import functions as F

from quillmill.operators import merge, repair

BLANK = r"[\t\n\x0b\f\r \xa0  -     　﻿]"
#: What the line feed repair must do, with a look-behind that reads each line anew at every quote.
SLOW = regex.compile(rf'(?<=":[^\n\r  ]*)"([^"]*)\n([^"]*)"(?={BLANK}*[,}}\]])')


def column(spark, expression, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.out for r in rows.select("i", expression.alias("out")).orderBy("i").collect()]


def test_line_feed_repair_equals_the_pattern(spark):
    rnd = random.Random(4)
    pieces = ['"', '"', '"', ":", '":', '": "', "\n", "\n", "\r", " ", ",", "}", "]", " ", "x", "\\", "﷐", "﷐0", "﷐1", '",\n"']
    texts = ["".join(rnd.choices(pieces, k=rnd.randint(0, 24))) for _ in range(20_000)]
    expected = [SLOW.sub(lambda m: f'"{m[1]}\\n{m[2]}"', t) for t in texts]
    assert sum(a != b for a, b in zip(texts, expected, strict=True)) > 500
    assert column(spark, repair.escaped_line_feed("t"), texts) == expected


def test_braces_equal_the_pattern(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choices("{}ab\n\U0001f600", k=rnd.randint(0, 8))) for _ in range(3000)]
    found = [regex.search(r"\{[\s\S]*\}", t) for t in texts]
    assert column(spark, repair.braces("t"), texts) == [m and m[0] for m in found]


def test_repairs_take_time_with_the_length_only(spark):
    pair = '"key": "some text here, and more", '
    hard = ["{" + pair * 30_000 + '"a": "x\ny"}', "{" * 1_000_000, "{" + '"a": "' + "\n" * 1_000_000 + '"x}', '{"a": "x\n' + '":' * 400_000 + "}", "{" + "," * 500_000 + "}", '{"a":' + " " * 1_000_000 + "}"]
    warm = column(spark, F.length(repair.single_repair("t")), ["{}"])
    assert warm == [2]
    for text in hard:
        began = time.perf_counter()
        column(spark, F.length(repair.without_controls(repair.single_repair("t"))), [text])
        assert time.perf_counter() - began < 15, text[:40]


def loads(text):
    def refused(x):
        raise ValueError(x)

    try:
        return json.loads(text, parse_constant=refused)
    except (ValueError, RecursionError):
        return ...


def test_gate_equals_a_strict_parser(spark):
    rnd = random.Random(6)
    tokens = ["{", "}", "[", "]", ",", ":", '"a"', '"', "1", "-1", "0", "01", "1.5", "1.", ".5", "e", "1e5", "true", "null", "NaN", "Infinity", "'", " ", "\n", "\t", "\x0b", "\xa0", "\x01", "\\", "\\n", "\\u12", "x", "//", "/**/", "﻿"]
    whole = json.dumps({"a": [1, -2.5, None, True, 'x\n"é\\'], "b": {"c": {}}, "": []}, ensure_ascii=False)
    texts = ["", "{}", "[" * 900 + "]" * 900, '{},9],[{}', '{"a":1},{"b":2}', '{"a":1}]', "1],[2", None, '{"a":1e999}', '{"a":-0}', '{"a":"' + "x" * 200_000 + '"}']
    texts += ["".join(rnd.choices(tokens, k=rnd.randint(1, 9))) for _ in range(6000)]
    for _ in range(4000):
        at = rnd.randrange(len(whole))
        texts.append(whole[:at] + rnd.choice(tokens) + whole[at + rnd.randrange(2) :])
    assert column(spark, repair.strict("t"), texts) == [t if t is not None and loads(t) is not ... else None for t in texts]
    raw = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = repair.parsed(raw, F.col("t")).select("i", "json", F.col("v").isNotNull().alias("there")).orderBy("i").collect()
    assert [r.json is not None for r in rows] == [r.there for r in rows]


def plain_merge(answers: list) -> tuple:
    """The answers of one document -> (result, error)."""
    within = lambda text: regex.search(r"\{[\s\S]*\}", text or "")
    commas = lambda text: regex.sub(rf",{BLANK}*([\]}}])", r"\1", text)
    controls = lambda text: regex.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text)
    if len(answers) > 1:
        parsed = [p for p in (loads(controls(commas(m[0]))) for m in map(within, answers) if m) if p is not ...]
        if not parsed:
            return None, merge.NO_CHUNK
        first, size = dict(parsed[0]), lambda text: len((text or "").encode("utf-16-be"))
        for section, name in merge.SECTIONS:
            held = {}
            for one in parsed:
                for entry in one.get(section) or []:
                    key = (entry.get(name) or "").lower().strip()
                    if not key:
                        continue
                    if key not in held:
                        held[key] = dict(entry)
                    elif section == "roles":
                        was = held[key]
                        was["pageNumbers"] = sorted({*(was.get("pageNumbers") or []), *(entry.get("pageNumbers") or [])})
                        if size(entry.get("description")) > size(was.get("description")):
                            was["description"] = entry["description"]
                        was["characteristics"] = list(dict.fromkeys([*(was.get("characteristics") or []), *(entry.get("characteristics") or [])]))
            first[section] = list(held.values())
        text = json.dumps(first, ensure_ascii=False)
    else:
        text = answers[0]
    if not (m := within(text)):
        return None, merge.NO_OBJECT
    fixed = SLOW.sub(lambda m: f'"{m[1]}\\n{m[2]}"', commas(m[0]))
    for attempt in (fixed, controls(fixed)):
        if (found := loads(attempt)) is not ...:
            return found, None
    return None, merge.MALFORMED


def test_merge_equals_a_loop(spark):
    rnd = random.Random(7)
    texts = ["so", "so, ]", "longer text", "\U0001f600\U0001f600", "abcd", "", 'with "quotes" \\ and é', "two\nlines", None]

    def answer():
        some = lambda make, most=3: [make() for _ in range(rnd.randint(0, most))]
        role = lambda: {k: v for k, v in {"name": rnd.choice(["Ann", " ann", "BOB", "bob ", "Cy", "", None]), "description": rnd.choice(texts), "pageNumbers": rnd.choice([[3, 1], [2.5, 2], [], None]), "characteristics": rnd.choice([["b", "a"], ["a", "c", "a"], None]), "agent": {"n": rnd.randint(0, 9)}, "speaking": rnd.choice([True, None])}.items() if rnd.random() < 0.85}
        named = lambda: {"roleName": rnd.choice(["x", " X", "y", "", None]), "n": rnd.randint(0, 99), "list": [None, 1, "a"]}
        whole = {"project": {"name": rnd.choice(texts), "extra": [1, {"a": None}]}, "version": rnd.randint(0, 9), "é key": rnd.choice(texts), "roles": some(role), "selfTapeInstructions": some(named), "formQuestions": some(named)}
        text = json.dumps({k: v for k, v in whole.items() if rnd.random() < 0.9}, ensure_ascii=rnd.random() < 0.5)
        return rnd.choice([text, text, text, f"here:\n```{text}\n```", text.replace("}]", "},\n ]"), text.replace("so", "s\x01o"), text[:-1], "nothing", "", None])

    docs = {i: [answer() for _ in range(rnd.choice([1, 1, 2, 3, 5]))] for i in range(250)}
    rows = [(d, n, raw) for d, answers in docs.items() for n, raw in enumerate(answers)]
    rnd.shuffle(rows)
    got = merge.merge_answers(spark.createDataFrame(rows, "doc_id int, ord int, raw string")).select("doc_id", F.to_json("result").alias("result"), "error").collect()
    assert len(got) == len(docs)
    for r in got:
        result, error = plain_merge(docs[r.doc_id])
        assert (r.result and json.loads(r.result), r.error) == (result, error), docs[r.doc_id]
    assert {r.error for r in got} == {None, merge.NO_CHUNK, merge.NO_OBJECT, merge.MALFORMED}


def test_merge_of_nothing(spark):
    assert merge.merge_answers(spark.createDataFrame([], "doc_id int, ord int, raw string")).collect() == []


def test_only_kept_values_are_written_out(spark):
    """Before values are grouped by key, JSON is made of traits alone, which are compared as texts; all else is carried as it was parsed."""
    chunks = spark.createDataFrame([(1, 0, '{"roles": [{"name": "a"}]}')], "doc_id int, ord int, raw string")
    plan = merge.merge_answers(chunks)._jdf.queryExecution().optimizedPlan().toString()
    below = [line for line in plan.splitlines() if "explode(" in line]
    assert below and sum(line.lower().count("to_json(") + line.lower().count("structstojson") for line in below) <= 1

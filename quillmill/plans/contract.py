"""Extension: which results break the rules that the extraction is asked to follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import js

#: What projects, roles and questions may be.
PROJECT_TYPES = ("commercial", "film", "tv_series", "short_film", "music_video", "web_series", "theatre", "vertical_short")
GENDERS = ("Male", "Female", "Any", "Non-binary")
QUESTION_TYPES = ("text", "radio", "textarea", "checkbox")
#: Questions that every role of a commercial is asked, and of a film or series; type, and whether an answer is required.
COMMERCIAL_QUESTIONS = (
    ("Do you have any competitive commercials currently on air?", "radio", True),
    ("Have you appeared in any competitive commercials in the last 2 years?", "radio", True),
    ("Please list any current brand conflicts", "textarea", True),
    ("Are you available for the fitting date?", "radio", True),
    ("Are you available for all shoot dates?", "radio", True),
    ("Do you have a valid passport?", "radio", False),
    ("Are you a permanent resident or citizen?", "radio", False),
    ("Do you have any visible tattoos?", "radio", False),
    ("What is your clothing size?", "text", False),
)
FILM_QUESTIONS = (
    ("Are you available for all production dates?", "radio", True),
    ("Do you have any scheduling conflicts during the production period?", "textarea", False),
    ("List any relevant experience", "textarea", False),
    ("Do you have a valid driver's license?", "radio", False),
)
FILM_TYPES = ("film", "tv_series", "short_film", "web_series")
SENTENCES, LEAST_VIDEOS = 3, 2


def sentences(text: Column | str) -> Column:
    """How many sentences a text has: what ends in a full stop, question or exclamation mark before a blank or the end.

    Quotes and brackets may close behind the mark; a rest without a mark is a sentence, too.
    """
    parts = F.split(js.trim(js.text_or_empty(text)), r"(?<=[.!?])[\"'”’)\]]*\s+")
    return F.size(F.filter(parts, lambda x: x.rlike(r"\w")))


def _items(c: Column) -> Column:
    return F.coalesce(c, F.array())


def _missing(asked: Column, standard: tuple[tuple[str, str, bool], ...]) -> Column:
    """Standard questions that a role's form lacks, with their type and requirement."""
    wanted = F.array(*(F.struct(F.lit(label).alias("label"), F.lit(kind).alias("type"), F.lit(required).alias("required")) for label, kind, required in standard))
    given = F.transform(_items(asked), lambda q: F.struct(js.trim(q["label"]).alias("label"), q["type"].alias("type"), F.coalesce(q["required"], F.lit(False)).alias("required")))
    return F.size(F.array_except(wanted, given))


def broken_rules(result: Column, first_page: Column, last_page: Column) -> Column:
    """(rule, n) for each rule: how often a typed result breaks it, pages having to lie between first and last."""
    project, roles, tapes, forms = result["project"], _items(result["roles"]), _items(result["selfTapeInstructions"]), _items(result["formQuestions"])
    count = lambda rows, rule: F.size(F.filter(rows, lambda x: F.coalesce(rule(x), F.lit(False))))
    total = lambda rows, n: F.aggregate(F.transform(rows, n), F.lit(0), lambda a, b: a + b)
    given = lambda c: js.truthy(c).isNotNull()
    kind = js.text_or_empty(project["type"])
    missing = F.when(kind == "commercial", total(forms, lambda f: _missing(f["questions"], COMMERCIAL_QUESTIONS))).when(kind.isin(*FILM_TYPES), total(forms, lambda f: _missing(f["questions"], FILM_QUESTIONS))).otherwise(0)
    rules = {
        "project_type": (given(project["type"]) & ~kind.isin(*PROJECT_TYPES)).cast("int"),
        "deadline": (given(project["deadline"]) & ~(project["deadline"].rlike(r"^\d{4}-\d{2}-\d{2}\z") & F.try_to_date(project["deadline"], "yyyy-MM-dd").isNotNull())).cast("int"),
        "description": count(roles, lambda r: sentences(r["description"]) != SENTENCES),
        "gender": count(roles, lambda r: r["gender"].isNotNull() & ~r["gender"].isin(*GENDERS)),
        "speaking": count(roles, lambda r: r["speaking"].isNull()),
        "page_numbers": total(roles, lambda r: count(_items(r["pageNumbers"]), lambda p: ~p.between(first_page, last_page))),
        "videos": count(tapes, lambda t: F.size(_items(t["videos"])) < LEAST_VIDEOS),
        "question_type": total(forms, lambda f: count(_items(f["questions"]), lambda q: ~js.text_or_empty(q["type"]).isin(*QUESTION_TYPES))),
        "standard_questions": missing,
        "empty_sections": sum(((F.size(x) == 0).cast("int") for x in (roles, tapes, forms)), F.lit(0)),
    }
    return F.array(*(F.struct(F.lit(rule).alias("rule"), F.coalesce(n, F.lit(0)).cast("int").alias("n")) for rule, n in rules.items()))


def violations(results: DataFrame, ids: list[str]) -> DataFrame:
    """(ids..., rule, n): a row for each rule and result of (ids..., result, first_page, last_page)."""
    return results.select(*ids, F.inline(broken_rules(F.col("result"), F.col("first_page"), F.col("last_page"))))

"""Repair and strict parsing of nearly-JSON text, by built-in expressions whose work grows with the text's length."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import js

RESULT = (
    "struct<project struct<name string, brand string, type string, location string, deadline string, director string, castingDirector string, productionDates string>, "
    "roles array<struct<name string, description string, ageRange string, gender string, speaking boolean, characteristics array<string>, pageNumbers array<int>>>, "
    "selfTapeInstructions array<struct<roleName string, videos array<struct<label string, description string>>, photos array<string>, filmingNotes array<string>>>, "
    "formQuestions array<struct<roleName string, questions array<struct<type string, label string, options array<string>, required boolean>>>>>"
)


#: White space, what ends a line, and control characters other than tab, line feed and carriage return.
SPACE = r"[\t\n\x0b\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
LINE_ENDS = r"\n\r\x{2028}\x{2029}"
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
#: Stands before a digit that says what it marks; where a text has this noncharacter itself, digit 0 follows it.
MARK = "\ufdd0"


def braces(c: Column | str) -> Column:
    """From the first opening to the last closing brace; NULL without both in this order."""
    c = js.col(c)
    first, behind = F.locate("{", c), F.locate("}", F.reverse(c))
    length = F.length(c) + 2 - behind - first
    return F.when((first > 0) & (behind > 0) & (length > 1), F.substring(c, first, length))


def without_trailing_commas(c: Column | str) -> Column:
    return F.regexp_replace(js.col(c), rf",{SPACE}*+([\]}}])", "$1")


def without_controls(c: Column | str) -> Column:
    """Strips control characters but tab, line feed and carriage return."""
    return F.regexp_replace(js.col(c), CONTROLS, "")


def escaped_line_feed(c: Column | str) -> Column:
    """The last raw line feed of a string becomes an escape, if a quote and colon stand on the line before the string.

    The string must be followed by a comma or a closing bracket. Its opening quote is the last one of its line, for no
    quote stands before the line feed. So one pass marks the last quote of each line that has a quote and colon before
    it, and a second one mends what follows a mark. Both take what they have read for good, so neither reads a part of
    the text more than a few times. Texts without a line feed are not touched.
    """
    own, last, line = f"{MARK}0", f"{MARK}1", f'[^"{LINE_ENDS}]'

    def mended(text: Column) -> Column:
        free = F.replace(text, F.lit(MARK), F.lit(own))
        marked = F.regexp_replace(free, f'(":(?:{line}*+")++)', f"$1{last}")
        escaped = F.regexp_replace(marked, rf'"{last}((?>[^"]*(?=\n)))\n([^"\n]*+)"(?={SPACE}*+[,}}\]])', r'"$1\\n$2"')
        return F.when(F.contains(text, F.lit("\n")), F.replace(F.replace(escaped, F.lit(last), F.lit("")), F.lit(own), F.lit(MARK))).otherwise(text)

    return js.let(js.col(c), mended)


def chunk_repair(c: Column | str) -> Column:
    """The order of repairs for one of several chunks."""
    return without_controls(without_trailing_commas(braces(c)))


def single_repair(c: Column | str) -> Column:
    """The order of repairs for a whole answer, before its first parse."""
    return escaped_line_feed(without_trailing_commas(braces(c)))


def _sealed(text: Column, seal: Column) -> Column:
    """A VARIANT list of the text's value and its seal, or NULL; only a text that is one value has the seal second.

    The parser is strict inside a value but stops behind the first one. A text that closes the list itself would have
    to hold its own digest to pass.
    """
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), seal, F.lit('"]')))


def _is_sealed(held: Column, seal: Column) -> Column:
    return F.try_variant_get(held, "$[1]", "string") == seal


def strict(c: Column | str) -> Column:
    """The text if a strict JSON parser takes it, else NULL: no trailing text, single quotes, NaN or raw control characters.

    Texts nested more than a thousand deep or with numbers of more than a thousand digits count as malformed.
    """
    c = js.col(c)
    seal = F.sha2(c, 256)
    return F.when(_is_sealed(_sealed(c, seal), seal), c)


def _parsed(texts: DataFrame, text: str, json: str, v: str) -> DataFrame:
    """Adds ``json``, the strict text of a column or NULL, and ``v``, its VARIANT; each text is parsed once."""
    held = texts.withColumn("_seal", F.sha2(text, 256)).withColumn("_held", _sealed(F.col(text), F.col("_seal")))
    whole = _is_sealed(F.col("_held"), F.col("_seal"))
    return held.withColumn(json, F.when(whole, F.col(text))).withColumn(v, F.when(whole, F.try_variant_get("_held", "$[0]", "variant"))).drop("_seal", "_held")


def parsed(raw: DataFrame, repaired: Column) -> DataFrame:
    """Adds ``json``, the strict text or NULL, and ``v``, its VARIANT."""
    return _parsed(raw.withColumn("_repaired", repaired), "_repaired", "json", "v").drop("_repaired")


def parse_single(raw: DataFrame, column: str = "raw") -> DataFrame:
    """A whole answer: what fails at first is parsed again without control characters. Only failures are parsed twice."""
    first = _parsed(raw.withColumn("_repaired", single_repair(column)), "_repaired", "json", "v")
    again = _parsed(first.withColumn("_cleaned", F.when(F.col("json").isNull(), without_controls("_repaired"))), "_cleaned", "_json", "_v")
    return again.withColumn("json", F.coalesce("json", "_json")).withColumn("v", F.coalesce("v", "_v")).drop("_repaired", "_cleaned", "_json", "_v")


def typed(v: Column | str, schema: str = RESULT) -> Column:
    """A VARIANT as the result type. What does not fit is NULL, and numbers are cut to the type: a view, the VARIANT keeps all."""
    return F.try_variant_get(js.col(v), "$", schema)

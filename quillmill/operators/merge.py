"""Merging of per-chunk records by normalised name, one shuffle on the key each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import js
from . import repair


def longest_first(text: Column | str, ord_: Column | str) -> Column:
    """Aggregate: the longest text, the earliest of equally long ones."""
    return F.max_by(js.col(text), F.struct(F.coalesce(js.length(text), F.lit(0)), -js.col(ord_)))


def distinct_union(array: Column | str, ord_: Column | str) -> Column:
    """Aggregate: elements in the order in which they were first seen."""
    rows = F.array_sort(F.collect_list(F.struct(js.col(ord_).alias("ord"), F.coalesce(js.col(array), F.array()).alias("items"))))
    return F.array_distinct(F.flatten(F.transform(rows, lambda r: r["items"])))


def keyed(rows: DataFrame, name: str) -> DataFrame:
    """Adds the merge key; rows without one go."""
    return rows.withColumn("key", js.name_key(name)).where(F.col("key").isNotNull() & (F.col("key") != ""))


def merge_roles(roles: DataFrame, scalars: tuple[str, ...] = ("name", "ageRange", "gender", "speaking")) -> DataFrame:
    """(ord, name, description, pageNumbers, characteristics, ...) -> one row per key, ``out_ord`` its first place.

    The first occurrence gives every scalar, even if NULL. Of descriptions the longest stays, the earlier one on
    ties; pages become a sorted set and characteristics a set in order of appearance, but what occurs once stays
    as it is. ``ord`` is one ordinal over all chunks.
    """
    scalars = tuple(c for c in scalars if c in roles.columns)
    grouped = keyed(roles, "name").groupBy("key").agg(
        F.count("*").alias("n"),
        F.min_by(F.struct(*scalars, "description", "pageNumbers", "characteristics"), "ord").alias("first"),
        F.min("ord").alias("out_ord"),
        longest_first("description", "ord").alias("longest"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("pageNumbers", F.array().cast("array<int>")))))).alias("pages"),
        distinct_union("characteristics", "ord").alias("seen"),
    )
    once = F.col("n") == 1
    return grouped.select(
        "out_ord", "key", *(F.col(f"first.{c}").alias(c) for c in scalars),
        F.when(once, F.col("first.description")).otherwise(F.col("longest")).alias("description"),
        F.when(once, F.col("first.pageNumbers")).otherwise(F.col("pages")).alias("pageNumbers"),
        F.when(once, F.col("first.characteristics")).otherwise(F.col("seen")).alias("characteristics"),
        "n",
    )


def first_wins(rows: DataFrame, name: str, ord_: str = "ord", partition: tuple[str, ...] = ()) -> DataFrame:
    """The earliest row of each key, whole."""
    held = keyed(rows, name)
    return held.groupBy(*partition, "key").agg(F.min_by(F.struct(*rows.columns), ord_).alias("r")).select("key", *(F.col(f"r.{c}").alias(c) for c in rows.columns))


def pick_first(rows: DataFrame, value: str, ord_: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The value of the earliest row that has one."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min_by(value, ord_).alias(value))


#: Errors of a document: none of its chunks could be parsed, its answer has no braces, or is malformed between them.
NO_CHUNK, NO_OBJECT, MALFORMED = "Failed to analyze any chunk", "Failed to parse AI response", "AI returned malformed JSON. Please try again."
#: The merged lists of a result and what their entries are named by.
SECTIONS = (("roles", "name"), ("selfTapeInstructions", "roleName"), ("formQuestions", "roleName"))
_ALL = len(SECTIONS)


def _string(v: Column, path: str) -> Column:
    """A member that is a JSON string; NULL for other values."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def _members(v: Column, *without: str) -> Column:
    """The members of an object, as ``"a":1,"b":2``, but for some."""
    left = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: ~k.isin(*without))
    return js.let(F.to_json(left), lambda text: F.substring(text, F.lit(2), F.length(text) - 2))


def _object(*members: Column) -> Column:
    """An object of the members that there are."""
    return F.concat(F.lit("{"), F.array_join(F.filter(F.array(*members), lambda m: m != ""), ","), F.lit("}"))


def _list(name: str, items: Column) -> Column:
    return F.concat(F.lit(f'"{name}":['), F.array_join(items, ",", "null"), F.lit("]"))


def _number(x: Column) -> Column:
    """A number as JSON has it: whole ones without a point."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def _item(kind: int, pos: Column, key: Column, x: Column, **more: Column) -> Column:
    given = {"kind": F.lit(kind), "at": F.struct(F.col("ord").cast("bigint").alias("ord"), pos.cast("int").alias("pos")), "key": key, "x": x, **more}
    kinds = {"raw": "string", "description": "string", "pages": "array<double>", "traits": "array<string>"}
    return F.struct(*(given.get(c, F.lit(None).cast(kinds.get(c, "string"))).alias(c) for c in ("kind", "at", "key", "x", *kinds)))


def _entries(kind: int, section: str, name: str) -> Column:
    """The entries of one list of a result: kind, place, key, value and, of roles, what is merged."""

    def entry(x: Column, i: Column) -> Column:
        merged = {"description": _string(x, "$.description"), "pages": F.try_variant_get(x, "$.pageNumbers", "array<double>"), "traits": F.transform(F.try_variant_get(x, "$.characteristics", "array<variant>"), lambda t: F.to_json(t))} if kind == 0 else {}
        return _item(kind, i, js.name_key(_string(x, f"$.{name}")), x, **merged)

    return F.coalesce(F.transform(F.try_variant_get("v", f"$.{section}", "array<variant>"), entry), F.array())


def _merged_role() -> Column:
    """The first role of a key with the longest description, all pages and all traits of the others."""
    longer = js.length("longest") > F.coalesce(js.length("description"), F.lit(0))
    rest = F.when(longer, _members(F.col("x"), "description", "pageNumbers", "characteristics")).otherwise(_members(F.col("x"), "pageNumbers", "characteristics"))
    longest = F.when(longer, F.concat(F.lit('"description":'), js.json_string("longest")))
    return _object(rest, longest, _list("pageNumbers", F.transform("pages", _number)), _list("characteristics", F.col("seen")))


def merge_answers(chunks: DataFrame) -> DataFrame:
    """(doc_id, ord, raw) for every chunk that was sent -> (doc_id, result, error), the result a VARIANT.

    The answer of a document of one chunk is repaired and parsed as it is. With more, even if only one could be parsed,
    the first parsed one gives all but the three lists: roles are merged, the first instructions and questions of each
    role stay. Entries keep members that nothing here knows. What is merged is written out as JSON and goes through
    the repairs of a single answer once more. Where there is no result, ``error`` says why. Entries without a name
    that is a string go, and a list that is no list counts as empty; equal traits are one, whatever their type.
    Members of an object may change their order. Every entry goes through one shuffle by its key, and what is left of
    it through one by its document; texts are parsed once, and only what is kept is written out.
    """
    held = repair.parsed(chunks.select("doc_id", "ord", "raw"), repair.chunk_repair("raw"))
    items = F.concat(F.array(_item(_ALL, F.lit(0), F.lit("all"), F.col("v"), raw=F.col("raw"))), *(_entries(kind, *of) for kind, of in enumerate(SECTIONS)))
    rows = held.select("doc_id", F.explode(items).alias("x")).where("x.key <> ''").select("doc_id", "x.*")
    length = F.struct(F.coalesce(js.length("description"), F.lit(0)).alias("len"), -F.col("at.ord"), -F.col("at.pos"))
    merged = rows.groupBy("doc_id", "kind", "key").agg(
        F.count("*").alias("n"), F.min("at").alias("at"), F.min_by("x", F.when(F.col("x").isNotNull(), F.col("at"))).alias("x"), F.min_by("raw", "at").alias("raw"),
        F.min_by("description", "at").alias("description"), F.max_by("description", length).alias("longest"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("pages", F.array().cast("array<double>")))))).alias("pages"), distinct_union("traits", "at").alias("seen"),
    )
    others = F.when(F.col("x").isNotNull(), _object(_members(F.col("x"), *(section for section, _ in SECTIONS))))
    entry = F.when(F.col("kind") == _ALL, others).when((F.col("kind") == 0) & (F.col("n") > 1), _merged_role()).otherwise(F.to_json("x")).alias("json")
    slim = merged.select("doc_id", "kind", "at", "n", "raw", entry)
    all_ = lambda c: F.first(F.when(F.col("kind") == _ALL, F.col(c)), ignorenulls=True)
    grouped = slim.groupBy("doc_id").agg(all_("n").alias("sent"), all_("raw").alias("raw"), all_("json").alias("others"), F.array_sort(F.collect_list(F.when(F.col("kind") < _ALL, F.struct("kind", "at", "json")))).alias("entries"))
    chosen = lambda kind: F.transform(F.filter("entries", lambda e: e["kind"] == kind), lambda e: e["json"])
    members = F.substring("others", F.lit(2), F.length("others") - 2)
    assembled = F.when(F.col("others").isNotNull(), _object(members, *(_list(section, chosen(kind)) for kind, (section, _) in enumerate(SECTIONS))))
    texts = grouped.select("doc_id", "sent", F.when(F.col("sent") == 1, F.col("raw")).otherwise(assembled).alias("text"))
    found = repair.parse_single(texts, "text")
    why = F.when((F.col("sent") > 1) & F.col("text").isNull(), NO_CHUNK).when(repair.braces("text").isNull(), NO_OBJECT).otherwise(MALFORMED)
    return found.select("doc_id", F.col("v").alias("result"), F.when(F.col("v").isNull(), why).alias("error"))

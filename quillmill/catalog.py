"""Queries over the driver's tables, and the DuckDB SQL that must give the same rows.

The tables stand in for extraction results: both sides derive names, pages, questions and the like from their
columns by the same expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import js
from .operators import extract, merge, pages, policies, repair, store
from .plans import contract, render
from .session import prepare, table
from .sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: table(prepare(spark), sf_dir, name))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _case(c, *values):
    """The value at c mod the number of values."""
    return F.get(F.array(*(F.lit(v) for v in values)), F.pmod(c, F.lit(len(values))).cast("int"))


# --- files and pages -------------------------------------------------------------------------------------


@query("""
SELECT doc_id, name, ext, regexp_matches(name, '(?i)[.](pdf|docx?)$') AS accepted, coalesce(mime = 'application/pdf', false) OR ends_with(name, '.pdf') AS pdf, ends_with(lower(name), '.pdf') AS looks_pdf
FROM (SELECT doc_id, 'doc_' || doc_id || '.' || ['pdf', 'PDF', 'docx', 'doc', 'txt'][doc_id % 5 + 1] AS name, ['pdf', 'PDF', 'docx', 'doc', 'txt'][doc_id % 5 + 1] AS ext, CASE WHEN doc_id % 7 = 0 THEN 'application/pdf' END AS mime FROM documents)
""")
def file_router(t):
    named = t("documents").select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("."), _case(F.col("doc_id"), "pdf", "PDF", "docx", "doc", "txt")).alias("name"), F.when(F.col("doc_id") % 7 == 0, "application/pdf").alias("mime"))
    return files.routed(named).select("doc_id", "name", "ext", "accepted", "pdf", "looks_pdf")


_PAGED = "SELECT doc_id, greatest(ceil(n_chars / 40.0)::INT, 1) AS n_pages FROM documents"


@query(f"""
SELECT doc_id, c::INT AS chunk_ix, total::INT AS total_chunks, (c * 95 + 1)::INT AS page_offset, least(c * 95 + 95, n_pages)::INT AS page_end
FROM (SELECT doc_id, n_pages, greatest(ceil(n_pages / 95.0), 1) AS total, unnest(range(0, greatest(ceil(n_pages / 95.0), 1)::BIGINT)) AS c FROM ({_PAGED}))
""")
def page_chunks(t):
    docs = t("documents").select("doc_id", F.greatest(F.ceil(F.col("n_chars") / F.lit(40.0)).cast("int"), F.lit(1)).alias("n_pages"))
    return pages.chunked(docs).select("doc_id", "chunk_ix", "total_chunks", "page_offset", "page_end")


_REQUESTED = "SELECT event_id, user_id % 50 AS doc_id, [k % 8 + 1, 3, k % 3, k % 8 + 1, 99] AS wanted FROM (SELECT event_id, user_id, json_extract_string(props, '$.k')::INT AS k FROM events)"
_TURNS = "SELECT conv_id AS doc_id, turn + 1 AS page_no, text FROM conversations"


@query(f"""
SELECT r.event_id, r.pos::INT AS pos, r.page_no::INT AS page_no, p.text
FROM (SELECT event_id, doc_id, unnest(wanted) AS page_no, unnest(range(0, 5)) AS pos FROM ({_REQUESTED})) r JOIN ({_TURNS}) p ON r.doc_id = p.doc_id AND r.page_no = p.page_no
""")
def page_select(t):
    k = F.get_json_object("props", "$.k").cast("int")
    requests = t("events").select("event_id", (F.col("user_id") % 50).alias("doc_id"), F.array(k % 8 + 1, F.lit(3), k % 3, k % 8 + 1, F.lit(99)).alias("page_numbers"))
    turns = t("conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_no"), "text")
    return pages.select_pages(requests, turns).select("event_id", "pos", "page_no", "text")


@query("""
SELECT doc_id, unnest(CASE WHEN doc_id % 3 = 0 THEN range(1, n + 1) ELSE [2, 1] END)::INT AS page_no, unnest(range(0, CASE WHEN doc_id % 3 = 0 THEN n ELSE 2 END))::INT AS pos
FROM (SELECT conv_id AS doc_id, max(turn + 1) AS n FROM conversations GROUP BY conv_id)
""")
def select_all_default(t):
    counts = pages.page_count(t("conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_no")))
    text = F.when(F.col("doc_id") % 3 == 0, "").otherwise("[2, 1]")
    return counts.select("doc_id", F.posexplode(pages.requested_or_all(pages.parse_page_list(text), F.col("n_pages"))).alias("pos", "page_no"))


@query("""
SELECT n.n_nationkey, 'Chunk ' || (n_nationkey % 4 + 1) || ' of 4 of ' || n_name || '; its first page is page ' || (n_nationkey % 4 * 95 + 1) AS prompt, t.text
FROM nation n CROSS JOIN (SELECT string_agg('=== ' || r_name || ' ===' || chr(10) || 'region ' || r_regionkey, chr(10) || chr(10) ORDER BY r_regionkey) AS text FROM region) t
""")
def broadcast_text(t):
    text = t("region").select(F.col("r_regionkey").alias("file_ord"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("mime"), F.concat(F.lit("region "), F.col("r_regionkey").cast("string")).cast("binary").alias("content"))
    chunks = t("nation").select("n_nationkey", pages.chunk_prompt("n_name", F.col("n_nationkey") % 4, F.lit(4), F.col("n_nationkey") % 4 * 95 + 1).alias("prompt"))
    return pages.with_shared_text(chunks, files.text_parts(text))


# --- repair and parsing ----------------------------------------------------------------------------------


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_get(t):
    return t("events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT event_id, '{\"k\": ' || json_extract_string(props, '$.k') || '}' AS json, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_repair(t):
    raw = t("events").select("event_id", F.concat(F.lit("noise "), F.replace("props", F.lit("}"), F.lit("\x01, }")), F.lit(" tail")).alias("raw"))
    return repair.parsed(raw, repair.chunk_repair("raw")).select("event_id", "json", F.try_variant_get("v", "$.k", "bigint").alias("k"))


@query("""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 4 THEN '{"a": "x' || chr(92) || 'ny", "k": ' || k || '}' END AS json, CASE WHEN event_id % 5 IN (0, 4) THEN k END AS k FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)
""")
def strict_json_gate(t):
    kind = F.col("event_id") % 5
    raw = t("events").select("event_id", F.when(kind == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(kind == 1, F.replace("props", F.lit('"'), F.lit("'"))).when(kind == 2, '{"k": NaN}').when(kind == 3, F.concat("props", F.lit(" y }"))).otherwise(F.concat(F.lit('{"a": "x\ny", "k": '), F.get_json_object("props", "$.k"), F.lit("}"))).alias("raw"))
    return repair.parse_single(raw).select("event_id", "json", F.try_variant_get("v", "$.k", "bigint").alias("k"))


_SPLIT_TEXT = ("""SELECT event_id, k, first, second, CASE event_id % 6 WHEN 0 THEN '{"text": "' WHEN 1 THEN '{"text":' || chr(10) || '"' WHEN 2 THEN '{"a": 1, "text": "x", "more": "' WHEN 3 THEN '{"list": ["' WHEN 4 THEN '{"text" : "' ELSE '{"text": "it''s", "more": "' END AS head,
  CASE event_id % 4 WHEN 0 THEN '"}' WHEN 1 THEN '"  , "k": 1}' WHEN 2 THEN '" : 2}' ELSE '"' || chr(10) || '}' END AS tail FROM (SELECT event_id, json_extract_string(props, '$.k') AS k, 'one' AS first, event_type || CASE WHEN event_id % 7 = 0 THEN chr(13) ELSE '' END AS second FROM events)""")


@query(f"""
SELECT event_id, head || first || CASE WHEN event_id % 6 IN (1, 4) OR event_id % 4 = 2 THEN chr(10) ELSE chr(92) || 'n' END || second || tail AS repaired FROM ({_SPLIT_TEXT})
""")
def newline_repair(t):
    e, text = F.col("event_id"), lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    head = _case(e, '{"text": "', '{"text":\n"', '{"a": 1, "text": "x", "more": "', '{"list": ["', '{"text" : "', '{"text": "it\'s", "more": "')
    tail = _case(e, '"}', '"  , "k": 1}', '" : 2}', '"\n}')
    second = text("event_type", F.when(e % 7 == 0, "\r").otherwise("")) if False else F.concat(F.col("event_type"), F.when(e % 7 == 0, "\r").otherwise(""))
    raw = t("events").select("event_id", text(head, "one\n", second, tail).alias("raw"))
    return raw.select("event_id", repair.single_repair("raw").alias("repaired"))


# --- merging ---------------------------------------------------------------------------------------------

_ROLES = """SELECT doc_id AS ord, CASE WHEN doc_id % 97 = 0 THEN 'solo' || doc_id WHEN doc_id % 2 = 0 THEN upper(source) ELSE '  ' || source || ' ' END AS name, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS gender,
  text AS description, [n_chars % 7 + 3, doc_id % 5 + 1, n_chars % 7 + 3] AS pages, [lang, 't' || doc_id % 3, lang] AS traits FROM documents"""


@query(f"""
WITH r AS (SELECT *, trim(lower(name)) AS key FROM ({_ROLES})),
n AS (SELECT key, count(*) AS n, min(ord) AS out_ord FROM r GROUP BY key),
firsts AS (SELECT r.* FROM r JOIN n ON r.key = n.key AND r.ord = n.out_ord),
longest AS (SELECT key, description FROM (SELECT key, description, row_number() OVER (PARTITION BY key ORDER BY coalesce(length(description), 0) DESC, ord) AS nth FROM r) WHERE nth = 1),
pages AS (SELECT key, list_sort(list_distinct(flatten(list(pages)))) AS pages FROM r GROUP BY key),
traits AS (SELECT key, string_agg(x, ',' ORDER BY spot) AS traits FROM (SELECT key, x, min(ord * 100 + pos) AS spot FROM (SELECT key, ord, unnest(traits) AS x, unnest(range(0, 3)) AS pos FROM r) GROUP BY key, x) GROUP BY key)
SELECT n.out_ord, n.key, f.name, f.gender, CASE WHEN n = 1 THEN f.description ELSE l.description END AS description, array_to_string(CASE WHEN n = 1 THEN f.pages ELSE p.pages END, ',') AS pages, CASE WHEN n = 1 THEN array_to_string(f.traits, ',') ELSE t.traits END AS traits
FROM n JOIN firsts f USING (key) JOIN longest l USING (key) JOIN pages p USING (key) JOIN traits t USING (key)
""")
def role_merge(t):
    id_ = F.col("doc_id")
    name = F.when(id_ % 97 == 0, F.concat(F.lit("solo"), id_.cast("string"))).when(id_ % 2 == 0, F.upper("source")).otherwise(F.concat(F.lit("  "), F.col("source"), F.lit(" ")))
    page = (F.col("n_chars") % 7 + 3).cast("int")
    roles = t("documents").select(id_.alias("ord"), name.alias("name"), F.when(id_ % 5 != 0, F.col("lang")).alias("gender"), F.col("text").alias("description"), F.array(page, (id_ % 5 + 1).cast("int"), page).alias("pageNumbers"), F.array("lang", F.concat(F.lit("t"), (id_ % 3).cast("string")), "lang").alias("characteristics"))
    return merge.merge_roles(roles).select("out_ord", "key", "name", "gender", "description", js.join(F.col("pageNumbers").cast("array<string>"), ",").alias("pages"), js.join("characteristics", ",").alias("traits"))


@query("""
SELECT user_id, key, event_id, value FROM (SELECT user_id, lower(trim(event_type)) AS key, event_id, value, row_number() OVER (PARTITION BY user_id, lower(trim(event_type)) ORDER BY ts, event_id) AS nth FROM events) WHERE nth = 1
""")
def first_wins(t):
    rows = t("events").select("user_id", F.concat(F.lit(" "), F.upper("event_type")).alias("name"), "event_id", "value", F.struct("ts", "event_id").alias("ord"))
    return merge.first_wins(rows, "name", partition=("user_id",)).select("user_id", "key", "event_id", "value")


@query("""
SELECT user_id, k FROM (SELECT user_id, json_extract_string(props, '$.k')::BIGINT AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events WHERE event_id % 3 > 0) WHERE nth = 1
""")
def project_pick(t):
    parsed = t("events").select("user_id", F.struct("ts", "event_id").alias("ord"), F.try_variant_get(F.try_parse_json(F.when(F.col("event_id") % 3 > 0, F.col("props")).otherwise("{oops")), "$.k", "bigint").alias("k"))
    return merge.pick_first(parsed, "k", "ord", ("user_id",))


@query("""
SELECT l_orderkey, string_agg(x, ',' ORDER BY spot) AS flags FROM (SELECT l_orderkey, x, min((l_linenumber, l_partkey, l_suppkey, l_extendedprice, pos)) AS spot FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, unnest([l_returnflag, l_linestatus]) AS x, unnest([0, 1]) AS pos FROM lineitem) GROUP BY l_orderkey, x) GROUP BY l_orderkey
""")
def distinct_union(t):
    rows = t("lineitem").withColumn("flags", F.array("l_returnflag", "l_linestatus"))
    return rows.groupBy("l_orderkey").agg(js.join(merge.distinct_union("flags", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")), ",").alias("flags"))


@query("""
SELECT conv_id, text AS longest FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(length(text), 0) DESC, turn) AS nth FROM conversations) WHERE nth = 1
""")
def longest_text(t):
    return t("conversations").groupBy("conv_id").agg(merge.longest_first("text", "turn").alias("longest"))


@query("""
WITH e AS (SELECT user_id AS doc_id, event_id AS ord, event_type, event_id % 9 = 0 AS broken, count(*) OVER (PARTITION BY user_id) AS sent FROM events),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS nth FROM e WHERE NOT broken),
r AS (SELECT doc_id, lower(event_type) AS key, min(ord) AS ord, arg_min(event_type, ord) AS name, arg_max(repeat('d', ord % 4 + 1), (ord % 4, -ord)) AS description, list_sort(list_distinct(list_concat([1, 2], list(ord % 3)))) AS pages FROM p GROUP BY doc_id, lower(event_type)),
one AS (SELECT doc_id, ' ' || event_type || '|' || repeat('d', ord % 4 + 1) || '|2,1,' || ord % 3 AS roles FROM p WHERE sent = 1),
many AS (SELECT doc_id, string_agg(' ' || name || '|' || description || '|' || array_to_string(CASE WHEN n = 1 THEN [2, 1, first_page] ELSE pages END, ','), ';' ORDER BY r.ord) AS roles FROM r JOIN (SELECT doc_id, lower(event_type) AS key, count(*) AS n, min(ord) % 3 AS first_page FROM p GROUP BY ALL) USING (doc_id, key) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN f.doc_id IS NOT NULL THEN 'p' || f.ord END AS project, coalesce(one.roles, many.roles) AS roles, CASE WHEN f.doc_id IS NULL AND d.sent = 1 THEN 'AI returned malformed JSON. Please try again.' WHEN f.doc_id IS NULL THEN 'Failed to analyze any chunk' END AS error
FROM (SELECT DISTINCT doc_id, sent FROM e) d LEFT JOIN (SELECT * FROM p WHERE nth = 1) f USING (doc_id) LEFT JOIN one USING (doc_id) LEFT JOIN many ON many.doc_id = d.doc_id
""")
def merged_results(t):
    e, text = F.col("event_id"), lambda x: F.lit(x) if isinstance(x, str) else x.cast("string")
    parts = ('here: {"project": {"name": "p', e, '"}, "roles": [{"name": " ', F.col("event_type"), '", "description": "', F.repeat(F.lit("d"), (e % 4 + 1).cast("int")), '", "pageNumbers": [2, 1, ', e % 3, "],}], ", F.when(e % 9 == 0, "'broken'").otherwise(""), "}")
    raw = t("events").select(F.col("user_id").alias("doc_id"), e.alias("ord"), F.concat(*map(text, parts)).alias("raw"))
    merged = merge.merge_answers(raw).select("doc_id", repair.typed("result").alias("result"), "error")
    shown = lambda r: F.concat(r["name"], F.lit("|"), r["description"], F.lit("|"), F.array_join(r["pageNumbers"].cast("array<string>"), ","))
    return merged.select("doc_id", F.col("result.project.name").alias("project"), F.when(F.col("error").isNull(), F.array_join(F.transform("result.roles", shown), ";")).alias("roles"), "error")


_ROLE_JSON = """'{"agent":"a' || first || '","characteristics":["x","t' || first % 2 || '"' || CASE WHEN n_traits > 1 THEN ',"t' || 1 - first % 2 || '"' ELSE '' END || '],"description":"' || description || '","name":" ' || name || '","pageNumbers":[' || array_to_string(CASE WHEN n = 1 THEN [2, 1, first % 3] ELSE pages END, ',') || ']}'"""


@query(f"""
WITH e AS (SELECT CASE WHEN event_id % 50 = 0 THEN -event_id ELSE user_id END AS doc_id, event_id AS ord, event_type, event_id % 9 AS kind FROM events),
s AS (SELECT doc_id, count(*) AS sent, max(kind) AS kind FROM e GROUP BY doc_id),
r AS (SELECT doc_id, lower(event_type) AS key, count(*) AS n, min(ord) AS first, arg_min(event_type, ord) AS name, arg_max(repeat('d', ord % 4 + 1), (ord % 4, -ord)) AS description, list_sort(list_distinct(list_concat([1, 2], list(ord % 3)))) AS pages, count(DISTINCT ord % 2) AS n_traits FROM e WHERE kind > 1 GROUP BY doc_id, lower(event_type)),
d AS (SELECT doc_id, min(first) AS ord, string_agg({_ROLE_JSON}, ',' ORDER BY first) AS roles, string_agg('{{"n":' || first || ',"roleName":"' || name || '"}}', ',' ORDER BY first) AS questions FROM r GROUP BY doc_id)
SELECT doc_id, '{{"formQuestions":[' || questions || '],"project":{{"name":"p' || ord || '"}},"roles":[' || roles || ']' || CASE WHEN sent > 1 THEN ',"selfTapeInstructions":[]' ELSE '' END || ',"version":' || ord || '}}' AS result,
  CASE WHEN ord IS NOT NULL THEN NULL WHEN sent > 1 THEN 'Failed to analyze any chunk' WHEN kind = 1 THEN 'Failed to parse AI response' ELSE 'AI returned malformed JSON. Please try again.' END AS error
FROM s LEFT JOIN d USING (doc_id)
""")
def merged_answers(t):
    """Members that nothing here knows, of results and of roles, come through the merge."""
    e, text = F.col("event_id"), lambda x: F.lit(x) if isinstance(x, str) else x.cast("string")
    role = (' "roles": [{"name": " ', F.col("event_type"), '", "agent": "a', e, '", "description": "', F.repeat(F.lit("d"), (e % 4 + 1).cast("int")), '", "pageNumbers": [2, 1, ', e % 3, '], "characteristics": ["x", "t', e % 2, '",]}],')
    parts = ('here: {"version": ', e, ', "project": {"name": "p', e, '"},', *role, ' "formQuestions": [{"roleName": "', F.col("event_type"), '", "n": ', e, "}], }")
    raw = F.when(e % 9 == 0, "{'broken'}").when(e % 9 == 1, "nothing").otherwise(F.concat(*map(text, parts)))
    chunks = t("events").select(F.when(e % 50 == 0, -e).otherwise(F.col("user_id")).alias("doc_id"), e.alias("ord"), raw.alias("raw"))
    return merge.merge_answers(chunks).select("doc_id", F.to_json("result").alias("result"), "error")


# --- stores ----------------------------------------------------------------------------------------------


@query("""
WITH latest AS (SELECT * FROM (SELECT o_custkey, o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS nth FROM orders) WHERE nth = 1)
SELECT c_custkey AS user_id, c_name AS id, CASE WHEN o_custkey IS NOT NULL THEN nullif(o_orderpriority, '1-URGENT') ELSE c_mktsegment END AS company_name FROM customer LEFT JOIN latest ON c_custkey = o_custkey
""")
def upsert_settings(t):
    held = t("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("id"), F.col("c_mktsegment").alias("company_name"))
    changes = t("orders").select(F.col("o_custkey").alias("user_id"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("company_name"), F.struct("o_orderdate", "o_orderkey").alias("updated_at"))
    return store.upsert(held, changes, "user_id", ["company_name"], "updated_at")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderkey % 2 = 0)")
def delete_owned(t):
    orders = t("orders").select("o_orderkey", "o_custkey")
    requests = orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).otherwise(F.col("o_custkey") + 1).alias("o_custkey"))
    return store.delete_by(orders, requests, ["o_orderkey", "o_custkey"])


@query("""
SELECT p_partkey AS user_id, CASE WHEN p_partkey % 4 > 1 THEN p_name WHEN p_partkey % 8 = 1 THEN p_brand ELSE 'Untitled' END AS name, 0::INT AS n_documents FROM part
""")
def insert_defaults(t):
    id_ = F.col("p_partkey")
    requests = t("part").select(id_.alias("user_id"), F.when(id_ % 4 == 0, "").when(id_ % 4 > 1, F.col("p_name")).alias("name"), F.to_json(F.struct(F.struct(F.when(id_ % 8 == 1, F.col("p_brand")).otherwise("").alias("name")).alias("project"))).alias("data"), F.lit(None).cast("array<struct<name:string,url:string>>").alias("documents"))
    return store.new_projects(requests).select("user_id", "name", F.size("documents").alias("n_documents"))


@query("""
SELECT n_nationkey AS user_id, CASE WHEN c_custkey IS NULL THEN '#00BFA5' ELSE nullif(c_mktsegment, 'BUILDING') END AS brand_color, CASE WHEN c_custkey IS NULL THEN '' ELSE c_name END AS company_name
FROM (SELECT n_nationkey FROM nation UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey > 100) u(n_nationkey) LEFT JOIN customer ON c_custkey = n_nationkey
""")
def overlay_defaults(t):
    users = t("nation").select(F.col("n_nationkey").cast("long").alias("user_id")).union(t("orders").where("o_orderkey > 100").select("o_orderkey"))
    held = t("customer").select(F.col("c_custkey").alias("user_id"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("brand_color"), F.col("c_name").alias("company_name"))
    return store.settings_or_defaults(users, held, {"brand_color": js.TEAL, "company_name": ""})


@query("""
SELECT c_custkey AS user_id, coalesce(n_name, 'House') AS company, CASE WHEN c_custkey % 2 = 0 THEN '#102030' ELSE '#00BFA5' END AS colour, CASE WHEN c_custkey % 2 = 0 THEN '16,32,48' ELSE '0,191,165' END AS rgb, CASE WHEN c_custkey % 2 = 0 THEN 'white' ELSE 'black' END AS text_colour,
  CASE WHEN c_custkey % 4 > 0 AND there THEN c_name END AS email, CASE WHEN there THEN '1' END AS phone, NULL::VARCHAR AS website, CASE WHEN there THEN c_mktsegment END AS header, CASE WHEN there THEN 'f' END AS footer,
  CASE WHEN c_custkey % 5 > 0 AND there THEN c_custkey || '/logo.png' END AS logo, CASE WHEN c_custkey % 5 > 1 AND there THEN 'data:' || CASE WHEN c_custkey % 3 = 0 THEN 'image/png' WHEN c_custkey % 3 = 1 THEN 'image/jpeg' ELSE '' END || ';base64,' || base64(encode(c_name)) END AS logo_uri, CASE WHEN c_custkey % 5 > 1 AND there THEN CASE WHEN c_custkey % 3 = 0 THEN 'png' ELSE 'jpeg' END END AS logo_format
FROM (SELECT *, c_nationkey < 20 AS there FROM customer) LEFT JOIN nation ON c_nationkey = n_nationkey AND c_custkey % 3 > 0 AND there
""".replace("CASE WHEN c_custkey % 2 = 0 THEN '#102030'", "CASE WHEN c_custkey % 2 = 0 AND there THEN '#102030'").replace("CASE WHEN c_custkey % 2 = 0 THEN '16,32,48'", "CASE WHEN c_custkey % 2 = 0 AND there THEN '16,32,48'").replace("CASE WHEN c_custkey % 2 = 0 THEN 'white'", "CASE WHEN c_custkey % 2 = 0 AND there THEN 'white'"))
def branding_join(t):
    k, customer = F.col("c_custkey"), t("customer")
    path = F.concat(k.cast("string"), F.lit("/logo.png"))
    given = {"company_name": F.when(k % 3 > 0, F.col("n_name")), "brand_color": F.when(k % 2 == 0, "#102030").otherwise(""), "contact_email": F.when(k % 4 > 0, F.col("c_name")).otherwise(""), "contact_phone": F.lit("1"), "contact_website": F.lit(""), "header_text": F.col("c_mktsegment"), "footer_text": F.lit("f"), "logo_path": F.when(k % 5 > 0, path)}
    settings = customer.where("c_nationkey < 20").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(k.alias("user_id"), *(given[c].alias(c) for c in store.SETTINGS_COLUMNS))
    logos = customer.where(k % 5 > 1).select(path.alias("path"), F.when(k % 3 < 2, _case(k % 3, "image/png", "image/jpeg")).alias("mime"), F.col("c_name").cast("binary").alias("content"))
    found = store.branding(customer.select(k.alias("user_id")), settings, "House", logos)
    shown = {"companyName": "company", "brandColor": "colour", "textColor": "text_colour", "contactEmail": "email", "contactPhone": "phone", "contactWebsite": "website", "headerText": "header", "footerText": "footer", "logoPath": "logo", "logoBase64": "logo_uri", "logoFormat": "logo_format"}
    return found.select("user_id", js.join(F.col("brandColorRgb").cast("array<string>"), ",").alias("rgb"), *(F.col(c).alias(o) for c, o in shown.items()))


@query("""
SELECT page_id, owner, length(url) <= 40 AND page_id % 3 < 2 AS accepted FROM (SELECT page_id, url, split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1) AS owner FROM pages) WHERE owner LIKE '%.com'
""")
def policy_rows(t):
    path = F.regexp_replace("url", "^[a-z]+://", "")
    size = F.when(F.length("url") <= 40, files.MAX_LOGO_BYTES).otherwise(files.MAX_LOGO_BYTES + 1)
    rows = t("pages").select("page_id", store.path_owner(path).alias("owner"), files.logo_accepted(size, _case(F.col("page_id"), "image/png", "image/jpeg", "text/html")).alias("accepted"))
    return rows.where(F.endswith("owner", F.lit(".com")))


@query("""
SELECT o_custkey AS user_id, o_orderkey AS id, o_orderstatus AS name, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey % 4 END::INT AS role_count, strftime(d, '%b ') || day(d) || strftime(d, ', %Y') AS short_date, strftime(d, '%B ') || day(d) || strftime(d, ', %Y') AS long_date,
  row_number() OVER (PARTITION BY o_custkey ORDER BY d DESC NULLS FIRST, o_orderkey)::INT AS place
FROM (SELECT *, CASE WHEN o_orderkey % 10 > 0 THEN o_orderdate END AS d FROM orders)
""")
def project_list(t):
    k = F.col("o_orderkey")
    rows = t("orders").select(F.col("o_custkey").alias("user_id"), k.alias("id"), F.col("o_orderstatus").alias("name"), F.when(k % 4 > 0, F.sequence(F.lit(1).cast("long"), k % 4)).alias("roles"), F.when(k % 10 > 0, F.col("o_orderdate")).alias("created_at"))
    return store.project_list(rows)


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT s_suppkey FROM supplier GROUP BY s_suppkey HAVING count(*) = 1) AND s_suppkey = 7")
def point_read(t):
    return store.exactly_one(t("supplier").select("s_suppkey", "s_name"), "s_suppkey", 7)


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def cascade_delete(t):
    survivors = t("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return store.cascade(t("orders"), survivors, "o_custkey").select("o_orderkey")


@query("SELECT page_id AS path, CASE WHEN page_id % 3 = 0 THEN 'new' ELSE url END AS content FROM pages")
def put_objects(t):
    held = t("pages").select(F.col("page_id").alias("path"), F.col("url").alias("content"))
    return store.put_objects(held, held.where("path % 3 = 0").withColumn("content", F.lit("new")))


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_outputs(t):
    return t("documents").join(t("labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT conv_id, count(*) AS n_turns, count(DISTINCT role) AS n_roles, count(*) FILTER (length(text) > 100) AS n_long FROM conversations GROUP BY conv_id")
def kpi_counts(t):
    return t("conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.countDistinct("role").alias("n_roles"), F.count_if(F.length("text") > 100).alias("n_long"))


# --- lookups and forms -----------------------------------------------------------------------------------

_KINDS = ("text", "radio", "textarea", "checkbox", "email", "other")
_TYPES = ("commercial", "feature_film", "tv_series", "vertical_short", "opera")


@query("""
SELECT p_partkey, ['control_textbox', 'control_radio', 'control_textarea', 'control_checkbox', 'control_email', 'control_textbox'][p_partkey % 6 + 1] AS control, ['26', '51', '28', '428', ''][p_partkey % 5 + 1] AS code FROM part
""")
def type_lookup(t):
    return t("part").select("p_partkey", render.control(_case(F.col("p_partkey"), *_KINDS)).alias("control"), js.lookup(_case(F.col("p_partkey"), *_TYPES), render.TYPE_CODES, "").alias("code"))


@query("SELECT p_partkey, p_name || ' — ' || p_type || CASE WHEN p_brand IN ('Brand#1', 'Brand#11') THEN '' ELSE ' | ' || p_brand END AS title FROM part")
def title_branch(t):
    company = F.when(F.col("p_brand").isin("Brand#1", "Brand#11"), "House").otherwise(F.col("p_brand"))
    return t("part").select("p_partkey", render.form_title("p_name", "p_type", company, "House").alias("title"))


def _questions(part):
    k = F.col("p_partkey")
    options = F.when(k % 5 > 0, F.array("p_brand", "p_type"))
    q = lambda kind, label, opts, required: F.struct(kind.alias("type"), label.alias("label"), opts.alias("options"), required.alias("required"))
    return part.select("p_partkey", "p_name", F.array(q(_case(k, *_KINDS), F.col("p_name"), options, k % 3 == 0), q(F.lit("radio"), F.lit("Size?"), F.array(F.lit("S"), F.lit("L")), F.lit(None).cast("boolean"))).alias("questions"))


_KIND_SQL = "['control_textbox', 'control_radio', 'control_textarea', 'control_checkbox', 'control_email', 'control_textbox'][p_partkey % 6 + 1]"


@query(f"""
SELECT p_partkey, ord::INT AS ord, kind, label, required, options FROM (SELECT p_partkey, unnest(range(1, 10)) AS ord,
  unnest(['control_head', 'control_fullname', 'control_email', 'control_phone', 'control_textbox', 'control_textbox', {_KIND_SQL}, 'control_radio', 'control_button']) AS kind,
  unnest([p_name, 'Full Name', 'Email Address', 'Phone Number', 'City and State', 'Your Agent/Manager', p_name, 'Size?', 'Submit Application']) AS label,
  unnest([NULL, 'Yes', 'Yes', 'No', 'No', 'No', CASE WHEN p_partkey % 3 = 0 THEN 'Yes' ELSE 'No' END, 'No', NULL]) AS required,
  unnest([NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN p_partkey % 5 > 0 THEN p_brand || '|' || p_type END, 'S|L', NULL]) AS options FROM part)
""")
def form_fields(t):
    rows = _questions(t("part")).select("p_partkey", F.explode(render.form_rows(F.col("questions"), F.col("p_name"))).alias("r"))
    return rows.select("p_partkey", F.col("r.order").cast("int").alias("ord"), F.col("r.type").alias("kind"), F.col("r.text").alias("label"), F.col("r.required").alias("required"), F.col("r.options").alias("options"))


@query("""
SELECT p_partkey, 'Full Name (required)' || chr(10) || 'Email Address (required)' || chr(10) || 'Phone Number' || chr(10) || 'City and State' || chr(10) || 'Your Agent/Manager' || chr(10) || p_name || own || CASE WHEN p_partkey % 3 = 0 THEN ' (required)' ELSE '' END || chr(10) || 'Size? [S / L]' AS form,
  'Create a casting application form with these fields:' || chr(10) || chr(10) || '1. Full Name (required)' || chr(10) || '2. Email Address (required)' || chr(10) || '3. Phone Number' || chr(10) || '4. City and State' || chr(10) || '5. Your Agent/Manager' || chr(10) || chr(10)
    || '6. ' || p_name || listed || CASE WHEN p_partkey % 3 = 0 THEN ' (REQUIRED)' ELSE '' END || chr(10) || '7. Size? — Options: S, L' AS mail,
  'Full Name *' || chr(10) || 'Email *' || chr(10) || 'Phone' || chr(10) || 'City/State' || chr(10) || 'Agent/Manager' || chr(10) || chr(10) || p_name || own || CASE WHEN p_partkey % 3 = 0 THEN ' *' ELSE '' END || chr(10) || 'Size? [S / L]' AS screen
FROM (SELECT *, CASE WHEN p_partkey % 6 = 1 AND p_partkey % 5 > 0 THEN ' [' || p_brand || ' / ' || p_type || ']' ELSE '' END AS own,
  CASE WHEN p_partkey % 6 = 1 AND p_partkey % 5 > 0 THEN ' — Options: ' || p_brand || ', ' || p_type ELSE '' END AS listed FROM part)
""")
def question_text(t):
    return _questions(t("part")).select("p_partkey", *(js.join(render.question_sheet(notation, F.col("questions")), "\n").alias(notation) for notation in ("form", "mail", "screen")))


@query(f"""
SELECT p_partkey, '{{"properties":{{"title":' || to_json(p_name) || '}},"questions":{{"1":{{"type":"control_head","text":' || to_json(p_name) || ',"order":"1"}},"2":{{"type":"control_fullname","text":"Full Name","required":"Yes","order":"2"}},'
  || '"3":{{"type":"control_email","text":"Email Address","required":"Yes","order":"3"}},"4":{{"type":"control_phone","text":"Phone Number","required":"No","order":"4"}},"5":{{"type":"control_textbox","text":"City and State","required":"No","order":"5"}},'
  || '"6":{{"type":"control_textbox","text":"Your Agent/Manager","required":"No","order":"6"}},"7":{{"type":"' || {_KIND_SQL} || '","text":' || to_json(p_name) || ',"required":"' || CASE WHEN p_partkey % 3 = 0 THEN 'Yes' ELSE 'No' END || '","order":"7"'
  || CASE WHEN p_partkey % 5 > 0 THEN ',"options":' || to_json(p_brand || '|' || p_type) ELSE '' END || '}},"8":{{"type":"control_radio","text":"Size?","required":"No","order":"8","options":"S|L"}},"9":{{"type":"control_button","text":"Submit Application","order":"9"}}}}}}' AS form FROM part
""")
def form_definition(t):
    rows = _questions(t("part"))
    return rows.select("p_partkey", render.form_json(F.col("p_name"), render.form_rows(F.col("questions"), F.col("p_name"))).alias("form"))


# --- text and layout -------------------------------------------------------------------------------------


@query("""
SELECT c_custkey, c_name || chr(10) || 'Age: N/A' || chr(10) || 'Gender: ' || CASE WHEN c_custkey % 2 = 0 THEN 'Any' ELSE 'N/A' END || CASE WHEN c_custkey % 3 = 0 THEN chr(10) || 'Ethnicity: ' || c_nationkey ELSE '' END || chr(10) || chr(10) || c_mktsegment AS block FROM customer
""")
def role_block(t):
    k = F.col("c_custkey")
    return t("customer").select("c_custkey", render.role_block(F.col("c_name"), F.col("c_mktsegment"), F.lit(None).cast("string"), F.when(k % 2 == 0, "Any").otherwise(""), F.when(k % 3 == 0, F.col("c_nationkey").cast("string")).otherwise("")).alias("block"))


@query("""
SELECT c_custkey, 'Intro: ' || c_name || chr(10) || 'Scene: ' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || chr(10) || 'Photos:' || chr(10) || 'head' || chr(10) || c_nationkey ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN chr(10) || chr(10) || 'Filming Notes:' || chr(10) || c_name ELSE '' END AS block FROM customer
""")
def instruction_block(t):
    k, video = F.col("c_custkey"), lambda label, c: F.struct(F.lit(label).alias("label"), F.col(c).alias("description"))
    photos = F.when(k % 2 == 0, F.array(F.lit("head"), F.col("c_nationkey").cast("string"))).otherwise(F.array().cast("array<string>"))
    return t("customer").select("c_custkey", render.instruction_block(F.array(video("Intro", "c_name"), video("Scene", "c_mktsegment")), photos, F.when(k % 3 == 0, F.array("c_name"))).alias("block"))


def _results(t):
    """A result for each region: its nations are roles, the larger ones have instructions and questions."""
    nation = t("nation").select("n_regionkey", "n_nationkey", "n_name")
    even = F.col("n_nationkey") % 2 == 0
    role = F.struct(F.col("n_name").alias("name"), F.concat(F.lit("About "), F.col("n_name")).alias("description"), F.when(even, "20-30").alias("ageRange"), F.when(even, "Any").otherwise("").alias("gender"), even.alias("speaking"))
    tape = F.struct(F.col("n_name").alias("roleName"), F.array(F.struct(F.lit("SLATE").alias("label"), F.col("n_name").alias("description"))).alias("videos"), F.when(even, F.array(F.lit("front"), F.lit("side"))).alias("photos"), F.when(~even, F.array(F.lit("quiet room"), F.lit("landscape"))).alias("filmingNotes"))
    form = F.struct(F.col("n_name").alias("roleName"), F.array(F.struct(F.lit("text").alias("type"), F.lit("Height?").alias("label"), even.alias("required"))).alias("questions"))
    listed = lambda item: F.transform(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("k"), item.alias("item")))), lambda s: s["item"])
    by_region = nation.groupBy("n_regionkey").agg(listed(role).alias("roles"), listed(tape).alias("selfTapeInstructions"), listed(form).alias("formQuestions"))
    project = F.struct(F.col("r_name").alias("name"), F.lit("").alias("brand"), F.lit("feature_film").alias("type"), F.when(F.col("r_regionkey") > 1, F.col("r_name")).alias("location"), F.lit(None).cast("string").alias("director"), F.lit("May").alias("productionDates"))
    return t("region").join(by_region, F.col("r_regionkey") == F.col("n_regionkey")).select("r_regionkey", F.struct(project.alias("project"), "roles", "selfTapeInstructions", "formQuestions").alias("result"))


_N = "chr(10)"
_EVEN = "n_nationkey % 2 = 0"


@query(f"""
SELECT r_regionkey, repeat('=', 50) || {_N} || 'PROJECT REPORT' || {_N} || repeat('=', 50) || {_N} || {_N} || 'PROJECT' || {_N} || repeat('-', 30) || {_N} || 'Name: ' || r_name || {_N} || 'Type: feature film' || {_N} || CASE WHEN r_regionkey > 1 THEN 'Location: ' || r_name || {_N} ELSE '' END || 'Dates: May' || {_N} || {_N} || 'ROLES' || {_N} || repeat('-', 30) || {_N}
  || string_agg(nth || '. ' || n_name || CASE WHEN {_EVEN} THEN ' (Speaking)' ELSE ' (Non-speaking)' END || {_N} || '   About ' || n_name || {_N} || CASE WHEN {_EVEN} THEN '   Age: 20-30' || {_N} || '   Gender: Any' || {_N} ELSE '' END, {_N} ORDER BY n_nationkey) || {_N}
  || 'SELF-TAPE INSTRUCTIONS' || {_N} || repeat('-', 30) || {_N}
  || string_agg('Role: ' || n_name || {_N} || '  SLATE: ' || n_name || {_N} || CASE WHEN {_EVEN} THEN '  Photos: front, side' ELSE '  Filming Notes:' || {_N} || '    1. quiet room' || {_N} || '    2. landscape' END || {_N}, {_N} ORDER BY n_nationkey) || {_N}
  || 'FORM QUESTIONS' || {_N} || repeat('-', 30) || {_N} || string_agg('Role: ' || n_name || {_N} || '  - Height? (text)' || CASE WHEN {_EVEN} THEN ' *' ELSE '' END || {_N}, {_N} ORDER BY n_nationkey) AS report
FROM region JOIN (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS nth FROM nation) ON r_regionkey = n_regionkey GROUP BY r_regionkey, r_name
""")
def report_lines(t):
    return _results(t).select("r_regionkey", render.report_text(F.col("result"), "PROJECT REPORT").alias("report"))


@query(f"""
SELECT r_regionkey, 'PROJECT: ' || r_name || {_N} || 'Brand: ' || {_N} || 'Type: feature_film' || {_N} || 'Location: ' || CASE WHEN r_regionkey > 1 THEN r_name ELSE 'N/A' END || {_N} || 'Director: N/A' || {_N} || 'Dates: May' || {_N} || {_N} || 'ROLES:' || {_N}
  || string_agg(n_name || CASE WHEN {_EVEN} THEN ' (Speaking) | Age: 20-30 | Any' ELSE ' (Non-speaking)' END || {_N} || 'About ' || n_name, {_N} || {_N} ORDER BY n_nationkey) || {_N} || {_N} || 'SELF-TAPE INSTRUCTIONS:' || {_N}
  || string_agg(n_name || ':' || {_N} || '  SLATE: ' || n_name || CASE WHEN {_EVEN} THEN {_N} || '  Photos: front, side' ELSE {_N} || '  Notes: quiet room; landscape' END, {_N} || {_N} ORDER BY n_nationkey) || {_N} || {_N} || 'FORM QUESTIONS:' || {_N}
  || string_agg(n_name || ':' || {_N} || '  - Height? (text)', {_N} || {_N} ORDER BY n_nationkey) AS everything
FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey, r_name
""")
def copy_all(t):
    return _results(t).select("r_regionkey", render.copy_text(F.col("result")).alias("everything"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 > 0 THEN 'Made here' ELSE concat_ws('  |  ', CASE WHEN c_custkey % 3 > 0 THEN c_name END, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END) END AS line1,
  CASE WHEN c_custkey % 5 = 0 THEN 'own' WHEN c_custkey % 3 = 0 AND c_custkey % 2 > 0 THEN NULL ELSE 'Made here' END AS line2 FROM customer
""")
def footer(t):
    k = F.col("c_custkey")
    first, second = render.footer(F.when(k % 3 > 0, F.col("c_name")).otherwise("House"), [F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise(""), F.lit(None).cast("string")], F.when(k % 5 == 0, "own"), "House", "Made here")
    return t("customer").select("c_custkey", first.alias("line1"), second.alias("line2"))


@query("""
SELECT p_partkey, unnest(['Name', 'Brand', 'Type']) AS label, unnest([p_name, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_brand END, CASE WHEN p_partkey % 3 > 0 THEN p_type END]) AS value FROM part
QUALIFY value IS NOT NULL AND value <> ''
""".replace("QUALIFY", ") WHERE").replace("SELECT p_partkey, unnest", "SELECT * FROM (SELECT p_partkey, unnest", 1))
def unpivot_fields(t):
    k = F.col("p_partkey")
    return render.unpivoted(t("part"), ["p_partkey"], [("Name", F.col("p_name")), ("Brand", F.when(k % 2 == 0, "").otherwise(F.col("p_brand"))), ("Type", F.when(k % 3 > 0, F.col("p_type")))])


_HEX = "printf('#%06x', (p_partkey * 7919) % 16777216)"


@query("SELECT p_partkey, (p_partkey * 7919 % 16777216) // 65536 || ',' || (p_partkey * 7919 % 65536) // 256 || ',' || (p_partkey * 7919 % 256) AS rgb FROM part")
def hex_rgb(t):
    colour = F.format_string("#%06x", F.col("p_partkey") * 7919 % 16777216)
    return t("part").select("p_partkey", js.join(js.hex_to_rgb(colour).cast("array<string>"), ",").alias("rgb"))


@query("""
SELECT p_partkey, CASE WHEN (((p_partkey * 7919 % 16777216) // 65536)::DOUBLE * 0.299::DOUBLE + ((p_partkey * 7919 % 65536) // 256)::DOUBLE * 0.587::DOUBLE + (p_partkey * 7919 % 256)::DOUBLE * 0.114::DOUBLE) / 255.0::DOUBLE > 0.5::DOUBLE THEN 'black' ELSE 'white' END AS text_colour FROM part
""")
def contrast(t):
    colour = F.format_string("#%06x", F.col("p_partkey") * 7919 % 16777216)
    return t("part").select("p_partkey", js.contrast_text(js.hex_to_rgb(colour)).alias("text_colour"))


@query(r"""
SELECT p_partkey, regexp_replace(x, '[^a-zA-Z0-9]', '_', 'g') AS each, regexp_replace(x, '[^a-zA-Z0-9]+', '_', 'g') AS runs, regexp_replace(x, '\s+', '_', 'g') AS spaces, replace(x, '"', '') AS unquoted, replace(x, '_', ' ') AS spaced FROM (SELECT p_partkey, p_name || ' "' || p_brand || '"  x_' || p_type AS x FROM part)
""")
def sanitizers(t):
    x = F.concat(F.col("p_name"), F.lit(' "'), F.col("p_brand"), F.lit('"  x_'), F.col("p_type"))
    return t("part").select("p_partkey", js.sanitize_each(x).alias("each"), js.sanitize_runs(x).alias("runs"), js.sanitize_spaces(x).alias("spaces"), js.without_quotes(x).alias("unquoted"), js.spaced(x).alias("spaced"))


@query("SELECT p_partkey, 'https://forms.example.com/new?title=' || replace(replace(replace(url_encode(p_name || ' (1)!*~' || p_brand), '%28', '('), '%29', ')'), '%21', '!') AS url FROM part".replace("replace(replace(replace(", "replace(replace(replace(replace(").replace("'%21', '!')", "'%21', '!'), '%2A', '*')"))
def uri_encode(t):
    return t("part").select("p_partkey", render.form_url("https://forms.example.com/new?title=", F.concat(F.col("p_name"), F.lit(" (1)!*~"), F.col("p_brand"))).alias("url"))


@query("SELECT item_id, 'data:text/plain;base64,' || base64(encode(text)) AS uri FROM benchmark")
def base64_text(t):
    return t("benchmark").select("item_id", js.data_uri(F.lit("text/plain"), F.col("text").cast("binary")).alias("uri"))


@query("SELECT doc_id, round(n_chars / 1024.0::DOUBLE)::BIGINT || 'KB' AS size FROM documents")
def size_label(t):
    return t("documents").select("doc_id", js.size_label("n_chars").alias("size"))


#: Fixed value: what marks an entry as one on ethnicity; it also finds the letters inside words.
ETHNICITY = "(?i)ethni|race|background|asian|african|latin|caucas|indigenous|pacific"


@query(f"SELECT doc_id, list_filter(string_split(text, ' '), lambda w: regexp_matches(w, '{ETHNICITY}'))[1] AS found FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'tall graceful asian' ELSE text END AS text FROM documents)")
def ethnicity_find(t):
    words = F.split(F.when(F.col("doc_id") % 4 == 0, "tall graceful asian").otherwise(F.col("text")), " ")
    return t("documents").select("doc_id", js.first_like(words, ETHNICITY).alias("found"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '1,3' WHEN p_size % 3 = 0 THEN '1,2,3,5' ELSE '1,2,3,7' END AS ids FROM part")
def set_toggle(t):
    x = F.when(F.col("p_size") % 2 == 0, 2).when(F.col("p_size") % 3 == 0, 5).otherwise(7)
    return t("part").select("p_partkey", js.join(js.toggled(F.array(F.lit(1), F.lit(2), F.lit(3)), x).cast("array<string>"), ",").alias("ids"))


@query("SELECT p_partkey, array_to_string(list_filter(['a', 'b', 'c'], lambda x, i: i <> p_partkey % 4 + 1), ',') AS kept FROM part")
def index_drop(t):
    return t("part").select("p_partkey", js.join(js.without_index(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.col("p_partkey") % 4), ",").alias("kept"))


@query(f"""
SELECT event_id, (SELECT count(*) FROM (SELECT sum(ms) OVER (ORDER BY i) AS spot FROM (SELECT unnest({list(render.STEP_MS[:-1])}) AS ms, unnest(range(0, 15)) AS i)) WHERE spot <= elapsed)::INT AS step FROM (SELECT event_id, event_id * 37 % 90000 AS elapsed FROM events)
""")
def schedule_asof(t):
    return t("events").select("event_id", render.step_at(F.col("event_id") * 37 % 90000, render.schedule(list(render.STEP_MS[:-1]))).cast("int").alias("step"))


def _wrap_sql(name: str, source: str, millimetres: int) -> str:
    """Recursive parts ``name`` (id, lines, n) for a source (id, text): its pieces one after the other into lines."""
    most, blank = millimetres * 720_000 // (render.POINTS * 254), render.HELVETICA[0]
    width = f"CASE WHEN {{0}} = '' THEN 0 ELSE list_sum(list_transform(string_split({{0}}, ''), lambda c: CASE WHEN ascii(c) BETWEEN 32 AND 126 THEN {list(render.HELVETICA)}[ascii(c) - 31] ELSE {render.OTHER_WIDTH} END)) END"
    new = f"x.begins OR f.used + x.gap + x.width > {most} AND f.used > 0"
    return f"""{name}_p AS (SELECT id, unnest(ps) AS p, unnest(range(len(ps))) AS pi FROM (SELECT id, string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) AS ps FROM ({source}))),
{name}_w AS (SELECT id, pi, unnest(ws) AS w, unnest(range(len(ws))) AS wi FROM (SELECT id, pi, string_split(p, ' ') AS ws FROM {name}_p)),
{name}_c AS (SELECT id, pi, wi, unnest(cs) AS c, unnest(range(len(cs))) AS ci FROM (SELECT id, pi, wi, CASE WHEN {width.format("w")} > {most} THEN string_split(w, '') ELSE [w] END AS cs FROM {name}_w)),
{name}_n AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY pi, wi, ci) AS nth, c, {width.format("c")} AS width, CASE WHEN wi > 0 AND ci = 0 THEN {blank} ELSE 0 END AS gap, wi = 0 AND ci = 0 AS begins FROM {name}_c),
{name}_f AS (SELECT id, nth, c AS line, width AS used, '' AS done, 1 AS n FROM {name}_n WHERE nth = 1
  UNION ALL SELECT f.id, x.nth, CASE WHEN {new} THEN x.c ELSE f.line || CASE WHEN x.gap > 0 THEN ' ' ELSE '' END || x.c END, CASE WHEN {new} THEN x.width ELSE f.used + x.gap + x.width END,
    CASE WHEN {new} THEN f.done || f.line || chr(10) ELSE f.done END, CASE WHEN {new} THEN f.n + 1 ELSE f.n END FROM {name}_f f JOIN {name}_n x ON x.id = f.id AND x.nth = f.nth + 1),
{name} AS (SELECT id, arg_max(done || line, nth) AS lines, arg_max(n, nth)::INT AS n FROM {name}_f GROUP BY id)"""


@query(f"WITH RECURSIVE {_wrap_sql('wide', 'SELECT item_id AS id, text FROM benchmark', 180)}, {_wrap_sql('slim', 'SELECT item_id AS id, text FROM benchmark', 20)} SELECT wide.id AS item_id, wide.lines AS wide, slim.lines AS slim, slim.n AS n_slim FROM wide JOIN slim USING (id)")
def wrapped_text(t):
    slim = render.wrapped("text", 20)
    return t("benchmark").select("item_id", F.array_join(render.wrapped("text", 180), "\n").alias("wide"), F.array_join(slim, "\n").alias("slim"), F.size(slim).alias("n_slim"))


@query(f"""
WITH RECURSIVE {_wrap_sql("said", "SELECT conv_id * 1000 + turn AS id, text FROM conversations", 180)},
blocks AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth, 9 + 4 * n AS height FROM conversations JOIN said ON id = conv_id * 1000 + turn),
placed AS (SELECT conv_id, nth, 38 AS y, 1 AS page, CASE WHEN 38 + height > 270 THEN 15 ELSE 38 + height END AS next_y, CASE WHEN 38 + height > 270 THEN 2 ELSE 1 END AS next_page FROM blocks WHERE nth = 1
  UNION ALL SELECT b.conv_id, b.nth, p.next_y, p.next_page, CASE WHEN p.next_y + b.height > 270 THEN 15 ELSE p.next_y + b.height END, CASE WHEN p.next_y + b.height > 270 THEN p.next_page + 1 ELSE p.next_page END FROM placed p JOIN blocks b ON b.conv_id = p.conv_id AND b.nth = p.nth + 1)
SELECT conv_id, nth::INT AS nth, y::INT AS y, page::INT AS page FROM placed
""")
def paginate_videos(t):
    turns = t("conversations").select("conv_id", "turn", (render.BLOCK + render.LINE * F.size(render.wrapped("text", render.TEXT_WIDTH))).alias("height"))
    heights = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "height"))), lambda s: s["height"]).alias("heights"))
    rows = heights.select("conv_id", F.posexplode(render.stacked(F.col("heights"), 38)).alias("pos", "at"))
    return rows.select("conv_id", (F.col("pos") + 1).alias("nth"), F.col("at.y").alias("y"), F.col("at.page").alias("page"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 35 ELSE 15 END::INT AS x, CASE WHEN p_size % 3 = 0 THEN 28 ELSE 30 END::INT AS y FROM part")
def header_layout(t):
    return t("part").select("p_partkey", render.logo_offset(F.col("p_size") % 2 == 0).alias("x"), render.first_line(F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_name"))).alias("y"))


@query("SELECT user_id, count(*) AS n, sum(value) FILTER (nth <= 3) AS first_three FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events) GROUP BY user_id")
def running_numbers(t):
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t("events").withColumn("nth", nth).groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("nth") <= 3, F.col("value"))).alias("first_three"))


# --- saving, guards, attachments and sheets --------------------------------------------------------------


@query("""
WITH body AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS company_name, CASE WHEN c_custkey % 3 = 0 THEN '#102030' ELSE '' END AS brand_color, c_mktsegment AS header_text FROM customer WHERE c_custkey % 5 > 0)
SELECT c_custkey AS user_id, CASE WHEN b.user_id IS NULL THEN 'before' ELSE nullif(company_name, '') END AS company_name, CASE WHEN b.user_id IS NULL THEN c_phone ELSE coalesce(nullif(brand_color, ''), '#00BFA5') END AS brand_color,
  CASE WHEN b.user_id IS NOT NULL THEN header_text END AS header_text, CASE WHEN b.user_id IS NOT NULL THEN TIMESTAMP '2026-01-02 03:04:05' END AS updated_at
FROM (SELECT c_custkey, '#ffffff' AS c_phone FROM customer) c LEFT JOIN body b ON c_custkey = b.user_id
""")
def settings_save(t):
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    given = {"company_name": F.when(k % 2 == 0, F.col("c_name")).otherwise(""), "brand_color": F.when(k % 3 == 0, "#102030").otherwise(""), "header_text": F.col("c_mktsegment")}
    bodies = t("customer").where(k % 5 > 0).select(k.alias("user_id"), *(given.get(c, F.lit("")).alias(c) for c in store.SETTINGS_COLUMNS))
    before = {"company_name": F.lit("before"), "brand_color": F.lit("#ffffff")}
    held = t("customer").select(k.alias("user_id"), *(before.get(c, none).alias(c) for c in store.SETTINGS_COLUMNS), F.lit(None).cast("timestamp").alias("updated_at"))
    saved = store.save_settings(held, bodies, F.lit("2026-01-02 03:04:05").cast("timestamp"))
    return saved.select("user_id", "company_name", "brand_color", "header_text", "updated_at")


@query("""
SELECT sha256(o_custkey || '/' || o_orderkey) AS id, o_custkey AS user_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'Untitled' END AS name, TIMESTAMP '2026-01-02 03:04:05' AS created_at FROM orders
""")
def projects_insert(t):
    k = F.col("o_orderkey")
    requests = t("orders").select(F.col("o_custkey").alias("user_id"), k.alias("request"), F.when(k % 2 == 0, F.col("o_orderstatus")).otherwise("").alias("name"), F.lit(None).cast("string").alias("data"), F.lit(None).cast("array<struct<name:string,url:string>>").alias("documents"))
    return store.inserted_projects(requests, "request", F.lit("2026-01-02 03:04:05").cast("timestamp")).select("id", "user_id", "name", "created_at")


@query("""
SELECT page_id, CASE WHEN page_id % 4 = 0 OR page_id % 7 = 0 THEN 400 WHEN page_id % 3 = 0 THEN 400 WHEN coalesce(strlen(html), 0) < 100 THEN 500 ELSE 200 END::INT AS status,
  CASE WHEN page_id % 4 = 0 OR page_id % 7 = 0 THEN 'Missing script file or role name' WHEN page_id % 3 = 0 THEN 'Invalid provider' WHEN coalesce(strlen(html), 0) < 100 THEN 'Generated PDF was empty' END AS error FROM pages
""")
def input_guards(t):
    k = F.col("page_id")
    rows = t("pages").select("page_id", F.when(k % 4 > 0, F.col("url")).alias("script"), F.when(k % 7 > 0, "role").otherwise("").alias("role"), F.when(k % 3 == 0, "fax").otherwise("link").alias("provider"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("size"))
    missing = js.truthy("script").isNull() | js.truthy("role").isNull()
    checked = store.guarded(rows, (missing, "Missing script file or role name", 400), (~F.col("provider").isin("link", "file"), "Invalid provider", 400), (F.col("size") < store.LEAST_PDF, "Generated PDF was empty", 500))
    return checked.select("page_id", "status", "error")


@query("""
SELECT doc_id, source || chr(10) || chr(10) || lang || CASE WHEN doc_id % 3 = 1 THEN chr(10) || chr(10) || '=== ' || source || '.pdf (PDF document attached above) ===' ELSE '' END AS prompt FROM documents
""")
def single_chunk_marker(t):
    prompt = pages.with_marker(F.array("source", "lang"), F.concat(F.col("source"), F.lit(".pdf")), F.col("doc_id") % 3)
    return t("documents").select("doc_id", prompt.alias("prompt"))


@query("""
SELECT c.conv_id AS project_id, c.turn AS role_ord, 'Sides_' || regexp_replace(c.role || ' ' || c.turn, '[^a-zA-Z0-9]', '_', 'g') || '.pdf' AS download, 'u' || s.turn AS url, 'attachment; filename="Self-Tape_' || c.role || '_' || c.turn || '.pdf"' AS header
FROM conversations c JOIN conversations s ON c.conv_id = s.conv_id AND c.turn = s.turn WHERE s.turn % 2 = 0
""")
def role_downloads(t):
    turns = t("conversations").select(F.col("conv_id").alias("project_id"), F.col("turn").alias("role_ord"), F.concat_ws(" ", "role", F.col("turn").cast("string")).alias("name"))
    sides = turns.where("role_ord % 2 = 0").select("project_id", "role_ord", F.concat(F.lit("u"), F.col("role_ord").cast("string")).alias("url"))
    header = turns.select("project_id", "role_ord", pages.attachment(pages.tape_name("name")).alias("header"))
    return pages.sides_downloads(turns, sides).join(header, ["project_id", "role_ord"])


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '240,240,0' ELSE '0,0,0' END AS fill, CASE WHEN p_size % 2 = 0 THEN 'black' ELSE 'white' END AS text_colour FROM part")
def bar_colours(t):
    known = F.col("p_size") % 2 == 0
    fill, text = render.bar_colours(known, F.when(known, F.array(F.lit(240), F.lit(240), F.lit(0))))
    return t("part").select("p_partkey", js.join(fill.cast("array<string>"), ",").alias("fill"), text.alias("text_colour"))


@query("""
SELECT p_partkey, to_json(p_name || '"' || p_brand || chr(92)) AS quoted, left(p_type, p_size % 9) AS short, array_to_string(['a', 'b', 'c', 'd'][1:p_size % 6], ',') AS shown FROM part
""")
def quoted_and_cut(t):
    n = F.col("p_size") % 9
    short = F.get(F.array(*(js.truncated("p_type", i) for i in range(9))), n.cast("int"))
    return t("part").select("p_partkey", js.json_string(F.concat(F.col("p_name"), F.lit('"'), F.col("p_brand"), F.lit("\\"))).alias("quoted"), short.alias("short"), js.join(js.prefix(F.array(*map(F.lit, "abcd")), (F.col("p_size") % 6).cast("int")), ",").alias("shown"))


@query("""
SELECT doc_id, doc_id % 3 < 2 AS some, CASE doc_id % 3 WHEN 0 THEN source || '.PDF' WHEN 1 THEN 'b.pdf' END AS first FROM documents
""")
def first_pdf(t):
    k = F.col("doc_id")
    names = F.array(F.lit("a.txt"), F.when(k % 3 == 0, F.concat("source", F.lit(".PDF"))).otherwise("a.doc"), F.when(k % 3 < 2, "b.pdf").otherwise("pdf"))
    return t("documents").select("doc_id", files.any_pdf(names).alias("some"), files.first_pdf(names).alias("first"))


@query("SELECT page_id || '/logo.' || CASE WHEN page_id % 2 = 0 THEN 'png' ELSE 'html' END AS path FROM pages WHERE page_id % 3 > 0")
def logo_objects(t):
    k = F.col("page_id")
    objects = t("pages").select(k, files.logo_path(k.cast("string"), F.when(k % 2 == 0, "a.png").otherwise("x.html")).alias("path"))
    return store.remove_objects(objects, objects.where("page_id % 3 = 0")).select("path")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE '{}' END AS raw FROM documents")
def recorded_answers(t):
    docs = t("documents").select("doc_id", "source")
    answers = extract.extract(docs.where("doc_id % 2 = 0"), lambda frames: (f.rename(columns={"source": "raw"}) for f in frames), "doc_id long, raw string")
    return extract.replay(docs.select("doc_id"), answers, ["doc_id"]).select("doc_id", "raw")


@query(f"""
WITH RECURSIVE turns AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations),
convs AS (SELECT conv_id, max(nth) AS n FROM turns GROUP BY conv_id),
{_wrap_sql("said", "SELECT conv_id * 1000 + nth AS id, text FROM turns", 180)}, {_wrap_sql("noted", "SELECT conv_id * 1000 + nth AS id, nth || '. ' || text AS text FROM turns WHERE conv_id % 5 > 0", 176)},
blocks AS (
  SELECT conv_id, 1000 AS ord, 'bar' AS kind, 'JOB INFORMATION' AS text, 17 AS x, 8 AS height, 9999 AS before, 9999 AS after FROM convs
  UNION ALL SELECT conv_id, 1001, 'fact', 'Project:', 17, 0, 9999, 9999 FROM convs
  UNION ALL SELECT conv_id, 1002, 'value', 'p' || conv_id, 55, 5, 9999, 9999 FROM convs
  UNION ALL SELECT conv_id, 1003, 'fact', 'Brand:', 17, 0, 9999, 9999 FROM convs WHERE conv_id % 2 = 0
  UNION ALL SELECT conv_id, 1004, 'value', 'b' || conv_id, 55, 5, 9999, 9999 FROM convs WHERE conv_id % 2 = 0
  UNION ALL SELECT conv_id, 1005, 'gap', '', 15, 5, 9999, 9999 FROM convs
  UNION ALL SELECT conv_id, 1006, 'bar', 'Step 1: Online Talent Form', 17, 10, 9999, 9999 FROM convs
  UNION ALL SELECT conv_id, 1007, 'text', 'Please complete the Online Talent Form. Submissions cannot be accepted without a completed form.', 15, 8, 9999, 9999 FROM convs
  UNION ALL SELECT conv_id, 1008, 'bar', 'Step 2: Record Audition Videos', 17, 10, 9999, 9999 FROM convs
  UNION ALL SELECT conv_id, 2000 + 2 * nth, 'label', 'VIDEO ' || nth || ' (LABEL IT ''' || role || ''')', 15, 5, 9999, 9999 FROM turns
  UNION ALL SELECT conv_id, 2001 + 2 * nth, 'video', lines, 15, said.n * 4 + 4, 9999, 270 FROM turns JOIN said ON id = conv_id * 1000 + nth
  UNION ALL SELECT conv_id, 8000, 'bar', 'Step 3: Photos', 17, 10, 9999, 9999 FROM convs WHERE conv_id % 3 > 0
  UNION ALL SELECT conv_id, 8001, 'photo', '1. head', 17, 5, 9999, 9999 FROM convs WHERE conv_id % 3 > 0
  UNION ALL SELECT conv_id, 8002, 'photo', '2. side', 17, 5, 9999, 9999 FROM convs WHERE conv_id % 3 > 0
  UNION ALL SELECT conv_id, 8003, 'gap', '', 15, 3, 9999, 9999 FROM convs WHERE conv_id % 3 > 0
  UNION ALL SELECT conv_id, 9000, 'bar', 'Filming Notes', 17, 10, 240, 9999 FROM convs WHERE conv_id % 5 > 0
  UNION ALL SELECT conv_id, 9000 + nth, 'note', lines, 17, noted.n * 4 + 2, 9999, 9999 FROM turns JOIN noted ON id = conv_id * 1000 + nth),
listed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY ord) AS nth FROM blocks),
placed AS (SELECT conv_id, 0::BIGINT AS nth, '' AS kind, '' AS text, 0 AS x, 0 AS y, 1 AS page, CASE WHEN conv_id % 2 = 0 THEN 30 ELSE 28 END AS next_y, 1 AS next_page FROM convs
  UNION ALL SELECT conv_id, nth, kind, text, x, y, page, CASE WHEN y + height > after THEN 15 ELSE y + height END, CASE WHEN y + height > after THEN page + 1 ELSE page END
  FROM (SELECT b.conv_id, b.nth, b.kind, b.text, b.x, b.height, b.after, CASE WHEN p.next_y > b.before THEN 15 ELSE p.next_y END AS y, CASE WHEN p.next_y > b.before THEN p.next_page + 1 ELSE p.next_page END AS page FROM placed p JOIN listed b ON b.conv_id = p.conv_id AND b.nth = p.nth + 1)),
ends AS (SELECT conv_id, max(next_page) AS page FROM placed GROUP BY conv_id),
whole AS (
  SELECT conv_id, -3 AS nth, 'logo' AS kind, '' AS text, 15 AS x, 2 AS y, 1 AS page FROM convs WHERE conv_id % 4 = 0
  UNION ALL SELECT conv_id, -2, 'company', 'House', CASE WHEN conv_id % 4 = 0 THEN 35 ELSE 15 END, 13, 1 FROM convs
  UNION ALL SELECT conv_id, -1, 'header', 'head', 15, 24, 1 FROM convs WHERE conv_id % 2 = 0
  UNION ALL SELECT conv_id, nth, kind, text, x, y, page FROM placed WHERE nth > 0 AND kind <> 'gap'
  UNION ALL SELECT conv_id, 99998, 'footer', CASE WHEN conv_id % 3 = 0 THEN 'a@b.example' ELSE 'Made here' END, 15, 286, page FROM ends
  UNION ALL SELECT conv_id, 99999, 'footer', CASE WHEN conv_id % 7 = 0 THEN 'own' ELSE 'Made here' END, 15, 290, page FROM ends WHERE conv_id % 7 = 0 OR conv_id % 3 = 0)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY nth))::INT AS nth, kind, text, x::INT AS x, y::INT AS y, page::INT AS page FROM whole
""")
def sheet_layout(t):
    k = F.col("conv_id")
    turns = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("label"), F.col("text").alias("description")))).alias("videos"))
    info = [("Project:", F.concat(F.lit("p"), k.cast("string"))), ("Brand:", F.when(k % 2 == 0, F.concat(F.lit("b"), k.cast("string"))).otherwise("")), ("Location:", F.lit(None).cast("string"))]
    photos = F.when(k % 3 > 0, F.array(F.lit("head"), F.lit("side")))
    notes = F.when(k % 5 > 0, F.transform("videos", lambda v: v["description"]))
    footers = render.footer(F.lit("House"), [F.when(k % 3 == 0, "a@b.example")], F.when(k % 7 == 0, "own"), "House", "Made here")
    sheet = render.sheet_pages(F.lit("House"), F.when(k % 2 == 0, "head").otherwise(""), k % 4 == 0, render.sheet_blocks(info, F.col("videos"), photos, notes), footers)
    rows = turns.select("conv_id", F.posexplode(sheet).alias("pos", "at"))
    return rows.select("conv_id", (F.col("pos") + 1).alias("nth"), "at.kind", "at.text", "at.x", "at.y", "at.page")


@query("""
SELECT c_custkey, concat_ws(chr(10), nullif(c_name, ''), CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, CASE WHEN c_custkey % 3 > 0 THEN '2026-01-02' END, 'C' || c_nationkey) AS block FROM customer
""")
def project_block(t):
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    given = {"name": F.col("c_name"), "brand": F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise(""), "deadline": F.when(k % 3 > 0, "2026-01-02"), "castingDirector": F.concat(F.lit("C"), F.col("c_nationkey").cast("string"))}
    projects = t("customer").select("c_custkey", F.struct(*(given.get(f, none).alias(f) for f in render.PROJECT_FIELDS)).alias("project"))
    return projects.select("c_custkey", render.project_block(F.col("project")).alias("block"))


# --- requests, policies, responses and the contract ------------------------------------------------------


@query("SELECT * FROM (" + ORACLE_SQL["project_list"] + ") WHERE user_id = 7")
def user_projects(t):
    k = F.col("o_orderkey")
    rows = t("orders").select(F.col("o_custkey").alias("user_id"), k.alias("id"), F.col("o_orderstatus").alias("name"), F.when(k % 4 > 0, F.sequence(F.lit(1).cast("long"), k % 4)).alias("roles"), F.when(k % 10 > 0, F.col("o_orderdate")).alias("created_at"))
    return store.project_list(store.owned(rows, 7))


@query("""
SELECT n_regionkey AS request, coalesce(string_agg('=== ' || n_name || ' ===' || chr(10) || 'nation ' || n_nationkey || chr(65533), chr(10) || chr(10) ORDER BY n_nationkey DESC) FILTER (n_nationkey % 5 > 0), '') AS text FROM nation GROUP BY n_regionkey
""")
def request_texts(t):
    k = F.col("n_nationkey")
    content = F.concat(F.concat(F.lit("nation "), k.cast("string")).cast("binary"), F.unhex(F.lit("FF")))
    uploads = t("nation").select(F.col("n_regionkey").alias("request"), (-k).alias("file_ord"), F.col("n_name").alias("name"), F.when(k % 5 == 0, "application/pdf").alias("mime"), content.alias("content"))
    return files.text_parts_by_request(uploads)


@query("""
SELECT page_id AS path, CASE WHEN page_id % 6 = 0 THEN 'third' WHEN page_id % 3 = 0 THEN 'second' ELSE url END AS content FROM pages
""")
def last_upload(t):
    held = t("pages").select(F.col("page_id").alias("path"), F.col("url").alias("content"))
    again = held.where("path % 3 = 0").select("path", F.lit("second").alias("content"), F.lit(2).alias("at"))
    uploads = again.union(held.where("path % 3 = 0").select("path", "content", F.lit(1))).union(held.where("path % 6 = 0").select("path", F.lit("third"), F.lit(3)))
    return store.put_objects(held, uploads, "at")


@query("""
SELECT c_custkey, own AS settings_select, own AS settings_insert, own AS settings_update, false AS settings_delete, logos AS logos_select, logos AND own AS logos_insert, logos AND own AS logos_update, logos AND own AS logos_delete FROM (SELECT c_custkey, c_nationkey = c_custkey % 25 AS own, c_custkey % 3 > 0 AS logos FROM customer)
""")
def policy_commands(t):
    k = F.col("c_custkey")
    rows = t("customer").select(k, F.col("c_nationkey").cast("long").alias("user_id"), F.when(k % 3 > 0, "logos").otherwise("papers").alias("bucket"), F.concat(F.col("c_nationkey").cast("string"), F.lit("/logo.png")).alias("path"), (k % 25).alias("user"))
    decide = lambda of, command: (policies.accepts if command == "insert" else policies.sees)(of, command, F.col("user"))
    return rows.select("c_custkey", *(decide(of, command).alias(f"{name}_{command}") for name, of in (("settings", policies.SETTINGS), ("logos", policies.LOGOS)) for command in ("select", "insert", "update", "delete")))


@query("""
SELECT c_custkey, CASE WHEN c_nationkey = 7 AND c_acctbal > 0 THEN 'new' ELSE c_mktsegment END AS company_name FROM customer
""")
def policy_update(t):
    held = t("customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("user_id"), F.col("c_mktsegment").alias("company_name"), "c_acctbal")
    changed = policies.update(held, {"company_name": F.lit("new")}, F.col("c_acctbal") > 0, policies.SETTINGS, F.lit(7))
    return changed.select("c_custkey", "company_name")


@query("""
SELECT doc_id, CASE g % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 1 END::INT AS attempt,
  CASE WHEN g % 5 IN (0, 3) THEN 'old ' || g WHEN g % 5 = 2 OR g % 3 = 1 THEN NULL WHEN g % 3 = 2 THEN CASE WHEN doc_id % 2 = 0 THEN '' ELSE '{}' END ELSE 'answer ' || g END AS raw,
  CASE WHEN g % 5 = 2 THEN 'ValueError: full' WHEN g % 5 IN (1, 4) AND g % 3 = 1 THEN 'ValueError: busy' END AS error
FROM (SELECT doc_id, doc_id // 2 AS g FROM documents)
""")
def resumed_answers(t):
    """Two documents share each request; some were answered before, failed once, or failed as often as is tried."""
    g = F.col("g")
    chunks = t("documents").select("doc_id", F.floor(F.col("doc_id") / 2).alias("g")).withColumn("key", extract.request_key(g))
    old = F.array(F.struct(F.lit("text").alias("type"), F.concat(F.lit("old "), g.cast("string")).alias("text")))
    last = F.element_at(F.array(*map(F.lit, (1, 1, 3, 2, 0))), (g % 5 + 1).cast("int"))
    tried = chunks.select("key", "g").distinct().where(g % 5 < 4).select("key", "g", last.alias("last"), F.explode(F.sequence(F.lit(1), last)).alias("attempt"))
    answered = (g % 5).isin(0, 3) & (F.col("attempt") == F.col("last"))
    held = tried.select("key", "attempt", F.when(answered, old).alias("blocks"), F.when(~answered, "ValueError: full").alias("error"))

    def ask(request):
        if request["g"] % 3 == 1:
            raise ValueError("busy")
        return [{"type": "tool"}] if request["g"] % 3 == 2 else [{"type": "text", "text": f"answer {request['g']}"}]

    attempts = held.unionByName(extract.attempted(extract.due(chunks.select("key", "g"), held), ask))
    found = chunks.join(extract.latest(attempts), "key", "left")
    return found.select("doc_id", "attempt", extract.answer_text("blocks", F.col("doc_id") % 2 == 0).alias("raw"), "error")


@query(f"""
SELECT p_partkey, '{{"provider":"jotform","title":' || to_json(p_name) || ',"importJson":' || form || ',"formattedQuestions":' || lines || '}}' AS form_response,
  '{{"provider":"google","url":' || to_json('https://forms.example.com/new?title=' || replace(p_name, ' ', '%20')) || ',"title":' || to_json(p_name) || ',"formattedQuestions":' || lines || '}}' AS link_response
FROM part JOIN ({ORACLE_SQL["form_definition"]}) USING (p_partkey) JOIN (SELECT p_partkey, to_json(string_split(form, chr(10))) AS lines FROM ({ORACLE_SQL["question_text"]})) USING (p_partkey)
""")
def form_responses(t):
    rows = _questions(t("part"))
    return rows.select("p_partkey", render.form_response(F.col("p_name"), F.col("questions")).alias("form_response"), render.link_response("https://forms.example.com/new?title=", F.col("p_name"), F.col("questions")).alias("link_response"))


@query("""
WITH k AS (SELECT p_partkey, p_partkey % 11 = 0 AS no_form FROM part),
n AS (SELECT p_partkey, unnest(['project_type', 'deadline', 'description', 'gender', 'speaking', 'page_numbers', 'videos', 'question_type', 'standard_questions', 'empty_sections']) AS rule,
  unnest([CASE WHEN p_partkey % 4 = 2 THEN 1 ELSE 0 END, CASE WHEN p_partkey // 4 % 4 IN (1, 2) THEN 1 ELSE 0 END, CASE WHEN p_partkey % 5 = 3 THEN 0 ELSE 1 END, CASE WHEN p_partkey % 3 = 1 THEN 1 ELSE 0 END, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END, CASE WHEN p_partkey % 7 IN (0, 6) THEN 1 ELSE 0 END,
    CASE WHEN p_partkey % 3 < 2 THEN 1 ELSE 0 END, CASE WHEN no_form THEN 0 ELSE 1 END, CASE WHEN no_form THEN 0 WHEN p_partkey % 4 = 0 THEN 9 - least(p_partkey % 10, 9) WHEN p_partkey % 4 = 1 THEN 4 ELSE 0 END, CASE WHEN no_form THEN 1 ELSE 0 END]) AS n FROM k)
SELECT p_partkey, rule, n::INT AS n FROM n
""")
def contract_rules(t):
    k, text = F.col("p_partkey"), lambda x: F.lit(x) if isinstance(x, str) else x.cast("string")
    questions = F.array(*(F.lit(f'{{"label":"{label}","type":"{kind}","required":{str(required).lower()}}}') for label, kind, required in contract.COMMERCIAL_QUESTIONS))
    asked = F.array_join(F.concat(F.slice(questions, F.lit(1), (k % 10).cast("int")), F.array(F.lit('{"label":"Eyes?","type":"select"}'))), ",")
    forms = F.when(k % 11 == 0, "[]").otherwise(F.concat(F.lit('[{"roleName":"A","questions":['), asked, F.lit("]}]")))
    videos = F.array_join(F.array_repeat(F.lit('{"label":"SLATE"}'), (k % 3).cast("int")), ",")
    parts = ('{"project":{"type":"', _case(k, "commercial", "film", "opera", "theatre"), '","deadline":"', _case(F.floor(k / 4), "2026-02-28", "2026-02-30", "soon", ""), '"},"roles":[{"name":"A","description":"', F.repeat(F.lit("One two. "), (k % 5).cast("int")), '","gender":', _case(k, '"Male"', '"male"', "null"), ',"speaking":', _case(k, "null", "true"),
             ',"pageNumbers":[', k % 7, ',3]}],"selfTapeInstructions":[{"roleName":"A","videos":[', videos, ']}],"formQuestions":', forms, "}")
    results = t("part").select("p_partkey", F.concat(*map(text, parts)).alias("raw")).select("p_partkey", repair.typed(F.parse_json("raw")).alias("result"), F.lit(1).alias("first_page"), F.lit(5).alias("last_page"))
    return contract.violations(results, ["p_partkey"])


@query("""
SELECT conv_id AS project_id, count(*) AS total, count(*) FILTER (role = 'assistant') AS done, count(*) FILTER (turn % 3 = 0) AS ready, count(*) FILTER (role = 'assistant') || '/' || count(*) || ' done' AS done_label, CASE WHEN count(*) FILTER (turn % 3 = 0) > 0 THEN 'Download All (' || count(*) FILTER (turn % 3 = 0) || ')' END AS download_label FROM conversations WHERE conv_id % 4 > 0 OR turn % 3 > 0 GROUP BY conv_id
""")
def role_progress(t):
    turns = t("conversations").select(F.col("conv_id").alias("project_id"), F.col("turn").alias("role_ord"), (F.col("role") == "assistant").alias("done"))
    sides = turns.where("role_ord % 3 = 0").select("project_id", "role_ord")
    return store.progress(turns.where("project_id % 4 > 0 or role_ord % 3 > 0"), sides.union(sides))


@query("""
SELECT conv_id AS project_id, turn AS role_ord, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS nth FROM conversations WHERE turn % 3 > 0
""")
def sides_to_make(t):
    turns = t("conversations").select(F.col("conv_id").alias("project_id"), F.col("turn").alias("role_ord"))
    return store.sides_to_make(turns, turns.where("role_ord % 3 = 0"))

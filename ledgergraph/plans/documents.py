"""Queries on documents: tables and files (A), classification (J, C11, H7), coercion and defaults (B6-B9), first-k lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgergraph.catalog import doctypes, frames, kinds
from ledgergraph.functions.ordering import first_n
from ledgergraph.operators import classify as j
from ledgergraph.operators import mentions as m
from ledgergraph.operators import status as s
from ledgergraph.plans import sql
from ledgergraph.plans.graph import EDGES_JSON, GRAPH
from ledgergraph.plans.registry import query
from ledgergraph.plans.text import MENTIONS, _mentions
from ledgergraph.session import scratch_folder
from ledgergraph.sources import bindings as b
from ledgergraph.sources import documents as d
from ledgergraph.sources import files as f
from ledgergraph.sources import store
from ledgergraph.sources.tables import spread, table

LIBRARY = """WITH library AS (SELECT doc_id AS id, substring(string_split(text, chr(10))[1], 1, 60) AS title, text AS content,
  source || '/' || doc_id || '.txt' AS file_path, 'txt' AS file_type, CAST(NULL AS VARCHAR) AS description,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS INTEGER)) AS created_at FROM documents)
"""
TEXT, SQLT = "yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"


def _library(spark, sf):
    made = "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(doc_id AS INT), 0)"
    return table(spark, sf, "documents").selectExpr(
        "doc_id AS id", "substring(split(text, '\\n', 2)[0], 1, 60) AS title", "text AS content",
        "concat(source, '/', doc_id, '.txt') AS file_path", "'txt' AS file_type", "CAST(NULL AS STRING) AS description",
        f"{made} AS created_at", f"{made} AS updated_at")


@query(LIBRARY + "SELECT id, title FROM library WHERE title ILIKE '%the%' ORDER BY id LIMIT 100 OFFSET 5")
def a1_title_search(spark, sf):
    return d.search(_library(spark, sf).select("id", "title"), "the", skip=5, limit=100)


@query(LIBRARY + "SELECT id, title FROM library WHERE id IN (SELECT doc_id FROM labels)")
def a2_lookup(spark, sf):
    keys = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return d.lookup(_library(spark, sf), keys).select("id", "title")


@query(LIBRARY + f"""SELECT id, title, strftime(created_at, '{SQLT}') AS created_at, strftime(created_at, '{SQLT}') AS updated_at FROM library
UNION ALL SELECT page_id + (SELECT max(id) + 1 FROM library), url, '2024-02-01 00:00:00', '2024-02-01 00:00:00' FROM pages""")
def a3_create(spark, sf):
    """The library as stored, with new documents appended to it and read back; pages get the ids after the last one."""
    folder = scratch_folder(spark, "library")
    d.append(_library(spark, sf), folder)
    next_id = (d.stored(spark, folder).agg(F.max("id")).first()[0] or 0) + 1
    new = table(spark, sf, "pages").select((F.col("page_id") + next_id).alias("id"), F.col("url").alias("title"))
    d.append(d.create(new, "2024-02-01 00:00:00"), folder)
    return d.stored(spark, folder).select("id", "title", F.date_format("created_at", TEXT).alias("created_at"), F.date_format("updated_at", TEXT).alias("updated_at"))


@query(LIBRARY + f"""SELECT id, CASE WHEN toxic = 1 THEN NULL ELSE title END AS title,
  CASE WHEN doc_id IS NOT NULL THEN 'quality ' || quality END AS description,
  strftime(CASE WHEN doc_id IS NOT NULL THEN TIMESTAMP '2024-03-01' ELSE created_at END, '{SQLT}') AS updated_at
FROM library LEFT JOIN labels ON doc_id = id""")
def a4_patch(spark, sf):
    patches = table(spark, sf, "labels").selectExpr(
        "doc_id AS id", "CASE WHEN toxic = 1 THEN map('description', concat('quality ', quality), 'title', NULL) "
                        "ELSE map('description', concat('quality ', quality)) END AS patch")
    out = d.patch(_library(spark, sf), patches, ["title", "description"], "2024-03-01 00:00:00")
    return out.select("id", "title", "description", F.date_format("updated_at", TEXT).alias("updated_at"))


@query(LIBRARY + "SELECT id FROM library WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def a5_delete(spark, sf):
    gone = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return d.delete(_library(spark, sf), gone).select("id")


@query(LIBRARY + """SELECT count(*) AS total, max_by(id, created_at) AS latest_id, max_by(title, created_at) AS latest_title
FROM library""")
def a6_analytics(spark, sf):
    return d.analytics(_library(spark, sf))


@query("""SELECT name, lower(regexp_extract(name, '\\.([^./]+)$', 1)) AS suffix, CAST(strlen(html) AS BIGINT) AS length, md5(html) AS md5
FROM (SELECT *, string_split(url, '/')[-1] AS name FROM pages)""")
def a7_file_fingerprints(spark, sf):
    """The web pages as files: their addresses and bytes."""
    pages = table(spark, sf, "pages").select(F.col("url").alias("path"), F.octet_length("html").cast("long").alias("length"),
                                             F.col("html").cast("binary").alias("content"))
    return f.fingerprints(pages)


@query("""SELECT source || '.' || lang AS name, n_chars AS length, CASE WHEN lang NOT IN ('en', 'fr') THEN 'type'
  WHEN n_chars > 5000 THEN 'size' END AS reason, lang IN ('en', 'fr') AND n_chars <= 5000 AS accepted FROM documents""")
def a8_admission(spark, sf):
    files = table(spark, sf, "documents").select(F.concat_ws(".", "source", "lang").alias("name"), F.col("n_chars").alias("length"))
    return f.admit(files, ["en", "fr"], 5000)


@query("""SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '[ \\t\\r\\n\\f\\v]+'), lambda x: x <> '')) AS INTEGER) AS word_count,
  CAST(length(text) AS INTEGER) AS character_count, CAST(len(string_split(text, chr(10))) AS INTEGER) AS line_count FROM documents""")
def a9_text_statistics(spark, sf):
    return d.text_statistics(table(spark, sf, "documents"))


def _chunk_sql(cap: str) -> str:
    return f"""SELECT doc_id, 'Text Preview ' || (i + 1) AS field, md5(substring(text, i * 500 + 1, 500)) AS value_md5,
  1.0::DOUBLE AS confidence FROM (SELECT *, unnest(range(0, {cap})) AS i FROM documents)"""


def _chunks(spark, sf, most):
    return d.preview(table(spark, sf, "documents"), most=most).select(
        "doc_id", "field", F.md5(F.col("value").cast("binary")).alias("value_md5"), "confidence")


@query(_chunk_sql("least(3, CAST(ceil(length(text) / 500) AS BIGINT))"))
def a10_text_preview(spark, sf):
    return _chunks(spark, sf, 3)


@query(_chunk_sql("CAST(ceil(length(text) / 500) AS BIGINT)"))
def a10_text_chunks(spark, sf):
    """All chunks of the whole texts."""
    return _chunks(spark, sf, None)


@query("""SELECT "p_name" AS "Field", p_brand || ' "' || p_type || '"' AS "Value", CAST(p_size AS VARCHAR) AS "Confidence",
  'PART' AS "Entity Type" FROM part""")
def a11_csv_export(spark, sf):
    """Results written as CSV and read back, quotes and all."""
    rows = table(spark, sf, "part").select(
        F.col("p_name").alias("Field"), F.concat(F.col("p_brand"), F.lit(' "'), F.col("p_type"), F.lit('"')).alias("Value"),
        F.col("p_size").cast("string").alias("Confidence"), F.lit("PART").alias("Entity Type"))
    folder = scratch_folder(spark, "csv")
    d.export_csv(rows, folder)
    schema = "`Field` string, `Value` string, `Confidence` string, `Entity Type` string"
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(folder)


# The suppliers' document processed again without some suppliers and edges; edges of other documents to those go too.
REPROCESSED = GRAPH + """, v AS (SELECT * FROM vertices WHERE confidence >= 0.7::DOUBLE AND (source_document <> 'suppliers' OR id NOT LIKE 'S%1')),
e AS (SELECT * FROM edges WHERE source_document <> 'suppliers' OR type <> 'DEPENDS_ON')
SELECT source_document, type, count(*) AS edges FROM e WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)
GROUP BY ALL"""

STORED = GRAPH + """, v AS (SELECT * FROM vertices WHERE confidence >= 0.7::DOUBLE)
SELECT source_document, type, count(*) AS edges FROM edges WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)
GROUP BY ALL"""


def _stored_counts(spark, folder):
    _, e = store.load_graph(spark, folder)
    return e.groupBy("source_document", "type").agg(F.count("*").alias("edges"))


@query(STORED)
def a12_graph_store(spark, sf):
    """Trusted vertices and the edges between them, written and read back."""
    folder = scratch_folder(spark, "graph")
    store.save_graph(b.vertices(spark, sf).filter("confidence >= 0.7"), b.edges(spark, sf), folder)
    return _stored_counts(spark, folder)


@query(REPROCESSED)
def a13_reprocessing(spark, sf):
    """After storing everything and then the suppliers' document again, which now has fewer suppliers and edges."""
    folder = scratch_folder(spark, "graph")
    v, e = b.vertices(spark, sf).filter("confidence >= 0.7"), b.edges(spark, sf)
    store.save_graph(v, e, folder)
    again = "source_document = 'suppliers'"
    store.save_graph(v.filter(again).filter("id NOT LIKE 'S%1'"), e.filter(again).filter("type <> 'DEPENDS_ON'"), folder)
    return _stored_counts(spark, folder)


@query(EDGES_JSON)
def a14_flattened_properties(spark, sf):
    """Properties of all edges as JSON text."""
    return d.as_json_text(b.edges(spark, sf).select("id", "properties"), "properties")


RAW_TYPES = """raw AS (SELECT p_partkey AS id, CASE p_size % 7 WHEN 0 THEN 'financial_metric' WHEN 1 THEN 'ORGANIZATION' WHEN 2 THEN p_type
  WHEN 3 THEN lower(p_type) || '_grade_part' WHEN 4 THEN '' WHEN 5 THEN 'Financial_metric' END AS type FROM part)"""


@query(f"WITH {RAW_TYPES}, a AS (SELECT * FROM {sql.sql_values(kinds.entity_alias_rows(), 'a(alias, canonical)')})" + """
SELECT id, CASE WHEN coalesce(type, '') = '' THEN 'Unknown' ELSE coalesce(canonical, CASE WHEN contains(type, '_')
  THEN array_to_string(list_transform(string_split(type, '_'), lambda w: upper(w[1:1]) || lower(w[2:])), '')
  ELSE upper(type[1:1]) || lower(type[2:]) END) END AS entity_type FROM raw LEFT JOIN a ON alias = type""")
def b6_entity_types(spark, sf):
    raw = table(spark, sf, "part").selectExpr(
        "p_partkey AS id", "CASE p_size % 7 WHEN 0 THEN 'financial_metric' WHEN 1 THEN 'ORGANIZATION' WHEN 2 THEN p_type "
        "WHEN 3 THEN concat(lower(p_type), '_grade_part') WHEN 4 THEN '' WHEN 5 THEN 'Financial_metric' END AS type")
    return j.coerce_entity_type(raw, frames.entity_aliases(spark)).select("id", "entity_type")


@query(f"""SELECT o_orderkey AS id, CASE WHEN upper(raw) IN ({', '.join("'" + n + "'" for n in kinds.RELATION_TYPES + kinds.EXTRA_ACCEPTED_RELATIONS)})
  THEN upper(raw) ELSE 'TRANSACTION' END AS relation_type
FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'supplies_to' WHEN 'O' THEN 'INVESTS_IN' ELSE 'OWNS' END AS raw FROM orders)""")
def b7_relation_types(spark, sf):
    raw = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS id", "CASE o_orderstatus WHEN 'F' THEN 'supplies_to' WHEN 'O' THEN 'INVESTS_IN' ELSE 'OWNS' END AS rel_type")
    return j.coerce_relation_type(raw, frames.accepted_relations(spark)).select("id", "relation_type")


@query("""SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 AND c_mktsegment = 'BUILDING' THEN 'Unknown' WHEN c_acctbal < 0
  THEN c_mktsegment ELSE c_name END AS name FROM customer""")
def b8_defaults(spark, sf):
    rows = table(spark, sf, "customer").selectExpr(
        "c_custkey AS id", "CASE WHEN c_acctbal < 0 THEN '' ELSE c_name END AS name",
        "CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS text")
    return j.with_defaults(rows).select("id", "name")


@query("SELECT count(*) AS events FROM events WHERE ts >= TIMESTAMP '2024-01-10 06:00:00'")
def b9_open_time_range(spark, sf):
    """History from a time on; the filter reaches the file scan."""
    return s.history(table(spark, sf, "events"), start="2024-01-10 06:00:00").agg(F.count("*").alias("events"))


def _class_sql(source: str, text: str = "text") -> str:
    parts = []
    for i, (name, spec) in enumerate(doctypes.DOCUMENT_TYPES.items()):
        hits = [f"CAST(contains(low, {sql.text_literal(k)}) AS INTEGER)" for k in spec["keywords"]]
        hits += [f"2 * CAST(regexp_matches(low, {sql.text_literal(p)}) AS INTEGER)" for p in spec["patterns"]]
        parts.append(f"SELECT doc_id, {i} AS ord, '{name}' AS t, ({' + '.join(hits)}) / {len(hits)}.0::DOUBLE AS score FROM lowered")
    return f"""lowered AS (SELECT doc_id, lower({text}) AS low FROM {source}),
scored AS ({' UNION ALL '.join(parts)}),
classified AS (SELECT doc_id, CASE WHEN score > 0.1::DOUBLE THEN t ELSE 'unknown' END AS doc_type,
    CASE WHEN score > 0.1::DOUBLE THEN score ELSE 0 END AS score FROM scored
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) = 1)"""


@query(f"WITH {sql.STATEMENTS}, {_class_sql('statements')} SELECT doc_id, doc_type, round(score, 6) AS score FROM classified")
def j1_classified_statements(spark, sf):
    return j.classify(b.statements(spark, sf)).select("doc_id", "doc_type", F.round("score", 6).alias("score"))


@query(f"WITH {_class_sql('documents')} SELECT doc_id, doc_type, round(score, 6) AS score FROM classified")
def j1_classified_documents(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return j.classify(docs).select("doc_id", "doc_type", F.round("score", 6).alias("score"))


FIELDS = f"fields AS (SELECT * FROM {sql.sql_values(doctypes.field_rows(), 'f(doc_type, ordinal, name, key, required)')})"


@query(f"WITH {sql.STATEMENTS}, {_class_sql('statements')}, {FIELDS} " + """
SELECT doc_type, ordinal, name AS field, key, required, count(*) AS documents FROM classified JOIN fields USING (doc_type)
GROUP BY ALL""")
def j2_suggested_schema(spark, sf):
    c = j.with_schema(j.classify(b.statements(spark, sf)), frames.document_fields(spark))
    return c.groupBy("doc_type", "ordinal", "field", "key", "required").agg(F.count("*").alias("documents"))


LABEL_ROWS = [(t, label, i, key) for t, by in doctypes.LABEL_FIELDS.items() for label, ks in by.items() for i, key in enumerate(ks)]


@query(MENTIONS + f", {_class_sql('statements')}, {FIELDS}, "
       f"lf AS (SELECT * FROM {sql.sql_values(LABEL_ROWS, 'l(doc_type, label, pos, key)')})" + """,
m AS (SELECT n.*, c.doc_type, lower(n.text) AS low FROM mentions n JOIN classified c USING (doc_id)),
hits AS (
  SELECT m.doc_id, m."start", f.name, f.key, 1 AS tier, l.pos AS pos FROM m JOIN lf l ON l.doc_type = m.doc_type AND l.label = m.type
    JOIN fields f ON f.doc_type = m.doc_type AND f.key = l.key
  UNION ALL SELECT m.doc_id, m."start", f.name, f.key, 2, f.ordinal FROM m JOIN fields f ON f.doc_type = m.doc_type
    AND len(list_filter(string_split(lower(f.name), ' '), lambda w: contains(m.low, w))) > 0
  UNION ALL SELECT m.doc_id, m."start", f.name, f.key, 3, f.ordinal FROM m JOIN fields f ON f.doc_type = m.doc_type
    AND len(list_filter(string_split(lower(f.key), '_'), lambda w: contains(m.low, w))) > 0)
SELECT doc_id, CAST("start" AS BIGINT) AS start_at, name AS field, key FROM hits
QUALIFY row_number() OVER (PARTITION BY doc_id, "start" ORDER BY tier, pos) = 1""")
def c11_mentions_to_fields(spark, sf):
    """The schema field of every mention."""
    types = j.classify(b.statements(spark, sf)).select("doc_id", "doc_type")
    mapped = j.map_to_fields(_mentions(spark, sf).join(types, "doc_id"), frames.document_fields(spark))
    return mapped.select("doc_id", F.col("start").cast("long").alias("start_at"), "field", "key")


@query(MENTIONS + """, first AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start") AS position FROM mentions)
SELECT doc_id, CAST("start" AS BIGINT) AS start_at, CASE type WHEN 'FINANCIAL_METRIC' THEN 'Financial Metric'
  ELSE upper(type[1:1]) || lower(type[2:]) END AS field, lower(type) AS key FROM first WHERE position <= 10""")
def j4_simple_fields(spark, sf):
    """Mentions as plain fields, the first ten of each document."""
    return j.simple_fields(_mentions(spark, sf)).select("doc_id", F.col("start").cast("long").alias("start_at"), "field", "key")


REPLIES = """replies AS (SELECT doc_id, text, CAST(string_split(doc_id, '-')[1] AS BIGINT) % 6 AS k FROM statements)"""
REPLY_CASE = """CASE CAST(split(doc_id, '-')[0] AS BIGINT) % 6
  WHEN 0 THEN 'Sure! ```json {"document_type": "invoice", "confidence": 0.9, "reasoning": "terms",} ``` done'
  WHEN 1 THEN '{"document_type": "unknown", "confidence": 0.4}'
  WHEN 2 THEN 'Look: {"document_type": "custom", "custom_type_name": " ", "confidence": 0.95} {"confidence": 0}'
  WHEN 3 THEN 'I cannot tell.'
  WHEN 4 THEN concat('{"document_type": "supply_note", "confidence": "0.8", "details": {"topics": ["a", "b",]}, "suggested_fields": ',
    '[{"name": "Ship Date", "required": true}, {"name": "Day", "key": "date", "required": false},],}')
  ELSE '{"document_type": "contract", "confidence": }' END AS reply"""


def _replies(spark, sf, *more):
    """Model replies of six kinds, one per statement, with further columns of the statement."""
    return j.read_replies(b.statements(spark, sf).selectExpr("doc_id", *more, REPLY_CASE))


@query(f"WITH {sql.STATEMENTS}, {REPLIES}" + """
SELECT doc_id, k NOT IN (3, 5) AS valid, CASE k WHEN 0 THEN 'invoice' WHEN 2 THEN 'custom' WHEN 4 THEN 'supply_note' ELSE 'unknown' END
  AS document_type, CASE k WHEN 0 THEN 0.9 WHEN 1 THEN 0.4 WHEN 2 THEN 0.95 WHEN 4 THEN 0.8 ELSE 0 END::DOUBLE AS confidence
FROM replies""")
def j5_read_replies(spark, sf):
    r = _replies(spark, sf)
    bad = ~F.col("valid")
    return r.select("doc_id", "valid", F.when(bad, "unknown").otherwise(F.col("document_type")).alias("document_type"),
                    F.when(bad, 0.0).otherwise(F.col("confidence")).alias("confidence"))


@query(MENTIONS + f", {REPLIES}" + """, first AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start") AS position FROM mentions),
n AS (SELECT doc_id, type, count(*) AS n, min("start") AS first FROM first WHERE position <= 15 GROUP BY ALL),
l AS (SELECT doc_id, max_by(type, (n, -first)) AS label FROM n GROUP BY doc_id)
SELECT doc_id, CASE k WHEN 0 THEN 'invoice' WHEN 3 THEN 'unknown' WHEN 5 THEN 'unknown' ELSE 'custom' END AS doc_type,
  CASE k WHEN 1 THEN lower(label) WHEN 2 THEN lower(label) WHEN 4 THEN 'supply_note' END AS custom_type,
  CASE k WHEN 0 THEN 0.9 WHEN 1 THEN 0.7 WHEN 2 THEN 0.95 WHEN 4 THEN 0.8 ELSE 0 END::DOUBLE AS confidence
FROM replies LEFT JOIN l USING (doc_id)""")
def j6_settled_types(spark, sf):
    return j.settle(_replies(spark, sf, "text"), None, j.common_label(_mentions(spark, sf)))


@query(f"WITH {sql.STATEMENTS}, {_class_sql('statements')}" + f"""
SELECT t AS doc_type, count(doc_id) AS documents FROM {sql.sql_values([(t,) for t in doctypes.REPLY_TYPES], 'r(t)')}
LEFT JOIN classified ON doc_type = t GROUP BY t""")
def j7_document_types(spark, sf):
    """All document types with the number of documents of each."""
    n = j.classify(b.statements(spark, sf)).groupBy("doc_type").agg(F.count("*").alias("documents"))
    types = frames.local(spark, [(t,) for t in doctypes.REPLY_TYPES], "doc_type string")
    return F.broadcast(types).join(n, "doc_type", "left").fillna(0, ["documents"])


@query(f"WITH {sql.STATEMENTS}, {REPLIES}, "
       f"common AS (SELECT * FROM {sql.sql_values([(i, *x) for i, x in enumerate(doctypes.COMMON_FIELDS)], 'c(pos, name, key, required)')}), "
       """own AS (SELECT * FROM (VALUES (0, 'Ship Date', 'ship_date', TRUE), (1, 'Day', 'date', FALSE)) o(pos, name, key, required)),
every AS (SELECT doc_id, 0 AS part, pos, name, key, required FROM replies, own WHERE k = 4
  UNION ALL SELECT doc_id, 1, pos, name, key, required FROM replies, common),
kept AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY part, pos) = 1)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part, pos) - 1 AS INTEGER) AS ordinal, name, key, required FROM kept""")
def h7_dynamic_fields(spark, sf):
    return j.dynamic_fields(_replies(spark, sf))


@query("""SELECT doc_id, quality, toxic, position FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY doc_id DESC) AS position
  FROM labels) WHERE position <= 5""")
def g5_first_k(spark, sf):
    """The first k rows of each group, in two rounds."""
    return first_n(table(spark, sf, "labels"), ["quality"], ["-doc_id"], 5, F.col("doc_id")).select(
        "doc_id", "quality", "toxic", F.col("position").cast("long").alias("position"))

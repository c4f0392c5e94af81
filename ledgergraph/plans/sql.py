"""Pieces of checking SQL that several queries share, written for DuckDB."""

from __future__ import annotations

from ledgergraph.catalog import kinds, relations
from ledgergraph.catalog.frames import sql_literal, sql_values
from ledgergraph.functions.text import SENTENCE_BREAK
from ledgergraph.operators import mentions as m


def text_literal(value: str) -> str:
    return sql_literal(value)


EVENT_FACTS = """facts AS (
  SELECT event_id, CASE event_type WHEN 'view' THEN 'completeness' WHEN 'click' THEN 'consistency'
      WHEN 'purchase' THEN 'accuracy' WHEN 'signup' THEN 'timeliness' WHEN 'error' THEN 'validity' END AS metric_type,
    'E' || (user_id % 4) AS entity_type, ts, value / 500.0::DOUBLE AS value, 0.5::DOUBLE AS threshold,
    CAST(json_extract(props, '$.k') AS INTEGER) / 100.0::DOUBLE AS confidence_score
  FROM events)"""

STATUS = """status AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS document_id, ts,
    CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'processing'
      WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS status,
    CASE event_type WHEN 'view' THEN 'entity_extraction' WHEN 'click' THEN 'graph_storage' END AS stage,
    k / 100.0::DOUBLE AS progress, CAST(k AS BIGINT) AS entities_processed,
    CAST(k // 2 AS BIGINT) AS relationships_processed,
    CASE WHEN event_type = 'error' THEN 'k=' || (k % 5) END AS error_message
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events))"""

VERTICES = """vertices AS (
  SELECT 'C' || c_custkey AS id, 'Company' AS type, c_name AS name, TIMESTAMP '1992-01-01' AS created_at,
    0.5::DOUBLE + (c_custkey % 50) / 100.0::DOUBLE AS confidence, 'customers-' || c_mktsegment AS source_document
  FROM customer
  UNION ALL SELECT 'S' || s_suppkey, 'Company', s_name, TIMESTAMP '1992-01-01', 0.9::DOUBLE, 'suppliers' FROM supplier
  UNION ALL SELECT 'N' || n_nationkey, 'Location', n_name, TIMESTAMP '1992-01-01', 1.0::DOUBLE, 'geography' FROM nation
  UNION ALL SELECT 'R' || r_regionkey, 'Location', r_name, TIMESTAMP '1992-01-01', 1.0::DOUBLE, 'geography' FROM region
  UNION ALL SELECT 'P' || p_partkey, 'FinancialInstrument', p_name, TIMESTAMP '1992-01-01',
    0.6::DOUBLE + p_size / 200.0::DOUBLE, 'catalogue-' || p_brand FROM part
  UNION ALL SELECT 'O' || o_orderkey, 'Transaction', 'Order ' || o_orderkey, o_orderdate, 0.8::DOUBLE,
    'orders-' || year(o_orderdate) FROM orders
  UNION ALL SELECT 'M1', 'FinancialMetric', 'revenue', TIMESTAMP '1992-01-01', 1.0::DOUBLE, 'metrics'
  UNION ALL SELECT 'M2', 'FinancialMetric', 'orders', TIMESTAMP '1992-01-01', 1.0::DOUBLE, 'metrics'
)"""

# Vertex properties, one row per key that is there.
VPROPS = """vprops AS (
  SELECT * FROM (
  SELECT 'C' || c_custkey AS id, 'Company' AS type, unnest(['name','industry','ticker','revenue','employees',
      'compliance_status','risk_assessment']) AS key,
    unnest([c_name, c_mktsegment, substring(c_mktsegment, 1, 5), printf('%.2f', c_acctbal), CAST(c_nationkey AS VARCHAR),
      CASE WHEN c_acctbal > 5000 THEN '{"Risk Management":"ok","Best Execution":"ok","Client Reporting":"open"}' END,
      CASE WHEN c_acctbal > 5000 THEN '{"market_risk":"low","operational_risk":"high"}' END]) AS value
  FROM customer
  UNION ALL SELECT 'S' || s_suppkey, 'Company', unnest(['name','ticker','revenue','employees']),
    unnest([s_name, s_name, printf('%.2f', s_acctbal), 'n/a']) FROM supplier
  UNION ALL SELECT 'N' || n_nationkey, 'Location', 'name', n_name FROM nation
  UNION ALL SELECT 'R' || r_regionkey, 'Location', 'name', r_name FROM region
  UNION ALL SELECT 'P' || p_partkey, 'FinancialInstrument', unnest(['name','type','issuer','face_value','cusip','documents']),
    unnest([p_name, p_type, p_brand, printf('%.2f', p_retailprice), p_brand,
      CASE p_size % 3 WHEN 0 THEN '["prospectus","offering_memorandum"]' WHEN 1 THEN '["prospectus"]' END]) FROM part
  UNION ALL SELECT 'O' || o_orderkey, 'Transaction', unnest(['amount','date','type','transaction_date','settlement_date']),
    unnest([printf('%.2f', o_totalprice), strftime(o_orderdate, '%Y-%m-%d'), o_orderstatus,
      strftime(o_orderdate, '%Y-%m-%d'),
      strftime(CAST(o_orderdate AS DATE) + CASE WHEN o_orderpriority = '1-URGENT' THEN -1 ELSE 7 END, '%Y-%m-%d')])
  FROM orders
  UNION ALL SELECT 'M1', 'FinancialMetric', 'name', 'revenue'
  UNION ALL SELECT 'M2', 'FinancialMetric', 'name', 'orders') WHERE value IS NOT NULL
)"""

PAIRS_AND_MONTHS = """supply AS (
  SELECT l_suppkey, o_custkey, count(*) AS lines, sum(l_quantity) AS quantity, avg(l_discount) AS discount,
    min(l_shipdate) AS first_ship
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
issued AS (
  SELECT l_suppkey, l_partkey, min(l_shipdate) AS first_ship, sum(l_quantity) AS size,
    avg(l_extendedprice / l_quantity) AS price
  FROM lineitem GROUP BY ALL),
months AS (
  SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice) AS revenue, count(*) AS orders
  FROM orders GROUP BY ALL)"""

EDGES = PAIRS_AND_MONTHS + """, edges AS (
  SELECT 'HEADQUARTERED_IN:C' || c_custkey || ':N' || c_nationkey AS id, 'HEADQUARTERED_IN' AS type,
    'C' || c_custkey AS src, 'N' || c_nationkey AS dst, 1.0::DOUBLE AS confidence,
    TIMESTAMP '1992-01-01' AS created_at, 'customers-' || c_mktsegment AS source_document FROM customer
  UNION ALL SELECT 'HEADQUARTERED_IN:S' || s_suppkey || ':N' || s_nationkey, 'HEADQUARTERED_IN', 'S' || s_suppkey,
    'N' || s_nationkey, 1.0::DOUBLE, TIMESTAMP '1992-01-01', 'suppliers' FROM supplier
  UNION ALL SELECT 'LOCATED_IN:N' || n_nationkey || ':R' || n_regionkey, 'LOCATED_IN', 'N' || n_nationkey,
    'R' || n_regionkey, 1.0::DOUBLE, TIMESTAMP '1992-01-01', 'geography' FROM nation
  UNION ALL SELECT 'SUPPLIES_TO:S' || l_suppkey || ':C' || o_custkey, 'SUPPLIES_TO', 'S' || l_suppkey,
    'C' || o_custkey, round(1.0::DOUBLE - discount, 6), first_ship, 'suppliers' FROM supply
  UNION ALL SELECT 'ISSUES:S' || l_suppkey || ':P' || l_partkey, 'ISSUES', 'S' || l_suppkey, 'P' || l_partkey,
    0.95::DOUBLE, first_ship, 'suppliers' FROM issued
  UNION ALL SELECT 'TRANSACTION:C' || o_custkey || ':O' || o_orderkey, 'TRANSACTION', 'C' || o_custkey,
    'O' || o_orderkey, 0.85::DOUBLE, o_orderdate, 'orders-' || year(o_orderdate) FROM orders
  UNION ALL SELECT 'HAS_METRIC:C' || o_custkey || ':M1:' || month, 'HAS_METRIC', 'C' || o_custkey, 'M1', 0.9::DOUBLE,
    CAST(month || '-01' AS TIMESTAMP), 'orders' FROM months
  UNION ALL SELECT 'HAS_METRIC:C' || o_custkey || ':M2:' || month, 'HAS_METRIC', 'C' || o_custkey, 'M2', 0.9::DOUBLE,
    CAST(month || '-01' AS TIMESTAMP), 'orders' FROM months
  UNION ALL SELECT 'DEPENDS_ON:C' || o_custkey || ':S' || l_suppkey, 'DEPENDS_ON', 'C' || o_custkey, 'S' || l_suppkey,
    0.7::DOUBLE, first_ship, 'suppliers' FROM supply
  UNION ALL SELECT 'EXPOSED_TO:C' || c_custkey || ':N' || c_nationkey, 'EXPOSED_TO', 'C' || c_custkey,
    'N' || c_nationkey, 0.75::DOUBLE, TIMESTAMP '1992-01-01', 'customers-' || c_mktsegment FROM customer
    WHERE c_acctbal < 0
)"""

# Edge properties, one row per key that is there (after EDGES).
EPROPS = """eprops AS (
  SELECT * FROM (
  SELECT 'SUPPLIES_TO:S' || l_suppkey || ':C' || o_custkey AS id, 'SUPPLIES_TO' AS type, unnest(['lines','quantity']) AS key,
    unnest([CAST(lines AS VARCHAR), printf('%.2f', quantity)]) AS value FROM supply
  UNION ALL SELECT 'ISSUES:S' || l_suppkey || ':P' || l_partkey, 'ISSUES', unnest(['issue_date','issue_price','issue_size']),
    unnest([strftime(first_ship, '%Y-%m-%d'), printf('%.2f', price + 1e-7), printf('%.2f', size)]) FROM issued
  UNION ALL SELECT 'TRANSACTION:C' || o_custkey || ':O' || o_orderkey, 'TRANSACTION', unnest(['transaction_date','amount']),
    unnest([strftime(o_orderdate, '%Y-%m-%d'), printf('%.2f', o_totalprice)]) FROM orders
  UNION ALL SELECT 'HAS_METRIC:C' || o_custkey || ':M1:' || month, 'HAS_METRIC', unnest(['type','timestamp','value']),
    unnest(['revenue', month, printf('%.2f', revenue)]) FROM months
  UNION ALL SELECT 'HAS_METRIC:C' || o_custkey || ':M2:' || month, 'HAS_METRIC', unnest(['type','timestamp','value']),
    unnest(['orders', month, printf('%.2f', CAST(orders AS DOUBLE))]) FROM months
  UNION ALL SELECT 'DEPENDS_ON:C' || o_custkey || ':S' || l_suppkey, 'DEPENDS_ON', 'severity',
    CASE WHEN lines >= 3 THEN 'high' WHEN lines = 2 THEN 'low' END FROM supply
  UNION ALL SELECT 'EXPOSED_TO:C' || c_custkey || ':N' || c_nationkey, 'EXPOSED_TO', 'severity',
    CASE WHEN c_acctbal < -500 THEN 'high' ELSE 'low' END FROM customer WHERE c_acctbal < 0
  ) WHERE value IS NOT NULL)"""

STATEMENTS = """statements AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || v AS doc_id, l_linenumber AS page,
    CASE (l_orderkey + l_linenumber) % 5
      WHEN 0 THEN s_name || ' supplies parts to ' || c_name || ' in ' || y || '.'
      WHEN 1 THEN c_name || ' bought a stake in ' || s_name || ' for $' || v || ' in ' || y || '.'
      WHEN 2 THEN s_name || ' did not invest, though ' || c_name || ' competes with ' || s_name || '.'
      WHEN 3 THEN c_name || ' reported revenue of $' || v || ' million during fiscal year ' || y || '.'
      ELSE c_name || ' acquired a division of ' || s_name || ', revenue growth of 12% yearly.' END
    || chr(10) || 'Invoice #' || l_orderkey || ' to the retail market, payment terms: amount due $' || v
    || ' from cash.' AS text
  FROM (SELECT *, printf('%.2f', l_extendedprice) AS v, CAST(year(l_shipdate) AS VARCHAR) AS y FROM lineitem)
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey)"""


def pieces(source: str, keys: str, pattern: str, name: str, text: str = "text") -> str:
    """CTE ``name``: keys, pos, gap_start, gap, hit of every piece of every text of ``source``."""
    rx = text_literal(pattern)
    return f"""{name}_cut AS (
  SELECT {keys}, string_split_regex({text}, {rx}) AS gaps, regexp_extract_all({text}, {rx}) AS hits FROM {source}),
{name} AS (
  SELECT {keys}, pos, gap, hit,
    CAST(sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY {keys} ORDER BY pos) AS BIGINT)
      - length(gap) - coalesce(length(hit), 0) AS gap_start
  FROM (SELECT {keys}, unnest(range(0, len(gaps))) AS pos, unnest(gaps) AS gap,
          unnest(hits || CASE WHEN len(gaps) > len(hits) THEN [NULL] ELSE [] END) AS hit FROM {name}_cut))"""


def sentences(source: str, keys: str, name: str = "sents") -> str:
    return (pieces(source, keys, SENTENCE_BREAK, name + "_p") + f""",
{name} AS (SELECT {keys}, pos AS sent_id, gap_start AS sent_start, gap_start + length(gap) AS sent_end, gap AS sentence
  FROM {name}_p WHERE gap <> '')""")


def label_case(column: str) -> str:
    whens = " ".join(f"WHEN regexp_full_match({column}, {text_literal('(?i)' + p)}) THEN '{label}'"
                     for label, p in m.label_patterns(m.PLAIN_NUMBER))
    return f"CASE {whens} END"


CONFIDENCE = """least(1.0::DOUBLE, 0.7::DOUBLE + CASE WHEN type IN ('CURRENCY', 'PERCENTAGE') THEN 0.2::DOUBLE
    WHEN type IN ('COMPANY', 'PERSON') THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN regexp_matches(substring(text, 1, 1), '^\\p{Lu}') THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN length(text) > 3 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END)"""


def mentions(source: str, keys: str, text: str = "text", names: bool = True) -> str:
    """CTEs up to ``mentions`` over a text table: keys, sent_id, start, end, text, type, confidence, doc_text."""
    known = "WHERE type <> 'COMPANY' OR lower(text) IN (SELECT lower(c_name) FROM customer UNION " \
            "SELECT lower(s_name) FROM supplier)" if names else ""
    return (sentences(source, f"{keys}, {text}") + ", "
            + pieces("sents", f"{keys}, {text}, sent_id, sent_start", m.mention_pattern(m.PLAIN_NUMBER), "mp", "sentence") + f""",
labelled AS (
  SELECT {keys}, {text} AS doc_text, sent_id, sent_start + gap_start + length(gap) AS "start",
    sent_start + gap_start + length(gap) + length(hit) AS "end", hit AS text, {label_case('hit')} AS type
  FROM mp WHERE hit IS NOT NULL),
mentions AS (SELECT *, {CONFIDENCE} AS confidence FROM labelled {known})""")


def pairs(keys: str = "doc_id, page", window: int = 100) -> str:
    """CTE ``pairs`` after ``mentions``."""
    names = [k.strip() for k in keys.split(",")]
    same = " AND ".join(f"a.{k} = b.{k}" for k in names)
    cols = ", ".join(f"a.{k}" for k in names)
    return f"""narrow AS MATERIALIZED (
  SELECT {keys}, sent_id, "start", "end", text, type, confidence FROM mentions),
texts AS MATERIALIZED (SELECT DISTINCT {keys}, doc_text FROM mentions),
met AS MATERIALIZED (
  SELECT {cols}, a.sent_id, a."start" AS src_start, a.text AS src_text, a.type AS src_type,
    a.confidence AS src_confidence, b."start" AS dst_start, b.text AS dst_text, b.type AS dst_type,
    b.confidence AS dst_confidence, b."end" AS dst_end
  FROM narrow a JOIN narrow b ON {same} AND a.sent_id = b.sent_id AND a."start" < b."start"
    AND b."start" - a."start" <= {window}),
pairs AS (
  SELECT a.* EXCLUDE (dst_end),
    substring(b.doc_text, CAST(a.src_start + 1 AS BIGINT), CAST(a.dst_end - a.src_start AS BIGINT)) AS context
  FROM met a JOIN texts b ON {same})"""


def any_match(column: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {text_literal('(?i)' + p)})" for p in patterns) + ")"


def relations_cte() -> str:
    """CTE ``rels`` after ``pairs``: every pair with its best relation type and confidence."""
    verbs = [(r, i, v) for i, (r, vs, _) in enumerate(relations.RELATION_PATTERNS) for v in vs]
    preps = [(r, p) for r, _, ps in relations.RELATION_PATTERNS for p in ps]
    return f"""pats AS (SELECT * FROM {sql_values(relations.pattern_rows(), 't(rel_type, ord, verb, prep)')}),
verbs AS (SELECT * FROM {sql_values(verbs, 't(rel_type, ord, verb)')}),
preps AS (SELECT * FROM {sql_values(preps, 't(rel_type, prep)')}),
compat AS (SELECT * FROM {sql_values(relations.compatibility_rows(), 't(src_type, rel_type, dst_type)')}),
contexts AS (SELECT context, lower(context) AS low, {any_match('context', relations.TIME_SIGNS)} AS timed,
    {any_match('context', relations.NEGATION_SIGNS)} AS negated
  FROM (SELECT DISTINCT context FROM pairs)),
fired AS (SELECT DISTINCT context, low, timed, negated, rel_type, ord FROM contexts JOIN pats
  ON contains(low, verb) AND contains(low, prep)),
quality AS (SELECT f.*,
    (SELECT count(*) FILTER (contains(f.low, v.verb)) / count(*) FROM verbs v WHERE v.rel_type = f.rel_type)
      * 0.6::DOUBLE
    + (SELECT count(*) FILTER (contains(f.low, p.prep)) / count(*) FROM preps p WHERE p.rel_type = f.rel_type)
      * 0.4::DOUBLE AS q FROM fired f),
rated AS (
  SELECT p.*, q.rel_type, q.ord, q.timed AS is_temporal, q.negated AS is_negated,
    greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.6::DOUBLE
      + CASE WHEN c.rel_type IS NOT NULL THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN length(p.context) < 50 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
      + (p.src_confidence + p.dst_confidence) * 0.05::DOUBLE + q.q * 0.1::DOUBLE
      + CASE WHEN q.timed THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
      - CASE WHEN q.negated THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END)) AS confidence
  FROM pairs p JOIN quality q ON p.context = q.context
  LEFT JOIN compat c ON c.src_type = p.src_type AND c.rel_type = q.rel_type AND c.dst_type = p.dst_type),
rels AS (
  SELECT * FROM rated
  QUALIFY row_number() OVER (PARTITION BY doc_id, page, sent_id, src_start, dst_start ORDER BY confidence DESC, ord) = 1)"""


STATEMENT_MENTIONS = STATEMENTS + ", " + mentions("statements", "doc_id, page")
LABELS = ", ".join(f"'{k}'" for k in kinds.MENTION_LABELS)

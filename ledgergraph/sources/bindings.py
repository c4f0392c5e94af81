"""Graph, metric, status and text tables made from the star-schema tables.

Each function is a plain projection, join or aggregation, so column pruning and filters on constant columns
(edge type, vertex type) reach the scans: ``edges(...).filter("type = 'LOCATED_IN'")`` reads ``nation`` only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgergraph.catalog import quality, rules
from ledgergraph.functions.text import once
from ledgergraph.sources.tables import spread, table


def money(value: Column) -> Column:
    """Text of an amount with two decimals."""
    return F.format_string("%.2f", value)


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def properties(**columns: Column) -> Column:
    """A property map without the entries whose value is null."""
    pairs = [part for name, value in columns.items() for part in (F.lit(name), value.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


VERTEX_SQL = """
SELECT concat('C', c_custkey) AS id, 'Company' AS type, c_name AS name,
  map('name', c_name, 'industry', c_mktsegment, 'ticker', substring(c_mktsegment, 1, 5),
    'revenue', format_string('%.2f', c_acctbal), 'employees', CAST(c_nationkey AS STRING),
    'compliance_status', CASE WHEN c_acctbal > 5000 THEN
      '{{"Risk Management":"ok","Best Execution":"ok","Client Reporting":"open"}}' END,
    'risk_assessment', CASE WHEN c_acctbal > 5000 THEN '{{"market_risk":"low","operational_risk":"high"}}' END) AS p,
  TIMESTAMP_NTZ '1992-01-01 00:00:00' AS created_at, 0.5D + (c_custkey % 50) / 100.0D AS confidence,
  concat('customers-', c_mktsegment) AS source_document FROM {customer}
UNION ALL SELECT concat('S', s_suppkey), 'Company', s_name,
  map('name', s_name, 'ticker', s_name, 'revenue', format_string('%.2f', s_acctbal), 'employees', 'n/a'),
  TIMESTAMP_NTZ '1992-01-01 00:00:00', 0.9D, 'suppliers' FROM {supplier}
UNION ALL SELECT concat('N', n_nationkey), 'Location', n_name, map('name', n_name),
  TIMESTAMP_NTZ '1992-01-01 00:00:00', 1.0D, 'geography' FROM {nation}
UNION ALL SELECT concat('R', r_regionkey), 'Location', r_name, map('name', r_name),
  TIMESTAMP_NTZ '1992-01-01 00:00:00', 1.0D, 'geography' FROM {region}
UNION ALL SELECT concat('P', p_partkey), 'FinancialInstrument', p_name,
  map('name', p_name, 'type', p_type, 'issuer', p_brand, 'face_value', format_string('%.2f', p_retailprice),
    'cusip', p_brand, 'documents', CASE p_size % 3 WHEN 0 THEN '["prospectus","offering_memorandum"]'
      WHEN 1 THEN '["prospectus"]' END),
  TIMESTAMP_NTZ '1992-01-01 00:00:00', 0.6D + p_size / 200.0D, concat('catalogue-', p_brand) FROM {part}
UNION ALL SELECT concat('O', o_orderkey), 'Transaction', concat('Order ', o_orderkey),
  map('amount', format_string('%.2f', o_totalprice), 'date', date_format(o_orderdate, 'yyyy-MM-dd'),
    'type', o_orderstatus, 'transaction_date', date_format(o_orderdate, 'yyyy-MM-dd'),
    'settlement_date', CAST(date_add(CAST(o_orderdate AS DATE), CASE o_orderpriority WHEN '1-URGENT' THEN -1 ELSE 7 END)
      AS STRING)),
  o_orderdate, 0.8D, concat('orders-', year(o_orderdate)) FROM {orders}
UNION ALL SELECT m.id, 'FinancialMetric', m.name, map('name', m.name), TIMESTAMP_NTZ '1992-01-01 00:00:00', 1.0D, 'metrics'
  FROM {region} LATERAL VIEW inline(array(struct('M1' AS id, 'revenue' AS name), struct('M2' AS id, 'orders' AS name))) m
  WHERE r_regionkey = 0
"""


def vertices(spark: SparkSession, folder: str) -> DataFrame:
    """Companies, locations, instruments, transactions and two metrics as one vertex table."""
    names = ("customer", "supplier", "nation", "region", "part", "orders")
    rows = spark.sql(VERTEX_SQL, **{n: table(spark, folder, n) for n in names})
    return rows.selectExpr("id", "type", "name", "map_filter(p, (k, v) -> v IS NOT NULL) AS properties", "created_at",
                           "created_at AS updated_at", "confidence", "source_document")


def supply_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (supplier, customer) with the number of lines, their quantity, discount and first date."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_discount",
                                                    "l_shipdate")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return (lines.join(orders, lines.l_orderkey == orders.o_orderkey)
            .groupBy("l_suppkey", "o_custkey")
            .agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"),
                 F.avg("l_discount").alias("discount"), F.min("l_shipdate").alias("first_ship")))


def customer_months(spark: SparkSession, folder: str) -> DataFrame:
    """Order value and number of orders per customer and month."""
    return (table(spark, folder, "orders")
            .groupBy("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
            .agg(F.sum("o_totalprice").alias("revenue"), F.count("*").alias("orders")))


EDGE_SQL = """
WITH supply AS (SELECT * FROM {pairs}), months AS (SELECT * FROM {months}),
issued AS (
  SELECT l_suppkey, l_partkey, min(l_shipdate) AS first_ship, sum(l_quantity) AS size,
    avg(l_extendedprice / l_quantity) AS price FROM {lineitem} GROUP BY l_suppkey, l_partkey)
SELECT 'HEADQUARTERED_IN' AS type, concat('C', c_custkey) AS src, concat('N', c_nationkey) AS dst, '' AS suffix,
  CAST(map() AS MAP<STRING, STRING>) AS p, TIMESTAMP_NTZ '1992-01-01 00:00:00' AS created_at, 1.0D AS confidence,
  concat('customers-', c_mktsegment) AS source_document FROM {customer}
UNION ALL SELECT 'HEADQUARTERED_IN', concat('S', s_suppkey), concat('N', s_nationkey), '', CAST(map() AS MAP<STRING, STRING>),
  TIMESTAMP_NTZ '1992-01-01 00:00:00', 1.0D, 'suppliers' FROM {supplier}
UNION ALL SELECT 'LOCATED_IN', concat('N', n_nationkey), concat('R', n_regionkey), '', CAST(map() AS MAP<STRING, STRING>),
  TIMESTAMP_NTZ '1992-01-01 00:00:00', 1.0D, 'geography' FROM {nation}
UNION ALL SELECT 'SUPPLIES_TO', concat('S', l_suppkey), concat('C', o_custkey), '',
  map('lines', CAST(lines AS STRING), 'quantity', format_string('%.2f', quantity)), first_ship,
  round(1.0D - discount, 6), 'suppliers' FROM supply
UNION ALL SELECT 'ISSUES', concat('S', l_suppkey), concat('P', l_partkey), '',
  map('issue_date', date_format(first_ship, 'yyyy-MM-dd'), 'issue_price', format_string('%.2f', price + 1e-7D),
    'issue_size', format_string('%.2f', size)), first_ship, 0.95D, 'suppliers' FROM issued
UNION ALL SELECT 'TRANSACTION', concat('C', o_custkey), concat('O', o_orderkey), '',
  map('transaction_date', date_format(o_orderdate, 'yyyy-MM-dd'), 'amount', format_string('%.2f', o_totalprice)),
  o_orderdate, 0.85D, concat('orders-', year(o_orderdate)) FROM {orders}
UNION ALL SELECT 'HAS_METRIC', concat('C', o_custkey), m.id, concat(':', month),
  map('type', m.name, 'timestamp', month, 'value', format_string('%.2f', m.value)),
  CAST(concat(month, '-01 00:00:00') AS TIMESTAMP_NTZ), 0.9D, 'orders' FROM months LATERAL VIEW inline(array(
    struct('M1' AS id, 'revenue' AS name, revenue AS value), struct('M2' AS id, 'orders' AS name, CAST(orders AS DOUBLE) AS value))) m
UNION ALL SELECT 'DEPENDS_ON', concat('C', o_custkey), concat('S', l_suppkey), '',
  map('severity', CASE WHEN lines >= 3 THEN 'high' WHEN lines = 2 THEN 'low' END), first_ship, 0.7D, 'suppliers' FROM supply
UNION ALL SELECT 'EXPOSED_TO', concat('C', c_custkey), concat('N', c_nationkey), '',
  map('severity', CASE WHEN c_acctbal < -500 THEN 'high' ELSE 'low' END), TIMESTAMP_NTZ '1992-01-01 00:00:00', 0.75D,
  concat('customers-', c_mktsegment) FROM {customer} WHERE c_acctbal < 0
"""


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """All relationships between the vertices, one table."""
    names = ("customer", "supplier", "nation", "orders", "lineitem")
    rows = spark.sql(EDGE_SQL, pairs=supply_pairs(spark, folder), months=customer_months(spark, folder),
                     **{n: table(spark, folder, n) for n in names})
    return rows.selectExpr("concat(type, ':', src, ':', dst, suffix) AS id", "type", "src", "dst",
                           "map_filter(p, (k, v) -> v IS NOT NULL) AS properties", "created_at",
                           "created_at AS updated_at", "confidence", "source_document")


def domain_subjects(spark: SparkSession, folder: str) -> DataFrame:
    """Subjects of the rules of all business domains: one per customer and rule, with some of the fields, requirements and
    risk factors that the rule asks for, some of them words where numbers are due."""
    texts = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    asked = F.array(*[F.struct(F.lit(no).alias("no"), F.lit(spec["type"]).alias("type"), texts(rules.domain_fields(spec)).alias("fields"),
                               texts(spec["compliance"]).alias("compliance"), texts(spec["risks"]).alias("risks"))
                      for no, spec in enumerate(rules.DOMAIN_RULES.values())])
    rows = table(spark, folder, "customer").select("c_custkey", once(money(F.col("c_acctbal"))).alias("balance"))
    rows = rows.select("c_custkey", "balance", F.explode(asked).alias("r"))
    n = F.col("c_custkey")

    def value(j: Column) -> Column:
        turn = (n + j) % 5
        return (F.when(turn == 1, "word").when(turn == 2, F.col("balance"))
                .when(turn == 3, F.concat(F.lit("AB"), F.lpad(n.cast("string"), 8, "0"))).when(turn == 4, "50"))

    def members(names: Column, kept) -> Column:
        some = F.filter(F.transform(names, lambda x, i: F.when(kept(i), F.concat(F.lit('"'), x, F.lit('":"ok"')))), lambda x: x.isNotNull())
        return F.concat(F.lit("{"), F.array_join(some, ","), F.lit("}"))

    given = F.transform("r.fields", lambda f, j: F.struct(f.alias("key"), value(j).alias("value")))
    more = F.array(F.struct(F.lit("compliance_status").alias("key"), members(F.col("r.compliance"), lambda i: (n + i) % 3 > 0).alias("value")),
                   F.struct(F.lit("risk_assessment").alias("key"), members(F.col("r.risks"), lambda i: (n + i) % 2 == 0).alias("value")))
    props = F.map_from_entries(F.filter(F.concat(given, more), lambda e: e["value"].isNotNull()))
    return rows.select(F.concat(F.lit("D"), "r.no", F.lit("-"), n).alias("id"), F.col("r.type").alias("type"), once(props).alias("properties"))


def people(spark: SparkSession, folder: str) -> DataFrame:
    """A person per customer, some of whom died before they were born."""
    born = F.date_add(F.lit("1950-01-01").cast("date"), (F.col("c_custkey") % 1000).cast("int"))
    died = F.when(F.col("c_custkey") % 3 == 0, F.date_add(born, (F.col("c_custkey") % 7 - 2).cast("int")))
    return table(spark, folder, "customer").select(
        key("H", "c_custkey").alias("id"), F.lit("Person").alias("type"), F.col("c_name").alias("name"),
        properties(name=F.col("c_name"), birth_date=born, death_date=died).alias("properties"))


def employment(spark: SparkSession, folder: str) -> DataFrame:
    """A job of the customer's person per order: a company, and the order's priority as the role."""
    return table(spark, folder, "orders").select(
        key("EMPLOYMENT:", "o_orderkey").alias("id"), F.lit("EMPLOYMENT").alias("type"), F.concat(F.lit("S"), F.col("o_orderkey") % 10).alias("src"),
        key("H", "o_custkey").alias("dst"), properties(role=F.col("o_orderpriority"), start_date=day(F.col("o_orderdate"))).alias("properties"))


def detailed_facts(spark: SparkSession, folder: str) -> DataFrame:
    """The metric facts with details: every other one says what its advice needs."""
    need = F.create_map(*[F.lit(x) for a in quality.ADVICE for x in (a[0], a[1])])
    k = F.round(F.col("confidence_score") * 100).cast("int")
    detail = F.create_map(need[F.col("metric_type")], F.concat(F.lit("k="), k))
    return metric_facts(spark, folder).withColumn("details", F.when(k % 2 == 0, detail))


def metric_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Quality metric facts (event_id, metric_type, entity_type, ts, value, threshold, confidence_score) from events."""
    return facts_from_events(table(spark, folder, "events"))


def facts_from_events(e: DataFrame) -> DataFrame:
    """The metric reading of a batch or stream of events."""
    return e.selectExpr(
        "event_id", "CASE event_type WHEN 'view' THEN 'completeness' WHEN 'click' THEN 'consistency' "
        "WHEN 'purchase' THEN 'accuracy' WHEN 'signup' THEN 'timeliness' WHEN 'error' THEN 'validity' END AS metric_type",
        "concat('E', user_id % 4) AS entity_type", "ts", "value / 500.0D AS value", "0.5D AS threshold",
        "CAST(get_json_object(props, '$.k') AS INT) / 100.0D AS confidence_score").filter("metric_type IS NOT NULL")


def status_events(spark: SparkSession, folder: str) -> DataFrame:
    """Processing status events, one document per user."""
    return status_from_events(table(spark, folder, "events"))


def status_from_events(e: DataFrame) -> DataFrame:
    """The status reading of a batch or stream of events."""
    k = "CAST(get_json_object(props, '$.k') AS INT)"
    return e.selectExpr(
        "event_id", "CAST(user_id AS STRING) AS document_id", "ts",
        "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'processing' "
        "WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS status",
        "CASE event_type WHEN 'view' THEN 'entity_extraction' WHEN 'click' THEN 'graph_storage' END AS stage",
        f"{k} / 100.0D AS progress", f"CAST({k} AS BIGINT) AS entities_processed",
        f"CAST({k} DIV 2 AS BIGINT) AS relationships_processed",
        f"CASE event_type WHEN 'error' THEN concat('k=', {k} % 5) END AS error_message").filter("status IS NOT NULL")


STATEMENT_SQL = """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, v) AS doc_id, l_linenumber AS page, concat(
    CASE (l_orderkey + l_linenumber) % 5
      WHEN 0 THEN concat(s_name, ' supplies parts to ', c_name, ' in ', y, '.')
      WHEN 1 THEN concat(c_name, ' bought a stake in ', s_name, ' for $', v, ' in ', y, '.')
      WHEN 2 THEN concat(s_name, ' did not invest, though ', c_name, ' competes with ', s_name, '.')
      WHEN 3 THEN concat(c_name, ' reported revenue of $', v, ' million during fiscal year ', y, '.')
      ELSE concat(c_name, ' acquired a division of ', s_name, ', revenue growth of 12% yearly.') END,
    '\\nInvoice #', l_orderkey, ' to the retail market, payment terms: amount due $', v, ' from cash.') AS text
FROM (SELECT *, format_string('%.2f', l_extendedprice) AS v, CAST(year(l_shipdate) AS STRING) AS y FROM {lines})
JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey
"""


def statements(spark: SparkSession, folder: str) -> DataFrame:
    """One short business text per line item: a sentence from a template and a payment sentence.

    doc_id is the key of the line with its price (the key alone may repeat), page its line number.
    """
    lines = spread(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                           "l_extendedprice", "l_shipdate"))
    names = ("orders", "customer", "supplier")
    return spark.sql(STATEMENT_SQL, lines=lines, **{n: table(spark, folder, n) for n in names})


def company_names(spark: SparkSession, folder: str) -> DataFrame:
    """The dictionary of known company names."""
    c = table(spark, folder, "customer").select(F.col("c_name").alias("name"))
    s = table(spark, folder, "supplier").select(F.col("s_name").alias("name"))
    return c.unionByName(s)

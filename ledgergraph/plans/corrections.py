"""Queries on corrections: the strategies (K1-K28), suggested and logged corrections (K29-K31), batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgergraph.catalog import frames
from ledgergraph.functions.values import get, number
from ledgergraph.operators import corrections as k
from ledgergraph.operators import validation as v
from ledgergraph.plans import sql
from ledgergraph.plans.registry import query
from ledgergraph.plans.validation import ENTITIES
from ledgergraph.session import scratch_folder
from ledgergraph.sources import bindings as b
from ledgergraph.sources import corrections_log
from ledgergraph.sources.tables import table

COMPANIES = """WITH co AS (
  SELECT 'C' || c_custkey AS id, c_name AS name, c_mktsegment AS industry, substring(c_mktsegment, 1, 5) AS ticker,
    printf('%.2f', c_acctbal) AS revenue, c_acctbal AS amount, CAST(c_nationkey AS VARCHAR) AS employees FROM customer
  UNION ALL SELECT 'S' || s_suppkey, s_name, NULL, s_name, printf('%.2f', s_acctbal), s_acctbal, 'n/a' FROM supplier)
"""


def _companies(spark, sf):
    return b.vertices(spark, sf).filter("type = 'Company'")


def _field_query(name: str, field: str, change, value_sql: str, doc: str) -> None:
    """A query that changes the properties of all companies and shows one field."""
    def fn(spark, sf):
        out = _companies(spark, sf).withColumn("properties", change(F.col("properties")))
        return out.select("id", get(F.col("properties"), field).alias(field))
    fn.__name__, fn.__doc__ = name, doc
    query(COMPANIES + f"SELECT id, {value_sql} AS {field} FROM co")(fn)


STANDARD = {"BUILDING": "construction", "AUTOMOBILE": "vehicles", "MACHINERY": "industrial"}
_case = "CASE industry " + " ".join(f"WHEN '{a}' THEN '{z}'" for a, z in STANDARD.items()) + " ELSE industry END"

for _args in (
    ("k1_add", "industry", lambda p: k.add(p, "industry", F.lit("unknown")), "coalesce(industry, 'unknown')",
     "Add a missing field."),
    ("k2_remove", "ticker", lambda p: k.remove(p, "ticker"), "CAST(NULL AS VARCHAR)", "Remove a field."),
    ("k3_update", "ticker", lambda p: k.update(p, "ticker", F.lit("NEW")), "'NEW'", "Set a field."),
    ("k4_format", "revenue", lambda p: k.format_number(p, "revenue", "%.3f EUR"),
     "printf('%.3f EUR', CAST(revenue AS DOUBLE))", "Format a number."),
    ("k5_convert", "employees", lambda p: k.convert(p, "employees", "double"),
     "coalesce(CAST(TRY_CAST(employees AS DOUBLE) AS VARCHAR), employees)", "Convert, or keep what cannot be converted."),
    ("k6_adjust", "revenue", lambda p: k.adjust(p, "revenue", 100.0), "printf('%.2f', CAST(revenue AS DOUBLE) + 100)",
     "Add an amount."),
    ("k7_normalize", "name", lambda p: k.normalize(p, "name"), "lower(trim(name))", "Trim and lower-case."),
    ("k8_standardize", "industry", lambda p: k.standardize(p, "industry", STANDARD), _case, "Replace known values."),
    ("k9_validate", "ticker", lambda p: k.keep_if(p, "ticker", lambda x: F.length(x) <= 5),
     "CASE WHEN length(ticker) <= 5 THEN ticker END", "Drop a value that fails a test."),
    ("k10_enrich", "industry", lambda p: k.transform(p, "industry", lambda x: F.concat(x, F.lit(" sector"))),
     "industry || ' sector'", "Enrich a value."),
    ("k11_transform", "name", lambda p: k.transform(p, "name", lambda x: F.substring_index(x, "#", 1)),
     "string_split(name, '#')[1]", "Transform a value."),
    ("k15_calculate", "label", lambda p: k.calculate(p, "label", F.concat_ws("/", get(p, "industry"), get(p, "ticker"))),
     "concat_ws('/', industry, ticker)", "Calculate a field from others."),
    ("k16_infer", "industry", lambda p: k.infer(p, "industry", F.concat(F.lit("as "), get(p, "name"))),
     "coalesce(industry, 'as ' || name)", "Infer a missing field from others."),
    ("k17_validate_format", "employees", lambda p: k.keep_pattern(p, "employees", r"\d+$"),
     "CASE WHEN regexp_full_match(employees, '[0-9]+') THEN employees END", "Drop a value of the wrong format."),
    ("k18_validate_pattern", "ticker", lambda p: k.keep_pattern(p, "ticker", r"[A-Z]{1,5}$"),
     "CASE WHEN regexp_full_match(ticker, '[A-Z]{1,5}') THEN ticker END", "Drop a value that does not match a pattern."),
    ("k19_validate_range", "revenue", lambda p: k.keep_range(p, "revenue", 0.0, 5000.0),
     "CASE WHEN CAST(revenue AS DOUBLE) BETWEEN 0 AND 5000 THEN revenue END", "Drop a value out of range."),
    ("k21_validate_consistency", "revenue",
     lambda p: k.consistent(p, ["revenue", "employees"], lambda r, e: number(r) > number(e) * 100),
     "CASE WHEN coalesce(CAST(revenue AS DOUBLE) > TRY_CAST(employees AS DOUBLE) * 100, FALSE) THEN revenue END",
     "Drop fields that contradict each other."),
    ("k23_validate_accuracy", "revenue", lambda p: k.keep_if(p, "revenue", lambda x: number(x) >= 0),
     "CASE WHEN CAST(revenue AS DOUBLE) >= 0 THEN revenue END", "Drop a value that is not accurate."),
    ("k25_validate_conformity", "ticker", lambda p: k.keep_if(p, "ticker", lambda x: x == F.upper(x)),
     "CASE WHEN ticker = upper(ticker) THEN ticker END", "Drop a value that does not conform."),
):
    _field_query(*_args)


@query("""
SELECT p_brand AS issuer, p_name AS name, count(*) AS merged, round(max(p_retailprice), 2) AS face_value,
  min('P' || p_partkey) AS id FROM part GROUP BY ALL""")
def k13_merge(spark, sf):
    """Merge instruments with the same issuer and name by aggregate functions (see also H5)."""
    from ledgergraph.operators.resolution import merge_by
    props = F.col("properties")
    v_ = b.vertices(spark, sf).filter("type = 'FinancialInstrument'").select("id", "name", get(props, "issuer").alias("issuer"),
                                                                            number(get(props, "face_value")).alias("face"))
    return merge_by(v_, ["issuer", "name"], merged=F.count("*"), face_value=F.round(F.max("face"), 2), id=F.min("id"))


@query(f"""WITH {sql.VERTICES}, {sql.EDGES} SELECT e.id FROM edges e JOIN vertices s ON s.id = src JOIN vertices d ON d.id = dst
WHERE e.type = 'SUPPLIES_TO' AND s.type = 'Company' AND d.type = 'Company' AND s.confidence >= 0.7::DOUBLE
  AND d.confidence >= 0.7::DOUBLE""")
def k20_validate_relationship(spark, sf):
    """Relationships whose ends exist and are of the right type, among the trusted vertices."""
    from ledgergraph.operators.graph import anchored
    good = b.vertices(spark, sf).filter("type = 'Company' AND confidence >= 0.7")
    return anchored(b.edges(spark, sf).filter("type = 'SUPPLIES_TO'"), good).select("id")


@query(COMPANIES + "SELECT id FROM co WHERE name IS NOT NULL AND industry IS NOT NULL")
def k22_validate_completeness(spark, sf):
    return k.complete(_companies(spark, sf), ["name", "industry"]).select("id")


@query("""
SELECT 'O' || o_orderkey AS id, CASE WHEN CAST(o_orderdate AS DATE) >= DATE '2001-01-01' - 730
  THEN strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders""")
def k24_validate_timeliness(spark, sf):
    """Drop dates older than two years at a given day."""
    o = b.vertices(spark, sf).filter("type = 'Transaction'")
    fresh = lambda x: F.date_diff(F.lit("2001-01-01").cast("date"), x.try_cast("date")) <= 730
    return o.withColumn("properties", k.keep_if(F.col("properties"), "date", fresh)).select(
        "id", get(F.col("properties"), "date").alias("date"))


@query(COMPANIES + """SELECT id, count(*) OVER (PARTITION BY ticker) AS times FROM co QUALIFY times > 1""")
def k26_validate_uniqueness(spark, sf):
    return k.repeated(_companies(spark, sf), ["ticker"])


@query(COMPANIES + "SELECT id FROM co WHERE CAST(revenue AS DOUBLE) >= 0 AND name LIKE '%#%'")
def k27_validate_integrity(spark, sf):
    p = F.col("properties")
    return k.holding(_companies(spark, sf), number(get(p, "revenue")) >= 0, get(p, "name").contains("#")).select("id")


@query(COMPANIES + "SELECT id FROM co WHERE coalesce(industry <> 'BUILDING' OR CAST(revenue AS DOUBLE) > 1000, FALSE)")
def k28_validate_business_rules(spark, sf):
    p = F.col("properties")
    return k.holding(_companies(spark, sf), (get(p, "industry") != "BUILDING") | (number(get(p, "revenue")) > 1000)).select("id")


def _log(spark, sf):
    """A correction log on customers: two corrections of the balance in order, one of the name, one switched off."""
    c = table(spark, sf, "customer").filter("c_acctbal < 0 OR c_mktsegment = 'BUILDING'")
    head = "CAST(c_custkey AS STRING)"
    return c.selectExpr(f"""inline(array(
      named_struct('correction_id', concat({head}, '-a'), 'subject_id', concat('C', c_custkey), 'strategy', 'adjust',
        'field', 'revenue', 'params', map('min', '0', 'max', '5000'), 'priority', 2, 'is_active', true),
      named_struct('correction_id', concat({head}, '-b'), 'subject_id', concat('C', c_custkey), 'strategy', 'update',
        'field', 'industry', 'params', map('value', 'corrected'), 'priority', 1, 'is_active', true),
      named_struct('correction_id', concat({head}, '-c'), 'subject_id', concat('C', c_custkey), 'strategy', 'remove',
        'field', 'ticker', 'params', map('by', 'hand'), 'priority', 1, 'is_active', c_mktsegment = 'BUILDING'),
      named_struct('correction_id', concat({head}, '-d'), 'subject_id', concat('C', c_custkey), 'strategy', 'add',
        'field', 'founding_date', 'params', map('by', 'hand'), 'priority', 0, 'is_active', true),
      named_struct('correction_id', concat({head}, '-e'), 'subject_id', concat('C', c_custkey), 'strategy', 'format',
        'field', 'name', 'params', map('format', '<{{}}>'), 'priority', 3, 'is_active', true)))""".replace("{{}}", "{}"))


@query(COMPANIES + """, logged AS (SELECT 'C' || c_custkey AS id, c_mktsegment = 'BUILDING' AS building FROM customer
  WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING')
SELECT co.id, CASE WHEN l.id IS NULL THEN name ELSE '<' || name || '>' END AS name,
  CASE WHEN l.id IS NULL THEN industry ELSE 'corrected' END AS industry,
  CASE WHEN coalesce(l.building, FALSE) THEN NULL ELSE ticker END AS ticker,
  round(CASE WHEN l.id IS NULL THEN CAST(revenue AS DOUBLE) ELSE greatest(0, least(CAST(revenue AS DOUBLE), 5000)) END, 2)
    AS revenue, l.id IS NOT NULL AS has_founding_date
FROM co LEFT JOIN logged l ON l.id = co.id""")
def k29_applied_log(spark, sf):
    """Entities after the active corrections of a log, in order of priority."""
    p = F.col("properties")
    return k.apply_logged(_companies(spark, sf), _log(spark, sf)).select(
        "id", get(p, "name").alias("name"), get(p, "industry").alias("industry"), get(p, "ticker").alias("ticker"),
        F.round(number(get(p, "revenue")), 2).alias("revenue"),
        F.map_contains_key(p, F.lit("founding_date")).alias("has_founding_date"))


# A suggested conversion fails on a value that is no number.
_TRIED = ENTITIES + """, tried AS (SELECT f.*, CASE WHEN action = 'convert' AND TRY_CAST(p.value AS DOUBLE) IS NULL THEN 'failed'
  ELSE 'applied' END AS status FROM found f LEFT JOIN vprops p ON p.id = f.subject_id AND p.key = f.field)"""


def _suggested(spark, sf):
    verts = b.vertices(spark, sf)
    return k.suggest(v.findings(v.validate_entities(verts, frames.rule_checks(spark)))), verts


@query(_TRIED + """ SELECT subject_id, rule, field, action AS strategy, status FROM tried""")
def k30_suggested_corrections(spark, sf):
    """Suggested corrections after they were tried."""
    return k.with_status(*_suggested(spark, sf), auto_apply=True).select("subject_id", "rule", "field", "strategy", "status")


@query("""
SELECT 'C' || c_custkey AS subject_id, CAST(4 + CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END
    - CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS active,
  CASE WHEN c_custkey % 5 = 0 THEN 'withdrawn' ELSE 'corrected' END AS state FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING'""")
def k31_correction_log(spark, sf):
    """Active corrections per entity in a stored log: written in two batches, some withdrawn by a third, read back."""
    folder, log = scratch_folder(spark, "corrections"), _log(spark, sf)
    first = F.col("priority") < 2
    corrections_log.append(log.where(first), folder)
    corrections_log.append(log.where(~first), folder)
    gone = log.where("strategy = 'update' AND CAST(substring(subject_id, 2) AS BIGINT) % 5 = 0").select("correction_id")
    corrections_log.withdraw(spark, gone, folder)
    rows = corrections_log.read(spark, folder)
    state = F.when(F.count_if(F.col("strategy").eqNullSafe("update") & F.col("is_active")) > 0, "corrected").otherwise("withdrawn")
    return rows.groupBy("subject_id").agg(F.count_if("is_active").alias("active"), state.alias("state"))


@query(COMPANIES + """SELECT id, CASE WHEN CAST(substring(id, 2) AS BIGINT) % 5 = 0 AND starts_with(id, 'C')
  AND (amount < 0 OR industry = 'BUILDING') THEN 'corrected' ELSE industry END AS industry, name FROM co""")
def k31_applied_by_id(spark, sf):
    """Corrections chosen from a stored log by their id."""
    folder = scratch_folder(spark, "corrections")
    corrections_log.append(_log(spark, sf), folder)
    chosen = table(spark, sf, "customer").where("c_custkey % 5 = 0").selectExpr("concat(c_custkey, '-b') AS correction_id")
    log = corrections_log.read(spark, folder).join(chosen, "correction_id", "left_semi")
    p = F.col("properties")
    return k.apply_logged(_companies(spark, sf), log).select("id", get(p, "industry").alias("industry"), get(p, "name").alias("name"))


def _batch(spark, sf, auto_apply: bool):
    suggested, verts = _suggested(spark, sf)
    return k.batch_totals(k.with_status(suggested, verts, auto_apply), verts).withColumn("success_rate", F.round("success_rate", 6))


_TOTALS = """, n AS (SELECT v.id, count(f.rule) AS c, count(f.rule) FILTER (status = 'failed') AS bad
  FROM vertices v LEFT JOIN {0} f ON f.subject_id = v.id GROUP BY v.id)
SELECT count(*) AS total_entities, count(*) FILTER (bad = 0) AS corrected_entities, count(*) FILTER (bad > 0) AS failed_corrections,
  CAST(sum(c) AS BIGINT) AS corrections, round(100.0::DOUBLE * count(*) FILTER (bad = 0) / count(*), 6) AS success_rate FROM n"""


@query(ENTITIES + ", offered AS (SELECT *, 'suggested' AS status FROM found)" + _TOTALS.format("offered"))
def e10_batch_correction(spark, sf):
    """Totals of a batch whose corrections are only suggested: none can fail."""
    return _batch(spark, sf, auto_apply=False)


@query(_TRIED + _TOTALS.format("tried"))
def e10_applied_corrections(spark, sf):
    """Totals of a batch whose corrections are applied; words where numbers are due make some fail."""
    return _batch(spark, sf, auto_apply=True)


@query(COMPANIES + """SELECT id, round(greatest(CAST(revenue AS DOUBLE), 0), 2) AS revenue,
  CASE WHEN TRY_CAST(employees AS DOUBLE) < 1 THEN '1.0' ELSE employees END AS employees, TRUE AS has_founding_date FROM co""")
def e10_corrected_companies(spark, sf):
    """Companies after the suggested corrections were applied."""
    suggested, verts = _suggested(spark, sf)
    p = F.col("properties")
    return k.apply_suggested(verts.filter("type = 'Company'"), suggested).select(
        "id", F.round(number(get(p, "revenue")), 2).alias("revenue"), get(p, "employees").alias("employees"),
        F.map_contains_key(p, F.lit("founding_date")).alias("has_founding_date"))

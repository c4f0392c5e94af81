"""Queries on validation: rules and checks (V), declared constraints (X), roll-ups (E8, E9, E11, E12, E16, E18), files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgergraph.catalog import frames, rules
from ledgergraph.functions.values import NUMERIC
from ledgergraph.operators import validation as v
from ledgergraph.plans import sql
from ledgergraph.plans.graph import GRAPH
from ledgergraph.plans.registry import query
from ledgergraph.sources import bindings as b
from ledgergraph.sources.tables import table

CHECKS = ("checks AS (SELECT * FROM "
          + sql.sql_values(rules.check_rows(), "t(rule, kind, type, domain, \"check\", field, pattern, min, max, enabled)")
          + ")")
NUM = sql.text_literal(NUMERIC)


def _findings_sql(subjects: str, props: str, where: str) -> str:
    """CTE ``found``: every violated check of every subject."""
    return f"""asked AS (
  SELECT s.id, c.*, p.id IS NOT NULL AS there, coalesce(p.value, 'None') AS value, d.value AS docs, m.value AS comp,
    r.value AS risks
  FROM {subjects} s JOIN checks c ON c.type = s.type AND c.enabled AND {where}
  LEFT JOIN {props} p ON p.id = s.id AND p.key = c.field
  LEFT JOIN {props} d ON d.id = s.id AND d.key = 'documents'
  LEFT JOIN {props} m ON m.id = s.id AND m.key = 'compliance_status'
  LEFT JOIN {props} r ON r.id = s.id AND r.key = 'risk_assessment'),
judged AS (SELECT *, CASE
    WHEN "check" IN ('required', 'metric', 'date') THEN CASE WHEN NOT there THEN 'add' END
    WHEN "check" = 'pattern' THEN CASE WHEN there AND NOT regexp_matches(value, pattern) THEN 'format' END
    WHEN "check" IN ('range', 'metric_range') THEN CASE WHEN there AND NOT regexp_matches(value, {NUM}) THEN 'convert'
      WHEN there AND (TRY_CAST(value AS DOUBLE) < min OR TRY_CAST(value AS DOUBLE) > max) THEN 'adjust' END
    WHEN "check" = 'document' THEN CASE WHEN docs IS NULL OR NOT contains(docs, '"' || field || '"') THEN 'add' END
    WHEN "check" = 'compliance' THEN CASE WHEN comp IS NULL OR NOT list_contains(json_keys(comp), field) THEN 'add' END
    WHEN "check" = 'risk' THEN CASE WHEN risks IS NULL OR NOT list_contains(json_keys(risks), field) THEN 'add' END
  END AS action FROM asked),
found AS (SELECT id AS subject_id, type, rule, "check", 'error' AS level, CASE "check" WHEN 'document' THEN 'documents'
    WHEN 'compliance' THEN 'compliance_status' WHEN 'risk' THEN 'risk_assessment' ELSE field END AS field, action
  FROM judged WHERE action IS NOT NULL)"""


ENTITY_WHERE = "c.kind IN ('entity', 'domain') AND c.\"check\" IN ('required','pattern','range','metric','metric_range','document')"
ENTITIES = (f"WITH {sql.VERTICES}, {sql.VPROPS}, {CHECKS}, " + _findings_sql("vertices", "vprops", ENTITY_WHERE))
RELATIONSHIPS = (f"WITH {sql.EDGES}, {sql.EPROPS}, {CHECKS}, "
                 + _findings_sql("edges", "eprops", "c.kind = 'relationship'"))
REPORT = """, counts AS (SELECT s.id, s.type, count(f.rule) AS findings, count(f.rule) FILTER (level = 'error') AS errors,
    count(f.rule) FILTER (level = 'warning') AS warnings
  FROM {0} s LEFT JOIN found f ON f.subject_id = s.id GROUP BY ALL),
report AS (SELECT *, CASE WHEN errors > 0 THEN 'error' WHEN warnings > 0 THEN 'warning' ELSE 'info' END AS overall_status,
    CASE WHEN findings > 0 THEN 1.0::DOUBLE - (errors * 0.7::DOUBLE + warnings * 0.3::DOUBLE) / findings ELSE 1.0::DOUBLE
    END AS confidence_score FROM counts)"""


def _entities(spark, sf):
    return v.validate_entities(b.vertices(spark, sf), frames.rule_checks(spark))


def _relationships(spark, sf):
    return v.validate_relationships(b.edges(spark, sf), frames.rule_checks(spark))


@query(f"WITH {sql.VERTICES}, {sql.EDGES}, {CHECKS}, n AS (SELECT type, count(*) AS n FROM vertices GROUP BY type "
       """UNION ALL SELECT type, count(*) FROM edges WHERE type <> 'Transaction' GROUP BY type)
SELECT rule, kind, c.type, "check", field, coalesce(n.n, 0) AS subjects FROM checks c LEFT JOIN n ON n.type = c.type
WHERE enabled""")
def v0_flattened_rules(spark, sf):
    """Every check of every rule with the number of subjects it applies to."""
    n = (b.vertices(spark, sf).select("type").unionByName(b.edges(spark, sf).select("type"))
         .groupBy("type").agg(F.count("*").alias("subjects")))
    c = frames.rule_checks(spark).filter("enabled")
    return F.broadcast(c).join(n, "type", "left").select("rule", "kind", "type", "check", "field",
                                                         F.coalesce("subjects", F.lit(0)).alias("subjects"))


def _one_check(name: str, check: str) -> None:
    """A query for one kind of check on entities and relationships together."""
    columns = 'subject_id, rule, field, action'

    def fn(spark, sf):
        one = frames.rule_checks(spark).filter(F.col("check") == check)
        e = v.findings(v.validate_entities(b.vertices(spark, sf), one))
        r = v.findings(v.validate_relationships(b.edges(spark, sf), one))
        return e.unionByName(r).select("subject_id", "rule", "field", "action")
    fn.__name__ = name
    fn.__doc__ = f"Findings of the {check} check."
    e = _findings_sql("vertices", "vprops", ENTITY_WHERE + f" AND c.\"check\" = '{check}'")
    r = _findings_sql("edges", "eprops", f"c.kind = 'relationship' AND c.\"check\" = '{check}'")
    for old in ("asked", "judged", "found"):
        r = r.replace(old, "r_" + old)
    query(f"WITH {sql.VERTICES}, {sql.VPROPS}, {sql.EDGES}, {sql.EPROPS}, {CHECKS}, {e}, {r} "
          f"SELECT {columns} FROM found UNION ALL SELECT {columns} FROM r_found")(fn)


for _name, _check in (("v1_required_fields", "required"), ("v2_patterns", "pattern"), ("v4_required_metrics", "metric"),
                      ("v5_metric_ranges", "metric_range"), ("v6_required_documents", "document"),
                      ("v7_required_dates", "date")):
    _one_check(_name, _check)


@query("""
SELECT 'C' || c_custkey AS subject_id, CASE WHEN c_custkey % 7 = 0 THEN 'convert' ELSE 'adjust' END AS action
FROM customer WHERE c_custkey % 7 = 0 OR (c_custkey % 7 <> 1 AND (c_acctbal < 0 OR c_acctbal > 5000))""")
def v3_field_ranges(spark, sf):
    """A caller's own range check, on balances that are sometimes words and sometimes NaN."""
    text = (F.when(F.col("c_custkey") % 7 == 0, "unknown").when(F.col("c_custkey") % 7 == 1, "NaN")
            .otherwise(b.money(F.col("c_acctbal"))))
    subjects = table(spark, sf, "customer").select(b.key("C", "c_custkey").alias("id"), F.lit("Account").alias("type"),
                                                   b.properties(balance=text).alias("properties"))
    check = frames.local(spark, [("balance_range", "entity", "Account", None, "range", "balance", None, 0.0, 5000.0, True)],
                         rules.CHECK_COLUMNS)
    return v.findings(v.validate_entities(subjects, check)).select("subject_id", "action")


def _list(values: list[str]) -> str:
    return "[" + ", ".join(sql.text_literal(v) for v in values) + "]"


# Subjects of all business domains, made as the bindings make them, together with the vertices.
DOMAIN_SUBJECTS = "dr AS (SELECT * FROM (VALUES " + ", ".join(
    f"({no}, '{spec['type']}', {_list(rules.domain_fields(spec))}, {_list(spec['compliance'])}, {_list(spec['risks'])})"
    for no, spec in enumerate(rules.DOMAIN_RULES.values())) + """) t(no, type, fields, compliance, risks)),
dv AS (SELECT 'D' || no || '-' || c_custkey AS id, type, c_custkey AS n, c_acctbal, fields, compliance, risks FROM customer, dr),
dvprops AS (
  SELECT id, type, key, CASE (n + j) % 5 WHEN 1 THEN 'word' WHEN 2 THEN printf('%.2f', c_acctbal) WHEN 3 THEN 'AB' || lpad(CAST(n AS VARCHAR), 8, '0')
      WHEN 4 THEN '50' END AS value FROM (SELECT id, type, n, c_acctbal, unnest(fields) AS key, unnest(range(len(fields))) AS j FROM dv)
  UNION ALL SELECT id, type, 'compliance_status', '{' || array_to_string(list_filter(list_transform(compliance,
    lambda x, i: CASE WHEN (n + i - 1) % 3 > 0 THEN '"' || x || '":"ok"' END), lambda x: x IS NOT NULL), ',') || '}' FROM dv
  UNION ALL SELECT id, type, 'risk_assessment', '{' || array_to_string(list_filter(list_transform(risks,
    lambda x, i: CASE WHEN (n + i - 1) % 2 = 0 THEN '"' || x || '":"ok"' END), lambda x: x IS NOT NULL), ',') || '}' FROM dv),
subj AS (SELECT id, type FROM vertices UNION ALL SELECT id, type FROM dv),
sprops AS (SELECT id, key, value FROM vprops UNION ALL SELECT id, key, value FROM dvprops WHERE value IS NOT NULL)"""
DOMAINS_WHERE = "c.kind = 'domain' AND c.\"check\" IN ('required','pattern','metric','metric_range','compliance','risk')"


def _domain_sql(where: str) -> str:
    return f"WITH {sql.VERTICES}, {sql.VPROPS}, {CHECKS}, {DOMAIN_SUBJECTS}, " + _findings_sql("subj", "sprops", where)


def _domain_vertices(spark, sf):
    return b.vertices(spark, sf).select("id", "type", "properties").unionByName(b.domain_subjects(spark, sf))


def _one_domain_check(name: str, check: str) -> None:
    def fn(spark, sf):
        one = frames.rule_checks(spark).filter(F.col("check") == check)
        return v.findings(v.validate_domains(_domain_vertices(spark, sf), one)).select("subject_id", "rule", "message")
    fn.__name__ = name
    fn.__doc__ = f"Findings of the {check} check of all domains."
    text = {"compliance": "Missing compliance requirement: ", "risk": "Missing required risk factor: "}[check]
    query(_domain_sql(f"c.kind = 'domain' AND c.\"check\" = '{check}'")
          + f" SELECT id AS subject_id, rule, '{text}' || field AS message FROM judged WHERE action IS NOT NULL")(fn)


_one_domain_check("v8_compliance", "compliance")
_one_domain_check("v9_risk_factors", "risk")


@query(ENTITIES + " SELECT subject_id, rule, \"check\", level, field, action FROM found")
def v10_entity_findings(spark, sf):
    return v.findings(_entities(spark, sf)).select("subject_id", "rule", "check", "level", "field", "action")


@query(RELATIONSHIPS + " SELECT subject_id, rule, \"check\", level, field, action FROM found")
def v11_relationship_findings(spark, sf):
    found = v.validate_relationships(v.ruled(b.edges(spark, sf)), frames.rule_checks(spark))
    return v.findings(found).select("subject_id", "rule", "check", "level", "field", "action")


@query(_domain_sql(DOMAINS_WHERE) + " SELECT subject_id, rule, \"check\", level, field, action FROM found")
def v12_domain_findings(spark, sf):
    """Findings of the rules of all domains."""
    d = v.validate_domains(_domain_vertices(spark, sf), frames.rule_checks(spark))
    return v.findings(d).select("subject_id", "rule", "check", "level", "field", "action")


# A rule with other content, one switched off, and a new one; another is deleted.
CHANGED = [
    ("company_required_fields", "entity", "Company", None, "required", "industry", None, None, None, True),
    ("company_required_fields", "entity", "Company", None, "metric_range", "revenue", None, 1000.0, 9000.0, True),
    ("transaction_required_fields", "entity", "Transaction", None, "required", "currency", None, None, None, False),
    ("location_required_fields", "entity", "Location", None, "required", "population", None, None, None, True),
    ("location_required_fields", "entity", "Location", None, "pattern", "name", "^[A-M]", None, None, True),
]
_KEPT = [r for r in rules.check_rows() if r[0] not in {c[0] for c in CHANGED} | {"market_making_validation"}]
_NEW_CHECKS = ("checks AS (SELECT * FROM "
               + sql.sql_values(_KEPT + CHANGED, "t(rule, kind, type, domain, \"check\", field, pattern, min, max, enabled)") + ")")


@query(f"WITH {sql.VERTICES}, {sql.VPROPS}, {_NEW_CHECKS}, " + _findings_sql("vertices", "vprops", ENTITY_WHERE) + """
SELECT rule, "check", field, action, count(*) AS findings FROM found GROUP BY ALL""")
def v13_changed_rules(spark, sf):
    """Validation after a rule was created, one changed, one switched off and one deleted."""
    checks = frames.rule_checks(spark)
    gone = checks.filter("rule = 'market_making_validation'").select("rule").distinct()
    changed = v.delete_rules(v.upsert_rules(checks, frames.local(spark, CHANGED, rules.CHECK_COLUMNS)), gone)
    found = v.findings(v.validate_entities(b.vertices(spark, sf), changed))
    return found.groupBy("rule", "check", "field", "action").agg(F.count("*").alias("findings"))


@query(f"""WITH {sql.VERTICES}, {sql.EDGES}, n AS (SELECT type, count(*) AS n FROM vertices GROUP BY type
  UNION ALL SELECT type, count(*) FROM edges GROUP BY type)
SELECT rule, kind, r.type, domain, coalesce(n.n, 0) AS subjects FROM {sql.sql_values(rules.rule_rows(),
    'r(rule, kind, type, domain, source_type, target_type, enabled)')} LEFT JOIN n ON n.type = r.type""")
def a15_rule_catalogue(spark, sf):
    """The rules, each with the number of subjects of its type in the graph."""
    n = (b.vertices(spark, sf).select("type").unionByName(b.edges(spark, sf).select("type"))
         .groupBy("type").agg(F.count("*").alias("subjects")))
    return F.broadcast(frames.rule_catalogue(spark)).join(n, "type", "left").select(
        "rule", "kind", "type", "domain", F.coalesce("subjects", F.lit(0)).alias("subjects"))


@query(ENTITIES + REPORT.format("vertices") + """
SELECT id, findings, errors, warnings, overall_status, round(confidence_score, 6) AS confidence_score FROM report""")
def e8_entity_reports(spark, sf):
    return v.report(_entities(spark, sf)).drop("type").withColumn("confidence_score", F.round("confidence_score", 6))


@query(ENTITIES + REPORT.format("vertices") + """
SELECT count(*) AS processed, count(*) FILTER (overall_status = 'error') AS error_count,
  count(*) FILTER (overall_status = 'warning') AS warning_count, count(*) FILTER (overall_status = 'info') AS success_count,
  round(avg(confidence_score), 6) AS average_confidence FROM report""")
def e9_batch_validation(spark, sf):
    return v.batch_totals(v.report(_entities(spark, sf))).withColumn("average_confidence", F.round("average_confidence", 6))


@query(ENTITIES + """
SELECT 'level' AS scope, level AS item, count(*) AS findings FROM found GROUP BY level
UNION ALL SELECT 'rule', rule, count(*) FROM found GROUP BY rule""")
def e11_finding_distribution(spark, sf):
    return v.distribution(v.findings(_entities(spark, sf)))


@query(ENTITIES + """
SELECT rule, action, count(*) AS corrections FROM found GROUP BY ALL""")
def e12_corrections_by_rule(spark, sf):
    return v.suggestions(v.findings(_entities(spark, sf)))


FILES = """files AS (SELECT source || '/' || doc_id || CASE WHEN lang = 'en' THEN '.pdf' ELSE '.txt' END AS name,
    CASE WHEN n_chars < 100 THEN 0 WHEN n_chars > 20000 THEN n_chars * 10000 ELSE n_chars END AS length FROM documents)"""


def _files(spark, sf):
    n = F.col("n_chars")
    return table(spark, sf, "documents").select(
        F.concat("source", F.lit("/"), "doc_id", F.when(F.col("lang") == "en", ".pdf").otherwise(".txt")).alias("name"),
        F.when(n < 100, 0).when(n > 20000, n * 10000).otherwise(n).alias("length"))


J8 = f"""WITH {FILES}, found AS (
  SELECT name, length, CASE WHEN length = 0 THEN 'document_content' WHEN length > 52428800 THEN 'document_size'
      ELSE 'document_accessibility' END AS rule,
    CASE WHEN length = 0 THEN 'error' WHEN length > 52428800 THEN 'warning' ELSE 'info' END AS level FROM files
  UNION ALL SELECT name, length, 'document_format', CASE WHEN lower(name) LIKE '%.pdf' THEN 'info' ELSE 'warning' END
  FROM files)"""


@query(J8 + " SELECT * FROM found")
def j8_file_findings(spark, sf):
    return v.validate_files(_files(spark, sf))


@query(J8 + """ SELECT count(*) AS total_rules, count(*) FILTER (level = 'info') AS passed,
  count(*) FILTER (level = 'error') AS failed, count(*) FILTER (level = 'warning') AS warnings FROM found""")
def e18_file_summary(spark, sf):
    return v.file_summary(v.validate_files(_files(spark, sf)))


@query(f"""WITH {sql.VERTICES}, {sql.VPROPS}
SELECT id AS subject_id, 'company_required_fields' AS rule, 'unique' AS "check", 'error' AS level, key AS field
FROM vprops WHERE type = 'Company' AND key IN ('ticker', 'name') QUALIFY count(*) OVER (PARTITION BY key, value) > 1""")
def x1_not_unique(spark, sf):
    """All fields that the catalogue declares unique."""
    return v.declared_constraints(b.vertices(spark, sf), b.edges(spark, sf)).filter("check = 'unique'")


@query("""
SELECT 'O' || o_orderkey AS subject_id, 'transaction_required_fields' AS rule, 'period' AS "check", 'error' AS level,
  'settlement_date' AS field FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT 'H' || c_custkey, 'person_required_fields', 'period', 'error', 'death_date' FROM customer
WHERE c_custkey % 3 = 0 AND c_custkey % 7 < 2""")
def x2_wrong_period(spark, sf):
    """All periods that the catalogue declares, on transactions and persons."""
    columns = ["id", "type", "properties"]
    subjects = b.vertices(spark, sf).select(*columns).unionByName(b.people(spark, sf).select(*columns))
    return v.declared_constraints(subjects, b.edges(spark, sf)).filter("check = 'period'")


@query("""
WITH jobs AS (SELECT 'S' || (o_orderkey % 10) AS src, 'H' || o_custkey AS dst, o_orderpriority AS role FROM orders),
wrong AS (SELECT dst, 'max_roles_per_person' AS field FROM jobs GROUP BY dst HAVING count(DISTINCT role) > 1
  UNION SELECT dst, 'max_companies_per_role' FROM jobs GROUP BY dst, role HAVING count(DISTINCT src) > 1)
SELECT dst AS subject_id, 'company_person_relationship' AS rule, 'cardinality' AS "check", 'error' AS level, field FROM wrong""")
def x3_declared_cardinality(spark, sf):
    """All cardinalities that the catalogue declares, on persons and their jobs."""
    return v.declared_constraints(b.people(spark, sf), b.employment(spark, sf)).filter("check = 'cardinality'")


@query(GRAPH + """
SELECT dst AS subject_id, 'suppliers_per_customer' AS rule, 'cardinality' AS "check", 'error' AS level, 'src' AS field
FROM edges WHERE type = 'SUPPLIES_TO' GROUP BY dst HAVING count(DISTINCT src) > 30""")
def x3_over_cardinality(spark, sf):
    return v.over_cardinality(b.edges(spark, sf), "SUPPLIES_TO", "dst", "src", 30, "suppliers_per_customer")


ENDPOINTS = GRAPH + f""", rt AS (SELECT * FROM {sql.sql_values(rules.rule_rows(),
    'r(rule, kind, type, domain, source_type, target_type, enabled)')} WHERE kind = 'relationship'),
ends AS (SELECT e.id, e.type, rule, s.type AS st, d.type AS dt, source_type, target_type FROM edges e
  JOIN rt ON rt.type = e.type JOIN vertices s ON s.id = e.src JOIN vertices d ON d.id = e.dst)"""


@query(ENDPOINTS + """
SELECT id AS subject_id, rule, 'endpoint' AS "check", 'error' AS level, 'src' AS field FROM ends WHERE st <> source_type
UNION ALL SELECT id, rule, 'endpoint', 'error', 'dst' FROM ends WHERE dt <> target_type""")
def x4_wrong_endpoints(spark, sf):
    return v.wrong_endpoints(b.edges(spark, sf), b.vertices(spark, sf), frames.rule_catalogue(spark))


@query(f"""WITH {sql.VERTICES}
SELECT id AS subject_id, 'confidence_threshold' AS rule, 'confidence' AS "check", 'warning' AS level, 'confidence' AS field
FROM vertices WHERE confidence < 0.7::DOUBLE""")
def x5_low_confidence(spark, sf):
    return v.low_confidence(b.vertices(spark, sf))


@query(GRAPH + """, known AS (SELECT id FROM vertices WHERE confidence >= 0.7::DOUBLE)
SELECT id AS subject_id, 'cross_reference' AS rule, 'reference' AS "check", 'error' AS level, 'src' AS field
FROM edges WHERE src NOT IN (SELECT id FROM known)
UNION ALL SELECT id, 'cross_reference', 'reference', 'error', 'dst' FROM edges WHERE dst NOT IN (SELECT id FROM known)""")
def x6_dangling(spark, sf):
    """Edges that refer to a vertex which is not among the trusted ones."""
    return v.dangling(b.edges(spark, sf), b.vertices(spark, sf).filter("confidence >= 0.7"))

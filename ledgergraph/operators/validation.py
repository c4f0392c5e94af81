"""Validation of entities and relationships against the rule checks, and its roll-ups.

The checks of a type travel as one array to each row of that type (a broadcast join with the small catalogue),
and are tried inside the row. Only violations become rows, and the report of an entity needs no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgergraph.catalog import doctypes, quality, rules
from ledgergraph.functions.text import once
from ledgergraph.functions.values import get, members, number, outside
from ledgergraph.operators.graph import by_id

ENTITY_CHECKS = ["required", "pattern", "range", "metric", "metric_range", "document"]
RELATIONSHIP_CHECKS = ["required", "pattern", "range", "date", "metric", "metric_range", "document"]
DOMAIN_CHECKS = ["required", "pattern", "metric", "metric_range", "compliance", "risk"]


def _by_type(checks: DataFrame, kept: list[str]) -> DataFrame:
    """One row per type with all its enabled checks of the given kinds, in a fixed order."""
    c = F.struct("rule", "check", "field", "pattern", "min", "max")
    return (checks.filter(F.col("enabled") & F.col("check").isin(*kept)).groupBy("type")
            .agg(F.array_sort(F.collect_list(c)).alias("_checks")))


def _there(c: Column) -> Column:
    """Whether the row has the field of a check, by its list of keys."""
    return F.exists("_keys", lambda k: k == c["field"])


def _in_question(c: Column) -> Column:
    """Whether a check can fail: one that asks for a field does without it, one of a value only with it."""
    return (F.when(c["check"].isin("required", "metric", "date"), ~_there(c))
            .when(c["check"].isin("document", "compliance", "risk"), True).otherwise(_there(c)))


def _looked_up(c: Column) -> Column:
    """A check with what the row has for its field."""
    props = F.col("properties")
    return F.struct(*[c[n].alias(n) for n in ("rule", "check", "field", "pattern", "min", "max")],
                    _there(c).alias("there"),
                    F.coalesce(F.try_element_at(props, c["field"]), F.lit("None")).alias("text"))


def _measured(c: Column) -> Column:
    """The same with the number in the text, where the check is about a range."""
    ranged = c["check"].isin("range", "metric_range") & c["there"]
    return F.struct(*[c[n].alias(n) for n in ("rule", "check", "field", "pattern", "min", "max", "there", "text")],
                    F.when(ranged, number(c["text"])).alias("value"))


def _judged(c: Column) -> Column:
    """The same with the action that would put it right; null if nothing is wrong."""
    check, field, there, value = c["check"], c["field"], c["there"], c["value"]
    action = (
        F.when(check.isin("required", "metric", "date"), F.when(~there, "add"))
        .when(check == "pattern",
              F.when(there & ~F.rlike(c["text"], F.concat(F.lit("^(?:"), c["pattern"], F.lit(")"))), "format"))
        .when(check == "document", F.when(~F.array_contains("_documents", field), "add"))
        .when(check == "compliance", F.when(~F.array_contains("_compliance", field), "add"))
        .when(check == "risk", F.when(~F.array_contains("_risks", field), "add"))
        .when(there, F.when(value.isNull(), "convert").when(outside(value, c["min"], c["max"]), "adjust")))
    return F.struct(*[c[n].alias(n) for n in ("rule", "check", "field", "min", "max", "text")],
                    F.lit("error").alias("level"), action.alias("action"))


def _message(check: Column, field: Column, action: Column) -> Column:
    head = F.when(check.startswith("metric"), "Financial metric ").otherwise("Field ")
    missing = (F.when(check == "required", "Missing required field: ").when(check == "date", "Missing required date: ")
               .when(check == "metric", "Missing required financial metric: ")
               .when(check == "document", "Missing required regulatory document: ")
               .when(check == "compliance", "Missing compliance requirement: ")
               .otherwise("Missing required risk factor: "))
    return (F.when(action == "format", F.concat(F.lit("Field "), field, F.lit(" does not match required pattern")))
            .when(action == "convert", F.concat(head, field, F.lit(" must be a numeric value")))
            .when(action == "adjust", F.concat(head, field, F.lit(" value "), F.col("text"),
                                               F.lit(" is outside allowed range ["), F.col("min").cast("string"),
                                               F.lit(", "), F.col("max").cast("string"), F.lit("]")))
            .otherwise(F.concat(missing, field)))


def validate(subjects: DataFrame, checks: DataFrame, kept: list[str]) -> DataFrame:
    """``subjects`` (id, type, properties, …) with an array ``findings``; empty, or null where no rule applies."""
    props = F.col("properties")
    prepared = subjects.select("*", members(get(props, "documents")).alias("_documents"),
                               members(get(props, "compliance_status")).alias("_compliance"),
                               members(get(props, "risk_assessment")).alias("_risks"), F.map_keys(props).alias("_keys"))
    joined = prepared.join(_by_type(checks, kept), "type", "left")
    # One step after another, so that each value is written down once and not copied into every place of use. Most checks
    # are dropped before, by what keys there are.
    asked = F.filter("_checks", _in_question)
    found = F.filter(F.transform(F.transform(F.transform(asked, _looked_up), _measured), _judged),
                     lambda f: f["action"].isNotNull())
    # Worked out once: a filter on the findings, which the optimizer takes from their explosion, would do it again.
    return joined.withColumn("findings", once(found)).select(*subjects.columns, "findings")


def validate_entities(vertices: DataFrame, checks: DataFrame) -> DataFrame:
    """All rules of the entity's type, those of the domains too, but without compliance and risk checks."""
    return validate(vertices, checks.filter("kind IN ('entity', 'domain')"), ENTITY_CHECKS)


def validate_relationships(edges: DataFrame, checks: DataFrame) -> DataFrame:
    return validate(edges, checks.filter("kind = 'relationship'"), RELATIONSHIP_CHECKS)


def ruled(edges: DataFrame) -> DataFrame:
    """The edges of types that have a rule, for where only findings are wanted: the others need not be read."""
    return edges.filter(F.col("type").isin(*[spec["type"] for spec in rules.RELATIONSHIP_RULES.values()]))


def validate_domain(vertices: DataFrame, checks: DataFrame, domain: str) -> DataFrame:
    return validate(vertices, checks.filter((F.col("kind") == "domain") & (F.col("domain") == domain)), DOMAIN_CHECKS)


def validate_domains(vertices: DataFrame, checks: DataFrame) -> DataFrame:
    """The rules of all domains at once, each on the entities of its type."""
    return validate(vertices, checks.filter("kind = 'domain'"), DOMAIN_CHECKS)


def findings(validated: DataFrame) -> DataFrame:
    """One row per finding: subject_id, type, rule, check, level, field, action, message, and the range of the check."""
    rows = validated.select(F.col("id").alias("subject_id"), "type", F.explode("findings").alias("f")).select(
        "subject_id", "type", "f.*")
    check, field = F.col("check"), F.col("field")
    target = (F.when(check == "document", "documents").when(check == "compliance", "compliance_status")
              .when(check == "risk", "risk_assessment").otherwise(field))
    return rows.select("subject_id", "type", "rule", "check", "level", target.alias("field"), "action",
                       _message(check, field, F.col("action")).alias("message"), "min", "max")


def report(validated: DataFrame) -> DataFrame:
    """One row per subject: findings, errors, warnings, overall status and confidence."""
    def n(level: str) -> Column:
        return F.coalesce(F.size(F.filter("findings", lambda f: f["level"] == level)), F.lit(0)).cast("long")
    rows = validated.select("id", "type", F.coalesce(F.size("findings"), F.lit(0)).cast("long").alias("findings"),
                            n("error").alias("errors"), n("warning").alias("warnings"))
    return _scored(rows)


def report_from_findings(found: DataFrame, subjects: DataFrame) -> DataFrame:
    """The same from finding rows of any origin; subjects without findings stay."""
    counts = found.groupBy(F.col("subject_id").alias("id")).agg(
        F.count("*").alias("findings"), F.count_if(F.col("level") == "error").alias("errors"),
        F.count_if(F.col("level") == "warning").alias("warnings"))
    return _scored(subjects.select("id", "type").join(counts, "id", "left").fillna(0))


def _scored(rows: DataFrame) -> DataFrame:
    weighed = F.col("errors") * quality.ERROR_WEIGHT + F.col("warnings") * quality.WARNING_WEIGHT
    return rows.select("*", F.when(F.col("errors") > 0, "error").when(F.col("warnings") > 0, "warning")
                       .otherwise("info").alias("overall_status"),
                       F.when(F.col("findings") > 0, F.lit(1.0) - weighed / F.col("findings")).otherwise(1.0)
                       .alias("confidence_score"))


def batch_totals(reports: DataFrame) -> DataFrame:
    """One row: subjects by worst level and their mean confidence."""
    return reports.agg(F.count("*").alias("processed"),
                       *[F.count_if(F.col("overall_status") == s).alias(n) for s, n in
                         (("error", "error_count"), ("warning", "warning_count"), ("info", "success_count"))],
                       F.avg("confidence_score").alias("average_confidence"))


def distribution(found: DataFrame) -> DataFrame:
    """Findings by level and by rule: scope, item, findings."""
    return (found.groupingSets([["level"], ["rule"]], "level", "rule")
            .agg(F.count("*").alias("findings"), F.grouping("rule").alias("_g"))
            .select(F.when(F.col("_g") == 1, "level").otherwise("rule").alias("scope"),
                    F.coalesce("level", "rule").alias("item"), "findings"))


def suggestions(found: DataFrame) -> DataFrame:
    """Suggested corrections by rule and action."""
    return found.groupBy("rule", "action").agg(F.count("*").alias("corrections"))


def validate_files(files: DataFrame) -> DataFrame:
    """Findings on files (name, length): size and format."""
    size, name = F.col("length"), F.lower("name")
    found = F.array(
        F.when(size == 0, F.struct(F.lit("document_content").alias("rule"), F.lit("error").alias("level")))
        .when(size > doctypes.MAX_FILE_BYTES, F.struct(F.lit("document_size").alias("rule"), F.lit("warning").alias("level")))
        .otherwise(F.struct(F.lit("document_accessibility").alias("rule"), F.lit("info").alias("level"))),
        F.when(name.endswith(".pdf"), F.struct(F.lit("document_format").alias("rule"), F.lit("info").alias("level")))
        .otherwise(F.struct(F.lit("document_format").alias("rule"), F.lit("warning").alias("level"))))
    return files.select("name", "length", F.explode(found).alias("f")).select("name", "length", "f.*")


def file_summary(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("total_rules"), F.count_if(F.col("level") == "info").alias("passed"),
                     F.count_if(F.col("level") == "error").alias("failed"),
                     F.count_if(F.col("level") == "warning").alias("warnings"))


def _finding(df: DataFrame, subject: Column, rule: str, check: str, level: str, field: Column) -> DataFrame:
    return df.select(subject.alias("subject_id"), F.lit(rule).alias("rule"), F.lit(check).alias("check"),
                     F.lit(level).alias("level"), field.alias("field"))


def not_unique(vertices: DataFrame, type_: str, field: str, rule: str) -> DataFrame:
    """Entities that share a value which should be unique. Values are counted first, then looked up."""
    value = get(F.col("properties"), field)
    rows = vertices.filter(F.col("type") == type_).select("id", value.alias("value")).filter("value IS NOT NULL")
    again = rows.groupBy("value").agg(F.count("*").alias("n")).filter("n > 1")
    return _finding(rows.join(again, "value", "left_semi"), F.col("id"), rule, "unique", "error", F.lit(field))


def wrong_period(vertices: DataFrame, type_: str, start: str, end: str, rule: str) -> DataFrame:
    """Entities whose start date lies after their end date."""
    props = F.col("properties")
    a, b = (get(props, f).try_cast("date") for f in (start, end))
    return _finding(vertices.filter((F.col("type") == type_) & (a > b)), F.col("id"), rule, "period", "error", F.lit(end))


def over_cardinality(edges: DataFrame, type_: str, end: str, other: str, most: int, rule: str) -> DataFrame:
    """Ends that stand in a relation to more than ``most`` different other ends."""
    many = (edges.filter(F.col("type") == type_).select(end, other).distinct()
            .groupBy(end).agg(F.count("*").alias("n")).filter(F.col("n") > most))
    return _finding(many, F.col(end), rule, "cardinality", "error", F.lit(other))


def over_roles(edges: DataFrame, type_: str, limits: dict[str, int], rule: str) -> DataFrame:
    """Persons (dst) with more roles than allowed, and those who have one role in more companies (src) than allowed."""
    jobs = edges.filter(F.col("type") == type_).select("src", "dst", get(F.col("properties"), "role").alias("role"))
    roles = jobs.where("role IS NOT NULL").select("dst", "role").distinct().groupBy("dst").count()
    companies = jobs.where("role IS NOT NULL").distinct().groupBy("dst", "role").count()
    many = roles.where(F.col("count") > limits["max_roles_per_person"]).select("dst", F.lit("max_roles_per_person").alias("limit"))
    many = many.union(companies.where(F.col("count") > limits["max_companies_per_role"]).select("dst", F.lit("max_companies_per_role")).distinct())
    return _finding(many, F.col("dst"), rule, "cardinality", "error", F.col("limit"))


def declared_constraints(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Findings for all unique fields, periods and cardinalities that the rule catalogue declares."""
    found = [not_unique(vertices, spec["type"], field, rule) for rule, spec in rules.ENTITY_RULES.items() for field in spec.get("unique", [])]
    found += [wrong_period(vertices, spec["type"], *spec["period"], rule) for rule, spec in rules.ENTITY_RULES.items() if "period" in spec]
    found += [over_roles(edges, spec["type"], spec["cardinality"], rule) for rule, spec in rules.RELATIONSHIP_RULES.items() if "cardinality" in spec]
    return reduce(DataFrame.unionByName, found)


def wrong_endpoints(edges: DataFrame, vertices: DataFrame, rule_table: DataFrame) -> DataFrame:
    """Edges whose source or target type is not the one the rule of the relation asks for."""
    wanted = rule_table.filter("kind = 'relationship' AND enabled").select(
        "rule", F.col("type").alias("rel"), "source_type", "target_type")
    asked = edges.select("id", F.col("type").alias("rel"), "src", "dst").join(wanted, "rel")
    ends = vertices.select("id", "type")
    both = (asked.join(ends.select(F.col("id").alias("src"), F.col("type").alias("src_type")), "src")
            .join(ends.select(F.col("id").alias("dst"), F.col("type").alias("dst_type")), "dst"))
    bad = F.array_compact(F.array(F.when(F.col("src_type") != F.col("source_type"), "src"),
                                  F.when(F.col("dst_type") != F.col("target_type"), "dst")))
    rows = both.select("id", "rule", F.explode(bad).alias("field"))
    return rows.select(F.col("id").alias("subject_id"), "rule", F.lit("endpoint").alias("check"),
                       F.lit("error").alias("level"), "field")


def low_confidence(vertices: DataFrame, least: float = rules.CONFIDENCE_THRESHOLD) -> DataFrame:
    return _finding(vertices.filter(F.col("confidence") < least), F.col("id"), "confidence_threshold", "confidence",
                    "warning", F.lit("confidence"))


def dangling(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges that refer to a vertex which does not exist, by the end that is wrong."""
    ends = F.array(*[F.struct(F.lit(end).alias("field"), F.col(end).alias("at")) for end in ("src", "dst")])
    asked = edges.select("id", F.inline(ends))
    wrong = asked.join(by_id(vertices, "at"), "at", "left_anti")
    return _finding(wrong, F.col("id"), "cross_reference", "reference", "error", F.col("field"))


def upsert_rules(catalogue: DataFrame, changes: DataFrame) -> DataFrame:
    """Rules with changed ones replaced and new ones added, by name."""
    return catalogue.join(changes.select("rule"), "rule", "left_anti").unionByName(changes)


def delete_rules(catalogue: DataFrame, names: DataFrame) -> DataFrame:
    return catalogue.join(names.select("rule"), "rule", "left_anti")

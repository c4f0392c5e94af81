"""The fixed values as small DataFrames, and as VALUES lists for the checking SQL.

Every frame here has at most a few hundred rows, bounded by this package and not by the data, so joining
one with ``broadcast`` is safe at any scale.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ledgergraph.catalog import doctypes, kinds, quality, relations, rules


def local(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """Rows as a local relation (through Arrow), so that the optimizer knows their size."""
    schema = T._parse_datatype_string(columns)
    data = pa.table({f.name: pa.array([row[i] for row in rows], to_arrow_type(f.dataType))
                     for i, f in enumerate(schema.fields)})
    return spark.createDataFrame(data, schema)


def rule_checks(spark: SparkSession) -> DataFrame:
    return local(spark, rules.check_rows(), rules.CHECK_COLUMNS)


def rule_catalogue(spark: SparkSession) -> DataFrame:
    return local(spark, rules.rule_rows(), "rule string, kind string, type string, domain string, "
                                           "source_type string, target_type string, enabled boolean")


def compatibility(spark: SparkSession) -> DataFrame:
    return local(spark, relations.compatibility_rows(), "src_type string, rel_type string, dst_type string")


def sentiment_terms(spark: SparkSession) -> DataFrame:
    return local(spark, relations.sentiment_rows(), "polarity string, category string, term string")


def document_fields(spark: SparkSession) -> DataFrame:
    return local(spark, doctypes.field_rows(),
                 "doc_type string, ordinal int, name string, key string, required boolean")


def entity_aliases(spark: SparkSession) -> DataFrame:
    return local(spark, kinds.entity_alias_rows(), "alias string, canonical string")


def accepted_relations(spark: SparkSession) -> DataFrame:
    names = kinds.RELATION_TYPES + kinds.EXTRA_ACCEPTED_RELATIONS
    return local(spark, [(n,) for n in names], "rel_type string")


def metric_weights(spark: SparkSession) -> DataFrame:
    return local(spark, list(quality.METRIC_WEIGHTS.items()), "metric_type string, weight double")


def stages(spark: SparkSession) -> DataFrame:
    return local(spark, [(s,) for s in kinds.STAGES], "stage string")


def sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, float):
        if value in (float("inf"), float("-inf")):
            return f"CAST('{'-' if value < 0 else ''}Infinity' AS DOUBLE)"
        return f"CAST({value!r} AS DOUBLE)"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def sql_values(rows: list[tuple], alias: str) -> str:
    """``(VALUES ...) AS alias`` for the checking SQL, e.g. alias ``t(a, b)``."""
    body = ",\n".join("(" + ", ".join(sql_literal(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS {alias}"

"""Corrections: field operations on property maps, row and table operations, suggested and logged corrections.

A field operation takes a property map column and returns one. Where the caller gives a function, it is a function
from Column to Column (an Arrow or pandas UDF is one too). A field that is not there is left alone unless stated; a function
that gives null leaves the value of a transform and fails a validation.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgergraph.functions.values import drop, get, number, put

Fn = Callable[[Column], Column]


def _there(props: Column, field: str) -> Column:
    return F.map_contains_key(props, F.lit(field))


def add(props: Column, field: str, value: Column) -> Column:
    """Set the field if it is not there."""
    return F.when(_there(props, field), props).otherwise(put(props, field, value))


def remove(props: Column, field: str) -> Column:
    return drop(props, field)


def update(props: Column, field: str, value: Column) -> Column:
    """Set the field whether it is there or not."""
    return put(props, field, value)


def transform(props: Column, field: str, fn: Fn) -> Column:
    """Replace the value by a function of it (also: enrich)."""
    value = get(props, field)
    return F.when(_there(props, field), put(props, field, F.coalesce(fn(value), value))).otherwise(props)


def format_number(props: Column, field: str, spec: str) -> Column:
    """Format a number by a printf spec; other values stay."""
    return transform(props, field, lambda v: F.when(number(v).isNotNull(), F.format_string(spec, number(v))))


def convert(props: Column, field: str, type_: str) -> Column:
    """The value as text of a type; a value that cannot be one stays."""
    return transform(props, field, lambda v: F.trim(v).try_cast(type_).cast("string"))


def adjust(props: Column, field: str, amount: float, digits: int = 2) -> Column:
    """Add an amount to a number; other values stay."""
    return transform(props, field, lambda v: F.when(
        number(v).isNotNull(), F.format_string(f"%.{digits}f", number(v) + F.lit(amount))))


def normalize(props: Column, field: str) -> Column:
    return transform(props, field, lambda v: F.lower(F.trim(v)))


def standardize(props: Column, field: str, standard: dict[str, str]) -> Column:
    """Replace known values by their standard form. The map is the caller's, and small."""
    known = F.create_map(*[F.lit(x) for kv in standard.items() for x in kv])
    return transform(props, field, lambda v: F.try_element_at(known, v))


def keep_if(props: Column, field: str, test: Fn) -> Column:
    """Remove the field if its value fails a test (also: accuracy, timeliness, conformity)."""
    ok = F.coalesce(test(get(props, field)), F.lit(False))
    return F.when(_there(props, field) & ~ok, drop(props, field)).otherwise(props)


def calculate(props: Column, field: str, value: Column) -> Column:
    """Set the field from the whole row; null leaves it."""
    return F.when(value.isNotNull(), put(props, field, value)).otherwise(props)


def infer(props: Column, field: str, value: Column) -> Column:
    """Set the field from the whole row if it is not there; null leaves it."""
    return F.when(~_there(props, field) & value.isNotNull(), put(props, field, value)).otherwise(props)


def keep_pattern(props: Column, field: str, pattern: str) -> Column:
    return keep_if(props, field, lambda v: v.rlike(f"^(?:{pattern})"))


def keep_range(props: Column, field: str, low: float, high: float) -> Column:
    return keep_if(props, field, lambda v: number(v).between(low, high))


def consistent(props: Column, fields: list[str], test: Callable[..., Column]) -> Column:
    """Remove all the fields if they are all there and fail a test together."""
    all_there = reduce(lambda a, b: a & b, [_there(props, f) for f in fields])
    ok = F.coalesce(test(*[get(props, f) for f in fields]), F.lit(False))
    return F.when(all_there & ~ok, reduce(drop, fields, props)).otherwise(props)


def complete(entities: DataFrame, fields: list[str]) -> DataFrame:
    """Entities with a value, not null, in every field."""
    return entities.filter(reduce(lambda a, b: a & b, [get(F.col("properties"), f).isNotNull() for f in fields]))


def holding(entities: DataFrame, *tests: Column) -> DataFrame:
    """Entities that pass every test on the whole row (integrity, business rules); null fails."""
    return entities.filter(reduce(lambda a, b: a & b, [F.coalesce(t, F.lit(False)) for t in tests]))


def repeated(entities: DataFrame, fields: list[str]) -> DataFrame:
    """Entities whose values in ``fields`` occur more than once, with the number of times.

    Values are counted first, so that copies are combined before they meet, and then looked up.
    """
    names = [f"_v{i}" for i in range(len(fields))]
    rows = entities.select("id", *[get(F.col("properties"), f).alias(n) for f, n in zip(fields, names)])
    rows = rows.dropna(subset=names)
    again = rows.groupBy(*names).agg(F.count("*").alias("times")).filter("times > 1")
    return rows.join(again, names).select("id", "times")


def _changed(old: Column, strategy: Column, params: Column) -> Column:
    """The value that a format, a conversion or an adjustment makes of another one; null if it can't."""
    def param(name: str) -> Column:
        return F.try_element_at(params, F.lit(name))
    low, high, now = param("min").try_cast("double"), param("max").try_cast("double"), old.try_cast("double")
    kind, form = param("type"), param("format")
    return (F.when(strategy == "format", F.when(form.isNull(), old).otherwise(F.replace(form, F.lit("{}"), old)))
            .when(strategy == "convert",
                  F.when(kind == "int", now.cast("bigint").cast("string"))
                  .when(kind == "float", now.cast("string"))
                  .when(kind == "bool", (F.length(old) > 0).cast("string"))
                  .when(kind == "date", F.trim(old).try_cast("timestamp_ntz").cast("string")).otherwise(old))
            .when(strategy == "adjust", F.when(now.isNull(), F.lit(None)).when(
                low.isNotNull() & high.isNotNull(), F.greatest(low, F.least(now, high)).cast("string")).otherwise(old)))


TAIL = ["format", "convert", "adjust"]


def logged_values(entities: DataFrame, corrections: DataFrame) -> DataFrame:
    """``id, field, there, value``: what the active corrections of a log make of each field that they name.

    Corrections of a field work in order of priority, then id, and touch no other field. So a field's log is cut by
    aggregates: what comes before its last removal doesn't count, nor what comes before the last update after that, and
    an addition counts if the field isn't there yet. Only the formats, conversions and adjustments after these points
    are put in order and worked through, field by field; the log of a subject never meets in one row.
    """
    key, order = ["id", "field"], F.struct("priority", "correction_id")
    fields = entities.select("id", F.map_keys("properties").alias("_fields"))
    log = corrections.filter("is_active").select(F.col("subject_id").alias("id"), "field", "strategy", "params", order.alias("at"))
    log = log.join(fields, "id").select(*key, "strategy", "params", "at", F.coalesce(F.array_contains("_fields", F.col("field")), F.lit(False)).alias("had"))
    kind = F.col("strategy")

    def of(name: str, value: Column | str = "at") -> Column:
        return F.when(kind == name, F.col(value) if isinstance(value, str) else value)

    removed = log.groupBy(*key).agg(F.max(of("remove")).alias("removed"))
    rows = log.join(removed, key).where(F.col("removed").isNull() | (F.col("at") > F.col("removed")) | ((kind == "remove") & (F.col("at") == F.col("removed"))))
    given = F.try_element_at("params", F.lit("value"))
    begun = rows.groupBy(*key).agg(
        F.first("removed").alias("_removed"), F.first("had").alias("_had"), F.min(of("add")).alias("_added"), F.min_by(given, of("add")).alias("_first"))
    begun = begun.select(*key, (F.col("_had") & F.col("_removed").isNull()).alias("_kept"), "_added", "_first")
    rows = rows.join(begun, key).where(F.col("_kept") | (F.col("at") >= F.col("_added")))
    effective = (kind == "update") & given.isNotNull()
    updated = rows.groupBy(*key).agg(F.max(F.when(effective, F.col("at"))).alias("_updated"), F.max_by(given, F.when(effective, F.col("at"))).alias("_new"))
    tail = rows.join(updated, key).where(kind.isin(*TAIL) & (F.col("_updated").isNull() | (F.col("at") > F.col("_updated"))))
    step = F.struct("at", "strategy", F.map_entries("params").alias("pairs"))
    steps = tail.groupBy(*key).agg(F.sort_array(F.collect_list(step)).alias("_steps"))
    base = begun.join(updated, key, "left").join(steps, key, "left").join(entities.select("id", "properties"), "id")
    old = F.when(F.col("_updated").isNotNull(), F.col("_new")).when(F.col("_kept"), F.try_element_at("properties", F.col("field"))).otherwise(F.col("_first"))
    start = base.select(*key, (F.col("_kept") | F.col("_added").isNotNull()).alias("there"), old.alias("_old"), "_steps")
    value = F.aggregate("_steps", F.col("_old"), lambda v, c: F.coalesce(_changed(v, c["strategy"], F.map_from_entries(c["pairs"])), v))
    return start.select(*key, "there", F.coalesce(value, F.col("_old")).alias("value"))


def with_values(entities: DataFrame, values: DataFrame) -> DataFrame:
    """Entities with the properties of ``values`` (id, field, there, value) in place of their own."""
    touched = values.groupBy("id").agg(F.collect_set("field").alias("_touched"),
                                       F.collect_list(F.when(F.col("there"), F.struct("field", "value"))).alias("_now"))
    rest = F.map_filter("properties", lambda k, _: ~F.array_contains("_touched", k))
    fixed = F.map_concat(rest, F.map_from_entries("_now"))
    return entities.join(touched, "id", "left").withColumn(
        "properties", F.when(F.col("_touched").isNull(), F.col("properties")).otherwise(fixed)).select(*entities.columns)


def apply_logged(entities: DataFrame, corrections: DataFrame) -> DataFrame:
    """Entities after their active corrections (correction_id, subject_id, strategy, field, params, priority, is_active).

    Corrections of one entity work in order of priority, then id; "add" without a value adds a null. What cannot be
    read as the number or date that a correction needs stays as it is.
    """
    return with_values(entities, logged_values(entities, corrections))


def suggest(findings: DataFrame) -> DataFrame:
    """The correction each finding suggests, as a correction table. Ids come from what is corrected.

    A conversion is one to a number, and an adjustment one to the range of the check.
    """
    params = (F.when(F.col("action") == "convert", F.create_map(F.lit("type"), F.lit("float")))
              .when(F.col("action") == "adjust", F.create_map(F.lit("min"), F.col("min").cast("string"), F.lit("max"), F.col("max").cast("string")))
              .otherwise(F.create_map().cast("map<string,string>")))
    return findings.select(
        F.sha2(F.concat_ws("|", "subject_id", "rule", "check", "field", "action", "message"), 256).alias("correction_id"),
        "subject_id", "rule", F.col("action").alias("strategy"), "field", params.alias("params"), F.lit(0).alias("priority"),
        F.lit(True).alias("is_active"))


def worked_through(suggested: DataFrame, entities: DataFrame) -> DataFrame:
    """``subject_id, field, there, value, steps`` after all suggested corrections of a field, in order.

    ``steps`` has each correction with its status: failed if the value it found was no number or date, applied otherwise.
    An entity has as many suggestions for a field as the rules have checks of it.
    """
    step = F.struct("priority", "correction_id", "rule", "strategy", F.map_entries("params").alias("pairs"))
    todo = suggested.filter("is_active").groupBy("subject_id", "field").agg(F.sort_array(F.collect_list(step)).alias("_todo"))
    rows = todo.join(entities.select(F.col("id").alias("subject_id"), "properties"), "subject_id", "left")
    had = F.coalesce(F.map_contains_key("properties", F.col("field")), F.lit(False))
    old = F.try_element_at("properties", F.col("field"))
    nothing = F.filter(F.transform("_todo", lambda c: F.struct(c["correction_id"].alias("correction_id"), c["rule"].alias("rule"),
                                                               c["strategy"].alias("strategy"), F.lit("").alias("status"))), lambda c: F.lit(False))

    def work(state: Column, c: Column) -> Column:
        strategy, params, there, now = c["strategy"], F.map_from_entries(c["pairs"]), state["there"], state["value"]
        given, tried = F.try_element_at(params, F.lit("value")), _changed(now, strategy, params)
        failed = there & strategy.isin("convert", "adjust") & tried.isNull()
        value = (F.when((strategy == "add") & ~there, given).when((strategy == "update") & there, F.coalesce(given, now))
                 .when(strategy.isin(*TAIL) & there, F.coalesce(tried, now)).otherwise(now))
        status = F.struct(c["correction_id"].alias("correction_id"), c["rule"].alias("rule"), strategy.alias("strategy"),
                          F.when(failed, "failed").otherwise("applied").alias("status"))
        return F.struct(((strategy == "add") | (there & (strategy != "remove"))).alias("there"), value.alias("value"),
                        F.concat(state["steps"], F.array(status)).alias("steps"))

    start = F.struct(had.alias("there"), old.alias("value"), nothing.alias("steps"))
    return rows.select("subject_id", "field", F.aggregate("_todo", start, work).alias("z")).select("subject_id", "field", "z.*")


def with_status(suggested: DataFrame, entities: DataFrame, auto_apply: bool) -> DataFrame:
    """Each suggested correction with what became of it: suggested, or applied or failed once it was tried."""
    if not auto_apply:
        return suggested.select("subject_id", "field", "correction_id", "rule", "strategy", F.lit("suggested").alias("status"))
    return worked_through(suggested, entities).select("subject_id", "field", F.inline("steps"))


def apply_suggested(entities: DataFrame, suggested: DataFrame) -> DataFrame:
    """Entities after their suggested corrections; one that fails leaves the value."""
    done = worked_through(suggested, entities)
    return with_values(entities, done.select(F.col("subject_id").alias("id"), "field", "there", "value"))


def batch_totals(status: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: entities corrected and failed, and the success rate in percent. Clean entities are successes."""
    bad = status.groupBy(F.col("subject_id").alias("id")).agg(
        F.count("*").alias("corrections"), F.count_if(F.col("status") == "failed").alias("failures"))
    rows = entities.select("id").join(bad, "id", "left").fillna(0)
    ok = F.col("failures") == 0
    return rows.agg(F.count("*").alias("total_entities"), F.count_if(ok).alias("corrected_entities"),
                    F.count_if(~ok).alias("failed_corrections"), F.sum("corrections").alias("corrections"),
                    (F.avg(F.when(ok, 1.0).otherwise(0.0)) * 100).alias("success_rate"))

"""Validation of extracted fields as rows of issues, and comparison with expected values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import is_iso_date

from .fields import FIELDS

#: In the order in which missing ones are reported.
REQUIRED = ("last_name", "first_name", "birth_date", "sex", "birth_place", "issue_date", "department_code", "issued_by")
SEXES = ("МУЖ", "ЖЕН", "М", "Ж")
ISSUE = "struct<field:string,code:string,message:string,value:string>"


def issue(test: Column, field: str, code: str, message: str) -> Column:
    return F.when(
        F.coalesce(test, F.lit(False)),
        F.struct(F.lit(field).alias("field"), F.lit(code).alias("code"), F.lit(message).alias("message"), F.col(field).cast("string").alias("value"))
    )


def blank(field: str) -> Column:
    return F.col(field).isNull() | F.col(field).rlike(r"(?U)^\s*\z")


def errors() -> list[Column]:
    out = [issue(blank(f), f, "missing_required_field", "Required field is missing") for f in REQUIRED]
    out += [issue(~is_iso_date(F.col(f)), f, "invalid_date_format", "Expected YYYY-MM-DD") for f in ("birth_date", "issue_date")]
    out.append(issue(~F.col("department_code").rlike(r"(?U)^\d{3}-\d{3}\z"), "department_code", "invalid_department_code_format", "Expected 000-000"))
    out.append(issue(~F.col("sex").isin(*SEXES), "sex", "invalid_sex_value", "Expected МУЖ, ЖЕН, М or Ж"))
    return out


def warnings() -> list[Column]:
    out = [
        issue(
            ~F.col(f).rlike(r"^[А-Я][А-Я \-]*\z"), f, "suspicious_name_format",
            "Name field contains unexpected characters"
        ) for f in ("last_name", "first_name", "middle_name")
    ]
    out.append(
        issue(
            blank("document_number"), "document_number", "missing_document_number",
            "Document number is missing; field is currently debug/validation only"
        )
    )
    out.append(
        issue(
            ~blank("document_number") & ~F.col("document_number").rlike(r"(?U)^\d{4} \d{6}\z"), "document_number",
            "invalid_document_number_format", "Expected 0000 000000"
        )
    )
    return out


def validate(fields: DataFrame) -> DataFrame:
    """Adds the struct ``validation``: status error > warning > ok, the issues and their counts."""
    e, w = F.array_compact(F.array(*errors())), F.array_compact(F.array(*warnings()))
    status = F.when(F.size(e) > 0, "error").when(F.size(w) > 0, "warning").otherwise("ok")
    summary = F.struct(F.size(e).alias("errors_count"), F.size(w).alias("warnings_count"))
    return fields.withColumn("validation", F.struct(status.alias("status"), e.alias("errors"), w.alias("warnings"), summary.alias("summary")))


def issues(validated: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per issue: key, severity, field, code, message, value."""
    one = lambda s: validated.select(key, F.lit(s).alias("severity"), F.explode(f"validation.{s}s").alias("i"))
    return one("error").union(one("warning")).select(key, "severity", "i.field", "i.code", "i.message", "i.value")


def error_results(requests: DataFrame, message: Column, stage: Column, service: bool = True) -> DataFrame:
    """Rows of the result shape for requests that a stage failed: all fields null, one error of the service or the pipeline."""
    field, code = ("__service__", "service_failed") if service else ("__pipeline__", "pipeline_failed")
    nulls = [F.lit(None).cast("string").alias(f) for f in FIELDS]
    one = F.array(F.struct(F.lit(field).alias("field"), F.lit(code).alias("code"), message.alias("message"), stage.alias("value")))
    check = F.struct(
        F.lit("error").alias("status"), one.alias("errors"), F.array().cast(f"array<{ISSUE}>").alias("warnings"),
        F.struct(F.lit(1).alias("errors_count"), F.lit(0).alias("warnings_count")).alias("summary")
    )
    return requests.select(
        "request_id", *nulls, check.alias("validation"),
        F.struct(F.lit("error").alias("status"), stage.alias("failed_stage")).alias("pipeline")
    )


def add_request_id(results: DataFrame, requests: DataFrame, key: str = "doc_id") -> DataFrame:
    """Results with the request that asked for each (requests: key, request_id)."""
    return results.join(requests.select(key, "request_id"), key)


def summaries(validated: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per result: status, issue counts, the issues' codes by severity and how many fields were found."""
    found = sum((F.col(f).isNotNull().cast("int") for f in FIELDS), F.lit(0))
    codes = lambda s: F.transform(f"validation.{s}", lambda i: F.concat_ws(":", i["field"], i["code"])).alias(s)
    return validated.select(
        key, "validation.status", "validation.summary.errors_count", "validation.summary.warnings_count",
        codes("errors"), codes("warnings"), found.alias("fields_found")
    )


def compare_fields(actual: DataFrame, expected: DataFrame, keys: tuple[str, ...] = ("case_id", "field")) -> DataFrame:
    """Both sides' values by case and field; ``ok`` compares nulls as equal, or matches a pattern where one is given."""
    a, e = actual.withColumnRenamed("value", "actual"), expected.withColumnRenamed("value", "expected")
    both = a.join(e, list(keys), "full")
    equal = F.col("actual").eqNullSafe(F.col("expected"))
    if "pattern" in e.columns:
        equal = F.when(
            F.col("pattern").isNotNull(),
            F.coalesce(F.regexp_like("actual", F.concat(F.lit("^(?:"), "pattern", F.lit(")$"))), F.lit(False))
        ).otherwise(equal)
    return both.withColumn("ok", equal)


def compare_validation(actual: DataFrame, expected: DataFrame, key: str = "case_id") -> DataFrame:
    """A row for each part of the validation that is not as expected; what ``expected`` leaves null is not compared.

    expected: key, status, errors_count, warnings_count; actual: key and the struct ``validation``, which may be null.
    """
    e = expected.select(key, *[F.col(c).alias(f"_{c}") for c in ("status", "errors_count", "warnings_count")])
    both = e.join(actual.select(key, "validation"), key, "left")
    missing = F.col("validation").isNull()
    asked = F.col("_status").isNotNull() | F.col("_errors_count").isNotNull() | F.col("_warnings_count").isNotNull()
    parts = [
        F.when(
            missing & asked,
            F.struct(F.lit("validation").alias("field"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("actual"))
        )
    ]
    for field, want, got in (
        ("validation.status", "_status", "validation.status"),
        ("validation.summary.errors_count", "_errors_count", "validation.summary.errors_count"),
        ("validation.summary.warnings_count", "_warnings_count", "validation.summary.warnings_count")
    ):
        wrong = ~missing & F.col(want).isNotNull() & ~F.col(want).cast("string").eqNullSafe(F.col(got).cast("string"))
        parts.append(
            F.when(
                wrong,
                F.struct(F.lit(field).alias("field"), F.col(want).cast("string").alias("expected"), F.col(got).cast("string").alias("actual"))
            )
        )
    return both.select(key, F.explode(F.array_compact(F.array(*parts))).alias("x")).select(key, "x.*")


def run_cases(results: DataFrame, expected: DataFrame, expected_validation: DataFrame, key: str = "case_id") -> DataFrame:
    """key, status (missing_input, ok, failed) and errors of each expected case.

    results: key, the fields and ``validation``; expected: key, field, value (or pattern).
    """
    actual = results.select(key, F.expr("stack(%d, %s) AS (field, value)" % (len(FIELDS), ", ".join(f"'{f}', `{f}`" for f in FIELDS))))
    compared = compare_fields(actual, expected, (key, "field")).join(expected.select(key, "field"), [key, "field"], "left_semi").where("NOT ok")
    fields = compared.select(key, F.struct("field", F.col("expected").cast("string").alias("expected"), "actual").alias("e"))
    checks = compare_validation(results, expected_validation, key).select(key, F.struct("field", "expected", "actual").alias("e"))
    wrong = fields.union(checks).groupBy(key).agg(F.array_sort(F.collect_list("e")).alias("errors"))
    cases = expected.select(key).union(expected_validation.select(key)).distinct()
    there = results.select(key, F.lit(True).alias("there")).distinct()
    out = cases.join(there, key, "left").join(wrong, key, "left")
    none = F.array().cast("array<struct<field:string,expected:string,actual:string>>")
    status = F.when(F.col("there").isNull(), "missing_input").when(F.col("errors").isNull(), "ok").otherwise("failed")
    return out.select(key, status.alias("status"), F.when(F.col("there").isNull(), none).otherwise(F.coalesce("errors", none)).alias("errors"))

"""Cleaning steps proposed for the issues of many tables, and decisions about them."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.errors import ToolError
from tablewright.functions import ids
from tablewright.specs import CleaningKind, CleaningStep, Outcome

# Missing categories below this share are filled without asking.
ASK_FROM_PERCENT = 10.0
# Operations a decision may put in place of the proposed one.
DECIDABLE = (
    CleaningKind.ignore_issue, CleaningKind.drop_rows, CleaningKind.fill_missing,
    CleaningKind.deduplicate, CleaningKind.strip_whitespace, CleaningKind.cast_type,
    CleaningKind.parse_dates, CleaningKind.normalize_format,
)


def suggest_cleaning(profile: DataFrame, issues: DataFrame) -> DataFrame:
    """One step per issue: operation, rationale, need for approval, expected effect."""
    roles = profile.select(
        "table_name", "column_name", F.col("total_count").alias("column_rows"),
        "is_likely_id", "is_likely_metric", "is_likely_categorical", "is_likely_date",
    )
    rows = profile.groupBy("table_name").agg(F.max("total_count").alias("row_count"))
    known = issues.join(roles, ["table_name", "column_name"], "left").join(rows, "table_name", "left")

    kind, name = F.col("issue_type"), F.col("column_name")
    metric = F.coalesce("is_likely_metric", F.lit(False))
    key = metric | F.coalesce("is_likely_id", F.lit(False)) | F.coalesce("is_likely_date", F.lit(False))
    category = F.coalesce("is_likely_categorical", F.lit(False))
    dated = F.coalesce("is_likely_date", F.lit(False))
    many = F.col("affected_rows_percent") >= ASK_FROM_PERCENT

    missing = kind == "missing_values"
    cases = [
        # when, action, operation, asks, impact, recommended action, rationale
        (missing & key, "drop_rows_with_missing_key_fields", "drop_rows", F.lit(True), F.lit("high"),
         F.format_string("Remove the rows without %s", name),
         F.format_string("%s is used as a %s, so a row without it cannot be counted or placed.", name,
                         F.when(metric, "measure").otherwise("key or date"))),
        (missing & category, "fill_missing_constant", "fill_missing", many,
         F.when(many, "medium").otherwise("low"),
         F.format_string("Put Unknown where %s is empty", name),
         F.format_string("%s is a category: its own label for empty cells keeps every row.", name)),
        (missing, "ignore_issue", "ignore_issue", F.lit(False), F.lit("low"),
         F.format_string("Leave %s as it is", name),
         F.format_string("%s plays no key role.", name)),
        (kind == "duplicate_rows", "remove_exact_duplicates", "deduplicate", F.lit(True), F.lit("high"),
         F.lit("Keep one of each group of equal rows"),
         F.lit("Repeated rows count twice in every total.")),
        (kind == "whitespace", "trim_whitespace", "strip_whitespace", F.lit(False), F.lit("low"),
         F.format_string("Trim %s", name),
         F.lit("Padded values differ from their unpadded equals in groups and joins.")),
        (kind == "numeric_stored_as_text", "convert_numeric", "cast_type", metric,
         F.when(metric, "high").otherwise("medium"),
         F.format_string("Turn %s into numbers", name),
         F.format_string("%s reads as numbers; as text it cannot be added up.", name)),
        (kind == "date_stored_as_text", "parse_dates", "parse_dates", dated, F.lit("medium"),
         F.format_string("Turn %s into timestamps", name),
         F.format_string("%s reads as dates; as text it cannot be put into periods.", name)),
        (kind == "high_cardinality_category", "ignore_issue", "ignore_issue", F.lit(False), F.lit("low"),
         F.format_string("Leave the many values of %s", name),
         F.lit("Many categories are worth knowing about and need no change.")),
        (kind == "mixed_types", "ignore_issue", "ignore_issue", F.lit(True), F.lit("medium"),
         F.format_string("Have somebody look at %s", name),
         F.lit("Numbers and dates are mixed; either conversion would lose the other.")),
    ]
    choice: Column | None = None
    for when, action, operation, asks, impact, recommended, rationale in cases:
        value = F.struct(
            F.lit(action).alias("action_type"), F.lit(operation).alias("operation"),
            asks.alias("asks"), impact.alias("impact"),
            recommended.alias("recommended"), rationale.alias("rationale"),
        )
        choice = F.when(when, value) if choice is None else choice.when(when, value)

    chosen = known.withColumn("choice", choice).filter(F.col("choice").isNotNull())
    operation = F.col("choice.operation")
    removes = operation.isin("drop_rows", "deduplicate")
    removed = F.when(removes, F.col("affected_rows_count")).otherwise(F.lit(0))
    touches_metric = (metric & operation.isin("drop_rows", "cast_type")) | (operation == "deduplicate")
    in_order = Window.partitionBy("table_name").orderBy("issue_order")
    numbered = chosen.withColumn("sequence", F.row_number().over(in_order))
    step_name = F.concat(
        F.lit("clean_"), F.lpad(F.col("sequence").cast("string"), 3, "0"), F.lit("_"), kind,
        F.lit("_"), F.col("table_name"), F.lit("_"), F.coalesce(name, F.lit("")),
    )
    return numbered.select(
        ids.uuid5(step_name).alias("step_id"),
        "table_name", "sequence", "issue_type", "column_name", "description",
        "affected_rows_count", "affected_rows_percent", "sample_values",
        F.col("choice.action_type").alias("action_type"),
        F.col("choice.recommended").alias("recommended_action"),
        F.col("choice.rationale").alias("rationale"),
        F.col("choice.impact").alias("impact_level"),
        touches_metric.alias("affects_key_metrics"),
        F.col("choice.asks").alias("requires_approval"),
        F.when(F.col("choice.asks"), "require_review").otherwise("approve").alias("default_decision"),
        operation.alias("operation"),
        _parameters(operation, name, kind).alias("parameters"),
        F.col("row_count").alias("rows_before"),
        F.greatest(F.col("row_count") - removed, F.lit(0)).alias("estimated_rows_after"),
        removed.alias("estimated_rows_removed"),
        F.array_compact(F.array(name)).alias("columns_changed"),
        F.when(metric & operation.isin("drop_rows", "cast_type"), F.array(name))
        .otherwise(F.array().cast("array<string>")).alias("metrics_potentially_affected"),
    )


def _parameters(operation: Column, name: Column, kind: Column) -> Column:
    """Parameters of the operation as a map of texts."""
    extra = (
        F.when(operation == "drop_rows", F.create_map(F.lit("strategy"), F.lit("drop_rows_with_missing_key_fields")))
        .when(operation == "fill_missing", F.create_map(F.lit("strategy"), F.lit("constant"), F.lit("fill_value"), F.lit("Unknown")))
        .when(operation == "deduplicate", F.create_map(F.lit("strategy"), F.lit("exact")))
        .when(operation == "cast_type", F.create_map(F.lit("target_type"), F.lit("numeric")))
        .when(kind == "mixed_types", F.create_map(F.lit("reason"), F.lit("mixed_types")))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    column = F.when(name.isNotNull(), F.create_map(F.lit("column"), name)).otherwise(
        F.create_map().cast("map<string,string>")
    )
    return F.map_concat(column, extra)


def summarize_cleaning(steps: DataFrame) -> DataFrame:
    """Per table: number of steps, how many ask, run by themselves or do nothing, expected loss."""
    asks, idle = F.col("requires_approval"), F.col("operation") == "ignore_issue"
    first = steps.select("table_name", "sequence", F.explode_outer("columns_changed").alias("c"))
    columns = first.groupBy("table_name", "c").agg(F.min("sequence").alias("s")).groupBy("table_name").agg(
        F.array_sort(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("s", "c")))).alias("pairs")
    )
    counted = steps.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("total_steps"),
        F.count_if(asks).alias("steps_requiring_approval"),
        F.count_if(idle).alias("auto_ignored_steps"),
        F.coalesce(F.sum("estimated_rows_removed"), F.lit(0)).alias("estimated_row_count_change"),
    )
    automatic = F.col("total_steps") - F.col("steps_requiring_approval") - F.col("auto_ignored_steps")
    return counted.join(columns, "table_name").select(
        "table_name", "total_steps", "steps_requiring_approval",
        F.greatest(automatic, F.lit(0)).alias("auto_approved_steps"),
        "auto_ignored_steps", "estimated_row_count_change",
        F.transform("pairs", lambda p: p.c).alias("estimated_columns_changed"),
    )


def resolve_decisions(steps: DataFrame, decisions: DataFrame) -> DataFrame:
    """Steps with `outcome` and the operation that will run.

    `decisions` has `step_id`, `decision` (approve, reject, modify) and, for modify,
    `modified_operation`, `modified_parameters` (map of texts).
    """
    _check_decisions(steps, decisions)
    optional = {"modified_operation": "string", "modified_parameters": "map<string,string>"}
    for name, dtype in optional.items():
        if name not in decisions.columns:
            decisions = decisions.withColumn(name, F.lit(None).cast(dtype))
    d = decisions.select("step_id", "decision", *optional)
    decided = F.col("decision")
    outcome = (
        F.when(decided == "approve", Outcome.approved.value)
        .when(decided == "reject", Outcome.rejected.value)
        .when(decided == "modify", Outcome.modified.value)
        .when(F.col("operation") == "ignore_issue", Outcome.skipped.value)
        .when(F.col("requires_approval"), Outcome.blocked.value)
        .when(F.col("default_decision") == "approve", Outcome.auto_approved.value)
        .otherwise(Outcome.blocked.value)
    )
    modified = F.col("outcome") == Outcome.modified.value
    return (
        steps.join(d, "step_id", "left")
        .withColumn("outcome", outcome)
        .withColumn("effective_operation", F.when(modified, F.col("modified_operation")).otherwise(F.col("operation")))
        .withColumn("effective_parameters", F.when(modified, F.coalesce("modified_parameters", F.create_map().cast("map<string,string>"))).otherwise(F.col("parameters")))
        .drop("decision", *optional)
    )


def _check_decisions(steps: DataFrame, decisions: DataFrame) -> None:
    twice = decisions.groupBy("step_id").count().filter("count > 1").first()
    if twice:
        raise ToolError(f"Duplicate decision for step {twice['step_id']}")
    unknown = decisions.join(steps.select("step_id"), "step_id", "left_anti").first()
    if unknown:
        raise ToolError(f"Decision references unknown step {unknown['step_id']}")
    odd = decisions.filter(~F.col("decision").isin("approve", "reject", "modify")).first()
    if odd:
        raise ToolError(f"Unknown decision '{odd['decision']}' for step {odd['step_id']}")
    modify = decisions.filter(F.col("decision") == "modify")
    if "modified_operation" not in decisions.columns:
        bad = modify.first()
    else:
        allowed = F.coalesce(F.col("modified_operation").isin([str(k) for k in DECIDABLE]), F.lit(False))
        bad = modify.filter(~allowed).first()
    if bad:
        raise ToolError(f"Step {bad['step_id']} is modified without a supported operation")


def summarize_decisions(resolved: DataFrame) -> DataFrame:
    """Counts per outcome in one row; nothing may run while a step is blocked."""
    counts = [F.count_if(F.col("outcome") == o.value).alias(f"{o.value}_steps") for o in Outcome]
    row = resolved.agg(F.count(F.lit(1)).alias("total_steps"), *counts)
    return row.withColumn("can_execute", F.col("blocked_steps") == 0)


def _typed(parameters: dict[str, str] | None) -> dict:
    """Parameters for the operation; a `mapping` is written as a JSON object."""
    given = {k: v for k, v in (parameters or {}).items() if k != "column"}
    if "mapping" in given:
        given["mapping"] = json.loads(given["mapping"])
    return given


def to_steps(resolved: DataFrame) -> list[CleaningStep]:
    """Resolved rows as steps to apply. There is one row per issue of a profile."""
    rows = resolved.orderBy("table_name", "sequence").collect()
    return [
        CleaningStep(
            table=r["table_name"],
            kind=r["effective_operation"],
            column=(r["effective_parameters"] or {}).get("column"),
            parameters=_typed(r["effective_parameters"]),
            outcome=r["outcome"],
            step_id=r["step_id"],
        )
        for r in rows
    ]


def steps_of(resolved: DataFrame, tables: Sequence[str]) -> list[CleaningStep]:
    """Steps of the named tables only."""
    return [s for s in to_steps(resolved) if s.table in set(tables)]

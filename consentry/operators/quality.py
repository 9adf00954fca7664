"""Model health from test results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consentry.functions.text import parse_test_id

HEALTHY, DEGRADED, QUARANTINED = 1, 2, 3
STATUS_NAMES = {QUARANTINED: "Quarantined", DEGRADED: "Degraded", HEALTHY: "Healthy"}


def result_rank(unique_id: Column, status: Column) -> Column:
    """Health a single result implies, or NULL; a passing test alone says nothing."""
    s, u = F.lower(status), F.lower(unique_id)
    model = u.startswith("model.") | u.startswith("seed.")
    test = u.startswith("test.")
    return (
        F.when((model | test) & s.isin("fail", "error"), QUARANTINED)
        .when((model | test) & (s == "warn"), DEGRADED)
        .when(model & s.isin("success", "pass"), HEALTHY)
    )


def model_name(unique_id: Column) -> Column:
    """Last segment of a model id, or the model a test id names."""
    last = F.substring_index(unique_id, ".", -1)
    is_test = F.lower(unique_id).startswith("test.")
    return F.when(is_test, parse_test_id(unique_id)["model"]).otherwise(last)


def model_health(results: DataFrame) -> DataFrame:
    """Per model its worst state and its numbers of failures and warnings.

    Quarantine is sticky, so the worst result decides whatever the order.
    """
    ranked = results.select(
        F.lower(model_name(F.col("unique_id"))).alias("model"),
        result_rank(F.col("unique_id"), F.col("status")).alias("rank"),
        F.coalesce("failures", F.lit(0)).alias("failures"),
    ).where(F.col("rank").isNotNull())
    worst = F.max("rank")
    return ranked.groupBy("model").agg(
        F.coalesce(*[F.when(worst == k, F.lit(v)) for k, v in STATUS_NAMES.items()]).alias("health"),
        F.count_if(F.col("rank") == QUARANTINED).alias("errors"),
        F.count_if(F.col("rank") == DEGRADED).alias("warnings"),
        F.sum("failures").alias("failed_rows"),
    )


def failures(results: DataFrame) -> DataFrame:
    """Failed and warning results with their model and column."""
    parsed = parse_test_id(F.col("unique_id"))
    is_test = F.lower("unique_id").startswith("test.")
    rank = result_rank(F.col("unique_id"), F.col("status"))
    kept = (rank == QUARANTINED) | ((rank == DEGRADED) & is_test)
    return results.where(kept).select(
        F.when(is_test, parsed["test_type"]).otherwise("model_execution").alias("test_name"),
        model_name(F.col("unique_id")).alias("model"),
        F.when(is_test, parsed["column_name"]).alias("column_name"),
        F.when(rank == QUARANTINED, "error").otherwise("warn").alias("severity"),
        "failures",
    )


def table_health(tables: DataFrame, health: DataFrame) -> DataFrame:
    """Health of catalog tables; a model called ``<table>_<rest>`` counts for the table too.

    Every prefix of a model name that ends at an underscore is a candidate, so the
    prefix match is an equi join.
    """
    words = F.split("model", "_")
    names = F.transform(
        F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), "_")
    )
    rank = F.coalesce(*[F.when(F.col("health") == v, F.lit(k)) for k, v in STATUS_NAMES.items()])
    candidates = health.select(F.explode(names).alias("_name"), rank.alias("rank")).groupBy("_name").agg(
        F.max("rank").alias("rank")
    )
    worst = F.coalesce("rank", F.lit(HEALTHY))
    return tables.join(candidates, F.lower("table_name") == F.col("_name"), "left").select(
        *tables.columns,
        F.coalesce(*[F.when(worst == k, F.lit(v)) for k, v in STATUS_NAMES.items()]).alias("health"),
    )


def refuse_quarantined(rows: DataFrame, health: DataFrame, key: str) -> DataFrame:
    """Rows of tables that are not quarantined."""
    blocked = health.where(F.col("health") == "Quarantined").select(F.col("model").alias(key))
    return rows.join(blocked, key, "left_anti")

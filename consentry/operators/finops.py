"""Cost records, spend and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Prices per thousand prompt tokens, completion tokens and milliseconds.
PROMPT_PRICE = "0.003"
COMPLETION_PRICE = "0.015"
COMPUTE_PRICE = "0.0001"
MONTHLY_BUDGET = 1000
WARNING_RATIO = 0.8


def billed_cost(prompt_tokens: Column, completion_tokens: Column, compute_ms: Column) -> Column:
    """Charge of one operation in exact decimals, rounded half-even to six places."""
    def part(n: Column, price: str) -> Column:
        return n.cast("decimal(18,0)") * F.lit(price).cast("decimal(9,6)") / F.lit(1000).cast("decimal(4,0)")

    total = (
        part(prompt_tokens, PROMPT_PRICE)
        + part(completion_tokens, COMPLETION_PRICE)
        + part(compute_ms, COMPUTE_PRICE)
    )
    return F.bround(total, 6).cast("decimal(18,6)")


def cost_records(usage: DataFrame) -> DataFrame:
    """FOCUS rows from (tenant, principal, operation, category, tokens, ms, at)."""
    tokens = F.col("prompt_tokens") + F.col("completion_tokens")
    cost = billed_cost(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("compute_ms"))
    start = F.timestamp_seconds(
        (F.unix_millis(F.col("at").cast("timestamp")) - F.greatest("compute_ms", F.lit(1))) / 1000.0
    )
    tags = F.create_map(
        F.lit("principal_id"), F.coalesce("principal", F.lit("anonymous")),
        F.lit("prompt_tokens"), F.col("prompt_tokens").cast("string"),
        F.lit("completion_tokens"), F.col("completion_tokens").cast("string"),
        F.lit("compute_ms"), F.col("compute_ms").cast("string"),
    )
    if "tags" in usage.columns:
        own = F.coalesce("tags", F.create_map().cast("map<string,string>"))
        tags = F.map_concat(F.map_filter(tags, lambda k, _: ~F.map_contains_key(own, k)), own)
    tenant = F.when(F.trim(F.coalesce("tenant", F.lit(""))) == "", "default").otherwise(F.col("tenant"))
    return usage.select(
        start.alias("ChargePeriodStart"),
        F.col("at").alias("ChargePeriodEnd"),
        cost.alias("BilledCost"),
        cost.alias("EffectiveCost"),
        F.lit("EUR").alias("Currency"),
        F.when(tokens > 0, tokens).otherwise(F.col("compute_ms")).alias("ConsumedQuantity"),
        F.when(tokens > 0, "Tokens").otherwise("Milliseconds").alias("ConsumedUnit"),
        tenant.alias("SubAccountId"),
        F.coalesce("operation", F.lit("unspecified_operation")).alias("ResourceId"),
        F.lit("DataGateway").alias("ServiceName"),
        F.coalesce(
            "category", F.when(tokens > 0, "AI-Inference").otherwise("DatabaseCompute")
        ).alias("PricingCategory"),
        tags.alias("Tags"),
    )


def budget_status(records: DataFrame, budgets: DataFrame, default_budget: float = MONTHLY_BUDGET) -> DataFrame:
    """Spend per tenant against its budget; a budget of 0 means unlimited."""
    spend = records.groupBy("SubAccountId").agg(F.sum("BilledCost").alias("spend"))
    own = budgets.groupBy(F.lower("tenant").alias("_t")).agg(F.max("budget").alias("_b"))
    limit = F.coalesce(F.col("_b").cast("double"), F.lit(float(default_budget)))
    amount = F.col("spend").cast("double")
    status = (
        F.when(limit <= 0, "UNLIMITED")
        .when(amount >= limit, "EXCEEDED")
        .when(amount >= limit * WARNING_RATIO, "WARNING")
        .otherwise("OK")
    )
    return spend.join(own, F.lower("SubAccountId") == F.col("_t"), "left").select(
        F.col("SubAccountId").alias("tenant"), amount.alias("spend"), limit.alias("budget"), status.alias("status")
    )


def records_in_period(records: DataFrame, start, end, tenant: str | None = None) -> DataFrame:
    """Records whose period ends inside [start, end]."""
    ends = F.col("ChargePeriodEnd")
    found = records.where((ends >= F.lit(start)) & (ends <= F.lit(end)))
    return found.where(F.lower("SubAccountId") == tenant.lower()) if tenant else found

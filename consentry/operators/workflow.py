"""Governance workflows: approvers, requests, expiry, activation, tenant backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consentry.model import LEGACY_TENANT


# Roles whose members approve everywhere.
ADMIN_ROLES = ("GovernanceAdmin", "ClusterAdmin")


def admin_members(roles: DataFrame, members: DataFrame) -> DataFrame:
    admins = roles.where(F.col("role_name").isin(*ADMIN_ROLES)).select("role_id")
    return members.join(admins, "role_id", "left_semi").select("member_sid").distinct()


def approvers(
    owners: DataFrame, table_owners: DataFrame, delegations: DataFrame, admins: DataFrame, now: Column
) -> DataFrame:
    """(table_id, approver_sid): active owners, delegates in time, and admins (no table)."""
    active = owners.where("is_active").select("owner_id", "owner_sid")
    live = delegations.where((F.col("valid_from") <= now) & (now < F.col("valid_to")))
    live = live.select("owner_id", "delegate_sid").distinct()
    by_owner = table_owners.join(active, "owner_id").select(
        "table_id", F.col("owner_sid").alias("approver_sid")
    )
    by_delegate = table_owners.join(live, "owner_id").select(
        "table_id", F.col("delegate_sid").alias("approver_sid")
    )
    everywhere = F.lit(None).cast(dict(table_owners.dtypes)["table_id"])
    by_role = admins.select(everywhere.alias("table_id"), F.col("member_sid").alias("approver_sid"))
    return by_owner.union(by_delegate).union(by_role).distinct()


def pending_for_approver(
    requests: DataFrame, tables: DataFrame, authorised: DataFrame, approver: str | None = None
) -> DataFrame:
    """Open requests on tables the approver owns or stands in for."""
    mine = authorised.where(F.col("table_id").isNotNull())
    if approver is not None:
        mine = mine.where(F.col("approver_sid") == approver)
    open_requests = requests.where(F.col("status").isin("PENDING", "PENDING_SECOND_APPROVAL"))
    return open_requests.join(mine.select("table_id"), "table_id", "left_semi").join(
        tables.select("table_id", "domain"), "table_id", "left"
    )


def expiring(
    consents: DataFrame, pending: DataFrame, triggered: DataFrame, now: Column, warning_days: int = 3
) -> DataFrame:
    """Consents to recertify: they end within the window, no ticket is open and none was
    triggered in the last 24 hours."""
    limit = now + F.expr(f"INTERVAL '{warning_days}' DAY")
    due = consents.where(
        ~F.col("is_revoked") & (F.col("valid_to") > now) & (F.col("valid_to") <= limit)
    )
    recent = triggered.where(F.col("triggered_at") > now - F.expr("INTERVAL '24' HOUR"))
    micros = F.unix_micros(F.col("valid_to").cast("timestamp")) - F.unix_micros(now.cast("timestamp"))
    hours = F.greatest(F.lit(1).cast("long"), F.floor(micros / F.lit(3600000000)))
    return (
        due.join(pending.select("consent_id"), "consent_id", "left_anti")
        .join(recent.select("consent_id"), "consent_id", "left_anti")
        .withColumn("hours_left", hours)
    )


def extended_expiry(valid_to: Column, now: Column, days: int) -> Column:
    return F.greatest(valid_to, now) + F.expr(f"INTERVAL '{days}' DAY")


def activate(requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(new consents, requests with their new status).

    A new consent has no column rules and no row filter.
    """
    can = F.col("status").isin("PENDING", "PENDING_SECOND_APPROVAL", "PENDING_EXTERNAL_APPROVAL")
    role = F.upper("grantee_type") == "ROLE"
    consents = requests.where(can).select(
        F.col("request_id").alias("consent_request_id"),
        "table_id",
        F.lit("ALLOW").alias("effect"),
        "grantee_type",
        F.when(~role, F.col("grantee")).alias("grantee_sid"),
        F.when(role, F.col("grantee")).alias("role_name"),
        now.alias("valid_from"),
        F.col("requested_valid_to").alias("valid_to"),
        "tenant_id",
    )
    updated = requests.withColumn("status", F.when(can, "ACTIVE").otherwise(F.col("status")))
    return consents, updated


def decision_report(requests: DataFrame) -> DataFrame:
    """Requests per requester, table and status."""
    return requests.groupBy("requester_sid", "table_id", "status").agg(
        F.count("*").alias("requests"), F.max("requested_at").alias("last_requested")
    )


def needs_tenant(tenant: Column) -> Column:
    return F.trim(F.coalesce(tenant, F.lit(""))).isin("", "default", "legacy-default")


def backfill_tenant(df: DataFrame, column: str = "tenant_id", tenant: str = LEGACY_TENANT) -> DataFrame:
    return df.withColumn(column, F.when(needs_tenant(F.col(column)), tenant).otherwise(F.col(column)))


def unmigrated(df: DataFrame, column: str = "tenant_id") -> DataFrame:
    return df.agg(F.count_if(needs_tenant(F.col(column))).alias("unmigrated"))

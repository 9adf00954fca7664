"""Governance model: driver-side values and the schemas of the governance tables."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

# Column access levels; ordered, so max/min work on them.
DENY, MASK, CLEAR = 0, 1, 2

LEGACY_TENANT = "legacy-single-tenant"


@dataclass(frozen=True)
class Subject:
    sid: str
    tenant: str | None = None
    groups: frozenset[str] = frozenset()
    roles: frozenset[str] = frozenset()
    attributes: dict[str, str] = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class MaskRule:
    rule_type: str = "REDACT"
    pattern: str | None = None
    replacement: str | None = None
    key_id: str | None = None


@dataclass(frozen=True)
class Column:
    name: str
    data_type: str = "string"
    sensitive: bool = False
    rule: MaskRule | None = None
    tags: tuple[str, ...] = ()


@dataclass(frozen=True)
class TableMeta:
    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...] = ()
    tenant_column: str | None = "tenant_id"
    sensitivity: str = "NORMAL"
    four_eyes: bool = False

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name.lower() == name.lower()), None)


@dataclass(frozen=True)
class Hop:
    """One further inner join of a correlated filter."""

    table: str
    alias: str
    left: str
    right: str


@dataclass(frozen=True)
class Condition:
    """One row-filter condition. Conditions of one group are AND-ed, groups are OR-ed."""

    column: str | None = None
    op: str = "EQ"
    value: Any = None
    group: int = 0
    user_attribute: str | None = None
    # Correlated form: EXISTS (dependent rows joined on foreign key = primary key)
    dependent: str | None = None
    foreign_key: str | None = None
    primary_key: str | None = None
    predicate: Any = None
    hops: tuple[Hop, ...] = ()
    event_time: str | None = None
    valid_from: str | None = None
    valid_to: str | None = None


@dataclass(frozen=True)
class Consent:
    table: str
    effect: str = "ALLOW"
    grantee_type: str = "USER"
    grantee: str | None = None
    role: str | None = None
    valid_from: dt.datetime = dt.datetime(1970, 1, 1)
    valid_to: dt.datetime = dt.datetime(9999, 12, 31)
    revoked: bool = False
    tenant: str | None = None
    columns: dict[str, int] = field(default_factory=dict, hash=False)
    filters: tuple[Condition, ...] = ()

    def active(self, now: dt.datetime) -> bool:
        return not self.revoked and self.valid_from <= now < self.valid_to

    def violations(self) -> list[str]:
        found = []
        if self.valid_to <= self.valid_from:
            found.append("valid_to must be after valid_from")
        if self.grantee_type.upper() == "ROLE":
            if not self.role:
                found.append("a role grant needs a role")
        elif not self.grantee:
            found.append("a grant needs a grantee")
        return found


def table_key(name: str) -> str:
    """Canonical ``domain.schema.table``, lower case; two-part names get ``default``."""
    parts = [p for p in name.strip().split(".") if p]
    if len(parts) == 2:
        parts = ["default", *parts]
    if len(parts) != 3 or not all(re.fullmatch(r"[A-Za-z_][A-Za-z0-9_\-]*", p) for p in parts):
        raise ValueError(f"not a table identifier: {name!r}")
    return ".".join(parts).lower()


def catalog_type_to_spark(text: str | None) -> T.DataType:
    """Catalog types are free text; the first matching fragment decides, in this order."""
    t = (text or "").lower()

    def has(*fragments: str) -> bool:
        return any(f in t for f in fragments)

    if has("binary", "blob", "image", "rowversion") or t.strip() == "timestamp":
        return T.BinaryType()
    if has("geo"):
        return T.StringType()
    if has("bigint", "long"):
        return T.LongType()
    if has("int"):
        return T.IntegerType()
    if has("decimal", "numeric", "money"):
        return T.DecimalType(38, 18)
    if has("float", "double", "real"):
        return T.DoubleType()
    if has("bool"):
        return T.BooleanType()
    if has("date", "time"):
        return T.TimestampType()
    return T.StringType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


S, B, I, L, TS = T.StringType(), T.BooleanType(), T.IntegerType(), T.LongType(), T.TimestampType()

# The columns of the governance tables.
GOVERNANCE_SCHEMAS: dict[str, T.StructType] = {
    "tables": _struct(
        id=S, source_type=S, source_name=S, schema_name=S, table_name=S, display_name=S,
        description=S, long_description=S, doc_source=S, sensitivity=S,
        requires_four_eyes=B, is_active=B, data_source_type=I, http_endpoint_json=S, plugin_name=S,
    ),
    "table_columns": _struct(
        id=S, table_id=S, column_name=S, data_type=S, is_sensitive=B, description=S,
        long_description=S, doc_source=S, meta_json=T.MapType(S, S),
    ),
    "column_masking_rules": _struct(
        id=S, table_column_id=S, rule_type=S, pattern_or_format=S, replacement=S, hmac_key_id=S,
    ),
    "data_owners": _struct(id=S, ad_sid=S, ad_account=S, display_name=S, email=S, is_active=B),
    "table_owners": _struct(id=S, table_id=S, data_owner_id=S, owner_role=S),
    "data_owner_delegations": _struct(
        id=S, data_owner_id=S, delegate_sid=S, valid_from=TS, valid_to=TS, reason=S
    ),
    "roles": _struct(id=S, role_name=S, description=S),
    "role_members": _struct(id=S, role_id=S, member_type=S, member_sid=S),
    "consents": _struct(
        id=S, table_id=S, consent_request_id=S, effect=S, grantee_type=S, grantee_sid=S,
        role_id=S, role_name=S, valid_from=TS, valid_to=TS, is_revoked=B, revoked_by_sid=S,
        revoked_at=TS, revoke_reason=S, tenant_id=S,
    ),
    "consent_column_rules": _struct(
        id=S, consent_id=S, table_column_id=S, column_name=S, access_level=I
    ),
    "consent_row_filters": _struct(
        id=S, consent_id=S, filter_group=I, table_column_id=S, column_name=S, operator=S,
        value_type=S, value_json=S, value_source=S, user_attribute=S, filter_type=I,
        dependent_table=S, dependent_table_alias=S, foreign_key_column=S, primary_key_column=S,
        subquery_predicate_json=S, target_temporal_column=S, dependent_valid_from_column=S,
        dependent_valid_to_column=S, target_table_alias=S,
        additional_hops_json=T.ArrayType(_struct(table=S, alias=S, left=S, right=S)),
    ),
    "policy_epochs": _struct(
        table_id=S, domain=S, schema_name=S, table_name=S, epoch=L, updated_at=TS
    ),
    "audit_log_entries": _struct(
        id=S, occurred_at=TS, event_type=S, actor_sid=S, target_table=S, target_column=S,
        decision=S, trace_id=S, details_json=S, prev_hash=S, entry_hash=S, tenant_id=S, seq=L,
    ),
    "consent_requests": _struct(
        id=S, table_id=S, requester_sid=S, requested_grantee_type=S, requested_grantee_ref=S,
        business_justification=S, status=S, requested_at=TS, requested_valid_to=TS,
        itsm_ticket_id=S, tenant_id=S,
    ),
    "approval_steps": _struct(
        id=S, consent_request_id=S, step_number=I, approver_sid=S, decision=S,
        rejection_reason=S, decided_at=TS,
    ),
    "table_relations": _struct(
        id=S, parent_table_id=S, child_table_id=S, relation_name=S, join_key_parent=S,
        join_key_child=S, cardinality=S,
    ),
    "itsm_outbox": _struct(
        id=S, request_id=S, tenant_id=S, event_type=S, payload_json=S, preferred_system=S,
        status=I, retry_count=I, max_retries=I, created_at=TS, next_retry_at=TS, last_error=S,
    ),
    "policy_rules": _struct(sub=S, tenant=S, obj=S, act=S, sub_rule=S, eft=S, rls_filter=S),
}

"""Catalog entries and consents of one request, read from the governance tables."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from consentry.model import Column, Condition, Consent, Hop, MaskRule, Subject, TableMeta

SIMPLE, CORRELATED, SET = 0, 1, 2


def _named(tables: DataFrame) -> DataFrame:
    return tables.withColumn("name", F.lower(F.concat_ws(".", "source_name", "schema_name", "table_name")))


def table_metas(
    catalog: Mapping[str, DataFrame], names: Sequence[str], keys: Mapping[str, Sequence[str]] | None = None
) -> dict[str, TableMeta]:
    """Metadata of the named, active tables. Only the columns of those tables are read."""
    wanted = [n.lower() for n in names]
    tables = _named(catalog["tables"]).where(F.col("name").isin(*wanted) & F.col("is_active"))
    columns = catalog["table_columns"].withColumnRenamed("id", "column_id")
    rules = catalog["column_masking_rules"].select(
        F.col("table_column_id").alias("column_id"), "rule_type", "pattern_or_format", "replacement", "hmac_key_id"
    )
    rows = (
        tables.select(F.col("id").alias("table_id"), "name", "sensitivity", "requires_four_eyes")
        .join(columns, "table_id")
        .join(rules, "column_id", "left")
        .orderBy("name", "column_id")
        .collect()
    )
    found: dict[str, TableMeta] = {}
    for name in dict.fromkeys(r["name"] for r in rows):
        mine = [r for r in rows if r["name"] == name]
        found[name] = TableMeta(
            name,
            tuple(
                Column(
                    r["column_name"],
                    r["data_type"],
                    bool(r["is_sensitive"]),
                    MaskRule(r["rule_type"], r["pattern_or_format"], r["replacement"], r["hmac_key_id"])
                    if r["rule_type"]
                    else None,
                )
                for r in mine
            ),
            tuple((keys or {}).get(name, ())),
            sensitivity=mine[0]["sensitivity"] or "NORMAL",
            four_eyes=bool(mine[0]["requires_four_eyes"]),
        )
    return found


def _condition(f) -> Condition:
    if f["filter_type"] == CORRELATED:
        alias = f["dependent_table_alias"] or "dep"

        def inside(reference: str, owner: str) -> str:
            head, _, tail = reference.rpartition(".")
            return f"{'dep' if head.lower() == alias.lower() else head or owner}.{tail}"

        hops, before = [], "dep"
        for h in f["additional_hops_json"] or []:
            hops.append(Hop(h["table"].lower(), h["alias"], inside(h["left"], before), inside(h["right"], h["alias"])))
            before = h["alias"]
        return Condition(
            group=f["filter_group"],
            dependent=f["dependent_table"].lower(),
            foreign_key=f["foreign_key_column"],
            primary_key=f["primary_key_column"],
            predicate=json.loads(f["subquery_predicate_json"]) if f["subquery_predicate_json"] else None,
            hops=tuple(hops),
            event_time=f["target_temporal_column"],
            valid_from=f["dependent_valid_from_column"],
            valid_to=f["dependent_valid_to_column"],
        )
    value = json.loads(f["value_json"]) if f["value_json"] else None
    if f["filter_type"] == SET:
        values = value if isinstance(value, list) else [] if value is None else [value]
        return Condition(f["column_name"], "IN", values, f["filter_group"])
    attribute = f["user_attribute"] if (f["value_source"] or "").upper() == "USER_ATTRIBUTE" else None
    if (f["value_source"] or "").upper() == "USER_ATTRIBUTE" and not attribute:
        return Condition(f["column_name"], "IN", [], f["filter_group"])
    return Condition(f["column_name"], f["operator"], value, f["filter_group"], attribute)


def subject_consents(
    catalog: Mapping[str, DataFrame],
    subject: Subject,
    now: dt.datetime,
    tables: Sequence[str],
) -> list[Consent]:
    """Consents that count for one subject on the named tables.

    The tables are filtered where they lie; what reaches the driver is the handful of
    consents of this subject.
    """
    wanted = _named(catalog["tables"]).where(F.col("name").isin(*[t.lower() for t in tables]))
    at = F.lit(now).cast("timestamp")
    kind = F.upper("grantee_type")
    mine = (
        (kind.isin("USER", "SERVICE_PRINCIPAL") & (F.col("grantee_sid") == subject.sid))
        | ((kind == "GROUP") & F.col("grantee_sid").isin(*subject.groups))
        | (
            (kind == "ROLE")
            & (F.col("role_name").isin(*subject.roles) | F.col("role_id").isin(*subject.roles))
        )
    )
    live = (
        catalog["consents"]
        .where(mine & ~F.col("is_revoked") & (F.col("valid_from") <= at) & (at < F.col("valid_to")))
        .join(wanted.select(F.col("id").alias("table_id"), "name"), "table_id")
    )
    if subject.tenant:
        live = live.where(F.col("tenant_id") == subject.tenant)
    chosen = live.select(F.col("id").alias("consent_id"))
    rules = catalog["consent_column_rules"].join(chosen, "consent_id", "left_semi").collect()
    filters = catalog["consent_row_filters"].join(chosen, "consent_id", "left_semi").collect()
    found = []
    for c in live.orderBy("id").collect():
        found.append(
            Consent(
                c["name"],
                c["effect"].upper(),
                c["grantee_type"].upper(),
                c["grantee_sid"],
                c["role_name"] if c["role_name"] in subject.roles else c["role_id"],
                c["valid_from"],
                c["valid_to"],
                False,
                c["tenant_id"],
                {r["column_name"]: r["access_level"] for r in rules if r["consent_id"] == c["id"]},
                tuple(_condition(f) for f in filters if f["consent_id"] == c["id"]),
            )
        )
    return found

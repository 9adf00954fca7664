"""Catalog jobs: metadata assembly, merges, schema diffs, contracts and search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from consentry.operators.ordering import numbered
from consentry.session import durable

# Documentation sources, strongest first.
DOCUMENTATION_ORDER = ("manual", "datacatalog", "dbt", "openapi", "database", "default")


def table_metadata(tables: DataFrame, columns: DataFrame, rules: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per table with its columns, masks and primary key nested.

    A table's columns are bounded by its schema, so the lists are small.
    """
    ruled = columns.join(rules, ["table_id", "column_name"], "left")
    item = F.struct("column_name", "data_type", "is_sensitive", "rule_type")
    listed = ruled.groupBy("table_id").agg(
        F.array_sort(F.collect_list(item)).alias("columns"),
    )
    keyed = keys.groupBy("table_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "column_name"))),
            lambda x: x["column_name"],
        ).alias("primary_key")
    )
    return tables.join(listed, "table_id", "left").join(keyed, "table_id", "left").withColumn(
        "columns", F.coalesce("columns", F.array())
    ).withColumn("primary_key", F.coalesce("primary_key", F.array()))


def search(
    tables: DataFrame, term: str | None = None, domain: str | None = None, skip: int = 0, take: int | None = None
) -> DataFrame:
    """Case-insensitive contains over names, texts and column names, in the order of the ids; ``take`` asks for a page."""
    if domain:
        tables = tables.where(F.lower("domain") == domain.lower())
    if term and term.strip():
        needle = F.lit(term.strip().lower())
        texts = [c for c in ("table_name", "display_name", "description") if c in tables.columns]
        hits = [F.coalesce(F.lower(c).contains(needle), F.lit(False)) for c in texts]
        if "columns" in tables.columns:
            hits.append(F.exists("columns", lambda c: F.lower(c["column_name"]).contains(needle)))
        matched = hits[0]
        for h in hits[1:]:
            matched = matched | h
        tables = tables.where(matched)
    found = tables.orderBy("table_id")
    found = found.offset(skip) if skip > 0 else found
    return found if take is None else found.limit(max(1, take))


def sensitivity_rank(label: Column) -> Column:
    """Rank of a label; an unknown label counts as HIGH."""
    name = F.upper(F.trim(label))
    return (
        F.when(name.isin("LOW", "PUBLIC"), 0)
        .when(name.isin("NORMAL", "INTERNAL"), 1)
        .when(name == "MEDIUM", 2)
        .when(name == "CONFIDENTIAL", 3)
        .when(name == "HIGH", 4)
        .when(name.isin("RESTRICTED", "SECRET"), 5)
        .otherwise(4)
    )


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def stricter_sensitivity(existing: Column, incoming: Column) -> Column:
    return (
        F.when(_blank(existing) & _blank(incoming), "NORMAL")
        .when(_blank(existing), incoming)
        .when(_blank(incoming), existing)
        .when(sensitivity_rank(incoming) > sensitivity_rank(existing), incoming)
        .otherwise(existing)
    )


def mask_strength(rule: Column) -> Column:
    name = F.upper(F.trim(rule))
    return (
        F.when(rule.isNull(), 0)
        .when(name == "NULLIFY", 4)
        .when(name == "REDACT", 3)
        .when(name.isin("HMAC", "HMAC_SHA256"), 2)
        .otherwise(1)
    )


def merge_tables(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge that only tightens: four-eyes OR, active AND, stricter label."""
    e, i = existing.alias("e"), incoming.alias("i")
    both = e.join(i, F.col("e.table_id") == F.col("i.table_id"), "full_outer")
    new, old = F.col("e.table_id").isNull(), F.col("i.table_id").isNull()
    return both.select(
        F.coalesce("e.table_id", "i.table_id").alias("table_id"),
        F.when(new, F.col("i.sensitivity"))
        .when(old, F.col("e.sensitivity"))
        .otherwise(stricter_sensitivity(F.col("e.sensitivity"), F.col("i.sensitivity")))
        .alias("sensitivity"),
        (F.coalesce("e.four_eyes", F.lit(False)) | F.coalesce("i.four_eyes", F.lit(False))).alias("four_eyes"),
        (F.coalesce("e.is_active", F.lit(True)) & F.coalesce("i.is_active", F.lit(True))).alias("is_active"),
    )


def merge_columns(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Columns of both snapshots; vanished ones stay, sensitivity and masks only grow."""
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("_name", F.lower("column_name"))

    e, i = keyed(existing).alias("e"), keyed(incoming).alias("i")
    on = (F.col("e.table_id") == F.col("i.table_id")) & (F.col("e._name") == F.col("i._name"))
    stronger = mask_strength(F.col("i.rule_type")) > mask_strength(F.col("e.rule_type"))
    return e.join(i, on, "full_outer").select(
        F.coalesce("i.table_id", "e.table_id").alias("table_id"),
        F.coalesce("i.column_name", "e.column_name").alias("column_name"),
        F.when(_blank(F.col("i.data_type")), F.col("e.data_type"))
        .otherwise(F.col("i.data_type"))
        .alias("data_type"),
        (
            F.coalesce("e.is_sensitive", F.lit(False)) | F.coalesce("i.is_sensitive", F.lit(False))
        ).alias("is_sensitive"),
        F.when(stronger, F.col("i.rule_type")).otherwise(F.col("e.rule_type")).alias("rule_type"),
    )


def documentation_rank(source: Column) -> Column:
    order = F.array(*[F.lit(s) for s in DOCUMENTATION_ORDER])
    at = F.array_position(order, F.lower(F.coalesce(source, F.lit("default"))))
    return F.when(at == 0, F.lit(len(DOCUMENTATION_ORDER) + 1).cast("long")).otherwise(at)


def best_documentation(docs: DataFrame, key: Sequence[str]) -> DataFrame:
    """Strongest source per key; of equal sources the latest entry overwrites."""
    order = F.struct(documentation_rank(F.col("doc_source")), (-F.col("version")))
    return docs.groupBy(*key).agg(
        F.min_by("description", order).alias("description"),
        F.min_by("doc_source", order).alias("doc_source"),
    )


def schema_elements(schema: T.StructType, type_name: str) -> list[tuple]:
    """Elements of a Spark schema as rows for ``schema_diff``."""
    rows = [("TYPE", type_name, None, "OBJECT", False, False)]
    for f in schema.fields:
        deprecated = "deprecated" in (f.metadata or {})
        rows.append(
            ("FIELD", f"{type_name}.{f.name}", type_name, f.dataType.simpleString(), not f.nullable, deprecated)
        )
    return rows


ELEMENT_SCHEMA = (
    "element string, path string, parent string, kind string, required boolean, deprecated boolean"
)


def schema_diff(base: DataFrame, target: DataFrame) -> DataFrame:
    """(change_type, code, path) between two sets of schema elements.

    Elements: TYPE, FIELD, ARGUMENT, ENUM_VALUE, INPUT_FIELD, UNION_MEMBER. One full outer
    join on (element, path). Members of a removed or re-kinded type are not reported one
    by one, nor are members of an added type or arguments of an added or removed field.
    """
    b, t = base.alias("b"), target.alias("t")
    on = (F.col("b.element") == F.col("t.element")) & (F.col("b.path") == F.col("t.path"))
    both = b.join(t, on, "full_outer").select(
        F.coalesce("b.element", "t.element").alias("element"),
        F.coalesce("b.path", "t.path").alias("path"),
        F.coalesce("b.parent", "t.parent").alias("parent"),
        F.col("b.path").isNull().alias("added"),
        F.col("t.path").isNull().alias("removed"),
        (F.col("b.kind") != F.col("t.kind")).alias("retyped"),
        (~F.col("b.deprecated") & F.col("t.deprecated")).alias("newly_deprecated"),
        F.col("t.required").alias("required"),
    )
    e = F.col("element")
    added, removed, retyped = F.col("added"), F.col("removed"), F.coalesce("retyped", F.lit(False))
    # One element may raise two changes: a new type and a deprecation.
    first = (
        F.when((e == "TYPE") & removed, "Breaking:TYPE_REMOVED")
        .when((e == "TYPE") & retyped, "Breaking:TYPE_KIND_CHANGED")
        .when((e == "TYPE") & added, "Safe:TYPE_ADDED")
        .when((e == "FIELD") & removed, "Breaking:FIELD_REMOVED")
        .when((e == "FIELD") & retyped, "Breaking:FIELD_TYPE_CHANGED")
        .when((e == "FIELD") & added, "Safe:FIELD_ADDED")
        .when((e == "ARGUMENT") & removed, "Breaking:FIELD_ARGUMENT_REMOVED")
        .when((e == "ARGUMENT") & retyped, "Breaking:FIELD_ARGUMENT_TYPE_CHANGED")
        .when((e == "ARGUMENT") & added & F.col("required"), "Breaking:REQUIRED_FIELD_ARGUMENT_ADDED")
        .when((e == "ARGUMENT") & added, "Safe:FIELD_ARGUMENT_ADDED")
        .when((e == "ENUM_VALUE") & removed, "Breaking:ENUM_VALUE_REMOVED")
        .when((e == "ENUM_VALUE") & added, "Dangerous:ENUM_VALUE_ADDED")
        .when((e == "INPUT_FIELD") & removed, "Breaking:INPUT_FIELD_REMOVED")
        .when((e == "INPUT_FIELD") & retyped, "Breaking:INPUT_FIELD_TYPE_CHANGED")
        .when((e == "INPUT_FIELD") & added & F.col("required"), "Breaking:REQUIRED_INPUT_FIELD_ADDED")
        .when((e == "INPUT_FIELD") & added, "Safe:OPTIONAL_INPUT_FIELD_ADDED")
        .when((e == "UNION_MEMBER") & removed, "Breaking:UNION_MEMBER_REMOVED")
        .when((e == "UNION_MEMBER") & added, "Dangerous:UNION_MEMBER_ADDED")
    )
    second = F.when(
        (e == "FIELD") & F.coalesce("newly_deprecated", F.lit(False)), "Dangerous:FIELD_DEPRECATED"
    )
    changes = both.select(
        "element", "path", "parent", F.explode(F.array_compact(F.array(first, second))).alias("change")
    )
    # Read three times below; the comparison itself runs once.
    changes = durable(changes, "changes")
    # A change inside a parent that was itself added, removed or re-kinded is implied.
    settled = (
        changes.where(
            F.col("change").isin(
                "Breaking:TYPE_REMOVED", "Breaking:TYPE_KIND_CHANGED", "Safe:TYPE_ADDED",
                "Breaking:FIELD_REMOVED", "Safe:FIELD_ADDED",
            )
        )
        .select(F.col("path").alias("parent"))
        .distinct()
    )
    # An argument's type is two levels up; its field is implied, so look at both.
    owner = F.substring_index("parent", ".", 1)
    kept = changes.join(settled, "parent", "left_anti").withColumn("_type", owner)
    kept = kept.join(settled.select(F.col("parent").alias("_type")), "_type", "left_anti")
    parts = F.split("change", ":")
    return kept.select(parts[0].alias("change_type"), parts[1].alias("code"), "path")


def change_counts(changes: DataFrame) -> DataFrame:
    kind = F.col("change_type")
    return changes.agg(
        F.count_if(kind == "Breaking").alias("breaking"),
        F.count_if(kind == "Dangerous").alias("dangerous"),
        F.count_if(kind == "Safe").alias("safe"),
        (F.count_if(kind == "Breaking") > 0).alias("has_breaking"),
    )


def contract_violations(contract: DataFrame, actual: DataFrame) -> DataFrame:
    """Columns a contract promises that are gone or have another type."""
    actual = actual.select(
        "table_id", F.lower("column_name").alias("_name"), F.lower("data_type").alias("_type")
    )
    promised = contract.withColumn("_name", F.lower("column_name"))
    joined = promised.join(actual, ["table_id", "_name"], "left")
    problem = F.when(F.col("_type").isNull(), "COLUMN_DROPPED").when(
        F.col("_type") != F.lower("data_type"), "TYPE_MISMATCH"
    )
    return joined.select("table_id", "column_name", problem.alias("problem")).where(
        F.col("problem").isNotNull()
    )


def contract_columns(
    columns: DataFrame,
    included: Sequence[str] = (),
    excluded: Sequence[str] = (),
    drop_inaccessible: bool = True,
) -> DataFrame:
    """Columns a contract exposes; tables left without columns vanish with them."""
    kept = columns
    if drop_inaccessible:
        kept = kept.where(~F.coalesce("inaccessible", F.lit(False)))
    if excluded:
        kept = kept.where(~F.arrays_overlap("tags", F.array(*[F.lit(t) for t in excluded])))
    if included:
        kept = kept.where(
            (F.size("tags") == 0)
            | F.arrays_overlap("tags", F.array(*[F.lit(t) for t in included]))
        )
    return kept


def schema_versions(registrations: DataFrame) -> DataFrame:
    """Version labels per service, and which one is the latest active."""
    n = numbered(registrations, ["service"], ["registered_at", "schema_id"], "n")
    newest = n.groupBy("service").agg(F.max(F.when(F.col("active"), F.col("n"))).alias("_newest"))
    return n.join(newest, "service").select(
        "service",
        "schema_id",
        F.concat(F.lit("v"), F.col("n").cast("string"), F.lit(".0.0")).alias("version"),
        F.coalesce(F.col("n") == F.col("_newest"), F.lit(False)).alias("latest"),
    )


def golden_queries(queries: DataFrame, domain: str | None = None, table: str | None = None) -> DataFrame:
    """Approved example queries of a domain or table, at most 20."""
    if domain:
        queries = queries.where(F.lower("domain") == domain.lower())
    if table:
        queries = queries.where(F.lower("table_name") == table.lower())
    return queries.orderBy("query_id").limit(20)

"""Catalog assembly, merges, schema diffs, contracts, model health, documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from consentry.operators import catalog as K
from consentry.operators import quality as Q
from consentry.queries.base import Frames, query
from consentry.session import scratch_path
from consentry.sources import documents as D
from consentry.sources.tables import governance_table, write_governance_table


def _rules(t: Frames):
    return t.catalog_columns.where("is_sensitive").select(
        "table_id",
        "column_name",
        F.when(F.col("column_name") == "Email", "MASK_EMAIL").otherwise("REDACT").alias("rule_type"),
    )


@query(
    "s7_table_metadata",
    """WITH c AS (SELECT table_id, count(*) AS n, string_agg(column_name || ':' || data_type || ':'
            || CASE WHEN is_sensitive THEN CASE WHEN column_name = 'Email' THEN 'MASK_EMAIL' ELSE 'REDACT' END ELSE '-' END,
            ',' ORDER BY column_name) AS shape FROM catalog_columns GROUP BY table_id),
          k AS (SELECT table_id, string_agg(column_name, ',' ORDER BY column_name) AS pk FROM catalog_columns
                WHERE column_name IN ('c6', 'c7') GROUP BY table_id)
       SELECT t.table_id, t.table_name, coalesce(n, 0) AS columns, coalesce(shape, '') AS shape,
              coalesce(pk, '') AS primary_key FROM catalog_tables t LEFT JOIN c ON c.table_id = t.table_id
         LEFT JOIN k ON k.table_id = t.table_id""",
)
def metadata(t: Frames):
    keys = t.catalog_columns.where("column_name IN ('c6', 'c7')").select(
        "table_id", "column_name", F.substr("column_name", F.lit(2)).cast("int").alias("position")
    )
    rows = K.table_metadata(t.catalog_tables, t.catalog_columns, _rules(t), keys)
    shape = F.transform(
        "columns",
        lambda c: F.concat_ws(":", c["column_name"], c["data_type"], F.coalesce(c["rule_type"], F.lit("-"))),
    )
    return rows.select(
        "table_id",
        "table_name",
        F.size("columns").cast("long").alias("columns"),
        F.array_join(shape, ",").alias("shape"),
        F.array_join("primary_key", ",").alias("primary_key"),
    )


@query(
    "s6_governance_catalog",
    """SELECT 'tables' AS name, count(*) AS n FROM catalog_tables
       UNION ALL SELECT 'consents', count(*) FROM consents
       UNION ALL SELECT 'consent_column_rules', count(*) FROM consent_rules""",
)
def governance_catalog(t: Frames):
    root = scratch_path(t.spark, "catalog")
    write_governance_table(
        t.catalog_tables.withColumnRenamed("table_id", "id").withColumnRenamed("four_eyes", "requires_four_eyes"),
        root, "tables",
    )
    write_governance_table(t.consents.withColumnRenamed("consent_id", "id"), root, "consents")
    write_governance_table(t.consent_rules, root, "consent_column_rules")
    counts = [
        governance_table(t.spark, root, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
        for n in ("tables", "consents", "consent_column_rules")
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


INCOMING_TABLES = """SELECT table_id + 500 AS table_id, CASE sensitivity WHEN 'LOW' THEN 'SECRET' WHEN 'ART9' THEN 'PUBLIC'
    ELSE sensitivity END AS sensitivity, table_id % 3 = 0 AS four_eyes, table_id % 4 > 0 AS is_active
    FROM {catalog_tables}"""
RANK = """CASE WHEN {x} IN ('LOW', 'PUBLIC') THEN 0 WHEN {x} IN ('NORMAL', 'INTERNAL') THEN 1 WHEN {x} = 'MEDIUM' THEN 2
    WHEN {x} = 'CONFIDENTIAL' THEN 3 WHEN {x} = 'HIGH' THEN 4 WHEN {x} IN ('RESTRICTED', 'SECRET') THEN 5 ELSE 4 END"""


@query(
    "u4_merge_tables",
    f"""WITH i AS ({INCOMING_TABLES.format(catalog_tables="catalog_tables")}), e AS (SELECT * FROM catalog_tables)
        SELECT coalesce(e.table_id, i.table_id) AS table_id,
          CASE WHEN e.table_id IS NULL THEN i.sensitivity WHEN i.table_id IS NULL THEN e.sensitivity
            WHEN e.sensitivity IS NULL AND i.sensitivity IS NULL THEN 'NORMAL' WHEN e.sensitivity IS NULL THEN i.sensitivity
            WHEN i.sensitivity IS NULL THEN e.sensitivity
            WHEN {RANK.format(x="i.sensitivity")} > {RANK.format(x="e.sensitivity")} THEN i.sensitivity
            ELSE e.sensitivity END AS sensitivity,
          coalesce(e.four_eyes, FALSE) OR coalesce(i.four_eyes, FALSE) AS four_eyes,
          coalesce(e.is_active, TRUE) AND coalesce(i.is_active, TRUE) AS is_active
        FROM e FULL JOIN i ON e.table_id = i.table_id""",
)
def merge_tables(t: Frames):
    return K.merge_tables(t.catalog_tables, t.sql(INCOMING_TABLES))


INCOMING_COLUMNS = """SELECT table_id, upper(column_name) AS column_name, CASE WHEN table_id % 2 = 0 THEN '' ELSE 'text' END AS data_type,
    table_id % 3 = 0 AS is_sensitive, CASE table_id % 4 WHEN 0 THEN 'NULLIFY' WHEN 1 THEN 'hmac' END AS rule_type
    FROM {catalog_columns} WHERE column_name <> 'phone'"""


@query(
    "u4_merge_columns",
    f"""WITH i AS ({INCOMING_COLUMNS.format(catalog_columns="catalog_columns")}),
          e AS (SELECT *, CASE WHEN is_sensitive THEN CASE WHEN column_name = 'Email' THEN 'MASK_EMAIL' ELSE 'REDACT' END END
                AS rule_type FROM catalog_columns)
        SELECT e.table_id, coalesce(i.column_name, e.column_name) AS column_name,
          CASE WHEN coalesce(i.data_type, '') = '' THEN e.data_type ELSE i.data_type END AS data_type,
          e.is_sensitive OR coalesce(i.is_sensitive, FALSE) AS is_sensitive,
          CASE WHEN i.rule_type = 'NULLIFY' OR (i.rule_type = 'hmac' AND (e.rule_type IS NULL OR e.rule_type = 'MASK_EMAIL'))
            THEN i.rule_type ELSE e.rule_type END AS rule_type
        FROM e LEFT JOIN i ON e.table_id = i.table_id AND lower(e.column_name) = lower(i.column_name)""",
)
def merge_columns(t: Frames):
    existing = t.catalog_columns.join(_rules(t), ["table_id", "column_name"], "left")
    return K.merge_columns(existing, t.sql(INCOMING_COLUMNS))


DOCS = """SELECT l_partkey AS table_id, l_linenumber AS col, CASE l_suppkey % 7 WHEN 0 THEN 'Manual' WHEN 1 THEN 'DataCatalog'
      WHEN 2 THEN 'dbt' WHEN 3 THEN 'OpenApi' WHEN 4 THEN 'Database' WHEN 5 THEN 'Default' ELSE 'Rumour' END AS doc_source,
    l_orderkey * 10 + l_linenumber AS version, 'doc ' || l_orderkey AS description FROM {lineitem}"""


@query(
    "u5_best_documentation",
    f"""WITH d AS ({DOCS.format(lineitem="lineitem")}), r AS (SELECT *, CASE lower(doc_source) WHEN 'manual' THEN 1 WHEN 'datacatalog' THEN 2
          WHEN 'dbt' THEN 3 WHEN 'openapi' THEN 4 WHEN 'database' THEN 5 WHEN 'default' THEN 6 ELSE 7 END AS rank FROM d)
        SELECT table_id, col, arg_min(description, rank * 10000000000 - version) AS description,
               min(rank) AS rank FROM r GROUP BY table_id, col""",
)
def documentation(t: Frames):
    best = K.best_documentation(t.sql(DOCS), ["table_id", "col"])
    rank = K.documentation_rank(F.col("doc_source")).cast("int")
    return best.select("table_id", "col", "description", rank.alias("rank"))


# Two versions of a schema, element by element, derived from the order lines.
ELEMENTS = """
    SELECT 'TYPE' AS element, 'T' || p_partkey AS path, CAST(NULL AS STRING) AS parent,
           CASE WHEN p_size % 10 = {0} THEN 'INTERFACE' ELSE 'OBJECT' END AS kind, FALSE AS required, FALSE AS deprecated
    FROM {part} WHERE p_partkey % 17 <> {0}
    UNION ALL
    SELECT DISTINCT 'FIELD', 'T' || l_partkey || '.f' || l_linenumber, 'T' || l_partkey,
           CASE WHEN l_partkey % 13 = {0} THEN 'Int' ELSE 'String' END, FALSE, l_partkey % 5 = {0}
    FROM {lineitem} WHERE l_linenumber <> 1 + {0} AND l_partkey % 17 <> {0}
    UNION ALL
    SELECT DISTINCT 'ARGUMENT', 'T' || l_partkey || '.f' || l_linenumber || '(a' || l_suppkey % 3 || ')',
           'T' || l_partkey || '.f' || l_linenumber, CASE WHEN l_suppkey % 11 = {0} THEN 'Int' ELSE 'Int!' END,
           l_suppkey % 3 = 1, FALSE
    FROM (SELECT l_partkey, l_linenumber, min(l_suppkey) AS l_suppkey FROM {lineitem} GROUP BY l_partkey, l_linenumber) x
    WHERE l_linenumber <> 1 + {0} AND l_partkey % 17 <> {0} AND l_suppkey % 3 <> {0}
    UNION ALL
    SELECT DISTINCT 'ENUM_VALUE', 'E' || l_suppkey || '.' || l_returnflag, 'E' || l_suppkey, 'VALUE', FALSE, FALSE
    FROM {lineitem} WHERE NOT (l_returnflag = 'A' AND l_suppkey % 4 = {0})
    UNION ALL
    SELECT 'INPUT_FIELD', 'I' || s_suppkey || '.x', 'I' || s_suppkey,
           CASE WHEN s_suppkey % 7 = {0} THEN 'Int' ELSE 'ID' END, s_suppkey % 2 = 0, FALSE
    FROM {supplier} WHERE s_suppkey % 5 <> {0}
    UNION ALL
    SELECT 'UNION_MEMBER', 'U.' || n_name, 'U', 'MEMBER', FALSE, FALSE FROM {nation} WHERE n_nationkey % 6 <> {0}"""


def _elements(version: int, **names: str) -> str:
    return ELEMENTS.replace("{0}", str(version)).format(**names)


_NAMES = {n: n for n in ("part", "lineitem", "supplier", "nation")}
DIFF = f"""b AS ({_elements(0, **_NAMES)}), t AS ({_elements(1, **_NAMES)}),
   gone AS (SELECT path FROM b WHERE element = 'TYPE' EXCEPT SELECT path FROM t WHERE element = 'TYPE'),
   come AS (SELECT path FROM t WHERE element = 'TYPE' EXCEPT SELECT path FROM b WHERE element = 'TYPE'),
   kinds AS (SELECT b.path FROM b JOIN t ON b.element = 'TYPE' AND t.element = 'TYPE' AND b.path = t.path AND b.kind <> t.kind),
   off AS (SELECT path FROM gone UNION SELECT path FROM come UNION SELECT path FROM kinds),
   f AS (SELECT coalesce(b.element, t.element) AS element, coalesce(b.path, t.path) AS path, coalesce(b.parent, t.parent) AS parent,
      b.path IS NULL AS added, t.path IS NULL AS removed, b.kind <> t.kind AS retyped, t.required AS required,
      NOT b.deprecated AND t.deprecated AS dep FROM b FULL JOIN t ON b.element = t.element AND b.path = t.path),
   lonely AS (SELECT path FROM f WHERE element = 'FIELD' AND (added OR removed)),
   changes AS (
     SELECT 'Breaking' AS change_type, 'TYPE_REMOVED' AS code, path FROM gone
     UNION ALL SELECT 'Safe', 'TYPE_ADDED', path FROM come
     UNION ALL SELECT 'Breaking', 'TYPE_KIND_CHANGED', path FROM kinds
     UNION ALL SELECT CASE WHEN removed THEN 'Breaking' WHEN added THEN 'Safe' ELSE 'Breaking' END,
        CASE WHEN removed THEN 'FIELD_REMOVED' WHEN added THEN 'FIELD_ADDED' ELSE 'FIELD_TYPE_CHANGED' END, path
       FROM f WHERE element = 'FIELD' AND (removed OR added OR retyped) AND parent NOT IN (SELECT path FROM off)
     UNION ALL SELECT 'Dangerous', 'FIELD_DEPRECATED', path FROM f WHERE element = 'FIELD' AND dep
        AND parent NOT IN (SELECT path FROM off)
     UNION ALL SELECT CASE WHEN removed OR coalesce(retyped, FALSE) OR required THEN 'Breaking' ELSE 'Safe' END,
        CASE WHEN removed THEN 'FIELD_ARGUMENT_REMOVED' WHEN retyped THEN 'FIELD_ARGUMENT_TYPE_CHANGED'
             WHEN required THEN 'REQUIRED_FIELD_ARGUMENT_ADDED' ELSE 'FIELD_ARGUMENT_ADDED' END, path
       FROM f WHERE element = 'ARGUMENT' AND (removed OR added OR retyped) AND parent NOT IN (SELECT path FROM lonely)
         AND split_part(parent, '.', 1) NOT IN (SELECT path FROM off)
     UNION ALL SELECT CASE WHEN removed THEN 'Breaking' ELSE 'Dangerous' END,
        CASE WHEN removed THEN 'ENUM_VALUE_REMOVED' ELSE 'ENUM_VALUE_ADDED' END, path
       FROM f WHERE element = 'ENUM_VALUE' AND (removed OR added)
     UNION ALL SELECT CASE WHEN removed OR coalesce(retyped, FALSE) OR required THEN 'Breaking' ELSE 'Safe' END,
        CASE WHEN removed THEN 'INPUT_FIELD_REMOVED' WHEN retyped THEN 'INPUT_FIELD_TYPE_CHANGED'
             WHEN required THEN 'REQUIRED_INPUT_FIELD_ADDED' ELSE 'OPTIONAL_INPUT_FIELD_ADDED' END, path
       FROM f WHERE element = 'INPUT_FIELD' AND (removed OR added OR retyped)
     UNION ALL SELECT CASE WHEN removed THEN 'Breaking' ELSE 'Dangerous' END,
        CASE WHEN removed THEN 'UNION_MEMBER_REMOVED' ELSE 'UNION_MEMBER_ADDED' END, path
       FROM f WHERE element = 'UNION_MEMBER' AND (removed OR added))"""


def _diff(t: Frames):
    versions = [t.sql(ELEMENTS.replace("{0}", str(v))) for v in (0, 1)]
    return K.schema_diff(*versions)


@query("u2_schema_diff", f"WITH {DIFF} SELECT * FROM changes")
def schema_diff(t: Frames):
    return _diff(t)


@query(
    "a18_change_counts",
    f"""WITH {DIFF} SELECT count(*) FILTER (change_type = 'Breaking') AS breaking,
          count(*) FILTER (change_type = 'Dangerous') AS dangerous, count(*) FILTER (change_type = 'Safe') AS safe,
          count(*) FILTER (change_type = 'Breaking') > 0 AS has_breaking FROM changes""",
)
def change_counts(t: Frames):
    return K.change_counts(_diff(t))


@query(
    "u3_contract_violations",
    """SELECT table_id, column_name, CASE WHEN column_name = 'amount' THEN 'COLUMN_DROPPED' ELSE 'TYPE_MISMATCH' END AS problem
       FROM catalog_columns WHERE (table_id % 5 = 0 AND column_name = 'amount')
          OR (table_id % 7 = 0 AND column_name = 'created_at')""",
)
def contract(t: Frames):
    actual = t.catalog_columns.where("NOT (table_id % 5 = 0 AND column_name = 'amount')").withColumn(
        "data_type",
        F.when(
            (F.col("table_id") % 7 == 0) & (F.col("column_name") == "created_at"), "date"
        ).otherwise(F.upper("data_type")),
    )
    return K.contract_violations(t.catalog_columns, actual)


@query(
    "g5_contract_projection",
    """SELECT table_id, column_name FROM catalog_columns WHERE column_name <> 'created_at' AND NOT (is_sensitive AND table_id % 2 = 0)
         AND (column_name LIKE 'c%' OR column_name IN ('amount') OR table_id % 2 = 1)""",
)
def projection(t: Frames):
    tagged = t.catalog_columns.withColumn(
        "tags",
        F.when(F.col("is_sensitive") & (F.col("table_id") % 2 == 0), F.array(F.lit("internal"), F.lit("public")))
        .when(F.col("column_name").startswith("c"), F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("public"))),
    ).withColumn("inaccessible", F.col("column_name") == "created_at")
    return K.contract_columns(tagged, included=["public"], excluded=["internal"]).select("table_id", "column_name")


@query(
    "w6_schema_versions",
    """WITH r AS (SELECT user_id AS service, event_id AS schema_id, event_type <> 'error' AS active,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
         m AS (SELECT service, max(n) FILTER (active) AS newest FROM r GROUP BY service)
       SELECT r.service, schema_id, 'v' || n || '.0.0' AS version, coalesce(n = newest, FALSE) AS latest
       FROM r JOIN m ON m.service = r.service""",
)
def versions(t: Frames):
    rows = t.events.select(
        F.col("user_id").alias("service"),
        F.col("event_id").alias("schema_id"),
        F.col("ts").alias("registered_at"),
        (F.col("event_type") != "error").alias("active"),
    )
    return K.schema_versions(rows)


@query(
    "g8_golden_queries",
    """SELECT table_id AS query_id, table_name FROM catalog_tables WHERE domain = 'hr' ORDER BY query_id LIMIT 20""",
)
def golden(t: Frames):
    rows = t.catalog_tables.withColumnRenamed("table_id", "query_id")
    return K.golden_queries(rows, domain="HR").select("query_id", "table_name")


RUN_JSON = """'{"metadata":{"dbt_version":"1.8.0","generated_at":"2024-01-20T00:00:00Z"},"elapsed_time":1.5,"results":[{"unique_id":"'
    || unique_id || '","status":"' || status || '","execution_time":0.5,"failures":' || coalesce(CAST(failures AS STRING), 'null')
    || '},{"unique_id":"source.x","status":"pass"}]}'"""


@query(
    "s8_run_results",
    """SELECT event_id, '1.8.0' AS tool_version, unique_id, status, failures FROM results
       UNION ALL SELECT event_id, '1.8.0', 'source.x', 'pass', NULL FROM results""",
)
def run_results(t: Frames):
    docs = t.results.select("event_id", F.expr(RUN_JSON).alias("body"))
    return D.run_results(docs, "body", ("event_id",)).select(
        "event_id", "tool_version", "unique_id", "status", "failures"
    )


MODEL = """regexp_replace(regexp_replace(regexp_replace(CASE WHEN unique_id LIKE 'test.%' THEN
    CASE WHEN regexp_matches(unique_id, '^test\\.shop\\.(not_null|unique)_') THEN regexp_replace(regexp_replace(
      split_part(unique_id, '.', 3), '^(not_null|unique)_', ''), '_[^_]*$', '')
    ELSE list_extract(string_split(split_part(unique_id, '.', 3), '_'), -1) END
    ELSE list_extract(string_split(unique_id, '.'), -1) END, '^ ', ''), ' $', ''), '^$', '')"""
HEALTH = f"""ranked AS (SELECT *, lower({MODEL}) AS model, CASE
      WHEN unique_id LIKE 'snapshot%' THEN NULL WHEN lower(status) IN ('fail', 'error') THEN 3 WHEN status = 'warn' THEN 2
      WHEN unique_id NOT LIKE 'test.%' AND status IN ('success', 'pass') THEN 1 END AS rank FROM results),
   health AS (SELECT model, CASE max(rank) WHEN 3 THEN 'Quarantined' WHEN 2 THEN 'Degraded' ELSE 'Healthy' END AS health,
      count(*) FILTER (rank = 3) AS errors, count(*) FILTER (rank = 2) AS warnings,
      CAST(sum(coalesce(failures, 0)) AS BIGINT) AS failed_rows FROM ranked WHERE rank IS NOT NULL GROUP BY model)"""


@query("a10_model_health", f"WITH {HEALTH} SELECT * FROM health")
def model_health(t: Frames):
    return Q.model_health(t.results)


@query(
    "a10_failures",
    f"""WITH {HEALTH} SELECT model, CASE rank WHEN 3 THEN 'error' ELSE 'warn' END AS severity, count(*) AS n FROM ranked
        WHERE rank = 3 OR (rank = 2 AND unique_id LIKE 'test.%') GROUP BY ALL""",
)
def failures(t: Frames):
    rows = Q.failures(t.results).withColumn("model", F.lower("model"))
    return rows.groupBy("model", "severity").agg(F.count("*").alias("n"))


@query(
    "g4_quarantine_gate",
    f"""WITH {HEALTH}, tables AS (SELECT DISTINCT 'revenue_' || user_id AS table_name FROM events)
        SELECT table_name FROM tables WHERE table_name NOT IN (SELECT model FROM health WHERE health = 'Quarantined')""",
)
def gate(t: Frames):
    names = t.events.select(F.concat(F.lit("revenue_"), F.col("user_id").cast("string")).alias("table_name"))
    return Q.refuse_quarantined(names.distinct(), Q.model_health(t.results), "table_name")


@query(
    "g4_table_health",
    f"""WITH {HEALTH}, tables(table_name) AS (VALUES ('monthly'), ('revenue'), ('monthly_revenue'), ('nothing'))
        SELECT table_name, CASE max(CASE health.health WHEN 'Quarantined' THEN 3 WHEN 'Degraded' THEN 2 ELSE 1 END)
          WHEN 3 THEN 'Quarantined' WHEN 2 THEN 'Degraded' ELSE 'Healthy' END AS health FROM tables
        LEFT JOIN health ON model = table_name OR starts_with(model, table_name || '_') GROUP BY table_name""",
)
def health(t: Frames):
    tables = t.spark.createDataFrame(
        [("monthly",), ("revenue",), ("monthly_revenue",), ("nothing",)], "table_name string"
    )
    return Q.table_health(tables, Q.model_health(t.results))


MANIFEST = """'{"nodes":{"model.shop.t' || p_partkey || '":{"resource_type":"model","name":"t' || p_partkey
    || '","schema":"' || p_brand || '","columns":{"c_email":{"name":"c_email","data_type":"text","tags":["PII"]},"note":{"name":"note","data_type":"'
    || p_type || '","tags":[],"meta":{"pii":"' || CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END
    || '"}}}},"test.x":{"resource_type":"test","name":"x","columns":{"z":{"name":"z"}}}}}'"""


@query(
    "s9_manifest_columns",
    """SELECT 't' || p_partkey AS model, p_brand AS schema_name, 'c_email' AS column_name, 'text' AS data_type,
              TRUE AS is_sensitive, 'MASK_EMAIL' AS proposed_rule FROM part
       UNION ALL SELECT 't' || p_partkey, p_brand, 'note', p_type, p_size % 2 = 0,
              CASE WHEN p_size % 2 = 0 THEN 'REDACT' END FROM part""",
)
def manifest(t: Frames):
    docs = t.part.select(F.expr(MANIFEST).alias("body"))
    return D.manifest_columns(docs, "body").drop("tags")


SERVICE = """'{"openapi":"3.0.0","paths":{"/v1/widget' || p_partkey || 's":{"get":{}},"/other":{}},"components":{"schemas":{"Widget'
    || p_partkey || '":{"description":"' || p_name || '",' || CASE p_size % 3 WHEN 0 THEN '"required":["Code","ghost"],' ELSE '' END
    || '"properties":{"Code":{"type":"string"},"' || CASE p_size % 3 WHEN 1 THEN 'owner_id' ELSE 'owner' END
    || '":{"type":"integer","format":"int64","x-sensitive":true}}},"Empty":{"type":"object"}}}}'"""


@query(
    "s10_service_tables",
    """SELECT p_partkey, 'widget' || p_partkey AS table_name, p_name AS description, 'Code:string:false,'
         || CASE p_size % 3 WHEN 1 THEN 'owner_id' ELSE 'owner' END || ':int64:true' AS columns,
         CASE p_size % 3 WHEN 1 THEN 'owner_id' ELSE 'Code' END AS primary_key, '/v1/widget' || p_partkey || 's' AS path
       FROM part""",
)
def service(t: Frames):
    docs = t.part.select("p_partkey", F.expr(SERVICE).alias("body"))
    rows = D.service_tables(docs, "body", ("p_partkey",))
    shape = F.transform(
        "columns", lambda c: F.concat_ws(":", c["name"], c["data_type"], c["sensitive"].cast("string"))
    )
    return rows.withColumn("columns", F.array_join(shape, ",")).withColumn(
        "primary_key", F.array_join("primary_key", ",")
    )

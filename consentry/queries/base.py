"""Registry of the queries and the frames they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Frames the given tables do not have (audit log, consents, ...) are derived from them by
# one portable SELECT each, so the check reads exactly the same rows.
DERIVED: dict[str, str] = {
    "audit": """
        SELECT event_id AS id, event_id + 1 AS seq, ts AS occurred_at,
               CASE WHEN event_type = 'purchase' THEN 'table_write'
                    WHEN event_type = 'signup' THEN 'break_glass' ELSE 'table_read' END AS event_type,
               CASE user_id % 7 WHEN 0 THEN 'svc-' WHEN 1 THEN 'SP-' WHEN 2 THEN 'dash-'
                    WHEN 3 THEN 'bi-' WHEN 4 THEN 'Batch-' ELSE 'user-' END
                 || CAST(user_id AS STRING) AS actor_sid,
               CASE WHEN event_id % 101 = 0 THEN ''
                    ELSE 'sales.dbo.t' || CAST((event_id * 7) % 211 AS STRING) END AS target_table,
               CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'Email'
                    WHEN 3 THEN 'email' WHEN 4 THEN 'IBAN' ELSE 'amount' END AS target_column,
               CASE WHEN event_type = 'error' THEN 'DENY' ELSE 'ALLOW' END AS decision,
               'trace|' || CAST(event_id % 17 AS STRING) AS trace_id,
               props AS details_json,
               'tenant-' || CAST(user_id % 4 AS STRING) AS tenant_id,
               CASE WHEN event_id % 3 = 0 THEN 'INC-' || CAST(event_id AS STRING)
                    WHEN event_id % 3 = 1 THEN 'because' ELSE ' chg-7 ' END AS justification,
               value AS latency
        FROM {events}""",
    "consents": """
        SELECT event_id AS consent_id, (event_id * 31) % 499 AS table_id,
               CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'Deny' ELSE 'Allow' END AS effect,
               CASE event_id % 4 WHEN 0 THEN 'USER' WHEN 1 THEN 'GROUP' WHEN 2 THEN 'ROLE'
                    ELSE 'SERVICE_PRINCIPAL' END AS grantee_type,
               CASE event_id % 4 WHEN 0 THEN 'user-' || CAST(user_id AS STRING)
                    WHEN 1 THEN 'grp-' || CAST(user_id % 25 AS STRING)
                    WHEN 2 THEN NULL ELSE 'user-' || CAST(user_id + 40 AS STRING) END AS grantee_sid,
               CASE WHEN event_id % 4 = 2 AND event_id % 19 > 0 THEN
                 CASE user_id % 5 WHEN 0 THEN 'MACHINERY' WHEN 1 THEN 'BUILDING'
                      WHEN 2 THEN 'AUTOMOBILE' WHEN 3 THEN 'HOUSEHOLD' ELSE 'FURNITURE' END
               END AS role_name,
               CAST(NULL AS STRING) AS role_id,
               ts AS valid_from,
               ts + (CAST(floor(value) AS INT) - 1) * INTERVAL '1' DAY AS valid_to,
               event_id % 11 = 0 AS is_revoked,
               'tenant-' || CAST(event_id % 2 AS STRING) AS tenant_id,
               CASE WHEN event_id % 5 < 3 THEN NULL
                    ELSE 'region = ' || CAST(event_id % 5 AS STRING) END AS filter_key
        FROM {events}""",
    "consent_rules": """
        SELECT event_id AS consent_id, 'c' || CAST(user_id % 3 AS STRING) AS column_name,
               CAST(event_id % 3 AS INT) AS access_level FROM {events} WHERE event_id % 4 < 3
        UNION ALL
        SELECT event_id, 'C' || CAST(3 + user_id % 3 AS STRING), CAST((event_id + 1) % 3 AS INT)
        FROM {events} WHERE event_id % 4 < 2""",
    "subjects": "SELECT 'user-' || CAST(c_custkey AS STRING) AS sid FROM {customer}",
    "subject_groups": """
        SELECT 'user-' || CAST(c_custkey AS STRING) AS sid,
               'grp-' || CAST(c_nationkey AS STRING) AS group_sid FROM {customer}""",
    "subject_roles": """
        SELECT 'user-' || CAST(c_custkey AS STRING) AS sid, c_mktsegment AS role_name
        FROM {customer} WHERE c_custkey % 3 > 0""",
    "policy": """
        SELECT DISTINCT CASE event_id % 9 WHEN 0 THEN '*' WHEN 1 THEN 'readers'
                 ELSE 'user-' || CAST(user_id AS STRING) END AS sub,
               'tenant-' || CAST(user_id % 4 AS STRING) AS tenant,
               CASE event_id % 5 WHEN 0 THEN 'sales.dbo.t' || CAST(event_id % 211 AS STRING)
                 WHEN 1 THEN 'Sales.dbo.*' WHEN 2 THEN 'sales.*.t' || CAST(event_id % 211 AS STRING)
                 WHEN 3 THEN 'sales.dbo.t1*' ELSE 'sales.:schema.t2' END AS obj,
               CASE event_id % 4 WHEN 0 THEN '*' WHEN 1 THEN 'write' ELSE 'read' END AS act,
               CASE WHEN event_id % 13 = 0 THEN 'r.ctx.unknown' ELSE 'true' END AS sub_rule,
               CASE WHEN event_id % 37 = 5 THEN 'deny' ELSE 'allow' END AS eft,
               CAST(NULL AS STRING) AS rls_filter
        FROM {events} WHERE event_type = 'signup'""",
    "grouping": """
        SELECT DISTINCT 'dash-' || CAST(user_id AS STRING) AS sid, 'readers' AS role
        FROM {events} WHERE user_id % 7 = 2""",
    "usage": """
        SELECT event_id, ts AS at, 'tenant-' || CAST(user_id % 4 AS STRING) AS tenant,
               'user-' || CAST(user_id AS STRING) AS principal, event_type AS operation,
               CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'AI-' || event_type END AS category,
               CASE WHEN event_type = 'view' THEN 0 ELSE CAST(floor(value * 100) AS BIGINT) END AS prompt_tokens,
               CASE WHEN event_type = 'view' THEN 0 ELSE CAST(event_id % 4000 AS BIGINT) END AS completion_tokens,
               CAST(event_id % 977 AS BIGINT) AS compute_ms
        FROM {events}""",
    "catalog_tables": """
        SELECT p_partkey AS table_id, CASE p_partkey % 3 WHEN 0 THEN 'sales' WHEN 1 THEN 'finance'
                 ELSE 'hr' END AS domain,
               p_brand AS schema_name, 't' || CAST(p_partkey AS STRING) AS table_name,
               p_name AS display_name, p_type AS description,
               CASE p_type WHEN 'ECONOMY' THEN 'LOW' WHEN 'SMALL' THEN 'HIGH_PII' WHEN 'MEDIUM' THEN 'MEDIUM'
                    WHEN 'PROMO' THEN 'ART9' ELSE NULL END AS sensitivity,
               p_size % 5 = 0 AS four_eyes, p_size % 7 > 0 AS is_active
        FROM {part}""",
    "catalog_columns": """
        SELECT DISTINCT l_partkey AS table_id,
               CASE l_linenumber WHEN 1 THEN 'Email' WHEN 2 THEN 'iban' WHEN 3 THEN 'phone' WHEN 4 THEN 'amount'
                    WHEN 5 THEN 'created_at' ELSE 'c' || CAST(l_linenumber AS STRING) END AS column_name,
               CASE l_linenumber WHEN 4 THEN 'decimal(18,2)' WHEN 5 THEN 'datetime' ELSE 'nvarchar' END AS data_type,
               l_linenumber < 4 AS is_sensitive
        FROM {lineitem}""",
    "lineage_edges": """
        SELECT DISTINCT 'o' || CAST(l_orderkey AS STRING) AS src, 'p' || CAST(l_partkey AS STRING) AS dst
        FROM {lineitem}
        UNION
        SELECT 'p' || CAST(l_partkey AS STRING), 's' || CAST(l_suppkey AS STRING) FROM {lineitem}
        UNION
        SELECT 's' || CAST(s_suppkey AS STRING), 'n' || CAST(s_nationkey AS STRING) FROM {supplier}
        UNION
        SELECT 'n' || CAST(n_nationkey AS STRING), 'r' || CAST(n_regionkey AS STRING) FROM {nation}
        UNION
        SELECT 'r' || CAST(n_regionkey AS STRING), 'n' || CAST(n_nationkey AS STRING)
        FROM {nation} WHERE n_nationkey < 5""",
    "requests": """
        SELECT o_orderkey AS request_id, o_custkey % 701 AS table_id,
               'user-' || CAST(o_custkey AS STRING) AS requester_sid,
               CASE o_orderkey % 3 WHEN 0 THEN 'USER' WHEN 1 THEN 'GROUP' ELSE 'ROLE' END AS grantee_type,
               'g-' || CAST(o_custkey % 50 AS STRING) AS grantee,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'PENDING' WHEN '2-HIGH' THEN 'PENDING_SECOND_APPROVAL'
                    WHEN '3-MEDIUM' THEN 'PENDING_EXTERNAL_APPROVAL' WHEN '5-LOW' THEN 'REJECTED'
                    ELSE 'ACTIVE' END AS status,
               o_orderdate AS requested_at, o_orderdate + INTERVAL '30' DAY AS requested_valid_to,
               CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'default'
                    WHEN 3 THEN 'legacy-default' ELSE 'tenant-a' END AS tenant_id,
               o_orderkey % 4 = 0 AS four_eyes
        FROM {orders}""",
    "steps": """
        SELECT l_orderkey AS request_id, 'user-' || CAST(l_suppkey % 40 AS STRING) AS approver_sid,
               CASE WHEN l_linenumber = 5 AND l_returnflag = 'R' THEN 'REJECTED' ELSE 'APPROVED' END AS decision,
               l_shipdate AS decided_at
        FROM {lineitem} WHERE l_linenumber < 6""",
    "results": """
        SELECT event_id,
               CASE event_id % 6
                 WHEN 0 THEN 'model.shop.revenue_' || CAST(user_id AS STRING)
                 WHEN 1 THEN 'test.shop.not_null_revenue_' || CAST(user_id AS STRING) || '_id.ab12'
                 WHEN 2 THEN 'test.shop.unique_monthly_revenue_account_id.cd34'
                 WHEN 3 THEN 'test.shop.custom_check_' || CAST(user_id AS STRING) || '.ef56'
                 WHEN 4 THEN 'seed.shop.Revenue_' || CAST(user_id AS STRING)
                 ELSE 'snapshot.shop.s' END AS unique_id,
               CASE event_type WHEN 'error' THEN CASE WHEN value > 60 THEN 'Error' ELSE 'warn' END
                    WHEN 'click' THEN 'success' WHEN 'view' THEN 'skipped' ELSE 'pass' END AS status,
               CASE WHEN event_type = 'error' THEN CAST(event_id % 9 AS INT) END AS failures
        FROM {events}""",
}
# Inputs of a derived frame that are not named in its own text.
ORDER = list(DERIVED)


class Frames:
    """The given tables, and the frames derived from them, loaded on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(self.path(name))
            elif name in DERIVED:
                self._made[name] = self.sql(DERIVED[name])
            else:
                raise AttributeError(name)
        return self._made[name]

    def sql(self, text: str, args=None, **frames: DataFrame) -> DataFrame:
        """A SELECT over ``{name}`` placeholders."""
        import string

        names = {n for _, n, _, _ in string.Formatter().parse(text) if n}
        inputs = {n: frames.get(n) if n in frames else getattr(self, n) for n in names}
        return self.spark.sql(text, args=args, **inputs)


Query = Callable[[Frames], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _with_derived(sql: str) -> str:
    """Puts the derived frames a check reads in front of it, as common table expressions."""
    import re

    used = [n for n in ORDER if re.search(rf"\b{n}\b", sql)]
    ctes = [f"{n} AS ({DERIVED[n].format(**{t: t for t in TABLES})})" for n in used]
    body = sql.strip()
    if not ctes:
        return body
    if body[:4].upper() == "WITH":
        rest = body[4:].strip()
        recursive = rest[:9].upper() == "RECURSIVE"
        rest = rest[9:].strip() if recursive else rest
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join([*ctes, rest])
    return "WITH " + ", ".join(ctes) + " " + body


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with the SQL that must give the same rows."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = function
        if check is not None:
            ORACLES[name] = _with_derived(check)
        return function

    return add

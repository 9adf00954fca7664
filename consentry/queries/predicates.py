"""Scans, projections, filters, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from consentry.functions.shapes import normalised_frame
from consentry.model import CLEAR, DENY, Column, Condition, Consent, MaskRule, Subject, TableMeta
from consentry.operators import predicates as P
from consentry.operators.consent import Decision, columns_of
from consentry.plans.governed import Governor, masked_projection, odata, page
from consentry.queries.base import Frames, query
from consentry.queries.metas import ANALYST, CUSTOMER, NOW, ORDERS, ORDERS_ROWS, governor
from consentry.sources.documents import payload_fields, payload_rows, result_rows
from consentry.session import scratch_path
from consentry.sources.skipping import build_file_index, indexed_scan, pruning_report
from consentry.sources.tables import changes_since, next_watermark, scan_report


@query(
    "s1_governed_scan",
    f"""SELECT o_orderkey, o_custkey, o_orderstatus, CAST(0 AS DOUBLE) AS o_totalprice, o_orderdate,
               'x-' || substr(o_orderpriority, 3) AS o_orderpriority
        FROM orders WHERE {ORDERS_ROWS}""",
)
def governed_scan(t: Frames):
    return governor(t).table(ORDERS.name, ANALYST)


@query(
    "p1_authorised_projection",
    "SELECT c_mktsegment, c_custkey FROM customer",
)
def authorised(t: Frames):
    return governor(t).table(CUSTOMER.name, ANALYST, columns=["c_mktsegment", "C_CUSTKEY", "no_such"])


@query(
    "p1_projection_fallback",
    "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag FROM lineitem",
)
def fallback(t: Frames):
    # The only requested column is denied, so all authorised columns come back.
    return governor(t).table("sales.dbo.lineitem", ANALYST, columns=["l_discount"])


@query(
    "p2_effective_level",
    "SELECT c_custkey, c_name, CAST(0 AS DOUBLE) AS c_acctbal FROM customer",
)
def effective(t: Frames):
    # Explicit CLEAR releases a sensitive column, an implicit one does not.
    decision = Decision(True, levels={"c_name": CLEAR, "c_mktsegment": DENY}, default_level=CLEAR)
    columns = columns_of(CUSTOMER, decision, ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"])
    return masked_projection(t.customer, CUSTOMER, decision, columns)


@query(
    "p3_row_masker",
    """SELECT s_suppkey, CASE WHEN length(s_name) > 8 THEN left(s_name, 3) || repeat('*', length(s_name) - 6)
                || right(s_name, 3) END AS s_name, CAST(0 AS DOUBLE) AS s_acctbal FROM supplier""",
)
def row_masker(t: Frames):
    meta = TableMeta(
        "m.dbo.supplier",
        (
            Column("s_suppkey", "bigint"),
            Column("s_name", sensitive=True, rule=MaskRule("MASK_PHONE")),
            Column("s_nationkey", "int"),
            Column("s_acctbal", "double", sensitive=True),
        ),
        ("s_suppkey",),
    )
    decision = Decision(True, levels={"s_nationkey": DENY}, default_level=CLEAR)
    return masked_projection(t.supplier, meta, decision, [c.name for c in meta.columns])


@query(
    "p4_normalised_projection",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS o_orderdate,
              strftime(o_orderdate, '%Y-%m-%d') AS day, base64(encode(o_orderpriority)) AS raw
       FROM orders""",
)
def normalised(t: Frames):
    return normalised_frame(
        t.orders.select(
            "o_orderkey",
            "o_orderdate",
            F.to_date("o_orderdate").alias("day"),
            F.encode("o_orderpriority", "UTF-8").alias("raw"),
        )
    )


TREE = {
    "and": [
        {"l_quantity": {"gte": 5, "lt": 45}},
        {"or": [{"l_returnflag": {"in": ["R", "A"]}}, {"l_linestatus": {"eq": "O"}}]},
        {"l_shipdate": {"gt": "1996-01-01"}},
    ],
    "l_returnflag": {"neq": None, "startswith": "", "contains": ""},
    "l_linestatus": {"endswith": "O"},
}


@query(
    "p5_filter_tree",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
       WHERE l_quantity >= 5 AND l_quantity < 45 AND (l_returnflag IN ('R', 'A') OR l_linestatus = 'O')
         AND l_shipdate > TIMESTAMP '1996-01-01' AND l_returnflag IS NOT NULL AND l_linestatus = 'O'""",
)
def filter_tree(t: Frames):
    df = t.lineitem
    return df.where(P.filter_tree(TREE, df.schema)).select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "p7_consent_predicate",
    """SELECT o_orderkey FROM orders
       WHERE o_orderstatus <> 'P' AND o_totalprice < 400000 AND o_totalprice > 2000.5 AND o_custkey <= 1200
         AND o_custkey >= 3 AND o_orderpriority LIKE '%-%G%' AND o_orderkey IS NOT NULL AND o_orderstatus = 'F'""",
)
def consent_predicate(t: Frames):
    df = t.orders
    conditions = [
        Condition("o_orderstatus", "NEQ", "P"),
        Condition("o_totalprice", "LT", 400000),
        Condition("o_totalprice", "GT", 2000.5),
        Condition("o_custkey", "LTE", 1200),
        Condition("o_custkey", "GTE", 3),
        Condition("o_orderpriority", "LIKE", "%-%G%"),
        Condition("o_orderkey", "NEQ", None),
        Condition("o_orderstatus", "EQ", user_attribute="status"),
    ]
    tests = [P.condition(c, df.schema, ANALYST) for c in conditions]
    return df.where(P.all_of(tests)).select("o_orderkey")


@query(
    "p8_filter_groups",
    """SELECT o_orderkey FROM orders
       WHERE (o_orderstatus = 'F' AND o_totalprice > 100000) OR (o_orderpriority IN ('1-URGENT', '2-HIGH'))
          OR (o_custkey = 7 AND o_orderstatus = 'O')""",
)
def groups(t: Frames):
    consent = Consent(
        "o",
        filters=(
            Condition("o_orderstatus", "EQ", "F", 0),
            Condition("o_totalprice", "GT", 100000, 0),
            Condition("o_orderpriority", "IN", '["1-URGENT", "2-HIGH"]', 1),
            Condition("o_custkey", "EQ", 7, 2),
            Condition("o_orderstatus", "EQ", "O", 2),
        ),
    )
    return t.orders.where(P.consent_predicate(consent, t.orders.schema)).select("o_orderkey")


@query(
    "p9_allow_minus_deny",
    """WITH o AS (SELECT o_orderkey, nullif(o_orderpriority, '3-MEDIUM') AS prio, o_totalprice, o_orderstatus FROM orders)
       SELECT o_orderkey FROM o WHERE (o_orderstatus = 'F' OR o_totalprice > 200000)
         AND NOT ((prio = '1-URGENT') OR (o_totalprice < 5000))""",
)
def allow_minus_deny(t: Frames):
    # A NULL priority makes the deny predicate unknown, so the row is dropped.
    df = t.orders.select(
        "o_orderkey",
        F.nullif("o_orderpriority", F.lit("3-MEDIUM")).alias("prio"),
        "o_totalprice",
        "o_orderstatus",
    )
    allows = [
        Consent("o", filters=(Condition("o_orderstatus", "EQ", "F"),)),
        Consent("o", filters=(Condition("o_totalprice", "GT", 200000),)),
    ]
    denies = [
        Consent("o", "DENY", filters=(Condition("prio", "EQ", "1-URGENT"),)),
        Consent("o", "DENY", filters=(Condition("o_totalprice", "LT", 5000),)),
    ]
    return df.where(P.combined_row_filter(allows, denies, df.schema)).select("o_orderkey")


@query(
    "p10_tenant_isolation",
    """SELECT tenant_id, count(*) AS n FROM audit WHERE tenant_id = 'tenant-2' GROUP BY tenant_id""",
)
def tenant(t: Frames):
    meta = TableMeta(
        "log.dbo.audit",
        tuple(Column(c) for c in t.audit.columns),
        ("id",),
    )
    reader = Subject("user-9", "tenant-2")
    g = Governor(t.spark, [Consent(meta.name, grantee="user-9")], now=NOW)
    g.register(lambda session: t.audit, meta)
    return g.table(meta.name, reader, columns=["tenant_id"]).groupBy("tenant_id").agg(F.count("*").alias("n"))


@query(
    "p11_equality_arguments",
    f"SELECT o_orderkey, o_orderdate FROM orders WHERE {ORDERS_ROWS} AND o_orderstatus = 'F' AND o_custkey = 77",
)
def arguments(t: Frames):
    return governor(t).table(
        ORDERS.name,
        ANALYST,
        columns=["o_orderkey", "o_orderdate"],
        equals={"o_orderstatus": "F", "o_custkey": 77, "limit": 5, "offset": 1, "o_orderkey": None},
    )


def _keys(t: Frames):
    return t.lineitem.where("l_quantity = 50").select("l_orderkey", "l_linenumber")


@query(
    "p12_composite_keys",
    """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE EXISTS (
         SELECT 1 FROM lineitem k WHERE k.l_quantity = 50 AND k.l_orderkey = lineitem.l_orderkey
           AND k.l_linenumber = lineitem.l_linenumber)""",
)
def composite_keys(t: Frames):
    return P.key_filter(t.lineitem, _keys(t), ["l_orderkey", "l_linenumber"]).select(
        "l_orderkey", "l_linenumber", "l_extendedprice"
    )


@query(
    "p13_key_table_join",
    """SELECT l.l_orderkey, l.l_linenumber, count(*) AS n FROM lineitem l
       JOIN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 50) k
         ON l.l_orderkey = k.l_orderkey AND l.l_linenumber = k.l_linenumber GROUP BY ALL""",
)
def key_table(t: Frames):
    joined = P.key_join(t.lineitem, _keys(t), ["l_orderkey", "l_linenumber"])
    return joined.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query(
    "p14_set_filter",
    """SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (1, 5, 9)
         AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def set_filter(t: Frames):
    named = P.set_filter(t.customer, "c_nationkey", [1, 5, 9])
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select("o_custkey")
    return P.set_filter(named, "c_custkey", urgent).select("c_custkey", "c_name")


@query(
    "p15_residual_filter",
    """SELECT 'good' AS part, count(*) AS n FROM lineitem
         WHERE (l_orderkey, l_linenumber) IN ((1, 1), (2, 3), (5, 4)) OR l_quantity BETWEEN 10 AND 12
       UNION ALL SELECT 'bad', 0 UNION ALL SELECT 'unknown', 0""",
)
def residual(t: Frames):
    good = P.where_text(
        t.lineitem,
        "(l_orderkey, l_linenumber) IN ((1, 1), (2, 3), (5, 4)) OR l_quantity BETWEEN 10 AND 12",
    )
    bad = P.where_text(t.lineitem, "EXISTS (SELECT 1)")
    unknown = P.where_text(t.lineitem, "no_such_column = 1")
    count = F.count("*").alias("n")
    parts = [
        df.agg(count).select(F.lit(name).alias("part"), "n")
        for name, df in (("good", good), ("bad", bad), ("unknown", unknown))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "p16_policy_template",
    """SELECT o_orderkey, o_orderstatus FROM orders
       WHERE o_orderstatus = 'F' AND (o_orderpriority = '2-HIGH' OR 'user-1' = 'x') AND 'EUR' = 'EUR'""",
)
def template(t: Frames):
    subject = Subject("user-1", "EUR", attributes={"status": "F", "clearance": "2-HIGH"})
    text = (
        "o_orderstatus = ${attr.status} AND (o_orderpriority = '${clearance}' OR ${user_sid} = 'x')"
        " AND ${tenant} = 'EUR'"
    )
    return P.where_template(t.orders, text, subject).select("o_orderkey", "o_orderstatus")


@query(
    "p18_catalog_search",
    """SELECT table_id, table_name, domain FROM catalog_tables
       WHERE domain = 'finance' AND (contains(lower(table_name), 'widget') OR contains(lower(display_name), 'widget')
         OR contains(lower(description), 'widget')) ORDER BY table_id LIMIT 50 OFFSET 5""",
)
def search(t: Frames):
    from consentry.operators.catalog import search as find

    return find(t.catalog_tables, " Widget ", "FINANCE", skip=5, take=50).select("table_id", "table_name", "domain")


ODATA_ROWS = f"SELECT o_orderkey, o_orderdate FROM orders WHERE {ORDERS_ROWS} AND o_orderkey > 1000 AND o_orderstatus = 'F'"


@query("p19_odata_page", f"{ODATA_ROWS} ORDER BY o_orderkey LIMIT 20 OFFSET 10")
def odata_page(t: Frames):
    rows, _ = odata(
        governor(t).table(ORDERS.name, ANALYST),
        ["o_orderkey"],
        {
            "$select": "o_orderkey,o_orderdate",
            "$filter": "o_orderkey gt 1000 and o_orderstatus eq 'F'",
            "$top": "20",
            "$skip": "10",
        },
    )
    return rows


@query("p19_odata_count", f"SELECT count(*) AS count FROM ({ODATA_ROWS})")
def odata_count(t: Frames):
    _, total = odata(
        governor(t).table(ORDERS.name, ANALYST),
        ["o_orderkey"],
        {"$filter": "o_orderkey gt 1000 and o_orderstatus eq 'F'", "$count": "true"},
    )
    return total


@query(
    "p20_pseudonym_join",
    """SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment""",
)
def pseudonym_join(t: Frames):
    # c_name is hidden behind a keyed hash, so it may still serve as a join key.
    g = governor(t)
    joined = g.join(CUSTOMER.name, CUSTOMER.name, ANALYST, [("c_name", "c_name")])
    return joined.groupBy(F.col("a.c_mktsegment").alias("c_mktsegment")).agg(F.count("*").alias("n"))


@query(
    "p21_tracked_tables",
    """SELECT target_table, count(*) AS n FROM audit WHERE target_table IN ('sales.dbo.t7', 'sales.dbo.t12')
       GROUP BY target_table""",
)
def tracked(t: Frames):
    from consentry.streaming.cdc import tracked as keep

    rows = keep(t.audit, ["SALES.dbo.t7", "t12"], "target_table")
    return rows.groupBy("target_table").agg(F.count("*").alias("n"))


@query(
    "p22_sample",
    """SELECT event_id, event_type FROM events
       WHERE CAST('0x' || substr(md5('7|' || CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 1000000 < 100000""",
)
def sample(t: Frames):
    return P.sample_percent(t.events, 10, seed=7, keys=["event_id"]).select("event_id", "event_type")


@query("p22_sample_bounds", "SELECT 'all' AS part, count(*) AS n FROM events UNION ALL SELECT 'none', 0")
def sample_bounds(t: Frames):
    n = F.count("*").alias("n")
    every = P.sample_percent(t.events, 100).agg(n).select(F.lit("all").alias("part"), "n")
    none = P.sample_percent(t.events, 0).agg(n).select(F.lit("none").alias("part"), "n")
    return every.unionByName(none)


@query(
    "l1_page",
    f"SELECT o_orderkey, o_custkey FROM orders WHERE {ORDERS_ROWS} ORDER BY o_orderkey LIMIT 50 OFFSET 100",
)
def first_page(t: Frames):
    return governor(t).page(ORDERS.name, ANALYST, after=100, columns=["o_orderkey", "o_custkey"])


@query(
    "l2_page_order",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_orderkey, l_linenumber, l_quantity LIMIT 200",
)
def page_order(t: Frames):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    return page(df, ["l_orderkey", "l_linenumber", "l_quantity"], 200)


@query(
    "s3_payload_rows",
    """SELECT event_id, 'k' AS name, json_extract_string(props, '$.k') AS value,
              CASE WHEN event_id % 3 = 2 THEN 'double' ELSE 'int' END AS kind
       FROM events WHERE event_id % 3 < 2
       UNION ALL
       SELECT event_id, 'v', CAST(event_id AS VARCHAR) || '.5', 'double' FROM events WHERE event_id % 3 = 0
       UNION ALL
       SELECT event_id, 'nested', '{"a":1}', 'json' FROM events WHERE event_id % 3 = 0""",
)
def payloads(t: Frames):
    # An array, an object, or a path that is not there.
    body = F.when(
        F.col("event_id") % 3 == 0,
        F.format_string(
            '{"data": {"rows": [%s, {"v": %d.5, "nested": {"a": 1}}]}}', F.col("props"), F.col("event_id")
        ),
    ).when(
        F.col("event_id") % 3 == 1, F.format_string('{"data": {"rows": %s}}', F.col("props"))
    ).otherwise(F.format_string('{"data": {"other": %s}}', F.col("props")))
    df = t.events.select("event_id", body.alias("body"))
    return payload_fields(payload_rows(df, "body", "data.rows", ("event_id",)), ("event_id",))


@query(
    "s4_nested_result_rows",
    """SELECT event_id, json_extract_string(props, '$.k') AS k FROM events
       UNION ALL SELECT event_id, '-1' FROM events WHERE event_id % 4 = 1""",
)
def nested_rows(t: Frames):
    form = (
        F.when(F.col("event_id") % 4 == 0, F.format_string('{"rows": [%s]}', F.col("props")))
        .when(
            F.col("event_id") % 4 == 1,
            F.format_string('{"edges": [{"node": %s}, {"node": {"k": -1}}]}', F.col("props")),
        )
        .when(F.col("event_id") % 4 == 2, F.format_string("[%s]", F.col("props")))
        .otherwise(F.format_string('{"jsonRows": "[%s]"}', F.replace("props", F.lit('"'), F.lit('\\"'))))
    )
    df = t.events.select("event_id", form.alias("body"))
    rows = result_rows(df, "body", ("event_id",))
    return rows.select("event_id", F.get_json_object("row", "$.k").alias("k"))


@query(
    "s5_pruned_scan",
    """SELECT event_type, count(*) AS n FROM events
       WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12' GROUP BY event_type""",
)
def pruned_scan(t: Frames):
    # The range reaches the Parquet footers; row groups outside it are not read.
    day = t.events.where("ts >= TIMESTAMP_NTZ '2024-01-10' AND ts < TIMESTAMP_NTZ '2024-01-12'")
    return day.groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "s5_scan_report",
    """SELECT count(DISTINCT CAST(ts AS DATE)) AS files_total,
              count(DISTINCT CAST(ts AS DATE)) FILTER (CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12') AS files_scanned,
              count(DISTINCT CAST(ts AS DATE)) FILTER (CAST(ts AS DATE) NOT BETWEEN DATE '2024-01-10' AND DATE '2024-01-12') AS files_pruned,
              round(count(DISTINCT CAST(ts AS DATE)) FILTER (CAST(ts AS DATE) NOT BETWEEN DATE '2024-01-10' AND DATE '2024-01-12')
                * 100.0 / count(DISTINCT CAST(ts AS DATE)), 2) AS pruned_percent FROM events""",
)
def report(t: Frames):
    # A table laid out by day, one file each; the filter leaves three partitions.
    path = scratch_path(t.spark, "by-day")
    t.events.withColumn("day", F.to_date("ts")).repartition("day").write.partitionBy("day").parquet(path)
    table = t.spark.read.parquet(path)
    return scan_report(table, table.where("day BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'"))


# The table is laid out by day, one file each; the filter names other columns, an interval and either of two users.
SKIPPED = {"event_id": {"gte": 400, "lt": 1900}, "or": [{"user_id": {"lt": 12}}, {"user_id": {"in": [40, 77]}}]}
SKIPPED_SQL = "event_id >= 400 AND event_id < 1900 AND (user_id < 12 OR user_id IN (40, 77))"


def _events_by_day(t: Frames):
    path = scratch_path(t.spark, "by-day")
    t.events.withColumn("day", F.to_date("ts")).repartition("day").write.partitionBy("day").parquet(path)
    return build_file_index(t.spark, path, ["event_id", "user_id", "value", "event_type"])


@query(
    "s5_file_index",
    """WITH f AS (SELECT min(event_id) AS lo, max(event_id) AS hi, min(user_id) AS ulo, max(user_id) AS uhi, count(*) AS n
                  FROM events GROUP BY CAST(ts AS DATE)),
            o AS (SELECT *, hi >= 400 AND lo < 1900 AND (ulo < 12 OR (ulo <= 40 AND uhi >= 40) OR (ulo <= 77 AND uhi >= 77)) AS opened FROM f)
       SELECT count(*) AS files_total, count(*) FILTER (opened) AS files_scanned, count(*) FILTER (NOT opened) AS files_pruned,
              round(count(*) FILTER (NOT opened) * 100.0 / count(*), 2) AS pruned_percent,
              CAST(sum(n) AS BIGINT) AS rows_total, CAST(coalesce(sum(n) FILTER (opened), 0) AS BIGINT) AS rows_scanned FROM o""",
)
def file_index(t: Frames):
    return pruning_report(_events_by_day(t), SKIPPED)


@query(
    "s5_indexed_scan",
    f"SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS day FROM events WHERE {SKIPPED_SQL}",
)
def rows_of_few_files(t: Frames):
    return indexed_scan(_events_by_day(t), SKIPPED).select("event_id", "user_id", "event_type", "day")


@query(
    "s13_changes_since",
    "SELECT event_id, event_type FROM events WHERE event_id > 400 ORDER BY event_id LIMIT 500",
)
def changes(t: Frames):
    return changes_since(t.events, "event_id", 400).select("event_id", "event_type")


@query(
    "s13_next_watermark",
    "SELECT CAST(max(event_id) AS BIGINT) AS watermark, count(*) AS changes FROM events WHERE event_id > 400",
)
def watermark(t: Frames):
    return next_watermark(changes_since(t.events, "event_id", 400, None), "event_id", 400)

"""Governed SQL, endpoints, exports and egress."""

from __future__ import annotations


from pyspark.sql import functions as F

from consentry.functions.shapes import flatten, row_size_estimate, value_kind, widened_type
from consentry.model import CLEAR, DENY, MASK
from consentry.queries.base import Frames, query
from consentry.queries.metas import ANALYST, CUSTOMER, LINEITEM, NATION, ORDERS, ORDERS_ROWS, governor
from consentry.sinks.export import apply_egress, capped, csv_line, export_parquet, json_rows
from consentry.sources.tables import parse_endpoint, register_models
from consentry.session import scratch_path

TABLES = {
    "orders": ORDERS.name, "customer": CUSTOMER.name, "nation": NATION.name, "lineitem": LINEITEM.name,
}
REVENUE = """
SELECT n_name, count(*) AS lines, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
       count(DISTINCT o_orderkey) AS orders
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
     JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY n_name HAVING sum(l_quantity) > 100"""


def revenue_by_nation(t: Frames):
    return governor(t).sql(REVENUE, ANALYST, tables=TABLES)


@query(
    "j6_governed_join",
    f"""SELECT n_name, count(*) AS lines, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
          count(DISTINCT o_orderkey) AS orders
        FROM (SELECT * FROM orders WHERE {ORDERS_ROWS}) JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN lineitem ON l_orderkey = o_orderkey
        GROUP BY n_name HAVING sum(l_quantity) > 100""",
)
def governed_join(t: Frames):
    return revenue_by_nation(t)


@query(
    "q1_governed_cte",
    f"""WITH o AS (SELECT * FROM orders WHERE {ORDERS_ROWS})
        SELECT o_orderstatus, count(*) AS n, CAST(sum(0) AS DOUBLE) AS total, max(o_orderkey) AS last_key
        FROM o GROUP BY o_orderstatus""",
)
def cte(t: Frames):
    # A CTE with the name of a table reads the governed table; the masked price sums to 0.
    text = """WITH orders AS (SELECT * FROM orders)
        SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS total, max(o_orderkey) AS last_key
        FROM orders GROUP BY o_orderstatus"""
    return governor(t).sql(text, ANALYST, tables=TABLES)


@query(
    "a17_governed_aggregates",
    """SELECT lower(c_mktsegment) AS segment, count(*) AS n, max(c_nationkey) AS top,
              round(avg(c_nationkey), 4) AS mean, coalesce(min(nullif(c_nationkey, 0)), -1) AS least
       FROM customer GROUP BY lower(c_mktsegment) HAVING count(*) > 10""",
)
def aggregates(t: Frames):
    text = """SELECT lower(c_mktsegment) AS segment, count(*) AS n, max(c_nationkey) AS top,
        round(avg(c_nationkey), 4) AS mean, coalesce(min(nullif(c_nationkey, 0)), -1) AS least
        FROM customer GROUP BY lower(c_mktsegment) HAVING count(*) > 10"""
    return governor(t).sql(text, ANALYST, tables=TABLES)


@query(
    "w7_governed_ranking",
    """SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS pos
       FROM customer QUALIFY pos <= 3""",
)
def ranking(t: Frames):
    text = """SELECT * FROM (SELECT c_custkey, c_nationkey,
        CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS BIGINT) AS pos FROM customer)
        WHERE pos <= 3"""
    return governor(t).sql(text, ANALYST, tables=TABLES)


@query(
    "l3_row_cap",
    f"""SELECT least(count(*), 1000) AS n, count(*) > 1000 AS cut FROM orders WHERE {ORDERS_ROWS}""",
)
def row_cap(t: Frames):
    rows = governor(t).sql("SELECT o_orderkey FROM orders", ANALYST, tables=TABLES, row_cap=1000, truncated="cut")
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.bool_and("cut"), F.lit(False)).alias("cut"))


@query(
    "q1_governed_using",
    f"""WITH o AS (SELECT o_custkey AS c_custkey, o_orderkey, o_orderstatus FROM orders WHERE {ORDERS_ROWS})
        SELECT c_mktsegment, count(*) AS n, max(o_orderkey) AS last_key
        FROM customer JOIN o USING (c_custkey) WHERE c_mktsegment <> 'md5(x)' GROUP BY c_mktsegment""",
)
def governed_using(t: Frames):
    # A join on a named column; a text value that looks like a call is a value.
    text = """WITH o AS (SELECT o_custkey AS c_custkey, o_orderkey FROM orders)
        SELECT c_mktsegment, count(*) AS n, max(o_orderkey) AS last_key
        FROM customer JOIN o USING (c_custkey) WHERE c_mktsegment <> 'md5(x)' GROUP BY c_mktsegment"""
    return governor(t).sql(text, ANALYST, tables=TABLES)


@query(
    "q4_policy_restricts",
    f"""SELECT o_orderkey, o_custkey, 'REDACTED' AS o_orderstatus, CAST(0 AS DOUBLE) AS o_totalprice,
               'x-' || substr(o_orderpriority, 3) AS o_orderpriority
        FROM orders WHERE {ORDERS_ROWS} AND o_orderkey % 2 = 0""",
)
def policy(t: Frames):
    # The policy hides one column, masks another, cannot raise a third, and adds a filter.
    def restrict(name, subject):
        levels = {"o_orderdate": DENY, "o_orderstatus": MASK, "o_totalprice": CLEAR}
        return True, levels, F.col("o_orderkey") % 2 == 0

    return governor(t, policy=restrict).table(ORDERS.name, ANALYST)


ENDPOINT = """
-- @name: revenue_by_segment
-- @summary: Number of customers of a segment per nation
-- @datasource: warehouse
-- @param segment string required
-- @param nation_from int default=3
SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE c_mktsegment = @segment AND n_nationkey >= @nation_from GROUP BY n_name
"""


@query(
    "q5_endpoint",
    """SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey
       WHERE c_mktsegment = 'BUILDING' AND n_nationkey >= 3 GROUP BY n_name""",
)
def endpoint(t: Frames):
    return parse_endpoint(ENDPOINT).run(governor(t), ANALYST, {"segment": "BUILDING"}, tables=TABLES)


@query(
    "k7_model_view",
    "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand",
)
def model_view(t: Frames):
    register_models(t.spark, {"model_parts": t.part}, {"model_parts": ["p_partkey", "p_brand"]})
    return t.spark.sql("SELECT p_brand, count(*) AS n FROM model_parts GROUP BY p_brand")


@query(
    "k1_parquet_export",
    """SELECT o_orderkey, o_custkey AS "customer.id", o_orderstatus AS "customer.status",
              '["' || o_orderpriority || '","x"]' AS tags FROM orders""",
)
def parquet_export(t: Frames):
    nested = t.orders.select(
        "o_orderkey",
        F.struct(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status")).alias("customer"),
        F.array("o_orderpriority", F.lit("x")).alias("tags"),
    )
    path = scratch_path(t.spark, "export")
    export_parquet(nested, path, configured=None, compression="gzip")
    return t.spark.read.parquet(path)


@query(
    "k1_truncation",
    """SELECT 'lineitem' AS name, count(*) > 500 AS is_truncated FROM lineitem
       UNION ALL SELECT 'region', count(*) > 500 FROM region
       UNION ALL SELECT 'rows', FALSE""",
)
def truncation(t: Frames):
    rows, more = capped(t.lineitem, 500, 100_000)
    _, fits = capped(t.region, 500, None)
    n = rows.agg((F.count("*") != 500).alias("is_truncated"))
    named = [
        df.select(F.lit(name).alias("name"), "is_truncated")
        for name, df in (("lineitem", more), ("region", fits), ("rows", n))
    ]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query(
    "k2_json_rows",
    """SELECT '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_mktsegment":'
         || CASE WHEN c_mktsegment = 'BUILDING' THEN 'null' ELSE '"' || c_mktsegment || '"' END || '}' AS "row"
       FROM customer""",
)
def json_objects(t: Frames):
    df = t.customer.select(
        "c_custkey", "c_name", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment")
    )
    return json_rows(df)


@query(
    "k2_json_arrays",
    """SELECT '[' || o_orderkey || ',"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || 'Z",'
         || CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE '"' || o_orderstatus || '"' END || ']' AS "row" FROM orders""",
)
def json_arrays(t: Frames):
    df = t.orders.select(
        "o_orderkey", "o_orderdate", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus")
    )
    return json_rows(df, "arrays")


@query(
    "t12_flatten",
    """SELECT c_custkey, c_name AS "a.name", c_nationkey AS "a.b.nation", '{"k":"' || c_mktsegment || '"}' AS "a.tags"
       FROM customer""",
)
def flattened(t: Frames):
    df = t.customer.select(
        "c_custkey",
        F.struct(
            F.col("c_name").alias("name"),
            F.struct(F.col("c_nationkey").alias("nation")).alias("b"),
            F.create_map(F.lit("k"), F.col("c_mktsegment")).alias("tags"),
        ).alias("a"),
        F.struct(F.col("c_acctbal").alias("hidden")).alias("z"),
    )
    return flatten(df, ["c_custkey", "a"])


VALUES = """CASE user_id % 5 WHEN 0 THEN CAST(event_id AS STRING)
  WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS STRING) ELSE '12345678901' END
  WHEN 2 THEN CASE WHEN event_id % 2 = 0 THEN '1.5' ELSE CAST(event_id AS STRING) END
  WHEN 3 THEN CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END
  ELSE CASE WHEN event_id % 2 = 0 THEN 'true' ELSE '7' END END"""


@query(
    "t13_type_widening",
    """SELECT DISTINCT user_id, CASE user_id % 5 WHEN 0 THEN 'int' WHEN 1 THEN 'bigint' WHEN 2 THEN 'double'
         WHEN 3 THEN 'boolean' ELSE 'string' END AS type FROM events""",
)
def widening(t: Frames):
    kinds = t.events.select("user_id", value_kind(F.expr(VALUES)).alias("kind"))
    return kinds.groupBy("user_id").agg(widened_type(F.col("kind")).alias("type"))


@query(
    "a16_response_size",
    """SELECT CAST(sum(2 * length('c_custkey') + 16 + 2 * length('c_name') + 2 * length(c_name)
         + 2 * length('c_acctbal') + 16) AS BIGINT) AS bytes FROM customer""",
)
def response_size(t: Frames):
    df = t.customer.select("c_custkey", "c_name", "c_acctbal")
    return df.agg(F.sum(row_size_estimate(df)).alias("bytes"))


@query(
    "x2_egress_chain",
    """SELECT c_custkey, upper(c_mktsegment) AS c_mktsegment, 'seen' AS stamp FROM customer WHERE c_acctbal > 0""",
)
def egress(t: Frames):
    return apply_egress(
        t.customer,
        [
            lambda df: df.where("c_acctbal > 0"),
            lambda df: df.select("c_custkey", F.upper("c_mktsegment").alias("c_mktsegment")),
            lambda df: df.withColumn("stamp", F.lit("seen")),
        ],
    )


@query(
    "k3_csv_lines",
    """SELECT event_id, '"' || CASE event_id % 5 WHEN 0 THEN '''=SUM(A1)' WHEN 1 THEN '''@' || event_type
          WHEN 2 THEN 'say ""' || event_type || '""' WHEN 3 THEN '''-1' ELSE event_type END || '","'
          || event_type || '"' AS line FROM events""",
)
def csv_lines(t: Frames):
    text = (
        F.when(F.col("event_id") % 5 == 0, "=SUM(A1)")
        .when(F.col("event_id") % 5 == 1, F.concat(F.lit("@"), "event_type"))
        .when(F.col("event_id") % 5 == 2, F.concat(F.lit('say "'), "event_type", F.lit('"')))
        .when(F.col("event_id") % 5 == 3, "-1")
        .otherwise(F.col("event_type"))
    )
    return t.events.select("event_id", csv_line(text, F.col("event_type")).alias("line"))



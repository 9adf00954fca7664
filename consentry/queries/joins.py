"""Joins: enrichment, nesting, semi joins, key walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from consentry.model import Condition, Consent, Hop
from consentry.operators import joins as J
from consentry.operators import predicates as P
from consentry.operators.intervals import valid_at
from consentry.queries.base import Frames, query
from consentry.queries.metas import ANALYST, CUSTOMER, ORDERS, ORDERS_ROWS, governor


@query(
    "j1_enrichment",
    f"""SELECT o.o_orderkey, o.o_custkey, c.c_mktsegment AS segment, c.c_custkey AS matched FROM
          (SELECT * FROM orders WHERE {ORDERS_ROWS}) o
          LEFT JOIN customer c ON o.o_custkey = c.c_custkey""",
)
def enrichment(t: Frames):
    rows = governor(t).enrich(
        ORDERS.name,
        ANALYST,
        "o_custkey",
        CUSTOMER.name,
        "c_custkey",
        "customer",
        columns=["o_orderkey", "o_custkey"],
        other_columns=["c_custkey", "c_mktsegment"],
    )
    return rows.select(
        "o_orderkey",
        "o_custkey",
        F.col("customer.c_mktsegment").alias("segment"),
        F.col("customer.c_custkey").alias("matched"),
    )


@query(
    "j1_enrichment_duplicates",
    """WITH d AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id
                    ORDER BY ts DESC) AS rn FROM events)
       SELECT c.c_custkey, d.event_id AS last_event, d.event_type AS last_type FROM customer c
         LEFT JOIN d ON d.user_id = c.c_custkey AND d.rn = 1""",
)
def duplicates(t: Frames):
    # Many right rows per key: the latest one wins, and nothing multiplies.
    rows = J.enrich(t.customer, t.events, "c_custkey", "user_id", "last", latest=[F.desc("ts")])
    return rows.select(
        "c_custkey", F.col("last.event_id").alias("last_event"), F.col("last.event_type").alias("last_type")
    )


@query(
    "j1_enrichment_refused",
    "SELECT o_orderkey, CAST(NULL AS VARCHAR) AS customer FROM orders",
)
def refused(t: Frames):
    rows = t.orders.select("o_orderkey", "o_custkey")
    return J.enrich(rows, None, "o_custkey", "c_custkey", "customer", keep_key=False)


@query(
    "j2_hierarchy",
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity, l_partkey, row_number() OVER (PARTITION BY l_orderkey
                    ORDER BY l_linenumber, l_partkey, l_quantity) AS rn FROM lineitem WHERE l_quantity > 10),
          lines AS (SELECT l_orderkey, count(*) AS n, string_agg(CAST(l_partkey AS VARCHAR), ','
                    ORDER BY l_linenumber, l_partkey, l_quantity) AS parts FROM l WHERE rn <= 3 GROUP BY l_orderkey),
          o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn
                FROM orders WHERE o_orderstatus <> 'P'),
          os AS (SELECT o_custkey, count(*) AS orders, sum(coalesce(n, 0)) AS lines,
                   string_agg(CAST(o_orderkey AS VARCHAR) || ':' || coalesce(parts, ''), ';' ORDER BY o_orderkey) AS tree
                 FROM o LEFT JOIN lines ON l_orderkey = o_orderkey WHERE rn <= 5 GROUP BY o_custkey)
       SELECT c_custkey, coalesce(orders, 0) AS orders, CAST(coalesce(lines, 0) AS BIGINT) AS lines,
              coalesce(tree, '') AS tree FROM customer LEFT JOIN os ON o_custkey = c_custkey""",
)
def hierarchy(t: Frames):
    tree = J.Nest(
        "customers",
        t.customer,
        ["c_custkey"],
        children=[
            J.Nest(
                "orders",
                t.orders.where("o_orderstatus <> 'P'"),
                ["o_orderkey"],
                parent_key="c_custkey",
                key="o_custkey",
                order=["o_orderkey"],
                limit=5,
                children=[
                    J.Nest(
                        "lines",
                        t.lineitem.where("l_quantity > 10"),
                        ["l_partkey", "l_quantity"],
                        parent_key="o_orderkey",
                        key="l_orderkey",
                        order=["l_linenumber", "l_partkey", "l_quantity"],
                        limit=3,
                    )
                ],
            )
        ],
    )
    rows = J.nest(tree)
    branch = F.transform(
        "orders",
        lambda o: F.concat(
            o["o_orderkey"].cast("string"),
            F.lit(":"),
            F.array_join(F.transform(o["lines"], lambda x: x["l_partkey"].cast("string")), ","),
        ),
    )
    n_lines = F.aggregate("orders", F.lit(0).cast("long"), lambda a, o: a + F.size(o["lines"]))
    return rows.select(
        "c_custkey",
        F.size("orders").cast("long").alias("orders"),
        n_lines.alias("lines"),
        F.array_join(branch, ";").alias("tree"),
    )


@query(
    "j3_correlated_exists",
    """SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM customer d JOIN nation n
         ON d.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
         WHERE d.c_custkey = o.o_custkey AND d.c_mktsegment = 'BUILDING' AND r.r_name IN ('ASIA', 'EUROPE'))
       AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')""",
)
def exists(t: Frames):
    tables = {"customer": t.customer, "nation": t.nation, "region": t.region, "lineitem": t.lineitem}
    allow = Consent(
        "o",
        filters=(
            Condition(
                dependent="customer",
                foreign_key="o_custkey",
                primary_key="c_custkey",
                hops=(
                    Hop("nation", "n", "dep.c_nationkey", "n.n_nationkey"),
                    Hop("region", "r", "n.n_regionkey", "r.r_regionkey"),
                ),
                predicate={
                    "dep": {"c_mktsegment": "BUILDING"},
                    "r": [{"column": "r_name", "op": "IN", "value": ["ASIA", "EUROPE"]}],
                },
            ),
        ),
    )
    deny = Consent(
        "o",
        "DENY",
        filters=(
            Condition(
                dependent="lineitem",
                foreign_key="o_orderkey",
                primary_key="l_orderkey",
                predicate='{"l_returnflag": "R"}',
            ),
        ),
    )
    rows = P.combined_row_filter([allow], [deny], t.orders.schema, tables=tables)
    return t.orders.where(rows).select("o_orderkey")


@query(
    "j4_temporal_exists",
    """WITH span AS (SELECT c_custkey, TIMESTAMP '1995-01-01' + CAST(c_custkey % 900 AS INT) * INTERVAL 1 DAY AS valid_from,
              CASE WHEN c_custkey % 3 = 0 THEN NULL
                   ELSE TIMESTAMP '1997-01-01' + CAST(c_custkey % 700 AS INT) * INTERVAL 1 DAY END AS valid_to FROM customer)
       SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM span WHERE c_custkey = o_custkey
         AND o_orderdate >= valid_from AND (valid_to IS NULL OR o_orderdate < valid_to))""",
)
def temporal(t: Frames):
    span = t.sql(
        """SELECT c_custkey, TIMESTAMP_NTZ '1995-01-01' + CAST(c_custkey % 900 AS INT) * INTERVAL '1' DAY AS valid_from,
             CASE WHEN c_custkey % 3 = 0 THEN NULL
                  ELSE TIMESTAMP_NTZ '1997-01-01' + CAST(c_custkey % 700 AS INT) * INTERVAL '1' DAY END AS valid_to
           FROM {customer}"""
    )
    cond = Condition(
        dependent="span",
        foreign_key="o_custkey",
        primary_key="c_custkey",
        event_time="o_orderdate",
        valid_from="valid_from",
        valid_to="valid_to",
    )
    return t.orders.where(P.condition(cond, t.orders.schema, tables={"span": span})).select("o_orderkey")


# A third of the orders and a third of the spans share one key; spans of it overlap in many ways.
HOT_SPANS = """SELECT CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey END AS k,
    {stamp} '1992-06-01' + CAST(c_custkey * 37 % 2300 AS INT) * INTERVAL '1' DAY AS valid_from,
    CASE WHEN c_custkey % 41 = 7 THEN NULL ELSE {stamp} '1992-06-01' + CAST(c_custkey * 37 % 2300 + c_custkey % 30 - 3 AS INT)
      * INTERVAL '1' DAY END AS valid_to FROM {customer}"""
HOT_ORDERS = "SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS k FROM {orders}"


@query(
    "j4_interval_sweep",
    f"""WITH span AS ({HOT_SPANS.format(stamp="TIMESTAMP", customer="customer")}), o AS ({HOT_ORDERS.format(orders="orders")})
       SELECT o_orderkey, k FROM o WHERE EXISTS (SELECT 1 FROM span WHERE span.k = o.k
         AND o_orderdate >= valid_from AND (valid_to IS NULL OR o_orderdate < valid_to))""",
)
def interval_sweep(t: Frames):
    spans = t.sql(HOT_SPANS.replace("{stamp}", "TIMESTAMP_NTZ"))
    return valid_at(t.sql(HOT_ORDERS), spans, [("k", "k")], "o_orderdate", "valid_from", "valid_to").select("o_orderkey", "k")


@query(
    "j4_outside_intervals",
    f"""WITH span AS ({HOT_SPANS.format(stamp="TIMESTAMP", customer="customer")}), o AS ({HOT_ORDERS.format(orders="orders")})
       SELECT o_orderkey, k FROM o WHERE NOT EXISTS (SELECT 1 FROM span WHERE span.k = o.k
         AND o_orderdate >= valid_from AND (valid_to IS NULL OR o_orderdate < valid_to))""",
)
def outside_intervals(t: Frames):
    spans = t.sql(HOT_SPANS.replace("{stamp}", "TIMESTAMP_NTZ"))
    rows = valid_at(t.sql(HOT_ORDERS), spans, [("k", "k")], "o_orderdate", "valid_from", "valid_to", negate=True)
    return rows.select("o_orderkey", "k")


@query(
    "j5_child_lists",
    """WITH k AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderpriority < '4'),
          c AS (SELECT l_orderkey, count(*) AS n, string_agg(CAST(l_partkey AS VARCHAR), ','
                  ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem WHERE l_quantity > 25 GROUP BY 1)
       SELECT o_orderkey, coalesce(n, 0) AS children, coalesce(parts, '') AS parts FROM k
         LEFT JOIN c ON l_orderkey = o_orderkey""",
)
def child_lists(t: Frames):
    rows = J.child_lists(
        t.orders.where("o_orderpriority < '4'"),
        t.lineitem.where("l_quantity > 25"),
        "o_orderkey",
        "l_orderkey",
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"),
        ["l_linenumber", "l_partkey"],
    )
    return rows.select(
        "o_orderkey",
        F.size("items").cast("long").alias("children"),
        F.array_join(F.transform("items", lambda x: x["l_partkey"].cast("string")), ",").alias("parts"),
    )


@query(
    "j5_child_lists_hot_keys",
    """SELECT n_nationkey, count(c_custkey) AS children, CAST(sum(c_custkey) AS BIGINT) AS key_sum
       FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey""",
)
def hot_lists(t: Frames):
    # Few keys with many children each: the lists come in bounded parts.
    parts = J.child_lists(
        t.nation, t.customer, "n_nationkey", "c_nationkey", F.col("c_custkey"), ["c_custkey"], list_rows=20
    )
    return parts.groupBy("n_nationkey").agg(
        F.sum(F.size("items")).alias("children"),
        F.sum(F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x["c_custkey"])).alias("key_sum"),
    )


@query(
    "j5_single_child",
    """SELECT c_custkey, min(o_orderkey) AS first_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey
       GROUP BY c_custkey""",
)
def single_child(t: Frames):
    rows = J.first_child(t.customer, t.orders, "c_custkey", "o_custkey", ["o_orderkey"])
    return rows.select("c_custkey", F.col("item.o_orderkey").alias("first_order"))


@query(
    "a15_dispatch_counts",
    "SELECT count(DISTINCT o_custkey) AS distinct_keys, CAST(ceil(count(DISTINCT o_custkey) / 500) AS BIGINT) AS batches FROM orders",
)
def dispatch(t: Frames):
    return J.dispatch_counts(t.orders, "o_custkey", 500)


def _edges(t: Frames):
    return t.sql(
        """SELECT 'nation-' || n_nationkey AS src, 'region-' || n_regionkey AS dst FROM {nation}
           UNION ALL SELECT 'customer-' || c_custkey, 'nation-' || c_nationkey FROM {customer}
           UNION ALL SELECT 'order-' || o_orderkey, 'customer-' || o_custkey FROM {orders}"""
    )


@query(
    "j7_key_walk",
    """SELECT 'order-' || o_orderkey AS root, 'order-' || o_orderkey AS node, 0 AS depth FROM orders
       UNION ALL SELECT 'order-' || o_orderkey, 'customer-' || o_custkey, 1 FROM orders
       UNION ALL SELECT 'order-' || o_orderkey, 'nation-' || c_nationkey, 2 FROM orders JOIN customer ON c_custkey = o_custkey
       UNION ALL SELECT 'order-' || o_orderkey, 'region-' || n_regionkey, 3 FROM orders
         JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""",
)
def key_walk(t: Frames):
    start = t.orders.select(F.concat(F.lit("order-"), F.col("o_orderkey")).alias("node"))
    return J.key_walk(_edges(t), start, max_depth=4)


@query(
    "j7_relations_of",
    """WITH r AS (SELECT DISTINCT l_partkey AS parent_table_id, l_suppkey AS child_table_id FROM lineitem),
            w AS (SELECT p_partkey AS table_id FROM part WHERE p_size = 11)
       SELECT * FROM r WHERE parent_table_id IN (SELECT table_id FROM w) OR child_table_id IN (SELECT table_id FROM w)""",
)
def relations(t: Frames):
    edges = t.lineitem.select(
        F.col("l_partkey").alias("parent_table_id"), F.col("l_suppkey").alias("child_table_id")
    ).distinct()
    wanted = t.part.where("p_size = 11").select(F.col("p_partkey").alias("table_id"))
    return J.relations_of(edges, wanted)

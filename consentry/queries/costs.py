"""Cost accounting and privacy."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from consentry.operators import finops as C
from consentry.operators import privacy as P
from consentry.queries.base import Frames, query
from consentry.queries.masks import duck_hmac
from consentry.sinks.export import focus_lines

# Half-even rounding in whole millionths, in integers: prices are whole hundred-millionths.
COST = """cost AS (SELECT *, prompt_tokens * 300 + completion_tokens * 1500 + compute_ms * 10 AS h FROM usage),
    billed AS (SELECT *, CAST(h // 100 + CASE WHEN h % 100 > 50 OR (h % 100 = 50 AND (h // 100) % 2 = 1) THEN 1 ELSE 0 END
      AS BIGINT) AS micros FROM cost)"""


@query(
    "a11_billed_cost",
    f"""WITH {COST} SELECT event_id, micros, CASE WHEN prompt_tokens + completion_tokens > 0 THEN 'Tokens' ELSE 'Milliseconds' END
          AS unit, coalesce(category, CASE WHEN prompt_tokens + completion_tokens > 0 THEN 'AI-Inference' ELSE 'DatabaseCompute' END)
          AS category, CASE WHEN prompt_tokens + completion_tokens > 0 THEN prompt_tokens + completion_tokens ELSE compute_ms END
          AS quantity, tenant AS account FROM billed""",
)
def billed(t: Frames):
    rows = C.cost_records(t.usage.withColumn("tags", F.create_map(F.lit("id"), F.col("event_id").cast("string"))))
    return rows.select(
        F.col("Tags")["id"].cast("long").alias("event_id"),
        (F.col("BilledCost") * 1000000).cast("long").alias("micros"),
        F.col("ConsumedUnit").alias("unit"),
        F.col("PricingCategory").alias("category"),
        F.col("ConsumedQuantity").alias("quantity"),
        F.col("SubAccountId").alias("account"),
    )


@query(
    "k3_focus_csv",
    f"""WITH {COST} SELECT event_id, '"' || strftime("at", '%Y-%m-%dT%H:%M:%S.%f') || 'Z",' || printf('%.6f', micros / 1e6) || ','
          || printf('%.6f', micros / 1e6) || ',"EUR",' || CASE WHEN prompt_tokens + completion_tokens > 0
          THEN prompt_tokens + completion_tokens ELSE compute_ms END || ',"'
          || CASE WHEN prompt_tokens + completion_tokens > 0 THEN 'Tokens' ELSE 'Milliseconds' END || '","' || tenant || '","''=' || operation
          || '","DataGateway","' || coalesce(category, CASE WHEN prompt_tokens + completion_tokens > 0 THEN 'AI-Inference'
          ELSE 'DatabaseCompute' END) || '"' AS line FROM billed""",
)
def focus_csv(t: Frames):
    # The operation starts like a formula; the first column is compared elsewhere.
    usage = t.usage.withColumn("operation", F.concat(F.lit("="), "operation"))
    rows = C.cost_records(usage.withColumn("tags", F.create_map(F.lit("id"), F.col("event_id").cast("string"))))
    named = rows.withColumn("ChargePeriodStart", F.col("Tags")["id"])
    lines = focus_lines(named)
    return lines.select(
        F.regexp_extract("line", r'^"(\d+)"', 1).cast("long").alias("event_id"),
        F.regexp_replace("line", r'^"\d+",', "").alias("line"),
    )


@query(
    "a12_budget_status",
    f"""WITH {COST}, s AS (SELECT tenant, CAST(sum(micros) / 1e6 AS DOUBLE) AS spend FROM billed GROUP BY tenant),
          b(t, budget) AS (VALUES ('tenant-0', 5.0), ('tenant-1', 0.0), ('tenant-2', 60.0)),
          l AS (SELECT tenant, spend, CAST(coalesce(b.budget, 1000) AS DOUBLE) AS budget FROM s LEFT JOIN b ON b.t = s.tenant)
        SELECT tenant, round(spend, 6) AS spend, budget, CASE WHEN budget <= 0 THEN 'UNLIMITED' WHEN spend >= budget THEN 'EXCEEDED'
          WHEN spend >= budget * 0.8 THEN 'WARNING' ELSE 'OK' END AS status FROM l""",
)
def budgets(t: Frames):
    limits = t.spark.createDataFrame(
        [("TENANT-0", 5.0), ("tenant-1", 0.0), ("tenant-2", 60.0)], "tenant string, budget double"
    )
    return C.budget_status(C.cost_records(t.usage), limits).withColumn("spend", F.round("spend", 6))


@query(
    "a13_records_in_period",
    """SELECT tenant AS account, count(*) AS n FROM usage WHERE "at" >= TIMESTAMP '2024-01-03' AND "at" <= TIMESTAMP '2024-01-09 12:00:00'
         AND tenant = 'tenant-3' GROUP BY tenant""",
)
def period(t: Frames):
    rows = C.records_in_period(
        C.cost_records(t.usage), dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 9, 12), "TENANT-3"
    )
    return rows.groupBy(F.col("SubAccountId").alias("account")).agg(F.count("*").alias("n"))


@query(
    "a14_private_sums",
    """SELECT l_suppkey, l_returnflag, count(*) < 190 AS suppressed,
              CASE WHEN count(*) >= 190 THEN CAST(0.5 AS DOUBLE) ELSE 0.0 END AS epsilon_spent FROM lineitem GROUP BY ALL""",
)
def private(t: Frames):
    rows = P.private_sums(
        t.lineitem, ["l_suppkey", "l_returnflag"], "l_quantity", 0.5, 50.0, min_cohort=190, seed=11
    )
    # The noisy value differs by design; what can be compared is who is suppressed.
    return rows.drop("value")


@query(
    "a14_private_values",
    "SELECT l_returnflag, TRUE AS near, TRUE AS noisy, CAST(0.5 AS DOUBLE) AS epsilon_spent FROM lineitem GROUP BY l_returnflag",
)
def private_values(t: Frames):
    # The scale of the noise is 100: it stays below 25 times that but for one case in 10**10, and is never nothing.
    rows = P.private_sums(t.lineitem, ["l_returnflag"], "l_quantity", 0.5, 50.0, seed=11)
    exact = t.lineitem.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("exact"))
    off = F.abs(F.col("value") - F.col("exact"))
    return rows.join(exact, "l_returnflag").select(
        "l_returnflag", (off <= 2500).alias("near"), (off > 0).alias("noisy"), "epsilon_spent"
    )


RELEASE_KEY = b"release-key-for-registered-queries"


# A client's three groups with the smallest keyed hashes, each amount at most 60.
CHOSEN = f"""each AS (SELECT l_suppkey, l_partkey % 40 AS shelf, sum(l_quantity) AS amount FROM lineitem GROUP BY ALL),
       ranked AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY
           {duck_hmac("encode('choice|' || l_suppkey || '|' || shelf)", RELEASE_KEY)}) AS n FROM each),
       chosen AS (SELECT l_suppkey, shelf, CAST(least(amount, 60) AS DOUBLE) AS amount FROM ranked WHERE n <= 3)"""


def _shelves(t: Frames):
    return t.lineitem.select("l_suppkey", (F.col("l_partkey") % 40).alias("shelf"), "l_quantity")


@query("a14_contributions", f"WITH {CHOSEN} SELECT l_suppkey, shelf, amount FROM chosen")
def bounded(t: Frames):
    return P.contributions(_shelves(t), ["shelf"], "l_suppkey", "l_quantity", RELEASE_KEY, 3, 60.0)


@query(
    "a14_private_client_sums",
    f"""WITH {CHOSEN}, g AS (SELECT shelf, count(*) AS n, sum(amount) AS total,
             (CAST('0x' || left({duck_hmac("encode('noise|2024|' || shelf)", RELEASE_KEY)}, 13) AS BIGINT) + 0.5::DOUBLE)
               / 4503599627370496::DOUBLE - 0.5::DOUBLE AS u FROM chosen GROUP BY shelf)
       SELECT shelf, n < 5 AS suppressed, CASE WHEN n >= 5 THEN round(total - 360 * sign(u) * ln(1 - 2 * abs(u)), 4) END AS value,
              CASE WHEN n >= 5 THEN CAST(0.5 AS DOUBLE) ELSE 0.0 END AS epsilon_spent FROM g""",
)
def client_sums(t: Frames):
    return P.private_client_sums(_shelves(t), ["shelf"], "l_suppkey", "l_quantity", 0.5, 60.0, RELEASE_KEY, "2024", most=3)


SPENDS = """SELECT event_id AS id, user_id AS client, ts AS at,
    CASE event_id % 4 WHEN 0 THEN 5.0 WHEN 1 THEN 3.5 WHEN 2 THEN 0.75 ELSE 2.5 END AS epsilon FROM {events}"""


@query(
    "w5_privacy_ledger",
    f"""WITH RECURSIVE s AS ({SPENDS.format(events="events")}),
          o AS (SELECT *, CAST("at" AS DATE) AS day, row_number() OVER (PARTITION BY client, CAST("at" AS DATE) ORDER BY "at", id) AS n FROM s),
          f AS (SELECT client, day, n, id, CAST(epsilon AS DOUBLE) AS spent, TRUE AS accepted FROM o WHERE n = 1
            UNION ALL
            SELECT o.client, o.day, o.n, o.id, CASE WHEN f.spent + o.epsilon <= 10 THEN f.spent + o.epsilon ELSE f.spent END,
              f.spent + o.epsilon <= 10 FROM f JOIN o ON o.client = f.client AND o.day = f.day AND o.n = f.n + 1)
        SELECT id, client, accepted FROM f""",
)
def ledger(t: Frames):
    # Clients fold together, so that many requests of one day are refused.
    return P.privacy_ledger(t.sql(SPENDS)).select("id", "client", "accepted")


@query(
    "w5_privacy_ledger_hot",
    f"""WITH RECURSIVE s AS ({SPENDS.format(events="events")}),
          o AS (SELECT *, CAST("at" AS DATE) AS day, row_number() OVER (PARTITION BY CAST("at" AS DATE) ORDER BY "at", id) AS n FROM s),
          f AS (SELECT day, n, id, CAST(epsilon AS DOUBLE) AS spent, TRUE AS accepted FROM o WHERE n = 1
            UNION ALL
            SELECT o.day, o.n, o.id, CASE WHEN f.spent + o.epsilon <= 10 THEN f.spent + o.epsilon ELSE f.spent END,
              f.spent + o.epsilon <= 10 FROM f JOIN o ON o.day = f.day AND o.n = f.n + 1)
        SELECT id, accepted FROM f""",
)
def hot_ledger(t: Frames):
    one = t.sql(SPENDS).withColumn("client", F.lit("everyone"))
    return P.privacy_ledger(one).select("id", "accepted")

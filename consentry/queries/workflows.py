"""Approvals, requests, activation, tenant backfill."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from consentry.operators import audit as A
from consentry.operators import workflow as W
from consentry.queries.base import Frames, query

NOW_SQL = "TIMESTAMP '1998-01-01'"


def now():
    return F.lit(dt.datetime(1998, 1, 1)).cast("timestamp_ntz")


def _authorised(t: Frames):
    owners = t.supplier.select(
        F.col("s_suppkey").alias("owner_id"), F.col("s_name").alias("owner_sid"), (F.col("s_acctbal") > 0).alias("is_active")
    )
    owned = t.lineitem.select(
        (F.col("l_partkey") % 701).alias("table_id"), F.col("l_suppkey").alias("owner_id")
    ).where("table_id % 10 = owner_id % 10").distinct()
    delegations = t.orders.select(
        (F.col("o_custkey") % 100).alias("owner_id"),
        F.concat(F.lit("deputy-"), F.col("o_custkey").cast("string")).alias("delegate_sid"),
        F.col("o_orderdate").alias("valid_from"),
        (F.col("o_orderdate") + F.expr("INTERVAL '20' DAY")).alias("valid_to"),
    )
    role = (
        F.when(F.col("r_name") == "ASIA", "GovernanceAdmin")
        .when(F.col("r_name") == "EUROPE", "ClusterAdmin")
        .otherwise(F.col("r_name"))
    )
    roles = t.region.select(F.col("r_regionkey").alias("role_id"), role.alias("role_name"))
    members = t.nation.select(
        F.col("n_regionkey").alias("role_id"), F.concat(F.lit("member-"), "n_name").alias("member_sid")
    )
    return W.approvers(owners, owned, delegations, W.admin_members(roles, members), now())


APPROVERS = f"""owned AS (SELECT DISTINCT l_partkey % 701 AS table_id, l_suppkey AS owner_id FROM lineitem
      WHERE (l_partkey % 701) % 10 = l_suppkey % 10),
   act AS (SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0),
   approvers AS (SELECT table_id, s_name AS approver_sid FROM owned JOIN act ON s_suppkey = owner_id
     UNION SELECT table_id, 'deputy-' || o_custkey FROM owned JOIN orders ON o_custkey % 100 = owner_id
       WHERE o_orderdate <= {NOW_SQL} AND {NOW_SQL} < o_orderdate + INTERVAL 20 DAY
     UNION SELECT NULL, 'member-' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey
       WHERE r_name IN ('ASIA', 'EUROPE'))"""


@query("j10_approvers", f"WITH {APPROVERS} SELECT table_id, approver_sid FROM approvers")
def approvers(t: Frames):
    return _authorised(t)


@query(
    "u1_distinct_approvers",
    f"WITH {APPROVERS} SELECT approver_sid, count(*) AS tables FROM approvers GROUP BY approver_sid",
)
def distinct_approvers(t: Frames):
    return _authorised(t).groupBy("approver_sid").agg(F.count("*").alias("tables"))


@query(
    "j11_pending_requests",
    f"""WITH {APPROVERS} SELECT request_id, r.table_id, status, c.domain FROM requests r
          LEFT JOIN catalog_tables c ON c.table_id = r.table_id
        WHERE status IN ('PENDING', 'PENDING_SECOND_APPROVAL') AND r.table_id IN (SELECT table_id FROM approvers
          WHERE approver_sid = 'Supplier#000000007')""",
)
def pending(t: Frames):
    rows = W.pending_for_approver(t.requests, t.catalog_tables, _authorised(t), "Supplier#000000007")
    return rows.select("request_id", "table_id", "status", "domain")


VOTES = """v AS (SELECT s.request_id, s.approver_sid, bool_or(decision = 'REJECTED') AS rej, bool_or(decision = 'APPROVED') AS app,
      min(decided_at) AS first FROM steps s JOIN requests r ON r.request_id = s.request_id
      WHERE s.approver_sid <> r.requester_sid GROUP BY ALL),
   n AS (SELECT request_id, count(*) FILTER (app) AS approvals, bool_or(rej) AS rejected FROM v GROUP BY request_id)"""


@query(
    "w3_approval_status",
    f"""WITH {VOTES} SELECT r.request_id, r.four_eyes, CASE WHEN coalesce(rejected, FALSE) THEN 'REJECTED'
          WHEN coalesce(approvals, 0) >= CASE WHEN four_eyes THEN 2 ELSE 1 END THEN 'APPROVED'
          WHEN coalesce(approvals, 0) > 0 THEN 'PENDING_SECOND_APPROVAL' ELSE 'PENDING' END AS status,
          coalesce(approvals, 0) + 1 AS next_step FROM requests r LEFT JOIN n ON n.request_id = r.request_id""",
)
def approval(t: Frames):
    requests = t.requests.select("request_id", "requester_sid", "four_eyes")
    return A.approval_status(requests, t.steps).drop("requester_sid")


@query(
    "w3_authorised_approvals",
    f"""WITH {APPROVERS}, {VOTES.replace("WHERE s.approver_sid <> r.requester_sid",
          "WHERE s.approver_sid <> r.requester_sid AND (r.table_id, s.approver_sid) IN (SELECT table_id, replace(approver_sid, 'deputy-', 'user-') FROM approvers WHERE table_id IS NOT NULL)")}
        SELECT CASE WHEN coalesce(rejected, FALSE) THEN 'REJECTED'
          WHEN coalesce(approvals, 0) >= CASE WHEN four_eyes THEN 2 ELSE 1 END THEN 'APPROVED'
          WHEN coalesce(approvals, 0) > 0 THEN 'PENDING_SECOND_APPROVAL' ELSE 'PENDING' END AS status, count(*) AS n
        FROM requests r LEFT JOIN n ON n.request_id = r.request_id GROUP BY 1""",
)
def authorised_approvals(t: Frames):
    # Votes of people who may not approve the table do not count.
    may = _authorised(t).withColumn("approver_sid", F.replace("approver_sid", F.lit("deputy-"), F.lit("user-")))
    requests = t.requests.select("request_id", "requester_sid", "four_eyes", "table_id")
    return A.approval_status(requests, t.steps, authorised=may).groupBy("status").agg(F.count("*").alias("n"))


@query(
    "w3_approval_steps",
    """WITH f AS (SELECT request_id, approver_sid, min(decided_at) AS decided_at FROM steps GROUP BY ALL)
       SELECT request_id, approver_sid, row_number() OVER (PARTITION BY request_id ORDER BY decided_at, approver_sid) AS step_number
       FROM f""",
)
def steps(t: Frames):
    return A.approval_steps(t.steps).select("request_id", "approver_sid", "step_number")


@query(
    "g7_decision_report",
    """SELECT requester_sid, table_id, status, count(*) AS requests, max(requested_at) AS last_requested
       FROM requests GROUP BY requester_sid, table_id, status""",
)
def report(t: Frames):
    return W.decision_report(t.requests)


@query(
    "g9_activate_requests",
    f"""SELECT request_id AS consent_request_id, table_id, 'ALLOW' AS effect, CASE WHEN grantee_type <> 'ROLE' THEN grantee END
          AS grantee_sid, CASE WHEN grantee_type = 'ROLE' THEN grantee END AS role_name, {NOW_SQL} AS valid_from,
          requested_valid_to AS valid_to FROM requests WHERE status LIKE 'PENDING%'""",
)
def activate(t: Frames):
    consents, _ = W.activate(t.requests, now())
    return consents.drop("grantee_type", "tenant_id")


@query(
    "g9_request_status",
    """SELECT CASE WHEN status LIKE 'PENDING%' THEN 'ACTIVE' ELSE status END AS status, count(*) AS n FROM requests GROUP BY 1""",
)
def statuses(t: Frames):
    _, updated = W.activate(t.requests, now())
    return updated.groupBy("status").agg(F.count("*").alias("n"))


@query(
    "g10_tenant_backfill",
    """SELECT CASE WHEN trim(coalesce(tenant_id, '')) IN ('', 'default', 'legacy-default') THEN 'legacy-single-tenant'
         ELSE tenant_id END AS tenant_id, count(*) AS n FROM requests GROUP BY 1""",
)
def backfill(t: Frames):
    return W.backfill_tenant(t.requests).groupBy("tenant_id").agg(F.count("*").alias("n"))


@query(
    "g10_unmigrated",
    """SELECT count(*) FILTER (trim(coalesce(tenant_id, '')) IN ('', 'default', 'legacy-default')) AS unmigrated FROM requests""",
)
def unmigrated(t: Frames):
    return W.unmigrated(t.requests)

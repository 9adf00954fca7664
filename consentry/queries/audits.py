"""Audit log, hash chains, policies over the log, lineage."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from consentry.functions.crypto import key_pads
from consentry.functions.text import client_type, is_ticket
from consentry.operators import abac as B
from consentry.operators import audit as A
from consentry.operators import lineage as L
from consentry.operators import merkle as M
from consentry.operators.ordering import latest_per_key
from consentry.queries.base import DERIVED, Frames, query
from consentry.session import checked_broadcast, durable, scratch_path
from consentry.sources.tables import stream_files

KEY = b"audit-key-for-registered-queries"
SEGMENT = 64

CLIENT = """CASE WHEN contains(lower(actor_sid), 'svc') OR lower(actor_sid) LIKE 'sp-%'
      OR contains(lower(actor_sid), 'serviceprincipal') OR contains(lower(actor_sid), 'batch') THEN 'ServicePrincipal'
    WHEN contains(lower(actor_sid), 'dash') OR contains(lower(actor_sid), 'bi') THEN 'DownstreamSystem'
    ELSE 'InteractiveUser' END"""


@query(
    "s14_audit_read",
    """SELECT id, actor_sid, target_table FROM audit WHERE tenant_id = 'tenant-1'
         AND occurred_at >= TIMESTAMP '2024-01-05' ORDER BY occurred_at DESC, id DESC LIMIT 700""",
)
def read(t: Frames):
    rows = A.read_log(t.audit, tenant="tenant-1", since=dt.datetime(2024, 1, 5), limit=700)
    return rows.select("id", "actor_sid", "target_table")


def _duck_hmac(text: str) -> str:
    inner, outer = key_pads(KEY)
    return f"upper(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({text})))))"


# The chain, entry after entry; every segment starts from its own anchor.
CHAIN = f"""RECURSIVE numbered AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY occurred_at, id) AS n FROM audit),
  parts AS (SELECT tenant_id, n, (n - 1) // {SEGMENT} AS segment, id,
      'v2|' || n || '|' || id || '|' AS head,
      '|' || strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%f') || '0+00:00|' || event_type || '|' || actor_sid || '|'
        || target_table || '|' || coalesce(target_column, '') || '|' || decision || '|'
        || replace(trace_id, '|', '\\|') || '|' || coalesce(details_json, '') || '|' || tenant_id AS tail
    FROM numbered),
  anchors AS (SELECT DISTINCT tenant_id, segment,
      {_duck_hmac("'anchor|' || tenant_id || '|' || segment")} AS anchor FROM parts),
  links AS (
    SELECT p.tenant_id, p.n, p.segment, p.id, a.anchor AS prev_hash, {_duck_hmac("head || a.anchor || tail")} AS entry_hash
      FROM parts p JOIN anchors a ON a.tenant_id = p.tenant_id AND a.segment = p.segment
      WHERE (p.n - 1) % {SEGMENT} = 0
    UNION ALL
    SELECT p.tenant_id, p.n, p.segment, p.id, l.entry_hash, {_duck_hmac("head || l.entry_hash || tail")}
      FROM links l JOIN parts p ON p.tenant_id = l.tenant_id AND p.segment = l.segment AND p.n = l.n + 1)"""


def _chained(t: Frames):
    """The log as it lies on disk."""
    return durable(A.append_chain(t.audit, KEY, segment_rows=SEGMENT), "log")


@query("k6_append_chain", f"WITH {CHAIN} SELECT tenant_id, n AS seq, id, prev_hash, entry_hash FROM links")
def append(t: Frames):
    return A.append_chain(t.audit, KEY, segment_rows=SEGMENT).select("tenant_id", "seq", "id", "prev_hash", "entry_hash")


@query("k6_append_stream", f"WITH {CHAIN} SELECT tenant_id, n AS seq, id, prev_hash, entry_hash FROM links")
def append_stream(t: Frames):
    events = stream_files(t.spark, t.path("events"))
    log = t.sql(DERIVED["audit"], events=events)
    root = scratch_path(t.spark, "audit-log")
    A.append_stream(log, root, KEY, segment_rows=SEGMENT).awaitTermination()
    return t.spark.read.parquet(f"{root}/log").select("tenant_id", "seq", "id", "prev_hash", "entry_hash")


@query(
    "w1_verify_chain",
    """WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY occurred_at, id) AS n FROM audit),
         bad AS (SELECT tenant_id, n, decision FROM numbered WHERE id % 997 = 3)
       SELECT tenant_id, n AS seq, 'TAMPERED' AS problem FROM bad""",
)
def verify(t: Frames):
    # Some entries are changed after they were written.
    forged = _chained(t).withColumn(
        "decision", F.when(F.col("id") % 997 == 3, "FORGED").otherwise(F.col("decision"))
    )
    return A.verify_chain(forged, KEY, segment_rows=SEGMENT)


@query(
    "w1_verify_deleted",
    f"""WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY occurred_at, id) AS n FROM audit),
         kept AS (SELECT * FROM numbered WHERE id % 501 <> 7)
       SELECT k.tenant_id, k.n AS seq, 'GAP' AS problem FROM kept k WHERE k.n > 1
         AND NOT EXISTS (SELECT 1 FROM kept p WHERE p.tenant_id = k.tenant_id AND p.n = k.n - 1)""",
)
def verify_deleted(t: Frames):
    kept = _chained(t).where(F.col("id") % 501 != 7)
    return A.verify_chain(kept, KEY, segment_rows=SEGMENT)


_NUMBERED = """SELECT tenant_id, id, row_number() OVER (PARTITION BY tenant_id ORDER BY occurred_at, id) AS n,
       count(*) OVER (PARTITION BY tenant_id) AS total FROM audit"""


@query(
    "w1_lost_segment",
    f"""WITH numbered AS ({_NUMBERED}) SELECT tenant_id, n AS seq, 'GAP' AS problem FROM numbered
        WHERE n = {2 * SEGMENT + 1}""",
)
def lost_segment(t: Frames):
    # The second segment of every chain is gone, and of one chain the first as well: its rest has no beginning.
    kept = _chained(t).where(f"segment <> 1 AND NOT (tenant_id = 'tenant-1' AND segment = 0)")
    return A.verify_chain(kept, KEY, segment_rows=SEGMENT)


@query(
    "w1_lost_tail",
    f"""WITH numbered AS ({_NUMBERED}) SELECT DISTINCT tenant_id, total AS seq, 'LOST_TAIL' AS problem FROM numbered""",
)
def lost_tail(t: Frames):
    log = _chained(t)
    tails = durable(A.signed_tails(A.chain_tails(log), KEY), "tails")
    # The last 11 entries of every chain are gone, and one chain altogether.
    cut = log.join(checked_broadcast(tails.select("tenant_id", "last_seq")), "tenant_id").where("seq <= last_seq - 11 AND tenant_id <> 'tenant-2'")
    return A.verify_chain(cut.drop("last_seq"), KEY, segment_rows=SEGMENT, tails=tails)


@query(
    "w1_repeated_entries",
    f"""WITH numbered AS ({_NUMBERED}) SELECT tenant_id, n AS seq, 'REPEATED' AS problem FROM numbered WHERE id % 499 = 5""",
)
def repeated_entries(t: Frames):
    log = _chained(t)
    return A.verify_chain(log.unionByName(log.where("id % 499 = 5")), KEY, segment_rows=SEGMENT)


@query(
    "w2_gaps_at_the_ends",
    f"""WITH numbered AS ({_NUMBERED}) SELECT DISTINCT tenant_id, CAST(1 AS BIGINT) AS missing_from, CAST(4 AS BIGINT) AS missing_to
        FROM numbered UNION ALL SELECT DISTINCT tenant_id, total - 2, total FROM numbered""",
)
def gaps_at_the_ends(t: Frames):
    log = _chained(t)
    tails = A.chain_tails(log)
    kept = log.join(tails, "tenant_id").where("seq > 4 AND seq < last_seq - 2").select("tenant_id", "seq")
    return A.chain_gaps(kept, tails=tails)


@query(
    "w2_chain_gaps",
    """WITH kept AS (SELECT tenant_id, seq FROM audit WHERE id % 7 < 4 AND id % 31 <> 5
           UNION ALL SELECT DISTINCT tenant_id, 0 FROM audit WHERE id % 7 < 4 AND id % 31 <> 5),
         n AS (SELECT tenant_id, seq, lead(seq) OVER (PARTITION BY tenant_id ORDER BY seq) AS nx FROM kept)
       SELECT tenant_id, seq + 1 AS missing_from, nx - 1 AS missing_to FROM n WHERE nx > seq + 1""",
)
def gaps(t: Frames):
    return A.chain_gaps(t.audit.where("id % 7 < 4 AND id % 31 <> 5"))


@query(
    "k4_audit_snapshot",
    f"""WITH {CHAIN} SELECT tenant_id, segment, count(*) AS entries, min(n) AS first_seq, max(n) AS last_seq,
          arg_min(prev_hash, n) AS root_hash, arg_max(entry_hash, n) AS final_hash,
          sha256(string_agg(n || ':' || entry_hash, chr(10) ORDER BY n)) AS payload_sha256,
          CAST(0 AS BIGINT) AS violations, TRUE AS complete FROM links GROUP BY tenant_id, segment""",
)
def snapshot(t: Frames):
    return A.snapshot(_chained(t), KEY, segment_rows=SEGMENT)


@query(
    "k4_snapshot_export",
    f"""WITH {CHAIN} SELECT l.tenant_id, segment, count(*) AS entries, min(n) AS first_seq, max(n) AS last_seq,
          min(a.occurred_at) AS first_at, max(a.occurred_at) AS last_at
        FROM links l JOIN audit a ON a.id = l.id
        WHERE a.occurred_at >= TIMESTAMP '2024-01-05' AND a.occurred_at < TIMESTAMP '2024-01-20' GROUP BY l.tenant_id, segment""",
)
def snapshot_export(t: Frames):
    log = _chained(t)
    tails = A.signed_tails(A.chain_tails(log), KEY)
    path = scratch_path(t.spark, "snapshot")
    at = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20)
    manifest = A.export_snapshot(log, KEY, path, *at, segment_rows=SEGMENT, tails=tails)
    return manifest.drop("payload_sha256")


@query(
    "k4_segment_heads",
    f"""WITH {CHAIN} SELECT tenant_id, segment, min(n) AS first_seq, max(n) AS last_seq, count(*) AS entries,
          arg_max(entry_hash, n) AS head_hash FROM links GROUP BY tenant_id, segment""",
)
def heads(t: Frames):
    return A.segment_heads(_chained(t))


@query(
    "a3_runtime_consumers",
    f"""SELECT target_table, actor_sid, count(*) AS query_count, min(occurred_at) AS first_seen,
          max(occurred_at) AS last_seen, {CLIENT} AS client_type FROM audit WHERE decision = 'ALLOW' GROUP BY ALL""",
)
def consumers(t: Frames):
    return A.consumers(t.audit)


@query("t5_client_type", f"SELECT DISTINCT actor_sid, {CLIENT} AS client_type FROM audit")
def client(t: Frames):
    return t.audit.select("actor_sid").distinct().select(
        "actor_sid", client_type(F.col("actor_sid")).alias("client_type")
    )


@query(
    "l4_top_consumers",
    """SELECT actor_sid, count(*) AS n FROM audit WHERE decision = 'ALLOW' GROUP BY actor_sid
       ORDER BY n DESC, actor_sid LIMIT 5""",
)
def top_consumers(t: Frames):
    rows = t.audit.where("decision = 'ALLOW'").groupBy("actor_sid").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "actor_sid").limit(5)


@query(
    "a6_disclosure_report",
    f"""WITH a AS (SELECT *, nullif(lower(trim(target_column)), '') AS col FROM audit WHERE decision = 'ALLOW')
        SELECT target_table, actor_sid, count(*) AS total_queries, min(occurred_at) AS first_access,
          max(occurred_at) AS last_access, coalesce(string_agg(DISTINCT col, ',' ORDER BY col), '') AS columns,
          min(CASE col WHEN 'email' THEN 'email: MASK_EMAIL' WHEN 'iban' THEN 'iban: MASK_IBAN' END) AS applied_mask,
          {CLIENT} AS category FROM a GROUP BY target_table, actor_sid""",
)
def disclosure(t: Frames):
    names = t.audit.select("target_table").distinct()
    rules = names.select("target_table", F.lit("EMAIL").alias("column_name"), F.lit("MASK_EMAIL").alias("rule_type"))
    rules = rules.unionByName(
        names.select("target_table", F.lit("iban").alias("column_name"), F.lit("MASK_IBAN").alias("rule_type"))
    )
    return A.disclosure_report(t.audit, rules).withColumn("columns", F.array_join("columns", ","))


@query(
    "a7_sensitivity_categories",
    f"""SELECT table_id, CASE WHEN contains(coalesce(sensitivity, ''), 'ART9') OR four_eyes THEN
          '{A.SPECIAL_CATEGORY}' || CASE WHEN contains(coalesce(sensitivity, ''), 'PII') THEN ';{A.PERSONAL_CATEGORY}' ELSE '' END
          || CASE WHEN contains(coalesce(sensitivity, ''), 'HIGH') THEN ';{A.CONFIDENTIAL_CATEGORY}' ELSE '' END
        WHEN contains(coalesce(sensitivity, ''), 'PII') THEN '{A.PERSONAL_CATEGORY};{A.CONFIDENTIAL_CATEGORY}'
        ELSE '{A.STANDARD_CATEGORY}' END AS categories FROM catalog_tables""",
)
def categories(t: Frames):
    found = A.sensitivity_categories(F.col("sensitivity"), F.col("four_eyes"))
    return t.catalog_tables.select("table_id", F.array_join(found, ";").alias("categories"))


@query(
    "a9_table_telemetry",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS rn FROM events),
         p AS (SELECT event_type, quantile_disc(value, 0.99) AS p99_latency FROM r WHERE rn <= 500 GROUP BY event_type),
         c AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL),
         k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS rn FROM c),
         b AS (SELECT event_type, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY rn) AS top_consumers
               FROM k WHERE rn <= 5 GROUP BY event_type)
       SELECT e.event_type, count(*) AS total_queries, any_value(p99_latency) AS p99_latency,
              any_value(top_consumers) AS top_consumers
       FROM events e JOIN p ON p.event_type = e.event_type JOIN b ON b.event_type = e.event_type GROUP BY e.event_type""",
)
def telemetry(t: Frames):
    rows = A.table_telemetry(t.events, "event_type", "value", "ts", "user_id")
    return rows.withColumn(
        "top_consumers", F.array_join(F.transform("top_consumers", lambda x: x.cast("string")), ",")
    )


@query(
    "w4_latest_per_key",
    """SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER
         (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 50""",
)
def latest(t: Frames):
    rows = t.events.select("user_id", "event_id", "ts")
    return latest_per_key(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")], 50).select("user_id", "event_id")


@query(
    "t7_break_glass",
    """SELECT id, actor_sid, regexp_matches(upper(trim(justification)), '^(INC|CHG|SEC|REQ|PR)-[0-9]+$') AS has_ticket
       FROM audit WHERE event_type = 'break_glass'""",
)
def glass(t: Frames):
    return A.break_glass(t.audit, "justification").select("id", "actor_sid", "has_ticket")


@query(
    "t7_ticket_format",
    """SELECT regexp_matches(upper(justification), '^(INC|CHG|SEC|REQ|PR)-[0-9]+$') AS valid, count(*) AS n
       FROM audit GROUP BY ALL""",
)
def tickets(t: Frames):
    return t.audit.groupBy(is_ticket(F.col("justification")).alias("valid")).agg(F.count("*").alias("n"))


# Policy rules met with requests one by one, as a check of the keyed join.
MATCHED = """req AS (SELECT id, actor_sid, tenant_id, event_type, decision, target_table,
      CASE WHEN trim(target_table) = '' THEN '*' ELSE target_table END AS object,
      CASE WHEN contains(lower(event_type), 'write') THEN 'write' ELSE 'read' END AS action FROM audit),
   rx AS (SELECT *, CASE WHEN obj = '*' THEN '.*' WHEN lower(obj) = 'sales.dbo.*' THEN 'sales\\.dbo\\..+'
      WHEN obj = 'sales.dbo.t1*' THEN 'sales\\.dbo\\.t1[^.]*' WHEN obj = 'sales.:schema.t2' THEN 'sales\\.[^.]+\\.t2'
      WHEN obj LIKE 'sales.*.%' THEN 'sales\\.[^.]*\\.' || split_part(obj, '.', 3)
      ELSE replace(obj, '.', '\\.') END AS pattern FROM policy),
   dr AS (SELECT DISTINCT actor_sid, tenant_id, object, action FROM req),
   fit AS (SELECT object, pattern FROM (SELECT DISTINCT object FROM dr) o JOIN (SELECT DISTINCT pattern FROM rx) x
      ON regexp_full_match(lower(o.object), x.pattern)),
   who AS (SELECT DISTINCT actor_sid, lower(actor_sid) AS sub FROM dr UNION SELECT DISTINCT actor_sid, '*' FROM dr
      UNION SELECT sid, 'readers' FROM grouping),
   m AS (SELECT d.*, p.sub, p.tenant, p.obj, p.act, p.sub_rule, p.eft FROM dr d JOIN fit f ON f.object = d.object
      JOIN who w ON w.actor_sid = d.actor_sid JOIN rx p ON p.pattern = f.pattern AND lower(p.sub) = w.sub),
   verdict AS (SELECT d.actor_sid, d.tenant_id, d.object, d.action,
      coalesce(bool_or(m.eft = 'allow' AND m.tenant = d.tenant_id AND (m.act = '*' OR m.act = d.action)
          AND m.sub_rule = 'true') AND NOT bool_or(m.eft = 'deny' AND m.tenant = d.tenant_id), FALSE) AS allowed
      FROM dr d LEFT JOIN m ON m.actor_sid = d.actor_sid AND m.tenant_id = d.tenant_id
        AND m.object = d.object AND m.action = d.action GROUP BY ALL),
   sim AS (SELECT r.id, r.object, CASE WHEN r.decision = 'DENY' THEN 'DENY' ELSE 'ALLOW' END AS recorded,
      CASE WHEN v.allowed THEN 'ALLOW' ELSE 'DENY' END AS simulated FROM req r JOIN verdict v
      ON v.actor_sid = r.actor_sid AND v.tenant_id = r.tenant_id AND v.object = r.object AND v.action = r.action)"""


def _requests(t: Frames):
    return t.audit.select(
        F.col("actor_sid").alias("actor"),
        F.col("tenant_id").alias("tenant"),
        F.when(F.trim("target_table") == "", "*").otherwise(F.col("target_table")).alias("object"),
        F.when(F.lower("event_type").contains("write"), "write").otherwise("read").alias("action"),
    ).distinct()


@query(
    "p17_object_patterns",
    f"""WITH {MATCHED}, o AS (SELECT DISTINCT object FROM dr), p AS (SELECT DISTINCT obj, pattern FROM rx)
        SELECT object, obj FROM o JOIN p ON regexp_full_match(lower(object), pattern)""",
)
def patterns(t: Frames):
    # Every object against every pattern, with the subject left open.
    objects = _requests(t).select("object").distinct()
    requests = objects.withColumn("actor", F.concat(F.lit("reader of "), "object"))
    rules = t.policy.select("obj").distinct().withColumn("sub", F.lit("*"))
    matched = B.match_rules(requests, rules, t.grouping)
    return matched.select("object", "obj")


@query(
    "p17_rules_with_literal_parts",
    """WITH o AS (SELECT DISTINCT 'Sales.T' || l_partkey || 'x' || l_linenumber || '.v' || l_suppkey % 3 AS object FROM lineitem),
            p AS (SELECT 'sales.t' || p_partkey || 'x*.v*' AS obj FROM part UNION SELECT 'sales.*' || p_partkey || 'x1.:v' FROM part)
       SELECT obj, count(*) AS objects FROM o JOIN p ON lower(object) LIKE replace(replace(obj, '*', '%'), ':v', '%')
       GROUP BY obj""",
)
def literal_parts(t: Frames):
    # As many rules as parts, all with wildcards inside segments.
    text = lambda c: F.col(c).cast("string")
    name = F.concat(F.lit("Sales.T"), text("l_partkey"), F.lit("x"), text("l_linenumber"), F.lit(".v"), (F.col("l_suppkey") % 3).cast("string"))
    requests = t.lineitem.select(name.alias("object")).distinct()
    requests = requests.withColumn("actor", F.concat(F.lit("reader of "), "object"))
    starts = t.part.select(F.concat(F.lit("sales.t"), text("p_partkey"), F.lit("x*.v*")).alias("obj"))
    ends = t.part.select(F.concat(F.lit("sales.*"), text("p_partkey"), F.lit("x1.:v")).alias("obj"))
    rules = starts.unionByName(ends).withColumn("sub", F.lit("*"))
    return B.match_rules(requests, rules, t.grouping).groupBy("obj").agg(F.count("*").alias("objects"))


@query(
    "j12_policy_decision",
    f"""WITH {MATCHED} SELECT actor_sid AS actor, tenant_id AS tenant, object, action, allowed FROM verdict""",
)
def decisions(t: Frames):
    return B.evaluate(_requests(t), t.policy.withColumnRenamed("tenant", "rule_tenant"), t.grouping)


@query(
    "j13_role_membership",
    """SELECT g.sid, g.role, count(a.id) AS accesses FROM grouping g LEFT JOIN audit a ON a.actor_sid = g.sid GROUP BY ALL""",
)
def roles(t: Frames):
    counted = t.audit.groupBy(F.col("actor_sid").alias("sid")).agg(F.count("*").alias("n"))
    return t.grouping.join(counted, "sid", "left").select(
        "sid", "role", F.coalesce("n", F.lit(0)).alias("accesses")
    )


@query(
    "j13_role_closure",
    """WITH RECURSIVE e AS (SELECT sid AS src, role AS dst FROM grouping
         UNION SELECT 'readers', 'staff' FROM grouping UNION SELECT 'staff', 'everyone' FROM grouping),
       c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON e.src = c.dst)
       SELECT src AS sid, dst AS role FROM c WHERE src LIKE 'dash-%'""",
)
def role_closure(t: Frames):
    up = t.grouping.limit(1)
    ladder = up.select(F.lit("readers").alias("sid"), F.lit("staff").alias("role")).unionByName(
        up.select(F.lit("staff").alias("sid"), F.lit("everyone").alias("role"))
    )
    edges = B.role_closure_edges(t.grouping.unionByName(ladder))
    roots = t.grouping.select(F.col("sid").alias("node")).distinct()
    closed = L.downstream(edges, roots)
    return closed.select(F.col("root").alias("sid"), F.col("node").alias("role"))


def _replayed(t: Frames):
    return B.replay(t.audit, t.policy, t.grouping)


@query(
    "a8_policy_replay",
    f"""WITH {MATCHED} SELECT count(*) AS evaluated, count(*) FILTER (simulated = 'ALLOW') AS allowed,
          count(*) FILTER (simulated = 'DENY') AS denied,
          count(*) FILTER (recorded <> simulated AND simulated = 'DENY') AS newly_denied,
          count(*) FILTER (recorded <> simulated AND simulated = 'ALLOW') AS newly_allowed,
          round(count(*) FILTER (recorded <> simulated) * 100.0 / count(*), 2) AS impact_percent FROM sim""",
)
def replay(t: Frames):
    return B.replay_summary(_replayed(t))


@query(
    "a8_replay_by_table",
    f"""WITH {MATCHED} SELECT object, count(*) AS evaluated, count(*) FILTER (simulated = 'ALLOW') AS allowed,
          count(*) FILTER (simulated = 'DENY') AS denied, count(*) FILTER (recorded <> simulated) AS changed
        FROM sim GROUP BY object""",
)
def replay_by_table(t: Frames):
    rows = B.replay_summary(_replayed(t), ["object"])
    return rows.select(
        "object", "evaluated", "allowed", "denied", (F.col("newly_denied") + F.col("newly_allowed")).alias("changed")
    )


@query(
    "a8_replay_differences",
    f"WITH {MATCHED} SELECT id, recorded, simulated FROM sim WHERE recorded <> simulated",
)
def replay_differences(t: Frames):
    return B.replay_differences(_replayed(t)).select("id", "recorded", "simulated")


ROOTS = "SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS node FROM orders"
REACH = f"""reach AS (SELECT node AS root, node, 0 AS d FROM ({ROOTS})
    UNION SELECT r.root, e.dst, r.d + 1 FROM reach r JOIN lineage_edges e ON e.src = r.node WHERE r.d < 7)"""
NODE_TYPE = """CASE left(node, 1) WHEN 'p' THEN 'Table' WHEN 's' THEN 'ExternalService'
    WHEN 'n' THEN CASE WHEN CAST(substr(node, 2) AS INT) % 2 = 0 THEN 'Dashboard' ELSE 'Column' END ELSE 'Table' END"""


def _roots(t: Frames):
    return t.orders.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"))


def _typed(closure):
    return closure.withColumn("node_type", F.expr(NODE_TYPE))


@query(
    "u6_downstream_closure",
    f"""WITH RECURSIVE {REACH}, best AS (SELECT root, node, min(d) AS distance FROM reach GROUP BY ALL)
        SELECT b.root, b.node, b.distance, min(e.src) AS upstream FROM best b JOIN lineage_edges e ON e.dst = b.node
          JOIN best u ON u.root = b.root AND u.node = e.src AND u.distance = b.distance - 1
        WHERE b.distance > 0 GROUP BY ALL""",
)
def closure(t: Frames):
    return L.downstream(t.lineage_edges, _roots(t))


# Besides the rings of nation and region, rings of three: a region feeds some suppliers of its nations.
RINGS = """SELECT 'r' || CAST(n_regionkey AS VARCHAR) AS src, 's' || CAST(s_suppkey AS VARCHAR) AS dst
    FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_suppkey % 50 = 0"""


@query(
    "u7_revocation_impact",
    f"""WITH RECURSIVE le AS (SELECT src, dst FROM lineage_edges UNION {RINGS}),
          reach AS (SELECT node AS root, node, 0 AS d FROM ({ROOTS})
            UNION SELECT r.root, e.dst, r.d + 1 FROM reach r JOIN le e ON e.src = r.node WHERE r.d < 8),
          best AS (SELECT root, node, min(d) AS distance FROM reach GROUP BY ALL),
          up AS (SELECT b.root, b.node, min(e.src) AS upstream FROM best b JOIN le e ON e.dst = b.node
            JOIN best u ON u.root = b.root AND u.node = e.src AND u.distance = b.distance - 1 GROUP BY ALL),
          ways AS (SELECT node AS root, node, [node] AS way FROM ({ROOTS})
            UNION ALL SELECT up.root, up.node, list_append(w.way, up.node) FROM ways w JOIN up ON up.root = w.root AND up.upstream = w.node),
          cyc AS (SELECT DISTINCT w.root, e.dst AS node FROM ways w JOIN le e ON e.src = w.node WHERE list_contains(w.way, e.dst))
        SELECT b.root, b.node, b.distance, c.node IS NOT NULL AS cyclic FROM best b
          LEFT JOIN cyc c ON c.root = b.root AND c.node = b.node WHERE b.distance > 0 OR c.node IS NOT NULL""",
)
def impact(t: Frames):
    rings = t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey")).where("s_suppkey % 50 = 0").select(
        F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("src"),
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("dst"),
    )
    return L.revocation_impact(t.lineage_edges.select("src", "dst").unionByName(rings), _roots(t))


@query(
    "a5_revocation_severity",
    f"""WITH RECURSIVE {REACH}, n AS (SELECT DISTINCT root, node FROM reach WHERE d > 0),
          y AS (SELECT root, {NODE_TYPE} AS node_type FROM n)
        SELECT root, CASE WHEN bool_or(node_type = 'Dashboard') THEN 'HIGH'
          WHEN bool_or(node_type = 'ExternalService') THEN 'MEDIUM' ELSE 'LOW' END AS severity,
          count(*) AS affected FROM y GROUP BY root""",
)
def severity(t: Frames):
    return L.revocation_severity(_typed(L.downstream(t.lineage_edges, _roots(t))))


@query(
    "a4_change_risk",
    f"""WITH RECURSIVE {REACH}, n AS (SELECT DISTINCT root, node FROM reach WHERE d > 0),
          y AS (SELECT root, count(*) AS downstream, bool_or({NODE_TYPE} = 'Dashboard') AS dash,
                  bool_or({NODE_TYPE} = 'ExternalService') AS ext FROM n GROUP BY root),
          a AS (SELECT 'o' || CAST(id % 4000 AS VARCHAR) AS root, count(DISTINCT actor_sid) AS readers, count(*) AS reads
                FROM audit WHERE decision = 'ALLOW' GROUP BY 1)
        SELECT coalesce(y.root, a.root) AS root, coalesce(downstream, 0) AS downstream, coalesce(readers, 0) AS readers,
          coalesce(reads, 0) AS reads, CASE WHEN coalesce(dash, FALSE) AND (coalesce(readers, 0) >= 3 OR coalesce(reads, 0) >= 50)
            THEN 'CRITICAL' WHEN coalesce(dash, FALSE) THEN 'HIGH' WHEN coalesce(ext, FALSE) OR coalesce(readers, 0) > 0 THEN 'MEDIUM'
            ELSE 'LOW' END AS risk FROM y FULL JOIN a ON y.root = a.root""",
)
def risk(t: Frames):
    root = F.concat(F.lit("o"), (F.col("id") % 4000).cast("string"))
    reads = A.consumers(t.audit.withColumn("root", root), ["root"])
    readers = reads.groupBy("root").agg(
        F.count("*").alias("readers"), F.sum("query_count").alias("reads")
    )
    return L.change_risk(_typed(L.downstream(t.lineage_edges, _roots(t))), readers)


@query(
    "g11_run_events",
    """WITH j AS (SELECT 'load-' || l_suppkey AS job, 'p' || l_partkey % 7 AS i, 'o' || l_returnflag AS o, l_shipdate AS ended
                  FROM lineitem),
         i AS (SELECT job, string_agg(DISTINCT '"' || i || '"', ',' ORDER BY '"' || i || '"') AS i FROM j GROUP BY job),
         o AS (SELECT job, string_agg(DISTINCT '"' || o || '"', ',' ORDER BY '"' || o || '"') AS o FROM j GROUP BY job),
         w AS (SELECT job, max(ended) AS event_time FROM j GROUP BY job)
       SELECT w.job, event_time, '{"eventType":"COMPLETE","job":"' || w.job || '","inputs":[' || i || '],"outputs":['
         || o || ']}' AS event FROM w JOIN i ON i.job = w.job JOIN o ON o.job = w.job""",
)
def run_events(t: Frames):
    edges = t.lineitem.select(
        F.concat(F.lit("load-"), F.col("l_suppkey").cast("string")).alias("job"),
        F.concat(F.lit("p"), (F.col("l_partkey") % 7).cast("string")).alias("input"),
        F.concat(F.lit("o"), "l_returnflag").alias("output"),
        F.col("l_shipdate").alias("at"),
    )
    return L.run_events(edges)


# Blocks of eight, so that chains take several rounds.
TREE_DEPTH = 3


@query(
    "k4_merkle_roots",
    f"""WITH {CHAIN},
          tree AS (SELECT tenant_id, n - 1 AS i, sha256('0|' || tenant_id || '|' || n || '|' || entry_hash) AS h,
              count(*) OVER (PARTITION BY tenant_id) AS width, 0 AS level FROM links
            UNION ALL
            SELECT tenant_id, i // 2, CASE WHEN count(*) = 2 THEN sha256('1|' || arg_min(h, i) || '|' || arg_max(h, i)) ELSE min(h) END,
              (width + 1) // 2, level + 1 FROM tree WHERE width > 1 GROUP BY tenant_id, i // 2, width, level)
        SELECT tenant_id, h AS root, (SELECT count(*) FROM audit a WHERE a.tenant_id = tree.tenant_id) AS entries
        FROM tree WHERE width = 1""",
)
def merkle_roots(t: Frames):
    return M.hash_tree(_chained(t), depth=TREE_DEPTH).roots().select("tenant_id", "root", "entries")


@query(
    "w1_merkle_proofs",
    f"""WITH numbered AS ({_NUMBERED}) SELECT tenant_id, n AS seq, n % 97 <> 5 AS valid FROM numbered""",
)
def merkle_proofs(t: Frames):
    # Some entries were exchanged after the roots had been signed.
    tree = M.hash_tree(_chained(t), depth=TREE_DEPTH)
    forged = F.when(F.col("seq") % 97 == 5, F.sha2(F.col("entry_hash"), 256)).otherwise(F.col("entry_hash"))
    return M.verify_proofs(tree.proofs().withColumn("entry_hash", forged), tree.roots(KEY), key=KEY)

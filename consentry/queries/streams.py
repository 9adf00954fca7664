"""Change streams, run over everything available and compared as tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from consentry.model import CLEAR, DENY, MASK, Column, MaskRule, TableMeta
from consentry.operators.consent import Decision
from consentry.operators.limits import first_request_windows
from consentry.operators.ordering import latest_per_key
from consentry.queries.base import Frames, query
from consentry.session import scratch_path
from consentry.sources.tables import stream_files
from consentry.streaming import cdc as S
from consentry.streaming.polling import change_stream, follow
from consentry.streaming.state import first_request_table, last_events

PEOPLE = TableMeta(
    "crm.dbo.people",
    (
        Column("id", "bigint"),
        Column("name"),
        Column("email", sensitive=True, rule=MaskRule("MASK_EMAIL")),
        Column("ssn", sensitive=True),
        Column("level", "int"),
    ),
    ("id",),
)
TYPES = {
    "id": T.LongType(), "name": T.StringType(), "email": T.StringType(), "ssn": T.StringType(),
    "level": T.IntegerType(),
}
LEVELS = Decision(True, levels={"id": CLEAR, "name": CLEAR, "email": MASK, "ssn": DENY}, default_level=CLEAR)


def _events(t: Frames):
    return stream_files(t.spark, t.path("events")).withColumn("ts", F.col("ts").cast("timestamp"))


def _ntz(df, *names: str):
    for name in names:
        df = df.withColumn(name, F.col(name).cast("timestamp_ntz"))
    return df


# A change message per event, plain or enveloped. Some deletes, some without a tenant.
MESSAGE = """CASE WHEN event_id % 2 = 0 THEN '{"schema":{},"payload":' ELSE '' END
  || '{"before":' || CASE WHEN event_type = 'error' THEN '{"id":' || event_id || ',"name":"Gone","TENANT_ID":"T-1"}' ELSE 'null' END
  || ',"after":' || CASE WHEN event_type = 'error' THEN 'null' ELSE '{"id":' || event_id || ',"name":"'
       || CASE user_id % 3 WHEN 0 THEN 'Ann' WHEN 1 THEN 'BOB' ELSE 'eve' END || '","email":"u' || user_id
       || '@corp.example.com","ssn":"1","extra":"x","level":"' || user_id % 10 || '"'
       || CASE user_id % 4 WHEN 0 THEN '' WHEN 1 THEN ',"tenant_id":"t-1"' ELSE ',"tenant_id":"t-2"' END || '}' END
  || ',"source":{"schema":"dbo","table":"' || CASE WHEN event_id % 5 = 0 THEN 'Other' ELSE 'People' END
  || '","ts_ms":5},"op":"' || CASE event_type WHEN 'error' THEN 'd' WHEN 'click' THEN 'c' WHEN 'view' THEN 'r' WHEN 'signup' THEN 'x' ELSE 'u' END
  || '","ts_ms":' || event_id || '}' || CASE WHEN event_id % 2 = 0 THEN '}' ELSE '' END"""

# What the messages say, read straight from the events.
CHANGES = """ch AS (SELECT event_id, user_id, event_type,
    CASE event_type WHEN 'error' THEN 'DELETE' WHEN 'click' THEN 'INSERT' WHEN 'view' THEN 'SNAPSHOT' ELSE 'UPDATE' END AS op,
    CASE WHEN event_type = 'error' THEN 'T-1' WHEN user_id % 4 = 0 THEN 'fallback' WHEN user_id % 4 = 1 THEN 't-1' ELSE 't-2' END AS tenant_id,
    'dbo.' || CASE WHEN event_id % 5 = 0 THEN 'Other' ELSE 'People' END AS table_name,
    CASE WHEN event_type = 'error' THEN 'Gone' WHEN user_id % 3 = 0 THEN 'Ann' WHEN user_id % 3 = 1 THEN 'BOB' ELSE 'eve' END AS name,
    CASE WHEN event_type = 'error' THEN NULL ELSE CAST(user_id % 10 AS INT) END AS level,
    CASE WHEN event_type = 'error' THEN NULL WHEN user_id < 0 THEN '' ELSE 'u***@***.com' END AS email
  FROM events WHERE event_type <> 'signup')"""


def _parsed(t: Frames):
    body = _events(t).select("event_id", "ts", F.expr(MESSAGE).alias("body"))
    return S.parse_envelope(body, "body", "fallback", ("event_id", "ts"))


def _typed(df):
    return S.typed_image(S.payload_image(df), PEOPLE, TYPES)


@query(
    "s11_change_envelope",
    f"WITH {CHANGES} SELECT event_id, op, tenant_id, table_name, event_id AS ts_ms FROM ch",
)
def envelope(t: Frames):
    return S.to_table(_parsed(t).select("event_id", "op", "tenant_id", "table_name", "ts_ms"))


@query(
    "s12_logical_changes",
    """SELECT o_orderkey, 'sales.orders_' || o_custkey % 3 AS table_name, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'B' END
         AS tenant_id FROM orders WHERE o_custkey % 4 < 3 AND o_custkey % 4 = o_custkey % 3""",
)
def logical(t: Frames):
    changes = stream_files(t.spark, t.path("orders")).select(
        "o_orderkey",
        (F.col("o_custkey") % 4).alias("relation_id"),
        F.create_map(F.lit("Tenant_Id"), F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise(" ")).alias("after"),
        F.create_map(F.lit("TENANT"), F.lit("B")).alias("before"),
        F.col("o_custkey"),
    ).where("o_custkey % 4 = o_custkey % 3")
    # The relations that exist, as the stream's schema messages named them.
    relations = t.orders.select(
        (F.col("o_custkey") % 3).alias("relation_id"),
        F.lit("sales").alias("namespace"),
        F.concat(F.lit("orders_"), (F.col("o_custkey") % 3).cast("string")).alias("name"),
    ).distinct()
    named = S.resolve_relations(changes, relations)
    return S.to_table(named.select("o_orderkey", "table_name", "tenant_id"))


@query(
    "st1_tenant_stamp",
    """SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 'T-1' ELSE 't-1' END AS tenant_id FROM events WHERE user_id % 4 < 2""",
)
def stamp(t: Frames):
    tenant = F.when(F.col("user_id") % 4 == 0, " ").when(F.col("user_id") % 4 == 1, "t-1").otherwise("t-2")
    rows = _events(t).select("event_id", tenant.alias("tenant_id"))
    return S.to_table(S.stamp_tenant(rows, "T-1"))


@query("st2_tenant_gate", f"WITH {CHANGES} SELECT event_id, tenant_id FROM ch WHERE lower(tenant_id) = 't-1'")
def gate(t: Frames):
    return S.to_table(S.tenant_gate(_parsed(t), " T-1 ").select("event_id", "tenant_id"))


@query("st3_payload_choice", f"WITH {CHANGES} SELECT event_id, name, level FROM ch")
def payload(t: Frames):
    return S.to_table(_typed(_parsed(t)).select("event_id", "name", "level"))


FILTER = "(name IN ('ANN', 'eve') OR level >= 7) AND NOT (name LIKE 'B%' AND level < 3) AND level BETWEEN 0 AND 8"
FILTER_SQL = """(lower(name) IN ('ann', 'eve') OR level >= 7) AND NOT (lower(name) LIKE 'b%' AND level < 3)
    AND level BETWEEN 0 AND 8"""


@query("st4_stream_filter", f"WITH {CHANGES} SELECT event_id, name, level FROM ch WHERE {FILTER_SQL}")
def row_filter(t: Frames):
    kept = S.stream_filter(_typed(_parsed(t)).select("event_id", "name", "level"), FILTER)
    return S.to_table(kept)


@query("st4_batch_filter", f"WITH {CHANGES} SELECT event_id, name, level FROM ch WHERE {FILTER_SQL}")
def batch_filter(t: Frames):
    # The same filter on a table, for parity.
    body = t.events.select("event_id", F.expr(MESSAGE).alias("body"))
    rows = _typed(S.parse_envelope(body, "body", "fallback", ("event_id",)))
    return S.stream_filter(rows.select("event_id", "name", "level"), FILTER)


@query("st5_stream_mask", f"WITH {CHANGES} SELECT event_id, event_id AS id, name, email, level FROM ch")
def mask(t: Frames):
    return S.to_table(S.enforce(_typed(_parsed(t)), PEOPLE, LEVELS, carry=["event_id"]))


@query("st6_decision_per_batch", f"WITH {CHANGES} SELECT event_id, name FROM ch WHERE level >= 4")
def per_batch(t: Frames):
    root = scratch_path(t.spark, "subscription")

    def decide() -> Decision:
        # Asked for anew by every batch.
        return Decision(
            True, levels={"name": CLEAR}, default_level=DENY, row_filter=F.col("level") >= 4
        )

    def write(batch, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    running = S.governed_subscription(_typed(_parsed(t)), decide, PEOPLE, ["event_id"], write, f"{root}/state")
    running.awaitTermination()
    return t.spark.read.parquet(f"{root}/out").drop("batch")


@query(
    "st7_fan_out",
    f"""WITH {CHANGES}, f AS (SELECT event_id, lower(table_name) AS topic FROM ch
          UNION ALL SELECT event_id, split_part(lower(table_name), '.', 2) FROM ch
          UNION ALL SELECT event_id, 'cdc_all' FROM ch) SELECT * FROM f""",
)
def fan_out(t: Frames):
    return S.to_table(S.fan_out(_parsed(t)).select("event_id", "topic"))


@query("st8_without_duplicates", "SELECT event_id, event_type FROM events")
def no_duplicates(t: Frames):
    doubled = _events(t).select("event_id", "event_type", "ts")
    doubled = doubled.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    kept = S.without_duplicates(doubled, ["event_id"])
    return S.to_table(kept.select("event_id", "event_type"))


@query(
    "st9_replay_history",
    """SELECT topic, event_id FROM (SELECT event_type AS topic, event_id, row_number() OVER (PARTITION BY event_type
         ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 50""",
)
def history(t: Frames):
    rows = _events(t).withColumnRenamed("event_type", "topic")
    return last_events(rows, "topic", "ts", "event_id").select("topic", "event_id")


@query(
    "st10_lag_report",
    """SELECT user_id AS slot, max(greatest(event_id * 1000000 - CAST(user_id * 1000 AS BIGINT), 0)) AS lag_bytes,
              max(greatest(event_id * 1000000 - CAST(user_id * 1000 AS BIGINT), 0)) > 1073741824 AS over_limit
       FROM events GROUP BY user_id""",
)
def lag(t: Frames):
    rows = _events(t).select(
        F.col("user_id").alias("slot"),
        (F.col("event_id") * 1000000).alias("position"),
        (F.col("user_id") * 1000).alias("acknowledged"),
    )
    return S.to_table(S.lag_report(rows, "position", "acknowledged"), mode="update", keys=["slot"])


@query(
    "st11_version_checkpoint",
    "SELECT event_type AS name, max(event_id) AS watermark FROM events GROUP BY event_type",
)
def checkpoint(t: Frames):
    root = scratch_path(t.spark, "versions")

    def save(batch, number: int) -> None:
        rows = batch.select(F.col("event_type").alias("name"), "event_id")
        S.advance_watermarks(t.spark, root, number, rows, "name", "event_id")

    running = (
        _events(t).writeStream.foreachBatch(save).option("checkpointLocation", f"{root}/offsets")
        .trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return S.read_watermarks(t.spark, root, "name")


def _poll_events(t: Frames, each):
    """The events as a change table in several files, in five polls; returns the lag of each poll."""
    root = scratch_path(t.spark, "polls")
    changes = t.events.select((F.col("event_id") + 1).alias("version"), "event_type", "user_id")
    changes.repartitionByRange(6, "version").write.parquet(f"{root}/table")
    head = changes.agg(F.max("version")).first()[0]
    stream = change_stream(t.spark, f"{root}/table", "version", f"{root}/position", (head or 0) // 5 + 1)
    return follow(stream, lambda batch, number: each(batch, number, root), f"{root}/state"), root


@query(
    "s13_change_stream",
    """SELECT event_id + 1 AS version, event_type, CAST(event_id // ((SELECT max(event_id) + 1 FROM events) // 5 + 1) AS INT) AS poll
       FROM events""",
)
def polled(t: Frames):
    def save(batch, number: int, root: str) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/told/poll={number}")

    _, root = _poll_events(t, save)
    return t.spark.read.parquet(f"{root}/told").select("version", "event_type", "poll")


@query(
    "st10_poll_lag",
    """WITH e AS (SELECT max(event_id) + 1 AS head FROM events), k AS (SELECT unnest(generate_series(0, 4)) AS poll)
       SELECT poll, poll * (head // 5 + 1) AS told_from, least((poll + 1) * (head // 5 + 1), head) AS told_to, head,
              head - told_to AS lag, head - told_to > 500 AS over_limit FROM e, k""",
)
def poll_lag(t: Frames):
    def skip(batch, number: int, root: str) -> None:
        batch.write.format("noop").mode("overwrite").save()

    lag, _ = _poll_events(t, skip)
    return lag.withColumn("over_limit", F.col("lag") > 500)


@query(
    "st12_request_windows",
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, user_id, count(*) AS requests FROM events
       GROUP BY ALL HAVING count(*) > 2""",
)
def windows(t: Frames):
    rows = _events(t).withWatermark("ts", S.WATERMARK)
    counted = S.to_table(S.request_windows(rows, "user_id", "ts", 3600), mode="update", keys=["window_start", "user_id"])
    return _ntz(S.breaches(counted, 2), "window_start")


@query(
    "st12_batch_breaches",
    """SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, user_id, count(*) AS requests, count(*) - 4 AS excess FROM events
       GROUP BY 1, 2 HAVING count(*) > 4""",
)
def breaches(t: Frames):
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return _ntz(S.session_breaches(rows, "user_id", "ts", 4, 86400), "window_start")


FIRST_REQUESTS = """WITH RECURSIVE w AS (SELECT user_id, min(ts) AS s FROM events GROUP BY user_id
         UNION ALL SELECT w.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = w.user_id AND e.ts >= w.s + INTERVAL 6 HOUR)
           FROM w WHERE w.s IS NOT NULL)
       SELECT w.user_id, w.s AS window_start, count(*) AS requests FROM w JOIN events e ON e.user_id = w.user_id
         AND e.ts >= w.s AND e.ts < w.s + INTERVAL 6 HOUR WHERE w.s IS NOT NULL GROUP BY ALL"""


@query(
    "st12_first_request_windows",
    FIRST_REQUESTS,
)
def first_request(t: Frames):
    rows = first_request_windows(t.events, "user_id", "ts", 6 * 3600)
    return _ntz(rows, "window_start")


@query("st12_first_request_stream", FIRST_REQUESTS)
def first_request_state(t: Frames):
    return _ntz(first_request_table(_events(t), "user_id", "ts", 6 * 3600), "window_start")


@query(
    "st13_running_spend",
    """SELECT date_trunc('day', ts) AS period_start, event_type AS tenant, round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 2)
         AS spend FROM events GROUP BY 1, 2""",
)
def spend(t: Frames):
    rows = _events(t).select("ts", F.col("event_type").alias("tenant"), F.col("value").cast("decimal(18,2)").alias("cost"))
    totals = S.to_table(S.running_spend(rows, "tenant", "cost", "ts"), mode="update", keys=["period_start", "tenant"])
    return _ntz(totals.withColumn("spend", F.round(F.col("spend").cast("double"), 2)), "period_start")


@query(
    "st14_masked_rows",
    """SELECT o_orderkey, o_custkey, CASE WHEN length(o_orderpriority) <= 8 THEN left(o_orderpriority, 1)
         || repeat('*', length(o_orderpriority) - 2) || right(o_orderpriority, 1) ELSE left(o_orderpriority, 3)
         || repeat('*', length(o_orderpriority) - 6) || right(o_orderpriority, 3) END AS o_orderpriority FROM orders""",
)
def masked_rows(t: Frames):
    meta = TableMeta(
        "sales.dbo.orders",
        (Column("o_orderkey", "bigint"), Column("o_custkey", "bigint"),
         Column("o_orderpriority", sensitive=True, rule=MaskRule("MASK_PHONE"))),
    )
    decision = Decision(True, default_level=CLEAR)
    return S.to_table(S.enforce(stream_files(t.spark, t.path("orders")), meta, decision))


@query(
    "k5_subscription_sink",
    f"""WITH {CHANGES} SELECT event_id, '{{"id":' || event_id || ',"name":"' || name || '"'
          || CASE WHEN email IS NULL THEN '' ELSE ',"email":"' || email || '"' END || '}}' AS payload
        FROM ch WHERE lower(tenant_id) = 't-1' AND table_name = 'dbo.People'""",
)
def subscription(t: Frames):
    """The whole path of a subscriber: parse, tenant gate, table, mask, payload."""
    mine = S.tracked(S.tenant_gate(_parsed(t), "t-1"), ["people"])
    rows = S.enforce(_typed(mine), PEOPLE, LEVELS, carry=["event_id"])
    body = S.subscription_payload(rows, ["id", "name", "email"])
    return S.to_table(rows.select("event_id", body.alias("payload")))


@query(
    "st9_replay_batch",
    """SELECT topic, event_id FROM (SELECT event_type AS topic, event_id, row_number() OVER (PARTITION BY event_type
         ORDER BY ts DESC) AS rn FROM events) WHERE rn <= 50""",
)
def replay_batch(t: Frames):
    rows = t.events.select(F.col("event_type").alias("topic"), "event_id", "ts")
    return latest_per_key(rows, ["topic"], [F.desc("ts")], S.REPLAY_EVENTS).select("topic", "event_id")

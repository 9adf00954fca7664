"""Audit log: reading, hash chains, consumers, disclosure and telemetry."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consentry.functions.crypto import hmac_text
from consentry.functions.text import client_type
from consentry.operators.ordering import latest_per_key, numbered
from consentry.session import checked_broadcast, durable

SEGMENT_ROWS = 4096
# Entries that one task compares with those before them.
ENTRIES_PER_TASK = 200_000
# Votes that one task brings together.
VOTES_PER_TASK = 200_000

# Payload fields after the sequence, in order.
PAYLOAD_FIELDS = (
    "event_type", "actor_sid", "target_table", "target_column", "decision", "trace_id",
    "details_json", "tenant_id",
)


def read_log(
    audit: DataFrame,
    table: str | None = None,
    actor: str | None = None,
    since=None,
    tenant: str | None = None,
    limit: int = 500,
) -> DataFrame:
    """Newest entries first, at most 5000; a top-k, not a sort of the log."""
    for column, value in (("target_table", table), ("actor_sid", actor), ("tenant_id", tenant)):
        if value is not None:
            audit = audit.where(F.col(column) == value)
    if since is not None:
        audit = audit.where(F.col("occurred_at") >= F.lit(since))
    return audit.orderBy(F.desc("occurred_at"), F.desc("id")).limit(max(1, min(limit, 5000)))


def _escaped(c: Column) -> Column:
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def _occurred(c: Column) -> Column:
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0+00:00"))


def payload(prev_hash: Column) -> Column:
    """The text an entry hash is computed over."""
    return F.concat_ws(
        "|",
        F.lit("v2"),
        F.col("seq").cast("string"),
        F.col("id").cast("string"),
        prev_hash,
        _occurred(F.col("occurred_at")),
        *[_escaped(F.col(f)) for f in PAYLOAD_FIELDS],
    )


def _anchor(chain: Sequence[str], key: bytes) -> Column:
    """Where the segment of a row starts from; bound to its chain and number."""
    names = [F.col(c).cast("string") for c in chain]
    return hmac_text(F.concat_ws("|", F.lit("anchor"), *names, F.col("segment")), key)


def append_chain(
    events: DataFrame,
    key: bytes,
    chain: Sequence[str] = ("tenant_id",),
    order: Sequence[str] = ("occurred_at", "id"),
    segment_rows: int = SEGMENT_ROWS,
    tails: DataFrame | None = None,
) -> DataFrame:
    """Adds seq, segment, prev_hash and entry_hash.

    Inside a chain each hash needs the one before, which is serial by nature. A chain is
    therefore cut into segments of ``segment_rows`` entries; each starts from an anchor
    bound to its chain and number, so segments are hashed in parallel and a hot chain
    spreads over many tasks. ``segment_heads`` links the segments to each other.

    ``tails``: (chain..., last_seq, last_hash) of entries written before; new entries go
    on from there, inside a segment that is not yet full.
    """
    rows = numbered(events, chain, order)
    anchor = _anchor(chain, key)
    if tails is not None:
        rows = rows.join(tails, list(chain), "left").withColumn(
            "seq", F.col("seq") + F.coalesce("last_seq", F.lit(0))
        )
        same = F.floor((F.col("last_seq") - 1) / segment_rows) == F.col("segment")
        anchor = F.when(same, F.col("last_hash")).otherwise(anchor)
    rows = rows.withColumn("segment", F.floor((F.col("seq") - 1) / segment_rows))
    # The payload in front of and behind the previous hash; only the hash is serial.
    cut = F.split(payload(F.lit("\x00")), "\x00", 2)
    rows = rows.withColumn("_head", cut[0]).withColumn("_tail", cut[1]).withColumn("_start", anchor)
    rows = rows.drop("last_seq", "last_hash")
    shape = rows.drop("_head", "_tail", "_start").schema.add("prev_hash", "string").add(
        "entry_hash", "string"
    )
    group = [*chain, "segment"]
    kept = [f.name for f in shape]

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, None
        for batch in batches:
            prev, entry = [], []
            for start, before, after in zip(batch["_start"], batch["_head"], batch["_tail"]):
                if start != current:
                    current, last = start, start
                prev.append(last)
                last = hmac.new(key, f"{before}{last}{after}".encode(), hashlib.sha256).hexdigest().upper()
                entry.append(last)
            yield batch.assign(prev_hash=prev, entry_hash=entry)[kept]

    return (
        rows.repartition(*group).sortWithinPartitions(*group, "seq").mapInPandas(link, shape)
    )


def chain_tails(chained: DataFrame, chain: Sequence[str] = ("tenant_id",)) -> DataFrame:
    """(chain..., last_seq, last_hash): where the next append goes on."""
    return chained.groupBy(*chain).agg(
        F.max("seq").alias("last_seq"), F.max_by("entry_hash", "seq").alias("last_hash")
    )


def append_stream(
    stream: DataFrame,
    root: str,
    key: bytes,
    chain: Sequence[str] = ("tenant_id",),
    order: Sequence[str] = ("occurred_at", "id"),
    segment_rows: int = SEGMENT_ROWS,
):
    """Appends a stream of events to a log under ``root``, batch by batch.

    Every batch writes its own folder and the tails after it, and starts from the tails of
    the batch before; a batch that runs again after a failure writes the same entries.
    """
    spark = stream.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        before = spark.read.parquet(f"{root}/tails/batch={number - 1}") if number else None
        linked = append_chain(batch, key, chain, order, segment_rows, before)
        linked.write.mode("overwrite").parquet(f"{root}/log/batch={number}")
        after = chain_tails(spark.read.parquet(f"{root}/log/batch={number}"), chain)
        if before is not None:
            after = after.unionByName(before.join(after, list(chain), "left_anti"))
        after.write.mode("overwrite").parquet(f"{root}/tails/batch={number}")

    return (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .start()
    )


def segment_heads(chained: DataFrame, chain: Sequence[str] = ("tenant_id",)) -> DataFrame:
    """One row per segment: first and last sequence, last hash. Input of the next level."""
    last = F.max(F.struct("seq", "entry_hash"))
    return (
        chained.groupBy(*chain, "segment")
        .agg(F.min("seq").alias("first_seq"), F.count("*").alias("entries"), last.alias("_l"))
        .select(
            *chain, "segment", "first_seq", F.col("_l.seq").alias("last_seq"), "entries",
            F.col("_l.entry_hash").alias("head_hash"),
        )
    )


def _tail_text(chain: Sequence[str]) -> Column:
    return F.concat_ws("|", F.lit("tail"), *[F.col(c).cast("string") for c in chain], F.col("last_seq"), F.col("last_hash"))


def signed_tails(tails: DataFrame, key: bytes, chain: Sequence[str] = ("tenant_id",)) -> DataFrame:
    """Tails with a keyed signature; kept apart from the log, they show later that its end is missing."""
    return tails.withColumn("signature", hmac_text(_tail_text(chain), key))


def verify_chain(
    chained: DataFrame,
    key: bytes,
    chain: Sequence[str] = ("tenant_id",),
    segment_rows: int = SEGMENT_ROWS,
    tails: DataFrame | None = None,
) -> DataFrame:
    """Violations: (chain..., seq, problem). Every entry is checked in parallel.

    ``GAP``: the entry before is absent, also before the first entry of a segment or of the whole chain. ``REPEATED``: a
    number occurs more than once. ``BROKEN_LINK`` and ``TAMPERED``: hashes do not fit. With signed ``tails``,
    ``LOST_TAIL``: the last entry once written is not there (the whole chain may be gone), and ``FORGED_TAIL``: the tail's
    signature is wrong.

    The predecessor comes from an equi join on (chain, seq), not from a window over the
    chain, so one long chain is no bottleneck. Payloads are hashed before it, so only hashes move, and tasks get
    their entries by number (``ENTRIES_PER_TASK``).
    """
    place = [*chain, "seq"]
    tasks = max(chained.sparkSession.sparkContext.defaultParallelism, chained.count() // ENTRIES_PER_TASK)
    first = (F.col("seq") - 1) % segment_rows == 0
    slim = chained.select(
        *place, "prev_hash", "entry_hash", F.when(first, _anchor(chain, key)).alias("_anchor"),
        (F.col("entry_hash") != hmac_text(payload(F.col("prev_hash")), key)).alias("_changed"),
    ).repartition(tasks, *place)
    numbers = slim.groupBy(*place).agg(F.min("entry_hash").alias("_hash"), F.count("*").alias("_n"))
    before = numbers.select(*chain, (F.col("seq") + 1).alias("seq"), F.col("_hash").alias("_before")).repartition(tasks, *place)
    expected = F.when(first, F.col("_anchor")).otherwise(F.col("_before"))
    checked = slim.join(before, place, "left")
    problem = (
        F.when((F.col("seq") > 1) & F.col("_before").isNull(), "GAP")
        .when(F.col("prev_hash") != expected, "BROKEN_LINK")
        .when(F.col("_changed"), "TAMPERED")
    )
    found = checked.select(*chain, "seq", problem.alias("problem")).where(F.col("problem").isNotNull())
    found = found.unionByName(numbers.where("_n > 1").select(*chain, "seq", F.lit("REPEATED").alias("problem")))
    if tails is None:
        return found
    # One row a chain: where it is broadcast, the log is neither moved nor sorted to find the ends.
    tails = durable(tails, "tails")
    true = hmac_text(_tail_text(chain), key) == F.col("signature")
    end = [*chain, "last_seq", "last_hash"]
    ends = chained.select(*chain, F.col("seq").alias("last_seq"), F.col("entry_hash").alias("last_hash"))
    ends = ends.join(checked_broadcast(tails.select(*end)), end, "left_semi").distinct()
    forged = tails.where(~F.coalesce(true, F.lit(False))).withColumn("problem", F.lit("FORGED_TAIL"))
    lost = tails.join(ends, end, "left_anti").withColumn("problem", F.lit("LOST_TAIL"))
    for rows in (forged, lost):
        found = found.unionByName(rows.select(*chain, F.col("last_seq").alias("seq"), "problem"))
    return found


def chain_gaps(
    entries: DataFrame, chain: Sequence[str] = ("tenant_id",), tails: DataFrame | None = None, first: int | None = 1
) -> DataFrame:
    """Missing ranges: (chain..., missing_from, missing_to).

    An entry opens a gap when its successor is absent; the gap closes at the next entry
    present. Only gap edges meet each other, not the whole log. Chains start at ``first`` (None: with their first entry); with
    ``tails`` a gap may also lie behind the last entry, or be a whole chain.
    """
    here = entries.select(*chain, F.col("seq").cast("long").alias("seq")).distinct()
    known = here.select(*chain)
    if tails is not None:
        known = known.unionByName(tails.select(*chain))
        here = here.unionByName(tails.select(*chain, (F.col("last_seq") + 1).cast("long").alias("seq")))
    if first is not None:
        here = here.unionByName(known.distinct().select(*chain, F.lit(first - 1).cast("long").alias("seq")))
    here = here.distinct()
    nexts = here.select(*chain, (F.col("seq") - 1).alias("seq"))
    prevs = here.select(*chain, (F.col("seq") + 1).alias("seq"))
    opens = here.join(nexts, [*chain, "seq"], "left_anti").select(*chain, F.col("seq").alias("at"), F.lit(0).alias("kind"))
    closes = here.join(prevs, [*chain, "seq"], "left_anti").select(*chain, F.col("seq").alias("at"), F.lit(1).alias("kind"))
    # Edges alternate close, open, close, open...; their ordinals pair them up.
    start = numbered(opens, chain, ["at"], "n").select(*chain, "n", F.col("at").alias("_open"))
    end = numbered(closes, chain, ["at"], "n").select(
        *chain, (F.col("n") - 1).alias("n"), F.col("at").alias("_close")
    )
    return start.join(end, [*chain, "n"]).select(
        *chain, (F.col("_open") + 1).alias("missing_from"), (F.col("_close") - 1).alias("missing_to")
    )


def consumers(audit: DataFrame, by: Sequence[str] = ("target_table",)) -> DataFrame:
    """Readers of each table from the allowed accesses of the log."""
    return (
        audit.where(F.upper("decision") == "ALLOW")
        .groupBy(*by, "actor_sid")
        .agg(
            F.count("*").alias("query_count"),
            F.min("occurred_at").alias("first_seen"),
            F.max("occurred_at").alias("last_seen"),
        )
        .withColumn("client_type", client_type(F.col("actor_sid")))
    )


def disclosure_report(audit: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Per table and recipient: accesses, columns seen and the first mask that applied.

    ``rules``: (target_table, column_name, rule_type). Column names fold case; the set of
    columns of a table is bounded by its schema.
    """
    allowed = audit.where(F.upper("decision") == "ALLOW")
    column = F.lower(F.trim("target_column"))
    per_column = allowed.groupBy(
        "target_table", "actor_sid", F.when(column != "", column).alias("column_name")
    ).agg(
        F.count("*").alias("n"),
        F.min("occurred_at").alias("first"),
        F.max("occurred_at").alias("last"),
    )
    if rules is not None:
        folded = rules.groupBy("target_table", F.lower("column_name").alias("column_name")).agg(
            F.min("rule_type").alias("rule_type")
        )
        per_column = per_column.join(folded, ["target_table", "column_name"], "left")
    else:
        per_column = per_column.withColumn("rule_type", F.lit(None).cast("string"))
    mask = F.when(
        F.col("rule_type").isNotNull(), F.concat_ws(": ", "column_name", "rule_type")
    )
    return (
        per_column.groupBy("target_table", "actor_sid")
        .agg(
            F.sum("n").alias("total_queries"),
            F.min("first").alias("first_access"),
            F.max("last").alias("last_access"),
            F.array_sort(F.collect_set("column_name")).alias("columns"),
            F.min(mask).alias("applied_mask"),
        )
        .withColumn("category", client_type(F.col("actor_sid")))
    )


# Categories of the disclosure report.
SPECIAL_CATEGORY = (
    "GDPR_ARTICLE_9 (Special Category: Health, Biometric, Genetic, Political or Religious Data)"
)
PERSONAL_CATEGORY = "PII (Personally Identifiable Information)"
CONFIDENTIAL_CATEGORY = "CONFIDENTIAL_BUSINESS_DATA"
STANDARD_CATEGORY = "STANDARD_OPERATIONAL_DATA"


def sensitivity_categories(sensitivity: Column, four_eyes: Column) -> Column:
    label = F.upper(F.coalesce(sensitivity, F.lit("NORMAL")))
    special = label.contains("ART9") | label.contains("ARTICLE_9") | four_eyes
    confidential = label.contains("HIGH") | label.contains("CONFIDENTIAL")
    found = F.array_compact(
        F.array(
            F.when(special, SPECIAL_CATEGORY),
            F.when(label.contains("PII"), PERSONAL_CATEGORY),
            F.when(confidential, CONFIDENTIAL_CATEGORY),
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(STANDARD_CATEGORY)))


def table_telemetry(
    queries: DataFrame, table: str, latency: str, at: str, consumer: str, window: int = 500, top: int = 5
) -> DataFrame:
    """Per table: total, nearest-rank p99 of the latest latencies, top consumers.

    Only ``window`` rows per table are ever held together.
    """
    totals = queries.groupBy(table).agg(F.count("*").alias("total_queries"))
    recent = latest_per_key(
        queries.select(table, latency, at), [table], [F.desc(at)], window
    )
    sorted_latency = F.array_sort(F.collect_list(latency))
    p99 = recent.groupBy(table).agg(
        F.element_at(
            sorted_latency, F.greatest(F.ceil(F.count("*") * 0.99), F.lit(1)).cast("int")
        ).alias("p99_latency")
    )
    best = latest_per_key(
        queries.groupBy(table, consumer).agg(F.count("*").alias("_n")),
        [table],
        [F.desc("_n"), F.asc(consumer)],
        top,
    )
    listed = best.groupBy(table).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("a"), F.col(consumer).alias("c")))),
            lambda x: x["c"],
        ).alias("top_consumers")
    )
    return totals.join(p99, table, "left").join(listed, table, "left")


def break_glass(audit: DataFrame, justification: str) -> DataFrame:
    """Emergency accesses with whether they cite a valid ticket."""
    from consentry.functions.text import is_ticket

    return audit.where(F.upper("event_type").contains("BREAK")).withColumn(
        "has_ticket", F.coalesce(is_ticket(F.trim(justification)), F.lit(False))
    )


def snapshot(
    chained: DataFrame,
    key: bytes,
    chain: Sequence[str] = ("tenant_id",),
    segment_rows: int = SEGMENT_ROWS,
    tails: DataFrame | None = None,
) -> DataFrame:
    """Manifest of a log snapshot: one row per segment with a digest over its entries.

    The digest is taken over the (bounded) segment; ``violations`` must be 0 to publish.
    """
    bad = verify_chain(chained, key, chain, segment_rows, tails).withColumn(
        "segment", F.floor((F.col("seq") - 1) / segment_rows)
    )
    bad = bad.groupBy(*chain, "segment").agg(F.count("*").alias("violations"))
    lines = F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "entry_hash"))),
        lambda x: F.concat_ws(":", x["seq"].cast("string"), x["entry_hash"]),
    )
    digests = chained.groupBy(*chain, "segment").agg(
        F.sha2(F.array_join(lines, "\n"), 256).alias("payload_sha256"),
        F.min_by("prev_hash", "seq").alias("root_hash"),
        F.max_by("entry_hash", "seq").alias("final_hash"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
        F.count("*").alias("entries"),
    )
    return (
        digests.join(bad, [*chain, "segment"], "left")
        .withColumn("violations", F.coalesce("violations", F.lit(0)))
        .withColumn(
            "complete", F.col("entries") == F.col("last_seq") - F.col("first_seq") + 1
        )
    )


def export_snapshot(
    chained: DataFrame,
    key: bytes,
    path: str,
    since=None,
    until=None,
    chain: Sequence[str] = ("tenant_id",),
    segment_rows: int = SEGMENT_ROWS,
    tails: DataFrame | None = None,
) -> DataFrame:
    """Writes the entries of a time window under ``path`` and returns the manifest of what was written.

    The whole log is verified first, and a broken one is refused. The manifest has a row per segment: entries, first and last
    number, and a digest over the payloads and hashes as they lie in the written files.
    """
    if not verify_chain(chained, key, chain, segment_rows, tails).isEmpty():
        raise ValueError("the audit chain is broken; nothing was exported")
    entries = chained
    if since is not None:
        entries = entries.where(F.col("occurred_at") >= F.lit(since))
    if until is not None:
        entries = entries.where(F.col("occurred_at") < F.lit(until))
    entries.write.mode("errorifexists").parquet(path)
    written = chained.sparkSession.read.schema(entries.schema).parquet(path)
    line = F.concat_ws(":", payload(F.col("prev_hash")), F.col("entry_hash"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"])
    return written.groupBy(*chain, "segment").agg(
        F.sha2(F.array_join(lines, "\n"), 256).alias("payload_sha256"),
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("entries"),
        F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"),
    )


def approval_status(
    requests: DataFrame,
    steps: DataFrame,
    four_eyes: str = "four_eyes",
    authorised: DataFrame | None = None,
) -> DataFrame:
    """Status of access requests from their approval steps.

    A requester cannot approve, a second vote of one approver does not count, and
    tables under four eyes need two approvers. With ``authorised`` (table_id,
    approver_sid; no table for admins) only votes of authorised approvers count.
    """
    owners = ["request_id", "requester_sid"]
    if authorised is not None:
        asked = requests.select("request_id", "table_id")
        admins = authorised.where(F.col("table_id").isNull()).select("approver_sid").distinct()
        own = steps.join(asked, "request_id").join(
            authorised.select("table_id", "approver_sid"), ["table_id", "approver_sid"], "left_semi"
        )
        steps = own.select(*steps.columns).union(steps.join(admins, "approver_sid", "left_semi").select(*steps.columns))
    # Votes shrink much in a shuffle, so its bytes say little about the memory of their groups: they are dealt by number.
    parts = max(steps.sparkSession.sparkContext.defaultParallelism, steps.count() // VOTES_PER_TASK)
    votes = (
        steps.select("request_id", "approver_sid", "decision").repartition(parts, "request_id")
        .join(requests.select(*owners), "request_id")
        .where(F.col("approver_sid") != F.col("requester_sid"))
        .groupBy("request_id", "approver_sid")
        .agg(
            F.bool_or(F.upper("decision") == "REJECTED").alias("rejects"),
            F.bool_or(F.upper("decision") == "APPROVED").alias("approves"),
        )
        .groupBy("request_id")
        .agg(F.count_if("approves").alias("approvals"), F.bool_or("rejects").alias("rejected"))
    )
    needed = F.when(F.col(four_eyes), 2).otherwise(1)
    n = F.coalesce("approvals", F.lit(0))
    status = (
        F.when(F.coalesce("rejected", F.lit(False)), "REJECTED")
        .when(n >= needed, "APPROVED")
        .when(n > 0, "PENDING_SECOND_APPROVAL")
        .otherwise("PENDING")
    )
    return requests.join(votes, "request_id", "left").select(
        *requests.columns, status.alias("status"), (n + 1).cast("long").alias("next_step")
    )


def approval_steps(steps: DataFrame) -> DataFrame:
    """Step numbers: the first vote of each approver, in order of time."""
    first = steps.groupBy("request_id", "approver_sid").agg(F.min("decided_at").alias("decided_at"))
    return numbered(first, ["request_id"], ["decided_at", "approver_sid"], "step_number")

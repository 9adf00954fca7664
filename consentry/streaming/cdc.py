"""Change streams: parsing, tenant gates, row filters, masks, fan-out, state."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from consentry.functions.masks import mask_column
from consentry.model import DENY, MASK, MaskRule, TableMeta
from consentry.operators.consent import Decision
from consentry.operators.ordering import latest_per_key
from consentry.operators.predicates import check_predicate
from consentry.session import scratch_path

# How long late rows may still change a result, and how long a key is remembered.
WATERMARK = "10 minutes"
REPLAY_EVENTS = 50
# Places a tenant is looked for, and operation codes.
TENANT_KEYS = ("tenant_id", "tenantid", "tenant", "mandant_id")
OPERATIONS = {"c": "INSERT", "u": "UPDATE", "d": "DELETE", "r": "SNAPSHOT"}


_CHANGE = (
    "op string, before map<string,string>, after map<string,string>, ts_ms string, tenant_id string, "
    "source struct<db: string, schema: string, table: string, ts_ms: string>"
)


def parse_envelope(df: DataFrame, payload: str, default_tenant: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Change events of a plain or an enveloped JSON message.

    Columns: source table, op, tenant, before and after as maps, source time. Messages
    that are not JSON or carry no operation are dropped.
    """

    # One parse per message; both forms are read by the same schema.
    message = F.from_json(payload, f"{_CHANGE}, payload struct<{_CHANGE}>")

    def at(path: str) -> Column:
        return F.coalesce(F.col(f"_m.payload.{path}"), F.col(f"_m.{path}"))

    rows = df.select(*keep, message.alias("_m")).select(
        *keep,
        F.concat_ws(".", at("source.db"), at("source.schema"), at("source.table")).alias("table_name"),
        F.lower(at("op")).alias("_op"),
        at("before").alias("before"),
        at("after").alias("after"),
        F.coalesce(at("ts_ms"), at("source.ts_ms")).try_cast("long").alias("ts_ms"),
        at("tenant_id").alias("_tenant"),
    )
    names = F.create_map(*[F.lit(x) for kv in OPERATIONS.items() for x in kv])
    return (
        rows.withColumn("op", F.try_element_at(names, F.col("_op")))
        .where(F.col("op").isNotNull())
        .withColumn(
            "tenant_id",
            F.coalesce(
                image_tenant(F.col("after")), image_tenant(F.col("before")),
                F.col("_tenant"), F.lit(default_tenant),
            ),
        )
        .drop("_op", "_tenant")
    )


def image_tenant(image: Column) -> Column:
    """Tenant of a row image; key names fold case, blanks do not count."""
    def value_of(name: str) -> Column:
        same = F.filter(F.map_entries(image), lambda e: F.lower(e["key"]) == name)
        text = F.try_element_at(same, F.lit(1))["value"]
        return F.when(F.trim(text) != "", text)

    return F.coalesce(*[value_of(k) for k in TENANT_KEYS])


def resolve_relations(changes: DataFrame, relations: DataFrame) -> DataFrame:
    """Names the table of each logical change; changes of unknown relations vanish."""
    named = relations.select(
        "relation_id", F.concat_ws(".", "namespace", "name").alias("table_name")
    )
    tenant = F.coalesce(image_tenant(F.col("after")), image_tenant(F.col("before")))
    return changes.join(named, "relation_id").withColumn("tenant_id", tenant)


def tracked(df: DataFrame, names: Iterable[str], column: str = "table_name") -> DataFrame:
    """Events of tracked tables, given by simple or qualified name; no name means all."""
    wanted = [n.lower() for n in names]
    if not wanted:
        return df
    low = F.lower(column)
    return df.where(low.isin(*wanted) | F.substring_index(low, ".", -1).isin(*wanted))


def stamp_tenant(df: DataFrame, caller: str) -> DataFrame:
    """Fills an empty tenant with the caller's; events of another tenant are refused."""
    own = F.when(F.trim(F.coalesce("tenant_id", F.lit(""))) == "", F.lit(caller)).otherwise(F.col("tenant_id"))
    return df.withColumn("tenant_id", own).where(F.lower("tenant_id") == caller.lower())


def tenant_gate(df: DataFrame, tenant: str | None) -> DataFrame:
    if not tenant or not tenant.strip():
        return df.where(F.lit(False))
    return df.where(F.lower(F.trim("tenant_id")) == tenant.strip().lower())


def payload_image(df: DataFrame) -> DataFrame:
    """The image a subscriber sees; events without one are dropped."""
    gone = F.col("op") == "DELETE"
    chosen = F.when(gone, F.coalesce("before", "after")).otherwise(F.coalesce("after", "before"))
    return df.withColumn("image", chosen).where(F.col("image").isNotNull() & (F.size("image") > 0))


def typed_image(df: DataFrame, meta: TableMeta, types: dict[str, T.DataType]) -> DataFrame:
    """Catalog columns of the image with their types; unknown members are dropped."""
    fields = [
        F.try_element_at("image", F.lit(c.name)).try_cast(types[c.name]).alias(c.name)
        for c in meta.columns
    ]
    return df.select(*[c for c in df.columns if c not in ("image", "before", "after")], *fields)


def case_insensitive(df: DataFrame) -> DataFrame:
    """Text columns under a case-insensitive collation, as stream filters compare."""
    return df.select(
        *[
            (F.collate(f.name, "UTF8_LCASE").alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name))
            for f in df.schema
        ]
    )


def stream_filter(df: DataFrame, text: str, fold_case: bool = True) -> DataFrame:
    """Row filter of a stream; a filter that is not a plain predicate keeps nothing.

    Function calls, CASE and subqueries are refused. With ``fold_case`` text compares
    without regard to case.
    """
    import re

    bare = re.sub(r"'(?:[^']|'')*'", "''", text)
    calls = re.findall(r"\b([A-Za-z_]\w*)\s*\(", bare)
    words = {"in", "and", "or", "not", "between", "is", "like"}
    if re.search(r"\bcase\b|\bexists\b", bare, re.I) or any(c.lower() not in words for c in calls):
        return df.where(F.lit(False))
    try:
        keyed = case_insensitive(df) if fold_case else df
        kept = keyed.where(check_predicate(text))
        kept.schema
    except Exception:  # noqa: BLE001 - every failure closes the gate
        return df.where(F.lit(False))
    return kept.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in df.schema])


def enforce(
    df: DataFrame,
    meta: TableMeta,
    decision: Decision,
    carry: Sequence[str] = (),
    master_key: bytes | None = None,
) -> DataFrame:
    """Filter and mask of a decision on typed events; the same plan as for a table."""
    if not decision.allowed:
        return df.where(F.lit(False)).select(*carry)
    if decision.row_filter is not None:
        df = df.where(decision.row_filter)
    out = [F.col(c) for c in carry]
    for column in meta.columns:
        level = decision.level(column)
        if level == DENY or column.name in carry:
            continue
        c = F.col(column.name)
        if level == MASK:
            rule = column.rule or MaskRule("REDACT", replacement="[REDACTED]")
            c = mask_column(c, column.name, df.schema[column.name].dataType, rule, master_key)
        out.append(c.alias(column.name))
    return df.select(*out)


def fan_out(df: DataFrame, column: str = "table_name") -> DataFrame:
    """One row per topic: the qualified name, the simple name and ``cdc_all``."""
    low = F.lower(column)
    topics = F.array_distinct(F.array(low, F.substring_index(low, ".", -1), F.lit("cdc_all")))
    return df.withColumn("topic", F.explode(topics))


def without_duplicates(df: DataFrame, keys: Sequence[str] = ("event_id",), remember: str = WATERMARK) -> DataFrame:
    """One event of each key.

    Keys are remembered by the time at which they arrive, for ``remember`` after it, then forgotten, so the state is bounded by
    the keys of that span. No event is too late by its own time: one whose key is not remembered always passes.
    """
    arrived = df.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", remember)
    return arrived.dropDuplicatesWithinWatermark(list(keys)).drop("_arrived")


def request_windows(df: DataFrame, client: str, at: str, seconds: int = 60) -> DataFrame:
    """Requests per client and clock window."""
    w = F.window(at, f"{seconds} seconds")
    return df.groupBy(w.alias("w"), F.col(client)).agg(F.count("*").alias("requests")).select(
        F.col("w.start").alias("window_start"), client, "requests"
    )


def breaches(windows: DataFrame, limit: int = 100) -> DataFrame:
    return windows.where(F.col("requests") > limit)


def session_breaches(df: DataFrame, client: str, at: str, limit: int = 100, seconds: int = 60) -> DataFrame:
    """Clock windows whose client went over the limit, with the excess."""
    return breaches(request_windows(df, client, at, seconds), limit).withColumn(
        "excess", F.col("requests") - limit
    )


def running_spend(df: DataFrame, tenant: str, cost: str, at: str, size: str = "1 day") -> DataFrame:
    return df.groupBy(F.window(at, size).alias("w"), F.col(tenant)).agg(F.sum(cost).alias("spend")).select(
        F.col("w.start").alias("period_start"), tenant, "spend"
    )


def merge_history(history: DataFrame | None, batch: DataFrame, at: str, event_id: str, n: int = REPLAY_EVENTS) -> DataFrame:
    """Last ``n`` events per topic after a batch."""
    both = batch if history is None else history.unionByName(batch)
    return latest_per_key(both, ["topic"], [F.desc(at), F.desc(event_id)], n)


def lag_report(df: DataFrame, position: str, acknowledged: str, limit: int = 1 << 30) -> DataFrame:
    """Bytes behind per slot and whether the limit is passed. Nothing is skipped."""
    lag = F.greatest(F.col(position) - F.col(acknowledged), F.lit(0))
    return df.groupBy("slot").agg(F.max(lag).alias("lag_bytes")).withColumn(
        "over_limit", F.col("lag_bytes") > limit
    )


def to_table(
    stream: DataFrame, mode: str = "append", label: str = "stream", keys: Sequence[str] = (), root: str | None = None
) -> DataFrame:
    """Runs a stream over everything available and returns the table it wrote.

    The files and the checkpoint lie in the shared scratch folder, so a restart goes on
    where the lost run stopped. In update mode a batch writes only the rows that it changed, and of each
    key (``keys``) the row of its last batch counts; null keys are keys like any other.
    """
    spark = stream.sparkSession
    root = root or scratch_path(spark, label)
    if mode == "append":
        query = (
            stream.writeStream.format("parquet")
            .option("path", f"{root}/out")
            .option("checkpointLocation", f"{root}/state")
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{root}/out")

    # Complete or update results: the batch number names the folder, so a batch that
    # runs again after a failure overwrites its own files.
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{root}/state")
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rows = spark.read.parquet(f"{root}/out")
    if mode == "complete":
        last = rows.agg(F.max("batch")).first()[0]
        rows = rows.where(F.col("batch") == last)
    elif keys:
        newest = F.max_by(F.struct(*stream.columns), "batch").alias("_row")
        rows = rows.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(newest).select("_row.*")
    return rows.drop("batch")


def governed_subscription(
    stream: DataFrame,
    decide: Callable[[], Decision],
    meta: TableMeta,
    carry: Sequence[str],
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
):
    """Starts a subscription that takes its decision anew for every batch, so a
    revocation takes effect at the next batch."""
    def each(batch: DataFrame, number: int) -> None:
        write(enforce(batch, meta, decide(), carry), number)

    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(each)
        .trigger(availableNow=True)
        .start()
    )


def subscription_payload(df: DataFrame, columns: Sequence[str]) -> Column:
    return F.to_json(F.struct(*columns))


def advance_watermarks(
    spark: SparkSession, root: str, number: int, batch: DataFrame, table: str, version: str
) -> None:
    """Appends the highest change version per table of one batch.

    Each batch has its own folder, so a batch that runs again replaces only itself.
    """
    high = batch.groupBy(table).agg(F.max(version).cast("long").alias("watermark"))
    high.write.mode("overwrite").parquet(f"{root}/versions/batch={number}")


def read_watermarks(spark: SparkSession, root: str, table: str) -> DataFrame:
    return (
        spark.read.parquet(f"{root}/versions").groupBy(table).agg(F.max("watermark").alias("watermark"))
    )

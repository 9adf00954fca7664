"""Masks and pseudonyms over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from consentry.functions.crypto import derive_key, hmac_text, key_pads, tenant_key
from consentry.functions.masks import (
    canonical_text,
    mask_auto,
    mask_column,
    mask_email,
    mask_iban,
    mask_nested,
    mask_phone,
    register_mask,
    static_mask,
)
from consentry.model import MaskRule
from consentry.queries.base import Frames, query

KEY = b"a-master-key-for-registered-queries"


def duck_hmac(blob: str, key: bytes) -> str:
    inner, outer = key_pads(key)
    return (
        f"upper(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || {blob}))))"
    )


@query(
    "m1_nullify",
    "SELECT c_custkey, CAST(NULL AS DOUBLE) AS acctbal, CAST(NULL AS VARCHAR) AS name FROM customer",
)
def nullify(t: Frames):
    rule = MaskRule("NULLIFY")
    return t.customer.select(
        "c_custkey",
        mask_column(F.col("c_acctbal"), "c_acctbal", T.DoubleType(), rule).alias("acctbal"),
        mask_column(F.col("c_name"), "c_name", T.StringType(), rule).alias("name"),
    )


@query(
    "m2_redact",
    """SELECT o_orderkey, CAST(0 AS BIGINT) AS custkey, CAST(0 AS DOUBLE) AS price,
              CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 'REDACTED' END AS status,
              '[HIDDEN]' AS priority, FALSE AS urgent
       FROM orders""",
)
def redact(t: Frames):
    rule = MaskRule("REDACT")
    status = F.nullif("o_orderstatus", F.lit("F"))
    return t.orders.select(
        "o_orderkey",
        mask_column(F.col("o_custkey"), "o_custkey", T.LongType(), rule).alias("custkey"),
        mask_column(F.col("o_totalprice"), "p", T.DoubleType(), rule).alias("price"),
        mask_column(status, "s", T.StringType(), rule).alias("status"),
        mask_column(
            F.col("o_orderpriority"), "o", T.StringType(), MaskRule("REDACT", replacement="[HIDDEN]")
        ).alias("priority"),
        mask_column(F.col("o_orderpriority") == "1-URGENT", "u", T.BooleanType(), rule).alias("urgent"),
    )


@query(
    "m3_hmac",
    f"""SELECT c_custkey, {duck_hmac("encode(c_name)", KEY)} AS name_hash,
               {duck_hmac("encode(CAST(c_custkey AS VARCHAR))", derive_key(KEY, "crm"))} AS key_hash
        FROM customer""",
)
def hmac_mask(t: Frames):
    return t.customer.select(
        "c_custkey",
        mask_column(F.col("c_name"), "c_name", T.StringType(), MaskRule("HMAC"), KEY).alias("name_hash"),
        mask_column(
            F.col("c_custkey"), "c_custkey", T.LongType(), MaskRule("HMAC_SHA256", key_id="crm"), KEY
        ).alias("key_hash"),
    )


EMAIL = """CASE user_id % 6 WHEN 0 THEN 'u' || CAST(user_id AS STRING) || '@mail.example.org'
    WHEN 1 THEN 'q@w.ee' WHEN 2 THEN 'ida' || CAST(event_id AS STRING) || '@intranet'
    WHEN 3 THEN 'plain words' WHEN 4 THEN 'ann@.x' ELSE NULL END"""


@query(
    "m4_mask_email",
    f"""WITH e AS (SELECT event_id, {EMAIL} AS email FROM events),
        p AS (SELECT event_id, email, instr(email, '@') AS a, substr(email, instr(email, '@') + 1) AS d FROM e)
        SELECT event_id, CASE WHEN email IS NULL THEN NULL WHEN a <= 2 THEN '***@***'
          WHEN regexp_matches(d, '^.+\\.[^.]*$') THEN email[1] || '***@***.' || regexp_extract(d, '([^.]*)$', 1)
          ELSE email[1] || '***@***' END AS masked FROM p""",
)
def email(t: Frames):
    return t.events.select("event_id", mask_email(F.expr(EMAIL)).alias("masked"))


IBAN = """CASE WHEN o_orderkey % 10 = 0 THEN 'abc' WHEN o_orderkey % 10 = 1 THEN 'abcdefgh'
    ELSE 'AT61 1904 ' || CAST(1000 + o_orderkey % 9000 AS STRING) || ' 0532 ' || CAST(o_custkey AS STRING) END"""


@query(
    "m5_mask_iban",
    f"""WITH v AS (SELECT o_orderkey, replace({IBAN}, ' ', '') AS c FROM orders)
        SELECT o_orderkey, CASE WHEN length(c) < 8 THEN '****'
          ELSE left(c, 2) || '** **** **** ' || right(c, 4) END AS masked FROM v""",
)
def iban(t: Frames):
    return t.orders.select("o_orderkey", mask_iban(F.expr(IBAN)).alias("masked"))


PHONE = """CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey AS STRING)
    WHEN c_custkey % 4 = 1 THEN '12345678' ELSE '+49170' || CAST(1000000 + c_custkey AS STRING) END"""


@query(
    "m6_mask_phone",
    f"""WITH v AS (SELECT c_custkey, {PHONE} AS p FROM customer)
        SELECT c_custkey, CASE WHEN length(p) <= 4 THEN repeat('*', length(p))
          WHEN length(p) <= 8 THEN left(p, 1) || repeat('*', length(p) - 2) || right(p, 1)
          ELSE left(p, 3) || repeat('*', length(p) - 6) || right(p, 3) END AS masked FROM v""",
)
def phone(t: Frames):
    return t.customer.select("c_custkey", mask_phone(F.expr(PHONE)).alias("masked"))


@query(
    "m7_mask_regex",
    """SELECT c_custkey, regexp_replace(c_name, '([A-Za-z]+)#0*([0-9]+)', '\\1-\\2', 'g') AS masked,
              'REDACTED' AS broken
       FROM customer""",
)
def regex(t: Frames):
    good = MaskRule("REGEX", pattern="([A-Za-z]+)#0*([0-9]+)", replacement="$1-$2")
    bad = MaskRule("REGEX", pattern="([", replacement="x")
    c = F.col("c_name")
    return t.customer.select(
        "c_custkey",
        mask_column(c, "c_name", T.StringType(), good).alias("masked"),
        mask_column(c, "c_name", T.StringType(), bad).alias("broken"),
    )


@query(
    "m8_mask_auto",
    """SELECT p_partkey,
              CASE WHEN length(p_name) <= 4 THEN repeat('*', length(p_name))
                ELSE left(p_name, 2) || repeat('*', length(p_name) - 4) || right(p_name, 2) END AS generic,
              CASE WHEN length(p_brand) <= 4 THEN repeat('*', length(p_brand))
                WHEN length(p_brand) <= 8 THEN left(p_brand, 1) || repeat('*', length(p_brand) - 2) || right(p_brand, 1)
                ELSE left(p_brand, 3) || repeat('*', length(p_brand) - 6) || right(p_brand, 3) END AS telephone,
              left(p_type, 1) || '***@***.com' AS contact
       FROM part""",
)
def auto(t: Frames):
    contact = F.concat("p_type", F.lit("@x.com"))
    return t.part.select(
        "p_partkey",
        mask_auto(F.col("p_name"), "p_name").alias("generic"),
        mask_auto(F.col("p_brand"), "telephone").alias("telephone"),
        mask_auto(contact, "contact").alias("contact"),
    )


@query(
    "m9_hmac_bytes",
    f"""SELECT vec_id, {duck_hmac("unhex(sha256(CAST(vec_id AS VARCHAR)))", KEY)} AS bytes_hash,
               'REDACTED' AS as_email FROM embeddings""",
)
def binary(t: Frames):
    raw = F.unhex(F.sha2(F.col("vec_id").cast("string"), 256))
    return t.embeddings.select(
        "vec_id",
        mask_column(raw, "b", T.BinaryType(), MaskRule("HMAC"), KEY).alias("bytes_hash"),
        mask_column(raw, "email", T.BinaryType(), MaskRule("MASK_EMAIL"), KEY).alias("as_email"),
    )


@query(
    "m10_canonical_text",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '0Z' AS stamp,
              strftime(ts, '%Y-%m-%d') AS day,
              CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'
                   ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS text
       FROM events""",
)
def canonical(t: Frames):
    e = t.events
    iso = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    )
    return e.select(
        "event_id",
        canonical_text(F.col("ts"), e.schema["ts"].dataType).alias("stamp"),
        canonical_text(F.to_date("ts"), T.DateType()).alias("day"),
        canonical_text(iso, T.StringType()).alias("text"),
    )


@query(
    "m11_tenant_pseudonym",
    f"""SELECT user_id, {duck_hmac("encode(CAST(user_id AS VARCHAR))", tenant_key(KEY, "tenant-a", "crm"))} AS in_a,
               {duck_hmac("encode(CAST(user_id AS VARCHAR))", tenant_key(KEY, "tenant-b", "crm"))} AS in_b,
               count(*) AS n
        FROM events GROUP BY user_id""",
)
def tenant_pseudonym(t: Frames):
    text = F.col("user_id").cast("string")
    # Grouped first: one hash per user instead of one per event.
    return (
        t.events.groupBy("user_id")
        .agg(F.count("*").alias("n"))
        .select(
            "user_id",
            hmac_text(text, tenant_key(KEY, "tenant-a", "crm")).alias("in_a"),
            hmac_text(text, tenant_key(KEY, "tenant-b", "crm")).alias("in_b"),
            "n",
        )
    )


@query(
    "m12_static_mask",
    """SELECT s_suppkey, '***' AS name, 'n/a' AS nation, CAST(NULL AS DOUBLE) AS acctbal FROM supplier""",
)
def static(t: Frames):
    return t.supplier.select(
        "s_suppkey",
        static_mask(T.StringType(), None).alias("name"),
        static_mask(T.StringType(), MaskRule("REDACT", replacement="n/a")).alias("nation"),
        static_mask(T.DoubleType(), MaskRule("NULLIFY")).alias("acctbal"),
    )


@query(
    "m13_mask_nested",
    """SELECT o_orderkey,
              'o***@***.org' AS owner_email, CAST(o_custkey AS VARCHAR) AS owner_id,
              CAST(0 AS DOUBLE) AS salary, 'x***@***.net' AS first_mail,
              '+49****' || right(CAST(1000 + o_orderkey % 9000 AS VARCHAR), 3) AS aliased
       FROM orders""",
)
def nested(t: Frames):
    rows = t.orders.select(
        "o_orderkey",
        F.struct(
            F.lit("owner@corp.org").alias("email"),
            F.col("o_custkey").cast("string").alias("id"),
            F.struct(F.col("o_totalprice").alias("salary")).alias("pay"),
        ).alias("owner"),
        F.array(F.struct(F.lit("xy@host.net").alias("mail"))).alias("contacts"),
        # "x" is a response alias of a phone field.
        F.concat(F.lit("+49999"), (F.col("o_orderkey") % 9000 + 1000).cast("string")).alias("x"),
    )
    masked = mask_nested(rows, {"x": "phone"})
    return masked.select(
        "o_orderkey",
        F.col("owner.email").alias("owner_email"),
        F.col("owner.id").alias("owner_id"),
        F.col("owner.pay.salary").alias("salary"),
        F.col("contacts")[0]["mail"].alias("first_mail"),
        F.col("x").alias("aliased"),
    )


register_mask(
    "FIRST_LETTER", lambda c, name, dtype, rule, key: F.concat(F.left(c, F.lit(1)), F.lit("."))
)


@query("x3_custom_mask", "SELECT p_partkey, left(p_name, 1) || '.' AS name FROM part")
def custom_mask(t: Frames):
    return t.part.select(
        "p_partkey",
        mask_column(F.col("p_name"), "p_name", T.StringType(), MaskRule("FIRST_LETTER")).alias("name"),
    )


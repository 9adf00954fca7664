"""Golden values of the masks."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from consentry.functions import masks as M
from consentry.functions.crypto import derive_key, hmac_hex, hmac_text, tenant_key
from consentry.model import MaskRule


def one(spark, make, value, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(make(F.col("v")).alias("m")).first()[0]


@pytest.mark.parametrize(
    ("value", "masked"),
    [
        ("zoe@lake.example", "z***@***.example"),
        ("max.q@a.b.c.d", "m***@***.d"),
        ("ida@intranet", "i***@***"),
        ("q@w.ee", "***@***"),
        ("@", "***@***"),
        ("plain words", "***@***"),
        ("ann@.x", "a***@***"),
        ("no@two@signs.io", "n***@***.io"),
        (None, None),
    ],
)
def test_email(spark, value, masked):
    assert one(spark, M.mask_email, value) == masked


@pytest.mark.parametrize(
    ("value", "masked"),
    [
        ("AT611904300234573201", "AT** **** **** 3201"),
        ("AT61 1904 3002 3457 3201", "AT** **** **** 3201"),
        ("x y z w v u t 1 2", "xy** **** **** ut12"),
        ("abc", "****"),
        ("ab cd ef g", "****"),
        ("abcdefgh", "ab** **** **** efgh"),
        (None, None),
    ],
)
def test_iban(spark, value, masked):
    assert one(spark, M.mask_iban, value) == masked


@pytest.mark.parametrize(
    ("value", "masked"),
    [("55", "**"), ("90210", "9***0"), ("8887766", "8*****6"), ("+4366012", "+******2"), ("004366098765", "004******765")],
)
def test_phone(spark, value, masked):
    assert one(spark, M.mask_phone, value) == masked


@pytest.mark.parametrize(
    ("name", "value", "masked"),
    [
        ("email", "zoe@lake.example", "z***@***.example"),
        ("note", "zoe@lake.example", "z***@***.example"),
        ("my_iban", "AT611904300234573201", "AT** **** **** 3201"),
        ("TelNo", "8887766", "8*****6"),
        ("note", "wxyz", "****"),
        ("note", "uvwxyz", "uv**yz"),
        ("note", "", ""),
    ],
)
def test_auto_format(spark, name, value, masked):
    rule = MaskRule("REGEX", pattern="")
    assert one(spark, lambda c: M.mask_column(c, name, T.StringType(), rule), value) == masked


def test_pattern_rules(spark):
    def apply(rule, value):
        return one(spark, lambda c: M.mask_column(c, "x", T.StringType(), rule), value)

    assert apply(MaskRule("REGEX", pattern=r"\d", replacement="#"), "a1b22") == "a#b##"
    assert apply(MaskRule("REGEX", pattern="([", replacement="#"), "a1") == "REDACTED"
    assert apply(MaskRule("REGEX", pattern="mask_last_four"), "AT611904300234573201") == "AT** **** **** 3201"
    assert apply(MaskRule("SOMETHING"), "a1") == "REDACTED"
    assert apply(MaskRule("REDACT", replacement="-"), "a1") == "-"


@pytest.mark.parametrize(
    ("kind", "dtype", "value", "masked"),
    [
        ("int", T.IntegerType(), 7, 0),
        ("double", T.DoubleType(), 7.5, 0.0),
        ("boolean", T.BooleanType(), True, False),
        ("string", T.StringType(), "x", "REDACTED"),
        ("int", T.IntegerType(), None, None),
    ],
)
def test_redact_keeps_type(spark, kind, dtype, value, masked):
    assert one(spark, lambda c: M.mask_column(c, "x", dtype, MaskRule("REDACT")), value, kind) == masked


@pytest.mark.parametrize("text", ["", "a", "Zürich", "x" * 300, "a|b\\c"])
def test_hmac_equals_library(spark, text):
    for key in (b"k", b"k" * 64, b"k" * 100):
        want = hmac.new(key, text.encode(), hashlib.sha256).hexdigest().upper()
        assert one(spark, lambda c, key=key: hmac_text(c, key), text) == want


def test_hmac_of_bytes(spark):
    raw = bytes(range(40))
    want = hmac.new(b"key", raw, hashlib.sha256).hexdigest().upper()
    assert one(spark, lambda c: hmac_hex(c, b"key"), bytearray(raw), "binary") == want


def test_keys_differ_by_name_and_tenant():
    assert derive_key(b"m", None) == b"m"
    assert derive_key(b"m", "a") != derive_key(b"m", "b")
    assert tenant_key(b"m", "t1", "a") != tenant_key(b"m", "t2", "a")


def test_same_instant_hashes_alike(spark):
    rule = MaskRule("HMAC")
    row = spark.sql(
        "SELECT TIMESTAMP '2024-05-01 10:00:00+00:00' AS a, TIMESTAMP '2024-05-01 12:00:00+02:00' AS b, "
        "TIMESTAMP_NTZ '2024-05-01 10:00:00' AS c"
    )
    cells = [M.mask_column(F.col(f.name), f.name, f.dataType, rule, b"key").alias(f.name) for f in row.schema]
    masked = row.select(*cells).first()
    assert masked.a == masked.b == masked.c


def test_numbers_have_one_text(spark):
    assert one(spark, lambda c: M.canonical_text(c, T.DoubleType()), 2.0, "double") == "2"
    assert one(spark, lambda c: M.canonical_text(c, T.DoubleType()), 2.5, "double") == "2.5"


def test_nested_names(spark):
    df = spark.createDataFrame(
        [((1, "a@b.org", ("5", 9.0)), [("x@y.net",), (None,)])],
        "u struct<id:int,workEmail:string,pay:struct<mobile:string,salary:double>>, l array<struct<mail:string>>",
    )
    row = M.mask_nested(df).first()
    assert row.u.id == 1 and row.u.workEmail == "***@***"
    assert row.u.pay.mobile == "*" and row.u.pay.salary == 0.0
    assert [x.mail for x in row.l] == ["***@***", None]


def test_nested_maps(spark):
    df = spark.createDataFrame(
        [({"Email": "joe@x.org", "SSN": "1", "note": "n", "phoneNo": None}, {"a": ("b@c.de",)})],
        "m map<string,string>, n map<string,struct<mail:string>>",
    )
    row = M.mask_nested(df).first()
    assert row.m == {"Email": "j***@***.org", "SSN": "REDACTED", "note": "n", "phoneNo": None}
    assert row.n["a"].mail == "***@***"


def test_keyed_masks_need_a_key():
    with pytest.raises(ValueError):
        M.mask_column(F.col("x"), "x", T.StringType(), MaskRule("HMAC"))

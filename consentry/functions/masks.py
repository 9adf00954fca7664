"""Column masks. Every mask is a native expression, so masked scans stay in codegen."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from consentry.functions.crypto import derive_key, hmac_hex, hmac_text
from consentry.model import MaskRule

def canonical_text(c: Column, dtype: T.DataType) -> Column:
    """Text form that does not depend on locale or time zone; the input of every hash."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0Z"))
    if isinstance(dtype, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return F.when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))
    if isinstance(dtype, T.BooleanType):
        return F.initcap(c.cast("string"))
    text = c.cast("string")
    if not isinstance(dtype, T.StringType):
        return text
    zoneless = (
        (F.length(c) >= 19)
        & (F.substring(c, 11, 1) == "T")
        & ~c.endswith("Z")
        & ~c.contains("+")
        & (F.instr(F.substr(c, F.lit(12)), "-") == 0)
    )
    return F.when(zoneless, F.concat(c, F.lit("Z"))).otherwise(c)


def mask_email(c: Column) -> Column:
    at = F.instr(c, "@")
    domain = F.substr(c, at + 1)
    tld = F.substring_index(domain, ".", -1)
    first = F.left(c, F.lit(1))
    return (
        F.when(at <= 2, F.lit("***@***"))
        .when(F.length(domain) - F.length(tld) > 1, F.concat(first, F.lit("***@***."), tld))
        .otherwise(F.concat(first, F.lit("***@***")))
    )


def mask_iban(c: Column) -> Column:
    clean = F.replace(c, F.lit(" "), F.lit(""))
    shown = F.concat(F.left(clean, F.lit(2)), F.lit("** **** **** "), F.right(clean, F.lit(4)))
    return F.when(F.length(clean) < 8, F.lit("****")).otherwise(shown)


def _keep_ends(c: Column, keep: Column | int) -> Column:
    keep = keep if isinstance(keep, Column) else F.lit(keep)
    stars = F.repeat(F.lit("*"), F.length(c) - keep * 2)
    return F.concat(F.left(c, keep), stars, F.right(c, keep))


def _all_stars(c: Column) -> Column:
    return F.repeat(F.lit("*"), F.length(c))


def mask_phone(c: Column) -> Column:
    n = F.length(c)
    keep = F.when(n <= 8, F.lit(1)).otherwise(F.lit(3))
    return F.when(n <= 4, _all_stars(c)).otherwise(_keep_ends(c, keep))


def mask_auto(c: Column, name: str) -> Column:
    """Format chosen by the column name, or by an ``@`` in the value."""
    lowered = name.lower()
    if "email" in lowered:
        return F.when(c == "", c).otherwise(mask_email(c))
    if "iban" in lowered:
        rest = mask_iban(c)
    elif "phone" in lowered or "tel" in lowered:
        rest = mask_phone(c)
    else:
        rest = F.when(F.length(c) <= 4, _all_stars(c)).otherwise(_keep_ends(c, 2))
    return F.when(c == "", c).when(c.contains("@"), mask_email(c)).otherwise(rest)


def _mask_by_pattern(c: Column, name: str, rule: MaskRule) -> Column:
    form = (rule.pattern or "").upper()
    if form == "MASK_EMAIL":
        masked = mask_email(c)
    elif form in ("MASK_LAST_FOUR", "MASK_IBAN"):
        masked = mask_iban(c)
    elif rule.pattern and rule.replacement:
        try:
            re.compile(rule.pattern)
        except re.error:
            masked = F.lit("REDACTED")
        else:
            masked = F.regexp_replace(c, F.lit(rule.pattern), F.lit(rule.replacement))
    else:
        return mask_auto(c, name)
    return F.when(c == "", c).otherwise(masked)


def _redact(c: Column, dtype: T.DataType, rule: MaskRule) -> Column:
    if isinstance(dtype, T.BooleanType):
        neutral = F.lit(False)
    elif isinstance(dtype, T.NumericType):
        neutral = F.lit(0).cast(dtype)
    else:
        neutral = F.lit("REDACTED" if rule.replacement is None else rule.replacement)
    return F.when(c.isNotNull(), neutral)


MaskFunction = Callable[[Column, str, T.DataType, MaskRule, bytes], Column]
_CUSTOM: dict[str, MaskFunction] = {}


def register_mask(rule_type: str, function: MaskFunction) -> None:
    """Adds a rule type: ``function(column, name, type, rule, master_key) -> Column``."""
    _CUSTOM[rule_type.upper()] = function


def mask_column(
    c: Column,
    name: str,
    dtype: T.DataType,
    rule: MaskRule | None,
    master_key: bytes | None = None,
) -> Column:
    """Masked form of a column; a sensitive column without a rule is redacted.

    Keyed masks need a ``master_key``; there is no default one.
    """
    rule = rule or MaskRule("REDACT")
    kind = (rule.rule_type or "REDACT").upper()
    if kind in _CUSTOM:
        return _CUSTOM[kind](c, name, dtype, rule, master_key)
    if kind == "NULLIFY":
        return F.lit(None).cast(dtype)
    if kind == "REDACT":
        return _redact(c, dtype, rule)
    if kind in ("HMAC", "HMAC_SHA256"):
        if not master_key:
            raise ValueError(f"the mask of {name!r} needs a master key")
        key = derive_key(master_key, rule.key_id)
        if isinstance(dtype, T.BinaryType):
            return hmac_hex(c, key)
        return hmac_text(canonical_text(c, dtype), key)
    if isinstance(dtype, T.BinaryType):
        return _redact(c, dtype, rule)
    text = canonical_text(c, dtype)
    if kind == "MASK_EMAIL":
        return mask_email(text)
    if kind == "MASK_IBAN":
        return mask_iban(text)
    if kind == "MASK_PHONE":
        return mask_phone(text)
    if kind == "REGEX":
        return _mask_by_pattern(text, name, rule)
    return _redact(c, T.StringType(), rule)


def static_mask(dtype: T.DataType, rule: MaskRule | None) -> Column:
    """The database-side mask: one constant for the whole column."""
    rule = rule or MaskRule()
    if (rule.rule_type or "").upper() == "NULLIFY":
        return F.lit(None).cast(dtype)
    return F.lit(rule.replacement if rule.replacement is not None else "***")


def is_effective_hmac(rule: MaskRule | None) -> bool:
    return rule is not None and (rule.rule_type or "").upper() in ("HMAC", "HMAC_SHA256")


# Name fragments that mark a field of a nested result as sensitive.
_EMAIL_PARTS = ("email",)
_IBAN_PARTS = ("iban", "bankaccount")
_PHONE_PARTS = ("phone", "mobile", "telefon")
_REDACT_PARTS = (
    "socialsecurity", "salary", "gehalt", "compensation", "wage", "balance", "saldo", "taxid",
    "steuernummer", "birth", "geburtsdatum", "creditcard", "passwort", "password",
)
_REDACT_NAMES = ("ssn", "diagnosis", "medicalrecord", "healthcondition")


def rule_for_name(name: str) -> MaskRule | None:
    """Mask rule implied by a field name alone, or None."""
    n = name.lower()
    if any(p in n for p in _EMAIL_PARTS) or n.endswith("mail"):
        return MaskRule("MASK_EMAIL")
    if any(p in n for p in _IBAN_PARTS):
        return MaskRule("MASK_IBAN")
    if any(p in n for p in _PHONE_PARTS):
        return MaskRule("MASK_PHONE")
    if n in _REDACT_NAMES or any(p in n for p in _REDACT_PARTS):
        return MaskRule("REDACT")
    return None


def _mask_by_key(key: Column, value: Column) -> Column:
    """Masks a text by the name it is stored under; names are known at run time only."""
    name = F.lower(key)

    def has(parts: tuple[str, ...]) -> Column:
        found = F.lit(False)
        for p in parts:
            found = found | name.contains(p)
        return found

    return (
        F.when(value.isNull(), value)
        .when(has(_EMAIL_PARTS) | name.endswith("mail"), mask_email(value))
        .when(has(_IBAN_PARTS), mask_iban(value))
        .when(has(_PHONE_PARTS), mask_phone(value))
        .when(has(_REDACT_PARTS) | name.isin(*_REDACT_NAMES), F.lit("REDACTED"))
        .otherwise(value)
    )


def mask_nested(
    df: DataFrame,
    aliases: dict[str, str] | None = None,
    master_key: bytes | None = None,
) -> DataFrame:
    """Masks sensitive names at any depth. The schema is walked once, on the driver.

    ``aliases`` maps a dotted response path to the real field name.
    """
    real = aliases or {}

    def walk(c: Column, name: str, dtype: T.DataType, path: str) -> Column:
        rule = (rule_for_name(real[path]) if path in real else None) or rule_for_name(name)
        if rule is not None:
            if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
                return F.when(c.isNotNull(), F.lit("REDACTED"))
            return mask_column(c, name, dtype, rule, master_key)
        return inside(c, dtype, path)

    def inside(c: Column, dtype: T.DataType, path: str) -> Column:
        if isinstance(dtype, T.StructType):
            fields = [
                walk(c[f.name], f.name, f.dataType, f"{path}.{f.name}").alias(f.name)
                for f in dtype.fields
            ]
            return F.when(c.isNotNull(), F.struct(*fields))
        if isinstance(dtype, T.ArrayType):
            return F.transform(c, lambda x: inside(x, dtype.elementType, path))
        if isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
            if isinstance(dtype.valueType, T.StringType):
                return F.transform_values(c, _mask_by_key)
            return F.transform_values(c, lambda k, v: inside(v, dtype.valueType, path))
        return c

    return df.select(
        *[walk(F.col(f"`{f.name}`"), f.name, f.dataType, f.name).alias(f.name) for f in df.schema]
    )

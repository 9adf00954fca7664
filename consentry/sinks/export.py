"""Exports: Parquet, JSON rows, cost CSV."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from consentry.functions.shapes import flatten, normalised

COMPRESSION = {"none": "uncompressed", "snappy": "snappy", "gzip": "gzip"}


@dataclass
class ExportResult:
    path: str
    truncated: bool


def capped(df: DataFrame, requested: int | None, configured: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows up to the cap, one-row frame telling whether more exist).

    The cap is the smaller of the two limits; without any limit everything is written.
    """
    limits = [n for n in (requested, configured) if n]
    if not limits:
        return df, df.sparkSession.range(1).select(F.lit(False).alias("is_truncated"))
    cap = min(limits)
    more = df.limit(cap + 1).agg((F.count("*") > cap).alias("is_truncated"))
    return df.limit(cap), more


def export_parquet(
    df: DataFrame,
    path: str,
    rows: int | None = None,
    compression: str = "snappy",
    configured: int | None = None,
) -> ExportResult:
    """Flattens and writes; an empty result still leaves files with a schema."""
    flat = flatten(df)
    out, more = capped(flat, rows, configured)
    out.write.mode("errorifexists").option("compression", COMPRESSION[compression.lower()]).parquet(path)
    return ExportResult(path, bool(more.first()[0]))


def json_rows(df: DataFrame, form: str = "objects") -> DataFrame:
    """One JSON text per row: an object, or an array of the values in column order."""
    if form == "objects":
        return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row"))

    def cell(f: T.StructField) -> Column:
        c = normalised(F.col(f.name), f.dataType)
        if isinstance(f.dataType, (T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType, T.BinaryType)):
            quoted = F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
        elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            quoted = F.to_json(c)
        else:
            quoted = c.cast("string")
        return F.when(c.isNull(), "null").otherwise(quoted)

    cells = [cell(f) for f in df.schema]
    return df.select(F.concat(F.lit("["), F.concat_ws(",", *cells), F.lit("]")).alias("row"))


def csv_safe(c: Column) -> Column:
    """Text a spreadsheet will not run as a formula."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def csv_line(*columns: Column) -> Column:
    """One quoted CSV line; quotes are doubled."""
    quoted = [
        F.concat(F.lit('"'), F.replace(csv_safe(c), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns
    ]
    return F.concat_ws(",", *quoted)


# Columns of the cost export, in order; those in the second list are bare.
FOCUS_COLUMNS = (
    "ChargePeriodStart", "ChargePeriodEnd", "BilledCost", "EffectiveCost", "Currency",
    "ConsumedQuantity", "ConsumedUnit", "SubAccountId", "ResourceId", "ServiceName",
    "PricingCategory",
)
FOCUS_NUMBERS = ("BilledCost", "EffectiveCost", "ConsumedQuantity")


def focus_lines(records: DataFrame) -> DataFrame:
    """Cost records as CSV lines; text is quoted, numbers are not."""
    types = {f.name: f.dataType for f in records.schema}

    def cell(name: str) -> Column:
        if name in FOCUS_NUMBERS:
            return F.col(name).cast("string")
        return csv_line(normalised(F.col(name), types[name]))

    return records.select(F.concat_ws(",", *[cell(c) for c in FOCUS_COLUMNS]).alias("line"))


def write_focus_csv(records: DataFrame, path: str) -> None:
    """One folder of part files; each starts with the header, as readers of folders expect."""
    header = ",".join(FOCUS_COLUMNS)
    lines = focus_lines(records)

    def with_header(batches):
        first = True
        for batch in batches:
            if first:
                batch = pd.concat([pd.DataFrame({"line": [header]}), batch], ignore_index=True)
                first = False
            yield batch

    lines.mapInPandas(with_header, "line string").write.text(path)


def write_csv(df: DataFrame, path: str) -> None:
    safe = df.select(*[csv_safe(F.col(f.name)).alias(f.name) for f in df.schema])
    safe.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def apply_egress(df: DataFrame, chain) -> DataFrame:
    """Runs a result through an ordered list of ``DataFrame -> DataFrame`` steps."""
    for step in chain:
        df = df.transform(step)
    return df

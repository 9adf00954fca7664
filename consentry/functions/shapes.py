"""Shapes of exported rows: flattening, type widening, normalised read values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_FLATTEN_DEPTH = 16


def flatten(df: DataFrame, project: Sequence[str] | None = None) -> DataFrame:
    """Nested fields become ``a.b`` columns, lists and maps JSON text.

    Projecting ``a`` takes ``a`` and every ``a.*`` column.
    """
    out: list[tuple[str, Column]] = []

    def walk(c: Column, dtype: T.DataType, name: str, depth: int) -> None:
        if isinstance(dtype, T.StructType) and depth < MAX_FLATTEN_DEPTH:
            for f in dtype.fields:
                walk(c[f.name], f.dataType, f"{name}.{f.name}", depth + 1)
        elif isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            out.append((name, F.to_json(c)))
        else:
            out.append((name, c))

    for field in df.schema:
        walk(F.col(f"`{field.name}`"), field.dataType, field.name, 0)
    if project:
        wanted = [p.lower() for p in project]
        out = [
            (n, c)
            for n, c in out
            if any(n.lower() == p or n.lower().startswith(p + ".") for p in wanted)
        ]
    return df.select(*[c.alias(n) for n, c in out])


# Rank of a value's kind; numeric kinds widen upward, any other mix is text.
_KIND_RANK = {"int": 1, "long": 2, "decimal": 3, "double": 4}
_RANK_TYPE = {1: "int", 2: "bigint", 3: "decimal(38,18)", 4: "double"}


def value_kind(text: Column) -> Column:
    """Kind of a JSON scalar given as text."""
    whole = text.rlike(r"^-?\d+$")
    small = text.try_cast("int").isNotNull()
    return (
        F.when(text.isNull(), F.lit(None))
        .when(whole & small, "int")
        .when(whole & text.try_cast("bigint").isNotNull(), "long")
        .when(whole, "decimal")
        .when(text.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), "double")
        .when(F.lower(text).isin("true", "false"), "boolean")
        .otherwise("string")
    )


def widened_type(kind: Column) -> Column:
    """Aggregate: the narrowest type that holds every value of a column."""
    rank = F.coalesce(*[F.when(kind == k, F.lit(r)) for k, r in _KIND_RANK.items()])
    numeric = F.count_if(rank.isNotNull())
    other = F.count_if(kind.isNotNull() & rank.isNull())
    booleans = F.count_if(kind == "boolean")
    top = F.max(rank)
    by_rank = F.coalesce(*[F.when(top == r, F.lit(t)) for r, t in _RANK_TYPE.items()])
    return (
        F.when((numeric > 0) & (other == 0), by_rank)
        .when((booleans > 0) & (booleans == other) & (numeric == 0), "boolean")
        .otherwise("string")
    )


def normalised(c: Column, dtype: T.DataType) -> Column:
    """Value as readers expect it: UTC ISO text for times, base64 for bytes."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    if isinstance(dtype, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(dtype, T.BinaryType):
        return F.base64(c)
    return c


def normalised_frame(df: DataFrame) -> DataFrame:
    return df.select(*[normalised(F.col(f.name), f.dataType).alias(f.name) for f in df.schema])


def row_size_estimate(df: DataFrame) -> Column:
    """Bytes one row takes in a response: names, text, bytes, 16 for anything else."""
    total = F.lit(0).cast("long")
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            size = F.coalesce(F.length(c) * 2, F.lit(16))
        elif isinstance(f.dataType, T.BinaryType):
            size = F.coalesce(F.length(c), F.lit(16))
        else:
            size = F.lit(16)
        total = total + 2 * len(f.name) + size
    return total


def coerce_parameter(value, kind: str, required: bool = False, default=None, name: str = "?"):
    """A request parameter as a Python value of its declared kind."""
    import datetime as dt
    import decimal
    import uuid

    if value is None or value == "":
        if default is not None:
            return coerce_parameter(default, kind, name=name)
        if required:
            raise ValueError(f"parameter {name!r} is required")
        return None
    text = str(value).strip()
    try:
        match kind.lower():
            case "int" | "integer" | "long" | "bigint":
                number = int(text)
                bits = 31 if kind.lower() in ("int", "integer") else 63
                if not -(2**bits) <= number < 2**bits:
                    raise ValueError("out of range")
                return number
            case "decimal" | "numeric":
                return decimal.Decimal(text)
            case "double" | "float":
                return float(text)
            case "bool" | "boolean":
                if text.lower() not in ("true", "false"):
                    raise ValueError("not a boolean")
                return text.lower() == "true"
            case "datetime" | "timestamp" | "date":
                return dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
            case "guid" | "uuid":
                return str(uuid.UUID(text))
            case _:
                return str(value)
    except (ValueError, decimal.InvalidOperation) as error:
        raise ValueError(f"parameter {name!r} is not a valid {kind}: {value!r}") from error

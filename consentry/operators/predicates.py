"""Row predicates: filter trees, consent conditions, key sets and policy templates.

Everything is a ``Column`` (or a semi join), so Catalyst merges it with the scan and
pushes what it can down to the files.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from consentry.model import CLEAR, Condition, Consent, Subject

MAX_DEPTH = 15
MAX_VALUES = 500
# A literal list longer than this becomes a semi join instead of an IN list.
IN_LIST_LIMIT = 1000


class GovernanceError(Exception):
    """The request is refused."""


def all_of(predicates: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates)


def any_of(predicates: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates)


def check_identifier(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name or ""):
        raise GovernanceError(f"not a column name: {name!r}")
    return name


def _typed(value: Any, dtype: T.DataType) -> Column:
    """A literal of the column's type; a value that does not convert compares as NULL."""
    return F.lit(value).try_cast(dtype)


def _column(schema: T.StructType, name: str) -> tuple[Column, T.DataType]:
    check_identifier(name)
    for f in schema.fields:
        if f.name.lower() == name.lower():
            return F.col(f.name), f.dataType
    raise GovernanceError(f"unknown column {name!r}")


def compare(column: Column, dtype: T.DataType, op: str, value: Any) -> Column:
    """One comparison. NULL only fits equality, an empty list matches nothing."""
    op = op.upper()
    if op == "IN":
        items = list(value or [])
        if not items:
            return F.lit(False)
        return column.isin(*[_typed(v, dtype) for v in items])
    if value is None:
        if op in ("EQ", "NEQ"):
            return column.isNull() if op == "EQ" else column.isNotNull()
        raise GovernanceError(f"{op} cannot be compared with null")
    if op == "CONTAINS":
        return column.contains(str(value))
    if op == "STARTSWITH":
        return column.startswith(str(value))
    if op == "ENDSWITH":
        return column.endswith(str(value))
    if op == "LIKE":
        return column.like(str(value))
    literal = _typed(value, dtype)
    if op == "NEQ":
        return column != literal
    if op in ("GT",):
        return column > literal
    if op in ("GTE",):
        return column >= literal
    if op in ("LT",):
        return column < literal
    if op in ("LTE",):
        return column <= literal
    return column == literal


def filter_tree(
    tree: Mapping[str, Any], schema: T.StructType, levels: Mapping[str, int] | None = None
) -> Column | None:
    """``{and: [...], or: [...], column: {op: value}}`` as a predicate.

    With ``levels`` given, a column the caller does not see in clear is refused:
    filtering on it would reveal the hidden value.
    """
    used = [0]

    def build(node: Mapping[str, Any], depth: int) -> Column | None:
        if depth > MAX_DEPTH:
            raise GovernanceError(f"filter deeper than {MAX_DEPTH}")
        parts: list[Column] = []
        for key, body in node.items():
            if key.lower() in ("and", "or"):
                branches = body if isinstance(body, Sequence) else [body]
                found = [p for p in (build(b, depth + 1) for b in branches) if p is not None]
                if found:
                    parts.append(all_of(found) if key.lower() == "and" else any_of(found))
                continue
            if levels is not None and levels.get(key.lower()) != CLEAR:
                raise GovernanceError(f"no clear access to filter column {key!r}")
            column, dtype = _column(schema, key)
            tests = body if isinstance(body, Mapping) else {"eq": body}
            for op, value in tests.items():
                used[0] += len(value) if op == "in" and value else 1
                if used[0] > MAX_VALUES:
                    raise GovernanceError(f"more than {MAX_VALUES} filter values")
                parts.append(compare(column, dtype, op, value))
        return all_of(parts) if parts else None

    return build(tree, 1)


def equality_arguments(
    args: Mapping[str, Any], schema: T.StructType, levels: Mapping[str, int]
) -> list[Column]:
    """``argument = column`` for columns in clear; paging arguments, nulls and names that
    are no columns do not count."""
    found = []
    for name, value in args.items():
        if name.lower() in ("limit", "offset") or value is None or name.lower() not in levels:
            continue
        if levels.get(name.lower()) != CLEAR:
            raise GovernanceError(f"no clear access to argument column {name!r}")
        column, dtype = _column(schema, name)
        found.append(compare(column, dtype, "EQ", value))
    return found


def _json_predicates(spec: Any, alias: str, schema: T.StructType) -> list[Column]:
    """``{col: value}`` or ``[{column, op, value}]`` on the dependent table."""
    if not spec:
        return []
    if isinstance(spec, Mapping):
        items = [(k, "EQ", v) for k, v in spec.items()]
    else:
        items = [(p["column"], p.get("op", "EQ"), p.get("value")) for p in spec]
    out = []
    for name, op, value in items:
        _, dtype = _column(schema, name)
        out.append(compare(F.col(f"{alias}__{name}"), dtype, op, value))
    return out


def correlated_exists(cond: Condition, tables: Mapping[str, DataFrame]) -> Column:
    """EXISTS over dependent rows, with further hops and a half-open validity interval.

    A correlated subquery keeps the condition usable under OR and NOT; Catalyst turns
    it into a semi, anti or existence join on the foreign key.
    """
    def named(frame: DataFrame, alias: str) -> DataFrame:
        # Prefixed names, so that the outer row's columns cannot be captured here.
        return frame.select(*[F.col(c).alias(f"{alias}__{c}") for c in frame.columns])

    def inner(reference: str) -> Column:
        return F.col(reference.replace(".", "__", 1))

    frames = {"dep": tables[cond.dependent], **{h.alias: tables[h.table] for h in cond.hops}}
    dep = named(frames["dep"], "dep")
    for hop in cond.hops:
        dep = dep.join(named(frames[hop.alias], hop.alias), inner(hop.left) == inner(hop.right))
    tests = [inner(f"dep.{cond.primary_key}") == F.col(cond.foreign_key).outer()]
    if cond.event_time and cond.valid_from:
        at = F.col(cond.event_time).outer()
        tests.append(at >= inner(f"dep.{cond.valid_from}"))
        if cond.valid_to:
            end = inner(f"dep.{cond.valid_to}")
            tests.append(end.isNull() | (at < end))
    spec = json.loads(cond.predicate) if isinstance(cond.predicate, str) else cond.predicate
    by_alias = spec if isinstance(spec, Mapping) and set(spec) & set(frames) else {"dep": spec}
    for alias, tests_of in by_alias.items():
        tests += _json_predicates(tests_of, alias, frames[alias].schema)
    return dep.where(all_of(tests)).exists()


def condition(
    cond: Condition,
    schema: T.StructType,
    subject: Subject | None = None,
    tables: Mapping[str, DataFrame] | None = None,
) -> Column:
    """One consent condition; an attribute the subject does not have matches nothing."""
    if cond.dependent:
        return correlated_exists(cond, tables or {})
    column, dtype = _column(schema, cond.column)
    value = cond.value
    if cond.user_attribute:
        value = (subject.attributes if subject else {}).get(cond.user_attribute)
        if value is None:
            return F.lit(False)
    op = cond.op.upper()
    if op not in ("EQ", "NEQ", "LT", "GT", "LTE", "GTE", "LIKE", "IN"):
        raise GovernanceError(f"operator {cond.op!r} is not allowed in a row filter")
    if op == "IN" and isinstance(value, str):
        value = json.loads(value)
    return compare(column, dtype, op, value)


def consent_predicate(
    consent: Consent,
    schema: T.StructType,
    subject: Subject | None = None,
    tables: Mapping[str, DataFrame] | None = None,
) -> Column | None:
    """AND inside a filter group, OR between the groups."""
    groups: dict[int, list[Column]] = {}
    for cond in consent.filters:
        groups.setdefault(cond.group, []).append(condition(cond, schema, subject, tables))
    return any_of([all_of(g) for g in groups.values()]) if groups else None


def combined_row_filter(
    allows: Sequence[Consent],
    denies: Sequence[Consent],
    schema: T.StructType,
    subject: Subject | None = None,
    tables: Mapping[str, DataFrame] | None = None,
) -> Column | None:
    """Allows OR-ed, minus the denies. NULL in a deny predicate drops the row (SQL logic)."""
    allow = [consent_predicate(c, schema, subject, tables) for c in allows]
    deny = [consent_predicate(c, schema, subject, tables) for c in denies]
    deny = [d for d in deny if d is not None]
    parts = []
    if allow and all(a is not None for a in allow):
        parts.append(any_of(allow))
    if deny:
        parts.append(~any_of(deny))
    return all_of(parts) if parts else None


def key_filter(df: DataFrame, keys: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose (composite) key is in ``keys``; duplicate keys do not multiply rows."""
    return df.join(keys.select(*columns), list(columns), "left_semi")


def key_join(df: DataFrame, keys: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Inner join against a key table; duplicate keys multiply rows."""
    return df.join(keys, list(columns), "inner")


def set_filter(df: DataFrame, column: str, values: Sequence[Any] | DataFrame) -> DataFrame:
    """Membership in a set from another source; an empty set matches nothing.

    A short list becomes IN, a long one or a frame a semi join, which Spark broadcasts
    only when the side is measured to be small.
    """
    if isinstance(values, DataFrame):
        key = values.columns[0]
        return df.join(
            values.select(F.col(key).alias(column)).distinct(), column, "left_semi"
        )
    dtype = df.schema[column].dataType
    if not values:
        return df.where(F.lit(False))
    if len(values) <= IN_LIST_LIMIT:
        return df.where(compare(F.col(column), dtype, "IN", values))
    # The same casts as in a short list: a value of another type matches nothing.
    texts = [(None if v is None else str(v),) for v in values]
    frame = df.sparkSession.createDataFrame(texts, T.StructType([T.StructField("_text", T.StringType())]))
    value = F.col("_text").try_cast(dtype)
    return df.join(frame.select(value.alias(column)).distinct(), column, "left_semi")


_FORBIDDEN_TEXT = re.compile(
    r";|--|/\*|\*/|\b(?:drop|alter|insert|update|delete|merge|truncate|grant|revoke|create|exec|"
    r"union|select|into|reflect|java_method|raise_error|assert_true)\b",
    re.IGNORECASE,
)


def check_predicate(text: str) -> str:
    """Refuses predicate text that is more than a predicate."""
    if not text.strip() or _FORBIDDEN_TEXT.search(re.sub(r"'(?:[^']|'')*'", "''", text)):
        raise GovernanceError("not a safe predicate")
    return text


_PLACEHOLDER = re.compile(r"'?\$\{([A-Za-z_.]+)\}'?")
_SAFE_CLAIM = re.compile(r"[A-Za-z0-9\-_.@: ]{1,256}")


def bind_template(text: str, subject: Subject) -> tuple[str, dict[str, str]]:
    """Replaces ``${...}`` by named parameters; claims never become part of the SQL text."""
    args: dict[str, str] = {}

    def claim(name: str) -> str:
        known = {"user_sid": subject.sid, "tenant": subject.tenant}
        key = name[5:] if name.startswith("attr.") else name
        value = known.get(name) or subject.attributes.get(key)
        if value is None:
            raise GovernanceError(f"claim {name!r} is missing")
        if not _SAFE_CLAIM.fullmatch(value):
            raise GovernanceError(f"claim {name!r} has characters that are not allowed")
        return value

    def marker(match: re.Match) -> str:
        name = f"claim{len(args)}"
        args[name] = claim(match.group(1))
        return f":{name}"

    bound = _PLACEHOLDER.sub(marker, text)
    check_predicate(bound)
    return bound, args


def where_template(df: DataFrame, text: str, subject: Subject) -> DataFrame:
    """Filters by a policy template with the subject's claims bound as parameters."""
    bound, args = bind_template(text, subject)
    bound = bound.replace("{", "{{").replace("}", "}}")
    return df.sparkSession.sql(f"SELECT * FROM {{source}} WHERE {bound}", args, source=df)


_TUPLE_IN = re.compile(r"\(([\w.,\s]+,[\w.,\s]+)\)\s+IN\s*\(\s*((?:\([^()]*\)\s*,?\s*)+)\)", re.IGNORECASE)


def _expanded(match: re.Match) -> str:
    """``(a, b) IN ((1, 2), ...)`` as a disjunction of equalities, whatever the types."""
    names = [n.strip() for n in match.group(1).split(",")]
    rows = re.findall(r"\(([^()]*)\)", match.group(2))
    cells = [re.findall(r"'(?:[^']|'')*'|[^,\s]+", row) for row in rows]
    if any(len(c) != len(names) for c in cells):
        raise GovernanceError("tuple of another length")
    tests = (" AND ".join(f"{n} = {v}" for n, v in zip(names, c)) for c in cells)
    return "(" + " OR ".join(f"({x})" for x in tests) + ")"


def where_text(df: DataFrame, text: str) -> DataFrame:
    """Residual filter given as text; anything that is not a plain predicate keeps no row."""
    try:
        filtered = df.where(_TUPLE_IN.sub(_expanded, check_predicate(text)))
        filtered.schema
    except Exception:  # noqa: BLE001 - every failure closes the gate
        return df.where(F.lit(False))
    return filtered


def tenant_filter(df: DataFrame, column: str, tenant: str | None) -> DataFrame:
    return df.where(F.col(column) == F.lit(tenant)) if tenant else df.where(F.lit(False))


def sample_percent(
    df: DataFrame, percent: float, seed: int | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """A sample of about ``percent`` of the rows. With ``keys`` a digest of seed and keys decides, so the same rows come
    back wherever and however often it is taken."""
    if percent <= 0:
        return df.where(F.lit(False))
    if percent >= 100:
        return df
    if not keys:
        return df.sample(fraction=percent / 100.0, seed=seed)
    text = F.concat_ws("|", F.lit(str(seed or 0)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    place = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % 1_000_000
    return df.where(place < round(percent * 10_000))

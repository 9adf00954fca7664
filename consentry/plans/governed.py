"""Governed relations: the only way a caller sees a table.

A decision is taken on the driver from a handful of consents; the result is a lazy
``filter`` + ``select`` over the registered source. Catalyst prunes and pushes through it.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from consentry.functions.masks import is_effective_hmac, mask_column
from consentry.model import CLEAR, DENY, MASK, Consent, Subject, TableMeta
from consentry.operators.consent import Decision, columns_of, resolve
from consentry.operators.joins import enrich
from consentry.operators.ordering import numbered
from consentry.plans.checked import check_leaves, read_query
from consentry.operators.predicates import (
    GovernanceError,
    check_predicate,
    equality_arguments,
    filter_tree,
)

Source = str | Callable[[SparkSession], DataFrame]

MAX_PAGE = 5000
DEFAULT_PAGE = 50
MAX_ROW_CAP = 10000

def masked_projection(
    df: DataFrame,
    meta: TableMeta,
    decision: Decision,
    columns: Sequence[str],
    master_key: bytes | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Selects catalog columns only; denied ones vanish, masked ones are masked.

    ``carry``: helper columns a later step needs and drops.
    """
    out = [F.col(c) for c in carry]
    for name in columns:
        column = meta.column(name)
        level = decision.level(column) if column else DENY
        if level == DENY:
            continue
        c = F.col(column.name)
        if level == MASK:
            c = mask_column(c, column.name, df.schema[column.name].dataType, column.rule, master_key)
        out.append(c.alias(column.name))
    return df.select(*out)


class Governor:
    """Holds sources, their metadata and consents; hands out governed frames."""

    def __init__(
        self,
        spark: SparkSession,
        consents: Sequence[Consent] = (),
        master_key: bytes | None = None,
        now: dt.datetime | None = None,
        policy: Callable[[str, Subject], tuple[bool, Mapping[str, int], Any]] | None = None,
        health: Mapping[str, str] | None = None,
        on_access: Callable[[dict], None] | None = None,
    ):
        self.spark = spark
        self.consents = list(consents)
        self.master_key = master_key
        self.now = now
        self.policy = policy
        self.health = {k.lower(): v for k, v in (health or {}).items()}
        self.on_access = on_access
        self._tables: dict[str, tuple[Source, TableMeta]] = {}
        self._lookups: dict[str, Source] = {}

    def register(self, source: Source, meta: TableMeta) -> Governor:
        self._tables[meta.name.lower()] = (source, meta)
        return self

    def lookup(self, name: str, source: Source) -> Governor:
        """A table row filters may look into, but nobody can read."""
        self._lookups[name.lower()] = source
        return self

    def meta(self, name: str) -> TableMeta:
        if name.lower() not in self._tables:
            raise GovernanceError(f"table {name!r} is not registered")
        return self._tables[name.lower()][1]

    def _load(self, name: str, session: SparkSession) -> DataFrame:
        key = name.lower()
        source = self._tables[key][0] if key in self._tables else self._lookups[key]
        return session.read.parquet(source) if isinstance(source, str) else source(session)

    def decide(
        self, name: str, subject: Subject, session: SparkSession | None = None, record: bool = True
    ) -> Decision:
        """Decision for one table; recorded before anything is read."""
        meta = self.meta(name)
        session = session or self.spark
        status = self.health.get(name.lower(), "HEALTHY").upper()
        if status == "QUARANTINED":
            raise GovernanceError(f"table {name!r} is quarantined")
        tables = _LazyTables(self, session)
        decision = resolve(
            self.consents,
            subject,
            meta.name,
            self._load(name, session).schema,
            self.now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None),
            tables,
        )
        if decision.allowed and self.policy:
            allowed, levels, row_filter = self.policy(meta.name, subject)
            if not allowed:
                decision = Decision(False, "denied by policy")
            else:
                decision = decision.restricted(levels, row_filter)
        if self.on_access and record:
            self.on_access(
                {
                    "actor_sid": subject.sid,
                    "tenant_id": subject.tenant,
                    "target_table": meta.name,
                    "decision": "ALLOW" if decision.allowed else "DENY",
                    "reason": decision.reason,
                }
            )
        return decision

    def _rows(
        self,
        name: str,
        subject: Subject,
        where: Mapping[str, Any] | None = None,
        equals: Mapping[str, Any] | None = None,
        session: SparkSession | None = None,
    ) -> tuple[DataFrame, Decision]:
        """Rows this subject may see, with every column still raw; never handed out."""
        session = session or self.spark
        decision = self.decide(name, subject, session)
        if not decision.allowed:
            raise GovernanceError(f"{subject.sid} has no access to {name!r}: {decision.reason}")
        meta = self.meta(name)
        df = self._load(name, session)
        levels = {c.name.lower(): decision.level(c) for c in meta.columns}
        tests = []
        if meta.tenant_column and meta.column(meta.tenant_column):
            if not subject.tenant:
                raise GovernanceError("a tenant is needed to read this table")
            tests.append(F.col(meta.tenant_column) == F.lit(subject.tenant))
        if decision.row_filter is not None:
            tests.append(decision.row_filter)
        if equals:
            tests += equality_arguments(equals, df.schema, levels)
        if where:
            tree = filter_tree(where, df.schema, levels)
            if tree is not None:
                tests.append(tree)
        for test in tests:
            df = df.where(test)
        return df, decision

    def table(
        self,
        name: str,
        subject: Subject,
        columns: Sequence[str] | None = None,
        where: Mapping[str, Any] | None = None,
        equals: Mapping[str, Any] | None = None,
        session: SparkSession | None = None,
    ) -> DataFrame:
        """The table as this subject may see it."""
        df, decision = self._rows(name, subject, where, equals, session)
        meta = self.meta(name)
        shown = columns_of(meta, decision, columns)
        return masked_projection(df, meta, decision, shown, self.master_key)

    def enrich(
        self,
        name: str,
        subject: Subject,
        key: str,
        other: str,
        other_key: str,
        as_name: str,
        columns: Sequence[str] | None = None,
        other_columns: Sequence[str] | None = None,
        **request: Any,
    ) -> DataFrame:
        """A table with the matching row of another one nested under ``as_name``.

        Both sides are governed on their own. Rows meet on the stored keys and are masked
        after that, so a masked key still finds its row but is never shown. A refused or
        absent other row is NULL.
        """
        df, decision = self._rows(name, subject, **request)
        meta = self.meta(name)
        shown = columns_of(meta, decision, columns)
        left = masked_projection(
            df.withColumn("_key", F.col(key)), meta, decision, shown, self.master_key, ("_key",)
        )
        try:
            found, rights = self._rows(other, subject)
        except GovernanceError:
            return enrich(left, None, "_key", other_key, as_name, keep_key=False)
        other_meta = self.meta(other)
        keyed = found.withColumn("_key", F.col(other_key))
        inner = masked_projection(
            keyed, other_meta, rights, columns_of(other_meta, rights, other_columns), self.master_key, ("_key",)
        )
        return enrich(left, inner, "_key", "_key", as_name, keep_key=False, hidden=("_key",))

    def page(
        self,
        name: str,
        subject: Subject,
        first: int | None = None,
        after: int = 0,
        **request: Any,
    ) -> DataFrame:
        """One page in primary-key order, so that pages neither overlap nor skip."""
        df = self.table(name, subject, **request)
        return page(df, self.meta(name).primary_key, first, after)

    def join(
        self,
        left: str,
        right: str,
        subject: Subject,
        on: Sequence[tuple[str, str]],
        how: str = "inner",
    ) -> DataFrame:
        """Joins two governed tables; a hidden key is refused unless it is a pseudonym."""
        pairs = []
        for name, keys in ((left, [k for k, _ in on]), (right, [k for _, k in on])):
            meta, decision = self.meta(name), self.decide(name, subject, record=False)
            for key in keys:
                column = meta.column(key)
                level = decision.level(column) if column else DENY
                pseudonym = level == MASK and is_effective_hmac(column.rule)
                if level != CLEAR and not pseudonym:
                    raise GovernanceError(f"join on hidden column {name}.{key}")
            pairs.append(self.table(name, subject))
        a, b = pairs[0].alias("a"), pairs[1].alias("b")
        tests = [F.col(f"a.{x}") == F.col(f"b.{y}") for x, y in on]
        return a.join(b, tests, how)

    def sql(
        self,
        text: str,
        subject: Subject,
        args: Mapping[str, Any] | None = None,
        tables: Mapping[str, str] | None = None,
        row_cap: int | None = None,
        truncated: str | None = None,
    ) -> DataFrame:
        """Runs a SELECT over governed views in a session that holds nothing else.

        ``tables`` maps the names used in the text to registered tables; by default
        every registered table is offered under the last part of its name. All rows come
        back unless ``row_cap`` asks for fewer; ``truncated`` then names a column that
        says on every row whether the cap cut any.
        """
        names = dict(tables or {n.split(".")[-1]: n for n in self._tables})
        session = self.spark.newSession()
        for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
            session.conf.set(key, self.spark.conf.get(key))
        # Value-bearing errors would leak hidden rows; bad casts and divisions give NULL.
        session.conf.set("spark.sql.ansi.enabled", "false")
        session.conf.set("spark.sql.debug.maxToStringFields", str(2**31 - 1))
        body = text.strip().rstrip(";")
        # Inside a subquery the grammar admits queries only.
        wrapped = f"SELECT * FROM (\n{body}\n)"
        query = read_query(session, wrapped)
        views = {n.lower(): n for n in names}
        unknown = query.relations - query.ctes - views.keys()
        if unknown:
            raise GovernanceError(f"tables {sorted(unknown)} are not registered")
        used = {views[r] for r in query.relations & views.keys()}
        if not used:
            raise GovernanceError("the statement reads no registered table")
        _check_join_columns(query.text, self._unjoinable({names[v] for v in used}, subject))
        for view in used:
            self.table(names[view], subject, session=session).createOrReplaceTempView(view)
        try:
            df = session.sql(wrapped, args=dict(args or {}))
        except AnalysisException as error:
            raise GovernanceError("the statement does not fit the governed tables") from error
        check_leaves(df, dict.fromkeys(used))
        return df if row_cap is None else capped_rows(df, row_cap, truncated)

    def _unjoinable(self, names: set[str], subject: Subject) -> set[str]:
        """Columns whose masked values mean nothing to a join; pseudonyms do not count."""
        hidden = set()
        for name in names:
            meta, decision = self.meta(name), self.decide(name, subject, record=False)
            for column in meta.columns if decision.allowed else ():
                if decision.level(column) == MASK and not is_effective_hmac(column.rule):
                    hidden.add(column.name.lower())
        return hidden


def capped_rows(df: DataFrame, row_cap: int, truncated: str | None = None) -> DataFrame:
    """At most ``row_cap`` rows, MAX_ROW_CAP at the utmost; ``truncated`` names a flag that tells if there were more."""
    cap = max(1, min(int(row_cap), MAX_ROW_CAP))
    if truncated is None:
        return df.limit(cap)
    # One row more than the cap shows whether it cut; both windows hold those few rows only.
    few = df.limit(cap + 1).select("*", F.monotonically_increasing_id().alias("_place"))
    more = F.count("*").over(Window.partitionBy()) > cap
    place = F.row_number().over(Window.orderBy("_place"))
    return few.select("*", more.alias(truncated), place.alias("_number")).where(F.col("_number") <= cap).drop("_place", "_number")


_REFERENCE = re.compile(r"'((?:\w+\.)*\w+)\b(?!\()")


def _check_join_columns(parsed: str, hidden: set[str]) -> None:
    """Refuses a join on a hidden column, named directly, by an alias, or in WHERE.

    The joined values are masked anyway, so nothing leaks; but equal masks would pair
    every row with every other.
    """
    if not hidden or "Join" not in parsed:
        return
    hidden = set(hidden)

    def uses(text: str) -> set[str]:
        return {r.split(".")[-1].lower() for r in _REFERENCE.findall(text)}

    renamed = [(uses(e), a.lower()) for e, a in re.findall(r"([^\[\],]+?) AS (\w+)", parsed)]
    while more := {a for names, a in renamed if names & hidden} - hidden:
        hidden |= more
    for line in parsed.splitlines():
        if "Join" in line:
            using = {w.lower() for group in re.findall(r"\[([^\]]*)\]", line) for w in re.findall(r"\w+", group)}
            if uses(line) & hidden or using & hidden or "NaturalJoin" in line:
                raise GovernanceError("join on a hidden column")
        elif "Filter" in line:
            for part in re.split(r"\b(?:AND|OR)\b", line.split("Filter", 1)[1]):
                names = _REFERENCE.findall(part)
                if uses(part) & hidden and (len(set(names)) > 1 or "list#" in part):
                    raise GovernanceError("join on a hidden column")


class _LazyTables(Mapping):
    """Dependent tables of correlated filters, loaded only when a filter names them."""

    def __init__(self, governor: Governor, session: SparkSession):
        self._governor, self._session = governor, session

    def __getitem__(self, name: str) -> DataFrame:
        return self._governor._load(name, self._session)

    def __iter__(self):
        return iter({**self._governor._tables, **self._governor._lookups})

    def __len__(self) -> int:
        return len({**self._governor._tables, **self._governor._lookups})


# Beyond this offset a page is found by row numbers instead of a top-k.
DEEP_OFFSET = 100_000


def page(
    df: DataFrame,
    order: Sequence[str],
    first: int | None = None,
    after: int = 0,
    max_page: int = MAX_PAGE,
) -> DataFrame:
    """Ordered page.

    A shallow page is a top-k: ``after + first`` rows leave each task. A deep one would
    carry the whole offset through one task, so rows are numbered in parallel instead;
    ``page_after`` is cheaper still where the caller knows the last key.
    """
    if after < 0:
        raise GovernanceError("offset must not be negative")
    size = max(1, min(DEFAULT_PAGE if first is None else first, max_page))
    keys = [k for k in order if k in df.columns] or df.columns[:1]
    if after > DEEP_OFFSET:
        rows = numbered(df, [], keys, "_row")
        return rows.where(F.col("_row").between(after + 1, after + size)).orderBy(*keys).drop("_row")
    return df.orderBy(*keys).offset(after).limit(size)


def page_after(df: DataFrame, order: Sequence[str], last: Sequence[Any], first: int | None = None) -> DataFrame:
    """The page that follows a known last key; the key range is pushed to the files."""
    size = max(1, min(DEFAULT_PAGE if first is None else first, MAX_PAGE))
    later = None
    for i in range(len(order)):
        test = F.col(order[i]) > F.lit(last[i])
        for j in range(i):
            test = test & (F.col(order[j]) == F.lit(last[j]))
        later = test if later is None else later | test
    return df.where((F.col(order[0]) >= F.lit(last[0])) & later).orderBy(*order).limit(size)


def odata(
    df: DataFrame, order: Sequence[str], options: Mapping[str, str]
) -> tuple[DataFrame, DataFrame | None]:
    """``$select $filter $top $skip $count`` over a governed frame: (page, count or None)."""
    def number(key: str) -> int | None:
        text = options.get(key)
        if text is None:
            return None
        if not re.fullmatch(r"\d+", text.strip()):
            raise GovernanceError(f"{key} must be a non-negative integer")
        return int(text)

    top, skip = number("$top"), number("$skip") or 0
    if options.get("$filter"):
        # Words become signs outside quoted text only.
        pieces = re.split(r"('(?:[^']|'')*')", options["$filter"])
        for word, sign in _ODATA_OPERATORS.items():
            pieces[::2] = [re.sub(rf"\b{word}\b", sign, p) for p in pieces[::2]]
        df = df.where(check_predicate("".join(pieces)))
    total = None
    if (options.get("$count") or "").lower() == "true":
        total = df.agg(F.count("*").alias("count"))
    ordered = page(df, order, top, skip)
    if options.get("$select"):
        wanted = [c.strip() for c in options["$select"].split(",")]
        unknown = [c for c in wanted if c not in df.columns]
        if unknown:
            raise GovernanceError(f"unknown columns {unknown}")
        ordered = ordered.select(*wanted)
    return ordered, total


# Comparison words of the query option.
_ODATA_OPERATORS = {"eq": "=", "ne": "<>", "gt": ">", "ge": ">=", "lt": "<", "le": "<="}

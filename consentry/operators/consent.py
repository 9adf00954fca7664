"""Consent resolution: one subject on the driver, all subjects as a Spark job."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from consentry.model import CLEAR, DENY, MASK, Consent, Subject, TableMeta
from consentry.model import Column as MetaColumn
from consentry.operators.predicates import combined_row_filter
from consentry.session import checked_broadcast, durable

# A principal that more holders than these hold is resolved for all of them at once.
SHARED_FROM = 8
# Holders whose rows one task writes out.
HOLDERS_PER_TASK = 1000
_HELD = ["holder", "table_id", "effect", "filter_key"]


@dataclass
class Decision:
    allowed: bool
    reason: str = ""
    levels: dict[str, int] = field(default_factory=dict)
    default_level: int = DENY
    row_filter: Column | None = None

    def level(self, column: MetaColumn) -> int:
        """Effective level: a sensitive column is masked unless it was released explicitly."""
        explicit = self.levels.get(column.name.lower())
        level = self.default_level if explicit is None else explicit
        if level == DENY:
            return DENY
        if column.sensitive and explicit != CLEAR:
            return MASK
        return level

    def restricted(self, levels: Mapping[str, int], row_filter: Column | None = None) -> Decision:
        """A policy can only take away: minimum per column, filters AND-ed."""
        caps = {k.lower(): v for k, v in levels.items()}
        merged = {
            name: min(self.levels.get(name, self.default_level), caps.get(name, CLEAR))
            for name in {*self.levels, *caps}
        }
        filters = [f for f in (self.row_filter, row_filter) if f is not None]
        both = filters[0] & filters[1] if len(filters) == 2 else (filters or [None])[0]
        return Decision(self.allowed, self.reason, merged, self.default_level, both)


def matches_subject(consent: Consent, subject: Subject) -> bool:
    kind = consent.grantee_type.upper()
    if kind == "GROUP":
        return consent.grantee in subject.groups
    if kind == "ROLE":
        return consent.role in subject.roles
    return consent.grantee == subject.sid


def _column_level(consent: Consent, column: str | None) -> int:
    if not consent.columns:
        return CLEAR
    rules = {k.lower(): v for k, v in consent.columns.items()}
    return rules.get(column, DENY) if column else DENY


def resolve(
    consents: Iterable[Consent],
    subject: Subject,
    table: str,
    schema: T.StructType,
    now: dt.datetime,
    tables: Mapping[str, DataFrame] | None = None,
) -> Decision:
    """Decision for one subject and one table."""
    mine = [
        c
        for c in consents
        if c.table.lower() == table.lower()
        and c.active(now)
        and (c.tenant is None or c.tenant == subject.tenant)
        and matches_subject(c, subject)
    ]
    allows = [c for c in mine if c.effect.upper() == "ALLOW"]
    denies = [c for c in mine if c.effect.upper() == "DENY"]
    if any(not c.columns and not c.filters for c in denies):
        return Decision(False, "denied for the whole table")
    if not allows:
        return Decision(False, "no active consent")

    open_consents = [c for c in allows if not c.filters]
    by_filter: dict[tuple, list[Consent]] = {}
    for c in open_consents or allows:
        by_filter.setdefault(() if open_consents else _filter_identity(c), []).append(c)

    def level(column: str | None) -> int:
        return min(max(_column_level(c, column) for c in group) for group in by_filter.values())

    levels: dict[str, int] = {}
    for name in {k.lower() for c in mine for k in c.columns}:
        denied = [v for c in denies for k, v in c.columns.items() if k.lower() == name]
        cap = DENY if DENY in denied else MASK if MASK in denied else CLEAR
        levels[name] = min(level(name), cap)
    return Decision(
        True,
        "",
        levels,
        CLEAR if level(None) == CLEAR else DENY,
        combined_row_filter(allows, denies, schema, subject, tables),
    )


def _filter_identity(consent: Consent) -> tuple:
    return tuple(sorted(repr(f).lower() for f in consent.filters))


def active_consents(consents: DataFrame, now: Column, tenant: str | None = None) -> DataFrame:
    """Not revoked and ``valid_from <= now < valid_to``."""
    live = consents.where(
        ~F.col("is_revoked") & (F.col("valid_from") <= now) & (now < F.col("valid_to"))
    )
    return live.where(F.col("tenant_id") == tenant) if tenant else live


def _principal_of(consents: DataFrame) -> DataFrame:
    """Adds (kind, principal): the one thing a consent is granted to."""
    kind = F.upper("grantee_type")
    return consents.withColumn(
        "kind", F.when(kind.isin("GROUP", "ROLE"), kind).otherwise(F.lit("SELF"))
    ).withColumn(
        "principal", F.when(kind == "ROLE", F.col("role_name")).otherwise(F.col("grantee_sid"))
    )


def subject_principals(subjects: DataFrame, groups: DataFrame, roles: DataFrame) -> DataFrame:
    """(sid, kind, principal): the subject itself, its groups and its roles."""
    own = subjects.select("sid", F.lit("SELF").alias("kind"), F.col("sid").alias("principal"))
    by_group = groups.select("sid", F.lit("GROUP").alias("kind"), F.col("group_sid").alias("principal"))
    by_role = roles.select("sid", F.lit("ROLE").alias("kind"), F.col("role_name").alias("principal"))
    return own.unionByName(by_group).unionByName(by_role).distinct()


def matched_consents(consents: DataFrame, principals: DataFrame) -> DataFrame:
    """Subject match as one equi join on (kind, principal) instead of a disjunctive condition."""
    return _principal_of(consents).join(principals, ["kind", "principal"])


def grants_per_principal(consents: DataFrame) -> DataFrame:
    """(kind, principal, consents): how many consents name each principal."""
    return _principal_of(consents).groupBy("kind", "principal").agg(F.count("*").alias("consents"))


def subject_profiles(principals: DataFrame, consents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Subjects that hold the same granted principals share one profile.

    Only principals some consent names count, so a large directory folds into few
    profiles and the matrix is computed per profile, not per subject.
    Returns (sid, profile) and (profile, kind, principal).
    """
    named = _principal_of(consents).select("kind", "principal").distinct()
    held = principals.join(named, ["kind", "principal"], "left_semi")
    per_subject = held.groupBy("sid").agg(
        F.array_sort(F.collect_set(F.struct("kind", "principal"))).alias("held")
    )
    keyed = durable(
        per_subject.select("sid", F.sha2(F.to_json("held"), 256).alias("profile"), "held"), "profiles"
    )
    parts = (
        keyed.groupBy("profile")
        .agg(F.any_value("held").alias("held"))
        .select("profile", F.explode("held").alias("h"))
        .select("profile", "h.kind", "h.principal")
    )
    return keyed.select("sid", "profile"), parts


def _folded_consents(consents: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Consents and their column rules, folded per principal: this is where most of the rows disappear."""
    known = _principal_of(consents).select(
        "consent_id", "table_id", F.upper("effect").alias("effect"), "filter_key", "kind", "principal"
    )
    rule_rows = rules.select("consent_id", F.lower("column_name").alias("column_name"), "access_level")
    with_rules = rule_rows.groupBy("consent_id").agg(F.count("*").alias("n_rules"))
    full = known.join(with_rules, "consent_id", "left").withColumn("full", F.col("n_rules").isNull())
    keys = ["kind", "principal", "table_id", "effect", "filter_key"]
    grants = full.groupBy(*keys).agg(F.bool_or("full").alias("full"))
    levels = (
        known.join(rule_rows, "consent_id")
        .groupBy(*keys, "column_name")
        .agg(F.max("access_level").alias("hi"), F.min("access_level").alias("lo"))
    )
    return durable(grants, "grants"), durable(levels, "levels")


def _fold_grants(grants: DataFrame) -> DataFrame:
    return grants.groupBy(*_HELD).agg(F.bool_or("full").alias("full"))


def _fold_levels(levels: DataFrame) -> DataFrame:
    return levels.groupBy(*_HELD, "column_name").agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"))


def _resolved(grants: DataFrame, levels: DataFrame) -> DataFrame:
    """(holder, table_id, column_name, level) of folded grants, which are read twice, and folded levels."""
    allow = F.col("effect") == "ALLOW"
    unfiltered = F.col("filter_key").isNull()
    outcome = (
        grants.groupBy("holder", "table_id")
        .agg(
            F.bool_or(allow).alias("any_allow"),
            F.bool_or(allow & unfiltered).alias("open"),
            F.bool_or(~allow & unfiltered & F.col("full")).alias("bare_deny"),
            F.bool_or(allow & unfiltered & F.col("full")).alias("open_full"),
            F.count_if(allow & ~unfiltered & ~F.col("full")).alias("partial_groups"),
        )
        .where("any_allow AND NOT bare_deny")
        .select(
            "holder",
            "table_id",
            "open",
            # Groups that release only named columns; zero means every column is released.
            F.when(F.col("open"), F.when(F.col("open_full"), 0).otherwise(1))
            .otherwise(F.col("partial_groups"))
            .alias("needed"),
        )
    )
    # Rules of a group with a rule-free consent add nothing: that group releases everything.
    per_column = levels.alias("l").join(
        grants.alias("g"), [F.col(f"l.{k}").eqNullSafe(F.col(f"g.{k}")) for k in _HELD]
    ).select(
        *[F.col(f"l.{k}").alias(k) for k in _HELD], "l.column_name", "l.hi", "l.lo", "g.full"
    )
    per_column = per_column.join(outcome, ["holder", "table_id"]).groupBy(
        "holder", "table_id", "column_name", "needed"
    )
    counted = allow & ~F.col("full") & (unfiltered == F.col("open"))
    resolved = per_column.agg(
        F.count_if(counted).alias("named"),
        F.min(F.when(counted, F.col("hi"))).alias("least"),
        F.min(F.when(~allow, F.col("lo"))).alias("deny_level"),
    ).select(
        "holder",
        "table_id",
        "column_name",
        F.when(F.col("deny_level") == DENY, F.lit(DENY))
        .otherwise(
            F.least(
                F.when(F.col("needed") == 0, F.lit(CLEAR))
                .when(F.col("named") < F.col("needed"), F.lit(DENY))
                .otherwise(F.col("least")),
                F.when(F.col("deny_level") == MASK, F.lit(MASK)).otherwise(F.lit(CLEAR)),
            )
        )
        .alias("level"),
    )
    rest = outcome.select(
        "holder",
        "table_id",
        F.lit("*").alias("column_name"),
        F.when(F.col("needed") == 0, F.lit(CLEAR)).otherwise(F.lit(DENY)).alias("level"),
    )
    return resolved.unionByName(rest)


def _shared_matrix(consents: DataFrame, rules: DataFrame, holders: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The matrix with everything said once that holders have in common.

    Principals that more than SHARED_FROM holders hold are shared; holders with the same shared ones form a class, named by
    its first holder. Returns (holder, class, own), where ``own`` lists the tables on which a principal of the holder's own
    has a consent, the levels of the classes, which hold on all other tables, and the levels of the holders on their own ones.
    """
    grants, levels = _folded_consents(consents, rules)
    sizes = holders.groupBy("kind", "principal").agg(F.count("*").alias("n"))
    marked = holders.join(sizes, ["kind", "principal"]).withColumn("shared", F.col("n") > SHARED_FROM)
    marked = durable(marked.select("holder", "kind", "principal", "shared"), "holders")
    common = F.collect_set(F.when(F.col("shared"), F.struct("kind", "principal")))
    sets = marked.groupBy("holder").agg(F.sha2(F.to_json(F.array_sort(common)), 256).alias("held"))
    named = sets.groupBy("held").agg(F.min("holder").alias("class"))
    members = durable(sets.join(named, "held").select("holder", "class"), "classes")

    firsts = members.where(F.col("holder") == F.col("class")).select("holder")
    of_class = marked.where("shared").join(firsts, "holder").drop("shared")
    own = marked.where("NOT shared").drop("shared")
    principal = ["kind", "principal"]
    class_grants = durable(_fold_grants(grants.join(of_class, principal)), "grants")
    class_levels = durable(_fold_levels(levels.join(of_class, principal)), "levels")
    own_grants = durable(_fold_grants(grants.join(own, principal)), "grants")
    own_levels = _fold_levels(levels.join(own, principal))

    # On a table of its own, a holder also has what its class has there.
    pairs = own_grants.select("holder", "table_id").distinct().join(members, "holder")
    pairs = durable(pairs.select("holder", "class", "table_id"), "pairs")
    with_class = lambda rows: pairs.join(rows.withColumnRenamed("holder", "class"), ["class", "table_id"]).drop("class")
    pair_grants = durable(_fold_grants(with_class(class_grants).unionByName(own_grants)), "grants")
    pair_levels = _fold_levels(with_class(class_levels).unionByName(own_levels))

    tables = pairs.groupBy("holder").agg(F.collect_list("table_id").alias("own"))
    members = durable(members.join(tables, "holder", "left"), "classes")
    return members, _resolved(class_grants, class_levels), _resolved(pair_grants, pair_levels)


def _to_holders(members: DataFrame, by_class: DataFrame, by_pair: DataFrame, about: DataFrame | None) -> DataFrame:
    """Rows of classes and of holders' own tables as rows of each holder, once for each of its rows in ``about`` (holder, ...).

    The rows of a class and table travel as one; they are written out where their holder is, without another shuffle.
    """
    cells = [c for c in by_class.columns if c not in ("holder", "table_id")]
    listed = F.collect_list(F.struct(*cells)).alias("cells")
    packed = by_class.groupBy(F.col("holder").alias("class"), "table_id").agg(listed)
    packed = checked_broadcast(durable(packed, "cells"))
    if about is not None:
        members = durable(members.join(about, "holder"), "classes")
        more = [c for c in about.columns if c != "holder"]
        by_pair = by_pair.groupBy("holder", "table_id").agg(listed).join(about, "holder").select("holder", "table_id", F.inline("cells"), *more)
    cores = members.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, members.count() // HOLDERS_PER_TASK)
    carried = [c for c in members.columns if c not in ("holder", "class", "own")]
    elsewhere = ~F.coalesce(F.array_contains("own", F.col("table_id")), F.lit(False))
    shared = members.repartition(parts).join(packed, "class").where(elsewhere).select("holder", "table_id", F.inline("cells"), *carried)
    return shared.unionByName(by_pair)


def access_matrix(consents: DataFrame, rules: DataFrame, holders: DataFrame, about: DataFrame | None = None) -> DataFrame:
    """Access of every holder to every table: (holder, table_id, column_name, level).

    ``consents``: active ones, with ``filter_key`` (canonical row filter, NULL for none).
    ``rules``: (consent_id, column_name, access_level).
    ``holders``: (holder, kind, principal).
    ``about``: (holder, ...), whose columns are carried along; a holder of several rows, such as the subjects of a
    profile, is written out for each of them.
    Column ``*`` carries the level of columns no consent mentions. Tables without an
    allow, or with an unconditional deny, do not appear.

    Maximum inside a filter group and minimum across groups both are associative, so
    consents are folded per principal before they meet the holders; no stage holds
    a group in memory. What holders have in common is resolved once (``_shared_matrix``).
    """
    return _to_holders(*_shared_matrix(consents, rules, holders), about)


def table_outcomes(consents: DataFrame, rules: DataFrame, holders: DataFrame) -> DataFrame:
    """(holder, table_id, outcome): hard deny, no consent, or allowed."""
    bare = (
        consents.join(rules.select("consent_id"), "consent_id", "left_anti")
        .where(F.col("filter_key").isNull() & (F.upper("effect") == "DENY"))
        .select("consent_id", F.lit(True).alias("bare"))
    )
    folded = (
        _principal_of(consents)
        .join(bare, "consent_id", "left")
        .groupBy("kind", "principal", "table_id")
        .agg(
            F.bool_or(F.upper("effect") == "ALLOW").alias("allow"),
            F.bool_or(F.coalesce("bare", F.lit(False))).alias("bare"),
        )
    )
    return (
        folded.join(holders, ["kind", "principal"])
        .groupBy("holder", "table_id")
        .agg(F.bool_or("allow").alias("allow"), F.bool_or("bare").alias("bare"))
        .select(
            "holder",
            "table_id",
            F.when(F.col("bare"), "DENIED")
            .when(~F.col("allow"), "NO_CONSENT")
            .otherwise("ALLOWED")
            .alias("outcome"),
        )
    )


def visible_catalog(consents: DataFrame, rules: DataFrame, holders: DataFrame, about: DataFrame | None = None) -> DataFrame:
    """Tables a holder sees, with the number of readable and masked named columns; ``about`` as in ``access_matrix``."""
    named = F.col("column_name") != "*"

    def counted(matrix: DataFrame) -> DataFrame:
        return matrix.groupBy("holder", "table_id").agg(
            F.count_if(named & (F.col("level") == CLEAR)).alias("clear_columns"),
            F.count_if(named & (F.col("level") == MASK)).alias("masked_columns"),
            F.max(F.when(~named, F.col("level"))).alias("other_columns"),
        )

    # A table lies as a whole either in the matrix of the class or in that of the holder.
    members, by_class, by_pair = _shared_matrix(consents, rules, holders)
    return _to_holders(members, counted(by_class), counted(by_pair), about)


def decision_lifetime(sensitive: Column, earliest_expiry: Column, now: Column) -> Column:
    """Seconds a decision may be reused: 60 s or 10 min, never past the first expiry."""
    base = F.when(sensitive, F.lit(60.0)).otherwise(F.lit(600.0))
    left = (F.unix_micros(earliest_expiry.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 1e6
    return F.when(left < base, F.greatest(left, F.lit(1.0))).otherwise(base)


def consent_violations(consents: DataFrame) -> DataFrame:
    """Rows that break the consent rules, with the reason."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    role = F.upper("grantee_type") == "ROLE"
    reason = (
        F.when(F.col("valid_to") <= F.col("valid_from"), "INTERVAL")
        .when(role & blank(F.col("role_name")) & blank(F.col("role_id")), "ROLE_MISSING")
        .when(~role & blank(F.col("grantee_sid")), "GRANTEE_MISSING")
    )
    return consents.withColumn("reason", reason).where(F.col("reason").isNotNull())


def columns_of(meta: TableMeta, decision: Decision, requested: Sequence[str] | None) -> list[str]:
    """Requested columns that are not denied; if none is left, every authorised column."""
    visible = [c.name for c in meta.columns if decision.level(c) != DENY]
    wanted = {r.lower() for r in requested or ()}
    return [v for v in visible if v.lower() in wanted] or visible

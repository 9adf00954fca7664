"""Consent resolution for whole directories."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from consentry.operators import consent as C
from consentry.operators import workflow as W
from consentry.queries.base import Frames, query

NOW = dt.datetime(2024, 1, 20)
NOW_SQL = "TIMESTAMP '2024-01-20'"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


LIVE = f"""live AS (SELECT *, upper(effect) AS eff FROM consents
    WHERE NOT is_revoked AND valid_from <= {NOW_SQL} AND {NOW_SQL} < valid_to AND tenant_id = 'tenant-1')"""
# One row per subject and consent, by the disjunctive rule as it is written down.
PAIRS = f"""{LIVE}, pairs AS (
    SELECT s.sid, l.consent_id FROM live l JOIN subjects s ON l.grantee_sid = s.sid
      WHERE l.grantee_type IN ('USER', 'SERVICE_PRINCIPAL')
    UNION SELECT g.sid, l.consent_id FROM live l JOIN subject_groups g ON l.grantee_sid = g.group_sid
      WHERE l.grantee_type = 'GROUP'
    UNION SELECT r.sid, l.consent_id FROM live l JOIN subject_roles r ON l.role_name = r.role_name
      WHERE l.grantee_type = 'ROLE')"""
RULES = """rules AS (SELECT consent_id, lower(column_name) AS column_name, max(access_level) AS access_level
    FROM consent_rules GROUP BY ALL)"""
# The rule per subject and table, step by step and without folding anything.
MATRIX = f"""{PAIRS}, {RULES},
  mine AS (SELECT p.sid, l.table_id, l.eff, l.filter_key, l.consent_id,
             NOT EXISTS (SELECT 1 FROM rules r WHERE r.consent_id = l.consent_id) AS bare
           FROM pairs p JOIN live l ON p.consent_id = l.consent_id),
  outcome AS (SELECT sid, table_id, bool_or(eff = 'ALLOW') AS any_allow,
                bool_or(eff = 'ALLOW' AND filter_key IS NULL) AS open,
                bool_or(eff = 'DENY' AND bare AND filter_key IS NULL) AS bare_deny
              FROM mine GROUP BY ALL),
  ok AS (SELECT * FROM outcome WHERE any_allow AND NOT bare_deny),
  cols AS (SELECT DISTINCT m.sid, m.table_id, r.column_name FROM mine m JOIN rules r ON m.consent_id = r.consent_id
           JOIN ok ON ok.sid = m.sid AND ok.table_id = m.table_id
           UNION ALL SELECT sid, table_id, '*' FROM ok),
  grp AS (SELECT c.sid, c.table_id, c.column_name, m.filter_key,
            max(CASE WHEN m.bare THEN 2 ELSE coalesce(r.access_level, 0) END) AS lvl
          FROM cols c JOIN ok ON ok.sid = c.sid AND ok.table_id = c.table_id
          JOIN mine m ON m.sid = c.sid AND m.table_id = c.table_id AND m.eff = 'ALLOW'
            AND (NOT ok.open OR m.filter_key IS NULL)
          LEFT JOIN rules r ON r.consent_id = m.consent_id AND r.column_name = c.column_name
          GROUP BY ALL),
  low AS (SELECT sid, table_id, column_name, min(lvl) AS lvl FROM grp GROUP BY ALL),
  deny AS (SELECT m.sid, m.table_id, r.column_name, min(r.access_level) AS cap FROM mine m
           JOIN rules r ON r.consent_id = m.consent_id WHERE m.eff = 'DENY' GROUP BY ALL),
  matrix AS (SELECT l.sid, l.table_id, l.column_name, CAST(least(l.lvl, coalesce(d.cap, 2)) AS INT) AS level
             FROM low l LEFT JOIN deny d ON d.sid = l.sid AND d.table_id = l.table_id
               AND d.column_name = l.column_name)"""

# Subjects that hold the same granted principals, named by the first of them.
MEMBERS = """held AS (
    SELECT s.sid, 'SELF ' || s.sid AS p FROM subjects s WHERE s.sid IN (SELECT grantee_sid FROM live
      WHERE grantee_type IN ('USER', 'SERVICE_PRINCIPAL'))
    UNION SELECT sid, 'GROUP ' || group_sid FROM subject_groups WHERE group_sid IN (SELECT grantee_sid FROM live WHERE grantee_type = 'GROUP')
    UNION SELECT sid, 'ROLE ' || role_name FROM subject_roles WHERE role_name IN (SELECT role_name FROM live WHERE grantee_type = 'ROLE')),
  folded AS (SELECT sid, string_agg(p, ',' ORDER BY p) AS h FROM held GROUP BY sid),
  members AS (SELECT sid, min(sid) OVER (PARTITION BY h) AS holder FROM folded)"""
PROFILES = f"{LIVE}, {MEMBERS}"


def _live(t: Frames):
    return C.active_consents(t.consents, now(), "tenant-1")


def _rules(t: Frames):
    return t.consent_rules


def _principals(t: Frames):
    return C.subject_principals(t.subjects, t.subject_groups, t.subject_roles)


def _by_profile(t: Frames):
    """(members, holders): resolved per profile, spread to the subjects at the end."""
    members, parts = C.subject_profiles(_principals(t), _live(t))
    return members, parts.withColumnRenamed("profile", "holder")


def _firsts(members):
    return members.groupBy(F.col("profile").alias("holder")).agg(F.min("sid").alias("first"))


def _represented(members, rows):
    """Names each profile by its first subject. Subjects are never multiplied by tables."""
    return rows.join(_firsts(members), "holder").drop("holder").withColumnRenamed("first", "holder")


def _subjects(members):
    return members.select(F.col("profile").alias("holder"), "sid")


def _each(rows):
    """Rows of profiles that carry the subjects of ``_subjects``, as rows of the subjects."""
    return rows.drop("holder").withColumnRenamed("sid", "holder")


@query(
    "j8_active_consents",
    f"""SELECT consent_id, table_id, effect FROM consents WHERE NOT is_revoked AND valid_from <= {NOW_SQL}
          AND {NOW_SQL} < valid_to AND tenant_id = 'tenant-1'""",
)
def active(t: Frames):
    return _live(t).select("consent_id", "table_id", "effect")


@query("j9_subject_match", f"WITH {PAIRS} SELECT consent_id, count(*) AS subjects FROM pairs GROUP BY consent_id")
def subject_match(t: Frames):
    """Holders are counted per principal, so a group everybody is in makes no pairs."""
    sizes = _principals(t).groupBy("kind", "principal").agg(F.count("*").alias("subjects"))
    return C.matched_consents(_live(t), sizes).select("consent_id", "subjects")


@query("j9_consents_per_subject", f"WITH {PAIRS} SELECT sid, count(*) AS consents FROM pairs GROUP BY sid")
def consents_per_subject(t: Frames):
    grants = C.grants_per_principal(_live(t))
    held = _principals(t).join(grants, ["kind", "principal"])
    return held.groupBy("sid").agg(F.sum("consents").alias("consents"))


@query("j9_subject_profiles", f"WITH {PROFILES} SELECT sid, holder FROM members")
def profiles(t: Frames):
    members, _ = _by_profile(t)
    first = members.groupBy("profile").agg(F.min("sid").alias("holder"))
    return members.join(first, "profile").select("sid", "holder")


@query(
    "a1_column_levels",
    f"WITH {MATRIX} SELECT sid AS holder, table_id, column_name, level FROM matrix",
)
def column_levels(t: Frames):
    """Resolved per profile, written out for every subject."""
    members, holders = _by_profile(t)
    return _each(C.access_matrix(_live(t), _rules(t), holders, _subjects(members)))


@query(
    "a2_table_outcome",
    f"""WITH {MATRIX}, {MEMBERS} SELECT sid AS holder, table_id, CASE WHEN bare_deny THEN 'DENIED'
          WHEN NOT any_allow THEN 'NO_CONSENT' ELSE 'ALLOWED' END AS outcome FROM outcome
        WHERE sid IN (SELECT holder FROM members)""",
)
def table_outcome(t: Frames):
    members, holders = _by_profile(t)
    return _represented(members, C.table_outcomes(_live(t), _rules(t), holders))


@query(
    "g1_access_matrix",
    f"""WITH {MATRIX} SELECT table_id, column_name, level, count(*) AS subjects FROM matrix GROUP BY ALL""",
)
def matrix(t: Frames):
    """Computed per profile; subjects are only counted, never paired with tables."""
    members, holders = _by_profile(t)
    sizes = members.groupBy(F.col("profile").alias("holder")).agg(F.count("*").alias("n"))
    levels = C.access_matrix(_live(t), _rules(t), holders, sizes)
    return levels.groupBy("table_id", "column_name", "level").agg(F.sum("n").alias("subjects"))


@query(
    "u8_visible_catalog",
    f"""WITH {MATRIX} SELECT sid AS holder, table_id,
          count(*) FILTER (column_name <> '*' AND level = 2) AS clear_columns,
          count(*) FILTER (column_name <> '*' AND level = 1) AS masked_columns,
          max(level) FILTER (column_name = '*') AS other_columns FROM matrix GROUP BY ALL""",
)
def visible(t: Frames):
    """Resolved per profile, written out for every subject."""
    members, holders = _by_profile(t)
    return _each(C.visible_catalog(_live(t), _rules(t), holders, _subjects(members)))


@query(
    "t10_decision_lifetime",
    f"""WITH e AS (SELECT table_id, min(valid_to) AS first FROM consents WHERE valid_to > {NOW_SQL} GROUP BY table_id),
          v AS (SELECT table_id, CASE WHEN table_id % 3 = 0 THEN 60.0 ELSE 600.0 END AS base,
                  epoch_us(first) - epoch_us({NOW_SQL}) AS us FROM e)
        SELECT table_id, CAST(CASE WHEN us / 1e6 < base THEN greatest(us / 1e6, 1.0) ELSE base END AS DOUBLE) AS seconds
        FROM v""",
)
def lifetime(t: Frames):
    first = t.consents.where(F.col("valid_to") > now()).groupBy("table_id").agg(F.min("valid_to").alias("first"))
    seconds = C.decision_lifetime(F.col("table_id") % 3 == 0, F.col("first"), now())
    return first.select("table_id", seconds.alias("seconds"))


@query(
    "g6_consent_violations",
    """SELECT consent_id, CASE WHEN valid_to <= valid_from THEN 'INTERVAL'
              WHEN grantee_type = 'ROLE' THEN 'ROLE_MISSING' ELSE 'GRANTEE_MISSING' END AS reason
       FROM consents WHERE valid_to <= valid_from OR (grantee_type = 'ROLE' AND role_name IS NULL)
          OR (grantee_type <> 'ROLE' AND grantee_sid IS NULL)""",
)
def violations(t: Frames):
    return C.consent_violations(t.consents).select("consent_id", "reason")


@query(
    "g2_expiring_consents",
    f"""SELECT consent_id, grantee_sid, greatest(1, (epoch_us(valid_to) - epoch_us({NOW_SQL})) // 3600000000) AS hours_left
        FROM consents WHERE NOT is_revoked AND valid_to > {NOW_SQL} AND valid_to <= {NOW_SQL} + INTERVAL 3 DAY
          AND consent_id NOT IN (SELECT event_id FROM events WHERE event_type = 'view')
          AND consent_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click'
                                  AND ts > {NOW_SQL} - INTERVAL 24 HOUR)""",
)
def expiring(t: Frames):
    pending = t.events.where("event_type = 'view'").select(F.col("event_id").alias("consent_id"))
    triggered = t.events.where("event_type = 'click'").select(
        F.col("event_id").alias("consent_id"), F.col("ts").alias("triggered_at")
    )
    return W.expiring(t.consents, pending, triggered, now()).select("consent_id", "grantee_sid", "hours_left")


@query(
    "g3_extension",
    f"SELECT consent_id, greatest(valid_to, {NOW_SQL}) + INTERVAL 30 DAY AS valid_to FROM consents",
)
def extension(t: Frames):
    return t.consents.select("consent_id", W.extended_expiry(F.col("valid_to"), now(), 30).alias("valid_to"))

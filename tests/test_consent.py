"""Consent resolution: the rules, and the bulk form against the single one."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from consentry.model import CLEAR, DENY, MASK, Column, Condition, Consent, Subject, TableMeta, table_key
from consentry.operators import consent as C
from consentry.plans.governed import masked_projection
from consentry.queries import QUERIES

NOW = dt.datetime(2024, 1, 1)
SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("a", "b", "c")])
ME = Subject("me", "t", frozenset({"g1", "g2"}), frozenset({"r1"}))


def decide(*consents, subject=ME):
    return C.resolve(consents, subject, "d.s.t", SCHEMA, NOW)


def allow(columns=None, filters=(), **more):
    return Consent("d.s.t", grantee="me", columns=columns or {}, filters=tuple(filters), **more)


def deny(columns=None, filters=(), **more):
    return Consent("d.s.t", "DENY", grantee="me", columns=columns or {}, filters=tuple(filters), **more)


EU, US = Condition("a", "EQ", "EU"), Condition("a", "EQ", "US")


def test_no_allow_and_bare_deny(spark):
    assert not decide().allowed
    assert not decide(allow(), deny()).allowed
    assert not decide(deny({"a": DENY})).allowed
    assert decide(allow(), deny({"a": DENY})).allowed


def test_maximum_inside_a_filter_group_minimum_across(spark):
    same = decide(allow({"b": MASK}, [EU]), allow({"b": CLEAR}, [EU]))
    assert same.levels["b"] == CLEAR
    across = decide(allow({"b": MASK}, [EU]), allow({"b": CLEAR}, [US]))
    assert across.levels["b"] == MASK
    one_sided = decide(allow({"a": CLEAR}, [EU]), allow({"b": CLEAR}, [US]))
    assert one_sided.levels == {"a": DENY, "b": DENY}


def test_unfiltered_consents_decide_alone(spark):
    d = decide(allow({"b": MASK}), allow({"b": CLEAR, "c": CLEAR}, [EU]))
    assert d.levels == {"b": MASK, "c": DENY}
    assert d.default_level == DENY and d.row_filter is None


def test_consent_without_rules_releases_everything(spark):
    assert decide(allow()).default_level == CLEAR
    assert decide(allow(), allow({"a": MASK})).levels["a"] == CLEAR
    assert decide(allow({}, [EU]), allow({"a": CLEAR}, [US])).default_level == DENY


def test_deny_rules_win_and_cap(spark):
    d = decide(allow(), deny({"A": DENY, "b": MASK}))
    assert d.levels["a"] == DENY and d.levels["b"] == MASK


def test_inactive_consents_do_not_count(spark):
    assert not decide(allow(revoked=True)).allowed
    assert not decide(allow(valid_to=NOW)).allowed
    assert decide(allow(valid_from=NOW)).allowed
    assert not decide(allow(tenant="other")).allowed


def test_subject_kinds(spark):
    group = Consent("d.s.t", grantee_type="GROUP", grantee="g1")
    role = Consent("d.s.t", grantee_type="ROLE", role="r1")
    service = Consent("d.s.t", grantee_type="SERVICE_PRINCIPAL", grantee="me")
    for c in (group, role, service):
        assert decide(c).allowed
        assert not decide(c, subject=Subject("x")).allowed


def test_sensitive_columns_need_an_explicit_release(spark):
    d = decide(allow(), allow({"b": CLEAR}))
    assert d.level(Column("a", sensitive=True)) == MASK
    assert d.level(Column("b", sensitive=True)) == CLEAR
    assert d.level(Column("a")) == CLEAR


def test_policy_only_restricts(spark):
    d = decide(allow({"a": MASK, "b": CLEAR})).restricted({"a": CLEAR, "b": DENY})
    assert d.levels == {"a": MASK, "b": DENY}


LEVEL = st.sampled_from([DENY, MASK, CLEAR])
RULES = st.dictionaries(st.sampled_from(["a", "b", "c"]), LEVEL, max_size=3)
FILTERS = st.sampled_from([(), (EU,), (US,)])
CONSENT = st.builds(
    lambda e, r, f: Consent("d.s.t", e, grantee="me", columns=r, filters=f),
    st.sampled_from(["ALLOW", "DENY"]), RULES, FILTERS,
)


@settings(max_examples=60, deadline=None)
@given(st.lists(CONSENT, max_size=5))
def test_invariants(spark, consents):
    d = decide(*consents)
    allows = [c for c in consents if c.effect == "ALLOW"]
    denies = [c for c in consents if c.effect == "DENY"]
    if not allows or any(not c.columns and not c.filters for c in denies):
        assert not d.allowed
    elif d.allowed:
        for c in denies:
            for name, level in c.columns.items():
                if level == DENY:
                    assert d.levels[name] == DENY
                if level == MASK:
                    assert d.levels[name] <= MASK


def test_matrix_equals_single_resolution(spark):
    """Random consents; one principal holds a third of them."""
    rng = random.Random(3)
    sids = [f"u{i}" for i in range(6)]
    groups = {s: frozenset(rng.sample(["g1", "g2", "hot"], 2)) for s in sids}
    consents, rows, rules = [], [], []
    for i in range(150):
        kind = rng.choice(["USER", "GROUP", "GROUP"])
        who = rng.choice(sids) if kind == "USER" else ("hot" if rng.random() < 0.5 else rng.choice(["g1", "g2"]))
        effect = "DENY" if rng.random() < 0.12 else "ALLOW"
        table = f"d.s.t{rng.randrange(9)}"
        columns = {n: rng.randrange(3) for n in rng.sample(["a", "b", "c"], rng.randrange(4))}
        cond = rng.choice([None, None, EU, US])
        if effect == "DENY" and not columns and cond is None and rng.random() < 0.8:
            columns = {"a": MASK}
        consents.append(
            Consent(table, effect, kind, who, columns=columns, filters=(cond,) if cond else ())
        )
        rows.append((i, table, effect, kind, who, None, cond.value if cond else None))
        rules += [(i, n, v) for n, v in columns.items()]
    frame = spark.createDataFrame(
        rows,
        "consent_id int, table_id string, effect string, grantee_type string, grantee_sid string, "
        "role_name string, filter_key string",
    )
    rule_frame = spark.createDataFrame(rules, "consent_id int, column_name string, access_level int")
    holders = [(s, "SELF", s) for s in sids] + [(s, "GROUP", g) for s in sids for g in groups[s]]
    holder_frame = spark.createDataFrame(holders, "holder string, kind string, principal string")
    got = {
        (r.holder, r.table_id, r.column_name): r.level
        for r in C.access_matrix(frame, rule_frame, holder_frame).collect()
    }
    want = {}
    for s in sids:
        subject = Subject(s, groups=groups[s])
        for k in range(9):
            d = C.resolve(consents, subject, f"d.s.t{k}", SCHEMA, NOW)
            if d.allowed:
                want[(s, f"d.s.t{k}", "*")] = d.default_level
                want |= {(s, f"d.s.t{k}", n): v for n, v in d.levels.items()}
    assert got == want


def test_what_holders_share_is_resolved_once(spark, monkeypatch):
    """Many holders of few groups, some with consents of their own: same levels, and no frame written with holders times tables."""
    rng = random.Random(5)
    sids = [f"u{i:03}" for i in range(120)]
    groups = {s: frozenset(["g1", "g2"] if int(s[1:]) % 3 else ["g1"]) for s in sids}
    consents, rows, rules = [], [], []
    for i in range(160):
        kind, who = ("USER", rng.choice(sids[:9])) if i % 13 == 0 else ("GROUP", rng.choice(["g1", "g2"]))
        effect = "DENY" if rng.random() < 0.15 else "ALLOW"
        table = f"d.s.t{rng.randrange(12)}"
        columns = {n: rng.randrange(3) for n in rng.sample(["a", "b", "c"], rng.randrange(4))}
        cond = rng.choice([None, EU, US])
        consents.append(Consent(table, effect, kind, who, columns=columns, filters=(cond,) if cond else ()))
        rows.append((i, table, effect, kind, who, None, cond.value if cond else None))
        rules += [(i, n, v) for n, v in columns.items()]
    frame = spark.createDataFrame(
        rows,
        "consent_id int, table_id string, effect string, grantee_type string, grantee_sid string, "
        "role_name string, filter_key string",
    )
    rule_frame = spark.createDataFrame(rules, "consent_id int, column_name string, access_level int")
    holders = [(s, "SELF", s) for s in sids] + [(s, "GROUP", g) for s in sids for g in groups[s]]
    written, durable = [], C.durable

    def counted(df, label="cut"):
        out = durable(df, label)
        written.append(out.count())
        return out

    monkeypatch.setattr(C, "durable", counted)
    about = spark.createDataFrame([(s, int(s[1:])) for s in sids], "holder string, n int")
    matrix = C.access_matrix(frame, rule_frame, spark.createDataFrame(holders, "holder string, kind string, principal string"), about)
    got = {(r.holder, r.n, r.table_id, r.column_name): r.level for r in matrix.collect()}
    # Subjects after the ninth differ by their groups alone.
    alike, want = {}, {}
    for s in sids:
        key = s if s in sids[:9] else groups[s]
        for k in range(12):
            if (key, k) not in alike:
                alike[key, k] = C.resolve(consents, Subject(s, groups=groups[s]), f"d.s.t{k}", SCHEMA, NOW)
            d = alike[key, k]
            if d.allowed:
                found = {"*": d.default_level} | d.levels
                want |= {(s, int(s[1:]), f"d.s.t{k}", n): v for n, v in found.items()}
    assert got == want
    assert max(written) < 500 < len(sids) * 12


def test_levels_are_written_for_every_subject(frames):
    """Not only for the first subject of a profile."""
    levels = QUERIES["a1_column_levels"](frames)
    per_level = levels.groupBy("table_id", "column_name", "level").count()
    assert sorted(map(tuple, per_level.collect())) == sorted(map(tuple, QUERIES["g1_access_matrix"](frames).collect()))
    profiles = QUERIES["j9_subject_profiles"](frames)
    seen, all_, first = levels.select("holder").distinct(), profiles.select("sid").count(), profiles.select("holder").distinct().count()
    assert first < seen.count() <= all_


def test_every_subject_sees_its_catalog(frames):
    rest = QUERIES["g1_access_matrix"](frames).where("column_name = '*'").groupBy("table_id").agg({"subjects": "sum"})
    seen = QUERIES["u8_visible_catalog"](frames).groupBy("table_id").count()
    assert sorted(map(tuple, seen.collect())) == sorted(map(tuple, rest.collect()))


def test_profiles_share_equal_holdings(spark):
    principals = spark.createDataFrame(
        [("u1", "GROUP", "g"), ("u2", "GROUP", "g"), ("u3", "GROUP", "g"), ("u3", "SELF", "u3"), ("u4", "GROUP", "x")],
        "sid string, kind string, principal string",
    )
    consents = spark.createDataFrame(
        [("GROUP", "g", None), ("USER", "u3", None)], "grantee_type string, grantee_sid string, role_name string"
    )
    members, parts = C.subject_profiles(principals, consents)
    by = {r.sid: r.profile for r in members.collect()}
    assert set(by) == {"u1", "u2", "u3"} and by["u1"] == by["u2"] != by["u3"]
    assert parts.count() == 3


def test_masked_projection_never_shows_raw_values(spark):
    meta = TableMeta("d.s.t", (Column("a"), Column("b", sensitive=True), Column("c")), ("a",))
    df = spark.createDataFrame([("x", "secret", "hidden")], SCHEMA)
    d = C.Decision(True, levels={"a": CLEAR, "c": DENY}, default_level=CLEAR)
    row = masked_projection(df, meta, d, ["a", "b", "c"]).first()
    assert row.asDict() == {"a": "x", "b": "REDACTED"}


def test_table_key():
    assert table_key("Dbo.Orders") == "default.dbo.orders"
    assert table_key("A.b.C") == "a.b.c"
    for bad in ("orders", "a.b.c.d", "a.b;c"):
        with pytest.raises(ValueError):
            table_key(bad)


def test_consent_violations():
    assert Consent("t", valid_from=NOW, valid_to=NOW, grantee="x").violations()
    assert Consent("t", grantee_type="ROLE").violations()
    assert Consent("t").violations()
    assert not Consent("t", grantee="x").violations()

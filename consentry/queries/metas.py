"""Catalog entries and consents the governed queries use."""

from __future__ import annotations

import datetime as dt

from consentry.model import CLEAR, DENY, MASK, Column, Condition, Consent, MaskRule, Subject, TableMeta
from consentry.plans.governed import Governor
from consentry.queries.base import Frames

NOW = dt.datetime(2024, 1, 20)
ANALYST = Subject(
    "user-1", "EUR", frozenset({"grp-analysts"}), frozenset({"auditor"}), {"region": "EUROPE", "status": "F"}
)

ORDERS = TableMeta(
    "sales.dbo.orders",
    (
        Column("o_orderkey", "bigint"),
        Column("o_custkey", "bigint"),
        Column("o_orderstatus"),
        Column("o_totalprice", "double", sensitive=True),
        Column("o_orderdate", "datetime"),
        Column("o_orderpriority", rule=MaskRule("REGEX", pattern="^[0-9]-", replacement="x-")),
    ),
    ("o_orderkey",),
)
CUSTOMER = TableMeta(
    "crm.dbo.customer",
    (
        Column("c_custkey", "bigint"),
        Column("c_name", sensitive=True, rule=MaskRule("HMAC", key_id="crm")),
        Column("c_nationkey", "int"),
        Column("c_acctbal", "double", sensitive=True),
        Column("c_mktsegment"),
    ),
    ("c_custkey",),
)
NATION = TableMeta(
    "ref.dbo.nation", (Column("n_nationkey", "int"), Column("n_name"), Column("n_regionkey", "int")), ("n_nationkey",)
)
LINEITEM = TableMeta(
    "sales.dbo.lineitem",
    (
        Column("l_orderkey", "bigint"),
        Column("l_partkey", "bigint"),
        Column("l_linenumber", "int"),
        Column("l_quantity", "double"),
        Column("l_extendedprice", "double"),
        Column("l_discount", "double", sensitive=True),
        Column("l_returnflag"),
    ),
    ("l_orderkey", "l_linenumber"),
)

CONSENTS = [
    Consent(
        ORDERS.name,
        grantee="user-1",
        filters=(
            Condition("o_orderstatus", "IN", ["F", "O"], group=0),
            Condition("o_totalprice", "GTE", 1000, group=0),
            Condition("o_orderpriority", "EQ", "1-URGENT", group=1),
        ),
        columns={
            "o_orderkey": CLEAR, "o_custkey": CLEAR, "o_orderstatus": CLEAR,
            "o_totalprice": CLEAR, "o_orderdate": CLEAR, "o_orderpriority": MASK,
        },
    ),
    Consent(
        ORDERS.name,
        effect="DENY",
        grantee_type="GROUP",
        grantee="grp-analysts",
        filters=(Condition("o_custkey", "LT", 20),),
        columns={"o_totalprice": MASK},
    ),
    Consent(CUSTOMER.name, grantee_type="GROUP", grantee="grp-analysts"),
    Consent(NATION.name, grantee_type="ROLE", role="auditor"),
    Consent(LINEITEM.name, grantee="user-1", columns={
        "l_orderkey": CLEAR, "l_partkey": CLEAR, "l_linenumber": CLEAR, "l_quantity": CLEAR,
        "l_extendedprice": CLEAR, "l_discount": DENY, "l_returnflag": CLEAR,
    }),
]

# Conditions of the same meaning for the check SQL.
ORDERS_ROWS = """((o_orderstatus IN ('F', 'O') AND o_totalprice >= 1000) OR o_orderpriority = '1-URGENT')
    AND NOT (o_custkey < 20)"""


def governor(t: Frames, consents=None, **options) -> Governor:
    options.setdefault("master_key", b"a-master-key-for-registered-queries")
    g = Governor(t.spark, CONSENTS if consents is None else consents, now=NOW, **options)
    for name, meta in (("orders", ORDERS), ("customer", CUSTOMER), ("nation", NATION), ("lineitem", LINEITEM)):
        g.register(t.path(name), meta)
    return g



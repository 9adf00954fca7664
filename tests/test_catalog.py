"""From the governance tables on disk to governed rows."""

import datetime as dt

import pytest

from consentry.model import GOVERNANCE_SCHEMAS, Subject
from consentry.operators.predicates import GovernanceError
from consentry.plans.governed import Governor
from consentry.sources.catalog import subject_consents, table_metas
from consentry.sources.tables import governance_table, write_governance_table

NOW = dt.datetime(2024, 1, 15)
OPEN = {"valid_from": dt.datetime(2024, 1, 1), "valid_to": dt.datetime(2025, 1, 1), "is_revoked": False, "tenant_id": "t1"}


def frame(spark, name, rows):
    schema = GOVERNANCE_SCHEMAS[name]
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("gov"))
    rows = {
        "tables": [
            {"id": "T1", "source_name": "Crm", "schema_name": "dbo", "table_name": "Invoices", "is_active": True},
            {"id": "T2", "source_name": "crm", "schema_name": "dbo", "table_name": "customers", "is_active": True},
            {"id": "T3", "source_name": "crm", "schema_name": "dbo", "table_name": "gone", "is_active": False},
        ],
        "table_columns": [
            {"id": f"T1-{i}", "table_id": "T1", "column_name": n, "data_type": k, "is_sensitive": n == "email"}
            for i, (n, k) in enumerate([("id", "int"), ("customer_id", "int"), ("invoice_date", "datetime"), ("email", "nvarchar")])
        ],
        "column_masking_rules": [{"id": "R", "table_column_id": "T1-3", "rule_type": "MASK_EMAIL"}],
        "consents": [
            {"id": "C1", "table_id": "T1", "effect": "Allow", "grantee_type": "Group", "grantee_sid": "g1", **OPEN},
            {"id": "C2", "table_id": "T1", "effect": "Allow", "grantee_type": "Role", "role_id": "r1", **OPEN},
            {"id": "C3", "table_id": "T1", "effect": "Allow", "grantee_type": "User", "grantee_sid": "u1", **OPEN, "is_revoked": True},
            {"id": "C4", "table_id": "T1", "effect": "Allow", "grantee_type": "User", "grantee_sid": "u1", **OPEN, "tenant_id": "t2"},
            {"id": "C5", "table_id": "T1", "effect": "Deny", "grantee_type": "User", "grantee_sid": "u1", **OPEN},
        ],
        "consent_column_rules": [{"id": "x", "consent_id": "C2", "column_name": "id", "access_level": 2}],
        "consent_row_filters": [
            {
                "id": "F1", "consent_id": "C1", "filter_group": 0, "filter_type": 1, "dependent_table": "crm.dbo.customers",
                "dependent_table_alias": "c", "foreign_key_column": "customer_id", "primary_key_column": "id",
                "subquery_predicate_json": '{"country": "DE"}', "target_temporal_column": "invoice_date",
                "dependent_valid_from_column": "valid_from", "dependent_valid_to_column": "valid_to",
            },
            {"id": "F2", "consent_id": "C5", "filter_group": 0, "filter_type": 2, "column_name": "id", "value_json": "[4, 5]"},
        ],
    }
    for name, items in rows.items():
        write_governance_table(frame(spark, name, items), root, name)
    return {name: governance_table(spark, root, name) for name in rows}


def invoices(session):
    return session.sql(
        "SELECT * FROM VALUES (1, 10, DATE'2024-01-05', 'joe@x.org'), (2, 10, DATE'2024-03-05', 'jim@x.org'), "
        "(3, 20, DATE'2024-01-05', 'ann@x.org'), (4, 10, DATE'2024-01-06', 'eve@x.org') AS v(id, customer_id, invoice_date, email)"
    )


def customers(session):
    return session.sql(
        "SELECT * FROM VALUES (10, 'DE', DATE'2024-01-01', DATE'2024-02-01'), (20, 'FR', DATE'2024-01-01', NULL) "
        "AS v(id, country, valid_from, valid_to)"
    )


ME = Subject("u1", "t1", frozenset({"g1"}))


def test_consents_of_a_subject(catalog):
    names = ["crm.dbo.invoices"]
    found = subject_consents(catalog, ME, NOW, names)
    assert [(c.effect, c.grantee_type, len(c.filters)) for c in found] == [("ALLOW", "GROUP", 1), ("DENY", "USER", 1)]
    role = subject_consents(catalog, Subject("z", "t1", roles=frozenset({"r1"})), NOW, names)
    assert role[0].role == "r1" and role[0].columns == {"id": 2}
    assert subject_consents(catalog, ME, dt.datetime(2025, 1, 1), names) == []
    assert subject_consents(catalog, Subject("z", "t1"), NOW, names) == []


def test_metadata(catalog):
    metas = table_metas(catalog, ["Crm.dbo.Invoices", "crm.dbo.gone"], {"crm.dbo.invoices": ["id"]})
    assert list(metas) == ["crm.dbo.invoices"]
    meta = metas["crm.dbo.invoices"]
    assert meta.column("email").rule.rule_type == "MASK_EMAIL" and meta.primary_key == ("id",)


def test_governed_rows_from_the_catalog(spark, catalog):
    metas = table_metas(catalog, ["crm.dbo.invoices"], {"crm.dbo.invoices": ["id"]})
    meta = metas["crm.dbo.invoices"]
    gov = Governor(spark, subject_consents(catalog, ME, NOW, [meta.name]), now=NOW)
    gov.register(invoices, meta).lookup("crm.dbo.customers", customers)
    rows = gov.table(meta.name, ME).collect()
    # Invoice 2 is outside the validity, 3 of another country, 4 denied.
    assert [(r.id, r.email) for r in rows] == [(1, "j***@***.org")]
    for name, who in ((meta.name, Subject("z", "t1")), ("crm.dbo.customers", ME)):
        with pytest.raises(GovernanceError):
            gov.table(name, who)

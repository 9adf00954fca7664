"""The data-skipping index: exact pruning, and never a lost row."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from consentry.operators.predicates import GovernanceError, filter_tree
from consentry.sources import skipping as S
from consentry.sources.tables import scan_report


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Twelve files; each holds its own range of n, days and names; two have nulls alone, one NaN, one no row."""
    path = str(tmp_path_factory.mktemp("skip") / "t")
    r = random.Random(1)
    schema = "n long, real double, day date, name string, at timestamp_ntz, file int, wide array<int>"
    for k in range(12):
        rows = []
        for i in range(20):
            n = k * 10 + i % 10
            real = float("nan") if k == 3 and i == 5 else n / 2
            at = datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=n)
            rows.append((None if k in (5, 6) or r.random() < 0.1 else n, real, at.date(), f"{chr(97 + k)}{i}", at, k, [n]))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([], schema).coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.fixture(scope="module")
def whole_index(spark, table):
    return S.build_file_index(spark, table)


FILTERS = [
    {"n": {"eq": 35}}, {"n": {"gt": 95}}, {"n": {"gte": 20, "lt": 30}}, {"n": {"in": [1, 118, 500]}}, {"n": None}, {"n": {"neq": None}},
    {"n": {"neq": 3}}, {"real": {"gt": 1000.0}}, {"real": {"lt": 2.0}}, {"real": {"eq": 17.5}}, {"day": {"gte": "2024-01-04"}},
    {"name": {"startsWith": "c1"}}, {"name": {"contains": "z"}}, {"name": {"gt": "k"}}, {"at": {"lt": "2024-01-01 05:00:00"}},
    {"or": [{"n": 3}, {"n": {"gte": 110}, "name": "l7"}]}, {"and": [{"n": {"lt": 50}}, {"or": [{"n": 7}, {"file": 9}]}]}, {},
    {"n": {"in": []}}, {"name": {"in": ["a1", "zz"]}},
]


@pytest.mark.parametrize("where", FILTERS, ids=str)
def test_no_row_is_lost_and_files_are_pruned_exactly(spark, table, whole_index, where):
    index = whole_index
    whole = spark.read.parquet(table)
    kept = filter_tree(where, whole.schema)
    want = whole if kept is None else whole.where(kept)
    got = S.indexed_scan(index, where)
    key = lambda x: sorted(map(repr, x.collect()))
    assert key(got) == key(want)
    report = S.pruning_report(index, where).first()
    assert report.files_total == 13 and report.rows_total == 240
    held = {r.f for r in want.select(F.col("_metadata.file_path").alias("f")).distinct().collect()}
    assert report.files_scanned >= len(held)
    if report.files_scanned and report.files_scanned < 13:
        assert scan_report(whole, got).first().files_scanned == report.files_scanned


def test_files_opened(spark, table):
    index = S.build_file_index(spark, table, ["n", "real", "name"])
    opened = lambda where: S.pruning_report(index, where).first().files_scanned
    assert opened({"n": {"eq": 35}}) == 1 and opened({"n": {"gte": 20, "lt": 40}}) == 2
    assert opened({"n": {"gt": 10_000}}) == 0 and opened({"name": {"startsWith": "c1"}}) == 1
    assert opened({"n": {"neq": None}}) == 10  # files of nulls alone, and the empty one
    assert opened({"real": {"gt": 1e9}}) == 12  # NaN may be anywhere
    assert opened({"real": {"lt": 5.0}}) == 2  # the file with NaN has no bounds
    assert opened({"day": {"eq": "1999-01-01"}}) == 12  # not indexed
    assert S.indexed_scan(index, {"n": {"gt": 10_000}}).count() == 0


def test_refresh_reads_new_footers_alone(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(10).coalesce(1).write.parquet(path)
    index = S.build_file_index(spark, path)
    read = []
    plain = S._read_footers
    monkeypatch.setattr(S, "_read_footers", lambda spark, files, fields: read.append(files.count()) or plain(spark, files, fields))
    spark.range(100, 110).coalesce(1).write.mode("append").parquet(path)
    again = S.refresh_file_index(index)
    assert read == [1] and again.files.count() == 2
    assert S.pruning_report(again, {"id": {"gte": 100}}).first().files_scanned == 1
    assert S.indexed_scan(again, {"id": {"gte": 100}}).count() == 10


def test_unknown_columns_are_refused(spark, table):
    index = S.build_file_index(spark, table, ["n"])
    with pytest.raises(GovernanceError):
        S.indexed_scan(index, {"nope": 1})
    with pytest.raises(GovernanceError):
        S.build_file_index(spark, table, ["wide"])


def test_random_filters(spark, table, whole_index):
    index = whole_index
    whole = spark.read.parquet(table).persist()
    r = random.Random(7)
    for _ in range(12):
        terms = [{"n": {r.choice(["gt", "gte", "lt", "lte", "eq"]): r.randrange(-5, 125)}} for _ in range(3)]
        where = {r.choice(["and", "or"]): [terms[0], {r.choice(["and", "or"]): terms[1:]}]}
        assert S.indexed_scan(index, where).count() == whole.where(filter_tree(where, whole.schema)).count(), where
    assert list(itertools.islice(index.columns, 2)) == ["n", "real"]

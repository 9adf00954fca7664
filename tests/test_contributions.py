"""How much one client moves private sums, and that the noise belongs to the key and the release."""

import statistics

from consentry.operators.privacy import contributions, private_client_sums

KEY = b"key"


def _rows(spark):
    hot = [("hot", g, 1000.0) for g in range(1000) for _ in range(2)]
    others = [(f"c{i}", i % 5, float(i % 7)) for i in range(100)]
    return spark.createDataFrame([*hot, *others, (None, 1, 5.0), ("c1", 3, None)], "client string, grp int, amount double")


def test_a_client_in_many_groups(spark):
    rows = _rows(spark)
    kept = contributions(rows, ["grp"], "client", "amount", KEY, 3, 10.0).collect()
    hot = [r for r in kept if r.client == "hot"]
    assert len(hot) == 3 and all(r.amount == 10.0 for r in hot)
    assert not [r for r in kept if r.client is None]
    assert len([r for r in kept if r.client == "c1"]) == 2
    # The choice belongs to the key.
    other = contributions(rows, ["grp"], "client", "amount", b"other", 3, 10.0).where("client = 'hot'").collect()
    assert {r.grp for r in other} != {r.grp for r in hot}
    # Without the client, three sums at most are others, each by no more than the bound.
    sums = lambda df: {r.grp: r.value for r in private_client_sums(
        df, ["grp"], "client", "amount", 1.0, 10.0, KEY, "r", most=3, min_cohort=0).collect()}
    every, without = sums(rows), sums(rows.where("client <> 'hot' OR client IS NULL"))
    moved = {g for g in without if abs(every[g] - without[g]) > 1e-3}
    assert len(moved) <= 3 and all(abs(every[g] - without[g]) <= 10.001 for g in moved)


def test_noise(spark):
    rows = spark.range(3000).selectExpr("id AS client", "id AS grp", "0.0 AS amount")
    ask = lambda release, key=KEY: [r.value for r in private_client_sums(
        rows, ["grp"], "client", "amount", 0.5, 10.0, key, release, min_cohort=1).orderBy("grp").collect()]
    first = ask("a")
    assert first == ask("a") and first != ask("b") and first != ask("a", b"other")
    # Laplace of scale 20: the mean size is the scale, the middle is nothing.
    assert 18 < statistics.mean(abs(x) for x in first) < 22 and abs(statistics.median(first)) < 2


def test_empty(spark):
    none = _rows(spark).limit(0)
    assert private_client_sums(none, ["grp"], "client", "amount", 1.0, 1.0, KEY, "r").count() == 0

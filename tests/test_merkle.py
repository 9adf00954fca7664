"""Hash trees against a plain fold, proofs of every entry, forged entries and roots."""

import hashlib

import pytest
from pyspark.sql import functions as F

from consentry.operators.merkle import hash_tree, verify_proofs


def sha(*parts):
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


def plain_root(name, hashes):
    level = [sha("0", name, str(i + 1), h) for i, h in enumerate(hashes)]
    while len(level) > 1:
        level = [sha("1", *level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


SIZES = {"a": 1, "b": 2, "c": 7, "d": 64, "e": 301, "": 65}


@pytest.mark.parametrize("depth", [1, 3, 12])
def test_roots_and_proofs(spark, depth):
    logs = {n: [sha(n, str(i)) for i in range(k)] for n, k in SIZES.items()}
    rows = [(n or None, i + 1, h) for n, hs in logs.items() for i, h in enumerate(hs)]
    log = spark.createDataFrame(rows, "tenant_id string, seq long, entry_hash string").repartition(3)
    if depth == 1:
        log = log.where("tenant_id <> 'e'")
    tree = hash_tree(log, depth=depth)
    roots = {r.tenant_id or "": (r.root, r.entries) for r in tree.roots().collect()}
    assert roots == {n: (plain_root(n, hs), len(hs)) for n, hs in logs.items() if depth > 1 or n not in ("e", "")}
    if depth == 1:
        return
    proofs = tree.proofs()
    signed = tree.roots(b"key")
    checked = verify_proofs(proofs, signed, key=b"key").collect()
    assert len(checked) == sum(SIZES.values()) and all(r.valid for r in checked)
    assert max(len(r.path) for r in proofs.collect()) == 9  # 301 entries
    # Another entry, another place, another root, or a root signed by someone else proves nothing.
    assert verify_proofs(proofs.withColumn("seq", F.col("seq") + 1), signed).where("valid").count() == 0
    assert verify_proofs(proofs.withColumn("entry_hash", F.reverse("entry_hash")), signed).where("valid").count() == 0
    assert verify_proofs(proofs, signed.withColumn("entries", F.col("entries") + 1), key=b"key").where("valid").count() == 0
    assert verify_proofs(proofs, signed, key=b"other").where("valid").count() == 0
    assert verify_proofs(proofs, signed.limit(0)).where("valid").count() == 0


def test_lost_and_empty(spark):
    log = spark.createDataFrame([("a", i, str(i)) for i in range(1, 30)], "tenant_id string, seq long, entry_hash string")
    whole = hash_tree(log, depth=3).roots().first().root
    assert hash_tree(log.where("seq <> 12"), depth=3).roots().first().root != whole
    assert hash_tree(log.unionByName(log.where("seq = 12")), depth=3).roots().first().root != whole
    assert hash_tree(log.limit(0)).roots().count() == 0

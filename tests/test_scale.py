"""Hot keys: one key with a third of the rows and more, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from consentry.operators import abac, lineage, privacy, relevance
from consentry.operators import audit as A
from consentry.operators import joins as J
from consentry.operators.limits import first_request_windows
from consentry.operators.ordering import GROUP_LIMIT, latest_per_key, numbered
from consentry.sources.tables import stream_files

HOT = 0.5


def skewed(n, keys=7, seed=1):
    rng = random.Random(seed)
    return [("hot" if rng.random() < HOT else f"k{rng.randrange(keys)}", i, rng.randrange(50)) for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    return skewed(3000)


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, id long, v int").repartition(6)


def test_numbered(df, rows):
    want, n = {}, {}
    for k, i, v in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        n[k] = n.get(k, 0) + 1
        want[i] = n[k]
    assert {r.id: r.seq for r in numbered(df, ["k"], ["v", "id"]).collect()} == want


def test_numbered_overall(df, rows):
    got = {r.id: r.seq for r in numbered(df, [], ["v", "id"]).collect()}
    order = sorted(rows, key=lambda r: (r[2], r[1]))
    assert got == {r[1]: i + 1 for i, r in enumerate(order)}


@pytest.mark.parametrize("n", [3, GROUP_LIMIT + 200])
def test_latest_per_key(df, rows, n):
    by = {}
    for k, i, v in rows:
        by.setdefault(k, []).append((-v, i))
    want = {i for items in by.values() for _, i in sorted(items)[:n]}
    got = latest_per_key(df, ["k"], [F.desc("v"), F.asc("id")], n)
    assert {r.id for r in got.collect()} == want


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_latest_per_key_cuts_before_the_shuffle(df):
    text = plan(latest_per_key(df, ["k"], [F.desc("v")], 50))
    assert text.count("WindowGroupLimit") == 2
    big = plan(latest_per_key(df, ["k"], [F.desc("v")], GROUP_LIMIT + 1))
    assert "_split" in big


def test_child_lists_bound_every_list(spark, df, rows):
    keys = spark.createDataFrame([("hot",), ("k1",), ("none",)], "k string")
    parts = J.child_lists(keys, df.withColumnRenamed("k", "parent"), "k", "parent", F.col("id"), ["id"], list_rows=100)
    got = {}
    for r in parts.collect():
        assert len(r["items"]) < 200
        got.setdefault(r.k, []).extend(x.id for x in r["items"])
    assert set(got) == {"hot", "k1", "none"} and got["none"] == []
    for key in ("hot", "k1"):
        assert sorted(got[key]) == sorted(i for k, i, _ in rows if k == key)


def test_nest_bounds_every_parent(spark, df):
    parents = df.select("k").distinct()
    child = J.Nest("items", df.withColumnRenamed("k", "k2"), ["id"], "k", "k2", ["id"], 10)
    nested = J.nest(J.Nest("p", parents, ["k"], children=[child]))
    assert all(len(r["items"]) == 10 for r in nested.collect())


def test_enrich_does_not_multiply(spark, df, rows):
    right = spark.createDataFrame([("HOT", 1), ("hot", 2), ("k1", 3)], "rk string, x int")
    out = J.enrich(df, right, "k", "rk", "r").collect()
    assert len(out) == len(rows)
    assert all((r.r.x == 2) if r.k == "hot" else (r.r is None) == (r.k != "k1") for r in out)


def brute_ledger(requests, budget=10.0):
    spent, taken = {}, set()
    for client, at, eps, rid in sorted(requests, key=lambda r: (r[1], r[3])):
        key = (client, at[:10])
        if round(spent.get(key, 0) + eps, 6) <= budget:
            spent[key] = round(spent.get(key, 0) + eps, 6)
            taken.add(rid)
    return taken


@pytest.mark.parametrize("amounts", [[0.1, 0.25, 3.0, 7.5], [0.004, 9.0, 0.5], [11.0, 10.0, 0.3]])
def test_ledger_equals_serial_run(spark, amounts):
    rng = random.Random(len(amounts))
    requests = []
    for i in range(2500):
        client = "hot" if rng.random() < HOT else f"c{rng.randrange(5)}"
        at = f"2024-01-0{rng.randrange(1, 3)} {rng.randrange(24):02}:{rng.randrange(60):02}:00"
        requests.append((client, at, rng.choice(amounts), i))
    frame = spark.createDataFrame(requests, "client string, at string, epsilon double, id int")
    frame = frame.withColumn("at", F.col("at").cast("timestamp_ntz"))
    got = privacy.privacy_ledger(frame).where("accepted").collect()
    assert {r.id for r in got} == brute_ledger(requests)
    assert privacy.privacy_ledger(frame).count() == len(requests)


def brute_windows(rows, size):
    out, start = {}, {}
    for client, at in sorted(rows):
        if client not in start or at >= start[client] + size:
            start[client] = at
        key = (client, start[client])
        out[key] = out.get(key, 0) + 1
    return out


@pytest.mark.parametrize(("size", "spread"), [(60, 5000), (60, 400), (7, 90000), (3000, 900), (5, 40)])
def test_first_request_windows(spark, size, spread):
    """One client spans many partitions, some smaller than a window."""
    rng = random.Random(size)
    rows = [("hot" if rng.random() < 0.7 else f"c{rng.randrange(3)}", rng.randrange(spread)) for _ in range(1500)]
    frame = spark.createDataFrame(rows, "client string, s long").withColumn("at", F.timestamp_seconds("s"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        out = first_request_windows(frame, "client", "at", size)
        out = out.select("client", F.unix_seconds("window_start").alias("s"), "requests").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = {(r.client, r.s): r.requests for r in out}
    assert got == brute_windows(rows, size)


def closure(edges, root):
    seen, frontier, d, out = {root}, [root], 0, {}
    while frontier:
        d += 1
        nxt = sorted({b for a in frontier for x, b in edges if x == a and b not in seen})
        for b in nxt:
            out[b] = d
        seen |= set(nxt)
        frontier = nxt
    return out


def test_downstream_with_a_hub(spark):
    rng = random.Random(5)
    edges = {("hub" if rng.random() < 0.3 else f"n{rng.randrange(40)}",
              "hub" if rng.random() < 0.3 else f"n{rng.randrange(40)}") for _ in range(90)}
    frame = spark.createDataFrame(sorted(edges), "src string, dst string")
    roots = ["hub", "n1", "n2"]
    got = lineage.downstream(frame, spark.createDataFrame([(r,) for r in roots], "node string")).collect()
    for root in roots:
        assert {r.node: r.distance for r in got if r.root == root} == closure(edges, root)


@pytest.mark.parametrize("nodes", (4, 4096))
def test_what_lies_behind_shared_nodes_is_not_written_per_root(spark, monkeypatch, nodes):
    rng = random.Random(nodes)
    monkeypatch.setattr(lineage, "MANY_ROOTS", 10, raising=False)
    monkeypatch.setattr(lineage, "PACKED_NODES", nodes, raising=False)
    edges = {(f"o{i}", f"m{rng.randrange(6)}") for i in range(60) for _ in range(2)}
    edges |= {(f"m{rng.randrange(6)}", f"n{rng.randrange(30)}") for _ in range(20)}
    edges |= {(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(50)}
    edges |= {("n3", "o5"), ("m1", "n3"), ("m2", "m1"), ("o7", "o7"), ("o9", "o5")}
    frame = spark.createDataFrame(sorted(edges), "src string, dst string")
    roots = [f"o{i}" for i in range(61)]
    written, plain = [], lineage.durable
    monkeypatch.setattr(lineage, "durable", lambda df, label="": written.append((label, plain(df, label))) or written[-1][1])
    got = lineage.downstream(frame, spark.createDataFrame([(r,) for r in roots], "node string")).collect()
    straight = {e for e in edges if e[0] != e[1]}
    for root in roots:
        mine = {r.node: r for r in got if r.root == root}
        want = closure(straight, root)
        want.pop(root, None)
        assert {n: r.distance for n, r in mine.items()} == want and len(mine) == sum(r.root == root for r in got)
        far = {**want, root: 0}
        for r in mine.values():
            assert r.upstream == min(a for a, b in straight if b == r.node and far.get(a) == r.distance - 1)
    assert sum(df.count() for label, df in written if label == "closure") < len(got) / 2


@pytest.mark.parametrize("light", (0, 16))
def test_next_nodes_are_no_ways_of_their_own(spark, monkeypatch, light):
    """The table of ways does not grow with the next nodes, and many shared nodes are still merged, as arrays or as rows."""
    rng = random.Random(light)
    monkeypatch.setattr(lineage, "MANY_ROOTS", 10)
    monkeypatch.setattr(lineage, "LIGHT", light, raising=False)
    edges = {(f"o{i}", f"m{rng.randrange(9)}") for i in range(80) for _ in range(3)}
    edges |= {(f"m{i}", f"s{j}") for i in range(9) for j in range(40) if rng.random() < 0.6}
    edges |= {(f"s{j}", f"n{j % 3}") for j in range(40)} | {("n0", "k"), ("n1", "k"), ("k", "n2"), ("n2", "m1"), ("m3", "m4")}
    rows = {}
    plain = lineage.durable
    monkeypatch.setattr(lineage, "durable", lambda df, label="": rows.setdefault(label, []).append(plain(df, label)) or rows[label][-1])
    roots = [f"o{i}" for i in range(80)]
    frame = spark.createDataFrame(sorted(edges), "src string, dst string")
    got = lineage.downstream(frame, spark.createDataFrame([(r,) for r in roots], "node string")).collect()
    for root in roots:
        mine, want = {r.node: r for r in got if r.root == root}, closure(edges, root)
        want.pop(root, None)
        assert {n: r.distance for n, r in mine.items()} == want and len(mine) == sum(r.root == root for r in got)
        far = {**want, root: 0}
        for r in mine.values():
            assert r.upstream == min(a for a, b in edges if b == r.node and far.get(a) == r.distance - 1)
    assert not [r for way in rows["way"] for r in way.collect() if r.distance == 1]


def test_ways_are_not_moved_where_only_nodes_are_read(spark, monkeypatch):
    monkeypatch.setattr(lineage, "MANY_ROOTS", 10)
    edges = spark.createDataFrame([*((f"o{i}", f"m{i % 3}") for i in range(30)), ("m0", "n"), ("m1", "n"), ("n", "k")], "src string, dst string")
    got = lineage.downstream(edges, edges.where("src LIKE 'o%'").select(F.col("src").alias("node")))
    kept = got.groupBy("root").agg(F.count("node").alias("n"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\b(ways|codes)#", plan) and re.search(r"\bnumbers#", plan)
    assert {r.root: r.n for r in kept.collect()} == {f"o{i}": 1 if i % 3 == 2 else 3 for i in range(30)}


def test_deep_chains_are_followed_to_the_end(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(20)]
    frame, root = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("n0",)], "node string")
    assert {r.node: r.distance for r in lineage.downstream(frame, root).collect()} == {f"n{i}": i for i in range(1, 21)}
    far = lineage.revocation_impact(spark.createDataFrame([*edges, ("n20", "n4")], "src string, dst string"), root).collect()
    assert len(far) == 20 and [r.node for r in far if r.cyclic] == ["n4"]


@pytest.mark.parametrize("seed", range(2))
def test_chains_between_joints(spark, seed):
    """Long chains between few joints, rings, and roots inside of chains."""
    rng = random.Random(seed)
    edges, names = set(), iter(range(10**6))
    for _ in range(9):
        a, b = (f"j{rng.randrange(5)}" for _ in range(2))
        way = [a, *(f"c{next(names)}" for _ in range(rng.randrange(12))), b]
        edges |= set(zip(way, way[1:], strict=False))
    ring = [f"ring{i}" for i in range(9)]
    edges |= set(zip(ring, [*ring[1:], ring[0]], strict=True)) | {("in", "x1"), ("x1", "x2")}
    frame = spark.createDataFrame(sorted(edges), "src string, dst string")
    inner = sorted(a for a, _ in edges if a.startswith("c"))
    roots = ["j0", "ring3", "in", "absent", *rng.sample(inner, min(3, len(inner)))]
    got = lineage.downstream(frame, spark.createDataFrame([(r,) for r in roots], "node string")).collect()
    straight = {e for e in edges if e[0] != e[1]}
    for root in roots:
        want = closure(straight, root)
        want.pop(root, None)
        assert {r.node: r.distance for r in got if r.root == root} == want, root
        far = {**want, root: 0}
        for r in got:
            if r.root == root:
                assert r.upstream == min(a for a, b in straight if b == r.node and far.get(a) == r.distance - 1)


def test_ten_thousand_nodes_in_few_rounds(spark, monkeypatch):
    edges = spark.range(10_000).selectExpr("concat('n', id) AS src", "concat('n', id + 1) AS dst")
    root = spark.createDataFrame([("n0",)], "node string")
    rounds = []
    plain = lineage.durable
    monkeypatch.setattr(lineage, "durable", lambda df, label="": rounds.append(label) or plain(df, label))
    got = lineage.downstream(edges, root)
    ends = got.agg(F.count("*"), F.max("distance"), F.sum(F.when(F.col("node") == F.concat(F.lit("n"), "distance"), 1))).first()
    assert tuple(ends) == (10_000, 10_000, 10_000)
    assert sum(r in ("closure", "jumps") for r in rounds) <= 20


def plain_impact(edges, root):
    """Breadth first with whole paths; nodes of a round are entered from the smallest source."""
    found, paths, cyclic, frontier, far = {root: 0}, {root: [root]}, set(), [root], 0
    while frontier:
        far, new = far + 1, {}
        for a in sorted(frontier):
            for b in sorted(b for x, b in edges if x == a):
                if b in paths[a]:
                    cyclic.add(b)
                elif b not in found:
                    new.setdefault(b, a)
        for b, a in new.items():
            found[b], paths[b] = far, [*paths[a], b]
        frontier = list(new)
    return {n: (d, n in cyclic) for n, d in found.items() if d or n in cyclic}


@pytest.mark.parametrize("seed", range(2))
def test_cycles_of_any_length(spark, seed):
    rng = random.Random(seed)
    edges = {(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(18)}
    edges |= {(f"m{i}", f"m{i + 1}") for i in range(11)} | {("m11", f"m{rng.randrange(9)}"), ("n1", "m2"), ("m5", "m1")}
    for root in ("n1", "m0"):
        assert impact(spark, sorted(edges), root) == plain_impact(edges, root)


def impact(spark, edges, root):
    frame = spark.createDataFrame(edges, "src string, dst string")
    out = lineage.revocation_impact(frame, spark.createDataFrame([(root,)], "node string")).collect()
    return {r.node: (r.distance, r.cyclic) for r in out}


def test_cycles_of_a_root_are_tested_without_joins(spark, monkeypatch):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "b"), ("c", "d"), ("b", "d"), ("d", "e"), ("e", "d"), ("a", "e"), ("e", "b")]
    labels, plain = [], lineage.durable
    monkeypatch.setattr(lineage, "durable", lambda df, label="": labels.append(label) or plain(df, label))
    assert impact(spark, edges, "a") == plain_impact(edges, "a") and "climb" not in labels
    monkeypatch.setattr(lineage, "TESTED", 0)
    assert impact(spark, edges, "a") == plain_impact(edges, "a") and "climb" in labels


@pytest.mark.parametrize("seed", range(3))
def test_what_lies_behind_hubs_of_cycles_is_found_once(spark, monkeypatch, seed):
    """Many roots that reach few hubs: each node behind these is found per hub, not merged per root, with the same rows."""
    rng = random.Random(seed)
    monkeypatch.setattr(lineage, "MANY_ROOTS", 10)
    monkeypatch.setattr(lineage, "HUB_EDGES", 6, raising=False)
    edges = {(f"o{i}", f"p{rng.randrange(12)}") for i in range(60) for _ in range(3)}
    edges |= {(f"p{i}", f"s{rng.randrange(40)}") for i in range(12) for _ in range(5)}
    edges |= {(f"s{i}", f"n{i % 5}") for i in range(40)} | {(f"n{i}", f"r{i % 2}") for i in range(5)}
    edges |= {(f"r{i % 2}", f"s{i}") for i in range(seed, 40, 2)} | {("r0", "n1"), ("p3", "r1"), ("o4", "r0"), ("o5", "n3"), ("s7", "s7"), ("s9", "end")}
    # Roots on cycles, roots that are only entered, or lead nowhere.
    edges |= {("s3", "o8"), ("r1", "o9"), ("o9", "o10"), ("o7", "o7"), ("n2", "last"), ("o61", "o61"), ("r0", "p5")}
    labels, plain = [], lineage.durable
    monkeypatch.setattr(lineage, "durable", lambda df, label="": labels.append(label) or plain(df, label))
    frame, roots = spark.createDataFrame(sorted(edges), "src string, dst string"), [f"o{i}" for i in range(62)] + ["last"]
    got = {}
    for r in lineage.revocation_impact(frame, spark.createDataFrame([(r,) for r in roots], "node string")).collect():
        assert r.node not in got.setdefault(r.root, {})
        got[r.root][r.node] = (r.distance, r.cyclic)
    for root in roots:
        assert got.get(root, {}) == plain_impact(edges, root), root
    assert "beyond" in labels and "impact" not in labels


def test_cycles_and_diamonds(spark):
    assert impact(spark, [("a", "b"), ("b", "c"), ("c", "a")], "a") == {
        "b": (1, False), "c": (2, False), "a": (0, True)
    }
    diamond = [("s", "a"), ("s", "b"), ("a", "d"), ("b", "d")]
    assert impact(spark, diamond, "s") == {"a": (1, False), "b": (1, False), "d": (2, False)}
    assert impact(spark, [("a", "a"), ("a", "b")], "a") == {"a": (0, True), "b": (1, False)}
    assert impact(spark, [("x", "y")], "a") == {}


def test_chain_append_verify_and_report(spark):
    rng = random.Random(2)
    rows = [
        (i, f"2024-01-01 00:{rng.randrange(60):02}:00", "read", "u|1", "t\\x", None, "ALLOW", "tr", "{}",
         "hot" if rng.random() < HOT else "cold")
        for i in range(500)
    ]
    log = spark.createDataFrame(
        rows,
        "id long, occurred_at string, event_type string, actor_sid string, target_table string, "
        "target_column string, decision string, trace_id string, details_json string, tenant_id string",
    ).withColumn("occurred_at", F.col("occurred_at").cast("timestamp_ntz"))
    key = b"key"
    chained = A.append_chain(log, key, segment_rows=32).cache()
    assert A.verify_chain(chained, key, segment_rows=32).count() == 0
    links = {(r.tenant_id, r.seq): r for r in chained.collect()}
    for (tenant, seq), r in links.items():
        if (seq - 1) % 32:
            assert r.prev_hash == links[(tenant, seq - 1)].entry_hash
    wrong = A.verify_chain(chained, b"other", segment_rows=32)
    assert wrong.count() == len(rows)
    # Rewriting an entry with a valid hash of its own breaks the link behind it.
    swapped = chained.withColumn(
        "entry_hash", F.when((F.col("tenant_id") == "hot") & (F.col("seq") == 5), "0").otherwise(F.col("entry_hash"))
    )
    found = {(r.tenant_id, r.seq, r.problem) for r in A.verify_chain(swapped, key, segment_rows=32).collect()}
    assert found == {("hot", 5, "TAMPERED"), ("hot", 6, "BROKEN_LINK")}
    heads = A.segment_heads(chained)
    assert heads.agg(F.sum("entries")).first()[0] == len(rows)
    chained.unpersist()


def test_chain_goes_on_over_batches(spark, tmp_path):
    """Three batches of a stream give one unbroken chain."""
    source, n = str(tmp_path / "in"), 0
    for size in (50, 7, 40):
        rows = [(n + i, f"2024-01-01 00:00:{(n + i) % 60:02}", "hot" if i % 3 else f"t{n}") for i in range(size)]
        n += size
        df = spark.createDataFrame(rows, "id long, at string, tenant_id string")
        df = df.withColumn("occurred_at", F.col("at").cast("timestamp_ntz")).drop("at")
        for c in ("event_type", "actor_sid", "target_table", "target_column", "decision", "trace_id", "details_json"):
            df = df.withColumn(c, F.lit("x"))
        df.coalesce(1).write.mode("append").parquet(source)
    root = str(tmp_path / "log")
    stream = stream_files(spark, source, files_per_trigger=1)
    A.append_stream(stream, root, b"k", segment_rows=16).awaitTermination()
    log = spark.read.parquet(f"{root}/log")
    assert log.count() == n and log.select("batch").distinct().count() == 3
    assert A.verify_chain(log.drop("batch"), b"k", segment_rows=16).count() == 0
    per = log.groupBy("tenant_id").agg(F.max("seq").alias("m"), F.count("*").alias("n"), F.count_distinct("seq").alias("d"))
    assert all(r.m == r.n == r.d for r in per.collect())


PATTERNS = ["*", "sales.dbo.*", "sales.*.t1", "sales.dbo.t1*", "sales.:schema.t2", "Sales.DBO.T3", "*.dbo.*", "sa*s.dbo.t4",
            "sales.dbo.:table", "sales.d.t1", "a+b.c.d"]
TARGETS = ["sales.dbo.t1", "sales.dbo.t12", "sales.hr.t2", "SALES.dbo.t3", "sales.dbo_hr.t1", "sales.dbo.t4",
           "sales.dbo", "other.dbo.x", "sales", "a+b.c.d", "aab.c.d", "sales.dbo.a.b", "*"]


def test_object_patterns(spark):
    def brute(pattern, target):
        if pattern == "*" or pattern.lower() == target.lower():
            return True
        body, tail = (pattern[:-2], r"\..+") if pattern.endswith(".*") else (pattern, "")
        out = []
        for seg in body.split("."):
            out.append("[^.]+" if re.fullmatch(r":\w+", seg) else "[^.]*".join(map(re.escape, seg.split("*"))))
        return re.fullmatch(r"\.".join(out) + tail, target, re.I) is not None

    requests = spark.createDataFrame([("u", x) for x in TARGETS], "actor string, object string")
    rules = spark.createDataFrame([("*", p) for p in PATTERNS], "sub string, obj string")
    none = spark.createDataFrame([], "sid string, role string")
    got = {(r.obj, r.object) for r in abac.match_rules(requests, rules, none).collect()}
    assert got == {(p, x) for p in PATTERNS for x in TARGETS if brute(p, x)}
    assert got == {(p, x) for p in PATTERNS for x in TARGETS if abac.matches_pattern(p, x)}


def test_many_rules_with_wildcards_in_segments(spark):
    """Each object meets a bounded number of 50,000 rules, and loses none that match."""
    rules = [("*", f"sales.t{i}x*") for i in range(25_000)] + [("*", f"Sales.*z{i}.:name") for i in range(25_000)]
    rules += [("*", "sales.*"), ("*", "sales.t1*"), ("*", "*.*9"), ("*", "s*s.*5*.b")]
    names = [f"sales.t{i}x{i % 7}" for i in range(0, 25_000, 50)] + [f"SALES.q{i}Z{i}.b" for i in range(0, 25_000, 500)]
    requests = spark.createDataFrame([("u", x) for x in names], "actor string, object string")
    frame = spark.createDataFrame(rules, "sub string, obj string")
    none = spark.createDataFrame([], "sid string, role string")
    got = {}
    for r in abac.match_rules(requests, frame, none).select("object", "obj").collect():
        got.setdefault(r.object, set()).add(r.obj)
    plain = [p for _, p in rules[50_000:]]
    for i in range(0, 25_000, 50):
        x = f"sales.t{i}x{i % 7}"
        assert got.pop(x) == {f"sales.t{i}x*"} | {p for p in plain if abac.matches_pattern(p, x)}
    for i in range(0, 25_000, 500):
        x = f"SALES.q{i}Z{i}.b"
        ends = {f"Sales.*z{i}.:name"} | {p for p in plain if abac.matches_pattern(p, x)}
        assert got.pop(x) == ends
    shapes = [r[0] for r in frame.select(abac.pattern_shape(F.col("obj"))).distinct().collect()]
    assert len(shapes) < 20
    keys = requests.select("object", F.explode(abac.object_keys(F.col("object"), shapes)).alias("key"))
    met = keys.join(frame.select(abac.pattern_key(F.col("obj")).alias("key")), "key").groupBy("object").count()
    assert met.agg(F.max("count")).first()[0] <= 8


def test_random_wildcard_segments(spark):
    import itertools

    parts = ["a", "ab", "*", "a*", "*b", "a*b", "b*a*", ":n", "*a*", "A*"]
    patterns = [".".join(x) + t for n in (1, 2) for x in itertools.product(parts, repeat=n) for t in ("", ".*")]
    targets = [".".join(x) for n in (1, 2, 3) for x in itertools.product(["a", "b", "ab", "Aab", "bab"], repeat=n)]
    requests = spark.createDataFrame([("u", x) for x in targets], "actor string, object string")
    rules = spark.createDataFrame([("*", p) for p in patterns], "sub string, obj string")
    none = spark.createDataFrame([], "sid string, role string")
    got = {(r.obj, r.object) for r in abac.match_rules(requests, rules, none).collect()}
    assert got == {(p, x) for p in patterns for x in targets if abac.matches_pattern(p, x)}


def test_policy_semantics(spark):
    lines = [
        "# comment", "p, alice, t1, a.b.*, read", "p, *, t1, a.b.secret, *, , deny", "p, staff, t1, a.c.x, read",
        "p, bob, t1, a.c.y, read, r.hour < 5, allow", "p, bob, t1, a.c.z, read", "p, bob, t2, a.c.z, read, r.odd, deny",
        "g, carol, staff",
    ]
    rules, grouping = abac.policy_frames(spark, lines, "t1")
    asked = [
        ("alice", "a.b.c", "read", True), ("alice", "a.b.secret", "read", False), ("alice", "a.b.c", "write", False),
        ("carol", "a.c.x", "read", True), ("dave", "a.c.x", "read", False),
        # An allow with an unknown condition does not count, a deny does.
        ("bob", "a.c.y", "read", False), ("bob", "a.c.z", "read", False), ("nobody", "q", "read", False),
    ]
    requests = spark.createDataFrame([(a, "t1", o, x) for a, o, x, _ in asked], "actor string, tenant string, object string, action string")
    renamed = rules.withColumnRenamed("tenant", "rule_tenant")
    got = {(r.actor, r.object, r.action): r.allowed for r in abac.evaluate(requests, renamed, grouping).collect()}
    assert got == {(a, o, x): ok for a, o, x, ok in asked}
    known = abac.evaluate(requests, renamed, grouping, {"r.hour < 5": F.lit(True), "r.odd": F.lit(False)})
    ok = {(r.actor, r.object) for r in known.where("allowed").collect()}
    assert {("bob", "a.c.y"), ("bob", "a.c.z")} <= ok


def brute_pick(scored, max_items, max_tokens, threshold):
    chosen, used = [], 0
    for item, score, tokens, boosted in sorted(scored, key=lambda r: (-r[1], r[0])):
        if len(chosen) >= max_items:
            break
        if not boosted and score < threshold and len(chosen) >= 3:
            continue
        if used + tokens > max_tokens and chosen:
            continue
        chosen.append(item)
        used += tokens
    return chosen


def test_pick_within_budget(spark):
    rng = random.Random(9)
    table = {
        q: [(i, rng.randrange(0, 40) / 40, rng.choice([10, 40, 300, 900, 5000]), rng.random() < 0.05) for i in range(400)]
        for q in range(6)
    }
    rows = [(q, *r) for q, items in table.items() for r in items]
    frame = spark.createDataFrame(rows, "query int, item long, score double, tokens long, boosted boolean")
    for limits in ((8, 4000, 0.25), (5, 200, 0.9), (3, 100, 0.0), (20, 1000, 0.5)):
        got = {}
        for r in relevance.pick_within_budget(frame, *limits).orderBy("query", "position").collect():
            got.setdefault(r.query, []).append(r.item)
        assert got == {q: brute_pick(items, *limits) for q, items in table.items()}


def test_relevance_scores(spark):
    queries = spark.createDataFrame([(1, "Order totals, for the customers"), (2, "xyz the")], "query int, text string")
    items = spark.createDataFrame(
        [(1, "orders by customer", False), (2, "totals", False), (3, "nothing here", True), (4, "zzz", False)],
        "item int, text string, boosted boolean",
    )
    got = {(r["query"], r["item"]): round(r["score"], 6) for r in relevance.relevance_scores(queries, items).collect()}
    # Three terms: order, totals, customers. Equal words 3, containing ones 1.
    assert got == {(1, 1): round(2 / 9, 6), (1, 2): round(3 / 9, 6)}


def test_gaps(spark):
    present = [1, 2, 5, 6, 9, 10, 15]
    frame = spark.createDataFrame([("a", s) for s in present] + [("b", 3)], "tenant_id string, seq long")
    got = {tuple(r) for r in A.chain_gaps(frame).collect()}
    # Chains start at 1, so what lies before the first entry is missing too.
    assert got == {("a", 3, 4), ("a", 7, 8), ("a", 11, 14), ("b", 1, 2)}


def test_votes_are_dealt_by_their_number(spark, monkeypatch):
    from consentry.operators import audit as A

    monkeypatch.setattr(A, "VOTES_PER_TASK", 10)
    steps = spark.range(2000).selectExpr("id % 500 AS request_id", "'u' || id % 3 AS approver_sid", "'APPROVED' AS decision")
    requests = spark.range(500).selectExpr("id AS request_id", "'u0' AS requester_sid", "id % 2 = 0 AS four_eyes")
    status = A.approval_status(requests, steps)
    assert ", 200), REPARTITION_BY_NUM" in status._jdf.queryExecution().toString()
    assert {r.status for r in status.collect()} <= {"APPROVED", "PENDING_SECOND_APPROVAL"}

"""Attribute policies evaluated over whole request logs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consentry.model import GOVERNANCE_SCHEMAS
from consentry.operators.lineage import downstream
from consentry.session import durable


def parse_policy(lines: Sequence[str], tenant: str) -> tuple[list[tuple], list[tuple[str, str]]]:
    """``p`` and ``g`` rows of a policy document with their defaults filled in."""
    rules, roles = [], []
    for raw in lines:
        parts = [p.strip() for p in raw.split(",")]
        if not raw.strip() or raw.strip().startswith("#"):
            continue

        def part(i: int, default: str | None, parts: list[str] = parts) -> str | None:
            return parts[i] if len(parts) > i and parts[i] else default

        if parts[0].lower() == "p" and len(parts) >= 4:
            rules.append(
                (parts[1], part(2, tenant), parts[3], part(4, "read"), part(5, "true"),
                 part(6, "allow"), part(7, None))
            )
        elif parts[0].lower() == "g" and len(parts) >= 3:
            roles.append((parts[1], parts[2]))
    return rules, roles


def policy_frames(spark, lines: Sequence[str], tenant: str) -> tuple[DataFrame, DataFrame]:
    """Rules and roles of a tenant's policy document; ``owner`` is that tenant, whatever tenant a rule names."""
    rules, roles = parse_policy(lines, tenant)
    return (
        spark.createDataFrame(rules, GOVERNANCE_SCHEMAS["policy_rules"]).withColumn("owner", F.lit(tenant)),
        spark.createDataFrame(roles, "sid string, role string"),
    )


def pattern_regex(pattern: Column) -> Column:
    """Object pattern as a regex: ``*`` stays inside a segment, a trailing ``.*`` takes
    any rest, ``:name`` one whole segment, dots are literal."""
    body = F.regexp_replace(pattern, r"\.\*$", "")
    tail = F.when(pattern.endswith(".*"), F.lit(r"\..+")).otherwise(F.lit(""))
    text = F.regexp_replace(body, r"([\\^$.|?+()\[\]{}])", r"\\$1")
    text = F.regexp_replace(text, r"(^|\\\.):[A-Za-z0-9_]+", r"$1[^.]+")
    text = F.replace(text, F.lit("*"), F.lit("[^.]*"))
    exact = F.concat(F.lit("(?i)^"), text, tail, F.lit("$"))
    return F.when(pattern == "*", F.lit("(?s)^.*$")).otherwise(exact)


def _segments(name: Column) -> Column:
    return F.split(F.lower(name), r"\.")


def _is_wild(segment: Column) -> Column:
    return segment.contains("*") | segment.rlike(r"^:[a-z0-9_]+")


# Up to so many literal characters of a wildcard segment are part of a key.
LITERAL = 16


def _literal(pattern: Column) -> Column:
    """``n, at, kind, text`` of the longest literal start (``p``) or, without one, end (``s``) of a wildcard segment.

    ``n`` is its length, 0 if no wildcard segment has a literal; ``-at`` is the segment's place, from 1.
    """
    body = F.regexp_replace(pattern, r"\.\*$", "")

    def of(segment: Column, place: Column) -> Column:
        start = F.left(F.regexp_extract(segment, r"^([^*:][^*]*)\*", 1), F.lit(LITERAL))
        end = F.right(F.regexp_extract(segment, r"^[^:]*\*([^*]+)$", 1), F.lit(LITERAL))
        text = F.when(start != "", start).otherwise(end)
        kind = F.when(start != "", "p").otherwise("s")
        return F.struct(F.length(text).alias("n"), (-place - 1).alias("at"), kind.alias("kind"), text.alias("text"))

    return F.array_max(F.transform(_segments(body), of))


def pattern_shape(pattern: Column) -> Column:
    """Which segments are literal (L) or hold a wildcard (W); ``>`` marks a trailing ``.*``, and ``@2p5`` that the
    first five characters of the wildcard segment 2 are literal (``s``: the last ones).

    There are as many shapes as ways to write a pattern, a few dozen, however many rules.
    """
    body = F.regexp_replace(pattern, r"\.\*$", "")
    letters = F.transform(_segments(body), lambda s: F.when(_is_wild(s), "W").otherwise("L"))
    tail = F.when(pattern.endswith(".*"), ">").otherwise("")
    held = _literal(pattern)
    literal = F.when(held["n"] > 0, F.concat(F.lit("@"), -held["at"], held["kind"], held["n"])).otherwise("")
    return F.when(pattern == "*", "any").otherwise(F.concat(F.array_join(letters, ""), tail, literal))


def pattern_key(pattern: Column) -> Column:
    """The pattern with its shape, every wildcard segment replaced by ``*``, and the literal its shape names."""
    body = F.regexp_replace(pattern, r"\.\*$", "")
    plain = F.transform(_segments(body), lambda s: F.when(_is_wild(s), "*").otherwise(s))
    held = _literal(pattern)
    rest = F.when(pattern != "*", F.array_join(plain, "."))
    return F.concat_ws("|", pattern_shape(pattern), rest, F.when((pattern != "*") & (held["n"] > 0), held["text"]))


def pattern_needs_regex(pattern: Column) -> Column:
    """Whether a segment holds more than a lone ``*``, so that the key does not decide."""
    body = F.regexp_replace(pattern, r"\.\*$", "")
    return (pattern != "*") & F.exists(_segments(body), lambda s: _is_wild(s) & (s != "*"))


def object_keys(name: Column, shapes: Sequence[str]) -> Column:
    """The keys under which patterns of these shapes would match an object name."""
    segments = _segments(name)
    keys = []
    for shape in shapes:
        if shape == "any":
            keys.append(F.lit("any"))
            continue
        form, _, literal = shape.partition("@")
        letters = form.rstrip(">")
        body = [F.try_element_at(segments, F.lit(i + 1)) for i in range(len(letters))]
        used = F.concat_ws(".", *body)
        if form.endswith(">"):
            fits = (F.size(segments) > len(letters)) & (F.length(name) > F.length(used) + 1)
        else:
            fits = F.size(segments) == len(letters)
        plain = [F.lit("*") if x == "W" else b for x, b in zip(letters, body)]
        parts = [F.lit(shape), F.concat_ws(".", *plain)]
        if literal:
            at, kind, n = re.fullmatch(r"(\d+)([ps])(\d+)", literal).groups()
            segment = body[int(at) - 1]
            fits = fits & (F.length(segment) >= int(n))
            parts.append((F.left if kind == "p" else F.right)(segment, F.lit(int(n))))
        keys.append(F.when(fits, F.concat_ws("|", *parts)))
    return F.array_compact(F.array(*keys))


# From so many rules on, pairs of subject and key are looked up in a table of bits: so many for a rule, in all, and in a word.
FILTERED, RULE_BITS, MOST_BITS, WORD = 50_000, 16, 1 << 27, 64


def _place(subject: Column, key: Column, size: int) -> Column:
    return F.pmod(F.xxhash64(subject, key), F.lit(size))


def _known_keys(ready: DataFrame, rules: int) -> tuple[Column, int]:
    """Table of bits, one row of at most MOST_BITS, in which the places of all rules' subjects and keys are set; and its size."""
    size = WORD << max(0, (min(MOST_BITS, rules * RULE_BITS) // WORD - 1).bit_length())
    place = _place(F.col("_rule_sub"), F.col("_rule_key"), size)
    bit = F.expr(f"shiftleft(1L, CAST(_place % {WORD} AS INT))")
    words = ready.select(place.alias("_place")).groupBy(F.floor(F.col("_place") / WORD).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    every = ready.sparkSession.range(size // WORD).select(F.col("id").alias("_word")).join(words, "_word", "left")
    listed = every.agg(F.array_sort(F.collect_list(F.struct("_word", F.coalesce("_bits", F.lit(0).cast("long")).alias("_bits")))).alias("_all"))
    return durable(listed.select(F.col("_all._bits").alias("_bits")), "keys").scalar(), size


def _candidates(requests: DataFrame, grouping: DataFrame, shapes: Sequence[str]) -> DataFrame:
    """Every request with its possible rule subjects and object keys, one pair a row; ``_first`` marks one row of a request.

    An actor's roles are listed once per actor (there are few), so requests meet them
    in one join and fan out without another shuffle.
    """
    roles = (
        grouping.select(F.lower("sid").alias("_actor"), F.lower("role").alias("_role"))
        .groupBy("_actor")
        .agg(F.collect_set("_role").alias("_roles"))
    )
    known = requests.withColumn("_actor", F.lower("actor")).join(roles, "_actor", "left")
    none = F.array().cast("array<string>")
    subjects = F.array_distinct(
        F.concat(F.array(F.lit("*"), F.col("_actor")), F.coalesce("_roles", none))
    )
    keyed = known.select(
        *requests.columns, F.posexplode(subjects).alias("_nth", "_sub"), object_keys(F.col("object"), shapes).alias("_all")
    ).select(*requests.columns, "_sub", "_nth", F.posexplode_outer("_all").alias("_at", "_key"))
    return keyed.withColumn("_first", (F.col("_nth") == 0) & (F.coalesce("_at", F.lit(0)) == 0)).drop("_nth", "_at")


def _with_rules(
    requests: DataFrame,
    rules: DataFrame,
    grouping: DataFrame,
    how: str,
    also: Column | None = None,
) -> DataFrame:
    shapes = sorted(r[0] for r in rules.select(pattern_shape(F.col("obj"))).distinct().collect())
    keyed = _candidates(requests, grouping, shapes or ["any"])
    obj = F.col("obj")
    ready = rules.select(
        F.lower("sub").alias("_rule_sub"),
        pattern_key(obj).alias("_rule_key"),
        F.when(pattern_needs_regex(obj), pattern_regex(obj)).alias("_regex"),
        *[F.col(c) for c in rules.columns],
    )
    count = rules.count()
    if count >= FILTERED:
        # Most keys belong to no rule: they go before the rows move. A left join keeps one row of each request.
        bits, size = _known_keys(ready, count)
        at = _place(F.col("_sub"), F.col("_key"), size)
        hit = F.col("_key").isNotNull() & (F.getbit(F.get(bits, F.floor(at / WORD).cast("int")), F.pmod(at, F.lit(WORD)).cast("int")) == 1)
        keyed = keyed.where(hit if how == "inner" else hit | F.col("_first"))
    keyed = keyed.drop("_first")
    # A regex is compiled per candidate; it is left to the patterns a key cannot decide.
    fits = F.when(F.col("_regex").isNull(), True).otherwise(F.expr("object rlike _regex"))
    on = (F.col("_sub") == F.col("_rule_sub")) & (F.col("_key") == F.col("_rule_key"))
    on = on & (fits if also is None else also & fits)
    return keyed.join(ready, on, how).drop("_sub", "_key", "_rule_sub", "_rule_key", "_regex")


def match_rules(requests: DataFrame, rules: DataFrame, grouping: DataFrame) -> DataFrame:
    """(request columns, rule columns) for every rule whose subject and object match.

    ``requests``: actor, object and more. Subjects and object keys meet in an equi join;
    there is no nested-loop join, and Spark splits a rule everybody matches at run time.
    """
    return _with_rules(requests, rules, grouping, "inner")


def closed_roles(grouping: DataFrame) -> DataFrame:
    """(sid, role) with the roles of roles, at any number of steps; names fold case."""
    edges = grouping.select(F.lower("sid").alias("src"), F.lower("role").alias("dst"))
    reached = downstream(edges, edges.select(F.col("src").alias("node")).distinct())
    return reached.select(F.col("root").alias("sid"), F.col("node").alias("role"))


def evaluate(
    requests: DataFrame,
    rules: DataFrame,
    grouping: DataFrame,
    conditions: dict[str, Column] | None = None,
) -> DataFrame:
    """Requests with ``allowed``. Any matching deny wins; no allow means denied.

    ``requests``: actor, tenant, object, action and what conditions need; every row comes back, equal ones too.
    ``rules`` call their tenant ``rule_tenant``; ``owner``, where there is such a column, is the tenant whose rule set a rule
    belongs to, else ``rule_tenant`` is. Rules meet only requests of the tenant that owns them. ``conditions`` maps the
    condition text of a rule to a predicate over the request. A condition that is unknown or NULL counts as
    met for a deny and as unmet for an allow. Within its rule set a deny ignores action and tenant, an allow
    needs both. Roles count at any number of steps.
    """
    met: Column = F.when(F.coalesce(F.trim("sub_rule"), F.lit("true")).isin("", "true"), True)
    for text, predicate in (conditions or {}).items():
        met = met.when(F.col("sub_rule") == text, predicate)
    owner = "owner" if "owner" in rules.columns else "rule_tenant"
    rules = rules.withColumn("_owner", F.col(owner))
    if owner != "rule_tenant":
        rules = rules.drop(owner)
    deny = F.lower("eft") == "deny"
    allow = (
        (F.lower("eft") == "allow")
        & (F.col("rule_tenant") == F.col("tenant"))
        & ((F.col("act") == "*") | (F.lower("act") == F.lower("action")))
    )
    # Equal requests are decided once. A left join keeps requests no rule matches.
    distinct = requests.distinct()
    verdict = (
        _with_rules(distinct, rules, closed_roles(grouping), "left", (F.col("_owner") == F.col("tenant")) & (deny | allow))
        .groupBy(*requests.columns)
        .agg(
            F.bool_or(deny & F.coalesce(met, F.lit(True))).alias("_denied"),
            F.bool_or(allow & F.coalesce(met, F.lit(False))).alias("_granted"),
        )
    )
    granted = F.coalesce("_granted", F.lit(False)) & ~F.coalesce("_denied", F.lit(False))
    verdict = verdict.select(*[F.col(c).alias(f"_{c}") for c in requests.columns], granted.alias("allowed"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in requests.columns]
    return requests.join(verdict, same).select(*requests.columns, "allowed")


def replay(audit: DataFrame, rules: DataFrame, grouping: DataFrame) -> DataFrame:
    """Audit rows with the recorded and the simulated decision.

    The log folds to its distinct (actor, tenant, table, action) first: the draft policy
    is evaluated once per distinct request, however often it was recorded.
    """
    table = F.when(F.trim(F.coalesce("target_table", F.lit(""))) == "", "*").otherwise(
        F.col("target_table")
    )
    action = F.when(F.lower("event_type").contains("write"), "write").otherwise("read")
    keys = ["actor", "tenant", "object", "action"]
    rows = audit.select(
        "id",
        "occurred_at",
        F.col("actor_sid").alias("actor"),
        F.col("tenant_id").alias("tenant"),
        table.alias("object"),
        F.coalesce(action, F.lit("read")).alias("action"),
        F.when(F.upper(F.trim("decision")) == "DENY", "DENY").otherwise("ALLOW").alias("recorded"),
    )
    distinct = rows.select(*keys).distinct()
    verdict = evaluate(distinct, rules.withColumnRenamed("tenant", "rule_tenant"), grouping)
    simulated = verdict.select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        F.when(F.col("allowed"), "ALLOW").otherwise("DENY").alias("simulated"),
    )
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(simulated, on).drop(*[f"_{k}" for k in keys])


def replay_summary(replayed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals and impact of a draft policy, overall or per table."""
    changed = F.col("recorded") != F.col("simulated")
    n = F.count("*")
    return replayed.groupBy(*by).agg(
        n.alias("evaluated"),
        F.count_if(F.col("simulated") == "ALLOW").alias("allowed"),
        F.count_if(F.col("simulated") == "DENY").alias("denied"),
        F.count_if(changed & (F.col("simulated") == "DENY")).alias("newly_denied"),
        F.count_if(changed & (F.col("simulated") == "ALLOW")).alias("newly_allowed"),
        F.round(F.count_if(changed) * 100.0 / n, 2).alias("impact_percent"),
    )


def replay_differences(replayed: DataFrame) -> DataFrame:
    return replayed.where(F.col("recorded") != F.col("simulated"))


def role_closure_edges(grouping: DataFrame) -> DataFrame:
    """Role inheritance as edges for a downstream closure."""
    return grouping.select(F.col("sid").alias("src"), F.col("role").alias("dst")).distinct()


def matches_pattern(pattern: str, target: str) -> bool:
    """Driver form of the object pattern."""
    if pattern == "*" or pattern.lower() == target.lower():
        return True
    body, tail = (pattern[:-2], r"\..+") if pattern.endswith(".*") else (pattern, "")
    text = re.sub(r"([\\^$.|?+()\[\]{}])", r"\\\1", body)
    text = re.sub(r"(^|\\\.):[A-Za-z0-9_]+", r"\1[^.]+", text).replace("*", "[^.]*")
    return re.fullmatch(text + tail, target, re.IGNORECASE) is not None

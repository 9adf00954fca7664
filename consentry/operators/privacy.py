"""Differentially private aggregates and the daily privacy ledger."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consentry.functions.crypto import hmac_text
from consentry.operators.ordering import latest_per_key
from consentry.operators.predicates import GovernanceError

# Defaults of the privacy engine.
MIN_COHORT = 5
DAILY_BUDGET = 10.0
MIN_SENSITIVITY = 0.01


def laplace(scale: Column | float, seed: int | None = None) -> Column:
    """Laplace noise by the inverse distribution function."""
    b = scale if isinstance(scale, Column) else F.lit(float(scale))
    u = (F.rand(seed) if seed is not None else F.rand()) - 0.5
    return -b * F.signum(u) * F.log1p(-2.0 * F.abs(u) * (1 - 1e-12))


def private_sums(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    epsilon: float,
    sensitivity: float,
    min_cohort: int = MIN_COHORT,
    seed: int | None = None,
) -> DataFrame:
    """Noisy sum per group; a cohort below the minimum is suppressed and costs nothing.

    The exact size of a cohort is no part of the answer: it would be free of any budget. The noise comes from
    Spark's generator, which is no secure source; give no ``seed`` outside tests.
    """
    if epsilon <= 0:
        raise GovernanceError("epsilon must be positive")
    if sensitivity < MIN_SENSITIVITY:
        raise GovernanceError(f"sensitivity must be at least {MIN_SENSITIVITY}")
    groups = df.groupBy(*by).agg(F.count("*").alias("cohort"), F.sum(value).alias("_sum"))
    # The noise is drawn once per group, before anything reads it twice.
    noisy = groups.withColumn("_noisy", F.col("_sum") + laplace(sensitivity / epsilon, seed))
    small = F.col("cohort") < min_cohort
    return noisy.select(
        *by,
        small.alias("suppressed"),
        F.when(~small, F.bround("_noisy", 4)).alias("value"),
        F.when(small, 0.0).otherwise(epsilon).alias("epsilon_spent"),
    )


def _text(*columns: str) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]


def contributions(
    df: DataFrame, by: Sequence[str], client: str, value: str, key: bytes, most: int, bound: float
) -> DataFrame:
    """(client, by..., amount): what each client adds to at most ``most`` groups, each amount clipped to ``bound``.

    A client's rows are summed per group first, so neither many rows nor many groups of one client move more than
    ``most * bound``. The groups that count are those with the smallest keyed hashes: nobody without the key can steer the choice, and
    it is the same each time. A hot client keeps ``most`` rows a task (window group limit). Rows without a client take no part;
    null values add nothing.
    """
    each = df.where(F.col(client).isNotNull()).groupBy(client, *by).agg(F.coalesce(F.sum(value), F.lit(0)).cast("double").alias("amount"))
    chosen = hmac_text(F.concat_ws("|", F.lit("choice"), *_text(client, *by)), key)
    kept = latest_per_key(each.withColumn("_choice", chosen), [client], [F.asc("_choice"), *[F.asc(c) for c in by]], most)
    clipped = F.greatest(F.least("amount", F.lit(float(bound))), F.lit(-float(bound)))
    return kept.select(client, *by, clipped.alias("amount"))


def keyed_laplace(scale: float, key: bytes, *counter: Column) -> Column:
    """Laplace noise from a keyed hash of a counter: 52 bits of HMAC-SHA256 as a uniform number.

    The same counter draws the same noise, so asking again tells nothing new; without the key it can't be told from chance.
    """
    digest = hmac_text(F.concat_ws("|", F.lit("noise"), *counter), key)
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52) - 0.5
    return -float(scale) * F.signum(u) * F.ln(1 - 2 * F.abs(u))


def private_client_sums(
    df: DataFrame,
    by: Sequence[str],
    client: str,
    value: str,
    epsilon: float,
    bound: float,
    key: bytes,
    release: str,
    most: int = 1,
    min_cohort: int = MIN_COHORT,
) -> DataFrame:
    """Noisy sum per group that hides a whole client, not a row: (by..., suppressed, value, epsilon_spent).

    A client moves all sums together by at most ``most * bound``, which is what the noise is scaled to. A cohort is the clients
    that count in a group; below the minimum it is suppressed. ``release`` names the answer: another name draws other noise and must be
    paid for again. Like in ``private_sums``, which groups there are is told as they are. The noise is a double; its last bits are not hardened.
    """
    if epsilon <= 0:
        raise GovernanceError("epsilon must be positive")
    if bound < MIN_SENSITIVITY or most < 1:
        raise GovernanceError(f"the bound must be at least {MIN_SENSITIVITY}, and one group at least must count")
    rows = contributions(df, by, client, value, key, most, bound)
    groups = rows.groupBy(*by).agg(F.count("*").alias("_cohort"), F.sum("amount").alias("_sum"))
    noise = keyed_laplace(most * bound / epsilon, key, F.lit(release), *_text(*by))
    small = F.col("_cohort") < min_cohort
    return groups.select(
        *by, small.alias("suppressed"), F.when(~small, F.bround(F.col("_sum") + noise, 4)).alias("value"),
        F.when(small, 0.0).otherwise(epsilon).alias("epsilon_spent"),
    )


def privacy_ledger(
    spends: DataFrame,
    client: str = "client",
    at: str = "at",
    epsilon: str = "epsilon",
    row_id: str = "id",
    budget: float = DAILY_BUDGET,
) -> DataFrame:
    """Every request with ``accepted``: a request that would pass the daily budget is
    refused and not added, so a later smaller one may still pass.

    Order matters only among requests that can be accepted at all. Of one amount ``e``
    at most ``budget / e`` requests fit a day, and once one of them is refused so is every
    later one; hence only the first ``budget / (smallest e)`` per (client, day, e) are candidates. The
    walk runs over those alone and holds one sum, however hot a client is; the rest are refused.
    """
    day = F.to_date(at)
    smallest = spends.agg(F.min(epsilon)).first()[0]
    if smallest is None:
        return spends.withColumn("accepted", F.lit(False))
    if smallest <= 0:
        raise GovernanceError("epsilon must be positive")
    # Amounts in millionths, so that the running sum is exact.
    unit = F.round(F.col(epsilon) * 1000000).cast("long")
    rows = spends.withColumn("_day", day).withColumn("_e", unit)
    most = int(budget / float(smallest)) + 1
    first = latest_per_key(rows, [client, "_day", "_e"], [F.asc(at), F.asc(row_id)], most)
    cap = int(round(budget * 1000000))
    id_type = first.schema[row_id].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, spent = None, 0
        for batch in batches:
            taken = []
            for key, amount in zip(zip(batch["_client"], batch["_day"]), batch["_e"]):
                if key != now:
                    now, spent = key, 0
                fits = spent + amount <= cap
                spent += amount if fits else 0
                taken.append(fits)
            yield batch.loc[taken, [row_id]].assign(_ok=True)

    # A day of a client is one walk in order; it holds a running sum, however many requests there are.
    walk = first.select(F.col(client).cast("string").alias("_client"), "_day", F.col(at).alias("_at"), row_id, "_e")
    walk = walk.repartition("_client", "_day").sortWithinPartitions("_client", "_day", "_at", row_id)
    taken = walk.select("_client", F.col("_day").cast("string").alias("_day"), row_id, "_e").mapInPandas(
        fold, f"{row_id} {id_type}, _ok boolean"
    )
    return (
        spends.join(taken, row_id, "left")
        .withColumn("accepted", F.coalesce("_ok", F.lit(False)))
        .drop("_ok")
    )

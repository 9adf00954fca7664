"""Hash trees over audit chains: one root a chain, and a proof for each entry that needs nothing else of the log.

A leaf binds chain, number and entry hash; a node binds its two children; a node without a neighbour moves up as it is. Blocks
of ``2 ** depth`` neighbours are folded in one row, so a chain of n entries takes ``log n / depth`` aggregates, each over that much fewer
rows, and no task holds more than a block.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consentry.functions.crypto import hmac_text
from consentry.session import durable

#: Levels of the tree that one aggregate folds: blocks of 4096.
DEPTH = 12


def leaf(chain: Sequence[str]) -> Column:
    """Hash of an entry; null names of a chain count as empty."""
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in chain]
    return F.sha2(F.concat_ws("|", F.lit("0"), *names, F.col("seq").cast("string"), F.col("entry_hash")), 256)


def _node(left: Column, right: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit("1"), left, right), 256)


def _above(level: Column) -> Column:
    """The level above: neighbours joined, a last one without a neighbour as it is."""
    last = F.floor((F.size(level) - 1) / 2).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.when(i * 2 + 1 < F.size(level), _node(F.get(level, i * 2), F.get(level, i * 2 + 1))).otherwise(F.get(level, i * 2)),
    )


def _levels(members: Column, depth: int) -> Column:
    """All levels of a block, leaves first."""
    leaves = F.transform(members, lambda m: m["hash"])
    grow = lambda levels, _: F.concat(levels, F.array(_above(F.element_at(levels, -1))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.array(leaves), grow)


@dataclass(frozen=True)
class HashTree:
    """Blocks of each round: (chain..., number, entries, members, top)."""

    rounds: tuple[DataFrame, ...]
    chain: tuple[str, ...]
    depth: int

    def roots(self, key: bytes | None = None) -> DataFrame:
        """(chain..., entries, root), with a keyed ``signature`` of the three if there is a key."""
        rows = self.rounds[-1].select(*self.chain, "entries", F.col("top").alias("root"))
        return rows if key is None else rows.withColumn("signature", _signature(self.chain, key))

    def proofs(self) -> DataFrame:
        """(chain..., seq, entry_hash, path): the neighbours on the way up, and whether each stands to the left."""
        out = self._paths(self.rounds[0]).select(*self.chain, "block", F.col("number").alias("seq"), "entry_hash", "path")
        for blocks in self.rounds[1:]:
            above = self._paths(blocks).select(
                *[F.col(c).alias(f"_{c}") for c in self.chain], F.col("block").alias("_up"), F.col("number").alias("_number"),
                F.col("path").alias("_more"),
            )
            same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in self.chain]
            out = out.join(above, [*same, F.col("block") == F.col("_number")]).select(
                *self.chain, F.col("_up").alias("block"), "seq", "entry_hash", F.concat("path", "_more").alias("path")
            )
        return out.drop("block")

    def _paths(self, blocks: DataFrame) -> DataFrame:
        def path(levels: Column, place: Column) -> Column:
            def step(i: Column) -> Column:
                other = F.call_function("shiftright", place, i).bitwiseXOR(F.lit(1))
                level = F.get(levels, i)
                near = F.struct((other % 2 == 0).alias("left"), F.get(level, other).alias("hash"))
                return F.when(other < F.size(level), near)

            return F.filter(F.transform(F.sequence(F.lit(0), F.lit(self.depth - 1)), step), lambda x: x.isNotNull())

        # A variable of a lambda, so that the levels are computed once a block.
        each = F.transform(
            F.array(_levels(F.col("members"), self.depth)),
            lambda levels: F.transform(
                "members",
                lambda m, i: F.struct(m["number"].alias("number"), m["entry_hash"].alias("entry_hash"), path(levels, i).alias("path")),
            ),
        )
        rows = blocks.select(*self.chain, F.col("number").alias("block"), F.explode(F.get(each, F.lit(0))).alias("_m"))
        return rows.select(*self.chain, "block", "_m.*")


def hash_tree(chained: DataFrame, chain: Sequence[str] = ("tenant_id",), depth: int = DEPTH) -> HashTree:
    """The tree over the entries of each chain in the order of their numbers.

    Blocks are ranges of numbers, so a hot chain spreads over many tasks. A missing number closes up inside its block, a repeated one
    counts twice: both give another root. An empty log has no roots.
    """
    none = F.lit(None).cast("string")
    nodes = chained.select(
        *chain, (F.col("seq") - 1).cast("long").alias("at"), F.col("seq").cast("long").alias("number"), leaf(chain).alias("hash"), "entry_hash",
        F.lit(1).cast("long").alias("entries"),
    )
    rounds = []
    while True:
        member = F.struct("number", "hash", "entry_hash")
        blocks = nodes.groupBy(*chain, F.shiftright("at", depth).alias("number")).agg(
            F.sum("entries").alias("entries"), F.array_sort(F.collect_list(member)).alias("members")
        )
        top = F.get(F.element_at(_levels(F.col("members"), depth), -1), F.lit(0))
        blocks = durable(blocks.withColumn("top", top), "hash-tree")
        rounds.append(blocks)
        if not (blocks.agg(F.max("number")).first()[0] or 0):
            return HashTree(tuple(rounds), tuple(chain), depth)
        nodes = blocks.select(
            *chain, F.col("number").alias("at"), "number", F.col("top").alias("hash"), none.alias("entry_hash"), "entries"
        )


def _signature(chain: Sequence[str], key: bytes) -> Column:
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in chain]
    return hmac_text(F.concat_ws("|", F.lit("root"), *names, F.col("entries").cast("string"), F.col("root")), key)


def verify_proofs(
    proofs: DataFrame, roots: DataFrame, chain: Sequence[str] = ("tenant_id",), key: bytes | None = None
) -> DataFrame:
    """(chain..., seq, valid): whether each entry leads up to the root of its chain. Nothing of the log is read.

    With ``key``, a root whose signature is wrong proves nothing. Entries of a chain without a root are not valid.
    """
    if key is not None:
        roots = roots.where(F.col("signature") == _signature(chain, key))
    up = F.aggregate(
        "path", leaf(chain),
        lambda at, step: F.when(step["left"], _node(step["hash"], at)).otherwise(_node(at, step["hash"])),
    )
    found = proofs.select(*chain, "seq", up.alias("_top"))
    right = roots.select(*[F.col(c).alias(f"_{c}") for c in chain], "root")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in chain]
    valid = F.coalesce(F.col("_top") == F.col("root"), F.lit(False))
    return found.join(right, same, "left").select(*chain, "seq", valid.alias("valid"))

"""Repair of conversation structure at least cost.

A conversation is sound if the initials of its roles read ``(s?(ua)+)?``: a system turn or none, then user and assistant in
turn. Edits make it so. Keep costs 0; Rerole, to user or assistant, 3; Delete 4, and blank and duplicate rows must go; Insert, of a user
or assistant turn without text, 3; a truncated row that stays adds 3. Of all cheapest sequences of edits the one whose initials
(``D``, ``I``, ``K``, ``R``) come first in ASCII is taken.

States are what was emitted last (nothing, s, u, a); a row's edits are the edges of a DAG between the states before and after it.
The weight of a path is one whole number: its high digits are the cost, and each row owns three octal digits below, in order,
for its edit initials (at most two inserts before the row's own edit), filled up with zeros at the end. The row's own edit ends its
digits, so no row's letters begin another's, and numbers stand in the order of (cost, letters). Ordinary integer minima over the DAG
thus choose cost and tie at once, and the letters are read off the smallest number.

A conversation of any length is cut into chunks of CHUNK rows. A chunk's whole numbers between all pairs of states are summarised as 16 costs and the
16 ranks of their letters; chunks join in a tree of FAN children by whole numbers of cost, rank before and rank after, and the states that
the root chooses lead back down. So a hot conversation is decided by many tasks, and the numbers stay short.

Rows are ordered by turn (null first), then role, then the SHA-256 of the text; equal rows stay apart. Nulls in role or text are one
space (so a null text is blank); rows without conversation form one conversation. A role's initial is its first character; a
role that doesn't begin with s, u or a can't be kept. Texts may have any length; columns beyond the four are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consentry.operators.ordering import numbered
from consentry.session import durable

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows of a chunk, and chunks (or nodes) that a node of the tree joins.
CHUNK, FAN = 256, 256

#: Digits of the edits, in the order of their letters; 0 is padding.
_LETTERS = " DIKR"
_DIGIT = {c: n for n, c in enumerate(_LETTERS)}
_SLOT, _BITS = 3, 3
#: Rows as codes: initials s, u, a, other; whole, truncated, or to be deleted.
_CODES = "suaoSUAO0123"
_STATES = range(4)  # nothing yet, after s, after u, after a
_NEXT = (2, 2, 3, 2)  # the state behind a user or assistant turn that is sound here
_ENDS = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
_MANY = 1 << 10  # above 16 ranks times 16 ranks


def _edges(code: str) -> list[tuple[int, int, int, int]]:
    """``before, after, cost, digits`` of the best way to edit a row between two states."""
    place = _CODES.index(code)
    initial, fault = place % 4, place // 4
    best: dict[tuple[int, int], tuple[int, int]] = {}

    def offer(i: int, j: int, cost: int, letters: str) -> None:
        digits = 0
        for c in letters.ljust(_SLOT):
            digits = digits << _BITS | _DIGIT[c]
        best[i, j] = min(best.get((i, j), (1 << 30, 0)), (cost, digits))

    for i in _STATES:
        offer(i, i, DELETE, "D")
        if fault == 2:
            continue
        extra, state = (TRUNCATED if fault else 0), i
        for inserts in range(3):
            before = "I" * inserts
            if initial == 0 and state == 0:
                offer(i, 1, extra + KEEP, "K")
            if (initial, _NEXT[state]) in ((1, 2), (2, 3)):
                offer(i, _NEXT[state], inserts * INSERT + KEEP + extra, before + "K")
            offer(i, _NEXT[state], inserts * INSERT + REROLE + extra, before + "R")
            state = _NEXT[state]
    return [(i, j, cost, digits) for (i, j), (cost, digits) in best.items()]


_EDGES = {code: _edges(code) for code in _CODES}


def _width(codes: str) -> int:
    return _SLOT * len(codes) + 2


def weights(codes: str, start: int) -> list[int | None]:
    """The smallest whole number of a path over the rows ``codes`` from ``start`` to each state."""
    width = _width(codes)
    unit = 1 << (_BITS * width)
    now: list[int | None] = [None] * 4
    now[start] = 0
    for r, code in enumerate(codes):
        shift = _BITS * (width - _SLOT * (r + 1))
        after: list[int | None] = [None] * 4
        for i, j, cost, digits in _EDGES[code]:
            if (w := now[i]) is not None:
                w += cost * unit + (digits << shift)
                if (b := after[j]) is None or w < b:
                    after[j] = w
        now = after
    return now


def letters(codes: str, weight: int) -> list[str]:
    """The edit initials at each row, read off the digits of a path's number; one entry more for what follows the last row."""
    width = _width(codes)
    low = weight & ((1 << (_BITS * width)) - 1)
    text = "".join(_LETTERS[int(d)] for d in f"{low:o}".zfill(width))
    return [text[k : k + _SLOT].rstrip() for k in range(0, width, _SLOT)]


def solve(codes: str) -> list[str]:
    """Edit initials at each row of a whole conversation, and after it."""
    width, now = _width(codes), weights(codes, 0)
    ended = []
    for j in _STATES:
        cost, tail = _ENDS[j]
        digits = 0
        for c in tail.ljust(2):
            digits = digits << _BITS | _DIGIT[c]
        if now[j] is not None:
            ended.append(now[j] + (cost << (_BITS * width)) + digits)
    return letters(codes, min(ended))


_solved = lru_cache(maxsize=20_000)(solve)


def _ranks(values: dict) -> dict:
    order = {v: n for n, v in enumerate(sorted(set(values.values())))}
    return {k: order[v] for k, v in values.items()}


#: A summary: cost and rank of the letters for each pair of states that a path joins.
Summary = dict[tuple[int, int], tuple[int, int]]


def summary(codes: str) -> Summary:
    width = _width(codes)
    found = {(i, j): w for i in _STATES for j, w in enumerate(weights(codes, i)) if w is not None}
    rank = _ranks({k: w & ((1 << (_BITS * width)) - 1) for k, w in found.items()})
    return {k: (w >> (_BITS * width), rank[k]) for k, w in found.items()}


def _joined(left: Summary, right: Summary) -> tuple[Summary, dict[tuple[int, int], int]]:
    """The summary of two stretches in a row, and the state between them on each of its paths."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for (h, i), (cost, rank) in left.items():
        for j in _STATES:
            if (more := right.get((i, j))) is not None:
                w = (cost + more[0]) * _MANY + rank * 16 + more[1]
                best[h, j] = min(best.get((h, j), (w, i)), (w, i))
    rank = _ranks({k: w % _MANY for k, (w, _) in best.items()})
    return {k: (w // _MANY, rank[k]) for k, (w, _) in best.items()}, {k: i for k, (_, i) in best.items()}


def fold(children: list[Summary]) -> Summary:
    now = children[0]
    for child in children[1:]:
        now, _ = _joined(now, child)
    return now


def states(children: list[Summary], start: int, end: int) -> list[int]:
    """The states at the borders of the children on the best path from ``start`` to ``end``."""
    now, back = children[0], []
    for child in children[1:]:
        now, between = _joined(now, child)
        back.append(between)
    out = [end]
    for between in reversed(back):
        out.append(between[start, out[-1]])
    return [start, *reversed(out)]


def best_end(root: Summary) -> int:
    """The state in which a whole conversation ends best, what is inserted behind it included."""

    def weight(j: int) -> int:
        cost, rank = root[0, j]
        tail = int("".join(str(_DIGIT[c]) for c in _ENDS[j][1].ljust(2)), 8)
        return (cost + _ENDS[j][0]) * _MANY + rank * 64 + tail

    return min((j for j in _STATES if (0, j) in root), key=weight)


def _flat(found: Summary) -> dict[str, list[int | None]]:
    pairs = [(i, j) for i in _STATES for j in _STATES]
    return {"costs": [found.get(p, (None, None))[0] for p in pairs], "ranks": [found.get(p, (None, None))[1] for p in pairs]}


def _unflat(row: dict) -> Summary:
    both = zip(row["costs"], row["ranks"], strict=True)
    return {(k // 4, k % 4): (c, r) for k, (c, r) in enumerate(both) if c is not None}


class _PerRow:
    """Maps each row of a frame; ``kept`` columns go through, ``work`` gives rows of the other columns.

    ``work`` returns a list of tuples for each row's values of ``read``.
    """

    def __init__(self, kept: list[str], read: list[str], work, fields: list[tuple[str, pa.DataType]]):
        self.kept, self.read, self.work, self.fields = kept, read, work, fields

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            took, made = [], []
            columns = [batch.column(c).to_pylist() for c in self.read]
            for n, values in enumerate(zip(*columns, strict=True)):
                for row in self.work(*values):
                    took.append(n)
                    made.append(row)
            take = pa.array(took, pa.int64())
            out = {c: batch.column(c).take(take) for c in self.kept}
            for k, (name, kind) in enumerate(self.fields):
                out[name] = pa.array([row[k] for row in made], kind)
            yield pa.record_batch(out)


_NUMBERS = [("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64()))]
_KEYS = ["lost", "conv"]


def _summarised(codes: str):
    flat = _flat(summary(codes))
    return [(flat["costs"], flat["ranks"])]


def _folded(children: list[dict]):
    flat = _flat(fold([_unflat(c) for c in children]))
    return [(flat["costs"], flat["ranks"])]


def _ended(costs: list, ranks: list):
    return [(0, best_end(_unflat({"costs": costs, "ranks": ranks})))]


def _led_down(children: list[dict], start: int, end: int):
    at = states([_unflat(c) for c in children], start, end)
    return [(c["node"], at[k], at[k + 1]) for k, c in enumerate(children)]


def _whole(codes: str):
    return [(_solved(codes),)]


def _between(codes: str, start: int, end: int, last: bool):
    tail = _ENDS[end][1] if last else ""
    return [([*letters(codes, weights(codes, start)[end])[:-1], tail],)]


def _decided(chunks: DataFrame) -> DataFrame:
    """``lost, conv, node, edits`` of chunks ``lost, conv, node, codes, alone, last``: initials at each row, and after the last one.

    Conversations of one chunk are solved at once. Those of more go up a tree of summaries and down again, a written table a level.
    """
    conv = chunks.schema["conv"].dataType.simpleString()
    keys = f"lost boolean, conv {conv}, node long"
    alone = chunks.where("alone").select(*_KEYS, "node", "codes")
    edits = [("edits", pa.list_(pa.string()))]
    done = alone.mapInArrow(_PerRow([*_KEYS, "node"], ["codes"], _whole, edits), f"{keys}, edits array<string>")
    parts = chunks.where("NOT alone").select(*_KEYS, "node", "codes", "last")
    numbers = f"{keys}, costs array<long>, ranks array<long>"
    level = parts.mapInArrow(_PerRow([*_KEYS, "node"], ["codes"], _summarised, _NUMBERS), numbers)
    level, tree = durable(level, "summaries"), []
    while level.agg(F.max("node")).first()[0]:
        up = F.floor(F.col("node") / FAN).cast("long").alias("node")
        children = F.sort_array(F.collect_list(F.struct("node", "costs", "ranks"))).alias("children")
        tree.append(durable(level.groupBy(*_KEYS, up).agg(children), "children"))
        joined = _PerRow([*_KEYS, "node"], ["children"], _folded, _NUMBERS)
        level = durable(tree[-1].mapInArrow(joined, numbers), "summaries")
    if not tree:
        return done
    ends, to = [("start", pa.int32()), ("end", pa.int32())], f"{keys}, start int, end int"
    way = level.mapInArrow(_PerRow([*_KEYS, "node"], ["costs", "ranks"], _ended, ends), to)
    for nodes in reversed(tree):
        led = _PerRow(_KEYS, ["children", "start", "end"], _led_down, [("node", pa.int64()), *ends])
        way = durable(nodes.join(way, [*_KEYS, "node"]).mapInArrow(led, to), "states")
    spelt = _PerRow([*_KEYS, "node"], ["codes", "start", "end", "last"], _between, edits)
    return done.unionByName(parts.join(way, [*_KEYS, "node"]).mapInArrow(spelt, done.schema))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, role, text, copies`` with planted faults, chosen by the crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes its role user. Nulls are one space.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


_BLANKS = " \t\n\x0b\f\r"


def _fault(text: Column) -> Column:
    """``blank``, ``truncated`` or null, of one text."""
    end = F.right(F.rtrim(text, F.lit(_BLANKS)), F.lit(1))
    return F.when(end == "", "blank").when(~end.isin(".", "!", "?"), "truncated")


def decide(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """Each row of ``conv_id, turn, role, text`` with its ``place`` in the conversation, its ``fault`` (blank, duplicate,
    truncated or null), its ``edits`` (initials of inserts before it and of its own edit) and, at a conversation's last row, the inserts
    ``after`` it.

    A row stands ``copies`` times, once by default, each copy behind the other. Deleted rows carry no text. An empty table gives no row.
    """
    copies = F.lit(1) if copies is None else copies
    filled = lambda c: F.coalesce(F.col(c), F.lit(" "))
    kind = rows.schema["conv_id"].dataType
    rows = rows.select(
        F.col("conv_id").isNull().alias("lost"),
        F.coalesce(F.col("conv_id"), F.lit("0").cast(kind)).alias("conv"), "turn", filled("role").alias("role"),
        F.sha2(filled("text"), 256).alias("digest"), filled("text").alias("text"), copies.alias("copies"),
    )
    # Equal rows become one with a count, so no key that they share can be too large to sort.
    same = ["lost", "conv", "turn", "role", "digest"]
    key = F.sha2(F.to_json(F.struct(*same)), 256).alias("row_key")
    texts = rows.groupBy(*same).agg(F.first("text").alias("text"), F.sum("copies").alias("copies"))
    texts = durable(texts.select("*", key, _fault(F.col("text")).alias("fault")), "turns")
    slim = texts.select(*same, "row_key", "copies", "fault")
    heard = ["lost", "conv", "role", "digest"]
    first = durable(slim.groupBy(*heard).agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns")).where("turns > 1"), "first")
    slim = slim.join(first.drop("turns"), heard, "left")
    again = F.col("first").isNotNull() & (F.struct("turn") > F.col("first"))
    slim = slim.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    fault = F.when(F.col("fault") == "blank", "blank").when(again | (F.col("copy") > 1), "duplicate").otherwise(F.col("fault"))
    slim = slim.select(*same, "row_key", "copy", fault.alias("fault"))
    order = ["turn", "role", "digest", "copy"]
    slim = durable(numbered(slim, _KEYS, order, "place"), "places")
    # Where a row stands in the codes: its initial, moved on by four for each worse fault.
    initial = F.instr(F.lit("sua"), F.left("role", F.lit(1)))
    initial = F.when((initial == 0) | (F.col("role") == ""), 4).otherwise(initial)
    worse = F.when(F.col("fault") == "truncated", 4).when(F.col("fault").isNotNull(), 8).otherwise(0)
    coded = slim.select(*_KEYS, "place", F.substring(F.lit(_CODES), initial + worse, F.lit(1)).alias("code"))
    node = F.floor((F.col("place") - 1) / CHUNK).cast("long").alias("node")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("place", "code"))), lambda x: x["code"])
    chunks = coded.groupBy(*_KEYS, node).agg(F.array_join(ordered, "").alias("codes"))
    size = coded.groupBy(*_KEYS).agg(F.max("place").alias("rows"))
    last = F.floor((F.col("rows") - 1) / CHUNK) == F.col("node")
    chunks = chunks.join(size, _KEYS).select(*_KEYS, "node", "codes", (F.col("rows") <= CHUNK).alias("alone"), last.alias("last"))
    decided = _decided(durable(chunks, "chunks"))
    at = decided.select(*_KEYS, "node", F.slice("edits", -1, 1)[0].alias("tail"), F.posexplode(F.slice("edits", 1, F.size("edits") - 1)).alias("nth", "edits"), F.size("edits").alias("n"))
    at = at.select(
        *_KEYS, (F.col("node") * CHUNK + F.col("nth") + 1).alias("place"), "edits",
        F.when(F.col("nth") + 2 == F.col("n"), F.col("tail")).otherwise("").alias("after"),
    )
    placed = durable(slim.join(at, [*_KEYS, "place"]), "edits")
    gone = placed.where(F.endswith("edits", F.lit("D"))).withColumn("text", F.lit(None).cast("string"))
    stay = placed.where(~F.endswith("edits", F.lit("D"))).join(texts.select("row_key", "text"), "row_key")
    conv_id = F.when(~F.col("lost"), F.col("conv")).alias("conv_id")
    return gone.unionByName(stay).select(conv_id, "place", "turn", "role", "fault", "edits", "after", "text")


class _Walk:
    """Reads rows sorted by conversation and place, spells out their turns and keeps the running figures of one conversation."""

    COLUMNS = ("conv_id", "place", "turn", "role", "fault", "edits", "after", "text")

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            done = []
            for conv, place, *row in zip(*(batch.column(c).to_pylist() for c in self.COLUMNS), strict=True):
                if place == 1:
                    if now:
                        done.append(now.row())
                    now = _Figures(conv)
                now.add(*row)
            yield self._batch(done, kind)
        if now:
            yield self._batch([now.row()], kind)

    @staticmethod
    def _batch(rows: list[dict], kind: pa.DataType) -> pa.RecordBatch:
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
        return pa.record_batch({c: pa.array([r[c] for r in rows], t) for c, t in zip(names, types, strict=True)})


class _Figures:
    def __init__(self, conv):
        self.conv, self.audit, self.digest = conv, [], hashlib.sha256()
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.cost = self.illegal = self.turns = self.state = 0
        self.low = self.high = self.before = None
        self.empty = True

    def add(self, turn, role: str, fault: str | None, edits: str, after: str, text: str | None) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        if fault:
            self.faults[fault] += 1
        if self.before is not None:
            self.illegal += self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        self.audit += (edits, after)
        self.cost += {"D": DELETE, "K": KEEP, "R": REROLE}[edits[-1]]
        self.cost += INSERT * (len(edits) - 1 + len(after))
        for said in turns(self, edits, role, text):
            self._say(*said)
        if edits[-1] != "D" and fault == "truncated":
            self.cost += TRUNCATED
        for said in turns(self, after, "", ""):
            self._say(*said)

    def _say(self, role: str, text: str) -> None:
        line = ("" if self.empty else "\n") + f"{role}:{text}"
        self.digest.update(line.encode("utf-8", "surrogatepass"))
        self.empty = False

    def row(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.faults | {
            "conv_id": self.conv, "gaps": gaps, "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit),
            "repaired_sha256": self.digest.hexdigest(),
        }


def turns(walk, edits: str, role: str, text: str | None) -> Iterator[tuple[str, str]]:
    """Role and text of each turn that the edits of a row leave or make; ``walk.state`` follows."""
    for edit in edits:
        if edit == "D":
            continue
        keeps_system = edit == "K" and role[:1] == "s"
        walk.state = 1 if keeps_system else _NEXT[walk.state]
        sound = "user" if walk.state == 2 else "assistant"
        yield (role if edit == "K" else sound), ("" if edit == "I" else text or "")


def figures(decided: DataFrame) -> DataFrame:
    """Per conversation of ``decide``: gaps between turns, faults, illegal neighbours, cost, audit letters, digest of the repaired text.

    The digest runs through a conversation in order, so one task reads it, as a stream: it holds a batch of rows, running
    figures and the audit letters, which are one cell of the result.
    """
    conv = decided.schema["conv_id"].dataType.simpleString()
    schema = (
        f"conv_id {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
        "repaired_sha256 string"
    )
    ordered = decided.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.mapInArrow(_Walk(), schema)


class _Turns:
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, spoken = type("Walk", (), {"state": 0})(), 0
        for batch in batches:
            took, said = [], []
            columns = (batch.column(c).to_pylist() for c in ("place", "edits", "after", "role", "text"))
            for n, (place, edits, after, role, text) in enumerate(zip(*columns, strict=True)):
                if place == 1:
                    walk.state, spoken = 0, 0
                for turn in [*turns(walk, edits, role, text), *turns(walk, after, "", "")]:
                    spoken += 1
                    took.append(n)
                    said.append((spoken, *turn))
            yield pa.record_batch(
                {
                    "conv_id": batch.column("conv_id").take(pa.array(took, pa.int64())), "turn": pa.array([s[0] for s in said], pa.int64()),
                    "role": pa.array([s[1] for s in said], pa.string()), "text": pa.array([s[2] for s in said], pa.string()),
                }
            )


def repaired(decided: DataFrame) -> DataFrame:
    """The repaired conversations ``conv_id, turn, role, text``, turns from 1."""
    conv = decided.schema["conv_id"].dataType.simpleString()
    ordered = decided.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.mapInArrow(_Turns(), f"conv_id {conv}, turn long, role string, text string")


def repair_report(conversations: DataFrame, decided: DataFrame) -> DataFrame:
    """``figures`` of ``decided`` for each ``conv_id`` of ``conversations``, with zeros where no row is left."""
    every = conversations.select(F.col("conv_id").alias("every_id")).distinct()
    found = figures(decided)
    joined = every.join(found, F.col("every_id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256().hexdigest())
    return joined.select(
        F.col("every_id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"),
    )

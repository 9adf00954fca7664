"""Chat formatting by event-sourced reconstruction.

A log of events, partitioned by conversation and sorted by sequence, is folded into final messages: deltas append to a
message, edits replace its text, and a regeneration throws away what the message held and all messages after it. The final
messages are rendered with a template whose control strings cannot be forged from inside a text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from consentry.session import durable

DELTA, EDIT, REGENERATE = "delta", "edit", "regenerate"


@dataclass(frozen=True)
class Template:
    """``head`` + role + ``after_role`` + text + ``end`` for every message.

    Inside roles and texts a backslash goes before every backslash and every control string, so no control string stands
    there bare, and ``unescape`` gives back the exact text.
    """

    head: str = "### "
    after_role: str = ":\n"
    end: str = "</turn>\n"
    trained_roles: tuple[str, ...] = ("assistant",)

    def escape(self, text: str, *more: str) -> str:
        marks = ("\\", self.head, self.end.rstrip("\n"), *more)
        return re.sub("|".join(map(re.escape, marks)), lambda m: "\\" + m[0], text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def render(self, role: str, text: str) -> tuple[str, int, int]:
        """The formatted message, and the range in it that the loss covers (empty if the role is not trained)."""
        before = self.head + self.escape(role, self.after_role) + self.after_role
        body = self.escape(text)
        trained = role in self.trained_roles
        return before + body + self.end, len(before), len(before) + (len(body) if trained else 0)

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """Roles and texts of a formatted piece; raises ValueError where it is not well formed."""
        out, at = [], 0
        while at < len(formatted):
            if not formatted.startswith(self.head, at):
                raise ValueError(f"no message starts at {at}")
            role, at = self._until(formatted, at + len(self.head), self.after_role)
            text, at = self._until(formatted, at, self.end)
            out.append((role, text))
        return out

    def _until(self, formatted: str, at: int, mark: str) -> tuple[str, int]:
        """The unescaped text up to the next unescaped ``mark``, and the place after it."""
        look = re.compile(r"\\.|" + re.escape(mark), re.DOTALL)
        place = at
        while found := look.search(formatted, place):
            if found[0] == mark:
                return self.unescape(formatted[at : found.start()]), found.end()
            place = found.end()
        raise ValueError(f"{mark!r} is missing after {at}")


def fold(events: DataFrame) -> DataFrame:
    """Final messages ``conv_id, message, role, text`` of an event log ``conv_id, seq, message, kind, role, text``.

    Events count in the order of ``seq``, then text. ``delta`` appends to its message, ``edit`` replaces the message's text so
    far, ``regenerate`` also withdraws every later message that was written before it. Unknown or null kinds are
    deltas. The role is that of the message's last event that has one, else empty. Null texts are empty. Rows without
    conversation or message belong to conversation or message null, like any other. Equal events all count.

    Texts are gathered per message only. What spans a conversation, the last regeneration before each message, is a running
    maximum over one small row per message.
    """
    kind = F.coalesce("kind", F.lit(DELTA))
    events = events.select(
        "conv_id", "message", F.coalesce("seq", F.lit(-(2**62))).cast("long").alias("seq"), kind.alias("kind"),
        "role", F.coalesce("text", F.lit("")).alias("text"),
    )
    last = lambda *kinds: F.max(F.when(F.col("kind").isin(*kinds), F.col("seq")))
    marks = events.groupBy(F.col("conv_id").alias("m_conv"), F.col("message").alias("m_message")).agg(
        last(EDIT, REGENERATE).alias("reset"), last(REGENERATE).alias("cut")
    )
    # A message is withdrawn up to the last regeneration of any message before it: a running maximum over small rows.
    before = Window.partitionBy("m_conv").orderBy("m_message").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumn("withdrawn", F.max("cut").over(before)).drop("cut")
    marks = marks.where(F.col("reset").isNotNull() | F.col("withdrawn").isNotNull())
    own = events.join(
        marks, F.col("conv_id").eqNullSafe(F.col("m_conv")) & F.col("message").eqNullSafe(F.col("m_message")), "left"
    ).drop("m_conv", "m_message")
    own = own.where(F.col("withdrawn").isNull() | (F.col("seq") > F.col("withdrawn")))
    own = own.where(F.col("reset").isNull() | (F.col("seq") >= F.col("reset")))
    # At the reset itself only the edit or regeneration counts, not deltas of the same number.
    own = own.where(F.col("reset").isNull() | (F.col("seq") > F.col("reset")) | F.col("kind").isin(EDIT, REGENERATE))
    parts = F.sort_array(F.collect_list(F.struct("seq", "text")))
    return own.groupBy("conv_id", "message").agg(
        F.coalesce(F.max_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))), F.lit("")).alias("role"),
        F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"),
    )


class _Render:
    def __init__(self, template: Template):
        self.template = template

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [
                self.template.render(role, text)
                for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)
            ]
            yield pa.record_batch(
                {
                    "conv_id": batch.column("conv_id"),
                    "message": batch.column("message"),
                    "formatted": pa.array([x[0] for x in done], pa.string()),
                    "loss_start": pa.array([x[1] for x in done], pa.int64()),
                    "loss_end": pa.array([x[2] for x in done], pa.int64()),
                }
            )


def format_chats(events: DataFrame, template: Template = Template()) -> DataFrame:
    """Formatted pieces ``conv_id, message, formatted, loss_start, loss_end``, one for each final message of ``fold``.

    A conversation is its pieces in the order of ``message``, joined without anything between. The loss covers code points
    ``loss_start`` to ``loss_end`` of a piece. An empty log gives no piece; a message without text a piece of marks only.
    """
    types = {f.name: f.dataType.simpleString() for f in events.schema}
    schema = f"conv_id {types['conv_id']}, message {types['message']}, formatted string, loss_start long, loss_end long"
    return fold(events).mapInArrow(_Render(template), schema)


class _ReadBack:
    """Walks pieces sorted by conversation and message, holding one piece and the running digests at a time."""

    SCHEMA = (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )

    def __init__(self, template: Template):
        self.template = template

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))
            for conv, formatted, start, end in zip(*columns, strict=True):
                if state is None or conv != now:
                    if state is not None:
                        done.append(self._row(now, state))
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in self.template.parse(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                loss = self.template.unescape(formatted[start:end])
                state[2] += len(loss)
                state[3].update(loss.encode("utf-8", "surrogatepass"))
                state[4] += len(formatted)
            if done:
                yield self._batch(done)
                done = []
        if state is not None:
            yield self._batch([self._row(now, state)])

    @staticmethod
    def _row(conv, state) -> dict:
        n, turns, chars, loss, formatted = state
        return {
            "conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars,
            "loss_sha256": loss.hexdigest(), "formatted_chars": formatted,
        }

    @staticmethod
    def _batch(rows: list[dict]) -> pa.RecordBatch:
        ints = {"conv_id", "n_turns", "loss_chars", "formatted_chars"}
        return pa.record_batch(
            {c: pa.array([r[c] for r in rows], pa.int64() if c in ints else pa.string()) for c in rows[0]}
        )


def read_back(pieces: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation, parsed from the formatted pieces: number of turns, sizes, and digests of turns and of trained text.

    A digest runs through a conversation in order, so a conversation is read by one task, but as a stream: the task holds
    one batch of pieces and a running hash, whatever the length of the conversation.
    """
    ordered = (
        pieces.select(F.col("conv_id").cast("long").alias("conv_id"), "message", "formatted", "loss_start", "loss_end")
        .repartition("conv_id").sortWithinPartitions("conv_id", "message")
    )
    return ordered.mapInArrow(_ReadBack(template), _ReadBack.SCHEMA)


def turns_as_events(turns: DataFrame, delta_chars: int = 2000) -> DataFrame:
    """The event log of stored turns ``conv_id, turn, role, text``: each text streamed in deltas of ``delta_chars``.

    Rows with equal conversation and turn are messages of their own, ordered by role, then by a digest of
    the text; a null turn comes first.
    """
    numbered = turns.select(
        "conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")
    ).groupBy("conv_id", "turn", "role", "digest").agg(F.first("text").alias("text"), F.count("*").alias("n"))
    copies = numbered.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    step = F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / delta_chars))
    return copies.withColumn("step", F.explode(step)).select(
        "conv_id", F.struct("turn", "role", "digest", "copy").alias("message"),
        F.col("step").cast("long").alias("seq"), F.lit(DELTA).alias("kind"), "role",
        F.substring("text", (F.col("step") * delta_chars + 1).cast("int"), F.lit(delta_chars)).alias("text"),
    )


def durable_pieces(events: DataFrame, template: Template = Template()) -> DataFrame:
    """The formatted pieces, written to the shared folder and read again."""
    return durable(format_chats(events, template), "chats")

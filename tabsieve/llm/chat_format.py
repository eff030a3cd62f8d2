"""Chat formatting: a finite-state machine over roles and a declarative template with loss flags; reversible."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.session import materialise

#: Characters after which a long conversation goes on in a new row.
ROW_CHARS = 1_000_000
#: Rows per Arrow batch.
OUT_ROWS = 1024


@dataclass(frozen=True)
class Turn:
    """Marks around a turn; with ``loss`` its text, not its marks, counts in the loss."""
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Turns by role, a turn for all other roles (``{}`` is the role), and the roles that may follow each state.

    A mark must hold a visible character, and no mark may begin inside another.
    """
    turns: dict[str, Turn]
    other: Turn
    follows: dict[str | None, tuple[str, ...]] = field(default_factory=dict)

    @cached_property
    def controls(self) -> re.Pattern:
        marks = [m for t in [*self.turns.values(), self.other] for m in (t.before, t.after)]
        names = sorted({m.split("{}")[0].strip() for m in marks}, key=len, reverse=True)
        return re.compile("|".join(f"{re.escape(m[0])}\\\\*{re.escape(m[1:])}" for m in names))

    @cached_property
    def openers(self) -> re.Pattern:
        head, tail = map(re.escape, self.other.before.split("{}"))
        known = "|".join(f"(?P<r{i}>{re.escape(t.before)})" for i, t in enumerate(self.turns.values()))
        return re.compile(f"{known}|{head}(?P<other>[^\\]]*){tail}")

    def escape(self, text: str) -> str:
        """Every control string gets one more backslash after its first character."""
        return self.controls.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self.controls.sub(lambda m: m[0][0] + m[0][2:] if m[0][1:2] == "\\" else m[0], text)

    def turn(self, role: str | None) -> Turn:
        known = self.turns.get(role)
        name = "%" if role is None else quote(role, safe="")
        return known or Turn(self.other.before.replace("{}", name), self.other.after, self.other.loss)

    def allowed(self, before: str | None, role: str | None) -> bool:
        """Whether ``role`` may follow ``before`` (None: the start)."""
        return role in self.follows.get(before, ())

    def read(self, text: str) -> Iterator[tuple[str | None, str]]:
        """Roles and texts back from a formatted text."""
        at, known = 0, list(self.turns.items())
        while at < len(text):
            found = self.openers.match(text, at)
            if not found:
                raise ValueError(f"no turn begins at character {at}")
            if found.lastgroup == "other":
                role, turn = None if found["other"] == "%" else unquote(found["other"]), self.other
            else:
                role, turn = known[int(found.lastgroup[1:])]
            end = text.index(turn.after, found.end())
            yield role, self.unescape(text[found.end():end])
            at = end + len(turn.after)


#: The default: instruction marks, any role may be read back, and user and assistant take turns.
INSTRUCT = Template(
    turns={"system": Turn("<<SYS>>", "<</SYS>>"), "user": Turn("[INST] ", " [/INST]"), "assistant": Turn("<s>", "</s>", loss=True)},
    other=Turn("[ROLE={}]", "[/ROLE]"),
    follows={None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
)


def _batches(rows: Iterator[tuple], schema: pa.Schema, least: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of some ``OUT_ROWS`` rows or ``least`` characters in the column ``text``."""
    out, chars, at = [], 0, schema.names.index("text") if "text" in schema.names else None

    def made():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    for row in rows:
        out.append(row)
        chars += len(row[at]) if at is not None else 0
        if len(out) >= OUT_ROWS or chars >= least:
            yield made()
            out, chars = [], 0
    if out:
        yield made()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        columns = batch.columns
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)


def format_conversations(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, template: Template = INSTRUCT) -> DataFrame:
    """``conv, part, seq, n_turns, text, segments, first_role, last_role, ordered, whole``: the formatted conversations, stored.

    A conversation is one row unless it is longer than ``ROW_CHARS`` or lies across two partitions; its rows
    then follow by ``(part, seq)``, and only a row with ``whole`` is known to be complete. ``segments`` cover the
    text, each with its loss flag. ``ordered`` tells that the state machine of ``template`` accepts each turn
    after the one before it within the row; ``first_role`` and ``last_role`` join rows (``conversation_facts``).

    Turns go by ``turn_col``, nulls first; turns of the same number by role, then text, and repeated rows are
    turns of their own. Rows are dealt by ranges of the whole order, so a conversation with any share of all
    turns is cut over many tasks, each of which holds one row at a time. Null texts are empty; a null or
    unknown role is written as such and never accepted; null conversations are one conversation; an empty
    table gives an empty table; other columns are ignored.
    """
    kinds = df.schema[conv_col].dataType.simpleString()
    turns = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
                      F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Rows that agree in all of these are equal, so their order does not matter; the number only lets ranges part them.
    order = [F.col("conv"), F.col("turn"), F.col("role"), F.md5("text"), F.monotonically_increasing_id()]
    turns = turns.select("*", *[c.alias(f"_k{i}") for i, c in enumerate(order[3:])])
    keys = ["conv", "turn", "role", "_k0", "_k1"]
    dealt = turns.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", "role", "text", F.spark_partition_id().alias("part"))
    fields = df.sparkSession.createDataFrame([], f"conv {kinds}, part int, seq long, n_turns long, text string, segments array<struct<start:long,end:long,loss:boolean>>, "
                                                 "first_role string, last_role string, ordered boolean, whole boolean").schema

    def pieces(batches):
        seq, state = 0, None

        def closed(ends: bool):
            return (state["conv"], state["part"], seq, state["n"], "".join(state["texts"]), state["segments"], state["first"], state["last"],
                    state["ordered"], ends and state["begins"])

        for conv, role, text, part in _rows(batches):
            same = state is not None and state["conv"] == conv
            if state is not None and (not same or state["chars"] >= ROW_CHARS):
                yield closed(not same)
                seq += 1
                state = None
            if state is None:
                # The first conversation of a task may have begun in another one, the last may go on there.
                state = {"conv": conv, "part": part, "n": 0, "texts": [], "segments": [], "chars": 0, "first": role, "ordered": True, "begins": seq > 0 and not same}
            elif not template.allowed(state["last"], role) or state["last"] is None:
                state["ordered"] = False
            turn, at = template.turn(role), state["chars"]
            for piece, loss in ((turn.before, False), (template.escape(text), turn.loss), (turn.after, False)):
                state["texts"].append(piece)
                state["segments"].append({"start": at, "end": at + len(piece), "loss": loss})
                at += len(piece)
            state |= {"chars": at, "last": role, "n": state["n"] + 1}
        if state is not None:
            yield closed(False)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        yield from _batches(pieces(batches), to_arrow_schema(fields))

    return materialise(dealt.mapInArrow(run, fields))


def conversation_facts(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Facts read back from the formatted rows: ``conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, accepted``.

    ``accepted``: the machine accepts the whole conversation. A digest reads a conversation in order, so rows
    that are not ``whole`` are brought together by conversation and streamed, one row in memory at a time.
    """
    kind = formatted.schema["conv"].dataType.simpleString()
    fields = formatted.sparkSession.createDataFrame([], f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                                        "formatted_chars long, accepted boolean").schema

    def facts(batches):
        state = None

        def closed():
            return (state["conv"], state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"], state["accepted"])

        for conv, text, segments, first, last, ordered, whole in _rows(batches):
            if state is not None and (whole or state["whole"] or state["conv"] != conv):
                yield closed()
                state = None
            if state is None:
                state = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0, "last": None,
                         "accepted": True, "whole": whole}
            state["accepted"] &= ordered and template.allowed(state["last"], first) and (state["n"] == 0 or state["last"] is not None)
            for role, body in template.read(text):
                state["turns"].update(f"{role or ''}\n{body}\n".encode())
                state["n"] += 1
            for s in segments:
                if s["loss"]:
                    body = template.unescape(text[s["start"]:s["end"]])
                    state["loss"].update(body.encode())
                    state["loss_chars"] += len(body)
            state |= {"chars": state["chars"] + len(text), "last": last}
        if state is not None:
            yield closed()

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        yield from _batches(facts(batches), to_arrow_schema(fields))

    columns = ["conv", "text", "segments", "first_role", "last_role", "ordered", "whole"]
    rest = formatted.where("NOT whole").repartition("conv").sortWithinPartitions("conv", "part", "seq")
    return formatted.where("whole").select(*columns).mapInArrow(run, fields).unionByName(rest.select(*columns).mapInArrow(run, fields))

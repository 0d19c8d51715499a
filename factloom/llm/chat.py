"""Chat formatting: a finite-state machine over roles, a declarative template, segments with loss flags.

A template names its marks, the order of roles that it expects and the roles
under loss. Each turn gives three segments: the opening with the role, the text,
the closing; only a text of a role under loss carries the loss flag. Inside texts and roles,
every control string gets a backslash after its first character (one more, where
backslashes stand there already), so no text can pass for a mark and the change
can be undone exactly.

Conversations stream through sorted partitions with hashes carried from batch to
batch, so even one very long conversation needs no more memory than one turn.

Defined results: null roles and texts count as empty; turns with equal numbers
are ordered by role and text; roles out of order, or none that the template
knows, are formatted all the same and make the conversation invalid; repeated
rows are repeated turns; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ship_by_value
from .workspace import small_batches

ship_by_value(__name__)


@dataclass(frozen=True)
class Template:
    turn: str = "<|turn|>"
    text: str = "<|text|>"
    end: str = "<|end|>\n"
    #: Further strings that other templates treat as control strings.
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
    loss: tuple[str, ...] = ("assistant",)
    #: Which roles may follow each state; "" is the beginning.
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )

    def firsts(self) -> str:
        strings = {self.turn, self.text, self.end.strip(), *self.foreign}
        return "[" + re.escape("".join(sorted({s[0] for s in strings}))) + "]"


class Escape:
    """Adds or removes one backslash behind the first character of each control string."""

    def __init__(self, template: Template):
        self._add = re.compile(rf"({template.firsts()}\\*)(?={_loosen(template)})")
        self._remove = re.compile(rf"({template.firsts()}\\*)\\(?={_loosen(template)})")

    def add(self, text: str) -> str:
        return self._add.sub(lambda m: m[1] + "\\", text)

    def remove(self, text: str) -> str:
        return self._remove.sub(lambda m: m[1], text)


def _loosen(template: Template) -> str:
    """The rests of control strings, where a first character inside a rest may carry backslashes too."""
    first = template.firsts()
    strings = sorted({template.turn, template.text, template.end.strip(), *template.foreign}, key=lambda s: (-len(s), s))
    return "(?:" + "|".join("".join(re.escape(c) + (r"\\*" if re.match(first, c) else "") for c in s[1:]) for s in strings) + ")"


def _formatter(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (conv_id, role, text), sorted by conversation and turn, give segments."""
        escape, now, begun, state, number = Escape(template), None, False, "", 0
        for batch in batches:
            out = []
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or conv != now:
                    now, begun, state, number = conv, True, "", 0
                allowed = role in template.follows.get(state, ()) if state is not None else False
                state = role if allowed else None
                parts = ((template.turn + escape.add(role) + template.text, False), (escape.add(text), role in template.loss), (template.end, False))
                for piece, loss in parts:
                    out.append((conv, number, piece, loss, allowed))
                    number += 1
            if out:
                a = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(a, kinds, strict=True)], ["conv_id", "segment", "text", "loss", "in_order"])

    return run


class _Reader:
    """Reads formatted output back, piece by piece."""

    def __init__(self, template: Template, escape: Escape):
        self.template, self.escape = template, escape
        self.held, self.role, self.turns, self.chars, self.loss_chars, self.valid = "", None, 0, 0, 0, True
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def take(self, piece: str, loss: bool, in_order: bool) -> None:
        t = self.template
        self.chars += len(piece)
        self.valid &= in_order
        if loss:
            plain = self.escape.remove(piece)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())
        self.held += piece
        while True:
            if self.role is None:
                if not self.held.startswith(t.turn) or (at := self.held.find(t.text)) < 0:
                    return
                self.role, self.held = self.held[len(t.turn) : at], self.held[at + len(t.text) :]
            if (at := self.held.find(t.end)) < 0:
                return
            self.all.update(f"{self.escape.remove(self.role)}\n{self.escape.remove(self.held[:at])}\n".encode())
            self.turns += 1
            self.role, self.held = None, self.held[at + len(t.end) :]


def _read_back(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments, sorted by conversation and number, give a row of digests per conversation."""
        escape, now, reader = Escape(template), None, None

        def row(conv, r: _Reader) -> tuple:
            return conv, r.turns, r.all.hexdigest(), r.loss_chars, r.loss.hexdigest(), r.chars, r.valid and not r.held

        def emit(rows: list) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            rows = []
            for conv, piece, loss, in_order in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if reader is None or conv != now:
                    if reader is not None:
                        rows.append(row(now, reader))
                    now, reader = conv, _Reader(template, escape)
                reader.take(piece, loss, in_order)
            if rows:
                yield emit(rows)
        if reader is not None:
            yield emit([row(now, reader)])

    return run


SEGMENTS = "conv_id long, segment long, text string, loss boolean, in_order boolean"


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments (conv_id, segment, text, loss, in_order) of conversations (conv_id, turn, role, text); a conversation's stand together, in order."""
    small_batches(turns.sparkSession, 2048)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    placed = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return placed.select("conv_id", "role", "text").mapInArrow(_formatter(template or Template()), SEGMENTS)


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of each conversation from its segments, in whatever order and partitions they come."""
    shape = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    placed = segments.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return placed.select("conv_id", "text", "loss", "in_order").mapInArrow(_read_back(template or Template()), shape)

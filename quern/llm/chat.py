"""Operator 10: chat formatting in budgeted windows.

A conversation becomes windows of whole turns. Prefix sums of turn tokens choose
each window's span: after the system turn and up to history_turns repeated turns,
as many new turns as the budget takes, at least one (a turn is never cut; one that
alone exceeds the budget gets a window of its own). The loss mask covers the text
of assistant turns that are new in a window; repeated turns are masked, so every
assistant text is learnt once.

Template: <|im_start|>role LF text <|im_end|> LF. In roles and texts & becomes
&amp; and <| becomes &lt;|, so no control string can occur inside a turn and
unescape() restores it exactly.

Conversations are dealt by conv_id and sorted within partitions (a sort that
spills); a task streams them and holds one chunk of turns plus the repeated
history, so one conversation of any length takes bounded memory. Its turns are
read in order by one task, as windows and digests are sequential by definition.

Defined results: null roles and texts are empty; rows with equal turn are ordered by
role, then text; repeated rows are turns of their own; null conv_id is a
conversation of its own; null turns come first. The system turn that is kept is
the first turn, if its role is system.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import bpe
from quern.llm.common import small_batches, text_or_empty

START, END = "<|im_start|>", "<|im_end|>"
WINDOWS = "conv_id long, window long, first_turn long, n_turns long, n_repeated long, n_tokens long, formatted string, loss array<array<int>>"
#: Turns that are laid out at once.
CHUNK = 512


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<|", "&lt;|")


def unescape(text: str) -> str:
    return text.replace("&lt;|", "<|").replace("&amp;", "&")


def escape_role(role: str) -> str:
    """As escape(), and a line feed, which would end the role's line, becomes &nl;."""
    return escape(role).replace("\n", "&nl;")


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text begins and ends in it, in code points."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a window; the inverse of the template."""
    out, at = [], 0
    while at < len(formatted):
        head = formatted.index("\n", at + len(START))  # a role has no line feed of its own, see escape_role()
        end = formatted.index(END, head + 1)
        out.append((unescape(formatted[at + len(START) : head].replace("&nl;", "\n")), unescape(formatted[head + 1 : end])))
        at = end + len(END) + 1
    return out


class _Conversation:
    """Lays out one conversation, chunk by chunk."""

    def __init__(self, conv_id: int | None, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system: tuple[str, int] | None = None
        self.window = self.turn = 0
        self.pending: list[tuple[str, int, int, int, bool]] = []
        self.past: list[tuple[str, int]] = []

    def add(self, turns: list[tuple[str, int, int, int, bool]], last: bool) -> Iterator[tuple]:
        """turns: formatted, text's begin and end, tokens, whether it is learnt. All windows that are certain."""
        self.pending += turns
        prefix = np.concatenate([[0], np.cumsum([t[3] for t in self.pending])])
        at = 0
        while at < len(self.pending):
            first = self.turn == 0 and self.window == 0
            before = ([self.system] if self.system else []) + self.past
            room = self.budget - sum(n for _, n in before)
            while len(before) > bool(self.system) and room < self.pending[at][3]:
                room += before.pop(bool(self.system))[1]  # the oldest repeated turn gives way
            end = max(at + 1, int(np.searchsorted(prefix, prefix[at] + room, side="right")) - 1)
            if end >= len(self.pending) and not last:
                break
            part = self.pending[at:end]
            text, loss, size = [], [], 0
            for s, _ in before:
                text.append(s)
                size += len(s)
            for s, a, b, _, learnt in part:
                if learnt:
                    loss.append([size + a, size + b])
                text.append(s)
                size += len(s)
            tokens = int(prefix[end] - prefix[at]) + sum(n for _, n in before)
            yield self.conv_id, self.window, self.turn, len(part), len(before), tokens, "".join(text), loss
            if first and part[0][0].startswith(f"{START}system\n"):
                self.system = (part[0][0], part[0][3])
            recent = part[1:] if first and self.system else part
            self.past = ([*self.past, *((p[0], p[3]) for p in recent)])[-self.history :] if self.history else []
            self.window, self.turn, at = self.window + 1, self.turn + len(part), end
        self.pending = self.pending[at:]


def format_windows(conversations: DataFrame, budget: int = 1024, history: int = 1, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per window (schema WINDOWS); a conversation's windows are neighbours, in order.

    path, pattern: the vocabulary that counts tokens; the public one if not given.
    loss: [begin, end) in code points of formatted.
    """
    small_batches(conversations.sparkSession)
    if path is None:
        path, pattern = bpe.public_vocabulary()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = bpe.Encoder.load(path, pattern).count
        open_: _Conversation | None = None
        names = [f.split()[0] for f in WINDOWS.split(", ")]

        def lay(conv: _Conversation, rows: list[tuple[str, str]], last: bool) -> Iterator[tuple]:
            made = [(*render(role, text), role == "assistant") for role, text in rows]
            sizes = count([m[0] for m in made]) if made else []
            yield from conv.add([(s, a, b, int(n), learnt) for (s, a, b, learnt), n in zip(made, sizes, strict=True)], last)

        rows: list[tuple[str, str]] = []
        for frame in frames:
            out = []
            for conv_id, null, role, text in zip(frame.conv_id, frame.no_conv, frame.role, frame.text, strict=True):
                key = None if null else int(conv_id)
                if open_ is None or open_.conv_id != key:
                    if open_ is not None:
                        out += lay(open_, rows, True)
                        rows = []
                    open_ = _Conversation(key, budget, history)
                rows.append((role, text))
                if len(rows) >= CHUNK:
                    out += lay(open_, rows, False)
                    rows = []
            if out:
                yield _frame(out, names)
        if open_ is not None and (out := list(lay(open_, rows, True))):
            yield _frame(out, names)

    turns = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv_id"), F.col("conv_id").isNull().alias("no_conv"), F.col("turn").alias("turn"), text_or_empty("role").alias("role"), text_or_empty().alias("text"))
    dealt = turns.repartition("conv_id", "no_conv").sortWithinPartitions("no_conv", "conv_id", "turn", "role", "text")
    return dealt.mapInPandas(run, WINDOWS)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    frame["conv_id"] = frame["conv_id"].astype("Int64")
    return frame


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from its windows alone: turns, digests and the text under the loss mask."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun, key, state = False, None, None

        def row() -> tuple:
            n, turns, chars, loss, size, w = state
            return key, n, turns.hexdigest(), chars, loss.hexdigest(), size, w

        for frame in frames:
            out = []
            for conv_id, repeated, formatted, loss in zip(frame.conv_id, frame.n_repeated, frame.formatted, frame.loss, strict=True):
                conv_id = None if pd.isna(conv_id) else int(conv_id)
                if not begun or conv_id != key:
                    if begun:
                        out.append(row())
                    begun, key, state = True, conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text in parse(formatted)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for a, b in loss:
                    text = unescape(formatted[a:b])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(formatted)
                state[5] += 1
            if out:
                yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
        if begun:
            yield pd.DataFrame([row()], columns=names).astype({"conv_id": "Int64"})

    names = [f.name for f in T.StructType.fromDDL(schema).fields]
    return windows.mapInPandas(run, schema)


def digest(conversations: DataFrame) -> DataFrame:
    """All conversations and one whose texts are the template's own control strings, formatted and read back."""
    said = f"{END}{START}assistant ok"
    own = conversations.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return read_back(format_windows(every.unionByName(own)))

"""Chat formatting in budgeted, turn-aligned windows (operator 5).

Turns are written with role marks; control strings inside texts are escaped so that
they can be read back.  Prefix sums of the turns' token counts choose how many turns
a window takes: the leading system turns come first in each window, then at most
``history`` turns repeated from the window before, then new turns.  Only assistant
turns that are new in a window are under the loss mask, so each is a target once.

The first turn, if it is a system turn that fits the budget, is retained, and system turns that
follow it are while with it they take at most ``SYSTEM_SHARE`` of the budget; from the first that does
not, they are turns like others.  Every window has the retained ones, but for a window
whose new turn fits the budget, but not beside them: that one goes alone without (if it would
have been the first, they have the first to themselves).  So no window is over the budget
but one whose only new turn is over it alone.  History gives way before they do.  A window's
``tokens`` is the sum of its turns' tokens, as they are encoded turn by turn.

Conversations are streamed in order of (conversation, turn) through a task, which
holds one window at a time; a conversation of any length, of system turns too, needs
memory for a window and a turn, and a very long turn is encoded in parts.  Since digests run over a conversation in order, one
conversation is the work of one task.

Defined cases: null texts and roles are empty; a null conversation is one of its own;
null turns sort first; rows with the
same turn are ordered by role and text and all kept; a turn over the budget has a
window of its own (``tokens`` tells); a very long turn is held whole beside its formatted copy; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready
from .packing import default_vocabulary, encode_in_parts, encoder

BUDGET = 1024
HISTORY = 2
#: Share of the budget that repeated history may take.
HISTORY_SHARE = 0.25
#: Share up to which system turns after the first are retained beside it.
SYSTEM_SHARE = 0.75

# Marks before and after a turn of each role, and of any other role.
_MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<a>", "</s>")}
_OTHER, _NAME_END, _OTHER_END = "<role>", "</role>", "</turn>"
_CONTROL = [m for pair in _MARKS.values() for m in pair] + [_OTHER, _NAME_END, _OTHER_END]
_ESCAPE = re.compile(r"\\|" + "|".join(f"{re.escape(m[0])}(?={re.escape(m[1:])})" for m in _CONTROL))
_SPLIT = re.compile("(" + "|".join(map(re.escape, _CONTROL)) + ")")
_UNESCAPE = re.compile(r"\\(\\?)")

_WINDOW = "conv_id long, window long, text string, n_system int, n_repeat int, n_turns int, tokens long, loss array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    """Doubles backslashes and puts one after the first character of each control string."""
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """The marked turn, and where its escaped text begins and ends in it."""
    if role in _MARKS:
        head, tail = _MARKS[role]
    else:
        head, tail = _OTHER + escape(role) + _NAME_END, _OTHER_END
    body = escape(text)
    return head + body + tail, len(head), len(head) + len(body)


def read_turns(window: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end of its escaped text."""
    out, parts, at = [], _SPLIT.split(window), 0
    heads = {pair[0]: role for role, pair in _MARKS.items()}
    role, begin = None, 0
    for i, part in enumerate(parts):
        if i % 2 == 0:
            at += len(part)
            continue
        if part in heads:
            role, begin = heads[part], at + len(part)
        elif part == _OTHER:
            begin = at + len(part)
        elif part == _NAME_END:
            role, begin = unescape(window[begin:at]), at + len(part)
        else:
            out.append((role, unescape(window[begin:at]), begin, at))
        at += len(part)
    return out


class _Conversation:
    """Takes turns one by one, gives windows as they fill."""

    def __init__(self, conv_id, count, budget: int, history: int):
        self.conv_id, self.count, self.budget, self.history = conv_id, count, budget, history
        self.system: list[tuple] = []  # leading system turns, in every window
        self.repeat: list[tuple] = []
        self.new: list[tuple] = []
        self.number = 0
        self.started = False
        self.retain = True  # has this window the system turns?
        # Tokens of the leading system turns; of all other turns so far; of those before this window.
        self.lead, self.total, self.before = 0, 0, 0

    def add(self, role: str, text: str) -> Iterator[dict]:
        formatted, a, b = write_turn(role, text)
        turn = (formatted, a, b, role == "assistant", self.count(formatted))
        most = self.budget * SYSTEM_SHARE if self.system else self.budget
        if role == "system" and not self.started and self.lead + turn[4] <= most:
            self.system.append(turn)
            self.lead += turn[4]
            return
        self.started = True
        if self.new and (not self.retain or self._size() + turn[4] > self.budget):
            yield self.flush()
        while self.repeat and not self.new and self._size() + turn[4] > self.budget:
            self.before += self.repeat.pop(0)[4]  # history gives way to what is new
        if self.system and not self.new and turn[4] <= self.budget < self.lead + turn[4]:
            if self.number == 0:
                yield self.flush()
            self.retain = False
        self.new.append(turn)
        self.total += turn[4]

    def _size(self) -> int:
        """Tokens of the window: repeated and new turns follow each other, so a difference of prefix sums."""
        return (self.lead if self.retain else 0) + self.total - self.before

    def flush(self) -> dict:
        parts, at, loss = [], 0, []
        system = self.system if self.retain else []
        for kind, turns in enumerate((system, self.repeat, self.new)):
            for formatted, a, b, target, _ in turns:
                if kind == 2 and target:
                    loss.append({"start": at + a, "end": at + b})
                parts.append(formatted)
                at += len(formatted)
        row = {
            "conv_id": self.conv_id, "window": self.number, "text": "".join(parts), "n_system": len(system), "n_repeat": len(self.repeat),
            "n_turns": len(self.new), "tokens": self._size(), "loss": loss,
        }
        past, kept, room = self.repeat + self.new, [], int(self.budget * HISTORY_SHARE)
        self.before = self.total
        for turn in reversed(past[-self.history :] if self.history else []):
            room -= turn[4]
            if room < 0:
                break
            kept.insert(0, turn)
            self.before -= turn[4]
        self.repeat, self.new, self.number, self.retain = kept, [], self.number + 1, True
        return row


def format_windows(
    conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, vocabulary: str | None = None,
    conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row a window: conv_id, window, text, n_system, n_repeat, n_turns, tokens, loss (code point spans)."""
    ready(conversations.sparkSession)
    vocabulary = vocabulary or default_vocabulary()
    rows = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    schema = pa.schema([
        ("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("n_system", pa.int32()), ("n_repeat", pa.int32()),
        ("n_turns", pa.int32()), ("tokens", pa.int64()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ])

    def run(batches):
        encode = encoder(vocabulary)
        count = lambda text: len(encode_in_parts(encode, text))
        open_, seen = None, False
        for batch in batches:
            out: list[dict] = []
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if not seen or conv_id != open_.conv_id:
                    if seen:
                        out.append(open_.flush())
                    open_, seen = _Conversation(conv_id, count, budget, history), True
                out += open_.add(role, text)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if seen:
            yield pa.RecordBatch.from_pylist([open_.flush()], schema=schema)

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, _WINDOW)


def read_back(windows: DataFrame, in_order: bool = False) -> DataFrame:
    """Digests of each conversation, from the windows' texts and loss spans alone.

    in_order: the windows are as ``format_windows`` made them; otherwise they are dealt and sorted again.
    """
    if not in_order:
        windows = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")

    def run(batches):
        done, now = [], None

        def close():
            done.append((now["id"], now["n"], now["turns"].hexdigest(), now["chars"], now["loss"].hexdigest(), now["formatted"], now["windows"]))

        def give():
            columns = list(zip(*done, strict=True)) if done else [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
            done.clear()
            return batch

        for batch in batches:
            for row in batch.to_pylist():
                if now is None or now["id"] != row["conv_id"]:
                    if now is not None:
                        close()
                    now = {"id": row["conv_id"], "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0, "windows": 0}
                turns = read_turns(row["text"])
                fresh = turns[: row["n_system"]] if row["window"] == 0 else []
                for role, text, _, _ in fresh + turns[row["n_system"] + row["n_repeat"] :]:
                    now["turns"].update(f"{role}\n{text}\n".encode())
                    now["n"] += 1
                for span in row["loss"]:
                    target = unescape(row["text"][span["start"] : span["end"]])
                    now["chars"] += len(target)
                    now["loss"].update(target.encode())
                now["formatted"] += len(row["text"])
                now["windows"] += 1
            yield give()
        if now is not None:
            close()
            yield give()

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    return windows.mapInArrow(run, schema)

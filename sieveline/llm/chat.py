"""Chat formatting into budgeted windows of whole turns, with a reversible escape and a loss mask.

Template: `<|im_start|>role\\ntext<|im_end|>\\n` for each turn. In texts and roles a backslash is put between `<` (and any
backslashes after it) and `|`, so no text holds `<|`, and taking one backslash away gives the text back; in roles,
backslashes and newlines are written as `\\\\` and `\\n` first.

Windows: running sums of the turns' tokens choose spans of whole turns whose tokens, with those of the retained system
turn and of the repeated history, stay within the budget. A window repeats the conversation's first turn if it is a
system turn, then the last turns before its span as far as `history` tokens reach, then its span. The loss mask covers
the texts of the assistant turns of the span only, so each is a target exactly once; repeated ones are masked.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from sieveline.llm.common import prepare

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens of a rendered turn beyond those of its text: markers and role.
FRAME_TOKENS = 4
#: What counts as a token of a text: a word or a single other character.
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"

WINDOW = ["window", "first_turn", "last_turn", "repeated", "tokens", "over_budget", "text", "loss"]


def _windows_of(kind: DataType) -> str:
    return f"conv_id {kind.simpleString()}, window int, first_turn int, last_turn int, repeated int, tokens long, over_budget boolean, text string, loss array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    return text if "<" not in text or "|" not in text else re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return text if "<\\" not in text else re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Windows:
    """Windows of one conversation, whose turns come in order; what it holds is the open window and the history.

    The history of a window is the longest run of turns before it within `history` tokens, the system turn aside, less
    the oldest turns that the budget has no room for; the window then takes turns while they stay within the budget. A
    turn that exceeds the budget alone makes a window of its own, without history.
    """

    def __init__(self, budget: int, history: int):
        self.budget, self.limit = budget, history
        self.system: tuple | None = None
        self.past: list[tuple] = []  # turns (role, text, tokens) before the open window that the next may repeat
        self.open: list[tuple] = []
        self.n = self.turns = 0

    def add(self, role: str, text: str, tokens: int):
        """The window that this turn closes, or None."""
        done = None
        if self.open and self.held + tokens > self.budget:
            done = self.close()
        if not self.open:
            self.first = self.turns
            self.repeats = list(self.past)
            kept = self.system[2] if self.system and self.turns else 0
            self.held = kept + sum(t[2] for t in self.repeats) + tokens
            while self.repeats and self.held > self.budget:
                self.held -= self.repeats.pop(0)[2]
        else:
            self.held += tokens
        turn = (role, text, tokens)
        self.open.append(turn)
        if not self.turns and role == "system":
            self.system = turn
        self.turns += 1
        return done

    def close(self):
        """(window, first, last, repeated, tokens, over budget, text, loss) of the open window; loss as pairs."""
        if not self.open:
            return None
        before = ([self.system] if self.system and self.first else []) + self.repeats
        text, at, loss = [], 0, []
        for i, (role, body, _) in enumerate(before + self.open):
            head, body = f"{START}{escape_role(role)}\n", escape(body)
            if i >= len(before) and role == "assistant":
                loss.append((at + len(head), at + len(head) + len(body)))
            text.append(f"{head}{body}{END}\n")
            at += len(text[-1])
        out = (self.n, self.first, self.turns, len(before), self.held, self.held > self.budget, "".join(text), loss)
        past = self.past + [t for t in self.open if t is not self.system]
        size = 0
        for i in range(len(past) - 1, -1, -1):
            size += past[i][2]
            if size > self.limit:
                past = past[i + 1 :]
                break
        self.past, self.open, self.n = past, [], self.n + 1
        return out


def _format(budget: int, history: int, kind: pa.DataType):
    def pack(rows: list[tuple]) -> pa.RecordBatch:
        conv, n, first, last, repeated, tokens, over, text, loss = zip(*rows) if rows else [[]] * 9
        pairs = np.array([p for x in loss for p in x], np.int32).reshape(-1, 2)
        struct = pa.StructArray.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["start", "end"])
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, loss)]), pa.int32()), struct)
        whole = [pa.array(x, pa.int32()) for x in (n, first, last, repeated)]
        return pa.RecordBatch.from_arrays([pa.array(conv, kind), *whole, pa.array(tokens, pa.int64()), pa.array(over, pa.bool_()), pa.array(text, pa.string()), lists], ["conv_id", *WINDOW])

    def run(batches):
        chat, now = None, None
        for batch in batches:
            rows = []
            for conv, role, text, tokens in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "tokens"))):
                if chat is None or conv != now:
                    if chat is not None:
                        rows.append((now, *chat.close()))
                    chat, now = Windows(budget, history), conv
                done = chat.add(role, text, tokens)
                if done is not None:
                    rows.append((now, *done))
            yield pack(rows)
        if chat is not None:
            yield pack([(now, *chat.close())])

    return run


def format_chats(turns: DataFrame, budget: int = 512, history: int = 128) -> DataFrame:
    """Windows (conv_id, window, first_turn, last_turn, repeated, tokens, over_budget, text, loss) of all conversations
    of turns(conv_id, turn, role, text, ...); loss holds character ranges of text (code points, end exclusive).

    Turns come by turn, then role, then text (so repeated rows are repeated turns); null turn numbers come first. Null
    role or text: empty. A null conv_id is a conversation of its own. An empty text is an empty target. Windows over
    budget hold one turn (with the system turn). conv_id keeps its type, turn is a whole number. Extra columns are
    ignored; an empty table gives no windows.

    The turns of a conversation are streamed through one task, in order; what is held of it is one window and its
    history, so neither a conversation of many turns nor a very long text (a window of its own) is more than that.
    """
    prepare(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tokens = (F.regexp_count(text, F.lit(TOKEN)) + FRAME_TOKENS).cast("long")
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"), tokens.alias("tokens"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(_format(budget, history, _arrow(kind)), _windows_of(kind))


def _arrow(kind: DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def turns_of(text: str) -> list[tuple[str, int, int]]:
    """(escaped role, begin, end) of each turn of a formatted text; the escaped text of the turn is text[begin:end]."""
    out, at = [], 0
    while at < len(text):
        end = text.find(END + "\n", at)
        begin = text.find("\n", at, end) + 1
        if end < 0 or begin <= 0 or not text.startswith(START, at):
            raise ValueError(f"unreadable at {at}")
        out.append((text[at + len(START) : begin - 1], begin, end))
        at = end + len(END) + 1
    return out


def _read(batch: pa.RecordBatch):
    """(conv_id, window, text, turns (role, text, target), first) of each window; repeated turns are left out."""
    loss = batch.column("loss")
    ends, begins = loss.offsets.to_numpy(), loss.values.field("start").to_numpy()
    ranges = list(zip(begins.tolist(), loss.values.field("end").to_numpy().tolist()))
    columns = (batch.column(c).to_pylist() for c in ("conv_id", "window", "text", "repeated", "first_turn"))
    for i, (conv, w, text, skip, first) in enumerate(zip(*columns)):
        under = set(ranges[ends[i] : ends[i + 1]])
        turns = []
        for role, begin, end in turns_of(text)[skip:]:
            body = unescape(text[begin:end])
            turns.append((unescape_role(role), body, body if (begin, end) in under else None))
        yield conv, w, text, turns, first


def read_windows(windows: DataFrame) -> DataFrame:
    """(conv_id, window, turn, role, text, target): the turns of the spans, parsed back from the formatted text.

    Repeated turns are left out; target is the unescaped text under the loss mask, null where there is none."""
    kind = windows.schema["conv_id"].dataType
    names = ["conv_id", "window", "turn", "role", "text", "target"]
    kinds = [_arrow(kind), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            rows = [(conv, w, first + i, *turn) for conv, w, _, turns, first in _read(batch) for i, turn in enumerate(turns)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names)

    return windows.mapInArrow(run, f"conv_id {kind.simpleString()}, window int, turn int, role string, text string, target string")


DIGEST = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]


def digest(windows: DataFrame, placed: bool = False) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows) of each conversation, all
    read back from the formatted windows, which are streamed in order.

    placed: the windows lie as format_chats gives them, a conversation in one partition and in order; others are
    shuffled first."""
    if not placed:
        windows = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    kind = windows.schema["conv_id"].dataType
    kinds = [_arrow(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches):
        def row():
            return (now, n, whole.hexdigest(), chars, target.hexdigest(), length, count)

        def pack(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], ["conv_id", *DIGEST])

        whole = None
        for batch in batches:
            rows = []
            for conv, _, text, turns, _ in _read(batch):
                if whole is None or conv != now:
                    if whole is not None:
                        rows.append(row())
                    now, whole, target, n, chars, length, count = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
                for role, body, loss in turns:
                    whole.update(f"{role}\n{body}\n".encode())
                    if loss is not None:
                        target.update(loss.encode())
                        chars += len(loss)
                n, length, count = n + len(turns), length + len(text), count + 1
            yield pack(rows)
        if whole is not None:
            yield pack([row()])

    return windows.mapInArrow(run, f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")

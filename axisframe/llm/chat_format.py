"""Chat formatting in budgeted windows.

A conversation's turns are cut into windows of a token budget at turn ends, found from prefix sums of the
turns' tokens. Every window begins with the system turn and a limited history repeated from before; each
turn is new in exactly one window. The loss mask covers the texts of new assistant turns only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisframe.llm._store import bounded_batches, cut

# fixed values of the template: "### role: text</turn>\n"; inside roles and texts its control strings are broken up
OPEN, MID, CLOSE = "### ", ": ", "</turn>\n"
_CONTROL = re.compile(r"\\|#{3,}|<(?=/turn>)")
_ESCAPED = re.compile(r"\\([\\hlc])")
_ROLE_CONTROL = re.compile(r"[\\:#<]")
_CODE = {"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c"}
_PLAIN = {"\\": "\\", "h": "#", "l": "<", "c": ":"}
_TURN = re.compile(r"### ((?:\\[\\hlc]|[^\\:#<])*): ((?:\\[\\hl]|(?!</turn>)[^\\])*)</turn>\n", re.S)
_PIECE = re.compile(r"\w+|[^\w\s]")

BUDGET, HISTORY = 1024, 256
WINDOW = pa.schema(
    [("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("n_tokens", pa.int64()), ("n_repeated", pa.int64()), ("n_new", pa.int64()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]
)


def escape(text: str) -> str:
    """The text with backslashes doubled, and without any of the template's control strings."""
    return _CONTROL.sub(lambda m: "".join(_CODE[c] for c in m[0]), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[1]], text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its escaped text starts and stops in it."""
    head = OPEN + _ROLE_CONTROL.sub(lambda m: _CODE[m[0]], role) + MID
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of a formatted window; raises ValueError if anything lies between turns."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def count_pieces(turns: list[str]) -> list[int]:
    """Default token counts of formatted turns: words and single other characters."""
    return [sum(1 for _ in _PIECE.finditer(t)) for t in turns]


def tokenizer_counts(path: str) -> Callable[[list[str]], list[int]]:
    """Token counts by a tokenizer's file, loaded once in each task."""
    loaded: list = []

    def count(turns: list[str]) -> list[int]:
        if not loaded:
            from tokenizers import Tokenizer

            loaded.append(Tokenizer.from_file(path))
        return [len(e.ids) for e in loaded[0].encode_batch_fast(turns, add_special_tokens=False)]

    return count


class _Windows:
    """Takes a conversation's turns in order and gives its windows; holds one window's turns at most."""

    def __init__(self, conv_id, budget: int, history: int, targets: tuple[str, ...]):
        self.conv_id, self.budget, self.history, self.targets = conv_id, budget, history, targets
        self.system: tuple | None = None
        self.repeated: list[tuple] = []
        self.new: list[tuple] = []
        self.sums = [0]  # prefix sums of tokens: the repeated turns, then the new ones
        self.window = 0

    def _start(self, turns: list[tuple]) -> None:
        self.repeated, self.new, self.sums = turns, [], [0]
        for t in turns:
            self.sums.append(self.sums[-1] + t[2])

    def add(self, role: str, text: str, tokens: int) -> dict | None:
        turn = (role, text, tokens)
        done = None
        if self.new and self.sums[-1] + turn[2] > self.budget:
            done = self.close()
        if not self.new and self.sums[-1] + turn[2] > self.budget:
            # history gives way, the oldest turn first; the system turn stays
            kept = [t for t in self.repeated if t is not self.system]
            room = self.budget - turn[2] - (self.system[2] if self.system else 0)
            while kept and sum(t[2] for t in kept) > room:
                kept.pop(0)
            self._start(([self.system] if self.system else []) + kept)
        if self.window == 0 and not self.new and role == "system" and self.system is None:
            self.system = turn
        self.new.append(turn)
        self.sums.append(self.sums[-1] + turn[2])
        return done

    def close(self) -> dict:
        parts, loss, at = [], [], 0
        for i, (role, text, _) in enumerate(self.repeated + self.new):
            part, a, b = format_turn(role, text)
            if i >= len(self.repeated) and role in self.targets:
                loss.append({"start": at + a, "stop": at + b})
            parts.append(part)
            at += len(part)
        out = {"conv_id": self.conv_id, "window": self.window, "text": "".join(parts), "n_tokens": self.sums[-1], "n_repeated": len(self.repeated), "n_new": len(self.new), "loss": loss}
        # history: the latest turns that fit, the system turn aside
        turns, sums, keep = self.repeated + self.new, self.sums, len(self.repeated + self.new)
        while keep > 0 and turns[keep - 1] is not self.system and sums[-1] - sums[keep - 1] <= self.history:
            keep -= 1
        self.window += 1
        self._start(([self.system] if self.system else []) + turns[keep:])
        return out


def format_conversations(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, targets: tuple[str, ...] = ("assistant",), count: Callable[[list[str]], list[int]] = count_pieces, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Training windows: conv_id, window (from 0), text, n_tokens, n_repeated and n_new turns, loss (code-point spans of text).

    Turns come by turn, then role, then text, nulls first; repeated rows are turns of their own. Null roles
    and texts are empty; rows with a null id form one conversation. ``count`` gives the tokens of formatted turns,
    so the template and its escapes are inside the budget. History is given up, the oldest
    turn first, where the next turn needs its room; a turn that is beyond the budget even with the system turn alone
    is kept whole in a window of its own with that, the only kind of window beyond the budget. An empty table gives no windows. Rows stream through a
    task in order, so a very long conversation needs no more memory than its longest window. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out = None, []
        for batch in batches:
            convs, roles, texts = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))
            tokens = count([format_turn(r, t)[0] for r, t in zip(roles, texts, strict=True)])
            for conv, role, text, n in zip(convs, roles, texts, tokens, strict=True):
                if at is None or at.conv_id != conv:
                    if at is not None:
                        out.append(at.close())
                    at = _Windows(conv, budget, history, targets)
                done = at.add(role, text, n)
                if done:
                    out.append(done)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=WINDOW)
                out = []
        if at is not None:
            yield pa.RecordBatch.from_pylist([at.close()], schema=WINDOW)

    bounded_batches(conversations.sparkSession)
    rows = conversations.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(
        run, "conv_id long, window long, text string, n_tokens long, n_repeated long, n_new long, loss array<struct<start:long,stop:long>>"
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from its windows alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The first digest is over role, newline, text, newline of each new turn; the second over all text under
    the loss masks, unescaped. loss_chars counts its code points, formatted_chars those of all windows.
    """
    fields = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began, conv, n, chars, size, turns, loss = False, None, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if not began or r["conv_id"] != conv:
                    if began:
                        out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))
                    began, conv, n, chars, size, turns, loss = True, r["conv_id"], 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, text in parse_turns(r["text"])[r["n_repeated"] :]:
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                for span in r["loss"]:
                    target = unescape(r["text"][span["start"] : span["stop"]])
                    loss.update(target.encode())
                    chars += len(target)
                size += len(r["text"])
            yield pa.record_batch([pa.array([o[i] for o in out], t) for i, (_, t) in enumerate(fields)], schema=schema)
        if began:
            yield pa.record_batch([pa.array([v], t) for v, (_, t) in zip((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size), fields, strict=True)], schema=schema)

    dealt = cut(windows, "windows").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

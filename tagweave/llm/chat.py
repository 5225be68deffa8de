"""Chat formatting by incremental black-box rendering.

A template is any function of a list of (role, text) turns to a string. It is
never looked into: each prefix of the turns is rendered, consecutive outputs
are compared, and what is new is the span of the turn. Where an output doesn't
begin with the one before, the template rewrites history; the first such turn
is reported and the span starts where the outputs part. The text inside an
assistant's span is found in the same way: the opening by rendering the turn
as a prompt, the closing by rendering it empty.

The template here marks every turn with control strings. Control strings inside
a text get one backslash after their first character, and one more if they had
some, which is undone exactly when the output is read back.

Rows are dealt by conversation and sorted by turn; a task streams through its
conversations and holds one at a time. Prefixes are rendered from escaped
turns, so a step costs one join and one comparison of memory.

Defined results: null texts and roles are empty; rows are ordered by turn
(null first), then role, then text, so repeated turns are kept in a stable
order; rows with a null conv_id are one conversation; empty tables give only
what is added; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Turns = list[tuple[str, str]]

#: Control strings of the template (fixed format).
BEGIN, END = "<s>", "</s>"
_CONTROL = r"(/?(?:s>|(?:INST|SYS|ROLE|SEP)\]))"
_ESCAPE = re.compile(r"([<\[])(\\*)" + _CONTROL)
_UNESCAPE = re.compile(r"([<\[])\\(\\*)" + _CONTROL)

SCHEMA = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
          "rewritten_at long, formatted string, spans array<struct<start: long, end: long, loss_start: long, loss_end: long>>")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def render(turns: Turns, prompt: bool = False) -> str:
    """The template; roles and texts come escaped. ``prompt`` opens an assistant's turn."""
    out = [BEGIN]
    for role, text in turns:
        if role == "user":
            out.append(f"[INST] {text} [/INST]")
        elif role == "system":
            out.append(f"[SYS] {text} [/SYS]")
        elif role == "assistant":
            out.append(f" {text}{END}")
        else:
            out.append(f"[ROLE] {role} [SEP] {text} [/ROLE]")
    return "".join(out) + (" " if prompt else "")


def read_back(formatted: str) -> Turns:
    """The turns of an output of ``render``."""
    out, at = [], len(BEGIN)
    while at < len(formatted):
        if formatted.startswith("[INST] ", at):
            role, start, close = "user", at + 7, " [/INST]"
        elif formatted.startswith("[SYS] ", at):
            role, start, close = "system", at + 6, " [/SYS]"
        elif formatted.startswith("[ROLE] ", at):
            sep = formatted.index(" [SEP] ", at + 6)
            role, start, close = unescape(formatted[at + 7:sep]), sep + 7, " [/ROLE]"
        else:
            role, start, close = "assistant", at + 1, END
        end = formatted.index(close, start)
        out.append((role, unescape(formatted[start:end])))
        at = end + len(close)
    return out


def locate(turns: Turns, template: Callable[..., str] = render) -> tuple[str, list[tuple[int, int, int, int]], int | None]:
    """The output for all turns, each turn's span and loss span (equal ends: no
    loss), and the first turn at which the template rewrote history (None: never)."""
    before, spans, rewritten = template([]), [], None
    for k, (role, _) in enumerate(turns):
        now = template(turns[:k + 1])
        start = len(before)
        if not now.startswith(before):
            rewritten = k if rewritten is None else rewritten
            start = next((i for i, (a, b) in enumerate(zip(before, now)) if a != b), min(len(before), len(now)))
        lo = hi = len(now)
        if role == "assistant":
            opened = template(turns[:k], prompt=True)
            empty = template([*turns[:k], (role, "")])
            lo, hi = len(opened), len(now) - (len(empty) - len(opened))
        spans.append((start, len(now), lo, hi))
        before = now
    return before, spans, rewritten


def formatted_row(conv_id, turns: Turns, template: Callable[..., str] = render, read: Callable[[str], Turns] = read_back) -> tuple:
    text, spans, rewritten = locate([(escape(r), escape(t)) for r, t in turns], template)
    back = read(text)
    loss = "".join(unescape(text[lo:hi]) for _, _, lo, hi in spans)
    digest = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    return (conv_id, len(back), digest("".join(f"{r}\n{t}\n" for r, t in back)), len(loss), digest(loss), len(text), rewritten, text,
            [{"start": a, "end": b, "loss_start": c, "loss_end": d} for a, b, c, d in spans])


def format_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation: digests, the formatted text and the spans."""
    columns = [c.strip().split(" ")[0] for c in SCHEMA.split(", ")[:7]] + ["formatted", "spans"]

    def frame(done: list[tuple]) -> pd.DataFrame:
        f = pd.DataFrame(done, columns=columns)
        for c in ("conv_id", "rewritten_at"):
            f[c] = pd.array(f[c], dtype="Int64")
        return f

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Turns = []
        last = object()
        for b in batches:
            done = []
            for conv, role, text in zip(b["conv_id"].array, b["role"].array, b["text"].array):
                conv = None if pd.isna(conv) else int(conv)
                if held and conv != last:
                    done.append(formatted_row(last, held))
                    held = []
                last = conv
                held.append(("" if pd.isna(role) else role, "" if pd.isna(text) else text))
            if done:
                yield frame(done)
        if held:
            yield frame([formatted_row(last, held)])

    dealt = rows.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInPandas(run, SCHEMA)

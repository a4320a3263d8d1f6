"""Chat formatting: spans of turns found by rendering prefixes of a conversation with a template that is a black box."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: str) -> str:
    """No control string `<|...` is left: `<`, backslashes, `|` gets one backslash more. unescape() takes it off again."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


#: Characters of a turn whose rendering is kept for the next, longer prefix, and how many such turns: 16 million characters at most.
SHORT, KEPT = 1000, 1 << 14


def _turn(role: str, text: str) -> str:
    return f"{START}{escape(role.replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n'))}\n{escape(text)}{END}\n"


_kept_turn = lru_cache(KEPT)(_turn)


def chatml(turns: list[Turn]) -> str:
    """The default template. A line break in a role is written as \\n, a backslash there as two."""
    return "".join([_kept_turn(r, t) if len(r) + len(t) <= SHORT else _turn(r, t) for r, t in turns])


def read_chatml(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, from, to) of each turn in chatml()'s output; from and to bound the escaped text."""
    out, at = [], 0
    while at < len(text):
        line = text.index("\n", at)
        end = text.index(END, line)
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text[at + len(START) : line]))
        out.append((role, unescape(text[line + 1 : end]), line + 1, end))
        at = end + len(END) + 1
    return out


def spans(turns: list[Turn], render: Template) -> tuple[str, list[tuple[int, int]] | None]:
    """The rendered conversation, and where in it each turn stands; None instead of spans if the template rewrites history.

    Every prefix is rendered, one turn longer each time, and compared with the one before: what it adds is its last turn's span. If it doesn't begin with the one before, the
    template has rewritten history. Nothing is known of the template, so no prefix can be left out: n turns cost n renderings of n / 2 turns on average, whatever the template.
    """
    whole = render([])
    found: list[tuple[int, int]] = []
    for i in range(1, len(turns) + 1):
        longer = render(turns[:i])
        if not longer.startswith(whole):
            return render(turns), None
        found.append((len(whole), len(longer)))
        whole = longer
    return whole, found


def format_conversations(rows: DataFrame, render: Template = chatml) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text): conv_id, formatted, starts, ends (code points of each turn's span), roles, rewrites (the template rewrites history; then no spans).

    Turns stand by turn (null first), ties by role and text. Null role or text: empty. Rows with a
    null conv_id belong to no other row: each is a conversation of its own. Repeated rows are turns of their own. An empty table gives an
    empty result; other columns are ignored. Rows stream through in conversation order, so a task
    holds one conversation at a time besides a batch; a conversation can't be split, since its template sees all of it.
    """
    some = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    some = some.repartition("conv_id", alone).sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = "conv_id long, formatted string, roles array<string>, starts array<long>, ends array<long>, rewrites boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(conv: int | None, turns: list[Turn]) -> dict:
            text, at = spans(turns, render)
            return {"conv_id": conv, "formatted": text, "roles": [r for r, _ in turns], "starts": [a for a, _ in at or ()], "ends": [b for _, b in at or ()], "rewrites": at is None}

        conv, turns, out, size = None, [], [], 0
        kinds = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("roles", pa.list_(pa.string())), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("rewrites", pa.bool_())])
        for batch in batches:
            for c, r, t in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
                if turns and (c != conv or c is None):
                    out.append(done(conv, turns))
                    size += len(out[-1]["formatted"])
                    turns = []
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(out, kinds)
                        out, size = [], 0
                conv = c
                turns.append((r, t))
        if turns:
            out.append(done(conv, turns))
        if out:
            yield pa.RecordBatch.from_pylist(out, kinds)

    return some.mapInArrow(run, schema)


def loss_spans(formatted: str, roles: list[str], starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Where the loss mask is on: each assistant's text, without the marks around it."""
    out = []
    for role, s, e in zip(roles, starts, ends, strict=True):
        if role == "assistant":
            (_, _, a, b), = read_chatml(formatted[s:e])
            out.append((s + a, s + b))
    return out

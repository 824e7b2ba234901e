"""Chat formatting in budgeted windows.

Turns are put into a template with marks, cut into windows of whole turns by their running sum of tokens. A window
opens with the conversation's system turn and a little repeated history; the loss mask covers the assistant turns
that are new in it, so that over all windows each assistant text is learned from once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, packing

#: Fixed values of the template: what opens and closes a turn of each role. Other roles carry their name in the text.
TEMPLATE = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("<|turn|>", "<|text|>", "<|end|>")
CONTROL = [x for pair in TEMPLATE.values() for x in pair] + list(OTHER)

_ESCAPE = re.compile(r"\\|" + "|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_OPEN = re.compile("|".join(map(re.escape, [a for a, _ in TEMPLATE.values()] + [OTHER[0]])))
_ROLE = {a: (role, b) for role, (a, b) in TEMPLATE.items()}


def escape(text: str) -> str:
    """A backslash before each backslash and after the first character of each control string: none is left whole."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def format_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """A turn in the template, and where its text begins and ends in it."""
    body = escape(text or "")
    if role in TEMPLATE:
        before, after = TEMPLATE[role]
    else:
        before, after = f"{OTHER[0]}{escape(role or '')}{OTHER[1]}", OTHER[2]
    return f"{before}{body}{after}", len(before), len(before) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, begin, end) of each turn of a formatted window; offsets are of the escaped text."""
    out, at = [], 0
    while at < len(formatted):
        m = _OPEN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn begins at {at}")
        if m[0] == OTHER[0]:
            cut = formatted.index(OTHER[1], m.end())
            role, begin, close = unescape(formatted[m.end() : cut]), cut + len(OTHER[1]), OTHER[2]
        else:
            (role, close), begin = _ROLE[m[0]], m.end()
        end = formatted.index(close, begin)
        out.append((role, unescape(formatted[begin:end]), begin, end))
        at = end + len(close)
    return out


def tokens(text: str | None) -> int:
    """A cheap count for a budget: a word, or four characters where words are longer than that."""
    text = text or ""
    return max(len(text.split()), -(-len(text) // 4))


def token_counter(spark: SparkSession, path: str | None = None) -> Callable[[str | None], int]:
    """Counts a text's tokens in the vocabulary file at path, by default the installed public one of word ends."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    held = spark.sparkContext.broadcast(bpe.read_tokenizer(path))
    return lambda text: len(packing.packed_ids(text, packing._coder(held.value))) // 4


@dataclass(frozen=True)
class Windows:
    """budget: tokens of a window; history: tokens of repeated turns at most. A turn that
    exceeds the budget has a window of its own, with the system turn before it."""

    budget: int = 2048
    history: int = 256


_SCHEMA = "conv_id long, window int, formatted string, repeated int, loss array<struct<start: int, end: int>>"
_LOSS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _windows(conv_id: int | None, turns: Iterator[tuple[str | None, str | None]], opts: Windows, count: Callable[[str | None], int]) -> Iterator[tuple]:
    """Cuts one conversation, turn by turn: only the open window, the history and the system turn are held."""
    number, system = 0, None
    window: list[tuple[str | None, str | None, int, bool]] = []
    spent = 0

    def finished() -> tuple:
        text, loss, repeated = [], [], 0
        at = 0
        for role, body, _, new in window:
            piece, a, b = format_turn(role, body)
            if new and role == "assistant":
                loss.append({"start": at + a, "end": at + b})
            repeated += not new
            text.append(piece)
            at += len(piece)
        return conv_id, number, "".join(text), repeated, loss

    for i, (role, body) in enumerate(turns):
        cost = count(body)
        if any(x[3] for x in window) and spent + cost > opts.budget:
            yield finished()
            number += 1
            kept, size = [], (system[2] if system else 0) + cost
            for x in reversed(window):
                if x is window[0] and system and x[0] == "system":
                    break
                if sum(y[2] for y in kept) + x[2] > opts.history or size + x[2] > opts.budget:
                    break
                kept.append((*x[:3], False))
                size += x[2]
            window = ([(*system, False)] if system else []) + kept[::-1]
            spent = sum(x[2] for x in window)
        if i == 0 and role == "system":
            system = (role, body, cost)
        window.append((role, body, cost, True))
        spent += cost
    if window:
        yield finished()


def format_chats(conversations: DataFrame, opts: Windows = Windows(), count: Callable[[str | None], int] | None = None) -> DataFrame:
    """One row per window: conv_id, window, formatted, repeated (how many turns at its front are repeats) and loss, the
    code point offsets [start, end) in formatted that are learned from.

    Only conv_id, turn, role and text are read. Rows are taken by turn (null first), ties by role and text; null texts
    and roles count as empty, and null conv_ids are one conversation. Rows that repeat are turns of their own. The
    first turn, if its role is system, opens every window. An empty table gives an empty result. Turns go by in the
    order of the sort, which Spark keeps on disk where need be; of a conversation of any length one window is held.
    count: the tokens of a turn's text, those of token_counter by default.
    """
    count = count or token_counter(conversations.sparkSession)
    n = common.shuffle_parts(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    rows = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "window", "formatted", "repeated", "loss"]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), _LOSS]
        out: list[tuple] = []
        for made in _by_conversation(batches, lambda key, turns: _windows(key, turns, opts, count)):
            out.append(made)
            if len(out) >= 512:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return common.arrow_map(rows, run, _SCHEMA)


def _by_conversation(batches: Iterator[pa.RecordBatch], each) -> Iterator[tuple]:
    """Calls each(conv_id, rows) for rows that come in the order of conv_id, the first column; rows are the others."""
    stream = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    row = next(stream, None)
    while row is not None:
        key, left = row[0], [row]

        def own(key=key, left=left):
            row = left.pop()
            while row is not None and row[0] == key:
                yield row[1:]
                row = next(stream, None)
            left.append(row)

        rows = own()
        yield from each(key, rows)
        for _ in rows:
            pass
        row = left.pop() if left else None


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation, read from its formatted windows alone: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars. Repeated turns count once; digests are over the unescaped texts."""
    n = common.shuffle_parts(windows.sparkSession)
    rows = windows.select("conv_id", "window", "formatted", "repeated", F.col("loss.start").alias("starts"), F.col("loss.end").alias("ends"))
    rows = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "window")

    def each(conv_id: int | None, parts: Iterator[tuple]) -> Iterator[tuple]:
        turns, loss, n_turns, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        for _, formatted, repeated, starts, ends in parts:
            chars += len(formatted)
            for role, text, _, _ in read_turns(formatted)[repeated:]:
                turns.update(f"{role}\n{text}\n".encode())
                n_turns += 1
            for a, b in zip(starts, ends, strict=True):
                said = unescape(formatted[a:b])
                loss.update(said.encode())
                loss_chars += len(said)
        yield conv_id, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        out = []
        for made in _by_conversation(batches, each):
            out.append(made)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return common.arrow_map(rows, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

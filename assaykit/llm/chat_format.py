"""Conversations as training windows of a bounded number of tokens, and back.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside a text are escaped reversibly: in
every run ``<``, backslashes, ``|`` one backslash is added, so no text contains ``<|``. A conversation's turns are
cut into windows at turns only, by prefix sums of the tokens of its written turns: a window holds the system turn (if
the first turn is one), up to ``history`` turns from before its span, as far as those leave half of the budget free,
then the span of new turns that ends where the prefix sum would leave the budget. The loss mask covers the texts of
new assistant turns; what is repeated is masked. A turn that doesn't fit beside history goes without; one that is
larger than the budget is a window of its own, whole, marked over_budget. Tokens are those of a byte-level tokenizer
if one is given, counted through its pre-tokens as in token_counts.py, else one for every four bytes.

A span also ends at every ``segment``-th turn. So the segments of a conversation are formatted apart, each from its own
turns, the last few of the segment before and the system turn: a conversation of a third of all turns is dealt to as
many tasks as it has segments, its turns ranked by ranges before. A task streams over its rows and holds the turns of
about a window at a time.

Defined cases: a null text or role is empty; turns that tie are ordered by role, then text, and repeated rows stay
repeated turns; a null conversation id is a conversation of its own; a very long text is one turn, never cut; an empty
table gives an empty result. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import cut, received, share, small_side, text_batches
from assaykit.llm.memory import lean
from assaykit.llm.mixing import running_sums
from assaykit.llm.token_counts import token_counter

START, END = "<|im_start|>", "<|im_end|>"
WINDOWS = "conv_id long, segment int, window int, text string, n_turns int, n_repeated int, n_tokens int, over_budget boolean, loss array<struct<start:int,end:int>>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_WINDOWS_ARROW = pa.schema([("conv_id", pa.int64()), ("segment", pa.int32()), ("window", pa.int32()), ("text", pa.string()), ("n_turns", pa.int32()), ("n_repeated", pa.int32()), ("n_tokens", pa.int32()), ("over_budget", pa.bool_()), ("loss", pa.list_(_SPAN))])
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)
#: Windows sent to Spark at once.
CHUNK = 256
#: A row's turn is what its segment begins with, repeated from before, or its own.
SYSTEM, HISTORY, OWN = 0, 1, 2
#: Bytes of parsed turns in a row.
PIECE = 1 << 20


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def approximate_tokens(text: str) -> int:
    """A token for every four bytes, as for byte-level tokenizers on running text."""
    return (len(text.encode()) + 3) // 4


def written(role: str, body: str) -> tuple[str, str, str]:
    """What stands before a turn's text, the text, what stands after it."""
    return f"{START}{escape_role(role)}\n", escape(body), f"{END}\n"


def _window(old: list, new: list, budget: int) -> tuple:
    """(text, n_turns, n_repeated, n_tokens, over_budget, loss spans) of repeated and new (role, parts, tokens)."""
    text, loss, at = [], [], 0
    for i, (role, (head, body, tail), _) in enumerate(old + new):
        if i >= len(old) and role == "assistant" and body:
            loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
        text += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    total = sum(n for *_, n in old + new)
    return "".join(text), len(old) + len(new), len(old), total, total > budget, loss


def windows_of(turns: Iterable[tuple[int, str, str]], budget: int, history: int, tokens: Callable[[str], int]):
    """Yields the windows of one segment's (kind, role, text) turns, those repeated from before first."""
    system: list = []
    held: list = []  # turns that spans may still need, history of the next one first
    begin = 0  # where in held the next span begins
    started = False

    def spans(last: bool):
        nonlocal held, begin, started
        sums = np.cumsum([0, *(n for *_, n in held)])
        while begin < len(held):
            fixed = sum(n for *_, n in system) if started or begin else 0
            # The earliest turn from which history leaves half of the budget free.
            free = max(0, budget // 2 - fixed)
            back = max(int(np.searchsorted(sums, sums[begin] - free)), begin - history)
            if system and back < begin and held[back] is system[0]:
                back += 1
            room = budget - fixed - (sums[begin] - sums[back])
            if held[begin][2] > room:  # a large turn goes without history
                back, room = begin, budget - fixed
            end = max(begin + 1, int(np.searchsorted(sums, sums[begin] + room, side="right")) - 1)
            if end == len(held) and not last:
                break  # turns to come may fit as well
            old = (system if fixed else []) + held[back:begin]
            yield _window(old, held[begin:end], budget)
            begin, started = end, True
        keep = max(0, begin - history)
        held, begin = held[keep:], begin - keep

    waiting = 0
    for kind, role, body in turns:
        parts = written(role, body)
        turn = (role, parts, tokens("".join(parts)))
        if kind == SYSTEM:
            system, started = [turn], True
            continue
        if kind == HISTORY:
            held.append(turn)
            begin += 1
            continue
        if not started and not system and not held and role == "system":
            system = [turn]
        held.append(turn)
        waiting += turn[2]
        if waiting > 4 * budget:
            yield from spans(False)
            waiting = sum(n for *_, n in held[begin:])
    yield from spans(True)


def format_conversations(
    turns: DataFrame,
    *,
    budget: int = 1024,
    history: int = 2,
    tokenizer: str | None = None,
    segment: int = 4096,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Rows of WINDOWS: text is the formatted window, its first n_repeated turns are repeated, loss spans count code points.

    tokenizer is the JSON of a byte-level tokenizer. Windows of a segment come in order, segments and windows count from 0.
    """
    counter = share(turns.sparkSession, tokenizer)

    def run(batches):
        definition = received(counter)
        tokens = approximate_tokens if definition is None else token_counter(definition)
        rows = ((c, g, k, r or "", t or "") for b in batches for c, g, k, r, t in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True))
        out: list[dict] = []
        for (conversation, nth), group in groupby(rows, key=lambda row: row[:2]):
            for w, (body, n, old, total, over, loss) in enumerate(windows_of((row[2:] for row in group), budget, history, tokens)):
                out.append({"conv_id": conversation, "segment": nth, "window": w, "text": body, "n_turns": n, "n_repeated": old, "n_tokens": total, "over_budget": over, "loss": loss})
                if len(out) >= CHUNK:
                    yield pa.RecordBatch.from_pylist(out, schema=_WINDOWS_ARROW)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_WINDOWS_ARROW)

    picked = text_batches(turns).select(F.col(conv_id).cast("long").alias("c"), F.col(turn).alias("t"), F.col(role).alias("r"), F.col(text).alias("x"))
    order = ["t", "r", "x"]
    long = cut(picked.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > segment).select(F.col("c").alias("k"), "n"))
    dealt = picked.withColumns({"g": F.lit(0), "kind": F.lit(OWN)})
    if not long.isEmpty():
        of_long = F.col("c").eqNullSafe(F.col("k"))
        ranked = running_sums(picked.join(small_side(long, 100_000), of_long).drop("k"), [F.col(c) for c in ("c", *order)], {"rank": F.lit(1)})
        first = ranked.groupBy(F.col("c").alias("k")).agg(F.min("rank").alias("first"))
        ranked = cut(ranked.join(small_side(cut(first), 100_000), of_long).withColumn("rank", F.col("rank") - F.col("first")).withColumn("g", F.floor(F.col("rank") / segment).cast("int")))
        last = F.floor((F.col("n") - 1) / segment).cast("int")
        own = ranked.withColumn("kind", F.lit(OWN))
        before = ranked.where((F.col("rank") % segment >= segment - history) & (F.col("g") < last) & ~((F.col("rank") == 0) & F.col("r").eqNullSafe("system"))).withColumns({"g": F.col("g") + 1, "kind": F.lit(HISTORY)})
        systems = ranked.where((F.col("rank") == 0) & (F.col("r") == "system")).withColumn("g", F.explode(F.sequence(F.lit(1), last))).withColumn("kind", F.lit(SYSTEM))
        dealt = dealt.join(small_side(long, 100_000), of_long, "left_anti")
        for part in (own, before, systems):
            dealt = dealt.unionByName(part.select("c", *order, "g", "kind"))
    return dealt.repartition("c", "g").sortWithinPartitions("c", "g", "kind", *order).select("c", "g", "kind", "r", "x").mapInArrow(lean(run), WINDOWS)


def parse_window(text: str) -> list[tuple[str, str, int]]:
    """(role, text, offset of the text) of each turn in a formatted window, unescaped."""
    found, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"not a formatted window: {text[at:at + 80]!r}")
        found.append((unescape_role(m[1]), unescape(m[2]), m.start(2)))
        at = m.end()
    return found


def read_back(windows: DataFrame) -> DataFrame:
    """Rows of DIGEST from what format_conversations() returns: what its windows hold, once they are parsed again.

    Windows are parsed where they are; what a conversation's hashes run over is brought together in pieces of about
    PIECE bytes and streamed. A hash of all turns can't be computed in parts, so that last step is a task for each
    conversation.
    """
    parts = "conv_id long, segment int, window int, n long, turns binary, loss_chars long, loss binary, chars long"
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64()]

    def parse(batches):
        rows = (row for b in batches for row in b.to_pylist())
        for (conversation, nth), group in groupby(rows, key=lambda row: (row["conv_id"], row["segment"])):
            first, turns, loss, size, n, loss_chars, chars = None, [], [], 0, 0, 0, 0

            def piece():
                values = (conversation, nth, first, n, b"".join(turns), loss_chars, b"".join(loss), chars)
                return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in parts.split(", ")])

            for row in group:
                first = row["window"] if first is None else first
                chars += len(row["text"])
                for role, body, _ in parse_window(row["text"])[row["n_repeated"] :]:
                    turns.append(f"{role}\n{body}\n".encode())
                    size += len(turns[-1])
                    n += 1
                for span in row["loss"]:
                    body = unescape(row["text"][span["start"] : span["end"]])
                    loss.append(body.encode())
                    loss_chars += len(body)
                if size >= PIECE:
                    yield piece()
                    first, turns, loss, size, n, loss_chars, chars = None, [], [], 0, 0, 0, 0
            if first is not None:
                yield piece()

    def digest(batches):
        rows = (row for b in batches for i in range(b.num_rows) for row in b.slice(i, 1).to_pylist())
        out = []
        for conversation, group in groupby(rows, key=lambda row: row["conv_id"]):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = loss_chars = chars = 0
            for row in group:
                turns.update(row["turns"])
                loss.update(row["loss"])
                n, loss_chars, chars = n + row["n"], loss_chars + row["loss_chars"], chars + row["chars"]
            out.append((conversation, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
        if out:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)], names=[c.split()[0] for c in DIGEST.split(", ")])

    found = windows.mapInArrow(lean(parse), parts).repartition("conv_id").sortWithinPartitions("conv_id", "segment", "window")
    return found.mapInArrow(lean(digest), DIGEST)

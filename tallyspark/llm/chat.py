"""Chat formatting in budgeted windows.

Prefix sums of the turns' tokens choose turn-aligned spans: a window is the system turn, some repeated history and as
many new turns as the budget holds. The system turn is retained in each window; history is repeated up to a limit;
the loss mask covers each assistant text once, in the window where it is new.

Edge cases: a null text is empty; a null role is the empty role; a null conv_id is a conversation of its own; turns
that tie (or are null, which come first) are ordered by role, then text; repeated rows stay repeated turns; a turn
over the budget stands in a window with the system turn alone and is never cut; no rows give no windows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
ROLES = {v: k for k, v in NAMES.items()}
END = "</turn>\n"
_escape = str.maketrans({"\\": "\\\\", "#": "\\#", "<": "\\<"})
_turn = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*)</turn>\n", re.S)
_escaped = re.compile(r"\\(.)", re.S)

WINDOWS = "conv_id long, window int, first_turn long, repeated int, n_turns int, n_tokens long, text string, loss array<struct<start:int,end:int>>"
_windows = pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("first_turn", pa.int64()), ("repeated", pa.int32()), ("n_turns", pa.int32()), ("n_tokens", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def escape(text: str) -> str:
    """Afterwards no control string ('###', '</turn>') is left in the text; unescape() reverses it."""
    return text.translate(_escape)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text) if "\\" in text else text


def header(role: str) -> str:
    return f"### {NAMES[role]}: " if role in NAMES else f"### ={escape(role).replace(':', chr(92) + ':')}: "


def parse(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end of the escaped text) of each turn of a window."""
    for m in _turn.finditer(text):
        yield ROLES[m[1]] if m[1] in ROLES else unescape(m[1][1:]), unescape(m[2]), m.start(2), m.end(2)


@lru_cache(maxsize=2)
def token_counter(ranks: bytes | None):
    """Tokens of a text by byte-pair ranks, the bytes of a tokenizer's file; without them, by words."""
    if not ranks:
        return lambda text: len(text.split())
    import tiktoken

    known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    code = tiktoken.Encoding("turns", pat_str=r"\s+|[^\s\p{L}\p{N}]+|\p{L}+|\p{N}+", mergeable_ranks=known, special_tokens={})
    return lambda text: len(code.encode_ordinary(text))


class _Conversation:
    """The windows of one conversation, made while its turns stream by; holds no more than a window and the history."""

    def __init__(self, key, budget: int, history: int, count):
        self.key, self.budget, self.history, self.count = key, budget, history, count
        self.system, self.held, self.fresh, self.index, self.seen, self.prefix = None, [], 0, 0, 0, [0]

    def push(self, role: str, text: str):
        turn = (role, escape(text), self.count(text) + self.count(header(role) + END))
        if role == "system" and self.seen == 0:
            self.system = turn
        base = self.system[2] if self.system else 0
        if self.fresh and base + self.prefix[-1] + turn[2] > self.budget:
            yield self.flush()
            k = len(self.held)  # the longest suffix of whole turns within both limits stays as history
            while k and self.prefix[-1] - self.prefix[k - 1] <= self.history and base + self.prefix[-1] - self.prefix[k - 1] + turn[2] <= self.budget:
                k -= 1
            self.held, self.fresh, self.prefix = self.held[k:], 0, [x - self.prefix[k] for x in self.prefix[k:]]
        if turn is not self.system:
            self.held.append(turn)
            self.prefix.append(self.prefix[-1] + turn[2])
        self.fresh, self.seen = self.fresh + 1, self.seen + 1

    def flush(self) -> dict:
        turns = ([self.system] if self.system else []) + self.held
        repeated, out, loss, at = len(turns) - self.fresh, [], [], 0
        for i, (role, text, _) in enumerate(turns):
            start = at + len(header(role))
            out.append(f"{header(role)}{text}{END}")
            at += len(out[-1])
            if role == "assistant" and i >= repeated and text:
                loss.append({"start": start, "end": start + len(text)})
        self.index += 1
        return {"conv_id": self.key, "window": self.index - 1, "first_turn": self.seen - self.fresh, "repeated": repeated, "n_turns": len(turns), "n_tokens": sum(t[2] for t in turns), "text": "".join(out), "loss": loss}


def chat_windows(df: DataFrame, *, budget: int = 1024, history: int = 256, tokenizer: str | None = TOKENIZER) -> DataFrame:
    """Windows of conversations (conv_id, turn, role, text): one exchange by conversation, then a stream over sorted
    rows, so that no conversation is ever held whole. Offsets of loss are code points of the window's text; n_turns
    counts the turns of the window, of which the first `repeated` were in earlier ones. The tokenizer's file is read on
    the driver and broadcast (about a megabyte)."""
    shared = df.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes() if tokenizer else None)

    def run(batches):
        count, now, rows, size = token_counter(shared.value), None, [], 0
        for batch in batches:
            for key, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if now is None or now.key != key:
                    if now:
                        rows.append(now.flush())
                    now = _Conversation(key, budget, history, count)
                for w in now.push(role or "", text or ""):
                    rows.append(w)
                    size += len(w["text"])
            if size > 1 << 22 or len(rows) > 2000:
                yield pa.RecordBatch.from_pylist(rows, _windows)
                rows, size = [], 0
        if now:
            rows.append(now.flush())
        yield pa.RecordBatch.from_pylist(rows, _windows)

    turns = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(tidy(run), WINDOWS)


def read_back(windows: DataFrame) -> DataFrame:
    """What chat_windows' rows, as it returns them, say of each conversation: turns and loss text, parsed from the windows."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    kinds = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        now, rows = None, []

        def end():
            rows.append({"conv_id": now[0], "n_turns": now[1], "turns_sha256": now[2].hexdigest(), "loss_chars": now[3], "loss_sha256": now[4].hexdigest(), "formatted_chars": now[5]})

        for batch in batches:
            for key, window, repeated, text, loss in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "window", "repeated", "text", "loss"))):
                if window == 0:
                    if now:
                        end()
                    now = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for i, (role, said, _, _) in enumerate(parse(text)):
                    if i >= repeated:
                        now[1] += 1
                        now[2].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescape(text[span["start"] : span["end"]])
                    now[3] += len(said)
                    now[4].update(said.encode())
                now[5] += len(text)
            yield pa.RecordBatch.from_pylist(rows, kinds)
            rows = []
        if now:
            end()
        yield pa.RecordBatch.from_pylist(rows, kinds)

    return windows.mapInArrow(tidy(run), schema)


def op10_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(chat_windows(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)))


#: formatted_chars follows from token counts, so SQL can't give it; the brute-force test covers this query.
ORACLE = None

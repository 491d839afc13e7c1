"""Chat formatting into budgeted windows.

A conversation's turns are rendered with a template that marks turns and escapes its own control
strings inside texts. Running sums of the turns' tokens choose windows of whole turns: each starts
with the system turn, repeats at most ``HISTORY`` tokens of the turns before, then takes new turns
while the budget lasts (a single turn beyond the budget gets a window of its own). Assistant texts
are the targets; those that a window only repeats are masked, so each is learned once.

Rows are dealt by conversation and sorted by turn, then streamed: a worker holds the system turn,
the history and the window being filled, so the length of a conversation is not bounded by memory.

Defined cases: a null text or role is empty; null turns come first; turns with equal numbers are
ordered by role and text and all kept, repeated rows too; a null conversation id is a conversation;
an empty table gives no window; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import load, sliced, worker_cache
from tidemark.llm.packing import encoder

BUDGET = 1024
HISTORY = 256
OPEN, CLOSE, NEXT = "<turn>", "</turn>", "\n"
SYSTEM, TARGET = "system", "assistant"
WINDOWS = "conv_id long, window long, formatted string, n_tokens long, first_new int, loss array<struct<start:int,length:int>>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escaped(text: str) -> str:
    """A backslash before each backslash and each opening bracket; no control string survives."""
    return text.replace("\\", "\\\\").replace("<", "\\<")


def unescaped(text: str) -> str:
    out, k = [], 0
    while True:
        at = text.find("\\", k)
        if at < 0:
            out.append(text[k:])
            return "".join(out)
        out.append(text[k:at])
        out.append(text[at + 1 : at + 2])
        k = at + 2


def rendered(role: str, text: str) -> tuple[str, int]:
    """The turn and where its escaped text begins. A role's line ends are escaped as well."""
    head = OPEN + escaped(role).replace("\n", "\\n") + NEXT
    return head + escaped(text) + CLOSE + NEXT, len(head)


def parsed(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start and end of the escaped text) of each turn, read from the formatted string alone."""
    k = 0
    while k < len(formatted):
        if not formatted.startswith(OPEN, k):
            raise ValueError(f"no turn at {k}")
        line = formatted.index(NEXT, k)
        start = line + len(NEXT)
        end = formatted.index(CLOSE + NEXT, start)
        while _is_escaped(formatted, end):
            end = formatted.index(CLOSE + NEXT, end + 1)
        role = formatted[k + len(OPEN) : line]
        yield _role(role), unescaped(formatted[start:end]), start, end
        k = end + len(CLOSE) + len(NEXT)


def _is_escaped(text: str, at: int) -> bool:
    k = at
    while k and text[k - 1] == "\\":
        k -= 1
    return (at - k) % 2 == 1


def _role(raw: str) -> str:
    out, k = [], 0
    while k < len(raw):
        if raw[k] == "\\":
            out.append("\n" if raw[k + 1] == "n" else raw[k + 1])
            k += 2
        else:
            out.append(raw[k])
            k += 1
    return "".join(out)


class Windows:
    """Fills the windows of one conversation, turn by turn."""

    def __init__(self, conv: int | None, budget: int, history: int) -> None:
        self.conv, self.budget, self.history = conv, budget, history
        self.system: tuple[str, int, int, bool] | None = None
        self.recent: list[tuple[str, int, int, bool]] = []  # turns after the system turn, as many as history may repeat
        self.fresh: list[tuple[str, int, int, bool]] = []
        self.sums = [0]  # tokens of the new turns, as running sums
        self.made = 0

    def repeated(self) -> list[tuple[str, int, int, bool]]:
        """The longest run of turns before the new ones that fits the history budget."""
        total, first = 0, len(self.recent)
        while first and total + self.recent[first - 1][1] <= self.history:
            first -= 1
            total += self.recent[first][1]
        return self.recent[first:]

    def room(self) -> int:
        fixed = (self.system[1] if self.system and self.made else 0) + sum(t[1] for t in self.repeated())
        return self.budget - fixed

    def add(self, turn: tuple[str, int, int, bool], is_system: bool) -> tuple | None:
        """Take a turn; gives the window before it if that is full."""
        done = self.close() if self.fresh and self.sums[-1] + turn[1] > self.room() else None
        if is_system and self.system is None and not self.made and not self.fresh:
            self.system = turn
        self.fresh.append(turn)
        self.sums.append(self.sums[-1] + turn[1])
        return done

    def close(self) -> tuple | None:
        if not self.fresh:
            return None
        before = self.repeated()
        if sum(t[1] for t in before) + self.sums[-1] + (self.system[1] if self.system and self.made else 0) > self.budget:
            before = []  # a turn beyond the budget stands without history
        turns = ([self.system] if self.system and self.made else []) + before
        first_new, parts, loss, place = len(turns), [], [], 0
        for k, (text, _, start, target) in enumerate(turns + self.fresh):
            if target and k >= first_new:
                loss.append({"start": place + start, "length": len(text) - len(CLOSE) - len(NEXT) - start})
            parts.append(text)
            place += len(text)
        tokens = sum(t[1] for t in turns) + self.sums[-1]
        row = (self.conv, self.made, "".join(parts), tokens, first_new, loss)
        own = self.fresh[1:] if self.system and not self.made else self.fresh
        self.recent = [*self.recent, *own]
        total = 0
        for k in range(len(self.recent) - 1, -1, -1):
            total += self.recent[k][1]
            if total > self.history:
                self.recent = self.recent[k + 1 :]
                break
        self.fresh, self.sums, self.made = [], [0], self.made + 1
        return row


def _measure(ranks_path: str):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_cache(f"ranks {ranks_path}", lambda: encoder(ranks_path))
        for batch in sliced(batches):
            counts = [len(coder.encode_ordinary(rendered(role, text)[0])) for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=[*batch.schema.names, "tokens"])

    return measure


def _format(budget: int, history: int):
    def format_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))]
        names = ["conv_id", "window", "formatted", "n_tokens", "first_new", "loss"]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        current, out = None, []
        for batch in sliced(batches):
            for conv, role, text, tokens in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "tokens"))):
                if current is None or current.conv != conv:
                    if current and (row := current.close()):
                        out.append(row)
                    current = Windows(conv, budget, history)
                turn, start = rendered(role, text)
                if row := current.add((turn, tokens, start, role == TARGET), role == SYSTEM):
                    out.append(row)
            if out:
                yield pack(out)
                out = []
        if current and (row := current.close()):
            yield pack([row])

    return format_rows


def format_conversations(turns: DataFrame, ranks_path: str | None = None, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window, in order within each conversation and partition. Tokens are counted before turns are dealt by conversation, so a long one only fills windows in its task."""
    columns = "conv_id long, turn long, role string, text string"
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    measured = rows.mapInArrow(_measure(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")), f"{columns}, tokens long")
    dealt = measured.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_format(budget, history), WINDOWS)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in DIGEST.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    state: list | None = None

    def digest() -> pa.RecordBatch:
        conv, turns, all_turns, chars, loss, formatted = state
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((conv, turns, all_turns.hexdigest(), chars, loss.hexdigest(), formatted), types)], names=names)

    for batch in sliced(batches):
        for conv, formatted, first_new, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "first_new", "loss"))):
            if state is None or state[0] != conv:
                if state is not None:
                    yield digest()
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for k, (role, text, _, _) in enumerate(parsed(formatted)):
                if k >= first_new:
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
            for span in loss:
                target = unescaped(formatted[span["start"] : span["start"] + span["length"]])
                state[3] += len(target)
                state[4].update(target.encode())
            state[5] += len(formatted)
    if state is not None:
        yield digest()


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows say, from their strings and masks alone: one row per conversation."""
    dealt = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return dealt.mapInArrow(_read_back, DIGEST)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], turns.schema)
    return read_back(format_conversations(turns.union(extra)))

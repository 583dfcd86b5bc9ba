"""Chat formatting into budgeted windows (operator 3).

A conversation is cut into windows of whole turns. The running sum of turn costs tells where a window is full. Every
later window starts with the system turn and some history, both repeated; only assistant texts that appear for the
first time are under the loss mask.

A turn reads ``<|turn|>role\\ntext<|end|>\\n``. Control strings inside texts and roles get a backslash after their first
character and a backslash gets a second one, so texts can be read back exactly.
"""

from __future__ import annotations

import os
import re
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

from boxmill.llm.text import extended

BUDGET = 1024
HISTORY = 256
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

# Tokens of a turn besides its text: two marks, the role and a line break.
TURN_TOKENS = 4

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
_CONTROL = re.compile(r"\\|<\||</?s>|\[/?INST\]|<</?SYS>>")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n", re.DOTALL)

WINDOW = {
    "window": "int",
    "text": "string",
    "n_turns": "int",
    "n_repeated": "int",
    "tokens": "long",
    "over_budget": "boolean",
    "loss_spans": "array<struct<start:int,end:int>>",
}


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    """Roles stand on one line: a line break becomes a backslash and an n."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


@dataclass(frozen=True)
class Turn:
    number: int
    role: str
    text: str
    cost: int


@dataclass
class Windows:
    """The open window of one conversation. Holds no more than a budget's worth of turns and the last turn."""

    conv_id: object
    budget: int
    history: int
    window: int = 0
    seen: int = 0
    prefix: int = 0
    opened_at: int = 0
    system: Turn | None = None
    repeated: list[Turn] = field(default_factory=list)
    fresh: list[Turn] = field(default_factory=list)
    past: deque[Turn] = field(default_factory=deque)

    def add(self, role: str, text: str, tokens: int) -> Iterator[tuple]:
        """Takes the next turn; gives the window that it closes, if any."""
        turn = Turn(self.seen, role, text, tokens + TURN_TOKENS)
        carried = sum(t.cost for t in self.repeated)
        if self.fresh and self.prefix - self.opened_at + carried + turn.cost > self.budget:
            yield self.close()
            self.opened_at = self.prefix
            self.repeated = self._repeats(turn)
            self.fresh = []
        if self.seen == 0 and role == "system":
            self.system = turn
        self.seen += 1
        self.prefix += turn.cost
        self.fresh.append(turn)
        self.past.append(turn)
        while self.past and sum(t.cost for t in self.past) > self.history:
            self.past.popleft()

    def _repeats(self, turn: Turn) -> list[Turn]:
        """The system turn, then the latest turns that fit into the history and leave room for ``turn``."""
        kept = [self.system] if self.system else []
        room = min(self.history, self.budget - turn.cost - sum(t.cost for t in kept))
        latest: list[Turn] = []
        for old in reversed(self.past):
            if old is self.system or old.cost > room:
                break
            room -= old.cost
            latest.append(old)
        return kept + latest[::-1]

    def close(self) -> tuple:
        """The open window as a row: id, then the columns of WINDOW."""
        pieces, spans, at = [], [], 0
        turns = self.repeated + self.fresh
        for k, turn in enumerate(turns):
            head, body = f"{OPEN}{escape_role(turn.role)}\n", escape(turn.text)
            if k >= len(self.repeated) and turn.role == "assistant":
                spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
            pieces += [head, body, CLOSE]
            at += len(head) + len(body) + len(CLOSE)
        tokens = sum(t.cost for t in turns)
        self.window += 1
        return (self.conv_id, self.window - 1, "".join(pieces), len(turns), len(self.repeated), tokens, tokens > self.budget, spans)


@cache
def tokenizer(path: str) -> Callable[[list[str]], list[int]]:
    """A function that counts the tokens of texts; the vocabulary is read once per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.encode_special_tokens = True
    return lambda texts: [len(e) for e in loaded.encode_batch_fast(texts, add_special_tokens=False)]


def windows(
    turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer_path: str = TOKENIZER
) -> DataFrame:
    """``conv_id`` and the columns of WINDOW, a row per window; windows of a conversation follow each other in one partition.

    Turns are ordered by ``turn``, equal numbers by role and text, nulls first. A null text or role is empty; rows
    with a null ``conv_id`` make one conversation; repeated rows are turns of their own. Turns are never cut: one that
    alone exceeds the budget (with the system turn) stands in a window marked ``over_budget``. Other columns are not read.

    A conversation passes through a task turn by turn and is never held as a whole, however many turns it has.
    """
    rows = turns.select("conv_id", "turn", "role", "text").repartition("conv_id")
    rows = rows.sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = extended(rows.select("conv_id").schema, WINDOW)
    kinds = [
        pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(),
        pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])),
    ]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: Windows | None = None
        id_kind = None

        def closed() -> Iterator[tuple]:
            nonlocal current, id_kind
            for batch in batches:
                id_kind = batch.column("conv_id").type
                texts = [t or "" for t in batch.column("text").to_pylist()]
                tokens = tokenizer(tokenizer_path)(texts)
                for conv_id, role, text, n in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), texts, tokens):
                    if current is None or current.conv_id != conv_id:
                        if current:
                            yield current.close()
                        current = Windows(conv_id, budget, history)
                    yield from current.add(role or "", text, n)
            if current:
                yield current.close()

        found = closed()
        while part := list(islice(found, 2000)):
            ids, *columns = zip(*part)
            arrays = [pa.array(ids, id_kind), *(pa.array(c, kind) for c, kind in zip(columns, kinds))]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", *WINDOW])

    return rows.mapInArrow(cut, schema)


def read_turns(text: str) -> list[tuple[str, str]]:
    """The ``(role, text)`` pairs of a formatted window."""
    return [(unescape_role(role), unescape(body)) for role, body in _TURN.findall(text)]

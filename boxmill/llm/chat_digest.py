"""Digests of formatted conversations, read back from the windows alone."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

from boxmill.llm.chat_format import read_turns, unescape
from boxmill.llm.text import extended

DIGEST = {
    "n_turns": "long",
    "turns_sha256": "string",
    "loss_chars": "long",
    "loss_sha256": "string",
    "formatted_chars": "long",
    "n_windows": "long",
}
_KINDS = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())


class Digest:
    """What has been read of one conversation: running hashes and counts, no text."""

    def __init__(self, conv_id: object):
        self.conv_id = conv_id
        self.turns = self.loss = self.chars = self.windows = 0
        self.turns_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def read(self, text: str, n_repeated: int, spans: list[dict[str, int]]) -> None:
        for role, body in read_turns(text)[n_repeated:]:
            self.turns += 1
            self.turns_hash.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
        for span in spans:
            target = unescape(text[span["start"] : span["end"]])
            self.loss += len(target)
            self.loss_hash.update(target.encode("utf-8", "surrogatepass"))
        self.chars += len(text)
        self.windows += 1

    def row(self) -> tuple:
        return (self.conv_id, self.turns, self.turns_hash.hexdigest(), self.loss, self.loss_hash.hexdigest(), self.chars, self.windows)


def digests(windows: DataFrame) -> DataFrame:
    """``conv_id`` and DIGEST per conversation of ``chat_format.windows``, which keeps a conversation's windows together in order.

    Works window by window in the same stage, so nothing is shuffled again and no conversation is held as a whole.
    """
    rows = windows.select("conv_id", "text", "n_repeated", "loss_spans")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_kind = None

        def closed() -> Iterator[tuple]:
            nonlocal id_kind
            current: Digest | None = None
            for batch in batches:
                id_kind = batch.column("conv_id").type
                for conv_id, *window in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "n_repeated", "loss_spans"))):
                    if current is None or current.conv_id != conv_id:
                        if current:
                            yield current.row()
                        current = Digest(conv_id)
                    current.read(*window)
            if current:
                yield current.row()

        found = closed()
        while part := list(islice(found, 5000)):
            ids, *columns = zip(*part)
            arrays = [pa.array(ids, id_kind), *(pa.array(c, kind) for c, kind in zip(columns, _KINDS))]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", *DIGEST])

    return rows.mapInArrow(read, extended(rows.select("conv_id").schema, DIGEST))

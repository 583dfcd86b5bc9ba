"""Substring dedup by hashing text units across the corpus (operator 1).

A text is cut to paragraphs, to lines and, as a finer unit, to sentences. Each unit's normalised words are hashed to 128 bits, and
for every digest that occurs more than once the earliest occurrence is found by a grouped minimum. Later occurrences
are removed where a run of them holds enough words, with their offsets in the original text retained.
"""

from __future__ import annotations

import re
import struct
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmill.llm.text import BLANKS, KEY, extended, key_columns, words, without
from boxmill.session import write_table

UNITS = {
    "paragraph": re.compile(r"[^\n]+(?:\n[^\n]+)*"),
    "line": re.compile(r"[^\n]+"),
    "sentence": re.compile(r"[^.!?\n]+[.!?]*"),
}
KINDS = tuple(UNITS)

# Repeated units are removed in runs of at least so many words; shorter ones are common phrases and stay.
MIN_WORDS = 25

# The first and last sentence of a passage may be fused with what surrounds it. So many equal words of the sentence next to a run count
# towards its words, on either side.
EDGE_WORDS = 8

ADDED = {"n_units": "int", "n_removed": "int", "removed_spans": "array<struct<start:int,end:int>>"}


# A 128-bit digest as two signed numbers.
HALVES = struct.Struct(">qq")


class Unit(NamedTuple):
    start: int
    end: int
    first: int  # the same without blanks at both ends; units of two kinds with one such span are one
    last: int
    items: list[bytes]


def units(text: str | None, kind: str) -> list[Unit]:
    """The units of a text that have a word, with the words lower-cased from A to Z."""
    found = []
    for m in UNITS[kind].finditer(text or ""):
        piece = m[0]
        items = words(piece.encode("utf-8", "surrogatepass").lower())
        if items:
            start, end = m.span()
            found.append(Unit(start, end, end - len(piece.lstrip(BLANKS)), start + len(piece.rstrip(BLANKS)), items))
    return found


def cut(text: str | None, kinds: Sequence[str]) -> tuple[list[list[Unit]], dict[tuple[int, int], int]]:
    """The units of each kind, and the number of each different span among them, in order."""
    by_kind = [units(text, kind) for kind in kinds]
    spans = sorted({(u.first, u.last) for found in by_kind for u in found})
    return by_kind, {span: number for number, span in enumerate(spans)}


def edge(items: list[bytes]) -> int | None:
    """A hash of the EDGE_WORDS words at an edge; a shorter sentence has none."""
    return xxhash.xxh32_intdigest(b" ".join(items)) - (1 << 31) if len(items) == EDGE_WORDS else None


def hashed(text: str | None, kinds: Sequence[str]) -> list[tuple[int, int, int, int | None, int | None]]:
    """``unit, digest_a, digest_b, before, after`` of each different span; the last two stand for the neighbouring words."""
    by_kind, numbers = cut(text, kinds)
    sentences = by_kind[kinds.index("sentence")] if "sentence" in kinds else units(text, "sentence")
    starts = [s.start for s in sentences]
    before = [None, *(edge(s.items[-EDGE_WORDS:]) for s in sentences)]
    after = [*(edge(s.items[:EDGE_WORDS]) for s in sentences), None]
    found = {}
    for unit in (u for some in by_kind for u in some):
        number = numbers[unit.first, unit.last]
        if number not in found:
            digest = HALVES.unpack(xxhash.xxh3_128_digest(b" ".join(unit.items)))
            found[number] = (number, *digest, before[bisect_left(starts, unit.start)], after[bisect_left(starts, unit.end)])
    return list(found.values())


def digests(documents: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """``doc_id, key_a, key_b, unit, digest_a, digest_b, before, after``: a narrow row per unit, without text."""
    rows_in = documents.select("doc_id", "text", *key_columns("doc_id", "text"))
    added = {"unit": "int", "digest_a": "long", "digest_b": "long", "before": "int", "after": "int"}
    kinds = tuple(kinds)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, found = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                own = hashed(text, kinds)
                owner += [row] * len(own)
                found += own
            of = [batch.column(c).take(pa.array(owner, pa.int64())) for c in ("doc_id", *KEY)]
            columns = zip(*found) if found else ((),) * len(added)
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            arrays = [*of, *(pa.array(c, t) for c, t in zip(columns, types))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *KEY, *added])

    return rows_in.mapInArrow(rows, extended(rows_in.select("doc_id", *KEY).schema, added))


def repeated_units(documents: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """``key_a, key_b, repeated``: per document that has any, the numbers of its units that occur earlier.

    A number is four times the unit's place, plus 2 if the words before it equal those before the earliest occurrence, plus 1 if
    the words after it do. The earliest occurrence has the smallest id (nulls last), then the smallest key, then the lowest
    place. Only digests that occur twice come out of the first step, so the join meets a small side. It is written
    out, so that both sides are dealt anew and Spark can split a hot digest.
    """
    found = digests(documents, kinds)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key_a", "unit")
    earliest = F.min(F.struct(place.alias("place"), F.col("before").alias("first_before"), F.col("after").alias("first_after")))
    first = found.groupBy("digest_a", "digest_b").agg(earliest.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = write_table(first.select("digest_a", "digest_b", "first.*"), "first-occurrences")
    later = found.join(first, ["digest_a", "digest_b"]).where(place != F.col("place"))
    same = [F.coalesce(F.col(c) == F.col(f"first_{c}"), F.lit(False)).cast("int") for c in ("before", "after")]
    return later.groupBy(*KEY).agg(F.collect_set(F.col("unit") * 4 + same[0] * 2 + same[1]).alias("repeated"))


def removed_spans(text: str | None, repeated: Sequence[int], kinds: Sequence[str], min_words: int) -> tuple[int, int, list[list[int]]]:
    """How many units a text has, how many of them go, and the spans that go: the union, over the kinds, of runs of neighbouring
    repeated units that come to ``min_words``, equal words beside the run included.
    """
    by_kind, numbers = cut(text, kinds)
    if not repeated:
        return len(numbers), 0, []
    known = {r >> 2: r & 3 for r in repeated}
    spans: list[list[int]] = []
    for found in by_kind:
        run: list[tuple[Unit, int]] = []
        for unit in [*found, None]:
            sides = known.get(numbers[unit.first, unit.last]) if unit else None
            if sides is not None:
                run.append((unit, sides))
                continue
            if run and sum(len(u.items) for u, _ in run) + EDGE_WORDS * ((run[0][1] >> 1) + (run[-1][1] & 1)) >= min_words:
                spans.append([run[0][0].start, run[-1][0].end])
            run = []
    union: list[list[int]] = []
    for start, end in sorted(spans):
        if union and start <= union[-1][1]:
            union[-1][1] = max(union[-1][1], end)
        else:
            union.append([start, end])
    starts = [a for a, _ in union]
    gone = 0
    for first, last in numbers if union else ():
        k = bisect_left(starts, first + 1) - 1
        gone += k >= 0 and last <= union[k][1]
    return len(numbers), gone, union


def deduplicated(documents: DataFrame, kinds: Sequence[str] = KINDS, min_words: int = MIN_WORDS) -> DataFrame:
    """``documents`` with repeated passages cut out of ``text``, and ADDED.

    ``removed_spans`` are code point offsets in the original text, end exclusive. A null text stays null, an empty one
    empty. Rows that agree in id and text are one occurrence and keep or lose the same units; a unit repeated inside
    one text counts like any other. A very long text is cut as a whole; an empty table stays empty. Columns named like ADDED
    are replaced. ``n_removed`` counts the units inside removed spans.
    """
    kinds = tuple(kinds)
    names = without(documents, list(ADDED)).columns
    row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")
    keyed = documents.select(row, *key_columns("doc_id", "text"))
    joined = keyed.join(repeated_units(documents, kinds), KEY, "left").select("row", "repeated")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            out: list[tuple] = []
            for text, repeated in zip(row.field("text").to_pylist(), batch.column("repeated").to_pylist()):
                count, removed, spans = removed_spans(text, repeated or (), kinds, min_words)
                if spans:
                    edges = [0, *(x for span in spans for x in span), len(text)]
                    text = "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((text, count, removed, [{"start": a, "end": b} for a, b in spans]))
            texts, counts, removed, spans = zip(*out) if out else ((), (), (), ())
            arrays = [pa.array(texts, pa.string()) if c == "text" else row.field(c) for c in names]
            arrays += [
                pa.array(counts, pa.int32()),
                pa.array(removed, pa.int32()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *ADDED])

    return joined.mapInArrow(rows, extended(documents.select([f"`{c}`" for c in names]).schema, ADDED))

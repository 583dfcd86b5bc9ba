"""Benchmark decontamination with a word-level Aho-Corasick automaton (operator 6).

Benchmark texts (questions and answers) are cut to windows of ten words; an item with fewer words is one window. All
windows form one automaton whose alphabet is the benchmark's vocabulary. A document is normalised to the same
alphabet and runs through the automaton once; a match ends at a word number, which leads back to the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from boxmill.llm.text import KEY, extended, key_columns, utf8
from boxmill.session import write_table

WINDOW_WORDS = 10

# (window, item) rows in one automaton at most; this bounds what is broadcast. Beyond it the benchmark takes several automata of
# about half as many, each run over all documents.
BLOCK_WINDOWS = 50_000

WORD_RANGES = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Bytes that are no part of a word become blanks, A-Z become a-z, and bytes from 0x80 stay.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 32 for b in range(256)
)
_LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
FOUND = {
    "n_words": "long",
    "n_hit": "long",
    "spans": "array<struct<first:int,last:int,start:int,end:int>>",
}


def normal_words(raw: bytes | None) -> list[bytes]:
    """The normalised words of a UTF-8 text; a null text has none."""
    return raw.translate(_NORMAL).split() if raw else []


def windows(benchmark: DataFrame, width: int = WINDOW_WORDS) -> DataFrame:
    """``window`` (normalised words joined by blanks) and ``item_id`` (of any type), each pair once.

    Items without words give none. An item without an id keeps its windows under a null id.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, owners = [], []
            for item, raw in zip(batch.column("item_id").to_pylist(), utf8(batch.column("text"))):
                items = normal_words(raw)
                own = {b" ".join(items[k : k + width]) for k in range(max(1, len(items) - width + 1))} if items else ()
                found += [w.decode() for w in own]
                owners += [item] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(owners, batch.column("item_id").type)], names=["window", "item_id"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return benchmark.select("item_id", "text").mapInArrow(rows, f"window string, item_id {kind}").distinct()


class Scanner:
    """The automaton over a bounded list of ``(window, item_id)`` rows."""

    def __init__(self, rows: list[tuple[str, int | None]]):
        self.codes: dict[bytes, int] = {}
        self.items: list[list[int]] = []
        by_window: dict[tuple[int, ...], int] = {}
        for window, item in rows:
            key = tuple(self.codes.setdefault(w, len(self.codes) + 1) for w in window.encode().split(b" "))
            number = by_window.setdefault(key, len(self.items))
            if number == len(self.items):
                self.items.append([])
            if item is not None:
                self.items[number].append(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, number in by_window.items():
            self.automaton.add_word(key, (len(key), number))
        if by_window:
            self.automaton.make_automaton()
        self.empty = not by_window

    def hits(self, items: list[bytes]) -> list[tuple[int, int, list[int]]]:
        """``first, last, item_ids`` of every occurrence; words count from zero."""
        if self.empty or not items:
            return []
        codes = tuple(map(self.codes.get, items, [0] * len(items)))
        return [(end - width + 1, end, self.items[number]) for end, (width, number) in self.automaton.iter(codes)]


def merged(hits: list[tuple[int, int, list[int]]]) -> list[list[int]]:
    """Overlapping and neighbouring hits as common spans of first and last word."""
    spans: list[list[int]] = []
    for first, last, _ in sorted(hits, key=lambda h: h[0]):
        if spans and first <= spans[-1][1] + 1:
            spans[-1][1] = max(spans[-1][1], last)
        else:
            spans.append([first, last])
    return spans


def offsets(text: str, spans: list[list[int]]) -> list[dict[str, int]]:
    """Word spans with their place in the original text, in code points, end exclusive."""
    if not spans:
        return []
    places = [m.span() for m in re.finditer(WORD_RANGES, text.translate(_LOWER))]
    return [{"first": a, "last": b, "start": places[a][0], "end": places[b][1]} for a, b in spans]


def _blocks(found: DataFrame, block_windows: int) -> Iterator[list[tuple[str, int | None]]]:
    """The windows in parts of at most ``block_windows`` rows, fetched one after the other; one empty part if there are none.

    Parts are planned at half the limit. One that exceeds it nevertheless is dealt out again, by another hash.
    """
    stored = write_table(found, "windows")

    def parts(rows: DataFrame, depth: int) -> Iterator[list[tuple[str, int | None]]]:
        count = rows.count()
        if count <= block_windows:
            yield [tuple(r) for r in rows.collect()]
            return
        n = -(-2 * count // block_windows)
        place = F.pmod(F.xxhash64(F.lit(depth), "window", "item_id"), F.lit(n))
        for part in range(n):
            yield from parts(rows.where(place == part), depth + 1)

    return parts(stored, 0)


def found_columns(kind: T.DataType) -> dict[str, str]:
    """What is added to a document, for item ids of the given type."""
    return {"n_words": FOUND["n_words"], "n_hit": FOUND["n_hit"], "item_ids": f"array<{kind.simpleString()}>", "spans": FOUND["spans"]}


def _scan(rows: DataFrame, windows_here: list[tuple[str, int | None]], kind: T.DataType) -> DataFrame:
    """Adds what one automaton finds to ``rows``, whose struct column ``row`` holds the text."""
    shared = rows.sparkSession.sparkContext.broadcast(windows_here)
    names, columns, arrow_kind = rows.columns, found_columns(kind), to_arrow_type(kind)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        for batch in batches:
            found: list[tuple] = []
            for raw in utf8(batch.column("row").field("text")):
                items = normal_words(raw)
                hits = scanner.hits(items)
                spans = merged(hits)
                ids = sorted({i for h in hits for i in h[2]})
                places = offsets(raw.decode("utf-8", "surrogatepass"), spans) if spans else []
                found.append((len(items), sum(b - a + 1 for a, b in spans), ids, places))
            counts, hit, ids, places = zip(*found) if found else ((), (), (), ())
            added = [
                pa.array(counts, pa.int64()),
                pa.array(hit, pa.int64()),
                pa.array(ids, pa.list_(arrow_kind)),
                pa.array(places, pa.list_(pa.struct([(n, pa.int32()) for n in ("first", "last", "start", "end")]))),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + added, names=[*names, *columns])

    return rows.mapInArrow(scanned, extended(rows.schema, columns))


def contamination(
    documents: DataFrame, benchmark: DataFrame, columns: list[str] | None = None, block_windows: int = BLOCK_WINDOWS
) -> DataFrame:
    """``row`` (the named columns of the document as a struct, all by default) with ``n_words, n_hit, item_ids, spans``.

    ``n_hit`` counts words inside any occurrence of a window, ``item_ids`` lists the items found once each (an item
    without an id hits, but cannot be listed), ``spans`` are the hit stretches by words and by code points of the original text.

    One automaton means one pass and no shuffle. With several, the finds of the others are joined on by id and text,
    where repeated rows find the same. An empty benchmark finds nothing; a null or empty text has no words; a very long text is
    scanned whole. The document's own columns are in the struct, so none can clash.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in (columns or documents.columns)))
    rows = documents.select(row.alias("row"))
    kind = benchmark.schema["item_id"].dataType
    blocks = _blocks(windows(benchmark), block_windows)
    first = _scan(rows, next(blocks), kind)
    others = [_scan(rows, block, kind).where("n_hit > 0") for block in blocks]
    if not others:
        return first
    keyed = first.select("*", *key_columns("row.doc_id", "row.text"))
    others = reduce(DataFrame.unionByName, others).select(*key_columns("row.doc_id", "row.text"), "item_ids", "spans")
    others = others.groupBy(*KEY).agg(
        F.flatten(F.collect_set("item_ids")).alias("more_ids"), F.flatten(F.collect_set("spans")).alias("more_spans")
    )
    joined = keyed.join(others, KEY, "left")
    both = lambda a, b: F.concat(a, F.coalesce(b, F.array().cast(found_columns(kind)[a])))
    joined = joined.withColumns({"item_ids": F.array_sort(F.array_distinct(both("item_ids", "more_ids"))), "spans": both("spans", "more_spans")})
    hit = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["last"]))))
    return joined.select("row", "n_words", F.size(hit).cast("long").alias("n_hit"), "item_ids", "spans")


def clean_documents(documents: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The documents without any benchmark window, with all their columns.

    Null and empty texts hold none and stay, as do repeated rows without a window; an empty table stays empty.
    """
    return contamination(documents, benchmark, None, block_windows).where("n_hit = 0").select("row.*")

"""Spelling variants by finite-state composition (operator 13).

Two words are near if one inserted, deleted or replaced code point makes one of the other. Near pairs are the pairs accepted by
the vocabulary's acceptor, composed with a one-edit transducer, composed with the acceptor again. Before the edit both words
take the same arcs and after it they take the same labels, so the composition falls apart by the state that the common start
leads to (and, as words that share their end can be read backwards, by their end).

A pair's edit lies where its words first differ, at a place from 0 to c, the length of its shorter word. Places are cut
into windows; words that can meet with their edit in a window share what is before and behind it. Those words are one
partition, with one minimised acceptor of what lies inside. Windows of crowded partitions are halved until no partition
is large, so every pair is found in exactly one of them, and no task holds the vocabulary.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmill.llm.text import KEY, key_columns
from boxmill.session import write_table

MIN_LENGTH = 7
MIN_COUNT = 2
# A word's form occurs at least so many times as often.
FORM_RATIO = 10
# One in so many runs of a document loses a code point.
DAMAGED = 31

# Words in one partition; windows of larger ones are halved. In a window of one place words differ in two code points at
# most, so with an alphabet of 116 such a partition stays below this anyway.
PARTITION_WORDS = 20_000

# Entries of one batch that a task sends on.
AT_ONCE = 50_000

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def word_counts(doc_id: int | None, text: str | None) -> Counter[str]:
    """The words of one text that are long enough, lower-cased A-Z only, some of them with a code point deleted.

    Which ones follows from the CRC-32 of id and word; a null id counts as empty, a null text has no words.
    """
    found: Counter[str] = Counter()
    label = "" if doc_id is None else str(doc_id)
    for run, n in Counter(RUN.findall((text or "").translate(_LOWER))).items():
        if len(run) < MIN_LENGTH:
            continue
        drawn = zlib.crc32(f"{label}:{run}".encode())
        if drawn % DAMAGED == 0:
            at = drawn % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < MIN_LENGTH:
                continue
        found[run] += n
    return found


def vocabulary(documents: DataFrame) -> DataFrame:
    """``word, n``: the different words with their occurrences, from ``MIN_COUNT`` on. Tasks add up before the shuffle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["word", "n"]
        found: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                found.update(word_counts(doc_id, text.as_py()))
                if len(found) >= AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=names)
                    found.clear()
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=names)

    counted = documents.select("doc_id", "text").mapInArrow(rows, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


class Acceptor:
    """The minimised acyclic acceptor of sorted, different strings; state 0 is the initial one."""

    def __init__(self, strings: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [False]
        known: dict[tuple, int] = {}
        # The states along the last string are still open; what lies behind a branch is finished and merged with its equal.
        path, last = [0], ""

        def finish(depth: int) -> None:
            while len(path) - 1 > depth:
                state = path.pop()
                same = known.setdefault((self.final[state], tuple(self.arcs[state].items())), state)
                self.arcs[path[-1]][last[len(path) - 1]] = same

        for string in strings:
            shared = _common(last, string)
            finish(shared)
            for letter in string[shared:]:
                self.arcs[path[-1]][letter] = len(self.arcs)
                path.append(len(self.arcs))
                self.arcs.append({})
                self.final.append(False)
            self.final[path[-1]] = True
            last = string
        finish(0)

    def shared_ends(self, p: int, q: int, but: str = "") -> Iterator[str]:
        """Strings accepted from both states, without those that start with the letter ``but``."""
        arcs, final = self.arcs, self.final
        if final[p] and final[q]:
            yield ""
        letters: list[str] = []
        stack = [(a, arcs[p][a], arcs[q][a], 0) for a in arcs[p] if a in arcs[q] and a != but]
        while stack:
            letter, p, q, depth = stack.pop()
            del letters[depth:]
            letters.append(letter)
            if final[p] and final[q]:
                yield "".join(letters)
            other = arcs[q]
            stack += [(a, s, other[a], depth + 1) for a, s in arcs[p].items() if a in other]

    def edits(self, state: int) -> list[tuple[str, str]]:
        """Pairs of strings accepted from ``state`` that are one edit apart and differ in their first letters (or the first is empty).

        A shorter string stands first.
        """
        arcs = list(self.arcs[state].items())
        found = []
        for k, (a, p) in enumerate(arcs):
            found += [(end, a + end) for end in self.shared_ends(state, p, but=a)]
            for b, q in arcs[k + 1 :]:
                found += [(a + end, b + end) for end in self.shared_ends(p, q)]
        return found

    def near_pairs(self, places: int) -> Iterator[tuple[str, str]]:
        """All accepted pairs one edit apart that first differ within the first ``places`` places; a shorter string first."""
        known: dict[int, list[tuple[str, str]]] = {}
        letters: list[str] = []
        stack = [("", 0, -1)]
        while stack:
            letter, state, depth = stack.pop()
            if depth >= 0:
                del letters[depth:]
                letters.append(letter)
            if len(self.arcs[state]) > 1 or self.final[state]:
                if state not in known:
                    known[state] = self.edits(state)
                if known[state]:
                    start = "".join(letters)
                    for a, b in known[state]:
                        yield start + a, start + b
            if depth + 2 < places:
                stack += [(a, s, depth + 1) for a, s in self.arcs[state].items()]


def _common(a: str, b: str) -> int:
    """The length of the common start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(k for k in range(n) if a[k] != b[k])


def partition_pairs(short: int, low: int, high: int, words: list[str]) -> Iterator[tuple[str, str]]:
    """Near pairs of words whose shorter one has ``short`` code points and whose edit lies in the window from ``low`` below ``high``.

    The words share their start before the window and their end behind it, and have ``short`` code points or one more.
    """
    behind = max(short - high, 0)
    start, end = words[0][:low], words[0][len(words[0]) - behind :]
    inside = sorted({w[low : len(w) - behind] for w in words})
    if len(inside) < 2:
        return
    width = short - low - behind
    for a, b in Acceptor(inside).near_pairs(high - low):
        # Two longer words meet in the windows of their own length.
        if len(a) == width:
            yield start + a + end, start + b + end


def _found(rows: list[tuple[int, int, int, str, int]]) -> Iterator[tuple[str, int, str, int]]:
    """Near words, each pair in both directions, of the rows of one partition key."""
    parts: dict[tuple, dict[str, int]] = defaultdict(dict)
    for short, low, high, word, n in rows:
        # The key is a hash, so what it stands for is compared again.
        parts[short, low, high, word[:low], word[len(word) - max(short - high, 0) :]][word] = n
    for (short, low, high, _, _), words in parts.items():
        if len(words) > 1:
            for a, b in partition_pairs(short, low, high, list(words)):
                yield a, words[a], b, words[b]
                yield b, words[b], a, words[a]


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of rows that come sorted by partition key."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])
    out: list[tuple[str, int, str, int]] = []

    def ready(least: int) -> Iterator[pa.RecordBatch]:
        if len(out) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
            out.clear()

    last, own = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*KEY, "short", "low", "high", "word", "n")]
        for key_a, key_b, *row in zip(*columns):
            if (key_a, key_b) != last:
                if len(own) > 1:
                    for found in _found(own):
                        out.append(found)
                        yield from ready(AT_ONCE)
                last, own = (key_a, key_b), []
            own.append(row)
    for found in _found(own):
        out.append(found)
        yield from ready(AT_ONCE)
    yield from ready(1)


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds the partition key to ``word, n, short, low, high``: what lies before and behind the window."""
    behind = F.greatest(F.col("short") - F.col("high"), F.lit(0))
    end = F.substring("word", F.length("word") - behind + 1, behind)
    start = F.substring("word", F.lit(1), F.col("low"))
    return rows.select("word", "n", "short", "low", "high", *key_columns("short", "low", "high", start, end))


def _halved(low, high):
    middle = F.floor((low + high) / 2).cast("int")
    return F.array(F.struct(low.alias("low"), middle.alias("high")), F.struct(middle.alias("low"), high.alias("high")))


def partitions(words: DataFrame, partition_words: int = PARTITION_WORDS) -> DataFrame:
    """``word, n, short, low, high`` with the key of the partition; no key has more rows than given, unless its window is one place.

    A word of length L takes part with words of its length and one more (``short`` is L), and as the longer one of a pair (L - 1).
    """
    length = F.length("word")
    both = F.filter(F.array(length, length - 1), lambda c: c >= MIN_LENGTH)
    rows = words.select("word", "n", F.explode(both).alias("short"))
    rows = rows.select("word", "n", "short", F.inline(_halved(F.lit(0), F.col("short") + 1)))
    done = []
    while True:
        keyed = write_table(_keyed(rows), "windows")
        crowded = keyed.where("high - low > 1").groupBy(*KEY).count().where(F.col("count") > partition_words)
        # Written out, so that both sides of the joins are dealt anew and Spark can split a crowded key.
        crowded = write_table(crowded.select(*KEY), "crowded")
        if crowded.isEmpty():
            break
        done.append(keyed.join(crowded, KEY, "left_anti"))
        again = keyed.join(crowded, KEY, "left_semi")
        rows = again.select("word", "n", "short", F.inline(_halved(F.col("low"), F.col("high"))))
    for part in done:
        keyed = keyed.unionByName(part)
    return keyed


def near_words(words: DataFrame, partition_words: int = PARTITION_WORDS) -> DataFrame:
    """``word, n, near, near_n``: every pair of words that are one edit apart, once in each direction.

    ``words`` has different words of at least ``MIN_LENGTH`` code points in ``word``, and ``n``.
    """
    dealt = partitions(words, partition_words).repartition(*KEY).sortWithinPartitions(*KEY)
    return dealt.mapInArrow(_composed, "word string, n long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the last word of each word's chain of forms, by pointer doubling.

    A form is ten times as frequent as its word, so chains are short and never closed.
    """
    found = write_table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = found.join(further, "root", "left")
        found = write_table(joined.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if found.where("moved").isEmpty():
            return found.select("word", "root")
        found = found.select("word", "root")


def spelling_groups(documents: DataFrame, partition_words: int = PARTITION_WORDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word with at least 7 code points and 2 occurrences.

    ``form`` is the most frequent near word (of equally frequent ones the first in code-point order) if it occurs at least ten
    times as often, else null; ``root`` is the end of the chain of forms, the word itself without one. A null or empty text has no
    words, a null id counts as empty, repeated rows count again, and a very long run is a word like any other. Other columns
    are not read. An empty table gives an empty result.
    """
    words = write_table(vocabulary(documents), "vocabulary")
    # Strings compare by code points, so the smallest struct is the most frequent near word.
    first = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    best = near_words(words, partition_words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), first.alias("first"))
    joined = words.join(best, "word", "left")
    common = -F.col("first.less") >= FORM_RATIO * F.col("n")
    joined = joined.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(common, F.col("first.near")).alias("form"),
        F.when(common, -F.col("first.less")).alias("form_n"),
    )
    found = write_table(joined, "forms")
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

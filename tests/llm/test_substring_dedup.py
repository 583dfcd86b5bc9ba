import re
from functools import lru_cache

import pytest

from boxmill.llm import substring_dedup
from boxmill.llm.queries import QUERIES
from boxmill.llm.text import key_columns
from tests.llm import cases

SF_DIR = "/root/testdata/sf0.001"


PATTERNS = {"paragraph": r"[^\n]+(?:\n[^\n]+)*", "line": r"[^\n]+", "sentence": r"[^.!?\n]+[.!?]*"}
KINDS = tuple(PATTERNS)
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))


@lru_cache(100_000)
def plain_units(text, kind):
    return [(m.start(), m.end(), split(m[0])) for m in re.finditer(PATTERNS[kind], text or "") if split(m[0])]


def beside(text, start, end):
    """The eight words next to a place, each from one sentence."""
    sentences = plain_units(text, "sentence")
    before = [w for a, _, w in sentences if a < start][-1:]
    after = [w for a, _, w in sentences if a >= end][:1]
    return [before[0][-8:] if before and len(before[0]) >= 8 else None, after[0][:8] if after and len(after[0]) >= 8 else None]


def slow(docs, kinds, min_words):
    """Texts after removal, by walking all documents in rank order; rows that agree in id and text are one occurrence."""
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0, key_rank(docs[k])))
    seen, out = {}, [None] * len(docs)
    for k in order:
        text = docs[k][1]
        for _, start, end, w in sorted((a + len(text[a:b]) - len(text[a:b].lstrip(" \t\n\v\f\r")), a, b, w) for kind in kinds for a, b, w in plain_units(text, kind)):
            seen.setdefault(tuple(w), (docs[k], start, beside(text, start, end)))
    for k in order:
        text, gone = docs[k][1], set()
        for kind in kinds:
            run = []
            for unit in [*plain_units(text, kind), None]:
                first = unit and seen[tuple(unit[2])]
                if unit and first[:2] != (docs[k], unit[0]):
                    same = [x is not None and x == y for x, y in zip(first[2], beside(text, *unit[:2]))]
                    run.append((unit, same))
                    continue
                if run and sum(len(u[2]) for u, _ in run) + 8 * (run[0][1][0] + run[-1][1][1]) >= min_words:
                    gone.update(range(run[0][0][0], run[-1][0][1]))
                run = []
        spans = []
        for place in sorted(gone):
            if spans and spans[-1][1] == place:
                spans[-1][1] = place + 1
            else:
                spans.append([place, place + 1])
        out[k] = (text if text is None else "".join(c for place, c in enumerate(text) if place not in gone), [tuple(s) for s in spans])
    return out


def key_rank(doc):
    return KEYS.get(doc, 0)


KEYS = {}


@pytest.mark.parametrize("kinds, min_words", [(KINDS, 25), (KINDS, 1), (("sentence",), 30), (("line",), 5), (("paragraph",), 1)])
def test_equals_a_walk_in_rank_order(spark, kinds, min_words):
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    docs = [tuple(r) for r in table.collect()]
    expected = {d[0]: e for d, e in zip(docs, slow(docs, kinds, min_words))}
    rows = substring_dedup.deduplicated(table, kinds, min_words).collect()
    assert {r["doc_id"]: (r["text"], [tuple(s) for s in r["removed_spans"]]) for r in rows} == expected
    assert any(r["removed_spans"] for r in rows)


def test_query_shows_what_it_cut(spark):
    texts = dict(map(tuple, spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()))
    for r in QUERIES["op1_substring_dedup"](spark, SF_DIR).collect():
        spans = [tuple(map(int, s.split("-"))) for s in r["removed_spans"].split(",") if s]
        text = texts[r["doc_id"]]
        assert r["removed_chars"] == sum(b - a for a, b in spans) == len(text) - len(r["text"])


def test_common_phrases_stay_and_long_passages_go(spark):
    phrase = "All rights reserved."
    passage = " ".join(f"word{i}" for i in range(55)) + "."
    docs = [(1, f"Alpha first. {passage} More of one. {phrase}"), (2, f"Beta second. {passage} More of two. {phrase}"), (3, f"Gamma. {phrase}")]
    rows = substring_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == {1: docs[0][1], 2: f"Beta second. More of two. {phrase}", 3: docs[2][1]}


def test_equal_words_beside_a_run_count(spark):
    """A passage of 51 words whose first and last sentence are fused with what surrounds them."""
    first, middle, last = (" ".join(f"{name}{i}" for i in range(17)) for name in ("head", "body", "tail"))
    docs = [(1, f"one starts so {first}. {middle}. {last} and ends."), (2, f"two {first}. {middle}. {last}"), (3, f"three. {middle}. other words"), (4, "clean text")]
    rows = substring_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == {1: docs[0][1], 2: f"two {first}.. {last}".replace("..", "."), 3: docs[2][1], 4: "clean text"}


def test_wrapped_paragraphs_and_lines(spark):
    words = [f"w{i}" for i in range(40)]
    flat, wrapped = " ".join(words), "\n".join(" ".join(words[k : k + 10]) for k in range(0, 40, 10))
    docs = [(1, f"Title\n\n{flat}\n\nEnd of one"), (2, f"Other\n\n{wrapped}\n\nEnd of two")]
    rows = substring_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == {1: docs[0][1], 2: "Other\n\n\n\nEnd of two"}
    rows = substring_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string"), ("line", "sentence")).collect()
    assert not any(r["removed_spans"] for r in rows)


def test_awkward_rows(spark):
    df = cases.documents(spark, clashing=True)
    rows = substring_dedup.deduplicated(df, min_words=5).collect()
    docs = [(d, t) for d, t, *_ in cases.rows()]
    KEYS.update({(r["doc_id"], r["text"]): r["key_a"] for r in df.select("doc_id", "text", *key_columns("doc_id", "text")).collect()})
    long = {t for _, t in docs if t == cases.LONG}
    expected = slow([(d, t) for d, t in docs if t not in long], KINDS, 5)
    assert sorted((repr(r["doc_id"]), repr(r["text"])) for r in rows if r["doc_id"] != 8) == sorted((repr(d), repr(e[0])) for (d, _), e in zip((x for x in docs if x[1] not in long), expected))
    assert substring_dedup.deduplicated(cases.empty(spark)).count() == 0
    (cut,) = [r for r in rows if r["doc_id"] == 8]
    # Sentence i of the long text repeats sentence i - 9000.
    assert cut["n_units"] == 30_001 and cut["n_removed"] == 21_000

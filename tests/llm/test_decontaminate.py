import re

import pytest

from boxmill.llm import decontaminate
from tests.llm import cases

ITEMS = [
    (1, "One two three four five six seven eight nine ten eleven twelve"),
    (2, "short Item here"),
    (3, None),
    (4, "...!"),
    (None, "nameless short item"),
    (5, "one two three four five six seven eight nine ten"),
    (5, "one two three four five six seven eight nine ten"),
    (6, "naïve straße"),
]
TEXTS = [
    "ONE, two three; four five six seven eight nine ten!",
    "x one two three four five six seven eight nine ten eleven twelve one",
    "A short item here, and a nameless short item. Short item HERE",
    "Naïve STRAßE naïve-straße",
    "two three four five six seven eight nine ten",
    "NAÏVE straße",
    None,
    "",
    "here short item",
]
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def slow(text, items):
    own = split(text)
    hit, found = set(), set()
    for item, words in items:
        words = split(words)
        for k in range(max(1, len(words) - 9)) if words else ():
            window = words[k : k + 10]
            for i in range(len(own) - len(window) + 1):
                if own[i : i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    found.add(item)
    return len(own), len(hit), sorted(found - {None})


@pytest.fixture(scope="module")
def benchmark_table(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WINDOWS, 8])
def test_equals_plain_search_in_one_block_and_in_several(spark, benchmark_table, block):
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(0, TEXTS[0])], "doc_id long, text string")
    rows = decontaminate.contamination(docs, benchmark_table, None, block).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        assert (r["n_words"], r["n_hit"], r["item_ids"]) == slow(r["row"]["text"], ITEMS)
        inside = {i for s in r["spans"] for i in range(s["first"], s["last"] + 1)}
        assert len(inside) == r["n_hit"]
        for s in r["spans"]:
            assert split(r["row"]["text"][s["start"] : s["end"]]) == split(r["row"]["text"])[s["first"] : s["last"] + 1]


def test_awkward_rows(spark, benchmark_table):
    df = cases.documents(spark, clashing=True)
    empty_benchmark = spark.createDataFrame([], "item_id long, text string")
    for bench, block in ((benchmark_table, 8), (benchmark_table, 50_000), (empty_benchmark, 50_000)):
        clean = decontaminate.clean_documents(df, bench, block)
        assert clean.columns == df.columns and clean.count() == len(cases.rows())
    one = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.clean_documents(df, one).count() == len(cases.rows()) - 1
    assert decontaminate.clean_documents(cases.empty(spark), benchmark_table).count() == 0


def test_ids_may_be_texts(spark):
    items = spark.createDataFrame([("q-2", "one two three four"), ("q-10", "five six seven"), (None, "eight nine")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "zero one two three four five six seven"), (2, "eight nine"), (3, "none")], "doc_id long, text string")
    rows = {r["row"]["doc_id"]: r for r in decontaminate.contamination(docs, items).collect()}
    assert rows[1]["item_ids"] == ["q-10", "q-2"] and rows[1]["n_hit"] == 7
    assert rows[2]["item_ids"] == [] and rows[2]["n_hit"] == 2 and rows[3]["n_hit"] == 0
    several = {r["row"]["doc_id"]: r["item_ids"] for r in decontaminate.contamination(docs, items, block_windows=2).collect()}
    assert several == {1: ["q-10", "q-2"], 2: [], 3: []}


def test_crowded_parts_are_dealt_out_again(spark):
    found = spark.range(20).selectExpr("concat('window ', id) AS window", "id AS item_id")
    parts = list(decontaminate._blocks(found, 1))
    assert all(len(p) <= 1 for p in parts) and len(parts) > 40
    assert sorted(r for p in parts for r in p) == sorted(tuple(r) for r in found.collect())
    assert list(decontaminate._blocks(found.limit(0), 3)) == [[]]

import hashlib
import random

import pytest

from boxmill.llm import content_sort
from boxmill.llm.queries import op12_content_sort
from tests.llm import cases

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow(rows):
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row, sorted; of equal rows one is kept."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault((text or "").translate(_LOWER), []).append(doc_id)
    found = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        stays = True
        for i in sorted(ids, key=lambda i: (i is not None, i)):
            found.append((i, keep, len(ids), stays and i == keep, digest))
            stays = stays and i != keep
    return sorted(found, key=repr)


def ours(df):
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert df.columns == columns
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
def test_equals_brute_force(spark, ranges):
    """A third of all rows is one text; many share a long head."""
    rng = random.Random(ranges)
    head = "the same start of very many texts, longer than what a place holds of it, "
    texts = ["One Text That Is Copied Very Often " * 5] * 120
    texts += [head + str(rng.randrange(60)) for _ in range(120)] + [head.upper() + str(rng.randrange(60)) for _ in range(60)]
    texts += ["", None, "É", "é", "a", "A", "ab", "a b", "a\x00b", "\U0001f600", "￿"] * 5
    rng.shuffle(texts)
    rows = [(i * 7 % 1000, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert ours(content_sort.exact_groups(df, ranges)) == slow(rows)


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    """With one hash for all texts and ids, only whole texts decide."""
    rng = random.Random(5)
    rows = [(i, "same head of all the texts in this table " + rng.choice("abcdef")) for i in range(200)]
    plain = content_sort.F.xxhash64
    monkeypatch.setattr(content_sort.F, "xxhash64", lambda c: plain(c) % 3 if c == "doc_id" else plain(content_sort.F.lit(0)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ours(content_sort.exact_groups(df, 6)) == slow(rows)


def test_repeated_rows_and_missing_ids(spark):
    rows = [(1, "x")] * 5 + [(None, "x")] * 3 + [(None, "y")] * 4 + [(2, None), (2, ""), (None, "")]
    for ranges in (1, 4):
        assert ours(content_sort.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), ranges)) == slow(rows)


def test_awkward_rows(spark):
    for clashing in (False, True):
        found = ours(content_sort.exact_groups(cases.documents(spark, clashing), 5))
        assert found == slow([r[:2] for r in cases.rows()])
    assert ours(content_sort.exact_groups(cases.empty(spark))) == []


def test_ranges_are_even_though_one_text_is_frequent(spark):
    rows = [(i, "copy" if i % 3 == 0 else f"text number {i}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = [r["count"] for r in content_sort.parts(df, 12).groupBy("range").count().collect()]
    assert len(sizes) == 12 and max(sizes) < 2 * 6000 / 12


def test_no_python_in_the_plan(spark):
    df = op12_content_sort(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    own = content_sort.parts(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), 8)
    plan += own._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
    # The texts move once; windows keep the ranges.
    assert own._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1

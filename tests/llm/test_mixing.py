import math
from collections import Counter, defaultdict

import pytest

from boxmill.llm import mixing
from boxmill.llm.oracle import ORACLE
from boxmill.llm.queries import QUERIES
from tests import oracle
from tests.llm import cases

SF_DIR = "/root/testdata/sf0.01"


def slow_targets(sizes):
    """Share by weight, stop at three times the size, share the excess again, until nothing is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, full, rest = dict.fromkeys(order, 0.0), set(), float(sum(sizes.values()))
    while rest > 1e-9:
        free = [s for s in order if s not in full]
        share = rest / sum(weight[s] for s in free)
        for s in free:
            target[s] += share * weight[s]
        rest = 0.0
        for s in free:
            if target[s] >= 3 * sizes[s]:
                rest += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                full.add(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 1000}, {"a": 1, "b": 1, "c": 1, "d": 997, None: 0}, {"x": 5}, {"a": 0, "b": 0}, {"é": 30, "z": 30, None: 40}])
def test_targets_equal_sharing_again_and_again(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    ours = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert ours == pytest.approx(slow_targets(sizes))


def test_query_equals_sql(spark):
    name = "op7_source_mixing"
    assert oracle.differences(spark, oracle.connect(SF_DIR), QUERIES[name], ORACLE[name], SF_DIR) is None


def test_words_taken_are_near_the_target_and_reruns_agree(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = mixing.copies(docs).collect()
    taken, largest = Counter(), defaultdict(int)
    for r in rows:
        taken[r["source"]] += r["copies"] * r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert 0 <= r["copies"] <= 3
    for r in rows:
        assert abs(taken[r["source"]] - r["target"]) <= 2 * largest[r["source"]]
    again = mixing.copies(docs.repartition(13).orderBy("n_chars")).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_mixed_rows_are_the_copies(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    counts = {r["doc_id"]: r["copies"] for r in mixing.copies(docs).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in mixing.mixed(docs).select("doc_id").collect()) == counts
    assert mixing.mixed(docs).columns == docs.columns


def test_awkward_rows(spark):
    df = cases.documents(spark, clashing=True)
    rows = mixing.copies(df).collect()
    assert len(rows) == len(cases.rows())
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.copies(cases.empty(spark)).count() == mixing.mixed(cases.empty(spark)).count() == 0
    assert all(math.isfinite(r["target"]) for r in rows)

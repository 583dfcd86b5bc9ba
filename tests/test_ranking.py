import numpy as np
import pytest
from pyspark.sql import functions as F

from boxmill import session
from boxmill.operators.ranking import percentile_within, row_number_within, top_rows
from boxmill.operators.splitting import grouped_split, random_rows, shuffle_key, stratified_split, train_val_split


@pytest.fixture
def skewed(spark):
    rng = np.random.default_rng(0)
    keys = np.where(rng.random(3000) < 0.4, 0, rng.integers(1, 40, 3000))
    rows = [(int(k), int(v), i) for i, (k, v) in enumerate(zip(keys, rng.integers(0, 500, 3000)))]
    return spark.createDataFrame(rows, "k int, v int, id int"), rows


def expected_ranks(rows):
    groups = {}
    for k, v, i in sorted(rows):
        groups[k] = groups.get(k, 0) + 1
        yield k, v, i, groups[k]


@pytest.mark.parametrize("task_rows", [100_000, 100, 0])
def test_row_number(spark, skewed, task_rows):
    df, rows = skewed
    found = row_number_within(df, ["k"], [F.col("v"), F.col("id")], "rn", task_rows).collect()
    assert sorted(map(tuple, found)) == sorted(expected_ranks(rows))


def test_row_number_with_helper_tables_on_disk(spark, skewed, monkeypatch):
    # With no room on the driver the helper tables are written and joined by shuffle.
    monkeypatch.setattr(session, "MAX_LISTED_ROWS", 1)
    df, rows = skewed
    found = row_number_within(df, ["k"], [F.col("v"), F.col("id")], "rn", 50).collect()
    assert sorted(map(tuple, found)) == sorted(expected_ranks(rows))


@pytest.mark.parametrize("task_rows", [100_000, 100])
def test_percentile(spark, skewed, task_rows):
    df, rows = skewed
    found = percentile_within(df.select("k", F.col("v").cast("double").alias("v")), ["k"], "v", 0.1, "p", task_rows)
    expected = {k: np.percentile([v for key, v, _ in rows if key == k], 10) for k in {r[0] for r in rows}}
    assert {r["k"]: r["p"] for r in found.collect()} == pytest.approx(expected)


def test_top_rows_cut_groups_before_the_shuffle(spark, skewed, capsys):
    df, _ = skewed
    top = top_rows(df, ["k"], [F.col("v").desc(), F.col("id")], 3)
    assert top.groupBy("k").count().agg(F.max("count")).first()[0] == 3
    top.explain()
    assert "WindowGroupLimit" in capsys.readouterr().out


def test_splits(spark):
    df = spark.range(1003).withColumn("label", (F.col("id") % 5 == 0).cast("int")).withColumn("image", F.col("id") % 97)
    parts = train_val_split(df, F.col("id"), seed=1).groupBy("subset").count().collect()
    assert {r["subset"]: r["count"] for r in parts} == {"train": 802, "val": 201}
    by_label = stratified_split(df, F.col("id")).filter("subset = 'test'").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in by_label} == {0: 161, 1: 41}
    sides = grouped_split(df, "image").groupBy("image").agg(F.count_distinct("subset").alias("n"))
    assert sides.filter("n > 1").count() == 0
    first = random_rows(df, F.col("id"), 3, seed=5).collect()
    assert first == df.orderBy(shuffle_key(5, F.col("id"))).limit(3).collect()


@pytest.mark.parametrize("task_rows", [100_000, 20])
def test_percentile_of_odd_values(spark, task_rows):
    """Null groups, null values, ties, huge and tiny numbers, infinities: one result for all limits."""
    rng = np.random.default_rng(3)
    rows = [(None, float(v)) for v in rng.integers(0, 9, 200)] + [(1, None)] * 5 + [(2, 4.0)]
    rows += [(3, float(v)) for v in np.exp(rng.normal(0, 200, 150))] + [(4, 1e308), (4, -1e308), (4, 0.0), (4, 5e-324)] * 20
    rows += [(5, float("-inf"))] * 10 + [(5, 1.0)] * 80 + [(5, 2.0)] * 10 + [(5, float("inf"))] * 50
    df = spark.createDataFrame(rows, "k int, v double").repartition(4)
    for fraction in (0.1, 1.0):
        found = {r["k"]: r["p"] for r in percentile_within(df, ["k"], "v", fraction, "p", task_rows).collect()}
        assert set(found) == {None, 1, 2, 3, 4, 5} and found[1] is None
        for k in (None, 2, 3, 4, 5):
            values = sorted(v for key, v in rows if key == k)
            place = (len(values) - 1) * fraction
            low, weight = int(place), place - int(place)
            expected = (1 - weight) * values[low] + weight * values[low + 1] if weight else values[low]
            assert found[k] == pytest.approx(expected, rel=1e-12) or (np.isnan(expected) and np.isnan(found[k]))


@pytest.mark.parametrize("task_rows", [100_000, 2])
def test_null_groups_keep_their_rows(spark, task_rows):
    df = spark.createDataFrame([(k if k % 2 else None, k) for k in range(12)], "k int, v int")
    found = row_number_within(df, ["k"], [F.col("v")], "rn", task_rows).collect()
    assert len(found) == 12
    assert sorted(r["rn"] for r in found if r["k"] is None) == [1, 2, 3, 4, 5, 6]


def test_splits_keep_rows_with_null_keys(spark):
    df = spark.createDataFrame([(None, 1, 0), (None, 2, 1), (3, 1, None), (4, None, None), (5, 2, 1)], "id int, image int, label int")
    for split in (
        train_val_split(df, F.col("id"), 1),
        stratified_split(df, F.col("id")),
        grouped_split(df, "image"),
    ):
        assert split.columns == ["id", "image", "label", "subset"]
        assert split.count() == 5 and split.where("subset IS NULL").count() == 0
    sides = grouped_split(df.unionByName(df), "image").groupBy("image").agg(F.count_distinct("subset").alias("n"))
    assert sides.where("n > 1").count() == 0

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from boxmill.llm import components, simhash
from boxmill.llm.queries import QUERIES
from tests.llm import cases

SF_DIR = "/root/testdata/sf0.001"


def slow_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    items = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not items:
        return 0
    shingles = [" ".join(items[i : i + 4]) for i in range(max(1, len(items) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def slow_components(values):
    """Smallest reachable value of each, by comparing all pairs."""
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    listed = sorted(values)
    for i, a in enumerate(listed):
        for b in listed[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {v: root(v) for v in values}


def slow_documents(docs):
    prints = [slow_fingerprint(t) for _, t in docs]
    groups = slow_components(set(prints))
    least = {}
    for (doc_id, _), p in zip(docs, prints):
        if doc_id is not None:
            least[groups[p]] = min(least.get(groups[p], doc_id), doc_id)
    return sorted((repr(d), f"{p:016x}", repr(least.get(groups[p]))) for (d, _), p in zip(docs, prints))


def test_query_equals_all_pairs(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    ours = QUERIES["op4_simhash_near_dedup"](spark, SF_DIR).collect()
    assert sorted((repr(r[0]), r[1], repr(r[2])) for r in ours) == slow_documents(docs)


def test_awkward_rows(spark):
    ours = simhash.with_component(cases.documents(spark, clashing=True)).collect()
    assert sorted((repr(r[0]), r[1], repr(r[2])) for r in ours) == slow_documents([r[:2] for r in cases.rows()])
    assert simhash.with_component(cases.empty(spark)).count() == 0


def test_home_lies_within_radius_and_neighbours_meet_there():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 300, dtype=np.uint64)
    for flips in range(1, 5):
        other = values.copy()
        for k in range(len(other)):
            for bit in rng.choice(64, flips, replace=False):
                other[k] ^= np.uint64(1) << np.uint64(bit)
        place, guest, row = simhash.anchors(values)
        homes = [set() for _ in values]
        for p, r in zip(place[guest == 0], row[guest == 0]):
            homes[r].add(p)
        place, guest, row = simhash.anchors(other)
        around = [set() for _ in values]
        for p, r in zip(place[guest == 1], row[guest == 1]):
            around[r].add(p)
        assert all(h & a for h, a in zip(homes, around))


def crowd(seed=5, n=1500):
    """Clusters around a few centres, some chained."""
    rng = random.Random(seed)
    found = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(n // 8):
            v = centre
            for bit in rng.sample(range(64), rng.randint(0, 6)):
                v ^= 1 << bit
            found.add(v)
            if rng.random() < 0.02:
                centre = v
    found |= {rng.getrandbits(64) for _ in range(n // 4)}
    return found


def signed(v):
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("home_rows", [simhash.HOME_ROWS, 7])
def test_crowded_homes_give_the_same_components(spark, monkeypatch, home_rows):
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 500 if home_rows == 7 else simhash.PAIRS_AT_ONCE)
    values = crowd()
    df = spark.createDataFrame([(signed(v),) for v in values], "fingerprint long").repartition(5)
    roots = {r["node"]: r["root"] for r in components.connected_components(simhash.links(df, home_rows)).collect()}
    groups = {}
    for v, root in slow_components(values).items():
        groups.setdefault(root, set()).add(signed(v))
    ours = {}
    for v in map(signed, values):
        ours.setdefault(roots.get(v, v), set()).add(v)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, groups.values()))


def test_links_stay_few_in_a_crowd(spark):
    """About as many links as members and meetings, not as pairs."""
    centre = random.Random(1).getrandbits(64)
    values = {centre} | {centre ^ 1 << i ^ 1 << j for i in range(64) for j in range(i)}
    df = spark.createDataFrame([(signed(v),) for v in values], "fingerprint long")
    assert simhash.links(df).count() < 40 * len(values) < len(values) ** 2 / 2


def test_long_chain(spark):
    edges = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    roots = components.connected_components(edges).collect()
    assert {r["root"] for r in roots} == {0} and len(roots) == 400


def test_spanning_links():
    a, b = components.spanning_links(np.array([5, 7, 9, 2, 7]), np.array([7, 9, 5, 3, 5]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(3, 2), (7, 5), (9, 5)]


def test_stage_keeps_one_row_of_each_group(spark):
    df = cases.documents(spark, clashing=True)
    kept = simhash.without_near_duplicates(df)
    assert kept.columns == df.columns
    prints = [slow_fingerprint(r["text"]) for r in kept.collect()]
    groups = slow_components({slow_fingerprint(r[1]) for r in cases.rows()})
    assert sorted(groups[p] for p in prints) == sorted(set(groups.values()))
    assert simhash.without_near_duplicates(cases.empty(spark)).count() == 0

import random
import zlib
from collections import Counter, defaultdict

import pytest

from boxmill.llm import sharding
from boxmill.llm.queries import QUERIES
from tests.llm import cases

SF_DIR = "/root/testdata/sf0.1"


def test_query_holds_the_law_of_bytes(spark):
    texts = dict(map(tuple, spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()))
    rows = QUERIES["op10_sharding"](spark, SF_DIR).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    filled, places = Counter(), defaultdict(list)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        filled[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert set(filled) == set(range(24))
    assert max(filled.values()) - min(filled.values()) < 0.01 * sum(filled.values()) / 24
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert len({(r["virtual_slot"], r["shard"]) for r in rows}) == len({r["virtual_slot"] for r in rows})


def totals(seed=1, slots=500):
    rng = random.Random(seed)
    return [(s, rng.randint(1, 9), rng.randint(10, 4000)) for s in range(slots)]


def filled(table, shards):
    found = Counter(dict.fromkeys(range(shards), 0))
    for s in table:
        found[s.shard] += s.bytes
    return found


@pytest.mark.parametrize("shards", [25, 30, 20])
def test_rebalancing_moves_little_and_levels(shards):
    before = sharding.assign(totals(), 24)
    after = sharding.rebalance(before, totals(), shards)
    assert [s.virtual_slot for s in after] == [s.virtual_slot for s in before]
    moved = sum(b.bytes for a, b in zip(before, after) if a.shard != b.shard)
    whole = sum(s.bytes for s in after)
    assert moved < 1.6 * whole * abs(shards - 24) / max(shards, 24)
    sizes = filled(after, shards).values()
    assert max(sizes) - min(sizes) < 0.05 * whole / shards


def test_versions_are_stored_and_never_overwritten(spark, tmp_path):
    table = sharding.assign(totals(slots=40), 4)
    sharding.store(spark, table, str(tmp_path / "slots"), 1)
    later = sharding.rebalance(table, totals(seed=2, slots=50), 5)
    sharding.store(spark, later, str(tmp_path / "slots"), 2)
    assert sharding.load(spark, str(tmp_path / "slots"), 1) == table
    assert sharding.load(spark, str(tmp_path / "slots"), 2) == later
    with pytest.raises(Exception, match="(?i)exist"):
        sharding.store(spark, later, str(tmp_path / "slots"), 2)


def test_awkward_rows(spark):
    df = cases.documents(spark, clashing=True)
    table = sharding.assign(sharding.slot_totals(df))
    placed = sharding.placed(df, table).collect()
    assert len(placed) == len(cases.rows())
    assert {(r["text_crc32"], r["size"]) for r in placed if r["doc_id"] in (4, 5)} == {(0, 8)}
    sharded = sharding.with_shard(df, table)
    assert sharded.count() == len(cases.rows())
    assert sorted(sharded.columns) == sorted(df.columns)  # both new names clash and are replaced
    assert all(isinstance(r["shard"], int) for r in sharded.collect())
    none = cases.empty(spark)
    assert sharding.slot_totals(none) == []
    assert sharding.with_shard(none, sharding.assign([])).count() == sharding.placed(none, []).count() == 0

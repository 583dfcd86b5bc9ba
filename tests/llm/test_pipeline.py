import re
from collections import Counter

import pytest

import corpus_pipeline
from boxmill.llm import quality_rules, sharding
from boxmill.session import write_table
from tests.llm import cases
from tests.llm.test_decontaminate import slow as slow_hits
from tests.llm.test_mixing import slow_targets
from tests.llm.test_near_copies import slow_kept
from tests.llm.test_quality_rules import slow_counts

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The output of every stage at the smallest size, and of ``run``."""
    docs = [spark.read.parquet(f"{SF_DIR}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(write_table(stage(spark, docs[-1], SF_DIR), name))
    return [[r.asDict() for r in d.collect()] for d in docs], docs[0].columns


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_every_stage_equals_brute_force(spark, stages):
    (docs, good, single, clean, mixed, sharded), columns = stages
    model = quality_rules.train(spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet"))

    def passes(text):
        counts = slow_counts(text)
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        return not failed and model.score(quality_rules.measured([text])[1])[0] >= quality_rules.KEEP_FROM

    assert ids(good) == ids(r for r in docs if passes(r["text"]))
    assert ids(single) == slow_kept([(r["doc_id"], r["text"]) for r in good])
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    assert ids(clean) == ids(r for r in single if not slow_hits(r["text"], items)[1])
    sizes, largest = Counter(), Counter()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    for r in clean:
        sizes[r["source"]] += words(r["text"])
        largest[r["source"]] = max(largest[r["source"]], words(r["text"]))
    taken = Counter()
    for r in mixed:
        taken[r["source"]] += words(r["text"])
    for source, target in slow_targets(sizes).items():
        assert abs(taken[source] - target) <= 2 * largest[source]
    assert max(Counter(ids(mixed)).values()) <= 3
    assert Counter(ids(sharded)) == Counter(ids(mixed))
    for stage in (good, single, clean, mixed):
        assert all(list(r) == columns for r in stage)
    filled = Counter()
    for r in sharded:
        filled[r["shard"]] += len(r["text"].encode()) + sharding.ROW_BYTES
    biggest = max(len(r["text"].encode()) for r in sharded) * 3
    assert max(filled.values()) <= sum(filled.values()) / 24 + biggest


def test_run_gives_the_rows_of_the_stages(spark, stages):
    ours = corpus_pipeline.run(spark, SF_DIR).collect()
    assert Counter((r["doc_id"], r["shard"]) for r in ours) == Counter((r["doc_id"], r["shard"]) for r in stages[0][-1])


def test_stages_take_awkward_rows(spark):
    """Nothing is made up, repeated rows and clashing columns pass through, and nothing comes of nothing."""
    for docs in (cases.documents(spark, clashing=True), cases.empty(spark)):
        given = Counter((r["doc_id"], r["text"]) for r in docs.collect())
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF_DIR)
            found = Counter((r["doc_id"], r["text"]) for r in out.collect())
            assert set(found) <= set(given)
            if name == "sharding":
                assert {"virtual_slot", "shard"} <= set(out.columns)
            else:
                assert out.columns == docs.columns
            if name == "near_dedup":
                # Five groups by their words; the text with one word more shares over 80 % with its neighbour.
                assert sorted(len(t or "") for _, t in found) == sorted({len(t or "") for t in kept_texts(given)})
            if name in ("decontamination", "sharding"):
                assert found == given
            if name == "mixing":
                assert all(n <= 3 * given[r] for r, n in found.items())
            if name == "quality_rules":
                assert all(n == given[r] for r, n in found.items())


def kept_texts(rows):
    """The texts of the smallest ids of each group of near copies."""
    listed = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None))
    kept = slow_kept([(k, t) for k, (_, t) in enumerate(listed)])
    return [listed[k][1] for k in kept]

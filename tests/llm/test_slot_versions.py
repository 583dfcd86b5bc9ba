import corpus_pipeline
from boxmill.llm import sharding
from boxmill.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def test_query_places_rows_by_a_stored_version(spark, monkeypatch):
    stored, write = [], sharding.store
    monkeypatch.setattr(sharding, "store", lambda s, table, folder, version: (stored.append((folder, version)), write(s, table, folder, version)))
    rows = QUERIES["op10_sharding"](spark, SF_DIR).collect()
    ((folder, version),) = stored
    shard_of = {s.virtual_slot: s.shard for s in sharding.load(spark, folder, version)}
    assert version == 1 and all(shard_of[r["virtual_slot"]] == r["shard"] for r in rows)


def test_later_documents_move_few_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    folder = str(tmp_path)
    before = {r["doc_id"]: r["shard"] for r in corpus_pipeline.shard(spark, docs.where("doc_id % 10 <> 0"), SF_DIR, folder).collect()}
    after = {r["doc_id"]: r["shard"] for r in corpus_pipeline.shard(spark, docs, SF_DIR, folder, earlier=1).collect()}
    assert len(after) == docs.count() and len(sharding.load(spark, folder, 2)) >= len(sharding.load(spark, folder, 1))
    assert sum(after[i] != s for i, s in before.items()) < len(before) / 4

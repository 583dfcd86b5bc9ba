import zlib

import numpy as np
import pytest

from boxmill.llm import gam_quality, labelled, toxicity
from boxmill.llm.queries import QUERIES
from tests.llm import cases

SF_DIR = "/root/testdata/sf0.1"


def auc(scores, labels):
    order = np.argsort(np.argsort(scores, kind="stable"), kind="stable") + 1.0
    for s in set(scores):
        order[scores == s] = order[scores == s].mean()
    pos = labels == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize(
    "name, label, folds, out, least, cut",
    [("op5_gam_quality", "quality", 5, 0, 0.98, 0.3), ("op8_toxicity", "toxic", 3, 1, 0.93, 0.7)],
)
def test_held_out_accuracy(spark, name, label, folds, out, least, cut):
    known = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    rows = QUERIES[name](spark, SF_DIR).collect()
    assert len(rows) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == out)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in known]
    assert auc(np.array([r["score"] for r in held]), np.array([known[r["doc_id"]] for r in held])) >= least


def test_held_out_labels_are_never_read(spark):
    """Turning all held-out labels round changes no score."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = "pmod(crc32(cast(doc_id AS string)), {}) = {}"
    for label, module, folds, out in (("quality", gam_quality, 5, 0), ("toxic", toxicity, 3, 1)):
        turned = labels.selectExpr("doc_id", f"CASE WHEN {held.format(folds, out)} THEN 1 - {label} ELSE {label} END AS {label}")
        scores = [dict(module.scored(docs, module.train(docs, t)).select("doc_id", "score").collect()) for t in (labels, turned)]
        assert scores[0] == scores[1]


def test_ambiguous_and_null_labels_are_dropped(spark):
    rows = labelled.unambiguous(cases.labels(spark), "quality").collect()
    assert {r["doc_id"]: r["label"] for r in rows} == {i: i % 2 for i in (1, 3, 4, 5, 6, 7, 8, 9, 10)}


def test_sample_is_bounded_even_if_one_id_has_all_rows(spark):
    docs = spark.range(500).selectExpr("CAST(1 AS long) AS doc_id", "CAST(id AS string) AS text")
    sample = labelled.training_documents(docs, cases.labels(spark), "quality", labelled.F.lit(True), 10)
    assert sample.count() == 500 and labelled.first_rows(sample, 10).count() == 10


def test_tables_add_up():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, (2000, 3)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 2)).astype(float)
    model = gam_quality.fit_tables(x, y)
    for row, margin in zip(x[:100], model.margin(x[:100])):
        total = model.intercept + sum(t[np.searchsorted(e, v)] for e, t, v in zip(model.edges, model.main, row))
        total += sum(t[np.searchsorted(model.pair_edges[a], row[a]), np.searchsorted(model.pair_edges[b], row[b])] for (a, b), t in model.pairs.items())
        assert abs(total - margin) < 1e-9
    assert ((model.score(x) >= 0.5) == y).mean() > 0.99  # only a pair can tell
    assert (0, 1) in model.pairs


def test_noisy_or_is_the_chance_of_any_sentence():
    model = toxicity.Model({"bad": 0, "worse": 1}, np.array([3.0, 5.0]), -4.0)
    text = "a bad thing. nothing here! bad and worse\nfine"
    chances = [p for _, _, p in model.sentences(text)]
    assert np.allclose(chances, [1 / (1 + np.exp(-z)) for z in (-1, -4, 4, -4)])
    score, blame = model.score(text)
    assert abs(score - (1 - np.prod([1 - p for p in chances]))) < 1e-9
    assert [text[a:b] for a, b, _ in blame] == [" bad and worse"]
    assert model.score(None) == model.score("") == (0.0, [])


def test_gradient_finds_the_guilty_token():
    rng = np.random.default_rng(2)
    docs, labels = [], []
    for _ in range(400):
        toxic = rng.random() < 0.3
        docs.append([(int(t),) for t in rng.integers(1, 5, 6)] + ([(0,)] if toxic else []))
        labels.append(int(toxic))
    model = toxicity.fit({str(i): i for i in range(5)}, np.array(labels), docs, np.ones(400))
    assert model.weights[0] > 4 + max(model.weights[1:])


@pytest.mark.parametrize("module", [gam_quality, toxicity])
def test_awkward_rows(spark, module):
    for labels in (cases.labels(spark), cases.no_labels(spark)):
        model = module.train(cases.documents(spark), labels)
        rows = module.scored(cases.documents(spark, clashing=True), model).collect()
        assert len(rows) == len(cases.rows()) and all(0 <= r["score"] <= 1 for r in rows)
        assert all(r["label"] == "own" for r in rows)
    assert module.scored(cases.empty(spark), module.train(cases.empty(spark), cases.labels(spark))).count() == 0


def test_all_tokens_that_meet_the_rule_get_a_weight(spark):
    """More of them than any fixed number of the past, against counts in plain Python."""
    rows = [(k, f"plain words here. vile{chr(97 + k % 26)}{chr(97 + k // 26 % 26)} and more", 1) for k in range(1000)] * 3
    rows += [(5000 + k, "plain words here and more", 0) for k in range(3000)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, label int")
    seen = {}
    for _, text, label in rows:
        for t in toxicity.tokens(text):
            seen.setdefault(t, [0, 0])[label] += 1
    expected = sorted(t for t, (c, n) in seen.items() if n >= 3 and (n + 0.5) / 3001 > 4 * (c + 0.5) / 3001)
    assert len(expected) > 600
    assert toxicity.choose_tokens(sample) == expected


def test_lexicon_is_a_cache_only(monkeypatch):
    monkeypatch.setattr(toxicity, "REMEMBERED", 2)
    vocabulary = {"badly": 0, "badl-": 1, "word": 2}
    text = "badly badlyest word. words badl word"
    slow = [tuple(sorted(vocabulary[t] for t in toxicity.tokens(s) if t in vocabulary)) for s in text.split(".")]
    assert [ids for _, _, ids in toxicity.bags(text, toxicity.Lexicon(vocabulary))] == slow

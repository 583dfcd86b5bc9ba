import math
from collections import defaultdict

import numpy as np
import pytest

from boxmill.llm import language_id as lid
from boxmill.llm.queries import QUERIES
from tests.llm import cases

SF_DIR = "/root/testdata/sf0.01"


def softmax(logs):
    weights = [math.exp(x - max(logs)) for x in logs]
    return [w / sum(weights) for w in weights]


def slow(rows, langs):
    """The fusion by plain loops over evidence rows."""
    each = range(len(langs))
    kinds = [*langs, "?", "-"]
    told = lambda d: "-" if d is None else d if d in langs else "?"
    seen = np.ones((len(kinds), len(langs)))
    for r in rows:
        seen[kinds.index(told(r["declared"]))] += [round(p * lid.MICRO) / lid.MICRO for p in softmax(r["text_log"])]
    log_told = np.log(seen / seen.sum(axis=0))
    sums = defaultdict(lambda: np.zeros(len(langs)))
    logs, own = [], []
    for r in rows:
        logs.append([r["text_log"][k] + log_told[kinds.index(told(r["declared"])), k] for k in each])
        own.append(np.array([round(p * lid.MICRO) / lid.MICRO for p in softmax(logs[-1])]))
        for key in (("all",), ("s", r["suffix"]), ("d", r["domain"], r["suffix"]), ("h", r["host"])):
            sums[key] += own[-1]
    out = []
    for r, log, mine in zip(rows, logs, own):
        rest = np.maximum(sums[("all",)] - mine, 0)
        prior = (rest + 1) / (rest.sum() + len(langs))
        country = np.array([lid.SUFFIX_PAGES * (lid.SUFFIX_LANGUAGE.get(r["suffix"]) == x) for x in langs])
        for key, extra in ((("s", r["suffix"]), country), (("d", r["domain"], r["suffix"]), 0 * country), (("h", r["host"]), 0 * country)):
            rest = np.maximum(sums[key] - mine, 0)
            prior = (rest + lid.SMOOTHING * prior + extra) / (rest.sum() + lid.SMOOTHING + extra.sum())
        posterior = softmax([log[k] + math.log(prior[k]) for k in each])
        out.append((langs[int(np.argmax(np.round(posterior, 6)))], max(posterior)))
    return out


PAGES = [
    (1, "https://www.beispiel.de/a", '<html lang="de"><p>der die das und nicht</p></html>'),
    (2, "https://www.beispiel.de/b", "<html><p>zzz</p></html>"),
    (3, "https://other.de", "<html lang=en-US><p>qqq</p></html>"),
    (4, "http://user@News.Example.COM:80/x", "<html lang='xx'><script>der die das</script><p>the and of that with</p><!-- der --></html>"),
    (5, "not a url", "<html><p>the of and</p>"),
    (6, None, None),
    (None, "https://www.beispiel.de/a", ""),
    (1, "https://www.beispiel.de/a", '<html lang="de"><p>der die das und nicht</p></html>'),
    (8, "https://localhost/", "<p>" + "the and of that with " * 20000),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(
        [(1, "the and of that with for this is", "en"), (2, "der die das und nicht mit ist ein", "DE"), (3, None, "fr"), (4, "no label", None)],
        "doc_id long, text string, lang string",
    )


def test_equals_plain_loops(spark, corpus):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "1 AS prior", "2 AS own")
    model = lid.profiles(corpus)
    assert model.languages == ["de", "en"]
    rows = lid.evidence(pages, model).collect()
    expected = sorted((repr(r["page_id"]), lang, round(p, 5)) for r, (lang, p) in zip(rows, slow(rows, model.languages)))
    ours = lid.identified(pages, corpus).collect()
    assert sorted((repr(r["page_id"]), r["lang"], round(r["confidence"], 5)) for r in ours) == expected
    found = {r["page_id"]: r for r in ours}
    assert found[2]["lang"] == "de" and found[2]["confidence"] > 0.6  # from the suffix and the host
    assert found[4]["text_lang"] == found[4]["lang"] == "en" and found[4]["host"] == "news.example.com"
    assert found[6]["text_lang"] is None and found[6]["lang"] in ("de", "en")


def test_query_equals_plain_loops_and_mostly_agrees_with_markup(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    model = lid.profiles(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    rows = lid.evidence(pages, model).collect()
    expected = {r["page_id"]: lang for r, (lang, _) in zip(rows, slow(rows, model.languages))}
    ours = QUERIES["op2_language_id"](spark, SF_DIR).collect()
    assert {r["page_id"]: r["lang"] for r in ours} == expected
    assert sum(r["lang"] == r["declared"] for r in ours) > 0.95 * len(ours)


def test_text_alone_is_right_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("lang IS NOT NULL")
    model = lid.profiles(docs.where("doc_id % 2 = 0"))
    rest = docs.where("doc_id % 2 = 1 AND n_chars > 200").collect()
    right = sum(model.languages[int(np.argmax(model.log_likelihood(r["text"])[1]))] == r["lang"] for r in rest)
    assert right > 0.9 * len(rest)


def test_empty_tables(spark, corpus):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert lid.identified(pages.limit(0), corpus).count() == 0
    rows = lid.identified(pages, cases.empty(spark)).collect()
    assert len(rows) == len(PAGES) and all(r["lang"] is None for r in rows)

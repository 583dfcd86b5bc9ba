import random

import pytest

import corpus_pipeline
from boxmill.llm import near_copies
from tests.llm import cases


def slow_shingles(text):
    items = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {tuple(items[i : i + 5]) for i in range(max(1, len(items) - 4))} if items else frozenset()


def slow_kept(docs):
    """Ids that stay, by comparing all pairs; the ids are unique."""
    sets = [slow_shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (5 * len(a & b) >= 4 * len(a | b)):
                x, y = root(i), root(j)
                parent[x] = y
    least = {}
    for k, (doc_id, _) in enumerate(docs):
        least[root(k)] = min(least.get(root(k), doc_id), doc_id)
    return sorted(least.values())


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_stage_equals_all_pairs(spark, size):
    table = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    docs = [tuple(r) for r in table.select("doc_id", "text").collect()]
    kept = corpus_pipeline.near_dedup(spark, table, f"/root/testdata/{size}")
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == slow_kept(docs)


def test_crowds_chains_and_short_texts(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = ["one two", "One  TWO", "one two three", "", " \n", "a b c d e", "a b c d f"]
    for _ in range(150):
        changed = list(base)
        for k in rng.sample(range(200), rng.randint(0, 6)):
            changed[k] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(changed))
    chain = [f"c{k}" for k in range(300)]
    texts += [" ".join(chain[k : k + 100]) for k in range(0, 200, 9)]
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    kept = near_copies.without_near_copies(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == slow_kept(docs)


def template_texts(rng, count, changed):
    """Texts of 200 words that differ from one template in some places each."""
    base = [f"w{k}" for k in range(200)]
    texts = []
    for _ in range(count):
        own = list(base)
        for k in rng.sample(range(200), changed):
            own[k] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(own))
    return texts


def test_templates_do_not_make_all_pairs(spark, monkeypatch):
    """No two of these texts are near copies, though all share most of their words: none meet in the index.

    What is compared before, by bands, is bounded by two partners for each band of a text.
    """
    compared = []
    plain = near_copies.checked
    monkeypatch.setattr(near_copies, "checked", lambda pairs, sets: (compared.append(pairs.count()), plain(pairs, sets))[1])
    for n in (100, 400):
        docs = list(enumerate(template_texts(random.Random(n), n, 14)))
        compared.clear()
        kept = near_copies.without_near_copies(spark.createDataFrame(docs, "doc_id long, text string"))
        assert kept.count() == n
        assert sum(compared[:2]) <= 2 * near_copies.BANDS * n
        assert len(compared) > 2 and sum(compared[2:]) == 0


def test_crowds_near_the_measure(spark):
    """Some pairs of these are near copies and some are not."""
    rng = random.Random(12)
    texts = template_texts(rng, 40, 4) + template_texts(rng, 40, 5) + [t + " and some more words" for t in template_texts(rng, 20, 4)]
    docs = list(enumerate(texts))
    kept = near_copies.without_near_copies(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == slow_kept(docs)


def test_the_last_pass_is_complete_by_itself(spark, monkeypatch):
    """Without the rounds before it, the same groups are found."""
    monkeypatch.setattr(near_copies, "TURNS", 0)
    test_crowds_near_the_measure(spark)


def test_only_the_measure_links(spark):
    """16 of 20 shingles in common link two texts, 15 of 20 do not."""
    tail = lambda n, mark: " ".join(f"{mark}{k}" for k in range(n))
    docs = [(1, tail(24, "a")), (2, tail(20, "a")), (3, tail(24, "b")), (4, tail(19, "b"))]
    kept = near_copies.without_near_copies(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]


def test_awkward_rows(spark):
    df = cases.documents(spark, clashing=True)
    kept = near_copies.without_near_copies(df)
    assert kept.columns == df.columns
    sets = [frozenset(slow_shingles(r["text"])) for r in kept.collect()]
    assert len(sets) == len(set(sets)) and set(sets) <= {frozenset(slow_shingles(r[1])) for r in cases.rows()}
    assert near_copies.without_near_copies(cases.empty(spark)).count() == 0


def test_simhash_proposes_pairs(spark, monkeypatch):
    """Without a band, what SimHash links within four bits and shares 80 % of its shingles is joined, and nothing else is."""
    monkeypatch.setattr(near_copies, "bands", lambda text: [])
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    near, far = " ".join(base[:-1] + ["other"]), " ".join(base[200:] + base[:200] + [f"y{k}" for k in range(300)])
    texts = [" ".join(base), " ".join(base).upper(), near, far, "", None]
    prints = [near_copies.simhash.fingerprint((t or "").encode()) for t in texts]
    assert 0 < (prints[0] ^ prints[2]).bit_count() <= 4 < (prints[0] ^ prints[3]).bit_count()
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 4]


def test_simhash_links_below_the_measure_join_nothing(spark, monkeypatch):
    """One fingerprint for all texts proposes them all; only those at 80 % are joined."""
    monkeypatch.setattr(near_copies.simhash, "fingerprint", lambda text: 7)
    texts = template_texts(random.Random(3), 6, 14) + ["a b c d e", "a  B c d e", ""]
    docs = list(enumerate(texts))
    kept = near_copies.without_near_copies(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == slow_kept(docs)


@pytest.mark.parametrize("per_entry", [-1, 10**9])
def test_rounds_are_for_crowds_only(spark, monkeypatch, per_entry):
    """Where the last pass is in proportion, texts are checked three times: with their first partners, the others, and what meets in the index."""
    monkeypatch.setattr(near_copies, "PAIRS_PER_ENTRY", per_entry)
    checks = []
    plain = near_copies.checked
    monkeypatch.setattr(near_copies, "checked", lambda pairs, sets: (checks.append(1), plain(pairs, sets))[1])
    # Without a band, only the index can find these.
    monkeypatch.setattr(near_copies.simhash, "fingerprint", lambda text: 0)
    monkeypatch.setattr(near_copies, "bands", lambda text: [len(text or b"") % 2] if text else [])
    test_crowds_near_the_measure(spark)
    assert (len(checks) == 3) == (per_entry > 0)


@pytest.mark.parametrize("most", [1, 4096])
def test_bitmaps_leave_out_most_texts_and_no_listed_one(spark, monkeypatch, most):
    monkeypatch.setattr(near_copies, "MOST_MAPS", most)
    rows = spark.range(20_000).select("id", *near_copies.key_columns("id"))
    rows = rows.unionByName(rows.where("id < 10").selectExpr("-1 - id AS id", "key_a", "key_b"))
    listed = near_copies.write_table(rows.where("id >= 0 AND id % 5 = 0").select("key_a", "key_b"), "listed")
    found = near_copies.maybe_listed(rows, listed)
    assert found.columns == rows.columns
    ids = [r["id"] for r in found.collect()]
    assert len(ids) == len(set(ids)) and {*range(0, 20_000, 5), -1, -6} <= set(ids)
    # A bit is set by chance in one of sixteen places, or in one of eight with a single bitmap.
    assert len(ids) < 4002 + (16_000 * 0.08 if most > 1 else 16_000 * 0.16)
    assert near_copies.maybe_listed(rows, listed.limit(0)).isEmpty()

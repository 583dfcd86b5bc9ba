import random
import re
import zlib
from collections import Counter

import pytest

from boxmill.llm import spelling
from tests.llm import cases


def slow_vocabulary(docs):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            found[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def slow(docs):
    words = slow_vocabulary(docs)
    rows, forms = {}, {}
    for w, n in words.items():
        own = sorted((-words[v], v) for v in words if near(w, v))
        if own and -own[0][0] >= 10 * n:
            forms[w] = own[0][1]
        rows[w] = [n, len(own)]
    found = []
    for w, (n, n_near) in rows.items():
        root = w
        while root in forms:
            root = forms[root]
        found.append((w, forms.get(w), root, n, n_near, words[forms[w]] if w in forms else None))
    return sorted(found)


def ours(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in df.collect())


def variants(rng, word, letters):
    k = rng.randrange(len(word) + 1)
    kind = rng.randrange(3)
    if kind == 0:
        return word[:k] + rng.choice(letters) + word[k:]
    return word[: max(k - 1, 0)] + (rng.choice(letters) if kind == 1 else "") + word[max(k, 1) :]


@pytest.mark.parametrize("partition_words", [spelling.PARTITION_WORDS, 4])
def test_equals_brute_force(spark, partition_words):
    """Words of few letters, so that many are near and repeat letters; windows are halved down to one place with a small limit."""
    rng = random.Random(3)
    letters = "abé"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 12))) for _ in range(25)]
    pool = []
    for w in base:
        pool += [w] * rng.choice([2, 30, 400])
        for _ in range(6):
            pool += [variants(rng, w, letters)] * rng.choice([1, 2, 3, 30])
    rng.shuffle(pool)
    docs = [(k, " ".join(pool[k::60]).upper() if k % 7 == 0 else ", ".join(pool[k::60])) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert ours(spelling.spelling_groups(df, partition_words)) == slow(docs)


def test_acceptor_and_composition():
    rng = random.Random(8)
    for _ in range(60):
        words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(3, 4))) for _ in range(14)})
        found = sorted(tuple(sorted(p)) for p in spelling.Acceptor(words).near_pairs(99))
        assert found == sorted((a, b) for a in words for b in words if a < b and near(a, b))


def test_acceptor_is_minimal():
    acceptor = spelling.Acceptor(sorted(["tap", "taps", "top", "tops"]))
    reached, todo = {0}, [0]
    while todo:
        for state in acceptor.arcs[todo.pop()].values():
            if state not in reached:
                reached.add(state)
                todo.append(state)
    assert len(reached) == 5


def test_every_pair_is_in_one_window(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(7, 9))) for _ in range(300)})
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    for limit in (20_000, 30, 3):
        found = sorted((r["word"], r["near"]) for r in spelling.near_words(df, limit).collect())
        assert found == sorted((a, b) for a in words for b in words if near(a, b))


def test_crowded_partitions_are_split(spark):
    """Words with a common half: no partition stays above the limit unless its window is one place."""
    rng = random.Random(10)
    words = {"sameStart".lower() + "".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(800)}
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    dealt = spelling.partitions(df, 20)
    assert dealt.where("high - low > 1").groupBy("key_a", "key_b").count().where("count > 20").isEmpty()


def test_very_long_words(spark):
    word = "abcdefghij" * 2000
    docs = [(k, " ".join([word] * 30 + [word[:9000] + word[9001:]] * 2)) for k in (1, 2)]
    docs = [(k, t) for k, t in docs if all(zlib.crc32(f"{k}:{w}".encode()) % 31 for w in set(t.split()))]
    found = ours(spelling.spelling_groups(spark.createDataFrame(docs, "doc_id long, text string")))
    assert [r[1] for r in found if r[1]] == [word]


def test_awkward_rows(spark):
    for clashing in (False, True):
        assert ours(spelling.spelling_groups(cases.documents(spark, clashing))) == slow([r[:2] for r in cases.rows()])
    assert ours(spelling.spelling_groups(cases.empty(spark))) == []
    signs = [(None, "abcdefg×h abcdefg×h ABCDEFGÀà"), (3, None), (4, "abcdefg×h straßenbahn")]
    df = spark.createDataFrame(signs, "doc_id long, text string")
    assert ours(spelling.spelling_groups(df)) == slow(signs)
